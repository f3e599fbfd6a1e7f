"""SimHash fingerprints and meet-in-the-middle ball hashing.

A fingerprint is 64 bits over the text's word shingles. Two fingerprints at distance
two or less share a variant at distance one or less from both, so every distinct
fingerprint emits itself and its 64 one-bit variants; rows are shuffled on the
variant. At most 65 fingerprints can meet in a variant, so no key is hot: documents
with the same fingerprint are one row there, however many copies there are. Members
of a variant are verified against the next one, which links all of them.

Defined cases: a null text has no words; a text without words has fingerprint zero and
is linked like any other; fewer words than a shingle are one shingle; a null id is a
document that joins a group but never names one, unless all its members are null;
repeated rows share a group; very long texts are read whole; an empty table gives no rows; extra
columns, whatever their names, are kept by `keep_first` and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import boxed, settle, ship, text_of
from cairn.llm.components import components

WIDTH = 3
SEED = 42


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, six ASCII spaces
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(width)))]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(ones).view(">i8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text")
        out = [fingerprint(t.as_py() or "") for t in texts]
        yield pa.record_batch([batch.column("key"), pa.array(out, pa.int64())], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row."""
    return docs.select(F.col(key).cast("long").alias("key"), text_of().alias("text")).mapInArrow(_fingerprints, "key long, fp long")


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): verified pairs within two bits that connect all of each variant's fingerprints."""
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]])
    variants = distinct.select(F.col(fp).alias("b"), F.explode(flips).alias("_flip"))
    variants = variants.select(F.col("b").bitwiseXOR(F.col("_flip")).alias("_variant"), "b")
    a = F.lag("b").over(Window.partitionBy("_variant").orderBy("b")).alias("a")
    met = variants.select(a, "b").where("a is not null")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row: the smallest key reachable over links."""
    prints = settle(fingerprints(docs, key))
    classes = settle(prints.groupBy("fp").agg(F.min("key").alias("least")))
    member = components(links(classes))
    roots = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(roots.join(names, "component").select("fp", "component_id"))
    # Copies of one text may hold a third of the rows: the outer join keeps the narrow
    # side whole and lets adaptive execution split the hot one.
    joined = prints.join(named, "fp", "left")
    return joined.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One document of each group: the one that names it. A key's repeated rows all go or one of them stays.

    Rows with a null key name no group: they stay.
    """
    gone = near_duplicates(docs, key).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    return boxed(docs, F.col(key).cast("long").alias("gone")).join(settle(gone), "gone", "left_anti").select("row.*")


ship(__name__)
