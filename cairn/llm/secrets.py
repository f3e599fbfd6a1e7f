"""Secret scans judged by corpus-wide ownership frequency.

Base findings (`assign`, `access`, `hex`) are located in every whole text. The method
looks wider: any token of 16 or more key-like characters that mixes letters and digits and lies in no
base finding is a candidate, known only by the SHA-256 of its characters. Over the
whole corpus each hash is counted by distinct repositories and distinct owners. A
hash that at least `common` owners or `common` repositories hold is a widely copied
example; one below that is specific to its owner, looks live, and is added as a `token`
span. Base spans are never taken away; their hashes are judged too, which gives
n_live and n_example.

Counting is two partially aggregated group-bys, (hash, repository, owner) and then hash,
so an example that a third of all documents hold is one row a task. The verdicts join
the narrow candidates by hash, where adaptive execution can split a hot hash.

Defined cases: a null text is empty; a null repository or owner is one of its own;
repeated rows are scanned as rows of their own and count as one repository; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairn.llm.common import boxed, settle, ship, text_of

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 16 or more hex digits: the maximal runs are the same as those of `[0-9a-f]+`.
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Bits a character a candidate must carry; words and numbers stay below it.
ENTROPY = 3.0
COMMON = 3


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the base findings, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates beyond the base findings."""
    out = []
    for m in TOKEN.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or entropy(s) < ENTROPY:
            continue
        if not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), s))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))


def _scan(batches):
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        base_sha, base_text, found = [], [], []
        for t in batch.column("text"):
            t = t.as_py() or ""
            base = base_spans(t)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            said = joined(x[:3] for x in base)
            base_text.append(said)
            base_sha.append(hashlib.sha256(said.encode()).hexdigest())
            found.append([{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(s.encode()).hexdigest()} for a, k, b, s in base + more_spans(t, base)])
        yield pa.record_batch(
            [batch.column("key"), batch.column("repo"), batch.column("owner"), batch.column("text_hash"), *[pa.array(x, pa.int64()) for x in counts], pa.array(base_sha, pa.string()), pa.array(base_text, pa.string()), pa.array(found, FOUND)],
            names=["key", "repo", "owner", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", "base_spans", "found"],
        )


SCHEMA = "key long, repo string, owner string, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, base_spans string, found array<struct<start int, kind int, end int, hash string>>"


def scan(docs: DataFrame, key: str = "doc_id", repo=None, owner=None, common: int = COMMON) -> DataFrame:
    """(key, text_hash, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) for every row.

    `repo` and `owner` are columns; by default a repository is a source in one language
    and an owner a source.
    """
    owner = F.col("source") if owner is None else owner
    # A null source or language is its own, also beside the same text in the other column.
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    repo = F.concat_ws("/", named("source"), named("lang")) if repo is None else repo
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    seen = rows.mapInArrow(_scan, SCHEMA).withColumn("_row", F.monotonically_increasing_id())
    seen = settle(seen)
    held = seen.where(F.size("found") > 0)
    single = held.select("_row", "repo", "owner", F.explode("found").alias("f"))
    owners = single.groupBy(F.col("f.hash").alias("hash"), "repo", "owner").agg(F.lit(1).alias("one"))
    owners = owners.groupBy("hash").agg(F.count_distinct("owner").alias("_owners"), F.count_distinct("repo").alias("_repos"))
    verdict = owners.select("hash", ((F.col("_owners") >= common) | (F.col("_repos") >= common)).alias("example"))
    judged = single.select("_row", "f.*").join(settle(verdict), "hash", "left")
    live = F.col("kind").isin(0, 1, 2) | ~F.col("example")
    span = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.col("start"), F.col("end"))
    per_row = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(live, F.struct("start", "kind", span.alias("span"))))).alias("all"),
        F.count_if(~F.col("example")).alias("n_live"), F.count_if(F.col("example")).alias("n_example"),
    )
    numbers = ["text_hash", "n_assign", "n_access", "n_hex", "base_sha256"]
    with_some = held.join(per_row, "_row").select(F.col("key").alias(key), *numbers, F.array_join("all.span", ",").alias("spans"), "n_live", "n_example")
    none = seen.where(F.size("found") == 0).select(F.col("key").alias(key), *numbers, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return with_some.unionByName(none)


def mask(text: str, spans: str) -> str:
    """`text` with every span, and what overlaps it, replaced by the first one's kind in angle brackets."""
    out, upto, end = [], 0, -1
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        a, b = int(a), int(b)
        if a >= end:
            out.append(text[upto:a] + f"<{kind}>")
        end = upto = max(b, end)
    return "".join(out) + text[upto:]


@F.pandas_udf(StringType())
def _masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if not isinstance(x, str) or t is None else mask(t, x) for t, x in zip(text, spans)], dtype=object)


def redact(docs: DataFrame, key: str = "doc_id", common: int = COMMON) -> DataFrame:
    """`docs` with every found span of its texts replaced by its kind in angle brackets; all rows stay, n_chars follows.

    Spans are joined by key and the text's hash, so rows that share a key keep their own.
    """
    found = scan(docs, key, common=common).where("spans <> ''")
    marks = settle(found.select(F.col(key).alias("mk"), F.col("text_hash").alias("mh"), "spans").dropDuplicates(["mk", "mh"]))
    rows = boxed(docs, F.col(key).cast("long").alias("k"), F.xxhash64(text_of()).alias("h"))
    rows = rows.join(marks, rows["k"].eqNullSafe(marks["mk"]) & (rows["h"] == marks["mh"]), "left")
    body, found_some = F.col("row.text"), F.col("spans").isNotNull()
    rows = rows.select("row", found_some.alias("cut"), F.when(found_some, _masked(body, F.col("spans"))).otherwise(body).alias("text"))
    new = {"text": lambda: F.col("text"), "n_chars": lambda: F.when(F.col("cut"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[(new[x]() if x in new else F.col(f"row.`{x}`")).alias(x) for x in docs.columns])


ship(__name__)
