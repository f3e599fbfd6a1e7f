"""Sinks: manifests, placements, catalog snapshots, object and pack writes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.shipping import ship

VERSION = 1


def write_manifest(delta: DataFrame, path: str) -> None:
    """K1: one JSONL segment, ordered by path and status; a segment is a run's delta."""
    delta.select("path", "blake3", "status", "size_bytes", "mtime_ns").orderBy("path", "status").coalesce(1).write.json(path)


def write_placements(placements: DataFrame, path: str) -> None:
    """K2"""
    placements.select("blake3", "pack", "offset", "length").orderBy("pack", "offset").write.json(path)


def upload_each(rows: DataFrame, put: Callable[[str, int], None]) -> DataFrame:
    """K3: calls put(blake3, size) for each object; a failure is that row's outcome and stops no other."""

    def run(parts):
        for pdf in parts:
            errors = []
            for digest, size in zip(pdf["blake3"], pdf["size_bytes"]):
                try:
                    put(digest, int(size))
                    errors.append(None)
                except Exception as e:  # each object fails alone
                    errors.append(str(e))
            yield pd.DataFrame({"blake3": pdf["blake3"], "error": pd.Series(errors, dtype=object)})

    return rows.select("blake3", "size_bytes").mapInPandas(run, "blake3 string, error string")


def placements(packed: DataFrame) -> DataFrame:
    """K4: where each member lies in its pack; packed: blake3, size_bytes, pack (as the bin fill gives it)."""
    w = Window.partitionBy("pack").orderBy("blake3").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("blake3", "pack", F.coalesce(F.sum("size_bytes").over(w), F.lit(0)).alias("offset"), F.col("size_bytes").alias("length"))


def save_catalog(tables: dict[str, DataFrame], path: str, snapshot: str) -> None:
    """K5, K6: every table under a new snapshot folder, and only then the pointer to it."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{snapshot}/{name}")
    head = spark.createDataFrame([(snapshot, VERSION, ",".join(tables))], "snapshot string, version int, tables string")
    head.coalesce(1).write.mode("overwrite").json(f"{path}/CURRENT")


def rotated(snapshots: DataFrame, keep: int, exempt_migrations: bool = True) -> DataFrame:
    """K7, K8: the snapshots beyond the newest `keep`; snapshots: name, mtime_ns."""
    rows = snapshots.where(~F.col("name").contains("pre-migration")) if exempt_migrations else snapshots
    return rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("mtime_ns"), F.desc("name")))).where(F.col("_r") > keep).drop("_r")


def write_path_filter(paths: DataFrame, path: str) -> bool:
    """K9: nothing is written when there is no path."""
    if not paths.limit(1).count():
        return False
    paths.select("path").orderBy("path").coalesce(1).write.text(path)
    return True


def keyed_name(key: str, domain: str, value):
    """K10"""
    return F.sha2(F.concat(F.lit(key), F.lit(domain), F.lit("\x00"), value), 256)


def schema_dump(tables: dict[str, DataFrame]) -> str:
    """K11, X12"""
    return "\n".join(f"{name}: {tables[name].schema.simpleString()}" for name in sorted(tables))


ship(__name__)
