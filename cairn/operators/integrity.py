"""Constraints as queries: each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: child table, column, parent table
FOREIGN = (("files", "folder_id", "folders"), ("files", "content_id", "contents"), ("remote_paths", "folder_id", "folders"), ("remote_paths", "content_id", "contents"), ("folders", "parent_id", "folders"))
UNIQUE = (("contents", ("blake3",)), ("folders", ("volume_id", "path")), ("files", ("folder_id", "name", "content_id")), ("volumes", ("name",)), ("vectors", ("volume_id", "destination", "origin_node_id")))
STATUS = ("present", "missing", "superseded", "offloaded")


def orphans(c) -> DataFrame:
    """Counts of rows whose parent is missing, by foreign key."""
    out = None
    for child, column, parent in FOREIGN:
        bad = getattr(c, child).where(F.col(column).isNotNull()).join(getattr(c, parent).select(F.col("id").alias(column)), column, "left_anti")
        one = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{child}.{column}").alias("constraint"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def violations(c) -> DataFrame:
    """(constraint, n) of foreign keys, unique keys, domains and the one live row a path may have."""
    out = orphans(c)
    for table, columns in UNIQUE:
        twice = getattr(c, table).groupBy(*columns).count().where("count > 1")
        out = out.unionByName(twice.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique {table}({','.join(columns)})").alias("constraint"), "n"))
    live = c.files.where("status <> 'superseded'").groupBy("folder_id", "name").count().where("count > 1")
    out = out.unionByName(live.agg(F.count(F.lit(1)).alias("n")).select(F.lit("one live row").alias("constraint"), "n"))
    bad = c.files.where(~F.col("status").isin(*STATUS))
    return out.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("status domain").alias("constraint"), "n"))


def compatible(version: int, known: int) -> bool:
    """X8"""
    return version <= known


def migrate(tables: dict[str, DataFrame], version: int, steps: list[tuple[int, Callable[[dict], dict]]]) -> tuple[dict[str, DataFrame], int]:
    """The steps above the version, in order."""
    for to, step in sorted(steps, key=lambda x: x[0]):
        if to > version:
            tables, version = step(tables), to
    return tables, version


def rebuilt(old: DataFrame, schema: str) -> DataFrame:
    """X11: cast to the new schema under ANSI rules; a lost row is an error."""
    from pyspark.sql.types import StructType

    new = old.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema)])
    if new.count() != old.count():
        raise ValueError("rows were lost")
    return new


def folder_audit(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Divergent folders by volume."""
    from cairn.operators.diffs import hash_divergence

    return hash_divergence(stored, derived).groupBy("volume_id").agg(F.count(F.lit(1)).alias("folders"))
