"""Derived views that most operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as p

ROW = ["id", "volume_id", "folder_id", "name", "path", "content_id", "blake3", "size_bytes", "mtime_ns", "status", "first_seen_run_id", "last_seen_run_id", "indexed_at_ns", "origin_node_id", "origin_run_id", "status_changed_run_id"]


def all_rows(c) -> DataFrame:
    """Every observation with its path and content."""
    folders = c.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("_folder"))
    contents = c.contents.select(F.col("id").alias("content_id"), "blake3", "size_bytes", "origin_node_id", "origin_run_id")
    rows = c.files.join(folders, "folder_id").join(contents, "content_id")
    return rows.withColumn("path", p.joined(F.col("_folder"), F.col("name"))).select(*ROW)


def live_rows(c) -> DataFrame:
    """Every row that is not superseded."""
    return all_rows(c).where("status <> 'superseded'")


def present_rows(c) -> DataFrame:
    """Live, present, outside the reserved subtrees."""
    return live_rows(c).where("status = 'present'").where(~p.hidden_in_queries(F.col("path")))


def introductions(c) -> DataFrame:
    """A10: (volume_id, content_id, run): the first run that saw a content, whatever its status since."""
    return c.files.groupBy("volume_id", "content_id").agg(F.min("first_seen_run_id").alias("run"))


def origins(c) -> DataFrame:
    """(volume_id, content_id, node, run): the recorded origin if whole, else this node's introduction."""
    contents = c.contents.select(F.col("id").alias("content_id"), "origin_node_id", "origin_run_id")
    whole = F.col("origin_node_id").isNotNull() & F.col("origin_run_id").isNotNull()
    return introductions(c).join(contents, "content_id").select(
        "volume_id", "content_id", F.when(whole, F.col("origin_node_id")).otherwise(F.lit(1)).cast("long").alias("node"),
        F.when(whole, F.col("origin_run_id")).otherwise(F.col("run")).alias("run"),
    )


def evidence(c) -> DataFrame:
    """(content_id, destination, checksum, verified_at_ns, layout) of objects, packs and paths."""
    cols = ["content_id", "destination", "checksum", "verified_at_ns"]
    packs = c.pack_members.join(c.remote_packs, "pack_id")
    stored = c.remote_paths.where(F.col("state").isin("live", "displaced"))
    parts = [(c.remote_objects, "object"), (packs, "pack"), (stored, "path")]
    first, *rest = [df.select(*cols, F.lit(layout).alias("layout")) for df, layout in parts]
    for x in rest:
        first = first.unionByName(x)
    return first


def with_volume(c, rows: DataFrame) -> DataFrame:
    return rows.join(c.volumes.select(F.col("id").alias("volume_id"), F.col("name").alias("volume")), "volume_id")
