"""Latest per group, ranks, limits, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.operators.lookups import no_op
from cairn.plans import views


def _latest(rows: DataFrame, *by: str) -> DataFrame:
    rest = F.struct(*[x for x in rows.columns if x not in by])
    return rows.groupBy(*by).agg(F.max_by(rest, "id").alias("_r")).select(*by, "_r.*")


def latest_successful(c) -> DataFrame:
    """The newest successful or partial run of each volume and kind."""
    return _latest(c.runs.where(F.col("status").isin("success", "partial") & F.col("volume_id").isNotNull()), "volume_id", "kind")


def latest_finished(c) -> DataFrame:
    """The newest finished (not aborted) run of each kind, volume and destination, none being one of its own."""
    rows = c.runs.where(F.col("status").isin("success", "partial", "failed", "refused") & F.col("volume_id").isNotNull())
    return _latest(rows, "kind", "volume_id", "destination")


def latest_sync(c) -> DataFrame:
    """W3"""
    return _latest(c.runs.where("kind = 'sync' and status = 'success' and volume_id is not null"), "volume_id", "destination")


def latest_index(c) -> DataFrame:
    """W4"""
    return _latest(c.runs.where(F.col("status").isin("success", "partial") & (F.col("kind") == "index") & F.col("volume_id").isNotNull()), "volume_id")


def latest_hook(c) -> DataFrame:
    """By start, then id"""
    rest = F.struct("id", "status", "started_at_ns", "ended_at_ns")
    return c.hook_runs.groupBy("volume_id", "trigger").agg(F.max_by(rest, F.struct("started_at_ns", "id")).alias("_r")).select("volume_id", "trigger", "_r.*")


def folded_runs(c) -> DataFrame:
    """W6 by volume, newest first: each maximal series of two or more no-op runs as one marker, all others as rows."""
    w = Window.partitionBy("volume_id").orderBy(F.desc("id"))
    rows = c.runs.where("volume_id is not null").withColumn("_quiet", F.coalesce(no_op(), F.lit(False)))
    starts = ~F.col("_quiet") | ~F.coalesce(F.lag("_quiet").over(w), F.lit(False))
    rows = rows.withColumn("_island", F.sum(starts.cast("long")).over(w))
    groups = rows.groupBy("volume_id", "_island").agg(F.count(F.lit(1)).alias("runs"), F.max("id").alias("id"))
    return groups.select("volume_id", "id", "runs", (F.col("runs") > 1).alias("folded"))


def dashboard(c, newest: int = 200, finished: int = 10) -> DataFrame:
    """Of the newest runs, the running ones and the latest finished."""
    top = c.runs.orderBy(F.desc("id")).limit(newest)
    done = top.where("status <> 'running'").orderBy(F.desc("id")).limit(finished)
    return top.where("status = 'running'").unionByName(done)


def active(c, newest: int = 50) -> DataFrame:
    """The running runs among the newest; limit first."""
    return c.runs.orderBy(F.desc("id")).limit(newest).where("status = 'running'")


def volume_activity(c, newest: int = 10) -> DataFrame:
    """By volume, whether any of its newest runs is running."""
    w = Window.partitionBy("volume_id").orderBy(F.desc("id"))
    top = c.runs.where("volume_id is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= newest)
    return top.groupBy("volume_id").agg(F.bool_or(F.col("status") == "running").alias("running"))


def entries(c) -> DataFrame:
    """Every folder's subfolders and present files with sizes, kind 0 for folders."""
    from cairn.operators.tree import rollup

    sizes = rollup(c).select("volume_id", "path", "cumulative_size")
    folders = c.folders.where("path <> ''").join(sizes, ["volume_id", "path"], "left").select(
        "volume_id", p.parent(F.col("path")).alias("folder"), p.last_segment(F.col("path")).alias("name"), F.coalesce("cumulative_size", F.lit(0)).alias("size_bytes"), F.lit(0).alias("kind")
    )
    files = views.live_rows(c).where("status = 'present'").select("volume_id", p.parent(F.col("path")).alias("folder"), "name", "size_bytes", F.lit(1).alias("kind"))
    return folders.unionByName(files)


def sorted_entries(c, volume_id: int, folder: str, by_size: bool = True) -> DataFrame:
    """W10 by size, W11 folders first."""
    rows = entries(c).where((F.col("volume_id") == volume_id) & (F.col("folder") == folder))
    return rows.orderBy(F.desc("size_bytes"), "kind", "name") if by_size else rows.orderBy("kind", "name")


def sorted_snapshots(snapshots: DataFrame) -> DataFrame:
    """W12"""
    return snapshots.orderBy(F.desc("taken_at"), "volume", "name")


def chosen_snapshot(snapshots: DataFrame, name: str | None = None) -> DataFrame:
    """The named one, or the newest."""
    return sorted_snapshots(snapshots).limit(1) if name is None else snapshots.where(F.col("name") == name)


def pack_groups(c) -> DataFrame:
    """Packs by key, members by offset."""
    members = c.pack_members.join(c.packs.select(F.col("id").alias("pack_id"), "pack_key"), "pack_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset_bytes", "content_id"))), lambda x: x["content_id"].cast("string"))
    return members.groupBy("pack_key").agg(F.array_join(ordered, ",").alias("members"))


def gathered_runs(c, volume_id: int | None, limit: int, only_failed: bool, only_changes: bool) -> DataFrame:
    """Filter, sort, limit, then count conflicts."""
    from cairn.operators.aggregates import conflict_counts
    from cairn.operators.lookups import filtered_runs

    rows = c.runs if volume_id is None else c.runs.where(F.col("volume_id") == volume_id)
    rows = rows.join(conflict_counts(c).withColumnRenamed("run_id", "id"), "id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return filtered_runs(rows, only_failed, only_changes, limit)


def routed(c, threshold: int) -> DataFrame:
    """Planned contents: large, small, or small and packed already."""
    planned = views.present_rows(c).select("content_id", "blake3", "size_bytes").distinct()
    known = c.pack_members.select("content_id", F.lit(True).alias("_packed")).distinct()
    route = F.when(F.col("size_bytes") >= threshold, "large").when(F.col("_packed"), "packed").otherwise("small")
    return planned.join(known, "content_id", "left").select("content_id", "blake3", "size_bytes", route.alias("route")).orderBy("blake3")


HASH_PREFERENCE = ("sha256", "sha1", "md5")


def chosen_checksum(hashes, preference=HASH_PREFERENCE):
    """The first non-empty hash by preference, then by name, as struct(algo, value)."""
    full = F.map_filter(hashes, lambda k, v: v.isNotNull() & (v != ""))
    name = F.coalesce(*[F.when(F.map_contains_key(full, a), a) for a in preference], F.array_min(F.map_keys(full)))
    return F.when(name.isNotNull(), F.struct(name.alias("algo"), F.element_at(full, name).alias("value")))


def worst(*levels):
    """The highest severity."""
    return F.greatest(*levels) if len(levels) > 1 else levels[0]
