"""Point lookups, projections and filters over the catalog."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.plans import views


def live_at(c, volume_id: int, path: str) -> DataFrame:
    """P1"""
    folder, name = posixpath.split(path)
    ids = c.folders.where((F.col("volume_id") == volume_id) & (F.col("path") == folder)).select(F.col("id").alias("folder_id"))
    return views.live_rows(c).where(F.col("name") == name).join(F.broadcast(ids), "folder_id", "left_semi")


def by_absolute_path(c, absolute: DataFrame) -> DataFrame:
    """For each `abs`, the live row in the deepest volume that holds it; volumes without the row fall through."""
    v = c.volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("_root"))
    under = absolute.join(F.broadcast(v), F.col("abs").startswith(F.concat("_root", F.lit("/"))))  # volumes: a configured few
    under = under.withColumn("path", p.relative(F.col("_root"), F.col("abs")))
    found = under.join(views.live_rows(c), ["volume_id", "path"])
    keep = F.struct("volume_id", "path", "id", "blake3", "status")
    return found.groupBy("abs").agg(F.max_by(keep, F.struct(F.length("_root"), "volume_id")).alias("r")).select("abs", "r.*")


def history_at(c, volume_id: int, path: str) -> DataFrame:
    """P4"""
    return views.all_rows(c).where((F.col("volume_id") == volume_id) & (F.col("path") == path)).orderBy("first_seen_run_id", "id")


def by_digest(c, digest: str) -> DataFrame:
    """P5"""
    return views.with_volume(c, views.all_rows(c).where(F.col("blake3") == digest.lower())).orderBy("volume", "path")


def dedup_sources(c) -> DataFrame:
    """P6 for every digest: the first present path that holds it, outside the reserved subtrees."""
    rows = views.live_rows(c).where("status = 'present'").where(~p.hidden_in_dedup(F.col("path")))
    return rows.groupBy("volume_id", "blake3").agg(F.min("path").alias("path"))


def missing(c) -> DataFrame:
    """P7"""
    return views.with_volume(c, views.live_rows(c).where("status = 'missing'"))


def present_paths(c, volume_id: int) -> DataFrame:
    """P8"""
    return views.live_rows(c).where((F.col("volume_id") == volume_id) & (F.col("status") == "present")).select("path").distinct()


def present_in_folder(c, folder_id: int) -> DataFrame:
    """P9"""
    return views.live_rows(c).where((F.col("folder_id") == folder_id) & (F.col("status") == "present")).orderBy("name")


def present_by_origin(c, node_id: int | None, volume_id: int | None = None) -> DataFrame:
    """A null node means no recorded origin."""
    rows = views.live_rows(c).where("status = 'present'").where(F.col("origin_node_id").eqNullSafe(F.lit(node_id).cast("long")))
    return rows if volume_id is None else rows.where(F.col("volume_id") == volume_id)


def present_content(c, volume_id: int) -> DataFrame:
    """P11"""
    return views.present_rows(c).where(F.col("volume_id") == volume_id)


def path_delta(c, volume_id: int, since: int) -> DataFrame:
    """Rows whose last change lies behind the watermark, whatever their status."""
    rows = views.all_rows(c).where((F.col("volume_id") == volume_id) & ~p.hidden_in_queries(F.col("path")))
    return rows.where(F.coalesce("status_changed_run_id", "first_seen_run_id") > since).orderBy("path", "status")


def folder_by_path(c, volume_id: int, path: str) -> DataFrame:
    """P13"""
    return c.folders.where((F.col("volume_id") == volume_id) & (F.col("path") == path))


def child_folders(c, parent_id: int) -> DataFrame:
    """P14"""
    return c.folders.where(F.col("parent_id") == parent_id).orderBy("path")


def by_id(table: DataFrame, id_: int) -> DataFrame:
    """P15, P18, P42, P46, P50"""
    return table.where(F.col("id") == id_)


def runs(c, volume_id: int | None = None, newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """P16"""
    rows = c.runs if volume_id is None else c.runs.where(F.col("volume_id") == volume_id)
    rows = rows.orderBy(F.desc("id") if newest_first else F.asc("id"))
    return rows if limit is None else rows.limit(limit)


def runs_by_peer(c, peer: int, limit: int) -> DataFrame:
    """P17"""
    return c.runs.where((F.col("kind") == "sync") & (F.col("peer_node_id") == peer)).orderBy(F.desc("id")).limit(limit)


def audits_since(c, volume_id: int, since_ns: int) -> DataFrame:
    """P19"""
    return c.runs.where((F.col("kind") == "audit") & (F.col("volume_id") == volume_id) & (F.col("started_at_ns") > since_ns)).orderBy("id")


def no_op():
    """P20"""
    return (F.col("status") == "success") & (F.coalesce("changed_count", "file_count") == 0)


def contested(c) -> DataFrame:
    """P21"""
    return c.contested_paths.orderBy("volume_id", "path")


def at_key(table: DataFrame, **key) -> DataFrame:
    """Rows whose columns have the key's values."""
    for name, value in key.items():
        table = table.where(F.col(name) == value)
    return table


def contested_flags(c, rows: DataFrame) -> DataFrame:
    """(contested, live_blake3) for each (volume_id, path); a latch without digest still counts."""
    latch = c.contested_paths.select("volume_id", "path", "live_blake3", F.lit(True).alias("_latch"))
    return rows.join(latch, ["volume_id", "path"], "left").withColumn("contested", F.coalesce("_latch", F.lit(False))).drop("_latch")


def sorted_table(table: DataFrame, *by: str) -> DataFrame:
    """P21, P24, P29-P31, P33, P35, P43, P47"""
    return table.orderBy(*by)


def hook_runs(c, volume_id: int | None = None, newest_first: bool = True, limit: int | None = None) -> DataFrame:
    """P34"""
    rows = c.hook_runs if volume_id is None else c.hook_runs.where(F.col("volume_id") == volume_id)
    rows = rows.orderBy(F.desc("id") if newest_first else F.asc("id"))
    return rows if limit is None else rows.limit(limit)


def exists_in(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows that the table knows."""
    return rows.join(table, on, "left_semi")


def self_node(c) -> DataFrame:
    """P44"""
    return c.nodes.where(F.col("endpoint").isNull())


def volume_by_path(c) -> DataFrame:
    """P49 for every path: the lowest id wins."""
    return c.volumes.groupBy("path").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id"))


def config_drift(c) -> DataFrame:
    """P51"""
    return c.config_drift.where("id = 1")


def origin_matches(filter_active: bool, node_id: int | None):
    """P53"""
    return F.lit(True) if not filter_active else F.col("origin_node_id").eqNullSafe(F.lit(node_id).cast("long"))


def by_digest_from(c, digest: str, filter_active: bool, node_id: int | None) -> DataFrame:
    """P54"""
    return by_digest(c, digest).where(origin_matches(filter_active, node_id))


def by_path_query(c, volume_id: int, path: str, with_history: bool, filter_active: bool = False, node_id: int | None = None) -> DataFrame:
    """P55"""
    rows = history_at(c, volume_id, path) if with_history else live_at(c, volume_id, path)
    return rows.where(origin_matches(filter_active, node_id))


def query(c, argument: str, with_history: bool = False) -> DataFrame:
    """A digest, an absolute path, or a path relative to any volume."""
    import re

    if re.fullmatch("[0-9a-fA-F]{64}", argument):
        return by_digest(c, argument).select(*views.ROW)
    if argument.startswith("/"):
        found = by_absolute_path(c, c.spark.createDataFrame([(argument,)], "abs string")).select("volume_id", "path")
        return (views.all_rows(c) if with_history else views.live_rows(c)).join(F.broadcast(found), ["volume_id", "path"], "left_semi")
    rows = views.all_rows(c) if with_history else views.live_rows(c)
    return rows.where(F.col("path") == argument)


def split_by_status(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, superseded)"""
    return rows.where("status <> 'superseded'"), rows.where("status = 'superseded'")


def needs_attention():
    """P60"""
    return F.col("status").isin("failed", "refused", "aborted", "partial")


def interesting():
    """Not a no-op, or with conflicts."""
    return ~F.coalesce(no_op(), F.lit(False)) | (F.coalesce("conflicts", F.lit(0)) > 0)


def filtered_runs(rows: DataFrame, only_failed: bool, only_changes: bool, limit: int) -> DataFrame:
    """Predicates before the limit."""
    if only_failed:
        rows = rows.where(needs_attention())
    if only_changes:
        rows = rows.where(interesting())
    return rows.orderBy(F.desc("id")).limit(limit)


def matched_selectors(rows: DataFrame, selectors: list[str]) -> DataFrame:
    """Rows with their first matching selector ('.', the path, or a folder above it)."""
    choice = F.lit(None).cast("string")
    for s in reversed(selectors):
        hit = F.lit(True) if s == "." else (F.col("path") == s) | F.col("path").startswith(s + "/")
        choice = F.when(hit, s).otherwise(choice)
    return rows.withColumn("selector", choice).where("selector is not null")


def candidates(c, volume_id: int, selectors: list[str], cutoff_ns: int) -> DataFrame:
    """Present rows outside the reserved subtrees that a selector names and that are older than the cutoff."""
    rows = views.live_rows(c).where((F.col("volume_id") == volume_id) & (F.col("status") == "present") & ~p.under_reserved(F.col("path")))
    return matched_selectors(rows, selectors).where(F.col("mtime_ns") < cutoff_ns).orderBy("path")


def unmatched_selectors(c, volume_id: int, selectors: list[str]) -> list[str]:
    """Selectors without a hit; age does not count. Selectors are a command's few arguments."""
    rows = views.live_rows(c).where((F.col("volume_id") == volume_id) & (F.col("status") == "present") & ~p.under_reserved(F.col("path")))
    hit = {r[0] for r in matched_selectors(rows, selectors).select("selector").distinct().collect()}
    return [s for s in selectors if s not in hit]


def clean_selectors(selectors: list[str]) -> list[str]:
    """P65"""
    out = []
    for s in selectors:
        if not s or s.startswith("/"):
            raise ValueError(f"selector must be a relative path: {s!r}")
        clean = posixpath.normpath(s)
        if clean == ".." or clean.startswith("../"):
            raise ValueError(f"selector leaves the volume: {s!r}")
        out.append(clean)
    return out


def held(rows: DataFrame, target: DataFrame) -> DataFrame:
    """(path, held): whether the target has the row's size and digest."""
    have = target.select("path", F.col("size_bytes").alias("_s"), F.col("blake3").alias("_d"))
    same = F.coalesce((F.col("_s") == F.col("size_bytes")) & (F.col("_d") == F.col("blake3")), F.lit(False))
    return rows.join(have, "path", "left").select("path", same.alias("held"))


def pairs(c, volume: str | None = None, destination: str | None = None) -> DataFrame:
    """Volumes and the targets they push to."""
    rows = c.sync_to.join(c.volumes.select(F.col("id").alias("volume_id"), F.col("name").alias("volume")), "volume_id")
    if volume is not None:
        rows = rows.where(F.col("volume") == volume)
    if destination is not None:
        rows = rows.where(F.col("target") == destination)
    return rows.select("volume", "target")


def ordered_targets(c) -> DataFrame:
    """Push targets, then required ones, each once, in order."""
    both = c.sync_to.withColumn("part", F.lit(0)).unionByName(c.offload_requires.withColumn("part", F.lit(1)))
    return both.groupBy("volume_id", "target").agg(F.min(F.col("part") * 1000 + F.col("ordinal")).alias("place"))


def accepted_destinations(c) -> DataFrame:
    """P74"""
    return c.sync_to.select("volume_id", "target").union(c.offload_requires.select("volume_id", "target")).distinct()


def validate_names(names: list[str]) -> None:
    """P75: non-empty and distinct."""
    if any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError(f"names must be non-empty and distinct: {names}")


def has_running(c, kind: str, volume_id: int, destination: str | None) -> DataFrame:
    """At most one row."""
    here = (F.col("kind") == kind) & (F.col("volume_id") == volume_id) & F.col("destination").eqNullSafe(F.lit(destination).cast("string"))
    return c.runs.where(here & (F.col("status") == "running")).limit(1).select(F.lit(True).alias("running"))


def latest_sync_id(c, volume_id: int, destination: str) -> DataFrame:
    """Among the volume's last twenty runs only."""
    last = c.runs.where(F.col("volume_id") == volume_id).orderBy(F.desc("id")).limit(20)
    return last.where((F.col("kind") == "sync") & (F.col("destination") == destination)).agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))


def materialises(disposition):
    """P78"""
    return disposition.isin("transfer", "supersede", "conflict", "copy-from-existing")


def awaiting_content(session: DataFrame) -> DataFrame:
    """For each digest the sorted paths that still need its bytes."""
    need = session.where(F.col("disposition").isin("transfer", "supersede", "conflict") & ~F.col("landed"))
    return need.groupBy("blake3").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.max("size_bytes").alias("size_bytes"))


def commits(disposition, status: str, landed):
    """P80"""
    return materialises(disposition) & (landed if status == "failed" else F.lit(True))


def matches_record(listing: DataFrame, live: DataFrame) -> DataFrame:
    """(path, same): listed file of the recorded size and time."""
    rec = live.select("path", F.col("size_bytes").alias("_s"), F.col("mtime_ns").alias("_m"))
    same = (F.col("kind") == "file") & (F.col("size_bytes") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m"))
    return listing.join(rec, "path", "left").select("path", F.coalesce(same, F.lit(False)).alias("same"))


def volumes_syncing_to(c, target: str) -> DataFrame:
    """P82"""
    return c.sync_to.where(F.col("target") == target).join(c.volumes.select(F.col("id").alias("volume_id"), "name"), "volume_id").select("name").orderBy("name")


def verifiable(c) -> DataFrame:
    """P83"""
    return c.destinations.where("type <> 'kopia'").select("name").orderBy("name")


def verify_cadences(c, default_ns: int) -> DataFrame:
    """Each verifiable destination's own cadence or the default, if positive."""
    own = F.coalesce(F.nullif(F.col("verify_every_ns"), F.lit(0)), F.lit(default_ns)).cast("long")
    return c.destinations.where("type <> 'kopia'").select("name", own.alias("verify_every_ns")).where("verify_every_ns > 0")


def with_stake(c) -> DataFrame:
    """Volumes that push anywhere or require anything."""
    return c.volumes.join(accepted_destinations(c), F.col("id") == F.col("volume_id"), "left_semi").select("id")


def effective_shallow(shallow, encrypted):
    """P86"""
    return shallow | encrypted


def prior_provenance(rows: DataFrame) -> DataFrame:
    """The origin pair, null unless whole."""
    whole = F.col("origin_node_id").isNotNull() & F.col("origin_run_id").isNotNull()
    return rows.select("id", F.when(whole, F.col("origin_node_id")).alias("node"), F.when(whole, F.col("origin_run_id")).alias("run"))


def runs_of_kind(c, kind: str) -> DataFrame:
    """P90: '' for all."""
    return c.runs if kind == "" else c.runs.where(F.col("kind") == kind)


def valid_origin(node, run, self_name: str):
    """Both or neither, a positive run, a plain name, never this node."""
    neither = node.isNull() & run.isNull()
    both = node.isNotNull() & run.isNotNull() & (run > 0) & node.rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$") & (node != self_name)
    return F.coalesce(neither | both, F.lit(False))


def valid_freshness(node, run):
    """P89"""
    return F.coalesce(node.rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$") & (run > 0), F.lit(False))
