"""Counts, maxima and sequential folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cairn.functions import paths as p
from cairn.functions.shipping import ship
from cairn.plans import views


def present_counts(c) -> DataFrame:
    """A1 by volume"""
    return c.files.where("status = 'present'").groupBy("volume_id").agg(F.count(F.lit(1)).alias("files"))


def missing_by_run(c) -> DataFrame:
    """A2 by run: rows whose absence the run saw"""
    return c.files.where("status = 'missing'").groupBy(F.col("last_seen_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("missing"))


def first_seen_by_run(c, run_ids: DataFrame, prefix: str) -> DataFrame:
    """A3, A4: rows first seen by the given runs below a folder prefix; runs without any are absent."""
    rows = views.all_rows(c).where(F.col("path").startswith(prefix))
    return rows.join(run_ids.select(F.col("run_id").alias("first_seen_run_id")), "first_seen_run_id", "left_semi").groupBy(F.col("first_seen_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("files"))


def contested_by_run(c) -> DataFrame:
    """A5"""
    return c.contested_paths.groupBy(F.col("raised_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("raised"))


def conflict_counts(c) -> DataFrame:
    """By run the larger of the latches it raised and the conflict copies it wrote."""
    copies = views.all_rows(c).where(F.col("path").startswith(p.PREFIX)).groupBy(F.col("first_seen_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("copies"))
    zero = F.lit(0)
    both = contested_by_run(c).join(copies, "run_id", "full_outer")
    return both.select("run_id", F.greatest(F.coalesce("raised", zero), F.coalesce("copies", zero)).alias("conflicts"))


def files_by_origin(c) -> DataFrame:
    """Present files by volume and origin coordinate."""
    rows = views.present_rows(c).select("volume_id", "content_id").join(views.origins(c), ["volume_id", "content_id"])
    return rows.groupBy("volume_id", "node", "run").agg(F.count(F.lit(1)).alias("files"))


def known_maxima(c) -> DataFrame:
    """By volume and origin node, the last run known of contents of any status."""
    rows = views.all_rows(c).where(~p.hidden_in_queries(F.col("path"))).select("volume_id", "content_id").distinct()
    return rows.join(views.origins(c), ["volume_id", "content_id"]).groupBy("volume_id", "node").agg(F.max("run").alias("run"))


def present_maxima(c) -> DataFrame:
    """The same over distinct present contents."""
    rows = views.present_rows(c).select("volume_id", "content_id").distinct()
    return rows.join(views.origins(c), ["volume_id", "content_id"]).groupBy("volume_id", "node").agg(F.max("run").alias("run"))


def last_push(c) -> DataFrame:
    """A11 by volume and destination: the last successful sync."""
    return c.runs.where("kind = 'sync' and status = 'success' and volume_id is not null").groupBy("volume_id", "destination").agg(F.max("id").alias("run_id"))


def recorded_state(c) -> DataFrame:
    """A12, A13 by destination: rows in five tables, and their sum."""
    tables = {"objects": c.remote_objects, "packs": c.remote_packs, "paths": c.remote_paths, "components": c.vectors, "freshness": c.push_freshness}
    each = None
    for name, t in tables.items():
        n = t.groupBy("destination").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
        each = n if each is None else each.unionByName(n)
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in tables]
    return each.groupBy("destination").agg(*sums, F.sum("n").alias("total"))


def folder_aggregates(c) -> DataFrame:
    """Direct count, bytes and an ordered digest of each folder's present files."""
    rows = c.files.where("status = 'present'").join(c.contents.select(F.col("id").alias("content_id"), "blake3", "size_bytes"), "content_id")
    fold = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "blake3"))), lambda x: F.concat_ws(":", x["name"], x["blake3"])), ",")
    return rows.groupBy("folder_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.sha2(fold, 256).alias("shallow"))


def pack_preview(rows: DataFrame, pack_size: int, order: str = "blake3", size: str = "size_bytes", group: str | None = None) -> DataFrame:
    """Fill packs in order, closing one when it reaches the pack size; the last member may overflow.

    Adds `pack`. Filling is sequential by nature: each fill group is one ordered pass
    over narrow rows, and groups run side by side.
    """
    return _fill(rows, order, size, group, "pack", lambda n, total, x: total >= pack_size)


def batches(rows: DataFrame, max_items: int, max_bytes: int, order: str, size: str = "size_bytes", group: str | None = None) -> DataFrame:
    """Batches of at most so many items and bytes; a batch closes before it would overflow. Adds `batch`."""
    return _fill(rows, order, size, group, "batch", lambda n, total, x: n > 0 and (n == max_items or total + x > max_bytes))


def _fill(rows: DataFrame, order: str, size: str, group: str | None, name: str, closes) -> DataFrame:
    keys = [group] if group else []
    sorted_ = (rows.repartition(F.col(group)) if group else rows.coalesce(1)).sortWithinPartitions(*keys, order)
    at_group, at_size, columns = (rows.columns.index(group) if group else None), rows.columns.index(size), [*rows.columns, name]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, total, number = object(), 0, 0, 0
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                g, x = (row[at_group] if at_group is not None else None), int(row[at_size])
                if g != now:
                    now, n, total, number = g, 0, 0, 0
                elif closes(n, total, x):
                    n, total, number = 0, 0, number + 1
                out.append(number)
                n, total = n + 1, total + x
            yield pd.DataFrame({**{k: pdf[k] for k in columns[:-1]}, name: out}, columns=columns)

    return sorted_.mapInPandas(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def planned_uploads(c) -> DataFrame:
    """Each present content once, at its first path."""
    return views.present_rows(c).groupBy("volume_id", "content_id").agg(F.min("path").alias("path"))


def paths_by_content(c) -> DataFrame:
    """Each content's present paths in order."""
    return views.present_rows(c).groupBy("content_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


def size_conflicts(entries: DataFrame) -> DataFrame:
    """Digests (in any letter case) given with more than one size; must be empty."""
    return entries.groupBy(F.lower("blake3").alias("blake3")).agg(F.count_distinct("size_bytes").alias("sizes")).where("sizes > 1")


def first_by_digest(c) -> DataFrame:
    """The first row of each digest by run, then id."""
    rows = views.all_rows(c)
    return rows.groupBy("blake3").agg(F.min_by("id", F.struct("first_seen_run_id", "id")).alias("id"))


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """A33, A39"""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def transfer_stats(log: DataFrame) -> DataFrame:
    """Last counters, most errors, any fatal; log: run_id, seq, bytes, transfers, errors, fatal."""
    last = lambda x: F.max_by(x, "seq").alias(x)
    return log.groupBy("run_id").agg(last("bytes"), last("transfers"), F.max("errors").alias("errors"), F.bool_or("fatal").alias("fatal"))


def drift_warnings(c) -> DataFrame:
    """For each volume and peer, audits since their last exchange that found changes."""
    from cairn.operators.joins import modified_by_run

    zero = F.lit(0)
    audits = c.runs.where("kind = 'audit'").select(F.col("id").alias("run_id"), "volume_id", "started_at_ns")
    since = c.peer_sync_state.select("volume_id", "peer_node_id", "last_synced_at_ns")
    rows = audits.join(since, "volume_id").where("started_at_ns > last_synced_at_ns")
    rows = rows.join(modified_by_run(c), "run_id", "left").join(missing_by_run(c), "run_id", "left")
    return rows.select("volume_id", "peer_node_id", "run_id", F.coalesce("modified", zero).alias("modified"), F.coalesce("missing", zero).alias("missing")).where("modified + missing > 0")


def already_correct(c, plan: DataFrame) -> DataFrame:
    """A36 by volume: present files that the plan does not touch; plan: volume_id, disposition."""
    busy = plan.where(F.col("disposition").isin("transfer", "supersede", "conflict", "copy-from-existing", "contested")).groupBy("volume_id").agg(F.count(F.lit(1)).alias("busy"))
    return present_counts(c).join(busy, "volume_id", "left").select("volume_id", (F.col("files") - F.coalesce("busy", F.lit(0))).alias("correct"))


def reread_slice(c, share: int = 10) -> DataFrame:
    """A38 by destination: the copies to read again: least lately verified first, until their share of all bytes is read, one at least."""
    from cairn.operators.joins import stored_paths

    w = Window.partitionBy("destination").orderBy(F.col("verified_at_ns").asc_nulls_first(), "id")
    before = F.coalesce(F.sum("size_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size_bytes").over(Window.partitionBy("destination"))
    rows = stored_paths(c).select("destination", "id", "size_bytes", before.alias("_before"), total.alias("_total"), F.row_number().over(w).alias("_rank"))
    return rows.where((F.col("_rank") == 1) | (F.col("_before") * share < F.col("_total"))).select("destination", "id", "size_bytes")


def write_preview(ops: DataFrame) -> DataFrame:
    """Counts and bytes by operation."""
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def tree_empty(listing: DataFrame, skip: list[str]) -> DataFrame:
    """One row: nothing but markers, companions and skipped folders below."""
    name = p.last_segment(F.col("path"))
    counted = listing.where(~name.startswith("._") & ~name.startswith(p.PREFIX))
    for s in skip:
        counted = counted.where(~F.col("path").startswith(s + "/"))
    return counted.agg((F.count(F.lit(1)) == 0).alias("empty"))


def capture_algorithms(c) -> DataFrame:
    """By destination the sorted hash types to ask for."""
    return c.remote_objects.groupBy("destination").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("checksum_algo"), F.array(F.lit("md5")))), ",").alias("algorithms"))


def report_failures(findings: DataFrame) -> DataFrame:
    """A37, A43 by destination: findings that are failures, and those not checked."""
    bad = F.col("outcome").isin("missing", "mismatched", "content-mismatch")
    return findings.groupBy("destination").agg(F.count_if(bad).alias("failures"), F.count_if(F.col("outcome") == "unchecked").alias("unchecked"))


ship(__name__)
