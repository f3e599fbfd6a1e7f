"""Structured Streaming: throttled progress, latest values, queues, ticks, stalls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.functions.shipping import ship

# Scheduling (T1-T8, T18-T26): state as columns, so that a tick is one query.


def due(last: DataFrame, cadence_ns: int, now_ns: int) -> DataFrame:
    """Keys never finished, or finished a cadence ago; last: key columns, finished_ns."""
    return last.where(F.col("finished_ns").isNull() | (F.lit(now_ns) - F.col("finished_ns") >= cadence_ns)).drop("finished_ns")


def due_targets(c, cadence_ns: int, now_ns: int) -> DataFrame:
    """The pairs of volumes and targets whose last finished sync is a cadence old."""
    from cairn.operators.ranking import latest_finished

    done = latest_finished(c).where("kind = 'sync'").select("volume_id", F.col("destination").alias("target"), F.coalesce("ended_at_ns", "started_at_ns").alias("finished_ns"))
    return due(c.sync_to.select("volume_id", "target").join(done, ["volume_id", "target"], "left"), cadence_ns, now_ns)


def due_volumes(c, cadence_ns: int, now_ns: int) -> DataFrame:
    """Volumes whose last finished index is a cadence old."""
    from cairn.operators.ranking import latest_finished

    done = latest_finished(c).where("kind = 'index' and destination is null").select("volume_id", F.coalesce("ended_at_ns", "started_at_ns").alias("finished_ns"))
    return due(c.files.select("volume_id").distinct().join(done, "volume_id", "left"), cadence_ns, now_ns)


def due_hooks(c, cadence_ns: int, now_ns: int) -> DataFrame:
    """T4"""
    from cairn.operators.ranking import latest_hook

    done = latest_hook(c).where("trigger = 'interval'").select("volume_id", F.coalesce("ended_at_ns", "started_at_ns").alias("finished_ns"))
    return due(c.files.select("volume_id").distinct().join(done, "volume_id", "left"), cadence_ns, now_ns)


def in_flight(c, queued: DataFrame | None = None) -> DataFrame:
    """Pairs with a running sync or a place in a queue."""
    rows = c.runs.where("kind = 'sync' and status = 'running'").select("volume_id", F.col("destination").alias("target"))
    return (rows if queued is None else rows.union(queued.select("volume_id", "target"))).distinct()


def dispatchable(c, cadence_ns: int, now_ns: int, queued: DataFrame | None = None) -> DataFrame:
    """T6"""
    return due_targets(c, cadence_ns, now_ns).join(in_flight(c, queued), ["volume_id", "target"], "left_anti")


def due_pulls(c, cadence_ns: int, now_ns: int) -> DataFrame:
    """Peers of volumes with a stake whose last exchange is a cadence old."""
    from cairn.operators.lookups import with_stake

    rows = c.peer_sync_state.select("volume_id", "peer_node_id", F.col("last_synced_at_ns").alias("finished_ns"))
    rows = rows.join(with_stake(c).withColumnRenamed("id", "volume_id"), "volume_id", "left_semi")
    return due(rows, cadence_ns, now_ns)


def tick(c, sync_ns: int, index_ns: int, now_ns: int) -> DataFrame:
    """What one tick starts: syncs that may go, an index before them, and an index alone where none goes."""
    syncs = dispatchable(c, sync_ns, now_ns).select("volume_id", F.lit("sync").alias("action"), "target")
    before = syncs.select("volume_id").distinct().select("volume_id", F.lit("pre-sync-index").alias("action"), F.lit(None).cast("string").alias("target"))
    alone = due_volumes(c, index_ns, now_ns).join(syncs, "volume_id", "left_anti").select("volume_id", F.lit("index").alias("action"), F.lit(None).cast("string").alias("target"))
    return syncs.unionByName(before).unionByName(alone)


def scan_tick(c) -> DataFrame:
    """An audit of every volume that has files and no running run."""
    busy = c.runs.where("status = 'running'").select("volume_id")
    return c.files.select("volume_id").distinct().join(busy, "volume_id", "left_anti")


def advance_snapshot(c) -> DataFrame:
    """The maxima a push may claim: settle them before reading the delta."""
    from cairn.operators.aggregates import present_maxima

    return present_maxima(c)


def run_ticks(source: DataFrame, step: Callable[[DataFrame, int], None], every: str = "30 seconds", checkpoint: str | None = None):
    """`step` for every micro-batch; its batch id makes a repeated batch recognisable."""
    w = source.writeStream.foreachBatch(step).trigger(processingTime=every)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


# Progress (T9-T17)


def throttled(events: DataFrame, min_count: int, min_interval_ns: int) -> DataFrame:
    """T11, T12 over a finished stream (run_id, seq, at_ns, bytes): the events a throttle lets through.

    An event goes through if it is a run's first, the min_count-th since the last one
    through, or min_interval after it; what is left at the end is flushed.
    """
    return events.groupBy("run_id").applyInPandas(_throttle_all(min_count, min_interval_ns), "run_id long, seq long, bytes long")


def _throttle_all(min_count: int, min_interval_ns: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, count, last, held = [], 0, None, None
        for r in pdf.sort_values(["at_ns", "seq"]).itertuples(index=False):
            count, held = count + 1, r
            if last is None or count >= min_count or r.at_ns - last >= min_interval_ns:
                out.append(r)
                count, last, held = 0, r.at_ns, None
        if held is not None:
            out.append(held)
        return pd.DataFrame([(r.run_id, r.seq, r.bytes) for r in out], columns=["run_id", "seq", "bytes"])

    return run


def throttle_stream(events: DataFrame, min_count: int, min_interval_ns: int, idle_ms: int = 10_000) -> DataFrame:
    """T11, T12 on a stream: state is a count, the last time through and the held event; a timeout flushes."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, seq, size = state.get if state.exists else (0, -1, -1, 0)
        out = []
        if state.hasTimedOut:
            if count:
                out.append((key[0], seq, size))
            state.remove()
        else:
            for pdf in parts:
                for r in pdf.sort_values(["at_ns", "seq"]).itertuples(index=False):
                    count, seq, size = count + 1, int(r.seq), int(r.bytes)
                    if last < 0 or count >= min_count or r.at_ns - last >= min_interval_ns:
                        out.append((key[0], seq, size))
                        count, last = 0, int(r.at_ns)
            state.update((count, last, seq, size))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["run_id", "seq", "bytes"]).astype({"run_id": "int64", "seq": "int64", "bytes": "int64"})

    return events.groupBy("run_id").applyInPandasWithState(run, "run_id long, seq long, bytes long", "count long, last long, seq long, bytes long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_values(events: DataFrame) -> DataFrame:
    """The last event of each run; in update mode on a stream."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("seq", "bytes"), "seq").alias("last")).select("run_id", "last.*")


def with_run(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Progress with its run; terminal once the run is."""
    r = runs.select(F.col("id").alias("run_id"), "kind", "status")
    return events.join(r, "run_id").withColumn("terminal", F.col("status") != "running")


def advances(events: DataFrame) -> DataFrame:
    """Events whose bytes pass every earlier one of the run."""
    from pyspark.sql import Window

    before = F.max("bytes").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("bytes") > F.col("_b"))).drop("_b")


def stalls(events: DataFrame, gap: str) -> DataFrame:
    """A run's stretches of progress; a second one means a stall of at least the gap; events: run_id, ts."""
    return events.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def queued(requests: DataFrame, running: DataFrame) -> DataFrame:
    """Each destination's queue without repeats, in order of the first request, and what may start now."""
    from pyspark.sql import Window

    first = requests.groupBy("target", "volume_id").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("seq"))
    busy = running.select("target", F.lit(True).alias("_busy")).distinct()
    return first.withColumn("place", place).join(busy, "target", "left").select("target", "volume_id", "place", ((F.col("place") == 1) & F.col("_busy").isNull()).alias("starts"))


def drift_latch(polls: DataFrame) -> DataFrame:
    """Polls (seq, digest) at which the configuration began or ceased to differ from the first one seen."""
    from pyspark.sql import Window

    w = Window.orderBy("seq")
    rows = polls.withColumn("drift", F.col("digest") != F.first("digest").over(w))
    return rows.withColumn("_b", F.coalesce(F.lag("drift").over(w), F.lit(False))).where("drift <> _b").select("seq", F.when(F.col("drift"), "raise").otherwise("clear").alias("action"))


def hooks_to_fire(changed: DataFrame, running: DataFrame) -> DataFrame:
    """Volumes whose hook is due and not running."""
    return changed.join(running, "volume_id", "left_anti")


ship(__name__)
