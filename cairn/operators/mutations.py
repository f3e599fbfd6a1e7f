"""State transitions: every operator takes the current state and events and returns the next state.

Parquet tables are never updated in place. Events on one key are folded in order where
order matters (M1, M8); where a rule is commutative a join and a group-by do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTOR = ["volume_id", "destination", "origin_node_id"]


def _keyed(a: DataFrame, b: DataFrame, on: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in on])


# Files (M1-M7, M47, M57, M58)


def fold_observations(files: DataFrame, events: DataFrame) -> DataFrame:
    """Path histories after observations of content, in run order.

    files and events: volume_id, path, content_id, status, first_seen_run_id,
    last_seen_run_id, status_changed_run_id; events carry the observing run in
    run_id instead of the three run columns. Seeing the live content touches its row;
    seeing an older one revives that row and keeps its first run; new content adds a
    row. The row that was live is superseded and keeps the run that last saw it;
    status_changed moves only when the status does.

    For one path and content: the row exists if it did or is observed; it is live in the
    end iff it is the path's last observed content, or was live and nothing came.
    """
    key = ["volume_id", "path"]
    seen = events.groupBy(*key, "content_id").agg(F.min("run_id").alias("_first"), F.max("run_id").alias("_last"))
    final = events.groupBy(*key).agg(F.max_by("content_id", "run_id").alias("_final"))
    # Runs at which the path's content changed under observation, to date a row's end and revival.
    w = Window.partitionBy(*key).orderBy("run_id")
    live = files.where("status <> 'superseded'").select(*key, F.col("content_id").alias("_was"))
    turns = events.join(live, key, "left").withColumn("_before", F.coalesce(F.lag("content_id").over(w), F.col("_was")))
    turns = turns.withColumn("_change", ~F.col("_before").eqNullSafe(F.col("content_id")))
    begun = turns.where("_change").groupBy(*key, "content_id").agg(F.max("run_id").alias("_revived"))
    ended = turns.where("_change and _before is not null").groupBy(*key, F.col("_before").alias("content_id")).agg(F.max("run_id").alias("_ended"))
    rows = files.join(seen, [*key, "content_id"], "full_outer").join(final, key, "left").join(begun, [*key, "content_id"], "left").join(ended, [*key, "content_id"], "left")
    wins = F.col("_final") == F.col("content_id")
    status = F.when(F.col("_final").isNull(), F.col("status")).when(wins, "present").otherwise("superseded")
    same = F.col("status") == "present"
    changed = (
        F.when(F.col("_final").isNull(), F.col("status_changed_run_id"))
        .when(wins & same & F.col("_revived").isNull(), F.col("status_changed_run_id"))
        .when(wins & F.col("_revived").isNull(), F.col("_first"))
        .when(wins, F.col("_revived"))
        .when(F.col("_ended").isNotNull(), F.col("_ended")).otherwise(F.col("status_changed_run_id"))
    )
    return rows.select(
        *key, "content_id", status.alias("status"), F.coalesce("first_seen_run_id", "_first").alias("first_seen_run_id"),
        F.greatest("last_seen_run_id", "_last").alias("last_seen_run_id"), changed.alias("status_changed_run_id"),
    )


def mark_missing(files: DataFrame, run_id: int, volume_id: int | None = None) -> DataFrame:
    """M6: present rows that the run did not see become missing; both run stamps take the run."""
    gone = (F.col("status") == "present") & (F.col("last_seen_run_id") != run_id)
    if volume_id is not None:
        gone = gone & (F.col("volume_id") == volume_id)
    return files.withColumns({
        "status": F.when(gone, "missing").otherwise(F.col("status")),
        "last_seen_run_id": F.when(gone, run_id).otherwise(F.col("last_seen_run_id")),
        "status_changed_run_id": F.when(gone, run_id).otherwise(F.col("status_changed_run_id")),
    })


def mark_offloaded(files: DataFrame, wanted: DataFrame, run_id: int) -> DataFrame:
    """M7: present rows at (volume_id, path, content_id) become offloaded; each wish must match exactly one row."""
    hit = wanted.select("volume_id", "path", "content_id", F.lit(True).alias("_hit"))
    found = files.where("status = 'present'").join(hit, ["volume_id", "path", "content_id"], "left_semi").count()
    if found != wanted.count():
        raise ValueError("a row to offload is not present, or not unique")
    now = (F.col("status") == "present") & F.coalesce("_hit", F.lit(False))
    rows = files.join(hit, ["volume_id", "path", "content_id"], "left")
    return rows.select(*[
        F.when(now, "offloaded").otherwise(F.col(x)).alias(x) if x == "status" else F.when(now, run_id).otherwise(F.col(x)).alias(x) if x == "status_changed_run_id" else F.col(x) for x in files.columns
    ])


def preserve_conflicts(files: DataFrame, conflicts: DataFrame, run_id: int) -> DataFrame:
    """The original is superseded and its bytes live on under the preserved path; conflicts: volume_id, path, preserved."""
    hit = conflicts.select("volume_id", "path", "preserved")
    rows = files.join(hit, ["volume_id", "path"], "left")
    now = F.col("preserved").isNotNull() & (F.col("status") != "superseded")
    old = rows.withColumn("status_changed_run_id", F.when(now, run_id).otherwise(F.col("status_changed_run_id"))).withColumn("status", F.when(now, "superseded").otherwise(F.col("status")))
    new = rows.where(now).withColumns({"path": F.col("preserved"), "status": F.lit("present"), "first_seen_run_id": F.lit(run_id).cast("long"), "last_seen_run_id": F.lit(run_id).cast("long"), "status_changed_run_id": F.lit(run_id).cast("long")})
    return old.select(*files.columns).unionByName(new.select(*files.columns))


# Durability vectors


def advance_vector(state: DataFrame, writes: DataFrame, allow_rewind: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next state, rejected writes) for at most one write a component.

    A lower run is a rewind and is rejected unless allowed. A method given replaces the
    old one; a higher run without one forgets it. The source moves with a higher run or a
    new method, and a local write with a method clears it. The verification time moves
    with a higher run or any method. Fold several writes of a component with
    `advance_all`: the rules do not commute.
    """
    new = writes.select(*VECTOR, *[F.col(x).alias("_" + x) for x in ("origin_run_id", "updated_at_ns", "verify_method", "source_node_id", "verified_at_ns")], F.lit(True).alias("_w"))
    rows = state.withColumn("_s", F.lit(True)).join(new, VECTOR, "full_outer")
    up, said = F.col("_origin_run_id") > F.col("origin_run_id"), F.col("_verify_method").isNotNull()
    rewind = F.coalesce(F.col("_origin_run_id") < F.col("origin_run_id"), F.lit(False)) & F.lit(not allow_rewind)
    takes = F.col("_w").isNotNull() & ~rewind
    insert = F.col("_s").isNull()
    differs = ~F.col("_verify_method").eqNullSafe(F.col("verify_method"))
    pick = lambda x, rule: F.when(~takes, F.col(x)).when(insert, F.col("_" + x)).otherwise(rule).alias(x)
    following = rows.select(
        *VECTOR, pick("origin_run_id", F.col("_origin_run_id")), pick("updated_at_ns", F.col("_updated_at_ns")),
        pick("verify_method", F.when(said, F.col("_verify_method")).when(up, None).otherwise(F.col("verify_method"))),
        pick("source_node_id", F.when(up, F.col("_source_node_id")).when(said & differs, F.col("_source_node_id")).when(F.col("_source_node_id").isNull() & said, None).otherwise(F.col("source_node_id"))),
        pick("verified_at_ns", F.when(up | said, F.col("_verified_at_ns")).otherwise(F.col("verified_at_ns"))),
    )
    rejected = rows.where(F.col("_w") & rewind).select(*VECTOR, F.col("_origin_run_id").alias("origin_run_id"))
    return following, rejected


def advance_all(state: DataFrame, writes: DataFrame, seq: str = "seq", allow_rewind: bool = False) -> DataFrame:
    """M8, M9 for any number of writes a component, folded in order inside a sorted array: one shuffle of the writes."""
    fields = ["origin_run_id", "updated_at_ns", "verify_method", "source_node_id", "verified_at_ns"]
    first = state.select(*VECTOR, F.lit(-1).cast("long").alias(seq), *fields)
    events = first.unionByName(writes.select(*VECTOR, F.col(seq).cast("long").alias(seq), *fields))
    listed = events.groupBy(*VECTOR).agg(F.array_sort(F.collect_list(F.struct(seq, *fields))).alias("e"))

    def step(a, x):
        up, said = x["origin_run_id"] > a["origin_run_id"], x["verify_method"].isNotNull()
        differs = ~x["verify_method"].eqNullSafe(a["verify_method"])
        folded = F.struct(
            x[seq].alias(seq), x["origin_run_id"].alias("origin_run_id"), x["updated_at_ns"].alias("updated_at_ns"),
            F.when(said, x["verify_method"]).when(up, None).otherwise(a["verify_method"]).alias("verify_method"),
            F.when(up, x["source_node_id"]).when(said & differs, x["source_node_id"]).when(x["source_node_id"].isNull() & said, None).otherwise(a["source_node_id"]).alias("source_node_id"),
            F.when(up | said, x["verified_at_ns"]).otherwise(a["verified_at_ns"]).alias("verified_at_ns"),
        )
        return F.when((x["origin_run_id"] >= a["origin_run_id"]) | F.lit(allow_rewind), folded).otherwise(a)

    folded = F.aggregate(F.expr("slice(e, 2, greatest(size(e) - 1, 0))"), F.element_at("e", 1), step)
    return listed.select(*VECTOR, folded.alias("r")).select(*VECTOR, *[F.col("r")[x].alias(x) for x in fields])


def pulled_verification(relayed_ns, now_ns):
    """A relayed time is never later than now; zero is unknown."""
    return F.least(F.nullif(relayed_ns, F.lit(0)), F.when(F.nullif(relayed_ns, F.lit(0)).isNotNull(), F.lit(now_ns)))


def overwrite_freshness(state: DataFrame, writes: DataFrame) -> DataFrame:
    """The last write wins."""
    new = writes.select(*VECTOR, F.col("origin_run_id").alias("_new"))
    return state.join(new, VECTOR, "full_outer").select(*VECTOR, F.coalesce("_new", "origin_run_id").alias("origin_run_id"))


def merge_freshness(state: DataFrame, writes: DataFrame) -> DataFrame:
    """The greatest wins."""
    return state.select(*VECTOR, "origin_run_id").unionByName(writes.select(*VECTOR, "origin_run_id")).groupBy(*VECTOR).agg(F.max("origin_run_id").alias("origin_run_id"))


def upgrade_to_fingerprint(c, destination: str, now_ns: int) -> DataFrame:
    """Volumes with content, a successful sync and nothing pending re-stamp their maxima as fingerprint-verified."""
    from cairn.operators import aggregates, joins

    synced = aggregates.last_push(c).where(F.col("destination") == destination).select("volume_id")
    pending = joins.pending_fingerprints(c, destination).where("pending > 0").select("volume_id")
    ready = aggregates.present_maxima(c).join(synced, "volume_id", "left_semi").join(pending, "volume_id", "left_anti")
    writes = ready.select(
        "volume_id", F.lit(destination).alias("destination"), F.col("node").alias("origin_node_id"), F.col("run").alias("origin_run_id"), F.lit(now_ns).alias("updated_at_ns"),
        F.lit("fingerprint-verified").alias("verify_method"), F.lit(None).cast("long").alias("source_node_id"), F.lit(now_ns).alias("verified_at_ns"),
    )
    return advance_vector(c.vectors, writes)[0]


def demote_fingerprints(state: DataFrame, lost: DataFrame) -> DataFrame:
    """Local fingerprint components of (volume_id, destination) that lost a copy count as presence and size."""
    hit = lost.select("volume_id", "destination").distinct().withColumn("_lost", F.lit(True))
    now = F.col("_lost") & (F.col("verify_method") == "fingerprint-verified") & F.col("source_node_id").isNull()
    return state.join(hit, ["volume_id", "destination"], "left").withColumn("verify_method", F.when(now, "presence+size").otherwise(F.col("verify_method"))).drop("_lost")


def revoke_source(state: DataFrame, source_node_id: int) -> DataFrame:
    """M14"""
    return state.where(~F.col("source_node_id").eqNullSafe(F.lit(source_node_id)))


def advance_watermarks(state: DataFrame, writes: DataFrame, allow_rewind: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next state, rejected); a null watermark never blocks."""
    key = ["volume_id", "peer_node_id"]
    new = writes.select(*key, F.col("last_shared_run_id").alias("_run"), F.col("last_synced_at_ns").alias("_at"), F.lit(True).alias("_w"))
    rows = state.join(new, key, "full_outer")
    back = F.coalesce(F.col("_run") < F.col("last_shared_run_id"), F.lit(False)) & F.lit(not allow_rewind)
    takes = F.col("_w").isNotNull() & ~back
    following = rows.select(*key, F.when(takes, F.col("_run")).otherwise(F.col("last_shared_run_id")).alias("last_shared_run_id"), F.when(takes, F.col("_at")).otherwise(F.col("last_synced_at_ns")).alias("last_synced_at_ns"))
    return following, rows.where(F.col("_w") & back).select(*key, F.col("_run").alias("last_shared_run_id"))


# Remote copies

#: from-state, to-state of the five transitions; `lost` may come from any other state.
CONFIRM, DISPLACE, DISPLACED, REVERT = ("committing", "live"), ("live", "displacing"), ("displacing", "displaced"), ("displacing", "live")


def transition(paths: DataFrame, ids: DataFrame, move: tuple[str, str], run_id: int | None = None, strict: bool = True) -> DataFrame:
    """The given ids move together; in a strict call every id must be in the from-state."""
    start, end = move
    if strict and paths.where(F.col("state") == start).join(ids, "id", "left_semi").count() != ids.count():
        raise ValueError(f"not every path is {start}")
    rows = paths.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    now = F.coalesce("_hit", F.lit(False)) & (F.col("state") == start)
    stamp = F.lit(run_id).cast("long") if move == DISPLACE else F.lit(None).cast("long") if move == REVERT else F.col("displaced_run_id")
    return rows.withColumn("displaced_run_id", F.when(now, stamp).otherwise(F.col("displaced_run_id"))).withColumn("state", F.when(now, end).otherwise(F.col("state"))).drop("_hit")


def mark_lost(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """M21, M63"""
    rows = paths.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    return rows.withColumn("state", F.when(F.col("_hit"), "lost").otherwise(F.col("state"))).drop("_hit")


def append_rows(state: DataFrame, new: DataFrame) -> DataFrame:
    """Appended rows, missing columns null."""
    return state.unionByName(new, allowMissingColumns=True)


def _refused(new: DataFrame, bad, what: str) -> DataFrame:
    """`new`, or an error when a bad row's columns are read."""
    kept = [F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(what)).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in new.schema]
    return new.select(*kept)


def _first_time(new: DataFrame, state: DataFrame, on: list[str], what: str) -> DataFrame:
    """`new`, or an error if a key is held already or comes twice."""
    held = state.select(*on).distinct().withColumn("_held", F.lit(True))
    rows = new.join(held, on, "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*on)))  # a key's rows: one, if nothing is wrong
    return _refused(rows, F.col("_held") | (F.col("_n") > 1), what).select(*new.columns)


def insert_objects(state: DataFrame, new: DataFrame) -> DataFrame:
    """Objects of a named destination, algorithm and checksum both given and not empty or both null, each key once; else an error."""
    algo, value = F.col("checksum_algo"), F.col("checksum")
    unpaired = (algo.isNull() != value.isNull()) | F.coalesce((algo == "") | (value == ""), F.lit(False))
    named = _refused(new, F.coalesce(F.col("destination") == "", F.lit(True)), "the destination is empty")
    paired = _refused(named, unpaired, "checksum_algo and checksum go together and are not empty")
    return append_rows(state, _first_time(paired, state, ["content_id", "destination"], "the object is recorded already"))


def insert_packs(packs: DataFrame, members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs and their members out of one table, so that neither comes without the other; a content is packed once, else an error.

    new: id, pack_key, size_bytes, members array<struct<content_id, offset_bytes, length_bytes>>.
    """
    each = new.select(F.col("id").alias("pack_id"), F.explode("members").alias("m")).select("pack_id", "m.*")
    return append_rows(packs, new.drop("members")), append_rows(members, _first_time(each, members, ["content_id"], "the content is packed already"))


def insert_hook_runs(state: DataFrame, new: DataFrame) -> DataFrame:
    """Running hook runs: a `change` names the run that fired it, an `interval` none (0 counts as none); else an error."""
    rows = new.withColumn("triggering_run_id", F.nullif(F.col("triggering_run_id"), F.lit(0))).withColumn("status", F.lit("running"))
    known = F.coalesce(F.col("trigger").isin("change", "interval"), F.lit(False))
    bad = ~known | ((F.col("trigger") == "change") != F.col("triggering_run_id").isNotNull())
    return append_rows(state, _refused(rows, bad, "a change hook, and only it, names the run that fired it"))


def record_verified(paths: DataFrame, seen: DataFrame, at_ns: int) -> DataFrame:
    """Compare and set: a stored copy's checksum is taken if none is recorded, or stamped if equal; seen: id, checksum."""
    rows = paths.join(seen.select("id", F.col("checksum").alias("_sum")), "id", "left")
    now = F.col("_sum").isNotNull() & F.col("state").isin("live", "displaced") & (F.col("checksum").isNull() | (F.col("checksum") == F.col("_sum")))
    return rows.withColumn("verified_at_ns", F.when(now, at_ns).otherwise(F.col("verified_at_ns"))).withColumn("checksum", F.when(now, F.col("_sum")).otherwise(F.col("checksum"))).drop("_sum")


def set_fingerprint(state: DataFrame, seen: DataFrame, on: list[str], at_ns: int) -> DataFrame:
    """The first fingerprint stays; seen: key columns, algo, value."""
    rows = state.join(seen.select(*on, F.col("algo").alias("_a"), F.col("value").alias("_v")), on, "left")
    first = F.col("checksum").isNull() & F.col("_v").isNotNull()
    return rows.withColumns({
        "verified_at_ns": F.when(first, at_ns).otherwise(F.col("verified_at_ns")), "checksum_algo": F.when(first, F.col("_a")).otherwise(F.col("checksum_algo")), "checksum": F.coalesce("checksum", "_v"),
    }).drop("_a", "_v")


def mark_verified(state: DataFrame, keys: DataFrame, on: list[str], at_ns: int) -> DataFrame:
    """M23, M27"""
    rows = state.join(keys.select(*on, F.lit(True).alias("_hit")).distinct(), on, "left")
    return rows.withColumn("verified_at_ns", F.when(F.col("_hit"), at_ns).otherwise(F.col("verified_at_ns"))).drop("_hit")


def settle_unfinished(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Copies in flight settle by what the destination holds; found: id, staged, at_path, in_history."""
    from cairn.operators import gate

    rows = paths.join(found, "id", "left")
    no = F.lit(False)
    staged, here, old = (F.coalesce(x, no) for x in ("staged", "at_path", "in_history"))
    state = F.when(F.col("state") == "committing", gate.settle_committing(staged, here)).when(F.col("state") == "displacing", gate.settle_displacing(old, here)).otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("staged", "at_path", "in_history")


# Runs (M29-M35, M44)


def finish_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """The first terminal state stays; ends: id, status, ended_at_ns, error."""
    rows = runs.join(ends.select("id", F.col("status").alias("_st"), F.col("ended_at_ns").alias("_e"), F.col("error").alias("_err")), "id", "left")
    now = F.col("_st").isNotNull() & (F.col("status") == "running")
    return rows.withColumns({"ended_at_ns": F.when(now, F.col("_e")).otherwise(F.col("ended_at_ns")), "error": F.when(now, F.col("_err")).otherwise(F.col("error")), "status": F.when(now, F.col("_st")).otherwise(F.col("status"))}).drop("_st", "_e", "_err")


def abort_running(runs: DataFrame, reason: str, at_ns: int) -> DataFrame:
    """M30"""
    now = F.col("status") == "running"
    return runs.withColumns({"ended_at_ns": F.when(now, at_ns).otherwise(F.col("ended_at_ns")), "error": F.when(now, reason).otherwise(F.col("error")), "status": F.when(now, "aborted").otherwise(F.col("status"))})


def blockers(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted run (kind, volume_id, destination) the first running one that excludes it.

    A sync yields to a running sync of its pair and to any index, audit or offload of
    the volume; an index or audit yields to those three; an offload yields to any run.
    One driver writes runs, so the check and the append do not race.
    """
    busy = runs.where("status = 'running'").select(F.col("id").alias("_id"), F.col("kind").alias("_kind"), "volume_id", F.col("destination").alias("_dest"))
    rows = wanted.join(busy, "volume_id", "left")
    local = F.col("_kind").isin("index", "audit", "offload")
    pair = (F.col("_kind") == "sync") & F.col("_dest").eqNullSafe(F.col("destination"))
    blocks = F.when(F.col("kind") == "sync", local | pair).when(F.col("kind") == "offload", F.lit(True)).otherwise(local)
    return rows.groupBy("kind", "volume_id", "destination").agg(F.min(F.when(blocks, F.col("_id"))).alias("blocked_by"))


# Latches (M36-M41, M46)


def raise_latches(state: DataFrame, events: DataFrame, on: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(next state, newly raised): a key that stands keeps its row; of several events the first counts."""
    rest = [x for x in events.columns if x not in on]
    first = events.groupBy(*on).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*on, "_r.*")
    new = first.join(state, on, "left_anti")
    return state.unionByName(new, allowMissingColumns=True), new


def clear_latches(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """M37, M39, M41"""
    return state.join(keys, on, "left_anti")


def raise_drift(state: DataFrame, new: DataFrame) -> DataFrame:
    """The singleton takes the new keys and keeps the time since when it stands."""
    old = state.select("id", F.col("since_ns").alias("_since"))
    return new.join(old, "id", "left").withColumn("since_ns", F.coalesce("_since", "since_ns")).drop("_since")


def reset_destination(c, destination: str) -> dict[str, DataFrame]:
    """Five tables without a destination's rows."""
    tables = {"remote_objects": c.remote_objects, "remote_packs": c.remote_packs, "remote_paths": c.remote_paths, "vectors": c.vectors, "push_freshness": c.push_freshness}
    return {name: t.where(F.col("destination") != destination) for name, t in tables.items()}


def close_session(files: DataFrame, session: DataFrame, failed: DataFrame, run_id: int) -> DataFrame:
    """Verified paths (volume_id, path, content_id) that did not fail become observations."""
    landed = session.join(failed, "path", "left_anti").select("volume_id", "path", "content_id", F.lit(run_id).cast("long").alias("run_id"))
    return fold_observations(files, landed)


# Names and migrations


def unique_names(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Base, base-2, base-3 and on for each new (base, id), after the names that exist."""
    used = taken.select(F.regexp_extract("name", r"^(.*?)(?:-(\d+))?$", 1).alias("base"), F.coalesce(F.expr("try_cast(regexp_extract(name, '-([0-9]+)$', 1) as int)"), F.lit(1)).alias("_n"))
    above = used.groupBy("base").agg(F.max("_n").alias("_top"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("id")) + F.coalesce("_top", F.lit(0))
    return rows.join(above, "base", "left").withColumn("_k", n).select("id", F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "_k")).alias("name"))


def peer_node(existing: dict | None, endpoint: str, upgrade: bool) -> dict:
    """A driver-side rule: a placeholder takes the endpoint if allowed; another endpoint is a collision."""
    if existing is None:
        return {"action": "insert", "endpoint": endpoint}
    if existing.get("endpoint") == endpoint:
        return {"action": "keep", "endpoint": endpoint}
    if existing.get("endpoint") == "" and upgrade:
        return {"action": "upgrade", "endpoint": endpoint}
    raise ValueError("another node has this name")


def backfill_status_changed(files: DataFrame) -> DataFrame:
    """A missing stamp takes the last run for rows that left, the first for rows that stand."""
    value = F.when(F.col("status") == "present", F.col("first_seen_run_id")).otherwise(F.col("last_seen_run_id"))
    return files.withColumn("status_changed_run_id", F.coalesce("status_changed_run_id", value))


def relabel_method(vectors: DataFrame, history: DataFrame, old: str, new: str, at_ns: int) -> tuple[DataFrame, DataFrame]:
    """Components under an old method name, and a history row for each."""
    hit = vectors.where(F.col("verify_method") == old)
    more = hit.select(*VECTOR, "origin_run_id", F.lit(at_ns).alias("at_ns"), F.lit(new).alias("verify_method"), "source_node_id")
    return vectors.withColumn("verify_method", F.when(F.col("verify_method") == old, new).otherwise(F.col("verify_method"))), history.unionByName(more, allowMissingColumns=True)


def import_runs(c) -> DataFrame:
    """A run for each volume with the count of its rows."""
    n = c.files.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_n"))
    return c.volumes.select(F.col("id").alias("volume_id")).join(n, "volume_id", "left").select("volume_id", F.coalesce("_n", F.lit(0)).alias("file_count"))


def rekey_by_folder(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows with a path get their folder's id and a name."""
    from cairn.functions import paths as p

    f = folders.select("volume_id", F.col("id").alias("folder_id"), F.col("path").alias("_f"))
    return rows.withColumn("_f", p.parent(F.col("path"))).join(f, ["volume_id", "_f"]).withColumn("name", p.last_segment(F.col("path"))).drop("_f")


def rekey_by_content(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """M71"""
    return rows.join(contents.select(F.col("id").alias("content_id"), "blake3"), "blake3")


def rekey_by_import(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """M72"""
    return rows.join(runs.select("volume_id", F.col("id").alias("first_seen_run_id")), "volume_id")
