"""Decisions: is every required copy proven, how fresh is what is known, how bad is it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.operators import aggregates, joins, lookups
from cairn.plans import views

#: Verify methods (G9); the first two prove content by themselves.
METHODS = ("peer-blake3", "kopia-verify", "fingerprint-verified", "presence+size", "size+mtime", "blake3")
CONTENT = ("peer-blake3", "kopia-verify")
FINGERPRINT, PRESENCE = "fingerprint-verified", "presence+size"
#: Levels: neutral, ok, warn, critical.
NEUTRAL, OK, WARN, CRITICAL = 0, 1, 2, 3
LATE = 3


def content_verified(method):
    """G8"""
    return F.coalesce(method.isin(*CONTENT), F.lit(False))


def known_method(method):
    """G9"""
    return F.coalesce(method.isin(*METHODS), F.lit(False))


def relayed_method(method, cadence_ns):
    """A fingerprint without a positive cadence counts as presence and size."""
    return F.when((method == FINGERPRINT) & ~(F.coalesce(cadence_ns, F.lit(0)) > 0), PRESENCE).otherwise(method)


def valid_component(node, run, method):
    """G11"""
    return F.coalesce(node.rlike("^[A-Za-z0-9][A-Za-z0-9_#-]*$") & (run > 0) & (method.isNull() | known_method(method)), F.lit(False))


can_gate = joins.can_gate


def cadenced(c, default_ns: int) -> DataFrame:
    """Targets that are verified on a schedule."""
    return lookups.verify_cadences(c, default_ns).select(F.col("name").alias("target"))


def checks(c, now_ns: int, max_age_ns: int = 0, default_cadence_ns: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """Every present file against every required target: (volume_id, path, content_id, size_bytes, target, ordinal, failure).

    The first condition that fails: no-evidence, behind, evidence-stale, not-pushed,
    not-verified; null when the target passes. One equi-join for each kind of evidence.
    """
    if rows is None:
        rows = views.live_rows(c).where("status = 'present'").where(~p.under_reserved(F.col("path")))
    files = rows.select("volume_id", "path", "content_id", "size_bytes", "first_seen_run_id", "status_changed_run_id").join(views.origins(c), ["volume_id", "content_id"])
    asked = files.join(c.offload_requires, "volume_id")
    comp = c.vectors.select("volume_id", F.col("destination").alias("target"), F.col("origin_node_id").alias("node"), F.col("origin_run_id").alias("_covered"), F.col("verify_method").alias("_method"), F.col("source_node_id").alias("_source"), F.col("verified_at_ns").alias("_verified"))
    push = aggregates.last_push(c).select("volume_id", F.col("destination").alias("target"), F.col("run_id").alias("_push"))
    fresh = c.push_freshness.select("volume_id", F.col("destination").alias("target"), F.col("origin_node_id").alias("node"), F.col("origin_run_id").alias("_fresh"))
    proof = joins.fingerprinted(c).select("content_id", F.col("destination").alias("target"), F.lit(True).alias("_proof"))
    steady = cadenced(c, default_cadence_ns).withColumn("_steady", F.lit(True))
    rows = asked.join(comp, ["volume_id", "target", "node"], "left").join(push, ["volume_id", "target"], "left").join(fresh, ["volume_id", "target", "node"], "left")
    rows = rows.join(proof, ["content_id", "target"], "left").join(steady, "target", "left")
    changed = F.coalesce("status_changed_run_id", "first_seen_run_id")
    old = F.lit(max_age_ns > 0) & (F.col("_verified").isNull() | (F.col("_verified") < F.lit(now_ns - max_age_ns)))
    unpushed = F.when(F.coalesce("_push", F.lit(0)) > 0, F.col("_push") < changed).otherwise(F.col("_fresh").isNull() | (F.col("_fresh") < F.col("run")))
    proven = F.coalesce("_proof", F.lit(False))
    verified = F.when(content_verified(F.col("_method")), True).when(F.col("_method") == FINGERPRINT, F.col("_source").isNotNull() | F.coalesce("_steady", F.lit(False)) | proven).when(F.col("_method") == PRESENCE, proven).otherwise(False)
    failure = F.when(F.col("_covered").isNull(), "no-evidence").when(F.col("_covered") < F.col("run"), "behind").when(old, "evidence-stale").when(unpushed, "not-pushed").when(~verified, "not-verified")
    return rows.select("volume_id", "path", "content_id", "size_bytes", "target", "ordinal", failure.alias("failure"))


def verdicts(checked: DataFrame) -> DataFrame:
    """A file passes iff every required target does."""
    return checked.groupBy("volume_id", "path", "size_bytes").agg(F.every(F.col("failure").isNull()).alias("ok"), F.count("failure").alias("failures"))


def readiness(c, now_ns: int, max_age_ns: int = 0) -> DataFrame:
    """A16 by volume: present files and bytes, and those that pass; volumes without policy do not apply."""
    passed = verdicts(checks(c, now_ns, max_age_ns))
    zero = F.lit(0)
    sums = passed.groupBy("volume_id").agg(F.count(F.lit(1)).alias("present_files"), F.sum("size_bytes").alias("present_bytes"), F.count_if("ok").alias("ready_files"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("size_bytes"))), zero).alias("ready_bytes"))
    rows = views.live_rows(c).where("status = 'present'").where(~p.under_reserved(F.col("path"))).groupBy("volume_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("size_bytes").alias("_b"))
    return rows.join(sums, "volume_id", "left").select(
        "volume_id", F.col("ready_files").isNotNull().alias("applicable"), F.col("_n").alias("present_files"), F.col("_b").alias("present_bytes"),
        F.coalesce("ready_files", zero).alias("ready_files"), F.coalesce("ready_bytes", zero).alias("ready_bytes"),
    )


def requirements(checked: DataFrame) -> DataFrame:
    """A17 by volume and target, in policy order: files that satisfy it and files it blocks."""
    return checked.groupBy("volume_id", "target", "ordinal").agg(F.count_if(F.col("failure").isNull()).alias("satisfied"), F.count("failure").alias("blocked"))


def blocked_groups(checked: DataFrame) -> DataFrame:
    """Failures by target and kind: files, the first path as example."""
    rows = checked.where("failure is not null")
    return rows.groupBy("volume_id", "target", "ordinal", F.col("failure").alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("example"))


def advice(kind, pushes_here):
    """G7, G45"""
    local = (
        F.when(kind == "no-evidence", "sync the volume to this target").when(kind == "behind", "sync again").when(kind == "evidence-stale", "verify the target")
        .when(kind == "not-pushed", "sync the whole volume").otherwise("verify the target with fingerprints")
    )
    return F.when(pushes_here, local).otherwise("have the peer that pushes to this target do so, then pull its durability")


def provenance(c, components: DataFrame) -> DataFrame:
    """Whose word each component is."""
    nodes = c.nodes.select(F.col("id").alias("source_node_id"), F.col("name").alias("_name"))
    label = F.when(F.col("source_node_id").isNull(), "locally verified").otherwise(F.concat(F.lit("asserted by peer "), F.coalesce(F.col("_name"), F.concat(F.lit("node-"), F.col("source_node_id")))))
    return components.join(nodes, "source_node_id", "left").select("volume_id", "destination", "origin_node_id", label.alias("provenance"))


def standing(c) -> DataFrame:
    """G14 with alarms, by volume and destination: none, alarm, needs-bootstrap or refused."""
    from cairn.operators.ranking import latest_finished

    last = latest_finished(c).where("kind = 'sync'").select("volume_id", "destination", "status", "error")
    ever = aggregates.last_push(c).select("volume_id", "destination", F.lit(True).alias("_ever"))
    alarm = c.destination_alarms.select("destination", F.lit(True).alias("_alarm"))
    rows = last.join(ever, ["volume_id", "destination"], "left").join(alarm, "destination", "left")
    first_use = F.col("_ever").isNull() & F.coalesce(F.col("error").contains("--init"), F.lit(False))
    state = F.when(F.col("_alarm"), "alarm").when(F.col("status") != "refused", "none").when(first_use, "needs-bootstrap").otherwise("refused")
    return rows.select("volume_id", "destination", "status", state.alias("standing"))


def cadence_level(age, cadence):
    """G16"""
    return F.when(F.coalesce(cadence, F.lit(0)) <= 0, OK).when(age <= cadence, OK).when(age <= LATE * cadence, WARN).otherwise(CRITICAL)


def sync_level(standing_, last_status, is_target, age, cadence):
    """G15"""
    return (
        F.when(standing_.isin("alarm", "refused"), CRITICAL).when(standing_ == "needs-bootstrap", WARN).when(last_status == "failed", CRITICAL).when(last_status == "partial", WARN)
        .when(~is_target, NEUTRAL).when(age.isNull(), WARN).otherwise(cadence_level(age, cadence))
    )


def evidence_stale(age, max_age):
    """Unknown counts as stale."""
    return F.when(F.coalesce(max_age, F.lit(0)) <= 0, False).when(age.isNull(), True).otherwise(age > max_age)


def durability_level(local_content, covered, stale, required):
    """G17"""
    return F.when(~local_content, NEUTRAL).when(~required, F.when(covered & ~stale, OK).otherwise(NEUTRAL)).when(~covered | stale, WARN).otherwise(OK)


def self_maxima(c) -> DataFrame:
    """By volume, this node's last run among present contents; 0 without any."""
    own = aggregates.present_maxima(c).where("node = 1").select("volume_id", "run")
    volumes = c.files.select("volume_id").distinct()
    return volumes.join(own, "volume_id", "left").select("volume_id", F.coalesce("run", F.lit(0)).cast("long").alias("run"))


def durability(c, now_ns: int, max_age_ns: int) -> DataFrame:
    """Each accepted target's cover of this node's own content; required targets without a component stay."""
    required = c.offload_requires.select("volume_id", "target", F.lit(True).alias("required"))
    comp = joins.self_components(c).select("volume_id", F.col("destination").alias("target"), F.col("origin_run_id").alias("_covered"), "verify_method", "verified_at_ns", F.lit(True).alias("_has"))
    rows = lookups.accepted_destinations(c).join(required, ["volume_id", "target"], "left").join(comp, ["volume_id", "target"], "left").join(self_maxima(c), "volume_id", "left")
    rows = rows.withColumn("required", F.coalesce("required", F.lit(False))).where("required or _has")
    age = F.when(F.col("verified_at_ns").isNotNull(), F.greatest(F.lit(0), F.lit(now_ns) - F.col("verified_at_ns")))
    own = F.coalesce(F.col("run"), F.lit(0))
    stale = evidence_stale(age, F.lit(max_age_ns))
    out = rows.select("volume_id", "target", "required", (own > 0).alias("local_content"), (F.coalesce("_covered", F.lit(0)) >= own).alias("covered"), stale.alias("stale"))
    return out.withColumn("level", durability_level(F.col("local_content"), F.col("covered"), F.col("stale"), F.col("required")))


def fleet(c, now_ns: int, sync_every_ns: int, max_age_ns: int) -> DataFrame:
    """What each place of a volume lacks or has more, how old that knowledge is, how bad."""
    zero = F.lit(0)
    refs = fleet_place_refs(c)
    comps = c.vectors.select("volume_id", F.col("destination").alias("name"), F.col("origin_node_id").alias("node"), F.col("origin_run_id").alias("_cov"), "updated_at_ns", "verified_at_ns")
    known = aggregates.known_maxima(c).select("volume_id", "node", F.col("run").alias("_known"))
    ahead = comps.join(known, ["volume_id", "node"], "left").groupBy("volume_id", "name").agg(
        F.bool_or(F.col("_cov") > F.coalesce("_known", zero)).alias("ahead"), F.max("updated_at_ns").alias("_updated"),
        F.when(F.every(F.col("verified_at_ns").isNotNull()), F.min("verified_at_ns")).alias("_verified"),
    )
    buckets = refs.select("volume_id", "name").join(aggregates.files_by_origin(c), "volume_id").join(comps.select("volume_id", "name", "node", "_cov"), ["volume_id", "name", "node"], "left")
    lacking = buckets.groupBy("volume_id", "name").agg(F.coalesce(F.sum(F.when(F.coalesce("_cov", zero) < F.col("run"), F.col("files"))), zero).alias("_lacking"))
    sync = c.runs.select(F.col("id").alias("_id"), F.col("ended_at_ns").alias("_ended"))
    push = aggregates.last_push(c).join(sync, F.col("run_id") == F.col("_id")).select("volume_id", F.col("destination").alias("name"), "_ended")
    peers = joins.peer_states(c).select("volume_id", "name", F.col("last_synced_at_ns").alias("_peer"))
    on = ["volume_id", "name"]
    rows = refs.join(ahead, on, "left").join(lacking, on, "left").join(push, on, "left").join(peers, on, "left")
    age = lambda ns: F.when(ns.isNotNull(), F.greatest(F.lit(0), F.lit(now_ns) - ns))
    changed = F.least(age(F.col("_ended")), age(F.col("_peer")))
    rows = rows.select(
        "volume_id", "name", "sync_target", "required", F.col("_updated").isNotNull().alias("missing_known"), F.coalesce("ahead", F.lit(False)).alias("ahead"),
        F.when(F.col("_updated").isNotNull(), F.col("_lacking")).otherwise(zero).alias("missing"), changed.alias("change_ns"), age(F.col("_verified")).alias("verified_ns"),
        F.least(changed, age(F.col("_updated"))).alias("as_of_ns"),
    )
    budget = stale_budget(F.col("sync_target"), F.col("required"), F.lit(sync_every_ns), F.lit(max_age_ns))
    rows = rows.withColumn("state", fleet_state(F.col("missing_known"), F.col("missing"), F.col("ahead")))
    rows = rows.withColumn("stale", (budget > 0) & (F.col("as_of_ns").isNull() | (F.col("as_of_ns") > budget)))
    return rows.withColumn("level", fleet_level(F.col("sync_target"), F.col("required"), F.col("as_of_ns"), F.lit(sync_every_ns), F.lit(max_age_ns)))


def fleet_place_refs(c) -> DataFrame:
    """D20 with roles: (volume_id, name, sync_target, required)."""
    from cairn.operators.diffs import fleet_refs

    refs = fleet_refs(lookups.ordered_targets(c), joins.fleet_places(c)).select("volume_id", "name")
    sync = c.sync_to.select("volume_id", F.col("target").alias("name"), F.lit(True).alias("_s")).distinct()
    need = c.offload_requires.select("volume_id", F.col("target").alias("name"), F.lit(True).alias("_r")).distinct()
    no = F.lit(False)
    return refs.join(sync, ["volume_id", "name"], "left").join(need, ["volume_id", "name"], "left").select("volume_id", "name", F.coalesce("_s", no).alias("sync_target"), F.coalesce("_r", no).alias("required"))


def fleet_state(known, missing, ahead):
    """D21"""
    return F.when(~known & ahead, "ahead").when(~known, "unknown").when((missing > 0) & ahead, "diverged").when(missing > 0, "behind").when(ahead, "ahead").otherwise("same")


def stale_budget(sync_target, required, sync_every, max_age):
    """G21"""
    return F.when(sync_target & (sync_every > 0), LATE * sync_every).when(required & (max_age > 0), max_age).otherwise(F.lit(0))


def fleet_level(sync_target, required, as_of, sync_every, max_age):
    """G22"""
    return F.when(~sync_target & ~required, NEUTRAL).when(as_of.isNull(), WARN).when(sync_target, cadence_level(as_of, sync_every)).when((max_age > 0) & (as_of > max_age), WARN).otherwise(OK)


def target_grid(c, now_ns: int, cadence_ns: int) -> DataFrame:
    """Coverage of each volume and accepted target."""
    state = standing(c).withColumnRenamed("destination", "target")
    push = aggregates.last_push(c).join(c.runs.select(F.col("id").alias("_id"), "ended_at_ns"), F.col("run_id") == F.col("_id")).select("volume_id", F.col("destination").alias("target"), F.greatest(F.lit(0), F.lit(now_ns) - F.col("ended_at_ns")).alias("age_ns"))
    sync = c.sync_to.select("volume_id", "target", F.lit(True).alias("_s"))
    alarm = c.destination_alarms.select(F.col("destination").alias("target"), F.lit(True).alias("_alarm"))
    on = ["volume_id", "target"]
    rows = lookups.accepted_destinations(c).join(state, on, "left").join(push, on, "left").join(sync, on, "left").join(alarm, "target", "left")
    rows = rows.withColumn("standing", F.when(F.col("_alarm"), "alarm").otherwise(F.coalesce("standing", F.lit("none")))).withColumn("sync_target", F.coalesce("_s", F.lit(False)))
    level = sync_level(F.col("standing"), F.coalesce(F.col("status"), F.lit("")), F.col("sync_target"), F.col("age_ns"), F.lit(cadence_ns))
    return rows.select("volume_id", "target", "sync_target", F.col("status").alias("last_outcome"), "standing", "age_ns", level.alias("level"))


def status_report(c, now_ns: int, cadence_ns: int, max_age_ns: int) -> DataFrame:
    """G24, A23, W18 by volume: the worst level of targets, durability and fleet; a drift latch makes it amber at least."""
    parts = [target_grid(c, now_ns, cadence_ns), durability(c, now_ns, max_age_ns), fleet(c, now_ns, cadence_ns, max_age_ns)]
    levels = None
    for x in parts:
        one = x.select("volume_id", "level")
        levels = one if levels is None else levels.union(one)
    drift = c.config_drift.select(F.lit(WARN).alias("_drift")).limit(1)
    worst = levels.groupBy("volume_id").agg(F.max("level").alias("level"))
    return worst.join(F.broadcast(drift), F.lit(True), "left").select("volume_id", "level", F.greatest("level", F.coalesce("_drift", F.lit(0))).alias("report_level"))


def push_watermark(has_sync, landed, run_id, fresh):
    """0 without a sync or for a fresh start; the run with landing evidence; null (refused) otherwise."""
    return F.when(~has_sync, 0).when(landed, run_id).when(fresh, 0)


def fresh_start(root_empty, has_records):
    """G27"""
    return root_empty & ~has_records


def settle_committing(staged, at_path):
    """G28"""
    return F.when(~staged & at_path, "live").otherwise("lost")


def settle_displacing(in_history, at_path):
    """G29"""
    return F.when(in_history, "displaced").when(at_path, "live").otherwise("lost")


def run_status(fatal, errors):
    """G30, G31, G41"""
    return F.when(fatal, "failed").when(errors > 0, "partial").otherwise("success")


def catch_up(added, quiet_ns):
    """A large late change"""
    return (added >= 25) & (quiet_ns >= 7 * 86_400_000_000_000)


def transfer_evidence(encrypted, shallow, checksum):
    """The class of evidence a transfer leaves."""
    return F.when(shallow | encrypted, "size+mtime").when(checksum, "blake3").otherwise("size+mtime")


def etag_flavour(value):
    """A dash marks a composite tag."""
    return F.when(value.contains("-"), "etag-composite").otherwise("etag-md5")


def alarm_action(findings, aborted):
    """Clean clears, findings raise, an abort without findings does neither."""
    return F.when(findings > 0, "raise").when(aborted, "keep").otherwise("clear")


def advance_method(pending, packed):
    """Fingerprint once nothing is pending; else presence and size, or nothing yet for packs."""
    return F.when(pending == 0, FINGERPRINT).when(packed, None).otherwise(PRESENCE)


def first_push_refused(tree_empty, has_paths):
    """G39"""
    return ~tree_empty & ~has_paths


def terminal_status(status, refused):
    """G40"""
    return F.when(refused, "refused").otherwise(status)


def pull_status(error, rewinds):
    """G42"""
    return F.when(error, "failed").when(rewinds > 0, "partial").otherwise("success")


def exit_code(level):
    """G43"""
    return F.when(level == CRITICAL, 2).when(level == WARN, 1).otherwise(0)


def downgraded(disposition, drifted):
    """G47"""
    return F.when((disposition == "supersede") & drifted, "conflict").otherwise(disposition)
