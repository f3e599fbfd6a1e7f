"""Queries of single rules and transitions over whole catalog tables, with their oracles.

`registry` holds the queries of whole operators; here stand the rules that these are made
of, each on rows that reach every branch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.functions import scalars as s
from cairn.operators import diffs as d
from cairn.operators import gate as g
from cairn.operators import mutations as m
from cairn.operators import ranking as w
from cairn.plans import views
from cairn.plans.projection import PREFIX
from cairn.plans.registry import _CHECKS, _GATE, DAY, LATER, NOW, ORACLES, q
from cairn.sources import files as src
from cairn.streaming import streams as t

VECTOR = ["volume_id", "destination", "origin_node_id"]


def _age(ns: str) -> str:
    """SQL of an age's label."""
    return (
        f"CASE WHEN {ns} < 60000000000 THEN concat({ns} // 1000000000, 's') WHEN {ns} < 3600000000000 THEN concat({ns} // 60000000000, 'm') "
        f"WHEN {ns} < {DAY} THEN concat({ns} // 3600000000000, 'h') ELSE concat({ns} // {DAY}, 'd') END"
    )


def _present(c, volume: int):
    return views.live_rows(c).where((F.col("volume_id") == volume) & (F.col("status") == "present"))


def _peer(c, volume: int):
    return c.peer_entries.where(F.col("volume_id") == volume)


# Sources and paths

q("s7_live_rows", lambda c: views.live_rows(c).select("id", "volume_id", "path", "blake3", "status"), "SELECT id, volume_id, path, blake3, status FROM live_rows")
q("s18_checked_listing", lambda c: src.checked_listing(
    c.listing.where("destination = 'dest0'").select("name", F.when(~F.col("unchecked"), F.col("sha256")).alias("checksum")),
    c.remote_objects.where("destination = 'dest0'").select(F.concat(F.lit("o"), "content_id").alias("name")),
), "SELECT name, CASE WHEN unchecked THEN NULL ELSE sha256 END AS checksum, unchecked FROM listing WHERE destination = 'dest0' AND name LIKE 'o%'")
q("p67_reserved_files", lambda c: views.all_rows(c).select("id", p.reserved_file(F.col("path")).alias("reserved")), f"SELECT id, path LIKE '{PREFIX}history/%' AS reserved FROM all_rows")
q("p68_reserved_folders", lambda c: c.folders.select("id", p.reserved_folder(F.col("path")).alias("reserved")), f"SELECT id, path = '{PREFIX}history' OR path LIKE '{PREFIX}history/%' AS reserved FROM folders")
q("h10_parents", lambda c: views.all_rows(c).select("id", p.parent(F.col("path")).alias("folder")), "SELECT f.id, d.path AS folder FROM files f JOIN folders d ON d.id = f.folder_id")
q("h11_last_segments", lambda c: views.all_rows(c).select("id", p.last_segment(F.col("path")).alias("name")), "SELECT id, name FROM files")
q("h12_first_segments", lambda c: views.all_rows(c).select("id", p.first_segments(F.col("path"), F.lit(2)).alias("top")), "SELECT id, array_to_string(string_split(path, '/')[1:2], '/') AS top FROM all_rows")
q("f1_escaped", lambda c: c.files.select("id", p.escape_like(F.concat("name", F.lit("_5%\\"))).alias("pattern")), r"SELECT id, concat(name, '\_5\%\\') AS pattern FROM files")
q("f25_ancestors", lambda c: views.all_rows(c).select("id", F.explode(p.ancestors(F.col("path"))).alias("folder")),
  "SELECT id, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM all_rows")
q("f26_joined", lambda c: views.all_rows(c).join(c.volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("root")), "volume_id").select(
    F.col("id"), p.join_volume(F.col("root"), F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, ".").otherwise(F.col("path"))).alias("full")),
  "SELECT r.id, CASE WHEN r.id % 5 < 2 THEN v.path ELSE concat(v.path, '/', r.path) END AS full FROM all_rows r JOIN volumes v ON v.id = r.volume_id")
q("f31_companions", lambda c: s.apple_double(c.files.select("id", "folder_id", "name").select(F.col("folder_id").alias("folder"), F.explode(F.when(F.col("id") % 2 == 0, F.array("name", F.concat(F.lit("._"), "name"))).otherwise(F.array(F.concat(F.lit("._"), "name")))).alias("name")).distinct()),
  "SELECT DISTINCT a.folder_id AS folder, concat('._', a.name) AS name FROM files a JOIN files b ON b.folder_id = a.folder_id AND b.name = a.name AND b.id % 2 = 0")

# Text, ages and versions

q("f9_elapsed", lambda c: c.runs.select("id", s.elapsed_since(F.col("started_at_ns"), F.col("ended_at_ns"), F.lit(LATER)).alias("ns")), f"SELECT id, {LATER} - CASE WHEN ended_at_ns IS NULL THEN started_at_ns ELSE ended_at_ns END AS ns FROM runs")
q("f21_plain", lambda c: c.runs.where("error is not null").select("id", s.without_escapes(F.concat(F.lit("\x1b[1;31m"), "error", F.lit("\x1b[0m"))).alias("text")), "SELECT id, error AS text FROM runs WHERE error IS NOT NULL")
q("f30_versions", lambda c: c.lineitem.select("l_orderkey", "l_linenumber", s.version_at_least(F.col("l_linenumber"), F.col("l_suppkey") % 5, F.col("l_partkey") % 7, (3, 2, 4)).alias("enough")),
  "SELECT l_orderkey, l_linenumber, l_linenumber > 3 OR l_linenumber = 3 AND (l_suppkey % 5 > 2 OR l_suppkey % 5 = 2 AND l_partkey % 7 >= 4) AS enough FROM lineitem")
q("f32_digests", lambda c: c.documents.select("doc_id", s.digest(F.col("text")).alias("digest")), "SELECT doc_id, sha256(text) AS digest FROM documents")
q("f34_evidence_labels", lambda c: c.vectors.withColumn("_age", F.lit(LATER) - F.col("verified_at_ns")).withColumn("_most", F.when(F.col("volume_id") % 2 == 0, 250 * DAY).otherwise(0)).select(
    *VECTOR, s.evidence_label(F.col("verify_method").isNotNull(), F.col("origin_node_id") != 3, F.col("_age"), F.col("_most"), g.evidence_stale(F.col("_age"), F.col("_most"))).alias("label")),
  f"SELECT volume_id, destination, origin_node_id, CASE WHEN verify_method IS NULL OR origin_node_id = 3 THEN '—' ELSE concat(CASE WHEN verified_at_ns IS NULL THEN 'unknown' ELSE {_age(f'({LATER} - verified_at_ns)')} END, "
  f"CASE WHEN volume_id % 2 = 0 THEN ' / 250d' ELSE '' END, CASE WHEN volume_id % 2 = 0 AND coalesce({LATER} - verified_at_ns > {250 * DAY}, true) THEN ' STALE' ELSE '' END) END AS label FROM vectors")
q("f46_hash_types", lambda c: c.remote_packs.select("pack_id", "destination", d.hash_type(F.when(F.col("pack_id") % 3 == 0, "etag-md5").when(F.col("pack_id") % 3 == 1, "etag-composite").otherwise(F.col("checksum_algo"))).alias("slot")),
  "SELECT pack_id, destination, CASE WHEN pack_id % 3 < 2 THEN 'md5' ELSE checksum_algo END AS slot FROM remote_packs")
q("f48_fresher", lambda c: c.vectors.select(*VECTOR, s.fresher(F.lit(LATER) - F.col("verified_at_ns"), F.lit(LATER) - F.col("updated_at_ns")).alias("ns")),
  f"SELECT volume_id, destination, origin_node_id, {LATER} - CASE WHEN coalesce(verified_at_ns > updated_at_ns, false) THEN verified_at_ns ELSE updated_at_ns END AS ns FROM vectors")
q("f49_older", lambda c: c.vectors.select(*VECTOR, s.older(F.lit(LATER) - F.col("verified_at_ns"), F.lit(LATER) - F.col("updated_at_ns")).alias("ns")),
  f"SELECT volume_id, destination, origin_node_id, {LATER} - CASE WHEN coalesce(verified_at_ns < updated_at_ns, false) THEN verified_at_ns ELSE updated_at_ns END AS ns FROM vectors")

# Comparisons

q("d4_content_mismatch", lambda c: views.live_rows(c).select("id", "volume_id", "path", "blake3").join(c.peer_entries.select("volume_id", "path", F.col("blake3").alias("_named")), ["volume_id", "path"], "left").select(
    "id", d.content_mismatch(F.col("blake3"), F.coalesce("_named", F.lit(""))).alias("differs")),
  "SELECT id, id % 7 = 0 AND id % 6 <> 0 AND id % 9 <> 0 AS differs FROM live_rows")
q("d15_failing", lambda c: d.failing(d.verify_session(_present(c, 1), _peer(c, 1))),
  "SELECT l.path FROM live_rows l LEFT JOIN peer_entries e ON e.volume_id = 1 AND e.path = l.path WHERE l.volume_id = 1 AND l.status = 'present' AND (e.path IS NULL OR e.blake3 <> l.blake3)")
q("d23_fold_members", lambda c: d.fold_members(c.nation.select(F.concat(F.lower("n_name"), F.lit("/a")).alias("path")), c.nation.where("n_regionkey < 3").select(F.concat("n_name", F.lit("/a")).alias("path"))),
  "WITH x AS (SELECT concat(lower(n_name), '/a') AS path, lower(n_name) AS top, true AS planned, false AS live FROM nation UNION ALL SELECT concat(n_name, '/a'), n_name, false, true FROM nation WHERE n_regionkey < 3) "
  "SELECT upper(top) AS key, path, top AS spelling, true AS dir, planned, live FROM x UNION ALL SELECT upper(path), path, path, false, planned, live FROM x")
q("d24_collisions", lambda c: d.collisions(d.fold_members(c.nation.select(F.lower("n_name").alias("path")), c.nation.where("n_regionkey < 3").select(F.col("n_name").alias("path")))), "SELECT upper(n_name) AS key FROM nation WHERE n_regionkey < 3")
q("d28_live_under", lambda c: d.live_under(c.nation.select(F.concat(F.lower("n_name"), F.lit("/x")).alias("path")), "Nation_1"), "SELECT concat(lower(n_name), '/x') AS path FROM nation WHERE n_name = 'NATION_1'")
q("d35_preserved", lambda c: d.preserved_rows(_present(c, 1), _peer(c, 1)),
  "SELECT l.path, coalesce(e.blake3, l.blake3) AS blake3, coalesce(e.size_bytes, l.size_bytes) AS size_bytes, CASE WHEN e.blake3 <> l.blake3 THEN NULL ELSE l.origin_node_id END AS origin_node_id "
  "FROM live_rows l LEFT JOIN peer_entries e ON e.volume_id = 1 AND e.path = l.path WHERE l.volume_id = 1 AND l.status = 'present'")
q("d36_removal_drift", lambda c: d.removal_drift(_present(c, 1), _peer(c, 1).select("path", (F.col("mtime_ns") % 5 == 0).alias("inode_changed"), (F.col("size_bytes") + F.when(F.col("size_bytes") % 4 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime_ns", "blake3")),
  "SELECT l.path, CASE WHEN e.mtime_ns % 5 = 0 THEN 'replaced' WHEN e.size_bytes % 4 = 0 THEN 'size' WHEN e.blake3 <> l.blake3 THEN 'hash' END AS drift "
  "FROM live_rows l JOIN peer_entries e ON e.volume_id = 1 AND e.path = l.path WHERE l.volume_id = 1 AND l.status = 'present'")
q("w12_snapshots", lambda c: w.sorted_snapshots(src.snapshot_names(_snapshots(c))).select("volume", "name", "run_id"), "SELECT name AS volume, concat('index-2024010', id % 9 + 1, 'T000000-run-', id, '.db') AS name, id AS run_id FROM volumes")
q("w13_newest_snapshot", lambda c: w.chosen_snapshot(src.snapshot_names(_snapshots(c))).select("volume", "name"),
  "SELECT name AS volume, concat('index-2024010', id % 9 + 1, 'T000000-run-', id, '.db') AS name FROM volumes ORDER BY id % 9 DESC, volume, name LIMIT 1")
q("w18_worst", lambda c: c.runs.select("id", w.worst(F.col("id") % 4, F.col("file_count") % 3).alias("level")), "SELECT id, CASE WHEN id % 4 > file_count % 3 THEN id % 4 ELSE file_count % 3 END AS level FROM runs")


def _snapshots(c):
    return c.volumes.select(F.col("name").alias("volume"), F.concat(F.lit("index-2024010"), F.col("id") % 9 + 1, F.lit("T000000-run-"), "id", F.lit(".db")).alias("name"))


# Decisions

q("g4_failure_kinds", lambda c: _GATE(c).groupBy("target", "failure").agg(F.count(F.lit(1)).alias("files")), f"SELECT target, failure, count(*) AS files FROM {_CHECKS} GROUP BY 1, 2")
q("g9_known_methods", lambda c: c.vectors.select(*VECTOR, g.known_method(F.when(F.col("origin_run_id") % 3 == 0, F.concat("verify_method", F.lit("-old"))).otherwise(F.col("verify_method"))).alias("known")),
  "SELECT volume_id, destination, origin_node_id, verify_method IS NOT NULL AND origin_run_id % 3 <> 0 AS known FROM vectors")
q("g10_relayed", lambda c: c.vectors.select(*VECTOR, g.relayed_method(F.col("verify_method"), F.when(F.col("verified_at_ns").isNotNull(), F.col("origin_run_id") % 3)).alias("method")),
  "SELECT volume_id, destination, origin_node_id, CASE WHEN verify_method = 'fingerprint-verified' AND (verified_at_ns IS NULL OR origin_run_id % 3 = 0) THEN 'presence+size' ELSE verify_method END AS method FROM vectors")
q("g15_sync_levels", lambda c: c.runs.select("id", g.sync_level(
    F.element_at(F.array(*map(F.lit, ("none", "alarm", "refused", "needs-bootstrap", "none"))), (F.col("id") % 5 + 1).cast("int")), F.col("status"), F.col("id") % 3 > 0, F.lit(LATER) - F.col("ended_at_ns"), F.lit(130 * DAY)).alias("level")),
  f"SELECT id, CASE WHEN id % 5 IN (1, 2) THEN 3 WHEN id % 5 = 3 THEN 2 WHEN status = 'failed' THEN 3 WHEN status = 'partial' THEN 2 WHEN id % 3 = 0 THEN 0 WHEN ended_at_ns IS NULL THEN 2 "
  f"WHEN ended_at_ns >= {LATER - 130 * DAY} THEN 1 WHEN ended_at_ns >= {LATER - 390 * DAY} THEN 2 ELSE 3 END AS level FROM runs")
q("g16_cadence_levels", lambda c: c.runs.where("ended_at_ns is not null").select("id", g.cadence_level(F.lit(LATER) - F.col("ended_at_ns"), F.col("id") % 4 * 100 * DAY).alias("level")),
  f"SELECT id, CASE WHEN id % 4 = 0 THEN 1 ELSE 3 - (ended_at_ns >= {LATER} - id % 4 * {100 * DAY})::INT - (ended_at_ns >= {LATER} - id % 4 * {300 * DAY})::INT END AS level FROM runs WHERE ended_at_ns IS NOT NULL")
q("g17_durability_levels", lambda c: c.vectors.select(*VECTOR, g.durability_level(F.col("origin_node_id") != 3, F.col("origin_run_id") % 2 == 0, g.evidence_stale(F.lit(LATER) - F.col("verified_at_ns"), F.lit(250 * DAY)), F.col("volume_id") <= 2).alias("level")),
  f"SELECT volume_id, destination, origin_node_id, CASE WHEN origin_node_id = 3 THEN 0 WHEN origin_run_id % 2 = 0 AND coalesce(verified_at_ns >= {LATER - 250 * DAY}, false) THEN 1 WHEN volume_id <= 2 THEN 2 ELSE 0 END AS level FROM vectors")
q("g18_stale_evidence", lambda c: c.vectors.select(*VECTOR, g.evidence_stale(F.lit(LATER) - F.col("verified_at_ns"), F.when(F.col("volume_id") > 1, F.col("volume_id") % 4 * 200 * DAY)).alias("stale")),
  f"SELECT volume_id, destination, origin_node_id, volume_id NOT IN (1, 4) AND (verified_at_ns IS NULL OR verified_at_ns < {LATER} - volume_id % 4 * {200 * DAY}) AS stale FROM vectors")
q("g21_stale_budgets", lambda c: c.vectors.select(*VECTOR, g.stale_budget(F.col("volume_id") % 2 == 0, F.col("origin_node_id") % 2 == 0, F.col("volume_id") - 2, F.col("origin_node_id") - 2).alias("budget")),
  "SELECT volume_id, destination, origin_node_id, CASE WHEN volume_id = 4 THEN 6 WHEN origin_node_id = 4 THEN 2 ELSE 0 END AS budget FROM vectors")
q("g22_fleet_levels", lambda c: c.runs.select("id", g.fleet_level(F.col("id") % 3 == 0, F.col("id") % 3 < 2, F.lit(LATER) - F.col("ended_at_ns"), F.lit(130 * DAY), F.when(F.col("id") % 2 == 0, 300 * DAY).otherwise(0)).alias("level")),
  f"SELECT id, CASE WHEN id % 3 = 2 THEN 0 WHEN ended_at_ns IS NULL THEN 2 WHEN id % 3 = 0 THEN CASE WHEN ended_at_ns >= {LATER - 130 * DAY} THEN 1 WHEN ended_at_ns >= {LATER - 390 * DAY} THEN 2 ELSE 3 END "
  f"WHEN id % 2 = 0 AND ended_at_ns < {LATER - 300 * DAY} THEN 2 ELSE 1 END AS level FROM runs")
q("g27_fresh_starts", lambda c: c.volumes.join(c.files.select(F.col("volume_id").alias("id"), F.lit(True).alias("_has")).distinct(), "id", "left").select("id", g.fresh_start(F.col("id") % 2 == 0, F.coalesce("_has", F.lit(False))).alias("fresh")),
  "SELECT id, id % 2 = 0 AND id NOT IN (SELECT volume_id FROM files) AS fresh FROM volumes")
q("g29_settled_displacing", lambda c: c.remote_paths.where("state = 'displacing'").select("id", g.settle_displacing(F.col("id") % 3 == 0, F.col("id") % 2 == 0).alias("state")), "SELECT id, CASE id % 6 WHEN 0 THEN 'displaced' WHEN 3 THEN 'displaced' WHEN 2 THEN 'live' WHEN 4 THEN 'live' ELSE 'lost' END AS state FROM remote_paths WHERE state = 'displacing'")
q("g32_catch_ups", lambda c: c.runs.where("kind = 'index' and ended_at_ns is not null").select("id", g.catch_up(F.col("file_count"), F.lit(NOW) - F.col("ended_at_ns")).alias("late")), f"SELECT id, file_count > 24 AND ended_at_ns <= {NOW - 7 * DAY} AS late FROM runs WHERE kind = 'index' AND ended_at_ns IS NOT NULL")
q("g33_transfer_evidence", lambda c: c.runs.join(c.destinations.select(F.col("name").alias("destination"), "encrypted"), "destination").select("id", g.transfer_evidence(F.col("encrypted"), F.col("file_count") % 3 == 0, F.col("id") % 2 == 0).alias("evidence")),
  "SELECT id, CASE WHEN destination <> 'dest2' AND file_count % 3 <> 0 AND id % 2 = 0 THEN 'blake3' ELSE 'size+mtime' END AS evidence FROM runs WHERE destination IN ('dest0', 'dest1', 'dest2')")
q("g37_advances_by_layout", lambda c: c.remote_paths.groupBy("destination", (F.col("id") % 3 > 0).alias("stamped")).agg(F.count_if(F.col("checksum").isNull()).alias("_n")).join(c.destinations.select(F.col("name").alias("destination"), "layout"), "destination").select(
    "destination", "stamped", g.advance_method(F.col("_n"), F.col("layout") == "packed").alias("method")),
  "SELECT DISTINCT destination, id % 3 > 0 AS stamped, CASE WHEN id % 3 > 0 THEN 'fingerprint-verified' WHEN destination <> 'dest2' THEN 'presence+size' END AS method FROM remote_paths WHERE destination <> 'dest3'")
q("g39_first_pushes", lambda c: c.sync_to.join(c.remote_paths.select(F.col("destination").alias("target"), F.lit(True).alias("_has")).distinct(), "target", "left").select("volume_id", "target", g.first_push_refused(F.col("volume_id") % 2 == 0, F.coalesce("_has", F.lit(False)) & (F.col("volume_id") < 4)).alias("refused")),
  "SELECT volume_id, target, volume_id % 2 = 1 AND NOT (volume_id < 4 AND target IN (SELECT destination FROM remote_paths)) AS refused FROM sync_to")
q("g40_terminal", lambda c: c.runs.select("id", g.terminal_status(F.col("status"), F.col("error").eqNullSafe("re-run with --init")).alias("status")), "SELECT id, status FROM runs")
q("g42_pulls", lambda c: c.runs.where("peer_node_id is not null").select("id", g.pull_status(F.col("error").isNotNull(), F.col("file_count") % 3).alias("status")), "SELECT id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN file_count % 3 = 0 THEN 'success' ELSE 'partial' END AS status FROM runs WHERE peer_node_id IS NOT NULL")
q("x4_hook_status", lambda c: c.hook_runs.select("id", s.hook_status(F.col("volume_id") % 3, F.col("trigger") == "interval").alias("status")), "SELECT id, CASE WHEN id % 2 = 0 THEN 'timeout' WHEN volume_id = 3 THEN 'success' ELSE 'failed' END AS status FROM hook_runs")
q("t18_claimed_maxima", t.advance_snapshot)
ORACLES["t18_claimed_maxima"] = ORACLES["a9_present_maxima"]  # a push claims what is present

# Transitions

q("m19_appended", lambda c: m.append_rows(c.remote_paths, c.files.select((F.col("id") + 1_000_000_000).alias("id"), "folder_id", "name", "content_id", F.lit("dest9").alias("destination"), F.lit("committing").alias("state"))).select("id", "name", "destination", "state", "checksum"),
  "SELECT id, name, destination, state, checksum FROM remote_paths UNION ALL SELECT id + 1000000000, name, 'dest9', 'committing', NULL FROM files")
q("m25_pack_fingerprints", lambda c: m.set_fingerprint(c.remote_packs, c.packs.select(F.col("id").alias("pack_id"), F.lit("sha256").alias("algo"), "pack_key").withColumnRenamed("pack_key", "value"), ["pack_id"], NOW).select("pack_id", "destination", "checksum_algo", "checksum", "verified_at_ns"),
  f"SELECT pack_id, destination, CASE WHEN pack_id % 5 = 0 THEN 'sha256' ELSE 'md5' END AS checksum_algo, CASE WHEN pack_id % 5 = 0 THEN concat('pack', pack_id) ELSE concat('p', pack_id) END AS checksum, CASE WHEN pack_id % 5 = 0 THEN {NOW} ELSE verified_at_ns END AS verified_at_ns FROM remote_packs")
q("m27_packs_verified", lambda c: m.mark_verified(c.remote_packs, c.remote_packs.where("destination = 'dest1'"), ["pack_id", "destination"], NOW).select("pack_id", "destination", "verified_at_ns"), f"SELECT pack_id, destination, CASE WHEN pack_id % 4 = 1 THEN {NOW} ELSE verified_at_ns END AS verified_at_ns FROM remote_packs")
q("m39_cleared_alarms", lambda c: m.clear_latches(c.destination_alarms, c.destinations.where("encrypted").select(F.col("name").alias("destination")), ["destination"]).select("destination", "detail"), "SELECT destination, detail FROM destination_alarms WHERE destination <> 'dest2'")
q("m71_rekeyed_contents", lambda c: m.rekey_by_content(c.peer_entries, c.contents).select("volume_id", "path", "content_id"), "SELECT e.volume_id, e.path, c.id AS content_id FROM peer_entries e JOIN contents c ON c.blake3 = e.blake3")
q("m72_rekeyed_imports", lambda c: m.rekey_by_import(c.peer_entries, c.runs.where("kind = 'index' and volume_id is not null").groupBy("volume_id").agg(F.min("id").alias("id"))).select("volume_id", "path", "first_seen_run_id"),
  "SELECT volume_id, path, (SELECT min(id) FROM runs r WHERE r.kind = 'index' AND r.volume_id = e.volume_id) AS first_seen_run_id FROM peer_entries e WHERE volume_id IN (SELECT volume_id FROM runs WHERE kind = 'index')")

# Checked inserts

q("m24_objects", lambda c: m.insert_objects(c.remote_objects, c.contents.select((F.col("id") + 1_000_000_000).alias("content_id"), F.lit("dest1").alias("destination"), F.when(F.col("id") % 2 == 0, "md5").alias("checksum_algo"), F.when(F.col("id") % 2 == 0, F.substring("blake3", 1, 32)).alias("checksum"))).select("content_id", "destination", "checksum_algo", "checksum"),
  "SELECT content_id, destination, checksum_algo, checksum FROM remote_objects UNION ALL SELECT id + 1000000000, 'dest1', CASE id % 2 WHEN 0 THEN 'md5' END, CASE id % 2 WHEN 0 THEN substring(blake3, 1, 32) END FROM contents")
_NEW_PACKS = lambda c: c.orders.where("o_orderkey % 2 = 0").groupBy((F.col("o_custkey") + 1_000_000_000).alias("id")).agg(
    F.concat(F.lit("new"), F.min("o_custkey")).alias("pack_key"), F.count(F.lit(1)).alias("size_bytes"), F.collect_list(F.struct(F.col("o_orderkey").alias("content_id"), F.lit(0).cast("long").alias("offset_bytes"), F.lit(1).cast("long").alias("length_bytes"))).alias("members"))
q("m28_packs", lambda c: m.insert_packs(c.packs, c.pack_members, _NEW_PACKS(c))[0].select("id", "pack_key", "size_bytes"),
  "SELECT id, pack_key, size_bytes FROM packs UNION ALL SELECT o_custkey + 1000000000, concat('new', o_custkey), count(*) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey")
q("m28_pack_members", lambda c: m.insert_packs(c.packs, c.pack_members, _NEW_PACKS(c))[1].select("content_id", "pack_id", "length_bytes"),
  "SELECT content_id, pack_id, length_bytes FROM pack_members UNION ALL SELECT o_orderkey, o_custkey + 1000000000, 1 FROM orders WHERE o_orderkey % 2 = 0")
q("m43_hook_runs", lambda c: m.insert_hook_runs(c.hook_runs, c.volumes.select((F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("volume_id"), F.when(F.col("id") % 2 == 0, "change").otherwise("interval").alias("trigger"), F.when(F.col("id") % 2 == 0, F.col("id") + 5).otherwise(0).alias("triggering_run_id"))).select("id", "volume_id", "trigger", "triggering_run_id", "status"),
  "SELECT id, volume_id, trigger, CAST(NULL AS BIGINT) AS triggering_run_id, status FROM hook_runs UNION ALL SELECT id + 1000000000, id, CASE id % 2 WHEN 0 THEN 'change' ELSE 'interval' END, CASE id % 2 WHEN 0 THEN id + 5 END, 'running' FROM volumes")
