"""Queries over the driver's tables and their SQL oracles, by name.

Every query is an operator applied to the catalog projection of a driver folder; every
oracle is written against the same projection in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.functions import scalars as s
from cairn.operators import aggregates as a
from cairn.operators import diffs as d
from cairn.operators import gate as g
from cairn.operators import integrity, tree
from cairn.operators import joins as j
from cairn.operators import lookups as k
from cairn.operators import mutations as m
from cairn.operators import ranking as w
from cairn.plans import views
from cairn.plans.projection import PREFIX, Catalog, duck
from cairn.sources import files as src
from cairn.sources import sinks
from cairn.streaming import streams as t

QUERIES: dict = {}
ORACLES: dict = {}
NOW = 1705300000000000000
DAY = 86400 * 10**9
HOUR = DAY // 24
#: After every run of the driver's events.
LATER = NOW + 400 * DAY


def q(name: str, run: Callable[[Catalog], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Catalog(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = duck(sql)


def _least(df: DataFrame, column: str):
    """An argument that hits: the least value of a column."""
    return df.agg(F.min(column)).first()[0]


# Lookups and filters

q("p1_live_at", lambda c: k.live_at(c, 1, "en/src0/f5.txt").select("id", "path", "blake3", "status"), "SELECT id, path, blake3, status FROM live_rows WHERE volume_id = 1 AND path = 'en/src0/f5.txt'")
q("p2_by_absolute_path", lambda c: k.by_absolute_path(c, views.live_rows(c).join(c.volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("root")), "volume_id").select(F.concat_ws("/", "root", "path").alias("abs"))).select("abs", "volume_id", "path", "id"),
  "SELECT concat(v.path, '/', l.path) AS abs, l.volume_id, l.path, l.id FROM live_rows l JOIN volumes v ON v.id = l.volume_id")
q("p3_relative", lambda c: c.volumes.crossJoin(F.broadcast(c.volumes.where("id <= 5").select(F.col("path").alias("base")))).select("id", "base", p.relative(F.col("base"), F.col("path")).alias("rel")),
  "SELECT v.id, b.path AS base, CASE WHEN v.path = b.path THEN '.' WHEN starts_with(v.path, concat(b.path, '/')) THEN substring(v.path, length(b.path) + 2) END AS rel FROM volumes v, volumes b WHERE b.id <= 5")
q("p4_history", lambda c: k.history_at(c, 1, "en/src0/f5.txt").select("id", "status", "first_seen_run_id"), "SELECT id, status, first_seen_run_id FROM all_rows WHERE volume_id = 1 AND path = 'en/src0/f5.txt'")
q("p5_by_digest", lambda c: k.by_digest(c, _least(c.contents, "blake3")).select("id", "volume", "path"),
  "SELECT r.id, v.name AS volume, r.path FROM all_rows r JOIN volumes v ON v.id = r.volume_id WHERE r.blake3 = (SELECT min(blake3) FROM contents)")
q("p6_dedup_sources", k.dedup_sources, f"SELECT volume_id, blake3, min(path) AS path FROM live_rows WHERE status = 'present' AND lower(path) NOT LIKE '{PREFIX}conflicts/%' AND lower(path) NOT LIKE '{PREFIX}history/%' AND lower(path) NOT LIKE '{PREFIX}staging/%' GROUP BY 1, 2")
q("p7_missing", lambda c: k.missing(c).select("id", "volume", "path"), "SELECT r.id, v.name AS volume, r.path FROM live_rows r JOIN volumes v ON v.id = r.volume_id WHERE r.status = 'missing'")
q("p8_present_paths", lambda c: k.present_paths(c, 2), "SELECT DISTINCT path FROM live_rows WHERE volume_id = 2 AND status = 'present'")
q("p9_in_folder", lambda c: k.present_in_folder(c, _least(views.live_rows(c).where("status = 'present'"), "folder_id")).select("id", "name"), "SELECT id, name FROM live_rows WHERE folder_id = (SELECT min(folder_id) FROM live_rows WHERE status = 'present') AND status = 'present'")
q("p10_by_origin", lambda c: k.present_by_origin(c, None, 3).select("id", "path"), "SELECT id, path FROM live_rows WHERE status = 'present' AND volume_id = 3 AND origin_node_id IS NULL")
q("p11_present_content", lambda c: k.present_content(c, 2).select("id", "path", "blake3"), "SELECT id, path, blake3 FROM present_rows WHERE volume_id = 2")
q("p12_path_delta", lambda c: k.path_delta(c, 1, 20).select("path", "content_id", "status", "size_bytes"),
  f"SELECT path, content_id, status, size_bytes FROM all_rows WHERE volume_id = 1 AND lower(path) NOT LIKE '{PREFIX}%' AND coalesce(status_changed_run_id, first_seen_run_id) > 20")
q("p13_folder_by_path", lambda c: k.folder_by_path(c, 1, "en"), "SELECT * FROM folders WHERE volume_id = 1 AND path = 'en'")
q("p14_child_folders", lambda c: k.child_folders(c, 1), "SELECT * FROM folders WHERE parent_id = 1")
q("p15_folder_by_id", lambda c: k.by_id(c.folders, 7), "SELECT * FROM folders WHERE id = 7")
q("p16_runs", lambda c: k.runs(c, 2, True, 25).select("id", "kind", "status"), "SELECT id, kind, status FROM runs WHERE volume_id = 2 ORDER BY id DESC LIMIT 25")
q("p17_runs_by_peer", lambda c: k.runs_by_peer(c, 3, 20).select("id", "status"), "SELECT id, status FROM runs WHERE kind = 'sync' AND peer_node_id = 3 ORDER BY id DESC LIMIT 20")
q("p18_run", lambda c: k.by_id(c.runs, 42).select("id", "kind", "status", "file_count"), "SELECT id, kind, status, file_count FROM runs WHERE id = 42")
q("p19_audits_since", lambda c: k.audits_since(c, 3, 1704800000000000000).select("id", "started_at_ns"), "SELECT id, started_at_ns FROM runs WHERE kind = 'audit' AND volume_id = 3 AND started_at_ns > 1704800000000000000")
q("p20_no_op", lambda c: c.runs.where(k.no_op()).select("id"), "SELECT id FROM runs WHERE status = 'success' AND coalesce(changed_count, file_count) = 0")
q("p21_contested", lambda c: k.contested(c).select("volume_id", "path", "live_blake3"), "SELECT volume_id, path, live_blake3 FROM contested_paths")
q("p22_contested_at", lambda c: k.at_key(c.contested_paths, volume_id=1).select("path", "raised_run_id"), "SELECT path, raised_run_id FROM contested_paths WHERE volume_id = 1")
q("p23_contested_flags", lambda c: k.contested_flags(c, views.live_rows(c).select("volume_id", "path")), "SELECT l.volume_id, l.path, c.live_blake3, c.path IS NOT NULL AS contested FROM live_rows l LEFT JOIN contested_paths c USING (volume_id, path)")
q("p24_alarms", lambda c: k.sorted_table(c.destination_alarms, "destination"), "SELECT * FROM destination_alarms")
q("p25_alarm", lambda c: k.at_key(c.destination_alarms, destination="dest1"), "SELECT * FROM destination_alarms WHERE destination = 'dest1'")
q("p26_component", lambda c: k.at_key(c.vectors, volume_id=2, destination="dest1", origin_node_id=2), "SELECT * FROM vectors WHERE volume_id = 2 AND destination = 'dest1' AND origin_node_id = 2")
q("p27_vector", lambda c: k.at_key(c.vectors, volume_id=2, destination="dest1"), "SELECT * FROM vectors WHERE volume_id = 2 AND destination = 'dest1'")
q("p28_volume_vectors", lambda c: k.at_key(c.vectors, volume_id=3), "SELECT * FROM vectors WHERE volume_id = 3")
q("p29_vector_history", lambda c: k.sorted_table(k.at_key(c.vectors_history, volume_id=2, destination="dest1"), "id"), "SELECT * FROM vectors_history WHERE volume_id = 2 AND destination = 'dest1'")
q("p30_freshness", lambda c: k.at_key(c.push_freshness, volume_id=1, destination="dest2"), "SELECT * FROM push_freshness WHERE volume_id = 1 AND destination = 'dest2'")
q("p31_volume_freshness", lambda c: k.at_key(c.push_freshness, volume_id=4), "SELECT * FROM push_freshness WHERE volume_id = 4")
q("p32_peer_state", lambda c: k.at_key(c.peer_sync_state, volume_id=1, peer_node_id=2), "SELECT * FROM peer_sync_state WHERE volume_id = 1 AND peer_node_id = 2")
q("p33_peer_history", lambda c: k.sorted_table(k.at_key(c.peer_sync_history, volume_id=1, peer_node_id=3), "id"), "SELECT * FROM peer_sync_history WHERE volume_id = 1 AND peer_node_id = 3")
q("p34_hook_runs", lambda c: k.hook_runs(c, 1, False, 15).select("id", "trigger", "status"), "SELECT id, \"trigger\", status FROM hook_runs WHERE volume_id = 1 ORDER BY id LIMIT 15")
q("p35_run_audit", lambda c: k.sorted_table(k.at_key(c.runs_audit, run_id=17), "id"), "SELECT * FROM runs_audit WHERE run_id = 17")
q("p36_remote_object", lambda c: k.at_key(c.remote_objects, content_id=_least(c.remote_objects.where("destination = 'dest1'"), "content_id"), destination="dest1").select("content_id", "checksum"), "SELECT content_id, checksum FROM remote_objects WHERE content_id = (SELECT min(content_id) FROM remote_objects WHERE destination = 'dest1') AND destination = 'dest1'")
q("p37_has_object", lambda c: k.exists_in(c.contents.select(F.col("id").alias("content_id")), c.remote_objects.where("destination = 'dest1'"), ["content_id"]), "SELECT id AS content_id FROM contents WHERE id IN (SELECT content_id FROM remote_objects WHERE destination = 'dest1')")
q("p38_remote_pack", lambda c: k.at_key(c.remote_packs, pack_id=5), "SELECT * FROM remote_packs WHERE pack_id = 5")
q("p39_pack_member", lambda c: k.at_key(c.pack_members, content_id=11), "SELECT * FROM pack_members WHERE content_id = 11")
q("p40_has_pack", lambda c: k.exists_in(c.contents.select(F.col("id").alias("content_id")), c.pack_members, ["content_id"]), "SELECT id AS content_id FROM contents WHERE id IN (SELECT content_id FROM pack_members)")
q("p41_pack_by_key", lambda c: k.at_key(c.packs, pack_key="pack3"), "SELECT * FROM packs WHERE pack_key = 'pack3'")
q("p42_pack", lambda c: k.by_id(c.packs, 9), "SELECT * FROM packs WHERE id = 9")
q("p43_pack_members", lambda c: k.sorted_table(k.at_key(c.pack_members, pack_id=9), "offset_bytes"), "SELECT * FROM pack_members WHERE pack_id = 9")
q("p44_self_node", k.self_node, "SELECT * FROM nodes WHERE endpoint IS NULL")
q("p45_node_by_name", lambda c: c.nodes.join(c.nodes.where("id = 4").select("name"), "name", "left_semi").select("id", "name"), "SELECT id, name FROM nodes WHERE name = (SELECT name FROM nodes WHERE id = 4)")
q("p46_node", lambda c: k.by_id(c.nodes, 3), "SELECT * FROM nodes WHERE id = 3")
q("p47_volumes", lambda c: k.sorted_table(c.volumes, "name"), "SELECT * FROM volumes")
q("p48_volume_by_name", lambda c: k.at_key(c.volumes, name="asia"), "SELECT * FROM volumes WHERE name = 'asia'")
q("p49_volume_by_path", k.volume_by_path, "SELECT path, arg_min(name, id) AS name, min(id) AS id FROM volumes GROUP BY path")
q("p50_volume", lambda c: k.by_id(c.volumes, 101), "SELECT * FROM volumes WHERE id = 101")
q("p51_config_drift", k.config_drift, "SELECT * FROM config_drift WHERE id = 1")
q("p52_query_by_path", lambda c: k.query(c, "en/src0/f5.txt", True).select("id", "volume_id"), "SELECT id, volume_id FROM all_rows WHERE path = 'en/src0/f5.txt'")
q("p53_origin_filter", lambda c: views.live_rows(c).where(k.origin_matches(True, 2)).select("id"), "SELECT id FROM live_rows WHERE origin_node_id = 2")
q("p54_digest_from", lambda c: k.by_digest_from(c, _least(c.contents.where("origin_node_id is null"), "blake3"), True, None).select("id"), f"SELECT id FROM all_rows WHERE blake3 = (SELECT min(blake3) FROM contents WHERE origin_node_id IS NULL) AND origin_node_id IS NULL")
q("p55_path_query", lambda c: k.by_path_query(c, 1, _least(views.all_rows(c).where("volume_id = 1 and origin_node_id is null"), "path"), True, True, None).select("id"), "SELECT id FROM all_rows WHERE volume_id = 1 AND path = (SELECT min(path) FROM all_rows WHERE volume_id = 1 AND origin_node_id IS NULL) AND origin_node_id IS NULL")
q("p56_origin_listing", lambda c: k.present_by_origin(c, 3).select("id", "volume_id", "path"), "SELECT id, volume_id, path FROM live_rows WHERE status = 'present' AND origin_node_id = 3")
q("p57_is_hash", lambda c: c.contents.select("id", p.is_hash(F.col("blake3")).alias("hash")).union(c.nodes.select("id", p.is_hash(F.col("name")))), "SELECT id, regexp_full_match(blake3, '[0-9a-fA-F]{64}') AS hash FROM contents UNION ALL SELECT id, regexp_full_match(name, '[0-9a-fA-F]{64}') FROM nodes")
q("p58_search_digest", lambda c: k.query(c, _least(c.contents, "blake3").upper()).select("id"), f"SELECT id FROM all_rows WHERE blake3 = (SELECT min(blake3) FROM contents)")
q("p59_superseded", lambda c: k.split_by_status(views.all_rows(c))[1].select("id", "path"), "SELECT id, path FROM all_rows WHERE status = 'superseded'")
q("p60_needs_attention", lambda c: c.runs.where(k.needs_attention()).select("id", "status"), "SELECT id, status FROM runs WHERE status IN ('failed', 'refused', 'aborted', 'partial')")
_CONFLICTS = f"""(SELECT coalesce(x.run_id, y.run_id) AS run_id, greatest(coalesce(x.raised, 0), coalesce(y.copies, 0)) AS conflicts
FROM (SELECT raised_run_id AS run_id, count(*) AS raised FROM contested_paths GROUP BY 1) x
FULL JOIN (SELECT first_seen_run_id AS run_id, count(*) AS copies FROM all_rows WHERE path LIKE '{PREFIX}%' GROUP BY 1) y ON x.run_id = y.run_id)"""
q("p61_filtered_runs", lambda c: k.filtered_runs(c.runs.withColumn("conflicts", F.lit(0)), True, False, 30).select("id", "status"), "SELECT id, status FROM runs WHERE status IN ('failed', 'refused', 'aborted', 'partial') ORDER BY id DESC LIMIT 30")
q("p62_interesting", lambda c: c.runs.join(a.conflict_counts(c).withColumnRenamed("run_id", "id"), "id", "left").where(k.interesting()).select("id"),
  f"SELECT r.id FROM runs r LEFT JOIN {_CONFLICTS} x ON x.run_id = r.id WHERE NOT coalesce(r.status = 'success' AND coalesce(r.changed_count, r.file_count) = 0, false) OR coalesce(x.conflicts, 0) > 0")
q("p63_candidates", lambda c: k.candidates(c, 1, ["en/src0", "de"], 1600000000000000000 + 20000 * 10**9).select("id", "path", "selector"),
  "SELECT id, path, CASE WHEN path = 'en/src0' OR starts_with(path, 'en/src0/') THEN 'en/src0' ELSE 'de' END AS selector FROM live_rows WHERE volume_id = 1 AND status = 'present' AND (path IN ('en/src0', 'de') OR starts_with(path, 'en/src0/') OR starts_with(path, 'de/')) AND mtime_ns < 1600020000000000000")
q("p64_selectors", lambda c: k.matched_selectors(views.live_rows(c), ["fr/src1", "fr", "."]).select("id", "selector"), "SELECT id, CASE WHEN starts_with(path, 'fr/src1/') THEN 'fr/src1' WHEN starts_with(path, 'fr/') THEN 'fr' ELSE '.' END AS selector FROM live_rows")
q("p66_reserved", lambda c: views.live_rows(c).select("id", p.under_reserved(F.col("path")).alias("offload"), p.reserved_file(F.col("path")).alias("sync"), p.reserved_folder(F.col("path")).alias("folder")),
  f"SELECT id, starts_with(path, '{PREFIX}history/') AS offload, starts_with(path, '{PREFIX}history/') AS sync, starts_with(path, '{PREFIX}history/') AS folder FROM live_rows")
q("p69_valid_paths", lambda c: views.live_rows(c).select("id", p.valid_relative(F.col("path")).alias("ok"), p.valid_folder(p.parent(F.col("path"))).alias("folder_ok")),
  f"SELECT id, NOT starts_with(path, '{PREFIX}history/') AS ok, NOT starts_with(path, '{PREFIX}history/') AS folder_ok FROM live_rows")
q("p70_valid_origins", lambda c: c.contents.join(c.nodes.select(F.col("id").alias("origin_node_id"), F.col("name")), "origin_node_id", "left").select("id", k.valid_origin(F.col("name"), F.col("origin_run_id"), "nobody").alias("ok")),
  "SELECT c.id, coalesce((n.name IS NULL AND origin_run_id IS NULL) OR (n.name IS NOT NULL AND origin_run_id > 0 AND regexp_full_match(n.name, '[A-Za-z0-9][A-Za-z0-9_-]*')), false) AS ok FROM contents c LEFT JOIN nodes n ON n.id = c.origin_node_id")
q("p71_held", lambda c: k.held(views.live_rows(c).where("volume_id = 1").select("path", "size_bytes", "blake3"), c.peer_entries.where("volume_id = 1").select("path", "size_bytes", "blake3")),
  "SELECT l.path, coalesce(e.size_bytes = l.size_bytes AND e.blake3 = l.blake3, false) AS held FROM live_rows l LEFT JOIN peer_entries e ON e.volume_id = 1 AND e.path = l.path WHERE l.volume_id = 1")
q("p72_pairs", lambda c: k.pairs(c, destination="dest2"), "SELECT v.name AS volume, s.target FROM sync_to s JOIN volumes v ON v.id = s.volume_id WHERE s.target = 'dest2'")
q("p73_ordered_targets", k.ordered_targets, "SELECT volume_id, target, min(place) AS place FROM (SELECT volume_id, target, ordinal AS place FROM sync_to UNION ALL SELECT volume_id, target, 1000 + ordinal FROM offload_requires) GROUP BY 1, 2")
q("p74_accepted", k.accepted_destinations, "SELECT volume_id, target FROM sync_to UNION SELECT volume_id, target FROM offload_requires")
q("p76_running", lambda c: k.has_running(c, "sync", 1, "dest1"), "SELECT true AS running FROM runs WHERE kind = 'sync' AND volume_id = 1 AND destination = 'dest1' AND status = 'running' LIMIT 1")
q("p77_latest_sync_id", lambda c: k.latest_sync_id(c, 1, "dest1"), "SELECT coalesce(max(id), 0) AS id FROM (SELECT * FROM runs WHERE volume_id = 1 ORDER BY id DESC LIMIT 20) WHERE kind = 'sync' AND destination = 'dest1'")
q("p82_volumes_syncing", lambda c: k.volumes_syncing_to(c, "dest1"), "SELECT v.name FROM sync_to s JOIN volumes v ON v.id = s.volume_id WHERE s.target = 'dest1'")
q("p83_verifiable", k.verifiable, "SELECT name FROM destinations WHERE type <> 'kopia'")
q("p84_cadences", lambda c: k.verify_cadences(c, 86400 * 10**9), "SELECT name, CAST(coalesce(nullif(verify_every_ns, 0), 86400000000000) AS BIGINT) AS verify_every_ns FROM destinations WHERE type <> 'kopia'")
q("p85_with_stake", k.with_stake, "SELECT id FROM volumes WHERE id IN (SELECT volume_id FROM sync_to UNION SELECT volume_id FROM offload_requires)")
q("p86_effective_shallow", lambda c: c.destinations.select("name", k.effective_shallow(F.lit(False), F.col("encrypted")).alias("shallow")), "SELECT name, encrypted AS shallow FROM destinations")
q("p87_provenance", lambda c: k.prior_provenance(c.contents), "SELECT id, CASE WHEN origin_run_id IS NOT NULL THEN origin_node_id END AS node, CASE WHEN origin_node_id IS NOT NULL THEN origin_run_id END AS run FROM contents")
q("p89_valid_freshness", lambda c: c.push_freshness.join(c.nodes.select(F.col("id").alias("origin_node_id"), "name"), "origin_node_id").select("volume_id", "destination", "name", k.valid_freshness(F.col("name"), F.col("origin_run_id")).alias("ok")),
  "SELECT f.volume_id, f.destination, n.name, regexp_full_match(n.name, '[A-Za-z0-9][A-Za-z0-9_-]*') AND f.origin_run_id > 0 AS ok FROM push_freshness f JOIN nodes n ON n.id = f.origin_node_id")
q("p90_runs_of_kind", lambda c: k.runs_of_kind(c, "audit").select("id"), "SELECT id FROM runs WHERE kind = 'audit'")

# Joins

q("j1_duplicates", lambda c: j.duplicates(c).select("id", "volume", "path", "blake3"), "SELECT r.id, v.name AS volume, r.path, r.blake3 FROM live_rows r JOIN volumes v ON v.id = r.volume_id WHERE r.status = 'present' AND r.content_id IN (SELECT content_id FROM files WHERE status = 'present' GROUP BY 1 HAVING count(*) > 1)")
q("j2_in_sync", j.in_sync_paths, "SELECT r.destination, f.volume_id, count(*) AS n FROM remote_paths r JOIN files f USING (folder_id, name, content_id) WHERE r.state = 'live' AND f.status = 'present' GROUP BY 1, 2")
q("j3_repairs", lambda c: j.repairs(c).select("destination", "folder_id", "name", "content_id"), "SELECT DISTINCT r.destination, r.folder_id, r.name, r.content_id FROM remote_paths r JOIN present_rows f USING (folder_id, name, content_id) WHERE r.state = 'lost' AND NOT EXISTS (SELECT 1 FROM remote_paths h WHERE h.destination = r.destination AND h.folder_id = r.folder_id AND h.name = r.name AND h.content_id = r.content_id AND h.state IN ('committing', 'live'))")
_REMOTE = "(SELECT r.*, f.volume_id, CASE WHEN f.path = '' THEN r.name ELSE concat(f.path, '/', r.name) END AS path, c.size_bytes, c.blake3 FROM remote_paths r JOIN folders f ON f.id = r.folder_id JOIN contents c ON c.id = r.content_id) rp"
q("j4_stored_paths", lambda c: j.stored_paths(c).select("id", "path", "state", "verified_at_ns", "blake3"), f"SELECT id, path, state, verified_at_ns, blake3 FROM {_REMOTE} WHERE state IN ('live', 'displaced')")
q("j5_remote_objects", lambda c: j.remote_objects(c).select("content_id", "destination", "blake3", "checksum"), "SELECT o.content_id, o.destination, c.blake3, o.checksum FROM remote_objects o JOIN contents c ON c.id = o.content_id")
q("j6_remote_packs", lambda c: j.remote_packs(c).select("pack_id", "destination", "pack_key", "size_bytes"), "SELECT r.pack_id, r.destination, p.pack_key, p.size_bytes FROM remote_packs r JOIN packs p ON p.id = r.pack_id")
q("j7_present_on_destination", j.present_on_destination, "SELECT DISTINCT content_id, destination FROM (SELECT content_id, destination FROM remote_objects UNION ALL SELECT m.content_id, r.destination FROM pack_members m JOIN remote_packs r USING (pack_id)) WHERE content_id IN (SELECT id FROM contents)")
q("j8_pending", lambda c: j.pending_fingerprints(c, "dest1"), "SELECT volume_id, count(DISTINCT content_id) AS pending FROM present_rows p WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.content_id = p.content_id AND e.destination = 'dest1' AND checksum IS NOT NULL AND verified_at_ns IS NOT NULL) GROUP BY 1")
q("j9_fingerprinted", j.fingerprinted, "SELECT DISTINCT content_id, destination FROM evidence WHERE checksum IS NOT NULL AND verified_at_ns IS NOT NULL")
q("j10_recorded", j.recorded_destinations, "SELECT destination FROM remote_objects UNION SELECT destination FROM remote_packs UNION SELECT destination FROM remote_paths")
q("j11_volumes_with_paths", j.volumes_with_paths, "SELECT DISTINCT r.destination, f.volume_id FROM remote_paths r JOIN folders f ON f.id = r.folder_id")
for _n, _states in (("j12_live_paths", ("live",)), ("j13_unsettled_paths", ("committing", "displacing")), ("j14_all_paths", ())):
    q(_n, lambda c, x=_states: j.remote_paths(c, *x).select("id", "volume_id", "path", "size_bytes", "state"), f"SELECT id, volume_id, path, size_bytes, state FROM {_REMOTE}" + (f" WHERE state IN ({', '.join(map(repr, _states))})" if _states else ""))
q("j15_peer_states", j.peer_states, "SELECT s.*, n.name FROM peer_sync_state s JOIN nodes n ON n.id = s.peer_node_id")
_MODIFIED = "(SELECT first_seen_run_id AS run_id, count(*) AS modified FROM files f WHERE status = 'present' AND EXISTS (SELECT 1 FROM files o WHERE o.folder_id = f.folder_id AND o.name = f.name AND o.status = 'superseded') GROUP BY 1)"
q("j16_modified", j.modified_by_run, f"SELECT * FROM {_MODIFIED}")
q("j17_split_recorded", lambda c: j.split_recorded(c, "dest1").select("content_id", "recorded"), "SELECT DISTINCT content_id, content_id IN (SELECT content_id FROM remote_objects WHERE destination = 'dest1' UNION ALL SELECT m.content_id FROM pack_members m JOIN remote_packs r USING (pack_id) WHERE r.destination = 'dest1') AS recorded FROM present_rows")
_TRANSLATE = f"(SELECT a.path, a.content_id, a.size_bytes, CASE WHEN l.content_id = a.content_id THEN 'confirm' ELSE 'write' END AS op FROM all_rows a LEFT JOIN {_REMOTE} ON rp.destination = 'dest1' AND rp.volume_id = 1 AND rp.state = 'live' AND rp.path = a.path LEFT JOIN (SELECT 1) z ON 1 = 1 WHERE a.volume_id = 1 AND a.status = 'present' AND lower(a.path) NOT LIKE '{PREFIX}%' AND coalesce(a.status_changed_run_id, a.first_seen_run_id) > 10)".replace("l.content_id", "rp.content_id")
q("j18_translate", lambda c: j.translate(c, "dest1", 1, 10), f"SELECT * FROM {_TRANSLATE}")
q("j19_add_repairs", lambda c: j.add_repairs(c, "dest1", 1, 10).select("path", "op"),
  f"SELECT path, op FROM {_TRANSLATE} UNION ALL SELECT DISTINCT f.path, 'repair' FROM remote_paths r JOIN present_rows f USING (folder_id, name, content_id) WHERE r.destination = 'dest1' AND f.volume_id = 1 AND r.state = 'lost' AND NOT EXISTS (SELECT 1 FROM remote_paths h WHERE h.destination = r.destination AND h.folder_id = r.folder_id AND h.name = r.name AND h.content_id = r.content_id AND h.state IN ('committing', 'live')) AND f.path NOT IN (SELECT path FROM {_TRANSLATE} zz)")
q("j20_classify_restore", j.classify_restore, "SELECT m.pack_id, count(*) AS n, coalesce(string_agg(c.id::VARCHAR, ',' ORDER BY m.offset_bytes NULLS FIRST, c.id) FILTER (WHERE true), '') AS members FROM contents c LEFT JOIN pack_members m ON m.content_id = c.id GROUP BY 1")
q("j22_durability_response", j.durability_response, "SELECT v.volume_id, v.destination, n.name AS node, v.origin_run_id, v.verify_method, CAST(coalesce(d.verify_every_ns, 0) AS BIGINT) AS verify_every_ns FROM vectors v JOIN nodes n ON n.id = v.origin_node_id LEFT JOIN destinations d ON d.name = v.destination")
q("j23_entry_origins", j.entry_origins, "SELECT p.volume_id, p.path, n.name AS origin, o.run FROM present_rows p JOIN origin o USING (volume_id, content_id) LEFT JOIN nodes n ON n.id = o.node")
q("j24_target_kinds", j.target_kinds, "SELECT name, CASE WHEN name IN (SELECT name FROM nodes) THEN 'node' WHEN name IN (SELECT name FROM destinations) THEN 'destination' ELSE 'relayed' END AS kind FROM (SELECT target AS name FROM sync_to UNION SELECT target FROM offload_requires)")
_CAN = "CASE WHEN type = 'kopia' THEN true WHEN layout = 'packed' THEN true WHEN type IN ('sftp', 'local') THEN native ELSE type = 's3' END"
q("j25_target_capability", lambda c: j.target_capability(c, c.vectors.select(F.col("destination").alias("target"), (F.col("source_node_id").isNull()).alias("capable"), F.col("origin_node_id").alias("ordinal"), F.lit("p").alias("peer")).where("target = 'dest3'")),
  f"SELECT r.volume_id, r.target, coalesce(d.can, (SELECT min(source_node_id IS NULL) FROM vectors WHERE destination = r.target AND destination = 'dest3'), true) AS capable FROM offload_requires r LEFT JOIN (SELECT name, {_CAN} AS can FROM destinations) d ON d.name = r.target")
q("j27_run_peers", j.run_peers, "SELECT id, name FROM nodes WHERE id IN (SELECT peer_node_id FROM runs)")
q("j28_orphan_volumes", j.orphan_volumes, "SELECT id, name FROM volumes WHERE id NOT IN (SELECT volume_id FROM sync_to UNION SELECT volume_id FROM offload_requires)")
q("j29_relayed_targets", j.peer_relayed_targets, "SELECT DISTINCT target FROM offload_requires WHERE target NOT IN (SELECT name FROM destinations) AND target NOT IN (SELECT name FROM nodes)")
q("j30_fleet_places", j.fleet_places, "SELECT volume_id, destination AS place FROM vectors UNION SELECT s.volume_id, n.name FROM peer_sync_state s JOIN nodes n ON n.id = s.peer_node_id")
q("j31_self_components", j.self_components, "SELECT * FROM vectors WHERE origin_node_id IN (SELECT id FROM nodes WHERE endpoint IS NULL)")
q("j32_synced_volumes", j.synced_volumes, "SELECT DISTINCT r.destination, v.name FROM runs r JOIN volumes v ON v.id = r.volume_id WHERE r.kind = 'sync' AND r.status = 'success'")
q("j33_contested_details", lambda c: j.contested_details(c, c.peer_entries.select("volume_id", "path", "blake3")), "SELECT volume_id, path, e.blake3, c.live_blake3, c.raised_run_id FROM peer_entries e JOIN contested_paths c USING (volume_id, path)")
q("j35_capabilities", j.destination_capabilities, f"SELECT s.target, d.capable FROM (SELECT DISTINCT target FROM sync_to) s JOIN (SELECT name, {_CAN} AS capable FROM destinations) d ON d.name = s.target")
_OBJ = lambda c: c.remote_objects.select("destination", F.concat(F.lit("o"), F.col("content_id")).alias("name"))
q("j36_scan_back", lambda c: j.scan_back(_OBJ(c), c.listing), "SELECT r.destination, concat('o', r.content_id) AS name, CASE WHEN l.name IS NULL THEN 'absent' WHEN l.sha256 IS NULL THEN 'no-checksum' ELSE 'recorded' END AS outcome FROM remote_objects r LEFT JOIN listing l ON l.destination = r.destination AND l.name = concat('o', r.content_id)")
q("j37_listing_map", lambda c: j.listing_map(c.listing).select("destination", "name", F.col("hashes")["md5"].alias("md5")), "SELECT destination, name, sha256 AS md5 FROM listing")
q("j38_provenance", lambda c: j.provenance(c, j.entry_origins(c).select("path", "origin", F.col("run").alias("origin_run")), 2, 9), "SELECT p.path, coalesce(n.id, 2) AS node, CASE WHEN n.id IS NULL THEN 9 ELSE o.run END AS run FROM present_rows p JOIN origin o USING (volume_id, content_id) LEFT JOIN nodes n ON n.id = o.node")

# Aggregates

q("a1_present_counts", a.present_counts, "SELECT volume_id, count(*) AS files FROM files WHERE status = 'present' GROUP BY 1")
_MISSING = "(SELECT last_seen_run_id AS run_id, count(*) AS missing FROM files WHERE status = 'missing' GROUP BY 1)"
q("a2_missing_by_run", a.missing_by_run, f"SELECT * FROM {_MISSING}")
q("a3_first_seen_by_run", lambda c: a.first_seen_by_run(c, c.runs.where("id <= 20").select(F.col("id").alias("run_id")), "en/"), "SELECT first_seen_run_id AS run_id, count(*) AS files FROM all_rows WHERE path LIKE 'en/%' AND first_seen_run_id IN (SELECT id FROM runs WHERE id <= 20) GROUP BY 1")
q("a5_contested_by_run", a.contested_by_run, "SELECT raised_run_id AS run_id, count(*) AS raised FROM contested_paths GROUP BY 1")
q("a6_conflict_counts", a.conflict_counts, f"SELECT * FROM {_CONFLICTS}")
_BUCKETS = "(SELECT volume_id, node, run, count(*) AS files FROM present_rows JOIN origin USING (volume_id, content_id) GROUP BY 1, 2, 3)"
_KNOWN = f"(SELECT volume_id, node, max(run) AS run FROM (SELECT DISTINCT volume_id, content_id FROM all_rows WHERE lower(path) NOT LIKE '{PREFIX}%') JOIN origin USING (volume_id, content_id) GROUP BY 1, 2)"
_PRESENT_MAX = "(SELECT volume_id, node, max(run) AS run FROM present_rows JOIN origin USING (volume_id, content_id) GROUP BY 1, 2)"
q("a7_files_by_origin", a.files_by_origin, f"SELECT * FROM {_BUCKETS}")
q("a8_known_maxima", a.known_maxima, f"SELECT * FROM {_KNOWN}")
q("a9_present_maxima", a.present_maxima, f"SELECT * FROM {_PRESENT_MAX}")
q("a10_introductions", views.introductions, "SELECT volume_id, content_id, min(first_seen_run_id) AS run FROM files GROUP BY 1, 2")
_PUSH = "(SELECT volume_id, destination, max(id) AS run_id FROM runs WHERE kind = 'sync' AND status = 'success' AND volume_id IS NOT NULL GROUP BY 1, 2)"
q("a11_last_push", a.last_push, f"SELECT * FROM {_PUSH}")
q("a12_recorded_state", a.recorded_state, """SELECT destination, count(*) FILTER (WHERE k = 1) AS objects, count(*) FILTER (WHERE k = 2) AS packs, count(*) FILTER (WHERE k = 3) AS paths, count(*) FILTER (WHERE k = 4) AS components,
count(*) FILTER (WHERE k = 5) AS freshness, count(*) AS total FROM (SELECT destination, 1 AS k FROM remote_objects UNION ALL SELECT destination, 2 FROM remote_packs UNION ALL SELECT destination, 3 FROM remote_paths UNION ALL SELECT destination, 4 FROM vectors UNION ALL SELECT destination, 5 FROM push_freshness) GROUP BY 1""")
q("a14_folder_aggregates", a.folder_aggregates, "SELECT f.folder_id, count(*) AS files, CAST(sum(c.size_bytes) AS BIGINT) AS bytes, sha256(string_agg(concat(f.name, ':', c.blake3), ',' ORDER BY f.name, c.blake3)) AS shallow FROM files f JOIN contents c ON c.id = f.content_id WHERE f.status = 'present' GROUP BY 1")
q("a24_pack_preview", lambda c: a.pack_preview(c.orders.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("size_bytes"), (F.col("o_custkey") % 16).alias("band")), 1_000_000, "o_orderkey", group="band").groupBy("band", "pack").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")),
  """, r AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey % 16 AS band, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT band, i, size, size AS total, 0 AS pack FROM r WHERE i = 1 UNION ALL SELECT r.band, r.i, r.size, CASE WHEN f.total >= 1000000 THEN r.size ELSE f.total + r.size END, CASE WHEN f.total >= 1000000 THEN f.pack + 1 ELSE f.pack END FROM f JOIN r ON r.band = f.band AND r.i = f.i + 1)
SELECT band, CAST(pack AS BIGINT) AS pack, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""")
q("a25_batches", lambda c: a.batches(c.orders.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("size_bytes"), (F.col("o_custkey") % 16).alias("band")), 8, 900_000, "o_orderkey", group="band").groupBy("band", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")),
  """, r AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey % 16 AS band, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT band, i, size, size AS total, 1 AS n, 0 AS batch FROM r WHERE i = 1 UNION ALL SELECT r.band, r.i, r.size, CASE WHEN f.n = 8 OR f.total + r.size > 900000 THEN r.size ELSE f.total + r.size END, CASE WHEN f.n = 8 OR f.total + r.size > 900000 THEN 1 ELSE f.n + 1 END,
CASE WHEN f.n = 8 OR f.total + r.size > 900000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN r ON r.band = f.band AND r.i = f.i + 1) SELECT band, CAST(batch AS BIGINT) AS batch, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1, 2""")
q("a26_planned_uploads", a.planned_uploads, "SELECT volume_id, content_id, min(path) AS path FROM present_rows GROUP BY 1, 2")
q("a27_paths_by_content", a.paths_by_content, "SELECT content_id, string_agg(path, ',' ORDER BY path) AS paths FROM present_rows GROUP BY 1")
q("a29_size_conflicts", lambda c: a.size_conflicts(c.peer_entries.select(F.substring(F.when(F.col("size_bytes") % 2 == 0, F.upper("blake3")).otherwise(F.col("blake3")), 1, 2).alias("blake3"), "size_bytes")), "SELECT substring(blake3, 1, 2) AS blake3, count(DISTINCT size_bytes) AS sizes FROM peer_entries GROUP BY 1 HAVING count(DISTINCT size_bytes) > 1")
q("a31_first_by_digest", a.first_by_digest, "SELECT blake3, arg_min(id, first_seen_run_id * 100000000 + id) AS id FROM all_rows GROUP BY 1")
q("a33_kind_counts", lambda c: a.kind_counts(c.runs), "SELECT kind, count(*) AS n FROM runs GROUP BY 1")
_LOG = lambda c: c.events.select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("seq"), F.floor(F.col("value")).cast("long").alias("bytes"), (F.col("event_id") % 7).alias("transfers"), (F.col("event_id") % 11).alias("errors"), (F.col("event_id") % 97 == 0).alias("fatal"))
q("a34_transfer_stats", lambda c: a.transfer_stats(_LOG(c)), "SELECT user_id % 50 AS run_id, arg_max(CAST(floor(value) AS BIGINT), event_id) AS bytes, arg_max(event_id % 7, event_id) AS transfers, max(event_id % 11) AS errors, bool_or(event_id % 97 = 0) AS fatal FROM events GROUP BY 1")
q("a35_drift_warnings", a.drift_warnings, f"SELECT s.volume_id, s.peer_node_id, r.id AS run_id, coalesce(m.modified, 0) AS modified, coalesce(x.missing, 0) AS missing FROM runs r JOIN peer_sync_state s ON s.volume_id = r.volume_id AND r.started_at_ns > s.last_synced_at_ns LEFT JOIN {_MODIFIED} m ON m.run_id = r.id LEFT JOIN {_MISSING} x ON x.run_id = r.id WHERE r.kind = 'audit' AND coalesce(m.modified, 0) + coalesce(x.missing, 0) > 0")
q("a38_reread_slice", a.reread_slice, f"SELECT destination, id, size_bytes FROM (SELECT destination, id, size_bytes, coalesce(sum(size_bytes) OVER (PARTITION BY destination ORDER BY verified_at_ns NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size_bytes) OVER (PARTITION BY destination) AS t, row_number() OVER (PARTITION BY destination ORDER BY verified_at_ns NULLS FIRST, id) AS r FROM {_REMOTE} WHERE state IN ('live', 'displaced')) WHERE r = 1 OR b * 10 < t")
q("a41_write_preview", lambda c: a.write_preview(j.translate(c, "dest1", 1, 10)), f"SELECT op, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {_TRANSLATE} GROUP BY 1")
q("a42_tree_empty", lambda c: a.tree_empty(c.peer_entries.select("path"), ["en", "de", "fr", "es", "moved"]), f"SELECT count(*) = 0 AS empty FROM peer_entries WHERE path NOT LIKE 'en/%' AND path NOT LIKE 'de/%' AND path NOT LIKE 'fr/%' AND path NOT LIKE 'es/%' AND path NOT LIKE 'moved/%' AND NOT starts_with(regexp_extract(path, '[^/]*$'), '._') AND NOT starts_with(regexp_extract(path, '[^/]*$'), '{PREFIX}')")
q("a44_capture_algorithms", a.capture_algorithms, "SELECT destination, 'md5,sha256' AS algorithms FROM remote_objects GROUP BY 1")

# Ranking

_RANKED = "(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY id DESC) AS rn FROM runs WHERE {where})"
q("w1_latest_successful", lambda c: w.latest_successful(c).select("volume_id", "kind", "id", "status"), "SELECT volume_id, kind, id, status FROM " + _RANKED.format(by="volume_id, kind", where="status IN ('success', 'partial') AND volume_id IS NOT NULL") + " WHERE rn = 1")
_FINISHED = _RANKED.format(by="kind, volume_id, destination", where="status IN ('success', 'partial', 'failed', 'refused') AND volume_id IS NOT NULL")
q("w2_latest_finished", lambda c: w.latest_finished(c).select("kind", "volume_id", "destination", "id", "status"), f"SELECT kind, volume_id, destination, id, status FROM {_FINISHED} WHERE rn = 1")
q("w3_latest_sync", lambda c: w.latest_sync(c).select("volume_id", "destination", "id"), f"SELECT volume_id, destination, run_id AS id FROM {_PUSH}")
q("w4_latest_index", lambda c: w.latest_index(c).select("volume_id", "id"), "SELECT volume_id, max(id) AS id FROM runs WHERE kind = 'index' AND status IN ('success', 'partial') AND volume_id IS NOT NULL GROUP BY 1")
q("w5_latest_hook", lambda c: w.latest_hook(c).select("volume_id", "trigger", "id", "status"), "SELECT volume_id, \"trigger\", id, status FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, \"trigger\" ORDER BY started_at_ns DESC, id DESC) AS rn FROM hook_runs) WHERE rn = 1")
q("w6_folded_runs", w.folded_runs, """, n AS (SELECT volume_id, id, coalesce(status = 'success' AND coalesce(changed_count, file_count) = 0, false) AS quiet FROM runs WHERE volume_id IS NOT NULL),
b AS (SELECT *, CASE WHEN NOT quiet OR NOT coalesce(lag(quiet) OVER (PARTITION BY volume_id ORDER BY id DESC), false) THEN 1 ELSE 0 END AS s FROM n),
i AS (SELECT *, sum(s) OVER (PARTITION BY volume_id ORDER BY id DESC) AS island FROM b) SELECT volume_id, max(id) AS id, count(*) AS runs, count(*) > 1 AS folded FROM i GROUP BY volume_id, island""")
q("w7_dashboard", lambda c: w.dashboard(c).select("id", "status"), ", n AS (SELECT * FROM runs ORDER BY id DESC LIMIT 200) SELECT id, status FROM n WHERE status = 'running' UNION ALL (SELECT id, status FROM n WHERE status <> 'running' ORDER BY id DESC LIMIT 10)")
q("w8_active", lambda c: w.active(c).select("id"), "SELECT id FROM (SELECT * FROM runs ORDER BY id DESC LIMIT 50) WHERE status = 'running'")
q("w9_volume_activity", w.volume_activity, "SELECT volume_id, bool_or(status = 'running') AS running FROM " + _RANKED.format(by="volume_id", where="volume_id IS NOT NULL") + " WHERE rn <= 10 GROUP BY 1")
_ROLLUP = "(SELECT d.volume_id, d.path, count(r.id) AS file_count, CAST(coalesce(sum(r.size_bytes), 0) AS BIGINT) AS cumulative_size FROM folders d LEFT JOIN live_rows r ON r.volume_id = d.volume_id AND r.status = 'present' AND (d.path = '' OR starts_with(r.path, concat(d.path, '/'))) GROUP BY 1, 2)"
q("w10_entries", lambda c: w.sorted_entries(c, 1, "en").select("name", "size_bytes", "kind"), f"SELECT substring(path, 4) AS name, cumulative_size AS size_bytes, 0 AS kind FROM {_ROLLUP} WHERE volume_id = 1 AND path LIKE 'en/%' UNION ALL SELECT name, size_bytes, 1 FROM live_rows WHERE volume_id = 1 AND status = 'present' AND path = concat('en/', name)")
q("w11_listing", lambda c: w.sorted_entries(c, 2, "", False).select("name", "kind"), "SELECT path AS name, 0 AS kind FROM folders WHERE volume_id = 2 AND path <> '' AND path NOT LIKE '%/%' UNION ALL SELECT name, 1 FROM live_rows WHERE volume_id = 2 AND status = 'present' AND path = name")
q("w14_pack_groups", w.pack_groups, "SELECT p.pack_key, string_agg(m.content_id::VARCHAR, ',' ORDER BY m.offset_bytes, m.content_id) AS members FROM pack_members m JOIN packs p ON p.id = m.pack_id GROUP BY 1")
q("w15_gathered_runs", lambda c: w.gathered_runs(c, 1, 20, False, True).select("id", "conflicts"), f"SELECT r.id, coalesce(x.conflicts, 0) AS conflicts FROM runs r LEFT JOIN {_CONFLICTS} x ON x.run_id = r.id WHERE r.volume_id = 1 AND (NOT coalesce(r.status = 'success' AND coalesce(r.changed_count, r.file_count) = 0, false) OR coalesce(x.conflicts, 0) > 0) ORDER BY r.id DESC LIMIT 20")
q("w16_routed", lambda c: w.routed(c, 2000).select("content_id", "route"), "SELECT DISTINCT content_id, CASE WHEN size_bytes >= 2000 THEN 'large' WHEN content_id IN (SELECT content_id FROM pack_members) THEN 'packed' ELSE 'small' END AS route FROM present_rows")
q("w17_chosen_checksum", lambda c: c.remote_objects.select("content_id", "destination", w.chosen_checksum(F.create_map(F.lit("crc"), F.lit("z"), F.lit("sha256"), F.coalesce("checksum", F.lit("")))).alias("h")).select("content_id", "destination", "h.algo", "h.value"),
  "SELECT content_id, destination, CASE WHEN checksum IS NOT NULL THEN 'sha256' ELSE 'crc' END AS algo, coalesce(checksum, 'z') AS value FROM remote_objects")

# Trees

_CLOSURE = "(SELECT DISTINCT volume_id, path FROM folder_paths)"
q("h6_needed_folders", lambda c: tree.needed_folders(views.all_rows(c)), f"SELECT * FROM {_CLOSURE}")
q("h8_folder_ids", lambda c: tree.with_folder_ids(tree.needed_folders(views.all_rows(c))), "SELECT * FROM folders")
q("h3_rollup", tree.rollup, f"SELECT * FROM {_ROLLUP}")
_URL = lambda c: c.pages.select(F.lit(1).alias("volume_id"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
q("h7_url_folders", lambda c: tree.needed_folders(_URL(c)), """, u AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), s AS (SELECT string_split(path, '/') AS x FROM u)
SELECT DISTINCT 1 AS volume_id, array_to_string(x[1:i], '/') AS path FROM s, range(0, 64) t(i) WHERE i < len(x)""")
q("h9_split_paths", lambda c: views.all_rows(c).select("id", p.parent(F.col("path")).alias("folder"), p.last_segment(F.col("path")).alias("leaf"), p.first_segments(F.col("path"), F.lit(1)).alias("top"), F.array_join(p.ancestors(F.col("path")), "|").alias("above")),
  "SELECT a.id, f.path AS folder, a.name AS leaf, split_part(a.path, '/', 1) AS top, CASE WHEN f.path = '' THEN '' ELSE concat(split_part(a.path, '/', 1), '|', f.path) END AS above FROM all_rows a JOIN folders f ON f.id = a.folder_id")
_HASHES = """, sh AS (SELECT d.volume_id, d.path, sha256(concat('folder:shallow:', coalesce(string_agg(concat(length(r.name), ':', r.name, r.blake3), '' ORDER BY r.name, r.blake3) FILTER (WHERE r.name IS NOT NULL), ''))) AS shallow
FROM folders d LEFT JOIN live_rows r ON r.folder_id = d.id AND r.status = 'present' GROUP BY 1, 2),
d2 AS (SELECT volume_id, path, shallow, sha256(concat('folder:deep:', shallow)) AS deep FROM sh WHERE path LIKE '%/%'),
d1 AS (SELECT s.volume_id, s.path, any_value(s.shallow) AS shallow, sha256(concat('folder:deep:', any_value(s.shallow), coalesce(string_agg(concat(length(split_part(k.path, '/', 2)), ':', split_part(k.path, '/', 2), k.deep), '' ORDER BY split_part(k.path, '/', 2)) FILTER (WHERE k.path IS NOT NULL), ''))) AS deep
FROM sh s LEFT JOIN d2 k ON k.volume_id = s.volume_id AND split_part(k.path, '/', 1) = s.path WHERE s.path <> '' AND s.path NOT LIKE '%/%' GROUP BY 1, 2),
d0 AS (SELECT s.volume_id, s.path, any_value(s.shallow) AS shallow, sha256(concat('folder:deep:', any_value(s.shallow), coalesce(string_agg(concat(length(k.path), ':', k.path, k.deep), '' ORDER BY k.path) FILTER (WHERE k.path IS NOT NULL), ''))) AS deep
FROM sh s LEFT JOIN d1 k ON k.volume_id = s.volume_id WHERE s.path = '' GROUP BY 1, 2),
hashes AS (SELECT * FROM d2 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d0) """
q("h1_folder_hashes", tree.folder_hashes, _HASHES + "SELECT * FROM hashes -- folders live_rows")
q("h3_touched_closure", lambda c: tree.touched_closure(c.folders.where("id % 3 = 0").select("volume_id", "path")), "SELECT DISTINCT d.volume_id, a.path, CASE WHEN a.path = '' THEN 0 ELSE len(string_split(a.path, '/')) END AS depth FROM folders d JOIN folders a ON a.volume_id = d.volume_id AND (a.path = '' OR a.path = d.path OR starts_with(d.path, concat(a.path, '/'))) WHERE d.id % 3 = 0")
q("d12_descendants", lambda c: tree.descendants(c, 1, "en").select("path"), "SELECT path FROM folders WHERE volume_id = 1 AND path LIKE 'en/%'")
q("h13_folder_digests", lambda c: tree.folder_digests(tree.folder_hashes(c)).select("volume_id", "path", "children"), _HASHES + "SELECT h.volume_id, h.path, coalesce(string_agg(concat(regexp_extract(k.path, '[^/]*$'), ':', k.deep), ',' ORDER BY regexp_extract(k.path, '[^/]*$')) FILTER (WHERE k.path IS NOT NULL), '') AS children FROM hashes h LEFT JOIN hashes k ON k.volume_id = h.volume_id AND k.path <> '' AND h.path = regexp_replace(k.path, '/?[^/]*$', '') GROUP BY 1, 2 -- folders live_rows")

# Diffs

_ENTRIES = lambda c: c.peer_entries.select("volume_id", "path", "blake3", "size_bytes", "mtime_ns")
q("d1_vanished", lambda c: d.vanished(c, _ENTRIES(c)).select("id", "path"), "SELECT l.id, l.path FROM live_rows l WHERE status = 'present' AND NOT EXISTS (SELECT 1 FROM peer_entries e WHERE e.volume_id = l.volume_id AND e.path = l.path)")
q("s5_scan_changes", lambda c: d.scan_changes(c, _ENTRIES(c)), "SELECT e.volume_id, e.path, CASE WHEN l.id IS NULL THEN 'added' WHEN l.blake3 <> e.blake3 THEN 'modified' WHEN l.status <> 'present' THEN 'restored' ELSE 'unchanged' END AS kind, coalesce(l.status = 'present' AND l.size_bytes = e.size_bytes AND l.mtime_ns = e.mtime_ns, false) AS quick FROM peer_entries e LEFT JOIN live_rows l USING (volume_id, path)")


def _reconciled(c) -> DataFrame:
    contents = c.contents.select(F.col("id").alias("content_id"), F.col("blake3").alias("want"))
    recorded = c.remote_objects.join(contents, "content_id", "left").select("destination", F.concat(F.lit("o"), F.col("content_id")).alias("name"), "want", F.col("checksum_algo").alias("algo"), "checksum")
    listed = c.listing.select("destination", "name", F.lit("").alias("named"), F.col("sha256").alias("checksum"), "unchecked")
    return d.reconcile(recorded, listed)


_RECONCILED = """(SELECT coalesce(r.destination, l.destination) AS destination, coalesce(concat('o', CAST(r.content_id AS VARCHAR)), l.name) AS name, CASE WHEN r.destination IS NULL THEN 'unrecorded' WHEN l.name IS NULL THEN 'missing'
WHEN l.unchecked THEN CASE WHEN r.checksum_algo IS NULL THEN 'pending' ELSE 'unchecked' END WHEN r.checksum_algo IS NULL THEN 'populate' WHEN r.checksum = l.sha256 THEN 'verified' ELSE 'mismatched' END AS outcome
FROM remote_objects r FULL JOIN listing l ON l.destination = r.destination AND l.name = concat('o', CAST(r.content_id AS VARCHAR)))""".replace("coalesce(concat('o', CAST(r.content_id AS VARCHAR)), l.name)", "CASE WHEN r.destination IS NULL THEN l.name ELSE concat('o', CAST(r.content_id AS VARCHAR)) END")
q("d2_reconcile", _reconciled, f"SELECT * FROM {_RECONCILED}")
q("a37_report_failures", lambda c: a.report_failures(_reconciled(c)), f"SELECT destination, count(*) FILTER (WHERE outcome IN ('missing', 'mismatched', 'content-mismatch')) AS failures, count(*) FILTER (WHERE outcome = 'unchecked') AS unchecked FROM {_RECONCILED} GROUP BY 1")
q("d3_reconcile_packs", lambda c: d.reconcile(c.remote_packs.join(c.packs.select(F.col("id").alias("pack_id"), "pack_key"), "pack_id").select("destination", F.col("pack_key").alias("name"), F.lit("w").alias("want"), F.col("checksum_algo").alias("algo"), "checksum"), c.remote_packs.where("pack_id % 6 <> 0").select("destination", F.concat(F.lit("pack"), F.col("pack_id")).alias("name"), F.when(F.col("pack_id") % 11 == 0, "v").otherwise("").alias("named"), F.concat(F.lit("p"), F.col("pack_id")).alias("checksum"), F.lit(False).alias("unchecked"))),
  "SELECT destination, concat('pack', pack_id) AS name, CASE WHEN pack_id % 6 = 0 THEN 'missing' WHEN pack_id % 11 = 0 THEN 'content-mismatch' WHEN checksum_algo IS NULL THEN 'populate' ELSE 'verified' END AS outcome FROM remote_packs")
_PLAN = f"""(SELECT e.volume_id, e.path, e.blake3, l.blake3 AS live, CASE WHEN l.blake3 = e.blake3 THEN 'already-correct' WHEN c.path IS NOT NULL AND c.live_blake3 IS DISTINCT FROM e.blake3 THEN 'contested'
WHEN l.blake3 IS NULL AND s.path IS NOT NULL THEN 'copy-from-existing' WHEN l.blake3 IS NULL THEN 'transfer' WHEN r.id IS NULL OR r.peer_node_id IS NULL OR r.peer_node_id <> 3 THEN 'conflict'
WHEN w.last_shared_run_id IS NULL THEN 'supersede' WHEN r.correlated_run_id IS NULL OR r.correlated_run_id > w.last_shared_run_id THEN 'conflict' ELSE 'supersede' END AS disposition, s.path AS source,
CASE WHEN r.id IS NULL THEN 'delivery run lookup error' WHEN r.peer_node_id IS NULL THEN 'local write on receiver' WHEN r.peer_node_id <> 3 THEN 'sourced from a different peer' WHEN w.last_shared_run_id IS NULL THEN NULL WHEN r.correlated_run_id IS NULL THEN 'delivery run has no correlated initiator id' WHEN r.correlated_run_id > w.last_shared_run_id THEN 'peer delivery newer than the last shared watermark' END AS why
FROM peer_entries e LEFT JOIN (SELECT * FROM live_rows WHERE status = 'present') l ON l.volume_id = e.volume_id AND l.path = e.path LEFT JOIN contested_paths c ON c.volume_id = e.volume_id AND c.path = e.path
LEFT JOIN (SELECT volume_id, blake3, min(path) AS path FROM live_rows WHERE status = 'present' AND lower(path) NOT LIKE '{PREFIX}%' GROUP BY 1, 2) s ON s.volume_id = e.volume_id AND s.blake3 = e.blake3
LEFT JOIN runs r ON r.id = l.first_seen_run_id LEFT JOIN peer_sync_state w ON w.volume_id = e.volume_id AND w.peer_node_id = 3)"""
_OFFER = lambda c: c.peer_entries.select("volume_id", "path", "blake3")
q("d5_dispositions", lambda c: d.dispositions(c, _OFFER(c), 3), f"SELECT volume_id, path, blake3, live, disposition, CASE WHEN disposition = 'copy-from-existing' THEN source END AS copy_from, CASE WHEN disposition = 'conflict' THEN why END AS reason FROM {_PLAN}")
q("d14_in_scope", lambda c: d.in_scope(d.dispositions(c, _OFFER(c), 3)).select("volume_id", "path"), f"SELECT volume_id, path FROM {_PLAN} WHERE disposition IN ('transfer', 'supersede', 'conflict')")
q("j34_conflict_details", lambda c: j.conflict_details(d.dispositions(c, _OFFER(c), 3)), f"SELECT volume_id, path, blake3, live, why AS reason FROM {_PLAN} WHERE disposition = 'conflict'")
q("a36_already_correct", lambda c: a.already_correct(c, d.dispositions(c, _OFFER(c), 3)), f"SELECT p.volume_id, p.files - coalesce(b.busy, 0) AS correct FROM (SELECT volume_id, count(*) AS files FROM files WHERE status = 'present' GROUP BY 1) p LEFT JOIN (SELECT volume_id, count(*) AS busy FROM {_PLAN} WHERE disposition <> 'already-correct' GROUP BY 1) b USING (volume_id)")
q("p78_materialises", lambda c: d.dispositions(c, _OFFER(c), 3).where(k.materialises(F.col("disposition"))).select("path", "disposition"), f"SELECT path, disposition FROM {_PLAN} WHERE disposition IN ('transfer', 'supersede', 'conflict', 'copy-from-existing')")
q("p79_awaiting_content", lambda c: k.awaiting_content(d.dispositions(c, _OFFER(c), 3).withColumn("landed", F.lit(False)).withColumn("size_bytes", F.lit(1).cast("long"))).select("blake3", F.array_join("paths", ",").alias("paths")), f"SELECT blake3, string_agg(path, ',' ORDER BY path) AS paths FROM {_PLAN} WHERE disposition IN ('transfer', 'supersede', 'conflict') GROUP BY 1")
q("d34_latch_inserts", lambda c: d.latch_inserts(c, d.dispositions(c, _OFFER(c), 3)), f"SELECT volume_id, path, live AS live_blake3 FROM {_PLAN} WHERE disposition IN ('conflict', 'contested') AND (volume_id, path) NOT IN (SELECT volume_id, path FROM contested_paths)")
q("d9_verify_session", lambda c: d.verify_session(views.live_rows(c).where("volume_id = 1").select("path", "blake3"), c.peer_entries.where("volume_id = 1").select("path", "blake3")),
  "SELECT coalesce(l.path, e.path) AS path, CASE WHEN l.path IS NULL THEN 'unexpected' WHEN e.path IS NULL THEN 'missing' WHEN l.blake3 = e.blake3 THEN 'matched' ELSE 'mismatched' END AS outcome FROM (SELECT * FROM live_rows WHERE volume_id = 1) l FULL JOIN (SELECT * FROM peer_entries WHERE volume_id = 1) e ON e.path = l.path")
_TWO = lambda c: (tree.folder_hashes(c), tree.folder_hashes(c).where("volume_id <> 2").withColumn("shallow", F.when(F.length("path") % 4 == 0, "x").otherwise(F.col("shallow"))))
q("d10_merkle_diff", lambda c: d.merkle_diff(*_TWO(c)), _HASHES + f"SELECT volume_id, path, volume_id = 2 AS absent FROM hashes WHERE NOT starts_with(path, '{PREFIX}history') AND (volume_id = 2 OR length(path) % 4 = 0) -- folders live_rows".replace("NOT starts_with(path, '" + PREFIX + "history')", f"path <> '{PREFIX}history' AND NOT starts_with(path, '{PREFIX}history/')"))
q("d11_to_descend", lambda c: d.to_descend(*_TWO(c)), f"SELECT volume_id, path FROM folders WHERE volume_id = 2 AND path <> '{PREFIX}history' AND NOT starts_with(path, '{PREFIX}history/')")
q("d16_entries_of_folders", lambda c: d.entries_of_folders(c, c.folders.where("id % 2 = 0").select("volume_id", "path")), f"SELECT l.volume_id, l.path, l.blake3, l.size_bytes FROM live_rows l WHERE status = 'present' AND NOT starts_with(path, '{PREFIX}') AND folder_id % 2 = 0")
q("d17_retryable", lambda c: d.retryable(views.live_rows(c).select("path"), c.contested_paths.select("path")), "SELECT path FROM live_rows WHERE path NOT IN (SELECT path FROM contested_paths)")
q("d19_hash_divergence", lambda c: d.hash_divergence(tree.folder_hashes(c).withColumn("deep", F.when(F.col("volume_id") == 3, "old").otherwise(F.col("deep"))), tree.folder_hashes(c)), "SELECT volume_id, path, false AS shallow_differs, true AS deep_differs FROM folders WHERE volume_id = 3")
q("x13_folder_audit", lambda c: integrity.folder_audit(tree.folder_hashes(c).withColumn("deep", F.when(F.col("volume_id") == 3, "old").otherwise(F.col("deep"))), tree.folder_hashes(c)), "SELECT volume_id, count(*) AS folders FROM folders WHERE volume_id = 3 GROUP BY 1")
q("d20_fleet_refs", lambda c: d.fleet_refs(k.ordered_targets(c), j.fleet_places(c)), """, o AS (SELECT volume_id, target AS name, CAST(min(place) AS BIGINT) AS place FROM (SELECT volume_id, target, ordinal AS place FROM sync_to UNION ALL SELECT volume_id, target, 1000 + ordinal FROM offload_requires) GROUP BY 1, 2),
e AS (SELECT volume_id, destination AS name FROM vectors UNION SELECT s.volume_id, n.name FROM peer_sync_state s JOIN nodes n ON n.id = s.peer_node_id) SELECT * FROM o UNION ALL SELECT volume_id, name, 1000000 + row_number() OVER (PARTITION BY volume_id ORDER BY name) FROM (SELECT * FROM e EXCEPT SELECT volume_id, name FROM o)""")
q("d22_fold_plan", lambda c: d.fold_plan(_SPELL(c, 2), _SPELL(c, 3), _SPELL(c, 2).union(_SPELL(c, 5)))[0])
q("d29_ancestor_counts", lambda c: d.ancestor_counts(views.live_rows(c)), "SELECT folder, count(*) AS files FROM (SELECT split_part(path, '/', 1) AS folder FROM live_rows WHERE path LIKE '%/%' UNION ALL SELECT f.path FROM live_rows l JOIN folders f ON f.id = l.folder_id WHERE f.path LIKE '%/%') GROUP BY 1")
q("d30_merge_pulled", lambda c: d.merge_pulled(c, c.vectors_history.groupBy("volume_id", "destination", "origin_node_id").agg(F.min("origin_run_id").alias("origin_run_id"), F.max_by("verify_method", "id").alias("verify_method"))),
  """, h AS (SELECT volume_id, destination, origin_node_id, min(origin_run_id) AS origin_run_id FROM vectors_history GROUP BY 1, 2, 3), a AS (SELECT volume_id, target FROM sync_to UNION SELECT volume_id, target FROM offload_requires)
SELECT h.*, CASE WHEN a.target IS NULL THEN 'out-of-scope' WHEN NOT h.origin_run_id > 0 THEN 'invalid' WHEN h.origin_run_id < v.origin_run_id THEN 'rewind' ELSE 'merged' END AS outcome FROM h LEFT JOIN a ON a.volume_id = h.volume_id AND a.target = h.destination LEFT JOIN vectors v ON v.volume_id = h.volume_id AND v.destination = h.destination AND v.origin_node_id = h.origin_node_id""")
q("d31_same_state", lambda c: d.same_state(c.config_drift, c.config_drift, ["path", "pending_keys"]), "SELECT true AS same FROM config_drift")
q("d33_flat_entries", lambda c: d.flat_entries(c).select("volume_id", "path", "blake3"), f"SELECT volume_id, path, blake3 FROM live_rows WHERE status = 'present' AND NOT starts_with(path, '{PREFIX}')")


def _SPELL(c, n: int) -> DataFrame:
    """Paths in three spellings, so that folded names clash."""
    rows = views.live_rows(c).where(F.col("id") % n == 0)
    return rows.select(F.when(F.col("id") % 3 == 0, F.upper("path")).otherwise(F.col("path")).alias("path")).distinct()

# Decisions

_PROOF = "(SELECT DISTINCT content_id, destination FROM evidence WHERE checksum IS NOT NULL AND verified_at_ns IS NOT NULL)"
_CHECKS = f"""(SELECT f.volume_id, f.path, f.content_id, f.size_bytes, q.target, q.ordinal, CASE WHEN v.origin_run_id IS NULL THEN 'no-evidence' WHEN v.origin_run_id < o.run THEN 'behind'
WHEN v.verified_at_ns IS NULL OR v.verified_at_ns < {NOW} - {150 * DAY} THEN 'evidence-stale'
WHEN CASE WHEN p.run_id > 0 THEN p.run_id < coalesce(f.status_changed_run_id, f.first_seen_run_id) ELSE s.origin_run_id IS NULL OR s.origin_run_id < o.run END THEN 'not-pushed'
WHEN NOT coalesce(v.verify_method IN ('peer-blake3', 'kopia-verify') OR (v.verify_method = 'fingerprint-verified' AND (v.source_node_id IS NOT NULL OR d.verify_every_ns > 0 OR e.content_id IS NOT NULL)) OR (v.verify_method = 'presence+size' AND e.content_id IS NOT NULL), false) THEN 'not-verified' END AS failure
FROM live_rows f JOIN origin o USING (volume_id, content_id) JOIN offload_requires q ON q.volume_id = f.volume_id
LEFT JOIN vectors v ON v.volume_id = f.volume_id AND v.destination = q.target AND v.origin_node_id = o.node LEFT JOIN {_PUSH} p ON p.volume_id = f.volume_id AND p.destination = q.target
LEFT JOIN push_freshness s ON s.volume_id = f.volume_id AND s.destination = q.target AND s.origin_node_id = o.node LEFT JOIN {_PROOF} e ON e.content_id = f.content_id AND e.destination = q.target
LEFT JOIN destinations d ON d.name = q.target AND d.type <> 'kopia' WHERE f.status = 'present' AND NOT starts_with(f.path, '{PREFIX}'))"""
_GATE = lambda c: g.checks(c, NOW, 150 * DAY)
q("g1_checks", _GATE, f"SELECT * FROM {_CHECKS}")
_VERDICTS = f"(SELECT volume_id, path, size_bytes, bool_and(failure IS NULL) AS ok, count(failure) AS failures FROM {_CHECKS} GROUP BY 1, 2, 3)"
q("g2_verdicts", lambda c: g.verdicts(_GATE(c)), f"SELECT * FROM {_VERDICTS}")
q("a16_readiness", lambda c: g.readiness(c, NOW, 150 * DAY), f"""SELECT r.volume_id, bool_or(v.path IS NOT NULL) AS applicable, count(*) AS present_files, CAST(sum(r.size_bytes) AS BIGINT) AS present_bytes, count(*) FILTER (WHERE v.ok) AS ready_files, CAST(coalesce(sum(r.size_bytes) FILTER (WHERE v.ok), 0) AS BIGINT) AS ready_bytes
FROM live_rows r LEFT JOIN {_VERDICTS} v ON v.volume_id = r.volume_id AND v.path = r.path WHERE r.status = 'present' AND NOT starts_with(r.path, '{PREFIX}') GROUP BY 1""")
q("a17_requirements", lambda c: g.requirements(_GATE(c)), f"SELECT volume_id, target, ordinal, count(*) FILTER (WHERE failure IS NULL) AS satisfied, count(failure) AS blocked FROM {_CHECKS} GROUP BY 1, 2, 3")
q("a18_blocked_groups", lambda c: g.blocked_groups(_GATE(c)), f"SELECT volume_id, target, ordinal, failure AS kind, count(*) AS files, min(path) AS example FROM {_CHECKS} WHERE failure IS NOT NULL GROUP BY 1, 2, 3, 4")
q("a39_outcomes", lambda c: a.kind_counts(g.verdicts(_GATE(c)), "ok"), f"SELECT ok, count(*) AS n FROM {_VERDICTS} GROUP BY 1")
q("g3_origins", views.origins, "SELECT * FROM origin")
q("g7_advice", lambda c: g.blocked_groups(_GATE(c)).select("volume_id", "target", "kind", g.advice(F.col("kind"), F.lit(False)).alias("advice")), f"SELECT DISTINCT volume_id, target, failure AS kind, 'have the peer that pushes to this target do so, then pull its durability' AS advice FROM {_CHECKS} WHERE failure IS NOT NULL")
q("g8_methods", lambda c: c.vectors.select("volume_id", "destination", "origin_node_id", g.content_verified(F.col("verify_method")).alias("content"), g.known_method(F.col("verify_method")).alias("known"), g.relayed_method(F.col("verify_method"), F.lit(0)).alias("relayed")),
  "SELECT volume_id, destination, origin_node_id, coalesce(verify_method IN ('peer-blake3', 'kopia-verify'), false) AS content, verify_method IS NOT NULL AS known, CASE WHEN verify_method = 'fingerprint-verified' THEN 'presence+size' ELSE verify_method END AS relayed FROM vectors")
q("g11_valid_components", lambda c: j.durability_response(c).select("volume_id", "destination", "node", g.valid_component(F.col("node"), F.col("origin_run_id"), F.col("verify_method")).alias("ok")), "SELECT v.volume_id, v.destination, n.name AS node, regexp_full_match(n.name, '[A-Za-z0-9][A-Za-z0-9_#-]*') AND v.origin_run_id > 0 AS ok FROM vectors v JOIN nodes n ON n.id = v.origin_node_id")
q("g12_can_gate", lambda c: c.destinations.select("name", g.can_gate(F.col("type"), F.col("layout"), F.col("native")).alias("ok")), f"SELECT name, {_CAN} AS ok FROM destinations")
q("g13_cadenced", lambda c: g.cadenced(c, 0), "SELECT name AS target FROM destinations WHERE type <> 'kopia' AND verify_every_ns > 0")
_STANDING = f"""(SELECT f.volume_id, f.destination, f.status, CASE WHEN a.destination IS NOT NULL THEN 'alarm' WHEN f.status <> 'refused' THEN 'none' WHEN p.run_id IS NULL AND contains(coalesce(f.error, ''), '--init') THEN 'needs-bootstrap' ELSE 'refused' END AS standing
FROM {_FINISHED} f LEFT JOIN {_PUSH} p ON p.volume_id = f.volume_id AND p.destination = f.destination LEFT JOIN destination_alarms a ON a.destination = f.destination WHERE f.rn = 1 AND f.kind = 'sync')"""
q("g14_standing", g.standing, f"SELECT * FROM {_STANDING}")
_ACCEPTED = "(SELECT volume_id, target FROM sync_to UNION SELECT volume_id, target FROM offload_requires)"
_AGE = f"(SELECT p.volume_id, p.destination, greatest(0, {NOW} - r.ended_at_ns) AS age_ns FROM {_PUSH} p JOIN runs r ON r.id = p.run_id)"
_GRID = f"""(SELECT a.volume_id, a.target, s.target IS NOT NULL AS sync_target, t.status AS last_outcome, CASE WHEN al.destination IS NOT NULL THEN 'alarm' ELSE coalesce(t.standing, 'none') END AS standing, g.age_ns,
CASE WHEN al.destination IS NOT NULL OR t.standing IN ('alarm', 'refused') THEN 3 WHEN t.standing = 'needs-bootstrap' THEN 2 WHEN t.status = 'failed' THEN 3 WHEN t.status = 'partial' THEN 2 WHEN s.target IS NULL THEN 0 WHEN g.age_ns IS NULL THEN 2 WHEN g.age_ns <= {DAY} THEN 1 WHEN g.age_ns <= {3 * DAY} THEN 2 ELSE 3 END AS level
FROM {_ACCEPTED} a LEFT JOIN {_STANDING} t ON t.volume_id = a.volume_id AND t.destination = a.target LEFT JOIN {_AGE} g ON g.volume_id = a.volume_id AND g.destination = a.target LEFT JOIN sync_to s ON s.volume_id = a.volume_id AND s.target = a.target LEFT JOIN destination_alarms al ON al.destination = a.target)"""
q("g25_target_grid", lambda c: g.target_grid(c, NOW, DAY), f"SELECT * FROM {_GRID}")
_SELF = f"(SELECT x.volume_id, CAST(coalesce(m.run, 0) AS BIGINT) AS run FROM (SELECT DISTINCT volume_id FROM files) x LEFT JOIN {_PRESENT_MAX} m ON m.volume_id = x.volume_id AND m.node = 1)"
q("g20_self_maxima", g.self_maxima, f"SELECT * FROM {_SELF}")
_DUR = f"""(SELECT volume_id, target, required, local_content, covered, stale, CASE WHEN NOT local_content THEN 0 WHEN NOT required THEN CASE WHEN covered AND NOT stale THEN 1 ELSE 0 END WHEN NOT covered OR stale THEN 2 ELSE 1 END AS level FROM (
SELECT a.volume_id, a.target, r.target IS NOT NULL AS required, coalesce(m.run, 0) > 0 AS local_content, coalesce(v.origin_run_id, 0) >= coalesce(m.run, 0) AS covered, v.verified_at_ns IS NULL OR greatest(0, {NOW} - v.verified_at_ns) > {150 * DAY} AS stale
FROM {_ACCEPTED} a LEFT JOIN offload_requires r ON r.volume_id = a.volume_id AND r.target = a.target LEFT JOIN vectors v ON v.volume_id = a.volume_id AND v.destination = a.target AND v.origin_node_id = 1 LEFT JOIN {_SELF} m ON m.volume_id = a.volume_id WHERE r.target IS NOT NULL OR v.origin_node_id IS NOT NULL))"""
q("g19_durability", lambda c: g.durability(c, NOW, 150 * DAY), f"SELECT * FROM {_DUR}")
q("g44_provenance", lambda c: g.provenance(c, c.vectors), "SELECT v.volume_id, v.destination, v.origin_node_id, CASE WHEN v.source_node_id IS NULL THEN 'locally verified' ELSE concat('asserted by peer ', n.name) END AS provenance FROM vectors v LEFT JOIN nodes n ON n.id = v.source_node_id")
_PLACES = f"(SELECT volume_id, target AS name FROM {_ACCEPTED} UNION SELECT volume_id, destination FROM vectors UNION SELECT s.volume_id, n.name FROM peer_sync_state s JOIN nodes n ON n.id = s.peer_node_id)"
_FLEET0 = f"""(SELECT x.volume_id, x.name, s.target IS NOT NULL AS sync_target, r.target IS NOT NULL AS required, v.upd IS NOT NULL AS missing_known, coalesce(v.ahead, false) AS ahead, CAST(CASE WHEN v.upd IS NULL THEN 0 ELSE coalesce(b.lacking, 0) END AS BIGINT) AS missing,
least(g.age_ns, CASE WHEN p.last_synced_at_ns IS NOT NULL THEN greatest(0, {NOW} - p.last_synced_at_ns) END) AS change_ns, CASE WHEN v.ver IS NOT NULL THEN greatest(0, {NOW} - v.ver) END AS verified_ns,
least(g.age_ns, CASE WHEN p.last_synced_at_ns IS NOT NULL THEN greatest(0, {NOW} - p.last_synced_at_ns) END, CASE WHEN v.upd IS NOT NULL THEN greatest(0, {NOW} - v.upd) END) AS as_of_ns
FROM {_PLACES} x LEFT JOIN (SELECT c.volume_id, c.destination, bool_or(c.origin_run_id > coalesce(m.run, 0)) AS ahead, max(updated_at_ns) AS upd, CASE WHEN bool_and(verified_at_ns IS NOT NULL) THEN min(verified_at_ns) END AS ver FROM vectors c LEFT JOIN {_KNOWN} m ON m.volume_id = c.volume_id AND m.node = c.origin_node_id GROUP BY 1, 2) v ON v.volume_id = x.volume_id AND v.destination = x.name
LEFT JOIN (SELECT y.volume_id, y.name, sum(k.files) FILTER (WHERE coalesce(c.origin_run_id, 0) < k.run) AS lacking FROM {_PLACES} y JOIN {_BUCKETS} k ON k.volume_id = y.volume_id LEFT JOIN vectors c ON c.volume_id = y.volume_id AND c.destination = y.name AND c.origin_node_id = k.node GROUP BY 1, 2) b ON b.volume_id = x.volume_id AND b.name = x.name
LEFT JOIN {_AGE} g ON g.volume_id = x.volume_id AND g.destination = x.name LEFT JOIN (SELECT s.volume_id, n.name, s.last_synced_at_ns FROM peer_sync_state s JOIN nodes n ON n.id = s.peer_node_id) p ON p.volume_id = x.volume_id AND p.name = x.name
LEFT JOIN sync_to s ON s.volume_id = x.volume_id AND s.target = x.name LEFT JOIN offload_requires r ON r.volume_id = x.volume_id AND r.target = x.name)"""
_FLEET = f"""(SELECT *, CASE WHEN NOT missing_known AND ahead THEN 'ahead' WHEN NOT missing_known THEN 'unknown' WHEN missing > 0 AND ahead THEN 'diverged' WHEN missing > 0 THEN 'behind' WHEN ahead THEN 'ahead' ELSE 'same' END AS state,
CASE WHEN sync_target THEN as_of_ns IS NULL OR as_of_ns > {3 * DAY} WHEN required THEN as_of_ns IS NULL OR as_of_ns > {150 * DAY} ELSE false END AS stale,
CASE WHEN NOT sync_target AND NOT required THEN 0 WHEN as_of_ns IS NULL THEN 2 WHEN sync_target THEN CASE WHEN as_of_ns <= {DAY} THEN 1 WHEN as_of_ns <= {3 * DAY} THEN 2 ELSE 3 END WHEN as_of_ns > {150 * DAY} THEN 2 ELSE 1 END AS level FROM {_FLEET0})"""
q("g23_fleet", lambda c: g.fleet(c, NOW, DAY, 150 * DAY), f"SELECT * FROM {_FLEET}")
q("g24_status_report", lambda c: g.status_report(c, NOW, DAY, 150 * DAY), f"SELECT volume_id, max(level) AS level, greatest(max(level), 2) AS report_level FROM (SELECT volume_id, level FROM {_GRID} UNION ALL SELECT volume_id, level FROM {_DUR} UNION ALL SELECT volume_id, level FROM {_FLEET}) GROUP BY 1 -- config_drift")
q("g26_push_watermark", lambda c: a.recorded_state(c).select("destination", g.push_watermark(F.lit(True), F.col("objects") > 0, F.col("objects"), F.lit(True)).alias("watermark"), g.fresh_start(F.lit(True), F.col("total") > 0).alias("fresh")), "SELECT destination, count(*) AS watermark, false AS fresh FROM remote_objects GROUP BY 1")
q("g28_settle", lambda c: c.remote_paths.select("id", g.settle_committing(F.col("id") % 2 == 0, F.col("id") % 3 > 0).alias("committing"), g.settle_displacing(F.col("id") % 2 == 0, F.col("id") % 3 > 0).alias("displacing")), "SELECT id, CASE WHEN id % 2 <> 0 AND id % 3 > 0 THEN 'live' ELSE 'lost' END AS committing, CASE WHEN id % 2 = 0 THEN 'displaced' WHEN id % 3 > 0 THEN 'live' ELSE 'lost' END AS displacing FROM remote_paths")
q("g30_run_status", lambda c: a.transfer_stats(_LOG(c)).select("run_id", g.run_status(F.col("fatal"), F.col("errors")).alias("status")), "SELECT user_id % 50 AS run_id, CASE WHEN bool_or(event_id % 97 = 0) THEN 'failed' WHEN max(event_id % 11) > 0 THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY 1")
q("g34_etags", lambda c: c.remote_packs.select("pack_id", g.etag_flavour(F.coalesce("checksum", F.lit("a-2"))).alias("flavour"), d.hash_type(g.etag_flavour(F.coalesce("checksum", F.lit("a-2")))).alias("slot")), "SELECT pack_id, CASE WHEN checksum IS NULL THEN 'etag-composite' ELSE 'etag-md5' END AS flavour, 'md5' AS slot FROM remote_packs")
q("g35_alarm_action", lambda c: a.report_failures(_reconciled(c)).select("destination", g.alarm_action(F.col("failures"), F.lit(False)).alias("action")), f"SELECT destination, CASE WHEN count(*) FILTER (WHERE outcome IN ('missing', 'mismatched', 'content-mismatch')) > 0 THEN 'raise' ELSE 'clear' END AS action FROM {_RECONCILED} GROUP BY 1")
q("g36_advance_method", lambda c: j.pending_fingerprints(c, "dest1").select("volume_id", g.advance_method(F.col("pending"), F.lit(False)).alias("plain"), g.advance_method(F.col("pending"), F.lit(True)).alias("packed")), "SELECT volume_id, 'presence+size' AS plain, NULL AS packed FROM present_rows p WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.content_id = p.content_id AND e.destination = 'dest1' AND checksum IS NOT NULL AND verified_at_ns IS NOT NULL) GROUP BY 1")
q("g43_exit_code", lambda c: g.target_grid(c, NOW, DAY).select("volume_id", "target", g.exit_code(F.col("level")).alias("code"), s.traffic_light(F.col("level")).alias("light")), f"SELECT volume_id, target, CASE level WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS code, CASE level WHEN 3 THEN 'red' WHEN 2 THEN 'amber' ELSE 'green' END AS light FROM {_GRID}")
q("g47_downgraded", lambda c: d.dispositions(c, _OFFER(c), 3).select("path", g.downgraded(F.col("disposition"), F.length("path") % 2 == 0).alias("disposition")), f"SELECT path, CASE WHEN disposition = 'supersede' AND length(path) % 2 = 0 THEN 'conflict' ELSE disposition END AS disposition FROM {_PLAN}")

# State transitions

_HISTORY = lambda c: c.conversations.select(F.lit(1).alias("volume_id"), F.concat(F.lit("c"), F.col("conv_id")).alias("path"), F.crc32("role").alias("content_id"), F.col("turn").alias("run_id")).groupBy("volume_id", "path", "run_id").agg(F.max("content_id").alias("content_id"))
_STATE = lambda c: views.all_rows(c).select("volume_id", "path", "content_id", "status", "first_seen_run_id", "last_seen_run_id", "status_changed_run_id")
q("m1_observe_scan", lambda c: m.fold_observations(_STATE(c), c.peer_entries.join(c.contents.select(F.col("id").alias("content_id"), "blake3"), "blake3").select("volume_id", "path", "content_id", F.lit(90).cast("long").alias("run_id"))),
  """, e AS (SELECT p.volume_id, p.path, c.id AS content_id FROM peer_entries p JOIN contents c USING (blake3)) SELECT coalesce(a.volume_id, e.volume_id) AS volume_id, coalesce(a.path, e.path) AS path, coalesce(a.content_id, e.content_id) AS content_id,
CASE WHEN x.content_id IS NULL THEN a.status WHEN x.content_id = coalesce(a.content_id, e.content_id) THEN 'present' ELSE 'superseded' END AS status, coalesce(a.first_seen_run_id, 90) AS first_seen_run_id, CASE WHEN e.content_id IS NOT NULL THEN greatest(coalesce(a.last_seen_run_id, 0), 90) ELSE a.last_seen_run_id END AS last_seen_run_id,
CASE WHEN x.content_id IS NULL THEN a.status_changed_run_id WHEN e.content_id IS NOT NULL AND a.status = 'present' THEN a.status_changed_run_id WHEN e.content_id IS NOT NULL THEN 90 WHEN a.status <> 'superseded' THEN 90 ELSE a.status_changed_run_id END AS status_changed_run_id
FROM all_rows a FULL JOIN e ON e.volume_id = a.volume_id AND e.path = a.path AND e.content_id = a.content_id LEFT JOIN e x ON x.volume_id = coalesce(a.volume_id, e.volume_id) AND x.path = coalesce(a.path, e.path)""")
q("m1_fold_history", lambda c: m.fold_observations(_STATE(c).where("false"), _HISTORY(c)).select("path", "content_id", "status", "first_seen_run_id", "last_seen_run_id"))
q("m6_mark_missing", lambda c: m.mark_missing(c.files, 20).select("id", "status", "last_seen_run_id", "status_changed_run_id"), "SELECT id, CASE WHEN status = 'present' AND last_seen_run_id <> 20 THEN 'missing' ELSE status END AS status, CASE WHEN status = 'present' THEN 20 ELSE last_seen_run_id END AS last_seen_run_id, CASE WHEN status = 'present' AND last_seen_run_id <> 20 THEN 20 ELSE status_changed_run_id END AS status_changed_run_id FROM files")
q("m7_mark_offloaded", lambda c: m.mark_offloaded(_STATE(c), _STATE(c).where("status = 'present' and volume_id = 1"), 77).select("volume_id", "path", "status", "status_changed_run_id"), "SELECT volume_id, path, CASE WHEN status = 'present' AND volume_id = 1 THEN 'offloaded' ELSE status END AS status, CASE WHEN status = 'present' AND volume_id = 1 THEN 77 ELSE status_changed_run_id END AS status_changed_run_id FROM all_rows")
_WRITES = lambda c: c.vectors_history.groupBy("volume_id", "destination", "origin_node_id").agg(F.max_by(F.struct("origin_run_id", F.col("at_ns").alias("updated_at_ns"), "verify_method", "source_node_id", F.col("at_ns").alias("verified_at_ns")), "id").alias("r")).select("volume_id", "destination", "origin_node_id", "r.*")
_W = """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, destination, origin_node_id ORDER BY id DESC) AS rn FROM vectors_history) WHERE rn = 1) """
q("m8_advance_vector", lambda c: m.advance_vector(c.vectors, _WRITES(c))[0], _W + """SELECT coalesce(v.volume_id, h.volume_id) AS volume_id, coalesce(v.destination, h.destination) AS destination, coalesce(v.origin_node_id, h.origin_node_id) AS origin_node_id,
CASE WHEN t THEN h.origin_run_id ELSE v.origin_run_id END AS origin_run_id, CASE WHEN t THEN h.at_ns ELSE v.updated_at_ns END AS updated_at_ns,
CASE WHEN NOT t THEN v.verify_method WHEN v.volume_id IS NULL OR h.verify_method IS NOT NULL THEN h.verify_method WHEN h.origin_run_id > v.origin_run_id THEN NULL ELSE v.verify_method END AS verify_method,
CASE WHEN NOT t THEN v.source_node_id WHEN v.volume_id IS NULL OR h.origin_run_id > v.origin_run_id THEN h.source_node_id WHEN h.verify_method IS NOT NULL AND h.verify_method IS DISTINCT FROM v.verify_method THEN h.source_node_id WHEN h.source_node_id IS NULL AND h.verify_method IS NOT NULL THEN NULL ELSE v.source_node_id END AS source_node_id,
CASE WHEN NOT t THEN v.verified_at_ns WHEN v.volume_id IS NULL OR h.origin_run_id > v.origin_run_id OR h.verify_method IS NOT NULL THEN h.at_ns ELSE v.verified_at_ns END AS verified_at_ns
FROM (SELECT *, volume_id AS vi, destination AS de, origin_node_id AS o FROM vectors) v FULL JOIN h ON h.volume_id = v.vi AND h.destination = v.de AND h.origin_node_id = v.o, LATERAL (SELECT h.volume_id IS NOT NULL AND (v.volume_id IS NULL OR h.origin_run_id >= v.origin_run_id) AS t) z""")
q("m16_rewinds", lambda c: m.advance_vector(c.vectors, _WRITES(c))[1], _W + "SELECT volume_id, destination, origin_node_id, h.origin_run_id FROM h JOIN vectors v USING (volume_id, destination, origin_node_id) WHERE h.origin_run_id < v.origin_run_id")
q("m8_fold_writes", lambda c: m.advance_all(c.vectors, c.vectors_history.select("volume_id", "destination", "origin_node_id", F.col("id").alias("seq"), "origin_run_id", F.col("at_ns").alias("updated_at_ns"), "verify_method", "source_node_id", F.col("at_ns").alias("verified_at_ns"))).select("volume_id", "destination", "origin_node_id", "origin_run_id"),
  "SELECT volume_id, destination, origin_node_id, max(origin_run_id) AS origin_run_id FROM (SELECT volume_id, destination, origin_node_id, origin_run_id FROM vectors UNION ALL SELECT volume_id, destination, origin_node_id, origin_run_id FROM vectors_history) GROUP BY 1, 2, 3")
_NEWF = lambda c: c.vectors.select("volume_id", "destination", "origin_node_id", (F.col("origin_run_id") - 9 + F.col("volume_id") * 2).alias("origin_run_id"))
q("m10_overwrite_freshness", lambda c: m.overwrite_freshness(c.push_freshness, _NEWF(c)), "SELECT volume_id, destination, origin_node_id, origin_run_id - 9 + volume_id * 2 AS origin_run_id FROM vectors")
q("m11_merge_freshness", lambda c: m.merge_freshness(c.push_freshness, _NEWF(c)), "SELECT v.volume_id, v.destination, v.origin_node_id, greatest(v.origin_run_id - 9 + v.volume_id * 2, f.origin_run_id) AS origin_run_id FROM vectors v LEFT JOIN push_freshness f USING (volume_id, destination, origin_node_id)")
q("m12_upgrade", lambda c: m.upgrade_to_fingerprint(c, "dest1", NOW).select("volume_id", "destination", "origin_node_id", "origin_run_id", "verify_method"))
q("m13_demote", lambda c: m.demote_fingerprints(c.vectors, c.vectors.where("destination = 'dest1'")).select("volume_id", "destination", "origin_node_id", "verify_method"), "SELECT volume_id, destination, origin_node_id, CASE WHEN destination = 'dest1' AND verify_method = 'fingerprint-verified' AND source_node_id IS NULL THEN 'presence+size' ELSE verify_method END AS verify_method FROM vectors")
q("m14_revoke", lambda c: m.revoke_source(c.vectors, 2).select("volume_id", "destination", "origin_node_id"), "SELECT volume_id, destination, origin_node_id FROM vectors WHERE source_node_id IS DISTINCT FROM 2")
q("m15_pulled_time", lambda c: c.vectors.select("volume_id", "destination", "origin_node_id", m.pulled_verification(F.coalesce("verified_at_ns", F.lit(0)), 1694030000000000000).alias("verified_at_ns")), "SELECT volume_id, destination, origin_node_id, CASE WHEN verified_at_ns IS NOT NULL THEN least(verified_at_ns, 1694030000000000000) END AS verified_at_ns FROM vectors")
_MARKS = lambda c: c.peer_sync_state.select("volume_id", "peer_node_id", (F.col("volume_id") * 10).alias("last_shared_run_id"), F.lit(NOW).alias("last_synced_at_ns"))
q("m17_watermarks", lambda c: m.advance_watermarks(c.peer_sync_state, _MARKS(c))[0], f"SELECT volume_id, peer_node_id, CASE WHEN coalesce(volume_id * 10 < last_shared_run_id, false) THEN last_shared_run_id ELSE volume_id * 10 END AS last_shared_run_id, CASE WHEN coalesce(volume_id * 10 < last_shared_run_id, false) THEN last_synced_at_ns ELSE {NOW} END AS last_synced_at_ns FROM peer_sync_state")
q("m67_watermark_rewinds", lambda c: m.advance_watermarks(c.peer_sync_state, _MARKS(c))[1], "SELECT volume_id, peer_node_id, volume_id * 10 AS last_shared_run_id FROM peer_sync_state WHERE volume_id * 10 < last_shared_run_id")
for _n, _move, _from in (("m59_confirm", m.CONFIRM, "committing"), ("m60_displace", m.DISPLACE, "live"), ("m61_displaced", m.DISPLACED, "displacing"), ("m62_revert", m.REVERT, "displacing")):
    _stamp = "88" if _move == m.DISPLACE else "NULL" if _move == m.REVERT else "displaced_run_id"
    q(_n, lambda c, x=_move: m.transition(c.remote_paths, c.remote_paths.where(F.col("state") == x[0]).where("id % 2 = 0"), x, 88).select("id", "state", "displaced_run_id"),
      f"SELECT id, CASE WHEN state = '{_from}' AND id % 2 = 0 THEN '{_move[1]}' ELSE state END AS state, CASE WHEN state = '{_from}' AND id % 2 = 0 THEN {_stamp} ELSE displaced_run_id END AS displaced_run_id FROM remote_paths")
q("m63_mark_lost", lambda c: m.mark_lost(c.remote_paths, c.remote_paths.where("id % 5 = 0")).select("id", "state"), "SELECT id, CASE WHEN id % 5 = 0 THEN 'lost' ELSE state END AS state FROM remote_paths")
q("m20_record_verified", lambda c: m.record_verified(c.remote_paths, c.remote_paths.select("id", F.concat(F.lit("c"), F.col("content_id") * 7).alias("checksum")), NOW).select("id", "checksum", "verified_at_ns"), f"SELECT id, CASE WHEN state IN ('live', 'displaced') THEN concat('c', CAST(content_id * 7 AS VARCHAR)) ELSE checksum END AS checksum, CASE WHEN state IN ('live', 'displaced') THEN {NOW} ELSE verified_at_ns END AS verified_at_ns FROM remote_paths")
q("m22_set_fingerprint", lambda c: m.set_fingerprint(c.remote_objects, c.remote_objects.select("content_id", "destination", F.lit("md5").alias("algo"), F.lit("new").alias("value")), ["content_id", "destination"], NOW).select("content_id", "destination", "checksum", "checksum_algo"), "SELECT content_id, destination, coalesce(checksum, 'new') AS checksum, CASE WHEN checksum IS NULL THEN 'md5' ELSE checksum_algo END AS checksum_algo FROM remote_objects")
q("m23_mark_verified", lambda c: m.mark_verified(c.remote_objects, c.remote_objects.where("content_id % 4 = 0"), ["content_id", "destination"], NOW).select("content_id", "destination", "verified_at_ns"), f"SELECT content_id, destination, CASE WHEN content_id % 4 = 0 THEN {NOW} ELSE verified_at_ns END AS verified_at_ns FROM remote_objects")
q("m53_settle", lambda c: m.settle_unfinished(c.remote_paths, c.remote_paths.select("id", (F.col("id") % 2 == 0).alias("staged"), (F.col("id") % 3 > 0).alias("at_path"), (F.col("id") % 4 == 1).alias("in_history"))).select("id", "state"), "SELECT id, CASE state WHEN 'committing' THEN CASE WHEN id % 2 <> 0 AND id % 3 > 0 THEN 'live' ELSE 'lost' END WHEN 'displacing' THEN CASE WHEN id % 4 = 1 THEN 'displaced' WHEN id % 3 > 0 THEN 'live' ELSE 'lost' END ELSE state END AS state FROM remote_paths")
q("m29_finish_runs", lambda c: m.finish_runs(c.runs, c.runs.where("id % 2 = 1").select("id", F.lit("success").alias("status"), F.lit(NOW).alias("ended_at_ns"), F.lit(None).cast("string").alias("error"))).select("id", "status", "ended_at_ns"), f"SELECT id, CASE WHEN status = 'running' AND id % 2 = 1 THEN 'success' ELSE status END AS status, CASE WHEN status = 'running' AND id % 2 = 1 THEN {NOW} ELSE ended_at_ns END AS ended_at_ns FROM runs")
q("m30_abort_running", lambda c: m.abort_running(c.runs, "restart", NOW).select("id", "status", "error"), "SELECT id, CASE WHEN status = 'running' THEN 'aborted' ELSE status END AS status, CASE WHEN status = 'running' THEN 'restart' ELSE error END AS error FROM runs")
_WANTED = lambda c: c.sync_to.select(F.lit("sync").alias("kind"), "volume_id", F.col("target").alias("destination")).unionByName(c.files.select(F.explode(F.array(F.lit("index"), F.lit("offload"))).alias("kind"), "volume_id", F.lit(None).cast("string").alias("destination")).distinct())
q("m31_blockers", lambda c: m.blockers(c.runs, _WANTED(c)), """SELECT w.kind, w.volume_id, w.destination, (SELECT min(r.id) FROM runs r WHERE r.status = 'running' AND r.volume_id = w.volume_id AND (w.kind = 'offload' OR r.kind IN ('index', 'audit', 'offload') OR (w.kind = 'sync' AND r.kind = 'sync' AND r.destination = w.destination))) AS blocked_by
FROM (SELECT 'sync' AS kind, volume_id, target AS destination FROM sync_to UNION ALL SELECT 'index', volume_id, NULL FROM (SELECT DISTINCT volume_id FROM files) UNION ALL SELECT 'offload', volume_id, NULL FROM (SELECT DISTINCT volume_id FROM files)) w""")
q("m36_raise_contested", lambda c: m.raise_latches(c.contested_paths, views.live_rows(c).where("id % 11 = 0").select("volume_id", "path", F.col("blake3").alias("live_blake3"), F.col("first_seen_run_id").alias("raised_run_id"), F.col("indexed_at_ns").alias("raised_at_ns")), ["volume_id", "path"], "raised_at_ns")[0],
  "SELECT volume_id, path, live_blake3, raised_run_id, raised_at_ns FROM contested_paths UNION ALL SELECT volume_id, path, blake3, first_seen_run_id, indexed_at_ns FROM live_rows WHERE id % 11 = 0 AND (volume_id, path) NOT IN (SELECT volume_id, path FROM contested_paths)")
q("m37_clear_contested", lambda c: m.clear_latches(c.contested_paths, c.peer_entries, ["volume_id", "path"]).select("volume_id", "path"), "SELECT volume_id, path FROM contested_paths WHERE (volume_id, path) NOT IN (SELECT volume_id, path FROM peer_entries)")
q("m38_raise_alarms", lambda c: m.raise_latches(c.destination_alarms, c.runs.where("status = 'failed' and destination is not null").select("destination", F.lit("verify").alias("kind"), F.lit("new").alias("detail"), F.col("id").alias("raised_run_id")), ["destination"], "raised_run_id")[1], "SELECT destination, 'verify' AS kind, 'new' AS detail, min(id) AS raised_run_id FROM runs WHERE status = 'failed' AND destination IS NOT NULL AND destination NOT IN (SELECT destination FROM destination_alarms) GROUP BY 1")
q("m40_raise_drift", lambda c: m.raise_drift(c.config_drift, c.config_drift.select("id", "path", F.lit("gamma").alias("pending_keys"), F.lit(NOW).alias("since_ns"))), "SELECT id, path, 'gamma' AS pending_keys, since_ns FROM config_drift")
q("m46_reset", lambda c: m.reset_destination(c, "dest1")["vectors"].select("volume_id", "destination", "origin_node_id"), "SELECT volume_id, destination, origin_node_id FROM vectors WHERE destination <> 'dest1'")
q("m49_new_contents", lambda c: c.peer_entries.select("blake3", "size_bytes").distinct().join(c.contents, "blake3", "left_anti"), "SELECT DISTINCT blake3, size_bytes FROM peer_entries WHERE blake3 NOT IN (SELECT blake3 FROM contents)")
q("m52_unique_names", lambda c: m.unique_names(c.nodes.select("id", F.lit("asia").alias("base")), c.volumes.select("name")), "SELECT id, concat('asia-', CAST(1 + row_number() OVER (ORDER BY id) AS VARCHAR)) AS name FROM nodes")
q("m54_backfill", lambda c: m.backfill_status_changed(c.files).select("id", "status_changed_run_id"), "SELECT id, coalesce(status_changed_run_id, CASE WHEN status = 'present' THEN first_seen_run_id ELSE last_seen_run_id END) AS status_changed_run_id FROM files")
q("m55_relabel", lambda c: m.relabel_method(c.vectors, c.vectors_history, "kopia-verify", "kopia", NOW)[0].groupBy("verify_method").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN verify_method = 'kopia-verify' THEN 'kopia' ELSE verify_method END AS verify_method, count(*) AS n FROM vectors GROUP BY 1")
q("m56_import_runs", m.import_runs, "SELECT v.id AS volume_id, count(f.id) AS file_count FROM volumes v LEFT JOIN files f ON f.volume_id = v.id GROUP BY 1")
q("m70_rekey_folders", lambda c: m.rekey_by_folder(views.all_rows(c).select("id", "volume_id", "path"), c.folders).select("id", "folder_id", "name"), "SELECT id, folder_id, name FROM files")

# Functions

q("f2_ages", lambda c: c.runs.where("ended_at_ns is not null").select("id", s.human_age(s.age_since(F.col("ended_at_ns"), F.lit(NOW))).alias("age"), s.human_duration(s.run_duration(F.col("started_at_ns"), F.col("ended_at_ns"))).alias("took"), s.truncated(F.col("error"), 8).alias("error")),
  f"""SELECT id, CASE WHEN a < 60000000000 THEN concat(a // 1000000000, 's') WHEN a < 3600000000000 THEN concat(a // 60000000000, 'm') WHEN a < {DAY} THEN concat(a // 3600000000000, 'h') ELSE concat(a // {DAY}, 'd') END AS age,
CASE WHEN t < 60 THEN concat(t, 's') WHEN t % 60 = 0 THEN concat(t // 60, 'm') ELSE concat(t // 60, 'm ', t % 60, 's') END AS took, CASE WHEN error IS NULL THEN '' WHEN length(error) <= 8 THEN error ELSE concat(substring(error, 1, 7), '…') END AS error
FROM (SELECT id, error, greatest(0, {NOW} - ended_at_ns) AS a, (ended_at_ns - started_at_ns) // 1000000000 AS t FROM runs WHERE ended_at_ns IS NOT NULL)""")
q("f3_bytes", lambda c: c.contents.select("id", s.human_bytes(F.col("size_bytes")).alias("size")), "SELECT id, CASE WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN concat(printf('%.1f', size_bytes / 1024.0), ' KiB') ELSE concat(printf('%.1f', size_bytes / 1048576.0), ' MiB') END AS size FROM contents")
q("f10_names", lambda c: c.customer.select("c_custkey", s.node_name(F.concat(F.lit("-_"), F.col("c_name"), F.lit(".x"))).alias("node"), s.short_hash(F.col("c_name")).alias("hash"), s.valid_name(F.col("c_name")).alias("valid"), s.nullable(F.lit("")).alias("empty")),
  "SELECT c_custkey, concat(regexp_replace(c_name, '[^A-Za-z0-9_-]', '-', 'g'), '-x') AS node, substring(sha256(c_name), 1, 12) AS hash, regexp_full_match(c_name, '[A-Za-z0-9][A-Za-z0-9_-]*') AS valid, NULL AS empty FROM customer")
q("f12_hex", lambda c: c.contents.select("id", s.hex_short(F.unhex("blake3"), 4).alias("short"), s.hex_or_empty(s.digest_or_null(F.col("blake3"))).alias("back"), s.hex_or_empty(s.digest_or_null(F.lit("zz"))).alias("none")), "SELECT id, substring(blake3, 1, 8) AS short, blake3 AS back, '' AS none FROM contents")
q("f18_keys", lambda c: c.config_drift.select(F.size(s.split_keys(F.col("pending_keys"))).alias("n"), s.join_keys(s.split_keys(F.col("pending_keys"))).alias("again"), F.size(s.split_keys(F.lit(""))).alias("none")), "SELECT 2 AS n, pending_keys AS again, 0 AS none FROM config_drift")
q("f23_run_ids", lambda c: c.runs.select("id", s.run_id_of(F.concat(F.lit("run-"), F.col("id"))).alias("canonical"), s.run_id_of(F.concat(F.lit("run-0"), F.col("id"))).alias("padded"), s.is_snapshot(F.concat(F.lit("index-"), F.col("id"), F.lit(".db"))).alias("snapshot")), "SELECT id, CASE WHEN id > 0 THEN id END AS canonical, CAST(NULL AS BIGINT) AS padded, true AS snapshot FROM runs")
q("f28_markers", lambda c: c.volumes.select("id", s.marker_valid(F.concat(F.lit('{"volume":"'), F.col("name"), F.lit('"}')), F.col("name")).alias("ok"), s.marker_valid(F.lit("{"), F.col("name")).alias("broken")), "SELECT id, true AS ok, false AS broken FROM volumes")
q("f36_labels", lambda c: g.target_grid(c, NOW, DAY).select("volume_id", "target", s.state_label(F.col("standing"), F.coalesce("last_outcome", F.lit("")), F.col("sync_target"), F.col("age_ns"), F.col("level")).alias("state"), s.role_label(F.col("sync_target"), ~F.col("sync_target")).alias("role")),
  f"SELECT volume_id, target, CASE WHEN standing IN ('alarm', 'refused') THEN standing WHEN standing = 'needs-bootstrap' THEN 'needs-init' WHEN last_outcome IN ('failed', 'partial') THEN last_outcome WHEN NOT sync_target THEN '—' WHEN age_ns IS NULL THEN 'never-synced' WHEN level = 2 THEN 'late' WHEN level = 3 THEN 'stalled' ELSE 'ok' END AS state, CASE WHEN sync_target THEN 'sync' ELSE 'offload' END AS role FROM {_GRID}")
q("f37_fleet_labels", lambda c: g.fleet(c, NOW, DAY, 150 * DAY).select("volume_id", "name", s.fleet_label(F.col("stale"), F.col("state")).alias("label")), f"SELECT volume_id, name, CASE WHEN stale THEN 'unknown' ELSE state END AS label FROM {_FLEET}")
q("f35_offload_label", lambda c: g.readiness(c, NOW, 150 * DAY).select("volume_id", s.offload_label(F.col("applicable"), F.lit(0).cast("long"), F.col("ready_files"), F.lit(512).cast("long"), F.col("present_files")).alias("label")).where("label = 'offload: no policy'"), "SELECT DISTINCT volume_id, 'offload: no policy' AS label FROM live_rows WHERE volume_id NOT IN (SELECT volume_id FROM offload_requires)")
q("f45_durable_labels", lambda c: g.durability(c, NOW, 150 * DAY).select("volume_id", "target", s.durable_label(F.lit(True), F.col("local_content"), F.col("covered")).alias("label")), f"SELECT volume_id, target, CASE WHEN NOT local_content THEN 'n/a' WHEN covered THEN 'yes' ELSE 'no' END AS label FROM {_DUR}")
q("f41_rates", lambda c: c.lineitem.select("l_orderkey", "l_linenumber", s.rate(F.col("l_extendedprice"), F.col("l_linenumber") - 1).alias("rate"), s.eta(F.col("l_extendedprice"), F.col("l_linenumber") - 1).alias("eta")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 1 <= 0 THEN 0.0 ELSE l_extendedprice / (l_linenumber - 1) END AS rate, CASE WHEN l_linenumber > 1 THEN l_extendedprice / (l_linenumber - 1) END AS eta FROM lineitem")
q("f43_crumbs", lambda c: c.folders.where("path like '%/%'").select("id", s.crumbs(F.col("path")).alias("x")).select("id", F.size("x").alias("n"), F.element_at("x", 1)["label"].alias("first"), F.element_at("x", -1)["prefix"].alias("last"), F.element_at("x", -1)["active"].alias("active")), "SELECT id, 2 AS n, split_part(path, '/', 1) AS first, path AS last, true AS active FROM folders WHERE path LIKE '%/%'")
q("f44_peer_labels", lambda c: c.runs.join(c.nodes.select(F.col("id").alias("peer_node_id"), "name"), "peer_node_id", "left").select("id", s.peer_label(F.col("name"), F.col("peer_node_id"), F.col("correlated_run_id")).alias("label")), "SELECT r.id, CASE WHEN r.peer_node_id IS NULL THEN '' WHEN r.correlated_run_id IS NULL THEN n.name ELSE concat(n.name, '#', r.correlated_run_id) END AS label FROM runs r LEFT JOIN nodes n ON n.id = r.peer_node_id")
q("f47_fold_keys", lambda c: c.nation.select("n_nationkey", d.fold_key(F.lower("n_name")).alias("key")), "SELECT n_nationkey, upper(n_name) AS key FROM nation")
q("k10_keyed_names", lambda c: c.contents.select("id", sinks.keyed_name("k", "object", F.col("blake3")).alias("name")), "SELECT id, sha256(concat('kobject', chr(0), blake3)) AS name FROM contents")
q("k7_rotated", lambda c: sinks.rotated(c.runs.select(F.concat(F.lit("s"), F.col("id")).alias("name"), F.col("started_at_ns").alias("mtime_ns")), 50), "SELECT name, mtime_ns FROM (SELECT concat('s', id) AS name, started_at_ns AS mtime_ns, row_number() OVER (ORDER BY started_at_ns DESC, concat('s', id) DESC) AS r FROM runs) WHERE r > 50")
q("k4_placements", lambda c: sinks.placements(c.pack_members.select(F.format_string("%08d", "content_id").alias("blake3"), F.col("length_bytes").alias("size_bytes"), F.col("pack_id").alias("pack"))), "SELECT printf('%08d', content_id) AS blake3, pack_id AS pack, offset_bytes AS \"offset\", length_bytes AS length FROM pack_members")
q("s12_replay", lambda c: src.replay(views.all_rows(c).select(F.col("name").alias("path"), "blake3", "status", "size_bytes", "mtime_ns", F.col("id").alias("run_id"))).select("path", "blake3", "run_id"), "SELECT name AS path, arg_max(blake3, id) AS blake3, max(id) AS run_id FROM all_rows WHERE status = 'present' GROUP BY 1")
q("s17_snapshot_names", lambda c: src.snapshot_names(c.runs.select(F.lit("v").alias("volume"), F.concat(F.lit("index-20240101T000000-run-"), F.col("id"), F.lit(".db")).alias("name"))).select("volume", "name", "run_id"), "SELECT 'v' AS volume, concat('index-20240101T000000-run-', id, '.db') AS name, id AS run_id FROM runs")
q("s11_transfer_log", lambda c: src.transfer_log(c.events.select(F.concat(F.lit('{"level":"error","msg":"m"}')).alias("value"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT 'error' AS kind, count(*) AS n FROM events")
q("x7_violations", integrity.violations)
q("x14_negotiated", lambda c: c.nodes.select("id", s.negotiated(F.col("id")).alias("protocol")), "SELECT id, least(greatest(id, 1), 3) AS protocol FROM nodes")

# Schedules and progress

_DONE = f"(SELECT volume_id, destination, coalesce(ended_at_ns, started_at_ns) AS at FROM {_FINISHED} WHERE rn = 1 AND kind = 'sync')"
_DUE = f"(SELECT s.volume_id, s.target FROM sync_to s LEFT JOIN {_DONE} r ON r.volume_id = s.volume_id AND r.destination = s.target WHERE r.at IS NULL OR {LATER} - r.at >= {HOUR})"
_FLIGHT = "(SELECT DISTINCT volume_id, destination AS target FROM runs WHERE kind = 'sync' AND status = 'running' AND volume_id IS NOT NULL)"
# A catalog in which no run of volume 2 is under way.
_QUIET = lambda c: SimpleNamespace(files=c.files, sync_to=c.sync_to, runs=c.runs.where("status <> 'running' or volume_id <> 2"))
_GO = f"(SELECT * FROM {_DUE} WHERE (volume_id, target) NOT IN (SELECT volume_id, target FROM {_FLIGHT} WHERE volume_id <> 2))"
q("t2_due_targets", lambda c: t.due_targets(c, HOUR, LATER), f"SELECT * FROM {_DUE}")
q("t3_due_volumes", lambda c: t.due_volumes(c, HOUR, LATER), f"SELECT f.volume_id FROM (SELECT DISTINCT volume_id FROM files) f LEFT JOIN (SELECT volume_id, coalesce(ended_at_ns, started_at_ns) AS at FROM {_FINISHED} WHERE rn = 1 AND kind = 'index' AND destination IS NULL) r USING (volume_id) WHERE r.at IS NULL OR {LATER} - r.at >= {HOUR}")
q("t6_dispatchable", lambda c: t.dispatchable(_QUIET(c), HOUR, LATER), f"SELECT * FROM {_GO}")
q("t8_due_pulls", lambda c: t.due_pulls(c, HOUR, NOW), f"SELECT volume_id, peer_node_id FROM peer_sync_state WHERE {NOW} - last_synced_at_ns >= {HOUR} AND volume_id IN (SELECT volume_id FROM {_ACCEPTED})")
q("t9_queued", lambda c: t.queued(c.runs.where("kind = 'sync' and volume_id is not null").select(F.col("destination").alias("target"), "volume_id", F.col("id").alias("seq")), t.in_flight(c).select("target")), f"SELECT target, volume_id, row_number() OVER (PARTITION BY target ORDER BY seq) AS place, row_number() OVER (PARTITION BY target ORDER BY seq) = 1 AND target NOT IN (SELECT target FROM {_FLIGHT}) AS starts FROM (SELECT destination AS target, volume_id, min(id) AS seq FROM runs WHERE kind = 'sync' AND volume_id IS NOT NULL GROUP BY 1, 2)")
q("t13_latest_values", lambda c: t.latest_values(_LOG(c)), "SELECT user_id % 50 AS run_id, max(event_id) AS seq, arg_max(CAST(floor(value) AS BIGINT), event_id) AS bytes FROM events GROUP BY 1")
q("t15_with_run", lambda c: t.with_run(_LOG(c).select("run_id", "seq"), c.runs), "SELECT e.user_id % 50 AS run_id, e.event_id AS seq, r.kind, r.status, r.status <> 'running' AS terminal FROM events e JOIN runs r ON r.id = e.user_id % 50")
q("t16_advances", lambda c: t.advances(_LOG(c)).select("run_id", "seq", "bytes"), "SELECT run_id, seq, bytes FROM (SELECT user_id % 50 AS run_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS bytes, max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id % 50 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR bytes > b")
q("t17_stalls", lambda c: t.stalls(c.events.select((F.col("user_id") % 50).alias("run_id"), F.col("ts").cast("timestamp").alias("ts")), "30 minutes").groupBy("run_id").agg(F.count(F.lit(1)).alias("stretches")),
  "SELECT run_id, CAST(sum(s) AS BIGINT) AS stretches FROM (SELECT user_id % 50 AS run_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events) GROUP BY 1")
q("t11_throttled", lambda c: t.throttled(_LOG(c).select("run_id", "seq", F.col("seq").alias("at_ns"), "bytes"), 5, 1 << 60).groupBy("run_id").agg(F.count(F.lit(1)).alias("events")),
  "SELECT run_id, 1 + CAST(ceil((n - 1) / 5.0) AS BIGINT) AS events FROM (SELECT user_id % 50 AS run_id, count(*) AS n FROM events GROUP BY 1)")
q("t21_drift_latch", lambda c: t.drift_latch(c.nation.select(F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey").between(5, 9), "b").otherwise("a").alias("digest"))), "SELECT n_nationkey AS seq, CASE WHEN n_nationkey = 5 THEN 'raise' ELSE 'clear' END AS action FROM nation WHERE n_nationkey IN (5, 10)")
q("t22_scan_tick", lambda c: t.scan_tick(_QUIET(c)), "SELECT DISTINCT volume_id FROM files WHERE volume_id NOT IN (SELECT volume_id FROM runs WHERE status = 'running' AND volume_id <> 2)")
q("t24_tick", lambda c: t.tick(_QUIET(c), HOUR, HOUR, LATER), f"SELECT volume_id, 'sync' AS action, target FROM {_GO} UNION ALL SELECT DISTINCT volume_id, 'pre-sync-index', NULL FROM {_GO} UNION ALL SELECT f.volume_id, 'index', NULL FROM (SELECT DISTINCT volume_id FROM files) f LEFT JOIN (SELECT volume_id, coalesce(ended_at_ns, started_at_ns) AS at FROM {_FINISHED} WHERE rn = 1 AND kind = 'index' AND destination IS NULL) r USING (volume_id) WHERE (r.at IS NULL OR {LATER} - r.at >= {HOUR}) AND f.volume_id NOT IN (SELECT volume_id FROM {_GO})")
q("t25_in_flight", lambda c: t.in_flight(c).where("volume_id is not null"), f"SELECT * FROM {_FLIGHT}")
