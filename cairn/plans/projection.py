"""The catalog as a projection of the driver's tables, in Spark SQL and in DuckDB SQL.

Each catalog table is one SELECT over driver tables or other catalog tables. The same
text serves both engines, but for four functions that they name differently, so that
operators and oracles start from equal rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The engine's own subtrees: conflict copies, history, staging, packs, markers.
PREFIX = ".cairn-"
SELF = 1


class Spark:
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    nbytes = staticmethod(lambda x: f"cast(octet_length({x}) as bigint)")
    div = staticmethod(lambda a, b: f"({a} div {b})")
    micros = staticmethod(lambda x: f"unix_micros(cast({x} as timestamp))")


class Duck:
    sha = staticmethod(lambda x: f"sha256({x})")
    nbytes = staticmethod(lambda x: f"octet_length(encode({x}))")
    div = staticmethod(lambda a, b: f"({a} // {b})")
    micros = staticmethod(lambda x: f"epoch_us({x})")


def tables(d) -> dict[str, str]:
    """SELECT of every catalog table; names in braces are the tables it reads."""
    return {
        "volumes": """
SELECT cast(r_regionkey + 1 as bigint) AS id, replace(lower(r_name), ' ', '-') AS name, concat('/data/', replace(lower(r_name), ' ', '-')) AS path FROM {region}
UNION ALL
SELECT cast(100 + n_nationkey as bigint), concat('n-', replace(lower(n_name), ' ', '-')), concat('/data/', replace(lower(r_name), ' ', '-'), '/', replace(lower(n_name), ' ', '-'))
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
        "nodes": """
SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey = 1 THEN NULL ELSE concat('https://node', cast(s_suppkey as string)) END AS endpoint FROM {supplier}""",
        "observations": f"""
SELECT min(doc_id) AS id, doc_id % 5 + 1 AS volume_id,
       CASE WHEN doc_id % 29 = 0 THEN concat('{PREFIX}history/', lang) ELSE concat(lang, '/', source) END AS folder,
       concat('f', cast(doc_id % 17 as string), '.txt') AS name, {d.sha("text")} AS blake3, min({d.nbytes("text")}) AS size_bytes
FROM {{documents}} GROUP BY 2, 3, 4, 5""",
        "contents": """
SELECT min(id) AS id, blake3, min(size_bytes) AS size_bytes,
       CASE WHEN min(id) % 3 = 0 THEN NULL ELSE 1 + min(id) % 3 END AS origin_node_id,
       CASE WHEN min(id) % 7 = 0 THEN NULL ELSE 1 + min(id) % 50 END AS origin_run_id
FROM {observations} GROUP BY blake3""",
        "folder_paths": """
SELECT DISTINCT volume_id, folder AS path FROM {observations}
UNION SELECT DISTINCT volume_id, CASE WHEN folder LIKE '%/%' THEN substring(folder, 1, position('/' IN folder) - 1) ELSE folder END FROM {observations}
UNION SELECT DISTINCT volume_id, '' FROM {observations}""",
        "folder_ids": """
SELECT cast(row_number() OVER (ORDER BY length(path), volume_id, path) as bigint) AS id, volume_id, path FROM {folder_paths}""",
        "folders": """
SELECT f.id, f.volume_id, p.id AS parent_id, f.path FROM {folder_ids} f LEFT JOIN {folder_ids} p
ON p.volume_id = f.volume_id AND f.path <> '' AND p.path = CASE WHEN f.path LIKE '%/%' THEN substring(f.path, 1, position('/' IN f.path) - 1) ELSE '' END""",
        "files": """
SELECT o.id, f.id AS folder_id, o.volume_id, o.name, c.id AS content_id,
       CASE WHEN row_number() OVER (PARTITION BY o.volume_id, o.folder, o.name ORDER BY o.id DESC) > 1 THEN 'superseded'
            WHEN o.id % 10 < 2 THEN 'missing' WHEN o.id % 10 = 2 THEN 'offloaded' ELSE 'present' END AS status,
       (1600000000 + o.id * 37) * 1000000000 AS mtime_ns, 1 + o.id % 40 AS first_seen_run_id, 1 + o.id % 40 + o.id % 7 AS last_seen_run_id,
       1700000000000000000 + o.id AS indexed_at_ns, CASE WHEN o.id % 4 = 0 THEN NULL ELSE 1 + o.id % 40 + o.id % 7 END AS status_changed_run_id
FROM {observations} o JOIN {folders} f ON f.volume_id = o.volume_id AND f.path = o.folder JOIN {contents} c ON c.blake3 = o.blake3""",
        "runs": f"""
SELECT event_id AS id, kind, CASE WHEN event_id % 37 = 0 THEN NULL ELSE user_id % 5 + 1 END AS volume_id,
       CASE WHEN kind IN ('sync', 'restore') THEN concat('dest', cast(user_id % 4 as string)) ELSE NULL END AS destination,
       started_at_ns, CASE WHEN status = 'running' THEN NULL ELSE started_at_ns + (event_id % 1000) * 1000000000 END AS ended_at_ns, status,
       CASE WHEN status = 'refused' AND event_id % 2 = 0 THEN 're-run with --init' WHEN status IN ('failed', 'refused') THEN concat('error ', cast(event_id as string)) ELSE NULL END AS error,
       event_id % 50 AS file_count, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS changed_count,
       CASE WHEN kind = 'sync' AND user_id % 4 = 3 THEN 2 + user_id % 3 ELSE NULL END AS peer_node_id,
       CASE WHEN kind = 'sync' AND user_id % 4 = 3 AND event_id % 5 <> 0 THEN event_id % 60 ELSE NULL END AS correlated_run_id,
       kind IN ('index', 'audit') AND event_id % 2 = 0 AS shallow
FROM (SELECT event_id, user_id, {d.micros("ts")} * 1000 AS started_at_ns,
             CASE event_id % 9 WHEN 0 THEN 'index' WHEN 1 THEN 'audit' WHEN 2 THEN 'restore' WHEN 3 THEN 'offload' WHEN 4 THEN 'index' ELSE 'sync' END AS kind,
             CASE WHEN event_id % 20 < 13 THEN 'success' WHEN event_id % 20 < 15 THEN 'partial' WHEN event_id % 20 < 17 THEN 'failed'
                  WHEN event_id % 20 = 17 THEN 'refused' WHEN event_id % 20 = 18 THEN 'aborted' ELSE 'running' END AS status FROM {{events}}) e""",
        "runs_audit": """
SELECT id * 2 AS id, id AS run_id, 'begin' AS transition, started_at_ns AS at_ns FROM {runs}
UNION ALL SELECT id * 2 + 1, id, status, ended_at_ns FROM {runs} WHERE ended_at_ns IS NOT NULL""",
        "hook_runs": """
SELECT id, volume_id, CASE WHEN id % 2 = 0 THEN 'interval' ELSE 'change' END AS trigger, started_at_ns, ended_at_ns,
       CASE WHEN status IN ('success', 'failed', 'running') THEN status ELSE 'timeout' END AS status FROM {runs} WHERE kind = 'index' AND volume_id IS NOT NULL""",
        "remote_objects": """
SELECT l_orderkey AS content_id, concat('dest', cast(l_suppkey % 4 as string)) AS destination, min(l_partkey) AS run_id,
       CASE WHEN min(l_partkey) % 3 = 0 THEN NULL ELSE 'sha256' END AS checksum_algo,
       CASE WHEN min(l_partkey) % 3 = 0 THEN NULL ELSE concat('c', cast(l_orderkey * 7 as string)) END AS checksum,
       CASE WHEN min(l_partkey) % 3 = 0 OR min(l_suppkey) % 5 = 0 THEN NULL ELSE 1690000000000000000 + min(l_partkey) END AS verified_at_ns
FROM {lineitem} WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey, l_suppkey % 4""",
        "packs": f"""
SELECT {d.div("o_orderkey", "8")} AS id, concat('pack', cast({d.div("o_orderkey", "8")} as string)) AS pack_key, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) AS size_bytes
FROM {{orders}} WHERE o_orderkey % 2 = 1 GROUP BY 1, 2""",
        "pack_members": f"""
SELECT o_orderkey AS content_id, {d.div("o_orderkey", "8")} AS pack_id,
       cast(coalesce(sum(cast(floor(o_totalprice) as bigint)) OVER (PARTITION BY {d.div("o_orderkey", "8")} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as bigint) AS offset_bytes,
       cast(floor(o_totalprice) as bigint) AS length_bytes FROM {{orders}} WHERE o_orderkey % 2 = 1""",
        "remote_packs": """
SELECT id AS pack_id, concat('dest', cast(id % 4 as string)) AS destination, CASE WHEN id % 5 = 0 THEN NULL ELSE 'md5' END AS checksum_algo,
       CASE WHEN id % 5 = 0 THEN NULL ELSE concat('p', cast(id as string)) END AS checksum,
       CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE 1690000000000000000 + id END AS verified_at_ns FROM {packs}""",
        "remote_paths": """
SELECT id, folder_id, name, content_id, concat('dest', cast(id % 4 as string)) AS destination, first_seen_run_id AS written_run_id,
       CASE id % 11 WHEN 0 THEN 'committing' WHEN 1 THEN 'displacing' WHEN 2 THEN 'displaced' WHEN 3 THEN 'lost' WHEN 4 THEN 'lost' ELSE 'live' END AS state,
       CASE WHEN id % 11 IN (1, 2) THEN last_seen_run_id ELSE NULL END AS displaced_run_id, mtime_ns,
       CASE WHEN id % 3 = 0 THEN NULL ELSE concat('c', cast(content_id * 7 as string)) END AS checksum,
       CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN NULL ELSE 1690000000000000000 + id * 1000 END AS verified_at_ns FROM {files} WHERE status <> 'superseded'""",
        "vectors": """
SELECT l_linenumber % 5 + 1 AS volume_id, concat('dest', cast(l_suppkey % 4 as string)) AS destination, l_partkey % 4 + 1 AS origin_node_id,
       max(l_orderkey % 60) AS origin_run_id, 1695000000000000000 + max(l_orderkey) * 1000000000 AS updated_at_ns,
       CASE (l_linenumber % 5 + l_suppkey % 4 + l_partkey % 4) % 5 WHEN 0 THEN 'peer-blake3' WHEN 1 THEN 'fingerprint-verified' WHEN 2 THEN 'presence+size' WHEN 3 THEN 'kopia-verify' ELSE NULL END AS verify_method,
       CASE WHEN (l_suppkey % 4 + l_partkey % 4) % 3 = 0 THEN 2 ELSE NULL END AS source_node_id,
       CASE WHEN (l_linenumber % 5 + l_suppkey % 4) % 4 = 0 THEN NULL ELSE 1694000000000000000 + max(l_orderkey) * 1000000000 END AS verified_at_ns
FROM {lineitem} WHERE (l_linenumber + l_suppkey % 4 + l_partkey % 4) % 6 <> 0 GROUP BY l_linenumber % 5, l_suppkey % 4, l_partkey % 4""",
        "vectors_history": """
SELECT (l_orderkey * 10 + l_linenumber) * 10 + l_partkey % 3 * 3 + l_suppkey % 3 AS id, l_linenumber % 5 + 1 AS volume_id, concat('dest', cast(l_suppkey % 4 as string)) AS destination,
       l_partkey % 4 + 1 AS origin_node_id, l_orderkey % 60 AS origin_run_id, 1695000000000000000 + l_orderkey * 1000000000 AS at_ns,
       CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'peer-blake3' ELSE 'presence+size' END AS verify_method,
       CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE NULL END AS source_node_id FROM {lineitem}""",
        "push_freshness": """
SELECT volume_id, destination, origin_node_id, origin_run_id - 5 AS origin_run_id FROM {vectors} WHERE origin_node_id <> 3""",
        "peer_sync_state": """
SELECT v.id AS volume_id, n.id AS peer_node_id, CASE WHEN (v.id + n.id) % 5 = 0 THEN NULL ELSE 20 + v.id * n.id END AS last_shared_run_id,
       1698000000000000000 + v.id * 1000 + n.id AS last_synced_at_ns FROM {volumes} v JOIN {nodes} n ON n.id BETWEEN 2 AND 4 WHERE v.id <= 5""",
        "peer_sync_history": """
SELECT id, volume_id, peer_node_id, correlated_run_id AS last_shared_run_id, started_at_ns AS at_ns FROM {runs} WHERE peer_node_id IS NOT NULL AND volume_id IS NOT NULL""",
        "contested_paths": """
SELECT f.volume_id, CASE WHEN d.path = '' THEN f.name ELSE concat(d.path, '/', f.name) END AS path,
       CASE WHEN f.id % 2 = 0 THEN NULL ELSE c.blake3 END AS live_blake3, f.first_seen_run_id AS raised_run_id, f.indexed_at_ns AS raised_at_ns
FROM {files} f JOIN {folders} d ON d.id = f.folder_id JOIN {contents} c ON c.id = f.content_id WHERE f.status <> 'superseded' AND f.id % 13 = 0""",
        "destination_alarms": """
SELECT destination, 'verify' AS kind, concat('findings in run ', cast(max(id) as string)) AS detail, max(id) AS raised_run_id
FROM {runs} WHERE status = 'failed' AND destination IN ('dest1', 'dest2') GROUP BY destination""",
        "config_drift": """
SELECT 1 AS id, '/etc/engine.toml' AS path, 'alpha,beta' AS pending_keys, min(started_at_ns) AS since_ns FROM {runs}""",
        # The configuration: targets a volume pushes to, targets its offload policy requires, destinations.
        "sync_to": """
SELECT v.id AS volume_id, t.ordinal, concat('dest', cast((v.id + t.ordinal) % 4 as string)) AS target
FROM {volumes} v JOIN (SELECT 0 AS ordinal UNION ALL SELECT 1) t ON 1 = 1 WHERE v.id <= 5""",
        "offload_requires": """
SELECT v.id AS volume_id, t.ordinal, concat('dest', cast((v.id * 2 + t.ordinal) % 4 as string)) AS target
FROM {volumes} v JOIN (SELECT 0 AS ordinal UNION ALL SELECT 1) t ON 1 = 1 WHERE v.id <= 4""",
        "destinations": """
SELECT 'dest0' AS name, 's3' AS type, 'mirror' AS layout, false AS native, false AS encrypted, 3600000000000 AS verify_every_ns
UNION ALL SELECT 'dest1', 'sftp', 'mirror', true, false, 0 UNION ALL SELECT 'dest2', 'local', 'packed', true, true, 7200000000000
UNION ALL SELECT 'kopia', 'kopia', 'mirror', false, false, 0""",
        # A second index of the same volumes, with changed, moved and dropped rows.
        "peer_entries": """
SELECT f.volume_id, CASE WHEN f.id % 6 = 0 THEN concat('moved/', f.name, cast(f.id as string)) WHEN d.path = '' THEN f.name ELSE concat(d.path, '/', f.name) END AS path,
       CASE WHEN f.id % 7 = 0 THEN concat('00', substring(c.blake3, 3, 62)) ELSE c.blake3 END AS blake3, c.size_bytes, f.mtime_ns
FROM {files} f JOIN {folders} d ON d.id = f.folder_id JOIN {contents} c ON c.id = f.content_id WHERE f.status <> 'superseded' AND f.id % 9 <> 0""",
        # What a remote listing says of the recorded objects.
        "listing": """
SELECT destination, concat('o', cast(content_id as string)) AS name, CASE WHEN content_id % 10 = 4 THEN 'other' ELSE concat('c', cast(content_id * 7 as string)) END AS sha256,
       content_id % 14 = 0 AS unchecked FROM {remote_objects} WHERE content_id % 8 <> 0
UNION ALL SELECT destination, concat('x', cast(content_id as string)), 'stray', false FROM {remote_objects} WHERE content_id % 40 = 0""",
    }


DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """Catalog tables as DataFrames; an attribute is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    @cached_property
    def _sql(self) -> dict[str, str]:
        return tables(Spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in DRIVER:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = self._sql[name]
                deps = {x: getattr(self, x) for x in dict.fromkeys(re.findall(r"\{(\w+)\}", text))}
                self._built[name] = self.spark.sql(text, **deps)
        return self._built[name]


def duck(sql: str) -> str:
    """An oracle over catalog tables as one DuckDB statement: the tables it names come first."""
    text = tables(Duck)
    need: list[str] = []

    def add(name: str) -> None:
        if name in need or name not in text:
            return
        for dep in re.findall(r"\{(\w+)\}", text[name]):
            add(dep)
        need.append(name)

    extra = VIEWS
    names = [x for x in re.findall(r"\b(\w+)\b", sql)]

    def add_view(name: str) -> None:
        for x in re.findall(r"\b(\w+)\b", extra[name]):
            (add_view(x) if x in extra and x != name else add(x))
        if name not in need:
            need.append(name)

    for x in names:
        if x in extra:
            add_view(x)
        elif x not in DRIVER:
            add(x)
    if sql.startswith(","):  # the oracle goes on with tables of its own
        need = need or [add("volumes") or "volumes"]
    parts = [f"{x} AS ({(text[x].replace('{', '').replace('}', '') if x in text else extra[x]).strip()})" for x in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql


_HIDDEN = " AND ".join(f"lower(path) NOT LIKE '{PREFIX}{x}/%'" for x in ("conflicts", "history", "staging", "packs", "index"))
#: Views that many oracles share.
VIEWS = {
    "all_rows": """
SELECT f.id, f.volume_id, f.folder_id, f.name, CASE WHEN d.path = '' THEN f.name ELSE concat(d.path, '/', f.name) END AS path, f.content_id, c.blake3, c.size_bytes, f.mtime_ns, f.status,
       f.first_seen_run_id, f.last_seen_run_id, f.indexed_at_ns, c.origin_node_id, c.origin_run_id, f.status_changed_run_id
FROM files f JOIN folders d ON d.id = f.folder_id JOIN contents c ON c.id = f.content_id""",
    "live_rows": "SELECT * FROM all_rows WHERE status <> 'superseded'",
    "present_rows": f"SELECT * FROM live_rows WHERE status = 'present' AND {_HIDDEN}",
    "origin": f"""
SELECT volume_id, content_id, CASE WHEN min(origin_node_id) IS NOT NULL AND min(origin_run_id) IS NOT NULL THEN min(origin_node_id) ELSE {SELF} END AS node,
       CASE WHEN min(origin_node_id) IS NOT NULL AND min(origin_run_id) IS NOT NULL THEN min(origin_run_id) ELSE min(first_seen_run_id) END AS run
FROM all_rows GROUP BY volume_id, content_id""",
    "evidence": """
SELECT content_id, destination, checksum, verified_at_ns, 'object' AS layout FROM remote_objects
UNION ALL SELECT m.content_id, p.destination, p.checksum, p.verified_at_ns, 'pack' FROM pack_members m JOIN remote_packs p ON p.pack_id = m.pack_id
UNION ALL SELECT content_id, destination, checksum, verified_at_ns, 'path' FROM remote_paths WHERE state IN ('live', 'displaced')""",
}
