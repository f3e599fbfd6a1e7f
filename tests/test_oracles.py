"""A spread of registered queries against their oracles in DuckDB."""

import math

import duckdb
import pytest

from cairn.plans import registry, rules
from cairn.plans.projection import DRIVER

NAMES = ["p2_by_absolute_path", "p12_path_delta", "j3_repairs", "j8_pending", "a8_known_maxima", "a24_pack_preview", "w6_folded_runs", "h1_folder_hashes", "d2_reconcile", "d5_dispositions", "g1_checks", "a16_readiness", "g23_fleet", "m1_observe_scan", "m8_advance_vector", "m8_fold_writes", "t9_queued", "t17_stalls"]
#: Rules with branches that small tables reach as well.
NAMES += ["p5_by_digest", "a29_size_conflicts", "t22_scan_tick", "f30_versions", "f34_evidence_labels", "d23_fold_members", "d24_collisions", "g4_failure_kinds", "g15_sync_levels", "g22_fleet_levels", "m25_pack_fingerprints"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in DRIVER:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    cur = duck.execute(registry.ORACLES[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_rules_are_registered():
    assert {"g15_sync_levels", "m72_rekeyed_imports"} <= set(registry.ORACLES) and rules.VECTOR
