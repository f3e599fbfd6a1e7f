"""Pinned semantics on small literal tables."""

import hashlib
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.functions import scalars as s
from cairn.operators import aggregates, diffs, lookups, mutations
from cairn.operators import gate as g
from cairn.sources import files, sinks, trees
from cairn.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_observations_fold_like_a_plain_fold(spark):
    """M1: touch, revive and supersede against a row-by-row fold of random histories."""
    rnd, events, state = random.Random(5), [], {}
    for path in "abcdef":
        live = None
        for run in range(1, 12):
            if rnd.random() < 0.7:
                x = rnd.randint(1, 3)
                events.append((1, path, x, run))
                row = state.setdefault((path, x), {"first": run, "changed": None, "status": None})
                if live != x:
                    if live is not None:
                        state[path, live].update(status="superseded", changed=run)
                    row.update(status="present", changed=run)
                    live = x
                row["last"] = run
    empty = spark.createDataFrame([], "volume_id long, path string, content_id long, status string, first_seen_run_id long, last_seen_run_id long, status_changed_run_id long")
    got = mutations.fold_observations(empty, spark.createDataFrame(events, "volume_id long, path string, content_id long, run_id long"))
    want = sorted((1, k[0], k[1], v["status"], v["first"], v["last"], v["changed"]) for k, v in state.items())
    assert sorted(map(tuple, got.collect())) == want


def test_vector_provenance(spark):
    """M8: local 10, peer 10, peer 20, local 20 give the sources null, null, peer, null."""
    schema = "volume_id long, destination string, origin_node_id long, origin_run_id long, updated_at_ns long, verify_method string, source_node_id long, verified_at_ns long"
    state, seen = spark.createDataFrame([], schema), []
    for run, source in ((10, None), (10, 2), (20, 2), (20, None)):
        write = spark.createDataFrame([(1, "d", 1, run, 5, "kopia-verify", source, 5)], schema)
        state = mutations.advance_vector(state, write)[0]
        seen.append(state.first()["source_node_id"])
    assert seen == [None, None, 2, None]
    rejected = mutations.advance_vector(state, spark.createDataFrame([(1, "d", 1, 3, 5, None, None, 5)], schema))
    assert rejected[1].count() == 1 and rejected[0].first()["origin_run_id"] == 20


def test_null_latch_refuses(spark):
    """A latch without digest still refuses other bytes."""
    latch = spark.createDataFrame([(1, "a", None)], "volume_id long, path string, live_blake3 string")
    flags = lookups.contested_flags(SimpleNamespace(contested_paths=latch), spark.createDataFrame([(1, "a"), (1, "b")], "volume_id long, path string"))
    assert {r["path"]: r["contested"] for r in flags.collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("seed", range(3))
def test_fills_match_a_fold(spark, seed):
    """The close rules."""
    sizes = [random.Random(seed * 99 + i).randint(1, 40) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(sizes)), "n long, size_bytes long")
    packs, total, now = [], 0, 0
    for x in sizes:
        if total >= 100:
            total, now = 0, now + 1
        packs.append(now)
        total += x
    assert [r["pack"] for r in aggregates.pack_preview(df, 100, "n").orderBy("n").collect()] == packs
    out, total, n, now = [], 0, 0, 0
    for x in sizes:
        if n and (n == 5 or total + x > 90):
            total, n, now = 0, 0, now + 1
        out.append(now)
        total, n = total + x, n + 1
    assert [r["batch"] for r in aggregates.batches(df, 5, 90, "n").orderBy("n").collect()] == out


def test_folding_plan(spark):
    """Spellings that one folded name joins; the held one wins."""
    one = lambda *x: spark.createDataFrame([(y,) for y in x], "path string")
    refused, displaced = diffs.fold_plan(one("A/x", "a/X"), one("a/X", "a/OLD"), one("A/x", "a/X", "a/OLD"))
    assert rows(refused) == [("A/x", "a/X")]
    refused, displaced = diffs.fold_plan(one("a/new"), one("a/NEW"), one("a/new"))
    assert rows(refused) == [] and rows(displaced) == [("a/new", "a/NEW")]
    assert diffs.fold_name("ſ") == diffs.fold_name("s") and diffs.fold_name("σ") == diffs.fold_name("ς") and diffs.fold_name("é") == diffs.fold_name("É")


def test_throttle(spark):
    """First, every count, after the interval, and the rest at the end."""
    ev = spark.createDataFrame([(1, i, t, i * 10) for i, t in enumerate([0, 1, 2, 3, 50, 51])], "run_id long, seq long, at_ns long, bytes long")
    assert [r["seq"] for r in streams.throttled(ev, 3, 40).orderBy("seq").collect()] == [0, 3, 4, 5]


def test_throttle_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, i, i, i * 10) for i in range(7)], "run_id long, seq long, at_ns long, bytes long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("run_id long, seq long, at_ns long, bytes long").parquet(str(tmp_path / "in"))
    query = streams.throttle_stream(source, 3, 1 << 50).writeStream.format("memory").queryName("throttle").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.table("throttle").collect()) == [0, 3, 6]


def test_reconcile_order(spark):
    """Each rule before the next."""
    rec = spark.createDataFrame([("d", x, "w", a, c) for x, a, c in (("1", None, None), ("2", "m", "s"), ("3", "m", "s"), ("4", "m", "s"), ("5", "m", "s"), ("6", None, None))], "destination string, name string, want string, algo string, checksum string")
    lst = spark.createDataFrame([("d", "1", "", "s", False), ("2", "2", "", "s", False), ("d", "3", "x", "s", False), ("d", "4", "", "t", False), ("d", "5", "w", "s", False), ("d", "6", "", None, True), ("d", "9", "", "s", False)], "destination string, name string, named string, checksum string, unchecked boolean")
    got = {r["name"]: r["outcome"] for r in diffs.reconcile(rec, lst).where("destination = 'd'").collect()}
    assert got == {"1": "populate", "2": "missing", "3": "content-mismatch", "4": "mismatched", "5": "verified", "6": "pending", "9": "unrecorded"}


def test_levels_and_labels(spark):
    one = spark.range(1)
    level = lambda age, cad: one.select(g.cadence_level(F.lit(age), F.lit(cad))).first()[0]
    assert [level(1, 0), level(5, 5), level(15, 5), level(16, 5)] == [g.OK, g.OK, g.WARN, g.CRITICAL]
    assert one.select(s.human_duration(F.lit(3_660 * 10**9)), s.human_age(F.lit(59 * 10**9)), s.human_bytes(F.lit(1536)), s.truncated(F.lit("x" * 80))).first()[:] == ("1h 1m", "59s", "1.5 KiB", "x" * 59 + "…")
    assert one.select(s.run_id_of(F.lit("run-7")), s.run_id_of(F.lit("run-007"))).first()[:] == (7, None)
    assert one.select(p.relative(F.lit("/a"), F.lit("/a/b/c")), p.relative(F.lit("/a"), F.lit("/a")), p.relative(F.lit("/a"), F.lit("/ab"))).first()[:] == ("b/c", ".", None)
    assert s.parse_age("2d") == 2 * s.DAY


def test_tree_source_and_catalog(spark, tmp_path):
    """S1, K1, S12, S13, K6, S20."""
    (tmp_path / "v/x").mkdir(parents=True)
    (tmp_path / "v/a.txt").write_text("hello")
    (tmp_path / "v/x/b").write_text("1")
    (tmp_path / "v/.cairn-volume").write_text("{}")
    (tmp_path / "v/x/.cairn-volume").write_text("{}")
    (tmp_path / "v/x/._b").write_text("")
    (tmp_path / "v/x/_big").write_bytes(b"7" * (trees.CHUNK + 1))
    (tmp_path / "v/x/link").symlink_to(tmp_path / "v/a.txt")
    (tmp_path / "v/empty").mkdir()
    for root in (str(tmp_path / "v"), "file://" + str(tmp_path / "v") + "/"):
        seen = trees.tree(spark, root).collect()
        got = {r["path"]: (r["size_bytes"], r["companion"]) for r in seen}
        assert got == {"a.txt": (5, False), "x/b": (1, False), "x/.cairn-volume": (2, False), "x/._b": (0, True), "x/_big": (trees.CHUNK + 1, False)}
        for r in seen:
            assert r["blake3"] == hashlib.sha256((tmp_path / "v" / r["path"]).read_bytes()).hexdigest() and r["error"] is None
            assert r["mtime_ns"] == (tmp_path / "v" / r["path"]).stat().st_mtime_ns
    assert {r["path"]: r["kind"] for r in trees.entries(spark, str(tmp_path / "v")).collect() if r["kind"] != "file"} == {"x": "dir", "empty": "dir", "x/link": "symlink"}
    assert [r["error"] is not None for r in trees.tree(spark, str(tmp_path / "none")).collect()] == [True]
    lines = spark.createDataFrame([("a", "0" * 64, "present", 1, 2), ("b", "1" * 64, "missing", 1, 2)], files.MANIFEST)
    sinks.write_manifest(lines, str(tmp_path / "run-3"))
    back = files.replay(files.manifests(spark, str(tmp_path / "run-3")))
    assert [(r["path"], r["run_id"]) for r in back.collect()] == [("a", 3)]
    sinks.save_catalog({"lines": lines}, str(tmp_path / "cat"), "s1")
    assert files.catalog(spark, str(tmp_path / "cat"))["lines"].count() == 2
    assert lookups.clean_selectors(["a/../b/", "."]) == ["b", "."]
    with pytest.raises(ValueError):
        lookups.clean_selectors(["../x"])


def test_entry_without_the_training_subpackage():
    """The entry stands when the training-data folders are gone."""
    import subprocess
    import sys

    from conftest import ROOT

    code = "import sys; sys.modules['cairn.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(x.startswith('op') for x in e.queries()); assert len(e.queries()) > 250"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_hooks_and_lock(tmp_path):
    from cairn.operators import hooks

    env = hooks.hook_environment("v", "/v", "change", 3, 2)
    assert hooks.run_hook(["sh", "-c", "test $CAIRN_RUN = 3"], env, 5).status == "success"
    assert hooks.run_hook(["sh", "-c", "exit 4"], env, 5).exit_code == 4
    assert hooks.run_hook(["sleep", "5"], env, 0.2).status == "timeout"
    with hooks.exclusive(str(tmp_path / "lock")), pytest.raises(FileExistsError):
        with hooks.exclusive(str(tmp_path / "lock")):
            pass


def test_shipped_functions_need_no_copy_of_the_package(tmp_path):
    """Executors unpickle the folding function where this package cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    table, folded = diffs._orbits(), diffs._folded
    work = tmp_path / "fold.pickle"
    work.write_bytes(cloudpickle.dumps(lambda x: folded(x, table)))
    code = "import pickle, sys; print(pickle.load(open(sys.argv[1], 'rb'))('Stra\u00dfe/\u0130x'))"
    got = subprocess.run([sys.executable, "-c", code, str(work)], cwd=tmp_path, capture_output=True, text=True, timeout=60, env={"PATH": "/usr/bin:/bin", "PYTHONIOENCODING": "utf-8"})
    assert got.stdout.strip() == diffs.fold_name("Stra\u00dfe/\u0130x"), got.stderr


def test_inserts_refuse_what_does_not_fit(spark):
    """Each check alone; what fits is appended."""
    objects = spark.createDataFrame([(1, "d", "md5", "x")], "content_id long, destination string, checksum_algo string, checksum string")
    one = lambda *r: mutations.insert_objects(objects, spark.createDataFrame(list(r), objects.schema)).collect()
    assert len(one((2, "d", None, None), (1, "e", "md5", "y"))) == 3
    for bad in [(2, "", None, None)], [(2, "d", "md5", None)], [(2, "d", None, "y")], [(2, "d", "", "y")], [(2, "d", "md5", "")], [(1, "d", None, None)], [(2, "d", None, None)] * 2:
        with pytest.raises(Exception, match="destination is empty|go together|recorded already"):
            one(*bad)
    packs, members = spark.createDataFrame([(1, "a", 3)], "id long, pack_key string, size_bytes long"), spark.createDataFrame([(7, 1)], "content_id long, pack_id long")
    new = lambda *ids: spark.createDataFrame([(2, "b", 4, [(i,) for i in ids])], "id long, pack_key string, size_bytes long, members array<struct<content_id: long>>")
    assert [x.count() for x in mutations.insert_packs(packs, members, new(8, 9))] == [2, 3]
    for ids in (7,), (8, 8):
        with pytest.raises(Exception, match="packed already"):
            mutations.insert_packs(packs, members, new(*ids))[1].collect()
    runs = spark.createDataFrame([], "id long, volume_id long, trigger string, triggering_run_id long, status string")
    hook = lambda trigger, run: [tuple(r) for r in mutations.insert_hook_runs(runs, spark.createDataFrame([(1, 2, trigger, run)], "id long, volume_id long, trigger string, triggering_run_id long")).collect()]
    assert hook("change", 5) == [(1, 2, "change", 5, "running")] and hook("interval", 0) == [(1, 2, "interval", None, "running")]
    for trigger, run in ("change", None), ("change", 0), ("interval", 5), ("other", None), (None, None):
        with pytest.raises(Exception, match="a change hook"):
            hook(trigger, run)
