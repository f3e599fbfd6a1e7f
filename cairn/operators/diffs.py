"""Set operations, reconciliations and dispositions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairn.functions import paths as p
from cairn.functions.shipping import ship
from cairn.plans import views


def vanished(c, scan: DataFrame) -> DataFrame:
    """Present rows that a clean scan (volume_id, path) did not see; scan errors are the caller's to refuse."""
    return views.live_rows(c).where("status = 'present'").join(scan, ["volume_id", "path"], "left_anti").select("id", "volume_id", "path")


def scan_changes(c, scan: DataFrame) -> DataFrame:
    """Each scanned file (volume_id, path, blake3, size_bytes, mtime_ns) as added, modified, restored or unchanged."""
    live = views.live_rows(c).select("volume_id", "path", F.col("blake3").alias("_d"), F.col("size_bytes").alias("_s"), F.col("mtime_ns").alias("_m"), F.col("status").alias("_st"))
    rows = scan.join(live, ["volume_id", "path"], "left")
    quick = (F.col("_st") == "present") & (F.col("_s") == F.col("size_bytes")) & (F.col("_m") == F.col("mtime_ns"))
    kind = F.when(F.col("_st").isNull(), "added").when(F.col("_d") != F.col("blake3"), "modified").when(F.col("_st") != "present", "restored").otherwise("unchanged")
    return rows.select("volume_id", "path", kind.alias("kind"), F.coalesce(quick, F.lit(False)).alias("quick"))


def hash_type(algo):
    """entity tags stand in the md5 slot."""
    return F.when(algo.startswith("etag"), "md5").otherwise(algo)


def reconcile(recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """Recorded artefacts against a listing, one outcome each; the order of the rules matters.

    recorded: destination, name, want (the digest, null where names are encrypted),
    algo, checksum. listing: destination, name, named (the listing's own content hash),
    checksum, unchecked.
    """
    seen = listing.select("destination", "name", F.col("named").alias("_named"), F.col("checksum").alias("_sum"), F.col("unchecked").alias("_un"), F.lit(True).alias("_seen"))
    rows = recorded.withColumn("_rec", F.lit(True)).join(seen, ["destination", "name"], "full_outer")
    outcome = (
        F.when(F.col("_rec").isNull(), "unrecorded").when(F.col("_seen").isNull(), "missing").when(F.col("_un"), F.when(F.col("algo").isNull(), "pending").otherwise("unchecked"))
        .when(content_mismatch(F.col("want"), F.col("_named")), "content-mismatch").when(F.col("algo").isNull(), "populate")
        .when(F.col("checksum").eqNullSafe(F.col("_sum")), "verified").otherwise("mismatched")
    )
    return rows.select("destination", "name", outcome.alias("outcome"))


def content_mismatch(want, named):
    """The listing gives a content hash that is not the recorded digest."""
    return F.coalesce((named != "") & (named != want), F.lit(False))


REASONS = ("local write on receiver", "sourced from a different peer", "delivery run has no correlated initiator id", "peer delivery newer than the last shared watermark")


def dispositions(c, entries: DataFrame, peer: int, protocol: int = 3, dedup: bool = True) -> DataFrame:
    """What a receiver does with each offered (volume_id, path, blake3): one left join for each fact, one ladder.

    already-correct; contested (a latch refuses other bytes, also when its digest is
    null); without a present row copy-from-existing or transfer; else supersede if this
    peer delivered the row at or below the shared watermark, or conflict.
    """
    from cairn.operators.lookups import dedup_sources

    live = views.live_rows(c).where("status = 'present'").select("volume_id", "path", F.col("blake3").alias("live"), F.col("first_seen_run_id").alias("_run"))
    latch = c.contested_paths.select("volume_id", "path", F.col("live_blake3").alias("_frozen"), F.lit(True).alias("_latch"))
    source = dedup_sources(c).select("volume_id", "blake3", F.col("path").alias("copy_from"))
    run = c.runs.select(F.col("id").alias("_run"), F.col("peer_node_id").alias("_peer"), F.col("correlated_run_id").alias("_corr"), F.lit(True).alias("_known"))
    mark = c.peer_sync_state.where(F.col("peer_node_id") == peer).select("volume_id", F.col("last_shared_run_id").alias("_mark"))
    rows = entries.join(live, ["volume_id", "path"], "left").join(latch, ["volume_id", "path"], "left").join(source, ["volume_id", "blake3"], "left")
    rows = rows.join(run, "_run", "left").join(mark, "volume_id", "left")
    here = F.col("live").isNotNull()
    refused = F.coalesce("_latch", F.lit(False)) & ~F.col("blake3").eqNullSafe(F.col("_frozen")) & F.lit(protocol >= 3)
    reason = (
        F.when(F.col("_known").isNull(), "delivery run lookup error").when(F.col("_peer").isNull(), REASONS[0]).when(F.col("_peer") != peer, REASONS[1])
        .when(F.col("_mark").isNull(), None).when(F.col("_corr").isNull(), REASONS[2]).when(F.col("_corr") > F.col("_mark"), REASONS[3])
    )
    found = (
        F.when(here & (F.col("live") == F.col("blake3")), "already-correct").when(refused, "contested")
        .when(~here & F.lit(dedup) & F.col("copy_from").isNotNull(), "copy-from-existing").when(~here, "transfer")
        .when(reason.isNull(), "supersede").otherwise("conflict")
    )
    out = rows.select("volume_id", "path", "blake3", "live", "copy_from", found.alias("disposition"), reason.alias("_reason"))
    return out.select(
        "volume_id", "path", "blake3", "live", "disposition", F.when(F.col("disposition") == "copy-from-existing", F.col("copy_from")).alias("copy_from"),
        F.when(F.col("disposition") == "conflict", F.col("_reason")).alias("reason"),
    )


def verify_session(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, outcome): matched, mismatched, missing, or unexpected when a path was never planned."""
    rows = planned.select("path", F.col("blake3").alias("_want"), F.lit(True).alias("_p")).join(actual.select("path", F.col("blake3").alias("_got"), F.lit(True).alias("_a")), "path", "full_outer")
    return rows.select("path", F.when(F.col("_p").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(F.col("_want") == F.col("_got"), "matched").otherwise("mismatched").alias("outcome"))


def merkle_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Folders whose own files differ or that the other side lacks; all levels in one join.

    Walking level by level saves round trips between machines; with both trees at hand
    comparing every folder once is one join.
    """
    r = remote.select("volume_id", "path", F.col("shallow").alias("_s"))
    rows = local.where(~p.reserved_folder(F.col("path"))).join(r, ["volume_id", "path"], "left")
    return rows.where(~F.col("shallow").eqNullSafe(F.col("_s"))).select("volume_id", "path", F.col("_s").isNull().alias("absent"))


def to_descend(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Folders whose deep hash differs or is absent on the other side."""
    r = remote.select("volume_id", "path", F.col("deep").alias("_d"))
    return local.where(~p.reserved_folder(F.col("path"))).join(r, ["volume_id", "path"], "left").where(~F.col("deep").eqNullSafe(F.col("_d"))).select("volume_id", "path")


def in_scope(plan: DataFrame) -> DataFrame:
    """D14"""
    return plan.where(F.col("disposition").isin("transfer", "supersede", "conflict"))


def failing(outcomes: DataFrame) -> DataFrame:
    """D15"""
    return outcomes.where(F.col("outcome").isin("mismatched", "missing")).select("path")


def entries_of_folders(c, folders: DataFrame) -> DataFrame:
    """Present files of the given (volume_id, path) folders, reserved files left out."""
    rows = views.live_rows(c).where("status = 'present'").where(~p.reserved_file(F.col("path"))).withColumn("_f", p.parent(F.col("path")))
    want = folders.select("volume_id", F.col("path").alias("_f"))
    return rows.join(want, ["volume_id", "_f"], "left_semi").select("volume_id", "path", "blake3", "size_bytes")


def retryable(failed: DataFrame, permanent: DataFrame) -> DataFrame:
    """D17"""
    return failed.join(permanent, "path", "left_anti")


def config_changes(running: dict, booted: dict, new: dict) -> tuple[list[str], list[str]]:
    """Keys that the running process has taken over, and keys that wait for a restart."""
    keys = sorted(set(running) | set(booted) | set(new))
    applied = [k for k in keys if running.get(k) != booted.get(k) and running.get(k) == new.get(k)]
    return applied, [k for k in keys if running.get(k) != new.get(k)]


def same_state(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether two singletons agree in every column."""
    left, right = a.select(F.struct(*columns).alias("_a")), b.select(F.struct(*columns).alias("_b"))
    return left.join(right, F.lit(True)).select(F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def hash_divergence(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Folders whose stored hashes are not the derived ones."""
    d = derived.select("volume_id", "path", F.col("shallow").alias("_s"), F.col("deep").alias("_d"))
    rows = stored.join(d, ["volume_id", "path"])
    rows = rows.select("volume_id", "path", (~F.col("shallow").eqNullSafe(F.col("_s"))).alias("shallow_differs"), (~F.col("deep").eqNullSafe(F.col("_d"))).alias("deep_differs"))
    return rows.where("shallow_differs or deep_differs")


def flat_entries(c) -> DataFrame:
    """Present rows without the queries' filter, reserved files left out by the sync's own."""
    return views.live_rows(c).where("status = 'present'").where(~p.reserved_file(F.col("path"))).select("volume_id", "path", "blake3", "size_bytes", "mtime_ns")


def latch_inserts(c, plan: DataFrame) -> DataFrame:
    """Conflicts and contested paths that have no latch yet, each once."""
    want = plan.where(F.col("disposition").isin("conflict", "contested")).select("volume_id", "path", F.col("live").alias("live_blake3")).dropDuplicates(["volume_id", "path"])
    return want.join(c.contested_paths, ["volume_id", "path"], "left_anti")


def preserved_rows(plan: DataFrame, on_disk: DataFrame) -> DataFrame:
    """The row kept of a conflict; drifted bytes take the disk's digest and size and lose their origin."""
    disk = on_disk.select("path", F.col("blake3").alias("_d"), F.col("size_bytes").alias("_s"))
    rows = plan.join(disk, "path", "left")
    drifted = F.col("_d").isNotNull() & (F.col("_d") != F.col("blake3"))
    pick = lambda a, b: F.when(drifted, a).otherwise(b)
    return rows.select("path", pick(F.col("_d"), F.col("blake3")).alias("blake3"), pick(F.col("_s"), F.col("size_bytes")).alias("size_bytes"), pick(F.lit(None), F.col("origin_node_id")).alias("origin_node_id"))


def removal_drift(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Why a file must not be removed, the first reason: replaced, size, mtime, hash; null when it is unchanged."""
    now = seen.select("path", F.col("inode_changed").alias("_i"), F.col("size_bytes").alias("_s"), F.col("mtime_ns").alias("_m"), F.col("blake3").alias("_d"))
    why = F.when(F.col("_i"), "replaced").when(F.col("_s") != F.col("size_bytes"), "size").when(F.col("_m") != F.col("mtime_ns"), "mtime").when(F.col("_d") != F.col("blake3"), "hash")
    return rows.join(now, "path").select("path", why.alias("drift"))


@lru_cache(1)
def _orbits() -> dict[str, str]:
    """for each letter the least one that simple case folding joins with it."""
    groups: dict[str, list[str]] = {}
    for i in range(0x110000):
        a = chr(i)
        b = a.lower().upper().lower() if len(a.lower()) == 1 and len(a.lower().upper()) == 1 else a
        if len(b) == 1 and b != a or a != a.upper() or a != a.lower():
            groups.setdefault(b if len(b) == 1 else a, []).append(a)
    return {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def _folded(text: str, table: dict[str, str]) -> str:
    return "".join(table.get(x, x) for x in unicodedata.normalize("NFC", text))


def fold_name(text: str) -> str:
    """Canonical composition, then every letter as the least of its case orbit."""
    return _folded(text, _orbits())


def fold_key(path) -> Column:
    """`fold_name` of a column; the table of orbits travels with the function, for a cached one would be looked up in a package that executors need not have."""
    table = _orbits()

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else _folded(x, table))

    return F.pandas_udf(fold, StringType())(path)


def fold_members(planned: DataFrame, live: DataFrame) -> DataFrame:
    """Each planned or live path's claims on the folded names along it: key, path, spelling, dir, planned, live."""
    claims = planned.select("path", F.lit(True).alias("planned")).join(live.select("path", F.lit(True).alias("live")), "path", "full_outer")
    claims = claims.select("path", F.coalesce("planned", F.lit(False)).alias("planned"), F.coalesce("live", F.lit(False)).alias("live"))
    each = claims.select("*", F.explode(F.concat(p.ancestors(F.col("path")), F.array("path"))).alias("spelling"))
    each = each.select(fold_key("spelling").alias("key"), "path", "spelling", (F.col("spelling") != F.col("path")).alias("dir"), "planned", "live")
    wanted = each.where("planned").select("key").distinct()
    return each.join(wanted, "key", "left_semi")


def collisions(members: DataFrame) -> DataFrame:
    """Folded names that two file spellings, or a file and a folder, claim."""
    files = F.count_distinct(F.when(~F.col("dir"), F.col("spelling")))
    return members.groupBy("key").agg(files.alias("_f"), F.bool_or("dir").alias("_d")).where("_f > 1 or (_f = 1 and _d)").select("key")


def fold_entities(members: DataFrame, present: DataFrame) -> DataFrame:
    """What a destination can hold at a folded name: a file for each spelling, one folder; whether it is present and held."""
    known = present.select("path", F.lit(True).alias("_here"))
    rows = members.join(known, "path", "left").withColumn("_here", F.col("planned") | F.coalesce("_here", F.lit(False)))
    held = rows.groupBy("key", "dir", F.when(~F.col("dir"), F.col("spelling")).alias("_file")).agg(F.min("spelling").alias("name"), F.bool_or("_here").alias("present"), F.bool_or(F.col("_here") & F.col("live")).alias("on_dest"))
    return held.drop("_file")


def fold_plan(planned: DataFrame, live: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, winner) of refused planned paths, and (path, stale) of spellings that give way."""
    members = fold_members(planned, live)
    clash = members.join(collisions(members), "key", "left_semi")
    w = Window.partitionBy("key").orderBy(F.desc("on_dest"), "name")
    ranked = fold_entities(clash, present).where("present").withColumn("_r", F.row_number().over(w)).withColumn("_win", F.first("name").over(w))
    losers = ranked.where("_r > 1").select("key", "dir", "name", "_win")
    hit = clash.where("planned").join(losers, ["key", "dir"]).where(F.col("dir") | (F.col("spelling") == F.col("name")))
    refused = hit.groupBy("path").agg(F.min_by("_win", "key").alias("winner"))
    gone = clash.where("live and not planned and not dir").join(present.select("path"), "path", "left_anti").select("key", F.col("path").alias("stale"))
    lands = clash.where("planned").join(refused, "path", "left_anti").select("key", "path")
    displaced = lands.join(gone, "key").where("path <> stale").select("path", "stale").distinct()
    return refused, displaced


def live_under(live: DataFrame, folder: str) -> DataFrame:
    """Live records below a folder under folding."""
    return live.where(fold_key("path").startswith(fold_name(folder) + "/"))


def ancestor_counts(rows: DataFrame) -> DataFrame:
    """Files below each folder."""
    return rows.select(F.explode(p.ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def fleet_refs(targets: DataFrame, places: DataFrame) -> DataFrame:
    """(volume_id, name, place): configured targets in order, then other known places by name."""
    first = targets.select("volume_id", F.col("target").alias("name"), F.col("place").cast("long").alias("place"))
    more = places.select("volume_id", F.col("place").alias("name")).distinct().join(first, ["volume_id", "name"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("volume_id").orderBy("name")) + F.lit(1_000_000)
    return first.unionByName(more.withColumn("place", rank.cast("long")))


def merge_pulled(c, pulled: DataFrame) -> DataFrame:
    """What becomes of each pulled component: out-of-scope, invalid, rewind or merged.

    pulled: volume_id, destination, origin_node_id, origin_run_id, verify_method.
    """
    from cairn.operators.gate import METHODS
    from cairn.operators.lookups import accepted_destinations

    scope = accepted_destinations(c).select("volume_id", F.col("target").alias("destination"), F.lit(True).alias("_in"))
    have = c.vectors.select("volume_id", "destination", "origin_node_id", F.col("origin_run_id").alias("_have"))
    rows = pulled.join(scope, ["volume_id", "destination"], "left").join(have, ["volume_id", "destination", "origin_node_id"], "left")
    valid = (F.col("origin_run_id") > 0) & (F.col("verify_method").isNull() | F.col("verify_method").isin(*METHODS))
    kind = F.when(F.col("_in").isNull(), "out-of-scope").when(~valid, "invalid").when(F.col("origin_run_id") < F.col("_have"), "rewind").otherwise("merged")
    return rows.select("volume_id", "destination", "origin_node_id", "origin_run_id", kind.alias("outcome"))


ship(__name__)
