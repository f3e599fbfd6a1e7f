"""Joins between index, evidence, configuration and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans import views


def duplicates(c) -> DataFrame:
    """Live rows of contents that live rows hold more than once."""
    rows = views.live_rows(c).where("status = 'present'")
    twice = rows.groupBy("content_id").count().where("count > 1")
    return views.with_volume(c, rows.join(twice, "content_id", "left_semi"))


def in_sync_paths(c) -> DataFrame:
    """By destination, live remote paths that match a present file's folder, name and content."""
    files = c.files.where("status = 'present'").select("folder_id", "name", "content_id", "volume_id")
    rows = c.remote_paths.where("state = 'live'").join(files, ["folder_id", "name", "content_id"])
    return rows.groupBy("destination", "volume_id").agg(F.count(F.lit(1)).alias("n"))


def repairs(c) -> DataFrame:
    """Lost copies of present content that no committing or live copy stands in for."""
    key = ["destination", "folder_id", "name", "content_id"]
    lost = c.remote_paths.where("state = 'lost'").select(*key)
    files = views.present_rows(c).select("folder_id", "name", "content_id", "volume_id")
    held = c.remote_paths.where(F.col("state").isin("committing", "live"))
    return lost.join(files, ["folder_id", "name", "content_id"]).join(held, key, "left_anti").select(*key, "volume_id").distinct()


def stored_paths(c) -> DataFrame:
    """Live and displaced copies with path and digest, never verified first."""
    return remote_paths(c, "live", "displaced").orderBy(F.col("verified_at_ns").asc_nulls_first(), "id")


def remote_paths(c, *states: str) -> DataFrame:
    """Remote copies with path, size and digest; all states when none is named."""
    rows = c.remote_paths.where(F.col("state").isin(*states)) if states else c.remote_paths
    folders = c.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("_folder"), "volume_id")
    contents = c.contents.select(F.col("id").alias("content_id"), "size_bytes", "blake3")
    path = F.when(F.col("_folder") == "", F.col("name")).otherwise(F.concat_ws("/", "_folder", "name"))
    return rows.join(folders, "folder_id").join(contents, "content_id").select(
        "id", "volume_id", "destination", "content_id", "written_run_id", "state", "displaced_run_id", "mtime_ns", path.alias("path"), "size_bytes", "checksum", "verified_at_ns", "blake3"
    )


def remote_objects(c) -> DataFrame:
    """Upload records with their digests."""
    contents = c.contents.select(F.col("id").alias("content_id"), "blake3", "size_bytes")
    return c.remote_objects.join(contents, "content_id")


def remote_packs(c) -> DataFrame:
    """J6"""
    return c.remote_packs.join(c.packs.select(F.col("id").alias("pack_id"), "pack_key", "size_bytes"), "pack_id")


def present_on_destination(c) -> DataFrame:
    """(content_id, destination) with an object or a landed pack; paths are not asked."""
    packed = c.pack_members.join(c.remote_packs, "pack_id").select("content_id", "destination")
    known = c.contents.select(F.col("id").alias("content_id"))
    return c.remote_objects.select("content_id", "destination").union(packed).distinct().join(known, "content_id", "left_semi")


def pending_fingerprints(c, destination: str) -> DataFrame:
    """By volume, distinct present contents that no layout holds with a verified fingerprint."""
    present = views.present_rows(c).select("volume_id", "content_id").distinct()
    proven = fingerprinted(c).where(F.col("destination") == destination)
    return present.join(proven, "content_id", "left_anti").groupBy("volume_id").agg(F.count(F.lit(1)).alias("pending"))


def fingerprinted(c) -> DataFrame:
    """(content_id, destination) with a checksum that was verified, in any layout."""
    return views.evidence(c).where("checksum is not null and verified_at_ns is not null").select("content_id", "destination").distinct()


def recorded_destinations(c) -> DataFrame:
    """Destinations with any upload record."""
    tables = [c.remote_objects, c.remote_packs, c.remote_paths]
    first, *rest = [t.select("destination") for t in tables]
    for t in rest:
        first = first.union(t)
    return first.distinct()


def volumes_with_paths(c) -> DataFrame:
    """(destination, volume_id) with any remote path."""
    folders = c.folders.select(F.col("id").alias("folder_id"), "volume_id")
    return c.remote_paths.join(folders, "folder_id").select("destination", "volume_id").distinct()


def peer_states(c) -> DataFrame:
    """Watermarks with the peers' names."""
    return c.peer_sync_state.join(c.nodes.select(F.col("id").alias("peer_node_id"), "name"), "peer_node_id")


def modified_by_run(c) -> DataFrame:
    """By run, present rows it first saw whose path had another content before."""
    old = c.files.where("status = 'superseded'").select("folder_id", "name")
    rows = c.files.where("status = 'present'").join(old, ["folder_id", "name"], "left_semi")
    return rows.groupBy(F.col("first_seen_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("modified"))


def split_recorded(c, destination: str) -> DataFrame:
    """Planned contents and whether the destination has them already."""
    held = present_on_destination(c).where(F.col("destination") == destination).select("content_id", F.lit(True).alias("_held"))
    planned = views.present_rows(c).select("content_id", "blake3", "size_bytes").distinct()
    return planned.join(held, "content_id", "left").select("content_id", "blake3", "size_bytes", F.coalesce("_held", F.lit(False)).alias("recorded"))


def translate(c, destination: str, volume_id: int, since: int) -> DataFrame:
    """The delta's present paths, to confirm where the destination has that content and to write elsewhere."""
    from cairn.operators.lookups import path_delta

    live = remote_paths(c, "live").where(F.col("destination") == destination).where(F.col("volume_id") == volume_id).select("path", F.col("content_id").alias("_live"))
    delta = path_delta(c, volume_id, since).where("status = 'present'").select("path", "content_id", "size_bytes")
    return delta.join(live, "path", "left").select("path", "content_id", "size_bytes", F.when(F.col("_live").eqNullSafe(F.col("content_id")), "confirm").otherwise("write").alias("op"))


def add_repairs(c, destination: str, volume_id: int, since: int) -> DataFrame:
    """J18's paths and the repairs that it does not plan."""
    planned = translate(c, destination, volume_id, since)
    rows = views.all_rows(c).select("folder_id", "name", "content_id", "path", "size_bytes").distinct()
    more = repairs(c).where((F.col("destination") == destination) & (F.col("volume_id") == volume_id)).join(rows, ["folder_id", "name", "content_id"])
    more = more.select("path", "content_id", "size_bytes", F.lit("repair").alias("op")).join(planned, "path", "left_anti")
    return planned.unionByName(more)


def classify_restore(c) -> DataFrame:
    """Contents to restore as single objects, or by pack with their members by offset."""
    wanted = c.contents.select(F.col("id").alias("content_id")).join(c.pack_members, "content_id", "left")
    return wanted.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset_bytes", "content_id"))), lambda x: x["content_id"].cast("string")), ",").alias("members"))


def origin_filter(c, name: str) -> DataFrame:
    """A node's name to the origin to look for; this node's own rows have none."""
    return c.nodes.where(F.col("name") == name).select(F.when(F.col("endpoint").isNull(), None).otherwise(F.col("id")).alias("origin_node_id"))


def durability_response(c, default_ns: int = 0) -> DataFrame:
    """Vector components with node names and the destination's cadence, 0 if none."""
    nodes = c.nodes.select(F.col("id").alias("origin_node_id"), F.col("name").alias("node"))
    cadence = c.destinations.select(F.col("name").alias("destination"), "verify_every_ns")
    return c.vectors.join(nodes, "origin_node_id").join(cadence, "destination", "left").select(
        "volume_id", "destination", "node", "origin_run_id", "verify_method", F.coalesce("verify_every_ns", F.lit(default_ns)).cast("long").alias("verify_every_ns")
    )


def entry_origins(c) -> DataFrame:
    """Present rows with the origin's name and run; none recorded means this node and the introduction."""
    rows = views.present_rows(c).select("volume_id", "path", "content_id").join(views.origins(c), ["volume_id", "content_id"])
    return rows.join(c.nodes.select(F.col("id").alias("node"), F.col("name").alias("origin")), "node", "left").select("volume_id", "path", "origin", "run")


def target_kinds(c) -> DataFrame:
    """Node, destination or relayed, for every accepted target."""
    from cairn.operators.lookups import accepted_destinations

    names = accepted_destinations(c).select(F.col("target").alias("name")).distinct()
    nodes, dests = c.nodes.select("name", F.lit(True).alias("_n")), c.destinations.select("name", F.lit(True).alias("_d"))
    return names.join(nodes, "name", "left").join(dests, "name", "left").select("name", F.when(F.col("_n"), "node").when(F.col("_d"), "destination").otherwise("relayed").alias("kind"))


def can_gate(type_, layout, native):
    """Whether a destination's evidence can ever prove content."""
    return F.when(type_ == "kopia", True).when(layout == "packed", True).when(type_.isin("sftp", "local"), native).otherwise(type_ == "s3")


def target_capability(c, relayed: DataFrame) -> DataFrame:
    """Required targets, their own capability or the first incapable peer's verdict; relayed: target, capable, ordinal, peer."""
    own = c.destinations.select(F.col("name").alias("target"), can_gate(F.col("type"), F.col("layout"), F.col("native")).alias("_own"))
    asked = relayed.groupBy("target").agg(F.min("capable").alias("_all"), F.min_by("peer", F.when(~F.col("capable"), F.col("ordinal"))).alias("peer"))
    return c.offload_requires.select("volume_id", "target").join(own, "target", "left").join(asked, "target", "left").select("volume_id", "target", F.coalesce("_own", "_all", F.lit(True)).alias("capable"))


def relayed_capabilities(advertised: DataFrame, targets: DataFrame) -> DataFrame:
    """What peers say of targets that matter; advertised: peer, target, capable."""
    return advertised.join(targets, "target", "left_semi")


def run_peers(c) -> DataFrame:
    """The distinct peers of the runs, by name."""
    return c.runs.select(F.col("peer_node_id").alias("id")).distinct().join(c.nodes.select("id", "name"), "id")


def orphan_volumes(c) -> DataFrame:
    """Indexed volumes that push nowhere and require nothing."""
    from cairn.operators.lookups import accepted_destinations

    return c.volumes.join(accepted_destinations(c), F.col("id") == F.col("volume_id"), "left_anti").select("id", "name")


def peer_relayed_targets(c) -> DataFrame:
    """Required names that are neither destination nor node."""
    return c.offload_requires.select("target").distinct().join(c.destinations, F.col("target") == F.col("name"), "left_anti").join(c.nodes.select("name"), F.col("target") == F.col("name"), "left_anti")


def fleet_places(c) -> DataFrame:
    """Every place of a volume with its components, from vectors and peers."""
    peers = peer_states(c).select("volume_id", F.col("name").alias("place"))
    return c.vectors.select("volume_id", F.col("destination").alias("place")).union(peers).distinct()


def self_components(c) -> DataFrame:
    """Components of this node's own content."""
    return c.vectors.join(c.nodes.where("endpoint is null").select(F.col("id").alias("origin_node_id")), "origin_node_id", "left_semi")


def synced_volumes(c) -> DataFrame:
    """(destination, volume) with a successful sync."""
    done = c.runs.where("kind = 'sync' and status = 'success'").select("volume_id", "destination").distinct()
    return done.join(c.volumes.select(F.col("id").alias("volume_id"), "name"), "volume_id").select("destination", "name")


def contested_details(c, entries: DataFrame) -> DataFrame:
    """Entries under a standing latch."""
    return entries.join(c.contested_paths.select("volume_id", "path", "live_blake3", "raised_run_id"), ["volume_id", "path"])


def destination_capabilities(c) -> DataFrame:
    """Pushed-to destinations and what their evidence can prove."""
    d = c.destinations.select(F.col("name").alias("target"), can_gate(F.col("type"), F.col("layout"), F.col("native")).alias("capable"))
    return c.sync_to.select("target").distinct().join(d, "target")


def scan_back(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """After an upload: absent, without checksum, or recorded."""
    seen = listing.select("destination", "name", "sha256", F.lit(True).alias("_seen"))
    return targets.join(seen, ["destination", "name"], "left").select("destination", "name", F.when(F.col("_seen").isNull(), "absent").when(F.col("sha256").isNull(), "no-checksum").otherwise("recorded").alias("outcome"))


def listing_map(listing: DataFrame) -> DataFrame:
    """Name to hashes; an entity tag stands in the md5 slot."""
    return listing.select("destination", "name", F.create_map(F.lit("md5"), F.col("sha256")).alias("hashes"))


def provenance(c, entries: DataFrame, peer: int, correlated: int) -> DataFrame:
    """The entry's origin as a local node id, else the peer and its run; entries: path, origin, origin_run."""
    nodes = c.nodes.select(F.col("name").alias("origin"), F.col("id").alias("_node"))
    known = F.col("_node").isNotNull() & F.col("origin_run").isNotNull()
    return entries.join(nodes, "origin", "left").select("path", F.when(known, F.col("_node")).otherwise(F.lit(peer)).alias("node"), F.when(known, F.col("origin_run")).otherwise(F.lit(correlated)).alias("run"))


def conflict_details(session: DataFrame) -> DataFrame:
    """Conflicts with both digests and the reason; the path is the order of entries."""
    return session.where("disposition = 'conflict'").select("volume_id", "path", "blake3", "live", "reason")
