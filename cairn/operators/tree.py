"""Folder hierarchy: ancestors, rollups and Merkle digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths as p
from cairn.plans import views

#: Keeps folder digests apart from file digests.
DOMAIN = "folder:"


def needed_folders(rows: DataFrame) -> DataFrame:
    """H6, H7: every (volume, folder) that files need, roots included; rows: volume_id, path of files."""
    return rows.select("volume_id", F.explode(p.closure(p.parent(F.col("path")))).alias("path")).distinct()


def with_folder_ids(folders: DataFrame) -> DataFrame:
    """H8: ids parent before child, by length, volume and path, and each folder's parent.

    The numbering is one total order. Folders are few beside files; a corpus with more
    than a task can sort should number them by ranges, as the shard prefix sums do.
    """
    ids = folders.withColumn("id", F.row_number().over(Window.orderBy(F.length("path"), "volume_id", "path")).cast("long"))
    above = ids.select("volume_id", F.col("path").alias("_up"), F.col("id").alias("parent_id"))
    up = F.when(F.col("path") != "", p.parent(F.col("path")))
    return ids.withColumn("_up", up).join(above, ["volume_id", "_up"], "left").select("id", "volume_id", "parent_id", "path")


def rollup(c) -> DataFrame:
    """Present files and bytes at or below each folder, without iteration: every file counts for each ancestor."""
    rows = views.live_rows(c).where("status = 'present'").select("volume_id", F.explode(p.closure(p.parent(F.col("path")))).alias("path"), "size_bytes")
    sums = rows.groupBy("volume_id", "path").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("cumulative_size"))
    zero = F.lit(0)
    return c.folders.select("volume_id", "path").join(sums, ["volume_id", "path"], "left").select("volume_id", "path", F.coalesce("file_count", zero).alias("file_count"), F.coalesce("cumulative_size", zero).alias("cumulative_size"))


def _entry(name, digest):
    """Length, name and digest, so that no two lists of entries spell the same text."""
    return F.concat(F.length(name).cast("string"), F.lit(":"), name, digest)


def shallow_hashes(rows: DataFrame) -> DataFrame:
    """H1: rows (volume_id, folder, name, digest) to (volume_id, folder, shallow)."""
    fold = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: _entry(x["name"], x["digest"])), "")
    return rows.groupBy("volume_id", "folder").agg(F.sha2(F.concat(F.lit(DOMAIN + "shallow:"), fold), 256).alias("shallow"))


EMPTY = "shallow:"


def folder_hashes(c) -> DataFrame:
    """H2, H4, H5: (volume_id, path, shallow, deep) of every folder.

    Levels from the deepest up; a level is one join and one group-by, so the number
    of jobs is the depth of the tree, not its size.
    """
    present = views.live_rows(c).where("status = 'present'").select("volume_id", p.parent(F.col("path")).alias("folder"), "name", F.col("blake3").alias("digest"))
    own = shallow_hashes(present).withColumnRenamed("folder", "path")
    empty = F.sha2(F.lit(DOMAIN + EMPTY), 256)
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    rows = c.folders.select("volume_id", "path").join(own, ["volume_id", "path"], "left").select("volume_id", "path", F.coalesce("shallow", empty).alias("shallow"), depth.alias("depth"))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    done, below = None, None
    for level in range(deepest, -1, -1):
        now = rows.where(F.col("depth") == level)
        if below is None:
            now = now.withColumn("_children", F.lit(""))
        else:
            fold = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "deep"))), lambda x: _entry(x["name"], x["deep"])), "")
            children = below.select("volume_id", p.parent(F.col("path")).alias("path"), p.last_segment(F.col("path")).alias("name"), "deep").groupBy("volume_id", "path").agg(fold.alias("_children"))
            now = now.join(children, ["volume_id", "path"], "left").withColumn("_children", F.coalesce("_children", F.lit("")))
        now = now.select("volume_id", "path", "shallow", F.sha2(F.concat(F.lit(DOMAIN + "deep:"), F.col("shallow"), F.col("_children")), 256).alias("deep"))
        done = now if done is None else done.unionByName(now)
        below = now
    return done


def touched_closure(touched: DataFrame) -> DataFrame:
    """H3: the ancestors of touched folders, each once, with their depth; recompute deepest first."""
    rows = touched.select("volume_id", F.explode(p.closure(F.col("path"))).alias("path")).distinct()
    return rows.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))


def descendants(c, volume_id: int, path: str) -> DataFrame:
    """All folders below one, reserved ones pruned."""
    below = F.lit(True) if path == "" else F.col("path").startswith(path + "/")
    return c.folders.where((F.col("volume_id") == volume_id) & (F.col("path") != path) & below & ~p.reserved_folder(F.col("path")))


def folder_digests(hashes: DataFrame) -> DataFrame:
    """Each folder with its children's names and digests."""
    child = hashes.where("path <> ''").select("volume_id", p.parent(F.col("path")).alias("path"), p.last_segment(F.col("path")).alias("name"), F.col("deep").alias("child"))
    lists = child.groupBy("volume_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "child"))), lambda x: F.concat_ws(":", x["name"], x["child"])), ",").alias("children"))
    return hashes.join(lists, ["volume_id", "path"], "left").select("volume_id", "path", "shallow", "deep", F.coalesce("children", F.lit("")).alias("children"))
