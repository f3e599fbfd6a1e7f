"""Contiguous byte-balanced shards from global prefix sums (DataFrame functions only).

Rows are ordered by (key, text_crc32, size). One range partitioning of the three
narrow columns gives ordered partitions; each partition's byte and row totals,
summed over the partitions before it, are its offsets, so the global prefix of
every row is its partition's offset plus a running sum inside the partition.
A row belongs to the shard that holds the midpoint of its byte range, so shards
are contiguous and differ from the target by at most half a row at each end.

Defined cases: a null text has size `overhead` and the checksum of no bytes; null
keys sort first; repeated rows are separate rows; an empty table gives no rows;
with fewer rows than shards some shards stay empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import boxed, settle, text_of


def byte_shards(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row of `docs` in one of `n_shards` shards."""
    order = [key, "text_crc32", "size"]
    narrow = docs.select(
        F.col(key),
        (F.octet_length(text_of(text)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"),
    )
    ranged = settle(narrow.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition, so its size is bounded by the partition count.
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_offset"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_end", F.sum("size").over(upto)).withColumn("_rank", F.row_number().over(inside))
    placed = placed.join(F.broadcast(offsets), "_part").select(
        key, "size", "text_crc32",
        F.expr(f"least({n_shards - 1}, (2 * (_byte_offset + _end) - size) * {n_shards} div (2 * _total))").cast("int").alias("shard"),
        (F.col("_row_offset") + F.col("_rank") - 1).alias("_global"),
    )
    placed = settle(placed)
    first = placed.groupBy("shard").agg(F.min("_global").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("_global") - F.col("_first")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, key: str = "doc_id") -> None:
    """Write every row of `docs` as a struct `row`, with its slot, under its shard's folder, in slot order.

    A struct, so that no column of `docs` can clash with shard and slot. Each shard is one folder of one or more files; rows with the same (key, checksum, size) are
    interchangeable, so any of their slots may fall to any of them.
    """
    marks = ["size", "text_crc32"]
    plan = byte_shards(docs, n_shards, key).withColumnRenamed(key, "id")
    plan = plan.withColumn("copy", F.row_number().over(Window.partitionBy("id", *marks).orderBy("shard", "slot")))
    plan = plan.select(F.col("id").alias("pid"), F.col("size").alias("psize"), F.col("text_crc32").alias("pcrc"), F.col("copy").alias("pcopy"), "shard", "slot")
    rows = boxed(docs, F.col(key).alias("id"), (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", *marks).orderBy(F.lit(0))))
    same = F.col("id").eqNullSafe(F.col("pid")) & (F.col("size") == F.col("psize")) & (F.col("text_crc32") == F.col("pcrc")) & (F.col("copy") == F.col("pcopy"))
    # Ranges of (shard, slot), as many as the session's shuffles have: a shard may be several files in order.
    out = rows.join(plan, same).select("row", "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.select("row", "slot", "shard").write.partitionBy("shard").parquet(path)
