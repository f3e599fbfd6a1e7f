"""Shared ground of the training-data operators: scratch tables, sessions, shipping."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list[tuple[SparkSession, str]] = []


def ship(module_name: str) -> None:
    """Pickle the module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it again.

    The files survive the loss of any executor and are removed when the session's
    Python ends, or by `release`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _scratch.append((spark, path))
    again = spark.read.schema(df.schema).parquet(path)
    again._cairn_path = path
    return again


def release(*frames: DataFrame) -> None:
    """Delete the files of settled frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_cairn_path", None)
        if path:
            _delete(df.sparkSession, path)
            _scratch[:] = [x for x in _scratch if x[1] != path]


def free_shuffles() -> None:
    """Have Spark drop the shuffle files of finished phases, whose results are settled.

    It does so when the driver's collector finds their plans unused; in a job of many
    phases on a driver with memory to spare that may be long after.
    """
    import gc

    from pyspark import SparkContext

    gc.collect()
    SparkContext._active_spark_context._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone; the files then go with the folder
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, *keys) -> DataFrame:
    """All columns of `docs` as one struct `row`, beside `keys`: no name of a later join can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), *keys)


def text_of(column: str = "text"):
    """A null text counts as empty everywhere."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int):
    """crc32 of the id's decimal text, modulo the number of folds; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds
