"""Sources: trees, manifests, listings, logs, snapshots, configuration."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, blake3 string, status string, size_bytes long, mtime_ns long"
PLACEMENT = "blake3 string, pack string, offset long, length long"


def manifests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """S13, K1's reader: manifest lines with the run of their file; a digest that is not 64 hex digits fails."""
    rows = spark.read.schema(MANIFEST).json(paths).withColumn("run_id", F.regexp_extract(F.input_file_name(), r"run-([1-9][0-9]*)", 1).cast("long"))
    checked = F.when(F.col("blake3").rlike("^[0-9a-fA-F]{64}$"), F.lower("blake3")).otherwise(F.raise_error(F.concat(F.lit("bad digest at "), F.col("path"))).cast("string"))
    return rows.withColumn("blake3", checked)


def replay(rows: DataFrame) -> DataFrame:
    """Present lines only, then the latest run of each path: a later missing line does not undo an earlier present one."""
    rest = F.struct("blake3", "size_bytes", "mtime_ns", "run_id")
    return rows.where("status = 'present'").groupBy("path").agg(F.max_by(rest, "run_id").alias("r")).select("path", "r.*")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A JSON listing with a map of hashes."""
    return spark.read.schema("Path string, Name string, Size long, IsDir boolean, Hashes map<string,string>").option("multiLine", "true").json(path).toDF("path", "name", "size_bytes", "is_dir", "hashes")


def transfer_log(lines: DataFrame) -> DataFrame:
    """JSON lines among plain text (column value), batch or stream: stats, error or text rows."""
    got = F.from_json("value", "level string, msg string, stats struct<bytes: long, transfers: long, errors: long, fatalError: boolean>")
    rows = lines.withColumn("j", got)
    kind = F.when(F.col("j.stats").isNotNull(), "stats").when(F.col("j.level") == "error", "error").otherwise("text")
    return rows.select(kind.alias("kind"), "j.stats.*", F.coalesce("j.msg", "value").alias("message"))


def path_set(spark: SparkSession, path: str) -> DataFrame:
    """S15"""
    return spark.read.text(path).select(F.col("value").alias("path")).where("path <> ''").distinct()


def snapshot_names(names: DataFrame) -> DataFrame:
    """Index-<time>-run-<id>.db to time and run, newest first; other names keep nulls. names: volume, name."""
    stamp = F.regexp_extract("name", r"^index-(\d{8}T\d{6})Z?-run-(\d+)\.db$", 1)
    run = F.regexp_extract("name", r"^index-(\d{8}T\d{6})Z?-run-(\d+)\.db$", 2)
    return names.select(
        "volume", "name", F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmmss")).alias("taken_at"), F.nullif(run, F.lit("")).cast("long").alias("run_id")
    ).orderBy(F.desc("taken_at"), "volume", "name")


def checked_listing(listed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Listed files that are recorded carry a hash, or are unchecked where none could be read."""
    return listed.join(recorded.select("name"), "name", "left_semi").withColumn("unchecked", F.col("checksum").isNull())


def configuration(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Volumes, targets, required targets and destinations of a TOML file."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    volumes = raw.get("volumes", {})
    pairs = lambda key: [(v, i, t) for v, x in volumes.items() for i, t in enumerate(x.get(key, []))]
    return {
        "volumes": spark.createDataFrame([(n, x["path"]) for n, x in volumes.items()], "name string, path string"),
        "sync_to": spark.createDataFrame(pairs("sync_to"), "volume string, ordinal int, target string"),
        "offload_requires": spark.createDataFrame(pairs("offload_requires"), "volume string, ordinal int, target string"),
        "destinations": spark.createDataFrame([(n, x.get("type", ""), x.get("layout", "mirror")) for n, x in raw.get("destinations", {}).items()], "name string, type string, layout string"),
    }


def catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the snapshot that the pointer names, if this engine knows its version."""
    from cairn.sources.sinks import VERSION

    head = spark.read.json(f"{path}/CURRENT").first()
    if head["version"] > VERSION:
        raise ValueError(f"catalog version {head['version']} is newer than {VERSION}")
    return {t: spark.read.parquet(f"{path}/{head['snapshot']}/{t}") for t in head["tables"].split(",")}
