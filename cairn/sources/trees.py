"""Directory trees: every entry below a root, whatever its name, size or kind.

Spark's own file scan leaves out empty files and names that begin with a dot or an
underscore, and holds a file's content in one row. Here the executors list folders and
stream contents themselves, so a file may be of any size. A root without a scheme, or
with `file:`, must be mounted where the executors run; other schemes go through pyarrow.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.shipping import ship

ENTRY = "path string, kind string, size_bytes long, mtime_ns long, error string"
HASHED = "path string, size_bytes long, mtime_ns long, blake3 string, error string"
#: Folders are dealt out once there are so many of them.
UNITS = 256
CHUNK, BATCH = 8 << 20, 10_000


def _local(root: str) -> str | None:
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return None if "://" in root else root


def _remote(root: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(root)


def _kind(mode: int) -> str:
    """S21"""
    return "file" if stat.S_ISREG(mode) else "dir" if stat.S_ISDIR(mode) else "symlink" if stat.S_ISLNK(mode) else "other"


def _list(root: str, folder: str) -> Iterator[tuple]:
    """(path, kind, size, time, error) of a folder's entries; what cannot be read is a row with its error."""
    at = lambda name: f"{folder}/{name}" if folder else name
    try:
        if (base := _local(root)) is None:
            import pyarrow.fs as fs

            system, base = _remote(root)
            for x in system.get_file_info(fs.FileSelector(os.path.join(base, folder) if folder else base)):
                kind = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(x.type, "other")
                yield at(x.base_name), kind, x.size if kind == "file" else None, x.mtime_ns, None
            return
        with os.scandir(os.path.join(base, folder)) as found:
            for x in found:
                try:
                    name = x.name.encode().decode()
                except UnicodeEncodeError:
                    yield at(x.name.encode("utf-8", "backslashreplace").decode()), "other", None, None, "the name is not UTF-8"
                    continue
                try:
                    s = x.stat(follow_symlinks=False)
                    kind = _kind(s.st_mode)
                    yield at(name), kind, s.st_size if kind == "file" else None, s.st_mtime_ns, None
                except OSError as e:
                    yield at(name), "other", None, None, str(e)
    except OSError as e:
        yield folder, "dir", None, None, str(e)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)


def _walk(root: str):
    def below(batches) -> Iterator[tuple]:
        for batch in batches:
            for unit in batch.to_pylist():
                left = [unit["folder"]]
                while left:
                    for row in _list(root, left.pop()):
                        yield row
                        if unit["deep"] and row[1] == "dir" and row[4] is None:
                            left.append(row[0])

    def run(batches):
        s, i = pa.string(), pa.int64()
        return _batches(below(batches), ["path", "kind", "size_bytes", "mtime_ns", "error"], [s, s, i, i, s])

    return run


def _hash(root: str):
    def one(path: str) -> tuple:
        """The digest of what is read, and size and time of the open file after that."""
        h = hashlib.sha256()
        try:
            if (base := _local(root)) is not None:
                with open(os.path.join(base, path), "rb") as f:
                    while data := f.read(CHUNK):
                        h.update(data)
                    s = os.fstat(f.fileno())
                return path, s.st_size, s.st_mtime_ns, h.hexdigest(), None
            system, base = _remote(root)
            full, size = os.path.join(base, path), 0
            with system.open_input_stream(full) as f:
                while data := f.read(CHUNK):
                    h.update(data)
                    size += len(data)
            return path, size, system.get_file_info(full).mtime_ns, h.hexdigest(), None
        except OSError as e:
            return path, None, None, None, str(e)

    def run(batches):
        s, i = pa.string(), pa.int64()
        rows = ((x["path"], None, None, None, x["error"]) if x["error"] else one(x["path"]) for b in batches for x in b.to_pylist())
        return _batches(rows, ["path", "size_bytes", "mtime_ns", "blake3", "error"], [s, i, i, s, s])

    return run


def _tasks(spark: SparkSession) -> int:
    """A stated number, which adaptive execution leaves alone: rows are small here, what they stand for is not."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below a root with its kind; links are not followed.

    The driver opens folders, level by level, only until there are enough to deal out;
    it keeps their names and nothing of the files in them.
    """
    shallow, deep = [], [""]
    while deep and len(deep) < UNITS:
        shallow += deep
        deep = [x[0] for f in deep for x in _list(root, f) if x[1] == "dir" and x[4] is None]
    units = [(f, False) for f in shallow] + [(f, True) for f in deep]
    dealt = spark.createDataFrame(units, "folder string, deep boolean").repartition(min(len(units), _tasks(spark)))
    return dealt.mapInArrow(_walk(root), ENTRY)


def tree(spark: SparkSession, root: str, with_digest: bool = True, marker: str = ".cairn-volume") -> DataFrame:
    """The regular files below a root, but the root's marker: path, size, time, digest, companion, error.

    What cannot be listed or read is a row with its error and null otherwise. Without
    digests no content is read. Files are dealt out again before they are read, for one
    folder may hold most of them.
    """
    root = root.rstrip("/") or "/"
    found = entries(spark, root).where(((F.col("kind") == "file") | F.col("error").isNotNull()) & (F.col("path") != marker))
    if with_digest:
        found = found.select("path", "error").repartition(_tasks(spark), "path").mapInArrow(_hash(root), HASHED)
    columns = ["path", "size_bytes", "mtime_ns", *(["blake3"] if with_digest else [])]
    return found.select(*columns, F.col("path").rlike(r"(^|/)\._[^/]+$").alias("companion"), "error")


ship(__name__)
