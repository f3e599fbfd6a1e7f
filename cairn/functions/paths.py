"""Path, digest and reserved-subtree expressions (Column to Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = ".cairn-"
#: Four lists that differ on purpose: each consumer hides another set of subtrees.
HIDDEN_IN_QUERIES = tuple(PREFIX + x for x in ("conflicts", "history", "staging", "packs", "index"))
HIDDEN_IN_DEDUP = tuple(PREFIX + x for x in ("conflicts", "history", "staging"))
HIDDEN_IN_OFFLOAD = tuple(PREFIX + x for x in ("conflicts", "history", "packs", "index"))
HIDDEN_IN_SYNC = HIDDEN_IN_QUERIES


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def hidden_in_queries(path: Column) -> Column:
    """P11's filter: case-insensitive, files below a reserved folder."""
    return _any(F.lower(path).startswith(x + "/") for x in HIDDEN_IN_QUERIES)


def hidden_in_dedup(path: Column) -> Column:
    return _any(F.lower(path).startswith(x + "/") for x in HIDDEN_IN_DEDUP)


def under_reserved(path: Column) -> Column:
    """A reserved folder itself or anything below it, case-sensitive."""
    return _any((path == x) | path.startswith(x + "/") for x in HIDDEN_IN_OFFLOAD)


def reserved_file(path: Column) -> Column:
    """P67"""
    return _any(path.startswith(x + "/") for x in HIDDEN_IN_SYNC)


def reserved_folder(path: Column) -> Column:
    """P68"""
    return path.isin(*HIDDEN_IN_SYNC) | reserved_file(path)


def joined(folder: Column, name: Column) -> Column:
    """The path of a name in a folder."""
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def parent(path: Column) -> Column:
    """The path without its last segment, '' at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def last_segment(path: Column) -> Column:
    """H11"""
    return F.substring_index(path, "/", -1)


def split_file(path: Column) -> Column:
    """H9: struct(folder, name)"""
    return F.struct(parent(path).alias("folder"), last_segment(path).alias("name"))


def first_segments(path: Column, n: Column) -> Column:
    """The path cut after its first n segments."""
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/")


def ancestors(path: Column) -> Column:
    """every folder above the path, outermost first, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )


def closure(path: Column) -> Column:
    """The root, every ancestor and the path itself."""
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), ancestors(path), F.array(path)))


def relative(base: Column, path: Column) -> Column:
    """P3: '.' when equal, the rest when below, null when outside."""
    return F.when(path == base, ".").when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path)))


def join_volume(volume_path: Column, rel: Column) -> Column:
    """F26"""
    return F.when(rel.isin("", "."), volume_path).otherwise(F.concat_ws("/", volume_path, rel))


def is_hash(text: Column) -> Column:
    """P57"""
    return text.rlike("^[0-9a-fA-F]{64}$")


def valid_relative(path: Column) -> Column:
    """Relative, no empty or dot segments, no NUL, no escape, not reserved."""
    parts = F.split(path, "/")
    plain = ~F.exists(parts, lambda x: x.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.contains("\x00") & plain & ~reserved_folder(path), F.lit(False))


def valid_folder(path: Column) -> Column:
    """P69, or the root."""
    return (path == "") | valid_relative(path)


def escape_like(text: Column) -> Column:
    r"""%, _ and \ made literal for LIKE."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
