"""Text, age, digest and name expressions (Column to Column), and a few driver-side rules."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9
NAME = "^[A-Za-z0-9][A-Za-z0-9_-]*$"


def _unit(ns, unit, mark: str):
    return F.concat(F.floor(ns / F.lit(unit)).cast("long").cast("string"), F.lit(mark))


def human_age(ns):
    """F2"""
    return F.when(ns < MINUTE, _unit(ns, SECOND, "s")).when(ns < HOUR, _unit(ns, MINUTE, "m")).when(ns < DAY, _unit(ns, HOUR, "h")).otherwise(_unit(ns, DAY, "d"))


def human_bytes(n):
    """one decimal, ties to the even digit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, x in enumerate("KMGTPE"):
        out = F.when(n >= 1024 ** (i + 1), F.format_string(f"%.1f {x}iB", F.bround(n / F.lit(float(1024 ** (i + 1))), 1))).otherwise(out)
    return out


def human_duration(ns):
    """the two largest units, the smaller left out when zero."""
    ns = F.greatest(ns, F.lit(0))

    def two(big, a, small, b):
        rest = F.floor((ns % F.lit(big)) / F.lit(small)).cast("long")
        return F.when(rest == 0, _unit(ns, big, a)).otherwise(F.concat(_unit(ns, big, a), F.lit(" "), rest.cast("string"), F.lit(b)))

    return F.when(ns < MINUTE, _unit(ns, SECOND, "s")).when(ns < HOUR, two(MINUTE, "m", SECOND, "s")).when(ns < DAY, two(HOUR, "h", MINUTE, "m")).otherwise(two(DAY, "d", HOUR, "h"))


def run_duration(started, ended):
    """null while running."""
    return ended - started


def age_since(instant, now):
    """Null without an instant, never negative."""
    return F.when(instant.isNotNull(), F.greatest(F.lit(0), now - instant))


def elapsed_since(started, ended, now):
    """F9"""
    return now - F.coalesce(ended, started)


def truncated(text, most: int = 60):
    """F10"""
    return F.when(text.isNull(), "").when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def hex_short(data, n: int):
    """F12"""
    return F.lower(F.substring(F.hex(data), 1, 2 * n))


def hex_or_empty(data):
    """F13"""
    return F.coalesce(F.lower(F.hex(data)), F.lit(""))


def digest_or_null(text):
    """F14"""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def node_name(host):
    """F15"""
    plain = F.regexp_replace(F.regexp_replace(host, "[^A-Za-z0-9_-]", "-"), "^[-_]+", "")
    return F.nullif(plain, F.lit(""))


def short_hash(seed):
    """F16"""
    return F.substring(F.sha2(seed, 256), 1, 12)


def valid_name(name):
    """F17"""
    return F.coalesce(name.rlike(NAME), F.lit(False))


def join_keys(keys):
    """F18"""
    return F.array_join(keys, ",")


def split_keys(text):
    """F19"""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def nullable(text):
    """F20"""
    return F.nullif(text, F.lit(""))


def without_escapes(text):
    """F21"""
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def is_snapshot(name):
    """F22"""
    return name.startswith("index-") & name.endswith(".db")


def run_id_of(name, prefix: str = "run-"):
    """a canonical positive number only."""
    return F.nullif(F.regexp_extract(name, f"^{prefix}([1-9][0-9]*)$", 1), F.lit("")).cast("long")


def parse_age(text: str) -> int:
    """nanoseconds of 90s, 15m, 12h or 30d."""
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m:
        raise ValueError(f"not an age: {text!r}")
    return int(m[1]) * {"s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}[m[2]]


def marker(text):
    """F28"""
    return F.from_json(text, "volume string, node string, created_at string")


def marker_valid(text, expected):
    """F29"""
    return F.coalesce(marker(text)["volume"] == expected, F.lit(False))


def version_at_least(major, minor, patch, least: tuple[int, int, int]):
    """F30"""
    return F.struct(*[x.cast("long") for x in (major, minor, patch)]) >= F.struct(*[F.lit(x).cast("long") for x in least])


def apple_double(listing):
    """companions `._x` whose sibling x is listed; listing: folder, name."""
    names = listing.select("folder", F.concat(F.lit("._"), F.col("name")).alias("name"))
    return listing.join(names, ["folder", "name"], "left_semi")


def digest(data):
    """SHA-256 stands for every content digest here."""
    return F.sha2(data, 256)


def naming_key(password: str, salt: str) -> bytes:
    """a driver-side key derivation."""
    return hashlib.scrypt(password.encode(), salt=salt.encode() or b"\0" * 16, n=1 << 14, r=8, p=1, dklen=32)


def evidence_label(has, local, age, max_age, stale):
    """F34"""
    text = F.coalesce(human_age(age), F.lit("unknown"))
    text = F.when(max_age > 0, F.concat(text, F.lit(" / "), human_age(max_age))).otherwise(text)
    return F.when(~has | ~local, "—").otherwise(F.concat(text, F.when(stale, " STALE").otherwise("")))


def offload_label(applicable, ready_bytes, ready_files, present_bytes, present_files):
    """F35"""
    text = F.concat(F.lit("offloadable now: "), human_bytes(ready_bytes), F.lit(" ("), ready_files.cast("string"), F.lit(" files) of "), human_bytes(present_bytes), F.lit(" present ("), present_files.cast("string"), F.lit(" files)"))
    return F.when(~applicable, "offload: no policy").otherwise(text)


def state_label(standing, outcome, is_target, age, level):
    """F36"""
    return (
        F.when(standing.isin("alarm", "refused"), standing).when(standing == "needs-bootstrap", "needs-init").when(outcome.isin("failed", "partial"), outcome)
        .when(~is_target, "—").when(age.isNull(), "never-synced").when(level == 2, "late").when(level == 3, "stalled").otherwise("ok")
    )


def fleet_label(stale, state):
    """F37"""
    return F.when(stale, "unknown").otherwise(state)


def traffic_light(level):
    """F38"""
    return F.when(level == 2, "amber").when(level == 3, "red").otherwise("green")


def role_label(sync_target, required):
    """F39"""
    return F.when(sync_target & required, "sync+offload").when(sync_target, "sync").when(required, "offload").otherwise("—")


def rate(done, elapsed_s):
    """F41"""
    return F.when(elapsed_s <= 0, 0.0).otherwise(done / elapsed_s)


def eta(left, per_second):
    """F42"""
    return F.when(per_second > 0, left / per_second)


def crumbs(path):
    """(label, prefix, active) along a path."""
    parts = F.split(path, "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(parts[i - 1].alias("label"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), (i == F.size(parts)).alias("active")))
    return F.when(path == "", F.array().cast("array<struct<label:string,prefix:string,active:boolean>>")).otherwise(steps)


def peer_label(name, peer_id, correlated):
    """F44"""
    who = F.coalesce(name, F.concat(F.lit("node-"), peer_id.cast("string")))
    return F.when(peer_id.isNull(), "").when(correlated.isNull(), who).otherwise(F.concat(who, F.lit("#"), correlated.cast("string")))


def durable_label(tracked, local, covered):
    """F45"""
    return F.when(~tracked, "—").when(~local, "n/a").when(covered, "yes").otherwise("no")


def fresher(a, b):
    """F48"""
    return F.least(a, b)


def older(a, b):
    """F49"""
    return F.greatest(a, b)


def negotiated(requested, lowest: int = 1, highest: int = 3):
    """X14"""
    return F.least(F.greatest(requested, F.lit(lowest)), F.lit(highest))


def hook_status(exit_code, timed_out):
    """X4"""
    return F.when(timed_out, "timeout").when(exit_code == 0, "success").otherwise("failed")
