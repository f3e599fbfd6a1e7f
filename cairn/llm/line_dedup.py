"""Line deduplication by an exact set-similarity join (DataFrame functions only).

A line's tokens are its distinct five-word shingles; a line of one to four words has one
token, its whole word sequence. A line is removed if an earlier line, by (document, line
number), has a Jaccard similarity of at least 0.8 with it. Lines with equal token sets are
one class, so exact copies are one row from step 2 on.

1. One pass over the texts writes the class of every line and the first q of its tokens in
   hash order, q = n - ceil(0.8 n) + floor(n / 20) + 1. Two similar lines of n and m <= n tokens
   share floor(m / 20) + 1 of these at least, which is floor(n / 25) + 1 or more.
2. A semi-join finds those of these tokens that another class holds as well. A line with fewer than
   floor(n / 25) + 1 of them is similar to no other and drops out. Of a class with more than
   64 copies only the first place takes part, so no token has a long list of one class.
3. Rarity: all tokens of the lines left are counted exactly. A line with fewer than
   ceil(0.8 n) tokens that another line holds drops out as well: in the order of rarity its
   whole prefix is its own. So a passage that many otherwise different lines share pairs
   none of them.
4. Prefix filter: tokens are ordered by (count, hash); of n tokens the first n - ceil(0.8 n) + 1
   are the prefix, and those that are shared are the line's keys. Length and positional filters
   follow, and a bound on the difference: each line's shared tokens leave 256 parity
   bits, and two sets differ in at least as many tokens as their bits do.
5. A line is first held against the earliest line of each key; only lines that this does not
   match go on to the lines of rank 2-16, 17-256 and so on. So a family of thousands of near copies
   costs a few pairs a line, not all pairs, and yet no pair is given up.
6. Verification: exact Jaccard over the whole token sets.

A token is the 64-bit hash of its words and a class the 64-bit hash of a token set (128 bits where
equal lines are told from different ones), so a wrong verdict takes a collision of two of them.

Why shingles and not single words as tokens: words of an ordinary vocabulary return in lines
that have nothing in common, and the lines that share one multiply with the corpus.

Defined cases: a null text has no lines; blank lines stay; very long lines are sets like any
other, in rows of 8 bytes a token; a null id sorts first; rows that repeat both id and
text lose the same lines; rows that share an id with different texts are ordered by their
texts' hashes; of equal lines the first place stays; an empty table gives no rows; extra columns,
whatever their names, are kept by `without_repeats` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import boxed, free_shuffles, release, settle, text_of

WIDTH = 5
SIMILAR = 0.8
#: Smaller sets are similar to no set but their equals.
LEAST = 4
PLACE = ["k", "h", "line"]
#: Tables up to these counted rows (16 to 60 bytes each) are broadcast; larger ones are shuffled.
FEW_LINES, FEW_PAIRS = 400_000, 200_000
#: Classes with more copies than these are held against others by their first place only.
COPIES = 64
#: Tokens that one task of the join by tokens holds, 70 bytes each; a token of more lines than that stays in one task.
TOKENS = 1_000_000


def _let(value, use):
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_tokens(rows: DataFrame, line, *keep) -> DataFrame:
    """`keep` and s, the distinct tokens of a line in hash order."""

    def shingles(h):
        each = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WIDTH)]))  # the last four reach beyond the line
        return F.struct(F.size(h).alias("n"), F.xxhash64(h).alias("whole"), each.alias("each"))

    words = F.array_remove(F.split(line, " "), "")
    # Lambdas are interpreted. What stands in the second step, which the optimiser keeps apart, is generated code on plain longs.
    hashed = rows.select(*keep, _let(F.transform(words, lambda w: F.xxhash64(w)), shingles).alias("_z"))
    n = F.col("_z.n")
    long = F.sort_array(F.array_distinct(F.slice("_z.each", F.lit(1), n - WIDTH + 1)))
    s = F.when(n >= WIDTH, long).when(n > 0, F.array("_z.whole")).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(*[c for c in hashed.columns if c != "_z"], s.alias("s"))


def _plain(text):
    """`text` with every other word separator but newlines as a space: a literal split is much the faster one."""
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _place(docs: DataFrame, key: str) -> list:
    """The document's part of a place; a null id sorts first."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text_of()).alias("h")]


def _needed(n):
    """Tokens of n that a similar line must share."""
    return F.ceil(F.lit(SIMILAR) * n - F.lit(1e-9))


def _head(n):
    """Tokens of n that stand at the head."""
    return F.when(n < LEAST, 0).otherwise(F.least(n, (n - _needed(n) + F.floor(n / 20) + 1).cast("int")))


def _lines(docs: DataFrame, key: str) -> DataFrame:
    """(k, h, line, n_lines, no_key, c, c2, n, head): every line's class, size and first tokens in hash order."""
    # What is the document's is computed before the lines are; behind them it would be computed for each line.
    split = F.split(_plain(text_of()), "\n")
    texts = docs.select(*_place(docs, key), F.col(key).isNull().alias("no_key"), F.size(split).cast("long").alias("n_lines"), split.alias("_all"))
    rows = texts.select("k", "h", "no_key", "n_lines", F.posexplode_outer("_all").alias("line", "_text"))  # outer: no filter that splits again
    sets = _with_tokens(rows, F.col("_text"), *PLACE, "n_lines", "no_key")  # no filter here, which the optimiser would compute the tokens twice for
    n = F.size("s")
    head = F.slice("s", F.lit(1), _head(n))
    return sets.select(*PLACE, "n_lines", "no_key", F.xxhash64("s").alias("c"), F.xxhash64(F.lit(1), F.col("s")).alias("c2"), n.alias("n"), head.alias("head"))


def _copied(lines: DataFrame) -> DataFrame:
    """(c, c2, _first, _n): the classes of more than one line, their first places and their lines."""
    found = lines.groupBy("c", "c2").agg(F.min(F.struct(*PLACE)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return settle(found.where("_n > 1"))


def _shared(lines: DataFrame, copied: DataFrame) -> DataFrame:
    """(c, t): the tokens at the head that another class holds at its head; of a class of many lines only the first takes part."""
    often = copied.where(F.col("_n") > COPIES).select("c", "c2", "_first")
    long = lines.where(F.col("n") >= LEAST)
    tokens = long.agg(F.sum(_head(F.col("n")))).first()[0] or 0
    places = long.join(F.broadcast(often) if often.count() <= FEW_LINES else often, ["c", "c2"], "left")
    places = places.where(F.col("_first").isNull() | (F.struct(*PLACE) == F.col("_first")))
    # One exchange serves both sides. _at, which is never negative, keeps the optimiser from moving the join before it.
    dealt = places.select("c", F.explode("head").alias("t")).repartition(tokens // TOKENS + 1, "t").withColumn("_at", F.spark_partition_id())
    another = (F.col("a.t") == F.col("b.t")) & (F.col("a.c") != F.col("b.c")) & (F.col("a._at") >= 0) & (F.col("b._at") >= 0)
    return dealt.alias("a").join(dealt.alias("b").hint("shuffle_hash"), another, "left_semi").select("c", "t").distinct()


def _survivors(lines: DataFrame, copied: DataFrame) -> DataFrame:
    """(c, p): the classes with enough shared tokens at the head, and their first places."""
    held = settle(_shared(lines, copied).groupBy("c").agg(F.count(F.lit(1)).alias("_m")))
    free_shuffles()
    enough = F.col("_m") >= F.floor(F.col("n") / 25) + 1
    first = settle(lines.select(*PLACE, "c", "n").join(held, "c").where(enough).groupBy("c").agg(F.min(F.struct(*PLACE)).alias("p")))
    release(held)
    return first


def _sets(docs: DataFrame, key: str, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(c, p, s): the whole token sets of these classes, from their first lines."""
    wanted = first.select("c", "p.*").groupBy("k", "h").agg(F.collect_list(F.struct("line", "c")).alias("want"))
    rows = docs.select(*_place(docs, key), text_of().alias("text"))
    if lines.where("line = 0").groupBy("k", "h").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").limit(1).count():
        rows = rows.dropDuplicates(["k", "h"])  # rows that repeat id and text
    texts = rows.join(F.broadcast(wanted) if first.count() <= FEW_LINES else wanted, ["k", "h"])
    chosen = _let(F.split(_plain(F.col("text")), "\n"), lambda x: F.transform("want", lambda w: F.struct(w["line"].alias("line"), w["c"].alias("c"), F.get(x, w["line"]).alias("t"))))
    each = texts.select("k", "h", F.explode_outer(chosen).alias("w"))
    return settle(_with_tokens(each, F.col("w.t"), "w.c", F.struct("k", "h", "w.line").alias("p")))


def _parity(part: int):
    """Of 64 bits, those that an odd number of the shared tokens of a quarter fall on."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t").bitwiseAND(63).cast("int"))
    return F.bit_xor(F.when(F.shiftrightunsigned("t", 6).bitwiseAND(3) == part, bit).otherwise(F.lit(0).cast("long")))


def _keys(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, c, n, i, p, own, x0..x3): the shared tokens of every prefix in the order of rarity, with their positions; and the sets of these classes."""
    single = sets.select("c", F.size("s").alias("n"), F.explode("s").alias("t"))
    tokens = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    # One exchange serves the counts and the tokens they join: _all has them read every column, else the optimiser sends a narrower table for them.
    dealt = single.repartition(tokens // TOKENS + 1, "t").withColumn("_at", F.spark_partition_id())
    counts = dealt.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max(F.col("c").bitwiseXOR(F.col("n") + F.col("_at"))).alias("_all"))
    shared = counts.where("df > 1 AND _all IS NOT NULL").select("t", "df")
    line = Window.partitionBy("c")  # one line's tokens
    held = dealt.where("_at >= 0").drop("_at").join(shared.hint("shuffle_hash"), "t").withColumn("m", F.count(F.lit(1)).over(line.orderBy("df", "t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    held = settle(held.withColumn("r", F.row_number().over(line.orderBy("df", "t"))).where(F.col("m") >= _needed(F.col("n"))).select("c", "n", "m", "t", "r"))
    free_shuffles()
    marks = held.groupBy("c").agg(*[_parity(j).alias(f"x{j}") for j in range(4)])
    left = settle(sets.join(marks, "c"))
    keys = held.where(F.col("r") <= F.col("m") - _needed(F.col("n")) + 1).select("t", "c", "n", (F.col("n") - F.col("m") + F.col("r") - 1).alias("i"), (F.col("n") - F.col("m")).alias("own"))
    keys = settle(keys.join(left.drop("s"), "c"))
    release(held)
    free_shuffles()
    return keys, left.select("c", "s")


def _ranked(keys: DataFrame) -> DataFrame:
    """`keys` with r, the rank of a line among those of its key by place.

    Range partitions may cut a key, so no task holds all the lines of a hot one.
    """
    parts = settle(keys.repartitionByRange("t", "p", "c").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("t", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("t").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    cut = settle(sizes.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").select("t", "_part", "_before"))
    own = F.row_number().over(Window.partitionBy("_part", "t").orderBy("p", "c"))
    ranked = parts.withColumn("_own", own).join(cut, ["t", "_part"], "left")
    return settle(ranked.select(*keys.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias("r")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b), the b whose similarity with a is enough."""
    pairs = settle(pairs)
    left, right = sets.select(F.col("c").alias("a"), F.col("s").alias("_s")), sets.select(F.col("c").alias("b"), F.col("s").alias("_t"))
    both = right.join(left.join(F.broadcast(pairs) if pairs.count() <= FEW_PAIRS else pairs, "a"), "b")
    shared = F.size(F.array_intersect("_s", "_t"))
    out = settle(both.where(shared >= F.lit(SIMILAR) * (F.size("_s") + F.size("_t") - shared) - 1e-9).select(F.col("b").alias("c")).distinct())
    release(pairs)
    free_shuffles()
    return out


def _possible():
    """What the lengths, the positions of the common token and the parities leave possible of a and the row's own line."""
    n, na = F.col("n"), F.col("na")
    most = F.least("ia", "i") + F.least(na - F.col("ia"), n - F.col("i"))  # shared before, at and behind the common token
    need = F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (na + n) - 1e-9)
    # Tokens in one line only: those that no other line has, and at least one for each bit that differs.
    odd = F.col("own") + F.col("owna")
    for j in range(4):
        odd = odd + F.bit_count(F.col(f"x{j}").bitwiseXOR(F.col(f"x{j}a")))
    return (na >= _needed(n)) & (n >= _needed(na)) & (most >= need) & (odd <= na + n - 2 * need)


def _matched(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(c): the classes with an earlier similar class."""
    ranked = _ranked(keys)
    last = ranked.agg(F.coalesce(F.max("r"), F.lit(0))).first()[0]
    marks = ["n", "i", "own", "x0", "x1", "x2", "x3"]
    earlier = ranked.select("t", F.col("c").alias("a"), F.col("p").alias("pa"), F.col("r").alias("ra"), *[F.col(x).alias(x + "a") for x in marks])
    # Most lines match the earliest line that they share a key with: one pair a line.
    met = ranked.where("r > 1").join(earlier.where("ra = 1"), "t").where(_possible())
    found = _verified(met.groupBy("c").agg(F.min(F.struct("pa", "a")).alias("_a")).select(F.col("_a.a").alias("a"), F.col("c").alias("b")), sets)
    left = settle(ranked.join(found, "c", "left_anti").where("r > 1"))
    low, high = 1, 1
    while low < last and left.limit(1).count():
        met = left.where(F.col("r") > low).join(earlier.where(F.col("ra").between(low, high)), "t").where((F.col("ra") < F.col("r")) & _possible())
        hits = _verified(met.select("a", F.col("c").alias("b")).distinct(), sets)
        found = found.unionByName(hits)
        low, high = high + 1, 16 * high
        left = settle(left.join(hits, "c", "left_anti").where(F.col("r") > low))
    return settle(found.distinct())


def _repeats(lines: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    lines = lines.where("n > 0")
    copied = _copied(lines)
    first = _survivors(lines, copied)
    free_shuffles()
    keys, sets = _keys(_sets(docs, key, lines, first))
    matched = _matched(keys, sets)
    known = copied.join(matched.withColumn("_hit", F.lit(True)), "c", "full_outer")
    known = settle(known.select("c", F.col("c2").alias("_c2"), "_first", F.coalesce("_hit", F.lit(False)).alias("_hit")))
    copy = (F.col("c2") == F.col("_c2")) & (F.struct(*PLACE) != F.col("_first"))
    gone = lines.select(*PLACE, "c", "c2").join(known, "c").where(F.col("_hit") | copy)
    return settle(gone.groupBy("k", "h").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(k, h, removed): for each document that loses lines, their numbers in ascending order."""
    return _repeats(settle(_lines(docs, key)), docs, key)


def report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_lines, n_removed, removed_lines) for every row."""
    lines = settle(_lines(docs, key))
    rows = lines.where("line = 0").select("k", "h", "no_key", "n_lines")  # a text has one line at least
    found = rows.join(_repeats(lines, docs, key), ["k", "h"], "left")
    return found.select(
        F.when(~F.col("no_key"), F.col("k")).cast(docs.schema[key].dataType).alias(key), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines")
    )


def without_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` without the removed lines; a document that loses its last words goes."""
    rows = boxed(docs, *_place(docs, key)).join(repeats(docs, key), ["k", "h"], "left")
    kept = _let(F.split(F.col("row.text"), "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: x[i]), "\n"))
    rows = rows.select("row", F.col("removed").isNotNull().alias("_cut"), F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept).alias("text"))
    rows = rows.where(~F.col("_cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = {"n_chars": lambda: F.when(F.col("_cut"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType), "text": lambda: F.col("text")}
    return rows.select(*[(chars[x]() if x in chars else F.col(f"row.`{x}`")).alias(x) for x in docs.columns])


def without_similar(rows: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of `rows`, those whose whole text has no similar one earlier in `docs`; rows with a null key stay and remove none."""
    whole = lambda: F.translate(text_of(), "\n", " ")
    gone = repeats(docs.where(F.col(key).isNotNull()).select(key, whole().alias("text")), key).select("k", "h")
    return boxed(rows, F.col(key).cast("long").alias("k"), F.xxhash64(whole()).alias("h")).join(gone, ["k", "h"], "left_anti").select("row.*")


#: The same join in DuckDB: similarity by counting common shingles.
ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), w AS (
  SELECT doc_id, line_no, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM l
), s AS (
  SELECT doc_id, line_no, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) ELSE [array_to_string(ws, ' ')] END AS ts
  FROM w WHERE len(ws) >= 1
), n AS (SELECT *, len(ts) AS n FROM s),
t AS (SELECT doc_id, line_no, n, unnest(ts) AS t FROM n),
o AS (
  SELECT b.doc_id, b.line_no, a.doc_id AS d, a.line_no AS m, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM t b JOIN t a ON a.t = b.t AND (a.doc_id, a.line_no) < (b.doc_id, b.line_no) GROUP BY 1, 2, 3, 4
), r AS (SELECT DISTINCT doc_id, line_no FROM o WHERE shared >= 0.8 * (na + nb - shared) - 1e-9),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed_lines FROM r GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines,
       coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""
