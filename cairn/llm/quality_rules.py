"""Quality rules and robust multivariate outliers (DataFrame functions only).

Base statistics come from every whole text. Documents that fail no base rule enter a
minimum-covariance-determinant estimate for their (lang, source); groups smaller than
`min_group` use their language's estimate, then the corpus's, and below that nothing is
judged. The estimate: a start from medians and median absolute deviations, then
concentration steps, each taking the mean and covariance of the `H` share of rows
with the smallest distances. Every step is one partially aggregated group-by over a
narrow table, so a source with a third of all rows costs no more than a small one.

The five transformed statistics are kept as integers (hundredths of logarithms), so
means and covariances are exact sums that do not depend on partitioning or order.

Defined cases: a null text is empty, has no words and fails the base rules; a null
lang or source is a group of its own; repeated rows are judged alike; an empty table
gives no rows; extra columns are ignored by `judge` and kept by `keep_clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import boxed, settle, text_of

SPACE = r"[\x20\x09-\x0D]+"
STATS = ["x1", "x2", "x3", "x4", "x5"]
#: Variances (in squared hundredths) no estimate may fall below: a statistic that hardly
#: varies in a group must not turn harmless differences into outliers.
FLOOR = [900.0, 400.0, 2500.0, 2500.0, 2500.0]
H = 0.75
#: Concentration steps; each can only lower the determinant.
STEPS = 4
#: Squared distance beyond which a row is an outlier. The 0.9999 quantile of chi-square
#: with five degrees is 25.7; concentrating on the share H shrinks the covariance about
#: twofold, and skewed statistics spread wider than a normal law, so the cut leaves room.
CUT = 60.0
MIN_GROUP = 200


def _let(value, use):
    """use(value) with `value` evaluated once: a projection may inline and repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(hashes):
    """Words covered by five-word windows that the text holds twice or more."""
    # A window is the hash of its five words' hashes; a text with fewer than six words repeats none.
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*[hashes[i + k] for k in range(5)]))

    def places(v):
        ordered = F.sort_array(F.transform(v, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(ordered, lambda s: F.filter(
            F.transform(s, lambda x, i: F.when(x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]), x["i"])), lambda x: x.isNotNull()
        ))
        # Each window found adds the words that the next one does not cover.
        return _let(F.sort_array(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x
        ))

    return F.when(F.size(hashes) < 6, 0).otherwise(_let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), 0).otherwise(places(v))))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    body = text_of(text)
    words = F.filter(F.split(body, SPACE), lambda x: x != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("again")
    ))
    out = docs.select(
        "*", of_words.alias("_w"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return out.select(
        *docs.columns, F.col("_w.n").cast("long").alias("n_words"), F.col("_w.chars").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("_w.again").cast("long").alias("n_repeat_words"),
    )


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _hundredths(x, scale: float):
    return F.floor(F.lit(100.0 * scale) * x + F.lit(0.5)).cast("long")


def transformed() -> list:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        _hundredths(F.log(n), 1.0).alias("x1"),
        # Thirty words of five characters stand for what is known before reading, so that
        # the mean of a short text counts for less.
        _hundredths(F.log((F.col("word_chars") + 150) / (n + 30.0)), 4.0).alias("x2"),
        _hundredths(F.log(1.0 + 1000.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))), 1.0).alias("x3"),
        _hundredths(F.log(1.0 + 100.0 * F.col("n_dup_lines") / n), 1.0).alias("x4"),
        _hundredths(F.log(1.0 + 100.0 * F.col("n_repeat_words") / n), 1.0).alias("x5"),
    ]


def _factor(groups: DataFrame) -> DataFrame:
    """From n, the sums s_i and the cross sums s_ij: means m_i and the Cholesky factor l_ij."""
    d = range(1, 6)
    out = groups.select("grp", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in d], *[
        (F.col(f"s{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n")) + F.lit(FLOOR[i - 1] if i == j else 0.0)).alias(f"c{i}{j}")
        for i in d for j in range(1, i + 1)
    ])
    for i in d:
        for j in range(1, i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(1, j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The floor on the diagonal keeps every pivot positive up to rounding.
            value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.drop(*[f"c{i}{j}" for i in d for j in range(1, i + 1)])


def _distance():
    z = []
    for i in range(1, 6):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(1, i):
            rest = rest - F.col(f"l{i}{k}") * z[k - 1]
        z.append(rest / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, "grp", "left")


def _sums(rows: DataFrame) -> DataFrame:
    d = range(1, 6)
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in d],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in d for j in range(1, i + 1)],
    )


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """Group, mean and Cholesky factor of the concentrated covariance; rows: grp, x1..x5."""
    d = range(1, 6)
    # The statistics are bounded small integers, so exact percentiles keep bounded counts.
    mid = rows.groupBy("grp").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in d])
    off = _with_groups(rows, mid, few).select("grp", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"a{i}") for i in d])
    mad = off.groupBy("grp").agg(*[F.percentile(f"a{i}", F.lit(0.5)).alias(f"a{i}") for i in d])
    now = mid.join(mad, "grp").select(
        "grp", *[f"m{i}" for i in d],
        *[(F.sqrt(2.198 * F.col(f"a{i}") * F.col(f"a{i}") + F.lit(FLOOR[i - 1])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in d for j in range(1, i + 1)],
    )
    for _ in range(STEPS):
        near = _with_groups(rows, settle(now), few).select("grp", *STATS, F.floor(100.0 * F.log(1.0 + _distance())).cast("long").alias("q"))
        near = settle(near)
        cut = near.groupBy("grp").agg(F.percentile("q", F.lit(H)).alias("cut"))
        now = _factor(_sums(_with_groups(near, cut, few).where(F.col("q") <= F.col("cut"))))
    return settle(now)


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept), a row for each row of docs."""
    have = set(docs.columns)
    group = [(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) if c in have else F.lit("-")).alias(f"_{c}") for c in ("lang", "source")]
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = settle(with_statistics(docs.select(F.col(key).alias("_key"), *group, text_of().alias("text"))).select("_key", "_lang", "_source", *numbers))
    stats = stats.withColumn("base_failed", base_failed()).select("*", *transformed())
    fit = stats.where(~F.col("base_failed"))
    sizes = settle(fit.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n")))
    by_lang = sizes.groupBy("_lang").agg(F.sum("_n").alias("_nl"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_na")).first()[0]
    both = F.concat_ws("\x00", F.col("_lang"), F.col("_source"))
    own, whole = F.col("_n") >= MIN_GROUP, F.lit(total >= MIN_GROUP)
    named = settle(sizes.join(by_lang, "_lang").select(
        "_lang", "_source",
        F.when(own, both).when(F.col("_nl") >= MIN_GROUP, F.col("_lang")).when(whole, F.lit("*")).alias("grp"),
    ))
    # Languages and sources are few; the count is checked, and a shuffle join is the other way.
    few = named.count() <= 10_000
    rows = settle(fit.join(F.broadcast(named) if few else named, ["_lang", "_source"]).select("_key", *numbers, "base_failed", "grp", *STATS))
    # Each row is fitted once in the estimate of its own group and, where larger units are needed, in theirs.
    larger = named.where(~F.col("grp").contains("\x00"))
    by_language, by_corpus = (larger.where(x).limit(1).count() > 0 for x in (F.col("grp") != "*", F.col("grp") == "*"))
    wanted = rows.where(F.col("grp").contains("\x00")).select("grp", *STATS)
    if by_language:
        langs = fit.join(F.broadcast(named) if few else named, ["_lang", "_source"]).select("_lang", *STATS)
        need = named.where(~F.col("grp").contains("\x00") & (F.col("grp") != "*")).select(F.col("grp").alias("_lang")).distinct()
        wanted = wanted.unionByName(langs.join(need, "_lang", "left_semi").withColumnRenamed("_lang", "grp"))
    if by_corpus:
        wanted = wanted.unionByName(fit.select(F.lit("*").alias("grp"), *STATS))
    found = estimates(settle(wanted), few)
    d2 = _with_groups(rows, found, few).withColumn("distance", _distance())
    kept = d2.select("_key", *numbers, "base_failed", "distance", F.coalesce(F.col("distance") <= CUT, F.lit(True)).alias("kept"))
    failed = stats.where("base_failed").select("_key", *numbers, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return kept.unionByName(failed).withColumnRenamed("_key", key)


def keep_clean(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that pass; a rejected key takes all its rows with it."""
    bad = settle(judge(docs, key).where(~F.col("kept")).select(F.col(key).alias("bad")).distinct())
    rows = boxed(docs, F.col(key).alias("id"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["bad"]), "left_anti").select("row.*")


def oracle() -> str:
    """`judge` over `documents` in DuckDB SQL, without the distance."""
    d = range(1, 6)
    pairs = [(i, j) for i in d for j in range(1, i + 1)]
    text = r"""
t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w),
same AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 4], ' ')) AS n FROM win),
again AS (SELECT rid, count(DISTINCT i + o) AS n FROM same, range(0, 5) r(o) WHERE n > 1 GROUP BY rid),
b AS MATERIALIZED (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN again a ON a.rid = w.rid),
s AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, floor(100.0 * ln(greatest(n_words, 1)::DOUBLE) + 0.5)::BIGINT AS x1,
  floor(400.0 * ln((word_chars + 150) / (greatest(n_words, 1)::DOUBLE + 30.0)) + 0.5)::BIGINT AS x2, floor(100.0 * ln(1.0::DOUBLE + 1000.0::DOUBLE * n_symbols / greatest(word_chars, 1)) + 0.5)::BIGINT AS x3,
  floor(100.0 * ln(1.0::DOUBLE + 100.0::DOUBLE * n_dup_lines / greatest(n_words, 1)::DOUBLE) + 0.5)::BIGINT AS x4, floor(100.0 * ln(1.0::DOUBLE + 100.0::DOUBLE * n_repeat_words / greatest(n_words, 1)::DOUBLE) + 0.5)::BIGINT AS x5 FROM b),
f AS MATERIALIZED (SELECT * FROM s WHERE NOT base_failed),
z AS (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS nl, sum(count(*)) OVER () AS na FROM f GROUP BY lang, source),
g AS MATERIALIZED (SELECT lang, source, CASE WHEN n >= MIN THEN lang || '/' || source WHEN nl >= MIN THEN lang WHEN na >= MIN THEN '*' END AS grp FROM z),
r AS MATERIALIZED (SELECT f.*, g.grp FROM f JOIN g ON g.lang = f.lang AND g.source = f.source),
u AS MATERIALIZED (SELECT grp, x1, x2, x3, x4, x5 FROM r WHERE contains(grp, '/') UNION ALL SELECT lang, x1, x2, x3, x4, x5 FROM f WHERE lang IN (SELECT grp FROM g) UNION ALL SELECT '*', x1, x2, x3, x4, x5 FROM f WHERE '*' IN (SELECT grp FROM g)),
""".replace("MIN", str(MIN_GROUP))
    mids = ", ".join(f"quantile_cont(x{i}, 0.5) AS m{i}" for i in d)
    offs = ", ".join(f"quantile_cont(abs(x{i} - m{i}), 0.5) AS a{i}" for i in d)
    first = ", ".join(f"sqrt(2.198::DOUBLE * a{i} * a{i} + {FLOOR[i - 1]}::DOUBLE) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in pairs)
    ms = ", ".join(f"m{i}" for i in d)
    text += f"mid AS MATERIALIZED (SELECT grp, {mids} FROM u GROUP BY grp),\nmad AS MATERIALIZED (SELECT u.grp, {offs} FROM u JOIN mid ON mid.grp = u.grp GROUP BY u.grp),\n"
    text += f"e0 AS MATERIALIZED (SELECT mid.grp, {ms}, {first} FROM mid JOIN mad ON mad.grp = mid.grp),\n"

    def distance(rows: str, model: str, keep: str, kind: str = "JOIN") -> str:
        """A SELECT of `keep` and the squared distance d, one nested SELECT for each coordinate."""
        inner = f"SELECT {keep}, {', '.join(f'k.x{i}' for i in d)}, {', '.join(f'e.m{i}' for i in d)}, {', '.join(f'e.l{i}{j}' for i, j in pairs)} FROM {rows} k {kind} {model} e ON e.grp = k.grp"
        for i in d:
            rest = f"(x{i} - m{i})"
            for j in range(1, i):
                rest = f"({rest} - l{i}{j} * z{j})"
            inner = f"SELECT *, {rest} / l{i}{i} AS z{i} FROM ({inner})"
        total = "z1 * z1"
        for i in range(2, 6):
            total = f"({total} + z{i} * z{i})"
        return f"SELECT *, {total} AS d FROM ({inner})"

    for step in range(STEPS):
        text += f"n{step} AS MATERIALIZED (SELECT grp, x1, x2, x3, x4, x5, floor(100.0::DOUBLE * ln(1.0::DOUBLE + d))::BIGINT AS q FROM ({distance('u', f'e{step}', 'k.grp')})),\n"
        sums = ", ".join([f"sum(x{i}) AS s{i}" for i in d] + [f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in pairs])
        text += f"c{step} AS MATERIALIZED (SELECT n.grp, count(*) AS n, {sums} FROM n{step} n JOIN (SELECT grp, quantile_cont(q, {H}) AS cut FROM n{step} GROUP BY grp) h ON h.grp = n.grp WHERE n.q <= h.cut GROUP BY n.grp),\n"
        floor = lambda i, j: f"{FLOOR[i - 1] if i == j else 0.0}::DOUBLE"
        inner = f"SELECT grp, {', '.join(f's{i} / n AS m{i}' for i in d)}, {', '.join(f'(s{i}{j} / n - (s{i} / n) * (s{j} / n)) + {floor(i, j)} AS c{i}{j}' for i, j in pairs)} FROM c{step}"
        for i, j in pairs:
            rest = f"c{i}{j}"
            for k in range(1, j):
                rest = f"({rest} - l{i}{k} * l{j}{k})"
            value = f"sqrt(greatest({rest}, 1.0::DOUBLE))" if i == j else f"{rest} / l{j}{j}"
            inner = f"SELECT *, {value} AS l{i}{j} FROM ({inner})"
        text += f"e{step + 1} AS MATERIALIZED ({inner}),\n"
    out = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    keep = ", ".join(f"k.{x}" for x in out.split(", "))
    text += f"o AS ({distance('r', f'e{STEPS}', keep, 'LEFT JOIN')})\n"
    return "WITH " + text.strip() + f"\nSELECT {out}, coalesce(d <= {CUT}, true) AS kept FROM o UNION ALL SELECT {out}, false FROM s WHERE base_failed"
