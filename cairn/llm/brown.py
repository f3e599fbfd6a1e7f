"""Language-model scoring with Brown classes.

Training (rows outside the held-out fold):

1. Every word of the corpus is counted exactly, by a map-side-combined group-by. The
   `known` most frequent words (a bounded table) go to the tasks; all other words stay
   distributed.
2. Every document is written once as word numbers plus its remaining, rare words.
3. Exchange clustering. The bigram matrix of the `core` most frequent words gives the first
   classes: the exchange algorithm moves each to the class that raises the class-bigram
   likelihood most, until no word moves. Then sweeps over the corpus count on which
   classes every known word borders, and blocks of words are exchanged by the same gain,
   in parallel. Sweeps end when few words move, when the likelihood falls (the better
   classes are kept) or after `sweeps`.
4. Every other word that training holds twice or more gets the class that makes its
   neighbours anywhere in the corpus likeliest: a distributed group-by on the word.
   Words seen once stand for the unseen ones: both have one of `shapes` classes by their last
   two bytes, as one occurrence says less about a word than its ending.
5. Class transitions are counted over the whole corpus.

A text's probability is the product over its tokens of P(class | class before) and
P(word | class). Transitions are smoothed towards the class unigram; emissions add
`alpha` to each count and keep one `alpha` a class for unseen words, so
both sum to one.

Hot keys: a rare training word is less frequent than `known` others, which bounds its group;
rare words of all texts meet the table of classes in a join that adaptive execution can
split, as a word that only held-out texts hold may be in any number of them.

Defined cases: a null text is empty and scores its end token; a null id folds as the
empty text; very long texts are sequences like any other; repeated rows are rows of their own
in training and scoring; words of one count are taken as known all or none; with nothing to train
on all words are unseen; an empty table gives no rows; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fold_of, free_shuffles, release, settle, ship, text_of

KNOWN, CORE, CLASSES, SHAPES = 1 << 17, 1024, 64, 32
#: Sweeps over the corpus at most, and the share of known words that must move for another.
SWEEPS, MOVING = 3, 0.01
ALPHA, KAPPA = 0.5, 20.0
FOLDS, HELD = 7, 2
#: Words exchanged one after the other; blocks run in parallel.
BLOCK = 1024
#: Of settled tables that grow with the corpus: word numbers are mostly small, which entropy coding makes use of.
PACKED = "zstd"
#: Rare tokens in a group of step 4.
GROUP = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[bytes]:
    """Words as bytes: A-Z lower-cased, split at the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts; words are counted as they stand, then their lower-case forms are summed."""
    # Literal splits and conditional translation stay in generated code; outer explodes add no filter that splits again.
    text = F.col("text")
    odd = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    plain = F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    lines = rows.select(F.explode_outer(F.split(plain, "\n")).alias("line"))
    single = lines.select(F.explode_outer(F.split("line", " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return single.groupBy(F.translate("w", UPPER, LOWER).cast("binary").alias("word")).agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, known: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words and their counts: all from the least frequency down to which at most `known` have."""
    least, total = None, 0
    for n, m in counts.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.desc("n")).limit(known).collect():
        total += m
        if total > known:
            break
        least = n
    if least is None:
        return [], np.zeros(0)
    top = sorted(((-n, bytes(w)) for w, n in counts.where(F.col("n") >= least).collect()))
    return [w for _, w in top], np.array([-n for n, _ in top], dtype=np.float64)


def _number(words: list[bytes]):
    """Word numbers by rank; a rare word has number len(words) and is also listed."""
    k = len(words)

    def run(batches):
        at = {w: i for i, w in enumerate(words)}.get
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, ids, rare = batch.slice(lo, 1000), [], []
                for t in part.column("text"):
                    ws = words_of(t.as_py() or "")
                    found = np.array([at(w, k) for w in ws], dtype=np.int32)
                    ids.append(found.tobytes())
                    rare.append([ws[i] for i in np.flatnonzero(found == k).tolist()])
                yield pa.record_batch(
                    [part.column("key"), part.column("held_out"), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))],
                    names=["key", "held_out", "ids", "rare"],
                )

    return run


def _sequences(batch):
    """The word numbers of a batch's texts, each behind a -1 and with another one at the end."""
    gap = np.array([-1], dtype=np.int32)
    parts = [gap]
    for x in batch.column("ids"):
        parts += [np.frombuffer(x.as_py(), dtype=np.int32), gap]
    return np.concatenate(parts)


def _bigrams(core: int):
    def run(batches):
        total = np.zeros(core * core, dtype=np.int64)
        for batch in batches:
            s = _sequences(batch)
            a, b = s[:-1], s[1:]
            both = (a >= 0) & (a < core) & (b >= 0) & (b < core)
            at, n = np.unique(a[both].astype(np.int64) * core + b[both], return_counts=True)
            total[at] += n
        at = np.flatnonzero(total)
        a = at // core
        edges = np.searchsorted(a, np.arange(core + 1))
        for i in range(core):
            cells = at[edges[i] : edges[i + 1]]
            if len(cells):
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([(cells % core).astype(np.int32).tobytes()]), pa.array([total[cells].tobytes()])], names=["a", "b", "n"])

    return run


def _sum_rows(core: int):
    def run(pdf):
        import pandas as pd

        total = np.zeros(core, dtype=np.int64)
        for b, n in zip(pdf["b"], pdf["n"]):
            total[np.frombuffer(b, dtype=np.int32)] += np.frombuffer(n, dtype=np.int64)
        return pd.DataFrame({"a": [int(pdf["a"].iloc[0])], "n": [total.tobytes()]})

    return run


def _g(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(cc: np.ndarray) -> float:
    """The part of the class-bigram log-likelihood that classes decide."""
    return float(_g(cc).sum() - _g(cc.sum(1)).sum() - _g(cc.sum(0)).sum())


def best_class(cc: np.ndarray, old: int, r: np.ndarray, l: np.ndarray, self_n: float) -> int:
    """Take a word out of its class, put it into the one of most gain and return that; `cc` is changed in place.

    r and l count the classes right and left of the word, self_n the word beside itself.
    """
    classes = len(r)
    cc[old, :classes] -= r
    cc[:classes, old] -= l
    cc[old, old] += self_n
    r_out, l_out = r.copy(), l.copy()
    r_out[old] -= self_n
    l_out[old] -= self_n
    rows, cols = cc.sum(1), cc.sum(0)
    wr, wl = r.sum(), l.sum()
    # Likelihood gained in each class: its row, its column, its margins. Only cells that the word has change.
    at, on = np.flatnonzero(r_out), np.flatnonzero(l_out)
    gain = (_g(cc[:, at] + r_out[at]) - _g(cc[:, at])).sum(1) + (_g(cc[on] + l_out[on, None]) - _g(cc[on])).sum(0)
    diag = np.diag(cc)
    gain += _g(diag + r_out + l_out + self_n) - _g(diag) - (_g(diag + r_out) - _g(diag)) - (_g(diag + l_out) - _g(diag))
    gain -= _g(rows + wr) - _g(rows) + _g(cols + wl) - _g(cols)
    new = int(np.argmax(gain))
    if gain[new] <= gain[old] + 1e-9:
        new = old
    cc[new] += r_out
    cc[:, new] += l_out
    cc[new, new] += self_n
    return new


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 20) -> np.ndarray:
    """Classes of the words of a bigram matrix by the exchange algorithm."""
    v = len(bigrams)
    n = bigrams.astype(np.float64)
    member = np.arange(v) % classes
    one = np.zeros((v, classes))
    one[np.arange(v), member] = 1.0
    cc = one.T @ n @ one
    right_of, left_of = n @ one, n.T @ one  # word to class, class to word
    for _ in range(sweeps):
        moved = 0
        for w in range(v):
            old = member[w]
            new = best_class(cc, old, right_of[w].copy(), left_of[w].copy(), n[w, w])
            if new != old:
                moved += 1
                member[w] = new
                right_of[:, old] -= n[:, w]
                right_of[:, new] += n[:, w]
                left_of[:, old] -= n[w]
                left_of[:, new] += n[w]
        if not moved:
            break
    return member


def _contexts(member: np.ndarray, classes: int):
    """For all known words: how often each class stands right and left of them and they beside themselves, in blocks of words.

    Cells are sent as steps from one to the next, which compress well.
    """

    def run(batches):
        width, known = 2 * classes + 1, len(member)
        total = np.zeros(known * width, dtype=np.int32)
        side = np.append(member, [-1, -1]).astype(np.int64)  # rare words and gaps are of no class
        for batch in batches:
            s = _sequences(batch)
            for lo in range(0, len(s) - 1, 1 << 20):
                a, b = s[lo : lo + (1 << 20) + 1][:-1], s[lo + 1 : lo + (1 << 20) + 1]
                ca, cb = side[a], side[b]
                x, y, z = (a >= 0) & (a < known) & (cb >= 0), (b >= 0) & (b < known) & (ca >= 0), (a == b) & (ca >= 0)
                for keys in (a[x].astype(np.int64) * width + cb[x], b[y].astype(np.int64) * width + classes + ca[y], a[z].astype(np.int64) * width + 2 * classes):
                    at, n = np.unique(keys, return_counts=True)
                    total[at] += n.astype(np.int32)
        for lo in range(0, known, BLOCK):
            mine = total[lo * width : (lo + BLOCK) * width]
            at = np.flatnonzero(mine)
            if len(at):
                yield pa.record_batch([pa.array([lo // BLOCK], pa.int32()), pa.array([np.diff(at, prepend=0).astype(np.int32).tobytes()]), pa.array([mine[at].tobytes()])], names=["block", "cell", "n"])

    return run


def _sum_cells(pdf, width: int) -> np.ndarray:
    n = np.zeros(BLOCK * width)
    for cell, k in zip(pdf["cell"], pdf["n"]):
        n[np.cumsum(np.frombuffer(cell, dtype=np.int32))] += np.frombuffer(k, dtype=np.int32)
    return n.reshape(BLOCK, width)


def _class_bigrams(member: np.ndarray, classes: int):
    """A block's part of the class-bigram matrix."""

    def run(pdf):
        import pandas as pd

        block, n = int(pdf["block"].iloc[0]), _sum_cells(pdf, 2 * classes + 1)
        mine = member[block * BLOCK : (block + 1) * BLOCK]
        cc = np.zeros((classes, classes))
        held = mine >= 0
        np.add.at(cc, mine[held], n[: len(mine)][held, :classes])
        return pd.DataFrame({"block": [block], "cells": [n.astype(np.float32).tobytes()], "cc": [cc.tobytes()]})

    return run


def _exchange_block(member: np.ndarray, classes: int, cc: np.ndarray):
    """New classes of a block's words, one after the other, against the rest as it stands. A word of no class enters its best one."""

    def run(pdf):
        import pandas as pd

        out = []
        for block, cells in zip(pdf["block"], pdf["cells"]):
            n = np.frombuffer(cells, dtype=np.float32).astype(np.float64).reshape(BLOCK, 2 * classes + 1)
            now, mine = cc.copy(), member[block * BLOCK : (block + 1) * BLOCK].copy()
            for i, old in enumerate(mine.tolist()):
                r, l, self_n = n[i, :classes], n[i, classes : 2 * classes], n[i, 2 * classes]
                if not (r.any() or l.any()):
                    continue
                if old < 0:  # it was in no cell yet: enter class 0, then leave for the best
                    old = 0
                    now[0] += r
                    now[:, 0] += l
                mine[i] = best_class(now, old, r.copy(), l.copy(), self_n)
            out.append((int(block), mine.astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["block", "classes"])

    return run


def cluster(train: DataFrame, k: int, core: int, classes: int, sweeps: int) -> tuple[np.ndarray, int]:
    """The class of every known word (-1 without neighbours of a class) and the sweeps made."""
    matrix = np.zeros((core, core), dtype=np.int64)
    for a, line in train.mapInArrow(_bigrams(core), "a int, b binary, n binary").groupBy("a").applyInPandas(_sum_rows(core), "a int, n binary").collect():
        matrix[a] = np.frombuffer(line, dtype=np.int64)  # at most core x core cells
    member = np.full(k, -1, dtype=np.int64)
    member[:core] = exchange(matrix, classes)
    best, kept, entered = -np.inf, member, False
    for sweep in range(sweeps + 1):
        found = train.mapInArrow(_contexts(member, classes), "block int, cell binary, n binary")
        found = settle(found.groupBy("block").applyInPandas(_class_bigrams(member, classes), "block int, cells binary, cc binary"))
        free_shuffles()
        cc = np.zeros((classes, classes))
        for (x,) in found.select("cc").collect():  # one small matrix for each block
            cc += np.frombuffer(x).reshape(classes, classes)
        # Before all words have entered there is nothing to compare with.
        now = likelihood(cc) if entered else -np.inf
        if entered and now <= best:
            release(found)
            return kept, sweep
        best, kept = now, member
        if sweep == sweeps:
            release(found)
            return kept, sweep
        moved = found.select("block", "cells").repartition("block").mapInPandas(lambda parts, f=_exchange_block(member, classes, cc): map(f, parts), "block int, classes binary")
        after = member.copy()
        for block, x in moved.collect():  # at most `known` numbers
            x = np.frombuffer(x, dtype=np.int32)
            after[block * BLOCK : block * BLOCK + len(x)] = x
        release(found)
        free_shuffles()
        few = entered and (after != member).sum() <= MOVING * k
        member, entered = after, True
        if few:
            return member, sweep + 1
    return kept, sweeps


def _rare_tokens(cls: np.ndarray, end: int):
    """(_row, j, word, left, right) of every rare word; -1 for a neighbour that is rare too."""

    def run(batches):
        k = len(cls)
        table = np.concatenate([cls, [-1, end]]).astype(np.int32)  # rare words; the gap, at -1, is the end
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = _sequences(part)
                at = np.flatnonzero(s == k)
                words = part.column("rare").flatten()
                size = part.column("rare").value_lengths().to_numpy()
                rows = np.repeat(part.column("_row").to_numpy(), size)
                j = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.record_batch(
                    [pa.array(rows, pa.int64()), pa.array(j, pa.int32()), words, pa.array(table[s[at - 1]], pa.int32()), pa.array(table[s[at + 1]], pa.int32()), pa.array(np.repeat(part.column("held_out").to_numpy(zero_copy_only=False), size), pa.bool_())],
                    names=["_row", "j", "word", "left", "right", "held_out"],
                )

    return run


def shape_of(word: bytes, shapes: int) -> int:
    return zlib.crc32(word[-2:]) % shapes


def _classes_of_rare(cc: np.ndarray, end: np.ndarray, start: np.ndarray, classes: int, shapes: int):
    """(word, n, cls) of the words of a group of training tokens."""
    p = cc + 0.5
    to = np.log(np.column_stack([p, end + 0.5]) / (p.sum(1) + end + 0.5)[:, None])  # class or end to the right of a class
    back = np.log(np.column_stack([p.T, start + 0.5]) / (p.sum(0) + start + 0.5)[:, None])  # class or start to its left
    right, left = np.vstack([to.T, np.zeros(classes)]), np.vstack([back.T, np.zeros(classes)])  # at -1: nothing known

    def run(pdf):
        import pandas as pd

        at, words = pd.factorize(pdf["word"])
        n = np.bincount(at, minlength=len(words))
        cls = np.full(len(words), -1, dtype=np.int32)
        often = np.flatnonzero(n[at] >= 2)
        often = often[np.argsort(at[often], kind="stable")]  # the tokens of a word together
        if len(often):
            first = np.flatnonzero(np.diff(at[often], prepend=-1))
            gain = np.add.reduceat(right[pdf["right"].to_numpy()[often]] + left[pdf["left"].to_numpy()[often]], first)
            cls[at[often[first]]] = np.where(gain.any(1), gain.argmax(1), -1)
        for i in np.flatnonzero(cls < 0).tolist():
            cls[i] = classes + shape_of(bytes(words[i]), shapes)
        return pd.DataFrame({"word": words, "n": n.astype(np.int64), "cls": cls})

    return run


def _states(batch, table: np.ndarray):
    """The class of every token of a batch's texts, end tokens between them, and where rare words stand."""
    s = _sequences(batch)
    c = table[s]
    rare = np.flatnonzero(s == len(table) - 2)
    c[rare] = batch.column("rare_cls").flatten().to_numpy(zero_copy_only=False)
    return s, c


def _transitions(table: np.ndarray, states: int):
    def run(batches):
        total = np.zeros(states * states, dtype=np.int64)
        for batch in batches:
            _, c = _states(batch, table)
            total += np.bincount(c[:-1] * states + c[1:], minlength=states * states)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    return run


def _score(table, states, trans, emit, room, base, base_room):
    """Sums over the transitions and emissions of all tokens."""

    def run(batches):
        flat, k = trans.reshape(-1), len(table) - 2
        for batch in batches:
            s, c = _states(batch, table)
            rare = np.flatnonzero(s == k)
            n = batch.column("rare_n").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            # At gap i stands the end of text i - 1; the first has none before it.
            model, plain, known = np.zeros(len(s)), np.zeros(len(s)), np.zeros(len(s), dtype=np.int64)
            model[1:] = flat[c[:-1] * states + c[1:]]
            often = (s >= 0) & (s < k)
            model[often] += emit[s[often]]
            plain[often] = base[s[often]]
            known[often] = 1
            model[rare] += np.log10((n + ALPHA) / room[c[rare]])
            plain[rare] = np.log10((n + 1.0) / base_room)
            known[rare] = n > 0
            gaps = np.flatnonzero(s < 0)
            plain[gaps] = base[-1]
            sums = [np.add.reduceat(x[1:], gaps[:-1]) if len(gaps) > 1 else x[:0] for x in (model, plain, known)]
            yield pa.record_batch(
                [batch.column("key"), batch.column("held_out"), pa.array(np.diff(gaps), pa.int64()), pa.array(sums[2], pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[0], pa.float64())],
                names=["key", "held_out", "n_tokens", "n_known", "base", "model"],
            )

    return run


def score(docs: DataFrame, key: str = "doc_id", known: int = KNOWN, core: int = CORE, classes: int = CLASSES, shapes: int = SHAPES, sweeps: int = SWEEPS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), (fold_of(key, FOLDS) == HELD).alias("held_out"), text_of().alias("text"))
    counts = settle(word_counts(rows.where(~F.col("held_out"))))
    n_docs = rows.where(~F.col("held_out")).count()
    size = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = size[1] + n_docs, size[0] + (n_docs > 0)
    words, freq = frequent(counts, known)
    release(counts)
    free_shuffles()
    k = len(words)
    core = min(core, k)
    classes = max(1, min(classes, core))
    end, states = classes + shapes, classes + shapes + 1
    coded = settle(rows.mapInArrow(_number(words), "key long, held_out boolean, ids binary, rare array<binary>").withColumn("_row", F.monotonically_increasing_id()), PACKED)
    train = coded.where(~F.col("held_out")).select("ids")
    member, _ = cluster(train, k, core, classes, sweeps) if k else (np.zeros(0, dtype=np.int64), 0)
    cls = np.where(member >= 0, member, [classes + shape_of(w, shapes) for w in words]) if k else member

    # Rare words: classes from their neighbours, then each text's list of them.
    table = np.concatenate([cls, [0, end]]).astype(np.int64)  # the place before the last is filled from the lists
    t = _collected(train.select("ids"), np.concatenate([cls, [end - 1, end]]).astype(np.int64), states)
    near = [t[:classes, :classes], t[:classes, end], t[end, :classes]]
    tokens = settle(coded.select("_row", "held_out", "ids", "rare").mapInArrow(_rare_tokens(np.where(cls < classes, cls, -1), classes), "_row long, j int, word binary, left int, right int, held_out boolean"), PACKED)
    groups = max(1, -(-tokens.where(~F.col("held_out")).count() // GROUP))
    seen = tokens.where(~F.col("held_out") & F.col("word").isNotNull()).select("word", "left", "right", F.pmod(F.xxhash64("word"), F.lit(groups)).alias("g"))
    rare = settle(seen.groupBy("g").applyInPandas(_classes_of_rare(*near, classes, shapes), "word binary, n long, cls int"))
    free_shuffles()
    shape = (F.lit(classes) + F.crc32(F.expr("substring(word, -2, 2)")) % shapes).cast("int")
    lists = tokens.select("_row", "j", "word").join(rare, "word", "left").select("_row", F.struct("j", F.coalesce("cls", shape).alias("cls"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).alias("x"))
    lists = settle(lists.groupBy("_row").agg(F.array_sort(F.collect_list("x")).alias("x")), PACKED)
    release(tokens)
    free_shuffles()
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    coded2 = settle(coded.drop("rare").join(lists, "_row", "left").select("key", "held_out", "ids", F.coalesce("x.cls", empty("int")).alias("rare_cls"), F.coalesce("x.n", empty("long")).alias("rare_n")), PACKED)
    types = np.bincount(cls, minlength=states).astype(np.float64) if k else np.zeros(states)
    for c, m in rare.groupBy("cls").agg(F.count(F.lit(1))).collect():  # one row for each class
        types[c] += m
    release(lists, rare, coded)
    free_shuffles()

    t = _collected(coded2.where(~F.col("held_out")).select("ids", "rare_cls"), table, states)
    unigram = (t.sum(0) + 1.0) / (t.sum() + states)
    trans = np.log10((t + KAPPA * unigram) / (t.sum(1, keepdims=True) + KAPPA))
    room = t.sum(0) + ALPHA * (types + 1.0)  # a class's tokens are the transitions into it
    emit = np.log10((freq + ALPHA) / room[cls]) if k else np.zeros(0)
    base_room = float(n + v + 1)
    base = np.append(np.log10((freq + 1.0) / base_room) if k else np.zeros(0), np.log10((n_docs + 1.0) / base_room))
    out = coded2.mapInArrow(_score(table, states, trans, emit, room, base, base_room), "key long, held_out boolean, n_tokens long, n_known long, base double, model double")
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"), F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"),
    )


def _collected(train: DataFrame, table: np.ndarray, states: int) -> np.ndarray:
    """Transitions between classes over the whole corpus; without lists, rare words have the class `table` gives them."""
    t = np.zeros(states * states)
    listed = "rare_cls" in train.columns
    found = train.mapInArrow(_transitions(table, states) if listed else _plain_transitions(table, states), "cell long, n long")
    for cell, m in found.groupBy("cell").agg(F.sum("n")).collect():  # at most states x states cells
        t[cell] = m
    return t.reshape(states, states)


def _plain_transitions(table: np.ndarray, states: int):
    def run(batches):
        total = np.zeros(states * states, dtype=np.int64)
        for batch in batches:
            c = table[_sequences(batch)]
            total += np.bincount(c[:-1] * states + c[1:], minlength=states * states)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    return run


ship(__name__)
