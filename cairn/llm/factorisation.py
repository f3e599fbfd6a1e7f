"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its words hashed into `DIMS` buckets with damped counts of unit
length, ten structure statistics in bins, and the recorded length's bin. The score
is the logistic of

    b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which takes time linear in the text's features. Labels, language, source and id are
never features. The model is fitted on the driver from at most `sample` labelled
rows of the training folds, chosen by the hash of their ids; scoring reads every whole
text. Classes weigh the same in fitting, so 0.5 is a text the model cannot place.

Defined cases: a null text is empty and is scored from its structure; labels other than
0 and 1, and null ones, are ignored; a document with both labels counts for each; without labels of both kinds the score
is the share of ones among the labels there are, or 0.5; repeated rows score alike; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import fold_of, ship, text_of

DIMS, RANK = 1 << 16, 8
#: The bound of the rows a model is fitted on.
SAMPLE = 12_000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ENDS = b".!?"


def _bins(text: bytes, words: list[bytes], distinct: int, n_chars) -> list[bytes]:
    n = max(1, len(words))
    size = max(1, len(text))
    share = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    log = lambda x: int(4 * math.log(1e-3 + x))
    values = [
        log(len(words)), int(2 * sum(map(len, words)) / n), log(share(_SYMBOLS) / size), log(share(_UPPER) / size), log(share(_DIGITS) / size),
        log(share(_ENDS) / n), log((len(lines) - len(set(lines))) / max(1, len(lines))), int(10 * distinct / n), log(len(lines)), log(n / max(1, len(lines))),
        log(float(n_chars)) if n_chars is not None else -99,
    ]
    return [b"\x00%d=%d" % (i, v) for i, v in enumerate(values)]


def features(text: str, n_chars=None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text, ascending buckets."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    at, tf = np.unique(np.fromiter((zlib.crc32(w) for w in words), dtype=np.int64, count=len(words)) % DIMS, return_counts=True)
    x = 1.0 + np.log(tf)
    x = x / max(1e-9, math.sqrt(float((x * x).sum()))) if len(x) else x
    marks = np.array([zlib.crc32(b) % DIMS for b in _bins(raw, words, len(at), n_chars)], dtype=np.int64)
    both, back = np.unique(np.concatenate([at, marks]), return_inverse=True)
    value = np.bincount(back, weights=np.concatenate([x, np.full(len(marks), 0.5)]), minlength=len(both))
    return both.astype(np.int32), value.astype(np.float32)


class Machine:
    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(7)
        self.b = math.log(prior / (1 - prior)) if 0 < prior < 1 else 50.0 * (2 * prior - 1)
        self.w = np.zeros(DIMS, dtype=np.float32)
        self.v = rng.normal(0, 0.02, (DIMS, RANK)).astype(np.float32)
        self.fitted = False

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        if not self.fitted:
            return self.b
        v = self.v[at] * x[:, None]
        s = v.sum(0)
        return float(self.b + self.w[at] @ x + 0.5 * (s @ s - (v * v).sum()))

    def score(self, at, x) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.raw(at, x)))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 5, rate: float = 0.1, decay: float = 1e-4, batch: int = 128) -> "Machine":
        ones = y.sum()
        weight = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))
        gw, gv, gb = np.full(DIMS, 1e-6), np.full((DIMS, RANK), 1e-6), 1e-6
        rng = np.random.default_rng(11)
        self.fitted, self.b = True, 0.0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                sizes = np.array([len(rows[i][0]) for i in part])
                at = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part]).astype(np.float64)
                edge = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                vx = self.v[at] * x[:, None]
                s = np.add.reduceat(vx, edge, axis=0)
                out = self.b + np.add.reduceat(self.w[at] * x, edge) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), edge))
                g = weight[part] * (1 / (1 + np.exp(-np.clip(out, -60, 60))) - y[part]) / len(part)
                each = np.repeat(g, sizes) * x
                ids, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, weights=each) + decay * self.w[ids]
                full = each[:, None] * (np.repeat(s, sizes, axis=0) - vx)
                dv = np.stack([np.bincount(back, weights=full[:, f]) for f in range(RANK)], axis=1) + decay * self.v[ids]
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                gb += g.sum() ** 2
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
                self.b -= rate * g.sum() / math.sqrt(gb)
        return self


def _features(batches):
    for batch in batches:
        at, x = [], []
        for t, n in zip(batch.column("text"), batch.column("n_chars")):
            a, b = features(t.as_py() or "", n.as_py())
            at.append(a.tobytes())
            x.append(b.tobytes())
        yield pa.record_batch([batch.column("key"), batch.column("y"), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["key", "y", "at", "x"])


def _scorer(machine: Machine):
    def run(batches):
        for batch in batches:
            out = [machine.score(*features(t.as_py() or "", n.as_py())) for t, n in zip(batch.column("text"), batch.column("n_chars"))]
            yield pa.record_batch([batch.column("key"), batch.column("held_out"), pa.array(out, pa.float64())], names=["key", "held_out", "score"])

    return run


def _rows(docs: DataFrame, key: str, *more) -> DataFrame:
    length = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(key).cast("long").alias("key"), text_of().alias("text"), F.abs(length).alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled rows outside the held-out fold."""
    wanted = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    wanted = wanted.where(fold_of("key", FOLDS) != HELD).distinct()
    # The sample is bounded, so it may be broadcast.
    chosen = wanted.orderBy(F.xxhash64("key"), "key", "y").limit(sample)
    found = _rows(docs, key).join(F.broadcast(chosen), "key").mapInArrow(_features, "key long, y int, at binary, x binary")
    got = found.orderBy(F.xxhash64("key"), "key", "y", F.xxhash64("at")).limit(sample).toArrow().to_pylist()
    y = np.array([r["y"] for r in got], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Machine(float(y.mean()) if len(y) else 0.5)
    return Machine().fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got], y)


def classify(docs: DataFrame, machine: Machine, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for every row."""
    rows = _rows(docs, key, (fold_of(key, FOLDS) == HELD).alias("held_out"))
    scored = rows.mapInArrow(_scorer(machine), "key long, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


ship(__name__)
