"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in linear time as half the
difference between the squared sum and the sum of squares of the factors. The model is fitted by mini-batches on a
bounded sample of labelled documents and then applied to every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import _text as tx
from skeinwork.llm._fit import sample

#: Buckets of hashed words; the statistics come after them.
BUCKETS = 1 << 15
FACTORS = 8
STATISTICS = ("upper", "digits", "punctuation", "symbols", "other", "newlines", "word_length", "longest_word", "distinct", "words", "chars", "hyphenless_runs", "short_words")

_KIND = np.zeros(256, dtype=np.int64)  # 0 lower case, 1 upper case, 2 digit, 3 punctuation, 4 symbol, 5 beyond ASCII, 6 new line, 7 space
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 5 if _b > 127 else 6 if _c == "\n" else 7 if _c in " \t\v\f\r" else 1 if _c.isupper() else 0 if _c.islower() else 2 if _c.isdigit() else 3 if _c in ".,;:!?'\"()-" else 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents: where each one's words begin, bucket and value of each distinct one, and the statistics.

    A word's value is its share of the document's words, square-rooted and scaled so that the values of a document have
    unit length. The text is read whole.
    """
    words = tx.Words(texts, lower=True)
    n = words.counts()
    of = np.repeat(np.arange(len(texts)), n)
    keys, count = np.unique(of * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    bucket, owner = keys % BUCKETS, keys // BUCKETS
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    value = np.sqrt(count / n[owner])

    data = np.frombuffer(words.data, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    kinds = np.zeros((len(texts), 8))
    if len(data):
        kind = _KIND[data]
        for k in range(8):
            total = np.concatenate([[0], np.cumsum(kind == k)])
            kinds[:, k] = total[np.minimum(at[:-1] + sizes, len(data))] - total[np.minimum(at[:-1], len(data))]
    length = words.ends - words.starts
    total = np.concatenate([[0], np.cumsum(length)])
    short = np.concatenate([[0], np.cumsum(length <= 2)])
    per_word = np.maximum(n, 1)
    longest = np.array([length[a:b].max() if b > a else 0 for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    visible = np.maximum(sizes - kinds[:, 6] - kinds[:, 7], 1)
    stats = np.column_stack([
        kinds[:, 1] / letters, kinds[:, 2] / visible, kinds[:, 3] / per_word, kinds[:, 4] / per_word, kinds[:, 5] / visible,
        kinds[:, 6] / per_word, np.log1p((total[words.first[1:]] - total[words.first[:-1]]) / per_word), np.log1p(longest), np.diff(begin) / per_word,
        np.log1p(n), np.log1p(sizes), kinds[:, 7] / per_word, (short[words.first[1:]] - short[words.first[:-1]]) / per_word,
    ])
    return begin, bucket, value, stats


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(stats.shape[1])

    def raw(self, begin: np.ndarray, bucket: np.ndarray, value: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value before the sigmoid, and each document's factor sums."""
        sums = lambda a: np.diff(np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])[begin], axis=0)
        v = self.factors[bucket] * value[:, None]
        own = self.factors[BUCKETS:]
        total = sums(v) + x @ own
        squares = sums(v * v) + (x * x) @ (own * own)
        linear = sums(self.weights[bucket] * value) + x @ self.weights[BUCKETS:]
        return self.bias + linear + 0.5 * (total * total - squares).sum(1), total

    def score(self, texts: list[bytes]) -> np.ndarray:
        begin, bucket, value, stats = features(texts)
        return 1 / (1 + np.exp(-np.clip(self.raw(begin, bucket, value, self.inputs(stats))[0], -30, 30)))


def fit(begin: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.05, ridge: float = 1e-5, seed: int = 11) -> Machine:
    """Mini-batches with Adagrad; both classes weigh the same. Same data, same model."""
    rng = np.random.default_rng(seed)
    d = BUCKETS + stats.shape[1]
    m = Machine(0.0, np.zeros(d), rng.normal(0, 0.02, (d, FACTORS)), stats.mean(0), stats.std(0) + 1e-6)
    if not len(y) or y.min() == y.max():
        m.bias = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        m.factors[:] = 0
        return m
    x_all = m.inputs(stats)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g_w, g_v, g_b = np.full(d, 1e-6), np.full((d, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            rows = order[at : at + 64]
            take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            n = begin[rows + 1] - begin[rows]
            b, val, x = bucket[take], value[take], x_all[rows]
            z, total = m.raw(np.concatenate([[0], np.cumsum(n)]), b, val, x)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            of = np.repeat(np.arange(len(rows)), n)
            used, place = np.unique(b, return_inverse=True)
            dw = np.zeros(len(used))
            np.add.at(dw, place, e[of] * val)
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, place, (e[of] * val)[:, None] * (total[of] - m.factors[b] * val[:, None]))
            own = slice(BUCKETS, d)
            ow = x.T @ e
            ov = x.T @ (e[:, None] * total) - ((x * x).T @ e)[:, None] * m.factors[own]
            for idx, a, c in ((used, dw, dv), (own, ow, ov)):
                a, c = a + ridge * m.weights[idx], c + ridge * m.factors[idx]
                g_w[idx] += a * a
                g_v[idx] += c * c
                m.weights[idx] -= rate * a / np.sqrt(g_w[idx])
                m.factors[idx] -= 0.2 * rate * c / np.sqrt(g_v[idx])
            g_b += e.sum() ** 2
            m.bias -= rate * e.sum() / np.sqrt(g_b)
    return m


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = 6000) -> Machine:
    """A machine from at most ``limit`` labelled documents (a fixed sample of ``labels``, whose fold the caller chose)."""
    tx.small_batches(docs.sparkSession)
    rows = sample(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("y")), id_col, limit)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches):
            begin, bucket, value, stats = features(texts)
            cut = list(zip(begin[:-1], begin[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([bucket[a:b].astype(np.uint16).tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], names=["id", "y", "b", "v", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(rows.withColumnRenamed(id_col, "id"), "id").select("id", "text", "y")
    got = texts.mapInArrow(emit, "id long, y int, b binary, v binary, s binary").toPandas().sort_values(["id", "y"])
    size = [len(x) // 2 for x in got["b"]]
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    stats = np.frombuffer(b"".join(got["s"]), dtype=np.float64).reshape(-1, len(STATISTICS)) if len(got) else np.zeros((1, len(STATISTICS)))
    return fit(begin, np.frombuffer(b"".join(got["b"]), dtype=np.uint16).astype(np.int64), np.frombuffer(b"".join(got["v"]), dtype=np.float32).astype(float), stats, got["y"].to_numpy())


def quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Null text is empty; an empty text is scored by its statistics alone.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches):
            s = machine.score(texts)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, "id long, score double, predicted int").withColumnRenamed("id", id_col)
