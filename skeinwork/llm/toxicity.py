"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps case, accents, look-alike letters of other scripts, full-width and mathematical letters, digits and signs
used as letters to one plain letter, drops zero-width and combining characters, and makes all else a space. The lexicon holds
beginnings of words and whole words whose documents are labelled toxic far more often than chance allows; phrases
of two words that hold an entry, yet only occur in documents labelled harmless, are exceptions. A text's matched
weight, plain and by length, goes through a logistic curve.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import _text as tx
from skeinwork.llm._fit import sample

_ALIKE = {
    **dict(zip("авекмнорстухіјѕԁһґ", "abekmhopctyxijsdhr", strict=True)),
    **dict(zip("αβεηικνορτυχγσω", "abenikvoptuxysw", strict=True)),
    **dict(zip("łøđħŧıßæœþ", "lodhtisaot", strict=True)),
}
#: Digits and signs that stand for letters; 1 is i or l, so that l is folded to i as well.
_LEET = dict(zip("0123456789@$", "oizeasgtbgas", strict=True))
_SPACE, _DROP = 32, 0


def _fold_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    special = [*range(0x3001), *range(0xFE00, 0xFE10), *range(0xFEFF, 0xFF5F), *range(0x1D400, 0x1D800)]
    for cp in special:
        c = chr(cp)
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            table[cp] = _DROP
            continue
        low = unicodedata.normalize("NFKD", c).casefold()[:1]
        low = unicodedata.normalize("NFKD", low)[:1]
        low = _LEET.get(low, _ALIKE.get(low, low))
        table[cp] = ord("i" if low == "l" else low) if low and low.isalpha() else _SPACE
    return table


_table: np.ndarray | None = None


def fold_text(text: str) -> str:
    """The folded text, with a space at both ends."""
    global _table
    if _table is None:
        _table = _fold_table()
    codes = _table[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return codes[codes != _DROP].tobytes().decode("utf-32-le", "replace")


def entries(folded: str) -> set[str]:
    """Candidates for the lexicon: beginnings of 3 to 6 letters and whole words, each behind a space."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.update(f" {w[:k]}" for k in range(3, min(len(w), 6) + 1))
            if len(w) > 6:
                out.add(f" {w} ")
    return out


def phrases(folded: str, lexicon: dict[str, float]) -> set[str]:
    words = folded.split()
    hit = [any(f" {w} ".startswith(x) for x in lexicon) for w in words] if len(lexicon) < 64 else [any(f" {w} "[:k] in lexicon for k in range(2, len(w) + 3)) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = ahocorasick.Automaton()
        for e, w in weights.items():
            self.automaton.add_word(e, (len(e), w))
        for e in exceptions:
            self.automaton.add_word(e, (len(e), 0.0))
        if weights or exceptions:
            self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the matched weight, and of the matched weight per 1000 words."""
        folded = fold_text(text or "")
        hits, free = [], []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(folded):
                (hits if weight else free).append((end + 1 - size, end + 1, weight))
        total = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y, _ in free))
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(1, len(folded.split())))) if total else 0.0

    def score(self, x: tuple[float, float]) -> float:
        c = self.curve
        return float(1 / (1 + np.exp(-(c[0] + c[1] * x[0] + c[2] * x[1]))))


def _counted(texts: DataFrame, what) -> DataFrame:
    """text, label -> entry, pos, neg: documents of either label that hold it, counted by partition and then by entry."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                counts[y].update(what(fold_text(text or "")))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([counts[y][n] for n in names], pa.int64()) for y in (1, 0)]], names=["entry", "pos", "neg"])

    return texts.select("text", "y").mapInArrow(emit, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method; an intercept is put first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
    return w


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = 8000, most: int = 2000, evidence: float = 4.0) -> Lexicon:
    """A lexicon from at most ``limit`` labelled documents (a fixed sample of ``labels``, whose fold the caller chose).

    An entry's log-likelihood ratio against chance must exceed the logarithm of the number of entries by ``evidence``. At most ``4 * most`` counted entries reach the
    driver, the best first, and at most ``most`` make the lexicon. Repeated label rows count each time; labels other than
    0 and 1 are left out. Without labels of both kinds the lexicon is empty.
    """
    tx.small_batches(docs.sparkSession)
    rows = sample(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("y")), id_col, limit)
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(rows, id_col).select("text", "y").persist()
    try:
        size = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
        n_pos, n_neg = size.get(1, 0), size.get(0, 0)
        if not n_pos or not n_neg:
            return Lexicon({}, [], (-1.0 if not n_pos else 1.0, 0.0, 0.0))
        rate = n_pos / (n_pos + n_neg)
        share = F.col("pos") / (F.col("pos") + F.col("neg"))
        ratio = F.col("pos") * F.log(share / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        every = _counted(texts, entries).where("pos + neg >= 3").persist()
        least = float(np.log(max(1, every.count()))) + evidence
        counted = every.where(f"pos >= 3 AND pos > {rate} * (pos + neg)").withColumn("z", ratio).where(F.col("z") >= least)
        weights: dict[str, float] = {}
        ends: set[str] = set()
        for r in counted.orderBy(F.desc("z"), F.desc(F.length("entry")), "entry").limit(4 * most).collect():
            e = r["entry"]
            if len(weights) < most and e not in ends and not any(e[:k] in weights for k in range(2, len(e) + 1)):
                weights[e] = float(np.log((r["pos"] + 0.5) / (n_pos + 1)) - np.log((r["neg"] + 0.5) / (n_neg + 1)))
                ends.update(e[:k] for k in range(2, len(e) + 1))
        every.unpersist()
        harmless = _counted(texts, lambda t: phrases(t, weights)).where("neg >= 3 AND pos = 0").orderBy(F.desc("neg"), "entry").limit(most)
        lexicon = Lexicon(weights, [r["entry"] for r in harmless.collect()])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Lexicon(lexicon.weights, lexicon.exceptions)
            for b in batches:
                x = [own.features(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in x], pa.float64()), pa.array([v for _, v in x], pa.float64()), b.column("y")], names=["u", "v", "y"])

        seen = texts.mapInArrow(emit, "u double, v double, y int").toPandas()
        return Lexicon(weights, lexicon.exceptions, tuple(_logistic(seen[["u", "v"]].to_numpy(), seen["y"].to_numpy())))
    finally:
        texts.unpersist()


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Null and empty texts match nothing and get the curve's lowest value.
    """
    weights, exceptions, curve = lexicon.weights, lexicon.exceptions, lexicon.curve

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions, curve)
        for b in batches:
            s = [own.score(own.features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, "id long, score double, predicted int").withColumnRenamed("id", id_col)
