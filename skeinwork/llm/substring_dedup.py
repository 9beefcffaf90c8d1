"""Substring deduplication: remove every word that lies in a token window seen earlier in the corpus.

Each document's windows of ``width`` consecutive words get Rabin-Karp hashes (two polynomials, 128 bits). Counting
every window would shuffle several times the corpus, so two exact steps thin them out first:

1. Exact copies of a document need no windows: the smallest id stands for all of them.
2. Each window is named by the minimum of its Rabin-Karp hashes of ``width - 12`` words. Equal windows have equal
   minima, so a window can only repeat if its minimum was selected at two places; about one word in seven selects
   one. Minima are counted by hash, and those that occur once go back to the document that holds them.

The windows that are left are counted by their full hash; the smallest document id of each hash goes back as "this
is the first". All counts are partial aggregations, so a passage that a third of the corpus holds is one row per
input partition, and no join is keyed by a hash: only by document id. A document's windows, minus the first ones,
merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm import _text as tx

#: Runs of words whose minimum names a window; the window holds SPAN of them.
SPAN = 13
_BASE2 = 0xD1342543DE82EF95


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over every n consecutive values (length len(x) - n + 1)."""
    have = 1
    while 2 * have <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def windows(words: tx.Words, i: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of document i: both hashes of its windows, and each window's minimum."""
    h = words.hashes[words.first[i] : words.first[i + 1]]
    if len(h) < width:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none
    span = min(SPAN, width)
    return tx.rolling(h, width), tx.rolling(tx.mix(h ^ np.uint64(_BASE2)), width, _BASE2), _slide(_grams(h, width), span, np.minimum)


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    return tx.mix(tx.rolling(h, width - min(SPAN, width) + 1))


def minima(words: tx.Words, i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The minima that document i selects, each once, and at how many places."""
    h = words.hashes[words.first[i] : words.first[i + 1]]
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    span = min(SPAN, width)
    grams = _grams(h, width)
    low = _slide(grams, span, np.minimum)
    pad = np.concatenate([np.zeros(span - 1, dtype=np.uint64), low, np.zeros(span - 1, dtype=np.uint64)])
    return np.unique(grams[grams == _slide(pad, span, np.maximum)], return_counts=True)


def candidates(words: tx.Words, i: int, width: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose minimum isn't in ``alone``: positions, both hashes, and whether an equal one comes before in the document."""
    one, two, low = windows(words, i, width)
    at = np.flatnonzero(~np.isin(low, alone)) if len(alone) else np.arange(len(low))
    one, two = one[at], two[at]
    again = np.ones(len(at), dtype=bool)
    if len(at):
        order = np.lexsort((at, two, one))
        a, b = one[order], two[order]
        again[order] = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
    return at, one, two, again


def removed(n_words: int, at: np.ndarray, width: int) -> np.ndarray:
    """Mask of the words that the windows starting at ``at`` cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _longs(rows) -> list[np.ndarray]:
    """A list column's values by row, as unsigned."""
    out = []
    flat, offsets = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64), np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(pa.compute.list_value_length(rows).fill_null(0).to_numpy(), out=offsets[1:])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(flat[a:b])
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per input row: ``id_col``, ``text`` (kept words joined by one space), ``n_words``, ``n_removed`` and
    ``intervals`` (maximal runs of removed words as structs of start and end, end exclusive).

    A word goes if a window of ``width`` words over it also starts earlier: in a smaller id, or before in the same
    document. Null text has no words. ``id_col`` must be unique; a row with a null id takes no part and keeps its
    words. Other columns of the input are ignored, whatever their names.
    """
    tx.small_batches(docs.sparkSession)
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    text = F.coalesce(F.col("body"), F.lit(""))
    # One filter and one name for all branches below, so that they share one exchange of the texts.
    numbered = small.where("id IS NOT NULL")
    first = numbered.select("id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).groupBy("h1", "h2").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("is_first"))
    base = numbered.join(first, "id", "left")

    def emit_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches, "body"):
            words = tx.Words(texts, lower=False)
            found = [minima(words, i, width) for i in range(len(texts))]
            ids = np.repeat(part.column("id").to_numpy(), [len(x) for x, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(np.concatenate([x for x, _ in found]))), pa.array(np.concatenate([n for _, n in found])), pa.array(ids)], names=["m", "n", "id"])

    counted = base.where("is_first").select("id", "body").mapInArrow(emit_minima, "m long, n long, id long").groupBy("m").agg(F.sum("n").alias("n"), F.max("id").alias("id"))
    alone = counted.where("n = 1").groupBy("id").agg(F.collect_list("m").alias("alone"))
    known = base.join(alone, "id", "left")

    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches, "body"):
            words = tx.Words(texts, lower=False)
            one, two, ids = [], [], []
            for i, (d, skip) in enumerate(zip(part.column("id").to_pylist(), _longs(part.column("alone")), strict=True)):
                _, a, b, again = candidates(words, i, width, skip)
                one.append(a[~again])
                two.append(b[~again])
                ids.append(np.full(len(one[-1]), d, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(np.concatenate(one))), pa.array(tx.signed(np.concatenate(two))), pa.array(np.concatenate(ids))], names=["h1", "h2", "id"])

    earliest = known.where("is_first").select("id", "body", "alone").mapInArrow(emit_windows, "h1 long, h2 long, id long").groupBy("h1", "h2").agg(F.min("id").alias("id"))
    own = earliest.groupBy("id").agg(F.collect_list("h1").alias("own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tx.chunks(batches, "body"):
            words = tx.Words(texts, lower=False)
            counts = words.counts()
            kept, n_removed, spans = [], [], []
            for i, (d, is_first, skip, mine) in enumerate(zip(part.column("id").to_pylist(), part.column("is_first").to_pylist(), _longs(part.column("alone")), _longs(part.column("own")), strict=True)):
                n, lo = int(counts[i]), int(words.first[i])
                gone = np.zeros(n, dtype=bool)
                if d is not None and not is_first:
                    gone[:] = n >= width
                elif d is not None:
                    at, one, _, again = candidates(words, i, width, skip)
                    gone = removed(n, at[again | ~np.isin(one, mine)], width)
                stay = np.flatnonzero(~gone) + lo
                kept.append(b" ".join([words.data[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]).decode())
                n_removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(kept, pa.string()), pa.array(counts.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "text", "n_words", "n_removed", "intervals"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("intervals", span)])
    known = known.join(own, "id", "left").select("id", "body", "is_first", "alone", "own")
    unnumbered = small.where("id IS NULL").select("id", "body", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("is_first", "alone", "own")])
    return known.union(unnumbered).mapInArrow(cut, schema).withColumnRenamed("id", id_col)
