"""Paragraph chunks: the documents of the vector space."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from skeinwork.functions.batches import offsets as list_offsets
from skeinwork.functions.batches import small_batches
from skeinwork.functions.text import strip

MIN_WORDS = 30
#: Ranges of ids whose chunks are numbered on their own; their totals are summed in one task.
RANGES = 4096


def word_count(text: Column) -> Column:
    flat = strip(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, r"\s+")))


def _chunker(separator: str, min_words: int) -> Callable[[bytes], list[tuple[bytes, int]]]:
    """The chunks of a text with their numbers of words: stripped paragraphs joined by a space until there are ``min_words``.

    What is left at the end is dropped. White space is that of ASCII, as of bytes.split().
    """
    cut = re.compile(separator.encode()).split

    def chunks(body: bytes) -> list[tuple[bytes, int]]:
        out, parts, words = [], [], 0
        for p in cut(body.strip()):
            if p := p.strip():
                parts.append(p)
                words += len(p.split())
                if words >= min_words:
                    out.append((b" ".join(parts), words))
                    parts, words = [], 0
        return out

    return chunks


def _bodies(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def listed(docs: DataFrame, separator: str = r"\n\n+", min_words: int = MIN_WORDS, body: str = "body") -> DataFrame:
    """``docs`` with ``chunks``, the list of each document's chunks, instead of the body."""
    cut = _chunker(separator, min_words)
    keep = [c for c in docs.columns if c != body]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [cut(b) for b in _bodies(batch.column(body))]
            each = [c for found in lists for c in found]
            items = pa.StructArray.from_arrays([_texts([t for t, _ in each]), pa.array([w for _, w in each], pa.int32())], ["content", "word_count"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(list_offsets(map(len, lists)), items)], [*keep, "chunks"])

    kept = docs.select(*keep, F.col(body).cast("string").alias(body))
    schema = StructType([*[docs.schema[c] for c in keep]]).add("chunks", ArrayType(StructType().add("content", "string").add("word_count", "integer")))
    small_batches(docs.sparkSession)
    return kept.mapInArrow(emit, schema)


def offsets(sizes: DataFrame) -> DataFrame:
    """``sizes(doc_id, n)``, one row a document, to ``(doc_id, offset)``: the chunks of all documents of smaller ids.

    Only ids and numbers are shuffled. Prefix sums have two levels: over at most RANGES ranges of ids, whose width
    follows from the smallest and the largest id, and within each range.
    """
    bounds = sizes.agg(F.min("doc_id").alias("__lo"), (F.floor((F.max("doc_id") - F.min("doc_id")) / RANGES) + 1).alias("__width"))
    placed = sizes.crossJoin(F.broadcast(bounds)).select("doc_id", "n", F.floor((F.col("doc_id") - F.col("__lo")) / F.col("__width")).alias("__range"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__range").agg(F.sum("n").alias("__total")).select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(starts, "__range").select("doc_id", (F.col("__start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset"))


def chunk_documents(docs: DataFrame, separator: str = r"\n\n+", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, body)`` to ``(chunk_id, doc_id, position, content, word_count)``, numbered from 1 by (doc_id, position);
    null bodies have no chunks, doc_id is unique.

    Chunks are cut twice, once to count them, which is far cheaper than to keep them: the texts are shuffled once, as they are.
    """
    cut = _chunker(separator, min_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(cut(b)) for b in _bodies(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [cut(b) for b in _bodies(batch.column("body"))]
            counts = np.array([len(found) for found in lists], dtype=np.int64)
            of = np.repeat(np.arange(len(lists)), counts)
            position = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            each = [c for found in lists for c in found]
            columns = [pa.array(batch.column("offset").to_numpy()[of] + position + 1), batch.column("doc_id").take(pa.array(of)), pa.array(position.astype(np.int32)), _texts([t for t, _ in each]), pa.array([w for _, w in each], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "doc_id", "position", "content", "word_count"])

    small_batches(docs.sparkSession)
    whole = docs.where(F.col("body").isNotNull()).select("doc_id", F.col("body").cast("string").alias("body"))
    kind = whole.schema["doc_id"].dataType
    sizes = whole.mapInArrow(count, StructType().add("doc_id", kind).add("n", "long"))
    placed = whole.join(offsets(sizes.where("n > 0")), "doc_id").select("doc_id", "body", F.col("offset").cast("long").alias("offset"))
    return placed.mapInArrow(emit, StructType().add("chunk_id", "long").add("doc_id", kind).add("position", "integer").add("content", "string").add("word_count", "integer"))
