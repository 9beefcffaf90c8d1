"""Line deduplication: drop lines whose normalised form occurs in too many documents.

Lines are exploded to one row per document and distinct key (a 128-bit hash of the normalised line). Where a line stays in
the first document that holds it, each key goes back to that one document, which keeps its lines, and all other
documents drop theirs: a minimum with map-side partial aggregation and no join of keys, so a frequent line is one row a
task, and nothing is written in between.

Other rules count keys by document, and the documents get back the hashes that they must lose. There a frequent line is one
row per document in the count and in the join; the most frequent ones, of which there are at most HOT_KEYS, are known to
all tasks and joined under several salts, so no task gets all rows of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm import _text as tx
from skeinwork.llm._store import Store

#: Most keys that are salted, rows that a key needs for it, and salts.
HOT_KEYS, HOT_ROWS, SALTS = 10_000, 1000, 64
KEYS = "h1 long, h2 long, id long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line without surrounding ASCII white space and with A-Z lower-cased; None if it is too short."""
    key = line.strip(b" \t\n\v\f\r").lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def keys_of(texts: list[str | None], ids: list[int], min_chars: int) -> pa.RecordBatch:
    found, owners = [], []
    for text, i in zip(texts, ids, strict=True):
        own = {line_key(x, min_chars) for x in _lines(text)} - {None}
        found += own
        owners += [i] * len(own)
    halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(owners, pa.int64())], names=["h1", "h2", "id"])


def key_sets(column: pa.ListArray) -> list[set[bytes]]:
    """The keys in each list of halves; null is an empty set."""
    halves = column.flatten()
    raw = np.column_stack([halves.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype("<i8").tobytes()
    ends = 16 * np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()])
    return [{raw[i : i + 16] for i in range(a, b, 16)} for a, b in pairwise(ends.tolist())]


def _lost(spark: SparkSession, keys: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Rows id, h1, h2 of the keys whose lines a document loses."""
    counted = keys.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"), *([F.count_distinct("id").alias("n")] if min_docs > 2 else []))
    frequent = counted.where("first < last" if min_docs == 2 else f"n >= {int(min_docs)}" if min_docs > 2 else "true")
    frequent = Store(spark).put(frequent.select("h1", "h2", "first", "rows"), "frequent")
    # No more than HOT_KEYS keys can have a share of 1 / HOT_KEYS of all rows or more.
    total = frequent.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") >= max(HOT_ROWS, -(-total // HOT_KEYS))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    salted = keys.join(F.broadcast(frequent.where(hot).select("h1", "h2", F.lit(True).alias("hot"))), ["h1", "h2"], "left").select("h1", "h2", "id", salt.alias("salt"))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hits = salted.join(frequent.select("h1", "h2", "first", F.explode(every).alias("salt")), ["h1", "h2", "salt"])
    return hits.where("id > first") if keep_first else hits


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """``docs`` with the text replaced by its kept lines, plus ``n_lines`` and ``n_dropped``.

    A key held by at least ``min_docs`` distinct ids loses its lines in all documents but the one with the
    smallest id (in all, without ``keep_first``). Null or empty text is one empty line, which is too short
    for a key. A row with a null id belongs to no document: it is returned unchanged and is not counted.
    Rows that share an id count as one document. Other columns pass through, whatever their names.
    """
    tx.small_batches(docs.sparkSession)
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield keys_of(part.column("text").to_pylist(), part.column("id").to_pylist(), min_chars)

    keys = small.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(emit, KEYS)
    # Up to two documents, a key's first document is the only one that keeps its lines, also where there is no other.
    stay = keep_first and min_docs <= 2
    sent = keys.groupBy("h1", "h2").agg(F.min("id").alias("id")) if stay else _lost(docs.sparkSession, keys, min_docs, keep_first)
    told = sent.groupBy("id").agg((F.collect_list if stay else F.collect_set)(F.struct("h1", "h2")).alias("__keys"))

    plain = [c for c in docs.columns if c != text_col]
    # Clashing names can't hurt: the input's columns travel in one struct.
    packed = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in plain]).alias("__row"))
    joined = packed.join(told.withColumnRenamed("id", "__id"), "__id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for i, text, own in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist(), key_sets(b.column("__keys")), strict=True):
                lines = kept = _lines(text)
                if i is not None and (stay or own):
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or (k in own) == stay]
                if len(kept) < len(lines):
                    text = b"\n".join(kept).decode()
                texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["__row", "__text", "__n_lines", "__n_dropped"])

    schema = T.StructType([packed.schema["__row"], T.StructField("__text", T.StringType()), T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    cut_df = joined.select("__id", "__row", "__text", "__keys").mapInArrow(cut, schema)
    out = [F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns]
    taken = {c.lower() for c in docs.columns}
    out += [F.col(f"__{c}").alias(c) for c in ("n_lines", "n_dropped") if c not in taken]
    return cut_df.select(*out)


def sha256_text(col) -> object:
    """Lowercase hex of the UTF-8 bytes."""
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)
