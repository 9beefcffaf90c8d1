"""The vector space that text and images share: bags of words to codebook, postings, norms and cosine scores.

A bag is ``(chunk_id, word, tf)``. Weights are (1 + log10 tf) * log10(N / df), with N the number of all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.batches import offsets, small_batches

#: Chunk ids of one part of a posting list.
LIST_CHUNKS = 4096


def term_frequency(tokens: DataFrame, word: str = "term") -> DataFrame:
    """``tokens(chunk_id, tokens)`` to ``(chunk_id, term, tf)``; partial counts are made before the shuffle."""
    return tokens.select("chunk_id", F.explode("tokens").alias(word)).groupBy("chunk_id", word).agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame, word: str = "term") -> DataFrame:
    return tf.groupBy(word).agg(F.count("*").alias("df"))


def collection_frequency(tf: DataFrame, word: str = "term") -> DataFrame:
    return tf.groupBy(word).agg(F.sum("tf").alias("cf"))


def codebook(cf: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms, ties by term, numbered from 1."""
    top = cf.orderBy(F.desc("cf"), "term").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("cf"), "term")).cast("long").alias("word_id"), *cf.columns)


def log_tf(tf: Column) -> Column:
    return 1 + F.log10(tf)


def idf(n: Column, df: Column) -> Column:
    return F.log10(n / F.nullif(df, F.lit(0)))


def with_count(df: DataFrame, counted: DataFrame, name: str = "n") -> DataFrame:
    """``df`` with the number of rows of ``counted`` as a column (one row is broadcast)."""
    return df.crossJoin(F.broadcast(counted.agg(F.count("*").alias(name))))


def postings(bag: DataFrame, all_chunks: DataFrame, keep_zero: bool = True) -> DataFrame:
    """``bag(chunk_id, word_id, tf)`` to ``(word_id, chunk_id, w)``; words of all chunks weigh 0 and may be dropped."""
    weighed = with_count(bag.join(document_frequency(bag, "word_id"), "word_id"), all_chunks)
    out = weighed.select("word_id", "chunk_id", (log_tf(F.col("tf")) * idf(F.col("n"), F.col("df"))).alias("w"))
    return out if keep_zero else out.where("w <> 0")


def posting_lists(counted: DataFrame, word: str = "term") -> DataFrame:
    """``counted(chunk_id, term, tf)`` to ``(term, part, postings)``: lists sorted by chunk, cut at every LIST_CHUNKS ids, so
    that a frequent term's list never becomes one row."""
    parts = counted.groupBy(word, F.floor(F.col("chunk_id") / LIST_CHUNKS).alias("part"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("chunk_id", "tf"))).alias("postings"))


def norms(posted: DataFrame) -> DataFrame:
    return posted.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def query_bag(words: DataFrame) -> DataFrame:
    """``words(query_id, word_id)``, one row per occurrence, to ``(query_id, word_id, qtf)``."""
    return words.groupBy("query_id", "word_id").agg(F.count("*").alias("qtf"))


def query_weights(bag: DataFrame, posted: DataFrame, all_chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """``(query_id, word_id, qw)`` of the query's words that have a posting.

    With ``max_chunks`` only postings of chunks up to that id count and it also is the N of the weights.
    """
    if max_chunks is not None:
        posted = posted.where(F.col("chunk_id") <= max_chunks)
    # The document frequency of a query's words, from the same restricted postings.
    counted = bag.join(document_frequency(posted, "word_id"), "word_id")
    counted = counted.withColumn("n", F.lit(max_chunks)) if max_chunks is not None else with_count(counted, all_chunks)
    return counted.select("query_id", "word_id", (log_tf(F.col("qtf")) * idf(F.col("n"), F.col("df"))).alias("qw"))


def term_vectors(counted: DataFrame, book: pa.Table, n: int) -> DataFrame:
    """``counted(chunk_id, doc_id, terms, tfs)`` to ``(chunk_id, doc_id, norm, words, weights)`` over a codebook(word_id, term, df)
    and n chunks. A chunk without a word of the codebook has no row; nothing is shuffled."""
    held = counted.sparkSession.sparkContext.broadcast((book["term"].combine_chunks(), book["word_id"].to_numpy(), np.log10(n / book["df"].to_numpy())))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, rare = held.value
        for batch in batches:
            column = batch.column("terms")
            at = pc.index_in(column.flatten(), value_set=terms).fill_null(-1).to_numpy()
            known = np.flatnonzero(at >= 0)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy())[known]
            w = (1 + np.log10(batch.column("tfs").flatten().to_numpy()[known])) * rare[at[known]]
            size, norm = np.bincount(of, minlength=batch.num_rows), np.sqrt(np.bincount(of, w * w, minlength=batch.num_rows))
            full = np.flatnonzero(size)
            cut = offsets(size[full])
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids[at[known]], w)]
            kept = pa.array(full)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(kept), batch.column("doc_id").take(kept), pa.array(norm[full]), *lists], ["chunk_id", "doc_id", "norm", "words", "weights"])

    small_batches(counted.sparkSession)
    return counted.select("chunk_id", "doc_id", "terms", "tfs").mapInArrow(emit, "chunk_id long, doc_id long, norm double, words array<long>, weights array<double>")


def vectors(posted: DataFrame, all_chunks: DataFrame) -> DataFrame:
    """The same from ``posted(word_id, chunk_id, w)`` and ``all_chunks(chunk_id, doc_id)``."""
    lists = posted.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sort_array(F.collect_list(F.struct("word_id", "w"))).alias("p"))
    return lists.join(all_chunks.select("chunk_id", "doc_id"), "chunk_id").select("chunk_id", "doc_id", "norm", F.col("p.word_id").alias("words"), F.col("p.w").alias("weights"))


def posted(vectors: DataFrame) -> DataFrame:
    """Vectors to ``(word_id, chunk_id, w)``."""
    return vectors.select("chunk_id", F.explode(F.arrays_zip("words", "weights")).alias("p")).select(F.col("p.words").alias("word_id"), "chunk_id", F.col("p.weights").alias("w"))


def best_chunk_per_document(scored: DataFrame) -> DataFrame:
    """``scored(query_id, doc_id, chunk_id, score)``: the best chunk of each document, ties to the smaller chunk."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_n(scored: DataFrame, n: int, tie: str = "chunk_id") -> DataFrame:
    """The n best rows of each query with their ``rank``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
