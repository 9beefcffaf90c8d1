"""Incremental index maintenance by micro-batches (an addition of ours: the batch build stays the reference point)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.functions.analysis import analyse
from skeinwork.functions.chunking import MIN_WORDS, listed
from skeinwork.operators import vectorspace as vs


def chunk_stream(docs: DataFrame, separator: str = r"\n\n+", min_words: int = MIN_WORDS) -> DataFrame:
    """A stream of documents to a stream of chunks; dense chunk ids need the whole table and are given by the next build."""
    lists = listed(docs.where("body IS NOT NULL").select("doc_id", "body"), separator, min_words)
    each = lists.select("doc_id", F.posexplode_outer("chunks").alias("position", "c")).where("position IS NOT NULL")
    return each.select("doc_id", "position", F.col("c")["content"].alias("content"), F.col("c")["word_count"].alias("word_count"))


def append_term_frequencies(docs: DataFrame, path: str, checkpoint: str, separator: str = r"\n\n+") -> StreamingQuery:
    """Append ``(doc_id, position, term, tf)`` of each micro-batch; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        tokens = chunk_stream(batch, separator).select(F.struct("doc_id", "position").alias("chunk_id"), analyse(F.col("content")).alias("tokens"))
        tf = vs.term_frequency(tokens).select("chunk_id.doc_id", "chunk_id.position", "term", "tf")
        tf.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
