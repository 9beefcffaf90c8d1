"""Ranked retrieval over an index, and the fusion of two modalities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import snippet
from skeinwork.operators import vectorspace as vs

RESULT = ["query_id", "rank", "chunk_id", "doc_id", "title", "url", "category", "image_url", "score"]


def shown(kept: DataFrame, chunks: DataFrame, docs: DataFrame, few: bool, snippets: bool = True) -> DataFrame:
    """``kept(query_id, rank, chunk_id, doc_id, score)`` to result rows with their metadata; if there are ``few`` of them, they
    go to the documents and chunks."""
    near = F.broadcast if few else lambda df: df
    out = docs.select("doc_id", "title", "url", "category", "image_url").join(near(kept), "doc_id")
    if snippets:
        out = chunks.select("chunk_id", "content").join(near(out), "chunk_id").withColumn("snippet", snippet(F.col("content")))
    return out.select(*RESULT, *(["snippet"] if snippets else []))


def normalised(results: DataFrame) -> DataFrame:
    """Scores over the largest of their query; unchanged where that isn't positive."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return results.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")))


def fuse(text: DataFrame | None, image: DataFrame | None, docs: DataFrame, alpha: float = 0.5, n: int = 10) -> DataFrame:
    """alpha * text + (1 - alpha) * image over normalised pools ``(query_id, doc_id, score)``; what one lacks counts 0.

    The top n are cut first and documents without metadata dropped then, so fewer may return.
    """
    parts = [normalised(pool).select("query_id", "doc_id", (F.col("score") * share).alias("score")) for pool, share in ((text, alpha), (image, 1 - alpha)) if pool is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    summed = both.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return vs.top_n(summed, n, tie="doc_id").join(docs.select("doc_id", "title", "url", "category", "image_url"), "doc_id").select("query_id", "rank", "doc_id", "title", "url", "category", "image_url", "score")
