"""The image index: the same vector space over visual words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import image as im
from skeinwork.operators import vectorspace as vs
from skeinwork.operators.best import cosine
from skeinwork.operators.search import shown
from skeinwork.sources.tables import Versions


@dataclass
class ImageIndex:
    docs: DataFrame
    chunks: DataFrame  # chunk_id, doc_id, patch_index
    centroids: DataFrame
    bag: DataFrame
    postings: DataFrame
    norms: DataFrame

    PARTS = ("docs", "chunks", "centroids", "bag", "postings", "norms")

    @classmethod
    def create(cls, docs: DataFrame, descriptors: DataFrame, path: str, k: int = 512, centroids: DataFrame | None = None) -> ImageIndex:
        """Descriptors to a stored index: a codebook of k visual words (trained if not given), then all parts."""
        return cls.build(docs, descriptors, im.visual_codebook(descriptors, k) if centroids is None else centroids).write(path)

    def write(self, path: str) -> ImageIndex:
        """Store all parts as the path's current version; postings are sorted by word."""
        new = Versions(self.bag.sparkSession, path).begin()
        docs, chunks, centroids = new.put(self.docs, "docs"), new.put(self.chunks, "chunks"), new.put(self.centroids, "centroids")
        bag = new.put(self.bag, "bag")
        posted = vs.postings(bag, chunks, keep_zero=False)
        posted = new.put(posted.repartitionByRange("word_id", "chunk_id").sortWithinPartitions("word_id", "chunk_id"), "postings")
        norms = new.put(vs.norms(posted), "norms")
        new.commit()
        return ImageIndex(docs, chunks, centroids, bag, posted, norms)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ImageIndex:
        now = Versions(spark, path).current()
        return cls(*[now.get(p) for p in cls.PARTS])

    @classmethod
    def build(cls, docs: DataFrame, descriptors: DataFrame, centroids: DataFrame) -> ImageIndex:
        """``descriptors(chunk_id, doc_id, patch_index, descriptor)``; words of all patches are dropped."""
        bag = im.histograms(im.quantize(descriptors, centroids))
        chunks = descriptors.select("chunk_id", "doc_id", "patch_index").distinct()
        posted = vs.postings(bag, chunks, keep_zero=False)
        return cls(docs, chunks, centroids, bag, posted, vs.norms(posted))

    def query_words(self, queries: DataFrame) -> DataFrame:
        """``queries(query_id, descriptor)``, one row a descriptor of any patch, to ``(query_id, word_id, qtf)``."""
        return vs.query_bag(im.quantize(queries, self.centroids).select("query_id", "word_id"))

    def best(self, queries: DataFrame, n: int, by_doc: bool = True, max_chunks: int | None = None) -> tuple[DataFrame, bool]:
        """``(query_id, chunk_id, doc_id, score, rank)`` of the n best, and whether they are few."""
        weights = vs.query_weights(self.query_words(queries), self.postings, self.chunks, max_chunks)
        held = vs.vectors(self.postings, self.chunks)
        return cosine(held if max_chunks is None else held.where(F.col("chunk_id") <= max_chunks), weights, n, by_doc)

    def search(self, queries: DataFrame, n: int = 10, group_by_doc: bool = True, max_chunks: int | None = None) -> DataFrame:
        kept, few = self.best(queries, n, group_by_doc, max_chunks)
        return shown(kept, self.chunks, self.docs, few, snippets=False)

    def pool(self, queries: DataFrame, n: int) -> DataFrame:
        return self.best(queries, n)[0].select("query_id", "doc_id", "score")

    def idf(self, k: int) -> DataFrame:
        """``(word_id, df, idf)`` of all k words; idf 0 where no patch holds the word."""
        words = self.bag.sparkSession.range(1, k + 1).withColumnRenamed("id", "word_id")
        df = vs.with_count(words.join(vs.document_frequency(self.bag, "word_id"), "word_id", "left").fillna({"df": 0}), self.chunks)
        return df.select("word_id", "df", F.when(F.col("df") > 0, vs.idf(F.col("n"), F.col("df"))).otherwise(0.0).alias("idf"))

    def dense_query(self, queries: DataFrame, k: int, max_chunks: int | None = None) -> DataFrame:
        """``(query_id, vector)``: TF-IDF weights of the query's words as an array of k."""
        posted = self.postings if max_chunks is None else self.postings.where(F.col("chunk_id") <= max_chunks)
        words = vs.with_count(self.query_words(queries).join(vs.document_frequency(posted, "word_id"), "word_id"), self.chunks)
        n = F.lit(max_chunks) if max_chunks is not None else F.col("n")
        weights = words.select("query_id", "word_id", (vs.log_tf(F.col("qtf")) * vs.idf(n, F.col("df"))).alias("w"))
        packed = weights.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "w"))).alias("m"))
        return packed.select("query_id", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("vector"))
