"""The text index: chunks, counted terms, codebook, vectors and postings, built lazily, stored as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.analysis import counted
from skeinwork.functions.chunking import MIN_WORDS, chunk_documents
from skeinwork.operators import vectorspace as vs
from skeinwork.operators.best import cosine
from skeinwork.operators.search import shown
from skeinwork.sources.tables import Versions

CODEBOOK_SIZE = 5000


@dataclass
class TextIndex:
    """Parts of an index; ``docs`` holds the metadata of results. Terms are stems unless ``stem`` is off."""

    docs: DataFrame
    chunks: DataFrame
    counted: DataFrame  # chunk_id, doc_id, terms, tfs; a row a chunk
    codebook: DataFrame  # word_id, term, cf, df
    vectors: DataFrame  # chunk_id, doc_id, norm, words, weights; a row a chunk with a word of the codebook
    postings: DataFrame
    stem: bool = True

    PARTS = ("docs", "chunks", "counted", "codebook", "vectors", "postings")

    @classmethod
    def build(cls, docs: DataFrame, k: int = CODEBOOK_SIZE, separator: str = r"\n\n+", min_words: int = MIN_WORDS, stem: bool = True) -> TextIndex:
        return cls.from_chunks(docs, chunk_documents(docs, separator, min_words), k, stem)

    @classmethod
    def from_chunks(cls, docs: DataFrame, chunks: DataFrame, k: int = CODEBOOK_SIZE, stem: bool = True) -> TextIndex:
        terms = cls.count(chunks, stem)
        book = cls.book(terms, k)
        made = cls.weigh(chunks, terms, book)
        return cls(docs.drop("body"), chunks, terms, book, made, vs.posted(made), stem)

    @staticmethod
    def count(chunks: DataFrame, stem: bool) -> DataFrame:
        return counted(chunks.select("chunk_id", "doc_id", "content"), "content", stem)

    @staticmethod
    def book(counted: DataFrame, k: int) -> DataFrame:
        """The codebook; how many chunks hold a term is counted along."""
        each = counted.select(F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy(F.col("t.terms").alias("term"))
        return vs.codebook(each.agg(F.sum("t.tfs").alias("cf"), F.count("*").alias("df")), k)

    @staticmethod
    def weigh(chunks: DataFrame, counted: DataFrame, book: DataFrame) -> DataFrame:
        return vs.term_vectors(counted, book.select("word_id", "term", "df").toArrow(), chunks.count())

    @property
    def terms(self) -> DataFrame:
        """``(chunk_id, term, tf)``."""
        return self.counted.select("chunk_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("chunk_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))

    @property
    def norms(self) -> DataFrame:
        return self.vectors.select("chunk_id", "norm")

    @classmethod
    def create(cls, docs: DataFrame, path: str, k: int = CODEBOOK_SIZE, separator: str = r"\n\n+", min_words: int = MIN_WORDS, stem: bool = True) -> TextIndex:
        """Build the index at the path, each part from the stored one before it.

        A version of its own is written and then made the current one, so readers never meet parts of two builds.
        Postings are sorted by word, so that a lookup skips most row groups.
        """
        new = Versions(docs.sparkSession, path).begin()
        meta = new.put(docs.drop("body"), "docs")
        chunks = new.put(chunk_documents(docs, separator, min_words), "chunks")
        terms = new.put(cls.count(chunks, stem), "counted")
        return cls._finish(new, meta, chunks, terms, new.put(cls.book(terms, k), "codebook"), stem)

    def write(self, path: str) -> TextIndex:
        """Store this index as the path's current version."""
        new = Versions(self.codebook.sparkSession, path).begin()
        return self._finish(new, new.put(self.docs, "docs"), new.put(self.chunks, "chunks"), new.put(self.counted, "counted"), new.put(self.codebook, "codebook"), self.stem)

    @classmethod
    def _finish(cls, new: Versions, docs: DataFrame, chunks: DataFrame, terms: DataFrame, book: DataFrame, stem: bool) -> TextIndex:
        made = new.put(cls.weigh(chunks, terms, book), "vectors")
        posted = new.put(cls.sorted_postings(made), "postings")
        new.commit()
        return cls(docs, chunks, terms, book, made, posted, stem)

    @staticmethod
    def sorted_postings(vectors: DataFrame) -> DataFrame:
        return vs.posted(vectors).repartitionByRange("word_id", "chunk_id").sortWithinPartitions("word_id", "chunk_id")

    @classmethod
    def read(cls, spark: SparkSession, path: str, stem: bool = True) -> TextIndex:
        """The current version at the path; ``stem`` as it was built."""
        now = Versions(spark, path).current()
        return cls(*[now.get(p) for p in cls.PARTS], stem)

    def bag(self, queries: DataFrame) -> DataFrame:
        """``queries(query_id, text)`` to ``(query_id, word_id, qtf)``; words outside the codebook add nothing."""
        words = counted(queries.select("query_id", "text"), "text", self.stem).select("query_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
        return words.select("query_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("n")).join(self.codebook, "term").groupBy("query_id", "word_id").agg(F.sum("n").alias("qtf"))

    def best(self, queries: DataFrame, n: int, by_doc: bool = True, max_chunks: int | None = None) -> tuple[DataFrame, bool]:
        """``(query_id, chunk_id, doc_id, score, rank)`` of the n best, and whether they are few."""
        bag = self.bag(queries.where(F.trim("text") != ""))
        held = self.vectors if max_chunks is None else self.vectors.where(F.col("chunk_id") <= max_chunks)
        return cosine(held, vs.query_weights(bag, vs.posted(held), self.chunks, max_chunks), n, by_doc)

    def search(self, queries: DataFrame, n: int = 10, group_by_doc: bool = True, max_chunks: int | None = None) -> DataFrame:
        """Result rows of all queries: the n documents (or chunks) of highest cosine, with snippets.

        With ``max_chunks`` only chunks up to that id are searched and it also is the N of the query's weights; the chunks'
        own weights and norms stay those of the whole collection.
        """
        kept, few = self.best(queries, n, group_by_doc, max_chunks)
        return shown(kept, self.chunks, self.docs, few)

    def pool(self, queries: DataFrame, n: int) -> DataFrame:
        """``(query_id, doc_id, score)`` of the n best documents, for fusion."""
        return self.best(queries, n)[0].select("query_id", "doc_id", "score")
