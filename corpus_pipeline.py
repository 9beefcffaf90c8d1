"""A corpus from raw documents to packed sequences, in five stages, each written and read again.

Language identification drops what is in no known language, line deduplication cuts lines that other documents
hold, near-duplicate detection keeps one document of each group, decontamination drops documents that hold a test
item, and packing deals the rest out to training sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm._fit import fold
from skeinwork.llm._store import Store
from skeinwork.llm.decontaminate import decontaminate
from skeinwork.llm.language import keep_identified, learn_languages
from skeinwork.llm.line_dedup import line_dedup
from skeinwork.llm.near_dedup import near_dedup
from skeinwork.llm.packing import pack_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the models reject: no letters, or a cross-entropy beyond that of the languages learned."""
    return keep_identified(docs, learn_languages(docs.where(fold("doc_id", 4) != 2)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that a document with a smaller id holds as well; n_chars follows the text."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents with a similarity of 0.8 or more in shingles of two words, the rule of op4."""
    copies = near_dedup(docs, shingle_words=2).where("NOT kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item within its error budget."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the language models nor edit matching nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's table is in the shared folder."""
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
