"""Build and search indexes from a shell: ``python -m skeinwork build-text ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.text import clean_body
from skeinwork.operators import image as im
from skeinwork.plans.engine import Engine
from skeinwork.plans.image_index import ImageIndex
from skeinwork.plans.text_index import TextIndex
from skeinwork.sources import files


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with a doc_id, or an article CSV, which is cleaned and gets ids from its urls' hashes."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    rows = files.clean_articles(files.read_articles(spark, path)).withColumn("body", clean_body(F.col("body")))
    return files.first_by(rows.where("url IS NOT NULL"), "url", "title").withColumn("doc_id", F.xxhash64("url").bitwiseAND(F.lit(2**62 - 1)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skeinwork")
    sub = p.add_subparsers(dest="command", required=True)
    text = sub.add_parser("build-text", help="chunks, codebook, postings and norms of documents")
    text.add_argument("documents")
    text.add_argument("index")
    text.add_argument("--codebook", type=int, default=5000)
    text.add_argument("--no-stems", action="store_true")
    image = sub.add_parser("build-image", help="descriptors, visual codebook and index of the images {doc_id}.jpg of a folder")
    image.add_argument("documents")
    image.add_argument("images")
    image.add_argument("index")
    image.add_argument("--codebook", type=int, default=512)
    image.add_argument("--limit", type=int, help="documents with an image, by id")
    search = sub.add_parser("search", help="the best documents of a text index")
    search.add_argument("index")
    search.add_argument("text")
    search.add_argument("--top", type=int, default=10)
    search.add_argument("--fts", action="store_true", help='web search syntax: words, "phrases", -unwanted, OR')
    search.add_argument("--no-stems", action="store_true")
    return p


def build_image(spark: SparkSession, documents: str, images: str, path: str, k: int, limit: int | None = None) -> ImageIndex:
    docs = read_documents(spark, documents).drop("body")
    grey = files.read_grey_images(spark, images).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).try_cast("long")).where("doc_id IS NOT NULL")
    grey = grey.join(docs.select("doc_id").orderBy("doc_id").limit(limit) if limit else docs.select("doc_id"), "doc_id", "left_semi")
    found = im.extract_descriptors(grey).withColumn("chunk_id", F.xxhash64("doc_id", "patch_index"))
    return ImageIndex.create(docs, found.persist(), path, k)


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"skeinwork {a.command}").getOrCreate()
    if a.command == "build-text":
        TextIndex.create(read_documents(spark, a.documents), a.index, a.codebook, stem=not a.no_stems)
    elif a.command == "build-image":
        build_image(spark, a.documents, a.images, a.index, a.codebook, a.limit)
    else:
        engine = Engine(TextIndex.read(spark, a.index, not a.no_stems))
        asked = spark.createDataFrame([(1, a.text)], "query_id long, text string")
        found = engine.search_fts(asked, a.top) if a.fts else engine.search_text(asked, a.top)
        found.orderBy("rank").drop("query_id").show(a.top, truncate=60)


if __name__ == "__main__":
    main()
