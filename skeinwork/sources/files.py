"""Flat files, images and ingestion into the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork import schemas
from skeinwork.functions.text import synth_content, url_category, url_key


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schemas.ARTICLE_CSV)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schemas.FEED_CSV)


def read_grey_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, h, w, pixels)``: grey bytes, top row first; files that can't be decoded are dropped."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def grey(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                x = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n).astype(float)
                out.append((x[:, :, 0] if n == 1 else x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299).round().astype(np.uint8).tobytes())
            yield pdf[["origin", "height", "width"]].set_axis(["path", "h", "w"], axis=1).assign(pixels=out)

    return raw.mapInPandas(grey, "path string, h int, w int, pixels binary")


def with_image(docs: DataFrame, image_paths: DataFrame) -> DataFrame:
    """Documents whose ``{doc_id}.jpg`` (or other suffix) is among ``image_paths(path)``."""
    ids = image_paths.select(F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).alias("name")).where("name <> ''").select(F.col("name").cast("long").alias("doc_id")).distinct()
    return docs.join(ids, "doc_id", "left_semi")


def clean_articles(rows: DataFrame, needed: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """Without rows that lack a needed column; missing categories, descriptions and images get their defaults."""
    return rows.dropna(subset=list(needed)).fillna({"category": "Unknown", "description": "", "image_url": ""})


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def new_documents(rows: DataFrame, existing: DataFrame, order: str = "input_pos") -> DataFrame:
    """What an insert that ignores known urls would add: the first row of each url that ``existing`` lacks."""
    return first_by(rows.where("url IS NOT NULL"), "url", order).join(existing.select("url"), "url", "left_anti")


def pending(rows: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url, without its query, hasn't been done."""
    keys = done.select(url_key(F.col(url)).alias("__key")).distinct()
    return rows.withColumn("__key", url_key(F.col(url))).join(keys, "__key", "left_anti").drop("__key")


def feed_corpus(feed: DataFrame, limit: int | None = None, order: str = "input_pos") -> DataFrame:
    """A corpus from feed rows: one chunk per entry, made of title and description, category from the link."""
    rows = first_by(feed.dropna(subset=["title", "description"]), "guid", order)
    rows = rows.orderBy(order).limit(limit) if limit else rows
    return rows.select(order, F.col("link").alias("url"), "title", "description", synth_content(F.col("title"), F.col("description")).alias("content"), url_category(F.col("link")).alias("category"))
