import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import image as im
from skeinwork.sources import files, html
from skeinwork.streaming.append import append_term_frequencies


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_from_files(spark, tmp_path):
    noise = np.random.default_rng(3).integers(0, 255, (200, 120), dtype=np.uint8)
    (tmp_path / "1.png").write_bytes(png(noise))
    (tmp_path / "2.png").write_bytes(png(np.full((120, 120), 128, np.uint8)))
    (tmp_path / "3.png").write_bytes(b"no image")
    images = files.read_grey_images(spark, f"file://{tmp_path}").withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.png", 1).cast("long"))
    got = {r.doc_id: np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w) for r in images.collect()}
    assert set(got) == {1, 2} and (got[1] == noise).all()
    found = im.extract_descriptors(images).collect()
    assert {r.doc_id for r in found} == {1} and {r.patch_index for r in found} == set(range(16)) and all(len(r.descriptor) == 128 for r in found)
    with pytest.raises(ValueError):
        im.visual_codebook(spark.createDataFrame([([0.0] * 4,)], "descriptor array<float>"), 5)


def test_resize_and_patches(spark):
    big = np.random.default_rng(0).integers(0, 255, (1000, 2000), dtype=np.uint8)
    assert im.resize_area(big).shape == (256, 512) and im.resize_area(big[:100, :100]).shape == (100, 100)
    image = big[:400, :600]
    patches = im.split_patches(image)
    assert len(patches) == 16 and all(p.size for p in patches) and patches[5].shape > (100, 150)
    bounds = im.patch_bounds(spark.createDataFrame([(1, 400, 600)], "doc_id long, h int, w int")).orderBy("patch_index").collect()
    assert [(r.y2 - r.y1, r.x2 - r.x1) for r in bounds] == [p.shape for p in patches]
    assert im.gradient_descriptors(np.full((120, 120), 128, np.uint8)) is None
    assert len(im.gradient_descriptors(big[:240, :240])) > len(im.gradient_descriptors(big[:80, :80]))


def test_csv_and_ingestion(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,title,description,body,image_url,category\nu1,t,"d ""q""","b1\nb2",,\nu2,,d,b,i,c\n')
    rows = files.read_articles(spark, f"file://{tmp_path}/a.csv")
    clean = files.clean_articles(rows).collect()
    assert [(r.url, r.description, r.body, r.image_url, r.category) for r in clean] == [("u1", 'd "q"', "b1\nb2", "", "Unknown")]
    (tmp_path / "f.csv").write_text("title,pubDate,guid,link,description\n A ,d,g1,https://x/news/world-1, B \nA2,d,g1,l,B2\n,d,g2,l,x\n")
    feed = files.read_feed(spark, f"file://{tmp_path}/f.csv").withColumn("input_pos", F.monotonically_increasing_id())
    assert [(r.content, r.category) for r in files.feed_corpus(feed, 10).collect()] == [("A. B", "world")]
    new = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u2"), (4, None)], "input_pos long, url string")
    assert [r.input_pos for r in files.new_documents(new, spark.createDataFrame([("u1",)], "url string")).collect()] == [2]


def test_articles():
    page = '<html><head><title>T</title><meta property="og:url" content="C"></head><body><p>out</p><article><p>One<p> two<script>var a="</p>";</script></p><p>Three</article><p>x</p>'
    a = html.parse_article(page)
    assert a["title"] == "T" and a["canonical"] == "C" and "Three" in a["body"] and "out" not in a["body"] and "var" not in a["body"]
    assert html.parse_article("<p>none</p>") is None and html.parse_article(None) is None


def test_stream_appends(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 30)], "doc_id long, body string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, body string").parquet(f"{tmp_path}/in")
    append_term_frequencies(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert [(r.doc_id, r.position, r.term, r.tf) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 0, "word", 30)]


def test_indexes_from_files_by_command_line(spark, tmp_path):
    from skeinwork.__main__ import main
    from skeinwork.plans.image_index import ImageIndex
    from skeinwork.plans.text_index import TextIndex

    r = np.random.default_rng(2)
    (tmp_path / "images").mkdir()
    for k in (1, 2):
        pixels = r.integers(0, 256, (96, 96), dtype=np.uint8)
        (tmp_path / "images" / f"{k}.png").write_bytes(png(pixels))
    spark.createDataFrame([(k, f"u{k}", "t", "w " * 40, "c", None) for k in (1, 2, 3)], "doc_id long, url string, title string, body string, category string, image_url string").write.parquet(f"file://{tmp_path}/docs")
    main(["build-image", f"file://{tmp_path}/docs", f"file://{tmp_path}/images", f"file://{tmp_path}/index", "--codebook", "8", "--limit", "1"])
    index = ImageIndex.read(spark, f"file://{tmp_path}/index")
    assert index.centroids.count() == 8 and {r.doc_id for r in index.chunks.collect()} == {1}
    (tmp_path / "a.csv").write_text("url,title,description,body,image_url,category\nu1,t,d," + "running foxes " * 20 + ",,\nu1,t2,d,b,i,c\n")
    main(["build-text", f"file://{tmp_path}/a.csv", f"file://{tmp_path}/text"])
    assert [(r.url, r.doc_id > 0) for r in TextIndex.read(spark, f"file://{tmp_path}/text").docs.collect()] == [("u1", True)]


def test_pages_come_in_small_batches(spark):
    """a worker holds one batch of pages, of Spark's own size 10,000 of them; the session's own numbers stay."""
    from skeinwork.functions import batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), F.repeat(F.lit("text "), 30), F.lit("</p></article>")).alias("html")).coalesce(1)
        assert html.extract_articles(pages).count() == 3000 and spark.conf.get(name) == str(batches.BATCH_ROWS)
        sizes = spark.range(3000).coalesce(1).mapInArrow(lambda found: found, "id long").mapInPandas(lambda found: (p.iloc[:1].assign(id=len(p)) for p in found), "id long")
        assert max(r.id for r in sizes.collect()) <= batches.BATCH_ROWS
        spark.conf.set(name, "77")
        html.extract_articles(pages)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)
