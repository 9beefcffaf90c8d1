"""Articles from raw HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.batches import small_batches
from skeinwork.functions.text import clean_body

MIN_BODY = 100


class _Article(HTMLParser):
    """Meta properties, the title, and the text of the paragraphs in the first article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title: list[str] = []
        self.paragraphs: list[list[str]] = []
        self.open: list[int] = []
        self.depth = 0
        self.seen = self.in_title = False
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("property") and a.get("content") is not None:
            self.meta.setdefault(a["property"], a["content"])
        elif tag == "title":
            self.in_title = not self.title
        elif tag in ("script", "style"):
            self.hidden += 1
        elif tag == "article" and (self.depth or not self.seen):
            self.depth, self.seen = self.depth + 1, True
        elif tag == "p" and self.depth:
            # An open paragraph goes on: a parser that doesn't repair markup nests the new one in it.
            self.paragraphs.append([])
            self.open.append(len(self.paragraphs) - 1)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "article" and self.depth:
            self.depth -= 1
            self.open = self.open if self.depth else []
        elif tag == "p" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            for i in self.open:
                self.paragraphs[i].append(data.strip())


def parse_article(html: str) -> dict[str, str | None] | None:
    """Title, description, image, section, canonical url and body; None without an article element."""
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    if not parser.seen:
        return None
    return {
        "title": parser.meta.get("og:title") or "".join(parser.title).strip() or None,
        "description": parser.meta.get("og:description"), "image_url": parser.meta.get("og:image"),
        "category": parser.meta.get("article:section"), "canonical": parser.meta.get("og:url"),
        "body": "\n\n".join("".join(p) for p in parser.paragraphs),
    }


def extract_articles(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to articles with a cleaned body of at least 100 characters.

    Pages come in small batches, so a worker's memory doesn't depend on how many there are.
    """
    names = ["url", "title", "description", "body", "image_url", "category"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (url, html) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if (a := parse_article(html)) is not None:
                    at.append(i)
                    rows.append((a["canonical"] or url, a["title"], a["description"], a["body"], a["image_url"], a["category"]))
            found = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), *found], ["page_id", *names])

    small_batches(pages.sparkSession)
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(emit, f"page_id long, {', '.join(f'{n} string' for n in names)}")
    return raw.withColumn("body", clean_body(F.col("body"))).where(F.length("body") >= MIN_BODY)
