"""Explicit schemas of the engine's tables and of its flat-file inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()

DOCUMENTS = _schema(doc_id=_L, url=_S, title=_S, description=_S, body=_S, image_url=_S, category=_S, created_at=T.TimestampType())
TEXT_CHUNKS = _schema(chunk_id=_L, doc_id=_L, position=_I, content=_S, word_count=_I)
CODEBOOK_TEXT = _schema(word_id=_L, term=_S, cf=_L)
POSTINGS = _schema(word_id=_L, chunk_id=_L, w=_D)
NORMS = _schema(chunk_id=_L, norm=_D)
CODEBOOK_IMAGE = _schema(word_id=_L, centroid=T.ArrayType(_D))
DESCRIPTORS = _schema(doc_id=_L, patch_index=_I, desc_index=_I, descriptor=T.ArrayType(T.FloatType()))

#: Flat files.
ARTICLE_CSV = _schema(url=_S, title=_S, description=_S, body=_S, image_url=_S, category=_S)
FEED_CSV = _schema(title=_S, pubDate=_S, guid=_S, link=_S, description=_S)
