"""One object that answers text, image, combined and full-text searches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skeinwork.operators import fts
from skeinwork.operators.search import fuse
from skeinwork.plans.image_index import ImageIndex
from skeinwork.plans.text_index import TextIndex


class Engine:
    def __init__(self, text: TextIndex | None = None, image: ImageIndex | None = None):
        self.text, self.image = text, image

    def search_text(self, queries: DataFrame, top_n: int = 10) -> DataFrame:
        return self.text.search(queries, top_n)

    def search_image(self, descriptors: DataFrame, top_n: int = 10) -> DataFrame:
        return self.image.search(descriptors, top_n)

    def search_multimodal(self, queries: DataFrame | None, descriptors: DataFrame | None, alpha: float = 0.5, top_n: int = 10) -> DataFrame:
        """Pools of 3 * top_n of either modality, normalised and added; either side may be missing."""
        text = self.text.pool(queries, 3 * top_n) if queries is not None else None
        image = self.image.pool(descriptors, 3 * top_n) if descriptors is not None else None
        if text is None and image is None:
            raise ValueError("a text or an image is needed")
        return fuse(text, image, (self.text or self.image).docs, alpha, top_n)

    def search_fts(self, queries: DataFrame, top_n: int = 10, pool: int = 16, max_chunks: int | None = None) -> DataFrame:
        """Web search syntax: words, "phrases", -unwanted, OR."""
        return fts.fts_search(self.text.chunks, queries, self.text.docs, top_n, pool, max_chunks)
