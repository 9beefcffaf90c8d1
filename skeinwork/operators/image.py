"""Images as bags of visual words: patches, descriptors, quantisation, histograms, codebook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.ann import nearest_centroid

MAX_SIDE, GRID, OVERLAP = 512, 4, 0.25


def resize_area(pixels: np.ndarray, max_side: int = MAX_SIDE) -> np.ndarray:
    """Shrink a grey image so that its longer side is ``max_side``, averaging the area under each new pixel."""
    h, w = pixels.shape
    scale = max_side / max(h, w)
    if scale >= 1:
        return pixels

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        overlap = np.minimum(edges[1:, None], np.arange(1, old + 1)[None, :]) - np.maximum(edges[:-1, None], np.arange(old)[None, :])
        m = np.maximum(overlap, 0)
        return m / m.sum(1, keepdims=True)

    out = weights(h, round(h * scale)) @ pixels.astype(float) @ weights(w, round(w * scale)).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def patch_bounds(sizes: DataFrame, grid: int = GRID, overlap: float = OVERLAP) -> DataFrame:
    """``sizes(.., h, w)`` to one row per patch: ``patch_index`` row by row, and y1, y2, x1, x2 clipped at the border."""
    cell = lambda side: F.floor(F.col(side) / grid).cast("int")
    margin = lambda side: F.floor(cell(side) * overlap).cast("int")
    low = lambda side, k: F.greatest(F.lit(0), k * cell(side) - margin(side))
    high = lambda side, k: F.least(F.col(side), (k + 1) * cell(side) + margin(side))
    each = sizes.withColumn("patch_index", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))))
    i, j = F.floor(F.col("patch_index") / grid).cast("int"), F.col("patch_index") % grid
    return each.select(*each.columns, low("h", i).alias("y1"), high("h", i).alias("y2"), low("w", j).alias("x1"), high("w", j).alias("x2"))


def split_patches(pixels: np.ndarray, grid: int = GRID, overlap: float = OVERLAP) -> list[np.ndarray]:
    """The patches of one image, in the order of ``patch_bounds``."""
    (h, w), out = pixels.shape[:2], []
    for n in range(grid * grid):
        spans = []
        for side, k in ((h, n // grid), (w, n % grid)):
            cell = side // grid
            margin = int(cell * overlap)
            spans.append(slice(max(0, k * cell - margin), min(side, (k + 1) * cell + margin)))
        out.append(pixels[spans[0], spans[1]])
    return out


def gradient_descriptors(patch: np.ndarray, step: int = 16) -> np.ndarray | None:
    """128 numbers for each textured cell of a patch: 4x4 histograms of 8 gradient directions, as in Lowe (2004) but on a
    regular grid of points instead of scale-space extrema. None for a flat patch."""
    if min(patch.shape) < step:
        return None
    gy, gx = np.gradient(patch.astype(float))
    size, angle = np.hypot(gx, gy), np.floor((np.arctan2(gy, gx) + np.pi) / (2 * np.pi) * 8).astype(int) % 8
    out = []
    for y in range(0, patch.shape[0] - step + 1, step):
        for x in range(0, patch.shape[1] - step + 1, step):
            s, a = size[y : y + step, x : x + step], angle[y : y + step, x : x + step]
            if s.mean() < 1.0:
                continue
            cell = (np.arange(step) * 4 // step)[:, None] * 4 + (np.arange(step) * 4 // step)[None, :]
            v = np.bincount((cell * 8 + a).ravel(), s.ravel(), 128)
            v = np.minimum(v / np.linalg.norm(v), 0.2)
            out.append(v / np.linalg.norm(v))
    return np.array(out, dtype=np.float32) if out else None


def extract_descriptors(images: DataFrame, provider: Callable[[np.ndarray], np.ndarray | None] = gradient_descriptors, max_side: int = MAX_SIDE) -> DataFrame:
    """``images(doc_id, h, w, pixels)`` with grey rows of bytes to ``(doc_id, patch_index, desc_index, descriptor)``.

    ``provider`` gives a patch's descriptors, or None; any detector can be plugged in. Undecodable images (null pixels)
    give no rows.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, h, w, raw in zip(pdf["doc_id"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                if raw is None:
                    continue
                image = resize_area(np.frombuffer(raw, dtype=np.uint8).reshape(h, w), max_side)
                for p, patch in enumerate(split_patches(image)):
                    found = provider(patch)
                    rows += [(doc, p, k, v.tolist()) for k, v in enumerate(found if found is not None else ())]
            yield pd.DataFrame(rows, columns=["doc_id", "patch_index", "desc_index", "descriptor"])

    return images.mapInPandas(emit, "doc_id long, patch_index int, desc_index int, descriptor array<float>")


def visual_codebook(descriptors: DataFrame, k: int = 512, seed: int = 42) -> DataFrame:
    """``(word_id, centroid)`` with ids 1..k by k-means; an error if there are fewer descriptors than k."""
    vectors = descriptors.select(array_to_vector(F.col("descriptor").cast("array<double>")).alias("features"))
    if vectors.limit(k).count() < k:
        raise ValueError(f"fewer descriptors than the {k} visual words asked for")
    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors)
    rows = [(i + 1, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return descriptors.sparkSession.createDataFrame(rows, "word_id long, centroid array<double>")


def quantize(descriptors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``descriptors(.., descriptor)`` with the ``word_id`` of the nearest centroid, ties to the smaller id."""
    return nearest_centroid(descriptors, centroids, "descriptor")


def histograms(quantised: DataFrame) -> DataFrame:
    """``(chunk_id, word_id, tf)``: how often each visual word occurs in each patch."""
    return quantised.groupBy("chunk_id", "word_id").agg(F.count("*").alias("tf"))


def dense_histograms(bag: DataFrame, k: int) -> DataFrame:
    """``(chunk_id, histogram)``: an array of k counts, for words 1..k."""
    packed = bag.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "tf"))).alias("m"))
    return packed.select("chunk_id", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("histogram"))
