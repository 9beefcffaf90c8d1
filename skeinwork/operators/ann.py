"""Dense vectors: exact cosine neighbours, inverted lists and random-projection hashing."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import vectorspace as vs
from skeinwork.sources.tables import Versions, session_dir

#: Queries and vectors that meet in one task of an exact search: some 30 MB and 60 MB at 512 components.
QUERY_BLOCK, VECTOR_BLOCK = 8192, 16_384
#: Rows of a slice of an inverted list, and of the files and tasks that hold it.
LIST_ROWS = 16_384
#: Rows that lists are trained on, and rows that the number of probes is measured with.
TRAINING_ROWS, TUNING_ROWS = 100_000, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def prepared(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """With components as doubles and the ``norm``; null and all-zero vectors, which have no direction, are left out."""
    return vectors.withColumn(vector_col, F.col(vector_col).cast("array<double>")).withColumn("norm", length(F.col(vector_col))).where("norm > 0")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_chunks(vectors: DataFrame, queries: DataFrame, n: int, admit: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``prepared`` vectors(chunk_id, doc_id, vector) and queries(query_id, vector): the n nearest chunks of each query by cosine.

    Both sides are dealt into blocks of bounded size, every query block meets every vector block in a task of its own,
    and each of these keeps n rows a query. Vectors of one length only.
    """
    parts = lambda df, rows: max(1, -(-df.count() // rows))
    n_q, n_v = parts(queries, QUERY_BLOCK), parts(vectors, VECTOR_BLOCK)
    n_v = max(n_v, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * n_v))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    v = vectors.select("chunk_id", "doc_id", "vector", "norm", F.pmod(F.xxhash64("chunk_id"), F.lit(n_v)).cast("int").alias("v"), every(n_q).alias("q"))
    q = queries.select("query_id", "vector", "norm", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("q"), every(n_v).alias("v"))
    return _met(v, q, ["q", "v"], n, admit)


def _met(v: DataFrame, q: DataFrame, on: list[str], n: int, admit: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The n nearest chunks of each query where vectors and queries with equal ``on`` meet; each such group is one task's.

    ``admit(queries, vectors)`` tells, as a matrix, which pairs of unit vectors count. Queries may bring a ``least`` score.
    """
    # Names of their own: both sides may come from one table.
    bounded = ["least"] if "least" in q.columns else []
    q = q.select(F.col("query_id").alias("asked"), F.col("vector").alias("qv"), F.col("norm").alias("qn"), *bounded, *on)

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({k: pa.array([], pa.float64() if k == "score" else pa.int64()) for k in ("query_id", "chunk_id", "doc_id", "score")})
        x, ids, docs = _matrix(vectors["vector"]) / vectors["norm"].to_numpy()[:, None], vectors["chunk_id"].to_numpy(), vectors["doc_id"].to_numpy()
        floor = queries["least"].to_numpy() if bounded else np.full(queries.num_rows, -2.0)
        asked, y = queries["asked"].to_numpy(), _matrix(queries["qv"]) / queries["qn"].to_numpy()[:, None]
        keep, out = min(n, len(ids)), []
        for at in range(0, len(asked), 512):
            score = np.round(y[at : at + 512] @ x.T, 9)
            if admit is not None:
                score[~admit(y[at : at + 512], x)] = -2
            # All ties of the n-th best stay: the last step takes the smaller ids.
            least = np.partition(score, len(ids) - keep, axis=1)[:, len(ids) - keep]
            row, col = np.nonzero((score >= np.maximum(least, floor[at : at + 512])[:, None]) & (score >= -1.5))
            order = np.lexsort((ids[col], -score[row, col], row))
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[rank < n], col[rank < n]
            out.append((asked[at + row], ids[col], docs[col], score[row, col]))
        return pa.table({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("query_id", "chunk_id", "doc_id", "score"))})

    return vs.top_n(v.groupBy(*on).cogroup(q.groupBy(*on)).applyInArrow(best, "query_id long, chunk_id long, doc_id long, score double"), n)


def by_document(found: DataFrame, n: int, docs: DataFrame | None = None) -> DataFrame:
    """The best chunk of each document, then the n best, with the metadata of ``docs`` if given (unknown documents go)."""
    out = vs.top_n(vs.best_chunk_per_document(found.drop("rank")), n)
    return out if docs is None else out.join(docs.select("doc_id", "title", "url", "category", "image_url"), "doc_id")


def knn_cosine(vectors: DataFrame, queries: DataFrame, n: int = 10, pool: int = 16, max_id: int | None = None, docs: DataFrame | None = None) -> DataFrame:
    """``vectors(chunk_id, doc_id, vector)`` and ``queries(query_id, vector)``: n documents by exact cosine.

    The n * ``pool`` nearest chunks are kept first, then the best chunk of each document.
    """
    v = prepared(vectors) if max_id is None else prepared(vectors.where(F.col("chunk_id") <= max_id))
    return by_document(nearest_chunks(v, prepared(queries), n * pool), n, docs)


def ivf_lists(rows: int) -> int:
    """Number of lists: a thousandth of the rows, or the square root beyond a million."""
    return max(1, rows // 1000) if rows <= 1_000_000 else int(math.sqrt(rows))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector_col: str = "vector", probes: int = 1) -> DataFrame:
    """``vectors`` with ``word_id``, and with several ``probes`` ``nth`` and the squared distance ``d2``, of the nearest
    ``centroids(word_id, centroid)``; ties to the smaller id.

    Centroids are a codebook of bounded size; they reach every task as one array, and nothing is shuffled.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("word_id", F.col("centroid").cast("array<double>").alias("centroid")))).alias("__centroids"))
    v = F.col(vector_col).cast("array<double>")
    distances = F.transform("__centroids", lambda c: F.struct(F.round(squared_distance(v, c["centroid"]), 12).alias("d"), c["word_id"].alias("word_id")))
    joined = vectors.crossJoin(F.broadcast(packed))
    if probes == 1:
        return joined.withColumn("word_id", F.array_min(distances)["word_id"]).drop("__centroids")
    near = F.slice(F.array_sort(distances), 1, probes)
    return joined.select(*vectors.columns, F.posexplode(near).alias("nth", "__near")).select(*vectors.columns, "nth", F.col("__near")["d"].alias("d2"), F.col("__near")["word_id"].alias("word_id"))


def train_lists(vectors: DataFrame, lists: int, seed: int = 42) -> DataFrame:
    """``(word_id, centroid)`` of the lists: k-means over unit vectors of a sample of at most TRAINING_ROWS rows."""
    rows = vectors.select(F.transform("vector", lambda x: x / F.col("norm")).alias("u"), F.xxhash64("chunk_id", F.lit(seed)).alias("h"), "chunk_id")
    sample = rows.orderBy("h", "chunk_id").limit(TRAINING_ROWS).select(array_to_vector("u").alias("features"))
    centers = KMeans(k=max(lists, 2), seed=seed, maxIter=10).fit(sample).clusterCenters() if lists > 1 else [[0.0]]
    if lists == 1:
        size = vectors.select(F.size("vector").alias("n")).first()
        centers = [[0.0] * (size["n"] if size else 1)]
    return vectors.sparkSession.createDataFrame([(i + 1, [float(x) for x in c]) for i, c in enumerate(centers)], "word_id long, centroid array<double>")


@dataclass
class IvfIndex:
    """Vectors in inverted lists, stored in one folder a list, so that a search reads the lists it probes.

    A list lies in slices of about LIST_ROWS rows: one that holds a third of all rows is written and searched in many tasks.
    """

    lists: DataFrame  # chunk_id, doc_id, vector, norm, slice, list_id
    slices: DataFrame  # list_id, slices, radius: the largest distance of a unit vector from the centroid; a row a list
    centroids: DataFrame
    probes: int

    @classmethod
    def create(cls, vectors: DataFrame, path: str, lists: int | None = None, probes: int | None = None, target: float = 0.95) -> IvfIndex:
        """Train and store. Without ``probes``, the smallest number that gives ``target`` of the ten true neighbours of
        a sample of TUNING_ROWS rows is measured and kept."""
        spark, new = vectors.sparkSession, Versions(vectors.sparkSession, path).begin()
        v = prepared(vectors)
        lists = lists or ivf_lists(v.count())
        centroids = new.put(train_lists(v, lists), "centroids")
        unit = v.withColumn("unit", F.transform("vector", lambda x: x / F.col("norm")))
        placed = nearest_centroid(unit, centroids, "unit").join(F.broadcast(centroids), "word_id")
        away = F.sqrt(squared_distance(F.col("unit"), F.col("centroid")))
        assigned = new.put(placed.select("chunk_id", "doc_id", "vector", "norm", F.col("word_id").alias("list_id"), away.alias("away")), "assigned")
        slices = new.put(assigned.groupBy("list_id").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("slices"), F.max("away").alias("radius")), "slices")
        sliced = assigned.drop("away").join(F.broadcast(slices.drop("radius")), "list_id").withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int"))
        sliced.drop("slices").repartition("list_id", "slice").write.partitionBy("list_id").parquet(f"{new.path}/{new.version}/lists")
        new.drop("assigned")
        stored = new.get("lists")
        probes = probes or (1 if lists == 1 else cls._measured(stored, centroids, lists, target))
        new.put(spark.createDataFrame([(probes,)], "probes int"), "settings")
        new.commit()
        return cls(stored, slices, centroids, probes)

    @staticmethod
    def _measured(stored: DataFrame, centroids: DataFrame, lists: int, target: float) -> int:
        sample = stored.orderBy(F.xxhash64("chunk_id", F.lit(7)), "chunk_id").limit(TUNING_ROWS).select(F.col("chunk_id").alias("query_id"), "vector", "norm")
        true = nearest_chunks(stored, sample, 11).where("chunk_id <> query_id").select("query_id", "chunk_id").join(stored.select("chunk_id", "list_id"), "chunk_id")
        near = nearest_centroid(sample.withColumn("unit", F.transform("vector", lambda x: x / F.col("norm"))).select("query_id", "unit"), centroids, "unit", lists)
        depth = true.join(near.select("query_id", F.col("word_id").alias("list_id"), "nth"), ["query_id", "list_id"]).groupBy("nth").count().toPandas().sort_values("nth")
        reached = depth["count"].cumsum() / max(depth["count"].sum(), 1)
        return int(depth["nth"][reached >= target].iloc[0]) + 1 if len(depth) else 1

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> IvfIndex:
        now = Versions(spark, path).current()
        return cls(now.get("lists"), now.get("slices"), now.get("centroids"), now.get("settings").first()["probes"])

    def search(self, queries: DataFrame, n: int = 10, pool: int = 16, max_id: int | None = None, docs: DataFrame | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """As ``knn_cosine``, but among the vectors of the ``probes`` lists nearest to each query.

        If ``exact``, the other lists are searched as well unless their radius shows that they hold no vector among the
        n * ``pool`` nearest; they only return vectors that reach those found before.
        """
        lists = self.slices.count()
        probes = max(1, min(probes or self.probes, lists))
        q = prepared(queries).select("query_id", "vector", "norm", F.transform("vector", lambda x: x / F.col("norm")).alias("qu"))
        near = nearest_centroid(q, self.centroids, "qu", max(2, lists if exact else probes)).withColumnRenamed("word_id", "list_id").drop("qu")
        found = self._probed(near.where(F.col("nth") < probes).select("query_id", "vector", "norm", "list_id"), n * pool, max_id)
        if exact and probes < lists:
            spark = queries.sparkSession
            found.drop("rank").write.parquet(path := f"{session_dir(spark)}/found")
            found = spark.read.parquet(path)
            # A query that has not yet enough vectors asks all lists.
            least = found.groupBy("query_id").agg(F.when(F.count("*") >= n * pool, F.min("score")).otherwise(-1.0).alias("least"))
            rest = near.where(F.col("nth") >= probes).join(least, "query_id", "left").fillna({"least": -1.0}).join(F.broadcast(self.slices), "list_id")
            gap = F.greatest(F.lit(0.0), F.sqrt("d2") - F.col("radius"))
            rest = rest.where(1 - gap * gap / 2 >= F.col("least") - 1e-8).select("query_id", "vector", "norm", "list_id", "least")
            found = vs.top_n(found.unionByName(self._probed(rest, n * pool, max_id).drop("rank")), n * pool)
        return by_document(found, n, docs)

    def _probed(self, asked: DataFrame, n: int, max_id: int | None) -> DataFrame:
        """The n nearest chunks of each of ``asked(query_id, vector, norm, list_id)`` in the lists that it asks."""
        # The lists asked for prune the folders that are read; there are no more of them than centroids.
        wanted = [(r["list_id"], -(-r["count"] // QUERY_BLOCK)) for r in asked.groupBy("list_id").count().collect()]
        blocks = F.broadcast(asked.sparkSession.createDataFrame(wanted, "list_id long, blocks int"))
        held = self.lists.where(F.col("list_id").isin([i for i, _ in wanted])) if wanted else self.lists.limit(0)
        held = held if max_id is None else held.where(F.col("chunk_id") <= max_id)
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        v = held.withColumn("list_id", F.col("list_id").cast("long")).join(blocks, "list_id").select("chunk_id", "doc_id", "vector", "norm", "list_id", "slice", every("blocks").alias("block"))
        asked = asked.join(blocks, "list_id").join(F.broadcast(self.slices.drop("radius")), "list_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("slice", every("slices"))
        return _met(v, asked, ["list_id", "slice", "block"], n)


def lsh_search(vectors: DataFrame, queries: DataFrame, n: int = 10, bucket: float = 1.0, tables: int = 8, radius: float = math.inf, seed: int = 42, pool: int = 16, max_id: int | None = None, docs: DataFrame | None = None) -> DataFrame:
    """As ``knn_cosine``, but by bucketed random projections of unit vectors: candidates share a bucket and lie within ``radius``, anywhere by default.

    Buckets are wide, so most pairs share one. They are told apart where blocks of queries and vectors meet; no row is made of a pair.
    """
    v = prepared(vectors if max_id is None else vectors.where(F.col("chunk_id") <= max_id))
    size = v.select(F.size("vector").alias("n")).first()
    planes = _directions(v.sparkSession, tables, size["n"] if size else 1, seed)

    def admit(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        hy, hx = np.floor(y @ planes.T / bucket), np.floor(x @ planes.T / bucket)
        shared = np.zeros((len(y), len(x)), dtype=bool)
        for t in range(tables):
            shared |= hy[:, t, None] == hx[None, :, t]
        return shared if math.isinf(radius) else shared & (2 - 2 * (y @ x.T) < radius * radius)

    return by_document(nearest_chunks(v, prepared(queries), n * pool, admit), n, docs)


def _directions(spark: SparkSession, tables: int, size: int, seed: int) -> np.ndarray:
    """Unit vectors of normal numbers in the order of Spark's own BucketedRandomProjectionLSH, so that buckets are the same."""
    r = spark._jvm.java.util.Random(seed)
    rows = np.array([[r.nextGaussian() for _ in range(size)] for _ in range(tables)])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours found, by query."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
