"""Exact top-k by integer inner product with a pivot-distance index.

Vectors get one coordinate more, which gives all of them the same length; then a larger inner product with a query is a
smaller Euclidean distance to it. Each vector is keyed by its nearest pivot and its distance to that pivot, and the
table is range-partitioned by (pivot, distance, id), so that a pivot with very many vectors lies in many parts.
The rows of a bounded sample, which also gives the pivots, give each query a first bound. Queries are dealt into blocks
by pivot and go to the parts that their bounds allow, and parts to the blocks that want them; where both meet, sorted annuli are walked outwards from the queries. By the
triangle inequality an annulus can be left out for a query when even the closest point it may hold is worse than the
query's k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm import _text as tx
from skeinwork.llm._store import Store

#: Rows of the sample that starts the bounds, pivots among them, and rows of an annulus.
SAMPLE, PIVOTS, ANNULUS = 2048, 128, 512
#: Bytes of vectors of a part of the index and of a block of queries, which meet in one task.
PART_BYTES, QUERY_BYTES = 32_000_000, 16_000_000
#: Squared lengths up to which scores are exact as doubles, and up to which they are long integers.
EXACT, MOST = 2.0**53, 2.0**62


def _matrix(column, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate([*flat, np.zeros(0)]).reshape(-1, dim)


class _Best:
    """The k best of each query so far: scores, descending, and ids, ascending in ties."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = ids != self.ids[query]
        score = score.astype(np.int64)
        query, score, ids = (np.concatenate([a, b[ok]]) for a, b in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(len(self.ids) + 1))
        rank = np.arange(len(query)) - first[query]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


class _Searcher:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, most: float, k: int, floor: np.ndarray):
        self.vectors, self.most, self.best = vectors, most, _Best(ids, k, floor)
        self.exact = np.float64 if most < EXACT else np.int64
        self.norms = (vectors**2).sum(1)
        lifted = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))
        self.to_pivots = np.sqrt(np.maximum(self.norms[:, None] + (pivots**2).sum(1)[None, :] + lifted[None, :] ** 2 - 2 * vectors @ pivots.T, 0))

    def highest(self, pivot: int, lo: float, hi: float) -> np.ndarray:
        """No vector of the annulus scores more with the query (the slack covers rounding)."""
        d = self.to_pivots[:, pivot]
        gap = np.maximum(np.maximum(lo - d, d - hi), 0)
        return (self.norms + self.most - gap**2) / 2 + 1e-6 * (1 + self.most)

    def walk(self, pivot: np.ndarray, dist: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Search sorted rows, annulus by annulus, the most promising first."""
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(pivot), ANNULUS), [len(pivot)]]))
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            top = self.highest(int(pivot[a]), dist[a], dist[b - 1])
            parts.append((float((top - self.best.floor)[np.isfinite(self.best.floor)].max(initial=-np.inf)), a, b, top))
        for _, a, b, top in sorted(parts, key=lambda p: (-p[0], p[1])):
            live = np.flatnonzero(top >= self.best.floor)
            if len(live):
                score = self.vectors[live].astype(self.exact) @ x[a:b].T.astype(self.exact)
                q, r = np.nonzero(score >= self.best.floor[live][:, None])
                if len(q):
                    self.best.add(live[q], score[q, r], ids[a:b][r])


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score``: the k best rows for each query but its own id's rows.

    Components count as floor(``scale`` * component). Rows without an id, with a null or empty vector or a null or non-finite
    component take no part, as queries and as candidates, nor do vectors whose squared length is over 2**62, whose scores
    may be no long integers. Vectors of different lengths have no inner product: each length is searched on its own.
    Ties go to the smaller id; rows that share an id are all candidates, and a query asked twice is answered for both rows at once.
    A query with fewer than k others returns all of them.
    """
    spark = vectors.sparkSession
    component = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))

    def whole(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND size(v) > 0").where(F.forall("v", component))
        # The range comes before FLOOR, which would make longs of doubles beyond them.
        near = F.forall("v", lambda c: F.abs(c.cast("double") * scale) <= MOST**0.5)
        x = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("double"))
        return df.where(near).select("id", x.alias("x")).withColumn("square", F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)).where(F.col("square") <= MOST)

    rows, asked = whole(vectors), whole(queries)
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max("square").alias("most")).collect()
    found = [_search(rows.where(F.size("x") == r["dim"]), asked.where(F.size("x") == r["dim"]), r["dim"], r["n"], r["most"], k) for r in sizes]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in found:
        out = out.union(part)
    return found[0] if len(found) == 1 else out


def _search(rows: DataFrame, asked: DataFrame, dim: int, n_rows: int, most: float, k: int) -> DataFrame:
    spark = rows.sparkSession
    store = Store(spark)
    start = rows.orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).select("id", "x").toPandas()
    sample_ids, sample = start["id"].to_numpy(), np.array(start["x"].tolist(), dtype=np.float64).reshape(-1, dim)
    pivots = np.unique(sample[:PIVOTS], axis=0)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))
        for b in batches:
            x = _matrix(b.column("x"), dim)
            own = np.sqrt(np.maximum(most - (x**2).sum(1), 0))
            d2 = 2 * most - 2 * (x @ pivots.T + own[:, None] * lift[None, :])
            near = d2.argmin(1) if len(x) else np.zeros(0, dtype=np.int64)
            dist = np.sqrt(np.maximum(d2[np.arange(len(x)), near], 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near.astype(np.int32)), pa.array(dist), b.column("x")], names=["id", "pivot", "dist", "x"])

    keyed = rows.select("id", "x").mapInArrow(key, "id long, pivot int, dist double, x array<double>")
    parts = max(1, -(-n_rows * dim * 8 // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // (4 * ANNULUS)))
    index = store.put(keyed.repartitionByRange(parts, "pivot", "dist", "id").withColumn("part", F.spark_partition_id()), "index")
    # The annulus of each pivot in each part: no more rows than pivots and parts together, nearly.
    ranges = index.groupBy("part", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("part", "pivot").toPandas()
    parts = int(ranges["part"].max()) + 1
    per_block = max(1, QUERY_BYTES // (dim * 8))

    def nearest(q: np.ndarray) -> np.ndarray:
        return ((pivots**2).sum(1)[None, :] + (most - (pivots**2).sum(1))[None, :] - 2 * q @ pivots.T).argmin(1) if len(q) else np.zeros(0, dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pivots), dtype=np.int64)
        for b in batches:
            n += np.bincount(nearest(_matrix(b.column("x"), dim)), minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(n)], names=["pivot", "n"])

    of_pivot = np.zeros(len(pivots), dtype=np.int64)
    for r in asked.select("x").mapInArrow(count, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect():
        of_pivot[r["pivot"]] = r["n"]
    before = np.cumsum(of_pivot) - of_pivot

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, q = b.column("id").to_numpy(), _matrix(b.column("x"), dim)
            if len(sample) >= k:
                score = q @ sample.T
                score[ids[:, None] == sample_ids[None, :]] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k]
                floor = floor - (0 if most < EXACT else 1e-9 * most)
            else:
                floor = np.full(len(ids), -np.inf)
            s = _Searcher(ids, q, pivots, most, k, floor)
            live = np.zeros((len(ids), parts), dtype=bool)
            for part, pivot, lo, hi in zip(ranges["part"], ranges["pivot"], ranges["lo"], ranges["hi"], strict=True):
                live[:, part] |= s.highest(pivot, lo, hi) >= floor
            # Blocks are stretches of the queries by pivot, in hash order within one: near queries want the same parts.
            near = nearest(q)
            place = before[near] + (tx.mix(ids.astype(np.int64).view(np.uint64)) % np.maximum(of_pivot[near], 1).astype(np.uint64)).astype(np.int64)
            wanted = [np.flatnonzero(x).tolist() for x in live]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(floor), pa.array(wanted, pa.list_(pa.int32())), pa.array((place // per_block).astype(np.int32))], names=["query", "q", "floor", "parts", "block"])

    routed = store.put(asked.select("id", "x").mapInArrow(route, "query long, q array<double>, floor double, parts array<int>, block int"), "queries")
    # Rows go to the blocks that want their part, and to no others.
    blocks = routed.select("block", F.explode("parts").alias("part")).distinct().groupBy("part").agg(F.collect_list("block").alias("blocks"))
    left = index.join(blocks, "part").select("id", "pivot", "dist", "x", "part", F.explode("blocks").alias("block"))
    right = routed.select("query", "q", "floor", F.explode("parts").alias("to"), F.col("block").alias("of"))

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pivot", "ascending"), ("dist", "ascending"), ("id", "ascending")])
        s = _Searcher(queries["query"].to_numpy(), _matrix(queries["q"], dim), pivots, most, k, queries["floor"].to_numpy())
        if rows.num_rows and queries.num_rows:
            s.walk(rows["pivot"].to_numpy(), rows["dist"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["x"], dim))
        return pa.table({"query_id": pa.array(s.best.ids[s.best.query], pa.int64()), "vec_id": pa.array(s.best.id, pa.int64()), "score": pa.array(s.best.score, pa.int64())})

    best = left.groupBy("block", "part").cogroup(right.groupBy("of", "to")).applyInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
