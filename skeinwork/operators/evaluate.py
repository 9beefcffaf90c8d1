"""Evaluation: query samples, precision at k, load selection, timing, index size and input read."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import mean

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOADS = (1_000, 10_000, 20_000)


def query_sample(docs: DataFrame, chunks: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """n documents with a title, a category and at least one chunk, in an order fixed by a hash of the id and the seed."""
    usable = docs.where("title <> '' AND category <> ''").join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")
    return usable.orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)))), "doc_id").limit(n).select("doc_id", "title", "category")


def precision_at_k(results: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``results(query_id, doc_id, rank)``: share of the query's category in its first k results without the query's own
    document; 0 without results. ``queries(query_id, doc_id, category)``."""
    own = queries.select("query_id", F.col("doc_id").alias("own_doc"), F.col("category").alias("own_category"))
    others = results.join(own, "query_id").where("doc_id <> own_doc")
    w = Window.partitionBy("query_id").orderBy("rank")
    first = others.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    same = first.join(docs.select("doc_id", "category"), "doc_id", "left").groupBy("query_id").agg(F.avg(F.coalesce((F.col("category") == F.col("own_category")).cast("double"), F.lit(0.0))).alias("p"))
    return own.join(same, "query_id", "left").select("query_id", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("precision"))


def loads_for(total: int, loads: tuple[int, ...] = LOADS) -> list[int]:
    """The loads that the collection reaches, or the collection itself."""
    return [x for x in loads if x <= total] or [total]


def measure(run: Callable[[int], DataFrame], queries: int, warm: int = 3) -> dict[str, float]:
    """Milliseconds of the very first run, mean of all warm runs, and queries a second of one client."""
    cold, times = None, []
    for q in range(queries):
        for repeat in range(warm + 1):
            began = time.perf_counter()
            run(q).write.format("noop").mode("overwrite").save()
            took = 1000 * (time.perf_counter() - began)
            if repeat:
                times.append(took)
            elif cold is None:
                cold = took
    warm_ms = mean(times) if times else 0.0
    return {"cold_ms": round(cold or 0.0, 2), "warm_ms": round(warm_ms, 2), "qps": round(1000 / warm_ms, 1) if warm_ms else 0.0}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the data files under a path, 0 if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def input_read(df: DataFrame) -> dict[str, int]:
    """Run ``df`` to its end; files, bytes and rows that its scans read, by their own counters, each scan once.

    A scan that several branches share is one scan. Bytes are those of the files opened, so a pruned folder doesn't count.
    """
    out = {"files": 0, "bytes": 0, "rows": 0}
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect() if df.columns else None
    names = {"numFiles": "files", "filesSize": "bytes", "numOutputRows": "rows"}
    seen, todo = set(), [execution.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind.startswith("Reused"):
            continue
        elif kind.startswith("FileSourceScan"):
            if node.id() not in seen:
                seen.add(node.id())
                metrics = node.metrics()
                for metric, name in names.items():
                    if metrics.contains(metric):
                        out[name] += metrics.apply(metric).value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def summary(rows: list[dict]) -> str:
    """A plain table of measured figures."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *[[str(r.get(n, "")) for n in names] for r in rows]]
    width = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(n) for x, n in zip(c, width, strict=True)).rstrip() for c in cells)
