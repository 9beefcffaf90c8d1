import math

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import ann, evaluate, fts
from skeinwork.operators import image as im
from skeinwork.operators import vectorspace as vs
from skeinwork.operators.search import fuse
from skeinwork.plans.text_index import TextIndex


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(d, f"u{d}", f"t{d}", "x", None) for d in (1, 2, 3)], "doc_id long, url string, title string, category string, image_url string")
    chunks = spark.createDataFrame([(1, 1, "apple apple banana common"), (2, 2, "banana cherry common"), (3, 3, "cherry cherry cherry common"), (4, 3, "apple common")], "chunk_id long, doc_id long, content string")
    return TextIndex.from_chunks(docs, chunks, 10, stem=False)


def ask(spark, index, text, **options):
    return index.search(spark.createDataFrame([(1, text)], "query_id long, text string"), **options).orderBy("rank").collect()


def test_weights_by_hand(index):
    words = {r.term: r.word_id for r in index.codebook.collect()}
    assert list(words) and words["cherry"] == 1 and words["common"] == 2
    w = {(r.word_id, r.chunk_id): r.w for r in index.postings.collect()}
    assert w[words["apple"], 1] == pytest.approx((1 + math.log10(2)) * math.log10(4 / 2))
    assert w[words["common"], 2] == 0.0


def test_search(spark, index):
    got = ask(spark, index, "apple")
    assert [r.doc_id for r in got] == [3, 1] and got[0].score == pytest.approx(1.0)
    assert all(r.score <= 1 + 1e-9 for r in ask(spark, index, "apple cherry banana"))
    assert ask(spark, index, "common") == [] and ask(spark, index, "unknown") == [] and ask(spark, index, "  ") == []
    # A chunk that only shares a word of idf 0 is a candidate with score 0.
    assert {r.doc_id: r.score for r in ask(spark, index, "banana common")}[3] == 0.0
    assert [r.chunk_id for r in ask(spark, index, "apple", group_by_doc=False)] == [4, 1]
    assert [r.chunk_id for r in ask(spark, index, "apple", max_chunks=2)] == [1]
    assert [r.doc_id for r in ask(spark, index, "apple apple banana common")][0] == 1


def test_index_round_trip(spark, index, tmp_path):
    stored = index.write(f"file://{tmp_path}/i")
    weights = lambda i: {(r.word_id, r.chunk_id): r.w for r in i.postings.collect()}
    assert weights(stored) == pytest.approx(weights(index))
    assert [r.doc_id for r in ask(spark, stored, "apple")] == [3, 1]
    assert evaluate.stored_bytes(spark, f"file://{tmp_path}/i") > 0 and evaluate.stored_bytes(spark, f"file://{tmp_path}/none") == 0


def test_fusion(spark, index):
    text = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25)], "query_id long, doc_id long, score double")
    image = spark.createDataFrame([(1, 2, 0.2), (1, 9, 0.1)], "query_id long, doc_id long, score double")
    score = lambda a, t=text, i=image: {r.doc_id: r.score for r in fuse(t, i, index.docs, a).collect()}
    assert score(0.5) == pytest.approx({1: 0.5, 2: 0.75})  # 9 has no metadata
    assert score(1.0)[1] == pytest.approx(1.0) and score(0.0)[2] == pytest.approx(1.0)
    assert score(0.5, i=None) == pytest.approx({1: 0.5, 2: 0.25})


def test_histograms_of_the_known_example(spark):
    labels, patches = [0, 0, 1, 2], [1, 1, 2, 2]
    q = spark.createDataFrame([(p, w + 1) for p, w in zip(patches, labels, strict=True)], "chunk_id long, word_id long")
    dense = {r.chunk_id: r.histogram for r in im.dense_histograms(im.histograms(q), 4).collect()}
    assert dense == {1: [2, 0, 0, 0], 2: [0, 1, 1, 0]}
    assert len(im.dense_histograms(im.histograms(q), 8).first().histogram) == 8


def test_centroids_are_their_own_nearest_and_ties_take_the_smaller(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "word_id long, centroid array<double>")
    got = im.quantize(c.select(F.col("word_id").alias("i"), F.col("centroid").alias("descriptor")), c)
    assert {r.i: r.word_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_phrases_and_exclusions(spark):
    chunks = spark.createDataFrame([(1, "red fox jumps"), (2, "fox red jumps"), (3, "red the fox")], "chunk_id long, content string")
    v = fts.tsvector(chunks)
    both = spark.createDataFrame([(1, "red"), (1, "fox")], "query_id long, lexeme string")
    assert {r.chunk_id for r in fts.match_all(v, both).collect()} == {1, 2, 3}
    assert {r.chunk_id for r in fts.match_signature(fts.signatures(v), v, both).collect()} == {1, 2, 3}
    found = lambda text: {r.chunk_id for r in fts.match_websearch(v, fts.websearch(spark.createDataFrame([(1, text)], "query_id long, text string"))).collect()}
    assert found("red fox") == {1, 2, 3} and found('"red fox"') == {1} and found("red fox -jumps") == {3} and found('"red the fox"') == {3}
    assert found('red -"fox red"') == {1, 3} and found('nothing OR "fox red"') == {2} and found("red nothing or the") == set() and found("-red") == set() and found("") == set()
    ranks = {r.chunk_id: r.score for r in fts.proximity_rank(v, both, fts.match_all(v, both)).collect()}
    assert ranks[1] > ranks[3] > 0


def test_approximate_search_finds_neighbours(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(200, 8))
    v = spark.createDataFrame([(i + 1, i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, doc_id long, vector array<double>")
    q = v.where("chunk_id <= 10").withColumnRenamed("chunk_id", "query_id").select("query_id", "vector")
    exact = ann.knn_cosine(v, q)
    assert exact.where("rank = 1 AND query_id = chunk_id").count() == 10
    share = lambda found: ann.recall(found, exact).agg(F.avg("recall")).first()[0]
    stored = ann.IvfIndex.create(v, f"file://{tmp_path}/ivf", lists=8)
    assert share(stored.search(q, probes=8)) == 1.0 and share(stored.search(q, probes=1)) < 1.0
    again = ann.IvfIndex.read(spark, f"file://{tmp_path}/ivf")
    assert again.probes == stored.probes <= 8 and share(again.search(q)) >= 0.9
    one = again.search(q.limit(1), probes=1)
    assert evaluate.input_read(one)["bytes"] < evaluate.input_read(again.search(q, probes=8))["bytes"]
    assert share(ann.lsh_search(v, q)) >= 0.9
    assert ann.ivf_lists(500) == 1 and ann.ivf_lists(20_000) == 20 and ann.ivf_lists(4_000_000) == 2000


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_searches_find_nine_tenths_on_the_tables(spark, sf):
    """Against plain cosine; the registered query ids, and lists enough that most are not probed."""
    import numpy as np

    from skeinwork.plans import adapters
    from skeinwork.queries import dense_queries

    path = f"/root/testdata/sf{sf}"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect())
    x = np.array([e for _, e in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = [k for k, (i, _) in enumerate(rows) if i % 20 == 0]
    v, q = adapters.vectors(spark, path).withColumn("doc_id", F.col("chunk_id")), dense_queries(spark, path)
    index = ann.IvfIndex.create(v, adapters.session_dir(spark), lists=20)
    for result in (ann.lsh_search(v, q), index.search(q), ann.knn_cosine(v, q)):
        found = {}
        for r in result.collect():
            found.setdefault(r.query_id, set()).add(r.chunk_id)
        shares = [len(found[rows[k][0] + 1] & {rows[j][0] + 1 for j in np.argsort(-(x @ x[k]), kind="stable")[:10]}) / 10 for k in asked]
        assert np.mean(shares) >= 0.9 and all(len(f) == 10 for f in found.values())
    assert np.mean(shares) == 1.0


def test_a_list_of_most_rows_lies_in_slices(spark, tmp_path, monkeypatch):
    """All lists probed give what the exact search gives, however lists and queries are split; ties go to the smaller id."""
    import numpy as np

    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    r = np.random.default_rng(8)
    copies = [[0.5, 0.25, -1.0, 0.125]] * 120
    data = [(i, i // 2, [float(x) for x in e]) for i, e in enumerate([*copies, *r.normal(size=(80, 4))])]
    v = spark.createDataFrame(data, "chunk_id long, doc_id long, vector array<double>")
    q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    index = ann.IvfIndex.create(v, f"file://{tmp_path}/ivf", lists=4, probes=4)
    sizes = index.lists.groupBy("list_id", "slice").count().collect()
    assert sum(x["count"] for x in sizes) == 200 and max(x["count"] for x in sizes) < 40 and index.slices.agg(F.max("slices")).first()[0] >= 8
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))
    assert rows(ann.IvfIndex.read(spark, f"file://{tmp_path}/ivf").search(q)) == rows(ann.knn_cosine(v, q))
    assert index.search(q.limit(0)).count() == 0 and rows(index.search(q, max_id=130)) == rows(ann.knn_cosine(v, q, max_id=130))


def test_exact_search_in_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 50)
    x = np.random.default_rng(3).integers(-2, 3, size=(150, 3)).astype(float)
    v = spark.createDataFrame([(i + 1, i // 2, r.tolist()) for i, r in enumerate(x)] + [(900, 1, None)], "chunk_id long, doc_id long, vector array<double>")
    q = v.where("chunk_id <= 20").withColumnRenamed("chunk_id", "query_id").select("query_id", "vector")
    n = np.linalg.norm(x, axis=1)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in ann.nearest_chunks(ann.prepared(v), ann.prepared(q), 5).collect()}
    for k in range(20):
        if n[k]:
            s = {j + 1: round(float(x[k] @ x[j] / n[k] / n[j]), 9) for j in range(150) if n[j]}
            want = sorted(s.items(), key=lambda t: (-t[1], t[0]))[:5]
            assert [got[k + 1, r + 1] for r in range(5)] == [(j, pytest.approx(c, abs=2e-9)) for j, c in want]
        else:
            assert (k + 1, 1) not in got
    assert ann.knn_cosine(v.limit(0), q).count() == 0 and ann.knn_cosine(v, q.limit(0)).count() == 0


def test_image_index_round_trip(spark, tmp_path):
    from skeinwork.plans.image_index import ImageIndex

    docs = spark.createDataFrame([(d, f"u{d}", "t", "c", None) for d in (1, 2)], "doc_id long, url string, title string, category string, image_url string")
    found = spark.createDataFrame([(1, 1, 0, [0.0, 0.1]), (1, 1, 0, [0.9, 1.0]), (2, 2, 0, [1.0, 1.0]), (3, 2, 1, [0.0, 5.0])], "chunk_id long, doc_id long, patch_index int, descriptor array<float>")
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 5.0])], "word_id long, centroid array<double>")
    built = ImageIndex.create(docs, found, f"file://{tmp_path}/i", centroids=c)
    read = ImageIndex.read(spark, f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(1, [0.0, 5.1])], "query_id long, descriptor array<float>")
    for i in (built, read):
        assert [(r.doc_id, r.chunk_id) for r in i.search(asked).collect()] == [(2, 3)]
    built.write(f"file://{tmp_path}/i")
    assert ImageIndex.read(spark, f"file://{tmp_path}/i").bag.count() == 4 and len([p for p in (tmp_path / "i").iterdir() if p.name.startswith("version")]) == 1
    k = im.visual_codebook(found, 2)
    assert k.count() == 2 and {r.word_id for r in im.quantize(found, k).collect()} <= {1, 2}
    with pytest.raises(ValueError):
        im.visual_codebook(found, 5)


def test_command_line(spark, tmp_path, capsys):
    from skeinwork.__main__ import main

    spark.createDataFrame([(1, "u1", "t1", "running foxes " * 20, "x", None), (2, "u2", "t2", "slow turtles " * 20, "x", None)], "doc_id long, url string, title string, body string, category string, image_url string").write.parquet(f"file://{tmp_path}/docs")
    main(["build-text", f"file://{tmp_path}/docs", f"file://{tmp_path}/index"])
    main(["search", f"file://{tmp_path}/index", "the fox runs"])
    out = capsys.readouterr().out
    assert "u1" in out and "u2" not in out
    main(["search", f"file://{tmp_path}/index", '"slow turtles" -fox', "--fts"])
    assert "u2" in capsys.readouterr().out


def test_precision_drops_the_query_itself(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, category string")
    results = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query_id long, doc_id long, rank int")
    queries = spark.createDataFrame([(7, 1, "a"), (8, 2, "a")], "query_id long, doc_id long, category string")
    assert {r.query_id: r.precision for r in evaluate.precision_at_k(results, queries, docs).collect()} == {7: 0.5, 8: 0.0}
    assert evaluate.loads_for(15_000) == [1_000, 10_000] and evaluate.loads_for(50) == [50]
    assert evaluate.measure(lambda q: docs, 2)["qps"] > 0
    assert "qps" in evaluate.summary([{"method": "own", "qps": 1.0}])


def test_codebook_order(spark):
    cf = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "term string, cf long")
    assert [(r.word_id, r.term) for r in vs.codebook(cf, 3).orderBy("word_id").collect()] == [(1, "c"), (2, "a"), (3, "b")]


def test_buckets_are_told_apart_without_rows_of_pairs(spark):
    """The neighbours of Spark's own bucketed projections, and a shuffle that doesn't grow with the pairs."""
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(3).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i + 1, i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, doc_id long, vector array<double>")
    q = v.where("chunk_id <= 20").withColumnRenamed("chunk_id", "query_id").select("query_id", "vector")
    for bucket, radius in ((0.25, float("inf")), (0.5, 0.9)):
        features = v.withColumn("features", array_to_vector("vector"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=2, seed=42).fit(features)
        pairs = model.approxSimilarityJoin(features, q.withColumn("features", array_to_vector("vector")), radius if radius < 9 else 1e9, distCol="d")
        want = {}
        for r in pairs.select("datasetB.query_id", "datasetA.chunk_id", "d").collect():
            want.setdefault(r.query_id, []).append((round(1 - r.d * r.d / 2, 9), -r.chunk_id))
        want = {(k, -c) for k, found in want.items() for _, c in sorted(found, reverse=True)[:10]}
        got = ann.lsh_search(v, q, bucket=bucket, tables=2, radius=radius)
        assert {(r.query_id, r.chunk_id) for r in got.collect()} == want
        assert "hashes" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lists_that_are_not_probed_are_searched_if_they_may_hold_neighbours(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(5)
    # Clusters far from each other, whose lists are left out, and vectors all over, whose lists are not.
    x = np.concatenate([r.normal(size=(150, 8)), *[c + 0.01 * r.normal(size=(60, 8)) for c in 4 * r.normal(size=(5, 8))]])
    v = spark.createDataFrame([(i + 1, i // 2, e.tolist()) for i, e in enumerate(x)], "chunk_id long, doc_id long, vector array<double>")
    q = v.where("(chunk_id - 1) % 9 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    found = lambda df: {(r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect()}
    index = ann.IvfIndex.create(v, f"file://{tmp_path}/ivf", lists=12, probes=1)
    for n, pool in ((10, 16), (5, 2)):
        want = found(ann.knn_cosine(v, q, n, pool))
        assert found(index.search(q, n, pool, exact=True)) == want != found(index.search(q, n, pool))
    assert found(index.search(q, max_id=200, exact=True)) == found(ann.knn_cosine(v, q, max_id=200))
