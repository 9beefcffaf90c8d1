import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import _text as tx
from skeinwork.llm._store import Store
from skeinwork.llm.components import connected_components
from skeinwork.llm.line_dedup import line_dedup
from skeinwork.llm.near_dedup import links_between, near_dedup
from skeinwork.llm.sketch import may_be_similar, registers, shingle_sets
from skeinwork.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, n_lines string, h1 string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "É", "x y", "ß"]
    lines = [" ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(25)]
    texts = ["\n".join(r.choices(lines, k=r.randint(0, 6))) for _ in range(n)]
    texts += [None, "", " \t\n\x0b ", "w1 " * 100, "w1 " * 100, "w1", "W1", lines[0].upper()]
    return list(enumerate(texts))


# Lines


def plain_lines(docs):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_plain_python(spark, seed):
    docs = corpus(seed)
    got = line_dedup(frame(spark, docs).drop("n_lines"))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got.collect()} == plain_lines(docs)


def test_hot_lines_are_salted(spark, monkeypatch):
    from skeinwork.llm import line_dedup as ld

    monkeypatch.setattr(ld, "HOT_ROWS", 3)
    monkeypatch.setattr(ld, "HOT_KEYS", 2)
    docs = [*corpus(7), *[(100 + i, f"a line that nearly all hold\nown line number {i}") for i in range(200)]]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup(frame(spark, docs).drop("n_lines")).collect()} == plain_lines(docs)


def test_lines_are_kept_without_a_table_in_between(spark, monkeypatch):
    """Each file that executors write costs a process on file systems without native calls; the default rule needs none."""
    from skeinwork.llm import line_dedup as ld

    def put(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(ld.Store, "put", put)
    docs = [*corpus(8), *[(100 + i, f"a line that nearly all hold\nown line number {i}\nshort") for i in range(300)]]
    for min_docs in (1, 2):
        got = line_dedup(frame(spark, docs).drop("n_lines"), min_docs=min_docs)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got.collect()} == plain_lines(docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize(("min_docs", "keep_first"), [(3, True), (2, False), (3, False), (1, False)])
def test_other_rules_with_salted_lines(spark, monkeypatch, min_docs, keep_first):
    from skeinwork.llm import line_dedup as ld

    monkeypatch.setattr(ld, "HOT_ROWS", 3)
    monkeypatch.setattr(ld, "HOT_KEYS", 2)
    docs = [(i, "\n".join([f"held by so many documents {n}" for n in range(1, 9) if i % n == 0] + [f"own line number {i}", "short"])) for i in range(40)]
    holders = {}
    for i, t in docs:
        for line in t.split("\n"):
            holders.setdefault(line, []).append(i)
    want = {i: "\n".join(x for x in t.split("\n") if x == "short" or len(holders[x]) < min_docs or keep_first and holders[x][0] == i) for i, t in docs}
    assert {r.doc_id: r.text for r in line_dedup(frame(spark, docs), min_docs=min_docs, keep_first=keep_first).collect()} == want


def test_key_sets():
    from skeinwork.llm.line_dedup import key_sets

    column = pa.array([[(9, 9)], None, [], [(1, -1), (2, 3)]], pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64())])))
    key = lambda *x: b"".join(n.to_bytes(8, "little", signed=True) for n in x)
    assert key_sets(column.slice(1)) == [set(), set(), {key(1, -1), key(2, 3)}] and key_sets(column.slice(0, 0)) == []


def test_lines_edge_cases(spark):
    docs = [(1, "same long line\nSAME LONG LINE "), (2, "\tsame long line\nother"), (None, "same long line"), (3, None)]
    out = {r.doc_id: r.text for r in line_dedup(frame(spark, docs)).collect()}
    assert out == {1: "same long line\nSAME LONG LINE ", 2: "other", None: "same long line", 3: None}
    assert line_dedup(frame(spark, docs)).columns == ["doc_id", "text", "id", "n_lines", "h1", "n_dropped"]
    assert line_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0
    three = [(1, "same long line"), (2, "same long line"), (3, "same long line"), (4, "twice only line"), (5, "twice only line")]
    assert {r.doc_id for r in line_dedup(frame(spark, three), min_docs=3).collect() if r.text} == {1, 4, 5}
    assert {r.doc_id for r in line_dedup(frame(spark, three), keep_first=False).collect() if r.text} == set()


# Windows


def plain_windows(docs, width):
    words = {i: WORD.findall(t or "") for i, t in docs}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for p in range(len(words[i]) - width + 1):
            w = tuple(words[i][p : p + width])
            if w in seen:
                gone[i].update(range(p, p + width))
            seen.add(w)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


@pytest.mark.parametrize(("seed", "width"), [(0, 20), (1, 5), (2, 1), (3, 14)])
def test_windows_against_plain_python(spark, seed, width):
    docs = corpus(seed)
    got = substring_dedup(frame(spark, docs), width=width)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == plain_windows(docs, width)


def test_window_intervals_and_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    out = {r.doc_id: r for r in substring_dedup(frame(spark, [(5, f"a {text} b"), (2, f"x y {text}"), (None, text), (7, "p " * 50)])).collect()}
    assert [tuple(x) for x in out[5].intervals] == [(1, 31)] and out[5].text == "a b" and out[2].n_removed == 0
    assert out[None].n_removed == 0 and out[7].text == "" or out[7].n_removed == 49
    assert substring_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_rolling_hashes_and_words():
    values = np.arange(1, 60, dtype=np.uint64)
    two = np.concatenate([values, values])
    r = tx.rolling(two, 7)
    assert (r[:53] == r[59:112]).all() and len(set(r[:53])) == 53 and not len(tx.rolling(values, 80))
    w = tx.Words([b" a  bc\n", b"", "é a".encode()], lower=True)
    assert w.counts().tolist() == [2, 0, 2] and w.hashes[0] == w.hashes[3]
    assert tx.Words([b"ABC"], True).hashes == tx.Words([b"abc"], False).hashes


# Near-duplicates


def plain_near(docs, size, percent=80):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_corpus(seed):
    r = random.Random(seed)
    docs = [v for _, v in corpus(seed, 20)]
    for n in (40, 90, 200):
        base = [f"v{r.randint(0, 900)}" for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randint(0, n // 14)):
                copy[r.randrange(n)] = f"u{r.randint(0, 99)}"
            docs.append(" ".join(copy))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "size"), [(0, 2), (1, 5)])
def test_near_duplicates_against_all_pairs(spark, seed, size):
    docs = near_corpus(seed)
    got = near_dedup(frame(spark, docs), shingle_words=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_near(docs, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_torn_buckets_in_small_blocks(spark, monkeypatch):
    """Many documents of one template, with fewer bands of one register each, so that buckets hold unlinked groups."""
    from skeinwork.llm import near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 5)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 300)
    r = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(60)] = f"u{r.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    got = near_dedup(frame(spark, docs), shingle_words=2, band_rows=1, bands=30).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_near(docs, 2)


def test_near_duplicates_of_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, long), (2, long + " end"), (3, "a b c d"), (3, "a b c d"), (3, None), (4, "a b c d")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(frame(spark, docs), shingle_words=2).collect())
    assert got == [(1, 59_999, 1), (2, 60_000, 1), (3, 0, 3), (3, 3, 3), (3, 3, 3), (4, 3, 3)]


def test_near_duplicates_of_nothing(spark):
    assert near_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0
    got = near_dedup(frame(spark, [(3, None), (4, ""), (9, "One two"), (8, "one TWO"), (None, "one two")])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {3: (0, 3, True), 4: (0, 4, True), 8: (1, 8, True), 9: (1, 8, False)}


def test_links_between_joins_components_like_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**40, 100).astype(np.uint64)
    sets = []
    for k in range(30):
        s = base.copy()
        s[rng.choice(100, k // 2, replace=False)] = rng.integers(0, 2**40, k // 2).astype(np.uint64)
        sets.append(np.unique(s))
    component = np.array([0] * 10 + list(range(10, 30)))
    found = links_between(np.arange(30), component, sets, 80)

    def joined(pairs):
        label = component.copy()
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return {frozenset(np.flatnonzero(label == x)) for x in label}

    every = [(a, b) for a, b in combinations(range(30), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert joined(found) == joined(every) and len(found) < 30


def test_registers_merge_and_estimate():
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(100, 1000))
    both = a + " " + " ".join(f"w{i}" for i in range(900, 1000))
    value, begin = shingle_sets(tx.Words([a.encode(), b.encode(), both.encode()], True), 1)
    r = registers(value, begin, 512)
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    equal, above, below = [(r[0] == r[1]).sum()], [(r[0] > r[1]).sum()], [(r[0] < r[1]).sum()]
    test = lambda s: may_be_similar(np.array(equal), np.array(above), np.array(below), np.array([900.0]), np.array([900.0]), s)[0]
    assert test(0.8) and not test(0.97)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links, Store(spark), "p").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_kept_text_digest(spark):
    from pyspark.sql import functions as F

    from skeinwork.llm.line_dedup import sha256_text

    assert spark.range(1).select(sha256_text(F.lit("é")).alias("x")).first().x == hashlib.sha256("é".encode()).hexdigest()
