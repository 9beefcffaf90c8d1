import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skeinwork.llm import packing, topk
from skeinwork.llm.packing import Encoder, Index, _statistics, order, pack, pack_documents
from skeinwork.llm.topk import top_k

PATH = public_tokenizers.path("word_bpe_49k.json")


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_by_word_ids_equal_the_whole_text(tokenizer):
    texts = ["It's  DON'T stop\tnow\n\n", "", " ", "éÉ ß İstanbul ΣΑΣ é", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>", "日本語 тест 👩‍👩‍👧 1234", "x" * 5000, "a" * 30 + "́ ́"]
    got = Encoder(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_fast_path_ids_equal_the_tokenizers_own(tokenizer):
    r = random.Random(1)
    low = [chr(c) for c in range(0x300)]
    odd = [chr(c) for c in (0x301, 0x2019, 0x4E2D, 0x3A3, 0x3C3, 0x130, 0x2028, 0xFB01, 0x1E9E, 0x212B, 0x660, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x200D, 0x2003)]
    texts = ["".join(r.choices(r.choice([low, low + odd * 20, [*"ab'stredvlm0 <|>,.", "'s", "<|endoftext|>"]]), k=r.randint(0, 14))) for _ in range(3000)]
    got = Encoder(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_bytes_tell_the_pieces_of_plain_texts(tokenizer, monkeypatch):
    r = random.Random(7)
    parts = ["'", "'s", "'re", "'LL", "'d", "''", "ab", "É", "ßÀÞ", "×", "÷", "12", " ", "\t\n", "\x1c", ".,", "-'t", "x'm y", "l", "v", "e", "Ñandú", "w" * 70]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    own = Encoder(PATH)
    for slots, known in ((packing.SLOTS, 10**6), (16, 10**6), (64, 40)):  # with many pieces to a slot, and a full table
        monkeypatch.setattr(packing, "SLOTS", slots)
        monkeypatch.setattr(packing, "KNOWN", known)
        own._forget()
        got = [x for at in range(0, len(texts), 100) for x in own.encode([t.encode() for t in texts[at : at + 100]])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_long_texts_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing.tx, "CHUNK_BYTES", 50)
    r = random.Random(3)
    texts = [" ".join(r.choices(["ab", "'s", "É,", "\t\t", "w" * 60, "1"], k=r.randint(0, 200))) for _ in range(60)] + ["x" * 500]
    got = Encoder(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_similar_documents_get_the_same_key():
    rng = np.random.default_rng(0)
    idf = rng.random(5000) * 8
    first, same = packing.priorities(idf), 0
    for _ in range(300):
        a = rng.choice(5000, 200, replace=False)
        b = np.concatenate([a[:160], rng.choice(5000, 40)])
        same += packing.lexical_key(a, first)[0] == packing.lexical_key(b, first)[0]
    assert 0.5 < same / 300 < 0.85  # a weighted Jaccard similarity of some 0.67


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Hello  wörld\n\n it's 'S"
    assert np.frombuffer(Encoder(path).encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_statistics_cover_all_documents(spark):
    docs = [[5, 5, 1], [5, 9, 70000, 1], [1]]
    rows = [(any(x > 65535 for x in d), np.array(d, dtype="<u4" if max(d) > 65535 else "<u2").tobytes()) for d in docs]
    idf, mean, size = _statistics(spark.createDataFrame(rows, "wide boolean, ids binary").repartition(3))
    want = {5: 2, 1: 3, 9: 1, 70000: 1, 4: 0}
    assert {t: idf[t] for t in want} == {t: pytest.approx(np.log1p((3 - n + 0.5) / (n + 0.5))) for t, n in want.items()}
    assert mean == pytest.approx(8 / 3) and size == 2 * 3 + 4 * 4 + 2


@pytest.mark.parametrize("seed", range(4))
def test_pack_places_every_token_once(seed):
    r = np.random.default_rng(seed)
    docs = [r.integers(0, 50, r.integers(1, 400)).astype(np.uint16) for _ in range(60)]
    out = pack(docs, 128, np.ones(50), 200.0)
    total = sum(map(len, docs))
    places = {d: [] for d in range(60)}
    filled = {}
    for d, start, n, s, o in out:
        assert n > 0 and filled.get(s, 0) == o
        filled[s] = o + n
        places[d].append((start, n))
    for d, p in places.items():
        assert [a for a, _ in p] == np.cumsum([0, *[n for _, n in p]])[:-1].tolist() and sum(n for _, n in p) == len(docs[d])
    assert sum(filled.values()) == total and all(n == 128 or n & (n - 1) == 0 for n in filled.values())


def test_neighbours_against_plain_bm25():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 30, 12).astype(np.uint16) for _ in range(40)]
    n, mean = 40, np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(30)}
    index, used = Index(docs, np.log1p([(n - df[t] + 0.5) / (df[t] + 0.5) for t in df]), mean), np.zeros(40, dtype=bool)
    used[[0, 5]] = True
    got = index.neighbours(0, used, most=40)
    score = np.zeros(40)
    for t in set(docs[0].tolist()):
        if 1 < df[t] <= 13:
            for k, d in enumerate(docs):
                if tf := (d == t).sum():
                    score[k] += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    score[used] = 0
    want = [k for k in np.lexsort((np.arange(40), -np.round(score, 9))) if score[k] > 0]
    assert sorted(got) == sorted(want) and score[got].tolist() == pytest.approx(score[want].tolist())


def test_rare_terms_of_its_own_do_not_hide_a_seeds_neighbour():
    docs = [np.arange(1000 + 100 * d, 1060 + 100 * d) for d in range(8)]
    docs[0], docs[5] = np.append(docs[0], np.arange(20)), np.append(docs[5], np.arange(20))
    idf = np.full(2000, 9.0)
    idf[:20] = 5.0
    assert list(order(docs, 10_000, idf, 65.0))[:2] == [0, 5]


def test_copies_that_make_up_half_a_shard_are_neighbours():
    docs = [np.arange(30) if d % 2 == 0 else np.arange(100 * d, 100 * d + 30) for d in range(40)]
    assert list(order(docs, 10_000, np.ones(4000), 30.0))[:20] == list(range(0, 40, 2))


def test_all_terms_against_plain_bm25():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 60, r.integers(5, 120)) for _ in range(50)]
    idf, mean = r.random(60) + 0.1, np.mean([len(d) for d in docs])
    index, used = Index(docs, idf, mean), np.zeros(50, dtype=bool)
    for seed in range(50):
        score = np.array([sum(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[seed].tolist()) if (tf := (d == t).sum())) for d in docs])
        score[seed] = 0
        used[:] = np.arange(50) == seed
        got = index.neighbours(seed, used, most=50, common=50)
        assert sorted(got) == np.flatnonzero(score).tolist() and score[got].tolist() == pytest.approx(sorted(score[got], reverse=True))


def test_pack_documents(spark, tokenizer):
    r = random.Random(0)
    texts = [" ".join(r.choices(["alpha", "Beta", "gamma,", "δelta"], k=r.randint(0, 900))) for _ in range(40)]
    data = [*enumerate(texts), (40, None), (41, ""), (41, "same id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in data], "doc_id long, text string, sequence_id string, shard int")
    for shard_bytes in (10**9, 20_000):
        got = pack_documents(docs, PATH, shard_bytes=shard_bytes).collect()
        pieces, sequences = {}, {}
        for p in got:
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) and len(p.ids) == p.length
            pieces.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for i, t in data:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            if i not in (40, 41, None):
                assert [x for _, part in sorted(pieces[i, len(ids)]) for x in part] == ids
        assert pieces[40, 1] == [(0, [1])] and (None, 3) in pieces or len(pieces) >= 43
        for parts in sequences.values():
            ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
            assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    assert pack_documents(docs.limit(0), PATH).count() == 0


# Top k


def plain_top(data, k):
    ok = {i: np.floor(64 * np.array(v, dtype=np.float64)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 3}
    return {(q, r + 1, i, int(s)) for q in ok if q % 20 == 0 for r, (s, i) in enumerate([(-n, i) for n, i in sorted((-float(ok[q] @ ok[i]), i) for i in ok if i != q)][:k])}


@pytest.mark.parametrize("size", [16_000_000, 100])
def test_top_k_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "QUERY_BYTES", size)
    monkeypatch.setattr(topk, "PART_BYTES", 10 * size)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    monkeypatch.setattr(topk, "ANNULUS", 16)
    r = np.random.default_rng(5)
    data = [(i, [float(x) for x in r.normal(size=3) * (3 if i % 9 == 0 else 0.4)]) for i in range(200)]
    data += [(i, [0.25, -0.5, 0.125]) for i in range(200, 260)] + [(260, None), (280, []), (300, [1.0, None, 0.0]), (320, [float("nan"), 0.0, 0.0]), (340, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (380, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in data], "vec_id long, embedding array<float>, rank int")
    data = [(i, [float(np.float32(c)) if c is not None else None for c in x] if x else x) for i, x in data]
    got = {tuple(x) for x in top_k(v, v.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(data, 20)


def test_top_k_of_huge_and_unequal_vectors(spark):
    big = 2.0**24  # scores up to 2**61, more than doubles tell apart
    data = [(0, [big, big + 1]), (1, [big, big]), (2, [big, big + 2]), (3, [1e160, 1.0]), (20, [1e300, 0.0]), (4, [0.0, 0.0]), (40, [1.0]), (41, [2.0]), (5, [0.5 + 2.0**-8, -1.0]), (60, [3.0, 3.0, 3.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(v, v.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score").collect()]
    whole = {i: [int(64 * c // 1) for c in x] for i, x in data if max(map(abs, x)) < 1e100}
    want = []
    for q in (0, 40, 60):
        s = sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))
        want += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    assert sorted(got) == sorted(want)


def test_top_k_of_few(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in top_k(v, v.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1, 8192), (2, 2, 8192)]
    assert top_k(v.limit(0), v).count() == 0 and top_k(v, v.limit(0)).count() == 0 and top_k(v.limit(1), v.limit(1)).count() == 0


# Pipeline


def test_pipeline_on_the_small_tables(spark):
    from skeinwork.llm.decontaminate import Matcher

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert set(rows) <= set(kept)
        if name == "language_id":
            assert all(any(c.isalpha() for c in t) for t in rows.values()) and len(rows) > 0.95 * len(kept)
        if name == "line_dedup":
            assert set(rows) == set(kept) and all(set(rows[i].split("\n")) <= {*kept[i].split("\n"), ""} for i in rows)
        if name == "near_dedup":
            from test_dedup import plain_near

            assert set(rows) == {i for i, (_, c) in plain_near(list(kept.items()), 2).items() if c == i}
        if name == "decontamination":
            m = Matcher([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()], 0.05, 40)
            assert set(rows) == {i for i, t in kept.items() if not m.find(t)}
        kept = rows
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def odd_tables(spark, path, empty=False):
    """Documents with copies, edited copies, repeated lines and rows, test items, nulls, and columns of clashing names."""
    r = random.Random(11)
    word = lambda: "".join(r.choices(["ba", "lo", "mi", "ne", "ru", "sta"], k=r.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, edited = [prose(r.randint(60, 200)) for _ in range(60)], []
    items = [prose(16) for _ in range(4)]
    for k in range(20):
        w = texts[k].split()
        w[r.randrange(len(w))] = "anders"
        edited.append(len(texts))
        texts.append(" ".join(w))
    texts += texts[30:34] + [None, "", " \n\t", "123 --- 456", f"{prose(40)} {items[0].upper()}, {prose(40)}", f"{prose(30)}\n{items[1].replace('a', 'o', 2)}\n{prose(30)}", prose(20_000)]
    line = prose(9)
    texts += [f"{prose(50)}\n{line}\n{prose(20)}" for _ in range(5)]
    rows = [(i, t, "xx", "s", len(t or ""), i, "k", 0) for i, t in enumerate(texts)]
    rows += [(len(texts), texts[40], None, None, None, None, None, None)] + [rows[50], rows[50]]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, id long, component_id string, n_lines int")
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([] if empty else [*enumerate(items), (None, None), (9, "")], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return [r[:2] for r in rows], items, edited


def test_pipeline_stages_on_odd_tables_against_brute_force(spark, tmp_path):
    from test_dedup import plain_lines, plain_near
    from test_scans import plain_distance

    from skeinwork.llm.decontaminate import budget, normalise
    from skeinwork.llm.language import learn_languages

    rows, items, edited = odd_tables(spark, tmp_path)
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        got = docs.collect()
        after = {r.doc_id: r.text for r in got}
        assert docs.columns == columns and sum(r.doc_id == 50 for r in got) in (0, 3)
        if name == "language_id":
            models = learn_languages(spark.read.parquet(f"{sf}/documents.parquet").where(corpus_pipeline.fold("doc_id", 4) != 2))
            rejected = models.identify([t or "" for t in before.values()])[3]
            assert after == {i: t for (i, t), x in zip(before.items(), rejected, strict=True) if not x}
            assert all(i not in after for i, t in before.items() if not any(c.isalpha() for c in t or "")) and len(after) > 0.9 * len(before)
        if name == "line_dedup":
            assert after == {i: t for i, (_, _, t) in plain_lines(list(before.items())).items()} and all(r.n_chars == len(r.text) for r in got)
        if name == "near_dedup":
            assert set(after) == {i for i, (_, c) in plain_near(list(before.items()), 2).items() if c == i}
            assert sum(i not in after for i in edited) >= 0.9 * len(edited)
        if name == "decontamination":
            held = lambda t: any(plain_distance(n, normalise(t)) <= budget(len(n), 0.05, 40) for n in map(normalise, items))
            assert set(after) == {i for i, t in before.items() if not held(t)} and len(after) < len(before)
        before = after
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_pipeline_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
