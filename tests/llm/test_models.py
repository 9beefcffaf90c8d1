import math
import random
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import language as lg
from skeinwork.llm import quality as ql
from skeinwork.llm.toxicity import Lexicon, fold_text, learn_lexicon, toxicity

WORDS = {"aa": ["bako", "tolu", "mira", "senda"], "bb": ["wexit", "zorp", "quilch", "yyv"]}


def texts(seed, n=120):
    r = random.Random(seed)
    return [(i, lang, " ".join(r.choices(WORDS[lang], k=r.randint(5, 40)))) for i in range(n) for lang in [r.choice(list(WORDS))]]


def rows(spark, data):
    return spark.createDataFrame([(i, t, lang, 1.0) for i, lang, t in data], "doc_id long, text string, lang string, score double")


# Language


def plain_levels(texts):
    """Orders 1 to 4 counted in plain Python."""
    key, _ = lg.grams(texts)
    counts, out = Counter(key.tolist()), []
    for n in range(4, 0, -1):
        if n < 4:
            counts = Counter(g & (1 << 16 * n) - 1 for g in counts)
        total = Counter()
        for g, v in counts.items():
            total[g >> 16] += v
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        gram = np.array(sorted(counts), dtype=np.uint64)
        out.insert(0, {"gram": gram, "count": np.array([counts[g] for g in gram.tolist()], dtype=float), "total": np.array([total[g >> 16] for g in gram.tolist()], dtype=float), "discount": min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)})
    return out


def test_kneser_ney_sums_to_one_and_matches_the_formula():
    tables = plain_levels(["abracadabra abra", "cadabra"])
    m = lg.kneser_ney([[t] for t in tables], ["x"])
    g, n = tables[3]["gram"], tables[3]["count"]
    alphabet = np.unique(g & np.uint64(0xFFFF))
    for context in np.unique(g >> np.uint64(16))[:20]:
        p = np.exp(m.log_probabilities(context << np.uint64(16) | alphabet)[:, 0])
        never = np.exp(m.log_probabilities(np.array([context << np.uint64(16) | np.uint64(999)]))[0, 0])
        assert p.sum() + never == pytest.approx(1, abs=1e-5)
    counts, d = dict(zip(g.tolist(), n.tolist(), strict=True)), tables[3]["discount"]
    best = max(counts, key=counts.get)
    same = [v for k, v in counts.items() if k >> 16 == best >> 16]
    lower = math.exp(m.log_probabilities(np.array([(0xFFFF << 48 | best & (1 << 48) - 1)], dtype=np.uint64))[0, 0])
    assert math.exp(m.log_probabilities(np.array([best], dtype=np.uint64))[0, 0]) == pytest.approx((counts[best] - d) / sum(same) + d * len(same) / sum(same) * lower, rel=1e-4)


def test_counts_cover_all_rows(spark, monkeypatch):
    data = texts(4)
    docs = rows(spark, data + data[:9]).repartition(5)
    for most in (lg.TASK_GRAMS, 20):
        monkeypatch.setattr(lg, "TASK_GRAMS", most)
        got = lg._levels(lg._counted(docs.select("text", "lang")).persist(), ["aa", "bb"], lg.MAX_CELLS)
        for j, lang in enumerate(("aa", "bb")):
            for n, want in enumerate(plain_levels([t for _, x, t in data + data[:9] if x == lang])):
                assert all(np.allclose(got[n][j][k].astype(float), want[k].astype(float)) if k == "gram" else got[n][j][k] == pytest.approx(want[k]) for k in want)


def test_a_pruned_model_sums_to_one(spark):
    levels = lg._levels(lg._counted(rows(spark, texts(4)).select("text", "lang")).persist(), ["aa", "bb"], 160, least_grams=10)
    assert all(len(t["gram"]) <= 40 for level in levels for t in level) and min(len(t["gram"]) for t in levels[3]) > 0
    m = lg.kneser_ney(levels, ["aa", "bb"])
    for context in np.unique(m.keys[3] >> np.uint64(16)):
        known = np.exp(m.log_probabilities(context << np.uint64(16) | m.keys[0]).astype(float)).sum(0)
        never = np.exp(m.log_probabilities(np.array([context << np.uint64(16) | np.uint64(999)])).astype(float))[0]
        assert known + never == pytest.approx(np.ones(2), abs=1e-3)


def test_no_ngram_is_left_out_of_models_in_parts(spark):
    r = random.Random(8)
    data = [(i, lang, "".join(r.choices(alphabet, k=300))) for i in range(240) for lang, alphabet in [[("aa", "abcdefghijklm éß"), ("bb", "ghijklmnopqrstuvw "), ("cc", "тестова 漢字")][i % 3]]]
    docs = rows(spark, data)
    # Few enough that the cut of old left out most 4-grams of a language, all that were seen once.
    parts, whole = lg.learn_languages(docs, held_back=4, max_cells=60_000), lg.learn_languages(docs, held_back=4)
    assert not whole.parts and len(parts.parts) > 3
    assert all(len(x.value.keys[-1]) * 3 <= 60_000 for _, _, x in parts.parts)
    some = [t for _, _, t in data[:30]] + [t for _, _, t in texts(5, 20)] + ["", "12", "zzz"]
    for got, want in zip((*parts.measure(some), *parts.identify(some)), (*whole.measure(some), *whole.identify(some)), strict=True):
        assert got == pytest.approx(want, rel=1e-5)
    odd = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    one, other = ({x.doc_id: x for x in lg.identify_language(odd, m).collect()} for m in (parts, whole))
    assert all((x.lang_pred, x.rejected) == (other[i].lang_pred, other[i].rejected) and x.cross_entropy == pytest.approx(other[i].cross_entropy, rel=1e-5) for i, x in one.items()) and len(one) == len(some)
    assert lg.keep_identified(odd, parts).count() == lg.keep_identified(odd, whole).count()


def test_a_context_is_whole_in_every_part_that_cuts_it(spark):
    docs = rows(spark, texts(4))
    models = lg.learn_languages(docs, held_back=4, max_cells=120)
    assert any(low >> 16 == high >> 16 for low, high, _ in models.parts)
    letters = np.append(models.parts[0][2].value.keys[0], np.uint64(999))
    for context in np.unique(np.concatenate([x.value.keys[3] for _, _, x in models.parts]) >> np.uint64(16)):
        split = models._split(context << np.uint64(16) | letters, np.arange(len(letters)))
        p = sum(np.exp(m.log_probabilities(key).astype(float)).sum(0) for m, key, _ in split)
        assert p == pytest.approx(np.ones(2), abs=1e-3)


def test_language_of_unseen_texts(spark):
    models = lg.learn_languages(rows(spark, texts(1, 600)), held_back=4)
    test = texts(2)
    docs = rows(spark, [*test, (900, None, None), (901, None, " 12 \n"), (902, None, "#" * 5000), (903, None, "qqqq jjjj vvvv kkkk ffff dddd hhhh gggg " * 9)])
    got = {r.doc_id: r for r in lg.identify_language(docs, models).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, lang, _ in test)
    assert sum(got[i].rejected for i, _, _ in test) <= 2
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902)) and got[903].rejected
    kept = lg.keep_identified(docs, models)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got.values())
    assert lg.identify_language(docs.limit(0), models).count() == 0


def test_rejection_of_what_was_not_learned(spark):
    """An unlearned language and random letters go, all lengths of what was learned stay but for the stated rate."""
    from pathlib import Path

    sf = Path("/root/testdata/sf0.01")
    if not sf.is_dir():
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = lg.learn_languages(docs.where("lang <> 'de' AND doc_id % 3 > 0"))
    assert "de" not in models.languages
    own = lg.identify_language(docs.where("lang <> 'de' AND doc_id % 3 = 0"), models).collect()
    assert sum(r.rejected for r in own) <= 0.02 * len(own)
    r = random.Random(6)
    junk = spark.createDataFrame([(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=400))) for i in range(40)], "doc_id long, text string")
    assert lg.identify_language(junk, models).where("NOT rejected").count() == 0
    other = lg.identify_language(docs.where("lang = 'de' AND length(text) > 300"), models)
    assert other.where("rejected").count() > 0.9 * other.count()


def test_languages_of_nothing(spark):
    docs = rows(spark, texts(3, 5)).limit(0)
    models = lg.learn_languages(docs)
    some = rows(spark, [(1, None, "abc"), (2, None, "12"), (3, None, None)])
    assert models.languages == [] and lg.identify_language(docs, models).count() == 0
    assert {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in lg.identify_language(some, models).collect()} == {1: ("und", 0.0, False), 2: ("und", 0.0, True), 3: ("und", 0.0, True)}
    assert [r.doc_id for r in lg.keep_identified(some, models).collect()] == [1]


def test_long_text_equals_its_parts():
    key, of = lg.grams(["ab", "", "É 9 x", "ab"])
    assert (of == 1).sum() == 0 and (key[of == 0] == key[of == 3]).all() and (of == 2).sum() == 3


# Toxicity


def test_lexicon_catches_disguised_words(spark):
    r = random.Random(3)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi") for b in ("ran", "tel", "sun", "dor")]
    bad = [*plain, "idiot"]
    data = []
    for i in range(300):
        toxic = i % 5 == 0
        w = r.choices(plain, k=20) + (["idiot"] if toxic else ["clown", "fish"] * (i % 7 == 0))
        r.shuffle(w)
        data.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(999, None)], "doc_id long, toxic int")
    lexicon = learn_lexicon(docs, labels)
    assert any(fold_text("idiot").startswith(e.rstrip()) for e in lexicon.weights) and len(lexicon.weights) < 5
    cases = [(1, "baran tel IDI0T sun"), (2, "baran Ídìоt koran"), (3, "id​iot x"), (4, "baran koran"), (5, None), (6, ""), (7, " ".join(bad[:-1]) * 50), (None, "1d1ot")]
    got = {r.doc_id: r for r in toxicity(spark.createDataFrame(cases, "doc_id long, text string"), lexicon).collect()}
    assert all(got[i].predicted == 1 for i in (1, 2, 3, None)) and all(got[i].predicted == 0 for i in (4, 5, 6, 7))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity(docs.limit(0), lexicon).count() == 0
    assert learn_lexicon(docs, labels.limit(0)).weights == {}


def plain_features(weights, exceptions, text):
    """Every place of every entry, looked up letter by letter."""
    folded = fold_text(text or "")
    free = [(i, i + len(e)) for e in exceptions for i in range(len(folded)) if folded.startswith(e, i)]
    total = sum(w for e, w in weights.items() for i in range(len(folded)) if folded.startswith(e, i) and not any(a <= i and i + len(e) <= b for a, b in free))
    return math.log1p(total), math.log1p(1000 * total / max(1, len(folded.split())))


def test_matching_against_every_place():
    r = random.Random(2)
    weights, exceptions = {" bad": 1.5, " badword ": 0.7, " nas": 2.0, "ob": 0.25}, [" bad luck ", " nas drive "]
    own = Lexicon(weights, exceptions, (-2.0, 1.0, 0.1))
    parts = ["bad", "b4d", "BADWORD", "luck", "nas", "n\u0430s", "drive", "n@s", "lob", "x", ",", "\u200b", "ok"]
    for _ in range(500):
        text = " ".join(r.choices(parts, k=r.randint(0, 12)))
        want = plain_features(weights, exceptions, text)
        assert own.features(text) == pytest.approx(want)
        assert own.score(own.features(text)) == pytest.approx(1 / (1 + math.exp(2 - want[0] - 0.1 * want[1])))


def test_learned_weights_against_counts(spark):
    """Weights, the evidence for an entry and exceptions from plain counts of documents; a repeated label row counts twice."""
    r = random.Random(12)
    words = ["alpha", "bravo", "carol", "delta", "echo", "fox"]
    data = [(i, " ".join(r.choices(words, k=8) + ["vile"] * (i % 4 == 0) + ["vile fox"] * (i % 6 == 1)), int(i % 4 == 0)) for i in range(200)]
    data = [(i, t.replace("vile fox", "clean fox") if y else t, y) for i, t, y in data]
    labels = [(i, y) for i, _, y in data] + [(0, 1)]
    got = learn_lexicon(spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    pos, neg, n = Counter(), Counter(), Counter(y for _, y in labels)
    for i, t, y in [*data, data[0]]:
        (pos if y else neg).update({e for w in fold_text(t).split() for e in [f" {w[:k]}" for k in range(3, min(len(w), 6) + 1)]} | {f" {w} " for w in fold_text(t).split() if len(w) > 6})
    rate, every = n[1] / sum(n.values()), [e for e in pos | neg if pos[e] + neg[e] >= 3]

    def evidence(e):
        p, q = pos[e], neg[e]
        share = p / (p + q)
        return p * math.log(share / rate) + (q * math.log((1 - share) / (1 - rate)) if q else 0)

    fit = [e for e in every if pos[e] >= 3 and pos[e] > rate * (pos[e] + neg[e]) and evidence(e) >= math.log(len(every)) + 4]
    assert set(got.weights) <= set(fit) and got.weights and all(any(e.startswith(k) or k.startswith(e) for k in got.weights) for e in fit)
    assert all(w == pytest.approx(math.log((pos[e] + 0.5) / (n[1] + 1)) - math.log((neg[e] + 0.5) / (n[0] + 1))) for e, w in got.weights.items())


# Quality


def brute_force(m, x):
    linear = m.bias + m.weights @ x
    return linear + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    d = ql.BUCKETS + len(ql.STATISTICS)
    m = ql.Machine(0.3, rng.normal(size=d), rng.normal(size=(d, ql.FACTORS)), rng.normal(size=len(ql.STATISTICS)), np.ones(len(ql.STATISTICS)))
    docs = [b"one two two three", b"", "é Ü!! 12".encode()]
    begin, bucket, value, stats = ql.features(docs)
    fast, _ = m.raw(begin, bucket, value, m.inputs(stats))
    for k in range(3):
        x = np.zeros(d)
        x[bucket[begin[k] : begin[k + 1]]] = value[begin[k] : begin[k + 1]]
        x[ql.BUCKETS :] = m.inputs(stats)[k]
        assert fast[k] == pytest.approx(brute_force(m, x))


def test_quality_is_learned(spark):
    r = random.Random(8)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "rho"])
    data = [(i, " ".join(word() if i % 3 else word().upper() + "$$$" for _ in range(30)), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 300], "doc_id long, quality int")
    machine = ql.learn_quality(docs, labels)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (None, "alpha")], "doc_id long, text string")
    got = {r.doc_id: r for r in ql.quality(docs.union(extra), machine).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in data if i >= 300]) > 0.98
    assert got[1000].score == got[1001].score and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 403
    assert ql.quality(docs.limit(0), machine).count() == 0 and ql.quality(docs, ql.learn_quality(docs, labels.limit(0))).count() == 400
