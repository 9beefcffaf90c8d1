import base64
import gzip
import random
import re
import urllib.parse
import zlib

import pytest

from skeinwork.llm.decontaminate import Matcher, budget, contaminated, decontaminate, myers, normalise, pieces, positions
from skeinwork.llm import secrets
from skeinwork.llm.secrets import KINDS, find_secrets, joined, secret_scan

SECRET = 'password="hunter2secret" x '


# Edit matching


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_against_table():
    r = random.Random(5)
    for _ in range(300):
        pattern = "".join(r.choices("abc", k=r.randint(1, 90)))
        text = "".join(r.choices("abc", k=r.randint(0, 120)))
        d, end = myers(pattern, text)
        assert d == plain_distance(pattern, text)
        assert not d < len(pattern) or plain_distance(pattern, text[:end]) == d


def test_positions_agree_with_normalise():
    for text in ("Abc, déf—Σας İx!", "", "  ", "a_b 1²", "ΣΑΣ ς"):
        norm, spans = positions(text)
        assert norm == normalise(text) and len(spans) == len(norm)


def edited(r, text, k):
    t = list(text)
    for _ in range(k):
        i = r.randrange(len(t))
        kind = r.random()
        if kind < 0.34:
            t[i] = r.choice("abcdefgh")
        elif kind < 0.67:
            del t[i]
        else:
            t.insert(i, r.choice("abcdefgh"))
    return "".join(t)


def test_matcher_against_brute_force():
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 30)))) for i in range(12)] + [(98, None), (99, "tiny item"), (100, "abc")]
    matcher = Matcher(items, 0.05, 40)
    for _ in range(60):
        item = r.choice(items[:12])[1]
        text = " ".join(word() for _ in range(20)) + " " + edited(r, item, r.randint(0, 14)) + " " + " ".join(word() for _ in range(20))
        want = {}
        for i, x in items:
            n = normalise(x or "")
            k = budget(len(n), 0.05, 40)
            if len(n) >= 8 and (d := plain_distance(n, normalise(text))) <= k:
                want[i] = d
        assert {h[0]: h[1] for h in matcher.find(text)} == want
    assert "".join(p for _, p in pieces("abcdefg", 2)) == "abcdefg"


def test_contaminated_documents(spark):
    passage = "the quick brown fox jumps over the lazy dog and keeps running until the evening falls"
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x. {passage.upper()}! y", "a", 0), (2, passage.replace("brown", "brawn"), "b", 0), (3, "clean text", "c", 0), (4, None, None, 0), (5, passage[:40], "d", 0), (None, "clean", "e", 0)], "doc_id long, text string, item_id string, start int")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)} and got[1, 1].distance == 0 and got[2, 1].distance == 1
    assert (got[1, 1].start, got[1, 1].end) == (3, 3 + len(passage))
    # Blocks of one item each find the same.
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, block_chars=10).collect()} == set(got)
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3, 4, 5, None]
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0 and decontaminate(docs, items.limit(0)).count() == 6


def test_short_items_are_whole_words_and_ids_may_be_null(spark):
    m = Matcher([(None, "Fine arts"), (None, "the fine art"), (3, "art"), (4, "")], 0.05, 40)
    hits = lambda text: sorted((s, e) for _, _, _, s, e in m.find(text))
    assert hits("see the FINE,arts now") == [(8, 17)] and hits("fine artsy, refine arts, art") == [] and hits("The fine art") == [(0, 12)]
    assert hits("the fine art of fine arts") == [(0, 12), (16, 25)]
    docs = spark.createDataFrame([(1, "the fine art of fine arts"), (2, "art")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "Fine arts"), (None, "the fine art"), (3, "art")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()] == [(1, None), (1, None)]
    assert [r.doc_id for r in decontaminate(docs, items, block_chars=5).collect()] == [2]


# Secrets


def plain_scan(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = []
    for kind, pattern, group, least in (("assign", rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        out += [(m.start(), KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_base_matches_against_plain_patterns():
    r = random.Random(2)
    parts = ["token", "API_KEY", "apikey", "ſecret", "secret", "passwd", "=", ":", " ", '"', "'", "abc", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "tokEn=", "\U0001f600"]
    for _ in range(400):
        text = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert find_secrets(text)[0] == plain_scan(text)


@pytest.mark.parametrize("wrap", [
    lambda s: s,
    urllib.parse.quote,
    lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""),
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: "".join(f"\\x{c:02x}" for c in s.encode()),
    lambda s: urllib.parse.quote(base64.b64encode(gzip.compress(s.encode())).decode(), safe=""),
])
def test_layers(wrap):
    inner = wrap(SECRET)
    text = f"né {inner} end"
    base, every = find_secrets(text)
    assert set(base) <= set(every)
    hit = [text[a:b] for a, kind, b in every if kind == 0]
    assert hit and all(h and h in text for h in hit) and all(3 <= a and b <= 3 + len(inner) for a, _, b in every)


def test_scan_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, SECRET, "c"), (None, "%41%%ZZ \\uZZZZ &#9999999999;", "d"), (4, "A" * 100_000 + "%" * 1000, "e")], "doc_id long, text string, spans string")
    got = secret_scan(docs).collect()
    assert [(r.doc_id, r.n_assign, len(r.spans)) for r in got] == [(1, 0, 0), (2, 0, 0), (2, 1, 1), (None, 0, 0), (4, 0, 0)]
    assert secret_scan(docs.limit(0)).count() == 0 and joined([(1, 0, 5), (1, 2, 9)]) == "assign:1:5,hex:1:9"


def places(text, *parts):
    """Whether each part's span is reported."""
    every = [(a, b) for a, _, b in find_secrets(text)[1]]
    return [any(a <= text.index(p) and text.index(p) + len(p) <= b for a, b in every) for p in parts]


def test_the_same_secret_at_each_of_its_places():
    plain, packed = base64.b64encode(SECRET.encode()).decode(), base64.b64encode(gzip.compress(SECRET.encode())).decode()
    text = f"a {plain} b {packed} c {plain} d {urllib.parse.quote(packed, safe='')}"
    again = text.rindex(plain)
    assert places(text, plain, packed) == [True, True]
    assert (again, 0, again + len(plain)) in find_secrets(text)[1]
    assert any(a >= text.index(" d ") for a, _, _ in find_secrets(text)[1])


def wrapped(data, width=64, end="\n"):
    b = base64.b64encode(data).decode()
    return end.join(b[i : i + width] for i in range(0, len(b), width))


@pytest.mark.parametrize("data", [f"\u00a0{SECRET}".encode(), f"\ufeff{SECRET}\u200b".encode(), f"{SECRET}\x1b\0".encode(), SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), f"\xff {SECRET}".encode("latin-1")])
def test_base64_of_more_than_printable_text(data):
    text = base64.b64encode(data).decode()
    assert places(f"x {text} y", text) == [True]
    text = base64.b64encode(gzip.compress(data)).decode()
    assert places(f"x {text} y", text) == [True]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n"])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_base64(width, end):
    noise = "".join(random.Random(3).choices("abcdefghij klm", k=400))
    # Across the first wrap, the later lines of compressed data, and a text shorter than two lines.
    for data in ((noise[: width // 4 * 3 - 12] + SECRET + noise).encode(), gzip.compress((noise + SECRET).encode()), zlib.compress((noise + SECRET).encode()), (noise[: width // 4 * 3 - 12] + SECRET.strip()).encode()):
        text = wrapped(data, width, end)
        assert end in text and places(f"x:\n{text}\ny", text) == [True]


@pytest.mark.parametrize("before", ["a", "ab", "abc", "abcd", "path/", "id-", "some_name_"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_base64_joined_to_other_text(before, pack):
    text = before + base64.urlsafe_b64encode(pack(SECRET.encode())).decode().rstrip("=")
    assert places(f"x {text} y", text) == [True] and places(f"x {text}-tail/", text) == [True]


def test_words_on_lines_of_their_own_are_not_secrets():
    text = base64.b64encode(SECRET.encode()).decode().rstrip("=")
    every = find_secrets(f"one\n{text}\nThe next line of prose")[1]
    assert {(a, b) for a, _, b in every} == {(4, 4 + len(text))}


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress])
def test_compressed_data_to_its_end(pack):
    long = base64.b64encode(pack(b"word, " * 3_000_000 + SECRET.encode())).decode()
    members = base64.b64encode(b"".join(pack(x) for x in (b"one ", b"two pass", SECRET[4:].encode()))).decode()
    padded = base64.b64encode(pack(b"one") + bytes(5) + pack(SECRET.encode())).decode()
    for text in (long, members, padded):
        assert places(f"x {text} y", text) == [True]


def test_parts_find_what_the_whole_text_has(monkeypatch):
    r = random.Random(4)
    deep = base64.b64encode(base64.b64encode(SECRET.encode())).decode()
    for _ in range(60):
        data = "".join(r.choice(["word, ", "a b ", "(x)", "é", "\n", "%70assword=abcdefg", deep, "token = 'abcdefgh'", "AKIA" + "B" * 16, "0123456789abcdef" * 3]) for _ in range(r.randint(1, 12)))
        text = base64.b64encode(gzip.compress(data.encode())).decode()
        whole = find_secrets(text)
        monkeypatch.setattr(secrets, "CHUNK", r.randint(1, 20))
        monkeypatch.setattr(secrets, "SEGMENT", r.randint(1, 30))
        assert find_secrets(text) == whole
        monkeypatch.undo()
