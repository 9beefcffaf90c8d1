import pytest
from pyspark.sql import functions as F

from skeinwork.functions import analysis as an
from skeinwork.functions import text as tf
from skeinwork.functions.chunking import chunk_documents, listed


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def plain_chunks(body, least=30):
    """The rule in plain Python."""
    out, buffer = [], ""
    for p in (p.strip() for p in __import__("re").split(r"\n\n+", body.strip())):
        if p:
            buffer = f"{buffer} {p}" if buffer else p
            if len(buffer.split()) >= least:
                out.append(buffer)
                buffer = ""
    return out


@pytest.mark.parametrize("body", ["", "  ", "a b", "w " * 29, "w " * 30, "w " * 20 + "\n\n" + "x " * 15 + "\n\n\n y", ("a\n\n" * 31) + "z " * 40])
def test_chunks_match_plain_rule(spark, body):
    got = listed(spark.createDataFrame([(1, body)], "doc_id long, body string")).first()["chunks"]
    assert [c.content for c in got] == plain_chunks(body) and [c.word_count for c in got] == [len(c.split()) for c in plain_chunks(body)]


def test_chunk_numbers_of_scattered_ids(spark):
    ids = [-(10**15), -5, 0, 3, 4, 70_000, 2**40, 2**60]
    docs = spark.createDataFrame([(i, "\n\n".join(["w " * 30] * (k % 3))) for k, i in enumerate(ids)], "doc_id long, body string")
    got = [(r.chunk_id, r.doc_id, r.position) for r in chunk_documents(docs.repartition(4)).orderBy("chunk_id").collect()]
    assert got == [(n + 1, i, p) for n, (i, p) in enumerate((i, p) for k, i in enumerate(ids) for p in range(k % 3))]
    assert chunk_documents(docs.limit(0)).count() == 0


def test_sql_stems_equal_python_stems():
    import random

    import duckdb
    import pandas as pd

    from skeinwork import porter_sql

    r = random.Random(1)
    ends = [*an._STEP2, *an._STEP3, *an._STEP4, "ed", "ing", "eed", "ied", "ies", "sses", "s", "y", "e", "ll", "at", "bl", "iz", "yy"]
    words = {"".join(r.choices("abdelstyouigrnc", k=r.randint(1, 6))) + "".join(r.choices(ends, k=r.randint(0, 2))) for _ in range(20_000)} | set(an._IRREGULAR)
    duck = duckdb.connect()
    duck.register("v", pd.DataFrame({"term": sorted(words)}))
    chain = porter_sql.steps("SELECT term FROM v")
    got = dict(duck.execute(f"WITH {', '.join(f'{k} AS ({x})' for k, x in chain.items())} SELECT term, stem FROM stems").fetchall())
    assert got == {w: an.porter(w) for w in words}


def test_short_document_has_no_chunk_and_null_body_is_skipped(spark):
    docs = spark.createDataFrame([(1, "too short"), (2, None), (70_000, "w " * 30), (3, "v " * 31 + "\n\n" + "u " * 30)], "doc_id long, body string")
    got = [(r.chunk_id, r.doc_id, r.position, r.word_count) for r in chunk_documents(docs).orderBy("chunk_id").collect()]
    assert got == [(1, 3, 0, 31), (2, 3, 1, 30), (3, 70_000, 0, 30)]


def test_tokens_and_stop_words(spark):
    assert value(spark, an.tokenize(F.lit("It's 3 NAÏVE x2y—End"))) == ["it", "s", "na", "ve", "x", "y", "end"]
    assert value(spark, an.analyse(F.lit("the cat and the cat"))) == ["cat", "cat"]
    assert len(an.STOPWORDS) == 153


@pytest.mark.parametrize(("word", "stem"), [p.split(">") for p in "caresses>caress ponies>poni ties>tie cats>cat agreed>agre plastered>plaster motoring>motor conflated>conflat hopping>hop falling>fall filing>file happy>happi sky>sky skies>sky dying>die news>news relational>relat rational>ration digitizer>digit operator>oper hopefulness>hope formaliti>formal triplicate>triplic revival>reviv adoption>adopt effective>effect probate>probat rate>rate controll>control is>is died>die".split()])
def test_porter(word, stem):
    assert an.porter(word) == stem


def test_scalar_functions(spark):
    assert value(spark, tf.snippet(F.lit("a  b\n" * 200))) == ("a b " * 40)[:160] + "…"
    assert value(spark, tf.url_key(F.lit("https://x/y?z=1?q"))) == "https://x/y"
    cases = {"https://www.x.com/news/world-europe-606?a": "world-europe", "https://x.com/news/tech": "tech", "/sport/football/1": "sport", "https://x.com": "Unknown", "": "Unknown", "https://x.com/news": "news", "https://x/news/-12": "Unknown"}
    for url, category in cases.items():
        assert value(spark, tf.url_category(F.lit(url))) == category, url
    assert value(spark, tf.clean_body(F.lit("Share page a  b\n\n \n\nCopy link\n\nc ,external d"))) == "a b\n\nc d"
    for n, text in ((0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 * 1024**3, "5.0 GB")):
        assert value(spark, tf.human_bytes(F.lit(n))) == text
