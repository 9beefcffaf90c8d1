"""Queries of the subpackage against their SQL on the smallest tables."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from skeinwork.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables")


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    ours, theirs = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.ORACLE_SQL[name]).fetch_df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(ours) == plain(theirs)


CONTRACTS = {
    "op1_decontaminate": "id doc_id item_id distance budget start end".split()[1:],
    "op2_line_dedup": "doc_id n_lines n_dropped kept_sha256".split(),
    "op3_retrieval_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset".split(),
    "op4_minhash_near_dedup": "doc_id n_shingles component_id kept".split(),
    "op5_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans".split(),
    "op6_exact_top_k": "query_id rank vec_id score".split(),
    "op7_language_id": "doc_id held_out lang_pred score".split(),
    "op8_toxicity": "doc_id held_out score predicted".split(),
    "op9_substring_dedup": "doc_id n_words n_removed kept_sha256".split(),
    "op10_quality": "doc_id held_out score predicted".split(),
}
TYPES = {"score": "double", "kept": "boolean", "held_out": "boolean", "predicted": "int", "rank": "int", "kept_sha256": "string", "base_sha256": "string", "spans": "string", "lang_pred": "string", "distance": "int", "budget": "int"}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(CONTRACTS, key=len))
def test_contract(spark, documents, name):
    """Columns and types, one row per document, and what follows from each row's document, in plain Python."""
    df = q.QUERIES[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    assert {c: types.get(c) for c in CONTRACTS[name]} == {c: "bigint" if c == "score" and name.startswith("op6") else TYPES.get(c, "bigint") for c in CONTRACTS[name]}
    rows = df.collect()
    if name not in ("op1_decontaminate", "op3_retrieval_packing", "op6_exact_top_k"):
        assert sorted(r.doc_id for r in rows) == sorted(documents)
    fold = lambda r, n: zlib.crc32(str(r.doc_id).encode()) % n
    if name == "op1_decontaminate":
        from test_scans import plain_distance

        from skeinwork.llm.decontaminate import normalise

        items = {r.item_id: normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
        whole = {(d, i) for d, r in documents.items() for i, x in items.items() if x in normalise(r.text or "")}
        assert whole and whole <= {(r.doc_id, r.item_id) for r in rows}
        for r in rows:
            inside = normalise(documents[r.doc_id].text[r.start : r.end])
            assert r.distance <= r.budget == int(len(items[r.item_id]) * 0.05) and plain_distance(items[r.item_id], inside) == r.distance
    if name == "op3_retrieval_packing":
        from tokenizers import Tokenizer

        own, pieces, filled = Tokenizer.from_file(q.public_tokenizers.path("word_bpe_49k.json")), {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append(r)
            filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert set(pieces) == set(documents)
        for d, parts in pieces.items():
            ids = [*own.encode(documents[d].text or "", add_special_tokens=False).ids, 1]
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
                at += r.length
            assert at == len(ids)
        sizes = []
        for parts in filled.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            sizes.append(at)
        assert max(sizes) <= 2048 and all(n & (n - 1) == 0 for n in sizes)
    if name == "op5_secret_scan":
        from test_scans import plain_scan

        from skeinwork.llm.secrets import joined

        for r in rows:
            base = plain_scan(documents[r.doc_id].text or "")
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
            assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest() and set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))
    if name == "op7_language_id":
        langs = {r.lang for r in documents.values()}
        assert all(r.held_out == (fold(r, 4) == 2) and 0 <= r.score <= 1 for r in rows)
        assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in documents[r.doc_id].text or "")) and r.lang_pred in langs | {"und"} for r in rows)
        held = [r for r in rows if r.held_out and r.lang_pred != "und"]
        assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) > 0.95 * len(held)
    if name in ("op8_toxicity", "op10_quality"):
        folds, out, label = (5, 0, "toxic") if name.startswith("op8") else (3, 1, "quality")
        assert all(r.held_out == (fold(r, folds) == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        true = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        held = [r for r in rows if r.held_out and true.get(r.doc_id) is not None]
        assert sum(r.predicted == true[r.doc_id] for r in held) > 0.85 * len(held)
