"""The queries of the ten operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm._fit import fold
from skeinwork.llm.decontaminate import contaminated
from skeinwork.llm.language import identify_language, learn_languages
from skeinwork.llm.line_dedup import line_dedup, sha256_text
from skeinwork.llm.near_dedup import near_dedup
from skeinwork.llm.packing import pack_documents
from skeinwork.llm.quality import learn_quality, quality
from skeinwork.llm.secrets import secret_scan, span_text
from skeinwork.llm.substring_dedup import substring_dedup
from skeinwork.llm.topk import top_k
from skeinwork.llm.toxicity import learn_lexicon, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text")).alias("kept_sha256"))


ORACLE_SQL["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, pos, line, f.k IS NOT NULL AND doc_id > f.first AS gone
  FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256_text(F.col("text")).alias("kept_sha256"))


ORACLE_SQL["op9_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), wins AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, n - 18)) AS p FROM words WHERE n >= 20)
), later AS (
  SELECT doc_id, p FROM wins QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM later, range(0, 20) t(k)
), each_word AS (
  SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(w) AS x FROM words
), kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY e.i) AS t
  FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, w.n AS n_words, w.n - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"), shingle_words=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


ORACLE_SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM words WHERE len(w) >= 2
    UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1)
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(na.n) AS nx, any_value(nb.n) AS ny
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  WHERE 10 * least(na.n, nb.n) >= 8 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs WHERE 100 * common >= 80 * (nx + ny - common)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), component AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
), class AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(l)) AS class_id
  FROM (SELECT doc_id, list(s) AS l FROM shingles GROUP BY doc_id)
)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept, coalesce(k.class_id, s.doc_id) AS class_id
FROM sizes s JOIN component c USING (doc_id) LEFT JOIN class k USING (doc_id)
"""


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity(docs, lexicon).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn_quality(docs, labels.where(fold("doc_id", 3) != 1))
    return quality(docs, machine).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = learn_languages(docs.where(fold("doc_id", 4) != 2))
    return identify_language(docs, models).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query
def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE_SQL["op6_exact_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
) WHERE rank <= 20
"""
