"""Queries over the test tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import (
    divergence,
    embedding_dedup,
    html_text,
    language,
    mixing,
    near_dedup,
    packing,
    runs,
    secrets,
    sharding,
    simhash,
    tokens,
    toxicity,
)
from caseloom.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: Target shares of sources, to be scaled to 1; sources that are not listed get the smallest one.
SOURCE_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in the mixed order."""
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, in_order=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), arrivals=sharding.ARRIVALS)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_table(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 0.85)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_toxicity,
        op2_token_counts,
        op3_html_text,
        op4_mixing,
        op5_sharding,
        op6_fingerprints,
        op7_embedding_dedup,
        op8_packing,
        op9_near_dedup,
        op10_secrets,
        op11_language_id,
        op12_source_divergence,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


_REACH = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(a, b) AS (SELECT DISTINCT {id}, {id} FROM {table} UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  c AS (SELECT a AS {id}, min(b) AS component_id FROM r GROUP BY a)"""

NEAR_DEDUP_SQL = (
    """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
  """
    + _REACH.format(id="doc_id", table="documents")
    + """
  SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
  FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""
)

EMBEDDING_DEDUP_SQL = (
    """WITH RECURSIVE l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id
    WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.93),
  """
    + _REACH.format(id="vec_id", table="embeddings")
    + """
  SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
  FROM embeddings JOIN c USING (vec_id)"""
)


DIVERGENCE_SQL = """WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d),
  o AS (SELECT row_id, lang, source, unnest(ws) AS term FROM d),
  t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM o GROUP BY ALL),
  v AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY lang, term HAVING sum(docs) >= 30),
  k AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY lang),
  c AS (SELECT t.lang, t.source, t.term, t.n FROM t JOIN v ON t.lang = v.lang AND t.term = v.term),
  s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
  p AS (SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n,
      1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.total + 5 * k.v) AS p, 1 + (1000000000 * (v.n + 5)) // (k.total + 5 * k.v) AS q
    FROM s JOIN v ON s.lang = v.lang JOIN k ON k.lang = s.lang
    LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term),
  m AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op7_embedding_dedup": EMBEDDING_DEDUP_SQL, "op9_near_dedup": NEAR_DEDUP_SQL, "op12_source_divergence": DIVERGENCE_SQL}
