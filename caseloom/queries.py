"""Queries over the test tables with their SQL equivalents.

Tables stand in for the stored ones: documents with embeddings are chunks, conversations are
e-mails cut into chunks (conv_id the message, turn the chunk), events are metric observations
and audit events, labels are feedback, benchmark items are questions and claims.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.functions import patterns as P
from caseloom.functions import text as T
from caseloom.functions.vectors import hash_embedding
from caseloom.operators import chunking, enrichment, evaluation, governance, grounding, metrics, retrieval
from caseloom.plans import agent, keyword, readonly_sql
from caseloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_vectors(rows: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """rows with the embedding that has their key as vec_id, or null.

    Where no vec_id repeats, vectors are grouped by it.  Spark then knows that a row has one at
    most, and leaves the join out for all that does not read embeddings: texts are not shuffled.
    """
    if vectors.where("vec_id is not null").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        vectors = vectors.groupBy("vec_id").agg(F.first("embedding").alias("embedding"))
    return rows.join(vectors, rows[key] == vectors["vec_id"], "left")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return with_vectors(table(spark, d, "documents"), "doc_id", table(spark, d, "embeddings")).select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "embedding", "source", F.col("lang").alias("doc_type")
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    return with_vectors(table(spark, d, "benchmark"), "item_id", table(spark, d, "embeddings")).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_embedding")
    )


def mails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("message_id"),
        F.col("turn").cast("int").alias("chunk_index"),
        F.col("role").alias("email_from"),
        F.col("text").alias("content"),
    )


CHUNKS = """chunks AS (SELECT doc_id AS id, text AS content, embedding, source, lang AS doc_type
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
QUESTIONS = """questions AS (SELECT item_id AS query_id, text AS query, embedding AS query_embedding
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""
TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{3,}}'))"
SEMANTIC = """semantic AS (SELECT query_id, id, similarity, row_number() OVER
    (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM (SELECT query_id, id, round(list_cosine_similarity(embedding::DOUBLE[], query_embedding::DOUBLE[]), 9) AS similarity
    FROM chunks, questions WHERE embedding IS NOT NULL AND query_embedding IS NOT NULL) QUALIFY rank <= {n})"""
KEYWORD = (
    "keyword AS (SELECT query_id, id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank"
    " FROM (SELECT query_id, id, count(*) AS hits FROM"
    f" (SELECT query_id, unnest({TOKENS.format('query')}) AS token FROM questions)"
    f" JOIN (SELECT id, unnest({TOKENS.format('content')}) AS token FROM chunks) USING (token) GROUP BY ALL)"
    " QUALIFY rank <= %d)"
)


# --- retrieval --------------------------------------------------------------------------


@query(
    f"WITH {CHUNKS}, {QUESTIONS}, {SEMANTIC.format(n=30)}, {KEYWORD % 30}, "
    """fused AS (SELECT query_id, id, round(sum(s), 12) AS rrf_score FROM (
      SELECT query_id, id, 0.7::DOUBLE / (60 + rank) AS s FROM semantic UNION ALL
      SELECT query_id, id, 0.3::DOUBLE / (60 + rank) FROM keyword) GROUP BY ALL)
    SELECT query_id, id, round(rrf_score, 9) AS rrf_score, row_number() OVER
      (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM fused QUALIFY rank <= 10"""
)
def hybrid_search_rrf(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.hybrid_search(chunks(spark, d), questions(spark, d), top_k=10)
    return out.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CHUNKS}, {QUESTIONS}, {SEMANTIC.format(n=10)} SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM semantic")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.semantic_top(chunks(spark, d), questions(spark, d), 10)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CHUNKS}, {QUESTIONS}, {KEYWORD % 10} SELECT query_id, id, hits, rank FROM keyword")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.keyword_top(chunks(spark, d), questions(spark, d), 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query()
def keyword_rank_cover_density(spark: SparkSession, d: str) -> DataFrame:
    # any of a question's words
    asks = questions(spark, d).withColumn("query", F.array_join(F.split("query", r"\s+"), " or "))
    return keyword.ranked_top(chunks(spark, d), asks, 10)


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'de' AND source = 'src0'")
def filter_equality(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.apply_filters(table(spark, d, "documents"), {"lang": "de", "source": "src0"}).select("doc_id", "source", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'gr')")
def filter_substring(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.apply_filters(table(spark, d, "part"), {"p_name_contains": "GR"}).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    bounds = {"o_orderdate_from": "1995-01-01 00:00:00", "o_orderdate_to": "1995-06-30 00:00:00"}
    return retrieval.apply_filters(table(spark, d, "orders"), bounds).select("o_orderkey", "o_orderdate")


MAILS = """mails AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS message_id, CAST(turn AS INTEGER) AS chunk_index,
  role AS email_from, text AS content FROM conversations)"""
HITS = "hits AS (SELECT 0::BIGINT AS query_id, * FROM mails WHERE chunk_index = 2)"


def mail_hits(spark: SparkSession, d: str) -> DataFrame:
    return mails(spark, d).where("chunk_index = 2").withColumn("query_id", F.lit(0).cast("long"))


@query(
    f"""WITH {MAILS}, {HITS}, wanted AS (SELECT DISTINCT query_id, message_id, unnest(range(chunk_index - 1, chunk_index + 2)) AS chunk_index FROM hits)
    SELECT query_id, id, message_id, chunk_index, FALSE AS stitched FROM hits UNION ALL
    SELECT w.query_id, m.id, m.message_id, m.chunk_index, TRUE FROM mails m JOIN wanted w ON m.message_id = w.message_id
      AND m.chunk_index = w.chunk_index WHERE w.chunk_index >= 0 AND m.id NOT IN (SELECT id FROM hits)"""
)
def neighbor_stitch(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.stitch_neighbours(mail_hits(spark, d), mails(spark, d), 1)


@query(
    f"""WITH {MAILS}, {HITS} SELECT query_id, id, message_id, chunk_index, FALSE AS is_sibling FROM hits UNION ALL
    SELECT 0::BIGINT, id, message_id, chunk_index, TRUE FROM mails
    WHERE message_id IN (SELECT message_id FROM hits) AND id NOT IN (SELECT id FROM hits)"""
)
def sibling_completion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.complete_siblings(mail_hits(spark, d), mails(spark, d))


@query(
    f"""WITH {MAILS}, hits AS (SELECT * FROM mails WHERE chunk_index = 0),
    files AS (SELECT m.id, m.message_id, m.chunk_index, embedding FROM mails m LEFT JOIN embeddings ON vec_id = m.id // 1000 * 8 + m.chunk_index WHERE chunk_index > 0)
    SELECT id, message_id AS link, CAST(r AS BIGINT) AS link_rank FROM (SELECT f.id, f.message_id,
      row_number() OVER (PARTITION BY f.message_id ORDER BY round(list_cosine_similarity(f.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC NULLS LAST, f.id) AS r
      FROM files f JOIN hits h ON f.message_id = h.message_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE r <= 2"""
)
def attachment_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    all_mails = mails(spark, d)
    files = all_mails.where("chunk_index > 0").withColumn("parent_message_id", F.col("message_id")).withColumn(
        "vec_id", F.floor(F.col("id") / 1000) * 8 + F.col("chunk_index")
    ).join(vectors, "vec_id", "left")
    first = vectors.where("vec_id = 0").select(F.col("embedding").alias("query_embedding"))
    hits = all_mails.where("chunk_index = 0").withColumn("query_id", F.lit(0)).crossJoin(F.broadcast(first))
    out = retrieval.linked_top(hits, files, "message_id", "parent_message_id", 2, by_similarity=True)
    return out.select("id", "link", F.col("link_rank").cast("long").alias("link_rank"))


@query(
    f"""WITH {MAILS}, parents AS (SELECT DISTINCT message_id FROM mails WHERE chunk_index >= 5)
    SELECT id, message_id AS link, CAST(r AS BIGINT) AS link_rank FROM (SELECT m.id, m.message_id,
      row_number() OVER (PARTITION BY m.message_id ORDER BY chunk_index, m.id) AS r
      FROM mails m JOIN parents USING (message_id) WHERE m.chunk_index < 5) WHERE r <= 2"""
)
def parent_topk(spark: SparkSession, d: str) -> DataFrame:
    all_mails = mails(spark, d)
    hits = all_mails.where("chunk_index >= 5").withColumn("query_id", F.lit(0)).withColumn("parent_message_id", F.col("message_id"))
    out = retrieval.linked_top(hits, all_mails.where("chunk_index < 5"), "parent_message_id", "message_id", 2)
    return out.select("id", "link", F.col("link_rank").cast("long").alias("link_rank"))


BOOST_QUERY = "Report from src3 about the de and fr meeting on 2024-01-15"


@query(
    rf"""WITH t AS (SELECT doc_id, text, {TOKENS.format('source')} AS a, {TOKENS.format('lang')} AS b,
      {TOKENS.format("left(text, 40)")} AS s, {TOKENS.format(f"'{BOOST_QUERY}'")} AS q FROM documents)
    SELECT doc_id, round(0.15 * (len(list_intersect(q, a)) + len(list_intersect(q, b))) + 0.075 * len(list_intersect(q, s))
      + 0.15 * CASE WHEN contains(text, '2024-01-15') THEN 1 ELSE 0 END, 6)::DOUBLE AS boost FROM t"""
)
def metadata_boost(spark: SparkSession, d: str) -> DataFrame:
    boost = retrieval.metadata_boost(
        F.lit(BOOST_QUERY), F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.substring("text", 1, 40), F.col("text")
    )
    return table(spark, d, "documents").select("doc_id", F.round(boost, 6).alias("boost"))


# --- text -------------------------------------------------------------------------------

STRIP = r"regexp_replace(regexp_replace({0}, '^[\s]+', ''), '[\s]+$', '')"
DENSITY = (
    "SELECT *, CASE WHEN length({c}) < 50 OR len(ls) = 0 THEN 'normal'"
    " WHEN len(regexp_extract_all({c}, '" + P.LEGAL + "'))::DOUBLE / greatest(words, 1) > 0.03 OR average > 120 THEN 'dense'"
    " WHEN len(regexp_extract_all({c}, '" + P.INFORMAL + "')) >= 2 OR average < 50 THEN 'conversational' ELSE 'normal' END AS density"
    " FROM (SELECT *, list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / nullif(len(ls), 0) AS average,"
    " len(regexp_extract_all({c}, '\\S+')) AS words FROM (SELECT *, list_filter(string_split(trim({c}, E' \\n\\t\\r'), E'\\n'), lambda x: length(trim(x)) > 0) AS ls FROM {t}))"
)


@query(f"SELECT conv_id, turn, density FROM ({DENSITY.format(c='text', t='conversations')})")
def content_density(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.content_density(F.col("text")).alias("density"))


@query(
    f"SELECT doc_id, CAST(CASE density WHEN 'dense' THEN 512 WHEN 'conversational' THEN 1500 ELSE 1024 END AS INTEGER) AS chunk_size"
    f" FROM ({DENSITY.format(c='text', t='documents')})"
)
def dynamic_chunk_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.chunk_size(F.col("text")).alias("chunk_size"))


def conversation_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text for each conversation: an upper-case title and its turns as paragraphs."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    paras = F.transform("t", lambda x: F.concat(F.when(x["turn"] % 3 == 0, F.concat(F.upper(x["role"]), F.lit(" NOTES\n\n"))).otherwise(""), x["text"]))
    return turns.select("conv_id", F.array_join(paras, "\n\n").alias("content"))


TEXTS = r"""texts AS (SELECT conv_id, string_agg(CASE WHEN turn % 3 = 0 THEN upper(role) || E' NOTES\n\n' ELSE '' END || text, E'\n\n' ORDER BY turn) AS content
  FROM conversations GROUP BY conv_id)"""
PARAGRAPHS = (
    r"""paras AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS BIGINT) AS seq, p FROM (
  SELECT conv_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT conv_id, list_filter(list_transform(
    regexp_split_to_array(content, '\n\s*\n'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS l FROM texts))),
typed AS (SELECT *, string_split(p, E'\n') AS ls FROM paras),
segs AS (SELECT conv_id, seq, p AS content, CASE
  WHEN len(ls) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(x, '"""
    + P.LIST_LINE
    + r"""')))::DOUBLE / len(ls) > 0.5 THEN 'list'
  WHEN len(ls) = 1 AND regexp_matches(p, '^#{1,6}\s+.+$') THEN 'heading'
  WHEN len(ls) = 1 AND length(p) BETWEEN 5 AND 120 AND NOT ends_with(p, '.') AND regexp_matches(p, '"""
    + P.UPPER_HEADING
    + r"""') THEN 'heading'
  WHEN len(regexp_extract_all(p, '"""
    + P.HEADER_LINE
    + r"""')) >= 2 AND len(regexp_extract_all(p, '"""
    + P.HEADER_LINE
    + r"""'))::DOUBLE / len(ls) > 0.5 THEN 'email_header' ELSE 'paragraph' END AS type FROM typed)"""
)


@query(f"WITH {TEXTS}, {PARAGRAPHS} SELECT conv_id, seq, type, CAST(length(content) AS BIGINT) AS char_count FROM segs")
def segment_list(spark: SparkSession, d: str) -> DataFrame:
    rows = conversation_texts(spark, d).select("conv_id", F.posexplode(chunking.segments(F.col("content"))).alias("seq", "s"))
    return rows.select("conv_id", F.col("seq").cast("long").alias("seq"), "s.type", F.col("s.char_count").cast("long").alias("char_count"))


@query(f"WITH {TEXTS}, {PARAGRAPHS} SELECT type, count(*) AS n FROM segs GROUP BY type")
def paragraph_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = conversation_texts(spark, d).select(F.explode(chunking.segments(F.col("content"))).alias("s"))
    return rows.groupBy("s.type").agg(F.count(F.lit(1)).alias("n"))


@query()
def chunk_assemble(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(conversation_texts(spark, d))


@query()
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(table(spark, d, "documents"), "doc_id", "text")


@query()
def email_segment(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("From: a@example.com\nTo: b@example.com\nSubject: case\n\n"), F.col("content"))
    return chunking.segment_emails(conversation_texts(spark, d).withColumn("content", head), "conv_id", "content")


HTML_SQL = r"""trim(regexp_replace(regexp_replace({unescaped}, '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n\t\r')"""


def _unescape_sql(c: str) -> str:
    c = f"regexp_replace({c}, '&#0*39;|&#[xX]0*27;', '''', 'g')"
    c = f"regexp_replace({c}, '&#0*34;|&#[xX]0*22;', '\"', 'g')"
    c = f"regexp_replace({c}, '&#0*60;|&#[xX]0*3[cC];', '<', 'g')"
    c = f"regexp_replace({c}, '&#0*62;|&#[xX]0*3[eE];', '>', 'g')"
    for name, char in T.NAMED.items():
        if name != "amp":
            char = "''" if char == "'" else char
            c = f"replace({c}, '&{name};', '{char}')"
    return f"regexp_replace({c}, '&amp;|&#0*38;|&#[xX]0*26;', '&', 'g')"


_STRIPPED = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'),"
    r" '(?i)<br\s*/?>', E'\n', 'g'), '(?i)</p\s*>', E'\n', 'g'), '(?s)<[^>]+>', ' ', 'g')"
)


@query("SELECT page_id, md5(" + HTML_SQL.format(unescaped=_unescape_sql(_STRIPPED)) + ") AS text_md5 FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


PII_UNION = " UNION ALL ".join(
    f"SELECT '{name}' AS pii_type, doc_id, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS n FROM documents"
    for name, pattern, _ in P.PII
)


@query(f"SELECT pii_type, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT doc_id) AS documents FROM ({PII_UNION}) WHERE n > 0 GROUP BY pii_type")
def pii_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.pii_counts(F.col("text"))).alias("pii_type", "n"))
    return rows.groupBy("pii_type").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("documents"))


def _redact_sql() -> str:
    c = "text"
    for _, pattern, token in P.PII:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{token}', 'g')"
    return c


@query(f"SELECT doc_id, md5({_redact_sql()}) AS redacted_md5 FROM documents")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact_pii(F.col("text"))).alias("redacted_md5"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^(?:https?)://([^/?#]+)', 1)) AS host, len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs FROM pages")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", F.lower(F.regexp_extract("url", r"^(?:https?)://([^/?#]+)", 1)).alias("host"),
        F.regexp_count("html", F.lit("(?i)<p[ >]")).cast("long").alias("paragraphs"),
    )


# --- grounding --------------------------------------------------------------------------


def answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer of each document: its text and two citations, the second of them unknown for odd
    ids."""
    cited = F.concat(
        F.col("text"), F.lit(" [Source: data/"), F.col("source"), F.lit(", p.3] and [Source: "),
        F.when(F.col("doc_id") % 2 == 1, F.lit("other.pdf")).otherwise(F.col("source")), F.lit("]"),
    )
    return table(spark, d, "documents").select("doc_id", "source", cited.alias("answer"))


ANSWERS = """answers AS (SELECT doc_id, source, text || ' [Source: data/' || source || ', p.3] and [Source: '
  || CASE WHEN doc_id % 2 = 1 THEN 'other.pdf' ELSE source END || ']' AS answer FROM documents)"""


@query(
    f"""WITH {ANSWERS}, c AS (SELECT doc_id, unnest(regexp_extract_all(answer, '{P.CITATION}', 1)) AS cited,
      unnest(regexp_extract_all(answer, '{P.CITATION}', 2)) AS page FROM answers)
    SELECT doc_id, trim(cited) AS cited, coalesce(CAST(nullif(page, '') AS INTEGER), 0) AS page FROM c"""
)
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).select("doc_id", F.explode(T.citations(F.col("answer"))).alias("c"))
    return rows.select("doc_id", F.col("c.source").alias("cited"), F.coalesce("c.page", F.lit(0)).alias("page"))


@query(
    f"""WITH {ANSWERS}, c AS (SELECT doc_id, source, lower(trim(unnest(regexp_extract_all(answer, '{P.CITATION}', 1)))) AS cited FROM answers),
    s AS (SELECT doc_id, avg(CASE WHEN cited = lower(source) OR ends_with(cited, lower(source)) OR ends_with(lower(source), cited) THEN 1.0 ELSE 0.0 END) AS score FROM c GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'grounded' WHEN score >= 0.5 THEN 'partial' ELSE 'ungrounded' END AS status FROM s"""
)
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    score = grounding.grounding_score(grounding.validate_citations(F.col("answer"), F.array("source")))
    return answers(spark, d).select("doc_id", F.round(score, 6).alias("score"), grounding.grounding_status(score).alias("status"))


@query(
    rf"""WITH claims AS (SELECT o_orderkey AS claim_id, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' with ' || CAST(o_orderkey % 7 AS VARCHAR) || '%' AS claim FROM orders),
    v AS (SELECT DISTINCT claim_id, unnest(regexp_extract_all(claim, '{P.CRITICAL}')) AS value FROM claims),
    n AS (SELECT norm, count(*) AS n FROM (SELECT DISTINCT regexp_replace(lower(value), '[$,\s]', '', 'g') AS norm FROM v)
      JOIN (SELECT regexp_replace(lower(text), '[,\s]', '', 'g') AS body FROM documents) ON contains(body, norm) GROUP BY norm)
    SELECT claim_id, value, coalesce(n, 0) AS supporting_docs, coalesce(n, 0) >= 2 AS is_sufficiently_supported
    FROM v LEFT JOIN n ON norm = regexp_replace(lower(value), '[$,\s]', '', 'g')"""
)
def critical_fact_support(spark: SparkSession, d: str) -> DataFrame:
    claim = F.concat(
        F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" with "), (F.col("o_orderkey") % 7).cast("string"), F.lit("%")
    )
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), claim.alias("claim"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return grounding.supported_facts(claims, docs)


@query(
    r"""WITH s AS (SELECT item_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x)), lambda x: length(x) >= 20 AND NOT starts_with(x, '#'))) AS claim FROM benchmark),
    w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(claim), '[a-z]{4,}')) AS words FROM s),
    d AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words FROM benchmark),
    j AS (SELECT w.item_id, len(w.words) > 0 AND NOT len(list_intersect(w.words, d.words)) >= greatest(2, len(w.words) // 3) AS bad
      FROM w JOIN d ON d.item_id = (w.item_id // 2) * 2)
    SELECT item_id, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 6) AS rate FROM j GROUP BY item_id"""
)
def unsupported_claim_rate(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    other = items.select((F.col("item_id")).alias("ref"), F.array("text").alias("docs"))
    pairs = items.withColumn("ref", F.floor(F.col("item_id") / 2) * 2).join(other, "ref")
    return pairs.select("item_id", F.round(grounding.unsupported_rate(F.col("text"), F.col("docs")), 6).alias("rate"))


SIGNALS = """signals AS (SELECT doc_id, 8 AS cited, doc_id % 9 AS invalid, list_resize([CASE WHEN toxic = 1 THEN 'critical' ELSE 'minor' END], doc_id % 4, 'major') AS sev,
  4 AS facts, CASE WHEN quality = 1 THEN 0 ELSE doc_id % 5 END AS weak FROM labels)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("toxic") == 1, "critical").otherwise("minor")
    n = (F.col("doc_id") % 4).cast("int")
    sev = F.slice(F.concat(F.array(first), F.array_repeat(F.lit("major"), 3)), F.lit(1), n)
    return table(spark, d, "labels").select(
        "doc_id", F.lit(8).alias("cited"), (F.col("doc_id") % 9).alias("invalid"), sev.alias("sev"), F.lit(4).alias("facts"),
        F.when(F.col("quality") == 1, 0).otherwise(F.col("doc_id") % 5).alias("weak"),
    )


@query(
    f"""WITH {SIGNALS}, r AS (SELECT *, least(1.0, greatest(0.0, 0.35 * invalid / cited + 0.35 * CASE WHEN len(sev) = 0 THEN 0.0 ELSE
      list_sum(list_transform(sev, lambda s: CASE s WHEN 'critical' THEN 1.0::DOUBLE WHEN 'major' THEN 0.6 ELSE 0.3 END)) / len(sev) END + 0.30 * weak / facts)) AS score FROM signals)
    SELECT doc_id, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.65 THEN 'block' WHEN round(score, 9) >= 0.35 THEN 'warn' ELSE 'pass' END AS decision,
    concat_ws('; ', CASE WHEN invalid > 0 THEN invalid || '/8 invalid citations' END,
      CASE WHEN list_contains(sev, 'critical') THEN '1 critical unsupported claims' WHEN len(sev) > 0 THEN len(sev) || ' unsupported claims' END,
      CASE WHEN weak > 0 THEN weak || '/4 weak critical facts' END) AS flags FROM r"""
)
def hallucination_score(spark: SparkSession, d: str) -> DataFrame:
    args = [F.col(c) for c in ("cited", "invalid", "sev", "facts", "weak")]
    score = grounding.risk_score(*args)
    return signals(spark, d).select(
        "doc_id", F.round(score, 6).alias("score"), grounding.risk_decision(F.round(score, 9)).alias("decision"),
        F.array_join(grounding.risk_flags(*args), "; ").alias("flags"),
    )


@query(
    """SELECT doc_id, CASE WHEN b = 'pass' AND quality = 0 THEN 'partial' ELSE b END AS status FROM (SELECT doc_id, quality,
      CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = doc_id % 4 THEN 'pass' WHEN doc_id % 3 > 0 THEN 'partial' ELSE 'fail' END AS b FROM labels)"""
)
def validation_status(spark: SparkSession, d: str) -> DataFrame:
    status = grounding.validation_status(F.col("doc_id") % 4, F.col("doc_id") % 3, F.when(F.col("quality") == 0, 1).otherwise(0))
    return table(spark, d, "labels").select("doc_id", status.alias("status"))


# --- evaluation and metrics -------------------------------------------------------------


@query(
    """WITH r AS (SELECT source, list('d' || doc_id ORDER BY n_chars DESC, doc_id)[1:20] AS retrieved FROM documents GROUP BY source),
    g AS (SELECT source, list('d' || doc_id ORDER BY doc_id) AS relevant FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
    SELECT source, round(len(list_filter(retrieved[1:10], lambda x: list_contains(relevant, x))) / 10.0, 6)::DOUBLE AS precision_at_k,
      round(len(list_filter(relevant, lambda x: list_contains(retrieved[1:10], x)))::DOUBLE / len(relevant), 6) AS recall_at_k,
      round(coalesce(1.0 / list_min(list_filter(list_transform(retrieved, lambda x, i: CASE WHEN list_contains(relevant, x) THEN i END), lambda y: y IS NOT NULL)), 0), 6)::DOUBLE AS reciprocal_rank
    FROM r JOIN g USING (source)"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    order = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    retrieved = docs.select(F.col("source").alias("key"), name.alias("item"), order.alias("rank")).where("rank <= 20")
    good = docs.join(labels.where("quality = 1"), "doc_id").select(F.col("source").alias("key"), name.alias("item"))
    found = evaluation.rank_metrics(retrieved, good, 10).join(good.select("key").distinct(), "key", "left_semi")
    return found.select(F.col("key").alias("source"), *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")])


@query(
    f"""WITH m AS ({ORACLES['retrieval_metrics']})
    SELECT count(*) AS questions, count(*) AS with_truth, round(avg(precision_at_k), 4) AS avg_precision_at_k,
    round(avg(recall_at_k), 4) AS avg_recall_at_k, round(avg(reciprocal_rank), 4) AS avg_mrr FROM m"""
)
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval_metrics(spark, d).withColumn("relevant", F.array(F.lit("x")))
    out = evaluation.report(rows)
    return out.select(
        "questions", F.col("with_truth").cast("long").alias("with_truth"),
        *[F.round(c, 4).alias(c) for c in ("avg_precision_at_k", "avg_recall_at_k", "avg_mrr")],
    )


@query(
    """SELECT node, count(seconds) AS n, round(avg(seconds), 4) AS mean_seconds FROM (SELECT event_type AS node,
      (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS seconds FROM events) GROUP BY node"""
)
def node_latency(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), F.col("event_type").alias("node"), "ts")
    return evaluation.node_timings(steps).groupBy("node").agg(F.count("seconds").alias("n"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))


SUMMARY = """SELECT name, count(*) AS n, round(avg(value), 6) AS mean, round(list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1], 6) AS p50,
  round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 6) AS p95,
  round(list_sort(list(value))[least(CAST(floor(count(*) * 0.99) AS BIGINT), count(*) - 1) + 1], 6) AS p99, round(max(value), 6) AS max
  FROM (SELECT {name} AS name, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1000) GROUP BY name"""


def observations(spark: SparkSession, d: str, prefix: str = "") -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit(prefix), F.col("event_type")).alias("name"), F.col("event_id").alias("seq"), "value"
    )


@query(SUMMARY.format(name="event_type"))
def histogram_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram_summary(observations(spark, d))


@query(
    f"""WITH s AS ({SUMMARY.format(name="'node_latency.' || event_type")}), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT name || '.p95' AS metric, 10.0::DOUBLE AS threshold, round(p95, 6) AS actual FROM s WHERE p95 > 10 UNION ALL
    SELECT 'error_rate', 0.02, round(e / t, 6) FROM (SELECT sum(n) FILTER (event_type = 'error')::DOUBLE AS e, sum(n) FILTER (event_type = 'view')::DOUBLE AS t FROM c) WHERE e / t > 0.02"""
)
def slo_violations(spark: SparkSession, d: str) -> DataFrame:
    summary = metrics.histogram_summary(observations(spark, d, "node_latency."))
    names = F.create_map(F.lit("view"), F.lit("node_invocations.retriever"), F.lit("error"), F.lit("llm_call_failure"))
    counters = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    counters = counters.withColumn("name", F.coalesce(names[F.col("event_type")], "event_type"))
    out = metrics.latency_violations(summary).unionByName(metrics.rate_violations(counters))
    return out.withColumn("actual", F.round("actual", 6))


@query(
    f"""WITH s AS ({SUMMARY.format(name='event_type')})
    SELECT name, '{"{"}p{"}"}'::VARCHAR AS kind, CAST(n AS BIGINT) AS n, 'caseloom_' || replace(replace(replace(name, '.', '_'), '-', '_'), '/', '_') || '_count ' || n AS line FROM s""".replace("'{p}'::VARCHAR", "'count'")
)
def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    summary = metrics.histogram_summary(observations(spark, d))
    counters = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    lines = metrics.exposition(counters, summary).where("kind = 1 and line like '%\\_count %'")
    return lines.join(summary.select("name", "n"), "name").select("name", F.lit("count").alias("kind"), "n", "line")


@query(
    """WITH w AS (SELECT unnest(range(0, 5)) AS k), e AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS window_start, value FROM events, w),
    a AS (SELECT window_start, sum(value) AS value FROM e GROUP BY 1)
    SELECT window_start, round(value, 4) AS value, count(*) FILTER (value > 100) OVER (ORDER BY window_start RANGE BETWEEN INTERVAL 2 MINUTE PRECEDING AND CURRENT ROW) = 3 AS firing FROM a"""
)
def sliding_alert(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.sliding_alert(table(spark, d, "events"), F.sum("value"), 100.0)
    return out.withColumn("value", F.round("value", 4))


# --- governance -------------------------------------------------------------------------


@query(
    """SELECT count(*) AS total_rows, count(DISTINCT source) AS distinct_sources, max(doc_id) AS max_id,
    CAST(coalesce(sum(CASE WHEN source IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS null_sources,
    CAST(coalesce(sum(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS blank_contents FROM documents"""
)
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    return governance.table_stats(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content")))


INVENTORY = """SELECT case_id, chunks, sources, oldest, newest, case_id = '3-MEDIUM' AS legal_hold,
  CAST(floor((epoch(TIMESTAMP '1999-01-01') - epoch(oldest)) / -86400.0 + days) AS BIGINT) AS days_left,
  floor((epoch(TIMESTAMP '1999-01-01') - epoch(oldest)) / -86400.0 + days) <= 0 AS expired
  FROM (SELECT o_orderpriority AS case_id, count(*) AS chunks, count(DISTINCT o_orderstatus) AS sources, min(o_orderdate) AS oldest, max(o_orderdate) AS newest,
    CASE o_orderpriority WHEN '1-URGENT' THEN 3000 ELSE 365 END AS days FROM orders GROUP BY 1)"""


@query(INVENTORY)
def data_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("case_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("effective_date")
    )
    policies = spark.createDataFrame([("1-URGENT", 3000, False), ("3-MEDIUM", None, True)], "case_id string, retention_days int, legal_hold boolean")
    return governance.data_inventory(rows, policies, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))


@query(
    f"""SELECT count(*) AS checked, CAST(sum(expired::INT) AS BIGINT) AS expired, CAST(sum((expired AND NOT legal_hold)::INT) AS BIGINT) AS deleted,
    CAST(sum((expired AND legal_hold)::INT) AS BIGINT) AS held FROM ({INVENTORY})"""
)
def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    return governance.retention_sweep(data_inventory(spark, d))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def audit_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type, CAST(ts AS DATE)), (event_type), ())")
def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return rows.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


@query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return governance.recent_events(table(spark, d, "events"), 100, "click").select("event_id", "event_type", "ts")


EVENT_KEY = "substr(sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d %H:%M')), 1, 32)"


@query(f"SELECT {EVENT_KEY} AS event_key, min(event_id) AS event_id FROM events GROUP BY 1")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = governance.event_key(F.col("event_type"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm"))
    rows = table(spark, d, "events").withColumn("event_key", key)
    return governance.first_of_key(rows, "event_key", F.asc("event_id")).select("event_key", "event_id")


@query("SELECT event_id, substr(sha256(event_type || '|' || user_id || '|' || coalesce(props, '')), 1, 32) AS event_key, sha256(coalesce(props, '')) AS props_hash FROM events")
def stable_hash(spark: SparkSession, d: str) -> DataFrame:
    props = F.coalesce("props", F.lit(""))
    return table(spark, d, "events").select(
        "event_id", governance.event_key(F.col("event_type"), F.col("user_id").cast("string"), props).alias("event_key"), F.sha2(props, 256).alias("props_hash")
    )


REVIEWS = """reviews AS (SELECT event_id AS review_id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'edited' WHEN 3 THEN 'rejected' ELSE 'escalated' END AS status,
  ts AS created_at, ts + INTERVAL 1 MINUTE * (event_id % 60) AS reviewed_at, value AS confidence FROM events)"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("pending", "approved", "edited", "rejected", "escalated")])
    return table(spark, d, "events").select(
        F.col("event_id").alias("review_id"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("status"), F.col("ts").alias("created_at"),
        F.expr("ts + make_dt_interval(0, 0, cast(event_id % 60 as int), 0)").alias("reviewed_at"), F.col("value").alias("confidence"),
    )


@query(
    f"""WITH {REVIEWS} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
    count(*) FILTER (status = 'edited') AS edited, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'escalated') AS escalated,
    round(count(*) FILTER (status IN ('approved', 'edited'))::DOUBLE / greatest(count(*) FILTER (status <> 'pending'), 1), 4) AS approval_rate,
    round(avg((epoch_us(reviewed_at) - epoch_us(created_at)) / 1e6) FILTER (status <> 'pending'), 1) AS mean_latency_seconds FROM reviews"""
)
def review_queue_metrics(spark: SparkSession, d: str) -> DataFrame:
    return governance.review_metrics(reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT review_id, confidence FROM reviews WHERE status = 'pending' ORDER BY confidence, review_id LIMIT 50")
def pending_list(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).where("status = 'pending'").orderBy("confidence", "review_id").limit(50).select("review_id", "confidence")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def feedback_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return governance.latest(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    f"""WITH {MAILS} SELECT message_id AS card, count(*) AS chunks, md5(left(string_agg(content, E'\\n\\n' ORDER BY chunk_index, id), 5000)) AS content_md5 FROM mails GROUP BY message_id"""
)
def document_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = mails(spark, d).withColumn("email_subject", F.lit(None).cast("string"))
    return governance.document_cards(rows).select("card", "chunks", F.md5("content").alias("content_md5"))


@query(
    """SELECT l_orderkey // 1000 AS file, CAST(n // 50 AS BIGINT) AS batch, count(*) AS n_rows, md5(string_agg(l_orderkey || ' | ' || l_linenumber || ' | ' || l_returnflag, E'\\n' ORDER BY n)) AS text_md5
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, l_linenumber, l_returnflag) - 1 AS n FROM lineitem) GROUP BY ALL"""
)
def csv_batching(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, d, "lineitem").withColumn("file", F.floor(F.col("l_orderkey") / 1000))
    n = F.row_number().over(Window.partitionBy("file").orderBy("l_orderkey", "l_linenumber", "l_returnflag")) - 1
    line = F.concat_ws(" | ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag")
    batches = rows.select("file", n.alias("n"), line.alias("line")).groupBy("file", F.floor(F.col("n") / 50).alias("batch")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("r")
    )
    return batches.select("file", "batch", "n_rows", F.md5(F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text_md5"))


@query(
    r"""SELECT o_orderkey, concat_ws(E'\n', 'Subject: ' || o_orderpriority, 'From: ' || c_name, 'Date: ' || strftime(o_orderdate, '%Y-%m-%d'),
      CASE WHEN o_orderstatus <> 'O' THEN 'Importance: ' || o_orderstatus END) AS text FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def ediscovery_text(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    line = lambda label, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(label + ": "), c))
    importance = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    parts = [line("Subject", F.col("o_orderpriority")), line("From", F.col("c_name")), line("Date", F.date_format("o_orderdate", "yyyy-MM-dd")), line("Importance", importance)]
    return rows.select("o_orderkey", F.concat_ws("\n", *parts).alias("text"))


INTENT = f"""CASE WHEN regexp_matches(q, '{P.TIMELINE}') THEN 'timeline' WHEN regexp_matches(q, '{P.COMPARISON}') THEN 'comparison'
  WHEN regexp_matches(q, '{P.SUMMARY}') THEN 'summary' WHEN regexp_matches(q, '{P.FACT}') THEN 'fact_lookup' ELSE 'exploratory' END"""
ASKED = """asked AS (SELECT item_id, lower(CASE item_id % 6 WHEN 0 THEN 'When did ' WHEN 1 THEN 'Compare ' WHEN 2 THEN 'Summarize ' WHEN 3 THEN 'How many ' WHEN 4 THEN 'What happened to '
  ELSE '' END || text) AS q FROM benchmark)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.lit(s) for s in ("When did ", "Compare ", "Summarize ", "How many ", "What happened to ", "")])
    head = F.get(heads, (F.col("item_id") % 6).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.concat(head, F.col("text")).alias("q"))


@query(f"WITH {ASKED} SELECT item_id, {INTENT} AS intent FROM asked")
def intent_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("item_id", T.intent(F.col("q")).alias("intent"))


@query(
    f"""WITH {ASKED}, i AS (SELECT item_id, {INTENT} AS intent FROM asked)
    SELECT item_id, intent, CASE WHEN intent = 'exploratory' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence, top_k::INT AS top_k, sw::DOUBLE AS semantic_weight, kw::DOUBLE AS keyword_weight
    FROM i JOIN (VALUES {', '.join(f"('{k}', {v[0]}, {v[1]}, {v[2]})" for k, v in T.INTENTS.items())}) p(intent, top_k, sw, kw) USING (intent)"""
)
def intent_params(spark: SparkSession, d: str) -> DataFrame:
    params = spark.createDataFrame([(k, *v[:3]) for k, v in T.INTENTS.items()], "intent string, top_k int, semantic_weight double, keyword_weight double")
    rows = asked(spark, d).select("item_id", T.intent(F.col("q")).alias("intent")).withColumn("confidence", T.intent_confidence(F.col("intent")))
    return rows.join(F.broadcast(params), "intent").select("item_id", "intent", "confidence", "top_k", "semantic_weight", "keyword_weight")


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey"""
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("version", F.struct("o_orderdate", "o_orderkey"))
    old, new = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    return governance.upsert(old, new, ["o_custkey"], "version").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey, true AS conflict_refused FROM orders")
def unique_insert_check(spark: SparkSession, d: str) -> DataFrame:
    """Orders inserted into others, after an insert with keys that are there has been refused."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    old, new = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    try:
        governance.unique_insert(old, orders, ["o_orderkey"])
        refused = False
    except ValueError:
        refused = True
    return governance.unique_insert(old, new, ["o_orderkey"]).withColumn("conflict_refused", F.lit(refused))


SQL_TEXT = """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey)
  SELECT n_name, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, round(sum(total), 2) AS total
  FROM customer JOIN o ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"""


@query(SQL_TEXT)
def readonly_sql_query(spark: SparkSession, d: str) -> DataFrame:
    views = {n: table(spark, d, n) for n in ("orders", "customer", "nation")}
    return readonly_sql.run(spark, views, SQL_TEXT, 1000)


@query(
    r"""SELECT item_id, list_aggregate(list_sort(list_distinct([item_id % 5 + 1, 7, 8, 9])), 'string_agg', ',') AS pages FROM benchmark"""
)
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat((F.col("item_id") % 5 + 1).cast("string"), F.lit(", 7-9, x, 8"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.page_ranges(text), ",").alias("pages"))


@query(
    """SELECT DISTINCT replace(replace(lower(split_part(source || '/' || lang, '/', 1)), '_', '-'), ' ', '-') AS case_id FROM documents
    WHERE source NOT IN ('src0', 'src1')"""
)
def case_discovery(spark: SparkSession, d: str) -> DataFrame:
    from caseloom.sources.tables import discover_cases

    paths = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path"))
    known = spark.createDataFrame([("src0",), ("src1",)], "case_id string")
    return discover_cases(paths, known).select("case_id")


@query(
    f"""WITH {MAILS} SELECT id, CASE WHEN chunk_index % 2 = 0 THEN 'm' || id || '@caseloom' ELSE 'gen-' || substr(sha256(left(
      CASE WHEN chunk_index % 3 = 0 THEN '' ELSE 'In-Reply-To: <t' || message_id || '@caseloom>' || chr(10) END || content, 500)), 1, 16) END AS message_key,
    CASE WHEN chunk_index % 3 = 0 THEN '' ELSE 't' || message_id || '@caseloom' END AS thread_key FROM mails"""
)
def message_thread_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of mails: every second one has its own, two in three say what they answer."""
    own = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("Message-ID: <m"), F.col("id").cast("string"), F.lit("@caseloom>\n"))).otherwise("")
    thread = F.when(F.col("chunk_index") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("In-Reply-To: <t"), F.col("message_id"), F.lit("@caseloom>\n")))
    c = F.concat(own, thread, F.col("content"))
    return mails(spark, d).select("id", T.message_id(c).alias("message_key"), T.thread_id(c).alias("thread_key"))


@query()
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", hash_embedding(F.col("text"), 64).alias("embedding"))


@query()
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(
        F.col("event_type").alias("upstream"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 != 0).alias("ok")
    )
    return streams.breaker_batch(calls)


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, count(*) > 30 AS limited FROM events GROUP BY ALL")
def request_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("hour"), "n", (F.col("n") > 30).alias("limited"))


@query(
    r"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) AS token FROM documents WHERE length(text) >= 20),
    tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    r AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln((SELECT count(*) FROM documents WHERE length(text) >= 20)::DOUBLE / df), 9) DESC, token) AS r FROM tf JOIN df USING (token))
    SELECT id, string_agg(token, ',' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY id"""
)
def keyword_enrichment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return enrichment.keywords(rows).select("id", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 250 AS p_partkey, EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l_partkey % 250) AS is_valid FROM lineitem")
def claim_verification(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 250).alias("p_partkey"))
    return enrichment.verify_claims(claims, table(spark, d, "part"), ["p_partkey"]).select("l_orderkey", "l_linenumber", "p_partkey", "is_valid")


@query("SELECT event_type, min(event_id) AS first_kept, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500) GROUP BY event_type")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"))
    kept = metrics.last_observations(rows, 500)
    return kept.groupBy(F.col("name").alias("event_type")).agg(F.min("seq").alias("first_kept"), F.count(F.lit(1)).alias("n"))


@query()
def agent_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return agent.answer(chunks(spark, d), questions(spark, d))


# --- spans, ids, reports ----------------------------------------------------------------


def _spans_sql(c: str, pattern: str, extra: str = "") -> str:
    """SQL list of (start, end, value) of matches: lengths of the parts between them, added up."""
    p = pattern.replace("'", "''")
    return (
        f"list_transform(regexp_extract_all({c}, '{p}'), lambda m, i: struct_pack(s := coalesce(list_sum(list_transform("
        f"string_split_regex({c}, '{p}')[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(regexp_extract_all({c}, '{p}')[1:i - 1],"
        f" lambda y: length(y))), 0), m := m{extra}))"
    )


PII_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, '{name}' AS pii_type, unnest({_spans_sql('text', pattern)}) AS x FROM documents"
    for n, (name, pattern, _) in enumerate(P.PII)
)


@query(
    f"""WITH f AS (SELECT doc_id, n, pii_type, CAST(x.s AS INTEGER) AS span_start, CAST(x.s + length(x.m) AS INTEGER) AS span_end, x.m AS value FROM ({PII_SPANS}))
    SELECT doc_id, span_start, span_end, pii_type, value FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, span_start, span_end ORDER BY n) = 1"""
)
def pii_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.pii_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.pii_type", "s.value")


@query(
    f"""WITH {ANSWERS}, c AS (SELECT doc_id, answer, unnest({_spans_sql('answer', P.CITATION)}) AS x FROM answers)
    SELECT doc_id, trim(regexp_extract(x.m, '{P.CITATION}', 1)) AS cited, regexp_replace(regexp_replace(
      substr(answer, CAST(greatest(x.s - 60, 0) + 1 AS BIGINT), CAST(x.s + length(x.m) + 60 - greatest(x.s - 60, 0) AS BIGINT)), '^\\s+', ''), '\\s+$', '') AS context FROM c"""
)
def citation_context(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).select("doc_id", F.explode(T.citation_contexts(F.col("answer"))).alias("c"))
    return rows.select("doc_id", F.col("c.source").alias("cited"), "c.context")


@query(
    f"""WITH {ANSWERS}, c AS (SELECT unnest(regexp_extract_all(answer, '{P.CITATION}', 1)) AS cited, unnest(regexp_extract_all(answer, '{P.CITATION}', 2)) AS page FROM answers)
    SELECT trim(cited) AS source, coalesce(string_agg(DISTINCT nullif(page, '')), '') AS pages FROM c GROUP BY 1"""
)
def cited_page_sets(spark: SparkSession, d: str) -> DataFrame:
    return grounding.cited_pages(answers(spark, d)).select("source", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("SELECT item_id, substr(sha256(text), 1, 16) AS query_hash FROM benchmark")
def query_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.query_hash(F.col("text")).alias("query_hash"))


@query(
    r"""SELECT p_partkey, regexp_matches(f, '^[\p{L}\p{N}_\-. ]+$') AS safe FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '.txt' WHEN 1 THEN '../' || p_name ELSE p_name || ':' END AS f FROM part)"""
)
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    name = F.when(n == 0, F.concat("p_name", F.lit(".txt"))).when(n == 1, F.concat(F.lit("../"), "p_name")).otherwise(F.concat("p_name", F.lit(":")))
    return table(spark, d, "part").select("p_partkey", T.is_safe_filename(name).alias("safe"))


@query(
    f"""WITH {MAILS} SELECT id, CASE WHEN id % 3 = 0 THEN '<' || id || '@x>' WHEN id % 3 = 1 THEN 'E' || id
      ELSE sha256('mails|' || content || '|' || email_from || '||' || chunk_index) END AS item_id FROM mails"""
)
def mail_item_ids(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("id").cast("string")
    internet = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" <"), number, F.lit("@x> "))).otherwise(F.lit(" "))
    entry = F.when(F.col("id") % 3 == 1, F.concat(F.lit("E"), number))
    none = F.lit(None).cast("string")
    return mails(spark, d).select(
        "id", T.mail_item_id(internet, entry, F.lit("mails"), F.col("content"), F.col("email_from"), none, F.col("chunk_index")).alias("item_id")
    )


@query(
    f"""WITH {ASKED}, i AS (SELECT item_id, {INTENT} AS intent FROM asked), c AS (SELECT *, (item_id % 10 / 10.0)::DOUBLE AS confidence FROM i)
    SELECT item_id, CASE WHEN confidence >= 0.8 THEN 5 ELSE top_k END::INT AS top_k FROM c
    JOIN (VALUES {', '.join(f"('{k}', {v[0]})" for k, v in T.INTENTS.items())}) p(intent, top_k) USING (intent)"""
)
def routed_params(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(*[F.lit(x) for k, v in T.INTENTS.items() for x in (k, v[0])])
    rows = asked(spark, d).select("item_id", T.intent(F.col("q")).alias("intent"))
    sure = (F.col("item_id") % 10).cast("int") / F.lit(10.0)
    return rows.select("item_id", T.routed_top_k(params[F.col("intent")], sure, F.lit(5)).alias("top_k"))


@query(
    """SELECT doc_id, round(c, 2)::DOUBLE AS confidence, c < 0.65 AS flagged FROM (SELECT doc_id,
      CASE WHEN doc_id % 3 = 0 THEN 0.85 WHEN doc_id % 3 = 1 THEN 0.55 ELSE 0.3 END - CASE WHEN toxic = 1 THEN 0.15 ELSE 0 END AS c FROM labels)"""
)
def review_flags(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 0, "pass").when(F.col("doc_id") % 3 == 1, "partial").otherwise("fail")
    confidence = F.round(grounding.review_confidence(status, F.col("toxic") == 1), 2)
    return table(spark, d, "labels").select("doc_id", confidence.alias("confidence"), grounding.needs_review(confidence).alias("flagged"))


@query("SELECT lang AS case_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def inventory_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("lang").alias("case_id"), "source")
    return governance.source_lists(rows).select("case_id", F.array_join("sources", ",").alias("sources"))


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n_docs FROM conversations GROUP BY conv_id")
def saved_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("docs"))
    return governance.set_sizes(sets).select("conv_id", "n_docs")


@query(
    """WITH r AS (SELECT doc_id % 4 AS loops, quality, toxic, doc_id % 7 / 10.0 AS x, doc_id % 3 AS truth FROM labels)
    SELECT count(*) AS questions, count(*) FILTER (truth > 0) AS with_truth, round(avg(quality), 3) AS avg_faithfulness, round(avg(toxic), 3) AS avg_relevance,
      round(avg(x), 3)::DOUBLE AS avg_citation_precision, round(avg(x), 3)::DOUBLE AS avg_unsupported_rate, round(avg(CASE WHEN loops > 1 THEN 1.0 ELSE 0.5 END), 3)::DOUBLE AS avg_coverage,
      round(avg(x) FILTER (truth > 0), 3)::DOUBLE AS avg_precision_at_k, round(avg(x) FILTER (truth > 0), 3)::DOUBLE AS avg_recall_at_k,
      round(avg(x) FILTER (truth > 0), 3)::DOUBLE AS avg_reciprocal_rank, round(avg(loops), 2) AS avg_seconds, round(avg(loops * 100), 0) AS avg_answer_length,
      round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS grader_pass_rate, round(avg(CASE WHEN loops > 0 THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS rewrite_rate,
      CAST(sum(toxic) AS BIGINT) AS total_warnings, CAST(sum(loops) AS BIGINT) AS total_stitched FROM r"""
)
def eval_full_report(spark: SparkSession, d: str) -> DataFrame:
    x, loops = (F.col("doc_id") % 7).cast("double") / 10.0, F.col("doc_id") % 4
    doc = lambda known: F.struct(known.alias("email_from"), F.lit("").alias("email_subject"), F.lit(None).cast("string").alias("message_id"))
    docs = F.array(doc(F.lit("a@x")), doc(F.when(loops > 1, "b@x").otherwise("")))
    rows = table(spark, d, "labels").select(
        F.col("quality").alias("faithfulness"), F.col("toxic").alias("relevance"),
        F.array_repeat(F.lit("r"), (F.col("doc_id") % 3).cast("int")).alias("relevant"),
        *[x.alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank", "citation_precision", "unsupported_rate")],
        loops.alias("seconds"), (loops * 100).alias("answer_length"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("grade"),
        loops.alias("loops"), F.col("toxic").alias("warnings"), loops.alias("stitched"), evaluation.metadata_coverage(docs).alias("coverage"),
    )
    return evaluation.full_report(rows)
