from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import chunking, evaluation, governance, grounding, metrics, retrieval
from caseloom.plans import agent, keyword, readonly_sql
from caseloom.plans.cache import Cache, key_for


# --- chunking ---------------------------------------------------------------------------


def segs(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return [(s["type"], s["content"]) for s in df.select(chunking.segments(F.col("t")).alias("s")).first()["s"]]


def test_segments(spark):
    text = "# Top\n\nA para.\n\n- a\n- b\n\nBefore [TABLE]\nx | y\n\nz\n[/TABLE] after\n\nFrom: a\nTo: b"
    assert segs(spark, text) == [
        ("heading", "# Top"), ("paragraph", "A para."), ("list", "- a\n- b"), ("paragraph", "Before"),
        ("table", "[TABLE]\nx | y\n\nz\n[/TABLE]"), ("paragraph", "after"), ("email_header", "From: a\nTo: b"),
    ]
    assert segs(spark, "  ") == [("text", "  ")]


def plain_assemble(parts, size, overlap):
    """Reference loop in Python."""
    out, open_, n = [], [], 0

    def join():
        return "\n\n".join(p for p in open_ if p.strip())

    for kind, text in parts:
        if n and kind in ("heading", "email_header"):
            out.append(join())
            tail = join()[-overlap:] if kind == "heading" and overlap else ""
            open_, n = ([tail], len(tail)) if tail else ([], 0)
        if n and n + len(text) + 2 > size:
            out.append(join())
            tail = join()[-overlap:] if overlap else ""
            open_, n = ([tail], len(tail)) if tail else ([], 0)
        open_ = [*open_, text]
        n += len(text) + 2
    return out + ([join()] if join().strip() else [])


@pytest.mark.parametrize(("size", "overlap"), [(60, 0), (60, 20), (25, 10), (1000, 200)])
def test_assemble_equals_a_plain_loop(spark, size, overlap):
    rng = random.Random(size)
    for _ in range(4):
        parts = [(rng.choice(["heading", "paragraph", "paragraph", "email_header", "list"]), "w" * rng.randint(1, 40)) for _ in range(12)]
        df = spark.createDataFrame([([(k, c, None, len(c)) for k, c in parts],)], f"s {chunking.SEGMENT}")
        got = df.select(chunking.assemble(F.col("s"), F.lit(size), overlap).alias("c")).first()["c"]
        assert got == plain_assemble(parts, size, overlap)


def test_chunk_documents(spark):
    text = "TITLE LINE\n\n" + "\n\n".join("word " * 60 for _ in range(10))
    df = spark.createDataFrame([(1, text), (2, "tiny")], "id long, content string")
    rows = chunking.chunk_documents(df, base_size=700).orderBy("id", "chunk_index").collect()
    assert [r["chunk_index"] for r in rows if r["id"] == 1] == list(range(rows[0]["total_chunks"])) and len(rows) > 3
    assert rows[-1]["content"] == "tiny" and rows[0]["chunk_type"] == "heading"


def test_email_segments():
    text = "From: a\nTo: b\n\nHello\n\n- x\n- y\n\nOn Monday the 3rd of May, Jo wrote:\n\n> old\n\nNew text\n\nBest regards\n\nJo"
    assert chunking.email_segments(text) == [
        ("email_header", "From: a\nTo: b"), ("email_body", "Hello"), ("list", "- x\n- y"),
        ("quoted_reply", "On Monday the 3rd of May, Jo wrote:\n\n> old"), ("email_body", "New text"), ("signature", "Best regards\n\nJo"),
    ]
    assert chunking.email_segments("") == []


def test_recursive_split():
    text = "\n\n".join(" ".join("w" * 7 for _ in range(30)) for _ in range(6)) + "z" * 500
    parts = chunking.split_recursively(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and "".join(parts).count("z") >= 500
    assert chunking.split_recursively("abc", 10, 2) == ["abc"]


# --- retrieval --------------------------------------------------------------------------


@pytest.fixture
def mails(spark):
    rows = [(10 * m + i, str(m), i, "c") for m in range(3) for i in range(4)] + [(99, None, 0, "c")]
    return spark.createDataFrame(rows, "id long, message_id string, chunk_index int, content string")


def test_stitching(spark, mails):
    hits = mails.where("id in (1, 2, 20, 99)").withColumn("query_id", F.lit(1))
    got = {(r["id"], r["stitched"]) for r in retrieval.stitch_neighbours(hits, mails, 1).collect()}
    assert got == {(1, False), (2, False), (20, False), (99, False), (0, True), (3, True), (21, True)}
    got = {(r["id"], r["is_sibling"]) for r in retrieval.complete_siblings(hits, mails).collect()}
    assert {i for i, new in got if new} == {0, 3, 21, 22, 23}


def test_fusion(spark):
    s = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")
    k = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, id long, rank int")
    got = [(r["id"], r["rrf_score"]) for r in retrieval.fuse(s, k, 2).orderBy("rank").collect()]
    assert got == [(8, pytest.approx(0.7 / 62 + 0.3 / 61)), (7, pytest.approx(0.7 / 61))]


def test_filters(spark, mails):
    assert retrieval.apply_filters(mails, {"message_id": "1", "chunk_index_from": 1, "chunk_index_to": 2}).count() == 2
    assert retrieval.apply_filters(mails, {"content_contains": "C", "message_id": None}).count() == 13
    with pytest.raises(ValueError):
        retrieval.apply_filters(mails, {"nope": 1})
    assert retrieval.merge_filters({"a": 1, "b": 2}, {"a": 3}) == {"a": 3, "b": 2}
    with pytest.raises(ValueError):
        retrieval.CaseScope("")


def test_merge_dedup_and_boost(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, None, 3), (1, None, 4)], "query_id long, id long, n int")
    assert sorted(r["n"] for r in retrieval.merge_dedup(df, F.asc("n")).collect()) == [1, 3, 4]
    args = [F.lit(x) for x in ("mail from Müller on 2024-01-15", "müller@x.org", None, None, "mail", "on 2024-01-15 it")]
    got = spark.range(1).select(retrieval.metadata_boost(*args).alias("b")).first()["b"]
    assert got == pytest.approx(0.15 + 0.075 + 0.15)


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 9.0), (1, 2, 0.7, 1.0)], "query_id long, id long, boosted_score double, other double")
    assert [r["id"] for r in retrieval.rerank(df).orderBy("rank").collect()] == [2, 1]
    rows = retrieval.rerank(df, lambda d: F.col("other"), 1).collect()
    assert [(r["id"], r["original_rank"]) for r in rows] == [(1, 1)]


# --- grounding and evaluation -----------------------------------------------------------


@pytest.mark.parametrize(
    ("cited", "invalid", "sev", "facts", "weak", "score", "decision", "n_flags"),
    [
        (8, 8, ["critical"] * 2, 2, 2, 1.0, "block", 3), (0, 0, [], 0, 0, 0.0, "pass", 0), (8, 3, [], 0, 0, 0.35 * 3 / 8, "pass", 1),
        (4, 4, ["minor"], 0, 0, 0.35 + 0.105, "warn", 2), (1, 0, ["critical", "minor"], 4, 1, 0.35 * 0.65 + 0.075, "pass", 2),
    ],
)
def test_risk(spark, cited, invalid, sev, facts, weak, score, decision, n_flags):
    df = spark.createDataFrame([(cited, invalid, sev, facts, weak)], "c int, i int, s array<string>, f int, w int")
    args = [F.col(x) for x in "cisfw"]
    r = df.select(
        grounding.risk_score(*args).alias("score"), grounding.risk_decision(grounding.risk_score(*args)).alias("d"), grounding.risk_flags(*args).alias("flags")
    ).first()
    assert r["score"] == pytest.approx(score) and r["d"] == decision and len(r["flags"]) == n_flags


def test_routes_and_status(spark):
    df = spark.createDataFrame([("yes", 0), ("no", 0), ("no", 2), ("no", 3)], "g string, n int")
    assert [r[0] for r in df.select(grounding.route(F.col("g"), F.col("n"))).collect()] == ["validator", "rewriter", "rewriter", "validator"]
    df = spark.createDataFrame([(0, 0, 0), (2, 2, 0), (2, 1, 0), (2, 0, 0), (2, 2, 1)], "t int, v int, w int")
    got = [r[0] for r in df.select(grounding.validation_status(F.col("t"), F.col("v"), F.col("w"))).collect()]
    assert got == ["pass", "pass", "partial", "fail", "partial"]


@pytest.mark.parametrize(
    ("retrieved", "relevant", "k", "p", "r", "rr"),
    [(["a", "x", "b", "y"], ["a", "b"], 4, 0.5, 1.0, 1.0), (["x", "y", "a"], ["a", "b"], 2, 0.0, 0.0, 1 / 3), ([], ["a"], 3, 0.0, 0.0, 0.0), (["a", "a"], ["a"], 2, 1.0, 1.0, 1.0), (["a"], [], 1, 0.0, 0.0, 0.0)],
)
def test_ranking_metrics(spark, retrieved, relevant, k, p, r, rr):
    df = spark.createDataFrame([(retrieved, relevant)], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(evaluation.precision_at_k(a, b, k), evaluation.recall_at_k(a, b, k), evaluation.reciprocal_rank(a, b)).first()
    assert list(got) == pytest.approx([p, r, rr])


def test_supported_facts(spark):
    claims = spark.createDataFrame([(1, "It cost $1,000 in 2024-01-15")], "claim_id long, claim string")
    docs = spark.createDataFrame([(1, "paid 1000"), (2, "total 1,000 usd"), (3, None)], "doc_id long, content string")
    got = {r["value"]: (r["supporting_docs"], r["is_sufficiently_supported"]) for r in grounding.supported_facts(claims, docs).collect()}
    assert got == {"$1,000": (2, True), "2024-01-15": (0, False)}


# --- metrics and governance -------------------------------------------------------------


def test_histogram(spark):
    df = spark.createDataFrame([("m", i, float(i)) for i in range(1, 6)] + [("n", i, float(i)) for i in range(1500)], "name string, seq long, value double")
    got = {r["name"]: r for r in metrics.histogram_summary(df).collect()}
    assert (got["m"]["mean"], got["m"]["max"], got["m"]["p50"], got["m"]["p95"]) == (3.0, 5.0, 3.0, 5.0)
    assert got["n"]["n"] == 1000 and got["n"]["p95"] == 1450.0


def test_service_levels(spark):
    summary = spark.createDataFrame([("node_latency.a", 1, 0.0, 0.0, 11.0, 12.0, 12.0), ("http_request_seconds.query", 1, 0.0, 0.0, 31.0, 44.0, 50.0)], "name string, n long, mean double, p50 double, p95 double, p99 double, max double")
    assert {r["metric"] for r in metrics.latency_violations(summary).collect()} == {"node_latency.a.p95", "http_request_seconds.query.p95"}
    counters = spark.createDataFrame([("node_invocations.retriever", 100), ("llm_call_failure.x", 3), ("Timeout.y", 1)], "name string, value long")
    assert [(r["metric"], r["actual"]) for r in metrics.rate_violations(counters).collect()] == [("error_rate", 0.03)]
    report = spark.createDataFrame([(0.5, 0.9)], "avg_recall_at_k double, avg_mrr double")
    assert [r["metric"] for r in metrics.quality_violations(report).collect()] == ["avg_recall_at_k"]
    costs = spark.createDataFrame([(0.1,), (0.3,)], "cost double")
    assert metrics.cost_violations(costs).count() == 1


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, n int")
    assert sorted(r["v"] for r in governance.upsert(old, new, ["k"], "n").collect()) == ["a", "c", "d"]
    with pytest.raises(ValueError):
        governance.unique_insert(old, new, ["k"])
    kept, n = governance.delete_where(old, F.col("k") == 1)
    assert (kept.count(), n) == (1, 1)
    with pytest.raises(PermissionError):
        governance.delete_where(old, F.lit(True), legal_hold=True)


def test_reviews(spark):
    items = spark.createDataFrame([(1, "pending", "x", None), (2, "approved", "y", None)], "review_id long, status string, answer string, edited_answer string")
    decisions = spark.createDataFrame([(1, "edited", "z"), (2, "rejected", "q"), (3, "approved", "")], "review_id long, new_status string, edited_answer string")
    out = governance.transition(items, decisions)
    assert {r["review_id"]: r["status"] for r in out.collect()} == {1: "edited", 2: "approved"}
    assert {r["review_id"]: r["answer"] for r in governance.feedback_export(out).collect()} == {1: "z", 2: "y"}


# --- plans ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "sql",
    [
        "select * from secret", "select * from t, secret", "select * from parquet.`{path}`", "select * from default.secret",
        "select (select max(id) from secret) from t", "select (select max(id) from parquet.`{path}`) from t",
        "select * from t where id in (select id from secret)", "select * from t where exists (select 1 from secret)",
        "select * from t join lateral (select * from secret)", "with secret as (select * from secret) select * from secret",
        "select * from (with secret as (select 1 z) select * from secret) join secret", "select * from identifier('secret')",
        "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'getProperty', 'x') from t",
        "select try_reflect('java.lang.System', 'getProperty', 'x')", "select identifier('java_method')('java.lang.System', 'gc')",
        "select transform(id) using 'cat' from t", "select own_udf() from t", "select input_file_name() from t", "select 1; select 2",
        "explain select * from secret", "insert into t select 1", "with x as (insert into t select 1) select 1", "select * from global_temp.t",
    ],
)
def test_sql_guard_refuses(spark, tmp_path, sql):
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "other"))
    spark.udf.register("own_udf", lambda: "1")
    with pytest.raises(readonly_sql.NotReadOnly):
        readonly_sql.run(spark, {"t": spark.range(5)}, sql.format(path=tmp_path / "other"))


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("select id % 2 b, count(*) n from t group by 1 having count(*) > 0 order by n limit 9", 2), ("select * from t union all select 7", 6),
        ("with x as (select * from t) select x.id, (select max(id) from t) m from x join t on x.id = t.id where x.id in (select id from t)", 5),
        ("select row_number() over (partition by id order by id) from t /* drop */ -- insert", 5), ("select 'a -- b; /* c' as `from` from T", 5),
        ("select * from (values (1), (2)) v(z) lateral view explode(array(1, 2)) e as k", 4), ("select * from range(3)", 3),
        ("select transform(array(id), x -> x + 1) from t", 5), ("explain select * from t", 1),
    ],
)
def test_sql_guard_allows(spark, sql, rows):
    assert len(readonly_sql.run(spark, {"t": spark.range(5)}, sql).collect()) == rows


def test_sql_runs_in_its_own_session(spark):
    spark.range(9).createOrReplaceTempView("t")
    assert readonly_sql.run(spark, {"t": spark.range(5)}, "select * from t").count() == 5
    assert spark.table("t").count() == 9


def test_readonly_sql(spark):
    views = {"t": spark.range(5)}
    assert readonly_sql.run(spark, views, "select id from t where 'drop' <> 'do' -- x", 3).count() == 3
    assert readonly_sql.run(spark, views, "with a as (select * from t) select count(*) c from a").first()["c"] == 5
    for bad in ("drop table t", "insert into t values (1)", "select 1; select 2", "set a=b", "", "with a as (select 1) insert into t select * from a", "explain drop table t"):
        with pytest.raises(readonly_sql.NotReadOnly):
            readonly_sql.validate(spark, bad)
    with pytest.raises(readonly_sql.NotReadOnly):
        readonly_sql.validate(spark, "select 'drop' from t", compatible=True)


def test_cache():
    now = [0.0]
    c = Cache(2, ttl=10, clock=lambda: now[0])
    c.set("a", 1)
    c.set("b", 2)
    assert c.get("a") == (True, 1)
    c.set("c", 3)
    assert c.get("b") == (False, None) and c.get("a")[0]
    now[0] = 11
    assert c.get("a") == (False, None)
    assert c.invalidate_prefix("c") == 1 and c.stats()["entries"] == 0
    assert key_for("ns", {"b": 1, "a": 2}) == key_for("ns", {"a": 2, "b": 1})


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopefulness", "hope"), ("agreed", "agre"), ("happy", "happi"), ("formalize", "formal")])
def test_stems(word, want):
    assert keyword.stem(word) == want


def test_query_grammar_and_density():
    index: dict[str, list[int]] = {}
    for s, p in keyword.lexemes("the safety report of the plant and safety plant report"):
        index.setdefault(s, []).append(p)
    hit = lambda q: any(keyword.matches(c, index) for c in keyword.parse(q))
    assert hit("safety plants") and hit('"safety report"') and not hit('"report safety"') and not hit("safety -report")
    assert hit("missing or plant") and not hit("-plant") and keyword.parse("the of") == []
    near = keyword.cover_density({"a": [1], "b": [2]}, {"a", "b"})
    far = keyword.cover_density({"a": [1], "b": [9]}, {"a", "b"})
    assert near == pytest.approx(0.1) and far < near


def test_agent(spark):
    chunks = spark.createDataFrame([(i, f"The pump number {i} failed. It was old.", [float(i), 1.0], f"f{i}.pdf") for i in range(6)], "id long, content string, embedding array<double>, source string")
    queries = spark.createDataFrame([(1, "Which pump failed", [1.0, 1.0]), (2, "zzz qqq xxx", [0.0, 1.0])], "query_id long, query string, query_embedding array<double>")
    got = {r["query_id"]: r for r in agent.answer(chunks, queries, top_k=3).collect()}
    assert got[1]["grade"] == "yes" and got[1]["loops"] == 0 and got[1]["grounding"] == "grounded"
    assert got[2]["grade"] == "no" and got[2]["loops"] == 3 and len(got) == 2


def test_enrichment(spark):
    from caseloom.operators import enrichment

    df = spark.createDataFrame([(1, "alpha alpha beta gamma words here", None), (2, "beta gamma words here and more", None), (3, "tiny", None)], "id long, content string, metadata_extra map<string,string>")
    got = {r["id"]: r for r in enrichment.enrich(df, 2).collect()}
    assert got[1]["metadata_extra"]["keywords"].startswith("alpha") and "Keywords: alpha" in got[1]["content"]
    assert got[3]["content"] == "tiny"
    calls = []

    def model():
        return lambda texts: [[len(t), 1.0] for t in texts]

    vectors = {r["id"]: r["embedding"] for r in enrichment.embed(df, model=model).collect()}
    assert vectors[3] == [4.0, 1.0] and not calls
    assert len(enrichment.embed(df, 8).first()["embedding"]) == 8
    safe = enrichment.protect(spark.createDataFrame([("mail a@b.org",), (None,)], "content string"))
    assert enrichment.protection_report(safe).collect()[0]["total"] == 1
    with pytest.raises(ValueError):
        enrichment.protect(df, "hide")
    r = spark.range(1).select(enrichment.relevance_proxy(F.lit("one two"), F.lit("two")).alias("a"), enrichment.faithfulness_proxy(F.lit("one two"), F.array(F.lit("two one"))).alias("b")).first()
    assert (r["a"], r["b"]) == (0.5, 1.0)


def test_ingest(spark, tmp_path):
    from caseloom.plans.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Call 555-123-4567 about the pump.")
    (tmp_path / "in" / "b.json").write_text("{")
    cache = Cache()
    cache.set("retrieval:c1:x", 1)
    where = f"file://{tmp_path}/in", f"file://{tmp_path}/table", "c1"
    for _ in range(2):
        report = ingest(spark, *where, cache=cache, pii="redact", dim=8, doc_type="note").first()
        assert (report["files_loaded"], report["files_failed"], report["status"]) == (1, 1, "PARTIAL")
    rows = spark.read.parquet(f"file://{tmp_path}/table").collect()
    assert len(rows) == 1 and "[PHONE_REDACTED]" in rows[0]["content"] and rows[0]["doc_type"] == "note" and cache.stats()["entries"] == 0


def test_jobs_and_retries():
    from caseloom.plans import jobs

    done = []
    q = jobs.JobQueue(1)
    q.submit("b", lambda: done.append("b"))
    q.submit("a", lambda: done.append("a"), jobs.HIGH)
    gone = q.submit("c", lambda: done.append("c"))
    bad = q.submit("d", lambda: 1 / 0, jobs.LOW)
    assert q.cancel(gone) and not q.cancel(gone)
    q.start()
    q.stop()
    assert done == ["a", "b"] and q.get(bad).status == "failed" and len(q.list("completed")) == 2
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert jobs.retry(flaky, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    assert jobs.retry(lambda: 1 / 0, fallback=lambda: "f", sleep=waits.append) == "f"
    breaker = jobs.Breaker(clock=lambda: 0.0)
    for _ in range(5):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(ConnectionError):
        breaker.call(lambda: 1)
    assert jobs.save_command("save docs 1,3-5,9 as my set", 4) == ([1, 3, 4], "my set") and jobs.save_command("no", 3) is None


def test_registry(spark):
    from caseloom.functions import registry

    spark.createDataFrame([("What is the date?",)], "content string").createOrReplaceTempView("reg_view")
    assert "query_intent" in registry.with_functions(spark, "reg_view")
    assert readonly_sql.run(spark, {"reg_view": spark.table("reg_view")}, "select query_intent from reg_view").first()[0] == "fact_lookup"

    @registry.register_scorer("my-scorer")
    def mine(hits):
        return F.lit(1.0)

    assert registry.SCORERS["my_scorer"] is mine


def plain_top(scores, n):
    """{query: [ids]} of (query, id, score), best first, ties by id."""
    out = {}
    for q, i, s in sorted(scores, key=lambda r: (r[0], -r[2], r[1])):
        out.setdefault(q, []).append((i, s))
    return {q: v[:n] for q, v in out.items()}


@pytest.mark.parametrize("text_ids", [False, True])
def test_search_legs_equal_brute_force(spark, monkeypatch, text_ids):
    import numpy as np

    from caseloom.operators import topn

    monkeypatch.setattr(topn, "MOST_HELD", 50)
    monkeypatch.setattr(retrieval, "BLOCK_SCORES", 40)
    rng, words = np.random.default_rng(3), [f"word{i}" for i in range(30)]
    name = (lambda i: f"c{i:04d}") if text_ids else (lambda i: i)
    rows = [(name(i), " ".join(rng.choice(words, 12)), [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(200)]
    rows += [(name(900), None, None), (name(901), "word1 word2", [0.0] * 5), (name(902), "word1 word2", [1.0, 2.0]), (name(903), "", [1.0] * 5)]
    asks = [(q, " ".join(rng.choice(words, 4)), [float(x) for x in rng.integers(-2, 3, 5)]) for q in range(6)] + [(6, "none of them", None), (7, None, [0.0] * 5)]
    kind = "string" if text_ids else "long"
    chunks = spark.createDataFrame(rows, f"id {kind}, content string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(asks, "query_id long, query string, query_embedding array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    cos = [
        (q, i, round(float(unit(a) @ unit(v)), 9)) for q, _, a in asks if a and any(a) for i, _, v in rows if v and len(v) == 5 and any(v)
    ]
    hits = [
        (q, i, n) for q, a, _ in asks for i, c, _ in rows if (n := len({w for w in (a or "").split()} & {w for w in (c or "").split()}))
    ]
    for found, score, want in (
        (retrieval.semantic_top(chunks, queries, 7), "similarity", plain_top(cos, 7)), (retrieval.keyword_top(chunks, queries, 7), "hits", plain_top(hits, 7))
    ):
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append((r["id"], r[score]))
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    monkeypatch.setattr(retrieval, "MOST_TOKENS", 2)  # the join instead
    joined = retrieval.keyword_top(chunks, queries, 7).collect()
    assert {(r["query_id"], r["id"], r["hits"]) for r in joined} == {(q, i, s) for q, v in plain_top(hits, 7).items() for i, s in v}
    assert retrieval.semantic_top(chunks.limit(0), queries, 3).count() == 0 == retrieval.keyword_top(chunks, queries.limit(0), 3).count()


def test_cover_density_equals_brute_force(spark):
    import random

    rng, words = random.Random(4), "safety plant report pipe valve tank alarm crew".split()
    rows = [(i, " ".join(rng.choices(words + ["the", "of"], k=rng.randint(0, 25)))) for i in range(150)]
    asks = [(q, x) for q, x in enumerate(["safety plant", '"pipe valve" or tank', "alarm -crew", "report or report", "the of", "missing", "safety or plant or pipe"])]
    got = keyword.ranked_top(spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame(asks, "query_id long, query string"), 5).collect()
    scores = []
    for q, ask in asks:
        for i, text in rows:
            index = {}
            for s, p in keyword.lexemes(text):
                index.setdefault(s, []).append(p)
            found = [keyword.cover_density(index, {s for w, x in c if w for s in x}) for c in keyword.parse(ask) if keyword.matches(c, index)]
            if found:
                scores.append((q, i, round(sum(found), 6)))
    want = plain_top(scores, 5)
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in got} == {(q, i, s, n + 1) for q, v in want.items() for n, (i, s) in enumerate(v)}


def test_alert_across_midnight_and_with_a_gap(spark):
    from caseloom.operators import metrics

    at = lambda *m: [(f"2024-01-0{1 + x // 1440} {x // 60 % 24:02d}:{x % 60:02d}:30", 200.0) for x in m]
    rows = at(1437, 1438, 1439, 1440, 1441) + at(300, 301, 600)
    events = spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = metrics.sliding_alert(events, F.sum("value"), 100.0, "1 minute", "1 minute").collect()
    firing = sorted(str(r["window_start"])[5:16] for r in out if r["firing"])
    assert firing == ["01-01 23:59", "01-02 00:00", "01-02 00:01"] and len(out) == 8


def test_agent_risk_uses_claims_and_facts(spark):
    docs = lambda *texts: [(n, n, f"s{n}.txt", t) for n, t in enumerate(texts)]
    schema = "query_id long, asked string, query string, loops int, grade string, docs array<struct<rank:int,id:int,source:string,text:string>>"
    same = "The valve of the northern plant was closed on 2024-01-15 by the crew. More text follows here."
    rows = [
        (1, "q", "q", 0, "yes", docs(same, same, same)),
        (2, "q", "q", 0, "yes", docs("Costs of $5,000 were paid on 2023-02-03 to a contractor of the plant. x", "Another unrelated sentence says 45% of it here. y")),
        (3, "q", "q", 0, "no", []),
    ]
    got = {r["query_id"]: r for r in agent._respond(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["decision"] == "pass" and got[1]["critical_facts"] == 1 and got[1]["risk"] == 0 and got[1]["citations"] == 3
    assert got[2]["critical_facts"] >= 3 and got[2]["risk"] >= 0.3
    assert got[3]["citations"] == 0 and got[3]["risk"] == 0


def test_pii_and_citation_spans_equal_python(spark):
    import random
    import re

    from caseloom.functions import patterns as P
    from caseloom.functions import text as T

    rng = random.Random(8)
    parts = ["a@b.co", "é 555-123-4567", "123-45-6789", "Passport No: AB123456", "[Source: a/b.txt, p.3]", "[source: c d]", "word ", "\n", "DOB: 1/2/1990 ", "1.2.3.4 ", "x"]
    texts = ["", *["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(80)]]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i long, t string")
    for r in df.select("i", "t", T.pii_spans(F.col("t")).alias("p"), T.citation_contexts(F.col("t")).alias("c")).collect():
        if r["t"] is None:
            assert r["p"] is None and r["c"] is None
            continue
        seen, want = set(), []
        for name, pattern, _ in P.PII:
            for m in re.finditer(pattern, r["t"]):
                if m.span() not in seen:
                    seen.add(m.span())
                    want.append((*m.span(), name, m[0]))
        assert sorted((s["start"], s["end"], s["pii_type"], s["value"]) for s in r["p"]) == sorted(want)
        assert [s["start"] for s in r["p"]] == sorted(s["start"] for s in r["p"])
        cited = [(m[1].strip(), r["t"][max(0, m.start() - 60) : m.end() + 60].strip()) for m in re.finditer(P.CITATION, r["t"])]
        assert [(c["source"], c["context"]) for c in r["c"]] == cited


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([(1, i, float(i % 4)) for i in range(8)], "query_id long, id long, boosted_score double")

    def broken(df):
        raise ConnectionError

    out, name = retrieval.rerank_with_fallback(hits, [("service", broken), ("gone", lambda df: F.col("no_such")), ("ids", lambda df: -F.col("id"))], 3)
    assert name == "ids" and [r["id"] for r in out.orderBy("rank").collect()] == [0, 1, 2]
    out, name = retrieval.rerank_with_fallback(hits, [("service", broken)], 2)
    assert name == "none" and [r["id"] for r in out.orderBy("rank").collect()] == [3, 7]


def test_retriever_composes_its_stages(spark):
    rows = []
    for m in range(6):
        for c in range(4):
            rows.append((m * 10 + c, f"mail {m} part {c} pump" if c else f"mail {m} opening", [float(m == 2) + c / 10, 1.0], f"m{m}", None, c, "ann lee", "bob", "pump", ""))
    rows.append((100, "drawing of it", [0.5, 0.5], "f1", "m2", 0, "", "", "", ""))
    schema = (
        "id long, content string, embedding array<double>, message_id string, parent_message_id string, chunk_index int, email_from string,"
        " email_to string, email_subject string, entity_name string"
    )
    chunks = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(1, "mail from ann about drawing", [1.0, 0.4])], "query_id long, query string, query_embedding array<double>")
    got = retrieval.retrieve(chunks, queries, top_k=2, top_n=6).collect()
    kinds = {r["origin"] for r in got}
    assert {"search", "sibling"} <= kinds and ("neighbour" in kinds or "attachment" in kinds)
    assert len({r["id"] for r in got}) == len(got)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) <= 6
    assert [r["boosted_score"] for r in ranked] == sorted((r["boosted_score"] for r in ranked), reverse=True)
    messages = {r["id"]: f"m{r['id'] // 10}" for r in got if r["id"] < 100}
    hit = {messages[r["id"]] for r in ranked if r["id"] in messages}
    assert all({m * 10 + c for c in range(4)} <= {r["id"] for r in got} for m in range(6) if f"m{m}" in hit)
