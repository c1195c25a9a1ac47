from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import patterns as P
from caseloom.functions import text as T
from caseloom.functions.vectors import cosine, hash_embedding


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("short", "normal"),
        ("Pursuant to section 4 the party shall comply with the regulation herein and thereof.", "dense"),
        ("hi there\nok thanks a lot\nsounds good to me\nsee you soon then", "conversational"),
        ("x" * 130, "dense"),
        ("A plain line of text that is neither long nor short, about seventy.", "normal"),
    ],
)
def test_content_density(spark, text, want):
    assert one(spark, T.content_density(F.col("t")), t=text) == want


def test_ids(spark):
    head = "Message-ID: <a1@x.org>\nIn-Reply-To: <b2@x.org>\nReferences: <c3@x.org>"
    assert one(spark, T.message_id(F.col("t")), t=head) == "a1@x.org"
    assert one(spark, T.thread_id(F.col("t")), t=head) == "b2@x.org"
    made = one(spark, T.message_id(F.col("t")), t="no header")
    assert re.fullmatch("gen-[0-9a-f]{16}", made) and made == one(spark, T.message_id(F.col("t")), t="no header")
    assert one(spark, T.thread_id(F.col("t")), t="none") == ""


def test_block_tests(spark):
    assert one(spark, T.is_quoted(F.col("t")), t="> a\n> b\nc") is True
    assert one(spark, T.is_quoted(F.col("t")), t="> a\nb") is False
    assert one(spark, T.is_list(F.col("t")), t="- a\n- b\nc") is True
    assert one(spark, T.is_list(F.col("t")), t="- a") is False
    assert one(spark, T.is_signature(F.col("t")), t="  Best regards,\nJo") is True
    assert one(spark, T.heading_level(F.col("t")), t="### Title") == 3
    assert one(spark, T.heading_level(F.col("t")), t="EXECUTIVE SUMMARY") == 1
    assert one(spark, T.heading_level(F.col("t")), t="EXECUTIVE SUMMARY.") is None
    assert one(spark, T.paragraph_type(F.col("t")), t="From: a\nTo: b\nSubject: c") == "email_header"


def test_citations_and_sources(spark):
    got = one(spark, T.citations(F.col("t")), t="x [Source: a/b.pdf, p.12] y [source: c.txt]")
    assert [(c["source"], c["page"]) for c in got] == [("a/b.pdf", 12), ("c.txt", None)]
    for a, b, want in [("A.pdf", "a.pdf ", True), ("a.pdf", "x/a.pdf", True), ("y\\a.pdf", "x/a.pdf", True), ("b.pdf", "a.pdf", False)]:
        assert one(spark, T.source_matches(F.col("a"), F.col("b")), a=a, b=b) is want


def test_values(spark):
    got = one(spark, T.critical_values(F.col("t")), t="Paid $1,234.56 (12.5%) on 2024-01-15, Jan 3, 2023 and 1,000")
    assert got == ["$1,234.56", "12.5%", "2024-01-15", "Jan 3, 2023", "1,000"]
    assert one(spark, T.normalise_value(F.col("t")), t=" $1,234.56") == "1234.56"


PII_TEXT = "mail a.b@x.org call 555-123-4567 or +44 20 7946 0958, ssn 123-45-6789, card 4111 1111 1111 1111, ip 10.0.0.1, DOB: 1/2/1990"


def test_pii(spark):
    got = one(spark, T.redact_pii(F.col("t")), t=PII_TEXT)
    for token in ("EMAIL", "PHONE", "SSN", "IP", "DOB"):
        assert f"[{token}_REDACTED]" in got
    assert not re.search(r"a\.b@|4567|6789|10\.0\.0\.1|1990|1111", got)
    assert one(spark, T.redact_pii(F.col("t")), t=got) == got
    counts = one(spark, T.pii_counts(F.col("t")), t=PII_TEXT)
    assert counts["EMAIL"] == 1 and counts["IP_ADDRESS"] == 1 and counts["CREDIT_CARD"] == 1


def test_html_to_text(spark):
    html = "<p>a &lt;b&gt;</p><script>x</p></script><style>y</style>c<br/>d&nbsp;&amp;amp; <b>e</b>"
    assert one(spark, T.html_to_text(F.col("t")), t=html).split() == ["a", "<b>", "c", "d", "&amp;", "e"]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("What happened between May and June?", "timeline"), ("Compare A with B", "comparison"), ("Give an overview", "summary"),
        ("How many people signed?", "fact_lookup"), ("Tell me more", "exploratory"),
    ],
)
def test_intent(spark, query, want):
    assert one(spark, T.intent(F.col("t")), t=query) == want


def test_small_parsers(spark):
    assert one(spark, T.page_ranges(F.col("t")), t="1,3-5, x,4") == [1, 3, 4, 5]
    assert one(spark, T.json_of_answer(F.col("t")), t='so: ```json\n{"a": 1}\n``` done') == '{"a": 1}'
    assert one(spark, T.json_of_answer(F.col("t")), t="none") is None
    assert one(spark, T.body_only(F.col("t")), t="From: a\nSubject: b\n\nhello") == "hello"
    assert one(spark, T.sanitise_metric(F.col("t")), t="a.b-c/d") == "caseloom_a_b_c_d"


def test_vectors(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    import hashlib

    digest = hashlib.sha512(b"q").digest()
    want = [int.from_bytes(digest[(2 * i) % 64 :][:2], "big") / 65535 * 2 - 1 for i in range(40)]
    assert one(spark, hash_embedding(F.col("t"), 40), t="q") == pytest.approx(want)


def test_pattern_count():
    assert len(P.PII) == 11 and len({n for n, *_ in P.PII}) == 10
