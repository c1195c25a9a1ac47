"""Citations, critical facts, answer risk and routing decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators.retrieval import slices_of

try:
    import ahocorasick
except ImportError:  # the join below does the same, more slowly
    ahocorasick = None

MOST_VALUES = 100_000
GROUNDED, PARTIAL = 0.9, 0.5
WEIGHTS = {"citation": 0.35, "claims": 0.35, "facts": 0.30}
SEVERITY = {"critical": 1.0, "major": 0.6, "minor": 0.3}
BLOCK, WARN = 0.65, 0.35
BLOCKED_ANSWER = (
    "**Not enough evidence for a reliable answer.** Citations, claims and critical facts show a high risk."
    " Refine the query or read the source documents."
)


def validate_citations(answer: Column, sources: Column) -> Column:
    """array<struct<source, page, is_valid>>: whether any of sources matches the cited one."""
    return F.transform(
        T.citations(answer),
        lambda c: F.struct(
            c["source"].alias("source"),
            c["page"].alias("page"),
            F.exists(sources, lambda s: T.source_matches(c["source"], s)).alias("is_valid"),
        ),
    )


def grounding_score(report: Column) -> Column:
    valid = F.size(F.filter(report, lambda c: c["is_valid"]))
    return F.when(F.size(report) > 0, valid / F.size(report)).otherwise(F.lit(0.0))


def grounding_status(score: Column) -> Column:
    return F.when(score >= GROUNDED, "grounded").when(score >= PARTIAL, "partial").otherwise("ungrounded")


def _texts_with(body: DataFrame, values: list[str]) -> DataFrame:
    """(norm, n): the number of rows whose body contains each value; values without one are left
    out."""
    shared = body.sparkSession.sparkContext.broadcast(values)  # at most MOST_VALUES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for v in shared.value:
            machine.add_word(v, v)
        if not len(machine):
            return
        machine.make_automaton()
        for batch in batches:
            found = [v for text in batch.column(0) for v in {hit for _, hit in machine.iter(text.as_py())}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["norm"])

    if ahocorasick is None:
        spark = body.sparkSession
        table = spark.createDataFrame([(v,) for v in values], "norm string")
        hits = body.join(F.broadcast(table), F.col("body").contains(F.col("norm"))).select("norm")
    else:
        hits = body.mapInArrow(run, "norm string")
    return hits.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


def supported_facts(claims: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """(claim_id, value, supporting_docs, is_sufficiently_supported) for each critical value.

    claims(claim_id, claim) x docs(doc_id, content): a document supports a value that its
    normalised text contains.  One pass over each text finds all values at once by an automaton
    of them, which is broadcast; only counts are shuffled.  The texts are read once for each
    MOST_VALUES distinct values.
    """
    values = claims.select(
        "claim_id", F.explode(F.array_distinct(T.critical_values(F.col("claim")))).alias("value")
    ).withColumn("norm", T.normalise_value(F.col("value")))
    distinct = values.select("norm").distinct().where("norm != ''")
    body = docs.select(T.normalise_content(F.coalesce(F.col("content"), F.lit(""))).alias("body"))
    counts = None
    for part in slices_of(distinct, "norm", MOST_VALUES):
        found = _texts_with(body, [r["norm"] for r in part.collect()])
        counts = found if counts is None else counts.unionByName(found)
    out = values.join(counts, "norm", "left").withColumn("supporting_docs", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select(
        "claim_id", "value", "supporting_docs", (F.col("supporting_docs") >= least).alias("is_sufficiently_supported")
    )


def validation_status(total: Column, valid: Column, weak_facts: Column) -> Column:
    """pass, partial or fail; a weak critical fact turns pass into partial."""
    base = F.when((total == 0) | (valid == total), "pass").when(valid > 0, "partial").otherwise("fail")
    return F.when((base == "pass") & (weak_facts > 0), "partial").otherwise(base)


def risk_score(cited: Column, invalid: Column, severities: Column, facts: Column, weak: Column) -> Column:
    """0 to 1 from the shares of invalid citations, of claim severity and of weak facts."""
    weight = F.aggregate(
        severities,
        F.lit(0.0),
        lambda a, s: a + F.when(s == "critical", SEVERITY["critical"]).when(s == "major", SEVERITY["major"]).otherwise(SEVERITY["minor"]),
    )
    claims = F.when(F.size(severities) > 0, F.least(weight / F.size(severities), F.lit(1.0))).otherwise(F.lit(0.0))
    raw = (
        WEIGHTS["citation"] * invalid / F.greatest(cited, F.lit(1))
        + WEIGHTS["claims"] * claims
        + WEIGHTS["facts"] * weak / F.greatest(facts, F.lit(1))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def risk_decision(score: Column) -> Column:
    return F.when(score >= BLOCK, "block").when(score >= WARN, "warn").otherwise("pass")


def risk_flags(cited: Column, invalid: Column, severities: Column, facts: Column, weak: Column) -> Column:
    """Reasons in words; claims below critical are named only if none is critical."""
    critical = F.size(F.filter(severities, lambda s: s == "critical"))
    n = F.size(severities)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.array_compact(
        F.array(
            F.when(invalid > 0, text(invalid, "/", cited, " invalid citations")),
            F.when(critical > 0, text(critical, " critical unsupported claims")).when(n > 0, text(n, " unsupported claims")),
            F.when(weak > 0, text(weak, "/", facts, " weak critical facts")),
        )
    )


def guarded_answer(answer: Column, decision: Column, score: Column, flags: Column) -> Column:
    warning = F.concat(
        F.format_string("> **Warning** (risk score: %.2f)\n>\n", score),
        F.array_join(F.transform(flags, lambda f: F.concat(F.lit("> - "), f, F.lit("\n"))), ""),
        F.lit("\n"),
        answer,
    )
    return F.when(decision == "block", F.lit(BLOCKED_ANSWER)).when(decision == "warn", warning).otherwise(answer)


def review_confidence(status: Column, downgraded: Column) -> Column:
    base = F.when(status == "pass", F.lit(0.85)).when(status == "partial", F.lit(0.55)).otherwise(F.lit(0.30))
    return base - F.when(downgraded, F.lit(0.15)).otherwise(F.lit(0.0))


def needs_review(confidence: Column, threshold: float = 0.65) -> Column:
    """Whether an answer goes to the review queue."""
    return confidence < threshold


def fact_warnings(facts: Column) -> Column:
    """A line for each weak fact (value, supporting_docs, is_sufficiently_supported), or one that
    says that there is none."""
    weak = F.filter(facts, lambda f: ~f["is_sufficiently_supported"])
    line = lambda f: F.concat(F.lit("- "), f["value"], F.lit(" (supporting documents: "), f["supporting_docs"].cast("string"), F.lit(")"))
    return (
        F.when(F.size(facts) == 0, "No critical facts.")
        .when(F.size(weak) == 0, "All critical facts have support.")
        .otherwise(F.concat(F.lit("Critical facts without enough support:\n"), F.array_join(F.transform(weak, line), "\n")))
    )


def cited_pages(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(source, pages): the sorted pages that answers cite of each source; citations without a
    page count as none."""
    cited = answers.select(F.explode(T.citations(F.col(answer))).alias("c"))
    return cited.groupBy(F.col("c.source").alias("source")).agg(F.array_sort(F.collect_set("c.page")).alias("pages"))


def route(grade: Column, loops: Column, most: int = 3) -> Column:
    """Where the query goes after grading."""
    return F.when((grade == "yes") | (loops >= most), "validator").otherwise("rewriter")


def _claims(answer: Column) -> Column:
    """Sentences of 20 or more characters that do not open with #."""
    return F.filter(
        F.transform(T.sentences(answer), T.strip), lambda s: (F.length(s) >= 20) & ~s.startswith("#")
    )


def unsupported_claims(answer: Column, docs: Column) -> Column:
    """Claims with words of which no document shares max(2, n/3) of the n."""

    def unsupported(s: Column) -> Column:
        words = T.ascii_words(s)
        need = F.greatest(F.lit(2), F.floor(F.size(words) / 3))
        return (F.size(words) > 0) & ~F.exists(docs, lambda d: F.size(F.array_intersect(words, T.ascii_words(d))) >= need)

    return F.filter(_claims(answer), unsupported)


def unsupported_rate(answer: Column, docs: Column) -> Column:
    """Share of unsupported claims; a claim without words counts as supported."""
    n = F.size(_claims(answer))
    return F.when(n > 0, F.size(unsupported_claims(answer, docs)) / n).otherwise(F.lit(0.0))


def local_facts(answer: Column, docs: Column, least: int = 2) -> Column:
    """array<struct<value, supporting_docs, is_sufficiently_supported>>: the critical values of an
    answer, supported by those of the given documents that hold them."""

    def fact(value: Column) -> Column:
        norm = T.normalise_value(value)
        n = F.size(F.filter(docs, lambda d: T.normalise_content(F.coalesce(d, F.lit(""))).contains(norm)))
        return F.struct(value.alias("value"), n.alias("supporting_docs"), (n >= least).alias("is_sufficiently_supported"))

    return F.transform(F.array_distinct(T.critical_values(answer)), fact)


def grounding_notice(answer: Column, report: Column, unsupported: Column) -> Column:
    """answer with up to two closing sections: invalid citations, unsupported claims."""
    bad = F.filter(report, lambda c: ~c["is_valid"])
    one = lambda c: F.concat(F.lit("- "), c["source"])
    cited = F.when(F.size(bad) > 0, F.concat(F.lit("\n\n---\n**Unverified citations:**\n"), F.array_join(F.transform(bad, one), "\n"))).otherwise("")
    claims = F.when(
        F.size(unsupported) > 0,
        F.concat(F.lit("\n\n---\n**Claims without support:**\n"), F.array_join(F.transform(unsupported, lambda c: F.concat(F.lit("- "), c)), "\n")),
    ).otherwise("")
    return F.concat(answer, cited, claims)


def document_block(docs: DataFrame, order: str) -> DataFrame:
    """(query_id, block): '[Source: s, p.N]' and the content of each document, joined by ---."""
    head = F.concat(
        F.lit("[Source: "), F.col("source"), F.when(F.col("page").isNotNull(), F.concat(F.lit(", p."), F.col("page").cast("string"))).otherwise(""), F.lit("]\n"), F.col("content")
    )
    rows = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), head.alias("t")))).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["t"]), "\n---\n").alias("block"))
