"""Text functions as column expressions: density, segments, citations, values, PII, HTML.

Word and boundary rules are written with explicit classes where the default of the regex engine
is ASCII only, so that accented letters count as letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions import patterns as P


def lines(text: Column) -> Column:
    """Lines of the trimmed text; other line ends than \\n are normalised first."""
    return F.split(F.regexp_replace(strip(text), r"\r\n?|[\x0B\x0C\x1C-\x1E\x85  ]", "\n"), "\n")


def strip(text: Column) -> Column:
    """text without white space at both ends."""
    return F.regexp_replace(text, r"^[\s\u0085  -     　]+|[\s\u0085  -     　]+$", "")


def blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def share_of_lines(text: Column, test) -> Column:
    """Share of the lines of text for which test(line) holds; null for a blank text."""
    split = lines(text)
    return F.when(~blank(text), F.size(F.filter(split, test)) / F.size(split))


def content_density(text: Column) -> Column:
    """'dense', 'conversational' or 'normal'; dense is tested first."""
    # number and length of the lines that are not blank, found once for all that is asked of them
    count = lambda a, x: F.when(blank(x), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["size"] + F.length(x)).alias("size")))
    held = F.array(F.aggregate(lines(text), F.struct(F.lit(0).alias("n"), F.lit(0).alias("size")), count))
    words = F.size(F.filter(F.split(strip(text), r"\s+"), lambda w: w != ""))
    legal = F.regexp_count(text, F.lit(P.LEGAL)) / F.greatest(words, F.lit(1))
    informal = F.regexp_count(text, F.lit(P.INFORMAL))

    def told(x: Column) -> Column:
        average = x["size"] / x["n"]
        return (
            F.when(x["n"] == 0, "normal")
            .when((average > 120) | (legal > 0.03), "dense")
            .when((average < 50) | (informal >= 2), "conversational")
            .otherwise("normal")
        )

    return F.when(text.isNull() | (F.length(text) < 50), "normal").otherwise(F.element_at(F.transform(held, told), 1))


def chunk_size(text: Column, base: int = 1024, dense: int = 512, conversational: int = 1500) -> Column:
    density = content_density(text)
    return (
        F.when(density == "dense", F.lit(dense))
        .when(density == "conversational", F.lit(conversational))
        .otherwise(F.lit(base))
    )


def message_id(text: Column) -> Column:
    """The Message-ID header, or an id made from the first 500 characters."""
    found = F.regexp_extract(text, r"(?i)Message-ID:\s*<?([^>\s]+)>?", 1)
    made = F.concat(F.lit("gen-"), F.substring(F.sha2(F.substring(text, 1, 500), 256), 1, 16))
    return F.when(found != "", found).otherwise(made)


def thread_id(text: Column) -> Column:
    """The first of In-Reply-To and References in the text; '' without either."""
    return F.regexp_extract(text, r"(?i)(?:In-Reply-To|References):\s*<?([^>\s]+)>?", 1)


def is_quoted(text: Column) -> Column:
    return F.coalesce(share_of_lines(text, lambda x: F.ltrim(x).startswith(">")) > 0.5, F.lit(False))


def is_signature(text: Column) -> Column:
    return strip(text).rlike(P.SIGNATURE)


def is_list(text: Column) -> Column:
    split = lines(text)
    return (F.size(split) >= 2) & (F.size(F.filter(split, lambda x: x.rlike(P.LIST_LINE))) / F.size(split) > 0.5)


def heading_level(text: Column, digits: bool = False) -> Column:
    """1 to 6 for a heading line, null otherwise."""
    body = strip(text)
    one_line = ~body.contains("\n")
    marks = F.regexp_extract(body, r"^(#{1,6})\s+.+$", 1)
    upper = body.rlike(P.UPPER_HEADING_DIGITS if digits else P.UPPER_HEADING)
    fits = F.length(body).between(5, 120) & ~body.endswith(".")
    return F.when(one_line & (marks != ""), F.length(marks)).when(one_line & fits & upper, F.lit(1))


def is_email_header(text: Column) -> Column:
    body = strip(text)
    count = F.regexp_count(body, F.lit(P.HEADER_LINE))
    return (count >= 2) & (count / F.greatest(F.size(lines(text)), F.lit(1)) > 0.5)


def paragraph_type(text: Column) -> Column:
    return (
        F.when(heading_level(text).isNotNull(), "heading")
        .when(is_email_header(text), "email_header")
        .otherwise("paragraph")
    )


def is_email(file_type: Column, text: Column) -> Column:
    head = F.regexp_count(F.substring(text, 1, 500), F.lit(P.HEADER_LINE))
    return F.coalesce(F.lower(file_type).isin("eml", "msg", "pst"), F.lit(False)) | (head >= 2)


def unicode_tokens(text: Column) -> Column:
    """Distinct lower-cased runs of three or more letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(P.TOKEN), F.lit(0)))


def ascii_words(text: Column) -> Column:
    """Distinct lower-cased runs of four or more ASCII letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def date_mentions(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(P.DATE_MENTION), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences: cut at white space after . ! or ?"""
    return F.split(text, r"(?<=[.!?])\s+")


def critical_values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.CRITICAL), F.lit(0))


def normalise_value(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[$,\s]", "")


def normalise_content(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[,\s]", "")


def citations(text: Column) -> Column:
    """array<struct<source, page>> of the citations in order; page is null where none is given."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(P.CITATION), F.lit(1)),
        F.regexp_extract_all(text, F.lit(P.CITATION), F.lit(2)),
        lambda source, page: F.struct(
            F.trim(source).alias("source"), page.try_cast("int").alias("page")
        ),
    )


def source_matches(cited: Column, source: Column) -> Column:
    """Equal, one a suffix of the other, or equal base names; trimmed, in lower case."""
    a, b = F.lower(F.trim(cited)), F.lower(F.trim(source))
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    return (a == b) | a.endswith(b) | b.endswith(a) | (base(a) == base(b))


def html_to_text(html: Column) -> Column:
    """Plain text of HTML: scripts and styles go, line ends for br and p, tags become blanks,
    character references are decoded, blanks and empty lines are collapsed."""
    out = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>|<style.*?>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = unescape(out)
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


#: The named character references decoded within the JVM.
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®",
    "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "middot": "·", "bull": "•",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "euro": "€", "pound": "£", "sect": "§", "para": "¶", "deg": "°", "times": "×", "frac12": "½",
    "amp": "&",
}


def unescape(text: Column) -> Column:
    """Common named references and ASCII numeric ones; & last, so that nothing is decoded twice."""
    out = F.regexp_replace(text, r"&#0*39;|&#[xX]0*27;", "'")
    out = F.regexp_replace(out, r"&#0*34;|&#[xX]0*22;", '"')
    out = F.regexp_replace(out, r"&#0*60;|&#[xX]0*3[cC];", "<")
    out = F.regexp_replace(out, r"&#0*62;|&#[xX]0*3[eE];", ">")
    for name, char in NAMED.items():
        if name != "amp":
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(out, r"&amp;|&#0*38;|&#[xX]0*26;", "&")


def redact_pii(text: Column) -> Column:
    """text with personal data replaced by tokens, one pattern after the other in their order.

    A later pattern does not see what an earlier one has replaced, so overlapping finds give one
    token, that of the pattern listed first.
    """
    for _, pattern, token in P.PII:
        text = F.regexp_replace(text, pattern, token)
    return text


def pii_counts(text: Column) -> Column:
    """map<type, count> of finds, each pattern on its own; types without a find are left out."""
    by_type: dict[str, Column] = {}
    for name, pattern, _ in P.PII:
        count = F.regexp_count(text, F.lit(pattern))
        by_type[name] = by_type[name] + count if name in by_type else count
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in by_type.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def sanitise_metric(name: Column) -> Column:
    return F.concat(F.lit("caseloom_"), F.translate(name, ".-/", "___"))


def page_ranges(text: Column) -> Column:
    """'1,3-5' -> [1, 3, 4, 5]: sorted and distinct; parts that are no number or range go."""
    parts = F.filter(F.split(text, ","), lambda p: p.rlike(r"^\s*\d{1,6}\s*(-\s*\d{1,6}\s*)?$"))
    ranges = F.transform(
        parts,
        lambda p: F.sequence(
            F.regexp_extract(p, r"(\d+)", 1).cast("int"),
            F.greatest(
                F.regexp_extract(p, r"(\d+)\s*$", 1).cast("int"), F.regexp_extract(p, r"(\d+)", 1).cast("int")
            ),
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def body_only(text: Column) -> Column:
    """The text without leading header lines."""
    return strip(F.regexp_replace(text, r"(?i)\A(?:[ \t]*(?:From|To|Cc|Bcc|Subject|Date|Sent|Received|Message-ID|In-Reply-To|References):[^\n]*(?:\n|\z))+", ""))


def json_of_answer(text: Column) -> Column:
    """The JSON text of a model's answer: the whole, a fenced block, or the first braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    whole = strip(text)
    return F.when(whole.startswith("{") & whole.endswith("}"), whole).when(fenced != "", fenced).when(braces != "", braces)


INTENTS = {
    # intent: (top_k, semantic weight, keyword weight, answer tokens)
    "fact_lookup": (4, 0.8, 0.2, 1024),
    "summary": (10, 0.6, 0.4, 4096),
    "timeline": (8, 0.5, 0.5, 3072),
    "comparison": (8, 0.7, 0.3, 3072),
    "exploratory": (8, 0.6, 0.4, 4096),
}


def intent(query: Column) -> Column:
    q = strip(F.lower(query))
    return (
        F.when(q.rlike(P.TIMELINE), "timeline")
        .when(q.rlike(P.COMPARISON), "comparison")
        .when(q.rlike(P.SUMMARY), "summary")
        .when(q.rlike(P.FACT), "fact_lookup")
        .otherwise("exploratory")
    )


def intent_confidence(name: Column) -> Column:
    return F.when(name == "exploratory", F.lit(0.5)).otherwise(F.lit(0.7))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches of pattern, by code points, end exclusive:
    the lengths of the parts between matches and of the matches before, added up."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(F.split(text, pattern), lambda p: F.length(p))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    sizes = F.transform(matches, lambda m: F.length(m))

    def one(m: Column, i: Column) -> Column:
        start = total(F.slice(parts, F.lit(1), i + 1)) + total(F.slice(sizes, F.lit(1), i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    return F.transform(matches, one)


def pii_spans(text: Column) -> Column:
    """array<struct<start, end, pii_type, value>> of personal data, sorted by start; of finds with
    one start and end the pattern listed first stays."""

    def typed(n: int, name: str):
        return lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(n).alias("n"), F.lit(name).alias("pii_type"), s["value"].alias("value")
        )

    found = F.concat(*[F.transform(spans(text, pattern), typed(n, name)) for n, (name, pattern, _) in enumerate(P.PII)])
    ordered = F.array_sort(found)
    first = F.filter(
        ordered, lambda x: ~F.exists(ordered, lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]) & (y["n"] < x["n"]))
    )
    return F.transform(first, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pii_type"].alias("pii_type"), x["value"].alias("value")))


def citation_contexts(text: Column, width: int = 60) -> Column:
    """array<struct<source, page, context>>: citations with up to width characters on each side."""
    around = F.transform(
        spans(text, P.CITATION),
        lambda s: strip(F.substring(text, F.greatest(s["start"] - width, F.lit(0)) + 1, s["end"] + width - F.greatest(s["start"] - width, F.lit(0)))),
    )
    return F.zip_with(
        citations(text), around, lambda c, a: F.struct(c["source"].alias("source"), c["page"].alias("page"), a.alias("context"))
    )


def query_hash(query: Column) -> Column:
    """The first 16 hex digits of the SHA-256, as audit records hold it."""
    return F.substring(F.sha2(query, 256), 1, 16)


def is_safe_filename(name: Column) -> Column:
    """Letters, digits, underscores, hyphens, dots and blanks only, at least one of them."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_\-. ]+$"), F.lit(False))


def mail_item_id(internet_id: Column, entry_id: Column, archive: Column, subject: Column, sender: Column, received: Column, index: Column) -> Column:
    """The internet message id, else the store's entry id, else a hash of what identifies the item."""
    raw = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (archive, subject, sender, received, index)])
    return F.coalesce(F.nullif(strip(internet_id), F.lit("")), F.nullif(entry_id, F.lit("")), F.sha2(raw, 256))


def routed_top_k(top_k: Column, confidence: Column, suggested: Column, sure: float = 0.8) -> Column:
    """The intent's number of chunks, or the suggested one of a confident classification."""
    return F.when((confidence >= sure) & suggested.isNotNull(), suggested).otherwise(top_k)
