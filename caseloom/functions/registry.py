"""Text and vector functions under names for SQL, and a registry of scorers.

register() makes the functions known to a session: scalar ones as SQL functions, whose bodies are
the same column expressions, so Spark inlines and compiles them like any other; table functions as
Python table functions over partitions of a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from caseloom.functions import text as T
from caseloom.functions import vectors as V

#: SQL name: (parameters, function of their columns).
SQL_FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "content_density": ("t string", T.content_density),
    "html_to_text": ("t string", T.html_to_text),
    "redact_pii": ("t string", T.redact_pii),
    "pii_counts": ("t string", T.pii_counts),
    "citations": ("t string", T.citations),
    "critical_values": ("t string", T.critical_values),
    "normalise_value": ("t string", T.normalise_value),
    "query_intent": ("t string", T.intent),
    "cosine_similarity": ("a array<double>, b array<double>", V.cosine),
}

SCORERS: dict[str, Callable] = {}


def register_scorer(name: str) -> Callable[[Callable], Callable]:
    """Decorator: make a scorer known by name (and by its name with _ for -)."""

    def add(f: Callable) -> Callable:
        SCORERS[name] = SCORERS[name.replace("-", "_")] = f
        return f

    return add


@register_scorer("none")
def _boosted(hits) -> Column:
    return F.col("boosted_score")


@register_scorer("lexical")
def _lexical(hits) -> Column:
    q = T.unicode_tokens(F.col("query"))
    return F.size(F.array_intersect(q, T.unicode_tokens(F.col("content")))) / F.greatest(F.size(q), F.lit(1))


def with_functions(spark: SparkSession, view: str, prefix: str = "") -> list[str]:
    """Adds to a temporary view one column for each function of a single text that fits its
    column `content`, named prefix + function, so that read-only SQL can use them; their names."""
    df = spark.table(view)
    names = [n for n, (args, _) in SQL_FUNCTIONS.items() if args == "t string"]
    for n in names:
        df = df.withColumn(prefix + n, SQL_FUNCTIONS[n][1](F.col("content")))
    df.createOrReplaceTempView(view)
    return [prefix + n for n in names]


# --- functions of a session -------------------------------------------------------------

_OPERATOR = re.compile(r"(?<![\w`.])(<=>|[-+*/%<>=!|&^]+|and|or|not|in)\(")


def sql_text(column: Column) -> str:
    """The expression of an unresolved column as SQL: operators become functions in backquotes, and
    numbers with a point are doubles, not decimals."""
    plain = lambda p: re.sub(r"(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])", r"\1D", _OPERATOR.sub(r"`\1`(", p))
    parts = re.split(r"('(?:[^'\\]|\\.)*')", column._jc.node().sql(), flags=re.S)
    return "".join(p if p.startswith("'") else plain(p) for p in parts)


class SplitText:
    """chunk_texts(TABLE(t) PARTITION BY key ORDER BY place): t(key string, content string).

    The texts of a partition, such as the mails of a thread, are joined by empty lines and cut by
    the recursive splitter.  Rows: key, chunk_index, total_chunks, content.
    """

    def __init__(self) -> None:
        self.key, self.texts = None, []

    def eval(self, row: Row) -> None:
        self.key = row[0]
        if row[1]:
            self.texts.append(row[1])

    def terminate(self) -> Iterator[tuple]:
        from caseloom.operators.chunking import split_recursively

        parts = split_recursively("\n\n".join(self.texts)) if self.texts else []
        for n, part in enumerate(parts):
            yield self.key, n, len(parts), part


class MailSegments:
    """mail_segments(TABLE(t)): t(key string, content string); the segments of each e-mail."""

    def eval(self, row: Row) -> Iterator[tuple]:
        from caseloom.operators.chunking import email_segments

        for n, (kind, content) in enumerate(email_segments(row[1] or "")):
            yield row[0], n, kind, content


#: SQL name: (class, columns of the result).
TABLE_FUNCTIONS: dict[str, tuple[type, str]] = {
    "chunk_texts": (SplitText, "key string, chunk_index int, total_chunks int, content string"),
    "mail_segments": (MailSegments, "key string, seq int, type string, content string"),
}


def register(spark: SparkSession) -> tuple[frozenset[str], frozenset[str]]:
    """Make all functions known to the session; the names of scalar and of table functions."""
    for name, (parameters, make) in SQL_FUNCTIONS.items():
        columns = [p.split()[0] for p in parameters.split(", ")]
        kind = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {p.split()[1]}) AS {p.split()[0]}" for p in parameters.split(", "))).select(
            make(*[F.col(c) for c in columns])
        ).dtypes[0][1]
        body = sql_text(make(*[F.col(c) for c in columns]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema, useArrow=True))
    return frozenset(SQL_FUNCTIONS), frozenset(TABLE_FUNCTIONS)
