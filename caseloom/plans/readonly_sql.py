"""Read-only SQL over a case's views.

A statement is parsed by Spark's own parser and its plan is walked before anything is resolved.
Only nodes of queries are allowed, only relations that are the case's views or common table
expressions in scope, and only built-in functions, none of which calls code by name.  Paths, other
tables and views, scripts and writing are therefore out of reach, and words within literals and
names are no obstacle.  The query runs in a session of its own that knows the case's views only,
and where asked the library's own functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from caseloom.functions import registry

MOST_ROWS = 1000
#: Words refused anywhere in compatible mode.
BLOCKED = frozenset(
    "insert update delete drop alter create truncate grant revoke copy call do vacuum merge refresh".split()
)
#: Nodes of a parsed query.
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin AsOfJoin Union Except"
    " Intersect SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith UnresolvedInlineTable"
    " UnresolvedTableValuedFunction UnresolvedHaving OneRowRelation LocalRelation Generate Window WithWindowDefinition Pivot"
    " Unpivot Sample Expand UnresolvedOrderByAll ResolvedInlineTable UnionLoop".split()
)
#: Built-in functions that run code given by name or tell about files.
REFUSED = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split()
)
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
#: Settings that the query's session takes over.
_SETTINGS = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")


class NotReadOnly(ValueError):
    pass


def _bare(sql: str) -> str:
    """sql without comments outside of quotes, and without a closing semicolon."""
    quoted = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
    kept = re.sub(rf"({quoted})|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)
    return kept.strip().rstrip(";").strip()


def _items(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _check_expression(spark: SparkSession, e, names: frozenset[str], own: frozenset[str] = frozenset()) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        parts = _items(e.nameParts())
        name = parts[-1].lower()
        builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        known = builtin.functionExists(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if len(parts) > 1 or name in REFUSED or not (known or name in own):
            raise NotReadOnly(f"function not allowed: {'.'.join(parts)}")
    elif "Python" in kind or "UnresolvedIdentifier" in kind:
        raise NotReadOnly(f"expression not allowed: {kind}")
    for child in _items(e.children()):
        _check_expression(spark, child, names, own)


def _check(spark: SparkSession, plan, names: frozenset[str], own: frozenset[str] = frozenset()) -> None:
    """NotReadOnly unless plan and all within it is allowed; names are the relations in scope, own
    the library's functions."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in NODES:
        raise NotReadOnly(f"not a part of a query: {kind}")
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise NotReadOnly(f"no such view: {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction":
        parts = _items(plan.name())
        if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS | own:
            raise NotReadOnly(f"table function not allowed: {'.'.join(parts)}")
    if kind == "UnresolvedWith":
        for cte in _items(plan.cteRelations()):
            cte_name = frozenset([cte._1().lower()])
            _check(spark, cte._2(), names | cte_name if plan.allowRecursion() else names, own)
            names = names | cte_name
    for e in _items(plan.expressions()):
        _check_expression(spark, e, names, own)
    for child in [*_items(plan.subqueries()), *_items(plan.children())]:
        _check(spark, child, names, own)


def validate(spark: SparkSession, sql: str, compatible: bool = False, views: frozenset[str] | set[str] = frozenset(), functions: frozenset[str] = frozenset()) -> str:
    """The statement without comments; NotReadOnly if it is not one single query over views."""
    text = _bare(sql)
    if not re.match(r"(?i)(select|with|explain)\b", text):
        raise NotReadOnly("only select, with and explain are allowed")
    if compatible:
        found = BLOCKED & set(re.findall(r"[a-z]+", text.lower()))
        if found or ";" in text:
            raise NotReadOnly(f"not allowed: {', '.join(sorted(found)) or ';'}")
    body = re.sub(r"(?i)^explain\b(\s+(extended|codegen|cost|formatted)\b)?", "", text)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        raise NotReadOnly(f"not a query: {str(e).splitlines()[0]}") from e
    _check(spark, plan, frozenset(v.lower() for v in views), functions)
    return text


def run(spark: SparkSession, views: dict[str, DataFrame], sql: str, limit: int = 200, functions: bool = False) -> DataFrame:
    """The first rows of a read-only query over the given views, at most MOST_ROWS; functions:
    whether it may use those of functions.registry."""
    known = frozenset(registry.SQL_FUNCTIONS) | frozenset(registry.TABLE_FUNCTIONS) if functions else frozenset()
    text = validate(spark, sql, views=set(views), functions=known)
    own = spark.newSession()
    for name in _SETTINGS:
        own.conf.set(name, spark.conf.get(name))
    if functions:
        registry.register(own)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, df in views.items():
        rows(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    out = own.sql(text)
    return out if text.lower().startswith("explain") else out.limit(min(max(limit, 1), MOST_ROWS))
