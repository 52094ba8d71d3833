"""The column functions under SQL.

A column function is written once, in Python; its SQL function is the text of the expression
that it builds, so both are the same expression to the planner. `register` adds them to a
session as temporary functions:

    SELECT page_id, canonicalize(url).url_canonical, relative_date(seen_at, now()) AS seen FROM pages
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import dates, labels, markup, text, urls

# name: (parameters, result, the column function)
SCALARS: dict[str, tuple[dict[str, str], str, Callable[..., Column]]] = {
    "normalize_ws": ({"value": "string"}, "string", text.normalize_ws),
    "content_hash": ({"title": "string", "body": "string"}, "string", text.content_hash),
    "strip_tags": ({"html": "string"}, "string", markup.strip_tags_native),
    "excerpt": ({"value": "string"}, "string", markup.excerpt_of_text),
    "resolve_link": ({"base": "string", "link": "string"}, "string", urls.resolve),
    "parse_feed_date": ({"written": "string"}, "timestamp", dates.parse_datetime),
    "resolve_published": (
        {"published": "timestamp", "updated": "timestamp", "fetched_at": "timestamp"},
        "struct<published_at: timestamp, date_source: string>",
        dates.resolve_published,
    ),
    "absolute_date": ({"at": "timestamp"}, "string", dates.absolute_date),
    "datetime_attr": ({"at": "timestamp"}, "string", dates.datetime_attr),
    "relative_date": ({"at": "timestamp", "clock": "timestamp"}, "string", dates.relative_date),
    "duration_text": ({"micros": "bigint"}, "string", dates.duration),
    "lang_label": ({"lang": "string"}, "string", labels.lang_label),
    "topic_label": ({"topic": "string"}, "string", labels.topic_label),
    "source_label": ({"source_type": "string"}, "string", labels.source_label),
    "gap_label": ({"gap_status": "string"}, "string", labels.gap_label),
    "error_kind": ({"message": "string"}, "string", labels.error_kind),
    "error_kind_label": ({"message": "string"}, "string", labels.error_kind_label),
}

_LITERAL = r"'(?:[^'\\]|\\.)*'|`[^`]*`"
# operators and words that are functions too, but are called so only between backquotes
_CALLED = re.compile(rf"({_LITERAL})|([<>=!+\-*/%&|^~]+|\b(?:and|or|not|in|isnull|isnotnull)\b)(?=\()", re.IGNORECASE | re.DOTALL)


def sql_text(column: Column) -> str:
    """The expression as SQL, with every operator as the function of that name."""
    written = column._jc.node().sql()
    return _CALLED.sub(lambda m: m[1] or f"`{m[2].lower()}`", written)


def scalar_statement(name: str) -> str:
    parameters, result, function = SCALARS[name]
    listed = ", ".join(f"{p} {kind}" for p, kind in parameters.items())
    body = sql_text(function(*(F.col(p) for p in parameters)))
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {result} RETURN {body}"


def canonicalize_statement() -> str:
    """A struct of the canonical form and the reason why there is none.

    The steps of the form become parameters of nested lambdas, of the same names, so each is
    evaluated once. Encoding international hosts calls Java, which a lateral table function may not do.
    """
    steps = urls.canonical_steps(F.col("raw"), "url_canonical", "reject_reason")
    body = "named_struct('url_canonical', url_canonical, 'reject_reason', reject_reason)"
    for name, column in reversed(steps):
        body = f"element_at(transform(array({sql_text(column)}), {name} -> {body}), 1)"
    return (
        "CREATE OR REPLACE TEMPORARY FUNCTION canonicalize(raw string) "
        f"RETURNS struct<url_canonical: string, reject_reason: string> RETURN {body}"
    )


def register(spark: SparkSession) -> None:
    """Add all functions to the session."""
    for name in SCALARS:
        spark.sql(scalar_statement(name))
    spark.sql(canonicalize_statement())
