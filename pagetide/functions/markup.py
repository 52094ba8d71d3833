"""Sanitizing of untrusted HTML columns.

The Arrow UDFs below wrap one small stdlib parser. It is stricter than a browser: what it
cannot place in the allow-list becomes text or disappears, never markup.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagetide.functions.binding import bind
from pagetide.functions.text import (
    fix_double_escaping,
    normalize_ws,
    trim_ws,
    unescape_fully,
)

# What may remain in a summary.
ALLOWED_TAGS = frozenset(
    ["p", "br", "strong", "b", "em", "i", "u", "code", "pre", "blockquote", "ul", "ol", "li", "a"]
)
ALLOWED_ATTRIBUTES = {"a": ("href", "title")}
ALLOWED_SCHEMES = frozenset(["http", "https", "mailto"])
LINK_REL = "noopener noreferrer nofollow"
DROPPED_WITH_CONTENT = frozenset(["script", "style"])
VOID_TAGS = frozenset(["br"])

# Fixed values of the HTML standard: start tags that end an open paragraph.
CLOSES_PARAGRAPH = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section
    summary table ul""".split()
)

# Fixed value: longest excerpt shown in a listing.
EXCERPT_LENGTH = 240

_SCHEME = re.compile(r"^([a-z][a-z0-9+.\-]*):", re.IGNORECASE)
_IGNORED_IN_URL = re.compile(r"[\x00-\x20]+")
_BLANKS = re.compile(r"\s+")


def _text(value: str) -> str:
    return escape(value, quote=False).replace("\xa0", "&nbsp;")


def _safe_link(url: str) -> bool:
    match = _SCHEME.match(_IGNORED_IN_URL.sub("", url))
    return match is None or match.group(1).lower() in ALLOWED_SCHEMES


class _Cleaner(HTMLParser):
    """Rewrites a fragment keeping only `tags`; output is always well nested."""

    def __init__(self, tags: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = tags
        self.out: list[str] = []
        self.open: list[str] = []
        self.dropping = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_WITH_CONTENT:
            self.dropping += 1
        if self.dropping:
            return
        if tag in CLOSES_PARAGRAPH:
            self._close("p")
        elif tag == "li":
            self._close("li", within=("ul", "ol"))
        if tag in self.tags:
            self.out.append(f"<{tag}{self._attributes(tag, attrs)}>")
            if tag not in VOID_TAGS:
                self.open.append(tag)

    # HTML has no self-closing elements: the slash is ignored, as browsers do.
    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in DROPPED_WITH_CONTENT:
            self.dropping = max(0, self.dropping - 1)
        elif not self.dropping:
            self._close(tag)

    def _close(self, tag, within=()):
        """Close the innermost open `tag` and what it holds, not looking past `within`."""
        for depth, name in enumerate(reversed(self.open), start=1):
            if name == tag:
                self.out.extend(f"</{inner}>" for inner in reversed(self.open[-depth:]))
                del self.open[-depth:]
                return
            if name in within:
                return

    def handle_data(self, data):
        if not self.dropping:
            self.out.append(_text(data))

    def _attributes(self, tag, attrs):
        kept = []
        for name, value in attrs:
            if name not in ALLOWED_ATTRIBUTES.get(tag, ()):
                continue
            if name == "href" and not _safe_link(value or ""):
                continue
            quoted = _text(value or "").replace('"', "&quot;")
            kept.append(f' {name}="{quoted}"')
        if tag == "a":
            kept.append(f' rel="{LINK_REL}"')
        return "".join(kept)

    def result(self) -> str:
        self.close()
        return "".join(self.out) + "".join(f"</{tag}>" for tag in reversed(self.open))


def _clean(fragment: str, tags: frozenset[str]) -> str:
    cleaner = _Cleaner(tags)
    cleaner.feed(fragment)
    return cleaner.result()


def _visible_text(fragment: str) -> str:
    return _BLANKS.sub(" ", unescape_fully(_clean(fragment, frozenset()))).strip()


def _sanitize_one(prepared: str) -> tuple[str | None, str | None]:
    cleaned = _clean(prepared, ALLOWED_TAGS).strip()
    text = _visible_text(cleaned) if cleaned else ""
    return (cleaned, text) if text else (None, None)


@F.pandas_udf(StructType([StructField("clean", StringType()), StructField("text", StringType())]))
def _sanitize(values: pd.Series) -> pd.DataFrame:
    pairs = [(None, None) if value is None else _sanitize_one(value) for value in values]
    return pd.DataFrame(pairs, columns=["clean", "text"], dtype=object)


@F.pandas_udf(StringType())
def _strip(values: pd.Series) -> pd.Series:
    return values.map(_visible_text, na_action="ignore")


def _has_markup(value: Column) -> Column:
    return value.contains("<") | value.contains("&")


def sanitize_with_text(value: Column) -> Column:
    """Struct of the allow-listed HTML (NULL when no visible text is left) and its plain text.

    Plain text needs no parser: it is only trimmed, and its `>` and no-break spaces escaped.
    """
    prepared = fix_double_escaping(value)
    escaped = F.replace(
        F.replace(trim_ws(prepared), F.lit(">"), F.lit("&gt;")), F.lit("\u00a0"), F.lit("&nbsp;")
    )
    plain = F.struct(
        F.nullif(escaped, F.lit("")).alias("clean"), F.nullif(normalize_ws(prepared), F.lit("")).alias("text")
    )
    marked = _has_markup(prepared)
    return F.when(marked, _sanitize(F.when(marked, prepared))).otherwise(plain)


def sanitize(value: Column) -> Column:
    """Allow-listed HTML, or NULL when no visible text is left."""
    return sanitize_with_text(value)["clean"]


def strip_tags(value: Column) -> Column:
    """Plain text of a fragment, white space normalized; NULL becomes ''."""
    return F.coalesce(
        F.when(_has_markup(value), _strip(F.when(_has_markup(value), value))).otherwise(
            normalize_ws(value)
        ),
        F.lit(""),
    )


# Patterns of the JVM-only variant: dropped elements, comments, tags.
NATIVE_DROPPED = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>"
NATIVE_COMMENT = r"(?s)<!--.*?-->"
NATIVE_TAG = r"(?s)</?[a-zA-Z!?][^>]*>"


def strip_tags_native(value: Column) -> Column:
    """`strip_tags` by regular expressions, for well-formed pages; entities are kept as is."""
    for pattern in (NATIVE_DROPPED, NATIVE_COMMENT, NATIVE_TAG):
        value = F.regexp_replace(value, pattern, "")
    return F.coalesce(normalize_ws(value), F.lit(""))


def excerpt_of_text(text: Column, length: int = EXCERPT_LENGTH) -> Column:
    """Cut plain text at `length`, dropping the last partial word and adding an ellipsis."""

    def shortened(whole: Column) -> Column:
        cut = F.regexp_replace(F.substring(whole, 1, length), " [^ ]*$", "")
        return F.when(F.length(whole) <= length, whole).otherwise(F.concat(cut, F.lit("…")))

    return bind(text, shortened)


def excerpt(value: Column, length: int = EXCERPT_LENGTH) -> Column:
    return excerpt_of_text(strip_tags(value), length)

