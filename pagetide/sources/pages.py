"""Page documents: RSS (0.9x, 1.0, 2.0) and Atom bodies to entry rows.

Documents are parsed by `from_xml` with one schema for all formats, where the rows are; only
entries leave the stage. A document that cannot be parsed yields an error as a whole page,
never part of its entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.dates import parse_datetime, resolve_published
from pagetide.functions.markup import sanitize_with_text
from pagetide.functions.text import clean_title, content_hash, trim_ws
from pagetide.functions.urls import canonicalize, resolve

_RSS_ITEM = (
    "struct<`_xml:base` string, title string, link string, guid struct<_VALUE string, _isPermaLink string>, "
    "pubDate string, `dc:date` string, description string, author string, `dc:creator` string, "
    "`content:encoded` string>"
)
_ATOM_LINKS = "array<struct<_href string, _rel string>>"
_ATOM_ENTRY = (
    f"struct<`_xml:base` string, title string, link {_ATOM_LINKS}, id string, "
    "published string, updated string, author array<struct<name string>>, "
    "summary string, content array<string>>"
)
# The column of malformed records must come last.
# RSS 1.0 has its items beside the channel, older and newer dialects within it.
DOCUMENT = (
    f"`_xml:base` string, channel struct<`_xml:base` string, title string, link array<string>, item array<{_RSS_ITEM}>>, "
    f"item array<{_RSS_ITEM}>, link {_ATOM_LINKS}, entry array<{_ATOM_ENTRY}>, _corrupt string"
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

_ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z][\w:.\-]*)"
_FEED_ROOTS = ("rss", "feed", "rdf:RDF")
# The declaration is read to its end, however far it is padded.
_DECLARED_ENCODING = r"""^\ufeff?\s*<\?xml[^>]*?encoding\s*=\s*["']([\w.\-]+)["']"""
BYTE_ORDER_MARK = "\ufeff"
_UTF8_NAMES = ("", "utf-8", "utf8")
_LATIN_NAMES = ("iso-8859-1", "latin-1", "latin1")
_WINDOWS_NAMES = ("windows-1252", "cp1252")
_LATIN9_NAMES = ("iso-8859-15", "latin-9", "latin9")


def _differences(codec: str) -> tuple[str, str]:
    """Characters that ISO-8859-1 reads where this code page has others, and those others."""
    pairs = [(chr(c), bytes([c]).decode(codec, "ignore")) for c in range(128, 256)]
    changed = [(a, b) for a, b in pairs if b and a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)

# Messages of unusable documents and of usable ones with a defect.
ERROR_BLANK = "FeedParseError: document sans contenu"
ERROR_MALFORMED = "FeedParseError: le document n'est pas du XML bien forme"
ERROR_NOT_A_FEED = "FeedParseError: racine inconnue, ni RSS ni Atom"
WARNING_ENCODING = "encodage autre que celui declare"


def _filled(value: Column) -> Column:
    """The trimmed value, NULL when blank."""
    return F.nullif(trim_ws(value), F.lit(""))


def _from_rss(item: Column) -> Column:
    guid = _filled(item["guid"]["_VALUE"])
    is_link = F.lower(F.coalesce(item["guid"]["_isPermaLink"], F.lit("true"))) != "false"
    return F.struct(
        item["title"].alias("title"),
        F.coalesce(_filled(item["link"]), F.when(is_link, guid)).alias("url_original"),
        _filled(item["_xml:base"]).alias("own_base"),
        guid.alias("guid"),
        F.coalesce(_filled(item["author"]), _filled(item["dc:creator"])).alias("author"),
        F.coalesce(_filled(item["content:encoded"]), _filled(item["description"])).alias("raw_summary"),
        item["pubDate"].alias("published"),
        item["dc:date"].alias("updated"),
    )


def _first_filled(values: Column) -> Column:
    return F.get(F.filter(F.transform(values, _filled), lambda v: v.isNotNull()), 0)


def _alternate(links: Column) -> Column:
    """The first address among links that are said to be the thing itself, or said to be nothing."""
    alternates = F.filter(links, lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
    return _first_filled(F.transform(alternates, lambda link: link["_href"]))


def _from_atom(entry: Column) -> Column:
    return F.struct(
        entry["title"].alias("title"),
        _alternate(entry["link"]).alias("url_original"),
        _filled(entry["_xml:base"]).alias("own_base"),
        _filled(entry["id"]).alias("guid"),
        _first_filled(F.transform(entry["author"], lambda author: author["name"])).alias("author"),
        F.coalesce(_first_filled(entry["content"]), _filled(entry["summary"])).alias("raw_summary"),
        entry["published"].alias("published"),
        entry["updated"].alias("updated"),
    )


def decode_body(body: Column) -> tuple[Column, Column]:
    """Text of a body and a warning, if its declared encoding is not what it holds.

    Valid UTF-8 is read as such whatever is declared; other bytes by the declared Western code
    page, or with replacement characters.
    """
    as_utf8 = F.try_validate_utf8(body.cast("string"))
    as_latin = F.decode(body, "ISO-8859-1")
    head = F.lower(F.regexp_extract(F.coalesce(as_utf8, as_latin), _DECLARED_ENCODING, 1))
    is_latin = head.isin(*_LATIN_NAMES, *_WINDOWS_NAMES, *_LATIN9_NAMES)
    text = F.coalesce(
        as_utf8,
        F.when(head.isin(*_LATIN_NAMES), as_latin)
        .when(head.isin(*_WINDOWS_NAMES), F.translate(as_latin, *_differences("cp1252")))
        .when(head.isin(*_LATIN9_NAMES), F.translate(as_latin, *_differences("iso-8859-15"))),
        F.make_valid_utf8(body.cast("string")),
    )
    ascii_only = F.length(as_utf8) == F.octet_length(body)
    wrong = F.when(as_utf8.isNotNull(), ~head.isin(*_UTF8_NAMES) & ~ascii_only).otherwise(~is_latin)
    return F.ltrim(text, F.lit(BYTE_ORDER_MARK)), F.when(wrong, F.lit(WARNING_ENCODING))


def parse_documents(pages: DataFrame, body: str = "body") -> DataFrame:
    """Replace a binary body by `items`, `parse_error` and `warning`."""
    text, warning = decode_body(F.col(body))
    staged = pages.withColumn("warning", warning).withColumn("__text", text).drop(body)
    read = staged.withColumn("__doc", F.from_xml("__text", DOCUMENT, _OPTIONS))
    error = (
        F.when(~F.col("__text").rlike(r"\S"), ERROR_BLANK)
        .when(F.col("__doc._corrupt").isNotNull(), ERROR_MALFORMED)
        .when(~F.regexp_extract("__text", _ROOT, 1).isin(*_FEED_ROOTS), ERROR_NOT_A_FEED)
    )
    root = _filled(F.col("__doc.`_xml:base`"))
    inner = _filled(F.col("__doc.channel.`_xml:base`"))
    items = F.concat(
        F.coalesce(F.transform("__doc.channel.item", _from_rss), F.array()),
        F.coalesce(F.transform("__doc.item", _from_rss), F.array()),
        F.coalesce(F.transform("__doc.entry", _from_atom), F.array()),
    )
    site = F.coalesce(_first_filled(F.col("__doc.channel.link")), _alternate(F.col("__doc.link")))
    return (
        read.withColumn("parse_error", error)
        .withColumn("items", F.when(F.col("parse_error").isNull(), items))
        .withColumn("base", F.coalesce(resolve(root, inner), root))
        .withColumn("site", site)
        .drop("__text", "__doc")
    )


def _resolved(entries: DataFrame) -> DataFrame:
    """Links as their documents mean them: relative to `xml:base` if there is one, else to the site.

    The site's address is no declared base: held against it, what looks like a host without
    scheme stays one, as such links occur and mean that.
    """
    link = F.col("url_original")
    hostlike = link.rlike(r"^[^/?#:]+\.[^/?#.:]+(:[0-9]+)?(/|$)") & ~link.rlike(r"(?i)^[^/]*\.(html?|php|aspx?|jsp|xml)$")
    own = F.when(F.col("own_base").isNotNull(), resolve(F.col("base"), F.col("own_base")))
    based = entries.withColumn("base", F.coalesce(own, "base")).withColumn(
        "base", F.when(F.col("base").isNotNull(), F.col("base")).when(~hostlike, F.col("site"))
    )
    return based.withColumn("url_original", resolve(F.col("base"), link)).drop("base", "own_base", "site")


def explode_entries(parsed: DataFrame, *, every_page: bool = False) -> DataFrame:
    """One row per entry of the parsed documents, with its position on the page.

    The outer form keeps the planner from testing for emptiness below the parser, which would
    parse every document a second time. With `every_page`, a page without entries is a row
    without position, and all rows keep what their document is worth.
    """
    kept = [c for c in parsed.columns if c != "items" and (every_page or c not in ("parse_error", "warning"))]
    exploded = parsed.select(*kept, F.posexplode_outer("items").alias("entry_pos", "item"))
    if not every_page:
        exploded = exploded.filter(F.col("item").isNotNull())
    return _resolved(exploded.select(*kept, "entry_pos", "item.*"))


def normalize_entries(entries: DataFrame) -> DataFrame:
    """Canonical URL, cleaned texts, hash and resolved date of raw entries.

    Entries without a usable link keep a NULL `url_canonical` and say why in `reject_reason`.
    """
    staged = (
        canonicalize(entries, "url_original")
        .withColumn("title", F.nullif(clean_title(F.col("title")), F.lit("")))
        .withColumn("author", F.nullif(clean_title(F.col("author")), F.lit("")))
        .withColumn("__summary", sanitize_with_text(F.col("raw_summary")))
        .withColumn(
            "__date",
            resolve_published(
                parse_datetime(F.col("published"), w3c=True),
                parse_datetime(F.col("updated"), w3c=True),
                F.col("fetched_at"),
            ),
        )
        .withColumn("title", F.coalesce("title", "url_canonical"))
    )
    return (
        staged.withColumn("summary_clean", F.col("__summary.clean"))
        .withColumn("content_hash", content_hash(F.col("title"), F.col("__summary.text")))
        .withColumn("published_at", F.col("__date.published_at"))
        .withColumn("date_source", F.col("__date.date_source"))
        .drop("__summary", "__date", "published", "updated")
    )
