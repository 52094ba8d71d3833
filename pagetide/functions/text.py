"""Text normalization: entities, whitespace, content hash."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entity escaped once too often, number of passes, hash field separator.
DOUBLE_ESCAPED = r"&amp;(#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[a-zA-Z][a-zA-Z0-9]{1,31};)"
MAX_PASSES = 3
HASH_SEPARATOR = "\x1f"

# White space as Python's str methods see it: Unicode's, and the four ASCII separators.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_SPACE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680))) + "".join(
    map(chr, (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def trim_ws(value: Column) -> Column:
    """Strip white space at both ends, looking at nothing else."""
    return F.btrim(value, F.lit(_SPACE_CHARS))


def fix_double_escaping(value: Column) -> Column:
    """Turn `&amp;eacute;` into `&eacute;`, up to three levels, leaving lone `&amp;` alone."""
    fixed = value
    for _ in range(MAX_PASSES):
        fixed = F.regexp_replace(fixed, DOUBLE_ESCAPED, "&$1")
    return F.when(value.contains("&amp;"), fixed).otherwise(value)


def normalize_ws(value: Column) -> Column:
    """Collapse white space runs to one space and trim."""
    return F.btrim(F.regexp_replace(value, _SPACE_RUN, " "))


def unescape_fully(value: str) -> str:
    """HTML-unescape three times over; decoding stable text changes nothing."""
    return reduce(lambda text, _: html.unescape(text), range(MAX_PASSES), value)


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(unescape_fully, na_action="ignore")


def unescape_text(value: Column) -> Column:
    """Fully unescape text; only values holding an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(value.contains("&"), value)), value)


def clean_title(value: Column) -> Column:
    return normalize_ws(unescape_text(value))


def content_hash(title: Column, summary_text: Column) -> Column:
    """SHA-256 of normalized title and summary text, insensitive to white space."""
    joined = F.concat(
        normalize_ws(F.coalesce(title, F.lit(""))),
        F.lit(HASH_SEPARATOR),
        normalize_ws(F.coalesce(summary_text, F.lit(""))),
    )
    return F.sha2(joined, 256)
