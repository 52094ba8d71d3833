"""Display labels and error classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label tables.
LANG_LABELS = {"fr": "FR", "en": "EN"}
TOPIC_LABELS = {"ai": "IA", "sec": "Cyber", "both": "IA + Cyber"}
SOURCE_LABELS = {
    "media": "média",
    "vendor": "éditeur",
    "official": "officiel",
    "community": "communauté",
}
GAP_LABELS = {"none": "aucun trou", "suspected": "trou suspecte", "unknown": "indetermine"}

# Exception name opening a run's message -> kind of failure, and its label.
ERROR_KINDS = {
    "FetchError": "reseau",
    "FeedParseError": "flux",
    "InvalidUrlError": "flux",
}
ERROR_KIND_LABELS = {"reseau": "réseau", "flux": "flux", "interne": "interne"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def lang_label(value: Column) -> Column:
    return F.coalesce(_lookup(LANG_LABELS, value), F.upper(value))


def topic_label(value: Column) -> Column:
    return F.coalesce(_lookup(TOPIC_LABELS, value), value)


def source_label(value: Column) -> Column:
    return F.coalesce(_lookup(SOURCE_LABELS, value), value)


def gap_label(value: Column) -> Column:
    return F.coalesce(_lookup(GAP_LABELS, value), F.lit(""))


def error_kind(message: Column, more_kinds: dict[str, str] | None = None) -> Column:
    """'reseau', 'flux', 'interne' or '' from the exception name that opens the message.

    `more_kinds` classifies exception names of other collectors whose run logs are read.
    """
    name = F.trim(F.substring_index(message, ":", 1))
    return F.coalesce(
        _lookup(ERROR_KINDS | (more_kinds or {}), name),
        F.when(name.endswith("Error"), "interne"),
        F.lit(""),
    )


def error_kind_label(message: Column, more_kinds: dict[str, str] | None = None) -> Column:
    return F.coalesce(_lookup(ERROR_KIND_LABELS, error_kind(message, more_kinds)), F.lit(""))
