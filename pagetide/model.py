"""Table schemas and the value domains of their enumerated columns."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerated domains of the data model.
LANGS = ("fr", "en")
TOPICS = ("ai", "sec", "both")
SOURCE_TYPES = ("media", "vendor", "official", "community")
DATE_SOURCES = ("published", "updated", "fetched")
RUN_STATUSES = ("ok", "not_modified", "error")
GAP_STATUSES = ("none", "suspected", "unknown")
MISSED_REASONS = ("docker_unavailable", "lock_held", "wrapper_error")

# Runs with these statuses prove that the feed was reached.
CLOSING_STATUSES = ("ok", "not_modified")

# Fixed value: length of the hexadecimal content hash.
CONTENT_HASH_LENGTH = 64


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _I, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)

FEED = _struct(
    ("feed_id", _L, False),
    ("slug", _S, False),
    ("name", _S, False),
    ("url", _S, False),
    ("lang", _S, False),
    ("topic", _S, False),
    ("source_type", _S, False),
    ("is_active", _B, False),
    ("etag", _S, True),
    ("last_modified", _S, True),
    ("created_at", _TS, False),
    ("updated_at", _TS, False),
)

ARTICLE = _struct(
    ("url_canonical", _S, False),
    ("first_feed_id", _L, False),
    ("title", _S, False),
    ("author", _S, True),
    ("raw_summary", _S, True),
    ("summary_clean", _S, True),
    ("content_hash", _S, False),
    ("published_at", _TS, False),
    ("date_source", _S, False),
    ("first_seen_at", _TS, False),
    ("last_seen_at", _TS, False),
    ("updated_at", _TS, False),
    ("embedding", T.ArrayType(T.FloatType()), True),
)

ARTICLE_FEED = _struct(
    ("url_canonical", _S, False),
    ("feed_id", _L, False),
    ("guid", _S, True),
    ("url_original", _S, False),
    ("first_seen_at", _TS, False),
    ("last_seen_at", _TS, False),
)

FEED_RUN = _struct(
    ("feed_id", _L, False),
    ("started_at", _TS, False),
    ("finished_at", _TS, True),
    ("status", _S, False),
    ("http_status", T.ShortType(), True),
    ("n_new", _I, False),
    ("n_seen", _I, False),
    ("error_message", _S, True),
    ("gap_status", _S, False),
    ("oldest_in_page", _TS, True),
    ("prev_max_published", _TS, True),
)

MISSED_RUN = _struct(
    ("attempted_at", _TS, False),
    ("reason", _S, False),
    ("detail", _S, True),
    ("drained_at", _TS, False),
)

DECLARATION = _struct(
    ("id", _S, True),
    ("name", _S, True),
    ("url", _S, True),
    ("lang", _S, True),
    ("topic", _S, True),
    ("source_type", _S, True),
)

# One row per response received for a run; a run has one or more attempts.
FETCH_LOG = _struct(
    ("feed_id", _L, False),
    ("run_id", _L, False),
    ("feed_pos", _I, False),
    ("started_at", _TS, False),
    ("attempt", _I, False),
    ("http_status", _I, True),
    ("transport_error", _S, True),
    ("body", T.BinaryType(), True),
    ("etag", _S, True),
    ("last_modified", _S, True),
    ("fetched_at", _TS, True),
)
