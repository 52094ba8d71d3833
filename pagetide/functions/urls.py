"""URL canonicalization as column expressions over a table.

The canonical URL is the deduplication key and the link shown to readers, so only changes
that keep it reachable are made. The address is cut by one RFC 3986 pattern instead of
`parse_url`, which keeps host case and rejects characters that occur in real feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.binding import bind

# Limits, implicit ports, host prefixes and tracking parameters.
MAX_URL_LENGTH = 2048
ALLOWED_SCHEMES = ("http", "https")
DEFAULT_PORTS = (80, 443)
MOBILE_HOST_PREFIXES = ("m.", "amp.")
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_", "_ga", "at_custom")
TRACKING_EXACT = (
    "fbclid",
    "gclid",
    "gbraid",
    "wbraid",
    "dclid",
    "msclkid",
    "yclid",
    "igshid",
    "mc_cid",
    "mc_eid",
    "_hsenc",
    "_hsmi",
    "vero_id",
    "oly_enc_id",
    "ck_subscriber_id",
    "ref",
    "source",
    "cmpid",
    "ncid",
    "spm",
    "at_medium",
    "at_campaign",
    "amp",
    "outputtype",
)

# Reasons given for a URL that has no canonical form.
REJECT_MISSING = "missing"
REJECT_TOO_LONG = "too_long"
REJECT_SCHEME = "scheme"
REJECT_HOST = "host"
REJECT_PORT = "port"

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_PARTS = r"^(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _ascii_host(host: Column) -> Column:
    """Punycode of an international host; one that cannot be encoded is kept as it is."""
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.coalesce(F.when(host.rlike(r"[^\x00-\x7f]"), encoded), host)


def _without_mobile_prefix(host: Column) -> Column:
    """Strip one mobile prefix, but only when a full domain is left behind it."""
    prefixes = "|".join(prefix.replace(".", r"\.") for prefix in MOBILE_HOST_PREFIXES)
    return F.regexp_replace(host, rf"^(?:{prefixes})(?=.*\.)", "")


def _settle_percent(path: Column) -> Column:
    """Decode escapes of unreserved characters and upper-case the other escapes.

    Cutting at every '%' turns the scan into one pass over an array: each piece but the
    first opens with the two hexadecimal digits of its escape, or is no escape at all.
    """

    def settle(piece: Column) -> Column:
        code = F.conv(F.substring(piece, 1, 2), 16, 10).cast("int")
        rest = F.substring(piece, 3, MAX_URL_LENGTH)
        return (
            F.when(~piece.rlike(r"^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), piece))
            .when(F.char(code).rlike(r"^[A-Za-z0-9\-._~]$"), F.concat(F.char(code), rest))
            .otherwise(F.concat(F.lit("%"), F.upper(F.substring(piece, 1, 2)), rest))
        )

    def rejoin(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, 2, MAX_URL_LENGTH), settle)
        return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

    settled = bind(F.split(path, "%", -1), rejoin)
    return F.when(path.contains("%"), settled).otherwise(path)


def _resolve_dots(segments: Column) -> Column:
    """Apply '..' by folding the segments over a stack."""

    def push(stack: Column, segment: Column) -> Column:
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(segment == "..", popped).otherwise(F.array_append(stack, segment))

    folded = F.aggregate(segments, F.array().cast("array<string>"), push)
    return F.when(F.array_contains(segments, ".."), folded).otherwise(segments)


def canonical_path(path: Column) -> Column:
    """Path without empty or dot segments, trailing slash and one final `amp` segment."""
    segments = F.filter(F.split(path, "/", -1), lambda segment: ~segment.isin("", "."))
    joined = bind(bind(segments, lambda kept: F.array_join(_resolve_dots(kept), "/")), _settle_percent)
    # The root has no segments; any other path gets its leading slash back.
    return F.regexp_replace(F.regexp_replace(joined, r"(?i)(^|/)amp$", ""), "^(?=.)", "/")


def _decode_component(text: Column) -> Column:
    """Form decoding that keeps a '%' which opens no escape."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode_component(text: Column) -> Column:
    """Percent encoding of all but RFC 3986 unreserved characters."""
    encoded = F.url_encode(text)
    for java, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(java), F.lit(wanted))
    return encoded


def _is_tracking(key: Column) -> Column:
    lowered = F.lower(key)
    prefixed = lowered.rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    return lowered.isin(*TRACKING_EXACT) | prefixed


def canonical_query(query: Column) -> Column:
    """Parameters without tracking, ordered by key and value, encoded anew."""
    pieces = F.filter(F.split(query, "&", -1), lambda piece: piece != "")
    pairs = F.transform(
        pieces,
        lambda piece: F.struct(
            _decode_component(F.substring_index(piece, "=", 1)).alias("key"),
            _decode_component(F.regexp_replace(piece, r"^[^=]*=?", "")).alias("value"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda pair: ~_is_tracking(pair["key"])))
    encoded = F.transform(
        kept,
        lambda pair: F.concat(
            _encode_component(pair["key"]), F.lit("="), _encode_component(pair["value"])
        ),
    )
    return F.array_join(encoded, "&")


_REFERENCE = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _cut(address: Column) -> Column:
    """Scheme, authority, path, query and fragment of an address, with their separators."""
    names = ("scheme", "authority", "path", "query", "fragment")
    parts = [F.regexp_extract(address, _REFERENCE, i + 1).alias(name) for i, name in enumerate(names)]
    after = F.regexp_replace(address, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", "")
    return F.struct(*parts, after.startswith("//").alias("has_authority"))


def without_dots(path: Column) -> Column:
    """An absolute path with its '.' and '..' segments applied; a final one leaves a slash."""

    def push(stack: Column, segment: Column) -> Column:
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return (
            F.when(segment == "..", popped).when(segment == ".", stack).otherwise(F.array_append(stack, segment))
        )

    def settle(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), push)
        ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(ended, "/"))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), bind(F.split(F.regexp_replace(path, "^/", ""), "/", -1), settle)).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """The address that `reference` means in a document with this base, after RFC 3986, section 5.2.

    A base that is no absolute address with an authority resolves nothing, and neither does a
    NULL base; absolute references stand for themselves. White space around and line breaks within
    a reference, which feeds have from layout, do not count.
    """
    bare = F.regexp_replace(F.regexp_replace(reference, r"[\t\r\n]", ""), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    both = F.struct(_cut(F.trim(base)).alias("b"), _cut(bare).alias("r"), bare.alias("text"))

    def merge(x: Column) -> Column:
        b, r = x["b"], x["r"]
        root = F.concat(b["scheme"], F.lit("://"), b["authority"])
        # all of the base's path up to its last slash, then the reference's own
        folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_replace(b["path"], "[^/]*$", ""))
        merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))
        own = F.concat(r["query"], r["fragment"])
        return (
            F.when((b["scheme"] == "") | ~b["has_authority"] | (r["scheme"] != ""), x["text"])
            .when(
                r["has_authority"],
                F.concat(b["scheme"], F.lit("://"), r["authority"], without_dots(r["path"]), own),
            )
            .when(r["path"] != "", F.concat(root, without_dots(merged), own))
            .when(r["query"] != "", F.concat(root, b["path"], own))
            .otherwise(F.concat(root, b["path"], b["query"], r["fragment"]))
        )

    return F.when(base.isNull(), reference).otherwise(bind(both, merge))


def canonical_steps(url: Column, into: str, reason: str) -> list[tuple[str, Column]]:
    """The columns that lead to the canonical form, each made of those before it; the last two stay."""
    bare, scheme, parts, host, port, early = (
        f"__{into}_{n}" for n in ("bare", "scheme", "parts", "host", "port", "early")
    )
    draft = f"__{into}_draft"
    found = F.lower(F.regexp_extract(F.col(bare), _SCHEME, 1))
    # What follows the scheme; a missing scheme means the text starts with the host.
    remainder = (
        F.when(F.col(bare).startswith("//"), F.col(bare))
        .when(F.col(scheme) == "", F.concat(F.lit("//"), F.col(bare)))
        .otherwise(F.regexp_replace(F.col(bare), _SCHEME, ""))
    )
    steps = [
        (bare, F.regexp_replace(url, r"[\x00-\x20\x7f]", "")),
        (scheme, F.when(F.col(bare).startswith("//"), "").otherwise(found)),
        (
            parts,
            F.struct(
                # User information ends at the last '@'.
                F.regexp_replace(F.regexp_extract(remainder, _PARTS, 1), "^.*@", "").alias("authority"),
                F.regexp_extract(remainder, _PARTS, 2).alias("path"),
                F.regexp_extract(remainder, _PARTS, 3).alias("query"),
            ),
        ),
    ]
    authority = F.col(parts)["authority"]
    bracketed = authority.startswith("[")
    bare_host = F.when(bracketed, F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(
        F.substring_index(authority, ":", 1)
    )
    bare_port = F.when(bracketed, F.regexp_extract(authority, r"^\[[^\]]*\]:(.*)$", 1)).otherwise(
        F.regexp_extract(authority, r"^[^:]*:(.*)$", 1)
    )
    number = F.when(F.col(port).rlike("^[0-9]{1,9}$"), F.col(port).cast("int"))
    shown_port = F.when(
        (number > 0) & ~number.isin(*DEFAULT_PORTS), F.concat(F.lit(":"), number.cast("string"))
    ).otherwise("")
    query = canonical_query(F.col(parts)["query"])
    assembled = F.concat(
        F.lit("https://"),
        F.col(host),
        shown_port,
        canonical_path(F.col(parts)["path"]),
        F.regexp_replace(query, r"^(?=.)", "?"),
    )
    good_port = (F.col(port) == "") | (F.col(port).rlike("^[0-9]+$") & number.between(0, 65535))
    refused = (
        F.when(F.col(bare).isNull() | (F.col(bare) == ""), REJECT_MISSING)
        .when(F.length(bare) > MAX_URL_LENGTH, REJECT_TOO_LONG)
        .when(~F.col(scheme).isin("", *ALLOWED_SCHEMES), REJECT_SCHEME)
        .when((F.col(host) == "") | authority.rlike(r"^\[[^\]]*$|^[^\[]+\[|^[^\[]*\]"), REJECT_HOST)
        .when(~F.coalesce(good_port, F.lit(False)), REJECT_PORT)
    )
    return [
        *steps,
        (host, _without_mobile_prefix(_ascii_host(F.regexp_replace(F.lower(bare_host), r"\.+$", "")))),
        (port, bare_port),
        (early, refused),
        (draft, F.when(F.col(early).isNull(), assembled)),
        (reason, F.when(F.length(draft) > MAX_URL_LENGTH, REJECT_TOO_LONG).otherwise(F.col(early))),
        (into, F.when(F.col(reason).isNull(), F.col(draft))),
    ]


def canonicalize(
    df: DataFrame, url: str, *, into: str = "url_canonical", reason: str = "reject_reason"
) -> DataFrame:
    """Add the canonical form of column `url`, or NULL and the reason why there is none."""
    steps = canonical_steps(F.col(url), into, reason)
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop(*(name for name, _ in steps[:-2]))
