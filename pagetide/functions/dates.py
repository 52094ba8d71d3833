"""Publication dates: lenient parsing, plausibility, fallback order, report formats.

Every pattern is guarded by a regular expression and assembled piece by piece, so
an unreadable date is NULL and never an error, and no clock is read: `fetched_at` and `now`
are columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.binding import bind
from pagetide.functions.text import trim_ws

# Plausibility bounds and the test for a page without chronology.
MAX_FUTURE_SKEW = "INTERVAL 2 HOURS"
MIN_PLAUSIBLE = "2000-01-01 00:00:00+00:00"
DEGENERATE_SPAN = "INTERVAL 5 MINUTES"
DEGENERATE_MIN_ENTRIES = 5

# Month names of mail dates, and zone names with their offset in hours.
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
ZONE_HOURS = {
    "AST": -4,
    "ADT": -3,
    "EST": -5,
    "EDT": -4,
    "CST": -6,
    "CDT": -5,
    "MST": -7,
    "MDT": -6,
    "PST": -8,
    "PDT": -7,
}

# Time zone and patterns of displayed dates.
REPORT_ZONE = "Europe/Paris"
ABSOLUTE_FORMAT = "dd/MM/yyyy HH:mm"
LOCAL_MINUTES_FORMAT = "yyyy-MM-dd'T'HH:mm"

# Each accepted form with the rewriting that brings it to `year|month|day|h|m|s|fraction|zone`.
_WEEKDAY = r"(?:[^\s,]*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?"
_ZONE = r"(?:\s*([+-]\d{1,4})\b|\s+([a-z]+))?"
_YMD = r"(\d{4})-(\d{1,2})-(\d{1,2})"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})"
_FORMS = (
    (
        rf"(?i)^{_WEEKDAY}(\d{{1,2}}),?[\s-]+([a-z]+)[\s-]+(\d{{2,4}}),?\s+{_CLOCK}{_ZONE}.*$",
        "$3|$2|$1|$4|$5|$6||$7$8",
    ),
    (
        rf"(?i)^{_WEEKDAY}([a-z]+)\s+(\d{{1,2}}),?\s+(\d{{2,4}}),?\s+{_CLOCK}{_ZONE}.*$",
        "$3|$1|$2|$4|$5|$6||$7$8",
    ),
    (
        rf"^{_YMD}T(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})(?:\.(\d{{1,6}}))?{_OFFSET}$",
        "$1|$2|$3|$4|$5|$6|$7|$8",
    ),
    (rf"^{_YMD}(?: (\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}}))?$", "$1|$2|$3|$4|$5|$6||"),
    (
        r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?$",
        "$3|$2|$1|$4|$5|$6||",
    ),
)
# Atom dates (W3C profile of ISO 8601) may omit seconds or zone.
_W3C_FORM = (rf"^{_YMD}T(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:\.\d+)?)?{_OFFSET}?$", "$1|$2|$3|$4|$5|$6||$7")

# Machine-written times: a full date, at least the hour, and the offset.
_ZONED_FORM = (
    r"^(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2})?)$",
    "$1|$2|$3|$4|$5|$6|$7|$8",
)


def _whole(text: Column) -> Column:
    """Integer of a digit string, NULL for other text. A failing `try_cast` costs an exception."""
    return F.when(text.rlike(r"^[+-]?\d{1,9}$"), text.cast("int"))


def _month_number(month: Column) -> Column:
    named = F.lower(month)
    short = F.lit([name[:3] for name in MONTHS])
    by_name = F.greatest(F.array_position(F.lit(list(MONTHS)), named), F.array_position(short, named))
    return F.coalesce(_whole(month), by_name.cast("int"))


def _zone_seconds(zone: Column) -> Column:
    """Seconds ahead of UTC of a numeric or named zone; unknown or absent zones are UTC."""

    def of_number(digits: Column) -> Column:
        # A bare two-digit offset counts hours, as do the leading digits of longer ones.
        size = F.abs(digits)
        return F.signum(digits).cast("int") * (F.floor(size / 100) * 3600 + size % 100 * 60).cast("int")

    compact = F.replace(zone, F.lit(":"), F.lit(""))
    four_digits = F.when(F.length(compact) == 3, F.rpad(compact, 5, "0")).otherwise(compact)
    hours = F.create_map(*(F.lit(x) for pair in ZONE_HOURS.items() for x in pair))[F.upper(zone)]
    numeric = bind(_whole(four_digits), of_number)
    return F.when(zone == "", 0).otherwise(F.coalesce(numeric, hours * 3600, F.lit(0)))


def _from_fields(fields: Column) -> Column:
    """Timestamp of the eight text fields; NULL when they name no real instant."""
    year, month, day, hour, minute, second, fraction, zone = (
        F.element_at(fields, i) for i in range(1, 9)
    )
    clock = (F.coalesce(_whole(part), F.lit(0)) for part in (hour, minute, second))
    micros = F.when(fraction == "", 0).otherwise(_whole(F.rpad(fraction, 6, "0")))
    numbers = F.array(_whole(year), _month_number(month), _whole(day), *clock, micros, _zone_seconds(zone))
    return bind(numbers, _from_numbers)


def _from_numbers(numbers: Column) -> Column:
    year, month, day, hour, minute, second, micros, ahead = (
        F.element_at(numbers, i) for i in range(1, 9)
    )
    full_year = (
        F.when(year > 99, year).when(year > 68, year + 1900).when(year >= 0, year + 2000)
    )
    first_day = F.when(month.between(1, 12), F.make_date(full_year, month, F.lit(1)))
    # Tested beforehand: impossible dates are common in feeds, and an exception per row is slow.
    possible = (hour < 24) & (minute < 60) & (second < 60) & day.between(1, F.day(F.last_day(first_day)))
    local = F.unix_seconds(
        F.make_timestamp(full_year, month, day, hour, minute, second.cast("decimal(8,6)"), F.lit("UTC"))
    )
    return F.when(possible, F.timestamp_micros((local - ahead) * 1_000_000 + micros))


def parse_datetime(value: Column, *, w3c: bool = False) -> Column:
    """Feed date to UTC timestamp: mail dates, ISO 8601, then day-first dates; else NULL.

    `w3c` also reads the ISO forms without seconds or zone that Atom documents use. Dates
    without a zone are UTC.
    """

    def normal_form(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for pattern, rewriting in reversed((*_FORMS, _W3C_FORM) if w3c else _FORMS):
            found = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, rewriting)).otherwise(found)
        return found

    return bind(
        trim_ws(value),
        lambda text: bind(F.split(normal_form(text), r"\|", -1), _from_fields),
    )


def parse_zoned(value: Column) -> Column:
    """ISO 8601 time that states its offset, as UTC; NULL for anything else."""
    pattern, rewriting = _ZONED_FORM
    normal_form = F.when(value.rlike(pattern), F.regexp_replace(value, pattern, rewriting))
    return bind(F.split(normal_form, r"\|", -1), _from_fields)


def is_plausible(value: Column, fetched_at: Column) -> Column:
    """Neither before the year 2000 nor further ahead of the fetch than a wrong clock explains."""
    earliest = F.lit(MIN_PLAUSIBLE).cast("timestamp")
    return (value >= earliest) & (value <= fetched_at + F.expr(MAX_FUTURE_SKEW))


def resolve_published(published: Column, updated: Column, fetched_at: Column) -> Column:
    """Struct (published_at, date_source) of the first plausible date, else the fetch time.

    `published` and `updated` are parsed timestamps.
    """

    def choice(value: Column, source: str) -> Column:
        return F.struct(value.alias("published_at"), F.lit(source).alias("date_source"))

    def first_plausible(dates: Column) -> Column:
        return (
            F.when(is_plausible(dates["published"], fetched_at), choice(dates["published"], "published"))
            .when(is_plausible(dates["updated"], fetched_at), choice(dates["updated"], "updated"))
            .otherwise(choice(fetched_at, "fetched"))
        )

    return bind(F.struct(published.alias("published"), updated.alias("updated")), first_plausible)


def is_degenerate(n_dated: Column, oldest: Column, newest: Column) -> Column:
    """A page of at least five dates within five minutes carries its generation time."""
    return F.coalesce(
        (n_dated >= DEGENERATE_MIN_ENTRIES) & (newest < oldest + F.expr(DEGENERATE_SPAN)),
        F.lit(False),
    )


def to_paris(value: Column) -> Column:
    """Local wall-clock time of the reports; stored values stay UTC."""
    return F.from_utc_timestamp(value, REPORT_ZONE)


def absolute_date(value: Column) -> Column:
    return F.date_format(to_paris(value), ABSOLUTE_FORMAT)


def datetime_attr(value: Column) -> Column:
    """ISO 8601 minutes with the report zone's offset."""

    def written(local: Column) -> Column:
        offset = ((F.unix_micros(local) - F.unix_micros(value)) / 60_000_000).cast("int")
        sign = F.when(offset < 0, "-").otherwise("+")
        hours = F.lpad(F.floor(F.abs(offset) / 60).cast("string"), 2, "0")
        minutes = F.lpad((F.abs(offset) % 60).cast("string"), 2, "0")
        return F.concat(F.date_format(local, LOCAL_MINUTES_FORMAT), sign, hours, F.lit(":"), minutes)

    return bind(to_paris(value), written)


def relative_date(value: Column, now: Column) -> Column:
    """French relative date; beyond 60 days the absolute one."""

    def since(micros: Column, seconds: int, unit: str) -> Column:
        count = F.floor(micros / (seconds * 1_000_000)).cast("string")
        return F.concat(F.lit("il y a "), count, F.lit(unit))

    def worded(micros: Column) -> Column:
        def below(seconds: int) -> Column:
            return micros < seconds * 1_000_000

        return (
            F.when(below(60), "à l'instant")
            .when(below(3600), since(micros, 60, " min"))
            .when(below(86400), since(micros, 3600, " h"))
            .when(below(2 * 86400), "hier")
            .when(below(7 * 86400), since(micros, 86400, " jours"))
            .when(below(60 * 86400), since(micros, 7 * 86400, " sem."))
            .otherwise(absolute_date(value))
        )

    return F.when(value.isNotNull(), bind(F.unix_micros(now) - F.unix_micros(value), worded))


def _nearest_tenth(minutes: Column, minutes_per_unit: int) -> Column:
    """Tenths of a unit, rounded as the binary floating-point quotient rounds.

    Only a quotient ending in exactly five hundredths is open: there the double may lie
    above or below the decimal value, or on it, and then the even tenth is taken. Cutting the
    double in two keeps the comparison free of rounding.
    """
    step = minutes_per_unit // 10
    down, rest = F.floor(minutes / step), minutes % step
    quotient = minutes.cast("double") / 60
    if minutes_per_unit > 60:
        quotient = quotient / (minutes_per_unit // 60)
    high = quotient.cast("float").cast("double")
    above = (high * 20 - (down * 2 + 1).cast("double")) + (quotient - high) * 20
    tie_up = bind(above, lambda sign: (sign > 0) | ((sign == 0) & (down % 2 == 1)))
    return down + ((rest * 2 > step) | ((rest * 2 == step) & tie_up)).cast("int")


def _one_decimal(minutes: Column, minutes_per_unit: int, unit: str) -> Column:
    def written(tenths: Column) -> Column:
        decimal = F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise("")
        return F.concat(F.floor(tenths / 10).cast("string"), decimal, F.lit(f" {unit}"))

    return bind(_nearest_tenth(minutes, minutes_per_unit), written)


def duration(micros: Column) -> Column:
    """Readable duration of integer microseconds; a missing measure is a dash, not zero."""
    # Integer part truncated towards zero.
    seconds = (micros / 1_000_000).cast("long")

    def longer(minutes: Column) -> Column:
        return (
            F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
            .when(minutes < 48 * 60, _one_decimal(minutes, 60, "h"))
            .otherwise(_one_decimal(minutes, 24 * 60, "j"))
        )

    return (
        F.when(micros.isNull(), "—")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s")))
        .otherwise(bind(F.floor(seconds / 60), longer))
    )
