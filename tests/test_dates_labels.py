from __future__ import annotations

import datetime as dt
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F
from support import at, utc

from pagetide.functions import dates, labels

FETCHED = at("2026-08-19T12:00:00")


def stamps(spark, values, use=dates.parse_datetime):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [utc(r["x"]) for r in frame.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def test_formats(spark):
    cases = {
        "Wed, 19 Aug 2026 15:14:25 +0000": "2026-08-19T15:14:25",
        "Wed, 19 Aug 2026 15:14:25 +0200": "2026-08-19T13:14:25",
        "2026-08-19T15:14:25+00:00": "2026-08-19T15:14:25",
        "2026-08-19T15:14:25Z": "2026-08-19T15:14:25",
        "2026-08-19T15:14:25.250-0730": "2026-08-19T22:44:25.250",
        "2026-08-19 15:14:25": "2026-08-19T15:14:25",
        "2026-08-19": "2026-08-19T00:00:00",
        "19/08/2026 08:30:00": "2026-08-19T08:30:00",
        " 19/08/2026 ": "2026-08-19T00:00:00",
    }
    assert stamps(spark, cases) == [at(v) for v in cases.values()]


def test_unreadable_is_null_and_never_an_error(spark):
    values = ["", "   ", "pas une date", "hier", None, "12:30", "2026-02-30", "2026-13-01", "2026-00-10",
              "32/01/2026", "30 Feb 2026 10:00:00 GMT", "19 Aug 2026 25:00:00 GMT", "19 Foo 2026 10:00:00", "0/0/0000"]
    assert stamps(spark, values) == [None] * len(values)


def test_mail_dates_equal_the_standard_library(spark):
    values = [
        "19 Aug 2026 15:14 EST", "Wed 19 Aug 26 15:14:25 GMT", "August 19, 2026 15:14:25 -0130",
        "Wed,19 August 2026 15:14:25 -0000", "19-Aug-26 15:14:25 GMT", "19 Aug 70 15:14:25 PDT",
        "19 Aug 2026 15:14:25 XYZ", "19 Aug 2026 15:14:25+0200", "1 Jan 2024 1:02:03 UT", "Thu, 01 Jan 1970 00:00:00 +0000",
    ]
    wanted = [parsedate_to_datetime(v) for v in values]
    wanted = [w.replace(tzinfo=dt.UTC) if w.tzinfo is None else w.astimezone(dt.UTC) for w in wanted]
    assert stamps(spark, values) == wanted


def test_atom_forms_only_on_request(spark):
    values = ["2026-08-19T15:14Z", "2026-08-19T15:14:25", "2026-08-19T15:14+02:00"]
    assert stamps(spark, values) == [None] * 3
    loose = stamps(spark, values, lambda c: dates.parse_datetime(c, w3c=True))
    assert loose == [at("2026-08-19T15:14:00"), at("2026-08-19T15:14:25"), at("2026-08-19T13:14:00")]


FALLBACKS = [
    ("2026-08-19T10:00:00", "2026-08-19T11:00:00", "2026-08-19T10:00:00", "published"),
    (None, "2026-08-19T11:00:00", "2026-08-19T11:00:00", "updated"),
    (None, None, "2026-08-19T12:00:00", "fetched"),
    ("2026-09-18T12:00:00", "2026-08-19T11:00:00", "2026-08-19T11:00:00", "updated"),
    ("2026-08-19T13:00:00", None, "2026-08-19T13:00:00", "published"),
    ("2026-08-19T14:00:00", None, "2026-08-19T14:00:00", "published"),
    ("2026-08-19T14:00:01", None, "2026-08-19T12:00:00", "fetched"),
    ("1970-01-01T00:00:00", None, "2026-08-19T12:00:00", "fetched"),
    ("2000-01-01T00:00:00", None, "2000-01-01T00:00:00", "published"),
]


def test_fallback_order(spark):
    rows = [(i, p and at(p), u and at(u), FETCHED) for i, (p, u, _, _) in enumerate(FALLBACKS)]
    frame = spark.createDataFrame(rows, "i int, p timestamp, u timestamp, f timestamp")
    resolved = frame.select("i", dates.resolve_published(F.col("p"), F.col("u"), F.col("f")).alias("r"))
    got = [(utc(x["r"]["published_at"]), x["r"]["date_source"]) for x in resolved.orderBy("i").collect()]
    assert got == [(at(wanted), source) for _, _, wanted, source in FALLBACKS]


def test_relative_dates(spark):
    now = FETCHED
    ages = {
        dt.timedelta(seconds=-5): "à l'instant",
        dt.timedelta(seconds=20): "à l'instant",
        dt.timedelta(minutes=42): "il y a 42 min",
        dt.timedelta(hours=5): "il y a 5 h",
        dt.timedelta(days=1): "hier",
        dt.timedelta(days=4): "il y a 4 jours",
        dt.timedelta(days=20): "il y a 2 sem.",
        dt.timedelta(days=200): "31/01/2026 13:00",
    }
    frame = spark.createDataFrame([(i, now - age, now) for i, age in enumerate(ages)], "i int, v timestamp, n timestamp")
    rows = frame.select("i", dates.relative_date(F.col("v"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == list(ages.values())


def test_report_zone_has_summer_time(spark):
    frame = spark.createDataFrame([(FETCHED,), (at("2026-01-19T12:00:00"),)], "v timestamp")
    rows = frame.select(dates.absolute_date(F.col("v")).alias("a"), dates.datetime_attr(F.col("v")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [
        ("19/08/2026 14:00", "2026-08-19T14:00+02:00"),
        ("19/01/2026 13:00", "2026-01-19T13:00+01:00"),
    ]


def test_durations_round_as_python_does(spark):
    minutes = list(range(0, 20_000, 7)) + list(range(60, 3000))

    def spoken(m):
        if m < 1:
            return f"{m * 60} s"
        if m < 60:
            return f"{m} min"
        hours = m / 60
        return (f"{hours:.1f} h" if hours < 48 else f"{hours / 24:.1f} j").replace(".0 ", " ")

    frame = spark.createDataFrame([(i, m * 60_000_000) for i, m in enumerate(minutes)], "i int, us long")
    rows = frame.select("i", dates.duration(F.col("us")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [spoken(m) for m in minutes]
    assert spark.range(1).select(dates.duration(F.lit(None).cast("long"))).first()[0] == "—"


def test_error_kinds(spark):
    cases = {
        "FetchError: hn-sec : HTTP 502": "reseau",
        "FeedParseError: flux illisible": "flux",
        "InvalidUrlError: schema interdit": "flux",
        "ProgrammingError: colonne": "interne",
        "flux degrade : encodage": "",
        "": "",
    }
    frame = spark.createDataFrame([*enumerate(cases), (99, None)], "i int, v string")
    rows = frame.select("i", labels.error_kind(F.col("v")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [*cases.values(), ""]
    other = spark.range(1).select(labels.error_kind(F.lit("OtherError: x"), {"OtherError": "flux"}))
    assert other.first()[0] == "flux"


def test_labels(spark):
    row = spark.range(1).select(
        labels.lang_label(F.lit("fr")), labels.lang_label(F.lit("de")), labels.topic_label(F.lit("both")),
        labels.source_label(F.lit("other")), labels.gap_label(F.lit("suspected")), labels.gap_label(F.lit(None).cast("string")),
        labels.error_kind_label(F.lit("FetchError: x")),
    ).first()
    assert tuple(row) == ("FR", "DE", "IA + Cyber", "other", "trou suspecte", "", "réseau")
