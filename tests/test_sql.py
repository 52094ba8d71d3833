"""SQL functions against the column functions that they are made of."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagetide.functions import sql, urls

ADDRESSES = [
    "https://m.a.test//x/../y/./amp/?utm_a=1&b=2&a=%41", "HTTP://USER:p@B\u00fccher.example:8080/%7Ez?q='it''s\\'", "//h.test", "ftp://x.test/",
    "h.test:99999", "[::1]/x", "", None, "x" * 3000, "https://a.test/?a=1&a=0&&=", "https://a.test/\u00e9#f",
]
TEXTS = ["<p>It's &amp; <b>so</b></p>", "FetchError: x", "KeyError: y", "Mon, 02 Jan 2023 03:04:05 +0200", "2024-02-30", "fr", "", None, "a \n\t b" * 90]


def test_canonical_urls(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(x,) for x in ADDRESSES], "raw string")
    wanted = urls.canonicalize(frame, "raw").select("raw", "url_canonical", "reject_reason").collect()
    found = spark.sql("SELECT raw, c.url_canonical, c.reject_reason FROM (SELECT raw, canonicalize(raw) AS c FROM {frame})", frame=frame).collect()
    assert found == wanted


@pytest.mark.parametrize("name", sorted(n for n, (p, *_) in sql.SCALARS.items() if list(p.values()) == ["string"]))
def test_functions_of_a_text(spark, name):
    sql.register(spark)
    frame = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    own = frame.select(sql.SCALARS[name][2](F.col("x")).alias("y")).collect()
    assert spark.sql(f"SELECT {name}(x) AS y FROM {{frame}}", frame=frame).collect() == own


def test_functions_of_times(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT relative_date(TIMESTAMP '2031-01-01 00:00:00', TIMESTAMP '2031-01-03 12:00:00') AS a, duration_text(3600000000) AS b, "
        "resolve_link('http://a.test/b/c', '../d') AS c, resolve_published(NULL, parse_feed_date('2031-01-02T03:04:05Z'), TIMESTAMP '2031-02-01 00:00:00').date_source AS d"
    ).first()
    assert tuple(row) == ("il y a 2 jours", "1 h", "http://a.test/d", "updated")
