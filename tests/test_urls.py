from __future__ import annotations

import random
from itertools import product
from urllib.parse import parse_qsl, quote, urlencode

import pytest
from pyspark.sql import functions as F

from pagetide.functions.urls import canonical_query, canonicalize

BASE = "https://journal.test/rubrique/papier?n=7"
# Independent ways to write the same address; every combination must lead back to BASE.
SCHEMES = ("https://", "http://", "HTTP://", "//", "")
HOSTS = ("journal.test", "JOURNAL.test", "m.journal.test", "amp.journal.test", "nom@journal.test", "journal.test.")
PATHS = ("/rubrique/papier", "/rubrique/papier/", "/rubrique//papier", "/x/../rubrique/./papier", "/rubrique/papier/amp", "/%72ubrique/papier")
QUERIES = ("?n=7", "?utm_id=q&n=7", "?n=7&UTM_term=&gclid=k", "?fbclid=9&n=%37")
TAILS = ("", "#suite", "  ")

# One rule each: (raw, canonical).
RULES = [
    ("https://depot.test", "https://depot.test"),
    ("https://depot.test/?", "https://depot.test"),
    ("https://www.depot.test/Casse/Gardee", "https://www.depot.test/Casse/Gardee"),
    ("https://depot.test:443/t", "https://depot.test/t"),
    ("http://depot.test:80/t", "https://depot.test/t"),
    ("http://depot.test:/t", "https://depot.test/t"),
    ("http://depot.test:8443/t", "https://depot.test:8443/t"),
    ("https://m.io/t", "https://m.io/t"),
    ("https://amp.kiosque.depot.test/t", "https://kiosque.depot.test/t"),
    ("https://bücher.test/ü", "https://xn--bcher-kva.test/ü"),
    ("https://depot.test/na%C3%AFf", "https://depot.test/na%C3%AFf"),
    ("https://depot.test/x%5Fy%3fz", "https://depot.test/x_y%3Fz"),
    ("https://depot.test/%5%6A%g1", "https://depot.test/%5j%g1"),
    ("https://depot.test/t/%41mp", "https://depot.test/t"),
    ("https://depot.test/../../t/..", "https://depot.test"),
    ("https://depot.test/t?w=2&w=10&v=z", "https://depot.test/t?v=z&w=10&w=2"),
    ("https://depot.test/t?k=5%qq&j&=8&&k=0", "https://depot.test/t?=8&j=&k=0&k=5%25qq"),
    ("http://[2001:db8::2]:90/t", "https://2001:db8::2:90/t"),
]

REJECTED = [
    ("file:///etc/hosts", "scheme"),
    ("tel:+33100000000", "scheme"),
    ("blob:https://depot.test/t", "scheme"),
    ("depot:9000/t", "scheme"),
    ("", "missing"),
    (" \t ", "missing"),
    (None, "missing"),
    ("https://depot.test/" + "z" * 2100, "too_long"),
    ("http:///t", "host"),
    ("https://depot.test:8x/t", "port"),
    ("https://depot.test:65536/t", "port"),
    ("https://[2001:db8::2/t", "host"),
]


def run(spark, raws):
    frame = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    rows = canonicalize(frame, "raw").orderBy("i").collect()
    return [(row["url_canonical"], row["reject_reason"]) for row in rows]


def test_all_ways_of_writing_meet(spark):
    raws = ["".join(parts) for parts in product(SCHEMES, HOSTS, PATHS, QUERIES, TAILS)]
    # without a scheme, "//" or userinfo, a first dot tells a host from a path
    assert {x for x in run(spark, raws)} == {(BASE, None)}


def test_rules(spark):
    assert run(spark, [raw for raw, _ in RULES]) == [(url, None) for _, url in RULES]


def test_canonical_urls_are_stable(spark):
    canonical = [BASE, *(url for _, url in RULES if "db8" not in url)]
    assert [url for url, _ in run(spark, canonical)] == canonical


def test_rejections(spark):
    assert run(spark, [raw for raw, _ in REJECTED]) == [(None, reason) for _, reason in REJECTED]


def test_canonical_form_that_grows_too_long_is_rejected(spark):
    url = "https://depot.test/t?w=" + "ü" * 900
    assert run(spark, [url]) == [(None, "too_long")]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_encoding_equals_the_standard_library(spark, seed):
    """Random queries without tracking parameters, against the form codec of the stdlib."""
    rng = random.Random(seed)
    alphabet = "abz019-._~*+ %&=/?:@!$'(),;éß€%20%C3%A9%zz"
    queries = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(queries)), "i int, q string")
    rows = frame.select("i", canonical_query(F.col("q")).alias("c")).orderBy("i").collect()
    for raw, row in zip(queries, rows, strict=True):
        assert row["c"] == urlencode(sorted(parse_qsl(raw, keep_blank_values=True)), quote_via=quote), raw
