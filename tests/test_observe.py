from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from support import at, utc

from pagetide.operators import observe

BASE = at("2024-01-01T00:00:00")
SCHEMA = (
    "feed_id long, run_id long, seq long, seen_at timestamp, url_canonical string, url_original string, "
    "guid string, title string, author string, raw_summary string, summary_clean string, "
    "content_hash string, published_at timestamp, date_source string"
)


def random_log(rng, n_runs=60, hot=0.5):
    """Pages of a few feeds; one URL is on half of them, and texts flip between versions."""
    rows, seq = [], 0
    for run in range(n_runs):
        feed = rng.randint(1, 4)
        seen = BASE + timedelta(minutes=17 * run)
        for _ in range(rng.randint(0, 6)):
            url = "hot" if rng.random() < hot else f"u{rng.randint(0, 12)}"
            version = rng.choice(["a", "b", "c", None])
            rows.append((
                feed, run, seq, seen, url, f"{url}?{seq}", rng.choice([None, f"g{seq}"]), f"t-{version}-{seq}", f"by {seq}",
                None, f"s{seq}", version, BASE - timedelta(hours=rng.randint(0, 99)), rng.choice(["published", "fetched"]),
            ))
            seq += 1
    return rows


def sequential(rows):
    """The rules applied one observation at a time."""
    articles, sightings, seen_pages = {}, {}, set()
    counts = {}
    for row in rows:
        r = dict(zip(OBSERVED_ORDER, row, strict=True))
        page, url = (r["feed_id"], r["run_id"]), r["url_canonical"]
        counts.setdefault(page, [0, 0, 0])
        if (page, url) in seen_pages:
            counts[page][2] += 1
            continue
        seen_pages.add((page, url))
        counts[page][0] += 1
        content = {c: r[c] for c in observe.REVISABLE}
        if url not in articles:
            counts[page][1] += 1
            articles[url] = {
                **content, "first_feed_id": r["feed_id"], "published_at": r["published_at"],
                "date_source": r["date_source"], "first_seen_at": r["seen_at"], "updated_at": r["seen_at"],
            }
        elif articles[url]["content_hash"] != r["content_hash"]:
            articles[url] |= {**content, "updated_at": r["seen_at"]}
        articles[url]["last_seen_at"] = r["seen_at"]
        sight = sightings.setdefault((url, r["feed_id"]), {"first_seen_at": r["seen_at"]})
        sight |= {"guid": r["guid"], "url_original": r["url_original"], "last_seen_at": r["seen_at"]}
    return articles, sightings, counts


OBSERVED_ORDER = [part.split()[0] for part in SCHEMA.split(", ")]
ARTICLE_FIELDS = (
    "first_feed_id", *observe.REVISABLE, "published_at", "date_source", "first_seen_at", "last_seen_at", "updated_at",
)


def plain(row, fields):
    return {f: utc(row[f]) if hasattr(row[f], "astimezone") else row[f] for f in fields}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_the_sequential_rules(spark, seed):
    rows = random_log(random.Random(seed))
    log = spark.createDataFrame(rows, SCHEMA)
    articles, sightings, counts = sequential(rows)

    folded = {r["url_canonical"]: plain(r, ARTICLE_FIELDS) for r in observe.fold_articles(log).collect()}
    assert folded == {u: {f: a[f] for f in ARTICLE_FIELDS} for u, a in articles.items()}

    unique = observe.first_in_page(observe.with_segment(log))
    fields = ("guid", "url_original", "first_seen_at", "last_seen_at")
    rows_seen = observe.sighting_rows(observe.fold_sightings(unique)).collect()
    assert {(r["url_canonical"], r["feed_id"]): plain(r, fields) for r in rows_seen} == sightings

    per_run = {(r["feed_id"], r["run_id"]): [r["n_seen"], r["n_new"], r["n_duplicates"]] for r in observe.run_counts(log).collect()}
    assert per_run == counts


@pytest.mark.parametrize("cuts", [(20, 45), (5, 6, 7, 50)])
def test_batches_equal_the_whole(spark, cuts):
    """Segments of separate batches merge to the articles of the whole log, in arrival order."""
    rows = random_log(random.Random(9))
    by_run = sorted({r[1] for r in rows})
    bounds = [0, *[by_run[min(c, len(by_run) - 1)] for c in cuts], by_run[-1] + 1]
    parts = None
    for batch, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        log = spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA)
        segments = observe.summarize(observe.first_in_page(observe.with_segment(log))).withColumn("batch", F.lit(batch))
        parts = segments if parts is None else parts.unionByName(segments)
    whole = observe.contents(spark.createDataFrame(rows, SCHEMA))
    found = observe.with_texts(observe.merge_articles(parts, "batch", "segment"), whole)
    merged = {r["url_canonical"]: plain(r, ARTICLE_FIELDS) for r in found.collect()}
    articles, _, _ = sequential(rows)
    assert merged == {u: {f: a[f] for f in ARTICLE_FIELDS} for u, a in articles.items()}


def test_merged_segments_can_be_merged_again(spark):
    """Compaction: the segments of early batches become one, and nothing else changes."""
    rows = random_log(random.Random(11))
    log = spark.createDataFrame(rows, SCHEMA)
    segments = observe.summarize(observe.first_in_page(observe.with_segment(log)))
    early, late = segments.filter("segment <= 2840160"), segments.filter("segment > 2840160")
    assert early.count() and late.count()
    again = observe.merge_articles(observe.merge_segments(early).unionByName(late))
    whole = observe.merge_articles(segments)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_known_urls_are_not_new(spark):
    rows = random_log(random.Random(4), n_runs=10)
    log = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([("hot",)], "url_canonical string")
    new = sum(r["n_new"] for r in observe.run_counts(log, known).collect())
    assert new == len({r[4] for r in rows} - {"hot"})


def test_flags(spark):
    rows = random_log(random.Random(5), n_runs=8, hot=0.1)
    flagged = observe.with_flags(observe.fold_articles(spark.createDataFrame(rows, SCHEMA))).collect()
    for row in flagged:
        assert row["is_fallback"] == (row["date_source"] == "fetched")
        assert row["was_revised"] == (row["updated_at"] > row["first_seen_at"])
    assert {r["was_revised"] for r in flagged} == {True, False}


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_no_text_is_sorted_or_aggregated(spark):
    """Whatever reorders or gathers rows sees hashes and positions; texts pass by once."""
    log = spark.createDataFrame(random_log(random.Random(3), n_runs=5), SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = observe.fold_articles(log)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    seen = [(node.nodeName(), node.output().mkString(" ") + node.simpleString(1000)) for node in nodes(plan)]
    gathering = [(name, shown) for name, shown in seen if any(x in name for x in ("Sort", "Window", "Aggregate"))]
    assert {"Sort", "Window"} <= {name for name, _ in gathering} and any("Aggregate" in name for name, _ in gathering)
    assert not [name for name, shown in gathering if any(text in shown for text in observe.TEXTS)]
    assert "title" in plan.output().mkString(" ")


@pytest.mark.parametrize("rows_whole", [5, 10**6])
def test_crowded_urls_are_cut_and_others_folded_in_one_shuffle(spark, tmp_path, rows_whole):
    """URLs of crowded buckets in segments, or none: the same articles; uncut, one shuffle does."""
    rows = random_log(random.Random(21), n_runs=80)
    log = spark.createDataFrame(rows, SCHEMA)
    articles, _, _ = sequential(rows)
    found = observe.fold_articles(log, workspace=str(tmp_path / "w"), rows=rows_whole).collect()
    assert {r["url_canonical"]: plain(r, ARTICLE_FIELDS) for r in found} == {
        u: {f: a[f] for f in ARTICLE_FIELDS} for u, a in articles.items()
    }
    pieces, placed = observe.with_pieces(log, rows=rows_whole)
    n_pieces = {r["url_canonical"]: r["n"] for r in pieces.groupBy("url_canonical").agg(F.count_distinct("segment").alias("n")).collect()}
    assert (n_pieces["hot"] > 1) == (rows_whole == 5) == (placed == observe.PLACED)
    if rows_whole == 10**6:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            narrow = observe.fold_articles(log, texts=False)
            names = [node.nodeName() for node in nodes(narrow._jdf.queryExecution().executedPlan())]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        # by page, by position, and the one row a URL that is left
        assert (names.count("Exchange"), names.count("Sort")) == (1, 3)
