"""State of the streams: buckets and versions, values per feed, late runs."""

from __future__ import annotations

import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from support import at, utc

from pagetide import model
from pagetide.files import children
from pagetide.plans import roles
from pagetide.session import shared_folder
from pagetide.sources import fetchlog
from pagetide.streaming import feed_state, upsert
from pagetide.streaming.buckets import BucketTable

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
NOW = at("2031-03-11T12:00:00")


def put(table, batch, rows):
    """Set the values of these keys: the merge that every table of the streams does."""
    new = table.spark.createDataFrame(rows, SCHEMA)
    version, numbers = table.touched(batch, new)
    old = table.read(version, numbers)
    table.write(batch, version, numbers, old.join(new, "k", "left_anti").select("k", "v").unionByName(new))


def state(table):
    return {r["k"]: r["v"] for r in table.current().collect()}


def test_versions_follow_each_other(spark):
    draw = random.Random(5)
    table, known = BucketTable(spark, shared_folder(spark, "t"), SCHEMA, ("k",), rows=6), {}
    for batch in range(7):
        rows = {f"k{draw.randrange(60)}": batch * 100 + i for i in range(draw.choice([0, 1, 12]) if batch else 9)}
        put(table, batch, list(rows.items()))
        if batch == 4:  # a replay writes the same again
            put(table, batch, list(rows.items()))
        known |= rows
        assert state(table) == known
        assert table.version(batch).n_rows == len(known)
    assert table.version(6).depth >= 2
    assert table.versions() == list(range(7))
    table.sweep(5)
    assert table.versions() == [5, 6] and state(table) == known
    put(table, 7, [("k1", -1)])
    assert state(table) == known | {"k1": -1}


def test_an_unfinished_version_is_not_seen(spark):
    table = BucketTable(spark, shared_folder(spark, "t"), SCHEMA, ("k",))
    assert state(table) == {}
    put(table, 0, [("a", 1)])
    # batch 1 wrote its rows and died before its manifest
    spark.createDataFrame([("a", 2, 0)], "k string, v long, bucket long").write.partitionBy("bucket").parquet(f"{table.root}/rows/batch=1")
    assert state(table) == {"a": 1}
    put(table, 1, [("a", 3)])
    assert state(table) == {"a": 3}


def size_of(files):
    return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in files)


def test_a_batch_reads_what_its_keys_touch(spark):
    """The same three keys after a short and after a ten times longer history: as much is read."""
    read = []
    for n in (300, 3000):
        table = BucketTable(spark, shared_folder(spark, "t"), SCHEMA, ("k",), rows=50)
        for batch in range(3):
            put(table, batch, [(f"k{i}", i) for i in range(n) if i % 3 == batch])
        version, numbers = table.touched(3, spark.createDataFrame([("k1",), ("k2",), ("new",)], "k string"))
        found = table.read(version, numbers)
        assert len(numbers) <= 3 and {"k1", "k2"} <= {r["k"] for r in found.collect()}
        read.append((len(found.inputFiles()), size_of(found.inputFiles())))
        put(table, 3, [("k1", -1)])
        assert len([name for name in children(spark, f"{table.root}/rows/batch=3") if name.startswith("bucket=")]) == 1
        assert table.current().count() == n
    assert read[1][0] <= 3 and read[1][1] <= 2 * read[0][1]


def test_late_pages_count_in_order_of_arrival(spark):
    """A page that was fetched early and arrives late adds to what is known, and takes nothing back."""
    def page(slug, days):
        item = f"<item><title>{slug}</title><link>https://x.test/{slug}</link><pubDate>{(NOW + timedelta(days=days)).strftime('%a, %d %b %Y %H:%M:%S')} +0000</pubDate></item>"
        return f"<rss version='2.0'><channel><title>x</title>{item}</channel></rss>".encode()

    def row(run, slug, days, published):
        when = NOW + timedelta(days=days)
        return (1, run, 0, when, 1, 200, None, page(slug, published), f'"{run}"', None, when)

    feeds = spark.createDataFrame(
        [(1, "a", "A", "https://a.test/", "fr", "sec", "media", True, None, None, NOW, NOW)], model.FEED
    )
    base = shared_folder(spark, "t")
    for rows in ([row(2, "one", 5, 4)], [row(1, "one", 1, 0), row(3, "two", 6, 5)]):
        spark.createDataFrame(rows, model.FETCH_LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")
        upsert.ingest_stream(fetchlog.stream_fetch_log(spark, f"{base}/log"), feeds, f"{base}/state").awaitTermination()
    found = {r["url_canonical"]: r for r in upsert.stored_articles(spark, f"{base}/state").collect()}
    assert utc(found["https://x.test/one"]["first_seen_at"]) == NOW + timedelta(days=5)
    assert utc(found["https://x.test/one"]["published_at"]) == NOW + timedelta(days=4)
    assert found["https://x.test/one"]["n_observations"] == 2
    runs = {r["run_id"]: r for r in upsert.stored_runs(spark, f"{base}/state").collect()}
    assert {k: r["n_new"] for k, r in runs.items()} == {1: 0, 2: 1, 3: 1}
    assert upsert.stored_feeds(spark, f"{base}/state", feeds).first()["etag"] == '"3"'


def test_values_per_feed(spark):
    """What is known before each run, over batches, with runs that show nothing new."""
    draw = random.Random(8)
    rows = []
    for run in range(40):
        newest = None if draw.random() < 0.3 else NOW + timedelta(hours=draw.randrange(200))
        oldest = None if draw.random() < 0.2 else NOW + timedelta(hours=draw.randrange(200))
        rows.append((draw.choice([1, 1, 1, 2, 3]), run, run, oldest, newest))
    base = shared_folder(spark, "t")
    for low, high in ((0, 15), (15, 16), (16, 40)):
        spark.createDataFrame(rows[low:high], feed_state.RUNS).write.mode("append").parquet(f"{base}/landed")
        feed_state.tell_available(spark, f"{base}/landed", f"{base}/state")
    known, held, n = {}, {}, {}
    wanted = {}
    for feed, run, _, oldest, newest in rows:
        now = None if feed not in known or oldest is None else oldest <= known[feed]
        wanted[run] = (known.get(feed), now, held.get(feed), n.get(feed, 0))
        n[feed] = n.get(feed, 0) + 1
        if now is not None:
            held[feed] = now
        if newest is not None:
            known[feed] = max(known.get(feed, newest), newest)
    got = {
        r["run_id"]: (utc(r["prev_max_published"]), r["overlaps"], r["last_overlaps"], r["n_runs"])
        for r in feed_state.told_runs(spark, f"{base}/state").collect()
    }
    assert got == wanted


def test_feeds_share_slots(spark):
    """However many feeds there are, the stream asks for few values; each feed still has its own."""
    n, base = 3 * feed_state.SLOTS, shared_folder(spark, "t")
    for batch in range(2):
        date = F.timestamp_seconds(F.col("id") * 10 + batch)
        runs = spark.range(n).select(
            F.col("id").alias("feed_id"), F.lit(batch).cast("long").alias("run_id"), F.lit(batch).cast("long").alias("run_order"),
            date.alias("oldest"), date.alias("run_max"),
        )
        runs.write.mode("append").parquet(f"{base}/landed")
        feed_state.tell_available(spark, f"{base}/landed", f"{base}/state")
    told = feed_state.told_runs(spark, f"{base}/state")
    right = "CASE run_id WHEN 0 THEN prev_max_published IS NULL AND n_runs = 0 ELSE unix_seconds(prev_max_published) = feed_id * 10 AND n_runs = 1 AND NOT overlaps END"
    assert (told.count(), told.filter(right).count()) == (2 * n, 2 * n)
    stored = spark.read.format("statestore").option("stateVarName", "feeds").load(f"{base}/state/_checkpoint")
    assert stored.count() <= feed_state.SLOTS


def test_feed_state_keeps_longs_beside_null(spark):
    """Dates and numbers that no float holds are told to the last digit, with NULL beside them."""
    big, far = (1 << 53) + 1, 250_000_000_000_000_001
    rows = [(1, big, 1, None, far), (1, big + 2, 2, None, None), (None, 5, 3, far, far), (None, None, None, far, None)]
    base = shared_folder(spark, "t")
    frame = spark.createDataFrame(rows, "feed_id long, run_id long, run_order long, oldest_us long, max_us long").selectExpr(
        "feed_id", "run_id", "run_order", "timestamp_micros(oldest_us) AS oldest", "timestamp_micros(max_us) AS run_max"
    )
    frame.coalesce(1).write.parquet(f"{base}/landed")
    feed_state.tell_available(spark, f"{base}/landed", f"{base}/state")
    told = feed_state.told_runs(spark, f"{base}/state").selectExpr("feed_id", "run_id", "unix_micros(prev_max_published)", "overlaps", "n_runs")
    assert set(map(tuple, told.collect())) == {
        (1, big, None, None, 0), (1, big + 2, far, None, 1), (None, 5, None, None, 0), (None, None, far, True, 1)
    }


def test_resolved_links_of_nested_bases(spark):
    from pagetide.sources.pages import explode_entries, parse_documents

    body = (
        "<feed xmlns='http://www.w3.org/2005/Atom' xml:base='http://a.test/x/y'><link href='http://site.test/s/'/>"
        "<entry xml:base='z/'><link href='1'/></entry><entry><link href='//other.test/2'/></entry><entry><link href='a.test/3'/></entry></feed>"
    )
    plain = (
        "<rss version='2.0'><channel><link>http://site.test/dir/index.html</link><item><link>next.html</link></item>"
        "<item><link>www.host.test/p</link></item><item><link>../up</link></item><item><link>?q=1</link></item>"
        "<item><guid>/by/guid</guid></item><item><link>mailto:x@y.test</link></item></channel></rss>"
    )
    pages = spark.createDataFrame([(1, body.encode()), (2, plain.encode())], "page_id long, body binary")
    found = explode_entries(parse_documents(pages).drop("warning")).select("page_id", "entry_pos", "url_original").collect()
    links = {(r["page_id"], r["entry_pos"]): r["url_original"] for r in found}
    assert links == {
        (1, 0): "http://a.test/x/z/1", (1, 1): "http://other.test/2", (1, 2): "http://a.test/x/a.test/3",
        (2, 0): "http://site.test/dir/next.html", (2, 1): "www.host.test/p", (2, 2): "http://site.test/up",
        (2, 3): "http://site.test/dir/index.html?q=1", (2, 4): "http://site.test/by/guid", (2, 5): "mailto:x@y.test",
    }


# The examples of RFC 3986, section 5.4, with the base given there.
EXAMPLES = """g:h=g:h g=http://a/b/c/g ./g=http://a/b/c/g g/=http://a/b/c/g/ /g=http://a/g //g=http://g ?y=http://a/b/c/d;p?y
g?y=http://a/b/c/g?y #s=http://a/b/c/d;p?q#s g#s=http://a/b/c/g#s g?y#s=http://a/b/c/g?y#s ;x=http://a/b/c/;x g;x=http://a/b/c/g;x
g;x?y#s=http://a/b/c/g;x?y#s .=http://a/b/c/ ./=http://a/b/c/ ..=http://a/b/ ../=http://a/b/ ../g=http://a/b/g ../..=http://a/
../../=http://a/ ../../g=http://a/g ../../../g=http://a/g ../../../../g=http://a/g /./g=http://a/g /../g=http://a/g
g.=http://a/b/c/g. .g=http://a/b/c/.g g..=http://a/b/c/g.. ..g=http://a/b/c/..g ./../g=http://a/b/g ./g/.=http://a/b/c/g/
g/./h=http://a/b/c/g/h g/../h=http://a/b/c/h"""


def test_references_of_the_standard(spark):
    from pagetide.functions.urls import resolve

    cases = [tuple(x.split("=", 1)) for x in EXAMPLES.split()] + [("", "http://a/b/c/d;p?q"), ("?y=1", "http://a/b/c/d;p?y=1")]
    frame = spark.createDataFrame(cases, "ref string, want string").withColumn("got", resolve(F.lit("http://a/b/c/d;p?q"), F.col("ref")))
    assert [(r["ref"], r["got"]) for r in frame.filter("got <> want OR got IS NULL").collect()] == []
    odd = spark.createDataFrame([(None, "x"), ("no base", "x"), ("mailto:a@b.c", "x"), ("http://h", "x"), ("http://h?q", " y\n/z ")], "base string, ref string")
    assert [r[0] for r in odd.select(resolve(F.col("base"), F.col("ref"))).collect()] == ["x", "x", "x", "http://h/x", "http://h/y/z"]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_unserved_runs_are_in_the_given_log(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    counted = roles.document_log(spark, folder).groupBy("http_status").count().collect()
    assert {r["http_status"] for r in counted} == {200, 304, 503, None}


def test_pieces_are_added_and_old_ones_not_written_again(spark):
    """A batch that adds to its buckets writes its own rows alone; splits and sweeps keep all pieces."""
    table, rows = BucketTable(spark, shared_folder(spark, "t"), SCHEMA, ("k",), rows=20), []
    for batch in range(3):
        new = [(f"k{i}", batch) for i in range(15)]
        rows += new
        frame = spark.createDataFrame(new, SCHEMA)
        version, numbers = table.touched(batch, frame)
        assert not version.many(numbers)
        table.write(batch, version, numbers, frame, added=numbers)
        assert spark.read.parquet(f"{table.root}/rows/batch={batch}").count() == 15
        assert sorted(map(tuple, table.current().collect())) == sorted(rows)
    assert table.version(2).depth >= 1
    table.sweep(2)
    assert sorted(map(tuple, table.current().collect())) == sorted(rows)


def test_texts_are_written_once(spark):
    """A batch adds the texts of contents it brought; those that stand are neither read nor written again."""
    rows = [
        (seq, url, f"title {seq}", NOW + timedelta(hours=seq), version)
        for seq, url, version in [(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "a", "y"), (5, "b", "x"), (6, "d", "x")]
    ]
    log = spark.createDataFrame(rows, "seq long, url_canonical string, title string, seen_at timestamp, content_hash string").selectExpr(
        "1L AS feed_id", "seq AS run_id", "seq", "seen_at", "url_canonical", "url_canonical AS url_original", "'g' AS guid", "title",
        "'by' AS author", "concat('s', seq) AS raw_summary", "concat('s', seq % 2) AS summary_clean", "content_hash",
        "seen_at AS published_at", "'published' AS date_source",
    )
    base = shared_folder(spark, "t")
    for part in ("seq <= 3", "seq > 3"):
        log.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/log")
        upsert.fold_available(spark, f"{base}/log", log.schema, f"{base}/state")
    assert [spark.read.parquet(f"{base}/state/contents/rows/batch={n}").count() for n in (0, 1)] == [3, 2]
    found = {r["url_canonical"]: (r["title"], r["raw_summary"], r["summary_clean"]) for r in upsert.stored_articles(spark, f"{base}/state").collect()}
    assert found == {
        "a": ("title 4", "s4", "s0"), "b": ("title 2", "s2", "s0"), "c": ("title 3", "s3", "s1"), "d": ("title 6", "s6", "s0")
    }
