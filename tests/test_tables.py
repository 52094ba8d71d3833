"""Reports, declarations, attempt log, audits and snapshots."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from support import at, utc

from pagetide import model
from pagetide.files import children, remove
from pagetide.operators import declare, paging, quality, reports, snapshot
from pagetide.session import shared_folder
from pagetide.sources import attempts, declarations
from pagetide.streaming import drain

NOW = at("2031-03-11T12:00:00")
FEED_ROW = ("name", "https://x.test/rss", "fr", "sec", "media", True, None, None, NOW, NOW)


def now():
    return F.lit(NOW).cast("timestamp")


def feed(number, slug, **changes):
    row = dict(zip(model.FEED.fieldNames(), (number, slug, *FEED_ROW), strict=True))
    return tuple((row | {"url": f"https://{slug}.test"} | changes).values())


def feeds_of(spark, *rows):
    return spark.createDataFrame(list(rows), model.FEED)


# --- reports ----------------------------------------------------------------------------


def articles_of(spark, n=97):
    """Four articles a minute; every tenth has no date."""
    rows = [
        (i, f"https://w{i}.invalid/", 1 + i % 2, f"No. {i}", None if i % 10 == 7 else NOW - timedelta(minutes=i // 4), "published", "<p>x</p>")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "first_seq long, url_canonical string, first_feed_id long, title string, published_at timestamp, date_source string, summary_clean string"
    )


def listed(n=97):
    return sorted(range(n), key=lambda i: (i % 10 == 7, 0 if i % 10 == 7 else i // 4, -i))


@pytest.mark.parametrize("few", [1, 1000])
def test_every_position_is_found_by_counting(spark, monkeypatch, few):
    """Also with dates that most rows share, and with slices cut down to single values."""
    monkeypatch.setattr(paging, "FEW", few)
    rows = [(i, None if i % 3 == 0 else NOW + timedelta(seconds=0 if i % 3 == 1 else i % 40)) for i in range(200)]
    frame = spark.createDataFrame(rows, "first_seq long, published_at timestamp").cache()
    wanted = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or NOW).timestamp() if r[1] else 0, -r[0]))]
    order = paging.newest_first(frame, "published_at", "first_seq")
    for position in (0, 67, 133, 199) if few == 1 else (66, 100, 200):
        left, skipped = paging.from_position(frame, order, position)
        ids = [r["first_seq"] for r in left.collect()]
        assert skipped == 0 and sorted(ids) == sorted(wanted[position:])


def test_order_by_structs_and_repeated_rows(spark):
    frame = spark.sql("SELECT struct(id DIV 10 AS a, CAST(id % 2 AS INT) AS b) AS seq, id FROM range(100)")
    order = paging.newest_first(frame, "seq")
    assert [o.name for o in order] == ["seq.a", "seq.b"]
    left, skipped = paging.from_position(frame, order, 7)  # five rows share each key: two of them lie before
    assert skipped == 2 and left.count() == 95
    with pytest.raises(TypeError, match="ordered by"):
        paging.newest_first(frame.selectExpr("'x' AS s"), "s")


def test_deep_pages_hold_no_rows_before_them(spark):
    feeds = feeds_of(spark, feed(1, "a"), feed(2, "b"))
    rows = reports.list_articles(articles_of(spark), feeds, page=3, page_size=30).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "limit=30" in plan and "offset" not in plan.lower()


@pytest.mark.parametrize(("page", "size"), [(1, 30), (2, 30), (4, 7), (5, 0), (0, 30), (-3, 30)])
def test_pagination(spark, page, size):
    feeds = feeds_of(spark, feed(1, "a"), feed(2, "b"))
    got = reports.list_articles(articles_of(spark), feeds, page=page, page_size=30)
    start = (max(1, page) - 1) * 30
    assert [r["first_seq"] for r in got.rows.collect()] == listed()[start : start + 30]
    assert len(listed()[start : start + 30]) == size
    info = got.info.first()
    assert (info["total"], info["pages"]) == (97, 4)
    assert info["has_previous"] == (page > 1) and info["has_next"] == (max(1, page) < 4)


def test_keyset_pages_follow_each_other(spark):
    """Also from the last dated article to those without a date, and among these."""
    articles, feeds = articles_of(spark), feeds_of(spark, feed(1, "a"), feed(2, "b"))
    for page in (1, 3, 4):
        last = reports.list_articles(articles, feeds, page=page, page_size=29).rows.collect()[-1]
        at = F.lit(last["published_at"]).cast("timestamp")
        following = reports.articles_after(articles, at, F.lit(last["first_seq"]), size=29).collect()
        assert [r["first_seq"] for r in following] == listed()[page * 29 : page * 29 + 29]


@pytest.mark.parametrize(("topic", "wanted"), [("ai", {1, 3}), ("sec", {2, 3}), ("both", {3}), (None, {1, 2, 3})])
def test_topic_filters_admit_mixed_feeds(spark, topic, wanted):
    feeds = feeds_of(spark, feed(1, "a", topic="ai"), feed(2, "b", topic="sec"), feed(3, "c", topic="both"))
    articles = articles_of(spark).withColumn("first_feed_id", F.col("first_seq") % 3 + 1)
    chosen = reports.select_articles(articles, feeds, topic=topic)
    assert {r["first_feed_id"] for r in chosen.collect()} == wanted


def test_unknown_filters_are_refused(spark):
    with pytest.raises(ValueError, match="lang"):
        reports.select_articles(articles_of(spark), feeds_of(spark, feed(1, "a")), lang="de")
    with pytest.raises(ValueError, match="topic"):
        reports.select_articles(articles_of(spark), feeds_of(spark, feed(1, "a")), topic="x")
    with pytest.raises(LookupError):
        reports.select_feed(feeds_of(spark, feed(1, "a")), "b")


def run(feed_id, when, status="ok", message=None):
    return (feed_id, when, when, status, 200 if status == "ok" else 502, 1, 2, message, "none", None, None)


def test_health_shows_the_last_run_and_feeds_that_never_ran(spark):
    feeds = feeds_of(spark, feed(1, "z"), feed(2, "off", is_active=False), feed(3, "jamais"))
    runs = spark.createDataFrame(
        [run(1, NOW - timedelta(1)), run(1, NOW, "error", "FetchError: z : HTTP 502"), run(2, NOW), run(2, NOW, "error", "FeedParseError: x")],
        model.FEED_RUN,
    )
    health = reports.feed_health(feeds, runs, articles_of(spark, 5))
    assert sorted((r["slug"], r["status"], r["error_kind"], r["n_articles"]) for r in health.collect() if r["status"]) == [
        ("off", "error", "flux", 2), ("off", "ok", "", 2), ("z", "error", "reseau", 3),
    ]
    shown = reports.health_table(health, now=now()).collect()
    assert [r["slug"] for r in shown] == ["jamais", "z", "off", "off"]
    assert (shown[0]["last_run"], shown[0]["status"], shown[1]["error_kind_label"]) == ("jamais", "—", "réseau")


@pytest.mark.parametrize(("statuses", "verdict"), [(["ok", "error"], 0), (["error"], 1), ([], 2), (["not_modified"], 0)])
def test_run_verdict(spark, statuses, verdict):
    runs = spark.createDataFrame([run(i, NOW, s) for i, s in enumerate(statuses)], model.FEED_RUN)
    assert reports.run_summary(runs).first()["verdict"] == verdict


# --- declarations -----------------------------------------------------------------------


def test_sync_and_its_idempotence(spark):
    stored = feeds_of(spark, feed(1, "same"), feed(2, "renamed"), feed(3, "gone"), feed(4, "back", is_active=False), feed(5, "off", is_active=False))
    wanted = [("same", "name"), ("renamed", "New name"), ("back", "name"), ("fresh", "name")]
    declared = spark.createDataFrame([(i, n, f"https://{i}.test", "fr", "sec", "media") for i, n in wanted], model.DECLARATION)
    actions = {r["slug"]: r["action"] for r in declare.sync_actions(stored, declared).collect()}
    assert actions == {"same": "unchanged", "renamed": "updated", "gone": "deactivated", "back": "updated", "fresh": "created", "off": "absent"}

    later = F.lit(NOW + timedelta(1)).cast("timestamp")
    synced = declare.apply_sync(stored, declared, later)
    rows = {r["slug"]: r for r in synced.collect()}
    assert {s: r["is_active"] for s, r in rows.items()} == {"same": True, "renamed": True, "gone": False, "back": True, "fresh": True, "off": False}
    assert rows["renamed"]["name"] == "New name" and rows["renamed"]["feed_id"] == 2
    assert utc(rows["same"]["updated_at"]) == NOW and utc(rows["gone"]["updated_at"]) == NOW + timedelta(1)
    again = {r["action"]: r["n_feeds"] for r in declare.sync_report(declare.sync_actions(synced, declared)).collect()}
    assert again == {"created": 0, "updated": 0, "unchanged": 4, "deactivated": 0}
    found, missing = declare.match_declarations(declared, stored)
    assert found.count() == 3 and [r["id"] for r in missing.collect()] == ["fresh"]


def test_declaration_rules(spark, tmp_path):
    good = {"id": "cert-fr", "name": "CERT", "url": "https://c.test/feed", "lang": "fr", "topic": "sec", "source_type": "official"}
    lines = [good, good | {"id": "Bad_Slug", "url": "ftp://x"}, good | {"id": "x", "url": "https://u.test", "lang": "de"},
             good | {"id": "dup", "extra": 1}, good | {"id": "no-name", "name": "", "url": "https://n.test"}]
    path = tmp_path / "feeds.json"
    path.write_text("\n".join(json.dumps(line) for line in lines))
    read = declarations.read_declarations(spark, str(path))
    broken = {(r["id"], r["rule"]) for r in declarations.declaration_violations(read).collect()}
    assert broken == {
        ("Bad_Slug", "id_pattern"), ("Bad_Slug", "url_scheme"), ("x", "id_length"), ("x", "lang"),
        ("dup", "extra_fields"), ("cert-fr", "duplicate_url"), ("no-name", "name_length"),
    }
    (tmp_path / "empty.json").write_text("\n")
    nothing = declarations.read_declarations(spark, str(tmp_path / "empty.json"))
    assert [r["rule"] for r in declarations.declaration_violations(nothing).collect()] == ["no_feed"]


# --- attempts ---------------------------------------------------------------------------

LINES = [
    json.dumps({"attempted_at": "2031-03-11T12:00:00Z", "reason": "docker_unavailable", "detail": "x" * 3000}),
    json.dumps({"attempted_at": "2031-03-11T14:00:00+02:00", "reason": "docker_unavailable"}),
    json.dumps({"attempted_at": "2031-03-11T06:00:00.250+00:00", "reason": "new_reason", "detail": ""}),
    json.dumps({"attempted_at": "2031-03-11T05:00:00-0130", "detail": 0}),
    json.dumps({"attempted_at": "2031-03-11T12:00:00", "reason": "lock_held"}),
    json.dumps({"attempted_at": "12:30", "reason": "lock_held"}),
    json.dumps({"attempted_at": 20310311, "reason": "lock_held"}),
    json.dumps({"reason": "lock_held"}),
    "[1, 2]", '"text"', "not json", "", '{"attempted_at": ',
]


def test_attempt_lines(spark):
    frame = spark.createDataFrame([(line,) for line in LINES], "value string")
    rows = {(utc(r["attempted_at"]), r["reason"], r["detail"] and len(r["detail"])) for r in attempts.parse_attempts(frame, now()).collect()}
    assert rows == {
        (NOW, "docker_unavailable", 2000), (NOW, "docker_unavailable", None),
        (at("2031-03-11T06:00:00.250"), "wrapper_error", None), (at("2031-03-11T06:30:00"), "wrapper_error", None),
    }


def test_draining_again_adds_nothing(spark, tmp_path):
    queue, state = tmp_path / "queue", shared_folder(spark, "t")
    queue.mkdir()
    (queue / "a.jsonl").write_text("\n".join(LINES))
    drain.drain_available(spark, str(queue), state, now())
    assert drain.stored_attempts(spark, state).count() == 3
    (queue / "b.jsonl").write_text("\n".join([*LINES, json.dumps({"attempted_at": "2031-03-12T00:00Z", "reason": "lock_held"})]))
    drain.drain_available(spark, str(queue), state, now())
    drain.drain_available(spark, str(queue), state, now())
    assert drain.stored_attempts(spark, state).count() == 4


# --- audits and snapshots ---------------------------------------------------------------


def test_audit_finds_each_kind_of_violation(spark):
    feeds = feeds_of(spark, feed(1, "a"), feed(2, "a", url="https://other.test"), feed(3, "c" * 70, lang="de"))
    good = ("https://u/1", 1, "t", None, None, None, "0" * 64, NOW, "published", NOW, NOW, NOW, None)
    articles = spark.createDataFrame(
        [good, good, ("https://u/2", 9, None, None, None, None, "short", NOW, "guess", NOW, NOW, NOW, None)],
        T.StructType([T.StructField(f.name, f.dataType, True) for f in model.ARTICLE]),
    )
    found = {(r["table_name"], r["rule"], r["row_key"], r["n_rows"]) for r in quality.audit({"feed": feeds, "article": articles}).collect()}
    assert found == {
        ("feed", "unique:slug", "a", 2), ("feed", "max_length:slug", "c" * 70, 1), ("feed", "domain:lang", "c" * 70, 1),
        ("article", "unique:url_canonical", "https://u/1", 2), ("article", "not_null:title", "https://u/2", 1),
        ("article", "exact_length:content_hash", "https://u/2", 1), ("article", "domain:date_source", "https://u/2", 1),
        ("article", "reference:first_feed_id", "9", 1),
    }


def test_clean_tables_have_no_violation(spark):
    runs = spark.createDataFrame([run(1, NOW)], model.FEED_RUN)
    missed = spark.createDataFrame([(NOW, "lock_held", None, NOW)], model.MISSED_RUN)
    assert quality.audit({"feed": feeds_of(spark, feed(1, "a")), "feed_run": runs, "missed_run": missed}).count() == 0
    naive = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t")
    assert quality.naive_columns(naive, "x") == ["x.t"] and quality.naive_columns(missed, "m") == []


def test_purging_a_feed_takes_all_that_hangs_on_it(spark):
    articles = spark.createDataFrame([("u1", 1), ("u2", 2)], "url_canonical string, first_feed_id long")
    sightings = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 2), ("u2", 1)], "url_canonical string, feed_id long")
    runs = spark.createDataFrame([run(1, NOW), run(2, NOW)], model.FEED_RUN)
    feeds = feeds_of(spark, feed(1, "a"), feed(2, "b"))
    left = quality.purge_feeds(spark.createDataFrame([(1,)], "feed_id long"), feeds, runs, articles, sightings)
    assert [r["url_canonical"] for r in left.articles.collect()] == ["u2"]
    assert [(r["url_canonical"], r["feed_id"]) for r in left.sightings.collect()] == [("u2", 2)]
    assert left.feeds.count() == left.runs.count() == 1


def test_snapshots_restore_content_and_damage_is_refused(spark):
    root = shared_folder(spark, "snapshots")
    tables = {
        "feed": feeds_of(spark, feed(1, "a"), feed(2, "b")),
        "feed_run": spark.createDataFrame([run(1, NOW)], model.FEED_RUN),
    }
    snapshot.take_snapshot(tables, root, "20310311-120000")
    restored = snapshot.restore(spark, root, "20310311-120000")
    assert {n: t.count() for n, t in restored.items()} == {"feed": 2, "feed_run": 1}
    assert snapshot.compare(snapshot.fingerprints(tables), snapshot.fingerprints(restored)).isEmpty()

    # Same row count, other content in one part; then that part is gone.
    folder = f"{root}/snapshot=20310311-120000/feed"
    part = f"{folder}/{next(n for n in children(spark, folder) if n.startswith('snapshot_part='))}"
    feeds_of(spark, feed(2, "c")).write.mode("overwrite").parquet(part)
    with pytest.raises(ValueError, match="refused"):
        snapshot.restore(spark, root, "20310311-120000")
    remove(spark, part)
    with pytest.raises(ValueError, match="refused"):
        snapshot.restore(spark, root, "20310311-120000")


def test_snapshots_copy_what_changed(spark):
    """Only parts with other rows are copied; rotation leaves what the rest still names."""
    root = shared_folder(spark, "snapshots")
    rows = [(i, f"v{i}") for i in range(500)]

    def taken(rows, stamp, empty=()):
        tables = {"t": spark.createDataFrame(rows, "i long, v string"), "e": spark.createDataFrame(list(empty), "i long")}
        return snapshot.take_snapshot(tables, root, stamp)

    def read(stamp):
        tables = snapshot.restore(spark, root, stamp)
        return sorted(map(tuple, tables["t"].collect())), tables["e"].count()

    first = taken(rows, "20260101-000000")
    assert first["t"].n_rows == 500 and len(first["t"].parts) == snapshot.PARTS and not first["e"].parts
    changed = [(i, "new" if i == 7 else v) for i, v in rows]
    second = taken(changed, "20260102-000000", [(1,)])
    fresh = [p for p in second["t"].parts if p.home == "20260102-000000"]
    assert 1 <= len(fresh) <= 2 and len(second["e"].parts) == 1
    third = taken(changed, "20260103-000000", [(1,)])
    assert third["t"].digest == second["t"].digest != first["t"].digest
    assert not [p for p in third["t"].parts if p.home == "20260103-000000"]
    assert snapshot.rotate(spark, root, keep=1) == ["20260101-000000", "20260102-000000"]
    assert snapshot.stamps(spark, root) == ["20260103-000000"]
    assert read("20260103-000000") == (sorted(changed), 1)
    # the old state of a changed part is gone, all others stay where they were first written
    old = [n for n in children(spark, f"{root}/snapshot=20260101-000000/t") if n.startswith("snapshot_part=")]
    assert len(old) == snapshot.PARTS - len({p.part for p in fresh} | {p.part for p in first["t"].parts if p not in third["t"].parts})
    with pytest.raises(ValueError, match="does not"), pytest.MonkeyPatch.context() as patch:
        patch.setattr(snapshot, "_rows", lambda *_: spark.createDataFrame([], "i long, v string"))
        taken(rows, "20260104-000000")
    assert snapshot.stamps(spark, root) == ["20260103-000000"]


def test_fingerprints_see_duplicates_and_nulls_but_not_order(spark):
    schema = "a string, b long"

    def of(*rows):
        return snapshot.fingerprint(spark.createDataFrame(list(rows), schema), "t").first()["fingerprint"]

    assert of(("x", 1), ("y", 2)) == of(("y", 2), ("x", 1))
    assert len({of(), of(("x", 1)), of(("x", 1), ("x", 1)), of((None, 1)), of(("", 1)), of(("x", None))}) == 6


def test_old_snapshots_expire(spark):
    root, table = shared_folder(spark, "snapshots"), {"t": spark.range(3)}
    stamps = [f"20310311-1200{i:02d}" for i in range(4)]
    for stamp in stamps:
        snapshot.take_snapshot(table, root, stamp)
    listed = snapshot.list_snapshots(spark, root, keep=2).collect()
    assert [(r["stamp"], r["expired"]) for r in listed] == [(s, i >= 2) for i, s in enumerate(reversed(stamps))]
