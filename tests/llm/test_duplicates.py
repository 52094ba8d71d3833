"""Exact and near duplicates, and components."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_support import documents

from pagetide.llm import exact_dedup, jaccard_join
from pagetide.llm.components import components


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- exact ------------------------------------------------------------------------------


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    out = Counter()
    for i, t in rows:
        key = (t or "").encode().lower()
        keep = max((x for x in groups[key] if x is not None), default=None)
        out[(i, keep if len(groups[key]) > 1 else i, len(groups[key]), hashlib.sha256(key).hexdigest())] += 1
    return out


def test_exact_groups(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = exact_dedup.exact_groups(odd).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in found) == exact(rows)
    assert all(r.kept == (r.id == r.keep_id) for r in found)


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == []


def test_exact_groups_lower_only_ascii(spark):
    rows = [(1, "ÀB"), (2, "àb"), (3, "Àb"), (4, "K"), (5, "K"), (6, "k")]
    found = {r.id: r.keep_id for r in exact_dedup.exact_groups(make(spark, rows)).collect()}
    assert found == {1: 3, 2: 2, 3: 3, 4: 6, 5: 5, 6: 6}


def test_keep_last(odd):
    kept = exact_dedup.keep_last(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {2: 1, 5: 1, 4: 1, 7: 1, None: 1, 8: 1}


def test_filters_merge_without_loss():
    random_ = np.random.default_rng(1)
    parts = [random_.integers(0, 50, 200, dtype=np.uint64) << np.uint64(58) for _ in range(5)]
    merged = exact_dedup.QuotientFilter.merged([exact_dedup.QuotientFilter.of(p) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.prints == values).all() and (merged.counts == counts).all()


# --- components -------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- near -------------------------------------------------------------------------------


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def near(rows, width, percent):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, monkeypatch, width, percent):
    # small blocks and leaves, so that short lists are cut and descended as long ones are
    for name, value in (("BLOCK", 16), ("GROUP_BLOCK", 12), ("LEAF", 4), ("FANOUT", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    draw = random.Random(percent)
    rows = []
    for size in (1, 2, 3, 12, 60, 200, 900):
        base = [f"w{draw.randrange(5000)}" for _ in range(size)]
        for _ in range(14):
            rows.append(edited(draw, base, draw.randrange(0, max(1, size // 25) + 1)))
    hot = [f"h{draw.randrange(90)}" for _ in range(150)]
    rows += [edited(draw, hot, draw.randrange(0, 6)) for _ in range(60)]
    rows += [" ".join(hot[:40]) + f" tail {k} " + " ".join(f"t{draw.randrange(9999)}" for _ in range(30)) for k in range(40)]
    draw.shuffle(rows)
    rows = list(enumerate(rows)) + [(900, None), (901, ""), (902, " \n "), (903, rows[0].upper()), (None, rows[0])]
    found = jaccard_join.near_duplicates(make(spark, rows), width, percent).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found if r.id is not None} == near(rows, width, percent)
    assert len(found) == len(rows)


def test_near_duplicates_of_odd_rows(odd, nothing):
    found = jaccard_join.near_duplicates(odd)
    assert sorted((r.id or 0, r.component_id or 0) for r in found.collect()) == [
        (0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8),
    ]
    assert jaccard_join.near_duplicates(nothing).collect() == []


def test_keep_first(odd):
    kept = jaccard_join.keep_first(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 8: 1}


def test_given_documents(given):
    docs = given("documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = jaccard_join.near_duplicates(docs, 3, 90).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == near(rows, 3, 90)
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()) == exact(rows)


def test_an_id_before_several_texts(spark):
    """Of such an id only the copy goes; its other text is of no other row."""
    long = "these words are the same in both of the documents that are said to be near copies of each other here "
    rows = [(1, "A copy", "en", "s"), (1, "unique text", "en", "s"), (2, "a COPY", "en", "s"), (None, "a copy", "en", "s")]
    kept = exact_dedup.keep_last(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a copy"), (1, "unique text"), (2, "a COPY")]
    rows = [(5, long * 4, "en", "s"), (5, "something else " * 9, "en", "s"), (3, long * 4 + "end", "en", "s"), (7, long * 4 + "fin", "en", "s")]
    rows += [(8, "one more " + str(k) + " of its kind", "en", "s") for k in range(3)] + [(None, long * 4, "en", "s")]
    kept = jaccard_join.keep_first(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    found = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert found == sorted((i or 0, t) for i, t, *_ in [rows[1], rows[2], *rows[4:]])


def test_links_of_all_texts_of_an_id(spark):
    long = [f"text {k} has these words in it which are all its own and {k} more of them come " * 4 for k in range(3)]
    rows = [(5, long[0]), (5, long[1]), (6, long[0] + "x"), (7, long[1] + "x"), (8, long[2])]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.component_id) for r in found} == {(5, 5), (6, 5), (7, 5), (8, 8)}
