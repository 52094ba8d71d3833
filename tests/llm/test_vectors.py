"""The operators on embeddings against plain numpy."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetide.llm import nearest, vector_codes, whitening

KIND = "vec_id long, embedding array<float>, label int, id string, vector string, n string, x string, list string, raw string"


def table_of(spark, rows):
    """Rows (vec_id, embedding, label), with more columns whose names the operators use inside."""
    full = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], g, *["?"] * 6) for i, v, g in rows]
    return spark.createDataFrame(full, KIND)


def drawn(n, width=8, seed=3, spread=1.0):
    random = np.random.default_rng(seed)
    return [(i, (random.standard_normal(width) * spread).round(3).tolist(), i % 3) for i in range(n)]


NAN, INF = float("nan"), float("inf")
ODD = [
    (1, None, 1),
    (2, [0.1, None, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], 1),
    (3, [NAN, 1, 1, 1, 1, 1, 1, 1], 1),
    (4, [INF, 1, 1, 1, 1, 1, 1, 1], None),
    (5, [], 2),
    (6, [1.0, 2.0, 3.0], 2),
    (7, [0.0] * 8, None),
    (50, [0.5, -0.5, 0.25, 0.0, 0.1, 0.2, 0.3, 0.4], 1),
    (50, [0.5, -0.5, 0.25, 0.0, 0.1, 0.2, 0.3, 0.4], 1),
    (8, [0.5, -0.5, 0.25, 0.0, 0.1, 0.2, 0.3, 0.4], None),
    (None, [0.5, -0.5, 0.25, 0.0, 0.1, 0.2, 0.3, 0.4], None),
    (9, [-0.5, 0.5, 0.25, 0.0, -0.1, 0.2, 0.3, 1.4], 0),
]


def fine(rows, width=8):
    found = []
    for i, v, g in rows:
        if v is not None and len(v) == width and None not in v and all(map(math.isfinite, v)):
            found.append((i, np.array(v, dtype=np.float32).astype(float), g))
    return found


# --- nearest neighbours -----------------------------------------------------------------


def exact_nearest(rows, k=5):
    kept = {(i, v.tobytes()): v for i, v, _ in fine(rows) if v.any()}
    found = {}
    for (q, raw), v in kept.items():
        if q is None or q % 50:
            continue
        near = []
        for (i, _), w in kept.items():
            if i != q:
                near.append((-(v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w), math.inf if i is None else i))
        near.sort(key=lambda x: (round(x[0], 12), x[1]))
        found[q] = [(None if i == math.inf else i, -s) for s, i in near[:k]]
    return found


def by_query(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def searched(frame, **more):
    return by_query(nearest.search(frame, F.col("id") % 50 == 0, **more))


@pytest.mark.parametrize("lists", [1, 6])
def test_all_lists_give_all_neighbours(spark, lists):
    rows = drawn(260) + [(1000 + i, v, 0) for i, v, _ in drawn(260)[:40]]  # ties
    got = searched(table_of(spark, rows), lists=lists, probes=lists, block_rows=16)
    want = exact_nearest(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)


def test_nearest_odd_rows(spark):
    rows = ODD + drawn(30)[10:]
    got = searched(table_of(spark, rows))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {
        q: [i for i, _ in near] for q, near in exact_nearest(rows).items()
    }
    assert not searched(table_of(spark, []))
    assert not searched(table_of(spark, ODD[:7]))
    alone = searched(table_of(spark, [(50, [1.0, 0, 0], 1), (51, [1.0, 1.0, 0], 1)]))
    assert [(q, [i for i, _ in near]) for q, near in alone.items()] == [(50, [51])]


def test_a_vector_of_many_rows_is_compared_once(spark):
    rows = drawn(200) + [(10_000 + i, [0.5] * 8, 1) for i in range(600)]
    frame = table_of(spark, rows)
    distinct, queries, width, dtype, members = nearest.entries(frame.selectExpr("vec_id AS id", "embedding AS vector"), F.col("id") % 50 == 0, 5)
    assert distinct.count() == 201 and max(len(r.ids) for r in distinct.collect()) == members == 6
    assert queries.count() == 4 + 12
    got = searched(frame)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {
        q: [i for i, _ in near] for q, near in exact_nearest(rows).items()
    }


def test_measured_lists_reach_the_recall(spark):
    rows = drawn(3000, width=8, seed=5)
    got = searched(table_of(spark, rows), lists=30)
    want = exact_nearest(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(len(near) for near in want.values())


def test_the_scan_abandons_most_candidates():
    random = np.random.default_rng(2)
    own, stored = (random.standard_normal((n, 64)).astype(np.float32) for n in (20, 2000))
    own, stored = (nearest.units(x).astype(np.float32) for x in (own, stored))
    cuts = [slice(c, c + 16) for c in range(0, 64, 16)]
    at, candidate = nearest.scan([own[:, c] for c in cuts], [stored[:, c] for c in cuts], np.full(20, np.inf), 5)
    near = np.argsort(-(own @ stored.T), axis=1)[:, :5]
    left = {(q, c) for q, c in zip(at.tolist(), candidate.tolist(), strict=True)}
    assert sum((q, c) in left for q in range(20) for c in near[q].tolist()) >= 97
    assert len(left) < 0.02 * 20 * 2000


# --- vector codes -----------------------------------------------------------------------


def exact_codes(rows, rounds=4):
    kept = sorted(fine(rows, len(rows[-1][1])), key=lambda r: (math.inf if r[0] is None else r[0], r[1].tolist()))
    x = np.array([np.floor(1024 * v) for _, v, _ in kept]).astype(np.int64)
    part = x.shape[1] // 4
    books, codes, error = [], [], np.zeros(len(x), dtype=np.int64)
    for p in range(4):
        own = x[:, p * part : (p + 1) * part]
        book = own[:256].copy()
        for turn in range(rounds + 1):
            squares = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            code = squares.argmin(axis=1)
            if turn < rounds:
                for j in set(code.tolist()):
                    of = own[code == j]
                    book[j] = of.sum(axis=0) // len(of)
        books.append(book)
        codes.append(code)
        error += squares.min(axis=1)
    by_label = defaultdict(int)
    for (_, _, g), e in zip(kept, error.tolist(), strict=True):
        by_label[g] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return sorted(
        ((i, bytes(c).hex(), e, by_label[g], sha) for (i, _, g), c, e in zip(kept, zip(*codes, strict=True), error.tolist(), strict=True)),
        key=str,
    )


def coded(df):
    return sorted(((r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [drawn(900), drawn(700, seed=8, spread=0.01), ODD + drawn(320)[60:], ODD, drawn(300, width=4)], ids=len)
def test_codes_equal_plain_rounds(spark, rows):
    assert coded(vector_codes.encode(table_of(spark, rows))) == exact_codes(rows)


def test_codes_of_no_or_unfit_vectors(spark):
    assert not vector_codes.encode(table_of(spark, [])).collect()
    assert not vector_codes.encode(table_of(spark, ODD[:5])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode(table_of(spark, [(1, [1.0, 2.0, 3.0], 0)]))


@pytest.mark.parametrize("b", [4, 8, 40])
def test_bounds_hold_and_lists_adapt(b):
    """Through rounds of moving entries, bounds stay below true distances and owners are nearest."""
    random = np.random.default_rng(b)
    x = random.integers(-40, 40, (500, 3))
    book = x[:64].copy()
    state = vector_codes.Bounds.measured(x, book, b)
    for turn in range(5):
        needed = np.zeros(b + 2, dtype=np.int64)
        new = book + random.integers(-1 - turn % 2, 2, book.shape)
        by = vector_codes._root(((new - book) ** 2).sum(axis=1))
        state, book = state.moved(by, b).assign(x, new, needed), new
        squares = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (state.own == squares.argmin(axis=1)).all()
        roots = np.sqrt(squares)
        assert (state.lower <= np.take_along_axis(roots, state.near.astype(int), 1) + 1e-9)[np.isfinite(state.lower)].all()
        others = roots.copy()
        np.put_along_axis(others, state.near.astype(int), np.inf, 1)
        others[np.arange(500), state.own] = np.inf
        assert (state.outer <= others.min(axis=1)).all()
        assert needed.sum() == 500
    assert vector_codes.adapted(32, np.array([90, 5, 4, 1, *[0] * 29, 0])) == vector_codes.LEAST
    assert vector_codes.adapted(16, np.array([50, *[0] * 16, 50])) == 32 == vector_codes.MOST
    assert vector_codes.adapted(32, np.zeros(34, dtype=int)) == 32


def test_large_components_are_exact():
    x = np.array([[1 << 28, -(1 << 28)], [3, 4]], dtype=np.int64)
    assert vector_codes.distances(x, x).tolist() == [[0, 2 * (1 << 56) + (-3 * 2 + 4 * 2) * (1 << 28) + 25], [2 * (1 << 56) + 2 * (1 << 28) + 25, 0]]


# --- whitening --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_counts_of_inertia(n):
    random = np.random.default_rng(n)
    for _ in range(40):
        a = random.integers(-3, 4, (n, n)).astype(float)
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        shift = float(random.uniform(values[0] - 1, values[-1] + 1))
        assert whitening.below(a - shift * np.eye(n)) == (values < shift).sum()


def test_equal_eigenvalues():
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 20)))[0]
    whole = turn @ np.diag([5.0, 5, 5, 3, 3, 2, 2, 2, *[1.0] * 12]) @ turn.T
    whole = (whole + whole.T) / 2
    values, axes = whitening.leading(whole, 8)
    assert values == pytest.approx([5, 5, 5, 3, 3, 2, 2, 2], abs=1e-12)
    assert np.abs(axes @ axes.T - np.eye(8)).max() < 1e-12
    assert np.abs(axes @ whole - values[:, None] * axes).max() < 1e-12


@pytest.mark.parametrize("rows", [drawn(200, width=12), ODD + drawn(30), drawn(5), [(i, [1e6 * i, 1e-3 * i * i, 5.0, 0], 0) for i in range(50)]], ids=len)
def test_whitening_equals_numpy(spark, rows):
    width = len(rows[-1][1])
    kept = fine(rows, width)
    x = np.array([np.floor(1024 * v) for _, v, _ in kept]).astype(np.int64).astype(object)
    n, sums = len(x), x.sum(axis=0)
    covariance = np.array(((n * x - sums).T @ (n * x - sums)).tolist(), dtype=object)
    exact = np.array([[c / n**3 for c in r] for r in covariance.tolist()])
    values, axes = np.linalg.eigh(exact)
    k = min(8, int((values > 1e-11 * values.sum()).sum()))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    found = whitening.whiten(table_of(spark, rows)).collect()
    assert len(found) == n * k
    assert {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, k + 1))
    assert all(r.identity_error == found[0].identity_error < 1e-4 for r in found)
    for c in range(k):
        mine = sorted((str(r.id), int(r.deviation), abs(r.whitened)) for r in found if r.component == c + 1)
        white = np.abs(((x - sums / n).astype(float) @ axes[:, c]) / math.sqrt(values[c]))
        own = sorted((str(i), int(((n * v - sums) ** 2).sum()), w) for (i, _, _), v, w in zip(kept, x, white, strict=True))
        assert [m[:2] for m in mine] == [o[:2] for o in own]
        assert [m[2] for m in mine] == pytest.approx([o[2] for o in own], abs=1e-6)
        assert next(r.explained for r in found if r.component == c + 1) == pytest.approx(values[c] / np.trace(exact), rel=1e-4)


def test_nothing_to_whiten(spark):
    for rows in ([], ODD[:5], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        assert not whitening.whiten(table_of(spark, rows)).collect()


def test_large_numbers_stay_exact():
    x = np.array([[1 << 45, 3], [-(1 << 45), 5]], dtype=np.int64)
    assert whitening.products(x).tolist() == [[2 << 90, (3 - 5) << 45], [(3 - 5) << 45, 34]]
    assert whitening.deviations(x, 10**9, np.array([7, 1], dtype=object)) == [
        (10**9 * a - 7) ** 2 + (10**9 * b - 1) ** 2 for a, b in [(1 << 45, 3), (-(1 << 45), 5)]
    ]
