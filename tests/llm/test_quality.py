"""Quality by co-training."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pagetide.llm import quality


def test_logistic_is_a_minimum():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(300, 3)), np.ones((300, 1))], axis=1)
    y = (draw.random(300) < quality.chance(x @ np.array([2.0, -1.0, 0.0, 0.5]))).astype(int)
    b = quality.logistic(x, y)
    gradient = x.T @ (quality.chance(x @ b) - y) + b
    assert np.abs(gradient).max() < 1e-4


def made(draw, good):
    text = " ".join(f"word{draw.randrange(900)}" if good else "## $$ 11 %%" for _ in range(draw.randrange(20, 60)))
    source = f"s{draw.randrange(0, 6) + (0 if good else 6)}"
    return text, source


def test_views_teach_each_other():
    """Few labels; what the text view is sure of tells the metadata view the good sources."""
    draw = random.Random(1)

    def document(good):
        text, source = made(draw, good)
        return [*quality.text_view(text), *quality.metadata_view(source, "en", len(text))]

    x, y = np.array([document(k % 2) for k in range(30)]), np.arange(30) % 2
    pool = np.array([document(k % 2) for k in range(2000)])

    def told(told_by, now):
        sums = quality.Sums()
        sums.add(pool, told_by, now)
        again = quality.Sums()
        again.merge(sums.packed())
        return again

    models = quality.cotrain(x, y, told)
    alone = quality.cotrain(x, y, told, rounds=0)
    test = np.array([document(k % 2) for k in range(400)])
    kinds = np.arange(400) % 2

    def right(models, part):
        return ((quality.chance(test[:, quality.PARTS[part]] @ models[part]) >= 0.5) == kinds).mean()

    assert right(models, 1) >= 0.93 > 0.9 > right(alone, 1) and right(models, 0) >= 0.97


def test_all_unlabelled_documents_teach(spark):
    """A pool of 9,000: every sure one is counted, and passes agree with one over all rows at once."""
    draw = random.Random(2)
    rows = [(k, *made(draw, k % 2)) for k in range(9100)]
    docs = spark.createDataFrame([(k, t, s, "en", len(t)) for k, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, quality int")
    features = docs.repartition(7).select("doc_id", quality.views("text", "source", "lang", "n_chars").alias("x"))
    x = quality.matrix(features.select("x").toArrow()["x"].combine_chunks())
    some = features.filter("doc_id < 600").toArrow()
    first, y = quality.matrix(some["x"].combine_chunks()), some["doc_id"].to_numpy() % 2
    models = [quality.logistic(first[:, part], y, ridge=quality.RIDGE) for part in quality.PARTS]
    whole = quality.Sums()
    whole.add(x, models, models)
    passed = quality.verdicts(features, models, models)
    assert whole.parts[1, 0][0] + whole.parts[1, 1][0] > 8000
    for key, (n, g, h) in whole.parts.items():
        assert passed.parts[key][0] == n
        assert np.allclose(passed.parts[key][1], g) and np.allclose(passed.parts[key][2], h)
    found = quality.quality(docs, labels).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in found]) >= 0.99


def test_quality_of_odd_rows(spark, odd, nothing):
    for rows in ([], [(1, 1), (2, 1)], [(1, 1), (2, 0), (6, 0), (7, 1), (None, 1), (4, None), (99, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        found = quality.quality(odd, labels).collect()
        assert len(found) == 10
        for r in found:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality.quality(nothing, labels).collect() == []


def test_quality_accuracy(given):
    found = quality.quality(given("documents"), given("labels")).join(given("labels"), "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in found])
    assert right >= max(0.9, np.mean([r.quality for r in found]))
    assert np.mean([r.predicted for r in found if r.quality]) == pytest.approx(1, abs=0.05)
