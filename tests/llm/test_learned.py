"""Language identification and toxicity."""

from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pytest

from pagetide.llm import language_id, toxicity


def out(i, k, r):
    return i is not None and zlib.crc32(str(i).encode()) % k == r


# --- language ---------------------------------------------------------------------------


def plain_grams(text):
    codes = [c if c > 127 or chr(c).isalpha() else 32 for c in map(ord, f" {text.lower()} ")]
    grams = []
    for k in range(len(codes)):
        for n in language_id.ORDERS:
            part = codes[k : k + n]
            if len(part) == n and part[:2] != [32, 32]:
                grams.append(tuple(part))
    return grams


def test_grams_are_those_of_each_text():
    texts = ["", "a", "  x  yz!", "été 12ü", "the cat"]
    flat, counts = language_id.ngrams(texts)
    assert counts.tolist() == [len(plain_grams(t)) for t in texts]
    start = 0
    for t, n in zip(texts, counts, strict=True):
        alone, _ = language_id.ngrams([t])
        assert flat[start : start + n].tolist() == alone.tolist()
        # equal n-grams have equal buckets
        assert len(set(plain_grams(t))) >= len(set(alone.tolist()))
        start += n


def test_scores_are_those_of_a_loop(spark):
    rows = [("en", "the cat and the dog"), ("de", "der Hund und die Katze"), ("en", "a bird in the tree"), (None, "x y")]
    langs, priors, matrix = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert langs == ["de", "en"]
    assert np.exp(priors) == pytest.approx([1 / 3, 2 / 3])
    texts = ["the tree", "und der", "zzz"]
    got = language_id.score_texts(texts, priors, matrix)
    for k, t in enumerate(texts):
        grams, _ = language_id.ngrams([t])
        total = sum(matrix[g].astype(float) for g in grams) * min(len(grams), language_id.EVIDENCE) / len(grams)
        total = np.exp(total + priors)
        assert got[k] == pytest.approx(total / total.sum(), rel=1e-5)


def test_language_of_odd_rows(odd, nothing):
    found = language_id.predict(odd).collect()
    assert len(found) == 10
    for r in found:
        assert r.held_out == out(r.doc_id, 3, 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5))
    assert language_id.predict(nothing).collect() == []
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn(odd):
    from pyspark.sql import functions as F

    found = language_id.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}


def test_language_accuracy(given):
    docs = given("documents")
    found = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97


# --- toxicity ---------------------------------------------------------------------------


def by_paths(scores, starts, moves):
    """Marginals of state 1 by summing over all paths of each chain."""
    cuts = [*np.flatnonzero(starts), len(scores)]
    result = np.zeros(len(scores))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        weights = {}
        for path in product((0, 1), repeat=b - a):
            w = np.prod([np.exp(s) for s, y in zip(scores[a:b], path, strict=True) if y])
            w *= np.prod([moves[x, y] for x, y in zip(path[:-1], path[1:], strict=True)])
            weights[path] = w
        whole = sum(weights.values())
        for k in range(b - a):
            result[a + k] = sum(w for p, w in weights.items() if p[k]) / whole
    return result


@pytest.mark.parametrize("block", [2, 3, 128])
def test_marginals_are_sums_over_paths(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    draw = np.random.default_rng(block)
    starts = np.zeros(23, dtype=bool)
    starts[[0, 1, 6, 15]] = True
    scores, moves = draw.normal(0, 2, 23), np.exp(draw.normal(0, 1, (2, 2)))
    assert toxicity.marginals(scores, starts, moves) == pytest.approx(by_paths(scores, starts, moves))


def test_long_chain_stays_finite():
    scores = np.random.default_rng(0).normal(0, 40, 50_000)
    starts = np.zeros(50_000, dtype=bool)
    starts[0] = True
    p = toxicity.marginals(scores, starts, np.array([[1.0, 1e-6], [1e6, 1.0]]))
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()


def test_learns_words_and_stems(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for k in range(300):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["vile", f"blorp{draw.choice(['an', 'ek', 'um'])}"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(900, "w1 w2 blorpzzz w3"), (901, None), (902, ""), (903, "w1 w2 w3"), (None, "vile vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int"))
    rows_ = {r.doc_id: r for r in found.collect()}
    assert len(rows_) == 305
    assert all(rows_[k].predicted == t for k, t in labels if rows_[k].held_out)
    assert rows_[900].predicted == 1 and rows_[None].predicted == 1
    assert [rows_[k].predicted for k in (901, 902, 903)] == [0, 0, 0]
    first, last = rows_[900].spans[0]
    assert "w1 w2 blorpzzz w3"[first:last] == "blorpzzz"
    assert all(r.held_out == out(r.doc_id, 5, 0) for r in rows_.values())


def test_one_huge_text_hides_no_other(spark, monkeypatch):
    """Labelled texts that sort behind a huge one, those of other scripts included, are learned from."""
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 20_000)
    draw = random.Random(6)
    rows, labels = [], []
    for k in range(240):
        script, vile = (("w", "vile"), ("слово", "гадость"))[k % 2]
        words = [f"{script}{draw.randrange(300)}" for _ in range(draw.randrange(5, 40))]
        toxic = k % 6 < 2
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), vile)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    for toxic in (0, 1):
        i = next(i for i in range(900 + toxic * 50, 1000) if not out(i, 5, 0))
        rows.append((i, " ".join(["a", *(f"w{draw.randrange(300)}" for _ in range(60_000)), *["vile"] * toxic])))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(k, t) for k, t in labels if out(k, 5, 0)]
    assert len(held) > 30 and all(found[k] == t for k, t in held)


def test_chains_leave_no_document_out():
    draw = np.random.default_rng(1)
    lengths = np.array([0, 5, 9_000_000, 40, 3000, 2_500_000, 7, 0, 1, 4000])
    toxic = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 1])
    parts = toxicity.chains_of(lengths, toxic, 50_000, draw)
    assert {d for d, _, _ in parts} == set(np.flatnonzero(lengths).tolist())
    assert all(0 <= a < b <= lengths[d] for d, a, b in parts)
    given = np.bincount([d for d, _, _ in parts], [b - a for _, a, b in parts], minlength=10)
    small = lengths < 5000
    assert (given[small] == lengths[small]).all()
    assert all(45_000 <= given[toxic == k].sum() <= 50_000 for k in (0, 1))
    # with room for all, each document is one chain
    assert toxicity.chains_of(lengths, toxic, 10**8, draw) == [(d, 0, n) for d, n in enumerate(lengths.tolist()) if n]


def test_toxicity_without_labels(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, none).collect()} == {(0.0, 0)}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, ones).collect()} <= {1.0}
    both = spark.createDataFrame([(1, 0), (7, 1), (6, 1), (8, 0)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(odd, both).collect()) == 10
    assert toxicity.toxicity(nothing, both).collect() == []


def test_toxicity_accuracy(given):
    found = toxicity.toxicity(given("documents"), given("labels")).join(given("labels"), "doc_id").collect()
    share = np.mean([r.toxic for r in found])
    # a few dozen labels at the smallest size; better than guessing, and no clean one accused
    assert np.mean([r.toxic == r.predicted for r in found]) >= 1 - share
    assert np.mean([r.predicted for r in found if not r.toxic]) < 0.02


def test_offsets_are_those_of_the_text_as_it_is():
    """Where a character is two in lower case, words stand further to the left than in that."""
    text = "\u0130\u0130 ab vile \u0130cd"
    assert [text[a:b] for a, b in toxicity.word_places(text)] == ["\u0130", "\u0130", "ab", "vile", "\u0130", "cd"]
