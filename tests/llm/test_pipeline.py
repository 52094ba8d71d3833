"""The stages of the pipeline, each against a brute-force version over what the one before kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from llm_support import FOLDER, documents
from pyspark.sql import functions as F
from test_duplicates import near
from test_texts import hits, water

from pagetide.llm import language_id


def brute(name, rows, docs, items):
    """Ids that a stage keeps, of rows (doc_id, text)."""
    if name == "language_id":
        found = language_id.predict(docs).filter(f"lang_pred <> 'und' and score >= {language_id.LEAST_SCORE}")
        return Counter(r.doc_id for r in found.collect())
    if name == "exact_dedup":
        groups = defaultdict(list)
        for i, t in rows:
            groups[(t or "").encode().lower()].append(i)
        return Counter(max(ids) for ids in groups.values())
    if name == "jaccard_join":
        return Counter(i for i, (_, root) in near(rows, 5, 80).items() if i == root)
    return Counter(i for i, t in rows if not hits(t, items, 10)[1])


def test_stages(spark, given):
    docs, items = given("documents"), [(str(r.item_id), r.text) for r in given("benchmark").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        ids = Counter(r.doc_id for r in after.collect())
        assert ids == brute(name, rows, docs, items)
        kept.append(len(rows) - sum(ids.values()))
        docs = after
    assert kept[1] and kept[2] and kept[3]  # every filter had something to do
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    found = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    taken = Counter()
    for r in found.join(docs.select("doc_id", "source"), "doc_id").collect():
        taken[r.source] += r.taken
        assert r.target == pytest.approx(water(sizes)[r.source])
    assert all(abs(taken[s] - t) <= 1 for s, t in water(sizes).items())
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(whole.collect()) == sorted(found.collect())


def test_stages_of_odd_rows(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, nothing, documents(spark, [(1, None, None, None)])):
        docs = docs.withColumn("dropped", F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            docs = after
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
