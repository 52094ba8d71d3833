"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams of every labelled text per language; the counts are added up by
Spark and end as one log-probability matrix (buckets x languages, bounded by `BUCKETS` and
`MAX_LANGUAGES`), which is broadcast. Scoring gathers the matrix rows of the n-grams that
occur in a batch and sums them per text; absent n-grams cost nothing.

Defined results: `und` with score 0 for a text that is null or has no letter, and for every
text if nothing could be learned; rows with a null id are not held out; repeated rows are
scored (and learned) as often as they occur; labels that are null are not learned; of equally
likely languages the first by name is taken; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import pieces, table

BUCKETS = 1 << 15
ORDERS = (2, 3)
MAX_LANGUAGES = 512
SMOOTHING = 0.5
EVIDENCE = 40  # n-grams that a score weighs at most: neighbours depend on each other
LEAST_SCORE = 0.5  # the pipeline rejects below

# ASCII that is no letter counts as a space
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and how many each text has; texts are framed by spaces."""
    framed = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in framed], dtype=np.int64)
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    buckets = np.empty((len(codes), len(ORDERS)), dtype=np.int64)
    for k, n in enumerate(ORDERS):
        value = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
        for j in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(value)]
            value ^= value >> np.uint64(29)
        value = (value * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        # n-grams that reach over the end of their text, and runs of spaces, are not counted
        inside = np.arange(len(value)) + n <= ends[owner[: len(value)]]
        blank = (codes[: len(value)] == 32) & (codes[1 : len(value) + 1] == 32)
        buckets[: len(value), k] = np.where(inside & ~blank, value.astype(np.int64), -1)
        buckets[len(value) :, k] = -1
    flat = buckets.ravel()
    real = flat >= 0
    counts = np.bincount(np.repeat(owner, len(ORDERS))[real], minlength=len(texts))
    return flat[real], counts


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, priors, matrix) from rows (lang, text)."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in pieces(batches, "text"):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            grams, counts = ngrams([t or "" for t in batch.column("text").to_pylist()])
            index = np.array([names.index(x) for x in langs])
            seen = np.bincount(np.repeat(index, counts) * BUCKETS + grams, minlength=len(names) * BUCKETS)
            for k, name in enumerate(names):
                part = seen[k * BUCKETS : (k + 1) * BUCKETS]
                totals[name] = part if name not in totals else totals[name] + part
                documents[name] = documents.get(name, 0) + int((index == k).sum())
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(used) + 1), pa.string()),
                    pa.array(np.concatenate(([-1], used)).astype(np.int32)),  # -1: documents
                    pa.array(np.concatenate(([documents[name]], total[used])).astype(np.int64)),
                ],
                ["lang", "bucket", "n"],
            )

    summed = (
        labelled.filter("lang is not null")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    found = summed.limit((BUCKETS + 1) * MAX_LANGUAGES + 1).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: raise MAX_LANGUAGES if memory allows")
    number = {x: k for k, x in enumerate(langs)}
    row = np.array([number[x] for x in found["lang"].to_pylist()], dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts, documents = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    grams = bucket >= 0
    counts[bucket[grams], row[grams]] = n[grams]
    documents[row[~grams]] = n[~grams]
    matrix = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    priors = np.log(documents / max(1.0, documents.sum())) if len(langs) else documents
    return langs, priors, matrix.astype(np.float32)


def score_texts(texts: list[str], priors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Posterior of each language for each text, from at most EVIDENCE n-grams' worth of evidence."""
    grams, counts = ngrams(texts)
    total = np.zeros((len(texts), len(priors)))
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        total[some] = np.add.reduceat(matrix[grams], starts, axis=0, dtype=np.float64)
    total *= (np.minimum(counts, EVIDENCE) / np.maximum(counts, 1))[:, None]
    total += priors
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def identifier(spark: SparkSession, model: tuple[list[str], np.ndarray, np.ndarray]):
    """A column function: text -> struct of lang and score."""
    langs, priors, matrix = model
    shared = spark.sparkContext.broadcast(matrix)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        size = max(1 << 14, (1 << 22) // max(4, len(langs)))
        for column in texts:
            rows = []
            for part in pieces([pa.RecordBatch.from_arrays([column], ["text"])], "text", size):
                values = [t or "" for t in part.column(0).to_pylist()]
                lettered = [any(map(str.isalpha, t)) for t in values]
                if not langs:
                    rows += [{"lang": "und", "score": 0.0}] * len(values)
                    continue
                chances = score_texts(values, priors, shared.value)
                best = chances.argmax(axis=1)
                for k, b in enumerate(best):
                    rows.append(
                        {"lang": langs[b], "score": float(chances[k, b])}
                        if lettered[k]
                        else {"lang": "und", "score": 0.0}
                    )
            yield pa.array(rows, kind)

    return identify


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for rows (doc_id, text, lang); learned from them too."""
    training = docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
    identify = identifier(docs.sparkSession, learn(training))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify("text").alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"
    )


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told with a score of `least` or more."""
    training = docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
    found = identifier(docs.sparkSession, learn(training))("text")
    return docs.filter((found["lang"] != "und") & (found["score"] >= least))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return predict(table(spark, folder, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}  # a learned model; tests compare with plain loops and measure accuracy
