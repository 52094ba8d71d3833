"""Quality: co-training of a text view and a metadata view.

Two logistic classifiers see a document from different sides: what its text says and is like
(hashed words; shares of letters, digits, capitals and symbols, repetition of words and lines,
lengths) and what is known of its page (source, language, length). Each starts from labelled
documents. In every round each tells of all unlabelled documents it is sure of, and the other
learns from these verdicts too: nothing is sampled or capped on the unlabelled side. A round is
a few Newton steps; a step is one pass in which tasks add up gradients and curvatures, two small
matrices, whatever the number of documents. Verdicts of a kind together weigh at most `HEAVY` times
the labels of that kind, so a view that is sure too often of one kind does not drown them.

At the end a third logistic curve combines the logits of both views. It is fitted on labelled
documents that neither view has learned from, so it calibrates them as they are on new ones.

Labelled documents are bounded: `SAMPLE` of each kind for the views and half as many for the
curve, chosen by a hash of the id. The features of all documents are written once and read by
every step and by the scoring.

Defined results: null texts are empty, null metadata is a value of its own; without labels of
both kinds every score is the share of good labels (0.5 without any); labels that are null or
name no document are not used, of repeated ones the largest is; repeated rows are rows of
their own; rows with null ids are neither held out nor learned from; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import table, written

SAMPLE = 4000
ROUNDS, STEPS, SURE = 3, 2, 0.95
RIDGE = 0.1
HEAVY = 1  # times the labels of a kind: the most that all verdicts of that kind weigh
WORDS = 128  # slots of the hashed words
SOURCES, LANGUAGES = 64, 16  # slots of the hashed metadata values
SHAPE = 12
TEXT = SHAPE + WORDS
META = SOURCES + LANGUAGES + 3
_ORDERS = 64  # groups that partial sums of tasks are added up in

_DIGITS, _CAPITALS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS, _ENDS = b"#$%&*@^~|<>{}[]\\=+_", b".!?"


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def calibrating(id_column: Column) -> Column:
    """Labelled documents that only the last curve learns from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Slots(dict):
    """Slots of words; the cache is emptied when full, so its size has a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = slot = xxhash.xxh3_64_intdigest(word.lower()) % WORDS
        return slot


_SLOTS = Slots()


def said(words: list[str]) -> list[float]:
    """How often each slot's words occur. The scale is small, so that much evidence is needed to believe words."""
    slots = np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words))
    counts = np.bincount(slots, minlength=WORDS)
    return (np.sqrt(counts / max(1, len(words))) * 0.4).tolist()


def text_view(text: str) -> list[float]:
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    size, n = max(1, len(raw)), max(1, len(words))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    return [
        share(_DIGITS),
        share(_CAPITALS),
        share(_SYMBOLS),
        share(b"!") * 10,
        share(_ENDS) * 10,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(raw) / n / 10,
        float(np.log1p(max(map(len, words), default=0))),
        float(np.log1p(len(words))),
        len(lines) / n,
        1.0,
        *said(words),
    ]


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    view = [0.0] * META
    view[xxhash.xxh3_64_intdigest(f"s{source}") % SOURCES] = 1.0
    view[SOURCES + xxhash.xxh3_64_intdigest(f"l{lang}") % LANGUAGES] = 1.0
    size = float(np.log1p(max(0, n_chars or 0)))
    view[-3:] = [size, size * size / 10, 1.0]
    return view


@F.arrow_udf(T.BinaryType())
def views(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
    """Both views of each document, as half-precision numbers."""
    rows = zip(texts.to_pylist(), sources.to_pylist(), langs.to_pylist(), sizes.to_pylist(), strict=True)
    found = (text_view(t or "") + metadata_view(s, g, n) for t, s, g, n in rows)
    return pa.array([np.minimum(x, 60_000).astype("<f2").tobytes() for x in found], pa.binary())


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(len(column), TEXT + META).astype(np.float64)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic weights by Newton's method with step halving."""
    weight = np.ones(len(y)) if weight is None else weight
    b = np.zeros(x.shape[1])

    def loss(b):
        return (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b))).sum() + 0.5 * ridge * b @ b

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), g)
        size = 1.0
        while size > 1e-4 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max(initial=0) < 1e-6:
            break
    return b


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


PARTS = (slice(0, TEXT), slice(TEXT, TEXT + META))
Views = list[np.ndarray]  # weights of the text view and of the metadata view


class Sums:
    """What verdicts add to a Newton step of each view, kind by kind: count, gradient, curvature."""

    def __init__(self):
        self.parts = {(k, y): [0.0, np.zeros(w), np.zeros((w, w))] for k, w in enumerate((TEXT, META)) for y in (0, 1)}

    def add(self, x: np.ndarray, told_by: Views, now: Views) -> None:
        """The rows of x that one view of `told_by` is sure of teach the other one, which is at `now`."""
        for k in (0, 1):
            p = chance(x[:, PARTS[1 - k]] @ told_by[1 - k])
            for y, sure in ((1, p >= SURE), (0, p <= 1 - SURE)):
                own = x[sure][:, PARTS[k]]
                q = chance(own @ now[k])
                part = self.parts[k, y]
                part[0] += len(own)
                part[1] += own.T @ (q - y)
                part[2] += (own * (q * (1 - q))[:, None]).T @ own

    def packed(self) -> bytes:
        return b"".join(np.concatenate([[n], g, h.ravel()]).astype("<f8").tobytes() for n, g, h in self.parts.values())

    def merge(self, packed: bytes) -> None:
        numbers, at = np.frombuffer(packed, "<f8"), 0
        for (k, _), part in self.parts.items():
            w = (TEXT, META)[k]
            part[0] += numbers[at]
            part[1] += numbers[at + 1 : at + 1 + w]
            part[2] += numbers[at + 1 + w : at + 1 + w + w * w].reshape(w, w)
            at += 1 + w + w * w


def verdicts(pool: DataFrame, told_by: Views, now: Views) -> Sums:
    """One pass over the unlabelled documents (x): their sums for the next step of both views."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = Sums(), False
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                sums.add(matrix(batch.column(0).slice(start, 2048)), told_by, now)
                seen = True
        if seen:
            packed = sums.packed()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(packed) % _ORDERS], pa.int64()), pa.array([packed], pa.binary())], ["slot", "sums"])

    def merged(rows: pa.Table) -> pa.Table:
        sums = Sums()
        for packed in sorted(rows["sums"].to_pylist()):
            sums.merge(packed)
        return pa.table({"sums": pa.array([sums.packed()], pa.binary())})

    partial = pool.select("x").mapInArrow(work, "slot long, sums binary")
    whole = Sums()
    for row in sorted(partial.groupBy("slot").applyInArrow(merged, "sums binary").collect()):  # _ORDERS rows at most
        whole.merge(bytes(row.sums))
    return whole


def cotrain(x: np.ndarray, y: np.ndarray, told, rounds: int = ROUNDS) -> Views:
    """The views after all rounds, from labelled x, y; `told` gives the sums of the unlabelled."""
    now = [logistic(x[:, part], y, ridge=RIDGE) for part in PARTS]
    for _ in range(rounds):
        told_by = [m.copy() for m in now]
        for _ in range(STEPS):
            sums = told(told_by, now)
            for k, part in enumerate(PARTS):
                own = x[:, part]
                q = chance(own @ now[k])
                gradient = own.T @ (q - y) + RIDGE * now[k]
                curvature = (own * (q * (1 - q))[:, None]).T @ own + RIDGE * np.eye(own.shape[1])
                for kind in (0, 1):
                    n, g, h = sums.parts[k, kind]
                    weight = min(1.0, HEAVY * (y == kind).sum() / n) if n else 0.0
                    gradient, curvature = gradient + weight * g, curvature + weight * h
                step = np.linalg.solve(curvature, gradient)
                # far from the minimum a whole step may overshoot
                now[k] = now[k] - step * min(1.0, 4.0 / max(1e-12, np.abs(own @ step).max(initial=0)))
    return now


def logits_of(x: np.ndarray, models: Views) -> np.ndarray:
    return np.stack([x[:, part] @ m for part, m in zip(PARTS, models, strict=True)] + [np.ones(len(x))], axis=1)


Model = tuple[Views, np.ndarray] | float


def learn(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model from (doc_id, x) and labels; the share of good ones if these are one-sided."""
    named = (
        labels.filter("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .filter(~held_out(F.col("doc_id")))
        .withColumn("curve", calibrating(F.col("doc_id")))
    )
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for kind in (0, 1):
        for curve, most in ((False, SAMPLE), (True, SAMPLE // 2)):
            one = named.filter((F.col("quality") == kind) & (F.col("curve") == curve)).orderBy(*by_hash).limit(most)
            chosen = one if chosen is None else chosen.unionAll(one)
    rows = features.join(F.broadcast(chosen), "doc_id").select("quality", "curve", "x").toArrow()  # 3 * SAMPLE ids
    x, y = matrix(rows["x"].combine_chunks()), rows["quality"].to_numpy()
    curve = rows["curve"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((*x.T, y, curve))  # rows arrive in any order; sums must not depend on it
    x, y, curve = x[order], y[order], curve[order]
    if len(set(y[~curve].tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    free = features.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pool = written(free.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("x"), "pool")
    models = cotrain(x[~curve], y[~curve], lambda told_by, now: verdicts(pool, told_by, now), rounds)
    last = curve if len(set(y[curve].tolist())) == 2 else np.ones(len(y), dtype=bool)
    return models, logistic(logits_of(x[last], models), y[last], ridge=0.1)


def quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, score, text_score, metadata_score, predicted) for every document."""
    seen = views("text", "source", "lang", F.col("n_chars").cast("long"))
    features = written(docs.select("doc_id", seen.alias("x")), "views")
    model = learn(features, labels, rounds)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            x = matrix(column)
            if isinstance(model, float):
                found = np.full((len(x), 3), model)
            else:
                z = logits_of(x, model[0])
                found = np.stack([chance(z @ model[1]), chance(z[:, 0]), chance(z[:, 1])], axis=1)
            yield pa.array(found.tolist(), pa.list_(pa.float64()))

    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("s")).select(
        "doc_id",
        "held_out",
        F.col("s")[0].alias("score"),
        F.col("s")[1].alias("text_score"),
        F.col("s")[2].alias("metadata_score"),
        (F.col("s")[0] >= 0.5).cast("int").alias("predicted"),
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}  # a learned model; tests measure accuracy
