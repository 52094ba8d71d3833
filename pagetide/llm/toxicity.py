"""Toxicity: a linear-chain conditional random field over the words of a document.

States are "clean" and "toxic span". A word's score is a sum of learned weights of its hashed
features (the word, its first 3 to 6 letters, its last 3); transitions have weights of their
own. Labels say which documents are toxic, not where: in the labelled sample, a word of a toxic
document is labelled toxic if one of its features is much oftener in toxic documents than in
others, by a likelihood-ratio test.
Forward-backward marginals give the toxic spans (offsets) and, added up, the document score,
which a logistic curve fitted on the same sample turns into a chance.

The sample is bounded: `SAMPLE` documents of each label, chosen by a hash of their text's
smallest three-word run, one for each such value, so that copies do not count as evidence.
Every chosen document is learned from. Token labels and the logistic curve read the whole of
it; the chains read the whole of it too, unless those of a label have over `SAMPLE_WORDS` words
together: then the documents above an equal allowance of words give pieces at random places.
Scoring reads every word of every document.

Defined results: null and word-less texts get the score of an empty sum; without labels of
both kinds every score is the share of toxic labels (0 without any); repeated rows are rows of
their own; rows with null ids are not held out; labels that are null, or that name no document,
are not used; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import pieces, table

SAMPLE = 3000  # labelled documents of each kind that the model is fitted on, at most
SAMPLE_WORDS = 1_500_000  # and words of each kind in the chains, at most; long documents give pieces
PIECE = 1000  # words of such a piece
DIMENSIONS = 1 << 18
FEATURES = 6
EVIDENT, OFTENER = 8.0, 5.0  # log likelihood ratio, and how much oftener in toxic documents
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.3, 1e-6
BLOCK = 128  # words that a block of a chain holds

_WORD = re.compile(r"\w+")


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(word: str) -> list[int]:
    """Hashed features; short words repeat the whole word, so each has the same number."""
    names = [f"={word}", *[f"{k}^{word[:k]}" if len(word) > k else f"={word}" for k in (3, 4, 5, 6)], f"${word[-3:]}"]
    return [xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


# --- chains -----------------------------------------------------------------------------


def _scan(steps: np.ndarray) -> np.ndarray:
    """Ratios r[t] of the two states after each 2x2 step, from r[-1] = 0; steps (n, 2, 2).

    A step maps r to (m10 + m11 r) / (m00 + m01 r). Blocks of steps are multiplied side by
    side, the short list of blocks is walked, then all blocks are filled side by side: a chain
    of any length costs BLOCK vector steps.
    """
    n = len(steps)
    rows = -(-n // BLOCK)
    padded = np.broadcast_to(np.eye(2), (rows * BLOCK, 2, 2)).copy()
    padded[:n] = steps
    padded = padded.reshape(rows, BLOCK, 2, 2)
    whole = padded[:, 0]
    for t in range(1, BLOCK):
        whole = padded[:, t] @ whole
        whole = whole / whole.sum(axis=(1, 2), keepdims=True)
    entry, r = np.zeros(rows), 0.0
    for k, m in enumerate(whole.tolist()):
        entry[k] = r
        r = (m[1][0] + m[1][1] * r) / (m[0][0] + m[0][1] * r)
    out = np.empty((rows, BLOCK))
    for t in range(BLOCK):
        m = padded[:, t]
        entry = (m[:, 1, 0] + m[:, 1, 1] * entry) / (m[:, 0, 0] + m[:, 0, 1] * entry)
        out[:, t] = entry
    return out.ravel()[:n]


def forward_backward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray):
    """(alpha, beta, weight): state ratios before and after each word of chains laid end to end.

    `scores` are log weights of state 1 over state 0; `starts` marks first words; `moves` are
    the weights (not logs) of going from a state (row) to a state (column). The marginal of
    state 1 is alpha * beta / (1 + alpha * beta).
    """
    weight = np.exp(np.clip(scores, -30, 30))
    n = len(weight)
    onto = np.empty((n, 2, 2))
    onto[:, 0, 0], onto[:, 0, 1] = moves[0, 0], moves[1, 0]
    onto[:, 1, 0], onto[:, 1, 1] = moves[0, 1] * weight, moves[1, 1] * weight
    # a first word does not depend on what stands before it
    onto[starts, 0], onto[starts, 1, 0], onto[starts, 1, 1] = 1.0, weight[starts], weight[starts]
    alpha = _scan(onto)
    back = np.empty((n, 2, 2))
    back[:-1, 0, 0], back[:-1, 0, 1] = moves[0, 0], moves[0, 1] * weight[1:]
    back[:-1, 1, 0], back[:-1, 1, 1] = moves[1, 0], moves[1, 1] * weight[1:]
    last = np.append(starts[1:], True)
    back[last] = 1.0
    beta = _scan(back[::-1])[::-1]
    return alpha, beta, weight


def marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    alpha, beta, _ = forward_backward(scores, starts, moves)
    both = alpha * beta
    return both / (1 + both)


# --- learning ---------------------------------------------------------------------------


def _labelled_words(docs: list[list[int]], table_: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
    """Token labels: words of toxic documents with a feature that is evidently oftener in these."""
    seen = np.zeros((2, DIMENSIONS))
    for types, label in zip(docs, toxic, strict=True):
        seen[int(label), np.unique(table_[np.unique(types)])] += 1 if len(types) else 0
    n = np.array([[max(1, (toxic == 0).sum())], [max(1, toxic.sum())]])
    rate, pooled = seen / n, seen.sum(axis=0) / n.sum()

    def likelihood(share):
        return np.nan_to_num(seen * np.log(share)) + np.nan_to_num((n - seen) * np.log1p(-share))

    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (likelihood(rate) - likelihood(pooled)).sum(axis=0)
    marks = (ratio >= EVIDENT) & (rate[1] >= OFTENER * rate[0])
    marking = marks[table_].any(axis=1)
    return [marking[types] & bool(label) for types, label in zip(docs, toxic, strict=True)]


def allowance(lengths: np.ndarray, most: int) -> int:
    """The largest number of words that each document may give without all giving over `most`; 1 at least."""
    low, high = 1, max(1, int(lengths.max(initial=1)))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(lengths, middle).sum() <= most else (low, middle - 1)
    return low


def chains_of(lengths: np.ndarray, toxic: np.ndarray, most: int, random: np.random.Generator) -> list[tuple[int, int, int]]:
    """(document, first, end) of the words to learn from; each document with words has a part."""
    given = [allowance(lengths[toxic == kind], most) for kind in (0, 1)]
    parts = []
    for d, (n, kind) in enumerate(zip(lengths.tolist(), toxic.tolist(), strict=True)):
        if n <= given[kind]:
            parts += [(d, 0, n)] if n else []
            continue
        size = min(PIECE, given[kind])
        # equal steps from a random start; what the start leaves over is a place of its own
        start = int(random.integers(size))
        places = [(max(0, a), min(n, a + size)) for a in range(start - size, n, size) if a + size > 0]
        for k in sorted(random.choice(len(places), given[kind] // size, replace=False).tolist()):
            parts.append((d, *places[k]))
    return parts


def fit(texts: list[str], toxic: np.ndarray, counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights, moves and the logistic curve, by Adagrad on the conditional likelihood."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())], dtype=np.int32) for t in texts]
    hashed = chain.from_iterable(map(features_of, number))
    table_ = np.fromiter(hashed, np.int32, FEATURES * len(number)).reshape(-1, FEATURES)
    del number
    labels = _labelled_words(docs, table_, toxic)
    w, square = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    bias, moves = -4.0, np.zeros((2, 2))
    bias_square, moves_square = 1e-6, np.full((2, 2), 1e-6)
    random = np.random.default_rng(seed)
    chains = chains_of(np.array([len(d) for d in docs]), toxic, SAMPLE_WORDS, random)
    for _ in range(EPOCHS):
        order = random.permutation(len(chains))
        for k in range(0, len(order), BATCH):
            part = [chains[c] for c in order[k : k + BATCH]]
            types, at = np.unique(np.concatenate([docs[d][a:b] for d, a, b in part]), return_inverse=True)
            y = np.concatenate([labels[d][a:b] for d, a, b in part])
            lengths = np.array([b - a for _, a, b in part])
            starts = np.zeros(len(at), dtype=bool)
            starts[np.cumsum(lengths) - lengths] = True
            scores = (w[table_[types]].sum(axis=1) + bias)[at]
            step = np.exp(moves)
            alpha, beta, weight = forward_backward(scores, starts, step)
            both = alpha * beta
            gap = both / (1 + both) - y
            # pairs of neighbours within a chain
            inner = np.flatnonzero(~starts)
            pair = np.empty((len(inner), 2, 2))
            pair[:, 0, 0] = step[0, 0]
            pair[:, 0, 1] = step[0, 1] * weight[inner] * beta[inner]
            pair[:, 1, 0] = alpha[inner - 1] * step[1, 0]
            pair[:, 1, 1] = alpha[inner - 1] * step[1, 1] * weight[inner] * beta[inner]
            expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            real = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
            by_type = np.bincount(at, weights=gap, minlength=len(types))
            rows = table_[types]
            gradient = np.bincount(rows.ravel(), weights=np.repeat(by_type, FEATURES), minlength=DIMENSIONS) + DECAY * w
            square += gradient**2
            w -= RATE * gradient / np.sqrt(square)
            bias_square += gap.sum() ** 2
            bias -= RATE * gap.sum() / np.sqrt(bias_square)
            turn = expected - real
            moves_square += turn**2
            moves -= 0.3 * RATE * turn / np.sqrt(moves_square)
    model = {"w": w.astype(np.float32), "bias": np.array(bias), "moves": np.exp(moves)}
    cache = WordScores(model)
    x = np.array([evidence(score_words(t, model, cache)) for t in texts])
    model["curve"] = _curve(x, toxic, counts)
    return model


def evidence(p: np.ndarray) -> np.ndarray:
    """What a document's marginals say: of the surest word, of all together, and of their share."""
    most = float(np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6))
    total = float(p.sum()) + 1e-3
    return np.array([np.log(most / (1 - most)), np.log(total), np.log(total / (len(p) + 20)), 1.0])


def _curve(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method; kinds weigh as often as they occur among all labels."""
    weight = (counts / np.maximum(1, np.bincount(y, minlength=2)))[y]
    weight *= len(y) / weight.sum()
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    middle[-1], spread[-1] = 0.0, 1.0  # the constant
    z = (x - middle) / spread
    ridge = np.array([0.3, 0.3, 0.3, 1e-3])

    def loss(b):
        return (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b))).sum() + 0.5 * (ridge * b * b).sum()

    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), g)
        size = 1.0
        while size > 1e-4 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
    b = b / spread
    b[-1] -= (b[:-1] * middle[:-1]).sum()
    return b


def _named(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned; of repeated ones the largest."""
    return (
        labels.filter("toxic in (0, 1) and doc_id is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(toxic, text, run): at most `most` labelled documents of each kind, distinct by a hash of runs."""

    @F.arrow_udf(T.LongType())
    def least_run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            keys = []
            for text in column.to_pylist():
                words = _WORD.findall((text or "").lower())
                runs = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
                keys.append(min(xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs) >> 1)
            yield pa.array(keys, pa.int64())

    # the narrow rows are sampled first, in the order of a hash; only the chosen texts travel
    chosen = _named(labels)
    wide = 3 * most
    chosen = chosen.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(wide).unionAll(
        chosen.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(wide)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    keyed = texts.withColumn("run", least_run("text")).dropDuplicates(["toxic", "run"])
    ordered = [
        keyed.filter(F.col("toxic") == kind).orderBy(F.xxhash64("run"), "run").limit(most).select("toxic", "text", "run")
        for kind in (0, 1)
    ]
    return ordered[0].unionAll(ordered[1])


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict[str, np.ndarray] | float:
    """The model, fitted in one task on the bounded sample; the share of toxic ones if it is one-sided."""
    kinds = _named(labels).groupBy("toxic").count().collect()
    counts = np.array([sum(r["count"] for r in kinds if r.toxic == k) for k in (0, 1)], dtype=float)

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("toxic", "ascending"), ("run", "ascending")])  # unique; only for equal results of reruns
        texts = [text or "" for text in rows["text"].to_pylist()]
        y = np.array(rows["toxic"].to_pylist())
        if len(set(y.tolist())) < 2:
            return pa.table({"name": ["share"], "value": [np.array([y.mean()]).astype("<f8").tobytes()]})
        model = fit(texts, y, counts)
        return pa.table({"name": list(model), "value": [v.astype("<f4" if k == "w" else "<f8").tobytes() for k, v in model.items()]})

    rows = sample(docs, labels, most).withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fitted, "name string, value binary").collect()
    read = {r.name: np.frombuffer(r.value, "<f4" if r.name == "w" else "<f8") for r in rows}
    if "w" not in read:
        return float(read["share"][0]) if read else 0.0
    return read | {"moves": read["moves"].reshape(2, 2)}


# --- scoring ----------------------------------------------------------------------------


class WordScores(dict):
    """Scores of words; the cache is emptied when full, so its size has a bound."""

    def __init__(self, model):
        super().__init__()
        self.w, self.bias = model["w"], float(np.ravel(model["bias"])[0])

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = float(self.w[features_of(word)].sum()) + self.bias
        return value


def score_words(text: str, model, cache: WordScores | None = None) -> np.ndarray:
    cache = WordScores(model) if cache is None else cache
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0)
    scores = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
    starts = np.zeros(len(words), dtype=bool)
    starts[0] = True
    return marginals(scores, starts, model["moves"])


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of the text in lower case stand in the text as it is."""
    lowered = text.lower()
    spans = [m.span() for m in _WORD.finditer(lowered)]
    if len(lowered) == len(text):
        return spans
    # a character may be several in lower case
    origin = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


_SCORED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
        ),
    ]
)


def scorer(spark: SparkSession, model):
    """A column function: text -> struct of the score and the toxic spans (code points)."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct(
        [("score", pa.float64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
    )

    @F.arrow_udf(_SCORED)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        cache = WordScores(model) if isinstance(model, dict) else None
        for column in texts:
            rows = []
            for part in pieces([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
                values = [t or "" for t in part.column(0).to_pylist()]
                if cache is None:
                    rows += [{"score": model, "spans": []}] * len(values)
                    continue
                words = [_WORD.findall(t.lower()) for t in values]
                lengths = np.array([len(x) for x in words])
                total = int(lengths.sum())
                scores = np.fromiter((s for x in words for s in map(cache.__getitem__, x)), np.float64, total)
                ends = np.cumsum(lengths)
                starts = np.zeros(total, dtype=bool)
                starts[(ends - lengths)[lengths > 0]] = True
                p = marginals(scores, starts, model["moves"]) if total else scores
                for text, a, b in zip(values, ends - lengths, ends, strict=True):
                    own = p[a:b]
                    x = float(model["curve"] @ evidence(own))
                    spans = []
                    if len(own) and own.max() >= 0.5:
                        places = word_places(text)
                        for k in np.flatnonzero(own >= 0.5).tolist():
                            if spans and k and spans[-1]["last"] == places[k - 1][1] and own[k - 1] >= 0.5:
                                spans[-1]["last"] = places[k][1]
                            else:
                                spans.append({"first": places[k][0], "last": places[k][1]})
                    rows.append({"score": float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), "spans": spans})
            yield pa.array(rows, kind)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every document."""
    score = scorer(docs.sparkSession, learn(docs, labels))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("t")).select(
        "doc_id",
        "held_out",
        F.col("t.score").alias("score"),
        (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
        F.col("t.spans").alias("spans"),
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Spans are written first:last, code points, end exclusive."""
    span = lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))
    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).withColumn(
        "spans", F.array_join(F.transform("spans", span), ",")
    )


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}  # a learned model; tests compare the chain with all paths and measure accuracy
