"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Vectors become unit vectors (then the order of cosines is that of distances) and are turned by
one random rotation, so that any leading coordinates are a random sample of a distance. The
index deals every vector to the list of its nearest centre and stores a list in blocks, each
block as columns of coordinates. A query visits its nearest lists. In a block, distances grow
by one block of columns after the other; after d of D coordinates a candidate with partial sum
s is abandoned if s * D / d exceeds t * (1 + e / sqrt(d))**2, where t is the squared distance
to beat: by then the hypothesis that it lies within t is refuted. What is left at the end is
scored exactly, in doubles, on the original vectors. A first pass reads the nearest list of
each query alone; the score of its k-th best is what the other lists have to beat.

How many lists are visited is measured, not set: the true neighbours of at most 128 queries
are found by comparing these with all vectors, and as many lists are visited as hold
`FOUND` of them. Centres are fitted on at most SAMPLE vectors (a bound by hash of the vector);
all vectors are in the index.

Equal vectors are one entry that carries its smallest ids: more than k of them can never be
among the k nearest. So a vector that a third of all rows share is compared once, and searched
once. Lists longer than a block are cut into blocks by hash, the queries of a list likewise.

Defined results: ids are whole numbers; see `vectors` for rows that take part; a zero vector
has no cosine and takes no part; equal rows (id and vector) count once; rows with the id of a query are its own, and no
candidates; ties go to the smaller id, a null id is largest; a null id is no query; with fewer
candidates than k there are fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetide.llm.common import table, written
from pagetide.llm.vectors import matrix, usable

LIST_ROWS = 1024  # vectors of a list, on average
MOST_LISTS = 4096  # centres are sent to every task: that many vectors at most
SAMPLE = 32_768  # vectors that centres are fitted on
BLOCK_ROWS = 1024
BLOCK_QUERIES = 1024
COLUMNS = 16  # of a block of columns: the test is done behind each
ERROR = 2.1  # e of the test: the chance of a wrong rejection falls with exp(-c * e * e)
FOUND = 0.96
MEASURED = 128
_NONE = np.iinfo(np.int64).max  # stands for a null id, behind all others


def rotation(width: int, seed: int = 7) -> np.ndarray:
    turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return turned


def units(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # squares of very small or large ones stay finite
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    scale = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    plain = (a * b).sum(axis=1) / scale
    odd = ~np.isfinite(plain) | (scale < 1e-290)
    if odd.any():  # sums of squares left the doubles
        plain[odd] = (units(a[odd]) * units(b[odd])).sum(axis=1)
    return plain


def spherical_means(units_: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample, as unit vectors."""
    random = np.random.default_rng(11)
    centres = units_[random.choice(len(units_), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_lists(units_, centres, 1)[:, 0]
        sums = np.zeros(centres.shape)
        np.add.at(sums, own, units_)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres).astype(np.float32)
    return centres


def nearest_lists(units_: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The lists of the nearest centres, nearest first."""
    found = np.empty((len(units_), min(probes, len(centres))), dtype=np.int64)
    for start in range(0, len(units_), 2048):
        near = -(units_[start : start + 2048].astype(np.float32) @ centres.T)
        if found.shape[1] == 1:
            found[start : start + 2048, 0] = near.argmin(axis=1)
        else:
            found[start : start + 2048] = np.argsort(near, axis=1, kind="stable")[:, : found.shape[1]]
    return found


@dataclass(frozen=True)
class Index:
    """Vectors in lists of blocks; `members` is how many ids an entry carries."""

    blocks: DataFrame  # list, block, raw, columns, ids, ends
    sizes: DataFrame  # list, n_blocks
    centres: np.ndarray
    turn: np.ndarray
    dtype: str
    members: int

    @property
    def width(self) -> int:
        return len(self.turn)


def entries(rows: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame, int, str, int]:
    """Distinct vectors with their smallest ids, queries with the key of their vector, and sizes.

    Rows (id, vector) become bytes first; a group is pruned to its smallest ids before any
    shuffle, so equal vectors in any number never meet in a task.
    """
    vectors, width = usable(rows)
    vectors = vectors.filter(F.exists("vector", lambda x: x != 0))
    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.ascontiguousarray(matrix(batch.column(2), width).astype(dtype))
            cells = pa.array([x.tobytes() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["id", "query", "raw"])

    numbered = vectors.select(F.col("id").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), "vector")
    packed = written(numbered.mapInArrow(pack, "id long, query boolean, raw binary"), "packed")
    key = F.unhex(F.md5("raw"))
    # An id may stand before several vectors; none of them is a candidate of its queries.
    most = packed.groupBy("id").agg(F.count_distinct("raw").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    members = k + most
    order = Window.partitionBy("raw").orderBy(F.col("id").asc_nulls_last())
    # partial limits of the ranking drop all but these rows before the shuffle
    few = packed.select("raw", "id").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= members)
    distinct = (
        few.groupBy("raw")
        .agg(F.array_sort(F.collect_set(F.coalesce("id", F.lit(int(_NONE))))).alias("ids"))
        .select(key.alias("key"), "raw", "ids")
    )
    queries = packed.filter("query AND id IS NOT NULL").select("id", key.alias("key"), "raw").distinct()
    return written(distinct, "entries"), queries, width, dtype, members


def build(distinct: DataFrame, width: int, dtype: str, members: int, lists: int | None = None, rows: int = BLOCK_ROWS) -> Index | None:
    """The index over all entries; None over none."""
    n = distinct.count()
    if not n:
        return None
    turn = rotation(width)
    share = min(1.0, SAMPLE / n) * 0.9  # by hash, so a little less than the bound
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) if n > SAMPLE else 1 << 30)
    sample = distinct.filter(drawn).select("raw").limit(SAMPLE).collect()  # bounded: SAMPLE vectors
    seen = np.frombuffer(b"".join(r.raw for r in sample), dtype).reshape(-1, width)
    seen = (units(seen) @ turn).astype(np.float32)
    count = lists or round(n / LIST_ROWS)
    centres = spherical_means(seen, max(1, min(count, MOST_LISTS, len(seen))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype).reshape(-1, width)
                own = nearest_lists((units(raw) @ turn).astype(np.float32), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["key", "raw", "ids", "list"])

    dealt = written(distinct.select("key", "raw", "ids").mapInArrow(deal, "key binary, raw binary, ids array<long>, list long"), "dealt")
    sizes = written(
        dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows).alias("n_blocks")), "sizes"
    )  # a row for each list, MOST_LISTS at most
    block = F.pmod(F.xxhash64("key"), F.col("n_blocks"))
    keyed = dealt.join(F.broadcast(sizes), "list").select("list", block.alias("block"), "key", "raw", "ids")

    def store(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        raw = np.frombuffer(b"".join(group["raw"].to_pylist()), dtype).reshape(-1, width)
        turned = (units(raw) @ turn).astype(np.float32)
        columns = [turned[:, c : c + COLUMNS].tobytes() for c in range(0, width, COLUMNS)]
        ids = group["ids"].to_pylist()
        return pa.table(
            {
                "list": group["list"][:1],
                "block": group["block"][:1],
                "raw": pa.array([raw.tobytes()], pa.binary()),
                "columns": pa.array([columns], pa.list_(pa.binary())),
                "ids": pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())),
                "ends": pa.array([np.cumsum([len(x) for x in ids]).tolist()], pa.list_(pa.int64())),
            }
        )

    stored = keyed.groupBy("list", "block").applyInArrow(
        store, "list long, block long, raw binary, columns array<binary>, ids array<long>, ends array<long>"
    )
    return Index(written(stored, "blocks"), sizes, centres, turn, dtype, members)


def scan(queries: list[np.ndarray], columns: list[np.ndarray], limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the dimension scan does not abandon.

    `limits` are squared distances to beat. The exact distances of some candidates with small first
    partial sums lower them, those of the candidates that come to the end once more.
    """
    widths = [c.shape[1] for c in columns]
    whole = sum(widths)
    first_q, first_c = queries[0], columns[0]
    partial = (first_q * first_q).sum(axis=1)[:, None] - 2 * first_q @ first_c.T + (first_c * first_c).sum(axis=1)
    limits = limits.copy()
    if partial.shape[1] >= k:
        some = min(8 * k, partial.shape[1])
        lead = np.argpartition(partial, some - 1, axis=1)[:, :some]
        exact = np.zeros(lead.shape)
        for q, c in zip(queries, columns, strict=True):
            gap = q[:, None, :] - c[lead]
            exact += (gap * gap).sum(axis=2)
        limits = np.minimum(limits, np.partition(exact, k - 1, axis=1)[:, k - 1])
    slack = 1e-5  # single precision must not decide
    seen = widths[0]

    def bar(rows: np.ndarray) -> np.ndarray:
        loose = 1.0 if seen == whole else (1 + ERROR / np.sqrt(seen)) ** 2
        return limits[rows] * loose * seen / whole + slack

    at, candidate = np.nonzero(partial <= bar(np.arange(len(first_q)))[:, None])
    sums = partial[at, candidate]
    for q, c in zip(queries[1:], columns[1:], strict=True):
        gap = q[at] - c[candidate]
        sums = sums + (gap * gap).sum(axis=1)
        seen += c.shape[1]
        alive = sums <= bar(at)
        at, candidate, sums = at[alive], candidate[alive], sums[alive]
    order = np.lexsort((sums, at))
    at, candidate, sums = at[order], candidate[order], sums[order]
    kth = np.searchsorted(at, at) + k - 1  # of the same query, if there are so many
    there = (kth < len(at)) & (at[np.minimum(kth, len(at) - 1)] == at)
    near = ~there | (sums <= np.where(there, sums[np.minimum(kth, len(at) - 1)], 0) + slack)
    return at[near], candidate[near]


def _best(keys: list[bytes], own_raw: np.ndarray, limits: np.ndarray, block: dict, index_width: int, turn: np.ndarray, dtype: str, k: int):
    """(key, ids, scores) of the k best rows of a block for each query."""
    raw = np.frombuffer(block["raw"], dtype).reshape(-1, index_width)
    columns = [np.frombuffer(x, np.float32).reshape(len(raw), -1) for x in block["columns"]]
    ids, ends = np.array(block["ids"], dtype=np.int64), np.array([0, *block["ends"]])
    for start in range(0, len(keys), 256):
        mine = own_raw[start : start + 256]
        turned = (units(mine) @ turn).astype(np.float32)
        cuts = [turned[:, c : c + COLUMNS] for c in range(0, index_width, COLUMNS)]
        at, candidate = scan(cuts, columns, limits[start : start + 256], k)
        scores = cosines(mine[at], raw[candidate])
        counts = ends[candidate + 1] - ends[candidate]  # an entry stands for each of its ids
        spots = np.repeat(ends[candidate], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rows, found, values = np.repeat(at, counts), ids[spots], np.repeat(scores, counts)
        order = np.lexsort((found, -values, rows))
        rows, found, values = rows[order], found[order], values[order]
        begins = np.searchsorted(rows, np.arange(len(mine) + 1))
        for i in range(len(mine)):
            a, b = begins[i], min(begins[i + 1], begins[i] + k)
            if b > a:
                yield keys[start + i], found[a:b], values[a:b]


def _visited(index: Index, probed: DataFrame, k: int) -> DataFrame:
    """The k best rows over the visited lists: (key, id, score) of (key, raw, least, list)."""
    per_list = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("chunks"))
    shape = written(index.sizes.join(per_list, "list"), "shape")  # a row for each list
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks"))
    asked = probed.join(F.broadcast(shape), "list").select(
        "list", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), "key", "raw", "least"
    )
    offered = index.blocks.join(F.broadcast(shape.select("list", "chunks")), "list").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    )
    width, turn, dtype = index.width, index.turn, index.dtype

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, rows, values = [], [], []
        if left.num_rows and right.num_rows:
            (block,) = right.select(["raw", "columns", "ids", "ends"]).to_pylist()
            own = np.frombuffer(b"".join(left["raw"].to_pylist()), dtype).reshape(-1, width)
            least = left["least"].to_numpy()
            limits = np.where(np.isnan(least), np.inf, 2 - 2 * least)
            for key, found, scores in _best(left["key"].to_pylist(), own, limits, block, width, turn, dtype, k):
                keys += [key] * len(found)
                rows.append(found)
                values.append(scores)
        return pa.table(
            {
                "key": pa.array(keys, pa.binary()),
                "id": pa.array(np.concatenate(rows) if rows else [], pa.int64()),
                "score": pa.array(np.concatenate(values) if values else [], pa.float64()),
            }
        )

    on = ["list", "block", "chunk"]
    met = asked.groupBy(*on).cogroup(offered.groupBy(*on)).applyInArrow(meet, "key binary, id long, score double")
    return top(met, k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each key; ranking drops the others before the shuffle already."""
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def exhaustive(index: Index, keys: list[bytes], raw: np.ndarray, k: int) -> DataFrame:
    """(key, id, score, list) of the k best rows by brute force; the queries go to every task."""
    width, dtype = index.width, index.dtype
    own = units(raw)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stored = np.frombuffer(row["raw"], dtype).reshape(-1, width)
                scores = own @ units(stored).T
                ends = np.array([0, *row["ends"]])
                near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out = [
                    (keys[q], row["ids"][spot], float(scores[q, c]), row["list"])
                    for q in range(len(keys))
                    for c in near[q]
                    for spot in range(ends[c], ends[c + 1])
                ]
                columns = list(zip(*out, strict=True))
                kinds = [pa.binary(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "id", "score", "list"]
                )

    found = index.blocks.select("list", "raw", "ids", "ends").mapInArrow(work, "key binary, id long, score double, list long")
    return top(found, k)


def probes_for(index: Index, queries: DataFrame, k: int, found: float = FOUND) -> int:
    """How many lists hold this share of the true neighbours of a bounded number of queries."""
    if len(index.centres) == 1:
        return 1
    sample = queries.select("key", "raw").distinct().orderBy("key").limit(MEASURED).collect()
    if not sample:
        return 1
    keys = [bytes(r.key) for r in sample]
    raw = np.frombuffer(b"".join(r.raw for r in sample), index.dtype).reshape(-1, index.width)
    # its own entry is among the best, in its own list, and is not asked for
    truth = exhaustive(index, keys, raw, index.members + 1).filter(F.col("score") < 1 - 1e-12).collect()
    if not truth:
        return 1
    order = nearest_lists((units(raw) @ index.turn).astype(np.float32), index.centres, len(index.centres))
    ranks = np.argsort(order, axis=1)
    spot = {key: i for i, key in enumerate(keys)}
    needed = [ranks[spot[bytes(r.key)], r.list] + 1 for r in truth]
    return int(np.ceil(np.quantile(needed, found)))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    lists: int | None = None,
    probes: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row where `is_query`.

    `is_query` is an expression of the column `id`. Without `probes` their number is measured.
    """
    narrow = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    empty = "query_id long, rank int, id long, score double"
    distinct, queries, width, dtype, members = entries(narrow, is_query, k)
    index = build(distinct, width, dtype, members, lists, block_rows) if width else None
    if index is None:
        return rows.sparkSession.createDataFrame([], empty)
    asked = written(queries.select("key", "raw").distinct(), "asked")
    many = probes or probes_for(index, asked, k)
    centres, turn = index.centres, index.turn

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype).reshape(-1, width)
                near = nearest_lists((units(raw) @ turn).astype(np.float32), centres, many)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int64()))], ["key", "raw", "lists"]
                )

    aimed = written(asked.mapInArrow(aim, "key binary, raw binary, lists array<long>"), "aimed")
    first = aimed.select("key", "raw", F.lit(float("nan")).alias("least"), F.col("lists")[0].alias("list"))
    found = written(_visited(index, first, members), "found")
    if many > 1:
        # what the other lists have to beat; a query with fewer rows so far takes all it meets
        kth = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        bars = kth.filter(F.col("n") >= members).select("key", "least")
        rest = aimed.join(bars, "key", "left").select(
            "key",
            "raw",
            F.coalesce("least", F.lit(float("nan"))).alias("least"),
            F.explode(F.slice("lists", 2, many)).alias("list"),
        )
        found = top(found.unionByName(_visited(index, rest, members)), members)
    pair = F.struct((-F.col("score")).alias("minus"), "id")
    best = written(found.groupBy("key").agg(F.array_sort(F.collect_list(pair)).alias("best")), "best")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    ranked = queries.select("id", "key").distinct().join(best, "key").select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.nullif("x.id", F.lit(int(_NONE))).alias("id"),
        (-F.col("x.minus")).alias("score"),
    )


def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    found = search(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {"op11_nearest": op11_nearest}
ORACLES: dict[str, str] = {}
