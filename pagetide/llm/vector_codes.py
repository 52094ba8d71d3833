"""Compression of vectors to codes of four bytes: product codebooks trained with adaptive bounds.

A vector of whole numbers is cut into parts; each part position has a codebook of 256 entries,
trained by rounds of assigning every part to its nearest entry and moving each entry to the
floored mean of its parts. After Drake and Hamerly, every part keeps the entries nearest to it,
all but its own, in the order of lower bounds on their distances, and one outer bound below the
distances of all the others. When entries move, bounds shrink by what the entries moved.
A part whose own entry, measured exactly, lies strictly below every bound keeps it; one that
lies below the outer bound is compared, in whole numbers, with the listed entries whose bounds
it reaches; only the rest is compared with all entries. How many entries are listed, b, adapts
to each part position: it shrinks to what all but a hundredth of the parts needed, and doubles
where over a tenth had to be compared with everything. Bounds decide only what need not be
looked at, and they are rounded down, so assignments are those of plain rounds.

The table of parts with their lists and bounds is written once a round, in place of that of two
rounds before; the driver sees sums per entry (256 x the vectors' length) and the counts that b follows.

Defined results: see `vectors` for rows that take part; a length that four does not divide is
refused; with fewer than 256 rows there are as many entries as rows; rows with a null id sort
behind all others, repeated ids by their vectors, so repeated rows are rows of their own; null
labels form one class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import table, written
from pagetide.llm.vectors import scaled, usable
from pagetide.session import shared_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
START = 16  # entries listed at first
LEAST, MOST = 8, 32
ROWS = 2048  # of a step in memory: that many x 256 distances


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, in whole numbers."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 1 << 53:  # products and sums exact in doubles
        a, b = x.astype(np.float64), book.astype(np.float64)
        found = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
        return found.astype(np.int64)
    if 4 * x.shape[1] * largest * largest >= 1 << 63:
        raise ValueError("components are too large for exact distances")
    return np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)


def _lowered(bound: np.ndarray) -> np.ndarray:
    """Bounds in half precision, rounded down: what they lose costs a comparison, never a result.

    No distance is below 0, so no bound has to be; infinity stands for "no entry".
    """
    short = np.clip(bound, 0.0, 65_000.0).astype(np.float16)
    return np.where(np.isinf(bound), np.float16(np.inf), np.nextafter(short, np.float16(-np.inf)))


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots rounded up."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf)


class Bounds:
    """Of rows at one part position: own entry, listed entries with lower bounds, outer bound."""

    def __init__(self, own: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.own, self.near, self.lower, self.outer = own, near, lower, outer

    @classmethod
    def measured(cls, x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        """Everything compared with everything."""
        found = distances(x, book)
        order = np.argsort(found, axis=1, kind="stable")[:, : b + 2]  # equal ones by index
        roots = _lowered(np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64)))
        listed = order[:, 1 : b + 1]
        near = np.zeros((len(x), b), dtype=np.uint8)
        lower = np.full((len(x), b), np.inf, dtype=np.float16)
        near[:, : listed.shape[1]] = listed
        lower[:, : listed.shape[1]] = roots[:, 1 : b + 1]
        outer = roots[:, b + 1] if order.shape[1] > b + 1 else np.full(len(x), np.inf, dtype=np.float16)
        return cls(order[:, 0].astype(np.uint8), near, lower, outer)

    def moved(self, by: np.ndarray, b: int) -> Bounds:
        """The bounds after entries moved by these distances, lists cut or filled up to b places."""
        lower = _lowered(self.lower.astype(np.float64) - by[self.near])
        outer = _lowered(self.outer.astype(np.float64) - by.max(initial=0.0))
        order = np.argsort(lower, axis=1, kind="stable")
        near, lower = np.take_along_axis(self.near, order, 1), np.take_along_axis(lower, order, 1)
        if b < lower.shape[1]:  # an entry that leaves the list is one of the others from now on
            outer = np.minimum(outer, lower[:, b])
            near, lower = near[:, :b], lower[:, :b]
        wide = b - lower.shape[1]
        near = np.pad(near, ((0, 0), (0, wide)))
        lower = np.pad(lower, ((0, 0), (0, wide)), constant_values=np.inf)
        return Bounds(self.own, near, lower, outer)

    def assign(self, x: np.ndarray, book: np.ndarray, needed: np.ndarray) -> Bounds:
        """Bounds whose own entries are the nearest now; counts in `needed` how deep lists were read.

        needed[i] counts the rows for which i listed entries were compared, the last the rows
        that were compared with all entries.
        """
        b = self.lower.shape[1]
        at = np.arange(len(x))
        own = ((x - book[self.own]) ** 2).sum(axis=1)
        reach = _root(own)
        everything = reach >= self.outer
        depth = (self.lower <= reach[:, None]).sum(axis=1)  # bounds rise, so these come first
        needed[:-1] += np.bincount(depth[~everything], minlength=b + 1)
        needed[-1] += everything.sum()
        new = Bounds(self.own.copy(), self.near.copy(), self.lower.copy(), self.outer.copy())

        rows = at[~everything & (depth > 0)]
        if len(rows):
            wide = int(depth[rows].max())
            listed = self.near[rows, :wide]
            squares = ((x[rows, None, :] - book[listed]) ** 2).sum(axis=2)
            asked = np.arange(wide) < depth[rows, None]
            far = np.iinfo(np.int64).max
            # the nearest, of equal ones the smallest index, its own entry among them
            all_squares = np.concatenate([np.where(asked, squares, far), own[rows, None]], axis=1)
            all_entries = np.concatenate([listed, self.own[rows, None]], axis=1).astype(np.int64)
            least = all_squares.min(axis=1)
            best = np.where(all_squares == least[:, None], all_entries, ENTRIES).min(axis=1)
            lower = self.lower[rows]
            lower[:, :wide] = np.where(asked, _lowered(np.sqrt(squares.astype(np.float64))), lower[:, :wide])
            near = self.near[rows]
            changed = np.flatnonzero(best != self.own[rows])
            place = (asked[changed] & (listed[changed] == best[changed, None])).argmax(axis=1)
            near[changed, place] = self.own[rows[changed]]  # the old own entry takes the place of the new
            lower[changed, place] = _lowered(np.sqrt(own[rows[changed]].astype(np.float64)))
            order = np.argsort(lower, axis=1, kind="stable")
            new.near[rows] = np.take_along_axis(near, order, 1)
            new.lower[rows] = np.take_along_axis(lower, order, 1)
            new.own[rows] = best
        rows = at[everything]
        if len(rows):
            fresh = Bounds.measured(x[rows], book, b)
            new.own[rows], new.near[rows], new.lower[rows], new.outer[rows] = fresh.own, fresh.near, fresh.lower, fresh.outer
        return new


def adapted(b: int, needed: np.ndarray) -> int:
    """The number of listed entries for the next round."""
    total = int(needed.sum())
    if not total:
        return b
    if needed[-1] * 10 > total:
        return min(MOST, 2 * b)
    inside = np.cumsum(needed[:-1])
    enough = int(np.searchsorted(inside, inside[-1] - total // 100)) if len(inside) else b
    return max(LEAST, min(b, enough))


_STATE = "x binary, own binary, near binary, lower binary, outer binary"


def _fields(batch: pa.RecordBatch, first: int, dtypes: list) -> list[np.ndarray]:
    """Binary columns of equal widths as matrices."""
    found = []
    for at, dtype in enumerate(dtypes):
        cells = batch.column(first + at).to_pylist()
        found.append(np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1))
    return found


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _step(
    rows: DataFrame,
    keys: list[str],
    width: int,
    dtype: str,
    books: list[np.ndarray],
    moves: list[np.ndarray] | None,
    b: list[int],
    before: list[int],
) -> DataFrame:
    """Rows with their state under these codebooks; without `moves` from the vectors themselves."""
    part = width // PARTS
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, _STATE, "error long", "needed array<long>"])
    first = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                if moves is None:
                    x = scaled(batch.column(first), width)
                else:
                    x, own, near, lower, outer = _fields(batch, first, [dtype, "u1", "u1", "<f2", "<f2"])
                    x = x.astype(np.int64)
                parts, counts, error, spots = [], [], np.zeros(len(x), dtype=np.int64), np.cumsum([0, *before])
                for p in range(PARTS):
                    own_x = x[:, p * part : (p + 1) * part]
                    needed = np.zeros(b[p] + 2, dtype=np.int64)
                    if moves is None:
                        state = Bounds.measured(own_x, books[p], b[p])  # tells nothing of b: no bounds yet
                    else:
                        cut = slice(spots[p], spots[p + 1])
                        old = Bounds(own[:, p], near[:, cut], lower[:, cut], outer[:, p])
                        state = old.moved(moves[p], b[p]).assign(own_x, books[p], needed)
                    error += ((own_x - books[p][state.own]) ** 2).sum(axis=1)
                    parts.append(state)
                    counts += needed.tolist()
                empty = [None] * (batch.num_rows - 1)  # counts of the step ride on its first row
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i) for i in range(first)),
                        _binary(x.astype(dtype)),
                        _binary(np.stack([s.own for s in parts], axis=1)),
                        _binary(np.concatenate([s.near for s in parts], axis=1)),
                        _binary(np.concatenate([s.lower for s in parts], axis=1)),
                        _binary(np.stack([s.outer for s in parts], axis=1)),
                        pa.array(error),
                        pa.array([counts, *empty], pa.list_(pa.int64())),
                    ],
                    [*keys, "x", "own", "near", "lower", "outer", "error", "needed"],
                )

    columns = [*keys, "vector"] if moves is None else [*keys, "x", "own", "near", "lower", "outer"]
    return rows.select(*columns).mapInArrow(work, schema)


def _updated(state: DataFrame, books: list[np.ndarray], dtype: str) -> list[np.ndarray]:
    """Entries moved to the floored means of their parts; sums are added up by Spark."""
    part = books[0].shape[1]
    count = len(books[0])

    def work(batches):
        sums = np.zeros((PARTS * count, part), dtype=np.int64)
        n = np.zeros(PARTS * count, dtype=np.int64)
        for batch in batches:
            x, own = _fields(batch, 0, [dtype, "u1"])
            for p in range(PARTS):
                slots = own[:, p].astype(np.int64) + p * count
                np.add.at(sums, slots, x[:, p * part : (p + 1) * part])
                n += np.bincount(slots, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                ["slot", "n", "sums"],
            )

    partial = state.select("x", "own").mapInArrow(work, "slot long, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(part)]
    new = [book.copy() for book in books]
    for row in partial.groupBy("slot").agg(F.sum("n").alias("n"), *totals).collect():  # a row for each entry
        p, entry = divmod(row.slot, count)
        new[p][entry] = [int(row[f"s{i}"]) // row.n for i in range(part)]
    return new


def _followed(state: DataFrame, b: list[int]) -> list[int]:
    """The next b of each part position, from the counts of the round."""
    counts = state.filter("needed IS NOT NULL").select(F.posexplode("needed").alias("at", "n"))
    found = np.zeros(sum(x + 2 for x in b), dtype=np.int64)
    for row in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # PARTS * (MOST + 2) rows at most
        found[row["at"]] = row["n"]
    cuts = np.cumsum([0, *(x + 2 for x in b)])
    return [adapted(x, found[cuts[p] : cuts[p + 1]]) for p, x in enumerate(b)]


def train(
    rows: DataFrame, keys: list[str], order: list[Column], width: int, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """The state of every row of (*keys, vector) under the codebooks after all rounds, and these.

    The state has the keys, `own` (a byte per part), `error`, and what the bounds need.
    """
    if width % PARTS:
        raise ValueError(f"vectors of length {width} cannot be cut into {PARTS} equal parts")
    whole = F.transform("vector", lambda c: F.floor(c.cast("double") * 1024).cast("long"))
    start = rows.orderBy(*order).limit(ENTRIES).select(whole.alias("x")).collect()
    seeds = np.array([row.x for row in start], dtype=np.int64)
    part = width // PARTS
    books = [seeds[:, p * part : (p + 1) * part].copy() for p in range(PARTS)]
    b = [START] * PARTS
    largest = rows.agg(F.max(F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double")))))).first()[0]
    dtype = "<i2" if largest < 31.0 else "<i4" if largest < 2.0**20 else "<i8"
    # a round reads the state of the round before, so two folders take turns
    folders = [shared_folder(rows.sparkSession, "llm/codes") for _ in range(2)]

    def stored(state: DataFrame, turn: int) -> DataFrame:
        state.write.mode("overwrite").parquet(folders[turn % 2])
        return rows.sparkSession.read.schema(state.schema).parquet(folders[turn % 2])

    state = stored(_step(rows, keys, width, dtype, books, None, b, b), 0)
    for turn in range(1, rounds + 1):
        new = _updated(state, books, dtype)
        moves = [_root(((x - y) ** 2).sum(axis=1)) for x, y in zip(new, books, strict=True)]
        before, b, books = b, _followed(state, b), new
        state = stored(_step(state, keys, width, dtype, books, moves, b, before), turn)
    return state, books


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components, by part, entry and position, as decimal numbers."""
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def encode(
    rows: DataFrame,
    rounds: int = ROUNDS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every row that takes part."""
    narrow = rows.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")
    )
    vectors, width = usable(narrow)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    if not width:
        empty = f"id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    state, books = train(vectors, ["id", "label"], order, width, rounds)
    # one row per label, written, so that the planner knows its size before it may broadcast it
    sums = written(state.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    joined = state.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(
        "id", F.lower(F.hex("own")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES: dict[str, str] = {}
