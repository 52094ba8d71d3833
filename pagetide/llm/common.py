"""What the operators of this folder share: reading tables, working tables, batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and go on from there.

    A lost executor then costs a read of files, not a repetition of everything before.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_of(df: DataFrame) -> int:
    """Tasks that a scan of these rows takes: the measure of the input that needs no job."""
    return max(1, df.rdd.getNumPartitions())


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `size` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(lengths, dtype=np.int64) // size
        starts = np.concatenate(([0], np.flatnonzero(np.diff(cut)) + 1, [batch.num_rows])).astype(int)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


MAP_BITS = 26


def bit_map(keys: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A bounded picture of a set of longs: one bit for each residue of a hash that occurs.

    The picture takes 2**bits / 8 bytes (8 MB), whatever the number of keys, so it may be sent
    to every task; a key of the set always finds its bit, others do with the share of set bits.
    Slices are built by the executors, the driver only puts them side by side.
    """
    block = 16
    index = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    slots = keys.select(index.alias("slot")).distinct()

    def fold(rows: pa.Table) -> pa.Table:
        found = rows["slot"].to_numpy()
        low = np.zeros(1 << block, dtype=np.uint8)
        low[found & ((1 << block) - 1)] = 1
        return pa.table({"part": [int(found[0] >> block)], "bytes": [np.packbits(low).tobytes()]})

    rows = (
        slots.groupBy(F.shiftright("slot", block).alias("part_key"))
        .applyInArrow(fold, "part long, bytes binary")
        .collect()
    )
    whole = np.zeros(1 << max(0, bits - 3), dtype=np.uint8)
    step = 1 << (block - 3)
    for row in rows:
        whole[row.part * step : (row.part + 1) * step] = np.frombuffer(row.bytes, dtype=np.uint8)
    return whole


def on_map(column: str, picture, bits: int = MAP_BITS):
    """Is the bit of this long set? `picture` is a broadcast `bit_map` of the same width."""

    @F.arrow_udf(T.BooleanType())
    def test(slot: pa.Array) -> pa.Array:
        slots = slot.to_numpy()
        return pa.array((picture.value[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool))

    return test(F.shiftrightunsigned(F.xxhash64(column), 64 - bits))


def without(docs: DataFrame, dropped: DataFrame, column: str = "doc_id", digest: Column | None = None) -> DataFrame:
    """The rows of `docs` that `dropped` does not name.

    `dropped` has (id), or (id, digest), where `digest` is what rows of `docs` are then held against
    as well: one id may stand before several texts. Rows off the bounded picture of the ids stay
    where they are; only the others, about as many as are dropped, are shuffled for the join
    that decides.
    """
    gone = written(dropped.toDF("__gone", *dropped.columns[1:]).filter("__gone is not null").distinct(), "dropped")
    hit = on_map(column, docs.sparkSession.sparkContext.broadcast(bit_map(gone, "__gone")))
    same = docs[column] == gone["__gone"]
    if digest is not None:
        same = same & (digest == gone["digest"])
    return docs.filter(~hit).unionAll(docs.filter(hit).join(gone, same, "left_anti"))


Query = Callable[[SparkSession, str], DataFrame]
