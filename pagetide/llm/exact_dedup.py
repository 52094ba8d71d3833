"""Exact duplicates: counting quotient filters per partition, then byte verification.

A filter splits a 64-bit fingerprint of the normalised text into a quotient (its leading
bits, the position) and a remainder, kept sorted within its quotient with a counter. Sorted
filters merge without loss: remainders of one quotient are merged and equal ones add their
counters. After the merge a counter above one means "possibly repeated": only those texts
travel, and they are compared as bytes.

Defined results: null is the empty text; empty texts equal each other; a repeated row (same
id, same text) counts in `group_size` and gets a row of its own; every row whose id is the
largest of its group is kept, so a repeated row is kept as often as it occurs; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import as_bytes, partitions_of, table, without, written

QUOTIENT_BITS = 26  # the merged filter's map of repeated quotients: 8 MB at any size


class QuotientFilter:
    """Sorted remainders with counters, found by quotient; here as two parallel arrays."""

    def __init__(self, prints: np.ndarray, counts: np.ndarray):
        self.prints, self.counts = prints, counts

    @classmethod
    def of(cls, prints: np.ndarray) -> QuotientFilter:
        return cls(*np.unique(prints, return_counts=True))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Merge of sorted runs; counters of one fingerprint add up."""
        prints = np.concatenate([f.prints for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        return cls(prints[first], np.add.reduceat(counts, first))

    def runs(self, block_bits: int):
        """(block, remainders, counters) for each range of quotients that is not empty."""
        shift = np.uint64(64 - block_bits)
        blocks = self.prints >> shift
        first = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        for a, b in zip(first, [*first[1:], len(blocks)], strict=True):
            yield int(blocks[a]), self.prints[a:b] & ((np.uint64(1) << shift) - np.uint64(1)), self.counts[a:b]


def fingerprints(text: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """64-bit fingerprints and bytes of the texts, with A-Z in lower case."""
    normal = [x.lower() for x in as_bytes(text)]  # bytes.lower() changes A-Z alone
    return np.fromiter(map(xxhash.xxh3_64_intdigest, normal), np.uint64, len(normal)), normal


def _digests(docs: DataFrame) -> DataFrame:
    def digest(batches):
        for batch in batches:
            prints, normal = fingerprints(batch.column(1))
            shas = [hashlib.sha256(x).digest() for x in normal]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), pa.array(shas, pa.binary())],
                ["id", "fingerprint", "sha"],
            )

    return docs.mapInArrow(digest, f"id {docs.schema[0].dataType.simpleString()}, fingerprint long, sha binary")


def _repeated_quotients(digests: DataFrame, block_bits: int, quotient_bits: int) -> np.ndarray:
    """Which quotients of the merged filter hold a counter above one; 2**quotient_bits bits."""

    def build(batches):
        prints = [batch.column(0).to_numpy().view(np.uint64) for batch in batches]
        if prints:
            runs = list(QuotientFilter.of(np.concatenate(prints)).runs(block_bits))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in runs], pa.int64()),
                    pa.array([x[1].tobytes() for x in runs], pa.binary()),
                    pa.array([x[2].astype("<i8").tobytes() for x in runs], pa.binary()),
                ],
                ["block", "remainders", "counters"],
            )

    def merge(rows: pa.Table) -> pa.Table:
        whole = QuotientFilter.merged(
            [
                QuotientFilter(np.frombuffer(a, "<u8"), np.frombuffer(b, "<i8"))
                for a, b in zip(rows["remainders"].to_pylist(), rows["counters"].to_pylist(), strict=True)
            ]
        )
        block = rows["block"][0].as_py()
        kept = 64 - block_bits  # bits of a remainder within its block
        slots = whole.prints[whole.counts > 1] >> np.uint64(kept - (quotient_bits - block_bits))
        bits = np.zeros(1 << (quotient_bits - block_bits), dtype=np.uint8)
        bits[slots.astype(np.int64)] = 1
        found = bits.any()
        return pa.table(
            {
                "block": pa.array([block] if found else [], pa.int64()),
                "bits": pa.array([np.packbits(bits).tobytes()] if found else [], pa.binary()),
            }
        )

    filters = digests.select("fingerprint").mapInArrow(build, "block long, remainders binary, counters binary")
    slices = filters.groupBy("block").applyInArrow(merge, "block long, bits binary")
    whole = np.zeros(1 << (quotient_bits - 3), dtype=np.uint8)
    step = 1 << (quotient_bits - block_bits - 3)
    for row in slices.collect():  # at most 2**quotient_bits bits, whatever the input
        whole[row.block * step : (row.block + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return whole


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", quotient_bits: int = QUOTIENT_BITS
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    digests = written(_digests(narrow), "digests")
    block_bits = min(quotient_bits - 3, max(6, int(np.ceil(np.log2(partitions_of(narrow))))))
    repeated = narrow.sparkSession.sparkContext.broadcast(
        _repeated_quotients(digests, block_bits, quotient_bits)
    )

    def suspects(batches):
        for batch in batches:
            prints, normal = fingerprints(batch.column(1))
            slots = (prints >> np.uint64(64 - quotient_bits)).astype(np.int64)
            hit = np.flatnonzero(repeated.value[slots >> 3] >> (7 - (slots & 7)) & 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hit)), pa.array([normal[i] for i in hit], pa.binary())],
                ["id", "normal"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    groups = (
        narrow.mapInArrow(suspects, f"id {kind}, normal binary")
        .groupBy("normal")  # the bytes themselves are the key; copies of one task combine first
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("normal", 256)).alias("sha"), "keep_id", "group_size")
    )
    joined = digests.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keep_last(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of equal texts those with the largest id.

    Rows of texts that occur once pass; a join by id and text is needed only for rows to drop, so
    of an id with several texts those stay that are its own. Repeated rows stay all or none.
    """
    dropped = exact_groups(docs, id_column, text_column).filter(~F.col("kept"))
    normal = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER, LOWER)
    digests = dropped.select(F.col("id").alias("gone"), F.col("text_sha256").alias("digest"))
    return without(docs, digests, id_column, F.sha2(normal, 256))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": SQL}
