"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Items and documents are normalised alike: A-Z in lower case, everything that is neither a
digit, a-z nor outside ASCII is a separator. The automaton reads word numbers, so one pass
over a document, from run to run of words that items have, finds every window; byte offsets stay those of the original, because
normalising replaces bytes one by one.

An automaton holds about `SLICE_WORDS` words of items, as it is sent to every task. Items are dealt
to as many slices as that takes (a longer one in pieces that share a window's length), and each
slice is one automaton and one pass over the documents; hits of a document are put together at
the end. The usual benchmark is one slice.

Defined results: null and word-less texts have no words and no hits; null or word-less items
have no window; items without id mark words but are not listed; items that repeat an id are
one item; repeated documents are rows of their own; an empty benchmark hits nothing; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import as_bytes, table, written

WINDOW = 10
SLICE_WORDS = 100_000

_NORMAL = bytes(
    c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Windows:
    """The automaton of one slice; values are (length, items that have the window)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            row = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for k in range(max(1, len(row) - window + 1)) if row else ():
                found.setdefault(row[k : k + window], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for row, names in found.items():
            self.automaton.add_word(row, (len(row), frozenset(n for n in names if n is not None)))
        if found:
            self.automaton.make_automaton()
        # a window lies within a run of words that items have
        least = min(map(len, found), default=1)
        self.runs = re.compile(b"\x01{%d,}" % least) if found else None

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of words (end exclusive, joined where they touch) inside windows, and the items."""
        ranges, items = [], set()
        known = bytes(map(self.numbers.__contains__, words)) if self.runs else b""
        for run in self.runs.finditer(known) if known else ():
            offset = run.start()
            part = tuple(map(self.numbers.__getitem__, words[offset : run.end()]))
            for end, (length, names) in self.automaton.iter(part):
                items |= names
                start, end = offset + end - length + 1, offset + end + 1
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, end))
        return ranges, items


Slice = list[tuple[str | None, bytes]]


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item, text, n) of the items that have words, cut where one has more than `most` of them."""
    step = max(1, most - window + 1)

    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                for k in range(0, max(1, len(words) - window + 1), step) if words else ():
                    part = words[k : k + step + window - 1]
                    rows.append((item, b" ".join(part), len(part)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "text", "n"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(
        cut, "item string, text binary, n long"
    )


def slices(benchmark: DataFrame, window: int = WINDOW, most: int = SLICE_WORDS) -> Iterator[Slice]:
    """The items, in slices of about `most` words; the driver holds one of them at a time."""
    cut = written(_pieces(benchmark, window, most), "items")
    total = cut.agg(F.sum("n").alias("n")).first().n or 0
    count = -(-total // most)
    for k in range(count):
        own = cut.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(row.item, bytes(row.text)) for row in own.select("item", "text").collect()]


_PAIRS = "array<struct<first:int,last:int>>"
_HITS = f"struct<n_words:bigint,ranges:{_PAIRS},offsets:{_PAIRS},items:array<string>>"


def finder(spark: SparkSession, items: list[tuple[str | None, bytes]], window: int):
    """A column function: text -> words, ranges of words hit, their code points, items."""
    shared = spark.sparkContext.broadcast(items)
    pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    kind = pa.struct([("n_words", pa.int64()), ("ranges", pair), ("offsets", pair), ("items", pa.list_(pa.string()))])

    def offsets(text: bytes, ranges) -> list[dict]:
        spots = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_NORMAL))] if ranges else []
        at = [(spots[a][0], spots[b - 1][1]) for a, b in ranges]
        # code points before a byte: bytes that do not continue a character
        heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) if at else ()
        return [{"first": int(heads[a]) - 1, "last": int(heads[b - 1])} for a, b in at]

    @F.arrow_udf(_HITS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(shared.value, window)
        for column in texts:
            rows = []
            for text in as_bytes(column):
                words = words_of(text)
                ranges, names = windows.scan(words)
                rows.append(
                    {
                        "n_words": len(words),
                        "ranges": [{"first": a, "last": b} for a, b in ranges],
                        "offsets": offsets(text, ranges),
                        "items": sorted(names, key=lambda x: x.encode()),
                    }
                )
            yield pa.array(rows, kind)

    return find


def _found(docs: DataFrame, parts: Iterator[Slice], window: int) -> DataFrame:
    """(doc_id, found) for every row: hits of all slices, as an array."""
    spark = docs.sparkSession
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return docs.select("doc_id", F.array(finder(spark, first, window)("text")).alias("found"))
    # several passes need the rows told apart: they are numbered as they are written
    rows = written(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "documents")
    passes = None
    for items in chain([first, second], parts):
        hits = rows.select("row", finder(spark, items, window)("text").alias("f")).filter(F.size("f.ranges") > 0)
        kept = written(hits, "hits")
        passes = kept if passes is None else passes.unionAll(kept)
    nothing = finder(spark, [], window)("text")  # counts words
    counted = rows.select("row", "doc_id", nothing.alias("f"))
    grouped = passes.groupBy("row").agg(F.collect_list("f").alias("more"))  # a row of each slice at most
    joined = counted.join(grouped, "row", "left")
    return joined.select("doc_id", F.concat(F.array("f"), F.coalesce("more", F.array().cast(f"array<{_HITS}>"))).alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits) for every row.

    `hits` are the code points of the original text that lie inside windows, per slice.
    """
    rows = _found(docs, slices(benchmark, window, most), window)
    ranges = F.array_sort(F.flatten(F.transform("found", lambda f: f["ranges"])))
    # ranges of several slices may overlap: what lies behind the end so far is added
    seen = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate(
        ranges,
        seen,
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"], a["end"]))).alias("n"),
            F.greatest(a["end"], r["last"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["items"]))))
    return (
        rows.select(
            "doc_id",
            F.col("found")[0]["n_words"].alias("n_words"),
            n_hit.alias("n_hit"),
            items.alias("items"),
            F.flatten(F.transform("found", lambda f: f["offsets"])).alias("hits"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("items")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = SLICE_WORDS) -> DataFrame:
    """The documents without any word inside a window of the benchmark; a pass for each slice."""
    for k, items in enumerate(slices(benchmark, window, most)):
        docs = written(docs, "clean") if k else docs
        docs = docs.filter(F.size(finder(docs.sparkSession, items, window)("text")["ranges"]) == 0)
    return docs


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("hits")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT item_id, least(10, len(words)) AS n, unnest([words[k:k + least(10, len(words)) - 1]
    for k in range(1, greatest(len(words) - 9, 1) + 1)]) AS win
  FROM b WHERE len(words) > 0
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS k, words FROM w, lengths WHERE len(words) >= n
), h AS (
  SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.words[dw.k:dw.k + dw.n - 1] = bw.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
  FROM h GROUP BY doc_id
)
SELECT w.doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": SQL}
