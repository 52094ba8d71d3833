"""Current state of a stream: buckets of rows by the hash of a key, one version a batch.

A version is a manifest: for each bucket the folder that holds its rows. A batch reads the
buckets of its own keys, writes these anew into a folder of its own, and then the manifest of
its version, which takes all other buckets over as they are. So a batch costs what its keys
touch, whatever the stream has seen before.

Version n is derived from version n - 1 and the batch alone. A replay overwrites the folder and
the manifest of its number, and a crash before the manifest leaves the version before valid.

A table whose rows can be merged when they are read may add a piece to a bucket instead of writing
it anew (`write(..., added=...)`); who writes it merges the pieces when there are `PIECES` of them.

Buckets stay small: when there are more than `rows` in one on average, their number doubles.
That moves nothing. A bucket that was written when there were fewer shares its folder with its
siblings until its own keys are next touched; who reads it keeps the rows of its own hash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.files import children, finished, remove

ROWS = 100_000
# Pieces of a bucket, at which it is written anew.
PIECES = 8
_NOWHERE = -1
_MANIFEST = "number long, batch long, depth int, n_rows long"


@dataclass(frozen=True)
class Bucket:
    """Rows whose hash ends in `number`; their folder was written by `batch` for `depth` bits.

    A bucket may have several pieces: entries of the same number and other batches.
    """

    number: int
    batch: int
    depth: int
    n_rows: int

    def folder(self, root: str) -> str:
        return f"{root}/rows/batch={self.batch}/bucket={self.number & ((1 << self.depth) - 1)}"


@dataclass(frozen=True)
class Version:
    """All buckets with their pieces, in the order of their numbers; there are 2**depth of them."""

    buckets: tuple[Bucket, ...]

    @property
    def depth(self) -> int:
        return self.buckets[-1].number.bit_length()

    @property
    def n_buckets(self) -> int:
        return 1 << self.depth

    def many(self, numbers: set[int]) -> set[int]:
        """Those of these buckets that have so many pieces that they should be merged."""
        pieces = Counter(b.number for b in self.buckets)
        return {n for n in numbers if pieces[n] >= PIECES}

    @property
    def n_rows(self) -> int:
        return sum(b.n_rows for b in self.buckets)

    def spread(self, n_rows: int, most: int) -> Version:
        """The same rows in as many buckets as `n_rows` need."""
        version = self
        while n_rows > most * version.n_buckets:
            halved = [replace(b, n_rows=(b.n_rows + 1) // 2) for b in version.buckets]
            upper = [replace(b, number=b.number + version.n_buckets) for b in halved]
            version = Version((*halved, *upper))
        return version


class BucketTable:
    """A table under `root`, of rows with these columns, found by `key` (one column or several)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: tuple[str, ...], rows: int = ROWS):
        self.spark, self.root, self.schema, self.key, self.rows = spark, root, schema, key, rows

    def number(self, version: Version) -> Column:
        """Number of the bucket that a row is in."""
        return F.xxhash64(*self.key).bitwiseAND(F.lit(version.n_buckets - 1))

    def version(self, batch: int) -> Version:
        """What stood after this batch; before the first there is one empty bucket."""
        if batch < 0:
            return Version((Bucket(0, _NOWHERE, 0, 0),))
        # one row a bucket: the state's own list of contents
        listed = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/batch={batch}").collect()
        return Version(tuple(sorted((Bucket(*row) for row in listed), key=lambda b: b.number)))

    def versions(self) -> list[int]:
        """Numbers of the batches whose manifest is complete."""
        folder = f"{self.root}/manifest"
        numbers = [int(name.partition("=")[2]) for name in children(self.spark, folder) if "=" in name]
        return sorted(n for n in numbers if finished(self.spark, f"{folder}/batch={n}"))

    def read(self, version: Version, numbers: set[int] | None = None) -> DataFrame:
        """Rows of these buckets, or of all."""
        wanted = [b for b in version.buckets if b.batch != _NOWHERE and (numbers is None or b.number in numbers)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        folders = sorted({b.folder(self.root) for b in wanted})
        if all(b.depth == version.depth for b in wanted):
            return self.spark.read.schema(self.schema).parquet(*folders)
        # a shared folder may hold rows of siblings that were written anew since
        placed = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        found = self.spark.read.schema(placed).option("basePath", f"{self.root}/rows").parquet(*folders)
        valid = self.spark.createDataFrame([(b.number, b.batch) for b in wanted], "number long, of long")
        there = (self.number(version) == F.col("number")) & (F.col("batch") == F.col("of"))
        return found.join(valid, there, "left_semi").select(*(field.name for field in self.schema))

    def touched(self, batch: int, keys: DataFrame) -> tuple[Version, set[int]]:
        """The version before `batch`, spread for the batch's keys, and the buckets they are in."""
        before = self.version(batch - 1)
        distinct = keys.select(*self.key).distinct()
        version = before.spread(before.n_rows + distinct.count(), self.rows)
        numbers = distinct.select(self.number(version).alias("number")).distinct().collect()
        return version, {row["number"] for row in numbers}

    def write(
        self, batch: int, version: Version, numbers: set[int], rows: DataFrame, added: set[int] = frozenset()
    ) -> None:
        """Make `rows` the whole content of these buckets, and the result the version of `batch`.

        To those `added`, rows are one more piece. Rows with a column `bucket` are placed by it already.
        """
        folder = f"{self.root}/rows/batch={batch}"
        names = [field.name for field in self.schema]
        if "bucket" in rows.columns:
            placed = rows.select(*names, "bucket")
        else:
            placed = rows.select(*names, self.number(version).alias("bucket")).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        counts = {}
        if numbers:
            written = self.spark.read.schema("bucket long").parquet(folder)
            counts = {row["bucket"]: row["count"] for row in written.groupBy("bucket").count().collect()}
        after = [b for b in version.buckets if b.number not in numbers or (b.number in added and b.batch != _NOWHERE)]
        after += [Bucket(n, batch, version.depth, counts[n]) for n in numbers if n in counts]
        there = {b.number for b in after}
        after += [Bucket(n, _NOWHERE, version.depth, 0) for n in range(version.n_buckets) if n not in there]
        listed = self.spark.createDataFrame([(b.number, b.batch, b.depth, b.n_rows) for b in after], _MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")

    def current(self) -> DataFrame:
        """All rows as of the last finished batch."""
        return self.read(self.version(max(self.versions(), default=-1)))

    def sweep(self, keep: int) -> None:
        """Forget the versions before batch `keep`, and remove the buckets that only they name."""
        numbers = self.versions()
        kept = [n for n in numbers if n >= keep]
        named = {b.folder(self.root) for n in kept for b in self.version(n).buckets}
        for n in numbers:
            if n < keep and kept:
                remove(self.spark, f"{self.root}/manifest/batch={n}")
        for n in (n for n in numbers if n < keep and kept):
            for name in children(self.spark, f"{self.root}/rows/batch={n}"):
                path = f"{self.root}/rows/batch={n}/{name}"
                if name.startswith("bucket=") and path not in named:
                    remove(self.spark, path)
