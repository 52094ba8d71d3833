"""Verified, incremental snapshots of a set of tables.

A table's rows are dealt to parts by their content, and every part has a fingerprint; the
digest over these stands for the table. A snapshot copies only parts whose fingerprint differs
from that of the snapshot before; for the others it names the folder where they are already,
and a table whose digest is unchanged is not looked at further. A snapshot is accepted, listed and
restored only if what was written reads back with the same row counts and fingerprints; a bad
one is refused before anything is replaced. Rotation removes old snapshots, and the parts that
no younger one names.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.files import children, finished, remove

# Fixed value: snapshots kept.
KEEP = 14

# Parts of a table: the unit that is copied, and the rows of a manifest per table.
PARTS = 64

_MANIFEST = "manifest"
_PART = "snapshot_part"
_RECORD = "table_name string, schema string, part long, n_rows long, fingerprint string, home string"
# Hexadecimal digits of a row's digest that enter the sum: 60 bits, exact in a long.
_DIGITS = 15


def _canonical(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        column = F.unix_micros(column)
    elif isinstance(field.dataType, T.TimestampNTZType):
        column = F.unix_micros(column.cast("timestamp"))
    elif isinstance(field.dataType, T.BinaryType):
        column = F.hex(column)
    return F.coalesce(column.cast("string"), F.lit("\x00"))


def row_digest(schema: T.StructType) -> Column:
    """60-bit digest of a row, by columns in name order."""
    fields = sorted(schema, key=lambda field: field.name)
    text = F.concat_ws("\x1f", *(_canonical(field) for field in fields))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("decimal(38,0)")


def fingerprint(table: DataFrame, name: str) -> DataFrame:
    """One row (table_name, n_rows, fingerprint); independent of row order and file layout."""
    digests = table.select(row_digest(table.schema).alias("digest"))
    return digests.agg(
        F.count(F.lit(1)).alias("n_rows"),
        # A sum sees duplicated or lost rows that an XOR would cancel.
        F.coalesce(F.sum("digest"), F.lit(0)).cast("string").alias("fingerprint"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "fingerprint")


def fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (fingerprint(t, name) for name, t in tables.items()))


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose fingerprints differ or that one side lacks."""
    left = expected.select("table_name", F.struct("n_rows", "fingerprint").alias("expected"))
    right = actual.select("table_name", F.struct("n_rows", "fingerprint").alias("actual"))
    both = left.join(right, "table_name", "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))


@dataclass(frozen=True)
class Part:
    """A part of a table: its content, and the snapshot in whose folder it lies."""

    part: int
    n_rows: int
    fingerprint: str
    home: str


@dataclass(frozen=True)
class Contents:
    """What a snapshot says of one table."""

    schema: T.StructType
    parts: tuple[Part, ...]

    @property
    def digest(self) -> str:
        """The top of the tree over the fingerprints of all parts."""
        leaves = [f"{p.part}:{p.n_rows}:{p.fingerprint}" for p in self.parts]
        return hashlib.sha256("\n".join(leaves).encode()).hexdigest()

    @property
    def n_rows(self) -> int:
        return sum(p.n_rows for p in self.parts)

    @property
    def fingerprint(self) -> str:
        return str(sum(int(p.fingerprint) for p in self.parts))


def _dealt(table: DataFrame) -> DataFrame:
    """The rows with their digest and their part: a changed row leaves all other parts alone."""
    return table.withColumn("__digest", row_digest(table.schema)).withColumn(
        _PART, F.pmod(F.col("__digest"), F.lit(PARTS)).cast("long")
    )


def _parts(table: DataFrame, home: str) -> tuple[Part, ...]:
    """Fingerprints of all parts; PARTS rows come to the driver."""
    found = _dealt(table).groupBy(_PART).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("__digest").cast("string").alias("fingerprint")
    )
    return tuple(sorted((Part(*row, home) for row in found.collect()), key=lambda p: p.part))


def _folder(root: str, name: str, part: Part) -> str:
    return f"{root}/snapshot={part.home}/{name}/{_PART}={part.part}"


def _rows(spark: SparkSession, root: str, name: str, contents: Contents) -> DataFrame:
    if not contents.parts:
        return spark.createDataFrame([], contents.schema)
    return spark.read.schema(contents.schema).parquet(*(_folder(root, name, p) for p in contents.parts))


def _load(spark: SparkSession, root: str, stamp: str) -> dict[str, Contents]:
    """The manifest of a snapshot: PARTS rows a table."""
    recorded = spark.read.schema(_RECORD).parquet(f"{root}/{_MANIFEST}/stamp={stamp}").collect()
    parts, schemas = defaultdict(list), {}
    for row in recorded:
        schemas[row["table_name"]] = T.StructType.fromJson(json.loads(row["schema"]))
        if row["part"] is not None:
            parts[row["table_name"]].append(Part(row["part"], row["n_rows"], row["fingerprint"], row["home"]))
    return {n: Contents(s, tuple(sorted(parts[n], key=lambda p: p.part))) for n, s in schemas.items()}


def stamps(spark: SparkSession, root: str) -> list[str]:
    """Names of the recorded snapshots, oldest first."""
    names = [name.partition("=")[2] for name in children(spark, f"{root}/{_MANIFEST}")]
    return [stamp for stamp in names if stamp and finished(spark, f"{root}/{_MANIFEST}/stamp={stamp}")]


def _copied(table: DataFrame, root: str, name: str, stamp: str, before: Contents | None) -> Contents:
    """Write the parts that the snapshot before does not have, and read them back."""
    spark = table.sparkSession
    now = Contents(table.schema, _parts(table, stamp))
    if before is not None and before.schema == now.schema and before.digest == now.digest:
        return before
    same = {(p.part, p.n_rows, p.fingerprint): p for p in before.parts} if before and before.schema == now.schema else {}
    parts = tuple(same.get((p.part, p.n_rows, p.fingerprint), p) for p in now.parts)
    fresh = tuple(p for p in parts if p.home == stamp)
    if fresh:
        moved = _dealt(table).drop("__digest").filter(F.col(_PART).isin(*(p.part for p in fresh)))
        # a part is as many files as tasks held rows of it: no part has to fit into one task
        moved.write.mode("overwrite").partitionBy(_PART).parquet(f"{root}/snapshot={stamp}/{name}")
        if _parts(_rows(spark, root, name, Contents(now.schema, fresh)), stamp) != fresh:
            raise ValueError(f"snapshot {stamp} does not read back as written")
    return Contents(now.schema, parts)


def take_snapshot(tables: dict[str, DataFrame], root: str, stamp: str) -> dict[str, Contents]:
    """Copy what changed since the newest snapshot below `root`, and record the new one.

    `stamp` is the UTC time of the snapshot, `yyyyMMdd-HHmmss`, so names sort by age.
    """
    spark = next(iter(tables.values())).sparkSession
    newest = [s for s in stamps(spark, root) if s < stamp][-1:]
    before = _load(spark, root, newest[0]) if newest else {}
    taken = {name: _copied(table, root, name, stamp, before.get(name)) for name, table in tables.items()}
    rows = [
        (name, contents.schema.json(), p.part, p.n_rows, p.fingerprint, p.home)
        for name, contents in taken.items()
        for p in contents.parts
    ]
    rows += [(name, c.schema.json(), None, 0, None, None) for name, c in taken.items() if not c.parts]
    spark.createDataFrame(rows, _RECORD).coalesce(1).write.mode("overwrite").parquet(f"{root}/{_MANIFEST}/stamp={stamp}")
    return taken


def list_snapshots(spark: SparkSession, root: str, keep: int = KEEP) -> DataFrame:
    """Recorded snapshots, newest first: rows, parts copied, and whether rotation would remove them."""
    rows = []
    for age, stamp in enumerate(reversed(stamps(spark, root))):  # KEEP and a few, after rotations
        tables = _load(spark, root, stamp).values()
        own = sum(p.home == stamp for c in tables for p in c.parts)
        rows.append((stamp, sum(c.n_rows for c in tables), own, age >= keep))
    return spark.createDataFrame(rows, "stamp string, n_rows long, n_copied long, expired boolean")


def rotate(spark: SparkSession, root: str, keep: int = KEEP) -> list[str]:
    """Remove all but the newest `keep` snapshots and the parts that none of these names.

    Manifests go first: a crash leaves parts that nothing names, which the next rotation removes.
    """
    known = stamps(spark, root)
    kept, expired = known[-keep:], known[:-keep]
    named = {
        _folder(root, name, part)
        for stamp in kept
        for name, contents in _load(spark, root, stamp).items()
        for part in contents.parts
    }
    for stamp in expired:
        remove(spark, f"{root}/{_MANIFEST}/stamp={stamp}")
    for home in (name for name in children(spark, root) if name.startswith("snapshot=")):
        if home.partition("=")[2] > known[-1]:
            continue  # being written
        for name in children(spark, f"{root}/{home}"):
            for part in children(spark, f"{root}/{home}/{name}"):
                path = f"{root}/{home}/{name}/{part}"
                if part.startswith(f"{_PART}=") and path not in named:
                    remove(spark, path)
    return expired


def restore(spark: SparkSession, root: str, stamp: str) -> dict[str, DataFrame]:
    """Tables of a snapshot, after the content of every part was checked against the manifest."""
    tables = {}
    for name, contents in _load(spark, root, stamp).items():
        there = {
            f"{root}/snapshot={home}/{name}/{folder}"
            for home in {p.home for p in contents.parts}
            for folder in children(spark, f"{root}/snapshot={home}/{name}")
        }
        sound = all(_folder(root, name, p) in there for p in contents.parts)
        if sound:
            tables[name] = _rows(spark, root, name, contents)
            found = [(p.part, p.n_rows, p.fingerprint) for p in _parts(tables[name], "")]
            sound = found == [(p.part, p.n_rows, p.fingerprint) for p in contents.parts]
        if not sound:
            raise ValueError(f"snapshot {stamp} is damaged: restore refused")
    return tables
