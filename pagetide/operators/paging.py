"""The row at a position of a large ordered table, found by counting.

`LIMIT` with an offset sends offset + size rows to one task. Here the position is narrowed down
by counts: approximate quantiles cut the range of the order column, one count per slice tells
which slice holds the position, and only that slice is cut again, until few rows are left. Each
step is two aggregations that combine before the shuffle and send some hundred numbers to the
driver; no row moves, and from the second step on the scan reads one slice. The page is then
the top of what follows that row, at any depth.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTS = 128
# Values of a slice that is small enough to be listed.
FEW = 1000
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class NewestFirst:
    """An order column, largest first, NULL last; a rank is a whole number that rises in that order."""

    name: str
    kind: T.DataType

    @property
    def _times(self) -> bool:
        return isinstance(self.kind, T.TimestampType)

    def rank(self) -> Column:
        number = F.unix_micros(self.name) if self._times else F.col(self.name).cast("long")
        return F.coalesce(-number, F.lit(_LAST))

    def _value(self, rank: int) -> Column:
        return F.timestamp_micros(F.lit(-rank)) if self._times else F.lit(-rank).cast(self.kind)

    def within(self, low: int, high: int) -> Column:
        """Is the rank between these two? Said of the column itself, so that scans can use it."""
        column = F.col(self.name)
        if low == _LAST:
            return column.isNull()
        if high == _LAST:
            return column.isNull() | (column <= self._value(low))
        return column.between(self._value(high), self._value(low))


def newest_first(rows: DataFrame, *names: str) -> list[NewestFirst]:
    """Order columns, structs as their fields in turn; times and whole numbers can be counted."""
    found = []
    for name in names:
        kind = rows.select(name).schema[0].dataType
        if isinstance(kind, T.StructType):
            found += newest_first(rows, *(f"{name}.{field.name}" for field in kind))
        elif isinstance(kind, (T.TimestampType, T.IntegralType)):
            found.append(NewestFirst(name, kind))
        else:
            raise TypeError(f"{name}: listings are ordered by times and whole numbers, not {kind.simpleString()}")
    return found


def _slices(ranks: DataFrame) -> list[tuple[int, int]]:
    """(last rank, rows) of slices with about as many rows each, in order; one aggregation each way."""
    shares = F.array(*(F.lit((i + 1) / CUTS) for i in range(CUTS)))
    cuts = sorted(set(ranks.agg(F.percentile_approx("rank", shares, 10_000)).first()[0] or []))
    if not cuts:
        return []
    # the count of cuts that lie below a rank is the number of its slice
    slice_of = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda cut: cut < F.col("rank")))
    counted = ranks.groupBy(slice_of.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    return sorted((row["last"], row["n"]) for row in counted.collect())  # CUTS + 1 rows at most


def _rank_at(ranks: DataFrame, position: int) -> tuple[int, int, int] | None:
    """The rank at a position from 0, the rows before that rank, and the rows that have it."""
    low, before = -_LAST, 0
    while True:
        slices = _slices(ranks)
        through = list(accumulate(n for _, n in slices))
        if not slices or position - before >= through[-1]:
            return None
        at = bisect_left(through, position - before + 1)
        last, n = slices[at]
        low = slices[at - 1][0] + 1 if at else low
        before += through[at] - n
        if low == last:
            return last, before, n
        ranks = ranks.filter(F.col("rank").between(low, last))
        if n <= FEW:
            listed = sorted(tuple(row) for row in ranks.groupBy("rank").count().collect())
            for rank, count in listed:
                if position < before + count:
                    return rank, before, count
                before += count
        if len(slices) == 1:  # all cuts fell on the last rank: that one apart from those before it
            ends = ranks.agg(F.count_if(F.col("rank") == last).alias("n"), F.max(F.when(F.col("rank") < last, F.col("rank"))).alias("below")).first()
            if position >= before + n - ends["n"]:
                return last, before + n - ends["n"], ends["n"]
            ranks = ranks.filter(F.col("rank") <= ends["below"])


def from_position(rows: DataFrame, order: Sequence[NewestFirst], position: int) -> tuple[DataFrame, int]:
    """The rows from a position on, and how many of them still lie before it.

    That number is 0 if the order columns tell all rows apart.
    """
    ranks: list[int] = []
    inside, skipped = rows, 0
    for column in order:
        found = _rank_at(inside.select(column.rank().alias("rank")), position - skipped)
        if found is None:
            return rows.limit(0), 0
        rank, before, same = found
        ranks.append(rank)
        skipped += before
        inside = inside.filter(column.within(rank, rank))
        if same == 1:
            break
    last = len(ranks) - 1
    wanted = order[last].within(ranks[last], _LAST)
    for column, rank in zip(reversed(order[:last]), reversed(ranks[:last]), strict=True):
        same = column.within(rank, rank) & wanted
        wanted = same if rank == _LAST else same | column.within(rank + 1, _LAST)
    return rows.filter(wanted), position - skipped
