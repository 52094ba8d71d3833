"""Mixing sources to target weights: weighted reservoir order, prefix sums, word budgets.

Every document draws an exponential key -ln(u) / quality (Efraimidis and Spirakis); within a
source, documents in the order of their keys are a weighted sample without replacement of any
length. A source first takes all its documents for each complete epoch of its target, then
the rest in the order of the keys; the document at the border gives the words still missing.

u comes from a digest of the id, so reruns agree. Quality is the share of letters in the
text, 0.05 at least.

Defined results: a null text has size 0 and takes nothing; a null source is a source, ranked
last; repeated rows are rows of their own, ordered among themselves by size only, so equal
rows share alike; sources of size 0 have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetide.llm.common import table, written

WEIGHTS = (3, 1, 2)
# Buckets are cut on the scale of the key's logarithm: there an exponential key looks alike whatever
# the quality, and no bucket holds much over a thousandth of a source.
BUCKETS = 512  # for each doubling of the key


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.coalesce(letters, F.lit(0.0)), F.lit(0.05))


def draw(id_column: Column) -> Column:
    """Uniform in (0, 1), from 52 bits of the id's digest; a null id draws as ''."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): 150 % shared by weight, 2x at most.

    Water filling in closed form: with sources in the order of size per weight, those before a
    point are full and the others share what is left by weight. Sums are whole numbers (`left3`
    counts half words), so only the last division rounds. One row per source: the windows
    without partition hold the list of sources, never their documents.
    """
    parts = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "w", F.element_at(parts, (F.col("rank") % len(weights)).cast("int") + 1).cast("long")
    )
    line = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("rank"))
    before = F.coalesce(F.sum("source_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left3", 3 * F.col("total") - 4 * before)
        .withColumn("open", F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.col("w") * F.col("left3") > 4 * F.col("source_size") * F.col("open"))
    )
    # the first source that is not full sets the level of all that follow it
    first = F.first(F.when(~F.col("full"), F.struct("left3", "open")), ignorenulls=True)
    level = level.withColumn(
        "level", first.over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    shared = (F.col("w") * F.col("level.left3")).cast("double") / (2 * F.col("level.open")).cast("double")
    return level.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.lit(2.0) * F.col("source_size")).otherwise(shared).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of (doc_id, source, text).

    No source is sorted as a whole: keys fall into buckets of their logarithm, bucket sums find the
    bucket at the border, and only its rows are ordered.
    """
    q = quality_of(F.col("text"))
    rows = written(
        docs.select(
            "doc_id",
            "source",
            size_of(F.col("text")).alias("size"),
            (-F.log(draw(F.col("doc_id"))) / q).alias("key"),
        ).withColumn("bucket", F.floor(F.log2("key") * buckets).cast("int")),
        "mix",
    )
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    wanted = (
        targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
        .withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5))
    )
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = (
        sums.withColumn("upto", F.sum("words").over(run))
        .join(wanted.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter("upto >= rest")
        .groupBy("s")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("border"))
    )
    plan = wanted.join(border, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "border"
    )
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    at = F.col("border.bucket")
    whole = joined.filter(F.col("bucket") != at).withColumn(
        "part", F.when(F.col("bucket") < at, F.col("size")).otherwise(F.lit(0))
    )
    order = Window.partitionBy("s").orderBy("key", "doc_id", "size")
    passed = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    split = joined.filter(F.col("bucket") == at).withColumn(
        "part",
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("border.before") - passed)),
    )
    return whole.unionByName(split).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


# Over the given documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(sha256(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(coalesce(length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0), 0.05)
      AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (
      ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left3,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s
), f AS (SELECT *, w * left3 > 4 * source_size * open AS full_ FROM l),
level AS (SELECT left3 AS a, open AS b FROM f WHERE NOT full_ ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN full_ THEN 2.0::DOUBLE * source_size
      ELSE (w * (SELECT a FROM level))::DOUBLE / (2 * (SELECT b FROM level))::DOUBLE END AS target
  FROM f
), e AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t
), r AS (
  SELECT *, floor(target - epochs * source_size + 0.5)::BIGINT AS rest FROM e
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - (sum(size) OVER (
    PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size))))::BIGINT
    AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": SQL}
