"""Feed declarations: reading, validation as a violations table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.model import DECLARATION, LANGS, SOURCE_TYPES, TOPICS

# Form of a feed id, and length bounds.
SLUG_PATTERN = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
ID_LENGTHS = (2, 64)
NAME_LENGTHS = (1, 200)


def read_declarations(spark: SparkSession, path: str, *, format: str = "json") -> DataFrame:
    """Declared feeds of JSON lines or CSV files; an unknown field is kept as a violation."""
    if format == "csv":
        return spark.read.schema(DECLARATION).option("header", "true").csv(path)
    known = {field.name for field in DECLARATION}
    # Objects are read as maps too, so that misspelled fields are seen and not dropped.
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", DECLARATION).alias("d"),
        F.map_keys(F.from_json("value", "map<string,string>")).alias("keys"),
    )
    extra = F.filter("keys", lambda key: ~key.isin(*known))
    return parsed.select("d.*", F.coalesce(extra, F.array().cast("array<string>")).alias("extra_fields"))


def _outside(column: str, bounds: tuple[int, int]) -> Column:
    return F.coalesce(~F.length(column).between(*bounds), F.lit(True))


def declaration_violations(declarations: DataFrame) -> DataFrame:
    """Every broken rule as (id, rule), instead of stopping at the first one."""

    def not_in(column: str, allowed: tuple[str, ...]) -> Column:
        return F.coalesce(~F.col(column).isin(*allowed), F.lit(True))

    tests = {
        "id_pattern": F.coalesce(~F.col("id").rlike(SLUG_PATTERN), F.lit(True)),
        "id_length": _outside("id", ID_LENGTHS),
        "name_length": _outside("name", NAME_LENGTHS),
        "url_scheme": F.coalesce(~F.col("url").rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(True)),
        "lang": not_in("lang", LANGS),
        "topic": not_in("topic", TOPICS),
        "source_type": not_in("source_type", SOURCE_TYPES),
    }
    if "extra_fields" in declarations.columns:
        tests["extra_fields"] = F.size("extra_fields") > 0
    broken = F.filter(
        F.array(*(F.when(test, F.lit(rule)) for rule, test in tests.items())), lambda rule: rule.isNotNull()
    )
    own = declarations.select("id", F.explode(broken).alias("rule"))
    repeated = [
        declarations.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("__id"))
        .filter("n > 1")
        .select(F.col("__id").alias("id"), F.lit(f"duplicate_{column}").alias("rule"))
        for column in ("id", "url")
    ]
    empty = declarations.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    none_declared = empty.select(F.lit(None).cast("string").alias("id"), F.lit("no_feed").alias("rule"))
    return own.unionByName(repeated[0]).unionByName(repeated[1]).unionByName(none_declared)
