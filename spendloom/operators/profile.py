"""Profiles and rankings of spend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions.numbers import to_number
from spendloom.operators.attributes import distinct_values
from spendloom.operators.prefix import RANGES, counted_values, quantile_columns, running_totals


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, missing) for every column, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing")


def describe_column(df: DataFrame, column: str, *, ranges: int = RANGES) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, exact quartiles, maximum.

    The column is read once and its values counted; everything comes from the counts. Squares are of
    distances from the minimum, so close values lose no digits. Missing values and texts that are no
    number count for nothing; without values the count is 0 and the rest is NULL.
    """
    counts = counted_values(df.select(to_number(F.col(column), None).alias("_v")), "_v")
    least = counts.agg(F.min("_v")).scalar()
    placed = running_totals(counts, [], "_v", "_n", ranges=ranges).withColumn("_d", F.col("_v") - least)
    found = placed.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("count"),
        F.sum(F.col("_d") * F.col("_n")).alias("_s"),
        F.sum(F.col("_d") * F.col("_d") * F.col("_n")).alias("_q"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        *quantile_columns({"p25": 0.25, "p50": 0.5, "p75": 0.75}),
    )
    spread = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.nullif("count", F.lit(0)), F.lit(0.0))
    return found.select(
        "count",
        (F.col("min") + F.col("_s") / F.nullif("count", F.lit(0))).alias("mean"),
        F.when(F.col("count") > 1, F.sqrt(spread / (F.col("count") - 1))).alias("std"),
        *("min", "p25", "p50", "p75", "max"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50, *, fill: float | None = 0.0) -> DataFrame:
    """Counts in equal bins between minimum and maximum, empty bins included.

    Values that are no number count as `fill`, or are left out when it is None; without values there are
    no rows. The edges are found inside the plan, so nothing runs while it is built.
    """
    numbers = df.select(to_number(F.col(column), fill).alias("_v")).dropna()
    least, most = F.min("_v"), F.max("_v")
    # one value alone stands in the middle
    half = F.when(least == most, 0.5).otherwise(0.0)
    low, width = (least - half).alias("low"), ((most - least + 2 * half) / bins).alias("width")
    edges = numbers.agg(F.struct(low, width).alias("edges")).scalar()
    position = F.floor((F.col("_v") - edges["low"]) / edges["width"]).cast("int")
    counts = numbers.withColumn("bin", F.least(position, F.lit(bins - 1))).groupBy("bin").agg(F.count("*").alias("_n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), edges.alias("edges"))
    return every.filter(F.col("edges.low").isNotNull()).join(counts, "bin", "left").select(
        "bin",
        (F.col("edges.low") + F.col("bin") * F.col("edges.width")).alias("low"),
        (F.col("edges.low") + (F.col("bin") + 1) * F.col("edges.width")).alias("high"),
        F.coalesce("_n", F.lit(0)).alias("rows"),
    )


def _spend(df: DataFrame, spend_col: str) -> Column:
    """The spend column; what is missing or is no number counts as 0."""
    is_text = df.schema[spend_col].dataType.typeName() == "string"
    return to_number(F.col(spend_col)) if is_text else F.coalesce(F.col(spend_col), F.lit(0))


def top_groups(df: DataFrame, group_col: str, spend_col: str, n: int | None = 15) -> DataFrame:
    """Spend per group, largest first; the first `n` groups or all."""
    ranked = (
        df.dropna(subset=[group_col])
        .groupBy(group_col)
        .agg(F.sum(_spend(df, spend_col)).alias(spend_col))
        .orderBy(F.desc(spend_col), group_col)
    )
    return ranked if n is None else ranked.limit(n)


def top_rows(df: DataFrame, spend_col: str, tie_cols: Sequence[str], n: int = 15) -> DataFrame:
    """The `n` rows with the largest spend."""
    return df.withColumn(spend_col, _spend(df, spend_col)).orderBy(F.desc(spend_col), *tie_cols).limit(n)


def class_counts(df: DataFrame, class_col: str) -> DataFrame:
    """Rows per class, most frequent first."""
    return df.groupBy(class_col).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), class_col)


def spend_trend(df: DataFrame, keys: Sequence[str], year: Column, spend_col: str) -> DataFrame:
    """Spend per key and year."""
    return df.groupBy(*keys, year.alias("year")).agg(F.sum(spend_col).alias(spend_col))


def spend_matrix(
    df: DataFrame, row_col: str, column_col: str, spend_col: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Spend by class (rows) and country (columns), 0 where there is none."""
    wanted = distinct_values(df, column_col) if columns is None else list(columns)
    return (
        df.dropna(subset=[row_col])
        .groupBy(row_col)
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col(column_col) == v, F.col(spend_col))), F.lit(0)).alias(v)
                for v in wanted
            ]
        )
    )
