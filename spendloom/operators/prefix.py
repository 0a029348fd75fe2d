"""Running totals that stay balanced when one group holds most rows, and when its numbers are close or equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Block of a row: a whole number that never falls along the order.
BLOCK = "_block"

#: Blocks of all groups together. Each holds about this share of all rows, the largest some seven times as much.
RANGES = 1024

#: Each step of the search for a row's block leaves one of so many parts of the bounds.
_PARTS = 4


def order_key(group: Sequence[str], number: str, ties: Sequence[str], *, descending: bool = False) -> Column:
    """What orders rows, as one ascending value: group, number (NULL first, or last when descending), ties."""
    value = -F.col(number) if descending else F.col(number)
    missing = F.col(number).isNull() if descending else F.col(number).isNotNull()
    return F.struct(*group, missing.alias("_missing"), value.alias("_value"), *ties)


def range_bounds(df: DataFrame, key: Column, ranges: int = RANGES) -> Column:
    """Bounds that cut all rows into about `ranges` parts of equal size: a lazy scalar, at most `ranges` values.

    The bounds are the keys with the smallest hashes: a sample that depends on the rows alone, not on how
    they are dealt, so every branch of a plan and every retried task finds the same ones.
    """
    keys = df.select(key.alias("_key"))
    sample = keys.orderBy(F.xxhash64("_key"), "_key").limit(ranges)
    return sample.agg(F.sort_array(F.collect_set("_key")).alias("_bounds")).scalar()


def with_blocks(df: DataFrame, key: Column, ranges: int = RANGES) -> DataFrame:
    """`df` with the number of bounds that each row's key reaches as BLOCK; the last two numbers may be one.

    The search is a chain of plain projections: within generated code the bounds are one shared value,
    while a function with a lambda copies all of them into every row before it reads them.
    """
    placed = df.withColumns({"_bounds": range_bounds(df, key, ranges), "_key": key, BLOCK: F.lit(0).cast("bigint")})
    widths = [1]
    while widths[0] * _PARTS < ranges:
        widths.insert(0, widths[0] * _PARTS)
    for width in widths:
        # beyond the last bound there is NULL, which is not reached; so BLOCK is never NULL and no join has to filter for it
        at = [F.get("_bounds", (F.col(BLOCK) + part * width - 1).cast("int")) <= F.col("_key") for part in range(1, _PARTS)]
        reached = F.when(at[-1], F.lit(len(at)))
        for part in range(len(at) - 1, 0, -1):
            reached = reached.when(at[part - 1], F.lit(part))
        placed = placed.withColumn(BLOCK, F.col(BLOCK) + reached.otherwise(F.lit(0)) * width)
    return placed.drop("_bounds", "_key")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    number: str,
    measure: str,
    ties: Sequence[str] = (),
    *,
    descending: bool = False,
    ranges: int = RANGES,
) -> DataFrame:
    """Add `running` (inclusive, by `number` and then `ties` within `group`), `total` and the block.

    Rows fall into blocks by bounds on the whole order (group, number, ties), so neither close nor equal
    numbers gather in one block; only rows alike in all of them do. The bounds are found inside the plan:
    nothing runs while it is built. A shuffle or stage that gives `df` is read again for them, not computed
    again; a `df` that comes straight from files is scanned once more for the columns of the order. Sums per (group, block) give each block its offset, at most one more
    than `ranges` rows a group, and the window runs inside (group, block); sums, window and the join
    between them share one partitioning. A hot group spans its share of all blocks. `group` columns must
    not be NULL.
    """
    by = [*group, BLOCK]
    key = order_key(group, number, ties, descending=descending)
    blocked = with_blocks(df, key, ranges)
    earlier = W.partitionBy(*group).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*by)
        .agg(F.sum(measure).alias("_sum"))
        .select(
            *by,
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_sum").over(W.partitionBy(*group)).alias("total"),
        )
    )
    first = F.col(number).desc_nulls_last() if descending else F.col(number).asc_nulls_first()
    inside = W.partitionBy(*by).orderBy(first, *ties).rowsBetween(W.unboundedPreceding, 0)
    return (
        blocked.withColumn("_inside", F.sum(measure).over(inside))
        .join(offsets, by)
        .withColumn("running", F.col("_before") + F.coalesce("_inside", F.lit(0)))
        .drop("_before", "_inside")
    )


def quantile_columns(shares: dict[str, float], value: str = "_v", count: str = "_n") -> list[Column]:
    """Aggregates of counted values with running totals: exact quantiles with linear interpolation."""
    first, last = F.col("running") - F.col(count), F.col("running") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value)))

    result = []
    for name, share in shares.items():
        position = F.lit(share) * (F.col("total") - 1)
        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position - F.floor(position))
        result.append((low + (high - low) * fraction).alias(name))
    return result


def counted_values(df: DataFrame, value: str) -> DataFrame:
    """(_v, _n): each value that is not NULL and how often it occurs; a hot value is one row."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *, ranges: int = RANGES) -> DataFrame:
    """One row of exact quantiles with linear interpolation, NULL values ignored.

    The position of each value comes from running totals over its counts.
    """
    placed = running_totals(counted_values(df, value), [], "_v", "_n", ranges=ranges)
    return placed.agg(*quantile_columns(shares))
