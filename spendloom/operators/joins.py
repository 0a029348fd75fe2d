"""Joins for sides in which a few keys hold most rows.

Elsewhere joins are plain: the planner chooses their form from sizes it measures while it runs, and it
splits skewed partitions of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT, _SALTS, _HASH = "_salt", "_salts", "_key_hash"

#: A key is hot when it holds more than one of so many parts of all rows; it then spreads over that many tasks at most.
PARTS = 64


def _key_hash(df: DataFrame, on: Sequence[str], like: DataFrame) -> Column:
    """Hash of the key columns, as of the types they have in `like`."""
    return F.xxhash64(*[F.col(c).cast(like.schema[c].dataType) for c in on])


def heavy_keys(df: DataFrame, on: str | Sequence[str], parts: int = PARTS) -> DataFrame:
    """(_key_hash, salts) of the keys that hold more than one of `parts` parts of all rows: a lazy frame of less than 2 * `parts` rows.

    A mergeable sketch of frequent items finds them in one pass over the key columns; each task sends a
    sketch, not its rows. The sketch keeps 64 times as many items as there can be hot keys, so a key's
    count is off by less than a thirtieth of what makes it hot, and none with that much more is missed. Its
    counts decide nothing but how wide a key is spread; results of a join do not depend on them.
    """
    on = [on] if isinstance(on, str) else list(on)
    kept = 2 * parts
    sketch = f"approx_top_k({_HASH}, {kept}, {32 * kept})"
    found = df.select(_key_hash(df, on, df).alias(_HASH)).agg(F.expr(sketch).alias("top"), F.count("*").alias("rows"))
    each = found.select("rows", F.explode("top").alias("x")).select("rows", F.col("x.item").alias(_HASH), F.col("x.count").alias("n"))
    share = F.ceil(F.col("n") * parts / F.col("rows")).cast("int")
    return each.filter(F.col("n") * parts > F.col("rows")).select(_HASH, share.alias("salts"))


def salted_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", *, hot: DataFrame, spread: Sequence[str], distinct: bool = False
) -> DataFrame:
    """Equi-join (inner, left, left_semi or left_anti) that spreads the left rows of listed keys.

    `hot` is a lazy frame, one row per key: `salts` and either the `on` columns or, as `heavy_keys` gives
    it, their hash. The salt of a left row is a hash of its `spread` columns, so a retried task gives the
    same; only the right rows of listed keys are repeated, once per salt. With `distinct`, left rows alike in
    all columns count once, and the shuffle of the join brings them together. No job runs here.
    """
    on = [on] if isinstance(on, str) else list(on)
    keys = [_HASH] if _HASH in hot.columns else on
    listed = hot.select(*keys, F.col("salts").alias(_SALTS))
    if keys == [_HASH]:
        # less than two rows for each of the parts, so it need not be found out that this is small
        listed = F.broadcast(listed)

    def with_salts(df: DataFrame) -> DataFrame:
        hashed = df.withColumn(_HASH, _key_hash(df, on, left)) if keys == [_HASH] else df
        return hashed.join(listed, keys, "left").withColumn(_SALTS, F.coalesce(_SALTS, F.lit(1)))

    spread_left = with_salts(left).withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.col(_SALTS)).cast("int"))
    repeated = with_salts(right).withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.col(_SALTS) - 1)))
    spread_left = spread_left.drop(_SALTS, _HASH)
    if distinct:
        spread_left = spread_left.repartition(*on, _SALT).distinct()
    return spread_left.join(repeated.drop(_SALTS, _HASH), [*on, _SALT], how).drop(_SALT)


def skewed_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", *, spread: Sequence[str], parts: int = PARTS, distinct: bool = False
) -> DataFrame:
    """The same as a plain equi-join of a large `left` with a `right` side of few rows per key.

    Keys that hold more than one of `parts` parts of the left rows, missing keys too, are found by a sketch
    inside the plan and spread by a hash of the `spread` columns. The key columns of `left` are read once
    more for it.
    """
    return salted_join(left, right, on, how, hot=heavy_keys(left, on, parts), spread=spread, distinct=distinct)
