"""Lookup tables: one row per key, or distinct pairs of a relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def any_value_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key; the smallest, so that the choice is repeatable.

    Pairs are counted first: Spark does that by hashing, while a minimum of
    texts makes it sort its input, here only the few pairs. (A plain distinct
    would be optimised away.)
    """
    pairs = df.groupBy(key, value).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 0)
    return pairs.groupBy(key).agg(F.min(value).alias(value))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, last: bool = False) -> DataFrame:
    """One whole row per key: the first by `order` (NULLs first), ties by all columns.

    An aggregate rather than a row number, so copies are thrown away before the
    shuffle and no task ever sorts a whole group. `last` keeps the last row.
    """
    rest = [c for c in df.columns if c not in keys]
    sort_key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("_order")
    row = F.struct(sort_key, *[F.col(c) for c in rest])
    pick = F.max(row) if last else F.min(row)
    return (
        df.groupBy(*keys)
        .agg(pick.alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
    )


def brand_map(brands: DataFrame, purchases: DataFrame) -> DataFrame:
    """Distinct (product, brand) pairs of the products that were purchased."""
    pairs = brands.select(F.col("product_number").cast("string"), "key_brand_identifier").distinct()
    bought = purchases.select(F.col("product_number").cast("string")).distinct()
    return pairs.join(bought, "product_number", "left_semi")


def stop_flag(company_products: DataFrame, products: DataFrame, companies: DataFrame, company_prefix: str) -> DataFrame:
    """Purchase-stop flag per product over the companies whose name starts with the prefix.

    'N' at any company makes the product active, which for 'Y'/'N' is the
    minimum. The flags of a product id are made distinct before its number is
    looked up.
    """
    ours = companies.filter(F.col("company_short_description").startswith(f"{company_prefix} ")).select("company_id")
    per_id = (
        company_products.join(ours, "company_id", "left_semi")
        .select("product_id", "purchase_stop_ind")
        .distinct()
    )
    numbers = products.select("product_id", F.col("product_number").cast("string"))
    return (
        per_id.join(numbers, "product_id", "left")
        .groupBy("product_number")
        .agg(F.min("purchase_stop_ind").alias("purchase_stop_ind"))
    )
