"""Cumulative-share tiering per class, its summary and its reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from spendloom.config import ABC, ABCDE, TierScheme
from spendloom.functions.numbers import thousands
from spendloom.operators.joins import skewed_join
from spendloom.operators.lookups import keep_first
from spendloom.operators.prefix import BLOCK, RANGES, running_totals

_SPEND, _LABEL = "_spend", "_label"


def product_spend(
    purchases: DataFrame,
    class_col: str = "class4",
    product_col: str = "product_number",
    description_col: str = "product_description",
    spend_col: str = "purchase_amount_eur",
) -> DataFrame:
    """Spend per (class, product, description); rows missing one of them are left out.

    Missing amounts count as 0, also when a product has no other.
    """
    keys = [class_col, product_col, description_col]
    spend = F.coalesce(F.sum(spend_col), F.lit(0))
    return purchases.dropna(subset=keys).groupBy(*keys).agg(spend.alias(spend_col))


def _exact_spend(df: DataFrame, spend_col: str) -> Column:
    """The spend as a decimal: decimals as they are, whole numbers whole, doubles rounded to nine decimals.

    What is no finite number, or has more than 21 digits before the point, is NULL.
    """
    kind, spend = df.schema[spend_col].dataType, F.col(spend_col)
    if isinstance(kind, DecimalType):
        return spend
    if kind.typeName() in ("double", "float"):
        return spend.try_cast(DecimalType(30, 9))
    return spend.try_cast(DecimalType(20, 0))


def _with_shares(df: DataFrame, class_col: str, product_col: str, spend_col: str, ranges: int) -> DataFrame:
    """Add the exact spend, running spend, class total and block of every product.

    Equal spends are ordered by product and then by all other columns, so labels do not depend on the
    order of the rows.
    """
    ties = [product_col, *[c for c in df.columns if c not in (class_col, product_col, spend_col)]]
    exact = df.filter(F.col(class_col).isNotNull()).withColumn(_SPEND, _exact_spend(df, spend_col))
    scale = exact.schema[_SPEND].dataType.scale
    ranked = running_totals(exact, [class_col], _SPEND, _SPEND, ties, descending=True, ranges=ranges)
    # Room for a factor of up to 1,000: `denominator * running` then keeps its decimals.
    sums = DecimalType(34, scale)
    return ranked.withColumns(
        {"running": F.col("running").cast(sums), "total": F.coalesce(F.col("total").cast(sums), F.lit(0).cast(sums))}
    )


def _share() -> Column:
    return F.when(
        (F.col("total") > 0) & F.col(_SPEND).isNotNull(),
        F.col("running").cast("double") / F.col("total").cast("double"),
    )


def cumulative_share(
    df: DataFrame,
    class_col: str,
    product_col: str,
    spend_col: str,
    *,
    ranges: int = RANGES,
) -> DataFrame:
    """Add `cum_share`: share of the class spent on products up to and including this one.

    NULL when the class total is not positive or the spend is missing.
    """
    shared = _with_shares(df, class_col, product_col, spend_col, ranges)
    return shared.select(*df.columns, _share().alias("cum_share"))


def _label(scheme: TierScheme) -> Column:
    """Right-closed bins, compared as `denominator * running <= numerator * total` in whole factors."""
    running, total = F.col("running"), F.col("total")
    label = F.when(total <= 0, F.lit(scheme.labels[-1]))
    label = label.when(F.col(_SPEND).isNull(), F.lit(scheme.out_of_range))
    for name, threshold in zip(scheme.labels, scheme.thresholds):
        part = Fraction(str(threshold))
        label = label.when(F.lit(part.denominator) * running <= F.lit(part.numerator) * total, F.lit(name))
    return label.when(running <= total, F.lit(scheme.labels[-1])).otherwise(F.lit(scheme.out_of_range))


def _collapse_thin_tiers(df: DataFrame, class_col: str, scheme: TierScheme) -> DataFrame:
    """Move tiers with too few products of a class into the last tier.

    Counted per block first and attached by (class, block), so a hot class is
    neither counted nor joined in one task.
    """
    others, last = scheme.labels[:-1], scheme.labels[-1]
    per_block = df.groupBy(class_col, BLOCK).agg(
        *[F.count_if(F.col(_LABEL) == name).alias(f"_n{i}") for i, name in enumerate(others)]
    )
    in_class = W.partitionBy(class_col)
    thin = F.array_compact(
        F.array(
            *[
                F.when(F.sum(f"_n{i}").over(in_class) < scheme.min_products, F.lit(name))
                for i, name in enumerate(others)
            ]
        )
    )
    counts = per_block.select(class_col, BLOCK, thin.alias("_thin"))
    return (
        df.join(counts, [class_col, BLOCK])
        .withColumn(_LABEL, F.when(F.array_contains("_thin", F.col(_LABEL)), last).otherwise(F.col(_LABEL)))
        .drop("_thin")
    )


def tier_products(
    df: DataFrame,
    class_col: str,
    product_col: str,
    spend_col: str,
    scheme: TierScheme = ABCDE,
    *,
    label_col: str = "segmentation",
    ranges: int = RANGES,
) -> DataFrame:
    """Label each product of a class by cumulative spend share, largest spend first.

    Adds `cum_share` and `label_col`. The share includes the product itself, so
    the only product of a class has share 1 and gets the last label. Classes
    whose total is not positive get the last label; missing spend, and running
    spend above the class total (credits), get `scheme.out_of_range`. Equal
    spends are ordered by product, then by the other columns. Decimals are compared exactly; doubles
    count to nine decimals.
    """
    labelled = _with_shares(df, class_col, product_col, spend_col, ranges).withColumn(
        _LABEL, _label(scheme)
    )
    if scheme.min_products:
        labelled = _collapse_thin_tiers(labelled, class_col, scheme)
    return labelled.select(*df.columns, _share().alias("cum_share"), F.col(_LABEL).alias(label_col))


def abc_tiers(df: DataFrame, class_col: str, product_col: str, spend_col: str, **options) -> DataFrame:
    """Three tiers at 80 % and 95 %, without a minimum population."""
    return tier_products(df, class_col, product_col, spend_col, ABC, **options)


def collapse_small_tiers(
    df: DataFrame, class_col: str, label_col: str, labels: Sequence[str], min_products: int
) -> DataFrame:
    """Move (class, label) groups of fewer than `min_products` rows into the last label."""
    counts = (
        df.groupBy(class_col, label_col)
        .agg(F.count("*").alias("_n"))
        .filter((F.col("_n") < min_products) & F.col(label_col).isin(*labels))
        .withColumn("_thin", F.lit(True))
        .drop("_n")
    )
    # Only thin groups are listed; a hot class is at most a few rows here.
    label = F.when(F.col("_thin"), F.lit(labels[-1])).otherwise(F.col(label_col))
    return df.join(counts, [class_col, label_col], "left").withColumn(label_col, label).select(*df.columns)


def tier_counts(df: DataFrame, class_col: str, label_col: str = "segmentation") -> DataFrame:
    """Rows per class and tier."""
    return df.groupBy(class_col, label_col).agg(F.count("*").alias("products"))


def tier_summary(
    tiers: DataFrame,
    class_col: str = "class4",
    label_col: str = "segmentation",
    product_col: str = "product_number",
    spend_col: str = "purchase_amount_eur",
    unit: str = "EUR",
) -> DataFrame:
    """Distinct products and total spend per class and tier, plain and formatted."""
    return (
        tiers.dropna(subset=[class_col, label_col])
        .groupBy(class_col, label_col)
        .agg(
            F.countDistinct(product_col).alias("products"),
            F.coalesce(F.sum(spend_col), F.lit(0)).alias("spend_total"),
        )
        .withColumn("products_text", thousands(F.col("products")))
        .withColumn("spend_total_text", thousands(F.col("spend_total"), unit))
        .orderBy(class_col, label_col)
    )


def attach_segment(
    purchases: DataFrame,
    tiers: DataFrame,
    on: Sequence[str] = ("product_number",),
    label_col: str = "segmentation",
    *,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Purchases with the label of their product.

    By product alone a product tiered in several classes, or under several
    descriptions, repeats its purchases; join on class and product to avoid it.
    With `spread`, columns that tell the purchases of a product apart, products
    that hold much of all purchases are dealt to several tasks.
    """
    labels = tiers.select(*on, label_col)
    if spread:
        return skewed_join(purchases, labels, list(on), "left", spread=spread)
    return purchases.join(labels, list(on), "left")


def segment_per_product(tiers: DataFrame, product_col: str = "product_number") -> DataFrame:
    """One tier row per product: the first by class and description."""
    return keep_first(tiers, [product_col], [c for c in tiers.columns if c not in (product_col, "cum_share")])


def reconcile(
    raw: DataFrame,
    raw_col: str,
    summary: DataFrame,
    summary_col: str,
    rtol: float = 1e-5,
    atol: float = 1e-8,
) -> DataFrame:
    """One row comparing the total of `raw` with the total of its summary."""
    sides = raw.select(F.col(raw_col).alias("_raw"), F.lit(None).alias("_summary")).unionByName(
        summary.select(F.lit(None).alias("_raw"), F.col(summary_col).alias("_summary"))
    )
    difference = F.col("summary_total") - F.col("raw_total")
    close = F.abs(difference.cast("double")) <= atol + rtol * F.abs(F.col("raw_total").cast("double"))
    return sides.agg(
        F.coalesce(F.sum("_raw"), F.lit(0)).alias("raw_total"),
        F.coalesce(F.sum("_summary"), F.lit(0)).alias("summary_total"),
    ).select("raw_total", "summary_total", difference.alias("difference"), close.alias("matches"))
