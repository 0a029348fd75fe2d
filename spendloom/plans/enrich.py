"""Purchases enriched with localised attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.config import EnrichmentScope
from spendloom.functions.text import attribute_key, merge_text
from spendloom.operators.attributes import list_values, pivot_values
from spendloom.operators.joins import skewed_join


def attributes_per_product(values: DataFrame, scope: EnrichmentScope) -> DataFrame:
    """One row per product; each column lists the distinct values of its attributes."""
    wanted = values.filter(
        (F.col("language_id") == scope.language) & F.col("attribute_id").isin(*scope.attribute_ids)
    ).select(
        F.col("item_number").cast("string").alias("product_number"),
        attribute_key(F.col("attribute_id")).alias("_key"),
        "value",
    )
    listed = list_values(wanted.dropna(subset=["product_number"]), ["product_number", "_key"], "value")
    # Both spellings are pivoted; the old one is merged into its column below.
    old = {key: f"_old_{target}" for key, target in scope.merged.items()}
    wide = pivot_values(listed, ["product_number"], "_key", "value_list", scope.outputs | old)
    old_of = {target: old[key] for key, target in scope.merged.items()}
    return wide.select(
        "product_number",
        *[
            merge_text(F.col(out), F.col(old_of[key])).alias(out) if key in old_of else F.col(out)
            for key, out in scope.outputs.items()
        ],
    )


def enrich_purchases(
    purchases: DataFrame, values: DataFrame, scope: EnrichmentScope = EnrichmentScope()
) -> DataFrame:
    """Distinct purchase rows with one column per attribute.

    Identical purchase rows become one row, which lowers spend totals. Attributes
    are reduced per product first, so wide purchase rows are never grouped by
    attribute. They are shuffled once, by product, and those of hot products by
    a hash of the row as well.
    """
    attributes = attributes_per_product(values, scope)
    rows = purchases.withColumn("product_number", F.col("product_number").cast("string"))
    return skewed_join(rows, attributes, "product_number", spread=rows.columns, distinct=True).select(
        *purchases.columns, *scope.outputs.values()
    )
