"""The wide product table built from attribute values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.config import ATTRIBUTE_ID_PREFIX, PRODUCT_RULES, PRODUCT_RULES_MIN, AttributeRule
from spendloom.operators.attributes import clean_values, pivot_by_rules
from spendloom.operators.columns import safe_columns, stage_string_keys

_VALUE_KEYS = ("id", "attribute_id", "value")


def product_bricks(rel: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Products with brick and node; NULL where the hierarchy lacks the column or the product."""
    products = stage_string_keys(rel, ["product_id"])
    nodes = ["brick_id", "classification_node_id"]
    if not any(c in hierarchy.columns for c in nodes):
        return products.withColumns({c: F.lit(None).cast("string") for c in nodes})
    places = safe_columns(hierarchy, {c: "string" for c in ("golden_item_id", *nodes)})
    return products.join(places.withColumnRenamed("golden_item_id", "product_id"), "product_id", "left")


def attribute_values(values: DataFrame) -> DataFrame:
    """Clean values of the ids that carry product attributes."""
    own = stage_string_keys(values, _VALUE_KEYS).filter(F.col("id").startswith(ATTRIBUTE_ID_PREFIX))
    return clean_values(own.select(*_VALUE_KEYS))


def _attribute_names(meta: DataFrame) -> DataFrame:
    return meta.select(F.col("id").cast("string").alias("attribute_id"), "name_eng")


def build_products(
    rel: DataFrame,
    hierarchy: DataFrame,
    values: DataFrame,
    meta: DataFrame,
    rules: Sequence[AttributeRule] = PRODUCT_RULES,
) -> DataFrame:
    """One row per (product, brick) with a column per rule, English attributes only.

    Values do not depend on the brick, so they are pivoted per product before
    they meet the bricks.
    """
    english = _attribute_names(meta).filter(F.col("name_eng").isNotNull())
    wide = pivot_by_rules(attribute_values(values).join(english, "attribute_id", "inner"), ["id"], rules)
    bricks = product_bricks(rel, hierarchy).select("product_id", "brick_id").dropna(subset=["product_id"]).distinct()
    return bricks.join(wide.withColumnRenamed("id", "product_id"), "product_id").select(
        "product_id", "brick_id", *[r.output for r in rules]
    )


def build_products_min(
    values: DataFrame, meta: DataFrame, rules: Sequence[AttributeRule] = PRODUCT_RULES_MIN
) -> DataFrame:
    """One row per product with a few columns; attributes without a name are kept."""
    named = attribute_values(values).join(_attribute_names(meta), "attribute_id", "left")
    return pivot_by_rules(named, ["id"], rules).withColumnRenamed("id", "product_id")
