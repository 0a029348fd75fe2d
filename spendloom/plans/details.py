"""Product details from whichever table has them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendloom.config import DETAIL_NAMES
from spendloom.functions.text import non_blank, strip_id_prefix, trimmed
from spendloom.operators.attributes import (
    candidate_ids,
    first_detail,
    pivot_details,
    unpivot_details,
)

DETAIL_SCHEMA = "product_number string, detail_name string, detail_value string"


def details_from_enrichment(enrichment: DataFrame, numbers: DataFrame) -> DataFrame:
    """Details of the products in a wide table keyed by product number."""
    wanted = numbers.select(non_blank(F.col("product_number").cast("string")).alias("product_number"))
    rows = enrichment.withColumn("product_number", F.col("product_number").cast("string"))
    kept = rows.join(wanted.dropna().distinct(), "product_number", "left_semi")
    return first_detail(unpivot_details(kept, display_names=False))


def is_long(product_data: DataFrame) -> bool:
    return {"attribute_name", "attribute_value"} <= set(product_data.columns)


def details_from_long(product_data: DataFrame, ids: DataFrame, names: Sequence[str] | None = DETAIL_NAMES) -> DataFrame:
    """Details of the ids in a long table, for the given names or for all; blank names and values are none.

    `_known` tells which names are among the known ones.
    """
    rows = product_data if names is None else product_data.filter(F.col("attribute_name").isin(*names))
    kept = rows.join(ids, "product_id", "left_semi")
    return kept.select(
        non_blank(strip_id_prefix(F.col("product_id"))).alias("product_number"),
        non_blank(F.col("attribute_name").cast("string")).alias("detail_name"),
        non_blank(F.col("attribute_value").cast("string")).alias("detail_value"),
        F.col("attribute_name").isin(*DETAIL_NAMES).alias("_known"),
    ).dropna()


def details_from_wide(product_data: DataFrame, ids: DataFrame) -> DataFrame:
    """Details of the ids in a table with one column per attribute."""
    kept = product_data.join(ids, "product_id", "left_semi")
    if "product_number" not in kept.columns:
        kept = kept.withColumn("product_number", strip_id_prefix(F.col("product_id").cast("string")))
    return first_detail(unpivot_details(kept, skip=["product_id"]))


def fetch_details(
    numbers: DataFrame,
    enrichment: DataFrame | None = None,
    product_data: DataFrame | None = None,
    *,
    discover_names: bool = True,
) -> DataFrame:
    """(product_number, detail_name, detail_value) of the products, one value each.

    Sources in order: the enrichment table, then the long product table with the known names and with
    any names, or the wide product table. Each product takes the first source that has it. All of it is
    one lazy plan that reads each table once; which sources apply is decided on their schema.
    """
    sources = []
    if enrichment is not None and "product_number" in enrichment.columns:
        sources.append(details_from_enrichment(enrichment, numbers).withColumn("_source", F.lit(0)))
    if product_data is not None:
        ids = candidate_ids(numbers)
        if is_long(product_data):
            found = details_from_long(product_data, ids, None if discover_names else DETAIL_NAMES)
            sources.append(found.withColumn("_source", F.when(F.col("_known"), 1).otherwise(2)).drop("_known"))
        else:
            sources.append(details_from_wide(product_data, ids).withColumn("_source", F.lit(1)))
    if not sources:
        return numbers.sparkSession.createDataFrame([], DETAIL_SCHEMA)
    # the least value of each (product, source, name), before products choose their source
    rows = reduce(DataFrame.unionByName, sources).groupBy("product_number", "_source", "detail_name")
    values = rows.agg(F.min("detail_value").alias("detail_value"))
    best = F.min("_source").over(Window.partitionBy("product_number"))
    return values.withColumn("_best", best).filter("_source = _best").select("product_number", "detail_name", "detail_value")


def product_details(
    numbers: DataFrame, enrichment: DataFrame | None = None, product_data: DataFrame | None = None
) -> DataFrame:
    """One row per product with a column for every known detail."""
    return pivot_details(fetch_details(numbers, enrichment, product_data))
