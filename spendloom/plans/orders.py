"""The order table: sales lines with item scope, stop flag and purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.config import ATTRIBUTE_ID_PREFIX, ITEM_BRAND_GROUPS, SALES_BRAND_GROUPS, OrderScope
from spendloom.functions.text import group_of
from spendloom.operators.attributes import pivot_values
from spendloom.operators.columns import stage_string_keys
from spendloom.operators.lookups import stop_flag

ITEM_COLUMNS = (
    "item_number",
    "item_description_eng",
    "key_brand_identifier",
    "rounding",
    "publishable_in_country",
    "item_segment",
)
HIERARCHY_COLUMNS = (
    "class4_number",
    "class4_description",
    "class3_number",
    "class3_description",
    "class2_number",
    "class2_description",
)


def items_sold(sales: DataFrame, after_year: int) -> DataFrame:
    """Sales lines with an order number after a year, brand types grouped."""
    return sales.filter(F.col("order_number").isNotNull() & (F.col("year_number") > after_year)).withColumn(
        "brand_type", group_of(F.col("brand_type"), SALES_BRAND_GROUPS)
    )


def items_in_scope(
    items: DataFrame, hierarchy: DataFrame, brands: DataFrame, values: DataFrame, scope: OrderScope
) -> DataFrame:
    """Distinct publishable items with class, brand group and one dimension."""
    dimension = pivot_values(
        values.filter(
            F.col("id").startswith(ATTRIBUTE_ID_PREFIX) & (F.col("attribute_id") == scope.dimension_attribute)
        ),
        ["id"],
        "attribute_id",
        "value",
        {scope.dimension_attribute: "_dimension"},
    )
    classes = hierarchy.select(F.col("class4_number").alias("key_class4_number"), *HIERARCHY_COLUMNS)
    brand_types = brands.select("key_brand_identifier", F.col("brand_type").alias("_brand_type"))
    published = items.filter(F.col("publishable_in_country").isNotNull())
    joined = published.join(classes, "key_class4_number", "left")
    if scope.class2:
        joined = joined.filter(F.col("class2_description").isin(*scope.class2))
    joined = joined.join(brand_types, "key_brand_identifier", "left").join(dimension, "id", "left")
    is_sized = F.lower("item_description_eng").contains(scope.dimension_word) & (
        F.col("class3_description") == scope.dimension_class3
    )
    return joined.select(
        F.col("id").alias("item_id"),
        *[F.col(c).alias("item_description" if c == "item_description_eng" else c) for c in ITEM_COLUMNS],
        *HIERARCHY_COLUMNS,
        group_of(F.col("_brand_type"), ITEM_BRAND_GROUPS).alias("brand_type_step"),
        F.when(is_sized, F.col("_dimension").try_cast("decimal(38,9)")).alias("dimension_per_product_type"),
    ).distinct()


def purchases_by_year(purchases: DataFrame) -> DataFrame:
    """Amount, quantity and number of purchase rows per product and year."""
    return purchases.groupBy(
        F.col("product_number").cast("string").alias("item_number"),
        F.col("year_authorization").alias("purchase_year_authorization"),
    ).agg(
        F.sum("purchase_amount_eur").alias("purchase_amount_eur"),
        F.sum("purchase_quantity").alias("purchase_quantity"),
        F.count("*").alias("purchase_rows"),
    )


def build_orders(
    sales: DataFrame,
    items: DataFrame,
    hierarchy: DataFrame,
    brands: DataFrame,
    values: DataFrame,
    company_products: DataFrame,
    products: DataFrame,
    companies: DataFrame,
    purchases: DataFrame,
    scope: OrderScope,
) -> DataFrame:
    """Sales lines of active items in scope, with the purchases of the item.

    Purchases come as one row per year, so a sales line is repeated at most once
    per year. Do not sum the sales measures afterwards.
    """
    sold = items_sold(stage_string_keys(sales, ["product_number"]), scope.after_year)
    active = stop_flag(company_products, products, companies, scope.company_prefix).filter(
        F.col("purchase_stop_ind") == "N"
    )
    wanted = items_in_scope(items, hierarchy, brands, values, scope)
    scoped = stage_string_keys(wanted, ["item_number"]).join(
        active.withColumnRenamed("product_number", "item_number"), "item_number"
    )
    scoped = scoped.join(purchases_by_year(purchases), "item_number", "left")
    lines = sold.join(scoped.withColumn("product_number", F.col("item_number")), "product_number", "inner")
    return lines.select(
        *sales.columns,
        *wanted.columns,
        "purchase_stop_ind",
        "purchase_year_authorization",
        "purchase_amount_eur",
        "purchase_quantity",
        "purchase_rows",
    )
