"""The purchase table: build, aggregate and sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.config import CLASS_SCOPE, PURCHASE_KEYS, PurchaseScope
from spendloom.functions.numbers import to_number
from spendloom.functions.text import class_code, equals_normalised, in_scope
from spendloom.operators.columns import stage_string_keys
from spendloom.operators.lookups import any_value_per_key, stop_flag


def scope_purchases(purchases: DataFrame, scope: PurchaseScope) -> DataFrame:
    """Rows of the wanted vendor state, years, classes and brand; pushed to the scan."""
    product = F.col("product_number")
    kept = purchases.filter(
        F.col("crm_main_group_vendor").isNotNull()
        & (F.col("year_authorization") > scope.after_year)
        & (class_code(F.col("class2")) == scope.class2_code)
        & equals_normalised(F.col("brand_name"), scope.brand)
        & in_scope(F.col("class4"), scope.classes)
    )
    return kept if scope.exclude_product is None else kept.filter(~product.rlike(scope.exclude_product))


def build_purchases(
    purchases: DataFrame,
    brands: DataFrame,
    company_products: DataFrame,
    products: DataFrame,
    companies: DataFrame,
    sales: DataFrame,
    scope: PurchaseScope,
) -> DataFrame:
    """Scoped purchase rows of active products with brand id, stop flag and rounding.

    The three lookups are combined per product first, so the purchase rows are
    shuffled once. A product with several brand ids repeats its rows.
    """
    fact = scope_purchases(stage_string_keys(purchases, ["product_number"]), scope)
    active = stop_flag(company_products, products, companies, scope.company_prefix).filter(
        F.col("purchase_stop_ind") == "N"
    )
    rounding = any_value_per_key(stage_string_keys(sales, ["product_number"]), "product_number", "sales_rounding")
    brand_ids = stage_string_keys(brands, ["product_number"]).select("product_number", "key_brand_identifier")
    lookup = (
        active.dropna(subset=["product_number"])
        .join(rounding, "product_number", "left")
        .join(brand_ids.distinct(), "product_number", "left")
    )
    return fact.join(lookup, "product_number", "inner").select(
        *purchases.columns, "key_brand_identifier", "purchase_stop_ind", "sales_rounding"
    )


def fetch_purchases(
    purchases: DataFrame,
    classes: Sequence[str] = CLASS_SCOPE,
    keys: Sequence[str] = PURCHASE_KEYS,
    limit: int | None = None,
) -> DataFrame:
    """Amount and quantity per purchase key of the classes in scope, largest amount first."""
    result = (
        purchases.filter(in_scope(F.col("class4"), list(classes)))
        .groupBy(*keys)
        .agg(
            F.sum("purchase_amount_eur").alias("purchase_amount_eur"),
            F.sum("purchase_quantity").alias("purchase_quantity"),
        )
        .orderBy(F.desc("purchase_amount_eur"), *keys)
    )
    return result if limit is None else result.limit(limit)


def scoped_sample(purchases: DataFrame, classes: Sequence[str] = CLASS_SCOPE, limit: int = 1000) -> DataFrame:
    """Some raw purchase rows of the classes in scope."""
    return purchases.filter(in_scope(F.col("class4"), list(classes))).limit(limit)


def fetch_enriched_purchases(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def fetch_super_table(
    df: DataFrame,
    class3: Sequence[str] | None = None,
    brand_name: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of the wide table; a filter or limit not given does not restrict."""
    if class3:
        df = df.filter(F.col("class3").isin(*class3))
    if brand_name:
        df = df.filter(F.col("brand_name").isin(*brand_name))
    return df if limit is None else df.limit(limit)


def fetch_super_table_for_clustering(
    df: DataFrame,
    features: Sequence[str],
    key: str = "product_number",
    class3: Sequence[str] | None = None,
    brand_name: Sequence[str] | None = None,
) -> DataFrame:
    """Key and numeric features of the rows in the filters, without rows that miss one of them."""
    rows = fetch_super_table(df, class3, brand_name)
    numbers = rows.select(F.col(key), *[to_number(F.col(c), None).alias(c) for c in features])
    return numbers.dropna(subset=[key, *features])
