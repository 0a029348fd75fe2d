"""One query per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.config import ABCDE, EnrichmentScope, OrderScope, PurchaseScope, SALES_BRAND_GROUPS, TierScheme
from spendloom.functions import text
from spendloom.functions.names import resolve_column
from spendloom.functions.numbers import year_of
from spendloom.operators import attributes, clustering, columns, lookups, profile, tiers, years
from spendloom.plans import details, enrich as enrichment, orders, products, purchases, segmentation
from spendloom.session import scratch_path
from spendloom.sources import catalog, files
from spendloom.verification import roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPEND = "purchase_amount_eur"
TIER_ARGS = ("class4", "product_number", SPEND)

#: Classes in scope, as the scope list of the source is for its own classes.
SCOPE = tuple(f"brand#{n}" for n in range(1, 21))
PURCHASES = PurchaseScope(
    brand="red", company_prefix="Acme", class2_code="2", after_year=1996, classes=SCOPE, exclude_product="01$"
)
ORDERS = OrderScope(company_prefix="Acme", after_year=1997, dimension_word="bolt")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines print them alike."""
    decimals = [f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


# --- Tiers -------------------------------------------------------------------------


def _spend(spark: SparkSession, d: str) -> DataFrame:
    return tiers.product_spend(roles.part_totals(spark, d))


def _tiers(spark: SparkSession, d: str, **options) -> DataFrame:
    return tiers.tier_products(_spend(spark, d), *TIER_ARGS, **options)


@query
def abcde_tiers(spark, d):
    return plain(_tiers(spark, d))


@query
def abcde_tiers_blocks(spark, d):
    """The same with finer blocks."""
    return plain(_tiers(spark, d, ranges=64))


@query
def abc_tiers(spark, d):
    return plain(tiers.abc_tiers(_spend(spark, d), *TIER_ARGS))


@query
def cum_share(spark, d):
    return plain(tiers.cumulative_share(_spend(spark, d), *TIER_ARGS))


@query
def credit_tiers(spark, d):
    scheme = TierScheme(min_products=0)
    return plain(tiers.tier_products(roles.credits(spark, d), "class4", "product_number", "balance", scheme))


@query
def credit_tiers_blocks(spark, d):
    scheme = TierScheme(min_products=0)
    return plain(
        tiers.tier_products(roles.credits(spark, d), "class4", "product_number", "balance", scheme, ranges=64)
    )


@query
def min_population(spark, d):
    raw = _tiers(spark, d, scheme=TierScheme(min_products=0))
    return plain(tiers.collapse_small_tiers(raw, "class4", "segmentation", ABCDE.labels, 5))


@query
def product_spend(spark, d):
    return plain(tiers.product_spend(roles.purchases(spark, d)))


@query
def tier_counts(spark, d):
    return tiers.tier_counts(_tiers(spark, d), "class4")


@query
def tier_summary(spark, d):
    return plain(tiers.tier_summary(_tiers(spark, d)))


@query
def attach_segment(spark, d):
    return plain(tiers.attach_segment(roles.purchases(spark, d), _tiers(spark, d)))


@query
def attach_segment_hot(spark, d):
    """A third of all purchases are of one product."""
    hot = F.when(F.col("uniquevendorcode").cast("int") % 3 == 0, "7").otherwise(F.col("product_number"))
    rows = roles.purchases(spark, d).withColumn("product_number", hot)
    return plain(tiers.attach_segment(rows, _tiers(spark, d), spread=["uniquevendorcode", SPEND, "purchase_quantity"]))


@query
def attach_segment_by_class(spark, d):
    joined = tiers.attach_segment(roles.part_purchases(spark, d), _tiers(spark, d), ["class4", "product_number"])
    return plain(joined)


@query
def reconcile(spark, d):
    purchase_rows = roles.part_purchases(spark, d)
    return plain(tiers.reconcile(purchase_rows, SPEND, tiers.tier_summary(_tiers(spark, d)), "spend_total"))


@query
def segmentation_report(spark, d):
    report = segmentation.segmentation_report(roles.purchases(spark, d), classes=SCOPE, years=_ship_years(spark, d))
    return plain(report["year_split"])


def _table_totals(report: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table of the report, and what its spend columns add up to."""
    sums = {"product_spend": SPEND, "tiers": SPEND, "purchases": SPEND, "summary": "spend_total", "reconciliation": "raw_total", "year_quantity": "purchase_quantity"}
    tables = []
    for name, df in report.items():
        total = F.sum(sums[name]) if name in sums else F.lit(None)
        tables.append(df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.round(total.cast("double"), 2).alias("total")))
    return reduce(DataFrame.union, tables)


@query
def report_tables(spark, d):
    report = segmentation.segmentation_report(roles.purchases(spark, d), classes=SCOPE, years=_ship_years(spark, d))
    return _table_totals(report)


@query
def staged_report_tables(spark, d):
    """The same from tables that are written once."""
    years = _ship_years(spark, d)
    path = scratch_path(spark, "report")
    return _table_totals(segmentation.staged_report(roles.purchases(spark, d), path, classes=SCOPE, years=years))


@query
def tiers_four_decimals(spark, d):
    """Small spends of four decimals, each product under two descriptions of equal spend."""
    parts = roles.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("class4"), F.explode(F.array("p_name", "p_type")).alias("product_description"))
    taxes = roles.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    spend = taxes.agg(F.sum((F.col("l_tax") * F.col("l_discount")).cast("decimal(18,4)")).alias(SPEND))
    rows = parts.join(spend, "p_partkey").withColumn("product_number", F.col("p_partkey").cast("string")).drop("p_partkey")
    return plain(tiers.tier_products(rows, *TIER_ARGS))


@query
def tiers_narrow(spark, d):
    """Spends that differ in the sixth digit and beyond, all in one class."""
    rows = roles.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_linenumber")).cast("decimal(18,6)").alias("n"))
    spend = (F.lit(10) + (F.col("n") * 1009 + F.col("l_orderkey") % 997) / 1_000_000).cast("decimal(18,6)")
    rows = rows.select(F.lit("one").alias("class4"), F.col("l_orderkey").cast("string").alias("product_number"), spend.alias(SPEND))
    return plain(tiers.tier_products(rows, *TIER_ARGS))


@query
def tiers_equal(spark, d):
    """Half of all orders in one class, all of one and the same spend."""
    rows = roles.table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "one").otherwise(F.col("o_orderpriority")).alias("class4"),
        F.concat(F.lit("item-"), F.col("o_orderkey").cast("string")).alias("product_number"),
        F.lit(10).cast("decimal(18,2)").alias(SPEND),
    )
    return plain(tiers.tier_products(rows, *TIER_ARGS))


@query
def kmeans_tiers(spark, d):
    return plain(clustering.kmeans_tiers(_spend(spark, d), SPEND))


@query
def gmm_tiers(spark, d):
    return plain(clustering.gmm_tiers(_spend(spark, d), SPEND))


@query
def product_clusters(spark, d):
    per_product = roles.purchases(spark, d).groupBy("product_number").agg(
        F.sum(SPEND).cast("double").alias("spend"), F.sum("purchase_quantity").alias("quantity")
    )
    found = clustering.ProductClustering(["spend", "quantity"], candidates=(2, 3, 4), key="product_number").run(per_product)
    return found.select("product_number", "cluster")


# --- Purchases ---------------------------------------------------------------------


@query
def fetch_purchase(spark, d):
    return plain(purchases.fetch_purchases(roles.purchases(spark, d), SCOPE))


@query
def scoped_sample(spark, d):
    """What a sample holds: its rows, and how many of them are in scope."""
    sample = purchases.scoped_sample(roles.purchases(spark, d), SCOPE, 1000)
    return sample.agg(
        F.count("*").alias("rows"), F.count_if(text.in_scope(F.col("class4"), SCOPE)).alias("rows_in_scope")
    )


@query
def super_table(spark, d):
    return plain(
        purchases.fetch_super_table(roles.purchases(spark, d), class3=["PROMO", "SMALL"], brand_name=[" RED\t"])
    )


@query
def clustering_fetch(spark, d):
    rows = roles.purchases(spark, d)
    return purchases.fetch_super_table_for_clustering(
        rows, [SPEND, "purchase_quantity"], class3=["PROMO", "SMALL"], brand_name=[" RED\t"]
    )


@query
def year_groups(spark, d):
    """The year columns of each measure."""
    metrics = years.year_metrics(roles.sales(spark, d), "product_number", _order_years(spark, d))
    groups = years.year_column_groups(metrics, ["turnover_eur", "orders", "absent"])
    return spark.createDataFrame([(k, ",".join(v)) for k, v in groups.items()], "measure string, year_columns string")


@query
def purchase_build(spark, d):
    return plain(
        purchases.build_purchases(
            roles.purchase_source(spark, d),
            roles.brands_raw(spark, d),
            roles.company_products(spark, d),
            roles.product_dim(spark, d),
            roles.company_dim(spark, d),
            roles.rounding_source(spark, d),
            PURCHASES,
        )
    )


@query
def brand_map(spark, d):
    scoped = purchases.scope_purchases(roles.purchase_source(spark, d), PURCHASES)
    return lookups.brand_map(roles.brands_raw(spark, d), scoped)


@query
def stop_flag(spark, d):
    return lookups.stop_flag(
        roles.company_products(spark, d), roles.product_dim(spark, d), roles.company_dim(spark, d), "Acme"
    )


@query
def any_lookup(spark, d):
    return lookups.any_value_per_key(roles.rounding_source(spark, d), "product_number", "sales_rounding")


@query
def dedup_first(spark, d):
    rows = roles.purchases(spark, d).select(
        "product_number", "year_authorization", "uniquevendorcode", "purchase_quantity", SPEND
    )
    return plain(lookups.keep_first(rows, ["product_number"], ["year_authorization", SPEND]))


# --- Orders ------------------------------------------------------------------------


def _item_inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        roles.items(spark, d),
        roles.class_hierarchy(spark, d),
        roles.item_brands(spark, d),
        roles.dimension_values(spark, d),
    ]


@query
def items_in_scope(spark, d):
    return plain(orders.items_in_scope(*_item_inputs(spark, d), ORDERS))


@query
def order_build(spark, d):
    return plain(
        orders.build_orders(
            roles.sales(spark, d),
            *_item_inputs(spark, d),
            roles.company_products(spark, d),
            roles.product_dim(spark, d),
            roles.company_dim(spark, d),
            roles.purchases(spark, d),
            ORDERS,
        )
    )


@query
def brand_group(spark, d):
    grouped = orders.items_sold(roles.sales(spark, d), 1997)
    return grouped.groupBy("brand_type").agg(F.count("*").alias("rows"))


@query
def purchases_by_year(spark, d):
    return plain(orders.purchases_by_year(roles.purchases(spark, d)))


# --- Products and attributes -------------------------------------------------------


@query
def product_build(spark, d):
    return products.build_products(
        roles.product_rel(spark, d),
        roles.product_hierarchy(spark, d),
        roles.attribute_values(spark, d),
        roles.attribute_meta(spark, d),
    )


@query
def product_build_min(spark, d):
    return products.build_products_min(roles.attribute_values(spark, d), roles.attribute_meta(spark, d))


@query
def safe_columns(spark, d):
    return products.product_bricks(roles.product_rel(spark, d), roles.product_hierarchy(spark, d))


@query
def stage_string_keys(spark, d):
    return columns.stage_string_keys(roles.table(spark, d, "part"), ["p_partkey"])


@query
def attr_clean(spark, d):
    return attributes.clean_values(roles.attribute_values(spark, d))


@query
def attr_key(spark, d):
    keyed = roles.local_attributes(spark, d).withColumn("attr_key", text.attribute_key(F.col("attribute_id")))
    return keyed.groupBy("attribute_id", "attr_key").agg(F.count("*").alias("rows"))


@query
def attr_listagg(spark, d):
    keyed = roles.local_attributes(spark, d).withColumn("attr_key", text.attribute_key(F.col("attribute_id")))
    return attributes.list_values(keyed, ["item_number", "attr_key"], "value")


@query
def attr_list_pages(spark, d):
    """The products of each attribute and value, in pages of 500 characters."""
    keyed = roles.local_attributes(spark, d).withColumn("attr_key", text.attribute_key(F.col("attribute_id")))
    return attributes.list_pages(keyed, ["attr_key", "value"], "item_number", 500)


@query
def attr_list_joined(spark, d):
    keyed = roles.local_attributes(spark, d).withColumn("attr_key", text.attribute_key(F.col("attribute_id")))
    return attributes.join_pages(attributes.list_pages(keyed, ["item_number", "attr_key"], "value", 7), ["item_number", "attr_key"])


@query
def enrich(spark, d):
    return plain(enrichment.enrich_purchases(roles.purchases(spark, d), roles.local_attributes(spark, d)))


@query
def enrich_attributes(spark, d):
    return enrichment.attributes_per_product(roles.local_attributes(spark, d), EnrichmentScope(language="NLD"))


@query
def merge_columns(spark, d):
    parts = roles.table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_type")).alias("a"),
        F.when(F.col("p_size") < 40, F.when(F.col("p_size") < 20, F.col("p_type")).otherwise(F.col("p_brand"))).alias("b"),
    )
    return attributes.merge_columns(parts, "a", "b", "merged")


@query
def expected_attrs(spark, d):
    return attributes.expected_attributes(roles.placed_values(spark, d), roles.attribute_template(spark, d))


@query
def attributes_wide(spark, d):
    return attributes.pivot_attributes_wide(
        roles.local_attributes(spark, d), ["item_number", "language_id"], "value", names=roles.local_attribute_ids(spark, d)
    )


@query
def candidate_ids(spark, d):
    return attributes.candidate_ids(roles.detail_numbers(spark, d))


@query
def detail_fetch(spark, d):
    return details.fetch_details(roles.detail_numbers(spark, d), product_data=roles.long_details(spark, d))


@query
def detail_fetch_sparse(spark, d):
    """A third of the values are missing, a third are blank."""
    number = F.substring(text.trimmed(F.col("attribute_value")), 2, 9).cast("int") % 3
    value = F.when(number == 1, " \t\u00a0").when(number == 2, F.col("attribute_value"))
    long = roles.long_details(spark, d).withColumn("attribute_value", value)
    return details.fetch_details(roles.detail_numbers(spark, d), product_data=long)


@query
def detail_fetch_wide(spark, d):
    return details.fetch_details(roles.detail_numbers(spark, d), product_data=roles.wide_products(spark, d))


@query
def detail_fetch_discovered(spark, d):
    """Thirteen names, none of them known: all are found."""
    value = text.trimmed(F.col("attribute_value"))
    number = F.length(value) * 7 + F.ascii(value) + F.ascii(F.right(value, F.lit(1)))
    odd = F.concat(F.lit("Odd "), (number % 13).cast("string"))
    long = roles.long_details(spark, d).withColumn("attribute_name", odd)
    return details.fetch_details(roles.detail_numbers(spark, d), product_data=long)


@query
def detail_fetch_mixed(spark, d):
    """An enrichment table that has a third of the products; the others come from the long table."""
    enriched = roles.table(spark, d, "part").filter("p_partkey % 3 = 0").select(
        F.col("p_partkey").cast("string").alias("product_number"), F.col("p_size").alias("size"), F.col("p_brand").alias("make")
    )
    return details.fetch_details(roles.detail_numbers(spark, d), enriched, roles.long_details(spark, d))


@query
def detail_discovery(spark, d):
    long = roles.long_details(spark, d).withColumnRenamed("attribute_name", "detail_name")
    return attributes.detail_names(long)


@query
def detail_pivot(spark, d):
    return details.product_details(roles.detail_numbers(spark, d), product_data=roles.long_details(spark, d))


@query
def detail_unpivot(spark, d):
    wide = roles.wide_products(spark, d).withColumn("product_number", text.strip_id_prefix(F.col("product_id")))
    return attributes.unpivot_details(wide, skip=["product_id"])


# --- Years -------------------------------------------------------------------------


@query
def year_norm(spark, d):
    year = F.year("l_shipdate").cast("string")
    line = F.col("l_linenumber")
    year_text = (
        F.when(line == 1, year)
        .when(line == 2, F.concat(year, F.lit("-05-01")))
        .when(line == 3, F.concat(year, F.lit("-5-1")))
        .when(line == 4, F.concat(year, F.lit("xyz")))
        .when(line == 5, F.lit("abcd"))
    )
    rows = roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", year_text.alias("year_text"))
    return rows.withColumn("year", year_of(F.col("year_text")))


def _year_rows(spark: SparkSession, d: str) -> DataFrame:
    return years.year_quantity(roles.purchases(spark, d), SCOPE)


def _ship_years(spark: SparkSession, d: str) -> list[int]:
    """Years of the purchases, read from their date alone."""
    return years.known_years(roles.table(spark, d, "lineitem"), F.year("l_shipdate"))


def _order_years(spark: SparkSession, d: str) -> list[int]:
    return years.known_years(roles.table(spark, d, "orders"), F.year("o_orderdate"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d).select("product_number", "product_description", "segmentation")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return tiers.segment_per_product(_labels(spark, d))


@query
def year_quantity(spark, d):
    return _year_rows(spark, d)


@query
def year_map(spark, d):
    """The sums as a map a product, widened to columns at the end."""
    return years.widen_years(years.year_maps(_year_rows(spark, d)), _ship_years(spark, d))


@query
def class_map(spark, d):
    return years.first_class(_year_rows(spark, d))


@query
def year_pivot(spark, d):
    rows = _year_rows(spark, d)
    return years.pivot_years(rows, _ship_years(spark, d))


@query
def year_split(spark, d):
    return years.year_split(_year_rows(spark, d), _labels(spark, d), years=_ship_years(spark, d))


@query
def year_enriched(spark, d):
    rows = _year_rows(spark, d).drop("product_description")
    return years.enrich_year_rows(rows, _segments(spark, d))


@query
def year_fill(spark, d):
    rows = _year_rows(spark, d).drop("product_description")
    return years.fill_from_map(rows, _segments(spark, d), "product_number", "product_description")


@query
def year_split_export(spark, d):
    path = scratch_path(spark, "year-split")
    split = years.year_split(_year_rows(spark, d), _labels(spark, d), years=_ship_years(spark, d))
    files.export_by_class(split, path)
    return files.read_export(spark, path).drop("source_file")


@query
def replaced_class_export(spark, d):
    """An export of which one class is replaced by half of its rows."""
    path = scratch_path(spark, "replaced")
    split = years.year_split(_year_rows(spark, d), years=_ship_years(spark, d))
    files.export_by_class(split, path)
    half = split.filter((F.col("class4") == "Brand#3") & (F.length("product_number") % 2 == 0))
    files.export_by_class(half, path, replace="classes")
    return files.read_export(spark, path).drop("source_file")


@query
def csv_round_trip(spark, d):
    """A query's rows, written as CSV files and read back."""
    path = files.query_to_csv(spark, f"SELECT * FROM parquet.`{d}/nation.parquet`", scratch_path(spark, "csv"))
    return spark.read.schema(roles.SCHEMAS["nation"]).option("header", True).csv(path)


@query
def table_round_trip(spark, d):
    """Rows saved to a table twice, and what the catalog says of it."""
    name = f"saved_{uuid.uuid4().hex}"
    rows = roles.table(spark, d, "supplier").select("s_suppkey", "s_name")
    catalog.save_table(rows, name)
    catalog.save_table(rows, name, create_if_missing=False)
    info = catalog.table_info(spark, name)
    return catalog.read_table(spark, name).withColumns({"rows": F.lit(info["num_rows"]), "columns": F.lit(info["num_columns"])})


@query
def merge_exports(spark, d):
    """A year split and a spend table, written and stacked by name."""
    path = scratch_path(spark, "merge")
    split = years.year_split(_year_rows(spark, d), years=_ship_years(spark, d))
    spend = _spend(spark, d).withColumn(SPEND, F.col(SPEND).cast("double"))
    written = files.write_tables({"split": split, "spend": spend}, path)
    return files.merge_exports(spark, written).drop("source_file")


@query
def year_metrics(spark, d):
    return plain(years.year_metrics(roles.sales(spark, d), "product_number", _order_years(spark, d)))


@query
def year_totals(spark, d):
    metrics = years.year_metrics(roles.sales(spark, d), "product_number", _order_years(spark, d))
    prefixes = ["turnover_eur", "quantity_sold", "orders"]
    totals = years.year_totals(metrics, prefixes)
    return plain(totals.select("product_number", *[f"{p}_total" for p in prefixes]))


@query
def super_summary(spark, d):
    metrics = years.year_metrics(roles.sales(spark, d), "product_number", _order_years(spark, d))
    prefixes = ["turnover_eur", "margin_gross_eur", "orders"]
    return plain(years.summarize_totals(years.year_totals(metrics, prefixes), prefixes))


# --- Profiles ----------------------------------------------------------------------


@query
def null_profile(spark, d):
    return profile.null_profile(roles.purchases(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query
def describe(spark, d):
    return _rounded(profile.describe_column(roles.table(spark, d, "lineitem"), "l_extendedprice"))


@query
def describe_blocks(spark, d):
    """The same with finer blocks."""
    return _rounded(profile.describe_column(roles.table(spark, d, "lineitem"), "l_extendedprice", ranges=64))


def _counts(df: DataFrame) -> DataFrame:
    return df.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "rows")


@query
def histogram(spark, d):
    return _counts(profile.histogram(roles.table(spark, d, "lineitem"), "l_extendedprice"))


@query
def quantity_histogram(spark, d):
    return _counts(profile.histogram(roles.table(spark, d, "lineitem"), "l_quantity", fill=None))


@query
def top_vendors(spark, d):
    return plain(profile.top_groups(roles.purchases(spark, d), "crm_main_vendor", SPEND))


@query
def spend_by_product(spark, d):
    return plain(profile.top_groups(roles.part_purchases(spark, d), "product_number", SPEND, None))


@query
def top_spend(spark, d):
    spend = _spend(spark, d)
    return plain(profile.top_rows(spend, SPEND, ["product_number"], 15))


@query
def class_counts(spark, d):
    return profile.class_counts(roles.purchases(spark, d), "class2")


@query
def spend_trend(spark, d):
    keys = ["crm_main_group_vendor", "country_of_origin"]
    return plain(profile.spend_trend(roles.purchases(spark, d), keys, year_of(F.col("year_authorization")), SPEND))


@query
def class_country_matrix(spark, d):
    countries = attributes.distinct_values(roles.table(spark, d, "nation"), "n_name")
    return plain(profile.spend_matrix(roles.purchases(spark, d), "class4", "country_of_origin", SPEND, countries))


# --- Columns and text --------------------------------------------------------------


@query
def standardize_columns(spark, d):
    return plain(columns.standardize_columns(roles.purchases(spark, d)))


@query
def harmonize_columns(spark, d):
    rows = roles.table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand_name"),
        F.col("p_type").alias("brand_names"),
        F.col("p_name").alias("class3"),
        F.col("p_type").alias("class4"),
    )
    return columns.harmonize_columns(rows)


@query
def spend_column(spark, d):
    balance = F.when(F.col("c_acctbal") < 0, F.lit("credit")).otherwise(F.col("c_acctbal").cast("string"))
    rows = roles.table(spark, d, "customer").select("c_custkey", balance.alias("total_spend"))
    return columns.spend_column(rows)[0]


@query
def number_text(spark, d):
    """Texts that a cast would take for numbers, and numbers with odd spaces around."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("d", "f", "", "e1", " ")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    words = F.when(F.col("c_custkey") % 7 == 0, "Infinity").when(F.col("c_custkey") % 7 == 1, "NaN")
    value = F.coalesce(words, F.concat(F.col("c_nationkey").cast("string"), suffix))
    rows = roles.table(spark, d, "customer").select("c_custkey", value.alias("total_spend"))
    return columns.spend_column(rows)[0]


@query
def odd_space_scope(spark, d):
    """Classes in scope that stand between no-break and other spaces."""
    space = F.element_at(F.array(F.lit("\u00a0"), F.lit("\u2003\t"), F.lit("\u3000 ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    padded = roles.table(spark, d, "part").select("p_partkey", F.concat(space, "p_brand", space).alias("class4"))
    return padded.filter(text.in_scope(F.col("class4"), SCOPE)).select("p_partkey", text.trimmed(F.col("class4")).alias("class4"))


@query
def harmonize_mixed(spark, d):
    """Two columns of nearly one name, a number and a text."""
    rows = roles.table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("brand_name"), F.col("p_brand").alias("brand_names")
    )
    return columns.harmonize_columns(rows)


@query
def renamed_columns(spark, d):
    """Renaming, selecting what exists, resolving a name and a class column."""
    rows = columns.rename_columns(roles.table(spark, d, "part"), {"p_brand": "Class 3", "p_name": "item_name"})
    found = columns.select_existing(rows, ["p_partkey", "item_name", "absent", "Class 3"])
    name = resolve_column(found, ["missing", "Item Name"])
    return found.select("p_partkey", F.col(name).alias("name"), columns.class_column(found))


@query
def preprocess_report(spark, d):
    """What the preprocessed purchases miss, column by column."""
    return columns.preprocess_report(roles.purchases(spark, d))[1]


@query
def amount_text(spark, d):
    rows = roles.table(spark, d, "supplier").select("s_suppkey", "s_acctbal").union(
        roles.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    )
    formatted = rows.withColumn("formatted", text.amount_text(F.col("s_acctbal")))
    return formatted.withColumn("parsed", text.parse_amount(F.col("formatted"))).withColumn(
        "is_valid", text.is_valid_amount(F.col("formatted"))
    )


@query
def amount_validity(spark, d):
    """How many unit texts are valid, over every line item."""
    units = text.amount_text(F.col("l_quantity") * 100 - 2500, "units")
    valid = text.is_valid_amount(units, "units")
    rows = roles.table(spark, d, "lineitem").select(valid.alias("is_valid"), text.parse_amount(units, "units").alias("v"))
    return rows.groupBy("is_valid").agg(F.count("*").alias("rows"), F.sum("v").alias("total"))


@query
def safe_slug(spark, d):
    return roles.table(spark, d, "documents").select("doc_id", text.safe_slug(F.col("text")).alias("slug"))


@query
def class_code(spark, d):
    rows = roles.purchases(spark, d).withColumn("class2_code", text.class_code(F.col("class2")))
    return rows.groupBy("class2", "class2_code").agg(F.count("*").alias("rows"))


@query
def sales_brand_groups(spark, d):
    rows = roles.sales(spark, d).withColumn("brand_group", text.group_of(F.col("brand_type"), SALES_BRAND_GROUPS))
    return rows.groupBy("brand_type", "brand_group").agg(F.count("*").alias("rows"))


@query
def stacked_columns(spark, d):
    """Optional columns: frames with different columns brought to one schema."""
    wanted = {"key": "string", "name": "string", "balance": "double", "segment": "string"}
    customers = roles.table(spark, d, "customer").withColumnsRenamed(
        {"c_custkey": "key", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"}
    )
    suppliers = roles.table(spark, d, "supplier").withColumnsRenamed(
        {"s_suppkey": "key", "s_name": "name", "s_acctbal": "balance"}
    )
    return reduce(DataFrame.union, [columns.safe_columns(df, wanted) for df in (customers, suppliers)])
