"""The test tables in the roles of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Schemas of the test tables, so that reading one starts no job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

#: What tells the line items of a part, supplier, order or customer apart.

_PRODUCT = "CAST(l_partkey AS STRING)"
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_FLAG = "IF(l_shipdate >= TIMESTAMP_NTZ '2001-09-01', 'N', 'Y')"
_BRAND_NUMBER = "CAST(substring(p_brand, 7) AS INT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return df


def _by_line(values: dict[int, str]) -> str:
    arms = " ".join(f"WHEN {number} THEN '{value}'" for number, value in values.items())
    return f"CASE l_linenumber {arms} END"


def lines_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part; a part may hold most lines."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "inner")


def purchase_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase rows: line items with part, supplier and nation."""
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    # the small tables first and one by one: their sizes are known then, and if one is shuffled, the lines are still narrow
    lines = table(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey", "inner").join(nations, "s_nationkey", "inner")
    rows = lines.join(parts, "l_partkey", "inner")
    return rows.selectExpr(
        "year(l_shipdate) AS year_authorization",
        "CAST(l_suppkey AS STRING) AS uniquevendorcode",
        "l_linestatus AS warehouse",
        f"{_PRODUCT} AS product_number",
        "p_name AS product_description",
        f"{_PRICE} AS purchase_amount_eur",
        "l_quantity AS purchase_quantity",
        "s_name AS crm_main_vendor",
        "nullif(n_name, 'NATION_7') AS crm_main_group_vendor",
        "concat(' ', p_size DIV 10, ' - ', p_type) AS class2",
        "p_type AS class3",
        "p_brand AS class4",
        "concat(' ', upper(split_part(p_name, ' ', 1)), '\t') AS brand_name",
        "l_returnflag AS brand_type",
        "n_name AS country_of_origin",
        f"{_FLAG} AS _flag",
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase rows with their stop flag."""
    return purchase_raw(spark, sf_dir).withColumnRenamed("_flag", "purchase_stop_ind")


def purchase_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase rows as the build reads them, without a stop flag."""
    return purchase_raw(spark, sf_dir).drop("_flag")


def part_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase rows with the columns the tiering needs, nothing joined but parts."""
    return lines_with_parts(spark, sf_dir).selectExpr(
        "p_brand AS class4",
        f"{_PRODUCT} AS product_number",
        "p_name AS product_description",
        f"{_PRICE} AS purchase_amount_eur",
    )


def part_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, summed per part before the parts are joined: no part is hot any more."""
    totals = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("l_partkey AS p_partkey", f"{_PRICE} AS price")
        .groupBy("p_partkey")
        .agg({"price": "sum"})
    )
    return totals.join(table(spark, sf_dir, "part"), "p_partkey").selectExpr(
        "p_brand AS class4",
        "CAST(p_partkey AS STRING) AS product_number",
        "p_name AS product_description",
        "`sum(price)` AS purchase_amount_eur",
    )


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances, some negative, by nation."""
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey", "inner").selectExpr(
        "n_name AS class4", "CAST(c_custkey AS STRING) AS product_number", "c_acctbal AS balance"
    )


def brands_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product to brand id; every fifth size has a second brand id."""
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS product_number",
        "explode(IF(p_size % 5 = 0, array(p_brand, p_brand || '-B'), array(p_brand))) AS key_brand_identifier",
    )


def company_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{_PRODUCT} AS product_id", "CAST(l_suppkey AS STRING) AS company_id", f"{_FLAG} AS purchase_stop_ind"
    )


def product_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS product_id", "CAST(p_partkey AS STRING) AS product_number"
    )


def company_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS company_id",
        "IF(s_nationkey < 20, 'Acme ', 'Other ') || s_name AS company_short_description",
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines: line items with order and customer."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "l_orderkey", "o_custkey": "c_custkey"})
    lines = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey", "inner")
    rows = lines.join(table(spark, sf_dir, "customer"), "c_custkey", "inner")
    brand_type = _by_line(
        {
            1: "Global A",
            2: "Local B",
            3: "OE",
            4: "Private label C",
            5: "Non branded",
            6: "Unknown type",
        }
    )
    turnover = f"CAST({_PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))"
    return rows.selectExpr(
        "IF(o_orderpriority != '5-LOW', CAST(l_orderkey AS STRING), NULL) AS order_number",
        f"{turnover} AS turnover_euro",
        f"CAST({turnover} - CAST({_PRICE} / 2 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS margin_euro",
        f"{_PRICE} AS list_price_turnover_euro",
        "l_quantity AS quantity_sold",
        "CAST(c_custkey AS STRING) AS customer_id",
        "c_mktsegment AS segment",
        f"{_PRODUCT} AS product_number",
        "l_linenumber AS line_number",
        "year(o_orderdate) AS year_number",
        f"{brand_type} AS brand_type",
    )


def rounding_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales rows as far as the rounding lookup needs them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{_PRODUCT} AS product_number", "CAST(l_linenumber % 3 AS STRING) AS sales_rounding"
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('ticGoldenItem-', p_partkey) AS id",
        "CAST(p_partkey AS STRING) AS item_number",
        "p_name AS item_description_eng",
        "p_brand AS key_brand_identifier",
        "CAST(p_size % 3 AS STRING) AS rounding",
        "IF(p_size % 7 != 0, 'Y', NULL) AS publishable_in_country",
        "p_type AS item_segment",
        "p_brand AS key_class4_number",
    )


def class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = _BRAND_NUMBER
    return table(spark, sf_dir, "part").select("p_brand").distinct().selectExpr(
        "p_brand AS class4_number",
        "'Class ' || p_brand AS class4_description",
        f"CAST({number} % 2 AS STRING) AS class3_number",
        f"IF({number} % 2 = 0, 'Bolts & Nuts', 'Washers') AS class3_description",
        f"CAST({number} % 3 AS STRING) AS class2_number",
        f"IF({number} % 3 != 0, '54 - Fasteners', '60 - Other') AS class2_description",
    )


def item_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().selectExpr(
        "p_brand AS key_brand_identifier",
        f"CASE {_BRAND_NUMBER} % 5 WHEN 0 THEN '(GLOBAL_A) Global A' WHEN 1 THEN '(LOCAL_B) Local B' WHEN 2 THEN 'OE'"
        " WHEN 3 THEN '(PRIVATE-LABEL-B) Private label B' END AS brand_type",
    )


def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One length or weight per part, not a number where the size is a multiple of 9."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('ticGoldenItem-', p_partkey) AS id",
        "IF(p_size % 2 = 0, 'taLengthMm_5', 'attWeight') AS attribute_id",
        "IF(p_size % 9 = 0, 'n/a', p_size || '.5') AS value",
    )


def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-attribute-value rows: one per line item, some blank or not Latin."""
    attribute = _by_line(
        {
            1: "attItemNumber",
            2: "attUnit",
            3: "taMat_3",
            4: "taLen_4",
            5: "attThreadType",
            6: "taThread_6",
            7: "attOther",
        }
    )
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(IF(l_discount = 0, '', 'ticGoldenItem-'), l_partkey) AS id",
        f"{attribute} AS attribute_id",
        """CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'Ж' || l_returnflag
                WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN '   '
                ELSE concat(' ', l_returnflag, CAST(l_quantity AS INT)) END AS value""",
    )


def attribute_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute names, numbered like the nations; one in use has no name."""
    return table(spark, sf_dir, "nation").selectExpr(
        """CASE n_nationkey WHEN 1 THEN 'attItemNumber' WHEN 2 THEN 'attUnit' WHEN 3 THEN 'taMat_3'
           WHEN 4 THEN 'taLen_4' WHEN 5 THEN 'attThreadType' WHEN 6 THEN 'taThread_6' WHEN 7 THEN 'attOther'
           ELSE 'att' || n_nationkey END AS id""",
        """CASE n_nationkey WHEN 1 THEN 'Item number' WHEN 2 THEN 'Unit' WHEN 3 THEN 'Material' WHEN 4 THEN 'LENGTH'
           WHEN 5 THEN NULL WHEN 6 THEN 'Thread diameter' WHEN 7 THEN 'Other' ELSE n_name END AS name_eng""",
    )


def product_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('ticGoldenItem-', p_partkey) AS product_id", "p_name AS wholesale_name"
    )


def product_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of all products but promotions; no node column."""
    return table(spark, sf_dir, "part").filter("p_type != 'PROMO'").selectExpr(
        "concat('ticGoldenItem-', p_partkey) AS golden_item_id", "p_brand AS brick_id"
    )


def attribute_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attribute is expected where: brick or node, one of them per row."""
    pairs = lines_with_parts(spark, sf_dir).select("l_linenumber", "p_brand", "p_type").distinct()
    attribute = "concat('att', l_linenumber) AS attribute_id"
    none = "CAST(NULL AS STRING)"
    by_brick = pairs.filter(f"l_linenumber * 3 <= {_BRAND_NUMBER}").selectExpr(
        attribute, "p_brand AS brick_id", f"{none} AS classification_node_id"
    )
    by_node = pairs.filter("l_linenumber > length(p_type)").selectExpr(
        attribute, f"{none} AS brick_id", "p_type AS classification_node_id"
    )
    return by_brick.union(by_node).distinct()


def placed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute values with brick and node of their product."""
    return lines_with_parts(spark, sf_dir).selectExpr(
        "l_orderkey AS row_id",
        f"{_PRODUCT} AS product_id",
        "concat('att', l_linenumber) AS attribute_id",
        "IF(p_type != 'PROMO', p_brand, NULL) AS brick_id",
        "p_type AS classification_node_id",
    )


def local_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localised attribute values: one per line item, two languages."""
    attribute = _by_line(
        {
            1: "taHeadShape",
            2: "taMaterial_2",
            3: "taMaterial_40",
            4: "taSurfaceThreatment_11",
            5: "taSurfaceTreatment_4",
            6: "taThreadType_",
            7: "taOther",
        }
    )
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{attribute} AS attribute_id",
        f"{_PRODUCT} AS item_number",
        "IF(l_linestatus = 'F', 'ENG', 'NLD') AS language_id",
        "IF(l_quantity != 13, concat(l_returnflag, CAST(l_quantity AS INT) % 5), NULL) AS value",
    )


def local_attribute_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes alone, from the one column that tells them."""
    return local_attributes(spark, sf_dir).select("attribute_id")


def wide_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with one column per attribute, some blank."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('ticGoldenItem-', p_partkey) AS product_id",
        "IF(p_size % 4 = 0, ' ', ' ' || p_type) AS material",
        "IF(p_size % 3 != 0, p_size, NULL) AS head_height",
        "p_name AS din_standard",
        "p_brand AS brand__name",
    )


def long_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product details in long form: one per line item."""
    name = _by_line(
        {
            1: "Unit",
            2: "Material",
            3: "Head shape",
            4: "Length",
            5: "Colour",
            6: "Colour",
            7: "Finish",
        }
    )
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(IF(l_partkey % 2 = 0, 'ticArticle-', 'ticGoldenItem-'), l_partkey) AS product_id",
        f"{name} AS attribute_name",
        "concat(' ', l_returnflag, CAST(l_quantity AS INT)) AS attribute_value",
    )


def detail_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product numbers asked for: every part bought from a supplier in debt."""
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").selectExpr("s_suppkey AS l_suppkey")
    bought = table(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey", "left_semi")
    return bought.selectExpr(f"' ' || {_PRODUCT} AS product_number")
