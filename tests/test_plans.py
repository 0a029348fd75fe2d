from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from scans import scanned_rows

from spendloom.config import AttributeRule, EnrichmentScope, OrderScope, PurchaseScope
from spendloom.operators import attributes, years
from spendloom.plans import details, enrich, orders, products, purchases, segmentation

PURCHASE = (
    "product_number int, year_authorization int, crm_main_group_vendor string, class2 string, class4 string,"
    " brand_name string, purchase_amount_eur decimal(18,2), purchase_quantity double"
)


def purchase_frame(spark, *rows):
    base = {
        "product_number": 1,
        "year_authorization": 2022,
        "crm_main_group_vendor": "v",
        "class2": " 54 - Fasteners",
        "class4": "6965 | Washers\t",
        "brand_name": " Own ",
        "purchase_amount_eur": Decimal(10),
        "purchase_quantity": 2.0,
    }
    return spark.createDataFrame([tuple((base | row).values()) for row in rows], PURCHASE)


@pytest.fixture(scope="module")
def master(spark):
    """Company flags, products and companies: products 1 and 2 are active, 3 is not."""
    flags = [("i1", "c", "N"), ("i2", "c", "N"), ("i3", "c", "Y")]
    return [
        spark.createDataFrame(flags, "product_id string, company_id string, purchase_stop_ind string"),
        spark.createDataFrame([("i1", 1), ("i2", 2), ("i3", 3)], "product_id string, product_number int"),
        spark.createDataFrame([("c", "Acme one")], "company_id string, company_short_description string"),
    ]


def test_purchase_build(spark, master):
    fact = purchase_frame(
        spark,
        {},
        {"product_number": 3},
        {"class2": "60 - Other"},
        {"class4": "7008 | shims"},
        {"brand_name": "Else"},
        {"year_authorization": 2020},
        {"crm_main_group_vendor": None},
        {"product_number": 2},
    )
    brands = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x")], "product_number int, key_brand_identifier string")
    sales = spark.createDataFrame([(1, "b"), (1, "a")], "product_number int, sales_rounding string")
    built = purchases.build_purchases(fact, brands, *master, sales, PurchaseScope("own", "Acme"))
    assert built.columns == [*fact.columns, "key_brand_identifier", "purchase_stop_ind", "sales_rounding"]
    found = Counter((r["product_number"], r["key_brand_identifier"], r["sales_rounding"]) for r in built.collect())
    assert found == {("1", "x", "a"): 1, ("1", "y", "a"): 1, ("2", None, None): 1}


def test_purchase_build_drops_excluded_products(spark):
    text = purchase_frame(spark, {}).withColumn("product_number", F.lit("XP001"))
    assert purchases.scope_purchases(text, PurchaseScope("own", "Acme")).count() == 0
    assert purchases.scope_purchases(text, PurchaseScope("own", "Acme", exclude_product=None)).count() == 1


def order_inputs(spark, master):
    sales = spark.createDataFrame(
        [("o1", 2022, 1, "Global A"), ("o2", 2022, 1, "Odd"), (None, 2022, 1, "OE"), ("o3", 2019, 1, "OE"), ("o4", 2022, 3, "OE")],
        "order_number string, year_number int, product_number int, brand_type string",
    )
    items = spark.createDataFrame(
        [("ticGoldenItem-1", 1, "Hex Nut", "b1", "1", "Y", "s", "k"), ("ticGoldenItem-3", 3, "Nut", "b1", "1", "Y", "s", "k"), ("x", 2, "Nut", "b1", "1", None, "s", "k")],
        "id string, item_number int, item_description_eng string, key_brand_identifier string, rounding string,"
        " publishable_in_country string, item_segment string, key_class4_number string",
    )
    hierarchy = spark.createDataFrame(
        [("k", "Hex", "3", "Bolts & Nuts", "2", "54 - Fasteners")],
        "class4_number string, class4_description string, class3_number string, class3_description string,"
        " class2_number string, class2_description string",
    )
    brands = spark.createDataFrame([("b1", "(OTHER) Other")], "key_brand_identifier string, brand_type string")
    values = spark.createDataFrame(
        [("ticGoldenItem-1", "taLengthMm_5", "12.5"), ("ticGoldenItem-3", "taLengthMm_5", "bad")],
        "id string, attribute_id string, value string",
    )
    bought = purchase_frame(
        spark,
        {"year_authorization": 2021},
        {"year_authorization": 2022},
        {"year_authorization": 2022, "purchase_amount_eur": Decimal(5)},
    )
    return [sales, items, hierarchy, brands, values, *master, bought]


def test_order_build_by_year(spark, master):
    built = orders.build_orders(*order_inputs(spark, master), OrderScope("Acme")).collect()
    found = {(r["order_number"], r["purchase_year_authorization"]): (r["purchase_amount_eur"], r["purchase_rows"]) for r in built}
    assert found == {(o, y): v for o in ("o1", "o2") for y, v in ((2021, (10, 1)), (2022, (15, 2)))}
    first = next(r for r in built if r["order_number"] == "o1")
    assert (first["brand_type"], first["brand_type_step"]) == ("Global", "Other")
    assert first["dimension_per_product_type"] == Decimal("12.5")
    assert next(r for r in built if r["order_number"] == "o2")["brand_type"] is None


def test_order_build_by_class(spark, master):
    other = OrderScope("Acme", class2=("60 - Other",))
    assert orders.build_orders(*order_inputs(spark, master), other).count() == 0
    assert orders.build_orders(*order_inputs(spark, master), OrderScope("Acme", class2=())).count() == 4


def test_product_build(spark):
    rel = spark.createDataFrame([("ticGoldenItem-1",), ("ticGoldenItem-2",), (None,)], "product_id string")
    hierarchy = spark.createDataFrame([("ticGoldenItem-1", 7), ("ticGoldenItem-1", 8)], "golden_item_id string, brick_id int")
    values = spark.createDataFrame(
        [
            ("ticGoldenItem-1", "attItemNumber", " 77 "),
            ("ticGoldenItem-1", "a1", "Steel"),
            ("ticGoldenItem-1", "a1", "Сталь"),
            ("ticGoldenItem-1", "attUnit", " "),
            ("ticGoldenItem-2", "a2", "unlisted"),
            ("ticGoldenItem-2", "a3", "no name"),
            ("other-1", "a1", "Brass"),
        ],
        "id string, attribute_id string, value string",
    )
    meta = spark.createDataFrame(
        [("attItemNumber", "Item"), ("a1", "MATERIAL"), ("attUnit", "Unit"), ("a2", "Colour"), ("a3", None)],
        "id string, name_eng string",
    )
    built = products.build_products(rel, hierarchy, values, meta)
    assert len(built.columns) == 27
    found = Counter((r["product_id"], r["brick_id"], r["product_number"], r["material"], r["unit"]) for r in built.collect())
    assert found == {
        ("ticGoldenItem-1", "7", "77", "Steel", None): 1,
        ("ticGoldenItem-1", "8", "77", "Steel", None): 1,
        ("ticGoldenItem-2", None, None, None, None): 1,
    }
    plain = products.build_products(rel, spark.createDataFrame([("a",)], "golden_item_id string"), values, meta)
    assert plain.filter("brick_id IS NULL").count() == 2
    small = products.build_products_min(values, meta).collect()
    assert {(r["product_id"], r["product_number"], r["material"]) for r in small} == {
        ("ticGoldenItem-1", "77", "Steel"),
        ("ticGoldenItem-2", None, None),
    }


def test_enrich_removes_copies_and_lists_values(spark):
    fact = purchase_frame(spark, {}, {}, {"product_number": 2})
    values = spark.createDataFrame(
        [
            ("taMaterial", "1", "ENG", "b"),
            ("taMaterial_2", "1", "ENG", "a"),
            ("taMaterial_2", "1", "ENG", "b"),
            ("taMaterial_2", "1", "ENG", None),
            ("taMaterial_2", "1", "NLD", "c"),
            ("taSurfaceThreatment", "1", "ENG", "old"),
            ("taSurfaceTreatment_4", "1", "ENG", "new"),
            ("taHeadShape", "1", "ENG", None),
            ("taUnknown", "1", "ENG", "u"),
        ],
        "attribute_id string, item_number string, language_id string, value string",
    )
    built = {r["product_number"]: r for r in enrich.enrich_purchases(fact, values).collect()}
    assert len(built) == 2
    assert built["1"]["material"] == "a | b"
    assert built["1"]["surface_treatment"] == "new | old"
    assert built["1"]["head_shape"] is None and built["2"]["material"] is None
    scope = EnrichmentScope(language="NLD")
    assert enrich.attributes_per_product(values, scope).first()["material"] == "c"


def test_fetch_and_sample(spark):
    fact = purchase_frame(spark, {}, {}, {"class4": "nothing"}, {"product_number": 2, "purchase_amount_eur": Decimal(1)})
    keys = ["product_number", "class4"]
    fetched = purchases.fetch_purchases(fact, keys=keys).collect()
    assert [(r["product_number"], r["purchase_amount_eur"]) for r in fetched] == [(1, 20), (2, 1)]
    assert purchases.fetch_purchases(fact, keys=keys, limit=1).count() == 1
    assert purchases.scoped_sample(fact, limit=2).count() == 2
    assert purchases.fetch_super_table(fact, brand_name=[" Own "], limit=3).count() == 3


DETAIL = "product_number string, detail_name string, detail_value string"


def test_detail_strategies(spark):
    numbers = spark.createDataFrame([(" 1 ",), ("2",), ("1",), ("",), (None,)], "product_number string")
    enrichment = spark.createDataFrame([("1", " M8 ", None), ("9", "M9", "x")], "product_number string, size string, note string")
    assert Counter(map(tuple, details.fetch_details(numbers, enrichment).collect())) == {("1", "size", "M8"): 1}

    long = spark.createDataFrame(
        [("ticItem-1", "Unit", "pc"), ("1", "Unit", "box"), ("ticArticle-2", "Colour", "red"), ("ticItem-9", "Unit", "x")],
        "product_id string, attribute_name string, attribute_value string",
    )
    nothing = enrichment.filter("product_number = '9'")
    both = {("1", "Unit", "box"): 1, ("2", "Colour", "red"): 1}
    assert Counter(map(tuple, details.fetch_details(numbers, nothing, long).collect())) == both
    # each product takes the first source that has it
    assert Counter(map(tuple, details.fetch_details(numbers, enrichment, long).collect())) == {("1", "size", "M8"): 1, ("2", "Colour", "red"): 1}

    colours = long.filter("attribute_name = 'Colour'")
    assert Counter(map(tuple, details.fetch_details(numbers, None, colours).collect())) == {("2", "Colour", "red"): 1}
    assert details.fetch_details(numbers, None, colours, discover_names=False).count() == 0

    wide = spark.createDataFrame(
        [("ticGoldenItem-1", "steel", " "), ("ticItem-1", "brass", "6")],
        "product_id string, material string, head__height string",
    )
    assert Counter(map(tuple, details.fetch_details(numbers, None, wide).collect())) == {
        ("1", "Material", "brass"): 1,
        ("1", "Head height", "6"): 1,
    }
    assert details.fetch_details(numbers).columns == ["product_number", "detail_name", "detail_value"]


def test_blank_details_are_none(spark):
    numbers = spark.createDataFrame([("1",), ("2",), ("3",)], "product_number string")
    rows = [("1", "Unit", None), ("1", "Unit", "pcs"), ("2", "Unit", "  "), ("2", "Unit", "box"), ("3", "Unit", "\t"), ("3", "Odd", "x"), ("1", None, "y"), ("1", " ", "z")]
    long = spark.createDataFrame(rows, "product_id string, attribute_name string, attribute_value string")
    found = Counter(map(tuple, details.fetch_details(numbers, None, long).collect()))
    assert found == {("1", "Unit", "pcs"): 1, ("2", "Unit", "box"): 1, ("3", "Odd", "x"): 1}
    assert details.product_details(numbers, None, long).count() == 3
    known = details.fetch_details(numbers, None, long, discover_names=False)
    assert {r["product_number"] for r in known.collect()} == {"1", "2"}


def test_long_details_are_scanned_once(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 50).cast("string").alias("product_id"), F.lit("Unit").alias("attribute_name"), F.col("id").cast("string").alias("attribute_value"))
    rows.write.parquet(str(tmp_path / "long"))
    numbers = spark.createDataFrame([("1",), ("2",)], "product_number string")
    long = spark.read.parquet(str(tmp_path / "long"))
    before = scanned_rows(spark)
    assert len(details.product_details(numbers, None, long).collect()) == 2
    assert scanned_rows(spark) - before == 5000


def test_candidate_ids(spark):
    numbers = spark.createDataFrame([("1",), ("ticItem-1",), ("1",)], "product_number string")
    ids = [r[0] for r in attributes.candidate_ids(numbers).collect()]
    assert len(ids) == len(set(ids)) == 7 and "ticItem-1" in ids


def test_detail_pivot_keeps_products_with_unlisted_names(spark):
    df = spark.createDataFrame([("1", "Unit", "pc"), ("2", "Odd", "x"), ("3", "Unit", None)], DETAIL)
    rows = {r["product_number"]: r for r in attributes.pivot_details(df).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["Unit"] == "pc" and rows["2"]["Unit"] is None
    assert len(attributes.pivot_details(df).columns) == 25


def test_expected_attributes(spark):
    values = spark.createDataFrame(
        [("a", "b1", "n1"), ("a", "b2", "n1"), ("a", "b2", "n2"), ("x", "b1", "n1"), ("a", None, "n2")],
        "attribute_id string, brick_id string, classification_node_id string",
    )
    template = spark.createDataFrame(
        [("a", "b1", None), ("a", "b1", "n1"), ("a", None, "n1")],
        "attribute_id string, brick_id string, classification_node_id string",
    )
    assert Counter(map(tuple, attributes.expected_attributes(values, template).collect())) == {
        ("a", "b1", "n1"): 1,
        ("a", "b2", "n1"): 1,
    }
    assert attributes.expected_attributes(values, template.drop("classification_node_id")).count() == 1


def test_pivot_by_rules_and_limits(spark):
    values = spark.createDataFrame([("1", "x", "Size", "a"), ("1", "y", "Other", "b")], "id string, attribute_id string, name_eng string, value string")
    rules = [AttributeRule("size", ("size",)), AttributeRule("y", (), ("y",))]
    assert tuple(attributes.pivot_by_rules(values, ["id"], rules).first()) == ("1", "a", "b")
    assert attributes.distinct_values(values, "name_eng") == ["Other", "Size"]
    with pytest.raises(ValueError):
        attributes.distinct_values(values, "name_eng", 1)


YEARS = "product_number string, product_description string, class4 string, year int, purchase_quantity double"


def test_year_split(spark):
    rows = spark.createDataFrame(
        [
            (" 1", "d", "late", 2023, 1.25),
            ("1", "d", "early", 2022, 2.5),
            ("2", "d", None, 2022, 1.0),
            ("3", "d", "c", None, 1.0),
            ("4", "d", "first", None, 1.0),
            ("4", "d", "c", 2022, None),
            (None, "d", "c", 2022, 1.0),
        ],
        YEARS,
    )
    segments = spark.createDataFrame([("1 ", "A", "x"), ("1", "B", "w")], "product_number string, segmentation string, product_description string")
    split = years.year_split(rows, segments)
    assert split.columns == ["product_number", "product_description", "segmentation", "class4", "purchase_quantity_2022", "purchase_quantity_2023"]
    assert {tuple(r) for r in split.collect()} == {("1", "w", "B", "early", 2, 1), ("4", None, None, "first", 0, 0)}


def test_year_quantity_and_metrics(spark):
    fact = purchase_frame(spark, {}, {}, {"year_authorization": 2023}).withColumn("product_description", F.lit("d"))
    found = {(r["year"], r["purchase_quantity"]) for r in years.year_quantity(fact).collect()}
    assert found == {(2022, 4.0), (2023, 2.0)}
    pivoted = years.pivot_years(years.year_quantity(fact), [2022, 2024]).first()
    assert (pivoted["purchase_quantity_2022"], pivoted["purchase_quantity_2024"]) == (4.0, 0.0)
    lines = spark.createDataFrame(
        [("i", "o1", 2022, 1.0), ("i", "o1", 2022, 2.0), ("i", "o2", 2022, 3.0), ("i", "o2", 2023, 1.0)],
        "item string, order_number string, year_number int, turnover_euro double",
    )
    metrics = years.year_metrics(lines, "item")
    assert metrics.columns == ["item", "turnover_eur_2022", "orders_2022", "turnover_eur_2023", "orders_2023"]
    assert tuple(metrics.first()) == ("i", 6.0, 2, 1.0, 1)
    totals = years.year_totals(metrics, ["turnover_eur", "orders", "absent"])
    assert (totals.first()["turnover_eur_total"], totals.first()["orders_total"]) == (7.0, 3)
    assert tuple(years.summarize_totals(totals, ["turnover_eur", "absent"]).first()) == (1, 7.0)


def test_year_enrichment_fills_descriptions(spark):
    rows = spark.createDataFrame([("1", None, "c", 2022, 1.0), ("2", "own", "c", 2022, 1.0)], YEARS)
    segments = spark.createDataFrame([("1", "s1", "A"), ("2", "s2", "B")], "product_number string, product_description string, segmentation string")
    joined = {r["product_number"]: r for r in years.enrich_year_rows(rows, segments).collect()}
    assert joined["1"]["product_description"] == "s1" and joined["2"]["product_description"] == "own"
    assert joined["2"]["product_description_seg"] == "s2"


def test_report(spark, tmp_path):
    fact = purchase_frame(spark, {}, {"product_number": 2}, {"product_number": 2, "class4": "6900 | bolts"}).withColumn(
        "product_description", F.lit("d")
    )
    report = segmentation.segmentation_report(fact, classes=None)
    assert report["reconciliation"].first()["matches"]
    assert report["tiers"].count() == 3 and report["purchases"].count() == 5
    folders = segmentation.export_report(report, str(tmp_path / "out")).collect()
    assert {r["class4_slug"].rsplit("-", 1)[0] for r in folders} == {"6965_Washers", "6900_bolts"}


def test_staged_report_reads_purchases_three_times(spark, tmp_path):
    rows = [{"product_number": i % 40, "class4": f"c{i % 3}"} for i in range(400)]
    purchase_frame(spark, *rows, {"product_number": None}).withColumn("product_description", F.lit("d")).coalesce(1).write.parquet(str(tmp_path / "p"))
    fact = spark.read.parquet(str(tmp_path / "p"))
    rows = fact.count()
    plain = segmentation.segmentation_report(fact, classes=None, years=[2023])
    before = scanned_rows(spark)
    report = segmentation.staged_report(fact, str(tmp_path / "stage"), classes=None, years=[2023])
    segmentation.export_report(report, str(tmp_path / "out"))
    staged = sum(report[t].count() for t in ("product_spend", "tiers", "year_quantity"))
    assert scanned_rows(spark) - before <= 3 * rows + 4 * staged
    for name, df in plain.items():
        assert sorted(map(str, report[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name


def test_staged_report_of_nothing(spark, tmp_path):
    fact = purchase_frame(spark, {}).withColumn("product_description", F.lit("d"))
    for name, df in (("none", fact.limit(0)), ("filtered", fact.filter("product_number < 0")), ("keyless", fact.withColumn("class4", F.lit(None).cast("string")))):
        report = segmentation.staged_report(df, str(tmp_path / name), classes=None, years=[2022])
        assert report["tiers"].count() == report["summary"].count() == 0
        assert report["reconciliation"].first()["summary_total"] == 0
