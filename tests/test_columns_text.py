from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendloom.functions import names, numbers, text
from spendloom.operators import columns, profile


def values(spark, data, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "kind, data, expression, wanted",
    [
        ("string", ["2023", "2023-05-01", "2023-5-1", "2023xyz", "abcd", None], numbers.year_of, [2023] * 4 + [None, None]),
        ("string", [" 54 - Fasteners", "Fasteners", None], text.class_code, ["54", None, None]),
        ("string", ["\t6965 | Washers\n", None], text.normalised, ["6965 | washers", None]),
        ("string", ["taThreadDirection_", "taMaterial_40", "taHeadShape", "x_1"], text.attribute_key, ["ThreadDirection", "Material", "HeadShape", "x"]),
        ("string", ["ticGoldenItem-1", "ticItem-2", "3"], text.strip_id_prefix, ["1", "2", "3"]),
        ("string", [' a/b: "c"\t d__e ', "___", None], text.safe_slug, ["a_b_c_d_e", "", None]),
        ("double", [2.5, 3.5, None], numbers.round_to_int, [2, 4, 0]),
        ("string", ["1.5", "x", "nan", None], numbers.to_number, [1.5, 0.0, 0.0, 0.0]),
        ("double", [1234.5, -0.5, None], text.amount_text, ["1,234.50 EUR", "-0.50 EUR", "Invalid value"]),
        ("bigint", [1000000, 5], numbers.thousands, ["1,000,000", "5"]),
        ("string", ["1,234.50 EUR", "-1.00 EUR", "12 EUR", "1d EUR", "x", None], text.parse_amount, [1234.5, -1.0, 12.0, None, None, None]),
        ("string", ["1,234.50 EUR", "-1.00 EUR", "12 EUR", "1d EUR", "x", None], text.is_valid_amount, [True, False, True, False, False, None]),
        ("int", [7], text.with_suffix, ["7 EUR"]),
        ("string", [" ok ", " ", "\t", None], text.non_blank, ["ok", None, None, None]),
        ("string", ["M8 (x)", "Größe", ""], text.looks_latin, [True, False, False]),
    ],
)
def test_expressions(spark, kind, data, expression, wanted):
    assert values(spark, data, kind, expression) == wanted


def test_merge_text(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "a"), ("a", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.merge_text(F.col("a"), F.col("b"))).collect()] == ["a", "b", "a", "a | b", None]


def test_names():
    assert names.standard_name("purchase_amount_eur") == "Purchase Amount Eur"
    assert names.standard_names(["class3", "___", "year_2023"]) == ["Class3", "___", "Year 2023"]
    assert names.distinct_names(["a", "A", "a", "a__dup1"]) == ["a", "A__dup1", "a__dup2", "a__dup1__dup1"]
    assert names.distinct_names(["a", "A"], case_sensitive=True) == ["a", "A"]
    assert names.title_name("head__shape") == "Head Shape"
    assert names.key_of("Head outside diameter (width)") == "headoutsidediameterwidth"


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], "`Group Vendor` int, spend int")
    assert names.resolve_column(df, ["crm", "group_vendor"]) == "Group Vendor"
    assert names.resolve_column(df, ["Spend", "group vendor"]) == "spend"
    with pytest.raises(ValueError, match="Group Vendor"):
        names.resolve_column(df, ["nothing", "else"])
    with pytest.raises(ValueError):
        names.resolve_column(df, [])


def test_duplicate_columns_and_preprocess(spark):
    df = spark.createDataFrame([(1, 2, "x", None)], "a int, b int, vendor_name string, vendor_names string").toDF("a", "a", "vendor_name", "vendor_names")
    assert columns.distinct_columns(df).columns == ["a", "a__dup1", "vendor_name", "vendor_names"]
    prepared = columns.preprocess(df)
    assert prepared.columns == ["A", "A Dup1", "Vendor Name"]
    assert tuple(prepared.first()) == (1, 2, "x")


def test_level_columns_are_merged_only_for_parity(spark):
    df = spark.createDataFrame([(None, "l1", "c2", "c3")], "level0 string, level1 string, class2 string, class3 string")
    assert columns.harmonize_columns(df).columns == df.columns
    strict = columns.harmonize_columns(df, strict_parity=True)
    assert strict.columns == ["level0", "class2", "class3"]
    assert strict.first()["level0"] == "l1"


def test_safe_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    safe = columns.safe_columns(df, {"id": "string", "kind": "string"})
    assert safe.dtypes == [("id", "string"), ("kind", "string")]
    assert tuple(safe.first()) == ("1", None)
    assert columns.rename_columns(df, {"id": "key"}).columns == ["key", "name"]
    assert columns.select_existing(df, ["name", "other"]).columns == ["name"]


def test_spend_and_class_columns(spark):
    df = spark.createDataFrame([("12.5", None), ("x", "b")], "total_spend string, class2 string")
    numeric, name = columns.spend_column(df)
    assert name == "total_spend" and [r[0] for r in numeric.collect()] == [12.5, 0.0]
    assert [r[0] for r in df.select(columns.class_column(df)).collect()] == [None, "b"]
    assert df.select("total_spend").select(columns.class_column(df.select("total_spend"))).first()[0] == "Unknown"
    with pytest.raises(ValueError):
        columns.spend_column(df.select("class2"))


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 5.0), ("a", 3.0)], "k string, v double")
    assert {r[0]: r[1] for r in profile.null_profile(df).collect()} == {"k": 1, "v": 1}
    row = profile.describe_column(df, "v").first()
    assert (row["count"], row["mean"], row["std"], row["min"], row["p25"], row["max"]) == (3, 3.0, 2.0, 1.0, 2.0, 5.0)
    bins = profile.histogram(df, "v", 4, fill=None).orderBy("bin").collect()
    assert [r["rows"] for r in bins] == [1, 0, 1, 1]
    assert [r["rows"] for r in profile.histogram(df.filter("v = 1"), "v", 2).orderBy("bin").collect()] == [0, 1]
    assert profile.histogram(df.filter("v > 9"), "v").count() == 0
    assert [tuple(r) for r in profile.top_groups(df, "k", "v", 1).collect()] == [("a", 4.0)]
    assert [r["v"] for r in profile.top_rows(df, "v", ["k"], 2).collect()] == [5.0, 3.0]
    assert tuple(profile.class_counts(df, "k").first()) == ("a", 2)
    texts = spark.createDataFrame([("a", "x"), ("b", "2.5")], "k string, v string")
    assert [tuple(r) for r in profile.top_rows(texts, "v", ["k"], 2).collect()] == [("b", 2.5), ("a", 0.0)]
    assert [tuple(r) for r in profile.top_groups(texts, "k", "v").collect()] == [("b", 2.5), ("a", 0.0)]
