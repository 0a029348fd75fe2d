"""Hot classes, close and equal numbers, hot keys: balance, and results that do not change."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from scans import scanned_rows

from spendloom.operators import attributes, joins, prefix, profile, tiers

MANY = 200_000


def one_class(spark, spend):
    ids = spark.range(MANY).select(F.lit("c").alias("class4"), F.concat(F.lit("000000item-"), "id").alias("product"), "id")
    return ids.withColumn("spend", F.expr(spend).cast("decimal(18,9)")).drop("id")


@pytest.mark.parametrize(
    "spend",
    ["10", f"10 + id / (100 * {MANY})", "exp(id % 1000 / 50)", "IF(id % 3 = 0, 5, id % 7)", "CAST(NULL AS INT)"],
    ids=["equal", "close", "spread", "third", "missing"],
)
def test_no_block_holds_much_of_a_class(spark, spend):
    df = one_class(spark, spend)
    placed = prefix.running_totals(df, ["class4"], "spend", "spend", ["product"], descending=True)
    sizes = placed.groupBy(prefix.BLOCK).count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert sizes[2] == MANY and sizes[0] < 0.02 * MANY and sizes[1] > 500


@pytest.mark.parametrize("ranges", [1, 3, 40, 1024])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_against_a_plain_window(spark, ranges, descending):
    rng = random.Random(ranges)
    rows = [(rng.choice("abb"), rng.choice([None, -2.5, 0.0, 3.25, rng.random()]), rng.choice(["x", "y", None, f"t{i}"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, t string, n long")
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    running = F.sum("n").over(W.partitionBy("g").orderBy(order, "t", "n").rowsBetween(W.unboundedPreceding, 0))
    plain = df.withColumns({"running": running, "total": F.sum("n").over(W.partitionBy("g"))})
    found = prefix.running_totals(df, ["g"], "v", "n", ["t", "n"], descending=descending, ranges=ranges).drop(prefix.BLOCK)
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_the_source_is_scanned_once(spark, tmp_path):
    one_class(spark, "id % 1000").write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    spend = tiers.product_spend(source.withColumn("d", F.lit("d")), "class4", "product", "d", "spend")
    df = tiers.tier_products(spend, "class4", "product", "spend")
    df.write.format("noop").mode("overwrite").save()
    before = scanned_rows(spark)
    df.write.format("noop").mode("overwrite").save()
    assert scanned_rows(spark) - before == MANY


def test_describe_of_close_values(spark):
    df = spark.range(10_001).select((1e9 + F.col("id") / 1e4).alias("v"))
    found = profile.describe_column(df, "v").first()
    assert (found["count"], found["min"], found["p50"], found["max"]) == (10_001, 1e9, 1e9 + 0.5, 1e9 + 1)
    assert found["mean"] == pytest.approx(1e9 + 0.5, abs=1e-6) and found["std"] == pytest.approx(0.28871, abs=1e-5)
    for rows, count in (([], 0), ([(None,)], 0), ([(4.0,)], 1)):
        r = profile.describe_column(spark.createDataFrame(rows, "v double"), "v").first()
        assert (r["count"], r["mean"], r["std"]) == (count, 4.0 if count else None, None)


def test_histogram_edges(spark):
    rows = lambda values: [(r["bin"], r["low"], r["high"], r["rows"]) for r in profile.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4, fill=None).orderBy("bin").collect()]
    assert rows([]) == [] and rows([None]) == []
    assert rows([2.0, 2.0]) == [(0, 1.5, 1.75, 0), (1, 1.75, 2.0, 0), (2, 2.0, 2.25, 2), (3, 2.25, 2.5, 0)]
    assert [r[3] for r in rows([0.0, 1.0, 2.0, 4.0])] == [1, 1, 1, 1]


def test_heavy_keys_are_found_and_spread(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    hot = joins.heavy_keys(left, "k").collect()
    assert len(hot) == 2 and sorted(r["salts"] for r in hot) == [5, 22]
    right = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("5", "c"), ("none", "d")], "k string, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain, found = left.join(right, "k", how), joins.skewed_join(left, right, "k", how, spread=["id"])
        assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert joins.heavy_keys(left.limit(0), "k").count() == 0


def test_hot_keys_of_two_columns_and_other_types(spark):
    left = spark.range(5000).select((F.col("id") % 2).cast("int").alias("a"), F.lit("x").alias("b"), "id")
    right = spark.createDataFrame([(0, "x", 1.5), (1, "y", 2.5)], "a bigint, b string, v double")
    plain, found = left.join(right, ["a", "b"], "left"), joins.skewed_join(left, right, ["a", "b"], spread=["id"], parts=8)
    assert sorted(map(str, found.select("id", "v").collect())) == sorted(map(str, plain.select("id", "v").collect()))


def test_pages_of_a_long_list(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"v{rng.randrange(900)}" * rng.choice([1, 1, 30])) for _ in range(3000)] + [("c", None), (None, "x"), ("d", "only")]
    df = spark.createDataFrame(rows, "k string, v string")
    pages = attributes.list_pages(df, ["k"], "v", 200).collect()
    longest = max(len(v) for _, v in rows if v)
    assert all(len(r["value_list"]) <= 200 + longest for r in pages) and len(pages) > 50
    whole = {r["k"]: r["value_list"] for r in attributes.list_values(df.dropna(), ["k"], "v").collect()}
    joined = {r["k"]: r["value_list"] for r in attributes.join_pages(attributes.list_pages(df, ["k"], "v", 200), ["k"]).collect()}
    assert joined == whole


def plan_of(df):
    return re.sub(r"#[0-9]+L?", "", df._jdf.queryExecution().optimizedPlan().toString())


def test_blocks_are_numbers_of_bounds_reached(spark):
    df = one_class(spark, "id % 1000").limit(5_000)
    key = prefix.order_key(["class4"], "spend", ["product"])
    for ranges in (1, 7, 16, 100):
        bounds = sorted(tuple(r) for r in df.select(prefix.range_bounds(df, key, ranges).alias("b")).first().b)
        found = prefix.with_blocks(df, key, ranges)
        assert len(bounds) == ranges and "lambda" not in plan_of(found)
        most = max(1, 4 ** math.ceil(math.log(ranges, 4))) if ranges > 1 else 4
        for r in found.select(key.alias("k"), prefix.BLOCK).sample(0.1, 3).collect():
            assert r[prefix.BLOCK] == min(sum(b <= tuple(r.k) for b in bounds), most - 1)


def test_pages_read_their_source_by_one_filter(spark):
    source = spark.range(100).selectExpr("IF(id % 9 = 0, NULL, concat('k', id % 5)) AS k", "IF(id % 7 = 0, NULL, CAST(id AS STRING)) AS v")
    filters = {line.split("Filter", 1)[1] for line in plan_of(attributes.list_pages(source, ["k"], "v", 20)).split("\n") if " Filter " in line and "page" not in line}
    assert len(filters) == 1
