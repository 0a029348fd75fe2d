from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from spendloom import session
from spendloom.operators.joins import salted_join, skewed_join
from spendloom.operators.lookups import any_value_per_key, brand_map, keep_first, stop_flag
from spendloom.operators.prefix import quantiles, running_totals
from spendloom.verification import roles


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    keys = [rng.choice(["hot", "hot", "hot", "a", "b", "c", None]) for _ in range(300)]
    left = spark.createDataFrame([(k, "y", i % 7) for i, k in enumerate(keys)], "k string, j string, v int")
    right = spark.createDataFrame(
        [("hot", "y", 1), ("hot", "y", 2), ("a", "y", 3), ("z", "y", 4), (None, "y", 5)], "k string, j string, w int"
    )
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", ["k", ["k", "j"]])
def test_salted_join_equals_plain_join(spark, sides, how, on):
    left, right = sides
    hot = spark.createDataFrame([("hot", "y", 4), ("none", "y", 9)], "k string, j string, salts int")
    plain = left.join(right, on, how)
    salted = salted_join(left, right, on, how, hot=hot, spread=["v"])
    assert salted.columns == plain.columns
    assert rows_of(salted) == rows_of(plain)


def test_shared_dir_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


@pytest.mark.parametrize("ranges", [1, 16])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, ranges, descending):
    rng = random.Random(3)
    numbers = [None, 0.0, -0.0, 1e-20, -1e-20, 1e20, 3.0, 3.5, -7.25]
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.choice(numbers + [rng.uniform(-9, 9)] * 9), i, rng.randint(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, n double, i int, v bigint")

    def place(row):
        n = row[1]
        return row[0], (n is None) == descending, 0 if n is None else -n if descending else n, row[2]

    run, totals, wanted = Counter(), Counter(), {}
    for g, _, i, v in sorted(rows, key=place):
        run[g] += v
        wanted[i] = run[g]
        totals[g] = run[g]
    found = running_totals(df, ["g"], "n", "v", ["i"], descending=descending, ranges=ranges).collect()
    assert {r["i"]: r["running"] for r in found} == wanted
    assert all(r["total"] == totals[r["g"]] for r in found)


@pytest.mark.parametrize("ranges", [1, 16])
def test_quantiles_interpolate(spark, ranges):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 4.0, None)], "v double")
    row = quantiles(df, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}, ranges=ranges).first()
    assert tuple(row) == (1.75, 2.0, 2.5, 4.0)


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "n")], "k string, o int, v string")
    assert rows_of(keep_first(df, ["k"], ["o"])) == Counter([("a", 1, "y"), ("b", None, "n")])
    assert rows_of(keep_first(df, ["k"], ["o"], last=True)) == Counter([("a", 2, "x"), ("b", None, "n")])


def test_stop_flag_is_n_if_any_company_says_so(spark):
    flags = [("1", "c1", "Y"), ("1", "c2", "N"), ("2", "c1", "Y"), ("2", "c2", "Y"), ("3", "c1", None), ("4", "c3", "N")]
    relation = spark.createDataFrame(flags, "product_id string, company_id string, purchase_stop_ind string")
    products = spark.createDataFrame([(str(i), f"n{i}") for i in range(1, 5)], "product_id string, product_number string")
    companies = spark.createDataFrame(
        [("c1", "Acme one"), ("c2", "Acme two"), ("c3", "Acmetric")], "company_id string, company_short_description string"
    )
    found = {r[0]: r[1] for r in stop_flag(relation, products, companies, "Acme").collect()}
    assert found == {"n1": "N", "n2": "Y", "n3": None}


def test_lookups(spark):
    brands = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "product_number int, key_brand_identifier string")
    bought = spark.createDataFrame([("1",), ("1",)], "product_number string")
    assert rows_of(brand_map(brands, bought)) == Counter([("1", "x"), ("1", "y")])
    assert rows_of(any_value_per_key(brands, "product_number", "key_brand_identifier")) == Counter([(1, "x"), (2, "z")])


def test_distinct_rows_of_hot_and_missing_keys_join_by_one_shuffle(spark, sides):
    left, right = sides
    twice = left.unionByName(left)
    joined = skewed_join(twice, right, ["k", "j"], spread=twice.columns, distinct=True)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert rows_of(joined) == rows_of(left.distinct().join(right, ["k", "j"], "left"))
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(k, j, v" not in re.sub(r"#[0-9]+L?", "", plan)


def test_suppliers_meet_the_lines_before_the_parts(spark):
    plan = roles.purchases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # printed from the top: the last join, its left side, then its right side
    tables = re.findall(r"Relation \[([a-z])_", plan)
    assert tables == ["l", "s", "n", "p"]
