"""Every query against its SQL, and that building a query starts no job."""

from __future__ import annotations

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from spendloom.verification.oracle import ORACLE
from spendloom.verification.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
#: Filters that leave nothing of the smallest tables.
NEED_LARGER = ("candidate_ids", "detail_fetch", "detail_fetch_wide", "detail_pivot", "detail_fetch_discovered", "detail_fetch_mixed", "detail_fetch_sparse")
#: Queries that must know values to name columns, write files or fit clusters.
NEED_JOBS = {
    "attributes_wide", "class_country_matrix", "csv_round_trip", "gmm_tiers", "kmeans_tiers", "merge_exports", "product_clusters",
    "replaced_class_export", "segmentation_report", "report_tables", "staged_report_tables", "super_summary", "table_round_trip",
    "year_map", "year_metrics", "year_pivot", "year_split", "year_groups", "year_split_export", "year_totals",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    sf, connection = (LARGER, connect(LARGER)) if name in NEED_LARGER else (SF, duck)
    assert difference(QUERIES[name](spark, sf), connection, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NEED_JOBS))
def test_building_a_query_starts_no_job(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"build {name}", name)
    QUERIES[name](spark, SF)
    assert not context.statusTracker().getJobIdsForGroup(f"build {name}")
    context.setJobGroup("after", "after")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["year_split", "year_metrics", "year_pivot"])
def test_years_come_from_one_column(spark, name, monkeypatch):
    """Naming the year columns reads the date alone, without a join."""
    from spendloom.operators import years

    asked = []
    monkeypatch.setattr(years, "distinct_values", lambda df, column, limit: asked.append(df.select(column)) or [1995, 1996])
    QUERIES[name](spark, SF)
    assert len(asked) == 1
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert len(asked[0]._jdf.queryExecution().executedPlan().collectLeaves().head().output().mkString(",").split(",")) == 1


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == [
        "class4",
        "product_number",
        "product_description",
        "purchase_amount_eur",
        "cum_share",
        "segmentation",
    ]
    assert df.count() > 0
