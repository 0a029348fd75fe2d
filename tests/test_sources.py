from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from scans import scanned_rows

from spendloom.operators.clustering import ProductClustering, gmm_tiers, kmeans_tiers
from spendloom.sources import catalog, files, named_queries


@pytest.fixture
def table(spark, request):
    name = f"db_{request.node.name.lower()}"
    catalog.create_database(spark, name)
    yield f"{name}.t"
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_catalog(spark, table):
    database = table.split(".")[0]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    assert not catalog.table_exists(spark, table)
    assert not catalog.save_table(df, table, create_if_missing=False)
    assert catalog.save_table(df, table)
    assert catalog.save_table(df, table, create_if_missing=False)
    assert catalog.table_exists(spark, table)
    assert database in catalog.list_databases(spark) and catalog.list_tables(spark, database) == ["t"]
    assert catalog.sample_table(spark, table, 3).count() == 3
    assert catalog.table_schema(spark, table).names == ["id", "name"]
    info = catalog.table_info(spark, table)
    assert (info["num_rows"], info["num_columns"], info["database"].split(".")[-1]) == (4, 2, database)
    assert info["size_bytes"] > 0 and info["created"] and info["modified"] and info["location"]
    assert info["schema"][0] == {"name": "id", "type": "int", "mode": "NULLABLE", "description": None}
    assert catalog.replace_table(df, table).count() == 2
    catalog.save_table(df, table, "overwrite")
    assert catalog.read_table(spark, table).count() == 2
    with pytest.raises(Exception):
        catalog.save_table(df, table, "empty_only")
    assert catalog.run_sql(spark, "SELECT * FROM IDENTIFIER(:t) WHERE id = :i", {"t": table, "i": 2}).count() == 1
    assert catalog.quick_query(f"SELECT count(*) AS n FROM {table}").first()["n"] == 2


def test_csv(spark, tmp_path):
    path = files.query_to_csv(spark, "SELECT 1 AS a, 'x' AS b", str(tmp_path / "q"), add_timestamp=False)
    assert path.endswith("q.csv")
    assert spark.read.option("header", True).csv(path).collect() == [("1", "x")]
    assert files.write_csv(spark.range(5), str(tmp_path / "q"), add_timestamp=False) == path
    assert spark.read.option("header", True).csv(path).count() == 5
    stamped = files.write_csv(spark.range(2), str(tmp_path / "r"))
    assert stamped != str(tmp_path / "r.csv") and spark.read.csv(stamped).count() >= 2


def test_export_and_merge(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("c", 3), (None, 4)], "class4 string, v int")
    folders = files.export_by_class(df, str(tmp_path / "one")).collect()
    assert {r["class4_slug"][:3] for r in folders} == {"a_b", "c"}
    assert all(r["folder"].endswith(f"class4_slug={r['class4_slug']}") for r in folders)
    other = spark.createDataFrame([("d", "w")], "class4 string, w string")
    files.write_tables({"two": other}, str(tmp_path))
    merged = files.merge_exports(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    found = {(r["class4"], r["v"], r["w"], r["source_export"]) for r in merged.collect()}
    assert found == {("a/b", 1, None, "one"), ("a/b", 2, None, "one"), ("c", 3, None, "one"), ("d", None, "w", "two")}
    assert merged.filter("source_file LIKE 'part-%'").count() == 4
    assert files.merge_exports(spark, []).count() == 0


def test_table_names():
    assert files.safe_table_name("a/b:c" + "x" * 40) == "a_b_c" + "x" * 40


def test_classes_that_look_alike_stay_apart(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("7", 2), ("a b", 3), ("a/b", 4)], "class4 string, v int")
    assert files.export_by_class(df, str(tmp_path / "x")).count() == 4
    found = files.read_export(spark, str(tmp_path / "x")).collect()
    assert {(r["class4"], r["v"]) for r in found} == {("007", 1), ("7", 2), ("a b", 3), ("a/b", 4)}
    assert {r["class4_slug"] for r in found if r["v"] < 3} == {"007", "7"}


def files_below(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("part-*") if "_manifest" not in str(f)}


def test_replacing_a_class_leaves_the_others_alone(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1), ("c+%", 2), ("d", 3), ("d", 4)], "class4 string, v int")
    path = tmp_path / "x"
    manifest = {r["class4_slug"]: r for r in files.export_by_class(df, str(path)).collect()}
    assert len(manifest) == 3 and all(r["files"] >= 1 and r["bytes"] > 0 and r["written"] for r in manifest.values())
    before = files_below(path)
    other = spark.createDataFrame([("d", 9), ("e", 5)], "class4 string, v int")
    again = {r["class4_slug"]: r for r in files.export_by_class(other, str(path), replace="classes").collect()}
    after = files_below(path)
    assert {f: t for f, t in before.items() if "slug=d" not in f}.items() <= after.items()
    assert not any("slug=d" in f for f in before.keys() & after.keys())
    slugs = {r["class4_slug"] for r in files.read_export(spark, str(path)).collect()}
    assert set(again) == slugs == set(manifest) | {"e"}
    found = {(r["class4"], r["v"]) for r in files.read_export(spark, str(path)).collect()}
    assert found == {("a b", 1), ("c+%", 2), ("d", 9), ("e", 5)}
    assert files.read_manifest(spark, str(path)).count() == 4
    assert files.export_by_class(other, str(path)).count() == 2 and files.read_export(spark, str(path)).count() == 2
    with pytest.raises(ValueError):
        files.export_by_class(df, str(path), replace="some")


def test_export_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "class4 string, v int")
    assert files.export_by_class(df, str(tmp_path / "x")).count() == 0
    files.export_by_class(spark.createDataFrame([("a", 1)], "class4 string, v int"), str(tmp_path / "x"))
    assert files.export_by_class(df, str(tmp_path / "x"), replace="classes").count() == 1


def test_table_information_reads_no_data(spark, table):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    catalog.save_table(df, table)
    assert catalog.table_info(spark, table, analyze=False)["num_rows"] is None
    assert catalog.table_info(spark, table)["num_rows"] == 100
    before = scanned_rows(spark)
    info = catalog.table_info(spark, table)
    assert info["num_rows"] == 100 and info["size_bytes"] > 0 and info["modified"]
    assert scanned_rows(spark) - before < 100
    catalog.save_table(df, table)
    assert catalog.table_info(spark, table)["num_rows"] == 200
    df.createOrReplaceTempView("a_view")
    found = catalog.table_info(spark, "a_view")
    spark.catalog.dropTempView("a_view")
    assert (found["num_rows"], found["num_columns"], found["size_bytes"]) == (None, 2, None)


def test_clashing_table_names(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_tables({"a/b": spark.range(1), "a:b": spark.range(1)}, str(tmp_path))


def test_named_queries(spark):
    assert "fetch_purchase_data" in named_queries.list_queries()
    with pytest.raises(KeyError, match="create_order_data"):
        named_queries.get_query("nothing")
    sample = named_queries.get_query("scoped_sample")
    df = spark.createDataFrame([("6965 | washers",), ("other",)], "class4 string")
    assert sample(df).count() == 1
    named_queries.register_query("mine", lambda d: d)
    assert named_queries.get_query("mine")(df) is df


@pytest.mark.parametrize("tiering", [kmeans_tiers, gmm_tiers])
def test_cluster_tiers_follow_spend(spark, tiering):
    rows = [(f"p{i}{j}", 10.0**i * (1 + j / 100)) for i in range(1, 6) for j in range(12)] + [("credit", -5.0), ("none", None)]
    df = spark.createDataFrame(rows, "product string, spend double")
    found = {r["product"]: (r["spend"], r["segmentation"]) for r in tiering(df, "spend").collect()}
    assert len(found) == 62
    assert found["credit"][1] == found["none"][1] == "E"
    by_spend = [label for spend, label in sorted((v for v in found.values() if v[0]), reverse=True)]
    assert by_spend == sorted(by_spend)


def test_clustering_chooses_k(spark):
    rows = [(i, float(i % 2) * 100 + i / 50, float(i % 2) * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, spend double, quantity double")
    clustering = ProductClustering(["spend", "quantity"], candidates=(2, 3))
    clustered = clustering.run(df)
    assert clustered.count() == 40 and set(clustering.scores) == {2, 3}
    assert clustered.select("cluster").distinct().count() == 2
