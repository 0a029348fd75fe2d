"""File exports and reading them back."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spendloom.functions.text import safe_slug
from spendloom.sources.catalog import run_sql


def write_csv(df: DataFrame, path: str, add_timestamp: bool = True) -> str:
    """Write CSV files with a header below `path`, which is returned as used; what stood there is replaced."""
    target = f"{path}_{datetime.now():%Y%m%d_%H%M%S_%f}.csv" if add_timestamp else f"{path}.csv"
    df.write.mode("overwrite").option("header", True).csv(target)
    return target


def query_to_csv(spark: SparkSession, sql: str, path: str, add_timestamp: bool = True) -> str:
    return write_csv(run_sql(spark, sql), path, add_timestamp)


def safe_table_name(name: str) -> str:
    return name.replace(":", "_").replace("/", "_")


def write_tables(tables: Mapping[str, DataFrame], path: str, file_format: str = "parquet") -> list[str]:
    """Write each table to its own folder below `path`; returns the folders."""
    names = [safe_table_name(n) for n in tables]
    if len(set(names)) < len(names):
        raise ValueError(f"table names are not distinct as folder names: {names}")
    written = []
    for name, df in zip(names, tables.values()):
        target = f"{path}/{name}"
        df.write.mode("overwrite").option("header", True).format(file_format).save(target)
        written.append(target)
    return written


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder, from its listing: no file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def export_by_class(
    df: DataFrame, path: str, class_col: str = "class4", file_format: str = "parquet", *, replace: str = "all"
) -> DataFrame:
    """Write one folder per class in a single job; returns the manifest of the export.

    Rows are gathered by class before the write so that small classes get one
    file; a large class is split again by the adaptive planner instead of
    being written by one task. With `replace="classes"` only the classes of `df` are
    replaced and the files of all others stay as they are. The manifest, also kept in
    the export's folder `_manifest`, has a row per class: its slug, folder, files, bytes and when it was
    last written; it comes from the listing, so nothing that was written is read again.
    """
    if replace not in ("all", "classes"):
        raise ValueError(f"replace is 'all' or 'classes', not {replace!r}")
    slug = f"{class_col}_slug"
    text = F.col(class_col).cast("string")
    # classes with one slug get folders of their own
    distinct_slug = F.when(safe_slug(text) == text, text).otherwise(F.concat(safe_slug(text), F.lit("-"), F.hex(F.crc32(text))))
    named = df.filter(text.isNotNull()).withColumn(slug, distinct_slug)
    writer = named.hint("rebalance", F.col(slug)).write.mode("overwrite").option("header", True)
    overwritten = "dynamic" if replace == "classes" else "static"
    writer.option("partitionOverwriteMode", overwritten).partitionBy(slug).format(file_format).save(path)
    return _write_manifest(df.sparkSession, path, slug)


def _write_manifest(spark: SparkSession, path: str, slug: str) -> DataFrame:
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    # as in the names of partition folders, where a plus sign is no space
    value = F.url_decode(F.replace(F.regexp_extract("folder", f"/{slug}=([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    files = list_files(spark, path).withColumn("folder", folder).withColumn(slug, value)
    manifest = files.groupBy(slug, "folder").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("written")
    )
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an export by class."""
    return spark.read.parquet(f"{path}/_manifest")


def read_export(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Rows of an export with the file each one comes from."""
    reader = spark.read.option("header", True).format(file_format)
    schema = reader.load(path).schema
    # slugs are text, also where they look like numbers
    fields = [StructField(f.name, StringType()) if f.name.endswith("_slug") else f for f in schema]
    rows = reader.schema(StructType(fields)).load(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def merge_exports(spark: SparkSession, paths: list[str], file_format: str = "parquet") -> DataFrame:
    """Stack exports by column name, NULL where one lacks a column.

    `source_file` and `source_export` tell where a row comes from.
    """
    if not paths:
        empty = StructType([StructField(c, StringType()) for c in ("source_file", "source_export")])
        return spark.createDataFrame([], empty)
    merged = None
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        part = read_export(spark, path, file_format).withColumn("source_export", F.lit(name))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged
