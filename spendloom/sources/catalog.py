"""Queries, table information and table writes through the session catalog."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Write dispositions and the Spark save modes they stand for.
SAVE_MODES = {
    "append": "append",
    "overwrite": "overwrite",
    "empty_only": "errorifexists",
}


def run_sql(spark: SparkSession, sql: str, args: dict[str, Any] | list | None = None) -> DataFrame:
    """Result of a query; names and values are passed as parameters. Errors are raised."""
    return spark.sql(sql, args=args)


def quick_query(sql: str, args: dict[str, Any] | list | None = None) -> DataFrame:
    """The same on the active session."""
    return run_sql(SparkSession.builder.getOrCreate(), sql, args)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def sample_table(spark: SparkSession, table: str, limit: int = 5) -> DataFrame:
    return spark.table(table).limit(limit)


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def list_databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def list_tables(spark: SparkSession, database: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def table_schema(spark: SparkSession, table: str) -> StructType:
    return spark.table(table).schema


def _files(spark: SparkSession, location: str | None):
    """Size and newest modification time of the files at a table's location, from their listing."""
    if not location:
        return None, None
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location)
    return listed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.max("modificationTime")).first()


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": table}).collect()
    return {r["col_name"]: r["data_type"] for r in rows}


def analyze_table(spark: SparkSession, table: str) -> None:
    """Count the rows of a table into the catalog; Spark forgets the count when it writes to the table."""
    spark.sql("ANALYZE TABLE IDENTIFIER(:t) COMPUTE STATISTICS", args={"t": table})


def _row_count(details: dict[str, str]) -> int | None:
    found = re.search(r"(\d+) rows", details.get("Statistics") or "")
    return int(found.group(1)) if found else None


def table_info(spark: SparkSession, table: str, *, analyze: bool = True) -> dict[str, Any]:
    """Rows, columns, size, creation and modification time, location and the schema of a table.

    The number of rows is the catalog's statistic, size and time of change are those of the listed files: no
    data is read. Where the catalog does not know the rows of a table they are counted into it once, or, with
    `analyze` off, are None. Views have neither rows nor size.
    """
    details = _described(spark, table)
    if analyze and _row_count(details) is None and details.get("Type") in ("MANAGED", "EXTERNAL"):
        analyze_table(spark, table)
        details = _described(spark, table)
    described, columns = spark.catalog.getTable(table), spark.catalog.listColumns(table)
    size, modified = _files(spark, details.get("Location"))
    return {
        "table": described.name,
        "database": ".".join(described.namespace or []),
        "num_rows": _row_count(details),
        "num_columns": len(columns),
        "size_bytes": size,
        "created": details.get("Created Time"),
        "modified": modified,
        "location": details.get("Location"),
        "schema": [
            {
                "name": c.name,
                "type": c.dataType,
                "mode": "NULLABLE" if c.nullable else "REQUIRED",
                "description": c.description,
            }
            for c in columns
        ],
    }


def create_database(spark: SparkSession, database: str) -> None:
    spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:d)", args={"d": database})


def save_table(df: DataFrame, table: str, mode: str = "append", create_if_missing: bool = True) -> bool:
    """Write a table; False when it is absent and must not be created."""
    spark = df.sparkSession
    if not create_if_missing and not table_exists(spark, table):
        return False
    df.write.mode(SAVE_MODES[mode]).saveAsTable(table)
    return True


def replace_table(df: DataFrame, table: str) -> DataFrame:
    """Create the table anew from `df` and read it back."""
    df.write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)
