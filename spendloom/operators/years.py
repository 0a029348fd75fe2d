"""Quantities and other measures by year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.config import CLASS_SCOPE
from spendloom.functions.numbers import round_to_int, to_number, year_of
from spendloom.functions.text import in_scope, trimmed
from spendloom.operators.attributes import distinct_values
from spendloom.operators.lookups import keep_first

#: Most year columns a discovered pivot may get, unless its caller sets another limit.
MAX_YEARS = 200


def year_quantity(
    purchases: DataFrame,
    classes: Sequence[str] | None = CLASS_SCOPE,
    year_col: str = "year_authorization",
) -> DataFrame:
    """Quantity per (product, class, year), with the smallest description.

    Summed per description first: that can be done by hashing, while a minimum
    of texts makes Spark sort its input, here only the sums.
    """
    scoped = purchases if classes is None else purchases.filter(in_scope(F.col("class4"), list(classes)))
    return (
        scoped.withColumn("year", year_of(F.col(year_col)))
        .groupBy("product_number", "class4", "year", "product_description")
        .agg(F.sum("purchase_quantity").alias("purchase_quantity"))
        .groupBy("product_number", "class4", "year")
        .agg(
            F.min("product_description").alias("product_description"),
            F.sum("purchase_quantity").alias("purchase_quantity"),
        )
        .select("product_number", "product_description", "class4", "year", "purchase_quantity")
    )


def first_class(year_rows: DataFrame) -> DataFrame:
    """Class of each product in its earliest year (a missing year counts as earliest).

    The smallest (year, class) pair, so it is reduced before the shuffle.
    """
    earliest = F.min(F.struct("year", "class4"))
    return year_rows.groupBy("product_number").agg(earliest.getField("class4").alias("class4"))


def _sum_in_year(value_col: str, year_col: str, year: int) -> str:
    return f"sum(IF(`{year_col}` = {int(year)}, `{value_col}`, NULL))"


def known_years(source: DataFrame, year: str | Column = "year", limit: int = MAX_YEARS) -> list[int]:
    """The years of a table, in order; raises beyond `limit`.

    Give the table that the years come from, before it is joined or summed, and the expression of the year:
    then only the year's own column is read. Years of rows that are filtered later give columns of zeros.
    """
    return distinct_values(source, year, limit)


def pivot_years(
    year_rows: DataFrame,
    years: Sequence[int],
    key: str = "product_number",
    year_col: str = "year",
    value_col: str = "purchase_quantity",
    label: str = "purchase_quantity",
) -> DataFrame:
    """One row per key and a summed column per year, 0 where there is none."""
    return (
        year_rows.dropna(subset=[key, year_col])
        .groupBy(key)
        .agg(*[F.expr(f"coalesce({_sum_in_year(value_col, year_col, y)}, 0)").alias(f"{label}_{y}") for y in years])
    )


def year_maps(
    year_rows: DataFrame, key: str = "product_number", year_col: str = "year", value_col: str = "purchase_quantity"
) -> DataFrame:
    """One row per key with `by_year`, a map from year to sum; no year has to be known.

    `widen_years` turns the map into columns. A key has as many entries as years.
    """
    sums = year_rows.dropna(subset=[key, year_col]).groupBy(key, year_col).agg(F.sum(value_col).alias("_sum"))
    entries = F.array_sort(F.collect_list(F.struct(year_col, "_sum")))
    return sums.groupBy(key).agg(F.map_from_entries(entries).alias("by_year"))


def widen_years(maps: DataFrame, years: Sequence[int], label: str = "purchase_quantity") -> DataFrame:
    """The map `by_year` as a column per year, 0 where there is none."""
    kept = [c for c in maps.columns if c != "by_year"]
    value = lambda y: F.coalesce(F.try_element_at("by_year", F.lit(int(y))), F.lit(0))
    return maps.select(*kept, *[value(y).alias(f"{label}_{y}") for y in years])


def year_split(
    year_rows: DataFrame,
    segments: DataFrame | None = None,
    *,
    years: Sequence[int] | None = None,
    limit: int = MAX_YEARS,
    label: str = "purchase_quantity",
    segment_cols: Sequence[str] = ("product_description", "segmentation", "sales_rounding"),
) -> DataFrame:
    """One row per product: segment columns, class, and a whole quantity per year.

    Products are compared by trimmed text. Products without a class are left
    out. Of several segment rows for a product the smallest is used. Without
    `years` all of `year_rows` is computed once more to find them; `known_years`
    finds them in the source.
    """
    years = known_years(year_rows, limit=limit) if years is None else sorted(years)
    rows = year_rows.withColumns(
        {
            "product_number": trimmed(F.col("product_number").cast("string")),
            "purchase_quantity": to_number(F.col("purchase_quantity"), None),
        }
    )
    result = (
        rows.dropna(subset=["product_number"])
        .groupBy("product_number")
        .agg(
            F.count("year").alias("_years"),
            F.min(F.struct("year", "class4")).getField("class4").alias("class4"),
            *[round_to_int(F.expr(_sum_in_year("purchase_quantity", "year", y))).alias(f"{label}_{y}") for y in years],
        )
        .filter((F.col("_years") > 0) & F.col("class4").isNotNull())
        .drop("_years")
    )
    present = [c for c in segment_cols if segments is not None and c in segments.columns]
    if present:
        per_product = keep_first(
            segments.select(trimmed(F.col("product_number").cast("string")).alias("product_number"), *present),
            ["product_number"],
            present,
        )
        result = result.join(per_product, "product_number", "left")
    return result.select("product_number", *present, "class4", *[f"{label}_{y}" for y in years])


def enrich_year_rows(year_rows: DataFrame, segments: DataFrame, suffix: str = "_seg") -> DataFrame:
    """Year rows with the segment columns of their product.

    Columns both sides have get the suffix on the segment side; a missing
    description is filled from there.
    """
    clashes = {c: c + suffix for c in segments.columns if c in year_rows.columns and c != "product_number"}
    joined = year_rows.join(segments.withColumnsRenamed(clashes), "product_number", "left")
    return fill_missing(joined, "product_description", "product_description" + suffix)


def fill_missing(df: DataFrame, column: str, source: str) -> DataFrame:
    """Fill a column from another one; take that one over when the column is absent."""
    if source not in df.columns:
        return df
    filled = F.coalesce(F.col(column), F.col(source)) if column in df.columns else F.col(source)
    return df.withColumn(column, filled)


def fill_from_map(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a column, or add it, from a key -> value table; of several values the largest."""
    values = lookup.dropna(subset=[key]).groupBy(key).agg(F.max(column).alias("_mapped"))
    joined = df.join(values, key, "left")
    return fill_missing(joined, column, "_mapped").drop("_mapped")


def year_metrics(
    order_lines: DataFrame,
    item_col: str,
    years: Sequence[int] | None = None,
    *,
    year_col: str = "year_number",
    order_col: str = "order_number",
    limit: int = MAX_YEARS,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Yearly sums and number of orders per item, one column per measure and year.

    `sums` maps a source column to the prefix of its year columns. Orders are
    counted from rows reduced to (item, year, order) first. Without `years` the
    order lines are computed once more to find them; `known_years` finds them in
    the source.
    """
    if sums is None:
        sums = {
            "turnover_euro": "turnover_eur",
            "quantity_sold": "quantity_sold",
            "margin_euro": "margin_gross_eur",
            "list_price_turnover_euro": "list_price_turnover_eur",
        }
    sums = {source: prefix for source, prefix in sums.items() if source in order_lines.columns}
    years = known_years(order_lines, year_col, limit) if years is None else sorted(years)
    per_order = (
        order_lines.dropna(subset=[item_col, year_col])
        .groupBy(item_col, year_col, order_col)
        .agg(*[F.sum(source).alias(source) for source in sums])
    )
    columns = []
    for y in years:
        columns += [
            F.expr(f"coalesce({_sum_in_year(source, year_col, y)}, 0)").alias(f"{prefix}_{y}")
            for source, prefix in sums.items()
        ]
        columns.append(F.expr(f"count(IF(`{year_col}` = {int(y)}, `{order_col}`, NULL))").alias(f"orders_{y}"))
    return per_order.groupBy(item_col).agg(*columns)


def year_columns(df: DataFrame, prefix: str) -> list[str]:
    """The columns `<prefix>_YYYY` of a frame, by year."""
    return sorted(c for c in df.columns if c.startswith(f"{prefix}_") and c[len(prefix) + 1 :].isdigit())


def year_column_groups(df: DataFrame, prefixes: Sequence[str]) -> dict[str, list[str]]:
    """For each measure the frame has by year, its year columns."""
    groups = {prefix: year_columns(df, prefix) for prefix in prefixes}
    return {prefix: found for prefix, found in groups.items() if found}


def year_totals(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Add `<prefix>_total`, the sum over the year columns of each prefix."""
    totals = {}
    for prefix in prefixes:
        columns = year_columns(df, prefix)
        if columns:
            total = F.lit(0)
            for c in columns:
                total = total + F.coalesce(F.col(c), F.lit(0))
            totals[f"{prefix}_total"] = total
    return df.withColumns(totals) if totals else df


def summarize_totals(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """One row: number of rows and the grand total of each prefix."""
    return df.agg(
        F.count("*").alias("rows"),
        *[F.sum(f"{p}_total").alias(f"{p}_total") for p in prefixes if f"{p}_total" in df.columns],
    )
