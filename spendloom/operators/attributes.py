"""Entity-attribute-value data: cleaning, pivoting, listing and unpivoting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.config import DETAIL_NAMES, ID_PREFIXES, AttributeRule
from spendloom.functions.names import key_of, title_name
from spendloom.functions.text import looks_latin, merge_text, non_blank, trimmed
from spendloom.operators.lookups import keep_first
from spendloom.operators.prefix import running_totals

#: Most columns a discovered pivot may get.
MAX_PIVOT_VALUES = 1_000


def clean_values(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Rows whose value is written in Latin characters and is not blank, trimmed."""
    return df.filter(looks_latin(F.col(value_col)) & non_blank(F.col(value_col)).isNotNull()).withColumn(
        value_col, trimmed(F.col(value_col))
    )


def _matches(rule: AttributeRule, name_col: str, id_col: str) -> Column:
    by_name = F.lower(F.col(name_col)).isin(*rule.names) if rule.names else None
    by_id = F.col(id_col).isin(*rule.ids) if rule.ids else None
    if by_name is not None and by_id is not None:
        return by_name | by_id
    return by_name if by_name is not None else by_id


def pivot_by_rules(
    values: DataFrame,
    keys: Sequence[str],
    rules: Sequence[AttributeRule],
    *,
    name_col: str = "name_eng",
    id_col: str = "attribute_id",
    value_col: str = "value",
) -> DataFrame:
    """One row per key; each rule's column is the largest value of its attributes.

    All columns come from one aggregation with map-side reduction.
    """
    return values.groupBy(*keys).agg(
        *[F.max(F.when(_matches(r, name_col, id_col), F.col(value_col))).alias(r.output) for r in rules]
    )


def pivot_values(
    values: DataFrame,
    keys: Sequence[str],
    attribute_col: str,
    value_col: str,
    attributes: Mapping[str, str] | Sequence[str],
) -> DataFrame:
    """One row per key and one column per listed attribute: its smallest value."""
    outputs = attributes if isinstance(attributes, Mapping) else {a: a for a in attributes}
    return values.groupBy(*keys).agg(
        *[F.min(F.when(F.col(attribute_col) == a, F.col(value_col))).alias(out) for a, out in outputs.items()]
    )


def distinct_values(df: DataFrame, column: str | Column, limit: int = MAX_PIVOT_VALUES) -> list:
    """The values of a column, or of an expression, that are to become columns; raises beyond `limit`."""
    values = F.col(column) if isinstance(column, str) else column
    rows = df.select(values.alias("_value")).dropna().distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; list the wanted ones")
    return sorted(r[0] for r in rows)


def pivot_attributes_wide(
    df: DataFrame,
    index_cols: Sequence[str],
    value_col: str,
    attribute_col: str = "attribute_id",
    attributes: Sequence[str] | None = None,
    *,
    names: DataFrame | None = None,
) -> DataFrame:
    """Attribute rows to columns.

    The attributes, when not given, are those in the column of that name of `names`, a narrow table such as
    the attribute list, or else of `df` itself, which is then computed once more.
    """
    wanted = distinct_values(df if names is None else names, attribute_col) if attributes is None else attributes
    return pivot_values(df, index_cols, attribute_col, value_col, list(wanted))


def list_values(df: DataFrame, keys: Sequence[str], value_col: str, output: str = "value_list") -> DataFrame:
    """Distinct values per key in order, joined by ' | '; NULL when there is none.

    Spark removes the copies by (key, value) with map-side reduction before it
    joins the texts.
    """
    texts = F.expr(f"listagg(DISTINCT `{value_col}`, ' | ') WITHIN GROUP (ORDER BY `{value_col}`)")
    return df.groupBy(*keys).agg(texts.alias(output))


def list_pages(df: DataFrame, keys: Sequence[str], value_col: str, page_chars: int = 1_000_000, separator: str = " | ") -> DataFrame:
    """The list of `list_values` in pages: keys, `page` and `value_list`, for keys with more values than one text should hold.

    A value stands on the page on which it would start if the whole list were one text, so no value is
    cut and a page is longer than `page_chars` only by what its last value exceeds it. Pages follow each
    other in ascending numbers; a very long value leaves out some. A page depends on its values and on
    the lengths before it, which are running totals: no task holds all values of a key. Missing keys and
    values are left out.
    """
    values = df.select(*keys, F.col(value_col).cast("string").alias("_value"))
    # conditions as the join of running totals infers them, so that all its branches share one shuffle
    values = values.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in values.columns])).distinct()
    lengths = values.withColumns({"_length": F.length("_value") + len(separator), "_order": F.lit(0)})
    placed = running_totals(lengths, list(keys), "_order", "_length", ["_value"])
    page = F.floor((F.col("running") - F.col("_length")) / page_chars).cast("long")
    texts = F.expr(f"listagg(_value, '{separator}') WITHIN GROUP (ORDER BY _value)")
    return placed.withColumn("page", page).groupBy(*keys, "page").agg(texts.alias("value_list"))


def join_pages(pages: DataFrame, keys: Sequence[str], separator: str = " | ") -> DataFrame:
    """One text per key from its pages, in their order: what `list_values` gives for keys and values that are there."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "value_list"))), lambda p: p["value_list"])
    return pages.groupBy(*keys).agg(F.array_join(texts, separator).alias("value_list"))


def merge_columns(df: DataFrame, first: str, second: str, output: str) -> DataFrame:
    """Replace two text columns by one holding both when they differ."""
    merged = merge_text(F.col(first), F.col(second))
    kept = [c for c in df.columns if c not in (first, second)]
    return df.select(*kept, merged.alias(output))


def expected_attributes(values: DataFrame, template: DataFrame) -> DataFrame:
    """Values whose attribute the template expects for their brick or for their node.

    One equality join per alternative instead of an OR: nothing is compared
    within the rows of an attribute.
    """
    result = values
    for column, flag in (("brick_id", "_by_brick"), ("classification_node_id", "_by_node")):
        if column in template.columns and column in values.columns:
            expected = (
                template.select("attribute_id", column).dropna().distinct().withColumn(flag, F.lit(True))
            )
            result = result.join(expected, ["attribute_id", column], "left")
        else:
            result = result.withColumn(flag, F.lit(None).cast("boolean"))
    return result.filter(F.col("_by_brick") | F.col("_by_node")).select(*values.columns)


# --- Product details: (product_number, detail_name, detail_value) -----------------


def candidate_ids(numbers: DataFrame, number_col: str = "product_number") -> DataFrame:
    """Distinct product ids a number may be stored under: each prefix, and none."""
    distinct_numbers = (
        numbers.select(non_blank(F.col(number_col).cast("string")).alias(number_col)).dropna().distinct()
    )
    prefix = F.explode(F.array(*[F.lit(p) for p in ID_PREFIXES]))
    ids = distinct_numbers.select(number_col, prefix.alias("_prefix")).select(
        number_col, F.concat("_prefix", number_col).alias("product_id")
    )
    # A number may itself begin with a prefix, so two numbers can share an id.
    return ids.select("product_id").distinct()


def unpivot_details(
    wide: DataFrame,
    id_col: str = "product_number",
    skip: Sequence[str] = (),
    *,
    display_names: bool = True,
) -> DataFrame:
    """Wide product rows to (product_number, detail_name, detail_value), blanks left out.

    With `display_names` a column is named after the detail it stands for, or
    else in title case.
    """
    known = {key_of(n): n for n in DETAIL_NAMES}
    columns = [c for c in wide.columns if c != id_col and c not in skip]
    if not columns:
        schema = "product_number string, detail_name string, detail_value string"
        return wide.sparkSession.createDataFrame([], schema)
    texts = wide.select(
        trimmed(F.col(id_col).cast("string")).alias("product_number"),
        *[
            non_blank(F.col(c).cast("string")).alias(known.get(key_of(c), title_name(c)) if display_names else c)
            for c in columns
        ],
    )
    names = texts.columns[1:]
    long = texts.unpivot("product_number", names, "detail_name", "detail_value")
    return long.filter(F.col("detail_value").isNotNull() & (F.col("product_number") != ""))


def first_detail(details: DataFrame) -> DataFrame:
    """One value per product and detail name: the smallest."""
    return keep_first(details, ["product_number", "detail_name"], ["detail_value"])


def pivot_details(details: DataFrame, names: Sequence[str] = DETAIL_NAMES) -> DataFrame:
    """One row per product with a column for every listed name, present or not."""
    present = details.dropna(subset=["product_number", "detail_name", "detail_value"])
    return pivot_values(present, ["product_number"], "detail_name", "detail_value", list(names))


def detail_names(details: DataFrame, allowed: Sequence[str] = DETAIL_NAMES) -> DataFrame:
    """Rows of each allowed detail name that occurs or, if none does, of every name."""
    counts = details.dropna(subset=["detail_name"]).groupBy("detail_name").agg(F.count("*").alias("rows"))
    listed = F.col("detail_name").isin(*allowed)
    known = counts.agg(F.coalesce(F.bool_or(listed), F.lit(False)).alias("_known"))
    return counts.join(known, listed | ~F.col("_known")).select("detail_name", "rows")
