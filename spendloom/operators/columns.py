"""Column selection, naming and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.config import CLASS_CANDIDATES, SPEND_CANDIDATES
from spendloom.functions.names import (
    distinct_names,
    first_present,
    similar_names,
    standard_names,
)
from spendloom.functions.numbers import to_number
from spendloom.operators.profile import null_profile

#: Column names that only differ by their number are different columns.
NUMBERED_NAMES = r"^(class|level)\s*\d+$"


def optional_column(df: DataFrame, name: str, data_type: str = "string") -> Column:
    """The column, cast; a typed NULL when the frame lacks it."""
    present = name in df.columns
    return (F.col(name) if present else F.lit(None)).cast(data_type).alias(name)


def safe_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Exactly these columns with these types, NULL where the frame lacks them."""
    return df.select(*[optional_column(df, name, t) for name, t in columns.items()])


def stage_string_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All columns, with the keys cast to string."""
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def distinct_columns(df: DataFrame) -> DataFrame:
    """Rename later copies of a column name."""
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return df.toDF(*distinct_names(df.columns, case_sensitive))


def standardize_columns(df: DataFrame) -> DataFrame:
    """'purchase_amount_eur' becomes 'Purchase Amount Eur'; names stay distinct."""
    return distinct_columns(df.toDF(*standard_names(df.columns)))


def harmonize_columns(
    df: DataFrame, threshold: float = 0.8, protect: str = NUMBERED_NAMES, *, strict_parity: bool = False
) -> DataFrame:
    """Merge columns with nearly the same name: the first one, filled from the others.

    Names matching `protect` are left alone. `strict_parity` protects class
    names only, so that for example level columns are merged.
    """
    if strict_parity:
        protect = r"^class\d+$"
    groups = similar_names(df.columns, threshold, protect)
    absorbed = {name for others in groups.values() for name in others}
    types = dict(df.dtypes)

    def merged(name: str) -> Column:
        others = groups.get(name, [])
        if len({types[c] for c in (name, *others)}) > 1:  # columns of different types become text
            return F.coalesce(*[F.col(c).cast("string") for c in (name, *others)]).alias(name)
        return F.coalesce(*[F.col(c) for c in (name, *others)]).alias(name)

    return df.select(*[merged(c) for c in df.columns if c not in absorbed])


def prepare_columns(df: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """Standardise the names, then merge nearly equal ones."""
    return harmonize_columns(standardize_columns(df), threshold, **options)


def spend_column(df: DataFrame, prefer: str = "Purchase Amount Eur") -> tuple[DataFrame, str]:
    """The frame with its spend column made numeric (text that is no number gives 0), and its name."""
    name = first_present(df, (prefer, *SPEND_CANDIDATES))
    if name is None:
        raise ValueError("no spend column found")
    return df.withColumn(name, to_number(F.col(name))), name


def class_column(df: DataFrame) -> Column:
    """First class-like column as text, else 'Unknown'. Missing text stays NULL."""
    name = first_present(df, CLASS_CANDIDATES)
    return (F.col(f"`{name}`").cast("string") if name else F.lit("Unknown")).alias("class3")


def preprocess(df: DataFrame) -> DataFrame:
    """Distinct, standard, harmonised column names; values are left as they are."""
    return df.transform(distinct_columns).transform(prepare_columns)


def preprocess_report(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The preprocessed frame and how many values each of its columns misses."""
    prepared = preprocess(df)
    return prepared, null_profile(prepared)
