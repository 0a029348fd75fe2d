"""The segmentation report: spend, tiers, summary, reconciliation, year split, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spendloom.config import ABCDE, CLASS_SCOPE, TierScheme
from spendloom.operators.tiers import (
    attach_segment,
    product_spend,
    reconcile,
    tier_products,
    tier_summary,
)
from spendloom.operators.years import year_quantity, year_split
from spendloom.sources.files import export_by_class


def segmentation_report(
    purchases: DataFrame,
    scheme: TierScheme = ABCDE,
    *,
    classes: Sequence[str] | None = CLASS_SCOPE,
    years: Sequence[int] | None = None,
    label_col: str = "segmentation",
) -> dict[str, DataFrame]:
    """All tables of the report by name, each a lazy frame over `purchases`.

    Every table that is read computes what it needs anew; `staged_report` writes the shared parts once.
    """
    spend_col = "purchase_amount_eur"
    spend = product_spend(purchases)
    tiers = tier_products(spend, "class4", "product_number", spend_col, scheme, label_col=label_col)
    summary = tier_summary(tiers, label_col=label_col)
    year_rows = year_quantity(purchases, classes)
    return {
        "product_spend": spend,
        "tiers": tiers,
        "purchases": attach_segment(purchases, tiers, label_col=label_col),
        "summary": summary,
        "reconciliation": reconcile(purchases, spend_col, summary, "spend_total"),
        "year_quantity": year_rows,
        "year_split": year_split(
            year_rows, tiers, years=years, segment_cols=("product_description", label_col, "sales_rounding")
        ),
    }


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _observed(purchases: DataFrame, spend_col: str, tiers: DataFrame, raw: Observation, tiered: Observation) -> DataFrame:
    """The reconciliation of two observed totals."""
    kinds = [df.agg(F.sum(spend_col)).schema[0].dataType for df in (purchases, tiers)]
    schema = StructType([StructField("_raw", kinds[0]), StructField("_tiered", kinds[1])])
    totals = purchases.sparkSession.createDataFrame([(raw.get["total"], tiered.get["total"])], schema)
    return reconcile(totals, "_raw", totals, "_tiered")


def staged_report(
    purchases: DataFrame,
    path: str,
    scheme: TierScheme = ABCDE,
    *,
    classes: Sequence[str] | None = CLASS_SCOPE,
    years: Sequence[int] | None = None,
    label_col: str = "segmentation",
) -> dict[str, DataFrame]:
    """The tables of `segmentation_report`, with spend, tiers and year quantities written once below `path`.

    `purchases` is computed twice here, once for the spend and once for the years, and once more by
    whoever reads the table of labelled purchases; everything else reads the written tables. The total of
    the purchases is observed while the spend is written, that of the tiers while they are. Observed
    totals may count a row twice when tasks run again, so totals that disagree are added up afresh; so are
    those of purchases without any spend, of which nothing may have been observed.
    """
    spend_col = "purchase_amount_eur"
    raw, tiered = Observation(), Observation()
    spend = _staged(product_spend(purchases.observe(raw, F.sum(spend_col).alias("total"))), f"{path}/product_spend")
    tiers = tier_products(spend, "class4", "product_number", spend_col, scheme, label_col=label_col)
    tiers = _staged(tiers.observe(tiered, F.sum(spend_col).alias("total")), f"{path}/tiers")
    summary = tier_summary(tiers, label_col=label_col)
    found = None if spend.isEmpty() else _observed(purchases, spend_col, tiers, raw, tiered)
    if found is None or not found.first()["matches"]:
        found = reconcile(purchases, spend_col, summary, "spend_total")
    year_rows = _staged(year_quantity(purchases, classes), f"{path}/year_quantity")
    return {
        "product_spend": spend,
        "tiers": tiers,
        "purchases": attach_segment(purchases, tiers, label_col=label_col),
        "summary": summary,
        "reconciliation": found,
        "year_quantity": year_rows,
        "year_split": year_split(
            year_rows, tiers, years=years, segment_cols=("product_description", label_col, "sales_rounding")
        ),
    }


def export_report(report: dict[str, DataFrame], path: str, file_format: str = "parquet") -> DataFrame:
    """Write the year split, one folder per class; returns the folders written."""
    return export_by_class(report["year_split"], path, "class4", file_format)
