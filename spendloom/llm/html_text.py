"""Main text of pages by the tree model, trained from labelled pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .page_model import PageModel, built_in_counts, label_counts, parse, sum_counts

#: Pages whose markup labels them and from which the model learns: so many at most, first by a hash of
#: page_id and url, besides the small labelled pages of the module.
TRAINING_PAGES = 2_000


def train_page_model(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> PageModel:
    """The model of a bounded sample of ``pages`` (page_id, url, html). Their texts stay on the executors;
    the driver sees sums over a bounded set of features."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            total.update(sum_counts(label_counts(parse(html)) for html in batch["html"]))
        yield pd.DataFrame({"feature": list(total.keys()), "n": list(total.values())}).astype({"feature": str, "n": int})

    order = F.xxhash64(F.col("page_id").cast("string"), F.col("url"))
    picked = pages.select(order.alias("place"), "page_id").orderBy("place", "page_id").limit(training_pages)
    last = picked.agg(F.max("place").alias("place")).collect()[0].place
    if last is None:
        return PageModel(built_in_counts())
    sample = pages.filter(order <= last).select(text_or_empty(F.col("html")).alias("html"))
    sums = sample.mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = Counter({r.feature: r.n for r in sums.collect()})
    return PageModel(sum_counts([built_in_counts(), seen]))


def extract_text(pages: DataFrame, model: PageModel, column: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text of ``html``.

    Null and empty pages, and pages without content, give an empty text.
    """
    counts = model.counts

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = PageModel(counts)
        for batch in batches:
            yield pd.Series([known.extract(html) for html in batch], dtype=object)

    return pages.withColumn(column, extract(text_or_empty(F.col("html"))))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_text(pages, train_page_model(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
