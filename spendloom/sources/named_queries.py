"""Queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spendloom.plans.enrich import enrich_purchases
from spendloom.plans.orders import build_orders
from spendloom.plans.products import build_products, build_products_min
from spendloom.plans.purchases import (
    build_purchases,
    fetch_enriched_purchases,
    fetch_purchases,
    scoped_sample,
)

QUERIES: dict[str, Callable[..., DataFrame]] = {
    "create_order_data": build_orders,
    "create_product_data": build_products,
    "create_product_data_min": build_products_min,
    "create_purchase_data": build_purchases,
    "enrich_purchase_data": enrich_purchases,
    "fetch_purchase_data": fetch_purchases,
    "fetch_purchase_data_enriched": fetch_enriched_purchases,
    "scoped_sample": scoped_sample,
}


def list_queries() -> list[str]:
    return sorted(QUERIES)


def get_query(name: str) -> Callable[..., DataFrame]:
    """The builder of a named query; KeyError lists the names."""
    if name not in QUERIES:
        raise KeyError(f"unknown query {name!r}; available: {', '.join(list_queries())}")
    return QUERIES[name]


def register_query(name: str, builder: Callable[..., DataFrame]) -> None:
    QUERIES[name] = builder
