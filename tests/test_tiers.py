from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from spendloom.config import ABCDE, TierScheme
from spendloom.operators import tiers

LOOSE = TierScheme(min_products=0)


def frame(spark, rows):
    return spark.createDataFrame(
        [(c, p, None if s is None else Decimal(str(s))) for c, p, s in rows],
        "class4 string, product string, spend decimal(18,2)",
    )


def labels(df, scheme=ABCDE, blocks=16):
    rows = tiers.tier_products(df, "class4", "product", "spend", scheme, ranges=blocks).collect()
    return {(r["class4"], r["product"]): r["segmentation"] for r in rows}


def expected(rows, scheme):
    """The tiering, one class after the other in plain Python."""
    classes = defaultdict(list)
    for c, p, s in rows:
        if c is not None:
            classes[c].append((p, None if s is None else Decimal(str(s))))
    result = {}
    for c, products in classes.items():
        products.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        total = sum((s for _, s in products if s is not None), Decimal(0))
        run, found = Decimal(0), {}
        for p, s in products:
            run += s or 0
            if total <= 0:
                found[p] = scheme.labels[-1]
            elif s is None or run > total:
                found[p] = scheme.out_of_range
            else:
                cut = next((i for i, t in enumerate(scheme.thresholds) if run <= Decimal(str(t)) * total), None)
                found[p] = scheme.labels[-1 if cut is None else cut]
        sizes = Counter(found.values())
        for p, label in found.items():
            if label in scheme.labels and sizes[label] < scheme.min_products:
                label = scheme.labels[-1]
            result[c, p] = label
    return result


@pytest.mark.parametrize("blocks", [1, 16])
@pytest.mark.parametrize(
    "spends, wanted",
    [
        ([100], "E"),
        ([80, 15, 4, 0.9, 0.1], "ABCDE"),
        ([10, -10], "EE"),
        ([0, 0], "EE"),
        ([85, 15], "BE"),
    ],
)
def test_boundaries(spark, spends, wanted, blocks):
    rows = [("c", f"p{i}", s) for i, s in enumerate(spends)]
    found = labels(frame(spark, rows), LOOSE, blocks)
    assert "".join(found[c, p] for c, p in sorted(found)) == wanted


@pytest.mark.parametrize("blocks", [1, 16])
def test_credits_leave_the_range(spark, blocks):
    rows = [("c", "p1", 100), ("c", "p2", 50), ("c", "p3", -60)]
    assert labels(frame(spark, rows), LOOSE, blocks) == {("c", "p1"): "nan", ("c", "p2"): "nan", ("c", "p3"): "E"}


@pytest.mark.parametrize("blocks", [1, 16])
def test_missing_spend_and_missing_class(spark, blocks):
    rows = [("c", "p1", 10), ("c", "p2", None), (None, "p3", 10)]
    assert labels(frame(spark, rows), LOOSE, blocks) == {("c", "p1"): "E", ("c", "p2"): "nan"}


@pytest.mark.parametrize("blocks", [1, 16])
def test_equal_spend_is_ordered_by_product(spark, blocks):
    rows = [("c", p, 25) for p in ("d", "b", "a", "c")]
    assert labels(frame(spark, rows), LOOSE, blocks) == {
        ("c", "a"): "A",
        ("c", "b"): "A",
        ("c", "c"): "A",
        ("c", "d"): "E",
    }


@pytest.mark.parametrize("blocks", [1, 4])
def test_thin_tiers_collapse_into_the_last(spark, blocks):
    rows = [("c", f"a{i:02}", 8) for i in range(10)] + [("c", f"b{i}", 3.5) for i in range(4)]
    rows += [("c", "e0", 1.5)] + [("c", f"e{i}", 0.9) for i in range(1, 6)]
    found = Counter(labels(frame(spark, rows), blocks=blocks).values())
    assert found == {"A": 10, "E": 10}


@pytest.mark.parametrize("blocks", [1, 7])
@pytest.mark.parametrize("scheme", [ABCDE, LOOSE, TierScheme(("x", "y"), (0.5,), 3)])
def test_random_frames_with_a_hot_class(spark, scheme, blocks):
    rng = random.Random(blocks)
    rows = [
        (rng.choice(["hot", "hot", "hot", "b", "c", None]), f"p{i:03}", rng.choice([None, 0, 1, 1, 2.5, -1, rng.randint(1, 900)]))
        for i in range(400)
    ]
    assert labels(frame(spark, rows), scheme, blocks) == expected(rows, scheme)


def test_share_never_falls_without_credits(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"p{i:03}", rng.randint(0, 500)) for i in range(200)]
    shared = tiers.cumulative_share(frame(spark, rows), "class4", "product", "spend", ranges=5)
    for c in "ab":
        ordered = shared.filter(f"class4 = '{c}'").orderBy("spend", ascending=False).collect()
        shares = sorted(r["cum_share"] for r in ordered)
        assert shares[-1] == 1.0
        assert [r["spend"] for r in ordered] == sorted((r["spend"] for r in ordered), reverse=True)


def test_double_spend_with_nan(spark):
    df = spark.createDataFrame([("c", "p1", 5.0), ("c", "p2", float("nan"))], "class4 string, product string, spend double")
    assert labels(df, LOOSE) == {("c", "p1"): "E", ("c", "p2"): "nan"}


def test_small_and_large_spends_are_exact(spark):
    tiny = spark.createDataFrame([("c", f"p{i}", 0.004) for i in range(10)], "class4 string, product string, spend double")
    assert Counter(labels(tiny, LOOSE).values()) == {"A": 8, "B": 1, "E": 1}
    huge = spark.createDataFrame([("c", "p1", 3e16), ("c", "p2", 1.0)], "class4 string, product string, spend double")
    assert labels(huge, LOOSE) == {("c", "p1"): "E", ("c", "p2"): "E"}


def test_labels_do_not_depend_on_the_order_of_rows(spark):
    rows = [("c", f"p{i}", d, Decimal(10)) for i in range(10) for d in "xy"]
    schema = "class4 string, product string, description string, spend decimal(18,2)"
    found = [
        {(r.product, r.description): r.segmentation for r in tiers.tier_products(spark.createDataFrame(r, schema), "class4", "product", "spend", LOOSE).collect()}
        for r in (rows, rows[::-1])
    ]
    assert found[0] == found[1] and len(found[0]) == 20


def test_scheme_needs_one_threshold_fewer():
    with pytest.raises(ValueError):
        TierScheme(labels=("A", "B"), thresholds=(0.5, 0.8))


def test_spend_drops_missing_keys_and_attach_repeats_rows(spark):
    purchases = spark.createDataFrame(
        [("c1", "p", "d", 10.0), ("c2", "p", "d", 90.0), (None, "p", "d", 5.0), ("c1", None, "d", 1.0)],
        "class4 string, product_number string, product_description string, purchase_amount_eur double",
    )
    spend = tiers.product_spend(purchases)
    assert {(r[0], r[3]) for r in spend.collect()} == {("c1", 10.0), ("c2", 90.0)}
    tiered = tiers.tier_products(spend, "class4", "product_number", "purchase_amount_eur", LOOSE)
    # Three rows of product p meet both of its classes; the row without product stays.
    assert tiers.attach_segment(purchases, tiered).count() == 7
    assert tiers.attach_segment(purchases, tiered, ["class4", "product_number"]).count() == 4


def test_product_without_any_amount_has_spend_zero(spark):
    purchases = spark.createDataFrame(
        [("c", "p", "d", None), ("c", "q", "d", 2.0)],
        "class4 string, product_number string, product_description string, purchase_amount_eur double",
    )
    assert {r[1]: r[3] for r in tiers.product_spend(purchases).collect()} == {"p": 0.0, "q": 2.0}


def test_summary_and_reconciliation(spark):
    rows = [("c", f"p{i}", s) for i, s in enumerate([8000, 1500, 400, 90, 10.5])]
    tiered = tiers.tier_products(frame(spark, rows), "class4", "product", "spend", LOOSE)
    summary = tiers.tier_summary(tiered, product_col="product", spend_col="spend")
    first = summary.first()
    assert (first["products_text"], first["spend_total_text"]) == ("1", "8,000 EUR")
    assert sum(r["products"] for r in summary.collect()) == 5
    check = tiers.reconcile(frame(spark, rows), "spend", summary, "spend_total").first()
    assert check["matches"] and check["difference"] == 0
    off = tiers.reconcile(frame(spark, rows[1:]), "spend", summary, "spend_total").first()
    assert not off["matches"]


def test_collapse_on_an_existing_label(spark):
    rows = [("c", f"p{i}", 1) for i in range(6)]
    df = frame(spark, rows).selectExpr("class4", "product", "IF(product < 'p2', 'A', 'nan') AS label")
    collapsed = tiers.collapse_small_tiers(df, "class4", "label", ABCDE.labels, 5)
    assert Counter(r["label"] for r in collapsed.collect()) == {"E": 2, "nan": 4}
