"""Clusterings against plain Python that tries everything."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from spendloom.operators import clustering


def squares(points, counts):
    mean = sum(p * c for p, c in zip(points, counts)) / sum(counts)
    return sum(c * (p - mean) ** 2 for p, c in zip(points, counts))


@pytest.mark.parametrize("seed", range(8))
def test_best_cuts_against_every_split(seed):
    rng = random.Random(seed)
    points = sorted(rng.sample(range(-40, 60), rng.randrange(1, 12)))
    counts = [rng.randrange(1, 5) for _ in points]
    for clusters in (1, 2, 3, 4):
        cuts = clustering.best_cuts(np.array(points), np.array(counts), clusters)
        ways = []
        for chosen in itertools.combinations(range(1, len(points)), min(clusters, len(points)) - 1):
            bounds = [0, *chosen, len(points)]
            ways.append(sum(squares(points[a:b], counts[a:b]) for a, b in zip(bounds, bounds[1:])))
        bounds = [*cuts, len(points)]
        assert cuts[0] == 0 and sum(squares(points[a:b], counts[a:b]) for a, b in zip(bounds, bounds[1:])) == pytest.approx(min(ways))
    assert clustering.best_cuts(np.zeros(0), np.zeros(0), 3) == []


def spends(spark, rows):
    return spark.createDataFrame(rows, "product string, spend double")


@pytest.mark.parametrize("tiering", [clustering.kmeans_tiers, clustering.gmm_tiers])
def test_few_or_no_spends(spark, tiering):
    assert tiering(spends(spark, []), "spend").count() == 0
    rows = spends(spark, [("a", None), ("b", -1.0), ("c", 0.0)])
    assert {r["segmentation"] for r in tiering(rows, "spend").collect()} == {"E"}
    rows = spends(spark, [("a", 10.0), ("b", 1000.0), ("c", 10.0), ("d", None)])
    found = {r["product"]: r["segmentation"] for r in tiering(rows, "spend").collect()}
    assert found == {"a": "B", "b": "A", "c": "B", "d": "E"}


def test_equal_layouts_give_equal_labels(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", math.exp(rng.gauss(rng.choice([2, 5, 9]), 0.6))) for i in range(400)]
    for tiering in (clustering.kmeans_tiers, clustering.gmm_tiers):
        first = {r["product"]: r["segmentation"] for r in tiering(spends(spark, rows), "spend").collect()}
        again = {r["product"]: r["segmentation"] for r in tiering(spends(spark, rows[::-1]).repartition(7), "spend").collect()}
        assert first == again and set(first.values()) == set("ABCDE")


def plain_clusters(points: dict[str, tuple[float, ...]], candidates, sample=1000, steps=30):
    """Scaled points, far starts, k-means and pairwise silhouettes, one by one."""
    names = list(points)
    raw = np.array([points[n] for n in names])
    z = (raw - raw.mean(axis=0)) / raw.std(axis=0, ddof=1)
    drawn = sorted(range(len(names)), key=lambda i: hashlib.md5(names[i].encode()).hexdigest())[:sample]
    some = sorted(tuple(z[i]) for i in drawn)
    best = None
    for k in candidates:
        centres = [min(some, key=lambda p: sum(x * x for x in p))]
        while len(centres) < k:
            centres.append(max(some, key=lambda p: min(sum((x - y) ** 2 for x, y in zip(p, c)) for c in centres)))
        centres = np.array(centres)
        for _ in range(steps):
            near = ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([z[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        near = ((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        away = ((z[:, None] - z) ** 2).sum(axis=2)
        values = []
        for i in range(len(z)):
            means = {j: away[i, near == j].sum() / ((near == j).sum() - (j == near[i]) or 1) for j in set(near)}
            own, other = means.pop(near[i]), min(means.values())
            values.append(0 if (near == near[i]).sum() == 1 or max(own, other) <= 0 else (other - own) / max(own, other))
        score = round(float(np.mean(values)), 9)
        if best is None or score > best[0]:
            order = sorted(range(k), key=lambda j: tuple(centres[j]))
            best = score, k, centres[order], {n: order.index(j) for n, j in zip(names, near)}
    return best


def test_product_clusters_against_plain_python(spark):
    rng = random.Random(11)
    points = {f"p{i}": (rng.gauss(c[0], 3), rng.gauss(c[1], 2)) for i in range(120) for c in [rng.choice([(0, 0), (40, 10), (10, 60)])]}
    df = spark.createDataFrame([(n, *p, "x") for n, p in points.items()], "product_number string, a double, b double, cluster_note string")
    found = clustering.ProductClustering(["a", "b"], candidates=(2, 3, 4), key="product_number", sample=50)
    rows = found.run(df.repartition(5)).collect()
    score, k, centres, labels = plain_clusters(points, (2, 3, 4), sample=50)
    assert max(found.scores, key=found.scores.get) == k == 3 and found.scores[k] == pytest.approx(score, abs=1e-8)
    assert np.allclose(found.centres[k], centres)
    assert {r["product_number"]: r["cluster"] for r in rows} == labels


def test_product_clusters_edges(spark):
    schema = "product_number string, a double, b double"
    make = lambda: clustering.ProductClustering(["a", "b"], candidates=(2, 3))
    assert make().run(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([("x", 1.0, 2.0)] * 3 + [("y", None, 2.0)], schema)
    assert [r["cluster"] for r in make().run(same).collect()] == [0, 0, 0]
    assert make().run(same, 2).count() == 3
