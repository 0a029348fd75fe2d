"""Tiers by one-dimensional clustering, and clustering of products on economic features. All of it is repeatable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.config import ABCDE
from spendloom.session import cut_lineage

#: Steps of the logarithm of spend that count as different, per unit; doubles have 1,460 units of logarithm.
RESOLUTION = 256
#: Steps of expectation and maximisation, and the least variance of a part (in units of the logarithm).
EM_STEPS = 40
LEAST_VARIANCE = 1e-4
_BIN, _CLUSTER = "_bin", "_cluster"


def _log_bin(spend_col: str) -> Column:
    """The step of a spend on the logarithmic scale; NULL where it has no logarithm."""
    spend = F.col(spend_col).cast("double")
    return F.when(spend > 0, F.floor(F.log(spend) * RESOLUTION)).cast("long")


def counted_logs(df: DataFrame, spend_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The steps that occur, in order, and their rows. At most 373,760 pairs, however many rows there are."""
    counts = df.select(_log_bin(spend_col).alias(_BIN)).dropna().groupBy(_BIN).agg(F.count("*").alias("n")).toPandas()
    counts = counts.sort_values(_BIN)
    return counts[_BIN].to_numpy(np.int64), counts["n"].to_numpy(np.int64)


def best_cuts(positions: np.ndarray, counts: np.ndarray, clusters: int) -> list[int]:
    """Exact one-dimensional k-means of counted positions: the place at which each cluster starts.

    Dynamic programming: the best way to split the first i positions into j clusters ends with a cluster
    whose start never falls as i rises, so each row is filled by halving. Of equal ways the earliest start
    is taken. With fewer positions than clusters each position is a cluster.
    """
    n, clusters = len(positions), min(clusters, len(positions))
    if not n:
        return []
    x = positions - np.average(positions, weights=counts)
    sums = [np.concatenate([[0.0], np.cumsum(counts * x**p)]) for p in range(3)]

    def cost(start: np.ndarray, end: int) -> np.ndarray:
        """Squared distances from their mean of the positions from each start to `end`, inclusive."""
        weight, first, second = (s[end + 1] - s[start] for s in sums)
        return np.maximum(second - first**2 / weight, 0)

    best = np.array([cost(np.array([0]), i)[0] for i in range(n)])
    starts = []
    for j in range(1, clusters):
        row, chosen = np.full(n, np.inf), np.full(n, j)
        waiting = [(j, n - 1, j, n - 1)]
        while waiting:
            low, high, least, most = waiting.pop()
            if low > high:
                continue
            middle = (low + high) // 2
            start = np.arange(least, min(middle, most) + 1)
            ways = best[start - 1] + cost(start, middle)
            at = int(np.argmin(ways))
            row[middle], chosen[middle] = ways[at], start[at]
            waiting += [(low, middle - 1, least, int(start[at])), (middle + 1, high, int(start[at]), most)]
        best = row
        starts.append(chosen)
    cuts, end = [], n - 1
    for chosen in reversed(starts):
        cuts.append(int(chosen[end]))
        end = cuts[-1] - 1
    return [0, *reversed(cuts)]


def kmeans_tiers(df: DataFrame, spend_col: str, labels: Sequence[str] = ABCDE.labels) -> DataFrame:
    """Label rows by the best split of the logarithm of spend into as many ranges as labels, largest spend first.

    Spend counts in steps of 1/256 of the natural logarithm; among splits of these counts it is exact.
    Spend that is not positive or is missing has no logarithm and gets the last label.
    """
    positions, counts = counted_logs(df, spend_col)
    cuts = best_cuts(positions, counts, len(labels))
    name = F.lit(labels[-1])
    for label, cut in zip(labels[: len(cuts)][::-1], cuts, strict=True):
        name = F.when(_log_bin(spend_col) >= int(positions[cut]), F.lit(label)).otherwise(name)
    return df.withColumn("segmentation", name)


def fit_mixture(x: np.ndarray, counts: np.ndarray, cuts: Sequence[int], steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and variances of a mixture of normal parts, by expectation and maximisation from a split."""
    part = np.searchsorted(cuts, np.arange(len(x)), side="right") - 1
    belongs = np.eye(len(cuts))[part].T
    for _ in range(steps + 1):
        weight = belongs * counts
        total = np.maximum(weight.sum(axis=1), 1e-12)
        means = weight @ x / total
        variances = np.maximum(weight @ x**2 / total - means**2, LEAST_VARIANCE)
        shares = total / counts.sum()
        density = shares[:, None] / np.sqrt(variances)[:, None] * np.exp(-((x - means[:, None]) ** 2) / (2 * variances[:, None]))
        belongs = density / np.maximum(density.sum(axis=0), 1e-300)
    return shares, means, variances


def gmm_tiers(df: DataFrame, spend_col: str, labels: Sequence[str] = ABCDE.labels) -> DataFrame:
    """Label rows by the likeliest part of a mixture of normal parts on the logarithm of spend, largest mean first.

    Fitted to counted steps, from the split of `kmeans_tiers`, in EM_STEPS steps. Spend that is not
    positive or is missing gets the last label.
    """
    positions, counts = counted_logs(df, spend_col)
    if not len(positions):
        return df.withColumn("segmentation", F.lit(labels[-1]))
    x = positions / RESOLUTION
    shares, means, variances = fit_mixture(x, counts, best_cuts(positions, counts, len(labels)))
    value = _log_bin(spend_col) / F.lit(float(RESOLUTION))
    order = np.argsort(-means, kind="stable")
    likelihood = [
        F.lit(float(np.log(shares[i]) - np.log(variances[i]) / 2)) - (value - float(means[i])) ** 2 / float(2 * variances[i]) for i in order
    ]
    highest = F.greatest(*likelihood) if len(likelihood) > 1 else likelihood[0]
    name = F.lit(labels[-1])
    for label, one in list(zip(labels, likelihood, strict=False))[::-1]:
        name = F.when(one == highest, F.lit(label)).otherwise(name)
    return df.withColumn("segmentation", name)


@dataclass
class ProductClustering:
    """Scale the features, choose the number of clusters by silhouette, cluster.

    Start centres are points far from each other in a sample of at most `sample` rows, those with the
    smallest hashes of `key`, or of their features; the rest is sums over all rows. So runs repeat, however rows are dealt.
    """

    features: Sequence[str]
    candidates: Sequence[int] = (2, 3, 4, 5, 6)
    key: str | None = None
    sample: int = 1000
    steps: int = 30
    scores: dict[int, float] = field(default_factory=dict)
    centres: dict[int, np.ndarray] = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Rows whose features are all known, with the scaled features `_z`: mean 0, sample deviation 1."""
        known = df.dropna(subset=list(self.features))
        numbers = [F.col(c).cast("double") for c in self.features]
        found = known.agg(*[f(n).alias(f"{f.__name__}{i}") for i, n in enumerate(numbers) for f in (F.avg, F.stddev_samp)]).first()
        scaled = []
        for i, number in enumerate(numbers):
            mean, deviation = found[f"avg{i}"], found[f"stddev_samp{i}"]
            scaled.append((number - F.lit(mean or 0.0)) / F.lit(deviation or 1.0))
        # read by every pass for every candidate number, so it is computed once
        return cut_lineage(known.withColumn("_z", F.array(*scaled)))

    def start(self, prepared: DataFrame, k: int) -> np.ndarray:
        """The sample's point nearest to the mean, then again and again the one farthest from those chosen."""
        place = F.md5(F.col(self.key).cast("string")) if self.key else F.xxhash64("_z")
        rows = prepared.orderBy(place, "_z").limit(self.sample).select("_z").collect()
        points = np.array(sorted(tuple(r["_z"]) for r in rows)).reshape(-1, len(self.features))
        if not len(points):
            return points
        chosen = [points[np.argmin((points**2).sum(axis=1))]]
        while len(chosen) < k:
            away = np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0)
            if away.max() <= 0:
                break
            chosen.append(points[np.argmax(away)])
        return np.array(chosen)

    def _distance(self, centre: Sequence[float]) -> Column:
        return reduce(lambda a, b: a + b, [(F.col("_z")[i] - float(c)) ** 2 for i, c in enumerate(centre)])

    def _nearest(self, centres: np.ndarray) -> Column:
        """The number of the nearest centre; of equally near ones the first."""
        away = F.array(*[self._distance(c) for c in centres])
        return F.array_position(away, F.array_min(away)).cast("int") - 1

    def _sums(self, prepared: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, np.ndarray, float]]:
        """Per cluster its rows, the sum of its points and of their squared lengths; one row a cluster."""
        z = [F.col("_z")[i] for i in range(len(self.features))]
        length = reduce(lambda a, b: a + b, [c * c for c in z])
        sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(z)]
        rows = prepared.withColumn(_CLUSTER, self._nearest(centres)).groupBy(_CLUSTER).agg(F.count("*").alias("n"), F.sum(length).alias("q"), *sums)
        return {r[_CLUSTER]: (r["n"], np.array([r[f"s{i}"] for i in range(len(z))]), r["q"]) for r in rows.collect()}

    def fit(self, prepared: DataFrame, k: int) -> np.ndarray:
        """Centres, ordered by their features: k-means from `start`, until centres rest or `steps` are done."""
        centres = self.start(prepared, k)
        for _ in range(self.steps if len(centres) else 0):
            sums = self._sums(prepared, centres)
            moved = np.array([sums[i][1] / sums[i][0] if i in sums else c for i, c in enumerate(centres)])
            rest = np.abs(moved - centres).max() < 1e-7
            centres = moved
            if rest:
                break
        self.centres[k] = centres[np.lexsort(centres.T[::-1])] if len(centres) else centres
        return self.centres[k]

    def silhouette(self, prepared: DataFrame, centres: np.ndarray) -> float:
        """Mean silhouette by squared distances; each row meets the sums of the clusters, not the other rows."""
        sums = self._sums(prepared, centres) if len(centres) > 1 else {}
        if len(sums) < 2:
            return 0.0
        own, others = F.lit(None).cast("double"), []
        z = [F.col("_z")[i] for i in range(len(self.features))]
        length = reduce(lambda a, b: a + b, [c * c for c in z])
        for cluster, (n, total, squares) in sorted(sums.items()):
            mean = length + float(squares / n) - 2 * reduce(lambda a, b: a + b, [c * float(t / n) for c, t in zip(z, total, strict=True)])
            here = F.col(_CLUSTER) == cluster
            # a row is no neighbour of itself; alone in its cluster it has no silhouette
            own = F.when(here, mean * n / (n - 1) if n > 1 else F.lit(None)).otherwise(own)
            others.append(F.when(~here, mean))
        nearest = F.least(*others)
        value = F.when(own.isNull() | (F.greatest(own, nearest) <= 0), 0.0).otherwise((nearest - own) / F.greatest(own, nearest))
        return prepared.withColumn(_CLUSTER, self._nearest(centres)).agg(F.avg(value)).first()[0]

    def choose_k(self, prepared: DataFrame) -> int:
        for k in self.candidates:
            self.scores[k] = self.silhouette(prepared, self.fit(prepared, k))
        return max(self.scores, key=lambda k: (round(self.scores[k], 9), -k))

    def run(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """All rows with known features, with their `cluster`; clusters are numbered by their centres."""
        prepared = self.prepare(df)
        k = k or self.choose_k(prepared)
        centres = self.centres[k] if k in self.centres else self.fit(prepared, k)
        cluster = self._nearest(centres) if len(centres) else F.lit(None).cast("int")
        return prepared.withColumn("cluster", cluster).select(*df.columns, "cluster")
