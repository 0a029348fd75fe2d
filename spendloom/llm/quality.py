"""Text quality by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a quantile threshold.

Of a good and a bad text the good one is preferred. A text's strength is linear in its features, and
the chance that one text beats another is the logistic function of the difference of their strengths;
the weights are fitted to pairs of labelled texts, each good one against several bad ones, so how many
texts of either kind there are does not matter. A strength becomes a score by its quantile among the
training texts: what lies above the quantile at which the share of bad labels ends scores THRESHOLD or
more.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.operators.prefix import counted_values, running_totals

from .common import stored, table, text_or_empty

THRESHOLD = 0.3
FOLDS = 5
HELD_OUT = 0
#: Rows of the larger class and, at least, of the other one in a block, within which texts meet.
BLOCK_ROWS = 4_096
BLOCK_OPPONENTS = 512
#: Quantiles of the training texts that become knots.
GRID = 1000
#: Sums of blocks are added as whole numbers of so many units to one.
_UNIT = 2**40
#: Opponents of each text of the larger class.
OPPONENTS = 8
#: Weight of the penalty on squared weights, per pair.
PENALTY = 1e-3
#: Words are also described by their shape, hashed to so many features.
SHAPES = 48
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\ufffd]")
_SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x"), (re.compile(r"\d+"), "9"))
_NAMES = (
    "log words", "no words", "mean length", "long words", "capitals", "letters", "digits", "symbols", "spaces", "control",
    "line ends", "repeated lines", "most frequent word", "distinct words", "repeated triples", "capital words", "no letter",
)
FEATURES = len(_NAMES) + SHAPES


def fold_hash(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def held_out(doc_id: Column) -> Column:
    return fold_hash(doc_id) % FOLDS == HELD_OUT


@lru_cache(maxsize=200_000)
def _describe(word: str) -> tuple[int, int, int, int, int, int, int, int]:
    """A word's shape feature, its characters, letters, digits and capitals; whether it is long, in capitals, without letter."""
    shape = word
    for pattern, new in _SHAPE:
        shape = pattern.sub(new, shape)
    # what follows a run of one sign says no more
    shape = re.sub(r"(.)\1+", r"\1", shape)[:8]
    letters, digits, capitals = sum(map(str.isalpha, word)), sum(map(str.isdigit, word)), sum("A" <= c <= "Z" for c in word)
    place = zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES
    return place, len(word), letters, digits, capitals, len(word) > 15, len(word) > 1 and word.isupper(), not letters


def features(text: str) -> np.ndarray:
    """Shares and means over the whole text, so that length alone says little; all zero but one without words."""
    words = _WORD.findall(text)
    n, size = len(words), max(len(text), 1)
    if not n:
        return np.eye(1, FEATURES, 1)[0]
    counts = Counter(words)
    shapes = [0.0] * SHAPES
    characters = letters = digits = capitals = long_words = upper = bare = 0
    for word, count in counts.items():
        place, w_characters, w_letters, w_digits, w_capitals, w_long, w_upper, w_bare = _describe(word)
        shapes[place] += count / n
        characters += w_characters * count
        letters += w_letters * count
        digits += w_digits * count
        capitals += w_capitals * count
        long_words += w_long * count
        upper += w_upper * count
        bare += w_bare * count
    lines = text.split("\n")
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1)
    found = (
        math.log(n) / 8, 0, characters / n / 8, long_words / n, capitals / size, letters / size, digits / size,
        (characters - letters - digits) / size, 1 - characters / size, len(_CONTROL.findall(text)) / size,
        min(len(lines) / n, 1), 1 - len(set(lines)) / len(lines), max(counts.values()) / n, len(counts) / n,
        1 - min(triples, 1), upper / n, bare / n,
    )
    return np.array([*found, *shapes])


def pairs_of(labels: np.ndarray, opponents: int = OPPONENTS, larger: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (better, worse): each row of the larger class, or of class ``larger``, meets ``opponents`` of the other, in turn."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    good_meet = len(good) >= len(bad) if larger is None else larger == 1
    many, few = (good, bad) if good_meet else (bad, good)
    met = min(opponents, len(few))
    place = np.repeat(np.arange(len(many)), met)
    other = (place * met + np.tile(np.arange(met), len(many))) % len(few)
    return (many[place], few[other]) if good_meet else (few[other], many[place])


def _slopes(x: np.ndarray, better: np.ndarray, worse: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the pairs' logistic loss at the weights ``w``."""
    difference = x[better] - x[worse]
    lose = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
    return -(difference.T @ lose), (difference.T * (lose * (1 - lose))) @ difference


def _newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, strength: float) -> np.ndarray:
    w = np.zeros(size)
    for _ in range(50):
        gradient, hessian = slopes(w)
        step = np.linalg.solve(hessian + strength * np.eye(size), gradient + strength * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights that make the better text of each pair the likelier winner: Newton steps on the logistic loss."""
    return _newton(lambda w: _slopes(x, better, worse, w), x.shape[1], penalty * len(better))


@dataclass(frozen=True)
class QualityModel:
    """``knots`` are strengths of training texts, ``levels`` their scores; both empty without preference pairs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def strengths(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a matrix product may round a row differently in another batch
        return (self.standardised(x) * self.weights).sum(axis=1)

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, strengths: np.ndarray) -> np.ndarray:
        """The quantile scale of the training texts; beyond them it goes on towards 0 and 1."""
        if not len(self.knots):
            return np.full(len(strengths), 0.5)
        low, high = np.minimum(strengths - self.knots[0], 0), np.maximum(strengths - self.knots[-1], 0)
        inside = np.interp(strengths, self.knots, self.levels)
        return np.where(low < 0, self.levels[0] * np.exp(low), np.where(high > 0, 1 - (1 - self.levels[-1]) * np.exp(-high), inside))

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """All rows and columns of ``docs`` with a score of 0 to 1 of the whole ``text`` (null as empty).

        Equal texts score alike, wherever they stand. Without preference pairs every text scores 0.5.
        No rows give no rows.
        """
        model = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.array([features(text) for text in batch]).reshape(-1, FEATURES)
                yield pd.Series(model.scores(model.strengths(x)))

        return docs.withColumn(column, score(text_or_empty(F.col("text"))))

    def score_described(self, described: DataFrame, column: str = "score") -> DataFrame:
        """The same for rows of ``describe``."""
        model = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model.scores(model.strengths(_matrix(batch))))

        return described.withColumn(column, score("x"))


def _without_pairs() -> QualityModel:
    none = np.zeros(0)
    return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), none, none)


def _with_levels(
    model: QualityModel, rows: int, bad: int, at: Callable[[np.ndarray], np.ndarray], threshold: float = THRESHOLD, grid: int = GRID
) -> QualityModel:
    """``model`` with knots at quantiles of the training texts' strengths; ``at`` gives the strengths of some ascending ranks."""
    shares = np.linspace(0, 1, grid)[1:-1]
    places = shares * (rows - 1)
    low, high = np.floor(places).astype(int), np.ceil(places).astype(int)
    ranks = np.unique(np.concatenate([low, high, [bad - 1, bad]]))
    found = at(ranks)
    value = lambda rank: found[np.searchsorted(ranks, rank)]
    # half way between the last text below the quantile and the first one above it
    cut = (value(bad - 1) + value(bad)) / 2
    knots = value(low) + (value(high) - value(low)) * (places - low)
    base = bad / rows
    below, above = knots < cut, knots > cut
    knots = np.concatenate([knots[below], [cut], knots[above]])
    down, up = np.minimum(shares[below] / base, 1), np.maximum((shares[above] - base) / (1 - base), 0)
    levels = np.concatenate([threshold * down, [threshold], threshold + (1 - threshold) * up])
    return replace(model, knots=knots, levels=np.maximum.accumulate(levels))


def fit(x: np.ndarray, labels: np.ndarray, threshold: float = THRESHOLD, grid: int = GRID) -> QualityModel:
    """The model of feature rows at hand with labels 1 (good) and 0 (bad); ``train`` fits tables of any size."""
    better, worse = pairs_of(labels)
    if not len(better):
        return _without_pairs()
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    model = replace(_without_pairs(), mean=mean, scale=np.where(deviation > 1e-9, deviation, 1.0))
    model = replace(model, weights=fit_pairs(model.standardised(x), better, worse))
    strengths = np.sort(model.strengths(x))
    return _with_levels(model, len(strengths), int((labels == 0).sum()), lambda ranks: strengths[ranks], threshold, grid)


def describe(docs: DataFrame) -> DataFrame:
    """``docs`` with ``x``, the features of the whole ``text`` (null as empty) as bytes of doubles, in place of the text."""

    @F.pandas_udf("binary")
    def described(batch: pd.Series) -> pd.Series:
        return pd.Series([features(text).astype(float).tobytes() for text in batch])

    return docs.withColumn("x", described(text_or_empty(F.col("text")))).drop("text")


def _matrix(rows: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=float).reshape(-1, FEATURES)


def _marked(labels: DataFrame) -> DataFrame:
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (doc_id, text, quality) of labelled documents outside the held-out fold: all, or the first ``most`` by a hash of doc_id and text.

    Null labels and labels without doc_id are left out; of several labels of a document the larger counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    found = texts.join(_marked(labels), "doc_id")
    if most is not None:
        found = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)
    return found.select("doc_id", "text", "quality")


def _in_blocks(rows: DataFrame, number: int, larger: int, copies: int) -> DataFrame:
    """Rows (place, quality, x) in ``number`` blocks of whole matrices; rows of the smaller class stand in ``copies`` blocks each.

    A row's blocks follow from its number and features, and the rows of a block are put in order, so a
    block does not depend on how rows are dealt. ``own`` marks one copy of each row.
    """
    copy = F.sequence(F.lit(0), F.when(F.col("quality") == larger, 0).otherwise(copies - 1))
    tied = rows.withColumn("tie", F.xxhash64("x"))
    dealt = tied.withColumn("copy", F.explode(copy)).select(
        F.pmod(F.pmod(F.xxhash64("place", "tie"), F.lit(number)) + F.col("copy"), F.lit(number)).alias("block"),
        "place", "tie", "quality", (F.col("copy") == 0).alias("own"), "x",
    )

    def gathered(block: pa.Table) -> pa.Table:
        order = np.lexsort((block["tie"].to_numpy(), block["place"].to_numpy()))
        column = lambda name: block[name].to_numpy()[order].astype(np.uint8).tobytes()
        x = np.ascontiguousarray(_matrix(block["x"].to_pylist())[order]).tobytes()
        return pa.table({"x": pa.array([x], pa.binary()), "quality": pa.array([column("quality")], pa.binary()), "own": pa.array([column("own")], pa.binary())})

    return dealt.groupBy("block").applyInArrow(gathered, "x binary, quality binary, own binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, quality, own in zip(batch["x"], batch["quality"], batch["own"]):
            yield _matrix([x.as_py()]), np.frombuffer(quality.as_py(), np.uint8), np.frombuffer(own.as_py(), np.uint8) == 1


def _summed(blocks: DataFrame, terms: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a few numbers of each block (features, labels, own), in whole units, so no order of blocks changes it."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _opened(batches):
            units = np.array([round(value * _UNIT) for value in terms(*block).tolist()], dtype=object)
            total = units if total is None else total + units
        if total is not None:
            values = pa.array([Decimal(int(unit)) for unit in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["place", "units"])

    sums = blocks.mapInArrow(added, "place int, units decimal(38,0)").groupBy("place").agg(F.sum("units").alias("units")).collect()
    return np.array([int(row.units) / _UNIT for row in sorted(sums, key=lambda row: row.place)])


def _strengths_at(blocks: DataFrame, model: QualityModel, rows: int, bad: int, ranks: np.ndarray) -> np.ndarray:
    """Strengths of the training texts at some ranks, those of ``_with_levels``, by running totals over all of them."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, own in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.strengths(x[own]))], ["v"])

    strengths = stored(blocks.mapInArrow(measured, "v double"), "quality-strengths")
    placed = running_totals(counted_values(strengths, "v"), [], "_v", "_n")
    # values within two ranks of a multiple of the step between quantiles, and those beside the cut
    step, last, first = (rows - 1) / (GRID - 1), F.col("running"), F.col("running") - F.col("_n")
    near = F.floor((last + 2) / step) >= F.ceil((first - 2) / step)
    near |= (first <= bad) & (last >= bad)
    found = sorted((row.running, row._v) for row in placed.filter(near).select("running", "_v").collect())
    after, values = np.array([running for running, _ in found]), np.array([value for _, value in found])
    return values[np.searchsorted(after, ranks, side="right")]


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of all documents (doc_id, text) with labels (doc_id, quality) outside the held-out fold.

    Null labels and labels without doc_id are left out; of several labels of a document the larger counts.
    Labels of one kind alone make no pairs, then every text scores 0.5.
    """
    rows = training_rows(docs, labels).select("doc_id", "text")
    return train_described(stored(describe(rows), "quality-features"), labels)


def train_described(described: DataFrame, labels: DataFrame) -> QualityModel:
    """The same from rows (doc_id, x) of ``describe``, which are read several times.

    The rows are dealt to blocks once. Each Newton step, the means and deviations before and the
    quantiles after are sums over all blocks; the driver receives some 2,300 numbers a step, and no row.
    """
    marked = _marked(labels)
    numbers = described.select(F.col("doc_id").cast("long").alias("doc_id"))
    counts = {r.quality: r["count"] for r in numbers.join(marked, "doc_id").groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return _without_pairs()
    larger, rows = int(good >= bad), good + bad
    number = -(-max(good, bad) // BLOCK_ROWS)
    copies = min(-(-BLOCK_OPPONENTS * number // min(good, bad)), number)
    rated = described.select(F.col("doc_id").cast("long").alias("doc_id"), "x").join(marked, "doc_id")
    rated = rated.filter(F.col("quality").isin(0, 1)).select(F.xxhash64("doc_id").alias("place"), "quality", "x")
    blocks = stored(_in_blocks(rated, number, larger, copies), "quality-blocks")

    mean = _summed(blocks, lambda x, _, own: x[own].sum(axis=0)) / rows
    deviation = np.sqrt(_summed(blocks, lambda x, _, own: np.square(x[own] - mean).sum(axis=0)) / rows)
    model = replace(_without_pairs(), mean=mean, scale=np.where(deviation > 1e-9, deviation, 1.0))
    pairs = int(_summed(blocks, lambda _, quality, own: np.array([float(len(pairs_of(quality, larger=larger)[0]))]))[0])
    upper = np.triu_indices(FEATURES)

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def terms(x: np.ndarray, quality: np.ndarray, _: np.ndarray) -> np.ndarray:
            gradient, hessian = _slopes(model.standardised(x), *pairs_of(quality, larger=larger), w)
            return np.concatenate([gradient, hessian[upper]])

        sums = _summed(blocks, terms)
        hessian = np.zeros((FEATURES, FEATURES))
        hessian[upper] = sums[FEATURES:]
        return sums[:FEATURES], hessian + np.triu(hessian, 1).T

    fitted = replace(model, weights=_newton(slopes, FEATURES, PENALTY * pairs))
    return _with_levels(fitted, rows, bad, lambda ranks: _strengths_at(blocks, fitted, rows, bad, ranks))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    described = stored(describe(docs.select("doc_id", "text")), "quality-features")
    scored = train_described(described, labels).score_described(described)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
