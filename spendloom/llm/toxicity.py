"""Toxicity by two class-conditional Kneser-Ney character models with a shared backoff.

Counts of six-character strings are gathered per class over all labelled training texts. Each class
model discounts its own counts and gives what that frees to one backoff that both share: the
Kneser-Ney model of all training text, itself backed off over distinct contexts to four, two and one
characters. Expressions rare in a class thus score alike in both. A word's evidence is the
difference of its two log-likelihoods, where strings that neither class has seen are backed off like
all others. A text's main feature is the difference of its two log-likelihoods by characters; beside it
stands the evidence above fixed levels a word, averaged over its words, so that length neither adds to
nor hides it. A small logistic model, fitted on training texts that the language models have not seen,
turns that into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table, text_or_empty

ORDER = 6
#: Bits of a character in a key; characters beyond 1,023 share codes.
BITS = 10
MASK = (1 << BITS) - 1
#: Added to keys of contexts; above all keys of strings.
CONTEXT = 1 << (BITS * ORDER)
#: Discounts of the class counts and of the shared counts.
CLASS_DISCOUNT = 1.0
SHARED_DISCOUNT = 0.75
#: Tasks hold the evidence of so many strings at most, 12 bytes each, the most frequent; the others are joined.
HOT = 1 << 22
#: Characters that a task collects before it merges their counts or looks them up; bounds its memory.
MERGE_EVERY = 1_000_000
#: Evidence of a word, in nats, that counts from these levels on.
LEVELS = (2.0, 4.0)
#: Text features are brought to about 1 for toxic texts, the mean log-likelihood difference first; the logistic
#: model's prior, last the intercept.
SCALES = (20.0, 12.0, 16.0, 70.0)
PRIOR = (2.0, 0.5, 2.0, 2.0, -3.5)
#: The logistic model is fitted on so many labelled rows at most, the first by a hash of doc_id.
CALIBRATION_ROWS = 50_000
THRESHOLD = 0.7
FOLDS = 3
HELD_OUT = 1
_PARTS, _ROW, _ADDED, _FEATURES = (f"__{x}" for x in ("parts", "row", "added", "features"))


def fold_hash(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def held_out(doc_id: Column) -> Column:
    return fold_hash(doc_id) % FOLDS == HELD_OUT


def _characters(text: str) -> np.ndarray:
    """Lower-cased characters, a space before and after."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _spaces(characters: np.ndarray) -> np.ndarray:
    return (characters == 32) | ((characters >= 9) & (characters <= 13))


def keys_of(characters: np.ndarray) -> np.ndarray:
    """For each character the packed string of it and the five before, back to the word's start.

    Words begin with the space before them; further back there are only spaces.
    """
    n = len(characters)
    places = np.arange(n)
    in_word = places - np.maximum.accumulate(np.where(_spaces(characters), places, 0))
    codes = np.concatenate([np.full(ORDER - 1, 32), characters & MASK])
    keys = np.zeros(n, np.int64)
    for back in range(ORDER - 1, -1, -1):
        keys = (keys << BITS) | np.where(in_word >= back, codes[ORDER - 1 - back : ORDER - 1 - back + n], 32)
    return keys


def class_counts(texts: DataFrame) -> DataFrame:
    """Counts of every six-character string in texts (text, toxic): key, toxic, ordinary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {0: [], 1: []}
        known = {0: (np.empty(0, np.int64), np.empty(0, np.int64)), 1: (np.empty(0, np.int64), np.empty(0, np.int64))}
        size = 0

        def merge() -> None:
            for label in (0, 1):
                keys, counts = np.unique(np.concatenate([*waiting[label], np.empty(0, np.int64)]), return_counts=True)
                both = np.concatenate([known[label][0], keys])
                keys, at = np.unique(both, return_inverse=True)
                known[label] = keys, np.bincount(at, np.concatenate([known[label][1], counts])).astype(np.int64)
                waiting[label].clear()

        def rows() -> pa.RecordBatch:
            (k0, n0), (k1, n1) = known[0], known[1]
            keys = np.concatenate([k0, k1])
            return pa.record_batch(
                [
                    pa.array(keys),
                    pa.array(np.concatenate([np.zeros_like(n0), n1])),
                    pa.array(np.concatenate([n0, np.zeros_like(n1)])),
                ],
                ["key", "toxic", "ordinary"],
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys = keys_of(_characters(text.as_py()))
                waiting[toxic].append(keys)
                size += len(keys)
                if size >= MERGE_EVERY:
                    merge()
                    size = 0
                    if len(known[0][0]) > 4_000_000:
                        yield rows()
                        known = {label: (np.empty(0, np.int64), np.empty(0, np.int64)) for label in known}
        merge()
        yield rows()

    counted = texts.select("text", "toxic").mapInArrow(count, "key long, toxic long, ordinary long")
    return counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _low(key: str, characters: int) -> Column:
    return F.col(key).bitwiseAND((1 << (BITS * characters)) - 1)


def _discounted(count: Column, context: Window, below: Column, discount: float = SHARED_DISCOUNT) -> Column:
    """Interpolated Kneser-Ney probability within a context (at most 1,024 characters follow one)."""
    total, kinds = F.sum(count).over(context), F.count(F.lit(1)).over(context)
    return (F.greatest(count - discount, F.lit(0.0)) + discount * kinds * below) / total


def context_key(key):
    """The key of the row of a string's context, its first five characters; keys and columns of keys."""
    return (F.shiftright(key, BITS) if isinstance(key, Column) else key >> BITS) + CONTEXT


def string_evidence(counts: DataFrame) -> DataFrame:
    """Per six-character string: key, n, evidence (log-likelihood, toxic less ordinary, of its last character).

    A row of each context, under context_key with n 0, holds the evidence of strings that were not counted:
    what the two classes leave to the shared backoff after it, whose own probability cancels out. After
    contexts that were not counted either, both classes are the shared model and the evidence is 0.
    """
    after = lambda key: Window.partitionBy(F.shiftright(key, BITS))
    fours = counts.groupBy(_low("key", 4).alias("four")).agg(F.count(F.lit(1)).alias("n4"))
    twos = fours.groupBy(_low("four", 2).alias("two")).agg(F.count(F.lit(1)).alias("n2"))
    ones = twos.groupBy(_low("two", 1).alias("one")).agg(F.count(F.lit(1)).alias("n1"))
    # at most 1,024 rows
    p1 = (F.col("n1") + 0.5) / (F.sum("n1").over(Window.partitionBy()) + 0.5 * (MASK + 1))
    ones = ones.select("one", p1.alias("p1"))
    twos = twos.withColumn("one", _low("two", 1)).join(ones, "one")
    twos = twos.select("two", _discounted(F.col("n2"), after("two"), F.col("p1")).alias("p2"))
    fours = fours.withColumn("two", _low("four", 2)).join(twos, "two")
    fours = fours.select("four", _discounted(F.col("n4"), after("four"), F.col("p2")).alias("p4"))
    sixes = counts.withColumn("four", _low("key", 4)).join(fours, "four")
    n, context = F.col("toxic") + F.col("ordinary"), after("key")
    sixes = sixes.withColumn("shared", _discounted(n, context, F.col("p4")))

    def left(count: str) -> tuple[Column, Column, Column]:
        kept = F.greatest(F.col(count) - CLASS_DISCOUNT, F.lit(0.0))
        total = F.sum(count).over(context)
        return kept, total, total - F.sum(kept).over(context)

    def log_p(count: str) -> Column:
        kept, total, freed = left(count)
        return F.log(F.when(total > 0, (kept + freed * F.col("shared")) / total).otherwise(F.col("shared")))

    def log_backoff(count: str) -> Column:
        _, total, freed = left(count)
        return F.log(F.when(total > 0, freed / total).otherwise(F.lit(1.0)))

    row = lambda key, n, evidence: F.struct(key.alias("key"), n.alias("n"), evidence.cast("float").alias("evidence"))
    string = row(F.col("key"), n, log_p("toxic") - log_p("ordinary"))
    backoff = row(context_key(F.col("key")), F.lit(0).cast("long"), log_backoff("toxic") - log_backoff("ordinary"))
    first = F.col("key") == F.min("key").over(context)
    sixes = sixes.select(F.when(first, F.array(string, backoff)).otherwise(F.array(string)).alias("rows"))
    return sixes.select(F.explode("rows").alias("row")).select("row.*")


@dataclass(frozen=True)
class Evidence:
    """Evidence of strings in order of their keys: of all if ``complete``, else of the most frequent."""

    keys: np.ndarray
    values: np.ndarray
    complete: bool

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.values[at], 0.0), found

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The evidence of each key, and whether it is known here."""
        values, found = self._of(keys)
        if self.complete:
            values[~found] = self._of(context_key(keys[~found]))[0]
        return values, found | self.complete

    def parts(self, texts: list[str]) -> list[tuple[list[int], list[float], list[float], list[list[int]]]]:
        """For each text what each feature is a mean of (characters, or words), the sums of word_features over
        the words whose strings are all known here, and of every other word the evidence of its known strings
        and the keys of the others."""
        characters = [_characters(text) for text in texts]
        all_characters = np.concatenate(characters)
        distinct, at = np.unique(keys_of(all_characters), return_inverse=True)
        values, known = self.of(distinct)
        # words begin with a space, as every text does
        spaces = _spaces(all_characters)
        places, word = np.flatnonzero(spaces), np.cumsum(spaces) - 1
        evidence = np.bincount(word, values[at])
        open_words = np.bincount(word, ~known[at]) > 0
        first = word[np.cumsum([0, *map(len, characters[:-1])])]
        sums = np.add.reduceat(np.where(open_words, 0.0, word_features(evidence)), first, axis=1).T
        counts = np.diff(np.append(first, len(places)))
        numbers = [[len(c), *[int(n) + 1] * (len(SCALES) - 1)] for c, n in zip(characters, counts, strict=True)]
        out = [(n, x.tolist(), [], []) for n, x in zip(numbers, sums, strict=True)]
        ends = np.append(places[1:], len(all_characters))
        opened = np.flatnonzero(open_words)
        for w, text in zip(opened.tolist(), (np.searchsorted(first, opened, "right") - 1).tolist(), strict=True):
            strings = at[places[w] : ends[w]]
            out[text][2].append(float(evidence[w]))
            out[text][3].append(distinct[strings[~known[strings]]].tolist())
        return out


def word_features(evidence: np.ndarray) -> np.ndarray:
    """Of each word: evidence, evidence above each level, and whether it is above the last."""
    return np.array([evidence, *(np.clip(evidence - level, 0, None) for level in LEVELS), evidence > LEVELS[-1]], dtype=float)


def hot_evidence(strings: DataFrame, most: int = HOT) -> Evidence:
    """The most frequent strings, by powers of two of their counts, contexts last; at most ``most`` rows reach the driver."""
    level = F.when(F.col("n") > 0, F.floor(F.log2("n")).cast("int")).otherwise(-1)
    sizes = dict(strings.groupBy(level.alias("level")).count().collect())
    lowest, total, complete = 64, 0, True
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        if total > most:
            complete = False
            break
        lowest = size
    rows = strings.filter(level >= lowest).select("key", "evidence").toArrow()
    keys, values = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return Evidence(keys[order], values[order], complete)


def _joined(parts: DataFrame, strings: DataFrame) -> DataFrame:
    """``parts`` with the words that tasks left open added to the sums, by a join with all strings."""
    parts = stored(parts.withColumn(_ROW, F.monotonically_increasing_id()), "open-words")
    words = parts.select(_ROW, F.posexplode(F.arrays_zip(f"{_PARTS}.known", f"{_PARTS}.keys")).alias("word", "x"))
    words = words.select(_ROW, "word", "x.known", F.explode("x.keys").alias("key"))
    values = words.select("key").distinct().join(strings.select("key", "evidence"), "key", "left")
    backoff = strings.select(F.col("key").alias("context"), F.col("evidence").alias("backoff"))
    values = values.withColumn("context", context_key(F.col("key"))).join(backoff, "context", "left")
    values = values.select("key", F.coalesce("evidence", "backoff", F.lit(0.0)).cast("double").alias("evidence"))
    words = words.join(values, "key").groupBy(_ROW, "word").agg((F.max("known") + F.sum("evidence")).alias("evidence"))
    e = F.col("evidence")
    features = [e, *(F.greatest(e - level, F.lit(0.0)) for level in LEVELS), (e > LEVELS[-1]).cast("double")]
    added = words.groupBy(_ROW).agg(F.array(*(F.sum(f) for f in features)).alias(_ADDED))
    sums = F.zip_with(f"{_PARTS}.sums", F.col(_ADDED), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    sums = F.when(F.col(_ADDED).isNull(), F.col(f"{_PARTS}.sums")).otherwise(sums)
    return parts.join(added, _ROW, "left").withColumn(_PARTS, F.struct(F.col(f"{_PARTS}.n").alias("n"), sums.alias("sums"))).drop(_ROW, _ADDED)


def fit_logistic(features: np.ndarray, labels: np.ndarray, prior: tuple = PRIOR, strength: float = 4.0) -> np.ndarray:
    """Weights of a logistic model, the intercept last, drawn to ``prior``; without rows the prior itself."""
    x = np.column_stack([np.clip(features, -6, 6), np.ones(len(features))])
    centre = np.array(prior)
    w = centre.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - labels) + strength * (w - centre))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(texts: DataFrame, found: str, model: ToxicityModel) -> DataFrame:
    """All columns of ``texts`` with ``found``: the features of its ``text``."""
    evidence = model.evidence

    @F.pandas_udf("n array<long>, sums array<double>, known array<double>, keys array<array<long>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = evidence.value
        for batch in batches:
            rows, waiting, size = [], [], 0
            for text in batch:
                waiting.append(text)
                size += len(text)
                if size >= MERGE_EVERY:
                    rows += known.parts(waiting)
                    waiting, size = [], 0
            rows += known.parts(waiting) if waiting else []
            yield pd.DataFrame(rows, columns=["n", "sums", "known", "keys"])

    with_parts = texts.withColumn(_PARTS, parts(text_or_empty(F.col("text"))))
    if not model.complete:
        with_parts = _joined(with_parts, model.strings)
    features = [F.col(f"{_PARTS}.sums")[i] * scale / F.col(f"{_PARTS}.n")[i] for i, scale in enumerate(SCALES)]
    return with_parts.withColumn(found, F.array(*features)).drop(_PARTS)


@dataclass(frozen=True)
class ToxicityModel:
    """``evidence`` is the broadcast of the most frequent of all ``strings``, or of all if ``complete``."""

    evidence: object
    complete: bool
    strings: DataFrame
    weights: np.ndarray | None = None

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """All rows and columns of ``docs`` with a score of 0 to 1 of its ``text`` (null as empty)."""
        x = [F.least(F.greatest(F.col(_FEATURES)[i], F.lit(-6.0)), F.lit(6.0)) for i in range(len(SCALES))]
        total = sum((f * float(w) for f, w in zip(x, self.weights, strict=False)), F.lit(float(self.weights[-1])))
        return _featured(docs, _FEATURES, self).withColumn(column, 1 / (1 + F.exp(-total))).drop(_FEATURES)


def train(docs: DataFrame, labels: DataFrame, hot: int = HOT) -> ToxicityModel:
    """The model of documents (doc_id, text) with labels (doc_id, toxic), outside the held-out fold.

    A fifth of the training texts, by the same hash, only calibrates. Null labels are left out; of
    several labels of a document the larger counts. Without labels all texts score the prior. ``hot``
    only says how many strings tasks hold; scores are the same for every value.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    # one form of join at every size: texts are shuffled, never the labels sent to all
    known = stored(texts.filter(~held_out(F.col("doc_id"))).join(marked.hint("merge"), "doc_id"), "labelled")
    calibrates = F.floor(fold_hash(F.col("doc_id")) / FOLDS) % 5 == 0
    counts = class_counts(known.filter(~calibrates))
    strings = stored(string_evidence(stored(counts, "strings")), "evidence")
    known_strings = hot_evidence(strings, hot)
    model = ToxicityModel(spark.sparkContext.broadcast(known_strings), known_strings.complete, strings)
    rows = known.filter(calibrates).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(CALIBRATION_ROWS)
    rows = _featured(rows, _FEATURES, model).select("toxic", _FEATURES).collect()
    features = np.array([r[_FEATURES] for r in rows], dtype=float).reshape(-1, len(SCALES))
    return replace(model, weights=fit_logistic(features, np.array([r.toxic for r in rows], dtype=float)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = train(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
