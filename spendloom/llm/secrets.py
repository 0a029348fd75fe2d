"""Secret scan: fixed patterns and character Markov models; built-in functions only.

Two first-order models over characters, one of random strings and one of ordinary identifiers, learn
from strings that the fixed patterns label: the values and keys they find are random strings, the
other strings of the same alphabet are identifiers. Any such string, or what base spans leave of it,
whose log-likelihood ratio outweighs the odds of the two kinds among the samples becomes a span of its
own; spans of the patterns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Fixed values of the contract: patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_KEY = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_HINT = r"(?i:passw|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more; shorter matches hold no longer one
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so shorter matches hold no longer one
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_VALUE},}}"
#: A string is reported if it is random with at least this probability, at the odds of the labelled samples.
LEAST_PROBABILITY = 0.95
#: Taken off every pair count and given to the model's single characters, so that what was seen once, as an
#: unlabelled secret among the identifiers, teaches nothing about its pairs.
DISCOUNT = 1.0
#: Added to the counts of single characters; without samples both models are uniform and report nothing.
SMOOTHING = 0.5

_SPAN = "struct<start:int,kind:int,end:int>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans_of(text: Column, pattern: str, kind: str, keep=None, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points.

    Splitting at the pattern gives what stands between matches; lengths add up to places. ``keep``
    drops matches after they have been found. ``hint`` is a quicker pattern that any match holds.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), _all(text, pattern).alias("match"))
    start = lambda acc, p: acc["at"] + F.length(p["gap"])
    end = lambda acc, p: start(acc, p) + F.coalesce(F.length(p["match"]), F.lit(0))

    def add(acc: Column, p: Column) -> Column:
        found = F.struct(start(acc, p).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end(acc, p).alias("end"))
        good = p["match"].isNotNull() if keep is None else p["match"].isNotNull() & keep(p["match"])
        return F.struct(
            end(acc, p).alias("at"),
            F.when(good, F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("spans"))
    return F.when(text.rlike(hint or pattern), F.aggregate(pairs, empty, add)["spans"]).otherwise(F.expr(_NO_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns by start, then kind as listed."""
    value = lambda m: F.length(F.regexp_replace(m, ASSIGN_KEY, ""))
    long_value = lambda m: value(m) >= LEAST_VALUE
    found = [
        spans_of(text, ASSIGN, "assign", keep=long_value, hint=ASSIGN_HINT),
        spans_of(text, ACCESS, "access", hint="AKIA"),
        spans_of(text, HEX, "hex"),
    ]
    return F.array_sort(F.concat(*found))


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def left_over(span: Column, others: Column) -> Column:
    """What spans, in order of their starts, leave of a span: pieces of LEAST_VALUE characters and more."""
    piece = lambda start, end: F.struct(start.alias("start"), F.lit(KINDS.index("markov")).alias("kind"), end.alias("end"))
    start = F.struct(span["start"].alias("at"), F.expr(_NO_SPANS).alias("left"))

    def cut(acc: Column, other: Column) -> Column:
        before = F.least(other["start"], span["end"])
        left = F.when(before - acc["at"] >= LEAST_VALUE, F.concat(acc["left"], F.array(piece(acc["at"], before)))).otherwise(acc["left"])
        return F.struct(F.greatest(acc["at"], other["end"]).alias("at"), left.alias("left"))

    def rest(acc: Column) -> Column:
        long_enough = span["end"] - acc["at"] >= LEAST_VALUE
        return F.when(long_enough, F.concat(acc["left"], F.array(piece(acc["at"], span["end"])))).otherwise(acc["left"])

    return F.aggregate(others, start, cut, rest)


def candidates(text: Column, base: Column) -> Column:
    """Spans of the strings that the models judge, without what base spans cover."""
    found = spans_of(text, CANDIDATE, "markov")
    return F.when(F.size(base) == 0, found).otherwise(F.flatten(F.transform(found, lambda s: left_over(s, base))))


def labelled_samples(texts: DataFrame) -> DataFrame:
    """Strings labelled by the patterns: (sample, random) from every row of texts (text, base)."""
    text, base = F.col("text"), F.col("base")
    secrets = F.transform(base, lambda s: F.regexp_replace(_cut(text, s), ASSIGN_KEY, ""))
    others = candidates(text, base)
    both = F.concat(
        F.transform(secrets, lambda x: F.struct(x.alias("sample"), F.lit(True).alias("random"))),
        F.transform(others, lambda s: F.struct(_cut(text, s).alias("sample"), F.lit(False).alias("random"))),
    )
    return texts.select(F.explode(both).alias("x")).select("x.sample", "x.random")


def least_ratio(counts: dict[bool, int], probability: float = LEAST_PROBABILITY) -> float:
    """The log-likelihood ratio from which a string is random with a probability, given samples of both kinds."""
    odds = (counts.get(False, 0) + 1) / (counts.get(True, 0) + 1)
    return math.log(odds) + math.log(probability / (1 - probability))


def ratio_table(samples: DataFrame, smoothing: float = SMOOTHING) -> tuple[list[float], dict[bool, int]]:
    """Log-likelihood ratios of ASCII pairs, at 128 * first + second, and the number of samples of each kind.

    The driver sees at most 2 * 128^2 counts. The first character counts as a pair with code 0 before it.
    """
    letters = F.filter(F.split("sample", ""), lambda c: c != "")
    letters = F.concat(F.array(F.lit(chr(0))), letters)
    pairs = samples.select("random", letters.alias("c")).filter(F.size("c") > 1)
    pairs = pairs.select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i)))).alias("pair")
    )
    codes = [F.ascii(F.substring("pair", k, 1)).alias(name) for k, name in ((1, "a"), (2, "b"))]
    counts = pairs.groupBy("random", "pair").count().select("random", *codes, "count").filter("a < 128 and b < 128")
    seen: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for row in counts.collect():
        seen[row.random][row.a, row.b] = row["count"]
    # every sample has one first character
    sizes = {label: sum(n for (a, _), n in seen[label].items() if a == 0) for label in seen}
    rows = {label: [sum(seen[label].get((a, b), 0) for b in range(128)) for a in range(128)] for label in seen}
    ends = {label: [sum(seen[label].get((a, b), 0) for a in range(128)) for b in range(128)] for label in seen}
    freed = {label: [sum(min(DISCOUNT, seen[label].get((a, b), 0)) for b in range(128)) for a in range(128)] for label in seen}

    def log_p(label: bool, a: int, b: int) -> float:
        single = (ends[label][b] + smoothing) / (sum(ends[label]) + 128 * smoothing)
        if not rows[label][a]:
            return math.log(single)
        kept = max(seen[label].get((a, b), 0) - DISCOUNT, 0)
        return math.log((kept + freed[label][a] * single) / rows[label][a] if freed[label][a] else single)

    return [log_p(True, a, b) - log_p(False, a, b) for a in range(128) for b in range(128)], sizes


def log_ratio(string: Column, ratios: list[float]) -> Column:
    """Sum of the ratios of a string's pairs of characters, its first one with code 0 before it."""
    known = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    letters = F.filter(F.split(string, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        more = F.when((acc["last"] >= 0) & (code < 128), F.get(known, acc["last"] * 128 + code)).otherwise(0.0)
        return F.struct(F.when(code < 128, code).otherwise(-1).alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(letters, start, add)["sum"]


def find_secrets(docs: DataFrame, probability: float = LEAST_PROBABILITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base and all spans as arrays of (start, kind, end).

    Every string of LEAST_VALUE characters and more is judged, in texts of any length, also what is left of
    one that a base span touches. Null texts are empty and have no spans; rows that repeat each get
    their spans; no rows give no rows. A table without base spans teaches nothing of random strings, so
    no spans are added to them.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text"))
    texts = texts.withColumn("base", base_spans(F.col("text")))
    ratios, sizes = ratio_table(labelled_samples(texts))
    if not sizes[True]:
        return texts.select("doc_id", "base", F.col("base").alias("spans"))
    least = least_ratio(sizes, probability)
    text, base = F.col("text"), F.col("base")
    judged = F.filter(candidates(text, base), lambda s: log_ratio(_cut(text, s), ratios) >= least)
    return texts.select("doc_id", "base", F.array_sort(F.concat(base, judged)).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the pattern spans, and all spans, of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
