"""What each filter removes in every order: count-weighted decision diagrams of failure masks.

A document's failure mask has one bit a filter. Masks are counted per part on Spark, at most 2^filters
rows a part; from there one small task a part works on a decision diagram: one level a filter, a pass
and a fail edge a node, counts at the ends, equal sub-diagrams shared. Swapping two adjacent levels
rebuilds only those two. Plain changes visit all orders by such swaps, and the path on which every
filter passes gives an order's steps: what its fail edges lead to is removed there.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_or_empty

FILTERS = "ABCDE"
#: Weights of a document: itself, labelled good, labelled toxic.
WEIGHTS = ("docs", "good", "toxic")
_WORDS, _TEXT = "__words", "__text"
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)

Weight = tuple[int, ...]


class Diagram:
    """A decision diagram of counted masks; ``order`` names the filter of each level.

    Levels are never skipped, so a node's weight is the sum of its two edges. ``levels[i]`` holds the
    nodes of a level as (pass, fail), places in the next level; the places of the last level are ``ends``.
    """

    def __init__(self, counts: Mapping[int, Weight], filters: str = FILTERS, width: int = len(WEIGHTS)):
        self.order = list(filters)
        self.zero: Weight = (0,) * width
        self.ends: list[Weight] = []
        self.levels: list[list[tuple[int, int]]] = [[] for _ in filters]
        places: list[dict] = [{} for _ in range(len(filters) + 1)]

        def build(level: int, mask: int) -> int:
            if level == len(filters):
                return self._place(places[level], tuple(counts.get(mask, self.zero)), self.ends)
            node = build(level + 1, mask), build(level + 1, mask | 1 << level)
            return self._place(places[level], node, self.levels[level])

        build(0, 0)

    @staticmethod
    def _place(known: dict, node, held: list) -> int:
        """The place of a node among those held; a new one is added."""
        if node not in known:
            known[node] = len(held)
            held.append(node)
        return known[node]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one; only these two are rebuilt."""
        below, rebuilt, known = self.levels[level + 1], [], {}
        for at, (passed, failed) in enumerate(self.levels[level]):
            (pp, pf), (fp, ff) = below[passed], below[failed]
            self.levels[level][at] = self._place(known, (pp, fp), rebuilt), self._place(known, (pf, ff), rebuilt)
        self.levels[level + 1] = rebuilt
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def weight(self, level: int, place: int) -> Weight:
        """What a node's paths weigh together."""
        if level == len(self.levels):
            return self.ends[place]
        return tuple(map(sum, zip(*(self.weight(level + 1, below) for below in self.levels[level][place]), strict=True)))

    def steps(self) -> list[tuple[Weight, Weight]]:
        """(kept, removed) of each level, down the path on which every filter passes."""
        found, place = [], 0
        for level, nodes in enumerate(self.levels):
            place, failed = nodes[place]
            found.append((self.weight(level + 1, place), self.weight(level + 1, failed)))
        return found


def plain_changes(n: int) -> Iterator[int]:
    """Swaps of a place with the next one that visit all orders of n things, the first order excluded."""
    if n < 2:
        return
    down = True
    for inner in [*plain_changes(n - 1), None]:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        if inner is not None:
            # the largest thing now stands first (the others one place on) or last
            yield inner + 1 if down else inner
        down = not down


def audit_part(counts: Mapping[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    diagram, orders = Diagram(counts, filters), []
    orders.append(("".join(diagram.order), diagram.steps()))
    for level in plain_changes(len(filters)):
        diagram.swap(level)
        orders.append(("".join(diagram.order), diagram.steps()))
    first, last, shapley = {}, {}, dict.fromkeys(filters, 0)
    for order, steps in orders:
        # a filter removes all that fail it where it comes first, and what fails no other where it comes last
        first[order[0]], last[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for letter, (_, removed) in zip(order, steps, strict=True):
            shapley[letter] += removed[0]
    return [
        (order, step, kept[0], gone[0], first[f] - gone[0], last[f], gone[1], gone[2], shapley[f])
        for order, steps in sorted(orders)
        for step, (f, (kept, gone)) in enumerate(zip(order, steps, strict=True), 1)
    ]


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters for every part of counted masks (part, mask, docs, good, toxic).

    Rows that repeat a part and mask add up; bit i of a mask is the i-th filter. No masks give no rows.
    """
    counted = masks.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {m: tuple(w) for m, *w in rows[["mask", *WEIGHTS]].itertuples(index=False)}
        return pd.DataFrame([(key[0], *row) for row in audit_part(counts, filters)], columns=[f.split()[0] for f in SCHEMA.split(", ")])

    # at most 2^filters rows a part
    return counted.groupBy("part").applyInPandas(of_part, SCHEMA)


def text_masks(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, digest of the text, and its failures of A to D as bits."""
    text = F.col(_TEXT)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_or_empty(F.col("text")).alias(_TEXT),
    )
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    rows = rows.withColumn(_WORDS, words)
    n, distinct = F.size(_WORDS), F.size(F.array_distinct(_WORDS))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    return rows.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), _bits(fails).alias("mask"))


def _bits(fails: Sequence[Column]) -> Column:
    return sum((F.when(fail, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, fail in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counted masks of documents (doc_id, text, source): part, mask, docs, good, toxic.

    A null text is empty, a null source the part ''. E fails for rows whose text a row with a smaller
    doc_id has, wherever that row is; rows without doc_id fail it never, and never make others fail. Of
    several labels of a document 1 counts; null labels, labels without doc_id and documents without
    label count as 0. Rows that repeat a doc_id each count, in every column. A text's copies are counted
    per part before copies meet, so a group of any size is a few rows there.
    """
    lost = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
    lost = lost.agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    ).withColumn("_numbered", F.lit(True))
    # rows without number find no label, and are dealt by their text
    rows = text_masks(docs).withColumns({"_numbered": F.col("doc_id").isNotNull(), "_id": F.coalesce("doc_id", F.xxhash64("digest"))})
    rows = rows.join(lost, ["_id", "_numbered"], "left").fillna(0, ["good", "toxic"])
    keys = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("_id", "_numbered", *keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    copies = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_null"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    copies = copies.withColumn("stay", F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0)))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("stay").alias("docs")),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("stay")).alias("docs")),
    )
    counted = copies.select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.docs > 0")
    docs_of = F.col("x.docs")
    return counted.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(docs_of).alias("docs"), F.sum(docs_of * F.col("good")).alias("good"), F.sum(docs_of * F.col("toxic")).alias("toxic")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over every part of the documents."""
    return audit_orders(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
labelled AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
          'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM cut LEFT JOIN labelled USING (doc_id)),
failed AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B
         WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed FROM masks),
counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, s::INT AS step, filter_order[s] AS f, list_slice(string_split(filter_order, ''), 1, s - 1) AS earlier
  FROM orders, range(1, 6) AS r(s)),
rows AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT list_has_any(failed, list_append(earlier, f)) THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN list_contains(failed, f) AND NOT list_has_any(failed, earlier) THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN list_contains(failed, f) AND list_has_any(failed, earlier) THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN failed = [f] THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN list_contains(failed, f) AND NOT list_has_any(failed, earlier) THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN list_contains(failed, f) AND NOT list_has_any(failed, earlier) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM rows
"""
