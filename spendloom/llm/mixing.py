"""Mixing sources to target weights along a time-varying curriculum; built-in functions only.

Each source's weight changes linearly over training; the integral of its schedule up to a time is the
number of words it must have given by then. A document stands at some cumulative word of its source,
in an order fixed by a hash; inverting the demand there gives its training position, and documents
are range-sorted by position. Cumulative words come from sums per block of the hash, so that no
task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, table, text_hash, text_or_empty

WEIGHTS = (5, 2, 1)
#: Slope of the schedule by place in WEIGHTS: 0.5 starts at half the mean weight and ends at 1.5 times.
TRENDS = (0.5, 0.0, -0.5)
#: A source gives at most so many times its words.
MOST_PASSES = 3
#: Hexadecimal digits of the hash that name a block: 4,096 blocks a source.
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _cycled(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, trends: tuple = TRENDS) -> DataFrame:
    """Per source: source_size, weight, trend, target.

    Targets share the words of all sources by weight, sources in code point order, null last. A target
    stops at MOST_PASSES times its source; the excess is shared again by weight. With sources in order
    of the level at which they stop, the shared level is known from sums over the ones before.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = totals.withColumn("place", F.row_number().over(by_name) - 1)
    named = named.withColumn("weight", _cycled(weights, F.col("place"))).withColumn("trend", _cycled(trends, F.col("place")))
    everything = Window.partitionBy()
    by_stop = Window.orderBy("stop", "place")
    here = by_stop.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = named.withColumn("most", F.col("source_size") * MOST_PASSES).withColumn("stop", F.col("most") / F.col("weight"))
    stops = stops.withColumn("rest_size", F.sum("source_size").over(everything) - F.sum("most").over(here))
    stops = stops.withColumn("rest_weight", F.sum("weight").over(everything) - F.sum("weight").over(here))
    # the level if this source and all before it stop; it holds up to the first source that does not
    level = F.when(F.col("rest_weight") > 0, F.col("rest_size") / F.col("rest_weight"))
    stops = stops.withColumn("level", level).withColumn("size_all", F.sum("source_size").over(everything))
    stops = stops.withColumn("weight_all", F.sum("weight").over(everything))
    stops = stops.withColumn("level_before", F.coalesce(F.lag("level").over(by_stop), F.col("size_all") / F.col("weight_all")))
    open_level = F.min(F.when(F.col("stop") > F.col("level_before"), F.struct("stop", "place", "level_before")))
    stops = stops.withColumn("shared", open_level.over(everything)["level_before"])
    target = F.when(F.col("stop") <= F.coalesce("shared", "stop"), F.col("most")).otherwise(F.col("shared") * F.col("weight"))
    return stops.select("source", "source_size", "weight", "trend", target.cast("double").alias("target"))


def schedule_time(demand: Column, target: Column, trend: Column) -> Column:
    """The time in 0..1 at which a source with this target and trend has given ``demand`` words.

    The schedule is target * (1 + trend * (2t - 1)); its integral target * ((1 - trend) t + trend t^2).
    """
    share = F.least(F.try_divide(demand, target), F.lit(1.0))
    flat = 1 - trend
    root = F.sqrt(flat * flat + 4 * trend * share)
    return F.when(trend == 0, share).otherwise(F.coalesce(F.try_divide(2 * share, flat + root), F.lit(0.0)))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, trends: tuple = TRENDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, positions, text_hash.

    A source gives whole passes over its documents and, of one more pass, the documents whose middle
    word lies in what is left: what it takes is within half a document of the target. ``positions``
    has one training position a copy; ``taken`` is size times copies. Rows come range-sorted by first
    position. Empty texts and sources of no words are never taken. Equal numbers share a hash and
    are taken in order of size; no rows give no rows.
    """
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            F.monotonically_increasing_id().alias("row"),
            text_hash(F.col("text")).alias("text_hash"),
            "source",
            word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).alias("hash"),
        ).withColumn("block", F.substring("hash", 1, BLOCK_DIGITS)),
        "sizes",
    )
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
    targets = source_targets(sized, weights, trends)
    b, t = blocks.alias("b"), targets.alias("t")
    offers = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "trend", "target").alias("o")
    s = sized.alias("s")
    same = F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.block") == F.col("o.block"))
    placed = s.join(offers, same).select("s.*", "earlier", "source_size", "trend", "target")

    in_block = Window.partitionBy("source", "block").orderBy("hash", "doc_id", "size", "row")
    before = F.coalesce(F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.col("earlier") + before + F.col("size") / 2
    passes = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    extra = middle < F.col("target") - passes * F.col("source_size")
    copies = F.when(F.col("size") > 0, passes + extra.cast("int")).otherwise(0).cast("int")
    placed = placed.withColumn("middle", middle).withColumn("copies", copies)
    position = lambda k: schedule_time(F.col("middle") + k * F.col("source_size"), F.col("target"), F.col("trend"))
    passes_made = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))
    positions = F.coalesce(F.transform(passes_made, position), F.array().cast("array<double>"))
    placed = placed.withColumn("positions", positions).withColumn("first", F.get("positions", F.lit(0)))
    out = placed.repartitionByRange("first", "row").sortWithinPartitions("first", "row")
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "positions", "text_hash"
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in order of first training position."""
    mixed = mix(table(spark, sf_dir, "documents"))
    first = F.round(F.get("positions", F.lit(0)), 6).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, [0.5::DOUBLE, 0.0, -0.5][place % 3 + 1] AS trend FROM s
), rounds AS (
  SELECT 0 AS round, CAST(sum(source_size) AS DOUBLE) / sum(weight) AS level FROM w
  UNION ALL
  SELECT r.round + 1,
         (SELECT (sum(source_size) - sum(CASE WHEN 3 * source_size / weight <= r.level THEN 3 * source_size ELSE 0 END))::DOUBLE
                 / nullif(sum(CASE WHEN 3 * source_size / weight <= r.level THEN 0 ELSE weight END), 0) FROM w)
  FROM rounds r WHERE r.round < 100 AND r.level IS NOT NULL
), final AS (
  SELECT level FROM rounds WHERE round = (SELECT max(round) FROM rounds)
), t AS (
  SELECT w.*, CASE WHEN level IS NULL OR 3 * source_size / weight <= level THEN CAST(3 * source_size AS DOUBLE)
                   ELSE level * weight END AS target
  FROM w, final
), p AS (
  SELECT d.*, t.source_size, t.trend, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT)
                 + CASE WHEN middle < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END END AS copies,
         least(middle / target, 1.0::DOUBLE) AS share
  FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       round(CASE WHEN copies = 0 THEN NULL WHEN trend = 0 THEN share
                  ELSE 2 * share / ((1 - trend) + sqrt((1 - trend) * (1 - trend) + 4 * trend * share)) END, 6) AS first_position
FROM c
"""
