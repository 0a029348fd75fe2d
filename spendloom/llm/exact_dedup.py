"""Exact deduplication by content-defined chunk recipes; built-in functions only.

A text is cut where its own characters say so, each chunk gets an identifier, and documents are equal
when their ordered lists of identifiers are. Identifiers are verified: chunk contents are gathered
once per distinct content, and contents that share an identifier get ordinals. From then on only
lists of numbers move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, stored, table, text_hash, text_or_empty

#: A chunk ends behind one of these endings, at 512 characters at least and 8,192 at most.
CHUNK = r"(?s).{509,8189}?[nrs][ ,.]\x20|.{1,8192}"
#: Runs of white space other than one plain space.
_UNEVEN = rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]*[\x09-\x0D][{SPACE}]*|\x20{{2,}}"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), _UNEVEN, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_groups(docs: DataFrame, chunk_id: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Of equal texts the smallest doc_id stays (null only if all are); of rows that repeat this number
    too, one. ``text_hash`` is that of the text as it is. Empty and null texts are equal; no rows give no
    rows. ``chunk_id`` maps a chunk to 64 bits; it may collide.
    """
    texts = docs.select(
        F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("text_hash"), normalised(F.col("text")).alias("text")
    )
    listed = texts.select("doc_id", "text_hash", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    ids = F.transform("chunks", lambda c: chunk_id(c)).alias("recipe")
    recipes = listed.select("doc_id", "text_hash", "text_sha256", ids, F.monotonically_increasing_id().alias("row"))
    recipes = stored(recipes, "recipes")
    contents = listed.select(F.explode("chunks").alias("chunk")).select(chunk_id(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = stored(contents.groupBy("id").count().filter("count > 1").select("id"), "shared-ids")
    if not shared.isEmpty():
        recipes = recipes.join(_ordinals(listed, contents, shared), "text_sha256", "left")
    else:
        recipes = recipes.withColumn("ordinals", F.lit(None).cast("array<struct<place:int,ordinal:int>>"))

    # lists of one group meet after a partial aggregate; the join back is split by the adaptive planner
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    groups = recipes.groupBy("recipe", "ordinals").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    r, g = recipes.alias("r"), groups.alias("g")
    same = (F.col("r.recipe") == F.col("g.recipe")) & F.col("r.ordinals").eqNullSafe(F.col("g.ordinals"))
    return r.join(g, same).select(
        "r.doc_id",
        F.col("g.first.doc_id").alias("keep_id"),
        "g.group_size",
        (F.col("r.row") == F.col("g.first.row")).alias("kept"),
        "r.text_sha256",
        "r.text_hash",
    )


def _ordinals(listed: DataFrame, contents: DataFrame, shared: DataFrame) -> DataFrame:
    """Per text with chunks whose identifier stands for several contents: place and ordinal of each."""
    by_content = Window.partitionBy("id").orderBy("chunk")
    numbered = contents.join(shared, "id", "left_semi").withColumn("ordinal", F.row_number().over(by_content))
    places = listed.select("text_sha256", F.posexplode("chunks").alias("place", "chunk")).distinct()
    found = places.join(numbered, "chunk").groupBy("text_sha256")
    return found.agg(F.array_sort(F.collect_list(F.struct("place", "ordinal"))).alias("ordinals"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
