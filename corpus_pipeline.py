"""A training corpus from raw documents: five stages, each by one operator of ``spendloom.llm``.

Every stage takes all documents that its predecessor kept, as a Parquet table, and its decisions take
effect. All but the last return the columns of the documents; the last returns packed pieces.
Rows are told apart by doc_id and a hash of their text, so tables may repeat numbers. No documents
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm.common import stored, table, text_hash
from spendloom.llm.exact_dedup import exact_groups
from spendloom.llm.mixing import mix
from spendloom.llm.near_dedup import near_duplicates
from spendloom.llm.packing import pack_documents
from spendloom.llm.toxicity import THRESHOLD, train

#: Column names of the stages' own, taken off again.
_ID, _HASH, _WANTED_ID, _WANTED_HASH, _SCORE, _PLACE = (f"__{x}" for x in ("id", "hash", "wanted_id", "wanted_hash", "score", "place"))


def _matched(docs: DataFrame, wanted: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a row of ``wanted`` of the same (doc_id, text_hash), with its other columns.

    Of rows that repeat both, one. ``all_rows`` has the (doc_id, text_hash) of every row; ``wanted``
    has none twice.
    """
    marked = docs.withColumns({_ID: F.col("doc_id").cast("long"), _HASH: text_hash(F.col("text"))})
    wanted = wanted.withColumnsRenamed({"doc_id": _WANTED_ID, "text_hash": _WANTED_HASH})
    same = F.col(_ID).eqNullSafe(F.col(_WANTED_ID)) & (F.col(_HASH) == F.col(_WANTED_HASH))
    found = marked.join(wanted, same)
    again = stored(all_rows.groupBy("doc_id", "text_hash").count().filter("count > 1"), "repeated-rows")
    if not again.isEmpty():
        again = again.select(F.col("doc_id").alias("__again_id"), F.col("text_hash").alias("__again_hash"))
        repeated = F.col(_ID).eqNullSafe(F.col("__again_id")) & (F.col(_HASH) == F.col("__again_hash"))
        once = found.join(again, repeated, "left_semi").dropDuplicates([_ID, _HASH])
        found = found.join(again, repeated, "left_anti").unionByName(once)
    return found.drop(_ID, _HASH, _WANTED_ID, _WANTED_HASH)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    A null text is scored as an empty one and stays null; rows of equal texts score alike, whatever their
    number, and rows that repeat each stay or go. Texts of any length are scored whole. Without labels every
    document stays; no documents give none. All columns of the documents are kept, whatever their names.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, _SCORE).filter(F.col(_SCORE) < THRESHOLD).drop(_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the row with the smallest doc_id, rows without number last.

    Null and empty texts are one group. Of rows that repeat number and text one stays. Texts of any length
    are compared whole; no documents give none, and all columns are kept.
    """
    groups = stored(exact_groups(docs).select("doc_id", "text_hash", "kept"), "kept-texts")
    return _matched(docs, groups.filter("kept").select("doc_id", "text_hash").distinct(), groups)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the row with the smallest doc_id.

    Null texts and texts without words are like no other and stay. Rows without number stay only where their
    component has no number; of rows that repeat number and text one stays. Texts of any length are compared
    whole; no documents give none, and all columns are kept.
    """
    found = stored(near_duplicates(docs).select("doc_id", "text_hash", "kept"), "kept-components")
    return _matched(docs, found.filter("kept").select("doc_id", "text_hash").distinct(), found)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, in order of training position.

    Documents without words have no size and are not taken; a null source is a source of its own, the last.
    Documents are taken in the order of a hash of their number, equal numbers by size, so reruns agree; rows
    that repeat number and text share all their copies. No documents give none, and all columns are kept.
    """
    taken = stored(mix(docs).select("doc_id", "text_hash", "positions"), "positions")
    # rows that repeat number and text are one row with all their copies
    places = taken.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("positions")).alias(_PLACE))
    placed = _matched(docs, places.filter(F.size(_PLACE) > 0), taken).withColumn(_PLACE, F.explode(_PLACE))
    return placed.repartitionByRange(_PLACE).sortWithinPartitions(_PLACE).drop(_PLACE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.

    A null or empty text is its end token alone; only texts longer than a sequence are cut. Rows that repeat a
    number, as copies taken by the mix do, are packed as documents of their own. No documents give no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("source mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the language models nor the packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{place}")
    return docs
