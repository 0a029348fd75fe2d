"""Hierarchical best-fit packing of token pieces into sequences of a fixed length.

Each level deals the items by hash to groups of bounded size and packs every group best-fit, longest
first. Nearly full bins are finished; the rest go up as items of the next, smaller level, where bins
of different groups meet. A level is a table (item, bin, offset); only numbers move, never texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty
from .tokenizing import BYTE_BPE, piece_ids

SEQUENCE = 2048
#: Items packed by one task; its memory and its share of the work.
GROUP_ITEMS = 50_000
#: A bin with no more free tokens than this is finished at once.
NEARLY_FULL = 4
#: Levels stop once one removes less than this share of the items.
LEAST_GAIN = 0.02
#: Bin numbers: level, then group, then place in the group.
_LEVEL, _GROUP = 1 << 58, 1 << 24


def token_pieces(
    docs: DataFrame,
    limit: int = SEQUENCE,
    vocabulary: str = BYTE_BPE,
    end_id: int = 0,
    vocabulary_path: str | None = None,
) -> DataFrame:
    """Pieces of every whole text of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32.

    A document is its ids and the end id; null and empty texts are the end id alone. Only documents
    longer than ``limit`` are cut; their first piece takes what does not fill whole ones.
    """
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(vocabulary, vocabulary_path)
        for batch in batches:
            numbers, texts, rows = batch.column(0).to_pylist(), batch.column(1), []
            for at in range(0, len(numbers), 64):
                encoded = encoder.encode(texts[at : at + 64].to_pylist())
                for number, ids in zip(numbers[at : at + 64], encoded, strict=True):
                    ids += end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n - start) % limit or limit
                        crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                        rows.append((number, piece, start, length, crc))
                        start, piece = start + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, taken in the given order, and the bins' fills.

    An item goes to the open bin with the least room that holds it. Bins are listed by room; a bit
    mask of the rooms in use finds the next larger one.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    mask, fills = 0, []
    for i, n in enumerate(lengths.tolist()):
        rooms = mask >> n
        if rooms:
            room = n + (rooms & -rooms).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, at = limit, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, limit - room
        fills[at] += n
        if room > n:
            by_room[room - n].append(at)
            mask |= 1 << (room - n)
    return bins, offsets, fills


def _packed(items: DataFrame, groups: int, level: int, limit: int) -> DataFrame:
    """Items (item, length) with bin, offset and the bin's fill, packed in groups."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "item"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(rows["length"].to_numpy(), limit)
        first = level * _LEVEL + int(rows["grp"].iloc[0]) * _GROUP
        return pd.DataFrame(
            {"item": rows["item"], "bin": first + bins, "offset": offsets, "fill": np.array(fills, np.int64)[bins]}
        )

    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, "item long, bin long, offset long, fill long")


def pack_items(
    items: DataFrame, limit: int = SEQUENCE, group_items: int = GROUP_ITEMS, nearly_full: int = NEARLY_FULL
) -> DataFrame:
    """Items (item: unique number, length: 1 to ``limit``) with sequence_id and offset.

    Offsets of a sequence leave no gap. No items give no rows.
    """
    levels: list[DataFrame] = []
    todo, n = items, items.count()
    while n:
        groups = -(-n // group_items)
        packed = stored(_packed(todo, groups, len(levels) + 1, limit), f"pack-{len(levels)}")
        levels.append(packed)
        if groups == 1:
            break
        open_bins = packed.filter(F.col("fill") < limit - nearly_full)
        todo = open_bins.groupBy(F.col("bin").alias("item")).agg(F.min("fill").alias("length"))
        before, n = n, todo.count()
        if n > (1 - LEAST_GAIN) * before:
            break
    if not levels:
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # from the top: where each bin ended up
    placed = levels[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for level in reversed(levels[:-1]):
        above = placed.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base"))
        placed = level.join(above, "bin", "left").select(
            "item",
            F.coalesce("sequence_id", "bin").alias("sequence_id"),
            (F.coalesce("base", F.lit(0)) + F.col("offset")).alias("offset"),
        )
    return placed


def pack_documents(docs: DataFrame, limit: int = SEQUENCE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it.

    Rows that repeat a document number are packed as documents of their own.
    """
    pieces = stored(token_pieces(docs, limit).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(pieces.select("item", "length"), limit, group_items)
    return pieces.join(placed, "item").drop("item")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
