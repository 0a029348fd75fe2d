"""Token ids as seekable zstandard files: one independent frame per document, seek table last.

A file holds, in ascending order of document number:

1. one zstandard frame per document, with content size and content checksum; its content is the
   document's ids as little-endian unsigned 32-bit integers;
2. a skippable frame 0x184D2A51 with the document numbers: per document a signed 64-bit integer
   and, after all of them, one byte that is 1 where the number is null;
3. the seek table of the public seekable format: a skippable frame 0x184D2A5E with compressed
   size, content size and checksum (low half of XXH64 of the content) of every frame before it,
   then the footer (number of frames, descriptor 0x80, magic 0x8F92EAB1).

After each of them stands an empty skippable frame, which belongs to the frame before it. The whole
file is an ordinary zstandard stream. Spark's text writer puts these empty frames there as its line
separator, so files go through Spark's commit protocol to any store that Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, table, text_or_empty
from .tokenizing import WORD_BPE, piece_ids

#: Fixed values of the public zstandard and seekable formats.
EMPTY_FRAME = b"P*M\x18\x00\x00\x00\x00"
NUMBERS_MAGIC = 0x184D2A51
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

READ_SCHEMA = "file string, place int, doc_id long, before long, n_tokens long, ids_crc32 long"


class CorruptFrame(ValueError):
    """Bytes that do not match their checksum or the format."""


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def file_parts(documents: Iterable[tuple[int | None, bytes]]) -> Iterator[bytes]:
    """The parts of one file, without the empty frames that the writer puts after each."""
    compress = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress
    entries, numbers, nulls = [], [], bytearray()
    for number, ids in documents:
        frame = compress(ids)
        entries.append((len(frame) + len(EMPTY_FRAME), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        numbers.append(0 if number is None else number)
        nulls.append(number is None)
        yield frame
    listed = _skippable(NUMBERS_MAGIC, np.array(numbers, dtype="<i8").tobytes() + bytes(nulls))
    entries.append((len(listed) + len(EMPTY_FRAME), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    yield listed
    footer = struct.pack("<IBI", len(entries), CHECKSUMS, FOOTER_MAGIC)
    yield _skippable(TABLE_MAGIC, np.array(entries, dtype="<u4").tobytes() + footer)


class TokenFile:
    """One file's seek table; decompresses only the documents asked for."""

    def __init__(self, content: bytes | memoryview):
        self.content = memoryview(content)
        end = len(self.content) - len(EMPTY_FRAME)
        if end < 17 or self.content[end:] != EMPTY_FRAME:
            raise CorruptFrame("no file end")
        frames, descriptor, magic = struct.unpack("<IBI", self.content[end - 9 : end])
        start = end - 9 - 12 * frames
        if magic != FOOTER_MAGIC or descriptor != CHECKSUMS or start < 8:
            raise CorruptFrame("no seek table")
        if struct.unpack("<II", self.content[start - 8 : start]) != (TABLE_MAGIC, end - start):
            raise CorruptFrame("no seek table")
        entries = np.frombuffer(self.content[start : end - 9], dtype="<u4").reshape(frames, 3)
        ends = np.cumsum(entries[:, 0], dtype=np.int64)
        self.starts, self.ends = ends[:-1] - entries[:-1, 0], ends[:-1] - len(EMPTY_FRAME)
        self.sizes, self.sums = entries[:-1, 1].astype(np.int64), entries[:-1, 2]
        n, numbers = frames - 1, self.content[ends[-1] - entries[-1, 0] + 8 :]
        nulls = numbers[8 * n : 9 * n]
        values = np.frombuffer(numbers[: 8 * n], dtype="<i8").tolist()
        self.numbers = [None if null else v for v, null in zip(values, nulls, strict=True)]
        self.before = np.cumsum(self.sizes // 4) - self.sizes // 4
        self._decompress = zstandard.ZstdDecompressor().decompress

    def ids(self, place: int) -> bytes:
        """The ids of the document at a place, checked against both checksums."""
        try:
            found = self._decompress(self.content[self.starts[place] : self.ends[place]])
        except zstandard.ZstdError as error:
            raise CorruptFrame(str(error)) from error
        if len(found) != self.sizes[place] or xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.sums[place]:
            raise CorruptFrame(f"frame {place}")
        return found

    def tokens(self) -> int:
        return int(self.sizes.sum() // 4)


def write_token_frames(
    docs: DataFrame, path: str, vocabulary: str = WORD_BPE, end_id: int = 2, vocabulary_path: str | None = None
) -> None:
    """Encode every whole ``text`` of ``docs`` (doc_id, text) and write files to a new folder.

    Files follow each other in ascending doc_id (null first; equal numbers by a hash of the text).
    Null and empty texts hold the end id alone. Every row gets a frame, repeated rows too.
    """
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(vocabulary, vocabulary_path)

        def documents():
            for batch in batches:
                numbers, texts = batch.column(0).to_pylist(), batch.column(1)
                for at in range(0, len(numbers), 64):
                    ids = encoder.encode(texts[at : at + 64].to_pylist())
                    yield from zip(numbers[at : at + 64], (i + end for i in ids), strict=True)

        part: list[bytes] = []
        size = 0
        for frame in file_parts(documents()):
            part.append(frame)
            size += len(frame)
            if size > 4_000_000:
                yield pa.record_batch([pa.array(part, pa.binary())], ["frame"])
                part, size = [], 0
        yield pa.record_batch([pa.array(part, pa.binary())], ["frame"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty(F.col("text")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    frames = placed.select("doc_id", "text").mapInArrow(encode, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME.decode()).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_token_frames(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """One row per document: file, place in it, doc_id, ids before it in the file, and its ids.

    With ``doc_ids`` only those documents are decompressed.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, f in _opened(batches):
            places = [i for i, n in enumerate(f.numbers) if wanted is None or n in wanted]
            for at in range(0, len(places), 500):
                rows = [(name, i, f.numbers[i], int(f.before[i]), f.ids(i)) for i in places[at : at + 500]]
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["f", "p", "d", "b", "i"]).cast(
                    pa.schema([("f", pa.string()), ("p", pa.int32()), ("d", pa.int64()), ("b", pa.int64()), ("i", pa.binary())])
                )

    return _files(spark, path).mapInArrow(read, "file string, place int, doc_id long, before long, ids binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, TokenFile]]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            yield name.as_py(), TokenFile(content.as_buffer())


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def totals(batches):
        for name, f in _opened(batches):
            yield pa.record_batch([pa.array([name]), pa.array([f.tokens()], pa.int64())], ["file", "tokens"])

    def digests(batches):
        for name, f in _opened(batches):
            n = len(f.numbers)
            columns = [
                pa.array([name] * n, pa.string()),
                pa.array(range(n), pa.int32()),
                pa.array(f.numbers, pa.int64()),
                pa.array(f.before, pa.int64()),
                pa.array(f.sizes // 4, pa.int64()),
                pa.array((zlib.crc32(f.ids(i)) for i in range(n)), pa.int64()),
            ]
            yield pa.record_batch(columns, ["file", "place", "doc_id", "before", "n_tokens", "ids_crc32"])

    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    files = _files(spark, path).mapInArrow(totals, "file string, tokens long").withColumn("part", part)
    files = files.select("file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("earlier"))
    rows = _files(spark, path).mapInArrow(digests, READ_SCHEMA)
    return rows.join(files, "file").select(
        "doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "place"
    )


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write seekable files to shared storage, and report from those files."""
    path = scratch(spark, "token-frames")
    write_token_frames(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
