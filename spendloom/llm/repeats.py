"""Repeated strings across all documents, and documents without them.

Every string of the least length has an anchor, the run of some bytes within it with the smallest hash
(``suffixes.anchored``). Equal strings have equal anchors, so a string whose anchor occurs once does
not repeat. So:

1. Texts give the hashes of their anchors; equal texts become one class. Hashes that occur once go.
2. Documents that keep some give segments: the runs of strings with one anchor that may still repeat.
3. Equal segments become one with a count. Segments of one anchor that differ are sorted into an
   enhanced suffix array; its prefix intervals with diverse left bytes are the maximal repeats.
4. An anchor that very many different segments share is split by where strings lie around it and by
   the bytes that all of them then have in common, in the end by the whole string.
5. Repeats, with all occurrences, go back to their documents, where they are removed.

Texts move once; afterwards only anchors, segments that may repeat, and spans do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty
from .suffixes import anchored, maximal_repeats


@dataclass(frozen=True)
class Settings:
    """length: of the strings; gram: bytes of an anchor; many: segments of an anchor that one task sorts.

    widths: strings around an anchor that stay together when it has more, level by level, last 1.
    """

    length: int = 200
    gram: int = 48
    many: int = 2_000
    widths: tuple[int, ...] = (16, 1)
    scan_bytes: int = 1 << 20


SEGMENT = "key long, node long, start long, n long, anchor int, id binary, segment binary"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _id(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))


def _anchors(texts: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_bytes, sha256, digest and the anchors' hashes of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _bytes(text.as_py())
                last, hashes = -1, []
                for _, place, found in anchored(np.frombuffer(data, np.uint8), settings.length, settings.gram):
                    new = np.flatnonzero(np.diff(place, prepend=last))
                    hashes.append(found[new])
                    last = place[-1]
                sha = hashlib.sha256(data)
                rows.append((number, len(data), sha.hexdigest(), sha.digest()[:16], np.concatenate(hashes) if hashes else []))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "sha256", "digest", "anchors"])

    return texts.mapInArrow(find, "doc_id long, n_bytes long, sha256 string, digest binary, anchors array<long>")


def _packed(texts: DataFrame) -> DataFrame:
    """digest and compressed bytes of every text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                data = [_bytes(t.as_py()) for t in batch.column(0)[at : at + 500]]
                digests = pa.array([hashlib.sha256(d).digest()[:16] for d in data], pa.binary())
                yield pa.record_batch([digests, pa.array(map(compress, data), pa.binary())], ["digest", "data"])

    return texts.select("text").mapInArrow(pack, "digest binary, data binary")


def _segments(touched: DataFrame, settings: Settings) -> DataFrame:
    """Runs of strings that may repeat, of touched (node, n, data, shared hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for node, n, data, shared in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = unpack(data.as_py()) if len(data.as_py()) else b""
                known = np.asarray(shared.values.to_numpy(zero_copy_only=False))
                rows: list[tuple] = []
                for first, place, hashes in anchored(np.frombuffer(data, np.uint8), settings.length, settings.gram):
                    good = np.isin(hashes, known)
                    edges = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (good[1:] != good[:-1]), [True]]))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        if good[a]:
                            begin = first + a
                            part = data[begin : first + b - 1 + settings.length]
                            rows.append((int(hashes[a]), begin, int(place[a]) - begin, _id(part), part))
                for at in range(0, len(rows), 2_000):
                    yield _segment_batch(rows[at : at + 2_000], node.as_py(), n.as_py())

    return touched.select("node", "n", "data", "shared").mapInArrow(cut, SEGMENT)


def _segment_batch(rows: list[tuple], node: int, n: int) -> pa.RecordBatch:
    key, start, anchor, ids, part = zip(*rows, strict=True)
    columns = [
        pa.array(key, pa.int64()),
        pa.array([node] * len(rows), pa.int64()),
        pa.array(start, pa.int64()),
        pa.array([n] * len(rows), pa.int64()),
        pa.array(anchor, pa.int32()),
        pa.array(ids, pa.binary()),
        pa.array(part, pa.binary()),
    ]
    return pa.record_batch(columns, ["key", "node", "start", "n", "anchor", "id", "segment"])


def _covered(found: list, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, start in it and length of the stretches that occurrences of repeats cover together."""
    at = np.array([p for r in found for p in r.occurrences], np.int64)
    stop = at + np.array([r.length for r in found for _ in r.occurrences], np.int64)
    order = np.argsort(at, kind="stable")
    at, stop = at[order], stop[order]
    owner = np.searchsorted(ends, at, side="right")
    reached = np.maximum.accumulate(stop)  # occurrences end within their segment
    first = np.flatnonzero(np.concatenate([[True], (at[1:] > reached[:-1]) | (owner[1:] != owner[:-1])])[: len(at)])
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    return owner[first], at[first] - begins[owner[first]], reached[last] - at[first]


def _scanned(segments: DataFrame, settings: Settings, listed: bool) -> DataFrame:
    """Maximal repeats of distinct segments (key, id, segment), anchor by anchor: id, start, length, repeat.

    ``listed`` gives a row for each occurrence of each repeat, named by its string; else a row for each
    stretch of a segment that repeats cover, which grows with the segments alone.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[bytes] = []
        parts: list[bytes] = []
        size, last = 0, None

        def repeats() -> pa.RecordBatch:
            found, begins, ends = maximal_repeats(parts, settings.length)
            if not listed:
                owner, start, length = _covered(found, begins, ends)
                none = pa.nulls(len(owner), pa.binary())
                covered = [pa.array([ids[i] for i in owner.tolist()], pa.binary()), pa.array(start), pa.array(length), none]
                return pa.record_batch(covered, ["id", "start", "length", "repeat"])
            at = np.array([p for r in found for p in r.occurrences], np.int64)
            owner = np.searchsorted(ends, at, side="right")
            names = [_id((parts[o])[p - b : p - b + r.length]) for r in found for o, b, p in _first(r, begins, ends)]
            columns = [
                pa.array([ids[i] for i in owner.tolist()], pa.binary()),
                pa.array(at - begins[owner], pa.int64()),
                pa.array([r.length for r in found for _ in r.occurrences], pa.int64()),
                pa.array([name for r, name in zip(found, names, strict=True) for _ in r.occurrences], pa.binary()),
            ]
            return pa.record_batch(columns, ["id", "start", "length", "repeat"])

        for batch in batches:
            for key, name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if size >= settings.scan_bytes and key != last:
                    yield repeats()
                    ids, parts, size = [], [], 0
                ids.append(name)
                parts.append(part.as_py())
                size, last = size + len(parts[-1]), key
        yield repeats()

    placed = segments.select("key", "id", "segment").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(scan, "id binary, start long, length long, repeat binary")


def _first(repeat, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    place = repeat.occurrences[0]
    owner = int(np.searchsorted(ends, place, side="right"))
    return [(owner, int(begins[owner]), place)]


def _split(segments: DataFrame, width: int, settings: Settings) -> DataFrame:
    """Segments cut where strings lie ``width`` apart around the anchor, keyed by what those have in common."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = settings.length
        for batch in batches:
            key, n, anchor, ids, parts = (batch.column(i).to_pylist() for i in range(5))
            rows = []
            for k, count, place, parent, part in zip(key, n, anchor, ids, parts, strict=True):
                begin, stop = 0, len(part) - length + 1
                while begin < stop:
                    step = (place - begin) // width  # strings that start here lie this far before the anchor
                    end = min(stop, place - step * width + 1)
                    low, high = place - step * width, place - (step + 1) * width + 1 + length
                    piece = part[begin : end - 1 + length]
                    common = _id(b"%d %d " % (k, step) + part[low:high])
                    new_key = int.from_bytes(common[:8], "little", signed=True)
                    rows.append((new_key, parent, begin, count, place - begin, _id(piece), piece))
                    begin = end
            for at in range(0, len(rows), 2_000):
                columns = list(zip(*rows[at : at + 2_000], strict=True))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["key", "parent", "start", "n", "anchor", "id", "segment"],
                )

    schema = "key long, parent binary, start long, n long, anchor int, id binary, segment binary"
    return segments.select("key", "n", "anchor", "id", "segment").mapInArrow(split, schema)


def _distinct(segments: DataFrame) -> DataFrame:
    return segments.groupBy("key", "id", "segment").agg(F.sum("n").alias("n"), F.min("anchor").alias("anchor"))


def _repeats(distinct: DataFrame, settings: Settings, widths: tuple[int, ...], listed: bool) -> DataFrame:
    """Repeats in distinct segments: id, start, length, repeat, as in ``_scanned``."""
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    whole = distinct.filter("n > 1").select(
        "id", F.lit(0).cast("long").alias("start"), F.length("segment").cast("long").alias("length"), F.col("id").alias("repeat")
    )
    shared = stored(distinct.join(sizes, "key"), "shared-segments")
    found = whole.unionByName(_scanned(shared.filter(F.col("size") <= settings.many), settings, listed))
    crowded = shared.filter(F.col("size") > settings.many)
    if widths and not crowded.isEmpty():
        pieces = stored(_split(crowded, widths[0], settings), "split-segments")
        inner = _repeats(stored(_distinct(pieces), "distinct-segments"), settings, widths[1:], listed)
        inner = inner.withColumnRenamed("start", "inside")
        back = pieces.select("id", "parent", "start").join(inner, "id")
        found = found.unionByName(
            back.select(F.col("parent").alias("id"), (F.col("start") + F.col("inside")).alias("start"), "length", "repeat")
        )
    return found


def repeated_strings(
    docs: DataFrame, settings: Settings = Settings(), *, listed: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Maximal repeats of (doc_id, text): rows, touched classes, and occurrences.

    rows: doc_id, n_bytes, sha256, digest of every row. touched: node, digest, n (rows with this text),
    data (compressed bytes) of texts with repeats. occurrences: node, start, length, repeat (names the
    repeated string, or a segment that occurs in full elsewhere; without ``listed`` stretches that
    repeats cover, without names). Texts shorter than the least
    length, null and empty ones hold no repeats; equal texts, repeated rows too, repeat in full.
    """
    texts = _texts(docs)
    rows = stored(_anchors(texts, settings), "anchors")
    classes = rows.filter(F.size("anchors") > 0).groupBy("digest")
    classes = classes.agg(F.count(F.lit(1)).alias("n"), F.first("anchors").alias("anchors"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "text-classes")
    hashes = classes.select("node", "n", F.explode("anchors").alias("hash"))
    shared = hashes.groupBy("hash").agg(F.sum("n").alias("times")).filter("times > 1").select("hash")
    kept = hashes.join(shared, "hash").groupBy("node").agg(F.collect_set("hash").alias("shared"))
    wanted = classes.select("node", "n", "digest").join(kept, "node")
    data = _packed(texts).dropDuplicates(["digest"])
    touched = stored(data.join(wanted.hint("merge"), "digest"), "touched-texts", codec="none")
    segments = stored(_segments(touched, settings), "segments")
    found = _repeats(stored(_distinct(segments), "distinct-segments"), settings, settings.widths, listed)
    spots = segments.select("node", "id", F.col("start").alias("at"))
    occurrences = spots.join(found, "id").select("node", (F.col("at") + F.col("start")).alias("start"), "length", "repeat")
    return rows, touched, occurrences


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Every byte within a string of the least length that also starts elsewhere is removed. ``kept`` is
    what is left as bytes, null for rows that lose nothing.
    """
    rows, touched, occurrences = repeated_strings(docs, settings, listed=False)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for digest, data, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = unpack(data)
                kept, end, runs, removed = [], 0, 0, 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    start, stop = s["start"], s["stop"]
                    if start > end or not runs:
                        kept.append(data[end:start])
                        runs += 1
                        end = start
                    removed += max(0, stop - end)
                    end = max(end, stop)
                kept.append(data[end:])
                left = b"".join(kept)
                row = [[digest], [removed], [runs], [hashlib.sha256(left).hexdigest()], [left]]
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch(
                    [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["digest", "n_removed", "n_spans", "kept_sha256", "kept"]
                )

    spans = occurrences.groupBy("node", "start").agg(F.max("length").alias("length")).groupBy("node")
    spans = spans.agg(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))).alias("spans"))
    schema = "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = touched.select("node", "digest", "data").join(spans, "node").select("digest", "data", "spans").mapInArrow(remove, schema)
    out = rows.select("doc_id", "n_bytes", "sha256", "digest").join(changed, "digest", "left")
    nothing = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", nothing).alias("n_removed"),
        F.coalesce("n_spans", nothing).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        "kept",
    )


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated strings of 200 bytes leaves of every document."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
