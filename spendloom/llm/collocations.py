"""Phrase collocations from depth-truncated suffix subtrees, partitioned by word prefixes within a memory budget.

1. *Prefixes.* Every word is counted per language. A word that occurs more often than a group may hold is
   extended by its next words, pass by pass, until every prefix fits or has as many words as a phrase.
2. *Groups.* Prefixes are dealt to slots by a hash; slots, in order, fill groups up to the budget. The
   group of a suffix follows from its first words alone.
3. *Suffixes.* Every occurrence gives the words that follow it in its piece, as many as a phrase has, up to
   the first word that is too rare to stand in a candidate. Tasks count equal suffixes before they send
   them, so a passage that repeats without end is one row a chunk.
4. *Subtrees.* A group's suffixes, sorted, are the leaves of its subtrees; a node is a run of leaves with
   the same first words, and occurs as often as its leaves together. Groups are independent of each other.
5. *Scores.* Node counts are joined with those of both sides of every cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table, text_or_empty

#: Words of a phrase at most, occurrences of a candidate at least, and rows returned per language.
DEPTH = 5
LEAST = 100
TOP = 2000
#: Suffixes of a group, until there are MOST_GROUPS of them; then groups grow instead.
BUDGET = 1 << 20
MOST_GROUPS = 1 << 20
#: Slots of prefixes a group; more let groups fill evenly.
SLOTS_A_GROUP = 4
#: Words, and distinct words, that a task collects before it counts their suffixes; bound its memory.
CHUNK = 3_000_000
CHUNK_WORDS = 1_000_000
#: Bytes of a text cut into words at once, up to the next end of a piece.
SEGMENT = 8_000_000
#: Bits of the filter of frequent words; a wrong hit only costs work.
FILTER_BITS = 1 << 26
#: Parts in which each language's candidates are ranked first.
RANK_PARTS = 64
_BITMAP = 1 << 15
#: Ends a piece among the words; no UTF-8 text holds this byte.
_BREAK = b"\xff"
_TO_SPACE = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
_SUFFIXES = "grp int, lang string, words binary, places binary, counts binary"


def _key(lang: Column, phrase: Column) -> Column:
    """The hash of a language and a phrase; ``_hash`` gives the same."""
    return F.xxhash64(F.concat(lang, F.lit("\n"), phrase))


def _hash(lang: bytes, phrase: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\n" + phrase, 42)


class _Ids(dict):
    """Numbers of words in the order in which they are asked for; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _segments(text: bytes) -> Iterator[bytes]:
    """The text in parts that end with a piece."""
    start = 0
    while len(text) - start > SEGMENT:
        end = text.find(_BREAK, start + SEGMENT)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


@dataclass
class Chunk:
    """Words of one language with their numbers: ``places`` has them as they follow each other, 0 ends a piece."""

    lang: bytes
    ids: _Ids
    places: np.ndarray

    def __post_init__(self):
        self.words = list(self.ids)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Chunk]:
    """All words of batches (lang, text); no piece is cut."""
    ids: dict[bytes, _Ids] = {}
    places: dict[bytes, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[Chunk]:
        for lang in list(ids):
            yield Chunk(lang, ids.pop(lang), np.concatenate(places.pop(lang)))

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py().encode()
            for segment in _segments(text.as_py().encode().lower().translate(_TO_SPACE)):
                words = segment.replace(_BREAK, b" " + _BREAK + b" ").split()
                words.append(_BREAK)
                known = ids.setdefault(name, _Ids())
                places.setdefault(name, []).append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= most or sum(map(len, ids.values())) > CHUNK_WORDS:
                    yield from flush()
                    size = 0
    yield from flush()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col("text")).alias("text"))


def word_counts(docs: DataFrame, chunk_words: int = CHUNK) -> DataFrame:
    """(lang, phrase, n) of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_words):
            n = np.bincount(chunk.places, minlength=len(chunk.words))[1:]
            yield _counted(chunk.lang, chunk.words[1:], n)

    counted = _texts(docs).mapInArrow(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _counted(lang: bytes, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang.decode()] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
    return pa.record_batch(columns, ["lang", "phrase", "n"])


@dataclass(frozen=True)
class Partition:
    """The vertical partition of all suffixes, the same in every task.

    ``frequent`` has a bit set for the hash of every frequent word, ``heavy`` the prefixes that are
    extended (language, line end, phrase), ``groups`` the group of each slot.
    """

    frequent: np.ndarray
    heavy: frozenset[bytes] = frozenset()
    groups: np.ndarray | None = None

    def _frequent(self, chunk: Chunk, numbers: np.ndarray) -> np.ndarray:
        """For every word of the chunk whether it is frequent, as far as ``numbers`` asks; none is no word."""
        known, numbers = np.zeros(len(chunk.words), bool), numbers[numbers > 0]
        hashes = np.array([_hash(chunk.lang, chunk.words[i]) for i in numbers.tolist()], np.uint64)
        at = hashes & np.uint64(FILTER_BITS - 1)
        known[numbers] = (self.frequent[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return known

    def suffixes(self, chunk: Chunk, heavy_only: bool = False) -> np.ndarray:
        """For every occurrence that starts a phrase its words up to DEPTH, 0 after the last (DEPTH rows).

        With ``heavy_only`` those whose first word is heavy.
        """
        n, places = len(chunk.places), np.concatenate([chunk.places, np.zeros(DEPTH, np.int32)])
        if heavy_only:
            first = [key[len(chunk.lang) + 1 :] for key in self.heavy if key.startswith(chunk.lang + b"\n")]
            starting = np.zeros(len(chunk.words), bool)
            starting[[chunk.ids[w] for w in first if w in chunk.ids]] = True
            starts = np.flatnonzero(starting[chunk.places])
            asked = np.unique(places[starts + np.arange(1, DEPTH)[:, None]])
        else:
            starting, starts, asked = None, None, np.arange(len(chunk.words))
        known = self._frequent(chunk, asked)
        if starts is None:
            words = np.where(known[places], places, 0)
            starts = np.flatnonzero((words[:n] > 0) & (words[1 : n + 1] > 0))
        else:
            words = np.where(known[places] | starting[places], places, 0)
        found = np.zeros((DEPTH, len(starts)), np.int32)
        alive = np.ones(len(starts), bool)
        for depth in range(DEPTH):
            alive &= words[starts + depth] > 0
            found[depth] = np.where(alive, words[starts + depth], 0)
        return found

    def prefixes(self, chunk: Chunk, suffixes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        """Suffixes by the length of their prefix, the first that is not heavy.

        Gives the length, the suffixes (places of columns), for each which prefix it has, and the prefixes.
        Suffixes that end with a heavy prefix have none.
        """
        open_ones = np.arange(suffixes.shape[1])
        for depth in range(1, DEPTH + 1):
            open_ones = open_ones[suffixes[depth - 1, open_ones] > 0]
            if not len(open_ones):
                return
            first, which = _distinct(suffixes[:depth, open_ones], len(chunk.words))
            phrases = [b" ".join([chunk.words[i] for i in column]) for column in suffixes[:depth, open_ones[first]].T.tolist()]
            heavy = np.array([depth < DEPTH and chunk.lang + b"\n" + p in self.heavy for p in phrases], bool)
            light = ~heavy[which]
            yield depth, open_ones[light], which[light], phrases
            open_ones = open_ones[~light]


def _packed(columns: np.ndarray, words: int) -> list[np.ndarray]:
    """Columns of word numbers as few sorting keys, the last one the first to sort by."""
    bits = max(words.bit_length(), 1)
    width, keys = 63 // bits, []
    for at in range(0, len(columns), width):
        key = np.zeros(columns.shape[1], np.int64)
        for row in columns[at : at + width]:
            key = (key << bits) | row
        keys.append(key)
    return keys[::-1]


def _ordered(columns: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending order of columns, and which in that order differ from the one before."""
    keys = _packed(columns, words)
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([key[order[1:]] != key[order[:-1]] for key in keys])
    return order, new


def _distinct(columns: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal columns the place of one, and for each column which of those it equals; in ascending order."""
    order, new = _ordered(columns, words)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def extended_counts(docs: DataFrame, partition: object, depth: int, chunk_words: int = CHUNK) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``depth`` words that extend a heavy prefix; ``partition`` is broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_words):
            for length, _, which, phrases in partition.value.prefixes(chunk, partition.value.suffixes(chunk, heavy_only=True)):
                n = np.bincount(which, minlength=len(phrases))
                if length == depth:
                    kept = np.flatnonzero(n)
                    yield _counted(chunk.lang, [phrases[i] for i in kept], n[kept])

    counted = _texts(docs).mapInArrow(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_filter(words: DataFrame) -> np.ndarray:
    """One bit per hash of the words (lang, phrase), FILTER_BITS in all."""
    # the bits that suffixes() looks at, in bitmaps of _BITMAP bits each
    at = _key(F.col("lang"), F.col("phrase")).bitwiseAND(FILTER_BITS - 1)
    maps = words.select((at / _BITMAP).cast("long").alias("map"), (at % _BITMAP).alias("bit"))
    rows = maps.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        found[row["map"] * (_BITMAP // 8) : (row["map"] + 1) * (_BITMAP // 8)] = np.frombuffer(row["bits"], np.uint8)
    return found


def _slot_groups(prefixes: DataFrame, budget: int) -> np.ndarray:
    """The group of each slot; groups are slots in order up to the budget. Slots are a power of two."""
    total = prefixes.agg(F.sum("n")).first()[0] or 0
    slots = 1 << max(SLOTS_A_GROUP * total // budget, 1).bit_length()
    at = _key(F.col("lang"), F.col("phrase")).bitwiseAND(slots - 1)
    loads = np.zeros(slots, np.int64)
    # at most `slots` rows
    for row in prefixes.groupBy(at.alias("slot")).agg(F.sum("n").alias("n")).collect():
        loads[row["slot"]] = row["n"]
    groups, group, held = np.zeros(slots, np.int32), 0, 0
    for slot, load in enumerate(loads.tolist()):
        if held and held + load > budget:
            group, held = group + 1, 0
        groups[slot], held = group, held + load
    return groups


def suffix_rows(docs: DataFrame, partition: object, chunk_words: int = CHUNK) -> DataFrame:
    """All suffixes of two words or more by group and language, equal ones of a chunk counted; ``partition`` is broadcast.

    A row holds the suffixes that a chunk has for a group: their words (number 0 is none), DEPTH rows of
    word numbers, and counts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, groups, out = zstandard.ZstdCompressor(level=1).compress, partition.value.groups, []
        for chunk in _chunks(batches, chunk_words):
            suffixes = partition.value.suffixes(chunk)
            first, which = _distinct(suffixes, len(chunk.words))
            counts, suffixes = np.bincount(which, minlength=len(first)), suffixes[:, first]
            del which, first
            group = np.full(len(counts), -1, np.int32)
            for _, places, prefix, phrases in partition.value.prefixes(chunk, suffixes):
                slots = np.array([_hash(chunk.lang, p) & (len(groups) - 1) for p in phrases], np.int64)
                group[places] = groups[slots][prefix]
            order = np.argsort(group, kind="stable")
            order = order[np.searchsorted(group[order], 0) :]
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
            for start, end in zip(bounds, np.append(bounds, len(order))[1:], strict=True):
                at = order[start:end]
                numbers, places = np.unique(np.append(suffixes[:, at], 0), return_inverse=True)
                # frequent words get small numbers, which pack better; 0 stays none
                order_of = np.append(0, 1 + np.argsort(-np.bincount(places)[1:], kind="stable"))
                places = np.argsort(order_of)[places[:-1]]
                words = b" ".join([b"", *[chunk.words[i] for i in numbers[order_of[1:]]]])
                parts = words, _planes(places.astype("<i4")), _planes(counts[at].astype("<i8"))
                out.append((int(group[at[0]]), chunk.lang.decode(), *map(pack, parts)))
                if len(out) >= 200:
                    yield _suffix_batch(out)
                    out = []
        yield _suffix_batch(out)

    return _texts(docs).mapInArrow(rows, _SUFFIXES)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes first, which packs better."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["grp", "lang", "words", "places", "counts"])


def subtree_nodes(words: list[bytes], suffixes: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[bytes, int, int]]:
    """(phrase, words, n) of all phrases of two words or more that occur ``least`` times among counted suffixes.

    Sorted suffixes are the leaves of a suffix tree cut at DEPTH words; a node at a depth is a run of
    leaves with equal first words.
    """
    if not len(counts):
        return []
    order, new = _ordered(suffixes, len(words))
    leaves, totals = suffixes[:, order[new]], np.add.reduceat(counts[order], np.flatnonzero(new))
    found, starts_node = [], np.zeros(len(totals), bool)
    starts_node[0] = True
    for depth in range(1, DEPTH + 1):
        starts_node[1:] |= leaves[depth - 1, 1:] != leaves[depth - 1, :-1]
        starts = np.flatnonzero(starts_node)
        n = np.add.reduceat(totals, starts)
        if depth > 1:
            kept = (n >= least) & (leaves[depth - 1, starts] > 0)
            phrases = leaves[:depth, starts[kept]].T.tolist()
            found += [(b" ".join([words[i] for i in p]), depth, c) for p, c in zip(phrases, n[kept].tolist(), strict=True)]
    return found


def group_nodes(rows: DataFrame, partition: object, least: int) -> DataFrame:
    """(lang, phrase, size, n) of the nodes of every group's subtrees; heavy prefixes, which have parts in many groups, left out."""

    def of_group(key: tuple, rows: pa.Table) -> pa.Table:
        unpack, ids, suffixes, counts = zstandard.ZstdDecompressor().decompress, _Ids(), [], []
        del ids[_BREAK]
        for words, places, n in zip(rows["words"], rows["places"], rows["counts"], strict=True):
            numbers = np.fromiter(map(ids.__getitem__, unpack(words.as_py()).split(b" ")), np.int32)
            suffixes.append(numbers[_numbers(unpack(places.as_py()), "<i4")].reshape(DEPTH, -1))
            counts.append(_numbers(unpack(n.as_py()), "<i8"))
        found = subtree_nodes(list(ids), np.concatenate(suffixes, axis=1), np.concatenate(counts), least)
        lang = key[1].as_py()
        heavy, name = partition.value.heavy, lang.encode() + b"\n"
        found = [(lang, p.decode(), d, n) for p, d, n in found if d >= DEPTH or name + p not in heavy]
        columns = zip(*found, strict=True) if found else [[]] * 4
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "phrase", "size", "n"])

    return rows.groupBy("grp", "lang").applyInArrow(of_group, "lang string, phrase string, size int, n long")


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, budget: int = BUDGET, chunk_words: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of up to DEPTH words that occur ``least`` times, and (lang, n) of all words.

    ``budget`` is the number of suffixes that a group may hold, ``chunk_words`` of words that a task holds;
    results are the same for every value.
    """
    spark = docs.sparkSession
    words = stored(word_counts(docs, chunk_words), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    prefixes = frequent = words.filter(F.col("n") >= least)
    budget = max(budget, (words.agg(F.sum("n")).first()[0] or 0) // MOST_GROUPS)
    partition, held = Partition(_word_filter(frequent)), []
    nodes = frequent.select("lang", "phrase", F.lit(1).alias("size"), "n")
    for depth in range(1, DEPTH):
        # less than all words by the budget, so MOST_GROUPS a pass at most
        heavy = prefixes.filter(F.col("n") > budget)
        keys = frozenset((r["lang"] + "\n" + r["phrase"]).encode() for r in heavy.select("lang", "phrase").collect())
        if depth > 1:
            nodes = nodes.unionByName(heavy.filter(F.col("n") >= least).select("lang", "phrase", F.lit(depth).alias("size"), "n"))
        held.append(prefixes.filter(F.col("n") <= budget))
        if not keys:
            break
        partition = Partition(partition.frequent, partition.heavy | keys)
        prefixes = stored(extended_counts(docs, spark.sparkContext.broadcast(partition), depth + 1, chunk_words), f"prefixes-{depth + 1}")
    else:
        held.append(prefixes)
    loads = held[0]
    for more in held[1:]:
        loads = loads.unionByName(more)
    partition = spark.sparkContext.broadcast(Partition(partition.frequent, partition.heavy, _slot_groups(loads, budget)))
    found = group_nodes(suffix_rows(docs, partition, chunk_words), partition, least)
    return stored(nodes.unionByName(found), "phrases"), totals


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, chunk_words: int = CHUNK
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (lang, text) are split into pieces and words; a null text is empty, a null language ``und``.
    Rows that repeat count as often as they stand there. Phrases of 2 to DEPTH words that occur ``least``
    times are scored by their worst cut, in exact decimals of 38 digits; counts of more than 16 digits
    raise. Phrases that a longer one contains as often are left out. Ties are ordered by a and phrase,
    so ranks are repeatable. Tables without such a phrase give no rows.
    """
    phrases, totals = frequent_phrases(docs, least, budget, chunk_words)
    candidates = phrases.filter("size > 1").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    whole = lambda c: f"cast({c} AS decimal(16,0))"
    score = F.expr(f"cast(1000 AS decimal(4,0)) * {whole('a')} * {whole('total')} div ({whole('l')} * {whole('r')})")
    cuts = stored(cuts.select("lang", "phrase", "size", "a", "k", "l", "r", "first", "rest", F.col("total").alias("n"), score.alias("score")), "cuts")
    # a phrase that a longer one contains as often is also contained as often in one with one word more
    ends = [("rest", "r", F.col("k") == 1), ("first", "l", F.col("k") == F.col("size") - 1)]
    inside = [cuts.filter(at & (F.col(n) == F.col("a")) & (F.col("size") > 2)).select("lang", F.col(p).alias("phrase")) for p, n, at in ends]
    worst = F.min(F.struct("score", "k", "l", "r", "n")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.n", "worst.score")
    scored = scored.join(inside[0].unionByName(inside[1]).distinct(), ["lang", "phrase"], "left_anti")
    # the best of each part first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?
-
]')) AS piece
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM cut GROUP BY 1),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM cut WHERE len(words) > 0),
grams AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM starts, range(1, 6) AS s(size) WHERE i + size - 1 <= len(words)),
f AS (SELECT lang, phrase, size, count(*)::HUGEINT AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, k, string_split(c.phrase, ' ') AS words FROM f c, range(1, 5) AS r(k) WHERE k < c.size),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.n AS l, r.n AS r, t.n, 1000 * c.a * t.n // (l.n * r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    FROM f x WHERE x.lang = w.lang AND x.n = w.a AND x.size > len(string_split(w.phrase, ' '))
      AND contains(' ' || x.phrase || ' ', ' ' || w.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
