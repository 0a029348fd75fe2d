"""Near duplicates by fast similarity sketches, banding and exact verification.

1. Each text becomes its set of word shingles and a sketch of 560 coordinates in 56 bands of 10 rows.
   Two sets of similarity 0.85 share no band with probability (1 - 0.85^10)^56, below 1 in 200,000.
2. Equal sets become one class; only classes go on. Bands that several classes share are buckets.
3. Small buckets give their pairs. In a larger one, sketches estimate all similarities, and only the
   links of a spanning forest of the likely pairs go on, so a large group of copies costs a row a
   member. A pair is weighed in one bucket only. Very large buckets are dealt in pairs of blocks.
4. Pairs are verified on the full sets. Where a bucket still holds several components, all likely
   pairs across components are verified too, so no link between components is missed.
5. Components of the verified links give each row the smallest doc_id that is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_hash, text_or_empty
from .components import components
from .sketches import band_keys, fast_sketch, set_digest, shingles


@dataclass(frozen=True)
class Settings:
    """similarity: percent; likely: estimate from which a pair is verified, 4.6 deviations below."""

    similarity: int = 85
    likely: float = 0.78
    bands: int = 56
    rows: int = 10
    small_bucket: int = 4
    block: int = 1_000

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def _sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest and band keys of every row of (doc_id, text_hash, text)."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text)
                keys = band_keys(fast_sketch(found, settings.coordinates), settings.rows) if len(found) else np.empty(0, np.uint64)
                rows.append((len(found), set_digest(found), keys.astype(np.int64)))
            n, digest, bands = zip(*rows, strict=True) if rows else ((), (), ())
            named = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"]}
            yield pd.DataFrame(named | {"n_shingles": n, "digest": digest, "bands": bands})

    return texts.mapInPandas(sketch, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")


def _candidates(texts: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node, shingles, sketch and band keys of the wanted classes (node, doc_id, text_hash, digest), from the texts again."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, digest, text in zip(batch["node"], batch["digest"], batch["text"], strict=True):
                found = shingles(text)
                if set_digest(found) == digest:  # another text may have the same hash
                    sketch = fast_sketch(found, settings.coordinates)
                    keys = band_keys(sketch, settings.rows)
                    rows.append((node, found.tobytes(), sketch.astype("<u2").tobytes(), keys.astype("<u8").tobytes()))
            yield pd.DataFrame(rows, columns=["node", "shingles", "sketch", "keys"])

    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])
    found = texts.join(wanted, same).select("node", "digest", "text")
    return found.mapInPandas(sets, "node long, shingles binary, sketch binary, keys binary").dropDuplicates(["node"])


def _find(parents: dict[int, int], x: int) -> int:
    while parents.setdefault(x, x) != x:
        parents[x] = parents[parents[x]]
        x = parents[x]
    return x


def _likely_pairs(rows: pd.DataFrame, settings: Settings, every: bool) -> pd.DataFrame:
    """Pairs of one block (or two) of a bucket whose estimate is likely: all across components, or else those
    of a spanning forest, most similar first. A pair counts in the first band whose key it shares."""
    rows = rows.drop_duplicates("node").sort_values("node")
    nodes, component = rows["node"].tolist(), rows["component"].to_numpy()
    sketches = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(len(rows), -1)
    keys = np.frombuffer(b"".join(rows["keys"]), "<u8").reshape(len(rows), -1)
    band = int(rows["band"].iloc[0])
    found: list[tuple[float, int, int]] = []
    for i in range(len(nodes) - 1):
        same = (sketches[i + 1 :] == sketches[i]).mean(axis=1)
        good = np.flatnonzero((same >= settings.likely) & (component[i + 1 :] != component[i]))
        first = (keys[i + 1 + good] == keys[i]).argmax(axis=1)
        found += [(-same[j], i, i + 1 + j) for j in good[first == band].tolist()]
    if not every:
        forest, parents = [], {}
        for pair in sorted(found):
            a, b = _find(parents, pair[1]), _find(parents, pair[2])
            if a != b:
                parents[a] = b
                forest.append(pair)
        found = forest
    return pd.DataFrame([(nodes[i], nodes[j]) for _, i, j in found], columns=["a", "b"]).astype("int64")


def _bucket_pairs(members: DataFrame, sketches: DataFrame, settings: Settings, every: bool) -> DataFrame:
    """Likely pairs of large buckets: members (bucket, band, size, node, component)."""
    blocks = F.ceil(F.col("size") / settings.block).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member meets every block: once with each pair of blocks that its own is in
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")
    met = dealt.join(sketches.select("node", "sketch", "keys"), "node").groupBy("bucket", "i", "j")
    return met.applyInPandas(lambda rows: _likely_pairs(rows, settings, every), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= settings.similarity * (len(x) + len(y) - both))
            yield batch.loc[good, ["a", "b"]]

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), (F.length("shingles") / 8).alias("n"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), (F.length("shingles") / 8).alias("m"))
    # sizes first: they alone exclude some pairs
    sized = pairs.join(one.select("a", "n"), "a").join(two.select("b", "m"), "b")
    kept = sized.filter(100 * F.least("n", "m") >= settings.similarity * F.greatest("n", "m")).select("a", "b")
    return kept.join(one.select("a", "x"), "a").join(two.select("b", "y"), "b").mapInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_hash.

    Texts of fewer than five words are one shingle; null texts and texts without words have none and
    link with nothing. Rows without number come last in their component and are kept only if it has
    no number at all; rows that repeat a number are both kept or both not. No rows give no rows.
    """
    text = text_or_empty(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))
    rows = stored(_sets(texts, settings), "shingle-sets")
    classes = rows.filter("n_shingles > 0").groupBy("digest")
    # one row stands for a class: of its smallest number, if it has numbers
    stands = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    classes = classes.agg(F.min("doc_id").alias("doc_id"), stands.alias("text_hash"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")

    banded = classes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(banded.join(buckets, "bucket"), "bucket-members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash", "digest")
    sets = stored(_candidates(texts, wanted, settings), "candidate-sets")

    small = members.filter(F.col("size") <= settings.small_bucket)
    other = small.select("bucket", F.col("node").alias("b"))
    pairs = small.select("bucket", F.col("node").alias("a")).join(other, "bucket").filter("a < b").select("a", "b")
    large = stored(members.filter(F.col("size") > settings.small_bucket), "large-buckets")
    likely = _bucket_pairs(large.withColumn("component", F.col("node")), sets, settings, every=False)
    links = stored(_verified(pairs.union(likely).distinct(), sets, settings), "links")

    # buckets that still hold several components
    found = components(links)
    named = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_members = stored(named.join(several.select("bucket"), "bucket"), "open-buckets")
    across = _bucket_pairs(open_members, sets, settings, every=True).distinct()
    more = stored(_verified(across, sets, settings), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    placed = classes.join(found, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").select("digest", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"), "text_hash")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
