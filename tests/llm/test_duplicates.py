"""Near dedup, repeated strings and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from spendloom.llm import near_dedup, repeats
from spendloom.llm.components import components
from spendloom.llm.near_dedup import near_duplicates
from spendloom.llm.repeats import remove_repeats
from spendloom.llm.sketches import fast_sketch, shingles
from spendloom.llm.suffixes import anchored, maximal_repeats, window_minima

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, digest string, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "x", "x") for i, t in rows], DOCS)


def word_sets(rows):
    out = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_components(rows):
    sets, parent = word_sets(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups: dict = {}
    for i, (number, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(number)
    return [min((n for n in groups[find(i)] if n is not None), default=None) for i in range(len(rows))], [len(s) for s in sets]


def near_rows(seed: int):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyzuvw") * rnd.randint(1, 9)
    rows = []
    for _ in range(3):
        base = [word() for _ in range(rnd.randint(60, 200))]
        for _ in range(50):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, " \n", "one two", "ONE  two", "a b c d e", "a b c d e f", rows[0].upper(), rows[0] + " É", "é É " * 40, "w " * 30000]
    rnd.shuffle(rows)
    return [(10_000 - 7 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small_bucket,block", [(4, 1000), (2, 10)])
def test_components_match_brute_force(spark, small_bucket, block):
    rows = near_rows(11)
    expected, sizes = brute_components(rows)
    found = near_duplicates(docs(spark, rows), near_dedup.Settings(small_bucket=small_bucket, block=block)).collect()
    want = {n: (s, c, n == c) for (n, _), c, s in zip(rows, expected, sizes, strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == want
    assert len(found) == len(rows) and 3 < len(set(expected)) < len(rows) - 20


def test_near_dedup_without_numbers_and_rows(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "other words"), (4, "other words"), (None, None), (None, "alone here")]
    found = near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == sorted(
        [("None", 1, "4", False), ("4", 1, "4", True), ("4", 1, "4", True), ("4", 1, "4", True), ("None", 0, "None", True), ("None", 1, "None", True)]
    )
    assert near_duplicates(docs(spark, [])).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    errors = []
    for n in (1, 2, 30, 700):
        for _ in range(20):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            cut = n // 3
            y = np.concatenate([x[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)])
            a, b = fast_sketch(x, 560), fast_sketch(y, 560)
            assert a.max() < np.iinfo(np.uint64).max
            errors.append((a == b).mean() - (n - cut) / (n + cut))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.1
    assert len(shingles("a b c d e f")) == 2 and len(shingles(" ")) == 0
    words = "x y y x z y x x y z " * 3
    assert len(shingles(words)) == len(word_sets([(0, words)])[0])


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count: dict = {}
    for d in data:
        for p in range(len(d) - length + 1):
            count[d[p : p + length]] = count.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        left = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def repeat_rows(seed: int):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abé \n") for _ in range(n))
    shared = [text(rnd.randint(20, 90)) for _ in range(6)]
    rows = []
    for _ in range(120):
        parts = [rnd.choice([text(rnd.randint(0, 60)), rnd.choice(shared), rnd.choice(shared)[: rnd.randint(0, 60)]]) for _ in range(rnd.randint(0, 5))]
        rows.append("".join(parts))
    rows += [None, "", "ab" * 100, "a" * 31, rows[5], rows[5], "x" + rows[9] + "y"]
    return list(enumerate(rows))


@pytest.mark.parametrize("many,widths", [(2_000, (16, 1)), (2, (16, 1)), (1, (5, 1))])
def test_removal_matches_brute_force(spark, many, widths):
    rows = repeat_rows(12)
    settings = repeats.Settings(length=32, gram=9, many=many, widths=widths, scan_bytes=500)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs(spark, rows), settings).collect()}
    assert [found[i] for i, _ in rows] == brute_removal(rows, 32)


def test_groups_list_every_occurrence(spark):
    rows = repeat_rows(16)
    settings = repeats.Settings(length=32, gram=9, scan_bytes=500)
    _, touched, found = repeats.repeated_strings(docs(spark, rows), settings)
    text = {r.node: zstandard.ZstdDecompressor().decompress(r.data) for r in touched.collect()}
    groups: dict = {}
    for r in found.collect():
        groups.setdefault(r.repeat, set()).add(text[r.node][r.start : r.start + r.length])
    assert groups and all(len(strings) == 1 and len(next(iter(strings))) >= 32 for strings in groups.values())


def test_removal_of_repeated_rows_and_none(spark):
    rows = [(1, "q" * 300), (1, "q" * 300), (None, "b c " * 80), (2, "unique words only")]
    found = remove_repeats(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("1", 300), ("1", 300), ("2", 0), ("None", 320)]
    assert remove_repeats(docs(spark, [])).count() == 0


def brute_repeats(segments, length):
    places: dict = {}
    begin = 0
    for k, s in enumerate(segments):
        for i in range(len(s)):
            for j in range(i + length, len(s) + 1):
                places.setdefault(s[i:j], []).append((k, i, begin))
        begin += len(s)
    out = set()
    for t, found in places.items():
        left = {segments[k][i - 1] if i else ("begin", k) for k, i, _ in found}
        right = {segments[k][i + len(t)] if i + len(t) < len(segments[k]) else ("end", k) for k, i, _ in found}
        if len(found) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(t), tuple(sorted(b + i for _, i, b in found))))
    return out


def test_interval_tree_gives_all_maximal_repeats():
    rnd = random.Random(13)
    for _ in range(200):
        length = rnd.choice([8, 9, 12, 16, 17])
        base = bytes(rnd.choice(b"ab") for _ in range(60))
        segments = []
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randint(0, 40)
            s = bytearray(base[at : at + rnd.randint(0, 30)])
            if s and rnd.random() < 0.6:
                s[rnd.randrange(len(s))] = rnd.choice(b"abc")
            segments.append(bytes(s) * rnd.choice([1, 1, 2]))
        found, _, _ = maximal_repeats(segments, length)
        got = {(r.length, tuple(sorted(r.occurrences))) for r in found}
        assert len(got) == len(found) and got == brute_repeats(segments, length)


def test_anchors_depend_on_the_string_alone(monkeypatch):
    from spendloom.llm import suffixes

    rng = np.random.default_rng(14)
    values = rng.integers(0, 9, 300).astype(np.uint64)
    assert window_minima(values, 37).tolist() == [i + int(np.argmin(values[i : i + 37])) for i in range(264)]
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = np.concatenate([place for _, place, _ in anchored(data, 64, 16)])
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    assert np.array_equal(whole, np.concatenate([place for _, place, _ in anchored(data, 64, 16)]))
    cut = np.concatenate([place for _, place, _ in anchored(data[1234:], 64, 16)])
    assert np.array_equal(whole[1234:], cut + 1234)


def test_pipeline_stages_take_effect(spark, tmp_path):
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice(["an", "er", "ti", "on", "th"]) for _ in range(rnd.randint(1, 4)))
    rows, toxic = [], {}
    for i in range(240):
        words = [word() for _ in range(rnd.randint(30, 120))]
        toxic[i] = i % 4 == 0
        for _ in range(len(words) // 10 if toxic[i] else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["moron", "scum"]))
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 1))
    clean = [r for r in rows if not toxic[r[0]]]
    rows += [(1000 + i, r[1].replace(" ", " \n"), "en", "s1", 1) for i, r in enumerate(clean[:20])]
    rows += [(2000 + i, r[1] + " end", "en", "s2", 1) for i, r in enumerate(clean[20:40])]
    rows += [clean[50], (None, None, None, None, None), (3000, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(t)) for i, t in toxic.items()]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, table, str(tmp_path))
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert all(r[0] in ids for r in clean) and len([i for i, t in toxic.items() if t and i in ids]) <= 3

    once = stages["exact dedup"](spark, kept, str(tmp_path))
    found = [r.doc_id for r in once.collect()]
    assert once.columns == table.columns and len(found) == len(set(found))
    assert not any(i in found for i in range(1000, 1020)) and all(r[0] in found for r in clean)
    normal = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()}
    assert len(found) == len(normal)

    apart = stages["near dedup"](spark, once, str(tmp_path))
    remaining = [(r.doc_id, r.text) for r in once.collect()]
    expected, sizes = brute_components(remaining)
    want = {n for (n, _), c, s in zip(remaining, expected, sizes, strict=True) if n == c or not s}
    assert apart.columns == table.columns and {r.doc_id for r in apart.collect()} == want

    mixed = stages["source mixing"](spark, apart, str(tmp_path))
    assert mixed.columns == table.columns
    copies: dict = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    from spendloom.llm.mixing import mix

    assert copies == {r.doc_id: len(r.positions) for r in mix(apart).collect() if r.positions}

    packed = stages["packing"](spark, mixed, str(tmp_path))
    pieces = packed.filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in pieces} == copies
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length").collect()))
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_and_odd_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = docs(spark, [(1, "some words here"), (1, "some words here"), (None, None), (2, "")]).withColumn("kept", F.lit(1)).withColumn("score", F.lit("z"))
    assert stage(spark, extra.limit(0), str(tmp_path)).count() == 0
    out = stage(spark, extra, str(tmp_path))
    assert out.count() >= 1 and (name == "packing" or out.columns == extra.columns)
