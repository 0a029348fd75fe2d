"""The filter interaction audit, collocations and quality."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.llm import collocations as phrases
from spendloom.llm import quality
from spendloom.llm.collocations import collocations, frequent_phrases, subtree_nodes
from spendloom.llm.filter_audit import Diagram, audit_orders, audit_part, mask_counts, plain_changes
from spendloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: With columns whose names the operators use themselves.
DOCS = "doc_id long, text string, source string, lang string, part string, mask string, score string, n string, rank string, good string"
LABELS = "doc_id long, quality int, toxic int, good string, docs string, _id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, g, *"xxxxxx") for i, t, s, g in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "x", "x", "x") for i, q, t in rows], LABELS)


# --- Filter interaction audit ---------------------------------------------------------


@pytest.mark.parametrize("n", range(1, 6))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for at in plain_changes(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def audited(counts, filters="ABCDE"):
    """Every order by looking at every mask."""
    rows, total = [], Counter()
    for order in permutations(filters):
        for step, f in enumerate(order):
            bit, earlier = 1 << filters.index(f), sum(1 << filters.index(x) for x in order[:step])
            fails = [(m, w) for m, w in counts.items() if m & bit]
            gone = [w for m, w in fails if not m & earlier]
            total[f] += sum(w[0] for w in gone)
            kept = sum(w[0] for m, w in counts.items() if not m & (earlier | bit))
            late, alone = sum(w[0] for m, w in fails if m & earlier), sum(w[0] for m, w in fails if m == bit)
            rows.append(("".join(order), step + 1, kept, sum(w[0] for w in gone), late, alone, sum(w[1] for w in gone), sum(w[2] for w in gone)))
    return sorted((*r, total[r[0][r[1] - 1]]) for r in rows)


def test_diagram_against_every_mask():
    rng = random.Random(3)
    for filters in ("A", "ABC", "ABCDE"):
        for share in (0.0, 0.4, 1.0):
            masks = [m for m in range(1 << len(filters)) if rng.random() < share]
            counts = {m: (rng.randrange(1, 4), rng.randrange(2), rng.randrange(2)) for m in masks}
            assert audit_part(counts, filters) == audited(counts, filters)


def test_diagram_shares_equal_parts_and_swaps_back():
    counts = dict.fromkeys(range(32), (1, 0, 1))
    diagram = Diagram(counts)
    assert [len(level) for level in diagram.levels] == [1] * 5 and diagram.ends == [(1, 0, 1)]
    diagram = Diagram({0: (5, 0, 0), 3: (2, 1, 0), 8: (1, 1, 1)})
    before = diagram.steps()
    diagram.swap(1)
    assert "".join(diagram.order) == "ACBDE" and diagram.weight(0, 0) == (8, 2, 1)
    diagram.swap(1)
    assert "".join(diagram.order) == "ABCDE" and diagram.steps() == before


def test_audit_of_documents(spark):
    rng = random.Random(5)
    words = ["aa", "Bb", "CCC", "d$", "e", "f\tg", "äÖ", "x" * 30]
    texts = ["", None, " \t\n", "ONE", "\U0001d400 a"] + [" ".join(rng.choices(words[: rng.randrange(1, 9)], k=rng.choice([3, 199, 200, 450]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s1", "s2"]), "en") for _ in range(150)]
    rows.append((99, "w" * 300_000 + " " + "v " * 100_000, "s1", "en"))
    marks = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [*range(0, 60, 2), *range(0, 60, 3), None]]

    first, good, toxic = {}, defaultdict(int), defaultdict(int)
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, t in marks:
        good[i], toxic[i] = max(good[i], q or 0), max(toxic[i], t or 0)
    counts: dict = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for i, t, s, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        weight = counts[s or ""][sum(1 << bit for bit, failed in enumerate(fails) if failed)]
        weight[0] += 1
        weight[1] += good[i] if i is not None else 0
        weight[2] += toxic[i] if i is not None else 0

    table = docs(spark, rows)
    found = audit_orders(mask_counts(table, labels(spark, marks))).collect()
    parts = defaultdict(list)
    for r in found:
        parts[r.part].append(tuple(r)[1:])
    assert {p: sorted(x) for p, x in parts.items()} == {p: audited(c) for p, c in counts.items()}
    assert audit_orders(mask_counts(table.limit(0), labels(spark, marks))).count() == 0
    unlabelled = audit_orders(mask_counts(table, labels(spark, [])))
    assert unlabelled.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


# --- Collocations ---------------------------------------------------------------------


def mined(rows, least, top):
    """All contiguous phrases counted one by one."""
    n, f = Counter(), Counter()
    for _, text, _, lang in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    frequent = {p: a for (p, a) in f.items() if a >= least and len(p[1]) > 1}
    found = defaultdict(list)
    for (lang, p), a in frequent.items():
        longer = [q for (x, q), b in frequent.items() if x == lang and len(q) > len(p) and b >= a]
        if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    )


def phrase_rows():
    rng = random.Random(7)
    words = ["of", "The", "tHE", "a", "rareé", "Äb", "x1", "\u0085y", "z ", "#"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", "\r"]) for _ in range(rng.randrange(40)))
        rows.append((i, text, "s", rng.choice(["en", "en", "de", None, ""])))
    rows += [(None, "New York city hall now. " * 30, "s", "en")] * 4 + [(5, None, None, "en"), (6, "", "s", None), (7, "lone", "s", "fr")]
    rows.append((8, "again and " * 40_000 + "deep blue sea " * 10, "s", "en"))
    return rows


@pytest.mark.parametrize("budget, chunk", [(1 << 20, 3_000_000), (400, 500), (7, 50)])
def test_collocations_against_plain_counts(spark, budget, chunk):
    rows = phrase_rows()
    for least, top in ((10, 2000), (3, 15)):
        found = collocations(docs(spark, rows), least, top, budget, chunk)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == mined(rows, least, top)
    assert collocations(docs(spark, []), 2).count() == 0
    assert collocations(docs(spark, [(1, None, None, None), (2, "one two", "s", "en")]), 2).count() == 0


def test_frequent_phrases_are_complete(spark):
    rows = [(i, "a b a b a b a b", "s", "en") for i in range(3)]
    found, totals = frequent_phrases(docs(spark, rows), 3, 2)
    counted = {r.phrase: r.n for r in found.collect()}
    text = "a b a b a b a b".split()
    expected = Counter(" ".join(text[i : i + k]) for k in range(1, 6) for i in range(9 - k))
    assert counted == {p: 3 * n for p, n in expected.items()} and totals.first()["total"] == 24


def test_nodes_are_runs_of_leaves():
    words = [b"", b"a", b"b", b"c"]
    suffixes = np.array([[1, 2, 0, 0, 0], [1, 2, 3, 0, 0], [1, 2, 3, 1, 2], [2, 3, 1, 0, 0], [1, 2, 0, 0, 0]], np.int32).T
    found = subtree_nodes(words, suffixes, np.array([1, 2, 3, 4, 5]), 5)
    assert sorted(found) == [(b"a b", 2, 11), (b"a b c", 3, 5)]
    assert subtree_nodes(words, suffixes[:, :0], np.zeros(0, np.int64), 1) == []


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 4)
    text = b"one two three\xfffour\xff\xfffive six seven eight nine ten"
    parts = list(phrases._segments(text))
    assert b"".join(parts) == text and len(parts) == 3 and all(p[:1] == b"\xff" for p in parts[1:])


def test_hashes_agree(spark):
    rows = [("en", "a b"), ("", "ä"), ("und", "")]
    found = spark.createDataFrame(rows, "lang string, phrase string").select(phrases._key(F.col("lang"), F.col("phrase"))).collect()
    assert [r[0] % 2**64 for r in found] == [phrases._hash(a.encode(), b.encode()) for a, b in rows]


# --- Quality --------------------------------------------------------------------------


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_quality_of_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op13_quality"](spark, "/root/testdata/sf0.01").collect()}
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    kept = [rows[m.doc_id].predicted for m in marks if m.quality == 1 and rows[m.doc_id].held_out]
    junk = [rows[m.doc_id].predicted for m in marks if m.quality == 0 and rows[m.doc_id].held_out]
    assert sum(kept) >= 0.95 * len(kept) and sum(junk) <= 0.25 * len(junk) and junk
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (fold(i) == 0) for i, r in rows.items())


def test_pairs_and_newton_steps():
    y = np.array([1, 1, 0, 1, 0, 1, 1])
    better, worse = quality.pairs_of(y, 2)
    assert len(better) == 10 and (y[better] == 1).all() and (y[worse] == 0).all()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 3))
    w, size = quality.fit_pairs(x, better, worse, 0.1), len(better)
    loss = lambda w: np.log1p(np.exp(-(x[better] - x[worse]) @ w)).sum() + 0.1 * size * w @ w / 2
    for d in np.eye(3):
        assert loss(w) <= min(loss(w + 1e-3 * d), loss(w - 1e-3 * d))


def test_scores_follow_quantiles():
    rng = np.random.default_rng(2)
    y = (rng.random(400) > 0.25).astype(int)
    x = rng.normal(size=(400, quality.FEATURES))
    x[:, 0] += 2 * y
    model = quality.fit(x, y)
    strengths = model.strengths(x)
    scores = model.scores(strengths)
    assert (scores < quality.THRESHOLD).sum() == (y == 0).sum()
    order = np.argsort(strengths)
    assert (np.diff(scores[order]) >= 0).all() and ((scores >= 0) & (scores <= 1)).all()
    assert model.scores(np.array([-1e9, 1e9])).tolist() == [0, 1]
    for single in (np.ones(5, int), np.zeros(5, int), np.zeros(0, int)):
        assert quality.fit(x[: len(single)], single).scores(np.array([3.0])).tolist() == [0.5]


def test_quality_edges(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["the", "house", "Is", "green,", "and", "tall."], k=30)) for _ in range(80)]
    bad = [" ".join(rng.choices(["B$$$", "BUY###", "NOW!!", "%%%"], k=30)) for _ in range(40)]
    rows = [(i, t, "s", "en") for i, t in enumerate(good + bad)] + [(None, good[0], "s", "en"), (3, good[3], "s", "en"), (500, None, None, None), (501, "", "s", "de")]
    rows.append((502, "word " * 400_000, "s", "en"))
    marks = [(i, int(i < 80), 0) for i in range(120)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    table = docs(spark, rows)
    model = quality.train(table, labels(spark, marks))
    scored = model.score(table).collect()
    assert len(scored) == len(rows)
    by_text = defaultdict(set)
    for r in scored:
        by_text[r.text or ""].add(r.score)
        assert 0 <= r.score <= 1
        if r.text in bad:
            assert r.score < quality.THRESHOLD
    assert all(len(x) == 1 for x in by_text.values())
    again = quality.train(table.repartition(7), labels(spark, marks)).score(table).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in scored)
    assert {r.score for r in quality.train(table, labels(spark, [])).score(table).collect()} == {0.5}
    assert model.score(table.limit(0)).count() == 0
    # labels of the held-out fold teach nothing
    other = [(i, 1 - q if fold(i) == 0 and q is not None else q, t) if i is not None else (i, q, t) for i, q, t in marks]
    assert np.array_equal(quality.train(table, labels(spark, other)).weights, model.weights)
    assert quality.training_rows(table, labels(spark, marks), 10).count() == 10


def test_quality_learns_from_every_labelled_row(spark):
    # 24,000 labelled rows in several blocks: as many of them score below the threshold as are marked bad
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.conv(F.abs(F.xxhash64("id", i)).cast("string"), 10, 36))
    kind = F.when(F.col("id") % 7 == 0, F.lit("!!! ##")).otherwise(F.lit("the, and"))
    table = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words, kind).alias("text"))
    marks = table.select("doc_id", ((F.col("doc_id") % 7 != 0) != (F.col("doc_id") % 10 == 0)).cast("int").alias("quality"))
    assert quality.training_rows(table, marks).count() == table.filter(~quality.held_out(F.col("doc_id"))).count() > 23_000
    scored = quality.train(table, marks).score(table).join(marks, "doc_id").filter(~quality.held_out(F.col("doc_id")))
    low, bad = scored.agg(F.count_if(F.col("score") < quality.THRESHOLD), F.count_if(F.col("quality") == 0)).first()
    assert low == bad


def test_quality_blocks_fit_what_one_block_fits(spark, monkeypatch):
    rng = random.Random(6)
    words = {1: ["the", "house", "Is", "green,", "and"], 0: ["B$$$", "house", "NOW!!", "the", "is"]}
    rows = [(i, " ".join(rng.choices(words[int(i % 5 > 0)], k=9)), "s", "en") for i in range(400)]
    table, marks = docs(spark, rows), labels(spark, [(i, int(i % 5 > 0), 0) for i in range(400)])
    whole = quality.train(table, marks)
    found = quality.training_rows(table, marks).withColumn("x", F.xxhash64("doc_id")).orderBy("x").collect()
    alone = quality.fit(np.array([quality.features(r.text) for r in found]), np.array([r.quality for r in found]))
    assert np.allclose(whole.weights, alone.weights, atol=1e-6) and np.allclose(whole.knots, alone.knots, atol=1e-5)
    monkeypatch.setattr(quality, "BLOCK_ROWS", 50)
    monkeypatch.setattr(quality, "BLOCK_OPPONENTS", 20)
    parts = quality.train(table, marks)
    assert np.allclose(parts.mean, whole.mean) and np.allclose(parts.scale, whole.scale) and len(parts.knots)
    assert np.array_equal(quality.train(table.repartition(9), marks).weights, parts.weights)


def test_features_without_words_and_with_odd_signs():
    for text in ("", " \n\t", "a", "\x00", "퟿\U0001d400  ", "1 2 3"):
        x = quality.features(text)
        assert x.shape == (quality.FEATURES,) and np.isfinite(x).all()
