"""Exact dedup, mixing, secrets, toxicity, pages and neighbours."""

from __future__ import annotations

import hashlib
import html
import random
import re
import string

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from spendloom.llm.exact_dedup import exact_groups
from spendloom.llm.html_text import extract_text, train_page_model
from spendloom.llm.mixing import mix, schedule_time
from spendloom.llm.neighbours import Settings, nearest, op3_permutation_search
from spendloom.llm.page_model import PageModel, built_in_counts, labels, parse
from spendloom.llm.queries import ORACLE, QUERIES
from spendloom.llm.secrets import find_secrets, listed
from spendloom.llm.toxicity import THRESHOLD, held_out, hot_evidence, string_evidence, train

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, score string, kept string, size string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "x", None, "x", "x") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""


@pytest.mark.parametrize("collide", [False, True])
def test_equal_texts_by_recipe(spark, collide):
    chunk_id = (lambda c: F.length(c).cast("long") % 2) if collide else F.xxhash64
    rows = [(1, "a b"), (2, "a\t\n b"), (3, None), (4, ""), (5, "x" * 9000 + " y. "), (6, "x" * 9000 + "  y. "), (7, "z")]
    rows += [(None, "z"), (7, "z"), (8, "a b " * 9000), (9, "a b " * 9001), (10, "yn, " * 700), (11, "yn, " * 699 + "ny, ")]
    found = exact_groups(docs(spark, [(i, t, "s") for i, t in rows]), chunk_id).collect()
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(found) == len(rows)
    for r in found:
        group = groups[normal[r.doc_id]]
        assert (r.keep_id, r.group_size) == (min(x for x in group if x is not None), len(group))
        assert r.text_sha256 == hashlib.sha256(normal[r.doc_id].encode()).hexdigest()
    assert sum(r.kept for r in found) == len(groups)
    assert exact_groups(docs(spark, [])).count() == 0


def water_levels(sizes: list[int], weights: list[int]) -> list[float]:
    target, open_ones, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_ones:
        level = left / sum(weights[i] for i in open_ones)
        over = [i for i in open_ones if level * weights[i] > 3 * sizes[i]]
        if not over:
            for i in open_ones:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
            open_ones.remove(i)
    return target


def test_mix_reaches_targets(spark):
    rnd = random.Random(4)
    sources = ["a", "b", "c", "d", "B", "", None]
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), sources[min(int(rnd.expovariate(0.5)), 6)]) for i in range(600)]
    rows += [(600, None, "a"), (601, "", "empty"), (None, "x y", "a"), (3, "w w", "a"), (3, "w w", "a")]
    found = mix(docs(spark, rows)).collect()
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in order]
    targets = water_levels(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert len(found) == len(rows) and abs(sum(targets) - sum(sizes)) < 1e-6
    by_size = {round(s): t for s, t in zip(sizes, targets, strict=True)}
    assert all(abs(r.target - by_size[r.source_size]) < 1e-6 and r.taken <= 3 * r.size for r in found)
    assert all(len(r.positions) * r.size == r.taken and all(0 <= p <= 1 for p in r.positions) for r in found)
    for size, target in by_size.items():
        assert abs(sum(r.taken for r in found if r.source_size == size) - target) <= 15
    first = [r.positions[0] for r in found if r.positions]
    assert first == sorted(first)
    again = mix(docs(spark, rows[::-1])).collect()
    assert sorted((str(r.doc_id), r.taken) for r in found) == sorted((str(r.doc_id), r.taken) for r in again)
    assert mix(docs(spark, [])).count() == 0 and mix(docs(spark, [(1, None, None)])).collect()[0].taken == 0


def test_schedule_is_inverted(spark):
    rows = spark.range(11).select((F.col("id") * 10).alias("d"))
    for trend in (-0.5, 0.0, 0.5, 1.0):
        t = rows.select("d", schedule_time(F.col("d"), F.lit(100.0), F.lit(trend)).alias("t")).collect()
        assert all(abs(100 * ((1 - trend) * r.t + trend * r.t**2) - r.d) < 1e-9 for r in t)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text: str) -> str:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_pattern_spans_match_plain_search(spark):
    rnd = random.Random(5)
    parts = ["token", "Secret", "PASSWORD", "api_key", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "ff", "é𝄞", "x" * 12]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))), "s") for i in range(300)]
    rows += [(300, None, "s"), (301, "", "s"), (302, ("token=abcdefghijkl é " * 800), "s"), (None, "secret: 0123456789abcdef", "s"), (5, "ff", "s")]
    found = find_secrets(docs(spark, rows)).select("doc_id", listed(F.col("base")).alias("b"), listed(F.col("spans")).alias("a")).collect()
    expected = sorted(plain_spans(t or "") for _, t, _ in rows)
    assert sorted(r.b for r in found) == expected
    assert all(set(filter(None, r.b.split(","))) <= set(r.a.split(",")) for r in found)
    assert find_secrets(docs(spark, [])).count() == 0


def test_models_find_random_strings_only(spark):
    rnd = random.Random(6)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
    words = ["configuration", "implementation", "internationalization", "user_account_settings", "get_default_value", "Verantwortung"]
    rows = [(i, f"{rnd.choice(words)} token={key(24)} {rnd.choice(words)}", "s") for i in range(300)]
    rows += [(1000 + i, f"see {key(32)} here", "s") for i in range(20)] + [(2000, "internationalization_settings user_account_settings_default", "s")]
    found = {r.doc_id: r.a for r in find_secrets(docs(spark, rows)).select("doc_id", listed(F.col("spans")).alias("a")).collect()}
    assert sum("markov:4:36" in found[1000 + i] for i in range(20)) >= 18
    assert found[2000] == "" and all("markov" not in found[i] for i in range(300))


def test_toxicity_learns_from_training_labels_only(spark):
    rnd = random.Random(7)
    syllables = ["an", "er", "ti", "on", "th", "re", "ing", "ed"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))

    def text(toxic):
        out = [word() for _ in range(rnd.randint(20, 200))]
        for _ in range(len(out) // 15 + 1 if toxic else 0):
            out.insert(rnd.randrange(len(out)), rnd.choice(["moron", "scum", "idiot"]))
        return " ".join(out)

    marks = [rnd.random() < 0.2 for _ in range(900)]
    rows = [(i, text(m), "s") for i, m in enumerate(marks)] + [(900, None, "s"), (901, "", "s"), (None, "x", "s"), (902, "moron " * 30000, "s")]
    table = docs(spark, rows)
    given = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = train(table, given)
    found = model.score(table, "found").select("doc_id", "found", "score", held_out(F.col("doc_id")).alias("held")).collect()
    assert len(found) == len(rows) and all(0 <= r.found <= 1 and r.score == "x" for r in found)
    held = [r for r in found if r.held and r.doc_id is not None and r.doc_id < 900]
    right = sum((r.found >= THRESHOLD) == marks[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    # labels of the held-out fold change nothing
    flipped = given.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(train(table, flipped).weights, model.weights)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(docs(spark, [(1, "a b", "s")]), none)
    assert [r.f < 0.5 for r in model.score(docs(spark, [(1, "a b", "s"), (2, None, "s")]), "f").collect()] == [True, True]
    assert model.score(docs(spark, []), "f").count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    "<div class='ad'>Buy it now.</div><article><h1>Head</h1><p><b>One\n two &amp; &lt;three&gt;<br><p>Four&nbsp;five.</p><aside>Elsewhere</aside><p>Six</article><footer>&copy; 2020</footer>"
)


def test_page_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p>plain"), (1, "u", PAGE), (5, "u", "<div>" * 3000 + "deep"), (None, "u", "<nav>x</nav>")]
    pages = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, text string")
    found = extract_text(pages, train_page_model(pages), "found").collect()
    assert len(found) == len(rows) and all(r.text == "kept" for r in found)
    texts = {r.page_id: r.found for r in found}
    assert texts[1] == "Head\nOne two & <three>\nFour five.\nSix"
    assert texts[2] == texts[3] == texts[None] == ""
    assert extract_text(pages.limit(0), train_page_model(pages.limit(0)), "found").count() == 0


def test_pages_of_the_tables_match_their_template(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract_text(pages, train_page_model(pages), "text").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_messages_give_exact_marginals():
    from itertools import product

    from spendloom.llm.page_model import features, kind

    model = PageModel(built_in_counts())
    page = parse("<div class='post'><p>some words here</p><a href='/'>x</a></div><nav><a href='/'>y</a></nav>")
    n = len(page.nodes)
    weights = np.zeros(n)
    total = 0.0
    for given in product((0, 1), repeat=n - 1):
        y, p = (0, *given), 1.0
        for i in range(1, n):
            p *= model.edge(kind(page.nodes[i]))[y[page.nodes[i].parent]][y[i]]
            for f in features(page.nodes[i]):
                p *= model.unary(f)[y[i]]
        total += p
        weights += p * np.array(y)
    assert np.allclose(model.marginals(page), weights / total)
    assert labels(parse("<main><p>a</p><nav>b</nav></main>")) == [0, 1, 1, 0]
    assert labels(parse("<p>a</p>")) is None


def test_neighbours_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found: dict = {}
    for r in op3_permutation_search(spark, sf).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        ours = [found[ids[q]][k] for k in sorted(found[ids[q]])]
        assert len(ours) == 20 and ours == sorted(ours, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - vectors[ids == v][0] @ vectors[q]) < 1e-12 for v, s in ours)
        hits.append(len(best & {v for v, _ in ours}) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_exact_when_small_with_ties_and_bad_rows(spark):
    rows = [(i, [float(i % 3), 1.0, -float(i % 2)], "x", 1) for i in range(60)]
    rows += [(100, None, "x", 1), (120, [0.0, 0.0, 0.0], "x", 1), (140, [1.0, None, 1.0], "x", 1), (160, [float("nan"), 1.0, 1.0], "x", 1)]
    rows += [(180, [float("inf"), 1.0, 1.0], "x", 1), (None, [1.0, 1.0, 1.0], "x", 1), (20, [2.0, 1.0, 0.0], "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, file string, rank int")
    found = nearest(table, F.col("vec_id") % 20 == 0, settings=Settings(pivots=6, block=7)).collect()
    vectors = {i: np.array(v) for i, v, _, _ in rows[:60]}
    for q in (0, 20, 40):
        expected = sorted(((-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q))[:20]
        ours = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [(v, s) for _, v, s in ours] == [(i, -s) for s, i in expected]
    assert {r.query_id for r in found} == {0, 20, 40}
    assert nearest(table.limit(0), F.lit(True)).count() == 0


def test_toxicity_drops_no_string(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(40)) + (" moron" * 3 if i % 5 == 0 else ""), "s") for i in range(300)]
    rows += [(300, None, "s"), (301, "", "s"), (302, "moron  unseen wordsofothers", "s"), (302, "moron  unseen wordsofothers", "s"), (None, "x", "s")]
    table = docs(spark, rows)
    given = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    whole = train(table, given)
    assert whole.complete and len(whole.evidence.value.keys) == whole.strings.count()
    expected = sorted((str(r.doc_id), r.f) for r in whole.score(table, "f").collect())
    for hot in (100, 0):
        part = train(table, given, hot)
        assert not part.complete and len(part.evidence.value.keys) <= hot
        assert np.allclose(part.weights, whole.weights, atol=1e-9)
        found = part.score(table, "f")
        assert found.columns == [*table.columns, "f"]
        found = sorted((str(r.doc_id), r.f) for r in found.collect())
        assert [i for i, _ in found] == [i for i, _ in expected]
        assert np.allclose([f for _, f in found], [f for _, f in expected], atol=1e-9)


def test_toxicity_weighs_mild_words_and_backs_off_unseen_strings(spark):
    rnd = random.Random(9)
    words = ["anther", "winter", "letter", "butter", "matter", "dinner"]
    weights = {1: [3, 3, 3, 1, 1, 1], 0: [1, 1, 1, 3, 3, 3]}
    texts = [(i, i % 2, " ".join(rnd.choices(words, weights[i % 2], k=60))) for i in range(300)]
    table = docs(spark, [(i, t, "s") for i, _, t in texts])
    model = train(table, spark.createDataFrame([(i, m) for i, m, _ in texts], "doc_id long, toxic int"))
    evidence = model.evidence.value
    mild, other = ["anther winter letter " * 20, "butter matter dinner " * 20]
    assert all(0 < evidence.parts([w])[0][1][0] < 2 for w in words[:3])
    found = {r.doc_id: r.f for r in model.score(docs(spark, [(1, mild, "s"), (2, "", "s"), (3, other, "s")]), "f").collect()}
    assert found[1] > found[2] > found[3]
    # a string that neither class has: what each leaves to the backoff after its context
    counts = spark.createDataFrame([(7 * 1024 + 1, 4, 1), (7 * 1024 + 2, 1, 0), (7 * 1024 + 3, 0, 5), (9 * 1024 + 1, 0, 2)], "key long, toxic long, ordinary long")
    known = hot_evidence(string_evidence(counts))
    values, found_here = known.of(np.array([7 * 1024 + 9, 9 * 1024 + 9, 8 * 1024 + 9]))
    assert np.allclose(values, [np.log(2 / 5) - np.log(2 / 6), -np.log(1 / 2), 0.0], atol=1e-6) and found_here.all()


@pytest.mark.parametrize("cut", ["</head>", "</head><body>"])
def test_pages_without_the_end_of_head(spark, cut):
    assert cut in PAGE
    page = PAGE.replace(cut, "")
    found = {html: parse(html).blocks for html in (PAGE, page)}
    assert [text for _, text in found[page]] == [text for _, text in found[PAGE]]
    pages = spark.createDataFrame([(1, "u", PAGE, "kept"), (2, "u", page, "kept")], "page_id long, url string, html string, text string")
    texts = {r.page_id: r.found for r in extract_text(pages, train_page_model(pages), "found").collect()}
    assert texts[2] == texts[1] == "Head\nOne two & <three>\nFour five.\nSix"
    assert [t for _, t in parse("<head><title>T</title>plain words").blocks] == ["plain words"]
    assert parse("<head><noscript><p>x</p></noscript><title>T</title></head>").blocks == []
