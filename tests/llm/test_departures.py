"""Repeated and missing numbers, deep pages, comments in articles, short secrets: what once went wrong."""

from __future__ import annotations

import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from spendloom.llm.near_dedup import near_duplicates
from spendloom.llm.neighbours import Settings, nearest
from spendloom.llm.page_model import PageModel, built_in_counts, labels, parse
from spendloom.llm.secrets import find_secrets, least_ratio, listed


def test_neighbours_do_not_depend_on_the_layout(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60), [rng.gauss(0, 1) for _ in range(5)]) for _ in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [
        sorted(tuple(r) for r in nearest(t, F.col("vec_id") % 20 == 0, 5, Settings(pivots=8, block=50)).collect())
        for t in (table, table.repartition(7), table.orderBy(F.rand(3)).coalesce(1))
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 15


def test_rows_without_number_meet_their_own_text_only(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(string.ascii_lowercase) * rng.randrange(1, 4) for _ in range(30))
    rows = [(None, text()) for _ in range(400)]
    copies = [(None, rows[0][1]), (None, rows[1][1] + " more"), (7, rows[2][1]), (7, text()), (9, rows[2][1].upper())]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in rows + copies], "doc_id long, text string, node string, bucket string")
    found = near_duplicates(table).collect()
    assert len(found) == len(rows) + len(copies)
    assert sum(r.component_id == 7 for r in found) == 4
    assert sum(r.doc_id is None and r.component_id is None for r in found) == 402 - 1
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def seconds(html: str) -> float:
    start = time.process_time()
    parse(html)
    return time.process_time() - start


@pytest.mark.parametrize(
    "tag, more", [("<font>", "</b>x "), ("<div>", "x "), ("<span><p>", "y "), ("<section><li>", "<td>z "), ("<a>", "x<p>")]
)
def test_open_tags_take_linear_time(tag, more):
    small, large = (seconds(tag * n + more * n) for n in (5_000, 50_000))
    assert large < 40 * max(small, 0.02)


def test_two_hundred_thousand_open_tags():
    page = parse("<font>" * 200_000 + "deep text")
    assert [t for _, t in page.blocks] == ["deep text"] and len(page.nodes) == 200_001


PROSE = "The council met on Monday and agreed on the plan for the new school by the river."
ARTICLE = f"""<html><body><nav><a href="/">Home</a></nav><article class="story"><h1>A new school</h1><p>{PROSE}</p>%s<p>Work begins in spring.</p>%s</article>
<div class="comments"><article class="comment"><p>Good news.</p></article></div><footer>Imprint</footer></body></html>"""
EXTRAS = [
    "<div class='comments'><h3>Comments</h3><div class='comment'><p>I do not like it at all.</p></div></div>",
    "<section id='comments'><article class='comment'><p>Who pays for that?</p></article></section>",
    "<div class='advert'><p>Buy paint at half price.</p></div>",
    "<div class='share social'><a href='/s'>Share this</a></div>",
]


@pytest.mark.parametrize("extra", EXTRAS)
def test_what_is_no_part_of_an_article(extra):
    model = PageModel(built_in_counts())
    for page in (ARTICLE % (extra, ""), ARTICLE % ("", extra)):
        assert model.extract(page) == f"A new school\n{PROSE}\nWork begins in spring."
        # so pages teach the same
        given = dict(zip((n.tag + " ".join(n.names) for n in parse(page).nodes), labels(parse(page))))
        assert given["articlestory"] == 1 and not any(y for name, y in given.items() if re.search("comment|advert|share", name))


def test_breaks_within_and_between_words():
    blocks = lambda html: [t for _, t in parse(html).blocks]
    assert blocks("<p>super<wbr>cali<wbr/>fragil</p>") == ["supercalifragil"]
    assert blocks("<p>one<hr>two<hr/>three") == ["one", "two", "three"]
    assert blocks("<p>one<br>two</p>") == ["one two"]
    assert blocks("<p>a <b>b</b><p>c</b></i>d") == ["a b", "cd"]


def test_short_and_joined_secrets_are_judged(spark):
    rnd = random.Random(8)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
    words = ["configuration", "implementation", "internationalization", "user_account_settings", "get_default_value", "Verantwortung", "straightforward"]
    rows = [(i, " ".join(rnd.choices(words, k=12)) + (f" token={key(24)}" if i < 400 else "")) for i in range(900)]
    lengths = {12: 0, 16: 1, 19: 2, 22: 3}
    rows += [(1000 + 100 * at + i, f"see {key(n)} here") for n, at in lengths.items() for i in range(25)]
    rows += [(2000 + i, f"{key(30)}-{'0123456789abcdef' * 2}") for i in range(20)]
    table = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, base string, spans string")
    found = {r.doc_id: r.a for r in find_secrets(table).select("doc_id", listed(F.col("spans")).alias("a")).collect()}
    caught = {n: sum(f"markov:4:{4 + n}" in found[1000 + 100 * at + i] for i in range(25)) for n, at in lengths.items()}
    assert caught[16] >= 22 and caught[19] >= 23 and caught[22] >= 24 and caught[12] >= 12, caught
    # the hex run begins where a key's last characters look like hex
    assert sum(bool(re.match(r"markov:0:(2[5-9]|3[01]),hex", found[2000 + i])) for i in range(20)) >= 18
    assert all("markov" not in found[i] for i in range(900))


def test_no_labelled_secret_adds_no_span(spark):
    table = spark.createDataFrame([(1, "nothing but ordinary words in here"), (2, "X7kQ2pLm9ZtR4vBn8WcY")], "doc_id long, text string")
    assert all(not r.spans and not r.base for r in find_secrets(table).collect())
    assert least_ratio({True: 10, False: 1000}) > least_ratio({True: 10, False: 10}) > 0
