"""Copies of a page do not make its article template; template is no matter of a share of the host."""

import random
import time
from collections import Counter

import pytest

from corpusmill.llm import html

SCHEMA = "page_id long, url string, html string"


def texts(spark, bodies):
    rows = [(k, f"https://a.example/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_keep_their_article(spark):
    bar = "<div class=bar>Welcome to A</div>"
    copies = ["<article><div class=body><p>One story told here.</p></div></article>"] * 9
    bare = [f"{bar}<div><p>Another story.</p></div>"] * 9
    others = [f"{bar}<div><p>Text number {k}.</p></div>" for k in range(9)]
    got = texts(spark, copies + bare + others)
    assert {got[k] for k in range(9)} == {"One story told here."}
    assert {got[k] for k in range(9, 18)} == {"Another story."}
    assert [got[k] for k in range(18, 27)] == [f"Text number {k}." for k in range(9)]


def test_template_of_a_small_part_of_a_large_host_goes(spark):
    bar = "<div class=bar>Welcome to the small part</div>"
    got = texts(spark, [f"{bar if k < 6 else ''}<div><p>Text number {k}.</p></div>" for k in range(600)])
    assert all(got[k] == f"Text number {k}." for k in range(600))


def test_copies_under_changing_menus_are_not_empty(spark):
    got = texts(spark, [f"<nav>Menu {k}</nav><div><p>The same story.</p></div>" for k in range(8)])
    assert set(got.values()) == {"The same story."}


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_recurring_blocks_go_as_a_count_over_contents_says(spark, monkeypatch, rows):
    monkeypatch.setattr(html, "BROADCAST_ROWS", rows)
    rnd = random.Random(2)
    blocks = [f"Block {k}" for k in range(40)]
    pages = [[f"Own text {k} here", *rnd.sample(blocks, rnd.randint(0, 6)), *rnd.sample(blocks[:4], 2)] for k in range(60)]
    pages += pages[:8]
    host = lambda k: f"h{k % 3}.example"
    seen = [Counter(b for p in {tuple(pages[k]) for k in range(len(pages)) if k % 3 == h} for b in set(p)) for h in range(3)]
    table = [(k, f"https://{host(k)}/{k}", "<body>" + "".join(f"<div class=c{len(b)}><p>{b}</p></div>" for b in p)) for k, p in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()}
    want = {k: "\n".join(b for b in p if seen[k % 3][b] < html.LEAST_PAGES) for k, p in enumerate(pages)}
    assert got == want and sum(len(x.split("\n")) for x in want.values()) < sum(map(len, pages)) - 100


def test_known_answers(spark):
    bodies = {
        '<article><p class="a"">kept text</p><p title=it\'s>and this</p></article>': "kept text\nand this",
        "<article>main</article><article class=comment>reader comment</article>": "main",
        '<article><div class="share-price">12 euros</div><p class="notice-period">three months</p><div class="share-box">tweet</div></article>': "12 euros\nthree months",
        "<article><header><h1>Title</h1><a>menu</a></header><p>Text</p></article>": "Title\nText",
        "<article><p>one<div/>two<br/>three</article>": "one\ntwo three",
        "<article><p>unclosed <a href='x>y": "unclosed",
        "<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table></article>": "a\nb\nc\nd\ne\nf",
    }
    assert texts(spark, list(bodies)) == dict(enumerate(bodies.values()))


def test_hostile_pages_take_linear_time(spark):
    deep = "<div>" * 1500 + "x" + "</div>" * 1500
    began = time.time()
    pages = [f"<article>{deep}</article><article>{deep}</article>", "<b>" * 20_000 + "</i>" * 20_000 + "t", "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000 + "t", "<div><b>" * 20_000 + "<td></td>" * 20_000 + "t", "<p " + "a=\"b" * 20_000, "<" * 50_000]
    got = texts(spark, pages)
    assert time.time() - began < 60
    assert got[0] == "x\nx" and got[1] == got[2] == got[3] == "t" and got[4] == "" and got[5] == "<" * 50_000
