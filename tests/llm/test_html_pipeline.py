import html
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import private_data, queries
from tallymark.llm.html_text import extract, main_text
from tests.llm.test_duplicates import brute_components
from tests.llm.test_text_models import brute_spans

SMALL = "/root/testdata/sf0.001"


def article(page):
    """The blocks of the only article of a made page, by plain cutting."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside))
    texts = [" ".join(html.unescape(b.replace("<br>", " ")).split()) for b in blocks]
    return " ".join(t for t in texts if t)


def test_pages_against_plain_cutting(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = queries.op6_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    assert all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


BODY = "<p>" + "Plenty of words stand in this paragraph of the story. " * 8 + "</p>"
TEXT = " ".join(("Plenty of words stand in this paragraph of the story. " * 8).split())


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   ", ""), ("plain &amp; text", "plain & text"), ("<p>", ""), ("<a<a<a", ""), ("<!-- x", ""), ("text <3 you &lt;b&gt;", "text <3 you <b>"),
    ('<div class="ad">x</div><p>Hello <b>wor</b>ld<br>again</p>', "Hello world again"),
    ("<article><header><h1>T</h1></header><p>x <script>var a='</p>'</script>y</article>", "T x y"),
    ("<table><tr><td>a<td>b</table>", "a b"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    (f'<body><header><a href=x>Home</a></header><div id="menu"><a>one</a></div><main><h1>Title</h1>{BODY}<p>Short.</p></main>'
     f'<div class="comments-list">{BODY}</div><aside>{BODY}</aside><form>Name<input></form><footer>{BODY}</footer></body>', f"Title {TEXT} Short."),
    (f'<div><div class=top><a>one</a> <a>two</a> <a>three</a></div><h2>Title</h2><div class=text>{BODY}<ul><li>a item<li>b item</ul></div></div>', f"Title {TEXT} a item b item"),
    (f"<article>{BODY}</article><article>{BODY}</article>", f"{TEXT} {TEXT}"),
    (f'<p title="a>b">{TEXT}</p>', TEXT),
])
def test_page_forms(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", [
    f'<p class="notice">Cookies<p>{TEXT}', f'<ul><li class="share">Share</ul><div>{BODY}</div>', f'<table><tr><td class="sidebar">x<td>{BODY}</table>',
    f"<html><head><title>x</title><meta charset=a><div>{BODY}</div>", f"<head><link href=a><body><div>{BODY}</div>", f"<div><form>Name</div><div>{BODY}</div>",
    f"<nav><ul><li>a<li>b</nav><div>{BODY}</div>", f"<head><noscript><link href=a></noscript><title>x</title></head><div>{BODY}</div>",
    f"<div><button><div>x</button>{BODY}</div>",
])
def test_furniture_without_end_tags(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page", [
    *[f'<div class="{name}"><article>{BODY}</article><div class="ads">x</div></div>' for name in ("content has-sidebar", "layout-with-nav", "no-comments", "search-result-page")],
    f'<div id="page-with-nav"><div class="Sidebar">{BODY[:90]}</div><div>{BODY}</div></div>', f"<form action=x><div>{BODY}</div></form>",
    *[f'<div>{BODY}</div><div class="{name}"><p>Some words of readers stand here, too, and are enough to be kept.</p></div>' for name in ("Sidebar", "pageFooter", "Comments", "userCOMMENTS", "ADBanner")],
])
def test_wrappers_and_capitals_in_names(page):
    assert main_text(page) == TEXT


def test_page_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "<p>x</p>"), (3, "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(df, ["page_id"]).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 499_999)]
    assert extract(df.limit(0), ["page_id"]).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(900_001, None), (900_002, ""), (900_003, "12345 678 !!"), (900_004, "𐌰𐌱𐌲 𐌳𐌴"), (None, "No id but words enough to be kept, the and of."), (900_005, "write to a.b@c.example.com or call +1 (222) 555-0100 the and of"),
             (900_006, "write to a.b@c.example.com or call +1 (222) 555-0100 the and of")]
    more = spark.createDataFrame(extra, "doc_id long, text string").select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("made").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(more).withColumn("score", F.lit("clash")).withColumn("__row", F.lit(1))
    out = [docs.cache()]
    for _, function in corpus_pipeline.STAGES:
        out.append(function(spark, out[-1], SMALL).cache())
    return [(d.columns, d.collect()) for d in out]


def test_stages_keep_their_columns(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])


def test_language_stage(stages):
    before, after = stages[0][1], stages[1][1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {900_001, 900_002, 900_003, 900_004} and None in {r.doc_id for r in after}
    assert all(r.lang for r in after)


def test_dedup_stage(stages):
    before, after = stages[1][1], stages[2][1]
    want = brute_components([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if i == c} | {None}
    assert 900_005 in {r.doc_id for r in after} and 900_006 not in {r.doc_id for r in after}


def test_decontamination_stage(spark, stages):
    before, after = stages[2][1], stages[3][1]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split())
    bad = {r.doc_id for r in before if any(plain(i) in plain(r.text) for i in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == bad


def test_private_data_stage(stages):
    before, after = {r.doc_id: r for r in stages[3][1]}, {r.doc_id: r for r in stages[4][1]}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text) and brute_spans(r.text) == ""
        if not brute_spans(before[i].text):
            assert r.text == before[i].text
    assert after[900_005].text == "write to <EMAIL> or call <PHONE> the and of"


def test_packing_stage(stages):
    assert {r.doc_id for r in stages[5][1]} == {r.doc_id for r in stages[4][1]}


def test_all_kinds_are_named():
    assert private_data.KINDS == ("email", "ip", "card", "phone") and len(corpus_pipeline.STAGES) == 5
