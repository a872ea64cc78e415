"""Search, page text, the pipeline and the registered queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import html, topk
from sievemill.llm.queries import ORACLE, QUERIES


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(120)]
    rows += [(200, None, "x"), (201, [1.0, None], "x"), (250, [float("nan")] * 6, "x"), (202, [float("inf")] * 6, "x"), (203, [], "x"), (300, rows[0][1], "x"), (None, rows[0][1], "x")]
    rows += [(150, rows[7][1], "x"), (151, rows[7][1], "x"), (152, rows[7][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    sound = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in sound if i % 50 == 0):
        score = {i: sum(a * b for a, b in zip(sound[q], v, strict=False)) for i, v in sound.items() if i != q}
        want += [(q, k + 1, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
    for block in (16, 10_000):
        got = topk.top_k(topk.quantised(table), F.col("vec_id") % 50 == 0, block_rows=block, block_queries=2)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(topk.quantised(table.where("false")), F.col("vec_id") % 50 == 0).collect() == []


def test_a_vector_repeated_very_often(spark):
    hot = spark.range(40_000).selectExpr("7L AS vec_id", "array(3L, 4L) AS terms")
    table = hot.union(spark.createDataFrame([(50, [1, 1]), (50, [1, 1]), (8, [3, 4]), (9, [9, 9]), (1, []), (2, None), (3, [9, None]), (None, [99, 99])], "vec_id long, terms array<long>"))
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, block_rows=1000)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(50, 1, 9, 18), *((50, n, 7, 7) for n in range(2, 6))]
    sizes = table.groupBy("vec_id", "terms").count()
    assert sizes.count() == 8 and max(r["n"] for r in got.groupBy("query_id", "vec_id").agg(F.count("*").alias("n")).collect()) == 4
    assert topk.top_k(table, F.col("vec_id") == 7, k=2).count() == 2  # a repeated query asks once


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(topk.quantised(table), F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, many of them, all day long.</div>
<article><h1>Fish &amp; chips</h1><p>A   long paragraph that says <b>some</b>thing about
fish&#44; and more.<br>Next</p><p>Short.</p><form><p>Your name</p></form><div class="comments"><p>A long comment by a reader of this page.</p></div></article>
<aside>Read this too</aside><div class="ad">Buy now</div><footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert html.main_text(PAGE) == "Fish & chips A long paragraph that says something about fish, and more. Next Short."
    bare = '<div class="menu"><a>x</a></div><div id="content"><p>A paragraph that is long enough to be the content.</p><p>Two.</p></div><div class="sidebar">Side text</div>'
    assert html.main_text(bare) == "A paragraph that is long enough to be the content. Two."
    assert html.main_text("just text") == "just text" and html.main_text("<nav>menu</nav>") == "" and html.main_text("<p><b>a<p>b") == "a b"


LONG = "This sentence is repeated to make a paragraph of the length that articles have. " * 4


def test_names_and_marks_do_not_decide_alone():
    split = f"<article><p>Teaser only.</p></article><div><p>{LONG}</p><p>{LONG}</p></div>"
    assert html.main_text(split).count("This sentence") == 8
    paper = f'<article><h1>T</h1><p>{LONG}</p><div class="related-work"><p>{LONG}</p></div><div class="related-posts"><p>Read our other story</p></div></article>'
    assert html.main_text(paper).count("This sentence") == 8 and "other story" not in html.main_text(paper)
    shared = f'<nav>menu</nav><div class="post-share-count widget"><h1>Title</h1><p>{LONG}</p><p>Short.</p></div><footer>us</footer>'
    assert html.main_text(shared) == f"Title {LONG.strip()} Short."
    links = "".join(f'<li><a href="{i}">Entry number {i}</a></li>' for i in range(30))
    assert html.main_text(f"<div><ul>{links}</ul></div><div><p>{LONG}</p></div>") == LONG.strip()


SHORT_BETWEEN = f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div><section><p>Ten.</p></section>" + "<div><p>x</p></div>" * 9


def test_smoothing_and_threshold_select_the_regions(monkeypatch):
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist() if p]
    whole = [html.main_text(p) for p in pages]
    with_it = html.main_text(SHORT_BETWEEN)
    assert all(whole) and "Ten." in with_it and not with_it.endswith("x")
    with monkeypatch.context() as m:
        m.setattr(html, "smoothed", lambda ratio: ratio)
        assert "Ten." not in html.main_text(SHORT_BETWEEN)
    with monkeypatch.context() as m:  # nothing comes from elsewhere
        m.setattr(html, "smoothed", lambda ratio: 0 * ratio)
        assert not any(html.main_text(p) for p in pages)
    with monkeypatch.context() as m:  # the threshold, and no mark, keeps asides out
        m.setattr(html, "scores", lambda page: np.ones(len(page.lines)))
        assert all(len(html.main_text(p)) > len(w) for p, w in zip(pages, whole, strict=True))


def test_article_text_of_the_tables(spark):
    """Every page of the tables: the text of its article, told from the rest by its place in the html."""
    import re
    from html import unescape

    for r in html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(" ".join(unescape(re.sub("<[^>]+>", " ", body)).split()).split())
        assert r["text"].split() == want.split()


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t"), (3, "w", "<p>" + "long text " * 50_000, "t")], "page_id long, url string, html string, text string")
    out = html.extract(pages).collect()
    assert [r["n_chars"] for r in out] == [len(r["text"]) for r in out] and len(out) == 5
    assert sorted(len(r["text"]) for r in out) == [0, 0, 83, 83, 499_999]
    assert html.extract(pages.where("false")).collect() == []


def test_pipeline(spark, odd_docs, tmp_path):
    import corpus_pipeline

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = odd_docs, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == odd_docs.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    ids = {r["doc_id"] for r in odd_docs.select("doc_id").collect()}
    assert ids - kept[0] == {1, 2, 3}  # no letter
    assert kept[0] - kept[1] == {5, 7, 8} and kept[1] == kept[2] == kept[3]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def test_pipeline_stages_on_no_rows_and_clashing_names(spark, odd_docs):
    import corpus_pipeline

    more = {"score": 42.0, "lang_pred": "x", "_text": "y", "_id": 7, "_spans": "z", "row": 1, "id": 2, "key": "k", "doc_tokens": 3, "_row": 4, "_group": 5}
    clashing = odd_docs.withColumns({k: F.lit(v) for k, v in more.items()})
    plain, full = odd_docs, clashing
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, full.where("false"), "")
        assert empty.count() == 0 and empty.columns == (full.columns if name != "packing" else empty.columns)
        plain, full = (stage(spark, d, "") for d in (plain, full))
        if name != "packing":
            assert full.columns == clashing.columns
            assert all(r[k] == v for r in full.collect() for k, v in more.items())
        shown = full.select(*plain.columns)
        assert sorted(map(repr, shown.drop("sequence_id", "offset").collect())) == sorted(map(repr, plain.drop("sequence_id", "offset").collect()))
        plain, full = (spark.createDataFrame(d.collect(), d.schema) for d in (plain, full))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    home = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{home}/{t}.parquet'")
    want = con.execute(ORACLE[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(tuple, QUERIES[name](spark, home).select(*columns).collect())) == sorted(want)


def test_random_pages_never_crash():
    rng = random.Random(1)
    for _ in range(200):
        html.main_text("".join(rng.choice(["<p>", "</p>", "<div class=ad>", "</div>", "text ", "<", ">", "&amp", "<!--", "-->", "<a href='", "<![", "<![CDATA[", "<!x", "<?", "</", "]]>", "=\"", "<script>", "<br/>", "<article>", "</body>"]) for _ in range(40)))


def test_malformed_pages_are_read_in_linear_time():
    import time

    for page, text in (
        ("a<![foo[x]]>b", "ab"), ("a<![>b", "ab"), ("a<![ x", "a"), ("a<![CDATA[ x > y ]]>", "a y ]]>"), ("<p>a<!-- never closed > b", "a"), ("<p>one</p> 1 < 2 <a href='x", "one 1 < 2"),
        ("<p>a <b x=\"never closed>b</b>", "a"), ("</p></i>a</zz>", "a"), ("<p>a &amp; b &lt", "a & b <"), ("<p>a</p><", "a <"),
    ):
        assert html.main_text(page) == text
    began = time.time()
    for unit in ("<a ", "<a b='>' ", "<!-- > ", "<![", "</x ", "</x>", "<b></i>", "<article>", "<a x=\"", "<", "&", "<p>", "<script></y ", "<?", "<!x"):
        html.main_text(unit * (400_000 // len(unit)))
        html.main_text("<div>" * 20_000 + unit * (200_000 // len(unit)) + ">")
    assert time.time() - began < 60
    began = time.time()
    assert html.main_text("<a " * 350_000) == "" and time.time() - began < 1
