"""The style tree decides without declared names, and odd pages have defined results."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import html_extract, queries
from tests.oracle import connect

SITE = "/root/testdata/sf0.1"


def test_names_taken_away(spark):
    """The stored pages with every declaring element and attribute made a bare div still give the article."""
    want = {r[0]: r[2] for r in connect(SITE).execute(queries.OP1_SQL).fetchall()}
    bare = F.regexp_replace(F.regexp_replace("html", r"<(article|nav|footer|header|aside|main)\b[^>]*>", "<div>"), r"</(article|nav|footer|header|aside|main)>", "</div>")
    pages = spark.read.parquet(f"{SITE}/pages.parquet").withColumn("html", F.regexp_replace(bare, r' (class|id|role)="[^"]*"', ""))
    got = html_extract.extract_main_text(pages).collect()
    assert len(got) == len(want)
    assert sum(r.text == want[r.page_id] for r in got) >= 0.9 * len(got)
    assert sum(r.n_removed > 0 for r in got) >= 0.9 * len(got)


def test_declared_branches_are_scored_too(spark):
    got = html_extract.extract_main_text(spark.read.parquet(f"{SITE}/pages.parquet"))
    assert got.where("n_low = 0").count() < 0.1 * got.count()


def test_odd_pages(spark):
    page = "<body><nav><a href=/>Home</a></nav><article><p>One  &amp; two<p>three</article><footer>end</footer></body>"
    rows = [(1, "http://a.example/", page), (1, "http://a.example/", page), (2, None, page), (3, "http://a.example/x", None), (4, "", ""), (None, "no url", "<p>bare text")]
    rows += [(5, "http://a.example/long", "<article>" + "<div><p>word</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_main_text(pages).collect()}
    assert got[1, "http://a.example/"] == got[2, None] == ("One & two three", 15)
    assert got[3, "http://a.example/x"] == got[4, ""] == ("", 0)
    assert got[None, "no url"] == ("bare text", 9)
    assert got[5, "http://a.example/long"][1] == 20000 * 5 - 1
    assert html_extract.extract_main_text(pages).count() == len(rows)
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
