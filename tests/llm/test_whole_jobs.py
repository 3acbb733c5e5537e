"""What each operator once left out: boilerplate inside a declared article, and what a corpus of any size teaches."""

from __future__ import annotations

import pytest

from barloom.llm import html_extract, lm


def _site(spark, wrap, n=12):
    """Pages with an unmarked line among paragraphs, an unmarked box, and two copies of one page."""
    own = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(n)]
    page = lambda k: wrap.format(f"<h1>Title {k}</h1><p>Read more from our partners today.</p><p>{own[k]}</p><p>{own[k][::-1]}</p><div><section>Follow us</section></div>")
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(n)]
    rows += [(100 + k, f"http://a.example/copy{k}", page(0)) for k in range(30)]  # copies of one page are no boilerplate
    rows += [(200, "http://b.example/1", page(1)), (201, "http://b.example/2", page(2))]  # two pages say too little
    out = {r.page_id: (r.text, r.n_removed) for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return out, own


def test_unmarked_boilerplate_inside_an_article(spark):
    out, own = _site(spark, "<body><div>Top of site</div><article>{}</article></body>")
    for k, n in [*((k, k) for k in range(12)), (100, 0), (129, 0)]:
        assert out[k if k < 12 else k][0] == f"Title {n} {own[n]} {own[n][::-1]}"
    assert "partners" in out[200][0] and out[200][1] == 0


def test_unmarked_boilerplate_without_an_article(spark):
    out, own = _site(spark, "<body><div class=top>Top of site</div><div class=text>{}</div></body>")
    for k in range(12):
        assert out[k] == (f"Title {k} {own[k]} {own[k][::-1]}", 3)


def test_lm_score_is_the_same_with_any_part_of_the_table_in_workers(spark, small, monkeypatch):
    monkeypatch.setattr(lm.Attention, "train", lambda *_: [])  # the table alone is looked at
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text")
    whole, few = ({r.doc_id: (r.n_known, r.score) for r in lm.score_documents(docs, table_words=n).collect()} for n in (1 << 17, 50))
    assert whole.keys() == few.keys() and len(whole) > 20
    for k, (known, score) in whole.items():
        assert few[k] == (known, pytest.approx(score, rel=1e-6))


def test_lm_samples_equal_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Attention, "train", lambda self, inputs, *rest: seen.append(len(inputs)))
    rows = [(k, "one and the same line of words") for k in range(50)] + [(100, "another line")]
    lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [2]
