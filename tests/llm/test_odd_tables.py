"""Odd rows of URL filters, token counts and the pipeline, and empty tables."""

from __future__ import annotations

import hashlib

from barloom.llm import tokencount, urlfilter


def test_url_filters(spark):
    block, alias = "http://example.org/es/a", "http://other.net/x"
    link = f'<link rel="canonical" href="{block}">'
    rows = [(1, block, ""), (2, alias, link), (2, alias, link), (3, None, link), (4, "no scheme", None), (5, "http://www.org/ok", link), (6, "http://far.net/y", f'<meta http-equiv=refresh content="0; url={alias}">'), (7, "http://lone.net/", "z" * 300_000), (None, "http://lone.net/", None)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, verdict int")
    judged = urlfilter.judge_urls(pages.select("page_id", "url", "html"))
    got = {(r.page_id, r.url if "url" in judged.columns else None): r.verdict for r in judged.collect()}
    verdict = {k[0]: v for k, v in got.items()}
    assert judged.count() == len(rows)
    assert (verdict[1], verdict[2], verdict[6]) == ("block", "block", "block")
    assert (verdict[3], verdict[4], verdict[5], verdict[7], verdict[None]) == ("allow",) * 5
    assert urlfilter.judge_urls(pages.select("page_id", "url", "html").limit(0)).count() == 0


def test_token_counts(spark):
    rows = [(1, None), (2, ""), (3, "Call 555-0100 or mail a@b.example now"), (3, "Call 555-0100 or mail a@b.example now"), (None, "x"), (4, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_tokens string")
    assert tokencount.count_with_edits(docs).count() == len(rows)
    assert tokencount.count_with_edits(docs.limit(0)).count() == 0


def test_pipeline_on_odd_and_empty_documents(spark, tmp_path, small):
    import corpus_pipeline

    words = " ".join(f"w{hashlib.md5(bytes([k])).hexdigest()[:5]}" for k in range(60))
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, words, None, None, 9), (4, words, "de", "t", 9), (4, words, "de", "t", 9), (None, "no id here", "en", "s", 1), (5, "tail " * 40_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 5, None]
    empty = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
