"""Language ID: agreement with labelled text, evidence where the text says nothing, odd rows."""

from llm_fixtures import SF_SMALL

from netsieve.llm.op3_language_id import identify


def test_text_decides_and_priors_step_in(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    known = docs.select("doc_id", "lang", "text").limit(60).collect()
    rows = [(r.doc_id, f"https://h{r.lang}.example.{r.lang}/p", f"<html lang=\"{r.lang}\"><p>{r.text}</p></html>") for r in known]
    rows += [(900, "https://hde.example.de/x", "<html lang='de'><p>12 34</p></html>"), (901, None, None),
             (902, "not a url", ""), (None, "https://hfr.example.fr/", "<html></html>"), (900, "https://hde.example.de/x", None)]
    got = identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert len(got) == len(rows) and all(0 < r.score <= 1 for r in got)
    lang = {r.page_id: r.lang for r in got}
    assert sum(lang[r.doc_id] == r.lang for r in known) >= 57
    assert {r.lang for r in got if r.page_id == 900} == {"de"} and lang[None] == "fr"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert identify(pages.limit(0), docs).count() == 0 and identify(pages, docs.limit(0)).count() == 0
