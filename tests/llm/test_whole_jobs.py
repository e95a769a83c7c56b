"""The training-data operators do the whole job where a shorter one once passed."""

from lorecast.llm import licenses, queries

SF = "/root/testdata/sf0.01"


def test_query_finds_every_notice(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in queries.op9_licenses(spark, SF).collect()}
    notices = licenses.TEMPLATES[:4] + licenses.SHORT_TEMPLATES
    want = {(r["doc_id"], n) for r in table.collect() for n, t in notices if t in r["text"]}
    assert got == want
    assert sum(n == "All-Rights-Reserved" for _, n in want) == 7


def test_short_templates_in_short_texts(spark):
    texts = ["All rights reserved.", "all RIGHTS reserved", "rights reserved", "all the rights reserved", None, "", "x " * 40 + "(All rights reserved.)"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in licenses.scan_licenses(rows, licenses.SHORT_TEMPLATES).collect()} == {0, 1, 6}
