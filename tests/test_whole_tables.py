"""Queries without SQL take the whole table, not its first ids or rows."""

import duckdb
import pytest

from lorecast.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stated(spark):
    ids = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    return {i for i in ids if i % 50 == 0}


def test_mmr_answers_every_stated_query(spark, stated):
    got = catalog.QUERIES["mmr_top10"](spark, SF).select("query").distinct().collect()
    assert len(stated) > 1 and {r[0] for r in got} == stated


def test_paired_statistics_see_all_evidence(spark):
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    want = {(q, i) for q in label if q % 50 == 0 for i in label if i != q and label[i] == label[q]}
    assert {(r["query"], r["id"]) for r in catalog.whole_gold(table).collect()} == want
    assert {r["query"] for r in catalog.paired(table).collect()} == {q for q, _ in want}


def test_bigrams_score_passages_beyond_any_position(spark, tmp_path):
    texts = [f"plain filler number{i}" for i in range(45)]
    texts[41] = "the amber lantern swung slowly"
    rows = [(i, x, "en", "one", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "amber lantern")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.QUERIES["bm25_latin_bigrams"](spark, str(tmp_path)).collect()
    assert [(r["query"], r["id"]) for r in got] == [(7, 41)]


def test_spans_of_odd_quantities_equal_their_sql(spark, tmp_path):
    """Fractions are rounded as the SQL rounds them; quantities may be null."""
    rows = [(1, 1, 8.6), (1, 2, 2.5), (2, 1, 9.5), (2, 2, 3.0), (3, 1, None), (3, 1, 4.0), (3, 2, None), (4, 1, 30.0), (4, 2, None), (4, 3, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["highlight_spans"](spark, str(tmp_path)).select("doc", "start", "end").collect()
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.sql(f'select doc, start, "end" from ({catalog.ORACLES["highlight_spans"]})').fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
