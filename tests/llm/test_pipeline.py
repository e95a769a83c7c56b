"""The pipeline's stages take effect one after the other."""

import corpus_pipeline as cp
from lorecast.llm.exact_dedup import exact_dedup
from lorecast.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, table = table, cp.materialize(stage(spark, table, SF), name)
        assert table.columns == list(cp.COLUMNS)
        assert table.exceptAll(before).count() == 0
        if name == "exact_dedup":
            assert exact_dedup(table).where("not kept").count() == 0
        if name == "ngram_jaccard_join":
            assert jaccard_components(table).where("component_id <> doc_id").count() == 0
    assert cp.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_run(spark):
    found = cp.run(spark, SF)
    assert 0 < found.count() < 200
    assert found.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]


def test_empty_and_null_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        table = cp.materialize(stage(spark, table, SF), name) if name != "mixing" else stage(spark, table, SF)
        assert table.count() == 0
