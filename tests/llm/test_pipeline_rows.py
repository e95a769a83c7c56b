"""Null and repeated ids: the pipeline decides by row."""

import zlib

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"word{i}" for i in range(80))


def kept(spark, stage, rows):
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()), key=repr)


def test_exact_copies_of_repeated_and_null_ids(spark):
    rows = [(7, "a copy"), (9, "a copy"), (7, "its own"), (None, "a copy"), (None, "alone"), (None, "alone")]
    assert kept(spark, cp.exact_copies, rows) == sorted([(9, "a copy"), (7, "its own"), (None, "alone")], key=repr)


def test_near_copies_of_repeated_and_null_ids(spark):
    near, more = BASE + " tail", BASE + " end"
    rows = [(3, BASE), (7, near), (7, more), (7, "quite another text of six words"), (None, BASE + " last"), (8, "one two three four five six")]
    assert kept(spark, cp.near_copies, rows) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
    assert len(kept(spark, cp.near_copies, [(7, near), (7, more)])) == 1


def test_a_leak_takes_only_its_own_row(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, leak), (None, BASE), (4, leak + " "), (4, BASE + " tail")]
    assert kept(spark, cp.decontaminate, rows) == sorted([rows[1], rows[3]], key=repr)


def test_toxicity_stage_learns_from_long_texts_too(spark, tmp_path):
    """All toxic labels are on texts over 100,000 bytes."""
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    long = "calm " * 20_100
    rows = [(i, f"{long} hideous", 1) for i in learnt[:60]] + [(i, long, 0) for i in learnt[60:100]] + [(i, "calm day", 0) for i in learnt[100:200]]
    rows += [(1000 + i, "calm hideous" if i < 30 else "calm day", None) for i in range(60)]
    docs = spark.createDataFrame([(i, x, "en", "one", len(x)) for i, x, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stay = {r["doc_id"] for r in cp.toxicity(spark, docs, str(tmp_path)).select("doc_id").collect() if r["doc_id"] >= 1000}
    assert stay == set(range(1030, 1060))
