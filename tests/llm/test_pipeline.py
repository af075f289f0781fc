import zlib

import numpy as np

import corpus_pipeline
from llm.test_orc_tokens import plain

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF), name)
        if name != "tokens":
            assert out.columns == docs.columns
        else:
            texts = [r.text for r in docs.orderBy("doc_id").collect()]
            ids = plain(texts)
            assert sorted(r.ids_crc32 for r in out.collect()) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids)
        docs = out
        counts.append(out.count())
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert n == counts[0] > counts[1] > counts[2]
    assert counts[3] == counts[4] > 0


def test_every_stage_takes_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat and the dog", "en", "a", 1), (1, "the cat and the dog", "en", "a", 1), (None, "a null id", "en", None, 1), (2, None, None, None, None), (3, "", "de", "b", 0), (4, "der hund und die katze", "de", "b", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        docs.write.parquet(f"{tmp_path}/{len(given)}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{len(given)}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{len(given)}")
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert out.filter("doc_id = 3").count() == 0


def test_rows_are_told_apart_by_more_than_their_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string"
    a, b, c = ("a b c d e f g h i j", "q w e r t z u i o p", "y x c v b n m l k j")
    rows = [(1, a), (1, b), (2, b), (3, c), (None, c), (None, "other words that stand alone in here"), (4, a), (4, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (3, c), (None, rows[5][1])], key=str)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    taken = [(r.doc_id, r.text) for r in mixed.collect()]
    # Half as much again as there is, so each row once or twice, and those without an id too.
    assert len(taken) in (12, 13) and set(taken) == set(rows)
    assert all(rows.count(r) <= taken.count(r) <= 2 * rows.count(r) for r in rows)
    assert taken == [(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs.repartition(3), SF).collect()]


def test_null_ids_reach_the_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(None, "the cat and the dog of the house", "en", "a", 1), (5, "a dog is in the house and the cat is out", "en", "a", 1)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.write_token_ids(spark, corpus_pipeline.mix_sources(spark, docs, SF), SF)
    assert {r.doc_id for r in out.collect()} == {None, 5}
