import numpy as np
from pyspark.sql import functions as F

from cargohold.llm import language_id as li

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_the_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Labels of the held-out fold are of no use to a model that doesn't read them.
    hidden = docs.withColumn("lang", F.when(li.held_out("doc_id"), F.lit("wrong")).otherwise(F.col("lang")))
    model = li.train(hidden)
    assert model.languages == ("de", "en", "es", "fr")
    rows = li.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.ambiguous for r in rows) <= len(rows) // 200


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = li.codewords(n)
        assert len({tuple(r) for r in code}) == n
        if n > 2:
            apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
            assert apart >= (2 if n == 3 else 3)


def test_decoding_corrects_a_wrong_bit():
    code = li.codewords(4)
    model = li.Model(("a", "b", "c", "d"), np.zeros((1, 7)), code, np.full(code.shape, 1 / 7))
    margins = code[2:3].astype(float).copy()
    margins[0, 3] *= -1
    best, score, doubt = li.decode(margins, model)
    assert best[0] == 2 and 0.25 < score[0] <= 1 and not doubt[0]
    _, score, doubt = li.decode(np.zeros((1, 7)), model)
    assert doubt[0] and abs(score[0] - 0.25) < 1e-9


def test_long_texts_and_parts_agree():
    text = "Der Hund läuft. " * 60_000
    table = np.random.default_rng(0).normal(size=(li.BUCKETS, 3)).astype(np.float32)
    whole, n = li._margins([text, "", None, "a\0b"], table)
    short, m = li._margins(["Der Hund läuft. " * 100], table)
    assert n[0] == 600 * m[0] and np.allclose(whole[0], short[0], atol=1e-3)
    assert n[1] == n[2] == 0 and n[3] == 4


def test_nulls_ties_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    rows = [(1, "the cat and the dog", "en", "", 0), (3, "der hund und die katze", "de", "", 0), (4, None, "en", "", 0), (5, "123 !", None, "", 0),
            (None, "the dog", "en", "", 0), (7, "", "de", "", 0), (8, "the dog", None, "", 0), (8, "the dog", None, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    docs = docs.filter(~li.held_out("doc_id") | F.col("lang").isNull())
    model = li.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in li.identify(docs, model).collect()}
    assert {(5, "und"), (8, "en")} <= got and (None, "en") in got
    assert li.keep_identified(docs, model).columns == docs.columns
    empty = spark.createDataFrame([], schema)
    nothing = li.train(empty)
    assert nothing.languages == () and li.identify(empty, nothing).collect() == []
    assert {r.lang_pred for r in li.identify(docs, nothing).collect()} == {"und"}
