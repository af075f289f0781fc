import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargohold.llm import language_id, near_dedup, orc_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", "don't we'll it's", "two  blanks", "tab\there", "end ", " start", "line\n\nline", "x\r\ny", "<|endoftext|> here",
       "naïve Übergröße ñandú", "数据 処理 données", "a1b2 3.14 --- ... !?", "é ‍ \U0001f600", "word" * 40, "\n lead", "tail\n", " nbsp", "½ ² Ⅷ"]


def plain(texts, path=PATH):
    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def encoded(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_are_the_librarys_for_any_text():
    rng = random.Random(3)
    letters = "ab é\nZ9.ß,x'- "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    parts = ["a", "B", "é", "1", "٣", "'", "'s", "'re", "'ll", "'ve", "'d", "'t", "'m", "'S", " ", "  ", "\n", "\t", "\r\n", " \n", "!", "“", "漢", "́", "\U0001f600", "<|endoftext|>", "\x0b", "'sabc", "''s"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(5000)]
    assert encoded(orc_tokens.Encoder(PATH), [*texts, None]) == plain([*texts, None])
    assert encoded(orc_tokens.Encoder(PATH), []) == []


def test_contractions_and_white_space_stay_on_the_fast_path(monkeypatch):
    encoder = orc_tokens.Encoder(PATH)
    monkeypatch.setattr(encoder, "_each", None)  # would be called for a whole text
    texts = ["I don't, we'll, they're 'quoted' o'clock", "two  blanks\t\ttabs\r\n\r\nlines  ", "  lead", "it''s 'S"]
    assert encoded(encoder, texts) == plain(texts)


def test_another_tokenizer_gives_the_librarys_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoded(orc_tokens.Encoder(path), ODD) == plain(ODD, path)


def test_long_texts_and_words():
    texts = ["word " * 500_000, "x" * 5000 + " 'y" * 1000, "é" * 3000]
    assert encoded(orc_tokens.Encoder(PATH), texts) == plain(texts)


@pytest.mark.parametrize("room", [50, 7])
def test_memory_is_bounded(monkeypatch, room):
    monkeypatch.setattr(orc_tokens, "REMEMBERED", room)
    encoder = orc_tokens.Encoder(PATH)
    for start in range(0, 300, 30):
        texts = [f"ab{i} cd{i} often {'long' * 6}{i % 3}" for i in range(start, start + 30)]
        assert encoded(encoder, texts) == plain(texts)
        assert encoder.entries <= room


def test_pre_tokens_met_again_stay_in_memory(monkeypatch):
    monkeypatch.setattr(orc_tokens, "REMEMBERED", 60)
    encoder, learnt = orc_tokens.Encoder(PATH), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda tokens, *a: (learnt.extend(tokens), learn(tokens, *a)))
    for i in range(200):
        texts = [f" common words here rare{i}", " common words here"]
        assert encoded(encoder, texts) == plain(texts)
    assert learnt.count(b" common") == 1


def test_round_trip_in_order(spark, tmp_path):
    rows = [(i * 37 % 500, f"text number {i} of some words", "c") for i in range(500)]
    rows += [(None, "no id", "c"), (501, None, "c"), (502, "", "c"), (7, "again", "c"), (7, "again", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = f"{tmp_path}/tokens"
    orc_tokens.write_tokens(docs, path, PATH)
    got = sorted(orc_tokens.token_index(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = plain([r[1] for r in want])
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    stored = orc_tokens.read_tokens(spark, path).filter("doc_id = 502").collect()
    assert [r.ids for r in stored] == [[2]]
    assert glob.glob(f"{path}/part-*.orc")


def test_no_rows(spark, tmp_path):
    orc_tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", PATH)
    assert orc_tokens.token_index(spark, f"{tmp_path}/none").collect() == []


def test_a_read_by_id_skips_row_groups(spark, tmp_path):
    rows = spark.range(0, 20_000, 2, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = f"{tmp_path}/tokens"
    orc_tokens.write_tokens(rows.coalesce(1), path, PATH)
    for wanted, found in ((5000, 1), (5001, 0)):
        one = orc_tokens.read_tokens(spark, path).filter(F.col("doc_id") == wanted)
        assert one.count() == found
        plan = one._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        read = sum(leaf.metrics().apply("numOutputRows").value() for leaf in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())))
        # Statistics leave one row group; its Bloom filter rules out ids that lie between those it holds.
        assert read <= (orc_tokens.ROWS_PER_INDEX if found else 0)


def test_a_worker_lets_the_encoder_go_when_it_gets_another_operators_task():
    held = orc_tokens.encoder(PATH)
    list(orc_tokens._sums(iter([])))
    assert orc_tokens.encoder(PATH) is held
    empty = iter([])
    tasks = [near_dedup._sign(5), near_dedup._emit_keys, near_dedup._stars, near_dedup._within, near_dedup._confirm(5, 80), near_dedup._near_in_block(80), near_dedup._links_in_block(5, 80), language_id._count(("en",))]
    for task in tasks:
        held = orc_tokens.encoder(PATH)
        list(task(empty))
        assert orc_tokens.encoder(PATH) is not held
