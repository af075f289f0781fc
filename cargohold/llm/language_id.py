"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.llm.common import let_go

#: Hashed n-grams; labelled rows of each language that a classifier is fitted on (about, chosen by hash of the id).
BUCKETS = 1 << 15
TRAIN_ROWS = 2000
#: Languages up to which every split of the languages is a bit of the code; beyond, a random code of 10 log2(n) bits.
EXHAUSTIVE = 7
#: Steepness of the logistic loss on a mean log-odds, and of the score; gap of losses under which a text is ambiguous.
SHARPNESS, SCORE_SHARPNESS, AMBIGUOUS_GAP = 4.0, 8.0, 0.01
#: Characters per vectorised step.
STEP = 1 << 18
NONE = "und"


@dataclass(frozen=True)
class Model:
    """Bit classifiers (BUCKETS x bits), codewords (languages x bits, +1 and -1) and weights of their losses."""

    languages: tuple[str, ...]
    table: np.ndarray
    code: np.ndarray
    weights: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, as far apart as the construction gives; no bit is the same for all."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    bits, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(0), (-1, None)
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        gram = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(gram, -bits)
        apart = (bits - gram.max()) // 2
        best = max(best, (int(apart), code), key=lambda x: x[0])
    return best[1]


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams of letters: each letter alone and with both neighbours; a gap counts as one blank."""
    joined = "\0" + "\0".join((t or "").lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    owner = np.cumsum(code == 0) - 1
    if joined.count("\0") != len(texts):  # texts that hold the separator themselves
        lengths = np.array([len((t or "").lower()) + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    kept, owner = np.where(letter, code, 0)[keep], owner[keep]
    kept = np.append(kept, np.uint32(0))
    middle = np.flatnonzero(kept[1:-1]) + 1
    for i in range(0, len(middle), STEP):
        m = middle[i : i + STEP]
        a, b, c = kept[m - 1], kept[m], kept[m + 1]
        three = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
        three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        one = ((b ^ np.uint32(0x5BD1E995)) * np.uint32(0x297A2D39)) >> np.uint32(17)
        yield owner[m], three
        yield owner[m], one


def _margins(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-odds of every bit, and the number of n-grams, of each text."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for owner, bucket in _grams(texts):
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = owner[at]
        sums[who] += np.add.reduceat(table[bucket], at, axis=0, dtype=np.float64)
        counts[who] += np.diff(np.r_[at, len(owner)])
    return sums / np.maximum(counts, 1)[:, None], counts


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted logistic loss, its score, and whether the runner-up is about as near."""
    z = SHARPNESS * margins[:, None, :] * model.code[None, :, :]
    losses = (np.logaddexp(0, -z) * model.weights[None, :, :]).sum(axis=2)
    order = np.sort(losses, axis=1)
    share = np.exp(-SCORE_SHARPNESS * (losses - order[:, :1]))
    gap = order[:, 1] - order[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
    return losses.argmin(axis=1), share.max(axis=1) / share.sum(axis=1), gap < AMBIGUOUS_GAP


def _count(languages: tuple[str, ...]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            langs = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for owner, bucket in _grams(batch.column("text").to_pylist()):
                total += np.bincount(langs[owner] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch({"lang": pa.array(lang), "bucket": pa.array(bucket), "c": pa.array(total[lang, bucket])})

    return run


def _score_bits(languages: tuple[str, ...], table: np.ndarray, code: np.ndarray):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        hits = np.zeros(code.shape, np.int64)
        for batch in batches:
            margins, counts = _margins(batch.column("text").to_pylist(), table)
            for row, lang in zip(np.flatnonzero(counts), (place[x] for x, n in zip(batch.column("lang").to_pylist(), counts, strict=True) if n), strict=True):
                hits[lang] += margins[row] * code[lang] > 0
        lang, bit = np.nonzero(hits)
        yield pa.record_batch({"lang": pa.array(lang), "bit": pa.array(bit), "c": pa.array(hits[lang, bit])})

    return run


def held_out(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id, which training leaves out as well."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about `train_rows` labelled rows of each language that are not held out.

    Each bit is a naive Bayes classifier between the languages with +1 and those with -1, every language weighing the
    same. A bit's loss counts, for a language, by the share of that language's training rows it gets right. To the
    driver come languages x BUCKETS counts at most. Null labels, ids and texts are not used; without a labelled row
    the model has no language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 1), np.float32), np.ones((0, 1), np.int8), np.ones((0, 1)))
    spark = docs.sparkSession
    rates = spark.createDataFrame([(x, min(1.0, train_rows / n)) for x, n in sizes.items()], "lang string, rate double")
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.join(F.broadcast(rates), "lang").filter((chance < F.col("rate")) & F.col("text").isNotNull()).select("text", "lang")
    counts = np.zeros((len(languages), BUCKETS))
    found = sample.mapInArrow(_count(languages), "lang long, bucket long, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    counts[found["lang"], found["bucket"]] = found["c"]
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    table = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, other = code[:, bit] > 0, code[:, bit] < 0
        if one.any() and other.any():
            table[:, bit] = np.log(shares[one].mean(axis=0)) - np.log(shares[other].mean(axis=0))
    right = np.full(code.shape, 1.0)
    hits = sample.mapInArrow(_score_bits(languages, table, code), "lang long, bit long, c long").groupBy("lang", "bit").agg(F.sum("c").alias("c")).toPandas()
    right[hits["lang"], hits["bit"]] += hits["c"]
    return Model(languages, table, code, right / right.sum(axis=1, keepdims=True))


def predicted(model: Model, text: Column, spark) -> Column:
    """Struct (lang, score, ambiguous) of a whole text. Null, or no letter: `und`, score 0, not ambiguous."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def predict(column: pa.Array) -> pa.Array:
        let_go()
        m = shared.value
        names, scores, doubts = [NONE] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        for begin in range(0, len(column), 256) if m.languages else ():
            part = column.slice(begin, 256).to_pylist()
            margins, counts = _margins(part, m.table)
            best, score, doubt = decode(margins, m)
            for i in np.flatnonzero(counts):
                names[begin + i], scores[begin + i], doubts[begin + i] = m.languages[best[i]], score[i], doubt[i]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(doubts)], ["lang", "score", "ambiguous"])

    return predict(text.cast("string"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row; only the text decides."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predicted(model, F.col(text_col), docs.sparkSession).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a language that is not ambiguous, with their columns."""
    p = predicted(model, F.col(text_col), docs.sparkSession)
    return docs.filter((p["lang"] != NONE) & ~p["ambiguous"])
