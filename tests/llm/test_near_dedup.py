import random

import pytest
from pyspark.sql import functions as F

from cargohold.llm import near_dedup
from llm import brute

SCHEMA = "doc_id long, text string, n_shingles string, kept string"


def family(seed, size, words, rate):
    """Copies of one text, each with its own share of words replaced, so that some are linked and some only near."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(size):
        p = rng.random() * rate
        out.append(" ".join(f"x{seed}_{i}_{j}" if rng.random() < p else w for j, w in enumerate(base)))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "other", "column") for i, t in enumerate(texts)], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    texts = family(1, 90, 60, 0.2) + family(2, 30, 150, 0.1) + family(3, 20, 12, 0.15)
    texts += ["", "one", "one", "One", "one two", "two words here", "TWO words\there", "é à ü", "  \n "] + texts[:5]
    got = found(near_dedup.near_duplicates(frame(spark, texts), shingle_words=k))
    assert got == brute.near_duplicates(list(enumerate(texts)), k)


@pytest.mark.parametrize("rows", [10**6, 0], ids=["broadcast", "shuffle"])
def test_pairs_of_a_hub_are_dealt_over_parts(spark, monkeypatch, rows):
    """The hub is the end with more pairs, wherever it stands; repeated ids are tried with each of their texts."""
    monkeypatch.setattr(near_dedup, "PART_PAIRS", 8)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROLES", rows)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", rows)
    texts = family(5, 60, 80, 0.12)
    items = [*enumerate(texts), (30, "quite another text than that before"), (61, "quite another text than that before")]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    sigs = near_dedup.staged(docs.mapInArrow(near_dedup._sign(2), "doc_id long, n long, da long, db long, sig binary"), "sigs")
    pairs = [(min(30, i), max(30, i)) for i in range(62) if i != 30 and i != 60] + [(0, 1), (1, 2)]
    pairs = spark.createDataFrame(pairs, "a long, b long")
    dealt = near_dedup._dealt(pairs).collect()
    assert len(dealt) == pairs.count() and {r.hub for r in dealt} == {30, 0, 1} and len({r.part for r in dealt if r.hub == 30}) == 8
    got = {tuple(r) for r in near_dedup.confirmed(pairs, sigs.select("doc_id", "n", "sig"), docs, 2, 80).collect()}
    sets = [(i, brute.shingles(t, 2)) for i, t in items]
    alike = {(i, j) for i, a in sets for j, b in sets if i < j and 100 * len(a & b) >= 80 * len(a | b)}
    assert got == alike & {tuple(r) for r in pairs.collect()} and (30, 61) in got


def test_leftovers_are_compared_in_blocks(spark, monkeypatch):
    """Only the last pass is left to find the links beyond a bucket's first member."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    texts = family(7, 80, 70, 0.35)
    rows = frame(spark, texts).select("doc_id", "text")
    sigs = near_dedup.staged(rows.mapInArrow(near_dedup._sign(2), "doc_id long, n long, da long, db long, sig binary"), "sigs")
    rest = sigs.select(F.lit(0).cast("long").alias("top"), "doc_id", F.col("doc_id").alias("comp"), "n")
    links = near_dedup._remaining(rest, sigs.select("doc_id", "n", "sig"), rows, 2, 80)
    roots = {r.node: r.root for r in near_dedup.components(links).collect()}
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(roots.get(i, ("alone", i)), []).append(i)
    want = {}
    for i, _, c, _ in brute.near_duplicates(list(enumerate(texts)), 2):
        want.setdefault(c, []).append(i)
    assert sorted(groups.values()) == sorted(want.values())


def test_a_member_is_tested_once_for_all_the_buckets_it_shares_with_a_component(spark, monkeypatch):
    """Members that share tens of buckets with the largest component without a link to it cost a few tests, not some for each bucket."""
    texts, asked, confirmed = family(11, 250, 120, 0.1), [], near_dedup.confirmed

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    got = found(near_dedup.near_duplicates(frame(spark, texts), shingle_words=5))
    assert got == brute.near_duplicates(list(enumerate(texts)), 5)
    assert len(asked) == 3 and 0 < asked[2] <= 2 * near_dedup.RANDOM_MEMBERS * len(texts), asked


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + j) for i in range(9) for j in range(i)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(min, groups.values())) == [0, 100, 200]
    assert sorted(map(len, groups.values())) == [9, 41, 60]


def test_nulls_repeats_long_texts_and_no_rows(spark):
    long = " ".join(f"t{i % 977}" for i in range(300_000))
    rows = [(None, "a b c", "", ""), (1, None, "", ""), (2, long, "", ""), (2, long, "", ""), (3, long + " end", "", ""), (4, "x" * 5_000_000, "", "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle_words=2).collect()
    by_id = sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str)
    assert by_id == sorted([(None, None, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True)], key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_within_the_radius_share_a_bucket():
    rng = random.Random(5)
    import numpy as np

    sig = np.array([[rng.randrange(1 << 16) for _ in range(near_dedup.PLACES)]], np.uint16)
    for _ in range(300):
        other = sig.copy()
        for j in rng.sample(range(near_dedup.PLACES), near_dedup.RADIUS):
            other[0, j] ^= 1
        assert (near_dedup.bucket_keys(sig) == near_dedup.bucket_keys(other)).any()
