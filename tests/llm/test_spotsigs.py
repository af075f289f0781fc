import hashlib
import itertools
import random
import re

from cargohold.llm import spotsigs

SCHEMA = "doc_id long, text string, fingerprint int"
ANCHORS = set(spotsigs.ANCHORS)


def digest(s):
    return hashlib.md5(s.encode()).hexdigest()[:12]


def spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in ANCHORS][:2]
        if w in ANCHORS and len(chain) == 2:
            out.add(digest(f"{w} {chain[0]} {chain[1]}"))
    return sorted(out) if out else [digest(" ".join(words))]


def like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for n, (i, t) in enumerate(rows):
        follow = rows[(n + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + follow[:third]
        a, b, c = spots(t), spots(edited), spots(follow)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), " ".join(a), " ".join(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "and", "der", "la", "río", "Haus", "tree", "stone", "été", "cloud", "x1", "river", "night"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) + rng.choice(["", ".", "\n", " \U0001f600"]) for _ in range(n)]


def test_matches_brute_force(spark):
    rows = list(zip([i * i * 31 + 5 for i in range(300)], texts(300), strict=True))
    rows += [(10**15, "The last of all"), (-7, ""), (3, None), (6, "the"), (6_000_000, "no anchor here though")]
    got = spotsigs.fingerprints(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_ranges_of_ids_between_quantiles(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "QUANTILES", 3)
    monkeypatch.setattr(spotsigs, "PARTS", 4)
    rows = [(i, f"text {i}") for i in range(3000)]
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: f"text {(i - 1) % 3000}" for i in range(3000)}


def test_single_rows_repeats_null_ids_and_no_rows(spark):
    for rows in ([(1, "the one two")], [(1, "a b c"), (1, "a b c"), (1, "z"), (None, "q"), (None, None)], []):
        got = spotsigs.fingerprints(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_near_pairs_loses_none(spark):
    base = texts(25, 4)
    rng = random.Random(9)
    many = [" ".join(w for w in t.split() if rng.random() > 0.04) for t in base for _ in range(6)]
    sets = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "doc_id long, text string")
    sets = spotsigs.with_spots(sets, spots="text").select("doc_id", "spots")
    rows = {r.doc_id: tuple(r.spots) for r in sets.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    for least in (0.5, 0.8):
        want = {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if like(x, y) >= least}
        assert {(r.a, r.b) for r in spotsigs.near_pairs(sets, least).collect()} == want
