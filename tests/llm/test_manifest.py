import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from cargohold.llm import manifest as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, rank string, part string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def sides(tree, k):
    for level in tree[:-1]:
        run = k // 16 * 16
        yield "".join(level[run:k]), "".join(level[k + 1 : run + 16])
        k //= 16


def brute(rows):
    null_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    ordered = sorted(rows, key=lambda r: (null_first(r[1]), null_first(r[0]), digest(r)))
    groups = [list(g) for _, g in itertools.groupby(ordered, key=lambda r: r[1])]
    trees = [levels([digest(r) for r in g]) for g in groups]
    if not trees:
        return []
    top = levels([t[-1][0] for t in trees])
    out = []
    for t, group in enumerate(groups):
        for k, row in enumerate(group):
            way = [*sides(trees[t], k), *sides(top, t)]
            changed = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                changed = (*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4]))
            folded = digest(changed)
            for left, right in way:
                folded = h(left, folded, right)
            proof = h(*[left + right for left, right in way])
            out.append((row[0], digest(row), trees[t][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def rows_of(sizes):
    return [(7 * i + s, None if s == 0 else f"src{s}", "en", i, f"Text {i} of Ä {s}") for s, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes,part", [((1,), 10), ((16,), 5), ((17, 1), 7), ((300, 40, 1, 0, 2), 50), ((4097,), 900), ([1] * 40, 6), ((256, 257), 10_000)])
def test_matches_plain_version(spark, sizes, part, monkeypatch):
    monkeypatch.setattr(m, "PART_LEAVES", part)
    rows = rows_of(sizes)
    assert got(m.manifest(docs(spark, rows).repartition(3))) == brute(rows)


def test_nulls_ties_repeats_long_texts_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "PART_LEAVES", 3)
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (1, "", "en", 0, None), (1, "", "en", 0, "A"), (1, "", "en", 0, "A")]
    rows += [(5, "é", None, 2, "ÄB"), (6, "z", "de", None, "X" * 200_000), (-3, "z", "de", 4, "minus"), *[(9, "r", "en", 1, "Same")] * 40]
    assert got(m.manifest(docs(spark, rows))) == brute(rows)
    assert m.manifest(docs(spark, [])).collect() == []


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = rows_of((120, 30))
    monkeypatch.setattr(m, "PART_LEAVES", 11)
    monkeypatch.setattr(m, "BROADCAST_NODES", 0)
    assert got(m.manifest(docs(spark, rows))) == brute(rows)


def test_multiproof_is_the_least_set(spark):
    """What is missing for a range: of each run over it, the nodes that lie beside it; nothing within, nothing twice."""
    cases = [(0, 0, 0, 1), (0, 0, 16, 17), (5, 40, 70, 300), (0, 300, 3000, 5000), (9, 255, 256, 4096)]
    frame = spark.createDataFrame(cases, "part long, lo long, hi long, n long").withColumn("tree", F.lit(4).cast("long"))
    for _, lo, hi, n in cases:
        want, level, size, known = [], 0, n, set(range(lo, hi + 1))
        while size > 1:
            needed = {x for k in known for x in range(k // 16 * 16, min(k // 16 * 16 + 16, size))} - known
            want += [(level, x) for x in needed]
            known, level, size = {k // 16 for k in known}, level + 1, -(-size // 16)
        mine = [(r.level, r.idx) for r in m.missing(frame.filter((F.col("lo") == lo) & (F.col("n") == n) & (F.col("n") > 1))).collect()]
        assert sorted(mine) == sorted(want)
