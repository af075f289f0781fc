import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cargohold.operators import sequence as Q
from cargohold.operators.digests import digest_chunks
from cargohold.operators.skew import SkewPolicy, slice_hot_keys

FORCED = SkewPolicy(max_rows=3)
POLICIES = [SkewPolicy(), FORCED]
IDS = ["whole", "sliced"]


RUNS = [
    ([], []),
    ([1], [1]),
    ([1, 2], [1, 2]),
    ([1, 1], [1]),
    ([1, 2, 3], [1, 2, 3]),
    ([1, 2, 1], [1, 2, 1]),
    ([1, 2, 2], [1, 2]),
    ([1, 1, 2], [1, 2]),
    ([1, 1, 1], [1]),
    ([None, None, 1, None], [None, 1, None]),
    ([1] * 6 + [2] * 7 + [1] * 5, [1, 2, 1]),
]


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
def test_unique_consecutive(spark, policy):
    rows = [(case, i, v) for case, (given, _) in enumerate(RUNS) for i, v in enumerate(given)]
    out = Q.unique_consecutive(spark.createDataFrame(rows, "k int, pos int, v int"), ["v"], ["pos"], ["k"], policy)
    got = out.orderBy("k", "pos").collect()
    for case, (_, expected) in enumerate(RUNS):
        assert [r.v for r in got if r.k == case] == expected


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
@pytest.mark.parametrize("case", [0, 9, 10])
def test_unique_consecutive_without_keys(spark, case, policy):
    given, expected = RUNS[case]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "pos int, v int")
    assert [r.v for r in Q.unique_consecutive(df, ["v"], ["pos"], None, policy).orderBy("pos").collect()] == expected


def skewed(spark, n=600, seed=1):
    """One key holds most rows, others a few; one key is NULL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 1 if rng.random() < 0.6 else rng.choice([2, 3, None, 5])
        rows.append((k, i // 3, i, rng.choice(["a", "b", None]), "é" * rng.randrange(0, 9)))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, t int, i int, v string, b string").withColumn(
        "b", F.col("b").cast("binary")
    )


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_slices_follow_the_order_and_are_bounded(spark):
    rows, df = skewed(spark)
    s = slice_hot_keys(df, ["k"], ["t", "i"], SkewPolicy(max_rows=50))
    assert s.sliced
    hot = s.df.filter("_hot").select("k", "t", "i", "_slice").collect()
    # Every key over the limit.
    sizes = sorted(((len(g), k) for k, g in by_key(rows).items() if len(g) > 50), key=lambda p: -p[0])
    assert {r.k for r in hot} == {k for _, k in sizes}
    for key in {r.k for r in hot}:
        seq = [r._slice for r in sorted((r for r in hot if r.k == key), key=lambda r: (r.t, r.i))]
        assert seq == sorted(seq) and len(set(seq)) > 1


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
def test_unique_consecutive_brute_force(spark, policy):
    rows, df = skewed(spark)
    want = set()
    for group in by_key(rows).values():
        for prev, cur in zip([None] + group, group):
            if prev is None or prev[3] != cur[3]:
                want.add(cur[2])
    out = Q.unique_consecutive(df, ["v"], ["t", "i"], ["k"], policy)
    assert {r.i for r in out.collect()} == want
    assert out.columns == df.columns


def windows(seq, n, step):
    out, buffer = [], []
    for x in seq:
        buffer = buffer + [x]
        if len(buffer) < n:
            continue
        if len(buffer) == n:
            out.append(list(buffer))
        elif step <= n:
            buffer = buffer[step:]
            if len(buffer) == n:
                out.append(list(buffer))
            continue
        if step > n and len(buffer) == step:
            buffer = buffer[step:]
    if 0 < len(buffer) < n:
        out.append(list(buffer))
    return out


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
@pytest.mark.parametrize("n,step", [(2, 1), (3, 2), (2, 2), (2, 5)])
def test_sliding_brute_force(spark, policy, n, step):
    rows, df = skewed(spark, 240)
    out = Q.sliding(df, "v", ["t", "i"], ["k"], n, step, policy).collect()
    for key, group in by_key(rows).items():
        got = [r.window for r in sorted((r for r in out if r.k == key), key=lambda r: r.window_start)]
        assert got == windows([g[3] for g in group], n, step)


def chunks_in(key, sizes):
    data = bytes(i % 251 for i in range(sum(sizes)))
    rows, at = [], 0
    for i, size in enumerate(sizes):
        rows.append((key, i, bytearray(data[at : at + size])))
        at += size
    return data, rows


CHUNKS = {
    1: [[2, 2]],
    2: [[2, 2], [1, 1, 1], [5]],
    3: [[2, 2], [1] * 10],
    4: [[2, 2], [0, 3, 0, 3, 0], [], [0]],
    101: [[101 * 101 - 1]],
}


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
@pytest.mark.parametrize("n", CHUNKS)
def test_rechunk(spark, n, policy):
    cases = [chunks_in(i, sizes) for i, sizes in enumerate(CHUNKS[n])]
    df = spark.createDataFrame([r for _, rows in cases for r in rows], "k int, pos int, b binary")
    out = Q.rechunk(df, ["k"], ["pos"], "b", n, policy).orderBy("k", "chunk_id").collect()
    for key, (data, _) in enumerate(cases):
        assert [bytes(r.b) for r in out if r.k == key] == [data[i : i + n] for i in range(0, len(data), n)]


def test_rechunk_through_many_sizes(spark):
    df = spark.createDataFrame(chunks_in(0, [101 * 101 - 1])[1], "k int, pos int, b binary")
    for n in (1000, 7, 101):
        df = Q.rechunk(df, ["k"], ["pos"], "b", n).withColumnRenamed("chunk_id", "pos")
    sizes = [len(r.b) for r in df.orderBy("pos").collect()]
    assert sizes == [101] * 100 + [100]


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
def test_rechunk_brute_force(spark, policy):
    rows, df = skewed(spark)
    out = Q.rechunk(df, ["k"], ["t", "i"], "b", 7, policy).collect()
    for key, group in by_key(rows).items():
        data = "".join(g[4] for g in group).encode()
        got = [bytes(r.b) for r in sorted((r for r in out if r.k == key), key=lambda r: r.chunk_id)]
        assert got == [data[i : i + 7] for i in range(0, len(data), 7)]


def test_chunk_binary(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefg")), (2, bytearray()), (3, bytearray(b"xyz"))], "k int, b binary")
    out = Q.chunk_binary(df, "b", 3).orderBy("k", "chunk_id").collect()
    assert [(r.k, r.chunk_id, bytes(r.b)) for r in out] == [(1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g"), (3, 0, b"xyz")]


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
def test_split_when_brute_force(spark, policy):
    rows, df = skewed(spark)
    out = Q.split_when(df, F.col("v") == "a", ["t", "i"], ["k"], policy).collect()
    got = {r.i: (r.group_id, r.is_first) for r in out}
    for group in by_key(rows).values():
        gid = -1
        for j, row in enumerate(group):
            first = j == 0 or row[3] == "a"
            gid += first
            assert got[row[2]] == (gid, first)


@pytest.mark.parametrize("policy", POLICIES, ids=IDS)
@pytest.mark.parametrize("cap", [1, 150, 10**6])
def test_capped_concat_brute_force(spark, policy, cap):
    rows, df = skewed(spark)
    out = {r.k: (bytes(r.b), r.n_bytes) for r in Q.capped_concat(df, ["k"], ["t", "i"], "b", cap, policy).collect()}
    for key, group in by_key(rows).items():
        data = group[0][4].encode()
        for row in group[1:]:
            if len(data) + len(row[4].encode()) > cap:
                break
            data += row[4].encode()
        assert out[key] == (data, len(data))


def test_head_per_group(spark):
    rows, df = skewed(spark)
    out = Q.head_per_group(df, ["t", "i"], ["k"], 2).collect()
    want = {r[2] for g in by_key(rows).values() for r in g[:2]}
    assert {r.i for r in out} == want


def test_head_limits_groups_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = Q.head_per_group(df, ["t", "i"], ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_switch_source(spark):
    a = spark.createDataFrame([(0, 0, "A")], "k int, pos int, s string")
    b = spark.createDataFrame([(0, 1, "B")], "k int, pos int, s string")
    assert [r.pos for r in Q.switch_source(a, b, "pos", None).collect()] == [0]
    a2, b2 = a, b.filter("pos > 5")
    assert [r.pos for r in Q.switch_source(a2, b2, "pos", 1).collect()] == [0]
    at = spark.createDataFrame([(0, 0)], "k int, at int")
    assert [r.s for r in Q.switch_source(a, b, "pos", at, ["k"]).collect()] == ["B"]


def test_ordered_concat(spark):
    a, b = spark.range(2), spark.range(3)
    assert [(r.source_ord, r.id) for r in Q.ordered_concat(a, b).orderBy("source_ord", "id").collect()] == [
        (0, 0), (0, 1), (1, 0), (1, 1), (1, 2),
    ]


TIED = [("a", 1, "xx"), ("a", 1, "yy"), ("a", 2, "z"), ("b", 1, "q"), ("b", 1, "q"), ("b", 1, "q"), ("b", 2, None), ("c", 1, None)]


def tied(spark):
    return spark.createDataFrame(TIED, "k string, t int, s string").withColumn("b", F.col("s").cast("binary"))


def test_capped_concat_with_ties(spark):
    for cap, want in ((100, {"a": 5, "b": 3, "c": None}), (2, {"a": 2, "b": 2, "c": None}), (1, {"a": 2, "b": 1, "c": None})):
        out = {r.k: (r.b, r.n_bytes) for r in Q.capped_concat(tied(spark), ["k"], ["t"], "b", cap).collect()}
        assert {k: n for k, (_, n) in out.items()} == want
        assert all(len(b) == n for b, n in out.values() if n is not None)
    whole = Q.capped_concat(tied(spark), ["k"], ["t"], "b", 100).filter("k = 'a'").first().b
    assert bytes(whole) in (b"xxyyz", b"yyxxz")


@pytest.mark.parametrize("limit", [1, 2, 1000])
def test_equal_positions_neither_lose_nor_double_rows(spark, limit):
    policy, rows = SkewPolicy(max_rows=limit), [("k", i // 7, (i * 5 // 3) % 2, f"{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, v int, s string").withColumn("b", F.col("s").cast("binary"))
    # Between equal positions the compared value decides: each position gives its distinct values, the first only if it is another than the one before.
    want, last = [], None
    for _, group in itertools.groupby(sorted((t, v) for _, t, v, _ in rows), key=lambda r: r[0]):
        for _, v in group:
            want += [v] if v != last else []
            last = v
    assert [r.v for r in Q.unique_consecutive(df, ["v"], ["t"], ["k"], policy).orderBy("t", "v").collect()] == want
    windows = Q.sliding(df, "s", ["t"], ["k"], 3, 3, policy).collect()
    assert sorted(s for r in windows for s in r.window) == sorted(r[3] for r in rows)
    split = Q.split_when(df, F.col("v") == 1, ["t"], ["k"], policy).collect()
    assert len(split) == 60 and sum(r.is_first for r in split) == sum(r[2] for r in rows) + 1
    assert max(r.group_id for r in split) == sum(r[2] for r in rows)
    pieces = Q.rechunk(df, ["k"], ["t"], "b", 8, policy).orderBy("chunk_id").collect()
    assert sorted(b"".join(bytes(r.b) for r in pieces)) == sorted("".join(r[3] for r in rows).encode())
    assert digest_chunks(df, ["k"], ["t"], "b", policy=policy).first().n_bytes == 60
    assert Q.capped_concat(df, ["k"], ["t"], "b", 37, policy).first().n_bytes == 37


def test_a_row_meets_few_cut_points_whatever_the_number_of_slices(spark, monkeypatch):
    rows = [("a", i * 7919 % 20_000) for i in range(20_000)] + [("b", i) for i in range(40)] + [(None, i) for i in range(300)] + [("c", 1)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(8)
    joined, mark = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda d: joined.append(d) or mark(d))
    s = slice_hot_keys(df, ["k"], ["t"], SkewPolicy(max_rows=3))
    nodes = [d for d in joined if "_cuts" in d.columns]
    assert len(nodes) > 1
    assert all(d.agg(F.max(F.size("_cuts"))).first()[0] <= 64 for d in nodes)
    got = s.df.collect()
    assert sorted((r.k or "", r.t) for r in got) == sorted((k or "", t) for k, t in rows)
    for key, least, hot in (("a", 4000, True), ("b", 8, True), (None, 60, True), ("c", 1, False)):
        seq = sorted((r.t, r._slice) for r in got if r.k == key)
        assert [n for _, n in seq] == sorted(n for _, n in seq) and len({n for _, n in seq}) >= least
        assert {r._hot for r in got if r.k == key} == {hot}
        assert max(len(list(g)) for _, g in itertools.groupby(n for _, n in seq)) <= 30


def test_digest_of_cut_keys_writes_no_files(spark, monkeypatch):
    chunks = [(k, i, bytes([i % 251]) * (i % 5)) for k in range(30) for i in range(40)] + [(99, i, bytes(500_000)) for i in range(5)]
    df = spark.createDataFrame(chunks, "k int, pos int, b binary").repartition(8)
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *_, **__: pytest.fail("a file for each slice"))
    got = {r.k: (r.digest, r.n_bytes) for r in digest_chunks(df, ["k"], ["pos"], "b", policy=SkewPolicy(max_rows=2)).collect()}
    whole = {k: b"".join(c[2] for c in g) for k, g in itertools.groupby(chunks, key=lambda c: c[0])}
    assert got == {k: (hashlib.md5(b).hexdigest(), len(b)) for k, b in whole.items()}


def test_chunk_binary_keeps_other_columns_and_all_bytes(spark):
    values = [b"", None, b"x", bytes(range(256)) * 40, b"abcd" * 3, "ü€".encode() * 5000, b"1234"]
    df = spark.createDataFrame([(i, [i, None], v, None) for i, v in enumerate(values)], "i int, a array<int>, b binary, s string").coalesce(1)
    rows = Q.chunk_binary(df, "b", 4).collect()
    assert Q.chunk_binary(df, "b", 4).columns == ["i", "a", "s", "chunk_id", "b"]
    want = [(i, [i, None], None, at // 4, v[at : at + 4]) for i, v in enumerate(values) if v for at in range(0, len(v), 4)]
    assert sorted((r.i, r.a, r.s, r.chunk_id, bytes(r.b)) for r in rows) == want
    plan = Q.chunk_binary(df, "b", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # cut in the batch, not by a lambda for each piece
    text = Q.chunk_binary(df.select(F.lit("hello").alias("t")), "t", 2).select("t").distinct().collect()
    assert sorted(r.t for r in text) == ["he", "ll", "o"]
