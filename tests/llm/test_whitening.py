import numpy as np
import pytest

from cargohold.llm import whitening
from cargohold.llm.whitening import and_counts, planes, weighted, whitened

SCHEMA = "vec_id long, embedding array<float>, n string, component string, dim string, q string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def vectors(n, dim, seed=0, scale=0.4):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * scale / dim
    return mixed.astype(np.float32).tolist()


def brute(rows, components=16):
    """Plain version over exact integers: one row after another, then the eigenvectors of the fractions."""
    usable = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    ints = [(i, tuple(int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in usable]
    fit = sorted({x for _, x in ints})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dim)]
    cov = [[sum((n * x[j] - sums[j]) * (n * x[k] - sums[k]) for x in fit) / n**3 for k in range(dim)] for j in range(dim)]
    values, axes = np.linalg.eigh(np.array(cov))
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in ints:
        d = [n * x[j] - sums[j] for j in range(dim)]
        z = np.array(d, float) / n @ axes
        for c in range(min(components, int((values > values[0] * dim * 2.3e-16).sum()))):
            out.setdefault((i, c + 1), []).append((n, sum(v * v for v in d), z[c] / np.sqrt(values[c]), values[c] / values.sum()))
    return out


def check(df, rows, components=16):
    want, found = brute(rows, components), {}
    signs = {}
    for r in df.collect():
        found.setdefault((r.vec_id, r.component), []).append(r)
        assert r.identity_error < 1e-9
        assert r.deviation_digits == str(r.deviation)
    assert found.keys() == want.keys()
    for key, mine in found.items():
        assert len(mine) == len(want[key])
        for r, w in zip(sorted(mine, key=lambda r: r.deviation), sorted(want[key]), strict=True):
            assert (r.n, r.deviation) == w[:2]
            assert r.explained == pytest.approx(w[3], rel=1e-9)
            sign = signs.setdefault(key[1], 1 if r.whitened * w[2] >= 0 else -1) if abs(w[2]) > 1e-6 else signs.get(key[1], 1)
            assert sign * r.whitened == pytest.approx(w[2], abs=1e-7)


def test_matches_plain_version(spark):
    rows = list(enumerate(vectors(300, 20)))
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(5, rows[6][1]), (None, rows[7][1])]
    check(whitened(table(spark, rows).repartition(5)), rows)


def test_rows_that_cannot_be_used_and_widths(spark):
    rows = list(enumerate(vectors(60, 6, seed=3)))
    rows += [(100, [300.0, -5000.0, 1.0, 2.0, 3.0, 4.0]), (101, [9e8, 1.0, 1.0, 1.0, 1.0, -1.0])]
    bad = [(200, None), (201, [float("nan")] * 6), (202, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (203, [float("inf")] * 6), (204, []), (205, [-float("inf"), *[0.0] * 5])]
    plain = rows + bad
    got = whitened(table(spark, plain))
    want = brute(plain)
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert {k[0] for k in found} == {i for i, _ in rows} == {k[0] for k in want}
    for key, w in want.items():
        r = found[key]
        assert (r.n, int(r.deviation_digits)) == w[0][:2]
        assert r.deviation is None or r.deviation == w[0][1]
        assert r.explained == pytest.approx(w[0][3], rel=1e-6, abs=1e-12)
    # Another length than the most frequent one, and an entry no long can hold.
    odd = [*plain, (300, [0.5] * 7), (301, [3e38, *[0.0] * 5])]
    assert sorted({r.vec_id for r in whitened(table(spark, odd)).collect()}) == sorted(i for i, _ in rows)


def test_few_distinct_vectors_have_few_components(spark):
    assert whitened(table(spark, [])).collect() == []
    assert whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    got = whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.25, 0.5]), (2, [0.25, 0.5])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 2), (2, 1, 2), (2, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in got)


def test_counts_of_planes_are_exact():
    rng = np.random.default_rng(1)
    y = np.column_stack([rng.integers(0, 1 << b, 1000) if b else np.zeros(1000, np.int64) for b in (3, 0, 9, 33, 1)])
    bits = np.array([int(c.max()).bit_length() for c in y.T])
    counts = np.zeros((bits.sum(), bits.sum()), np.int64)
    for at in range(0, 1000, 130):
        and_counts(planes(y[at : at + 130], bits), counts)
    exact = y.astype(object)
    assert (weighted(counts, bits) == exact.T @ exact).all()
    np.testing.assert_array_equal(np.bitwise_count(planes(y, bits)).sum(axis=1), counts.diagonal())


def test_blocks_and_steps_do_not_matter(spark, monkeypatch):
    rows = list(enumerate(vectors(200, 5, seed=9)))
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 17)
    monkeypatch.setattr(whitening, "STEP_WORDS", 3)
    check(whitened(table(spark, rows)), rows)
