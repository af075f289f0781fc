import hashlib
from collections import defaultdict

import pytest

from cargohold.llm.exact_dedup import exact_duplicates, heavy_digests

SCHEMA = "doc_id long, text string, digest string, row string, kept string, hot string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        taken = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not taken, hashlib.sha256(text.encode()).hexdigest()))
            taken |= i == keep
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("support", [1e-3, 0.05, 0.5])
def test_one_row_of_each_text_stays(spark, support):
    rows = [(i, "copied everywhere") for i in range(0, 900, 3)]
    rows += [(1000 + i, f"text {i % 40}") for i in range(200)] + [(5000 + i, f"alone {i}") for i in range(100)]
    rows += [(7000, "Alone 1"), (7001, "alone 1 "), (7002, "x" * 300_000), (7003, "x" * 300_000)]
    assert got(exact_duplicates(docs(spark, rows).repartition(7), support=support)) == brute(rows)


def test_nulls_empty_texts_repeated_rows_and_no_rows(spark):
    rows = [(1, None), (2, ""), (None, ""), (None, None), (3, "a"), (3, "a"), (3, "b"), (None, "c"), (None, "c"), (4, "d")]
    assert got(exact_duplicates(docs(spark, rows))) == brute(rows)
    # All rows of a heavy text have one id: exactly one of them stays.
    assert got(exact_duplicates(docs(spark, [(9, "same")] * 50 + [(1, "other")]))) == brute([(9, "same")] * 50 + [(1, "other")])
    assert exact_duplicates(docs(spark, [])).collect() == []


def test_heavy_digests_are_exact_and_none_is_missed(spark):
    frequent = {"h0": 400, "h1": 150, "h2": 101}
    rows = [(d, k, k) for d, n in frequent.items() for k in range(n)] + [(f"r{k % 333}", k, 10_000 + k) for k in range(1349)]
    table = spark.createDataFrame(rows, "digest string, doc_id long, row long").repartition(9)
    found = {r.hot: (r.keep_id, r.keep_row, r.group_size) for r in heavy_digests(table, 0.05).collect()}
    assert found == {d: (n - 1, n - 1, n) for d, n in frequent.items()}


def test_heavy_rows_are_not_shuffled(spark):
    rows = docs(spark, [(i, "hot" if i % 3 else f"t{i}") for i in range(300)])
    plan = exact_duplicates(rows, support=0.1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    # Only the branch of the union that has the window shuffles.
    assert plan.count("hashpartitioning(digest") == 1 and plan.index("Window") > plan.index("Union")
