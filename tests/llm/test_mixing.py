import pytest

from cargohold.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_targets_share_the_excess_again():
    # Shares of 150 by 3:1:2 are 75, 25, 50; the first stops at 20, and 130 by 1:2 gives the second 43.3, the third 86.7.
    assert mixing.targets([10, 40, 50], [3, 1, 2], 150) == pytest.approx([20, 130 / 3, 260 / 3])
    assert mixing.targets([0, 10], [3, 1], 15) == [0.0, 15.0]
    assert mixing.targets([], [], 0) == []


def brute(rows, order):
    """Weighted fair queueing one entry after another; `order` gives each source's queue."""
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in sources}
    total = sum(own.values())
    goal = dict(zip(sources, mixing.targets([own[s] for s in sources], [mixing.WEIGHTS[i % 3] for i in range(len(sources))], 1.5 * total), strict=True))
    entries = []
    for s in sources:
        upto = 0
        for _ in range(2):
            for i in order[s]:
                upto += sizes[i]
                if sizes[i]:
                    entries.append((upto / goal[s], i))
    taken, left = dict.fromkeys(sizes, 0), int(1.5 * total)
    for _, i in sorted(entries):
        words = min(sizes[i], left)
        taken[i] += words
        left -= words
    return sizes, own, goal, taken


@pytest.mark.parametrize("bins,last", [(1024, 10_000), (4, 3)])
def test_matches_queues_worked_off_one_by_one(spark, bins, last, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "LAST_ENTRIES", last)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 23)), f"s{min(i % 7, 3)}") for i in range(150)]
    rows += [(900, None, "s1"), (901, "", "s2"), (902, "a b", None), (903, " \t\n", None)]
    got = mixing.mixed(docs(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    order = {}
    for r in sorted((r for r in got if r.finish is not None), key=lambda r: r.finish):
        order.setdefault(r.source, []).append(r.doc_id)
    sizes, own, goal, taken = brute(rows, {s: order.get(s, []) for s in {r[2] for r in rows}})
    assert len(got) == len(rows)
    for i, _, s in rows:
        r = by_id[i]
        assert (r.size, r.source_size, r.taken) == (sizes[i], own[s], taken[i])
        assert r.target == pytest.approx(goal[s])
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))


def test_order_and_copies(spark):
    rows = [(i, "w " * 10, "a" if i < 20 else "b") for i in range(100)]
    frame = docs(spark, rows)
    mix = mixing.mixed(frame)
    got = [r.doc_id for r in mixing.sequence(frame, mix).collect()]
    taken = {r.doc_id: r.taken for r in mix.collect()}
    assert sorted(got) == sorted(i for i in taken for _ in range(-(-taken[i] // 10)))
    assert {taken[i] for i in range(20)} == {20}
    assert mixing.sequence(frame, mix).columns == frame.columns


def test_reruns_repeats_one_source_and_no_rows(spark):
    frame = docs(spark, [(1, "a b c", "x")] * 3 + [(None, "d", "x")])
    first, second = (sorted(map(str, mixing.mixed(frame).collect())) for _ in range(2))
    assert first == second and len(first) == 4
    assert sum(r.taken for r in mixing.mixed(frame).collect()) == 15
    assert mixing.mixed(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mixed(docs(spark, [(1, None, "x")])).collect()] == [0]
