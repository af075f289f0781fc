import random
import re

from cargohold.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id int, similarity string"


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(w, k):
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    """Every window of every text against every item."""
    out = set()
    for i, t in docs:
        w = words(t)
        for item, s in items:
            x = words(s)
            if not x or not w:
                continue
            k, n = min(5, len(x)), min(len(x), len(w))
            b = shingles(x, k)
            for a in range(len(w) - n + 1):
                win = w[a : a + n]
                mine = shingles(win, min(k, len(win)))
                if sum(map(len, mine & b)) >= 0.8 * sum(map(len, mine | b)):
                    out.add((i, item))
                    break
    return out


def test_matches_all_windows(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, " ".join(say(n))) for j, n in enumerate([40, 15, 59, 30, 5, 3, 1])] + [(7, ""), (8, None)]
    docs = []
    for i in range(120):
        w = say(80)
        kind, item = i % 6, words(items[i % 5][1])
        if kind == 1:
            w[20:20] = item
        elif kind == 2:
            w[:0] = item
        elif kind == 3:
            w += [x.upper() + "," for x in item]
        elif kind == 4 and len(item) > 30:
            item[len(item) // 2] = "changed"
            w[10:10] = item
        elif kind == 5:
            w[30:30] = item[: len(item) // 2]
        docs.append((i, " ".join(w)))
    docs += [(200, ""), (201, None), (202, items[0][1]), (203, " ".join(words(items[0][1])[:-1])), (204, items[3][1] + " " + items[1][1]), (205, "word1")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == brute(docs, items)
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_repeats_null_ids_and_no_rows(spark):
    text = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    frame = spark.createDataFrame([(1, f"a {text} b", 0, ""), (1, f"a {text} b", 0, ""), (None, text, 0, ""), (2, "clean", 0, "")], SCHEMA)
    got = decontaminate.contaminated(frame, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.start_word, r.similarity) for r in got), key=str) == [(1, 1, 1, 1.0), (None, 1, 0, 1.0)]
    assert [r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()] == [2]
    assert decontaminate.contaminated(frame.limit(0), bench).collect() == []
    assert decontaminate.contaminated(frame, bench.limit(0)).collect() == []
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == 4


def test_radius_is_guaranteed_by_the_blocks():
    rng = random.Random(1)
    for _ in range(2000):
        flips = rng.sample(range(64), decontaminate.RADIUS)
        per = [sum(f // decontaminate.BLOCK_BITS == j for f in flips) for j in range(decontaminate.BLOCKS)]
        assert min(per) <= decontaminate.FLIPS


def placed(docs, items):
    """The windows where a shared shingle puts an item, as the SQL has them."""
    out = set()
    for i, t in docs:
        w = words(t)
        at = {}
        for p in range(len(w) - 4):
            at.setdefault(" ".join(w[p : p + 5]), []).append(p)
        for item, s in items:
            x = words(s)
            starts = {max(0, min(p - q, len(w) - len(x))) for q in range(len(x) - 4) for p in at.get(" ".join(x[q : q + 5]), ())}
            b = shingles(x, 5)
            for a in starts:
                mine = shingles(w[a : a + len(x)], 5)
                if sum(map(len, mine & b)) >= 0.8 * sum(map(len, mine | b)):
                    out.add((i, item))
    return out


def test_near_copies_with_edits_at_the_edges_and_words_of_mixed_length(spark):
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.choice((1, 2, 3, 5, 9, 14)))) for _ in range(n)]
    items = [(j, " ".join(say(rng.randrange(16, 60)))) for j in range(60)]
    docs = []
    for j, text in items:
        for kind in range(4):
            w = words(text)
            if kind in (0, 2):
                w[0] = "unprecedentedly"
            if kind in (1, 2):
                w[-1] = "incomprehensible"
            if kind == 3:
                w = w[1:]
            docs.append((4 * j + kind, " ".join(say(12) + w + say(12))))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = placed(docs, items)
    assert len(want) > 180 and got == want
