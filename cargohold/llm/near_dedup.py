"""Near-duplicates by MinHash: multi-index Hamming join of b-bit signatures, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargohold.llm.common import broadcast_if, let_go, mix, shingle_sets, slices, staged

#: A signature has CHUNKS chunks of CHUNK 16-bit MinHash values. Two signatures that differ in at most RADIUS places
#: differ in at most one place of some chunk (pigeonhole), so they agree on that chunk with one place left out.
CHUNKS, CHUNK = 16, 5
PLACES = CHUNKS * CHUNK
RADIUS = 2 * CHUNKS - 1
#: Members of a bucket that one task compares at a time.
BLOCK_ROWS = 1024
#: Ids of documents to confirm that may be broadcast, and pairs with the places of their ends; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_ROLES = 1_000_000, 300_000
#: Partners of one document that one task compares with it (about).
PART_PAIRS = 256
#: Members of a bucket's largest component, chosen at random, and of those of all its buckets with that component the ones
#: that a document outside is tested against before the full comparison.
RANDOM_MEMBERS = 3

_A = (mix(np.arange(1, PLACES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, PLACES + 1001, dtype=np.uint64)).astype(np.uint32)
_SLOTS = mix(np.arange(2001, PLACES + 2001, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """PLACES MinHash values of 16 bits; long sets are taken in parts."""
    low = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(base), 8192):
        np.minimum(low, (base[i : i + 8192, None] * _A + _B).min(axis=0), out=low)
    return (mix(low.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """One key per signature, chunk and place left out: rows x PLACES."""
    parts = sigs.reshape(len(sigs), CHUNKS, CHUNK).astype(np.uint64)
    keys = np.empty((len(sigs), CHUNKS, CHUNK), np.uint64)
    for out in range(CHUNK):
        packed = np.zeros((len(sigs), CHUNKS), np.uint64)
        for j in (x for x in range(CHUNK) if x != out):
            packed = (packed << np.uint64(16)) | parts[:, :, j]
        keys[:, :, out] = packed
    with np.errstate(over="ignore"):
        return mix(mix(keys.reshape(len(sigs), PLACES)) + _SLOTS)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for whole in batches:
            for batch in slices(whole, "text"):
                ns, a, b, sigs = [], [], [], []
                for s in shingle_sets(batch.column("text"), k):
                    ns.append(len(s))
                    with np.errstate(over="ignore"):
                        a.append(int(np.sum(mix(s), dtype=np.uint64)))
                        b.append(int(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n": pa.array(ns, pa.int64()),
                        "da": pa.array(np.array(a, np.uint64).view(np.int64)),
                        "db": pa.array(np.array(b, np.uint64).view(np.int64)),
                        "sig": pa.array(sigs, pa.binary()),
                    }
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PLACES)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            keys = bucket_keys(_matrix(batch.column("sig"))).view(np.int64)
            yield pa.record_batch(
                {
                    "key": pa.array(keys.ravel()),
                    "doc_id": pa.array(np.repeat(batch.column("doc_id").to_numpy(), PLACES)),
                    "n": pa.array(np.repeat(batch.column("n").to_numpy(), PLACES)),
                }
            )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id: each member of a bucket beside its first one, which alone is remembered."""
    let_go()
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, n = (batch.column(c).to_numpy() for c in ("key", "doc_id", "n"))
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        known = last is not None and last[0] == key[0]
        if known:
            head[0] = False
        group = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
        leader = np.where(group >= 0, doc[group], last[1] if known else 0)
        size = np.where(group >= 0, n[group], last[2] if known else 0)
        last = (key[-1], leader[-1], size[-1])
        rest = ~head
        yield pa.record_batch(
            {"key": pa.array(key[rest]), "leader": pa.array(leader[rest]), "leader_n": pa.array(size[rest]), "doc_id": pa.array(doc[rest]), "n": pa.array(n[rest])}
        )


def _close(sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    return (sig_a != sig_b).sum(axis=-1) <= RADIUS


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(start, end, (hub, part)) of each run of rows with the same hub and part."""
    hub, part = batch.column("hub").to_numpy(), batch.column("part").to_numpy()
    cuts = np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hub)], strict=True):
        yield a, b, (int(hub[a]), int(part[a]))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, part and role: the partners whose signature is within RADIUS of one of their hub's."""
    let_go()
    at, hubs = None, np.zeros((0, PLACES), np.uint16)
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs, partner = _matrix(batch.column("sig")), batch.column("role").to_numpy() == 1
        keep = np.zeros(batch.num_rows, bool)
        for a, b, place in _runs(batch):
            first = a + int((~partner[a:b]).sum())
            mine = sigs[a:first]
            hubs = np.concatenate([hubs, mine]) if place == at else mine
            at = place
            for hub in hubs:
                keep[first:b] |= _close(sigs[first:b], hub)
        yield pa.record_batch({c: batch.column(c).filter(pa.array(keep)) for c in ("hub", "doc_id", "part")})


def _confirm(k: int, percent: int):
    """Rows sorted by hub, part and role: the partners whose full set reaches the similarity with one of their hub's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        at, hubs = None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                hub, part, role = (batch.column(c).to_pylist() for c in ("hub", "part", "role"))
                keep = np.zeros(batch.num_rows, bool)
                for i, mine in enumerate(shingle_sets(batch.column("text"), k)):
                    if (hub[i], part[i]) != at:
                        at, hubs = (hub[i], part[i]), []
                    if role[i] == 0:
                        hubs.append(mine)
                        continue
                    for other in hubs:
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if both > 0 and 100 * both >= percent * (len(mine) + len(other) - both):
                            keep[i] = True
                            break
                found = {c: batch.column(c).filter(pa.array(keep)) for c in ("hub", "doc_id")}
                yield pa.record_batch({"a": found["hub"], "b": found["doc_id"]})

    return run


def _dealt(pairs: DataFrame) -> DataFrame:
    """(hub, doc_id, part) for each pair (a, b): the end with more pairs is the hub, and its partners are dealt by hash
    over parts of about PART_PAIRS, so that no end is one task."""
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b"))
    heavy = ends.groupBy("end").agg(F.count("*").alias("pairs")).filter(F.col("pairs") > PART_PAIRS)
    heavy = broadcast_if(staged(heavy, "hubs"), BROADCAST_IDS)
    of = lambda c: heavy.select(F.col("end").alias(c), F.col("pairs").alias(f"n{c}"))
    both = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    turn = F.coalesce("nb", F.lit(0)) > F.coalesce("na", F.lit(0))
    parts = F.ceil(F.coalesce(F.greatest("na", "nb"), F.lit(1)) / PART_PAIRS)
    hub, partner = F.when(turn, F.col("b")).otherwise(F.col("a")), F.when(turn, F.col("a")).otherwise(F.col("b"))
    return both.select(hub.alias("hub"), partner.alias("doc_id"), F.pmod(F.xxhash64(partner), parts).cast("int").alias("part"))


def _beside(dealt: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """`column` of each partner behind that of its hub, which moves once for each part and not for each pair."""
    roles = dealt.select("hub", "doc_id", "part", F.lit(1).alias("role"))
    roles = staged(roles.union(dealt.select("hub", F.col("hub").alias("doc_id"), "part", F.lit(0).alias("role")).distinct()), "roles")
    found = rows.select("doc_id", column).join(broadcast_if(roles, BROADCAST_ROLES), "doc_id")
    return found.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").select("hub", "doc_id", "part", "role", column)


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) within RADIUS whose full shingle sets reach the similarity."""
    near = staged(_beside(_dealt(pairs), reps, "sig").mapInArrow(_within, "hub long, doc_id long, part int"), "near").distinct()
    links = staged(_beside(near, docs, "text").mapInArrow(_confirm(k, percent), "a long, b long"), "links")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b).

    In each round every node moves to the least node within two steps, in an order that is random for the round, and
    from there once more; edges between different places are the next round's. Stars and dense groups end at once,
    long chains shrink by a factor.
    """
    e, maps, nth = staged(edges.select("a", "b"), "edges"), [], 0
    while not e.isEmpty():
        rank = lambda c, n=nth: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("v"))
        both = e.union(e.select("b", "a")).select("a", "b")
        one = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("x"), F.least("m", rank("a")).alias("m"))
        two = both.join(one, F.col("b") == F.col("x")).select("a", "m").union(one.select("x", "m"))
        move = two.groupBy("a").agg(F.min("m").alias("m")).select("a", F.col("m.v").alias("p"))
        if nth:
            move = staged(move, "moves")
            onward = move.select(F.col("a").alias("p"), F.col("p").alias("q"))
            move = move.join(onward, "p").select("a", F.col("q").alias("p"))
        move = staged(move, "moves")
        maps.append(move)
        e = e.join(move.withColumnRenamed("p", "pa"), "a").join(move.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        e = staged(e.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        nth += 1
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for move in maps[1:]:
        onward = move.select(F.col("a").alias("root"), F.col("p").alias("next"))
        found = found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return staged(found, "roots") if len(maps) > 1 else found


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return staged(found.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "apart")


def _members(star: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, doc_id, n, comp) of all buckets with three members or more and two components or more."""
    large = star.groupBy("key").agg(F.count("*").alias("c"), F.first("leader").alias("leader"), F.first("leader_n").alias("n")).filter("c > 1")
    rows = star.join(large.select("key"), "key").select("key", "doc_id", "n").union(large.select("key", F.col("leader").alias("doc_id"), "n"))
    rows = rows.join(roots.select(F.col("node").alias("doc_id"), F.col("root")), "doc_id", "left")
    rows = staged(rows.select("key", "doc_id", "n", F.coalesce("root", "doc_id").alias("comp")), "members")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(mixed, "key", "left_semi")


def _majority(members: DataFrame) -> DataFrame:
    """(key, top, reps, rows) of each bucket: its largest component, some random members of it, and its size."""
    picks = [F.min(F.struct(F.xxhash64("doc_id", "key", F.lit(j)).alias("h"), "doc_id", "n")).alias(f"m{j}") for j in range(RANDOM_MEMBERS)]
    by_comp = members.groupBy("key", "comp").agg(F.count("*").alias("c"), *picks)
    top = F.max(F.struct("c", "comp", F.array(*[f"m{j}" for j in range(RANDOM_MEMBERS)]).alias("reps"))).alias("m")
    return by_comp.groupBy("key").agg(top).select("key", F.col("m.comp").alias("top"), F.col("m.reps").alias("reps"))


def _fits(percent: int):
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and a <> b")


def _tests(rest: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of each member outside of a largest component, once for all the buckets where it meets that one, with
    the RANDOM_MEMBERS members that most of them chose. Pairs in `tried` don't count."""
    reps = F.array_distinct(F.transform("reps", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["n"].alias("n"))))
    met = rest.filter("comp <> top").select("top", "doc_id", "n", F.explode(reps).alias("r"))
    met = met.groupBy("top", "doc_id", "n", "r").agg(F.count("*").alias("buckets"))
    met = met.select("top", F.col("doc_id").alias("a"), F.col("r.doc_id").alias("b"), F.col("n").alias("na"), F.col("r.n").alias("nb"), "buckets").filter(_fits(percent))
    known = tried.select(F.col("a").alias("x"), F.col("b").alias("y"))
    met = met.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
    place = Window.partitionBy("top", "a", "na").orderBy(F.desc("buckets"), F.xxhash64("b", "a"), "b", "nb")
    best = met.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= RANDOM_MEMBERS)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_PLACE = ["top", "hb", "pb"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by _PLACE, one table for each place."""
    held: list[pa.RecordBatch] = []
    group = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy() for c in _PLACE], axis=1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
            if group != tuple(place[a]):
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, group = [], tuple(place[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near_in_block(percent: int):
    """For each probe of a block its near home rows as one list, and a row for each home row that is in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in _groups(batches):
            doc, comp, n, probe = (t.column(c).to_numpy() for c in ("doc_id", "comp", "n", "probe"))
            sigs, top = _matrix(t.column("sig")), t.column("top")[0].as_py()
            home, lists, used = np.flatnonzero(probe == 0), [], np.zeros(len(doc), bool)
            probes = np.flatnonzero(probe == 1)
            for p in probes:
                once = (comp[home] == top) | (doc[home] > doc[p])
                fits = home[once & (comp[home] != comp[p]) & (100 * np.minimum(n[home], n[p]) >= percent * np.maximum(n[home], n[p]))]
                fits = fits[_close(sigs[fits], sigs[p])] if len(fits) else fits
                used[fits] = True
                lists.append(doc[fits].tolist())
            rows = [(d, x) for d, x in zip(doc[probes].tolist(), lists, strict=True) if x] + [(d, None) for d in doc[used].tolist()]
            if rows:
                place = {c: pa.array([t.column(c)[0].as_py()] * len(rows), t.schema.field(c).type) for c in _PLACE}
                yield pa.record_batch({**place, "doc_id": pa.array([r[0] for r in rows], pa.int64()), "near": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})

    return run


def _links_in_block(k: int, percent: int):
    """The pairs of a block's lists whose full sets reach the similarity; each document's text stands in a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in _groups(batches):
            listed, sets, found = pc.is_valid(t.column("near")), {}, []
            for batch in t.filter(pc.invert(listed)).select(["doc_id", "text"]).to_batches():
                for part in slices(batch, "text"):
                    sets |= zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), k), strict=True)
            probes = t.filter(listed)
            lists = list(zip(probes.column("doc_id").to_pylist(), probes.column("near").to_pylist(), strict=True))
            home = sorted({d for _, near in lists for d in near})
            sizes = np.array([len(sets[d]) for d in home], np.int64)
            all_of, begin = np.concatenate([sets[d] for d in home]), np.cumsum(sizes) - sizes
            known, number = np.unique(all_of, return_inverse=True)
            at = {d: j for j, d in enumerate(home)}
            for doc, near in lists:
                mine, mark = sets[doc], np.zeros(len(known), np.int64)
                place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                mark[place[known[place] == mine]] = 1
                both = np.add.reduceat(mark[number], begin)
                where = np.array([at[d] for d in near])
                alike = 100 * both[where] >= percent * (len(mine) + sizes[where] - both[where])
                found += [(min(doc, d), max(doc, d)) for d, ok in zip(near, alike, strict=True) if ok]
            yield pa.record_batch({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _remaining(rest: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of mixed buckets in different components, found by comparing blocks.

    Buckets with the same largest component form one group. Its members are dealt over blocks of about BLOCK_ROWS
    home rows; those outside of the largest component are probes, in blocks as well. Each pair of a home and a
    probe block is one comparison: by signatures first, then by the sets of the documents that are near another.
    """
    members = staged(rest.select("top", "doc_id", "comp", "n").distinct(), "members")
    sizes = members.groupBy("top").agg(F.count("*").alias("h"), F.count_if(F.col("comp") != F.col("top")).alias("p"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    sizes = staged(sizes.select("top", blocks("h").alias("nh"), blocks("p").alias("np")), "sizes")
    # Each member meets its signature once and is dealt over blocks with it.
    rows = members.join(sizes, "top").join(reps.select("doc_id", "sig"), "doc_id")
    own = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
    place = lambda hb, pb, probe: F.struct(hb.alias("hb"), pb.alias("pb"), F.lit(probe).alias("probe"))
    homes = F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda i: place(own("nh"), i, 0))
    probes = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: place(i, own("np"), 1))
    places = F.when(F.col("comp") != F.col("top"), F.concat(homes, probes)).otherwise(homes)
    signed = rows.select("top", "doc_id", "comp", "n", "sig", F.explode(places).alias("at")).select("top", "at.*", "doc_id", "comp", "n", "sig")
    near = signed.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(_near_in_block(percent), "top long, hb int, pb int, doc_id long, near array<long>")
    near = staged(near, "near-lists")
    text = docs.join(broadcast_if(near.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text"))
    # Each text meets its blocks once as well; the lists, which are long in large groups, go straight to theirs.
    places = near.groupBy("doc_id").agg(F.collect_set(F.struct(*_PLACE)).alias("places"))
    full = text.join(places, "doc_id").select("doc_id", "text", F.explode("places").alias("at")).select("at.*", "doc_id", F.lit(None).cast("array<long>").alias("near"), "text")
    full = full.union(near.filter("near is not null").select(*_PLACE, "doc_id", "near", F.lit(None).cast("string").alias("text")))
    return staged(full.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(_links_in_block(k, percent), "a long, b long"), "links").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Two documents are linked if their sets of `shingle_words`-word shingles (A-Z lower-cased; the whole sequence
    if there are fewer words) have a Jaccard similarity of `percent` or more. Equal sets are one node. Every pair of
    nodes whose signatures differ in at most RADIUS of PLACES places shares a bucket. Links are confirmed on the
    full sets. Each document is first confirmed against the first member of one of its buckets, then against those of the
    others that lie in another component, then against random
    members of the largest component there; what then still lies in another component is compared with the rest in
    blocks. Pairs inside one component need no test, so groups of copies cost rows, not pairs.

    Null or empty texts, and texts without a word, have no shingles and stand alone. A null id gives a null
    component and kept = true. Rows that repeat an id count as one document and each give a row. Other columns
    are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = staged(docs.mapInArrow(_sign(shingle_words), "doc_id long, n long, da long, db long, sig binary"), "sigs")
    live = sigs.filter("n > 0 and doc_id is not null")
    nodes = staged(
        live.groupBy("da", "db").agg(F.min(F.struct("doc_id", "n", "sig")).alias("m")).select("da", "db", "m.*"), "nodes"
    )
    reps = nodes.select("doc_id", "n", "sig")
    texts = docs.filter("doc_id is not null")
    keys = reps.mapInArrow(_emit_keys, "key long, doc_id long, n long")
    star = staged(
        keys.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_stars, "key long, leader long, leader_n long, doc_id long, n long"),
        "stars",
    )
    tried = star.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"), F.col("leader_n").alias("na"), F.col("n").alias("nb")).filter(_fits(percent))
    tried = staged(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # Most groups are one component after a single test for each member; of the other pairs only those between components are left.
    first = staged(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = confirmed(first, reps, texts, shingle_words, percent)
    links = links.union(confirmed(_apart(tried.join(first, ["a", "b"], "left_anti"), components(links)), reps, texts, shingle_words, percent))
    roots = components(links)
    for full in (False, True):
        members = staged(_members(star, roots), "mixed")
        if members.isEmpty():
            break
        rest = members.join(staged(_majority(members), "tops"), "key")
        if full:
            links = links.union(_remaining(rest, reps, texts, shingle_words, percent))
        else:
            links = links.union(confirmed(staged(_tests(rest, tried, percent), "pairs"), reps, texts, shingle_words, percent))
        roots = components(links)

    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = staged(roots.join(least, "root").select(F.col("node").alias("doc_id"), "component_id"), "components")
    # An id that repeats with other texts belongs to several nodes; the least of their components is its own.
    by_set = nodes.select("da", "db", "doc_id").join(named, "doc_id", "left")
    by_set = staged(by_set.select("da", "db", F.coalesce("component_id", "doc_id").alias("component_id")), "sets")
    found = sigs.join(by_set, ["da", "db"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
