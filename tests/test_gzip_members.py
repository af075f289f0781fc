"""Gzip files of several members."""

import gzip
import hashlib
import io
import os
import re
import zlib

import pytest

from cargohold.plans import catalog
from cargohold.sources.gzip_members import Member, _heads, member_index, read_members


def stored(data):
    """A member whose data isn't compressed, so that a gzip file inside it can be seen."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("members")
    small = [gzip.compress(bytes([i]) * i) for i in range(30)]
    named = b"\x1f\x8b\x08\x08" + gzip.compress(b"with a name")[4:10] + b"name\0" + gzip.compress(b"with a name")[10:]
    large = os.urandom(3_000_000)
    nested = stored(b"head" + gzip.compress(b"inner one") + gzip.compress(b"inner two") + b"tail")
    cut = small[9][:-3]
    made = {
        "many.gz": b"".join(small),
        "one.gz": gzip.compress(large),
        "mixed.gz": named + gzip.compress(large) + small[0] + small[5],
        "nested.gz": nested + small[4] + nested,
        "padded.gz": small[3] + b"\0" * 600,
        "garbage.gz": small[3] + b"garbage",
        "gap.gz": small[3] + cut + small[4],
        "late.gz": b"text" + small[4],
        "cut.gz": small[3] + cut,
        "empty.gz": b"",
        "text.gz": b"no gzip at all",
    }
    for name, data in made.items():
        (folder / name).write_bytes(data)
    return folder, made, large


def index(spark, folder, names, window):
    df = spark.createDataFrame([(f"{folder}/{n}",) for n in names], "path string")
    return member_index(df, window=window)


@pytest.mark.parametrize("window", [50, 1 << 20])
def test_small_members(spark, files, window):
    folder, made, _ = files
    names = ["many.gz", "nested.gz", "padded.gz"]
    found = index(spark, folder, [*names, *names], window).cache()
    assert found.filter("error IS NOT NULL").count() == 0
    assert found.filter("path LIKE '%many.gz'").count() == 30 and found.filter("path LIKE '%nested.gz'").count() == 3
    data = {}
    for r in sorted(read_members(found).collect(), key=lambda r: (r.path, r.member, r.pos)):
        data[os.path.basename(r.path)] = data.get(os.path.basename(r.path), b"") + bytes(r.bytes)
    assert data == {n: gzip.decompress(made[n]) for n in names}
    places = [(r.member, r.start, r.end) for r in found.filter("path LIKE '%many.gz'").orderBy("member").collect()]
    assert [p[0] for p in places] == list(range(30)) and all(a[2] == b[1] for a, b in zip(places, places[1:]))


def test_large_members_come_in_pieces_and_names_in_heads(spark, files):
    folder, _, large = files
    found = index(spark, folder, ["one.gz", "mixed.gz"], 500_000).cache()
    assert [(r.member, r.n_bytes) for r in found.filter("path LIKE '%mixed.gz'").orderBy("member").collect()] == [
        (0, 11), (1, len(large)), (2, 0), (3, 5)
    ]
    pieces = read_members(found.filter("n_bytes > 1000")).orderBy("path", "pos").collect()
    assert max(len(r.bytes) for r in pieces) <= 1 << 20 and len(pieces) >= 6
    assert b"".join(bytes(r.bytes) for r in pieces) == large * 2
    # One task for each member, not for each file.
    assert {r.member for r in pieces} == {0, 1}


def test_damage_is_reported(spark, files):
    folder, made, _ = files
    names = ["garbage.gz", "gap.gz", "late.gz", "cut.gz", "empty.gz", "text.gz", "absent.gz"]
    found = index(spark, folder, names, 64).collect()
    errors = {os.path.basename(r.path): r.error for r in found if r.error}
    first = len(gzip.compress(b"\3" * 3))
    assert errors == {
        "garbage.gz": f"no member at byte {first}", "gap.gz": f"no member at byte {first}", "late.gz": "no member at byte 0",
        "cut.gz": f"no member at byte {first}", "empty.gz": "no gzip member", "text.gz": "no gzip member", "absent.gz": "NotFound",
    }


def test_no_files(spark):
    df = spark.createDataFrame([(None,)], "path string")
    assert member_index(df).collect() == [] and read_members(member_index(df)).collect() == []


def test_a_short_member_is_read_by_few_bytes(files):
    folder, made, _ = files
    read = []

    class Counted:
        def __init__(self, stream):
            self.seek, self.tell, self.stream = stream.seek, stream.tell, stream

        def read(self, n):
            read.append(len(got := self.stream.read(n)))
            return got

    behind = made["many.gz"] + bytes(5_000_000)
    member = Member(Counted(io.BytesIO(behind)), 0)
    assert b"".join(member) == b"" and member.end == len(gzip.compress(b"")) and sum(read) <= 4096
    (folder / "wide.bin").write_bytes(behind)
    assert sum(1 for _ in _heads(f"{folder}/wide.bin", 0, len(made["many.gz"]))) >= 30
    assert list(_heads(f"{folder}/many.gz", 0, 1)) == [0]


def test_members_meet_their_windows_without_a_broadcast(spark, files):
    folder, _, _ = files
    found = index(spark, folder, ["many.gz", "one.gz", "absent.gz"], 50)
    assert len(found.collect()) == 32
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_query_joins_digests_to_the_index_without_a_broadcast(spark, tmp_path):
    texts = ["x" * (i % 3) for i in range(20)]
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    done = catalog.all_queries()["gunzip_members"](spark, str(tmp_path))
    expected = [(i, len(text), hashlib.md5(text.encode()).hexdigest(), None) for i, text in enumerate(texts)]
    assert sorted(map(tuple, done.collect())) == expected
    assert re.search(r"SortMergeJoin \[path#\d+, member#\d+L\]", done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
