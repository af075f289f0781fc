"""The tar data source, requests dealt by size and the ledger of attempts."""

import io
import tarfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from cargohold.functions import paths as P
from cargohold.sources import fetch as FT
from cargohold.sources import ledger, schedule
from cargohold.sources import tar_source as S
from cargohold.sources.tar import tar_entries, tar_index


def pack(path, files, pax=True):
    with tarfile.open(path, "w", format=tarfile.PAX_FORMAT if pax else tarfile.GNU_FORMAT) as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            tar.addfile(info, io.BytesIO(data or b""))


FILES = [(f"{'long/' * 30 if i % 9 == 0 else ''}f{i % 5}/n{i:03}", None if i % 13 == 5 else bytes([i % 256]) * (i * 37 % 3000)) for i in range(120)]


@pytest.fixture
def archives(tmp_path):
    folder = tmp_path / "tars"
    folder.mkdir()
    pack(folder / "a.tar", FILES)
    pack(folder / "b.tar", FILES[:7], pax=False)
    pack(folder / "empty.tar", [])
    (folder / "_hidden.tar").write_bytes(b"x")
    return str(folder)


def rows(df):
    return sorted((r.archive, r.entry_ord, r.entry_name, r.entry_size, r.entry_type, r.data_offset, r.error, r.bytes and bytes(r.bytes)) for r in df.collect())


@pytest.mark.parametrize("window", [1, 4096, 20_000, 1 << 30])
def test_windows_give_every_entry_once(spark, archives, window):
    found = S.read_archives(spark, archives, window)
    assert rows(found) == rows(tar_entries(tar_index(spark, archives)))
    assert found.rdd.getNumPartitions() >= (40 if window == 1 else 1)


def test_without_windows_an_archive_is_a_partition(spark, archives):
    S.register(spark)
    frame = spark.read.format("tar").option("path", archives).load()
    assert rows(frame) == rows(tar_entries(tar_index(spark, archives)))
    headers = spark.read.format("tar").option("path", f"{archives}/a.tar").option("bytes", "false").load()
    assert "bytes" not in headers.columns and headers.count() == len(FILES)
    with pytest.raises(Exception, match="path"):
        spark.read.format("tar").load().count()


def test_filters_are_decided_on_headers(spark, archives):
    frame = S.read_archives(spark, archives, 8192)
    want = lambda keep: sorted(n for n, d in FILES if keep(n, d))
    picked = frame.filter("archive LIKE '%a.tar' AND entry_type = 'file' AND entry_size > 1000 AND entry_name LIKE '%f1/%'")
    assert sorted(r.entry_name for r in picked.collect()) == want(lambda n, d: d is not None and len(d) > 1000 and "f1/" in n)
    assert "BatchScan" in picked._jdf.queryExecution().toString()
    either = frame.filter("archive LIKE '%a.tar' AND (entry_size = 37 OR entry_name IN ('f1/n001', 'f2/n002')) AND NOT entry_ord > 50")
    assert sorted(r.entry_name for r in either.collect()) == ["f1/n001", "f2/n002"]


def test_only_matching_ranges_are_opened(archives, spark):
    table = f"{archives}/../windows"
    S.write_windows(spark, archives, table, 8192)
    schema = S.TarDataSource({"windows": table}).schema()
    reader = S.TarReader({"windows": table}, schema)
    pushed = [D.EqualTo(("archive",), f"{archives}/a.tar"), D.GreaterThan(("entry_size",), 2500), D.Not(D.StringStartsWith(("entry_name",), "f3/"))]
    left = D.EqualTo(("bytes",), b"x")
    assert list(reader.pushFilters([*pushed, left])) == [left]
    parts = reader.partitions()
    assert {p.archive for p in parts} == {f"{archives}/a.tar"}
    got = [n for p in parts for b in reader.read(p) for n in b.column("entry_name").to_pylist()]
    want = [(n, d) for n, d in FILES if d is not None and len(d) > 2500 and not n.startswith("f3/")]
    assert sorted(got) == sorted(n for n, _ in want)
    assert reader.opened == [len(want), sum(len(d) for _, d in want)]


def test_damage(spark, tmp_path):
    pack(tmp_path / "good.tar", FILES[:20])
    data = (tmp_path / "good.tar").read_bytes()
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / "cut.tar").write_bytes(data[:7_000])
    used = data.rstrip(b"\0")
    (folder / "noend.tar").write_bytes(used.ljust(-(-len(used) // 512) * 512, b"\0"))
    (folder / "none.tar").write_bytes(b"")
    (folder / "junk.tar").write_bytes(b"j" * 2048)
    want = rows(tar_entries(tar_index(spark, str(folder), "PERMISSIVE")))
    for window in (600, 1 << 20):
        assert rows(S.read_archives(spark, str(folder), window, mode="PERMISSIVE")) == want
    with pytest.raises(Exception, match="bad tar archive"):
        S.read_archives(spark, str(folder)).collect()
    small = S.read_archives(spark, str(tmp_path / "good.tar"), maxBytes="100")
    over = {r.entry_name: (r.error, r.bytes) for r in small.collect()}
    assert over[FILES[1][0]][0] is None and over[FILES[8][0]] == ("EntryTooLarge", None)


def test_stream_reads_each_archive_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for lot in range(3):
        pack(folder / f"{lot}.tar", [(f"{lot}/x", b"1"), (f"{lot}/y", b"")])
        stream = S.stream_archives(spark, str(folder))
        sink = stream.select("entry_name", "entry_size", "error").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        sink.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.entry_name for r in got) == ["0/x", "0/y", "1/x", "1/y", "2/x", "2/y"]


# --- schedule -----------------------------------------------------------------------------------


def requests(spark):
    """One host with a third of the requests and most bytes, some middling ones, many small ones."""
    size = F.when(F.col("id") % 3 == 0, F.col("id") * 7919 % 10_000_000).otherwise(F.col("id") % 50_000)
    host = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, F.concat(F.lit("mid"), F.col("id") % 4)).otherwise(F.concat(F.lit("s"), F.col("id") % 500))
    return spark.range(6000).select(F.concat(F.lit("https://"), host, F.lit("/"), "id").alias("url"), F.when(F.col("id") % 10 != 9, size).alias("size"))


@pytest.mark.parametrize("bucket", [50, 20_000])
@pytest.mark.parametrize("per_host,total,threads", [(5, 16, 1), (3, 8, 1), (8, 32, 4), (50, 4, 1)])
def test_limits_hold_and_partitions_are_even(spark, monkeypatch, per_host, total, threads, bucket):
    monkeypatch.setattr(schedule, "BUCKET_ROWS", bucket)
    dealt = schedule.schedule(requests(spark), "url", F.col("size"), per_host, total, threads)
    got = dealt.select(P.url_host(F.col("url")).alias("host"), "url", F.coalesce("size", F.lit(0)).alias("size"), F.spark_partition_id().alias("p")).collect()
    assert sorted(r.url for r in got) == sorted(r.url for r in requests(spark).collect())
    places, most = total // threads, max(1, per_host // threads)
    assert {r.p for r in got} <= set(range(places))
    spread = {h: {r.p for r in got if r.host == h} for h in ("big", "mid1")}
    assert all(len(p) <= most for p in spread.values()) and len(spread["big"]) == min(most, places)
    by_host = Counter()
    for host, p in {(r.host, r.p) for r in got}:
        by_host[host] += 1
    assert max(by_host.values()) <= most
    loads = Counter()
    for r in got:
        loads[r.p] += r.size + schedule.REQUEST_BYTES
    # Nothing beats the larger of an even share and what the largest host must put into each of its places.
    bound = max(sum(loads.values()) / places, sum(r.size + schedule.REQUEST_BYTES for r in got if r.host == "big") / min(most, places))
    assert max(loads.values()) <= 1.35 * bound


def test_largest_request_comes_first_and_alone(spark):
    rows = [("https://a/huge", 10**9), *[(f"https://a/{i}", 10**6) for i in range(400)], *[(f"https://b{i}/x", None) for i in range(50)], ("none", 5), (None, 5)]
    dealt = schedule.schedule(spark.createDataFrame(rows, "url string, size bigint"), "url", F.col("size"), 4, 8)
    parts = dealt.rdd.glom().collect()
    assert len(parts) == 8 and sum(map(len, parts)) == len(rows)
    first = next(p for p in parts if any(r.url == "https://a/huge" for r in p))
    assert first[0].url == "https://a/huge"
    assert schedule.schedule(spark.createDataFrame([], "url string, size bigint"), "url", F.col("size"), 4, 8).collect() == []


def test_place_hosts_packs_largest_first():
    placed = schedule.place_hosts([("a", 800), ("b", 400), ("c", 400), ("d", 100)], 1700, 4, 2)
    assert len(placed["a"]) == 2 and all(len(set(v)) == len(v) <= 2 for v in placed.values())
    loads = Counter()
    for host, size in (("a", 800), ("b", 400), ("c", 400), ("d", 100)):
        for p in placed[host]:
            loads[p] += size / len(placed[host])
    assert max(loads.values()) <= 500


# --- ledger -------------------------------------------------------------------------------------


class Flaky:
    """Fails for URLs that end in a digit of `turn` or more; a URL with `gone` is answered by 404."""

    def __init__(self, turn):
        self.turn = turn

    def __call__(self, url):
        if "gone" in url:
            return FT.Response(404)
        if int(url[-1]) >= self.turn:
            raise FT.TransportError("reset")
        return FT.Response(200, "text/plain", 1, None, io.BytesIO(url[-1].encode()))


def test_ledger_waits_doubles_and_closes(spark, tmp_path):
    urls = [f"https://h/{i}" for i in range(4)] + ["https://h/gone", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:1])], "k int, url string")
    folder, start = f"{tmp_path}/ledger", datetime(2024, 1, 1)
    run = lambda turn, seconds, most=3: ledger.fetch_due(df, "url", Flaky(turn), folder, start + timedelta(seconds=seconds), max_attempts=most, base_seconds=10, total=2)
    assert run(1, 0) == 5  # 0 answers, 1 to 3 fail, `gone` is an answer
    assert run(9, 9) == 0
    assert run(2, 10) == 3  # 1 answers
    assert run(3, 29) == 0  # the second wait is twice as long
    open_ = {r.url: r for r in ledger.answers(df, "url", folder).collect() if r.due is not None}
    assert {u: r.attempts for u, r in open_.items()} == {"https://h/2": 2, "https://h/3": 2}
    assert run(3, 30) == 2  # 2 answers, 3 has used its attempts
    assert run(9, 10_000) == 0
    out = {r.k: r for r in ledger.answers(df, "url", folder).collect()}
    assert len(out) == 7 and [out[k].attempts for k in range(7)] == [1, 2, 3, 3, 1, 0, 1]
    assert [out[k].status for k in range(7)] == [200, 200, 200, None, 404, None, 200]
    assert out[3].transport_error == "TransportError: reset" and all(r.due is None for r in out.values())
    assert bytes(out[6].body) == b"0"
    more = df.union(spark.createDataFrame([(9, "https://h/new0")], df.schema))
    assert ledger.fetch_due(more, "url", Flaky(5), folder, start, total=2) == 1


def test_a_broken_pass_is_repeated(spark, tmp_path):
    df = spark.createDataFrame([("https://h/1",)], "url string")
    folder = f"{tmp_path}/ledger"
    (tmp_path / "ledger" / "pass=0").mkdir(parents=True)
    (tmp_path / "ledger" / "pass=0" / "part-0.parquet").write_bytes(b"half")
    assert ledger.attempts(df, folder).collect() == []
    assert ledger.fetch_due(df, "url", Flaky(5), folder, datetime(2024, 1, 1), total=2) == 1
    assert ledger.answers(df, "url", folder).first().status == 200


def test_small_windows_share_partitions(spark, archives):
    table = f"{archives}/../shared-windows"
    S.write_windows(spark, archives, table, 2048)
    schema = S.TarDataSource({"windows": table}).schema()
    alone = S.TarReader({"windows": table}, schema).partitions()
    few = S.TarReader({"windows": table, "tasks": "5"}, schema)
    parts = few.partitions()
    files = len({w.archive for w in alone})
    assert len(alone) > 20 and files <= len(parts) <= 5 + files
    assert {(w.archive, w.begin, w.ordinal) for w in parts} < {(w.archive, w.begin, w.ordinal) for w in alone}
    reader = S.TarReader({"windows": table}, schema)
    entries = lambda r, ws: [e for w in ws for b in r.read(w) for e in b.to_pylist()]
    assert entries(few, parts) == entries(reader, alone)
