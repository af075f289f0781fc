"""Whole jobs on a generated mini dataset, result tables, list scans and streams."""

import base64
import gzip
import hashlib
import io
import os
import tarfile
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cargohold.config import JobConfig
from cargohold.operators.aggregate import JobFailed, observed
from cargohold.plans.assets import ingest_images
from cargohold.plans.metadata import ingest_metadata
from cargohold.plans.run import run
from cargohold.operators.audit import plan_fetch
from cargohold.operators.skew import SkewPolicy
from cargohold.schemas import FAILURE_COLUMNS, IMAGE_LIST_COLUMNS, SUBSETS
from cargohold.plans import assets
from cargohold.session import scratch_dir
from cargohold.sinks.files import cached_stage
from cargohold.sinks.results import write_results
from cargohold.sources.fetch import FileFetcher
from cargohold.sources import image_list
from cargohold.sources.image_list import header_ok, read_image_list
from cargohold.streaming import ops as streaming
from cargohold.streaming.ops import stream_counts, unique_consecutive_stream

TEXTS = ['A "q" b', "line\nbreak", "crlf\r\nx", "  edges  ", "back\\slash", "", "com,ma", '"', "ünï", "x\\", "tab\tx"]
LIST_SCHEMA = ", ".join(f"{c} string" for c in IMAGE_LIST_COLUMNS)
SHORT = dict(max_retries=1, max_total_connections=4)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="cargohold-test-")


def list_row(i, data, url=None, subset=None, **changes):
    row = {c: "" for c in IMAGE_LIST_COLUMNS}
    row.update(
        ImageID=str(i),
        Subset=subset or SUBSETS[i % 3],
        OriginalURL=url or f"https://h.example.com/img{i:03d}.jpg",
        Author=TEXTS[i % len(TEXTS)],
        Title=TEXTS[(i + 3) % len(TEXTS)],
        OriginalSize=str(len(data)),
        OriginalMD5=base64.b64encode(hashlib.md5(data).digest()).decode(),
    )
    row.update(changes)
    return tuple(row[c] for c in IMAGE_LIST_COLUMNS)


def payload(i):
    return f"image {i} ".encode() * (i + 1)


def mini(folder):
    """Hosted images and list rows with every kind of trouble; returns (rows, expected codes)."""
    os.makedirs(f"{folder}/host")
    rows, codes = [], {}
    for i in range(12):
        data = payload(i)
        changes = {}
        if i != 3:
            with open(f"{folder}/host/img{i:03d}.jpg", "wb") as f:
                f.write(data)
        if i == 3:
            codes[i] = "RequestFailed"
        elif i == 4:
            changes["OriginalSize"], codes[i] = "7", "InvalidSize"
        elif i == 5:
            changes["OriginalMD5"], codes[i] = base64.b64encode(b"0" * 16).decode(), "MD5SumMismatch"
        elif i == 6:
            changes["OriginalURL"], codes[i] = "https://h.example.com/a", "BadPath"
        elif i == 7:
            changes["OriginalSize"], codes[i] = "many", "BadSize"
        elif i == 8:
            changes["OriginalMD5"], codes[i] = "?", "BadChecksumField"
        rows.append(list_row(i, data, **changes))
    return rows, codes


def upper(data):
    if b"image 9" in data:
        raise ValueError("no such colour")
    return data.upper()


def results_by_id(df):
    return {int(r.ImageID): r for r in df.collect()}


def test_ingest_images(spark, folder):
    rows, codes = mini(folder)
    df = spark.createDataFrame(rows, LIST_SCHEMA)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/host")
    cfg = JobConfig(root=f"{folder}/root", save_original_images=True, resize_output_format="up", **SHORT)
    first = results_by_id(ingest_images(df, cfg, "top", fetcher, upper, f"{folder}/first"))
    codes[9] = "ImageUnknown"
    assert {i: r.failure_code for i, r in first.items()} == {i: codes.get(i) for i in range(12)}
    assert all(r.need_fetch for r in first.values())
    for i, r in first.items():
        kept = r.failure_code is None or i == 9
        if r.dest_path:
            assert os.path.exists(r.dest_path) == kept
            assert os.path.exists(r.resized_path) == (r.failure_code is None)
        if r.failure_code is None:
            assert open(r.dest_path, "rb").read() == payload(i) and r.bytes_written == len(payload(i))
            assert open(r.resized_path, "rb").read() == payload(i).upper()
    assert first[9].failure_details == "resize failed: no such colour"
    # Second run: stored copies are used, a damaged one is fetched again.
    with open(first[0].dest_path, "wb") as f:
        f.write(b"damaged!")
    again = results_by_id(ingest_images(df, cfg, "top", fetcher, None, f"{folder}/second"))
    assert {i for i, r in again.items() if not r.need_fetch} == {i for i in range(12) if i not in codes} - {0} | {9}
    assert again[0].reason == "md5" and open(again[0].dest_path, "rb").read() == payload(0)
    assert again[1].failure_code is None
    for out in ("first", "second"):
        good = read_image_list(spark, f"{folder}/{out}/csv/outcome=success")
        bad = read_image_list(spark, f"{folder}/{out}/csv/outcome=failure", columns=FAILURE_COLUMNS)
        assert sorted(r.ImageID for r in good.unionByName(bad.select(*IMAGE_LIST_COLUMNS)).collect()) == sorted(
            r[0] for r in rows
        )
        assert {tuple(r) for r in good.collect()} <= set(rows)
        assert all(r.FailureDetails for r in bad.collect())


def test_ingest_small_images(spark, folder):
    """Size and digest are not checked, the original stands in for a missing thumbnail."""
    os.makedirs(f"{folder}/host")
    for name in ("img000.jpg", "thumb1.jpg"):
        with open(f"{folder}/host/{name}", "wb") as f:
            f.write(b"any bytes")
    rows = [
        list_row(0, b"other"),
        list_row(1, b"other", Thumbnail300KURL="https://h.example.com/thumb1.jpg"),
    ]
    cfg = JobConfig(root=f"{folder}/root", download_300k=True, save_original_images=True, resize_images=False, **SHORT)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/host")
    out = results_by_id(ingest_images(spark.createDataFrame(rows, LIST_SCHEMA), cfg, "top", fetcher))
    assert [out[i].failure_code for i in (0, 1)] == [None, None]
    assert out[1].dest_path.endswith("/thu/thumb1.jpg")


def archive(members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            tar.addfile(info, None if data is None else io.BytesIO(data))
    return buffer.getvalue()


def csv_list(rows, columns):
    def quote(value):
        return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value

    at = [IMAGE_LIST_COLUMNS.index(c) for c in columns]
    return "\n".join([",".join(columns)] + [",".join(quote(r[i]) for i in at) for r in rows]).encode() + b"\n"


def hosted_manifest(spark, folder, members_by_name, damage=None):
    os.makedirs(f"{folder}/archives", exist_ok=True)
    out = []
    for (role, name), members in members_by_name.items():
        tar = archive(members)
        packed = gzip.compress(tar)
        with open(f"{folder}/archives/{name}.tar.gz", "wb") as f:
            f.write(packed)
        for kind, data in (("tar.gz", packed), ("tar", tar)):
            md5 = hashlib.md5(data).hexdigest()
            if damage == "md5" and kind == "tar.gz":
                md5 = "0" * 32
            size = len(data) - (1 if damage == "size" and kind == "tar.gz" else 0)
            out.append((3, "2017_11", role, name, f"https://h.example.com/{name}.tar.gz", kind, f"{name}.{kind}", size, md5))
    schema = "version int, top_dir string, role string, description string, uri string, kind string, name string, size bigint, md5_hex string"
    return spark.createDataFrame(out, schema)


def test_ingest_metadata(spark, folder):
    members = {
        ("other", "ann"): {"2017_11/": None, "2017_11/train/ann.csv": b"x" * 3000, "2017_11/empty.csv": b""},
        ("other", "cls"): {"2017_11/classes.csv": b"a,b\n"},
    }
    rows = hosted_manifest(spark, folder, members)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/archives")
    cfg = JobConfig(root=f"{folder}/root", save_tarballs=True, **SHORT)
    first = ingest_metadata(spark, cfg, fetcher, rows)
    assert first.count() == 4 and first.filter("skipped").count() == 0
    assert open(f"{folder}/root/2017_11/train/ann.csv", "rb").read() == b"x" * 3000
    assert sorted(n for n in os.listdir(f"{folder}/root") if "tar" in n) == ["ann.tar", "ann.tar.gz", "cls.tar", "cls.tar.gz"]
    # With the tars stored nothing is fetched: a fetcher that knows no file will do.
    again = ingest_metadata(spark, cfg, FileFetcher("none", folder), rows)
    assert again.filter("skipped").count() == 3
    # A damaged tar is rebuilt from the stored tar.gz.
    with open(f"{folder}/root/cls.tar", "r+b") as f:
        f.write(b"zz")
    ingest_metadata(spark, cfg, FileFetcher("none", folder), rows)
    assert hashlib.md5(open(f"{folder}/root/cls.tar", "rb").read()).hexdigest() == rows.filter("name = 'cls.tar'").first().md5_hex


@pytest.mark.parametrize("damage,message", [("md5", "md5 sum mismatch"), ("size", "SizeLimit"), ("gone", "status 404")])
def test_metadata_failures_raise(spark, folder, damage, message):
    rows = hosted_manifest(spark, folder, {("other", "ann"): {"a.csv": b"x" * 100}}, damage)
    source = f"{folder}/nowhere" if damage == "gone" else f"{folder}/archives"
    cfg = JobConfig(root=f"{folder}/root", **SHORT)
    with pytest.raises(JobFailed, match=message):
        ingest_metadata(spark, cfg, FileFetcher("https://h.example.com/", source), rows)


def test_run_end_to_end(spark, folder):
    rows, codes = mini(folder)
    by_subset = {s: [r for r in rows if r[1] == s] for s in SUBSETS}
    lists = {f"2017_11/{s}/images.csv": csv_list(part, IMAGE_LIST_COLUMNS) for s, part in by_subset.items()}
    # One list has its columns in another order.
    lists["2017_11/test/images.csv"] = csv_list(by_subset["test"], IMAGE_LIST_COLUMNS[::-1])
    members = {("images", "images"): lists, ("other", "cls"): {"2017_11/classes.csv": b"a,b\n"}}
    manifest_rows = hosted_manifest(spark, folder, members)
    for name in os.listdir(f"{folder}/archives"):
        os.link(f"{folder}/archives/{name}", f"{folder}/host/{name}")
    cfg = JobConfig(root=f"{folder}/root", resize_images=False, **SHORT)
    out = run(spark, cfg, FileFetcher("https://h.example.com/", f"{folder}/host"), manifest_rows)
    assert out["metadata"].count() == 1
    assert len(os.listdir(f"{folder}/root/results/2017_11")) == 1
    assert {int(r.ImageID): r.failure_code for r in out["images"].collect()} == {i: codes.get(i) for i in range(12)}
    assert sum(r.n_rows for r in out["report"].collect()) == 12
    got = {tuple(r) for r in out["images"].select(*IMAGE_LIST_COLUMNS).collect()}
    assert got == set(rows)
    assert not [n for n in os.listdir(f"{folder}/root") if "tar" in n]


def test_results_tables(spark, folder):
    rows = [list_row(i, b"x", subset="train") for i in range(len(TEXTS))]
    df = spark.createDataFrame(rows, LIST_SCHEMA).withColumn("failure_code", F.when(F.col("ImageID") > 5, "Redirect"))
    df = df.withColumn("failure_details", F.when(F.col("failure_code").isNotNull(), F.col("Author")))
    write_results(df, f"{folder}/csv", SUBSETS)
    good = read_image_list(spark, f"{folder}/csv/outcome=success", with_filename=True)
    bad = read_image_list(spark, f"{folder}/csv/outcome=failure", columns=FAILURE_COLUMNS)
    assert {tuple(r) for r in good.select(*IMAGE_LIST_COLUMNS).collect()} == {r for r in rows if int(r[0]) <= 5}
    assert {r.FailureDetails for r in bad.collect()} == {r[6] for r in rows if int(r[0]) > 5}
    assert good.filter("_csv_filename LIKE '/%subset_dir=train%'").count() == 6
    for outcome, columns in (("success", IMAGE_LIST_COLUMNS), ("failure", FAILURE_COLUMNS)):
        for subset in ("validation", "test"):
            path = f"{folder}/csv/outcome={outcome}/subset_dir={subset}/part-header.csv"
            assert open(path).read() == ",".join(columns) + "\n"
        assert header_ok(spark, f"{folder}/csv/outcome={outcome}", columns).filter("NOT header_ok").count() == 0
    write_results(df, f"{folder}/text", compat=True)
    want = {0: set(), 1: set()}
    for r in rows:
        bad = int(r[0]) > 5
        quoted = [('"' + v.replace('"', '""') + '"') if i in (6, 7) else v for i, v in enumerate(r)]
        want[bad].add(",".join(quoted + (['"' + r[6].replace('"', '""') + '"'] if bad else [])))
    for bad, (outcome, columns) in enumerate((("success", IMAGE_LIST_COLUMNS), ("failure", FAILURE_COLUMNS))):
        place = f"{folder}/text/outcome={outcome}/subset_dir=train"
        names = sorted(n for n in os.listdir(place) if n.startswith("part-"))
        text = "".join(open(f"{place}/{n}", newline="").read() for n in names)
        assert text.startswith(",".join(columns) + "\n")
        rest = text[len(",".join(columns)) + 1 :]
        assert len(rest) == sum(len(line) + 1 for line in want[bad]) and all(line + "\n" in rest for line in want[bad])
    with open(f"{folder}/odd.csv", "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError, match="not in the header"):
        read_image_list(spark, f"{folder}/odd.csv")


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(max_rows=10)], ids=["whole", "sliced"])
def test_list_reader(spark, folder, policy):
    """Many small splits, so records and quoted fields cross their borders."""
    rows = [list_row(i, b"x", subset="train") for i in range(200)]
    with open(f"{folder}/unix.csv", "wb") as f:
        f.write(csv_list(rows[:150], IMAGE_LIST_COLUMNS))
    with open(f"{folder}/dos.csv", "wb") as f:
        f.write(csv_list(rows[150:], IMAGE_LIST_COLUMNS).replace(b",\n", b",\r\n"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        got = [tuple(r) for r in read_image_list(spark, folder, policy=policy).collect()]
        assert len(got) == len(rows) and set(got) == set(rows)
        simple = [r for r in rows if not any("\n" in v or v == "x\\" for v in r)]
        os.makedirs(f"{folder}/simple")
        with open(f"{folder}/simple/list.csv", "wb") as f:
            f.write(csv_list(simple, IMAGE_LIST_COLUMNS))
        plain = read_image_list(spark, f"{folder}/simple", multi_line=False)
        assert sorted(tuple(r) for r in plain.collect()) == sorted(simple)
    finally:
        spark.conf.set(key, before)


class Stop(Exception):
    pass


def test_quotes_inside_fields_lose_no_row(spark, folder):
    lines = [f'{i},x,5" tv {i},"a ""b"", c","two\nlines ""{i}""",,"q"z,,7,m,t' for i in range(10)]
    with open(f"{folder}/list.csv", "w") as f:
        f.write(",".join(IMAGE_LIST_COLUMNS) + "\n" + "\n".join(lines) + "\n")
    rows = read_image_list(spark, f"{folder}/list.csv").collect()
    assert sorted(int(r[0]) for r in rows) == list(range(10))
    assert {r[2] for r in rows} == {f'5" tv {i}' for i in range(10)}
    assert {r[4] for r in rows} == {f'two\nlines "{i}"' for i in range(10)}
    with open(f"{folder}/open.csv", "w") as f:
        f.write(",".join(IMAGE_LIST_COLUMNS) + '\n1,"never closed,2\n3,4\n')
    with pytest.raises(ValueError, match="ends inside a quoted field"):
        read_image_list(spark, f"{folder}/open.csv").collect()


def broken_after(monkeypatch, parts):
    """Let the job store that many parts of its results and then fail."""
    real, seen = assets.spool, []

    def spool(df, path=None):
        if path and "/rows/part=" in path:
            if len(seen) == parts:
                raise Stop
            seen.append(path)
        return real(df, path)

    monkeypatch.setattr(assets, "spool", spool)


@pytest.mark.parametrize("first,kept,then", [(4, 2, 2), (4, 1, 1), (5, 2, 8), (3, 0, 5)])
def test_resume_finishes_the_rest(spark, folder, monkeypatch, first, kept, then):
    rows, codes = mini(folder)
    df = spark.createDataFrame(rows, LIST_SCHEMA)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/host")
    cfg = JobConfig(root=f"{folder}/root", resize_images=False, **SHORT)
    with monkeypatch.context() as patch:
        broken_after(patch, kept)
        with pytest.raises(Stop):
            ingest_images(df, cfg, "top", fetcher, results=f"{folder}/out", waves=first)
    longer = df.union(spark.createDataFrame([list_row(20, b"new")] * 2, LIST_SCHEMA))
    got = ingest_images(longer, cfg, "top", fetcher, results=f"{folder}/out", waves=then).collect()
    assert sorted(int(r.ImageID) for r in got) == [*range(12), 20, 20]
    assert {int(r.ImageID): r.failure_code for r in got} == {i: codes.get(i) for i in range(12)} | {20: "RequestFailed"}
    # Finished: nothing is asked for again. Other rows or another configuration are refused.
    again = ingest_images(longer, cfg, "top", FileFetcher("none", folder), results=f"{folder}/out", waves=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    with pytest.raises(ValueError, match="another configuration"):
        ingest_images(longer, JobConfig(root=f"{folder}/root", **SHORT), "top", fetcher, results=f"{folder}/out")
    for other in (df, longer.union(df)):
        with pytest.raises(ValueError, match="lacks or counts otherwise"):
            ingest_images(other, cfg, "top", fetcher, results=f"{folder}/out")


def test_one_path_holds_the_bytes_of_one_url(spark, folder):
    os.makedirs(f"{folder}/host/b")
    for name, data in (("same.jpg", b"first"), ("b/same.jpg", b"other")):
        with open(f"{folder}/host/{name}", "wb") as f:
            f.write(data)
    urls = ["https://h.example.com/same.jpg", "https://h.example.com/b/same.jpg", "https://h.example.com/same.jpg"]
    data = [b"first", b"other", b"first"]
    rows = [list_row(i, data[i], subset="train", OriginalURL=u) for i, u in enumerate(urls)]
    cfg = JobConfig(root=f"{folder}/root", save_original_images=True, resize_images=False, **SHORT)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/host")
    part = spark.createDataFrame(rows[:1], LIST_SCHEMA)
    ingest_images(part, cfg, "top", fetcher, results=f"{folder}/out")
    out = results_by_id(ingest_images(spark.createDataFrame(rows, LIST_SCHEMA), cfg, "top", fetcher, results=f"{folder}/out"))
    assert [out[i].failure_code for i in range(3)] == [None, "TargetTaken", None]
    assert open(out[0].dest_path, "rb").read() == b"first"


def test_stage_of_other_inputs_is_built_again(spark, folder):
    for made_from, value in (("a", 1), ("a", 1), ("b", 3)):
        built = cached_stage(spark, f"{folder}/stage", lambda v=value: spark.range(v), made_from=made_from)
        assert built.count() == value
    assert cached_stage(spark, f"{folder}/stage", lambda: spark.range(9), made_from="b").count() == 3


def test_valid_copies_are_opened_once(spark, folder, monkeypatch):
    rows, codes = mini(folder)
    df = spark.createDataFrame(rows, LIST_SCHEMA)
    cfg = JobConfig(root=f"{folder}/root", save_original_images=True, resize_images=False, **SHORT)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/host")
    first = results_by_id(ingest_images(df, cfg, "top", fetcher))
    planned = assets.plan_images(df, cfg, "top")
    monkeypatch.setattr(assets, "read_stored", lambda df, path="dest_path": assets._no_response(df).withColumn("body", F.raise_error("opened").cast("binary")))
    second = results_by_id(assets.store_and_resize(assets.acquire(planned, cfg, fetcher), cfg))
    assert {i: (r.failure_code, r.bytes_written) for i, r in second.items()} == {i: (r.failure_code, r.bytes_written) for i, r in first.items()}


def test_result_writes_evaluate_their_input_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [list_row(i, b"x") for i in range(50)]
    df = spark.createDataFrame(rows, LIST_SCHEMA).withColumn("failure_code", F.when(F.col("ImageID") > 25, "Redirect"))
    df = df.withColumn("failure_details", F.col("Author"))
    write_results(df.mapInArrow(count, df.schema), f"{folder}/csv", SUBSETS)
    assert seen.value == 50


def test_paths_of_workers():
    from cargohold import storage

    assert storage.resolve("file:/a/b")[1] == storage.resolve("file:///a/b")[1] == storage.resolve("/a/b")[1] == "/a/b"
    for bad in ("dbfs:/x", "dbfs://x/y", "ftp://h/x"):
        with pytest.raises(ValueError, match="cannot open"):
            storage.resolve(bad)
    opened = []
    known = {"hdfs:/x/y": "hdfs:///", "hdfs://n:8020/x/y": "hdfs://n:8020/", "s3a://b/x/y": "s3://b/", "s3://b/x/y": "s3://b/"}
    real = storage._mounted
    try:
        storage._mounted = lambda root: opened.append(root) or (None, "")
        assert {storage.resolve(p)[1] for p in known} == {"/x/y"}
    finally:
        storage._mounted = real
    assert opened == list(known.values())


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session, "x")


def test_observed(spark):
    df = spark.range(10).withColumn("failure_code", F.when(F.col("id") < 3, "Redirect"))
    watched, metrics = observed(df, "counts")
    watched.write.format("noop").mode("overwrite").save()
    assert metrics.get == {"rows": 10, "failures": 3}


def test_scratch_dir_uses_the_shared_folder(spark):
    class Session:
        sparkContext = spark.sparkContext
        conf = {"spark.checkpoint.dir": "hdfs://cluster/shared/"}

    assert scratch_dir(spark, "x").startswith("/")
    first, second = scratch_dir(Session, "x"), scratch_dir(Session, "x")
    assert first.startswith("hdfs://cluster/shared/x-") and first != second


def test_stream_plan_equals_batch(spark, folder):
    schema = "dest_path string, expected_size bigint, expected_md5 string"
    rows = [(f"/s/{i}", 10 + i % 2, "ab" if i % 3 else "cd") for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in")
    stored = spark.createDataFrame([(f"/s/{i}", 10, "ab") for i in range(15)], "path string, length bigint, md5 string")
    want = plan_fetch(spark.createDataFrame(rows, schema), stored)
    for name, static in (("plan_listed", stored), ("plan_asked", None)):
        planned = plan_fetch(spark.readStream.schema(schema).parquet(f"{folder}/in"), static)
        query = planned.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.table("plan_listed").collect())) == sorted(map(tuple, want.collect()))
    assert {r.reason for r in spark.table("plan_asked").collect()} == {"missing"}


def test_stream_unique_and_counts(spark, folder):
    values = [("a", None), ("a", "x"), ("b", "x"), ("a", "x"), ("a", None), ("a", None), ("b", "y"), ("b", "y")]
    schema = "k string, v string, pos int"
    for part in (0, 4):
        rows = [(k, v, part + i) for i, (k, v) in enumerate(values[part : part + 4])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        kept = unique_consecutive_stream(source, "v", ["pos"], ["k"])
        sink = kept.writeStream.format("parquet").option("path", f"{folder}/out")
        sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema).parquet(f"{folder}/out").orderBy("pos")
    assert [r.pos for r in out.collect()] == [0, 1, 2, 4, 6]
    counts = stream_counts(spark.readStream.schema(schema).parquet(f"{folder}/in"), ["k"])
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts_by_key")
    query.trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.n_rows for r in spark.table("counts_by_key").collect()} == {"a": 5, "b": 3}


def _feed(spark, folder, schema, batches, **options):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        kept = unique_consecutive_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), **options)
        sink = kept.writeStream.format("parquet").option("path", f"{folder}/out")
        sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").orderBy("pos").collect()


def test_stream_unique_compares_typed_columns(spark, folder):
    nan, noon = float("nan"), datetime(2024, 1, 1, 12)
    values = [(1, nan, noon), (1, nan, noon), (2, nan, noon), (2, None, noon), (2, None, noon), (2, None, None), (None, 0.5, None), (None, 0.5, None)]
    rows = [("k", *v, i) for i, v in enumerate(values * 2)]
    out = _feed(spark, folder, "k string, a int, b double, c timestamp, pos int", [rows[:5], rows[5:]], cols=["a", "b", "c"], order_by=["pos"], partition_by=["k"])
    assert [r.pos for r in out] == [0, 2, 3, 5, 6, 8, 10, 11, 13, 14]


def test_stream_key_larger_than_memory_is_merged_in_order(spark, folder, monkeypatch):
    monkeypatch.setattr(streaming, "RUN_ROWS", 700)
    monkeypatch.setattr(streaming, "BLOCK_ROWS", 64)
    rows = [(1, (i // 3) % 5 if i % 7 else None, i) for i in range(12_500)]
    shuffled = sorted(rows[:12_000], key=lambda r: r[2] * 7919 % 12_007)
    out = _feed(spark, folder, "k int, v int, pos int", [shuffled, rows[12_000:]], cols="v", order_by=["pos"], partition_by=["k"])
    want = [r for i, r in enumerate(rows) if i == 0 or r[1] != rows[i - 1][1]]
    assert [tuple(r) for r in out] == want


@pytest.mark.parametrize("run_rows", [3, 50_000])
def test_stream_with_watermark_orders_across_batches(spark, folder, monkeypatch, run_rows):
    monkeypatch.setattr(streaming, "RUN_ROWS", run_rows)
    monkeypatch.setattr(streaming, "BLOCK_ROWS", 2)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("k", at(i), (i // 4) % 2, i) for i in range(40)]
    dealt = [[r for r in rows[:20] if r[3] % 2 == 0], [r for r in rows[:20] if r[3] % 2], rows[39:19:-1]]
    late = ("k", at(1), 9, 100)
    ends = [[("end", at(300), 0, 200)], [late, ("end", at(400), 1, 201)]]
    out = _feed(spark, folder, "k string, ts timestamp, v int, pos int", dealt + ends, cols=["v"], order_by=["ts", "pos"], partition_by=["k"], watermark=("ts", "60 minutes"))
    # The row that comes after the watermark has passed it is dropped; the end's own rows still wait or have left.
    assert [r.pos for r in out if r.k == "k"] == list(range(0, 40, 4))
    with pytest.raises(ValueError, match="begin"):
        unique_consecutive_stream(spark.createDataFrame([], "k int, ts timestamp"), "k", ["k"], ["k"], ("ts", "1 day"))


def test_line_texts_stay_out_of_the_sums(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text(",".join(IMAGE_LIST_COLUMNS) + "\n" + "".join(f'i{i},train,,,,,,"line {i}\nsecond, ""{i}""",,,\n' for i in range(50)))
    seen, cut = [], image_list.slice_hot_keys
    monkeypatch.setattr(image_list, "slice_hot_keys", lambda df, *rest: seen.append(df.columns) or cut(df, *rest))
    for limit in (1000, 7):
        rows = image_list.read_image_list(spark, str(tmp_path), policy=SkewPolicy(max_rows=limit)).collect()
        assert {(r.ImageID, r[7]) for r in rows} == {(f"i{i}", f'line {i}\nsecond, "{i}"') for i in range(50)}
    assert seen and all("value" not in columns for columns in seen)
