"""Columns, classification, audit, fetch, pipe, digests and images on small literal cases."""

import base64
import hashlib
import io
import os
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargohold.config import JobConfig
from cargohold.functions import digest as D
from cargohold.functions import paths as P
from cargohold.functions import text as X
from cargohold.operators import audit, classify, images
from cargohold.operators.aggregate import host_count
from cargohold.operators.digests import digest_chunks, with_empty
from cargohold.operators.pipe import convert_command, pipe_through
from cargohold.operators.route import if_then_else, tee
from cargohold.operators.skew import SkewPolicy
from cargohold.plans import catalog
from cargohold.schemas import IMAGE_LIST_COLUMNS
from cargohold.sinks.files import spool
from cargohold.sources import fetch as FT
from cargohold.sources.manifest import manifest, top_dir
from cargohold.storage import in_parallel, resolve


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "url,name",
    [
        ("https://a.b/c/def.jpg", "def.jpg"),
        ("https://a.b/c/def.jpg?x=/y#z/w", "def.jpg"),
        ("https://a.b/en/853/", "853"),
        ("https://a.b", ""),
        ("https://a.b/", ""),
        ("https://a.b/%20x", "%20x"),
        ("not a url", None),
    ],
)
def test_url_filename(spark, url, name):
    assert one(spark, P.url_filename(F.lit(url))) == name


@pytest.mark.parametrize(
    "dest,want",
    [
        ("/r/t/train/images-original/abc/abcd.jpg", "/r/t/train/small/abc/abcd.png"),
        ("/r/t/train/images-original/abc/abcd.JPG", "/r/t/train/small/abc/abcd.JPG.png"),
        ("/r/t/train/images-original/abc/abcd", "/r/t/train/small/abc/abcd.png"),
    ],
)
def test_resized_path(spark, dest, want):
    assert one(spark, P.resized_path(F.lit(dest), "small", "png")) == want


def test_choose_url(spark):
    for thumb, small, want in [("t", True, "t"), ("", True, "o"), (None, True, "o"), ("t", False, "o")]:
        assert one(spark, P.choose_url(F.lit("o"), F.lit(thumb), small)) == want


def test_text(spark):
    assert one(spark, X.csv_quote(F.lit('a "q" b'))) == '"a ""q"" b"'
    assert one(spark, X.parent_dir(F.lit("a/b/c.csv"))) == "a/b"
    assert one(spark, X.parent_dir(F.lit("c.csv"))) == ""
    assert one(spark, X.dehexify(F.lit("00ff"))) == bytearray(b"\x00\xff")
    assert one(spark, X.md5_b64_to_hex(F.lit(base64.b64encode(b"\x00" * 15 + b"\xab").decode()))) == "00" * 15 + "ab"
    assert one(spark, X.md5_b64_to_hex(F.lit("***"))) is None
    assert one(spark, X.utf8(F.lit(bytearray(b"a\xff")))) == "a�"


def test_digest_known_answers(spark):
    assert one(spark, D.digest(F.lit("abc"), "MD2")) == "da853b0d3f88d99b30283a69e6ded6bb"
    for name in ("MD5", "SHA-1", "SHA-256", "SHA-384", "SHA-512"):
        want = hashlib.new(name.replace("SHA-", "sha"), b"abc").hexdigest()
        assert one(spark, D.digest(F.lit("abc"), name)) == want
    with pytest.raises(ValueError):
        D.digest(F.lit("x"), "CRC")


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(max_rows=20)], ids=["whole", "sliced"])
@pytest.mark.parametrize("algorithm", ["MD5", "SHA-256"])
def test_digest_chunks(spark, policy, algorithm):
    rows = [(1 if i % 3 else i % 7, f"k{i % 2}", i, bytearray(b"%d," % i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, pos int, bytes binary").repartition(7)
    want = {}
    for a, b, _, data in rows:
        want[a, b] = want.get((a, b), b"") + data
    out = digest_chunks(df, ["a", "b"], ["pos"], "bytes", algorithm, policy).collect()
    got = {(r.a, r.b): (r.digest, r.n_bytes) for r in out}
    assert len(out) == len(want)
    assert got == {k: (hashlib.new(algorithm.replace("SHA-", "sha"), v).hexdigest(), len(v)) for k, v in want.items()}
    keys = spark.createDataFrame([(1, "k0"), (99, "none")], "a int, b string")
    padded = {r.a: r.digest for r in with_empty(keys, spark.createDataFrame(out), ["a", "b"]).collect()}
    assert padded[99] == hashlib.md5(b"").hexdigest() and padded[1] == got[1, "k0"][0]


RESPONSE_CASES = [
    # url tail, size, b64?, status, type, length, body, error -> code, details
    ("abc.jpg", "3", True, 200, "image/jpeg", 3, b"abc", None, None, None),
    ("abc.jpg", "3", True, 200, "IMAGE/JPEG", 3, b"abc", None, None, None),
    ("ab", "3", True, 200, "image/jpeg", 3, b"abc", None, "BadPath", "no usable file name in url: https://h/ab"),
    ("abc.jpg", "x3", True, 200, "image/jpeg", 3, b"abc", None, "BadSize", "size is not a number: x3"),
    ("abc.jpg", "3", False, 200, "image/jpeg", 3, b"abc", None, "BadChecksumField", "checksum is not Base64: ***"),
    ("abc.jpg", "3", True, None, None, None, None, "reset", "RequestError", "request to https://h/abc.jpg failed: reset"),
    ("abc.jpg", "3", True, 200, "text/html", 3, b"abc", None, "ContentTypeNotJpeg", "https://h/abc.jpg"),
    ("abc.jpg", "3", True, 200, None, 3, b"abc", None, "ContentTypeNotJpeg", "https://h/abc.jpg"),
    ("abc.jpg", "3", True, 200, "image/jpeg", None, b"abc", None, "NoContentLength", "https://h/abc.jpg"),
    ("abc.jpg", "3", True, 200, "image/jpeg", 4, b"abcd", None, "InvalidSize",
     "https://h/abc.jpg: server size (4) doesn't match expected size (3)!"),
    ("abc.jpg", "3", True, 200, "image/jpeg", 3, b"abcd", None, "ImageUnknown", "body of 4 bytes is over the limit of 3"),
    ("abc.jpg", "3", True, 302, None, None, None, None, "Redirect", "photo is unavailable: https://h/abc.jpg"),
    ("abc.jpg", "3", True, 404, None, None, b"gone\xff", None, "RequestFailed",
     "http request to https://h/abc.jpg failed: gone�"),
    ("abc.jpg", "3", True, 204, None, None, b"z" * (1024 * 1024 + 1), None, "RequestFailed",
     "http request to https://h/abc.jpg failed: "),
    ("abc.jpg", "3", True, 200, "image/jpeg", 3, b"abd", None, "MD5SumMismatch", "md5 sum mismatch"),
]


def image_rows(spark, cases):
    md5 = base64.b64encode(hashlib.md5(b"abc").digest()).decode()
    rows = []
    for i, (tail, size, good, status, kind, length, body, error, *_) in enumerate(cases):
        line = [str(i), "train", f"https://h/{tail}", "", "", "", "", "", size, md5 if good else "***", ""]
        rows.append((*line, status, kind, length, None, body and bytearray(body), error))
    schema = ", ".join(f"{c} string" for c in IMAGE_LIST_COLUMNS)
    schema += ", status int, content_type string, content_length bigint, location string, body binary, transport_error string"
    return P.download_params(spark.createDataFrame(rows, schema), JobConfig(root="/r"), "top")


def test_classification(spark):
    df = image_rows(spark, RESPONSE_CASES)
    out = classify.verify_digest(classify.classify_response(df), F.md5("body")).collect()
    got = {int(r.ImageID): (r.failure_code, r.failure_details) for r in out}
    assert got == {i: case[-2:] for i, case in enumerate(RESPONSE_CASES)}
    good = [r for r in out if r.ImageID == "0"][0]
    assert good.dest_path == "/r/top/train/images-original/abc/abc.jpg" and good.expected_size == 3


def test_small_images_skip_size_and_digest(spark):
    df = image_rows(spark, RESPONSE_CASES)
    out = classify.verify_digest(classify.classify_response(df, True), F.md5("body"), True).collect()
    codes = {int(r.ImageID): r.failure_code for r in out}
    assert all(codes[i] is None for i in (0, 4, 9, 10, 14)) and codes[6] == "ContentTypeNotJpeg"


def test_io_error_and_unavailable(spark):
    df = image_rows(spark, RESPONSE_CASES[:1]).withColumn("io", F.lit("disk full"))
    out = classify.verify_digest(classify.classify_response(df), F.md5("body"), io_error="io")
    assert [(r.failure_code, r.failure_details) for r in out.collect()] == [("ImageIO", "disk full")]
    assert audit.quarantine(out).count() == 1
    redirect = df.withColumn("status", F.lit(302))
    for path, want in [("photo_unavailable.png", True), ("photo_unavailable_l.png", True), ("other.png", False)]:
        moved = redirect.withColumn("location", F.lit(f"https://s/{path}?x"))
        assert moved.select(classify.is_unavailable_redirect()).first()[0] is want


def test_if_then_else_keeps_null_rows(spark):
    df = spark.createDataFrame([(False,), (True,), (None,)], "b boolean")
    out = if_then_else(
        df, F.col("b"), lambda d: d.withColumn("f", F.lit("true flow")), lambda d: d.withColumn("f", F.lit("false flow"))
    )
    assert sorted(r.f for r in out.collect()) == ["false flow", "false flow", "true flow"]
    seen = []
    tee(df, [lambda d: seen.append(d.count()), lambda d: seen.append(d.filter("b").count())])
    assert seen == [3, 1]


def test_plan_fetch(spark):
    folder = tempfile.mkdtemp(prefix="cargohold-test-")
    for name, data in [("same", b"abc"), ("other", b"abd"), ("long", b"abcd"), ("empty", b"")]:
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    names = ["same", "other", "long", "empty", "none"]
    md5 = hashlib.md5(b"abc").hexdigest()
    df = spark.createDataFrame([(f"{folder}/{n}", 3, md5) for n in names], "dest_path string, expected_size bigint, expected_md5 string")
    found = spark.createDataFrame(
        [(f"{folder}/{n}", s) for n, s in [("same", 3), ("other", 3), ("long", 4), ("empty", 0)]], "path string, length bigint"
    )
    want = {"same": "valid", "other": "md5", "long": "size", "empty": "size", "none": "missing"}
    for source in (None, found):
        out = audit.plan_fetch(df, source).collect()
        assert {os.path.basename(r.dest_path): r.reason for r in out} == want
        assert all(r.need_fetch == (r.reason != "valid") for r in out)
        loose = audit.plan_fetch(df, source, check_md5=False).collect()
        assert {os.path.basename(r.dest_path): r.need_fetch for r in loose}["other"] is False
        assert all(r.need_fetch for r in audit.plan_fetch(df, source, always=True).collect())
    listed = spark.createDataFrame([(n, 3, md5) for n in names], "name string, size bigint, md5_hex string")
    states = {r.name: r.state for r in audit.verify_artifacts(listed, folder=folder).collect()}
    assert states == {"same": "ok", "other": "md5_mismatch", "long": "size_mismatch", "empty": "size_mismatch", "none": "missing"}


def test_small_joins(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, error string")
    b = spark.createDataFrame([(1, None, "d"), (2, None, "d"), (4, "y", None)], "k int, error string, digest string")
    out = {r.k: r.error for r in audit.join_results(a, b, ["k"]).collect()}
    assert out == {1: None, 2: "x", 3: None, 4: "y"}
    assert [r.k for r in audit.not_done(a, b, ["k"]).collect()] == [3]
    urls = spark.createDataFrame([("https://a/x",), ("http://a/y",), ("https://b/z",), ("bad url",)], "url string")
    assert host_count(urls).first().n_hosts == 2


def test_fetch(spark):
    folder = tempfile.mkdtemp(prefix="cargohold-test-")
    for i in range(3):
        with open(f"{folder}/f{i}", "wb") as f:
            f.write(b"x" * (10 * (i + 1)))
    df = spark.createDataFrame([(f"https://h/f{i}", f"{folder}/out/f{i}") for i in range(4)], "url string, dest string")
    files = FT.FileFetcher("https://h/", folder)
    many = {r.url[-2:]: r.status for r in FT.fetch(df, "url", files, total=4, threads=3).collect()}
    assert many == {"f0": 200, "f1": 200, "f2": 200, "f3": 404}
    got = {r.url[-2:]: r for r in FT.fetch(df, "url", files, total=4, max_bytes=20).collect()}
    assert got["f0"].status == 200 and len(got["f0"].body) == 10 and got["f0"].content_length == 10
    assert got["f2"].size_limit_hit and got["f2"].body is None and got["f3"].status == 404
    saved = {r.url[-2:]: r for r in FT.fetch_to_store(df, "url", "dest", files, total=4).collect()}
    assert saved["f1"].md5 == hashlib.md5(b"x" * 20).hexdigest() and saved["f1"].bytes_written == 20
    assert saved["f3"].error == "RequestFailed: status 404"
    canned = spark.createDataFrame([("https://h/f0", 200, None)], "url string, status int, transport_error string")
    canned = canned.unionByName(canned)
    assert FT.fetch_table(df, canned).count() == 4
    table = {r.url[-2:]: r.transport_error for r in FT.fetch_table(df, canned).collect()}
    assert table["f0"] is None and table["f1"] == "no response recorded"


class Flaky:
    """Fails a given number of times, counted in a folder."""

    def __init__(self, folder, failures):
        self.folder, self.failures = folder, failures

    def __call__(self, url):
        seen = len(os.listdir(self.folder))
        with open(f"{self.folder}/{seen}", "w"):
            pass
        if seen < self.failures:
            raise FT.TransportError("connection reset")
        return FT.Response(204)


@pytest.mark.parametrize("failures,retries,ok", [(2, 3, True), (3, 2, False)])
def test_fetch_retries(spark, failures, retries, ok):
    folder = tempfile.mkdtemp(prefix="cargohold-test-")
    df = spark.createDataFrame([("https://h/x",)], "url string")
    row = FT.fetch(df, "url", Flaky(folder, failures), retries=retries, total=1).first()
    assert row.attempts == (failures + 1 if ok else retries + 1)
    assert (row.status == 204) if ok else ("connection reset" in row.transport_error)


def test_http_fetcher_reports_a_refused_connection():
    with pytest.raises(FT.TransportError):
        FT.HttpFetcher(timeout=2)("http://127.0.0.1:9/x")
    result, error, attempts = FT.with_retries(FT.HttpFetcher(), "no url", 5, lambda r: r)
    assert result is None and "unknown url type" in error and attempts == 1


def test_in_parallel_keeps_order_and_bounds():
    running, most = [], []

    def call(i):
        running.append(i)
        most.append(len(running))
        time.sleep(0.001 * (i % 3))
        running.remove(i)
        return i

    assert list(in_parallel(call, ((i,) for i in range(50)), 4)) == list(range(50))
    assert max(most) <= 4


def test_resolve():
    assert resolve("file:/a/b")[1] == resolve("file:///a/b")[1] == resolve("/a/b")[1] == "/a/b"


def test_host_limit(spark):
    df = spark.range(3000).select(F.concat(F.lit("https://h"), F.col("id") % 3, F.lit("/"), "id").alias("url"))
    spread = FT.spread_by_host(df, "url", 5, 16)
    placed = spread.select(P.url_host(F.col("url")).alias("host"), F.spark_partition_id().alias("part"))
    parts = placed.groupBy("host").agg(F.count_distinct("part").alias("n"))
    assert all(1 < r.n <= 5 for r in parts.collect()) and spread.rdd.getNumPartitions() == 16


def test_pipe(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "k int, s string")
    out = {r.k: r for r in pipe_through(df, "s", "tr a-z A-Z").collect()}
    assert bytes(out[1].out) == b"ABC" and bytes(out[2].out) == b"" and out[3].out is None
    bad = {r.k: r for r in pipe_through(df, "s", ["sh", "-c", "echo oops >&2; exit 3"], stderr_cap=3).collect()}
    assert (bad[1].out, bad[1].exit_code, bad[1].stderr) == (None, 3, "oop")
    assert pipe_through(df, "s", ["no-such-command"]).first().exit_code == -1
    assert pipe_through(df, "s", ["sleep", "5"], timeout=0.2).first().exit_code == -1
    assert convert_command("FillCrop", 10, "jpg", 80)[-6:] == ["center", "-extent", "10x10", "-quality", "80", "jpg:-"]


def test_manifest(spark):
    assert manifest(spark).count() == 26
    assert [manifest(spark, v).count() for v in (1, 2, 3)] == [6, 10, 10]
    row = manifest(spark, 3).filter("role = 'images' AND kind = 'tar'").first()
    assert (row.name, row.size, row.top_dir) == ("images_2017_11.tar", 3362037760, "2017_11")
    with pytest.raises(ValueError):
        manifest(spark, 4)
    assert top_dir(1) == "images_2016_08"


def test_config():
    assert JobConfig().resize_box_size == 224
    for bad in ({"dataset_version": 4}, {"resize_mode": "x"}, {"max_total_connections": 100}, {"max_retries": 0}):
        with pytest.raises(ValueError):
            JobConfig(**bad)


@pytest.mark.parametrize(
    "mode,w,h,want",
    [
        ("ShrinkToFit", 400, 200, (100, 50, 0, 0, 100, 50)),
        ("ShrinkToFit", 40, 20, (40, 20, 0, 0, 40, 20)),
        ("ShrinkToFit", 1000, 1, (100, 1, 0, 0, 100, 1)),
        ("FillCrop", 400, 200, (200, 100, 50, 0, 100, 100)),
        ("FillCrop", 20, 40, (100, 200, 0, 50, 100, 100)),
        ("FillDistort", 33, 77, (100, 100, 0, 0, 100, 100)),
    ],
)
def test_resize_plan(spark, mode, w, h, want):
    row = images.resize_plan(spark.createDataFrame([(w, h)], "w int, h int"), "w", "h", mode, 100).first()
    assert tuple(row[c] for c in images.GEOMETRY) == want


def png_pixels(data):
    """Pixels of a PNG written without row filters."""
    w, h, kind = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), data[25]
    size = int.from_bytes(data[33:37], "big")
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8)
    return raw.reshape(h, -1)[:, 1:].reshape(h, w, {0: 1, 2: 3, 6: 4}[kind])


def test_resize_images(spark):
    folder = tempfile.mkdtemp(prefix="cargohold-test-")
    rng = np.random.default_rng(3)
    originals = {}
    for i, (h, w, c) in enumerate([(40, 60, 3), (64, 32, 1), (8, 8, 3), (30, 30, 4)]):
        originals[f"{folder}/i{i}.png"] = pixels = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        with open(f"{folder}/i{i}.png", "wb") as f:
            f.write(images.encode_png(pixels))
    with open(f"{folder}/bad.png", "wb") as f:
        f.write(b"no image")
    decoded = images.with_orientation(images.decode_images(spark, folder))
    assert decoded.count() == 5
    for mode in ("ShrinkToFit", "FillCrop", "FillDistort"):
        out = {r.path: r for r in images.resize_images(decoded, mode, 16).collect()}
        assert out[f"{folder}/bad.png"].error and out[f"{folder}/bad.png"].resized is None
        for path, pixels in originals.items():
            got = png_pixels(bytes(out[path].resized))
            h, w, c = pixels.shape
            if mode == "FillDistort" or (mode == "ShrinkToFit" and (h, w) == (8, 8)):
                assert got.shape[:2] == ((16, 16) if mode == "FillDistort" else (8, 8))
            if (h, w) == (64, 32) and mode == "ShrinkToFit":
                block = pixels.astype(float).reshape(16, 4, 8, 4, c).mean(axis=(1, 3))
                assert np.array_equal(got, np.floor(block + 0.5).astype(np.uint8))
            if (h, w) == (8, 8) and mode == "ShrinkToFit":
                assert np.array_equal(got, pixels)
    with pytest.raises(ValueError):
        images.resize_images(decoded, "FillCrop", 16, "jpg")


def test_decode_files_gives_what_the_image_source_gives(spark):
    folder = tempfile.mkdtemp(prefix="cargohold-test-")
    rng = np.random.default_rng(5)
    good = [images.encode_png(rng.integers(0, 256, shape, dtype=np.uint8)) for shape in [(40, 60, 3), (64, 32, 1), (1, 1, 1), (30, 31, 4)]]
    text = good[0][:-12] + b"\0\0\0\1tEXtx" + zlib.crc32(b"tEXtx").to_bytes(4, "big") + good[0][-12:]
    bad = [b"", b"no image", good[0][:100], good[1][:-20] + b"\1" * 20, text]
    for i, data in enumerate(good + bad):
        with open(f"{folder}/{i}.png", "wb") as f:
            f.write(data)
    named = spark.createDataFrame([(f"{folder}/{i}.png",) for i in range(len(good + bad))] + [(f"{folder}/none.png",), (None,)], "path string")
    decoded = images.decode_files(named)
    assert decoded.columns == images.decode_images(spark, folder).columns
    found = {r.path: r for r in decoded.collect()}
    assert len(found) == len(good + bad) + 2
    listed = {r.path: r for r in images.decode_images(spark, folder).collect()}
    for i in range(len(good)):
        assert found[f"{folder}/{i}.png"] == listed[f"{folder}/{i}.png"]
    for path in set(found) - {f"{folder}/{i}.png" for i in range(len(good))}:
        assert found[path].error.startswith("cannot decode image") and found[path].width == -1
    assert all(r.resized is None for r in images.resize_images(decoded.filter("error is not null"), "FillCrop", 16).collect())


@pytest.mark.parametrize("name", ["resize_images_shrink", "resize_images_crop", "resize_images_distort"])
def test_resizing_takes_as_many_tasks_for_many_files_as_for_few(spark, tmp_path, name):
    rows = [(i, "x" * i) for i in range(1, 131)] + [(7, "y")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    jobs, context = name, spark.sparkContext
    context.setJobGroup(jobs, name)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "8m")  # two files to a task of the image source
        got = catalog.all_queries()[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(size, before)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.page_id for r in got) == list(range(1, 131))
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(jobs) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 2 * context.defaultParallelism


def test_area_average_against_brute_force():
    rng = np.random.default_rng(5)
    a = rng.random((13, 1))
    for n in (1, 2, 5, 12):
        want = []
        for i in range(n):
            lo, hi = i * 13 / n, (i + 1) * 13 / n
            parts = [max(0.0, min(hi, j + 1) - max(lo, j)) for j in range(13)]
            want.append(sum(p * a[j, 0] for j, p in enumerate(parts)) / (hi - lo))
        assert np.allclose(images._axis_area(a, n)[:, 0], want)


def test_orientation():
    grid = np.arange(6).reshape(2, 3, 1)
    # Row and column that the first stored row and column stand for, by tag.
    upright = {1: grid, 2: grid[:, ::-1], 3: grid[::-1, ::-1], 4: grid[::-1]}
    for tag, want in upright.items():
        assert np.array_equal(images.orient(grid, tag), want)
    assert images.orient(grid, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    assert images.orient(grid, 8)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert images.orient(grid, 5)[:, :, 0].tolist() == [[0, 3], [1, 4], [2, 5]]
    assert images.orient(grid, 7)[:, :, 0].tolist() == [[5, 2], [4, 1], [3, 0]]
    tiff = b"MM\0*\0\0\0\x08" + b"\0\x01" + b"\x01\x12\0\x03\0\0\0\x01\0\x06\0\0" + b"\0\0\0\0"
    app1 = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(app1) + 2).to_bytes(2, "big") + app1 + b"\xff\xda"
    assert images.exif_orientation(jpeg) == 6 and images.exif_orientation(b"\x89PNG") == 1


class _Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_orientation_behind_large_segments():
    tiff = b"II*\0\x08\0\0\0" + b"\1\0" + b"\x12\1\3\0\1\0\0\0\x08\0\0\0" + b"\0\0\0\0"
    app1 = b"Exif\0\0" + tiff
    big = b"".join(b"\xff" + bytes([0xE2]) + (60_002).to_bytes(2, "big") + b"\xff\xda" * 30_000 for _ in range(6))
    tail = b"\xff\xda" + b"x" * 500_000
    found = b"\xff\xff\xff\xe1" + (len(app1) + 2).to_bytes(2, "big") + app1
    stream = _Counted(b"\xff\xd8" + big + found + tail)
    assert images.exif_orientation(stream) == 8 and stream.taken < 4096
    for data in (b"", b"\xff\xd8", b"\xff\xd8\xff", b"\xff\xd8" + big, b"\xff\xd8" + tail + found, b"\xff\xd8\xff\xe1\0\0", b"\xff\xd8\xff\xe1\0\x09Exif\0\0M"):
        assert images.exif_orientation(data) == 1


def test_resize_payloads_without_the_command(spark):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, None)], "k int, b binary")
    out = {r.k: r for r in images.resize_payloads(df, "b", "FillCrop", 8).collect()}
    assert out[1].resize_error.startswith("resize failed") and out[2].resize_error is None
    done = {r.k: r for r in images.resize_payloads(df, "b", "FillCrop", 8, resizer=lambda b: b + b"!").collect()}
    assert bytes(done[1].resized) == b"x!" and done[2].resized is None


def test_pipe_outputs_leave_in_groups():
    class Frame:
        schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    batch = pa.record_batch([pa.array(range(12)), pa.array([None if i == 3 else "x" * 3_000_000 for i in range(12)])], names=["k", "s"])
    found = list(pipe_through(Frame(), "s", "cat")(iter([batch])))
    assert len(found) >= 4 and max(b.column("out").nbytes for b in found) < 16_000_000
    cells = [r for b in found for r in b.to_pylist()]
    assert [r["k"] for r in cells] == list(range(12))
    assert [r["out"] and len(r["out"]) for r in cells] == [None if i == 3 else 3_000_000 for i in range(12)]


def test_stored_stages_bound_the_batches_of_their_workers(spark, tmp_path):
    df = spark.range(0, 2000, 1, 1).select(F.expr("repeat(cast(id % 10 as string), 20000)").alias("s"))
    sizes = df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = [r.n for r in spool(sizes, f"{tmp_path}/sizes").collect()]
    assert sum(found) > 39_000_000 and max(found) < 9_000_000
    assert spark.conf.get(name) == before
