import gzip
import io
import os
import tarfile
import tempfile

import pytest
from pyspark.sql import functions as F

from cargohold.operators.aggregate import JobFailed, assert_no_failures, entry_size_errors
from cargohold.sinks.files import cached_stage, copy_files, extract_tar, spool, write_files
from cargohold.sources import tar as TAR
from cargohold.sources.files import gunzip, gunzip_files, listing, scan_files

SIZES = [0, 1, 511, 512, 513, 1024, 5000]


def content(i, size):
    return bytes((i * 7 + j) % 256 for j in range(size))


def make_tar(path, fmt=tarfile.USTAR_FORMAT, names=None):
    with tarfile.open(path, "w", format=fmt) as archive:
        folder = tarfile.TarInfo("data/")
        folder.type = tarfile.DIRTYPE
        archive.addfile(folder)
        for i, size in enumerate(SIZES):
            info = tarfile.TarInfo((names or {}).get(i, f"data/f{i}.bin"))
            info.size = size
            archive.addfile(info, io.BytesIO(content(i, size)))


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="cargohold-test-")


@pytest.mark.parametrize("fmt", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar_chunks_and_entries(spark, folder, fmt):
    long_name = "data/" + "x" * 150 + "é.bin"
    names = {} if fmt == tarfile.USTAR_FORMAT else {3: long_name}
    make_tar(f"{folder}/a.tar", fmt, names)
    make_tar(f"{folder}/b.tar", fmt, names)
    index = TAR.tar_index(spark, folder)
    assert index.count() == 2 * (len(SIZES) + 1)
    for size, window in ((512, 512), (1024, 2048), (512, 64 * 1024 * 1024)):
        rows = TAR.tar_chunks(index, size, window).collect()
        for name in ("a.tar", "b.tar"):
            mine = [r for r in rows if r.archive.endswith(name)]
            for i, length in enumerate(SIZES):
                got = sorted((r for r in mine if r.entry_name == names.get(i, f"data/f{i}.bin")), key=lambda r: r.chunk_pos)
                assert b"".join(r.bytes for r in got) == content(i, length)
                assert [r.chunk_pos for r in got] == list(range(max(1, -(-length // size))))
                assert [r.first for r in got] == [True] + [False] * (len(got) - 1)
                assert [r.last for r in got] == [False] * (len(got) - 1) + [True]
            folders = [r for r in mine if r.entry_type == "directory"]
            assert [(bytes(r.bytes), r.first, r.last) for r in folders] == [(b"", True, True)]
    whole = {(r.archive[-5:], r.entry_name): r for r in TAR.tar_entries(index, 1024).collect()}
    assert bytes(whole["a.tar", "data/f4.bin"].bytes) == content(4, 513)
    assert (whole["b.tar", "data/f6.bin"].bytes, whole["b.tar", "data/f6.bin"].error) == (None, "EntryTooLarge")
    chunks = TAR.tar_chunks(index)
    assert entry_size_errors(chunks, ["archive", "entry_name"], "entry_size", "bytes").count() == 0


@pytest.mark.parametrize("damage,code", [("checksum", "InvalidChecksum"), ("truncated", "Truncated"), ("eof", "NoEOF"), ("record", "InvalidRecordSize")])
def test_tar_errors(spark, folder, damage, code):
    make_tar(f"{folder}/a.tar")
    data = bytearray(open(f"{folder}/a.tar", "rb").read())
    used = 512 * (1 + sum(1 + -(-s // 512) for s in SIZES))
    if damage == "checksum":
        data[512 * 2 + 3] ^= 0xFF
    elif damage == "truncated":
        data = data[: used - 1024]
    elif damage == "eof":
        data = data[:used]
    else:
        data = data[: used + 100]
    with open(f"{folder}/a.tar", "wb") as f:
        f.write(data)
    bad = TAR.tar_index(spark, folder, "PERMISSIVE").filter("error IS NOT NULL").collect()
    assert [r.error for r in bad] == [code]
    with pytest.raises(Exception, match=code):
        TAR.tar_index(spark, folder).collect()


def test_extract(spark, folder):
    os.mkdir(f"{folder}/in")
    make_tar(f"{folder}/in/a.tar", names={5: "../outside.bin"})
    index = TAR.tar_index(spark, f"{folder}/in")
    first = extract_tar(index, f"{folder}/out").collect()
    bad = [r for r in first if r.error]
    assert [r.error for r in bad] == ["UnsafePath: ../outside.bin"]
    assert not os.path.exists(f"{folder}/outside.bin")
    for i, size in enumerate(SIZES):
        if i != 5:
            assert open(f"{folder}/out/data/f{i}.bin", "rb").read() == content(i, size)
    with open(f"{folder}/out/data/f6.bin", "wb") as f:
        f.write(b"short")
    again = {r.entry_name: r for r in extract_tar(index, f"{folder}/out").collect()}
    assert again["data/f4.bin"].skipped and not again["data/f6.bin"].skipped
    assert open(f"{folder}/out/data/f6.bin", "rb").read() == content(6, 5000)
    with pytest.raises(JobFailed, match="UnsafePath"):
        assert_no_failures(extract_tar(index, f"{folder}/out"), order_by="entry_ord")
    assert assert_no_failures(extract_tar(index.filter("entry_name NOT LIKE '..%'"), f"{folder}/out")) == len(SIZES)


def test_gunzip(spark, folder):
    good = gzip.compress(b"hello " * 1000) + gzip.compress(b"world")
    rows = [(0, bytearray(good)), (1, bytearray(good[:40])), (2, bytearray(b"junk")), (3, None), (4, bytearray(gzip.compress(b"")))]
    out = {r.k: r for r in gunzip(spark.createDataFrame(rows, "k int, b binary"), "b").collect()}
    assert bytes(out[0].b) == b"hello " * 1000 + b"world" and out[0].error is None
    assert out[1].b is None and out[1].error and out[2].error
    assert out[3].b is None and out[3].error is None and bytes(out[4].b) == b""
    with open(f"{folder}/x.gz", "wb") as f:
        f.write(good)
    files = spark.createDataFrame(
        [(f"{folder}/x.gz", f"{folder}/sub/x"), (f"{folder}/none.gz", f"{folder}/none")], "src string, dst string"
    )
    done = {r.src: r for r in gunzip_files(files, "src", "dst").collect()}
    assert done[f"{folder}/x.gz"].bytes_written == 6005 and done[f"{folder}/none.gz"].error
    assert os.listdir(f"{folder}/sub") == ["x"]


def test_write_scan_copy(spark, folder):
    rows = [(i, f"{folder}/p/{i % 2}/f{i}", bytearray(content(i, 100 * i))) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, path string, b binary")
    assert {r.k: r.bytes_written for r in write_files(df, "path", "b", ["k"]).collect()} == {i: 100 * i for i in range(5)}
    assert {r.path: r.length for r in listing(spark, f"{folder}/p").collect()} == {r[1]: len(r[2]) for r in rows}
    got = scan_files(spark, f"{folder}/p").select("content").collect()
    assert sorted(bytes(r.content) for r in got) == sorted(bytes(r[2]) for r in rows if r[2])
    copied = copy_files(df.withColumn("to", F.concat("path", F.lit(".copy"))).select("path", "to"), "path", "to")
    assert copied.filter("error IS NOT NULL").count() == 0
    assert open(f"{folder}/p/1/f3.copy", "rb").read() == content(3, 300)


def test_cached_stage_and_spool(spark, folder):
    built = []

    def build():
        built.append(1)
        return spark.range(100).select(F.lit("a").alias("b"))

    def hundred(df):
        return df.count() == 100

    path = f"{folder}/stage"
    assert cached_stage(spark, path, build, hundred).count() == 100 and len(built) == 1
    assert cached_stage(spark, path, build, hundred).count() == 100 and len(built) == 1
    assert cached_stage(spark, path, build, lambda df: False).count() == 100 and len(built) == 2
    assert cached_stage(spark, f"{folder}/other", build, keep="none").count() == 100
    assert cached_stage(spark, f"{folder}/other", build, keep="temporary").count() == 100
    assert not os.path.exists(f"{folder}/other")
    assert spool(spark.range(7)).count() == 7


def header(name, size=b"00000000000", kind=b"0"):
    block = bytearray(512)
    block[: len(name)] = name
    block[100:108], block[124 : 124 + len(size)], block[156:157], block[257:265] = b"0000644\0", size, kind, b"ustar\x0000"
    block[148:156] = b" " * 8
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


def extension(record):
    return header(b"pax", b"%011o" % len(record), b"x") + record.ljust(512, b"\0")


@pytest.mark.parametrize(
    "bad",
    [
        extension(b"0 a=b\n") + header(b"f"),
        extension(b"13 size=zzzz\n") + header(b"f"),
        header(b"f", b"\xff" * 12),
        header(b"pax", b"77777777777", b"x"),
        extension(b"99 path=x\n") + header(b"f"),
    ],
    ids=["zero record", "no number", "negative size", "huge extension", "long record"],
)
def test_damaged_headers_end_in_an_error_row(spark, folder, bad):
    good = header(b"one.txt", b"%011o" % 3) + b"abc".ljust(512, b"\0")
    with open(f"{folder}/a.tar", "wb") as f:
        f.write(good + bad + bytes(1024))
    open(f"{folder}/empty.tar", "wb").close()
    index = TAR.tar_index(spark, folder, "PERMISSIVE")
    rows = {(os.path.basename(r.archive), r.error) for r in index.collect()}
    assert rows == {("a.tar", None), ("a.tar", "InvalidHeader"), ("empty.tar", "NoEOF")}
    chunks = TAR.read_tar(spark, folder, mode="PERMISSIVE").collect()
    assert sorted(str(r.error) for r in chunks) == ["InvalidHeader", "NoEOF", "None"]
    assert sorted(str(r.error) for r in TAR.tar_entries(index).collect()) == ["InvalidHeader", "NoEOF", "None"]
    with pytest.raises(Exception, match="bad tar archive"):
        TAR.read_tar(spark, folder).collect()


def test_last_entry_of_a_name_and_links(spark, folder):
    os.makedirs(f"{folder}/in")
    with tarfile.open(f"{folder}/in/a.tar", "w") as archive:
        for i in range(30):
            info = tarfile.TarInfo("same.bin")
            info.size = 5
            archive.addfile(info, io.BytesIO(b"%05d" % i))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "same.bin"
        archive.addfile(link)
    rows = extract_tar(TAR.tar_index(spark, f"{folder}/in"), f"{folder}/out").collect()
    assert open(f"{folder}/out/same.bin", "rb").read() == b"00029"
    assert sorted((r.entry_name, r.error is None) for r in rows) == [("link", False), ("same.bin", True)]


def test_listing_has_empty_files(spark, folder):
    os.makedirs(f"{folder}/in/deep")
    for name, size in (("a", 0), ("deep/b", 3), ("_hidden", 1)):
        with open(f"{folder}/in/{name}", "wb") as f:
            f.write(b"x" * size)
    assert sorted(map(tuple, listing(spark, f"{folder}/in").collect())) == [(f"{folder}/in/a", 0), (f"{folder}/in/deep/b", 3)]
    assert listing(spark, f"{folder}/i*/deep").count() == 1
