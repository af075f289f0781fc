"""The log of versions and the packed store."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cargohold.operators import audit, changes
from cargohold.config import JobConfig
from cargohold.plans import assets
from cargohold.plans.assets import ingest_images
from cargohold.schemas import FAILURE_COLUMNS, IMAGE_LIST_COLUMNS
from cargohold.sinks import packs
from cargohold.sinks.results import repair_headers
from cargohold.sources.fetch import FileFetcher
from cargohold.sources.image_list import read_image_list
from test_jobs import LIST_SCHEMA, SHORT, mini


def rows(spark, *cells):
    return spark.createDataFrame(list(cells), "path string, length long, md5 string, deleted boolean")


def state(spark, log, upto=None):
    return {r.path: (r.length, r.md5, r.version) for r in changes.state(spark, log, upto).collect()}


def test_versions_merge(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert changes.latest_version(spark, log) == -1 and state(spark, log) == {}
    assert changes.append(rows(spark, ("a", 1, "x", False), ("b", 2, "y", None), (None, 3, "z", False)), log) == 0
    assert changes.append(rows(spark, ("a", 5, "w", False), ("b", None, None, True)), log) == 1
    assert state(spark, log) == {"a": (5, "w", 1)}
    assert state(spark, log, 0) == {"a": (1, "x", 0), "b": (2, "y", 0)}
    assert changes.fold(spark, log) == 1 and changes.fold(spark, log) == 1
    assert state(spark, log) == {"a": (5, "w", 1)}
    changes.append(rows(spark, ("b", 7, "v", False)), log)
    assert state(spark, log) == {"a": (5, "w", 1), "b": (7, "v", 2)}
    assert {(r.path, r.deleted) for r in changes.changes(spark, log, 0, 1).collect()} == {("a", False), ("b", True)}
    # Behind a base no earlier version is opened.
    assert not [f for f in changes.state(spark, log).inputFiles() if "version=0" in f or "version=1" in f]


def test_ties_and_empty_versions(spark, tmp_path):
    log = f"{tmp_path}/log"
    changes.append(rows(spark, ("a", None, None, True), ("a", 3, "x", False), ("a", 2, "y", False), ("a", 3, "x", False)), log)
    assert state(spark, log) == {"a": (3, "x", 0)}
    assert changes.append(rows(spark, ("a", 1, "q", False)).limit(0), log) == 1
    assert state(spark, log) == {"a": (3, "x", 0)}


def test_a_broken_version_does_not_count(spark, tmp_path):
    log = f"{tmp_path}/log"
    changes.append(rows(spark, ("a", 1, "x", False)), log)
    os.makedirs(f"{log}/version=1")
    with open(f"{log}/version=1/part-0.parquet", "wb") as out:
        out.write(b"half")
    assert state(spark, log) == {"a": (1, "x", 0)}
    assert changes.append(rows(spark, ("a", 2, "y", False)), log) == 1
    assert state(spark, log) == {"a": (2, "y", 1)}


def test_replan_equals_a_whole_plan_and_runs_without_python(spark, tmp_path):
    log = f"{tmp_path}/log"
    changes.append(rows(spark, ("a", 1, "x", False), ("b", 2, "y", False), ("c", 3, "z", False)), log)
    cells = [("a", 1, "x"), ("a", 1, "q"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w"), (None, 1, "x"), ("c", None, None)]
    wanted = spark.createDataFrame(cells, "dest_path string, expected_size long, expected_md5 string")
    plan = audit.plan_fetch(wanted, changes.state(spark, log))
    changes.append(rows(spark, ("b", None, None, True), ("d", 4, "w", False), ("new", 1, "n", False)), log)
    more = wanted.union(spark.createDataFrame([("new", 1, "n"), ("c", 9, "z"), ("b", 2, "y")], wanted.schema))
    got = changes.replan(more, plan, log, 0)
    want = audit.plan_fetch(more, changes.state(spark, log))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString()


def payloads(spark, cells, parts=4):
    return spark.createDataFrame(cells, "name string, bytes binary").repartition(parts, "name")


def content(spark, store, upto=None):
    return {r.path: bytes(r.bytes) for r in packs.get(spark, store, upto).collect()}


def test_packs_hold_every_version(spark, tmp_path):
    store = f"{tmp_path}/store"
    cells = [(f"n{i}", bytes([i]) * i) for i in range(50)]
    packs.put(payloads(spark, cells), "name", "bytes", store)
    assert len(os.listdir(f"{store}/packs")) <= 4
    assert content(spark, store) == dict(cells)
    packs.put(payloads(spark, [("n1", b"other"), ("n2", None), ("n60", b"")]), "name", "bytes", store)
    now = {**dict(cells), "n1": b"other", "n60": b""}
    del now["n2"]
    assert content(spark, store) == now and content(spark, store, 0) == dict(cells)
    assert packs.get(spark, store).filter("path = 'n1'").select("version").first().version == 1


def test_packs_rotate_and_large_values_have_their_own(spark, tmp_path):
    store = f"{tmp_path}/store"
    cells = [("a", b"x" * 40), ("b", b"y" * 70), ("c", b"z" * 300), ("d", b"w" * 10)]
    packs.put(payloads(spark, cells, 1), "name", "bytes", store, pack_bytes=100)
    sizes = sorted(os.path.getsize(f"{store}/packs/{n}") for n in os.listdir(f"{store}/packs"))
    assert sum(sizes) == 420 and len(sizes) >= 3
    assert content(spark, store) == dict(cells)


def test_compact_swaps_and_vacuum_deletes(spark, tmp_path):
    store = f"{tmp_path}/store"
    cells = [(f"n{i}", os.urandom(100)) for i in range(40)]
    packs.put(payloads(spark, cells), "name", "bytes", store)
    old = set(os.listdir(f"{store}/packs"))
    packs.put(payloads(spark, [(n, None) for n, _ in cells[:30]]), "name", "bytes", store)
    assert {r.pack for r in packs.usage(spark, store).filter("live < size").collect()} == old
    packs.compact(spark, store)
    assert content(spark, store) == dict(cells[30:])
    # What a killed task has left is referred to by nothing.
    with open(f"{store}/packs/pack-orphan", "wb") as out:
        out.write(b"lost")
    kept = {r.pack for r in packs.entries(spark, store).collect()}
    gone = (old | {"pack-orphan"}) - kept
    assert packs.vacuum(spark, store) == len(gone) and set(os.listdir(f"{store}/packs")) == kept
    assert content(spark, store) == dict(cells[30:]) and packs.vacuum(spark, store) == 0


def test_damaged_packs_are_errors_and_stop_compaction(spark, tmp_path):
    store = f"{tmp_path}/store"
    packs.put(payloads(spark, [("a", b"x" * 10), ("b", b"y" * 10)], 1), "name", "bytes", store)
    name = os.listdir(f"{store}/packs")[0]
    with open(f"{store}/packs/{name}", "r+b") as out:
        out.truncate(15)
    errors = [r.error for r in packs.get(spark, store).orderBy("offset").collect()]
    assert errors == [None, "expected 10 bytes, got 5"]
    with pytest.raises(Exception, match="cannot compact"):
        packs.compact(spark, store, least=2)
    assert changes.latest_version(spark, f"{store}/log") == 0


def test_payloads_are_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = payloads(spark, [(f"n{i}", b"x") for i in range(20)]).mapInArrow(count, "name string, bytes binary")
    packs.put(df, "name", "bytes", f"{tmp_path}/store")
    assert seen.value == 20 and packs.entries(spark, f"{tmp_path}/store").filter(F.col("md5").isNull()).count() == 0


def test_headers_are_repaired_and_no_row_is_lost(spark, tmp_path):
    head = ",".join(IMAGE_LIST_COLUMNS)
    row = lambda i: f'{i},train,u,,l,,"a, b","t\nu",1,m,'
    old = ",".join("Checksum" if c == "OriginalMD5" else c for c in IMAGE_LIST_COLUMNS)
    texts = {
        "ok.csv": f"{head}\n{row(1)}\n", "bare.csv": f"{row(2)}\n{row(3)}\n", "empty.csv": "", "old.csv": f"{old}\r\n{row(4)}",
        "long.csv": f"{row(5)}\n" * 40_000, "other.csv": ",".join(reversed(IMAGE_LIST_COLUMNS)) + f"\n{row(6)}\n",
        "failure.csv": ",".join(FAILURE_COLUMNS) + f"\n{row(7)},why\n", "note.txt": "text", "headonly.csv": head,
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    done = {os.path.basename(r.path): (r.action, r.error) for r in repair_headers(spark, str(tmp_path), IMAGE_LIST_COLUMNS).collect()}
    assert done == {
        "ok.csv": ("ok", None), "bare.csv": ("added", None), "empty.csv": ("written", None), "old.csv": ("replaced", None), "long.csv": ("added", None),
        "other.csv": ("refused", "header in another order"), "failure.csv": ("refused", "header of 12 fields"), "headonly.csv": ("ok", None),
    }
    for name in ("other.csv", "failure.csv", "note.txt", "ok.csv"):
        assert (tmp_path / name).read_text(newline="") == texts[name]
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".") and not n.endswith(".crc")]
    files = [str(tmp_path / n) for n in ("ok.csv", "bare.csv", "empty.csv", "old.csv", "long.csv")]
    ids = Counter(r.ImageID for r in read_image_list(spark, files).select("ImageID").collect())
    assert ids == {"1": 1, "2": 1, "3": 1, "4": 1, "5": 40_000}
    again = {r.action for r in repair_headers(spark, files, IMAGE_LIST_COLUMNS).collect()}
    assert again == {"ok"}


def test_image_job_over_packs_resumes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    rows, codes = mini(folder)
    df = spark.createDataFrame(rows, LIST_SCHEMA)
    fetcher = FileFetcher("https://h.example.com/", f"{folder}/host")
    cfg = JobConfig(root=f"{folder}/root", **{**SHORT, "resize_images": False, "save_original_images": True, "packed": True})
    # The rows are stored, but the run ends before the log has them.
    with monkeypatch.context() as patch:
        patch.setattr(assets, "_log_packed", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest_images(df, cfg, "top", fetcher, results=f"{folder}/out")
    assert packs.entries(spark, assets.packed_store(cfg)).count() == 0
    got = ingest_images(df, cfg, "top", fetcher, results=f"{folder}/out").collect()
    assert {int(r.ImageID): r.failure_code for r in got} == {i: codes.get(i) for i in range(12)}
    held = content(spark, assets.packed_store(cfg))
    good = {r.dest_path: int(r.bytes_written) for r in got if r.failure_code is None}
    assert {p: len(b) for p, b in held.items()} == good
    # Everything is stored: a run of its own fetches only what failed, and a resizer is given the stored bytes.
    again = ingest_images(df, cfg, "top", fetcher, results=f"{folder}/again").collect()
    assert {int(r.ImageID) for r in again if not r.need_fetch} == {i for i in range(12) if i not in codes}
    resize = JobConfig(root=f"{folder}/root", **{**SHORT, "resize_images": True, "save_original_images": True, "packed": True, "resize_output_format": "txt"})
    made = ingest_images(df, resize, "top", fetcher, lambda image: b"small " + image, results=f"{folder}/resized").collect()
    for r in (r for r in made if r.failure_code is None):
        with open(r.resized_path, "rb") as stream:
            assert stream.read() == b"small " + held[r.dest_path]
    assert sum(r.failure_code is None for r in made) == len(good)
