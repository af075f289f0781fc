"""Payloads through an external command."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cargohold.config import RESIZE_MODES
from cargohold.storage import payload_batches, with_columns

STDERR_CAP = 1024 * 1024


def run_command(argv: list[str], payload: bytes, stderr_cap: int, timeout: float | None) -> tuple:
    """(stdout, exit code, stderr); stdout only on success."""
    try:
        done = subprocess.run(argv, input=payload, capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return None, -1, f"timed out after {timeout} s"
    except OSError as exc:
        return None, -1, str(exc)
    if done.returncode:
        return None, done.returncode, done.stderr[:stderr_cap].decode("utf-8", "replace")
    return done.stdout, 0, None


def pipe_through(
    df: DataFrame,
    col: str,
    argv: list[str] | str,
    stderr_cap: int = STDERR_CAP,
    timeout: float | None = None,
    out: str = "out",
) -> DataFrame:
    """Feed each payload to one run of the command: adds `out`, `exit_code` and `stderr`.

    No shell is involved; a text command is split at white space. A failing command is an error of
    its row. NULL payloads are skipped.
    """
    command = argv.split() if isinstance(argv, str) else list(argv)
    schema = with_columns(
        df.schema,
        T.StructField(out, T.BinaryType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("stderr", T.StringType()),
    )

    fields = {out: pa.binary(), "exit_code": pa.int32(), "stderr": pa.string()}

    def cells(column: pa.Array) -> Iterator[tuple]:
        for cell in column:
            value = cell.as_py()
            payload = value.encode() if isinstance(value, str) else value
            yield (None, None, None) if payload is None else run_command(command, payload, stderr_cap, timeout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One payload at a time; outputs leave in groups, not with the last row of the batch.
            yield from payload_batches(batch, fields, cells(batch.column(batch.schema.get_field_index(col))))

    return df.mapInArrow(run, schema)


def convert_command(mode: str, box: int, output_format: str, quality: int | None = None) -> list[str]:
    """Argument list of the image converter for a resize mode."""
    # Geometry flags of the converter.
    geometry = {
        "ShrinkToFit": ["-thumbnail", f"{box}x{box}>"],
        "FillCrop": ["-thumbnail", f"{box}x{box}^", "-gravity", "center", "-extent", f"{box}x{box}"],
        "FillDistort": ["-thumbnail", f"{box}x{box}!"],
    }
    if mode not in RESIZE_MODES:
        raise ValueError(f"mode must be one of {RESIZE_MODES}")
    encoding = [] if quality is None else ["-quality", str(quality)]
    hint = ["-define", f"jpeg:size={2 * box}x{2 * box}"]
    return ["convert", *hint, "-", "-auto-orient", *geometry[mode], *encoding, f"{output_format}:-"]
