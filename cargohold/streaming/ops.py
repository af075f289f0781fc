"""Streaming operators. Routing, classification and planning against a static listing need no special
form: the batch functions take streaming DataFrames as they are."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import merge
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cargohold.sinks.results import write_results


#: Rows of a key that are sorted at a time; longer shares of a key are sorted in runs of that many, kept in state.
RUN_ROWS = 50_000
#: Rows of a stored run that are read back at a time.
BLOCK_ROWS = 1_000
_TIME, _MILLIS = "_time", "_millis"


def _position(row: Row, order_by: list[str]) -> tuple:
    """Sorts as Spark does: NULL first, NaN last."""
    values = [row[c] for c in order_by]
    return tuple((v is not None, v != v, None if v is None or v != v else v) for v in values)


def _same(a: object, b: object) -> bool:
    return a == b or (a is None and b is None) or (a is not None and b is not None and a != a and b != b)


class _Consecutive(StatefulProcessor):
    """Keeps the last row of a key, typed as the compared columns, and rows that wait in sorted runs of blocks.

    No more than RUN_ROWS rows and one block of each run are in memory: runs are merged as they are read.
    """

    def __init__(self, schema: T.StructType, cols: list[str], order_by: list[str], timed: bool):
        self.names, self.cols, self.order_by, self.timed = schema.fieldNames(), cols, order_by, timed
        self.kept = T.StructType([T.StructField(f"c{i}", schema[c].dataType, True) for i, c in enumerate(cols)])
        self.run_rows, self.block_rows = RUN_ROWS, BLOCK_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.kept)
        place = T.StructType([T.StructField("run", T.LongType()), T.StructField("block", T.LongType())])
        self.blocks = handle.getMapState("blocks", place, T.StructType([T.StructField("rows", T.BinaryType())]))
        self.runs = handle.getValueState("runs", T.StructType([T.StructField("first", T.LongType()), T.StructField("next", T.LongType())]))

    def _runs(self) -> tuple[int, int]:
        return tuple(self.runs.get()) if self.runs.exists() else (0, 0)

    def _store(self, run: int, rows: Iterator[tuple]) -> bool:
        """Write sorted rows as the blocks of a run; whether there were any."""
        block = 0
        while part := list(islice(rows, self.block_rows)):
            self.blocks.updateValue((run, block), (pickle.dumps([tuple(r) for r in part]),))
            block += 1
        return block > 0

    def _read(self, run: int) -> Iterator[Row]:
        """Rows of a run, block by block; a block is gone once it is read."""
        make, block = Row(*self.names), 0
        while self.blocks.containsKey((run, block)):
            held = pickle.loads(self.blocks.getValue((run, block))[0])
            self.blocks.removeKey((run, block))
            yield from (make(*values) for values in held)
            block += 1

    def _merged(self, runs: list[Iterator[Row]]) -> Iterator[Row]:
        key = lambda row: _position(row, self.order_by)
        return runs[0] if len(runs) == 1 else merge(*runs, key=key)

    def _unique(self, rows: Iterator[Row]) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for row in rows:
            now = tuple(row[c] for c in self.cols)
            if last is None or not all(map(_same, now, last)):
                yield row
            last = now
        if last is not None:
            self.last.update(last)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, following = self._runs()
        latest, held = None, []
        while part := list(islice(rows, self.run_rows)):
            part.sort(key=lambda row: _position(row, self.order_by))
            if self.timed:
                stamps = [r[_MILLIS] for r in part if r[_MILLIS] is not None]
                latest = max([*stamps, *([latest] if latest is not None else [])], default=None)
            if held:
                self._store(following, iter(held))
                following += 1
            held = part
        if not self.timed:
            yield from self._unique(self._merged([*[self._read(run) for run in range(first, following)], iter(held)]))
            return
        self._store(following, iter(held))
        self.runs.update((first, following + 1))
        if latest is not None:
            self.handle.registerTimer(latest + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Give out what the watermark has passed, in order; the rest becomes one run again."""
        passed = timerValues.getCurrentWatermarkInMs()
        first, following = self._runs()
        if first == following:
            return
        done = lambda row: row[_MILLIS] is None or row[_MILLIS] <= passed
        later: list[Row] = []
        kept = following

        def ripe() -> Iterator[Row]:
            nonlocal kept
            for row in self._merged([self._read(run) for run in range(first, following)]):
                if done(row):
                    yield row
                    continue
                later.append(row)
                if len(later) == self.run_rows:
                    self._store(kept, iter(later))
                    later.clear()
                    kept += 1

        yield from self._unique(ripe())
        if later:
            self._store(kept, iter(later))
            kept += 1
        self.runs.update((following, kept))

    def close(self) -> None:
        pass


def unique_consecutive_stream(
    df: DataFrame, cols: str | list[str], order_by: list[str], partition_by: list[str], watermark: tuple[str, str] | None = None
) -> DataFrame:
    """Drop rows whose `cols` (of any types) equal those of the row before in the key; NULLs and NaNs equal themselves.

    Without `watermark`, rows are ordered within a micro-batch, and across batches the order is that of the source.
    With `watermark` (a time column, which leads `order_by`, and a delay), rows wait in state until the watermark has
    passed their time and are then given out in order, whatever batch they came in; rows later than that are dropped,
    as by every operator on event time. Rows without a time leave with the next ones that do. A key's rows are sorted in
    runs and merged from the state, so a key may be larger than memory. Needs the RocksDB state store.
    """
    cols = [cols] if isinstance(cols, str) else cols
    if watermark is None:
        made = _Consecutive(df.schema, cols, order_by, False)
        return df.groupBy(*partition_by).transformWithState(made, outputStructType=df.schema, outputMode="append", timeMode="none")
    column, delay = watermark
    if order_by[0] != column:
        raise ValueError("order_by must begin with the watermark's column")
    timed = df.withColumn(_TIME, F.col(column).cast("timestamp")).withWatermark(_TIME, delay).withColumn(_MILLIS, F.unix_millis(_TIME))
    made = _Consecutive(timed.schema, cols, order_by, True)
    out = timed.groupBy(*partition_by).transformWithState(made, outputStructType=timed.schema, outputMode="append", timeMode="EventTime")
    return out.drop(_TIME, _MILLIS)


def stream_results(df: DataFrame, out: str, checkpoint: str, subsets: list[str] | None = None) -> DataStreamWriter:
    """Write classified rows to the success and failure tables, one folder per micro-batch.

    The batch id is part of the path and the write overwrites, so a batch that is run again after a
    failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_results(batch, f"{out}/batch={batch_id}", subsets)

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def stream_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Running row counts per key, for the report of a running stream (complete or update mode)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
