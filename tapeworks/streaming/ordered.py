"""Keyed state that advances in event time, whatever order rows arrive in.

Rows wait in state, packed by (key, time bucket), until an event-time timer says that the watermark
passed them; then they are released bucket by bucket in time order. A bucket's rows are pieces under
numbers of their own: what waits is written once and not again with every piece that comes. Results
don't depend on how the input was cut into batches, and memory holds one bucket of one key. Rows behind the watermark
are late: Spark drops them before they get here (``live.TickJob`` takes late ticks as well).

The watermark moves with the data, so the last rows of a stream that ended wait for ever. A *beat* is a
row without payload that only moves the watermark; ``beat_source`` and ``send_beat`` make one from far ahead.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BEAT = "is_beat"
_US = 1_000_000


def _pack(rows: pd.DataFrame) -> bytes:
    table, out = pa.RecordBatch.from_pandas(rows, preserve_index=False), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_batch(table)
    return out.getvalue()


def _unpack(raw: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(pa.BufferReader(raw)) as r:
        return r.read_all().to_pandas()


class InOrder(StatefulProcessor):
    """Base of processors that need their rows in time order.

    Subclasses give ``STATE`` (DDL of one row), ``FIRST`` (its first value) and ``advance``. Rows of one
    instant are taken in the order of the columns ``ties``.
    """

    STATE = "n BIGINT"
    FIRST: tuple = (0,)
    ties: tuple[str, ...] = ()
    bucket_seconds = 86_400
    piece_rows = 50_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.STATE)
        self.waiting = handle.getMapState("waiting", "bucket BIGINT, piece BIGINT", "rows BINARY")
        self.pieces = handle.getValueState("pieces", "n BIGINT")

    def advance(self, key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        """The state after ordered rows (``event_us`` is their time in microseconds), and what they give."""
        raise NotImplementedError

    def _wake(self, us: int, now: int = -1) -> None:
        """One timer a key: at the earliest waiting row. Timers up to ``now`` are about to go."""
        at = -(-us // 1000)
        timers = [t for t in self.handle.listTimers() if t * 1000 > now]
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _hold(self, rows: pd.DataFrame, piece: int) -> None:
        bucket = rows["event_us"].to_numpy() // (self.bucket_seconds * _US)
        for b, part in rows.groupby(bucket):
            self.waiting.updateValue((int(b), piece), (_pack(part),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, known = None, self.pieces.get()
        piece, held, n = known[0] if known else 0, [], 0
        for pdf in rows:
            if BEAT in pdf:
                pdf = pdf[~pdf[BEAT].fillna(False).astype(bool)].drop(columns=BEAT)
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
                first = int(pdf["event_us"].min() if first is None else min(first, pdf["event_us"].min()))
            if n >= self.piece_rows:
                self._hold(pd.concat(held), piece)
                piece, held, n = piece + 1, [], 0
        if held:
            self._hold(pd.concat(held), piece)
            piece += 1
        if first is not None:
            self.pieces.update((piece,))
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = self.value.get()
        state = tuple(known) if known else self.FIRST
        ahead = None
        for b, pieces in itertools.groupby(sorted(self.waiting.keys()), key=lambda at: at[0]):
            if b * self.bucket_seconds * _US > now:
                ahead = b * self.bucket_seconds * _US  # as good as its first row
                break
            at = [(b, p) for _, p in pieces]
            rows = pd.concat([_unpack(bytes(self.waiting.getValue(x)[0])) for x in at], ignore_index=True)
            ripe = rows["event_us"] <= now
            if ripe.any():
                state, out = self.advance(key, state, rows[ripe].sort_values(["event_us", *self.ties], kind="stable", ignore_index=True))
                if len(out):
                    yield out
                for x in at:
                    self.waiting.removeKey(x)
                if not ripe.all():
                    self.waiting.updateValue(at[0], (_pack(rows[~ripe]),))
            if not ripe.all():
                ahead = int(rows.loc[~ripe, "event_us"].min())
                break
        self.value.update(state)
        if ahead is not None:
            self._wake(ahead, now)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], processor: InOrder, schema: str, *, delay: str = "0 seconds",
             beats: DataFrame | None = None) -> DataFrame:
    """Attach a processor to a stream with an event time ``ts``; ``delay`` is how late rows may come."""
    if beats is not None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != "ts"]
        stream = stream.withColumn(BEAT, F.lit(False)).unionByName(beats.select("ts", *empty, F.lit(True).alias(BEAT)))
    stream = stream.withWatermark("ts", delay).withColumn("event_us", F.unix_micros("ts"))
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def beat_source(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of beats from a folder."""
    spark.createDataFrame([], "ts TIMESTAMP").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("ts TIMESTAMP").parquet(folder)


def send_beat(spark: SparkSession, folder: str, ts: str = "2200-01-01 00:00:00") -> None:
    """Every row before ``ts`` is released when the stream goes on."""
    spark.sql(f"SELECT TIMESTAMP '{ts}' AS ts").write.mode("append").parquet(folder)
