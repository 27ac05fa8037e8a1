"""Hourly tick archives: LZMA files of 20-byte big-endian records.

``TickArchives`` is a data source whose partitions are days of one symbol; hours that are absent are
skipped, and filters on symbol and time leave out files before any is opened.
"""

from __future__ import annotations

import lzma
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from tapeworks.schemas import TICK_DDL

# Record layout (ms, ask points, bid points, ask volume, bid volume), points per unit.
RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("av", ">f4"), ("bv", ">f4")])
POINTS = 100_000.0


def decode(content: bytes, hour: datetime) -> pd.DataFrame:
    """Ticks of one hourly file; empty content gives no rows, a torn record is an error."""
    raw = lzma.decompress(content) if content else b""
    if len(raw) % RECORD.itemsize:
        raise ValueError(f"{len(raw)} bytes is not a whole number of tick records")
    r = np.frombuffer(raw, RECORD)
    start = pd.Timestamp(hour).tz_convert(UTC).tz_localize(None)
    return pd.DataFrame({
        "ts": start + pd.to_timedelta(r["ms"].astype("int64"), unit="ms"),
        "ask": r["ask"].astype(float) / POINTS, "bid": r["bid"].astype(float) / POINTS,
        "ask_vol": r["av"].astype(float), "bid_vol": r["bv"].astype(float),
    })


def encode(ticks: pd.DataFrame, hour: datetime) -> bytes:
    """The hourly file of ticks (ts, ask, bid, ask_vol, bid_vol); times are cut to milliseconds."""
    start = pd.Timestamp(hour).tz_convert(UTC).tz_localize(None)
    out = np.zeros(len(ticks), RECORD)
    out["ms"] = (ticks["ts"] - start) // pd.Timedelta(milliseconds=1)
    for name, col in (("ask", "ask"), ("bid", "bid")):
        out[name] = np.rint(ticks[col].to_numpy() * POINTS)
    out["av"], out["bv"] = ticks["ask_vol"], ticks["bid_vol"]
    return lzma.compress(out.tobytes(), format=lzma.FORMAT_ALONE, preset=1)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][\w+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", path)))
    return fs.LocalFileSystem(), path


_NAME = re.compile(r"([A-Za-z]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$")  # months count from 0


def write_tick_archives(ticks: DataFrame, root: str) -> int:
    """One file for each symbol and hour of ``ticks``; gives the number of files. A file appears whole:
    it is written beside its place and moved there."""
    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        system, base = _file_system(root)
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        hours = pdf.groupby("hour")
        for second, own in hours:
            at = datetime.fromtimestamp(int(second), UTC)
            folder = f"{base}/{key[0]}/{at.year}/{at.month - 1:02}/{at.day:02}"
            system.create_dir(folder)
            part = f"{folder}/{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(encode(own, at))
            system.move(part, f"{folder}/{at.hour:02}h_ticks.bi5")
        return pd.DataFrame({"files": [hours.ngroups]})

    rows = ticks.withColumns({"hour": F.unix_seconds(F.date_trunc("hour", "ts")), "day": F.unix_date(F.to_date("ts"))})
    return rows.groupBy("symbol", "day").applyInPandas(save, "files INT").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


@dataclass
class _Day(InputPartition):
    symbol: str
    files: list[tuple[str, datetime]]


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.symbols: set[str] | None = None
        self.low, self.high = datetime.min.replace(tzinfo=UTC), datetime.max.replace(tzinfo=UTC)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Symbols are decided here; times only choose hours, so Spark checks them again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = own if self.symbols is None else self.symbols & own
                continue
            if column == ("ts",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo):
                at = f.value if f.value.tzinfo else f.value.astimezone(UTC)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, at - timedelta(hours=1))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = min(self.high, at)
            yield f

    def partitions(self) -> list[_Day]:
        system, base = _file_system(self.root)
        days: dict[tuple, list] = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            m = _NAME.search(info.path)
            if m and (self.symbols is None or m[1] in self.symbols):
                y, mo, d, h = map(int, m.groups()[1:])
                hour = datetime(y, mo + 1, d, h, tzinfo=UTC)
                if self.low < hour <= self.high:
                    days.setdefault((m[1], y, mo, d), []).append((info.path, hour))
        return [_Day(symbol, sorted(files, key=lambda f: f[1])) for (symbol, *_), files in sorted(days.items())]

    def read(self, partition: _Day | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _file_system(self.root)
        for path, hour in partition.files:
            with system.open_input_file(path) as f:
                t = decode(f.read(), hour)
            seq = int(hour.timestamp()) * 10_000_000 + np.arange(len(t))
            yield pa.RecordBatch.from_arrays([
                pa.array([partition.symbol] * len(t), pa.string()), pa.array(t["ts"], pa.timestamp("us")).cast(pa.timestamp("us", "UTC")), pa.array(seq),
                *(pa.array(t[c], pa.float64()) for c in ("ask", "bid", "ask_vol", "bid_vol")),
            ], ["symbol", "ts", "seq", "ask", "bid", "ask_vol", "bid_vol"])


class TickArchives(DataSource):
    """``spark.read.format("tick_archives").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "tick_archives"

    def schema(self) -> str:
        return TICK_DDL

    def reader(self, schema) -> _Reader:  # noqa: ARG002
        return _Reader(self.options["path"])


def tick_archives(spark: SparkSession, root: str) -> DataFrame:
    """Ticks of ``<symbol>/<year>/<month>/<day>/<hour>h_ticks.bi5`` files, a task for each symbol and day."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TickArchives)
    return spark.read.format("tick_archives").load(root)


def read_tick_archives(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of all ``<symbol>/<year>/<month>/<day>/<hour>h_ticks.bi5`` files under ``path``.

    Months in paths count from 0. Files decode in parallel, one at a time per task; ``seq``
    keeps the order of records inside a file behind the file's hour.
    """
    tail = r"([A-Za-z]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$"
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bi5")
        .option("recursiveFileLookup", "true").load(path)
    )
    parts = [F.regexp_extract("path", tail, i) for i in range(1, 6)]
    hour = F.make_timestamp(
        parts[1].cast("int"), parts[2].cast("int") + 1, parts[3].cast("int"), parts[4].cast("int"),
        F.lit(0), F.lit(0))
    src = files.select(parts[0].alias("symbol"), F.unix_seconds(hour).alias("hour"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for symbol, hour_s, content in zip(pdf["symbol"], pdf["hour"], pdf["content"]):
                t = decode(content, datetime.fromtimestamp(hour_s, UTC))
                seq = hour_s * 10_000_000 + np.arange(len(t))
                yield t.assign(symbol=symbol, seq=seq)[
                    ["symbol", "ts", "seq", "ask", "bid", "ask_vol", "bid_vol"]]

    return src.mapInPandas(run, TICK_DDL)
