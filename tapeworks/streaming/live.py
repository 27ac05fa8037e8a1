"""Streaming bars, gap merging and the per-micro-batch signal job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.sources.tables import write_bars


def stream_bars(ticks: DataFrame, minutes: int, *, watermark: str = "10 minutes",
                pip_size: Column | None = None) -> DataFrame:
    """Tumbling bars per symbol from ticks (symbol, ts, price, bid, ask, volume).

    Event-time windows: a bar is final once the watermark passes its end; later ticks are
    dropped. Works unchanged on a batch frame.
    """
    pip = F.lit(0.1) if pip_size is None else pip_size
    at = F.unix_micros("ts")
    w = F.window("ts", f"{minutes} minutes")
    g = ticks.withWatermark("ts", watermark).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
        F.max_by("bid", at).alias("bid"), F.max_by("ask", at).alias("ask"))
    spread = F.col("ask") - F.col("bid")
    return g.select(
        "symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "bid", "ask",
        F.when(spread > 0, spread).otherwise(pip).alias("spread"))


def bar_sink(root: str, timeframe: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: upsert of finished bars, so replays and backfills do not duplicate."""

    def save(batch: DataFrame, epoch: int) -> None:  # noqa: ARG001
        write_bars(batch.withColumn("timeframe", F.lit(timeframe)), root, upsert=True)

    return save


@dataclass(frozen=True)
class TickJob:
    """foreachBatch body for ticks that may come at any time: bars are right after every batch.

    A batch's ticks are stored under its number, so a replay replaces them. The bars that they
    touch are built anew from all stored ticks of those days and upserted, late ones like others.
    """

    tick_root: str
    bar_root: str
    minutes: int
    timeframe: str

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark, cell = batch.sparkSession, F.window("ts", f"{self.minutes} minutes")["start"]
        ticks = batch.withColumn("day", F.to_date("ts"))
        path = f"{self.tick_root}/batch={epoch}"
        ticks.write.mode("overwrite").partitionBy("day").parquet(path)
        own = spark.read.schema(ticks.schema).parquet(path)
        touched = own.select("symbol", cell.alias("cell")).distinct()
        days = own.select("day").distinct().union(own.select(F.to_date(cell)).distinct()).union(
            own.select(F.to_date(cell + F.make_dt_interval(mins=F.lit(self.minutes - 1))))).distinct()
        known = spark.read.schema(ticks.schema).parquet(self.tick_root).join(F.broadcast(days), "day", "left_semi")  # a batch's few days
        known = known.withColumn("cell", cell).join(touched, ["symbol", "cell"], "left_semi").drop("cell", "day")
        bars = stream_bars(known, self.minutes).withColumn("timeframe", F.lit(self.timeframe))
        write_bars(bars, self.bar_root, upsert=True)


def signal_sink(score: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None],
                known: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch job: score the batch's closed bars, keep new signal ids, append them."""
    from tapeworks.operators.signal_store import insert_ignore

    def run(batch: DataFrame, epoch: int) -> None:  # noqa: ARG001
        append(insert_ignore(known(), score(batch)))

    return run


def alerts_once(alerts: DataFrame, *, ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """One alert per (symbol, direction, h4_ts) within the watermark."""
    return alerts.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["symbol", "direction", "h4_ts"])
