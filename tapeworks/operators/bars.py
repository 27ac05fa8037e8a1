"""Ticks to bars, bar resampling and bar predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.timeexpr import bar_floor
from tapeworks.schemas import TIMEFRAME_MINUTES


def ticks_to_bars(ticks: DataFrame, minutes: int = 1, *, timeframe: str | None = None,
                  keys: tuple[str, ...] = ("symbol",), order: str = "seq") -> DataFrame:
    """Mid-price OHLC per (keys, interval).

    ``order`` is a bigint input position: open and close are the first and last tick in
    input order. A primitive ordering column keeps this a hash aggregate with map-side
    combine, so a hot symbol is reduced to one row per interval before the shuffle.
    """
    mid = (F.col("ask") + F.col("bid")) / 2
    o = F.col(order)
    bars = (
        ticks.groupBy(*keys, bar_floor(F.col("ts"), minutes).alias("ts"))
        .agg(
            F.min_by(mid, o).alias("open"),
            F.max(mid).alias("high"),
            F.min(mid).alias("low"),
            F.max_by(mid, o).alias("close"),
            F.sum((F.col("ask_vol") + F.col("bid_vol")) / 2).alias("volume"),
            F.max_by("bid", o).alias("bid"),
            F.max_by("ask", o).alias("ask"),
        )
        .withColumn("spread", F.col("ask") - F.col("bid"))
    )
    return bars.withColumn("timeframe", F.lit(timeframe or _label(minutes)))


def resample_bars(bars: DataFrame, minutes: int, *, timeframe: str | None = None,
                  keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars from finer ones; the interval must divide a day."""
    if minutes <= 0 or 1440 % minutes:
        raise ValueError(f"interval of {minutes} minutes does not divide a day")
    rows = bars.withColumn("_bucket", bar_floor(F.col("ts"), minutes))
    return _rollup(rows, list(keys)).withColumn("timeframe", F.lit(timeframe or _label(minutes)))


def _rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """OHLC of rows per (keys, _bucket)."""
    o = F.unix_micros("ts")
    out = rows.groupBy(*keys, "_bucket").agg(
        F.min_by("open", o).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", o).alias("close"),
        F.sum("volume").alias("volume"),
        F.max_by("bid", o).alias("bid"),
        F.max_by("ask", o).alias("ask"),
        F.max_by("spread", o).alias("last_spread"),
    ).withColumnRenamed("_bucket", "ts")
    quoted = F.col("ask").isNotNull() & F.col("bid").isNotNull()
    spread = F.when(quoted, F.col("ask") - F.col("bid")).otherwise(F.col("last_spread"))
    return out.withColumn("spread", spread).drop("last_spread").withColumn("source", F.lit("resampled"))


def resample_many(bars: DataFrame, timeframes: list[str], *,
                  keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One bar set at several timeframes, as one table with a timeframe column.

    Each row is tagged once per timeframe and combined map-side, so the input is read and
    shuffled once whatever the number of timeframes.
    """
    if any(1440 % TIMEFRAME_MINUTES[t] for t in timeframes):
        raise ValueError("an interval does not divide a day")
    tags = F.array(*[
        F.struct(F.lit(t).alias("tf"), F.lit(TIMEFRAME_MINUTES[t] * 60_000_000).cast("bigint").alias("us"))
        for t in timeframes])
    us = F.unix_micros("ts")
    rows = bars.drop("timeframe").withColumn("_t", F.explode(tags)).withColumns({
        "timeframe": F.col("_t.tf"),
        "_bucket": F.timestamp_micros(us - F.pmod(us, F.col("_t.us")))})
    return _rollup(rows, [*keys, "timeframe"])


def bar_valid() -> Column:
    """OHLC consistency and ask >= bid (missing quotes pass)."""
    lo, hi = F.col("low"), F.col("high")
    inside = (lo <= F.col("open")) & (F.col("open") <= hi) & (lo <= F.col("close")) & (
        F.col("close") <= hi
    )
    return F.coalesce(inside, F.lit(False)) & F.coalesce(F.col("ask") >= F.col("bid"), F.lit(True))


def between_ts(df: DataFrame, start, end, closed: str = "left") -> DataFrame:
    """[start, end) or, with closed='both', [start, end]."""
    if closed not in ("left", "both"):
        raise ValueError(closed)
    upper = F.col("ts") <= F.lit(end) if closed == "both" else F.col("ts") < F.lit(end)
    return df.where((F.col("ts") >= F.lit(start)) & upper)


def new_bars(bars: DataFrame, high_water: DataFrame,
             keys: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """Bars strictly later than each series' high-water mark (``hwm``)."""
    return (
        bars.join(high_water.select(*keys, "hwm"), list(keys), "left")
        .where(F.col("hwm").isNull() | (F.col("ts") > F.col("hwm")))
        .drop("hwm")
    )


def gap_windows(bars: DataFrame, minutes: int, now: Column,
                keys: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """Backfill request per series: (last + interval, now), only when non-empty."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    return (
        bars.groupBy(*keys).agg(F.max("ts").alias("last_ts"))
        .select(*keys, (F.col("last_ts") + step).alias("start"), now.alias("end"))
        .where(F.col("start") < F.col("end"))
    )


def merge_backfill(stream: DataFrame, fetched: DataFrame,
                   keys: tuple[str, ...] = ("symbol", "timeframe", "ts")) -> DataFrame:
    """Stream bars plus fetched bars that the stream does not hold and that are newer than
    its high-water mark."""
    series = [k for k in keys if k != "ts"]
    hwm = stream.groupBy(*series).agg(F.max("ts").alias("hwm"))
    fresh = new_bars(fetched, hwm, tuple(series)).join(
        stream.select(*keys), list(keys), "left_anti"
    )
    return stream.unionByName(fresh, allowMissingColumns=True)


def session_gate(ts: Column, london: bool = True, ny: bool = True) -> Column:
    """Entry hours: 7..12 UTC (London flag) or 13..20 UTC (New York flag)."""
    h = F.hour(ts)
    return (F.lit(london) & h.between(7, 12)) | (F.lit(ny) & h.between(13, 20))


def _label(minutes: int) -> str:
    for name, m in TIMEFRAME_MINUTES.items():
        if m == minutes:
            return name
    return f"{minutes}m"
