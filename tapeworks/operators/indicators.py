"""Causal indicators over a Series. NULL marks warm-up everywhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.operators.carry import NOTHING, Chunk, Smoothing
from tapeworks.operators.series import Series

# --- recurrences: one vectorised pass per chunk, continued from exact states -----------------


def _true_range(c: Chunk) -> np.ndarray:
    h, low, pc = c["high"], c["low"], c.before("close")
    return np.fmax(h - low, np.fmax(np.abs(h - pc), np.abs(low - pc)))


@dataclass(frozen=True)
class Recurrence:
    """A named recurrence: output columns, its vectorised body, and how deep its smoothings are nested."""

    ddl: str
    body: Callable[[Chunk], dict[str, np.ndarray]]
    levels: int = 1


def _one(out: str, how: Smoothing, x: Callable[[Chunk], np.ndarray]) -> Recurrence:
    return Recurrence(f"`{out}` DOUBLE", lambda c: {out: c.smooth(x(c), how)})


def ema_mean_seeded(period: int, out: str, col: str = "close") -> Recurrence:
    return _one(out, Smoothing(2.0 / (period + 1), period, "mean"), lambda c: c[col])


def ema(period: int, out: str, col: str = "close") -> Recurrence:
    return _one(out, Smoothing(2.0 / (period + 1), period), lambda c: c[col])


def ema_mean_seeded_by(period_col: str, out: str, col: str = "close") -> Recurrence:
    """Mean-seeded EMA whose period is a column, constant within a series: parameter sweeps
    put the parameter set into the series keys."""

    def body(c: Chunk) -> dict[str, np.ndarray]:
        n = int(c.constant(period_col))
        return {out: c.smooth(c[col], Smoothing(2.0 / (n + 1), n, "mean"))}

    return Recurrence(f"`{out}` DOUBLE", body)


def rma(period: int, out: str, col: str = "close") -> Recurrence:
    return _one(out, Smoothing(1.0 / period, period, "mean"), lambda c: c[col])


def atr(period: int, out: str = "atr") -> Recurrence:
    return _one(out, Smoothing(1.0 / period, period, "mean"), _true_range)


def tsi(long: int = 25, short: int = 13, signal: int = 13, out: str = "tsi",
        line: str = "tsi_signal") -> Recurrence:
    """Doubly smoothed momentum over its doubly smoothed size; NULL where that has faded to nothing."""
    slow, fast, last = (Smoothing(2.0 / (p + 1), p) for p in (long, short, signal))

    def body(c: Chunk) -> dict[str, np.ndarray]:
        move = c["close"] - c.before("close")
        up = c.smooth(c.smooth(move, slow), fast, 1)
        size = c.smooth(c.smooth(np.abs(move), slow), fast, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(size < NOTHING, np.nan, 100.0 * up / size)
        smooth = c.smooth(value, last, 2)
        return {out: np.where(np.isnan(smooth), np.nan, value), line: smooth}

    return Recurrence(f"`{out}` DOUBLE, `{line}` DOUBLE", body, 3)


def cost_atr(period: int, floor_price: float, out: str = "cost_atr") -> Recurrence:
    """Floored running mean of the true range while warming, then Wilder without floor."""
    return _one(out, Smoothing(1.0 / period, period, "floored", floor_price), _true_range)


def add(series: Series, *parts: Recurrence) -> Series:
    """All given recurrences in one pass (one shuffle) over each chunk."""

    def body(c: Chunk) -> dict[str, np.ndarray]:
        cols: dict[str, np.ndarray] = {}
        for part in parts:
            cols.update(part.body(c))
        return {n: pd.array(v, dtype="Float64") if np.isnan(v).any() else v
                for n, v in cols.items()}

    return series.kernel(body, ", ".join(p.ddl for p in parts), levels=max(p.levels for p in parts))


# --- native windows ------------------------------------------------------------------------


def true_range(series: Series, out: str = "tr") -> Series:
    def build(w):
        pc = F.lag("close").over(w)
        span = F.col("high") - F.col("low")
        return {out: F.greatest(span, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))}

    return series.windowed(build, back=1)


def supertrend(series: Series, period: int = 10, multiplier: float = 3.0, *,
               prefix: str = "st") -> Series:
    """Ratcheting bands that never reset, and the direction they imply.

    The lower band is a running maximum and the upper a running minimum, so the direction is
    the last bar that broke exactly one band, flipped once for each later bar beyond both.
    A ready ``_<prefix>_atr`` column of the same period is used and dropped.
    """
    raw = f"_{prefix}_atr"
    lo, up, d = f"{prefix}_lower", f"{prefix}_upper", f"{prefix}_dir"
    s = series if raw in series.df.columns else add(series, atr(period, raw))
    if s.chunked:
        s = s.settle()
    mid, width = (F.col("high") + F.col("low")) / 2, F.col(raw) * multiplier
    s = s.running({lo: ("max", mid - width), up: ("min", mid + width)})
    armed = F.col("k") > period - 1
    above, below = armed & (F.col("close") > F.col(up)), armed & (F.col("close") < F.col(lo))
    both = (above & below).cast("int")
    s = s.running({"_flips": ("sum", both)})
    lone = F.when(above & ~below, 1).when(below & ~above, -1)
    mark = F.when(lone.isNotNull(), F.struct(lone.alias("d"), F.col("_flips").alias("f")))
    s = s.running({"_mark": ("last", mark)})
    flips = F.col("_flips") - F.coalesce(F.col("_mark.f"), F.lit(0))
    base = F.coalesce(F.col("_mark.d"), F.lit(1))
    direction = F.when(flips % 2 == 0, base).otherwise(-base)
    ready = F.col(raw).isNotNull()
    df = (
        s.df.withColumn(d, F.when(ready, direction))
        .withColumn(f"{prefix}_value", F.when(F.col(d) == 1, F.col(lo)).when(ready, F.col(up)))
        .drop(raw, "_flips", "_mark")
    )
    return s.with_df(df)


def _week(keys: tuple[str, ...]) -> list[str]:
    return [*keys, "week_start"]


def weekly_levels(series: Series) -> Series:
    """Previous observed ISO week's extremes plus the running extremes of this week.

    Work is split by (keys, week); only one row per week meets the lag.
    """
    df = series.df.withColumn("week_start", F.date_trunc("week", "ts"))
    weeks = df.groupBy(*_week(series.keys)).agg(
        F.max("high").alias("_wh"), F.min("low").alias("_wl"))
    w = Window.partitionBy(*series.keys).orderBy("week_start")
    prior = weeks.select(
        *_week(series.keys),
        F.lag("_wh").over(w).alias("prev_high"),
        F.lag("_wl").over(w).alias("prev_low"),
        F.lag("_wh", 2).over(w).alias("older_high"),
        F.lag("_wl", 2).over(w).alias("older_low"),
    )
    run = Window.partitionBy(*_week(series.keys)).orderBy("k").rowsBetween(
        Window.unboundedPreceding, 0)
    seen = F.col("prev_high").isNotNull()
    out = (
        df.join(prior, _week(series.keys))
        .withColumn("curr_high", F.max("high").over(run))
        .withColumn("curr_low", F.min("low").over(run))
        .withColumn("curr_high", F.when(seen, F.col("curr_high")))
        .withColumn("curr_low", F.when(seen, F.col("curr_low")))
    )
    return series.with_df(out)


def break_of_structure(series: Series, block_bars: int = 20) -> Series:
    """Sticky weekly break, its order block and the change-of-character flags.

    Adds bos ('BOS_UP'/'BOS_DOWN'/'IDLE', NULL without levels), bos_level, ob_high, ob_low,
    choch_bearish, choch_bullish.
    """
    s = weekly_levels(series)
    if s.chunked:
        s = s.settle()

    def blocks(w):
        past = w.rowsBetween(-block_bars, -1)
        zone = F.struct("high", "low")
        return {
            "_down_bar": F.last(F.when(F.col("open") > F.col("close"), zone), True).over(past),
            "_up_bar": F.last(F.when(F.col("close") > F.col("open"), zone), True).over(past),
        }

    s = s.windowed(blocks, back=block_bars)
    none = F.lit(None).cast("double")

    def event(state: str, level: str, block: str):
        return F.struct(
            F.lit(state).alias("state"), F.col(level).alias("level"),
            F.coalesce(F.col(f"{block}.high"), none).alias("hi"),
            F.coalesce(F.col(f"{block}.low"), none).alias("lo"),
        )

    hit = F.when(F.col("close") > F.col("prev_high"), event("BOS_UP", "prev_high", "_down_bar"))
    hit = hit.when(F.col("close") < F.col("prev_low"), event("BOS_DOWN", "prev_low", "_up_bar"))
    run = Window.partitionBy(*_week(series.keys)).orderBy("k").rowsBetween(
        Window.unboundedPreceding, 0)
    seen = F.col("prev_high").isNotNull()
    df = (
        s.df.withColumn("_hit", F.first(hit, ignorenulls=True).over(run))
        .withColumns({
            "bos": F.when(seen, F.coalesce(F.col("_hit.state"), F.lit("IDLE"))),
            "bos_level": F.col("_hit.level"),
            "ob_high": F.col("_hit.hi"),
            "ob_low": F.col("_hit.lo"),
            "choch_bearish": F.when(seen, F.coalesce(
                F.col("prev_high") < F.col("older_high"), F.lit(False))),
            "choch_bullish": F.when(seen, F.coalesce(
                F.col("prev_low") > F.col("older_low"), F.lit(False))),
        })
        .drop("_hit", "_down_bar", "_up_bar")
    )
    return s.with_df(df)


def crossover(series: Series, a: str, b: str, *, up: str = "cross_up",
              down: str = "cross_down") -> Series:
    """a crosses b against the previous row on which both are known.

    Both columns are NULL only while warming up, or on rows where they are skipped together;
    the previous known pair comes from a running last over earlier rows.
    """
    pair = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
        F.col(a).alias("a"), F.col(b).alias("b")))
    s = series.running({"_pair": ("last", pair)})
    s = s.windowed(lambda w: {"_before": F.lag("_pair").over(w)}, back=1)
    known = pair.isNotNull()

    def crossed(was, now):
        return F.coalesce(known & was & now, F.lit(False))

    df = s.df.withColumns({
        up: crossed(F.col("_before.a") <= F.col("_before.b"), F.col(a) > F.col(b)),
        down: crossed(F.col("_before.a") >= F.col("_before.b"), F.col(a) < F.col(b)),
        f"prev_{a}": F.when(known, F.col("_before.a")),
    }).drop("_pair", "_before")
    return s.with_df(df)


def ema_trend(series: Series, period: int = 50, span: int = 5,
              min_slope_price: float = 0.5) -> Series:
    """LONG/SHORT/FLAT by close against the EMA and the EMA's slope over ``span`` bars. A ready
    ``trend_ema`` column is used as it is."""
    ready = "trend_ema" in series.df.columns
    s = series if ready else add(series, ema(period, "trend_ema"))
    s = s.windowed(lambda w: {"_ago": F.lag("trend_ema", span).over(w)}, back=span)
    slope = (F.col("trend_ema") - F.col("_ago")) / span
    label = (
        F.when((F.col("close") > F.col("trend_ema")) & (slope > min_slope_price), "LONG")
        .when((F.col("close") < F.col("trend_ema")) & (slope < -min_slope_price), "SHORT")
        .otherwise("FLAT")
    )
    return s.with_df(s.df.withColumn("trend_slope", slope).withColumn("trend", label).drop("_ago"))


def volatility_filter(series: Series, window: int = 20, mult: float = 1.5,
                      col: str = "atr") -> Series:
    """True where the ATR exceeds ``mult`` times the mean of up to window-1 earlier values."""
    s = series.windowed(
        lambda w: {"_mean": F.avg(col).over(w.rowsBetween(-(window - 1), -1))}, back=window - 1)
    hot = F.coalesce(
        (F.col("_mean") > 0) & (F.col(col) > F.col("_mean") * mult), F.lit(False))
    return s.with_df(s.df.withColumn("vol_suppressed", hot).drop("_mean"))


def session_range(series: Series, first_hour: int = 0, last_hour: int = 6) -> Series:
    """Running high, low and bar count of the day's quiet hours, as later bars see them."""
    quiet = F.hour("ts").between(first_hour, last_hour)
    run = (
        Window.partitionBy(*series.keys, "day").orderBy("k").rowsBetween(
            Window.unboundedPreceding, 0)
    )
    df = series.df.withColumn("day", F.to_date("ts")).withColumns({
        "range_high": F.max(F.when(quiet, F.col("high"))).over(run),
        "range_low": F.min(F.when(quiet, F.col("low"))).over(run),
        "range_bars": F.count(F.when(quiet, F.lit(1))).over(run),
    })
    return series.with_df(df)


def swing_pivots(series: Series, left: int = 5, right: int = 5) -> Series:
    """Pivot prices confirmed ``right`` bars late, on the confirming row."""
    span = left + right

    def build(w):
        full = w.rowsBetween(-span, 0)
        enough = F.col("k") >= span
        hi, lo = F.lag("high", right).over(w), F.lag("low", right).over(w)
        return {
            "pivot_high": F.when(enough & (hi >= F.max("high").over(full)), hi),
            "pivot_low": F.when(enough & (lo <= F.min("low").over(full)), lo),
        }

    return series.windowed(build, back=span)
