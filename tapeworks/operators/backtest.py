"""Trades from position-free signals: next-bar-open execution as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.costs import CostTerms, round_trip_currency
from tapeworks.operators.series import Series, index_series


def signal_islands(series: Series, *, atr_col: str | None = None, delay: int = 0) -> DataFrame:
    """One row per run of equal signals with the next bar's open as its fill.

    The last bar's own signal is dropped; the bar stands as a terminal row filled at its
    close. ``delay`` moves every fill that many further bars (clamped to the last close).
    """
    ahead = 1 + delay

    def near(col, w):
        return [F.lead(col, a).over(w) for a in range(ahead - 1, 0, -1)]

    def build(w):
        return {
            "_prev": F.lag("signal").over(w),
            "_open": F.coalesce(F.lead("open", ahead).over(w), *near("close", w)),
            "_ts": F.coalesce(F.lead("ts", ahead).over(w), *near("ts", w)),
            "_last": F.lead("k").over(w).isNull(),
        }

    s = series.windowed(build, back=1, ahead=ahead)
    edge = F.col("_last") | F.col("_prev").isNull() | (F.col("_prev") != F.col("signal"))
    atr = F.col(atr_col) if atr_col else F.lit(None).cast("double")
    rows = s.df.where(edge).select(
        *s.keys, "k",
        F.when(F.col("_last"), "END").otherwise(F.col("signal")).alias("signal"),
        F.when(F.col("_last"), F.col("close")).otherwise(F.col("_open")).alias("fill"),
        F.when(F.col("_last"), F.col("ts")).otherwise(F.col("_ts")).alias("fill_ts"),
        atr.alias("atr"),
    )

    def pair(w):
        return {f"exit_{c}": F.lead(c).over(w) for c in ("fill", "fill_ts", "atr")}

    if not s.chunked:
        return rows.withColumns(pair(Window.partitionBy(*s.keys).orderBy("k")))
    sparse = index_series(rows.withColumnRenamed("k", "bar_k"), s.keys, order="bar_k",
                          bucket=F.floor(F.col("bar_k") / s.rows_per_chunk),
                          rows_per_chunk=s.rows_per_chunk)
    return sparse.windowed(pair, ahead=1).df.drop("k").withColumnRenamed("bar_k", "k")


def backtest(series: Series, *, terms: CostTerms, pip_size: float, lots: float = 1.0,
             atr_col: str | None = None, session: str | None = None, delay: int = 0,
             stress: Column | float = 1.0) -> DataFrame:
    """Net trades: signal at i fills at the open of i+1, reversals close and open at one fill."""
    keys = list(series.keys)
    isl = signal_islands(series, atr_col=atr_col, delay=delay)
    sign = F.when(F.col("signal") == "LONG", 1.0).otherwise(-1.0)
    cost = round_trip_currency(
        terms, lots=F.lit(lots),
        atr_pips=F.coalesce(F.col("exit_atr"), F.lit(0.0)) / pip_size,
        session=F.lit(session), stress=stress if isinstance(stress, Column) else F.lit(stress),
    )
    gross = sign * (F.col("exit_fill") - F.col("fill")) / pip_size * terms.pip_value * lots
    return isl.where(F.col("signal").isin("LONG", "SHORT")).select(
        *keys, F.col("k").alias("signal_k"), F.col("signal").alias("direction"),
        F.col("fill_ts").alias("entry_ts"), F.col("fill").alias("entry_price"),
        F.col("exit_fill_ts").alias("exit_ts"), F.col("exit_fill").alias("exit_price"),
        gross.alias("gross_pnl"), (gross - cost).alias("pnl"),
    )
