"""Multi-timeframe confluence scan and its scored signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions import scalars as sc
from tapeworks.operators import indicators as ind
from tapeworks.operators import rules
from tapeworks.operators.joins import asof_many
from tapeworks.operators.series import Series


def confluence_scan(h4: Series, h1: Series, m15: Series, decisions: DataFrame, *,
                    on_close: bool = True, h4_params: dict | None = None,
                    h1_params: dict | None = None, m15_params: dict | None = None,
                    min_slope_price: float = 0.5) -> DataFrame:
    """One scan result per decision row (symbol, ts).

    Each timeframe contributes its latest bar: completed ones by default, or any that have
    opened with ``on_close=False``. Signals are computed once over whole series instead of
    replaying a look-back window at every step.
    """
    key = ["symbol"]
    bos = rules.weekly_bos_retest(h4, also=(ind.ema(50, "trend_ema"),), **(h4_params or {}))
    trend = ind.ema_trend(bos, min_slope_price=min_slope_price)
    four = trend.df.select("symbol", "ts", "k", "close", "signal", "sl", "tp", "trend")
    one = rules.gold_pullback(h1, **(h1_params or {})).df.select(
        "symbol", "ts", "k", "close", "signal", "sl", "tp")
    fast = rules.ema_cross(m15, **(m15_params or {})).df.select("symbol", "ts", "k", "signal")
    shift = (14_400, 3_600, 900) if on_close else (0, 0, 0)
    joined = asof_many(decisions, [
        (four, "h4_", ["k", "close", "signal", "sl", "tp", "trend"], shift[0]),
        (one, "h1_", ["k", "close", "signal", "sl", "tp"], shift[1]),
        (fast, "m15_", ["k", "signal"], shift[2]),
    ], key)
    enough = (F.col("h4_k") >= 1) & (F.col("h1_k") >= 1) & (F.col("m15_k") >= 1)
    enough = F.coalesce(enough, F.lit(False))

    def shown(c: str) -> Column:
        return F.when(enough, F.col(c)).otherwise("FLAT")

    df = joined.withColumns({
        "h4_trend": shown("h4_trend"), "h4_signal": shown("h4_signal"),
        "h1_signal": shown("h1_signal"), "m15_signal": shown("m15_signal"),
    })
    go = (F.col("h4_trend") != "FLAT") & (F.col("h1_signal") == F.col("h4_trend"))
    agrees = F.col("h4_signal") == F.col("h4_trend")
    df = df.withColumn("confluence", go)

    def level(c: str) -> Column:
        own = F.when(agrees & F.col(f"h4_{c}").isNotNull(), F.col(f"h4_{c}")).otherwise(
            F.col(f"h1_{c}"))
        return F.when(F.col("confluence"), own)

    return df.select(
        "symbol", "ts", "h4_ts", "h4_signal", "h4_trend", "h1_signal", "m15_signal", "confluence",
        F.when(F.col("confluence"), F.col("h4_trend")).otherwise("FLAT").alias("direction"),
        F.when(F.col("confluence"), F.col("h1_close")).alias("entry_price"),
        level("sl").alias("sl"), level("tp").alias("tp"),
        F.when(F.col("confluence"), F.when(agrees & F.col("h4_sl").isNotNull(), "BOS")
               .otherwise("ATR")).alias("sl_source"),
    )


def scored(scan: DataFrame, *, pip: float = 0.1, w_structure: int = 30, w_momentum: int = 30,
           w_session: int = 20, w_cost: int = 20) -> DataFrame:
    """Component scores, total, label, reward-to-risk and stop distance."""
    c = F.col
    df = scan.withColumns({
        "score_structure": sc.score_structure(c("h4_trend"), c("h1_signal"), c("m15_signal"), w_structure),
        "score_momentum": sc.score_momentum(c("entry_price"), c("sl"), c("tp"), w_momentum),
        "score_session": sc.score_session(c("ts"), w_session),
        "score_cost": sc.score_cost(c("entry_price"), c("sl"), c("tp"), w_cost, pip=pip),
        "rr": sc.reward_risk(c("entry_price"), c("sl"), c("tp"), pip),
        "sl_pips": sc.stop_pips(c("entry_price"), c("sl"), pip),
    })
    total = F.least(c("score_structure") + c("score_momentum") + c("score_session")
                    + c("score_cost"), F.lit(100))
    return df.withColumn("score_total", total).withColumn("score_label", sc.score_label(c("score_total")))


def outcome_entries(scan: DataFrame, hours: DataFrame, *, warmup: int = 50) -> DataFrame:
    """Scanner study: confluent, levelled, confirmed by the fast frame, past the warm-up, and
    the first per (direction, coarse bar). ``hours`` gives k per decision row."""
    ok = (
        F.col("confluence") & F.col("sl").isNotNull() & F.col("tp").isNotNull()
        & (F.col("m15_signal") == F.col("direction")) & (F.col("k") >= warmup)
    )
    rows = scan.join(hours, ["symbol", "ts"]).where(ok)
    pay = F.struct("k", "ts", "entry_price", "sl", "tp")
    return (
        rows.groupBy("symbol", "direction", "h4_ts").agg(F.min_by(pay, "k").alias("p"))
        .select("symbol", "direction", F.col("p.k").alias("k"), F.col("p.ts").alias("ts"),
                F.col("p.entry_price").alias("entry"), F.col("p.sl").alias("sl"),
                F.col("p.tp").alias("tp"))
    )
