"""Trading rules as DataFrame steps: each adds signal ('LONG'/'SHORT'/'FLAT'), sl and tp.

All rules are position-free here; ``tapeworks.operators.fills`` runs those whose exits depend
on an open position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.timeexpr import bar_floor
from tapeworks.operators import indicators as ind
from tapeworks.operators.bars import session_gate
from tapeworks.operators.series import Series, index_series
from tapeworks.operators.zones import zone_proximity


def _emit(s: Series, choices: list[tuple[Column, str, Column, Column]]) -> Series:
    """First matching choice wins; NULL conditions count as false."""
    pick = None
    for cond, side, sl, tp in choices:
        row = F.struct(F.lit(side).alias("d"), sl.alias("sl"), tp.alias("tp"))
        pick = F.when(cond, row) if pick is None else pick.when(cond, row)
    df = s.df.withColumn("_p", pick)
    return s.with_df(df.withColumns({
        "signal": F.coalesce(F.col("_p.d"), F.lit("FLAT")),
        "sl": F.col("_p.sl"),
        "tp": F.col("_p.tp"),
    }).drop("_p"))


def _tsi_bull() -> Column:
    return (F.col("tsi") > 0) & (F.col("tsi") > F.col("tsi_signal"))


def _tsi_bear() -> Column:
    return (F.col("tsi") < 0) & (F.col("tsi") < F.col("tsi_signal"))


def ema_cross(series: Series, fast: int = 9, slow: int = 21, *,
              also: tuple[ind.Recurrence, ...] = ()) -> Series:
    """FLAT while warming, then LONG if fast > slow else SHORT. Recurrences that later steps
    need go into ``also`` and share this rule's pass."""
    if fast >= slow:
        raise ValueError("fast must be below slow")
    s = ind.add(series, ind.ema_mean_seeded(fast, "ema_fast"),
                ind.ema_mean_seeded(slow, "ema_slow"), *also)
    ready = F.col("ema_fast").isNotNull() & F.col("ema_slow").isNotNull()
    up = F.col("ema_fast") > F.col("ema_slow")
    none = F.lit(None).cast("double")
    return _emit(s, [(ready & up, "LONG", none, none), (ready & ~up, "SHORT", none, none)])


def ema_cross_sweep(series: Series, params: list[tuple[str, int, int]], *,
                    also: tuple[ind.Recurrence, ...] = ()) -> Series:
    """EMA cross for many (param_id, fast, slow) sets in one plan; ``param_id`` joins the keys."""
    sets = F.array(*[F.struct(F.lit(i).alias("param_id"), F.lit(f).alias("fast"), F.lit(s).alias("slow"))
                     for i, f, s in params])
    df = series.df.withColumn("_s", F.explode(sets)).select("*", "_s.*").drop("_s")
    s = Series(df, (*series.keys, "param_id"), series.max_rows, series.rows_per_chunk)
    s = ind.add(s, ind.ema_mean_seeded_by("fast", "ema_fast"),
                ind.ema_mean_seeded_by("slow", "ema_slow"), *also)
    ready = F.col("ema_fast").isNotNull() & F.col("ema_slow").isNotNull()
    up, none = F.col("ema_fast") > F.col("ema_slow"), F.lit(None).cast("double")
    return _emit(s, [(ready & up, "LONG", none, none), (ready & ~up, "SHORT", none, none)])


def gold_pullback(series: Series, *, ema_fast: int = 20, ema_slow: int = 50, st_period: int = 10,
                  st_multiplier: float = 3.0, tsi_long: int = 25, tsi_short: int = 13,
                  tsi_signal: int = 13, atr_period: int = 14, sl_atr_mult: float = 1.5,
                  tp_atr_mult: float = 3.0, pivot_left: int = 5, pivot_right: int = 5,
                  zone_merge_pips: float = 50.0, max_zone_touches: int = 3,
                  zone_entry_pips: float = 150.0, pip_size: float = 0.1) -> Series:
    """EMA, supertrend and TSI agreement near a fresh zone. ``hold_long``/``hold_short`` say
    whether an open position would be kept."""
    s = zone_proximity(
        series, pip_size=pip_size, left=pivot_left, right=pivot_right,
        merge_pips=zone_merge_pips, max_touches=max_zone_touches, gate_pips=zone_entry_pips,
    )
    s = ind.add(s, ind.ema(ema_fast, "ema_fast"), ind.ema(ema_slow, "ema_slow"),
                ind.tsi(tsi_long, tsi_short, tsi_signal), ind.atr(atr_period),
                ind.atr(st_period, "_st_atr"))
    s = ind.supertrend(s, st_period, st_multiplier)
    ready = F.lit(True)
    for c in ("ema_fast", "ema_slow", "st_dir", "tsi_signal", "atr"):
        ready = ready & F.col(c).isNotNull()
    bull = ready & (F.col("ema_fast") > F.col("ema_slow")) & (F.col("st_dir") == 1)
    bear = ready & (F.col("ema_fast") < F.col("ema_slow")) & (F.col("st_dir") == -1)
    c, a = F.col("close"), F.col("atr")
    s = s.with_columns({"hold_long": F.coalesce(bull, F.lit(False)),
                        "hold_short": F.coalesce(bear, F.lit(False))})
    return _emit(s, [
        (bull & _tsi_bull() & F.col("near_support"), "LONG", c - a * sl_atr_mult, c + a * tp_atr_mult),
        (bear & _tsi_bear() & F.col("near_resistance"), "SHORT", c + a * sl_atr_mult,
         c - a * tp_atr_mult),
    ])


def london_sweep(series: Series, *, sl_atr_mult: float = 1.0, rr: float = 2.0,
                 atr_period: int = 14, vol_window: int = 20, vol_mult: float = 1.5,
                 min_range_bars: int = 5) -> Series:
    """Sweep of the quiet-hours range that closes back inside, hours 7..11; the first signal
    of the day repeats until noon."""
    s = ind.add(series, ind.atr(atr_period))
    if s.chunked:
        s = s.settle()
    s = ind.session_range(ind.volatility_filter(s, vol_window, vol_mult))
    hi, lo, c, a = F.col("range_high"), F.col("range_low"), F.col("close"), F.col("atr")
    armed = (
        F.hour("ts").between(7, 11) & (F.col("range_bars") >= min_range_bars)
        & ~F.col("vol_suppressed")
    )
    sl_short, sl_long = F.col("high") + a * sl_atr_mult, F.col("low") - a * sl_atr_mult

    def shot(side: str, sl: Column, tp: Column) -> Column:
        return F.struct(F.lit(side).alias("d"), sl.alias("sl"), tp.alias("tp"))

    fired = F.when(armed & (F.col("high") > hi) & (c < hi),
                   shot("SHORT", sl_short, c - (sl_short - c) * rr))
    fired = fired.when(armed & (F.col("low") < lo) & (c > lo),
                       shot("LONG", sl_long, c + (c - sl_long) * rr))
    run = Window.partitionBy(*s.keys, "day").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    df = s.df.withColumn("_f", F.first(fired, ignorenulls=True).over(run))
    live = F.hour("ts").between(7, 11) & F.col("_f").isNotNull()
    df = df.withColumns({
        "signal": F.when(live, F.col("_f.d")).otherwise("FLAT"),
        "sl": F.when(live, F.col("_f.sl")),
        "tp": F.when(live, F.col("_f.tp")),
    }).drop("_f")
    return s.with_df(df)


def prev_week_range(series: Series, *, ema_fast: int = 20, ema_slow: int = 50, tsi_long: int = 25,
                    tsi_short: int = 13, tsi_signal: int = 13, pip_size: float = 0.1,
                    touch_buf_pips: float = 3.0, break_buf_pips: float = 2.0,
                    sl_atr_mult: float = 1.0, atr_period: int = 14, max_risk_pips: float = 150.0,
                    risk_reward: float = 2.0, london: bool = True, ny: bool = True) -> Series:
    """Pullback to, or breakout of, the previous week's extremes."""
    s = ind.add(series, ind.ema(ema_fast, "ema_fast"), ind.ema(ema_slow, "ema_slow"),
                ind.tsi(tsi_long, tsi_short, tsi_signal), ind.atr(atr_period))
    s = ind.weekly_levels(s)
    pwh, pwl, c = F.col("prev_high"), F.col("prev_low"), F.col("close")
    touch, brk = touch_buf_pips * pip_size, break_buf_pips * pip_size
    buf = F.col("atr") * sl_atr_mult
    bull = (F.col("ema_fast") > F.col("ema_slow")) & _tsi_bull()
    bear = (F.col("ema_fast") < F.col("ema_slow")) & _tsi_bear()
    open_hours = session_gate(F.col("ts"), london, ny)

    def long(setup: Column, level: Column):
        sl = level - buf
        risk = c - sl
        ok = open_hours & setup & bull & (risk > 0) & (risk <= max_risk_pips * pip_size)
        return ok, "LONG", sl, c + risk * risk_reward

    def short(setup: Column, level: Column):
        sl = level + buf
        risk = sl - c
        ok = open_hours & setup & bear & (risk > 0) & (risk <= max_risk_pips * pip_size)
        return ok, "SHORT", sl, c - risk * risk_reward

    return _emit(s, [
        long((F.col("low") <= pwl + touch) & (c >= pwl), pwl),
        short((F.col("high") >= pwh - touch) & (c <= pwh), pwh),
        long(c > pwh + brk, pwh),
        short(c < pwl - brk, pwl),
    ])


def weekly_bos_retest(series: Series, *, ema_fast: int = 20, ema_slow: int = 50,
                      tsi_long: int = 25, tsi_short: int = 13, tsi_signal: int = 13,
                      pip_size: float = 0.1, ob_buffer_pips: float = 5.0,
                      max_risk_pips: float = 80.0, risk_reward: float = 2.0,
                      also: tuple[ind.Recurrence, ...] = ()) -> Series:
    """Retest of the order block after a weekly break of structure."""
    s = ind.add(series, ind.ema(ema_fast, "ema_fast"), ind.ema(ema_slow, "ema_slow"),
                ind.tsi(tsi_long, tsi_short, tsi_signal), *also)
    s = ind.break_of_structure(s)
    c, buf, cap = F.col("close"), ob_buffer_pips * pip_size, max_risk_pips * pip_size
    bull = (F.col("ema_fast") > F.col("ema_slow")) & _tsi_bull()
    bear = (F.col("ema_fast") < F.col("ema_slow")) & _tsi_bear()
    sl_l, sl_s = F.col("ob_low") - buf, F.col("ob_high") + buf
    risk_l, risk_s = c - sl_l, sl_s - c
    go_long = (
        (F.col("bos") == "BOS_UP") & ~F.col("choch_bearish") & bull
        & (F.col("low") <= F.col("ob_high")) & (c >= F.col("ob_low"))
        & (risk_l > 0) & (risk_l <= cap)
    )
    go_short = (
        (F.col("bos") == "BOS_DOWN") & ~F.col("choch_bullish") & bear
        & (F.col("high") >= F.col("ob_low")) & (c <= F.col("ob_high"))
        & (risk_s > 0) & (risk_s <= cap)
    )
    return _emit(s, [
        (go_long, "LONG", sl_l, c + risk_l * risk_reward),
        (go_short, "SHORT", sl_s, c - risk_s * risk_reward),
    ])


def _tsi_cross_entry(s: Series, choices, sl_mult: float, tp_mult: float) -> Series:
    c, a = F.col("close"), F.col("atr")
    rows = []
    for cond, side in choices:
        sign = 1 if side == "LONG" else -1
        rows.append((cond, side, c - a * (sign * sl_mult), c + a * (sign * tp_mult)))
    return _emit(s, rows)


def tsi_momentum(series: Series, *, ema_period: int = 50, tsi_long: int = 25, tsi_short: int = 13,
                 tsi_signal: int = 13, atr_period: int = 14, sl_atr_mult: float = 1.5,
                 tp_atr_mult: float = 3.0, tsi_threshold: float = 5.0, london: bool = True,
                 ny: bool = True) -> Series:
    """TSI crossover beyond a threshold on the right side of the EMA. The crossings are kept
    (``cross_up``/``cross_down``): they also close positions."""
    s = ind.add(series, ind.ema(ema_period, "ema_regime"),
                ind.tsi(tsi_long, tsi_short, tsi_signal), ind.atr(atr_period))
    s = _visible_tsi(s, ["ema_regime", "tsi_signal", "atr"])
    gate = session_gate(F.col("ts"), london, ny)
    return _tsi_cross_entry(s, [
        (gate & F.col("cross_up") & (F.col("tsi") > tsi_threshold)
         & (F.col("close") > F.col("ema_regime")), "LONG"),
        (gate & F.col("cross_down") & (F.col("tsi") < -tsi_threshold)
         & (F.col("close") < F.col("ema_regime")), "SHORT"),
    ], sl_atr_mult, tp_atr_mult)


def _visible_tsi(s: Series, needed: list[str]) -> Series:
    """Crossings count only rows on which every needed indicator is known."""
    ready = F.lit(True)
    for c in needed:
        ready = ready & F.col(c).isNotNull()
    s = s.with_columns({"tsi": F.when(ready, F.col("tsi")),
                        "tsi_signal": F.when(ready, F.col("tsi_signal"))})
    if s.chunked:
        s = s.settle()
    return ind.crossover(s, "tsi", "tsi_signal")


def hourly_bias(series: Series, *, tsi_long: int = 25, tsi_short: int = 13, tsi_signal: int = 13,
                ema_period: int = 50) -> DataFrame:
    """BULL/BEAR/FLAT per completed hour of a finer series, stamped with the hour's end.

    An hour without both indicators keeps the bias before it.
    """
    keys = [k for k in series.keys if k != "timeframe"]
    hours = series.df.groupBy(*keys, bar_floor(F.col("ts"), 60).alias("hour")).agg(
        F.max_by("close", F.unix_micros("ts")).alias("close")).withColumnRenamed("hour", "ts")
    h = index_series(hours, tuple(keys), rows_per_chunk=series.rows_per_chunk)
    h = ind.add(h, ind.ema(ema_period, "bias_ema"), ind.tsi(tsi_long, tsi_short, tsi_signal))
    c, e = F.col("close"), F.col("bias_ema")
    known = F.col("tsi_signal").isNotNull() & e.isNotNull()
    raw = F.when(known & _tsi_bull() & (c > e), "BULL").when(
        known & _tsi_bear() & (c < e), "BEAR").when(known, "FLAT")
    h = h.running({"bias": ("last", raw)})
    return h.df.select(
        *keys, (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("hour_end"),
        F.coalesce("bias", F.lit("FLAT")).alias("bias"),
    )


def multi_tf_tsi(series: Series, *, tsi_long: int = 25, tsi_short: int = 13, tsi_signal: int = 13,
                 ema_period: int = 50, atr_period: int = 14, sl_atr_mult: float = 1.5,
                 tp_atr_mult: float = 3.0, ob_moderate: float = 40.0, ob_extreme: float = 75.0,
                 london: bool = True, ny: bool = True) -> Series:
    """Three tiers of TSI crossings on a fine series with the bias of the last full hour."""
    keys = [k for k in series.keys if k != "timeframe"]
    bias = hourly_bias(series, tsi_long=tsi_long, tsi_short=tsi_short, tsi_signal=tsi_signal,
                       ema_period=ema_period)
    s = ind.add(series, ind.tsi(tsi_long, tsi_short, tsi_signal), ind.atr(atr_period))
    s = _visible_tsi(s, ["tsi_signal", "atr"])
    # The last completed observed hour is the hour row before the bar's own hour, so the
    # as-of match is an equi join on the hour plus a lag over hour rows.
    w = Window.partitionBy(*keys).orderBy("hour_end")
    last_full = bias.select(
        *keys, (F.col("hour_end") - F.expr("INTERVAL 1 HOUR")).alias("_hour"),
        F.lag("bias").over(w).alias("h1_bias"),
    )
    df = s.df.withColumn("_hour", bar_floor(F.col("ts"), 60)).join(
        last_full, [*keys, "_hour"], "left").drop("_hour")
    df = df.withColumn("h1_bias", F.coalesce("h1_bias", F.lit("FLAT")))
    gate = session_gate(F.col("ts"), london, ny)
    up, dn, was = gate & F.col("cross_up"), gate & F.col("cross_down"), F.col("prev_tsi")
    bull, bear = F.col("h1_bias") == "BULL", F.col("h1_bias") == "BEAR"
    return _tsi_cross_entry(s.with_df(df), [
        (up & (was < -ob_extreme), "LONG"),
        (dn & (was > ob_extreme), "SHORT"),
        (up & (was < -ob_moderate) & bull, "LONG"),
        (dn & (was > ob_moderate) & bear, "SHORT"),
        (up & bull & (F.col("tsi") < ob_moderate), "LONG"),
        (dn & bear & (F.col("tsi") > -ob_moderate), "SHORT"),
    ], sl_atr_mult, tp_atr_mult)


def last_snapshot(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Last row's columns per key. The row-number limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    out = df.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return out.select(*keys, "ts", *cols)


def paper_signal(in_position: Column, confluence: Column, direction: Column,
                 h4_trend: Column) -> Column:
    """Flat: the confluent direction; in a position: the 4-hour trend."""
    return F.when(in_position, h4_trend).when(confluence, direction).otherwise("FLAT")
