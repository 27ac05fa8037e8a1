"""Trade statistics. Ordered figures (drawdown) are built from chunk summaries, so one run may
hold any share of the trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def profit_factor(pnl: Column) -> Column:
    """Gains over losses; no losses: inf with gains, else 0."""
    win, loss = _gains(pnl), _losses(pnl)
    return F.when(loss > 0, win / loss).when(win > 0, F.lit(INF)).otherwise(F.lit(0.0))


def _gains(pnl: Column) -> Column:
    return F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))


def _losses(pnl: Column) -> Column:
    return F.coalesce(F.sum(F.when(pnl < 0, -pnl)), F.lit(0.0))


def expectancy(pnl: Column) -> Column:
    return F.coalesce(F.avg(pnl), F.lit(0.0))


def win_rate(pnl: Column) -> Column:
    return F.coalesce(F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), F.lit(0.0))


def sharpe(pnl: Column, ddof: int = 1) -> Column:
    """Mean over standard deviation; 0 when the deviation is 0 or undefined."""
    sd = F.stddev_samp(pnl) if ddof == 1 else F.stddev_pop(pnl)
    return F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.avg(pnl) / sd).otherwise(0.0)


def drawdown_parts(trades: DataFrame, keys: list[str], order: list[str], chunk: list[Column],
                   pnl: str = "pnl", ends: tuple[str, str] | None = None) -> DataFrame:
    """One summary per (keys, chunk): everything the drawdown of the whole run needs.

    ``chunk`` columns must be monotone in ``order``. Summaries merge in chunk order. ``ends``
    names columns whose first and last values (in order) are kept as well.
    """
    names = [f"_c{i}" for i in range(len(chunk))]
    extra = [F.col(c).alias(f"_e{i}") for i, c in enumerate(ends or ())]
    df = trades.select(
        *keys, *order, F.col(pnl).alias("_p"), *extra, *[c.alias(n) for c, n in zip(chunk, names)])
    run = (
        Window.partitionBy(*keys, *names).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumn("_cum", F.sum("_p").over(run))
    df = df.withColumn("_peak", F.max("_cum").over(run))
    p = F.col("_p")
    marks = []
    if ends:
        w = Window.partitionBy(*keys, *names).orderBy(*order)
        df = df.withColumn("_head", F.lag("_cum").over(w).isNull()).withColumn(
            "_tail", F.lead("_cum").over(w).isNull())
        marks = [F.max(F.when(F.col("_head"), F.col("_e0"))).alias("first_value"),
                 F.max(F.when(F.col("_tail"), F.col("_e1"))).alias("last_value")]
    return df.groupBy(*keys, *names).agg(
        *marks, F.count(F.lit(1)).alias("n"), F.sum(p).alias("total"), F.count_if(p > 0).alias("wins"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gains"),
        F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("losses"),
        F.avg("_p").alias("mean"), F.var_pop("_p").alias("var"),
        F.max("_cum").alias("top"), F.min("_cum").alias("bottom"),
        F.max(F.col("_peak") - F.col("_cum")).alias("dd"),
        F.max_by("_peak", F.col("_peak") - F.col("_cum")).alias("dd_peak"),
    )


def _merge_drawdown(parts: DataFrame, keys: list[str], names: list[str], from_zero: bool) -> DataFrame:
    before = (
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    df = parts.withColumn("_base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    high = F.max(F.col("_base") + F.col("top")).over(before)
    if from_zero:
        high = F.greatest(F.coalesce(high, F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("_high", high)
    carried = F.col("_high") - (F.col("_base") + F.col("bottom"))
    local = F.struct(F.col("dd").alias("dd"), (F.col("_base") + F.col("dd_peak")).alias("peak"))
    over = F.struct(carried.alias("dd"), F.col("_high").alias("peak"))
    best = F.when(F.coalesce(carried > F.col("dd"), F.lit(False)), over).otherwise(local)
    return df.withColumn("_best", best).withColumn("_top", F.col("_base") + F.col("top"))


def fold_level(parts: DataFrame, keys: list[str], inner: str) -> DataFrame:
    """Summaries of the chunks that share ``keys``, merged in the order of ``inner``: the result
    has the same columns but that one and merges on in the same way."""
    df = _merge_drawdown(parts, keys, [inner], from_zero=False)
    n, mean = F.col("n"), F.col("mean")
    at = F.col(inner)
    ends = [f(c, at).alias(c) for f, c in ((F.min_by, "first_value"), (F.max_by, "last_value")) if c in parts.columns]
    out = df.groupBy(*keys).agg(
        *ends, F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("wins").alias("wins"),
        F.sum("gains").alias("gains"), F.sum("losses").alias("losses"),
        F.sum(n * F.col("var") + n * mean * mean).alias("_m2"), F.max("_top").alias("top"),
        F.min(F.col("_base") + F.col("bottom")).alias("bottom"), F.max("_best").alias("_worst"))
    out = out.withColumn("mean", F.col("total") / F.col("n")).withColumn(
        "var", F.greatest(F.col("_m2") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return out.withColumns({"dd": F.col("_worst.dd"), "dd_peak": F.col("_worst.peak")}).drop("_m2", "_worst")


def summarize(parts: DataFrame, keys: list[str], *, from_zero: bool = False) -> DataFrame:
    """Run-level statistics from chunk summaries, merged level by level: chunks of several columns
    are first merged within all but the last of them, so one window never holds all chunks.

    Gives trade_count, wins, total, mean, var_samp, var_pop, gains, losses, max_dd, dd_peak
    (the peak before the deepest drawdown) and top (the final running peak).
    """
    names = sorted(c for c in parts.columns if c.startswith("_c"))
    while len(names) > 1:
        parts = fold_level(parts, [*keys, *names[:-1]], names.pop())
    df = _merge_drawdown(parts, keys, names, from_zero)
    n, mean = F.col("n"), F.col("mean")
    out = df.groupBy(*keys).agg(
        F.sum("n").alias("trade_count"), F.sum("wins").alias("wins"),
        F.sum("total").alias("total"), F.sum("gains").alias("gains"),
        F.sum("losses").alias("losses"),
        F.sum(n * F.col("var") + n * mean * mean).alias("_m2"),
        F.max("_best").alias("_worst"), F.max("_top").alias("top"),
    )
    avg = F.col("total") / F.col("trade_count")
    ss = F.greatest(F.col("_m2") - F.col("trade_count") * avg * avg, F.lit(0.0))
    worst = F.greatest(F.col("_worst.dd"), F.lit(0.0))
    return out.select(
        *keys, "trade_count", "wins", "total", avg.alias("mean"),
        F.when(F.col("trade_count") > 1, ss / (F.col("trade_count") - 1)).alias("var_samp"),
        (ss / F.col("trade_count")).alias("var_pop"), "gains", "losses",
        worst.alias("max_dd"), F.col("_worst.peak").alias("dd_peak"), "top",
    )


def _ratio(var: str) -> Column:
    sd = F.sqrt(F.col(var))
    return F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.col("mean") / sd).otherwise(0.0)


def basic_metrics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The seven research metrics; the peak starts at the first equity value."""
    m = summarize(parts, keys)
    pct = F.when((F.col("max_dd") > 0) & (F.col("dd_peak") != 0),
                 F.col("max_dd") / F.abs("dd_peak")).otherwise(0.0)
    return m.select(
        *keys, F.col("total").alias("total_return"), F.col("max_dd").alias("max_drawdown_abs"),
        pct.alias("max_drawdown_pct"), _ratio("var_samp").alias("sharpe_ratio"),
        F.col("trade_count"), (F.col("wins") / F.col("trade_count")).alias("win_rate"),
        F.col("mean").alias("avg_trade_pnl"),
    )


def strategy_metrics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Profit factor, expectancy, win rate, drawdown from a zero peak, Sharpe, verdict."""
    m = summarize(parts, keys, from_zero=True)
    pf = F.when(F.col("losses") > 0, F.col("gains") / F.col("losses")).when(
        F.col("gains") > 0, F.lit(INF)).otherwise(0.0)
    return m.select(
        *keys, "trade_count", pf.alias("profit_factor"), F.col("mean").alias("expectancy"),
        (F.col("wins") / F.col("trade_count")).alias("win_rate"),
        F.col("max_dd").alias("max_drawdown"), _ratio("var_samp").alias("sharpe"),
        ((F.col("mean") > 0) & (pf > 1)).alias("is_profitable"),
    )


def walk_forward_metrics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Script-style metrics in pips: population deviation, drawdown over the final peak."""
    m = summarize(parts, keys)
    base = F.when(F.abs("top") > 0, F.abs("top")).otherwise(1.0)
    return m.select(
        *keys, "trade_count", (F.col("wins") / F.col("trade_count")).alias("win_rate"),
        F.col("total").alias("total_pnl_pips"), F.col("mean").alias("avg_pnl_pips"),
        F.when(F.col("max_dd") > 0, F.col("max_dd") / base).otherwise(0.0)
        .alias("max_drawdown_pct"),
        _ratio("var_pop").alias("sharpe"),
    )


def journal_performance(trades: DataFrame, keys: list[str], order: list[str],
                        chunk: list[Column]) -> DataFrame:
    """Closed-trade report: NaN where a figure is undefined, exit-kind histogram as a map."""
    parts = drawdown_parts(trades, keys, order, chunk, ends=("entry_ts", "exit_ts"))
    m = summarize(parts, keys, from_zero=True)
    at = F.struct(*sorted(c for c in parts.columns if c.startswith("_c")))
    ends = parts.groupBy(*keys).agg(
        F.min_by("first_value", at).alias("first_trade_ts"),
        F.max_by("last_value", at).alias("last_trade_ts"))
    kinds = trades.groupBy(*keys, "exit_kind").count().groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("exit_kind", "count"))))
        .alias("exit_counts"))
    pf = F.when(F.col("losses") > 0, F.col("gains") / F.col("losses")).when(
        F.col("gains") > 0, F.lit(INF)).otherwise(F.lit(NAN))
    sd = F.sqrt("var_samp")
    return (
        m.join(kinds, keys).join(ends, keys).select(
            *keys, "trade_count", F.col("wins").alias("win_count"),
            (F.col("wins") / F.col("trade_count")).alias("win_rate"),
            F.col("total").alias("total_pnl"), F.col("mean").alias("avg_pnl"),
            pf.alias("profit_factor"), F.col("max_dd").alias("max_drawdown_abs"),
            F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.col("mean") / sd).otherwise(F.lit(NAN))
            .alias("sharpe_ratio"),
            "exit_counts", "first_trade_ts", "last_trade_ts",
        )
    )


def equity_curve(trades: DataFrame, keys: list[str], order: list[str], chunk: list[Column],
                 pnl: str = "pnl") -> DataFrame:
    """Cumulative pnl and drawdown per trade, against both peak conventions.

    Local prefixes per (keys, chunk) plus a carry from the chunk summaries; both sides of the
    join are partitioned by (keys, chunk).
    """
    names = [f"_c{i}" for i in range(len(chunk))]
    df = trades.withColumns(dict(zip(names, chunk)))
    run = (
        Window.partitionBy(*keys, *names).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumn("_cum", F.sum(pnl).over(run)).withColumn("_top", F.max("_cum").over(run))
    before = (
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        df.groupBy(*keys, *names).agg(F.sum(pnl).alias("_s"), F.max("_cum").alias("_t"))
        .withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
        .withColumn("_high", F.max(F.col("_base") + F.col("_t")).over(before))
        .select(*keys, *names, "_base", "_high")
    )
    equity = F.col("_base") + F.col("_cum")
    peak = F.greatest(F.col("_high"), F.col("_base") + F.col("_top"))
    return (
        df.join(totals, [*keys, *names])
        .withColumn("equity", equity)
        .withColumn("drawdown", peak - equity)
        .withColumn("drawdown_from_zero", F.greatest(peak, F.lit(0.0)) - equity)
        .drop(*names, "_cum", "_top", "_base", "_high")
    )


def degradation(train: Column, oos: Column) -> Column:
    """(train - oos) / |train| Sharpe; NaN if train is 0."""
    return F.when(train != 0, (train - oos) / F.abs(train)).otherwise(F.lit(NAN))
