"""Bar quality: day validation and the nine-check report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.scalars import pip_size_heuristic
from tapeworks.functions.timeexpr import with_market_open
from tapeworks.operators.series import index_series

HIGH, MEDIUM = "high", "medium"


def hours_with_data(ticks: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return ticks.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.count_distinct(F.date_trunc("hour", "ts")).alias("hours_with_data"),
    )


def validate_days(bars: DataFrame, *, min_bars: int = 100, max_spread_pips: float = 50.0,
                  keys: tuple[str, ...] = ("symbol",), pip_size: Column | None = None) -> DataFrame:
    """Per symbol-day: hard checks (bar count, positive prices) and the first wide spread."""
    pip = pip_size_heuristic(F.col("symbol")) if pip_size is None else pip_size
    at = F.unix_micros("ts")
    bad = (F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)
    wide = F.col("spread") / pip > max_spread_pips
    day = bars.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min(F.when(bad, F.col("ts"))).alias("first_bad_price_ts"),
        F.min(F.when(wide, F.col("ts"))).alias("first_wide_spread_ts"),
        F.min_by(F.col("spread") / pip, F.when(wide, at)).alias("first_wide_spread_pips"),
    )
    few = F.col("bars") < min_bars
    warnings = F.filter(F.array(
        F.when(few, "too few bars"),
        F.when(F.col("first_bad_price_ts").isNotNull(), "non-positive price"),
        F.when(F.col("first_wide_spread_ts").isNotNull(), "wide spread"),
    ), lambda w: w.isNotNull())
    return day.withColumn("passed", ~few & F.col("first_bad_price_ts").isNull()).withColumn(
        "warnings", warnings)


def expected_slots(spans: DataFrame, step_seconds: int, keys: list[str],
                   calendar: DataFrame | None = None) -> DataFrame:
    """Open grid slots between ``first_ts`` and ``last_ts`` of each series.

    The grid is generated day by day so that a long series is spread over the cluster.
    """
    step = step_seconds * 1_000_000
    first = F.unix_micros("first_ts")
    n = F.floor((F.unix_micros("last_ts") - first) / step)
    per = max(1, 86_400 // step_seconds)
    blocks = spans.select(
        *keys, "first_ts", n.alias("_n"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(n / per))).alias("_d"),
    ).repartition(*keys, "_d")
    slot = F.explode(F.sequence(
        F.col("_d") * per, F.least(F.col("_n"), F.col("_d") * per + (per - 1))))
    grid = blocks.withColumn("_i", slot).withColumn(
        "_at", F.timestamp_micros(F.unix_micros("first_ts") + F.col("_i") * step))
    grid = with_market_open(grid.select(*keys, "_at"), "_at", "_open", calendar)
    return grid.groupBy(*keys).agg(F.count_if("_open").alias("expected"))


def data_quality(bars: DataFrame, step_seconds: int, *, min_coverage: float = 0.995,
                 spread_z_max: float = 8.0, keys: tuple[str, ...] = ("symbol", "timeframe"),
                 order: str = "ts", calendar: DataFrame | None = None) -> DataFrame:
    """One row per series and check: check, passed, severity, observed.

    ``order`` is the input position; give a sequence column to check arrival order.
    """
    ks = list(keys)
    s = index_series(bars, keys, order=order)
    s = s.with_df(with_market_open(s.df, "ts", "_open", calendar))
    s = s.windowed(lambda w: {"_before": F.lag("ts").over(w),
                              "_open_before": F.lag("_open").over(w)}, back=1)
    delta = (F.unix_micros("ts") - F.unix_micros("_before")) / 1e6
    spread = F.col("spread")
    base = s.df.withColumn("_gap", F.coalesce(
        F.col("_open") & F.col("_open_before") & (delta > step_seconds * 1.5), F.lit(False)))
    one = base.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ts") <= F.col("_before")).alias("disorder"),
        F.count_if(F.col("ts") == F.col("_before")).alias("dupes"),
        F.count_if(F.col("ask") < F.col("bid")).alias("bad_quotes"),
        F.count(spread).alias("n_spread"), F.avg(spread).alias("mu"),
        F.stddev_pop(spread).alias("sd"), F.max(spread).alias("hi"), F.min(spread).alias("lo"),
        F.count_if(spread < 0).alias("negative"),
        F.count_if("_open").alias("present"),
        F.count_if("_gap").alias("gaps"), F.count_if(~F.col("_open")).alias("closed"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    if order != "ts":  # in time order equal instants are neighbours and already counted
        one = one.drop("dupes").join(base.groupBy(*ks, "ts").count().groupBy(*ks).agg(
            F.sum(F.col("count") - 1).alias("dupes")), ks)
    z = F.abs(F.col("spread") - F.col("mu")) / F.col("sd")
    far = base.join(one.select(*ks, "mu", "sd"), ks).groupBy(*ks).agg(
        F.count_if(F.coalesce((F.col("sd") > 0) & (z > spread_z_max), F.lit(False)))
        .alias("outliers"))
    grid = expected_slots(one, step_seconds, ks, calendar)
    row = one.join(far, ks).join(grid, ks).withColumn(
        "coverage", F.when(F.col("expected") > 0, F.col("present") / F.col("expected"))
        .otherwise(1.0))

    def check(name: str, ok: Column, severity: str, seen: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), ok.alias("passed"),
                        F.lit(severity).alias("severity"), seen.cast("double").alias("observed"))

    def none_of(name: str, severity: str, col: str) -> Column:
        return check(name, F.col(col) == 0, severity, F.col(col))

    quoted = F.col("n_spread") >= 2
    checks = F.filter(F.array(
        none_of("monotonic_timestamps", HIGH, "disorder"),
        none_of("no_duplicate_timestamps", HIGH, "dupes"),
        none_of("valid_bid_ask", HIGH, "bad_quotes"),
        F.when(quoted, none_of("no_negative_spread", HIGH, "negative")),
        F.when(quoted, none_of("spread_outliers", MEDIUM, "outliers")),
        check("coverage", F.col("coverage") >= min_coverage, HIGH, F.col("coverage")),
        none_of("intra_session_gaps", MEDIUM, "gaps"),
        none_of("no_closed_market_data", HIGH, "closed"),
    ), lambda c: c.isNotNull())
    return row.select(*ks, F.explode(checks).alias("c")).select(*ks, "c.*")


def with_missing_series(report: DataFrame, wanted: DataFrame,
                        keys: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """Adds the failed non_empty check for wanted series that have no bars at all."""
    absent = wanted.select(*keys).distinct().join(
        report.select(*keys).distinct(), list(keys), "left_anti")
    return report.unionByName(absent.select(
        *keys, F.lit("non_empty").alias("check"), F.lit(False).alias("passed"),
        F.lit(HIGH).alias("severity"), F.lit(0.0).alias("observed")))


def verdict(report: DataFrame, keys: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """passed = every high-severity check passed; failures = names of all failed checks."""
    failed = F.when(~F.col("passed"), F.col("check"))
    return report.groupBy(*keys).agg(
        F.bool_and(F.col("passed") | (F.col("severity") != HIGH)).alias("passed"),
        F.sort_array(F.collect_set(failed)).alias("failures"),
    )
