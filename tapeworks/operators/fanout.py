"""Matching signals with subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREE_DELAY_SECONDS = 1800


def _delay(tier: Column, free_delay: int) -> Column:
    return F.when(F.lower(tier).isin("premium", "pro"), 0).otherwise(free_delay)


def _reach(users: DataFrame, free_delay: int) -> DataFrame:
    """One row per (user, pair, session) of users who are not banned."""
    return (
        users.where(~F.coalesce(F.col("banned"), F.lit(False)))
        .withColumn("symbol", F.explode(F.array_distinct("prefs.pairs")))
        .withColumn("session", F.explode(F.array_distinct("prefs.sessions")))
        .select("telegram_id", "symbol", "session", F.col("prefs.min_score").alias("min_score"),
                _delay(F.col("tier"), free_delay).alias("delay_seconds"))
    )


def select_recipients(signals: DataFrame, users: DataFrame, *, free_delay: int = FREE_DELAY_SECONDS,
                      salts: int = 16) -> DataFrame:
    """Deliveries of a batch of signals (id, ts, symbol, session, score_total): one row per
    signal and user who should receive it, with send_at.

    Equi join on (symbol, session, salt): users of a popular pair are spread over ``salts``
    parts and each signal, the small side of a live batch, is copied once per part. Signals
    without a session reach nobody.
    """
    u = _reach(users, free_delay).withColumn("_salt", F.pmod(F.hash("telegram_id"), F.lit(salts)))
    s = signals.where(F.col("session").isNotNull()).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        s.join(u, ["symbol", "session", "_salt"]).where(F.col("score_total") >= F.col("min_score"))
        .select("id", "telegram_id", "delay_seconds", send_at(F.col("ts"), F.col("delay_seconds")).alias("send_at"))
    )


def send_at(ts: Column, delay_seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + delay_seconds.cast("bigint") * 1_000_000)


def recipient_counts(signals: DataFrame, users: DataFrame, *, free_delay: int = FREE_DELAY_SECONDS
                     ) -> DataFrame:
    """How many users each signal reaches, immediate and delayed, without listing them.

    Users shrink to a histogram over (symbol, session, min_score) and a running count over
    scores; signals of one (symbol, session, score) share one row of it.
    """
    h = _reach(users, free_delay).groupBy("symbol", "session", "min_score").agg(
        F.count_if(F.col("delay_seconds") == 0).alias("_now"),
        F.count_if(F.col("delay_seconds") > 0).alias("_later"))
    steps = signals.where(F.col("session").isNotNull()).select(
        "symbol", "session", F.col("score_total").alias("min_score")).distinct()
    w = Window.partitionBy("symbol", "session").orderBy("min_score").rangeBetween(
        Window.unboundedPreceding, 0)
    grid = steps.join(h, ["symbol", "session", "min_score"], "full").select(
        "symbol", "session", F.col("min_score").alias("score_total"),
        F.coalesce(F.sum("_now").over(w), F.lit(0)).alias("immediate"),
        F.coalesce(F.sum("_later").over(w), F.lit(0)).alias("delayed"))
    return signals.join(grid, ["symbol", "session", "score_total"], "left").fillna(
        0, ["immediate", "delayed"])


def by_tier(users: DataFrame, tier: str | None = None) -> DataFrame:
    """Users ordered by id, optionally of one tier."""
    rows = users if tier is None else users.where(F.lower("tier") == tier.lower())
    return rows.orderBy("telegram_id")
