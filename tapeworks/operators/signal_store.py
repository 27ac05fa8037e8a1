"""Signal table operations: lifecycle merges, confidence statistics and score analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import wilson_lower

_CLOSED = ("win", "loss")
COMPONENTS = ("structure", "momentum", "session", "cost")
_OUTCOMES = ("outcome_pnl_pips", "outcome_bars_held", "max_adverse_pips", "max_favor_pips")


def insert_ignore(table: DataFrame, incoming: DataFrame, key: str = "id",
                  order: str | None = None) -> DataFrame:
    """Incoming rows to append: unknown keys only, the first of each key."""
    fresh = incoming.join(table.select(key), key, "left_anti")
    if order is None:
        return fresh.dropDuplicates([key])
    w = Window.partitionBy(key).orderBy(order)
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_status(table: DataFrame, events: DataFrame) -> DataFrame:
    """Table after an ordered status log (id, seq, status, status_ts, outcomes).

    Status and its time come from the last event; each outcome keeps its last non-null value
    and falls back to the stored one.
    """
    agg = events.groupBy("id").agg(
        F.max_by("status", "seq").alias("_status"), F.max_by("status_ts", "seq").alias("_status_ts"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in _OUTCOMES])
    out = table.join(agg, "id", "left")
    cols = ("status", "status_ts", *_OUTCOMES)
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).drop(*[f"_{c}" for c in cols])


def win_rate(signals: DataFrame, lo: int, hi: int, regime: str = "any", min_samples: int = 1) -> DataFrame:
    """(rate, n) of closed signals in a score band; (0.5, 0) below the sample minimum."""
    rows = signals.where(F.col("status").isin(*_CLOSED) & F.col("score_total").between(lo, hi))
    if regime != "any":
        rows = rows.where(F.col("regime") == regime)
    n, w = F.count(F.lit(1)), F.count_if(F.col("status") == "win")
    enough = F.col("n") >= max(min_samples, 1)
    return rows.agg(n.alias("n"), w.alias("w")).select(
        F.when(enough, F.col("w") / F.col("n")).otherwise(0.5).alias("win_rate"),
        F.when(enough, F.col("n")).otherwise(0).alias("sample_size"))


def win_rates(signals: DataFrame, bands: list[tuple[int, int]], min_samples: int = 1) -> DataFrame:
    """(lo, rate, n) of every score band in one pass over the table; bands may overlap."""
    c = F.col
    closed = [c("status").isin(*_CLOSED) & c("score_total").between(lo, hi) for lo, hi in bands]
    sums = signals.agg(*[F.struct(F.lit(lo).alias("lo"), F.count_if(in_band).alias("n"),
                                  F.count_if(in_band & (c("status") == "win")).alias("w")).alias(f"_{i}")
                         for i, ((lo, _), in_band) in enumerate(zip(bands, closed))])
    rows = sums.select(F.explode(F.array(*[f"_{i}" for i in range(len(bands))])).alias("b")).select("b.*")
    enough = c("n") >= max(min_samples, 1)
    return rows.select("lo", F.when(enough, c("w") / c("n")).otherwise(0.5).alias("win_rate"),
                       F.when(enough, c("n")).otherwise(0).alias("sample_size"))


def score_histogram(signals: DataFrame, by_regime: bool = False) -> DataFrame:
    """Wins and closed count per score (at most 101 scores per regime)."""
    keys = (["regime"] if by_regime else []) + ["score_total"]
    return signals.where(F.col("status").isin(*_CLOSED)).groupBy(*keys).agg(
        F.count_if(F.col("status") == "win").alias("w"), F.count(F.lit(1)).alias("n"))


def confidence_table(signals: DataFrame, *, by_regime: bool = False, band: int = 10,
                     z: float = 1.645, min_samples: int = 20) -> DataFrame:
    """Confidence of every score 0..100, per regime if asked.

    History is reduced to a histogram first; each histogram row then feeds the scores whose
    band covers it, so the table has a fixed size however many signals there are.
    """
    keys = ["regime"] if by_regime else []
    h = score_histogram(signals, by_regime)
    reach = F.explode(F.sequence(
        F.greatest(F.col("score_total") - band, F.lit(0)),
        F.least(F.col("score_total") + band, F.lit(100))))
    g = h.select(*keys, reach.alias("score"), "w", "n").groupBy(*keys, "score").agg(
        F.sum("w").alias("w"), F.sum("n").alias("n"))
    ok = F.col("n") >= min_samples
    label = F.when(F.col("n") >= 50, "ESTABLISHED").when(F.col("n") >= 20, "DEVELOPING").otherwise("INSUFFICIENT")
    return g.select(
        *keys, "score",
        F.when(ok, wilson_lower(F.col("w").cast("double"), F.col("n").cast("double"), z)).otherwise(0.5)
        .alias("confidence_pct"),
        F.when(ok, F.col("n")).otherwise(0).alias("confidence_n"),
        F.when(ok, label).otherwise("INSUFFICIENT").alias("confidence_label"))


def with_confidence(rows: DataFrame, table: DataFrame, *, score: str = "score_total",
                    keys: list[str] | None = None) -> DataFrame:
    """Attach confidence by score; scores without history get (0.5, 0, INSUFFICIENT).

    The table has at most 101 rows per regime; Catalyst or AQE broadcasts it by measured size.
    """
    keys = keys or []
    t = table.withColumnRenamed("score", score)
    out = rows.join(t, [*keys, score], "left")
    return out.fillna({"confidence_pct": 0.5, "confidence_n": 0, "confidence_label": "INSUFFICIENT"})


def score_breakdown(signals: DataFrame) -> DataFrame:
    s = F.col("score_total")
    bucket = F.when(s < 50, "LOW (0-49)").when(s < 70, "MEDIUM (50-69)").otherwise("HIGH (70-100)")
    st = F.col("status")
    return signals.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(st == "win").alias("wins"),
        F.count_if(st == "loss").alias("losses"), F.count_if(st == "expired").alias("expired"),
        F.round(F.avg(F.when(st.isin(*_CLOSED), F.col("outcome_pnl_pips"))), 1).alias("avg_pnl_pips"),
    )


def component_correlations(signals: DataFrame, min_rows: int = 30) -> DataFrame:
    """One row of Pearson r per component against winning; no row below ``min_rows``."""
    won = F.when(F.col("status") == "win", 1.0).otherwise(0.0)
    closed = signals.where(F.col("status").isin(*_CLOSED))
    row = closed.agg(F.count(F.lit(1)).alias("n"), *[
        F.corr(F.col(f"score_{c}").cast("double"), won).alias(c) for c in COMPONENTS])
    clean = [F.round(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), 3).alias(c) for c in COMPONENTS]
    return row.where(F.col("n") >= min_rows).select(*clean)


def suggest_weights(corr: DataFrame) -> DataFrame:
    """Weights summing to 100 from positive correlations, at least 5 each; the rounding rest
    goes to the largest (first on ties). No row without a positive correlation or when the
    adjusted weights would be invalid."""
    pos = {c: F.greatest(F.col(c), F.lit(0.0)) for c in COMPONENTS}
    total = sum(pos.values())
    df = corr.withColumn("_t", total).where("_t > 0")
    raw = {c: F.greatest(F.bround(pos[c] / F.col("_t") * 100).cast("int"), F.lit(5)) for c in COMPONENTS}
    df = df.select(*[raw[c].alias(c) for c in COMPONENTS])
    vals = [F.col(c) for c in COMPONENTS]
    rest = F.lit(100) - sum(vals[1:], vals[0])
    top = F.greatest(*vals)
    out, taken = [], F.lit(False)
    for c, v in zip(COMPONENTS, vals):
        mine = (v == top) & ~taken
        out.append(F.when(mine, v + rest).otherwise(v).alias(c))
        taken = taken | (v == top)
    return df.select(*out)


def recent(signals: DataFrame, n: int = 20) -> DataFrame:
    """Newest first; a top-k, not a full sort."""
    return signals.orderBy(F.col("ts").desc(), F.col("id")).limit(n)


def month_rows(signals: DataFrame, year: int, month: int) -> DataFrame:
    """One calendar month as a half-open range, which reaches the scan as a filter."""
    start = F.make_timestamp(*[F.lit(x) for x in (year, month, 1, 0, 0, 0)])
    nxt = (year + month // 12, month % 12 + 1)
    end = F.make_timestamp(*[F.lit(x) for x in (*nxt, 1, 0, 0, 0)])
    return signals.where((F.col("ts") >= start) & (F.col("ts") < end))


def kept_after_purge(signals: DataFrame, year: int, month: int) -> DataFrame:
    return signals.where(F.col("ts") >= F.make_timestamp(*[F.lit(x) for x in (year, month, 1, 0, 0, 0)]))


def reconcile(positions: DataFrame, signals: DataFrame) -> DataFrame:
    """Boot actions from open positions (symbol, direction, entry_signal_id) and the table.

    Open without link: none; link to a row that is not open: clear_link; linked: ok; flat:
    every open signal of the symbol expires.
    """
    live = signals.where(F.col("status").isin("confirmed", "active")).select(
        F.col("symbol").alias("_sym"), F.col("id").alias("signal_id"))
    held = positions.where(F.col("direction") != "FLAT")
    linked = held.join(live, F.col("entry_signal_id") == F.col("signal_id"), "left").select(
        "symbol", F.col("entry_signal_id").alias("signal_id"),
        F.when(F.col("entry_signal_id").isNull(), "none")
        .when(F.col("_sym").isNull(), "clear_link").otherwise("ok").alias("action"))
    flat = positions.where(F.col("direction") == "FLAT").join(live, F.col("symbol") == F.col("_sym"))
    return linked.unionByName(flat.select("symbol", "signal_id", F.lit("expire").alias("action")))


def alert_decision(rows: DataFrame, *, threshold: Column | int, keys: tuple[str, ...] = ("symbol",),
                   order: Column | str = "ts", sent: DataFrame | None = None) -> DataFrame:
    """First failing gate per row, or NULL when the alert goes out.

    Needs confluence, halted, m15_signal, direction, score_total, news_blocked, h4_ts. The last
    gate compares (direction, h4_ts) with the last alert sent: a row that another gate stops
    leaves no trace, and a duplicate repeats the pair, so the row before among those that pass
    all other gates decides. Equal pairs share h4_ts, so windows reach over one such bar only.
    ``sent`` holds earlier alerts (keys, ``order``, direction, h4_ts).
    """
    c = F.col
    other = (
        F.when(~c("confluence"), "no confluence").when(c("halted"), "halted")
        .when(c("m15_signal") != c("direction"), "fast frame disagrees")
        .when(c("score_total") < threshold, "score below threshold")
        .when(c("news_blocked"), "news window")
    )
    judged = rows.withColumn("_other", other).withColumn("_sent", F.lit(False))
    if sent is not None:
        judged = judged.unionByName(
            sent.withColumn("_other", F.lit(None).cast("string")).withColumn("_sent", F.lit(True)),
            allowMissingColumns=True)
    w = Window.partitionBy(*keys, "h4_ts", c("_other").isNull()).orderBy(order)
    again = c("h4_ts").isNotNull() & (F.lag("direction").over(w) == c("direction"))
    reason = F.coalesce("_other", F.when(again, "duplicate"))
    return judged.withColumn("reject_reason", reason).where(~c("_sent")).drop("_other", "_sent")
