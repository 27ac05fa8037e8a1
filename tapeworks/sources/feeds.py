"""JSON payloads: bar API pages, economic calendars, price events, subscriber rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType
from pyspark.sql.types import ArrayType, StructType

from tapeworks.functions.scalars import falsy, normalize_names, normalize_symbol
from tapeworks.functions.timeexpr import with_market_open
from tapeworks.operators import quality
from tapeworks.schemas import BAR_PAYLOAD_DDL, NEWS_ROW_DDL, PRICE_EVENT_DDL, schema
from tapeworks.sources.tables import dedupe

# Currencies whose high-impact events matter.
NEWS_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "XAU")


def bars_from_payload(pages: DataFrame, *, start: Column, end: Column, pip_size: Column,
                      nominal_spread_pips: float = 2.0) -> DataFrame:
    """Bars from pages with ``meta`` and ``values``: casts, range, first copy per instant,
    repaired extremes and a synthetic quote around the close."""
    rows = pages.select(
        F.col("meta.symbol").alias("symbol"), F.col("meta.interval").alias("timeframe"),
        F.posexplode("values").alias("_pos", "v"))
    when = F.coalesce(
        F.try_to_timestamp(F.col("v.datetime"), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.col("v.datetime"), F.lit("yyyy-MM-dd")))
    px = {c: F.col(f"v.{c}").cast("double").alias(c) for c in ("open", "high", "low", "close")}
    b = rows.select("symbol", "timeframe", "_pos", when.alias("ts"), *px.values())
    b = b.where((F.col("ts") >= start) & (F.col("ts") <= end))
    b = dedupe(b, ["symbol", "timeframe", "ts"], ["_pos"]).drop("_pos")
    spread = pip_size * nominal_spread_pips
    return b.withColumns({
        "high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close"),
        "volume": F.lit(0.0), "bid": F.col("close") - spread / 2, "ask": F.col("close") + spread / 2,
        "spread": spread, "source": F.lit("api"),
    })


def read_bar_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema(BAR_PAYLOAD_DDL)).option("multiLine", True).json(path)


def gated_open_bars(bars: DataFrame, step_seconds: int) -> DataFrame:
    """Open-market bars of the series whose quality report passes."""
    b = with_market_open(bars).where("is_open").drop("is_open")
    keys = ["symbol", "timeframe"]
    ok = quality.verdict(quality.data_quality(b, step_seconds)).where("passed").select(*keys)
    return b.join(ok, keys, "left_semi")


def news_events(payload: DataFrame) -> DataFrame:
    """High-impact events of relevant currencies from raw JSON text (``value``), whether the
    rows sit under result.rows or directly in result; bad dates are dropped."""
    row = schema(NEWS_ROW_DDL)
    nested = StructType().add("result", StructType().add("rows", ArrayType(row)))
    flat = StructType().add("result", ArrayType(row))
    a = F.from_json("value", nested)["result"]["rows"]
    b = F.from_json("value", flat)["result"]
    e = payload.select(F.explode(F.coalesce(a, b)).alias("e")).select("e.*")
    at = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = e.select(
        at.alias("event_ts"), F.coalesce("event", F.lit("Unknown")).alias("name"), "country",
        F.initcap(F.lower("impact")).alias("impact"), F.upper("currency").alias("currency"))
    return out.where(
        F.col("event_ts").isNotNull() & (F.col("impact") == "High")
        & F.col("currency").isin(*NEWS_CURRENCIES))


def price_ticks(raw: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Ticks from JSON price events in ``value`` (batch or streaming).

    Missing bid or ask falls back to the price, missing volume to 0, missing timestamp to the
    last trade time; other events, unknown symbols and unparseable rows are dropped. A price of 0 is one.
    """
    e = raw.select(F.from_json("value", schema(PRICE_EVENT_DDL)).alias("e")).select("e.*")
    price = F.col("price").try_cast("double")
    at = F.coalesce(F.nullif("timestamp", F.lit(0)), F.nullif("last_trade_time", F.lit(0)))
    vol = F.coalesce(falsy(F.col("last_volume")), F.lit(0.0))
    t = e.where(F.col("event") == "price").select(
        normalize_symbol(F.col("symbol")).alias("symbol"), F.timestamp_seconds(at).alias("ts"), price.alias("price"),
        F.coalesce(falsy(F.col("bid")), price).alias("bid"), F.coalesce(falsy(F.col("ask")), price).alias("ask"),
        vol.alias("volume"))
    t = t.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & F.col("price").isNotNull())
    return t.where(F.col("symbol").isin(*known)) if known else t


def subscribers(rows: DataFrame) -> DataFrame:
    """Subscriber rows with ``prefs``, JSON text or VARIANT, read and normalised; what it lacks or has in
    another type counts as absent. banned defaults to false."""
    doc = F.col("prefs") if isinstance(rows.schema["prefs"].dataType, VariantType) else F.try_parse_json("prefs")
    pairs, sessions = (F.try_variant_get(doc, f"$.{name}", "array<string>") for name in ("pairs", "sessions"))
    score = F.try_variant_get(doc, "$.min_score", "int")
    clean = F.struct(
        normalize_names(pairs).alias("pairs"),
        normalize_names(sessions, {"NY": "NEWYORK"}).alias("sessions"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(score, F.lit(0)))).alias("min_score"))
    banned = F.coalesce("banned", F.lit(False)) if "banned" in rows.columns else F.lit(False)
    return rows.withColumn("banned", banned).withColumn("prefs", clean)
