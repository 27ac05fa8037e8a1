"""Small fixed dimensions. Each has a handful of rows, so broadcasting them is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Instruments (symbol, feed symbol, class, pip size, precision, pip value, sessions).
INSTRUMENTS = [
    ("EUR/USD", "EUR_USD", "FX", 0.0001, 5, 10.0, ["LONDON", "NEWYORK", "OVERLAP"]),
    ("GBP/USD", "GBP_USD", "FX", 0.0001, 5, 10.0, ["LONDON", "OVERLAP"]),
    ("USD/JPY", "USD_JPY", "FX", 0.01, 3, 9.0, ["ASIA", "NEWYORK"]),
    ("XAU/USD", "XAU_USD", "METAL", 0.1, 2, 10.0, ["LONDON", "NEWYORK", "OVERLAP"]),
]
# Cost profile per symbol (spread floor, commission/side/lot, fixed slip, ATR k).
COST_PROFILES = [
    ("EUR/USD", 0.8, 3.5, 0.3, 0.05),
    ("GBP/USD", 1.2, 3.5, 0.4, 0.06),
    ("USD/JPY", 0.9, 3.5, 0.3, 0.05),
    ("XAU/USD", 20.0, 5.0, 10.0, 0.10),
]
# Liquidity multipliers by session and the news multiplier.
SESSION_MULTIPLIERS = {"ASIA": 1.5, "LONDON": 1.0, "NEWYORK": 1.0, "OVERLAP": 1.0}
NEWS_MULTIPLIER = 5.0
STRESS_FACTORS = (1.0, 1.25, 1.5)
# Trading sessions (name, zone, local start hour, local end hour).
SESSIONS = [
    ("ASIA", "Asia/Tokyo", 9, 18),
    ("LONDON", "Europe/London", 8, 16),
    ("NEWYORK", "America/New_York", 8, 17),
]


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        INSTRUMENTS,
        "symbol STRING, oanda_symbol STRING, asset_class STRING, pip_size DOUBLE, "
        "price_precision INT, pip_value_per_lot DOUBLE, best_sessions ARRAY<STRING>",
    )


def cost_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        COST_PROFILES,
        "symbol STRING, spread_floor_pips DOUBLE, commission_per_side_per_lot DOUBLE, "
        "slippage_fixed_pips DOUBLE, slippage_atr_k DOUBLE",
    )
