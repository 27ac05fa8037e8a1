"""Declared schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql.types import StructType

BAR_DDL = (
    "symbol STRING, timeframe STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, "
    "close DOUBLE, volume DOUBLE, bid DOUBLE, ask DOUBLE, spread DOUBLE, source STRING"
)
TICK_DDL = (
    "symbol STRING, ts TIMESTAMP, seq BIGINT, ask DOUBLE, bid DOUBLE, ask_vol DOUBLE, bid_vol DOUBLE"
)
PRICE_EVENT_DDL = (
    "event STRING, symbol STRING, price STRING, bid STRING, ask STRING, last_volume STRING, "
    "timestamp BIGINT, last_trade_time BIGINT"
)
BAR_PAYLOAD_DDL = (
    "meta STRUCT<symbol: STRING, interval: STRING>, status STRING, message STRING, code INT, "
    "values ARRAY<STRUCT<datetime: STRING, open: STRING, high: STRING, low: STRING, close: STRING>>"
)
NEWS_ROW_DDL = (
    "id STRING, date STRING, country STRING, event STRING, type STRING, actual STRING, "
    "estimate STRING, previous STRING, impact STRING, currency STRING"
)
TRADE_DDL = (
    "run_id STRING, trade_no BIGINT, entry_ts TIMESTAMP, exit_ts TIMESTAMP, symbol STRING, "
    "pnl DOUBLE, session STRING, regime STRING"
)
JOURNAL_DDL = (
    "symbol STRING, direction STRING, entry_ts TIMESTAMP, exit_ts TIMESTAMP, entry_price DOUBLE, "
    "exit_price DOUBLE, sl_at_entry DOUBLE, tp_at_entry DOUBLE, exit_kind STRING, pnl DOUBLE, "
    "n_bars_held INT"
)
SIGNAL_DDL = (
    "id STRING, ts TIMESTAMP, symbol STRING, source STRING, direction STRING, h4_signal STRING, "
    "h1_signal STRING, m15_signal STRING, confluence BOOLEAN, entry_price DOUBLE, sl DOUBLE, "
    "tp DOUBLE, rr DOUBLE, sl_pips DOUBLE, score_total INT, score_structure INT, "
    "score_momentum INT, score_session INT, score_cost INT, score_label STRING, "
    "score_weights STRING, confidence_pct DOUBLE, confidence_n INT, confidence_label STRING, "
    "regime STRING, status STRING, status_ts TIMESTAMP, outcome_pnl_pips DOUBLE, "
    "outcome_bars_held INT, max_adverse_pips DOUBLE, max_favor_pips DOUBLE, created_at TIMESTAMP"
)
RECORD_DDL = (
    "_type STRING, week_start STRING, symbol STRING, prev_high DOUBLE, prev_low DOUBLE, "
    "week_high DOUBLE, week_low DOUBLE, recorded_at STRING, ts STRING, h4_signal STRING, "
    "h1_signal STRING, m15_signal STRING, confluence BOOLEAN, entry_price DOUBLE, sl DOUBLE, "
    "tp DOUBLE, source STRING"
)
TRIAL_DDL = (
    "strategy STRING, instrument STRING, timeframe STRING, session STRING, "
    "params MAP<STRING, STRING>, feature_version STRING, data_version STRING, "
    "cost_model_version STRING, validation_split STRING, run_timestamp TIMESTAMP, "
    "git_commit STRING, random_seed BIGINT, observed_sharpe DOUBLE, campaign_id STRING, "
    "status STRING, result_id STRING, seq BIGINT"
)
ARTIFACT_DDL = (
    "artifact_id STRING, run_id STRING, trial_id STRING, campaign_id STRING, "
    "artifact_type STRING, data_hash STRING, feature_version STRING, cost_model_version STRING, "
    "payload MAP<STRING, DOUBLE>"
)
USER_DDL = (
    "telegram_id BIGINT, first_name STRING, username STRING, tier STRING, "
    "prefs STRUCT<pairs: ARRAY<STRING>, sessions: ARRAY<STRING>, min_score: INT>, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, banned BOOLEAN"
)


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


# The six timeframes of the multi-timeframe writer, in minutes.
TIMEFRAME_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}
