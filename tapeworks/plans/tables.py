"""The given tables mapped to the domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators.bars import ticks_to_bars
from tapeworks.operators.series import Series, index_series

KEYS = ("symbol", "timeframe")
HALF_SPREAD = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a tick tape; event_id is the input order."""
    size = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), (F.col("value") + HALF_SPREAD).alias("ask"),
        (F.col("value") - HALF_SPREAD).alias("bid"), size.alias("ask_vol"), size.alias("bid_vol"),
    )


def bars(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf_dir), minutes)


def series(spark: SparkSession, sf_dir: str, minutes: int) -> Series:
    return index_series(bars(spark, sf_dir, minutes), KEYS)


TICKS_SQL = """
ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value + 0.01 AS ask, value - 0.01 AS bid,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vol
  FROM events)"""

_LABEL = {1: "1m", 5: "5m", 15: "15m", 30: "30m", 60: "1h", 240: "4h", 1440: "1d"}


def bars_sql(minutes: int, name: str = "b") -> str:
    """CTE body of indexed bars."""
    return f"""
{name} AS (
  SELECT *, ask - bid AS spread, '{_LABEL[minutes]}' AS timeframe,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k
  FROM (
    SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts,
           arg_min((ask + bid) / 2, seq) AS open, max((ask + bid) / 2) AS high,
           min((ask + bid) / 2) AS low, arg_max((ask + bid) / 2, seq) AS close,
           sum(vol) AS volume, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask
    FROM ticks GROUP BY 1, 2))"""


def with_bars(minutes: int, *ctes: str, select: str) -> str:
    parts = [TICKS_SQL, bars_sql(minutes), *ctes]
    return "WITH RECURSIVE " + ",".join(p for p in parts if p) + "\n" + select


TR_SQL = """
tr AS (
  SELECT *, CASE WHEN k = 0 THEN high - low ELSE greatest(high - low,
         abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY k))"""


def tr_sql(src: str = "b") -> str:
    return TR_SQL.format(src=src)


def mean_seeded_sql(name: str, src: str, col: str, period: int, alpha: str) -> str:
    """Recursive CTE (symbol, k, y): mean of the first rows, then the fading recurrence."""
    return f"""
{name} AS (
  SELECT symbol, CAST({period} - 1 AS BIGINT) AS k, avg({col}) AS y FROM {src}
  WHERE k < {period} GROUP BY symbol HAVING count(*) = {period}
  UNION ALL
  SELECT e.symbol, s.k, {alpha} * s.{col} + (1 - {alpha}) * e.y
  FROM {name} e JOIN {src} s ON s.symbol = e.symbol AND s.k = e.k + 1)"""


def ema_mean_sql(name: str, period: int, src: str = "b", col: str = "close") -> str:
    return mean_seeded_sql(name, src, col, period, f"(2.0::DOUBLE / ({period} + 1))")


def rma_sql(name: str, period: int, src: str = "tr", col: str = "tr") -> str:
    return mean_seeded_sql(name, src, col, period, f"(1.0::DOUBLE / {period})")


def ema_first_sql(name: str, period: int, src: str = "b", col: str = "close") -> str:
    a = f"(2.0::DOUBLE / ({period} + 1))"
    return f"""
{name}_all AS (
  SELECT symbol, k, {col} AS y FROM {src} WHERE k = 0
  UNION ALL
  SELECT e.symbol, s.k, {a} * s.{col} + (1 - {a}) * e.y
  FROM {name}_all e JOIN {src} s ON s.symbol = e.symbol AND s.k = e.k + 1),
{name} AS (SELECT symbol, k, y FROM {name}_all WHERE k >= {period} - 1)"""


def tsi_sql(name: str = "tsi", src: str = "b", long: int = 25, short: int = 13,
            signal: int = 13) -> str:
    """CTE (symbol, k, tsi, tsi_signal) of rows past the warm-up."""
    cl, cs, cg = (f"(2.0::DOUBLE / ({p} + 1))" for p in (long, short, signal))
    return f"""
{name}_m AS (
  SELECT symbol, k, close - lag(close) OVER (PARTITION BY symbol ORDER BY k) AS m FROM {src}),
{name}_r AS (
  SELECT symbol, k, m AS a1, abs(m) AS b1, 1 AS n1, NULL::DOUBLE AS a2, NULL::DOUBLE AS b2,
         0 AS n2, NULL::DOUBLE AS sig, 0 AS n3, NULL::DOUBLE AS val
  FROM {name}_m WHERE k = 1
  UNION ALL
  SELECT symbol, k, xa1, xb1, xn1, xa2, xb2, xn2,
         CASE WHEN xd THEN CASE WHEN n3 = 0 THEN xval ELSE {cg} * xval + (1 - {cg}) * sig END
              ELSE sig END,
         n3 + xd::INT, xval
  FROM (
    SELECT *, CASE WHEN xe THEN CASE WHEN n2 = 0 THEN xa1
                   ELSE {cs} * xa1 + (1 - {cs}) * a2 END ELSE a2 END AS xa2,
           CASE WHEN xe THEN CASE WHEN n2 = 0 THEN xb1
                   ELSE {cs} * xb1 + (1 - {cs}) * b2 END ELSE b2 END AS xb2,
           n2 + xe::INT AS xn2, n2 + xe::INT >= {short} AND xb2 <> 0 AS xd,
           CASE WHEN n2 + xe::INT >= {short} AND xb2 <> 0 THEN 100.0 * xa2 / xb2 END AS xval
    FROM (
      SELECT r.symbol, s.k, r.a2, r.b2, r.n2, r.sig, r.n3,
             {cl} * s.m + (1 - {cl}) * r.a1 AS xa1, {cl} * abs(s.m) + (1 - {cl}) * r.b1 AS xb1,
             r.n1 + 1 AS xn1, r.n1 + 1 >= {long} AS xe
      FROM {name}_r r JOIN {name}_m s ON s.symbol = r.symbol AND s.k = r.k + 1))),
{name} AS (SELECT symbol, k, val AS tsi, sig AS tsi_signal FROM {name}_r
           WHERE val IS NOT NULL AND n3 >= {signal})"""


def supertrend_sql(name: str, atr: str, src: str = "b", mult: float = 3.0) -> str:
    """CTE (symbol, k, lo, up, dir) following the bands row by row."""
    return f"""
{name}_x AS (
  SELECT s.symbol, s.k, s.close, (s.high + s.low) / 2 - {mult} * a.y AS rl,
         (s.high + s.low) / 2 + {mult} * a.y AS ru
  FROM {src} s JOIN {atr} a ON a.symbol = s.symbol AND a.k = s.k),
{name} AS (
  SELECT symbol, k, rl AS lo, ru AS up, 1 AS dir FROM {name}_x
  WHERE (symbol, k) IN (SELECT (symbol, min(k)) FROM {name}_x GROUP BY symbol)
  UNION ALL
  SELECT x.symbol, x.k, greatest(x.rl, p.lo), least(x.ru, p.up),
         CASE WHEN p.dir = -1 AND x.close > least(x.ru, p.up) THEN 1
              WHEN p.dir = 1 AND x.close < greatest(x.rl, p.lo) THEN -1 ELSE p.dir END
  FROM {name} p JOIN {name}_x x ON x.symbol = p.symbol AND x.k = p.k + 1)"""


WEEKLY_SQL = """
wk AS (
  SELECT symbol, date_trunc('week', ts) AS week_start, max(high) AS wh, min(low) AS wl
  FROM b GROUP BY 1, 2),
wkp AS (
  SELECT symbol, week_start, lag(wh) OVER w AS prev_high, lag(wl) OVER w AS prev_low,
         lag(wh, 2) OVER w AS older_high, lag(wl, 2) OVER w AS older_low
  FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY week_start)),
lv AS (
  SELECT b.*, wkp.week_start, prev_high, prev_low, older_high, older_low,
         CASE WHEN prev_high IS NOT NULL THEN max(high) OVER w END AS curr_high,
         CASE WHEN prev_high IS NOT NULL THEN min(low) OVER w END AS curr_low
  FROM b JOIN wkp ON b.symbol = wkp.symbol AND date_trunc('week', b.ts) = wkp.week_start
  WINDOW w AS (PARTITION BY b.symbol, wkp.week_start ORDER BY b.k))"""

BOS_SQL = """
first_break AS (
  SELECT symbol, week_start, min(k) AS k0 FROM lv
  WHERE close > prev_high OR close < prev_low GROUP BY 1, 2),
broke AS (
  SELECT f.symbol, f.week_start, f.k0, l.close > l.prev_high AS up,
         CASE WHEN l.close > l.prev_high THEN l.prev_high ELSE l.prev_low END AS bos_level,
         (SELECT max(o.k) FROM lv o WHERE o.symbol = f.symbol AND o.k BETWEEN f.k0 - 20 AND f.k0 - 1
          AND CASE WHEN l.close > l.prev_high THEN o.open > o.close ELSE o.close > o.open END
         ) AS ob_k
  FROM first_break f JOIN lv l ON l.symbol = f.symbol AND l.k = f.k0),
bos AS (
  SELECT lv.*, CASE WHEN lv.prev_high IS NULL THEN NULL
                    WHEN br.k0 IS NULL OR lv.k < br.k0 THEN 'IDLE'
                    WHEN br.up THEN 'BOS_UP' ELSE 'BOS_DOWN' END AS bos,
         CASE WHEN lv.k >= br.k0 THEN br.bos_level END AS bos_level,
         CASE WHEN lv.k >= br.k0 THEN o.high END AS ob_high,
         CASE WHEN lv.k >= br.k0 THEN o.low END AS ob_low,
         CASE WHEN lv.prev_high IS NOT NULL
              THEN coalesce(lv.prev_high < older_high, false) END AS choch_bearish,
         CASE WHEN lv.prev_high IS NOT NULL
              THEN coalesce(lv.prev_low > older_low, false) END AS choch_bullish
  FROM lv LEFT JOIN broke br ON br.symbol = lv.symbol AND br.week_start = lv.week_start
  LEFT JOIN b o ON o.symbol = br.symbol AND o.k = br.ob_k)"""
