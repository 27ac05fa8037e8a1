"""Queries over the tick tape: bars, calendar, quality, indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeworks.functions import timeexpr as tx
from tapeworks.operators import bars as br
from tapeworks.operators import indicators as ind
from tapeworks.operators import quality as dq
from tapeworks.plans.registry import query
from tapeworks.plans.tables import (
    BOS_SQL, TICKS_SQL, WEEKLY_SQL, bars, bars_sql, ema_first_sql, ema_mean_sql, rma_sql, series,
    supertrend_sql, table, ticks, tr_sql, tsi_sql, with_bars,
)
from tapeworks.sources import ticks as archives
from tapeworks.storage import shared_dir

_OHLC = ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "bid", "ask",
         "spread"]
_OHLC_SQL = """SELECT symbol, timeframe, ts, round(open, 6) AS open, round(high, 6) AS high,
  round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume,
  round(bid, 6) AS bid, round(ask, 6) AS ask, round(spread, 6) AS spread FROM b"""


def _ohlc(name: str, minutes: int) -> None:
    @query(name, with_bars(minutes, select=_OHLC_SQL))
    def run(spark, sf_dir):
        return bars(spark, sf_dir, minutes).select(*_OHLC)


for _n, _m in (("ohlc_1m", 1), ("ohlc_1h", 60), ("ohlc_4h", 240), ("ohlc_1d", 1440)):
    _ohlc(_n, _m)


@query("resample_fanout", "WITH " + TICKS_SQL + "," + bars_sql(1, "m1") + """,
spread_out AS (
  SELECT m1.*, t.tf, time_bucket(to_minutes(t.mins), ts) AS bucket
  FROM m1, (VALUES ('5m', 5), ('15m', 15), ('30m', 30), ('1h', 60), ('4h', 240)) t(tf, mins))
SELECT symbol, tf AS timeframe, count(*) AS bars, round(sum(close), 4) AS close_sum,
       round(sum(high - low), 4) AS range_sum, round(sum(volume), 4) AS volume_sum, round(sum(open), 4) AS open_sum,
       round(sum(bid), 4) AS bid_sum, round(sum(ask), 4) AS ask_sum, round(sum(ask - bid), 4) AS spread_sum
FROM (SELECT symbol, tf, bucket, arg_min(open, ts) AS open, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low,
             arg_max(bid, ts) AS bid, arg_max(ask, ts) AS ask, sum(volume) AS volume FROM spread_out GROUP BY 1, 2, 3) GROUP BY 1, 2""", digits=4)
def resample_fanout(spark, sf_dir):
    """One minute set at five coarser timeframes, checked by per-timeframe totals."""
    wide = br.resample_many(bars(spark, sf_dir, 1), ["5m", "15m", "30m", "1h", "4h"])
    return wide.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("close").alias("close_sum"),
        F.sum(F.col("high") - F.col("low")).alias("range_sum"),
        F.sum("volume").alias("volume_sum"), F.sum("open").alias("open_sum"),
        *[F.sum(c).alias(f"{c}_sum") for c in ("bid", "ask", "spread")])


@query("bar_validity", with_bars(60, select="""SELECT symbol,
  low <= open AND open <= high AND low <= close AND close <= high AND ask >= bid AS valid,
  count(*) AS bars FROM b GROUP BY 1, 2"""))
def bar_validity(spark, sf_dir):
    b = bars(spark, sf_dir, 60)
    return b.groupBy("symbol", br.bar_valid().alias("valid")).agg(F.count(F.lit(1)).alias("bars"))


@query("day_validation", with_bars(15, select="""
SELECT d.*, h.ticks, h.hours_with_data FROM (
  SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS bars,
    min(ts) FILTER (WHERE least(open, high, low, close) <= 0) AS first_bad_price_ts,
    min(ts) FILTER (WHERE spread / 0.00001 > 1999.999) AS first_wide_spread_ts,
    concat_ws('; ', CASE WHEN count(*) < 50 THEN 'too few bars' END, CASE WHEN min(least(open, high, low, close)) <= 0 THEN 'non-positive price' END,
      CASE WHEN max(spread) / 0.00001 > 1999.999 THEN 'wide spread' END) AS warnings,
    count(*) >= 50 AND min(least(open, high, low, close)) > 0 AS passed
  FROM b GROUP BY 1, 2) d
JOIN (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS ticks,
             count(DISTINCT date_trunc('hour', ts)) AS hours_with_data
      FROM ticks GROUP BY 1, 2) h ON h.symbol = d.symbol AND h.day = d.day"""), dates=("day",))
def day_validation(spark, sf_dir):
    d = dq.validate_days(bars(spark, sf_dir, 15), min_bars=50, max_spread_pips=1999.999)
    h = dq.hours_with_data(ticks(spark, sf_dir))
    d = d.withColumn("warnings", F.concat_ws("; ", "warnings"))
    return d.drop("first_wide_spread_pips").join(h, ["symbol", "day"])


_HOLIDAY_SQL = """
yrs AS (SELECT CAST(unnest(generate_series({y0}, {y1})) AS BIGINT) AS y),
dd AS (SELECT CAST(d AS DATE) AS day, year(d) AS y, month(d) AS m, isodow(d) AS wd,
         row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d) AS nth,
         row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d DESC) AS nth_back
       FROM (SELECT unnest(generate_series(make_date({y0}, 1, 1), make_date({y1}, 12, 31),
                    INTERVAL 1 DAY)) AS d)),
golden AS (SELECT y, y % 19 AS a, y // 100 AS c, y % 100 AS r FROM yrs),
e1 AS (SELECT *, (19 * a + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM golden),
e2 AS (SELECT *, (32 + 2 * (c % 4) + 2 * (r // 4) - h - r % 4) % 7 AS l FROM e1),
e3 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM e2),
easter AS (SELECT y, make_date(y, s // 31, s % 31 + 1) AS d FROM e3),
hol AS (
  SELECT day, 'closed' AS kind FROM dd WHERE (m = 1 AND day(day) = 1)
     OR (m = 12 AND day(day) IN (25, 26)) OR (m = 11 AND wd = 4 AND nth = 4)
     OR (m = 1 AND wd = 1 AND nth = 3) OR (m = 2 AND wd = 1 AND nth = 3)
     OR (m = 5 AND wd = 1 AND nth_back = 1) OR (m = 9 AND wd = 1 AND nth = 1)
  UNION SELECT CASE isodow(make_date(y, 7, 4)) WHEN 6 THEN make_date(y, 7, 3)
       WHEN 7 THEN make_date(y, 7, 5) ELSE make_date(y, 7, 4) END, 'closed' FROM yrs
  UNION SELECT d - 2, 'closed' FROM easter
  UNION SELECT day + 1, 'half' FROM dd WHERE m = 11 AND wd = 4 AND nth = 4
  UNION SELECT make_date(y, 12, 24), 'half' FROM yrs)"""


def _open_sql(ts: str, kind: str) -> str:
    return f"""NOT (coalesce({kind}, '') = 'closed' OR isodow({ts}) = 6
      OR (isodow({ts}) = 5 AND hour({ts}) >= 17) OR (coalesce({kind}, '') = 'half'
      AND hour({ts}) >= 12) OR (isodow({ts}) = 7 AND hour({ts}) < 17))"""


def _local(ts: str, tz: str = "America/New_York") -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{tz}')"


@query("holiday_calendar", "WITH " + _HOLIDAY_SQL.format(y0=1990, y1=2010) + """
SELECT year(day) AS year, day, kind FROM hol
WHERE year(day) IN (SELECT DISTINCT year(o_orderdate) FROM orders)""", dates=("day",))
def holiday_calendar(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return tx.holiday_calendar(years)


def _sess_sql(ts: str, tz: str, a: int, b: int) -> str:
    return f"(hour({_local(ts, tz)}) >= {a} AND hour({_local(ts, tz)}) < {b})"


_FLAGS_SQL = f"""
fl AS (
  SELECT ts, {_sess_sql('ts', 'Asia/Tokyo', 9, 18)} AS asia,
         {_sess_sql('ts', 'Europe/London', 8, 16)} AS ldn,
         {_sess_sql('ts', 'America/New_York', 8, 17)} AS ny, value FROM events)"""
_PRIMARY_SQL = """CASE WHEN ldn AND ny THEN 'OVERLAP' WHEN ldn THEN 'LONDON' WHEN ny THEN 'NEWYORK'
  WHEN asia THEN 'ASIA' END"""


@query("session_tags", "WITH " + _FLAGS_SQL + f"""
SELECT {_PRIMARY_SQL} AS primary_session, asia::INT + ldn::INT + ny::INT + (ldn AND ny)::INT
  AS n_active, count(*) AS ticks, round(sum(value), 4) AS value_sum FROM fl GROUP BY 1, 2""", digits=4)
def session_tags(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    return ev.groupBy(
        tx.primary_session(F.col("ts")).alias("primary_session"),
        F.size(tx.active_sessions(F.col("ts"))).alias("n_active"),
    ).agg(F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("value_sum"))


@query("session_bounds", f"""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
x AS (SELECT day, timezone('UTC', timezone('Asia/Tokyo', day + INTERVAL 9 HOUR)) AS asia_start,
  timezone('UTC', timezone('Europe/London', day + INTERVAL 8 HOUR)) AS ls,
  timezone('UTC', timezone('Europe/London', day + INTERVAL 16 HOUR)) AS le,
  timezone('UTC', timezone('America/New_York', day + INTERVAL 8 HOUR)) AS ns,
  timezone('UTC', timezone('America/New_York', day + INTERVAL 17 HOUR)) AS ne FROM d)
SELECT day, asia_start, ls AS london_start, le AS london_end, ns AS newyork_start,
  ne AS newyork_end, CASE WHEN greatest(ls, ns) < least(le, ne) THEN greatest(ls, ns) END
  AS overlap_start, CASE WHEN greatest(ls, ns) < least(le, ne) THEN least(le, ne) END
  AS overlap_end FROM x""", dates=("day",))
def session_bounds(spark, sf_dir):
    day = F.col("day")
    a, _ = tx.session_bounds(day, "ASIA")
    ls, le = tx.session_bounds(day, "LONDON")
    ns, ne = tx.session_bounds(day, "NEWYORK")
    os_, oe = tx.overlap_bounds(day)
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(
        "day", a.alias("asia_start"), ls.alias("london_start"), le.alias("london_end"),
        ns.alias("newyork_start"), ne.alias("newyork_end"), os_.alias("overlap_start"),
        oe.alias("overlap_end"))


@query("market_open", f"""WITH {_HOLIDAY_SQL.format(y0=2023, y1=2025)},
t AS (SELECT ts, {_local('ts')} AS lt, value FROM events)
SELECT {_open_sql('lt', 'kind')} AS is_open,
  NOT (isodow(ts) = 6 OR (isodow(ts) = 5 AND hour(ts) >= 21) OR (isodow(ts) = 7 AND hour(ts) < 21))
  AS coarse_open, count(*) AS ticks, round(sum(value), 4) AS value_sum
FROM t LEFT JOIN hol ON hol.day = CAST(lt AS DATE) GROUP BY 1, 2""", digits=4)
def market_open(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    return tx.with_market_open(ev).groupBy(
        "is_open", tx.coarse_market_open(F.col("ts")).alias("coarse_open"),
    ).agg(F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("value_sum"))


@query("market_open_calendar", f"""WITH t AS (SELECT event_type, ts, {_local('ts')} AS lt FROM events),
hol AS (SELECT DISTINCT CAST(lt AS DATE) AS day, CASE WHEN day(lt) % 5 = 0 THEN 'closed' ELSE 'half' END AS kind FROM t WHERE day(lt) % 5 = 0 OR day(lt) % 7 = 3)
SELECT event_type, {_open_sql('lt', 'kind')} AS is_open, count(*) AS ticks FROM t LEFT JOIN hol ON hol.day = CAST(lt AS DATE) GROUP BY 1, 2""")
def market_open_calendar(spark, sf_dir):
    """Openness under a calendar of one's own: every fifth day closed, some others half."""
    ev = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    day = F.to_date(F.from_utc_timestamp("ts", tx.NEW_YORK))
    d = F.dayofmonth("day")
    own = ev.select(day.alias("day")).distinct().where((d % 5 == 0) | (d % 7 == 3)).withColumn("kind", F.when(d % 5 == 0, "closed").otherwise("half"))
    return tx.with_market_open(ev, calendar=own).groupBy("event_type", "is_open").agg(F.count(F.lit(1)).alias("ticks"))


@query("trading_day_volume", f"""
WITH {TICKS_SQL}, t AS (SELECT *, {_local('ts')} AS lt FROM ticks)
SELECT symbol, CASE WHEN hour(lt) < 17 THEN CAST(lt AS DATE) - 1 ELSE CAST(lt AS DATE) END
  AS trading_day, count(*) AS ticks, round(sum(vol), 4) AS volume FROM t GROUP BY 1, 2""", digits=4, dates=("trading_day",))
def trading_day_volume(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy(
        "symbol", tx.trading_day(F.col("ts")).alias("trading_day")
    ).agg(F.count(F.lit(1)).alias("ticks"), F.sum("ask_vol").alias("volume"))


@query("next_events", """
WITH t AS (SELECT event_id, ts, date_trunc('day', ts) AS d, isodow(ts) - 1 AS wd FROM events),
nb AS (
  SELECT event_id, ts, d, wd, h, CASE WHEN hour(ts) >= h THEN d + INTERVAL 1 DAY ELSE d END AS c
  FROM t, (VALUES (8), (13), (20)) v(h)),
nb2 AS (SELECT event_id, h, c + to_days(CASE isodow(c) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END::INT)
  + to_hours(h) AS fire FROM nb),
nw AS (SELECT event_id, n, CASE WHEN d + to_days(((w - wd + 7) % 7)::INT) + to_hours(h) <= ts
    THEN d + to_days((((w - wd + 7) % 7) + 7)::INT) + to_hours(h)
    ELSE d + to_days(((w - wd + 7) % 7)::INT) + to_hours(h) END AS fire
  FROM t, (VALUES ('MARKET_OPEN', 6, 22), ('MARKET_CLOSE', 4, 21), ('WEEKLY_REPORT', 4, 21))
  v(n, w, h)),
allev AS (
  SELECT event_id, 'BAR_CLOSE_15M' AS n, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS fire FROM t
  UNION ALL SELECT event_id, 'MARKET_UPDATE_4H', time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR FROM t
  UNION ALL SELECT event_id, n, fire FROM nw
  UNION ALL SELECT event_id, CASE h WHEN 8 THEN 'LONDON_OPEN' WHEN 13 THEN 'NY_OPEN'
    ELSE 'DAILY_REPORT' END, fire FROM nb2),
mn AS (SELECT event_id, min(fire) AS fire_at FROM allev GROUP BY 1)
SELECT a.event_id, fire_at, string_agg(n, ',' ORDER BY n) AS fired
FROM allev a JOIN mn ON a.event_id = mn.event_id AND a.fire = mn.fire_at GROUP BY 1, 2""")
def next_events(spark, sf_dir):
    at, names = tx.next_events(F.col("ts"))
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.select("event_id", at.alias("fire_at"),
                     F.concat_ws(",", F.array_sort(names)).alias("fired"))


@query("display_times", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC / ') ||
  strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran', '%H:%M IRST') AS shown FROM events""")
def display_times(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", tx.display_utc_and_tehran(F.col("ts").cast("timestamp")).alias("shown"))


_DQ_SQL = with_bars(60, _HOLIDAY_SQL.format(y0=2023, y1=2025), f"""
bl AS (SELECT b.*, {_local('ts')} AS lt, lag(ts) OVER w AS pts FROM b
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
bo AS (SELECT bl.*, {_open_sql('lt', 'kind')} AS o FROM bl LEFT JOIN hol ON hol.day = CAST(lt AS DATE)),
bp AS (SELECT bo.*, lag(o) OVER (PARTITION BY symbol ORDER BY ts) AS po FROM bo),
span AS (SELECT symbol, min(ts) AS f, max(ts) AS l FROM b GROUP BY 1),
g AS (SELECT symbol, {_local('unnest(generate_series(f, l, INTERVAL 1 HOUR))')} AS lt FROM span),
ex AS (SELECT symbol, count(*) FILTER (WHERE {_open_sql('lt', 'kind')}) AS expected
  FROM g LEFT JOIN hol ON hol.day = CAST(lt AS DATE) GROUP BY 1),
st AS (SELECT symbol, avg(spread) AS mu, stddev_pop(spread) AS sd FROM b GROUP BY 1),
a AS (SELECT bp.symbol, count(*) - count(DISTINCT ts) AS dupes,
    count(*) FILTER (WHERE ts <= pts) AS disorder, count(*) FILTER (WHERE ask < bid) AS bad,
    count(*) FILTER (WHERE spread < 0) AS neg,
    count(*) FILTER (WHERE sd > 0 AND abs(spread - mu) / sd > 8) AS outl,
    count(*) FILTER (WHERE o) AS present, count(*) FILTER (WHERE NOT o) AS closed,
    count(*) FILTER (WHERE o AND po AND ts - pts > INTERVAL 90 MINUTE) AS gaps
  FROM bp JOIN st ON st.symbol = bp.symbol GROUP BY 1),
r AS (SELECT a.*, present / expected AS cov FROM a JOIN ex ON ex.symbol = a.symbol)""", select="""
SELECT symbol, '1h' AS timeframe, t.c AS "check", t.p AS passed, t.s AS severity,
  round(t.v::DOUBLE, 6) AS observed
FROM r, LATERAL (VALUES ('monotonic_timestamps', disorder = 0, 'high', disorder::DOUBLE),
  ('no_duplicate_timestamps', dupes = 0, 'high', dupes::DOUBLE), ('valid_bid_ask', bad = 0, 'high', bad::DOUBLE),
  ('no_negative_spread', neg = 0, 'high', neg::DOUBLE), ('spread_outliers', outl = 0, 'medium', outl::DOUBLE),
  ('coverage', cov >= 0.995, 'high', cov), ('intra_session_gaps', gaps = 0, 'medium', gaps::DOUBLE),
  ('no_closed_market_data', closed = 0, 'high', closed::DOUBLE)) t(c, p, s, v)""")


@query("dq_report", _DQ_SQL)
def dq_report(spark, sf_dir):
    return dq.data_quality(bars(spark, sf_dir, 60), 3600)


@query("dq_verdict", f"""SELECT symbol, timeframe, bool_and(passed OR severity <> 'high') AS passed,
  coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE NOT passed), '') AS failures
  FROM ({_DQ_SQL}) GROUP BY 1, 2""")
def dq_verdict(spark, sf_dir):
    v = dq.verdict(dq.data_quality(bars(spark, sf_dir, 60), 3600))
    return v.withColumn("failures", F.concat_ws(",", "failures"))


@query("gap_windows", with_bars(60, select="""
SELECT symbol, timeframe, max(ts) + INTERVAL 1 HOUR AS start, TIMESTAMP '2024-01-31' AS "end"
FROM b GROUP BY 1, 2 HAVING max(ts) + INTERVAL 1 HOUR < TIMESTAMP '2024-01-31'"""))
def gap_windows(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return br.gap_windows(bars(spark, sf_dir, 60), 60, now)


@query("backfill_merge", with_bars(60, select="""
SELECT symbol, timeframe, ts, round(close, 6) AS close FROM b"""))
def backfill_merge(spark, sf_dir):
    """The first half as the stream, all bars as the fetch: the merge restores every bar once."""
    b = bars(spark, sf_dir, 60).select("symbol", "timeframe", "ts", "close")
    half = b.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return br.merge_backfill(half, b)


@query("day_levels", with_bars(60, select="""
SELECT symbol, CAST(ts AS DATE) AS day, round(max(high), 6) AS high, round(min(low), 6) AS low,
  count(*) AS bars FROM b GROUP BY 1, 2"""), dates=("day",))
def day_levels(spark, sf_dir):
    return bars(spark, sf_dir, 60).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("bars"))


@query("week_levels", with_bars(60, select="""
SELECT symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, round(max(high), 6) AS high,
  round(min(low), 6) AS low, count(*) AS bars FROM b GROUP BY 1, 2"""))
def week_levels(spark, sf_dir):
    return bars(spark, sf_dir, 60).groupBy("symbol", F.date_trunc("week", "ts").alias("week_start")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("bars"))


# --- indicators ----------------------------------------------------------------------------

_ID = ["symbol", "ts"]


def _linear(name: str, part, cte: str, out: str, *, tr: bool = False) -> None:
    sql = with_bars(60, tr_sql() if tr else "", cte, select=f"""
SELECT b.symbol, b.ts, round(y, 6) AS {out} FROM b LEFT JOIN r ON r.symbol = b.symbol AND r.k = b.k""")

    @query(name, sql)
    def run(spark, sf_dir):
        return ind.add(series(spark, sf_dir, 60), part).df.select(*_ID, out)


_linear("ema_sma_seed", ind.ema_mean_seeded(20, "ema_20"), ema_mean_sql("r", 20), "ema_20")
_linear("ema_first_seed", ind.ema(50, "ema_50"), ema_first_sql("r", 50), "ema_50")
_linear("rma_close", ind.rma(14, "rma_14"), rma_sql("r", 14, "b", "close"), "rma_14")


@query("rma_close_gaps", with_bars(60, """
nn AS (SELECT symbol, k AS at, row_number() OVER (PARTITION BY symbol ORDER BY k) - 1 AS k, close FROM b WHERE k % 7 > 0)""", rma_sql("r", 14, "nn", "close"), select="""
SELECT b.symbol, b.ts, round(y, 6) AS rma_14 FROM b LEFT JOIN nn ON nn.symbol = b.symbol AND nn.at = b.k
LEFT JOIN r ON r.symbol = nn.symbol AND r.k = nn.k"""))
def rma_close_gaps(spark, sf_dir):
    """Unknown inputs are skipped: no output there, and the seed is the mean of known values."""
    s = series(spark, sf_dir, 60).with_columns({"known": F.when(F.col("k") % 7 > 0, F.col("close"))})
    return ind.add(s, ind.rma(14, "rma_14", "known")).df.select(*_ID, "rma_14")


_linear("atr_wilder", ind.atr(14, "atr_14"), rma_sql("r", 14), "atr_14", tr=True)


@query("true_range", with_bars(60, tr_sql(), select="SELECT symbol, ts, round(tr, 6) AS tr FROM tr"))
def true_range(spark, sf_dir):
    return ind.true_range(series(spark, sf_dir, 60)).df.select(*_ID, "tr")


@query("tsi", with_bars(60, tsi_sql("r"), select="""
SELECT b.symbol, b.ts, round(tsi, 6) AS tsi, round(tsi_signal, 6) AS tsi_signal
FROM b LEFT JOIN r ON r.symbol = b.symbol AND r.k = b.k"""))
def tsi(spark, sf_dir):
    return ind.add(series(spark, sf_dir, 60), ind.tsi()).df.select(*_ID, "tsi", "tsi_signal")


@query("supertrend", with_bars(60, tr_sql(), rma_sql("a", 10), supertrend_sql("r", "a"), select="""
SELECT b.symbol, b.ts, dir AS st_dir, round(CASE dir WHEN 1 THEN lo ELSE up END, 6) AS st_value
FROM b LEFT JOIN r ON r.symbol = b.symbol AND r.k = b.k"""))
def supertrend(spark, sf_dir):
    return ind.supertrend(series(spark, sf_dir, 60)).df.select(*_ID, "st_dir", "st_value")


@query("cost_atr", with_bars(60, tr_sql(), """
w AS (SELECT symbol, k, greatest(avg(tr) OVER (PARTITION BY symbol ORDER BY k), 0.5) AS y
      FROM tr QUALIFY k < 14),
r AS (SELECT symbol, k, y FROM w WHERE k = 13
      UNION ALL SELECT r.symbol, tr.k, (r.y * 13 + tr.tr) / 14 FROM r
      JOIN tr ON tr.symbol = r.symbol AND tr.k = r.k + 1)""", select="""
SELECT b.symbol, b.ts, round(coalesce(r.y, w.y), 6) AS cost_atr FROM b
LEFT JOIN r ON r.symbol = b.symbol AND r.k = b.k LEFT JOIN w ON w.symbol = b.symbol AND w.k = b.k"""))
def cost_atr(spark, sf_dir):
    return ind.add(series(spark, sf_dir, 60), ind.cost_atr(14, 0.5)).df.select(*_ID, "cost_atr")


@query("weekly_levels", with_bars(240, WEEKLY_SQL, select="""
SELECT symbol, ts, round(prev_high, 6) AS prev_high, round(prev_low, 6) AS prev_low,
  round(curr_high, 6) AS curr_high, round(curr_low, 6) AS curr_low FROM lv"""))
def weekly_levels(spark, sf_dir):
    return ind.weekly_levels(series(spark, sf_dir, 240)).df.select(
        *_ID, "prev_high", "prev_low", "curr_high", "curr_low")


@query("bos_order_block", with_bars(240, WEEKLY_SQL, BOS_SQL, select="""
SELECT symbol, ts, bos, round(bos_level, 6) AS bos_level, round(ob_high, 6) AS ob_high,
  round(ob_low, 6) AS ob_low, choch_bearish, choch_bullish FROM bos"""))
def bos_order_block(spark, sf_dir):
    return ind.break_of_structure(series(spark, sf_dir, 240)).df.select(
        *_ID, "bos", "bos_level", "ob_high", "ob_low", "choch_bearish", "choch_bullish")


@query("tsi_crossover", with_bars(60, tsi_sql("r"), select="""
SELECT b.symbol, b.ts, coalesce(pt <= ps AND tsi > tsi_signal, false) AS cross_up,
  coalesce(pt >= ps AND tsi < tsi_signal, false) AS cross_down, round(pt, 6) AS prev_tsi FROM b LEFT JOIN (
    SELECT *, lag(tsi) OVER w AS pt, lag(tsi_signal) OVER w AS ps FROM r
    WINDOW w AS (PARTITION BY symbol ORDER BY k)) x ON x.symbol = b.symbol AND x.k = b.k"""))
def tsi_crossover(spark, sf_dir):
    s = ind.crossover(ind.add(series(spark, sf_dir, 60), ind.tsi()), "tsi", "tsi_signal")
    return s.df.select(*_ID, "cross_up", "cross_down", "prev_tsi")


EMA_TREND_SQL = """
tr50 AS (SELECT b.*, t.y AS trend_ema, lag(t.y, 5) OVER (PARTITION BY b.symbol ORDER BY b.k) AS ago
         FROM b LEFT JOIN t ON t.symbol = b.symbol AND t.k = b.k),
trend AS (SELECT *, (trend_ema - ago) / 5 AS slope,
  CASE WHEN close > trend_ema AND (trend_ema - ago) / 5 > 0.5 THEN 'LONG'
       WHEN close < trend_ema AND (trend_ema - ago) / 5 < -0.5 THEN 'SHORT' ELSE 'FLAT' END AS trend
  FROM tr50)"""


@query("ema_trend_slope", with_bars(240, ema_first_sql("t", 50), EMA_TREND_SQL, select="""
SELECT symbol, ts, round(slope, 6) AS trend_slope, trend FROM trend"""))
def ema_trend_slope(spark, sf_dir):
    return ind.ema_trend(series(spark, sf_dir, 240)).df.select(*_ID, "trend_slope", "trend")


@query("vol_filter", with_bars(60, tr_sql(), rma_sql("a", 14), select="""
SELECT b.symbol, b.ts, coalesce(m > 0 AND y > 1.5 * m, false) AS vol_suppressed FROM b LEFT JOIN (
  SELECT *, avg(y) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)
  AS m FROM a) x ON x.symbol = b.symbol AND x.k = b.k"""))
def vol_filter(spark, sf_dir):
    s = ind.volatility_filter(ind.add(series(spark, sf_dir, 60), ind.atr(14)))
    return s.df.select(*_ID, "vol_suppressed")


@query("session_range", with_bars(60, select="""
SELECT symbol, ts, round(max(high) FILTER (WHERE hour(ts) < 7) OVER w, 6) AS range_high,
  round(min(low) FILTER (WHERE hour(ts) < 7) OVER w, 6) AS range_low,
  count(*) FILTER (WHERE hour(ts) < 7) OVER w AS range_bars
FROM b WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)"""))
def session_range(spark, sf_dir):
    return ind.session_range(series(spark, sf_dir, 60)).df.select(
        *_ID, "range_high", "range_low", "range_bars")


PIVOT_SQL = """
pv AS (SELECT *, CASE WHEN k >= 10 AND lag(high, 5) OVER w >= max(high) OVER f
         THEN lag(high, 5) OVER w END AS pivot_high,
       CASE WHEN k >= 10 AND lag(low, 5) OVER w <= min(low) OVER f THEN lag(low, 5) OVER w END
         AS pivot_low
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY k),
  f AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))"""


@query("swing_pivots", with_bars(60, PIVOT_SQL, select="""
SELECT symbol, ts, round(pivot_high, 6) AS pivot_high, round(pivot_low, 6) AS pivot_low FROM pv"""))
def swing_pivots(spark, sf_dir):
    return ind.swing_pivots(series(spark, sf_dir, 60)).df.select(*_ID, "pivot_high", "pivot_low")


@query("time_gaps", with_bars(60, _HOLIDAY_SQL.format(y0=2023, y1=2025), f"""
o AS (SELECT b.symbol, b.ts, {_open_sql('lt', 'kind')} AS o FROM (SELECT *, {_local('ts')} AS lt FROM b) b
  LEFT JOIN hol ON hol.day = CAST(lt AS DATE)),
p AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(o) OVER w AS po FROM o
  WINDOW w AS (PARTITION BY symbol ORDER BY ts))""", select="""
SELECT symbol, prev_ts, ts FROM p WHERE o AND po AND ts - prev_ts > INTERVAL 90 MINUTE"""))
def time_gaps(spark, sf_dir):
    s = series(spark, sf_dir, 60)
    s = s.with_df(tx.with_market_open(s.df)).windowed(lambda w: {
        "prev_ts": F.lag("ts").over(w), "prev_open": F.lag("is_open").over(w)}, back=1)
    wide = F.unix_micros("ts") - F.unix_micros("prev_ts") > 5_400_000_000
    return s.df.where(wide & F.col("is_open") & F.col("prev_open")).select(
        "symbol", "prev_ts", "ts")


# --- tick archives --------------------------------------------------------------------------

@query("tick_archive_round_trip", """
SELECT event_type AS symbol, date_trunc('milliseconds', ts) AS ts, round(value, 5) AS ask, round(value / 2, 5) AS bid, 1.0::DOUBLE AS ask_vol, 0.5::DOUBLE AS bid_vol FROM events""")
def tick_archive_round_trip(spark, sf_dir):
    """All events written as hourly archives and read back by the archive source."""
    root = f"{shared_dir(spark).rstrip('/')}/tapeworks/archives-{uuid.uuid4().hex}"
    t = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("ask"),
        (F.col("value") / 2).alias("bid"), F.lit(1.0).alias("ask_vol"), F.lit(0.5).alias("bid_vol"))
    archives.write_tick_archives(t, root)
    return archives.tick_archives(spark, root).drop("seq")
