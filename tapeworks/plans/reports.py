"""Combined jobs: snapshots, outlooks, sweeps, scanner studies and feed round trips."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks import dims
from tapeworks.functions import scalars as sc
from tapeworks.operators import backtest as bt
from tapeworks.operators import fills, joins, metrics, rules, scan
from tapeworks.operators import indicators as ind
from tapeworks.operators.validation import hash_draw
from tapeworks.plans.ledger import ORDER, chunk, ledger
from tapeworks.plans.registry import ORACLES, query
from tapeworks.plans.tables import (
    TICKS_SQL, WEEKLY_SQL, bars, bars_sql, ema_mean_sql, series, table, tr_sql, with_bars,
)
from tapeworks.plans.trading import (
    _COST_ATR, _CROSS, _ENGINE, _LEVEL_OUT, BASIC_SQL, LOOSE, PIP, TERMS, _scan, bos_sql,
    cross_trades, engine_sql, cross_sql, scan_sql, tsi_mom_sql, walk_sql,
)
from tapeworks.schemas import TRIAL_DDL, schema
from tapeworks.sources import feeds, logs, tables
from tapeworks.storage import shared_dir


@query("bos_snapshot", with_bars(240, *bos_sql(cap="200.0"), select="""
SELECT symbol, timeframe, ts, signal, bos, round(prev_high, 6) AS prev_high, round(prev_low, 6) AS prev_low, round(ob_high, 6) AS ob_high,
  round(ob_low, 6) AS ob_low, round(CASE WHEN signal <> 'FLAT' THEN sl END, 6) AS sl FROM sg
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC) = 1"""))
def bos_snapshot(spark, sf_dir):
    s = rules.weekly_bos_retest(series(spark, sf_dir, 240), max_risk_pips=2000.0)
    return rules.last_snapshot(s.df, ["symbol", "timeframe"],
                               ["signal", "bos", "prev_high", "prev_low", "ob_high", "ob_low", "sl"])


@query("weekly_outlook", with_bars(240, WEEKLY_SQL, """
l AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC) = 1)""", select="""
SELECT symbol, week_start, round(prev_high, 6) AS prev_high, round(prev_low, 6) AS prev_low, round(prev_high - prev_low, 6) AS prev_range,
  round(close, 6) AS last_close, CASE WHEN close > prev_high THEN 'ABOVE' WHEN close < prev_low THEN 'BELOW' ELSE 'INSIDE' END AS bias FROM l"""))
def weekly_outlook(spark, sf_dir):
    s = ind.weekly_levels(series(spark, sf_dir, 240))
    r = rules.last_snapshot(s.df, ["symbol"], ["week_start", "prev_high", "prev_low", "close"])
    c = F.col("close")
    return r.select(
        "symbol", "week_start", "prev_high", "prev_low", (F.col("prev_high") - F.col("prev_low")).alias("prev_range"),
        c.alias("last_close"), F.when(c > F.col("prev_high"), "ABOVE").when(c < F.col("prev_low"), "BELOW").otherwise("INSIDE").alias("bias"))


@query("sweep_snapshot", f"""SELECT s.symbol, s.ts, s.signal, s.sl, s.tp, r.range_high, r.range_low, r.range_bars
FROM ({ORACLES['sweep_signals']}) s JOIN ({ORACLES['session_range']}) r ON r.symbol = s.symbol AND r.ts = s.ts
QUALIFY row_number() OVER (PARTITION BY s.symbol ORDER BY s.ts DESC) = 1""")
def sweep_snapshot(spark, sf_dir):
    s = rules.london_sweep(series(spark, sf_dir, 60))
    return rules.last_snapshot(s.df, ["symbol"], ["signal", "sl", "tp", "range_high", "range_low", "range_bars"])


@query("daily_report", f"""
SELECT s.symbol, s.ts, s.h4_trend, s.h1_signal, s.m15_signal, s.direction, d.high AS day_high, d.low AS day_low, d.bars AS day_bars
FROM ({ORACLES['confluence_scan']}) s JOIN ({ORACLES['day_levels']}) d ON d.symbol = s.symbol AND d.day = CAST(s.ts - INTERVAL 15 MINUTE AS DATE)
QUALIFY row_number() OVER (PARTITION BY s.symbol ORDER BY s.ts DESC) = 1""")
def daily_report(spark, sf_dir):
    """Latest scan per symbol with the levels of its day."""
    s, _ = _scan(spark, sf_dir)
    last = rules.last_snapshot(s, ["symbol"], ["h4_trend", "h1_signal", "m15_signal", "direction"])
    last = last.withColumn("day", F.to_date(F.col("ts") - F.expr("INTERVAL 15 MINUTE")))
    levels = bars(spark, sf_dir, 60).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.count(F.lit(1)).alias("day_bars"))
    return last.join(levels, ["symbol", "day"]).drop("day")


@query("recent_performance", """
SELECT l_returnflag AS run, count(*) AS trade_count, round(avg((l_discount > l_tax)::INT), 4) AS win_rate,
  round(sum(l_extendedprice * (l_discount - l_tax)), 4) AS total_pnl FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1""", digits=4)
def recent_performance(spark, sf_dir):
    """Journal report since a date; the filter reaches the scan."""
    t = ledger(spark, sf_dir).where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return metrics.strategy_metrics(metrics.drawdown_parts(t, ["run"], ORDER, chunk()), ["run"]).join(
        t.groupBy("run").agg(F.sum("pnl").alias("total_pnl")), "run").select("run", "trade_count", "win_rate", "total_pnl")


_SWEEP = [("p5_20", 5, 20), ("p9_21", 9, 21), ("p10_50", 10, 50)]


def _sweep_part(i: int, fast: int, slow: int) -> str:
    ctes = ",".join([TICKS_SQL, bars_sql(60), *cross_sql(fast, slow), *engine_sql(), BASIC_SQL])
    return f"SELECT '{i}' AS param_id, symbol, trade_count, round(total_return, 4) AS total_return, round(sharpe_ratio, 4) AS sharpe_ratio FROM (WITH RECURSIVE {ctes} SELECT * FROM bm)"


@query("parameter_sweep", " UNION ALL ".join(_sweep_part(*p) for p in _SWEEP), digits=4)
def parameter_sweep(spark, sf_dir):
    """All parameter sets in one plan, each a key of its own."""
    s = rules.ema_cross_sweep(series(spark, sf_dir, 60), _SWEEP, also=(ind.cost_atr(14, 0.5),))
    t = bt.backtest(s, terms=TERMS, pip_size=PIP, atr_col="cost_atr")
    keys = ["param_id", "symbol"]
    m = metrics.basic_metrics(metrics.drawdown_parts(t, keys, ["signal_k"], [F.floor(F.col("signal_k") / 10_000)]), keys)
    return m.select(*keys, "trade_count", "total_return", "sharpe_ratio")


@query("last_trades", with_bars(60, *cross_sql(5, 20), *engine_sql(), select="""
SELECT symbol, signal_k, direction, round(pnl, 4) AS pnl FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY signal_k DESC) <= 20"""), digits=4)
def last_trades(spark, sf_dir):
    """The latest twenty trades per symbol (row-number limit, applied before the shuffle too)."""
    w = Window.partitionBy("symbol").orderBy(F.col("signal_k").desc())
    t = cross_trades(spark, sf_dir).withColumn("_n", F.row_number().over(w)).where("_n <= 20")
    return t.select("symbol", "signal_k", "direction", "pnl")


@query("lookback_rows", with_bars(60, select="""
SELECT symbol, ts, round(close, 6) AS close FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC) <= 50"""))
def lookback_rows(spark, sf_dir):
    s = series(spark, sf_dir, 60)
    last = s.df.groupBy("symbol").agg(F.max("k").alias("_last"))
    return joins.last_rows_before(s.df.join(last, "symbol"), F.col("_last"), ["symbol"], 50).select("symbol", "ts", "close")


@query("performance_slices", with_bars(15, *tsi_mom_sql("0"), walk_sql("sgl", "s.xdn", "s.xup"), f"lt AS ({_LEVEL_OUT})", select="""
SELECT exit_kind, direction, CAST(isodow(entry_ts) AS INT) AS weekday, count(*) AS trades, round(avg((pnl_pips > 0)::INT), 4) AS win_rate, round(sum(pnl_pips), 4) AS pips
FROM lt GROUP BY GROUPING SETS ((exit_kind), (direction), (isodow(entry_ts)), ())"""), digits=4)
def performance_slices(spark, sf_dir):
    s = rules.tsi_momentum(series(spark, sf_dir, 15), tsi_threshold=0.0)
    t = fills.level_trades(s, pip_size=PIP, exit_long=F.col("cross_down"), exit_short=F.col("cross_up"), signal_kind="REV")
    t = t.withColumn("weekday", (F.weekday("entry_ts") + 1).cast("int"))
    return t.groupingSets([["exit_kind"], ["direction"], ["weekday"], []], "exit_kind", "direction", "weekday").agg(
        F.count(F.lit(1)).alias("trades"), metrics.win_rate(F.col("pnl_pips")).alias("win_rate"), F.sum("pnl_pips").alias("pips"))


@query("symbol_lookup", """
WITH o AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN s WHEN 1 THEN replace(s, '/', '_') ELSE replace(s, '/', '') END AS raw, s AS symbol, o_totalprice AS p
  FROM (SELECT *, ['EUR/USD', 'GBP/USD', 'USD/JPY', 'XAU/USD'][o_orderkey % 4 + 1] AS s FROM orders))
SELECT raw, symbol, count(*) AS n, round(sum(p / CASE symbol WHEN 'USD/JPY' THEN 0.01::DOUBLE WHEN 'XAU/USD' THEN 0.1::DOUBLE ELSE 0.0001::DOUBLE END) / 1e9, 3) AS gpips,
  CASE WHEN raw LIKE '%JPY%' THEN 0.01::DOUBLE WHEN raw LIKE '%XAU%' THEN 0.1::DOUBLE ELSE 0.00001::DOUBLE END AS guessed_pip FROM o GROUP BY 1, 2""")
def symbol_lookup(spark, sf_dir):
    """Three spellings normalised and joined with the instrument dimension; misses fail."""
    from tapeworks.functions.costs import price_to_pips

    k = F.col("o_orderkey")
    name = F.element_at(F.array(*[F.lit(s) for s, *_ in dims.INSTRUMENTS]), (k % 4).cast("int") + 1)
    raw = F.when(k % 3 == 0, name).when(k % 3 == 1, F.replace(name, F.lit("/"), F.lit("_"))).otherwise(
        F.replace(name, F.lit("/"), F.lit("")))
    o = table(spark, sf_dir, "orders").select(raw.alias("raw"), "o_totalprice")
    o = o.withColumn("symbol", sc.normalize_symbol(F.col("raw")))
    j = joins.lookup(o, dims.instruments(spark), "symbol", required="pip_size")
    return j.groupBy("raw", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(price_to_pips(F.col("o_totalprice"), F.col("pip_size"))) / 1e9, 3).alias("gpips")
    ).withColumn("guessed_pip", sc.pip_size_heuristic(F.col("raw")))


@query("content_hashes", """
SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS content_hash FROM orders""")
def content_hashes(spark, sf_dir):
    body = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.content_hash(body).alias("content_hash"))


@query("dataset_fingerprint", """
SELECT count(*) AS n, bit_xor(('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || round(l_extendedprice * 100)::BIGINT), 1, 8))::UBIGINT::BIGINT) AS fingerprint FROM lineitem""")
def dataset_fingerprint(spark, sf_dir):
    """Order-free fingerprint of the ledger: combines map-side, no sort."""
    cols = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hash_draw(*cols, cents)).alias("fingerprint"))


# --- storage and feeds ----------------------------------------------------------------------

@query("store_round_trip", with_bars(60, select="""
SELECT symbol, ts, round(close, 6) AS close, 'events' AS source FROM b
WHERE symbol = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'"""))
def store_round_trip(spark, sf_dir):
    """Write every bar by month, upsert one series again, read a closed range with pruning."""
    root = f"{shared_dir(spark)}/tapeworks/bars-{uuid.uuid4().hex}"
    b = bars(spark, sf_dir, 60).withColumn("source", F.lit("events"))
    tables.write_bars(b, root)
    tables.write_bars(b.where("symbol = 'view'"), root, upsert=True)
    out = tables.load_bars(spark, root, "view", "1h", datetime(2024, 1, 5, 6, tzinfo=UTC), datetime(2024, 1, 20, 18, tzinfo=UTC))
    return out.select("symbol", "ts", "close", "source")


@query("month_file", with_bars(60, select="""
SELECT symbol, ts, round(close, 6) AS close FROM b WHERE symbol = 'click' AND year(ts) = 2024 AND month(ts) = 1"""))
def month_file(spark, sf_dir):
    """One stored month of one series, found by its partition."""
    root = f"{shared_dir(spark)}/tapeworks/bars-{uuid.uuid4().hex}"
    tables.write_bars(bars(spark, sf_dir, 60).withColumn("source", F.lit("events")), root)
    return tables.read_month(spark, root, "click", "1h", 2024, 1).select("symbol", "ts", "close")


@query("half_open_range", with_bars(60, select="""
SELECT symbol, ts, round(close, 6) AS close FROM b
WHERE symbol = 'view' AND ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00'"""))
def half_open_range(spark, sf_dir):
    """The range without its last instant."""
    root = f"{shared_dir(spark)}/tapeworks/bars-{uuid.uuid4().hex}"
    tables.write_bars(bars(spark, sf_dir, 60).withColumn("source", F.lit("events")), root)
    out = tables.load_bars(spark, root, "view", "1h", datetime(2024, 1, 5, 6, tzinfo=UTC), datetime(2024, 1, 20, 18, tzinfo=UTC), closed="left")
    return out.select("symbol", "ts", "close")


@query("timeframe_files", "WITH " + TICKS_SQL + "," + bars_sql(1, "m1") + """
SELECT symbol, tf AS timeframe, time_bucket(to_minutes(mins), ts) AS ts, round(arg_max(close, ts), 6) AS close
FROM m1, (VALUES ('15m', 15), ('1h', 60), ('4h', 240)) t(tf, mins) GROUP BY 1, 2, 3""")
def timeframe_files(spark, sf_dir):
    """A minute set written at three timeframes in one pass, read back."""
    root = f"{shared_dir(spark)}/tapeworks/bars-{uuid.uuid4().hex}"
    tables.write_timeframes(bars(spark, sf_dir, 1).withColumn("source", F.lit("events")), root, ["15m", "1h", "4h"])
    return tables.read_bars(spark, root).select("symbol", "timeframe", "ts", "close")


@query("month_end", with_bars(60, select="""
SELECT CASE WHEN ts < TIMESTAMP '2024-02-01' THEN 'archived' ELSE 'kept' END AS place, count(*) AS rows, round(sum(close), 4) AS close_sum FROM b
WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1"""), digits=4)
def month_end(spark, sf_dir):
    """January exported and purged: what the archive and the table hold afterwards."""
    path = f"{shared_dir(spark)}/tapeworks/archive-{uuid.uuid4().hex}"
    _, kept = tables.archive_and_purge(bars(spark, sf_dir, 60).where("ts >= TIMESTAMP '2024-01-01'"), 2024, 1, path)
    both = tables.read_archive(spark, path).select("close", F.lit("archived").alias("place")).unionByName(
        kept.select("close", F.lit("kept").alias("place")))
    return both.groupBy("place").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close_sum"))


def _closed_trades(spark, sf_dir):
    """Line items as closed trades; returned ones have no result yet."""
    c, day = F.col, lambda n: F.col(n).cast("timestamp")
    pnl = F.when(c("l_returnflag") != "R", F.round(c("l_extendedprice") * (c("l_discount") - 0.05), 4))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("symbol"), F.when(c("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("direction"),
        day("l_shipdate").alias("entry_ts"), (day("l_shipdate") + F.make_dt_interval(hours=c("l_linenumber").cast("int") * 3)).alias("exit_ts"), c("l_extendedprice").alias("entry_price"),
        (c("l_extendedprice") + c("l_tax")).alias("exit_price"), F.lit(None).cast("double").alias("sl_at_entry"), F.lit(None).cast("double").alias("tp_at_entry"),
        c("l_returnflag").alias("exit_kind"), pnl.alias("pnl"))


@query("journal_lines", """
SELECT l_orderkey || '-' || l_linenumber AS symbol, CASE l_linestatus WHEN 'O' THEN 'LONG' ELSE 'SHORT' END AS direction, CAST(l_shipdate AS TIMESTAMP) AS entry_ts,
  round(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (l_discount - 0.05) ELSE 0 END, 4) AS pnl, round_even(l_linenumber * 3 / 4.0, 0)::INTEGER AS n_bars_held FROM lineitem""", digits=4)
def journal_lines(spark, sf_dir):
    """Closed trades appended to the journal as JSON lines, with a broken line among them, read back."""
    path = f"{shared_dir(spark)}/tapeworks/journal-{uuid.uuid4().hex}"
    logs.append_exits(_closed_trades(spark, sf_dir), path)
    spark.range(2).select(F.lit('{"symbol": broken').alias("value")).write.mode("append").text(path)
    return logs.read_journal(spark, path).select("symbol", "direction", "entry_ts", "pnl", "n_bars_held")


@query("tagged_records", """
SELECT o_orderkey || '' AS symbol, round(o_totalprice, 2) AS prev_high FROM orders WHERE o_orderkey % 2 = 0""", digits=2)
def tagged_records(spark, sf_dir):
    """Levels and signals in one log of JSON lines, told apart by their tag."""
    path = f"{shared_dir(spark)}/tapeworks/records-{uuid.uuid4().hex}"
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    logs.append_records(o.where(k % 2 == 0).select(k.cast("string").alias("symbol"), F.col("o_totalprice").alias("prev_high")), path, "level")
    logs.append_records(o.where(k % 2 != 0).select(k.cast("string").alias("symbol"), F.col("o_totalprice").alias("entry_price")), path, "signal")
    return logs.read_records(spark, path, "level").select("symbol", "prev_high")


@query("trial_lines", """
SELECT o_orderkey || '' AS result_id, o_orderpriority AS strategy, round(o_totalprice / 1000000, 6) AS observed_sharpe FROM orders""")
def trial_lines(spark, sf_dir):
    """Trials appended to their log and read back."""
    path = f"{shared_dir(spark)}/tapeworks/trials-{uuid.uuid4().hex}"
    given = {"result_id": F.col("o_orderkey").cast("string"), "strategy": F.col("o_orderpriority"), "observed_sharpe": F.col("o_totalprice") / 1_000_000, "seq": F.col("o_orderkey").cast("bigint")}
    rows = table(spark, sf_dir, "orders").select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(TRIAL_DDL)])
    logs.append_trials(rows, path)
    return logs.read_trials(spark, path).select("result_id", "strategy", "observed_sharpe")


@query("price_event_ticks", """
SELECT event_type AS symbol, count(*) AS ticks, round(sum(CASE WHEN user_id % 2 = 0 THEN value + 0.5 ELSE value END), 4) AS ask_sum,
  round(sum(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 2.0 END)::DOUBLE, 4) AS volume
FROM (SELECT * REPLACE ('XXX/' || upper(substr(event_type, 1, 3)) AS event_type) FROM events) WHERE event_id % 10 <> 0 GROUP BY 1""", digits=4)
def price_event_ticks(spark, sf_dir):
    """Every event as live price JSON with missing fields, heartbeats dropped."""
    ev, i = table(spark, sf_dir, "events"), F.col("event_id")
    body = F.struct(
        F.when(i % 10 == 0, "heartbeat").otherwise("price").alias("event"),
        F.concat(F.lit("XXX"), F.upper(F.substring("event_type", 1, 3))).alias("symbol"), F.col("value").cast("string").alias("price"),
        F.when(F.col("user_id") % 2 == 0, (F.col("value") + 0.5).cast("string")).alias("ask"),
        F.when(i % 3 != 0, "2").alias("last_volume"), F.when(i % 2 == 0, F.lit(0)).otherwise(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("timestamp"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("last_trade_time"))
    t = feeds.price_ticks(ev.select(F.to_json(body).alias("value")))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.sum("ask").alias("ask_sum"), F.sum("volume").alias("volume"))


@query("payload_bars", with_bars(60, select="""
SELECT symbol, '1h' AS timeframe, ts, round(greatest(high, open, close), 6) AS high, round(least(low, open, close), 6) AS low, round(close, 6) AS close,
  round(close - 0.1, 6) AS bid, round(close + 0.1, 6) AS ask FROM b WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'"""))
def payload_bars(spark, sf_dir):
    """Bars as API pages of one day with a repeated first value, normalised again."""
    b = bars(spark, sf_dir, 60)
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")])
    pages = b.groupBy("symbol", "timeframe", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(item)).alias("v"))
    pages = pages.select(F.struct("symbol", F.col("timeframe").alias("interval")).alias("meta"),
                         F.concat("v", F.slice("v", 1, 1)).alias("values"))
    at = lambda s: F.lit(s).cast("timestamp")
    out = feeds.bars_from_payload(pages, start=at("2024-01-03"), end=at("2024-01-28"), pip_size=F.lit(PIP))
    return out.select("symbol", "timeframe", "ts", "high", "low", "close", "bid", "ask")


@query("news_payload", """
SELECT event_id::VARCHAR AS name, ts AS event_ts, ['USD', 'EUR', 'GBP'][user_id % 5 + 1] AS currency FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)
WHERE value > 100 AND user_id % 5 < 3 AND event_id % 7 <> 0""")
def news_payload(spark, sf_dir):
    """Events as calendar JSON in both layouts: low impact, odd currencies and bad dates go."""
    ev, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    row = F.struct(
        F.when(i % 7 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"), i.cast("string").alias("event"),
        F.when(F.col("value") > 100, "HIGH").otherwise("low").alias("impact"),
        F.element_at(F.array(*[F.lit(c) for c in ("usd", "eur", "gbp", "chf", "nok")]), (u % 5).cast("int") + 1).alias("currency"))
    nested = F.to_json(F.struct(F.struct(F.array(row).alias("rows")).alias("result")))
    flat = F.to_json(F.struct(F.array(row).alias("result")))
    out = feeds.news_events(ev.select(F.when(i % 2 == 0, nested).otherwise(flat).alias("value")))
    return out.select("name", "event_ts", "currency")


# --- scanner studies ------------------------------------------------------------------------

def _at_hours(sql: str) -> str:
    """Decide at hourly closes instead of 15-minute closes."""
    return sql.replace("FROM s15 ASOF LEFT JOIN s4", "FROM (SELECT d.symbol, d.v, s15.k, s15.signal FROM s1 d ASOF LEFT JOIN s15 ON s15.symbol = d.symbol AND d.v >= s15.v) s15 ASOF LEFT JOIN s4")


@query("scanner_outcomes", "WITH " + ",".join([TICKS_SQL, *[_at_hours(x) for x in scan_sql("300.0", 1000, "0.0")], bars_sql(60, "hb"), """
ok AS (SELECT scn.*, hb.k FROM scn JOIN hb ON hb.symbol = scn.symbol AND hb.ts + INTERVAL 1 HOUR = scn.ts
  WHERE confluence AND sl IS NOT NULL AND tp IS NOT NULL AND m15_signal = direction AND hb.k >= 50),
en AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY symbol, direction, h4_ts ORDER BY k) = 1),
hit AS (SELECT en.symbol, en.k, min(hb.k) AS hk FROM en JOIN hb ON hb.symbol = en.symbol AND hb.k BETWEEN en.k + 1 AND en.k + 24
  AND CASE direction WHEN 'LONG' THEN hb.low <= sl OR hb.high >= tp ELSE hb.high >= sl OR hb.low <= tp END GROUP BY 1, 2)"""]) + """
SELECT en.symbol, en.ts, direction, CASE WHEN hb.k IS NULL THEN 'OPEN' WHEN CASE direction WHEN 'LONG' THEN hb.low <= sl ELSE hb.high >= sl END THEN 'SL' ELSE 'TP' END AS outcome,
  round(CASE WHEN hb.k IS NULL THEN 0.0 WHEN CASE direction WHEN 'LONG' THEN hb.low <= sl ELSE hb.high >= sl END THEN -abs(entry_price - sl) / 0.1 ELSE abs(tp - entry_price) / 0.1 END, 4) AS pnl_pips
FROM en LEFT JOIN hit ON hit.symbol = en.symbol AND hit.k = en.k LEFT JOIN hb ON hb.symbol = hit.symbol AND hb.k = hit.hk""", digits=4)
def scanner_outcomes(spark, sf_dir):
    """Scanner study: hourly scans, one entry per direction and coarse bar, barrier outcome."""
    h1 = series(spark, sf_dir, 60)
    close_at = (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    s = scan.confluence_scan(series(spark, sf_dir, 240), h1, series(spark, sf_dir, 15), h1.df.select("symbol", close_at),
                             h4_params={"max_risk_pips": 2000.0}, h1_params=LOOSE, min_slope_price=0.0)
    e = scan.outcome_entries(s, h1.df.select("symbol", close_at, "k"))
    return joins.triple_barrier(e, h1.df, ["symbol"]).select("symbol", "ts", "direction", "outcome", "pnl_pips")


def _at_four(sql: str) -> str:
    return sql.replace("FROM s15 ASOF LEFT JOIN s4", "FROM (SELECT d.symbol, d.v, s15.k, s15.signal FROM s4 d ASOF LEFT JOIN s15 ON s15.symbol = d.symbol AND d.v >= s15.v) s15 ASOF LEFT JOIN s4")


@query("scanner_walk_forward", "WITH RECURSIVE " + ",".join([TICKS_SQL, *[_at_four(x) for x in scan_sql("300.0", 1000, "0.0")], bars_sql(15, "fb"), bars_sql(240, "db"), """
ev AS (SELECT scn.symbol, scn.ts, 1 AS o, db.close, NULL::DOUBLE AS high, NULL::DOUBLE AS low, CASE WHEN confluence AND sl IS NOT NULL AND tp IS NOT NULL THEN direction ELSE 'FLAT' END AS sig,
    sl, tp, h4_signal FROM scn JOIN db ON db.symbol = scn.symbol AND db.ts + INTERVAL 4 HOUR = scn.ts
  UNION ALL SELECT symbol, ts + INTERVAL 15 MINUTE, 0, NULL, high, low, 'FLAT', NULL, NULL, NULL FROM fb),
eo AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, o) - 1 AS k FROM ev),
w AS (SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS k, 'FLAT' AS pos, NULL::DOUBLE AS entry, NULL::TIMESTAMP AS ets, NULL::DOUBLE AS psl, NULL::DOUBLE AS ptp, 0 AS held,
    NULL::VARCHAR AS kind, NULL::VARCHAR AS xdir, NULL::DOUBLE AS xin, NULL::TIMESTAMP AS xets, NULL::DOUBLE AS xout, NULL::TIMESTAMP AS xts FROM eo
  UNION ALL
  SELECT symbol, k, CASE WHEN pos = 'FLAT' OR kd IS NOT NULL THEN sig ELSE pos END,
    CASE WHEN pos = 'FLAT' OR kd IS NOT NULL THEN close ELSE entry END, CASE WHEN pos = 'FLAT' OR kd IS NOT NULL THEN ts ELSE ets END,
    CASE WHEN pos = 'FLAT' OR kd IS NOT NULL THEN sl ELSE psl END, CASE WHEN pos = 'FLAT' OR kd IS NOT NULL THEN tp ELSE ptp END,
    CASE WHEN pos = 'FLAT' OR kd IS NOT NULL THEN 0 ELSE held + 1 - o END,
    kd, CASE WHEN kd IS NOT NULL THEN pos END, entry, ets, CASE kd WHEN 'SL' THEN psl WHEN 'TP' THEN ptp ELSE close END, ts
  FROM (SELECT s.symbol, s.k, s.ts, s.o, s.close, s.sig, s.sl, s.tp, p.pos, p.entry, p.ets, p.psl, p.ptp, p.held,
      CASE WHEN p.pos = 'LONG' AND s.low <= p.psl OR p.pos = 'SHORT' AND s.high >= p.psl THEN 'SL'
           WHEN p.pos = 'LONG' AND s.high >= p.ptp OR p.pos = 'SHORT' AND s.low <= p.ptp THEN 'TP'
           WHEN p.pos <> 'FLAT' AND s.o = 1 AND p.held >= 40 THEN 'EXPIRED'
           WHEN p.pos = 'LONG' AND s.h4_signal = 'SHORT' OR p.pos = 'SHORT' AND s.h4_signal = 'LONG' THEN 'SIGNAL' END AS kd
    FROM w p JOIN eo s ON s.symbol = p.symbol AND s.k = p.k + 1))"""]) + """
SELECT symbol, xdir AS direction, xets AS entry_ts, round(xin, 6) AS entry_price, xts AS exit_ts, round(xout, 6) AS exit_price, kind AS exit_kind,
  round(CASE xdir WHEN 'LONG' THEN xout - xin ELSE xin - xout END / 0.1, 6) AS pnl_pips FROM w WHERE kind IS NOT NULL""")
def scanner_walk_forward(spark, sf_dir):
    """Coarse decisions with barriers on fine bars, maximum holding time and reversals."""
    h4, m15 = series(spark, sf_dir, 240), series(spark, sf_dir, 15)
    at = (F.col("ts") + F.expr("INTERVAL 4 HOUR")).alias("ts")
    dec = h4.df.select("symbol", at, "close")
    s = scan.confluence_scan(h4, series(spark, sf_dir, 60), m15, dec, h4_params={"max_risk_pips": 2000.0}, h1_params=LOOSE, min_slope_price=0.0)
    s = s.join(dec, ["symbol", "ts"])
    ready = F.col("confluence") & F.col("sl").isNotNull() & F.col("tp").isNotNull()
    side = F.when(ready & (F.col("direction") == "LONG"), 1).when(ready & (F.col("direction") == "SHORT"), -1).otherwise(0)
    s = s.withColumns({"side": side, "exit_long": F.col("h4_signal") == "SHORT", "exit_short": F.col("h4_signal") == "LONG"})
    fine = m15.df.select("symbol", (F.col("ts") + F.expr("INTERVAL 15 MINUTE")).alias("ts"), "high", "low")
    return fills.scanner_trades(s, fine, ["symbol"], pip_size=PIP, max_hold=40).drop("held")
