"""Queries for rules, scans, trades and time-aware joins on the tick tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.functions.costs import CostTerms
from tapeworks.operators import backtest as bt
from tapeworks.operators import fills, joins, metrics, rules, scan
from tapeworks.operators import indicators as ind
from tapeworks.operators.zones import zone_proximity
from tapeworks.plans.market import EMA_TREND_SQL, PIVOT_SQL
from tapeworks.plans.registry import query
from tapeworks.plans.tables import (
    BOS_SQL, KEYS, TICKS_SQL, WEEKLY_SQL, bars, bars_sql, ema_first_sql, ema_mean_sql, rma_sql,
    series, supertrend_sql, table, tr_sql, tsi_sql, with_bars,
)

PIP = 0.1
TERMS = CostTerms.literal(20.0, 5.0, 10.0, 0.10, 10.0)
_SIG = ["symbol", "ts", "signal", "sl", "tp"]
_SIG_SQL = """SELECT symbol, ts, signal, round(CASE WHEN signal <> 'FLAT' THEN sl END, 6) AS sl,
  round(CASE WHEN signal <> 'FLAT' THEN tp END, 6) AS tp FROM sg"""


def _join_sql(name: str, *parts: str, src: str = "b", **cols: str) -> str:
    """CTE: src rows plus indicator columns alias=cte.column."""
    picks = ", ".join(f"{c} AS {a}" for a, c in cols.items())
    joins_ = " ".join(f"LEFT JOIN {p} ON {p}.symbol = z.symbol AND {p}.k = z.k" for p in parts)
    return f"{name} AS (SELECT z.*, {picks} FROM {src} z {joins_})"


# --- EMA cross and its backtest -------------------------------------------------------------

_CROSS = """
sg AS (SELECT b.*, CASE WHEN f.y IS NULL OR s.y IS NULL THEN 'FLAT' WHEN f.y > s.y THEN 'LONG'
       ELSE 'SHORT' END AS signal
  FROM b LEFT JOIN f ON f.symbol = b.symbol AND f.k = b.k
  LEFT JOIN s ON s.symbol = b.symbol AND s.k = b.k)"""


def cross_sql(fast: int, slow: int) -> list[str]:
    return [ema_mean_sql("f", fast), ema_mean_sql("s", slow), _CROSS]


@query("ema_cross_signals", with_bars(60, *cross_sql(5, 20), select="SELECT symbol, ts, signal FROM sg"))
def ema_cross_signals(spark, sf_dir):
    return rules.ema_cross(series(spark, sf_dir, 60), 5, 20).df.select("symbol", "ts", "signal")


_COST_ATR = """
cw AS (SELECT symbol, k, greatest(avg(tr) OVER (PARTITION BY symbol ORDER BY k), 0.5) AS y
       FROM tr QUALIFY k < 14),
cr AS (SELECT symbol, k, y FROM cw WHERE k = 13
       UNION ALL SELECT cr.symbol, tr.k, (cr.y * 13 + tr.tr) / 14 FROM cr
       JOIN tr ON tr.symbol = cr.symbol AND tr.k = cr.k + 1),
ca AS (SELECT symbol, k, y FROM cw WHERE k < 13 UNION ALL SELECT symbol, k, y FROM cr)"""

# Walks the engine bar by bar: signal at k fills at the open of k+1 (or further with a delay).
_ENGINE = """
er AS (SELECT sg.*, ca.y AS atr, lead(k) OVER w IS NULL AS is_last,
         coalesce(lead(open, {a}) OVER w{late}) AS nopen,
         coalesce(lead(ts, {a}) OVER w{late_ts}) AS nts
       FROM sg JOIN ca USING (symbol, k) WINDOW w AS (PARTITION BY symbol ORDER BY k)),
en AS (
  SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS k, 'FLAT' AS pos, NULL::DOUBLE AS entry,
         NULL::TIMESTAMP AS ets, NULL::BIGINT AS ek, NULL::VARCHAR AS xdir, NULL::DOUBLE AS xin,
         NULL::TIMESTAMP AS xits, NULL::DOUBLE AS xout, NULL::TIMESTAMP AS xots,
         NULL::DOUBLE AS xatr, NULL::BIGINT AS xk FROM er
  UNION ALL
  SELECT s.symbol, s.k,
    CASE WHEN s.is_last THEN 'FLAT' ELSE s.signal END,
    CASE WHEN s.signal = p.pos THEN p.entry ELSE s.nopen END,
    CASE WHEN s.signal = p.pos THEN p.ets ELSE s.nts END,
    CASE WHEN s.signal = p.pos THEN p.ek ELSE s.k END,
    CASE WHEN p.pos <> 'FLAT' AND (s.is_last OR s.signal <> p.pos) THEN p.pos END,
    p.entry, p.ets, CASE WHEN s.is_last THEN s.close ELSE s.nopen END,
    CASE WHEN s.is_last THEN s.ts ELSE s.nts END, s.atr, p.ek
  FROM en p JOIN er s ON s.symbol = p.symbol AND s.k = p.k + 1),
trades AS (SELECT symbol, xk AS signal_k, xdir AS direction, xits AS entry_ts, xin AS entry_price,
    xots AS exit_ts, xout AS exit_price,
    CASE xdir WHEN 'LONG' THEN 1.0 ELSE -1.0 END * (xout - xin) / 0.1 * 10.0
    - ((20.0 * {stress} + 2 * (10.0 + 0.1 * xatr / 0.1) * {stress}) * 10.0 + 10.0) AS pnl
  FROM en WHERE xdir IS NOT NULL)"""


def engine_sql(delay: int = 0, stress: str = "1.0") -> list[str]:
    late = "".join(f", lead(close, {a}) OVER w" for a in range(delay, 0, -1))
    late_ts = "".join(f", lead(ts, {a}) OVER w" for a in range(delay, 0, -1))
    return [tr_sql(), _COST_ATR, _ENGINE.format(a=1 + delay, late=late, late_ts=late_ts, stress=stress)]


def cross_trades(spark, sf_dir, **kw):
    s = rules.ema_cross(series(spark, sf_dir, 60), 5, 20, also=(ind.cost_atr(14, 0.5),))
    return bt.backtest(s, terms=TERMS, pip_size=PIP, atr_col="cost_atr", **kw)


_TRADE_COLS = ["symbol", "signal_k", "direction", "entry_ts", "entry_price", "exit_ts",
               "exit_price", "pnl"]
_TRADE_SQL = """SELECT symbol, signal_k, direction, entry_ts, round(entry_price, 6) AS entry_price,
  exit_ts, round(exit_price, 6) AS exit_price, round(pnl, 6) AS pnl FROM trades"""


@query("backtest_trades", with_bars(60, *cross_sql(5, 20), *engine_sql(), select=_TRADE_SQL))
def backtest_trades(spark, sf_dir):
    return cross_trades(spark, sf_dir).select(*_TRADE_COLS)


@query("one_bar_delay", with_bars(60, *cross_sql(5, 20), *engine_sql(1), select="""
SELECT symbol, count(*) AS trades, round(avg(pnl), 6) AS delayed_expectancy FROM trades GROUP BY 1"""))
def one_bar_delay(spark, sf_dir):
    return cross_trades(spark, sf_dir, delay=1).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("delayed_expectancy"))


@query("cost_stress_expectancy", with_bars(60, *cross_sql(5, 20), *engine_sql(0, "1.5"), select="""
SELECT symbol, count(*) AS trades, round(avg(pnl), 6) AS expectancy_at_1_5x FROM trades GROUP BY 1"""))
def cost_stress_expectancy(spark, sf_dir):
    return cross_trades(spark, sf_dir, stress=1.5).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("expectancy_at_1_5x"))


BASIC_SQL = """
eq AS (SELECT *, sum(pnl) OVER w AS eqv FROM trades
       WINDOW w AS (PARTITION BY symbol ORDER BY signal_k)),
pk AS (SELECT *, max(eqv) OVER (PARTITION BY symbol ORDER BY signal_k) AS peak FROM eq),
bm AS (SELECT symbol, sum(pnl) AS total_return, max(peak - eqv) AS max_drawdown_abs,
    CASE WHEN max(peak - eqv) > 0 AND arg_max(peak, peak - eqv) <> 0
         THEN max(peak - eqv) / abs(arg_max(peak, peak - eqv)) ELSE 0 END AS max_drawdown_pct,
    CASE WHEN coalesce(stddev_samp(pnl), 0) > 0 THEN avg(pnl) / stddev_samp(pnl) ELSE 0 END
      AS sharpe_ratio,
    count(*) AS trade_count, avg((pnl > 0)::INT) AS win_rate, avg(pnl) AS avg_trade_pnl
  FROM pk GROUP BY symbol)"""
_BASIC_SELECT = """SELECT symbol, round(total_return, 4) AS total_return,
  round(max_drawdown_abs, 4) AS max_drawdown_abs, round(max_drawdown_pct, 4) AS max_drawdown_pct,
  round(sharpe_ratio, 4) AS sharpe_ratio, trade_count, round(win_rate, 4) AS win_rate,
  round(avg_trade_pnl, 4) AS avg_trade_pnl FROM bm"""


@query("backtest_metrics", with_bars(60, *cross_sql(5, 20), *engine_sql(), BASIC_SQL, select=_BASIC_SELECT), digits=4)
def backtest_metrics(spark, sf_dir):
    """Flagship: ticks -> bars -> EMA cross -> next-open trades -> seven metrics per symbol."""
    t = cross_trades(spark, sf_dir)
    return metrics.basic_metrics(
        metrics.drawdown_parts(t, ["symbol"], ["signal_k"], [F.floor(F.col("signal_k") / 10_000)]),
        ["symbol"])


@query("equity_curve", with_bars(60, *cross_sql(5, 20), *engine_sql(), BASIC_SQL, select="""
SELECT symbol, signal_k, round(eqv, 3) AS equity, round(peak - eqv, 3) AS drawdown,
  round(greatest(peak, 0) - eqv, 3) AS drawdown_from_zero FROM pk"""), digits=3)
def equity_curve(spark, sf_dir):
    t = cross_trades(spark, sf_dir)
    e = metrics.equity_curve(t, ["symbol"], ["signal_k"], [F.floor(F.col("signal_k") / 10_000)])
    return e.select("symbol", "signal_k", "equity", "drawdown", "drawdown_from_zero")


@query("research_run", with_bars(60, """
n AS (SELECT symbol, floor(count(*) * 0.7::DOUBLE) AS cut FROM b GROUP BY 1),
pr AS (SELECT b.* REPLACE (CASE WHEN k < cut THEN k ELSE k - cut END::BIGINT AS k,
          b.symbol || CASE WHEN k < cut THEN '|train' ELSE '|oos' END AS symbol)
       FROM b JOIN n ON n.symbol = b.symbol)""",
    ema_mean_sql("f", 5, "pr"), ema_mean_sql("s", 20, "pr"), _CROSS.replace("b.", "pr.").replace("FROM b ", "FROM pr "),
    tr_sql("pr"), _COST_ATR, _ENGINE.format(a=1, late="", late_ts="", stress="1.0"), BASIC_SQL, """
sp AS (SELECT split_part(symbol, '|', 1) AS sym, split_part(symbol, '|', 2) AS part, * FROM bm)""",
    select="""
SELECT o.sym AS symbol, t.trade_count AS train_trades, o.trade_count AS oos_trades,
  round(t.sharpe_ratio, 6) AS train_sharpe, round(o.sharpe_ratio, 6) AS oos_sharpe,
  round(o.total_return, 6) AS oos_total,
  round((t.sharpe_ratio - o.sharpe_ratio) / abs(t.sharpe_ratio), 6) AS sharpe_degradation,
  round(o.trade_count / t.trade_count, 6) AS hold_ratio,
  CASE WHEN o.sharpe_ratio > 0.2 AND o.total_return > 0 THEN 'PROMISING'
       ELSE 'WEAK / NEEDS WORK' END AS verdict
FROM sp t JOIN sp o ON o.sym = t.sym AND t.part = 'train' AND o.part = 'oos'"""))
def research_run(spark, sf_dir):
    """Ratio split, one engine run per part, degradation and preliminary verdict."""
    from tapeworks.operators.validation import ratio_split
    from tapeworks.operators.series import index_series

    s = ratio_split(series(spark, sf_dir, 60), 0.7)
    both = index_series(s.df.drop("k"), (*KEYS, "part"))
    both = rules.ema_cross(both, 5, 20, also=(ind.cost_atr(14, 0.5),))
    t = bt.backtest(both, terms=TERMS, pip_size=PIP, atr_col="cost_atr")
    keys = ["symbol", "part"]
    m = metrics.basic_metrics(metrics.drawdown_parts(
        t, keys, ["signal_k"], [F.floor(F.col("signal_k") / 10_000)]), keys)

    def of(part: str, col: str):
        return F.max(F.when(F.col("part") == part, F.col(col)))

    r = m.groupBy("symbol").agg(
        of("train", "trade_count").alias("train_trades"), of("oos", "trade_count").alias("oos_trades"),
        of("train", "sharpe_ratio").alias("train_sharpe"), of("oos", "sharpe_ratio").alias("oos_sharpe"),
        of("oos", "total_return").alias("oos_total"))
    return r.withColumns({
        "sharpe_degradation": metrics.degradation(F.col("train_sharpe"), F.col("oos_sharpe")),
        "hold_ratio": F.col("oos_trades") / F.col("train_trades"),
        "verdict": F.when((F.col("oos_sharpe") > 0.2) & (F.col("oos_total") > 0), "PROMISING")
        .otherwise("WEAK / NEEDS WORK"),
    })


# --- other rules ----------------------------------------------------------------------------

@query("sweep_signals", with_bars(60, tr_sql(), rma_sql("a", 14), """
v AS (SELECT b.*, CAST(b.ts AS DATE) AS day, a.y AS atr,
    avg(a.y) OVER (PARTITION BY b.symbol ORDER BY b.k ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING) AS m,
    max(high) FILTER (WHERE hour(ts) < 7) OVER d AS rh, min(low) FILTER (WHERE hour(ts) < 7) OVER d AS rl,
    count(*) FILTER (WHERE hour(ts) < 7) OVER d AS rn
  FROM b LEFT JOIN a ON a.symbol = b.symbol AND a.k = b.k
  WINDOW d AS (PARTITION BY b.symbol, CAST(b.ts AS DATE) ORDER BY b.k)),
hits AS (SELECT *, CASE WHEN high > rh AND close < rh THEN 'SHORT' ELSE 'LONG' END AS d
  FROM v WHERE hour(ts) BETWEEN 7 AND 11 AND rn >= 5 AND NOT coalesce(m > 0 AND atr > 1.5 * m, false)
    AND ((high > rh AND close < rh) OR (low < rl AND close > rl))),
h1 AS (SELECT symbol, day, min(k) AS k0 FROM hits GROUP BY 1, 2),
sg AS (SELECT v.symbol, v.ts, CASE WHEN h.k IS NULL THEN 'FLAT' ELSE h.d END AS signal,
    CASE h.d WHEN 'SHORT' THEN h.high + h.atr ELSE h.low - h.atr END AS sl,
    CASE h.d WHEN 'SHORT' THEN h.close - (h.high + h.atr - h.close) * 2.0
             ELSE h.close + (h.close - (h.low - h.atr)) * 2.0 END AS tp
  FROM v LEFT JOIN h1 ON h1.symbol = v.symbol AND h1.day = v.day AND v.k >= h1.k0
    AND hour(v.ts) BETWEEN 7 AND 11
  LEFT JOIN hits h ON h.symbol = h1.symbol AND h.k = h1.k0)""", select=_SIG_SQL))
def sweep_signals(spark, sf_dir):
    return rules.london_sweep(series(spark, sf_dir, 60)).df.select(*_SIG)


_BULL = "(ef > es AND tsi > 0 AND tsi > tsi_signal)"
_BEAR = "(ef < es AND tsi < 0 AND tsi < tsi_signal)"


def _trend_parts() -> list[str]:
    return [ema_first_sql("e20", 20), ema_first_sql("e50", 50), tsi_sql("t"), tr_sql(), rma_sql("a", 14)]


def pwr_sql(cap: str = "100.0") -> list[str]:
    return ["", WEEKLY_SQL, *_trend_parts(),
    _join_sql("x", "e20", "e50", "t", "a", src="lv", ef="e20.y", es="e50.y", tsi="t.tsi",
              tsi_signal="t.tsi_signal", atr="a.y"), f"""
pw AS (SELECT *, (hour(ts) BETWEEN 7 AND 12 OR hour(ts) BETWEEN 13 AND 20) AS gate,
    {_BULL} AS bull, {_BEAR} AS bear,
    close - (prev_low - atr) AS r1, prev_high + atr - close AS r2, close - (prev_high - atr) AS r3,
    prev_low + atr - close AS r4 FROM x),
pc AS (SELECT *, CASE
    WHEN gate AND low <= prev_low + 100.0 AND close >= prev_low AND bull AND r1 > 0 AND r1 <= {cap} THEN 1
    WHEN gate AND high >= prev_high - 100.0 AND close <= prev_high AND bear AND r2 > 0 AND r2 <= {cap} THEN 2
    WHEN gate AND close > prev_high + 0.2 AND bull AND r3 > 0 AND r3 <= {cap} THEN 3
    WHEN gate AND close < prev_low - 0.2 AND bear AND r4 > 0 AND r4 <= {cap} THEN 4 ELSE 0 END AS c FROM pw),
sg AS (SELECT * EXCLUDE (c), CASE WHEN c IN (1, 3) THEN 'LONG' WHEN c IN (2, 4) THEN 'SHORT' ELSE 'FLAT' END AS signal,
    CASE c WHEN 1 THEN prev_low - atr WHEN 2 THEN prev_high + atr WHEN 3 THEN prev_high - atr
           WHEN 4 THEN prev_low + atr END AS sl,
    CASE c WHEN 1 THEN close + 2 * r1 WHEN 2 THEN close - 2 * r2 WHEN 3 THEN close + 2 * r3
           WHEN 4 THEN close - 2 * r4 END AS tp FROM pc)"""]


@query("prev_week_range", with_bars(60, *pwr_sql(), select=_SIG_SQL))
def prev_week_range(spark, sf_dir):
    return rules.prev_week_range(series(spark, sf_dir, 60), max_risk_pips=1000.0,
                              touch_buf_pips=1000.0).df.select(*_SIG)


def bos_sql(src: str = "b", cap: str = "8.0") -> list[str]:
    return [WEEKLY_SQL, BOS_SQL, ema_first_sql("e20", 20), ema_first_sql("e50", 50), tsi_sql("t"),
        _join_sql("x", "e20", "e50", "t", src="bos", ef="e20.y", es="e50.y", tsi="t.tsi",
                  tsi_signal="t.tsi_signal"), f"""
bc AS (SELECT *, CASE
    WHEN bos = 'BOS_UP' AND ob_high IS NOT NULL AND NOT choch_bearish AND low <= ob_high
      AND close >= ob_low AND {_BULL} AND close - (ob_low - 0.5) > 0 AND close - (ob_low - 0.5) <= {cap} THEN 1
    WHEN bos = 'BOS_DOWN' AND ob_high IS NOT NULL AND NOT choch_bullish AND high >= ob_low
      AND close <= ob_high AND {_BEAR} AND ob_high + 0.5 - close > 0 AND ob_high + 0.5 - close <= {cap} THEN 2
    ELSE 0 END AS c FROM x),
sg AS (SELECT *, CASE c WHEN 1 THEN 'LONG' WHEN 2 THEN 'SHORT' ELSE 'FLAT' END AS signal,
    CASE c WHEN 1 THEN ob_low - 0.5 WHEN 2 THEN ob_high + 0.5 END AS sl,
    CASE c WHEN 1 THEN close + 2 * (close - (ob_low - 0.5))
           WHEN 2 THEN close - 2 * (ob_high + 0.5 - close) END AS tp FROM bc)"""]


@query("weekly_bos_retest", with_bars(60, *bos_sql(cap="200.0"), select=_SIG_SQL))
def weekly_bos_retest(spark, sf_dir):
    return rules.weekly_bos_retest(series(spark, sf_dir, 60), max_risk_pips=2000.0).df.select(*_SIG)


def tsi_mom_sql(th: str = "5") -> list[str]:
    return ["", ema_first_sql("e50", 50), tsi_sql("t"), tr_sql(), rma_sql("a", 14), f"""
vis AS (SELECT t.symbol, t.k, tsi, tsi_signal, a.y AS atr, e50.y AS em,
    lag(tsi) OVER w AS pt, lag(tsi_signal) OVER w AS ps
  FROM t JOIN a ON a.symbol = t.symbol AND a.k = t.k JOIN e50 ON e50.symbol = t.symbol AND e50.k = t.k
  WINDOW w AS (PARTITION BY t.symbol ORDER BY t.k)),
sg AS (SELECT b.*, atr, coalesce(pt <= ps AND tsi > tsi_signal, false) AS xup,
    coalesce(pt >= ps AND tsi < tsi_signal, false) AS xdn,
    CASE WHEN hour(ts) BETWEEN 7 AND 20 AND pt <= ps AND tsi > tsi_signal AND tsi > {th} AND close > em THEN 'LONG'
         WHEN hour(ts) BETWEEN 7 AND 20 AND pt >= ps AND tsi < tsi_signal AND tsi < -{th} AND close < em THEN 'SHORT'
         ELSE 'FLAT' END AS signal
  FROM b LEFT JOIN vis ON vis.symbol = b.symbol AND vis.k = b.k),
sgl AS (SELECT *, CASE signal WHEN 'LONG' THEN close - 1.5 * atr WHEN 'SHORT' THEN close + 1.5 * atr END AS sl,
    CASE signal WHEN 'LONG' THEN close + 3 * atr WHEN 'SHORT' THEN close - 3 * atr END AS tp FROM sg)"""]


@query("tsi_momentum", with_bars(15, *tsi_mom_sql("0"), select=_SIG_SQL.replace("FROM sg", "FROM sgl")))
def tsi_momentum(spark, sf_dir):
    return rules.tsi_momentum(series(spark, sf_dir, 15), tsi_threshold=0.0).df.select(*_SIG)


@query("multi_tf_tsi", with_bars(15, bars_sql(60, "h"), ema_first_sql("he", 50, "h"), tsi_sql("ht", "h"),
    tsi_sql("t"), tr_sql(), rma_sql("a", 14), """
hb AS (SELECT h.symbol, h.k, h.ts, CASE WHEN ht.tsi IS NULL OR he.y IS NULL THEN NULL
    WHEN ht.tsi > 0 AND ht.tsi > ht.tsi_signal AND h.close > he.y THEN 'BULL'
    WHEN ht.tsi < 0 AND ht.tsi < ht.tsi_signal AND h.close < he.y THEN 'BEAR' ELSE 'FLAT' END AS raw
  FROM h LEFT JOIN ht ON ht.symbol = h.symbol AND ht.k = h.k LEFT JOIN he ON he.symbol = h.symbol AND he.k = h.k),
hx AS (SELECT symbol, ts + INTERVAL 1 HOUR AS known_at, coalesce(last_value(raw IGNORE NULLS)
    OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'FLAT') AS bias FROM hb),
bb AS (SELECT b.*, coalesce(hx.bias, 'FLAT') AS bias FROM b
  ASOF LEFT JOIN hx ON hx.symbol = b.symbol AND b.ts >= hx.known_at),
vis AS (SELECT t.symbol, t.k, tsi, tsi_signal, a.y AS atr, lag(tsi) OVER w AS pt, lag(tsi_signal) OVER w AS ps
  FROM t JOIN a ON a.symbol = t.symbol AND a.k = t.k WINDOW w AS (PARTITION BY t.symbol ORDER BY t.k)),
c AS (SELECT bb.*, vis.* EXCLUDE (symbol, k), hour(ts) BETWEEN 7 AND 20 AND pt <= ps AND tsi > tsi_signal AS up,
    hour(ts) BETWEEN 7 AND 20 AND pt >= ps AND tsi < tsi_signal AS dn
  FROM bb LEFT JOIN vis ON vis.symbol = bb.symbol AND vis.k = bb.k),
sg AS (SELECT *, CASE WHEN up AND pt < -75 THEN 'LONG' WHEN dn AND pt > 75 THEN 'SHORT'
    WHEN up AND pt < -40 AND bias = 'BULL' THEN 'LONG' WHEN dn AND pt > 40 AND bias = 'BEAR' THEN 'SHORT'
    WHEN up AND bias = 'BULL' AND tsi < 40 THEN 'LONG' WHEN dn AND bias = 'BEAR' AND tsi > -40 THEN 'SHORT'
    ELSE 'FLAT' END AS signal FROM c),
sgl AS (SELECT *, CASE signal WHEN 'LONG' THEN close - 1.5 * atr WHEN 'SHORT' THEN close + 1.5 * atr END AS sl,
    CASE signal WHEN 'LONG' THEN close + 3 * atr WHEN 'SHORT' THEN close - 3 * atr END AS tp FROM sg)""",
    select="SELECT symbol, ts, bias AS h1_bias, signal, round(sl, 6) AS sl, round(tp, 6) AS tp FROM sgl"))
def multi_tf_tsi(spark, sf_dir):
    return rules.multi_tf_tsi(series(spark, sf_dir, 15)).df.select(*_SIG, "h1_bias")


def zones_sql(name: str = "zn", merge: str = "5.0", touches: int = 3) -> str:
    """Recursive CTE (symbol, k, zones) over pv; a zone is {p: price, kd: kind, t: touches}."""
    def add(z: str, price: str, kd: int) -> str:
        same = f"list_transform({z}, lambda x: x.kd = {kd} AND abs(x.p - {price}) <= {merge})"
        pos = f"list_position({same}, true)"
        return f"""CASE WHEN {price} IS NULL THEN {z} WHEN coalesce({pos}, 0) > 0 THEN
          list_transform({z}, lambda x, i: CASE WHEN i = {pos}
            THEN {{'p': x.p, 'kd': x.kd, 't': x.t + 1}} ELSE x END)
          ELSE list_append({z}, {{'p': {price}, 'kd': {kd}, 't': 1}}) END"""

    return f"""
{name} AS (
  SELECT symbol, k, CAST([] AS STRUCT(p DOUBLE, kd INTEGER, t INTEGER)[]) AS zones FROM pv WHERE k = 0
  UNION ALL
  SELECT symbol, k, {add('z2', 'pivot_low', 1)} FROM (
    SELECT symbol, k, pivot_low, {add('z1', 'pivot_high', -1)} AS z2 FROM (
      SELECT s.symbol, s.k, s.pivot_high, s.pivot_low,
        list_transform(list_filter(r.zones, lambda x: (s.close - x.p) * x.kd >= 0),
          lambda x: {{'p': x.p, 'kd': x.kd, 't': x.t +
            CASE WHEN x.kd = 1 AND s.low <= x.p + {merge} THEN 1
                 WHEN x.kd = -1 AND s.high >= x.p - {merge} THEN 1 ELSE 0 END}}) AS z1
      FROM {name} r JOIN pv s ON s.symbol = r.symbol AND s.k = r.k + 1))),
{name}f AS (SELECT symbol, k, list_filter(zones, lambda x: x.kd = 1 AND x.t <= {touches}) AS sup,
  list_filter(zones, lambda x: x.kd = -1 AND x.t <= {touches}) AS res FROM {name})"""


@query("zones", with_bars(60, PIVOT_SQL, zones_sql(), select="""
SELECT b.symbol, b.ts, len(sup) AS n_support, len(res) AS n_resistance,
  len(list_filter(sup, lambda x: close - 15.0 <= x.p AND x.p <= close + 15.0)) > 0 AS near_support,
  len(list_filter(res, lambda x: close - 15.0 <= x.p AND x.p <= close + 15.0)) > 0 AS near_resistance
FROM b JOIN znf ON znf.symbol = b.symbol AND znf.k = b.k"""))
def zones(spark, sf_dir):
    s = zone_proximity(series(spark, sf_dir, 60), pip_size=PIP, merge_pips=50.0, gate_pips=150.0)
    return s.df.select("symbol", "ts", "n_support", "n_resistance", "near_support", "near_resistance")


def gold_sql(gate: str = "15.0", touches: int = 3) -> list[str]:
    return ["", PIVOT_SQL, zones_sql(touches=touches), *_trend_parts(), rma_sql("a10", 10), supertrend_sql("st", "a10"),
    _join_sql("x", "e20", "e50", "t", "a", "st", "znf", ef="e20.y", es="e50.y", tsi="t.tsi",
              tsi_signal="t.tsi_signal", atr="a.y", dir="st.dir", sup="znf.sup", res="znf.res"), f"""
gp AS (SELECT *, coalesce(ef > es AND dir = 1 AND atr IS NOT NULL AND tsi IS NOT NULL, false) AS hold_long,
    coalesce(ef < es AND dir = -1 AND atr IS NOT NULL AND tsi IS NOT NULL, false) AS hold_short FROM x),
gs AS (SELECT *, CASE
    WHEN hold_long AND {_BULL} AND len(list_filter(sup, lambda z: close - {gate} <= z.p AND z.p <= close + {gate})) > 0 THEN 'LONG'
    WHEN hold_short AND {_BEAR} AND len(list_filter(res, lambda z: close - {gate} <= z.p AND z.p <= close + {gate})) > 0 THEN 'SHORT'
    ELSE 'FLAT' END AS signal FROM gp),
sg AS (SELECT *, CASE signal WHEN 'LONG' THEN close - 1.5 * atr WHEN 'SHORT' THEN close + 1.5 * atr END AS sl,
    CASE signal WHEN 'LONG' THEN close + 3 * atr WHEN 'SHORT' THEN close - 3 * atr END AS tp FROM gs)"""]


@query("gold_pullback", with_bars(60, *gold_sql(), select=_SIG_SQL))
def gold_pullback(spark, sf_dir):
    return rules.gold_pullback(series(spark, sf_dir, 60)).df.select(*_SIG)


# --- position-aware trades ------------------------------------------------------------------

def walk_sql(src: str, exit_long: str, exit_short: str, *, engine: bool = False) -> str:
    """Recursive CTE: one open position per symbol, walked row by row."""
    last = "s.is_last OR " if engine else ""
    may = "NOT s.is_last" if engine else "true"
    return f"""
wr AS (SELECT *, lead(k) OVER w IS NULL AS is_last, lead(open) OVER w AS nopen, lead(ts) OVER w AS nts
       FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY k)),
wk_ AS (
  SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS k, 'FLAT' AS pos, NULL::BIGINT AS ek, NULL::DOUBLE AS psl,
    NULL::DOUBLE AS ptp, NULL::VARCHAR AS xdir, NULL::BIGINT AS xek, NULL::DOUBLE AS xsl,
    NULL::DOUBLE AS xtp, NULL::VARCHAR AS kind FROM wr
  UNION ALL
  SELECT symbol, k, CASE WHEN pos = 'FLAT' THEN CASE WHEN may THEN signal ELSE 'FLAT' END
                         WHEN kd IS NULL THEN pos ELSE 'FLAT' END,
    CASE WHEN pos = 'FLAT' THEN k ELSE ek END, CASE WHEN pos = 'FLAT' THEN sl ELSE psl END,
    CASE WHEN pos = 'FLAT' THEN tp ELSE ptp END,
    CASE WHEN kd IS NOT NULL THEN pos END, ek, psl, ptp, kd
  FROM (SELECT s.symbol, s.k, p.pos, p.ek, p.psl, p.ptp, s.signal, s.sl, s.tp, {may} AS may,
      CASE WHEN p.pos = 'LONG' THEN CASE WHEN s.low <= p.psl THEN 'SL' WHEN s.high >= p.ptp THEN 'TP'
             WHEN {last}{exit_long} THEN 'SIGNAL' END
           WHEN p.pos = 'SHORT' THEN CASE WHEN s.high >= p.psl THEN 'SL' WHEN s.low <= p.ptp THEN 'TP'
             WHEN {last}{exit_short} THEN 'SIGNAL' END END AS kd
    FROM wk_ p JOIN wr s ON s.symbol = p.symbol AND s.k = p.k + 1)),
wt AS (SELECT symbol, xdir AS direction, xek AS ek, k AS xk, xsl AS sl, xtp AS tp, kind FROM wk_ WHERE xdir IS NOT NULL)"""


_ENGINE_OUT = """
SELECT e.symbol, e.k AS signal_k, direction, e.nts AS entry_ts, round(e.nopen, 6) AS entry_price,
  coalesce(x.nts, x.ts) AS exit_ts, round(coalesce(x.nopen, x.close), 6) AS exit_price, kind AS exit_kind,
  round(CASE direction WHEN 'LONG' THEN 1.0 ELSE -1.0 END * (coalesce(x.nopen, x.close) - e.nopen) / 0.1 * 10.0
   - ((20.0 + 2 * (10.0 + 0.1 * x.atr / 0.1)) * 10.0 + 10.0), 6) AS pnl
FROM wt JOIN wr e ON e.symbol = wt.symbol AND e.k = wt.ek JOIN wr x ON x.symbol = wt.symbol AND x.k = wt.xk"""
_ENGINE_COLS = [*_TRADE_COLS[:7], "exit_kind", "pnl"]


@query("engine_trades_range", with_bars(60, *pwr_sql(), walk_sql("sg", "false", "false", engine=True), select=_ENGINE_OUT))
def engine_trades_range(spark, sf_dir):
    s = rules.prev_week_range(series(spark, sf_dir, 60), max_risk_pips=1000.0,
                              touch_buf_pips=1000.0)
    return fills.engine_trades(s, terms=TERMS, pip_size=PIP).select(*_ENGINE_COLS)


@query("engine_trades_pullback", with_bars(60, *gold_sql(), """
sgh AS (SELECT * REPLACE (-1e9 AS sl, NULL::DOUBLE AS tp) FROM sg WHERE false UNION ALL
        SELECT * REPLACE (NULL::DOUBLE AS sl, NULL::DOUBLE AS tp) FROM sg)""",
    walk_sql("sgh", "NOT s.hold_long", "NOT s.hold_short", engine=True), select=_ENGINE_OUT))
def engine_trades_pullback(spark, sf_dir):
    """The pullback rule leaves when its trend filters part; its levels do not close trades."""
    s = rules.gold_pullback(series(spark, sf_dir, 60))
    none = F.lit(None).cast("double")
    s = s.with_columns({"sl": none, "tp": none})
    return fills.engine_trades(s, terms=TERMS, pip_size=PIP, exit_long=~F.col("hold_long"),
                               exit_short=~F.col("hold_short")).select(*_ENGINE_COLS)


_LEVEL_OUT = """
SELECT e.symbol, direction, e.ts AS entry_ts, round(e.close, 6) AS entry_price, x.ts AS exit_ts,
  round(CASE kind WHEN 'SL' THEN wt.sl WHEN 'TP' THEN wt.tp ELSE x.close END, 6) AS exit_price,
  CASE kind WHEN 'SIGNAL' THEN 'REV' ELSE kind END AS exit_kind,
  round(CASE direction WHEN 'LONG' THEN 1.0 ELSE -1.0 END *
   (CASE kind WHEN 'SL' THEN wt.sl WHEN 'TP' THEN wt.tp ELSE x.close END - e.close) / 0.1, 6) AS pnl_pips
FROM wt JOIN wr e ON e.symbol = wt.symbol AND e.k = wt.ek JOIN wr x ON x.symbol = wt.symbol AND x.k = wt.xk"""


def _level_trades(spark, sf_dir):
    s = rules.tsi_momentum(series(spark, sf_dir, 15), tsi_threshold=0.0)
    return fills.level_trades(s, pip_size=PIP, exit_long=F.col("cross_down"),
                              exit_short=F.col("cross_up"), signal_kind="REV")


@query("level_trades_tsi", with_bars(15, *tsi_mom_sql("0"), walk_sql("sgl", "s.xdn", "s.xup"), select=_LEVEL_OUT))
def level_trades_tsi(spark, sf_dir):
    return _level_trades(spark, sf_dir).drop("timeframe", "held")


@query("walk_forward_report", with_bars(15, *tsi_mom_sql("0"), walk_sql("sgl", "s.xdn", "s.xup"), f"""
lt AS ({_LEVEL_OUT}),
q AS (SELECT *, sum(pnl_pips) OVER (PARTITION BY symbol ORDER BY entry_ts) AS eqv FROM lt),
q2 AS (SELECT *, max(eqv) OVER (PARTITION BY symbol ORDER BY entry_ts) AS pk FROM q),
m AS (SELECT symbol, count(*) AS trade_count, avg((pnl_pips > 0)::INT) AS win_rate, sum(pnl_pips) AS total,
    max(pk - eqv) / CASE WHEN abs(max(pk)) > 0 THEN abs(max(pk)) ELSE 1 END AS dd,
    CASE WHEN stddev_pop(pnl_pips) > 0 THEN avg(pnl_pips) / stddev_pop(pnl_pips) ELSE 0 END AS sharpe
  FROM q2 GROUP BY 1)""", select="""
SELECT symbol, trade_count, round(win_rate, 5) AS win_rate, round(total, 3) AS total_pnl_pips,
  round(dd, 4) AS max_drawdown_pct, round(sharpe, 5) AS sharpe,
  CASE WHEN trade_count >= 10 AND win_rate >= 0.4 AND total > 0 AND dd <= 0.2 THEN 'GO' ELSE 'NO_GO' END AS verdict,
  concat_ws(',', CASE WHEN trade_count < 10 THEN 'trades' END, CASE WHEN win_rate < 0.4 THEN 'win_rate' END,
    CASE WHEN total <= 0 THEN 'total_pnl' END, CASE WHEN dd > 0.2 THEN 'max_drawdown' END) AS failures FROM m"""))
def walk_forward_report(spark, sf_dir):
    """Script metrics with population deviation and final-peak drawdown, plus the verdict."""
    from tapeworks.operators.validation import verdict_table

    t = _level_trades(spark, sf_dir)
    m = metrics.walk_forward_metrics(metrics.drawdown_parts(
        t, ["symbol"], ["entry_ts"], [F.date_trunc("month", "entry_ts")], "pnl_pips"), ["symbol"])
    v = verdict_table(m, [
        ("trades", F.col("trade_count") < 10), ("win_rate", F.col("win_rate") < 0.4),
        ("total_pnl", F.col("total_pnl_pips") <= 0), ("max_drawdown", F.col("max_drawdown_pct") > 0.2)])
    return v.select(
        "symbol", "trade_count", F.round("win_rate", 5).alias("win_rate"),
        F.round("total_pnl_pips", 3).alias("total_pnl_pips"),
        F.round("max_drawdown_pct", 4).alias("max_drawdown_pct"), F.round("sharpe", 5).alias("sharpe"),
        "verdict", F.concat_ws(",", "failures").alias("failures"))


@query("paper_trades", with_bars(60, *pwr_sql(), walk_sql("sg", "s.signal <> 'LONG'", "s.signal <> 'SHORT'"), select="""
SELECT e.symbol, direction, e.ts AS entry_ts, round(e.close, 6) AS entry_price, x.ts AS exit_ts,
  round(x.close, 6) AS exit_price, 'EXIT_' || kind AS exit_kind,
  round(CASE direction WHEN 'LONG' THEN x.close - e.close ELSE e.close - x.close END, 6) AS pnl,
  CASE kind WHEN 'TP' THEN 'win' WHEN 'SL' THEN 'loss' ELSE 'expired' END AS status,
  round_even(date_diff('second', e.ts, x.ts) / 14400, 0)::INT AS n_bars_held
FROM wt JOIN wr e ON e.symbol = wt.symbol AND e.k = wt.ek JOIN wr x ON x.symbol = wt.symbol AND x.k = wt.xk"""))
def paper_trades(spark, sf_dir):
    from tapeworks.functions.scalars import bars_held, lifecycle_status

    t = fills.paper_trades(rules.prev_week_range(series(spark, sf_dir, 60), max_risk_pips=1000.0,
                              touch_buf_pips=1000.0))
    secs = F.unix_timestamp("exit_ts") - F.unix_timestamp("entry_ts")
    t = t.withColumn("status", lifecycle_status(F.col("exit_kind")))
    return t.withColumn("n_bars_held", bars_held(secs)).drop("timeframe", "sl_at_entry", "tp_at_entry")


# --- time-aware joins -----------------------------------------------------------------------

@query("asof_multi_tf", with_bars(15, bars_sql(60, "h"), bars_sql(240, "d"), select="""
SELECT b.symbol, b.ts, h.ts AS h1_ts, round(h.close, 6) AS h1_close, d.ts AS h4_ts, round(d.close, 6) AS h4_close
FROM b ASOF LEFT JOIN (SELECT *, ts + INTERVAL 1 HOUR AS v FROM h) h ON h.symbol = b.symbol AND b.ts >= h.v
ASOF LEFT JOIN (SELECT *, ts + INTERVAL 4 HOUR AS v FROM d) d ON d.symbol = b.symbol AND b.ts >= d.v"""))
def asof_multi_tf(spark, sf_dir):
    left = bars(spark, sf_dir, 15).select("symbol", "ts")
    return joins.asof_many(left, [
        (bars(spark, sf_dir, 60), "h1_", ["close"], 3600),
        (bars(spark, sf_dir, 240), "h4_", ["close"], 14_400)], ["symbol"], bucket_seconds=7 * 86_400)


def _news(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return ev.select(F.col("ts").cast("timestamp").alias("event_ts"), "event_id")


_NEWS_SQL = "nw AS (SELECT ts AS event_ts, event_id FROM events WHERE event_type = 'error')"


@query("news_blackout", with_bars(15, _NEWS_SQL, select="""
SELECT symbol, ts, EXISTS (SELECT 1 FROM nw WHERE b.ts BETWEEN event_ts - INTERVAL 30 MINUTE
  AND event_ts + INTERVAL 15 MINUTE) AS blocked FROM b"""))
def news_blackout(spark, sf_dir):
    b, n = bars(spark, sf_dir, 15).select("symbol", "ts"), _news(spark, sf_dir)
    return joins.with_blackout(b, n)


@query("next_event", with_bars(60, _NEWS_SQL, select="""
SELECT b.symbol, b.ts, nw.event_ts AS next_ts, nw.event_id AS next_event_id
FROM b ASOF LEFT JOIN nw ON b.ts < nw.event_ts"""))
def next_event(spark, sf_dir):
    b = bars(spark, sf_dir, 60).select("symbol", "ts")
    return joins.next_event(b, _news(spark, sf_dir), values=["event_id"])


@query("bars_in_parent", with_bars(15, bars_sql(240, "p"), """
pp AS (SELECT symbol, ts AS parent_ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev_parent_ts FROM p)""",
    select="""SELECT b.symbol, parent_ts, count(*) AS bars, round(min(low), 6) AS low, round(max(high), 6) AS high
FROM b JOIN pp ON pp.symbol = b.symbol AND b.ts > prev_parent_ts AND b.ts <= parent_ts GROUP BY 1, 2"""))
def bars_in_parent(spark, sf_dir):
    j = joins.bars_in_parent(bars(spark, sf_dir, 15).drop("timeframe"),
                             bars(spark, sf_dir, 240).select("symbol", "ts"), ["symbol"], parent_seconds=14_400)
    return j.groupBy("symbol", "parent_ts").agg(
        F.count(F.lit(1)).alias("bars"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("triple_barrier", with_bars(60, *cross_sql(5, 20), """
en AS (SELECT symbol, k, signal AS direction, close AS entry,
    CASE signal WHEN 'LONG' THEN close - 20 ELSE close + 20 END AS sl,
    CASE signal WHEN 'LONG' THEN close + 30 ELSE close - 30 END AS tp FROM sg WHERE signal <> 'FLAT'),
hit AS (SELECT en.symbol, en.k, min(b.k) AS hk FROM en JOIN b ON b.symbol = en.symbol AND b.k BETWEEN en.k + 1 AND en.k + 24
    AND CASE direction WHEN 'LONG' THEN b.low <= sl OR b.high >= tp ELSE b.high >= sl OR b.low <= tp END GROUP BY 1, 2)""",
    select="""SELECT en.symbol, en.k, direction, b.ts AS exit_ts,
  CASE WHEN b.k IS NULL THEN 'OPEN' WHEN CASE direction WHEN 'LONG' THEN b.low <= sl ELSE b.high >= sl END THEN 'SL' ELSE 'TP' END AS outcome,
  round(CASE WHEN b.k IS NULL THEN 0.0 WHEN CASE direction WHEN 'LONG' THEN b.low <= sl ELSE b.high >= sl END
    THEN -abs(entry - sl) / 0.1 ELSE abs(tp - entry) / 0.1 END, 4) AS pnl_pips
FROM en LEFT JOIN hit ON hit.symbol = en.symbol AND hit.k = en.k LEFT JOIN b ON b.symbol = hit.symbol AND b.k = hit.hk"""), digits=4)
def triple_barrier(spark, sf_dir):
    s = rules.ema_cross(series(spark, sf_dir, 60), 5, 20)
    c, long = F.col("close"), F.col("signal") == "LONG"
    e = s.df.where(F.col("signal") != "FLAT").select(
        "symbol", "k", F.col("signal").alias("direction"), c.alias("entry"),
        F.when(long, c - 20).otherwise(c + 20).alias("sl"),
        F.when(long, c + 30).otherwise(c - 30).alias("tp"))
    return joins.triple_barrier(e, s.df, ["symbol"]).select(
        "symbol", "k", "direction", "exit_ts", "outcome", "pnl_pips")


# --- confluence scan ------------------------------------------------------------------------

LOOSE = {"zone_entry_pips": 3000.0, "max_zone_touches": 1000}


def _scan(spark, sf_dir, h1_params: dict | None = None, slope: float = 0.5):
    m15 = series(spark, sf_dir, 15)
    at = (F.col("ts") + F.expr("INTERVAL 15 MINUTE")).alias("ts")
    return scan.confluence_scan(
        series(spark, sf_dir, 240), series(spark, sf_dir, 60), m15, m15.df.select("symbol", at),
        h4_params={"max_risk_pips": 2000.0}, h1_params=h1_params, min_slope_price=slope), m15


def _sub(name: str, minutes: int, parts: list[str], select: str) -> str:
    """A nested query over its own bars, so that CTE names of different timeframes stay apart."""
    ctes = ",".join(p for p in [TICKS_SQL, bars_sql(minutes), *parts] if p)
    return f"{name} AS (WITH RECURSIVE {ctes} {select})"


def scan_sql(gate: str = "15.0", touches: int = 3, slope: str = "0.5") -> list[str]:
    trend = EMA_TREND_SQL.replace("0.5", slope)
    return [
    _sub("s4", 240, [*bos_sql(cap="200.0"), ema_first_sql("tt", 50), trend.replace("t.y", "tt.y").replace("JOIN t ON t.symbol = b.symbol AND t.k", "JOIN tt ON tt.symbol = b.symbol AND tt.k")],
         "SELECT sg.symbol, sg.ts, sg.k, sg.close, sg.signal, sg.sl, sg.tp, trend.trend, sg.ts + INTERVAL 4 HOUR AS v FROM sg JOIN trend ON trend.symbol = sg.symbol AND trend.k = sg.k"),
    _sub("s1", 60, gold_sql(gate, touches), "SELECT symbol, ts, k, close, signal, sl, tp, ts + INTERVAL 1 HOUR AS v FROM sg"),
    _sub("s15", 15, cross_sql(9, 21), "SELECT symbol, ts, k, signal, ts + INTERVAL 15 MINUTE AS v FROM sg"),
    """
j AS (SELECT s15.symbol, s15.v AS ts, s4.ts AS h4_ts, s4.k AS k4, s1.k AS k1, s15.k AS k15,
    s4.signal AS g4, s4.trend AS tr4, s4.sl AS sl4, s4.tp AS tp4, s1.signal AS g1, s1.close AS c1, s1.sl AS sl1, s1.tp AS tp1, s15.signal AS g15
  FROM s15 ASOF LEFT JOIN s4 ON s4.symbol = s15.symbol AND s15.v >= s4.v
  ASOF LEFT JOIN s1 ON s1.symbol = s15.symbol AND s15.v >= s1.v),
j2 AS (SELECT *, coalesce(k4 >= 1 AND k1 >= 1 AND k15 >= 1, false) AS ok FROM j),
j3 AS (SELECT symbol, ts, h4_ts, CASE WHEN ok THEN g4 ELSE 'FLAT' END AS h4_signal, CASE WHEN ok THEN tr4 ELSE 'FLAT' END AS h4_trend,
    CASE WHEN ok THEN g1 ELSE 'FLAT' END AS h1_signal, CASE WHEN ok THEN g15 ELSE 'FLAT' END AS m15_signal, sl4, tp4, c1, sl1, tp1 FROM j2),
sc AS (SELECT *, h4_trend <> 'FLAT' AND h1_signal = h4_trend AS confluence FROM j3),
scn AS (SELECT symbol, ts, h4_ts, h4_signal, h4_trend, h1_signal, m15_signal, confluence,
    CASE WHEN confluence THEN h4_trend ELSE 'FLAT' END AS direction, CASE WHEN confluence THEN c1 END AS entry_price,
    CASE WHEN confluence THEN CASE WHEN h4_signal = h4_trend AND sl4 IS NOT NULL THEN sl4 ELSE sl1 END END AS sl,
    CASE WHEN confluence THEN CASE WHEN h4_signal = h4_trend AND tp4 IS NOT NULL THEN tp4 ELSE tp1 END END AS tp,
    CASE WHEN confluence THEN CASE WHEN h4_signal = h4_trend AND sl4 IS NOT NULL THEN 'BOS' ELSE 'ATR' END END AS sl_source FROM sc)"""]


@query("confluence_scan", "WITH " + ",".join([TICKS_SQL, *scan_sql()]) + """
SELECT * REPLACE (round(entry_price, 6) AS entry_price, round(sl, 6) AS sl, round(tp, 6) AS tp) FROM scn""")
def confluence_scan(spark, sf_dir):
    return _scan(spark, sf_dir)[0]


SCORED_SQL = """
st AS (SELECT *, abs(entry_price - sl) / 0.1 AS sl_pips, abs(tp - entry_price) / 0.1 AS tp_pips FROM scn),
sv AS (SELECT *, CASE WHEN sl_pips > 0 THEN tp_pips / sl_pips END AS rr,
    CASE WHEN h4_trend <> 'FLAT' THEN 15 + CASE WHEN h1_signal = h4_trend THEN 10 ELSE 0 END
      + CASE WHEN m15_signal = h4_trend THEN 5 ELSE 0 END ELSE 0 END AS score_structure,
    CASE WHEN entry_price IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN sl IS NOT NULL THEN 10 ELSE 0 END
      + CASE WHEN tp IS NOT NULL THEN 5 ELSE 0 END AS score_momentum,
    CASE WHEN isodow(ts) >= 6 THEN 0 WHEN hour(ts) IN (13, 14, 15, 16) THEN 20 WHEN hour(ts) BETWEEN 8 AND 12 THEN 16
      WHEN hour(ts) BETWEEN 17 AND 21 THEN 14 WHEN hour(ts) < 8 THEN 8 ELSE 0 END AS score_session FROM st),
sw AS (SELECT *, CASE WHEN entry_price IS NULL OR sl IS NULL THEN 0 ELSE CASE WHEN sl_pips >= 15 THEN 10 ELSE 0 END
      + CASE WHEN rr >= 1.5 THEN 10 ELSE 0 END END AS score_cost FROM sv),
sx AS (SELECT *, least(score_structure + score_momentum + score_session + score_cost, 100) AS score_total FROM sw)"""


@query("scored_signals", "WITH " + ",".join([TICKS_SQL, *scan_sql(), SCORED_SQL]) + """
SELECT symbol, ts, score_structure, score_momentum, score_session, score_cost, score_total,
  CASE WHEN score_total >= 70 THEN 'HIGH' WHEN score_total >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS score_label,
  round(rr, 6) AS rr, round(sl_pips, 6) AS sl_pips FROM sx""")
def scored_signals(spark, sf_dir):
    return scan.scored(_scan(spark, sf_dir)[0]).select(
        "symbol", "ts", "score_structure", "score_momentum", "score_session", "score_cost",
        "score_total", "score_label", "rr", "sl_pips")
