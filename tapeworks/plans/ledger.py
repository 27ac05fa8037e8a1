"""Queries over the trade ledger: metrics, costs, splits, resampling, trials and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import dims
from tapeworks.functions import costs
from tapeworks.functions.stats import CDF_DEN, CDF_NUM, EULER_MASCHERONI, INV_A, INV_B, INV_C, INV_D
from tapeworks.operators import indicators as ind
from tapeworks.operators import joins, metrics, risk, trials
from tapeworks.operators import validation as val
from tapeworks.operators.series import index_series
from tapeworks.plans.registry import ORACLES, query
from tapeworks.plans.tables import series, table
from tapeworks.storage import materialize

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades; run = return flag."""
    pnl = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("status"), *ORDER, pnl.alias("pnl"))


def chunk() -> list:
    """Order-preserving pieces: ship date, then ranges of a million order keys."""
    return [F.col("l_shipdate"), F.floor(F.col("l_orderkey") / 1_000_000)]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pnl and number of trades per run: the whole ledger, combined map-side to one row per run and day."""
    return ledger(spark, sf_dir).groupBy("run", F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.sum("pnl"), 4).alias("pnl"), F.count(F.lit(1)).alias("trades"))


def _per_trade():
    """Mean pnl of the trades of grouped days."""
    return F.sum("pnl") / F.sum("trades")


def trade_series(spark: SparkSession, sf_dir: str):
    """The trades of each run in order."""
    led = ledger(spark, sf_dir).select("run", "l_shipdate", F.struct(*ORDER).alias("order"), "pnl")
    return index_series(led, ("run",), order="l_shipdate", tie="order")


_ORD = ", ".join(ORDER)
LEDGER_SQL = f"""
led AS (SELECT l_returnflag AS run, l_linestatus AS status, {_ORD},
          l_extendedprice * (l_discount - l_tax) AS pnl FROM lineitem),
eq AS (SELECT *, sum(pnl) OVER (PARTITION BY run ORDER BY {_ORD}) AS eqv FROM led),
pk AS (SELECT *, max(eqv) OVER (PARTITION BY run ORDER BY {_ORD}) AS peak FROM eq)"""
DAILY_SQL = """
daily AS (SELECT l_returnflag AS run, CAST(l_shipdate AS DATE) AS day,
    round(sum(l_extendedprice * (l_discount - l_tax)), 4) AS pnl, count(*) AS trades FROM lineitem GROUP BY 1, 2),
ds AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY day) - 1 AS k FROM daily),
sz AS (SELECT run, count(*) AS n FROM ds GROUP BY 1)"""


@query("ledger_metrics", "WITH " + LEDGER_SQL + """
SELECT run, count(*) AS trade_count, round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 4) AS profit_factor,
  round(avg(pnl), 4) AS expectancy, round(avg((pnl > 0)::INT), 4) AS win_rate,
  round(max(greatest(peak, 0) - eqv), 4) AS max_drawdown, round(avg(pnl) / stddev_samp(pnl), 4) AS sharpe,
  avg(pnl) > 0 AND sum(pnl) > 0 AS is_profitable FROM pk GROUP BY run""", digits=4)
def ledger_metrics(spark, sf_dir):
    p = metrics.drawdown_parts(ledger(spark, sf_dir), ["run"], ORDER, chunk())
    return metrics.strategy_metrics(p, ["run"])


@query("ledger_script_metrics", "WITH " + LEDGER_SQL + """
SELECT run, status, count(*) AS trade_count, round(avg((pnl > 0)::INT), 4) AS win_rate, round(sum(pnl), 4) AS total_pnl_pips,
  round(avg(pnl), 4) AS avg_pnl_pips, round(max(pk2 - eq2) / abs(max(pk2)), 4) AS max_drawdown_pct,
  round(avg(pnl) / stddev_pop(pnl), 4) AS sharpe
FROM (SELECT *, max(eq2) OVER w AS pk2 FROM (SELECT *, sum(pnl) OVER (PARTITION BY run, status ORDER BY """ + _ORD + """) AS eq2 FROM led)
  WINDOW w AS (PARTITION BY run, status ORDER BY """ + _ORD + """)) GROUP BY 1, 2""", digits=4)
def ledger_script_metrics(spark, sf_dir):
    keys = ["run", "status"]
    p = metrics.drawdown_parts(ledger(spark, sf_dir), keys, ORDER, chunk())
    return metrics.walk_forward_metrics(p, keys)


@query("drawdown_conventions", "WITH " + LEDGER_SQL + """
SELECT run, round(max(peak - eqv), 4) AS dd_from_first, round(max(greatest(peak, 0) - eqv), 4) AS dd_from_zero,
  round(max(peak - eqv) / abs(max(peak)), 4) AS dd_pct_final_peak,
  round(max(peak - eqv) / abs(arg_max(peak, peak - eqv)), 4) AS dd_pct_own_peak FROM pk GROUP BY run""", digits=4)
def drawdown_conventions(spark, sf_dir):
    p = metrics.drawdown_parts(ledger(spark, sf_dir), ["run"], ORDER, chunk())
    a, z = metrics.summarize(p, ["run"]), metrics.summarize(p, ["run"], from_zero=True)
    return a.join(z.select("run", F.col("max_dd").alias("zero_dd")), "run").select(
        "run", F.col("max_dd").alias("dd_from_first"), F.col("zero_dd").alias("dd_from_zero"),
        (F.col("max_dd") / F.abs("top")).alias("dd_pct_final_peak"),
        (F.col("max_dd") / F.abs("dd_peak")).alias("dd_pct_own_peak"))


@query("ledger_by_year_rollup", """
SELECT l_returnflag AS run, year(l_shipdate) AS year, l_linestatus AS status, count(*) AS trades,
  round(avg((l_discount > l_tax)::INT), 4) AS win_rate, round(sum(l_extendedprice * (l_discount - l_tax)), 4) AS pnl
FROM lineitem GROUP BY ROLLUP (1, 2, 3)""", digits=4)
def ledger_by_year_rollup(spark, sf_dir):
    d = ledger(spark, sf_dir).withColumn("year", F.year("l_shipdate").cast("bigint"))
    return d.rollup("run", "year", "status").agg(
        F.count(F.lit(1)).alias("trades"), metrics.win_rate(F.col("pnl")).alias("win_rate"),
        F.sum("pnl").alias("pnl"))


@query("journal_performance", "WITH " + LEDGER_SQL + """
SELECT run, count(*) AS trade_count, count(*) FILTER (WHERE pnl > 0) AS win_count, round(avg((pnl > 0)::INT), 4) AS win_rate,
  round(sum(pnl), 4) AS total_pnl, round(avg(pnl), 4) AS avg_pnl,
  round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 4) AS profit_factor,
  round(max(greatest(peak, 0) - eqv), 4) AS max_drawdown_abs, round(avg(pnl) / stddev_samp(pnl), 4) AS sharpe_ratio,
  count(*) FILTER (WHERE l_linenumber % 3 = 0) AS exits_sl, count(*) FILTER (WHERE l_linenumber % 3 = 1) AS exits_tp,
  count(*) FILTER (WHERE l_linenumber % 3 = 2) AS exits_signal, min(l_shipdate) AS first_trade_ts, max(l_shipdate) AS last_trade_ts
FROM pk GROUP BY run""", digits=4)
def journal_performance(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("EXIT_SL"), F.lit("EXIT_TP"), F.lit("EXIT_SIGNAL")), F.col("l_linenumber") % 3 + 1)
    t = ledger(spark, sf_dir).withColumns({
        "exit_kind": kind, "entry_ts": F.col("l_shipdate"), "exit_ts": F.col("l_shipdate")})
    r = metrics.journal_performance(t, ["run"], ORDER, chunk())
    exits = [F.element_at("exit_counts", F.lit(f"EXIT_{n}")).alias(f"exits_{n.lower()}") for n in ("SL", "TP", "SIGNAL")]
    return r.select(
        "run", "trade_count", "win_count", "win_rate", "total_pnl", "avg_pnl",
        "profit_factor", "max_drawdown_abs", "sharpe_ratio", *exits,
        "first_trade_ts", "last_trade_ts")


# --- costs ----------------------------------------------------------------------------------

_SYM = [s for s, *_ in dims.INSTRUMENTS]
_COST_DIM = "(VALUES ('EUR/USD', 0.8, 3.5, 0.3, 0.05, 10.0), ('GBP/USD', 1.2, 3.5, 0.4, 0.06, 10.0), ('USD/JPY', 0.9, 3.5, 0.3, 0.05, 9.0), ('XAU/USD', 20.0, 5.0, 10.0, 0.10, 10.0)) c(symbol, fl, com, fx, kk, pv)"


@query("cost_stress", f"""
WITH t AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'EUR/USD' WHEN 1 THEN 'GBP/USD' WHEN 2 THEN 'USD/JPY' ELSE 'XAU/USD' END AS symbol,
    CASE l_returnflag WHEN 'A' THEN 'ASIA' WHEN 'N' THEN 'LONDON' ELSE NULL END AS session, l_tax > 0.07 AS news,
    l_linestatus = 'F' AS is_stop, l_discount * 100 AS realized, l_quantity AS atr FROM lineitem),
m AS (SELECT t.*, c.*, f.stress, CASE WHEN session = 'ASIA' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN news THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END * f.stress AS mk
  FROM t JOIN {_COST_DIM} ON c.symbol = t.symbol, (VALUES (1.0::DOUBLE), (1.25::DOUBLE), (1.5::DOUBLE)) f(stress)),
p AS (SELECT m.symbol, stress, greatest(realized, fl::DOUBLE) * mk + (fx::DOUBLE + kk::DOUBLE * atr) * mk
    + (fx::DOUBLE + kk::DOUBLE * atr) * CASE WHEN is_stop THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * mk AS pips, pv::DOUBLE AS pv, com::DOUBLE AS com FROM m)
SELECT symbol, stress, count(*) AS fills, round(sum(pips), 5) AS cost_pips, round(sum(pips * pv + com * 2.0::DOUBLE), 5) AS cost_currency FROM p GROUP BY 1, 2""", digits=5)
def cost_stress(spark, sf_dir):
    """Round-trip costs of every line item under the three stress factors."""
    li = table(spark, sf_dir, "lineitem")
    t = li.select(
        F.element_at(F.array(*[F.lit(s) for s in _SYM]), F.col("l_linenumber") % 4 + 1).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "ASIA").when(F.col("l_returnflag") == "N", "LONDON").alias("session"),
        (F.col("l_tax") > 0.07).alias("news"), (F.col("l_linestatus") == "F").alias("is_stop"),
        (F.col("l_discount") * 100).alias("realized"), F.col("l_quantity").alias("atr"))
    dim = dims.cost_profiles(spark).join(dims.instruments(spark).select("symbol", "pip_value_per_lot"), "symbol")
    df = costs.stress_sweep(joins.lookup(t, dim, "symbol", required="pip_value_per_lot"))
    kw = dict(atr_pips=F.col("atr"), session=F.col("session"), realized=F.col("realized"),
              exit_on_stop=F.col("is_stop"), news=F.col("news"), stress=F.col("stress"))
    terms = costs.CostTerms.from_columns()
    return df.groupBy("symbol", "stress").agg(
        F.count(F.lit(1)).alias("fills"), F.sum(costs.round_trip_pips(terms, **kw)).alias("cost_pips"),
        F.sum(costs.round_trip_currency(terms, **kw)).alias("cost_currency"))


# --- risk -----------------------------------------------------------------------------------

@query("daily_risk_ledger", """
WITH f AS (SELECT l_returnflag AS run, CAST(l_shipdate AS DATE) AS trading_day, l_extendedprice * (l_discount - l_tax) / 1000 AS r,
    row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY """ + _ORD + """) AS n FROM lineitem),
g AS (SELECT *, sum(r) OVER (PARTITION BY run, trading_day ORDER BY n) AS s FROM f),
t AS (SELECT run, trading_day, min(n) FILTER (WHERE s <= -3 OR n >= 6) AS trip, count(*) AS total FROM g GROUP BY 1, 2)
SELECT t.run, t.trading_day, round(g.s, 4) AS realized_r, g.n AS trades, t.trip IS NOT NULL AS halted, t.total - g.n AS ignored,
  CASE WHEN t.trip IS NULL THEN NULL WHEN g.s <= -3 THEN 'daily loss limit' ELSE 'max daily trades' END AS halt_reason
FROM t JOIN g ON g.run = t.run AND g.trading_day = t.trading_day AND g.n = coalesce(t.trip, t.total)""", digits=4, dates=("trading_day",))
def daily_risk_ledger(spark, sf_dir):
    f = ledger(spark, sf_dir).withColumns({
        "trading_day": F.to_date("l_shipdate"), "pnl_r": F.col("pnl") / 1000})
    return risk.daily_ledger(f, ["run"], ORDER)


# --- splits ---------------------------------------------------------------------------------

def _spans(d: DataFrame) -> DataFrame:
    return d.groupBy("run").agg(F.min("day").cast("timestamp").alias("start"), F.max("day").cast("timestamp").alias("end"))


_WIN_SQL = DAILY_SQL + """,
span AS (SELECT run, CAST(min(day) AS TIMESTAMP) AS s, CAST(max(day) AS TIMESTAMP) AS e FROM daily GROUP BY 1),
win AS (SELECT run, w AS "window", s + to_days((w * 60)::INT) AS train_start, s + to_days((w * 60 + 365)::INT) AS train_end,
    s + to_days((w * 60 + 365)::INT) AS test_start, s + to_days((w * 60 + 455)::INT) AS test_end
  FROM (SELECT *, unnest(generate_series(0, 200)) AS w FROM span) WHERE s + to_days((w * 60 + 455)::INT) <= e)"""


@query("walk_forward_windows", "WITH " + _WIN_SQL + " SELECT * FROM win")
def walk_forward_windows(spark, sf_dir):
    return val.walk_forward_windows(_spans(daily(spark, sf_dir)), ["run"], train_days=365, test_days=90, step_days=60)


@query("walk_forward_expectancy", "WITH " + _WIN_SQL + """
SELECT win.run, "window", count(*) AS days, round(sum(pnl), 4) AS total, round(sum(pnl) / sum(trades), 2) AS expectancy FROM win JOIN daily d
  ON d.run = win.run AND CAST(d.day AS TIMESTAMP) >= test_start AND CAST(d.day AS TIMESTAMP) < test_end GROUP BY 1, 2""", digits=4)
def walk_forward_expectancy(spark, sf_dir):
    d = daily(spark, sf_dir)
    rows = d.withColumn("ts", F.col("day").cast("timestamp"))
    w = val.assign_test_windows(rows, _spans(d), ["run"], ts="ts", train_days=365, test_days=90, step_days=60)
    return w.groupBy("run", "window").agg(F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("total"),
        F.round(_per_trade(), 2).alias("expectancy"))


@query("purged_kfold", "WITH " + DAILY_SQL + """,
f AS (SELECT ds.*, sz.n, fold, fold * (n // 5) AS lo, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS hi
  FROM ds JOIN sz ON sz.run = ds.run, (VALUES (0), (1), (2), (3), (4)) v(fold))
SELECT run, fold, CASE WHEN k >= lo AND k < hi THEN 'test' WHEN k < greatest(0, lo - 10) OR k >= least(n, hi + 10) THEN 'train'
  ELSE 'purged' END AS role, count(*) AS days, round(sum(pnl), 4) AS pnl FROM f GROUP BY 1, 2, 3""", digits=4)
def purged_kfold(spark, sf_dir):
    s = index_series(daily(spark, sf_dir), ("run",), order="day")
    return val.purged_kfold(s, 5, 10).groupBy("run", "fold", "role").agg(
        F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("pnl"))


# --- bootstrap ------------------------------------------------------------------------------

def _plan_sql(seed: int, n: int) -> str:
    return DAILY_SQL + f""",
bl AS (SELECT run, n, greatest(1, least(n, round_even(sqrt(n), 0)::BIGINT)) AS b FROM sz),
pl AS (SELECT run, n, b, r.resample, g.block_no,
    ('0x' || substr(md5('{seed}|' || r.resample || '|' || g.block_no), 1, 8))::UBIGINT::BIGINT % greatest(1, n - b + 1) AS start,
    least(b, n - g.block_no * b) AS len
  FROM bl, (SELECT unnest(generate_series(0, {n - 1})) AS resample) r, (SELECT unnest(generate_series(0, 5000)) AS block_no) g
  WHERE g.block_no * b < n),
bs AS (SELECT pl.run, resample, block_no, ds.k, ds.pnl FROM pl JOIN ds ON ds.run = pl.run AND ds.k >= pl.start AND ds.k < pl.start + pl.len)"""


def _boot(spark, sf_dir, n: int, seed: int):
    s = index_series(daily(spark, sf_dir), ("run",), order="day")
    sizes = s.df.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return s, val.bootstrap_blocks(sizes, ["run"], n_resamples=n, seed=seed)


@query("block_bootstrap", "WITH " + _plan_sql(7, 40) + """
SELECT run, resample, count(*) AS n, round(sum(pnl * ((k % 7) + 1)), 4) AS weighted FROM bs GROUP BY 1, 2""", digits=4)
def block_bootstrap(spark, sf_dir):
    """Row-level resamples with an arbitrary statistic."""
    s, plan = _boot(spark, sf_dir, 40, 7)
    s = s.with_columns({"w": F.col("pnl") * (F.col("k") % 7 + 1)})
    rows = val.bootstrap_rows(s, plan, "w")
    return rows.groupBy("run", "resample").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weighted"))


def _trade_plan_sql(seed: int, n: int) -> str:
    """The plan over single trades: pl (run, resample, block_no, start, len) of ds (run, k, pnl)."""
    plan = _plan_sql(seed, n)
    plan = plan[plan.index("bl AS"):plan.index(",\nbs AS")]
    return f"""
ds AS (SELECT l_returnflag AS run, l_extendedprice * (l_discount - l_tax) AS pnl, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_ORD}) - 1 AS k FROM lineitem),
sz AS (SELECT run, count(*) AS n FROM ds GROUP BY 1),
{plan}"""


def _trade_boot(s, n: int, seed: int) -> DataFrame:
    sizes = s.df.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return val.bootstrap_blocks(sizes, ["run"], n_resamples=n, seed=seed)


@query("randomized_entry", "WITH " + _trade_plan_sql(0, 500) + """,
cs AS (SELECT run, k, sum(pnl) OVER (PARTITION BY run ORDER BY k) AS c FROM ds),
nul AS (SELECT pl.run, resample, sum(e.c - coalesce(b.c, 0)) / any_value(n) AS m FROM pl JOIN cs e ON e.run = pl.run AND e.k = pl.start + pl.len - 1
  LEFT JOIN cs b ON b.run = pl.run AND b.k = pl.start - 1 GROUP BY 1, 2),
ob AS (SELECT run, avg(pnl) AS observed FROM ds GROUP BY 1)
SELECT ob.run, round(observed, 4) AS observed, count(*) AS resamples, round(avg((m < observed)::INT), 3) AS rank, round(avg(m), 4) AS null_mean
FROM nul JOIN ob ON ob.run = nul.run GROUP BY ob.run, observed""", digits=4)
def randomized_entry(spark, sf_dir):
    """Mean pnl of block resamples of the trades, and the observed mean's rank among them."""
    s = trade_series(spark, sf_dir).settle()
    null = val.bootstrap_paths(s, _trade_boot(s, 500, 0), "pnl")
    obs = s.df.groupBy("run").agg(F.avg("pnl").alias("observed"))
    null = materialize(null)
    rank = val.percentile_rank(null, obs, ["run"], "mean_pnl")
    return null.groupBy("run").agg(F.count(F.lit(1)).alias("resamples"), F.avg("mean_pnl").alias("null_mean")).join(
        rank, "run").select("run", "observed", "resamples", F.round("rank", 3).alias("rank"), "null_mean")


@query("mc_drawdown_p95", "WITH " + _trade_plan_sql(10000, 500) + """,
bs AS (SELECT p.run, resample, block_no, i, ds.pnl FROM (SELECT *, unnest(range(len)) AS i FROM pl) p JOIN ds ON ds.run = p.run AND ds.k = p.start + p.i),
e AS (SELECT run, resample, block_no, i, sum(pnl) OVER w AS eqv FROM bs WINDOW w AS (PARTITION BY run, resample ORDER BY block_no, i)),
p AS (SELECT *, greatest(0, max(eqv) OVER (PARTITION BY run, resample ORDER BY block_no, i)) - eqv AS dd FROM e),
d AS (SELECT p.run, resample, max(dd) / (SELECT sum(abs(pnl)) FROM ds WHERE ds.run = p.run) AS dd FROM p GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY dd) - 1 AS i FROM d)
SELECT run, round(dd, 6) AS mc_p95_drawdown_pct FROM o WHERE i = least(499, floor(0.95 * 500))""")
def mc_drawdown_p95(spark, sf_dir):
    """The drawdown that one resample of the trades in twenty exceeds, over the sum of all moves."""
    s = trade_series(spark, sf_dir).settle()
    base = s.df.groupBy("run").agg(F.sum(F.abs("pnl")).alias("_base"))
    dd = val.bootstrap_paths(s, _trade_boot(s, 500, 10_000), "pnl").join(base, "run").withColumn(
        "dd", F.col("max_drawdown") / F.when(F.col("_base") > 0, F.col("_base")).otherwise(1.0))
    return val.index_quantile(dd, ["run"], "dd").withColumnRenamed("quantile", "mc_p95_drawdown_pct")


@query("label_shuffle", "WITH " + DAILY_SQL + """,
lb AS (SELECT run, k, pnl, CASE WHEN day(day) % 2 = 1 THEN 1 ELSE -1 END AS label FROM ds),
dl AS (SELECT lb.*, s, row_number() OVER (PARTITION BY run, s ORDER BY ('0x' || substr(md5('7|' || s || '|' || k), 1, 8))::UBIGINT, k) - 1 AS j
  FROM lb, (SELECT unnest(generate_series(0, 19)) AS s)),
nl AS (SELECT dl.run, s, avg(n.label * dl.pnl) AS m FROM dl JOIN lb n ON n.run = dl.run AND n.k = dl.j GROUP BY 1, 2),
ob AS (SELECT run, avg(label * pnl) AS o FROM lb GROUP BY 1)
SELECT nl.run, s::INTEGER AS shuffle, round(m, 4) AS null_mean, round(o, 4) AS observed, round(avg((m < o)::INT) OVER (PARTITION BY nl.run), 4) AS rank FROM nl JOIN ob USING (run)""", digits=4)
def label_shuffle(spark, sf_dir):
    """Daily pnl taken long or short by label, against twenty permutations of the labels."""
    s = index_series(daily(spark, sf_dir), ("run",), order="day")
    s = s.with_columns({"label": F.when(F.dayofmonth("day") % 2 == 1, 1).otherwise(-1)})
    return val.label_shuffles(s, "pnl", "label", n_shuffles=20, seed=7)


@query("lookahead_check", """
WITH n AS (SELECT event_type AS symbol, count(DISTINCT time_bucket(INTERVAL 1 HOUR, ts)) - 1 AS last FROM events GROUP BY 1),
c AS (SELECT DISTINCT symbol, floor(last * (i / 8.0::DOUBLE))::BIGINT AS cutoff FROM n, (SELECT unnest(generate_series(1, 8)) AS i))
SELECT f AS feature, symbol, cutoff, f = 'leaky' AND cutoff < (SELECT last FROM n WHERE n.symbol = c.symbol) AS leak
FROM c, (VALUES ('causal'), ('leaky')) v(f)""")
def lookahead_check(spark, sf_dir):
    """Causal indicators pass at every cutoff; a feature that reads the next bar is caught."""
    s = series(spark, sf_dir, 60)

    def causal(x):
        return ind.add(x, ind.ema(20, "e"), ind.tsi(), ind.atr(14))

    def leaky(x):
        return x.windowed(lambda w: {"nxt": F.lead("close").over(w)}, ahead=1)

    a = val.lookahead_leaks(s, causal, ["e", "tsi", "atr"]).withColumn("feature", F.lit("causal"))
    b = val.lookahead_leaks(s, leaky, ["nxt"]).withColumn("feature", F.lit("leaky"))
    return a.unionByName(b).select("feature", "symbol", "cutoff", "leak")


# --- trials and gate ------------------------------------------------------------------------

def supplier_stats(spark, sf_dir) -> DataFrame:
    """Per-supplier run statistics; a supplier is one trial of its nation's campaign."""
    li = table(spark, sf_dir, "lineitem").withColumn(
        "pnl", F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax") + 0.01))
    p = F.col("pnl")
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    g = li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("expectancy"), metrics.sharpe(p).alias("sharpe"),
        metrics.profit_factor(p).alias("pf"),
        F.coalesce(F.avg(F.when(late, p)), F.lit(0.0)).alias("lockbox"),
        F.avg(p - F.col("l_extendedprice") * 0.005).alias("stressed"))
    return g.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


STATS_SQL = """
st AS (SELECT s.*, g.* FROM (
    SELECT l_suppkey, count(*) AS n, avg(pnl) AS expectancy,
      CASE WHEN coalesce(stddev_samp(pnl), 0) > 0 THEN avg(pnl) / stddev_samp(pnl) ELSE 0 END AS sharpe,
      CASE WHEN sum(pnl) FILTER (WHERE pnl < 0) < 0 THEN coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / -sum(pnl) FILTER (WHERE pnl < 0)
           WHEN sum(pnl) FILTER (WHERE pnl > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS pf,
      coalesce(avg(pnl) FILTER (WHERE l_shipdate >= TIMESTAMP '2000-01-01'), 0) AS lockbox, avg(pnl - l_extendedprice * 0.005) AS stressed
    FROM (SELECT *, l_extendedprice * (l_discount - l_tax + 0.01) AS pnl FROM lineitem) GROUP BY 1) g
  JOIN supplier s ON s.s_suppkey = g.l_suppkey),
log AS (SELECT 'T' || l_suppkey AS result_id, 'N' || s_nationkey AS campaign_id, 'S' || (l_suppkey % 2) AS strategy, 'RUNNING' AS status,
    0.0::DOUBLE AS observed_sharpe, 2 * l_suppkey AS seq FROM st
  UNION ALL SELECT 'T' || l_suppkey, 'N' || s_nationkey, 'S' || (l_suppkey % 2), CASE WHEN s_acctbal < 0 THEN 'FAILED' ELSE 'COMPLETE' END,
    CASE WHEN s_acctbal < 0 THEN 0.0 ELSE sharpe END, 2 * l_suppkey + 1 FROM st),
lt AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY seq DESC) = 1)"""


def trial_log(stats: DataFrame) -> DataFrame:
    """Two records per trial: RUNNING with Sharpe 0, then COMPLETE or FAILED."""
    sid = F.col("l_suppkey")
    base = stats.select(
        F.concat(F.lit("T"), sid).alias("result_id"), F.concat(F.lit("N"), "s_nationkey").alias("campaign_id"),
        F.concat(F.lit("S"), sid % 2).alias("strategy"), sid.alias("_i"), "sharpe", (F.col("s_acctbal") < 0).alias("_bad"))
    phase = F.explode(F.array(
        F.struct(F.lit("RUNNING").alias("status"), F.lit(0.0).alias("observed_sharpe"), (F.col("_i") * 2).alias("seq")),
        F.struct(F.when(F.col("_bad"), "FAILED").otherwise("COMPLETE").alias("status"),
                 F.when(F.col("_bad"), 0.0).otherwise(F.col("sharpe")).alias("observed_sharpe"), (F.col("_i") * 2 + 1).alias("seq"))))
    return base.withColumn("p", phase).select("result_id", "campaign_id", "strategy", "p.*")


@query("trial_latest", "WITH " + STATS_SQL + """
SELECT result_id, campaign_id, strategy, status, round(observed_sharpe, 6) AS observed_sharpe, seq FROM lt""")
def trial_latest(spark, sf_dir):
    return trials.latest(trial_log(supplier_stats(spark, sf_dir)))


_FAM = "campaign_id, strategy"


def _h(coeffs, x: str) -> str:
    out = f"{coeffs[0]!r}::DOUBLE"
    for c in coeffs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    frac = f"({a} + 0.65::DOUBLE)"
    for n in (4, 3, 2, 1):
        frac = f"({a} + {n}.0::DOUBLE / {frac})"
    t = f"""(CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_h(CDF_NUM, a)} / {_h(CDF_DEN, a)}
      ELSE exp(-{a} * {a} / 2) / {frac} / 2.506628274631::DOUBLE END)"""
    return f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE - {t} ELSE {t} END)"


def quantile_sql(p: str) -> str:
    q, lo, hi = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1.0::DOUBLE - {p}))"
    r = f"({q} * {q})"
    return f"""(CASE WHEN {p} < 0.02425 THEN {_h(INV_C, lo)} / {_h(INV_D, lo)} WHEN {p} > 0.97575 THEN -{_h(INV_C, hi)} / {_h(INV_D, hi)}
      ELSE {q} * {_h(INV_A, r)} / {_h(INV_B, r)} END)"""


DSR_SQL = f"""
fam AS (SELECT {_FAM}, count(*) AS n_trials, var_samp(observed_sharpe) AS v,
    CASE WHEN count(*) >= 3 AND avg(abs(observed_sharpe)) <> 0 THEN max(observed_sharpe) - min(observed_sharpe) < 0.01 * avg(abs(observed_sharpe)) ELSE false END AS low_variance
  FROM lt GROUP BY ALL),
ev AS (SELECT *, CASE WHEN n_trials >= 2 AND v > 0 THEN sqrt(v) * ((1 - {EULER_MASCHERONI}::DOUBLE) * {quantile_sql('(1 - 1.0::DOUBLE / n_trials)')}
    + {EULER_MASCHERONI}::DOUBLE * {quantile_sql('(1 - 1.0::DOUBLE / (n_trials * exp(1.0::DOUBLE)))')}) ELSE 0 END AS sr0 FROM fam)"""


@query("campaign_families", "WITH " + STATS_SQL + f"""
SELECT {_FAM}, count(*) AS n_trials, round(var_samp(observed_sharpe), 9) AS sr_variance, round(max(observed_sharpe), 6) AS best_sharpe,
  arg_max(result_id, (observed_sharpe, result_id)) AS best_id,
  count(*) >= 3 AND avg(abs(observed_sharpe)) <> 0 AND max(observed_sharpe) - min(observed_sharpe) < 0.01 * avg(abs(observed_sharpe)) AS low_variance FROM lt GROUP BY ALL""", digits=9)
def campaign_families(spark, sf_dir):
    t = trials.latest(trial_log(supplier_stats(spark, sf_dir)))
    return trials.family_stats(t, ["campaign_id", "strategy"]).withColumn(
        "best_sharpe", F.round("best_sharpe", 6))


_BEST_SQL = """
best AS (SELECT campaign_id, strategy, max(observed_sharpe) AS sr, arg_max(result_id, (observed_sharpe, result_id)) AS id FROM lt GROUP BY ALL),
bo AS (SELECT best.*, st.n AS n_obs FROM best JOIN st ON 'T' || st.l_suppkey = best.id)"""


@query("campaign_dsr", "WITH " + STATS_SQL + "," + DSR_SQL + "," + _BEST_SQL + f""",
z AS (SELECT bo.*, ev.n_trials, ev.v, ev.sr0, low_variance, (sr - sr0) * sqrt(n_obs - 1) / sqrt(greatest(1e-12, 1 + 1.25 * sr * sr)) AS z
  FROM bo JOIN ev ON ev.campaign_id = bo.campaign_id AND ev.strategy = bo.strategy)
SELECT {_FAM}, n_trials, n_obs, round(sr, 6) AS observed_sharpe, round(sr0, 6) AS benchmark_sharpe, CASE WHEN n_trials > 1 AND NOT v > 0 THEN NULL ELSE round({cdf_sql('z')}, 6) END AS probability,
  concat_ws(',', CASE WHEN n_obs < 200 THEN 'small sample' END, CASE WHEN n_trials = 1 THEN 'no multiple-testing penalty' END,
    CASE WHEN low_variance THEN 'suspiciously low trial variance' END) AS warnings FROM z""")
def campaign_dsr(spark, sf_dir):
    """Deflated Sharpe of the best trial of every (campaign, strategy)."""
    stats = supplier_stats(spark, sf_dir)
    fam = ["campaign_id", "strategy"]
    t = trials.latest(trial_log(stats))
    best = trials.family_stats(t, fam).select(*fam, F.col("best_sharpe").alias("observed_sharpe"), "best_id")
    n = stats.select(F.concat(F.lit("T"), "l_suppkey").alias("best_id"), F.col("n").alias("n_obs"))
    out = trials.family_dsr(t, fam, best.join(n, "best_id"))
    return out.select(*fam, "n_trials", "n_obs", "observed_sharpe", "benchmark_sharpe", "probability",
                      F.concat_ws(",", "warnings").alias("warnings"))


def run_artifacts(stats: DataFrame) -> DataFrame:
    """Ten artifacts per run; some runs lack the lockbox, some mix provenance."""
    c, sid = F.col, F.col("l_suppkey")
    one = F.lit(1.0)
    rows = trials.emit(stats.withColumn("run_id", F.concat(F.lit("T"), sid)), ["run_id", "l_suppkey", "s_acctbal", "s_nationkey"], {
        "EQUITY_CURVE": {"drawdown_pct": (sid % 40) / 100},
        "TRADE_LEDGER": {"n_trades": c("n"), "profit_factor": c("pf"), "expectancy": c("expectancy"), "sharpe": c("sharpe")},
        "DATA_QUALITY": {"passed": F.when(sid % 11 == 0, 0).otherwise(1)}, "NO_LOOKAHEAD": {"passed": one},
        "WALK_FORWARD": {"pass_rate": (sid % 10) / 10}, "RANDOMIZED_ENTRY": {"rank": F.lit(1.0) - (sid % 9) / 100},
        "ONE_BAR_DELAY": {"base_expectancy": c("expectancy"), "delayed_expectancy": c("stressed")},
        "COST_STRESS": {"expectancy_at_1_5x": c("stressed")}, "MONTE_CARLO_DD": {"p95_drawdown_pct": (sid % 50) / 100},
        "LOCKBOX": {"expectancy": c("lockbox")},
    })
    rows = rows.where(~((c("s_acctbal") < 500) & (c("artifact_type") == "LOCKBOX")))
    mixed = (c("s_nationkey") == 3) & (c("artifact_type") == "COST_STRESS")
    return rows.select(
        "run_id", c("run_id").alias("trial_id"), F.concat(F.lit("N"), "s_nationkey").alias("campaign_id"), "artifact_type", "payload",
        F.when(mixed, "other").otherwise("d1").alias("data_hash"), F.lit("f1").alias("feature_version"),
        F.lit("c1").alias("cost_model_version"), F.lit(1).alias("created_seq"))


_T = {"min_profit_factor": 1.0, "min_deflated_sharpe": 0.05, "min_walk_forward_rate": 0.3, "min_entry_rank": 0.95, "max_mc_p95_drawdown_pct": 0.3}


@query("gate_decisions", "WITH " + STATS_SQL + "," + DSR_SQL + f""",
z AS (SELECT st.*, ev.n_trials, ev.v, (st.sharpe - sr0) * sqrt(greatest(n, 2) - 1) / sqrt(greatest(1e-12, 1 + 1.25 * st.sharpe * st.sharpe)) AS z
  FROM st JOIN ev ON ev.campaign_id = 'N' || st.s_nationkey AND ev.strategy = 'S' || (st.l_suppkey % 2)),
p AS (SELECT *, CASE WHEN n_trials > 1 AND NOT v > 0 THEN 0 ELSE {cdf_sql('z')} END AS prob, l_suppkey % 40 / 100 AS dd, l_suppkey % 10 / 10 AS wf, 1 - l_suppkey % 9 / 100 AS rk, l_suppkey % 50 / 100 AS mc FROM z),
f AS (SELECT *, CASE WHEN s_acctbal < 500 THEN 'missing artifact: LOCKBOX' WHEN s_nationkey = 3 THEN 'provenance mismatch' ELSE
  concat_ws(',', CASE WHEN n < 200 THEN 'sample' END, CASE WHEN pf < 1.0 THEN 'profit_factor' END, CASE WHEN expectancy <= 0 THEN 'expectancy' END,
    CASE WHEN dd > 0.2 THEN 'max_drawdown' END, CASE WHEN prob <= 0.05 THEN 'deflated_sharpe' END, CASE WHEN wf < 0.3 THEN 'walk_forward' END,
    CASE WHEN rk < 0.95 THEN 'randomized_entry' END, CASE WHEN NOT (stressed > 0 AND (expectancy <= 0 OR stressed >= 0.5 * expectancy)) THEN 'one_bar_delay' END,
    CASE WHEN stressed <= 0 THEN 'cost_stress' END, CASE WHEN mc > 0.3 THEN 'mc_p95_drawdown' END, CASE WHEN lockbox <= 0 THEN 'lockbox' END,
    CASE WHEN l_suppkey % 11 = 0 THEN 'data_quality' END) END AS failed FROM p)
SELECT 'T' || l_suppkey AS run_id, failed, CASE WHEN failed = '' THEN 'GO' ELSE 'NO_GO' END AS verdict,
  CASE WHEN s_acctbal >= 500 AND s_nationkey <> 3 THEN round(prob, 6) END AS deflated_sharpe FROM f""")
def gate_decisions(spark, sf_dir):
    """Every run's decision at once from artifacts and the trial log."""
    stats = supplier_stats(spark, sf_dir)
    fam = ["campaign_id", "strategy"]
    obs = stats.select(
        F.concat(F.lit("T"), "l_suppkey").alias("run_id"), F.concat(F.lit("N"), "s_nationkey").alias("campaign_id"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 2).alias("strategy"), F.col("sharpe").alias("observed_sharpe"),
        F.greatest(F.col("n"), F.lit(2)).alias("n_obs"))
    prob = trials.family_dsr(trials.latest(trial_log(stats)), fam, obs).select("run_id", "probability")
    g = trials.evaluate_gate(run_artifacts(stats), prob, _T)
    return g.select("run_id", F.concat_ws(",", "failed_criteria").alias("failed"), "verdict", "deflated_sharpe")


@query("artifact_audit", "WITH " + STATS_SQL + """,
art AS (SELECT DISTINCT CASE WHEN l_suppkey % 7 = 0 THEN 'X' || l_suppkey ELSE 'T' || l_suppkey END AS trial_id FROM st)
SELECT 'orphan artifact' AS violation, trial_id AS subject FROM art WHERE trial_id NOT IN (SELECT result_id FROM lt)
UNION ALL SELECT 'complete trial without artifacts', result_id FROM lt WHERE status = 'COMPLETE' AND result_id NOT IN (SELECT trial_id FROM art)""")
def artifact_audit(spark, sf_dir):
    """Every seventh run's artifacts carry an unknown trial id."""
    stats = supplier_stats(spark, sf_dir)
    sid = F.regexp_extract("run_id", r"(\d+)", 1).cast("bigint")
    art = run_artifacts(stats).withColumn(
        "trial_id", F.when(sid % 7 == 0, F.concat(F.lit("X"), sid)).otherwise(F.col("run_id")))
    return trials.audit(art, trial_log(stats))


@query("campaign_audit", "WITH " + STATS_SQL + """,
mine AS (SELECT * FROM lt WHERE campaign_id = 'N3' AND strategy = 'S1'),
art AS (SELECT DISTINCT CASE WHEN l_suppkey % 7 = 0 THEN 'X' || l_suppkey ELSE 'T' || l_suppkey END AS trial_id FROM st WHERE s_nationkey = 3)
SELECT 'orphan artifact' AS violation, trial_id AS subject FROM art WHERE trial_id NOT IN (SELECT result_id FROM mine)
UNION ALL SELECT 'complete trial without artifacts', result_id FROM mine WHERE status = 'COMPLETE' AND result_id NOT IN (SELECT trial_id FROM art)""")
def campaign_audit(spark, sf_dir):
    """The audit of one campaign's strategy: artifacts of others count as orphans there."""
    stats = supplier_stats(spark, sf_dir)
    sid = F.regexp_extract("run_id", r"(\d+)", 1).cast("bigint")
    art = run_artifacts(stats).withColumn(
        "trial_id", F.when(sid % 7 == 0, F.concat(F.lit("X"), sid)).otherwise(F.col("run_id")))
    return trials.audit(art, trial_log(stats), campaign=("N3", "S1"))


_NARROW = "strategy, instrument, timeframe"


@query("narrow_family_dsr", "WITH " + STATS_SQL[:STATS_SQL.index("log AS")] + f"""
lt AS (SELECT 'S' || (l_suppkey % 2) AS strategy, 'I' || (s_nationkey % 3) AS instrument, CASE l_suppkey % 3 WHEN 0 THEN '1h' ELSE '4h' END AS timeframe,
    'T' || l_suppkey AS run_id, sharpe AS observed_sharpe, n AS n_obs FROM st),
{DSR_SQL.strip().replace(_FAM, _NARROW)},
z AS (SELECT lt.*, n_trials, v, sr0, (observed_sharpe - sr0) * sqrt(n_obs - 1) / sqrt(greatest(1e-12, 1 + 1.25 * observed_sharpe * observed_sharpe)) AS z FROM lt JOIN ev USING ({_NARROW}))
SELECT run_id, {_NARROW}, n_trials, round(sr0, 6) AS benchmark_sharpe, CASE WHEN n_trials > 1 AND NOT v > 0 THEN NULL ELSE round({cdf_sql('z')}, 6) END AS probability FROM z""")
def narrow_family_dsr(spark, sf_dir):
    """Deflated Sharpe of every trial against the trials of its strategy, instrument and timeframe."""
    stats, sid, fam = supplier_stats(spark, sf_dir), F.col("l_suppkey"), _NARROW.split(", ")
    t = materialize(stats.select(
        F.concat(F.lit("S"), sid % 2).alias("strategy"), F.concat(F.lit("I"), F.col("s_nationkey") % 3).alias("instrument"), F.when(sid % 3 == 0, "1h").otherwise("4h").alias("timeframe"),
        F.concat(F.lit("T"), sid).alias("result_id"), F.col("sharpe").alias("observed_sharpe"), F.col("n").alias("n_obs")))
    out = trials.family_dsr(t.drop("n_obs"), fam, t.withColumnRenamed("result_id", "run_id"))
    return out.select("run_id", *fam, "n_trials", "benchmark_sharpe", "probability")


@query("bootstrap_statistic", "WITH " + _plan_sql(7, 40) + """
SELECT run, resample, round(max(pnl) - min(pnl), 4) AS stat FROM bs GROUP BY 1, 2""", digits=4)
def bootstrap_statistic(spark, sf_dir):
    """A statistic that needs all rows of a resample: the span of daily pnl."""
    s, plan = _boot(spark, sf_dir, 40, 7)
    return val.bootstrap_statistic(s, plan, "pnl", F.max("pnl") - F.min("pnl"))


@query("validation_battery", "WITH " + LEDGER_SQL + "," + DAILY_SQL + f""",
m AS (SELECT run, count(*) AS n, sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0) AS pf, avg(pnl) AS ex,
    avg(pnl) / stddev_samp(pnl) AS sr, max(peak - eqv) / abs(max(peak)) AS dd, avg(pnl - l_extendedprice * 0.001) AS stressed FROM pk GROUP BY run),
lb AS (SELECT ds.run, sum(pnl) / sum(trades) AS lockbox FROM ds JOIN sz ON sz.run = ds.run WHERE k >= floor(n * 0.8::DOUBLE) GROUP BY 1),
wf AS (SELECT run, avg((expectancy > 0)::INT) AS rate FROM ({ORACLES['walk_forward_expectancy']}) GROUP BY 1),
re AS ({ORACLES['randomized_entry']}), mc AS ({ORACLES['mc_drawdown_p95']}),
fam AS (SELECT count(*) AS n_trials, var_samp(sr) AS v FROM m),
ev AS (SELECT *, sqrt(v) * ((1 - {EULER_MASCHERONI}::DOUBLE) * {quantile_sql('(1 - 1.0::DOUBLE / n_trials)')}
    + {EULER_MASCHERONI}::DOUBLE * {quantile_sql('(1 - 1.0::DOUBLE / (n_trials * exp(1.0::DOUBLE)))')}) AS sr0 FROM fam),
z AS (SELECT m.*, lockbox, rate, rank, mc_p95_drawdown_pct AS p95, (sr - sr0) * sqrt(n - 1) / sqrt(1 + 1.25 * sr * sr) AS z
  FROM m JOIN lb ON lb.run = m.run JOIN wf ON wf.run = m.run JOIN re ON re.run = m.run JOIN mc ON mc.run = m.run, ev),
p AS (SELECT *, {cdf_sql('z')} AS prob FROM z)
SELECT run AS run_id, concat_ws(',', CASE WHEN n < 200 THEN 'sample' END, CASE WHEN pf < 1.25 THEN 'profit_factor' END, CASE WHEN ex <= 0 THEN 'expectancy' END,
    CASE WHEN dd > 0.2 THEN 'max_drawdown' END, CASE WHEN prob <= 0.95 THEN 'deflated_sharpe' END, CASE WHEN rate < 0.6 THEN 'walk_forward' END,
    CASE WHEN rank < 0.95 THEN 'randomized_entry' END, CASE WHEN NOT (stressed > 0 AND (ex <= 0 OR stressed >= 0.5 * ex)) THEN 'one_bar_delay' END,
    CASE WHEN stressed <= 0 THEN 'cost_stress' END, CASE WHEN p95 > 0.3 THEN 'mc_p95_drawdown' END, CASE WHEN lockbox <= 0 THEN 'lockbox' END) AS failed,
  n::DOUBLE AS n_trades, round(pf, 6) AS profit_factor, round(dd, 6) AS drawdown_pct, round(prob, 6) AS deflated_sharpe, round(rate, 6) AS wf_pass_rate,
  round(rank, 3) AS randomized_entry_rank, round(p95, 6) AS mc_p95_drawdown_pct FROM p""")
def validation_battery(spark, sf_dir):
    """Every artifact of every ledger run computed from its trades, then the gate over them."""
    led = ledger(spark, sf_dir)
    parts = materialize(metrics.drawdown_parts(led, ["run"], ORDER, chunk()))
    m = metrics.strategy_metrics(parts, ["run"]).select(
        "run", F.col("trade_count").alias("n"), "profit_factor", "expectancy", "sharpe")
    dd = metrics.summarize(parts, ["run"]).select("run", (F.col("max_dd") / F.abs("top")).alias("dd"))
    stressed = led.groupBy("run").agg(F.avg(F.col("pnl") - F.col("l_extendedprice") * 0.001).alias("stressed"))
    s = index_series(daily(spark, sf_dir), ("run",), order="day").settle()
    t = trade_series(spark, sf_dir).settle()
    lockbox = val.ratio_split(s, 0.8).df.where("part = 'oos'").groupBy("run").agg(_per_trade().alias("lockbox"))
    rows = s.df.withColumn("ts", F.col("day").cast("timestamp"))
    win = val.assign_test_windows(rows, _spans(s.df), ["run"], ts="ts", train_days=365, test_days=90, step_days=60)
    rate = win.groupBy("run", "window").agg(F.round(_per_trade(), 2).alias("e")).groupBy("run").agg(
        F.avg(F.when(F.col("e") > 0, 1.0).otherwise(0.0)).alias("rate"))
    obs = t.df.groupBy("run").agg(F.avg("pnl").alias("observed"), F.sum(F.abs("pnl")).alias("_base"))
    rank = val.percentile_rank(val.bootstrap_paths(t, _trade_boot(t, 500, 0), "pnl"), obs, ["run"], "mean_pnl").select("run", "rank")
    paths = val.bootstrap_paths(t, _trade_boot(t, 500, 10_000), "pnl").join(obs, "run").withColumn("dd", F.col("max_drawdown") / F.col("_base"))
    p95 = val.index_quantile(paths, ["run"], "dd").withColumnRenamed("quantile", "p95")
    stats = m
    for part in (dd, stressed, lockbox, rate, materialize(rank), materialize(p95)):
        stats = stats.join(part, "run")
    stats = materialize(stats)
    c, one = F.col, F.lit(1.0)
    art = trials.emit(stats, ["run"], {
        "EQUITY_CURVE": {"drawdown_pct": c("dd")},
        "TRADE_LEDGER": {"n_trades": c("n"), "profit_factor": c("profit_factor"), "expectancy": c("expectancy"), "sharpe": c("sharpe")},
        "DATA_QUALITY": {"passed": one}, "NO_LOOKAHEAD": {"passed": one}, "WALK_FORWARD": {"pass_rate": c("rate")},
        "RANDOMIZED_ENTRY": {"rank": c("rank")}, "COST_STRESS": {"expectancy_at_1_5x": c("stressed")},
        "ONE_BAR_DELAY": {"base_expectancy": c("expectancy"), "delayed_expectancy": c("stressed")},
        "MONTE_CARLO_DD": {"p95_drawdown_pct": c("p95")}, "LOCKBOX": {"expectancy": c("lockbox")},
    }).select(c("run").alias("run_id"), "artifact_type", "payload", F.lit("d1").alias("data_hash"), F.lit("f1").alias("feature_version"),
              F.lit("c1").alias("cost_model_version"), F.lit(1).alias("created_seq"))
    log = stats.select(c("run").alias("result_id"), F.lit("ledger").alias("campaign_id"), c("sharpe").alias("observed_sharpe"))
    seen = stats.select(c("run").alias("run_id"), F.lit("ledger").alias("campaign_id"), c("sharpe").alias("observed_sharpe"), c("n").alias("n_obs"))
    prob = trials.family_dsr(log, ["campaign_id"], seen).select("run_id", "probability")
    g = trials.evaluate_gate(art, prob)
    return g.select(
        "run_id", F.concat_ws(",", "failed_criteria").alias("failed"), "n_trades", "profit_factor", "drawdown_pct", "deflated_sharpe",
        "wf_pass_rate", F.round("randomized_entry_rank", 3).alias("randomized_entry_rank"), "mc_p95_drawdown_pct")
