"""Queries over the signal table, subscribers and external signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.dims import INSTRUMENTS
from tapeworks.functions import scalars as sc
from tapeworks.functions import timeexpr as tx
from tapeworks.operators import fanout, risk, rules
from tapeworks.operators import signal_store as store
from tapeworks.plans.market import _FLAGS_SQL, _PRIMARY_SQL
from tapeworks.plans.registry import query
from tapeworks.plans.tables import table
from tapeworks.sources import feeds
from tapeworks.storage import materialize

_SYMBOLS = [s for s, *_ in INSTRUMENTS]
_SESSIONS = ["ASIA", "LONDON", "NEWYORK", "OVERLAP"]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored signals."""
    o, c = table(spark, sf_dir, "orders"), F.col
    ts = c("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(c("o_orderkey") % 24).cast("int"))
    symbol = F.element_at(F.array(*[F.lit(s) for s in _SYMBOLS]), (c("o_orderkey") % 4).cast("int") + 1)
    df = o.select(
        "o_orderkey", "o_custkey", symbol.alias("symbol"), ts.alias("ts"),
        F.concat(F.lit("scan"), "o_orderkey").alias("source"),
        F.when(c("o_custkey") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        (c("o_orderkey") % 101).cast("int").alias("score_total"),
        (c("o_orderkey") % 31).cast("int").alias("score_structure"),
        (c("o_custkey") * 7 % 31).cast("int").alias("score_momentum"),
        (c("o_custkey") % 21).cast("int").alias("score_session"),
        ((c("o_orderkey") + c("o_custkey")) % 21).cast("int").alias("score_cost"),
        F.when(c("o_orderstatus") == "F", "win").when(c("o_orderstatus") == "O", "loss").otherwise("expired").alias("status"),
        c("o_orderpriority").alias("regime"),
        F.round((c("o_totalprice") - 250000) / 1000, 3).alias("outcome_pnl_pips"))
    return df.withColumn("id", sc.signal_id(c("symbol"), c("ts"), c("source")))


SIG_SQL = """
sg AS (SELECT *, substr(sha256(symbol || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || source), 1, 16) AS id FROM (
  SELECT o_orderkey, o_custkey, ['EUR/USD', 'GBP/USD', 'USD/JPY', 'XAU/USD'][o_orderkey % 4 + 1] AS symbol,
    o_orderdate + to_hours((o_orderkey % 24)::INT) AS ts, 'scan' || o_orderkey AS source,
    CASE WHEN o_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, o_orderkey % 101 AS score_total, o_orderkey % 31 AS score_structure,
    o_custkey * 7 % 31 AS score_momentum, o_custkey % 21 AS score_session, (o_orderkey + o_custkey) % 21 AS score_cost,
    CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'expired' END AS status, o_orderpriority AS regime,
    round((o_totalprice - 250000) / 1000, 3) AS outcome_pnl_pips FROM orders))"""


def _w(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([SIG_SQL, *ctes]) + "\n" + select


@query("signal_ids", _w("SELECT o_orderkey, id, symbol, ts FROM sg"))
def signal_ids(spark, sf_dir):
    return signals(spark, sf_dir).select("o_orderkey", "id", "symbol", "ts")


@query("event_signal_ids", """
SELECT event_id, left(sha256(concat_ws('|', event_type, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00', 'live')), 16) AS id FROM events""")
def event_signal_ids(spark, sf_dir):
    """Ids of instants with fractions of a second."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.select("event_id", sc.signal_id(F.col("event_type"), F.col("ts"), F.lit("live")).alias("id"))


@query("win_rate_bands", _w("""
SELECT b.lo, CASE WHEN count(*) FILTER (WHERE status IN ('win', 'loss')) >= 1 THEN round(count(*) FILTER (WHERE status = 'win')
  / count(*) FILTER (WHERE status IN ('win', 'loss')), 6) ELSE 0.5 END AS win_rate, count(*) FILTER (WHERE status IN ('win', 'loss')) AS sample_size
FROM sg JOIN (VALUES (0, 49), (50, 69), (70, 100)) b(lo, hi) ON score_total BETWEEN b.lo AND b.hi GROUP BY 1"""))
def win_rate_bands(spark, sf_dir):
    return store.win_rates(signals(spark, sf_dir), [(0, 49), (50, 69), (70, 100)])


_CONF_SQL = """
band AS (SELECT {keys} g.score, count(*) FILTER (WHERE status = 'win')::DOUBLE AS w, count(*)::DOUBLE AS n
  FROM sg JOIN (SELECT unnest(generate_series(0, 100)) AS score) g ON score_total BETWEEN greatest(0, g.score - 10) AND least(100, g.score + 10)
  WHERE status IN ('win', 'loss') GROUP BY ALL),
wl AS (SELECT *, greatest(0, least(1, (w / n + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(w / n * (1 - w / n) / n + 1.645 * 1.645 / (4 * n * n)))
    / (1 + 1.645 * 1.645 / n))) AS lb FROM band)"""
_CONF_OUT = """score, CASE WHEN n >= 20 THEN round(lb, 6) ELSE 0.5 END AS confidence_pct, CASE WHEN n >= 20 THEN n::BIGINT ELSE 0 END AS confidence_n,
  CASE WHEN n >= 50 THEN 'ESTABLISHED' WHEN n >= 20 THEN 'DEVELOPING' ELSE 'INSUFFICIENT' END AS confidence_label FROM wl"""


@query("wilson_confidence", _w("SELECT " + _CONF_OUT, _CONF_SQL.format(keys="")))
def wilson_confidence(spark, sf_dir):
    return store.confidence_table(signals(spark, sf_dir))


@query("wilson_confidence_by_regime", _w("SELECT regime, " + _CONF_OUT, _CONF_SQL.format(keys="regime,")))
def wilson_confidence_by_regime(spark, sf_dir):
    return store.confidence_table(signals(spark, sf_dir), by_regime=True)


@query("signal_confidence", _w("""
SELECT sg.id, CASE WHEN n >= 20 THEN round(lb, 6) ELSE 0.5 END AS confidence_pct,
  CASE WHEN coalesce(n, 0) < 20 THEN 'Unproven' WHEN lb >= 0.65 THEN 'High' WHEN lb >= 0.52 THEN 'Moderate' ELSE 'Low' END AS bucket
FROM sg LEFT JOIN wl ON wl.score = sg.score_total""", _CONF_SQL.format(keys="")))
def signal_confidence(spark, sf_dir):
    s = signals(spark, sf_dir)
    out = store.with_confidence(s.select("id", "score_total"), store.confidence_table(s))
    return out.select("id", "confidence_pct", sc.confidence_bucket(F.col("confidence_pct"), F.col("confidence_n")).alias("bucket"))


@query("score_breakdown", _w("""
SELECT CASE WHEN score_total < 50 THEN 'LOW (0-49)' WHEN score_total < 70 THEN 'MEDIUM (50-69)' ELSE 'HIGH (70-100)' END AS bucket,
  count(*) AS total, count(*) FILTER (WHERE status = 'win') AS wins, count(*) FILTER (WHERE status = 'loss') AS losses,
  count(*) FILTER (WHERE status = 'expired') AS expired, round(avg(outcome_pnl_pips) FILTER (WHERE status IN ('win', 'loss')), 1) AS avg_pnl_pips
FROM sg GROUP BY 1"""))
def score_breakdown(spark, sf_dir):
    return store.score_breakdown(signals(spark, sf_dir))


_CORR_SQL = """
cl AS (SELECT *, (status = 'win')::INT::DOUBLE AS won FROM sg WHERE status IN ('win', 'loss')),
cc AS (SELECT round(coalesce(corr(won, score_structure), 0), 3) AS structure, round(coalesce(corr(won, score_momentum), 0), 3) AS momentum,
  round(coalesce(corr(won, score_session), 0), 3) AS session, round(coalesce(corr(won, score_cost), 0), 3) AS cost FROM cl HAVING count(*) >= 30)"""


@query("component_corr", _w("SELECT * FROM cc", _CORR_SQL))
def component_corr(spark, sf_dir):
    return store.component_correlations(signals(spark, sf_dir))


@query("suggest_weights", _w("""
SELECT structure + CASE WHEN pos = 1 THEN d ELSE 0 END AS structure, momentum + CASE WHEN pos = 2 THEN d ELSE 0 END AS momentum,
  session + CASE WHEN pos = 3 THEN d ELSE 0 END AS session, cost + CASE WHEN pos = 4 THEN d ELSE 0 END AS cost FROM w3""", _CORR_SQL, """
w1 AS (SELECT greatest(structure, 0) AS s, greatest(momentum, 0) AS m, greatest(session, 0) AS n, greatest(cost, 0) AS c FROM cc),
w2 AS (SELECT greatest(5, round_even(s / (s + m + n + c) * 100, 0))::INT AS structure, greatest(5, round_even(m / (s + m + n + c) * 100, 0))::INT AS momentum,
  greatest(5, round_even(n / (s + m + n + c) * 100, 0))::INT AS session, greatest(5, round_even(c / (s + m + n + c) * 100, 0))::INT AS cost FROM w1 WHERE s + m + n + c > 0),
w3 AS (SELECT *, 100 - structure - momentum - session - cost AS d,
  list_position([structure, momentum, session, cost], greatest(structure, momentum, session, cost)) AS pos FROM w2)"""))
def suggest_weights(spark, sf_dir):
    return store.suggest_weights(store.component_correlations(signals(spark, sf_dir)))


@query("recent_signals", _w("SELECT id, ts, status FROM sg ORDER BY ts DESC, id LIMIT 20"))
def recent_signals(spark, sf_dir):
    return store.recent(signals(spark, sf_dir)).select("id", "ts", "status")


@query("signal_counts", _w("""
SELECT status, count(*) AS signals, round(sum(outcome_pnl_pips) FILTER (WHERE status IN ('win', 'loss')), 3) AS pnl_pips,
  count(*) FILTER (WHERE NOT status IN ('win', 'loss', 'expired')) AS live FROM sg GROUP BY 1"""), digits=3)
def signal_counts(spark, sf_dir):
    st = F.col("status")
    return signals(spark, sf_dir).groupBy("status").agg(
        F.count(F.lit(1)).alias("signals"), F.sum(F.when(st.isin("win", "loss"), F.col("outcome_pnl_pips"))).alias("pnl_pips"),
        F.count_if(~st.isin("win", "loss", "expired")).alias("live"))


@query("insert_ignore", _w("""
SELECT id, o_orderkey FROM sg WHERE o_orderkey % 3 <> 0"""))
def insert_ignore(spark, sf_dir):
    """A third of the rows is stored already; every incoming row comes twice."""
    s = signals(spark, sf_dir).select("id", "o_orderkey")
    have = s.where(F.col("o_orderkey") % 3 == 0)
    twice = s.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return store.insert_ignore(have, twice, order="seq").select("id", "o_orderkey")


@query("status_merge", _w("""
SELECT id, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' ELSE status END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ts + INTERVAL 2 HOUR END AS status_ts,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 2 = 0 THEN -1.0 ELSE outcome_pnl_pips END AS outcome_pnl_pips,
  CASE WHEN o_orderkey % 5 <> 0 THEN 7 END AS outcome_bars_held FROM sg"""))
def status_merge(spark, sf_dir):
    """Two status events per signal: the first sets bars held, the second the final status."""
    s, k = signals(spark, sf_dir), F.col("o_orderkey")
    none_i, none_d = F.lit(None).cast("int"), F.lit(None).cast("double")
    base = s.select("id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("status_ts"),
                    F.lit(-1.0).alias("outcome_pnl_pips"), none_i.alias("outcome_bars_held"),
                    none_d.alias("max_adverse_pips"), none_d.alias("max_favor_pips"))
    hour = F.expr("INTERVAL 1 HOUR")
    two = F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("active").alias("status"), (F.col("ts") + hour).alias("status_ts"),
                 none_d.alias("outcome_pnl_pips"), F.lit(7).alias("outcome_bars_held")),
        F.struct(F.lit(2).alias("seq"), F.col("status").alias("status"), (F.col("ts") + hour * 2).alias("status_ts"),
                 F.when(k % 2 == 1, F.col("outcome_pnl_pips")).alias("outcome_pnl_pips"), none_i.alias("outcome_bars_held"))))
    ev = s.where(k % 5 != 0).select("id", two.alias("e")).select(
        "id", "e.*", none_d.alias("max_adverse_pips"), none_d.alias("max_favor_pips"))
    return store.apply_status(base, ev).select("id", "status", "status_ts", "outcome_pnl_pips", "outcome_bars_held")


@query("position_reconcile", """
WITH p AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 3 = 0 THEN 'FLAT' ELSE 'LONG' END AS d,
    CASE WHEN c_custkey % 3 = 2 THEN c_custkey * 4 END AS link FROM customer),
g AS (SELECT o_custkey AS s, o_orderkey AS id, o_orderstatus IN ('F', 'O') AS live FROM orders)
SELECT s AS symbol, link AS signal_id, CASE WHEN link IS NULL THEN 'none' WHEN link IN (SELECT id FROM g WHERE live) THEN 'ok' ELSE 'clear_link' END AS action
FROM p WHERE d <> 'FLAT'
UNION ALL SELECT p.s, g.id, 'expire' FROM p JOIN g ON g.s = p.s AND g.live WHERE d = 'FLAT'""")
def position_reconcile(spark, sf_dir):
    c, o, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey")
    pos = c.select(k.alias("symbol"), F.when(k % 3 == 0, "FLAT").otherwise("LONG").alias("direction"),
                   F.when(k % 3 == 2, k * 4).alias("entry_signal_id"))
    st = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "active").otherwise("win")
    sig = o.select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("id"), st.alias("status"))
    return store.reconcile(pos, sig)


@query("monthly_archive", _w("""
SELECT year(ts) AS year, month(ts) AS month, count(*) AS rows_out, count(*) FILTER (WHERE status = 'win') AS wins FROM sg GROUP BY 1, 2"""))
def monthly_archive(spark, sf_dir):
    """Rows per month read back from the partitioned archive."""
    from tapeworks.sources.tables import archive_months, read_archive
    from tapeworks.storage import shared_dir
    import uuid

    path = f"{shared_dir(spark)}/tapeworks/archive-{uuid.uuid4().hex}"
    archive_months(signals(spark, sf_dir).select("id", "ts", "status"), path)
    back = read_archive(spark, path)
    return back.groupBy(F.year("ts").cast("bigint").alias("year"), F.month("ts").cast("bigint").alias("month")).agg(
        F.count(F.lit(1)).alias("rows_out"), F.count_if(F.col("status") == "win").alias("wins"))


# --- subscribers ----------------------------------------------------------------------------

def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subscribers; preference bits come from their keys."""
    c = F.col

    def bits(key: str, names: list[str]):
        return F.filter(F.array(*[
            F.when(F.shiftright(c(key).cast("int"), i).bitwiseAND(F.lit(1)) == 1, F.lit(n)) for i, n in enumerate(names)
        ]), lambda x: x.isNotNull())

    prefs = F.struct(bits("c_custkey", _SYMBOLS).alias("pairs"), bits("c_nationkey", _SESSIONS).alias("sessions"),
                     (c("c_custkey") * 7 % 101).cast("int").alias("min_score"))
    tier = F.when(c("c_acctbal") > 7000, "pro").when(c("c_acctbal") > 4000, "premium").otherwise("free")
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("telegram_id"), tier.alias("tier"), prefs.alias("prefs"), (c("c_acctbal") < -500).alias("banned"))


USERS_SQL = """
us AS (SELECT c_custkey AS uid, CASE WHEN c_acctbal > 4000 THEN 0 ELSE 1800 END AS delay, c_custkey * 7 % 101 AS min_score,
  [x FOR x IN [CASE WHEN c_custkey & 1 > 0 THEN 'EUR/USD' END, CASE WHEN c_custkey & 2 > 0 THEN 'GBP/USD' END, CASE WHEN c_custkey & 4 > 0 THEN 'USD/JPY' END,
    CASE WHEN c_custkey & 8 > 0 THEN 'XAU/USD' END] IF x IS NOT NULL] AS pairs,
  [x FOR x IN [CASE WHEN c_nationkey & 1 > 0 THEN 'ASIA' END, CASE WHEN c_nationkey & 2 > 0 THEN 'LONDON' END, CASE WHEN c_nationkey & 4 > 0 THEN 'NEWYORK' END,
    CASE WHEN c_nationkey & 8 > 0 THEN 'OVERLAP' END] IF x IS NOT NULL] AS sessions FROM customer WHERE NOT c_acctbal < -500)"""


@query("fanout_match", _w("""
SELECT ss.id, session, count(uid) FILTER (WHERE delay = 0) AS immediate, count(uid) FILTER (WHERE delay > 0) AS delayed
FROM ss LEFT JOIN us ON list_contains(pairs, symbol) AND list_contains(sessions, session) AND score_total >= min_score GROUP BY 1, 2""",
    USERS_SQL, _FLAGS_SQL.replace("value FROM events", "sg.* EXCLUDE (ts) FROM sg"), f"ss AS (SELECT *, {_PRIMARY_SQL} AS session FROM fl)"))
def fanout_match(spark, sf_dir):
    """Recipients per signal, immediate and delayed, for all signals and subscribers."""
    s = signals(spark, sf_dir).withColumn("session", tx.primary_session(F.col("ts")))
    return fanout.recipient_counts(s, users(spark, sf_dir)).select("id", "session", "immediate", "delayed")


@query("live_recipients", _w("""
SELECT ss.id, uid AS telegram_id, delay AS delay_seconds, ss.ts + to_seconds(delay) AS send_at
FROM ss JOIN us ON list_contains(pairs, symbol) AND list_contains(sessions, session) AND score_total >= min_score
WHERE ss.ts = (SELECT max(ts) FROM ss WHERE session IS NOT NULL)""",
    USERS_SQL, _FLAGS_SQL.replace("value FROM events", "sg.* EXCLUDE (ts) FROM sg"), f"ss AS (SELECT *, {_PRIMARY_SQL} AS session FROM fl)"))
def live_recipients(spark, sf_dir):
    """Deliveries of the newest instant's signals: what one live batch sends, to whom and when."""
    s = signals(spark, sf_dir).withColumn("session", tx.primary_session(F.col("ts"))).where("session IS NOT NULL")
    newest = s.agg(F.max("ts").alias("ts"))
    return fanout.select_recipients(s.join(newest, "ts"), users(spark, sf_dir))


@query("prefs_normalized", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'LONDON,NEWYORK' WHEN 1 THEN 'ASIA' ELSE '' END AS sessions,
  greatest(0, least(100, c_custkey % 140 - 20)) AS min_score FROM customer""")
def prefs_normalized(spark, sf_dir):
    """Messy preference text cleaned: trim, upper case, NY alias, blanks and copies dropped."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, " ny , London,LONDON,").when(k % 3 == 1, "asia,  ").otherwise("  ")
    clean = sc.normalize_names(F.split(raw, ","), {"NY": "NEWYORK"})
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat_ws(",", clean).alias("sessions"),
        F.greatest(F.lit(0), F.least(F.lit(100), k % 140 - 20)).alias("min_score"))


@query("paper_choice", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'FLAT' END
  WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END ELSE 'FLAT' END AS signal FROM orders""")
def paper_choice(spark, sf_dir):
    """What the paper position follows: the slow trend while it is open, else a confluent signal."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    trend = F.when(c % 3 == 0, "LONG").when(c % 3 == 1, "SHORT").otherwise("FLAT")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rules.paper_signal(k % 3 == 0, k % 2 == 0, F.when(c % 2 == 0, "LONG").otherwise("SHORT"), trend).alias("signal"))


@query("user_registry", """
WITH u AS (SELECT c_custkey AS telegram_id, CASE c_custkey % 3 WHEN 0 THEN 'Premium' WHEN 1 THEN 'free' ELSE 'PRO' END AS tier, c_custkey % 11 = 0 AS banned,
    CASE c_custkey % 4 WHEN 0 THEN '["EUR/USD","XAU/USD"]' WHEN 1 THEN '["GBP/USD"]' WHEN 2 THEN '[]' END AS pairs,
    CASE c_custkey % 3 WHEN 0 THEN '["LONDON","NEWYORK"]' ELSE '["ASIA"]' END AS sessions, greatest(0, least(100, c_custkey % 140 - 20)) AS min_score,
    c_custkey % 50 AS a, c_custkey % 31 + 20 AS b FROM customer)
SELECT telegram_id, tier, banned, row_number() OVER (PARTITION BY lower(tier) ORDER BY telegram_id) AS place,
  '{' || CASE WHEN pairs IS NULL THEN '' ELSE '"pairs":' || pairs || ',' END || '"sessions":' || sessions || ',"min_score":' || min_score || '}' AS prefs,
  CASE WHEN a + b = 60 THEN '{"structure":' || a || ',"momentum":' || b || ',"session":30,"cost":10}' END AS weights FROM u""")
def user_registry(spark, sf_dir):
    """Users with messy preferences, stored as VARIANT and read again; each one's place by id in the tier,
    preferences and score weights as JSON text."""
    k = F.col("c_custkey")
    pairs = F.when(k % 4 == 0, '[" xau/usd", "EUR/USD", ""]').when(k % 4 == 1, '["gbp/usd","GBP/USD "]').when(k % 4 == 2, "[]").otherwise('"none"')
    text = F.concat(F.lit('{"pairs": '), pairs, F.lit(', "sessions": '), F.when(k % 3 == 0, '["ny", "London"]').otherwise('["asia "]'), F.lit(', "min_score": '), k % 140 - 20, F.lit("}"))
    users = table(spark, sf_dir, "customer").select(
        k.alias("telegram_id"), F.when(k % 3 == 0, "Premium").when(k % 3 == 1, "free").otherwise("PRO").alias("tier"), (k % 11 == 0).alias("banned"), F.parse_json(text).alias("prefs"))
    u = feeds.subscribers(materialize(users))
    place = F.row_number().over(Window.partitionBy(F.lower("tier")).orderBy("telegram_id"))
    tiers = [fanout.by_tier(u, t).withColumn("place", place) for t in ("free", "pro", "premium")]
    a, b = F.col("telegram_id") % 50, F.col("telegram_id") % 31 + 20
    return reduce(DataFrame.union, tiers).select(
        "telegram_id", "tier", "banned", "place", sc.prefs_json(F.col("prefs")).alias("prefs"), sc.weights_json(a, b, F.lit(30), F.lit(10)).alias("weights"))


# --- gates and repeats ----------------------------------------------------------------------

@query("alert_gates", _w("""
SELECT d.id, coalesce(other, CASE WHEN dup THEN 'duplicate' END) AS reject_reason FROM d LEFT JOIN e USING (id)""", """
d AS (SELECT id, symbol, ts, direction, time_bucket(INTERVAL 4 HOUR, ts) AS h4, CASE WHEN o_orderkey % 2 = 1 THEN 'no confluence' WHEN o_orderkey % 13 = 0 THEN 'halted'
  WHEN o_custkey % 5 = 0 THEN 'fast frame disagrees' WHEN score_total < 40 THEN 'score below threshold' WHEN o_orderkey % 17 = 0 THEN 'news window' END AS other FROM sg),
e AS (SELECT id, lag(direction) OVER w = direction AND lag(h4) OVER w = h4 AS dup FROM d WHERE other IS NULL WINDOW w AS (PARTITION BY symbol ORDER BY (ts, id)))"""))
def alert_gates(spark, sf_dir):
    s, k = signals(spark, sf_dir), F.col("o_orderkey")
    s = s.withColumns({
        "h4_ts": tx.bar_floor(F.col("ts"), 240), "at": F.struct("ts", "id"),
        "confluence": k % 2 == 0, "halted": k % 13 == 0, "news_blocked": k % 17 == 0,
        "m15_signal": F.when(F.col("o_custkey") % 5 == 0, "FLAT").otherwise(F.col("direction"))})
    return store.alert_decision(s, threshold=40, order="at").select("id", "reject_reason")


_REPEAT_SQL = """
WITH RECURSIVE r AS (SELECT event_id, event_type AS symbol, user_id % 2 AS side, ts, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY ts, event_id) AS n FROM {src}),
a AS (SELECT symbol, side, n, event_id, ts AS last, true AS accepted FROM r WHERE n = 1
  UNION ALL SELECT r.symbol, r.side, r.n, r.event_id, CASE WHEN r.ts - a.last < INTERVAL 1 HOUR THEN a.last ELSE r.ts END, r.ts - a.last >= INTERVAL 1 HOUR
  FROM a JOIN r ON r.symbol = a.symbol AND r.side = a.side AND r.n = a.n + 1)"""


@query("repeat_suppression", _REPEAT_SQL.format(src="events") + " SELECT event_id, accepted FROM a")
def repeat_suppression(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("symbol"), (F.col("user_id") % 2).alias("side"), F.col("ts").cast("timestamp").alias("ts"))
    return risk.suppress_repeats(ev, ["symbol", "side"], tie="event_id").select("event_id", "accepted")


@query("external_signals", _REPEAT_SQL.format(src="(SELECT * FROM events WHERE value > 5 AND user_id % 3 <> 0)") + """
SELECT a.event_id, round(CASE WHEN abs(e.value - e.value * 0.9) > 0 THEN abs(e.value * 1.25 - e.value) / abs(e.value - e.value * 0.9) END, 6) AS rr
FROM a JOIN events e ON e.event_id = a.event_id WHERE accepted""")
def external_signals(spark, sf_dir):
    ev, v, u = table(spark, sf_dir, "events"), F.col("value"), F.col("user_id")
    parsed = ev.select(
        "event_id", F.col("event_type").alias("symbol"), F.when(u % 2 == 0, "long").otherwise("short").alias("direction"),
        F.col("ts").cast("timestamp").alias("ts"), (v > 5).alias("is_signal"),
        F.when(u % 3 == 0, "LOW").otherwise("HIGH").alias("confidence"), v.alias("entry"), (v * 0.9).alias("sl"), (v * 1.25).alias("tp"))
    return risk.external_signals(parsed, tie="event_id").select("event_id", "rr")
