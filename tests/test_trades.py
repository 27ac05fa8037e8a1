import datetime as dt
import random

import pytest
from helpers import T0, bars, walk
from pyspark.sql import functions as F

from tapeworks.functions import costs
from tapeworks.operators import fanout, fills, joins, risk, rules
from tapeworks.operators import signal_store as store
from tapeworks.operators.series import index_series

KEYS = ("symbol", "timeframe")


def candidate_rows(n, seed, symbol):
    rng, out = random.Random(seed), []
    for r in walk(n, seed, symbol):
        side = rng.choice([0, 0, 0, 1, -1])
        sl, tp = r[6] - side * rng.uniform(0.5, 6), r[6] + side * rng.uniform(0.5, 6)
        out.append((*r, side, sl if side else None, tp if side else None, rng.random() < 0.05, rng.random() < 0.05))
    return out


def loop(rows, max_hold=None):
    pos, out = None, []
    for k, r in enumerate(rows):
        hi, lo, side, sl, tp, xl, xs = r[4], r[5], *r[7:12]
        if pos:
            pos[4] += 1
            up = pos[0] > 0
            kind = None
            if (lo <= pos[2]) if up else (hi >= pos[2]):
                kind = "SL"
            elif (hi >= pos[3]) if up else (lo <= pos[3]):
                kind = "TP"
            elif max_hold and pos[4] >= max_hold:
                kind = "EXPIRED"
            elif xl if up else xs:
                kind = "SIGNAL"
            if kind:
                out.append((pos[1], k, kind))
                pos = None
        elif side:
            pos = [side, k, sl, tp, 0]
    return out


@pytest.mark.parametrize("max_hold,chunk", [(None, 10**6), (3, 10**6), (None, 130), (3, 40), (None, 7)])
def test_selection_equals_bar_loop_across_batches(spark, max_hold, chunk):
    data = {s: candidate_rows(1700, i, s) for i, s in enumerate("AB")}
    names = ["symbol", "timeframe", "ts", "open", "high", "low", "close", "side", "sl", "tp", "exit_long", "exit_short"]
    import pandas as pd

    pdf = pd.concat([pd.DataFrame(v, columns=names).assign(k=range(len(v))) for v in data.values()])
    df = spark.createDataFrame(pdf).withColumn("k", F.col("k").cast("bigint")).repartition(6)
    t = fills.select_trades(df, ["symbol"], ["k"], ["k", "ts"], max_hold=max_hold,
                            chunk=F.col("k") / chunk)
    for s, rows in data.items():
        got = [tuple(r) for r in t.where(F.col("symbol") == s).orderBy("entry_k").select("entry_k", "exit_k", "exit_kind").collect()]
        assert got == loop(rows, max_hold) and len(got) > 50


def test_position_held_through_many_chunks(spark):
    """Candidates everywhere, but the first position only closes in the last chunk."""
    rows = [("X", i, T0 + dt.timedelta(hours=i), 10.0, 10.0, 10.0, 1, 5.0, 15.0, False, False) for i in range(100)]
    rows[93] = (*rows[93][:3], 16.0, 10.0, 10.0, *rows[93][6:])
    df = spark.createDataFrame(rows, "symbol STRING, k BIGINT, ts TIMESTAMP, high DOUBLE, low DOUBLE, close DOUBLE, side INT, "
                                     "sl DOUBLE, tp DOUBLE, exit_long BOOLEAN, exit_short BOOLEAN")
    t = fills.select_trades(df, ["symbol"], ["k"], ["k", "ts"], chunk=F.col("k") / 10).collect()
    assert [(r["entry_k"], r["exit_k"], r["exit_kind"], r["held"]) for r in t] == [(0, 93, "TP", 93)]
    assert t[0]["entry_ts"] == T0


@pytest.mark.parametrize("chunk", [100_000, 90])
def test_paper_and_level_trades_do_not_depend_on_chunks(spark, chunk):
    rows = [r[:7] for r in candidate_rows(600, 4, "A")]
    s = rules.london_sweep(index_series(bars(spark, rows), KEYS, rows_per_chunk=chunk), atr_period=3)
    paper = sorted(map(tuple, fills.paper_trades(s).select("entry_ts", "exit_ts", "exit_kind").collect()))
    level = sorted(map(tuple, fills.level_trades(s, pip_size=1.0).select("entry_ts", "exit_ts", "exit_kind").collect()))
    if not hasattr(spark, "_seen_trades"):
        spark._seen_trades = (paper, level)
    assert (paper, level) == spark._seen_trades and len(paper) > 5 and len(level) > 5


def test_triple_barrier_stop_first(spark):
    rows = [("X", "1h", T0 + dt.timedelta(hours=i), 10.0, 10.0, 10.0, 10.0) for i in range(60)]
    rows[5] = (*rows[5][:4], 13.0, 7.0, 10.0)
    rows[40] = (*rows[40][:4], 13.0, 10.0, 10.0)
    s = index_series(bars(spark, rows), KEYS)
    e = spark.createDataFrame([("X", 0, "LONG", 10.0, 8.0, 12.0), ("X", 0, "SHORT", 10.0, 12.0, 8.0), ("X", 16, "LONG", 10.0, 8.0, 12.0),
                               ("X", 15, "LONG", 10.0, 8.0, 12.0), ("X", 5, "LONG", 10.0, 8.0, 12.0)],
                              "symbol STRING, k BIGINT, direction STRING, entry DOUBLE, sl DOUBLE, tp DOUBLE")
    r = {(x["k"], x["direction"]): (x["outcome"], round(x["pnl_pips"], 6)) for x in joins.triple_barrier(e, s.df, ["symbol"]).collect()}
    assert r == {(0, "LONG"): ("SL", -20.0), (0, "SHORT"): ("SL", -20.0), (16, "LONG"): ("TP", 20.0), (15, "LONG"): ("OPEN", 0.0), (5, "LONG"): ("OPEN", 0.0)}


@pytest.mark.parametrize("bucket", [30 * 86_400, 7200])
def test_asof_carries_over_empty_buckets(spark, bucket):
    left = spark.createDataFrame([("X", T0 + dt.timedelta(minutes=37 * i)) for i in range(60)] + [("Y", T0)], "symbol STRING, ts TIMESTAMP")
    right = spark.createDataFrame([("X", T0 + dt.timedelta(hours=h), float(h)) for h in (1, 2, 17, 18)], "symbol STRING, ts TIMESTAMP, v DOUBLE")
    got = {(r["symbol"], r["ts"]): r["r_v"] for r in joins.asof_backward(
        left, right, ["symbol"], values=["v"], prefix="r_", on_close_seconds=1800, bucket_seconds=bucket).collect()}
    assert len(got) == 61 and got[("Y", T0)] is None
    for (sym, ts), v in got.items():
        ok = [h for h in (1, 2, 17, 18) if sym == "X" and T0 + dt.timedelta(hours=h, minutes=30) <= ts]
        assert v == (float(max(ok)) if ok else None)


def test_blackout_and_next_event_edges(spark):
    ev = spark.createDataFrame([(T0 + dt.timedelta(hours=5), "a"), (T0 + dt.timedelta(days=4), "b")], "event_ts TIMESTAMP, name STRING")
    rows = spark.createDataFrame([(T0 + dt.timedelta(hours=5, minutes=m),) for m in (-31, -30, 0, 15, 16)], "ts TIMESTAMP")
    assert joins.blackout(rows, ev).count() == 3 and joins.blackout(rows, ev, how="left_anti").count() == 2
    n = [r["next_name"] for r in joins.next_event(rows, ev, values=["name"]).orderBy("ts").collect()]
    assert n == ["a", "a", "b", "b", "b"]
    late = spark.createDataFrame([(T0 + dt.timedelta(days=9),)], "ts TIMESTAMP")
    assert joins.next_event(late, ev, values=["name"]).first()["next_name"] is None


def test_lookup_rejects_unknown_symbols(spark):
    from tapeworks import dims

    df = spark.createDataFrame([("EUR/USD",), ("ABC/DEF",)], "symbol STRING")
    assert joins.lookup(df.limit(1), dims.instruments(spark), "symbol", required="pip_size").first()["pip_size"] == 0.0001
    with pytest.raises(Exception, match="unknown ABC/DEF"):
        joins.lookup(df, dims.instruments(spark), "symbol", required="pip_size").collect()


def test_cost_model(spark):
    t = costs.CostTerms.literal(0.8, 3.5, 0.3, 0.05, 10.0)
    one = spark.range(1)
    v = one.select(
        costs.round_trip_pips(t, atr_pips=F.lit(10.0)).alias("a"),
        costs.round_trip_pips(t, atr_pips=F.lit(10.0), exit_on_stop=True, session=F.lit("ASIA"), stress=1.5).alias("b"),
        costs.round_trip_pips(t, atr_pips=F.lit(0.0), realized=F.lit(2.0), news=True).alias("c"),
        costs.round_trip_currency(t, atr_pips=F.lit(10.0), lots=2.0, stress=1.25).alias("d")).first()
    assert v["a"] == pytest.approx(2.4) and v["b"] == pytest.approx((0.8 + 0.8 + 1.6) * 2.25)
    assert v["c"] == pytest.approx((2.0 + 0.6) * 5) and v["d"] == pytest.approx(2.4 * 1.25 * 10 * 2 + 14)


def test_recipients_equal_brute_force(spark):
    rng = random.Random(5)
    syms, sess, tiers = ["EUR/USD", "XAU/USD"], ["LONDON", "ASIA"], ["free", "premium", "pro"]
    users = [(i, rng.choice(tiers), (rng.sample(syms, rng.randint(0, 2)), rng.sample(sess, rng.randint(0, 2)), rng.randint(0, 100)), rng.random() < 0.1) for i in range(80)]
    sig = [(f"s{i}", T0, rng.choice(syms), rng.choice([*sess, None]), rng.randint(0, 100)) for i in range(40)]
    u = spark.createDataFrame(users, "telegram_id BIGINT, tier STRING, prefs STRUCT<pairs: ARRAY<STRING>, sessions: ARRAY<STRING>, min_score: INT>, banned BOOLEAN")
    s = spark.createDataFrame(sig, "id STRING, ts TIMESTAMP, symbol STRING, session STRING, score_total INT")
    want = {(x[0], y[0]): 1800 if y[1] == "free" else 0 for x in sig for y in users
            if not y[3] and x[2] in y[2][0] and x[3] in y[2][1] and x[4] >= y[2][2]}
    got = fanout.select_recipients(s, u).collect()
    assert {(r["id"], r["telegram_id"]): r["delay_seconds"] for r in got} == want and len(got) == len(want)
    assert all((r["send_at"] - T0).total_seconds() == r["delay_seconds"] for r in got)
    for r in fanout.recipient_counts(s, u).collect():
        mine = [d for (i, _), d in want.items() if i == r["id"]]
        assert (r["immediate"], r["delayed"]) == (mine.count(0), mine.count(1800))


@pytest.mark.parametrize("chunk", [100_000, 500, 40, 3])
@pytest.mark.parametrize("pauses", [(5, 60, 600, 4000), (1, 2, 70), (600,)], ids=["pauses", "never pauses", "even"])
def test_repeats_equal_fold(spark, chunk, pauses):
    n = 3000 if chunk > 3 else 150
    rng, t, rows = random.Random(8), T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice(pauses))
        rows.append((rng.choice("AAAAB"), t, i))
    last, want = {}, {}
    for s, ts, i in rows:
        want[i] = s not in last or (ts - last[s]).total_seconds() >= 3600
        if want[i]:
            last[s] = ts
    df = spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP, i BIGINT").repartition(5)
    got = {r["i"]: r["accepted"] for r in risk.suppress_repeats(df, ["symbol"], rows_per_chunk=chunk).collect()}
    assert got == want


def test_governor_latches(spark):
    day = [-1.0, -1.5, -0.6, 5.0], [1.0] * 8, [-3.0], [0.5, -1.0]
    rows = [("acc", f"d{d}", i, r) for d, rs in enumerate(day) for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "account STRING, trading_day STRING, i INT, pnl_r DOUBLE")
    got = {r["trading_day"]: (round(r["realized_r"], 6), r["trades"], r["halted"], r["ignored"], r["halt_reason"]) for r in risk.daily_ledger(df, ["account"], ["i"]).collect()}
    assert got == {"d0": (-3.1, 3, True, 1, "daily loss limit"), "d1": (6.0, 6, True, 2, "max daily trades"),
                   "d2": (-3.0, 1, True, 0, "daily loss limit"), "d3": (-0.5, 2, False, 0, None)}
    plan = risk.daily_ledger(df, ["account"], ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_store_edges(spark):
    sig = spark.createDataFrame([(str(i), "win" if i % 3 else "loss", i % 101, "r", 1, 1, 1, 1) for i in range(19)],
                                "id STRING, status STRING, score_total INT, regime STRING, score_structure INT, score_momentum INT, score_session INT, score_cost INT")
    assert store.win_rate(sig, 0, 100, min_samples=20).first()[:] == (0.5, 0)
    assert store.win_rate(sig, 0, 100, "none").first()[:] == (0.5, 0)
    c = store.confidence_table(sig).first()
    assert c["confidence_label"] == "INSUFFICIENT" and c["confidence_n"] == 0 and c["confidence_pct"] == 0.5
    assert store.component_correlations(sig).count() == 0
    corr = spark.createDataFrame([(0.3, -0.2, 0.0, 0.0)], "structure DOUBLE, momentum DOUBLE, session DOUBLE, cost DOUBLE")
    assert tuple(store.suggest_weights(corr).first()) == (85, 5, 5, 5)
    assert store.suggest_weights(spark.createDataFrame([(-0.1, 0.0, 0.0, 0.0)], corr.schema)).count() == 0
    s = spark.createDataFrame([("a", dt.datetime(2024, 2, 29, 23)), ("b", dt.datetime(2024, 3, 1)), ("c", dt.datetime(2024, 12, 31))], "id STRING, ts TIMESTAMP")
    assert [r["id"] for r in store.month_rows(s, 2024, 2).collect()] == ["a"] and store.month_rows(s, 2024, 12).count() == 1
    assert store.kept_after_purge(s, 2024, 3).count() == 2


def test_sessions_and_paper_choice(spark):
    r = spark.createDataFrame([(True, True, "LONG", "SHORT"), (False, True, "LONG", "SHORT"), (False, False, "LONG", "SHORT")],
                              "p BOOLEAN, c BOOLEAN, d STRING, t STRING")
    got = [x[0] for x in r.select(rules.paper_signal(F.col("p"), F.col("c"), F.col("d"), F.col("t"))).collect()]
    assert got == ["SHORT", "LONG", "FLAT"]
