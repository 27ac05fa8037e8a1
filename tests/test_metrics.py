import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import metrics


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(3)
    rows = [("r", i, rng.gauss(0.1, 2)) for i in range(900)] + [("s", i, -1.0) for i in range(5)]
    return rows, spark.createDataFrame(rows, "run STRING, i BIGINT, pnl DOUBLE")


def loop(pnls):
    cum = peak0 = dd0 = 0.0
    peak, dd, pct = None, 0.0, 0.0
    for p in pnls:
        cum += p
        peak = cum if peak is None or cum > peak else peak
        if peak - cum > dd:
            dd, pct = peak - cum, (peak - cum) / abs(peak) if peak else 0.0
        peak0 = max(peak0, cum)
        dd0 = max(dd0, peak0 - cum)
    return cum, dd, pct, dd0, peak


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_drawdown_is_the_same_for_any_chunking(trades, size):
    rows, df = trades
    parts = metrics.drawdown_parts(df, ["run"], ["i"], [F.floor(F.col("i") / size)])
    basic = {r["run"]: r for r in metrics.basic_metrics(parts, ["run"]).collect()}
    strat = {r["run"]: r for r in metrics.strategy_metrics(parts, ["run"]).collect()}
    script = {r["run"]: r for r in metrics.walk_forward_metrics(parts, ["run"]).collect()}
    for run in ("r", "s"):
        p = [x[2] for x in rows if x[0] == run]
        total, dd, pct, dd0, peak = loop(p)
        assert math.isclose(basic[run]["total_return"], total, rel_tol=1e-9)
        assert math.isclose(basic[run]["max_drawdown_abs"], dd, rel_tol=1e-9)
        assert math.isclose(basic[run]["max_drawdown_pct"], pct, rel_tol=1e-9)
        assert math.isclose(strat[run]["max_drawdown"], dd0, rel_tol=1e-9)
        assert math.isclose(script[run]["max_drawdown_pct"], dd / abs(peak), rel_tol=1e-9)
        sd = statistics.stdev(p)
        assert math.isclose(strat[run]["sharpe"], statistics.mean(p) / sd if sd else 0.0, rel_tol=1e-9, abs_tol=1e-12)
    assert strat["s"]["profit_factor"] == 0.0


def test_equity_curve_chunks(trades):
    rows, df = trades
    e = metrics.equity_curve(df, ["run"], ["i"], [F.floor(F.col("i") / 50)])
    got = [tuple(r) for r in e.where("run = 'r'").orderBy("i").select("equity", "drawdown").collect()]
    cum, peak = 0.0, -math.inf
    for (eq, dd), p in zip(got, [x[2] for x in rows if x[0] == "r"]):
        cum += p
        peak = max(peak, cum)
        assert abs(eq - cum) < 1e-9 and abs(dd - (peak - cum)) < 1e-9


def test_undefined_figures(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "EXIT_TP")], "run STRING, i BIGINT, pnl DOUBLE, exit_kind STRING")
    df = df.withColumns({"entry_ts": F.current_timestamp(), "exit_ts": F.current_timestamp()})
    r = metrics.journal_performance(df, ["run"], ["i"], [F.lit(0)]).first()
    assert r["profit_factor"] == math.inf and math.isnan(r["sharpe_ratio"]) and r["exit_counts"] == {"EXIT_TP": 1}
    parts = metrics.drawdown_parts(df, ["run"], ["i"], [F.lit(0)])
    b = metrics.basic_metrics(parts, ["run"]).first()
    assert b["sharpe_ratio"] == 0.0 and b["max_drawdown_abs"] == 0.0
    assert metrics.strategy_metrics(parts, ["run"]).first()["profit_factor"] == math.inf
    assert df.agg(metrics.profit_factor(F.col("pnl"))).first()[0] == math.inf


def test_three_levels_of_chunks_agree_with_one(spark):
    import random

    rng = random.Random(7)
    rows = [("a" if i % 3 else "b", i, round(rng.gauss(0, 5), 3)) for i in range(700)]
    df = spark.createDataFrame(rows, "run STRING, i BIGINT, pnl DOUBLE")
    i = F.col("i")
    cuts = ([F.lit(0)], [F.floor(i / 200), F.floor(i / 20), F.floor(i / 3)], [F.floor(i / 90), F.floor(i / 7)])
    for zero in (False, True):
        got = []
        for cut in cuts:
            m = metrics.summarize(metrics.drawdown_parts(df, ["run"], ["i"], cut), ["run"], from_zero=zero)
            got.append({r["run"]: r.asDict() for r in m.collect()})
        for run in ("a", "b"):
            for other in got[1:]:
                for k, v in got[0][run].items():
                    assert k == "run" or abs(other[run][k] - v) < 1e-6, k
