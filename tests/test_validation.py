import datetime as dt
import itertools
import math
import random
import statistics

import pytest
from helpers import bars, walk
from pyspark.sql import functions as F

from tapeworks.functions import stats
from tapeworks.operators import indicators as ind
from tapeworks.operators import trials
from tapeworks.operators import validation as val
from tapeworks.operators.series import index_series

N = statistics.NormalDist()


def test_normal_functions(spark):
    xs = [i / 7 for i in range(-60, 61)]
    got = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - N.cdf(r["x"])) < 1e-13 for r in got)
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.99999]
    got = spark.createDataFrame([(p,) for p in ps], "p DOUBLE").select("p", stats.normal_quantile(F.col("p")).alias("x")).collect()
    assert all(abs(r["x"] - N.inv_cdf(r["p"])) < 1e-7 for r in got)


def dsr(sr, n_obs, n, var, kurt=6.0):
    g = stats.EULER_MASCHERONI
    sr0 = math.sqrt(var) * ((1 - g) * N.inv_cdf(1 - 1 / n) + g * N.inv_cdf(1 - 1 / (n * math.e))) if n > 1 else 0.0
    return N.cdf((sr - sr0) * math.sqrt(n_obs - 1) / math.sqrt(max(1e-12, 1 + (kurt - 1) / 4 * sr * sr)))


def test_best_of_200_random_trials_is_rejected(spark):
    rng = random.Random(11)
    rows = []
    for i in range(200):
        p = [rng.gauss(0, 1) for _ in range(300)]
        rows.append((f"T{i}", "C", "S", statistics.mean(p) / statistics.stdev(p), i))
    t = spark.createDataFrame(rows, "result_id STRING, campaign_id STRING, strategy STRING, observed_sharpe DOUBLE, seq BIGINT")
    fam = ["campaign_id", "strategy"]
    best = trials.family_stats(t, fam).select(*fam, F.col("best_sharpe").alias("observed_sharpe"), F.lit(300).alias("n_obs"))
    r = trials.family_dsr(t, fam, best).first()
    sh = [x[3] for x in rows]
    assert r["probability"] == pytest.approx(dsr(max(sh), 300, 200, statistics.variance(sh)), abs=1e-6)
    assert r["probability"] < 0.95 and r["n_trials"] == 200
    solo = trials.family_dsr(t.where("result_id = 'T0'"), fam, best).first()
    assert "no multiple-testing penalty" in solo["warnings"]


def test_dsr_fails_closed(spark):
    t = spark.createDataFrame([("a", "C", 0.5), ("b", "C", 0.5), ("c", "C", 0.5)], "result_id STRING, campaign_id STRING, observed_sharpe DOUBLE")
    obs = spark.createDataFrame([("C", 0.5, 300)], "campaign_id STRING, observed_sharpe DOUBLE, n_obs INT")
    r = trials.family_dsr(t, ["campaign_id"], obs).first()
    assert r["probability"] is None and r["refused"] and "suspiciously low trial variance" in r["warnings"]
    with pytest.raises(Exception, match="without variance"):
        trials.family_dsr(t, ["campaign_id"], obs, strict=True).collect()


GOOD = {
    "EQUITY_CURVE": {"drawdown_pct": 0.1}, "TRADE_LEDGER": {"n_trades": 300, "profit_factor": 2.0, "expectancy": 1.0, "sharpe": 0.3},
    "DATA_QUALITY": {"passed": 1}, "NO_LOOKAHEAD": {"passed": 1}, "WALK_FORWARD": {"pass_rate": 0.8}, "RANDOMIZED_ENTRY": {"rank": 0.99},
    "ONE_BAR_DELAY": {"base_expectancy": 1.0, "delayed_expectancy": 0.8}, "COST_STRESS": {"expectancy_at_1_5x": 0.5},
    "MONTE_CARLO_DD": {"p95_drawdown_pct": 0.2}, "LOCKBOX": {"expectancy": 0.4}}
FAULTS = [
    ("TRADE_LEDGER", "n_trades", 199, "sample"), ("TRADE_LEDGER", "profit_factor", 1.2, "profit_factor"), ("TRADE_LEDGER", "expectancy", 0.0, "expectancy"),
    ("EQUITY_CURVE", "drawdown_pct", 0.21, "max_drawdown"), ("WALK_FORWARD", "pass_rate", 0.59, "walk_forward"),
    ("RANDOMIZED_ENTRY", "rank", 0.94, "randomized_entry"), ("ONE_BAR_DELAY", "delayed_expectancy", 0.49, "one_bar_delay"),
    ("COST_STRESS", "expectancy_at_1_5x", 0.0, "cost_stress"), ("MONTE_CARLO_DD", "p95_drawdown_pct", 0.31, "mc_p95_drawdown"),
    ("LOCKBOX", "expectancy", -0.1, "lockbox"), ("DATA_QUALITY", "passed", 0, "data_quality"), ("NO_LOOKAHEAD", "passed", 0, "no_lookahead")]


def test_gate_isolates_each_criterion(spark):
    rows, want = [], {"ok": [], "dsr": ["deflated_sharpe"], "missing": ["missing artifact: LOCKBOX"], "mixed": ["provenance mismatch"]}
    def put(run, payloads, skip=None, mixed=None):
        for kind, p in payloads.items():
            if kind != skip:
                rows.append((run, run, kind, {k: float(v) for k, v in p.items()}, "d2" if kind == mixed else "d1", "f", "c", 1))
    put("ok", GOOD), put("dsr", GOOD), put("missing", GOOD, skip="LOCKBOX"), put("mixed", GOOD, mixed="WALK_FORWARD")
    for i, (kind, key, v, name) in enumerate(FAULTS):
        put(f"f{i}", {**GOOD, kind: {**GOOD[kind], key: v}})
        want[f"f{i}"] = [name]
    art = spark.createDataFrame(rows, "run_id STRING, trial_id STRING, artifact_type STRING, payload MAP<STRING, DOUBLE>, data_hash STRING, "
                                      "feature_version STRING, cost_model_version STRING, created_seq INT")
    prob = art.select("run_id").distinct().withColumn("probability", F.when(F.col("run_id") == "dsr", 0.95).otherwise(0.99))
    got = {r["run_id"]: r for r in trials.evaluate_gate(art, prob).collect()}
    assert {k: r["failed_criteria"] for k, r in got.items()} == want
    assert [k for k, r in got.items() if r["verdict"] == "GO"] == ["ok"]


def test_audit_and_latest(spark):
    log = spark.createDataFrame([("a", "C", "S", "RUNNING", 1), ("a", "C", "S", "COMPLETE", 2), ("b", "C", "S", "COMPLETE", 3), ("c", "D", "S", "FAILED", 4)],
                                "result_id STRING, campaign_id STRING, strategy STRING, status STRING, seq BIGINT")
    art = spark.createDataFrame([("a", "C"), ("zz", "C")], "trial_id STRING, campaign_id STRING")
    assert {r["result_id"]: r["status"] for r in trials.latest(log).collect()} == {"a": "COMPLETE", "b": "COMPLETE", "c": "FAILED"}
    got = {(r[0], r[1]) for r in trials.audit(art, log).collect()}
    assert got == {("orphan artifact", "zz"), ("complete trial without artifacts", "b")}
    assert trials.audit(art, log, campaign=("D", "S")).count() == 0
    assert trials.orphan_artifacts(art, log).count() == 1


def test_run_logged_keeps_failures(spark):
    seen = []
    trials.run_logged(spark, lambda d: seen.append(d.first()["status"]), {"strategy": "s", "result_id": "r", "seq": 0}, lambda: 0.4)
    with pytest.raises(ZeroDivisionError):
        trials.run_logged(spark, lambda d: seen.append(d.first()["status"]), {"strategy": "s", "result_id": "r", "seq": 1}, lambda: 1 / 0)
    assert seen == ["RUNNING", "COMPLETE", "RUNNING", "FAILED"]


def test_lookahead_reports_leaks(spark):
    s = index_series(bars(spark, walk(200, 5, "X")), ("symbol", "timeframe"))
    ok = val.lookahead_leaks(s, lambda x: ind.add(x, ind.ema(5, "e"), ind.tsi(6, 4, 3)), ["e", "tsi"])
    assert ok.where("leak").count() == 0 and ok.count() == 8
    future = val.lookahead_leaks(s, lambda x: x.windowed(lambda w: {"f": F.lead("close").over(w)}, ahead=1), ["f"])
    assert future.where("leak").count() == 7


def test_bootstrap_paths_equal_row_level(spark):
    rng = random.Random(2)
    rows = [("r", i, rng.gauss(0, 1)) for i in range(130)] + [("one", 0, 1.5)]
    s = index_series(spark.createDataFrame(rows, "run STRING, i BIGINT, v DOUBLE"), ("run",), order="i")
    sizes = s.df.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    plan = val.bootstrap_blocks(sizes, ["run"], n_resamples=25, seed=3)
    fast = {(r["run"], r["resample"]): r for r in val.bootstrap_paths(s, plan, "v").collect()}
    slow: dict = {}
    for r in val.bootstrap_rows(s, plan, "v").orderBy("block_no", "pos").collect():
        slow.setdefault((r["run"], r["resample"]), []).append(r["v"])
    assert len(fast) == len(slow) == 50
    for k, xs in slow.items():
        assert len(xs) == (130 if k[0] == "r" else 1)
        cum = peak = dd = 0.0
        for x in xs:
            cum += x
            peak = max(peak, cum)
            dd = max(dd, peak - cum)
        assert fast[k]["mean_pnl"] == pytest.approx(statistics.mean(xs)) and fast[k]["max_drawdown"] == pytest.approx(dd, abs=1e-9)
    stat = val.bootstrap_statistic(s, plan, "v", F.max("v")).collect()
    assert all(r["stat"] == max(slow[(r["run"], r["resample"])]) for r in stat)
    again = val.bootstrap_blocks(sizes, ["run"], n_resamples=25, seed=3)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("rows_per_chunk", [5, 40, 100_000])
def test_block_summaries_across_chunks(spark, rows_per_chunk):
    """Blocks within, across and longer than a chunk of rows; rows without a value add nothing."""
    rng = random.Random(4)
    vs = {"a": [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(203)], "b": [rng.gauss(0, 1) for _ in range(9)]}
    df = spark.createDataFrame([(r, i, v) for r, xs in vs.items() for i, v in enumerate(xs)], "run STRING, i BIGINT, v DOUBLE")
    s = index_series(df, ("run",), order="i", bucket=F.floor(F.col("i") / 50), rows_per_chunk=rows_per_chunk)
    sizes = s.df.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    plan = val.bootstrap_blocks(sizes, ["run"], n_resamples=60, seed=5)
    drawn = {(r["run"], r["resample"], r["block_no"]): (r["start"], r["len"]) for r in plan.collect()}
    found = val.block_summaries(s, plan, "v").collect()
    assert len(found) == len(drawn) == 60 * (15 + 3)
    for r in found:
        start, n = drawn[r["run"], r["resample"], r["block_no"]]
        xs = vs[r["run"]][start:start + n]
        cum = list(itertools.accumulate(x or 0.0 for x in xs))
        dd = max(max(cum[:i + 1]) - c for i, c in enumerate(cum))
        assert (r["n"], len(xs)) == (sum(x is not None for x in xs), n)
        assert (r["total"], r["top"], r["bottom"], r["dd"]) == pytest.approx((cum[-1], max(cum), min(cum), dd), abs=1e-9)


def test_splits(spark):
    s = index_series(spark.createDataFrame([("r", i) for i in range(23)], "run STRING, i BIGINT"), ("run",), order="i")
    parts = dict(val.ratio_split(s, 0.7).df.groupBy("part").count().collect())
    assert parts == {"train": 16, "oos": 7}
    f = val.purged_kfold(s, 4, 2).collect()
    for k in range(4):
        lo, hi = k * 5, 23 if k == 3 else (k + 1) * 5
        want = {i: "test" if lo <= i < hi else "purged" if lo - 2 <= i < hi + 2 else "train" for i in range(23)}
        assert {r["k"]: r["role"] for r in f if r["fold"] == k} == want
    with pytest.raises(ValueError):
        val.purged_kfold(s, 1, 0)


def test_windows_and_assignment_agree(spark):
    span = spark.createDataFrame([("r", dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1))], "run STRING, start TIMESTAMP, end TIMESTAMP")
    kw = dict(train_days=40, test_days=20, step_days=9)
    w = val.walk_forward_windows(span, ["run"], **kw).collect()
    assert all(r["train_end"] == r["test_start"] and r["test_end"] <= dt.datetime(2024, 6, 1) for r in w)
    rows = spark.createDataFrame([("r", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(520)], "run STRING, ts TIMESTAMP")
    got = {(r["ts"], r["window"]) for r in val.assign_test_windows(rows, span, ["run"], ts="ts", **kw).collect()}
    want = {(t["ts"], r["window"]) for t in rows.collect() for r in w if r["test_start"] <= t["ts"] < r["test_end"]}
    assert got == want and len(w) == 11


def test_index_quantile_and_rank(spark):
    xs = [float(i % 37) for i in range(100)]
    d = spark.createDataFrame([("r", x) for x in xs], "run STRING, v DOUBLE")
    assert val.index_quantile(d, ["run"], "v").first()["quantile"] == sorted(xs)[95]
    obs = spark.createDataFrame([("r", 10.0)], "run STRING, observed DOUBLE")
    assert val.percentile_rank(d, obs, ["run"], "v").first()["rank"] == sum(x < 10 for x in xs) / 100


def test_random_baseline_is_seeded(spark):
    a, b = (val.random_baseline(spark, 2000, seed=4, sd=2.0) for _ in range(2))
    assert a.collect() == b.collect()
    r = a.agg(F.avg("pnl"), F.stddev("pnl")).first()
    assert abs(r[0]) < 0.2 and abs(r[1] - 2.0) < 0.15
