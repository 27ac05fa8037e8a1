"""Trial log, artifacts, audits and the go/no-go gate as grouped queries over all runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.stats import sharpe_warnings, with_deflated_sharpe

# The artifact types a gate decision needs.
REQUIRED = ("EQUITY_CURVE", "TRADE_LEDGER", "DATA_QUALITY", "NO_LOOKAHEAD", "WALK_FORWARD",
            "RANDOMIZED_ENTRY", "ONE_BAR_DELAY", "COST_STRESS", "MONTE_CARLO_DD", "LOCKBOX")
# Gate thresholds.
THRESHOLDS = {
    "min_trades": 200, "min_profit_factor": 1.25, "max_drawdown_pct": 0.20,
    "min_deflated_sharpe": 0.95, "min_walk_forward_rate": 0.60, "min_entry_rank": 0.95,
    "max_mc_p95_drawdown_pct": 0.30,
}


def latest(log: DataFrame, seq: str = "seq", key: str = "result_id") -> DataFrame:
    """Last record per result in log order."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(key, "_r.*")


def family_stats(trials: DataFrame, family: list[str]) -> DataFrame:
    """Trial count, Sharpe variance, the best trial and the low-variance warning per family.

    All statuses count: failed and running trials are part of the search.
    """
    s = F.col("observed_sharpe")
    g = trials.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_trials"), F.var_samp(s).alias("sr_variance"),
        F.max(s).alias("best_sharpe"), F.max_by("result_id", F.struct(s, "result_id")).alias("best_id"),
        (F.max(s) - F.min(s)).alias("_span"), F.avg(F.abs(s)).alias("_size"))
    low = (F.col("n_trials") >= 3) & (F.col("_size") != 0) & (F.col("_span") < F.col("_size") * 0.01)
    return g.withColumn("low_variance", low).drop("_span", "_size")


def family_dsr(trials: DataFrame, family: list[str], observed: DataFrame, *,
               strict: bool = False) -> DataFrame:
    """Deflated Sharpe of observed rows (family, observed_sharpe, n_obs) against their family."""
    f = family_stats(trials, family).drop("best_sharpe", "best_id")
    f = f.withColumn("sr_variance", F.coalesce("sr_variance", F.lit(0.0)))
    df = with_deflated_sharpe(
        observed.join(f, family), observed="observed_sharpe", n_obs="n_obs", n_trials="n_trials",
        sr_variance="sr_variance", strict=strict)
    return df.withColumn("warnings", sharpe_warnings(
        F.col("n_obs"), F.col("n_trials"), F.col("low_variance")))


def orphan_artifacts(artifacts: DataFrame, trials: DataFrame) -> DataFrame:
    known = trials.select(F.col("result_id").alias("trial_id")).distinct()
    return artifacts.join(known, "trial_id", "left_anti")


def audit(artifacts: DataFrame, trials: DataFrame, *, campaign: tuple[str, str] | None = None
          ) -> DataFrame:
    """Violations: artifacts of unknown trials, and complete trials without artifacts."""
    trials = latest(trials)
    if campaign is not None:
        artifacts = artifacts.where(F.col("campaign_id") == campaign[0])
        trials = trials.where(
            (F.col("campaign_id") == campaign[0]) & (F.col("strategy") == campaign[1]))
    orphans = orphan_artifacts(artifacts, trials).select(
        F.lit("orphan artifact").alias("violation"), F.col("trial_id").alias("subject")).distinct()
    done = trials.where(F.col("status") == "COMPLETE").select(F.col("result_id").alias("trial_id"))
    silent = done.join(artifacts.select("trial_id").distinct(), "trial_id", "left_anti").select(
        F.lit("complete trial without artifacts").alias("violation"), F.col("trial_id").alias("subject"))
    return orphans.unionByName(silent)


def emit(stats: DataFrame, ids: list[str], payloads: dict[str, dict[str, Column]]) -> DataFrame:
    """Artifact rows: one per run and type, payload as a map of scalars."""
    rows = F.array(*[
        F.struct(F.lit(t).alias("artifact_type"), F.map_from_arrays(
            F.array(*[F.lit(n) for n in p]), F.array(*[c.cast("double") for c in p.values()])
        ).alias("payload"))
        for t, p in payloads.items()])
    return stats.select(*ids, F.explode(rows).alias("a")).select(*ids, "a.*")


def evaluate_gate(artifacts: DataFrame, probability: DataFrame, t: dict | None = None) -> DataFrame:
    """Decision per run_id from its artifacts alone plus the campaign's deflated Sharpe.

    Missing artifacts, then mixed provenance, stop the evaluation; otherwise every failed
    criterion is listed. ``probability`` gives run_id, probability.
    """
    t = {**THRESHOLDS, **(t or {})}
    need = artifacts.where(F.col("artifact_type").isin(*REQUIRED))
    tag = F.struct("data_hash", "feature_version", "cost_model_version")
    wide = need.groupBy("run_id").agg(
        F.count_distinct(tag).alias("_prov"),
        F.collect_set("artifact_type").alias("_have"),
        *[F.max_by("payload", F.when(F.col("artifact_type") == a, F.col("created_seq"))).alias(a)
          for a in REQUIRED],
    ).join(probability, "run_id", "left")

    def of(kind: str, name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.try_element_at(F.col(kind), F.lit(name)), F.lit(default))

    led, delay = "TRADE_LEDGER", "ONE_BAR_DELAY"
    base, late = of(delay, "base_expectancy"), of(delay, "delayed_expectancy")
    computed = {
        "n_trades": of(led, "n_trades"), "profit_factor": of(led, "profit_factor"),
        "expectancy": of(led, "expectancy"), "drawdown_pct": of("EQUITY_CURVE", "drawdown_pct"),
        "deflated_sharpe": F.coalesce(F.col("probability"), F.lit(0.0)),
        "wf_pass_rate": of("WALK_FORWARD", "pass_rate"),
        "randomized_entry_rank": of("RANDOMIZED_ENTRY", "rank"),
        "expectancy_at_1_5x": of("COST_STRESS", "expectancy_at_1_5x", -1.0),
        "mc_p95_drawdown_pct": of("MONTE_CARLO_DD", "p95_drawdown_pct", 1.0),
        "lockbox_expectancy": of("LOCKBOX", "expectancy"),
    }
    c = {n: F.col(n) for n in computed}
    survives = (late > 0) & ((base <= 0) | (late >= base * 0.5))
    criteria = [
        ("sample", c["n_trades"] < t["min_trades"]),
        ("profit_factor", c["profit_factor"] < t["min_profit_factor"]),
        ("expectancy", c["expectancy"] <= 0),
        ("max_drawdown", c["drawdown_pct"] > t["max_drawdown_pct"]),
        ("deflated_sharpe", c["deflated_sharpe"] <= t["min_deflated_sharpe"]),
        ("walk_forward", c["wf_pass_rate"] < t["min_walk_forward_rate"]),
        ("randomized_entry", c["randomized_entry_rank"] < t["min_entry_rank"]),
        ("one_bar_delay", ~survives),
        ("cost_stress", c["expectancy_at_1_5x"] <= 0),
        ("mc_p95_drawdown", c["mc_p95_drawdown_pct"] > t["max_mc_p95_drawdown_pct"]),
        ("lockbox", c["lockbox_expectancy"] <= 0),
        ("data_quality", of("DATA_QUALITY", "passed") == 0),
        ("no_lookahead", of("NO_LOOKAHEAD", "passed") == 0),
    ]
    wide = wide.withColumns(computed)
    absent = F.array_except(F.array(*[F.lit(a) for a in REQUIRED]), F.col("_have"))
    missing = F.transform(absent, lambda a: F.concat(F.lit("missing artifact: "), a))
    listed = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in criteria]), lambda x: x.isNotNull())
    failed = (
        F.when(F.size(missing) > 0, missing)
        .when(F.col("_prov") != 1, F.array(F.lit("provenance mismatch"))).otherwise(listed)
    )
    ready = (F.size(missing) == 0) & (F.col("_prov") == 1)
    return wide.select(
        "run_id", failed.alias("failed_criteria"),
        F.when(F.size(failed) == 0, "GO").otherwise("NO_GO").alias("verdict"),
        *[F.when(ready, F.col(n)).alias(n) for n in computed])


def run_logged(spark, write, trial: dict, body):
    """Two-phase log around a job: RUNNING before it, then COMPLETE or FAILED, never silent.

    ``write`` appends one-row frames to the trial table; ``body`` returns the observed Sharpe.
    """
    from tapeworks.schemas import TRIAL_DDL, schema

    def row(status: str, sharpe: float, seq: int) -> DataFrame:
        cols = schema(TRIAL_DDL).names
        full = {**trial, "status": status, "observed_sharpe": sharpe, "seq": seq}
        return spark.createDataFrame([tuple(full.get(c) for c in cols)], TRIAL_DDL)

    write(row("RUNNING", 0.0, 2 * trial["seq"]))
    try:
        sharpe = body()
    except Exception:
        write(row("FAILED", 0.0, 2 * trial["seq"] + 1))
        raise
    write(row("COMPLETE", float(sharpe), 2 * trial["seq"] + 1))
    return sharpe
