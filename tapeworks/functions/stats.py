"""Normal distribution and Sharpe deflation as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational approximation of the normal CDF (Hart; West 2005).
CDF_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of the normal quantile.
INV_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
INV_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0)
INV_LOW = 0.02425
EULER_MASCHERONI = 0.5772156649015329


def _horner(coeffs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Accurate to about 1e-15 for |x| < 7.07, continued fraction beyond."""
    a = F.abs(x)
    near = F.exp(-a * a / 2) * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)
    frac = a + 0.65
    for n in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(n) / frac
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(
        F.exp(-a * a / 2) / frac / 2.506628274631)
    return F.when(x.isNull(), F.lit(None)).when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Acklam's approximation (relative error about 1e-9)."""
    q = p - 0.5
    r = q * q
    mid = q * _horner(INV_A, r) / _horner(INV_B, r)
    lo, hi = F.sqrt(F.log(p) * -2), F.sqrt(F.log(F.lit(1.0) - p) * -2)
    return (
        F.when(p < INV_LOW, _horner(INV_C, lo) / _horner(INV_D, lo))
        .when(p > 1 - INV_LOW, -_horner(INV_C, hi) / _horner(INV_D, hi))
        .otherwise(mid)
    )


def with_expected_max_sharpe(df: DataFrame, n_trials: str, sr_variance: str, out: str) -> DataFrame:
    """Adds the expected best Sharpe of n independent trials; 0 below two trials or without
    variance. Quantile arguments are staged so that each is computed once."""
    n, one = F.col(n_trials), F.lit(1.0)
    df = df.withColumn("_p1", one - one / n).withColumn("_p2", one - one / (n * math.e))
    best = normal_quantile(F.col("_p1")) * (1 - EULER_MASCHERONI) + normal_quantile(
        F.col("_p2")) * EULER_MASCHERONI
    value = F.when((n >= 2) & (F.col(sr_variance) > 0), F.sqrt(sr_variance) * best).otherwise(0.0)
    return df.withColumn(out, value).drop("_p1", "_p2")


def with_deflated_sharpe(df: DataFrame, *, observed: str, n_obs: str, n_trials: str,
                         sr_variance: str, skew: float = 0.0, kurtosis: float = 6.0,
                         strict: bool = True, out: str = "probability") -> DataFrame:
    """Adds benchmark_sharpe and the probability that the true Sharpe beats it.

    Fails closed: without trials, with fewer than two observations, or with several trials
    that show no variance it raises, or leaves NULL and a ``refused`` reason when not strict
    (a batch over many families must not die on one of them).
    """
    n, sr = F.col(n_trials), F.col(observed)
    df = with_expected_max_sharpe(df, n_trials, sr_variance, "benchmark_sharpe")
    refused = (
        F.when(n < 1, "no trials").when(F.col(n_obs) < 2, "fewer than two observations")
        .when((n > 1) & ~F.coalesce(F.col(sr_variance) > 0, F.lit(False)),
              "several trials without variance")
    )
    spread = F.greatest(F.lit(1e-12), F.lit(1.0) - sr * skew + sr * sr * ((kurtosis - 1) / 4))
    z = (sr - F.col("benchmark_sharpe")) * F.sqrt(F.col(n_obs) - 1) / F.sqrt(spread)
    df = df.withColumn("refused", refused)
    if strict:
        df = df.withColumn("_z", F.when(
            F.col("refused").isNotNull(), F.raise_error(F.col("refused")).cast("double")).otherwise(z))
    else:
        df = df.withColumn("_z", F.when(F.col("refused").isNull(), z))
    return df.withColumn(out, normal_cdf(F.col("_z"))).drop("_z")


def sharpe_warnings(n_obs: Column, n_trials: Column, low_variance: Column,
                    kurtosis: float = 6.0) -> Column:
    """Reasons to distrust a deflated Sharpe."""
    return F.filter(F.array(
        F.when(F.lit(math.isclose(kurtosis, 3.0)), "normal kurtosis assumed"),
        F.when(n_obs < 200, "small sample"),
        F.when(n_trials == 1, "no multiple-testing penalty"),
        F.when(low_variance, "suspiciously low trial variance"),
    ), lambda w: w.isNotNull())
