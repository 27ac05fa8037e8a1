"""Splits, resampling and overfitting control."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.series import Series
from tapeworks.storage import materialize


def ratio_split(series: Series, ratio: float = 0.7) -> Series:
    """Adds part: 'train' for the first floor(n*ratio) rows, else 'oos'."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie strictly between 0 and 1")
    keys = list(series.keys)
    n = series.df.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_cut"))
    df = series.df.join(n, keys).withColumn(
        "part", F.when(F.col("k") < F.col("_cut"), "train").otherwise("oos"))
    return series.with_df(df.drop("_cut"))


def verdict_table(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds failures (names of the checks that hold) and verdict GO/NO_GO."""
    found = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())
    return df.withColumn("failures", found).withColumn(
        "verdict", F.when(F.size("failures") == 0, "GO").otherwise("NO_GO"))


def walk_forward_windows(spans: DataFrame, keys: list[str], *, train_days: int, test_days: int,
                         step_days: int | None = None) -> DataFrame:
    """Rolling windows per key from ``start``/``end``, emitted while the test part fits."""
    step = step_days or test_days
    if min(train_days, test_days, step) <= 0:
        raise ValueError("train, test and step must be positive")
    def days(n: Column) -> Column:
        return F.make_dt_interval(days=n.cast("int"))

    room = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 86_400e6
                   - (train_days + test_days))
    last = F.floor(room / step)
    w = spans.where(room >= 0).withColumn(
        "window", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    a = F.col("start") + days(F.col("window") * step)
    b = a + days(F.lit(train_days))
    return w.select(
        *keys, "window", a.alias("train_start"), b.alias("train_end"), b.alias("test_start"),
        (b + days(F.lit(test_days))).alias("test_end"))


def assign_test_windows(rows: DataFrame, spans: DataFrame, keys: list[str], *, ts: str,
                        train_days: int, test_days: int, step_days: int | None = None) -> DataFrame:
    """Adds ``window`` for each test window that holds the row.

    Window numbers follow from date arithmetic, so no range join is needed; a row lies in at
    most ceil(test/step) windows.
    """
    step = step_days or test_days
    s = spans.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    age = (F.unix_micros(ts) - F.unix_micros("_s")) / 86_400e6 - train_days
    room = (F.unix_micros("_e") - F.unix_micros("_s")) / 86_400e6 - (train_days + test_days)
    hi = F.least(F.floor(age / step), F.floor(room / step))
    lo = F.greatest(F.floor((age - test_days) / step) + 1, F.lit(0))
    return (
        rows.join(s, keys).where((age >= 0) & (room >= 0) & (lo <= hi))
        .withColumn("window", F.explode(F.sequence(lo, hi))).drop("_s", "_e")
    )


def purged_kfold(series: Series, n_splits: int, embargo: int) -> DataFrame:
    """One row per (row, fold): role 'test', 'train' or 'purged'.

    Folds are a constant array exploded next to each row; roles come from the position.
    """
    if n_splits < 2 or embargo < 0:
        raise ValueError("n_splits >= 2 and embargo >= 0 required")
    keys = list(series.keys)
    n = series.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    df = series.df.join(n, keys).withColumn(
        "fold", F.explode(F.array(*[F.lit(i) for i in range(n_splits)])))
    size = F.floor(F.col("_n") / n_splits)
    lo = F.col("fold") * size
    hi = F.when(F.col("fold") == n_splits - 1, F.col("_n")).otherwise(lo + size)
    k = F.col("k")
    role = (
        F.when((k >= lo) & (k < hi), "test")
        .when((k < lo - embargo) | (k >= hi + embargo), "train").otherwise("purged")
    )
    return df.withColumn("role", role).drop("_n")


def hash_draw(seed: Column, *parts: Column) -> Column:
    """Reproducible draw in 0..2^32-1, the same in any engine that has md5."""
    text = F.concat_ws("|", seed, *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bootstrap_blocks(sizes: DataFrame, keys: list[str], *, n_resamples: int, seed: int = 0,
                     block: Column | None = None) -> DataFrame:
    """Moving-block plan: (keys, resample, block_no, start, len) from rows with n per key.

    The default block length is round(sqrt(n)) within 1..n; the last block is cut to fit.
    """
    size = block if block is not None else F.greatest(
        F.lit(1), F.least(F.col("n"), F.bround(F.sqrt("n")).cast("bigint")))
    plan = sizes.where("n > 0").withColumn("_b", size)
    plan = plan.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    plan = plan.repartition(-(-n_resamples // 25), *keys, "resample")  # few rows now, one for each block next
    last = F.floor((F.col("n") - 1) / F.col("_b"))
    plan = plan.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    starts = F.greatest(F.lit(1), F.col("n") - F.col("_b") + 1)
    draw = hash_draw(F.lit(str(seed)), F.col("resample").cast("string"), F.col("block_no").cast("string"))
    return plan.select(
        *keys, "n", "resample", "block_no", F.pmod(draw, starts).alias("start"),
        F.least(F.col("_b"), F.col("n") - F.col("block_no") * F.col("_b")).alias("len"))


def bootstrap_rows(series: Series, plan: DataFrame, value: str) -> DataFrame:
    """Every resampled row, for statistics that need them all: (keys, resample, pos, value)."""
    keys = list(series.keys)
    rows = plan.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)))
    rows = rows.withColumn("k", F.col("start") + F.col("_i"))
    return rows.join(series.df.select(*keys, "k", value), [*keys, "k"]).select(
        *keys, "resample", "block_no", F.col("_i").alias("pos"), value)


def bootstrap_statistic(series: Series, plan: DataFrame, value: str, stat: Column) -> DataFrame:
    """Any aggregate column per resample."""
    return bootstrap_rows(series, plan, value).groupBy(*series.keys, "resample").agg(stat.alias("stat"))


def _summed_blocks(value: np.ndarray, start: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Summaries of the blocks of one length that begin at ``start``.

    The values are cut into segments of that length and every position is summed up to its segment's
    end and from its beginning, so a block is one or two lookups.
    """
    seg = np.zeros(-(-len(value) // length) * length)
    seg[:len(value)] = value
    seg = seg.reshape(-1, length)
    cum = np.cumsum(seg, axis=1)
    base = cum - seg

    def ahead(f: np.ufunc, x: np.ndarray) -> np.ndarray:
        return f.accumulate(x[:, ::-1], axis=1)[:, ::-1]

    at = np.divmod(start, length)
    total, top, bottom = cum[at[0], -1] - base[at], ahead(np.maximum, cum)[at] - base[at], ahead(np.minimum, cum)[at] - base[at]
    dd = ahead(np.maximum, cum - ahead(np.minimum, cum))[at]
    two = at[1] != 0
    end = np.divmod(start[two] + length - 1, length)
    peak = np.maximum.accumulate(cum, axis=1)
    low, most = total[two] + np.minimum.accumulate(cum, axis=1)[end], np.maximum.accumulate(peak - cum, axis=1)[end]
    dd[two] = np.maximum(np.maximum(dd[two], most), top[two] - low)
    top[two] = np.maximum(top[two], total[two] + peak[end])
    bottom[two] = np.minimum(bottom[two], low)
    total[two] += cum[end]
    return {"total": total, "top": top, "bottom": bottom, "dd": dd}


def block_summaries(series: Series, plan: DataFrame, value: str) -> DataFrame:
    """Number, total, highest and lowest prefix and drawdown of every block of a plan.

    Series are cut into chunks of at least a block; a chunk gets the rows that blocks from it reach. A
    key has two lengths at most, so n rows serve any number of blocks, and a task holds two chunks.
    """
    keys, plan = list(series.keys), materialize(plan)
    reach = materialize(plan.groupBy(*keys).agg(F.max("len").alias("_len")))
    size = F.greatest(F.lit(series.rows_per_chunk), F.col("_len"))
    first = F.greatest(F.floor((F.col("k") - F.col("_len") + 1) / size), F.lit(0))
    rows = series.df.select(*keys, "k", F.col(value).cast("double").alias("_p")).join(reach, keys).select(
        *keys, "k", "_p", F.explode(F.sequence(first, F.floor(F.col("k") / size))).alias("_chunk"))
    blocks = plan.join(reach, keys).select(
        *keys, "resample", "block_no", "start", "len", F.floor(F.col("start") / size).alias("_chunk"))
    own, names = [*keys, "resample", "block_no"], ("total", "top", "bottom", "dd")
    out = StructType([*(plan.schema[c] for c in own), *StructType.fromDDL("n BIGINT, " + ", ".join(f"{c} DOUBLE" for c in names)).fields])

    def summed(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        found: dict[str, np.ndarray] = {c: np.zeros(len(blocks)) for c in names}
        n = np.zeros(len(blocks), np.int64)
        if len(blocks):
            rows = rows.sort_by("k")
            p = rows["_p"].combine_chunks()
            known = np.concatenate([[0], np.cumsum(p.is_valid().to_numpy(zero_copy_only=False))])
            p = p.fill_null(0.0).to_numpy()
            start, length = blocks["start"].to_numpy() - rows["k"][0].as_py(), blocks["len"].to_numpy()
            n[:] = known[start + length] - known[start]
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                for c, x in _summed_blocks(p, start[at], int(one)).items():
                    found[c][at] = x
        cols = [*(blocks[c] for c in own), pa.array(n), *(pa.array(found[c]) for c in names)]
        return pa.Table.from_arrays(cols, names=out.names)

    part = [*keys, "_chunk"]
    return rows.groupBy(*part).cogroup(blocks.groupBy(*part)).applyInArrow(summed, out)


def bootstrap_paths(series: Series, plan: DataFrame, value: str) -> DataFrame:
    """Mean and zero-peak drawdown per resample, from one summary for each drawn block."""
    keys = list(series.keys)
    parts = block_summaries(series, plan, value)
    before = Window.partitionBy(*keys, "resample").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    parts = parts.withColumn("_high", F.greatest(F.max(F.col("_base") + F.col("top")).over(before), F.lit(0.0)))
    worst = F.greatest("dd", F.col("_high") - F.col("_base") - F.col("bottom"), F.lit(0.0))
    return parts.groupBy(*keys, "resample").agg(
        (F.sum("total") / F.sum("n")).alias("mean_pnl"), F.max(worst).alias("max_drawdown"))


def label_shuffles(series: Series, value: str, label: str, *, n_shuffles: int, seed: int = 0) -> DataFrame:
    """Mean of label times value with the labels dealt anew: (keys, shuffle, null_mean, observed, rank).

    In each shuffle the rows are ordered by a hash and row j gets the label of position j, a
    permutation that SQL can repeat. ``rank`` is the share of shuffles strictly below the
    observed mean. Costs n * shuffles rows and windows of one series each, so series are per
    day or coarser.
    """
    keys = list(series.keys)
    rows = series.settle().df.select(*keys, "k", F.col(value).alias("_v"), F.col(label).alias("_l"))
    dealt = rows.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles - 1))))
    draw = hash_draw(F.lit(str(seed)), F.col("shuffle").cast("string"), F.col("k").cast("string"))
    w = Window.partitionBy(*keys, "shuffle").orderBy(draw, "k")
    placed = dealt.withColumn("_j", F.row_number().over(w).cast("bigint") - 1)
    labels = rows.select(*keys, F.col("k").alias("_j"), F.col("_l").alias("_new"))
    null = placed.join(labels, [*keys, "_j"]).groupBy(*keys, "shuffle").agg(F.avg(F.col("_new") * F.col("_v")).alias("null_mean"))
    seen = rows.groupBy(*keys).agg(F.avg(F.col("_l") * F.col("_v")).alias("observed"))
    rank = percentile_rank(null, seen, keys, "null_mean").drop("observed")
    return null.join(seen, keys).join(rank, keys)


def percentile_rank(dist: DataFrame, observed: DataFrame, keys: list[str], value: str,
                    stat: str = "observed") -> DataFrame:
    """Share of the distribution strictly below the observed statistic."""
    return (
        dist.join(observed.select(*keys, stat), keys).groupBy(*keys, stat)
        .agg(F.avg(F.when(F.col(value) < F.col(stat), 1.0).otherwise(0.0)).alias("rank"))
    )


def index_quantile(dist: DataFrame, keys: list[str], value: str, q: float = 0.95) -> DataFrame:
    """The element at sorted position min(n-1, int(q*n)); no interpolation.

    Equal values are counted first, so the ordered window sees distinct values only.
    """
    counts = dist.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    df = counts.withColumn("_n", F.sum("_m").over(w)).withColumn("_upto", upto)
    want = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    return df.where(F.col("_upto") > want).groupBy(*keys).agg(F.min(value).alias("quantile"))


def lookahead_leaks(series: Series, feature, columns: list[str], *, n_cutoffs: int = 8,
                    tol: float = 1e-12) -> DataFrame:
    """Rows whose feature value changes when later rows are cut off.

    The feature runs once over (series, cutoff) pairs: a fixed number of evenly spaced
    cutoffs, each with the rows up to it. A value that is missing on one side only is a leak.
    """
    from tapeworks.operators.series import index_series

    keys = list(series.keys)
    full = feature(series).df.select(*keys, "k", *[F.col(c).alias(f"_full_{c}") for c in columns])
    n = series.df.groupBy(*keys).agg(F.max("k").alias("_last"))
    cut = F.explode(F.array_distinct(F.array(*[
        F.floor(F.col("_last") * F.lit((i + 1) / n_cutoffs)) for i in range(n_cutoffs)])))
    part = series.df.join(n.withColumn("cutoff", cut).drop("_last"), keys).where(
        F.col("k") <= F.col("cutoff")).drop("k")
    again = index_series(part, (*keys, "cutoff"), rows_per_chunk=series.rows_per_chunk)
    cut_rows = feature(again).df.where(F.col("k") == F.col("cutoff"))
    both = cut_rows.join(full, [*keys, "k"])
    leak = F.lit(False)
    for c in columns:
        a, b = F.col(c), F.col(f"_full_{c}")
        same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(
            F.abs(a - b) <= F.greatest(F.lit(tol), F.abs(b) * 1e-9))
        leak = leak | ~same
    return both.select(*keys, "cutoff", leak.alias("leak"))


def random_baseline(spark, n: int, *, seed: int, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """Edgeless strategy: independent Gaussian pnl per trade."""
    return spark.range(n).select(
        F.col("id").alias("trade_no"), (F.randn(seed) * sd + mean).alias("pnl"))
