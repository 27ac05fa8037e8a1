"""Time-aware joins as equi joins and windows. No cross joins, no unbounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.series import index_series
from tapeworks.storage import materialize


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], *, values: list[str],
                  prefix: str, on_close_seconds: int = 0,
                  bucket_seconds: int = 30 * 86_400) -> DataFrame:
    """Latest right row with ts (+ ``on_close_seconds``) <= the left row's ts, per key."""
    return asof_many(left, [(right, prefix, values, on_close_seconds)], keys,
                     bucket_seconds=bucket_seconds)


def asof_many(left: DataFrame, rights: list[tuple[DataFrame, str, list[str], int]],
              keys: list[str], *, bucket_seconds: int = 30 * 86_400) -> DataFrame:
    """As-of match of one left side against several right sides in one union and one window.

    Each right side is (frame with ts, output prefix, value columns, seconds after ts at which
    a row becomes visible). The window is split by time so that a long key is not one task: the last right row of every bucket is one summary row, and a running
    last over those summaries answers left rows that precede their bucket's first right row.
    """
    lcols = [c for c in left.columns if c not in keys]
    pays = [(f"_v{i}", r, prefix, values, wait) for i, (r, prefix, values, wait) in enumerate(rights)]
    typed = {n: r.select(F.struct("ts", *v).alias("x")).schema["x"].dataType
             for n, r, _, v, _ in pays}
    ltype = left.select(F.struct(*lcols).alias("x")).schema["x"].dataType

    def empty(name: str) -> Column:
        return F.lit(None).cast(typed[name]).alias(name)

    both = left.select(*keys, F.unix_micros("ts").alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*lcols).alias("_l"), *[empty(n) for n in typed])
    for name, r, _, v, wait in pays:
        both = both.unionByName(r.select(
            *keys, (F.unix_micros("ts") + wait * 1_000_000).alias("_t"), F.lit(0).alias("_side"),
            F.lit(None).cast(ltype).alias("_l"),
            *[F.struct("ts", *v).alias(n) if n == name else empty(n) for n in typed]))
    part = [*keys, "_b"]
    both = materialize(both.withColumn("_b", F.floor(F.col("_t") / (bucket_seconds * 1_000_000))))
    run = (
        Window.partitionBy(*part).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    out = both.withColumns(
        {n: F.last(n, ignorenulls=True).over(run) for n in typed}).where("_side = 1")
    before = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    at = {n: F.when(F.col(n).isNotNull(), F.col("_t")) for n in typed}
    carry = both.groupBy(*part).agg(
        *[F.max_by(n, at[n]).alias(n) for n in typed]
    ).select(*part, *[F.last(n, ignorenulls=True).over(before).alias(f"_c{n}") for n in typed])
    out = out.join(carry, part, "left").withColumns(
        {n: F.coalesce(n, f"_c{n}") for n in typed})
    picked = []
    for name, _, prefix, v, _ in pays:
        picked += [F.col(f"{name}.{c}").alias(f"{prefix}{c}") for c in ("ts", *v)]
    return out.select(*keys, "_l.*", *picked)


def next_event(left: DataFrame, events: DataFrame, *, left_ts: str = "ts",
               event_ts: str = "event_ts", values: list[str],
               bucket_seconds: int = 86_400) -> DataFrame:
    """Earliest event strictly later than left_ts (one calendar for all rows).

    Each event owns the half-open span since its predecessor. Spans are listed once per time
    bucket they touch, so a row meets its event by an equi join on the bucket; buckets number
    at most the calendar's days plus its events, and a busy bucket is split by AQE's skew join.
    """
    size = bucket_seconds * 1_000_000
    ev = (
        events.select(F.unix_micros(event_ts).alias("_e"), F.struct(F.col(event_ts).alias("ts"), *values).alias("_v"))
        .groupBy("_e").agg(F.min("_v").alias("_v")).withColumn("_all", F.lit(0))
    )
    s = index_series(ev, ("_all",), order="_e", bucket=F.floor(F.col("_e") / size))
    ev = s.windowed(lambda w: {"_prev": F.lag("_e").over(w)}, back=1).df
    start = left.agg(F.min(F.unix_micros(left_ts))).scalar()
    ev = ev.withColumn("_from", F.coalesce("_prev", F.least(start, F.col("_e") - 1)))
    spans = ev.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_from") / size), F.floor((F.col("_e") - 1) / size)))).select("_b", "_from", "_e", "_v")
    rows = left.withColumn("_t", F.unix_micros(left_ts)).withColumn("_b", F.floor(F.col("_t") / size))
    hit = (rows["_b"] == spans["_b"]) & (rows["_t"] >= spans["_from"]) & (rows["_t"] < spans["_e"])
    return rows.join(spans, hit, "left").select(
        *[rows[c] for c in left.columns], F.col("_v.ts").alias("next_ts"),
        *[F.col(f"_v.{v}").alias(f"next_{v}") for v in values])


def bars_in_parent(child: DataFrame, parent: DataFrame, keys: list[str],
                   *, parent_seconds: int) -> DataFrame:
    """Child bars with previous parent ts < child ts <= parent ts.

    Parents sit on an epoch-aligned grid. A parent claims the grid cells between its
    predecessor and itself, so the join is an equi join on the cell with no residual.
    """
    step = parent_seconds * 1_000_000
    w = Window.partitionBy(*keys).orderBy("ts")
    p = parent.select(
        *keys, F.col("ts").alias("parent_ts"), F.lag("ts").over(w).alias("prev_parent_ts")
    ).where(F.col("prev_parent_ts").isNotNull())
    first = F.floor(F.unix_micros("prev_parent_ts") / step) + 1
    last = F.floor(F.unix_micros("parent_ts") / step)
    cells = p.withColumn("_cell", F.explode(F.sequence(first, last)))
    at = F.unix_micros("ts")
    c = child.withColumn("_cell", F.ceil(at / step))
    return c.join(cells, [*keys, "_cell"]).drop("_cell")


def blackout(rows: DataFrame, events: DataFrame, *, ts: str = "ts", event_ts: str = "event_ts",
             before_seconds: int = 1800, after_seconds: int = 900, how: str = "left_semi"
             ) -> DataFrame:
    """Rows inside (left_semi) or outside (left_anti) any event's closed window.

    Equi join on a grid cell as wide as the window: a window touches at most two cells, so each
    event is listed twice and each row once, whatever the number of events.
    """
    cell = (before_seconds + after_seconds) * 1_000_000
    at = F.unix_micros(event_ts)
    lo, hi = at - before_seconds * 1_000_000, at + after_seconds * 1_000_000
    e = events.select(lo.alias("_lo"), hi.alias("_hi")).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor(F.col("_hi") / cell))))
    r = rows.withColumn("_t", F.unix_micros(ts)).withColumn("_cell", F.floor(F.col("_t") / cell))
    hit = (r["_cell"] == e["_cell"]) & (r["_t"] >= e["_lo"]) & (r["_t"] <= e["_hi"])
    return r.join(e, hit, how).drop("_t", "_cell")


def with_blackout(rows: DataFrame, events: DataFrame, *, ts: str = "ts", event_ts: str = "event_ts",
                  before_seconds: int = 1800, after_seconds: int = 900) -> DataFrame:
    """``rows`` with blocked, true inside any event's closed window: one pass over either side.

    Grid cells are as long as a window. So in a cell the windows that reach in from the left cover
    it up to the furthest of their ends, and those that begin inside cover it from the first of
    their beginnings: two instants say all, and every row meets one row of its cell.
    """
    cell = (before_seconds + after_seconds) * 1_000_000
    at = F.unix_micros(event_ts)
    e = events.select((at - before_seconds * 1_000_000).alias("_lo"), (at + after_seconds * 1_000_000).alias("_hi")).distinct()
    e = e.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor(F.col("_hi") / cell))))
    # windows have the length of a cell: those that reach in from the left and those that begin inside
    left = F.col("_lo") < F.col("_cell") * cell
    e = e.groupBy("_cell").agg(F.max(F.when(left, F.col("_hi"))).alias("_until"), F.min(F.when(~left, F.col("_lo"))).alias("_from"))
    r = rows.withColumn("_t", F.unix_micros(ts)).withColumn("_cell", F.floor(F.col("_t") / cell))
    hit = (F.col("_t") <= F.col("_until")) | (F.col("_t") >= F.col("_from"))
    return r.join(e, "_cell", "left").select(*[r[c] for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("blocked"))


def triple_barrier(entries: DataFrame, bars: DataFrame, keys: list[str], *, horizon: int = 24,
                   pip: float = 0.1) -> DataFrame:
    """First of stop or target within the next ``horizon`` bars; the stop wins inside a bar.

    Entries carry k, direction, entry, sl, tp; bars carry k, ts, high, low. Cells of
    ``horizon`` positions make it an equi join: an entry looks at two cells at most.
    """
    e = entries.withColumn("_cell", F.explode(F.sequence(
        F.floor((F.col("k") + 1) / horizon), F.floor((F.col("k") + horizon) / horizon))))
    b = bars.select(
        *keys, F.col("k").alias("_bk"), F.col("ts").alias("_bts"), F.col("high").alias("_h"),
        F.col("low").alias("_w"), F.floor(F.col("k") / horizon).alias("_cell"))
    long = F.col("direction") == "LONG"
    stop = F.when(long, F.col("_w") <= F.col("sl")).otherwise(F.col("_h") >= F.col("sl"))
    goal = F.when(long, F.col("_h") >= F.col("tp")).otherwise(F.col("_w") <= F.col("tp"))
    hit = F.when(stop, "SL").when(goal, "TP")
    live = (F.col("_bk") > F.col("k")) & (F.col("_bk") <= F.col("k") + horizon)
    ent = [c for c in entries.columns if c not in keys]
    first = (
        e.join(b, [*keys, "_cell"]).where(live & hit.isNotNull())
        .groupBy(*keys, "k", "direction")
        .agg(F.min_by(F.struct(hit.alias("outcome"), F.col("_bts").alias("exit_ts")), "_bk")
             .alias("_x"))
    )
    out = entries.join(first, [*keys, "k", "direction"], "left")
    risk = F.abs(F.col("entry") - F.col("sl")) / pip
    reward = F.abs(F.col("tp") - F.col("entry")) / pip
    outcome = F.coalesce(F.col("_x.outcome"), F.lit("OPEN"))
    return out.select(
        *keys, *ent, outcome.alias("outcome"), F.col("_x.exit_ts").alias("exit_ts"),
        F.when(outcome == "SL", -risk).when(outcome == "TP", reward).otherwise(0.0)
        .alias("pnl_pips"),
    )


def lookup(df: DataFrame, dim: DataFrame, on: str, *, required: str) -> DataFrame:
    """Dimension join that fails on a miss; ``required`` is a non-null column of ``dim``."""
    out = df.join(dim, on, "left")
    miss = F.assert_true(F.col(required).isNotNull(), F.concat(F.lit("unknown "), F.col(on)))
    return out.where(miss.isNull())


def last_rows_before(rows: DataFrame, k_limit: Column, keys: list[str], n: int) -> DataFrame:
    """The n rows with k in (limit-n, limit], for a dense position k."""
    return rows.where((F.col("k") <= k_limit) & (F.col("k") > k_limit - n))
