"""Daily loss governor and repeat suppression over ordered records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tapeworks.operators.series import ROWS_PER_CHUNK, index_series
from tapeworks.storage import materialize, renewed


def daily_ledger(fills: DataFrame, keys: list[str], order: list[str], *, r: str = "pnl_r",
                 max_loss_r: float = 3.0, max_trades: int = 6) -> DataFrame:
    """Per (keys, trading_day): realised R and trades until the halt, ignored fills, reason.

    A day halts at ``max_trades`` fills at the latest, so only its first max_trades rows can
    matter. They are picked by a row-number limit, which Spark applies before the shuffle as
    well as after it; the rest of the day is only counted.
    """
    day = [*keys, "trading_day"]
    w = Window.partitionBy(*day).orderBy(*order)
    head = fills.select(*day, *order, F.col(r).alias("_r")).withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= max_trades)
    run = Window.partitionBy(*day).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("_sum", F.sum("_r").over(run))
    lost = F.col("_sum") <= -max_loss_r
    trip = F.min(F.when(lost | (F.col("_n") >= max_trades), F.col("_n")))
    head = head.withColumn("_trip", trip.over(Window.partitionBy(*day)))
    live = F.col("_trip").isNull() | (F.col("_n") <= F.col("_trip"))
    used = head.where(live).groupBy(*day).agg(
        F.max_by("_sum", "_n").alias("realized_r"), F.max("_n").cast("bigint").alias("trades"),
        F.max(F.col("_trip").isNotNull()).alias("halted"))
    total = fills.groupBy(*day).agg(F.count(F.lit(1)).alias("_all"))
    return used.join(total, day).select(
        *day, "realized_r", "trades", "halted", (F.col("_all") - F.col("trades")).alias("ignored"),
        F.when(F.col("halted") & (F.col("realized_r") <= -max_loss_r), "daily loss limit")
        .when(F.col("halted"), "max daily trades").alias("halt_reason"))


def _chain_ends(us: np.ndarray, width: int) -> np.ndarray:
    """For every row the last row accepted in this chunk if it is accepted itself."""
    nxt = np.searchsorted(us, us + width)
    end = np.where(nxt < len(us), nxt, np.arange(len(us)))
    while True:  # jumps double
        further = end[end]
        if (further == end).all():
            return end
        end = further


def _accepted(us: np.ndarray, first: int, width: int) -> np.ndarray:
    ok = np.zeros(len(us), bool)
    while first < len(us):
        ok[first] = True
        first = int(np.searchsorted(us, us[first] + width))
    return ok


def suppress_repeats(rows: DataFrame, keys: list[str], ts: str = "ts", *, window_seconds: int = 3600,
                     out: str = "accepted", tie: str | None = None,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Accept a row unless the last *accepted* row of its key is younger than the window.

    A row's successor is the first row a window later; the accepted rows are those that successors
    reach from a key's first row. Chunks of a long key are worked on apart: every row at which a chain may
    enter a chunk learns where that chain enters a later one, jumps between entries are doubled, and
    doubling also marks the entries that are reached, in as many rounds as the number of chunks
    has binary digits. Of rows at one instant the first by ``tie`` counts.
    """
    s = index_series(rows, tuple(keys), order=ts, tie=tie, rows_per_chunk=rows_per_chunk)
    width, cols = window_seconds * 1_000_000, rows.columns
    df = s.df.withColumn("_us", F.unix_micros(ts))
    schema = StructType([*rows.schema.fields, StructField(out, BooleanType())])

    def mark(pdf: pd.DataFrame, entry: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        first = 0 if entry is None else int(entry["entry"].iloc[0] - pdf["k"].iloc[0]) if len(entry) else len(pdf)
        return pdf[cols].assign(**{out: _accepted(pdf["_us"].to_numpy(), first, width)})[schema.names]

    if not s.chunked:
        return df.groupBy(*keys).applyInPandas(lambda pdf: mark(pdf), schema)

    df = materialize(df.withColumn("_chunk", F.floor(F.col("k") / rows_per_chunk)))
    at = [*keys, "_chunk"]
    reached = _entries(df.select(*at, "k", "_us"), keys, width, -(-s.max_rows // rows_per_chunk))
    return df.groupBy(*at).cogroup(reached.groupBy(*at)).applyInPandas(mark, schema)


def _entries(df: DataFrame, keys: list[str], width: int, chunks: int) -> DataFrame:
    """(keys, _chunk, entry): the first accepted row of each chunk that has one."""
    at, key_fields = [*keys, "_chunk"], [df.schema[c] for c in keys]
    node = StructType([*key_fields, *StructType.fromDDL("_chunk BIGINT, entry BIGINT, us BIGINT, leaves BIGINT").fields])

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows at which a chain may enter: up to the first one a window after the chunk's beginning."""
        pdf = pdf.sort_values("k", ignore_index=True)
        us = pdf["_us"].to_numpy()
        n = min(len(us), int(np.searchsorted(us, us[0] + width)) + 1)
        leaves = us[_chain_ends(us, width)[:n]] + width
        return pdf.iloc[:n][at].assign(entry=pdf["k"].iloc[:n], us=us[:n], leaves=leaves)[node.names]

    nodes = materialize(df.groupBy(*at).applyInPandas(candidates, node))
    ends = df.groupBy(*at).agg(F.max("_us").alias("_end"))
    hop = StructType([*node.fields, *StructType.fromDDL("_to BIGINT").fields])

    def aim(pdf: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        """The chunk where the chain goes on: the first one that ends late enough."""
        index = index.sort_values("_to")
        place = np.searchsorted(index["_end"].to_numpy(), pdf["leaves"].to_numpy())
        pdf, place = pdf[place < len(index)], place[place < len(index)]
        return pdf.assign(_to=index["_to"].to_numpy()[place])[hop.names]

    own = nodes.select(*at).distinct()
    every = own.join(ends.withColumnRenamed("_chunk", "_to"), keys)
    aimed = nodes.groupBy(*at).cogroup(renewed(every).groupBy(*at)).applyInPandas(aim, hop)
    step = StructType([*key_fields, *StructType.fromDDL("entry BIGINT, goal BIGINT, _chunk BIGINT").fields])

    def land(pdf: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("entry")
        place = np.searchsorted(there["us"].to_numpy(), pdf["leaves"].to_numpy())
        return pdf.assign(goal=there["entry"].to_numpy()[place], _chunk=pdf["_to"])[step.names]

    to = [*keys, "_to"]
    jumps = materialize(aimed.groupBy(*to).cogroup(renewed(nodes.withColumnRenamed("_chunk", "_to")).groupBy(*to)).applyInPandas(land, step))
    first = nodes.where("entry = 0").select(*at, "entry")
    levels = [jumps]
    while 1 << len(levels) < chunks:
        one = levels[-1]
        two = one.select(*keys, F.col("entry").alias("goal"), F.col("goal").alias("_further"), F.col("_chunk").alias("_there"))
        levels.append(materialize(one.select(*keys, "entry", "goal").join(two, [*keys, "goal"]).select(
            *keys, "entry", F.col("_further").alias("goal"), F.col("_there").alias("_chunk"))))
    reached = first
    for level in reversed(levels):
        more = reached.select(*keys, "entry").join(level, [*keys, "entry"]).select(*at, F.col("goal").alias("entry"))
        reached = materialize(reached.union(more))
    return reached


def external_signals(parsed: DataFrame, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Parsed external messages that count: real signals above LOW confidence, first per hour
    and (symbol, direction), with reward over risk."""
    kept = parsed.where(F.col("is_signal") & (F.coalesce(F.col("confidence"), F.lit("LOW")) != "LOW"))
    kept = kept.withColumns({
        "symbol": F.upper(F.coalesce("symbol", F.lit("UNKNOWN"))),
        "direction": F.upper(F.coalesce("direction", F.lit("UNKNOWN")))})
    out = suppress_repeats(kept, ["symbol", "direction"], ts, tie=tie).where("accepted").drop("accepted")
    return out.withColumn("rr", _rr(F.col("entry"), F.col("sl"), F.col("tp")))


def _rr(entry: Column, sl: Column, tp: Column) -> Column:
    risk = F.abs(entry - sl)
    return F.when(risk > 0, F.abs(tp - entry) / risk)
