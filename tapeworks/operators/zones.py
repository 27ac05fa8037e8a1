"""Supply and demand zones from swing pivots.

A zone begins at a confirmed pivot, ends at the first later close beyond its price, and is fresh
until it was touched too often; a pivot near a live zone of its kind touches that zone instead of
beginning one. Only the last rule depends on other zones, so the work falls into parts:

1. *Search.* A pivot's breaking bar and first touching bars depend on its price alone. A pivot
   looks through its own block of bars; what it has not met there is sought in an index of the blocks'
   extremes, which names the next block worth a look. Each visit finds a touch or the break, so
   the number of visits is fixed.
2. *Choice.* Which pivots begin zones is decided per block of bars over pivots only. Blocks
   start with the zones that earlier blocks leave alive, blocks whose start turns out different are
   decided again until none is. The first wrong block is right after each round.
3. *Painting.* Each block of bars meets the zones that are fresh in it.

A series of one block is one task that does all three.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.indicators import swing_pivots
from tapeworks.operators.series import Series
from tapeworks.storage import materialize, renewed

SUPPORT, RESISTANCE = 1, -1
#: Bars of a block, and blocks whose pivots search together.
BLOCK, SEARCH = 4096, 64
NEVER = np.iinfo(np.int64).max
_PAINT = "near_support BOOLEAN, near_resistance BOOLEAN, n_support INT, n_resistance INT"
_PIVOT = "k BIGINT, kind INT, price DOUBLE, next BIGINT, touches ARRAY<BIGINT>, broken BIGINT"
_CHOSEN = "k BIGINT, kind INT, price DOUBLE, touches ARRAY<BIGINT>, broken BIGINT, zone_k BIGINT"


def _first(mask: np.ndarray) -> int:
    at = int(mask.argmax()) if len(mask) else 0
    return at if len(mask) and mask[at] else len(mask)


def look_through(bars: pd.DataFrame, price: float, kind: int, start: int, need: int, merge: float) -> tuple[list[int], int]:
    """Bars from ``start`` on that touch a zone, at most ``need``, and the bar that breaks it (or NEVER)."""
    k0 = int(bars["k"].iloc[0])
    close = bars["close"].to_numpy()[start - k0 :]
    end = _first((close - price) * kind < 0)
    side = bars["low" if kind == SUPPORT else "high"].to_numpy()[start - k0 :][:end]
    hit = side <= price + merge if kind == SUPPORT else side >= price - merge
    return (np.flatnonzero(hit)[:need] + start).tolist(), start + end if end < len(close) else NEVER


def choose(pivots: list[tuple], alive: list[tuple], merge: float) -> list[int]:
    """The zone of each pivot (k, kind, price, broken), in order; ``alive`` zones (k, kind, price,
    broken) come from earlier bars. The oldest live zone near enough takes the pivot."""
    zones = {SUPPORT: [], RESISTANCE: []}
    for z in sorted(alive):
        zones[z[1]].append(z)
    out = []
    for p in pivots:
        k, kind, price, _ = p
        live = zones[kind] = [z for z in zones[kind] if z[3] > k]
        near = next((z for z in live if abs(z[2] - price) <= merge), None)
        if near is None:
            live.append(p)
        out.append((near or p)[0])
    return out


def paint(bars: pd.DataFrame, zones: list[tuple], gate: float) -> dict[str, np.ndarray]:
    """Counts and nearness of fresh zones (kind, price, from, until) after each bar."""
    n, k0, close = len(bars), int(bars["k"].iloc[0]) if len(bars) else 0, bars["close"].to_numpy()
    out = {}
    for name, own in (("support", SUPPORT), ("resistance", RESISTANCE)):
        count, near = np.zeros(n, np.int32), np.zeros(n, bool)
        for kind, price, begin, until in zones:
            if kind == own:
                span = slice(max(begin - k0, 0), min(until - k0, n))
                count[span] += 1
                near[span] |= (close[span] - gate <= price) & (price <= close[span] + gate)
        out |= {f"near_{name}": near, f"n_{name}": count}
    return out


def _whole(bars: pd.DataFrame, merge: float, gate: float, max_touches: int) -> dict[str, np.ndarray]:
    """All three parts over one block."""
    pivots, events = [], {}
    for kind, col in ((RESISTANCE, "pivot_high"), (SUPPORT, "pivot_low")):
        for k, price in bars.loc[bars[col].notna(), ["k", col]].itertuples(index=False):
            touches, broken = look_through(bars, price, kind, int(k) + 1, max_touches, merge)
            pivots.append((int(k), kind, float(price), broken))
            events[int(k), kind] = touches
    pivots.sort(key=lambda p: p[0])
    for p, zone in zip(pivots, choose(pivots, [], merge)):
        if zone != p[0]:
            events[zone, p[1]].append(p[0])
            del events[p[0], p[1]]
    fresh = []
    for k, kind, price, broken in pivots:
        if (k, kind) in events:
            times = sorted(events[k, kind])
            fresh.append((kind, price, k, min(broken, times[max_touches - 1] if len(times) >= max_touches else NEVER)))
    return paint(bars, fresh, gate)


def _search(bars: DataFrame, pivots: DataFrame, keys: list[str], blocks: int, block: int, merge: float, max_touches: int) -> DataFrame:
    """Touches and breaking bars of all pivots."""
    schema = StructType([*(pivots.schema[c] for c in keys), *StructType.fromDDL(_PIVOT).fields])
    names, here = schema.names, [*keys, "_block", "_from"]
    edges = bars.groupBy(*keys, "_block").agg(*(f("close").alias(f"c{i}") for i, f in enumerate((F.min, F.max))), F.min("low").alias("low"), F.max("high").alias("high"))
    origin = F.floor(F.col("k") / (block * SEARCH))

    def visit(found: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", ignore_index=True)
        out = []
        for p in found.itertuples():
            touches = list(p.touches)
            more, broken = look_through(rows, p.price, p.kind, max(int(p.next), int(rows["k"].iloc[0])), max_touches - len(touches), merge) if len(rows) else ([], NEVER)
            after = (int(p.next) // block + 1) * block
            out.append((*(getattr(p, c) for c in keys), p.k, p.kind, p.price, after, touches + more, broken))
        return pd.DataFrame(out, columns=names)

    def jump(found: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        """The next block that holds a touch or the break; none: the pivot is done."""
        index = index.sort_values("_block")
        ids, out = index["_block"].to_numpy(), []
        c0, c1, low, high = (index[c].to_numpy() for c in ("c0", "c1", "low", "high"))
        for p in found.itertuples():
            i = int(np.searchsorted(ids, p.next // block))
            short = len(p.touches) < max_touches
            if p.kind == SUPPORT:
                worth = (c0[i:] < p.price) | (short & (low[i:] <= p.price + merge))
            else:
                worth = (c1[i:] > p.price) | (short & (high[i:] >= p.price - merge))
            i += _first(worth)
            out.append(int(ids[i]) * block if i < len(ids) else NEVER)
        return found.assign(next=out)[names]

    done, now = None, pivots
    for _ in range(max_touches + 2):
        asked = now.withColumns({"_block": F.floor(F.col("next") / block), "_from": origin})
        wanted = asked.select(*here).distinct()
        seen = asked.groupBy(*here).cogroup(renewed(bars.join(wanted, [*keys, "_block"])).groupBy(*here)).applyInPandas(visit, schema)
        if blocks == 1:
            return seen
        seen = materialize(seen)
        ended = seen.where(F.col("broken") != NEVER)
        left = seen.where(F.col("broken") == NEVER).withColumn("_from", origin)
        froms = left.select(*keys, "_from").distinct()
        ahead = materialize(left.groupBy(*keys, "_from").cogroup(renewed(edges.join(froms, keys)).groupBy(*keys, "_from")).applyInPandas(jump, schema))
        ended = ended.union(ahead.where(F.col("next") == NEVER))
        done = ended if done is None else done.union(ended)
        now = ahead.where(F.col("next") != NEVER)
        if now.isEmpty():
            return done
    raise RuntimeError("a zone search visited more blocks than it has events")


def _choose(found: DataFrame, keys: list[str], block: int, merge: float) -> DataFrame:
    """The zone of every pivot."""
    at = [*keys, "_block"]
    schema = StructType([*(found.schema[c] for c in keys), *StructType.fromDDL("_block BIGINT, " + _CHOSEN).fields])
    pivots = materialize(found.drop("next").withColumn("_block", F.floor(F.col("k") / block)))
    cols = ["k", "kind", "price", "broken"]

    def decide(rows: pd.DataFrame, alive: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", kind="stable", ignore_index=True)
        tuples = [list(df[cols].itertuples(index=False, name=None)) for df in (rows, alive)]
        return rows.assign(zone_k=choose(*tuples, merge))[schema.names]

    def standing(chosen: DataFrame) -> DataFrame:
        """Zones alive at the start of later blocks; those alive at once are apart, so a block has few."""
        zones = chosen.where("zone_k = k")
        until = F.when(F.col("broken") == NEVER, F.col("_last")).otherwise(F.floor(F.col("broken") / block))
        ends = pivots.groupBy(*keys).agg(F.max("_block").alias("_last"))
        zones = zones.join(ends, keys).withColumn("_to", F.least(until, F.col("_last")))
        return zones.where(F.col("_to") > F.col("_block")).withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, F.col("_to")))).select(*at, *cols)

    def marks(alive: DataFrame) -> DataFrame:
        h = F.xxhash64("k", "kind")
        return alive.groupBy(*at).agg(F.count("*").alias("_n"), F.sum(F.shiftright(h, 20)).alias("_sum"), F.bit_xor(h).alias("_xor"))

    nobody = renewed(pivots.limit(0).select(*at, *cols))
    chosen = materialize(pivots.groupBy(*at).cogroup(nobody.groupBy(*at)).applyInPandas(decide, schema))
    known = materialize(marks(nobody))
    while True:
        alive = materialize(standing(chosen))
        told = materialize(marks(alive))
        changed = materialize(told.exceptAll(known).select(*at).union(known.exceptAll(told).select(*at)).distinct().join(pivots.select(*at).distinct(), at, "left_semi"))
        if changed.isEmpty():
            return chosen
        again = pivots.join(changed, at, "left_semi").groupBy(*at).cogroup(renewed(alive.join(changed, at, "left_semi")).groupBy(*at)).applyInPandas(decide, schema)
        chosen, known = materialize(chosen.join(changed, at, "left_anti").union(again)), told


def _lives(chosen: DataFrame, keys: list[str], max_touches: int) -> DataFrame:
    """(keys, kind, price, begin, until) of every zone while it is fresh."""
    zone = [*keys, "kind", "zone_k"]
    order = F.row_number().over(Window.partitionBy(*zone).orderBy("k"))
    merged = chosen.where("zone_k <> k").withColumn("_r", order).where(F.col("_r") <= max_touches)
    merged = merged.groupBy(*zone).agg(F.collect_list("k").alias("_merged"))  # at most max_touches
    zones = chosen.where("zone_k = k").join(merged, zone, "left")
    times = F.array_sort(F.concat("touches", F.coalesce("_merged", F.array().cast("array<bigint>"))))
    worn = F.coalesce(F.get(times, F.lit(max_touches - 1)), F.lit(int(NEVER)))
    return zones.select(*keys, "kind", "price", F.col("k").alias("begin"), F.least("broken", worn).alias("until"))


def zone_proximity(series: Series, *, pip_size: float, left: int = 5, right: int = 5,
                   merge_pips: float = 10.0, max_touches: int = 3,
                   gate_pips: float = 150.0, block: int = BLOCK) -> Series:
    """Adds near_support, near_resistance and the counts of fresh zones after each bar."""
    if left < 1 or right < 1 or pip_size <= 0 or max_touches < 1:
        raise ValueError("left, right, max_touches >= 1 and pip_size > 0 required")
    s = swing_pivots(series, left, right)
    merge, gate = merge_pips * pip_size, gate_pips * pip_size
    keys, names = list(s.keys), [*s.df.columns, *(c.split()[0] for c in _PAINT.split(", "))]
    schema = StructType([*s.df.schema.fields, *StructType.fromDDL(_PAINT).fields])
    blocks = -(-s.max_rows // block)
    if blocks == 1:
        def alone(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k", ignore_index=True)
            return pdf.assign(**_whole(pdf, merge, gate, max_touches))[names]

        return s.with_df(s.df.groupBy(*keys).applyInPandas(alone, schema))

    s = s.settle()
    rows = s.df.withColumn("_block", F.floor(F.col("k") / block))
    bars = rows.select(*keys, "_block", "k", "high", "low", "close")
    sides = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("price")) for kind, c in ((RESISTANCE, "pivot_high"), (SUPPORT, "pivot_low"))))
    pivots = s.df.where("pivot_high IS NOT NULL OR pivot_low IS NOT NULL").select(*keys, "k", F.explode(sides).alias("_p")).where("_p.price IS NOT NULL").select(
        *keys, "k", "_p.kind", "_p.price", (F.col("k") + 1).alias("next"), F.array().cast("array<bigint>").alias("touches"), F.lit(int(NEVER)).alias("broken"))
    lives = _lives(_choose(_search(bars, pivots, keys, blocks, block, merge, max_touches), keys, block, merge), keys, max_touches)
    last = F.least(F.col("until") - 1, F.lit(s.max_rows - 1))
    shown = lives.where(F.col("until") > F.col("begin")).withColumn("_block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor(last / block))))
    at = [*keys, "_block"]

    def painted(pdf: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        own = list(zones[["kind", "price", "begin", "until"]].itertuples(index=False, name=None))
        return pdf.assign(**paint(pdf, own, gate))[names]

    return s.with_df(rows.groupBy(*at).cogroup(renewed(shown).groupBy(*at)).applyInPandas(painted, schema)).settle()


def zone_freshness(touches, broken, max_touches: int):
    """Not broken and not tested too often."""
    return ~F.coalesce(broken, F.lit(False)) & (touches <= max_touches)
