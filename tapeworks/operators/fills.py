"""Trades whose exits depend on the open position.

Every execution style shares one selection: enter at a candidate row while flat, leave at the
first later row that stops, reaches its target, expires or is told to leave, and only then
look for the next candidate. Which candidates trade depends on earlier choices. Series are cut
into chunks that run in parallel as if they began flat; chunks whose predecessor turns out to
hand over an open position run again with it, until no hand-over changes. The first wrong
chunk is right after each round, so this ends, usually after two or three rounds because
positions close. Fills are columns that windows attached beforehand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from tapeworks.functions.costs import CostTerms, round_trip_currency
from tapeworks.operators.series import Series
from tapeworks.storage import materialize

_BLOCK = 512


class _Walk:
    """Open position of one series and the batch search that moves it forward."""

    def __init__(self, payload: list[str], max_hold: int | None, reenter: bool) -> None:
        self.payload, self.max_hold, self.reenter = payload, max_hold, reenter
        self.open: dict | None = None

    def feed(self, b: dict[str, np.ndarray], out: list[tuple]) -> None:
        n = len(b["side"])
        cand = np.flatnonzero(b["side"] != 0)
        i = 0
        while i < n:
            if self.open is None:
                at = np.searchsorted(cand, i)
                if at == len(cand):
                    return
                j = cand[at]
                self.open = {"side": b["side"][j], "sl": b["sl"][j], "tp": b["tp"][j], "held": 0,
                             "entry": tuple(b[c][j] for c in self.payload)}
                i = j + 1
                continue
            j, kind = self._leave(b, i, n)
            if kind is None:
                return
            p = self.open
            out.append((p["side"], p["sl"], p["tp"], kind, p["held"], *p["entry"],
                        *[b[c][j] for c in self.payload]))
            self.open = None
            if self.reenter and b["side"][j] != 0 and kind in ("EXPIRED", "SIGNAL"):
                i = j
            else:
                i = j + 1

    def _leave(self, b: dict[str, np.ndarray], i: int, n: int):
        p = self.open
        up = p["side"] > 0
        while i < n:
            e = min(n, i + _BLOCK)
            hi, lo = b["high"][i:e], b["low"][i:e]
            with np.errstate(invalid="ignore"):
                stop = lo <= p["sl"] if up else hi >= p["sl"]
                goal = hi >= p["tp"] if up else lo <= p["tp"]
            told = b["exit_long" if up else "exit_short"][i:e]
            ticks = p["held"] + np.cumsum(b["counts"][i:e])
            late = (
                b["decides"][i:e] & (ticks >= self.max_hold)
                if self.max_hold is not None else np.zeros(e - i, bool)
            )
            any_ = stop | goal | late | told
            if any_.any():
                r = int(np.argmax(any_))
                kind = ("SL" if stop[r] else "TP" if goal[r] else "EXPIRED" if late[r]
                        else "SIGNAL")
                p["held"] = int(ticks[r])
                return i + r, kind
            p["held"] = int(ticks[-1])
            i = e
        return n, None


def select_trades(rows: DataFrame, keys: list[str], order: list[str], payload: list[str], *,
                  chunk: Column, max_hold: int | None = None, reenter: bool = False, one_chunk: bool = False) -> DataFrame:
    """Non-overlapping trades of each series.

    Rows need side (+1/-1/0), sl, tp, high, low, exit_long, exit_short and optionally counts
    (bars that age a position) and decides (rows on which expiry is checked). Gives direction,
    sl, tp, exit_kind, held and entry_*/exit_* for every payload column. ``chunk``, monotone in
    ``order``, cuts series into pieces that are walked in parallel, whatever their length;
    ``one_chunk`` says that every series is known to be a single piece.
    """
    df = rows
    for name, value in (("counts", F.lit(1)), ("decides", F.lit(True))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    use = ["side", "sl", "tp", "high", "low", "exit_long", "exit_short", "counts", "decides"]
    inner = [f"_p_{c}" for c in payload]
    df = df.select(*keys, F.floor(chunk).cast("bigint").alias("_chunk"), *order, *use, *[F.col(c).alias(i) for c, i in zip(payload, inner)])
    fields = {f.name: f.dataType for f in rows.schema.fields}
    key_fields = [StructField(k, fields[k]) for k in keys]
    trade_fields = (
        StructType.fromDDL("direction STRING, sl DOUBLE, tp DOUBLE, exit_kind STRING, held BIGINT").fields
        + [StructField(f"{s}_{c}", fields[c]) for s in ("entry", "exit") for c in payload]
    )
    walk = _Feeder(inner, max_hold, reenter)
    state = [StructField(n, t) for n, t in zip(
        ["side", "sl", "tp", "held", *inner],
        [IntegerType(), DoubleType(), DoubleType(), LongType(), *[fields[c] for c in payload]])]
    return _speculate(df, keys, order, walk, key_fields, trade_fields, state, one_chunk)


class _Feeder:
    """Pandas body of the walk over one chunk, from a state."""

    def __init__(self, inner: list[str], max_hold: int | None, reenter: bool) -> None:
        self.inner, self.max_hold, self.reenter = inner, max_hold, reenter

    def new(self) -> _Walk:
        return _Walk(self.inner, self.max_hold, self.reenter)

    def feed(self, walk: _Walk, part: pd.DataFrame) -> list[tuple]:
        arrays = {c: part[c].to_numpy(float) for c in ("sl", "tp", "high", "low")}
        arrays |= {c: part[c].to_numpy(int) for c in ("side", "counts")}
        arrays |= {c: part[c].to_numpy(bool) for c in ("exit_long", "exit_short", "decides")}
        arrays |= {c: part[c].to_numpy() for c in self.inner}
        found: list[tuple] = []
        walk.feed(arrays, found)
        return [("LONG" if t[0] > 0 else "SHORT", *t[1:]) for t in found]

    def chunk(self, order: list[str], trade_names: list[str]):
        """(key, rows, incoming state) -> trades, plus one row with the states in and out."""
        n_trade, n_state = len(trade_names), 4 + len(self.inner)

        def run(key: tuple, pdf: pd.DataFrame, given: pd.DataFrame, names: list[str]) -> pd.DataFrame:
            walk, was = self.new(), (0, None, None, 0, *[None] * len(self.inner))
            if len(given) and given["side"].iloc[0] != 0:
                was = tuple(given[c].iloc[0] for c in ("side", "sl", "tp", "held", *self.inner))
                walk.open = {"side": was[0], "sl": float(was[1]), "tp": float(was[2]),
                             "held": int(was[3]), "entry": was[4:]}
            trades = self.feed(walk, pdf.sort_values(order, ignore_index=True))
            p = walk.open
            end = (0, None, None, 0, *[None] * len(self.inner))
            if p is not None:
                end = (int(p["side"]), p["sl"], p["tp"], int(p["held"]), *p["entry"])
            rows = [(*key, False, *t, *[None] * (2 * n_state)) for t in trades]
            rows.append((*key, True, *[None] * n_trade, *was, *end))
            return pd.DataFrame(rows, columns=names)

        return run


def _speculate(df: DataFrame, keys: list[str], order: list[str], walk: _Feeder,
               key_fields: list, trade_fields: list, state: list, one_chunk: bool) -> DataFrame:
    """Run chunks from a flat start, then re-run those whose incoming state was wrong.

    A round writes the chunks that it ran and one state row for each chunk; what earlier rounds
    wrote stays, and the last round that ran a chunk counts.
    """
    at = [*keys, "_chunk"]
    schema = StructType(
        [*key_fields, StructField("_chunk", LongType()), StructField("_is_state", BooleanType()),
         *trade_fields,
         *[StructField(f"_{io}_{f.name}", f.dataType) for io in ("in", "out") for f in state]])
    body, names = walk.chunk(order, [f.name for f in trade_fields]), schema.names
    trades, marks = [f.name for f in trade_fields], [c for c in names if c.startswith(("_in_", "_out_"))]
    nothing = pd.DataFrame({"side": []})
    run = lambda rows: rows.groupBy(*at).applyInPandas(lambda key, pdf: body(key, pdf, nothing, names), schema)
    if one_chunk:
        return run(df).where(~F.col("_is_state")).select(*keys, *trades)
    rows = materialize(df)
    rounds = [materialize(run(rows))]
    states = rounds[0].where("_is_state").select(*at, *marks)
    while True:
        w = Window.partitionBy(*keys).orderBy("_chunk")
        wanted = states.withColumns({f"_want_{f.name}": F.lag(f"_out_{f.name}").over(w) for f in state})
        wanted = wanted.withColumn("_want_side", F.coalesce("_want_side", F.lit(0)))
        same = F.lit(True)
        for f in state:
            same = same & F.col(f"_want_{f.name}").eqNullSafe(F.col(f"_in_{f.name}"))
        flat = (F.col("_want_side") == 0) & (F.col("_in_side") == 0)
        wrong = materialize(wanted.where(~(flat | same)).select(
            *at, *[F.col(f"_want_{f.name}").alias(f.name) for f in state]))
        if wrong.isEmpty():
            break
        again = rows.join(wrong.select(*at), at, "left_semi").groupBy(*at).cogroup(
            wrong.groupBy(*at)).applyInPandas(
                lambda key, pdf, given: body(key, pdf, given, names), schema)
        rounds.append(materialize(again))
        states = materialize(states.join(wrong.select(*at), at, "left_anti").unionByName(
            rounds[-1].where("_is_state").select(*at, *marks)))
    done, later = None, None
    for table in reversed(rounds):
        kept = table.where(~F.col("_is_state")).select(*at, *trades)
        done = kept if done is None else done.union(kept.join(later, at, "left_anti"))
        ran = table.where("_is_state").select(*at)
        later = ran if later is None else later.union(ran).distinct()
    return done.select(*keys, *trades)


def _side() -> Column:
    return F.when(F.col("signal") == "LONG", 1).when(F.col("signal") == "SHORT", -1).otherwise(0)


def _never() -> Column:
    return F.lit(False)


def _cut(s: Series) -> Column:
    return F.col("k") / s.rows_per_chunk


def engine_trades(series: Series, *, terms: CostTerms, pip_size: float, lots: float = 1.0,
                  exit_long: Column | None = None, exit_short: Column | None = None,
                  atr_col: str = "atr", session: str | None = None) -> DataFrame:
    """Position-aware rule filled at the next bar's open; the last bar closes at its close."""
    s = series.windowed(
        lambda w: {"_open": F.lead("open").over(w), "_ts": F.lead("ts").over(w)}, ahead=1)
    last = F.col("_open").isNull()
    rows = s.df.withColumns({
        "side": F.when(last, 0).otherwise(_side()),
        "exit_long": F.coalesce(exit_long, _never()) | last if exit_long is not None else last,
        "exit_short": F.coalesce(exit_short, _never()) | last if exit_short is not None else last,
        "fill": F.coalesce("_open", "close"), "fill_ts": F.coalesce("_ts", "ts"),
        "fill_atr": F.col(atr_col),
    })
    keys = list(s.keys)
    t = select_trades(rows, keys, ["k"], ["k", "fill", "fill_ts", "fill_atr"], chunk=_cut(s), one_chunk=not s.chunked)
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    gross = sign * (F.col("exit_fill") - F.col("entry_fill")) / pip_size * terms.pip_value * lots
    cost = round_trip_currency(
        terms, lots=F.lit(lots), session=F.lit(session),
        atr_pips=F.coalesce(F.col("exit_fill_atr"), F.lit(0.0)) / pip_size)
    return t.select(
        *keys, F.col("entry_k").alias("signal_k"), "direction",
        F.col("entry_fill_ts").alias("entry_ts"), F.col("entry_fill").alias("entry_price"),
        F.col("exit_fill_ts").alias("exit_ts"), F.col("exit_fill").alias("exit_price"),
        "exit_kind", "sl", "tp", (gross - cost).alias("pnl"))


def level_trades(series: Series, *, pip_size: float, exit_long: Column | None = None,
                 exit_short: Column | None = None, signal_kind: str = "EOD") -> DataFrame:
    """Entry at the signal's close, exit at the stop or target price, otherwise at the close;
    a trade open at the end is dropped."""
    rows = series.df.withColumns({
        "side": _side(),
        "exit_long": F.coalesce(exit_long, _never()) if exit_long is not None else _never(),
        "exit_short": F.coalesce(exit_short, _never()) if exit_short is not None else _never(),
    })
    keys = list(series.keys)
    t = select_trades(rows, keys, ["k"], ["k", "ts", "close"], chunk=_cut(series), one_chunk=not series.chunked)
    kind = F.when(F.col("exit_kind") == "SIGNAL", signal_kind).otherwise(F.col("exit_kind"))
    return _priced(t.withColumn("exit_kind", kind), keys, pip_size)


def _priced(t: DataFrame, keys: list[str], pip_size: float) -> DataFrame:
    price = (
        F.when(F.col("exit_kind") == "SL", F.col("sl")).when(F.col("exit_kind") == "TP", F.col("tp"))
        .otherwise(F.col("exit_close"))
    )
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    return t.withColumn("exit_price", price).select(
        *keys, "direction", F.col("entry_ts"), F.col("entry_close").alias("entry_price"),
        "exit_ts", "exit_price", "exit_kind", "held",
        (sign * (F.col("exit_price") - F.col("entry_close")) / pip_size).alias("pnl_pips"))


def scanner_trades(decisions: DataFrame, fine: DataFrame, keys: list[str], *, pip_size: float,
                   max_hold: int = 96, chunk_days: int = 365) -> DataFrame:
    """Coarse-bar decisions with barriers watched on fine bars.

    Decisions: ts, close, side, sl, tp, exit_long, exit_short (opposite coarse signal). Fine
    bars: ts, high, low. At one instant fine bars come first; on a decision row the order is
    expiry, reversal, entry. Series are split into pieces of ``chunk_days``.
    """
    none = F.lit(None).cast("double")
    d = decisions.select(
        *keys, "ts", F.lit(1).alias("_o"), "side", "sl", "tp", none.alias("high"),
        none.alias("low"), "exit_long", "exit_short", F.lit(0).alias("counts"),
        F.lit(True).alias("decides"), "close")
    f = fine.select(
        *keys, "ts", F.lit(0).alias("_o"), F.lit(0).alias("side"), none.alias("sl"),
        none.alias("tp"), "high", "low", F.lit(False).alias("exit_long"),
        F.lit(False).alias("exit_short"), F.lit(1).alias("counts"), F.lit(False).alias("decides"),
        none.alias("close"))
    chunk = F.unix_micros("ts") / (chunk_days * 86_400_000_000)
    t = select_trades(d.unionByName(f), keys, ["ts", "_o"], ["ts", "close"], max_hold=max_hold,
                      reenter=True, chunk=chunk)
    return _priced(t, keys, pip_size)


def paper_trades(series: Series) -> DataFrame:
    """Ledger of the paper position: stops and targets on bar extremes, then the signal; every
    exit is priced at the close, a flip exits first."""
    rows = series.df.withColumns({
        "side": _side(), "exit_long": F.col("signal") != "LONG",
        "exit_short": F.col("signal") != "SHORT"})
    keys = list(series.keys)
    t = select_trades(rows, keys, ["k"], ["ts", "close"], chunk=_cut(series), one_chunk=not series.chunked)
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    return t.select(
        *keys, "direction", "entry_ts", F.col("entry_close").alias("entry_price"), "exit_ts",
        F.col("exit_close").alias("exit_price"), F.col("sl").alias("sl_at_entry"),
        F.col("tp").alias("tp_at_entry"), F.concat(F.lit("EXIT_"), "exit_kind").alias("exit_kind"),
        (sign * (F.col("exit_close") - F.col("entry_close"))).alias("pnl"))
