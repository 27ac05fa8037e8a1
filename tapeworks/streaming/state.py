"""Keyed state processors for live series (transformWithStateInPandas).

Each processor holds one small state row per key, and rows that the watermark hasn't passed yet (see
``ordered``), so state grows with the number of series and not with their length. They need the
RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeworks.streaming.ordered import InOrder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PAPER_OUT = (
    "symbol STRING, ts TIMESTAMP, kind STRING, price DOUBLE, pnl DOUBLE, cumulative_pnl DOUBLE"
)
REPEAT_OUT = "symbol STRING, direction STRING, ts TIMESTAMP, accepted BOOLEAN"
ALERT_OUT = "symbol STRING, ts TIMESTAMP, direction STRING, h4_ts TIMESTAMP, id STRING"
RISK_OUT = "account STRING, ts TIMESTAMP, trading_day STRING, realized_r DOUBLE, trades INT, halted BOOLEAN, tripped BOOLEAN"
STALL_OUT = "symbol STRING, last_tick TIMESTAMP, stalled_at TIMESTAMP"


class PaperPosition(InOrder):
    """Position state machine: level breaches first, then entry, hold, or exit before a flip.

    Input: symbol, ts, high, low, close, signal, sl, tp.
    """

    STATE = "side INT, entry DOUBLE, sl DOUBLE, tp DOUBLE, total DOUBLE"
    FIRST = (0, None, None, None, 0.0)

    def advance(self, key, state, rows):
        side, entry, sl, tp, total = state
        out = []
        for r in rows.itertuples():
            want = {"LONG": 1, "SHORT": -1}.get(r.signal, 0)
            pnl = None
            if side:
                stop = sl is not None and (r.low <= sl if side > 0 else r.high >= sl)
                goal = tp is not None and (r.high >= tp if side > 0 else r.low <= tp)
                if not (stop or goal) and want == side:
                    kind = "HOLD"
                else:
                    kind = "EXIT_SL" if stop else "EXIT_TP" if goal else "EXIT_SIGNAL"
                    pnl = (r.close - entry) * side
                    total += pnl
                    side, entry, sl, tp = 0, None, None, None
            elif want:
                kind = "ENTRY_LONG" if want > 0 else "ENTRY_SHORT"
                side, entry = want, float(r.close)
                sl = None if pd.isna(r.sl) else float(r.sl)
                tp = None if pd.isna(r.tp) else float(r.tp)
            else:
                kind = "NO_CHANGE"
            out.append((key[0], r.ts, kind, r.close, pnl, total))
        return (side, entry, sl, tp, float(total)), pd.DataFrame(out, columns=["symbol", "ts", "kind", "price", "pnl", "cumulative_pnl"])


class RepeatGuard(InOrder):
    """Accept a (symbol, direction) unless its last accepted row is younger than the window."""

    STATE = "free_us BIGINT"
    FIRST = (None,)

    def __init__(self, window_seconds: int = 3600) -> None:
        self.width = window_seconds * 1_000_000

    def advance(self, key, state, rows):
        ts = rows["event_us"].to_numpy()
        free = int(ts[0]) if state[0] is None else state[0]
        ok, i = np.zeros(len(ts), bool), int(np.searchsorted(ts, free))
        while i < len(ts):
            ok[i] = True
            free = int(ts[i]) + self.width
            i = int(np.searchsorted(ts, free))
        out = pd.DataFrame({"symbol": key[0], "direction": key[1], "ts": rows["ts"], "accepted": ok})
        return (free,), out


class AlertMemory(InOrder):
    """Alerts of a symbol unless the one sent last has the same direction and slow bar; only that one
    is remembered. Input: symbol, ts, direction, h4_ts, id. The first of a slow bar is always sent, so a
    symbol may be keyed with a span of whole slow bars as well."""

    STATE = "direction STRING, h4 BIGINT"
    FIRST = ("", -1)
    ties = ("id",)
    bucket_seconds = 30 * 86_400

    def advance(self, key, state, rows):
        pair = pd.DataFrame({"d": rows["direction"], "h": rows["h4_ts"].astype("datetime64[us]").astype("int64")})
        before = pair.shift(1)
        before.loc[0, ["d", "h"]] = state
        new = (pair["d"] != before["d"]) | (pair["h"] != before["h"])  # a repeat leaves the pair that it repeats
        last = pair.iloc[-1]
        return (str(last["d"]), int(last["h"])), rows.loc[new, ["symbol", "ts", "direction", "h4_ts", "id"]]


class LossGovernor(InOrder):
    """Latching daily halt. Input: account, ts, trading_day, pnl_r in event order."""

    STATE = "day STRING, r DOUBLE, trades INT, halted BOOLEAN"
    FIRST = ("", 0.0, 0, False)

    def __init__(self, max_loss_r: float = 3.0, max_trades: int = 6) -> None:
        self.max_loss_r, self.max_trades = max_loss_r, max_trades

    def advance(self, key, state, rows):
        day, r, trades, halted = state
        days = rows["trading_day"]
        out = []
        for _, part in rows.groupby((days != days.shift()).cumsum(), sort=False):
            if part["trading_day"].iloc[0] != day:
                day, r, trades, halted = part["trading_day"].iloc[0], 0.0, 0, False
            n = len(part)
            total = np.cumsum([r, *part["pnl_r"]])[1:]
            count = trades + np.arange(1, n + 1)
            stop = (total <= -self.max_loss_r) | (count >= self.max_trades)
            tripped = np.zeros(n, bool)
            if halted:
                total, count, stop = np.full(n, r), np.full(n, trades), np.ones(n, bool)
            elif stop.any():
                at = int(stop.argmax())
                tripped[at] = True
                total[at:], count[at:], stop[at:] = total[at], count[at], True
            r, trades, halted = float(total[-1]), int(count[-1]), bool(stop[-1])
            out.append(pd.DataFrame({
                "account": key[0], "ts": part["ts"], "trading_day": day, "realized_r": total, "trades": count.astype("int32"), "halted": stop, "tripped": tripped}))
        return (day, r, trades, halted), pd.concat(out, ignore_index=True)


class StallWatch(StatefulProcessor):
    """One row when no tick of a symbol arrived for 1.5 intervals (processing-time timer)."""

    def __init__(self, interval_seconds: int) -> None:
        self.wait_ms = int(interval_seconds * 1500)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(pdf["ts"].max() for pdf in rows)
        if self.last.exists():
            newest = max(newest, pd.Timestamp(self.last.get()[0]))
        self.last.update((newest.to_pydatetime(),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield pd.DataFrame({"symbol": [], "last_tick": [], "stalled_at": []}).astype(
            {"symbol": str, "last_tick": "datetime64[us]", "stalled_at": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame({"symbol": [key[0]], "last_tick": [pd.Timestamp(self.last.get()[0])],
                            "stalled_at": [at]})

    def close(self) -> None:
        pass


def run_keyed(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, *,
              time_mode: str = "None") -> DataFrame:
    """Attach a processor that needs no order to a stream."""
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)
