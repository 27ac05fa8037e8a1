"""Indicators advanced one closed bar at a time, equal to the batch ones.

State per symbol is a fixed set of scalars, the last twenty bars and the unbroken zones; the
work per bar does not depend on the length of the series.
"""

from __future__ import annotations

import pandas as pd

from tapeworks.operators.zones import RESISTANCE, SUPPORT
from tapeworks.streaming.ordered import InOrder

OUT = (
    "symbol STRING, ts TIMESTAMP, ema DOUBLE, atr DOUBLE, tsi DOUBLE, tsi_signal DOUBLE, "
    "st_dir INT, st_value DOUBLE, prev_high DOUBLE, prev_low DOUBLE, bos STRING, bos_level DOUBLE, "
    "ob_high DOUBLE, ob_low DOUBLE, choch_bearish BOOLEAN, choch_bullish BOOLEAN, "
    "n_support INT, n_resistance INT"
)
_STATE = {
    "n": "INT", "prev": "DOUBLE", "ema": "DOUBLE", "atr": "DOUBLE", "st_atr": "DOUBLE",
    "st_lo": "DOUBLE", "st_up": "DOUBLE", "st_dir": "INT",
    "up1": "DOUBLE", "abs1": "DOUBLE", "up2": "DOUBLE", "abs2": "DOUBLE", "line": "DOUBLE",
    "n2": "INT", "n3": "INT",
    "week": "INT", "hi": "DOUBLE", "lo": "DOUBLE", "p_hi": "DOUBLE", "p_lo": "DOUBLE",
    "o_hi": "DOUBLE", "o_lo": "DOUBLE", "bos": "STRING", "level": "DOUBLE", "b_hi": "DOUBLE",
    "b_lo": "DOUBLE",
    "opens": "ARRAY<DOUBLE>", "highs": "ARRAY<DOUBLE>", "lows": "ARRAY<DOUBLE>",
    "closes": "ARRAY<DOUBLE>", "z_price": "ARRAY<DOUBLE>", "z_kind": "ARRAY<INT>",
    "z_touch": "ARRAY<INT>",
}
_START = {"n": 0, "n2": 0, "n3": 0, "st_dir": 0, "bos": "IDLE",
          **{k: [] for k, t in _STATE.items() if t.startswith("ARRAY")}}


def _blend(old: float | None, x: float, alpha: float) -> float:
    return x if old is None else old + alpha * (x - old)


def _wilder(old: float | None, x: float, n: int, period: int) -> float:
    """Running mean for the first ``period`` values, then Wilder's recurrence."""
    return _blend(old, x, 1.0 / min(n, period))


class ZoneBook:
    """Unbroken zones of one series as [price, kind, touches], oldest first."""

    def __init__(self, merge: float, max_touches: int) -> None:
        self.merge, self.max_touches = merge, max_touches
        self.zones: list[list] = []

    def step(self, high: float, low: float, close: float, pivot_high: float | None,
             pivot_low: float | None) -> None:
        kept = []
        for z in self.zones:
            price, kind = z[0], z[1]
            if (close - price) * kind < 0:
                continue
            reached = low <= price + self.merge if kind == SUPPORT else high >= price - self.merge
            z[2] += reached
            kept.append(z)
        self.zones = kept
        for price, kind in ((pivot_high, RESISTANCE), (pivot_low, SUPPORT)):
            if price is not None:
                self._add(price, kind)

    def _add(self, price: float, kind: int) -> None:
        for z in self.zones:
            if z[1] == kind and abs(z[0] - price) <= self.merge:
                z[2] += 1
                return
        self.zones.append([price, kind, 1])

    def fresh(self, kind: int) -> list[float]:
        return [z[0] for z in self.zones if z[1] == kind and z[2] <= self.max_touches]


class LiveIndicators(InOrder):
    """Input: symbol, ts, open, high, low, close of closed bars. Output: ``OUT``."""

    STATE = ", ".join(f"{k} {t}" for k, t in _STATE.items())
    FIRST = tuple((dict.fromkeys(_STATE) | _START).values())
    bucket_seconds = 30 * 86_400

    def __init__(self, *, ema: int = 20, atr: int = 14, tsi: tuple[int, int, int] = (25, 13, 13),
                 st: tuple[int, float] = (10, 3.0), block_bars: int = 20, pivot: tuple[int, int] = (5, 5),
                 zone_merge: float = 5.0, max_touches: int = 3) -> None:
        self.ema, self.atr, self.tsi, self.st = ema, atr, tsi, st
        self.block_bars, self.pivot = block_bars, pivot
        self.zone_merge, self.max_touches = zone_merge, max_touches
        self.keep = max(block_bars, sum(pivot))

    def advance(self, key, state, rows):
        s = dict(zip(_STATE, state))
        s |= {k: list(s[k]) for k, t in _STATE.items() if t.startswith("ARRAY")}
        out = [(key[0], r.ts, *self.step(s, r)) for r in rows.itertuples()]
        df = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        kinds = {c.split()[0]: "float64" for c in OUT.split(", ") if c.endswith("DOUBLE")}
        return tuple(s[k] for k in _STATE), df.astype(kinds | {"st_dir": "Int32"})

    def step(self, s: dict, r) -> tuple:
        """Advance every indicator by one bar."""
        first = s["n"] == 0
        s["n"] += 1
        shown = (
            *self._averages(s, r, first), *self._strength(s, r, first), *self._trend(s, r),
            *self._structure(s, r), *self._zones(s, r),
        )
        s["prev"] = r.close
        for name, v in (("opens", r.open), ("highs", r.high), ("lows", r.low), ("closes", r.close)):
            s[name] = [*s[name], v][-self.keep:]
        return shown

    def _averages(self, s, r, first):
        tr = r.high - r.low
        if not first:
            tr = max(tr, abs(r.high - s["prev"]), abs(r.low - s["prev"]))
        s["ema"] = _blend(s["ema"], r.close, 2.0 / (self.ema + 1))
        s["atr"] = _wilder(s["atr"], tr, s["n"], self.atr)
        s["st_atr"] = _wilder(s["st_atr"], tr, s["n"], self.st[0])
        return (s["ema"] if s["n"] >= self.ema else None, s["atr"] if s["n"] >= self.atr else None)

    def _strength(self, s, r, first):
        if first:
            return None, None
        long, short, signal = self.tsi
        move = r.close - s["prev"]
        s["up1"] = _blend(s["up1"], move, 2.0 / (long + 1))
        s["abs1"] = _blend(s["abs1"], abs(move), 2.0 / (long + 1))
        if s["n"] - 1 < long:
            return None, None
        s["up2"] = _blend(s["up2"], s["up1"], 2.0 / (short + 1))
        s["abs2"] = _blend(s["abs2"], s["abs1"], 2.0 / (short + 1))
        s["n2"] += 1
        if s["n2"] < short or s["abs2"] == 0.0:
            return None, None
        value = 100.0 * s["up2"] / s["abs2"]
        s["line"] = _blend(s["line"], value, 2.0 / (signal + 1))
        s["n3"] += 1
        return (value, s["line"]) if s["n3"] >= signal else (None, None)

    def _trend(self, s, r):
        period, mult = self.st
        if s["n"] < period:
            return None, None
        mid, width = (r.high + r.low) / 2, mult * s["st_atr"]
        if s["st_lo"] is None:
            s["st_lo"], s["st_up"], s["st_dir"] = mid - width, mid + width, 1
        else:
            s["st_lo"], s["st_up"] = max(s["st_lo"], mid - width), min(s["st_up"], mid + width)
            if s["st_dir"] < 0 and r.close > s["st_up"]:
                s["st_dir"] = 1
            elif s["st_dir"] > 0 and r.close < s["st_lo"]:
                s["st_dir"] = -1
        return s["st_dir"], s["st_lo"] if s["st_dir"] > 0 else s["st_up"]

    def _structure(self, s, r):
        week = (r.ts.toordinal() - 1) // 7
        if week != s["week"]:
            s["o_hi"], s["o_lo"], s["p_hi"], s["p_lo"] = s["p_hi"], s["p_lo"], s["hi"], s["lo"]
            s["week"], s["hi"], s["lo"] = week, r.high, r.low
            s["bos"], s["level"], s["b_hi"], s["b_lo"] = "IDLE", None, None, None
        s["hi"], s["lo"] = max(s["hi"], r.high), min(s["lo"], r.low)
        if s["p_hi"] is None:
            return None, None, None, None, None, None, None, None
        if s["bos"] == "IDLE" and (r.close > s["p_hi"] or r.close < s["p_lo"]):
            up = r.close > s["p_hi"]
            s["bos"], s["level"] = ("BOS_UP", s["p_hi"]) if up else ("BOS_DOWN", s["p_lo"])
            for i in range(1, min(self.block_bars, len(s["opens"])) + 1):
                body = s["closes"][-i] - s["opens"][-i]
                if (body < 0) if up else (body > 0):
                    s["b_hi"], s["b_lo"] = s["highs"][-i], s["lows"][-i]
                    break
        lower = s["o_hi"] is not None and s["p_hi"] < s["o_hi"]
        higher = s["o_lo"] is not None and s["p_lo"] > s["o_lo"]
        return s["p_hi"], s["p_lo"], s["bos"], s["level"], s["b_hi"], s["b_lo"], lower, higher

    def _zones(self, s, r):
        left, right = self.pivot
        book = ZoneBook(self.zone_merge, self.max_touches)
        book.zones = [list(z) for z in zip(s["z_price"], s["z_kind"], s["z_touch"])]
        ph = pl = None
        if s["n"] > left + right:
            highs, lows = [*s["highs"][-(left + right):], r.high], [*s["lows"][-(left + right):], r.low]
            ph = highs[left] if highs[left] >= max(highs) else None
            pl = lows[left] if lows[left] <= min(lows) else None
        book.step(r.high, r.low, r.close, ph, pl)
        for i, name in enumerate(("z_price", "z_kind", "z_touch")):
            s[name] = [z[i] for z in book.zones]
        return len(book.fresh(SUPPORT)), len(book.fresh(RESISTANCE))

    def close(self) -> None:
        pass
