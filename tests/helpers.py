"""Small fixtures and plain-Python folds written from the operator definitions."""

import datetime as dt
import random

import pandas as pd

T0 = dt.datetime(2024, 1, 1)


def walk(n, seed=1, symbol="X", step=60, start=T0, scale=1.0):
    rng, p, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o = p
        p = max(1.0, p + rng.gauss(0, scale))
        hi, lo = max(o, p) + rng.random() * scale, min(o, p) - rng.random() * scale
        rows.append((symbol, "1h", start + dt.timedelta(minutes=step * i), o, hi, lo, p))
    return rows


def bars(spark, rows):
    pdf = pd.DataFrame(rows, columns=["symbol", "timeframe", "ts", "open", "high", "low", "close"])
    return spark.createDataFrame(pdf, "symbol STRING, timeframe STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE")


def fold_ema(xs, p):
    out, y, n = [], None, 0
    for x in xs:
        if x is None:
            out.append(None)
            continue
        y = x if y is None else y + (x - y) * 2 / (p + 1)
        n += 1
        out.append(y if n >= p else None)
    return out


def fold_rma(xs, p):
    out, y, seen = [], None, []
    for x in xs:
        if y is None:
            seen.append(x)
            if len(seen) == p:
                y = sum(seen) / p
        else:
            y = (y * (p - 1) + x) / p
        out.append(y)
    return out


def fold_tr(rows):
    out, pc = [], None
    for *_, h, lo, c in rows:
        out.append(h - lo if pc is None else max(h - lo, abs(h - pc), abs(lo - pc)))
        pc = c
    return out


def fold_tsi(cs, a, b, g):
    m = [None] + [y - x for x, y in zip(cs, cs[1:])]
    up = fold_ema(fold_ema(m, a), b)
    size = fold_ema(fold_ema([None if x is None else abs(x) for x in m], a), b)
    v = [None if u is None or not s else 100 * u / s for u, s in zip(up, size)]
    line = fold_ema(v, g)
    return [(x, s) if s is not None and x is not None else None for x, s in zip(v, line)]


def fold_supertrend(rows, p, mult):
    out, state = [], None
    for (*_, h, lo, c), a in zip(rows, fold_rma(fold_tr(rows), p)):
        if a is None:
            out.append(None)
            continue
        rl, ru = (h + lo) / 2 - mult * a, (h + lo) / 2 + mult * a
        if state is None:
            state = (rl, ru, 1)
        else:
            low, up, d = max(rl, state[0]), min(ru, state[1]), state[2]
            if d == -1 and c > up:
                d = 1
            elif d == 1 and c < low:
                d = -1
            state = (low, up, d)
        out.append(state)
    return out


def close_to(a, b, tol=1e-8):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return abs(a - b) <= tol * max(1.0, abs(b))
