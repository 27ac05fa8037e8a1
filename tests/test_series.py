"""Recurrences against plain folds, and the chunked path against the single-task path."""

import datetime as dt

import pytest
from helpers import T0, bars, close_to, fold_ema, fold_rma, fold_supertrend, fold_tr, fold_tsi, walk
from pyspark.sql import functions as F

from tapeworks.functions.costs import CostTerms
from tapeworks.operators import backtest as bt
from tapeworks.operators import carry
from tapeworks.operators import indicators as ind
from tapeworks.operators import rules
from tapeworks.operators.series import index_series
from tapeworks.operators.zones import zone_proximity

KEYS = ("symbol", "timeframe")


@pytest.fixture(scope="module")
def data():
    return {"A": walk(1500, 1, "A"), "B": walk(700, 2, "B")}


@pytest.fixture(scope="module")
def frame(spark, data):
    return bars(spark, data["A"] + data["B"]).repartition(5)


@pytest.fixture(scope="module", params=[100_000, 230], ids=["single", "chunked"])
def series(request, frame):
    return index_series(frame, KEYS, rows_per_chunk=request.param)


def rows_of(s, symbol, *cols):
    return [tuple(r) for r in s.df.where(F.col("symbol") == symbol).orderBy("k").select(*cols).collect()]


def test_positions(series, data):
    for sym, rows in data.items():
        got = rows_of(series, sym, "k", "ts")
        assert got == [(i, r[2]) for i, r in enumerate(rows)]


def test_recurrences_match_folds(series, data):
    s = ind.add(series, ind.ema(3, "e"), ind.rma(4, "r"), ind.atr(5), ind.tsi(6, 4, 3), ind.ema_mean_seeded(5, "m"))
    for sym, rows in data.items():
        close = [r[6] for r in rows]
        got = rows_of(s, sym, "e", "r", "atr", "tsi", "tsi_signal")
        e, r, a = fold_ema(close, 3), fold_rma(close, 4), fold_rma(fold_tr(rows), 5)
        t = fold_tsi(close, 6, 4, 3)
        for i, g in enumerate(got):
            assert close_to(g[0], e[i]) and close_to(g[1], r[i]) and close_to(g[2], a[i]), i
            assert close_to(g[3], t[i] and t[i][0]) and close_to(g[4], t[i] and t[i][1]), i


def _hard(n, seed):
    """Bars with a column that starts late and has long gaps, and a close with long flat stretches."""
    rows = walk(n, seed, "H")
    out, flat = [], None
    for i, r in enumerate(rows):
        if 900 <= i < 1100 or 1500 <= i < 1560 or 2000 <= i < n - 300:
            flat = flat or r[3]
            r = (*r[:3], flat, flat, flat, flat)
        else:
            flat = None
        known = None if i < 1300 or 1700 <= i < 1950 or i % 7 == 0 else r[6]
        out.append((*r, known))
    return out


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(*r, "x") for r in _hard(14_000, 5)]
    schema = "symbol STRING, timeframe STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, late DOUBLE, note STRING"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def _recurrences(frame, chunk):
    s = index_series(frame, KEYS, rows_per_chunk=chunk)
    parts = (ind.rma(14, "r", "late"), ind.ema(20, "e", "late"), ind.ema_mean_seeded(200, "m", "late"), ind.tsi(), ind.atr(14), ind.cost_atr(60, 0.5))
    cols = ("r", "e", "m", "tsi", "tsi_signal", "atr", "cost_atr")
    return rows_of(ind.add(s, *parts), "H", *cols)


@pytest.mark.parametrize("chunk, fan", [(50, 7), (1500, 3), (1500, 1000)])
def test_recurrences_are_exact_at_every_length(hard, monkeypatch, chunk, fan):
    monkeypatch.setattr(carry, "FAN", fan)
    whole, cut = _recurrences(hard, 1_000_000), _recurrences(hard, chunk)
    assert len(whole) == len(cut) == 14_000
    for i, (w, c) in enumerate(zip(whole, cut)):
        for x, y in zip(w, c):
            assert close_to(x, y, 1e-9), (i, w, c)


def test_whole_series_agree_with_folds_over_known_values(hard):
    rows = _hard(14_000, 5)
    known = [r[7] for r in rows]
    got = _recurrences(hard, 1_000_000)
    at = [i for i, x in enumerate(known) if x is not None]
    want_r, want_e = fold_rma([known[i] for i in at], 14), fold_ema(known, 20)
    t = fold_tsi([r[6] for r in rows], 25, 13, 13)
    by_row = dict(zip(at, want_r))
    for i, g in enumerate(got):
        assert close_to(g[0], by_row.get(i)) and close_to(g[1], want_e[i]), i
        if i < 9000:  # beyond, the flat stretch has faded below what doubles hold
            assert close_to(g[3], t[i] and t[i][0]) and close_to(g[4], t[i] and t[i][1]), i


def test_faded_momentum_is_unknown_until_prices_move(hard):
    got = _recurrences(hard, 1500)
    assert all(g[3] is None for g in got[13_000:13_700]) and all(g[3] is not None for g in got[13_701:])


def test_supertrend_matches_fold(series, data):
    s = ind.supertrend(series, 10, 3.0)
    for sym, rows in data.items():
        got = rows_of(s, sym, "st_dir", "st_value")
        for g, w in zip(got, fold_supertrend(rows, 10, 3.0)):
            if w is None:
                assert g == (None, None)
            else:
                assert g[0] == w[2] and close_to(g[1], w[0] if w[2] == 1 else w[1])


def test_constant_series_has_no_tsi(spark):
    flat = [("C", "1h", T0 + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0) for i in range(80)]
    s = ind.add(index_series(bars(spark, flat), KEYS), ind.tsi(), ind.ema(3, "e"))
    assert s.df.where("tsi IS NOT NULL OR tsi_signal IS NOT NULL").count() == 0
    assert s.df.where("e = 5.0").count() == 78


@pytest.mark.parametrize("build,cols", [
    (lambda s: ind.weekly_levels(s), ["prev_high", "curr_low"]),
    (lambda s: ind.break_of_structure(s), ["bos", "ob_high", "choch_bullish"]),
    (lambda s: ind.crossover(ind.add(s, ind.tsi(6, 4, 3)), "tsi", "tsi_signal"), ["cross_up", "cross_down"]),
    (lambda s: ind.volatility_filter(ind.add(s, ind.atr(5))), ["vol_suppressed"]),
    (lambda s: ind.swing_pivots(s), ["pivot_high", "pivot_low"]),
    (lambda s: zone_proximity(s, pip_size=0.1, gate_pips=20), ["near_support", "n_resistance"]),
    (lambda s: rules.london_sweep(s), ["signal", "sl"]),
    (lambda s: rules.gold_pullback(s, ema_fast=3, ema_slow=6, st_period=4, tsi_long=6, tsi_short=4, tsi_signal=3,
                                   atr_period=4), ["signal", "tp"]),
    (lambda s: rules.ema_cross(s, 3, 7), ["signal"]),
    (lambda s: rules.tsi_momentum(s, ema_period=6, tsi_long=6, tsi_short=4, tsi_signal=3, atr_period=4), ["signal", "sl"]),
    (lambda s: rules.multi_tf_tsi(s, ema_period=6, tsi_long=6, tsi_short=4, tsi_signal=3, atr_period=4), ["signal", "h1_bias"]),
    (lambda s: rules.weekly_bos_retest(s, ema_fast=3, ema_slow=6, tsi_long=6, tsi_short=4, tsi_signal=3), ["signal"]),
], ids=["levels", "bos", "cross", "vol", "pivots", "zones", "sweep", "gold", "ema", "tsi", "multi", "retest"])
def test_chunked_equals_single(frame, build, cols):
    one = build(index_series(frame, KEYS)).df.select(*KEYS, "ts", *cols)
    cut = build(index_series(frame, KEYS, rows_per_chunk=230)).df.select(*KEYS, "ts", *cols)

    def table(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())

    assert table(one) == table(cut)


@pytest.fixture(scope="module")
def one_hot(spark):
    """One key with nearly all rows; prices drift, crash and return, so zones live long and break together."""
    rows = walk(1100, 8, "Z", scale=0.8)
    moved = []
    for i, (*head, o, h, lo, c) in enumerate(rows):
        by = 0.04 * i if i < 600 else 24 - 30 * (i > 750) + 25 * (i > 950)
        moved.append((*head, o + by, h + by, lo + by, c + by))
    return bars(spark, moved + walk(90, 4, "Y")).repartition(3).cache()


ZONE_COLS = ("near_support", "near_resistance", "n_support", "n_resistance")


@pytest.mark.parametrize("left, merge, touches", [(2, 20.0, 3), (1, 60.0, 1), (3, 5.0, 2)])
def test_zones_match_a_bar_by_bar_book(one_hot, left, merge, touches):
    from tapeworks.operators.zones import RESISTANCE, SUPPORT
    from tapeworks.streaming.indicators import ZoneBook

    how = {"pip_size": 0.1, "left": left, "right": left, "merge_pips": merge, "max_touches": touches, "gate_pips": 40.0}
    s = index_series(one_hot, KEYS)
    pivots = ind.swing_pivots(s, left, left).df.where("symbol = 'Z'").orderBy("k").select("high", "low", "close", "pivot_high", "pivot_low").collect()
    book, want = ZoneBook(merge * 0.1, touches), []
    for r in pivots:
        book.step(*r)
        sides = [book.fresh(SUPPORT), book.fresh(RESISTANCE)]
        want.append((*(any(r.close - 4.0 <= p <= r.close + 4.0 for p in z) for z in sides), *(len(z) for z in sides)))
    for block in (7, 1_000_000) if left == 2 else (100, 400):
        assert rows_of(zone_proximity(s, **how, block=block), "Z", *ZONE_COLS) == want, block


def _loop_trades(rows, sig):
    """Next-open engine, one bar at a time."""
    pos, out, n = None, [], len(rows)
    for i in range(n):
        if i == n - 1:
            if pos:
                out.append((*pos, rows[i][6]))
            break
        fill = rows[i + 1][3]
        if pos and sig[i] != pos[0]:
            out.append((*pos, fill))
            pos = None
        if not pos and sig[i] != "FLAT":
            pos = (sig[i], fill)
    return out


@pytest.mark.parametrize("chunk", [100_000, 150])
def test_islands_equal_bar_loop(frame, data, chunk):
    s = rules.ema_cross(index_series(frame, KEYS, rows_per_chunk=chunk), 3, 7)
    if s.chunked:
        s = s.settle()
    t = bt.backtest(s, terms=CostTerms.literal(0, 0, 0, 0, 1.0), pip_size=1.0)
    for sym, rows in data.items():
        sig = [r[0] for r in rows_of(s, sym, "signal")]
        want = _loop_trades(rows, sig)
        got = [tuple(r) for r in t.where(F.col("symbol") == sym).orderBy("signal_k").select(
            "direction", "entry_price", "exit_price").collect()]
        assert got == want
