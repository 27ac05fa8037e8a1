"""Alert gates, repeat ties, ids with fractions, blackout flags."""

import datetime as dt
import random

from helpers import T0, close_to
from pyspark.sql import functions as F

from tapeworks.functions import scalars as sc
from tapeworks.operators import indicators as ind
from tapeworks.operators import joins, risk
from tapeworks.operators import signal_store as store
from tapeworks.operators.series import index_series

_ROWS = "id INT, symbol STRING, ts TIMESTAMP, h4_ts TIMESTAMP, direction STRING, m15_signal STRING, confluence BOOLEAN, halted BOOLEAN, news_blocked BOOLEAN, score_total INT"


def _row(i, minute, direction="LONG", ok=True, score=80):
    ts = T0 + dt.timedelta(minutes=minute)
    return (i, "X", ts, T0 + dt.timedelta(hours=minute // 240 * 4), direction, direction, ok, False, False, score)


def test_rejected_alerts_leave_no_trace(spark):
    rows = [_row(1, 0, ok=False), _row(2, 15), _row(3, 30), _row(4, 45, "SHORT", score=1), _row(5, 60), _row(6, 75, "SHORT"), _row(7, 90), _row(8, 240), _row(9, 255)]
    got = store.alert_decision(spark.createDataFrame(rows, _ROWS), threshold=40)
    assert {r["id"]: r["reject_reason"] for r in got.collect()} == {
        1: "no confluence", 2: None, 3: "duplicate", 4: "score below threshold", 5: "duplicate", 6: None, 7: None, 8: None, 9: "duplicate"}


def test_alerts_sent_before_a_batch_count(spark):
    sent = spark.createDataFrame([_row(0, 0)], _ROWS).select("symbol", "direction", "h4_ts", "ts")
    got = store.alert_decision(spark.createDataFrame([_row(1, 15), _row(2, 30, "SHORT"), _row(3, 240)], _ROWS), threshold=40, sent=sent)
    assert {r["id"]: r["reject_reason"] for r in got.collect()} == {1: "duplicate", 2: None, 3: None}


def test_repeats_at_one_instant_go_by_the_tie(spark):
    rows = [("X", T0, 2), ("X", T0, 1), ("X", T0 + dt.timedelta(hours=1), 4), ("X", T0 + dt.timedelta(hours=1), 3)]
    got = risk.suppress_repeats(spark.createDataFrame(rows, "symbol STRING, ts TIMESTAMP, i INT"), ["symbol"], tie="i")
    assert {r["i"] for r in got.where("accepted").collect()} == {1, 3}


def test_ids_tell_fractions_of_a_second_apart(spark):
    rows = [(T0,), (T0 + dt.timedelta(microseconds=5),), (T0 + dt.timedelta(milliseconds=120),)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP")
    ids = [r[0] for r in df.select(sc.signal_id(F.lit("X"), F.col("ts"), F.lit("s"))).collect()]
    import hashlib

    assert ids == [hashlib.sha256(f"X|{t.isoformat()}+00:00|s".encode()).hexdigest()[:16] for (t,) in rows]


def test_rma_skips_unknown_values(spark):
    xs = [None, None, None, 1.0, 2.0, None, 3.0, 4.0, 5.0, None, 7.0, 8.0]
    df = spark.createDataFrame([("X", T0 + dt.timedelta(hours=i), x) for i, x in enumerate(xs)], "symbol STRING, ts TIMESTAMP, close DOUBLE")
    got = [r["r"] for r in ind.add(index_series(df, ("symbol",)), ind.rma(5, "r")).df.orderBy("k").collect()]
    want = [None] * 8 + [3.0, None, (3.0 * 4 + 7) / 5, ((3.0 * 4 + 7) / 5 * 4 + 8) / 5]
    assert all(close_to(a, b) for a, b in zip(got, want)) and len(got) == len(want)


def test_blackout_flags(spark):
    rng = random.Random(1)
    events = [T0 + dt.timedelta(seconds=rng.randrange(90_000)) for _ in range(12)]
    rows = [T0 + dt.timedelta(seconds=s) for s in range(0, 90_000, 60)] + [e + dt.timedelta(minutes=m) for e in events for m in (-30, 15)]
    got = joins.with_blackout(spark.createDataFrame([(t,) for t in rows], "ts TIMESTAMP"), spark.createDataFrame([(e,) for e in events], "event_ts TIMESTAMP"))
    for r in got.collect():
        assert r["blocked"] == any(e - dt.timedelta(minutes=30) <= r["ts"] <= e + dt.timedelta(minutes=15) for e in events)
