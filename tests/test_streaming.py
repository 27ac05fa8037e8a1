"""State machines and sinks on small streams."""

import datetime as dt
import random
import time

import pytest
from helpers import T0
from pyspark.sql import functions as F

from tapeworks.plans.streams import drain, drain_in_order
from tapeworks.sources import tables
from tapeworks.streaming import live, state


def feed(spark, path, frames, ddl):
    """One file per micro-batch, in name order."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
        time.sleep(0.05)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


PAPER = "symbol STRING, ts TIMESTAMP, high DOUBLE, low DOUBLE, close DOUBLE, signal STRING, sl DOUBLE, tp DOUBLE"


def test_paper_position_events(spark, tmp_path):
    def row(i, hi, lo, c, sig, sl=None, tp=None):
        return ("X", T0 + dt.timedelta(hours=i), hi, lo, c, sig, sl, tp)

    frames = [[row(0, 10, 10, 10, "FLAT"), row(1, 10, 10, 10, "LONG", 9.0, 12.0)], [row(2, 11, 10, 10.5, "LONG"), row(3, 11, 8.9, 9.5, "LONG")],
              [row(4, 10, 9, 9.5, "SHORT", 11.0, 8.0), row(5, 10, 9, 9.2, "LONG"), row(6, 10, 9, 9.3, "LONG", 9.0, 12.0), row(7, 12.5, 8.5, 11.0, "LONG")]]
    s = feed(spark, str(tmp_path / "in"), [[tuple(float(v) if isinstance(v, int) else v for v in r) for r in f] for f in frames], PAPER)
    out = drain_in_order(spark, s, ["symbol"], state.PaperPosition(), state.PAPER_OUT).orderBy("ts").collect()
    assert [r["kind"] for r in out] == ["NO_CHANGE", "ENTRY_LONG", "HOLD", "EXIT_SL", "ENTRY_SHORT", "EXIT_SIGNAL", "ENTRY_LONG", "EXIT_SL"]
    assert [round(r["pnl"], 6) for r in out if r["pnl"] is not None] == [-0.5, 0.3, 1.7]
    assert out[-1]["cumulative_pnl"] == pytest.approx(1.5)


def test_bar_sink_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "bars")
    rows = [("X", T0 + dt.timedelta(hours=i), 1.0, 2.0, 0.5, 1.5, 3.0, 1.4, 1.6, 0.2) for i in range(5)]
    ddl = "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, bid DOUBLE, ask DOUBLE, spread DOUBLE"
    batch = spark.createDataFrame(rows, ddl)
    save = live.bar_sink(root, "1h")
    save(batch.limit(3), 0), save(batch, 1), save(batch, 1)
    assert tables.read_bars(spark, root).count() == 5


def test_signal_sink_skips_known_ids(spark):
    kept = []
    table = [("a",)]
    sink = live.signal_sink(lambda b: b, lambda d: kept.extend(r["id"] for r in d.collect()),
                            lambda: spark.createDataFrame(table, "id STRING"))
    sink(spark.createDataFrame([("a",), ("b",), ("b",)], "id STRING"), 0)
    assert kept == ["b"]


def test_late_ticks_and_zero_spread(spark):
    t = spark.createDataFrame([("X", T0 + dt.timedelta(minutes=m), p, p, p, 1.0) for m, p in ((50, 3.0), (10, 1.0), (70, 5.0))],
                              "symbol STRING, ts TIMESTAMP, price DOUBLE, bid DOUBLE, ask DOUBLE, volume DOUBLE")
    r = live.stream_bars(t, 60).orderBy("ts").collect()
    assert (r[0]["open"], r[0]["close"], r[0]["volume"], r[0]["spread"]) == (1.0, 3.0, 2.0, 0.1)


def test_alerts_once(spark, tmp_path):
    ddl = "symbol STRING, direction STRING, h4_ts TIMESTAMP, ts TIMESTAMP"
    a = ("X", "LONG", T0, T0 + dt.timedelta(minutes=15))
    s = feed(spark, str(tmp_path / "in"), [[a, a], [a, ("X", "SHORT", T0, T0 + dt.timedelta(minutes=30))]], ddl)
    assert drain(spark, live.alerts_once(s)).count() == 2


REPEATS = "symbol STRING, direction STRING, ts TIMESTAMP"


def _accepted(rows, width):
    last, out = {}, []
    for s, d, ts in sorted(rows):
        ok = (s, d) not in last or ts - last[s, d] >= width
        if ok:
            last[s, d] = ts
        out.append((s, d, ts, ok))
    return sorted(out)


@pytest.mark.parametrize("delay, disorder", [("20000 days", None), ("5 hours", 4)])
def test_order_of_arrival_changes_nothing(spark, tmp_path, delay, disorder):
    """Rows cut into files in any order that the delay allows, one file a batch."""
    rng = random.Random(7)
    rows = [(rng.choice("AB"), rng.choice(["L", "S"]), T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 9), seconds=rng.randrange(60))) for _ in range(900)]
    if disorder is None:
        rng.shuffle(rows)
    else:  # every row at most four hours late
        rows.sort(key=lambda r: r[2] + dt.timedelta(hours=rng.random() * disorder))
    frames = [rows[i : i + 100] for i in range(0, 900, 100)]
    s = feed(spark, str(tmp_path / "in"), frames, REPEATS)
    guard = state.RepeatGuard(3600)
    guard.bucket_seconds = 7200
    got = drain_in_order(spark, s, ["symbol", "direction"], guard, state.REPEAT_OUT, delay=delay).collect()
    assert sorted(map(tuple, got)) == _accepted(rows, dt.timedelta(hours=1))


def test_a_tables_files_come_in_no_order(spark, tmp_path):
    """Without a delay named, no row of a table is late, however many batches its files make."""
    rng = random.Random(9)
    rows = [(rng.choice("AB"), "L", T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 30), seconds=i % 60)) for i in range(300)]
    s = feed(spark, str(tmp_path / "in"), [rows[i : i + 60] for i in range(0, 300, 60)], REPEATS)
    got = drain_in_order(spark, s, ["symbol", "direction"], state.RepeatGuard(), state.REPEAT_OUT).collect()
    assert sorted(map(tuple, got)) == _accepted(rows, dt.timedelta(hours=1))


class _Kept(dict):
    """State of one key that counts what is written."""

    def __init__(self):
        self.written = 0

    def updateValue(self, k, v):
        self.written += len(v[0])
        self[k] = v

    getValue, removeKey = dict.get, dict.pop
    get = lambda self: dict.get(self, 0)
    update = lambda self, v: self.__setitem__(0, v)


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Kept())

    getValueState = getMapState
    listTimers = lambda self: list(self.timers)
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


def test_waiting_rows_are_written_once():
    import pandas as pd

    def written(batches):
        guard, handle = state.RepeatGuard(), _Handle()
        guard.init(handle)
        for i in range(batches):
            pdf = pd.DataFrame({"ts": pd.to_datetime([T0]), "event_us": [i * 1_000_000]})
            list(guard.handleInputRows(("A", "L"), iter([pdf]), None))
        return handle.states["waiting"].written

    assert written(80) == 8 * written(10)


def test_loss_governor_goes_on_across_pieces():
    import pandas as pd

    rng = random.Random(5)
    fills = [(d, rng.choice([-1.4, -0.3, 0.2])) for d in ("d1", "d2", "d3") for _ in range(rng.choice([3, 5, 11]))]
    want, day = [], None
    for d, x in fills:
        if d != day:
            day, r, n, halted = d, 0.0, 0, False
        trip = False
        if not halted:
            r, n = r + x, n + 1
            trip = halted = r <= -3 or n >= 6
        want.append((d, r, n, halted, trip))
    for size in (1, 4, len(fills)):
        gov, st, got = state.LossGovernor(), state.LossGovernor.FIRST, []
        for i in range(0, len(fills), size):
            pdf = pd.DataFrame(fills[i : i + size], columns=["trading_day", "pnl_r"]).assign(ts=T0)
            st, out = gov.advance(("acc",), st, pdf)
            got += list(out[["trading_day", "realized_r", "trades", "halted", "tripped"]].itertuples(index=False, name=None))
        assert got == want


def test_rows_wait_for_the_watermark(spark, tmp_path):
    rows = [[("A", "L", T0 + dt.timedelta(hours=h))] for h in (0, 5, 3, 9, 2)]
    s = feed(spark, str(tmp_path / "in"), rows, REPEATS)
    from tapeworks.streaming.ordered import in_order
    got = drain(spark, in_order(s, ["symbol", "direction"], state.RepeatGuard(), state.REPEAT_OUT, delay="1 hour"))
    # hour 3 came before hour 4 was released, hour 2 after it; hour 9 still waits
    assert sorted(r["ts"] for r in got.collect()) == [T0 + dt.timedelta(hours=h) for h in (0, 3, 5)]


def test_stall_is_reported(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    ddl = "symbol STRING, ts TIMESTAMP"
    s = feed(spark, str(tmp_path / "in"), [[("X", T0)]], ddl)
    out = state.run_keyed(s, ["symbol"], state.StallWatch(1), state.STALL_OUT, time_mode="ProcessingTime")
    path = str(tmp_path / "out")
    q = (
        out.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                n = spark.read.schema(state.STALL_OUT).parquet(path).count()
            except Exception:  # noqa: BLE001
                n = 0
            if n:
                break
    finally:
        q.stop()
    r = spark.read.schema(state.STALL_OUT).parquet(path).collect()
    assert len(r) == 1 and r[0]["symbol"] == "X" and r[0]["last_tick"] == T0 and r[0]["stalled_at"] > T0




def test_live_indicators_across_batches(spark, tmp_path):
    from helpers import bars, close_to, walk
    from tapeworks.operators import indicators as ind
    from tapeworks.operators.series import index_series
    from tapeworks.streaming.indicators import OUT, LiveIndicators

    rows = walk(400, 6, "X")
    ddl = "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"
    cut = [(r[0], *r[2:]) for r in rows]
    mixed = cut[:]
    random.Random(3).shuffle(mixed)
    s = feed(spark, str(tmp_path / "in"), [mixed[:37], mixed[37:220], mixed[220:]], ddl)
    got = drain_in_order(spark, s, ["symbol"], LiveIndicators(), OUT, delay="30 days").orderBy("ts").collect()
    b = index_series(bars(spark, rows), ("symbol", "timeframe"))
    b = ind.break_of_structure(ind.supertrend(ind.add(b, ind.ema(20, "ema"), ind.tsi(), ind.atr(14))))
    want = b.df.orderBy("ts").collect()
    assert len(got) == 400
    for g, w in zip(got, want):
        for c in ("ema", "atr", "tsi", "tsi_signal", "st_value", "prev_high", "ob_low"):
            assert close_to(g[c], w[c]), c
        assert (g["st_dir"], g["bos"]) == (w["st_dir"], w["bos"])


def test_scan_job_is_idempotent(spark, tmp_path):
    from helpers import walk
    from tapeworks.streaming.signals import ScanJob, deliver_to

    rows = walk(96 * 40, 12, "XAU/USD", step=15, scale=2.0)
    ddl = "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"
    frame = spark.createDataFrame([(r[0], *r[2:]) for r in rows], ddl)
    users = spark.createDataFrame([(1, "free", (["XAU/USD"], ["LONDON", "OVERLAP", "NEWYORK", "ASIA"], 0), False)],
                                  "telegram_id BIGINT, tier STRING, prefs STRUCT<pairs: ARRAY<STRING>, sessions: ARRAY<STRING>, min_score: INT>, banned BOOLEAN")
    sent = []
    cut = T0 + dt.timedelta(days=38)
    job = ScanJob(str(tmp_path / "bars"), str(tmp_path / "signals"), threshold=0, scan_params={
        "h1_params": {"zone_entry_pips": 1e6, "max_zone_touches": 10_000}, "min_slope_price": 0.0},
        deliver=deliver_to(users, lambda d: sent.extend(d.collect())))
    tables.write_bars(frame.where(frame.ts < cut).withColumn("timeframe", F.lit("15m")), job.bar_root)
    late = frame.where(frame.ts >= cut)
    job(late.where(late.ts < cut + dt.timedelta(days=1)), 0)
    job(late, 1), job(late, 1)
    got = spark.read.parquet(job.signal_root)
    assert got.count() == got.select("id").distinct().count() == 2 * 96
    ok = got.where("reject_reason IS NULL")
    assert ok.where("NOT confluence OR m15_signal <> direction").count() == 0
    assert len(sent) == ok.where("session IS NOT NULL").count()
    assert got.where("reject_reason = 'no confluence' AND confluence").count() == 0
