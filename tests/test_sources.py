import datetime as dt
import json
import lzma
import struct
from datetime import UTC

import pytest
from helpers import T0, bars, walk
from pyspark.sql import functions as F

from tapeworks.operators import bars as br
from tapeworks.operators import quality
from tapeworks.sources import feeds, logs, tables, ticks


def test_tick_archive_to_bars(spark, tmp_path):
    recs = [(1000, 110000, 109990, 1.5, 0.8), (2500, 110010, 110000, 1.0, 1.0), (61_000, 109990, 109980, 2.0, 2.0)]
    body = lzma.compress(b"".join(struct.pack(">IIIff", *r) for r in recs))
    for hour in (9, 10):
        d = tmp_path / "EURUSD" / "2020" / "02" / "10"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{hour:02d}h_ticks.bi5").write_bytes(body if hour == 9 else b"")
    t = ticks.read_tick_archives(spark, str(tmp_path))
    rows = t.orderBy("seq").collect()
    assert len(rows) == 3 and rows[0]["ts"] == dt.datetime(2020, 3, 10, 9, 0, 1)
    assert rows[0]["ask"] == 1.1 and rows[0]["bid"] == 1.0999
    b = br.ticks_to_bars(t, 1).orderBy("ts").collect()
    assert [r["ts"].minute for r in b] == [0, 1]
    assert b[0]["open"] == pytest.approx(1.09995) and b[0]["close"] == pytest.approx(1.10005)
    assert b[0]["volume"] == pytest.approx((2.3 + 2.0) / 2) and b[0]["ask"] == 1.1001
    with pytest.raises(ValueError):
        ticks.decode(lzma.compress(b"123"), dt.datetime(2020, 1, 1, tzinfo=UTC))


def test_input_order_beats_time_order(spark):
    df = spark.createDataFrame(
        [("X", dt.datetime(2024, 1, 1, 0, 0, 30), 1, 2.0, 2.0, 1.0, 1.0), ("X", dt.datetime(2024, 1, 1, 0, 0, 10), 2, 3.0, 3.0, 1.0, 1.0)],
        "symbol STRING, ts TIMESTAMP, seq BIGINT, ask DOUBLE, bid DOUBLE, ask_vol DOUBLE, bid_vol DOUBLE")
    r = br.ticks_to_bars(df, 1).first()
    assert (r["open"], r["close"]) == (2.0, 3.0)


def test_monthly_store(spark, tmp_path):
    root = str(tmp_path / "bars")
    assert tables.read_bars(spark, root).count() == 0
    b = bars(spark, walk(24 * 70, 4, "EUR/USD"))
    tables.write_bars(b, root)
    lo, hi = dt.datetime(2024, 1, 20, tzinfo=UTC), dt.datetime(2024, 2, 10, tzinfo=UTC)
    load = lambda **k: tables.load_bars(spark, root, "EUR/USD", "1h", lo, hi, **k)
    assert load().count() == 21 * 24 + 1 and load(closed="left").count() == 21 * 24
    plan = load()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:400]
    assert load().where("volume <> 0.0 OR source <> 'dukascopy'").count() == 0
    part = b.where("ts >= '2024-02-01' AND ts < '2024-02-03'").withColumn("close", F.lit(1.0))
    tables.write_bars(part, root, upsert=True)
    feb = tables.read_month(spark, root, "EUR/USD", "1h", 2024, 2)
    assert feb.count() == 29 * 24 and feb.where("close = 1.0").count() == 48
    tables.write_bars(part, root)
    assert tables.read_month(spark, root, "EUR/USD", "1h", 2024, 2).count() == 48
    assert tables.read_month(spark, root, "EUR/USD", "1h", 2024, 1).count() == 31 * 24
    with pytest.raises(ValueError):
        tables.load_bars(spark, root, "EUR/USD", "1h", dt.datetime(2024, 1, 1), hi)


def test_logs(spark, tmp_path):
    p = str(tmp_path / "journal")
    t = spark.createDataFrame(
        [("XAU/USD", "LONG", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 10), 1.0, 2.0, None, None, "EXIT_TP", None)],
        "symbol STRING, direction STRING, entry_ts TIMESTAMP, exit_ts TIMESTAMP, entry_price DOUBLE, exit_price DOUBLE, "
        "sl_at_entry DOUBLE, tp_at_entry DOUBLE, exit_kind STRING, pnl DOUBLE")
    logs.append_exits(t, p)
    (tmp_path / "journal" / "x.json").write_text("\nnot json\n\n")
    r = logs.read_journal(spark, p).collect()
    assert len(r) == 1 and r[0]["n_bars_held"] == 2 and r[0]["pnl"] == 0.0
    lv = str(tmp_path / "levels")
    logs.append_records(spark.createDataFrame([("XAU/USD", 1.0)], "symbol STRING, prev_high DOUBLE"), lv, "level")
    logs.append_records(spark.createDataFrame([("XAU/USD", "s")], "symbol STRING, source STRING"), lv, "signal")
    assert logs.read_records(spark, lv, "level").count() == 1 and logs.read_records(spark, lv, "signal").first()["source"] == "s"
    bad = tmp_path / "trials.jsonl"
    bad.write_text('{"strategy": "a", "seq": 1}\n\n')
    assert logs.read_trials(spark, str(bad)).count() == 1
    bad.write_text('{"strategy": \n')
    with pytest.raises(Exception):
        logs.read_trials(spark, str(bad)).collect()


def test_payload_repairs_and_first_copy_wins(spark, tmp_path):
    page = {"meta": {"symbol": "EUR/USD", "interval": "1h"}, "values": [
        {"datetime": "2024-01-02 01:00:00", "open": "1.2", "high": "1.1", "low": "1.15", "close": "1.3"},
        {"datetime": "2024-01-02 01:00:00", "open": "9", "high": "9", "low": "9", "close": "9"},
        {"datetime": "2024-01-01", "open": "1", "high": "1", "low": "1", "close": "1"},
        {"datetime": "2025-01-01", "open": "1", "high": "1", "low": "1", "close": "1"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    at = lambda s: F.lit(s).cast("timestamp")
    b = feeds.bars_from_payload(feeds.read_bar_payloads(spark, str(tmp_path)), start=at("2024-01-01"),
                                end=at("2024-01-03"), pip_size=F.lit(0.0001)).orderBy("ts").collect()
    assert len(b) == 2 and b[1]["high"] == 1.3 and b[1]["low"] == 1.15
    assert b[1]["ask"] - b[1]["bid"] == pytest.approx(0.0002)


def test_price_event_fallbacks(spark):
    ev = [{"event": "price", "symbol": "EURUSD", "price": "1.1", "bid": "0", "timestamp": 0, "last_trade_time": 5},
          {"event": "price", "symbol": "EUR/USD", "price": "x", "timestamp": 5}, {"event": "heartbeat"},
          {"event": "price", "symbol": "GBP_USD", "price": "2", "ask": "2.5", "last_volume": "3", "timestamp": 7}]
    df = spark.createDataFrame([(json.dumps(e),) for e in ev] + [("{broken",)], "value STRING")
    r = feeds.price_ticks(df).orderBy("symbol").collect()
    assert [(x["symbol"], x["bid"], x["ask"], x["volume"]) for x in r] == [("EUR/USD", 1.1, 1.1, 0.0), ("GBP/USD", 2.0, 2.5, 3.0)]
    assert feeds.price_ticks(df, ["GBP/USD"]).count() == 1


def test_price_of_zero_is_a_tick(spark):
    ev = [{"event": "price", "symbol": "EUR/USD", "price": "0", "ask": "0.5", "timestamp": 5}, {"event": "price", "symbol": "EUR/USD", "price": "0.0", "timestamp": 6},
          {"event": "price", "symbol": "EUR/USD", "price": None, "ask": "0.5", "timestamp": 7}]
    r = feeds.price_ticks(spark.createDataFrame([(json.dumps(e),) for e in ev], "value STRING")).orderBy("ts").collect()
    assert [(x["price"], x["bid"], x["ask"]) for x in r] == [(0.0, 0.0, 0.5), (0.0, 0.0, 0.0)]


def test_subscriber_prefs(spark):
    df = spark.createDataFrame([(1, '{"pairs": [" eur/usd", ""], "sessions": ["ny", "NEWYORK"], "min_score": 140}')], "telegram_id BIGINT, prefs STRING")
    r = feeds.subscribers(df).first()
    assert r["prefs"]["pairs"] == ["EUR/USD"] and r["prefs"]["sessions"] == ["NEWYORK"] and r["prefs"]["min_score"] == 100
    assert r["banned"] is False


def q_bars(spark, rows):
    return spark.createDataFrame(rows, "symbol STRING, timeframe STRING, ts TIMESTAMP, bid DOUBLE, ask DOUBLE, spread DOUBLE, seq BIGINT")


@pytest.mark.parametrize("fault,check", [
    ("dup", "no_duplicate_timestamps"), ("order", "monotonic_timestamps"), ("quote", "valid_bid_ask"), ("neg", "no_negative_spread"),
    ("wide", "spread_outliers"), ("hole", "coverage"), ("hole", "intra_session_gaps"), ("weekend", "no_closed_market_data")])
def test_each_quality_check_fails_once(spark, fault, check):
    t0 = dt.datetime(2025, 6, 2, 8)
    rows = [["E", "1h", t0 + dt.timedelta(hours=i), 1.0, 1.0001, 0.0001, i] for i in range(90)]
    if fault == "dup":
        rows.append([*rows[5][:6], 90])
    if fault == "order":
        rows[3][6], rows[4][6] = 4, 3
    if fault == "quote":
        rows[7][4] = 0.5
    if fault == "neg":
        rows[7][5] = -0.0001
    if fault == "wide":
        rows[7][5] = 1.0
    if fault == "hole":
        del rows[20:30]
    if fault == "weekend":
        rows.append(["E", "1h", dt.datetime(2025, 6, 7, 12), 1.0, 1.0001, 0.0001, 90])
    rep = quality.data_quality(q_bars(spark, rows), 3600, order="seq" if fault == "order" else "ts")
    failed = {r["check"] for r in rep.where("NOT passed").collect()}
    assert check in failed
    v = quality.verdict(rep).first()
    assert v["passed"] is (check in ("spread_outliers",)) and check in v["failures"]


def test_missing_series_fails(spark):
    rep = quality.data_quality(q_bars(spark, [["E", "1h", dt.datetime(2025, 6, 2, 8), 1.0, 1.1, 0.1, 0]]), 3600)
    want = spark.createDataFrame([("E", "1h"), ("G", "1h")], "symbol STRING, timeframe STRING")
    bad = quality.verdict(quality.with_missing_series(rep, want)).where("NOT passed").collect()
    assert [(r["symbol"], r["failures"]) for r in bad] == [("G", ["non_empty"])]


def test_backfill_helpers(spark):
    b = bars(spark, walk(10, 1, "X"))
    old, hwm = b.limit(0), b.groupBy("symbol", "timeframe").agg(F.min("ts").alias("hwm"))
    assert br.new_bars(b, hwm).count() == 9 and br.new_bars(b, hwm.limit(0)).count() == 10
    assert br.merge_backfill(old, b).count() == 10
    assert br.gap_windows(b, 60, F.lit("2024-01-01 10:00:00").cast("timestamp")).count() == 0
    assert br.gap_windows(b, 60, F.lit("2024-01-01 11:00:00").cast("timestamp")).count() == 1
    with pytest.raises(ValueError):
        br.resample_bars(b, 7)


def test_timeframe_fanout_and_month_end(spark, tmp_path):
    root = str(tmp_path / "tf")
    b = bars(spark, walk(24 * 40, 3, "EUR/USD", step=60)).withColumns(
        {"volume": F.lit(1.0), "bid": F.col("close") - 0.5, "ask": F.col("close") + 0.5, "spread": F.lit(1.0)})
    tables.write_timeframes(b, root, ["1h", "4h"])
    got = dict(tables.read_bars(spark, root).groupBy("timeframe").count().collect())
    assert got == {"1h": 960, "4h": 240}
    four = tables.read_bars(spark, root).where("timeframe = '4h'").orderBy("ts").first()
    one = b.orderBy("ts").limit(4).collect()
    assert four["open"] == one[0]["open"] and four["close"] == one[3]["close"] and four["volume"] == 4.0
    n, kept = tables.archive_and_purge(b.select("ts", "close"), 2024, 1, str(tmp_path / "jan"))
    assert n == 31 * 24 and kept.count() == 9 * 24 and spark.read.parquet(str(tmp_path / "jan")).count() == n


def test_json_text(spark):
    from tapeworks.functions import scalars as sc

    r = spark.range(1).select(
        sc.prefs_json(F.struct(F.array(F.lit("b"), F.lit("a")).alias("pairs"), F.array(F.lit("X")).alias("sessions"), F.lit(5).alias("min_score"))).alias("p"),
        sc.weights_json(F.lit(30), F.lit(30), F.lit(20), F.lit(20)).alias("w"), sc.weights_json(F.lit(1), F.lit(1), F.lit(1), F.lit(1)).alias("bad"),
        sc.normalize_symbol(F.lit("XAU_USD")).alias("a"), sc.normalize_symbol(F.lit("XAUUSD")).alias("b"), sc.normalize_symbol(F.lit("nope")).alias("c"),
        sc.bars_held(F.lit(36_000)).alias("h"), sc.score_structure(F.lit("LONG"), F.lit("LONG"), F.lit("LONG"), 25).alias("s")).first()
    assert json.loads(r["p"]) == {"pairs": ["a", "b"], "sessions": ["X"], "min_score": 5}
    assert json.loads(r["w"])["cost"] == 20 and r["bad"] is None
    assert (r["a"], r["b"], r["c"], r["h"], r["s"]) == ("XAU/USD", "XAU/USD", None, 2, 25)


def test_archives_by_day_with_pushed_filters(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    rows = [(s, T0 + dt.timedelta(hours=h, milliseconds=i), 10 * h + i, 1.5 + i, 1.25 + h, 2.0, 0.5) for s in ("AB", "CD") for h in (0, 1, 5, 30, 31) for i in range(3)]
    root = str(tmp_path / "ticks")
    assert ticks.write_tick_archives(spark.createDataFrame(rows, ticks.TICK_DDL).repartition(3), root) == 10
    got = ticks.tick_archives(spark, root)
    assert sorted((r.symbol, r.ts, r.ask, r.bid) for r in got.collect()) == sorted((s, t, a, b) for s, t, _, a, b, *_ in rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ticks.read_tick_archives(spark, root).collect()))
    some = got.where((F.col("symbol") == "CD") & (F.col("ts") >= T0 + dt.timedelta(hours=5)) & (F.col("ts") < T0 + dt.timedelta(hours=31)))
    assert sorted(r.ts.hour for r in some.collect()) == [5, 5, 5, 6, 6, 6]
    reader = ticks._Reader(root)
    at = T0.replace(tzinfo=dt.timezone.utc)
    kept = list(reader.pushFilters([EqualTo(("symbol",), "CD"), GreaterThanOrEqual(("ts",), at + dt.timedelta(hours=5)), LessThan(("ts",), at + dt.timedelta(hours=31))]))
    assert len(kept) == 2 and [len(p.files) for p in reader.partitions()] == [1, 2]  # hours 5, and 30 and 31
    assert ticks.tick_archives(spark, str(tmp_path / "none")).count() == 0
