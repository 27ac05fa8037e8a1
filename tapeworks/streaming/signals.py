"""The scored-signal job of a live stream: one batch of closed bars in, decided signals out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions import scalars as sc
from tapeworks.functions.timeexpr import primary_session
from tapeworks.operators import fanout, joins, scan
from tapeworks.operators import signal_store as store
from tapeworks.operators.bars import resample_bars
from tapeworks.operators.series import index_series
from tapeworks.sources.tables import read_bars, write_bars
from tapeworks.storage import materialize

KEYS = ("symbol", "timeframe")
_HISTORY = (
    "id STRING, symbol STRING, ts TIMESTAMP, direction STRING, h4_ts TIMESTAMP, status STRING, "
    "score_total INT, reject_reason STRING"
)


@dataclass(frozen=True)
class ScanJob:
    """foreachBatch body: store bars, scan, score, attach confidence, gate, append.

    Replays are harmless: bars are upserted and signals carry an id made from the bar's own
    instant, so known ids are skipped.
    """

    bar_root: str
    signal_root: str
    news: DataFrame | None = None
    halted: DataFrame | None = None
    threshold: int = 50
    lookback_days: int | None = None  # None: indicators see all bars of the batch's symbols
    scan_params: dict | None = None
    deliver: Callable[[DataFrame], None] | None = None

    def __call__(self, batch: DataFrame, epoch: int) -> None:  # noqa: ARG002
        spark = batch.sparkSession
        batch = materialize(batch.withColumn("timeframe", F.lit("15m")))
        write_bars(batch, self.bar_root, upsert=True)
        signals = materialize(self.decide(spark, batch))
        fresh = materialize(store.insert_ignore(self.history(spark), signals))
        fresh.write.mode("append").parquet(self.signal_root)
        if self.deliver is not None:
            self.deliver(fresh.where(F.col("reject_reason").isNull()))

    def history(self, spark: SparkSession) -> DataFrame:
        """Stored signals; empty before the first batch."""
        try:
            return spark.read.schema(_HISTORY).parquet(self.signal_root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _HISTORY)

    def decide(self, spark: SparkSession, batch: DataFrame) -> DataFrame:
        """Every decision row of the batch with score, confidence and reject reason."""
        touched = batch.groupBy("symbol").agg(F.max("ts").alias("_last"))
        fine = read_bars(spark, self.bar_root).where("timeframe = '15m'").drop("year", "month").join(touched, "symbol")
        if self.lookback_days is not None:
            fine = fine.where(F.col("ts") > F.col("_last") - F.make_dt_interval(days=F.lit(self.lookback_days)))
        fine = materialize(fine.drop("_last"))
        m15 = index_series(fine, KEYS)
        h1, h4 = (index_series(resample_bars(fine, m), KEYS) for m in (60, 240))
        at = batch.select("symbol", (F.col("ts") + F.make_dt_interval(mins=F.lit(15))).alias("ts"))
        s = materialize(scan.scored(scan.confluence_scan(h4, h1, m15, at, **(self.scan_params or {}))))
        s = s.withColumn("id", sc.signal_id(F.col("symbol"), F.col("ts"), F.lit("15m_scan")))
        past = self.history(spark)
        s = self._gates(s, past)
        sent = past.where(F.col("reject_reason").isNull()).select("symbol", "direction", "h4_ts", "ts")
        sent = sent.join(s.select("symbol", "h4_ts").distinct(), ["symbol", "h4_ts"], "left_semi")
        return store.alert_decision(s, threshold=self.threshold, sent=sent).withColumns({
            "source": F.lit("15m_scan"), "status": F.lit("pending"),
            "session": primary_session(F.col("ts"))})

    def _gates(self, s: DataFrame, past: DataFrame) -> DataFrame:
        s = store.with_confidence(s, store.confidence_table(past))
        if self.news is None:
            s = s.withColumn("news_blocked", F.lit(False))
        else:
            hit = joins.blackout(s.select("symbol", "ts"), self.news).withColumn("news_blocked", F.lit(True))
            s = s.join(hit.distinct(), ["symbol", "ts"], "left").fillna({"news_blocked": False})
        if self.halted is None:
            s = s.withColumn("halted", F.lit(False))
        else:
            s = s.join(self.halted.select("symbol").distinct().withColumn("halted", F.lit(True)),
                       "symbol", "left").fillna({"halted": False})
        return s


def deliver_to(users: DataFrame, sink: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """Fan a batch of accepted signals out to subscribers, one scheduled row per recipient."""

    def run(accepted: DataFrame) -> None:
        sink(fanout.select_recipients(accepted, users))

    return run
