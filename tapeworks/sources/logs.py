"""JSON-lines logs: trade journal, tagged records, trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.functions.scalars import bars_held
from tapeworks.schemas import JOURNAL_DDL, RECORD_DDL, TRIAL_DDL, schema
from tapeworks.sources.tables import append_log


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Closed trades; blank and malformed lines are skipped."""
    return spark.read.schema(schema(JOURNAL_DDL)).option("mode", "DROPMALFORMED").json(path)


def append_exits(trades: DataFrame, path: str) -> None:
    """Closed trades as journal lines: missing pnl is 0, bars held in four-hour units."""
    secs = F.unix_timestamp("exit_ts") - F.unix_timestamp("entry_ts")
    full = trades.withColumn("pnl", F.coalesce("pnl", F.lit(0.0))).withColumn("n_bars_held", bars_held(secs))
    append_log(full.select(*schema(JOURNAL_DDL).names), path)


def append_records(rows: DataFrame, path: str, kind: str) -> None:
    """Level or signal records with their type tag."""
    if kind not in ("level", "signal"):
        raise ValueError(kind)
    append_log(rows.withColumn("_type", F.lit(kind)), path)


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.schema(schema(RECORD_DDL)).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("_type") == kind)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial log; a malformed line is an error, blank lines are not."""
    return spark.read.schema(schema(TRIAL_DDL)).option("mode", "FAILFAST").json(path)


def append_trials(rows: DataFrame, path: str) -> None:
    append_log(rows.select(*schema(TRIAL_DDL).names), path)
