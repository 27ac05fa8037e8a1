"""Bar, signal and archive tables on Parquet."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.schemas import BAR_DDL, schema
from tapeworks.storage import materialize

PARTITIONS = ["symbol", "timeframe", "year", "month"]


def _month_index(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def _stamped(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"year": F.year("ts"), "month": F.month("ts")})


def write_bars(bars: DataFrame, root: str, *, upsert: bool = False) -> None:
    """Replace exactly the symbol/timeframe/months present in ``bars``; with ``upsert`` keep
    their other rows.

    One task per touched month and series keeps files whole and sorted by time; a month of
    bars is bounded by the calendar.
    """
    names = schema(BAR_DDL).names
    full = bars
    for n in names:
        if n not in full.columns:
            full = full.withColumn(n, F.lit(None).cast(schema(BAR_DDL)[n].dataType))
    full = _stamped(full.select(*names))
    old = _stored(bars.sparkSession, root) if upsert else None
    if old is not None:
        touched = full.select(*PARTITIONS).distinct()
        keep = old.join(touched, PARTITIONS, "left_semi").join(
            full.select("symbol", "timeframe", "ts"), ["symbol", "timeframe", "ts"], "left_anti")
        full = materialize(full.unionByName(keep.select(*full.columns)))
    (
        full.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "ts")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(root)
    )


def _stored_schema():
    return schema(BAR_DDL + ", year INT, month INT")


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_stored_schema()).parquet(root)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """Whole bar table; empty when nothing was written. Missing volume is 0, missing source
    is 'dukascopy'."""
    stored = _stored(spark, root)
    if stored is None:
        return spark.createDataFrame([], schema(BAR_DDL))
    return (
        stored.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
        .withColumn("source", F.coalesce("source", F.lit("dukascopy")))
    )


def read_month(spark: SparkSession, root: str, symbol: str, timeframe: str, year: int, month: int) -> DataFrame:
    df = read_bars(spark, root)
    if "year" not in df.columns:
        return df
    hit = (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)
    return df.where(hit & (F.col("year") == year) & (F.col("month") == month)).drop("year", "month")


def load_bars(spark: SparkSession, root: str, symbol: str, timeframe: str, start: datetime,
              end: datetime, *, closed: str = "both") -> DataFrame:
    """Bars of one series in [start, end] (or [start, end)), bounds cut to whole seconds.

    The range is repeated as a predicate on the year and month partitions, which Catalyst
    cannot derive, so files outside it are never listed into the scan.
    """
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("range bounds must carry a time zone")
    lo, hi = start.replace(microsecond=0), end.replace(microsecond=0)
    df = read_bars(spark, root).where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    if "year" in df.columns:
        at = F.col("year") * 12 + F.col("month")
        df = df.where((at >= _utc_month(lo)) & (at <= _utc_month(hi))).drop("year", "month")
    upper = F.col("ts") <= F.lit(hi) if closed == "both" else F.col("ts") < F.lit(hi)
    return df.where((F.col("ts") >= F.lit(lo)) & upper).orderBy("ts")


def _utc_month(t: datetime) -> int:
    from datetime import UTC

    u = t.astimezone(UTC)
    return u.year * 12 + u.month


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last in ``order``; deterministic."""
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def archive_months(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Rows into year/month partitions, each month sorted by time."""
    stamped = rows.withColumns({"year": F.year(ts), "month": F.month(ts)})
    # A month may be large: range partitioning splits it and keeps its files in time order.
    (
        stamped.repartitionByRange("year", "month", ts).sortWithinPartitions("year", "month", ts)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month").parquet(path)
    )


def write_timeframes(bars: DataFrame, root: str, timeframes: list[str]) -> None:
    """One fine bar set resampled to every timeframe and written in a single pass."""
    from tapeworks.operators.bars import resample_many

    write_bars(resample_many(bars, timeframes), root)


def export_month(rows: DataFrame, year: int, month: int, path: str) -> int:
    """One calendar month sorted by time into Parquet; gives the number of rows."""
    from tapeworks.operators.signal_store import month_rows

    seen = Observation()
    # observed above the sort: range partitioning samples the rows below it a second time
    month_rows(rows, year, month).orderBy("ts").observe(seen, F.count(F.lit(1)).alias("n")).write.mode(
        "overwrite").parquet(path)
    return seen.get["n"]


def archive_and_purge(table: DataFrame, year: int, month: int, archive: str) -> tuple[int, DataFrame]:
    """Month-end job: export the month, then the rows that stay (everything from the next month)."""
    from tapeworks.operators.signal_store import kept_after_purge

    n = export_month(table, year, month, archive)
    nxt = (year + month // 12, month % 12 + 1)
    return n, materialize(kept_after_purge(table, *nxt))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)
