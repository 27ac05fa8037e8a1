"""Registry of queries: a Spark callable and, where possible, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, TimestampType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, digits: int = 6, dates: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``. Doubles are rounded; timestamps and dates leave as UTC
    wall time. ``dates`` names the SQL's date columns, which become timestamps too."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = fn(spark, sf_dir)
            cols = []
            for f in df.schema.fields:
                c = F.col(f"`{f.name}`")
                if isinstance(f.dataType, DoubleType):
                    c = F.round(c, digits)
                elif isinstance(f.dataType, TimestampType | DateType):
                    c = c.cast("timestamp_ntz")
                cols.append(c.alias(f.name))
            return df.select(*cols)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            swap = ", ".join(f"CAST({d} AS TIMESTAMP) AS {d}" for d in dates)
            ORACLES[name] = f"SELECT * REPLACE ({swap}) FROM ({oracle})" if dates else oracle
        return fn

    return wrap
