"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written Parquet table cuts lineage, survives the loss of executors, keeps column
pruning and gives Catalyst real file sizes for its join choices.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; for local masters without one a temporary folder that goes at exit."""
    path = spark.conf.get(_CONF, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="tapeworks-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set(_CONF, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Like :func:`materialize`, plus the row count observed while writing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tapeworks/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, to be grouped together with kin of theirs."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
