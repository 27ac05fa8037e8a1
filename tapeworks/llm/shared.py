"""Written tables in the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = "spark.checkpoint.dir"


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary folder only where a local session has none."""
    root = spark.conf.get(CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CONF} to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="llm-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(CONF, root)
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once and read back from the shared folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; reads one column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()["b"]


def parts(total: int, each: int, least: int = 1) -> int:
    """How many parts of `each` make up `total`."""
    return max(least, -(-int(total) // each))


def group_of(n: int, *cols: Column) -> Column:
    """0..n-1 by hash; nulls have a group too."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
