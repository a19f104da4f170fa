"""Tables that outlive any executor: written to the folder all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lodestone-')}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; under a folder of our own where that is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(given or _own_dir()).rstrip('/')}/lodestone/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: computed once, with sizes for the planner."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
