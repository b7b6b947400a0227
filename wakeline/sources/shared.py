"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_folder() -> tempfile.TemporaryDirectory:
    """A folder of this process, which goes when it ends."""
    return tempfile.TemporaryDirectory(prefix="positions-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in ``spark.checkpoint.dir``; only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = own_folder().name
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table and read back, so that several results need one run of ``df``."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
