"""The folder that the driver and all executors see, and cutting a plan's lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where all share one disk, a temporary folder may stand in for an absent setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, and read again if an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_absent(df: DataFrame, key: Column) -> Column:
    """A string key to left-join ``df`` by: rows where it is null get keys of their own, which match nothing, so that they are
    dealt to all tasks and not to one. They are told apart by their columns of numbers and times.
    """
    own = [f.name for f in df.schema if isinstance(f.dataType, P.NumericType | P.DatetimeType)]
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(F.lit(0), *own).cast("string")))
