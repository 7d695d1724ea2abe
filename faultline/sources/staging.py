"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one, but only if Spark itself is local, as in tests."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(os.environ.get("TMPDIR", "/tmp"), "faultline-checkpoints")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over as many tasks as spark.sql.shuffle.partitions says, by keys if there are any.

    For steps whose work is large for their bytes: Spark would join their partitions by size, or read a file's row group in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def staged(df: DataFrame) -> DataFrame:
    """The frame, computed once and written as a table, so that plans that read it stay short and a lost executor loses none of it.

    Unlike checkpoint() it is compressed and read by column.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4()}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def weighed(table: DataFrame, weight: Column, limit: int) -> DataFrame:
    """A written table that isn't broadcast if its rows weigh more than `limit` in all: Spark takes the size of its compressed files for it."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    return table.hint("merge") if total > limit else table
