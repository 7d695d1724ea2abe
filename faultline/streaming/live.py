"""Runs as they arrive: their failures, and their packets (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.parse import distilled_failure, parse_runs
from faultline.plans import packet
from faultline.sources.ingest import RUNS, write_packets


def _arriving(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUNS).json(path)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """run_id, failure of each run that arrives as JSON lines in a folder; no state is kept, since a run is one row."""
    return parse_runs(_arriving(spark, path)).select("run_id", distilled_failure().alias("failure"))


def write_batch(runs: DataFrame, batch: int, repo_files: DataFrame, out: str) -> None:
    """The packets of one batch of runs. Nothing in them depends on when it runs, so a replay writes the same rows."""
    held = runs.dropDuplicates(["run_id"])
    built = packet.build(held, repo_files, created_at=F.timestamp_seconds(F.lit(0)))
    write_packets(built["packets"], built["files"], out, batch)


def packets(spark: SparkSession, path: str, repo_files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the packets of the runs that arrive in a folder; ends when all that is there has been read."""
    writer = _arriving(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda runs, batch: write_batch(runs, batch, repo_files, out)).start()
