"""Test runs as a stream: late and repeated rows, windowed figures, and the batch transforms per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.common import blanks


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def windowed(runs: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Runs and failures per repo and window of started_at; a ci_run_id counts once, rows later than ``late`` are dropped."""
    once = runs.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late).dropDuplicatesWithinWatermark(["ci_run_id"])
    failed = F.upper(blanks("test_result")) == "FAILED"
    return once.groupBy(F.window("started_at", width), "repo").agg(F.count("*").alias("n_runs"), F.count_if(failed).alias("n_failures")).select(
        F.col("window.start").alias("window_start"), "repo", "n_runs", "n_failures"
    )


def start(df: DataFrame, name: str, checkpoint: str):
    return df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
