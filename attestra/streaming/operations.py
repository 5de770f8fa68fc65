"""Operation logs as streams: the current state of each operation, and counts by hour, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "operation_id string, operation_type string, status string, at timestamp"


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """A stream of the JSON lines that arrive below ``path``; lines without an id or time are left out."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.where("operation_id is not null and at is not null")


def latest_states(log: DataFrame) -> DataFrame:
    """(operation_id, status, at): the newest status of each operation, ties by status; for update or complete output.

    State is one row an operation, whatever the number of its events.
    """
    newest = F.max(F.struct("at", "status"))
    return log.groupBy("operation_id").agg(newest.alias("x")).select("operation_id", "x.status", "x.at")


def hourly_counts(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, operation_type, status, n): distinct events by hour; an hour is final once the watermark has passed it."""
    once = log.withWatermark("at", late).dropDuplicatesWithinWatermark(["operation_id", "status"])
    hours = once.groupBy(F.window("at", "1 hour"), "operation_type", "status").agg(F.count("*").alias("n"))
    return hours.select(F.col("window.start").alias("hour"), "operation_type", "status", "n")
