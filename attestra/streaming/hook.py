"""A hook after publishing: every published asset is scanned once, whatever is replayed, and failures are rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "asset_id string, status string, error string"


def _exists(df: DataFrame, path: str) -> bool:
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where)


def scan_batch(scan: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that scans the assets of a batch (column asset_id) once.

    ``scan`` gives candidates, with asset_id the published asset that led to them. They are written below
    ``out/candidates/batch=<id>``, then one status row an asset below ``out/status/batch=<id>``: ``completed``,
    ``completed_no_relation``, or ``failed_retryable`` with the error where the scan fails. A failed scan leaves no
    candidates and never stops the stream. Statuses are written last, so a batch that has them is done: replaying it
    adds nothing, and one that broke off before is written anew. Assets that repeat in a batch have one status.
    """

    def run(batch: DataFrame, number: int) -> None:
        status, found = f"{out}/status/batch={number}", f"{out}/candidates/batch={number}"
        if _exists(batch, f"{status}/_SUCCESS"):
            return
        assets = batch.select("asset_id").distinct()
        error = None
        try:
            scan(batch).write.mode("overwrite").parquet(found)
            had = batch.sparkSession.read.parquet(found).select("asset_id").distinct().withColumn("had", F.lit(True))
            rows = assets.join(had, "asset_id", "left").select("asset_id", F.when(F.col("had"), "completed").otherwise("completed_no_relation").alias("status"), F.lit(None).cast("string").alias("error"))
        except Exception as e:  # the hook must not block publishing; the row says why
            error = str(e).split("\n", 1)[0][:500]
            where = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(found)
            where.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            rows = assets.select("asset_id", F.lit("failed_retryable").alias("status"), F.lit(error).alias("error"))
        rows.write.mode("overwrite").parquet(status)

    return run


def after_publish(published: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger):
    """Start the hook on a stream of published assets; ``trigger`` is that of the stream writer."""
    return published.writeStream.foreachBatch(scan_batch(scan, out)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retryable(statuses: DataFrame) -> DataFrame:
    """Assets whose newest status is a failure: asset_id and error. ``statuses``: the status table, with its batch."""
    last = statuses.groupBy("asset_id").agg(F.max_by(F.struct("status", "error"), "batch").alias("x"))
    return last.where("x.status = 'failed_retryable'").select("asset_id", "x.error")
