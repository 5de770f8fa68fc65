"""Recordings in chunks: a cache of provider results, retries of failed chunks only, and one clock over all chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import text as T
from attestra.runtime import discard, materialise

PROTOCOL = "transcript-provider-v1"
SEGMENTS = "array<struct<start_time:double,end_time:double,text:string>>"
#: Chunks of a recording whose sums one task of a window adds up.
BLOCK = 4096


def _filled(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "") != "", F.lit(False))


def complete() -> Column:
    """Whether a result is whole: completed, a text that isn't blank, at least one segment."""
    return F.coalesce(F.col("status") == "completed", F.lit(False)) & _filled(F.col("text")) & (F.coalesce(F.size("segments"), F.lit(0)) > 0)


def cached_results(cache: DataFrame, identity: str) -> DataFrame:
    """(chunk_hash, text, segments) of a cache (chunk_hash, provider_identity, protocol, status, text, segments): whole results of
    this very provider. Results of one chunk that differ give the smallest text."""
    own = cache.where((F.col("provider_identity") == identity) & (F.col("protocol") == PROTOCOL) & complete())
    return own.groupBy("chunk_hash").agg(F.min(F.struct("text", "segments")).alias("r")).select("chunk_hash", "r.*")


def transcribe(
    chunks: DataFrame, cache: DataFrame, provider: Callable[[DataFrame, int], DataFrame], identity: str, max_retries: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Results of all chunks, and new rows for the cache.

    ``chunks``: owner, chunk (0, 1, 2 ... within an owner), duration, chunk_hash, payload. ``provider(open, attempt)`` gets
    chunk_hash and payload and returns chunk_hash, failure (null if it ran), status, text and segments. A chunk that the
    cache holds isn't sent; equal chunks are sent once. Each round sends only what failed before, ``max_retries`` (0 to 3) more
    times. A row that comes back without a failure and isn't whole is ``transcript_parse_failed``; one that doesn't
    come back is ``asr_process_failed``. Rounds are written, so a lost executor repeats no round before its own.

    Results: owner, chunk, duration, asr_status (completed_cached, completed, completed_after_retry, failed), retry_count,
    failure_reason (the last failure, or empty), text and segments (null where failed). A chunk without a hash fails as
    ``chunk_unreadable`` and isn't sent. No chunks give no rows.
    """
    if not 0 <= max_retries <= 3:
        raise ValueError("max_retries must be between 0 and 3")
    spark, paths = chunks.sparkSession, []

    def write(df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label, "zstd")
        paths.append(path)
        return out

    blank = F.lit("")
    hits = write(cached_results(cache, identity).join(chunks.select("chunk_hash").distinct(), "chunk_hash", "left_semi"), "hits")
    one = chunks.where("chunk_hash is not null").groupBy("chunk_hash").agg(F.any_value("payload").alias("payload"))
    todo = write(one.join(hits, "chunk_hash", "left_anti").withColumn("failure_reason", blank), "open")
    told = hits.select("chunk_hash", F.lit("completed_cached").alias("asr_status"), F.lit(0).alias("retry_count"), blank.alias("failure_reason"), "text", "segments")
    for attempt in range(max_retries + 1):
        if not todo.head(1):
            break
        came = provider(todo.select("chunk_hash", "payload"), attempt).select("chunk_hash", "failure", "status", "text", F.col("segments").cast(SEGMENTS).alias("segments"))
        came = came.withColumn("whole", F.col("failure").isNull() & complete()).withColumn("came", F.lit(True))
        came = came.groupBy("chunk_hash").agg(F.max_by(F.struct("whole", "failure", "came", "text", "segments"), "whole").alias("r")).select("chunk_hash", "r.*")
        tried = write(todo.join(came, "chunk_hash", "left"), "tried")
        good = F.coalesce("whole", F.lit(False))
        state = "completed" if attempt == 0 else "completed_after_retry"
        told = told.unionByName(tried.where(good).select("chunk_hash", F.lit(state).alias("asr_status"), F.lit(attempt).alias("retry_count"), "failure_reason", "text", "segments"))
        why = F.when(F.col("came").isNull(), "asr_process_failed").otherwise(F.coalesce("failure", F.lit("transcript_parse_failed")))
        todo = tried.where(~good).select("chunk_hash", "payload", why.alias("failure_reason"))
    none = lambda kind: F.lit(None).cast(kind)
    told = told.unionByName(todo.select("chunk_hash", F.lit("failed").alias("asr_status"), F.lit(max_retries).alias("retry_count"), "failure_reason", none("string").alias("text"), none(SEGMENTS).alias("segments")))
    joined = chunks.select("owner", "chunk", "duration", "chunk_hash").join(told, "chunk_hash", "left")
    results, _ = materialise(
        joined.select(
            "owner", "chunk", "duration", F.coalesce("asr_status", F.lit("failed")).alias("asr_status"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
            F.coalesce("failure_reason", F.lit("chunk_unreadable")).alias("failure_reason"), "text", "segments",
        ), "results", "zstd",
    )
    new = told.where(F.col("asr_status").isin("completed", "completed_after_retry"))
    fresh, _ = materialise(new.select("chunk_hash", F.lit(identity).alias("provider_identity"), F.lit(PROTOCOL).alias("protocol"), F.lit("completed").alias("status"), "text", "segments"), "fresh", "zstd")
    for path in paths:
        discard(spark, path)
    return results, fresh


def sums_before(rows: DataFrame, key: str, at: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Rows with the sums of ``values`` over the rows of their key with smaller ``at``; 0 for the first.

    ``at`` is a number that is different within a key and without wide gaps. Sums go by blocks of ``at`` first, so a key
    of very many rows is spread: a window holds a block, or one row a block of the key.
    """
    r = rows.withColumns({"_b": F.floor(F.col(at) / block)} | {f"_v_{name}": c for name, c in values.items()})
    sums = r.groupBy(key, "_b").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in values])
    inside = Window.partitionBy(key, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    j = r.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    return j.select(*rows.columns, *[(F.col(f"_o_{name}") + F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0))).alias(name) for name in values])


def clock(results: DataFrame) -> DataFrame:
    """Results with start_time and end_time on the clock of the recording, and ``before``: segments with text in earlier chunks."""
    texts = F.coalesce(F.size(F.filter("segments", lambda s: _filled(s["text"]))), F.lit(0))
    r = sums_before(results, "owner", "chunk", {"offset": F.col("duration"), "before": texts})
    return r.select(*results.columns, "before", "offset", F.round("offset", 3).alias("start_time"), F.round(F.col("offset") + F.col("duration"), 3).alias("end_time"))


def missing_ranges(clocked: DataFrame) -> DataFrame:
    """(owner, start_time, end_time, reason) of every failed chunk of ``clock``."""
    return clocked.where("asr_status = 'failed'").select("owner", "start_time", "end_time", F.col("failure_reason").alias("reason"))


def segments_of(clocked: DataFrame) -> DataFrame:
    """Segments with text on the recording's clock: owner, segment_id, start_time, end_time, start_timestamp, end_timestamp, text.

    A segment's number is its place in its chunk, blank ones counted, after the segments with text of earlier chunks.
    """
    s = clocked.select("owner", "before", "offset", F.posexplode("segments").alias("at", "s")).where(_filled(F.col("s.text")))
    start, end = F.col("s.start_time") + F.col("offset"), F.col("s.end_time") + F.col("offset")
    return s.select(
        "owner", F.format_string("transcript-%04d", F.col("before") + F.col("at") + 1).alias("segment_id"), F.round(start, 3).alias("start_time"), F.round(end, 3).alias("end_time"),
        T.clock_millis(start).alias("start_timestamp"), T.clock_millis(end).alias("end_timestamp"), F.regexp_replace("s.text", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "").alias("text"),
    )


def recordings(results: DataFrame) -> DataFrame:
    """One row an owner: status (completed, partial, failed), chunks, failed, end_time. Nothing of an owner is collected."""
    failed, some = F.count_if(F.col("asr_status") == "failed"), F.bool_or(F.exists(F.coalesce("segments", F.array().cast(SEGMENTS)), lambda s: _filled(s["text"])))
    g = results.groupBy("owner").agg(failed.alias("failed"), some.alias("some"), F.count("*").alias("chunks"), F.round(F.sum("duration"), 3).alias("end_time"))
    status = F.when(F.col("some") & (F.col("failed") == 0), "completed").when(F.col("some"), "partial").otherwise("failed")
    return g.select("owner", status.alias("status"), "chunks", "failed", "end_time")
