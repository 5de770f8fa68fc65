"""Results of transcript providers as JSON of any shape, cut down to the fields that may be kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.text import squeeze
from attestra.operators.chunks import PROTOCOL

# Fixed values that results depend on.
STATUSES = ("completed", "partial")
METADATA = ("bridge_version", "funasr_version", "model_location", "environment_location", "device", "network_access")
CHUNKING = ("strategy", "chunk_seconds", "chunk_count", "segment_timeout_seconds", "max_retries", "chunks")


def _text(value: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "string"), F.lit(""))


def _some(value: Column, root: str, fields: tuple[str, ...]) -> Column:
    """The listed fields of an object, each as it is; absent ones stay absent in JSON."""
    return F.struct(*[F.try_variant_get(value, f"$.{root}.{f}", "variant").alias(f) for f in fields])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sanitized(result: Column, reference: Column) -> Column:
    """(problem, segments, result) of a provider's JSON text: ``result`` is JSON of the allowed fields, null if there is a problem.

    Problems, the first that holds: ``unreadable`` (null or not JSON), ``protocol_or_status``, ``text_blank``, ``no_segments``. A
    segment stays if its text isn't blank and its end lies after its start (absent ones count as 0; what is no number drops the
    segment); one without an id gets one from its place among all. Texts are squeezed, ``reference`` replaces the
    recording's place, and machine paths in the metadata and chunking go with every field that isn't listed. Confidence, timestamps,
    missing ranges, warnings and listed fields are kept as they came, whatever their type. ``segments`` counts those kept.
    """
    return _once(F.try_parse_json(result), lambda v: _once(_segments(v), lambda kept: _allowed(v, kept, reference)))


def _segments(v: Column) -> Column:
    """The segments that stay."""
    whole = F.try_variant_get(v, "$.segments", "array<variant>")

    def segment(x: Column, i: Column) -> Column:
        number = lambda f: F.when(F.try_variant_get(x, f"$.{f}", "variant").isNull(), 0.0).otherwise(F.try_variant_get(x, f"$.{f}", "double"))
        own = _text(x, "segment_id")
        return F.struct(
            F.when(own != "", own).otherwise(F.format_string("transcript-%03d", i + 1)).alias("segment_id"), number("start_time").alias("start_time"), number("end_time").alias("end_time"),
            _text(x, "start_timestamp").alias("start_timestamp"), _text(x, "end_timestamp").alias("end_timestamp"), squeeze(_text(x, "text")).alias("text"),
            F.try_variant_get(x, "$.confidence", "variant").alias("confidence"),
        )

    return F.filter(F.transform(F.coalesce(whole, F.array().cast("array<variant>")), segment), lambda s: F.coalesce((s["text"] != "") & (s["end_time"] > s["start_time"]), F.lit(False)))


def _allowed(v: Column, kept: Column, reference: Column) -> Column:
    """The struct that ``sanitized`` returns."""
    named = lambda f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit("unknown")).alias(f)
    raw = lambda f: F.coalesce(F.try_variant_get(v, f"$.{f}", "variant"), F.parse_json(F.lit("[]"))).alias(f)
    problem = (
        F.when(v.isNull(), "unreadable").when((_text(v, "protocol") != PROTOCOL) | ~_text(v, "status").isin(*STATUSES), "protocol_or_status")
        .when(squeeze(_text(v, "text")) == "", "text_blank").when(F.size(kept) == 0, "no_segments")
    )
    out = F.to_json(F.struct(
        F.lit(PROTOCOL).alias("protocol"), F.lit("TranscriptResult").alias("result_type"), named("provider"), named("model"), named("language"), _text(v, "status").alias("status"),
        reference.alias("source_reference"), squeeze(_text(v, "text")).alias("text"), F.try_variant_get(v, "$.timestamp", "variant").alias("timestamp"), kept.alias("segments"), F.lit(True).alias("timestamps"),
        _some(v, "provider_metadata", METADATA).alias("provider_metadata"), raw("missing_ranges"), _some(v, "chunking", CHUNKING).alias("chunking"), raw("warnings"),
    ))
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), F.size(kept)).otherwise(0).cast("long").alias("segments"), F.when(problem.isNull(), out).alias("result"))
