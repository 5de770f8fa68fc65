"""Keyed state: observation pools, exception queues, operation logs, pointers. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.identity import HEX64

# Fixed values that results depend on.
OPERATION_TYPES = ("capture", "transcript", "source_reconciliation", "organize", "publish", "relation_curation")
TERMINAL = ("completed", "failed", "partial", "blocked", "interrupted", "needs_reconciliation")
REFERENCE_COLUMNS = ("input_refs", "output_refs", "receipt_refs", "stage_refs", "change_refs")


def observe(pool: DataFrame, seen: DataFrame, strong: DataFrame, now: str, expiry_days: int = 90) -> DataFrame:
    """The pool after a run: seen candidates are counted and observed again, those now strong promoted, those unseen
    for ``expiry_days`` expired. ``pool``: candidate_id, first_seen, last_seen, times_detected, current_status; ``seen`` and ``strong``: candidate_id."""
    s = seen.select("candidate_id", F.lit(True).alias("again")).distinct()
    g = strong.select("candidate_id", F.lit(True).alias("won")).distinct()
    j = pool.join(s, "candidate_id", "full").join(g, "candidate_id", "left")
    again, won = F.coalesce("again", F.lit(False)), F.coalesce("won", F.lit(False))
    old = F.coalesce(F.col("last_seen").try_cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"interval {expiry_days} days"), F.lit(True))
    status = F.when(again, "observing").otherwise(F.col("current_status"))
    open_ = status == "observing"
    final = F.when(won & open_, "promoted").when(open_ & ~again & old, "expired").otherwise(status)
    touched = again | (open_ & (won | old))
    return j.select(
        "candidate_id", F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(touched, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("times_detected", F.lit(0)) + again.cast("int")).cast("long").alias("times_detected"), final.alias("current_status"),
    )


def resolve_exceptions(queue: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The queue after an audit: found ones are updated and keep when they were first seen; open ones not found are resolved."""
    f = found.select("exception_id", F.col("problem").alias("new_problem"), F.lit(True).alias("here")).dropDuplicates(["exception_id"])
    j = queue.join(f, "exception_id", "full")
    here = F.coalesce("here", F.lit(False))
    gone = ~here & (F.col("status") == "open")
    return j.select(
        "exception_id", F.coalesce("new_problem", "problem").alias("problem"), F.when(here, "open").when(gone, "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.when(here | gone, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def valid_operation(scheme: str) -> Column:
    """Whether a log row is sound: id, type, status, references, and no secret that isn't redacted."""
    kinds = "|".join(OPERATION_TYPES)
    refs = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in REFERENCE_COLUMNS]))
    stable = F.forall(refs, lambda r: r.rlike(f"^{scheme}://[A-Za-z0-9._~:/-]+\\z"))
    text = F.to_json(F.struct(*REFERENCE_COLUMNS, "failure_detail"))
    clean = ~T.leaks_credentials(text) | F.contains(text, F.lit("[REDACTED]"))
    return F.coalesce(
        F.col("operation_id").rlike(f"^op_({kinds})_[0-9a-f]{{32}}\\z") & F.col("operation_type").isin(*OPERATION_TYPES) & F.col("status").isin("started", *TERMINAL) & stable & clean, F.lit(False)
    )


def current_operations(events: DataFrame) -> DataFrame:
    """One row an operation: the first terminal event wins, else the start; a later other end is noted as conflicting."""
    terminal = F.col("status").isin(*TERMINAL)
    e = events.withColumn("terminal", terminal)
    x = F.struct("status", "completed_at", "started_at")
    g = e.groupBy("operation_id", "operation_type").agg(
        F.min("started_at").alias("started_at"),
        F.min_by(x, F.when(F.col("terminal"), F.col("completed_at"))).alias("end"),
        (F.size(F.collect_set(F.when(F.col("terminal"), F.col("status")))) > 1).alias("conflicting"),
    )
    done = F.col("end.completed_at").isNotNull()
    return g.select(
        "operation_id", "operation_type", "started_at", F.when(done, F.col("end.status")).otherwise("started").alias("status"),
        F.when(done, F.col("end.completed_at")).alias("completed_at"), F.when(done, T.duration_ms(F.col("started_at"), F.col("end.completed_at"))).alias("duration_ms"), "conflicting",
    )


def reconcile_operations(operations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Operations against canonical evidence (operation_id, canonical_status): missing and started ones take it, unknown
    evidence and conflicts need reconciliation."""
    j = operations.join(evidence, "operation_id", "full")
    known = F.col("canonical_status").isin("completed", "failed", "partial", "blocked")
    ended = F.col("status").isin(*TERMINAL)
    has = F.col("evidence").isNotNull() if "evidence" in evidence.columns else F.col("canonical_status").isNotNull()
    status = (
        F.when(ended & known & (F.col("status") != F.col("canonical_status")), "needs_reconciliation").when(ended, F.col("status"))
        .when(known, F.col("canonical_status")).when(has, "needs_reconciliation").otherwise(F.col("status"))
    )
    return j.withColumn("status", status)


def find_operations(operations: DataFrame, reference: str, operation_type: str | None = None, started_after: str | None = None) -> DataFrame:
    """Log rows that mention a reference in any of their five lists, in the order of their starts."""
    out = operations.where(F.array_contains(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in REFERENCE_COLUMNS])), reference))
    if operation_type:
        out = out.where(F.col("operation_type") == operation_type)
    if started_after:
        out = out.where(F.col("started_at") >= started_after)
    return out.orderBy("started_at")


def current_revisions(revisions: DataFrame) -> DataFrame:
    """The newest committed revision of each material."""
    return revisions.groupBy("material_id").agg(F.max_by("revision_id", "committed_at").alias("revision_id"), F.max("committed_at").alias("committed_at"))


def put_objects(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Content objects that the store lacks, one a hash."""
    return new.dropDuplicates(["content_hash"]).join(existing.select("content_hash"), "content_hash", "left_anti")


def append_unknown(entries: DataFrame, new: DataFrame, key: str = "reference") -> DataFrame:
    """Entries and those of ``new`` whose key they lack."""
    return entries.unionByName(new.dropDuplicates([key]).join(entries.select(key).distinct(), key, "left_anti").select(*entries.columns))


def missing_references(rows: DataFrame, manifest: DataFrame, key: str = "reference") -> DataFrame:
    """Rows whose reference no manifest entry has."""
    return rows.join(manifest.select(key).distinct(), key, "left_anti")


def hash_mismatches(rows: DataFrame, manifest: DataFrame, key: str = "reference", value: str = "content_hash") -> DataFrame:
    """Rows whose hash differs from their manifest entry's."""
    m = manifest.select(key, F.col(value).alias("stored"))
    return rows.join(m, key).where(F.col(value) != F.col("stored"))


def valid_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^sha256:{HEX64}\\z"), F.lit(False))


def admission(candidates: DataFrame) -> Column:
    """First reason why a candidate can't be admitted by the gate of its type, null if it can. Columns: asset_type, status,
    gate_status, title, markdown, time_sensitive, external_change, independent_sources, fields, ai_invented, validation, user_intent."""
    need = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), F.coalesce("fields", F.array().cast("array<string>")))) > 0
    kind, yes = F.col("asset_type"), lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~kind.isin("intelligence_brief", "method_asset", "creation_asset"), "unsupported_type")
        .when((F.col("status") != "publishable") | (F.col("gate_status") != "passed"), "not_publishable")
        .when(F.btrim(F.coalesce("title", F.lit(""))) == "", "title_required")
        .when(F.btrim(F.coalesce("markdown", F.lit(""))) == "", "markdown_required")
        .when((kind == "intelligence_brief") & ~(yes("time_sensitive") & yes("external_change")), "time_sensitivity_required")
        .when((kind == "intelligence_brief") & (F.coalesce("independent_sources", F.lit(0)) < 2), "two_sources_required")
        .when((kind == "method_asset") & need("purpose", "inputs", "preconditions", "steps", "outputs", "limitations", "applicability", "failure_conditions", "source_basis"), "procedural_fields_required")
        .when((kind == "method_asset") & (yes("ai_invented") | ~F.coalesce(F.col("validation").isin("passed", "not_required"), F.lit(False))), "method_not_validated")
        .when((kind == "creation_asset") & need("audience", "purpose", "deliverable", "version"), "creation_fields_required")
        .when((kind == "creation_asset") & ~yes("user_intent"), "user_intent_required")
    )
