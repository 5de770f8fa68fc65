"""Operation logs as SQL: table functions that look up, find and reconcile operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import state as M

_NAMES = ("operation_id", "operation_type", "started_at", "status", "completed_at")


def register(events: DataFrame, evidence: DataFrame, prefix: str = "operation") -> None:
    """Register SQL table functions over an operation log, for the session.

    ``events``: rows of the log as ``state.current_operations`` takes them (operation_id, operation_type, started_at, completed_at,
    status) and the reference lists. ``evidence``: operation_id, canonical_status.

    - ``<prefix>_get(id)``: the current state of one operation; no row if it is unknown.
    - ``<prefix>_find(reference, type)``: operations with a reference in any list; a null type finds every type.
    - ``<prefix>_reconcile(id)``: id, status and canonical status of one operation against the evidence.

    They are SQL functions over views, so Spark plans a call like the query it stands for: filters reach the scan, and a
    lateral call is a join. Nothing runs until a query calls them.
    """
    spark = events.sparkSession
    current = M.current_operations(events)
    current.select(*[F.col(c).cast("string").alias(c) for c in _NAMES]).createOrReplaceTempView(f"{prefix}_current")
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in M.REFERENCE_COLUMNS]
    refs = events.select("operation_id", "operation_type", F.explode(F.array_distinct(F.flatten(F.array(*lists)))).alias("reference")).distinct()
    refs.createOrReplaceTempView(f"{prefix}_references")
    M.reconcile_operations(current, evidence).select("operation_id", "status", "canonical_status").createOrReplaceTempView(f"{prefix}_reconciled")
    columns = ", ".join(f"{c} string" for c in _NAMES)
    spark.sql(f"create or replace temporary function {prefix}_get(wanted string) returns table ({columns}) return select {', '.join(_NAMES)} from {prefix}_current where operation_id = wanted")
    spark.sql(
        f"create or replace temporary function {prefix}_find(wanted string, kind string) returns table (operation_id string, operation_type string) "
        f"return select operation_id, operation_type from {prefix}_references where reference = wanted and (kind is null or operation_type = kind)"
    )
    spark.sql(
        f"create or replace temporary function {prefix}_reconcile(wanted string) returns table (operation_id string, status string, canonical_status string) "
        f"return select operation_id, status, canonical_status from {prefix}_reconciled where operation_id = wanted"
    )
