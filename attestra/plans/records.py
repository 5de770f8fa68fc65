"""Queries of state, lookups, gates and runs; a part of the catalogue. Rows of the business tables stand in for records."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.operators import lookups as L
from attestra.operators import relations as R
from attestra.operators import runs
from attestra.operators import sequence as S
from attestra.operators import state as M
from attestra.plans.catalog import query
from attestra.runtime import table

TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text(head: str, c) -> F.Column:
    return F.concat(F.lit(head), (F.col(c) if isinstance(c, str) else c).cast("string"))


@query("""with x as (select *, least(o_custkey, (o_custkey * 7 + 1) % 1500) as a, greatest(o_custkey, (o_custkey * 7 + 1) % 1500) as b, left(o_orderpriority, 1) as k from orders),
r as (select distinct a, b, k from x where o_orderstatus = 'F')
select o_orderkey as pair_id, exists(select 1 from r where r.a = x.a and r.b = x.b and r.k = x.k) as known, exists(select 1 from r where r.a = x.a and r.b = x.b and r.k <> x.k) as conflicting from x where o_orderstatus <> 'F'""")
def registry_lookups(spark, sf_dir):
    """Open relations that the registry has, in either direction, and those it contradicts (analogue: finished orders are the registry)."""
    o = table(spark, sf_dir, "orders").withColumns({"source_asset_id": F.col("o_custkey"), "target_asset_id": (F.col("o_custkey") * 7 + 1) % 1500, "relation_type": F.left("o_orderpriority", F.lit(1)), "reciprocal_relation": F.lit("r")})
    registry = o.where("o_orderstatus = 'F'").select(F.col("target_asset_id").alias("source_asset_id"), F.col("source_asset_id").alias("target_asset_id"), "relation_type", "reciprocal_relation", F.lit("executed").alias("approval_status"))
    pairs = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("pair_id"), "source_asset_id", "target_asset_id", "relation_type", "reciprocal_relation")
    flag = lambda conflicting, name: R.relation_exists(pairs, registry, conflicting).select("pair_id", F.lit(True).alias(name))
    out = pairs.select("pair_id").join(flag(False, "known"), "pair_id", "left").join(flag(True, "conflicting"), "pair_id", "left")
    return out.select("pair_id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("conflicting", F.lit(False)).alias("conflicting"))


_LOG = """l as (select user_id || '-' || (event_id % 7) as operation_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as t, user_id,
  case event_type when 'click' then 'completed' when 'error' then 'failed' when 'purchase' then 'partial' else 'started' end as status from events)"""


def _log(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "click", "completed").when(kind == "error", "failed").when(kind == "purchase", "partial").otherwise("started")
    e = table(spark, sf_dir, "events").withColumns({"operation_id": F.concat_ws("-", "user_id", F.col("event_id") % 7), "operation_type": F.lit("capture"), "status": status, "started_at": F.date_format("ts", TIME)})
    return e.withColumn("completed_at", F.when(F.col("status") != "started", F.col("started_at")))


@query(f"""with {_LOG} select operation_id, min(t) as started_at, coalesce(arg_min(status, t) filter (status <> 'started'), 'started') as status,
  min(t) filter (status <> 'started') as completed_at, count(distinct status) filter (status <> 'started') > 1 as conflicting from l group by 1""")
def operation_states(spark, sf_dir):
    """One row an operation: its first end wins, other ends are conflicts (analogue: events as log rows)."""
    return M.current_operations(_log(spark, sf_dir)).select("operation_id", "started_at", "status", "completed_at", "conflicting")


@query(f"""with {_LOG}, o as (select operation_id, coalesce(arg_min(status, t) filter (status <> 'started'), 'started') as status from l group by 1),
v as (select c_custkey || '-' || (c_nationkey % 7) as operation_id, case c_mktsegment when 'BUILDING' then 'completed' when 'MACHINERY' then 'blocked' else 'seen' end as canonical from customer)
select operation_id, case when o.status <> 'started' and canonical in ('completed', 'blocked') and o.status <> canonical then 'needs_reconciliation' when o.status <> 'started' then o.status
  when canonical in ('completed', 'blocked') then canonical when canonical is not null then 'needs_reconciliation' else o.status end as status from o full join v using (operation_id)""")
def operations_reconciled(spark, sf_dir):
    """Operations against canonical evidence (analogue: market segments of customers)."""
    seg = F.col("c_mktsegment")
    canonical = F.when(seg == "BUILDING", "completed").when(seg == "MACHINERY", "blocked").otherwise("seen")
    evidence = table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_custkey", F.col("c_nationkey") % 7).alias("operation_id"), canonical.alias("canonical_status"))
    return M.reconcile_operations(M.current_operations(_log(spark, sf_dir)), evidence).select("operation_id", "status")


@query("""with f as (select distinct o_custkey as id from orders where o_orderstatus = 'P'), q as (select c_custkey as id, c_mktsegment as problem, case when c_acctbal < 0 then 'resolved' else 'open' end as status from customer)
select id as exception_id, case when f.id is not null then 'P' else problem end as problem, case when f.id is not null then 'open' when status = 'open' then 'resolved' else status end as status,
  case when q.id is null then '2024-05-01' else '2024-01-01' end as first_seen, case when f.id is not null or status = 'open' then '2024-05-01' else '2024-02-01' end as last_seen from q full join f using (id)""")
def exceptions_reconciled(spark, sf_dir):
    """An exception queue after an audit (analogue: customers queued, those with pending orders found)."""
    c = table(spark, sf_dir, "customer")
    queue = c.select(F.col("c_custkey").alias("exception_id"), F.col("c_mktsegment").alias("problem"), F.when(F.col("c_acctbal") < 0, "resolved").otherwise("open").alias("status"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-02-01").alias("last_seen"))
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("exception_id"), F.lit("P").alias("problem"))
    return M.resolve_exceptions(queue, found, "2024-05-01")


@query("select distinct 'sha256:' || sha256(text) as content_hash from documents where text not in (select text from benchmark where text is not null)")
def object_puts(spark, sf_dir):
    """Content objects that a store lacks: texts of documents that are no benchmark text."""
    h = I.content_hash(F.col("text")).alias("content_hash")
    return M.put_objects(table(spark, sf_dir, "benchmark").select(h), table(spark, sf_dir, "documents").where("text is not null").select(h))


@query("select 'o' || l_orderkey as reference from lineitem union all select distinct 'o' || o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def manifest_appends(spark, sf_dir):
    """A manifest's entries and those new ones whose reference it lacks (analogue: line items and orders)."""
    entries = table(spark, sf_dir, "lineitem").select(_text("o", "l_orderkey").alias("reference"))
    return M.append_unknown(entries, table(spark, sf_dir, "orders").select(_text("o", "o_orderkey").alias("reference")))


@query("select user_id as material_id, arg_max(event_id, ts) as revision_id, max(ts) as committed_at from events group by 1")
def revision_pointers(spark, sf_dir):
    """The newest revision of each material (analogue: events of users)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("material_id"), F.col("event_id").alias("revision_id"), F.col("ts").alias("committed_at"))
    return M.current_revisions(e)


@query("""with x as (select c_acctbal > 0 as ok, o_orderstatus = 'F' and o_totalprice > 100000 as strong, case left(o_orderpriority, 1) when '1' then 'source_of' when '2' then 'extends' when '3' then 'related' when '4' then 'explains' else 'supports' end as kind,
  c_nationkey < 3 as had, c_nationkey = 4 as clash, c_mktsegment as seg, c_nationkey * 3 as len from orders join customer on o_custkey = c_custkey)
select case when not ok then 'endpoint_not_eligible' when not strong then 'not_strong' when kind = 'related' then 'related_never_applies' when had then 'relation_exists' when clash then 'relation_conflicts'
  when kind = 'source_of' and seg <> 'BUILDING' then 'structural_evidence_missing' when kind = 'explains' then 'type_not_applicable' when kind <> 'source_of' and seg not in ('AUTOMOBILE', 'MACHINERY') then 'semantic_evidence_missing'
  when kind <> 'source_of' and len < 40 then 'rationale_too_short' end as reason, count(*)::bigint as n from x group by 1""")
def apply_gate_reasons(spark, sf_dir):
    """Why candidates may not be applied on their own; null where they may (analogue: orders as candidates)."""
    seg, names = F.col("c_mktsegment"), lambda *n: F.array(*map(F.lit, n))
    evidence = (
        F.when(seg == "BUILDING", names("stable_identity_match", "stable_reference_match", "revision_match"))
        .when(seg == "AUTOMOBILE", names(*runs.STRONG_EVIDENCE)).when(seg == "MACHINERY", names(*["semantic_dimension"] * 4)).otherwise(names("other"))
    )
    kind = F.element_at(names("source_of", "extends", "related", "explains", "supports"), F.left("o_orderpriority", F.lit(1)).cast("int"))
    c = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("c_acctbal") > 0).alias("both_eligible"), F.when(F.col("o_orderstatus") == "F", "strong").otherwise("medium").alias("relation_strength"), F.when(F.col("o_totalprice") > 100000, "high").otherwise("low").alias("confidence"),
        kind.alias("relation_type"), (F.col("c_nationkey") < 3).alias("exists"), (F.col("c_nationkey") == 4).alias("conflicts"), evidence.alias("evidence_kinds"), F.repeat(F.lit("x"), F.col("c_nationkey") * 3).alias("rationale"),
    )
    return c.groupBy(R.apply_gate(c).alias("reason")).agg(F.count("*").alias("n"))


@query("""with x as (select o_custkey || '-' || left(o_orderpriority, 1) as id, o_orderstatus as st, o_totalprice > 400000 as bad, least('a' || o_custkey, 'm' || ((o_custkey * 7 + 1) % 1500)) || greatest('a' || o_custkey, 'm' || ((o_custkey * 7 + 1) % 1500)) || left(o_orderpriority, 1) as fact from orders),
y as (select *, count(*) over (partition by id) as same_id, sum((st <> 'P')::int) over (partition by fact) as same_fact from x)
select concat_ws(',', case when same_id > 1 then 'duplicate_relation_id' end, case when st = 'P' then 'invalid_endpoint' end, case when bad then 'invalid_revision' end, case when st = 'P' then 'invalid_status' end,
  case when st <> 'P' and same_fact > 1 then 'duplicate_active_fact' end) as violations, count(*)::bigint as n from y group by 1""")
def registry_violations(spark, sf_dir):
    """Rules that a registry's rows break (analogue: orders as relations)."""
    sha = lambda head, c: F.concat(F.lit(head), F.sha2(c.cast("string"), 256))
    kind, status = F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus")
    target = (F.col("o_custkey") * 7 + 1) % 1500
    o = table(spark, sf_dir, "orders").select(
        F.concat_ws("-", "o_custkey", kind).alias("relation_id"), sha("asset_sha256_", F.col("o_custkey")).alias("source_asset_id"),
        F.when(status == "P", target.cast("string")).otherwise(sha("material_sha256_", target)).alias("target_asset_id"),
        sha("revision_sha256_", F.col("o_custkey")).alias("source_revision"), F.when(F.col("o_totalprice") > 400000, "none").otherwise(sha("snapshot_sha256_", target)).alias("target_revision"),
        kind.alias("relation_type"), kind.alias("reciprocal_relation"), F.when(status == "F", "executed").when(status == "O", "approved").otherwise("unknown").alias("approval_status"),
    )
    return R.validate_registry(o).groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@query("select 'c' || l_orderkey as candidate_id, min(l_partkey || '/' || l_suppkey) as path from lineitem where l_returnflag = 'A' group by 1")
def matching_receipts(spark, sf_dir):
    """The first receipt of each candidate by path, of one protocol (analogue: line items as receipts)."""
    r = table(spark, sf_dir, "lineitem").select(_text("c", "l_orderkey").alias("candidate_id"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("path"), F.col("l_returnflag").alias("protocol"), "l_shipdate")
    return L.first_receipts(r, "A").select("candidate_id", "path")


@query("""with d as (select distinct 'm' || o_custkey as material_id, o_orderpriority as asset_type from orders), w as (select 'm' || c_custkey as material_id, asset_type from customer, (select distinct o_orderpriority as asset_type from orders))
select material_id, asset_type, case when d.material_id is null then 'not_applicable' else 'publishable' end as status from w left join d using (material_id, asset_type)""")
def derivative_types_filled(spark, sf_dir):
    """Derivatives of every source, placeholders for the types it lacks (analogue: priorities of customers' orders)."""
    d = table(spark, sf_dir, "orders").select(_text("m", "o_custkey").alias("material_id"), F.col("o_orderpriority").alias("asset_type")).distinct()
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return L.fill_missing_types(table(spark, sf_dir, "customer").select(_text("m", "c_custkey").alias("material_id")), d.withColumn("status", F.lit("publishable")), kinds)


@query("select o_custkey as bundle, case when bool_and(o_orderstatus = 'F') then 'published' else 'publish_partial' end as final_status from orders group by 1")
def bundle_status(spark, sf_dir):
    """Whether all components of a bundle are published (analogue: finished orders of customers)."""
    status = F.when(F.col("o_orderstatus") == "F", "published_or_already_published").otherwise("pending_retry")
    return runs.final_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle"), status.alias("status")), "bundle")


@query("""with f as (select 'f' || c_custkey as path, 'm' || c_custkey as m, 'r' || c_nationkey as r, c_mktsegment as b from customer where c_acctbal > 0 union all select 's' || s_suppkey, 'm' || s_suppkey, 'r' || s_nationkey, 'BUILDING' from supplier),
o as (select 'm' || o_custkey as m, 'f' || o_custkey as want, 'r' || min(o_orderkey % 25) as r, case when count(*) > 9 then 'BUILDING' else 'MACHINERY' end as b from orders group by o_custkey),
n as (select m, count(*) as n, min(path) as place from f group by 1),
j as (select o.m, o.r, coalesce(place, want) as target, coalesce(n > 1, false) as several, coalesce(t.r, '') as old, coalesce(t.r = o.r, false) as same, t.b <> o.b as differs from o left join n using (m) left join f t on t.path = coalesce(place, want))
select m as material_id, r as revision_id, target, case when several or same and differs then 'capture_incomplete_projection_pending' when same then 'already_projected' else 'capture_completed' end as status,
  case when several or same then null when old <> '' then 'updated' else 'created' end as action,
  case when several then 'multiple inbox projections share the same material_id' when same and differs then 'same revision projection content drift detected' end as reason, old as previous_revision from j""")
def projection_ladder(spark, sf_dir):
    """What completing each source does to its projection (analogue: customers and suppliers as files, orders as sources)."""
    page = lambda m, r, b: F.concat(L.header_block({"material_id": m, "revision_id": r}), b)
    c, s = table(spark, sf_dir, "customer").where("c_acctbal > 0"), table(spark, sf_dir, "supplier")
    files = c.select(_text("f", "c_custkey").alias("path"), page(_text("m", "c_custkey"), _text("r", "c_nationkey"), F.col("c_mktsegment")).alias("text"))
    files = files.unionByName(s.select(_text("s", "s_suppkey").alias("path"), page(_text("m", "s_suppkey"), _text("r", "s_nationkey"), F.lit("BUILDING")).alias("text")))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(_text("r", F.min(F.col("o_orderkey") % 25)).alias("revision_id"), F.when(F.count("*") > 9, "BUILDING").otherwise("MACHINERY").alias("b"))
    o = o.withColumns({"material_id": _text("m", "o_custkey"), "requested": _text("f", "o_custkey"), "state": F.lit("capture_completed")})
    return L.projection_actions(o.withColumn("rendered", page(F.col("material_id"), F.col("revision_id"), F.col("b"))), files)


@query("""select conv_id, turn, coalesce(sum(length(text)::double) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as chunk_offset, role = 'user' as missing from conversations""")
def chunk_clock(spark, sf_dir):
    """Running offsets of chunks and which of them leave a gap (analogue: turns as chunks, user turns as failed ones)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("duration"), (F.col("role") != "user").alias("ok"))
    return S.chunk_offsets(c, "conv_id", "turn").select("conv_id", "turn", F.col("offset").alias("chunk_offset"), F.col("missing").isNotNull().alias("missing"))


@query("""select conv_id, count(*)::bigint as n, max(length(text)::double) as longest, quantile_disc(length(text)::double, 0.95) as p95, avg((trim(coalesce(text, '')) = '')::int::double) as empty_ratio from conversations group by 1""")
def segment_measures(spark, sf_dir):
    """Durations of a transcript's segments and the share of empty ones (analogue: turns as long as their texts)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "text", F.lit(0.0).alias("start_time"), F.length("text").cast("double").alias("end_time"))
    return S.segment_measures(c, "conv_id")


@query("select least('c' || c_custkey, 'c7') as asset_a, greatest('c' || c_custkey, 'c7') as asset_b from customer where c_acctbal > 0 and c_custkey <> 7 and exists(select 1 from customer where c_custkey = 7 and c_acctbal > 0)")
def incremental_candidates(spark, sf_dir):
    """The pairs of one asset with every other eligible one (analogue: a customer)."""
    return R.incremental_pairs(table(spark, sf_dir, "customer").select(_text("c", "c_custkey").alias("asset_id"), (F.col("c_acctbal") > 0).alias("eligible")), "c7")


@query("select o_orderstatus as status, count(*)::bigint as relations, count(*) filter (o_orderstatus <> 'F')::bigint as broken, count(*) filter (o_orderstatus = 'P')::bigint as repairable from orders group by 1")
def audit_counts(spark, sf_dir):
    """Counts of an audit's statuses (analogue: orders as checks), one part a status."""
    status = F.col("o_orderstatus")
    checks = table(spark, sf_dir, "orders").withColumn("status", F.when(status == "F", "healthy").when(status == "P", "repair_candidate").otherwise("conflict"))
    parts = [runs.audit_summary(checks.where(status == s)).select(F.lit(s).alias("status"), "relations", "broken", "repairable") for s in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("relations > 0")


@query()
def discovery_run(spark, sf_dir):
    """A dry run of discovery over documents as knowledge assets: retrieved pairs by class; tests hold the run against its rules."""
    d = table(spark, sf_dir, "documents")
    assets = d.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("asset_id"), F.lit("r").alias("revision"), F.col("n_chars").isNotNull().alias("eligible"), F.lit("").alias("exclusion_reason"), F.lit("knowledge").alias("asset_class"),
        F.concat_ws(" ", F.slice(F.split("text", "\\s+", 8), 1, 7)).alias("title"), F.create_map(F.lit("正文"), F.coalesce("text", F.lit(""))).alias("sections"),
        F.create_map().cast("map<string,string>").alias("frontmatter"), F.col("doc_id").cast("string").alias("path"), F.lit("").alias("file_hash"),
    )
    registry = spark.createDataFrame([], "source_asset_id string, target_asset_id string, relation_type string, reciprocal_relation string, approval_status string")
    found = runs.discover(assets, registry, "vault")
    return runs.counts(**{k: found[k] for k in ("retrieved", "strong", "medium", "weak", "excluded")})
