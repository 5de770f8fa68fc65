"""Queries of receipts, rollbacks and the gate of records; a part of the catalogue. Records are JSON built from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import identity as I
from attestra.operators import manifests as M
from attestra.operators import receipts as P
from attestra.plans.catalog import query
from attestra.runtime import materialise, table

SCHEME = "vault"


@query("""with recursive e as (select user_id as a, event_id as seq, event_type as post, case when event_id % 997 = 0 then 'elsewhere' else coalesce(lag(event_type) over (partition by user_id order by event_id), 'new') end as pre from events),
s as (select a, 'new' as base, case when a % 5 = 0 then 'elsewhere' when a % 7 = 0 then first(post order by seq) else last(post order by seq) end as now from e group by a),
chain(a, seq, state) as (select a, -1::bigint, base from s union all
  select c.a, n.seq, n.post from chain c, lateral (select seq, post from e where e.a = c.a and e.seq > c.seq and e.pre = c.state order by seq limit 1) n)
select s.a as asset_id, case when last(c.state order by c.seq) = s.now then 'proven' when bool_or(c.state = s.now) then 'outdated' else 'broken' end as status, count(*) - 1 as steps,
  last(c.state order by c.seq) as reached_hash, (select min(e.seq) from e where e.a = s.a and e.seq not in (select k.seq from chain k where k.a = s.a)) as broken_at
from s join chain c on c.a = s.a group by s.a, s.now""")
def receipts_replay(spark, sf_dir):
    """Whether receipts explain what is stored (analogue: a user's events as edits, types as hashes, some made elsewhere)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("post_hash"))
    before = F.coalesce(F.lag("post_hash").over(Window.partitionBy("asset_id").orderBy("seq")), F.lit("new"))
    e = e.withColumn("pre_hash", F.when(F.col("seq") % 997 == 0, "elsewhere").otherwise(before))
    now = F.when(F.col("asset_id") % 5 == 0, "elsewhere").when(F.col("asset_id") % 7 == 0, F.min_by("post_hash", "seq")).otherwise(F.max_by("post_hash", "seq"))
    return P.replay(e, e.groupBy("asset_id").agg(F.lit("new").alias("base_hash"), now.alias("current_hash")))


def _registry(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers as rows of a registry, orders as units that change one or two of them."""
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.count("*").alias("n"))  # one row
    o = table(spark, sf_dir, "orders").join(F.broadcast(n)).withColumn("other", (F.col("o_custkey") * 7 + 1) % F.col("n"))
    keys = F.array_distinct(F.when(F.col("o_orderstatus") == "P", F.array("o_custkey", "other")).otherwise(F.array("o_custkey")))
    value = F.when(F.col("o_orderkey") % 11 != 0, F.concat_ws("-", "o_orderpriority", "o_orderkey"))
    return c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), o.select(F.col("o_orderkey").alias("unit"), F.col("o_orderkey").alias("seq"), F.explode(keys).alias("key"), value.alias("value"))


_CHANGES = """with recursive ch as (select distinct o_orderkey as u, key, case when o_orderkey % 11 <> 0 then o_orderpriority || '-' || o_orderkey end as v
  from (select *, unnest(case when o_orderstatus = 'P' then [o_custkey, (o_custkey * 7 + 1) % (select count(*) from customer)] else [o_custkey] end) as key from orders)),
im as (select u, key, v, lag(v) over w as prev, row_number() over w as n, count(*) over (partition by key) as last, lead(u) over w as nxt from ch window w as (partition by key order by u)),
lg as (select u, key, case when n = 1 then c_mktsegment else prev end as before, v as after, n = last as final from im left join customer on c_custkey = key),
now as (select coalesce(c_custkey, key) as key, case when coalesce(c_custkey, key) % 97 = 0 then 'edited' when l.key is null then c_mktsegment else l.after end as v from customer full join (select * from lg where final) l on l.key = c_custkey),
refused(u) as (select l.u from lg l join now on now.key = l.key where l.final and l.after is distinct from now.v
  union select l.u from refused r join lg x on x.u = r.u join lg l on l.key = x.key and l.u < x.u),
back as (select now.key, case when l.key is null then now.v else l.before end as v from now left join (select key, arg_min(struct_pack(b := before), u).b as before from lg where u not in (select u from refused) group by key) l on l.key = now.key)"""


@query(f"{_CHANGES} select key, v as value from back where v is not null")
def rollback_registry(spark, sf_dir):
    """A registry after all units were applied, some rows edited, and everything undone that may be."""
    registry, changes = _registry(spark, sf_dir)
    log, _ = materialise(P.undo_log(registry, changes), "log")
    after = P.apply_changes(registry, changes)
    held = after.join(registry.unionByName(changes.select("key", "value")).select("key").distinct(), "key", "right")
    held = held.withColumn("value", F.when(F.col("key") % 97 == 0, "edited").otherwise(F.col("value"))).where("value is not null")
    return P.rollback(held, log)[0]


def _block(text: Column | None, hash_: Column, reference: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit("reference" if text is None else "inline").alias("storage"), hash_.alias("content_hash"), F.lit("text/plain").alias("media_type"), (none if text is None else text).alias("text"),
                    (none if reference is None else reference).alias("reference"), F.array().cast("array<string>").alias("operations"))


def _records(spark, sf_dir) -> DataFrame:
    """doc_id, fault, record, manifest, report reference and report of every document; a fault is doc_id modulo 24."""
    fault, text = F.col("doc_id") % 24, F.coalesce("text", F.lit(""))
    is_ = lambda n: F.col("fault") == n
    d = table(spark, sf_dir, "documents").select("doc_id", fault.alias("fault"), text.alias("text"), F.coalesce("source", F.lit("web")).alias("platform"), I.content_hash(text).alias("hash"))
    d = d.withColumns({"hex": F.substring("hash", 8, 64), "key": F.concat(F.lit("d"), "doc_id"), "url": F.concat(F.lit("https://a.com/"), "doc_id"), "report_hex": F.sha2(F.concat(F.lit("report"), "doc_id"), 256)})
    d = d.withColumns({"material_id": I.material_id(I.source_key(F.col("platform"), F.col("key"), F.col("url"))), "asset": F.concat(F.lit(f"{SCHEME}://asset/asset_sha256_"), "hex"), "report": F.concat(F.lit(f"{SCHEME}://report/asset_sha256_"), "report_hex")})
    source = F.struct("platform", F.when(is_(2), "other").otherwise(F.col("key")).alias("source_id"), F.col("url").alias("source_url"), F.when(is_(13), "/tmp/title").otherwise("A title").alias("title"), F.when(is_(20), "unknown").otherwise("Someone").alias("author"), F.lit("2024").alias("captured_at"), F.when(is_(12), "short").alias("summary"))
    item = lambda i, kind: F.struct(i.alias("evidence_id"), kind.alias("kind"), F.col("asset").alias("reference"), F.col("hash").alias("content_hash"), F.lit("").alias("uncertainty"), F.lit(5.0).alias("start_time"), F.when(is_(7), 1.0).otherwise(9.0).alias("end_time"))
    quality = F.struct(F.when(is_(21), "partial").otherwise("complete").alias("capture_status"), F.lit("full").alias("content_fidelity"), F.lit("readable").alias("transcript_quality"), (~is_(5)).alias("review_required"), F.array().cast("array<string>").alias("uncertainties"))
    history = F.when(is_(18), F.array().cast("array<struct<report_reference:string>>")).otherwise(F.array(F.struct(F.col("report").alias("report_reference"))))
    lifecycle = F.struct(F.when(is_(6), "gone").otherwise("captured").alias("status"), F.lit("pending").alias("review_status"), F.lit("a").alias("created_at"), F.lit("b").alias("updated_at"), history.alias("processing_history"))
    raw = _block(None, F.when(is_(4), "sha256:zz").otherwise(F.col("hash")), F.col("asset"))
    readable = lambda t: _block(t, F.when(is_(3), I.content_hash(F.lit("other"))).otherwise(F.col("hash")), None)
    whole = lambda revision, t: F.to_json(F.struct(
        F.when(is_(1), "v2").otherwise("source-material-v3").alias("protocol"), F.lit("3.0.0").alias("schema_version"), "material_id", revision.alias("revision_id"), source.alias("source"),
        F.struct(raw.alias("raw"), readable(t).alias("readable")).alias("content"),
        F.array(item(F.lit("e1"), F.lit("source_media")), item(F.when(is_(8), "e1").otherwise("e2"), F.when(is_(19), "note").otherwise("transcript"))).alias("evidence"),
        F.when(~is_(11), quality).alias("quality"), lifecycle.alias("lifecycle"),
        F.when(is_(9), "elsewhere").otherwise(F.concat(F.lit(f"{SCHEME}://manifest/"), "material_id", F.lit(f"/revision_sha256_{'0' * 64}"))).alias("asset_manifest_reference"), F.lit("").alias("understanding_sidecar_reference"),
    ))
    d = d.withColumn("draft", F.from_json(whole(F.lit(""), F.lit("")), M.MATERIAL_SCHEMA))  # no text counts for a revision
    d = d.withColumn("revision_id", F.when(is_(10), f"revision_sha256_{'0' * 64}").otherwise(I.revision_id(F.col("draft")))).drop("draft")
    entry = lambda ref, hex_, role, path: F.struct(ref.alias("reference"), F.concat(F.lit("asset_sha256_"), hex_).alias("asset_id"), F.lit(role).alias("role"), path.alias("storage_relative_path"), F.concat(F.lit("sha256:"), hex_).alias("content_hash"), F.lit("text/plain").alias("media_type"), F.lit(1).alias("size_bytes"))
    held = entry(F.col("asset"), F.when(is_(16), F.sha2(F.lit("other"), 256)).otherwise(F.col("hex")), "raw", F.when(is_(17), "../x").otherwise("a/x"))
    told = entry(F.col("report"), F.col("report_hex"), "transcript_quality_report", F.lit("a/y"))
    manifest = F.to_json(F.struct(F.lit("reference-manifest-v1").alias("protocol"), F.lit("1.0.0").alias("schema_version"), "material_id", "revision_id", F.when(is_(15), F.array(told)).otherwise(F.array(held, told)).alias("entries")))
    qa = lambda s, w: F.struct(s.alias("status"), w.alias("warnings"))
    none = F.array().cast("array<string>")
    report = F.to_json(F.struct(
        F.lit("media-transcript-quality-v1").alias("protocol"), F.col("hash").alias("transcript_content_hash"), F.when(is_(22), "sha256:old").otherwise(F.col("hash")).alias("readable_content_hash"), (~is_(23)).alias("ready_for_sorting"),
        F.lit("ready_for_整理").alias("quality_status"), qa(F.lit("pass"), none).alias("transcript_structural_qa"), qa(F.when(is_(0), "unusable").otherwise("usable"), F.array(F.lit("short"))).alias("transcript_content_quality"), none.alias("missing_ranges"),
    ))
    return d.select("doc_id", "fault", "text", "report", whole(F.col("revision_id"), F.col("text")).alias("record"), F.when(~is_(14), manifest).alias("manifest"), report.alias("report_record"))


_FAULT = """with f as (select doc_id, doc_id % 24 as k, coalesce(text, '') as t from documents),
p as (select *, case when k = 11 then 'keys' when k = 1 then 'protocol' when k = 12 or regexp_matches(t, '(^|[^\\\\])"(analysis|summary|key_points)"\\s*:') then 'forbidden_field' when k = 2 then 'identity' when k = 4 then 'raw_hash' when k = 3 then 'readable_hash_mismatch' when k = 8 then 'evidence_repeated' when k = 7 then 'evidence_time'
  when k = 5 then 'review_required' when k = 6 then 'lifecycle_status' when k = 9 then 'manifest_reference' when k = 10 then 'revision' when k = 13 then 'temporary' end as record_problem from f)"""


@query(f"{_FAULT} select record_problem as problem, count(*)::bigint as n from p group by 1")
def record_problems(spark, sf_dir):
    """First problem of the record of every document (JSON with planted faults); null where it is sound."""
    return M.check_materials(_records(spark, sf_dir).select("record"), SCHEME).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"""{_FAULT} select coalesce(record_problem, case when k in (14, 17) then 'manifest_missing' when k = 15 then 'reference_missing' when k = 16 then 'hash_mismatch' end) as problem, count(*)::bigint as n from p group by 1""")
def publishing_gate(spark, sf_dir):
    """The whole gate of every document's record: the record, its manifest and their binding."""
    rows, _ = materialise(_records(spark, sf_dir).select("record", "manifest"), "records", "zstd")
    manifests = rows.where("manifest is not null").select(F.col("manifest").alias("record"))
    return M.publishable(rows.select("record"), manifests, SCHEME).groupBy("problem").agg(F.count("*").alias("n"))


def _sound(checked: DataFrame) -> DataFrame:
    """The rows without a problem. They are written before they are picked: a filter on the problem would be moved below
    the parse of the record and hold one parse for each field that it reads. The texts of blocks aren't kept."""
    rows, _ = materialise(checked.withColumn("material", F.col("material").dropFields("content.readable.text")), "sound", "zstd")
    return rows.where("problem is null").drop("problem")


def _reported(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sound records, and their latest quality reports."""
    rows, _ = materialise(_records(spark, sf_dir), "records", "zstd")
    sound = _sound(M.check_materials(rows.select("record"), SCHEME).select("material", "problem"))
    entries = M.manifest_entries(M.check_manifests(rows.where("manifest is not null").select(F.col("manifest").alias("record")), SCHEME).where("problem is null"))
    return sound, M.latest_reports(sound, entries, rows.select(F.col("report").alias("reference"), F.col("report_record").alias("record")))


@query(f"""{_FAULT}, q as (select case when k in (14, 17, 18) then 'report_missing' when k = 22 then 'readable_hash' when k = 21 then 'capture_incomplete' when k = 23 then 'not_ready' when k = 0 then 'content' end as problem, k from p where record_problem is null)
select problem, case when problem is null then case when k = 20 then 'short,metadata_incomplete:author' else 'short' end end as warnings, count(*)::bigint as n from q group by all""")
def quality_verdicts(spark, sf_dir):
    """Whether the latest quality report of every sound record admits it to sorting, and its warnings."""
    sound, latest = _reported(spark, sf_dir)
    return M.quality_verdict(sound, latest).groupBy("problem", F.array_join("warnings", ",").alias("warnings")).agg(F.count("*").alias("n"))


@query(f"""{_FAULT}, q as (select case when k = 20 then 'author' when k = 19 then 'transcript' when k in (14, 17, 18) then 'transcript_gate' when k = 23 then 'transcript_quality' else '' end as missing, k from p where record_problem is null)
select missing, case when missing like 'transcript%' or k = 21 then 'capture_partial' else 'capture_completed' end as state, count(*)::bigint as n from q group by all""")
def completion_states(spark, sf_dir):
    """What every sound record still lacks, and whether its capture is complete."""
    sound, latest = _reported(spark, sf_dir)
    done = M.completion(sound, latest, ("video",), ("transcript",))
    return done.groupBy(F.array_join("missing", ",").alias("missing"), "state").agg(F.count("*").alias("n"))


@query(f"""{_FAULT} select k % 6 as validation, count(*)::bigint as n from p where record_problem is null and k <> 21 and k % 6 < 4 and regexp_matches(t, '[^\\s]') group by 1""")
def sources_ready(spark, sf_dir):
    """Sound, complete records with a text whose validation passed (analogue: two of six classes of documents failed)."""
    rows = _records(spark, sf_dir).select("doc_id", F.col("fault").alias("k"), F.col("text").alias("readable"), "record")
    sound = _sound(M.check_materials(rows, SCHEME))
    checks = sound.select(*[F.col("material")[c].alias(c) for c in ("material_id", "revision_id")], F.when(F.col("k") % 6 < 4, "passed").otherwise("failed").alias("status"))
    return M.ready_sources(sound, checks).groupBy((F.col("k") % 6).alias("validation")).agg(F.count("*").alias("n"))
