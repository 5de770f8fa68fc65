"""Queries of approved bundles, chunked recordings, migrations and the SQL surface; the fourth part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import identity as I
from attestra.operators import bundles as B
from attestra.operators import chunks as C
from attestra.operators import migration as G
from attestra.plans.catalog import query
from attestra.plans.records import _LOG, _log
from attestra.runtime import materialise, table
from attestra.sources import surface

_KINDS = ("source_asset", "learning_note", "intelligence_brief", "method_asset", "creation_asset")


def _bundles(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as bundles, their lines as candidates (the first is the source) and components; faults go by the keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"))
    k = F.col("bundle_id")
    bundles = o.select(
        "bundle_id", F.when(k % 41 == 1, "v0").otherwise(B.BUNDLE).alias("protocol"), F.lit(B.AWAITING).alias("workflow_state"), F.lit(B.PLAN).alias("plan_protocol"),
        F.when(k % 41 == 2, k + 1).otherwise(k).alias("plan_bundle_id"), (k % 41 != 3).alias("confirmed"), F.lit("user").alias("reviewer"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey")  # all that follows is within an order
    lines = lines.groupBy(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").cast("long").alias("line")).agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("long").alias("quantity"))
    first = lines.groupBy("bundle_id").agg(F.min("line").alias("first"))
    text = lambda part: F.concat(F.lit("---\nkind: note\n---\n\nPart "), part.cast("string"), F.lit("\n"))

    def candidates_of(c: DataFrame, *more: str) -> DataFrame:
        kind = F.when(F.col("line") == F.col("first"), _KINDS[0]).otherwise(F.element_at(F.array(*map(F.lit, _KINDS[1:])), (F.col("line") % 4 + 1).cast("int")))
        return c.select(
            "bundle_id", F.concat_ws("-", "bundle_id", "line").alias("candidate_id"), kind.alias("asset_type"), F.when(F.col("quantity") % 10 == 0, "draft").otherwise("publishable").alias("status"), F.concat(F.lit("m"), k).alias("material_id"), F.lit("r1").alias("revision_id"),
            F.concat(F.lit("Line "), "line").alias("title"), text(F.col("part")).alias("markdown"), F.concat(F.lit("ref/"), k).alias("readable_reference"), F.lit("sha256:0").alias("content_hash"),
            F.array(F.lit("z"), F.concat(F.lit("a"), "part")).alias("stable_references"), F.lit("{}").alias("admission"), "line", "part", *more,
        )

    # only keys and digests are written; candidates and components are columns of them
    c = lines.join(first, "bundle_id")
    c, _ = materialise(c.join(B.bundle_digests(candidates_of(c)), "bundle_id"), "candidates", "zstd")
    candidates = candidates_of(c)
    is_ = lambda n: (k * 31 + F.col("line") * 7 + F.col("part")) % 60 == n
    folder = F.element_at(F.create_map(*[F.lit(x) for pair in B.FOLDERS.items() for x in pair]), F.col("asset_type"))
    both = candidates_of(c, "bundle_digest").withColumns({
        "component_type": F.col("asset_type"), "target_folder": F.when(is_(0), "elsewhere").otherwise(folder),
        "filename": F.when(is_(1), "../x.md").otherwise(F.concat("candidate_id", F.lit(".md"))), "source_material_id": F.when(is_(2), "other").otherwise(F.col("material_id")), "source_revision_id": F.col("revision_id"),
        "published_title": F.when(is_(3), "Other").otherwise(F.col("title")), "published_body": F.when(is_(4), "Other").otherwise(F.concat(F.lit("\n  Part "), F.col("part").cast("string"), F.lit("\t"))),
        "projection_hash": F.when(~is_(5), "p"), "quality": F.lit("{}"), "inputs": F.array(F.when(is_(6), "/tmp/a").otherwise("a/b")),
    })
    kept = ("component_type", "inputs", "published_body", "line", "part", "bundle_digest")
    now = B.own_binding(both.select("bundle_id", "candidate_id", *B.held_columns(both), *B.planned_columns(), *kept, B.candidate_view(both).alias("text")))
    components = now.select(
        "bundle_id", "candidate_id", "component_type", "target_folder", "filename", "source_material_id", "source_revision_id", "published_title", "published_body", "projection_hash", "quality", "inputs",
        F.when(is_(7), "changed").when(~is_(8), F.col("text")).alias("snapshot"), F.when(is_(9), "old").otherwise(B.whole_binding(F.col("bundle_digest"), F.col("own"))).alias("approved"), F.when(is_(10), "old").otherwise(B.written(F.col("own"))).alias("confirmed_binding"),
    )
    every = candidates.where("bundle_id % 3 = 0 and line % 3 <> 1").select("bundle_id", "candidate_id", F.col("line").alias("position"))
    absent = o.where("bundle_id % 33 = 0").select("bundle_id", F.lit("nowhere").alias("candidate_id"), F.lit(99).cast("long").alias("position"))
    return bundles, candidates.drop("line", "part"), components, every.unionByName(absent)


_PREFLIGHT = """with l as (select l_orderkey as b, l_linenumber::bigint as line, min(l_partkey) as part, min(l_quantity)::bigint as q from lineitem where l_orderkey in (select o_orderkey from orders) group by all),
c as (select *, b || '-' || line as id, case when line = min(line) over (partition by b) then 'source_asset' else ['learning_note', 'intelligence_brief', 'method_asset', 'creation_asset'][line % 4 + 1] end as kind, (b * 31 + line * 7 + part) % 60 as k, q % 10 <> 0 as ok from l),
sel as (select b, id, line as position, '' as nm from c where b % 3 = 0 and line % 3 <> 1 union all select o_orderkey, 'nowhere', 99, '' from orders where o_orderkey % 33 = 0),
pick as (select * from sel union all select b, id, 0, id from c where ok and b not in (select b from sel)),
p as (select pick.*, c.kind, c.kind = 'source_asset' as src, case when pick.b % 41 = 1 then 'bundle_state' when pick.b % 41 = 2 then 'plan_mismatch' when pick.b % 41 = 3 then 'approval_missing' when c.id is null then 'candidate_absent' when not c.ok then 'not_publishable'
  when k = 6 then 'temporary_input' when k = 8 and kind <> 'source_asset' then 'snapshot_missing' when k = 7 and kind <> 'source_asset' then 'candidate_changed' when k in (0, 1) then 'target_mismatch' when k = 2 then 'source_mismatch' when k = 4 and kind <> 'source_asset' then 'body_mismatch'
  when k = 3 and kind <> 'source_asset' then 'title_mismatch' when k = 5 and kind = 'source_asset' then 'projection_missing' when k = 9 then 'approval_mismatch' when k = 10 and kind <> 'source_asset' then 'confirmation_mismatch' end as problem from pick left join c on c.b = pick.b and c.id = pick.id),
f as (select *, first_value(problem) over (partition by b order by problem is null, position, nm rows between unbounded preceding and unbounded following) as blocked from p)"""


@query(f"{_PREFLIGHT} select b as bundle_id, id as candidate_id, kind as asset_type, problem, blocked from f")
def bundle_preflight(spark, sf_dir):
    """Every selected candidate of approved bundles with its problem, bindings recomputed (analogue: orders and lines)."""
    return B.preflight(*_bundles(spark, sf_dir)).select("bundle_id", "candidate_id", "asset_type", "problem", "blocked")


@query(f"""{_PREFLIGHT}, d as (select *, bool_or(src and b % 5 = 1) over (partition by b) as stopped, case when src then b % 5 <> 1 else hash_ok end as done from (select *, position is not null and (b + length(id)) % 4 <> 0 as hash_ok from f))
select b as bundle_id, id as candidate_id, case when blocked is not null then 'blocked' when not src and stopped then 'pending_retry' when done then 'published_or_already_published' else 'pending_retry' end as status,
  case when blocked is not null then blocked when not src and stopped then 'source_not_committed' end as reason from d""")
def bundle_dispatch(spark, sf_dir):
    """Dispatch of approved bundles: sources first, derivatives of a failed source wait (analogue: publishing fails by key)."""

    def publish(df: DataFrame) -> DataFrame:
        of_source = F.col("bundle_id") % 5 != 1
        other = (F.col("bundle_id") + F.length("candidate_id")) % 4 != 0
        return df.select("bundle_id", "candidate_id", F.when(F.col("asset_type") == "source_asset", of_source).otherwise(other).alias("committed"))

    return B.dispatch(B.preflight(*_bundles(spark, sf_dir)), publish)[0].select("bundle_id", "candidate_id", "status", "reason")


def _digit(hash_: Column, place: int) -> Column:
    """A digit of a hash, from 1."""
    return F.substring(hash_, 7 + place, 1)


def _chunked(spark, sf_dir) -> DataFrame:
    """Turns of conversations as chunks of recordings, run against a cache with stale rows and a provider that fails by hash."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, sf_dir, "conversations").withColumn("chunk", (F.row_number().over(order) - 1).cast("long"))
    body = F.coalesce("text", F.lit(""))
    t = t.select(F.col("conv_id").alias("owner"), "chunk", F.length(body).cast("double").alias("duration"), I.content_hash(body).alias("chunk_hash"), body.alias("payload"))
    t, _ = materialise(t, "chunks", "zstd")

    def segments(payload: Column, shout: bool) -> Column:
        half = F.floor(F.length(payload) / 2).cast("int")
        a, b = F.substring(payload, F.lit(1), half), F.substring(payload, half + 1, F.length(payload))
        part = lambda s, e, x: F.struct(s.cast("double").alias("start_time"), e.cast("double").alias("end_time"), (F.translate(x, "aeiou", "AEIOU") if shout else x).alias("text"))
        return F.array(part(F.lit(0), half, a), part(half, half, F.lit(" ")), part(half, F.length(payload), b))

    last = _digit(F.col("chunk_hash"), 64)
    kept = t.where(last < "8").select(
        "chunk_hash", F.when(last == "0", "p0").otherwise("p1").alias("provider_identity"), F.lit(C.PROTOCOL).alias("protocol"), F.when(last == "1", "failed").otherwise("completed").alias("status"),
        F.when(last == "2", " ").otherwise(F.col("payload")).alias("text"), segments(F.col("payload"), False).alias("segments"),
    )

    def provider(open_: DataFrame, attempt: int) -> DataFrame:
        d = _digit(F.col("chunk_hash"), attempt + 1)
        failure = F.when(d < "3", "segment_timeout").when(d < "6", "asr_process_failed")
        sent = open_.where(d != "6")  # lost on the way
        return sent.select("chunk_hash", failure.alias("failure"), F.when(d == "7", "partial").otherwise("completed").alias("status"), F.translate("payload", "aeiou", "AEIOU").alias("text"), segments(F.col("payload"), True).alias("segments"))

    return C.clock(C.transcribe(t, kept, provider, "p1", 2)[0])


_CHUNKS = r"""with t as (select conv_id as owner, row_number() over (partition by conv_id order by turn, role, text) - 1 as chunk, coalesce(text, '') as x from conversations),
h as (select *, sha256(x) as hex, length(x)::double as n, length(regexp_replace(x, '\s', '', 'g')) > 0 as filled from t),
d as (select *, hex[64] < '8' and hex[64] not in ('0', '1', '2') and filled as hit, [case when hex[i] < '3' then 'segment_timeout' when hex[i] < '7' then 'asr_process_failed' when hex[i] = '7' or not filled then 'transcript_parse_failed' end for i in [1, 2, 3]] as w from h),
r as (select *, case when hit then 'completed_cached' when w[1] is null then 'completed' when w[2] is null or w[3] is null then 'completed_after_retry' else 'failed' end as asr_status,
  case when hit or w[1] is null then 0 when w[2] is null then 1 else 2 end as retry_count, case when hit or w[1] is null then '' when w[2] is null then w[1] when w[3] is null then w[2] else w[3] end as failure_reason,
  coalesce(sum(n) over (partition by owner order by chunk rows between unbounded preceding and 1 preceding), 0) as start_time from d)"""


@query(f"{_CHUNKS} select owner, chunk, asr_status, retry_count, failure_reason, start_time, start_time + n as end_time from r")
def chunk_results(spark, sf_dir):
    """Chunks after a cache and two retries, on the recording's clock (analogue: turns of conversations)."""
    return _chunked(spark, sf_dir).select("owner", "chunk", "asr_status", "retry_count", "failure_reason", "start_time", "end_time")


@query(f"""{_CHUNKS} select owner, case when count_if(asr_status = 'failed') = 0 and bool_or(asr_status <> 'failed') then 'completed' when bool_or(asr_status <> 'failed') then 'partial' else 'failed' end as status,
  count(*) as chunks, count_if(asr_status = 'failed')::bigint as failed, sum(n) as end_time from r group by owner""")
def chunk_recordings(spark, sf_dir):
    """Status of recordings from the results of their chunks."""
    return C.recordings(_chunked(spark, sf_dir))


@query(f"{_CHUNKS} select owner, start_time, start_time + n as end_time, failure_reason as reason from r where asr_status = 'failed'")
def chunk_missing_ranges(spark, sf_dir):
    """Ranges of recordings whose chunks failed to the end."""
    return C.missing_ranges(_chunked(spark, sf_dir))


@query(rf"""{_CHUNKS}, s as (select owner, chunk, start_time as o, case when hit then x else translate(x, 'aeiou', 'AEIOU') end as y, floor(length(x) / 2)::bigint as half, n, asr_status <> 'failed' as ok from r),
e as (select owner, chunk, o, unnest(case when ok then [{{i: 1, s: 0, e: half, t: substr(y, 1, half)}}, {{i: 2, s: half, e: half, t: ' '}}, {{i: 3, s: half, e: n, t: substr(y, half + 1)}}] end) as g from s),
f as (select owner, chunk, o, g.i as i, o + g.s as st, o + g.e as en, regexp_replace(g.t, '^\s+|\s+$', '', 'g') as text from e where length(regexp_replace(g.t, '\s', '', 'g')) > 0),
m as (select f.*, coalesce(b.n, 0) as before from f left join (select owner, chunk, sum(n) over (partition by owner order by chunk rows between unbounded preceding and 1 preceding) as n from (select r.owner, r.chunk, count(f.owner) as n from r left join f on f.owner = r.owner and f.chunk = r.chunk group by all)) b on b.owner = f.owner and b.chunk = f.chunk)
select owner, 'transcript-' || lpad((before + i)::bigint::varchar, 4, '0') as segment_id, st::double as start_time, en::double as end_time, text from m""")
def chunk_segments(spark, sf_dir):
    """Segments of all chunks on the clock of their recordings, numbered."""
    return C.segments_of(_chunked(spark, sf_dir)).select("owner", "segment_id", "start_time", "end_time", "text")


def _notes(spark, sf_dir) -> DataFrame:
    """Documents as notes of folders: with another class, the right one, none, several, or without front matter."""
    n, folders = F.col("doc_id"), [*G.CLASSES, *G.REMOVED, "99 其他"]
    head = (
        F.when(n % 7 == 0, "title: a").when(n % 7 == 1, "asset_class: source\ntitle: a").when(n % 7 == 2, "title: a\nasset_class: knowledge").when(n % 7 == 3, "asset_class:  old \ngraph: 1\nasset_class: creation")
        .when(n % 7 == 4, "asset_class: intelligence")
    )
    text = F.coalesce("text", F.lit(""))
    folder = F.element_at(F.array(*map(F.lit, folders)), (n % len(folders) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("notes/"), n, F.lit(".md")).alias("relative_path"), folder.alias("folder"), F.when(head.isNull(), text).otherwise(F.concat(F.lit("---\n"), head, F.lit("\n---\n"), text)).alias("text"), "doc_id")


_NOTES = """with d as (select doc_id, coalesce(text, '') as t, doc_id % 8 as f, doc_id % 7 as h from documents),
n as (select *, ['10 原始资料', '20 学习笔记', '30 情报简报', '40 方法库', '50 输出成果', '00 收件箱', '90 系统', '99 其他'][f + 1] as folder, ['source', 'knowledge', 'intelligence', 'knowledge', 'creation', null, null, null][f + 1] as w,
  ['title: a', 'asset_class: source' || chr(10) || 'title: a', 'title: a' || chr(10) || 'asset_class: knowledge', 'asset_class:  old ' || chr(10) || 'graph: 1' || chr(10) || 'asset_class: creation', 'asset_class: intelligence', null, null][h + 1] as head from d),
x as (select *, case h when 0 then 'title: a' || coalesce(chr(10) || 'asset_class: ' || w, '') when 1 then coalesce('asset_class: ' || w || chr(10), '') || 'title: a' when 2 then 'title: a' || coalesce(chr(10) || 'asset_class: ' || w, '')
  when 3 then coalesce('asset_class: ' || w || chr(10), '') || 'graph: 1' || coalesce(chr(10) || 'asset_class: ' || w, '') when 4 then coalesce('asset_class: ' || w, '') end as new, '---' || chr(10) as open, chr(10) || '---' || chr(10) as shut from n),
c as (select *, 'notes/' || doc_id || '.md' as path, coalesce(open || head || shut, '') || t as text, open || new || shut || t as after from x),
g as (select *, head is not null and f < 7 and head <> new as hit from c)"""


@query(f"""{_NOTES} select path as relative_path, folder, ['', 'source', 'knowledge', 'creation', 'intelligence'][h + 1] as previous_class, coalesce(w, 'removed') as new_class, 'sha256:' || sha256(text) as before_hash,
  'sha256:' || sha256(after) as after_hash, 'sha256:' || sha256(t) as body_hash from g where hit""")
def class_changes(spark, sf_dir):
    """The change set of a migration of classes in front matter (documents as notes)."""
    return G.change_set(_notes(spark, sf_dir)).drop("after_text")


@query(f"""{_NOTES}, m as (select path, case when not hit then 'untouched' when doc_id % 10 = 0 then 'drifted' when doc_id % 10 = 1 then 'current' else 'changed' end as state, case when hit and doc_id % 10 = 0 then text || 'x' when hit then after else text end as now from g)
select path as relative_path, state, 'sha256:' || sha256(now) as content_hash from m""")
def class_migration(spark, sf_dir):
    """Notes after a migration that finds some changed since and some migrated before."""
    notes = _notes(spark, sf_dir)
    changes, _ = materialise(G.change_set(notes), "changes", "zstd")
    ahead = notes.join(changes.select("relative_path", "after_text"), "relative_path", "left")
    hit, n = F.col("after_text").isNotNull(), F.col("doc_id") % 10
    now = ahead.withColumn("text", F.when(hit & (n == 0), F.concat("text", F.lit("x"))).when(hit & (n == 1), F.col("after_text")).otherwise(F.col("text")))
    return G.migrated(now, changes).select("relative_path", "state", I.content_hash(F.col("text")).alias("content_hash"))


@query(f"""{_NOTES}, r as (select o_orderkey as k, o_custkey % ((select count(*) from documents) + 5) as s, (o_orderkey * 7 + 3) % (select count(*) from documents) as t from orders),
j as (select r.*, a.doc_id as sd, b.doc_id as td, coalesce(a.hit, false) or coalesce(b.hit, false) as touched, a.after as sa, a.text as st, a.hit as sh, b.after as ta, b.text as tt, b.hit as th from r left join g a on a.doc_id = r.s left join g b on b.doc_id = r.t),
z as (select *, case when not touched then 'untouched' when sd is null or td is null then 'asset_missing' when k % 50 = 0 then 'identity_changed' else 'rebased' end as state from j)
select k as relation_id, state as rebase_state, case when state = 'rebased' then 'sha256:' || sha256(case when sh then sa else st end) else 'old' end as source_revision, case when state = 'rebased' then 'sha256:' || sha256(case when th then ta else tt end) else 'old' end as target_revision from z""")
def registry_rebased(spark, sf_dir):
    """Relations whose notes a migration touched, with the notes' new revisions (analogue: orders join documents)."""
    notes = _notes(spark, sf_dir)
    changes, _ = materialise(G.change_set(notes), "changes", "zstd")
    after = I.content_hash(F.col("text"))
    assets, _ = materialise(G.migrated(notes, changes).select("relative_path", F.col("relative_path").alias("asset_id"), after.alias("revision"), after.alias("file_hash")), "assets")
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))  # one row
    note = lambda c: F.concat(F.lit("notes/"), c, F.lit(".md"))
    o = table(spark, sf_dir, "orders").join(F.broadcast(n)).withColumns({"s": note(F.col("o_custkey") % (F.col("n") + 5)), "t": note((F.col("o_orderkey") * 7 + 3) % F.col("n"))})
    registry = o.select(F.col("o_orderkey").alias("relation_id"), F.col("s").alias("source_location"), F.col("t").alias("target_location"), F.when(F.col("o_orderkey") % 50 == 0, "moved").otherwise(F.col("s")).alias("source_asset_id"),
                        F.col("t").alias("target_asset_id"), F.lit("old").alias("source_revision"), F.lit("old").alias("target_revision"))
    return G.rebase(registry, assets, changes).select("relation_id", "rebase_state", "source_revision", "target_revision")


@query(f"""with {_LOG}, o as (select operation_id, coalesce(arg_min(status, t) filter (status <> 'started'), 'started') as status from l group by 1)
select c_custkey, o.operation_id, o.status from customer join o on o.operation_id = c_custkey || '-' || (c_nationkey % 7)""")
def operation_surface(spark, sf_dir):
    """Operations looked up for every customer through the SQL function (a lateral call that Spark plans as a join)."""
    seg = F.col("c_mktsegment")
    customers = table(spark, sf_dir, "customer").withColumn("wanted", F.concat_ws("-", "c_custkey", F.col("c_nationkey") % 7))
    events = _log(spark, sf_dir)
    for name in ("input_refs", "output_refs", "receipt_refs", "stage_refs", "change_refs"):
        events = events if name in events.columns else events.withColumn(name, F.array().cast("array<string>"))
    surface.register(events, customers.select(F.col("wanted").alias("operation_id"), seg.alias("canonical_status")))
    customers.createOrReplaceTempView("operation_asked")
    return spark.sql("select c.c_custkey, g.operation_id, g.status from operation_asked c, lateral (select * from operation_get(c.wanted)) g")
