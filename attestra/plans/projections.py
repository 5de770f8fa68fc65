"""Queries of managed lines in notes, ends of candidates and provider results; the fifth part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.operators import projection as J
from attestra.operators import providers as V
from attestra.plans.catalog import query
from attestra.runtime import table

_HEAD, _MANAGED = "---\ntitle: a\n---\n", "---\ntitle: a\ngraph_group: g\nasset_class: b\n---\n"


def _prose() -> Column:
    return F.concat(F.lit("Text: "), F.coalesce("text", F.lit("")), F.lit(" end."))


def _marker(key: Column) -> Column:
    return F.concat(F.lit("rel-"), key, F.lit("."))


@query(r"""with d as (select doc_id, 'Text: ' || coalesce(text, '') || ' end.' as t, chr(10) as n from documents)
select doc_id, 'sha256:' || sha256('---' || n || 'title: a' || n || '---' || n || t || case doc_id % 3 when 0 then n || n || '## Links' || n || n || '- keep' || n || n when 1 then '' else n || n || '## Links' || n || n || '- keep' || n || n || n end || '## Next' || n || 'end') as form_hash from d""")
def note_forms(spark, sf_dir):
    """Notes without managed lines: sections that keep a line, that go whole, and that aren't managed (documents as notes)."""
    n, own = F.col("doc_id") % 3, F.concat(F.lit("\n- to x ("), _marker(F.col("doc_id")), F.lit(")"))
    links = F.concat(F.when(n == 1, "").otherwise("\n- keep"), F.when(n == 2, "").otherwise(own))
    text = F.concat(F.lit(_MANAGED), _prose(), F.lit("\n\n## Links\n"), links, F.lit("\n\n\n## Next\nend\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", I.content_hash(J.nonsemantic(text, _marker(F.col("doc_id")))).alias("form_hash"))


def _relations(spark, sf_dir) -> DataFrame:
    """Orders as relations between documents."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))  # one row
    return table(spark, sf_dir, "orders").join(F.broadcast(n)).select("o_orderkey", (F.col("o_custkey") % F.col("n")).alias("source"), ((F.col("o_orderkey") * 7 + 3) % F.col("n")).alias("target"))


@query("""with r as (select o_orderkey as k, o_custkey % (select count(*) from documents) as s, (o_orderkey * 7 + 3) % (select count(*) from documents) as t from orders),
e as (select k, 'source' as side, s as d from r union all select k, 'target', t from r),
l as (select *, max(k) over (partition by d) as last from e),
x as (select k, side, k % 40 = 7 and side = 'target' as no_image, doc_id is null or d % 10 = 1 as no_note, d % 10 = 0 or (k % 3 = 0 and k <> last) as changed from l left join documents on doc_id = d),
p as (select k, case when bool_or(no_image or (no_note and doc is null)) then 'image_missing' when bool_or(no_note) then 'note_missing' when bool_or(changed and side = 'source') then 'source_changed' when bool_or(changed) then 'target_changed' end as reason
  from (select x.*, doc.doc_id as doc from x join l using (k, side) left join documents doc on doc.doc_id = l.d) group by k)
select 'rel-' || k || '.' as candidate_id, reason is null as proven, reason from p""")
def projection_proofs(spark, sf_dir):
    """Proofs that only managed lines changed (analogue: orders as relations of documents; the last order of each wrote its line)."""
    r = _relations(spark, sf_dir)
    k, d = F.col("k"), F.col("doc_id")
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("doc_id")) for s in ("source", "target")])).alias("e")
    e = r.select(F.col("o_orderkey").alias("k"), ends).select("k", "e.*")
    docs = table(spark, sf_dir, "documents").select("doc_id", _prose().alias("prose"))
    plain = F.concat(F.lit(_HEAD), F.col("prose"), F.lit("\n"))
    written = F.concat(F.lit(_MANAGED), F.col("prose"), F.lit("\n\n## Links\n\n- to x ("), _marker(F.col("last")), F.lit(")\n"))
    now = F.when(F.col("last").isNull(), plain).when(d % 10 == 0, F.concat(plain, F.lit("More.\n"))).otherwise(written)
    docs = docs.join(e.groupBy("doc_id").agg(F.max("k").alias("last")), "doc_id", "left")
    image = F.when((k % 3 == 0) | (d % 10 == 0), plain).otherwise(now)
    before = e.where(~((k % 40 == 7) & (F.col("side") == "target"))).join(docs, "doc_id").select(_marker(k).alias("candidate_id"), "side", image.alias("text"))
    relations = r.select(_marker(F.col("o_orderkey")).alias("candidate_id"), F.col("source").alias("source_asset_id"), F.col("target").alias("target_asset_id"))
    return J.nonsemantic_proofs(relations, before, docs.where(d % 10 != 1).select(d.alias("asset_id"), now.alias("text")))


@query("""with c as (select o_orderkey as k, o_custkey as s, o_custkey + o_orderkey % 3 as t from orders),
j as (select c.*, a.c_custkey as sk, b.c_custkey as tk from c left join customer a on a.c_custkey = s left join customer b on b.c_custkey = t)
select k as candidate_id, case when sk is null or tk is null then 'asset_missing' when k % 17 = 0 then 'identity_changed' when k % 13 = 0 then 'revision_changed' when (k % 11 = 0 and s % 5 <> 0) or (k % 7 = 0 and t % 5 = 0) then 'snapshot_changed' end as problem from j""")
def candidate_ends(spark, sf_dir):
    """Whether candidates' ends are as they were found (analogue: orders as candidates of customers, faults by the keys)."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    asset = lambda x: F.concat(F.lit("asset-"), x)
    file_hash = lambda x: F.when(x % 5 != 0, F.concat(F.lit("hash-"), x))
    s, t = F.col("o_custkey"), F.col("o_custkey") + k % 3
    candidates = table(spark, sf_dir, "orders").select(
        k.alias("candidate_id"), s.alias("source_location"), F.when(k % 17 == 0, "other").otherwise(asset(s)).alias("source_asset_id"), F.lit("1").alias("source_revision"), F.when(k % 11 != 0, file_hash(s)).alias("source_snapshot_hash"),
        t.alias("target_location"), asset(t).alias("target_asset_id"), F.when(k % 13 == 0, "0").otherwise("1").alias("target_revision"), F.when((k % 7 == 0) & (t % 5 == 0), "old").otherwise(file_hash(t)).alias("target_snapshot_hash"),
    )
    customers = table(spark, sf_dir, "customer").select(c.alias("relative_path"), asset(c).alias("asset_id"), F.lit("1").alias("revision"), file_hash(c).alias("file_hash"))
    return J.end_changes(candidates, customers)


@query(r"""with t as (select conv_id, turn, coalesce(text, '') as x, string_split(coalesce(text, ''), ' ') as w, conv_id % 20 as f from conversations),
s as (select *, [i for i in range(1, len(w) + 1) if len(w[i]) % 2 = 1 and regexp_matches(w[i], '\S')] as kept from t),
p as (select *, case when f = 0 then 'unreadable' when f in (1, 2) then 'protocol_or_status' when not regexp_matches(x, '\S') then 'text_blank' when len(kept) = 0 then 'no_segments' end as problem from s)
select conv_id, turn, problem, case when problem is null then len(kept) else 0 end::bigint as segments, case when problem is null then 'transcript-' || lpad(kept[1]::varchar, greatest(3, len(kept[1]::varchar))::int, '0') end as first_id,
  case when problem is null then '{"device":"cpu","network_access":false}' end as metadata, case when problem is null and f = 3 then '[{"end":2.5,"start":1}]' when problem is null then '[]' end as missing_ranges from p""")
def provider_results(spark, sf_dir):
    """Turns of conversations as provider results, words as segments, cut down to allowed fields."""
    f, x = F.col("conv_id") % 20, F.coalesce("text", F.lit(""))
    words = F.transform(F.split(x, " "), lambda w, i: F.struct(i.alias("start_time"), (i + F.length(w) % 2).alias("end_time"), w.alias("text"), F.lit("/tmp/x").alias("path")))
    meta = F.struct(F.lit("cpu").alias("device"), F.lit(False).alias("network_access"), F.lit("/usr/bin/python").alias("python_executable"))
    gaps = F.when(f == 3, F.array(F.struct(F.lit(1).alias("start"), F.lit(2.5).alias("end"))))
    made = F.to_json(F.struct(F.when(f == 1, "v0").otherwise(V.PROTOCOL).alias("protocol"), F.when(f == 2, "failed").otherwise("partial").alias("status"), x.alias("text"), words.alias("segments"), meta.alias("provider_metadata"), gaps.alias("missing_ranges")))
    out = V.sanitized(F.when(f == 0, F.concat(F.lit("{"), made)).otherwise(made), F.concat(F.lit("conversation/"), F.col("conv_id")))
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("o"))
    part = lambda path: F.get_json_object("o.result", path)
    return got.select("conv_id", "turn", "o.problem", "o.segments", part("$.segments[0].segment_id").alias("first_id"), part("$.provider_metadata").alias("metadata"), part("$.missing_ranges").alias("missing_ranges"))
