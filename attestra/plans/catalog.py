"""Query catalogue: name -> query and, where SQL can say it, DuckDB SQL.

Queries on the business tables are analogues: the operator is the engine's, the rows are stand-ins for its own records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import identity as I
from attestra.functions import text as T
from attestra.functions import web as W
from attestra.operators import overlap as O
from attestra.operators import quality as Q
from attestra.operators import relations as R
from attestra.operators import sequence as S
from attestra.operators import state as M
from attestra.operators.graph import connected_components
from attestra.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_MEASURES = """m as (select *, length(t) as n, len(regexp_extract_all(t, '[。！？!?；;，,、：:.]')) as p, len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]')) as a,
  list_max(list_transform(string_split_regex(t, '[。！？!?；;，,、：:.]'), lambda x: length(x))) as r,
  regexp_matches(lower(t), 'no transcript acquired|transcript unavailable|missing transcript|暂无转录|未取得字幕|无转录内容') as ph from s),
g as (select *, case when n = 0 or ph or a / greatest(1, n) > 0.02 or (n >= 500 and p * 100 / greatest(1, n) < 0.15) or r > 800 then 'unusable'
  when (n >= 300 and p * 100 / greatest(1, n) < 0.35) or r > 400 then 'usable_with_warnings' else 'usable' end as status from m)"""
_SQUEEZED = "s as (select *, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) as t from documents)"


@query(f"with {_SQUEEZED}, {_MEASURES} select lang, status, count(*)::bigint as n from g group by all")
def document_quality_gate(spark, sf_dir):
    """Content rules over documents, counted by language and status."""
    return Q.document_gate(table(spark, sf_dir, "documents")).groupBy("lang", "status").agg(F.count("*").alias("n"))


@query(f"with {_SQUEEZED}, {_MEASURES} select g.status, l.quality, count(*)::bigint as n from g join labels l using (doc_id) group by all")
def gate_vs_label(spark, sf_dir):
    """Status of the gate against the labels."""
    docs = Q.document_gate(table(spark, sf_dir, "documents")).select("doc_id", "status")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("status", "quality").agg(F.count("*").alias("n"))


@query("select lang, quantile_disc(length(text), 0.5)::bigint as p50, quantile_disc(length(text), 0.95)::bigint as p95, max(length(text))::bigint as longest from documents group by lang")
def document_length_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of text lengths."""
    n = F.length("text").cast("long")
    d = table(spark, sf_dir, "documents").select("lang", n.alias("n"))
    return d.groupBy("lang").agg(F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) within group (order by n)").cast("long").alias("p95"), F.max("n").alias("longest"))


@query("""with c as (select lang, len(regexp_extract_all(text, '[㐀-鿿]')) as h, len(regexp_extract_all(text, '[A-Za-z]')) as l from documents)
select lang, case when h >= greatest(20.0, l * 0.2) then 'zh-CN' when l >= greatest(20, h * 2) then 'en' when h > 0 or l > 0 then 'mixed' else 'unknown' end as detected, count(*)::bigint as n from c group by all""")
def language_detect_vs_declared(spark, sf_dir):
    """Detected against declared languages."""
    return table(spark, sf_dir, "documents").groupBy("lang", T.detect_language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


@query()
def repetition_pollution(spark, sf_dir):
    """Characters in repeated runs and phrases; back-references are beyond the SQL."""
    t = T.squeeze(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.repeated_run_chars(t).alias("run_chars"), T.repeated_phrase_chars(t).alias("phrase_chars"))


@query("select doc_id, 'sha256:' || sha256(text) as content_hash, 'asset_sha256_' || sha256(text) as asset_id from documents")
def content_identity(spark, sf_dir):
    """Content hashes and asset ids."""
    h = I.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), I.asset_id(h).alias("asset_id"))


@query("select 'sha256:' || sha256(text) as h, count(*)::bigint as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    """Groups of equal content hashes."""
    g = table(spark, sf_dir, "documents").groupBy(I.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return g.where("copies > 1")


#: What a fingerprint drops, in the SQL's classes.
_NO_WORD = "[^\\p{L}\\p{M}\\p{Nl}\\p{Nd}\\p{Pc}]+"


@query(f"select md5(lower(regexp_replace(text, '{_NO_WORD}', '', 'g'))) as h, count(*)::bigint as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def fingerprint_duplicates(spark, sf_dir):
    """Groups of texts whose fingerprints are equal."""
    key = F.md5(T.fingerprint(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy(key.alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_TERMS = """t as (select doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_-]{2,}')) as term, generate_subscripts(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_-]{2,}'), 1) as pos from documents),
c as (select doc_id, term, count(*) as n, min(pos) as first from t where term not in ('source', 'asset', 'knowledge', 'learning', 'video', 'material', 'content', 'relation') group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, first) as rank from c)"""


@query(f"with {_TERMS} select term, count(distinct doc_id)::bigint as df from r where rank <= 220 group by term")
def term_document_frequency(spark, sf_dir):
    """In how many documents a term is among the 220 most frequent, for every term."""
    return R.document_frequency(R.top_terms(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"with {_TERMS} select doc_id, term, n::bigint as n, rank::bigint as rank from r where rank <= 5")
def top_terms_per_document(spark, sf_dir):
    """The five most frequent terms of each document."""
    return R.top_terms(table(spark, sf_dir, "documents"), "doc_id", "text", 5).select(F.col("id").alias("doc_id"), "term", "n", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_TERMS}, u as (select doc_id, term from r where rank <= 220), k as (select count(distinct doc_id) as n from u),
f as (select term, count(*) as df from u group by 1), w as (select term, 1 + ln((n + 1) / df) as weight from f, k where df >= 2 and df <= greatest(12, floor(sqrt(n) * 4))),
p as (select u.*, w.weight from u join w using (term)),
s as (select a.doc_id as a, b.doc_id as b, round(sum(a.weight), 9) as score from p a join p b on a.term = b.term and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b, score, unnest([a, b]) as e from s), q as (select *, row_number() over (partition by e order by score desc, a, b) as rank from e)
select distinct a as asset_a, b as asset_b, round(score, 3) as retrieval_score from q where rank <= 12""")
def related_document_pairs(spark, sf_dir):
    """Documents related by shared terms: the twelve best of each."""
    return R.related_pairs(R.term_lists(table(spark, sf_dir, "documents"), "doc_id", "text"), shared=0)


@query("""with s as (select item_id, list_distinct(list_transform(range(1, greatest(1, length(t) - 4) + 1), lambda i: substr(t, i, 5))) as g
  from (select item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') as t from benchmark)),
d as (select doc_id, list_distinct(list_transform(range(1, greatest(1, length(t) - 4) + 1), lambda i: substr(t, i, 5))) as g
  from (select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') as t from documents)),
x as (select d.doc_id, s.item_id, count(*) as c from (select doc_id, unnest(g) as k from d) d join (select item_id, unnest(g) as k from s) s using (k) group by 1, 2)
select x.doc_id, x.item_id, c::bigint as shared from x join d using (doc_id) join s using (item_id) where c / least(len(d.g), len(s.g)) >= 0.58""")
def shingle_overlap_benchmark(spark, sf_dir):
    """Documents that overlap a benchmark text by 0.58 or more of the smaller set of character shingles."""
    return O.overlapping(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("""with d as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\\d+'))) as token from documents), b as (select distinct unnest(regexp_extract_all(text, '\\d+')) as token from benchmark)
select doc_id, count(*)::bigint as unsupported from d anti join b using (token) group by 1""")
def unsupported_number_tokens(spark, sf_dir):
    """Numbers of documents that no benchmark text has (analogue: digits only)."""
    tokens = lambda t: F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit("\\d+"), F.lit(0)))).alias("token")
    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")))
    return d.join(table(spark, sf_dir, "benchmark").select(tokens(F.col("text"))).distinct(), "token", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unsupported"))


_URL = """u as (select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as q from pages),
k as (select *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|si|feature)='))), '&') as kept from u),
c as (select page_id, scheme || '://' || host || path || case when kept <> '' then '?' || kept else '' end as canonical from k)"""


@query(f"with {_URL} select page_id, canonical from c")
def canonical_urls(spark, sf_dir):
    """Canonical addresses of pages."""
    return table(spark, sf_dir, "pages").select("page_id", I.canonical_url(F.col("url")).alias("canonical"))


@query(f"with {_URL} select page_id, 'url:sha256:' || sha256(canonical) as source_key, 'material_sha256_' || sha256('url:sha256:' || sha256(canonical)) as material_id from c")
def source_keys(spark, sf_dir):
    """Source keys and material ids of pages."""
    key = I.source_key(F.lit("web"), F.lit("unknown"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("source_key"), I.material_id(key).alias("material_id"))


@query("select 'generic_web' as platform, 'generic_web_static' as provider, count(*)::bigint as n from pages where regexp_matches(url, '^https?://[^/?#]+') having count(*) > 0")
def route_platforms(spark, sf_dir):
    """Pages by platform and provider."""
    p = table(spark, sf_dir, "pages").select(W.platform(F.col("url")).alias("platform"))
    return p.groupBy("platform", W.provider(F.col("platform"))["provider"].alias("provider")).agg(F.count("*").alias("n"))


@query()
def page_extract(spark, sf_dir):
    """Readable text and title of pages, by an HTML parser."""
    p = table(spark, sf_dir, "pages").select("page_id", W.extract_page("html").alias("x"))
    return p.select("page_id", "x.title", F.length("x.readable_text").alias("n_chars"), F.md5("x.readable_text").alias("text_md5"))


@query()
def page_failure_class(spark, sf_dir):
    """Failure ladder over pages taken as successful responses."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"), F.col("html").alias("body"))
    return W.classify_responses(p).groupBy("failure_class").agg(F.count("*").alias("n"))


@query("""select page_id, (contains(lower(html), 'login')::int + contains(lower(html), 'sign in')::int + contains(lower(html), 'log in')::int + contains(html, '登录')::int + contains(html, '请登录')::int + contains(lower(html), 'password')::int + contains(html, '用户名')::int) >= 2 as login,
  regexp_matches(lower(html), 'captcha|cloudflare|verify you are human|人机验证|安全验证|challenge-platform') as challenge, contains(lower(html), '<script') as script from pages""")
def raw_page_signals(spark, sf_dir):
    """Login, challenge and script signals in raw pages."""
    h, none = F.coalesce("html", F.lit("")), F.lit("")
    return table(spark, sf_dir, "pages").select("page_id", W.looks_like_login(h, none).alias("login"), W.looks_like_challenge(h, none).alias("challenge"), F.contains(F.lower(h), F.lit("<script")).alias("script"))


@query(f"""with k as (select *, lower(regexp_replace(text, '{_NO_WORD}', '', 'g')) as print from conversations where text <> ''),
l as (select *, lag(print) over (partition by conv_id order by turn) as before from k) select conv_id, turn from l where print = '' or print is distinct from before""")
def conversation_dedup(spark, sf_dir):
    """Turns that don't repeat the one before."""
    return S.drop_repeats(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], cleaned=False).select("conv_id", "turn")


@query()
def conversation_paragraphs(spark, sf_dir):
    """Turns as segments of ten seconds, joined into paragraphs."""
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("pos"), F.format_string("transcript-%04d", F.col("turn") + 1).alias("segment_id"), (F.col("turn") * 10.0).alias("start_time"), (F.col("turn") * 10.0 + 10).alias("end_time"), "text"
    )
    p = S.paragraphs(S.drop_repeats(c, "conv_id", ["start_time", "end_time", "pos"]), "conv_id")
    return p.select("conv_id", "paragraph_id", "start_time", "end_time", F.length("text").alias("n_chars"), F.size("segment_ids").alias("segments"))


@query("""with s as (select *, turn * 10.0 as b, turn * 10.0 + length(text) - 40 as e from conversations),
l as (select *, lag(b) over (partition by conv_id order by turn) as before from s)
select conv_id, not bool_or(coalesce(b < before or e <= b, false)) as in_order, md5(string_agg(text, '' order by turn)) as text_md5 from l group by 1""")
def conversation_turn_order(spark, sf_dir):
    """Whether a conversation's turns as segments are in order, and their text as one (analogue: ends by text length)."""
    c = table(spark, sf_dir, "conversations").withColumns({"pos": F.col("turn"), "start": F.col("turn") * 10.0, "end": F.col("turn") * 10.0 + F.length("text") - 40})
    whole = S.merged_text(c, "conv_id").select("conv_id", F.md5("text").alias("text_md5"))
    return S.in_order(c, "conv_id", "start", "end", "pos").join(whole, "conv_id")


@query("""with l as (select conv_id, list_sort(list(length(text)::double)) as v from conversations group by 1)
select conv_id, v[greatest(1, ceil(len(v) * 0.5))::int] as p50, v[greatest(1, ceil(len(v) * 0.95))::int] as p95 from l""")
def turn_length_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of the lengths of a conversation's turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("double")).alias("v"))
    return c.select("conv_id", T.percentile_of(F.col("v"), 0.5).alias("p50"), T.percentile_of(F.col("v"), 0.95).alias("p95"))


@query("""with i as (select user_id, epoch_us(ts) as s, least(epoch_us(lead(ts) over (partition by user_id order by ts, event_id)), epoch_us(ts) + 3600000000) as e from events),
o as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as top from i where e > s),
n as (select *, sum((top is null or s > top)::int) over (partition by user_id order by s, e rows between unbounded preceding and current row) as island from o)
select user_id, sum(x)::bigint as covered from (select user_id, island, max(e) - min(s) as x from n group by 1, 2) group by 1""")
def event_interval_coverage(spark, sf_dir):
    """Microseconds of each user covered by intervals from an event to the next, an hour at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", s.alias("s"), F.least(F.lead(s).over(w), s + 3600000000).alias("e"))
    return S.interval_union(e.withColumnsRenamed({"s": "begin", "e": "until"}), "user_id", "begin", "until").select("user_id", F.col("covered").cast("long").alias("covered"))


@query("select event_id, user_id from events where event_type = 'purchase' and user_id = 7 and ts >= timestamp '2024-01-10'")
def event_log_lookup(spark, sf_dir):
    """Log lookup by type, reference and time."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("array<string>")
    log = e.withColumns({c: none for c in M.REFERENCE_COLUMNS}).withColumns(
        {"output_refs": F.array(F.concat(F.lit("user:"), F.col("user_id"))), "operation_type": F.col("event_type"), "started_at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    )
    return M.find_operations(log, "user:7", "purchase", "2024-01-10 00:00:00").select("event_id", "user_id")


@query("select user_id, arg_max(event_type, {'t': ts, 'e': event_id}) as last_type, max(ts) as last_ts from events group by 1")
def event_latest_state(spark, sf_dir):
    """Last event of each user."""
    e = table(spark, sf_dir, "events")
    return S.latest(e.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", F.lit(True)).select("user_id", F.col("event_type").alias("last_type"), F.col("ts").alias("last_ts"))


@query("""with p as (select user_id, min(ts) as f, max(ts) as l, count(*) as n from events where ts < timestamp '2024-01-20' group by 1), s as (select distinct user_id from events where ts >= timestamp '2024-01-20' and event_type = 'click'),
g as (select distinct user_id from events where ts >= timestamp '2024-01-20' and event_type = 'purchase')
select coalesce(p.user_id, s.user_id) as user_id, coalesce(n, 0)::bigint + (s.user_id is not null)::int as times_detected,
  case when g.user_id is not null then 'promoted' when s.user_id is null and l < timestamp '2024-01-25' then 'expired' else 'observing' end as current_status
from p full join s on p.user_id = s.user_id left join g on g.user_id = coalesce(p.user_id, s.user_id)""")
def event_observation_expiry(spark, sf_dir):
    """A pool of users seen before a day, reconciled with clicks and purchases after it; expiry after seven days."""
    e = table(spark, sf_dir, "events").withColumn("candidate_id", F.col("user_id"))
    cut = F.lit("2024-01-20").cast("timestamp")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    pool = e.where(F.col("ts") < cut).groupBy("candidate_id").agg(text(F.min("ts")).alias("first_seen"), text(F.max("ts")).alias("last_seen"), F.count("*").alias("times_detected"), F.lit("observing").alias("current_status"))
    late = e.where(F.col("ts") >= cut)
    out = M.observe(pool, late.where("event_type = 'click'"), late.where("event_type = 'purchase'"), "2024-02-01T00:00:00", 7)
    return out.select(F.col("candidate_id").alias("user_id"), "times_detected", "current_status")


@query("select count(*)::bigint as missing from lineitem l anti join (select o_orderkey from orders where o_orderstatus <> 'F') o on l.l_orderkey = o.o_orderkey")
def missing_references(spark, sf_dir):
    """Rows whose reference is missing: line items without an order that isn't finished (analogue)."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("reference"))
    return M.missing_references(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference")), o).agg(F.count("*").alias("missing"))


@query("select l_returnflag as flag, count(*)::bigint as n from lineitem join part on l_partkey = p_partkey where l_quantity::bigint <> p_size group by 1")
def hash_mismatch(spark, sf_dir):
    """Rows whose value differs from their entry's: quantities against part sizes (analogue)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("reference"), F.col("p_size").cast("long").alias("content_hash"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("reference"), F.col("l_quantity").cast("long").alias("content_hash"), "l_returnflag")
    return M.hash_mismatches(r, p).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("""select 'm' || c_custkey as source_asset_id, 'o' || o_orderkey as target_asset_id, o_orderkey % 25 = c_nationkey as exact from orders join customer on o_custkey = c_custkey
where c_acctbal > 0 and o_orderstatus <> 'F' and starts_with('r' || (o_orderkey % 25), 'r' || c_nationkey)""")
def structural_links(spark, sf_dir):
    """source_of candidates: orders as assets derived from customers at a revision, finished ones related already (analogue)."""
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(text("m", "c_custkey").alias("asset_id"), (F.col("c_acctbal") > 0).alias("eligible"), F.lit("source").alias("asset_class"), text("r", "c_nationkey").alias("revision"), F.create_map().cast("map<string,string>").alias("frontmatter"))
    o = table(spark, sf_dir, "orders").withColumns({"source": text("m", "o_custkey"), "asset_id": text("o", "o_orderkey"), "seen": F.concat(F.lit("r"), (F.col("o_orderkey") % 25).cast("string"))})
    reference = F.concat(F.lit("vault://material/"), "source", F.lit("/revision/"), "seen")
    front = F.create_map(F.lit("source_asset"), "source", F.lit("source_revision"), "seen", F.lit("source_reference"), reference)
    derived = o.select("asset_id", F.lit(True).alias("eligible"), F.lit("derived").alias("asset_class"), F.lit("x").alias("revision"), front.alias("frontmatter"))
    had = o.where("o_orderstatus = 'F'").select(F.col("source").alias("source_asset_id"), F.col("asset_id").alias("target_asset_id"), F.lit("source_of").alias("relation_type"), F.lit("derived_from").alias("reciprocal_relation"), F.lit("executed").alias("approval_status"))
    out = R.structural_candidates(c.unionByName(derived), had, "vault")
    return out.select("source_asset_id", "target_asset_id", F.array_contains("evidence_kinds", "revision_match").alias("exact"))


@query("select node, count(*)::bigint as degree from (select distinct l_partkey as p, -1 - l_suppkey as s from lineitem) unpivot (node for side in (p, s)) group by 1")
def endpoint_degree(spark, sf_dir):
    """Degrees in the graph of parts and suppliers."""
    return _edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _edges(spark, sf_dir) -> DataFrame:
    """Every part and supplier that a line item joins; suppliers are negative, so that they are no part's id at any size."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()


@query()
def components(spark, sf_dir):
    """Connected components of that graph, by size; a recursive SQL is too slow on it, a test holds it against brute force."""
    return connected_components(_edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size"))


@query("""with s as (select distinct c_custkey as id from customer), e as (select distinct o_custkey as a, (o_custkey * 7 + 1) % 1500 as b, 1 as k from orders),
x as (select a, b from e where a in (select id from s) and b in (select id from s)), p as (select distinct least(a, b) as a, greatest(a, b) as b from x where a <> b),
d as (select id, count(p.a) as n from s left join p on id in (p.a, p.b) group by 1)
select count(*)::bigint as nodes, (select count(*) from x)::bigint as relations, count(*) filter (n = 0)::bigint as isolated, round(avg(n), 3) as average_degree, max(n)::bigint as max_degree, max(n) >= greatest(6.0, 0.6 * count(*)) as hub_warning from d""")
def graph_summary(spark, sf_dir):
    """Graph measures of a made graph of customers (analogue)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_asset_id"), ((F.col("o_custkey") * 7 + 1) % 1500).alias("target_asset_id")).distinct()
    g = R.graph_metrics(o.withColumn("approval_status", F.lit("executed")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id")))
    return g.select("nodes", "relations", "isolated", "average_degree", "max_degree", "hub_warning")


@query()
def overlink_quota(spark, sf_dir):
    """Retrieved pairs under the greedy quota of six a document, best scores first."""
    p = R.related_pairs(R.term_lists(table(spark, sf_dir, "documents"), "doc_id", "text"), shared=0)
    s = p.select(F.col("asset_a").cast("string").alias("source_asset_id"), F.col("asset_b").cast("string").alias("target_asset_id"), F.lit("extends").alias("relation_type"), F.format_string("%014.3f|%012d|%012d", 1e9 - F.col("retrieval_score"), "asset_a", "asset_b").alias("ord"))
    return R.quota(s).select("source_asset_id", "target_asset_id", "kept")


@query("""with a as (select c_custkey as k, (c_nationkey % 2)::varchar as revision, (c_nationkey % 3)::varchar as hash, c_mktsegment as line, c_nationkey::varchar as n from customer where c_acctbal > -500),
j as (select o.*, s.k as sk, t.k as tk, coalesce(s.revision <> (o_orderkey % 2)::varchar or t.revision <> '1', false) as changed, s.line = 'BUILDING' and t.line <> 'BUILDING' as held,
  left(o_orderpriority, 1) in (select left(o_orderpriority, 1) from orders where o_orderstatus = 'F') and s.hash = '1' and t.hash = '1' as proven,
  contains(s.n, left(o_orderpriority, 1)) or contains(t.n, left(o_orderpriority, 1)) as marked
  from orders o left join a s on s.k = o_custkey left join a t on t.k = (o_custkey * 7 + 1) % 1500)
select status, count(*)::bigint as n from (select case when sk is null or tk is null then 'needs_review' when changed and held and proven then 'verified' when changed then 'needs_review'
  when held then 'healthy' when marked then 'conflict' else 'repair_candidate' end as status from j) group by 1""")
def audit_ladder(spark, sf_dir):
    """The registry audit: orders as relations of two customers, market segments as their lines (analogue)."""
    text = lambda c: c.cast("string")
    c = table(spark, sf_dir, "customer").where("c_acctbal > -500")
    line = F.concat("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("~"), text(F.col("c_nationkey")))
    assets = c.select(text(F.col("c_custkey")).alias("asset_id"), text(F.col("c_nationkey") % 2).alias("revision"), text(F.col("c_nationkey") % 3).alias("file_hash"), line.alias("text"))
    o = table(spark, sf_dir, "orders")
    registry = o.select(
        F.col("o_orderkey").alias("relation_id"), F.lit("executed").alias("approval_status"), F.left("o_orderpriority", F.lit(1)).alias("mark"),
        text(F.col("o_custkey")).alias("source_asset_id"), text((F.col("o_custkey") * 7 + 1) % 1500).alias("target_asset_id"),
        text(F.col("o_orderkey") % 2).alias("source_revision"), F.lit("1").alias("target_revision"), F.lit("BUILDING").alias("source_line"), F.lit("~").alias("target_line"),
    )
    receipts = o.where("o_orderstatus = 'F'").select(F.left("o_orderpriority", F.lit(1)).alias("candidate_id"), F.lit("p").alias("path"), F.lit("1").alias("source_hash"), F.lit("1").alias("target_hash"))
    return R.audit(registry.withColumnRenamed("mark", "candidate_id"), assets, receipts).groupBy("status").agg(F.count("*").alias("n"))


@query("""with a as (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as f, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc) as l from lineitem)
select l_partkey, max(l_orderkey) filter (f = 1) as first_key, max(l_orderkey) filter (l = 1) as last_key from a group by 1""")
def ordered_dedup_first_last(spark, sf_dir):
    """First and last entry of each reference."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    order = [F.col("l_orderkey"), F.col("l_linenumber")]
    pick = lambda last, name: S.first_or_last(li, "l_partkey", order, last).select("l_partkey", F.col("l_orderkey").alias(name))
    return pick(False, "first_key").join(pick(True, "last_key"), "l_partkey")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: related documents by bounded retrieval over an inverted index."""
    return R.related_pairs(R.term_lists(table(spark, sf_dir, "documents"), "doc_id", "text"))
