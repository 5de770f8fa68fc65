"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import collocations, fill_middle, mixing, near_vectors, ngram_jaccard, packing, preference, routed_search, rules, suffix_tree, toxicity, url_filter, warc
from attestra.llm.labelled import fold
from attestra.runtime import table

#: The url rules of the query: host, path, verdict.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
TOXIC_LIMIT = 0.7
QUALITY_LIMIT = 0.3


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all embeddings at cosine 0.95."""
    out = near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return out.withColumnRenamed("id", "vec_id")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations: 2k against 2k + 1."""
    turns = table(spark, sf_dir, "conversations")
    return preference.format_pairs(turns, preference.neighbours(turns))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with weights 1, 2, 3."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every 50th vector."""
    return routed_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules."""
    listed = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), listed).withColumnRenamed("id", "page_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 85 % of their four-word shingles."""
    out = ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.withColumnRenamed("id", "doc_id")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, pieces as digests."""
    return packing.pack(table(spark, sf_dir, "documents"), window=1024, digest=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    third = fold(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), third != 1)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_LIMIT).cast("int").alias("predicted"), "passages")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    model = rules.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    out = rules.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of 2 to 3 words of each language of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, top=2000, within=50)


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability, learned from four of five folds."""
    return suffix_tree.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put together again, as digests."""
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_preference_format, op3_source_mix, op4_routed_search, op5_url_filter,
        op6_ngram_jaccard, op7_pack, op8_toxicity, op9_quality_rules, op10_warc,
        op11_collocations, op12_suffix_tree, op13_fill_middle,
    )
}

_COMPONENTS = """
    reach(id, other) as (select id, id from nodes union select r.id, l.b from reach r join links l on r.other = l.a),
    comps as (select id, min(other) as component_id from reach group by id)"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
with recursive vecs as (select vec_id as id, embedding::double[] as v from embeddings),
    nodes as (select id from vecs),
    links as (select x.id as a, y.id as b from vecs x join vecs y on x.id <> y.id and len(x.v) = len(y.v)
              where list_cosine_similarity(x.v, y.v) >= 0.95),
{_COMPONENTS}
select c.id as vec_id, (select count(*) from links l where l.a = c.id)::bigint as n_links, c.component_id, c.id = c.component_id as kept
from comps c""",
    "op2_preference_format": r"""
with ends as (select conv_id // 2 as pair_id, min(conv_id) as chosen_id, max(conv_id) as rejected_id from conversations group by 1 having min(conv_id) < max(conv_id)),
t as (select e.pair_id, (c.conv_id <> e.chosen_id)::int as side, c.role, c.text,
             row_number() over (partition by c.conv_id order by c.turn nulls last, c.role, c.text) as pos
      from conversations c join ends e on c.conv_id in (e.chosen_id, e.rejected_id)),
d as (select *, count(*) over w = 2 and min(role) over w is not distinct from max(role) over w and min(text) over w is not distinct from max(text) over w as same
      from t window w as (partition by pair_id, pos)),
f as (select *, min(case when not same then pos end) over (partition by pair_id) as first from d),
b as (select *, coalesce(pos < first, true) as shared, '<|' || esc_role || '|>' || chr(10) || esc_text || '<|end|>' || chr(10) as body
       from (select *, regexp_replace(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\\\1>', 'g') as esc_role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') as esc_text from f)),
s as (select *, sum(length(body)) over (partition by pair_id, side, shared order by pos) as stop from b),
m as (select *, case when role = 'assistant' then (stop - length(body) + length(esc_role) + 5)::varchar || '-' || stop::varchar end as span from s)
select e.pair_id, e.chosen_id, e.rejected_id, count(*) filter (shared and side = 0)::bigint as prompt_turns,
  coalesce(string_agg(body, '' order by pos) filter (shared and side = 0), '') as prompt,
  coalesce(string_agg(body, '' order by pos) filter (not shared and side = 0), '') as chosen,
  coalesce(string_agg(body, '' order by pos) filter (not shared and side = 1), '') as rejected,
  coalesce(string_agg(span, ',' order by pos) filter (not shared and side = 0), '') as chosen_mask,
  coalesce(string_agg(span, ',' order by pos) filter (not shared and side = 1), '') as rejected_mask
from m join ends e using (pair_id) group by all""",
    "op3_source_mix": """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, row_number() over (order by source nulls last) as sid from s),
w as (select *, ((sid - 1) % 3 + 1)::double as weight, 3 * source_size as most from r),
l as (select *, coalesce(sum(most) over o, 0) as stopped, coalesce(sum(weight) over o, 0.0) as used, sum(source_size) over () as total, sum(weight) over () as heavy
      from w window o as (order by most::double / weight, sid rows between unbounded preceding and 1 preceding)),
v as (select *, (total - stopped)::double / (heavy - used) as level from l),
f as (select level as final from v where level * weight <= most order by stopped, level limit 1),
p as (select sid, source, source_size, least(most::double, final * weight) as target from v, f),
g as (select d.*, p.source_size, p.target, least(round(p.target)::bigint, 3 * p.source_size) as goal,
             sum(size) over (partition by p.sid order by d.h, d.doc_id, d.size rows between unbounded preceding and current row) - size as pos
      from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size::bigint as source_size, target,
  (greatest(0, least(size, goal - pos)) + greatest(0, least(size, goal - source_size - pos)) + greatest(0, least(size, goal - 2 * source_size - pos)))::bigint as taken
from g""",
    "op5_url_filter": f"""
with r(rh, rp, verdict) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
k as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h),
j as (select k.*, r.rh || r.rp as rule, r.verdict, row_number() over (partition by page_id order by length(r.rh || r.rp) desc nulls last) as n
      from k left join r on (k.host = r.rh or ends_with(k.host, '.' || r.rh)) and starts_with(k.path, r.rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from j where n = 1""",
    "op6_ngram_jaccard": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
    sh as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [words]
             else list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]) end) as g from w),
    n as (select doc_id, count(*) as n from sh group by 1),
    o as (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
    links as (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
    nodes as (select doc_id as id from documents),
{_COMPONENTS}
select c.id as doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from comps c left join n on n.doc_id = c.id""",
    "op10_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as first from p where n >= 100 group by 1)
select p.page_id, p.n::bigint as payload_bytes, p.digest as payload_digest,
  case when f.first < p.page_id then 'revisit' else 'response' end as record_type, case when f.first < p.page_id then f.first end as refers_to
from p left join f on p.digest = f.digest and p.n >= 100""",
    "op11_collocations": r"""
with d as (select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(pieces) as piece from d)),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from p, (values (1), (2), (3)) as ks(k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
t as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 10),
x as (select c.*, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:], ' ') as tail from c, (values (1), (2)) as js(j) where j < k),
s as (select x.lang, x.k, x.phrase, x.a, j, h.f as l, e.f as r, (1000000::hugeint * a * a // (h.f::hugeint * e.f))::bigint as score
      from x join f h on h.lang = x.lang and h.phrase = x.head join f e on e.lang = x.lang and e.phrase = x.tail),
b as (select *, row_number() over (partition by lang, phrase order by score, j) as pick from s),
o as (select lang, phrase, max(a) as outer_a from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from c where k = 3) group by 1, 2),
z as (select b.lang, b.phrase, a, l, r, score, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
      from b left join o on o.lang = b.lang and o.phrase = b.phrase and b.k = 2 where pick = 1 and (outer_a is null or 100 * outer_a < 50 * a))
select z.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, t.n, score from z join t on t.lang = z.lang where rank <= 2000""",
    "op13_fill_middle": """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select doc_id, t, length(t)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as one, greatest(h1 % (n + 1), h2 % (n + 1)) as two,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
o as (select *, substr(t, 1, one) as pre, substr(t, one + 1, two - one) as mid, substr(t, two + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then one end as prefix_chars, case when form <> 'plain' then two - one end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from o""",
}
