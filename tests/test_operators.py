import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestra.functions import identity as I
from attestra.functions import text as T
from attestra.functions import web as W
from attestra.operators import quality as Q
from attestra.operators import relations as R
from attestra.operators import sequence as S
from attestra.operators import state as M
from attestra.operators.graph import connected_components
from attestra.sources import vault

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["asset_a", "asset_b", "retrieval_score", "shared_terms"] and out.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (2, 1), (10, 3)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0


def test_whole_graph(spark, tmp_path):
    rows = [(p, s, float(q)) for p, s, q in [(1, 1, 1), (1, 1, 2), (2, 1, 7), (3, 2, 50), (4, 2, 3), (4, 3, 1), (5, 4, 9), (1, 5, 30)]]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(p, -1 - s) for p, s, _ in rows}
    link = {v: v for e in edges for v in e}
    for _ in link:
        for a, b in edges:
            link[a] = link[b] = min(link[a], link[b])
    size = {c: list(link.values()).count(c) for c in link.values()}
    degree = {v: sum(v in e for e in edges) for v in link}
    got = entry.queries()
    assert {r["node"]: r["degree"] for r in got["endpoint_degree"](spark, str(tmp_path)).collect()} == degree
    assert {r["component"]: r["size"] for r in got["components"](spark, str(tmp_path)).collect()} == size


def test_all_document_frequencies(spark, tmp_path):
    rows = [(i, "shared " + f"word{i} word{i}") for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["term"]: r["df"] for r in entry.queries()["term_document_frequency"](spark, str(tmp_path)).collect()}
    assert got == {"shared": 25} | {f"word{i}": 1 for i in range(25)}


def test_clean_and_language(spark):
    assert one(spark, T.clean(F.col("t")), t="hello   world") == "hello world."
    assert one(spark, T.clean(F.col("t")), t="今天天气很好所以出门") == "今天天气很好。所以出门。"
    assert one(spark, T.detect_language(F.col("t")), t="字" * 25) == "zh-CN"
    assert one(spark, T.detect_language(F.col("t")), t="a" * 25) == "en"


def test_canonical_url(spark):
    url = "HTTP://Example.com/a?b=2&utm_source=x&a=1#top"
    assert one(spark, I.canonical_url(F.col("u")), u=url) == "http://example.com/a?a=1&b=2"
    assert one(spark, I.canonical_url(F.col("u")), u="ftp://x/y") is None


def test_routing(spark):
    for url, name in {"https://youtu.be/x": "youtube", "https://b23.tv/x": "bilibili", "/a/b.mp4": "local_file", "http://10.0.0.1/x": None, "https://example.com/": "generic_web"}.items():
        assert one(spark, W.platform(F.col("u")), u=url) == name


def test_page():
    page = W.read_page("<title>T</title><nav>no</nav><article><p>" + "word " * 30 + "</p></article>")
    assert page["title"] == "T" and page["readable_text"].startswith("word word") and "no" not in page["readable_text"]


def test_coverage(spark):
    df = spark.sql("select array(named_struct('start', 1D, 'end', 5D), named_struct('start', 3D, 'end', 8D), named_struct('start', 10D, 'end', 12D)) as i, 11D as d")
    assert df.select(Q.coverage(F.col("i"), F.col("d"))).first()[0] == 8.0
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 8.0), ("a", 10.0, 12.0)], "k string, s double, e double")
    assert S.interval_union(rows, "k", "s", "e").first()["covered"] == 9.0


def test_gate(spark):
    schema = "text string, status string, readable_text string, media_duration double, segments array<struct<segment_id:string,start_time:double,end_time:double,text:string>>, missing_ranges array<struct<start_time:double,end_time:double,reason:string>>"
    words = "这是一段可以正常阅读的文字，其中有标点。另外一句说明不同的事情！" * 2
    seg = [(f"s{i}", i * 10.0, i * 10.0 + 10, f"第{i}段") for i in range(6)]
    rows = [(words, "completed", words, 60.0, seg, []), (words, "failed", "", 600.0, [("s", 0.0, 600.0, "x")], []), (words, "partial", words, 60.0, seg, [(0.0, 1.0, "x")])]
    got = Q.transcript_gate(spark.createDataFrame(rows, schema)).collect()
    assert got[1]["structural_failures"] == ["giant_single_segment", "provider_failed"]
    assert got[1]["quality_status"] == "transcript_quality_failed" and got[2]["quality_status"] == "transcript_partial"
    assert got[0]["coverage_ratio"] == 1.0


def test_paragraphs(spark):
    rows = [("d", i, f"s{i}", i * 10.0, i * 10.0 + 10, "x" * 99 + ".") for i in range(6)]
    p = S.paragraphs(spark.createDataFrame(rows, "k string, pos int, segment_id string, start_time double, end_time double, text string"), "k", 250, 400).orderBy("paragraph_id").collect()
    assert [r["segment_ids"] for r in p] == [["s0", "s1", "s2"], ["s3", "s4", "s5"]]
    assert S.split_oversized("a" * 100, 50, 60) == ["a" * 60 + ".", "a" * 40]


def test_quota(spark):
    rows = [("hub", f"n{i}", "extends", f"{i:02d}") for i in range(8)] + [("hub", "s", "source_of", "99")]
    got = R.quota(spark.createDataFrame(rows, "source_asset_id string, target_asset_id string, relation_type string, ord string"), 3).collect()
    assert sum(r["kept"] for r in got) == 4 and all(r["kept"] for r in got if r["relation_type"] == "source_of")


def test_observations(spark):
    pool = spark.createDataFrame([("a", "2024-01-01T00:00:00", "2024-01-01T00:00:00", 1, "observing"), ("b", "2024-01-01T00:00:00", "2024-01-01T00:00:00", 1, "observing")], "candidate_id string, first_seen string, last_seen string, times_detected long, current_status string")
    seen = spark.createDataFrame([("a",), ("c",)], "candidate_id string")
    strong = spark.createDataFrame([("c",)], "candidate_id string")
    got = {r["candidate_id"]: (r["times_detected"], r["current_status"]) for r in M.observe(pool, seen, strong, "2024-05-01T00:00:00").collect()}
    assert got == {"a": (2, "observing"), "b": (1, "expired"), "c": (1, "promoted")}


def test_vault(spark, tmp_path):
    d = tmp_path / "20 学习笔记"
    d.mkdir()
    (d / "a.md").write_text("---\ntype: note\nstatus: formal\nasset_id: asset_sha256_" + "a" * 64 + "\n---\n# Title\n\n## One\ntext\n")
    (d / "my-draft.md").write_text("# x\n")
    got = {r["title"]: r for r in vault.scan_vault(spark, str(tmp_path)).collect()}
    assert got["Title"]["eligible"] and got["Title"]["sections"]["One"] == "text\n" and got["x"]["exclusion_reason"] == "draft_excluded"


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark._jvm
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_retrieval_in_blocks_shuffles_terms_but_no_lists(spark, monkeypatch):
    """Blocks change nothing, shared terms are the longest, and a term's assets are not sent to each of them."""
    rng = random.Random(5)
    pool = ["t" * rng.randrange(1, 9) + f"{k}" for k in range(180)]
    held = {i: set(rng.sample(pool, 12)) for i in range(2700)}
    rows = spark.createDataFrame([(i * 7919, t) for i, terms in held.items() for t in terms] + [(None, pool[0])], "id long, term string").repartition(4)
    before = _shuffled(spark)
    got = {(r["asset_a"], r["asset_b"]): r for r in R.retrieve_pairs(rows, 4, 3).collect()}
    sent = _shuffled(spark) - before
    assert got and sent < 4_000_000, sent
    monkeypatch.setattr(R, "MIN_BLOCKS", 3)
    monkeypatch.setattr(R, "MET_BLOCKS", 2)
    monkeypatch.setattr(R, "CELLS", 1)
    assert {(r["asset_a"], r["asset_b"]): r for r in R.retrieve_pairs(rows, 4, 3).collect()} == got
    df = {t: sum(t in terms for terms in held.values()) + (t == pool[0]) for t in pool}
    counts = {t for t, k in df.items() if k <= math.floor(4 * math.sqrt(len(held) + 1))}
    for (a, b), r in got.items():
        assert r["shared_terms"] == sorted(held[a // 7919] & held[b // 7919] & counts, key=lambda t: (-len(t), t))[:3]
    assert R.retrieve_pairs(rows, 4, 0).columns == ["asset_a", "asset_b", "retrieval_score"]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_retrieved_pairs_equal_brute_force(spark, kind):
    rng, name = random.Random(4), (lambda i: f"a{i:03d}") if kind == "string" else (lambda i: i)
    held = {name(i): {f"t{rng.randrange(30) if i % 3 else rng.randrange(6)}" for _ in range(rng.randrange(1, 8))} for i in range(70)}
    held[name(70)] = {"alone"}
    n, df = len(held), {}
    for terms in held.values():
        for t in terms:
            df[t] = df.get(t, 0) + 1
    weight = {t: 1 + math.log((n + 1) / k) for t, k in df.items() if 2 <= k <= max(12, math.floor(4 * math.sqrt(n)))}
    scores = {(a, b): s for a in held for b in held if a < b and (s := round(sum(weight.get(t, 0) for t in held[a] & held[b]), 9)) > 0}
    best = {p for e in held for p in sorted((p for p in scores if e in p), key=lambda p: (-scores[p], p))[:3]}
    rows = [(a, t) for a, terms in held.items() for t in terms]
    got = R.retrieve_pairs(spark.createDataFrame(rows + rows[:20], f"id {kind}, term string"), 3).collect()
    assert {(r["asset_a"], r["asset_b"]) for r in got} == best and len(got) == len(best)
    assert all(abs(r["retrieval_score"] - scores[r["asset_a"], r["asset_b"]]) < 6e-4 and set(r["shared_terms"]) <= held[r["asset_a"]] & held[r["asset_b"]] for r in got)
    assert R.retrieve_pairs(spark.createDataFrame([], f"id {kind}, term string"), 3).count() == 0


def test_rows_without_a_fact_are_spread(spark):
    """Rows that aren't active have no fact; they must not meet in one window, nor count for a fact."""
    a, m, r = "asset_sha256_" + "0" * 64, "material_sha256_" + "1" * 64, "revision_sha256_" + "2" * 64
    rows = [(f"x{i}", a, m, r, r, "extends", "extended_by", "rejected") for i in range(50)] + [("y", a, m, r, r, "extends", "extended_by", "approved"), ("z", m, a, r, r, "extended_by", "extends", "executed")]
    df = spark.createDataFrame(rows, "relation_id string, source_asset_id string, target_asset_id string, source_revision string, target_revision string, relation_type string, reciprocal_relation string, approval_status string")
    out = R.validate_registry(df)
    assert {x["relation_id"]: x["violations"] for x in out.collect()} == {f"x{i}": [] for i in range(50)} | {"y": ["duplicate_active_fact"], "z": ["duplicate_active_fact"]}
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert len(windows) == 2 and not any("target_asset_id" in w for w in windows) and any("w0" in w for w in windows)


def test_terms_shuffle_texts_and_not_terms(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (2, "gamma"), (None, "beta only")], "id long, text string")
    top = R.top_terms(df, "id", "text")
    assert {(r["id"], r["term"], r["n"], r["rank"]) for r in top.where("id is not null").collect()} == {(1, "alpha", 2, 1), (1, "beta", 1, 2), (2, "gamma", 2, 1), (2, "beta", 1, 2)}
    assert {r["term"]: r["df"] for r in R.document_frequency(top).collect()} == {"alpha": 1, "beta": 2, "gamma": 1, "only": 0}
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pages_are_classified_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        p = spark.range(1).select(F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"), F.lit("").alias("body"))
        assert W.classify_responses(p).first()["failure_class"] == "empty_html"
        assert int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, old)
