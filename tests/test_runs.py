"""Runs, lookups and publishing against their rules."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.operators import lookups as L
from attestra.operators import runs
from attestra.sources import publish as P
from attestra.sources import vault

ASSET = "asset_id string, revision string, eligible boolean, exclusion_reason string, asset_class string, title string, sections map<string,string>, frontmatter map<string,string>, path string, file_hash string"
REGISTRY = "relation_id string, candidate_id string, source_asset_id string, source_revision string, target_asset_id string, target_revision string, relation_type string, reciprocal_relation string, approval_status string"
POOL = "candidate_id string, first_seen string, last_seen string, times_detected long, current_status string"


def sha(n):
    return f"{n:064x}"


def assets(spark):
    note = lambda n, text, kind="knowledge", ok=True: (f"asset_sha256_{sha(n)}", f"snapshot_sha256_{sha(n)}", ok, "" if ok else "draft_excluded", kind, f"笔记{n}", {"正文": text}, {}, f"{n}.md", f"sha256:{sha(n)}")
    words = "alpha_model beta_signal gamma_window delta_filter"
    rows = [
        note(1, f"**注意力预算**在原有框架上的讨论。在**注意力预算**基础上进一步扩展出新的适用范围，参见 {words}。"),
        note(2, f"**注意力预算**是一个核心主张，结论是预算决定了阅读的深度，参见 {words}。"),
        note(3, "完全无关的另一段文字，没有任何共同的概念或术语。"),
        note(4, f"**注意力预算**的草稿，参见 {words}。", ok=False),
    ]
    m, r = f"material_sha256_{sha(9)}", f"revision_sha256_{sha(9)}"
    reference = {"source_asset": m, "source_revision": r, "source_reference": f"vault://material/{m}/revision/{r}"}
    rows += [(m, r, True, "", "source", "来源", {"正文": "来源的正文。"}, {}, "s.md", "sha256:" + sha(9)), (*note(5, "一段由来源得到的笔记文字。")[:7], reference, "5.md", f"sha256:{sha(5)}")]
    return spark.createDataFrame(rows, ASSET)


def test_curation(spark):
    a, empty, pool = assets(spark), spark.createDataFrame([], REGISTRY), spark.createDataFrame([], POOL)
    got = runs.curate(a, empty, pool, "vault", "2024-05-01T00:00:00")
    strong = {(r["source_asset_id"][-1], r["target_asset_id"][-1], r["relation_type"]) for r in got["strong"].collect()}
    assert strong == {("1", "2", "extends"), ("9", "5", "source_of")}
    s = got["summary"].first()
    assert (s["scanned"], s["eligible"], s["strong"], s["relations_applied"], s["existing_relations_before"]) == (6, 5, 2, 2, 0)
    assert (s["candidate_pairs"], s["medium"], s["weak"]) == (10, 0, 8)  # all share the heading; one pair is structural
    assert [r["reason"] for r in got["excluded"].collect()] == ["draft_excluded"]
    before, after = got["graph_before"].first(), got["graph_after"].first()
    assert (before["relations"], before["isolated"], after["relations"], after["isolated"], after["components"]) == (0, 5, 2, 1, 3)
    registry = spark.createDataFrame(got["registry"].collect(), REGISTRY)
    assert all(r["relation_id"].startswith("relation_sha256_") and r["approval_status"] == "auto_executed" for r in registry.collect())
    again = runs.curate(a, registry, pool, "vault", "2024-06-01T00:00:00")
    assert again["applied"].count() == 0 and again["registry"].count() == 2
    weak = {r["reason"]: r["n"] for r in again["weak_statistics"].collect()}
    assert weak["duplicate_existing_relation"] == 1 and sum(weak.values()) == 10


def test_conflict_refuses_the_run(spark):
    a = assets(spark)
    ids = [f"asset_sha256_{sha(n)}" for n in (2, 1)]
    row = ("r", "c", ids[0], "x", ids[1], "x", "supports", "supported_by", "executed")
    with pytest.raises(ValueError, match="relation_conflicts"):
        runs.curate(a, spark.createDataFrame([row], REGISTRY), spark.createDataFrame([], POOL), "vault", "2024-05-01T00:00:00")


def test_empty_run(spark):
    got = runs.discover(spark.createDataFrame([], ASSET), spark.createDataFrame([], REGISTRY), "vault")
    assert {k: v.count() for k, v in got.items()} == dict.fromkeys(("strong", "medium", "weak", "retrieved", "excluded"), 0)
    assert tuple(runs.counts(a=got["strong"], b=got["weak"]).first()) == (0, 0)


def test_statuses(spark):
    rows = [("a", "published_or_already_published"), ("a", "pending_retry"), ("b", "published_or_already_published"), ("c", None)]
    got = runs.final_status(spark.createDataFrame(rows, "bundle string, status string"), "bundle").collect()
    assert {r["bundle"]: r["final_status"] for r in got} == {"a": "publish_partial", "b": "published", "c": "publish_partial"}
    kinds = spark.createDataFrame([("method_asset",), ("other",), ("source_asset",), (None,)], "k string")
    assert [r["k"] for r in L.in_fixed_order(kinds, "k").collect()] == ["source_asset", "method_asset", "other", None]


def test_guards(spark):
    name = "op_capture_" + "a" * 32
    log = spark.createDataFrame([(name, "started"), ("op_capture_" + "b" * 32, "failed"), ("op_capture_" + "b" * 32, "failed")], "operation_id string, status string")
    assert L.get_operation(log, name).count() == 1 and L.get_operation(log, "op_capture_" + "c" * 32).count() == 0
    for bad in ("x", "op_capture_" + "A" * 32, "op_other_" + "a" * 32):
        with pytest.raises(ValueError, match="invalid operation id"):
            L.get_operation(log, bad)
    with pytest.raises(ValueError, match="duplicate"):
        L.get_operation(log, "op_capture_" + "b" * 32)
    c = spark.createDataFrame([("x",), ("y",)], "candidate_id string")
    assert L.load_candidate(c, c.where("candidate_id = 'z'"), "x").count() == 1
    for strong, medium, key in ((c, c, "x"), (c, c, "z")):
        with pytest.raises(ValueError, match="must identify one"):
            L.load_candidate(strong, medium, key)


def test_projections(spark):
    page = lambda m, r, body="b": f"---\nmaterial_id: {m}\nrevision_id: {r}\n---\n{body}"
    files = spark.createDataFrame([("a.md", page("a", "1")), ("b.md", page("b", "1", "other")), ("c.md", page("c", "0")), ("d1.md", page("d", "1")), ("d2.md", page("d", "1")), ("e.md", "plain")], "path string, text string")
    rows = [(m, "1", f"{m}.md", page(m, "1"), "capture_completed") for m in "abcdef"]
    sources = spark.createDataFrame(rows, "material_id string, revision_id string, requested string, rendered string, state string")
    got = {r["material_id"]: (r["status"], r["action"]) for r in L.projection_actions(sources, files).collect()}
    done, wait = "capture_completed", L.PENDING
    assert got == {"a": ("already_projected", None), "b": (wait, None), "c": (done, "updated"), "d": (wait, None), "e": (done, "created"), "f": (done, "created")}
    assert {r["material_id"]: r["action"] for r in L.projection_actions(sources, files, refresh=True).collect()}["b"] == "refreshed"


def test_captures_and_languages(spark):
    whole = {"protocol": "capture-protocol-v2", "source": {"title": " ", "platform": "p"}, "capture": {"warnings": ["a", "b"]}, "media": {"files": [{"path": ""}, {"path": "m.mp4"}]}}
    rows = [(1, json.dumps(whole)), (2, json.dumps({"protocol": "other"})), (3, "{"), (4, None), (5, json.dumps({"protocol": "capture-protocol-v2", "subtitle": {"reference": "s.vtt"}}))]
    got = {r["id"]: r for r in L.capture_results(spark.createDataFrame(rows, "id int, record string")).collect()}
    assert (got[1]["title"], got[1]["platform"], got[1]["raw_file_reference"], got[1]["failure_reason"], got[1]["problem"]) == ("unknown", "p", "m.mp4", "a | b", None)
    assert got[2]["problem"] and got[3]["problem"] and got[4]["problem"] and got[5]["raw_file_reference"] == "s.vtt"
    one = spark.range(1).select(
        L.subtitle_languages(F.array(F.lit("en"), F.lit("fr")), F.array(F.lit("zh"))).alias("langs"), L.missing_sections(F.lit("来源信息")).alias("missing"), L.yaml_scalar(F.lit('a"b')).alias("y"), L.yaml_scalar(F.lit(3)).alias("n"),
        L.transcript_markdown(F.lit("en"), F.lit("why"), F.expr("array(named_struct('start_time', 0D, 'end_time', 61D, 'text', 'Hi.'))"), F.expr("array(named_struct('start_time', 0D, 'end_time', 61D, 'segment_id', 's1', 'text', '<b> & c'))")).alias("md"),
        L.language_decision(F.expr("cast(null as struct<declared_language:string,selected_language:string,language_decision_reason:string,selected_candidate_id:string>)"), F.lit("a" * 30), F.lit("x")).alias("auto"),
    ).first()
    assert one["langs"] == ["zh", "en"] and one["missing"] == ["采集状态"] and one["y"] == '"a\\"b"' and one["n"] == "3"
    assert "### 00:00:00–00:01:01\n\nHi.\n" in one["md"] and "- `00:00:00–00:01:01` `s1` &lt;b&gt; &amp; c\n" in one["md"] and one["md"].endswith("</details>\n")
    assert one["auto"]["output_language"] == "en" and one["auto"]["language_decision_reason"].startswith("single x transcript")
    entries = spark.createDataFrame([("raw",), ("old",), (None,)], "role string")
    assert [r["role"] for r in L.without_roles(entries, ("old",), {"raw": "raw_history"}).collect()] == ["raw_history", None]


def test_collections(spark, tmp_path):
    path = str(tmp_path / "pool.json")
    schema = "candidate_id string, times_detected long"
    assert vault.load_collection(spark, path, "pool-v1", "items", schema).count() == 0
    vault.atomic_json(path, {"protocol": "pool-v1", "items": [{"candidate_id": "a", "times_detected": 2}]})
    assert [tuple(r) for r in vault.load_collection(spark, path, "pool-v1", "items", schema).collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="other-v1 is required"):
        vault.load_collection(spark, path, "other-v1", "items", schema)
    assert vault.load_json(path)["protocol"] == "pool-v1"
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError, match="JSON object required"):
        vault.load_json(str(tmp_path / "list.json"))


class Crash(Exception):
    pass


def crash_at(step):
    def at(now):
        if now == step:
            raise Crash(step)

    return at


@pytest.mark.parametrize(("step", "outcome"), [("intent", "discarded"), ("asset", "committed"), ("receipt", "committed"), ("index", "committed")])
def test_recovery(tmp_path, step, outcome):
    root, target = str(tmp_path / "gov"), tmp_path / "vault" / "a.md"
    target.parent.mkdir()
    args = (root, str(tmp_path / "vault"), str(target), b"body", {"transaction_id": "t1"}, {"asset_id": "a"}, f"{root}/index.json")
    with P.exclusive(root), pytest.raises(Crash):
        P.publish(*args, at=crash_at(step))
    assert P.recover(root) == {"t1": outcome} and P.recover(root) == {}
    assert target.exists() == (outcome == "committed")
    if outcome == "discarded":
        assert P.publish(*args) == "committed"
    assert [p["asset_id"] for p in vault.load_json(f"{root}/index.json")["publications"]] == ["a"]
    assert vault.load_json(f"{root}/receipts/t1.json")["validation_result"] == "committed" and target.read_bytes() == b"body"
    with pytest.raises(P.Conflict):
        P.publish(*args)


def test_recovery_conflicts(tmp_path):
    root, target = str(tmp_path / "gov"), tmp_path / "vault" / "a.md"
    target.parent.mkdir()
    args = (root, str(tmp_path / "vault"), str(target), b"body", {"transaction_id": "t1"}, {"asset_id": "a"}, f"{root}/index.json")
    with pytest.raises(Crash):
        P.publish(*args, at=crash_at("asset"))
    target.unlink()
    target.write_bytes(b"edited")
    assert P.recover(root) == {"t1": "conflict: target_modified"} and P.recover(root) == {"t1": "conflict: needs_reconciliation"}
    assert target.read_bytes() == b"edited"
    with pytest.raises(ValueError, match="target_outside_vault"):
        P.publish(root, str(tmp_path / "vault"), str(tmp_path / "b.md"), b"x", {"transaction_id": "t2"}, {}, f"{root}/index.json")
    with P.exclusive(root), pytest.raises(ValueError, match="busy"), P.exclusive(root, wait=0.2):
        pass
