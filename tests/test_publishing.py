"""Bundles, chunked recordings, migrations and the SQL surface against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import bundles as B
from attestra.operators import chunks as C
from attestra.operators import migration as G
from attestra.sources import surface

CANDIDATE = "bundle_id long, candidate_id string, asset_type string, status string, material_id string, revision_id string, title string, markdown string, readable_reference string, content_hash string, stable_references array<string>, admission string"
COMPONENT = "bundle_id long, candidate_id string, component_type string, target_folder string, filename string, source_material_id string, source_revision_id string, published_title string, published_body string, projection_hash string, quality string, inputs array<string>"


def candidate(b, i, kind, **over):
    row = dict(bundle_id=b, candidate_id=f"{b}-{i}", asset_type=kind, status="publishable", material_id="m", revision_id="r", title="T", markdown="---\na: b\n---\n\nBody\n", readable_reference="x", content_hash="h", stable_references=["b", "a"], admission="{}")
    return tuple((row | over).values())


def component(b, i, kind, **over):
    row = dict(bundle_id=b, candidate_id=f"{b}-{i}", component_type=kind, target_folder=B.FOLDERS[kind], filename="n.md", source_material_id="m", source_revision_id="r", published_title="T", published_body="Body", projection_hash="p", quality="{}", inputs=["a", None])
    return tuple((row | over).values())


def bundle_tables(spark, changed=()):
    kinds = ["learning_note", "source_asset", "method_asset"]
    rows = [candidate(b, i, k, **({"title": "New", "stable_references": None} if (b, i) in changed else {})) for b in range(5) for i, k in enumerate(kinds)]
    c = spark.createDataFrame(rows + [candidate(9, 0, "source_asset"), candidate(9, 1, "source_asset")], CANDIDATE)
    parts = [component(b, i, k) for b in range(5) for i, k in enumerate(kinds)] + [component(9, 0, "source_asset"), component(9, 1, "source_asset")]
    return c, spark.createDataFrame(parts, COMPONENT)


def approve(c, parts):
    now = B.bindings(c, parts).select("bundle_id", "candidate_id", F.col("binding").alias("approved"), F.col("own_binding").alias("confirmed_binding"))
    views = c.withColumn("snapshot", B.candidate_view(c)).select("bundle_id", "candidate_id", "snapshot")
    return parts.join(views, ["bundle_id", "candidate_id"]).join(now, ["bundle_id", "candidate_id"])


def heads(spark, ids):
    rows = [(b, B.BUNDLE, B.AWAITING, B.PLAN, b, True, "user") for b in ids]
    return spark.createDataFrame(rows, "bundle_id long, protocol string, workflow_state string, plan_protocol string, plan_bundle_id long, confirmed boolean, reviewer string")


def test_an_approval_binds_the_whole_bundle(spark):
    c, parts = bundle_tables(spark)
    approved = approve(c, parts)
    none = spark.createDataFrame([], "bundle_id long, candidate_id string, position long")
    ok = B.preflight(heads(spark, range(5)), c, approved, none).collect()
    assert len(ok) == 15 and all(r["problem"] is None and r["blocked"] is None for r in ok)
    assert [r["asset_type"] for r in sorted((r for r in ok if r["bundle_id"] == 0), key=lambda r: r["place"])] == list(B.ORDER[:2]) + ["method_asset"]
    moved, _ = bundle_tables(spark, {(2, 2)})  # one candidate changed: its own snapshot differs, the others' bindings too
    got = {r["candidate_id"]: r["problem"] for r in B.preflight(heads(spark, [2, 3]), moved, approved, none).collect()}
    assert got == {"2-0": "approval_mismatch", "2-1": "approval_mismatch", "2-2": "candidate_changed", "3-0": None, "3-1": None, "3-2": None}
    twice = {r["candidate_id"]: (r["problem"], r["blocked"]) for r in B.preflight(heads(spark, [9]), c, approved, none).collect()}
    assert twice == {"9-0": (None, "source_repeated"), "9-1": ("source_repeated", "source_repeated")}
    assert B.preflight(heads(spark, [0]).limit(0), c, approved, none).count() == 0
    absent = spark.createDataFrame([(1, "1-1", 2), (1, "nowhere", 5), (1, None, 6)], none.schema)
    got = [(r["candidate_id"], r["problem"], r["blocked"]) for r in B.preflight(heads(spark, [1]), c, approved, absent).collect()]
    assert sorted(got, key=str) == sorted([("1-1", None, "candidate_absent"), ("nowhere", "candidate_absent", "candidate_absent"), (None, "candidate_absent", "candidate_absent")], key=str)


def test_bundle_digests_ignore_order_and_count_copies(spark):
    rows = [candidate(b, i, "method_asset", bundle_id=b, candidate_id=str(i), title=str(i % 3)) for b in (1, 2) for i in range(20)]
    digests = lambda rows: {r["bundle_id"]: r["bundle_digest"] for r in B.bundle_digests(spark.createDataFrame(rows, CANDIDATE).repartition(3)).collect()}
    one = digests(rows)
    random.Random(1).shuffle(rows)
    assert digests(rows) == one and one[1] == one[2]
    assert digests(rows + [rows[0]])[rows[0][0]] != one[1] and digests(rows[1:])[rows[0][0]] != one[1]


@pytest.mark.parametrize("text", ["", "Body", "---\na: b\n---\nBody\n\n", "---\n---\nBody", "---\n\n---\n Body　", "--- \nBody", "---\na\n---\n---\nb\n---\nc"])
def test_body_hash(spark, text):
    end = text.find("\n---\n", 4) if text.startswith("---\n") else -1
    want = "sha256:" + hashlib.sha256(((text[end + 5 :] if end >= 0 else text).strip() + "\n").encode()).hexdigest()
    assert spark.range(1).select(B.body_hash(F.lit(text)).alias("h")).first()["h"] == want


def test_derivatives_wait_for_their_source(spark):
    c, parts = bundle_tables(spark)
    none = spark.createDataFrame([], "bundle_id long, candidate_id string, position long")
    sent = []

    def publish(df):
        sent.extend(r["candidate_id"] for r in df.collect())
        return df.where("bundle_id <> 3").select("bundle_id", "candidate_id", (~F.col("candidate_id").isin("1-1", "2-0")).alias("committed"))  # bundle 3 says nothing

    rows, whole = B.dispatch(B.preflight(heads(spark, range(5)), c, approve(c, parts).withColumn("approved", F.when(F.col("bundle_id") == 4, "old").otherwise(F.col("approved"))), none), publish)
    got = {r["candidate_id"]: (r["status"], r["reason"]) for r in rows.collect()}
    done, wait, late = ("published_or_already_published", None), ("pending_retry", None), ("pending_retry", "source_not_committed")
    assert got == {"0-0": done, "0-1": done, "0-2": done, "1-0": late, "1-1": wait, "1-2": late, "2-0": wait, "2-1": done, "2-2": done, "3-0": late, "3-1": wait, "3-2": late} | {f"4-{i}": ("blocked", "approval_mismatch") for i in range(3)}
    assert {r["bundle_id"]: r["status"] for r in whole.collect()} == {0: "published", 1: "publish_partial", 2: "publish_partial", 3: "publish_partial", 4: "blocked"}
    assert sorted(sent) == ["0-0", "0-1", "0-2", "1-1", "2-0", "2-1", "2-2", "3-1"]


CACHE = f"chunk_hash string, provider_identity string, protocol string, status string, text string, segments {C.SEGMENTS}"


def test_chunks_are_retried_alone(spark):
    chunks = [("a", 0, 10.0, "h0", "w0"), ("a", 1, 5.0, "h1", "w1"), ("a", 2, 2.5, "h2", "w2"), ("b", 0, 1.0, "h3", "w3"), ("b", 1, 1.0, "h0", "w0"), ("b", 2, 1.0, None, None), ("c", 0, 3.0, "h4", "w4")]
    df = spark.createDataFrame(chunks, "owner string, chunk long, duration double, chunk_hash string, payload string")
    seg = [(0.0, 1.0, " x "), (1.0, 2.0, " \t"), (2.0, 3.0, "y")]
    whole = lambda h, ident="p", status="completed", text="t", segs=seg: (h, ident, C.PROTOCOL, status, text, segs)
    cache = spark.createDataFrame([whole("h1"), whole("h2", ident="old"), whole("h3", status="failed"), whole("h4", text=" \n"), whole("h4", segs=[]), whole("unused")], CACHE)
    plan = {"h0": [("crash", 1), (None, 1)], "h2": [("segment_timeout", 1)] * 9, "h3": [(None, 0), None, (None, 1)], "h4": [None, None, None]}
    sent = []

    def provider(open_, attempt):
        rows = []
        for r in open_.collect():
            sent.append((attempt, r["chunk_hash"]))
            what = plan[r["chunk_hash"]][attempt]
            if what:
                rows.append((r["chunk_hash"], what[0], "completed", "t" if what[1] else "", [(0.0, 1.0, r["payload"])]))
        return spark.createDataFrame(rows, f"chunk_hash string, failure string, status string, text string, segments {C.SEGMENTS}")

    results, fresh = C.transcribe(df, cache, provider, "p", 2)
    got = {(r["owner"], r["chunk"]): (r["asr_status"], r["retry_count"], r["failure_reason"]) for r in results.collect()}
    retried = ("completed_after_retry", 1, "crash")
    assert got == {
        ("a", 0): retried, ("b", 1): retried, ("a", 1): ("completed_cached", 0, ""), ("a", 2): ("failed", 2, "segment_timeout"), ("b", 0): ("completed_after_retry", 2, "asr_process_failed"),
        ("b", 2): ("failed", 0, "chunk_unreadable"), ("c", 0): ("failed", 2, "asr_process_failed"),
    }
    assert sorted(sent) == sorted([(0, "h0"), (0, "h2"), (0, "h3"), (0, "h4"), (1, "h0"), (1, "h2"), (1, "h3"), (1, "h4"), (2, "h2"), (2, "h3"), (2, "h4")])
    assert sorted(r["chunk_hash"] for r in fresh.collect()) == ["h0", "h3"]
    clocked = C.clock(results)
    assert {(r["owner"], r["start_time"], r["end_time"], r["reason"]) for r in C.missing_ranges(clocked).collect()} == {("a", 15.0, 17.5, "segment_timeout"), ("b", 2.0, 3.0, "chunk_unreadable"), ("c", 0.0, 3.0, "asr_process_failed")}
    segments = sorted((r["owner"], r["segment_id"], r["start_time"], r["text"], r["end_timestamp"]) for r in C.segments_of(clocked).collect())
    assert segments == [("a", "transcript-0001", 0.0, "w0", "00:00:01.000"), ("a", "transcript-0002", 10.0, "x", "00:00:11.000"), ("a", "transcript-0004", 12.0, "y", "00:00:13.000"), ("b", "transcript-0001", 0.0, "w3", "00:00:01.000"), ("b", "transcript-0002", 1.0, "w0", "00:00:02.000")]
    assert {r["owner"]: (r["status"], r["failed"]) for r in C.recordings(results).collect()} == {"a": ("partial", 1), "b": ("partial", 1), "c": ("failed", 1)}
    again, more = C.transcribe(df.where("owner <> 'c' and chunk_hash <> 'h2'"), cache.unionByName(fresh), provider, "p", 0)
    assert {r["asr_status"] for r in again.collect()} == {"completed_cached"} and more.count() == 0 and len(sent) == 11
    assert C.transcribe(df.limit(0), cache.limit(0), provider, "p")[0].count() == 0
    with pytest.raises(ValueError):
        C.transcribe(df, cache, provider, "p", 4)


def test_sums_over_blocks_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(None if k == 3 else k, i, rng.randrange(9)) for k in range(4) for i in sorted(rng.sample(range(60), 35))]
    rng.shuffle(rows)
    got = C.sums_before(spark.createDataFrame(rows, "k int, i long, v long"), "k", "i", {"before": F.col("v")}, 8)
    assert {(r["k"], r["i"]): r["before"] for r in got.collect()} == {(k, i): sum(w for q, j, w in rows if q == k and j < i) for k, i, _ in rows}


def plain_change(text, folder):
    end = text.find("\n---\n", 4) if text.startswith("---\n") else -1
    if end < 0 or folder not in {*G.CLASSES, *G.REMOVED}:
        return text, ""
    want, lines, previous, found = G.CLASSES.get(folder), [], "", False
    for line in text[4:end].splitlines():
        if line.startswith("asset_class:"):
            found, previous = True, line.split(":", 1)[1].strip()
            lines += [f"asset_class: {want}"] if want else []
        else:
            lines.append(line)
    lines += [f"asset_class: {want}"] if want and not found else []
    return "---\n" + "\n".join(lines) + "\n---\n" + text[end + 5 :], previous


def test_change_sets_equal_a_plain_one(spark):
    rng = random.Random(8)
    pieces = ["---\n", "\n---\n", "asset_class: source\n", "asset_class: knowledge ", "asset_class:", "title: x", "\n", "\r\n", "body", " "]
    texts = ["", "---\n---\n", "---\n\n---\nx", "---\nasset_class: creation\n---\n"] + ["---\n" * (rng.random() < 0.8) + "".join(rng.choices(pieces, k=rng.randrange(9))) + "\n---\nend" * (rng.random() < 0.8) for _ in range(300)]
    notes = [(f"n{i}", rng.choice([*G.CLASSES, *G.REMOVED, "other"]), t) for i, t in enumerate(texts)] + [("null", "90 系统", None)]
    df = spark.createDataFrame(notes, "relative_path string, folder string, text string")
    got = {r["relative_path"]: (r["after_text"], r["previous_class"]) for r in G.change_set(df).collect()}
    assert got == {p: plain_change(t, f) for p, f, t in notes if t is not None and plain_change(t, f)[0] != t} and len(got) > 100
    once = G.migrated(df, G.change_set(df)).drop("state")
    held = [tuple(r) for r in once.select("relative_path", "folder", "text").collect()]
    second = {r["relative_path"]: r["after_text"] for r in G.change_set(once).collect()}
    assert len(held) == len(notes) and second == {p: plain_change(t, f)[0] for p, f, t in held if t is not None and plain_change(t, f)[0] != t}


def test_rebase_keeps_rows_and_refuses_other_identities(spark):
    registry = spark.createDataFrame(
        [("r1", "a", "b", "A", "B", "x"), ("r2", "b", "c", "B", "C", "x"), ("r3", "a", "c", "old", "C", "x"), ("r4", "a", "gone", "A", "G", "x"), ("r5", None, "a", None, "A", "x"), ("r6", "c", "c", "C", "C", "x")],
        "relation_id string, source_location string, target_location string, source_asset_id string, target_asset_id string, hit string",
    ).withColumns({"source_revision": F.lit("1"), "target_revision": F.lit("1")})
    assets = spark.createDataFrame([(p, p.upper(), f"{p}2", f"h{p}") for p in "abc"], "relative_path string, asset_id string, revision string, file_hash string")
    changes = spark.createDataFrame([("a",)], "relative_path string")
    got = {r["relation_id"]: (r["rebase_state"], r["source_revision"], r["target_snapshot"], r["hit"]) for r in G.rebase(registry, assets, changes).collect()}
    assert got == {"r1": ("rebased", "a2", "hb", "x"), "r2": ("untouched", "1", None, "x"), "r3": ("identity_changed", "1", None, "x"), "r4": ("asset_missing", "1", None, "x"), "r5": ("asset_missing", "1", None, "x"), "r6": ("untouched", "1", None, "x")}
    assert {r["rebase_state"] for r in G.rebase(registry, assets, changes.limit(0)).collect()} == {"untouched"}


def test_operations_as_sql_functions(spark):
    refs = "input_refs array<string>, output_refs array<string>, receipt_refs array<string>, stage_refs array<string>, change_refs array<string>"
    rows = [("o1", "publish", "1", None, "started", ["x", "y"], None, None, None, ["x"]), ("o1", "publish", "1", "2", "completed", ["x"], ["z"], None, None, None), ("o2", "capture", "3", None, "started", ["x"], None, None, None, None)]
    events = spark.createDataFrame(rows, f"operation_id string, operation_type string, started_at string, completed_at string, status string, {refs}")
    surface.register(events, spark.createDataFrame([("o2", "failed"), ("o3", "strange")], "operation_id string, canonical_status string"), "op_test")
    run = lambda sql: sorted(map(tuple, spark.sql(sql).collect()))
    assert run("select operation_id, status, completed_at from op_test_get('o1')") == [("o1", "completed", "2")] and run("select * from op_test_get('o9')") == []
    assert run("select operation_id from op_test_find('x', null)") == [("o1",), ("o2",)] and run("select operation_id from op_test_find('z', 'capture')") == []
    assert run("select * from op_test_reconcile('o2')") == [("o2", "failed", "failed")]
    assert run("select * from op_test_reconcile('o3')") == [("o3", "needs_reconciliation", "strange")]
    assert json.loads(spark.sql("select to_json(collect_list(g.status)) from values ('o1'), ('o2') t(id), lateral op_test_get(t.id) g").first()[0])


def test_preflight_shuffles_no_texts(spark):
    c, parts = bundle_tables(spark)
    none = spark.createDataFrame([], "bundle_id long, candidate_id string, position long")
    plan = B.preflight(heads(spark, range(5)), c, approve(c, parts), none)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("to_json" in line or "regexp_replace" in line for line in joins)
    null = spark.createDataFrame([tuple(None if k == 1 else v for k, v in enumerate(candidate(7, 0, "source_asset")))], CANDIDATE)
    got = B.preflight(heads(spark, [7]), null, approve(c, parts), none).collect()
    assert [(r["candidate_id"], r["asset_type"], r["problem"]) for r in got] == [(None, None, "candidate_absent")]
    forged = approve(c, parts).withColumn("approved", F.concat(F.substring("approved", 1, 60), F.lit("0" * 11)))  # alike at first only
    assert {r["problem"] for r in B.preflight(heads(spark, [0]), c, forged, none).collect()} == {"approval_mismatch"}
