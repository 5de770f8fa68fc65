import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.operators import manifests as M

S = "vault"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def good(spark):
    body = sha("raw")
    record = {
        "protocol": "source-material-v3", "schema_version": "3.0.0", "material_id": "", "revision_id": "",
        "source": {"platform": "web", "source_id": "x1", "source_url": "https://a.com/p", "title": "T", "author": "unknown", "captured_at": "2024"},
        "content": {
            "raw": {"storage": "reference", "content_hash": f"sha256:{body}", "media_type": "t", "reference": f"{S}://asset/asset_sha256_{body}"},
            "readable": {"storage": "inline", "content_hash": f"sha256:{sha('hi')}", "media_type": "t", "text": "hi", "operations": []},
        },
        "evidence": [{"evidence_id": "e", "kind": "source_media", "reference": f"{S}://asset/asset_sha256_{body}", "content_hash": f"sha256:{body}", "uncertainty": ""}],
        "quality": {"capture_status": "complete", "content_fidelity": "full", "transcript_quality": "readable", "review_required": True, "uncertainties": []},
        "lifecycle": {"status": "captured", "review_status": "pending", "created_at": "a", "updated_at": "b", "processing_history": [{"report_reference": f"{S}://report/asset_sha256_{sha('q')}"}]},
        "asset_manifest_reference": "", "understanding_sidecar_reference": "",
    }
    source = spark.createDataFrame([("web", "x1", "https://a.com/p")], "platform string, source_id string, url string")
    key = source.select(I.material_id(I.source_key(F.col("platform"), F.col("source_id"), F.col("url"))).alias("k")).first()[0]
    record["material_id"], record["asset_manifest_reference"] = key, f"{S}://manifest/{key}/revision_sha256_{'0' * 64}"
    rows = spark.createDataFrame([(json.dumps(record),)], "record string").select(F.from_json("record", M.MATERIAL_SCHEMA).alias("m"))
    record["revision_id"] = rows.select(I.revision_id(F.col("m")).alias("r")).first()[0]
    manifest = {
        "protocol": "reference-manifest-v1", "schema_version": "1.0.0", "material_id": key, "revision_id": record["revision_id"],
        "entries": [
            {"reference": f"{S}://asset/asset_sha256_{body}", "asset_id": f"asset_sha256_{body}", "role": "raw", "storage_relative_path": "a/b", "content_hash": f"sha256:{body}", "media_type": "t", "size_bytes": 3},
            {"reference": f"{S}://report/asset_sha256_{sha('q')}", "asset_id": f"asset_sha256_{sha('q')}", "role": "transcript_quality_report", "storage_relative_path": "a/q", "content_hash": f"sha256:{sha('q')}", "media_type": "t", "size_bytes": 1},
        ],
    }
    return record, manifest


def change(record, path, value):
    out = json.loads(json.dumps(record))
    at = out
    *way, last = path
    for p in way:
        at = at[p]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return out


def test_materials(spark, good):
    record, _ = good
    h = "sha256:" + "1" * 64
    cases = [
        (record, None), (change(record, ["evidence"], None), "keys"), (change(record, ["protocol"], "x"), "protocol"),
        (change(record, ["source", "summary"], "x"), "forbidden_field"), (change(record, ["source", "title"], 'a "summary": b'), "revision"),
        (change(record, ["source", "author"], None), "source_keys"), (change(record, ["source", "source_id"], "x2"), "identity"),
        (change(record, ["content", "readable", "content_hash"], h), "readable_hash_mismatch"), (change(record, ["content", "raw", "storage"], "z"), "raw_storage"),
        (change(record, ["content", "raw", "reference"], "/tmp/x"), "raw_reference"), (change(record, ["content", "readable", "operations"], None), "operations"),
        (change(record, ["evidence", 0, "uncertainty"], None), "evidence_keys"), (change(record, ["evidence"], record["evidence"] * 2), "evidence_repeated"),
        (change(change(record, ["evidence", 0, "start_time"], 5), ["evidence", 0, "end_time"], 4), "evidence_time"),
        (change(record, ["quality", "capture_status"], "x"), "quality_capture_status"), (change(record, ["quality", "review_required"], False), "review_required"),
        (change(record, ["lifecycle", "status"], "x"), "lifecycle_status"), (change(record, ["asset_manifest_reference"], f"{S}://manifest/a/b"), "manifest_reference"),
        (change(record, ["lifecycle", "created_at"], "/tmp/x"), "temporary"),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(90, None), (91, "[1]"), (92, "{")]
    got = {r["i"]: r["problem"] for r in M.check_materials(spark.createDataFrame(rows, "i int, record string"), S).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)} | {90: "json", 91: "json", 92: "json"}


def test_manifests_and_binding(spark, good):
    record, manifest = good
    e = ["entries", 0]
    cases = [
        (manifest, None), (change(manifest, [*e, "role"], None), "entry_keys"), (change(manifest, [*e, "reference"], "x"), "entry_reference"),
        (change(manifest, [*e, "asset_id"], "asset_sha256_" + "1" * 64), "entry_asset_id"), (change(manifest, ["entries"], manifest["entries"] * 2), "entry_repeated"),
        (change(manifest, [*e, "storage_relative_path"], "a/../b"), "unsafe_path"), (change(manifest, [*e, "storage_relative_path"], "/x"), "unsafe_path"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)], "i int, record string")
    assert {r["i"]: r["problem"] for r in M.check_manifests(rows, S).collect()} == {i: p for i, (_, p) in enumerate(cases)}
    one = lambda r: spark.createDataFrame([(json.dumps(r),)], "record string")
    short = change(manifest, ["entries"], manifest["entries"][1:])
    for m, want in ((manifest, None), (short, "reference_missing"), (change(manifest, ["revision_id"], "revision_sha256_" + "1" * 64), "manifest_missing")):
        assert [r["problem"] for r in M.publishable(one(record), one(m), S).collect()] == [want]
    entries = M.manifest_entries(M.check_manifests(one(manifest), S))
    files = spark.createDataFrame([("a/b", 4, manifest["entries"][0]["content_hash"])], "path string, size_bytes long, content_hash string")
    assert {r["storage_relative_path"]: r["problem"] for r in M.check_files(entries, files).collect()} == {"a/b": "size_mismatch", "a/q": "missing"}


def test_quality_and_readiness(spark, good):
    record, manifest = good
    one = lambda r: spark.createDataFrame([(json.dumps(r), "hi")], "record string, readable string")
    materials = M.check_materials(one(record), S)
    entries = M.manifest_entries(M.check_manifests(one(manifest), S))
    report = {
        "protocol": "media-transcript-quality-v1", "transcript_content_hash": record["content"]["raw"]["content_hash"], "readable_content_hash": record["content"]["readable"]["content_hash"],
        "ready_for_sorting": True, "quality_status": "ready_for_整理", "transcript_structural_qa": {"status": "pass", "warnings": ["w"]}, "transcript_content_quality": {"status": "usable"},
    }
    ref = manifest["entries"][1]["reference"]
    for r, want in ((report, (None, ["w", "metadata_incomplete:author"])), (report | {"ready_for_sorting": False}, ("not_ready", None)), (report | {"missing_ranges": ["x"]}, ("missing_ranges", None)), (None, ("report_missing", None))):
        reports = spark.createDataFrame([(ref, json.dumps(r))] if r else [], "reference string, record string")
        latest = M.latest_reports(materials, entries, reports)
        assert [(x["problem"], x["warnings"]) for x in M.quality_verdict(materials, latest).collect()] == [want]
        done = M.completion(materials, latest, ("youtube",), ("transcript",)).first()
        assert done["missing"] == ["author", "transcript"] and done["state"] == "capture_partial"
    ids = [(record["material_id"], record["revision_id"], s) for s in ("passed", "failed")]
    for row, n in ((ids[0], 1), (ids[1], 0)):
        assert M.ready_sources(materials, spark.createDataFrame([row], "material_id string, revision_id string, status string")).count() == n


def test_records_are_parsed_once_each_and_not_by_the_filter_on_problems(spark, good):
    from attestra.plans import ledger

    record, _ = good
    rows = spark.createDataFrame([(json.dumps(record),), (json.dumps(change(record, ["content", "raw"], None)),), (json.dumps(change(record, ["source"], "x")),)], "record string")
    checked = M.check_materials(rows, S)
    assert "_parts" not in checked.columns and "get_json_object" not in checked._jdf.queryExecution().toString()
    assert [r["problem"] for r in checked.collect()] == [None, "content_keys", "source_keys"]
    sound = ledger._sound(checked.select("material", "problem"))
    assert sound._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 0
    assert [r["material"]["revision_id"] for r in sound.collect()] == [record["revision_id"]]
