"""Revisions with injected failures, and the hook after publishing with replays."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from attestra.sources import revisions as V
from attestra.streaming import hook

ROW = "material_id string, revision_id string, name string, payload binary"


def rows_of(spark, revisions):
    return spark.createDataFrame([(m, r, n, p) for (m, r), files in revisions.items() for n, p in files.items()], ROW)


def test_revisions_are_put_in_place_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "r")
    os.makedirs(root)
    good = {(f"m{i % 5}", f"r{i}"): {"source.json": f"s{i}".encode(), "manifest.json": f"m{i}".encode()} for i in range(30)}
    need = ("source.json", "manifest.json")
    V.append_revisions(rows_of(spark, good), root, need)
    stored = {(m, r): V.digests(f"{root}/{m}/{r}") for m in os.listdir(root) for r in os.listdir(f"{root}/{m}")}
    assert stored == {k: {n: hashlib.sha256(p).hexdigest() for n, p in sorted(v.items())} for k, v in good.items()}
    V.append_revisions(rows_of(spark, good), root, need)  # the same again changes nothing
    new = {("m9", f"n{i}"): {"source.json": b"x", "manifest.json": b"y"} for i in range(8)}
    broken = {
        "lacks": new | {("m9", "half"): {"source.json": b"x"}},
        "unsafe": new | {("m9", "../up"): {"source.json": b"x", "manifest.json": b"y"}},
        "identity_conflict": new | {("m0", "r0"): {"source.json": b"other", "manifest.json": b"m0"}},
    }
    for why, revisions in broken.items():
        with pytest.raises(Exception, match=why):
            V.append_revisions(rows_of(spark, revisions), root, need)
        assert sorted(os.listdir(root)) == [f"m{i}" for i in range(5)]  # no revision, no staging folder
    with pytest.raises(Exception, match="boom"):
        bad = rows_of(spark, new).withColumn("payload", F.when(F.col("revision_id") == "n5", F.raise_error("boom")).otherwise(F.col("payload")))
        V.append_revisions(bad, root, need)
    assert sorted(os.listdir(root)) == [f"m{i}" for i in range(5)]
    with pytest.raises(Exception, match="never overwritten"):
        rows_of(spark, new).write.format(V.FORMAT).mode("overwrite").save(root)


def test_revisions_are_classified(spark, tmp_path):
    root = str(tmp_path)
    sets = {("m", "ok"): {"a": b"1", "b": b"2"}, ("m", "half"): {"a": b"1"}, ("m", "other"): {"a": b"9", "b": b"2"}, ("m", "more"): {"a": b"1", "b": b"2", "c": b"3"}, ("m", "unasked"): {"a": b"1"}}
    V.append_revisions(rows_of(spark, sets), root)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [("m", r, n, sha(p)) for r in ("ok", "half", "other", "more", "gone") for n, p in (("a", b"1"), ("b", b"2"))]
    expected = spark.createDataFrame(want, "material_id string, revision_id string, name string, sha256 string")
    got = {r["revision_id"]: r["status"] for r in V.classify(spark, root, expected).collect()}
    assert got == {"ok": "valid", "half": "partial", "other": "conflict", "more": "conflict", "gone": "missing"}


def test_the_hook_scans_once_and_failures_are_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def land(n, ids):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"asset_id": i}) for i in ids))

    def scan(batch):
        if batch.where("asset_id = 'late'").head(1):
            return batch.select("asset_id", F.raise_error("scan failed").alias("with"))
        return batch.where("asset_id <> 'lonely'").select("asset_id", F.lit("other").alias("with"))

    def run(checkpoint):
        stream = spark.readStream.schema("asset_id string").option("maxFilesPerTrigger", 1).json(str(source))
        q = hook.after_publish(stream, scan, out, str(tmp_path / checkpoint))
        q.awaitTermination(120)
        assert q.exception() is None
        status = spark.read.parquet(f"{out}/status")
        return sorted((r["batch"], r["asset_id"], r["status"]) for r in status.collect()), spark.read.option("mergeSchema", "true").parquet(f"{out}/candidates").count(), status

    land(0, ["a", "a", "lonely"])
    first, n, _ = run("c")
    assert first == [(0, "a", "completed"), (0, "lonely", "completed_no_relation")] and n == 2
    assert run("again")[:2] == (first, n)  # all batches replayed from nothing: nothing is added
    land(1, ["late", "b"])
    second, n, status = run("c")
    assert second == [*first, (1, "b", "failed_retryable"), (1, "late", "failed_retryable")] and n == 2
    assert {r["asset_id"] for r in hook.retryable(status).collect()} == {"b", "late"}
    assert all("scan failed" in r["error"] for r in hook.retryable(status).collect())
