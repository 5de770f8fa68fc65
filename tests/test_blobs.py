"""Paths against the standard library; stored objects read back."""

import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from attestra.functions import paths
from attestra.operators import blobs


def test_normal_paths_equal_the_standard_librarys(spark):
    rng = random.Random(3)
    parts = ["", ".", "..", "a", "b.c", "é漢", "...", " "]
    rows = [(rng.choice(["", "/", "//", "///"]) + "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 8))),) for _ in range(1500)] + [("",), ("..",), ("/..",), ("a/..",)]
    df = spark.createDataFrame(rows, "p string").withColumn("n", paths.normalise(F.col("p")))
    assert [(r["p"], r["n"]) for r in df.collect()] == [(p, os.path.normpath(p)) for (p,) in rows]
    assert spark.createDataFrame([(None,)], "p string").select(paths.normalise(F.col("p")).alias("n")).first()["n"] is None


def test_path_problems(spark):
    rows = [
        ("x/y.md", "/r", None), ("./x/../y", "/r", None), ("../r2/x", "/r", "escapes"), ("/r/x", "/r/", None), ("/rx", "/r", "escapes"), ("a/../../r/ok", "/r", None),
        (".", "/r", "escapes"), ("", "/r", "empty"), (None, "/r", "empty"), ("a\nb", "/r", "control"), ("x", "r", "relative_root"), ("secret/k", "/r", "forbidden"), ("a/../secret", "/r", "forbidden"), ("secrets", "/r", None),
    ]
    df = spark.createDataFrame(rows, "p string, root string, want string").withColumn("got", paths.problem(F.col("p"), F.col("root"), ("secret",)))
    assert [(r["p"], r["got"]) for r in df.collect()] == [(p, w) for p, _, w in rows]
    deep = spark.createDataFrame([("a/b", "/r"), ("a", "/r"), ("/x", "/")], "p string, root string").select(paths.problem(F.col("p"), F.col("root"), direct=True).alias("x"))
    assert [r["x"] for r in deep.collect()] == ["not_a_child", None, None]


def test_objects_come_back_with_their_hashes(spark, tmp_path, monkeypatch):
    stored = {
        "objects/aa/one": (b"  plain \xff text\n", "text/plain", None), "objects/aa/two": (json.dumps({"text": "", "readable_text": " inner "}).encode(), "application/JSON", None),
        "objects/bb/three": (json.dumps({"text": 5, "content": "no"}).encode(), "application/json", None), "objects/bb/list": (b"[1]", "application/json", None),
        "objects/cc/bad": (b"{not json", "application/json", None), "objects/cc/nul": (json.dumps({"text": None, "content": "c"}).encode(), "application/json", None),
    }
    for path, (data, *_) in stored.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path.parent / "outside").write_bytes(b"no")
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    entries = [("m", "r", p, p, sha(d), t) for p, (d, t, _) in stored.items()]
    entries += [("m", "r", "out", "../outside", sha(b"no"), "t"), ("m", "r", "gone", "objects/zz/gone", sha(b""), "t"), ("m", "r", "forged", "objects/aa/one", sha(b"x"), "t"), ("m", "r", "twice", "a", "b", "c"), ("m", "r", "twice", "a", "b", "c")]
    e = spark.createDataFrame(entries, "material_id string, revision_id string, reference string, storage_relative_path string, content_hash string, media_type string")
    wanted = spark.createDataFrame([("m", "r", x[2], i) for i, x in enumerate(entries[:-1])] + [("m", "r", "never", 99)], "material_id string, revision_id string, reference string, data_ int")
    for most in (1000, 1):
        monkeypatch.setattr(blobs, "MOST_FOLDERS", most)
        got = {r["reference"]: r for r in blobs.read_objects(spark, str(tmp_path), blobs.references(wanted, e)).withColumn("readable", blobs.readable_text(F.col("data"), F.col("entry.media_type"))).collect()}
        assert {k: r["problem"] for k, r in got.items() if r["problem"]} == {"out": "escapes_root", "gone": "object_missing", "forged": "hash_mismatch", "twice": "reference_repeated", "never": "reference_missing"}
        assert {k: bytes(got[k]["data"]) for k in stored} == {k: d for k, (d, *_) in stored.items()}
        text = {k: got[k]["readable"] for k in stored}
        assert text == {"objects/aa/one": "plain � text", "objects/aa/two": "inner", "objects/bb/three": '{"text": 5, "content": "no"}', "objects/bb/list": "[1]", "objects/cc/bad": "{not json", "objects/cc/nul": "c"}
    assert blobs.read_objects(spark, str(tmp_path / "none"), blobs.references(wanted, e)).where("data is not null").count() == 0


def test_time_index(spark):
    whole = {"segments": [{"text": " a \n b ", "start_timestamp": "00:01", "start_time": 1, "end_time": 2.5}, {"text": " "}, 7, {"no": 1}, {"text": "c"}]}
    rows = [("m", "r", json.dumps(whole).encode(), "application/json"), ("n", "r", b"[]", "application/json"), ("o", "r", b"{", "application/json"), ("p", "r", json.dumps(whole).encode(), "text/plain"), ("q", "r", None, "application/json")]
    df = spark.createDataFrame(rows, "material_id string, revision_id string, data binary, media_type string")
    got = [tuple(r) for r in blobs.time_index(df).orderBy("pos").collect()]
    assert got == [("m", "r", 0, "00:01", "2.5", "a b"), ("m", "r", 4, "", "", "c")]
