"""Provider results cut down to allowed fields, against a plain version on JSON."""

import json
import random

from pyspark.sql import functions as F

from attestra.operators import providers as P


def plain(text, reference):
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return "unreadable", 0, None
    get = lambda k, d="": v[k] if isinstance(v, dict) and v.get(k) is not None else d
    if get("protocol") != "transcript-provider-v1" or get("status") not in ("completed", "partial"):
        return "protocol_or_status", 0, None
    if not get("text").strip():
        return "text_blank", 0, None
    segments = []
    for n, s in enumerate(get("segments", []), 1):
        if not isinstance(s, dict):
            continue
        row = {"segment_id": s.get("segment_id") or f"transcript-{n:03d}", "start_time": float(s.get("start_time", 0)), "end_time": float(s.get("end_time", 0)), "start_timestamp": s.get("start_timestamp", ""), "end_timestamp": s.get("end_timestamp", ""), "text": " ".join((s.get("text") or "").split())}
        if "confidence" in s:
            row["confidence"] = s["confidence"]
        if row["text"] and row["end_time"] > row["start_time"]:
            segments.append(row)
    if not segments:
        return "no_segments", 0, None
    pick = lambda k, names: {n: get(k, {})[n] for n in names if n in get(k, {})}
    out = {"protocol": v["protocol"], "result_type": "TranscriptResult", "provider": get("provider", "unknown"), "model": get("model", "unknown"), "language": get("language", "unknown"), "status": v["status"], "source_reference": reference, "text": " ".join(v["text"].split()), "segments": segments, "timestamps": True, "provider_metadata": pick("provider_metadata", P.METADATA), "missing_ranges": get("missing_ranges", []), "chunking": pick("chunking", P.CHUNKING), "warnings": get("warnings", [])}
    if "timestamp" in v:
        out["timestamp"] = v["timestamp"]
    return None, len(segments), out


def test_sanitized_against_a_plain_version(spark):
    rng = random.Random(5)
    some = lambda **options: {k: rng.choice(v) for k, v in options.items() if rng.random() < 0.8}
    texts = ["a", " a  b\n", "", "  ", "中文 x"]
    rows = [None, "", "{", "[]", "3", "null"]
    for _ in range(400):
        v = some(protocol=["transcript-provider-v1"] * 6 + ["v0"], status=["completed", "partial", "partial", "failed"], text=texts[:2] * 3 + texts, provider=["p", "q"], model=["m"], language=["zh"], timestamp=[1, "t", {"at": 2}], warnings=[[], ["w"]], missing_ranges=[[], [{"start": 1.5}]], extra=["secret"])
        v |= {"protocol": "transcript-provider-v1"} if rng.random() < 0.7 else {}
        v["segments"] = [some(segment_id=["s1", "s2", ""], start_time=[0, 1, 2.5], end_time=[0, 2, 3.25], text=texts, start_timestamp=["00:00"], confidence=[0.5, None, "high"], path=["/x"]) for _ in range(rng.randrange(4))] + [7] * rng.randrange(2)
        v["provider_metadata"] = some(device=["cpu"], network_access=[False], python_executable=["/usr/bin/python"], model_path=["/m"])
        v["chunking"] = some(strategy=["fixed"], chunks=[[{"a": 1}], []], chunk_count=[2], folder=["/tmp"])
        rows.append(json.dumps(v))
    many = [{"text": "w", "end_time": 1 if n in (0, 999, 1199) else 0} for n in range(1200)]
    rows.append(json.dumps({"protocol": "transcript-provider-v1", "status": "partial", "text": "x", "segments": many}))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("t", P.sanitized(F.col("t"), F.lit("ref")).alias("s"))
    seen = set()
    for r in df.collect():
        problem, n, out = plain(r["t"], "ref")
        got = r["s"]
        assert (got["problem"], got["segments"]) == (problem, n), r["t"]
        assert (json.loads(got["result"]) if got["result"] else None) == out, r["t"]
        seen.add(problem)
    assert seen == {None, "unreadable", "protocol_or_status", "text_blank", "no_segments"}
