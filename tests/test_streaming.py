import json

from attestra.streaming import operations as O


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_operation_streams(spark, tmp_path):
    rows = [
        {"operation_id": "a", "operation_type": "x", "status": "started", "at": "2024-01-01T00:10:00"},
        {"operation_id": "a", "operation_type": "x", "status": "completed", "at": "2024-01-01T00:20:00"},
        {"operation_id": "a", "operation_type": "x", "status": "completed", "at": "2024-01-01T00:20:00"},
        {"operation_id": "b", "operation_type": "x", "status": "started", "at": "2024-01-01T09:00:00"},
        {"operation_id": None, "status": "started", "at": "2024-01-01T09:00:00"},
    ]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, rows)))
    log = O.read_log(spark, str(tmp_path))
    assert {(r["operation_id"], r["status"]) for r in run(O.latest_states(log), "states", "complete")} == {("a", "completed"), ("b", "started")}
    got = {(r["hour"].hour, r["status"], r["n"]) for r in run(O.hourly_counts(log), "hours", "append")}
    assert got == {(0, "started", 1), (0, "completed", 1)}  # the last hour is still open
