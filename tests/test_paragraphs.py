import random

from pyspark.sql import functions as F

from attestra.operators import sequence as S

SEGMENTS = "k string, pos int, segment_id string, start_time double, end_time double, text string"


def _one_by_one(rows, target, most, seconds):
    out, text, ids, start, end = [], "", [], 0.0, 0.0

    def flush():
        nonlocal text, ids, start, end
        if text:
            out.append((start, end, text.strip(), ids))
            text, ids, start, end = "", [], 0.0, 0.0

    for _, _, name, begin, until, said in sorted(rows, key=lambda r: (r[3], r[4], r[1])):
        if len(said) > most:
            flush()
            out.extend((begin, until, p, [name]) for p in S.split_oversized(said, target, most))
            continue
        if not text:
            start = begin
        both = S._joined(text, said)
        lasts = max(until, end) - start
        if text and len(both) > most:
            flush()
            start, both = begin, said
        text, ids, end = both, [*ids, name], max(end, until)
        if (len(both) >= target and both[-1] in ".。") or lasts >= seconds:
            flush()
    flush()
    return [(f"paragraph-{i:04d}", *p) for i, p in enumerate(out, 1)]


def test_paragraphs_of_many_keys_in_small_batches(spark):
    rng, by = random.Random(8), {}
    for k in [*(f"k{i}" for i in range(25)), None]:
        said = lambda: "".join(rng.choice("ab 中") for _ in range(rng.choice((0, 5, 30, 45, 150)))) + rng.choice(("", "."))
        by[k] = [(k, i, f"s{i}", rng.randint(0, 40) * 5.0, rng.randint(0, 40) * 5.0 + 10, said()) for i in range(rng.randint(1, 14))]
    rows = [r for v in by.values() for r in v]
    rng.shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        p = S.paragraphs(spark.createDataFrame(rows, SEGMENTS), "k", 60, 100, 90.0)
        assert "FlatMapGroups" not in p._jdf.queryExecution().toString()  # no call, and no pandas frame, a conversation
        got = sorted(map(tuple, p.collect()), key=str)
    finally:
        spark.conf.set(name, old)
    assert got == sorted(((k, *p) for k, v in by.items() for p in _one_by_one(v, 60, 100, 90.0)), key=str)


def test_a_text_is_cleaned_once(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(["好好好好好好 text", "  ", None, "a a", "a  a", "中文 所以 然后"])], "k string, pos int, text string")
    kept = S.drop_repeats(rows, "k", ["pos"])
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("{2,16}") == 1
    assert kept.columns == ["k", "pos", "text"] and [r["pos"] for r in kept.orderBy("pos").collect()] == [0, 3, 5]
    assert S.drop_repeats(rows.select("text", "pos", "k"), "k", ["pos"]).select(F.count("*")).first()[0] == 3
