import random

from attestra.operators import overlap


def _rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé中\U00020000 -") for _ in range(rng.randint(1, 9)))
    items = [" ".join(word() for _ in range(12)) for _ in range(30)] + ["", "--", "abc", "Ab-c", "abcde", None, "\U00020000\U00020001"]
    docs = []
    for k in range(120):
        text = " ".join(word() for _ in range(rng.choice((1, 4, 30))))
        docs.append(text + (rng.choice(items[:30])[: rng.choice((30, 60, 99))] if k % 3 else ""))
    docs += ["", None, "a.b.c", "abc", "ABCDE", "ab", "\U00020000 \U00020001", items[3] * 3, items[4].upper()]
    return spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")


def test_broadcast_shingles_equal_the_join_of_shingles(spark, monkeypatch):
    docs, items = _rows(spark)
    monkeypatch.setattr(overlap, "CHARS", 300)
    got = overlap.overlapping(docs, items, "doc_id", "item_id")
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # no shingle of a document is shuffled
    got = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(overlap, "BROADCAST_CHARS", 0)
    want = overlap.overlapping(docs, items, "doc_id", "item_id")
    assert want.dtypes == [("doc_id", "int"), ("item_id", "string"), ("shared", "bigint")]
    assert got == sorted(map(tuple, want.collect())) and len(got) > 40


def test_no_reference_text(spark):
    docs, items = _rows(spark)
    assert overlap.overlapping(docs, items.where("item_id = ''"), "doc_id", "item_id").collect() == []
