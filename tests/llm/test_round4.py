import random

from attestra.llm import ngram_jaccard


def test_rows_of_a_long_column_that_may_link_without_pairs(spark):
    rng = random.Random(5)
    rows = []
    for shingle, sizes, comps in ((1, (20, 24), 3), (2, (5, 400), 40), (3, (50, 50), 1), (4, (10, 12), 2)):
        for k in range(150):
            n = rng.randint(*sizes)
            rows.append((shingle, 1000 * shingle + k, n, rng.randrange(max(1, n // 3)), 1000 * shingle + rng.randrange(comps)))
    rows += [(5, 1, 10, 0, 1), (5, 2, 11, 0, 2), (5, 3, 100, 0, 3), (6, 1, 10, 0, 1), (6, 2, 10, 9, 2)]
    wide = spark.createDataFrame(rows, "shingle long, key long, n int, pos int, comp long")
    for percent in (60, 85):
        may = lambda a, b: ngram_jaccard.linked(min(a[2] - a[3], b[2] - b[3]), a[2], b[2], percent)  # noqa: B023, E731
        want = {(a[0], a[1]) for a in rows if any(a[0] == b[0] and a[4] != b[4] and may(a, b) for b in rows)}
        found = ngram_jaccard._may_link(wide, percent)
        assert {(r["shingle"], r["key"]) for r in found.collect()} == want and want
        assert "Generate" not in found._jdf.queryExecution().toString()  # rows of a column are not copied for each other
