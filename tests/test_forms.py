"""A note's form works its text out once and trims every kind of blank at its ends."""

from pyspark.sql import functions as F

from attestra.operators import projection as J

BLANKS = "".join(c for c in map(chr, range(0x3100)) if c.isspace())


def test_a_text_is_worked_out_once_and_trimmed(spark):
    rows = [(f"{BLANKS}a{BLANKS}b{BLANKS}",), (BLANKS,), ("​a᠎",), ("",), (None,)]
    made = spark.createDataFrame(rows, "x string").select(F.concat(F.lit("once-only"), F.col("x")).alias("text"))
    out = made.select(J.nonsemantic(F.col("text"), F.lit("mark")).alias("form"))
    assert [r["form"] for r in out.collect()] == [None if x is None else f"once-only{x}".strip() for (x,) in rows]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("once-only") == 1
    bare = spark.createDataFrame(rows, "text string").select(J.nonsemantic(F.col("text"), F.lit("mark")).alias("form"))
    assert [r["form"] for r in bare.collect()] == [None if x is None else x.strip() for (x,) in rows]
