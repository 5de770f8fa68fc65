"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

A source's documents, in the order of a hash, make a stream of words that is cut into blocks of equal length and may be
read up to three times. Slot k of the schedule has the point frac((k + 1/2) / phi) of the golden ratio; its place
among the cumulative targets names the source, and the slot's rank within its source names the block. Ranks and
offsets are two-level prefix sums over chunks, so a source with most of the rows is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.runtime import discard, materialise

WORD = "[^\\x20\\x09-\\x0D]+"
GOLDEN = 0.6180339887498949
#: The hash prefix that splits a source's documents (4096 parts) and the slots a part of the schedule holds.
PARTS_HEX = 3
CHUNK = 1 << 14
#: Sources whose cuts may be broadcast (below 8 MB but for very long names); beyond it Spark picks the join.
BROADCAST_SOURCES = 20_000
#: Buckets of the unit interval in which slots meet the sources' intervals.
GRID = 256


def words(text: Column) -> Column:
    """Number of words of a whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """(source, source_size) -> sid, source, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn. They share the sum of all sizes by weight; a target stops
    at ``repeats`` times its source's size and the rest is shared again. That is one water level: with the sources in
    the order of the level at which they stop, the level after k stops is (sum - stopped) / (weight that is left).
    One row a source passes through the window, never rows of documents.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = ranked.withColumn("weight", pick).withColumn("most", F.lit(repeats) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns(
        {
            "stopped": F.coalesce(F.sum("most").over(order), F.lit(0)),
            "used": F.coalesce(F.sum("weight").over(order), F.lit(0.0)),
            "total": F.sum("source_size").over(every),
            "heavy": F.sum("weight").over(every),
        }
    )
    w = w.withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / (F.col("heavy") - F.col("used")))
    stays = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("stopped"), "level"))).over(every)
    w = w.withColumn("final", stays["level"])
    return w.select("sid", "source", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("final") * F.col("weight")).alias("target"))


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix: ``slot``, ``sid``, ``rank``, ``epoch``, ``block``, ``words``.

    ``plan`` has sid, source_size and target. Slots beyond a source's target are void; the few that the points leave a
    source short of stand at the end. A slot's block is its rank modulo the source's blocks; ``words`` is what the mix
    takes of it, short only where the target ends.
    """
    spark = plan.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    goal = F.least(F.round("target").cast("long"), 3 * F.col("source_size"))
    p = plan.where("source_size > 0").select("sid", "source_size", goal.alias("goal"), blocks.alias("blocks"))
    p = p.withColumn("need", F.floor(F.col("goal") / F.col("source_size")) * F.col("blocks") + F.ceil(F.pmod("goal", "source_size") / block_words))
    upto = F.sum("goal").over(Window.orderBy("sid"))
    p = p.withColumns({"hi": upto / F.greatest(F.lit(1), F.sum("goal").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})
    p = p.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    p, _ = materialise(p, "plan")
    slots = int(p.agg(F.sum("need")).first()[0] or 0)
    k = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    point = (F.col("slot") + 0.5) * GOLDEN
    k = k.withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * GRID))
    cells = p.where("goal > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.lit(GRID - 1).cast("long"), F.floor(F.col("hi") * GRID)))))
    drawn = k.join(cells, "cell").where("u >= lo and u < hi")
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    drawn, _ = materialise(drawn.select("slot", "sid", "chunk", local.alias("local")), "slots")
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.join(counts.select("sid", "chunk", ahead.alias("ahead")), ["sid", "chunk"])
    ranked = ranked.select("sid", "slot", (F.col("ahead") + F.col("local")).alias("rank"))
    had = counts.groupBy("sid").agg(F.sum("n").alias("had"))
    short = p.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    short = short.select("sid", F.lit(slots).cast("long").alias("slot"), F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    s = ranked.unionByName(short).join(p.drop("lo", "hi"), "sid").where("rank < need")
    s = s.withColumns({"epoch": F.floor(F.col("rank") / F.col("blocks")), "block": F.pmod("rank", "blocks")})
    begin = F.col("epoch") * F.col("source_size") + F.col("block") * block_words
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    s = s.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least(length, F.col("goal") - begin)))
    return s.where("words > 0").select("slot", "sid", "rank", "epoch", "block", "words")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    block_words: int = 512,
) -> DataFrame:
    """One row a document: id, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words the mix takes).

    Taken words count repeats; a source's sum to its target rounded, and no document is taken more than three times.
    Null and wordless texts have size 0 and nothing taken; a null source is a source, the last. Rows that repeat are
    documents of their own. An empty table gives no rows. The order within a source is that of md5 of the id, then id
    and size, so reruns agree. Other columns are not read.
    """
    out, _ = _taken(docs, id_col, text_col, source_col, weights, block_words)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def draw(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    block_words: int = 512,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole number; all their columns.

    A mix takes the first words of a source's stream once more than the rest, so all that a source's documents need is
    the last hash of those taken more often and both numbers: rows meet one row a source and texts are not shuffled.
    Documents with the same id are taken alike. Null and wordless texts are never taken. No rows give no rows.
    """
    spark = docs.sparkSession
    out, paths = _taken(docs, id_col, text_col, source_col, weights, block_words)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    cuts = out.where("size > 0").groupBy("source").agg(F.max(F.struct(times.alias("n"), "h")).alias("most"), F.min(times).alias("least"))
    cuts, _ = materialise(cuts.select(*[F.col(c).alias(f"mixed_{c}") for c in ("source", "most", "least")]), "cuts")
    for path in paths:
        discard(spark, path)
    held = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    # the row travels as one column, so no name of its columns can clash with those of the mix
    rows = docs.where(F.col(text_col).rlike(WORD)).select(F.struct("*").alias("row"), F.col(source_col).alias("source"), _order(F.col(id_col)).alias("h"))
    rows = rows.join(held, rows["source"].eqNullSafe(held["mixed_source"]))
    n = F.when(F.col("h") <= F.col("mixed_most")["h"], F.col("mixed_most")["n"]).otherwise(F.col("mixed_least"))
    rows = rows.select("row", n.alias("n")).where("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def _order(id_: Column) -> Column:
    return F.md5(F.coalesce(id_.cast("string"), F.lit("")))


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], block_words: int) -> tuple[DataFrame, list[str]]:
    """id, h, source, size, source_size, target and taken of every document, and the written tables that they need."""
    key = _order(F.col(id_col))
    light, light_path = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("h")), "sizes", "zstd")
    plan, plan_path = materialise(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    slots = schedule(plan, block_words)
    reads, reads_path = materialise(slots.groupBy("sid", "block").agg(F.collect_list("words").alias("reads")), "reads")
    named = light.join(plan.select("sid", F.col("source").alias("src"), "source_size", "target"), F.col("source").eqNullSafe(F.col("src")))
    named = named.withColumn("part", F.substring("h", 1, PARTS_HEX)).drop("src")
    sums = named.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("sid", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("upto", F.sum("size").over(inside)).join(sums.select("sid", "part", ahead.alias("ahead")), ["sid", "part"])
    placed = placed.withColumn("at", F.col("ahead") + F.col("upto") - F.col("size"))
    # a piece is what a document has in one block; its row is numbered so that a document's pieces meet again
    placed, placed_path = materialise(placed.select("id", "h", "source", "size", "source_size", "target", "sid", "at", F.monotonically_increasing_id().alias("row")), "placed", "zstd")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
    a = F.greatest(F.col("at") - F.col("block") * block_words, F.lit(0).cast("long"))
    b = F.least(F.col("at") + F.col("size") - F.col("block") * block_words, F.lit(block_words).cast("long"))
    got = F.aggregate("reads", F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(F.lit(0).cast("long"), F.least(x, b) - a))
    taken = cut.join(reads, ["sid", "block"]).groupBy("row").agg(F.sum(got).alias("taken"))
    out = placed.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("id", "h", "source", "size", "source_size", "target", "taken"), [light_path, plan_path, reads_path, placed_path]
