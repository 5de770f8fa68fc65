"""Graph operators over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.runtime import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph: ``id``, ``component`` (the smallest id reachable) for every id on an edge.

    Alternating large-star and small-star steps; each round is aggregates and equi-joins, is written to the shared
    folder, and halves the depth of the trees, so the rounds grow with the logarithm of the longest path. The smallest
    neighbours are written before they are joined back, so that the join reads two plain shuffles and AQE can split a
    node that very many edges share. Nulls and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    lo, hi = F.least(src, dst), F.greatest(src, dst)
    kept = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e, path = materialise(kept.select(hi.alias("a"), lo.alias("b")).distinct(), "cc")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not now[0] or tuple(now) == mark:
            break
        mark, old = tuple(now), [path]

        def write(df: DataFrame, paths: list[str] = old) -> DataFrame:
            out, where = materialise(df, "cc")
            paths.append(where)
            return out

        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = write(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = write(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e, path = materialise(small, "cc")
        for used in old:
            discard(spark, used)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
