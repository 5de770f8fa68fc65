"""Receipts of managed edits: proofs that chains of them explain what is stored now, and undoing them in reverse order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.runtime import discard, materialise


def replay(receipts: DataFrame, assets: DataFrame) -> DataFrame:
    """Whether an asset's receipts lead from its known state to the current one.

    ``receipts``: asset_id, seq (numbers that grow with time, different within an asset), pre_hash, post_hash.
    ``assets``: asset_id, base_hash, current_hash, one row each. From the base, the next receipt is always the first
    later one that starts from the state reached. One row an asset: status, steps (receipts followed), reached_hash and
    broken_at (its first receipt that the chain leaves out, null if there is none).

    status: ``proven`` where the chain ends at the current hash, ``outdated`` where it passes it, ``broken`` otherwise.
    Receipts of unknown assets, and receipts without a hash or number, prove nothing; unknown hashes of an asset match
    nothing. Successors come from one window by (asset, hash), in which a state's receipts stand in time; chains are
    followed by pointer doubling, so rounds grow with the logarithm of the longest chain.
    """
    spark = receipts.sparkSession
    known = receipts.select("asset_id", F.col("seq").cast("long").alias("seq"), "pre_hash", "post_hash").join(assets.select("asset_id"), "asset_id", "left_semi")
    known = known.dropna()
    paths: list[str] = []

    def write(df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label)
        paths.append(path)
        return out

    begin = F.lit(-(2**63)).cast("long")  # stands for the base
    links = known.unionByName(assets.select("asset_id", begin.alias("seq"), F.lit(None).cast("string").alias("pre_hash"), F.col("base_hash").alias("post_hash")))
    links = write(links, "links")
    ends = links.select("asset_id", F.col("post_hash").alias("hash"), "seq", F.lit(None).cast("long").alias("starts"))
    starts = links.where("pre_hash is not null").select("asset_id", F.col("pre_hash").alias("hash"), "seq", F.col("seq").alias("starts"))
    later = Window.partitionBy("asset_id", "hash").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    both = ends.unionByName(starts).where("hash is not null").withColumn("next", F.min("starts").over(later))
    jump = write(both.where("starts is null and next is not null").select("asset_id", "seq", "next"), "jump")
    reached = write(assets.select("asset_id", begin.alias("seq")), "reached")
    while jump.head(1):
        more = reached.join(jump, ["asset_id", "seq"]).select("asset_id", F.col("next").alias("seq"))
        reached = write(reached.unionByName(more), "reached")
        far = jump.select("asset_id", F.col("seq").alias("next"), F.col("next").alias("beyond"))
        jump = write(jump.join(far, ["asset_id", "next"]).select("asset_id", "seq", F.col("beyond").alias("next")), "jump")
    chain = links.join(reached.withColumn("on", F.lit(True)), ["asset_id", "seq"], "left").join(assets.select("asset_id", "current_hash"), "asset_id")
    on = F.col("on").isNotNull()
    told = chain.groupBy("asset_id").agg(
        (F.count_if(on) - 1).alias("steps"),
        F.max_by(F.struct("post_hash"), F.when(on, F.col("seq"))).alias("end"),
        F.min(F.when(~on, F.col("seq"))).alias("broken_at"),
        F.max(F.when(on & (F.col("post_hash") == F.col("current_hash")), F.col("seq"))).alias("at"),
        F.max(F.when(on, F.col("seq"))).alias("last"),
    )
    status = F.when(F.col("at") == F.col("last"), "proven").when(F.col("at").isNotNull(), "outdated").otherwise("broken")
    out, _ = materialise(told.select("asset_id", status.alias("status"), "steps", F.col("end.post_hash").alias("reached_hash"), "broken_at"), "replayed")
    for path in paths:
        discard(spark, path)
    return out


def undo_log(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The before-image of every change: unit, seq, key, before, after.

    ``registry``: key, value. ``changes``: unit (rows that are done and undone together), seq (grows with time, different
    for a key), key, value (null removes the row). The image before is what the change before left, or the registry's row.
    """
    row = changes.select("unit", "seq", "key", F.col("value").alias("after"))
    old = F.lag(F.struct("after")).over(Window.partitionBy("key").orderBy("seq"))
    row = row.withColumn("old", old).join(registry.select("key", "value"), "key", "left")
    return row.select("unit", "seq", "key", F.when(F.col("old").isNull(), F.col("value")).otherwise(F.col("old.after")).alias("before"), "after")


def apply_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The registry after the last change of each key; a null value removes the row."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("now"))
    out = registry.join(last, "key", "full").select("key", F.when(F.col("now").isNull(), F.col("value")).otherwise(F.col("now.value")).alias("value"))
    return out.where("value is not null")


def rollback(registry: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo the units of an undo log in reverse order: the registry afterwards (key, value), and unit, refused, reason.

    A change may be undone if the row still is what it left: the last one of a key against the registry, an earlier one
    against the before-image of the next. A unit with a change that may not is refused as a whole (``row_changed``),
    and so is every unit with an earlier change of a row that a refused unit keeps (``later_unit_refused``). Rows
    are compared by sha256, a missing row as missing. Rounds follow refusals from unit to unit; each is two joins.
    """
    spark, paths = registry.sparkSession, []

    def write(df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label)
        paths.append(path)
        return out

    digest = lambda c: F.coalesce(F.sha2(F.col(c).cast("binary"), 256), F.lit(""))
    entries = log.join(registry.select("key", "value"), "key", "left")
    following = F.lead(digest("before")).over(Window.partitionBy("key").orderBy("seq"))
    entries = entries.withColumn("held", F.coalesce(following, digest("value")) == digest("after")).select("unit", "seq", "key", "before", "held")
    entries = write(entries, "entries")
    refused = write(entries.where("not held").select("unit").distinct().withColumn("reason", F.lit("row_changed")), "refused")
    new = refused
    while new.head(1):
        keeps = entries.join(new.select("unit"), "unit", "left_semi").groupBy("key").agg(F.max("seq").alias("kept"))
        hit = entries.join(keeps, "key").where("seq < kept").select("unit").distinct().join(refused, "unit", "left_anti")
        new = write(hit.withColumn("reason", F.lit("later_unit_refused")), "refused")
        refused = write(refused.unionByName(new), "refused")
    undone = entries.join(refused, "unit", "left_anti").groupBy("key").agg(F.min_by(F.struct("before"), "seq").alias("was"))
    after = registry.select("key", "value").join(undone, "key", "full").select("key", F.when(F.col("was").isNull(), F.col("value")).otherwise(F.col("was.before")).alias("value"))
    after, _ = materialise(after.where("value is not null"), "rolled-back")
    units = entries.select("unit").distinct().join(refused, "unit", "left").select("unit", F.col("reason").isNotNull().alias("refused"), "reason")
    units, _ = materialise(units, "units")
    for path in paths:
        discard(spark, path)
    return after, units
