"""Preference formatting: pairs of conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def escape(value: Column) -> Column:
    """A value that can't hold a mark of the template: ``<|`` gets a backslash between, and one more where there are some."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "<(\\\\*)\\|", "<$1\\\\|")


def escape_role(role: Column) -> Column:
    """A role that can't end its mark either: ``|>`` gets a backslash between, too, one more where there are some."""
    return F.regexp_replace(escape(role), "\\|(\\\\*)>", "|\\\\$1>")


def render(role: Column, text: Column) -> Column:
    """One turn of the template; role and text are escaped, so that neither can forge a mark and different turns differ."""
    return F.concat(F.lit("<|"), escape_role(role), F.lit("|>\n"), escape(text), F.lit("<|end|>\n"))


def format_pairs(turns: DataFrame, pairs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a pair: ``pair_id``, ``chosen_id``, ``rejected_id``, ``prompt_turns``, ``prompt``, ``chosen``, ``rejected``
    and ``chosen_mask``, ``rejected_mask``: the spans ``start-end`` of the completion, in characters, that carry loss.

    ``turns`` has conv_id, turn, role, text; ``pairs`` has pair_id, chosen_id, rejected_id. The prompt is the longest
    common prefix of turns: same place, role and text, nulls equal. Turns are ordered by turn (null last), then role
    and text. A conversation without turns has an empty completion; equal conversations have two empty ones. Spans
    are the text and end mark of the turns of ``loss_role``, without the role line. Marks of the template inside a role
    or text are escaped. A pair is grouped by its own id, so no group is larger than two conversations. Turns that repeat
    whole are turns of their own; pair ids must differ. Other columns are not read, and clashing ones don't matter; no
    pairs give no rows, no turns give empty texts.
    """
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("conv_id")) for i, c in enumerate(("chosen_id", "rejected_id"))]))
    ends = pairs.select("pair_id", side.alias("s")).select("pair_id", "s.side", "s.conv_id")
    t = ends.join(turns.select("conv_id", "turn", "role", "text"), "conv_id")
    order = (F.col("turn").asc_nulls_last(), "role", "text")
    t = t.withColumn("at", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(*order)))
    same = Window.partitionBy("pair_id", "at")
    turn = F.struct("role", "text")
    t = t.withColumn("both", (F.count("*").over(same) == 2) & F.min(turn).over(same).eqNullSafe(F.max(turn).over(same)))
    first = F.min(F.when(~F.col("both"), F.col("at"))).over(Window.partitionBy("pair_id"))
    t = t.withColumn("shared", F.coalesce(F.col("at") < first, F.lit(True))).withColumn("body", render(F.col("role"), F.col("text")))
    inside = Window.partitionBy("pair_id", "side", "shared").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("stop", F.sum(F.length("body")).over(inside))
    begin = F.col("stop") - F.length("body") + F.length(escape_role(F.col("role"))) + 5
    t = t.withColumn("span", F.when(F.col("role") == loss_role, F.concat_ws("-", begin.cast("string"), F.col("stop").cast("string"))))

    def joined(keep: Column, column: str, by: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("at", column)))), lambda x: x[column]), by)

    out = t.groupBy("pair_id").agg(
        F.count_if(F.col("shared") & (F.col("side") == 0)).alias("prompt_turns"),
        joined(F.col("shared") & (F.col("side") == 0), "body", "").alias("prompt"),
        joined(~F.col("shared") & (F.col("side") == 0), "body", "").alias("chosen"),
        joined(~F.col("shared") & (F.col("side") == 1), "body", "").alias("rejected"),
        joined(~F.col("shared") & (F.col("side") == 0), "span", ",").alias("chosen_mask"),
        joined(~F.col("shared") & (F.col("side") == 1), "span", ",").alias("rejected_mask"),
    )
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")]
    return pairs.join(out, "pair_id", "left").select(
        "pair_id", "chosen_id", "rejected_id", F.coalesce("prompt_turns", F.lit(0)).cast("long").alias("prompt_turns"), *text
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected, where both exist."""
    ids = turns.select("conv_id").where("conv_id is not null").distinct().withColumn("pair_id", F.floor(F.col("conv_id") / 2))
    both = ids.groupBy("pair_id").agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    return both.where("chosen_id < rejected_id")
