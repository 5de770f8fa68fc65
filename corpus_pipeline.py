"""A corpus pipeline of the llm operators: what is toxic, poor or a copy goes, the rest is mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import mixing, ngram_jaccard, packing, rules, toxicity
from attestra.llm.labelled import fold
from attestra.llm.queries import QUALITY_LIMIT, TOXIC_LIMIT
from attestra.runtime import bound_batches, discard, materialise, table


# Every stage gives an empty table for an empty one, keeps columns it doesn't name whatever they are called, decides
# rows that repeat whole alike, and reads whole texts; null and empty texts are said where they matter.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.7; null and wordless texts have no passage and stay unless the model is empty
    and most labels are toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.keep_clean(docs, model, TOXIC_LIMIT)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least 0.3; a null text has the statistics of an empty one."""
    bound_batches(spark)
    model = rules.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return rules.keep_good(docs, model, QUALITY_LIMIT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8, the one with the smallest id.

    Documents without words and rows without an id are nobody's copies. Where ids repeat, rows decide (see below).
    """
    bound_batches(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        return _drop_copied_rows(docs)
    groups = ngram_jaccard.jaccard_components(docs, width=5, percent=80)
    drop, _ = materialise(groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("doc_id")), "drop")
    return docs.join(drop, "doc_id", "left_anti")


def _drop_copied_rows(docs: DataFrame) -> DataFrame:
    """The same where ids repeat: rows are numbered and decided by number. Of a group the row with the smallest id stays,
    of several with that id the first; a row travels as one column, so no name of its columns can clash."""
    rows, _ = materialise(docs.select(F.struct("*").alias("row"), "doc_id", "text", F.monotonically_increasing_id().alias("at")), "rows", "zstd")
    groups = ngram_jaccard.jaccard_components(rows.where("doc_id is not null").select("at", "text"), id_col="at", width=5, percent=80)
    named = groups.select(F.col("id").alias("at"), "component_id").join(rows.select("at", "doc_id"), "at")
    stays = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "at")).alias("stays"))
    drop = named.join(stays, "component_id").where(F.col("at") != F.col("stays.at")).select("at")
    drop, _ = materialise(drop, "drop")
    return rows.join(drop, "at", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken by the words held, to the nearest whole number.

    Null and wordless texts are never taken; a null source is a source, the last.
    """
    bound_batches(spark)
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; null and empty texts give the end id alone, a null id stays null."""
    bound_batches(spark)
    return packing.pack(docs, window=1024, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and tokenizers are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes once the next one is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old:
            discard(spark, old)
        old = path
    return docs
