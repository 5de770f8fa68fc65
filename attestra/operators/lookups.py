"""Lookups with guards, fixed orders, fills, and the state of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators.state import OPERATION_TYPES

# Fixed values that results depend on.
PUBLISH_ORDER = ("source_asset", "learning_note", "intelligence_brief", "method_asset", "creation_asset")
CAPTURE_SECTIONS = ("来源信息", "采集状态")
SUBTITLE_PRIORITY = ("zh-Hans", "zh", "zh-CN", "en")
PENDING = "capture_incomplete_projection_pending"
SEVERAL = "multiple inbox projections share the same material_id"
DRIFT = "same revision projection content drift detected"
CAPTURE = """protocol string, source struct<source_url:string,platform:string,title:string,author:string>,
  capture struct<capture_status:string,capture_method:string,warnings:array<string>>, subtitle struct<status:string,language:string,reference:string>,
  audio struct<status:string>, visual struct<text_possible:string>, media struct<files:array<struct<path:string>>>"""


def one_or_none(rows: DataFrame, key: str, value: str, problem: str) -> DataFrame:
    """The row with a key, if there is one; more are an error. At most two rows reach the driver."""
    hit = rows.where(F.col(key) == value)
    if hit.limit(2).count() > 1:
        raise ValueError(problem)
    return hit


def exactly_one(rows: DataFrame, key: str, value: str, problem: str) -> DataFrame:
    """The row with a key; none or more are an error."""
    hit = rows.where(F.col(key) == value)
    if hit.limit(2).count() != 1:
        raise ValueError(problem)
    return hit


def get_operation(operations: DataFrame, operation_id: str) -> DataFrame:
    """The log row of an operation, no row if unknown; a malformed id and a repeated record are errors."""
    kind, _, token = operation_id.removeprefix("op_").rpartition("_")
    if not operation_id.startswith("op_") or kind not in OPERATION_TYPES or len(token) != 32 or set(token) - set("0123456789abcdef"):
        raise ValueError("invalid operation id")
    return one_or_none(operations, "operation_id", operation_id, "duplicate operation records")


def load_candidate(strong: DataFrame, medium: DataFrame, candidate_id: str) -> DataFrame:
    """The strong or medium candidate of an id, which must be one row."""
    return exactly_one(strong.unionByName(medium, allowMissingColumns=True), "candidate_id", candidate_id, "candidate_id must identify one strong/medium candidate")


def first_receipts(receipts: DataFrame, protocol: str) -> DataFrame:
    """(candidate_id, path, receipt): the first receipt of each candidate by path, of one protocol; other columns are in ``receipt``."""
    rest = [c for c in receipts.columns if c not in ("candidate_id", "path", "protocol")]
    own = receipts.where((F.col("protocol") == protocol) & F.col("candidate_id").isNotNull())
    # the struct breaks ties by its values, so that reruns agree
    best = F.min(F.struct("path", *rest))
    return own.groupBy("candidate_id").agg(best.alias("receipt")).select("candidate_id", "receipt.path", "receipt")


def fill_missing_types(sources: DataFrame, derivatives: DataFrame, types: tuple[str, ...], key: str = "material_id") -> DataFrame:
    """Derivatives, and for each source a ``not_applicable`` row of every type it has none of. ``derivatives``: key, asset_type, status."""
    wanted = sources.select(key).distinct().withColumn("asset_type", F.explode(F.array(*map(F.lit, types))))
    absent = wanted.join(derivatives.select(key, "asset_type").distinct(), [key, "asset_type"], "left_anti")
    return derivatives.unionByName(absent.withColumn("status", F.lit("not_applicable")), allowMissingColumns=True)


def in_fixed_order(rows: DataFrame, column: str, order: tuple[str, ...] = PUBLISH_ORDER) -> DataFrame:
    """Rows by the place of a column's value in a list; others last, by value."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.orderBy(F.when(place == 0, len(order) + 1).otherwise(place).asc_nulls_last(), column)


def missing_sections(text: Column, names: tuple[str, ...] = CAPTURE_SECTIONS) -> Column:
    """Required section names that a text lacks; null text lacks all."""
    return F.array_compact(F.array(*[F.when(~F.contains(F.coalesce(text, F.lit("")), F.lit(n)), n) for n in names]))


def without_roles(entries: DataFrame, roles: tuple[str, ...], renamed: dict[str, str] | None = None) -> DataFrame:
    """Entries of other roles than ``roles``, some renamed; a null role stays."""
    name = F.col("role")
    for old, new in (renamed or {}).items():
        name = F.when(F.col("role") == old, new).otherwise(name)
    return entries.where(F.coalesce(~F.col("role").isin(*roles), F.lit(True))).withColumn("role", name)


def language_decision(decision: Column, text: Column, provider: Column) -> Column:
    """Declared, detected and output language and the reason: of a decision (a struct, null if there is none), else detected."""
    found = T.detect_language(text)
    own = F.concat(F.lit("single "), provider, F.lit(" transcript selected; detected_language="), found)
    chosen = F.coalesce(decision["selected_language"], found)
    reason = F.when(decision.isNull(), own).otherwise(decision["language_decision_reason"])
    return F.struct(
        F.coalesce(decision["declared_language"], found).alias("declared_language"), chosen.alias("detected_language"), chosen.alias("output_language"),
        reason.alias("language_decision_reason"), F.coalesce(decision["selected_candidate_id"], F.lit("")).alias("selected_candidate_id"),
    )


def known(value: Column) -> Column:
    """The value, ``unknown`` if it is blank or null."""
    return F.when(F.regexp_like(F.coalesce(value, F.lit("")), F.lit("(?U)\\S")), value).otherwise("unknown")


def capture_results(captures: DataFrame, json_col: str = "record") -> DataFrame:
    """Capture records (JSON) as flat results; ``problem`` for another protocol or unreadable text. Other columns stay."""
    c = F.from_json(json_col, CAPTURE)
    paths = F.filter(F.transform(c["media"]["files"], lambda f: f["path"]), lambda p: F.coalesce(p != "", F.lit(False)))
    flat = {
        "source_url": known(c["source"]["source_url"]), "platform": known(c["source"]["platform"]), "title": known(c["source"]["title"]), "author": known(c["source"]["author"]),
        "capture_status": known(c["capture"]["capture_status"]), "raw_file_reference": F.coalesce(F.get(paths, F.lit(0)), known(c["subtitle"]["reference"])),
        "duration": F.lit("unknown"), "language": known(c["subtitle"]["language"]), "subtitle_detected": known(c["subtitle"]["status"]),
        "audio_detected": known(c["audio"]["status"]), "visual_text_possible": known(c["visual"]["text_possible"]),
        "failure_reason": F.coalesce(F.array_join(c["capture"]["warnings"], " | "), F.lit("")), "capture_tool": known(c["capture"]["capture_method"]),
        "problem": F.when(~F.coalesce(c["protocol"] == "capture-protocol-v2", F.lit(False)), "protocol must be capture-protocol-v2"),
    }
    return captures.withColumns(flat)


def subtitle_languages(manual: Column, automatic: Column) -> Column:
    """Languages in order of priority that either list has."""
    empty = F.array().cast("array<string>")
    return F.array_intersect(F.array(*map(F.lit, SUBTITLE_PRIORITY)), F.array_union(F.coalesce(manual, empty), F.coalesce(automatic, empty)))


def projections(files: DataFrame) -> DataFrame:
    """(path, text, material_id, revision_id) of projected Markdown files; without front matter both ids are empty."""
    value = lambda k: F.coalesce(T.frontmatter_value(F.col("text"), k), F.lit("")).alias(k)
    return files.select("path", "text", value("material_id"), value("revision_id"))


def projection_actions(sources: DataFrame, files: DataFrame, refresh: bool = False) -> DataFrame:
    """What completing each source does to its projection: (material_id, revision_id, target, status, action, reason, previous_revision).

    ``sources``: material_id, revision_id, requested (path), rendered, state; one row a material. ``files``: path, text.
    A source with one projection keeps its place. The same revision with the same text is already projected, with another
    one drift, which ``refresh`` mends. ``action`` is null where nothing is written.
    """
    have = projections(files)
    own = have.where("material_id <> ''").groupBy("material_id").agg(F.count("*").alias("n"), F.min("path").alias("place"))
    there = have.select(F.col("path").alias("target"), F.col("text").alias("old"), F.col("revision_id").alias("previous_revision"))
    j = sources.join(own, "material_id", "left").withColumn("target", F.coalesce("place", "requested")).join(there, "target", "left")
    same = F.coalesce(F.col("previous_revision") == F.col("revision_id"), F.lit(False))
    drift = same & (F.col("old") != F.col("rendered"))
    several = F.coalesce(F.col("n") > 1, F.lit(False))
    stuck = several | drift if not refresh else several
    rest = same & ~drift
    return j.select(
        "material_id", "revision_id", "target",
        F.when(stuck, PENDING).when(rest, "already_projected").otherwise(F.col("state")).alias("status"),
        F.when(stuck | rest, None).when(drift, "refreshed").when(F.coalesce(F.col("previous_revision"), F.lit("")) != "", "updated").otherwise("created").alias("action"),
        F.when(several, SEVERAL).when(drift & stuck, DRIFT).alias("reason"), F.coalesce("previous_revision", F.lit("")).alias("previous_revision"),
    )


def transcript_markdown(language: Column, reason: Column, paragraphs: Column, segments: Column) -> Column:
    """A readable transcript: paragraphs under their times, then every segment as evidence. Both are arrays of structs."""
    span = lambda s: F.concat(T.clock(s["start_time"]), F.lit("–"), T.clock(s["end_time"]))
    safe = lambda t: F.replace(F.replace(F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    read = F.transform(paragraphs, lambda p: F.concat(F.lit("### "), span(p), F.lit("\n\n"), p["text"], F.lit("\n")))
    proof = F.transform(segments, lambda s: F.concat(F.lit("- `"), span(s), F.lit("` `"), s["segment_id"], F.lit("` "), safe(s["text"])))
    head = F.concat(
        F.lit("# Readable Transcript\n\n> 输出语言："), language, F.lit("。"), reason,
        F.lit("\n> 本文只做断句、相邻去重和段落整理；未总结、扩写或改变作者立场。\n\n## 连续可读正文\n"),
    )
    tail = F.lit("## 时间证据\n\n<details>\n<summary>展开逐段时间证据</summary>\n")
    return F.array_join(F.concat(F.array(head), read, F.array(tail), proof, F.array(F.lit("\n</details>\n"))), "\n")


def yaml_scalar(value: Column) -> Column:
    """A scalar as JSON text, null as null."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def header_block(values: dict[str, Column]) -> Column:
    """Front matter of scalars in the given order."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_scalar(v)) for k, v in values.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))

