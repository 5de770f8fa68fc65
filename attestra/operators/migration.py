"""A change of the class in notes' front matter: the change set first, then the notes, then the relations that touch them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
CLASSES = {"10 原始资料": "source", "20 学习笔记": "knowledge", "30 情报简报": "intelligence", "40 方法库": "knowledge", "50 输出成果": "creation"}
REMOVED = ("00 收件箱", "90 系统")
REASON = "graph_metadata_canonicalization_nonsemantic"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def _header_end(text: Column) -> Column:
    """Where the line feed ahead of the closing mark is (from 1); 0 without front matter."""
    return F.when(text.startswith("---\n"), F.locate("\n---\n", text, 5)).otherwise(0)


def body(text: Column) -> Column:
    """What follows the closing mark; null without front matter."""
    return F.when(_header_end(text) > 0, F.substring(text, _header_end(text) + 5, F.length(text)))


def _header(text: Column) -> Column:
    lines = F.split(F.substring(text, F.lit(5), _header_end(text) - 5), LINE_ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def reclassed(text: Column, wanted: Column, key: str = "asset_class") -> Column:
    """Text whose front matter has ``wanted`` on every line of the key (on a new last line where there is none), or, where
    ``wanted`` is null, no such line. Without front matter the text stays; the body always does.
    Line ends of the header become line feeds and a blank line at its end goes, one a pass, so such a header may change again."""
    lines, ours = _header(text), lambda x: x.startswith(f"{key}:")
    line = F.concat(F.lit(f"{key}: "), wanted)
    put = F.when(F.exists(lines, ours), F.transform(lines, lambda x: F.when(ours(x), line).otherwise(x))).otherwise(F.array_append(lines, line))
    new = F.when(wanted.isNull(), F.filter(lines, lambda x: ~ours(x))).otherwise(put)
    return F.when(_header_end(text) > 0, F.concat(F.lit("---\n"), F.array_join(new, "\n"), F.lit("\n---\n"), body(text))).otherwise(text)


def change_set(notes: DataFrame, classes: dict[str, str] | None = None, removed: tuple[str, ...] = REMOVED, key: str = "asset_class") -> DataFrame:
    """What a migration would change, before anything is written: relative_path, folder, previous_class, new_class,
    before_hash, after_hash, body_hash and after_text, for notes (relative_path, folder, text) whose text changes.

    ``classes`` gives a folder's class; in ``removed`` folders the line goes. Notes of other folders, without front
    matter or without a text are no part of it. Only a scan: no shuffle, and texts don't leave their task.
    """
    classes = CLASSES if classes is None else classes
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    n = notes.where(F.col("folder").isin(*classes, *removed) & (_header_end(F.col("text")) > 0))
    n = n.withColumn("wanted", F.element_at(table, F.col("folder"))).withColumn("after_text", reclassed(F.col("text"), F.col("wanted"), key))
    had = F.filter(_header(F.col("text")), lambda x: x.startswith(f"{key}:"))
    previous = F.regexp_replace(F.substring(F.element_at(had, -1), len(key) + 2, 1_000_000_000), r"(?U)\A\s+|\s+\z", "")
    return n.where(F.col("after_text") != F.col("text")).select(
        "relative_path", "folder", F.when(F.size(had) > 0, previous).otherwise("").alias("previous_class"), F.coalesce("wanted", F.lit("removed")).alias("new_class"),
        _hash(F.col("text")).alias("before_hash"), _hash(F.col("after_text")).alias("after_hash"), _hash(body(F.col("after_text"))).alias("body_hash"), "after_text",
    )


def migrated(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes after a change set: relative_path, folder, text, state.

    state: ``changed`` where the note still is what the change was made for, ``current`` where it already is what it would
    become (a repeated run), ``drifted`` where it is neither and so keeps its text, and ``untouched``.
    """
    c = changes.select("relative_path", "before_hash", "after_hash", "after_text")
    j = notes.select("relative_path", "folder", "text").join(c, "relative_path", "left")
    now = _hash(F.col("text"))
    state = (
        F.when(F.col("before_hash").isNull(), "untouched").when(F.coalesce(now == F.col("before_hash"), F.lit(False)), "changed")
        .when(F.coalesce(now == F.col("after_hash"), F.lit(False)), "current").otherwise("drifted")
    )
    return j.withColumn("state", state).select("relative_path", "folder", F.when(F.col("state") == "changed", F.col("after_text")).otherwise(F.col("text")).alias("text"), "state")


def rebase(registry: DataFrame, assets: DataFrame, changes: DataFrame) -> DataFrame:
    """A registry with the revisions of touched relations renewed, all its rows, and their rebase_state.

    ``registry``: relation_id, source_location, target_location, source_asset_id, target_asset_id, source_revision,
    target_revision and any others, which stay. ``assets``: relative_path, asset_id, revision, file_hash after the migration.
    A relation is touched if the change set has one of its ends. States: ``untouched``, ``asset_missing`` (kept as it
    is), ``identity_changed`` (kept; a caller must not write a registry that has any) and ``rebased``, which also sets
    source_snapshot, target_snapshot, revalidation_status and revision_change_reason. Paths are unique in both tables.
    Changes and assets are joined as one table by path, once for each end.
    """
    path = "relative_path"
    at = assets.select(path, F.struct("asset_id", "revision", "file_hash").alias("asset")).join(changes.select(path, F.lit(True).alias("hit")), path, "full")
    end = lambda side: at.select(F.col(path).alias(f"{side}_location"), F.col("asset").alias(f"_{side}"), F.col("hit").alias(f"_{side}_hit"))
    j = registry.join(end("source"), "source_location", "left").join(end("target"), "target_location", "left")
    touched = F.coalesce("_source_hit", "_target_hit", F.lit(False))
    known = F.col("_source").isNotNull() & F.col("_target").isNotNull()
    same = F.col("_source.asset_id").eqNullSafe(F.col("source_asset_id")) & F.col("_target.asset_id").eqNullSafe(F.col("target_asset_id"))
    state = F.when(~touched, "untouched").when(~known, "asset_missing").when(~same, "identity_changed").otherwise("rebased")
    j = j.withColumn("rebase_state", state)
    done = F.col("rebase_state") == "rebased"
    old = lambda name: F.col(name) if name in registry.columns else F.lit(None).cast("string")
    new = {
        "source_revision": F.col("_source.revision"), "target_revision": F.col("_target.revision"), "source_snapshot": F.col("_source.file_hash"), "target_snapshot": F.col("_target.file_hash"),
        "revalidation_status": F.lit("verified"), "revision_change_reason": F.lit(REASON),
    }
    rest = [c for c in registry.columns if c not in new]
    return j.select(*rest, *[F.when(done, v).otherwise(old(name)).alias(name) for name, v in new.items()], "rebase_state")
