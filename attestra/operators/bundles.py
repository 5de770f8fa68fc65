"""Approved bundles of candidates: what an approval binds, the checks before publishing, and dispatch in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.runtime import discard, materialise

# Fixed values that results depend on.
ORDER = ("source_asset", "learning_note", "intelligence_brief", "method_asset", "creation_asset")
FOLDERS = {"source_asset": "10 原始资料", "learning_note": "20 学习笔记", "intelligence_brief": "30 情报简报", "method_asset": "40 方法库", "creation_asset": "50 输出成果"}
BUNDLE, PLAN = "candidate-bundle-v1", "candidate-bundle-publish-plan-v1"
AWAITING = "awaiting_user_confirmation"

KEY = ["bundle_id", "candidate_id"]


def _hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def body_hash(text: Column) -> Column:
    """Hash of a text without its front matter and outer white space, with one final line feed."""
    end = F.locate("\n---\n", text, 5)
    bare = F.when(text.startswith("---\n") & (end > 0), F.substring(text, end + 5, F.length(text))).otherwise(text)
    return _hash(F.concat(F.regexp_replace(bare, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), F.lit("\n")))


def candidate_view(candidates: DataFrame) -> Column:
    """The part of a candidate that an approval covers, as JSON with sorted keys; provenance counts as a set of rows in order."""
    source = F.struct("material_id", "revision_id")
    is_source = F.col("asset_type") == "source_asset"
    content = F.when(is_source, F.to_json(F.struct("content_hash", "readable_reference"), {"ignoreNullFields": "false"})).otherwise(
        F.to_json(F.struct(body_hash(F.coalesce("markdown", F.lit(""))).alias("body_hash"), "title"), {"ignoreNullFields": "false"})
    )
    stable = F.array_sort(F.coalesce("stable_references", F.array().cast("array<string>")))
    admission = F.coalesce("admission", F.lit("{}"))
    return I.to_json(F.struct(admission.alias("admission"), "asset_type", "candidate_id", content.alias("content"), stable.alias("provenance"), source.alias("source"), "status"))


def _sha(value: Column) -> Column:
    """The first 16 bytes of a SHA-256, as texts that are only compared are carried through shuffles."""
    return F.substring(F.unhex(F.sha2(value.cast("binary"), 256)), 1, 16)


def bundle_digests(candidates: DataFrame) -> DataFrame:
    """(bundle_id, bundle_digest): one digest of all candidates of a bundle, whatever their order.

    The hashes of the views are added up in eight 32-bit words, and the sums and their count are hashed. Sums are
    partial before the shuffle, so a bundle of any size needs no task that holds it.
    """
    v = candidates.select("bundle_id", F.sha2(candidate_view(candidates), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).cast("string") for i in range(8)]
    return v.groupBy("bundle_id").agg(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *words), 256)).alias("bundle_digest"))


def held_columns(candidates: DataFrame) -> list[Column]:
    """Of a candidate what the checks need, texts as hashes."""
    return [*map(F.col, ("asset_type", "status", "material_id", "revision_id", "title")), _sha(candidate_view(candidates)).alias("view"), _sha(body_hash(F.coalesce("markdown", F.lit("")))).alias("body")]


def planned_columns() -> list[Column]:
    """Of a component what the bindings need, texts as hashes."""
    published = F.when(F.col("published_body").isNotNull(), _sha(body_hash(F.col("published_body"))))
    return [*map(F.col, ("target_folder", "filename", "source_material_id", "source_revision_id", "published_title", "projection_hash", "quality")), published.alias("published")]


def own_binding(rows: DataFrame) -> DataFrame:
    """Rows of ``held_columns`` and ``planned_columns`` with ``found``, the first problem, and ``own``, the bytes of the candidate's own binding."""
    kind, is_source = F.col("asset_type"), F.col("asset_type") == "source_asset"
    folder = F.element_at(F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair]), kind)
    plain_name = F.col("filename").rlike(r"\A[^/\x00]+\.md\z")
    published = F.when(~is_source, F.col("published"))
    problem = (
        F.when(~F.coalesce((F.col("target_folder") == folder) & plain_name, F.lit(False)), "target_mismatch")
        .when(~(F.col("material_id").eqNullSafe(F.col("source_material_id")) & F.col("revision_id").eqNullSafe(F.col("source_revision_id"))), "source_mismatch")
        .when(published.isNotNull() & (published != F.col("body")), "body_mismatch")
        .when(~is_source & F.col("published_title").isNotNull() & ~F.col("title").eqNullSafe(F.col("published_title")), "title_mismatch")
        .when(is_source & (F.coalesce("projection_hash", F.lit("")) == ""), "projection_missing")
    )
    snap = I.to_json(F.struct("filename", F.hex(published).alias("published"), F.when(is_source, F.col("projection_hash")).alias("projection"), "quality", "target_folder", F.hex("view").alias("view")))
    return rows.withColumn("found", problem).withColumn("own", F.when(F.col("found").isNull(), F.unhex(F.sha2(snap, 256))))


def whole_binding(digest: Column, own: Column) -> Column:
    """The binding of a candidate within its bundle, from its own one; null where that is."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(digest, F.lit("|"), F.hex(own)).cast("binary"), 256))


def written(own: Column) -> Column:
    """Bytes of a hash as the text that is stored."""
    return F.concat(F.lit("sha256:"), F.lower(F.hex(own)))


def bindings(candidates: DataFrame, components: DataFrame) -> DataFrame:
    """What publishing would write now: bundle_id, candidate_id, problem, binding, own_binding.

    ``candidates``: bundle_id, candidate_id, asset_type, status, material_id, revision_id, title, markdown,
    readable_reference, content_hash, stable_references (array), admission (canonical JSON). ``components``: bundle_id,
    candidate_id, target_folder, filename, source_material_id, source_revision_id, published_title, published_body,
    projection_hash, quality (canonical JSON). ``binding`` covers the whole bundle and ``own_binding`` only the candidate; both
    are null where a problem forbids a snapshot: ``target_mismatch``, ``source_mismatch``, ``body_mismatch``,
    ``title_mismatch``, ``projection_missing``. Only candidates with a component have a row. Texts are hashed where they are
    read; only hashes are shuffled.
    """
    j = candidates.select(*KEY, *held_columns(candidates)).join(components.select(*KEY, *planned_columns()), KEY)
    j = own_binding(j).select(*KEY, "found", "own").join(bundle_digests(candidates), "bundle_id")
    return j.select(*KEY, F.col("found").alias("problem"), whole_binding(F.col("bundle_digest"), F.col("own")).alias("binding"), written(F.col("own")).alias("own_binding"))


def preflight(bundles: DataFrame, candidates: DataFrame, components: DataFrame, selection: DataFrame) -> DataFrame:
    """Every selected candidate with its place and first problem: bundle_id, candidate_id, asset_type, place, problem, blocked.

    ``bundles``: bundle_id, protocol, workflow_state, plan_protocol, plan_bundle_id, confirmed, reviewer, one row each.
    ``candidates`` and ``components`` as for ``bindings``; components also have component_type, inputs (array of paths),
    snapshot (``candidate_view`` of the stored candidate, null if none is stored), approved and confirmed_binding.
    ``selection``: bundle_id, candidate_id, position; a bundle without a row selects all its publishable candidates, in the order
    of their ids. ``place`` orders a bundle: types in a fixed order, then position. ``blocked`` is the problem of the
    bundle's first selected candidate that has one: nothing of that bundle is published.

    Problems in order: ``bundle_state``, ``plan_mismatch``, ``approval_missing``, ``candidate_absent``, ``not_publishable``,
    ``component_mismatch``, ``temporary_input``, ``snapshot_missing``, ``candidate_changed``, those of ``bindings``,
    ``approval_mismatch``, ``confirmation_mismatch`` and ``source_repeated`` (a bundle has one source). Ids are
    unique within a bundle; null ids match nothing. An empty table of bundles gives no rows.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    named = F.col("candidate_id").isNotNull()
    held = candidates.select(*KEY, *held_columns(candidates)).withColumns({c: F.when(named, F.col(c)) for c in ("asset_type", "view")})
    temporary = yes(F.exists("inputs", I.is_temporary)).alias("temporary")
    plan = components.select(*KEY, *planned_columns(), "component_type", temporary, _sha(F.col("snapshot")).alias("snapshot"), _sha(F.col("approved")).alias("approved"), _sha(F.col("confirmed_binding")).alias("own_confirmed"))
    chosen = selection.select(*KEY, "position", F.lit(True).alias("asked"))
    # one shuffle by candidate: what is held, what is planned and what is asked for
    j = own_binding(held.join(plan, KEY, "left")).join(chosen, KEY, "full").where(yes(F.col("asked")) | yes(F.col("status") == "publishable"))
    is_source, stored = F.col("asset_type") == "source_asset", F.col("snapshot")
    alone = (
        F.when(F.col("view").isNull(), "candidate_absent")
        .when(~yes(F.col("status") == "publishable"), "not_publishable")
        .when(~yes(F.col("component_type") == F.col("asset_type")), "component_mismatch")
        .when(F.col("temporary"), "temporary_input")
        .when(~is_source & stored.isNull(), "snapshot_missing")
        .when(~is_source & (stored != F.col("view")), "candidate_changed")
        .otherwise(F.col("found"))
    )
    unconfirmed = yes(~is_source & ~_sha(written(F.col("own"))).eqNullSafe(F.col("own_confirmed")))
    j = j.select(*KEY, "asset_type", "asked", F.when(F.col("asked"), F.col("position")).otherwise(0).cast("long").alias("position"), F.when(F.col("asked"), "").otherwise(F.col("candidate_id").cast("string")).alias("by"),
                 alone.alias("alone"), F.when(alone.isNull(), F.col("own")).alias("own"), F.when(alone.isNull(), F.col("approved")).alias("approved"), unconfirmed.alias("unconfirmed"))
    # and one by bundle, of what is left
    given = selection.select("bundle_id").distinct().withColumn("given", F.lit(True))
    heads = bundles.join(given, "bundle_id", "left").join(bundle_digests(candidates), "bundle_id", "left")
    j = j.join(heads, "bundle_id").where(yes(F.col("asked")) | F.col("given").isNull())
    bad = (
        F.when(~yes((F.col("protocol") == BUNDLE) & (F.col("workflow_state") == AWAITING)), "bundle_state")
        .when(~yes((F.col("plan_protocol") == PLAN) & (F.col("plan_bundle_id") == F.col("bundle_id"))), "plan_mismatch")
        .when(~yes(F.col("confirmed") & (F.col("reviewer") == "user")), "approval_missing")
        .when(F.col("alone").isNotNull(), F.col("alone"))
        .when(~_sha(whole_binding(F.col("bundle_digest"), F.col("own"))).eqNullSafe(F.col("approved")), "approval_mismatch")
        .when(F.col("unconfirmed"), "confirmation_mismatch")
    )
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("asset_type")), F.lit(0)).cast("long")
    rows = j.select(*KEY, "asset_type", F.struct(order.alias("type"), "position", "by").alias("place"), bad.alias("problem"))
    first = F.min(F.when(F.col("asset_type") == "source_asset", F.col("place")))
    asked = F.struct("place.position", "place.by")
    later = rows.groupBy("bundle_id").agg(first.alias("source"), F.min_by("problem", F.when(F.col("problem").isNotNull(), asked)).alias("first"), F.count_if(F.col("asset_type") == "source_asset").alias("sources"))
    out = rows.join(later, "bundle_id")
    again = (F.col("sources") > 1) & (F.col("asset_type") == "source_asset") & (F.col("place") > F.col("source"))
    blocked = F.coalesce("first", F.when(F.col("sources") > 1, "source_repeated"))
    return out.select(*KEY, "asset_type", "place", F.coalesce("problem", F.when(again, "source_repeated")).alias("problem"), blocked.alias("blocked"))


def dispatch(prepared: DataFrame, publish: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Publish what ``preflight`` admits: rows (bundle_id, candidate_id, asset_type, place, status, reason) and bundles (bundle_id, status, n).

    ``publish`` gets candidates and returns bundle_id, candidate_id, committed for them; a candidate it leaves out isn't
    committed. It runs twice, for all sources and then for the derivatives of bundles whose source committed or that
    publish none, and must be safe to repeat, as tasks may be. Derivatives of a failed source wait: ``pending_retry``. A
    bundle is ``published``, ``publish_partial`` or ``blocked``. Both waves are written before they are used.
    """
    spark, paths = prepared.sparkSession, []

    def write(df: DataFrame, label: str) -> DataFrame:
        out, path = materialise(df, label)
        paths.append(path)
        return out

    cols = [*KEY, "asset_type", "place"]
    rows = write(prepared, "prepared")
    ready = rows.where("blocked is null").select(*cols)
    is_source = F.col("asset_type") == "source_asset"

    def wave(df: DataFrame, label: str) -> DataFrame:
        told = publish(df).groupBy(*KEY).agg(F.bool_or("committed").alias("committed"))
        return write(df.join(told, KEY, "left").select(*cols, F.coalesce("committed", F.lit(False)).alias("committed")), label)

    sources = wave(ready.where(is_source), "sources")
    failed = sources.where("not committed").select("bundle_id").distinct()
    others = wave(ready.where(~is_source).join(failed, "bundle_id", "left_anti"), "derivatives")
    state = F.when(F.col("committed"), "published_or_already_published").otherwise("pending_retry")
    none = F.lit(None).cast("string")
    ran = sources.unionByName(others).select(*cols, state.alias("status"), none.alias("reason"))
    waits = ready.where(~is_source).join(failed, "bundle_id", "left_semi").select(*cols, F.lit("pending_retry").alias("status"), F.lit("source_not_committed").alias("reason"))
    stopped = rows.where("blocked is not null").select(*cols, F.lit("blocked").alias("status"), F.col("blocked").alias("reason"))
    done, _ = materialise(ran.unionByName(waits).unionByName(stopped), "dispatched")
    whole = F.when(F.bool_or(F.col("status") == "blocked"), "blocked").when(F.bool_and(F.col("status") == "published_or_already_published"), "published").otherwise("publish_partial")
    for path in paths:
        discard(spark, path)
    return done, done.groupBy("bundle_id").agg(whole.alias("status"), F.count("*").alias("n"))
