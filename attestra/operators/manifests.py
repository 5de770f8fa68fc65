"""Checks of source materials, their manifests and quality reports: JSON rows in, the first problem of each out.

A check is an ordered list of (problem, condition) over columns; a record's problem is the first condition that holds,
null for a sound record. Records are JSON texts and are read by a schema, so that nothing runs outside the JVM but the
canonical form that a revision id hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.runtime import materialise

# Fixed values that results depend on.
MATERIAL = f"material_sha256_{I.HEX64}"
REVISION = f"revision_sha256_{I.HEX64}"
ASSET = f"asset_sha256_{I.HEX64}"
SIDECAR = f"sidecar_sha256_{I.HEX64}"
KINDS = ("asset", "manifest", "report", "sidecar", "material")
FORBIDDEN_KEYS = (
    "analysis", "summary", "key_points", "core_claims", "argument_chain", "argument_structure", "recommendation", "possible_value", "methodology",
)
MATERIAL_KEYS = (
    "protocol", "schema_version", "material_id", "revision_id", "source", "content", "evidence", "quality", "lifecycle",
    "asset_manifest_reference", "understanding_sidecar_reference",
)
PART_KEYS = {
    "source": ("platform", "source_id", "source_url", "title", "author", "captured_at"),
    "content": ("raw", "readable"),
    "quality": ("capture_status", "content_fidelity", "transcript_quality", "review_required", "uncertainties"),
    "lifecycle": ("status", "review_status", "created_at", "updated_at", "processing_history"),
}
BLOCK_KEYS = ("storage", "content_hash", "media_type")
EVIDENCE_KEYS = ("evidence_id", "kind", "reference", "content_hash", "uncertainty")
ENTRY_KEYS = ("reference", "asset_id", "role", "storage_relative_path", "content_hash", "media_type", "size_bytes")
CHOICES = {
    "quality.capture_status": ("complete", "partial"),
    "quality.content_fidelity": ("full", "partial"),
    "quality.transcript_quality": ("not_applicable", "raw", "readable", "partial"),
    "lifecycle.status": ("captured", "partial", "reviewed", "archived"),
    "lifecycle.review_status": ("pending", "reviewed", "convert_approved", "archived"),
}
UNKNOWN = ("", "unknown", "none", "null", "unavailable")
NOT_READY = ("failed", "raw", "unusable")

_BLOCK = "struct<storage:string,content_hash:string,media_type:string,text:string,reference:string>"
MATERIAL_SCHEMA = (
    "protocol string, schema_version string, material_id string, revision_id string, "
    "source struct<platform:string,source_id:string,source_url:string,title:string,author:string,published_at:string,captured_at:string>, "
    f"content struct<raw:{_BLOCK},readable:{_BLOCK}>, "
    "evidence array<struct<evidence_id:string,kind:string,reference:string,content_hash:string,uncertainty:string,start_time:double,end_time:double>>, "
    "quality struct<capture_status:string,content_fidelity:string,transcript_quality:string,review_required:string,uncertainties:array<string>>, "
    "lifecycle struct<status:string,review_status:string,created_at:string,updated_at:string,processing_history:array<struct<report_reference:string>>>, "
    "asset_manifest_reference string, understanding_sidecar_reference string"
)
MANIFEST_SCHEMA = (
    "protocol string, schema_version string, material_id string, revision_id string, entries array<struct<reference:string,asset_id:string,"
    "role:string,storage_relative_path:string,content_hash:string,media_type:string,size_bytes:long>>"
)
REPORT_SCHEMA = (
    "protocol string, transcript_content_hash string, readable_content_hash string, ready_for_sorting boolean, quality_status string, "
    "transcript_structural_qa struct<status:string,warnings:array<string>>, transcript_content_quality struct<status:string,warnings:array<string>>, "
    "missing_ranges array<string>"
)


def first_problem(*ladder: tuple[str, Column]) -> Column:
    """Name of the first condition that holds; null conditions don't hold."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in ladder])


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def lacks_keys(json: Column, names: tuple[str, ...]) -> Column:
    """Whether the object of a JSON text misses one of the keys."""
    return F.size(F.array_except(F.array(*map(F.lit, names)), _keys(json))) > 0


def holds_key(json: Column, names: tuple[str, ...]) -> Column:
    """Whether an object anywhere in a JSON text has one of the keys; a quote inside a string is always escaped.

    The pattern is only tried on texts that hold a quoted name, which a plain search of bytes tells.
    """
    named = reduce(or_, [F.contains(json, F.lit(f'"{name}"')) for name in names])
    return named & json.rlike(f'(?<!\\\\)"(?:{"|".join(names)})"\\s*:')


def holds_temporary(json: Column) -> Column:
    """Whether a string value anywhere in a JSON text starts with a temporary prefix; keys don't count.

    The pattern is only tried on texts in which a quote stands before the start of a prefix, escaped or not.
    """
    starts = sorted({c for p in I.TEMPORARY for c in ([p.split("/")[0]] if p[0] != "/" else ["/", "\\/"])})
    quoted = reduce(or_, [F.contains(json, F.lit(f'"{c}')) for c in starts])
    heads = "|".join(p.replace("/", "\\\\?/") for p in I.TEMPORARY)
    return json.rlike(f'(?<!\\\\)"(?:{heads})(?:[^"\\\\]|\\\\.)*+"(?!\\s*:)')


def bad_hash(value: Column) -> Column:
    return ~F.coalesce(value.rlike(f"^sha256:{I.HEX64}\\z"), F.lit(False))


def bad_reference(value: Column, scheme: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """Whether a value is no logical reference ``scheme://kind/...`` of an allowed kind."""
    shapes = {"asset": ASSET, "report": ASSET, "sidecar": SIDECAR, "manifest": f"{MATERIAL}/+{REVISION}", "material": f"{MATERIAL}/+revision/+{REVISION}"}
    ok = F.lit(False)
    for kind in kinds:
        ok = ok | value.rlike(f"^(?i:{scheme})://{kind}/+{shapes[kind]}/*(?:[?#].*)?\\z")
    return ~F.coalesce(ok, F.lit(False)) | I.is_temporary(value)


def _kind(reference: Column) -> Column:
    return F.regexp_extract(reference, "^[^:]+://([^/?#]*)", 1)


def _block_problems(parts: Column, block: Column, name: str, scheme: str) -> list[tuple[str, Column]]:
    stored = block["storage"]
    inline, apart = stored == "inline", stored == "reference"
    return [
        (f"{name}_keys", lacks_keys(parts[name], BLOCK_KEYS)),
        (f"{name}_hash", bad_hash(block["content_hash"])),
        (f"{name}_text", inline & block["text"].isNull()),
        (f"{name}_hash_mismatch", inline & (I.content_hash(block["text"]) != block["content_hash"])),
        (f"{name}_reference", apart & bad_reference(F.coalesce(block["reference"], F.lit("")), scheme, ("asset",))),
        (f"{name}_storage", ~F.coalesce(inline | apart, F.lit(False))),
    ]


def check_materials(materials: DataFrame, scheme: str, json_col: str = "record") -> DataFrame:
    """``materials`` with ``material`` (the record read) and ``problem`` (the first one, null if sound).

    Null or unreadable JSON has the problem ``json``. Nothing is dropped; rows that repeat are checked each. A record is
    cut into its parts once, and its content into blocks; keys are looked up in the part, not in the whole record.
    """
    j, m, parts, blocks = F.col(json_col), F.col("material"), F.col("_parts"), F.col("_blocks")
    rows = materials.withColumns({"material": F.from_json(j, MATERIAL_SCHEMA), "_parts": F.from_json(j, "map<string,string>")})
    rows = rows.withColumn("_blocks", F.from_json(parts["content"], "map<string,string>"))
    keys = [(f"{part}_keys", lacks_keys(parts[part], names)) for part, names in PART_KEYS.items()]
    evidence = F.coalesce(m["evidence"], F.array().cast("array<struct<evidence_id:string,kind:string,reference:string,content_hash:string,uncertainty:string,start_time:double,end_time:double>>"))
    raw_items = F.from_json(parts["evidence"], "array<string>")
    ids = F.transform(evidence, lambda e: e["evidence_id"])
    history = F.coalesce(m["lifecycle"]["processing_history"], F.array().cast("array<struct<report_reference:string>>"))
    named = F.filter(F.transform(history, lambda h: h["report_reference"]), lambda r: F.coalesce(r, F.lit("")) != "")
    sidecar = m["understanding_sidecar_reference"]
    ladder = [
        ("json", j.isNull() | F.json_object_keys(j).isNull()),
        ("keys", lacks_keys(j, MATERIAL_KEYS)),
        ("protocol", m["protocol"] != "source-material-v3"),
        ("schema_version", m["schema_version"] != "3.0.0"),
        ("forbidden_field", holds_key(j, FORBIDDEN_KEYS)),
        ("material_id", ~m["material_id"].rlike(f"^{MATERIAL}\\z")),
        ("revision_id", ~m["revision_id"].rlike(f"^{REVISION}\\z")),
        keys[0],
        ("identity", m["material_id"] != I.material_id(I.source_key(m["source"]["platform"], m["source"]["source_id"], m["source"]["source_url"]))),
        keys[1],
        *_block_problems(blocks, m["content"]["raw"], "raw", scheme),
        *_block_problems(blocks, m["content"]["readable"], "readable", scheme),
        ("operations", ~F.array_contains(_keys(blocks["readable"]), "operations")),
        ("evidence", m["evidence"].isNull()),
        ("evidence_keys", F.exists(raw_items, lambda x: lacks_keys(x, EVIDENCE_KEYS))),
        ("evidence_repeated", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("evidence_hash", F.exists(evidence, lambda e: bad_hash(e["content_hash"]))),
        ("evidence_reference", F.exists(evidence, lambda e: bad_reference(e["reference"], scheme, ("asset",)))),
        ("evidence_time", F.exists(evidence, lambda e: F.coalesce(e["end_time"] < e["start_time"], F.lit(False)))),
        keys[2],
        *[(path.replace(".", "_"), ~F.coalesce(m[path.split(".")[0]][path.split(".")[1]].isin(*names), F.lit(False))) for path, names in list(CHOICES.items())[:3]],
        ("review_required", F.coalesce(m["quality"]["review_required"], F.lit("")) != "true"),
        ("uncertainties", m["quality"]["uncertainties"].isNull()),
        keys[3],
        *[(path.replace(".", "_"), ~F.coalesce(m[path.split(".")[0]][path.split(".")[1]].isin(*names), F.lit(False))) for path, names in list(CHOICES.items())[3:]],
        ("processing_history", m["lifecycle"]["processing_history"].isNull() | F.exists(history, lambda h: h.isNull())),
        ("report_reference", F.exists(named, lambda r: bad_reference(r, scheme, ("report",)))),
        ("manifest_reference", bad_reference(m["asset_manifest_reference"], scheme, ("manifest",))),
        ("sidecar_reference", (sidecar != "") & bad_reference(sidecar, scheme, ("sidecar",))),
        ("revision", m["revision_id"] != I.revision_id(m)),
        ("temporary", holds_temporary(j)),
    ]
    return rows.withColumn("problem", first_problem(*ladder)).drop("_parts", "_blocks")


def material_references(checked: DataFrame) -> DataFrame:
    """(material_id, revision_id, place, reference, content_hash): every reference of a read record; hash where one is promised."""
    m = F.col("material")
    block = lambda name: F.when(m["content"][name]["storage"] == "reference", F.struct(F.lit(name).alias("place"), m["content"][name]["reference"].alias("reference"), m["content"][name]["content_hash"].alias("content_hash")))
    plain = lambda place, c: F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(place).alias("place"), c.alias("reference"), F.lit(None).cast("string").alias("content_hash")))
    items = F.transform(m["evidence"], lambda e: F.struct(F.concat(F.lit("evidence:"), e["evidence_id"]).alias("place"), e["reference"].alias("reference"), e["content_hash"].alias("content_hash")))
    reports = F.transform(m["lifecycle"]["processing_history"], lambda h: plain("report", h["report_reference"]))
    every = F.concat(
        F.array(block("raw"), block("readable"), plain("manifest", m["asset_manifest_reference"]), plain("sidecar", m["understanding_sidecar_reference"])),
        F.coalesce(items, F.array().cast("array<struct<place:string,reference:string,content_hash:string>>")),
        F.coalesce(reports, F.array().cast("array<struct<place:string,reference:string,content_hash:string>>")),
    )
    return checked.select(m["material_id"].alias("material_id"), m["revision_id"].alias("revision_id"), F.explode(F.array_compact(every)).alias("r")).select("material_id", "revision_id", "r.*")


def check_manifests(manifests: DataFrame, scheme: str, json_col: str = "record") -> DataFrame:
    """``manifests`` with ``manifest`` (the record read) and ``problem`` (the first one, null if sound)."""
    j, m = F.col(json_col), F.col("manifest")
    entries = F.coalesce(m["entries"], F.from_json(F.lit("[]"), "array<struct<reference:string,asset_id:string,role:string,storage_relative_path:string,content_hash:string,media_type:string,size_bytes:long>>"))
    names = F.transform(entries, lambda e: e["reference"])
    path = lambda e: e["storage_relative_path"]
    ladder = [
        ("json", j.isNull() | F.json_object_keys(j).isNull()),
        ("keys", lacks_keys(j, ("protocol", "schema_version", "material_id", "revision_id", "entries"))),
        ("protocol", m["protocol"] != "reference-manifest-v1"),
        ("schema_version", m["schema_version"] != "1.0.0"),
        ("material_id", ~m["material_id"].rlike(f"^{MATERIAL}\\z")),
        ("revision_id", ~m["revision_id"].rlike(f"^{REVISION}\\z")),
        ("entries", m["entries"].isNull()),
        ("entry_keys", F.exists(F.from_json(F.get_json_object(j, "$.entries"), "array<string>"), lambda x: lacks_keys(x, ENTRY_KEYS))),
        ("entry_reference", F.exists(entries, lambda e: bad_reference(e["reference"], scheme, ("asset", "report")))),
        ("entry_hash", F.exists(entries, lambda e: bad_hash(e["content_hash"]))),
        ("entry_asset_id", F.exists(entries, lambda e: e["asset_id"] != I.asset_id(e["content_hash"]))),
        ("entry_repeated", F.size(F.array_distinct(names)) < F.size(names)),
        ("unsafe_path", F.exists(entries, lambda e: path(e).startswith("/") | F.array_contains(F.split(path(e), "/"), ".."))),
        ("temporary_path", F.exists(entries, lambda e: I.is_temporary(path(e)))),
    ]
    return manifests.withColumn("manifest", F.from_json(j, MANIFEST_SCHEMA)).withColumn("problem", first_problem(*ladder))


def manifest_entries(checked: DataFrame) -> DataFrame:
    """(material_id, revision_id, reference, asset_id, role, storage_relative_path, content_hash, media_type, size_bytes); the
    last of a reference holds."""
    m = F.col("manifest")
    rows = checked.select(m["material_id"].alias("material_id"), m["revision_id"].alias("revision_id"), F.posexplode(m["entries"]).alias("pos", "e"))
    keys = ["material_id", "revision_id", F.col("e.reference").alias("reference")]
    return rows.groupBy(*keys).agg(F.max_by("e", "pos").alias("e")).select("material_id", "revision_id", "reference", *[f"e.{c}" for c in ENTRY_KEYS[1:]])


def check_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose stored file (path, size_bytes, content_hash) is missing or differs: entry columns and ``problem``."""
    f = files.select(F.col("path").alias("storage_relative_path"), F.col("size_bytes").alias("stored_size"), F.col("content_hash").alias("stored_hash"))
    j = entries.join(f, "storage_relative_path", "left")
    problem = first_problem(("missing", F.col("stored_hash").isNull()), ("size_mismatch", F.col("stored_size") != F.col("size_bytes")), ("hash_mismatch", F.col("stored_hash") != F.col("content_hash")))
    return j.withColumn("problem", problem).where("problem is not null").drop("stored_size", "stored_hash")


def bind(materials: DataFrame, manifests: DataFrame) -> DataFrame:
    """Checked materials against checked manifests: (material_id, revision_id, problem), one row a material.

    A manifest belongs to the revision that names the same ids. Problems, in this order: ``manifest_missing``,
    ``reference_missing`` (an asset or report that the manifest lacks), ``hash_mismatch``; null where all is bound.
    """
    ids = ["material_id", "revision_id"]
    wanted = material_references(materials).where(_kind(F.col("reference")).isin("asset", "report"))
    had = manifest_entries(manifests).select(*ids, "reference", F.col("content_hash").alias("stored"))
    j = wanted.join(had, [*ids, "reference"], "left")
    worst = j.groupBy(*ids).agg(F.bool_or(F.col("stored").isNull()).alias("absent"), F.bool_or(F.col("stored") != F.col("content_hash")).alias("differs"))
    known = manifests.select(*[F.col("manifest")[c].alias(c) for c in ids]).distinct().withColumn("known", F.lit(True))
    out = materials.select(*[F.col("material")[c].alias(c) for c in ids]).join(known, ids, "left").join(worst, ids, "left")
    problem = first_problem(("manifest_missing", F.col("known").isNull()), ("reference_missing", F.col("absent")), ("hash_mismatch", F.col("differs")))
    return out.select(*ids, problem.alias("problem"))


def latest_reports(materials: DataFrame, entries: DataFrame, reports: DataFrame, role: str = "transcript_quality_report") -> DataFrame:
    """(material_id, revision_id, report): the last history entry of each material whose manifest entry has the role.

    ``reports``: reference and record (JSON). A material without one has a null report.
    """
    m, ids = F.col("material"), ["material_id", "revision_id"]
    own = materials.select(m["material_id"].alias("material_id"), m["revision_id"].alias("revision_id"), m["lifecycle"]["processing_history"].alias("h"))
    steps = own.select(*ids, F.posexplode("h").alias("pos", "s")).select(*ids, "pos", F.col("s.report_reference").alias("reference"))
    of_role = entries.where(F.col("role") == role).select(*ids, "reference")
    last = steps.join(of_role, [*ids, "reference"]).groupBy(*ids).agg(F.max_by("reference", "pos").alias("reference"))
    read = reports.select("reference", F.from_json("record", REPORT_SCHEMA).alias("report")).dropDuplicates(["reference"])
    return own.select(*ids).distinct().join(last, ids, "left").join(read, "reference", "left").select(*ids, "report")


def quality_verdict(materials: DataFrame, latest: DataFrame) -> DataFrame:
    """(material_id, revision_id, problem, warnings): whether a material's latest report admits it to sorting."""
    m, r, ids = F.col("material"), F.col("report"), ["material_id", "revision_id"]
    j = materials.select(m["material_id"].alias("material_id"), m["revision_id"].alias("revision_id"), "material").join(latest, ids, "left")
    structural, content = r["transcript_structural_qa"], r["transcript_content_quality"]
    usable = content["status"].isin("usable", "usable_with_warnings")
    problem = first_problem(
        ("report_missing", r.isNull()),
        ("report_protocol", ~r["protocol"].eqNullSafe("media-transcript-quality-v1")),
        ("raw_hash", ~r["transcript_content_hash"].eqNullSafe(m["content"]["raw"]["content_hash"])),
        ("readable_hash", ~r["readable_content_hash"].eqNullSafe(m["content"]["readable"]["content_hash"])),
        ("capture_incomplete", ~m["quality"]["capture_status"].eqNullSafe("complete")),
        ("not_readable", ~m["quality"]["transcript_quality"].eqNullSafe("readable")),
        ("not_ready", ~(F.coalesce(r["ready_for_sorting"], F.lit(False)) & r["quality_status"].eqNullSafe("ready_for_整理"))),
        ("structural", ~structural["status"].eqNullSafe("pass")),
        ("content", ~F.coalesce(usable, F.lit(False))),
        ("missing_ranges", (F.size(r["missing_ranges"]) > 0) & (content["status"] != "usable_with_warnings")),
    )
    none = F.array().cast("array<string>")
    open_keys = F.array_compact(F.array(*[F.when(_unknown(m["source"][k]), F.lit(f"metadata_incomplete:{k}")) for k in ("title", "author")]))
    warnings = F.concat(F.coalesce(structural["warnings"], none), F.coalesce(content["warnings"], none), open_keys)
    return j.select(*ids, problem.alias("problem"), F.when(problem.isNull(), warnings).alias("warnings"))


def _unknown(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), "(?U)^\\s+|\\s+$", "")).isin(*UNKNOWN)


def completion(materials: DataFrame, latest: DataFrame, transcript_platforms: tuple[str, ...], transcript_kinds: tuple[str, ...]) -> DataFrame:
    """(material_id, revision_id, missing, state): what a capture still lacks, and capture_partial or capture_completed."""
    m, r, ids = F.col("material"), F.col("report"), ["material_id", "revision_id"]
    j = materials.select(m["material_id"].alias("material_id"), m["revision_id"].alias("revision_id"), "material").join(latest, ids, "left")
    media = F.exists(m["evidence"], lambda e: (e["kind"] == "source_media") & (F.coalesce(e["reference"], F.lit("")) != ""))
    expected = F.lower(m["source"]["platform"]).isin(*transcript_platforms) | F.coalesce(media, F.lit(False))
    had = F.coalesce(F.exists(m["evidence"], lambda e: F.lower(e["kind"]).isin(*transcript_kinds)), F.lit(False))
    ready = F.coalesce(r["ready_for_sorting"], F.lit(False))
    missing = F.array_compact(
        F.array(
            F.when(_unknown(m["source"]["title"]), "title"), F.when(_unknown(m["source"]["author"]), "author"),
            F.when(expected & ~had, "transcript"), F.when(expected & had & r.isNull(), "transcript_gate"), F.when(expected & had & r.isNotNull() & ~ready, "transcript_quality"),
        )
    )
    stuck = F.exists(missing, lambda x: x.startswith("transcript")) | (m["quality"]["capture_status"] == "partial")
    return j.select(*ids, missing.alias("missing"), F.when(stuck, "capture_partial").otherwise("capture_completed").alias("state"))


def ready_sources(materials: DataFrame, validations: DataFrame, json_col: str = "record") -> DataFrame:
    """Materials ready for derivation: passed validation (material_id, revision_id, status), complete, with a readable text
    in ``readable``, no temporary path."""
    m, ids = F.col("material"), ["material_id", "revision_id"]
    passed = validations.where("status = 'passed'").select(*ids).distinct()
    rows = materials.withColumns({c: m[c] for c in ids}).where((m["protocol"] == "source-material-v3") & (m["quality"]["capture_status"] == "complete"))
    rows = rows.where(~F.coalesce(m["quality"]["transcript_quality"].isin(*NOT_READY), F.lit(False)) & ~holds_temporary(F.col(json_col)))
    return rows.where(F.coalesce(F.col("readable"), F.lit("")).rlike("(?U)\\S")).join(passed, ids, "left_semi").drop(*ids)


def readable_problem(text: Column, quality: Column, source_type: Column, forbidden: str, transcript_types: tuple[str, ...]) -> Column:
    """First reason why a readable text can't be promoted. ``quality`` is a struct: protocol, status, source_type,
    readability, evidence_status and coverage (a map of numbers); ``forbidden`` is a pattern of headings."""
    cover, spoken = quality["coverage"], source_type.isin(*transcript_types)
    told = F.arrays_overlap(F.map_keys(cover), F.array(*map(F.lit, ("duration_seconds", "segment_count", "start_time", "end_time"))))
    return first_problem(
        ("empty", ~text.rlike("(?U)\\S") | text.isNull()),
        ("analysis", text.rlike(forbidden)),
        ("temporary", F.contains(text, F.lit("/tmp/"))),
        ("quality_result", ~(quality["protocol"].eqNullSafe("source-promotion-quality-v1") & quality["status"].eqNullSafe("passed"))),
        ("source_type", ~quality["source_type"].eqNullSafe(source_type)),
        ("readability", ~F.coalesce(quality["readability"].isin("ready", "minor_revision"), F.lit(False))),
        ("evidence", ~quality["evidence_status"].eqNullSafe("verified")),
        ("coverage", ~spoken & told),
        ("duration", spoken & (cover["duration_seconds"] <= 0)),
        ("segments", spoken & (cover["segment_count"] <= 0)),
    )


def read_records(spark, path: str, json_col: str = "record") -> DataFrame:
    """(path, record, problem) of JSON files read whole by Spark; ``problem`` is ``json`` where the root is no object."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(json_col))
    return rows.withColumn("problem", F.when(F.json_object_keys(json_col).isNull(), "json"))


def publishable(materials: DataFrame, manifests: DataFrame, scheme: str) -> DataFrame:
    """(material_id, revision_id, problem): the whole gate, records, manifests and their binding, one row a material."""
    sound, _ = materialise(check_materials(materials, scheme), "materials")
    good = check_manifests(manifests, scheme).where("problem is null")
    bound = bind(sound.where("problem is null"), good)
    failed = sound.where("problem is not null").select(F.col("material.material_id").alias("material_id"), F.col("material.revision_id").alias("revision_id"), "problem")
    return bound.unionByName(failed)
