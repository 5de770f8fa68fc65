"""File sources: vaults of Markdown, JSON logs, blobs; and small driver-side sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.functions import text as T

# Fixed values that results depend on.
DIRECTORIES = {"10 原始资料": "source", "20 学习笔记": "knowledge", "30 情报简报": "intelligence", "40 方法库": "method", "50 输出成果": "creation"}
ELIGIBLE = ("formal", "confirmed", "published", "active")


def scan_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, raw, length) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.url_decode(F.regexp_replace("path", "\\+", "%2B"))
    return files.select(path.alias("path"), F.col("content").alias("raw"), "length")


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """Assets of the five scanned folders: identity, revision, class, title, front matter, sections, eligibility and reason."""
    present = [d for d in DIRECTORIES if os.path.isdir(f"{root}/{d}")] if os.path.isdir(root) else list(DIRECTORIES)
    parts = [scan_files(spark, f"{root}/{d}").withColumn("asset_class", F.lit(DIRECTORIES[d])) for d in present]
    if not parts:
        return assets(spark.createDataFrame([], "path string, raw binary, asset_class string"))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    return assets(files)


def assets(files: DataFrame) -> DataFrame:
    """Rows (path, raw, asset_class) as assets; a ladder of reasons tells why one isn't eligible."""
    text = F.decode("raw", "UTF-8")
    df = files.withColumns({"text": text, "file_hash": I.content_hash(F.col("raw"))})
    df = df.withColumns({"frontmatter": T.frontmatter(F.col("text")), "body": T.body(F.col("text")), "file": F.substring_index("path", "/", -1)})
    fm = F.col("frontmatter")
    df = df.withColumn("states", T.states(fm))
    kind = F.lower(F.coalesce(fm["type"], F.lit("")))
    hold = F.exists("states", lambda s: s.rlike("waiting|draft|candidate"))
    is_source = F.col("asset_class") == "source"
    empty = F.lit("")
    material, revision, asset = (F.coalesce(fm[k], empty) for k in ("material_id", "revision_id", "asset_id"))
    rev_ok = revision.rlike(f"^revision_sha256_{I.HEX64}\\z")
    source_ok = material.rlike(f"^material_sha256_{I.HEX64}\\z") & rev_ok
    asset_ok = asset.rlike(f"^asset_sha256_{I.HEX64}\\z")
    reason = (
        F.when(F.contains(F.lower("file"), F.lit("draft")) | F.contains(F.col("file"), F.lit("草稿")) | F.contains(kind, F.lit("draft")), "draft_excluded")
        .when(hold, "non_formal_state")
        .when(F.coalesce(fm["cleanup_candidate"] == "true", F.lit(False)), "cleanup_candidate_projection")
        .when(~F.exists("states", lambda s: s.isin(*ELIGIBLE)), "formal_state_missing")
        .when(is_source & ~source_ok, "stable_source_identity_missing")
        .when(~is_source & ~asset_ok, "stable_asset_identity_missing")
        .otherwise("")
    )
    snapshot = F.concat(F.lit("snapshot_sha256_"), F.substring_index("file_hash", ":", -1))
    return df.select(
        F.when(is_source & source_ok, material).when(~is_source & asset_ok, asset).otherwise("").alias("asset_id"),
        F.when(is_source & source_ok, revision).when(~is_source & asset_ok, F.when(rev_ok, revision).otherwise(snapshot)).otherwise("").alias("revision"),
        "asset_class", F.coalesce(fm["type"], empty).alias("type"), T.title(F.col("body"), F.regexp_replace("file", "\\.md$", "")).alias("title"),
        "path", "file_hash", "frontmatter", T.sections(F.col("body")).alias("sections"), "body", "text", (reason == "").alias("eligible"), reason.alias("exclusion_reason"),
    ).orderBy("path")


def operation_log(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Operation files of all months with a month column; unreadable ones keep their text in _corrupt_record."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/[0-9][0-9][0-9][0-9]-[0-9][0-9]/op_*.json")
    return raw.withColumn("month", F.regexp_extract("_metadata.file_path", "/(\\d{4}-\\d{2})/op_", 1))


def manual_links(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, line, text, managed) of the lines that hold a link; managed if they name a candidate of the registry."""
    lines = files.select("path", F.posexplode(F.split("text", "\\n")).alias("pos", "line_text")).where(F.contains("line_text", F.lit("[[")))
    ids = F.regexp_extract_all("line_text", F.lit(f"relation_candidate_sha256_{I.HEX64}"), F.lit(0))
    named = lines.withColumn("candidate_id", F.explode_outer(ids))
    known = registry.select("candidate_id", F.lit(True).alias("known")).distinct()
    j = named.join(known, "candidate_id", "left").groupBy("path", "pos", "line_text").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("managed"))
    return j.select("path", (F.col("pos") + 1).alias("line"), F.btrim("line_text").alias("text"), "managed")


def safety_scan(files: DataFrame, categories: dict[str, str], max_bytes: int = 1_000_000) -> DataFrame:
    """Distinct (path, category): patterns found in a file's text, files too large, files that aren't UTF-8."""
    text = F.col("raw").cast("string")
    bad = ~F.is_valid_utf8(text)
    found = F.array_compact(F.array(*[F.when(text.rlike(p), c) for c, p in categories.items()], F.when(F.length("raw") > max_bytes, "oversized"), F.when(bad, "not_utf8")))
    return files.select("path", F.explode(found).alias("category")).distinct()


def atomic_write(path: str, value: bytes) -> None:
    """One driver-side file, written beside its place, flushed, then renamed over it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.tmp-{os.getpid()}"
    with open(beside, "wb") as f:
        f.write(value)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def atomic_json(path: str, value: object) -> None:
    atomic_write(path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def put_object(root: str, value: bytes) -> str:
    """A content object at the place its hash names; the same bytes again change nothing, other bytes there are an error."""
    import hashlib

    digest = hashlib.sha256(value).hexdigest()
    path = f"{root}/objects/sha256/{digest[:2]}/{digest}"
    if os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.sha256(f.read()).hexdigest() != digest:
                raise ValueError(f"object differs from its name: {path}")
    else:
        atomic_write(path, value)
    return f"sha256:{digest}"


def load_json(path: str) -> dict:
    """A small JSON document on the driver; its root must be an object."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"JSON object required: {path}")
    return value


def load_collection(spark: SparkSession, path: str, protocol: str, collection: str, schema: str) -> DataFrame:
    """The rows of a persisted pool, queue or registry; no file gives no rows, another protocol or no list is an error."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    whole = spark.read.schema(f"protocol string, {collection} array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in schema.split(', '))}>>").option("multiLine", True).json(path)
    head = whole.select("protocol", F.col(collection).isNotNull().alias("listed")).limit(2).collect()  # one row a file
    if len(head) != 1 or head[0]["protocol"] != protocol or not head[0]["listed"]:
        raise ValueError(f"{protocol} is required")
    return whole.select(F.inline(collection))
