"""Identities: pure functions of row content."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "si", "feature")
TEMPORARY = ("/tmp/", "/private/tmp/", "file:///tmp/", "file:///private/tmp/")
HEX64 = "[0-9a-f]{64}"


def _dumps(value: str | None, **options) -> str | None:
    return None if value is None else json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True, **options)


@F.pandas_udf(StringType())
def canonical_compact(values: pd.Series) -> pd.Series:
    """JSON text as compact JSON with sorted keys; nulls inside stay."""
    return values.map(lambda v: _dumps(v, separators=(",", ":")))


@F.pandas_udf(StringType())
def canonical_pretty(values: pd.Series) -> pd.Series:
    """JSON text as indented JSON with sorted keys and a final line feed."""
    return values.map(lambda v: None if v is None else _dumps(v, indent=2) + "\n")


def to_json(value: Column) -> Column:
    """A struct as JSON text with its null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def content_hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256))


def content_hash_or_missing(value: Column) -> Column:
    return F.coalesce(content_hash(value), F.lit("missing"))


def asset_id(hash_: Column) -> Column:
    return F.concat(F.lit("asset_sha256_"), F.substring_index(hash_, ":", -1))


def canonical_url(url: Column) -> Column:
    """A web address without fragment and tracking keys, host in lower case, query pairs sorted; null if it isn't one."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    netloc = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    plus = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, "\\+", "%20")), c)
    code = lambda c: F.regexp_replace(F.regexp_replace(F.url_encode(c), "\\*", "%2A"), "%7E", "~")
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(
            plus(F.substring_index(x, "=", 1)).alias("k"),
            F.when(F.instr(x, "=") > 0, plus(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise("").alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), netloc, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (netloc != ""), out)


def source_key(platform: Column, source_id: Column, url: Column) -> Column:
    """local:hash, platform:id, or the hash of the canonical address where the id is unknown."""
    p, i = F.lower(F.btrim(platform)), F.btrim(F.coalesce(source_id, F.lit("")))
    return (
        F.when(p == "", None)
        .when(p == "local", F.when(i.rlike(f"^sha256:{HEX64}\\z"), F.concat(F.lit("local:"), i)))
        .when(~i.isin("", "unknown", "none"), F.concat(p, F.lit(":"), i))
        .otherwise(F.concat(F.lit("url:"), content_hash(canonical_url(url))))
    )


def material_id(key: Column) -> Column:
    return F.concat(F.lit("material_sha256_"), F.sha2(key, 256))


def revision_id(record: Column) -> Column:
    """Of a source material struct: only facts count, evidence in the order of its ids; review state and times don't."""
    evidence = F.array_sort(
        F.transform(
            record["evidence"],
            lambda e: F.struct(
                e["evidence_id"].alias("evidence_id"), e["content_hash"].alias("content_hash"), e["end_time"].alias("end_time"), e["kind"].alias("kind"),
                e["start_time"].alias("start_time"), F.coalesce(e["uncertainty"], F.lit("")).alias("uncertainty"),
            ),
        )
    )
    s, c, q = record["source"], record["content"], record["quality"]
    parts = {
        "schema_version": to_json(F.array(record["schema_version"])),
        "material_id": to_json(F.array(record["material_id"])),
        "source": to_json(F.struct(*[s[k].alias(k) for k in ("platform", "source_id", "source_url", "title", "author")], F.coalesce(s["published_at"], F.lit("")).alias("published_at"))),
        "content": to_json(F.struct(c["raw"]["content_hash"].alias("raw_content_hash"), c["readable"]["content_hash"].alias("readable_content_hash"))),
        "evidence": to_json(evidence),
        "quality": to_json(F.struct(*[q[k].alias(k) for k in ("capture_status", "content_fidelity", "transcript_quality", "uncertainties")])),
    }
    # the parts are put together as text: a nested struct below a Python function has no name in this version of Spark
    value = lambda k, j: F.substring(j, F.lit(2), F.length(j) - 2) if k in ("schema_version", "material_id") else j
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.coalesce(value(k, j), F.lit("null"))) for k, j in parts.items()])
    facts = F.concat(F.lit("{"), body, F.lit("}"))
    return F.concat(F.lit("revision_sha256_"), F.sha2(canonical_compact(facts), 256))


def candidate_id(source: Column, source_revision: Column, target: Column, target_revision: Column, relation: Column) -> Column:
    """Of the ordered pair; paths and times don't count."""
    parts = F.concat_ws("|", source, source_revision, relation, target, target_revision)
    return F.concat(F.lit("relation_candidate_sha256_"), F.sha2(parts, 256))


def canonical_pair(left: Column, right: Column) -> Column:
    return F.struct(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))


def exception_id(problem: Column, relation: Column, source: Column, target: Column) -> Column:
    parts = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (problem, relation, source, target)])
    return F.concat(F.lit("relation_exception_sha256_"), F.sha2(parts, 256))


def hashed_record(prefix: str, record: Column, pretty: bool = True) -> Column:
    """Prefix and hash of a struct's canonical JSON: ids of relations, bundles, receipts, transactions, drafts."""
    text = canonical_pretty(to_json(record)) if pretty else canonical_compact(to_json(record))
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def body_identity(text: Column) -> Column:
    """(asset_id, snapshot revision, content hash) of a body."""
    h = F.sha2(text, 256)
    return F.struct(
        F.concat(F.lit("asset_sha256_"), h).alias("asset_id"), F.concat(F.lit("snapshot_sha256_"), h).alias("revision"), F.concat(F.lit("sha256:"), h).alias("content_hash")
    )


def chunk_identity(audio_hash: Column, size: Column, chunk_seconds: Column, codec: Column) -> Column:
    return F.sha2(F.concat_ws("|", audio_hash, size.cast("string"), chunk_seconds.cast("string"), codec), 256)


def reference(scheme: str, kind: Column, identity: Column) -> Column:
    """A stable reference of a kind."""
    return F.concat(F.lit(f"{scheme}://"), kind, F.lit("/"), identity)


def object_path(hash_: Column) -> Column:
    """Place of a content object: two hex digits as folder, then all of them."""
    h = F.substring_index(hash_, ":", -1)
    return F.concat(F.lit("objects/sha256/"), F.substring(h, 1, 2), F.lit("/"), h)


def manifest_entry(hash_: Column, role: Column, media_type: Column, size: Column, kind: Column, scheme: str) -> Column:
    a = asset_id(hash_)
    return F.struct(
        reference(scheme, kind, a).alias("reference"), a.alias("asset_id"), role.alias("role"), object_path(hash_).alias("storage_relative_path"),
        hash_.alias("content_hash"), media_type.alias("media_type"), size.cast("long").alias("size_bytes"),
    )


def operation_id(kind: Column) -> Column:
    """A new random id of an operation."""
    return F.concat(F.lit("op_"), kind, F.lit("_"), F.translate(F.uuid(), "-", ""))


def snapshot(candidates: Column, bundle: Column) -> Column:
    """Digest of a bundle with its candidates in the order of their ids: what an approval binds."""
    return hashed_record("approval_sha256_", F.struct(bundle.alias("bundle"), F.array_sort(candidates).alias("candidates")))


def is_temporary(value: Column) -> Column:
    out = F.lit(False)
    for prefix in TEMPORARY:
        out = out | value.startswith(prefix)
    return F.coalesce(out, F.lit(False))
