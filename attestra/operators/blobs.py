"""Stored objects named by manifests: their bytes, the readable text they hold and the time index of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import paths
from attestra.operators.manifests import first_problem

#: Folders up to which only those that entries name are listed.
MOST_FOLDERS = 1000
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def references(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """``wanted`` (material_id, revision_id, reference) with the entry it names and ``problem``: a reference must name
    exactly one entry of its manifest, else ``reference_missing`` or ``reference_repeated``. Other columns stay."""
    keys = ["material_id", "revision_id", "reference"]
    held = entries.groupBy(*keys).agg(F.count("*").alias("held"), F.any_value(F.struct("storage_relative_path", "content_hash", "media_type")).alias("entry"))
    out = wanted.join(held, keys, "left")
    problem = first_problem(("reference_missing", F.col("held").isNull()), ("reference_repeated", F.col("held") > 1))
    return out.withColumn("problem", problem).withColumn("entry", F.when(F.col("problem").isNull(), F.col("entry"))).drop("held")


def read_objects(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (columns ``entry`` and ``problem``, see ``references``) with ``data``, the bytes of the object.

    A path that leaves the root is never opened (``escapes_root``); others are read by Spark in the folders that the
    entries name, or, where these are more than a thousand, in all folders below the root. ``object_missing`` and
    ``hash_mismatch`` (the bytes are not those of the entry's sha256) are problems, too; data is null with any of them.
    """
    base = F.regexp_replace(F.lit(root), _SCHEME, "")
    asked = wanted.withColumn("at", paths.join(paths.normalise(base), F.col("entry.storage_relative_path")))
    escapes = F.col("entry").isNotNull() & ~paths.inside(F.col("at"), paths.normalise(base))
    asked = asked.withColumn("problem", F.coalesce("problem", F.when(escapes, "escapes_root"))).withColumn("at", F.when(F.col("problem").isNull(), F.col("at")))
    folders = [r[0] for r in asked.where("at is not null").select(F.regexp_extract("at", "^(.*)/", 1)).distinct().limit(MOST_FOLDERS + 1).collect()]
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if len(folders) > MOST_FOLDERS:
        folders = [str(where.toUri().getPath())]
    folders = [f for f in folders if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f or "/"))]
    if folders:
        qualified = [store.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f or "/")).toString() for f in folders]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(qualified)
        files = files.select(F.regexp_replace("path", _SCHEME, "").alias("at"), F.col("content").alias("data")).dropDuplicates(["at"])
        out = asked.join(files, "at", "left")
    else:
        out = asked.withColumn("data", F.lit(None).cast("binary"))
    told = F.concat(F.lit("sha256:"), F.sha2("data", 256))
    problem = first_problem(("object_missing", F.col("at").isNotNull() & F.col("data").isNull()), ("hash_mismatch", F.col("data").isNotNull() & ~told.eqNullSafe(F.col("entry.content_hash"))))
    out = out.withColumn("problem", F.coalesce("problem", problem)).withColumn("data", F.when(F.col("problem").isNull(), F.col("data")))
    return out.drop("at")


def _text(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def readable_text(data: Column, media_type: Column, inline: Column | None = None) -> Column:
    """A readable text: the inline one, else the first filled of text, readable_text and content of a JSON object if it
    is a string, else all bytes as UTF-8; white space around it goes, what is no UTF-8 becomes the replacement character."""
    raw = _text(data)
    value = F.try_parse_json(raw)

    def part(name: str) -> Column:
        held = F.try_variant_get(value, f"$.{name}", "variant")
        kind, text = F.schema_of_variant(held), F.try_variant_get(value, f"$.{name}", "string")
        filled = F.when(kind == "STRING", text != "").when(kind == "VOID", False).otherwise(~F.coalesce(text, F.lit("-")).isin("0", "0.0", "false", "[]", "{}"))
        return F.when(held.isNotNull() & F.coalesce(filled, F.lit(True)), F.struct(kind.alias("kind"), text.alias("text")))

    first = F.coalesce(*[part(n) for n in ("text", "readable_text", "content")])
    is_json = F.contains(F.lower(F.coalesce(media_type, F.lit(""))), F.lit("json")) & F.schema_of_variant(value).startswith("OBJECT")
    stored = F.when(F.coalesce(is_json, F.lit(False)) & (first["kind"] == "STRING"), first["text"]).otherwise(raw)
    return _strip(stored if inline is None else F.coalesce(inline, stored))


def time_index(objects: DataFrame, keys: tuple[str, ...] = ("material_id", "revision_id")) -> DataFrame:
    """(keys, pos, start, end, text): the segments of JSON objects (``data``, ``media_type``) that hold a text, in order.

    What is no JSON object with an array ``segments`` gives no row; timestamps are preferred to times, white space
    inside a text is one space.
    """
    raw = _text(F.col("data"))
    json = F.contains(F.lower(F.coalesce(F.col("media_type"), F.lit(""))), F.lit("json"))
    rows = objects.where(json & F.col("data").isNotNull()).select(*keys, F.from_json(raw, "segments array<string>").alias("held"))
    item = rows.select(*keys, F.posexplode("held.segments").alias("pos", "item"))
    get = lambda name: F.get_json_object("item", f"$.{name}")
    text = _strip(F.regexp_replace(get("text"), "(?U)\\s+", " "))
    out = item.select(*keys, "pos", F.coalesce(get("start_timestamp"), get("start_time"), F.lit("")).alias("start"), F.coalesce(get("end_timestamp"), get("end_time"), F.lit("")).alias("end"), text.alias("text"))
    return out.where("text <> ''")
