"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

A record is one text row, so archives are written, committed and retried like any Spark output, on any store that
Spark reaches. Reading splits the files at the record magic. Every piece may start a record: its header and length
name a successor offset. Payloads may hold the magic too, so a candidate counts only if the chain of successors from
the file's start reaches it. Chains are followed by pointer jumping: inside a block of a file every candidate finds
where its chain leaves the block, then those exits are joined and doubled, then each block keeps what its true entry
reaches. Pieces of a record whose payload held the magic are put together again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.runtime import discard, materialise, scratch_path

MAGIC = "WARC/1.1\r\n"
MIN_REVISIT = 100
#: Bytes of a record that one row of the span index covers.
SPAN = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def decide(pages: DataFrame) -> DataFrame:
    """(digest, refers_to): of each payload of at least 100 bytes that pages of different ids have, the smallest page_id.

    Only ids and digests are grouped, with partial sums, so a group's size never matters. A row with that payload and a
    larger page_id revisits it. Rows without a page_id, and rows that repeat the smallest one, are responses.
    """
    light = pages.where(F.col("page_id").isNotNull() & (F.octet_length(F.col("html")) >= MIN_REVISIT))
    light = light.select("page_id", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("digest"))
    ends = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top"))
    return ends.where("refers_to < top").select("digest", "refers_to")


def target_uri(url: Column) -> Column:
    """An address as one header value: printable ASCII as it is, all other characters percent-encoded as UTF-8."""
    one = lambda c: F.when(c.rlike("[\\x21-\\x7E]"), c).when(c == " ", "%20").otherwise(F.url_encode(c))
    return F.when(url.rlike("^[\\x21-\\x7E]*\\z"), url).otherwise(F.array_join(F.transform(F.split(url, ""), one), ""))


def write(pages: DataFrame, out: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record a row below ``out``: response records, and revisit records for payloads that another page has.

    A null payload is empty; a null or empty url has no Target-URI line, an odd one is percent-encoded so that it stays
    on one line. Rows that repeat a page_id are written each, decided by their own payload. Other columns are not read.
    """
    src = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    first, path = materialise(decide(src), "firsts", "zstd")  # its size decides how Spark joins it
    digest = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    rows = src.withColumn("digest", digest).join(first, "digest", "left")
    rows = rows.withColumn("refers_to", F.when((F.octet_length("html") >= MIN_REVISIT) & (F.col("page_id") > F.col("refers_to")), F.col("refers_to")))
    body = F.col("html").cast("binary")
    again = F.col("refers_to").isNotNull()
    uri = F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), target_uri(F.col("url")), F.lit("\r\n")))
    block = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    size = F.lit(len(_HTTP)) + F.when(again, 0).otherwise(F.octet_length(body))
    end = F.lit("\r\n")
    record = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"), end,
        F.lit("WARC-Record-ID: "), F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:>")), end,
        F.lit(f"WARC-Date: {date}\r\n"), F.coalesce(uri, F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex("digest")), end,
        F.lit("X-Payload-Length: "), F.octet_length(body).cast("string"), end,
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"),
        block, F.lit("\r\n\r"),
    )
    # the writer ends each row with a line feed, the last byte of a record
    rows.select(record.alias("value")).write.text(out)
    discard(rows.sparkSession, path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", f"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each candidate of a block, where its chain leaves the block: pointers double until none moves."""
    pdf = pdf.sort_values("start")
    start, after = pdf["start"].to_numpy(np.int64), pdf["after"].to_numpy(np.int64)
    n = len(start)
    at = np.minimum(np.searchsorted(start, after), n - 1)
    jump = np.where(start[at] == after, at, np.arange(n))
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            break
        jump = twice
    return pdf.assign(leaves=after[jump])[["file", "block", "start", "after", "leaves"]]


def _reached(candidates: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entries' chains visit."""
    if not len(candidates) or not len(entries):
        return pd.DataFrame({"file": [], "start": [], "after": []}).astype({"file": "object", "start": "int64", "after": "int64"})
    pdf = candidates.sort_values("start")
    start, after = pdf["start"].to_numpy(np.int64), pdf["after"].to_numpy(np.int64)
    place = {int(s): i for i, s in enumerate(start)}
    keep = np.zeros(len(start), bool)
    for e in entries["entry"]:
        i = place.get(int(e))
        while i is not None and not keep[i]:
            keep[i] = True
            i = place.get(int(after[i]))
    return pdf.loc[keep, ["file", "start", "after"]]


def _pieces(spark, out: str) -> DataFrame:
    """The pieces between magics with their place: file, block, order in the block."""
    raw = spark.read.option("lineSep", MAGIC).text(out)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("raw"),
    )


def read(spark, out: str) -> DataFrame:
    """The records of the archives below ``out`` that a chain from their file's start reaches.

    Columns: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``sound`` (whether the
    digest of the payload read equals the one noted; null for revisits). Bytes after a broken chain are not trusted.
    """
    paths = []

    def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        done, path = materialise(df, label, "zstd")
        paths.append(path)
        return done, path

    p = _pieces(spark, out)
    gap = F.instr(F.decode("raw", "ISO-8859-1"), "\r\n\r\n")
    # the header has no multi-byte text, so its end in characters of an 8-bit decoding is its end in bytes
    p = p.withColumn("gap", gap).withColumn("head", F.when(F.col("gap") > 0, F.decode(F.substring("raw", F.lit(1), F.col("gap") - 1), "ISO-8859-1")))
    size = _long(_field("Content-Length"))
    p = p.withColumns({"size": size, "length": F.octet_length("raw").cast("long")})
    http = F.lit(len(_HTTP))
    payload = F.substring("raw", F.col("gap") + 4 + http, (F.col("size") - http).cast("int"))
    whole = F.col("length") >= F.col("gap") + 3 + F.col("size")
    light = p.select(
        "file", "block", "seq", "length", "gap", "size",
        _field("WARC-Type").alias("record_type"), _long(F.regexp_extract("head", "WARC-Record-ID: <urn:page:([^>]*)>", 1)).alias("page_id"),
        _long(F.regexp_extract("head", "WARC-Refers-To: <urn:page:([^>]*)>", 1)).alias("refers_to"),
        F.regexp_extract("head", "WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("noted"), _long(_field("X-Payload-Length")).alias("noted_bytes"),
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
    )
    light, _ = keep(light, "candidates")
    # offsets: two prefix sums, over a file's blocks and within each block
    step = F.col("length") + len(MAGIC)
    blocks = light.groupBy("file", "block").agg(F.sum(step).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = light.withColumn("within", within).join(blocks.select("file", "block", ahead.alias("ahead")), ["file", "block"])
    start = F.col("ahead") + F.col("within") - len(MAGIC)
    placed = placed.withColumn("start", start).withColumn("after", F.col("start") + len(MAGIC) + F.col("gap") + 3 + F.col("size") + 4)
    placed, _ = keep(placed.drop("within", "ahead", "seq"), "placed")
    cand = placed.where("start >= 0 and gap > 0 and size >= 0 and record_type is not null").select("file", "block", "start", "after")
    kinds = "file string, block long, start long, after long, leaves long"
    chains, _ = keep(cand.groupBy("file", "block").applyInPandas(_chains, kinds), "chains")
    # between blocks: where the chain of an exit leaves its own block, doubled until no pointer moves
    hop = chains.select("file", "block", F.col("start").alias("entry"), F.col("leaves").alias("to"))
    used = chains.select("file", F.col("leaves").alias("entry")).distinct()
    hop = hop.join(used, ["file", "entry"], "left_semi").unionByName(hop.where("entry = 0")).distinct()
    hop, _ = keep(hop, "hops")
    reach = hop.where("entry = 0").select("file", "entry")
    jump = hop.select("file", "entry", "to")
    known = -1
    while True:
        reach, _ = keep(reach.unionByName(reach.join(jump, ["file", "entry"]).select("file", F.col("to").alias("entry"))).distinct(), "reach")
        now = reach.count()
        if now == known:
            break
        known = now
        second = jump.select("file", F.col("entry").alias("to"), F.col("to").alias("next"))
        jump, _ = keep(jump.join(second, ["file", "to"], "left").select("file", "entry", F.coalesce("next", "to").alias("to")), "jump")
    entries = hop.join(reach, ["file", "entry"], "left_semi").select("file", "block", "entry")
    true = cand.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(_reached, "file string, start long, after long")
    true, _ = keep(true, "true")
    records = placed.join(true.select("file", "start"), ["file", "start"], "left_semi")
    # records whose payload held the magic: their pieces lie between their start and their end
    broken = records.where("digest is null and record_type = 'response'").select("file", "start", "after", "gap", "size")
    broken, _ = keep(broken, "broken")
    if broken.head(1):
        spans = broken.withColumn("span", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("after") - 1) / SPAN))))
        spans = spans.select("file", "span", F.col("start").alias("owner"), "after", F.col("gap").alias("own_gap"), F.col("size").alias("own_size"))
        order = placed.select("file", "block", "start", "length").withColumn("span", F.floor(F.col("start") / SPAN))
        mine = order.join(spans, ["file", "span"]).where("start >= owner and start < after")
        files = broken.select("file").distinct()
        pieces = _pieces(spark, out).join(files, "file", "left_semi").withColumn("length", F.octet_length("raw").cast("long"))
        step = F.col("length") + len(MAGIC)
        totals = light.groupBy("file", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("n"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        within = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pieces = pieces.withColumn("within", within).join(totals.select("file", "block", ahead.alias("ahead")), ["file", "block"])
        pieces = pieces.withColumn("start", F.col("ahead") + F.col("within") - len(MAGIC)).select("file", "start", "raw")
        joined = mine.join(pieces, ["file", "start"]).groupBy("file", "owner", "own_gap", "own_size").agg(
            F.sort_array(F.collect_list(F.struct("start", "raw"))).alias("parts")
        )
        text = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1)["raw"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["raw"]))
        body = F.substring(F.col("text"), F.col("own_gap") + 4 + http, (F.col("own_size") - http).cast("int"))
        healed = joined.withColumn("text", text).select("file", F.col("owner").alias("start"), F.sha2(body, 256).alias("healed"))
        records = records.join(healed, ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "healed"))
    response = F.col("record_type") == "response"
    out_rows = records.select(
        "page_id",
        F.when(response, F.col("size") - http).otherwise(F.col("noted_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("noted")).alias("payload_digest"),
        "record_type", "refers_to",
        F.when(response, (F.col("digest") == F.col("noted")) & (F.col("size") - http == F.col("noted_bytes"))).alias("sound"),
    )
    done, _ = materialise(out_rows, "records", "zstd")
    for path in paths:
        discard(spark, path)
    return done


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and delete them."""
    spark = pages.sparkSession
    out = scratch_path(spark, "warc")
    write(pages, out)
    records = read(spark, out)
    discard(spark, out)
    return records
