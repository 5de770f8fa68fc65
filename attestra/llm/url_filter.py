"""URL rules kept as a sorted array of 64-bit digests.

The index is one flat file: digests in ascending order, the ends of the stored rule strings, and their bytes. Tasks map
it into memory, probe all candidate strings of a batch with one binary search, and compare the stored string of every
hit, so a collision of digests can't decide a url. A string is a host, a slash, which no host holds, and a path, so that
hosts and paths stay apart. Lists up to a stated size travel to every executor once, by way of the shared folder; larger
ones are cut into shards by digest and meet the distinct candidate strings there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.runtime import bound_batches, discard, materialise, put, scratch_path

#: Bytes of an index that is copied to every executor; above it the shards are used.
MAX_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
#: Rows of candidate strings that one task of a shard probes at most, on average.
SHARD_PROBES = 2_000_000


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without one."""
    at = F.instr(url, "://")
    found = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    ascii_lower = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, ascii_lower).otherwise("")


def path(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)).otherwise("")


@dataclass(frozen=True)
class Shape:
    """What bounds the candidates of a url: the numbers of host labels and the lengths of paths that rules have."""

    labels: tuple[int, ...]
    paths: tuple[int, ...]


def digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"), 42)


def build_index(rules: dict[str, str]) -> bytes:
    """Number of rules, sorted digests, ends and text as one piece of bytes; a rule's last byte is its verdict."""
    rows = sorted((digest(r), r) for r in rules)
    text = [r.encode("utf-8", "surrogatepass") + rules[r][:1].encode() for _, r in rows]
    keys, ends = np.array([d for d, _ in rows], "<u8"), np.cumsum([len(t) for t in text], dtype="<i8")
    return b"".join([np.array([len(rows)], "<i8").tobytes(), keys.tobytes(), ends.astype("<i8").tobytes(), *text])


class Index:
    """The file mapped into memory."""

    def __init__(self, where: str) -> None:
        data = np.memmap(where, np.uint8, "r")
        n = int(data[:8].view("<i8")[0])
        self.keys, self.ends, self.text = data[8 : 8 + 8 * n].view("<u8"), data[8 + 8 * n : 8 + 16 * n].view("<i8"), data[8 + 16 * n :]

    def lookup(self, strings: list[str]) -> list[str | None]:
        """The stored verdict (a or b) of each string, None for those that aren't stored."""
        out: list[str | None] = [None] * len(strings)
        probes = np.fromiter(map(digest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, probes)
        ok = at < len(self.keys)
        hit = np.flatnonzero(ok & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == probes)) if len(self.keys) else []
        for i in hit:
            j, want = int(at[i]), strings[i].encode("utf-8", "surrogatepass")
            while j < len(self.keys) and self.keys[j] == probes[i]:
                stored = bytes(self.text[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])])
                if stored[:-1] == want:
                    out[i] = stored[-1:].decode()
                    break
                j += 1
        return out


def candidates(hosts: list[str], paths: list[str], shape: Shape) -> tuple[list[int], list[str]]:
    """(row, string) of everything that a rule which fits a url could be."""
    rows, strings = [], []
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if not h:
            continue
        cut = h.split(".")
        ends = [".".join(cut[-k:]) for k in shape.labels if k <= len(cut)]
        heads = [p[:k] for k in shape.paths if k <= len(p)]
        for e in ends:
            for q in heads:
                rows.append(i)
                strings.append(f"{e}/{q}")
    return rows, strings


_VERDICTS = {"a": "allow", "b": "block"}


def _probe(name: str, shape: Shape, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            index = index or Index(SparkFiles.get(name))
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            rows, strings = candidates(hosts, paths, shape)
            rule: list[str | None] = [None] * b.num_rows
            verdict = [default] * b.num_rows
            for i, s, v in zip(rows, strings, index.lookup(strings), strict=True):
                s = s.replace("/", "", 1)
                if v and (rule[i] is None or (len(s), rule[i]) > (len(rule[i]), s)):
                    rule[i], verdict[i] = s, _VERDICTS[v]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return run


def _explode(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, strings = candidates(b.column("host").to_pylist(), b.column("path").to_pylist(), shape)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(rows, pa.int64())), pa.array(strings, pa.string())], ["row", "string"])

    return run


def _shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"string": [], "verdict": []}, dtype="object")
    with tempfile.TemporaryDirectory() as d:  # the task's own; gone when it ends
        with open(f"{d}/index", "wb") as f:
            f.write(build_index(dict(zip(right["rule"], right["verdict"], strict=True))))
        strings = left["string"].tolist()
        got = Index(f"{d}/index").lookup(strings)
    return pd.DataFrame([(s, v) for s, v in zip(strings, got, strict=True) if v], columns=["string", "verdict"])


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row a url: ``id``, ``host``, ``path``, ``rule`` (host and path of the longest rule that fits, or null), ``verdict``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest string wins, ties go to the smaller string. Of rules stored twice block
    wins; a rule without a host or verdict is none. No rule: ``default``. Null urls and urls without :// have an empty host and path and fit nothing. Repeated
    rows are judged each; other columns are not read; an empty list gives ``default`` everywhere.
    """
    spark = pages.sparkSession
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stored = rules.where("host <> '' and verdict is not null").where(~F.col("host").rlike("[/?#]"))  # no url has such a host
    stored = stored.select(low.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    stored = stored.groupBy(F.concat_ws("/", "host", "path").alias("rule")).agg(
        F.max(F.substring("verdict", 1, 1)).alias("verdict"), F.first("host").alias("host"), F.max(F.length("path")).alias("k")
    )
    stored, stored_path = materialise(stored, "rules")
    facts = stored.agg(
        F.collect_set(F.size(F.split("host", "\\."))), F.collect_set("k"), F.coalesce(F.sum(F.octet_length("rule") + 24), F.lit(0))
    ).first()
    shape = Shape(tuple(sorted(facts[0])), tuple(sorted(facts[1])))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.select("id", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.coalesce(path(F.col("url")), F.lit("")).alias("path"))
    kind = dict(urls.dtypes)["id"]
    bound_batches(spark, 2000)
    if facts[2] <= max_bytes:
        where = scratch_path(spark, "rules")
        put(spark, where, build_index({r["rule"]: r["verdict"] for r in stored.collect()}))  # at most max_bytes
        discard(spark, stored_path)
        spark.sparkContext.addFile(where)
        return urls.mapInArrow(_probe(where.rsplit("/", 1)[-1], shape, default), f"id {kind}, host string, path string, rule string, verdict string")
    urls, _ = materialise(urls.withColumn("row", F.monotonically_increasing_id()), "urls", "zstd")
    probes, probes_path = materialise(urls.mapInArrow(_explode(shape), "row long, string string"), "probes", "zstd")
    distinct = probes.select("string").distinct()
    shards = max(1, -(-facts[2] // SHARD_BYTES))
    salts = max(1, -(-probes.count() // (SHARD_PROBES * shards)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    left = distinct.select(place("string"), F.pmod(F.hash("string"), F.lit(salts)).alias("salt"), "string")
    right = stored.select(place("rule"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "rule", "verdict")
    hits = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(_shard, "string string, verdict string")
    rule = F.regexp_replace("string", "^([^/]*)/", "$1")
    best = probes.join(hits, "string").groupBy("row").agg(
        F.min_by(F.struct(rule.alias("rule"), "verdict"), F.struct(-F.length("string"), rule)).alias("best")
    )
    long = F.when(F.col("best.verdict") == "b", "block").when(F.col("best.verdict") == "a", "allow").otherwise(default)
    done, _ = materialise(urls.join(best, "row", "left").select("id", "host", "path", F.col("best.rule").alias("rule"), long.alias("verdict")), "judged", "zstd")
    for used in (stored_path, probes_path):
        discard(spark, used)
    return done
