"""Phrases whose words keep company more than chance: counts from suffix arrays, scored by their worst cut.

Words of a language are numbered within a shard; numpy sorts the shard's suffixes by prefix doubling, and the intervals
of equal common prefixes are its distinct n-grams with their counts. Most n-grams of a corpus are rare, so shards first
send hashes and counts in packed blocks; a bucket adds them up and answers with one bit a key, set where the sum reaches
the least count. That never loses a phrase: a clash of hashes can only raise a sum. Then shards send the phrases whose
bit is set, in words, and Spark counts them exactly, so no result rests on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm import shards as S
from attestra.runtime import discard, materialise, small_batches

_BREAK = b"."
#: Letters to lower case, what ends a piece to the break, tabs to spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_SHARDS = "shard long, lang string, n_words long, vocabulary binary, words binary"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with a break wherever a piece ends."""
    return text.translate(_PLAIN).replace(_BREAK, b" . ").split()


def _cut(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[S.Ids, list[np.ndarray]]] = {}
        held: dict[str, int] = {}
        task, made = TaskContext.get().partitionId(), 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made
            ids, parts = open_.pop(lang)
            del held[lang]
            words = np.concatenate(parts)
            made += 1
            row = [(task << 32) + made, lang, int((words != 0).sum()), b" ".join(list(ids)[1:]), S.squeeze(words)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "lang", "n_words", "vocabulary", "words"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                if lang not in open_:
                    open_[lang], held[lang] = (S.Ids({_BREAK: 0}), []), 0
                ids, parts = open_[lang]
                found = words_of(text.as_py())
                found.append(_BREAK)
                parts.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                held[lang] += len(found)
                if held[lang] >= shard_words:
                    yield close(lang)
        for lang in list(open_):
            yield close(lang)

    return run


def suffix_array(words: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` words at least, by prefix doubling; the end ranks below all words."""
    rank, have = words.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while have < length:
        behind = np.zeros(len(rank), np.int64)
        behind[:-have] = rank[have:]
        key = rank * (int(rank.max(initial=0)) + 2) + behind
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(fresh)
        have *= 2
    return order


def intervals(words: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for n from 1 to ``length``: a place and the count of each distinct n-gram without a break (0)."""
    order = suffix_array(words, length)
    padded = np.concatenate([words, np.zeros(length, words.dtype)])
    same, whole = np.ones(len(order), bool), np.ones(len(order), bool)
    same[:1] = False
    for n in range(1, length + 1):
        column = padded[order + n - 1]
        same[1:] &= column[1:] == column[:-1]  # the common prefix with the suffix before has n words
        whole &= column != 0
        first = np.flatnonzero(~same)
        counts = np.diff(np.append(first, len(order)))
        keep = whole[first]
        yield n, order[first[keep]], counts[keep]


def _hashes(row: dict) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(row["lang"])
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in [_BREAK, *row["vocabulary"].split(b" ")]), np.uint64)


def _grams(row: dict, length: int):
    """Keys of a shard's n-grams, ascending, with n, place and count."""
    words, hashes = S.expand(row["words"], "<i4"), _hashes(row)
    padded = np.concatenate([words, np.zeros(length, words.dtype)])
    keys, ns, places, counts = [], [], [], []
    for n, place, count in intervals(words, length):
        state = np.full(len(place), n, np.uint64)
        for k in range(n):
            state = S.chain(state, hashes[padded[place + k]])
        for held, value in zip((keys, ns, places, counts), (state, np.full(len(place), n, np.int8), place, count), strict=True):
            held.append(value)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], *(np.concatenate(x)[order] for x in (ns, places, counts)), padded


_REQUEST = "bucket int, shard long, keys binary, counts binary"


def _send(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in S.one_by_one(batches):
            key, _, _, count, _ = _grams(row, length)
            cut = S.cut_points(key, buckets)
            for b in range(buckets):
                i, j = cut[b], cut[b + 1]
                if j > i:
                    block = [pa.array([b], pa.int32()), pa.array([row["shard"]], pa.int64()), pa.array([S.squeeze_sorted(key[i:j])], pa.binary()), pa.array([S.squeeze(count[i:j].astype("<u4"))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(block, ["bucket", "shard", "keys", "counts"])

    return run


def _often(least: int):
    def merge(group: pa.Table) -> tuple[list[bytes], int]:
        keys = [S.expand_sorted(k.as_py()) for k in group["keys"]]
        counts = [S.expand(c.as_py(), "<u4").astype(np.int64) for c in group["counts"]]
        total, place = S.sums(np.concatenate(keys), np.concatenate(counts))
        bits = (total >= least)[place]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return [np.packbits(x).tobytes() for x in np.split(bits, ends)], 0

    return merge


def _tell(length: int, buckets: int):
    """The phrases whose bit is set, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in S.one_by_one(batches):
            key, ns, places, counts, padded = _grams(row, length)
            cut = S.cut_points(key, buckets)
            sizes = [s for s in np.diff(cut) if s]
            bits = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=s) for r, s in zip(row["bits"] or [], sizes, strict=True)] or [np.zeros(0, np.uint8)])
            vocabulary = pa.array(["", *row["vocabulary"].decode().split(" ")], pa.string())
            for n in range(1, length + 1):
                chosen = np.flatnonzero((ns == n) & (bits == 1))
                for part in np.array_split(chosen, max(1, len(chosen) // 20_000)):
                    columns = [vocabulary.take(pa.array(padded[places[part] + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*columns, " ") if n > 1 else columns[0]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * m, pa.string()), pa.array(np.full(m, n), pa.int32()), phrase, pa.array(counts[part], pa.int64())], ["lang", "n", "phrase", "f"])

    return run


def frequent_phrases(docs: DataFrame, max_words: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang", shard_words: int = S.SHARD_WORDS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(lang, n, phrase, f) of all phrases of 1 to ``max_words`` words that occur ``least`` times or more, with exact counts;
    (lang, words) with all word occurrences of a language; the scratch paths that both read.

    Overlapping occurrences count, none crosses a piece's end. A null text is empty, a null language ``und``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with small_batches(spark, 500):
        parts, parts_path = materialise(rows.mapInArrow(_cut(shard_words), _SHARDS).where("n_words > 0"), "shards", "zstd")
    words = parts.groupBy("lang").agg(F.sum("n_words").alias("words"))
    total = parts.agg(F.sum(F.col("n_words") * max_words)).first()[0] or 0
    buckets = S.buckets_for(total)
    with small_batches(spark, 2):
        bits = S.answer(parts.mapInArrow(_send(max_words, buckets), _REQUEST), _often(least))
        bits, bits_path = materialise(bits, "often")
        told = S.with_replies(parts, {"bits": bits}).mapInArrow(_tell(max_words, buckets), "lang string, n int, phrase string, f long")
        grams = told.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        grams, grams_path = materialise(grams, "phrases", "zstd")
    discard(spark, bits_path)
    return grams, words, [parts_path, grams_path]


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, within: int = 50, text_col: str = "text", lang_col: str = "lang", shard_words: int = S.SHARD_WORDS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase that occurs a >= ``least`` times scores floor(10^6 a^2 / (l r)) at its worst cut into parts that occur l and
    r times. Phrases that lie inside a longer one with at least ``within`` percent of their count are left out. Numbers
    are exact (38 digits). Empty tables and texts give no row; repeated rows count as often as they occur.
    """
    grams, words, paths = frequent_phrases(docs, max_words, least, text_col, lang_col, shard_words)
    long_ones = grams.where("n >= 2")
    # a part occurs at least as often as the phrase, so it is among the grams
    cut = long_ones.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = grams.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"square": exact("a") * exact("a"), "parts": exact("l") * exact("r")})
    scored = scored.withColumn("score", F.expr("(square * 1000000BD) div parts"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    if max_words > 2:
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
        outer = grams.where("n >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
        worst = worst.join(outer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < within * F.col("a")))
    kept = worst.select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task ranks a whole language
    spread = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
    out, _ = materialise(out, "collocations")
    for path in paths:
        discard(docs.sparkSession, path)
    return out
