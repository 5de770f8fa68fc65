"""Word shards, and exchanges of packed blocks between shards and buckets of keys.

A shard is a row that holds the words of some documents as numbers. Statistics of n-grams that most shards meet once or
twice would be as many rows as there are words, so a shard sends sorted arrays instead: one compressed block a bucket of
keys. Spark shuffles the blocks by bucket, a task adds up the blocks of one bucket, and every block gets an answer of the
same length, which Spark brings back to its shard. Shards and buckets hold about as many words at every size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shard, and keys of a bucket, at most about.
SHARD_WORDS = 1_000_000
BUCKET_KEYS = 1_250_000

_ODD1, _ODD2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _ODD1
    x = (x ^ (x >> np.uint64(27))) * _ODD2
    return x ^ (x >> np.uint64(31))


def chain(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its start and the hash of one more word."""
    return mix(state * _GOLD + word)


def word_hashes(joined: bytes) -> np.ndarray:
    """Hashes of words that are joined by single spaces, eight bytes of all words of a length at a time; no words give none.

    Different words of equally many bytes, eight at most, have different hashes.
    """
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts
    out, data = np.zeros(len(sizes), np.uint64), np.append(data, np.zeros(8, np.uint8))
    steps = (sizes + 7) // 8
    for k in np.unique(steps):
        of = np.flatnonzero(steps == k)
        state = mix(sizes[of].astype(np.uint64) + _GOLD)
        for j in range(int(k)):
            at = starts[of] + 8 * j
            block = np.ascontiguousarray(data[np.minimum(at[:, None] + np.arange(8), len(data) - 1)]).view("<u8").reshape(-1)
            spare = np.clip(8 * j + 8 - sizes[of], 0, 8).astype(np.uint64) * np.uint64(8)  # bits beyond the word's end
            kept = np.where(spare < 64, np.uint64(2**64 - 1) >> (spare & np.uint64(63)), np.uint64(0))
            state = chain(state, block & kept)
        out[of] = state
    return out


def squeeze(a: np.ndarray) -> bytes:
    """An array as bytes, those of equal weight side by side, compressed."""
    if not len(a):
        return b""
    columns = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
    planes = np.empty((a.itemsize, len(a)), np.uint8)
    for j in range(a.itemsize):  # several times faster than a transposed copy
        planes[j] = columns[:, j]
    return zstandard.ZstdCompressor(level=1).compress(planes.data)


def expand(data: bytes, kind: str) -> np.ndarray:
    """The array that ``squeeze`` was given."""
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    columns = np.empty(planes.shape[::-1], np.uint8)
    for j, plane in enumerate(planes):
        columns[:, j] = plane
    return columns.view(kind).reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences."""
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "<u8"), dtype=np.uint64)


def cut_points(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin among ascending keys, and their end; bucket b holds the b-th of equal ranges of keys."""
    starts = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]]).astype(np.int64)


def buckets_for(words: int) -> int:
    return max(1, -(-words // BUCKET_KEYS))


class Ids(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the values of equal keys, and for each key the place of its sum."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(values[order], first) if len(first) else np.zeros(0, values.dtype)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(keys)]])))
    return total, place


def ascending(x: np.ndarray, width: int = 64) -> np.ndarray:
    """Places of unsigned numbers of ``width`` bits in ascending order.

    Numbers sort several times faster than their places, so each place rides in the low bits of its number. Where both
    don't fit, the number's high bits do, and the result is looked over.
    """
    bits = max(len(x).bit_length(), 1)
    place, low = np.arange(len(x), dtype=np.uint64), np.uint64(bits)
    key = np.sort((x << low if width + bits <= 64 else x >> low << low) | place)
    order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    if width + bits > 64 and (x[order][1:] < x[order][:-1]).any():
        return np.argsort(x, kind="stable")
    return order


def ranks(x: np.ndarray, width: int = 64) -> np.ndarray:
    """Each number's rank among the different ones, from 0."""
    order = ascending(x, width)
    out = np.empty(len(x), np.uint64)
    sorted_x = x[order]
    out[order] = np.cumsum(np.append(False, sorted_x[1:] != sorted_x[:-1])[: len(x)])
    return out


def ascending_pairs(a: np.ndarray, b: np.ndarray, major: np.ndarray | None = None) -> np.ndarray:
    """Places of pairs by the first, then by the second; ``b`` holds small numbers such as ranks. ``major``: ranks of ``a``, if known."""
    if not len(a):
        return np.zeros(0, np.int64)
    major, width = ranks(a) if major is None else major, int(b.max()).bit_length()
    wide = int(major.max()).bit_length() + width
    if wide > 64:
        return np.lexsort((b, a))
    return ascending(major << np.uint64(width) | b, wide) if wide + len(a).bit_length() <= 64 else np.argsort(major << np.uint64(width) | b, kind="stable")


REPLY = "shard long, bucket int, reply binary, found long"


def answer(requests: DataFrame, merge) -> DataFrame:
    """Bring the blocks of each bucket together and answer each.

    ``merge`` takes the table of one bucket's blocks and returns a reply (bytes) for each and one number for the bucket,
    which stands in ``found`` of its first reply. A bucket holds about BUCKET_KEYS keys, whatever the input's size.
    """

    def run(group: pa.Table) -> pa.Table:
        replies, found = merge(group)
        numbers = [found] + [0] * (group.num_rows - 1)
        return pa.table({"shard": group["shard"], "bucket": group["bucket"], "reply": pa.array(replies, pa.binary()), "found": pa.array(numbers, pa.int64())})

    return requests.groupBy("bucket").applyInArrow(run, REPLY)


def with_replies(shards: DataFrame, replies: dict[str, DataFrame]) -> DataFrame:
    """Shards with an array column of replies (one a bucket, in order) for each name; a null one without any reply."""
    for name, df in replies.items():
        parts = df.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias("r"))  # one a bucket
        shards = shards.join(parts.select("shard", F.col("r.reply").alias(name)), "shard", "left")
    return shards


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
