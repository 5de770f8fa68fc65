"""Overlap of texts with a small set of reference texts by character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestra.functions import text as T
from attestra.runtime import bound_batches

#: Characters of reference texts up to which their shingles are broadcast (some 100 MB); beyond it texts are joined by shingles.
BROADCAST_CHARS = 2_000_000
#: Characters of texts that a task looks up at once.
CHARS = 500_000
#: No code point: stands behind a text that is shorter than a shingle.
_NONE = 0x1FFFFF


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first three characters, last two) of every shingle of five, repeated ones included; a shorter text is one."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    parts = [p if len(p) >= T.FIVE else np.concatenate([p, np.full(T.FIVE - len(p), _NONE, np.uint32)]) for p in parts]
    n = np.array([len(p) for p in parts], np.int64)
    c = np.concatenate(parts).astype(np.int64)
    last = np.cumsum(n)
    ok = np.ones(len(c), bool)
    for k in range(1, T.FIVE):
        ok[last - k] = False
    at = np.flatnonzero(ok)
    return np.repeat(np.arange(len(texts)), n - T.FIVE + 1), c[at] << 42 | c[at + 1] << 21 | c[at + 2], c[at + 3] << 21 | c[at + 4]


class References:
    """Distinct shingles of reference texts and the texts that hold each."""

    def __init__(self, items: list, texts: list[str]) -> None:
        self.items = items
        which, head, tail = _grams(texts)
        self.heads = np.unique(head)  # fewer than 2^21, as the characters are bounded
        key, self.which = np.unique(np.stack([np.searchsorted(self.heads, head) << 42 | tail, which]), axis=1)
        self.keys, self.first = np.unique(key, return_index=True)
        self.first = np.append(self.first, len(key))
        self.n = np.bincount(self.which, minlength=len(items))

    def find(self, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the given, place among the distinct shingles) of those that some reference text holds."""
        i = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        some = np.flatnonzero(self.heads[i] == head)
        key = i[some] << 42 | tail[some]
        j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[j] == key
        return some[hit], j[hit]

    def overlaps(self, texts: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, reference, shared) of the pairs that share ``least`` of the smaller set or more."""
        which, head, tail = _grams(texts)
        at, gram = self.find(head, tail)
        held = np.unique(which[at] * len(self.keys) + gram)
        text, gram = held // len(self.keys), held % len(self.keys)
        known = np.bincount(text, minlength=len(texts))  # a text has so many distinct shingles at least
        many = self.first[gram + 1] - self.first[gram]
        place = np.repeat(self.first[gram] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair, shared = np.unique(np.repeat(text, many) * len(self.n) + self.which[place], return_counts=True)
        text, item = pair // len(self.n), pair % len(self.n)
        may = shared / np.minimum(known[text], self.n[item]) >= least
        text, item, shared = text[may], item[may], shared[may]
        sizes = {k: len({texts[k][i : i + T.FIVE] for i in range(max(1, len(texts[k]) - T.FIVE + 1))}) for k in np.unique(text).tolist()}
        size = np.array([sizes[k] for k in text.tolist()], np.int64)
        ok = shared / np.minimum(size, self.n[item]) >= least
        return text[ok], item[ok], shared[ok]


def _look_up(references, least: float, columns: tuple[str, str], id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = references.value, [*columns, "shared"]
        for b in batches:
            texts, ids, held = b.column(1).to_pylist(), b.column(0), 0
            start = 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1])
                if held >= CHARS or end == len(texts):
                    text, item, shared = found.overlaps(texts[start:end], least)
                    items = pa.array([found.items[k] for k in item.tolist()], item_type)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + start)).cast(id_type), items, pa.array(shared, pa.int64())], names)
                    start, held = end, 0

    return run


def overlapping(docs: DataFrame, references: DataFrame, doc_id: str, item_id: str, text_col: str = "text", least: float = 0.58) -> DataFrame:
    """(doc_id, item_id, shared): texts that share ``least`` or more of the smaller set of distinct character shingles.

    Reference texts are few: their shingles are broadcast, and each document is looked up where it is read, so that
    neither its shingles nor the pairs below ``least`` are shuffled. Beyond BROADCAST_CHARS characters the shingles of
    both sides are joined instead. Null texts overlap with nothing.
    """
    spark = docs.sparkSession
    squeezed = lambda df, k: df.select(k, T.shingled(F.col(text_col)).alias("t")).where("t is not null")
    if (references.agg(F.sum(F.length(text_col))).first()[0] or 0) > BROADCAST_CHARS:
        one = lambda t, k: t.select(k, T.shingles(F.col(text_col)).alias("g")).select(k, F.size("g").alias(f"{k}_n"), F.explode("g").alias("g"))
        x = one(docs, doc_id).join(one(references, item_id), "g").groupBy(doc_id, item_id, f"{doc_id}_n", f"{item_id}_n").agg(F.count("*").alias("shared"))
        return x.where(F.col("shared") / F.least(f"{doc_id}_n", f"{item_id}_n") >= least).select(doc_id, item_id, "shared")
    rows = squeezed(references, item_id).collect()
    kinds = [df.schema[k].dataType for df, k in ((docs, doc_id), (references, item_id))]
    schema = f"{doc_id} {kinds[0].simpleString()}, {item_id} {kinds[1].simpleString()}, shared long"
    if not rows:
        return spark.createDataFrame([], schema)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(References([r[0] for r in rows], [r[1] for r in rows]))
    return squeezed(docs, doc_id).mapInArrow(_look_up(shared, least, (doc_id, item_id), *map(to_arrow_type, kinds)), schema)
