"""Concatenate and cut: documents laid end to end as one token stream, cut into fixed windows.

Pass one tokenises each document once, stores its ids in two bytes where they fit, and counts tokens. The totals of the
partitions, one small row each, become global offsets by a prefix sum. Pass two reads the stored ids and cuts at every
multiple of the window. Nothing is gathered: a document's place follows from its partition's offset and its own within.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.tokens import default_vocabulary, encoder, ids_of
from attestra.runtime import bound_batches, materialise

_TOKENS = "id long, part long, at long, n long, wide boolean, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_DIGESTS = _PIECES.replace("ids binary", "ids_crc32 long")


def _tokenise(path: str, end: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path, added), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = b.slice(lo, 500)
                ats, ns, wides, packed = [], [], [], []
                for text in rows.column("text"):
                    ids = ids_of(encode, text.as_py(), end)
                    wide = bool(ids.max() > 0xFFFF)
                    ats.append(at)
                    ns.append(len(ids))
                    wides.append(wide)
                    packed.append((ids if wide else ids.astype("<u2")).tobytes())
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), pa.array([part] * len(ns), pa.int64()), pa.array(ats, pa.int64()),
                        pa.array(ns, pa.int64()), pa.array(wides, pa.bool_()), pa.array(packed, pa.binary()),
                    ],
                    ["id", "part", "at", "n", "wide", "ids"],
                )

    return run


def _cut(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                yield _pieces(b.slice(lo, 500), window, digest)

    return run


def _pieces(rows: pa.RecordBatch, window: int, digest: bool) -> pa.RecordBatch:
    n = rows.column("n").to_numpy()
    begin = rows.column("begin").to_numpy()
    first, last = begin // window, (begin + n - 1) // window
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(seq * window, begin[row]) - begin[row]
    stop = np.minimum((seq + 1) * window, begin[row] + n[row]) - begin[row]
    offset = begin[row] + start - seq * window
    wides = rows.column("wide").to_pylist()
    ids = [np.frombuffer(v.as_buffer(), "<u4" if w else "<u2").astype("<u4", copy=False).tobytes() for v, w in zip(rows.column("ids"), wides, strict=True)]
    cuts = [memoryview(ids[r])[4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
    value = pa.array([zlib.crc32(c) for c in cuts], pa.int64()) if digest else pa.array([bytes(c) for c in cuts], pa.binary())
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"]
    numbers = [pa.array(x, pa.int64()) for x in (start, stop - start, n[row], seq, offset)]
    return pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(row)), *numbers, value], names)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    vocabulary: str | None = None,
    end: int = 0,
    digest: bool = False,
    added: bool = True,
) -> DataFrame:
    """One row a piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    ``ids`` is the piece's ids as little-endian unsigned 32-bit integers; with ``digest`` it is ``ids_crc32`` instead.
    A text's literal added tokens give their own ids, as by default in the vocabulary file's tokenizer; without ``added``
    they are ordinary text.
    The documents keep the order in which the table's partitions hold them. Null and empty texts give the end id alone;
    rows that repeat are packed as often as they come; a null id stays null. Only the last sequence can be short, so
    padding is below one window. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored, _ = materialise(src.mapInArrow(_tokenise(path, end, added), _TOKENS), "tokens", "zstd")
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row (16 bytes) a partition of the input: a million partitions make 16 MB
    placed = stored.join(F.broadcast(bases), "part").select("id", (F.col("base") + F.col("at")).alias("begin"), "n", "wide", "ids")
    return placed.mapInArrow(_cut(window, digest), _DIGESTS if digest else _PIECES)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring pieces of one sequence within a task become one row."""
    for b in batches:
        rows = sorted(zip(b.column("sequence_id").to_pylist(), b.column("offset").to_pylist(), b.column("ids").to_pylist(), strict=True))
        out: list[list] = []
        for seq, off, ids in rows:
            if out and out[-1][0] == seq and out[-1][1] + len(out[-1][2]) // 4 == off:
                out[-1][2] += ids
            else:
                out.append([seq, off, bytearray(ids)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([bytes(r[2]) for r in out], pa.binary())],
            ["sequence_id", "offset", "ids"],
        )


def sequences(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """Whole sequences (``sequence_id``, ``ids``, ``length``) of the pieces of ``pack``.

    A task hands on the windows that lie wholly inside its rows as they are; only boundary records, the parts of
    windows that cross tasks, are shuffled and joined. A window holds at most ``window`` ids, so no group grows. No
    pieces give no rows; pieces that repeat whole are not expected, as ``pack`` makes none.
    """
    bound_batches(pieces.sparkSession)
    runs, _ = materialise(pieces.select("sequence_id", "offset", "ids").mapInArrow(_assemble, "sequence_id long, offset long, ids binary"), "runs", "zstd")
    whole = runs.where(F.octet_length("ids") == 4 * window).select("sequence_id", "ids")
    edges = runs.where(F.octet_length("ids") < 4 * window).groupBy("sequence_id")
    joined = edges.agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.unionByName(joined.select("sequence_id", text.alias("ids"))).withColumn("length", (F.octet_length("ids") / 4).cast("long"))
