"""Fill-in-the-middle: texts cut in three and put together again around marks.

A text is stored as maximal runs of one class of characters, the class being the number of bytes that UTF-8 takes for
them, with the running count of characters and bytes at each run's end. A cut after k characters is found by binary
search among the counts; the rest of its byte offset is arithmetic, since all characters of a run are equally long. No
text is decoded and no character is visited one by one. All texts of a batch share one array of runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.runtime import bound_batches

MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Runs:
    """Maximal runs over texts that stand one after the other: width of a character, characters and bytes up to a run's end."""

    width: np.ndarray
    units: np.ndarray
    bytes: np.ndarray

    def offset(self, at: np.ndarray) -> np.ndarray:
        """Byte offsets of cuts after ``at`` characters."""
        run = np.searchsorted(self.units, at, side="left")  # the first run that ends at the cut or behind it
        run = np.minimum(run, max(len(self.units) - 1, 0))
        if not len(self.units):
            return np.zeros(len(at), np.int64)
        return self.bytes[run] - (self.units[run] - at) * self.width[run]


def encode_runs(data: np.ndarray) -> Runs:
    """The runs of UTF-8 bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.append(lead, len(data)))
    ends = np.flatnonzero(np.append(width[1:] != width[:-1], True)) if len(width) else np.zeros(0, np.int64)
    after = np.append(lead[1:], len(data))[ends] if len(width) else np.zeros(0, np.int64)
    return Runs(width[ends], ends + 1, after)


def lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each text whose bytes lie between two offsets."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.diff(lead[offsets])


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from the sha256 of the seed and its id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its values."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


_KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
_TYPE = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:binary>"


def _rearrange(rate: int, spm_rate: int, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    @F.arrow_udf(_TYPE)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, *h in batches:
            data, ends = _texts(text)
            h1, h2, h3, h4 = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in h)
            n = lengths(data, ends)
            base = np.concatenate([[0], np.cumsum(n)])[:-1]
            cuts = h1 % (n + 1), h2 % (n + 1)
            first, second = np.minimum(*cuts), np.maximum(*cuts)
            runs = encode_runs(data)
            one, two = runs.offset(base + first), runs.offset(base + second)
            whole, out, form = data.tobytes(), [], []
            for i in range(len(n)):
                a, b, c, d = (int(v) for v in (ends[i], one[i], two[i], ends[i + 1]))
                body = whole[a:d]
                if not body or h3[i] % 100 >= rate or p in body or s in body or m in body:
                    form.append("plain")
                    out.append(body)
                elif h4[i] % 100 < spm_rate:
                    form.append("spm")
                    out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
                else:
                    form.append("psm")
                    out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
            plain = np.array([f == "plain" for f in form], bool)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64(), mask=plain), pa.array(second - first, pa.int64(), mask=plain), pa.array(out, pa.binary())],
                fields=list(_KIND),
            )

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row a document: its id, ``n`` characters, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, ``output``.

    ``rate`` of 100 documents are cut in three at two drawn places, ``spm_rate`` of 100 of those with the suffix first.
    A text that is null or empty or holds a mark stays plain, its cuts null. Repeated rows are treated alike; whole texts,
    however long, are cut by byte arithmetic; only id and text are read.
    """
    bound_batches(docs.sparkSession)
    key = F.col(id_col)
    made = _rearrange(rate, spm_rate, marks)(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), *draws(key, seed))
    rows = docs.select(key.alias(id_col), made.alias("fim"))
    parts = [F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    return rows.select(F.col(id_col), *parts, F.col("fim.output").cast("string").alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``output`` was made. Marks end as they never begin, so their first places are the true ones."""
    p, s, m = marks
    after = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    before = lambda text, mark: F.substring(text, F.lit(1), F.instr(text, mark) - 1)
    middle = after(output, m)
    psm = F.concat(before(after(output, p), s), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
