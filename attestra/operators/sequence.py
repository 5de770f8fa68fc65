"""Operators over ordered rows: segments, paragraphs, chunks, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import text as T


def explode_segments(transcripts: DataFrame, key: str) -> DataFrame:
    """(key, pos, segment_id, start_time, end_time, text); without segments one row of the whole text, ids by place."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("segment_id"), F.lit(0.0).alias("start_time"), F.lit(0.0).alias("end_time"), F.coalesce("text", F.lit("")).alias("text")))
    seg = F.when(F.size(F.coalesce("segments", F.expr("array()"))) > 0, F.transform("segments", lambda s: F.struct(s["segment_id"].alias("segment_id"), T.as_double(s["start_time"]).alias("start_time"), T.as_double(s["end_time"]).alias("end_time"), F.coalesce(s["text"], F.lit("")).alias("text")))).otherwise(whole)
    rows = transcripts.select(key, F.posexplode(seg).alias("pos", "s"))
    name = F.coalesce(F.nullif("s.segment_id", F.lit("")), F.format_string("transcript-%04d", F.col("pos") + 1))
    return rows.select(key, "pos", name.alias("segment_id"), "s.start_time", "s.end_time", "s.text")


def parse_blocks(text: Column) -> Column:
    """Segments of a text with [hh:mm:ss - hh:mm:ss] lines, as an array of structs."""
    p = "\\[(\\d{2}):(\\d{2}):(\\d{2}(?:\\.\\d+)?)\\s*-\\s*(\\d{2}):(\\d{2}):(\\d{2}(?:\\.\\d+)?)\\]\\s*\\n((?s:.*?))(?=\\n\\[\\d{2}:|\\z)"
    g = [F.regexp_extract_all(text, F.lit(p), F.lit(k)) for k in range(1, 8)]
    return F.transform(
        F.arrays_zip(*g),
        lambda z: F.struct(
            T.seconds_of(z["0"], z["1"], z["2"]).alias("start_time"), T.seconds_of(z["3"], z["4"], z["5"]).alias("end_time"), F.regexp_replace(z["6"], "(?U)^\\s+|\\s+$", "").alias("text")
        ),
    )


def drop_repeats(rows: DataFrame, key: str, order: list[str], text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """Rows in order, cleaned, without blank ones and without those whose fingerprint equals that of the row kept before.

    A row equal to its predecessor has the same fingerprint, so comparing neighbours after the blanks are gone decides
    the same rows as comparing with the last kept one.
    """
    t = T.clean(F.col(text_col)) if cleaned else F.col(text_col)
    # each text is cleaned once: a filter on it would be pushed below and clean it again wherever it names it
    one = F.transform(F.array(t), lambda c: F.struct(c.alias(text_col), T.fingerprint(c).alias("print")))
    rest = [c for c in rows.columns if c != text_col]
    df = rows.select(*rest, F.inline(F.filter(one, lambda x: x[text_col] != ""))).select(*rows.columns, "print")
    before = F.lag("print").over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("before", before).where((F.col("print") == "") | ~F.col("print").eqNullSafe(F.col("before"))).drop("print", "before")


def _joined(left: str, right: str) -> str:
    if not left:
        return right
    han = lambda s: any("㐀" <= c <= "鿿" for c in s)
    return left.rstrip() + ("" if han(left[-4:]) and han(right[:4]) else " ") + right.lstrip()


def split_oversized(text: str, target: int, most: int) -> list[str]:
    """Pieces of a run-on text: at the last sentence end that fits, else before the last discourse marker, else hard."""
    han = lambda s: any("㐀" <= c <= "鿿" for c in s)
    least, rest, out = max(40, int(target * 0.6)), text.strip(), []
    while len(rest) > most:
        head = rest[: most + 1]
        ends = [i for i in range(least, len(head)) if head[i - 1] in T.SENTENCE_END]
        cut = ends[-1] if ends else max(head.rfind(m, least) for m in T.DISCOURSE_MARKERS)
        cut = cut if cut >= least else most
        piece, rest = rest[:cut].strip(), rest[cut:].strip()
        if piece:
            out.append(piece if piece[-1] in T.SENTENCE_END else piece + ("。" if han(piece) else "."))
    return [*out, rest] if rest else out


def paragraphs(segments: DataFrame, key: str, target: int = 420, most: int = 760, seconds: float = 180.0) -> DataFrame:
    """(key, paragraph_id, start_time, end_time, text, segment_ids): segments joined in order into paragraphs.

    A paragraph ends at a sentence end past ``target`` characters or when it lasts ``seconds``; a segment that would pass
    ``most`` starts a new one, and a longer segment is split. The time since the old start still counts after such a
    start. Segments stream through a task in order, many conversations or transcripts a batch; a task holds one paragraph.
    """
    kind = dict(segments.dtypes)[key]
    schema = f"{key} {kind}, paragraph_id string, start_time double, end_time double, text string, segment_ids array<string>"
    names = [key, "paragraph_id", "start_time", "end_time", "text", "segment_ids"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        whose, n, text, ids, start, end = None, 0, "", [], 0.0, 0.0

        def put(begin: float, until: float, piece: str, of: list) -> None:
            nonlocal n
            n += 1
            out.append((whose, f"paragraph-{n:04d}", begin, until, piece, of))

        def flush() -> None:
            nonlocal text, ids, start, end
            if text:
                put(start, end, text.strip(), ids)
                text, ids, start, end = "", [], 0.0, 0.0

        def written(key_type: pa.DataType) -> pa.RecordBatch:
            types = [key_type, pa.string(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string())]
            columns = zip(*out, strict=True) if out else [()] * len(types)
            done = [pa.array(c, t, from_pandas=k in (2, 3)) for k, (c, t) in enumerate(zip(columns, types, strict=True))]
            out.clear()
            return pa.RecordBatch.from_arrays(done, names)

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            times = [b.column(k).to_numpy(zero_copy_only=False).tolist() for k in (1, 2)]
            for k, begin, until, segment, said, place in zip(b.column(0).to_pylist(), *times, *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if place == 1:
                    flush()
                    whose, n, ids, end = k, 0, [], 0.0
                if len(said) > most:
                    flush()
                    for piece in split_oversized(said, target, most):
                        put(begin, until, piece, [segment])
                    continue
                if not text:
                    start = begin
                both = _joined(text, said)
                lasts = max(until, end) - start
                if text and len(both) > most:
                    flush()
                    start, both = begin, said
                text, end = both, max(end, until)
                ids.append(segment)
                if (len(both) >= target and both[-1] in T.SENTENCE_END) or lasts >= seconds:
                    flush()
            yield written(key_type)
        flush()
        if out:
            yield written(key_type)

    order = [F.col(c).asc_nulls_last() for c in ("start_time", "end_time", "pos")]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))  # leaves each key's rows together and in order
    times = [F.col(c).cast("double").alias(c) for c in ("start_time", "end_time")]
    return segments.withColumn("place", place).select(key, *times, F.col("segment_id").cast("string"), "text", "place").mapInArrow(fold, schema)


def readable_text(rows: DataFrame, key: str) -> DataFrame:
    """Paragraphs joined by blank lines."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "text"))), lambda s: s["text"]), "\n\n").alias("readable_text"))


def media_hygiene(segments: DataFrame, key: str) -> DataFrame:
    """Cleaned segments as short paragraphs: 300 to 520 characters, 90 seconds."""
    return paragraphs(drop_repeats(segments, key, ["start_time", "end_time", "pos"]), key, 300, 520, 90.0)


def shift_chunks(segments: DataFrame, key: str, chunk: str, offset: str) -> DataFrame:
    """Segments of chunks on the clock of the whole: offsets added, three decimals, ids by place."""
    order = Window.partitionBy(key).orderBy(chunk, "pos")
    at = F.row_number().over(order)
    return segments.withColumns({"start_time": F.round(F.col("start_time") + F.col(offset), 3), "end_time": F.round(F.col("end_time") + F.col(offset), 3), "segment_id": F.format_string("transcript-%04d", at)})


def chunk_offsets(chunks: DataFrame, key: str, chunk: str = "chunk", duration: str = "duration", ok: str = "ok") -> DataFrame:
    """Running offset of each chunk, and the missing range that a failed one leaves."""
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    out = chunks.withColumn("offset", F.coalesce(F.sum(duration).over(before), F.lit(0.0)))
    gap = F.struct(F.col("offset").alias("start_time"), (F.col("offset") + F.col(duration)).alias("end_time"), F.lit("chunk_failed").alias("reason"))
    return out.withColumn("missing", F.when(~F.col(ok), gap))


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, covered): length of the union of intervals, by islands over a running maximum."""
    some = rows.where(F.col(end) > F.col(start)).select(key, F.col(start).alias("s"), F.col(end).alias("e"))
    order = Window.partitionBy(key).orderBy("s", "e")
    top = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col("s") > top), 1).otherwise(0)
    marked = some.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg((F.max("e") - F.min("s")).alias("n")).groupBy(key).agg(F.sum("n").alias("covered"))


def in_order(rows: DataFrame, key: str, start: str, end: str, pos: str) -> DataFrame:
    """(key, in_order): whether starts never fall along pos and ends lie after starts."""
    before = F.lag(start).over(Window.partitionBy(key).orderBy(pos))
    bad = (F.col(start) < before) | (F.col(end) <= F.col(start)) | F.col(start).isNull() | F.col(end).isNull()
    return rows.withColumn("bad", F.coalesce(bad, F.lit(False))).groupBy(key).agg((~F.bool_or("bad")).alias("in_order"))


def merged_text(segments: DataFrame, key: str) -> DataFrame:
    """Segment texts in order as one."""
    return segments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "").alias("text"))


def latest(rows: DataFrame, key: str, order: str, where: Column) -> DataFrame:
    """The last row of each key for which a condition holds."""
    cols = [c for c in rows.columns if c != key]
    return rows.where(where).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def first_or_last(rows: DataFrame, key: str | list[str], order: list[Column], last: bool) -> DataFrame:
    """One row a key: the first or last by an order."""
    by = [c.desc() for c in order] if last else [c.asc() for c in order]
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("place = 1").drop("place")


def segment_measures(segments: DataFrame, key: str) -> DataFrame:
    """(key, n, longest, p95, empty_ratio) of segments: durations by nearest rank; a segment without visible text is empty."""
    d = segments.withColumns({"d": F.col("end_time") - F.col("start_time"), "blank": F.btrim(F.coalesce("text", F.lit(""))) == ""})
    return d.groupBy(key).agg(
        F.count("*").alias("n"), F.max("d").alias("longest"), F.expr("percentile_disc(0.95) within group (order by d)").alias("p95"), F.avg(F.col("blank").cast("double")).alias("empty_ratio")
    )
