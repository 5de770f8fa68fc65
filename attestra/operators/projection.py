"""What a note says apart from lines that a system manages, proofs that only those changed, and checks of a relation's ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.migration import LINE_ENDS

# Fixed values that results depend on.
MANAGED_KEYS = ("asset_class", "graph_group")

_SPACE = r"[\s\x1c-\x1f]"
#: The characters of that class, for trims: they look at the ends only.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HEADING = rf"^##{_SPACE}+.+$"
_SECTION = rf"(?dmU)((?:{_HEADING}|\A)(?s:.*?))(?={_HEADING}|\z)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _right_stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def _stripped(text: Column) -> Column:
    return F.ltrim(_right_stripped(text), F.lit(_BLANKS))


def _lines(text: Column) -> Column:
    """Lines without their ends; a last end makes no further line."""
    lines = F.split(text, LINE_ENDS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def nonsemantic(text: Column, marker: Column) -> Column:
    """A note without the managed keys of its front matter and without the lines that hold ``marker``.

    The body is cut at its level-two headings. A section whose text has the marker loses those lines and blank ends, and is set
    off by blank lines; one of which only the heading is left goes, and what follows joins what is before. Sections are
    judged each by its own text. Blank ends of the note go. A null text is null; a null or empty marker touches no section.
    Linear in the text: sections are found in one pass and joined once, and a text that is worked out is so once,
    though it is named often below (a projection that Spark inlines would else build it anew each time).
    """
    return _once(text, lambda t: _nonsemantic(t, marker))


def _nonsemantic(text: Column, marker: Column) -> Column:
    shut = F.when(text.startswith("---\n") & (F.locate("\n---\n", text, 5) > 0), F.locate("\n---\n", text)).otherwise(0)
    header = lambda at: F.filter(_lines(F.substring(text, F.lit(1), at - 1)), lambda x: ~x.rlike(rf"^({'|'.join(MANAGED_KEYS)}):"))
    bare = _once(shut, lambda at: F.when(at > 0, F.concat(F.array_join(header(at), "\n"), F.substring(text, at, F.length(text)))).otherwise(text))
    holds = lambda x: F.coalesce((F.length(marker) > 0) & F.contains(x, marker), F.lit(False))
    kept = lambda x: _stripped(F.array_join(F.filter(_lines(x), lambda line: ~F.contains(line, marker)), "\n"))
    headed = lambda x: F.regexp_extract(x, rf"(?dmU)\A({_HEADING})", 1)

    def unit(x: Column) -> Column:
        ours = holds(x) & (headed(x) != "")
        rest = F.when(ours, kept(x))
        return F.struct(ours.alias("ours"), F.when(ours & (rest != headed(x)), rest).when(~ours, x).alias("text"))  # null: it goes

    units = lambda plain: F.transform(F.regexp_extract_all(plain, F.lit(_SECTION), 1), unit)

    def piece(u: Column, i: Column, all_: Column) -> Column:
        cut = F.coalesce(F.get(all_, i + 1)["ours"], F.lit(False))  # blank ends go ahead of a managed section
        t = u["text"]
        own = F.when(t.isNull() | (cut & (t == "")), "").otherwise(F.concat(F.lit("\n\n"), t, F.when(cut, "").otherwise("\n\n")))
        return F.when(u["ours"], own).otherwise(F.when(cut, _right_stripped(t)).otherwise(t))

    joined = lambda plain: _once(units(plain), lambda all_: F.array_join(F.transform(all_, lambda u, i: piece(u, i, all_)), ""))
    # sections are read only where one may be managed
    return F.when(text.isNotNull(), _stripped(_once(bare, lambda plain: F.when(holds(plain), joined(plain)).otherwise(plain))))


def nonsemantic_proofs(relations: DataFrame, before: DataFrame, notes: DataFrame) -> DataFrame:
    """Whether both ends of a relation still say what they did before a system wrote the relation into them.

    ``relations``: candidate_id (unique), source_asset_id, target_asset_id. ``before``: candidate_id, side (source or target),
    text: the images that a receipt kept; of several for a side, all must agree. ``notes``: asset_id (unique), text.
    One row a relation: candidate_id, proven, reason: null, or ``image_missing``, ``note_missing``, ``source_changed``,
    ``target_changed``, the first that holds; a null text is a missing one. Forms are compared by SHA-256: an image is hashed
    where it is read, a note once, and again only for relations whose marker its text holds, so only notes' texts are
    shuffled, once. A note with many relations is skewed as any join's key; AQE splits it.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_asset_id").alias("asset_id")) for s in ("source", "target")])).alias("end")
    r = relations.select("candidate_id", ends).select("candidate_id", "end.*")
    form = lambda marker: F.unhex(F.sha2(nonsemantic(F.col("text"), marker), 256))
    mark = F.col("candidate_id")
    images = before.select("candidate_id", "side", form(mark).alias("image"))
    plain = notes.select("asset_id", "text", form(F.lit("")).alias("plain"))
    touched = F.contains("text", mark) | mark.rlike(LINE_ENDS)  # line ends of the front matter change
    now = r.join(plain, "asset_id", "left").select("candidate_id", "side", F.when(touched, form(mark)).otherwise(F.col("plain")).alias("now"))
    j = now.join(images, ["candidate_id", "side"], "left")
    j = j.select("candidate_id", "side", F.col("image").isNull().alias("no_image"), F.col("now").isNull().alias("no_note"), (F.col("now") != F.col("image")).alias("changed"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    reason = F.when(any_(F.col("no_image")), "image_missing").when(any_(F.col("no_note")), "note_missing")
    for side in ("source", "target"):
        reason = reason.when(any_(F.col("changed") & (F.col("side") == side)), f"{side}_changed")
    return j.groupBy("candidate_id").agg(reason.alias("reason")).select("candidate_id", F.col("reason").isNull().alias("proven"), "reason")


def end_changes(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """Whether a candidate may be written: its ends are what they were when it was found.

    ``candidates``: candidate_id, and of both ends source_asset_id, source_location, source_revision, source_snapshot_hash (target_
    likewise). ``assets``: relative_path (unique), asset_id, revision, file_hash. One row a candidate: candidate_id and problem:
    null, or ``asset_missing`` (no asset at a location), ``identity_changed``, ``revision_changed``, ``snapshot_changed``, the first that
    holds at an end. Nulls equal nulls only. Texts aren't read; a location is joined once for each end.
    """
    j = candidates
    for s in ("source", "target"):
        at = assets.select(F.col("relative_path").alias(f"{s}_location"), F.struct("asset_id", "revision", "file_hash").alias(f"_{s}"))
        j = j.join(at, f"{s}_location", "left")
    some = lambda test: test("source") | test("target")
    differs = lambda field, old: some(lambda s: ~F.col(f"_{s}.{field}").eqNullSafe(F.col(f"{s}_{old}")))
    problem = (
        F.when(some(lambda s: F.col(f"_{s}").isNull()), "asset_missing").when(differs("asset_id", "asset_id"), "identity_changed")
        .when(differs("revision", "revision"), "revision_changed").when(differs("file_hash", "snapshot_hash"), "snapshot_changed")
    )
    return j.select("candidate_id", problem.alias("problem"))
