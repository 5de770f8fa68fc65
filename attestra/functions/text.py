"""Scalar text functions: Column -> Column, evaluated by Spark itself unless a note says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
CJK = "\\u3400-\\u9fff"
SENTENCE_END = "。！？!?；;：:."
PUNCTUATION = "[。！？!?；;，,、：:.]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffd]"
PLACEHOLDERS = ("no transcript acquired", "transcript unavailable", "missing transcript", "暂无转录", "未取得字幕", "无转录内容")
DISCOURSE_MARKERS = (
    "那么", "所以", "但是", "不过", "然而", "因此", "同时", "当然", "比如", "例如", "首先", "其次", "最后", "简单来说", "总之", "接下来",
    "其中", "注意", "如果", "虽然", "甚至", "否则", "之后",
)
LANGUAGE_ALIASES = {
    "zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "chinese": "zh-CN",
    "en": "en", "en-us": "en", "en-gb": "en", "english": "en",
}
SECRET_NAMES = "authorization|cookie|token|secret|credential|password|session"
FIVE = 5


def matches(text: Column, pattern: str) -> Column:
    """Number of matches of a Java regular expression."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def as_double(c: Column) -> Column:
    """The number, or 0 where it can't be read."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS, rounded down, never negative; hours may pass 23."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)))


def clock_millis(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.mmm, half to even."""
    ms = F.greatest(F.bround(seconds * 1000), F.lit(0.0)).cast("long")
    s = F.floor(ms / 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)), F.pmod(ms, F.lit(1000))
    )


def seconds_of(hours: Column, minutes: Column, seconds: Column) -> Column:
    """Fields of a clock as seconds."""
    return as_double(hours) * 3600 + as_double(minutes) * 60 + as_double(seconds)


def language_name(value: Column) -> Column:
    """Canonical name of a declared language; other names stay, empty ones are unknown."""
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "_", "-"))
    out = F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(value)
    for alias, name in LANGUAGE_ALIASES.items():
        out = F.when(key == alias, name).otherwise(out)
    return out


def detect_language(text: Column) -> Column:
    """By counts of Han and Latin letters: zh-CN, en, mixed or unknown."""
    han, latin = matches(text, f"[{CJK}]"), matches(text, "[A-Za-z]")
    return (
        F.when(han >= F.greatest(F.lit(20.0), latin * 0.2), "zh-CN")
        .when(latin >= F.greatest(F.lit(20), han * 2), "en")
        .when((han > 0) | (latin > 0), "mixed")
        .otherwise("unknown")
    )


def draft_language(text: Column) -> Column:
    """The stricter rule for drafts: other Han range, integer half, strict comparisons."""
    han, latin = matches(text, "[\\u4e00-\\u9fff]"), matches(text, "[A-Za-z]")
    return (
        F.when(han > F.greatest(F.lit(20).cast("long"), F.floor(latin / 2)), "zh-CN")
        .when(latin > F.greatest(F.lit(20).cast("long"), han * 2), "en")
        .otherwise("unknown")
    )


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))


def _without_repeats(text: Column) -> Column:
    return F.regexp_replace(text, "(?d)(.{2,16})\\1+", "$1")


def _once(value: Column, use) -> Column:
    """``use(value)``, however often it names the value, which is bound to a lambda and worked out once."""
    return F.transform(F.array(value), use)[0]


def _with_stops(text: Column) -> Column:
    def stopped(t: Column) -> Column:
        out = t
        for marker in DISCOURSE_MARKERS:
            out = F.regexp_replace(out, f"(?U)(?<=[^{SENTENCE_END}\\s])(?={marker})", "。")
        return F.when(t.rlike(f"[{CJK}]"), out).otherwise(t)

    return _once(text, stopped)


def _with_end(text: Column) -> Column:
    end = F.when(text.rlike(f"[{CJK}]"), "。").otherwise(".")
    return F.when((text != "") & ~text.rlike(f"[{SENTENCE_END}]$"), F.concat(text, end)).otherwise(text)


def clean(text: Column) -> Column:
    """A spoken fragment as readable text: see ``clean_steps`` for what was applied."""
    return _once(_with_stops(_without_repeats(squeeze(text))), _with_end)


def clean_steps(text: Column) -> Column:
    """Names of the steps that changed the text in ``clean``."""
    squeezed = squeeze(text)
    once = _without_repeats(squeezed)
    stopped = _with_stops(once)
    return F.array_compact(
        F.array(
            F.when(once != squeezed, "adjacent_exact_phrase_repetition_removed"),
            F.when(stopped != once, "discourse_marker_punctuation_restored"),
            F.when((stopped != "") & ~stopped.rlike(f"[{SENTENCE_END}]$"), "terminal_punctuation_restored"),
        )
    )


def close_cjk(text: Column) -> Column:
    """White space squeezed, and removed between two CJK characters."""
    return F.regexp_replace(squeeze(text), f"(?<=[{CJK}]) (?=[{CJK}])", "")


def fingerprint(text: Column) -> Column:
    """Key of equal texts: letters, digits and CJK only, lower-cased."""
    return F.lower(F.regexp_replace(text, f"(?U)[^\\w{CJK}]+", ""))


def join_fragment(left: Column, right: Column) -> Column:
    """Two fragments joined, without a space where CJK text meets CJK text."""
    close = F.right(left, F.lit(4)).rlike(f"[{CJK}]") & F.left(right, F.lit(4)).rlike(f"[{CJK}]")
    return F.when(left == "", right).otherwise(F.concat(F.rtrim(left), F.when(close, "").otherwise(" "), F.ltrim(right)))


def longest_unpunctuated(text: Column) -> Column:
    """Length of the longest stretch without punctuation."""
    return F.array_max(F.transform(F.split(text, PUNCTUATION), lambda x: F.length(x))).cast("long")


def _chars_in(text: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def repeated_run_chars(text: Column) -> Column:
    """Characters in runs of three or more of one character."""
    return _chars_in(text, "(?d)(.)\\1{2,}")


def repeated_phrase_chars(text: Column) -> Column:
    """Characters in phrases of 2 to 8 that follow themselves."""
    return _chars_in(text, "(?d)(.{2,8})\\1+")


def percentile_of(values: Column, ratio: float) -> Column:
    """Nearest-rank percentile of an array, 0 for an empty one."""
    at = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(ratio)).cast("int"))
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.least(at, F.size(values)))).otherwise(0.0)


def scalar(value: Column) -> Column:
    """A front-matter value without quotes; true and false in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(value), '^"+|"+$', ""), "^'+|'+$", "")
    return F.when(F.lower(bare).isin("true", "false"), F.lower(bare)).otherwise(bare)


def frontmatter(text: Column) -> Column:
    """The header between --- lines as a map; a key given twice keeps its last value, indented lines don't count."""
    header = F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---\\n", 1)
    lines = F.filter(F.split(header, "\\n"), lambda x: x.rlike("^[^\\s:][^:]*:|^[^\\s][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), scalar(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value")))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    """What follows the front matter; the whole text without one."""
    return F.regexp_replace(text, "(?s)\\A---\\n.*?\\n---\\n", "")


def frontmatter_value(text: Column, key: str) -> Column:
    """One key's value, JSON strings decoded; null if absent."""
    raw = F.regexp_extract(text, f"(?m)^{key}:\\s*(.+?)\\s*$", 1)
    return F.when(raw != "", F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"), raw))


def title(text: Column, stem: Column) -> Column:
    """The first level-one heading, else the file's stem."""
    found = F.btrim(F.regexp_extract(text, "(?m)^#[ \\t]+(.+)$", 1))
    return F.when(found != "", found).otherwise(stem)


def strict_title(text: Column) -> Column:
    """The only level-one heading; null if there are none or several, or it is unknown."""
    all_ = F.regexp_extract_all(text, F.lit("(?m)^#[ \\t]+(.+?)[ \\t]*$"), F.lit(1))
    return F.when((F.size(all_) == 1) & (F.lower(F.element_at(all_, 1)) != "unknown"), F.element_at(all_, 1))


def sections(text: Column) -> Column:
    """heading -> text below it, all levels; a heading given twice has both texts, each followed by a line feed."""
    parts = F.split(F.concat(F.lit("\n"), text), "\\n(?=#{1,6}[ \\t]+\\S)")
    some = F.filter(parts, lambda x: x.rlike("^#{1,6}[ \\t]+\\S"))
    pairs = F.transform(
        some,
        lambda x: F.struct(
            F.btrim(F.regexp_extract(x, "^#{1,6}[ \\t]+([^\\n]+)", 1)).alias("k"),
            F.concat(F.regexp_replace(F.regexp_replace(x, "^[^\\n]*\\n?", ""), "(?U)^\\s+|\\s+$", ""), F.lit("\n")).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(
        F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), "").alias("value")))
    )


def states(meta: Column) -> Column:
    """Distinct lower-cased values of the four status keys."""
    keys = ("status", "workflow_state", "review_status", "ingestion_status")
    return F.array_distinct(F.array_compact(F.array(*[F.lower(F.btrim(meta[k])) for k in keys])))


def role_text(section_map: Column, pattern: str) -> Column:
    """Texts of the sections whose heading matches."""
    return F.array_join(F.map_values(F.map_filter(section_map, lambda k, v: k.rlike(pattern))), "\n")


def shingled(text: Column) -> Column:
    """The letters and digits of a text, lower-cased: what ``shingles`` cuts."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def shingles(text: Column, width: int = FIVE) -> Column:
    """Distinct character n-grams of the letters and digits, lower-cased; the whole if it is shorter.

    One pass of a look-ahead finds them all. Texts with characters beyond 16 bits, which a look-ahead would halve, are cut
    into characters first; the cut is bound to a lambda, so that it is made once a text.
    """
    t = shingled(text)
    fast = F.regexp_extract_all(t, F.lit(f"(?=(.{{{width}}}))"), F.lit(1))
    at = lambda c: F.sequence(F.lit(1), F.size(c) - width + 1)
    slow = F.transform(F.array(F.split(t, "")), lambda c: F.transform(at(c), lambda i: F.array_join(F.slice(c, i, F.lit(width)), "")))[0]
    wide = t.rlike("[\\x{10000}-\\x{10FFFF}]")
    return F.when(F.length(t) < width, F.array(t)).when(wide, F.array_distinct(slow)).otherwise(F.array_distinct(fast))


def overlap(left: Column, right: Column) -> Column:
    """Overlap coefficient of two sets, 0 if one is empty."""
    small = F.greatest(F.lit(1), F.least(F.size(left), F.size(right)))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / small).otherwise(0.0)


def longest_first(values: Column, n: int) -> Column:
    """The n longest strings, ties by code point."""
    by = F.array_sort(F.transform(values, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.slice(F.transform(by, lambda s: s["x"]), 1, n)


def numbers(text: Column) -> Column:
    """Distinct numeric tokens."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_])[0-9]+(?:\\.[0-9]+)?%?(?![A-Za-z0-9_])"), F.lit(0)))


def without_ordinals(text: Column) -> Column:
    """Text without the numbers of list items."""
    return F.regexp_replace(text, "(?m)^\\s*[0-9]+[.、]\\s*", "")


def _chinese(n: int) -> str:
    digits = "零一二三四五六七八九"
    if n == 100:
        return "一百"
    tens, ones = divmod(n, 10)
    return ("" if tens == 0 else "十" if tens == 1 else digits[tens] + "十") + (digits[ones] if ones or not tens else "")


def unsupported_numbers(output: Column, source: Column) -> Column:
    """Numbers of a draft that its source lacks, sorted; percentages may stand in words in the source."""
    new = F.array_except(numbers(without_ordinals(output)), numbers(source))
    names = F.create_map(*[F.lit(x) for n in range(101) for x in (f"{n}%", _chinese(n))])
    spelled = lambda t: F.coalesce(
        F.contains(source, F.concat(F.lit("百分之"), names[t])) | F.contains(source, F.concat(F.lit("百分之"), F.regexp_replace(t, "%", ""))), F.lit(False)
    )
    return F.array_sort(F.filter(new, lambda t: ~spelled(t)))


def redact(value: Column) -> Column:
    """A failure detail on one line of at most 500 characters, without secrets."""
    line = F.substring(squeeze(value), 1, 500)
    return F.when(F.coalesce(value, F.lit("")) != "", F.regexp_replace(line, f"(?i)({SECRET_NAMES})\\s*[:=]\\s*\\S+", "$1=[REDACTED]"))


def clean_public(value: Column) -> Column:
    """Text without control characters, squeezed, at most 500 characters."""
    return F.substring(squeeze(F.regexp_replace(value, "[\\x00-\\x1f\\x7f]", " ")), 1, 500)


def leaks_credentials(value: Column) -> Column:
    return F.coalesce(value.rlike(f"(?i)({SECRET_NAMES})[\"']?\\s*[:=]"), F.lit(False))


def references(values: Column) -> Column:
    """Distinct references in order, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def duration_ms(start: Column, stop: Column) -> Column:
    """Milliseconds between two ISO instants, at least 0."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(stop.try_cast("timestamp")) - F.unix_millis(start.try_cast("timestamp")))


def display_title(name: Column, platform: Column, source_id: Column) -> Column:
    """A title, or platform and id where it is unknown."""
    unknown = F.lower(F.btrim(F.coalesce(name, F.lit("")))).isin("", "unknown", "none", "null")
    return F.when(unknown, F.concat_ws(" ", platform, source_id)).otherwise(name)


def without_lines(text: Column, marker: Column) -> Column:
    """Text without the lines that hold a marker."""
    return F.array_join(F.filter(F.split(text, "\\n"), lambda x: ~F.contains(x, marker)), "\n")


def set_header(text: Column, key: str, value: Column) -> Column:
    """Front matter with one key set; the body's bytes stay."""
    line = F.concat(F.lit(f"{key}: "), value)
    head = F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---\\n", 1)
    had = head.rlike(f"(?m)^{key}:")
    lines = F.transform(F.split(head, "\\n"), lambda x: F.when(x.startswith(f"{key}:"), line).otherwise(x))
    new = F.when(had, F.array_join(lines, "\n")).otherwise(F.concat_ws("\n", head, line))
    return F.when(text.startswith("---\n") & (head != ""), F.concat(F.lit("---\n"), new, F.lit("\n---\n"), body(text))).otherwise(text)


def append_line(text: Column, heading: Column, line: Column) -> Column:
    """Text with a line below a heading, which is added where absent; the same text if the line is there."""
    begin = F.instr(text, F.concat(F.lit("\n"), heading, F.lit("\n")))
    after = begin + F.length(heading) + 2
    put = F.concat(F.substring(text, F.lit(1), after - 1), line, F.lit("\n"), F.substring(text, after, F.length(text)))
    add = F.concat(F.rtrim(text), F.lit("\n\n"), heading, F.lit("\n"), line, F.lit("\n"))
    return F.when(F.contains(text, line), text).when(begin > 0, put).otherwise(add)
