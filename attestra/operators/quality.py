"""Quality gates over transcripts, readable text and drafts: rule columns, then status ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T

# Fixed values that results depend on.
COGNITIVE_MARKERS = {
    "structural_abstraction": ("机制", "结构", "模型", "路径", "链条", "因果", "约束", "变量"),
    "concept_relationship": ("关系", "相互", "导致", "推动", "承接", "转向", "依赖", "前提"),
    "concept_distinction": ("区别", "区分", "不是", "而是", "层次"),
    "reusable_insight": ("可复用", "观察框架", "判断框架", "分析框架", "用于分析", "迁移"),
}
ATTRIBUTED = ("来源主张", "来源认为", "材料认为", "作者认为", "素材认为")
BOUNDED = ("待核验", "未经核验", "来源边界", "不确定", "未提供", "尚未验证")
AI_LABELS = ("AI结构化", "AI Structural Synthesis", "AI_candidate")
DERIVED = ("认知核", "可复用", "理解框架", "分析框架", "分析问题", "机制模型", "机制链", "概念对照", "论证推进", "结构性洞见")
SOURCE_CLAIMS = ("来源主张", "作者观点", "材料主张", "Source Claim")
USER_VIEWS = ("User Confirmed View", "user_confirmed", "用户确认观点", "用户已确认", "我的观点", "我的理解")
IGNORED_SECTIONS = ("来源", "参考", "生成状态", "Provenance")


def names(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))


def contains_any(text: Column, markers, lower: bool = False) -> Column:
    t = F.lower(text) if lower else text
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(t, F.lit(m.lower() if lower else m))
    return out


def coverage(intervals: Column, duration: Column, corrected: bool = False) -> Column:
    """Seconds of ``duration`` that intervals (array of struct start, end) cover, by one fold over them in order.

    An interval that begins after the duration counts negative, as the results to match have it; ``corrected`` leaves
    such intervals out.
    """
    some = F.filter(intervals, lambda i: (i["end"] > i["start"]) & ((i["start"] < duration) if corrected else F.lit(True)))
    cut = F.array_sort(F.transform(some, lambda i: F.struct(F.greatest(F.lit(0.0), i["start"]).alias("start"), F.least(duration, i["end"]).alias("end"))))
    none = F.lit(None).cast("double")
    begin = F.struct(F.lit(0.0).alias("total"), none.alias("start"), none.alias("end"))

    def step(a: Column, i: Column) -> Column:
        first, inside = a["start"].isNull(), i["start"] <= a["end"]
        return F.struct(
            F.when(first | inside, a["total"]).otherwise(a["total"] + a["end"] - a["start"]).alias("total"),
            F.when(~first & inside, a["start"]).otherwise(i["start"]).alias("start"),
            F.when(~first & inside, F.greatest(a["end"], i["end"])).otherwise(i["end"]).alias("end"),
        )

    return F.aggregate(cut, begin, step, lambda a: F.greatest(F.lit(0.0), a["total"] + F.coalesce(a["end"] - a["start"], F.lit(0.0))))


def ordered(segments: Column) -> Column:
    """Whether starts never fall and every end lies after its start, in the given order; unreadable times fail."""
    readable = F.forall(segments, lambda s: s["start_time"].isNotNull() & s["end_time"].isNotNull() & (s["end_time"] > s["start_time"]))
    at = F.sequence(F.lit(2), F.greatest(F.size(segments), F.lit(2)))
    rising = F.forall(at, lambda i: F.coalesce(F.try_element_at(segments, i)["start_time"] >= F.try_element_at(segments, i - 1)["start_time"], F.lit(True)))
    first = F.coalesce(F.try_element_at(segments, F.lit(1))["start_time"] >= -1, F.lit(True))
    return readable & rising & first


def content_metrics(text: Column, duration: Column | None = None) -> dict[str, Column]:
    """Measures of a readable text that is already squeezed."""
    n = F.length(text).cast("long")
    han = F.regexp_extract_all(text, F.lit(f"[{T.CJK}]"), F.lit(0))
    out = {
        "text_length": n,
        "punctuation_per_100": T.matches(text, T.PUNCTUATION) * 100 / F.greatest(F.lit(1), n),
        "abnormal_ratio": T.matches(text, T.CONTROL) / F.greatest(F.lit(1), n),
        "cjk_count": F.size(han),
        "cjk_kinds": F.size(F.array_distinct(han)),
        "cjk_diversity": F.size(F.array_distinct(han)) / F.greatest(F.lit(1), F.size(han)),
        "repetition_ratio": F.greatest(T.repeated_run_chars(text), T.repeated_phrase_chars(text)) / F.greatest(F.lit(1), n),
        "longest_unpunctuated": T.longest_unpunctuated(text),
        "placeholder": contains_any(text, T.PLACEHOLDERS, lower=True),
    }
    if duration is not None:
        out["chars_per_minute"] = n / F.greatest(duration / 60, F.lit(1 / 60))
    return out


def content_rules(duration: Column | None, repetition: bool = True) -> tuple[Column, Column]:
    """(failures, warnings) over the columns of ``content_metrics``."""
    c = F.col
    fails = [((c("text_length") == 0) | c("placeholder"), "content_missing_or_placeholder")]
    if duration is not None:
        fails.append(((duration >= 30) & (c("chars_per_minute") < 20), "content_density_too_low"))
    fails.append((c("abnormal_ratio") > 0.02, "abnormal_character_ratio"))
    warns = []
    if repetition:
        fails.append((c("repetition_ratio") > 0.015, "mechanical_repetition_pollution"))
        warns.append(((c("repetition_ratio") > 0.006) & (c("repetition_ratio") <= 0.015), "repetition_warning"))
    sparse = (c("text_length") >= 500) & (c("punctuation_per_100") < 0.15)
    fails += [
        ((c("cjk_count") >= 200) & (c("cjk_diversity") < 0.02) & (c("cjk_kinds") < 20), "lexical_diversity_abnormally_low"),
        (sparse, "punctuation_absent_in_long_text"),
        (c("longest_unpunctuated") > 800, "extreme_run_on_text"),
    ]
    warns += [
        (~sparse & (c("text_length") >= 300) & (c("punctuation_per_100") < 0.35), "punctuation_sparse"),
        ((c("longest_unpunctuated") > 400) & (c("longest_unpunctuated") <= 800), "long_run_on_text"),
    ]
    return names(*fails), names(*warns)


def content_status(failures: Column, warnings: Column) -> Column:
    return F.when(F.size(failures) > 0, "unusable").when(F.size(warnings) > 0, "usable_with_warnings").otherwise("usable")


def transcript_gate(transcripts: DataFrame) -> DataFrame:
    """All 22 rules over rows (text, status, segments, missing_ranges, readable_text, media_duration), with the final status.

    Segments are structs start_time, end_time, text. Missing arrays count as empty; a missing duration as 0.
    """
    d = F.coalesce(F.col("media_duration").cast("double"), F.lit(0.0))
    seg = F.coalesce(F.col("segments"), F.expr("cast(array() as array<struct<segment_id:string,start_time:double,end_time:double,text:string>>)")) if "segment_id" in str(transcripts.schema["segments"].dataType) else F.coalesce(F.col("segments"), F.expr("cast(array() as array<struct<start_time:double,end_time:double,text:string>>)"))
    df = transcripts.withColumns({"g_duration": d, "g_segments": seg, "g_text": T.squeeze(F.col("readable_text")), "g_raw": F.btrim(F.coalesce("text", F.lit("")))})
    timed = F.filter("g_segments", lambda s: s["start_time"].isNotNull() & s["end_time"].isNotNull())
    lengths = F.transform(timed, lambda s: F.greatest(F.lit(0.0), s["end_time"] - s["start_time"]))
    blank = F.size(F.filter(timed, lambda s: T.squeeze(s["text"]) == ""))
    n = F.size("g_segments")
    df = df.withColumns(
        {
            "segment_count": n,
            "coverage_seconds": F.when(F.col("g_duration") > 0, coverage(F.transform(timed, lambda s: F.struct(s["start_time"].alias("start"), s["end_time"].alias("end"))), F.col("g_duration"))).otherwise(0.0),
            "max_segment": F.coalesce(F.array_max(lengths), F.lit(0.0)),
            "p95_segment": T.percentile_of(lengths, 0.95),
            "empty_ratio": F.when(n > 0, blank / F.greatest(n, F.lit(1))).otherwise(1.0),
            "in_order": ordered(F.col("g_segments")),
            "missing_count": F.greatest(F.size(F.coalesce("missing_ranges", F.array())), F.lit(0)) if "missing_ranges" in transcripts.columns else F.lit(0),
            **content_metrics(F.col("g_text"), F.col("g_duration")),
        }
    )
    df = df.withColumn("coverage_ratio", F.when(F.col("g_duration") > 0, F.col("coverage_seconds") / F.col("g_duration")).otherwise(0.0))
    c = F.col
    giant = (c("g_duration") >= 180) & (c("segment_count") <= 1) & (c("max_segment") >= c("g_duration") * 0.8)
    known = c("g_duration") > 0
    status = F.coalesce("status", F.lit(""))
    fails = names(
        ((c("g_raw") == "") | (c("segment_count") == 0), "transcript_empty"),
        (c("placeholder"), "placeholder_text"),
        (~c("in_order"), "invalid_or_unordered_timestamps"),
        (giant, "giant_single_segment"),
        (~giant & (c("max_segment") > 180), "oversized_segment"),
        (c("empty_ratio") > 0.5, "excessive_empty_segments"),
        (known & (c("coverage_ratio") < 0.70), "timestamp_coverage_severely_incomplete"),
        (status == "failed", "provider_failed"),
    )
    warns = names(
        (~giant & (c("max_segment") > 75) & (c("max_segment") <= 180), "long_segment"),
        (known & (c("coverage_ratio") >= 0.70) & (c("coverage_ratio") < 0.90), "timestamp_coverage_incomplete"),
        (c("missing_count") > 0, "missing_ranges_present"),
        (status == "partial", "provider_partial"),
    )
    bad, odd = content_rules(c("g_duration"))
    df = df.withColumns({"structural_failures": fails, "structural_warnings": warns, "content_failures": bad, "content_warnings": odd})
    structure = F.when(F.size("structural_failures") > 0, "fail").when(F.size("structural_warnings") > 0, "warning").otherwise("pass")
    df = df.withColumns({"structural_status": structure, "content_status": content_status(c("content_failures"), c("content_warnings"))})
    ready = (c("structural_status") != "fail") & (c("content_status") != "unusable") & (c("missing_count") == 0) & (status == "completed")
    partial = (c("g_raw") != "") & ((c("missing_count") > 0) | (status == "partial"))
    gate = F.when(ready, "ready_for_整理").when(partial, "transcript_partial").otherwise("transcript_quality_failed")
    return df.withColumns({"ready": ready, "quality_status": gate}).drop("g_duration", "g_segments", "g_text", "g_raw")


def document_gate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Content rules without duration and repetition over documents: adds measures and ``status``."""
    df = docs.withColumn("g_text", T.squeeze(F.col(text_col)))
    wanted = {k: v for k, v in content_metrics(F.col("g_text")).items() if k != "repetition_ratio"}
    df = df.withColumns(wanted)
    bad, odd = content_rules(None, repetition=False)
    return df.withColumn("status", content_status(bad, odd)).drop("g_text")


def meaningful_sections(markdown: Column) -> Column:
    """Texts below second-level headings, of 80 characters or more; provenance sections don't count."""
    lines = F.concat(F.lit("\n"), markdown)
    parts = F.split(lines, "\\n(?=## )")
    keep = F.filter(parts, lambda p: ~(p.startswith("## ") & contains_any(F.regexp_extract(p, "^## ([^\\n]*)", 1), IGNORED_SECTIONS, lower=True)))
    texts = F.transform(keep, lambda p: F.regexp_replace(F.regexp_replace(p, "(?m)^##? [^\\n]*\\n?", ""), "(?U)^\\s+|\\s+$", ""))
    return F.filter(texts, lambda t: F.length(t) >= 80)


def redundancy(markdown: Column) -> Column:
    """Largest overlap of character shingles between two sections as high, medium or low."""
    sets = F.transform(meaningful_sections(markdown), lambda t: T.shingles(t))
    at = F.sequence(F.lit(1), F.greatest(F.size(sets), F.lit(1)))
    best = F.array_max(
        F.flatten(
            F.transform(
                at,
                lambda i: F.transform(
                    F.filter(at, lambda j: j > i), lambda j: T.overlap(F.try_element_at(sets, i), F.try_element_at(sets, j))
                ),
            )
        )
    )
    return F.when(best >= 0.58, "high").when(best >= 0.34, "medium").otherwise("low")


def cognitive_signals(markdown: Column) -> Column:
    return names(*[(contains_any(markdown, markers), name) for name, markers in COGNITIVE_MARKERS.items()])


def source_boundary(markdown: Column) -> Column:
    return F.when(contains_any(markdown, ATTRIBUTED) & contains_any(markdown, BOUNDED), "passed").otherwise("insufficient")


def authority_boundary(markdown: Column, user_view_allowed: Column) -> Column:
    """Whether derived sections are labelled, source claims aren't labelled as derived, and no user view is made up."""
    heads = F.regexp_extract_all(markdown, F.lit("(?m)^[ \\t]*## ([^\\n]*)$"), F.lit(1))
    labelled = F.filter(heads, lambda h: contains_any(h, AI_LABELS, lower=True))
    bare = F.exists(heads, lambda h: contains_any(h, DERIVED, lower=True) & ~contains_any(h, AI_LABELS, lower=True))
    mixed = F.exists(heads, lambda h: contains_any(h, SOURCE_CLAIMS, lower=True) & contains_any(h, AI_LABELS, lower=True))
    user = contains_any(markdown, USER_VIEWS, lower=True)
    view = F.when(~user, "not_present").when(user_view_allowed, "grounded").otherwise("unverified")
    ok = ~bare & (F.size(labelled) > 0) & ~mixed & (view != "unverified")
    return F.struct(
        F.when(ok, "passed").otherwise("failed").alias("status"), labelled.alias("labelled"),
        F.when(mixed, "misclassified_as_ai_candidate").otherwise("passed").alias("source_claims"), view.alias("user_view"),
    )


def missing_information(title: Column, author: Column, uncertainties: Column) -> Column:
    def unknown(c: Column) -> Column:
        return F.lower(F.btrim(F.coalesce(c, F.lit("")))).isin("", "unknown", "null")

    doubt = F.exists(F.coalesce(uncertainties, F.array().cast("array<string>")), lambda u: contains_any(u, ("unreviewed", "recognition", "听辨", "识别"), lower=True))
    return F.array_sort(names((unknown(title), "来源标题未知"), (unknown(author), "来源作者未知"), (doubt, "ASR/转写尚未人工复核，局部听辨可能不准确")))


def draft_report(drafts: DataFrame) -> DataFrame:
    """Quality report of drafts (markdown, source_text, user_view_allowed): signals, unsupported numbers, reasons, publishable."""
    m = F.col("markdown")
    allowed = F.coalesce(F.col("user_view_allowed"), F.lit(False)) if "user_view_allowed" in drafts.columns else F.lit(False)
    df = drafts.withColumns(
        {
            "title": F.btrim(F.regexp_extract(m, "(?m)^# (.+)$", 1)), "redundancy": redundancy(m), "signals": cognitive_signals(m),
            "unsupported": T.unsupported_numbers(m, F.col("source_text")), "boundary": source_boundary(m), "authority": authority_boundary(m, allowed),
            "output_language": T.draft_language(m), "source_language": T.draft_language(F.col("source_text")),
        }
    )
    c = F.col
    reasons = names(
        ((c("title") == "") | (F.lower("title") == "unknown") | c("title").startswith("#"), "generation_metadata_inconsistent"),
        (c("redundancy") == "high", "semantic_redundancy_high"),
        (F.size("signals") < 2, "insufficient_cognitive_delta"),
        (F.size("unsupported") > 0, "unsupported_factual_expansion"),
        (c("boundary") != "passed", "source_boundary_missing"),
        (c("authority.status") != "passed", "authority_boundary_missing_or_invalid"),
    )
    return df.withColumn("blocking_reasons", reasons).withColumn("publishable", F.size("blocking_reasons") == 0)
