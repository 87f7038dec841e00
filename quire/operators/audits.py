"""Lesson audits, coverage and comparisons of runs and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, tile_of_integer
from quire.operators.findings import broken_rules, finding, rule, union_all
from quire.operators.grounding import verify_spans

# ---------------------------------------------------------------------------
# Fixed values
PREVIEW_LIMIT = 300
UNSAFE = ["PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "SOURCE_DAMAGED"]
REQUIRED_CHAPTER_FIELDS = [
    "chapter_number", "chapter_title", "chapter_summary", "learning_objectives", "key_terms", "core_lessons",
    "practice_questions", "source_chunk_ids",
]
PRONUNCIATION_TERMS = [
    "pronunciation", "phonetic notation", "ipa", "word ending", "word endings", "-ed ending", "ed ending",
    "past-tense ending", "past tense ending",
]
DAMAGED_NOTATION = r"�|//|/(?:\s*)/"
# probe -> (all of, any of)
PROBE_ALIASES = {
    "wanted_pronunciation": (
        [], ["wanted", "-ed ending", "ed ending", "past-tense ending", "past tense ending", "regular past tense"],
    ),
    "spelling_zero_score": (
        [], ["spelling", "misspelled", "zero score", "write from dictation", "fill in the blanks", "partial credit"],
    ),
    "highlight_correct_summary": ([], ["highlight correct summary", "correct summary", "summary task"]),
    "essay_timing": (["essay"], ["time", "timing", "minute", "minutes", "time limit"]),
}
IMPORTANCES = ["HIGH", "MEDIUM", "LOW"]
CONCEPT_TYPES = [
    "official_rule", "task_format", "definition", "strategy", "language_rule", "practice_skill", "source_topic", "other",
]
SOURCE_CONDITIONS = ["CLEAR", "AMBIGUOUS", "DAMAGED"]
CONCEPTS_PER_CHAPTER = (4, 15)
SEMANTIC = ["SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "SOURCE_DAMAGED", "NOT_APPLICABLE"]
PEDAGOGICAL = ["USABLE", "NEEDS_REVISION", "MISLEADING", "NOT_APPLICABLE"]
ABSTENTION = ["JUSTIFIED", "OVERCAUTIOUS", "MISALIGNED", "NOT_APPLICABLE"]
# ---------------------------------------------------------------------------


def citation_audit(chunks: DataFrame, ideas: DataFrame, key: str = "lesson_id") -> DataFrame:
    """Findings of a lesson's citations (G11). Uncited chunks are noted, not errors.

    chunks: (key, i, node_id, text_preview); ideas: (key, i, idea, source_chunk_ids).
    """
    named = chunks.filter(~T.blank("node_id"))
    per_id = named.groupBy(key, "node_id").agg(F.count(F.lit(1)).alias("n"))
    cited = ideas.select(key, "i", F.explode("source_chunk_ids").alias("node_id"))
    parts = [
        finding(chunks.filter(T.blank("node_id")), "citations", "error", key, "BLANK_NODE_ID", F.col("i").cast("string")),
        finding(per_id.filter("n > 1"), "citations", "error", key, "DUPLICATE_CHUNK", F.col("node_id")),
        finding(chunks.filter(T.blank("text_preview")), "citations", "error", key, "MISSING_PREVIEW", F.coalesce("node_id", F.lit(""))),
        finding(
            ideas.filter(F.coalesce(F.size("source_chunk_ids"), F.lit(0)) <= 0), "citations", "error", key,
            "IDEA_WITHOUT_SOURCE", F.col("i").cast("string"),
        ),
        finding(
            cited.join(per_id.select(key, "node_id"), [key, "node_id"], "left_anti"), "citations", "error", key,
            "UNKNOWN_CITATION", F.concat_ws(":", F.col("i").cast("string"), F.coalesce("node_id", F.lit(""))),
        ),
        finding(
            named.join(cited.select(key, "node_id").distinct(), [key, "node_id"], "left_anti"), "citations", "note", key,
            "UNCITED_CHUNK", F.col("node_id"),
        ),
    ]
    return union_all(parts)


def citation_verdict(lessons: DataFrame, findings: DataFrame, key: str = "lesson_id") -> DataFrame:
    counts = findings.groupBy("key").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("code") == "UNCITED_CHUNK").alias("uncited")
    )
    return lessons.select(F.col(key).cast("string").alias("key")).join(counts, "key", "left").select(
        F.col("key").alias(key),
        F.when(F.coalesce("errors", F.lit(0)) == 0, "pass").otherwise("fail").alias("status"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("uncited", F.lit(0)).alias("uncited"),
    )


def section_lesson_findings(
    lessons: DataFrame, chunks: DataFrame, citations: DataFrame, titles: DataFrame, positions: DataFrame,
    key: str = "lesson_id",
) -> DataFrame:
    """Findings of a generated section lesson.

    lessons: (key, retrieved_chunk_count, resolved_chapter, filter_chapter, front_matter, requested_section,
    include_descendants, ordering, expanded_count, covered_count, missing_count, covered_titles, missing_titles);
    chunks: (key, i, node_id, text_preview, chapter_number, section, page_start, page_end);
    citations: (key, node_id); titles: (key, section); positions: (chapter_number, section, position).
    """
    fail = lambda df, code, detail="": finding(df, "section_lesson", "error", key, code, detail)
    warn = lambda df, code, detail="": finding(df, "section_lesson", "warning", key, code, detail)
    per_id = chunks.filter(~T.blank("node_id")).groupBy(key, "node_id").agg(F.count(F.lit(1)).alias("n"))
    totals = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
    scoped = titles.select(key, "section").distinct()
    title_counts = titles.groupBy(key).agg(F.count(F.lit(1)).alias("n_titles"), F.first("section").alias("one_title"))
    actual = chunks.join(scoped, [key, "section"], "left_semi").select(key, "section").distinct()
    head = lessons.join(totals, key, "left").join(title_counts, key, "left").na.fill(0, ["n_chunks", "n_titles"])
    inside = chunks.join(lessons.select(key, "resolved_chapter", "filter_chapter", "front_matter", "ordering", "requested_section"), key)
    wrong = lambda c: F.col(c).isNotNull() & ~F.col("chapter_number").eqNullSafe(F.col(c))
    stated = lambda c: lessons.select(key, F.explode(c).alias("section"))
    covered = stated("covered_titles").distinct()
    drift = actual.join(covered, [key, "section"], "left_anti").unionByName(covered.join(actual, [key, "section"], "left_anti"))

    # document order: each chunk against the one before it, in the stated order
    placed = chunks.join(positions, ["chapter_number", "section"], "left")
    number = lambda c: F.struct(F.col(c).isNull().alias("n"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("v"))
    sort_key = F.struct(
        number("chapter_number").alias("a"), number("position").alias("b"), number("page_start").alias("c"),
        number("page_end").alias("d"), F.coalesce("node_id", F.lit("")).alias("e"),
    )
    walked = ordered_scan(
        placed.withColumn("__k", sort_key), [key], ["i"], tile_of_integer("i"),
        {"__before": Scan("prev", F.col("__k")), "__page": Scan("prev", F.col("page_start"))},
    ).join(lessons.select(key, "ordering"), key)
    breaks = walked.filter((F.col("ordering") == "document") & (F.col("__before") > F.col("__k")))
    page_breaks = walked.filter((F.col("ordering") == "semantic") & (F.col("__page") > F.col("page_start"))).select(key).distinct()
    disordered = breaks.select(key).distinct()
    opening = chunks.groupBy(key).agg(F.min_by(F.struct("text_preview", "section", "node_id"), "i").alias("__first"))
    heading = lambda t: (T.match_text(t) != "") & F.contains(T.match_text("__first.text_preview"), T.match_text(t))
    contaminated = (
        head.filter((F.col("ordering") == "document") & ~T.blank("requested_section"))
        .join(disordered, key, "left_anti")
        .join(opening, key)
        .filter(~T.blank("__first.text_preview"))
        .filter(~(F.coalesce(heading("requested_section"), F.lit(False)) | F.coalesce(heading("__first.section"), F.lit(False))))
    )
    sums = F.col("covered_count") + F.col("missing_count") != F.col("expanded_count")
    return union_all(
        [
            fail(chunks.filter(T.blank("node_id")), "BLANK_NODE_ID", F.col("i").cast("string")),
            fail(per_id.filter("n > 1"), "DUPLICATE_CHUNK", F.col("node_id")),
            fail(head.filter(~F.col("retrieved_chunk_count").eqNullSafe(F.col("n_chunks"))), "CHUNK_COUNT_MISMATCH"),
            fail(citations.join(per_id, [key, "node_id"], "left_anti"), "INVALID_REFERENCE", F.coalesce("node_id", F.lit(""))),
            warn(chunks.filter(~T.blank("node_id")).join(citations.select(key, "node_id").distinct(), [key, "node_id"], "left_anti"), "UNCITED_CHUNK", F.col("node_id")),
            fail(inside.filter(wrong("resolved_chapter")), "CHAPTER_BOUNDARY", F.col("node_id")),
            fail(inside.filter(wrong("filter_chapter")), "CHAPTER_BOUNDARY", F.col("node_id")),
            fail(inside.filter(F.col("section").isNull() & ~F.coalesce("front_matter", F.lit(False))), "NO_SECTION", F.col("node_id")),
            fail(chunks.filter(F.col("section").isNotNull()).join(scoped, [key, "section"], "left_anti"), "OUT_OF_SCOPE_SECTION", F.col("node_id")),
            warn(
                head.filter(
                    ~T.blank("requested_section") & ~F.coalesce("include_descendants", F.lit(True)) & (F.col("n_titles") > 0)
                    & ((F.col("n_titles") != 1) | (F.col("one_title") != F.col("requested_section")))
                ),
                "EXACT_SECTION_EXPANDED",
            ),
            fail(head.filter(~F.col("expanded_count").eqNullSafe(F.col("n_titles"))), "COVERAGE_MISMATCH", "expanded_count"),
            fail(covered.join(scoped, [key, "section"], "left_anti"), "COVERAGE_MISMATCH", F.concat(F.lit("covered:"), F.col("section"))),
            fail(stated("missing_titles").distinct().join(scoped, [key, "section"], "left_anti"), "COVERAGE_MISMATCH", F.concat(F.lit("missing:"), F.col("section"))),
            fail(head.filter(sums), "COVERAGE_MISMATCH", "sum"),
            fail(drift.select(key).distinct(), "COVERAGE_MISMATCH", "actual"),
            fail(breaks, "ORDER_BREAK", F.col("node_id")),
            warn(page_breaks, "NOT_PAGE_SORTED"),
            fail(chunks.filter(T.blank("text_preview") & ~T.blank("node_id")), "MISSING_PREVIEW", F.col("node_id")),
            fail(chunks.filter(~T.blank("text_preview") & (F.length("text_preview") > PREVIEW_LIMIT)), "PREVIEW_TOO_LONG", F.col("node_id")),
            warn(contaminated, "FIRST_PREVIEW_WITHOUT_HEADING", F.coalesce("__first.node_id", F.lit(""))),
        ]
    )


def audit_status(subjects: DataFrame, findings: DataFrame, key: str = "lesson_id", strict: bool = False) -> DataFrame:
    """FAIL / PASS_WITH_WARNINGS / PASS."""
    counts = findings.groupBy("key").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    e, w = F.coalesce("errors", F.lit(0)), F.coalesce("warnings", F.lit(0))
    status = F.when((e > 0) | (F.lit(strict) & (w > 0)), "FAIL").when(w > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return subjects.select(F.col(key).cast("string").alias("key")).join(counts, "key", "left").select(
        F.col("key").alias(key), status.alias("status"), e.alias("errors"), w.alias("warnings")
    )


def concept_coverage(concepts: DataFrame, mapping: DataFrame, results: DataFrame) -> DataFrame:
    """Worst status of the claims mapped to each concept.

    concepts: (concept_id); mapping: (concept_id, claim_id); results: (claim_id, support_status).
    """
    joined = mapping.join(results, "claim_id")
    s = F.col("support_status")
    per = joined.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s != "NOT_A_FACTUAL_CLAIM").alias("factual"),
        F.bool_or(s.isin("UNSUPPORTED", "CONTRADICTED", "SOURCE_DAMAGED")).alias("unsafe"),
        F.bool_or(s == "PARTIALLY_SUPPORTED").alias("partial"),
    )
    status = (
        F.when(F.col("n").isNull(), "OMITTED")
        .when(F.col("factual") == 0, "ERROR_ONLY_NON_FACTUAL")
        .when(F.col("unsafe"), "COVERED_UNSAFELY")
        .when(F.col("partial"), "PARTIALLY_COVERED")
        .otherwise("COVERED_SAFELY")
    )
    return concepts.select("concept_id").join(per, "concept_id", "left").select(
        "concept_id", status.alias("coverage_status"), F.coalesce("n", F.lit(0)).alias("claims")
    )


def version_comparison(v1: DataFrame, v2: DataFrame, coverage: DataFrame, key: str = "book") -> DataFrame:
    """Safety, coverage and comparison verdicts of two versions of each book.

    v1: (key, support_status, severity); v2: (key, origin, semantic, pedagogical, abstention, severity);
    coverage: (key, importance, v2_status).
    """
    n = F.count_if
    sem, sev = F.col("semantic"), F.col("severity")
    grounded = F.col("origin") == "source_grounded"
    generated = F.col("origin") == "pedagogical_generation"
    withheld = ~grounded & ~generated
    old = v1.groupBy(key).agg(
        F.count(F.lit(1)).alias("v1_claims"),
        n(F.col("support_status").isin(UNSAFE) & (F.col("severity") == "HIGH")).alias("v1_high_unsafe"),
    )
    new = v2.groupBy(key).agg(
        F.count(F.lit(1)).alias("v2_records"),
        *[n(grounded & (sem == s)).alias(f"v2_{s.lower()}") for s in ["SUPPORTED"] + UNSAFE],
        n(grounded & sem.isin(UNSAFE) & (sev == "HIGH")).alias("v2_high_unsafe"),
        n(sem.isin(UNSAFE) & sev.isin("MEDIUM", "LOW")).alias("lesser_unsafe"),
        *[n(generated & (F.col("pedagogical") == s)).alias(s.lower()) for s in ("USABLE", "NEEDS_REVISION", "MISLEADING")],
        *[n(withheld & (F.col("abstention") == s)).alias(s.lower()) for s in ("JUSTIFIED", "OVERCAUTIOUS", "MISALIGNED")],
    )
    high, medium = F.col("importance") == "HIGH", F.col("importance") == "MEDIUM"
    st = F.col("v2_status")
    cov = coverage.groupBy(key).agg(
        F.count(F.lit(1)).alias("concepts"),
        n(high & (st == "SILENTLY_OMITTED")).alias("high_omitted"),
        n(high & (st == "COVERED_UNSAFELY")).alias("high_unsafe_concepts"),
        n(medium & (st == "SILENTLY_OMITTED")).alias("medium_omitted"),
        n(st == "PARTIALLY_COVERED").alias("partially_covered"),
        n(st == "SAFELY_WITHHELD").alias("safely_withheld"),
    )
    joined = old.join(new, key, "full_outer").join(cov, key, "full_outer").na.fill(0)
    c = F.col
    safety = (
        F.when((c("v2_high_unsafe") > 0) | (c("misleading") > 0) | (c("high_unsafe_concepts") > 0), "FAIL")
        .when(c("lesser_unsafe") + c("needs_revision") + c("overcautious") + c("misaligned") > 0, "PASS_WITH_WARNINGS")
        .otherwise("PASS")
    )
    covers = (
        F.when(c("high_omitted") + c("high_unsafe_concepts") > 0, "FAIL")
        .when(c("partially_covered") + c("medium_omitted") + c("safely_withheld") > 0, "PASS_WITH_WARNINGS")
        .otherwise("PASS")
    )
    better = c("v2_high_unsafe") < c("v1_high_unsafe")
    verdict = (
        F.when((c("safety") == "PASS") & (c("coverage") == "PASS") & better, "IMPROVED")
        .when(c("safety").isin("PASS", "PASS_WITH_WARNINGS") & (c("coverage") == "PASS_WITH_WARNINGS") & better,
              "IMPROVED_WITH_COVERAGE_WARNINGS")
        .otherwise("NOT_IMPROVED")
    )
    return joined.withColumn("safety", safety).withColumn("coverage", covers).withColumn("comparison", verdict)


def version_findings(v2: DataFrame, coverage: DataFrame, traces: DataFrame) -> DataFrame:
    """Ranked findings of the newer version.

    v2: (chapter_number, ord, record_id, origin, semantic, pedagogical, severity); coverage: (chapter_number, ord,
    concept_id, importance, v2_status); traces: (chapter_number, probe_id, v2_status).
    """
    row = lambda df, category, id, status, order: df.select(
        "chapter_number", category.alias("category"), F.col(id).alias("id"), F.col(status).alias("status"), order.alias("sort_index")
    )
    bad = ["SILENTLY_OMITTED", "COVERED_UNSAFELY"]
    return union_all(
        [
            row(v2.filter((F.col("origin") == "source_grounded") & (F.col("severity") == "HIGH") & F.col("semantic").isin(UNSAFE)),
                F.lit("HIGH_SEVERITY_UNSAFE_SOURCE_GROUNDED"), "record_id", "semantic", F.col("ord").cast("long")),
            row(v2.filter((F.col("origin") == "pedagogical_generation") & (F.col("pedagogical") == "MISLEADING")),
                F.lit("MISLEADING_PEDAGOGICAL_RECORD"), "record_id", "pedagogical", F.col("ord").cast("long")),
            row(coverage.filter((F.col("importance") == "HIGH") & F.col("v2_status").isin(bad)),
                F.concat(F.lit("HIGH_IMPORTANCE_"), F.col("v2_status")), "concept_id", "v2_status", F.col("ord").cast("long")),
            row(traces.filter(F.col("v2_status").isin(bad)), F.lit("KNOWN_PATTERN_TRACE_REMAINS_UNSAFE_OR_OMITTED"),
                "probe_id", "v2_status", F.lit(1000).cast("long")),
        ]
    ).orderBy("chapter_number", "category", "sort_index", "id")


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], section: str | None = None) -> DataFrame:
    """Full outer match of the chunks of two runs.

    old, new: (keys, node_id, text_preview, section, page_start); ``section`` names a column of the requested title.
    """
    fields = ["text_preview", "section", "page_start"]
    side = lambda df, p: df.select(*keys, "node_id", *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(f"in_{p}"))
    joined = side(old, "old").join(side(new, "new"), [*keys, "node_id"], "full_outer")
    start = lambda c: T.preview(c, 80, right_trim=False)
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(~F.col("old_text_preview").eqNullSafe(F.col("new_text_preview")), "changed")
        .otherwise("same")
    )
    return joined.select(
        *keys, "node_id", change.alias("change"), "old_section", "new_section", "old_page_start", "new_page_start",
        start("old_text_preview").alias("old_preview_start"), start("new_text_preview").alias("new_preview_start"),
    )


def starts_with_section(preview: Column, section: Column) -> Column:
    trimmed = F.regexp_replace(preview, rf"(?U)\A{T.SPACE}+", "")
    return F.when(~T.blank(section), F.startswith(trimmed, section))


def comparison_status(runs: DataFrame) -> DataFrame:
    """IMPROVED / SAME_PASS / REGRESSED / INCONCLUSIVE.

    runs: (key..., old_status, new_status, old_warnings, new_warnings, new_failures, old_starts, new_starts).
    """
    unknown = F.col("old_status").isNull() | F.col("new_status").isNull()
    clean = F.col("new_status").isin("PASS", "PASS_WITH_WARNINGS") & (F.coalesce("new_failures", F.lit(0)) == 0)
    more = F.col("new_warnings") > F.col("old_warnings")
    fewer = F.col("new_warnings") < F.col("old_warnings")
    opened = F.col("new_starts") & ~F.col("old_starts")
    no = lambda c: F.coalesce(c, F.lit(False))
    status = (
        F.when(unknown, "INCONCLUSIVE")
        .when(~no(clean), "REGRESSED")
        .when(no(more), "REGRESSED")
        .when(no(fewer) | no(opened), "IMPROVED")
        .otherwise("SAME_PASS")
    )
    return runs.withColumn("status", status)


def same_fields(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Metadata equality per field (G19), nulls equal."""
    joined = old.select(*keys, *[F.col(f).alias(f"o_{f}") for f in fields]).join(
        new.select(*keys, *[F.col(f).alias(f"n_{f}") for f in fields]), keys, "full_outer"
    )
    return joined.select(*keys, *[F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")).alias(f"same_{f}") for f in fields])


def material_findings(books: DataFrame, chapters: DataFrame, chunks: DataFrame, references: DataFrame, key: str = "book") -> DataFrame:
    """Findings of a book's learning materials.

    books: (key, detected_chapters, max_chapters or null); chapters: (key, chapter_number, fields array of present
    names); chunks: (key, node_id); references: (key, node_id).
    """
    made = chapters.groupBy(key).agg(F.count(F.lit(1)).alias("made"))
    held = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("held"))
    head = books.join(made, key, "left").join(held, key, "left").na.fill(0, ["made", "held"])
    limited = F.col("max_chapters").isNotNull()
    wanted = F.array(*[F.lit(f) for f in REQUIRED_CHAPTER_FIELDS])
    lacking = F.array_except(wanted, F.col("fields"))
    unknown = references.filter(~T.blank("node_id")).select(key, "node_id").distinct().join(
        chunks.select(key, "node_id").distinct(), [key, "node_id"], "left_anti"
    )
    name = "materials"
    return union_all(
        [
            finding(head.filter("made = 0"), name, "error", key, "NO_CHAPTERS"),
            finding(head.filter("held = 0"), name, "error", key, "NO_SOURCE_CHUNKS"),
            finding(unknown, name, "error", key, "INVALID_REFERENCE", F.col("node_id")),
            finding(chapters.filter(F.size(lacking) > 0), name, "error", key, "MISSING_CHAPTER_FIELDS",
                    F.concat_ws(":", F.col("chapter_number").cast("string"), F.array_join(lacking, ","))),
            finding(head.filter(~limited & (F.col("made") != F.col("detected_chapters"))), name, "error", key, "CHAPTER_COUNT_MISMATCH"),
            finding(head.filter(limited & (F.col("made") < F.col("detected_chapters"))), name, "warning", key, "PARTIAL_GENERATION"),
        ]
    )


def source_noise(concepts: DataFrame) -> DataFrame:
    """Damaged pronunciation notation in a concept's quotes, and the probes it matches.

    concepts: (concept_id, title, description, quotes array<string>).
    """
    text = F.lower(T.squash(F.concat_ws(" ", "title", "description", F.array_join("quotes", " "))))
    spoken = T.any_contains(text, PRONUNCIATION_TERMS)
    damaged = spoken & F.exists("quotes", lambda q: q.rlike(f"(?U){DAMAGED_NOTATION}"))
    probes = F.filter(
        F.array(
            *[
                F.when(
                    F.forall(F.array(*[F.lit(t) for t in required]).cast("array<string>"), lambda t: F.contains(text, t))
                    & T.any_contains(text, any_of),
                    F.lit(name),
                )
                for name, (required, any_of) in PROBE_ALIASES.items()
            ]
        ),
        lambda p: p.isNotNull(),
    )
    return concepts.select("concept_id", F.coalesce(damaged, F.lit(False)).alias("damaged_notation"), probes.alias("probes"))


def inventory_problems(concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Faults of concept inventories (G27): (chapter_number, concept_id, code).

    concepts: (chapter_number, i from 1, concept_id, importance, concept_type, source_condition, title, description,
    source_chunk_ids, evidence_spans array<struct<node_id, quote>>); chunks: (chapter_number, node_id, text).
    """
    among = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    wanted = F.format_string("chapter_%02d.concept_%02d", F.col("chapter_number").cast("int"), F.col("i").cast("int"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rules = [
        rule(~F.col("concept_id").eqNullSafe(wanted), "WRONG_CONCEPT_ID", "", ""),
        rule(~among("importance", IMPORTANCES), "INVALID_IMPORTANCE", "", ""),
        rule(~among("concept_type", CONCEPT_TYPES), "INVALID_CONCEPT_TYPE", "", ""),
        rule(~among("source_condition", SOURCE_CONDITIONS), "INVALID_SOURCE_CONDITION", "", ""),
        rule(T.blank("title"), "BLANK_TITLE", "", ""),
        rule(T.blank("description"), "BLANK_DESCRIPTION", "", ""),
        rule(size("source_chunk_ids") <= 0, "NO_SOURCE_IDS", "", ""),
        rule(size("evidence_spans") <= 0, "NO_EVIDENCE_SPAN", "", ""),
    ]
    keys = ["chapter_number", "concept_id"]
    shape = broken_rules(concepts, rules, keys).select(*keys, "code")
    low, high = CONCEPTS_PER_CHAPTER
    counts = concepts.groupBy("chapter_number").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("n").between(low, high))
    counted = counts.select("chapter_number", F.lit(None).cast("string").alias("concept_id"), F.lit("CONCEPT_COUNT").alias("code"))
    ids = concepts.select(*keys, F.explode("source_chunk_ids").alias("raw")).withColumn("node_id", T.strip("raw"))
    outside = ids.join(chunks.select("chapter_number", "node_id").distinct(), ["chapter_number", "node_id"], "left_anti")
    spans = concepts.select(
        F.struct(*keys).alias("claim_id"), F.posexplode("evidence_spans").alias("i", "s"), F.col("source_chunk_ids").alias("source_ids")
    ).select("claim_id", "i", F.col("s.node_id").alias("node_id"), F.col("s.quote").alias("quote"), "source_ids")
    faults = verify_spans(spans, chunks.select("node_id", "text")).select("claim_id.*", F.explode("codes").alias("code"))
    return union_all([shape, counted, outside.select(*keys, F.lit("SOURCE_ID_OUTSIDE_CHAPTER").alias("code")), faults.select(*keys, "code")])


def evaluation_problems(records: DataFrame, evaluations: DataFrame) -> DataFrame:
    """First fault per record of a chapter evaluation (G27): (record_id, code).

    records: (record_id, origin, allowed_ids); evaluations: (record_id, semantic, pedagogical, abstention, severity,
    confidence, rationale, evidence_ids). Each record is judged exactly once, on the one scale its origin has.
    """
    times = evaluations.groupBy("record_id").agg(F.count(F.lit(1)).alias("__times"))
    joined = evaluations.join(times, "record_id").join(records.withColumn("__known", F.lit(True)), "record_id", "full_outer")
    among = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    na = lambda c: F.col(c) == "NOT_APPLICABLE"
    s, p, a = na("semantic"), na("pedagogical"), na("abstention")
    fits = (
        F.when(F.col("origin") == "source_grounded", ~s & p & a)
        .when(F.col("origin") == "pedagogical_generation", s & ~p & a)
        .otherwise(s & p & ~a)
    )
    none = F.array().cast("array<string>")
    code = T.first_reason(
        [
            (F.col("__times").isNull(), "MISSING_EVALUATION"),
            (F.col("__known").isNull(), "UNKNOWN_RECORD"),
            (F.col("__times") > 1, "DUPLICATE_EVALUATION"),
            (~(among("semantic", SEMANTIC) & among("pedagogical", PEDAGOGICAL) & among("abstention", ABSTENTION)), "INVALID_STATUS"),
            (~fits, "STATUS_DOES_NOT_FIT_ORIGIN"),
            (~among("severity", IMPORTANCES), "INVALID_SEVERITY"),
            (~among("confidence", IMPORTANCES), "INVALID_CONFIDENCE"),
            (T.blank("rationale"), "BLANK_RATIONALE"),
            (F.size(F.array_except(F.coalesce("evidence_ids", none), F.coalesce("allowed_ids", none))) > 0, "EVIDENCE_NOT_ALLOWED"),
        ]
    )
    return joined.select("record_id", code.alias("code")).filter(F.col("code").isNotNull()).distinct()
