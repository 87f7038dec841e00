"""Document contract rules written as row-local rule arrays (G5, G7 counts, G13, G21, G29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.findings import broken_rules, rule, union_all
from quire.operators.grounding import GENERATED_KINDS, HIGH_RISK_KINDS, source_id_errors, verify_spans

# ---------------------------------------------------------------------------
# Fixed values
ORIGINS = ["source_grounded", "pedagogical_generation", "insufficient_source_evidence"]
CLAIM_KINDS = [
    "source_summary", "learning_objective", "definition", "official_rule", "task_format", "strategy",
    "factual_explanation", "pronunciation_rule", "grammar_rule", "pedagogical_example", "misconception_statement",
    "misconception_correction", "practice_question", "practice_answer", "learner_instruction", "self_assessment",
    "study_plan", "other",
]
GENERATED_TOO = ["pedagogical_generation", "source_grounded", "insufficient_source_evidence"]
SOURCE_ONLY = ["source_grounded", "insufficient_source_evidence"]
RULE_KINDS = ["official_rule", "task_format", "pronunciation_rule", "grammar_rule"]
# field -> (allowed kinds, allowed origins)
FIELD_POLICY = {
    "estimated_study_time": (["study_plan"], GENERATED_TOO),
    "chapter_summary": (["source_summary"], SOURCE_ONLY),
    "learning_objectives": (["learning_objective"], SOURCE_ONLY),
    "key_terms.meaning": (["definition"], SOURCE_ONLY),
    "core_lessons.explanation": (["source_summary", "strategy", "factual_explanation"] + RULE_KINDS, SOURCE_ONLY),
    "worked_examples.example": (["pedagogical_example"], GENERATED_TOO),
    "worked_examples.explanation": (["strategy", "factual_explanation"] + RULE_KINDS, SOURCE_ONLY),
    "common_misconceptions.misconception": (["misconception_statement"], GENERATED_TOO),
    "common_misconceptions.correction": (["misconception_correction"], SOURCE_ONLY),
    "practice_questions.question": (["practice_question"], GENERATED_TOO),
    "practice_questions.answer": (["practice_answer"], GENERATED_TOO),
    "review_checklist": (["self_assessment"], GENERATED_TOO),
}
GROUNDED_FIELDS = [
    "text", "claim_kind", "origin", "source_chunk_ids", "grounded_in_source_chunk_ids", "evidence_spans", "reason",
]
CONFIDENCE_VALUES = ["high", "medium", "low"]
RESPONSE_FIELDS = ["answer", "source_chunk_ids", "confidence", "follow_up_questions"]
NOT_ENOUGH_PHRASE = "not provide enough information"
MINIMUMS = {
    "learning_objectives": (3, "TOO_FEW_LEARNING_OBJECTIVES"),
    "key_terms": (3, "TOO_FEW_KEY_TERMS"),
    "core_lessons": (4, "TOO_FEW_CORE_LESSONS"),
    "worked_examples": (2, "TOO_FEW_WORKED_EXAMPLES"),
    "practice_questions": (3, "TOO_FEW_PRACTICE_QUESTIONS"),
    "review_checklist": (4, "TOO_FEW_REVIEW_CHECKLIST_ITEMS"),
}
FILLER_TEXTS = [
    "review the cited source excerpt.", "the source excerpt provides the local evidence.",
    "study the source material.", "read the source and answer the question.",
    "this lesson is based on the source excerpt.",
]
VERDICTS = ["faithful", "unfaithful"]
TRANSFORMATIONS = [
    "demonstration_to_statement", "simplified_restatement", "condensed_summary", "usage_to_definition",
]
DISPOSITIONS = ["candidate", "omitted"]
DIAGRAM_SOURCES = ["worked_examples.", "exercises."]
# ---------------------------------------------------------------------------


def _policy(field: Column, part: int) -> Column:
    pairs = []
    for name, allowed in FIELD_POLICY.items():
        pairs += [F.lit(name), F.array(*[F.lit(v) for v in allowed[part]])]
    return F.element_at(F.create_map(*pairs), field)


def grounded_errors(contents: DataFrame, chunks: DataFrame, normalise=T.contract_text) -> DataFrame:
    """All broken rules of grounded content (G5, with G6 and G7 for its ids and spans).

    contents: (claim_id, path, field, chapter_number, book_pdf, missing_fields, text, claim_kind, origin,
    source_chunk_ids, grounded_in_source_chunk_ids, evidence_spans, reason).
    """
    kind, origin, path = F.col("claim_kind"), F.col("origin"), F.col("path")
    at = lambda leaf: F.concat(path, F.lit(f".{leaf}"))
    known_kind = F.coalesce(kind.isin(CLAIM_KINDS), F.lit(False))
    known_origin = F.coalesce(origin.isin(ORIGINS), F.lit(False))
    kinds, origins = _policy(F.col("field"), 0), _policy(F.col("field"), 1)
    risky = F.coalesce(kind.isin(HIGH_RISK_KINDS), F.lit(False))
    cited = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: ~T.blank(v))) > 0
    ids, grounded = cited("source_chunk_ids"), cited("grounded_in_source_chunk_ids")
    spans = F.coalesce(F.size("evidence_spans"), F.lit(0)) > 0
    g, p, n = (origin == o for o in ORIGINS)
    combo = "INVALID_ORIGIN_FIELD_COMBINATION"
    whole = F.coalesce(F.size("missing_fields"), F.lit(0)) == 0
    rules = [
        rule(~whole, "INVALID_GROUNDED_CONTENT_SHAPE", path,
             F.concat(F.lit("Missing grounded-content fields: "), F.array_join(F.array_sort("missing_fields"), ", "))),
        rule(whole & ~known_kind, "INVALID_CLAIM_KIND", at("claim_kind"), "Unknown claim kind."),
        rule(whole & known_kind & ~F.array_contains(kinds, kind), "INVALID_CLAIM_KIND", at("claim_kind"),
             "Claim kind is not allowed for this field."),
        rule(whole & ~known_origin, "INVALID_ORIGIN", at("origin"), "Unknown origin."),
        rule(whole & known_origin & ~F.array_contains(origins, origin), "PEDAGOGICAL_ORIGIN_NOT_ALLOWED", at("origin"),
             "Origin is not allowed for this field."),
        rule(whole & risky & p, "HIGH_RISK_PEDAGOGICAL_GENERATION_FORBIDDEN", path, "High-risk kind cannot be generated."),
        rule(whole & p & ~F.coalesce(kind.isin(GENERATED_KINDS), F.lit(False)), "PEDAGOGICAL_ORIGIN_NOT_ALLOWED", path,
             "Generation is not allowed for this claim kind."),
        rule(whole & F.col("evidence_spans").isNull(), "INVALID_GROUNDED_CONTENT_SHAPE", at("evidence_spans"),
             "evidence_spans must be an array."),
        rule(whole & (g | p) & T.blank("text"), combo, at("text"), "text must be a non-empty string."),
        rule(whole & g & ~ids, combo, at("source_chunk_ids"), "source_grounded content must cite a source chunk."),
        rule(whole & g & ~ids & F.col("chapter_number").isNotNull(), "INHERITED_CITATION_NOT_SUPPORTED", at("source_chunk_ids"),
             "Chapter content must carry its own source ids."),
        rule(whole & (g | n) & grounded, combo, at("grounded_in_source_chunk_ids"), "must not use grounded_in_source_chunk_ids."),
        rule(whole & (g | p) & F.col("reason").isNotNull(), combo, at("reason"), "reason must be null."),
        rule(whole & g & risky & ~spans, "HIGH_RISK_EVIDENCE_SPAN_REQUIRED", at("evidence_spans"),
             "High-risk source_grounded content requires an evidence span."),
        rule(whole & (p | n) & ids, combo, at("source_chunk_ids"), "must not use source_chunk_ids."),
        rule(whole & (p | n) & spans, combo, at("evidence_spans"), "must not use evidence_spans."),
        rule(whole & n & F.col("text").isNotNull(), combo, at("text"), "insufficient_source_evidence text must be null."),
        rule(whole & n & T.blank("reason"), "MISSING_INSUFFICIENT_EVIDENCE_REASON", at("reason"), "A reason is required."),
    ]
    shape = broken_rules(contents, rules, ["claim_id"])
    complete = contents.filter(whole)
    id_rows = union_all(
        [
            complete.select("claim_id", at(c).alias("json_path"), "chapter_number", "book_pdf", F.col(c).alias("ids"))
            for c in ("source_chunk_ids", "grounded_in_source_chunk_ids")
        ]
    )
    id_errors = source_id_errors(id_rows, chunks).select(
        "claim_id", "code", "json_path", F.coalesce("node_id", F.lit("")).alias("message")
    )
    span_rows = complete.select(
        "claim_id", "path", F.col("source_chunk_ids").alias("source_ids"), F.posexplode("evidence_spans").alias("i", "s")
    ).select("claim_id", "path", "source_ids", "i", F.col("s.node_id").alias("node_id"), F.col("s.quote").alias("quote"))
    checked = verify_spans(span_rows.drop("path"), chunks, normalise)
    span_errors = (
        checked.select("claim_id", "i", "node_id", F.explode("codes").alias("code"))
        .join(complete.select("claim_id", "path"), "claim_id")
        .select(
            "claim_id", "code",
            F.concat("path", F.lit(".evidence_spans["), F.col("i").cast("string"), F.lit("]")).alias("json_path"),
            F.coalesce("node_id", F.lit("")).alias("message"),
        )
    )
    return union_all([shape, id_errors, span_errors])


def contract_summary(contents: DataFrame, errors: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: counts by origin, high-risk counts, verified spans, failing claims."""
    totals = contents.agg(
        F.count(F.lit(1)).alias("grounded_content_count"),
        *[F.count_if(F.col("origin") == o).alias(f"{o}_count") for o in ORIGINS],
        F.count_if(F.col("claim_kind").isin(HIGH_RISK_KINDS)).alias("high_risk_claim_count"),
    )
    failing = errors.agg(F.count_distinct("claim_id").alias("invalid_claim_count"), F.count(F.lit(1)).alias("error_count"))
    spans = verified.agg(F.count_if(F.col("verified")).alias("verified_evidence_span_count"))
    return totals.crossJoin(failing).crossJoin(spans)


def answer_errors(responses: DataFrame) -> DataFrame:
    """First broken rule of each answer.

    responses: (response_id, fields, answer, source_chunk_ids, confidence, follow_up_questions, allowed_ids);
    ``fields`` are the top-level names the response had.
    """
    ids = F.transform("source_chunk_ids", lambda v: T.strip(v))
    follow = F.transform("follow_up_questions", lambda v: T.strip(v))
    lacking = F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit(NOT_ENOUGH_PHRASE))
    wanted = F.array(*[F.lit(f) for f in RESPONSE_FIELDS])
    repeats = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    any_blank = lambda a: F.exists(a, lambda v: v.isNull() | (v == ""))
    low = F.col("confidence") == "low"
    code = T.first_reason(
        [
            (F.size(F.array_except("fields", wanted)) > 0, "unexpected_fields"),
            (F.size(F.array_except(wanted, F.col("fields"))) > 0, "missing_fields"),
            (T.blank("answer"), "blank_answer"),
            (F.col("source_chunk_ids").isNull(), "ids_not_a_list"),
            (any_blank(ids), "blank_id"),
            (repeats(ids), "duplicate_id"),
            (F.size(F.array_except(ids, F.col("allowed_ids"))) > 0, "unknown_id"),
            (~F.coalesce(F.col("confidence").isin(CONFIDENCE_VALUES), F.lit(False)), "invalid_confidence"),
            (F.col("follow_up_questions").isNull() | ~F.size(follow).between(2, 3), "follow_up_count"),
            (any_blank(follow), "blank_follow_up"),
            (repeats(follow), "duplicate_follow_up"),
            ((F.size(ids) > 0) & lacking & low, "insufficient_answer_cites"),
            ((F.size(ids) == 0) & ~lacking, "supported_answer_without_citation"),
            ((F.size(ids) == 0) & lacking & ~low, "insufficient_answer_not_low"),
        ]
    )
    return responses.withColumn("code", code)


def split_provenance(responses: DataFrame) -> DataFrame:
    """Citations split into lesson and fallback sets, which may not overlap.

    responses: (response_id, source_chunk_ids, lesson_ids, fallback_ids).
    """
    overlap = F.size(F.array_intersect("lesson_ids", "fallback_ids")) > 0
    lesson = F.filter("source_chunk_ids", lambda v: F.array_contains("lesson_ids", v))
    fallback = F.filter("source_chunk_ids", lambda v: F.array_contains("fallback_ids", v))
    return responses.select(
        "response_id",
        F.when(~overlap, lesson).alias("lesson_source_chunk_ids"),
        F.when(~overlap, fallback).alias("retrieved_source_chunk_ids"),
        F.when(~overlap, F.concat(lesson, fallback)).alias("source_chunk_ids"),
        F.when(overlap, "source_sets_overlap").alias("code"),
    )


def substantive_errors(contents: DataFrame, allowed: DataFrame, key: str = "chapter") -> DataFrame:
    """Chapters too thin to publish.

    contents: (key, field, item, text, origin, source_chunk_ids) with one row per grounded text and ``item``
    the list position; allowed: (key, node_id).
    """
    root = F.split_part("field", F.lit("."), F.lit(1))
    counts = contents.groupBy(key).agg(
        *[F.count_distinct(F.when(root == f, F.col("item"))).alias(f"n_{f}") for f in MINIMUMS]
    )
    few = broken_rules(
        counts,
        [
            rule(F.col(f"n_{f}") < n, code, F.lit(f), F.concat(F.lit(f"needs {n}, has "), F.col(f"n_{f}").cast("string")))
            for f, (n, code) in MINIMUMS.items()
        ],
        [key],
    )
    filler = contents.filter(T.match_text("text").isin(FILLER_TEXTS)).select(
        key, F.lit("GENERIC_PLACEHOLDER_TEXT").alias("code"),
        F.concat("field", F.lit("["), F.col("item").cast("string"), F.lit("]")).alias("json_path"),
        F.lit("filler").alias("message"),
    )
    pool = allowed.select(key, "node_id").distinct()
    used = (
        contents.filter(F.col("origin") == "source_grounded")
        .select(key, F.explode("source_chunk_ids").alias("node_id"))
        .distinct()
        .withColumn("__used", F.lit(True))
    )
    cover = pool.join(used, [key, "node_id"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("__pool"), F.count_if(F.col("__used")).alias("__n")
    )
    thin = cover.filter(
        ((F.col("__pool") < 4) & (F.col("__n") < F.col("__pool"))) | ((F.col("__pool") >= 4) & (F.col("__n") < 4))
    ).select(
        key, F.lit("INSUFFICIENT_SOURCE_CHUNK_COVERAGE").alias("code"), F.lit("").alias("json_path"),
        F.concat(F.col("__n").cast("string"), F.lit(" of "), F.col("__pool").cast("string")).alias("message"),
    )
    return union_all([few, filler, thin])


def approval_problems(approvals: DataFrame, key: str = "manifest_id") -> DataFrame:
    """Everything wrong with approval rows.

    approvals: (key, i, claim_path, claim_hash, source_content_revision, source_chunk_ids, transformation_type,
    verdict, reviewer struct<id, name, kind>).
    """
    where = F.concat(F.lit("approvals["), F.col("i").cast("string"), F.lit("]"))
    text_fields = ["claim_path", "claim_hash", "source_content_revision", "transformation_type", "verdict"]
    firsts = approvals.filter(F.coalesce("claim_path", F.lit("")) != "").groupBy(key, "claim_path").agg(F.min("i").alias("__first"))
    rows = approvals.join(firsts, [key, "claim_path"], "left")
    reviewer = lambda f: F.col(f"reviewer.{f}")
    known = F.col("reviewer").isNotNull()
    rules = [rule(T.blank(f), "MISSING_FIELD", where, f) for f in text_fields]
    rules += [
        rule(F.col("source_chunk_ids").isNull(), "MISSING_FIELD", where, "source_chunk_ids"),
        rule(~known, "MISSING_FIELD", where, "reviewer"),
        rule(F.col("i") > F.col("__first"), "SECOND_APPROVAL", where, F.col("claim_path")),
        rule(~F.col("verdict").isin(VERDICTS), "UNKNOWN_VERDICT", where, F.col("verdict")),
        rule(~F.col("transformation_type").isin(TRANSFORMATIONS), "UNKNOWN_TRANSFORMATION", where, F.col("transformation_type")),
        rule(F.coalesce(F.size("source_chunk_ids"), F.lit(0)) <= 0, "NO_SOURCE_CHUNKS", where, ""),
        rule(F.exists("source_chunk_ids", lambda v: T.blank(v)), "BLANK_SOURCE_CHUNK", where, ""),
        rule(known & T.blank("reviewer.id"), "REVIEWER_FIELD", where, "id"),
        rule(known & T.blank("reviewer.name"), "REVIEWER_FIELD", where, "name"),
        rule(known & ~reviewer("kind").eqNullSafe("human"), "REVIEWER_NOT_HUMAN", where, F.coalesce(reviewer("kind"), F.lit(""))),
    ]
    return broken_rules(rows, rules, [key])


def recommendation_problems(rows: DataFrame, key: str = "manifest_id") -> DataFrame:
    """Everything wrong with advisory rows.

    rows: (key, i, disposition, omission_reason, verdict, recommended_verdict, rationale, recommended_by struct<id, name, kind>).
    """
    where = F.concat(F.lit("recommendations["), F.col("i").cast("string"), F.lit("]"))
    d, author = F.col("disposition"), F.col("recommended_by")
    rules = [
        rule(~F.coalesce(d.isin(DISPOSITIONS), F.lit(False)), "UNKNOWN_DISPOSITION", where, ""),
        rule((d == "omitted") & T.blank("omission_reason"), "OMITTED_WITHOUT_REASON", where, ""),
        rule((d == "candidate") & ~T.blank("omission_reason"), "CANDIDATE_WITH_REASON", where, ""),
        rule(F.col("verdict").isNotNull(), "CARRIES_VERDICT", where, ""),
        rule(~F.coalesce(F.col("recommended_verdict").isin(VERDICTS), F.lit(False)), "UNKNOWN_VERDICT", where, ""),
        rule(T.blank("rationale"), "NO_RATIONALE", where, ""),
        rule(author.isNull(), "NO_AUTHOR", where, ""),
        rule(author.isNotNull() & ~F.col("recommended_by.kind").eqNullSafe("ai_assisted"), "AUTHOR_KIND", where, ""),
        rule(author.isNotNull() & T.blank("recommended_by.id"), "AUTHOR_FIELD", where, "id"),
        rule(author.isNotNull() & T.blank("recommended_by.name"), "AUTHOR_FIELD", where, "name"),
    ]
    return broken_rules(rows, rules, [key])


def manifest_problems(
    manifests: DataFrame, concepts: DataFrame, alignments: DataFrame, resources: DataFrame, assets: DataFrame,
    key: str = "manifest_id",
) -> DataFrame:
    """Gaps of export manifests, one row each."""
    head = broken_rules(
        manifests,
        [rule(T.blank(f), "MISSING", F.lit(f"lesson.{f}"), "") for f in ("stable_key", "title", "domain")]
        + [
            rule(T.blank("generator_version"), "MISSING", "teaching_document.generator_version", ""),
            rule(T.blank("framework_key"), "MISSING", "competency_framework.stable_key", ""),
            rule(T.blank("framework_title"), "MISSING", "competency_framework.title", ""),
            rule(~F.coalesce("approved", F.lit(False)), "UNAPPROVED", "approved", ""),
        ],
        [key],
    )
    empty = manifests.join(concepts.select(key).distinct(), key, "left_anti").select(
        key, F.lit("EMPTY").alias("code"), F.lit("concepts").alias("json_path"), F.lit("").alias("message")
    )
    path = lambda name: F.concat(F.lit(f"{name}."), F.col("i").cast("string"))
    field = lambda name, f: rule(T.blank(f), "MISSING", F.concat(path(name), F.lit(f".{f}")), "")
    bad_concepts = broken_rules(concepts, [field("concepts", f) for f in ("stable_key", "statement", "objective_type")], [key])
    known = concepts.filter(~T.blank("stable_key")).select(key, T.strip("stable_key").alias("objective_stable_key")).distinct()
    bad_alignments = broken_rules(alignments, [field("alignments", f) for f in ("objective_stable_key", "alignment_role")], [key])
    undeclared = (
        alignments.filter(~T.blank("objective_stable_key"))
        .withColumn("objective_stable_key", T.strip("objective_stable_key"))
        .join(known, [key, "objective_stable_key"], "left_anti")
        .select(key, F.lit("UNDECLARED_CONCEPT").alias("code"), path("alignments").alias("json_path"), F.col("objective_stable_key").alias("message"))
    )
    bad_resources = broken_rules(
        resources,
        [field("resources", "stable_key"), rule(F.coalesce("elements", F.lit(0)) == 0, "EMPTY", F.concat(path("resources"), F.lit(".elements")), "")],
        [key],
    )
    bad_assets = broken_rules(
        assets, [field("assets", f) for f in ("stable_key", "media_type", "alt_text", "caption", "illustrates", "provenance")], [key]
    )
    return union_all([head, empty, bad_concepts, bad_alignments, undeclared, bad_resources, bad_assets])


def unresolved_elements(references: DataFrame, leaves: DataFrame, key: str = "manifest_id") -> DataFrame:
    """Manifest paths that lead nowhere in the chapter.

    leaves: (key, path) of every node of the chapter document, inner nodes included.
    """
    return references.join(leaves.select(key, "path").distinct(), [key, "path"], "left_anti")
