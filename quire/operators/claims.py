"""Claims as rows: flattening, citations, batches, severity and verdict roll-ups
(G1, G2, G4, G14-G16, G25, G27, G28)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, salted_join, tile_of_integer
from quire.operators.findings import broken_rules, rule

# ---------------------------------------------------------------------------
# Fixed values
GROUNDED_ORIGINS = ["source_grounded", "pedagogical_generation", "insufficient_source_evidence"]
# field, nested field (None = the item itself), claim type, takes the chapter's ids, keys an object item's text may have
CHAPTER_FIELDS = [
    ("learning_objectives", None, "learning_objective", True, ["text", "objective", "description"]),
    ("key_terms", "meaning", "key_term_definition", False, []),
    ("core_lessons", "explanation", "core_lesson_explanation", False, []),
    ("worked_examples", "example", "worked_example_content", False, []),
    ("worked_examples", "explanation", "worked_example_explanation", False, []),
    ("common_misconceptions", "misconception", "misconception_statement", False, []),
    ("common_misconceptions", "correction", "misconception_correction", False, []),
    ("practice_questions", "answer", "practice_answer", False, []),
    ("review_checklist", None, "review_checklist_item", True, ["text", "item"]),
]
CONTEXT_KEY = {
    "key_terms": "term", "core_lessons": "title", "worked_examples": "title", "practice_questions": "question",
}
# where a book's chapters may stand, first wins
CHAPTER_ROOTS = ["$.learning_materials.chapters", "$.learning_materials.chapter_packages", "$.chapter_packages"]
BOOK_TEXT_FIELDS = [("book_overview", "book_overview"), ("summary", "book_summary"), ("overview", "book_overview")]
BOOK_LIST_FIELDS = [
    ("who_this_is_for", None, "audience_item", ["text", "description"]),
    ("how_to_use_this_book", None, "usage_instruction", ["text", "instruction"]),
    ("global_key_terms", "meaning", "global_key_term_definition", []),
]
SUPPORT_STATUSES = [
    "SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "SOURCE_DAMAGED", "NOT_A_FACTUAL_CLAIM",
]
FINDING_STATUSES = ["PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "SOURCE_DAMAGED"]
STATUS_PRIORITY = ["CONTRADICTED", "SOURCE_DAMAGED", "UNSUPPORTED", "PARTIALLY_SUPPORTED"]
CLAIM_NATURES = [
    "official_rule", "task_format", "definition", "source_summary", "strategy", "factual_explanation",
    "pedagogical_example", "learner_instruction", "self_assessment", "study_plan", "other",
]
LEVELS = ["HIGH", "MEDIUM", "LOW"]
ACTIONS = {
    "SUPPORTED": "keep",
    "PARTIALLY_SUPPORTED": "rewrite_with_supported_scope",
    "UNSUPPORTED": "rewrite_or_remove",
    "CONTRADICTED": "remove_or_correct",
    "SOURCE_DAMAGED": "inspect_source_and_regenerate",
    "NOT_A_FACTUAL_CLAIM": "keep_but_label_generated_when_needed",
}
HIGH_RISK_IDS = [
    "chapter_02.worked_examples.2.explanation", "chapter_15.key_terms.1.meaning",
    "chapter_11.common_misconceptions.2.correction", "chapter_16.core_lessons.4.explanation",
]
HIGH_RISK_WORDS = (
    "score|scoring|zero score|partial credit|time limit|timed|minutes?|word limit|words?|sentence or less|"
    "response format|must|mandatory|listening|reading|writing|speaking|pronunciation|grammar|spelling|essay|"
    "dictation|test takers?|pte academic"
)
# ---------------------------------------------------------------------------

CHAPTER_SCHEMA = (
    "chapter_number string, chapter_title string, chapter_summary string, source_chunk_ids array<string>, "
    + ", ".join(sorted({f"{f[0]} array<string>" for f in CHAPTER_FIELDS}))
    + ", estimated_study_time_minutes string"
)
BOOK_SCHEMA = (
    "book_overview string, summary string, overview string, source_chunk_ids array<string>, "
    + ", ".join(f"{f[0]} array<string>" for f in BOOK_LIST_FIELDS)
    + ", study_plan array<string>, final_review string"
)


def _json(value: Column, path: str) -> Column:
    return F.get_json_object(value, f"$.{path}")


def _ids(value: Column) -> Column:
    """Ids of a container that has the field; null when it has none."""
    return F.from_json(_json(value, "source_chunk_ids"), "array<string>")


def _is_object(value: Column) -> Column:
    return F.startswith(F.ltrim(value), F.lit("{"))


def _nonblank(value: Column) -> Column:
    return T.bound(value, lambda v: F.when(~T.blank(v), v))


def unwrap_grounded(value: Column, use: Callable[[dict[str, Column]], Column]) -> Column:
    """``use`` of the text, origin, kind and ids of a field that is a plain string or a grounded object (G1).

    Values are raw JSON text, so both document versions pass through one path; each is read once.
    """
    def parts(v: Column, origin: Column) -> Column:
        grounded = origin.isNotNull()
        return F.struct(
            F.when(grounded, _nonblank(_json(v, "text"))).when(~_is_object(v), _nonblank(v)).alias("text"), origin.alias("origin"),
            F.when(grounded, _json(v, "claim_kind")).alias("kind"), F.when(grounded, _ids(v)).alias("ids"),
        )

    known = lambda o: F.when(o.isin(GROUNDED_ORIGINS), o)
    named = lambda v: T.bound(F.when(_is_object(v), _json(v, "origin")), known)
    unwrapped = T.bound(value, lambda v: T.bound(named(v), lambda origin: parts(v, origin)))
    return T.bound(unwrapped, lambda p: use({n: p[n] for n in ("text", "origin", "kind", "ids")}))


def _place(field: int, item: Column | int = 0, sub: Column | int = 0) -> Column:
    """Where a claim stands: field, item of its list, part of the item; lists of any length keep their order."""
    value = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.struct(value(field).alias("field"), value(item).alias("item"), value(sub).alias("sub"))


def _claim(seq: Column, suffix: Column, path: Column, kind: str, text: Column, context: Column, origin: Column,
           ids: Column, grounded: Column, claim_kind: Column) -> Column:
    return F.struct(
        seq.alias("seq"), suffix.alias("suffix"), path.alias("path"), F.lit(kind).alias("claim_type"),
        text.alias("claim_text"), context.cast("string").alias("context"), origin.alias("citation_origin"),
        ids.cast("array<string>").alias("source_chunk_ids"), grounded.cast("string").alias("grounded_origin"),
        claim_kind.cast("string").alias("claim_kind"),
    )


def citation_origin(local: Column, inherited: Column | None = None) -> tuple[Column, Column]:
    """(origin, ids): the container's ids if it has the field, else the chapter's where allowed."""
    none = F.lit(None).cast("array<string>")
    chapter = none if inherited is None else inherited
    origin = F.when(local.isNotNull(), "local").when(chapter.isNotNull(), "inherited_chapter").otherwise("none")
    return origin, F.coalesce(local, chapter, F.array().cast("array<string>"))


def _field_claims(number: int, field: str, sub: str | None, kind: str, inherits: bool, keys: list[str],
                  items: Column, inherited: Column) -> Column:
    tail = F.lit("") if sub is None else F.lit(f".{sub}")
    context_key = CONTEXT_KEY.get(field)

    def claim(item: Column, i: Column, is_object: Column, parts: dict[str, Column]) -> Column:
        text = parts["text"]
        if keys:
            named = F.coalesce(*[_nonblank(_json(item, k)) for k in keys])
            text = F.when(is_object, named).otherwise(_nonblank(item))
        context = F.lit(None) if context_key is None else _json(item, context_key)
        local = F.coalesce(parts["ids"], F.when(is_object, _ids(item)))

        def cited(found: Column) -> Column:
            origin, ids = citation_origin(found, inherited if inherits else None)
            return _claim(
                _place(number, i),
                F.concat(F.lit(f"{field}."), i.cast("string"), tail),
                F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("]"), tail),
                kind, text, context, origin, ids, parts["origin"], parts["kind"],
            )

        return T.bound(local, cited)

    def one(item: Column, i: Column) -> Column:
        def of(is_object: Column) -> Column:
            made = unwrap_grounded(item if sub is None else _json(item, sub), lambda parts: claim(item, i, is_object, parts))
            return made if sub is None else F.when(is_object, made)

        return T.bound(_is_object(item), of)

    return F.transform(F.coalesce(items, F.array().cast("array<string>")), one)


def chapter_claims(chapters: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per claim of chapter documents (G1).

    chapters: (doc, chapter_index, document JSON, and where the chapters stand as ``root``, if not under
    ``learning_materials.chapters``). Every list field of a chapter is
    turned into claims inside its own row and exploded once: no shuffle.
    """
    root = F.col("root") if "root" in chapters.columns else F.lit(CHAPTER_ROOTS[0])
    parsed = chapters.select(doc, "chapter_index", root.alias("root"), F.from_json("document", CHAPTER_SCHEMA).alias("d"))
    inherited = F.col("d.source_chunk_ids")

    def summary(parts: dict[str, Column]) -> Column:
        origin, ids = citation_origin(parts["ids"], inherited)
        return _claim(_place(0), F.lit("chapter_summary"), F.lit("chapter_summary"), "chapter_summary", parts["text"],
                      F.lit(None), origin, ids, parts["origin"], parts["kind"])

    lists = [F.array(unwrap_grounded(F.col("d.chapter_summary"), summary))]
    for number, (field, sub, kind, inherits, keys) in enumerate(CHAPTER_FIELDS, start=1):
        lists.append(_field_claims(number, field, sub, kind, inherits, keys, F.col(f"d.{field}"), inherited))
    time = F.col("d.estimated_study_time_minutes")
    number = time.try_cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(T.strip(time))
    lists.append(
        F.array(
            _claim(_place(len(CHAPTER_FIELDS) + 1), F.lit("estimated_study_time_minutes"), F.lit("estimated_study_time_minutes"),
                   "estimated_study_time",
                   F.when(~T.blank(time), F.concat(F.lit("Estimated study time: "), F.coalesce(whole, T.strip(time)), F.lit(" minutes."))),
                   F.lit(None), F.lit("none"), F.array(), F.lit(None), F.lit(None))
        )
    )
    number = T.int_or_null("d.chapter_number")
    rows = parsed.select(
        doc, "root", "chapter_index", number.alias("chapter_number"), F.col("d.chapter_title").alias("chapter_title"),
        F.explode(F.flatten(F.array(*lists))).alias("c"),
    ).filter(F.col("c").isNotNull() & ~T.blank("c.claim_text"))
    prefix = F.format_string("chapter_%02d.", F.coalesce("chapter_number", F.col("chapter_index") + 1).cast("int"))
    path = F.concat(F.col("root"), F.lit("["), F.col("chapter_index").cast("string"), F.lit("]."), F.col("c.path"))
    return _finish(rows.withColumn("claim_id", F.concat(prefix, F.col("c.suffix"))).withColumn("json_path", path), doc, "chapter")


def _finish(rows: DataFrame, doc: str, scope: str) -> DataFrame:
    clean = F.transform("c.source_chunk_ids", lambda v: T.strip(v))
    empty = F.size("c.source_chunk_ids") == 0
    return rows.select(
        doc,
        "claim_id",
        "json_path",
        F.lit(scope).alias("scope"),
        F.struct(F.lit(0 if scope == "book" else 1).alias("part"), "chapter_index", F.col("c.seq").alias("seq")).alias("position"),
        "chapter_number",
        "chapter_title",
        F.col("c.claim_type").alias("claim_type"),
        F.col("c.claim_text").alias("claim_text"),
        F.col("c.context").alias("context"),
        F.when(empty, "none").otherwise(F.col("c.citation_origin")).alias("citation_origin"),
        clean.alias("source_chunk_ids"),
        F.when(empty, "NO_CITATION").otherwise("RESOLVED").alias("evidence_status"),
        F.col("c.grounded_origin").alias("grounded_origin"),
        F.col("c.claim_kind").alias("claim_kind"),
    )


def book_chapters(books: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, chapter_index, document, root) of whole book documents: the first of the three places that holds a list, empty or not (G1).

    books: (doc, book JSON).
    """
    lists = [_json(F.col("book"), r.removeprefix("$.")) for r in CHAPTER_ROOTS]
    found = F.coalesce(*[F.when(F.startswith(v, F.lit("[")), F.struct(F.lit(r).alias("root"), v.alias("chapters"))) for r, v in zip(CHAPTER_ROOTS, lists)])
    rows = books.select(doc, found.alias("f")).select(doc, "f.root", F.posexplode(F.from_json("f.chapters", "array<string>")).alias("chapter_index", "document"))
    return rows.filter(_is_object(F.col("document"))).select(doc, "chapter_index", "document", "root")


def whole_book_claims(books: DataFrame, doc: str = "doc") -> DataFrame:
    """Claims of whole book documents: those of the book itself and those of its chapters (G1). books: (doc, book JSON)."""
    materials = books.select(doc, _json(F.col("book"), "learning_materials").alias("materials")).filter(_is_object(F.col("materials")))
    return book_claims(materials, doc).unionByName(chapter_claims(book_chapters(books, doc), doc))


def book_problems(books: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, code) of books without a generation object, without materials or chapters, or with a chapter that is no object (G1)."""
    at = lambda path: F.coalesce(_json(F.col("book"), path), F.lit(""))
    held = F.startswith(at("learning_materials"), F.lit("{")) | F.startswith(at("chapter_packages"), F.lit("["))
    lists = [F.when(F.startswith(at(r.removeprefix("$.")), F.lit("[")), F.from_json(at(r.removeprefix("$.")), "array<string>")) for r in CHAPTER_ROOTS]
    odd = F.exists(F.coalesce(*lists, F.array().cast("array<string>")), lambda c: ~F.coalesce(_is_object(c), F.lit(False)))
    codes = [(~F.startswith(at("generation"), F.lit("{")), "NO_GENERATION"), (~held, "NO_MATERIALS"), (odd, "CHAPTER_NOT_AN_OBJECT")]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in codes]), lambda c: c.isNotNull())
    return books.select(doc, F.explode(found).alias("code"))


def book_claims(books: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per book-level claim (G1). books: (doc, materials JSON)."""
    parsed = books.select(doc, F.from_json("materials", BOOK_SCHEMA).alias("d"))
    none = F.lit(None)
    lists = []
    own, own_ids = citation_origin(F.col("d.source_chunk_ids"))
    for n, (field, kind) in enumerate(BOOK_TEXT_FIELDS):
        lists.append(F.array(_claim(_place(0, n), F.lit(field), F.lit(field), kind, _nonblank(F.col(f"d.{field}")), none, own, own_ids, none, none)))
    for n, (field, sub, kind, keys) in enumerate(BOOK_LIST_FIELDS, start=1):
        lists.append(_book_list(n, field, sub, kind, keys, F.col(f"d.{field}")))
    plan_field = len(BOOK_LIST_FIELDS) + 1
    plan = F.coalesce("d.study_plan", F.array().cast("array<string>"))

    def week(item: Column, i: Column) -> Column:
        origin, ids = citation_origin(_ids(item))
        head = F.concat(F.lit("study_plan."), i.cast("string"))
        path = F.concat(F.lit("study_plan["), i.cast("string"), F.lit("]"))
        focus = _claim(_place(plan_field, i), F.concat(head, F.lit(".focus")), F.concat(path, F.lit(".focus")),
                       "study_plan_focus", _nonblank(_json(item, "focus")), _json(item, "week"), origin, ids, none, none)
        acts = F.transform(
            F.coalesce(F.from_json(_json(item, "activities"), "array<string>"), F.array().cast("array<string>")),
            lambda a, j: _claim(
                _place(plan_field, i, j + 1),
                F.concat(head, F.lit(".activities."), j.cast("string")),
                F.concat(path, F.lit(".activities["), j.cast("string"), F.lit("]")),
                "study_plan_activity",
                F.when(_is_object(a), F.coalesce(*[_nonblank(_json(a, k)) for k in ("text", "activity", "description")])).otherwise(_nonblank(a)),
                _json(item, "week"),
                *citation_origin(F.when(_is_object(a), _ids(a)).otherwise(_ids(item))), none, none),
        )
        return F.concat(F.array(focus), acts)

    lists.append(F.flatten(F.transform(plan, week)))
    review = F.col("d.final_review")
    origin, ids = citation_origin(_ids(review))
    lists.append(F.array(_claim(_place(plan_field + 1), F.lit("final_review.summary"), F.lit("final_review.summary"),
                                "final_review_summary", _nonblank(_json(review, "summary")), none, origin, ids, none, none)))
    questions = F.coalesce(F.from_json(_json(review, "questions"), "array<string>"), F.array().cast("array<string>"))
    lists.append(F.transform(questions, lambda q, i: _claim(
        _place(plan_field + 1, i + 1), F.concat(F.lit("final_review.questions."), i.cast("string")),
        F.concat(F.lit("final_review.questions["), i.cast("string"), F.lit("]")), "final_review_question",
        F.when(_is_object(q), F.coalesce(*[_nonblank(_json(q, k)) for k in ("text", "question")])).otherwise(_nonblank(q)),
        none, *citation_origin(F.when(_is_object(q), _ids(q)).otherwise(_ids(review))), none, none)))
    rows = parsed.select(
        doc, F.lit(-1).alias("chapter_index"), F.lit(None).cast("int").alias("chapter_number"),
        F.lit(None).cast("string").alias("chapter_title"), F.explode(F.flatten(F.array(*lists))).alias("c"),
    ).filter(~T.blank("c.claim_text"))
    rows = rows.withColumn("claim_id", F.concat(F.lit("book."), F.col("c.suffix"))).withColumn(
        "json_path", F.concat(F.lit("$.learning_materials."), F.col("c.path"))
    )
    return _finish(rows, doc, "book")


def _book_list(number: int, field: str, sub: str | None, kind: str, keys: list[str], items: Column) -> Column:
    def one(item: Column, i: Column) -> Column:
        text = (
            _nonblank(_json(item, sub)) if sub
            else F.when(_is_object(item), F.coalesce(*[_nonblank(_json(item, k)) for k in keys])).otherwise(_nonblank(item))
        )
        origin, ids = citation_origin(F.when(_is_object(item), _ids(item)))
        tail = f".{sub}" if sub else ""
        return _claim(_place(number, i), F.concat(F.lit(f"{field}."), i.cast("string"), F.lit(tail)),
                      F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"]{tail}")), kind, text,
                      _json(item, "term") if sub else F.lit(None), origin, ids, F.lit(None), F.lit(None))

    return F.transform(F.coalesce(items, F.array().cast("array<string>")), one)


def claim_problems(claims: DataFrame, doc: str = "doc") -> DataFrame:
    """Repeated claim ids, repeated or blank source ids."""
    ids = F.col("source_chunk_ids")
    local = broken_rules(
        claims,
        [
            rule(F.exists(ids, lambda v: v.isNull() | (v == "")), "BLANK_SOURCE_ID", F.col("json_path"), "blank source id"),
            rule(F.size(F.array_distinct(ids)) != F.size(ids), "DUPLICATE_SOURCE_ID", F.col("json_path"), "repeated source id"),
        ],
        [doc, "claim_id"],
    )
    repeated = claims.groupBy(doc, "claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("json_path").alias("json_path")).filter("n > 1")
    return local.unionByName(
        repeated.select(doc, "claim_id", F.lit("DUPLICATE_CLAIM_ID").alias("code"), "json_path", F.lit("repeated claim id").alias("message"))
    )


def claim_summary(claims: DataFrame, doc: str = "doc") -> DataFrame:
    """Counts by scope, citation origin and type (G4), as one long table."""
    sets = claims.groupingSets(
        [[F.col(doc)], [F.col(doc), F.col("scope")], [F.col(doc), F.col("citation_origin")], [F.col(doc), F.col("claim_type")]],
        F.col(doc), F.col("scope"), F.col("citation_origin"), F.col("claim_type"),
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    dimension = (
        F.when(F.col("g") == 3 + 4, "all").when(F.col("g") == 3, "scope").when(F.col("g") == 5, "citation_origin").otherwise("claim_type")
    )
    return sets.select(
        doc, dimension.alias("dimension"), F.coalesce("scope", "citation_origin", "claim_type", F.lit("all")).alias("value"), "n"
    )


def source_claims(claims: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Claims to judge: those that assert something about the source, or the ones asked for."""
    if requested is not None:
        return claims.join(requested.select("claim_id").distinct(), "claim_id", "left_semi")
    return claims.filter(F.coalesce("grounded_origin", F.lit("")) != "pedagogical_generation")


def plan_batches(claims: DataFrame, size: int, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Claims with their batch number: same chapter and same evidence, at most ``size`` each.

    Groups are numbered by their first claim. A group of any size is cut by a tiled
    running count; where its batches start is a running sum over one row per group, so
    neither a large group nor many groups of one document meet in a task.
    """
    bundle = F.concat_ws("", F.coalesce(F.col("chapter_number").cast("string"), F.lit("book")), F.array_join("source_chunk_ids", "")).alias("bundle")
    rows = claims.withColumn("__bundle", bundle)
    bundles = rows.groupBy(doc, "__bundle").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__claims"))
    opened = bundles.withColumn("__batches", F.ceil(F.col("__claims") / F.lit(size)))
    starts = ordered_scan(opened, [doc], ["__first"], tile_of_integer("__first"), {"__before": Scan("sum_before", F.col("__batches"))})
    placed = ordered_scan(rows, [doc, "__bundle"], [order], tile_of_integer(order), {"__n": Scan("sum", F.lit(1))})
    known = salted_join(placed, starts.select(doc, "__bundle", "__before", "__claims"), [doc, "__bundle"], "inner", F.col(order))
    part = F.floor((F.col("__n") - 1) / F.lit(size)).cast("long")
    return known.select(
        *claims.columns, (F.col("__before") + part + 1).alias("batch_number"),
        F.least(F.lit(size).cast("long"), F.col("__claims") - part * size).alias("batch_claims"),
    )


def largest_bundle(batches: DataFrame, chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Characters of the largest evidence bundle per document."""
    one = batches.groupBy(doc, "batch_number").agg(F.first("source_chunk_ids").alias("ids"))
    sized = one.select(doc, "batch_number", F.explode("ids").alias("node_id")).join(
        chunks.select("node_id", F.length("text").alias("chars")), "node_id"
    )
    return sized.groupBy(doc, "batch_number").agg(F.sum("chars").alias("chars")).groupBy(doc).agg(F.max("chars").alias("largest_bundle_chars"))


def severity_floor(claim_id: Column, text: Column, context: Column, claim_type: Column, high_risk: list[str] = HIGH_RISK_IDS) -> Column:
    """HIGH for listed claims and risky wording, else null (G15). ``high_risk`` names claims of the book at hand."""
    words = F.concat_ws(" ", text, context, claim_type)
    risky = words.rlike(rf"(?iu){T.WORD_BEFORE}(?:{HIGH_RISK_WORDS}){T.WORD_AFTER}")
    return F.when(claim_id.isin(high_risk) | risky, F.lit("HIGH"))


def apply_severity_floor(results: DataFrame, high_risk: list[str] = HIGH_RISK_IDS) -> DataFrame:
    floor = severity_floor(F.col("claim_id"), F.col("claim_text"), F.coalesce("context", F.lit("{}")), F.col("claim_type"), high_risk)
    raised = floor.isNotNull() & (F.col("model_severity") != "HIGH")
    return results.withColumn("severity", F.coalesce(floor, F.col("model_severity"))).withColumn(
        "severity_floor_applied", F.coalesce(raised, F.lit(False))
    )


def _counts() -> list[Column]:
    status, severity = F.col("support_status"), F.col("severity")
    finding = status.isin(FINDING_STATUSES)
    names = ["supported", "partially_supported", "unsupported", "contradicted", "source_damaged", "not_factual"]
    counts = [F.count(F.lit(1)).alias("claim_count")]
    counts += [F.count_if(status == s).alias(f"{n}_count") for s, n in zip(SUPPORT_STATUSES, names)]
    counts += [F.count_if(finding & (severity == level)).alias(f"{level.lower()}_severity_finding_count") for level in LEVELS]
    return counts


def verdict_rollup(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and verdict per key and chapter, and per key over all chapters."""
    grouped = results.withColumn("chapter", F.coalesce(F.col("chapter_number").cast("string"), F.lit("book")))
    sets = grouped.groupingSets(
        [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col("chapter")]], *[F.col(k) for k in keys], F.col("chapter")
    ).agg(*_counts(), F.grouping("chapter").alias("is_total"))
    verdict = (
        F.when(F.col("high_severity_finding_count") > 0, "FAIL")
        .when(F.col("medium_severity_finding_count") + F.col("low_severity_finding_count") > 0, "PASS_WITH_WARNINGS")
        .otherwise("PASS")
    )
    return sets.withColumn("verdict", verdict)


def results_by(results: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """Long counts by each dimension alone."""
    columns = [F.col(k) for k in [*keys, *dimensions]]
    sets = results.groupingSets([[*[F.col(k) for k in keys], F.col(d)] for d in dimensions], *columns).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"__{d}") for d in dimensions]
    )
    name = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")) for d in dimensions])
    return sets.select(*keys, name.alias("dimension"), value.alias("value"), "n")


def priority_findings(results: DataFrame, order: str = "ord") -> DataFrame:
    """High findings in priority order: status, chapter (book last), position."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_PRIORITY]), F.col("support_status"))
    action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("support_status"))
    return (
        results.filter((F.col("severity") == "HIGH") & F.col("support_status").isin(FINDING_STATUSES))
        .withColumn("priority", rank)
        .withColumn("recommended_action", action)
        .withColumn("claim_text", T.preview("claim_text", 300))
        .orderBy("priority", F.asc_nulls_last("chapter_number"), order)
    )


def results_of_chapters(results: DataFrame, chapters: DataFrame) -> DataFrame:
    """Results whose chapter is selected."""
    return results.join(chapters.select("chapter_number").distinct(), "chapter_number", "left_semi")


def judged_results(claims: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted results, problems): each expected claim judged exactly once and well.

    raw: (claim_id, support_status, claim_nature, severity, confidence, rationale, evidence_chunk_ids_used).
    """
    times = raw.groupBy("claim_id").agg(F.count(F.lit(1)).alias("__times"))
    expected = claims.select("claim_id", F.col("source_chunk_ids").alias("__cited"), "claim_text", "context", "claim_type")
    joined = raw.join(times, "claim_id").join(expected.withColumn("__known", F.lit(True)), "claim_id", "full_outer")
    used = F.coalesce("evidence_chunk_ids_used", F.array().cast("array<string>"))
    code = T.first_reason(
        [
            (F.col("__times").isNull(), "MISSING_RESULT"),
            (F.col("__known").isNull(), "EXTRA_RESULT"),
            (F.col("__times") > 1, "DUPLICATE_RESULT"),
            (~F.coalesce(F.col("support_status").isin(SUPPORT_STATUSES), F.lit(False)), "INVALID_SUPPORT_STATUS"),
            (~F.coalesce(F.col("claim_nature").isin(CLAIM_NATURES), F.lit(False)), "INVALID_CLAIM_NATURE"),
            (~F.coalesce(F.col("severity").isin(LEVELS), F.lit(False)), "INVALID_SEVERITY"),
            (~F.coalesce(F.col("confidence").isin(LEVELS), F.lit(False)), "INVALID_CONFIDENCE"),
            (T.blank("rationale"), "BLANK_RATIONALE"),
            (F.size(F.array_distinct(used)) != F.size(used), "DUPLICATE_EVIDENCE"),
            (F.size(F.array_except(used, F.coalesce("__cited", F.array().cast("array<string>")))) > 0, "EVIDENCE_OUTSIDE_CITATIONS"),
        ]
    )
    judged = joined.withColumn("code", code)
    problems = judged.filter(F.col("code").isNotNull()).select("claim_id", "code").distinct()
    action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), F.col("support_status"))
    good = judged.filter(F.col("code").isNull()).withColumnRenamed("severity", "model_severity")
    accepted = apply_severity_floor(good).select(
        "claim_id", "support_status", "claim_nature", "severity", "model_severity", "severity_floor_applied", "confidence",
        T.squash("rationale").alias("rationale"), used.alias("evidence_chunk_ids_used"), action.alias("recommended_action"),
    )
    return accepted, problems


def join_results(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claim columns beside their verdict columns."""
    return claims.join(results, "claim_id")
