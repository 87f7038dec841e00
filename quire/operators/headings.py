"""Heading candidates and their reduction to outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, first_per_key, ordered_scan, read_once, salted_join, tile_of_integer
from quire.operators.lines import line_table, near

# ---------------------------------------------------------------------------
# Patterns, word lists and limits that results depend on.
HEADING_WORDS = ["Chapter", "Unit", "Module", "Lesson", "Section"]
NUMBERED = r"^\d+(?:\.\d+)*\.?\s+\S+"
FOOTER = [
    "copyright", "©", "all rights reserved", r"printed in", r"oreilly\.com", "o'reilly", "isbn",
]
FOOTER_PRICE = [r"us\s*\$", r"can\s*\$"]
RUNNING = [r"chapter\s+\d+\s*\|", r"\|\s*chapter\s+\d+"]
PAGE_BAR = [r"^\d{1,4}\s*\|", r"\|\s*\d{1,4}$"]
DOT_LEADERS = r"(?:\.\s*){3,}\s*\d+\b"
BULLET = r"^[\-\*•◦▪–—\s]+$"
BARE_NUMBER = [r"^\d{1,3}\.$", r"^\(?[a-zA-Z]\)$", r"^\d{1,3}\)$"]
ITEM_NUMBER = r"^\d{1,3}[.)]\s+\S+"
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
HIGH_RULES = ["starts_with_chapter"]
MEDIUM_RULES = ["numbered_heading", "mostly_uppercase_short_line"]
LOW_RULES = ["short_title_like_line"]
QUESTION_STARTERS = [
    "what ", "why ", "how ", "when ", "where ", "who ", "which ", "can ", "could ", "should ",
    "does ", "do ", "is ", "are ", "will ",
]
CODE_PREFIXES = [
    "def ", "class ", "import ", "from ", "return ", "const ", "let ", "var ", "function ", "print(",
]
CODE_MARKS = r"[{}<>]=?|==|=>|::"
SENTENCE_MARKERS = [" because ", " however ", " whereas ", " although ", " while "]
EXAMPLE_TERMS = ["animal", "animals", "cats", "dogs", "dolphins", "sharks"]
TABLE_TERMS = [
    "% exposure", "pop.", "rank ", "score ", "benchmark", "dataset", "accuracy",
    "model number of parameters", "instruction group instruction",
]
STRICT_TABLE_TERMS = TABLE_TERMS + ["caption", "source:"]
TOPIC_TABLE_TERMS = [
    "figure ", "table ", "source:", "% exposure", "pop.", "rank ", "score ", "benchmark", "dataset", "accuracy",
]
METRIC_WORDS = "PPL|BPB|BPC|ACC|FLOP|FLOPs|MFU|MBU|QPS|GB|TPU|GPU"
TOPIC_METRIC_WORDS = "FLOP|FLOPs|PPL|BPB|BPC|ACC|SOTA"
GENERIC = ["answer", "answers", "example", "examples", "note", "notes", "question", "questions", "tip", "tips"]
STRICT_GENERIC = [
    "activity", "answer", "answers", "example", "examples", "exercise", "exercises", "note", "notes",
    "question", "questions", "review", "summary", "tip", "tips",
]
PROMPT_PREFIXES = [
    "user:", "assistant:", "system:", "generated answer:", "context:", "description:", "input:", "output:",
]
# ---------------------------------------------------------------------------


def _starts_upper(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def _title_words(line: Column, strip_chars: str) -> Column:
    """Words that begin with a capital or are whole numbers, wrapping marks removed."""
    bare = F.transform(T.words(line), lambda w: F.regexp_replace(w, f"^[{strip_chars}]+|[{strip_chars}]+$", ""))
    return F.size(F.filter(bare, lambda w: _starts_upper(w) | w.rlike(r"^\p{Nd}+$")))


def _half_titled(line: Column, strip_chars: str) -> Column:
    return _title_words(line, strip_chars) >= F.greatest(F.lit(1), F.floor(T.word_count(line) / 2))


def _mostly_upper(line: Column, longest: int, fewest_letters: int) -> Column:
    n = T.letters(line)
    return (
        (F.length(line) <= longest)
        & (n >= fewest_letters)
        & (T.share(T.count_chars(line, r"\p{Lu}"), n) >= 0.8)
    )


def heading_candidates(chunks: DataFrame, id: str = "id", keep: list[str] | None = None) -> DataFrame:
    """Line-level candidates with the first matching rule and a five-line preview."""
    keep = keep or [c for c in chunks.columns if c != "text"]
    table = line_table(chunks.select(*keep, "text"), reach=2, keep=keep)
    line = F.col("line")
    tests = [(line.rlike(rf"^{w}{T.WORD_AFTER}"), f"starts_with_{w.lower()}") for w in HEADING_WORDS]
    tests += [
        (line.rlike(f"(?U){NUMBERED}"), "numbered_heading"),
        (_mostly_upper(line, 80, 1), "mostly_uppercase_short_line"),
        (
            (F.length(line) < 100)
            & ~line.rlike(r"[.,;:]\z")
            & T.word_count(line).between(1, 12)
            & _half_titled(line, r"\"'()\[\]{}"),
            "short_title_like_line",
        ),
    ]
    around = F.concat(
        near(F.col("before"), F.col("line_no"), 2), F.array(line), near(F.col("after"), F.col("line_no"), 2)
    )
    judged = T.pinned(table, table.columns, {"rule": T.first_reason(tests)}).filter(F.col("rule").isNotNull())
    return judged.select(*keep, "line_no", "line", "rule", F.left(F.array_join(around, " "), F.lit(500)).alias("preview"))


def _first_passing(rows: DataFrame, keys: list[str], order: list[str], passes: Column) -> DataFrame:
    """Add ``__first``: order of the first row per key that passes every other test.

    The per-key minimum is combined map-side; the join back is salted, so a heading that
    fills a third of the table spreads over tasks.
    """
    rank = F.struct(*order)
    firsts = rows.filter(passes).groupBy(*keys).agg(F.min(rank).alias("__first"))
    return salted_join(rows, firsts, keys, "left", rank)


def outline_reduction(
    candidates: DataFrame,
    include_low_confidence: bool = False,
    max_length: int = 120,
    doc: str = "doc",
    order: list[str] | None = None,
    source_file: str | None = None,
) -> DataFrame:
    """Kept headings per document with position and confidence (D3).

    A repeat is judged last, among rows that pass all other tests, so the survivors
    are the first row per folded heading.
    """
    order = order or ["ord", "line_no"]
    original = T.squash("line")
    contents_line = original.rlike(r"^\d+\.\s+.+(?:\.\s*){3,}\s*\d+\s*$")
    heading = T.squash(
        F.when(
            (F.col("rule") == "numbered_heading") & contents_line,
            F.regexp_replace(original, r"\s*(?:\.\s*){3,}\s*\d+\s*$", ""),
        ).otherwise(original)
    )
    rows = T.pinned(candidates, candidates.columns, {"__orig": original, "heading": heading})
    h, o = F.col("heading"), F.col("__orig")
    compact = F.regexp_replace(h, r"(?U)\s+", "")
    allowed = HIGH_RULES + MEDIUM_RULES + (LOW_RULES if include_low_confidence else [])
    named = F.lower(h).isin("") if source_file is None else (
        (F.lower(h) == F.lower(T.file_name(source_file))) | (F.lower(h) == F.lower(T.file_stem(source_file)))
    )
    rule_ok = (
        F.when(F.col("rule") == "starts_with_chapter", h.rlike(r"(?i)^chapter\s+\d+$|^chapter\s+\d+\s*[:\-]\s+\S+"))
        .when(
            F.col("rule") == "numbered_heading",
            o.rlike(r"^\d+\.\s+.+(?:\.\s*){3,}\s*\d+\s*$") | o.rlike(r"^\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\s+[A-Z]"),
        )
        .when(F.col("rule") == "mostly_uppercase_short_line", h.rlike(rf"^CHAPTER\s+\d+{T.WORD_AFTER}"))
        .otherwise(True)
    )
    reason = T.first_reason(
        [
            (~F.col("rule").isin(allowed), "rule_not_allowed"),
            (F.length(h) < 3, "too_short"),
            (F.length(h) > max_length, "too_long"),
            (h.rlike(T.PAGE_NUMBER), "standalone_page_number"),
            (h.rlike(T.URL_OR_EMAIL), "url_or_email"),
            (T.any_rlike(h, FOOTER + FOOTER_PRICE), "footer_like"),
            ((T.symbols(h) > 6) | (T.share(T.symbols(h), F.length(h)) > 0.25), "too_much_punctuation"),
            (named, "repeated_file_name"),
            (
                (T.count_chars(compact, r"\p{Nd}") >= 4) & (T.letters(compact) == 0),
                "numeric_noise",
            ),
            (
                h.rlike(rf"(?i)^\d+\s*\|\s*chapter{T.WORD_AFTER}")
                | (h.rlike(rf"(?i){T.WORD_BEFORE}chapter\s+\d+:") & F.contains(h, F.lit("|"))),
                "running_header",
            ),
            (~rule_ok, "rule_specific_noise"),
        ]
    )
    judged = T.pinned(rows, rows.columns, {"__reason": reason})
    kept = judged.filter(F.col("__reason").isNull()).drop("__reason").withColumn("__key", F.lower(h))
    firsts = first_per_key(kept, [doc, "__key"], order)
    placed = ordered_scan(
        firsts, [doc], order, tile_of_integer(order[0], 1024), {"position": Scan("sum", F.lit(1))}
    )
    confidence = (
        F.when(F.col("rule").isin(HIGH_RULES), "high").when(F.col("rule").isin(MEDIUM_RULES), "medium").otherwise("low")
    )
    return placed.withColumn("confidence", confidence).drop("__orig", "__key")


def body_outline(outline: DataFrame, chunks: DataFrame, doc: str = "doc", id: str = "id") -> DataFrame:
    """Contents entries told apart from body chapter markers; every row keeps its reason."""
    first_page = (
        outline.filter(F.col("heading").rlike(r"^CHAPTER\s+\d+$"))
        .groupBy(doc)
        .agg(F.min("page_start").alias("__body"))
    )
    text = F.coalesce(F.col("__text"), F.lit(""))
    chapter_like = (
        F.regexp_count(text, F.lit(rf"{T.WORD_BEFORE}\d+\.\s+[A-Z][A-Za-z].*?{DOT_LEADERS}"))
        + F.regexp_count(text, F.lit(rf"{T.WORD_BEFORE}CHAPTER\s+\d+{T.WORD_AFTER}"))
        + F.regexp_count(text, F.lit(rf"{T.WORD_BEFORE}Chapter\s+\d+{T.WORD_AFTER}"))
    )
    features = chunks.withColumnRenamed("text", "__text").select(
        doc,
        id,
        F.contains(F.lower(text), F.lit("contents")).alias("__contents"),
        chapter_like.alias("__like"),
        text.rlike(DOT_LEADERS).alias("__leaders"),
        F.transform(T.lines(text), T.strip).alias("__lines"),
    )
    h, p = T.squash("heading"), T.squash(F.coalesce("preview", F.lit("")))
    is_body = h.rlike(r"^(?:CHAPTER|Chapter)\s+\d+$|^Chapter\s+\d+\s*[:\-]\s+\S+")
    body_like_preview = ~(F.contains(F.lower(p), F.lit("table of contents")) | p.rlike(DOT_LEADERS))
    page, start = F.col("page_start"), F.col("__body")
    toc_reason = T.first_reason(
        [
            (F.col("__contents"), "likely_table_of_contents"),
            (F.col("__like") >= 3, "many_chapter_lines_close_together"),
            (page < start, "before_first_body_chapter_marker"),
            (
                h.rlike(r"^\d+\.\s+\S+") & (p.rlike(DOT_LEADERS) | F.col("__leaders")),
                "chapter_listing_with_page_references",
            ),
            ((page <= start) & ~is_body, "early_duplicate_or_toc_like_entry"),
        ]
    )
    body_ok = is_body & (F.coalesce(F.array_contains("__lines", h), F.lit(False)) | body_like_preview)
    reason = F.coalesce(
        toc_reason, F.when(body_ok, "likely_body_chapter_marker").otherwise("not_likely_body_marker")
    )
    joined = outline.join(features, [doc, id], "left").join(first_page, doc, "left")
    return (
        joined.withColumn("reason", reason)
        .withColumn("is_toc", F.col("reason") != "likely_body_chapter_marker")
        .drop("__contents", "__like", "__leaders", "__lines", "__body")
    )


def section_candidates(
    chunks: DataFrame,
    keep: list[str] | None = None,
    include_front_matter: bool = False,
    max_length: int = 140,
    min_confidence: str = "medium",
) -> DataFrame:
    """Section and topic candidates inside chapter-enriched chunks."""
    keep = keep or [c for c in chunks.columns if c != "text"]
    if not include_front_matter and "is_front_matter" in chunks.columns:
        chunks = chunks.filter(~F.coalesce("is_front_matter", F.lit(False)))
    table = line_table(chunks.select(*keep, "text"), reach=3, keep=keep)
    table = T.pinned(
        table, [*keep, "line_no", "before", "after"], {"line": T.squash("line"), "next_line": T.squash("next_line")}
    )
    line, nxt = F.col("line"), F.col("next_line")
    named = F.endswith(F.lower(line), F.lit(".pdf"))
    if "source_pdf" in keep:
        named = named | (F.lower(line) == F.lower(T.file_name("source_pdf"))) | (
            F.lower(line) == F.lower(T.file_stem("source_pdf"))
        )
    crowded = (T.symbols(line) > 8) & (T.share(T.symbols(line), F.length(line)) > 0.2)
    noise = [
        F.length(line) < 3,
        F.length(line) > max_length,
        line.rlike(T.PAGE_NUMBER),
        line.rlike(T.URL_OR_EMAIL),
        T.any_rlike(line, FOOTER + RUNNING + PAGE_BAR),
        named,
        line.rlike(r"(?i)^chapter\s+\d+$"),
        line.rlike(r"(?:\.\s*){3,}\d+\s*$")
        | line.rlike(rf"(?i){T.WORD_BEFORE}table of contents{T.WORD_AFTER}")
        | line.rlike(r"(?i)^contents$|^chapter\s+\d+[:.\-\s].+\s+\d{1,4}$"),
        line.rlike("[<>]") | crowded,
        line.rlike(BULLET),
        T.any_rlike(line, BARE_NUMBER, ""),
        T.letters(line) < 2,
    ]
    clean = ~F.exists(F.array(*[F.coalesce(n, F.lit(False)) for n in noise]), lambda v: v)
    number = F.regexp_extract(line, r"^(\d{1,2}(?:\.\d{1,2})+\.?|\d{1,2}\.)\s*(.*)$", 1)
    title = T.squash(F.regexp_extract(line, r"^(\d{1,2}(?:\.\d{1,2})+\.?|\d{1,2}\.)\s*(.*)$", 2))
    numbered = (number != "") & ~((title == "") & line.rlike(r"^\d{1,2}\.$"))
    decimal = number.rlike(r"^\d{1,2}(?:\.\d{1,2})+\.?$")
    body_next = F.coalesce(
        ~nxt.rlike(T.PAGE_NUMBER) & ~nxt.rlike(T.URL_OR_EMAIL) & (T.word_count(nxt) >= 8) & (T.letters(nxt) >= 40),
        F.lit(False),
    )
    question = (
        (F.length(line) <= 140)
        & F.endswith(line, F.lit("?"))
        & T.word_count(line).between(3, 18)
        & T.starts_with_any(F.lower(line), QUESTION_STARTERS)
    )
    strong = (
        ~line.rlike(r"[.,;:]\z")
        & line.rlike(r"^[\p{Lu}\p{Nd}]")
        & T.word_count(line).between(1, 14)
        & _half_titled(line, r"\"'()\[\]{}:")
    )
    first_word = F.regexp_replace(F.element_at(T.words(line), 1), r"^[\"'()\[\]{}:]+|[\"'()\[\]{}:]+$", "")
    weak = (
        ~line.rlike(r"[.,;]\z")
        & _starts_upper(line)
        & T.word_count(line).between(2, 18)
        & _starts_upper(first_word)
    )
    kind = T.first_reason(
        [
            (numbered, "numbered_heading"),
            (question, "question_heading"),
            (_mostly_upper(line, 90, 3), "mostly_uppercase_short_line"),
            (strong & body_next, "heading_followed_by_body"),
            (strong, "short_title_like_line"),
            (weak, "weak_title_like_line"),
        ]
    )
    confidence = (
        F.when(
            F.col("candidate_type") == "numbered_heading",
            F.when(~decimal, "low").when(title != "", "high").otherwise("medium"),
        )
        .when(F.col("candidate_type") == "question_heading", F.when(F.col("__body"), "high").otherwise("medium"))
        .when(F.col("candidate_type") == "weak_title_like_line", "low")
        .otherwise("medium")
    )
    side = lambda name: F.left(
        F.array_join(F.transform(near(F.col(name), F.col("line_no"), 3), T.squash), " "), F.lit(350)
    )
    wanted = [c for c, r in CONFIDENCE_RANK.items() if r >= CONFIDENCE_RANK[min_confidence]]
    typed = T.pinned(table, table.columns, {"candidate_type": F.when(clean, kind), "__body": body_next}).filter(
        F.col("candidate_type").isNotNull()
    )
    return (
        typed.withColumn("confidence", confidence)
        .filter(F.col("confidence").isin(wanted))
        .select(
            *keep,
            F.col("line").alias("heading"),
            "candidate_type",
            "confidence",
            (F.col("line_no") + 1).alias("line_number"),
            side("before").alias("preview_before"),
            side("after").alias("preview_after"),
        )
    )


def number_candidates(
    candidates: DataFrame, keys: list[str], order: list[str], name: str = "candidate_id"
) -> DataFrame:
    """``section_candidate_NNN`` ids in document order."""
    placed = ordered_scan(
        candidates, keys, order, tile_of_integer(order[0], 256), {"__n": Scan("sum", F.lit(1))}
    )
    return placed.withColumn(name, F.format_string("section_candidate_%03d", F.col("__n").cast("int"))).drop("__n")


def _has_body(after: Column) -> Column:
    return (T.word_count(after) >= 8) & (T.letters(after) >= 35) & after.rlike(r"[.!?]")


def _crowded(h: Column) -> Column:
    return (T.symbols(h) > 8) & (T.share(T.symbols(h), F.length(h)) > 0.2)


def _code(h: Column) -> Column:
    return T.starts_with_any(F.lower(h), CODE_PREFIXES) | F.contains(h, F.lit("```")) | h.rlike(CODE_MARKS)


def _list_item(h: Column, decimal_tail: str) -> Column:
    return (
        h.rlike(r"^\d{1,3}[.)]$")
        | (h.rlike(ITEM_NUMBER) & ~h.rlike(rf"^\d{{1,2}}\.\d{{1,2}}{decimal_tail}"))
        | h.rlike(r"^\(?[a-zA-Z]\)$")
    )


def _apply_duplicates_and_cap(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    cap: int,
    cap_reason: str,
    duplicate_first: bool,
) -> DataFrame:
    """Second step of an outline reduction: repeats of the first passing row, then the cap.

    ``__reason`` is null for rows that pass. With ``duplicate_first`` a repeat outranks
    the row's own reason, else it is judged last.
    """
    passes = F.col("__reason").isNull()
    rows = read_once(rows, *keys, *order)
    rows = _first_passing(rows, [*keys, "__key"], order, passes)
    repeat = F.coalesce(F.struct(*order) > F.col("__first"), F.lit(False))
    reason = (
        F.when(repeat, "duplicate_in_chapter").otherwise(F.col("__reason"))
        if duplicate_first
        else F.coalesce(F.col("__reason"), F.when(repeat, "duplicate_in_chapter"))
    )
    rows = rows.withColumn("__reason", reason)
    counted = ordered_scan(
        rows,
        keys,
        order,
        tile_of_integer(order[0], 256),
        {"__n": Scan("sum", F.when(F.col("__reason").isNull(), 1).otherwise(0))},
    )
    over = F.col("__reason").isNull() & F.lit(cap > 0) & (F.col("__n") > cap)
    final = F.when(over, F.lit(cap_reason)).otherwise(F.col("__reason"))
    return (
        counted.withColumn("kept", final.isNull())
        .withColumn("reason", F.coalesce(final, F.col("__keep_reason")))
        .withColumn("position", F.when(F.col("kept"), F.col("__n")))
        .drop("__n", "__reason", "__keep_reason", "__first", "__key")
    )


def section_outline(
    candidates: DataFrame,
    keys: list[str],
    order: list[str],
    include_low_confidence: bool = False,
    max_per_chapter: int = 30,
) -> DataFrame:
    """Per-chapter outline with a reason on every row."""
    base = (
        candidates.withColumn("heading", T.squash("heading"))
        .withColumn("__key", T.heading_key("heading"))
        .withColumn("__after", T.squash(F.coalesce("preview_after", F.lit(""))))
    )
    base = read_once(base, *keys, *order)
    counts = base.groupBy(*keys, "__key").agg(F.count(F.lit(1)).alias("__repeats"))
    firsts = base.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__chapter_first"))
    place = F.struct(*order)
    base = salted_join(salted_join(base, counts, [*keys, "__key"], "inner", place), firsts, keys, "inner", place)
    h, after, kind = F.col("heading"), F.col("__after"), F.col("candidate_type")
    low = F.lower(h)
    body = _has_body(after)
    combined = F.lower(F.concat_ws(" ", h, after))
    sure = (F.col("confidence") == "high") & kind.isin("numbered_heading", "question_heading")
    caption = (
        T.any_rlike(h, [r"^figure\s+\d", r"^fig\.\s*\d", r"^table\s+\d", "^source:", rf"{T.WORD_BEFORE}caption{T.WORD_AFTER}"])
        | T.any_contains(combined, TABLE_TERMS)
        | (F.contains(h, F.lit(",")) & ~h.rlike(r"(?i)^factor\s+\d+:"))
        | (
            h.rlike(rf"(?i){T.WORD_BEFORE}(?:human|model|input|output|prompt|label|response){T.WORD_AFTER}")
            & ~after.rlike(r"[.!?]")
        )
        | ((T.count_chars(h, r"\p{Nd}") >= 3) & ~T.starts_with_any(low, ["factor ", "step "]))
        | F.contains(h, F.lit("%"))
    )
    bare = F.regexp_replace(low, r"^[:. ]+|[:. ]+$", "")
    generic = bare.isin(GENERIC) | (
        bare.rlike(r"^(example|answer|note|tip)\s*\d*[:.]?\s*(.*)$")
        & (F.trim(F.regexp_extract(bare, r"^(example|answer|note|tip)\s*\d*[:.]?\s*(.*)$", 2)) == "")
    )
    fragment = (
        h.rlike(r"^\p{Ll}")
        | h.rlike(r"[.,;]\z")
        | (F.contains(h, F.lit(",")) & (T.word_count(h) >= 6))
        | h.rlike(rf"\)\s*,?\s+and{T.WORD_AFTER}")
        | (T.word_count(h) > 16)
        | ((T.word_count(h) >= 9) & T.any_contains(low, SENTENCE_MARKERS))
    )
    supported = kind.isin("numbered_heading", "question_heading", "heading_followed_by_body", "short_title_like_line")
    if include_low_confidence:
        supported = supported | kind.isin("mostly_uppercase_short_line", "weak_title_like_line")
    unsure = ~F.coalesce(sure, F.lit(False))
    lowest = 1 if include_low_confidence else 2
    rank = F.coalesce(F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(
        F.col("confidence") == "low", 1), F.lit(0))
    reason = T.first_reason(
        [
            (rank < lowest, "confidence_below_minimum"),
            (F.length(h) < 3, "too_short"),
            (F.length(h) > 140, "too_long"),
            (T.letters(h) < 3, "not_enough_letters"),
            (h.rlike(T.URL_OR_EMAIL), "url_or_email"),
            (h.rlike(T.PAGE_NUMBER) | T.any_rlike(h, PAGE_BAR), "page_label"),
            (T.any_rlike(h, FOOTER + RUNNING), "header_or_footer"),
            (h.rlike(r"(?i)^chapter\s+\d+$"), "repeated_chapter_marker"),
            (_list_item(h, r"(?:\.\d{1,2})*\s+"), "exercise_or_list_fragment"),
            (h.rlike(BULLET), "bullet_or_marker"),
            (h.rlike(r"[<>{}\[\]`]") | _crowded(h), "too_much_punctuation"),
            (_code(h), "code_fragment"),
            (caption, "caption_or_table_noise"),
            (h.rlike(rf"[=×*/]|{T.WORD_BEFORE}(?:{METRIC_WORDS}){T.WORD_AFTER}"), "formula_or_metric_noise"),
            (generic, "generic_heading"),
            (F.col("__repeats") > 2, "repeated_too_often_in_chapter"),
            (~supported, "candidate_type_not_supported"),
            (unsure & ~body, "missing_body_text_after"),
            (unsure & fragment, "sentence_fragment"),
            (
                unsure & ~kind.isin("numbered_heading", "question_heading") & ~body & (
                    (F.col("__repeats") > 1) | (T.word_count(h) <= 2)
                ),
                "isolated_short_phrase",
            ),
            (
                unsure
                & (kind == "short_title_like_line")
                & (F.struct(*order) != F.col("__chapter_first"))
                & ((T.word_count(h) > 5) | F.contains(h, F.lit(","))),
                "short_title_like_noise",
            ),
        ]
    )
    level = (
        F.when(kind == "numbered_heading", "numbered_section")
        .when(kind == "question_heading", "topic_question")
        .otherwise("section_or_topic")
    )
    judged = (
        T.pinned(base, base.columns, {"__reason": reason})
        .withColumn("__keep_reason", F.lit("kept"))
        .withColumn("outline_level", level)
        .drop("__repeats", "__chapter_first", "__after")
    )
    return _apply_duplicates_and_cap(judged, keys, order, max_per_chapter, "max_per_chapter_reached", True)


def strict_section_outline(
    candidates: DataFrame,
    keys: list[str],
    order: list[str],
    include_medium: bool = False,
    max_per_chapter: int = 12,
) -> DataFrame:
    """Numbered and question headings only."""
    base = candidates.withColumn("heading", T.squash("heading")).withColumn("__key", T.heading_key("heading"))
    h, kind, conf = F.col("heading"), F.col("candidate_type"), F.col("confidence")
    after = T.squash(F.coalesce("preview_after", F.lit("")))
    low, combined = F.lower(h), F.lower(F.concat_ws(" ", h, after))
    bare = F.regexp_replace(low, r"^[:. ]+|[:. ]+$", "")
    generic_pattern = r"^(activity|answer|example|exercise|note|question|review|summary|tip)\s*\d*[:.]?\s*(.*)$"
    generic_tail = F.trim(F.regexp_extract(bare, generic_pattern, 2))
    section_title = T.squash(F.regexp_extract(h, r"^\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\.?\s+(.+)$", 1))
    titled = (F.length(section_title) >= 5) & (T.letters(section_title) >= 3) & ~section_title.rlike(r"^\p{Ll}")
    asked = (
        F.endswith(h, F.lit("?"))
        & _starts_upper(h)
        & T.word_count(h).between(3, 18)
        & T.starts_with_any(low, QUESTION_STARTERS)
    )
    numbered, question = kind == "numbered_heading", kind == "question_heading"
    medium = (conf == "medium") & F.lit(include_medium)
    reason = T.first_reason(
        [
            (F.length(h) < 8, "too_short"),
            (F.length(h) > 140, "too_long"),
            (h.rlike(T.URL_OR_EMAIL), "url_or_email"),
            (
                low.rlike(r"\.(pdf|txt|json|py)\z") | h.rlike(T.PAGE_NUMBER) | T.any_rlike(h, PAGE_BAR),
                "file_name_or_page_label",
            ),
            (
                h.rlike(r"[<>{}\[\]`]") | (T.count_chars(h, r"\p{L}\p{N}") == 0) | _crowded(h),
                "mostly_punctuation",
            ),
            (_code(h), "code_fragment"),
            (_list_item(h, r"(?:\.\d{1,2})*\s+\S+"), "exercise_or_numbered_question"),
            (
                bare.isin(STRICT_GENERIC)
                | (bare.rlike(generic_pattern) & ((F.length(generic_tail) < 5) | (T.letters(generic_tail) < 3))),
                "generic_heading",
            ),
            (
                h.rlike(rf"[=×*/%]|{T.WORD_BEFORE}(?:{METRIC_WORDS}){T.WORD_AFTER}")
                | ((T.count_chars(h, r"\p{Nd}") >= 3) & (T.letters(h) <= 12)),
                "formula_or_numeric_noise",
            ),
            (
                h.rlike(r"(?i)^(figure|fig\.|table)\s+\d") | T.any_contains(combined, STRICT_TABLE_TERMS),
                "caption_or_table_noise",
            ),
            (kind.isin("short_title_like_line", "weak_title_like_line"), "weak_short_title_like"),
            (
                (kind == "mostly_uppercase_short_line") & ~(T.word_count(h).between(2, 8) & _has_body(after)),
                "mostly_uppercase_non_title",
            ),
            (numbered & ~titled, "numbered_heading_without_meaningful_title"),
            (numbered & (conf != "high") & ~medium, "numbered_heading_confidence_not_allowed"),
            (question & ~asked, "invalid_question_heading"),
            (question & T.any_contains(combined, EXAMPLE_TERMS), "question_example_noise"),
            (question & (conf != "high") & ~(medium & _has_body(after)), "question_heading_confidence_not_allowed"),
            (~(numbered | question), "candidate_type_not_allowed"),
        ]
    )
    keep_reason = F.concat(
        F.when(conf == "high", "high_confidence_").otherwise("medium_"),
        kind,
        F.when(conf == "high", "").when(numbered, "_with_title").otherwise("_with_body"),
    )
    judged = T.pinned(base, base.columns, {"__reason": reason}).withColumn("__keep_reason", keep_reason)
    return _apply_duplicates_and_cap(judged, keys, order, max_per_chapter, "max_per_chapter_reached", True)


def chapter_source_chunks(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Marker chunk of each chapter: the one its first body chunk names."""
    body = chunks.filter(
        ~F.coalesce("is_front_matter", F.lit(False))
        & F.col("chapter_number").isNotNull()
        & F.col("chapter_source_chunk_id").isNotNull()
    )
    return body.groupBy(doc, "chapter_number").agg(
        F.min_by("chapter_source_chunk_id", "ord").alias("__source_chunk")
    )


def topic_outline(
    candidates: DataFrame,
    chunks: DataFrame,
    order: list[str],
    doc: str = "doc",
    id: str = "id",
    include_short_title_like: bool = False,
    include_uppercase_headings: bool = False,
    max_length: int = 120,
    min_confidence: str = "medium",
    max_per_chapter: int = 25,
) -> DataFrame:
    """Topic outline with chapter-opening titles."""
    base = candidates.withColumn("heading", T.squash("heading")).withColumn("__key", F.lower("heading"))
    base = salted_join(base, chapter_source_chunks(chunks, doc), [doc, "chapter_number"], "left", F.struct(*order))
    if "is_front_matter" not in candidates.columns:
        base = base.join(chunks.select(doc, id, "is_front_matter"), [doc, id], "left")
    h, kind = F.col("heading"), F.col("candidate_type")
    after = T.squash(F.coalesce("preview_after", F.lit("")))
    low = F.lower(h)
    n_words = T.word_count(h)
    digits = T.count_chars(h, r"\p{Nd}")
    opening = F.coalesce(F.col(id) == F.col("__source_chunk"), F.lit(False))
    type_reason = (
        F.when(
            kind.isin("numbered_heading", "question_heading", "heading_followed_by_body"), "allowed_candidate_type"
        )
        .when(
            kind == "mostly_uppercase_short_line",
            "uppercase_heading_included" if include_uppercase_headings else "uppercase_heading_excluded",
        )
        .when(
            kind == "short_title_like_line",
            F.lit("short_title_like_included")
            if include_short_title_like
            else F.when(opening, "chapter_opening_title").otherwise("short_title_like_excluded"),
        )
        .otherwise("candidate_type_not_allowed")
    )
    refused = type_reason.isin("uppercase_heading_excluded", "short_title_like_excluded", "candidate_type_not_allowed")
    all_words = T.words(h)
    capitals = F.size(F.filter(all_words, _starts_upper))
    short = F.size(F.filter(all_words, lambda w: F.length(w) <= 3))
    wanted = [c for c, r in CONFIDENCE_RANK.items() if r >= CONFIDENCE_RANK[min_confidence]]
    early = T.first_reason(
        [
            (~F.col("confidence").isin(wanted), "confidence_below_minimum"),
            (F.length(h) < 3, "too_short"),
            (F.length(h) > max_length, "too_long"),
            (T.letters(h) < 3, "not_enough_letters"),
            (h.rlike(T.PAGE_NUMBER), "standalone_page_number"),
            (h.rlike(T.URL_OR_EMAIL), "url_or_email"),
            (T.any_rlike(h, FOOTER + PAGE_BAR + RUNNING), "footer_or_header_text"),
            (h.rlike(r"(?i)^chapter\s+\d+$"), "repeated_chapter_marker"),
            (_list_item(h, ""), "exercise_or_list_item"),
            (h.rlike("[<>]") | _crowded(h), "too_much_punctuation"),
            (
                T.starts_with_any(low, PROMPT_PREFIXES + ["category question", "instruction group"])
                | h.rlike(r"[\[\]]")
                | F.contains(low, F.lit(".pdf")),
                "prompt_or_placeholder_noise",
            ),
            (
                F.endswith(h, F.lit("?"))
                & ((n_words < 3) | h.rlike(r"^\p{Ll}") | T.any_contains(low, EXAMPLE_TERMS)),
                "question_example_noise",
            ),
            (
                h.rlike(r"^\p{Ll}")
                | h.rlike(r"[\"'”’]\d{1,3}$")
                | ((n_words >= 9) & T.any_contains(low, SENTENCE_MARKERS))
                | ((n_words >= 10) & h.rlike(r"[‐\-–]\z")),
                "sentence_fragment_noise",
            ),
            (
                h.rlike(rf"[=×*/<>%]|{T.WORD_BEFORE}(?:{TOPIC_METRIC_WORDS}){T.WORD_AFTER}")
                | (
                    h.rlike(r"^\d+(?:\.\d+)?\s+")
                    & ~h.rlike(r"^\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\s+[A-Za-z]")
                )
                | ((digits >= 3) & ~F.startswith(low, F.lit("factor ")))
                | ((digits >= 2) & (T.letters(h) <= 5)),
                "formula_or_numeric_noise",
            ),
        ]
    )
    late = T.first_reason(
        [
            ((type_reason != "chapter_opening_title") & ((n_words > 16) | h.rlike(r"[.,;]\z")), "sentence_like_noise"),
            (
                F.contains(low, F.lit(" and others"))
                | (low.rlike(rf"{T.WORD_BEFORE}(?:billion|trillion|million){T.WORD_AFTER}") & (digits > 0))
                | (F.contains(h, F.lit(",")) & (n_words > 8)),
                "table_row_sentence_noise",
            ),
            (
                T.any_contains(F.lower(F.concat_ws(" ", h, after)), TOPIC_TABLE_TERMS)
                | ((n_words >= 4) & (capitals == n_words) & (short >= 2)),
                "table_or_figure_noise",
            ),
            (F.coalesce("is_front_matter", F.lit(False)), "front_matter"),
        ]
    )
    level = (
        F.when(type_reason == "chapter_opening_title", "chapter_title")
        .when(kind == "numbered_heading", "numbered_section")
        .when(kind == "question_heading", "topic_question")
        .when(kind == "mostly_uppercase_short_line", "heading")
        .otherwise("section_or_topic")
    )
    judged = (
        T.pinned(base, base.columns, {"__reason": F.coalesce(early, F.when(refused, type_reason), late)})
        .withColumn("__keep_reason", type_reason)
        .withColumn("outline_level", level)
        .drop("__source_chunk")
    )
    return _apply_duplicates_and_cap(
        judged, [doc, "chapter_number"], order, max_per_chapter, "max_entries_per_chapter_reached", False
    )
