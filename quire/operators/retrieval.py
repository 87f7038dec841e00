"""Similarity top-k, scope, document order, lookups and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, first_per_key, ordered_scan, salted_join, tile_of_integer, top_n
from quire.operators.nearest import SCORE_DIGITS, exact_top_k

# ---------------------------------------------------------------------------
# Fixed values
FILTER_FIELDS = ["chapter", "chapter_number", "section", "topic", "content_type", "is_front_matter"]
FLAT_PARENT_PHRASES = [
    "best practices", "use cases", "workflow", "strategies", "methods", "patterns", "techniques",
]
FLAT_DESCENDANT_WORDS = [
    "add", "ask", "break", "choose", "define", "describe", "design", "evaluate", "give", "include", "iterate",
    "keep", "organize", "provide", "separate", "specify", "test", "use", "version", "write",
]
FALLBACK_CANDIDATES, FALLBACK_CHUNKS = 10, 5
# ---------------------------------------------------------------------------


def metadata_filter(nodes: DataFrame, **wanted) -> DataFrame:
    """Conjunction of exact matches; an absent or None value is no predicate."""
    for field in FILTER_FIELDS:
        if wanted.get(field) is not None:
            nodes = nodes.filter(F.col(field) == F.lit(wanted[field]))
    return nodes


def similarity_top_k(nodes: DataFrame, queries: DataFrame, k: int = 5, scope: list[str] | None = None) -> DataFrame:
    """Top ``k`` nodes per query, metadata filter first.

    nodes: (node_id, embedding, *scope); queries: (query_id, query_vector, *scope). Exact: blocks of vectors are
    left out only where the triangle inequality rules them out.
    """
    scope = scope or []
    return exact_top_k(nodes, queries, k, scope).select("query_id", "node_id", *scope, "score", "rank")


def merge_scoped(results: DataFrame, k: int) -> DataFrame:
    """Merge per-section results: best score per node, then the first ``k`` (R2)."""
    best = results.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return top_n(best, ["query_id"], [F.desc_nulls_last(F.round("score", SCORE_DIGITS)), F.asc("node_id")], k)


def scope_ends(outline: DataFrame, doc: str = "doc") -> DataFrame:
    """Outline with, per section, its place ``n`` in the chapter and where its scope ends.

    Ends hold for every request alike, so they come from ordered scans of the outline:
    forward for the place, backward for the next that is no flat descendant, and a third
    backward per level of the chapter, over the sections that are no deeper. Levels have
    no limit; a section is repeated once for each level of its chapter from its own on.
    """
    keys = [doc, "chapter_number"]
    named = outline.filter(F.col("section").isNotNull())
    placed = ordered_scan(named, keys, ["position"], tile_of_integer("position"), {"n": Scan("sum", F.lit(1))})
    first_word = F.lower(F.element_at(T.words(F.concat(F.col("section"), F.lit(" x"))), 1))
    back = T.pinned(
        placed, placed.columns, {"__back": -F.col("n"), "__foreign": ~first_word.isin(FLAT_DESCENDANT_WORDS)}
    )
    scans = {
        "__next": Scan("last_before", F.col("n")),
        "__stranger": Scan("last_before", F.when(F.col("__foreign"), F.col("n"))),
    }
    seen = ordered_scan(back, keys, ["__back"], tile_of_integer("__back"), scans)
    levels = placed.filter(F.col("level").isNotNull()).select(*keys, F.col("level").alias("__v")).distinct()
    upto = salted_join(placed.select(*keys, "n", "level"), levels, keys, "inner", F.col("n"))
    # a section without a level ends level scopes only
    upto = upto.filter(F.col("level").isNull() | (F.col("level") <= F.col("__v"))).withColumn("__back", -F.col("n"))
    ends = {
        "__level": Scan("last_before", F.col("n")),
        "__above": Scan("last_before", F.when(F.col("level") < F.col("__v"), F.col("n"))),
    }
    by_level = ordered_scan(upto, [*keys, "__v"], ["__back"], tile_of_integer("__back"), ends)
    seen = seen.join(by_level.filter(F.col("level") == F.col("__v")).select(*keys, "n", "__level", "__above"), [*keys, "n"], "left")
    far = F.lit(2**62)
    parent = T.any_contains(F.lower(F.trim("section")), FLAT_PARENT_PHRASES)
    level_end = F.when(F.col("level").isNull(), F.col("n") + 1).otherwise(F.coalesce("__level", far))
    flat_end = F.when(~parent, F.col("n") + 1).otherwise(F.least(F.coalesce("__above", far), F.coalesce("__stranger", far)))
    end = F.when(level_end > F.coalesce("__next", far), level_end).otherwise(flat_end)
    last = placed.groupBy(*keys).agg(F.max("n").alias("__size"))
    return seen.join(last, keys).select(*outline.columns, "n", F.least(end, F.col("__size") + 1).alias("end"))


def section_scope(outline: DataFrame, requests: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(expanded titles, problems) per request.

    outline: (doc, chapter_number, position, section, level);
    requests: (request_id, doc, section, chapter_number or null, include_descendants).
    A scope is a run of places, so it is unrolled and met on (doc, chapter, place): only
    the sections of the answer are formed.
    """
    ends = scope_ends(outline, doc)
    req = requests.select(
        "request_id", doc, F.col("section").alias("__want"), F.col("chapter_number").alias("__chapter"), "include_descendants"
    )
    match = req.join(ends.withColumnRenamed("section", "__want"), [doc, "__want"], "left").filter(
        F.col("__chapter").isNull() | F.col("chapter_number").isNull() | (F.col("chapter_number") == F.col("__chapter"))
    )
    summary = match.groupBy("request_id").agg(
        F.count("position").alias("matches"), F.count_distinct("chapter_number").alias("chapters")
    )
    code = T.first_reason(
        [
            (F.coalesce("matches", F.lit(0)) == 0, "section_not_found"),
            (F.col("__chapter").isNull() & (F.col("chapters") > 1), "section_in_several_chapters"),
            (F.col("matches") > 1, "section_repeated"),
        ]
    )
    judged = req.join(summary, "request_id", "left").withColumn("code", code)
    problems = judged.filter(F.col("code").isNotNull()).select("request_id", "code")
    found = match.join(judged.filter(F.col("code").isNull()).select("request_id"), "request_id")
    last = F.when(F.col("include_descendants"), F.greatest(F.col("n"), F.col("end") - 1)).otherwise(F.col("n"))
    places = found.select("request_id", doc, "chapter_number", F.explode(F.sequence(F.col("n"), last)).alias("n"))
    titles = places.join(ends.select(doc, "chapter_number", "n", "section", "position"), [doc, "chapter_number", "n"])
    return titles.groupBy("request_id", doc, "chapter_number", "section").agg(F.min("position").alias("position")), problems


def document_order(nodes: DataFrame, positions: DataFrame, doc: str = "doc") -> DataFrame:
    """Sort key columns of the document order (R4): chapter, outline position, pages, node id.

    positions: (doc, chapter_number, section, position); the last listing of a repeated title counts.
    """
    places = positions.groupBy(doc, "chapter_number", "section").agg(F.max("position").alias("section_position"))
    return nodes.join(places, [doc, "chapter_number", "section"], "left")


def order_columns(id: str = "node_id") -> list[Column]:
    number = lambda c: F.asc_nulls_last(F.col(c).cast("string").try_cast("long"))
    return [number("chapter_number"), number("section_position"), number("page_start"), number("page_end"), F.asc(id)]


def section_coverage(titles: DataFrame, retrieved: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counts per request, titles with ``covered``) (R5). Titles stay rows, in ``position`` order."""
    seen = retrieved.select(*keys, "section").distinct().withColumn("covered", F.lit(True))
    wanted = titles.groupBy(*keys, "section").agg(F.min("position").alias("position"))
    joined = wanted.join(seen, [*keys, "section"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    counts = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expanded_section_count"),
        F.count_if("covered").alias("covered_section_count"),
        F.count_if(~F.col("covered")).alias("missing_section_count"),
    )
    return counts, joined


def lookup_by_id(requests: DataFrame, chunks: DataFrame, require_text: bool = True) -> DataFrame:
    """Requested ids resolved in request order, each with its first error.

    requests: (request_id, ord, node_id); chunks: (node_id, text). Match counts are
    aggregated per id before the join, so a repeated id does not multiply rows.
    """
    matches = chunks.groupBy("node_id").agg(F.count(F.lit(1)).alias("__n"), F.first("text").alias("text"))
    repeats = requests.groupBy("request_id", "node_id").agg(F.count(F.lit(1)).alias("__asked"))
    joined = requests.join(repeats, ["request_id", "node_id"]).join(matches, "node_id", "left")
    code = T.first_reason(
        [
            (F.col("__asked") > 1, "duplicate_request"),
            (F.col("__n") > 1, "duplicate_match"),
            (F.col("__n").isNull(), "missing"),
            (F.lit(require_text) & T.blank("text"), "blank_text"),
        ]
    )
    return joined.select("request_id", "ord", "node_id", "text", code.alias("code"))


def fallback_candidates(candidates: DataFrame, used: DataFrame, expected: DataFrame, n: int = 5) -> DataFrame:
    """New candidates in ranking order, or the first error met before the n-th is taken.

    candidates: (request_id, rank, node_id, source_pdf, chapter_number); used: (request_id,
    node_id); expected: (request_id, want_pdf, want_chapter).
    """
    rows = candidates.withColumn("node_id", T.strip("node_id")).join(expected, "request_id")
    code = T.first_reason(
        [
            (F.coalesce("node_id", F.lit("")) == "", "missing_node_id"),
            (~F.col("source_pdf").eqNullSafe(F.col("want_pdf")), "wrong_document"),
            (~T.int_or_null("chapter_number").eqNullSafe(F.col("want_chapter")), "wrong_chapter"),
        ]
    )
    rows = rows.withColumn("code", code)
    good = rows.filter(F.col("code").isNull()).join(used, ["request_id", "node_id"], "left_anti")
    fresh = first_per_key(good, ["request_id", "node_id"], ["rank"])
    taken = top_n(fresh, ["request_id"], [F.asc("rank")], n, "position")
    last = taken.groupBy("request_id").agg(
        F.max("rank").alias("__last"), F.count(F.lit(1)).alias("__taken")
    )
    bad = rows.filter(F.col("code").isNotNull()).join(last, "request_id", "left")
    read = bad.filter(F.coalesce("__taken", F.lit(0)) < n).unionByName(
        bad.filter((F.col("__taken") >= n) & (F.col("rank") < F.col("__last")))
    )
    errors = first_per_key(read.select("request_id", "rank", "node_id", "code"), ["request_id"], ["rank"])
    ok = taken.join(errors.select("request_id"), "request_id", "left_anti")
    return ok.select("request_id", "position", "node_id", F.lit(None).cast("string").alias("code")).unionByName(
        errors.select("request_id", F.lit(0).alias("position"), "node_id", "code")
    )


def scope_consistency(rows: DataFrame, lesson_fields: DataFrame) -> DataFrame:
    """One document and one chapter per lesson.

    rows: (lesson_id, place, source_pdf, chapter_number) with place ``source`` or ``clean``;
    lesson_fields: (lesson_id, resolved_chapter, filter_chapter).
    """
    number = T.int_or_null("chapter_number")
    of = lambda place: F.when(F.col("place") == place, number)
    pdf = F.when(F.col("place") == "source", F.coalesce("source_pdf", F.lit("")))
    per = rows.groupBy("lesson_id").agg(
        F.count_distinct(pdf).alias("pdfs"),
        F.min(pdf).alias("source_pdf"),
        F.min(of("source")).alias("s_min"),
        F.max(of("source")).alias("s_max"),
        F.min(of("clean")).alias("c_min"),
        F.max(of("clean")).alias("c_max"),
    )
    joined = per.join(lesson_fields, "lesson_id", "left")
    places = [F.col("resolved_chapter"), F.col("filter_chapter"), F.col("s_min"), F.col("c_min")]
    chosen = F.coalesce(*places)
    conflict = F.lit(False)
    for p in places:
        conflict = conflict | F.coalesce(p != chosen, F.lit(False))
    code = T.first_reason(
        [
            ((F.col("pdfs") != 1) | (T.strip("source_pdf") == ""), "no_single_document"),
            ((F.col("s_min") != F.col("s_max")) | (F.col("c_min") != F.col("c_max")), "several_chapters"),
            (chosen.isNull(), "no_chapter"),
            (conflict, "chapter_conflict"),
        ]
    )
    return joined.select("lesson_id", "source_pdf", F.when(code.isNull(), chosen).alias("chapter_number"), code.alias("code"))


def fallback_retrieval(
    requests: DataFrame, sources: DataFrame, nodes: DataFrame, chunks: DataFrame, candidates: int = FALLBACK_CANDIDATES, n: int = FALLBACK_CHUNKS
) -> DataFrame:
    """New chunks for questions that a lesson's own chunks do not answer, as one plan.

    requests: (request_id, query_vector, resolved_chapter, filter_chapter); sources: (request_id, place, node_id, source_pdf,
    chapter_number), the lesson's chunks as it and the chunk file (place ``clean``) know them; nodes: (node_id, embedding,
    source_pdf, chapter_number); chunks: (node_id, text). A lesson must name one document and one chapter;
    that chapter's nearest ``candidates`` are read in order until ``n`` new ones are taken, and their texts are looked up.
    Returns (request_id, position, node_id, score, text, code): a row a chunk, or one row of position 0 with the first fault.
    """
    lessons = requests.select(F.col("request_id").alias("lesson_id"), "resolved_chapter", "filter_chapter")
    scope = scope_consistency(sources.withColumnRenamed("request_id", "lesson_id"), lessons).withColumnRenamed("lesson_id", "request_id")
    good = scope.filter("code IS NULL").select("request_id", "source_pdf", "chapter_number")
    asked = requests.join(good, "request_id").select(F.col("request_id").alias("query_id"), "query_vector", "chapter_number")
    number = T.int_or_null("chapter_number")
    near = similarity_top_k(nodes.select("node_id", "embedding", number.alias("chapter_number")), asked, candidates, ["chapter_number"])
    named = near.join(nodes.select("node_id", "source_pdf"), "node_id").select(F.col("query_id").alias("request_id"), "rank", F.col("node_id").cast("string").alias("node_id"), "source_pdf", "chapter_number", "score")
    expected = good.select("request_id", F.col("source_pdf").alias("want_pdf"), F.col("chapter_number").alias("want_chapter"))
    used = sources.select("request_id", F.col("node_id").cast("string").alias("node_id")).distinct()
    chosen = fallback_candidates(named.drop("score"), used, expected, n)
    taken = chosen.filter("position > 0")
    texts = lookup_by_id(taken.select("request_id", F.col("position").alias("ord"), "node_id"), chunks.select(F.col("node_id").cast("string").alias("node_id"), "text"))
    scores = named.groupBy("request_id", "node_id").agg(F.max("score").alias("score"))
    found = texts.join(scores, ["request_id", "node_id"]).select("request_id", F.col("ord").alias("position"), "node_id", "score", "text", "code")
    fault = lambda df, node: df.select("request_id", F.lit(0).alias("position"), node.cast("string").alias("node_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("text"), "code")
    return found.unionByName(fault(chosen.filter("position = 0"), F.col("node_id"))).unionByName(fault(scope.filter("code IS NOT NULL"), F.lit(None)))


def pack_context(
    chunks: DataFrame, keys: list[str], order: list[str], max_chars: int, tile: Column | None = None
) -> DataFrame:
    """Chunks that fit the context budget, the last one cut.

    A chunk is read while ``max - used - header - 8 > 200``; only the chunk that meets the
    end of the budget is cut, so a running sum of whole block lengths decides.
    """
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    header = F.concat(
        F.lit("CHUNK ID: "), F.col("node_id"), F.lit("\nChapter: "), show("chapter"),
        F.lit("\nChapter number: "), show("chapter_number"), F.lit("\nSection: "), show("section"),
        F.lit("\nTopic: "), show("topic"), F.lit("\nPages: "), show("page_start"), F.lit("-"), show("page_end"),
        F.lit("\nText:\n"),
    )
    rows = chunks.filter(~T.blank("node_id")).withColumn("__h", header).withColumn(
        "__t", T.strip(F.coalesce("text", F.lit("")))
    )
    rows = rows.withColumn("__block", F.length("__h") + F.length("__t") + 4)
    scanned = ordered_scan(
        rows, keys, order, tile if tile is not None else tile_of_integer(order[0]),
        {"__used": Scan("sum_before", F.col("__block"))},
    )
    room = F.lit(max_chars) - F.col("__used") - F.length("__h") - 8
    kept = scanned.withColumn("__room", room).filter((F.col("__room") > 200) & (F.col("__used") < max_chars))
    text = F.when(F.length("__t") > F.col("__room"), T.rstrip(F.expr("left(__t, cast(__room as int))"))).otherwise(F.col("__t"))
    return kept.withColumn("block", F.concat("__h", text, F.lit("\n---"))).drop("__h", "__t", "__block", "__used", "__room")


def first_n_with_cap(chunks: DataFrame, keys: list[str], order: list[Column], n: int, chars: int) -> DataFrame:
    """First ``n`` chunks per group with their text cut to ``chars`` (R9, chapter blocks)."""
    return top_n(chunks, keys, order, n).withColumn("text", F.left(F.col("text"), F.lit(chars)))


def dedupe_first(records: DataFrame, id: str, order: list[str | Column]) -> DataFrame:
    """First record per non-blank id."""
    return first_per_key(records.filter(~T.blank(id)), [id], order)


def referenced_rows(chunks: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept chunks, findings): only chunks named somewhere in a document.

    chunks: (node_id, text, ...); references: (node_id) from the claim bridge.
    """
    ids = references.filter(~T.blank("node_id")).select("node_id").distinct()
    seen = chunks.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(T.blank("text")).alias("blank")
    )
    joined = seen.join(ids.withColumn("wanted", F.lit(True)), "node_id", "full_outer")
    wanted = F.coalesce("wanted", F.lit(False))
    code = T.first_reason(
        [
            (wanted & F.col("n").isNull(), "missing_referenced"),
            (wanted & (F.col("n") > 1), "duplicate_referenced"),
            (wanted & F.col("blank"), "blank_referenced"),
            (~wanted & F.col("blank"), "blank_unreferenced"),
        ]
    )
    findings = joined.select(
        "node_id", code.alias("code"), F.when(wanted, "error").otherwise("warning").alias("severity")
    ).filter(F.col("code").isNotNull())
    return chunks.join(ids, "node_id", "left_semi"), findings


def compact_chapters(chapters: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Short JSON row per chapter under one budget for the whole book.

    chapters: (chapter_number, chapter_title, chapter_summary, key_terms
    array<struct<term, meaning>>, source_chunk_ids). Lines are joined by one newline
    when the budget is counted; the JSON form is Spark's.
    """
    short = lambda c, n: T.preview(F.coalesce(c, F.lit("")), n)
    block = F.struct(
        "chapter_number",
        "chapter_title",
        short(F.col("chapter_summary"), 800).alias("chapter_summary"),
        F.transform(
            F.slice("key_terms", 1, 8),
            lambda t: F.struct(t["term"].alias("term"), short(t["meaning"], 160).alias("meaning")),
        ).alias("key_terms"),
        F.slice("source_chunk_ids", 1, 10).alias("source_chunk_ids"),
    )
    rows = chapters.withColumn("line", F.to_json(block))
    scanned = ordered_scan(
        rows, keys, ["chapter_number"], tile_of_integer("chapter_number"),
        {"__before": Scan("sum_before", F.length("line") + 1)},
    )
    fits = scanned.filter(F.col("__before") < max_chars)
    return fits.withColumn("line", F.expr(f"left(line, cast({max_chars} - __before as int))")).drop("__before")
