"""Chapters, sections and boundaries of chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, salted_join, tile_of_integer, top_n
from quire.operators.lines import line_table
from quire.operators.patterns import find_patterns

# ---------------------------------------------------------------------------
# Fixed values
ROMAN = "[ivxlcdm]+"
NON_CHAPTER_TITLES = [
    "acknowledgments", "appendix", "appendices", "bibliography", "epilogue", "glossary", "index", "preface",
    "references",
]
SHORT_TITLES = [
    "example", "examples", "note", "tip", "answer", "question", "exercise", "summary", "review", "activity",
    "memory", "tools", "planning", "agents", "rag",
]
SOURCE_ORDER = [
    "toc", "body_outline", "section_candidates", "section_outline", "strict_section_outline", "chapter_only",
    "flat_chunks",
]
# ---------------------------------------------------------------------------


def corpus_profile(chunks: DataFrame, candidates: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Counts, lengths, ends and candidates per group of chunks."""
    n = F.length(F.coalesce("text", F.lit("")))
    profile = chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum(n).alias("total_characters"),
        F.min(n).alias("min_chunk_length"),
        F.max(n).alias("max_chunk_length"),
        F.round(F.avg(n), 2).alias("average_chunk_length"),
        F.count_if(n == 0).alias("empty_chunk_count"),
        F.min_by("id", order).alias("first_chunk_id"),
        F.max_by("id", order).alias("last_chunk_id"),
    )
    found = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_count"))
    return profile.join(found, keys, "left").fillna(0, ["candidate_count"])


def metadata_profile(chunks: DataFrame, metadata: str = "metadata", n: int = 5) -> DataFrame:
    """Per metadata key: rows, distinct values and the commonest values, first seen first on ties."""
    pairs = chunks.select("ord", F.explode(metadata).alias("key", "value"))
    values = pairs.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    totals = values.groupBy("key").agg(
        F.sum("n").alias("chunk_count"), F.count(F.lit(1)).alias("unique_value_count")
    )
    ranked = top_n(values, ["key"], [F.desc("n"), F.asc("seen"), F.asc("value")], n)
    return ranked.join(totals, "key").select("key", "chunk_count", "unique_value_count", "rank", "value", "n")


def chapter_number_of(heading: Column | str) -> Column:
    found = F.regexp_extract(heading, rf"(?i){T.WORD_BEFORE}CHAPTER\s+(\d+){T.WORD_AFTER}", 1)
    return F.when(found != "", found.try_cast("int"))


def chapter_markers(body: DataFrame, chunks: DataFrame, doc: str = "doc", id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(markers, problems). Markers are one per chunk, the last listed one."""
    known = chunks.select(doc, id, "ord", F.col("page_start").alias("__page"))
    joined = body.withColumn("chapter_number", chapter_number_of("heading")).join(known, [doc, id], "left")
    problem = T.first_reason(
        [
            (F.col("ord").isNull(), "marker_chunk_not_found"),
            (F.col("chapter_number").isNull(), "chapter_number_not_parsed"),
        ]
    )
    problems = joined.withColumn("code", problem).filter(F.col("code").isNotNull()).select(doc, id, "heading", "code")
    good = joined.filter(problem.isNull())
    last = F.max_by(
        F.struct(
            F.col("heading").alias("chapter"),
            "chapter_number",
            F.col(id).alias("chapter_source_chunk_id"),
            F.coalesce("__page", "page_start").alias("chapter_source_page"),
        ),
        "position",
    )
    return good.groupBy(doc, "ord").agg(last.alias("marker")), problems


def assign_chapters(
    chunks: DataFrame, markers: DataFrame, doc: str = "doc", width: int | None = None
) -> DataFrame:
    """Each chunk takes the last marker at or before it; earlier chunks are front matter."""
    marked = chunks.join(markers, [doc, "ord"], "left")
    tile = tile_of_integer("ord", width) if width else tile_of_integer("ord")
    filled = ordered_scan(marked, [doc], ["ord"], tile, {"__m": Scan("last", F.col("marker"))})
    return filled.select(
        *[c for c in chunks.columns],
        *[
            F.col(f"__m.{c}").alias(c)
            for c in ("chapter", "chapter_number", "chapter_source_chunk_id", "chapter_source_page")
        ],
        F.col("__m").isNull().alias("is_front_matter"),
    )


# -- contents pages ---------------------------------------------------------


def _contents_line(line: Column) -> Column:
    return T.squash(F.regexp_replace(T.squash(line), r"(?:\.\s*){2,}", " "))


def _has_page(line: Column) -> Column:
    return _contents_line(line).rlike(rf"(?i)^.+\s+(?:\d{{1,4}}|{ROMAN})$")


def contents_region(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Chunks of the contents pages.

    Start and end are two map-side combined minima per document, not a scan.
    """
    says = lambda t: F.contains(F.lower(t), F.lit("table of contents"))
    listing = F.exists(T.lines(F.coalesce("text", F.lit(""))), lambda v: _has_page(v) | says(v))
    flags = chunks.select(doc, "ord", F.coalesce(says(F.col("text")), F.lit(False)).alias("says"), listing.alias("lists"))
    starts = flags.groupBy(doc).agg(F.min(F.when(F.col("says"), F.col("ord"))).alias("start"))
    after = salted_join(flags, starts.filter(F.col("start").isNotNull()), [doc], "inner", F.col("ord")).filter(F.col("ord") >= F.col("start"))
    bounds = after.groupBy(doc, "start").agg(F.min(F.when(~F.col("lists"), F.col("ord"))).alias("stop"))
    inside = (F.col("ord") >= F.col("start")) & (F.col("stop").isNull() | (F.col("ord") < F.col("stop")))
    return salted_join(chunks, bounds, [doc], "inner", F.col("ord")).filter(inside).drop("start", "stop")


def contents_outline(region: DataFrame, doc: str = "doc") -> DataFrame:
    """Entries of the contents pages in order.

    entry_type: ``chapter``, ``section`` (under the last chapter) or ``other``. A roman
    page also takes words made of those letters; kept as it is in the reference.
    """
    table = line_table(region.select(doc, "ord", "text"), reach=1, keep=[doc, "ord"])
    line = T.squash("line")
    low = F.lower(line)
    header = (
        low.isin("table of contents", "contents")
        | low.rlike(f"^{ROMAN}$")
        | low.rlike(rf"^(?:{ROMAN}|\d+)\s*\|\s*table of contents$")
        | low.rlike(rf"^table of contents\s*\|\s*(?:{ROMAN}|\d+)$")
    )
    pattern = rf"(?i)^(.+?)\s+(\d{{1,4}}|{ROMAN})$"
    rows = (
        table.filter(~header)
        .withColumn("__c", _contents_line(F.col("line")))
        .filter(F.col("__c").rlike(pattern))
        .withColumn("__t", T.squash(F.regexp_extract("__c", pattern, 1)))
        .withColumn("page_text", F.lower(F.regexp_extract("__c", pattern, 2)))
    )
    page = F.when(F.col("page_text").rlike(r"^\d+$"), F.col("page_text").try_cast("int"))
    numbered = r"^(\d{1,3})\.\s+(.+)$"
    is_chapter = F.col("__t").rlike(numbered) & page.isNotNull()
    rows = rows.select(
        doc,
        "ord",
        "line_no",
        "page_text",
        page.alias("page_start"),
        is_chapter.alias("__chapter"),
        F.when(is_chapter, F.regexp_extract("__t", numbered, 1).try_cast("int")).alias("__number"),
        F.when(is_chapter, T.squash(F.regexp_extract("__t", numbered, 2))).otherwise(F.col("__t")).alias("title"),
    )
    scanned = ordered_scan(
        rows,
        [doc],
        ["ord", "line_no"],
        tile_of_integer("ord", 256),
        {
            "chapter_position": Scan("sum", F.col("__chapter").cast("int")),
            "chapter_number": Scan("last", F.col("__number")),
            "__entry": Scan("sum", F.lit(1)),
        },
    )
    plain = F.lower(F.regexp_replace("title", r"^[ .:\-]+|[ .:\-]+$", ""))
    other = plain.isin(NON_CHAPTER_TITLES) | (F.col("chapter_position") == 0) | F.col("page_start").isNull()
    kind = F.when(F.col("__chapter"), "chapter").when(other, "other").otherwise("section")
    return scanned.select(
        doc,
        F.col("__entry").alias("entry"),
        kind.alias("entry_type"),
        "title",
        "page_text",
        "page_start",
        F.when(kind != "other", F.col("chapter_position")).alias("chapter_position"),
        F.when(kind != "other", F.col("chapter_number")).alias("chapter_number"),
        F.when(kind == "section", F.lit(1)).alias("level"),
    )


# -- choice of the structure source ------------------------------------------


def _signal(frame: DataFrame, doc: str, name: str, chapters, sections, pages, noise, confidence) -> DataFrame:
    measured = frame.groupBy(doc).agg(
        chapters.alias("chapter_count"), sections.alias("section_count"), pages.alias("has_page_numbers")
    )
    c, s, p = F.col("chapter_count"), F.col("section_count"), F.col("has_page_numbers")
    return measured.select(
        doc,
        F.lit(name).alias("source"),
        F.lit(True).alias("available"),
        c.cast("long").alias("chapter_count"),
        s.cast("long").alias("section_count"),
        F.coalesce(p, F.lit(False)).alias("has_page_numbers"),
        noise(c, s, p).cast("double").alias("noise_score"),
        confidence(c, s, p).alias("confidence"),
    )


def structure_signals(
    chunks: DataFrame,
    contents: DataFrame,
    body: DataFrame,
    candidates: DataFrame,
    outline: DataFrame,
    strict: DataFrame,
    doc: str = "doc",
) -> DataFrame:
    """One row per (document, source) with its seven signals (D12). Missing sources are not available."""
    zero = F.lit(0)
    has_page = F.bool_or(F.col("page_start").isNotNull())
    chapter_of = F.struct("chapter_number", "chapter")
    rows = [
        _signal(
            contents, doc, "toc",
            F.count_if(F.col("entry_type") == "chapter"),
            F.count_if(F.col("entry_type") == "section"),
            F.count_if(F.col("entry_type") == "chapter") > 0,
            lambda c, s, p: F.when((c >= 5) & (s >= 20), 0.1).otherwise(0.35),
            lambda c, s, p: F.when((c >= 5) & (s >= 20) & p, "high").when((c >= 3) & p, "medium").otherwise("low"),
        ),
        _signal(
            body, doc, "body_outline",
            F.count_if(F.col("heading").rlike(rf"{T.WORD_BEFORE}CHAPTER\s+\d+{T.WORD_AFTER}")), F.max(zero), has_page,
            lambda c, s, p: F.when(c >= 5, 0.2).otherwise(0.5),
            lambda c, s, p: F.when(c >= 5, "high").otherwise("medium"),
        ),
        _signal(
            candidates, doc, "section_candidates",
            F.count_distinct("chapter_number"), F.count(F.lit(1)), has_page,
            lambda c, s, p: F.when(s > 500, 0.8).when(s >= 50, 0.6).otherwise(0.3),
            lambda c, s, p: F.when(s.between(50, 500), "medium").otherwise("low"),
        ),
        _signal(
            outline, doc, "section_outline",
            F.count_distinct("chapter_number"), F.count_if(F.col("kept")),
            F.bool_or(F.col("kept") & F.col("page_start").isNotNull()),
            lambda c, s, p: F.when(s > 200, 0.6).when(s >= 40, 0.4).otherwise(0.2),
            lambda c, s, p: F.when(s.between(40, 200), "medium").otherwise("low"),
        ),
        _signal(
            strict, doc, "strict_section_outline",
            F.count_distinct(F.when(F.col("kept"), F.col("chapter_number"))), F.count_if(F.col("kept")),
            F.bool_or(F.col("kept") & F.col("page_start").isNotNull()),
            lambda c, s, p: F.when((s >= 20) & (c >= 5), 0.15).otherwise(0.1),
            lambda c, s, p: F.when((s >= 20) & (c >= 5), "medium").otherwise("low"),
        ),
        _signal(
            chunks.filter(F.col("chapter").isNotNull() | F.col("chapter_number").isNotNull()), doc, "chapter_only",
            F.count_distinct(chapter_of), F.max(zero), has_page,
            lambda c, s, p: F.when(c >= 5, 0.2).otherwise(0.35),
            lambda c, s, p: F.lit("medium"),
        ),
        _signal(
            chunks, doc, "flat_chunks", F.max(zero), F.max(zero), F.bool_and(F.lit(False)),
            lambda c, s, p: F.lit(0.5), lambda c, s, p: F.lit("low"),
        ),
    ]
    present = rows[0]
    for r in rows[1:]:
        present = present.unionByName(r)
    grid = chunks.select(doc).distinct().select(
        doc, F.explode(F.array(*[F.lit(s) for s in SOURCE_ORDER])).alias("source")
    )
    return grid.join(present, [doc, "source"], "left").select(
        doc,
        "source",
        F.coalesce("available", F.lit(False)).alias("available"),
        F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
        F.coalesce("section_count", F.lit(0)).alias("section_count"),
        F.coalesce("has_page_numbers", F.lit(False)).alias("has_page_numbers"),
        F.coalesce("noise_score", F.lit(1.0)).alias("noise_score"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"),
    )


def select_source(signals: DataFrame, doc: str = "doc") -> DataFrame:
    """Chosen source per document and the outline it yields.

    Fixed rules first; the fallback ranks all sources but always yields the flat outline.
    """
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    place = F.lit(len(SOURCE_ORDER)) - F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    score = F.struct(
        F.col("available").cast("int").alias("a"),
        rank.alias("b"),
        F.col("has_page_numbers").cast("int").alias("c"),
        F.least("section_count", F.lit(200)).alias("d"),
        F.least("chapter_count", F.lit(50)).alias("e"),
        (-F.when(F.col("noise_score") == 0, 1.0).otherwise(F.col("noise_score"))).alias("f"),
        place.alias("g"),
    )
    is_ = lambda name: F.col("source") == name
    c, s = F.col("chapter_count"), F.col("section_count")
    per = signals.groupBy(doc).agg(
        F.bool_or(is_("toc") & F.col("available") & (c >= 5) & (s >= 20) & F.col("has_page_numbers")).alias("toc"),
        F.bool_or(is_("toc") & (F.col("confidence") == "high")).alias("toc_high"),
        F.bool_or(is_("body_outline") & F.col("available") & (c >= 5)).alias("body"),
        F.bool_or(is_("strict_section_outline") & F.col("available") & (s >= 20) & (c >= 5)).alias("strict"),
        F.bool_or(is_("chapter_only") & F.col("available")).alias("chapters"),
        F.max_by("source", score).alias("best"),
    )
    chosen = (
        F.when(F.col("toc"), "toc")
        .when(F.col("body") & ~F.col("toc_high"), "body_outline")
        .when(F.col("strict"), "strict_section_outline")
        .when(F.col("chapters"), "chapter_only")
    )
    outline = (
        F.when(chosen == "toc", "contents")
        .when(chosen.isin("body_outline", "chapter_only"), "chapters")
        .when(chosen == "strict_section_outline", "empty")
        .otherwise("flat")
    )
    return per.select(doc, F.coalesce(chosen, F.col("best")).alias("selected_source"), outline.alias("outline"))


# -- sections -----------------------------------------------------------------


def assign_sections(chunks: DataFrame, sections: DataFrame, doc: str = "doc") -> DataFrame:
    """As-of join of chunks to sections by page.

    ``sections``: (doc, chapter_number, position, section, page_start, level). A section
    starting on the chunk's page wins with its first listing; else the last section that
    started earlier. Pages, not chunks, are scanned: the (chapter, page) table is small
    and the chunk table only meets it in an equi join.
    """
    row = F.struct(F.col("section"), F.col("page_start").alias("section_page_start"), F.col("level").alias("section_level"))
    listed = (
        sections.filter(F.col("page_start").isNotNull() & (F.coalesce("section", F.lit("")) != ""))
        .groupBy(doc, "chapter_number", F.col("page_start").alias("__page"))
        .agg(F.min_by(row, "position").alias("__first"), F.max_by(row, "position").alias("__last"))
    )
    body = ~F.coalesce("is_front_matter", F.lit(False)) & F.col("page_start").isNotNull()
    pages = chunks.filter(body).select(doc, "chapter_number", F.col("page_start").alias("__page")).distinct()
    grid = pages.join(listed, [doc, "chapter_number", "__page"], "full_outer")
    filled = ordered_scan(
        grid, [doc, "chapter_number"], ["__page"], tile_of_integer("__page"), {"__asof": Scan("last", F.col("__last"))}
    ).select(
        doc,
        "chapter_number",
        F.col("__page").alias("page_start"),
        F.coalesce("__first", "__asof").alias("__s"),
    )
    joined = chunks.join(filled, [doc, "chapter_number", "page_start"], "left")
    s = F.when(body, F.col("__s"))
    return joined.select(
        *chunks.columns,
        s["section"].alias("section"),
        s["section_page_start"].alias("section_page_start"),
        s["section_level"].alias("section_level"),
        s["section"].alias("topic"),
    )


def _soft(value: Column) -> Column:
    return T.squash(F.replace(value, F.lit("­"), F.lit("")))


def _title_regex(title: Column) -> Column:
    escaped = F.transform(
        T.words(_soft(title)), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1")
    )
    return F.array_join(escaped, r"(?:(?U:\s)+|­+|-?(?U:\s)+)")


def _generic_title(title: Column) -> Column:
    folded = F.lower(_soft(title))
    return (F.length(folded) <= 12) | folded.isin(SHORT_TITLES)


def with_heading_offset(df: DataFrame, text: str, title: str, name: str, min_start: int = 0) -> DataFrame:
    """Add the 0-based offset at which ``title`` stands as a heading in ``text``, else null.

    First a line that is the title, or begins with it; then a title broken over lines. The
    title is always escaped before it is used as a pattern. What depends on the row alone
    is pinned before the lines are walked, so no line works it out again.
    """
    usable = (F.coalesce(F.col(text), F.lit("")) != "") & (F.coalesce(F.col(title), F.lit("")) != "")
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(.*?)({T.LINE_BREAK}|\z)"), F.lit(0))
    rows = T.pinned(
        df,
        df.columns,
        {
            "__h": F.when(usable, F.lower(_soft(F.col(title)))),
            "__n": F.length(_soft(F.col(title))),
            "__g": _generic_title(F.col(title)),
            "__r": _title_regex(F.col(title)),
            "__p": F.when(usable, pieces),
        },
    )
    t, n, generic, regex = F.col("__h"), F.col("__n"), F.col("__g"), F.col("__r")
    wide = F.greatest(F.lit(120), n + 80)
    # lines short enough to be headings, each cleaned once
    lines = F.filter(
        F.transform(F.col("__p"), lambda v, i: F.struct(v.alias("v"), i.alias("i"), _soft(v).alias("s"))),
        lambda z: (z["s"] != "") & (F.length(z["s"]) <= wide),
    )
    rows = T.pinned(rows, rows.columns, {"__l": lines})

    def place(z: Column) -> Column:
        """Characters before the heading inside the line, or null."""
        low = F.lower(z["s"])
        lead = F.length(F.regexp_extract(z["v"], rf"(?U)\A({T.SPACE}*)", 1))
        extra = F.trim(F.substring(z["s"], n + 1, F.length(z["s"])))
        begins = (
            F.startswith(low, t) & (F.length(z["s"]) <= F.greatest(F.lit(80), n + 40)) & ((extra == "") | extra.rlike(r"^[:\-|]"))
        )
        at = F.regexp_instr(T.strip(z["v"]), F.concat(F.lit("(?iu)"), regex)) - 1
        return F.when((low == t) | begins, lead).when(~generic & at.between(0, 4), lead + at)

    placed = F.filter(
        F.transform("__l", lambda z: F.struct(z["i"].alias("i"), place(z).alias("at"))), lambda z: z["at"].isNotNull()
    )
    rows = T.pinned(rows, rows.columns, {"__w": placed})
    starts = F.filter(
        F.transform("__w", lambda z: F.struct(F.length(F.array_join(F.slice("__p", F.lit(1), z["i"]), "")).alias("start"), z["at"].alias("at"))),
        lambda z: z["start"] >= min_start,
    )
    rows = T.pinned(rows, rows.columns, {"__o": F.get(starts, 0)["start"] + F.get(starts, 0)["at"]})

    # a title broken over lines: (line start)(prefix)(title)(rest of line); looked for only where no line was found
    broken = F.concat(F.lit(r"(?iu)(?:\A|\n)([^\n]*?)("), regex, F.lit(r")([^\n]*)"))
    looked = F.when(F.col("__o").isNull() & t.isNotNull(), F.col(text))
    both = F.arrays_zip(
        F.regexp_extract_all(looked, broken, F.lit(0)).alias("w"), F.regexp_extract_all(looked, broken, F.lit(1)).alias("p")
    )
    rows = T.pinned(rows, rows.columns, {"__b": both})

    def is_heading(m: Column) -> Column:
        norm = _soft(m["w"])
        low = F.lower(norm)
        return (low == t) | F.when(
            generic, F.startswith(low, t) & (F.length(norm) <= F.greatest(F.lit(80), n + 30))
        ).otherwise((F.length(norm) <= wide) & (F.length(_soft(m["p"])) <= 4))

    found = F.filter(
        F.transform(
            F.filter("__b", is_heading),
            lambda m: _locate(m["w"], F.col(text)) + F.startswith(m["w"], F.lit("\n")).cast("int") + F.length(m["p"]),
        ),
        lambda v: v >= min_start,
    )
    return rows.select(*df.columns, F.coalesce("__o", F.get(found, 0)).alias(name))


def _locate(part: Column, text: Column) -> Column:
    return F.position(part, text) - 1


def _with_refusal(df: DataFrame, original: str, cleaned: str, heading: str, min_length: int, name: str) -> DataFrame:
    """Add why a cut is not safe, ``ok`` when it is, null where nothing was cut."""
    o, c = F.col(original), F.col(cleaned)
    much = F.length(c) < F.length(o) * F.lit(0.10).cast("double")
    rows = with_heading_offset(df.withColumn("__much", F.when(much, c)), "__much", heading, "__kept_heading")
    reason = T.first_reason(
        [
            (T.blank(c), "trim_skipped_empty_text"),
            ((F.length(c) < min_length) & (F.length(o) > 500), "trim_skipped_below_min_cleaned_length"),
            (much & (F.length(c) < 300), "trim_skipped_removed_more_than_90_percent"),
            (much & F.col("__kept_heading").isNull(), "trim_skipped_removed_more_than_90_percent_without_heading"),
        ],
        "ok",
    )
    return T.pinned(rows, df.columns, {name: F.when(c.isNotNull(), reason)})


def section_neighbours(sections: DataFrame, doc: str = "doc") -> DataFrame:
    """Next title per listed section, keyed by folded title and start page."""
    titled = sections.filter(F.coalesce("section", F.lit("")) != "")
    return ordered_scan(
        titled,
        [doc, "chapter_number"],
        ["position"],
        tile_of_integer("position"),
        {"next_section": Scan("next", F.col("section"))},
    )


def trim_boundaries(chunks: DataFrame, sections: DataFrame, min_cleaned_length: int = 200, doc: str = "doc") -> DataFrame:
    """Cut text that belongs to the neighbouring section (D14); adds ``boundary_cleanup``."""
    folded = F.lower(_soft(F.col("section")))
    near_by = section_neighbours(sections, doc)
    info = near_by.groupBy(doc, "chapter_number", folded.alias("__fold"), F.col("page_start").alias("__page")).agg(
        F.max_by(F.struct("next_section"), "position").alias("__exact")
    )
    fallback = near_by.groupBy(doc, "chapter_number", folded.alias("__fold")).agg(
        F.min_by(F.struct("next_section"), "position").alias("__any")
    )
    key = F.struct(
        F.coalesce("page_start", F.lit(10**9)).alias("a"),
        F.coalesce("page_end", F.lit(10**9)).alias("b"),
        T.natural_key("id").alias("c"),
    )
    firsts = (
        chunks.filter(F.col("chapter_number").isNotNull() & (F.coalesce("section", F.lit("")) != ""))
        .groupBy(doc, "chapter_number", "section")
        .agg(F.min_by("id", key).alias("__first_id"))
    )
    rows = (
        chunks.withColumn("__fold", folded)
        .withColumn("__page", F.col("section_page_start"))
        .join(info, [doc, "chapter_number", "__fold", "__page"], "left")
        .join(fallback, [doc, "chapter_number", "__fold"], "left")
        .join(firsts, [doc, "chapter_number", "section"], "left")
        .withColumn("__info", F.coalesce("__exact", "__any"))
        .withColumn("__text", F.coalesce("text", F.lit("")))
    )
    body = ~F.coalesce("is_front_matter", F.lit(False))
    known = F.col("__info").isNotNull() & (F.coalesce("section", F.lit("")) != "")
    attempt = known & (F.col("__text") != "") & body & (
        (F.col("id") == F.col("__first_id"))
        | F.col("page_start").eqNullSafe(F.col("section_page_start"))
    )
    add = lambda df, **columns: T.pinned(df, df.columns, columns)
    text, section = F.col("__text"), F.col("section")
    rows = add(rows, __attempt=F.coalesce(attempt, F.lit(False)), __known=F.coalesce(known & body, F.lit(False)))
    rows = add(rows, __try=F.when(F.col("__attempt"), text))
    rows = with_heading_offset(rows, "__try", "section", "__at")
    rows = add(rows, __cut=F.when(F.col("__at") > 0, F.substring(text, F.col("__at") + 1, F.length(text))))
    rows = _with_refusal(rows, "__text", "__cut", "section", min_cleaned_length, "__why1")
    rows = add(rows, __t1=F.when(F.col("__why1") == "ok", F.col("__cut")).otherwise(text))
    end = F.when(F.col("__known") & F.col("chapter_number").isNotNull() & (F.col("__t1") != ""), F.col("__info.next_section"))
    rows = add(rows, __end=F.when(end != "", end))
    rows = with_heading_offset(rows, "__t1", "__end", "__stop", 1)
    rows = add(rows, __kept=F.when(F.col("__stop").isNotNull(), T.rstrip(F.substring(F.col("__t1"), F.lit(1), F.col("__stop")))))
    rows = _with_refusal(rows, "__t1", "__kept", "section", min_cleaned_length, "__why2")
    rows = add(rows, __t2=F.when(F.col("__why2") == "ok", F.col("__kept")).otherwise(F.col("__t1")))
    warnings = F.filter(
        F.array(
            F.when(F.col("__attempt") & F.col("__at").isNull(), F.concat(F.lit("start_heading_not_found:"), F.col("section"))),
            F.when(F.col("__why1") != "ok", F.col("__why1")),
            F.when(F.col("__why2") != "ok", F.col("__why2")),
        ),
        lambda w: w.isNotNull(),
    )
    length = lambda c: F.length(c).cast("int")
    cleanup = F.struct(
        (F.col("__t2") != F.col("__text")).alias("applied"),
        length("__text").alias("original_text_length"),
        length("__t2").alias("cleaned_text_length"),
        (length("__text") - length("__t1")).alias("prefix_trimmed_chars"),
        (length("__t1") - length("__t2")).alias("suffix_trimmed_chars"),
        F.when(F.col("__attempt"), F.col("section")).alias("start_heading"),
        (F.col("__attempt") & F.col("__at").isNotNull()).alias("start_heading_found"),
        F.col("__end").alias("end_heading"),
        F.coalesce(F.col("__why2") == "ok", F.lit(False)).alias("end_heading_found"),
        warnings.alias("warnings"),
    )
    return rows.select(
        *[c for c in chunks.columns if c != "text"], F.col("__t2").alias("text"), cleanup.alias("boundary_cleanup")
    )


# -- page ranges, counts, groups ----------------------------------------------


def page_offset(contents: DataFrame, page_lines: DataFrame, doc: str = "doc") -> DataFrame:
    """Printed minus actual page per document, from the first contents entry found as a heading.

    ``contents``: (doc, position, title, printed); ``page_lines``: (doc, page, line_no, line).
    A blank title is in no line.
    """
    heads = page_lines.filter(F.startswith("line", F.lit("#"))).select(F.struct("page", "line_no").alias("text_id"), F.lower("line").alias("norm"), doc).distinct()
    # a place that several lines share stands for all of them: each is tried, so the id that every word carries needs no text
    titles = contents.select(F.struct("position", "title", "printed").alias("pattern_id"), F.lower(F.trim("title")).alias("norm"), doc).distinct()
    hit = find_patterns(titles, heads, [doc]).select(doc, "pattern_id.position", "pattern_id.printed", "text_id.page", "text_id.line_no")
    return hit.groupBy(doc).agg(
        F.min_by(F.col("printed") - F.col("page"), F.struct("position", "page", "line_no")).alias("offset")
    )


def chapter_ranges(marks: DataFrame, ends: DataFrame, doc: str = "doc") -> DataFrame:
    """Page range of each chapter: up to one page before the next mark.

    ``marks``: (doc, start, title) with actual start pages; ``ends``: (doc, last_page).
    """
    starts = marks.groupBy(doc, "start", "title").agg(F.lit(1).alias("__one"))
    scanned = ordered_scan(
        starts,
        [doc],
        ["start", "title"],
        tile_of_integer("start"),
        {"next_start": Scan("next", F.col("start")), "chapter_number": Scan("sum", F.lit(1))},
    )
    return scanned.join(ends, doc).select(
        doc,
        "chapter_number",
        "title",
        F.col("start").alias("first_page"),
        F.coalesce(F.col("next_start") - 1, F.col("last_page")).alias("last_page"),
    )


def pages_in_ranges(pages: DataFrame, marks: DataFrame, doc: str = "doc") -> DataFrame:
    """Each page with its chapter. Ranges follow from starts alone, so this is a forward fill, not a range join.

    Of several marks on one page the last takes it; the others have empty ranges.
    """
    starts = marks.groupBy(doc, F.col("start").alias("page")).agg(F.max_by("title", "title").alias("__title"))
    # pages that hold a mark but no content still carry the fill
    grid = pages.select(doc, "page").distinct().join(starts, [doc, "page"], "full_outer")
    filled = ordered_scan(grid, [doc], ["page"], tile_of_integer("page"), {"chapter": Scan("last", F.col("__title"))})
    return pages.join(filled.select(doc, "page", "chapter"), [doc, "page"]).filter(F.col("chapter").isNotNull())


def assignment_counts(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Chunks per chapter and section, with chapter and document totals."""
    body = chunks.filter(~F.coalesce("is_front_matter", F.lit(False))).select(
        doc,
        F.coalesce("chapter", F.concat(F.lit("CHAPTER "), F.col("chapter_number").cast("string"))).alias("chapter"),
        F.coalesce("section", F.lit("Unassigned")).alias("section"),
    )
    return body.rollup(doc, "chapter", "section").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.grouping_id().alias("level")
    )


def cleanup_counts(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Boundary-cleanup counters per chapter."""
    b = lambda name: F.col(f"boundary_cleanup.{name}")
    return chunks.groupBy(doc, F.coalesce("chapter", F.lit("front_matter")).alias("chapter")).agg(
        F.count_if(b("applied")).alias("chunks_cleaned"),
        F.count_if(b("prefix_trimmed_chars") > 0).alias("prefix_trims"),
        F.count_if(b("suffix_trimmed_chars") > 0).alias("suffix_trims"),
        F.count_if(F.size(b("warnings")) > 0).alias("warnings"),
    )


def chapter_order(chunks: DataFrame, doc: str = "doc", id: str = "id") -> DataFrame:
    """Body chunks sorted by chapter in natural order.

    A range-partitioned sort: a chapter of any size spreads over as many tasks as it needs.
    """
    number = T.int_or_null("chapter_number")
    body = chunks.filter(~F.coalesce("is_front_matter", F.lit(False)) & number.isNotNull())
    return body.withColumn("chapter_number", number).orderBy(
        doc, "chapter_number", F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0)), T.natural_key(id)
    )


def facet_tree(chunks: DataFrame, levels: list[str], content: str = "content_type") -> DataFrame:
    """Counts and distinct content types at every depth of the facet tree."""
    per_type = chunks.groupBy(*levels, content).agg(F.count(F.lit(1)).alias("n"))
    return per_type.rollup(*levels).agg(
        F.array_sort(F.collect_set(content)).alias("content_types"),
        F.sum("n").alias("chunk_count"),
        F.grouping_id().alias("level"),
    )


def lesson_marker(text: Column | str) -> Column:
    """Marker from the first ten lines: ``LESSON n`` or ``RECAP LESSON n``."""
    pattern = rf"(?i)^(recap\s+lesson|lesson)\s+(\d+){T.WORD_AFTER}"
    head = F.transform(F.slice(T.lines(F.coalesce(text, F.lit(""))), 1, 10), T.squash)
    hit = F.get(F.filter(head, lambda v: v.rlike(pattern)), 0)
    prefix = F.when(F.lower(hit).rlike("^recap"), "RECAP LESSON ").otherwise("LESSON ")
    number = F.regexp_extract(hit, pattern, 2).try_cast("decimal(38,0)").cast("string")
    return F.when(hit.isNotNull(), F.concat(prefix, number))


def marker_runs(
    rows: DataFrame, keys: list[str], order: list[str], tile: Column | None, marker: str = "marker", opened: list[str] | None = None
) -> DataFrame:
    """A marker unlike the current one opens the next run (D19); rows before any marker have run 0.

    Two scans: the previous marker, then the running count of changes with what the
    opening row held (``opened`` columns, as ``opened_by``).
    """
    seen = ordered_scan(rows, keys, order, tile, {"__prev": Scan("last_before", F.col(marker))})
    change = F.col(marker).isNotNull() & ~F.col(marker).eqNullSafe(F.col("__prev"))
    flagged = seen.withColumn("__change", change.cast("int"))
    scans = {"run": Scan("sum", F.col("__change")), "current": Scan("last", F.col(marker))}
    if opened:
        scans["opened_by"] = Scan("last", F.when(F.col("__change") == 1, F.struct(*opened)))
    return ordered_scan(flagged, keys, order, tile, scans).drop("__prev", "__change")


def lesson_chapters(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Chapters from lesson markers, for documents without any other structure."""
    rows = T.pinned(chunks, chunks.columns, {"__marker": lesson_marker(F.col("text"))})
    runs = marker_runs(rows, [doc], ["ord"], tile_of_integer("ord"), "__marker", ["id", "page_start"])
    front = F.col("run") == 0
    return runs.select(
        *chunks.columns,
        F.when(~front, F.col("current")).alias("chapter"),
        F.when(~front, F.col("run")).alias("chapter_number"),
        F.col("opened_by.id").alias("chapter_source_chunk_id"),
        F.col("opened_by.page_start").alias("chapter_source_page"),
        front.alias("is_front_matter"),
        F.when(~front, F.col("current")).alias("section"),
    )
