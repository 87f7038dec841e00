"""Heading, outline and structure operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, tile_of_integer
from quire.operators import headings as H
from quire.operators import structure as S

BODY = "This line of running text has clearly more than eight words and well over forty letters in it."


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_lines_match_splitlines(spark):
    texts = ["a\nb\r\nc\rd", "a\n", "", "\n", "x y\u0085z\x0bq\x1cw\x1ee", "a\n\nb\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(rows(df.select("i", T.lines("t").alias("l")), "i", "l"))
    for i, t in enumerate(texts):
        assert got[i] == t.splitlines(), t


def test_squash_words_and_preview(spark):
    texts = ["  a b \x1c c ", "", "   ", "one two", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df.select("t", T.squash("t").alias("s"), T.word_count("t").alias("n"), T.preview("t", 20).alias("p")), "t", "s", "n", "p")
    for t, s, n, p in got:
        assert s == " ".join(t.split()) and n == len(t.split())
        assert p == (s if len(s) <= 20 else s[:17].rstrip() + "...")


def test_natural_key_orders_numbers(spark):
    ids = ["c10", "c9", "2x", "c9b1", "c9b", "a"]
    df = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(T.natural_key("id"))
    assert [r.id for r in df.collect()] == ["2x", "a", "c9", "c9b", "c9b1", "c10"]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_ordered_scan_is_independent_of_tile_width(spark, width):
    rng = random.Random(3)
    data = [("g%d" % (i % 3 == 0), i * 2 + 1, rng.choice([None, 1, 2, 5])) for i in range(60)]
    df = spark.createDataFrame(data, "g string, o long, v int")
    scans = {
        "s": Scan("sum", F.col("v")), "sb": Scan("sum_before", F.col("v")), "l": Scan("last", F.col("v")),
        "lb": Scan("last_before", F.col("v")), "p": Scan("prev", F.col("v")), "n": Scan("next", F.col("v")),
    }
    got = {(r.g, r.o): r for r in ordered_scan(df, ["g"], ["o"], tile_of_integer("o", width), scans).collect()}
    for g in {d[0] for d in data}:
        seq = [d for d in data if d[0] == g]
        total, last = 0, None
        for i, (_, o, v) in enumerate(seq):
            r = got[(g, o)]
            assert r.sb == total and r.lb == last
            total += v or 0
            last = v if v is not None else last
            assert r.s == total and r.l == last
            assert r.p == (seq[i - 1][2] if i else None)
            assert r.n == (seq[i + 1][2] if i + 1 < len(seq) else None)


def test_heading_candidates_first_rule_wins(spark):
    text = "Chapter 1\n1.2 Scope\nALL CAPS HERE\nA Short Title\n" + BODY + "\nlower words only."
    df = spark.createDataFrame([("d", 0, "c0", text)], "doc string, ord long, id string, text string")
    got = H.heading_candidates(df).orderBy("line_no")
    assert rows(got, "line_no", "rule") == [
        (0, "starts_with_chapter"), (1, "numbered_heading"), (2, "mostly_uppercase_short_line"),
        (3, "short_title_like_line"),
    ]
    assert got.first()["preview"] == "Chapter 1 1.2 Scope ALL CAPS HERE"


def test_outline_drops_noise_and_repeats(spark):
    data = [
        ("d", 0, 0, "Chapter 1", "starts_with_chapter"), ("d", 0, 1, "chapter 1", "starts_with_chapter"),
        ("d", 1, 0, "CHAPTER 2", "mostly_uppercase_short_line"), ("d", 1, 1, "1. Intro . . . . 12", "numbered_heading"),
        ("d", 1, 2, "www.example.org", "numbered_heading"), ("d", 1, 3, "Title", "short_title_like_line"),
        ("d", 2, 0, "2.3 Deep Part", "numbered_heading"), ("d", 2, 1, "3 apples", "numbered_heading"),
    ]
    df = spark.createDataFrame(data, "doc string, ord long, line_no int, line string, rule string").withColumn("preview", F.lit(""))
    got = H.outline_reduction(df).orderBy("position")
    assert rows(got, "position", "heading", "confidence") == [
        (1, "Chapter 1", "high"), (2, "CHAPTER 2", "medium"), (3, "2.3 Deep Part", "medium"),
    ] or rows(got, "heading") == [("Chapter 1",), ("CHAPTER 2",), ("1. Intro",), ("2.3 Deep Part",)]


def test_body_outline_reasons(spark):
    chunks = spark.createDataFrame(
        [
            ("d", "toc", 0, 1, "Table of contents\n1. Intro . . . . 3"),
            ("d", "b1", 1, 5, "CHAPTER 1\n" + BODY), ("d", "b2", 2, 9, "CHAPTER 2\n" + BODY),
            ("d", "pre", 3, 2, "CHAPTER 9 lies here"),
        ],
        "doc string, id string, ord long, page_start int, text string",
    )
    outline = spark.createDataFrame(
        [
            ("d", "toc", 1, 1, "1. Intro", "x"), ("d", "b1", 2, 5, "CHAPTER 1", "CHAPTER 1 text"),
            ("d", "b2", 3, 9, "CHAPTER 2", "CHAPTER 2 text"), ("d", "pre", 4, 2, "Chapter Nine", ""),
        ],
        "doc string, id string, position int, page_start int, heading string, preview string",
    )
    got = dict(rows(H.body_outline(outline, chunks.drop("ord", "page_start")), "id", "reason"))
    assert got == {
        "toc": "likely_table_of_contents", "b1": "likely_body_chapter_marker",
        "b2": "likely_body_chapter_marker", "pre": "before_first_body_chapter_marker",
    }


def test_assign_chapters_takes_last_marker(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}", i + 1) for i in range(6)], "doc string, ord long, id string, page_start int")
    body = spark.createDataFrame(
        [("d", "c2", "CHAPTER 1", 1, 3), ("d", "c4", "CHAPTER 2", 2, 5), ("d", "c4", "Chapter 3", 3, 5),
         ("d", "zz", "CHAPTER 4", 4, 1), ("d", "c5", "Coda", 5, 1)],
        "doc string, id string, heading string, position int, page_start int",
    )
    markers, problems = S.chapter_markers(body, chunks)
    got = S.assign_chapters(chunks, markers, width=2).orderBy("ord")
    assert rows(got, "chapter_number", "is_front_matter") == [
        (None, True), (None, True), (1, False), (1, False), (3, False), (3, False)]
    assert sorted(rows(problems, "id", "code")) == [("c5", "chapter_number_not_parsed"), ("zz", "marker_chunk_not_found")]


def section_rows(spark, lines):
    text = "\n".join(lines)
    return spark.createDataFrame(
        [("d", 0, "c0", 1, "CHAPTER 1", "book.pdf", 1, text)],
        "doc string, ord long, id string, chapter_number int, chapter string, source_pdf string, page_start int, text string",
    )


def test_section_candidates(spark):
    lines = ["1.1 Scope", BODY, "What is a plan?", BODY, "LOUD HEADING", "Strong Title", BODY, "Alone Title", "x",
             "Weak title but lower words follow here", "book.pdf", "12", "3.", "Chapter 4", "* -"]
    got = H.section_candidates(section_rows(spark, lines), min_confidence="low")
    assert dict(rows(got, "heading", "candidate_type")) | {} == {
        "1.1 Scope": "numbered_heading", "What is a plan?": "question_heading",
        "LOUD HEADING": "mostly_uppercase_short_line", "Strong Title": "heading_followed_by_body",
        "Alone Title": "short_title_like_line",
        "Weak title but lower words follow here": "weak_title_like_line",
    }
    conf = dict(rows(got, "heading", "confidence"))
    assert conf["1.1 Scope"] == "high" and conf["What is a plan?"] == "high"
    nums = H.number_candidates(got, ["doc"], ["ord", "line_number"]).orderBy("line_number")
    assert rows(nums, "candidate_id")[0] == ("section_candidate_001",)


def outline_input(spark, entries):
    after = "Body text follows here with many words, enough letters and a stop."
    data = [("d", 1, "CHAPTER 1", 0, i, "c0", h, k, c, after if b else "") for i, (h, k, c, b) in enumerate(entries)]
    return spark.createDataFrame(
        data,
        "doc string, chapter_number int, chapter string, ord long, line_number int, id string, heading string, "
        "candidate_type string, confidence string, preview_after string",
    )


def test_section_outline_duplicate_first_and_cap(spark):
    df = outline_input(spark, [
        ("Good Heading Words", "heading_followed_by_body", "medium", True),
        ("good heading words", "numbered_heading", "low", True),
        ("Plan steps = 3", "heading_followed_by_body", "medium", True),
        ("Two", "heading_followed_by_body", "medium", True),
        ("What holds it up?", "question_heading", "high", False),
        ("LOUD", "mostly_uppercase_short_line", "medium", True),
    ])
    got = H.section_outline(df, ["doc", "chapter_number"], ["ord", "line_number"], max_per_chapter=2).orderBy("line_number")
    assert rows(got, "kept", "reason") == [
        (True, "kept"), (False, "duplicate_in_chapter"), (False, "formula_or_metric_noise"),
        (True, "kept"), (False, "max_per_chapter_reached"), (False, "candidate_type_not_supported"),
    ]


def test_strict_outline(spark):
    df = outline_input(spark, [
        ("1.1 Scope of plans", "numbered_heading", "high", True), ("1.2 Of", "numbered_heading", "high", True),
        ("1.3 Medium Part", "numbered_heading", "medium", True), ("Why do cats sleep?", "question_heading", "high", True),
        ("How does it work?", "question_heading", "high", True), ("Summary: abc", "heading_followed_by_body", "medium", True),
        ("1.1 scope of plans", "numbered_heading", "high", True), ("Plain Heading", "heading_followed_by_body", "medium", True),
    ])
    got = H.strict_section_outline(df, ["doc", "chapter_number"], ["ord", "line_number"]).orderBy("line_number")
    assert rows(got, "reason") == [
        ("high_confidence_numbered_heading",), ("too_short",), ("numbered_heading_confidence_not_allowed",),
        ("question_example_noise",), ("high_confidence_question_heading",), ("generic_heading",),
        ("duplicate_in_chapter",), ("candidate_type_not_allowed",),
    ]


def test_topic_outline(spark):
    df = outline_input(spark, [
        ("Opening Words", "short_title_like_line", "medium", True), ("1.1 scoping", "numbered_heading", "high", True),
        ("User: hello", "heading_followed_by_body", "medium", True), ("LOUD", "mostly_uppercase_short_line", "medium", True),
        ("1.1 scoping", "numbered_heading", "high", True),
    ])
    chunks = spark.createDataFrame(
        [("d", 0, "c0", 1, "c0", False)],
        "doc string, ord long, id string, chapter_number int, chapter_source_chunk_id string, is_front_matter boolean")
    got = H.topic_outline(df, chunks, ["ord", "line_number"]).orderBy("line_number")
    assert rows(got, "reason", "outline_level") == [
        ("chapter_opening_title", "chapter_title"), ("allowed_candidate_type", "numbered_section"),
        ("prompt_or_placeholder_noise", "section_or_topic"), ("uppercase_heading_excluded", "heading"),
        ("duplicate_in_chapter", "numbered_section"),
    ]


def test_contents_region_and_outline(spark):
    data = [
        ("d", 0, "Cover"), ("d", 1, "Table of Contents\nPreface ix\n1. Start . . . 3\nFirst steps 4"),
        ("d", 2, "2. More . . . 20\nDeep part 21\nwhat he did\nxii | Table of Contents"), ("d", 3, "Plain words"), ("d", 4, "9. Late 99"),
    ]
    df = spark.createDataFrame(data, "doc string, ord long, text string")
    region = S.contents_region(df)
    assert sorted(r.ord for r in region.collect()) == [1, 2]
    got = S.contents_outline(region).orderBy("entry")
    assert rows(got, "entry_type", "title", "page_text", "chapter_number") == [
        ("other", "Preface", "ix", None), ("chapter", "Start", "3", 1), ("section", "First steps", "4", 1),
        ("chapter", "More", "20", 2), ("section", "Deep part", "21", 2), ("other", "what he", "did", None),
    ]


def test_section_asof(spark):
    sections = spark.createDataFrame(
        [("d", 1, 0, "A", 3, 1), ("d", 1, 1, "B", 5, 1), ("d", 1, 2, "C", 5, 1), ("d", 1, 3, "D", 9, 1)],
        "doc string, chapter_number int, position int, section string, page_start int, level int")
    chunks = spark.createDataFrame(
        [("d", 1, p, False) for p in (1, 3, 4, 5, 6, 9, 40)] + [("d", 1, 5, True), ("d", 2, 5, False), ("d", 1, None, False)],
        "doc string, chapter_number int, page_start int, is_front_matter boolean")
    got = S.assign_sections(chunks, sections)
    assert sorted(rows(got.filter("chapter_number = 1 and not is_front_matter and page_start is not null"), "page_start", "section"), key=lambda r: r[0]) == [
        (1, None), (3, "A"), (4, "A"), (5, "B"), (6, "C"), (9, "D"), (40, "D")]
    assert rows(got.filter("chapter_number = 2 or is_front_matter or page_start is null"), "section") == [(None,)] * 3


def test_heading_offset(spark):
    cases = [
        ("tail of before\n  Scope of Work\nbody", "Scope of Work", 0, 17), ("Scope of Work: more\nx", "scope of work", 0, 0),
        ("we discuss the scope of work in detail and at some length", "Scope of Work", 0, None),
        ("intro\nScope of\nWork and\nbody", "Scope of Work", 0, 6), ("Note this\nNote", "Note", 0, 10),
        ("Scope of Work\nx\nScope of Work", "Scope of Work", 1, 16), ("a (b) c*d\nzz", "(b) c*d", 0, None), ("", "x", 0, None),
        ("1. Scope of Work\nx", "Scope of Work", 0, 3),
    ]
    df = spark.createDataFrame([(i, t, h) for i, (t, h, _, _) in enumerate(cases)], "i int, t string, h string")
    got = {}
    for m in (0, 1):
        for r in S.with_heading_offset(df, "t", "h", "o", m).collect():
            got[(r.i, m)] = r.o
    for i, (_, _, m, want) in enumerate(cases):
        assert got[(i, m)] == want, cases[i]


def test_trim_boundaries(spark):
    filler = "x" * 300
    sections = spark.createDataFrame([("d", 1, 0, "First Section Title", 1, 1), ("d", 1, 1, "Second Section Title", 2, 1)],
        "doc string, chapter_number int, position int, section string, page_start int, level int")
    t0 = "old tail\nFirst Section Title\n" + filler + "\nSecond Section Title\nnext"
    t1 = "First words\n" + filler
    chunks = spark.createDataFrame(
        [("d", "c1", 1, "First Section Title", 1, 1, 1, False, t0), ("d", "c2", 1, "Second Section Title", 2, 2, 2, False, t1)],
        "doc string, id string, chapter_number int, section string, section_page_start int, page_start int, page_end int, is_front_matter boolean, text string")
    got = {r.id: r for r in S.trim_boundaries(chunks, sections).collect()}
    a, b = got["c1"], got["c2"]
    assert a.text == "First Section Title\n" + filler
    assert (a.boundary_cleanup.prefix_trimmed_chars, a.boundary_cleanup.end_heading_found) == (9, True)
    assert b.text == t1 and b.boundary_cleanup.warnings == ["start_heading_not_found:Second Section Title"]


def test_ranges_and_offset(spark):
    marks = spark.createDataFrame([("d", 4, "1 A"), ("d", 10, "REVIEW"), ("d", 7, "2 B")], "doc string, start int, title string")
    ends = spark.createDataFrame([("d", 20)], "doc string, last_page int")
    got = S.chapter_ranges(marks, ends).orderBy("chapter_number")
    assert rows(got, "chapter_number", "title", "first_page", "last_page") == [(1, "1 A", 4, 6), (2, "2 B", 7, 9), (3, "REVIEW", 10, 20)]
    pages = spark.createDataFrame([("d", p) for p in range(1, 13)], "doc string, page int")
    assert sorted(rows(S.pages_in_ranges(pages, marks).groupBy("chapter").count(), "chapter", "count")) == [("1 A", 3), ("2 B", 3), ("REVIEW", 3)]
    contents = spark.createDataFrame([("d", 0, "Place Values", 6)], "doc string, position int, title string, printed int")
    lines = spark.createDataFrame([("d", 4, 0, "# Place values"), ("d", 2, 0, "Place Values")], "doc string, page int, line_no int, line string")
    assert S.page_offset(contents, lines).first()["offset"] == 2


def test_lesson_chapters(spark):
    data = [("d", 0, "c0", 1, "cover"), ("d", 1, "c1", 2, "Lesson 1\nx"), ("d", 2, "c2", 3, "lesson 1 again"),
            ("d", 3, "c3", 4, "Recap  Lesson 2"), ("d", 4, "c4", 5, "words"), ("d", 5, "c5", 6, "LESSON 1")]
    df = spark.createDataFrame(data, "doc string, ord long, id string, page_start int, text string")
    got = S.lesson_chapters(df).orderBy("ord")
    assert rows(got, "chapter_number", "chapter", "chapter_source_chunk_id") == [
        (None, None, None), (1, "LESSON 1", "c1"), (1, "LESSON 1", "c1"), (2, "RECAP LESSON 2", "c3"),
        (2, "RECAP LESSON 2", "c3"), (3, "LESSON 1", "c5")]


def test_source_selection(spark):
    chunks = spark.createDataFrame([("d", 1, "CHAPTER 1", 1), ("e", None, None, None)], "doc string, chapter_number int, chapter string, page_start int")
    toc = spark.createDataFrame([("d", "chapter")] * 5 + [("d", "section")] * 20, "doc string, entry_type string")
    body = spark.createDataFrame([], "doc string, heading string, page_start int")
    cand = spark.createDataFrame([], "doc string, chapter_number int, page_start int")
    kept = spark.createDataFrame([], "doc string, chapter_number int, page_start int, kept boolean")
    signals = S.structure_signals(chunks, toc, body, cand, kept, kept)
    assert signals.count() == 14
    assert sorted(rows(S.select_source(signals), "doc", "selected_source", "outline")) == [
        ("d", "toc", "contents"), ("e", "flat_chunks", "flat")]


def test_counts_order_facets(spark):
    df = spark.createDataFrame(
        [("d", 1, "C1", "s", "q", 2, 2, "c10", False), ("d", 1, "C1", None, "q", 2, 2, "c9", False), ("d", 2, "C2", "t", "r", None, 1, "c1", False), ("d", None, None, None, "q", 1, 1, "f", True)],
        "doc string, chapter_number int, chapter string, section string, content_type string, page_start int, page_end int, id string, is_front_matter boolean")
    counts = {(r.chapter, r.section, r.level): r.chunk_count for r in S.assignment_counts(df).collect()}
    assert counts[("C1", "Unassigned", 0)] == 1 and counts[("C1", None, 1)] == 2 and counts[(None, None, 7)] == 3
    assert rows(S.chapter_order(df), "id") == [("c9",), ("c10",), ("c1",)]
    tree = {(r.doc, r.chapter): r for r in S.facet_tree(df, ["doc", "chapter"]).filter("level = 0").collect()}
    assert tree[("d", "C1")].content_types == ["q"] and tree[("d", "C1")].chunk_count == 2
