"""Inputs derived from the driver tables, as SQL for both engines."""

from quire.plans.registry import derive

# Documents as the chunks of books: a book per source, a chunk per document, in id order.
derive(
    "chunks",
    """SELECT source AS doc, doc_id AS ord, 'c' || CAST(doc_id AS STRING) AS id, text, lang,
       CAST(floor(doc_id / 3) AS INT) + 1 AS page_start, CAST(floor(doc_id / 3) AS INT) + 1 AS page_end
       FROM documents""",
)

# Chapter markers: some chunks open a chapter; a few name no number, a few sit on one chunk twice.
derive(
    "chapter_marks",
    """SELECT source AS doc, 'c' || CAST(doc_id AS STRING) AS id,
       CASE WHEN doc_id % 19 = 0 THEN 'Interlude' ELSE 'CHAPTER ' || CAST(1 + n_chars % 40 AS STRING) END AS heading,
       doc_id * 2 AS position, CAST(floor(doc_id / 3) AS INT) + 1 AS page_start
       FROM documents WHERE n_chars % 7 = 3
       UNION ALL
       SELECT source AS doc, 'c' || CAST(doc_id AS STRING) AS id, 'Chapter ' || CAST(50 + doc_id % 9 AS STRING) AS heading,
       doc_id * 2 + 1 AS position, CAST(floor(doc_id / 3) AS INT) + 1 AS page_start
       FROM documents WHERE n_chars % 35 = 3""",
)

# Chunks with a chapter and section read off their place, front matter first.
derive(
    "placed",
    """SELECT source AS doc, doc_id AS ord, 'c' || CAST(doc_id AS STRING) AS id, text, lang,
       CASE WHEN n_chars % 11 = 0 THEN NULL ELSE CAST(n_chars % 9 AS INT) END AS chapter_number,
       CASE WHEN n_chars % 11 = 0 THEN NULL ELSE 'CHAPTER ' || CAST(n_chars % 9 AS STRING) END AS chapter,
       n_chars % 11 = 0 AS is_front_matter,
       CASE WHEN n_chars % 5 = 0 THEN NULL ELSE 'Part ' || CAST(n_chars % 6 AS STRING) END AS section,
       CASE WHEN n_chars % 13 = 0 THEN NULL ELSE CAST(n_chars % 200 AS INT) END AS page_start,
       CAST(n_chars % 200 + 1 AS INT) AS page_end, lang AS content_type
       FROM documents""",
)

# Whole lines marked by their place so that headings, questions, list items and noise occur.
_CASE = """CASE (doc_id * 7 + ({i})) % 16
  WHEN 0 THEN 'CHAPTER ' || CAST(1 + doc_id % 9 AS STRING)
  WHEN 1 THEN CAST(1 + doc_id % 9 AS STRING) || '.' || CAST(1 + ({i}) % 7 AS STRING) || ' ' || l
  WHEN 2 THEN 'What is ' || l || ' now?'
  WHEN 3 THEN upper(replace(l, 'ß', 'ss'))
  WHEN 4 THEN l
  WHEN 5 THEN CAST(1 + ({i}) % 30 AS STRING) || '. ' || l || ' . . . . ' || CAST(doc_id % 300 AS STRING)
  WHEN 6 THEN 'www.' || l
  WHEN 7 THEN 'Chapter ' || CAST(1 + ({i}) % 12 AS STRING) || ': ' || l
  WHEN 8 THEN CAST(({i}) AS STRING) || ') ' || l
  WHEN 9 THEN 'Table of Contents'
  WHEN 10 THEN l || ' ' || CAST(doc_id % 90 AS STRING)
  ELSE l END"""
derive(
    "structured",
    f"""SELECT source AS doc, doc_id AS ord, 'c' || CAST(doc_id AS STRING) AS id, lang,
        CAST(doc_id % 4 AS INT) AS chapter_number, 'CHAPTER ' || CAST(doc_id % 4 AS STRING) AS chapter,
        CAST(floor(doc_id / 3) AS INT) + 1 AS page_start, CAST(floor(doc_id / 3) AS INT) + 1 AS page_end,
        array_join(transform(split(text, chr(10)), (l, i) -> {_CASE.format(i='i')}), chr(10)) AS text
        FROM documents""",
    f"""SELECT source AS doc, doc_id AS ord, 'c' || CAST(doc_id AS STRING) AS id, lang,
        CAST(doc_id % 4 AS INT) AS chapter_number, 'CHAPTER ' || CAST(doc_id % 4 AS STRING) AS chapter,
        CAST(floor(doc_id / 3) AS INT) + 1 AS page_start, CAST(floor(doc_id / 3) AS INT) + 1 AS page_end,
        array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {_CASE.format(i='i - 1')}), chr(10)) AS text
        FROM documents""",
)

# Oracle-side helpers: the non-blank lines of a text with their neighbours.
derive(
    "structured_lines",
    "SELECT 1 AS unused",
    """SELECT doc, ord, id, lang, chapter_number, chapter, page_start, page_end, line_no, line,
       row_number() OVER (PARTITION BY ord ORDER BY line_no) AS k
       FROM (SELECT doc, ord, id, lang, chapter_number, chapter, page_start, page_end, CAST(t.i AS INT) AS line_no, trim(l[t.i + 1]) AS line
             FROM (SELECT *, string_split(text, chr(10)) AS l FROM structured) s, UNNEST(range(len(s.l))) AS t(i))
       WHERE line <> ''""",
)

# Answers of learners: users, items by event, right or wrong by type.
derive(
    "attempts",
    """SELECT 'u' || CAST(user_id AS STRING) AS learner, 'i' || CAST(event_id % 20 AS STRING) AS item_id, event_id AS attempt_id, ts,
       event_type IN ('purchase', 'click', 'view') AS correct
       FROM events""",
)
