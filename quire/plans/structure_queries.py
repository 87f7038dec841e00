"""Document structure queries."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import position_in_group, read_once, tile_of_integer
from quire.operators import headings as H
from quire.operators import structure as S
from quire.plans.registry import ORACLES, Tables, derive, query
from quire.sources import chunks as C

_LET = r"len(regexp_extract_all({c}, '\p{{L}}'))"
_UP = r"len(regexp_extract_all({c}, '\p{{Lu}}'))"
_DIG = r"len(regexp_extract_all({c}, '\p{{Nd}}'))"
_SYM = r"len(regexp_extract_all({c}, '[^\p{{L}}\p{{N}}\s]'))"
_WRD = r"CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END"


def let(c): return _LET.format(c=c)
def up(c): return _UP.format(c=c)
def dig(c): return _DIG.format(c=c)
def sym(c): return _SYM.format(c=c)
def wrd(c): return "(" + _WRD.format(c=c) + ")"
def m(c, pattern): return f"regexp_matches({c}, '" + pattern.replace("'", "''") + "')"


def titled(c: str, strip: str) -> str:
    """Capitalised or numeric words of a squashed line."""
    return (
        f"len(list_filter(list_transform(string_split({c}, ' '), lambda x: trim(x, {strip})), "
        r"lambda x: regexp_matches(x, '^\p{Lu}') OR regexp_full_match(x, '\p{Nd}+')))"
    )


def squashed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


QUOTES = "'\"''()[]{}'"
QUOTES_COLON = "'\"''()[]{}:'"
URL = r"(?i)https?://|www\.|\S+@\S+\.\S+"
PAGE_NO = r"(?i)^(?:page\s*)?\d{1,4}$"
FOOT = r"(?i)copyright|©|all rights reserved|printed in|oreilly\.com|o'reilly|isbn"
LEADERS = r"(?:\.\s*){3,}\s*\d+\b"
RUNNING = r"(?i)chapter\s+\d+\s*\||\|\s*chapter\s+\d+"
BAR = r"^\d{1,4}\s*\||\|\s*\d{1,4}$"
STARTERS = "['what ', 'why ', 'how ', 'when ', 'where ', 'who ', 'which ', 'can ', 'could ', 'should ', 'does ', 'do ', 'is ', 'are ', 'will ']"
CODES = "['def ', 'class ', 'import ', 'from ', 'return ', 'const ', 'let ', 'var ', 'function ', 'print(']"


def starts(c: str, names: str) -> str:
    return f"len(list_filter({names}, lambda p: starts_with({c}, p))) > 0"


def holds(c: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in names) + ")"


derive(
    "heads",
    "SELECT 1 AS unused",
    rf"""SELECT * FROM (SELECT *, CASE
         WHEN {m('line', r'^Chapter([^\p{L}\p{N}_]|$)')} THEN 'starts_with_chapter' WHEN {m('line', r'^Unit([^\p{L}\p{N}_]|$)')} THEN 'starts_with_unit'
         WHEN {m('line', r'^Module([^\p{L}\p{N}_]|$)')} THEN 'starts_with_module' WHEN {m('line', r'^Lesson([^\p{L}\p{N}_]|$)')} THEN 'starts_with_lesson'
         WHEN {m('line', r'^Section([^\p{L}\p{N}_]|$)')} THEN 'starts_with_section'
         WHEN {m('line', r'^\d+(?:\.\d+)*\.?\s+\S+')} THEN 'numbered_heading'
         WHEN len(line) <= 80 AND {let('line')} > 0 AND {up('line')} * 1.0 / {let('line')} >= 0.8 THEN 'mostly_uppercase_short_line'
         WHEN len(line) < 100 AND NOT {m('line', r'[.,;:]$')} AND {wrd(squashed('line'))} BETWEEN 1 AND 12
           AND {titled(squashed('line'), QUOTES)} >= greatest(1, floor({wrd(squashed('line'))} / 2)) THEN 'short_title_like_line' END AS rule
       FROM structured_lines) WHERE rule IS NOT NULL""",
)


@query(
    "heading_candidates",
    r"""SELECT h.id, h.line_no, any_value(h.line) AS line, any_value(h.rule) AS rule, substr(string_agg(n.line, ' ' ORDER BY n.line_no), 1, 500) AS preview
        FROM heads h JOIN structured_lines n ON n.ord = h.ord AND n.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY h.id, h.line_no""",
)
def heading_candidates(t: Tables):
    return H.heading_candidates(t.structured, keep=["id"])


_H = "heading"
derive(
    "outlined",
    "SELECT 1 AS unused",
    rf"""SELECT doc, ord, id, line_no, page_start, page_end, rule, heading, row_number() OVER (PARTITION BY doc ORDER BY ord, line_no) AS position FROM (
         SELECT *, row_number() OVER (PARTITION BY doc, lower(heading) ORDER BY ord, line_no) AS dup FROM (
           SELECT *, {squashed("CASE WHEN rule = 'numbered_heading' AND " + m('o', r'^\d+\.\s+.+(?:\.\s*){3,}\s*\d+\s*$') + r" THEN regexp_replace(o, '\s*(?:\.\s*){3,}\s*\d+\s*$', '') ELSE o END")} AS heading
           FROM (SELECT *, {squashed('line')} AS o FROM heads))
         WHERE rule IN ('starts_with_chapter', 'numbered_heading', 'mostly_uppercase_short_line') AND len(heading) BETWEEN 3 AND 120
           AND NOT {m(_H, PAGE_NO)} AND NOT {m(_H, URL)} AND NOT {m(_H, FOOT + r'|us\s*\$|can\s*\$')}
           AND {sym(_H)} <= 6 AND {sym(_H)} * 1.0 / len(heading) <= 0.25
           AND NOT ({dig(_H)} >= 4 AND {let(_H)} = 0)
           AND NOT ({m(_H, r'(?i)^\d+\s*\|\s*chapter\b')} OR ({m(_H, r'(?i)\bchapter\s+\d+:')} AND contains(heading, '|')))
           AND CASE rule WHEN 'starts_with_chapter' THEN {m(_H, r'(?i)^chapter\s+\d+$|^chapter\s+\d+\s*[:\-]\s+\S+')}
             WHEN 'numbered_heading' THEN {m('o', r'^\d+\.\s+.+(?:\.\s*){3,}\s*\d+\s*$')} OR {m('o', r'^\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\s+[A-Z]')}
             ELSE {m(_H, r'^CHAPTER\s+\d+\b')} END
       ) WHERE dup = 1""",
)


def _outline(t: Tables):
    found = H.heading_candidates(t.structured, keep=["doc", "ord", "id", "page_start", "page_end"])
    return H.outline_reduction(found)


@query(
    "outline_reduction",
    "SELECT doc, id, line_no, heading, rule, position, CASE WHEN rule = 'starts_with_chapter' THEN 'high' ELSE 'medium' END AS confidence FROM outlined",
)
def outline_reduction(t: Tables):
    return _outline(t).select("doc", "id", "line_no", "heading", "rule", F.col("position").cast("long").alias("position"), "confidence")


@query(
    "body_outline",
    rf"""WITH fb AS (SELECT doc, min(page_start) AS body FROM outlined WHERE {m('heading', r'^CHAPTER\s+\d+$')} GROUP BY doc),
       pv AS (SELECT o.doc, o.ord, o.line_no, substr(string_agg(n.line, ' ' ORDER BY n.line_no), 1, 500) AS preview FROM outlined o JOIN structured_lines n ON n.ord = o.ord AND n.line_no BETWEEN o.line_no - 2 AND o.line_no + 2 GROUP BY o.doc, o.ord, o.line_no),
       j AS (SELECT o.*, pv.preview, s.text, fb.body, {m('o.heading', r'^(?:CHAPTER|Chapter)\s+\d+$|^Chapter\s+\d+\s*[:\-]\s+\S+')} AS is_body FROM outlined o JOIN pv USING (doc, ord, line_no) JOIN structured s USING (doc, ord) LEFT JOIN fb ON fb.doc = o.doc)
       SELECT doc, id, line_no, reason, reason <> 'likely_body_chapter_marker' AS is_toc FROM (SELECT *, CASE
         WHEN contains(lower(text), 'contents') THEN 'likely_table_of_contents'
         WHEN len(regexp_extract_all(text, '\b\d+\.\s+[A-Z][A-Za-z].*?{LEADERS}')) + len(regexp_extract_all(text, '\bCHAPTER\s+\d+\b')) + len(regexp_extract_all(text, '\bChapter\s+\d+\b')) >= 3 THEN 'many_chapter_lines_close_together'
         WHEN page_start < body THEN 'before_first_body_chapter_marker'
         WHEN {m('heading', r'^\d+\.\s+\S+')} AND ({m('preview', LEADERS)} OR {m('text', LEADERS)}) THEN 'chapter_listing_with_page_references'
         WHEN page_start <= body AND NOT is_body THEN 'early_duplicate_or_toc_like_entry'
         WHEN is_body AND (list_contains(list_transform(string_split(text, chr(10)), lambda x: trim(x)), heading) OR NOT (contains(lower(preview), 'table of contents') OR {m('preview', LEADERS)})) THEN 'likely_body_chapter_marker'
         ELSE 'not_likely_body_marker' END AS reason FROM j)""",
)
def body_outline(t: Tables):
    outline = _outline(t)
    body = H.body_outline(outline.drop("line"), t.structured.select("doc", "id", "text"))
    return body.select("doc", "id", "line_no", "reason", "is_toc")


@query(
    "chunk_profile",
    """WITH c AS (SELECT doc, count(*) AS n FROM heads GROUP BY doc)
       SELECT s.doc, count(*) AS chunk_count, CAST(sum(len(text)) AS BIGINT) AS total_characters, min(len(text)) AS min_chunk_length, max(len(text)) AS max_chunk_length,
       round(avg(len(text)) + 1e-9, 2) AS average_chunk_length, count(*) FILTER (WHERE len(text) = 0) AS empty_chunk_count, arg_min(id, ord) AS first_chunk_id, arg_max(id, ord) AS last_chunk_id,
       coalesce(any_value(c.n), 0) AS candidate_count FROM structured s LEFT JOIN c ON c.doc = s.doc GROUP BY s.doc""",
)
def chunk_profile(t: Tables):
    p = S.corpus_profile(t.structured, H.heading_candidates(t.structured, keep=["doc"]), ["doc"])
    return p.select(
        "doc", "chunk_count", "total_characters", *[F.col(c).cast("long").alias(c) for c in ("min_chunk_length", "max_chunk_length")],
        F.round(F.col("total_characters") / F.col("chunk_count") + 1e-9, 2).alias("average_chunk_length"),
        "empty_chunk_count", "first_chunk_id", "last_chunk_id", "candidate_count",
    )


@query(
    "metadata_profile",
    """WITH p AS (SELECT doc_id AS ord, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'size', CAST(n_chars % 50 AS STRING) FROM documents),
       v AS (SELECT key, value, count(*) AS n, min(ord) AS seen FROM p GROUP BY key, value), s AS (SELECT key, CAST(sum(n) AS BIGINT) AS chunk_count, count(*) AS unique_value_count FROM v GROUP BY key)
       SELECT key, chunk_count, unique_value_count, CAST(r AS INT) AS rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, seen, value) AS r FROM v) JOIN s USING (key) WHERE r <= 5""",
)
def metadata_profile(t: Tables):
    meta = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("size"), (F.col("n_chars") % 50).cast("string"))
    return S.metadata_profile(t.documents.select(F.col("doc_id").alias("ord"), meta.alias("metadata")))


@query(
    "chapter_fill",
    r"""WITH g AS (SELECT k.doc, c.ord, arg_max(k.heading, k.position) AS heading, arg_max(k.id, k.position) AS src, any_value(c.page_start) AS pg FROM (SELECT *, regexp_extract(heading, '(?i)chapter\s+(\d+)', 1) AS n FROM chapter_marks) k
         JOIN chunks c USING (doc, id) WHERE n <> '' GROUP BY k.doc, c.ord)
       SELECT c.id, last_value(g.heading IGNORE NULLS) OVER w AS chapter, CAST(regexp_extract(last_value(g.heading IGNORE NULLS) OVER w, '(\d+)', 1) AS INT) AS chapter_number,
       last_value(g.src IGNORE NULLS) OVER w AS chapter_source_chunk_id, last_value(g.pg IGNORE NULLS) OVER w AS chapter_source_page, last_value(g.heading IGNORE NULLS) OVER w IS NULL AS is_front_matter
       FROM chunks c LEFT JOIN g USING (doc, ord) WINDOW w AS (PARTITION BY c.doc ORDER BY c.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def chapter_fill(t: Tables):
    chunks = t.chunks.drop("text")
    markers, _ = S.chapter_markers(t.chapter_marks, chunks)
    return S.assign_chapters(chunks, markers).select(
        "id", "chapter", "chapter_number", "chapter_source_chunk_id", "chapter_source_page", "is_front_matter"
    )


@query(
    "chapter_marker_problems",
    r"""SELECT doc, id, heading, 'chapter_number_not_parsed' AS code FROM chapter_marks WHERE NOT regexp_matches(heading, '(?i)chapter\s+\d+')""",
)
def chapter_marker_problems(t: Tables):
    return S.chapter_markers(t.chapter_marks, t.chunks)[1]


# -- section candidates and outlines -------------------------------------------------------------
_L = "line"
derive(
    "seccand",
    "SELECT 1 AS unused",
    rf"""WITH l AS (SELECT doc, ord, id, chapter_number, page_start, line_no, {squashed('line')} AS line, {squashed("lead(line) OVER (PARTITION BY ord ORDER BY line_no)")} AS nx FROM structured_lines),
       n AS (SELECT *, regexp_extract(line, '^(\d{{1,2}}(?:\.\d{{1,2}})+\.?|\d{{1,2}}\.)\s*(.*)$', 1) AS num, {squashed("regexp_extract(line, '^(\\d{1,2}(?:\\.\\d{1,2})+\\.?|\\d{1,2}\\.)\\s*(.*)$', 2)")} AS title,
         coalesce(NOT {m('nx', PAGE_NO)} AND NOT {m('nx', URL)} AND {wrd('nx')} >= 8 AND {let('nx')} >= 40, false) AS body,
         NOT {m(_L, r'[.,;:]$')} AND {m(_L, r'^[\p{Lu}\p{Nd}]')} AND {wrd(_L)} BETWEEN 1 AND 14 AND {titled(_L, QUOTES_COLON)} >= greatest(1, floor({wrd(_L)} / 2)) AS strong
         FROM l WHERE len(line) BETWEEN 3 AND 140 AND NOT {m(_L, PAGE_NO)} AND NOT {m(_L, URL)} AND NOT {m(_L, FOOT)} AND NOT {m(_L, RUNNING)} AND NOT {m(_L, BAR)}
         AND NOT lower(line) LIKE '%.pdf' AND NOT {m(_L, r'(?i)^chapter\s+\d+$')} AND NOT {m(_L, r'(?:\.\s*){3,}\d+\s*$')} AND NOT {m(_L, r'(?i)\btable of contents\b')}
         AND NOT {m(_L, r'(?i)^contents$|^chapter\s+\d+[:.\-\s].+\s+\d{1,4}$')} AND NOT {m(_L, '[<>]')} AND NOT ({sym(_L)} > 8 AND {sym(_L)} * 1.0 / len(line) > 0.2)
         AND NOT {m(_L, r'^[\-\*•◦▪–—\s]+$')} AND NOT {m(_L, r'^\d{1,3}\.$|^\(?[a-zA-Z]\)$|^\d{1,3}\)$')} AND {let(_L)} >= 2),
       k AS (SELECT *, CASE WHEN num <> '' AND NOT (title = '' AND {m(_L, r'^\d{1,2}\.$')}) THEN 'numbered_heading'
           WHEN line LIKE '%?' AND {wrd(_L)} BETWEEN 3 AND 18 AND {starts('lower(line)', STARTERS)} THEN 'question_heading'
           WHEN len(line) <= 90 AND {let(_L)} >= 3 AND {up(_L)} * 1.0 / {let(_L)} >= 0.8 THEN 'mostly_uppercase_short_line'
           WHEN strong AND body THEN 'heading_followed_by_body' WHEN strong THEN 'short_title_like_line'
           WHEN NOT {m(_L, r'[.,;]$')} AND {m(_L, r'^\p{Lu}')} AND {wrd(_L)} BETWEEN 2 AND 18 AND {m("trim(split_part(line, ' ', 1), " + QUOTES_COLON + ")", r'^\p{Lu}')} THEN 'weak_title_like_line' END AS candidate_type FROM n),
       c AS (SELECT *, CASE candidate_type WHEN 'numbered_heading' THEN CASE WHEN NOT {m('num', r'^\d{1,2}(?:\.\d{1,2})+\.?$')} THEN 'low' WHEN title <> '' THEN 'high' ELSE 'medium' END
           WHEN 'question_heading' THEN CASE WHEN body THEN 'high' ELSE 'medium' END WHEN 'weak_title_like_line' THEN 'low' ELSE 'medium' END AS confidence FROM k WHERE candidate_type IS NOT NULL),
       p AS (SELECT c.ord AS o, c.line_no AS n, substr(string_agg({squashed('x.line')}, ' ' ORDER BY x.line_no), 1, 350) AS preview_after FROM c JOIN structured_lines x ON x.ord = c.ord AND x.line_no BETWEEN c.line_no + 1 AND c.line_no + 3 GROUP BY c.ord, c.line_no)
       SELECT doc, ord, id, chapter_number, page_start, line_no + 1 AS line_number, line AS heading, candidate_type, confidence, coalesce(preview_after, '') AS preview_after FROM c LEFT JOIN p ON p.o = c.ord AND p.n = c.line_no WHERE confidence <> 'low'""",
)
_KEEP = ["doc", "ord", "id", "chapter_number", "page_start"]


def _candidates(t: Tables):
    return H.section_candidates(t.structured, keep=_KEEP)


@query("section_candidates", "SELECT id, heading, candidate_type, confidence, line_number, preview_after FROM seccand")
def section_candidates(t: Tables):
    return _candidates(t).select("id", "heading", "candidate_type", "confidence", "line_number", "preview_after")


@query(
    "candidate_numbers",
    "SELECT id, line_number, 'section_candidate_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, line_number) AS n FROM seccand)",
)
def candidate_numbers(t: Tables):
    return H.number_candidates(_candidates(t), ["doc"], ["ord", "line_number"]).select("id", "line_number", "candidate_id")


_HD, _AF = "heading", "af"
_BODY = f"({wrd(_AF)} >= 8 AND {let(_AF)} >= 35 AND {m(_AF, '[.!?]')})"
_CROWD = f"({sym(_HD)} > 8 AND {sym(_HD)} * 1.0 / len(heading) > 0.2)"
_CODE = f"({starts('lo', CODES)} OR contains(heading, '```') OR {m(_HD, r'[{}<>]=?|==|=>|::')})"


def _item(tail: str) -> str:
    return f"({m(_HD, r'^\d{1,3}[.)]$')} OR ({m(_HD, r'^\d{1,3}[.)]\s+\S+')} AND NOT {m(_HD, r'^\d{1,2}\.\d{1,2}' + tail)}) OR {m(_HD, r'^\(?[a-zA-Z]\)$')})"


_KEY = "replace(replace(replace(replace(lower(heading), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"')"
METRICS = r"\b(?:PPL|BPB|BPC|ACC|FLOP|FLOPs|MFU|MBU|QPS|GB|TPU|GPU)\b"
TERMS = ["% exposure", "pop.", "rank ", "score ", "benchmark", "dataset", "accuracy", "model number of parameters", "instruction group instruction"]


def _final(base: str, keep: str, cap: int, cap_reason: str, duplicate_first: bool) -> str:
    repeat = "f.first_pass IS NOT NULL AND (b.ord, b.line_number) > f.first_pass"
    chosen = (
        f"CASE WHEN {repeat} THEN 'duplicate_in_chapter' ELSE r0 END" if duplicate_first else f"coalesce(r0, CASE WHEN {repeat} THEN 'duplicate_in_chapter' END)"
    )
    return f"""f AS (SELECT doc, chapter_number, key, min((ord, line_number)) AS first_pass FROM {base} WHERE r0 IS NULL GROUP BY doc, chapter_number, key),
       d AS (SELECT b.*, {chosen} AS r1 FROM {base} b LEFT JOIN f ON f.doc = b.doc AND f.chapter_number = b.chapter_number AND f.key = b.key),
       n AS (SELECT *, sum(CASE WHEN r1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc, chapter_number ORDER BY ord, line_number) AS pos FROM d)
       SELECT id, line_number, r1 IS NULL AND pos <= {cap} AS kept, coalesce(r1, CASE WHEN pos > {cap} THEN '{cap_reason}' ELSE {keep} END) AS reason,
       CASE WHEN r1 IS NULL AND pos <= {cap} THEN CAST(pos AS BIGINT) END AS position FROM n"""


def _shown(df):
    return df.select("id", "line_number", "kept", "reason", F.col("position").cast("long").alias("position"))


@query(
    "section_outline",
    rf"""WITH s AS (SELECT *, {_KEY} AS key, lower(heading) AS lo, preview_after AS af, lower(heading || ' ' || preview_after) AS bth FROM seccand),
       r AS (SELECT *, count(*) OVER (PARTITION BY doc, chapter_number, key) AS reps, min((ord, line_number)) OVER (PARTITION BY doc, chapter_number) AS cf, trim(lo, ':. ') AS bare,
         confidence = 'high' AND candidate_type IN ('numbered_heading', 'question_heading') AS sure FROM s),
       b AS (SELECT *, CASE
         WHEN len(heading) < 3 THEN 'too_short' WHEN len(heading) > 140 THEN 'too_long' WHEN {let(_HD)} < 3 THEN 'not_enough_letters' WHEN {m(_HD, URL)} THEN 'url_or_email'
         WHEN {m(_HD, PAGE_NO)} OR {m(_HD, BAR)} THEN 'page_label' WHEN {m(_HD, FOOT)} OR {m(_HD, RUNNING)} THEN 'header_or_footer' WHEN {m(_HD, r'(?i)^chapter\s+\d+$')} THEN 'repeated_chapter_marker'
         WHEN {_item(r'(?:\.\d{1,2})*\s+')} THEN 'exercise_or_list_fragment' WHEN {m(_HD, r'^[\-\*•◦▪–—\s]+$')} THEN 'bullet_or_marker'
         WHEN {m(_HD, r'[<>{}\[\]`]')} OR {_CROWD} THEN 'too_much_punctuation' WHEN {_CODE} THEN 'code_fragment'
         WHEN {m(_HD, r'(?i)^figure\s+\d|^fig\.\s*\d|^table\s+\d|^source:|\bcaption\b')} OR {holds('bth', TERMS)} OR (contains(heading, ',') AND NOT {m(_HD, r'(?i)^factor\s+\d+:')})
           OR ({m(_HD, r'(?i)\b(?:human|model|input|output|prompt|label|response)\b')} AND NOT {m(_AF, '[.!?]')}) OR ({dig(_HD)} >= 3 AND NOT starts_with(lo, 'factor ') AND NOT starts_with(lo, 'step ')) OR contains(heading, '%') THEN 'caption_or_table_noise'
         WHEN {m(_HD, '[=×*/]|' + METRICS)} THEN 'formula_or_metric_noise'
         WHEN bare IN ('answer','answers','example','examples','note','notes','question','questions','tip','tips') OR ({m('bare', r'^(example|answer|note|tip)\s*\d*[:.]?\s*(.*)$')} AND trim(regexp_extract(bare, '^(example|answer|note|tip)\s*\d*[:.]?\s*(.*)$', 2)) = '') THEN 'generic_heading'
         WHEN reps > 2 THEN 'repeated_too_often_in_chapter'
         WHEN candidate_type NOT IN ('numbered_heading', 'question_heading', 'heading_followed_by_body', 'short_title_like_line') THEN 'candidate_type_not_supported'
         WHEN sure THEN NULL WHEN NOT {_BODY} THEN 'missing_body_text_after'
         WHEN {m(_HD, r'^\p{Ll}')} OR {m(_HD, r'[.,;]$')} OR (contains(heading, ',') AND {wrd(_HD)} >= 6) OR {m(_HD, r'\)\s*,?\s+and\b')} OR {wrd(_HD)} > 16 OR ({wrd(_HD)} >= 9 AND {holds('lo', [' because ', ' however ', ' whereas ', ' although ', ' while '])}) THEN 'sentence_fragment'
         WHEN candidate_type = 'short_title_like_line' AND (ord, line_number) <> cf AND ({wrd(_HD)} > 5 OR contains(heading, ',')) THEN 'short_title_like_noise' END AS r0 FROM r),
       {_final('b', "'kept'", 30, 'max_per_chapter_reached', True)}""",
)
def section_outline(t: Tables):
    return _shown(H.section_outline(_candidates(t), ["doc", "chapter_number"], ["ord", "line_number"]))


_GEN = r"^(activity|answer|example|exercise|note|question|review|summary|tip)\s*\d*[:.]?\s*(.*)$"
_STRICT_BASE = rf"""s AS (SELECT *, {_KEY} AS key, lower(heading) AS lo, preview_after AS af, lower(heading || ' ' || preview_after) AS bth, trim(lower(heading), ':. ') AS bare,
         trim(regexp_extract(trim(lower(heading), ':. '), '{_GEN}', 2)) AS gt, {squashed("regexp_extract(heading, '^\\d{1,2}\\.\\d{1,2}(?:\\.\\d{1,2})*\\.?\\s+(.+)$', 1)")} AS st FROM seccand),
       b AS (SELECT *, CASE
         WHEN len(heading) < 8 THEN 'too_short' WHEN len(heading) > 140 THEN 'too_long' WHEN {m(_HD, URL)} THEN 'url_or_email'
         WHEN {m('lo', r'\.(pdf|txt|json|py)$')} OR {m(_HD, PAGE_NO)} OR {m(_HD, BAR)} THEN 'file_name_or_page_label'
         WHEN {m(_HD, r'[<>{}\[\]`]')} OR NOT {m(_HD, r'[\p{L}\p{N}]')} OR {_CROWD} THEN 'mostly_punctuation' WHEN {_CODE} THEN 'code_fragment'
         WHEN {_item(r'(?:\.\d{1,2})*\s+\S+')} THEN 'exercise_or_numbered_question'
         WHEN bare IN ('activity','answer','answers','example','examples','exercise','exercises','note','notes','question','questions','review','summary','tip','tips') OR ({m('bare', _GEN)} AND (len(gt) < 5 OR {let('gt')} < 3)) THEN 'generic_heading'
         WHEN {m(_HD, '[=×*/%]|' + METRICS)} OR ({dig(_HD)} >= 3 AND {let(_HD)} <= 12) THEN 'formula_or_numeric_noise'
         WHEN {m(_HD, r'(?i)^(figure|fig\.|table)\s+\d')} OR {holds('bth', TERMS + ['caption', 'source:'])} THEN 'caption_or_table_noise'
         WHEN candidate_type IN ('short_title_like_line', 'weak_title_like_line') THEN 'weak_short_title_like'
         WHEN candidate_type = 'mostly_uppercase_short_line' AND NOT ({wrd(_HD)} BETWEEN 2 AND 8 AND {_BODY}) THEN 'mostly_uppercase_non_title'
         WHEN candidate_type = 'numbered_heading' THEN CASE WHEN NOT (len(st) >= 5 AND {let('st')} >= 3 AND NOT {m('st', r'^\p{Ll}')}) THEN 'numbered_heading_without_meaningful_title' WHEN confidence <> 'high' THEN 'numbered_heading_confidence_not_allowed' END
         WHEN candidate_type = 'question_heading' THEN CASE WHEN NOT (heading LIKE '%?' AND {m(_HD, r'^\p{Lu}')} AND {wrd(_HD)} BETWEEN 3 AND 18 AND {starts('lo', STARTERS)}) THEN 'invalid_question_heading'
           WHEN {holds('bth', ['animal', 'cats', 'dogs', 'dolphins', 'sharks'])} THEN 'question_example_noise' WHEN confidence <> 'high' THEN 'question_heading_confidence_not_allowed' END
         ELSE 'candidate_type_not_allowed' END AS r0 FROM s)"""


@query("strict_section_outline", f"WITH {_STRICT_BASE}, {_final('b', chr(39) + 'high_confidence_' + chr(39) + ' || candidate_type', 12, 'max_per_chapter_reached', True)}")
def strict_section_outline(t: Tables):
    return _shown(H.strict_section_outline(_candidates(t), ["doc", "chapter_number"], ["ord", "line_number"]))


@query(
    "topic_outline",
    rf"""WITH src AS (SELECT doc, chapter_number, arg_min(id, ord) AS source_chunk FROM structured GROUP BY doc, chapter_number),
       s AS (SELECT c.*, lower(heading) AS key, lower(heading) AS lo, preview_after AS af, lower(heading || ' ' || preview_after) AS bth, src.source_chunk = c.id AS opening FROM seccand c JOIN src USING (doc, chapter_number)),
       k AS (SELECT *, CASE WHEN candidate_type IN ('numbered_heading', 'question_heading', 'heading_followed_by_body') THEN 'allowed_candidate_type' WHEN candidate_type = 'mostly_uppercase_short_line' THEN 'uppercase_heading_excluded'
           WHEN candidate_type = 'short_title_like_line' THEN CASE WHEN opening THEN 'chapter_opening_title' ELSE 'short_title_like_excluded' END ELSE 'candidate_type_not_allowed' END AS tr FROM s),
       b AS (SELECT *, CASE
         WHEN len(heading) < 3 THEN 'too_short' WHEN len(heading) > 120 THEN 'too_long' WHEN {let(_HD)} < 3 THEN 'not_enough_letters' WHEN {m(_HD, PAGE_NO)} THEN 'standalone_page_number' WHEN {m(_HD, URL)} THEN 'url_or_email'
         WHEN {m(_HD, FOOT)} OR {m(_HD, BAR)} OR {m(_HD, RUNNING)} THEN 'footer_or_header_text' WHEN {m(_HD, r'(?i)^chapter\s+\d+$')} THEN 'repeated_chapter_marker' WHEN {_item('')} THEN 'exercise_or_list_item'
         WHEN {m(_HD, '[<>]')} OR {_CROWD} THEN 'too_much_punctuation'
         WHEN {starts('lo', "['user:', 'assistant:', 'system:', 'generated answer:', 'context:', 'description:', 'input:', 'output:', 'category question', 'instruction group']")} OR {m(_HD, r'[\[\]]')} OR contains(lo, '.pdf') THEN 'prompt_or_placeholder_noise'
         WHEN heading LIKE '%?' AND ({wrd(_HD)} < 3 OR {m(_HD, r'^\p{Ll}')} OR {holds('lo', ['animal', 'sharks', 'dolphins', 'cats', 'dogs'])}) THEN 'question_example_noise'
         WHEN {m(_HD, r'^\p{Ll}')} OR {m(_HD, r'''["'”’]\d{1,3}$''')} OR ({wrd(_HD)} >= 9 AND {holds('lo', [' because ', ' however ', ' whereas ', ' although ', ' while '])}) OR ({wrd(_HD)} >= 10 AND {m(_HD, r'[‐\-–]$')}) THEN 'sentence_fragment_noise'
         WHEN {m(_HD, r'[=×*/<>%]|\b(?:FLOP|FLOPs|PPL|BPB|BPC|ACC|SOTA)\b')} OR ({m(_HD, r'^\d+(?:\.\d+)?\s+')} AND NOT {m(_HD, r'^\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\s+[A-Za-z]')}) OR ({dig(_HD)} >= 3 AND NOT starts_with(lo, 'factor ')) OR ({dig(_HD)} >= 2 AND {let(_HD)} <= 5) THEN 'formula_or_numeric_noise'
         WHEN tr NOT IN ('allowed_candidate_type', 'chapter_opening_title') THEN tr
         WHEN tr <> 'chapter_opening_title' AND ({wrd(_HD)} > 16 OR {m(_HD, r'[.,;]$')}) THEN 'sentence_like_noise'
         WHEN contains(lo, ' and others') OR ({m('lo', r'\b(?:billion|trillion|million)\b')} AND {dig(_HD)} > 0) OR (contains(heading, ',') AND {wrd(_HD)} > 8) THEN 'table_row_sentence_noise'
         WHEN {holds('bth', ['figure ', 'table ', 'source:', '% exposure', 'pop.', 'rank ', 'score ', 'benchmark', 'dataset', 'accuracy'])} OR ({wrd(_HD)} >= 4 AND len(list_filter(string_split(heading, ' '), lambda x: regexp_matches(x, '^\p{{Lu}}'))) = {wrd(_HD)}
           AND len(list_filter(string_split(heading, ' '), lambda x: len(x) <= 3)) >= 2) THEN 'table_or_figure_noise' END AS r0 FROM k),
       {_final('b', 'tr', 25, 'max_entries_per_chapter_reached', False)}""",
)
def topic_outline(t: Tables):
    chunks = t.structured.drop("text").withColumn("is_front_matter", F.lit(False))
    first = chunks.groupBy("doc", "chapter_number").agg(F.min_by("id", "ord").alias("chapter_source_chunk_id"))
    chunks = chunks.join(first, ["doc", "chapter_number"])
    return _shown(H.topic_outline(_candidates(t), chunks, ["ord", "line_number"]))


# -- contents ---------------------------------------------------------------------------------------
_TOC = r"(?i)^.+\s+(?:\d{1,4}|[ivxlcdm]+)$"
_CLEAN = lambda c: squashed(f"regexp_replace({squashed(c)}, '(?:\\.\\s*){{2,}}', ' ', 'g')")
derive(
    "tocregion",
    "SELECT 1 AS unused",
    rf"""WITH f AS (SELECT s.doc, s.ord, contains(lower(text), 'table of contents') AS says, coalesce(bool_or({m(_CLEAN('l.line'), _TOC)} OR contains(lower(l.line), 'table of contents')), false) AS lists
         FROM structured s LEFT JOIN structured_lines l ON l.ord = s.ord GROUP BY s.doc, s.ord, s.text),
       a AS (SELECT *, min(CASE WHEN says THEN ord END) OVER (PARTITION BY doc) AS start FROM f),
       b AS (SELECT *, min(CASE WHEN NOT lists AND ord >= start THEN ord END) OVER (PARTITION BY doc) AS stop FROM a)
       SELECT doc, ord FROM b WHERE ord >= start AND (stop IS NULL OR ord < stop)""",
)


@query("contents_region", "SELECT doc, ord FROM tocregion")
def contents_region(t: Tables):
    return S.contents_region(t.structured).select("doc", "ord")


derive(
    "toc",
    "SELECT 1 AS unused",
    rf"""WITH e AS (SELECT l.doc, l.ord, l.line_no, lower({squashed('line')}) AS lo, {_CLEAN('line')} AS c FROM structured_lines l JOIN tocregion USING (doc, ord)),
       p AS (SELECT *, {squashed("regexp_extract(c, '(?i)^(.+?)\\s+(\\d{1,4}|[ivxlcdm]+)$', 1)")} AS tt, lower(regexp_extract(c, '(?i)^(.+?)\s+(\d{{1,4}}|[ivxlcdm]+)$', 2)) AS page_text FROM e
         WHERE lo NOT IN ('table of contents', 'contents') AND NOT {m('lo', '^[ivxlcdm]+$')} AND NOT {m('lo', r'^(?:[ivxlcdm]+|\d+)\s*\|\s*table of contents$|^table of contents\s*\|\s*(?:[ivxlcdm]+|\d+)$')} AND {m('c', _TOC)}),
       q AS (SELECT *, {m('page_text', r'^\d+$')} AS num, {m('tt', r'^(\d{1,3})\.\s+(.+)$')} AND {m('page_text', r'^\d+$')} AS chap FROM p),
       w AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, line_no) AS entry, sum(CASE WHEN chap THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord, line_no) AS cp,
         last_value(CASE WHEN chap THEN CAST(regexp_extract(tt, '^(\d{{1,3}})\.', 1) AS INT) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord, line_no) AS cn FROM q),
       k AS (SELECT *, CASE WHEN chap THEN {squashed("regexp_extract(tt, '^(\\d{1,3})\\.\\s+(.+)$', 2)")} ELSE tt END AS title, CASE WHEN chap THEN 'chapter'
         WHEN lower(trim(tt, ' .:-')) IN ('acknowledgments','appendix','appendices','bibliography','epilogue','glossary','index','preface','references') OR cp = 0 OR NOT num THEN 'other' ELSE 'section' END AS entry_type FROM w)
       SELECT doc, entry, entry_type, title, page_text, CASE WHEN num THEN CAST(page_text AS INT) END AS page_start, CASE WHEN entry_type <> 'other' THEN CAST(cp AS BIGINT) END AS chapter_position, CASE WHEN entry_type <> 'other' THEN cn END AS chapter_number FROM k""",
)


def _contents(t: Tables):
    return S.contents_outline(S.contents_region(t.structured))


@query("contents_outline", "SELECT * FROM toc")
def contents_outline(t: Tables):
    c = _contents(t)
    return c.select("doc", F.col("entry").cast("long").alias("entry"), "entry_type", "title", "page_text", "page_start", F.col("chapter_position").cast("long").alias("chapter_position"), "chapter_number")


# The seven signals, from the oracles of the inputs they measure.
_SIGNALS_SQL = rf"""
  SELECT doc, 'toc' AS source, chapter_count, section_count, CASE WHEN chapter_count >= 5 AND section_count >= 20 THEN 'high' WHEN chapter_count >= 3 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT doc, count(*) FILTER (WHERE entry_type = 'chapter') AS chapter_count, count(*) FILTER (WHERE entry_type = 'section') AS section_count FROM toc GROUP BY doc)
  UNION ALL SELECT doc, 'body_outline', n, 0, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END
    FROM (SELECT b.doc, count(*) FILTER (WHERE regexp_matches(l.line, '\bCHAPTER\s+\d+\b')) AS n FROM ({ORACLES["body_outline"]}) b JOIN structured_lines l ON l.id = b.id AND l.line_no = b.line_no WHERE NOT b.is_toc GROUP BY b.doc)
  UNION ALL SELECT doc, 'section_candidates', count(DISTINCT chapter_number), count(*), CASE WHEN count(*) BETWEEN 50 AND 500 THEN 'medium' ELSE 'low' END FROM seccand GROUP BY doc
  UNION ALL SELECT doc, 'section_outline', c, k, CASE WHEN k BETWEEN 40 AND 200 THEN 'medium' ELSE 'low' END
    FROM (SELECT s.doc, count(DISTINCT s.chapter_number) AS c, count(*) FILTER (WHERE o.kept) AS k FROM ({ORACLES["section_outline"]}) o JOIN structured s USING (id) GROUP BY s.doc)
  UNION ALL SELECT doc, 'strict_section_outline', c, k, CASE WHEN k >= 20 AND c >= 5 THEN 'medium' ELSE 'low' END
    FROM (SELECT s.doc, count(DISTINCT s.chapter_number) FILTER (WHERE o.kept) AS c, count(*) FILTER (WHERE o.kept) AS k FROM ({ORACLES["strict_section_outline"]}) o JOIN structured s USING (id) GROUP BY s.doc)
  UNION ALL SELECT doc, 'chapter_only', count(DISTINCT chapter_number), 0, 'medium' FROM structured GROUP BY doc
  UNION ALL SELECT DISTINCT doc, 'flat_chunks', 0, 0, 'low' FROM structured"""


@query("structure_signals", _SIGNALS_SQL)
def structure_signals(t: Tables):
    return _signals(t).filter("available").select("doc", "source", "chapter_count", "section_count", "confidence")


def _signals(t: Tables):
    chunks, found = t.structured, read_once(_candidates(t), "doc", "ord")  # three signals read them
    outline = H.section_outline(found, ["doc", "chapter_number"], ["ord", "line_number"])
    strict = H.strict_section_outline(found, ["doc", "chapter_number"], ["ord", "line_number"])
    body = H.body_outline(_outline(t).drop("line"), chunks.select("doc", "id", "text")).filter(~F.col("is_toc"))
    return S.structure_signals(chunks.drop("text"), _contents(t), body, found, outline, strict)


@query(
    "structure_source",
    f"""WITH g AS ({_SIGNALS_SQL}),
       p AS (SELECT doc, bool_or(source = 'toc' AND chapter_count >= 5 AND section_count >= 20) AS toc, bool_or(source = 'body_outline' AND chapter_count >= 5) AS body FROM g GROUP BY doc)
       SELECT doc, CASE WHEN toc THEN 'toc' WHEN body THEN 'body_outline' WHEN strict THEN 'strict_section_outline' ELSE 'chapter_only' END AS selected_source,
         CASE WHEN toc THEN 'contents' WHEN body THEN 'chapters' WHEN strict THEN 'empty' ELSE 'chapters' END AS outline
       FROM p JOIN (SELECT doc, bool_or(source = 'strict_section_outline' AND section_count >= 20 AND chapter_count >= 5) AS strict FROM g GROUP BY doc) USING (doc)""",
)
def structure_source(t: Tables):
    return S.select_source(_signals(t))


# -- sections ------------------------------------------------------------------------------------------
derive(
    "sections",
    """SELECT source AS doc, CAST(n_chars % 9 AS INT) AS chapter_number, doc_id AS position, 'Section ' || CAST(doc_id AS STRING) AS section, CAST(n_chars % 190 AS INT) AS page_start, CAST(doc_id % 3 AS INT) AS level
       FROM documents WHERE n_chars % 4 = 1""",
)


@query(
    "section_asof",
    """WITH p AS (SELECT * FROM placed), b AS (SELECT *, NOT is_front_matter AND page_start IS NOT NULL AS body FROM p),
       f AS (SELECT doc, chapter_number, page_start, arg_min(section, position) AS first, arg_max(section, position) AS last FROM sections GROUP BY doc, chapter_number, page_start),
       a AS (SELECT b.id, arg_max(f.last, f.page_start) AS aof, max(CASE WHEN f.page_start = b.page_start THEN f.first END) AS same FROM b JOIN f ON f.doc = b.doc AND f.chapter_number = b.chapter_number AND f.page_start <= b.page_start WHERE body GROUP BY b.id)
       SELECT b.id, coalesce(same, aof) AS section FROM b LEFT JOIN a USING (id)""",
)
def section_asof(t: Tables):
    return S.assign_sections(t.placed.drop("section", "text"), t.sections).select("id", "section")


# each chunk of a section opens with the tail of the one before and runs on into the next
derive(
    "bounded",
    """SELECT source AS doc, 'c' || CAST(doc_id AS STRING) AS id, CAST(doc_id % 5 AS INT) AS chapter_number, 'CHAPTER ' || CAST(doc_id % 5 AS STRING) AS chapter,
       'Heading number ' || CAST(doc_id AS STRING) AS section, CAST(doc_id AS INT) AS section_page_start, CAST(doc_id AS INT) AS page_start, CAST(doc_id AS INT) AS page_end, false AS is_front_matter,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE substr(text, 1, 40) || chr(10) END AS lead, CASE WHEN doc_id % 7 = 0 THEN '' ELSE '  Heading number ' || CAST(doc_id AS STRING) || chr(10) END AS head, text AS body, doc_id
       FROM documents""",
)
derive(
    "bounded_sections",
    """SELECT doc, chapter_number, doc_id AS position, section, page_start, 1 AS level FROM bounded""",
)


# what a chunk keeps: its section's heading to the next section's, unless too little would stay
_TRIMMED = r"""WITH n AS (SELECT *, lead(section) OVER (PARTITION BY doc, chapter_number ORDER BY doc_id) AS nxt FROM bounded),
       a AS (SELECT *, lead || head || body || CASE WHEN nxt IS NULL THEN '' ELSE chr(10) || nxt || chr(10) || 'tail' END AS text, CASE WHEN head <> '' THEN len(lead) + 2 END AS hat FROM n),
       b AS (SELECT *, substr(text, hat + 1) AS cut FROM a),
       c AS (SELECT *, CASE WHEN hat > 0 THEN CASE WHEN trim(cut, ' ' || chr(10)) = '' THEN 'trim_skipped_empty_text' WHEN len(cut) < 200 AND len(text) > 500 THEN 'trim_skipped_below_min_cleaned_length'
           WHEN len(cut) < len(text) * 0.1 AND len(cut) < 300 THEN 'trim_skipped_removed_more_than_90_percent' ELSE 'ok' END END AS w1 FROM b),
       d AS (SELECT *, CASE WHEN w1 = 'ok' THEN cut ELSE text END AS t1 FROM c),
       e AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN rtrim(substr(t1, 1, len(t1) - len(nxt) - 6), ' ' || chr(10)) END AS kept FROM d),
       g AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN CASE WHEN trim(kept, ' ' || chr(10)) = '' THEN 'trim_skipped_empty_text' WHEN len(kept) < 200 AND len(t1) > 500 THEN 'trim_skipped_below_min_cleaned_length'
           WHEN len(kept) < len(t1) * 0.1 AND len(kept) < 300 THEN 'trim_skipped_removed_more_than_90_percent' ELSE 'ok' END END AS w2 FROM e),
       z AS (SELECT *, len(CASE WHEN w2 = 'ok' THEN kept ELSE t1 END) AS chars, len(text) - len(t1) AS prefix, len(t1) - len(CASE WHEN w2 = 'ok' THEN kept ELSE t1 END) AS suffix, coalesce(w2 = 'ok', false) AS end_found,
         list_filter([CASE WHEN head = '' THEN 'start_heading_not_found:' || section END, CASE WHEN w1 <> 'ok' THEN w1 END, CASE WHEN w2 <> 'ok' THEN w2 END], lambda w: w IS NOT NULL) AS warned FROM g)"""


@query("boundary_trim", _TRIMMED + " SELECT id, chars, prefix, suffix, end_found, array_to_string(warned, ';') AS warnings FROM z")
def boundary_trim(t: Tables):
    return _trimmed(t).select(
        "id", F.length("text").cast("long").alias("chars"), F.col("boundary_cleanup.prefix_trimmed_chars").cast("long").alias("prefix"),
        F.col("boundary_cleanup.suffix_trimmed_chars").cast("long").alias("suffix"), F.col("boundary_cleanup.end_heading_found").alias("end_found"),
        F.array_join("boundary_cleanup.warnings", ";").alias("warnings"),
    )


def _trimmed(t: Tables):
    b = t.bounded
    nxt = b.select("doc", "chapter_number", F.col("doc_id").alias("o"), "section")
    from quire.functions.ordered import Scan, ordered_scan

    ahead = ordered_scan(nxt, ["doc", "chapter_number"], ["o"], tile_of_integer("o"), {"nxt": Scan("next", F.col("section"))})
    rows = b.join(ahead.select(F.col("o").alias("doc_id"), "nxt"), "doc_id")
    tail = F.when(F.col("nxt").isNull(), F.lit("")).otherwise(F.concat(F.lit("\n"), "nxt", F.lit("\ntail")))
    chunks = rows.withColumn("text", F.concat("lead", "head", "body", tail)).drop("lead", "head", "body", "nxt", "doc_id")
    return S.trim_boundaries(chunks, t.bounded_sections)


@query(
    "cleanup_counts",
    _TRIMMED
    + """ SELECT doc, chapter, count(*) FILTER (prefix + suffix > 0) AS chunks_cleaned, count(*) FILTER (prefix > 0) AS prefix_trims, count(*) FILTER (suffix > 0) AS suffix_trims, count(*) FILTER (len(warned) > 0) AS warnings
       FROM z GROUP BY doc, chapter""",
)
def cleanup_counts(t: Tables):
    return S.cleanup_counts(_trimmed(t))


@query(
    "flat_nodes",
    _TRIMMED
    + """ SELECT id AS node_id, chars, page_start, prefix + suffix > 0 AS applied, prefix, suffix, section AS start_heading, head <> '' AS start_heading_found, nxt AS end_heading, end_found AS end_heading_found, len(warned) AS warning_count FROM z""",
)
def flat_nodes(t: Tables):
    n, c = C.flat_nodes(_trimmed(t)), "boundary_cleanup_"
    return n.select(
        "node_id", F.length("text").cast("long").alias("chars"), "page_start", F.col(c + "applied").alias("applied"), F.col(c + "prefix_trimmed_chars").cast("long").alias("prefix"),
        F.col(c + "suffix_trimmed_chars").cast("long").alias("suffix"), *[F.col(c + x).alias(x) for x in ("start_heading", "start_heading_found", "end_heading", "end_heading_found")],
        F.col(c + "warning_count").cast("long").alias("warning_count"),
    )


@query(
    "page_ranges",
    """WITH k AS (SELECT DISTINCT doc, page_start AS start, heading AS title FROM chapter_marks), e AS (SELECT doc, max(page_start) AS last_page FROM chunks GROUP BY doc)
       SELECT k.doc, row_number() OVER w AS chapter_number, title, start AS first_page, coalesce(lead(start) OVER w - 1, last_page) AS last_page FROM k JOIN e USING (doc) WINDOW w AS (PARTITION BY k.doc ORDER BY start, title)""",
)
def page_ranges(t: Tables):
    marks = t.chapter_marks.select("doc", F.col("page_start").alias("start"), F.col("heading").alias("title"))
    ends = t.chunks.groupBy("doc").agg(F.max("page_start").alias("last_page"))
    return S.chapter_ranges(marks, ends).withColumn("chapter_number", F.col("chapter_number").cast("long"))


@query(
    "pages_by_chapter",
    """WITH k AS (SELECT doc, page_start AS start, max(heading) AS title FROM chapter_marks GROUP BY doc, page_start)
       SELECT doc, chapter, count(*) AS pages FROM (SELECT c.doc, c.id, arg_max(k.title, k.start) AS chapter FROM chunks c JOIN k ON k.doc = c.doc AND k.start <= c.page_start GROUP BY c.doc, c.id) GROUP BY doc, chapter""",
)
def pages_by_chapter(t: Tables):
    marks = t.chapter_marks.select("doc", F.col("page_start").alias("start"), F.col("heading").alias("title"))
    pages = t.chunks.select("doc", "id", F.col("page_start").alias("page"))
    return S.pages_in_ranges(pages, marks).groupBy("doc", "chapter").agg(F.count(F.lit(1)).alias("pages"))


# a contents page of one entry per language
derive(
    "text_rows",
    "SELECT doc_id, source, lang, n_chars, i, l FROM (SELECT doc_id, source, lang, n_chars, posexplode(split(text, chr(10))) AS (i, l) FROM documents)",
    "SELECT doc_id, source, lang, n_chars, CAST(u.i AS INT) AS i, s.ls[u.i + 1] AS l FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents) s, UNNEST(range(len(s.ls))) AS u(i)",
)
derive("contents_entries", "SELECT source AS doc, min(doc_id) AS position, min(l) AS title, CAST(min(n_chars) % 500 AS INT) AS printed FROM text_rows WHERE trim(l) <> '' GROUP BY source, lang")
derive("page_heads", "SELECT source AS doc, CAST(floor(doc_id / 3) AS INT) + 1 AS page, doc_id * 100000 + i AS line_no, CASE WHEN doc_id % 2 = 0 THEN '# ' ELSE '' END || l AS line FROM text_rows")


@query(
    "page_offset",
    """SELECT doc, "offset" FROM (SELECT c.doc, c.printed - h.page AS "offset", row_number() OVER (PARTITION BY c.doc ORDER BY c.position, h.page, h.line_no) AS r FROM contents_entries c JOIN page_heads h ON h.doc = c.doc AND starts_with(h.line, '#') AND contains(lower(h.line), lower(trim(c.title)))) WHERE r = 1""",
)
def page_offset(t: Tables):
    return S.page_offset(t.contents_entries, t.page_heads)


@query(
    "assignment_counts",
    """SELECT doc, chapter, section, count(*) AS chunk_count, grouping(doc) * 4 + grouping(chapter) * 2 + grouping(section) AS level FROM (SELECT doc, coalesce(chapter, 'CHAPTER ' || CAST(chapter_number AS STRING)) AS chapter, coalesce(section, 'Unassigned') AS section FROM placed WHERE NOT is_front_matter)
       GROUP BY ROLLUP (doc, chapter, section)""",
)
def assignment_counts(t: Tables):
    return S.assignment_counts(t.placed.drop("text"))


def ranked(ordered, keys: list[str]):
    """Place of each row of a sorted table inside its group."""
    marked = ordered.withColumn("__m", F.monotonically_increasing_id())  # rises along the sort
    return position_in_group(marked, keys, ["__m"], None, "rank").drop("__m")


@query(
    "chapter_natural_order",
    r"""SELECT id, chapter_number, CAST(row_number() OVER (PARTITION BY doc ORDER BY chapter_number, coalesce(page_start, 0), coalesce(page_end, 0), CAST(regexp_extract(id, '(\d+)', 1) AS BIGINT)) AS BIGINT) AS rank
        FROM placed WHERE NOT is_front_matter AND chapter_number IS NOT NULL""",
)
def chapter_natural_order(t: Tables):
    return ranked(S.chapter_order(t.placed.drop("text")), ["doc"]).select("id", "chapter_number", F.col("rank").cast("long").alias("rank"))


@query(
    "facet_tree",
    """SELECT doc, chapter, section, array_to_string(list_sort(list(DISTINCT content_type)), ',') AS content_types, count(*) AS chunk_count, grouping(doc) * 4 + grouping(chapter) * 2 + grouping(section) AS level
       FROM (SELECT doc, coalesce(chapter, '-') AS chapter, coalesce(section, '-') AS section, content_type FROM placed) GROUP BY ROLLUP (doc, chapter, section)""",
)
def facet_tree(t: Tables):
    rows = t.placed.select("doc", F.coalesce("chapter", F.lit("-")).alias("chapter"), F.coalesce("section", F.lit("-")).alias("section"), "content_type")
    return S.facet_tree(rows, ["doc", "chapter", "section"]).withColumn("content_types", F.array_join("content_types", ","))


derive(
    "lessoned",
    """SELECT doc, ord, id, page_start, CASE WHEN ord % 5 = 0 THEN 'Lesson  ' || CAST(1 + ord % 4 AS STRING) || chr(10) || text WHEN ord % 13 = 0 THEN text || chr(10) || 'x' || chr(10) || 'LESSON 9'
       WHEN ord % 7 = 0 THEN chr(10) || 'Recap lesson ' || CAST(1 + ord % 2 AS STRING) || ' here' || chr(10) || text ELSE text END AS text FROM chunks""",
)


@query(
    "lesson_chapters",
    r"""WITH h AS (SELECT *, regexp_extract(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: regexp_matches(x, '(?i)^(recap lesson|lesson) \d+([^\p{L}\p{N}_]|$)'))[1], '(?i)^((recap )?lesson \d+)', 1) AS raw FROM lessoned),
       k AS (SELECT *, CASE WHEN raw <> '' THEN upper(raw) END AS mk FROM h),
       p AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
       r AS (SELECT *, sum(CASE WHEN mk IS NOT NULL AND mk IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS run, last_value(mk IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS cur FROM p)
       SELECT id, CASE WHEN run > 0 THEN cur END AS chapter, CASE WHEN run > 0 THEN CAST(run AS BIGINT) END AS chapter_number, CASE WHEN run > 0 THEN first_value(id) OVER (PARTITION BY doc, run ORDER BY ord) END AS chapter_source_chunk_id, run = 0 AS is_front_matter FROM r""",
)
def lesson_chapters(t: Tables):
    r = S.lesson_chapters(t.lessoned)
    return r.select("id", "chapter", F.col("chapter_number").cast("long").alias("chapter_number"), "chapter_source_chunk_id", "is_front_matter")


@query(
    "marker_runs",
    """WITH p AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS mk FROM events),
       q AS (SELECT *, last_value(mk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p),
       r AS (SELECT *, sum(CASE WHEN mk IS NOT NULL AND mk IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM q)
       SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS events FROM r GROUP BY user_id, run""",
)
def marker_runs(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("marker"))
    runs = S.marker_runs(rows, ["user_id"], ["ts", "event_id"], None)
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("events"))


# -- sources on tables ------------------------------------------------------------------------------------
derive("marked_texts", "SELECT doc_id, array_join(transform(split(text, chr(10)), (l, i) -> '<!-- page ' || CASE WHEN i % 2 = 1 THEN ' ' ELSE '' END || CAST(i + 1 AS STRING) || ' -->' || l), '') AS text FROM documents")


@query(
    "marked_pages",
    "SELECT doc_id, i + 1 AS page, 'b:p' || CAST(i + 1 AS STRING) AS node_id, l AS text FROM text_rows",
)
def marked_pages(t: Tables):
    return C.page_chunks(C.marked_pages(t.marked_texts, ["doc_id"]), "b").drop("ord")


@query(
    "page_chunks",
    r"""SELECT 'book' || CAST(doc_id % 7 AS STRING) || '_chunk_' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS STRING), 3, '0') ELSE CAST(doc_id AS STRING) END AS id,
       CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS INT) WHEN doc_id % 3 = 1 THEN CAST(n_chars + 1 AS INT) ELSE CAST(doc_id AS INT) END AS page_start FROM documents""",
)
def page_chunks(t: Tables):
    number = F.col("n_chars").cast("string")
    meta = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("page_label"), F.concat(F.lit("p. "), number))).when(
        F.col("doc_id") % 3 == 1, F.create_map(F.lit("page"), (F.col("n_chars") + 1).cast("string"))
    ).otherwise(F.create_map(F.lit("page"), F.lit("front")))
    pages = t.documents.select(F.concat(F.lit("in/book"), (F.col("doc_id") % 7).cast("string"), F.lit(".pdf")).alias("path"), F.col("doc_id").alias("ordinal"), "text", meta.alias("metadata"))
    return C.chunks_of_pages(pages).select("id", "page_start")


@query(
    "chunk_documents",
    """SELECT source AS file, count(*) AS chunks, min('c' || CAST(doc_id AS STRING)) AS first_id, CAST(sum(len(text)) AS BIGINT) AS chars FROM documents GROUP BY source""",
)
def chunk_documents(t: Tables):
    """Chunk documents written as JSON per chunk and read back through the scan."""
    item = F.to_json(F.array(F.struct(F.lit(" ").alias("node_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), "text")))
    files = t.documents.select(F.col("source").alias("file"), F.when(F.col("doc_id") % 2 == 0, item).otherwise(F.concat(F.lit('{"chunks": [], "nodes": '), item, F.lit("}"))).alias("document"))
    rows = C.explode_chunks(files)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"), F.min("row_id").alias("first_id"), F.sum(F.length("text")).alias("chars"))


_DERIVED = """WITH k AS (SELECT source, doc_id, trim(text, ' ' || chr(10)) = '' AS blank FROM documents), bad AS (SELECT DISTINCT source FROM k WHERE blank UNION SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 4 = 1) """


def _derived(t: Tables):
    chunks = t.documents.select(F.col("source").alias("material_id"), F.col("doc_id").alias("i"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("node_id"), "text")
    materials = t.documents.groupBy(F.col("source").alias("material_id")).agg(
        F.max("source").alias("source_pdf"), F.when(F.min("doc_id") % 4 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("chapter_numbers")
    )
    return C.derive_chunks(materials, chunks)


@query(
    "derive_chunks",
    _DERIVED + "SELECT node_id, source_pdf, chapter_number, text, material_id FROM (SELECT 'c' || CAST(doc_id AS STRING) AS node_id, source AS source_pdf, 1 AS chapter_number, text, source AS material_id FROM documents WHERE source NOT IN (SELECT source FROM bad))",
)
def derive_chunks(t: Tables):
    return _derived(t)[0]


@query(
    "derive_refusals",
    _DERIVED + "SELECT source AS material_id, 'BLANK_TEXT' AS code, 'c' || CAST(doc_id AS STRING) AS detail FROM k WHERE blank UNION ALL SELECT source, 'AMBIGUOUS_CHAPTER', '' FROM documents GROUP BY source HAVING min(doc_id) % 4 = 1",
)
def derive_refusals(t: Tables):
    return _derived(t)[1]
