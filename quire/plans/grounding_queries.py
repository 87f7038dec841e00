"""Grounding, audit and comparison queries."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import audits as A
from quire.operators import claims as L
from quire.operators import contract as K
from quire.operators import grounding as G
from quire.plans.registry import Tables, derive, query

_ONE = r"trim(regexp_replace({c}, '[ \n]+', ' ', 'g'))"


def flat(c: str) -> str:
    return _ONE.format(c=c)


# -- claims of documents ---------------------------------------------------------------------------
derive("chapter_docs", "SELECT source AS doc, doc_id AS chapter_index, lang, text, n_chars FROM documents")


def _chapter_json(t: Tables):
    d, lines = t.chapter_docs, F.split("text", "\n")
    grounded = lambda l: F.struct(l.alias("text"), F.lit("definition").alias("claim_kind"), F.lit("source_grounded").alias("origin"), F.array(F.lit("c1"), F.lit("c2")).alias("source_chunk_ids"))
    doc = F.struct(
        F.col("chapter_index").alias("chapter_number"), F.col("lang").alias("chapter_title"), F.col("text").alias("chapter_summary"),
        F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("c9"))).alias("source_chunk_ids"),
        lines.alias("learning_objectives"),
        F.transform(lines, lambda l: F.struct(grounded(l).alias("meaning"), F.col("lang").alias("term"))).alias("key_terms"),
        F.transform(lines, lambda l: F.struct(l.alias("meaning"), F.col("lang").alias("term"))).alias("practice_questions"),
        F.transform(lines, lambda l: F.struct(l.alias("explanation"), F.array(F.lit("c3")).alias("source_chunk_ids"))).alias("core_lessons"),
        F.col("n_chars").alias("estimated_study_time_minutes"),
    )
    return d.select("doc", "chapter_index", F.to_json(doc).alias("document"))


derive(
    "flat_claims",
    "SELECT 1 AS unused",
    """WITH c AS (SELECT *, string_split(text, chr(10)) AS ls, CASE WHEN n_chars % 2 = 0 THEN 'inherited_chapter' ELSE 'none' END AS inh,
         'chapter_' || CASE WHEN chapter_index < 10 THEN '0' ELSE '' END || CAST(chapter_index AS STRING) || '.' AS p FROM chapter_docs),
       l AS (SELECT c.doc, c.inh, c.p, CAST(u.i AS STRING) AS i, c.ls[u.i + 1] AS l FROM c, UNNEST(range(len(c.ls))) AS u(i))
       SELECT * FROM (SELECT doc, p || 'chapter_summary' AS claim_id, 'chapter_summary' AS claim_type, text AS claim_text, inh AS citation_origin FROM c
       UNION ALL SELECT doc, p || 'learning_objectives.' || i, 'learning_objective', l, inh FROM l
       UNION ALL SELECT doc, p || 'key_terms.' || i || '.meaning', 'key_term_definition', l, 'local' FROM l
       UNION ALL SELECT doc, p || 'core_lessons.' || i || '.explanation', 'core_lesson_explanation', l, 'local' FROM l
       UNION ALL SELECT doc, p || 'estimated_study_time_minutes', 'estimated_study_time', 'Estimated study time: ' || CAST(n_chars AS STRING) || ' minutes.', 'none' FROM c) WHERE trim(claim_text, ' ' || chr(10)) <> ''""",
)


@query("claim_flatten", "SELECT * FROM flat_claims")
def claim_flatten(t: Tables):
    return L.chapter_claims(_chapter_json(t)).select("doc", "claim_id", "claim_type", "claim_text", "citation_origin")


@query(
    "claim_summary",
    """SELECT doc, 'scope' AS dimension, 'chapter' AS value, count(*) AS n FROM flat_claims GROUP BY doc UNION ALL SELECT doc, 'all', 'all', count(*) FROM flat_claims GROUP BY doc
       UNION ALL SELECT doc, 'citation_origin', citation_origin, count(*) FROM flat_claims GROUP BY doc, citation_origin UNION ALL SELECT doc, 'claim_type', claim_type, count(*) FROM flat_claims GROUP BY doc, claim_type""",
)
def claim_summary(t: Tables):
    return L.claim_summary(L.chapter_claims(_chapter_json(t)))


# Whole books: every line of a text in the book's own lists, its plan and a chapter; chapters stand in three places.
derive(
    "book_rows",
    "SELECT doc_id, text, lang, CAST(doc_id % 4 AS INT) AS form, split(text, chr(10)) AS l FROM documents",
    "SELECT doc_id, text, lang, CAST(doc_id % 4 AS INT) AS form, string_split(text, chr(10)) AS l FROM documents",
)


def _books(t: Tables):
    lines, form = F.col("l"), F.col("form")
    chapters = F.array(F.struct(F.lit(7).alias("chapter_number"), F.col("lang").alias("chapter_title"), lines.alias("learning_objectives")))
    shown = lambda on: F.when(on, chapters)
    materials = F.struct(
        F.col("text").alias("summary"), F.transform(lines, lambda x: F.struct(x.alias("description"))).alias("who_this_is_for"),
        F.array(F.struct(F.lit(1).alias("week"), F.col("lang").alias("focus"), lines.alias("activities"))).alias("study_plan"),
        F.struct(F.array(F.lit("s1")).alias("source_chunk_ids"), F.col("text").alias("summary"), F.transform(lines, lambda x: F.struct(x.alias("question"))).alias("questions")).alias("final_review"),
        shown(form == 0).alias("chapters"), shown(form.isin(0, 1)).alias("chapter_packages"),
    )
    book = F.struct(F.when(form != 3, materials).alias("learning_materials"), shown(form.isin(0, 1, 2)).alias("chapter_packages"), F.when(F.col("doc_id") % 5 != 0, F.struct(F.lit(1).alias("v"))).alias("generation"))
    return t.book_rows.select(F.col("doc_id").alias("doc"), F.to_json(book).alias("book"))


@query(
    "book_claims",
    """WITH b AS (SELECT doc_id, text, lang, form, l FROM book_rows WHERE form <> 3), x AS (SELECT b.*, CAST(u.i AS STRING) AS i, b.l[u.i + 1] AS x FROM b, UNNEST(range(len(b.l))) AS u(i)),
       r AS (SELECT *, CASE form WHEN 0 THEN '$.learning_materials.chapters' WHEN 1 THEN '$.learning_materials.chapter_packages' ELSE '$.chapter_packages' END AS root FROM x)
       SELECT * FROM (SELECT doc_id AS doc, 'book.summary' AS claim_id, '$.learning_materials.summary' AS json_path, text AS claim_text, 'none' AS citation_origin FROM b
       UNION ALL SELECT doc_id, 'book.who_this_is_for.' || i, '$.learning_materials.who_this_is_for[' || i || ']', x, 'none' FROM x
       UNION ALL SELECT doc_id, 'book.study_plan.0.focus', '$.learning_materials.study_plan[0].focus', lang, 'none' FROM b
       UNION ALL SELECT doc_id, 'book.study_plan.0.activities.' || i, '$.learning_materials.study_plan[0].activities[' || i || ']', x, 'none' FROM x
       UNION ALL SELECT doc_id, 'book.final_review.summary', '$.learning_materials.final_review.summary', text, 'local' FROM b
       UNION ALL SELECT doc_id, 'book.final_review.questions.' || i, '$.learning_materials.final_review.questions[' || i || ']', x, 'none' FROM x
       UNION ALL SELECT doc_id, 'chapter_07.learning_objectives.' || i, root || '[0].learning_objectives[' || i || ']', x, 'none' FROM r) WHERE trim(claim_text, ' ' || chr(10)) <> ''""",
)
def book_claims(t: Tables):
    return L.whole_book_claims(_books(t)).select("doc", "claim_id", "json_path", "claim_text", "citation_origin")


@query("book_problems", "SELECT doc_id AS doc, 'NO_GENERATION' AS code FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'NO_MATERIALS' FROM documents WHERE doc_id % 4 = 3")
def book_problems(t: Tables):
    return L.book_problems(_books(t))


# -- claims read off order lines ------------------------------------------------------------------------
derive(
    "cited_lines",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS claim_id, CASE WHEN l_linenumber < 5 THEN 'chapter' ELSE 'book' END AS scope, CAST(l_suppkey % 7 AS INT) AS chapter_number, 'a.pdf' AS expected_pdf,
       'p' || CAST(CASE WHEN l_partkey % 83 = 0 THEN l_partkey + 90000000 ELSE l_partkey END AS STRING) AS node_id, l_returnflag AS doc, l_orderkey * 10 + l_linenumber AS ord FROM lineitem""",
)
derive("part_chunks", "SELECT 'p' || CAST(p_partkey AS STRING) AS node_id, CASE WHEN p_size = 13 THEN '' ELSE p_name END AS text, CASE WHEN p_size % 10 = 4 THEN 'b.pdf' ELSE 'a.pdf' END AS source_pdf, CAST(p_partkey % 7 AS INT) AS chapter_number FROM part")
derive(
    "citation_faults",
    "SELECT 1 AS unused",
    """WITH j AS (SELECT c.*, p.node_id AS hit, p.text, p.source_pdf, p.chapter_number AS pc FROM cited_lines c LEFT JOIN part_chunks p USING (node_id))
       SELECT claim_id, node_id, 'UNRESOLVED' AS code FROM j WHERE hit IS NULL UNION ALL SELECT claim_id, node_id, 'EMPTY_TEXT' FROM j WHERE hit IS NOT NULL AND text = ''
       UNION ALL SELECT claim_id, node_id, 'DOCUMENT_MISMATCH' FROM j WHERE source_pdf = 'b.pdf' UNION ALL SELECT claim_id, node_id, 'CHAPTER_MISMATCH' FROM j WHERE scope = 'chapter' AND pc <> chapter_number""",
)


@query("citation_errors", "SELECT code, count(*) AS n, count(DISTINCT node_id) AS nodes FROM citation_faults GROUP BY code")
def citation_errors(t: Tables):
    e = G.citation_errors(t.cited_lines, t.part_chunks)
    return e.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("nodes"))


@query("evidence_set", "SELECT c.doc, c.node_id, min(c.ord) AS first_cited, count(*) AS citations FROM cited_lines c JOIN part_chunks p USING (node_id) GROUP BY c.doc, c.node_id")
def evidence_set(t: Tables):
    return G.evidence_set(t.cited_lines, t.part_chunks).select("doc", "node_id", "first_cited", "citations")


# -- quotes -----------------------------------------------------------------------------------------------
derive(
    "quoted",
    """SELECT CAST(doc_id AS STRING) AS claim_id, 'c' || CAST(doc_id AS STRING) AS node_id, CASE WHEN doc_id % 5 = 0 THEN split_part(text, chr(10), 1) || ' never said' WHEN doc_id % 5 = 1 THEN text ELSE split_part(text, chr(10), 2) END AS quote, doc_id % 9 <> 0 AS cited FROM documents""",
)


@query(
    "evidence_span",
    rf"""WITH q AS (SELECT claim_id, quote, cited, {flat('quote')} AS nq, {flat('d.text')} AS nt FROM quoted JOIN documents d ON 'c' || CAST(d.doc_id AS STRING) = node_id),
       w AS (SELECT *, CASE WHEN nq = '' THEN 0 ELSE len(string_split(nq, ' ')) END AS n FROM q)
       SELECT claim_id, array_to_string(list_filter([CASE WHEN nq = '' THEN 'EVIDENCE_SPAN_QUOTE_TOO_SHORT' END, CASE WHEN nq <> '' AND NOT cited THEN 'EVIDENCE_SPAN_NODE_NOT_CITED' END, CASE WHEN nq <> '' AND n < 4 THEN 'EVIDENCE_SPAN_QUOTE_TOO_SHORT' END, CASE WHEN n > 80 THEN 'EVIDENCE_SPAN_QUOTE_TOO_LONG' END,
         CASE WHEN nq <> '' AND NOT contains(nt, nq) THEN 'EVIDENCE_SPAN_QUOTE_NOT_FOUND' END], lambda x: x IS NOT NULL), ';') AS codes, nq <> '' AND cited AND n BETWEEN 4 AND 80 AND contains(nt, nq) AS verified FROM w""",
)
def evidence_span(t: Tables):
    spans = t.quoted.select("claim_id", F.lit(0).alias("i"), "node_id", "quote", F.when(F.col("cited"), F.array("node_id")).otherwise(F.array(F.lit("x"))).alias("source_ids"))
    checked = G.verify_spans(spans, t.chunks.select(F.col("id").alias("node_id"), "text"))
    return checked.select("claim_id", F.array_join("codes", ";").alias("codes"), "verified")


derive(
    "passage_sentences",
    "SELECT 1 AS unused",
    rf"""SELECT item_id, i, lower(trim(s[i])) AS q FROM (SELECT item_id, string_split(regexp_replace({flat('text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM benchmark), UNNEST(range(1, len(s) + 1)) AS u(i)""",
)


@query(
    "span_cover",
    rf"""WITH d AS (SELECT doc_id, lower({flat('text')}) AS f FROM documents), q AS (SELECT *, len(string_split(q, ' ')) BETWEEN 4 AND 80 AS fits FROM passage_sentences),
       h AS (SELECT q.item_id, q.i, arg_min('c' || CAST(d.doc_id AS STRING), d.doc_id) AS node_id FROM q JOIN d ON q.fits AND contains(d.f, q.q) GROUP BY q.item_id, q.i)
       SELECT CAST(q.item_id AS STRING) AS claim_id, count(*) AS sentences, CASE WHEN bool_and(fits AND h.node_id IS NOT NULL) THEN 'source_grounded' ELSE 'insufficient_source_evidence' END AS origin FROM q LEFT JOIN h ON h.item_id = q.item_id AND h.i = q.i GROUP BY q.item_id""",
)
def span_cover(t: Tables):
    claims = t.benchmark.select(F.col("item_id").cast("string").alias("claim_id"), T.squash("text").alias("text"))
    chunks = t.chunks.select(F.col("id").alias("node_id"), "ord", "text")
    return G.cover_claims(claims, chunks, [])[1]


@query(
    "quote_locations",
    rf"""WITH d AS (SELECT doc_id, lower({flat('text')}) AS f FROM documents), q AS (SELECT * FROM passage_sentences WHERE q <> '')
       SELECT q.item_id, q.i, min(d.doc_id) AS doc_id FROM q JOIN d ON contains(d.f, q.q) GROUP BY q.item_id, q.i""",
)
def quote_locations(t: Tables):
    parts = t.benchmark.select("item_id", F.posexplode(G.sentences(T.squash("text"))).alias("i", "s"))
    quotes = parts.select(F.struct("item_id", (F.col("i") + 1).alias("i")).alias("quote_id"), T.match_text("s").alias("norm"))
    chunks = t.chunks.select(F.col("id").alias("node_id"), "ord", T.match_text("text").alias("norm"))
    found = G.locate_quotes(quotes, chunks, [])
    return found.select("quote_id.item_id", F.col("quote_id.i").cast("long").alias("i"), F.col("ord").alias("doc_id"))


@query(
    "text_derivation",
    rf"""SELECT claim_id, CASE WHEN NOT cited THEN 'pedagogical_generation' WHEN trim(quote, ' ' || chr(10)) <> '' AND contains({flat('d.text')}, {flat('quote')}) THEN 'exact_source_text' ELSE 'source_paraphrase' END AS text_derivation FROM quoted JOIN documents d ON 'c' || CAST(d.doc_id AS STRING) = node_id""",
)
def text_derivation(t: Tables):
    records = t.quoted.select(
        F.col("claim_id").alias("record_id"), F.when(F.col("cited"), "source_grounded").otherwise("pedagogical_generation").alias("origin"), F.col("quote").alias("text"), F.array("node_id").alias("source_chunk_ids")
    )
    return G.text_derivation(records, t.chunks.select(F.col("id").alias("node_id"), "text")).select(F.col("record_id").alias("claim_id"), "text_derivation")


@query(
    "quote_bank",
    rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace({flat('text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents), e AS (SELECT doc_id, i, trim(l[i]) AS q FROM s, UNNEST(range(1, len(l) + 1)) AS u(i)),
       g AS (SELECT doc_id, q, min(i) AS i FROM e WHERE len(string_split(q, ' ')) BETWEEN 4 AND 80 AND q <> '' GROUP BY doc_id, q), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g)
       SELECT 'c' || CAST(doc_id AS STRING) || '.quote_' || lpad(CAST(p AS STRING), 2, '0') AS quote_id, CAST(p AS INT) AS position, q AS quote FROM r WHERE p <= 12""",
)
def quote_bank(t: Tables):
    return G.quote_bank(t.chunks.withColumn("node_id", F.col("id"))).select("quote_id", "position", "quote")


# -- judged claims ------------------------------------------------------------------------------------------
derive(
    "judged",
    """SELECT CAST(d.doc_id AS STRING) AS claim_id, d.doc_id AS ord, d.source AS book, CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE CAST(d.doc_id % 6 AS INT) END AS chapter_number, d.lang AS claim_type, d.text AS claim_text,
       CASE d.n_chars % 6 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED' WHEN 3 THEN 'CONTRADICTED' WHEN 4 THEN 'SOURCE_DAMAGED' ELSE 'NOT_A_FACTUAL_CLAIM' END AS support_status,
       CASE WHEN l.toxic = 1 THEN 'HIGH' WHEN l.quality = 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)


@query(
    "verdict_rollup",
    """WITH c AS (SELECT book, coalesce(CAST(chapter_number AS STRING), 'book') AS chapter, support_status AS s, severity, support_status NOT IN ('SUPPORTED', 'NOT_A_FACTUAL_CLAIM') AS f FROM judged)
       SELECT book, chapter, count(*) AS claim_count, count(*) FILTER (WHERE s = 'CONTRADICTED') AS contradicted_count, count(*) FILTER (WHERE f AND severity = 'HIGH') AS high_severity_finding_count,
       CASE WHEN count(*) FILTER (WHERE f AND severity = 'HIGH') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE f) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS verdict FROM c GROUP BY GROUPING SETS ((book), (book, chapter))""",
)
def verdict_rollup(t: Tables):
    return L.verdict_rollup(t.judged, ["book"]).select("book", "chapter", "claim_count", "contradicted_count", "high_severity_finding_count", "verdict")


@query("results_by", "SELECT book, 'claim_type' AS dimension, claim_type AS value, count(*) AS n FROM judged GROUP BY book, claim_type UNION ALL SELECT book, 'support_status', support_status, count(*) FROM judged GROUP BY book, support_status")
def results_by(t: Tables):
    return L.results_by(t.judged, ["book"], ["claim_type", "support_status"])


@query(
    "priority_findings",
    rf"""SELECT claim_id, CAST(list_position(['CONTRADICTED', 'SOURCE_DAMAGED', 'UNSUPPORTED', 'PARTIALLY_SUPPORTED'], support_status) AS BIGINT) AS priority, CASE WHEN len({flat('claim_text')}) <= 300 THEN {flat('claim_text')} ELSE rtrim(substr({flat('claim_text')}, 1, 297)) || '...' END AS claim_text
       FROM judged WHERE severity = 'HIGH' AND support_status NOT IN ('SUPPORTED', 'NOT_A_FACTUAL_CLAIM')""",
)
def priority_findings(t: Tables):
    return L.priority_findings(t.judged).select("claim_id", F.col("priority").cast("long").alias("priority"), "claim_text")


derive("worded", "SELECT claim_id, claim_type, CASE WHEN ord % 4 = 0 THEN claim_text || ' must' WHEN ord % 4 = 1 THEN 'Scores ' || claim_text WHEN ord % 4 = 2 THEN 'time limit, ' || claim_text ELSE claim_text END AS claim_text, severity AS model_severity FROM judged")


@query(
    "severity_floor",
    r"""WITH w AS (SELECT *, regexp_matches(regexp_replace(claim_text || ' {} ' || claim_type, '[^\x00-\x7F]', 'Z', 'g'), '(?i)\b(score|scoring|zero score|partial credit|time limit|timed|minutes?|word limit|words?|sentence or less|response format|must|mandatory|listening|reading|writing|speaking|pronunciation|grammar|spelling|essay|dictation|test takers?|pte academic)\b') AS hit FROM worded)
       SELECT claim_id, CASE WHEN hit THEN 'HIGH' ELSE model_severity END AS severity, hit AND model_severity <> 'HIGH' AS severity_floor_applied FROM w""",
)
def severity_floor(t: Tables):
    rows = t.worded.withColumn("context", F.lit("{}"))
    return L.apply_severity_floor(rows).select("claim_id", "severity", "severity_floor_applied")


@query("results_of_chapters", "SELECT claim_id, chapter_number FROM judged WHERE chapter_number IN (SELECT DISTINCT n_regionkey FROM nation)")
def results_of_chapters(t: Tables):
    return L.results_of_chapters(t.judged, t.nation.select(F.col("n_regionkey").alias("chapter_number"))).select("claim_id", "chapter_number")


@query(
    "batch_plan",
    """WITH g AS (SELECT *, o_orderpriority || '|' || o_orderstatus AS b, min(o_orderkey) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS f, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS n FROM orders),
       s AS (SELECT *, (n - 1) // 7 AS sl FROM g) SELECT o_orderkey AS ord, dense_rank() OVER (ORDER BY f, sl) AS batch_number FROM s""",
)
def batch_plan(t: Tables):
    claims = t.orders.select(F.lit("d").alias("doc"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("chapter_number"), F.array("o_orderstatus").alias("source_chunk_ids"))
    return L.plan_batches(claims, 7).select("ord", F.col("batch_number").cast("long").alias("batch_number"))


@query(
    "judge_completeness",
    """WITH r AS (SELECT event_id % 20000 AS id, event_type, user_id, value FROM events), e AS (SELECT o_orderkey AS id FROM orders), n AS (SELECT id, count(*) AS k FROM r GROUP BY id)
       SELECT code, count(*) AS n FROM (SELECT DISTINCT coalesce(n.id, e.id) AS id, CASE WHEN n.id IS NULL THEN 'MISSING_RESULT' WHEN e.id IS NULL THEN 'EXTRA_RESULT' WHEN n.k > 1 THEN 'DUPLICATE_RESULT' WHEN r.event_type = 'error' THEN 'INVALID_SUPPORT_STATUS' WHEN r.user_id % 9 = 0 THEN 'BLANK_RATIONALE' WHEN r.user_id % 5 = 0 THEN 'EVIDENCE_OUTSIDE_CITATIONS' END AS code
         FROM n FULL JOIN e ON n.id = e.id LEFT JOIN r ON r.id = n.id) WHERE code IS NOT NULL GROUP BY code""",
)
def judge_completeness(t: Tables):
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.array(F.lit("a")).alias("source_chunk_ids"), F.lit("t").alias("claim_text"), F.lit("{}").alias("context"), F.lit("k").alias("claim_type"))
    raw = t.events.select(
        (F.col("event_id") % 20000).alias("claim_id"), F.when(F.col("event_type") == "error", "odd").otherwise("SUPPORTED").alias("support_status"), F.lit("definition").alias("claim_nature"), F.lit("LOW").alias("severity"),
        F.lit("HIGH").alias("confidence"), F.when(F.col("user_id") % 9 == 0, " ").otherwise("why").alias("rationale"), F.when(F.col("user_id") % 5 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("evidence_chunk_ids_used"),
    )
    return L.judged_results(claims, raw)[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("claim_results", "SELECT CAST(o_orderkey AS STRING) AS claim_id, o_orderstatus AS claim_type, l.n AS votes FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey")
def claim_results(t: Tables):
    claims = t.orders.select(F.col("o_orderkey").cast("string").alias("claim_id"), F.col("o_orderstatus").alias("claim_type"))
    results = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("claim_id")).agg(F.count(F.lit(1)).alias("votes"))
    return L.join_results(claims, results)


@query(
    "coverage_worst",
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'UNSUPPORTED' WHEN l_returnflag = 'A' THEN 'PARTIALLY_SUPPORTED' WHEN l_linestatus = 'F' THEN 'NOT_A_FACTUAL_CLAIM' ELSE 'SUPPORTED' END AS s FROM lineitem),
       a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE s <> 'NOT_A_FACTUAL_CLAIM') AS f, bool_or(s = 'UNSUPPORTED') AS u, bool_or(s = 'PARTIALLY_SUPPORTED') AS p FROM r GROUP BY l_orderkey)
       SELECT o_orderkey AS concept_id, CASE WHEN n IS NULL THEN 'OMITTED' WHEN f = 0 THEN 'ERROR_ONLY_NON_FACTUAL' WHEN u THEN 'COVERED_UNSAFELY' WHEN p THEN 'PARTIALLY_COVERED' ELSE 'COVERED_SAFELY' END AS coverage_status, coalesce(n, 0) AS claims FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
)
def coverage_worst(t: Tables):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("concept_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("claim_id"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "UNSUPPORTED").when(F.col("l_returnflag") == "A", "PARTIALLY_SUPPORTED")
        .when(F.col("l_linestatus") == "F", "NOT_A_FACTUAL_CLAIM").otherwise("SUPPORTED").alias("support_status"),
    )
    ids = lines.withColumn("claim_id", F.to_json("claim_id"))
    return A.concept_coverage(t.orders.select(F.col("o_orderkey").alias("concept_id")), ids.select("concept_id", "claim_id"), ids.select("claim_id", "support_status").distinct())


@query(
    "version_comparison",
    """WITH a AS (SELECT source AS book, count(*) FILTER (WHERE n_chars % 6 BETWEEN 1 AND 4 AND doc_id % 3 = 0) AS hi1 FROM documents GROUP BY source),
       b AS (SELECT source AS book, count(*) FILTER (WHERE doc_id % 3 = 0 AND n_chars % 97 = 1 AND doc_id % 4 = 0) AS hi2, count(*) FILTER (WHERE n_chars % 97 = 1 AND doc_id % 4 <> 0) AS less, count(*) FILTER (WHERE doc_id % 3 = 1 AND doc_id % 211 = 1) AS mis, count(*) FILTER (WHERE doc_id % 3 = 1 AND doc_id % 50 = 2) AS rev FROM documents GROUP BY source),
       c AS (SELECT source AS book, count(*) FILTER (WHERE lang = 'fr' AND n_chars % 31 = 0) AS om, count(*) FILTER (WHERE lang <> 'fr' AND n_chars % 31 = 0) AS mom, count(*) FILTER (WHERE n_chars % 31 = 1) AS pc FROM documents GROUP BY source),
       v AS (SELECT book, hi1, hi2, CASE WHEN hi2 > 0 OR mis > 0 THEN 'FAIL' WHEN less + rev > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS safety, CASE WHEN om > 0 THEN 'FAIL' WHEN mom + pc > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS coverage FROM a JOIN b USING (book) JOIN c USING (book))
       SELECT book, safety, coverage, CASE WHEN safety = 'PASS' AND coverage = 'PASS' AND hi2 < hi1 THEN 'IMPROVED' WHEN safety <> 'FAIL' AND coverage = 'PASS_WITH_WARNINGS' AND hi2 < hi1 THEN 'IMPROVED_WITH_COVERAGE_WARNINGS' ELSE 'NOT_IMPROVED' END AS comparison FROM v""",
)
def version_comparison(t: Tables):
    d, n, i = t.documents, F.col("n_chars"), F.col("doc_id")
    v1 = d.select(F.col("source").alias("book"), F.when((n % 6).between(1, 4), "UNSUPPORTED").otherwise("SUPPORTED").alias("support_status"), F.when(i % 3 == 0, "HIGH").otherwise("LOW").alias("severity"))
    grounded, generated = i % 3 == 0, i % 3 == 1
    v2 = d.select(
        F.col("source").alias("book"), F.when(grounded, "source_grounded").when(generated, "pedagogical_generation").otherwise("insufficient_source_evidence").alias("origin"),
        F.when(n % 97 == 1, "CONTRADICTED").otherwise("SUPPORTED").alias("semantic"), F.when(i % 211 == 1, "MISLEADING").when(i % 50 == 2, "NEEDS_REVISION").otherwise("USABLE").alias("pedagogical"),
        F.lit("JUSTIFIED").alias("abstention"), F.when(i % 4 == 0, "HIGH").otherwise("MEDIUM").alias("severity"),
    )
    cov = d.select(F.col("source").alias("book"), F.when(F.col("lang") == "fr", "HIGH").otherwise("MEDIUM").alias("importance"), F.when(n % 31 == 0, "SILENTLY_OMITTED").when(n % 31 == 1, "PARTIALLY_COVERED").otherwise("COVERED_SAFELY").alias("v2_status"))
    return A.version_comparison(v1, v2, cov).select("book", "safety", "coverage", "comparison")


@query(
    "version_findings",
    """SELECT CAST(doc_id % 6 AS INT) AS chapter_number, 'HIGH_SEVERITY_UNSAFE_SOURCE_GROUNDED' AS category, CAST(doc_id AS STRING) AS id FROM documents WHERE n_chars % 11 = 0 AND lang = 'en'
       UNION ALL SELECT CAST(doc_id % 6 AS INT), 'MISLEADING_PEDAGOGICAL_RECORD', CAST(doc_id AS STRING) FROM documents WHERE lang = 'fr' AND n_chars % 5 = 0
       UNION ALL SELECT CAST(doc_id % 6 AS INT), 'HIGH_IMPORTANCE_COVERED_UNSAFELY', CAST(doc_id AS STRING) FROM documents WHERE lang = 'de'""",
)
def version_findings(t: Tables):
    base = t.documents.select((F.col("doc_id") % 6).cast("int").alias("chapter_number"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("record_id"), "lang", "n_chars")
    v2 = base.select(
        "chapter_number", "ord", "record_id", F.when(F.col("lang") == "en", "source_grounded").otherwise("pedagogical_generation").alias("origin"), F.when(F.col("n_chars") % 11 == 0, "UNSUPPORTED").otherwise("SUPPORTED").alias("semantic"),
        F.when((F.col("lang") == "fr") & (F.col("n_chars") % 5 == 0), "MISLEADING").otherwise("USABLE").alias("pedagogical"), F.lit("HIGH").alias("severity"),
    )
    cov = base.select("chapter_number", "ord", F.col("record_id").alias("concept_id"), F.when(F.col("lang") == "de", "HIGH").otherwise("LOW").alias("importance"), F.lit("COVERED_UNSAFELY").alias("v2_status"))
    traces = base.select("chapter_number", F.col("record_id").alias("probe_id"), F.lit("COVERED_SAFELY").alias("v2_status"))
    return A.version_findings(v2, cov, traces).select("chapter_number", "category", "id")


# -- lessons: a conversation as a lesson, its turns as source chunks -----------------------------------------
derive("turns", "SELECT conv_id AS lesson_id, turn AS i, CASE WHEN conv_id % 12 = 3 AND turn = 2 THEN 't1' ELSE 't' || CAST(turn AS STRING) END AS node_id, CASE WHEN turn = 4 THEN ' ' ELSE text END AS text_preview, role FROM conversations")


@query(
    "lesson_citations",
    """WITH d AS (SELECT lesson_id, node_id, count(*) AS n FROM turns GROUP BY lesson_id, node_id), c AS (SELECT lesson_id, i, CASE WHEN i % 3 = 0 THEN NULL ELSE 't' || CAST(i + 1 AS STRING) END AS cite FROM turns)
       SELECT code, count(*) AS n FROM (SELECT 'DUPLICATE_CHUNK' AS code FROM d WHERE n > 1 UNION ALL SELECT 'MISSING_PREVIEW' FROM turns WHERE trim(text_preview, ' ' || chr(10)) = '' UNION ALL SELECT 'IDEA_WITHOUT_SOURCE' FROM c WHERE cite IS NULL
         UNION ALL SELECT 'UNKNOWN_CITATION' FROM c WHERE cite IS NOT NULL AND (lesson_id, cite) NOT IN (SELECT lesson_id, node_id FROM d) UNION ALL SELECT 'UNCITED_CHUNK' FROM turns WHERE (lesson_id, node_id) NOT IN (SELECT lesson_id, cite FROM c WHERE cite IS NOT NULL)) GROUP BY code""",
)
def lesson_citations(t: Tables):
    ideas = t.turns.select("lesson_id", "i", F.col("role").alias("idea"), F.when(F.col("i") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (F.col("i") + 1).cast("string")))).alias("source_chunk_ids"))
    return A.citation_audit(t.turns, ideas).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


derive("lesson_rows", "SELECT lesson_id, i, node_id || '.' || CAST(i AS STRING) AS node_id, text_preview, CAST(lesson_id % 3 AS INT) AS chapter_number, CASE WHEN role = 'system' THEN NULL ELSE role END AS section, CAST(CASE WHEN lesson_id % 4 = 0 THEN 9 - i ELSE i END AS INT) AS page_start, CAST(i AS INT) AS page_end FROM turns")


@query(
    "section_lesson_audit",
    """WITH k AS (SELECT lesson_id, count(*) AS n, bool_or(chapter_number <> 0) AS wrong, bool_or(section IS NULL) AS nosec, bool_or(trim(text_preview, ' ' || chr(10)) = '') AS blank, bool_or(len(text_preview) > 300 AND trim(text_preview, ' ' || chr(10)) <> '') AS long FROM lesson_rows GROUP BY lesson_id),
       o AS (SELECT lesson_id, bool_or(p > page_start) AS brk FROM (SELECT *, lag(page_start) OVER (PARTITION BY lesson_id ORDER BY i) AS p FROM lesson_rows) GROUP BY lesson_id)
       SELECT lesson_id, wrong, nosec, blank, long, coalesce(brk, false) AS page_break FROM k JOIN o USING (lesson_id)""",
)
def section_lesson_audit(t: Tables):
    rows = t.lesson_rows
    lessons = rows.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("retrieved_chunk_count")).select(
        "lesson_id", "retrieved_chunk_count", F.lit(0).alias("resolved_chapter"), F.lit(None).cast("int").alias("filter_chapter"), F.lit(False).alias("front_matter"), F.lit("user").alias("requested_section"), F.lit(True).alias("include_descendants"),
        F.lit("semantic").alias("ordering"), F.lit(2).alias("expanded_count"), F.lit(2).alias("covered_count"), F.lit(0).alias("missing_count"),
        F.array(F.lit("user"), F.lit("assistant")).alias("covered_titles"), F.array().cast("array<string>").alias("missing_titles"),
    )
    titles = lessons.select("lesson_id", F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("section"))
    positions = rows.select("chapter_number", "section").distinct().withColumn("position", F.lit(1)).filter(F.col("section").isNotNull())
    found = A.section_lesson_findings(lessons, rows, rows.select("lesson_id", "node_id"), titles, positions)
    has = lambda code: F.bool_or(F.col("code") == code)
    per = found.groupBy(F.col("key").cast("long").alias("lesson_id")).agg(
        has("CHAPTER_BOUNDARY").alias("wrong"), has("NO_SECTION").alias("nosec"), has("MISSING_PREVIEW").alias("blank"), has("PREVIEW_TOO_LONG").alias("long"), has("NOT_PAGE_SORTED").alias("page_break")
    )
    return lessons.select("lesson_id").join(per, "lesson_id", "left").na.fill(False)


@query(
    "answer_rules",
    """SELECT event_id AS response_id, CASE WHEN user_id % 13 = 0 THEN 'missing_fields' WHEN event_id % 17 = 0 THEN 'blank_answer' WHEN event_id % 7 = 0 THEN 'unknown_id' WHEN event_type = 'error' THEN 'invalid_confidence' WHEN event_type = 'view' THEN 'duplicate_follow_up' WHEN event_id % 5 = 0 THEN 'supported_answer_without_citation' END AS code FROM events""",
)
def answer_rules(t: Tables):
    e = t.events
    fields = ["answer", "source_chunk_ids", "confidence", "follow_up_questions"]
    names = lambda n: F.array(*[F.lit(f) for f in fields[:n]])
    rows = e.select(
        F.col("event_id").alias("response_id"), F.when(F.col("user_id") % 13 == 0, names(3)).otherwise(names(4)).alias("fields"), F.when(F.col("event_id") % 17 == 0, " ").otherwise("It says so").alias("answer"),
        F.when(F.col("event_id") % 7 == 0, F.array(F.lit("z"))).when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("source_chunk_ids"),
        F.when(F.col("event_type") == "error", "sure").otherwise("high").alias("confidence"), F.when(F.col("event_type") == "view", F.array(F.lit("q"), F.lit(" q"))).otherwise(F.array(F.lit("q"), F.lit("r"))).alias("follow_up_questions"), F.array(F.lit("a"), F.lit("b")).alias("allowed_ids"),
    )
    return K.answer_errors(rows).select("response_id", "code")


@query(
    "provenance_split",
    """SELECT l_returnflag || l_linestatus AS k, count(*) FILTER (WHERE l_suppkey % 10 = 0) AS overlaps, count(*) FILTER (WHERE l_suppkey % 10 <> 0 AND l_partkey % 2 = 0) AS lesson_cites FROM lineitem GROUP BY 1""",
)
def provenance_split(t: Tables):
    one = F.when(F.col("l_partkey") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
    rows = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("response_id"), F.array(one).alias("source_chunk_ids"), F.array(F.lit("a")).alias("lesson_ids"),
        F.when(F.col("l_suppkey") % 10 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("fallback_ids"),
    )
    s = K.split_provenance(rows)
    return s.groupBy(F.col("response_id").alias("k")).agg(F.count_if(F.col("code").isNotNull()).alias("overlaps"), F.coalesce(F.sum(F.size("lesson_source_chunk_ids")), F.lit(0)).alias("lesson_cites"))


@query(
    "run_compare",
    """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id, event_type), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id, event_type)
       SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS node_id, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
)
def run_compare(t: Tables):
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    side = lambda cond: t.events.filter(cond).groupBy("user_id", F.col("event_type").alias("node_id")).agg(F.count(F.lit(1)).cast("string").alias("text_preview")).withColumn("section", F.lit("s")).withColumn("page_start", F.lit(1))
    return A.compare_runs(side(F.col("ts") < cut), side(F.col("ts") >= cut), ["user_id"]).select("user_id", "node_id", "change")


@query(
    "run_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'INCONCLUSIVE' WHEN o_custkey % 5 = 0 THEN 'REGRESSED' WHEN o_custkey % 3 > o_orderkey % 3 THEN 'REGRESSED' WHEN o_custkey % 3 < o_orderkey % 3 THEN 'IMPROVED' ELSE 'SAME_PASS' END AS status FROM orders""",
)
def run_status(t: Tables):
    runs = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", "PASS").alias("old_status"), F.lit("PASS").alias("new_status"), (F.col("o_orderkey") % 3).alias("old_warnings"), (F.col("o_custkey") % 3).alias("new_warnings"),
        F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0).alias("new_failures"), F.lit(True).alias("old_starts"), F.lit(True).alias("new_starts"),
    )
    return A.comparison_status(runs).select("o_orderkey", "status")


@query(
    "material_audit",
    """WITH b AS (SELECT c_mktsegment AS book, count(*) AS n FROM customer GROUP BY c_mktsegment), u AS (SELECT DISTINCT c_mktsegment AS book, c_nationkey + 1 AS nk FROM customer)
       SELECT book, CASE WHEN (SELECT count(*) FROM u WHERE u.book = b.book AND nk NOT IN (SELECT n_nationkey FROM nation)) > 0 OR n % 2 = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM b""",
)
def material_audit(t: Tables):
    c = t.customer.withColumnRenamed("c_mktsegment", "book")
    counts = c.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    books = counts.select("book", (F.col("n") + F.col("n") % 2).alias("detected_chapters"), F.lit(None).cast("int").alias("max_chapters"))
    chapters = c.select("book", F.col("c_custkey").alias("chapter_number"), F.array(*[F.lit(f) for f in A.REQUIRED_CHAPTER_FIELDS]).alias("fields"))
    chunks = counts.select("book").crossJoin(F.broadcast(t.nation.select(F.col("n_nationkey").cast("string").alias("node_id"))))
    refs = c.select("book", (F.col("c_nationkey") + 1).cast("string").alias("node_id"))
    return A.audit_status(books, A.material_findings(books, chapters, chunks, refs), "book").select("book", "status")


# -- approvals, provenance, corrections ------------------------------------------------------------------------
derive("approval_claims", "SELECT CAST(n_chars % 50 AS INT) AS chapter_number, 'p' || CAST(doc_id AS STRING) AS claim_path, CAST(doc_id AS INT) AS k, text FROM documents")


@query(
    "approval_status",
    """SELECT claim_path, CASE WHEN k % 7 = 0 THEN 'not_reviewed' WHEN k % 7 = 1 THEN 'rejected' WHEN k % 7 = 2 THEN 'reworded' WHEN k % 7 = 3 THEN 'source_changed' WHEN k % 7 = 4 THEN 'chunks_missing' END AS reason FROM approval_claims""",
)
def approval_status(t: Tables):
    claims = t.approval_claims
    chunks = claims.select("chapter_number", F.col("claim_path").alias("node_id"), "text")
    revisions = G.source_revision(chunks, ["chapter_number"])
    k = F.col("k") % 7
    approvals = claims.filter(k != 0).join(revisions, "chapter_number").select(
        "chapter_number", "claim_path", F.when(k == 1, "unfaithful").otherwise("faithful").alias("verdict"),
        G.claim_hash(F.when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("claim_hash"),
        F.when(k == 3, "old").otherwise(F.col("revision")).alias("source_content_revision"),
        F.array(F.when(k == 4, "gone").otherwise(F.col("claim_path"))).alias("source_chunk_ids"),
    )
    return G.approval_status(claims.select("chapter_number", "claim_path", "text"), approvals, revisions, chunks.select("chapter_number", "node_id")).select("claim_path", "reason")


@query(
    "provenance_records",
    """SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_custkey % 4 = 0 THEN 'no_source_chunks' END WHEN 'F' THEN CASE WHEN o_custkey % 3 = 0 THEN 'missing_fields' END ELSE 'insufficient_source_evidence' END AS error FROM orders""",
)
def provenance_records(t: Tables):
    o = t.orders
    none = F.array().cast("array<string>")
    rows = o.select(
        F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "O", "source_grounded").when(F.col("o_orderstatus") == "F", "pedagogical_generation").otherwise("insufficient_source_evidence").alias("origin"),
        F.when(F.col("o_custkey") % 4 == 0, none).otherwise(F.array(F.lit("c"))).alias("source_chunk_ids"), none.alias("grounded_in_source_chunk_ids"), none.alias("chunk_ids"), F.lit(None).cast("string").alias("transformation"),
        F.lit("r").alias("generation_reason"), F.when(F.col("o_custkey") % 3 != 0, "g1").alias("generator_version"), F.lit(None).cast("string").alias("author_reference"), F.lit("res").alias("source_resource_id"),
    )
    return G.translate_provenance(rows).select("path", "error")


@query(
    "corrections",
    """SELECT source AS doc, 'p' || CAST(doc_id AS STRING) AS json_path, CASE WHEN n_chars % 6 IN (1, 2, 3) AND doc_id % 2 = 0 THEN 'fixed' ELSE lang END AS value, n_chars % 6 IN (1, 2, 3) AND doc_id % 2 = 0 AS corrected FROM documents""",
)
def corrections(t: Tables):
    d = t.documents.select(F.col("source").alias("doc"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("json_path"), "lang", "doc_id", (F.col("n_chars") % 6).alias("k"))
    audit = d.select("doc", "json_path", F.element_at(F.array(*[F.lit(s) for s in L.SUPPORT_STATUSES]), (F.col("k") + 1).cast("int")).alias("support_status"))
    fixes = d.filter(F.col("doc_id") % 2 == 0).select("doc", "json_path", F.lit("fixed").alias("new_value"))
    return G.apply_corrections(d.select("doc", "json_path", F.col("lang").alias("value")), audit, fixes)[0]


@query(
    "claim_normalise",
    rf"""WITH q AS (SELECT q.claim_id, cited, CAST(q.claim_id AS INT) AS k, {flat('quote')} AS nq, {flat('d.text')} AS nt FROM quoted q JOIN documents d ON 'c' || CAST(d.doc_id AS STRING) = node_id),
       v AS (SELECT *, nq <> '' AND len(string_split(nq, ' ')) BETWEEN 4 AND 80 AND contains(nt, nq) AS ok FROM q)
       SELECT claim_id, CASE WHEN k % 8 = 0 THEN 'pedagogical_generation' WHEN NOT cited OR NOT ok THEN 'insufficient_source_evidence' ELSE 'source_grounded' END AS origin FROM v""",
)
def claim_normalise(t: Tables):
    claims = t.quoted.select(
        "claim_id", F.lit("d").alias("doc"), F.lit("t").alias("text"), F.when(F.col("claim_id").cast("int") % 8 == 0, "misconception_statement").otherwise("definition").alias("claim_kind"), F.lit("source_grounded").alias("origin"),
        F.when(F.col("cited"), F.array("node_id", "node_id")).otherwise(F.array(F.lit("zz"))).alias("source_chunk_ids"), F.array().cast("array<string>").alias("grounded_in_source_chunk_ids"), F.array(F.struct("node_id", "quote")).alias("evidence_spans"), F.lit(None).cast("string").alias("reason"),
    )
    chunks = t.chunks.select(F.col("id").alias("node_id"), "text")
    return G.normalise_claims(claims, chunks, chunks.select(F.lit("d").alias("doc"), "node_id")).select("claim_id", "origin")


@query(
    "grounded_rules",
    rf"""WITH q AS (SELECT q.claim_id, cited, CAST(q.claim_id AS INT) AS k, quote, {flat('quote')} AS nq, {flat('d.text')} AS nt FROM quoted q JOIN documents d ON 'c' || CAST(d.doc_id AS STRING) = node_id),
       v AS (SELECT *, CASE WHEN nq = '' THEN 0 ELSE len(string_split(nq, ' ')) END AS n FROM q),
       e AS (SELECT claim_id, 'INVALID_CLAIM_KIND' AS code FROM v WHERE k % 6 = 1 UNION ALL SELECT claim_id, 'PEDAGOGICAL_ORIGIN_NOT_ALLOWED' FROM v WHERE k % 6 = 2 UNION ALL SELECT claim_id, 'PEDAGOGICAL_ORIGIN_NOT_ALLOWED' FROM v WHERE k % 6 = 2
         UNION ALL SELECT claim_id, 'INVALID_ORIGIN_FIELD_COMBINATION' FROM v WHERE k % 6 = 2 UNION ALL SELECT claim_id, 'INVALID_ORIGIN_FIELD_COMBINATION' FROM v WHERE k % 6 = 2
         UNION ALL SELECT claim_id, 'SOURCE_CHUNK_ID_NOT_FOUND' FROM v WHERE NOT cited UNION ALL SELECT claim_id, 'EVIDENCE_SPAN_NODE_NOT_CITED' FROM v WHERE NOT cited AND nq <> '' UNION ALL SELECT claim_id, 'EVIDENCE_SPAN_QUOTE_TOO_SHORT' FROM v WHERE n < 4
         UNION ALL SELECT claim_id, 'EVIDENCE_SPAN_QUOTE_TOO_LONG' FROM v WHERE n > 80 UNION ALL SELECT claim_id, 'EVIDENCE_SPAN_QUOTE_NOT_FOUND' FROM v WHERE nq <> '' AND NOT contains(nt, nq) UNION ALL SELECT claim_id, 'INVALID_GROUNDED_CONTENT_SHAPE' FROM v WHERE false)
       SELECT code, count(*) AS n FROM e GROUP BY code""",
)
def grounded_rules(t: Tables):
    k = F.col("claim_id").cast("int") % 6
    rows = t.quoted.select(
        "claim_id", F.lit("$.x").alias("path"), F.lit("key_terms.meaning").alias("field"), F.lit(1).alias("chapter_number"), F.lit("a.pdf").alias("book_pdf"), F.array().cast("array<string>").alias("missing_fields"), F.lit("t").alias("text"),
        F.when(k == 1, "strategy").otherwise("definition").alias("claim_kind"), F.when(k == 2, "pedagogical_generation").otherwise("source_grounded").alias("origin"),
        F.when(F.col("cited"), F.array("node_id")).otherwise(F.array(F.lit("zz"))).alias("source_chunk_ids"), F.array().cast("array<string>").alias("grounded_in_source_chunk_ids"), F.array(F.struct("node_id", "quote")).alias("evidence_spans"), F.lit(None).cast("string").alias("reason"),
    )
    chunks = t.chunks.select(F.col("id").alias("node_id"), "text", F.lit("a.pdf").alias("source_pdf"), F.lit(1).alias("chapter_number"))
    return K.grounded_errors(rows, chunks).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "substantive_minimums",
    """SELECT doc, 'TOO_FEW_KEY_TERMS' AS code FROM (SELECT source AS doc, count(*) FILTER (WHERE n_chars % 20 = 0) AS n FROM documents GROUP BY source) WHERE n < 3
       UNION ALL SELECT source, 'TOO_FEW_WORKED_EXAMPLES' FROM documents GROUP BY source UNION ALL SELECT source, 'TOO_FEW_PRACTICE_QUESTIONS' FROM documents GROUP BY source UNION ALL SELECT source, 'TOO_FEW_REVIEW_CHECKLIST_ITEMS' FROM documents GROUP BY source
       UNION ALL SELECT source, 'TOO_FEW_CORE_LESSONS' FROM documents GROUP BY source UNION ALL SELECT source, 'TOO_FEW_LEARNING_OBJECTIVES' FROM (SELECT source, count(*) FILTER (WHERE n_chars % 20 <> 0) AS n FROM documents GROUP BY source) WHERE n < 3
       UNION ALL SELECT source, 'GENERIC_PLACEHOLDER_TEXT' FROM documents WHERE doc_id % 83 = 0""",
)
def substantive_minimums(t: Tables):
    d = t.documents
    contents = d.select(
        F.col("source").alias("doc"), F.when(F.col("n_chars") % 20 == 0, "key_terms.meaning").otherwise("learning_objectives").alias("field"), F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 83 == 0, "Study the  source material.").otherwise(F.col("text")).alias("text"),
        F.lit("source_grounded").alias("origin"), F.array(F.col("doc_id").cast("string")).alias("source_chunk_ids"),
    )
    allowed = d.select(F.col("source").alias("doc"), F.col("doc_id").cast("string").alias("node_id"))
    return K.substantive_errors(contents, allowed, "doc").select("doc", "code")


@query(
    "approval_rules",
    """SELECT code, count(*) AS n FROM (SELECT 'UNKNOWN_VERDICT' AS code FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'REVIEWER_NOT_HUMAN' FROM orders WHERE o_custkey % 9 = 0 UNION ALL SELECT 'NO_SOURCE_CHUNKS' FROM orders WHERE o_orderkey % 8 = 0
         UNION ALL SELECT 'SECOND_APPROVAL' FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > 1) GROUP BY code""",
)
def approval_rules(t: Tables):
    o = t.orders.select(
        F.lit("m").alias("manifest_id"), F.col("o_orderkey").alias("i"), F.col("o_custkey").cast("string").alias("claim_path"), F.lit("h").alias("claim_hash"), F.lit("r").alias("source_content_revision"),
        F.when(F.col("o_orderkey") % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("source_chunk_ids"), F.lit("condensed_summary").alias("transformation_type"), F.when(F.col("o_orderstatus") == "P", "maybe").otherwise("faithful").alias("verdict"),
        F.struct(F.lit("1").alias("id"), F.lit("n").alias("name"), F.when(F.col("o_custkey") % 9 == 0, "model").otherwise("human").alias("kind")).alias("reviewer"),
    )
    return K.approval_problems(o).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recommendation_rules",
    """SELECT code, count(*) AS n FROM (SELECT 'UNKNOWN_DISPOSITION' AS code FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'OMITTED_WITHOUT_REASON' FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0
         UNION ALL SELECT 'CANDIDATE_WITH_REASON' FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 1 UNION ALL SELECT 'NO_RATIONALE' FROM orders WHERE o_orderkey % 6 = 0) GROUP BY code""",
)
def recommendation_rules(t: Tables):
    o = t.orders.select(
        F.lit("m").alias("manifest_id"), F.col("o_orderkey").alias("i"), F.when(F.col("o_orderstatus") == "O", "candidate").when(F.col("o_orderstatus") == "F", "omitted").otherwise("later").alias("disposition"), F.when(F.col("o_custkey") % 2 == 1, "why").alias("omission_reason"),
        F.lit(None).cast("string").alias("verdict"), F.lit("faithful").alias("recommended_verdict"), F.when(F.col("o_orderkey") % 6 != 0, "because").alias("rationale"), F.struct(F.lit("1").alias("id"), F.lit("n").alias("name"), F.lit("ai_assisted").alias("kind")).alias("recommended_by"),
    )
    return K.recommendation_problems(o).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


derive("noisy_concepts", "SELECT doc_id AS concept_id, CASE WHEN doc_id % 3 = 0 THEN 'Pronunciation of ' || lang ELSE lang END AS title, CASE WHEN doc_id % 4 = 0 THEN text || ' / /t/' ELSE text END AS quote, CASE WHEN doc_id % 5 = 0 THEN 'essay with a time limit' WHEN doc_id % 5 = 1 THEN 'partial credit' ELSE '' END AS description FROM documents")


@query(
    "source_noise",
    """SELECT concept_id, (concept_id % 3 = 0 OR contains(lower(quote), 'ipa')) AND (concept_id % 4 = 0 OR contains(quote, '//')) AS damaged_notation, concept_id % 5 = 0 AS timing, concept_id % 5 = 1 AS spelling FROM noisy_concepts""",
)
def source_noise(t: Tables):
    n = A.source_noise(t.noisy_concepts.select("concept_id", "title", "description", F.array("quote").alias("quotes")))
    return n.select("concept_id", "damaged_notation", F.array_contains("probes", "essay_timing").alias("timing"), F.array_contains("probes", "spelling_zero_score").alias("spelling"))


derive(
    "inventory",
    """SELECT CAST(n_chars % 90 AS INT) AS chapter_number, doc_id AS i, 'c' || CAST(doc_id AS STRING) AS node_id, text, CASE WHEN doc_id % 6 = 0 THEN 'chapter_x' ELSE NULL END AS wrong_id, CASE WHEN doc_id % 5 = 0 THEN 'topic' ELSE 'definition' END AS concept_type,
       CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE lang END AS title, CASE WHEN doc_id % 7 = 0 THEN 'c-1' ELSE 'c' || CAST(doc_id AS STRING) END AS source_id FROM documents""",
)


@query(
    "inventory_rules",
    rf"""WITH v AS (SELECT i.*, {flat('u.l')} AS nq, u.k AS k FROM (SELECT *, string_split(text, chr(10)) AS ls FROM inventory) i, LATERAL (SELECT unnest(i.ls) AS l, generate_subscripts(i.ls, 1) AS k) u),
       w AS (SELECT *, CASE WHEN nq = '' THEN 0 ELSE len(string_split(nq, ' ')) END AS n, row_number() OVER (PARTITION BY i, nq ORDER BY k) AS seen FROM v)
       SELECT code, count(*) AS n FROM (SELECT 'WRONG_CONCEPT_ID' AS code FROM inventory WHERE i % 6 = 0 UNION ALL SELECT 'INVALID_CONCEPT_TYPE' FROM inventory WHERE i % 5 = 0 UNION ALL SELECT 'BLANK_TITLE' FROM inventory WHERE i % 8 = 0 UNION ALL SELECT 'SOURCE_ID_OUTSIDE_CHAPTER' FROM inventory WHERE i % 7 = 0
         UNION ALL SELECT 'CONCEPT_COUNT' FROM inventory GROUP BY chapter_number HAVING count(*) NOT BETWEEN 4 AND 15 UNION ALL SELECT 'EVIDENCE_SPAN_NODE_NOT_CITED' FROM w WHERE i % 7 = 0 AND nq <> '' UNION ALL SELECT 'EVIDENCE_SPAN_QUOTE_TOO_SHORT' FROM w WHERE n < 4
         UNION ALL SELECT 'DUPLICATE_EVIDENCE_SPAN' FROM w WHERE nq <> '' AND seen > 1 UNION ALL SELECT 'EVIDENCE_SPAN_QUOTE_TOO_LONG' FROM w WHERE n > 80) GROUP BY code""",
)
def inventory_rules(t: Tables):
    i = t.inventory
    right = F.format_string("chapter_%02d.concept_%02d", F.col("chapter_number"), F.col("i").cast("int"))
    concepts = i.select(
        "chapter_number", "i", F.coalesce("wrong_id", right).alias("concept_id"), F.lit("HIGH").alias("importance"), "concept_type", F.lit("CLEAR").alias("source_condition"), "title", F.lit("d").alias("description"),
        F.array("source_id").alias("source_chunk_ids"), F.transform(F.split("text", "\n"), lambda l: F.struct("node_id", l.alias("quote"))).alias("evidence_spans"),
    )
    return A.inventory_problems(concepts, i.select("chapter_number", "node_id", "text")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evaluation_rules",
    """WITH n AS (SELECT event_id % 20000 AS id, count(*) AS k FROM events GROUP BY 1), e AS (SELECT event_id % 20000 AS id, event_type, user_id FROM events)
       SELECT code, count(*) AS n FROM (SELECT DISTINCT coalesce(n.id, o.o_orderkey) AS id, CASE WHEN n.id IS NULL THEN 'MISSING_EVALUATION' WHEN o.o_orderkey IS NULL THEN 'UNKNOWN_RECORD' WHEN n.k > 1 THEN 'DUPLICATE_EVALUATION' WHEN e.event_type = 'error' THEN 'INVALID_STATUS'
         WHEN o.o_orderstatus <> 'O' THEN 'STATUS_DOES_NOT_FIT_ORIGIN' WHEN e.user_id % 9 = 0 THEN 'BLANK_RATIONALE' WHEN e.user_id % 5 = 0 THEN 'EVIDENCE_NOT_ALLOWED' END AS code FROM n FULL JOIN orders o ON o.o_orderkey = n.id LEFT JOIN e ON e.id = n.id) WHERE code IS NOT NULL GROUP BY code""",
)
def evaluation_rules(t: Tables):
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "O", "source_grounded").when(F.col("o_orderstatus") == "F", "pedagogical_generation").otherwise("insufficient_source_evidence").alias("origin"), F.array(F.lit("a")).alias("allowed_ids"))
    e = t.events
    evaluations = e.select(
        (F.col("event_id") % 20000).alias("record_id"), F.when(F.col("event_type") == "error", "odd").otherwise("SUPPORTED").alias("semantic"), F.lit("NOT_APPLICABLE").alias("pedagogical"), F.lit("NOT_APPLICABLE").alias("abstention"), F.lit("LOW").alias("severity"), F.lit("HIGH").alias("confidence"),
        F.when(F.col("user_id") % 9 == 0, " ").otherwise("why").alias("rationale"), F.when(F.col("user_id") % 5 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("evidence_ids"),
    )
    return A.evaluation_problems(records, evaluations).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
