"""Retrieval queries."""

from pyspark.sql import functions as F

from quire.operators import retrieval as R
from quire.plans.registry import Tables, derive, query
from quire.plans.structure_queries import ranked

_COS = "list_cosine_similarity(CAST(n.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
derive("vectors", "SELECT vec_id, embedding, label FROM embeddings")
# one question per label: its first vector
derive(
    "asked",
    "SELECT min(vec_id) AS query_id, min_by(embedding, vec_id) AS embedding, label FROM embeddings GROUP BY label",
    "SELECT min(vec_id) AS query_id, arg_min(embedding, vec_id) AS embedding, label FROM embeddings GROUP BY label",
)


def _asked(t: Tables):
    return t.asked.select("query_id", F.col("embedding").alias("query_vector"), "label")


def _nodes(t: Tables):
    return t.vectors.select(F.col("vec_id").alias("node_id"), "embedding", "label")


@query(
    "vector_topk",
    f"""SELECT query_id, node_id, round(score + 1e-9, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT q.query_id, n.vec_id AS node_id, {_COS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round({_COS}, 12) DESC, n.vec_id) AS r FROM vectors n, asked q) WHERE r <= 5""",
)
def vector_topk(t: Tables):
    top = R.similarity_top_k(_nodes(t).drop("label"), _asked(t).drop("label"), 5)
    return top.select("query_id", "node_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "rank")


@query(
    "vector_topk_scoped",
    f"""SELECT query_id, node_id, round(score + 1e-9, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT q.query_id, n.vec_id AS node_id, {_COS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round({_COS}, 12) DESC, n.vec_id) AS r FROM vectors n JOIN asked q ON q.label = n.label) WHERE r <= 4""",
)
def vector_topk_scoped(t: Tables):
    top = R.similarity_top_k(_nodes(t), _asked(t), 4, ["label"])
    return top.select("query_id", "node_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "rank")


@query(
    "vector_topk_merged",
    f"""SELECT query_id, node_id, round(score + 1e-9, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT q.query_id, n.vec_id AS node_id, {_COS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round({_COS}, 12) DESC, n.vec_id) AS r
        FROM vectors n JOIN asked q ON n.label = q.label OR n.label = (q.label + 1) % 10) WHERE r <= 5""",
)
def vector_topk_merged(t: Tables):
    """One top-k per section of a two-section scope, merged."""
    asked = _asked(t)
    both = asked.unionByName(asked.withColumn("label", (F.col("label") + 1) % 10))
    parts = R.similarity_top_k(_nodes(t), both.withColumn("query_id", F.struct("query_id", "label")), 5, ["label"])
    top = R.merge_scoped(parts.withColumn("query_id", F.col("query_id.query_id")), 5)
    return top.select("query_id", "node_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "rank")


@query("metadata_filter", "SELECT id, doc, section FROM placed WHERE chapter_number = 3 AND content_type = 'en' AND NOT is_front_matter")
def metadata_filter(t: Tables):
    return R.metadata_filter(t.placed, chapter_number=3, content_type="en", is_front_matter=False).select("id", "doc", "section")


# sections of an outline: titles repeat now and then, levels 0-2
derive(
    "outline_sections",
    """SELECT source AS doc, CAST(doc_id % 3 AS INT) AS chapter_number, doc_id AS position, CASE WHEN doc_id % 37 = 0 THEN 'Repeated' WHEN doc_id % 11 = 0 THEN 'Use patterns ' || CAST(doc_id AS STRING) WHEN doc_id % 11 < 4 THEN 'Test part ' || CAST(doc_id AS STRING) ELSE 'Item ' || CAST(doc_id AS STRING) END AS section,
       CAST(n_chars % 3 AS INT) AS level FROM documents""",
)
derive(
    "scope_requests",
    """SELECT doc_id AS request_id, source AS doc, CASE WHEN doc_id % 29 = 0 THEN 'Nowhere' WHEN doc_id % 37 = 0 THEN 'Repeated' WHEN doc_id % 11 = 0 THEN 'Use patterns ' || CAST(doc_id AS STRING) WHEN doc_id % 11 < 4 THEN 'Test part ' || CAST(doc_id AS STRING) ELSE 'Item ' || CAST(doc_id AS STRING) END AS section,
       CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 3 AS INT) ELSE NULL END AS chapter_number, doc_id % 5 <> 0 AS include_descendants FROM documents""",
)
derive(
    "scopes",
    "SELECT 1 AS unused",
    """WITH mt AS (SELECT r.request_id, r.doc, r.include_descendants, o.chapter_number, o.position, o.section, o.level, count(*) OVER (PARTITION BY r.request_id) AS n
         FROM scope_requests r JOIN outline_sections o ON o.doc = r.doc AND o.section = r.section AND (r.chapter_number IS NULL OR o.chapter_number = r.chapter_number)),
       g AS (SELECT * FROM mt WHERE n = 1),
       l AS (SELECT g.request_id, min(CASE WHEN o.level <= g.level THEN o.position END) AS sl, min(CASE WHEN NOT contains(lower(g.section), 'patterns') OR o.level < g.level OR lower(split_part(o.section, ' ', 1)) NOT IN ('test', 'use') THEN o.position END) AS sf, min(o.position) AS nx
         FROM g JOIN outline_sections o ON o.doc = g.doc AND o.chapter_number = g.chapter_number AND o.position > g.position WHERE g.include_descendants GROUP BY g.request_id),
       b AS (SELECT g.*, CASE WHEN l.nx IS NULL THEN g.position + 1 WHEN coalesce(l.sl, 2147483647) > l.nx THEN coalesce(l.sl, 2147483647) ELSE coalesce(l.sf, 2147483647) END AS stop FROM g LEFT JOIN l USING (request_id))
       SELECT b.request_id, b.doc, b.chapter_number, o.section, min(o.position) AS position FROM b JOIN outline_sections o ON o.doc = b.doc AND o.chapter_number = b.chapter_number AND (o.position = b.position OR (b.include_descendants AND o.position > b.position AND o.position < b.stop)) GROUP BY b.request_id, b.doc, b.chapter_number, o.section""",
)


@query("section_scope", "SELECT request_id, chapter_number, section, position FROM scopes")
def section_scope(t: Tables):
    return R.section_scope(t.outline_sections, t.scope_requests)[0].select("request_id", "chapter_number", "section", "position")


@query(
    "section_scope_problems",
    """WITH mt AS (SELECT r.request_id, any_value(r.chapter_number) AS c, count(o.position) AS n, count(DISTINCT o.chapter_number) AS k FROM scope_requests r LEFT JOIN outline_sections o ON o.doc = r.doc AND o.section = r.section AND (r.chapter_number IS NULL OR o.chapter_number = r.chapter_number) GROUP BY r.request_id)
       SELECT request_id, CASE WHEN n = 0 THEN 'section_not_found' WHEN c IS NULL AND k > 1 THEN 'section_in_several_chapters' ELSE 'section_repeated' END AS code FROM mt WHERE n <> 1""",
)
def section_scope_problems(t: Tables):
    return R.section_scope(t.outline_sections, t.scope_requests)[1]


derive("retrieved", "SELECT doc_id AS request_id, source AS doc, CASE WHEN n_chars % 2 = 0 THEN 'Item ' ELSE 'Test part ' END || CAST(doc_id AS STRING) AS section FROM documents")


_COVERED = "j AS (SELECT s.request_id, s.section, s.position, r.section IS NOT NULL AS covered FROM scopes s LEFT JOIN (SELECT DISTINCT request_id, section FROM retrieved) r USING (request_id, section))"


def _coverage(t: Tables):
    titles, _ = R.section_scope(t.outline_sections, t.scope_requests)
    return R.section_coverage(titles, t.retrieved, ["request_id"])


@query(
    "scope_coverage",
    f"WITH {_COVERED} SELECT request_id, count(*) AS expanded_section_count, count(*) FILTER (WHERE covered) AS covered_section_count, count(*) FILTER (WHERE NOT covered) AS missing_section_count FROM j GROUP BY request_id",
)
def scope_coverage(t: Tables):
    return _coverage(t)[0]


@query("scope_coverage_titles", f"WITH {_COVERED} SELECT request_id, section, position, covered FROM j")
def scope_coverage_titles(t: Tables):
    return _coverage(t)[1]


@query(
    "document_order",
    """WITH o AS (SELECT doc, chapter_number, section, max(position) AS sp FROM (SELECT source AS doc, CAST(n_chars % 9 AS INT) AS chapter_number, 'Part ' || CAST(n_chars % 6 AS STRING) AS section, n_chars % 50 AS position FROM documents) GROUP BY doc, chapter_number, section)
       SELECT p.id, p.doc, o.sp AS section_position, p.chapter_number, CAST(row_number() OVER (PARTITION BY p.doc ORDER BY p.chapter_number NULLS LAST, o.sp NULLS LAST, p.page_start NULLS LAST, p.page_end NULLS LAST, p.id) AS BIGINT) AS rank FROM placed p LEFT JOIN o ON o.doc = p.doc AND o.chapter_number = p.chapter_number AND o.section = p.section""",
)
def document_order(t: Tables):
    outline = t.documents.select(
        F.col("source").alias("doc"), (F.col("n_chars") % 9).cast("int").alias("chapter_number"),
        F.concat(F.lit("Part "), (F.col("n_chars") % 6).cast("string")).alias("section"), (F.col("n_chars") % 50).alias("position"),
    )
    nodes = t.placed.drop("text").withColumn("node_id", F.col("id"))
    ordered = R.document_order(nodes, outline).orderBy(*R.order_columns())
    return ranked(ordered, ["doc"]).select("id", "doc", "section_position", "chapter_number", F.col("rank").cast("long").alias("rank"))


# citations with planted faults: unknown, repeated and blank
derive("lookups", "SELECT l_orderkey AS request_id, l_linenumber AS ord, 'o' || CAST(CASE WHEN l_partkey % 97 = 0 THEN l_orderkey + 90000000 WHEN l_linenumber > 5 THEN l_orderkey ELSE l_orderkey + l_linenumber END AS STRING) AS node_id FROM lineitem")
derive("lookup_chunks", "SELECT 'o' || CAST(o_orderkey AS STRING) AS node_id, CASE WHEN o_custkey % 31 = 0 THEN ' ' ELSE o_orderpriority END AS text FROM orders UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'again' FROM orders WHERE o_custkey % 53 = 0")


@query(
    "citation_integrity",
    """WITH c AS (SELECT node_id, count(*) AS n, bool_or(trim(text) = '') AS blank FROM lookup_chunks GROUP BY node_id), a AS (SELECT *, count(*) OVER (PARTITION BY request_id, node_id) AS asked FROM lookups)
       SELECT CASE WHEN asked > 1 THEN 'duplicate_request' WHEN n > 1 THEN 'duplicate_match' WHEN n IS NULL THEN 'missing' WHEN blank THEN 'blank_text' ELSE 'ok' END AS code, count(*) AS ids FROM a LEFT JOIN c USING (node_id) GROUP BY 1""",
)
def citation_integrity(t: Tables):
    found = R.lookup_by_id(t.lookups, t.lookup_chunks)
    return found.groupBy(F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("ids"))


derive("fallbacks", "SELECT user_id AS request_id, event_id AS rank, 'n' || CAST(event_id % 40 AS STRING) AS node_id, CASE WHEN event_id % 211 = 0 THEN 'other.pdf' ELSE 'book.pdf' END AS source_pdf, CASE WHEN event_id % 307 = 0 THEN '9' ELSE '3' END AS chapter_number FROM events")
derive("used_ids", "SELECT user_id AS request_id, 'n' || CAST(event_id % 40 AS STRING) AS node_id FROM events WHERE event_type = 'error'")


@query(
    "fallback_candidates",
    """WITH r AS (SELECT *, CASE WHEN source_pdf <> 'book.pdf' THEN 'wrong_document' WHEN chapter_number <> '3' THEN 'wrong_chapter' END AS code FROM fallbacks),
       g AS (SELECT request_id, node_id, min(rank) AS rank FROM r WHERE code IS NULL AND (request_id, node_id) NOT IN (SELECT request_id, node_id FROM used_ids) GROUP BY request_id, node_id),
       k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS p FROM g), t5 AS (SELECT * FROM k WHERE p <= 5), l AS (SELECT request_id, max(rank) AS last, count(*) AS n FROM t5 GROUP BY request_id),
       e AS (SELECT request_id, arg_min(node_id, rank) AS node_id, arg_min(code, rank) AS code FROM (SELECT r.* FROM r LEFT JOIN l USING (request_id) WHERE code IS NOT NULL AND (coalesce(n, 0) < 5 OR rank < last)) GROUP BY request_id)
       SELECT request_id, CAST(p AS INT) AS position, node_id, NULL AS code FROM t5 WHERE request_id NOT IN (SELECT request_id FROM e) UNION ALL SELECT request_id, 0, node_id, code FROM e""",
)
def fallback_candidates(t: Tables):
    expected = t.fallbacks.select("request_id").distinct().withColumn("want_pdf", F.lit("book.pdf")).withColumn("want_chapter", F.lit(3))
    return R.fallback_candidates(t.fallbacks, t.used_ids, expected)


# lessons: a question per label, its first vectors the lesson's chunks; some vectors stand in another document, some have no text
derive(
    "lesson_vectors",
    """SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place, CASE WHEN vec_id % 97 = 90 THEN 'b.pdf' ELSE 'a.pdf' END AS pdf FROM embeddings""",
)


@query(
    "fallback_retrieval",
    f"""WITH w AS (SELECT DISTINCT q.query_id, q.label, q.embedding, q.label % 5 = 3 AS odd FROM asked q), u AS (SELECT w.query_id, v.vec_id FROM lesson_vectors v JOIN w USING (label) WHERE v.place <= 3),
       c AS (SELECT * FROM (SELECT q.query_id, n.vec_id, n.pdf, {_COS} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round({_COS}, 12) DESC, n.vec_id) AS rank FROM lesson_vectors n JOIN w q ON q.label = n.label WHERE NOT q.odd) WHERE rank <= 10),
       k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM c WHERE pdf = 'a.pdf' AND (query_id, vec_id) NOT IN (SELECT query_id, vec_id FROM u)), t5 AS (SELECT * FROM k WHERE p <= 5), l AS (SELECT query_id, max(rank) AS last, count(*) AS n FROM t5 GROUP BY query_id),
       e AS (SELECT query_id, arg_min(vec_id, rank) AS vec_id FROM (SELECT c.* FROM c LEFT JOIN l USING (query_id) WHERE pdf <> 'a.pdf' AND (coalesce(n, 0) < 5 OR rank < last)) GROUP BY query_id)
       SELECT query_id AS request_id, CAST(p AS INT) AS position, CAST(vec_id AS STRING) AS node_id, round(score + 1e-9, 6) AS score, CASE WHEN vec_id % 37 = 5 THEN NULL WHEN vec_id % 31 = 4 THEN ' ' ELSE 'text ' || vec_id END AS text,
         CASE WHEN vec_id % 37 = 5 THEN 'missing' WHEN vec_id % 31 = 4 THEN 'blank_text' END AS code FROM t5 WHERE query_id NOT IN (SELECT query_id FROM e)
       UNION ALL SELECT query_id, 0, CAST(vec_id AS STRING), NULL, NULL, 'wrong_document' FROM e UNION ALL SELECT query_id, 0, NULL, NULL, NULL, 'no_single_document' FROM w WHERE odd""",
)
def fallback_retrieval(t: Tables):
    v, asked = t.lesson_vectors, _asked(t)
    requests = asked.select(F.col("query_id").alias("request_id"), "query_vector", F.col("label").cast("int").alias("resolved_chapter"), F.lit(None).cast("int").alias("filter_chapter"))
    own = v.filter("place <= 3").join(asked.select(F.col("query_id").alias("request_id"), "label"), "label")
    pdf = F.when((F.col("label") % 5 == 3) & (F.col("place") == 2), "b.pdf").otherwise("a.pdf")
    sources = own.select("request_id", F.lit("source").alias("place"), F.col("vec_id").alias("node_id"), pdf.alias("source_pdf"), F.col("label").alias("chapter_number"))
    nodes = v.select(F.col("vec_id").alias("node_id"), "embedding", F.col("pdf").alias("source_pdf"), F.col("label").alias("chapter_number"))
    i = F.col("vec_id")
    chunks = v.filter(i % 37 != 5).select(i.alias("node_id"), F.when(i % 31 == 4, " ").otherwise(F.concat(F.lit("text "), i.cast("string"))).alias("text"))
    found = R.fallback_retrieval(requests, sources, nodes, chunks)
    return found.select("request_id", "position", "node_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "text", "code")


@query(
    "scope_consistency",
    """WITH s AS (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'error' THEN 'b' ELSE 'a' END) AS pdfs, min(CASE WHEN value < 480 THEN 3 ELSE 4 END) AS lo, max(CASE WHEN value < 480 THEN 3 ELSE 4 END) AS hi FROM (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN event_type ELSE 'x' END AS event_type, value FROM events) GROUP BY user_id)
       SELECT user_id AS lesson_id, CASE WHEN pdfs <> 1 THEN 'no_single_document' WHEN lo <> hi THEN 'several_chapters' WHEN user_id % 5 = 0 AND lo <> 4 THEN 'chapter_conflict' END AS code FROM s""",
)
def scope_consistency(t: Tables):
    rows = t.events.select(
        F.col("user_id").alias("lesson_id"), F.lit("source").alias("place"),
        F.when((F.col("user_id") % 7 == 0) & (F.col("event_type") == "error"), "b").otherwise("a").alias("source_pdf"),
        F.when(F.col("value") < 480, 3).otherwise(4).alias("chapter_number"),
    )
    lessons = rows.select("lesson_id").distinct().select(
        "lesson_id", F.when(F.col("lesson_id") % 5 == 0, 4).alias("resolved_chapter"), F.lit(None).cast("int").alias("filter_chapter")
    )
    return R.scope_consistency(rows, lessons).select("lesson_id", "code")


@query(
    "context_pack",
    r"""WITH h AS (SELECT *, len('CHUNK ID: ' || id || chr(10) || 'Chapter: ' || coalesce(chapter, 'None') || chr(10) || 'Chapter number: ' || coalesce(CAST(chapter_number AS STRING), 'None') || chr(10) || 'Section: ' || coalesce(section, 'None') || chr(10) || 'Topic: ' || 'None' || chr(10) || 'Pages: ' || coalesce(CAST(page_start AS STRING), 'None') || '-' || CAST(page_end AS STRING) || chr(10) || 'Text:' || chr(10)) AS hl, trim(text, ' ' || chr(10)) AS s FROM placed),
       u AS (SELECT *, coalesce(sum(hl + len(s) + 4) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h)
       SELECT id, hl + 4 + len(CASE WHEN len(s) > 6000 - used - hl - 8 THEN rtrim(substr(s, 1, CAST(6000 - used - hl - 8 AS BIGINT)), ' ' || chr(10)) ELSE s END) AS chars FROM u WHERE 6000 - used - hl - 8 > 200 AND used < 6000""",
)
def context_pack(t: Tables):
    chunks = t.placed.withColumn("node_id", F.col("id")).withColumn("topic", F.lit(None).cast("string"))
    return R.pack_context(chunks, ["doc"], ["ord"], 6000).select("id", F.length("block").cast("long").alias("chars"))


@query("chapter_blocks", "SELECT id, CAST(r AS INT) AS rank, len(substr(text, 1, 500)) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc, chapter_number ORDER BY ord) AS r FROM placed) WHERE r <= 3")
def chapter_blocks(t: Tables):
    return R.first_n_with_cap(t.placed, ["doc", "chapter_number"], [F.asc("ord")], 3, 500).select("id", "rank", F.length("text").cast("long").alias("chars"))


@query("first_lines", r"SELECT line, min(ord * 1000 + line_no) AS place FROM structured_lines GROUP BY line")
def first_lines(t: Tables):
    from quire.operators.lines import line_table

    lines = line_table(t.structured, keep=["ord"]).withColumn("place", F.col("ord") * 1000 + F.col("line_no"))
    return R.dedupe_first(lines.select("line", "place"), "line", ["place"])


@query(
    "referenced_rows",
    """WITH s AS (SELECT node_id, count(*) AS n, bool_or(trim(text) = '') AS blank FROM lookup_chunks GROUP BY node_id), w AS (SELECT DISTINCT node_id FROM lookups)
       SELECT code, severity, count(*) AS ids FROM (SELECT CASE WHEN w.node_id IS NOT NULL AND n IS NULL THEN 'missing_referenced' WHEN w.node_id IS NOT NULL AND n > 1 THEN 'duplicate_referenced' WHEN w.node_id IS NOT NULL AND blank THEN 'blank_referenced' WHEN w.node_id IS NULL AND blank THEN 'blank_unreferenced' END AS code,
         CASE WHEN w.node_id IS NOT NULL THEN 'error' ELSE 'warning' END AS severity FROM s FULL JOIN w ON s.node_id = w.node_id) WHERE code IS NOT NULL GROUP BY code, severity
       UNION ALL SELECT 'kept', 'ok', count(*) FROM lookup_chunks WHERE node_id IN (SELECT node_id FROM w)""",
)
def referenced_rows(t: Tables):
    kept, findings = R.referenced_rows(t.lookup_chunks, t.lookups)
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("ids")).unionByName(
        kept.agg(F.count(F.lit(1)).alias("ids")).select(F.lit("kept").alias("code"), F.lit("ok").alias("severity"), "ids")
    )


_SHORT = r"""CASE WHEN len(trim(regexp_replace({c}, '[ \n]+', ' ', 'g'))) <= {n} THEN trim(regexp_replace({c}, '[ \n]+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace({c}, '[ \n]+', ' ', 'g')), 1, {n} - 3)) || '...' END"""


@query(
    "compact_chapters",
    rf"""WITH r AS (SELECT source AS book, doc_id AS chapter_number, to_json({{'chapter_number': doc_id, 'chapter_title': lang, 'chapter_summary': {_SHORT.format(c='text', n=800)},
           'key_terms': list_transform(string_split(text, chr(10))[1:8], lambda l: {{'term': l, 'meaning': {_SHORT.format(c='l', n=160)}}}), 'source_chunk_ids': [CAST(doc_id AS STRING)]}}) AS line FROM documents),
       s AS (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY book ORDER BY chapter_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r)
       SELECT book, chapter_number, substr(CAST(line AS VARCHAR), 1, CAST(5000 - used AS BIGINT)) AS line FROM s WHERE used < 5000""",
)
def compact_chapters(t: Tables):
    """Lines of a text as its key terms; the operator keeps eight and cuts a book to its budget."""
    rows = t.documents.select(
        F.col("source").alias("book"), F.col("doc_id").alias("chapter_number"), F.col("lang").alias("chapter_title"), F.col("text").alias("chapter_summary"),
        F.transform(F.split("text", "\n"), lambda l: F.struct(l.alias("term"), l.alias("meaning"))).alias("key_terms"), F.array(F.col("doc_id").cast("string")).alias("source_chunk_ids"),
    )
    return R.compact_chapters(rows, ["book"], 5000).select("book", "chapter_number", "line")
