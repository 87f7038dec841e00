"""Concept, bank, package and store queries."""

from pyspark.sql import functions as F

from quire.functions import json_tree
from quire.operators import concepts as C
from quire.operators import contract as K
from quire.operators import packages as P
from quire.plans.registry import Tables, derive, query
from quire.sources import store as S
from quire.sources.scratch import written

_STOP = "[" + ", ".join(f"'{w}'" for w in C.EVERYDAY_WORDS) + "]"
_STEM1 = """CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN substr(w, 1, len(w) - 3) || 'y' WHEN w LIKE '%es' AND len(w) > 4 AND NOT w LIKE '%ses' THEN substr(w, 1, len(w) - 2)
    WHEN w LIKE '%s' AND NOT w LIKE '%ss' AND len(w) > 3 THEN substr(w, 1, len(w) - 1) ELSE w END"""


def vocab_sql(source: str, keys: str, text: str) -> str:
    """Distinct stemmed words per row, one row per word."""
    return rf"""SELECT DISTINCT {keys}, w3 AS word FROM (SELECT *, CASE WHEN w2 LIKE '%e' AND len(w2) > 3 THEN substr(w2, 1, len(w2) - 1) ELSE w2 END AS w3 FROM (
        SELECT *, CASE WHEN w1 LIKE '%ing' AND len(w1) > 5 THEN substr(w1, 1, len(w1) - 3) ELSE w1 END AS w2 FROM (SELECT *, {_STEM1} AS w1 FROM (
          SELECT {keys}, unnest(regexp_extract_all(regexp_replace(lower({text}), '\$[^$]*\$', ' ', 'g'), '[a-z]{{3,}}')) AS w FROM {source}) WHERE NOT list_contains({_STOP}, w)))) WHERE NOT list_contains({_STOP}, w3)"""


derive("goals", "SELECT doc_id * 100000 + i AS sentence_id, source AS book, l AS goal FROM text_rows")
derive("bank_skills", "SELECT 'k' || CAST(item_id AS STRING) AS key, item_id, text FROM benchmark")
derive("goal_words", "SELECT 1 AS unused", vocab_sql("goals", "sentence_id", "goal"))
derive("skill_words", "SELECT 1 AS unused", vocab_sql("bank_skills", "key", "text"))
derive(
    "goal_matches",
    "SELECT 1 AS unused",
    """WITH sp AS (SELECT word, count(*) AS n FROM skill_words GROUP BY word), sn AS (SELECT sentence_id, count(*) AS c FROM goal_words GROUP BY sentence_id), cn AS (SELECT key, count(*) AS c FROM skill_words GROUP BY key),
       j AS (SELECT g.sentence_id, s.key, sum(1.0 / sp.n) AS score, count(*) AS shared, string_agg(g.word, ' ' ORDER BY g.word) AS matched_on FROM goal_words g JOIN skill_words s USING (word) JOIN sp USING (word) GROUP BY g.sentence_id, s.key)
       SELECT sentence_id, key, round(score, 6) AS score, matched_on, round(shared * 1.0 / sn.c, 6) AS of_sentence, round(shared * 1.0 / cn.c, 6) AS of_candidate FROM j JOIN sn USING (sentence_id) JOIN cn USING (key) WHERE round(score, 6) >= 1.0""",
)


def _matching(t: Tables):
    sentences = t.goals.select("sentence_id", C.vocabulary("goal").alias("vocab"))
    skills = t.bank_skills.select("key", C.vocabulary("text").alias("vocab"))
    return sentences, skills, C.match_concepts(sentences, skills)


@query("token_vocabulary", "SELECT sentence_id, string_agg(word, ' ' ORDER BY word) AS words FROM goal_words GROUP BY sentence_id")
def token_vocabulary(t: Tables):
    v = t.goals.select("sentence_id", F.array_sort(C.vocabulary("goal")).alias("v")).filter(F.size("v") > 0)
    return v.select("sentence_id", F.array_join("v", " ").alias("words"))


@query("concept_match", "SELECT sentence_id, key, score, matched_on, of_sentence, of_candidate FROM goal_matches")
def concept_match(t: Tables):
    return _matching(t)[2].withColumn("matched_on", F.array_join("matched_on", " "))


_ASSIGN = """WITH b AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY score DESC, of_sentence DESC, of_candidate DESC) AS r FROM goal_matches), t AS (SELECT key, count(*) AS ties, min(sentence_id) AS s FROM b WHERE r = 1 GROUP BY key),
       a AS (SELECT k.key, CASE WHEN ties = 1 THEN s END AS sentence_id, coalesce(ties, 0) AS ties FROM bank_skills k LEFT JOIN t USING (key))"""


@query("concept_assign", f"{_ASSIGN} SELECT key, sentence_id, ties FROM a")
def concept_assign(t: Tables):
    _, skills, matches = _matching(t)
    return C.assign_concepts(skills, matches.withColumn("ord", F.col("sentence_id"))).select("key", "sentence_id", "ties")


@query(
    "concept_proposals",
    f"""{_ASSIGN}, o AS (SELECT a.sentence_id, a.key, m.score, m.of_candidate, rank() OVER (PARTITION BY a.sentence_id ORDER BY m.score DESC, m.of_candidate DESC) AS r, count(*) OVER (PARTITION BY a.sentence_id) AS offered FROM a JOIN goal_matches m ON m.sentence_id = a.sentence_id AND m.key = a.key),
       p AS (SELECT sentence_id, any_value(offered) AS offered, count(*) AS n, min(key) AS key FROM o WHERE r = 1 GROUP BY sentence_id)
       SELECT g.sentence_id, CASE WHEN n = 1 THEN key END AS bank, coalesce(offered, 0) AS offered, (n = 1) IS TRUE OR g.sentence_id % 2 = 0 AS assessed, CASE WHEN n = 1 THEN 'whole_number' END AS required_form FROM goals g LEFT JOIN p USING (sentence_id)""",
)
def concept_proposals(t: Tables):
    _, skills, matches = _matching(t)
    matches = written(matches.drop("matched_on"), "matches")  # found once, for assignments and proposals alike
    assigned = C.assign_concepts(skills, matches.withColumn("ord", F.col("sentence_id")))
    forms = C.required_form(t.bank_skills.select(F.col("key").alias("skill"), F.lit("number").alias("answer_kind"), F.lit(1).alias("answer_den"), F.lit(True).alias("answer_is_reduced")))
    checklist = t.goals.filter(F.col("sentence_id") % 2 == 0).select("sentence_id")
    p = C.concept_proposals(t.goals.select("sentence_id", "goal"), assigned, matches, checklist, forms.withColumnRenamed("skill", "key"))
    return p.drop("goal")


@query(
    "review_coverage",
    f"""WITH gw AS (SELECT g.sentence_id, g.book, w.word FROM goals g JOIN goal_words w USING (sentence_id)), c AS (SELECT key, min(score) AS lo FROM goal_matches GROUP BY key)
       SELECT key, count(*) AS sentences, max(score) AS best FROM goal_matches GROUP BY key""",
)
def review_coverage(t: Tables):
    sentences, skills, _ = _matching(t)
    return C.review_coverage(sentences, skills)


derive("turn_words", "SELECT 1 AS unused", vocab_sql("(SELECT conv_id, turn, text FROM conversations)", "conv_id, turn", "text"))


@query(
    "common_words",
    "WITH n AS (SELECT conv_id, count(*) AS texts FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, word, count(*) AS n FROM turn_words GROUP BY conv_id, word) SELECT conv_id, word, w.n AS n, texts FROM w JOIN n USING (conv_id) WHERE w.n >= texts * 0.5",
)
def common_words(t: Tables):
    return C.common_words(t.conversations, "conv_id")


@query(
    "required_forms",
    """SELECT c_nationkey AS skill, count(*) AS exercises, CASE WHEN bool_and(c_custkey % 4 <> 0) THEN 'simplest_fraction' END AS required_form FROM customer GROUP BY c_nationkey""",
)
def required_forms(t: Tables):
    items = t.customer.select(F.col("c_nationkey").alias("skill"), F.lit("number").alias("answer_kind"), (F.col("c_custkey") % 4 + 1).alias("answer_den"), F.lit(True).alias("answer_is_reduced"))
    return C.required_form(items)


derive("term_rows", "SELECT source AS book, doc_id * 100000 + i AS ord, l || '  ' AS term, l AS meaning, CAST(doc_id % 9 AS INT) AS chapter_number, lang FROM text_rows")


_TERMS = r"""k AS (SELECT *, trim(regexp_replace(term, '[ \n]+', ' ', 'g')) AS tt FROM term_rows), g AS (SELECT book, lower(tt) AS f, count(*) AS n, min(ord) AS seen, arg_min(tt, ord) AS term FROM k WHERE tt <> '' GROUP BY book, lower(tt)),
       r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, seen) AS rk FROM g)"""


def _terms(t: Tables):
    return C.key_terms(t.term_rows.withColumn("source_chunk_ids", F.array("lang")), ["book"], ["ord"])


@query("key_terms", f"WITH {_TERMS} SELECT book, CAST(rk AS INT) AS rank, term, n FROM r WHERE rk <= 30")
def key_terms(t: Tables):
    return _terms(t)[0].drop("meaning")


@query(
    "key_term_sources",
    f"""WITH {_TERMS}, j AS (SELECT k.*, r.rk FROM k JOIN r ON r.book = k.book AND r.f = lower(k.tt) WHERE r.rk <= 30)
       SELECT book, CAST(rk AS INT) AS rank, 'chapter' AS kind, CAST(chapter_number AS STRING) AS value, min(ord) AS first_ord FROM j GROUP BY book, rk, chapter_number UNION ALL SELECT book, CAST(rk AS INT), 'source_chunk_id', lang, min(ord) FROM j GROUP BY book, rk, lang""",
)
def key_term_sources(t: Tables):
    return _terms(t)[1].withColumn("first_ord", F.col("first_place.ord")).drop("first_place")


@query(
    "study_plan",
    """WITH n AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
       SELECT n_regionkey, CAST((r - 1) // CASE WHEN c <= 4 THEN 1 ELSE 2 END + 1 AS INT) AS week, string_agg(n_name, ' and ' ORDER BY n_nationkey) AS focus FROM n GROUP BY 1, 2""",
)
def study_plan(t: Tables):
    planned = C.study_plan(t.nation, ["n_regionkey"], "n_nationkey")
    return C.study_weeks(planned, ["n_regionkey"], "n_nationkey", "n_name").drop("chapters")


@query("lesson_items", "SELECT p_partkey FROM part WHERE p_size % 10 = 0 OR p_size % 10 IN (1, 2, 3)")
def lesson_items(t: Tables):
    items = t.part.withColumn("chapter", F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 10))
    return C.lesson_items(items, 4).select("p_partkey")


@query("lesson_chapter_map", "SELECT n_nationkey AS lesson, CAST(unnest(CASE n_nationkey WHEN 4 THEN [1, 2, 3] WHEN 8 THEN [1, 2, 3, 5, 6, 7] WHEN 9 THEN [1, 2, 3, 5, 6, 7] ELSE [n_nationkey] END) AS INT) AS chapter FROM nation")
def lesson_chapter_map(t: Tables):
    return C.lesson_chapters(t.nation.select(F.col("n_nationkey").alias("lesson")))


@query(
    "uncovered_skills",
    """SELECT p_brand AS skill, count(*) AS exercises_in_bank, arg_min(p_name, p_partkey) AS sample_question, coalesce('passed over for ' || min(p_name) FILTER (WHERE p_size = 49), 'no learning goal in this chapter''s enrichment matched it') AS why FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 50 AND p_type = 'ECONOMY') GROUP BY p_brand""",
)
def uncovered_skills(t: Tables):
    items = t.part.select(F.col("p_brand").alias("skill"), F.col("p_name").alias("prompt"), F.col("p_partkey").alias("ord"))
    declared = t.part.filter((F.col("p_size") == 50) & (F.col("p_type") == "ECONOMY")).select(F.col("p_brand").alias("skill"))
    reasons = t.part.filter("p_size = 49").groupBy(F.col("p_brand").alias("skill")).agg(F.concat(F.lit("passed over for "), F.min("p_name")).alias("reason"))
    return C.uncovered_skills(items, declared, reasons)


@query("work_queue", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def work_queue(t: Tables):
    done = t.orders.filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return C.work_queue(t.customer, done, ["c_custkey"]).select("c_custkey")


# -- packages: an order is a package, its lines are elements ----------------------------------------------
@query(
    "exercise_bank",
    """WITH b AS (SELECT p_brand, count(*) AS n, min(p_size % 5) AS lo, max(p_size % 5) AS hi FROM part GROUP BY p_brand), c AS (SELECT s_suppkey, 'Brand#' || CAST(s_suppkey % 30 AS STRING) AS skill FROM supplier)
       SELECT s_suppkey AS concept_key, CASE WHEN n IS NULL THEN 'no_questions' ELSE 'wrong_chapter' END AS code FROM c LEFT JOIN b ON p_brand = skill WHERE n IS NULL OR lo <> 0 OR hi <> 0""",
)
def exercise_bank(t: Tables):
    concepts = t.supplier.select(F.col("s_suppkey").alias("concept_key"), F.lit(0).alias("chapter_number"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("skill"))
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("skill"), (F.col("p_size") % 5).alias("chapter"))
    return P.exercise_bank(concepts, items)[1].select("concept_key", "code")


@query(
    "exercise_bank_items",
    """SELECT s_suppkey AS concept_key, p_partkey AS id, 'Brand#' || CAST(s_suppkey % 30 AS STRING) AS skill FROM supplier JOIN part ON p_brand = 'Brand#' || CAST(s_suppkey % 30 AS STRING) WHERE ascii(right(p_brand, 1)) % 2 = s_suppkey % 4""",
)
def exercise_bank_items(t: Tables):
    """The bank itself: all questions of a skill lie in one chapter, which is that of some of its concepts."""
    concepts = t.supplier.select(F.col("s_suppkey").alias("concept_key"), (F.col("s_suppkey") % 4).alias("chapter_number"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("skill"))
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("skill"), (F.ascii(F.right("p_brand", F.lit(1))) % 2).alias("chapter"))
    return P.exercise_bank(concepts, items)[0].select("concept_key", "id", "skill")


derive("blocks_before", "SELECT l_orderkey AS package_id, 's' || l_returnflag AS section, CAST(l_partkey AS STRING) AS content, CAST(l_linenumber AS STRING) AS key FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'")
derive("blocks_after", "SELECT l_orderkey AS package_id, 's' || l_returnflag AS section, CAST(l_partkey AS STRING) AS content, CAST(l_linenumber AS STRING) AS key FROM lineitem WHERE l_quantity > 5")


@query(
    "additive_diff",
    """WITH b AS (SELECT DISTINCT package_id, section, content FROM blocks_before), a AS (SELECT DISTINCT package_id, section, content FROM blocks_after)
       SELECT package_id, 'added' AS change, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY package_id UNION ALL SELECT package_id, 'removed', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY package_id""",
)
def additive_diff(t: Tables):
    diff = P.additive_diff(P.block_elements(t.blocks_before), P.block_elements(t.blocks_after))
    return diff.groupBy("package_id", "change").agg(F.count(F.lit(1)).alias("n"))


@query(
    "additive_verdict",
    """WITH b AS (SELECT DISTINCT package_id, section, content FROM blocks_before), a AS (SELECT DISTINCT package_id, section, content FROM blocks_after), r AS (SELECT package_id, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY package_id)
       SELECT o_orderkey AS package_id, CASE WHEN o_orderstatus = 'P' THEN 'schema_changed' WHEN o_custkey % 10 = 0 THEN 'other_lesson' WHEN coalesce(n, 0) > 0 THEN 'removed_content' ELSE 'additive' END AS verdict FROM orders LEFT JOIN r ON package_id = o_orderkey""",
)
def additive_verdict(t: Tables):
    diff = P.additive_diff(P.block_elements(t.blocks_before), P.block_elements(t.blocks_after))
    heads = t.orders.select(
        F.col("o_orderkey").alias("package_id"), F.lit("v1").alias("old_schema"), F.when(F.col("o_orderstatus") == "P", "v2").otherwise("v1").alias("new_schema"),
        F.lit("x").alias("old_lesson"), F.when(F.col("o_custkey") % 10 == 0, "y").otherwise("x").alias("new_lesson"),
    )
    return P.additive_verdict(heads, diff).select("package_id", "verdict")


derive("edges", "SELECT l_returnflag AS package_id, l_orderkey * 10 + l_linenumber AS i, 'k' || CAST(l_partkey AS STRING) AS source, 'k' || CAST(l_suppkey AS STRING) AS target, CASE WHEN l_linenumber = 3 THEN 'likes' ELSE 'requires' END AS kind FROM lineitem")
derive("nodes_of", "SELECT f AS package_id, 'k' || CAST(p_partkey AS STRING) AS stable_key, p_partkey AS i FROM part, (SELECT DISTINCT l_returnflag AS f FROM lineitem) x WHERE p_size <> 9")


@query(
    "association_integrity",
    """WITH k AS (SELECT package_id, stable_key FROM nodes_of), r AS (SELECT *, min(i) OVER (PARTITION BY package_id, source, target, kind) AS f FROM edges)
       SELECT code, count(*) AS n FROM (SELECT 'UNKNOWN_END' AS code FROM r LEFT JOIN k ON k.package_id = r.package_id AND k.stable_key = r.source WHERE k.stable_key IS NULL UNION ALL SELECT 'UNKNOWN_END' FROM r LEFT JOIN k ON k.package_id = r.package_id AND k.stable_key = r.target WHERE k.stable_key IS NULL
         UNION ALL SELECT 'UNKNOWN_TYPE' FROM r WHERE kind = 'likes' UNION ALL SELECT 'SELF_EDGE' FROM r WHERE source = target UNION ALL SELECT 'REPEATED_EDGE' FROM r WHERE i > f) GROUP BY code""",
)
def association_integrity(t: Tables):
    return P.association_problems(t.edges, t.nodes_of).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("key_integrity", "SELECT package_id, code, count(*) AS n FROM (SELECT l_returnflag AS package_id, CASE WHEN l_partkey % 40 = 0 THEN 'NO_KEY' WHEN row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY l_orderkey * 10 + l_linenumber) > 1 AND min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_returnflag, l_partkey) < l_orderkey * 10 + l_linenumber THEN 'REPEATED_KEY' END AS code FROM lineitem) WHERE code IS NOT NULL GROUP BY package_id, code")
def key_integrity(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("package_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.when(F.col("l_partkey") % 40 != 0, F.col("l_partkey").cast("string")).alias("stable_key"))
    return P.key_problems(rows, "resources").groupBy("package_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "link_integrity",
    """SELECT code, count(*) AS n FROM (SELECT 'UNKNOWN_RESOURCE' AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'MISSING_FIELD' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'WRONG_LESSON' FROM orders WHERE o_orderkey % 6 = 1
         UNION ALL SELECT 'UNLINKED_RESOURCE' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders)) GROUP BY code""",
)
def link_integrity(t: Tables):
    links = t.orders.select(
        F.lit("p").alias("package_id"), F.col("o_orderkey").alias("i"), F.col("o_custkey").cast("string").alias("resource_key"), F.lit("lesson").alias("scope"), F.when(F.col("o_orderkey") % 6 == 1, "other").otherwise("this").alias("lesson_stable_key"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("help").alias("role"), F.lit("always").alias("availability"), F.lit("all").alias("phase_visibility"), F.lit("none").alias("assistance_effect"), F.lit(None).cast("string").alias("evidence_classification"),
    )
    resources = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.lit("p").alias("package_id"), F.col("c_custkey").cast("string").alias("stable_key"))
    lessons = resources.select("package_id").distinct().withColumn("lesson_key", F.lit("this"))
    return P.link_problems(links, resources, lessons).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "asset_integrity",
    """SELECT code, count(*) AS n FROM (SELECT 'MISSING_FIELD' AS code FROM part WHERE p_size = 3 UNION ALL SELECT 'ILLUSTRATES_NOTHING' FROM part WHERE p_partkey % 1000 NOT IN (SELECT s_suppkey FROM supplier)) GROUP BY code""",
)
def asset_integrity(t: Tables):
    assets = t.part.select(
        F.lit("p").alias("package_id"), F.col("p_partkey").alias("i"), F.col("p_partkey").cast("string").alias("stable_key"), F.lit("image/svg").alias("media_type"), F.lit("inline").alias("encoding"), F.when(F.col("p_size") == 3, " ").otherwise("alt").alias("alt_text"),
        F.col("p_name").alias("caption"), (F.col("p_partkey") % 1000).cast("string").alias("illustrates"),
    )
    addressable = t.supplier.select(F.lit("p").alias("package_id"), F.col("s_suppkey").cast("string").alias("key"))
    return P.asset_problems(assets, addressable).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_rules",
    """SELECT code, count(*) AS n FROM (SELECT 'MISSING' AS code FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'UNAPPROVED' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'EMPTY' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)
         UNION ALL SELECT 'UNDECLARED_CONCEPT' FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'UNDECLARED_CONCEPT' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)) GROUP BY code""",
)
def manifest_rules(t: Tables):
    s = t.supplier
    text = lambda v: F.lit(v)
    m = s.select(F.col("s_suppkey").alias("manifest_id"), text("k").alias("stable_key"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise("t").alias("title"), text("d").alias("domain"), text("g").alias("generator_version"), text("f").alias("framework_key"), text("f").alias("framework_title"), (F.col("s_suppkey") % 5 != 0).alias("approved"))
    rich = t.customer.filter(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    concepts = s.join(rich, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("manifest_id"), F.lit(0).alias("i"), text("c0").alias("stable_key"), text("s").alias("statement"), text("skill").alias("objective_type"))
    alignments = s.select(F.col("s_suppkey").alias("manifest_id"), F.lit(0).alias("i"), F.when(F.col("s_suppkey") % 3 == 0, "cx").otherwise("c0").alias("objective_stable_key"), text("primary").alias("alignment_role"))
    resources = s.select(F.col("s_suppkey").alias("manifest_id"), F.lit(0).alias("i"), text("r").alias("stable_key"), F.lit(1).alias("elements"))
    assets = resources.select("manifest_id", "i", *[text("x").alias(c) for c in ("stable_key", "media_type", "alt_text", "caption", "illustrates", "provenance")])
    return K.manifest_problems(m, concepts, alignments, resources, assets).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("element_paths", "SELECT l_orderkey AS manifest_id, 'lines.' || CAST(l_linenumber + 1 AS STRING) AS path FROM lineitem WHERE (l_orderkey, l_linenumber + 1) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem)")
def element_paths(t: Tables):
    leaf = lambda add: t.lineitem.select(F.col("l_orderkey").alias("manifest_id"), F.concat(F.lit("lines."), (F.col("l_linenumber") + add).cast("string")).alias("path"))
    return K.unresolved_elements(leaf(1), leaf(0))


# the same packages with keys in reverse and with keys in order
derive(
    "packages_json",
    """SELECT doc_id, concat('{"title" : ', to_json(named_struct('x', lang)), ', "content_hash": "old", "blocks":[ ', array_join(transform(split(text, chr(10)), (l, i) -> to_json(named_struct('text', l, 'position', i, 'more', named_struct('z', null, 'a', array(n_chars, doc_id))), map('ignoreNullFields', 'false'))), ' , '),
       ' ],"a\\\\"key":', CAST(doc_id AS STRING), ', "A": true}') AS json FROM documents""",
    """SELECT doc_id, '{"A":true,"a\\"key":' || doc_id || ',"blocks":[' || array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: '{"more":{"a":[' || n_chars || ',' || doc_id || '],"z":null},"position":' || (i - 1) || ',"text":' || to_json(l) || '}'), ',') || '],"title":{"x":' || to_json(lang) || '}}' AS json FROM documents""",
)


@query("package_digests", "SELECT doc_id, sha256(json) AS digest FROM packages_json")
def package_digests(t: Tables):
    return t.packages_json.select("doc_id", json_tree.canonical_digest("json", ["content_hash"]).alias("digest"))


@query("content_fingerprints", "SELECT count(DISTINCT (p_name, p_brand, p_type, p_size)) AS prints FROM part")
def content_fingerprints(t: Tables):
    return t.part.select(P.content_hash(["p_name", "p_brand", "p_type", "p_size"]).alias("h")).agg(F.count_distinct("h").alias("prints"))


@query(
    "append_only_merge",
    """WITH s AS (SELECT DISTINCT source, lower(lang) AS f FROM documents WHERE n_chars > 400), i AS (SELECT source, lower(trim(regexp_replace(l, '[ \\n]+', ' ', 'g'))) AS f, arg_min(l, doc_id * 100000 + i) AS name, min(doc_id * 100000 + i) AS ord FROM text_rows GROUP BY source, f)
       SELECT source, name, ord, true AS added FROM i WHERE (source, f) NOT IN (SELECT source, f FROM s) UNION ALL SELECT source, lang, doc_id, false FROM documents WHERE n_chars > 400""",
)
def append_only_merge(t: Tables):
    """The merged rows: stored names and, behind them, the new lines."""
    stored = t.documents.filter(F.col("n_chars") > 400).select("source", F.col("lang").alias("name"), F.col("doc_id").alias("ord"))
    incoming = t.text_rows.select("source", F.col("l").alias("name"), (F.col("doc_id") * 100000 + F.col("i")).alias("ord"))
    return P.append_only_merge(stored, incoming, ["source"], "name", "ord")[0].select("source", "name", "ord", "added")


@query(
    "append_only_report",
    """WITH s AS (SELECT DISTINCT source, lower(lang) AS f FROM documents WHERE n_chars > 400), i AS (SELECT DISTINCT source, CASE WHEN source IN (SELECT min(source) FROM documents) THEN lower(lang) ELSE lower(trim(regexp_replace(l, '[ \\n]+', ' ', 'g'))) END AS f FROM text_rows),
       n AS (SELECT source, count(*) AS added FROM i WHERE (source, f) NOT IN (SELECT source, f FROM s) GROUP BY source)
       SELECT b.source, coalesce(n.added, 0) AS added, n.added IS NULL AS refused FROM (SELECT DISTINCT source FROM documents) b LEFT JOIN n USING (source)""",
)
def append_only_report(t: Tables):
    """Added names a source; the first source offers its languages again."""
    stored = t.documents.filter(F.col("n_chars") > 400).select("source", F.col("lang").alias("name"), F.col("doc_id").alias("ord"))
    first = t.documents.agg(F.min("source").alias("__first"))
    rows = t.text_rows.join(F.broadcast(first), F.col("source") == F.col("__first"), "left")  # one row
    incoming = rows.select("source", F.when(F.col("__first").isNotNull(), F.col("lang")).otherwise(F.col("l")).alias("name"), (F.col("doc_id") * 100000 + F.col("i")).alias("ord"))
    return P.append_only_merge(stored, incoming, ["source"], "name", "ord")[1]


@query("catalog_counts", "SELECT source AS book_slug, count(*) AS chapters, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS enriched FROM documents GROUP BY source")
def catalog_counts(t: Tables):
    chapters = t.documents.select(F.col("source").alias("book_slug"), F.col("doc_id").alias("chapter_number"))
    enriched = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("book_slug"), F.col("doc_id").alias("chapter_number"))
    counts, index = P.catalog(chapters, enriched)
    return counts.join(index.groupBy("book_slug").agg(F.count_if("has_enrichment").alias("enriched")), "book_slug")


derive("teaching_docs", "SELECT doc_id, text, lang, n_chars FROM documents")


_BLOCKS = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM teaching_docs WHERE n_chars % 10 <> 0),
       b AS (SELECT doc_id, 0 AS s, 0 AS i, 'core_method' AS section, 'method' AS type, 'core_method' AS key, 'x' AS content FROM d UNION ALL SELECT doc_id, 1, 0, 'overview', 'overview', 'overview', 'x' FROM d UNION ALL SELECT doc_id, 2, 0, 'learning_goals', 'goals', 'learning_goals', 'x' FROM d
         UNION ALL SELECT doc_id, 3, u.i, 'techniques', 'concept_explanation', 'techniques.' || u.i, l[u.i + 1] FROM d, UNNEST(range(len(l))) AS u(i) UNION ALL SELECT doc_id, 4, 0, 'worked_examples', 'worked_example', 'worked_examples.0', 'a' FROM d
         UNION ALL SELECT doc_id, 6, 0, 'common_mistakes', 'common_mistake', 'common_mistakes.0', 'a' FROM d UNION ALL SELECT doc_id, 7, 0, 'practice_plan', 'practice_plan', 'practice_plan', 'x' FROM d UNION ALL SELECT doc_id, 8, 0, 'mastery_checklist', 'checklist', 'mastery_checklist', 'x' FROM d
         UNION ALL SELECT doc_id, 9, 0, 'strategy_notes', 'strategy_notes', 'strategy_notes', 'x' FROM d)"""


def _sections(t: Tables):
    """Lines of a text as its techniques; some documents lack their goals and are refused."""
    d = t.teaching_docs
    lines = F.split("text", "\n")
    none = F.lit(None).cast("array<string>")
    whole = lambda s: F.struct(F.lit(s).alias("section"), none.alias("items"), F.lit("x").alias("content"))
    items = lambda s, arr: F.struct(F.lit(s).alias("section"), arr.alias("items"), F.lit("").alias("content"))
    one = F.array(F.lit("a"))
    parts = [whole("core_method"), whole("overview"), items("techniques", lines), items("worked_examples", one), items("common_mistakes", one), whole("practice_plan"), whole("mastery_checklist"), whole("strategy_notes")]
    return d.select("doc_id", F.explode(F.when(F.col("n_chars") % 10 == 0, F.array(*parts)).otherwise(F.array(*parts, whole("learning_goals")))).alias("s")).select("doc_id", "s.*")


@query("teaching_blocks", _BLOCKS + " SELECT doc_id, section, type, key, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, i) - 1 AS BIGINT) AS position FROM b")
def teaching_blocks(t: Tables):
    return P.teaching_blocks(_sections(t), ["doc_id"])[0].select("doc_id", "section", "type", "key", "content", F.col("position").cast("long").alias("position"))


@query("teaching_refusals", "SELECT doc_id, 'learning_goals' AS missing FROM teaching_docs WHERE n_chars % 10 = 0")
def teaching_refusals(t: Tables):
    return P.teaching_blocks(_sections(t), ["doc_id"])[1].select("doc_id", F.array_join("missing", ",").alias("missing"))


_PICTURES = "p AS (SELECT doc_id, 'picture.' || u.i AS key, CASE WHEN u.i % 5 = 4 THEN 'nowhere' ELSE 'techniques.' || (u.i // 2) END AS appears_after, 'pic ' || l[u.i + 1] AS content, u.i AS ord FROM d, UNNEST(range(len(l))) AS u(i))"


def _pictures(t: Tables):
    """A picture for every line, behind the technique of half its number; every fifth names no block."""
    rows = t.teaching_docs.filter(F.col("n_chars") % 10 != 0).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "l"))
    after = F.when(F.col("ord") % 5 == 4, "nowhere").otherwise(F.concat(F.lit("techniques."), F.floor(F.col("ord") / 2).cast("string")))
    return rows.select("doc_id", F.concat(F.lit("picture."), F.col("ord").cast("string")).alias("key"), after.alias("appears_after"), F.concat(F.lit("pic "), "l").alias("content"), "ord")


@query(
    "teaching_pictures",
    f"""{_BLOCKS}, {_PICTURES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, i) AS place FROM b),
       w AS (SELECT doc_id, section, type, key, content, place, -1 AS ord FROM o UNION ALL SELECT p.doc_id, o.section, 'illustration', p.key, p.content, o.place, p.ord FROM p JOIN o ON o.doc_id = p.doc_id AND o.key = p.appears_after)
       SELECT doc_id, section, type, key, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, ord) - 1 AS BIGINT) AS position FROM w""",
)
def teaching_pictures(t: Tables):
    blocks, _ = P.teaching_blocks(_sections(t), ["doc_id"])
    done, _ = P.insert_after(blocks, _pictures(t), ["doc_id"])
    return done.select("doc_id", "section", "type", "key", "content", F.col("position").cast("long").alias("position"))


# -- store --------------------------------------------------------------------------------------------------
@query("keyed_upsert", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def keyed_upsert(t: Tables):
    rows = t.events.select("user_id", "event_type", "event_id", "ts")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return S.upsert(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("store_keys", "SELECT source || ':ch' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || CAST(doc_id AS STRING) AS chapter_id, doc_id AS chapter_number, source AS book_slug FROM documents")
def store_keys(t: Tables):
    d = t.documents.select("source", S.chapter_key("source", "doc_id").alias("chapter_id"))
    parsed = S.parse_label(F.col("chapter_id"))
    return d.select("chapter_id", parsed["chapter_number"].cast("long").alias("chapter_number"), parsed["book_slug"].alias("book_slug"))


@query("load_gate", "SELECT o_orderkey AS chapter_id, count(l_orderkey) FILTER (WHERE l_returnflag <> 'N') AS blocking_errors, count(l_orderkey) FILTER (WHERE l_returnflag <> 'N') = 0 AS loaded FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def load_gate(t: Tables):
    errors = t.lineitem.select(F.col("l_orderkey").alias("chapter_id"), F.when(F.col("l_returnflag") == "N", "EMPTY_CLEAN_CHUNK_TEXT").otherwise("CHAPTER_MISMATCH").alias("code"))
    return S.load_gate(t.orders.select(F.col("o_orderkey").alias("chapter_id")), errors)


@query(
    "light_registration",
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'not_one_chapter' WHEN doc_id % 8 = 0 THEN 'no_chapter_number' WHEN doc_id % 7 = 0 THEN 'no_slug' WHEN doc_id % 5 = 0 THEN 'no_content' END AS code FROM documents""",
)
def light_registration(t: Tables):
    i = F.col("doc_id")
    docs = t.documents.select(
        i.alias("document_id"), F.when(i % 9 == 0, 2).otherwise(1).alias("chapters"), F.when(i % 8 == 0, "three").otherwise(i.cast("string")).alias("chapter_number"), F.when(i % 7 == 0, " ").otherwise(F.col("source")).alias("slug"),
        F.create_map(F.lit("key_terms"), F.when(i % 5 == 0, 0).otherwise(3)).alias("sizes"),
    )
    return S.register_extracted(docs).select("document_id", "code")


@query(
    "attempts_history",
    """SELECT event_id AS id, event_type AS task_type, props AS prompt_excerpt FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 100""",
)
def attempts_history(t: Tables):
    a = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("task_type"), F.col("props").alias("prompt_text"))
    return S.history(a, task="view")


@query("document_section", "SELECT event_id, json_extract_string(props, '$.k') AS section FROM events")
def document_section(t: Tables):
    return S.document_section(t.events, "k", ["k"], "props").select("event_id", "section")


@query("public_items", "SELECT p_partkey, p_name, p_size FROM part")
def public_items(t: Tables):
    return S.public_items(t.part, ["p_brand", "p_type", "p_retailprice"])
