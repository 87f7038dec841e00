"""Text, quality and bank queries."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, tile_of_integer
from quire.operators import quality as Q
from quire.operators.findings import check_health, overall_verdict, verdict_of
from quire.plans.registry import Tables, derive, query

# word, sentence and syllable counts the plain way: one list element per word
derive(
    "measured",
    "SELECT 1 AS unused",
    r"""SELECT doc_id, lang, source, plain, w,
        len(list_filter(regexp_split_to_array(plain, '[.!?]+'), lambda p: len(list_filter(regexp_split_to_array(p, '[ \n]+'), lambda t: t <> '')) >= 3)) AS sentences,
        len(w) AS words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: CASE WHEN regexp_replace(x, '[^A-Za-z]', '', 'g') = '' THEN 0
            ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[aeiouy]+'))
              - CASE WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') LIKE '%e'
                     AND len(regexp_extract_all(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)), 0) AS BIGINT) AS syllables
        FROM (SELECT *, regexp_extract_all(plain, '[A-Za-z'']+') AS w
              FROM (SELECT doc_id, lang, source, regexp_replace(text, '\$\$.+?\$\$|\$[^$]*\$|\\[a-zA-Z]+\{[^{}]*\}', ' ', 'g') AS plain FROM documents))""",
)


@query(
    "readability_by_lang",
    """SELECT lang, source, count(*) AS docs, count(grade) AS measured, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(words) AS BIGINT) AS words,
       CAST(sum(syllables) AS BIGINT) AS syllables, round(avg(grade) + 1e-9, 4) AS mean_grade
       FROM (SELECT *, CASE WHEN sentences >= 3 AND words >= 80 THEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 END AS grade FROM measured)
       GROUP BY lang, source""",
)
def readability_by_lang(t: Tables):
    m = Q.readability(t.documents, ["lang", "source"])
    return m.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("docs"), F.count("grade").alias("measured"),
        *[F.sum(c).alias(c) for c in ("sentences", "words", "syllables")], F.round(F.avg("grade") + 1e-9, 4).alias("mean_grade"),
    )


@query(
    "readability_docs",
    """SELECT doc_id, sentences, words, syllables, round(CASE WHEN sentences >= 3 AND words >= 80 THEN 0.39 * words / sentences + 11.8 * syllables / words - 15.59 END + 1e-9, 4) AS grade
       FROM measured""",
)
def readability_docs(t: Tables):
    m = Q.readability(t.documents, ["doc_id"])
    return m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sentences", "words", "syllables")], F.round(F.col("grade") + 1e-9, 4).alias("grade"))


@query(
    "reading_findings",
    """SELECT doc_id, CASE WHEN grade > 10.5 THEN CASE WHEN words * 1.0 / sentences > 14 THEN 'SPLIT_SENTENCES' ELSE 'PLAINER_WORDS' END ELSE 'LONG_SENTENCES' END AS code
       FROM (SELECT *, 0.39 * words / sentences + 11.8 * syllables / words - 15.59 AS grade FROM measured WHERE sentences >= 3 AND words >= 80)
       WHERE grade > 10.5 OR words * 1.0 / sentences > 14""",
)
def reading_findings(t: Tables):
    return Q.reading_findings(Q.readability(t.documents, ["doc_id"]), 10.0).select("doc_id", "code")


@query(
    "long_words_top",
    r"""WITH tok AS (SELECT lang, doc_id, i, lower(w[i]) AS word FROM measured, UNNEST(range(1, len(w) + 1)) AS u(i)),
       syl AS (SELECT *, regexp_replace(word, '[^a-z]', '', 'g') AS a FROM tok),
       heavy AS (SELECT * FROM syl WHERE a <> '' AND greatest(1, len(regexp_extract_all(a, '[aeiouy]+')) -
         CASE WHEN a LIKE '%e' AND len(regexp_extract_all(a, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) >= 3),
       c AS (SELECT lang, word, count(*) AS n, min(doc_id * 1000000 + i) AS seen FROM heavy GROUP BY lang, word)
       SELECT lang, word, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seen) AS r FROM c) WHERE r <= 6""",
)
def long_words_top(t: Tables):
    return Q.long_words(t.documents, ["lang"], "doc_id")


@query(
    "longest_sentences",
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(plain, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM measured),
       e AS (SELECT doc_id, i, trim(l[i], chr(10) || ' ') AS sentence FROM s, UNNEST(range(1, len(l) + 1)) AS u(i)),
       n AS (SELECT *, len(list_filter(regexp_split_to_array(sentence, '[ \n]+'), lambda x: x <> '')) AS words FROM e)
       SELECT doc_id, CAST(r AS INT) AS rank, words, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, i) AS r FROM n WHERE words >= 3) WHERE r <= 3""",
)
def longest_sentences(t: Tables):
    return Q.longest_sentences(t.documents, ["doc_id"]).withColumn("words", F.col("words").cast("long"))


derive("gapped", "SELECT doc_id, lang, CASE WHEN doc_id % 97 = 0 THEN '  ' ELSE replace(text, ' de ', ' de  ') END AS text FROM (SELECT doc_id, lang, replace(text, ' the ', ' the  ') AS text FROM documents)")


@query(
    "gap_damage",
    r"""WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\x00-\x7F]', '-', 'g'), '[^\x00-\x7F]', 'Z', 'g') AS x FROM gapped),
       m AS (SELECT doc_id, text, trim(text) = '' AS blank, regexp_extract_all(x, '\b[a-z]{1,6}\b {2,}\b[a-z]{1,6}\b') AS m, list_transform(regexp_split_to_array(x, '\b[a-z]{1,6}\b {2,}\b[a-z]{1,6}\b'), lambda y: len(y)) AS p FROM a),
       o AS (SELECT *, list_transform(range(1, least(3, len(m)) + 1), lambda i: list_sum(p[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0)) AS places FROM m),
       n AS (SELECT doc_id, blank, len(m) AS g, array_to_string(list_transform(places, lambda s, i: trim(replace(substr(text, CAST(greatest(s - 18, 0) + 1 AS BIGINT), CAST(s + len(m[i]) + 18 - greatest(s - 18, 0) AS BIGINT)), chr(10), '\n'))), '|') AS snippets FROM o)
       SELECT doc_id, CASE WHEN blank THEN 'EMPTY' ELSE 'SUSPECTED_GAP' END AS code, CASE WHEN blank THEN 'error' ELSE 'warning' END AS severity,
       CASE WHEN blank THEN 0 ELSE g END AS gap_count, CASE WHEN blank THEN '' ELSE snippets END AS snippets FROM n WHERE blank OR g > 0""",
)
def gap_damage(t: Tables):
    return Q.extraction_damage(t.gapped, ["doc_id"]).select("doc_id", "code", "severity", F.col("gap_count").cast("long").alias("gap_count"), F.array_join("snippets", "|").alias("snippets"))


@query(
    "text_normal_forms",
    r"""SELECT doc_id, lower(s) AS folded, len(s) AS chars, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, ' ')) END AS words,
       CASE WHEN len(s) <= 300 THEN s ELSE rtrim(substr(s, 1, 297)) || '...' END AS preview
       FROM (SELECT doc_id, trim(regexp_replace(text, '[ \n]+', ' ', 'g')) AS s FROM documents)""",
)
def text_normal_forms(t: Tables):
    s = T.squash("text")
    return t.documents.select(
        "doc_id", T.match_text("text").alias("folded"), F.length(s).cast("long").alias("chars"),
        T.word_count("text").cast("long").alias("words"), T.preview("text", 300).alias("preview"),
    )


@query(
    "contract_text_hash",
    r"""SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[ \n]+', ' ', 'g'))) AS h FROM documents""",
)
def contract_text_hash(t: Tables):
    return t.documents.select("doc_id", F.sha2(T.contract_text("text"), 256).alias("h"))


derive("cited", "SELECT doc_id, ' ' || text || ' :contentReference[oaicite:' || CAST(doc_id AS STRING) || ']{index=1}' AS text FROM documents")


@query("citation_artifacts", "SELECT doc_id, sha256(text) AS h FROM documents")
def citation_artifacts(t: Tables):
    return t.cited.select("doc_id", F.sha2(Q.strip_citation_artifacts("text"), 256).alias("h"))


# -- teaching contract: documents as skills named by their first word; every line is part of an explanation, an example, a step or a mistake ------------------
derive(
    "skills",
    """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 3 = 0 THEN 'procedure' ELSE 'item' END AS kind, split_part(text, ' ', 1) AS name, doc_id AS ord,
       array_join(filter(l, (x, i) -> i % 4 = 0), ' ') AS explanation, filter(l, (x, i) -> i % 4 = 1) AS examples, filter(l, (x, i) -> i % 4 = 2) AS steps,
       array_join(filter(l, (x, i) -> i % 4 = 3), ' ') AS mistake FROM (SELECT *, filter(split(text, chr(10)), x -> x <> '') AS l FROM documents)""",
    """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 3 = 0 THEN 'procedure' ELSE 'item' END AS kind, split_part(text, ' ', 1) AS name, doc_id AS ord,
       array_to_string(list_filter(l, lambda x, i: i % 4 = 1), ' ') AS explanation, list_filter(l, lambda x, i: i % 4 = 2) AS examples, list_filter(l, lambda x, i: i % 4 = 3) AS steps,
       array_to_string(list_filter(l, lambda x, i: i % 4 = 0), ' ') AS mistake FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)""",
)
derive("lessons", "SELECT source AS id, CASE WHEN CAST(min(doc_id) AS BIGINT) % 3 = 0 THEN 'too short' ELSE max(text) END AS about, CAST(min(doc_id) AS BIGINT) % 4 AS k FROM documents GROUP BY source")
_W = r"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \n]+'), lambda x: x <> ''))"


def _wc(column: str) -> str:
    return _W.format(c=column)


derive(
    "contract_findings",
    "SELECT 1 AS unused",
    rf"""SELECT * FROM (
       SELECT 'skill_teaching' AS "check", 'reject' AS severity, id AS key, 'NO_EXPLANATION' AS code FROM skills WHERE {_wc('explanation')} < 4
       UNION ALL SELECT 'skill_teaching', 'reject', id, 'NO_EXAMPLE' FROM skills WHERE len(examples) = 0
       UNION ALL SELECT 'skill_teaching', 'reject', id, 'NO_STEPS' FROM skills WHERE kind = 'procedure' AND len(steps) < 2
       UNION ALL SELECT 'skill_teaching', 'warn', id, 'NO_MISTAKE' FROM skills WHERE {_wc('mistake')} < CASE WHEN kind = 'procedure' THEN 3 ELSE 1 END
       UNION ALL SELECT 'circular_definition', 'reject', id, 'CIRCULAR' FROM (SELECT *, lower(trim(name)) AS n, regexp_extract_all(lower(explanation), '[a-z'']+') AS w FROM skills)
         WHERE len(n) >= 3 AND list_contains(w, n) AND len(list_filter(w, lambda x: x <> n AND NOT starts_with(x, substr(n, 1, greatest(4, len(n) - 2))))) < 4
       UNION ALL SELECT 'example_uses_the_thing', 'reject', id, 'NOT_USED' FROM skills
         WHERE kind = 'item' AND trim(name) <> '' AND len(list_filter(examples, lambda e: contains(lower(e), substr(lower(trim(name)), 1, greatest(4, len(name) - 2))))) = 0
       UNION ALL SELECT 'worked_example_shows_work', 'warn', id, 'TERSE_STEPS' FROM skills WHERE kind = 'procedure' AND len(steps) > 0 AND len(list_filter(steps, lambda s: {_wc('s')} >= 3)) = 0
       UNION ALL SELECT 'lesson_priming', 'reject', id, 'NO_ABOUT' FROM lessons WHERE {_wc('about')} < 4
       UNION ALL SELECT 'lesson_priming', 'reject', id, 'NO_OUTCOMES' FROM lessons WHERE k = 1
       UNION ALL SELECT 'lesson_priming', 'warn', id, 'NO_PITFALLS' FROM lessons WHERE k = 2)""",
)


def _skills(t: Tables):
    return t.skills.withColumnRenamed("mistake", "common_mistake")


def _lessons(t: Tables):
    some = lambda k: F.when(F.col("k") == k, F.array().cast("array<string>")).otherwise(F.array("about"))
    return t.lessons.select("id", "about", some(1).alias("will_be_able_to"), some(2).alias("common_pitfalls"))


def _contract_findings(t: Tables):
    skills, lessons = _skills(t), _lessons(t)
    out = Q.priming_findings(lessons)
    return lessons, skills, out.unionByName(Q.skill_findings(skills))


@query("contract_findings_all", 'SELECT "check", severity, key, code FROM contract_findings')
def contract_findings_all(t: Tables):
    return _contract_findings(t)[2].select("check", "severity", "key", "code")


@query(
    "contract_rollup",
    """WITH r AS (SELECT DISTINCT key FROM contract_findings WHERE severity = 'reject')
       SELECT (SELECT count(*) FROM lessons) AS lessons, (SELECT count(*) FROM skills) AS skills,
       (SELECT count(*) FROM skills WHERE id NOT IN (SELECT key FROM r)) AS teachable, (SELECT count(*) FROM skills WHERE id IN (SELECT key FROM r)) AS rejected_skills,
       (SELECT count(*) FROM lessons WHERE id IN (SELECT key FROM r)) AS rejected_lessons, (SELECT count(*) = 0 FROM r) AS accepted""",
)
def contract_rollup(t: Tables):
    return Q.contract_rollup(*_contract_findings(t))


@query("findings_by_check", 'SELECT "check", severity, count(*) AS n FROM contract_findings GROUP BY "check", severity')
def findings_by_check(t: Tables):
    return Q.findings_by_check(_contract_findings(t)[2])


@query(
    "check_verdicts",
    """WITH g AS (SELECT id, c FROM skills, (SELECT UNNEST(['skill_teaching', 'circular_definition']) AS c)),
       v AS (SELECT g.id, g.c, count(f.key) AS n FROM g LEFT JOIN contract_findings f ON f.key = g.id AND f."check" = g.c GROUP BY g.id, g.c)
       SELECT id AS key, CASE WHEN max(CASE WHEN n > 0 THEN 1 ELSE 0 END) = 1 THEN 'fix' ELSE 'pass' END AS verdict, CAST(sum(n) AS BIGINT) AS findings FROM v GROUP BY id""",
)
def check_verdicts(t: Tables):
    """Verdicts with the health of each check proven on planted rows taken from the table itself."""
    skills = _skills(t)
    checks = {"skill_teaching": Q.teaching_findings, "circular_definition": Q.circular_findings}
    long_text = F.lit("Plain words say what it is and how it is used every day")
    good = skills.withColumn("explanation", long_text).withColumn("examples", F.array(F.lit("one"))).withColumn(
        "steps", F.array(F.lit("a"), F.lit("b"))).withColumn("common_mistake", F.lit("reading the wrong line"))
    bad = {
        "skill_teaching": good.withColumn("explanation", F.lit("")),
        "circular_definition": good.withColumn("name", F.lit("yacht")).withColumn("explanation", F.lit("a yacht is a yacht")),
    }
    health, findings = None, None
    for name, check in checks.items():
        one = check_health(name, check, good, bad[name], "id")
        health = one if health is None else health.unionByName(one)
        found = check(skills)
        findings = found if findings is None else findings.unionByName(found)
    return overall_verdict(verdict_of(skills, findings, health, "id"))


derive(
    "skill_lines",
    "SELECT id, name, example, ord, i FROM (SELECT id, split_part(t, ' ', 1) AS name, ord, posexplode(split(t, chr(10))) AS (i, example) FROM (SELECT CAST(doc_id AS STRING) AS id, doc_id AS ord, text AS t FROM documents))",
    "SELECT id, name, l[u.i + 1] AS example, ord, CAST(u.i AS INT) AS i FROM (SELECT CAST(doc_id AS STRING) AS id, split_part(text, ' ', 1) AS name, doc_id AS ord, string_split(text, chr(10)) AS l FROM documents) s, UNNEST(range(len(s.l))) AS u(i)",
)


@query(
    "templated_examples",
    rf"""WITH a AS (SELECT *, substr(lower(trim(name)), 1, CAST(greatest(4, len(name) - 2) AS INT)) AS stem FROM skill_lines),
       k AS (SELECT id, ord, i, CASE WHEN name = '' THEN trim(lower(example))
          WHEN regexp_full_match(stem, '[\p{{L}}\p{{N}}_]+') THEN trim(array_to_string(list_transform(regexp_extract_all(lower(example), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN starts_with(w, stem) THEN '___' ELSE w END), ''))
          ELSE trim(regexp_replace(lower(example), '(^|[^\p{{L}}\p{{N}}_])' || regexp_replace(stem, '([^\p{{L}}\p{{N}}_])', '\\\1', 'g') || '[\p{{L}}\p{{N}}_]*', '\1___', 'g')) END AS skeleton FROM a),
       f AS (SELECT * FROM k WHERE {_wc('skeleton')} >= 4),
       s AS (SELECT skeleton, count(DISTINCT id) AS skills, min(ord * 100000 + i) AS seen FROM f GROUP BY skeleton HAVING count(DISTINCT id) >= 5)
       SELECT id, skeleton, skills FROM (SELECT DISTINCT f.id, s.skeleton, s.skills, row_number() OVER (PARTITION BY f.id ORDER BY s.seen, s.skeleton) AS r
         FROM (SELECT DISTINCT id, skeleton FROM f) f JOIN s USING (skeleton)) WHERE r = 1""",
)
def templated_examples(t: Tables):
    return Q.templated_examples(t.skill_lines, ["ord", "i"])


# -- equations, lesson rules ---------------------------------------------------------------------
derive(
    "worked",
    """SELECT l_orderkey * 10 + l_linenumber AS k, 'so $' || CAST(CAST(l_quantity AS INT) AS STRING) || ' + ' || CAST(l_linenumber AS STRING) || ' = ' ||
       CAST(CAST(l_quantity AS INT) + l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS STRING) || '$ and $' ||
       CAST(l_linenumber AS STRING) || '/' || CAST(CAST(l_quantity AS INT) AS STRING) || ' = ' || CAST(l_linenumber * 2 AS STRING) || '/' || CAST(CAST(l_quantity AS INT) * 2 AS STRING) ||
       ' = x$' AS text, CAST(l_quantity AS INT) AS q, l_linenumber AS n, l_partkey AS p FROM lineitem""",
)


@query(
    "equation_chains",
    """SELECT verdict, sides, count(*) AS chains FROM (
         SELECT CASE WHEN p % 50 = 0 THEN 'false' ELSE 'true' END AS verdict, 2 AS sides FROM worked
         UNION ALL SELECT 'true', 2 FROM worked) GROUP BY verdict, sides""",
)
def equation_chains(t: Tables):
    return Q.check_chains(Q.equation_chains(t.worked, ["k"])).groupBy("verdict", "sides").agg(F.count(F.lit(1)).alias("chains"))


derive("answers", "SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 'summarize_written_text' ELSE 'write_essay' END AS task_type FROM conversations")


@query(
    "worked_example_rules",
    rf"""WITH a AS (SELECT *, {_wc('text')} AS words, len(list_filter(string_split(regexp_replace(trim(text, ' ' || chr(10)), '[.!?]+([ \n]|$)', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '')) AS sentences FROM answers),
       c AS (SELECT role, count(*) AS n FROM answers GROUP BY role)
       SELECT role AS key, 'OVER_LENGTH' AS code, count(*) AS n FROM a WHERE words > 120 GROUP BY role
       UNION ALL SELECT role, 'NOT_ONE_SENTENCE', count(*) FROM a WHERE task_type = 'summarize_written_text' AND sentences <> 1 GROUP BY role
       UNION ALL SELECT role, 'TOO_FEW_EXAMPLES', 1 FROM c WHERE n < 100""",
)
def worked_example_rules(t: Tables):
    examples = t.answers.select(F.col("role").alias("lesson_id"), F.col("turn").alias("i"), F.col("text").alias("model_answer"))
    lessons = t.answers.groupBy(F.col("role").alias("lesson_id")).agg(F.max("task_type").alias("task_type")).withColumn("pack", F.lit("p")).withColumn("max_words", F.lit(120))
    policy = lessons.select("pack").distinct().withColumn("min_worked_examples", F.lit(100))
    return Q.worked_example_findings(examples, lessons, policy).groupBy("key", "code").agg(F.count(F.lit(1)).alias("n"))


derive(
    "methods",
    "SELECT CAST(doc_id AS STRING) AS lesson_id, filter(split(text, chr(10)), x -> trim(x) <> '') AS steps, doc_id % 3 AS k FROM documents",
    "SELECT CAST(doc_id AS STRING) AS lesson_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS steps, doc_id % 3 AS k FROM documents",
)


@query(
    "method_banners",
    """WITH m AS (SELECT lesson_id, k, list_transform(steps, lambda x: lower(trim(x, ' ' || chr(10)))) AS s FROM methods WHERE len(steps) >= 2),
       t AS (SELECT lesson_id, s, list_filter(list_transform(CASE k WHEN 0 THEN s[1:len(s) - 1] WHEN 1 THEN s ELSE [s[1], 'other'] END, lambda x: trim(replace(x, '$', ''))), lambda x: x <> '') AS toks,
              CASE k WHEN 0 THEN len(s) > 2 ELSE true END AS arrowed FROM m)
       SELECT lesson_id AS key, CAST(len(toks) AS STRING) || '/' || CAST(len(s) AS STRING) AS detail FROM t
       WHERE arrowed AND len(toks) > 0 AND len(list_filter(toks, lambda x: NOT list_contains(s, x))) = 0 AND len(toks) <> len(s)""",
)
def method_banners(t: Tables):
    steps, k = F.col("steps"), F.col("k")
    listed = F.when(k == 0, F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))).when(k == 1, steps).otherwise(F.concat(F.slice(steps, 1, 1), F.array(F.lit("other"))))
    rows = t.methods.select("lesson_id", F.array_join(listed, " → ").alias("name"), F.lit(None).cast("string").alias("formula"), "steps")
    return Q.banner_findings(rows).select("key", "detail")


derive("guides", """SELECT o_orderpriority AS task_type, 'Form: 2 Length is between ' || CAST(200 + min(o_custkey) % 7 AS STRING) || ' and ' || CAST(300 + max(o_custkey) % 7 AS STRING) || ' words 1 Other ' ||
    CASE WHEN min(o_custkey) % 2 = 0 THEN 'Grammar: ok Spelling: ok' ELSE 'Content: ok' END AS evidence, 200 + min(o_custkey) % 7 AS lo, 300 + max(o_custkey) % 7 AS hi, min(o_custkey) % 2 AS k FROM orders GROUP BY o_orderpriority""")
derive("exam_lessons", """SELECT o_orderkey AS lesson_id, o_orderpriority AS task_type, 'Write ' || CAST(200 + o_custkey % 7 AS STRING) || ' to ' || CAST(300 + o_orderkey % 7 AS STRING) || '-word answers' AS rule,
    CASE o_orderstatus WHEN 'O' THEN 'Grammar' WHEN 'F' THEN 'Content' ELSE 'Clear thinking' END AS factor, 200 + o_custkey % 7 AS a, 300 + o_orderkey % 7 AS b FROM orders""")


@query(
    "stated_ranges",
    """SELECT l.lesson_id, l.task_type, CAST(g.lo AS STRING) || '-' || CAST(g.hi AS STRING) AS "range" FROM exam_lessons l JOIN guides g USING (task_type) WHERE NOT (l.a = g.lo AND l.b = g.hi)""",
)
def stated_ranges(t: Tables):
    lessons = t.exam_lessons.select("lesson_id", "task_type", F.array().cast("array<string>").alias("facts"), F.array("rule").alias("rules"))
    return Q.unstated_ranges(lessons, t.guides)


@query(
    "foreign_traits",
    """SELECT l.lesson_id, l.task_type, l.factor AS name FROM exam_lessons l JOIN guides g USING (task_type)
       WHERE (l.factor = 'Grammar' AND g.k <> 0) OR (l.factor = 'Content' AND g.k = 0)""",
)
def foreign_traits(t: Tables):
    return Q.foreign_traits(t.exam_lessons.withColumnRenamed("factor", "name"), Q.guide_traits(t.guides))


# a task per benchmark item, known by the item's whole text, and one per language, known by the shortest of its lines' words
derive(
    "aliases",
    "SELECT 'task-' || CAST(item_id AS STRING) AS task_type, text AS alias FROM benchmark UNION ALL SELECT 'lang-' || lang, min(w) FROM (SELECT lang, explode(split(text, '[ \\\\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY lang",
    "SELECT 'task-' || CAST(item_id AS STRING) AS task_type, text AS alias FROM benchmark UNION ALL SELECT 'lang-' || lang, min(w) FROM (SELECT lang, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY lang",
)
derive("guide_book", "SELECT CAST(doc_id AS INT) AS page, CASE WHEN doc_id % 50 = 7 THEN 'Scoring ' || text ELSE text END AS text FROM documents")


@query(
    "guide_pages",
    r"""WITH p AS (SELECT page, text, lower(trim(regexp_replace(text, '[ \n]+', ' ', 'g'))) AS f FROM guide_book),
       a AS (SELECT task_type, lower(trim(regexp_replace(alias, '[ \n]+', ' ', 'g'))) AS x FROM aliases),
       h AS (SELECT DISTINCT a.task_type, p.page, true AS matched FROM p JOIN a ON contains(p.f, a.x)),
       s AS (SELECT page FROM p WHERE contains(f, 'scoring') ORDER BY page LIMIT 4),
       al AS (SELECT * FROM h UNION ALL SELECT DISTINCT a.task_type, s.page, false FROM a, s WHERE a.task_type NOT IN (SELECT task_type FROM h)),
       q AS (SELECT al.task_type, al.page, matched, len(g.text) AS n, coalesce(sum(len(g.text) + 2) OVER (PARTITION BY al.task_type ORDER BY CASE WHEN al.page = 15 AND matched THEN 1 ELSE 0 END, al.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
         FROM al JOIN guide_book g USING (page))
       SELECT task_type, page, matched, CAST(least(n, 24000 - used) AS BIGINT) AS chars FROM q WHERE used < 24000""",
)
def guide_pages(t: Tables):
    pages = t.guide_book
    hits = Q.guide_pages(pages, t.aliases)
    return Q.packed_pages(hits, pages).select("task_type", "page", "matched", F.length("text").cast("long").alias("chars"))


@query(
    "checkable_assertions",
    r"""SELECT lesson_id, 0 AS i, 'format_fact' AS kind, 'Words: ' || CAST(a AS STRING) AS text FROM exam_lessons
       UNION ALL SELECT lesson_id, 1, 'scoring_factor', 'Scoring for this task takes into account ' || factor || ': ' || task_type FROM exam_lessons
       UNION ALL SELECT lesson_id, 2, 'critical_rule', rule FROM exam_lessons""",
)
def checkable_assertions(t: Tables):
    e = t.exam_lessons.select(
        "lesson_id", F.array(F.struct(F.lit("Words").alias("label"), F.col("a").cast("string").alias("value"))).alias("facts"),
        F.array(F.struct(F.col("factor").alias("name"), F.col("task_type").alias("what_it_measures"))).alias("factors"),
        F.array("rule", F.lit("Read it twice")).alias("rules"),
    )
    return Q.checkable_assertions(e)


# -- banks ------------------------------------------------------------------------------------------
derive(
    "questions",
    """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'multiple' END AS mode, source AS topic, lang AS title, text AS passage, split_part(text, chr(10), 1) AS question,
       CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'gist' END AS skill, array_join(filter(l, (x, i) -> i % 5 = 0), ' ') AS o1, array_join(filter(l, (x, i) -> i % 5 = 1), ' ') AS o2, array_join(filter(l, (x, i) -> i % 5 = 2), ' ') AS o3,
       array_join(filter(l, (x, i) -> i % 5 = 3), ' ') AS o4, array_join(filter(l, (x, i) -> i % 5 = 4), ' ') AS o5,
       CASE WHEN doc_id % 5 = 0 THEN 'E' ELSE 'B' END AS k1, CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE 'C' END AS k2 FROM (SELECT *, split(text, ' ') AS l FROM documents)""",
    """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'single' ELSE 'multiple' END AS mode, source AS topic, lang AS title, text AS passage, split_part(text, chr(10), 1) AS question,
       CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'gist' END AS skill, array_to_string(list_filter(l, lambda x, i: i % 5 = 1), ' ') AS o1, array_to_string(list_filter(l, lambda x, i: i % 5 = 2), ' ') AS o2,
       array_to_string(list_filter(l, lambda x, i: i % 5 = 3), ' ') AS o3, array_to_string(list_filter(l, lambda x, i: i % 5 = 4), ' ') AS o4, array_to_string(list_filter(l, lambda x, i: i % 5 = 0), ' ') AS o5,
       CASE WHEN doc_id % 5 = 0 THEN 'E' ELSE 'B' END AS k1, CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE 'C' END AS k2 FROM (SELECT *, string_split(text, ' ') AS l FROM documents)""",
)


@query(
    "question_shape",
    rf"""WITH q AS (SELECT *, {_wc('passage')} AS w, CASE WHEN mode = 'single' THEN [o1, o2, o3, o4] ELSE [o1, o2, o3, o4, o5] END AS opts, CASE WHEN mode = 'single' THEN [k1] ELSE [k1, k2] END AS corr FROM questions)
       SELECT id, CASE WHEN trim(question) = '' THEN 'missing_question' WHEN skill = '' THEN 'missing_skill'
         WHEN NOT (CASE WHEN mode = 'single' THEN w BETWEEN 120 AND 300 ELSE w BETWEEN 200 AND 400 END) THEN 'passage_length'
         WHEN len(list_filter(opts, lambda o: trim(o, ' ' || chr(10)) = '')) > 0 THEN 'option_text'
         WHEN len(list_distinct(list_transform(opts, lambda o: lower(trim(o, ' ' || chr(10)))))) <> len(opts) THEN 'duplicate_option'
         WHEN len(list_distinct(corr)) <> len(corr) THEN 'duplicate_correct'
         WHEN mode = 'single' AND k1 = 'E' THEN 'correct_outside' END AS code FROM q""",
)
def question_shape(t: Tables):
    q = t.questions
    opt = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("text"))
    four = [opt(k, c) for k, c in zip("ABCD", ("o1", "o2", "o3", "o4"))]
    single = F.col("mode") == "single"
    rationale = F.create_map(*[F.lit(x) for k in "ABCDE" for x in (k, "because")])
    rows = q.withColumn("options", F.when(single, F.array(*four)).otherwise(F.array(*four, opt("E", "o5")))).withColumn(
        "correct", F.when(single, F.array("k1")).otherwise(F.array("k1", "k2"))
    ).withColumn("rationale", rationale)
    return rows.select("id", Q.question_reason().alias("code"))


derive("passages", "SELECT doc_id AS ord, source AS topic, CASE WHEN doc_id % 41 = 0 THEN '' ELSE lang END AS title, text AS passage FROM documents")


@query(
    "passage_shape",
    rf"""WITH p AS (SELECT ord, title, trim(passage, ' ' || chr(10)) AS s FROM passages),
       m AS (SELECT *, {_wc('s')} AS w, len(list_filter(string_split(regexp_replace(s, '[.!?]+([ \n]|$)', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '')) AS n FROM p)
       SELECT ord, CASE WHEN title = '' THEN 'empty_title' WHEN s = '' THEN 'empty_passage' WHEN w NOT BETWEEN 180 AND 300 THEN 'length' WHEN n < 4 THEN 'sentences'
         WHEN regexp_matches(s, '(^|\n)\s*[-*•]') THEN 'bullets' END AS code FROM m""",
)
def passage_shape(t: Tables):
    return t.passages.select("ord", Q.passage_reason().alias("code"))


@query(
    "bank_dedupe_ids",
    r"""WITH k AS (SELECT *, trim(regexp_replace(lower(substr(passage, 1, 120)), '[ \n]+', ' ', 'g')) AS kk FROM passages),
       f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kk ORDER BY ord) AS r FROM k) WHERE r = 1),
       s AS (SELECT *, substr(trim(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24) AS slug FROM f)
       SELECT ord, slug || '-' || lpad(CAST(row_number() OVER (PARTITION BY slug ORDER BY ord) AS STRING), CAST(greatest(2, len(CAST(row_number() OVER (PARTITION BY slug ORDER BY ord) AS STRING))) AS INTEGER), '0') AS id FROM s""",
)
def bank_dedupe_ids(t: Tables):
    kept = Q.dedupe_bank(t.passages, "passage", "ord", 120)
    return Q.assign_ids(kept, "topic", "ord", "passage").select("ord", "id")


derive("prompt_bank", """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'agree_disagree' WHEN 1 THEN 'positive_negative' WHEN 2 THEN 'discuss_two_views' ELSE 'other' END AS type, source AS topic, text AS statement,
    CASE doc_id % 3 WHEN 0 THEN 'Do you agree or disagree?' WHEN 1 THEN 'Is it positive or negative?' ELSE 'Discuss both views' END AS directive, lang AS instruction FROM documents""")


@query(
    "prompt_shape",
    """SELECT id, CASE WHEN type = 'other' THEN 'unknown_type' WHEN trim(statement, ' ' || chr(10)) = '' THEN 'empty_statement'
       WHEN (type = 'agree_disagree' AND id % 3 <> 0) OR (type = 'positive_negative' AND id % 3 <> 1) OR (type = 'discuss_two_views' AND id % 3 <> 2) THEN 'directive' END AS code FROM prompt_bank""",
)
def prompt_shape(t: Tables):
    return t.prompt_bank.select("id", Q.prompt_reason().alias("code"))


derive(
    "charts",
    """SELECT o_custkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'bar' WHEN 1 THEN 'line' ELSE 'pie' END AS chart_type, o_orderkey AS k,
       o_orderpriority AS label, CASE WHEN o_orderkey % 400 = 0 THEN -1.0 ELSE floor(o_totalprice / 20000) END AS value FROM orders""",
)


@query(
    "chart_shape",
    """WITH c AS (SELECT id, max(chart_type) AS ct, count(*) AS n, bool_or(value < 0) AS neg, sum(value) AS s, count(DISTINCT value) AS d FROM charts GROUP BY id)
       SELECT id, CASE WHEN n NOT BETWEEN 4 AND 8 THEN 'point_count' WHEN neg THEN 'negative_value' WHEN ct = 'pie' AND s NOT BETWEEN 99 AND 101 THEN 'pie_total' WHEN d = 1 THEN 'all_equal' END AS code FROM c""",
)
def chart_shape(t: Tables):
    items = t.charts.groupBy("id").agg(F.max("chart_type").alias("chart_type"), F.array_sort(F.collect_list(F.struct("label", "value"))).alias("points"))
    named = items.select("id", "chart_type", "points", F.lit("t").alias("title"), F.lit("s").alias("subject"), F.lit("u").alias("unit"))
    return named.select("id", Q.chart_reason().alias("code"))


@query(
    "solver_agreement",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
       SELECT user_id AS item_id, CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN n END), 0) AS BIGINT) AS agree, CAST(sum(n) AS BIGINT) AS votes,
       arg_max(event_type, n * 1000 + ascii(event_type) * 1.0 + ascii(substr(event_type, 2, 1)) / 1000.0) AS commonest, coalesce(sum(CASE WHEN event_type = 'click' THEN n END), 0) >= 3 AS accepted FROM c GROUP BY user_id""",
)
def solver_agreement(t: Tables):
    items = t.events.select(F.col("user_id").alias("item_id")).distinct().withColumn("answer", F.lit("click"))
    votes = t.events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("vote"))
    return Q.solver_agreement(items, votes).drop("answer")


@query(
    "grader_spread",
    """SELECT user_id, event_type, count(value) AS runs, min(value) AS "min", max(value) AS "max", round(max(value) - min(value), 6) AS "range", round(avg(value) + 1e-9, 2) AS mean, round(stddev_pop(value) + 1e-9, 2) AS stdev
       FROM events GROUP BY user_id, event_type""",
)
def grader_spread(t: Tables):
    return Q.repeatability(t.events, ["user_id", "event_type"], "value").withColumn("range", F.round("range", 6))


@query(
    "grader_inversions",
    """WITH m AS (SELECT user_id, event_type, round(avg(value) + 1e-9, 2) AS mean FROM events GROUP BY user_id, event_type),
       w AS (SELECT user_id, mean, lag(mean) OVER (PARTITION BY user_id ORDER BY event_type) AS p FROM m)
       SELECT user_id, count(*) FILTER (WHERE p > mean) AS inversions FROM w GROUP BY user_id""",
)
def grader_inversions(t: Tables):
    means = Q.repeatability(t.events, ["user_id", "event_type"], "value")
    return Q.quality_ranks(means, "user_id", "event_type")


derive("sent", "SELECT source AS batch, doc_id, lang, n_chars FROM documents")
derive("returned", "SELECT source AS batch, CASE WHEN doc_id % 53 = 0 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 71 <> 0")


@query(
    "batch_reconcile",
    """WITH j AS (SELECT r.batch, r.doc_id, s.doc_id AS k, s.lang AS sl, r.lang AS rl FROM returned r LEFT JOIN sent s ON r.batch = s.batch AND r.doc_id = s.doc_id)
       SELECT batch, doc_id, 'UNKNOWN_ROW' AS code, '' AS field FROM j WHERE k IS NULL
       UNION ALL SELECT batch, doc_id, 'CHANGED_FIELD', 'lang' FROM j WHERE k IS NOT NULL AND sl <> rl
       UNION ALL SELECT a.batch, NULL, 'COUNT_MISMATCH', CAST(a.n AS STRING) || '/' || CAST(coalesce(b.n, 0) AS STRING) FROM (SELECT batch, count(*) AS n FROM sent GROUP BY batch) a
         LEFT JOIN (SELECT batch, count(*) AS n FROM returned GROUP BY batch) b USING (batch) WHERE a.n <> coalesce(b.n, 0)""",
)
def batch_reconcile(t: Tables):
    return Q.reconcile(t.sent, t.returned, "doc_id", ["lang", "n_chars"])


@query(
    "lesson_freshness",
    """WITH f AS (SELECT key, count(*) AS n FROM contract_findings WHERE "check" = 'skill_teaching' GROUP BY key)
       SELECT id AS lesson_id, CASE WHEN ord % 19 = 0 THEN 'missing' WHEN coalesce(f.n, 0) > 0 THEN 'stale' ELSE 'ok' END AS status, coalesce(f.n, 0) AS problems
       FROM skills LEFT JOIN f ON f.key = skills.id""",
)
def lesson_freshness(t: Tables):
    skills = _skills(t)
    wanted = skills.withColumnRenamed("id", "lesson_id")
    stored = wanted.filter(F.col("ord") % 19 != 0)
    return Q.lesson_status(wanted, stored, Q.teaching_findings(skills))
