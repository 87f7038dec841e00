"""Queries over nested JSON documents: leaves, artifacts, equations, readability."""

from pyspark.sql import functions as F

from quire.functions import json_tree
from quire.operators import quality as Q
from quire.plans.registry import Tables, derive, query

# Lessons: every line of a text in nested fields, with wrong sums among the problems and mistakes.
derive(
    "lesson_json",
    """SELECT doc_id, to_json(named_struct(
         'common_mistakes', transform(l, (x, i) -> named_struct('fix', concat('Say ', x), 'mistake', concat('$', i, '+1=', i + 3, '$ ', x))),
         'core_method', named_struct('formula', concat('$$', doc_id, '*2=', doc_id * 2, '$$'), 'minutes', doc_id % 50, 'summary', l[0]),
         'provenance_note', concat(' ', l[0], ' :contentReference[oaicite:', doc_id, ']{index=1}'),
         'worked_examples', transform(l, (x, i) -> named_struct('annotations', array(named_struct('note', concat(x, '  :contentReference[oaicite:1]{index=0}'))),
            'input', concat('$$', i, '+2=', i + 1, '$$'), 'model_answer', concat('$$', doc_id, '+', i, '=', doc_id + i + CASE WHEN (doc_id + i) % 50 = 0 THEN 1 ELSE 0 END, '$$ ', x))))) AS json
       FROM (SELECT doc_id, split(replace(text, '$', ' '), chr(10)) AS l FROM documents)""",
    """SELECT doc_id, to_json({
         'common_mistakes': list_transform(l, lambda x, i: {'fix': 'Say ' || x, 'mistake': '$' || (i - 1) || '+1=' || (i + 2) || '$ ' || x}),
         'core_method': {'formula': '$$' || doc_id || '*2=' || (doc_id * 2) || '$$', 'minutes': doc_id % 50, 'summary': l[1]},
         'provenance_note': ' ' || l[1] || ' :contentReference[oaicite:' || doc_id || ']{index=1}',
         'worked_examples': list_transform(l, lambda x, i: {'annotations': [{'note': x || '  :contentReference[oaicite:1]{index=0}'}],
            'input': '$$' || (i - 1) || '+2=' || i || '$$', 'model_answer': '$$' || doc_id || '+' || (i - 1) || '=' || (doc_id + i - 1 + CASE WHEN (doc_id + i - 1) % 50 = 0 THEN 1 ELSE 0 END) || '$$ ' || x})}) AS json
       FROM (SELECT doc_id, string_split(replace(text, '$', ' '), chr(10)) AS l FROM documents)""",
)
derive(
    "lesson_leaves",
    "SELECT 1 AS unused",
    """SELECT doc_id, j.id AS place, j.fullkey AS json_path, j.key AS name, CASE WHEN j.type = 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END AS kind, j.atom ->> '$' AS value
       FROM lesson_json, json_tree(lesson_json.json) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')""",
)


def _leaves(t: Tables):
    return json_tree.leaves(t.lesson_json, ["doc_id"])


@query("document_leaves", "SELECT doc_id, json_path, kind, value FROM lesson_leaves")
def document_leaves(t: Tables):
    return _leaves(t).select("doc_id", "json_path", "kind", "value")


@query(
    "document_artifacts",
    r"""SELECT doc_id, json_path, CASE WHEN kind = 'STRING' THEN trim(regexp_replace(value, '\s*:contentReference\[[^\]]*\]\{[^}]*\}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) ELSE value END AS value
       FROM lesson_leaves""",
)
def document_artifacts(t: Tables):
    return Q.strip_document_artifacts(_leaves(t)).select("doc_id", "json_path", "value")


@query(
    "document_equations",
    r"""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(value, '\$+([^$]+)\$+', 1)) AS chain FROM lesson_leaves WHERE NOT regexp_matches(json_path, '\.(input|mistake|misconception)(\.|\[|$)')),
       p AS (SELECT *, list_transform(regexp_split_to_array(chain, '[+*=]'), lambda x: CAST(x AS BIGINT)) AS v FROM c)
       SELECT doc_id, chain, CASE WHEN (contains(chain, '*') AND v[1] * v[2] = v[3]) OR (contains(chain, '+') AND v[1] + v[2] = v[3]) THEN 'true' ELSE 'false' END AS verdict FROM p""",
)
def document_equations(t: Tables):
    return Q.check_chains(Q.document_chains(_leaves(t), ["doc_id"])).select("doc_id", "chain", "verdict")


@query(
    "document_readability",
    r"""SELECT doc_id,
        len(list_filter(regexp_split_to_array(plain, '[.!?]+'), lambda p: len(list_filter(regexp_split_to_array(p, '[ \n]+'), lambda t: t <> '')) >= 3)) AS sentences, len(w) AS words,
        CAST(coalesce(list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda a: CASE WHEN a = '' THEN 0
            ELSE greatest(1, len(regexp_extract_all(a, '[aeiouy]+')) - CASE WHEN a LIKE '%e' AND len(regexp_extract_all(a, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END)), 0) AS BIGINT) AS syllables
        FROM (SELECT *, regexp_extract_all(plain, '[A-Za-z'']+') AS w
              FROM (SELECT doc_id, regexp_replace(string_agg(value, ' ' ORDER BY place), '\$\$.+?\$\$|\$[^$]*\$|\\[a-zA-Z]+\{[^{}]*\}', ' ', 'g') AS plain FROM lesson_leaves
                    WHERE kind = 'STRING' AND name NOT IN ('model_answer', 'example', 'formula', 'input', 'item', 'source_label', 'schema_version', 'task_type', 'tags') GROUP BY doc_id))""",
)
def document_readability(t: Tables):
    measured = Q.readability(json_tree.prose(_leaves(t), ["doc_id"]), ["doc_id"])
    return measured.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("sentences", "words", "syllables")])
