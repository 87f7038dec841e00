"""Operators against brute force and plain rules on small tables."""

import json
import random
import re
from fractions import Fraction
from math import gcd

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, first_per_key, ordered_scan, read_once, salted_join, tile_of_integer
from quire.operators import audits as A
from quire.operators import claims as L
from quire.operators import concepts as C
from quire.plans import catalog
from quire.operators import contract as K
from quire.operators import grounding as G
from quire.operators import packages as P
from quire.operators import practice as M
from quire.operators import quality as Q
from quire.operators import retrieval as R
from quire.operators.findings import check_health
from quire.sources import chunks as Ch
from quire.sources import store as St
from quire.streaming import schedule as S


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# -- skew-safe pieces -------------------------------------------------------------------------------------
def test_first_per_key_and_salted_join_with_one_hot_key(spark):
    hot = [("k", i, f"v{i}") for i in range(500)] + [(f"c{i}", i, "x") for i in range(20)]
    df = spark.createDataFrame(hot, "k string, o int, v string").repartition(7)
    got = {r.k: r.v for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert got["k"] == "v0" and len(got) == 21
    small = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(df, small, ["k"], "inner", F.col("o"))
    assert joined.count() == 520 and joined.filter("k = 'k' and n = 500").count() == 500


# -- grounding ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_locate_quotes_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "dd", "ee"]
    texts = [(f"n{i}", i, f"s{i % 2}", " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(40)]
    texts += [(f"copy{i}", 100 + i, "s0", texts[0][3]) for i in range(30)]
    quotes = []
    for q in range(60):
        if q % 3 == 0:
            words = " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 6)))
        else:
            src = rng.choice(texts)[3]
            a = rng.randint(0, len(src) - 1)
            words = src[a : a + 14].strip()
        if len(words.split()) >= 4:
            quotes.append((q, f"s{q % 2}", " ".join(words.split())))
    chunks = spark.createDataFrame(texts, "node_id string, ord long, scope string, norm string")
    qs = spark.createDataFrame(quotes, "quote_id long, scope string, norm string")
    got = {r.quote_id: r.node_id for r in G.locate_quotes(qs, chunks, ["scope"]).collect()}
    want = {}
    for q, s, n in quotes:
        hits = sorted((o, i) for i, o, sc, t in texts if sc == s and n in t)
        if hits:
            want[q] = hits[0][1]
    assert got == want and want


def test_spans_report_every_error(spark):
    chunks = spark.createDataFrame([("c1", "The quick brown fox jumps."), ("c2", "")], "node_id string, text string")
    spans = spark.createDataFrame(
        [("a", 0, " c1 ", "quick  brown fox jumps", ["c1"]), ("a", 1, "c1", "quick brown fox jumps", ["c1"]), ("b", 0, "c1", "slow brown fox jumps", ["c1"]),
         ("c", 0, "c9", "one two three four", ["c9"]), ("d", 0, "c1", "fox", []), ("e", 0, "", "x", ["c1"])],
        "claim_id string, i int, node_id string, quote string, source_ids array<string>",
    )
    got = {(r.claim_id, r.i): (r.codes, r.verified) for r in G.verify_spans(spans, chunks).collect()}
    assert got[("a", 0)] == ([], True) and got[("a", 1)] == (["DUPLICATE_EVIDENCE_SPAN"], True)
    assert got[("b", 0)] == (["EVIDENCE_SPAN_QUOTE_NOT_FOUND"], False) and got[("c", 0)] == (["SOURCE_CHUNK_ID_NOT_FOUND"], False)
    assert got[("d", 0)] == (["EVIDENCE_SPAN_NODE_NOT_CITED", "EVIDENCE_SPAN_QUOTE_TOO_SHORT"], False)
    assert got[("e", 0)] == (["SOURCE_CHUNK_ID_NOT_FOUND"], False)


def test_contract_text_composes(spark):
    df = spark.createDataFrame([("ﬁne  print ①",), ("plain",), (None,)], "t string")
    assert [r.t for r in df.select(T.contract_text("t").alias("t")).collect()] == ["fine print 1", "plain", None]


def test_chapter_claims_of_both_versions(spark):
    doc = {
        "chapter_number": 3, "chapter_title": "T", "source_chunk_ids": ["c1"], "chapter_summary": "Sum",
        "learning_objectives": ["Know it", {"objective": "Do it", "source_chunk_ids": []}, "  "],
        "key_terms": [{"term": "t", "meaning": {"text": "M", "origin": "source_grounded", "claim_kind": "definition", "source_chunk_ids": ["c2", "c2"]}}],
        "worked_examples": ["not an object", {"title": "e", "example": "E", "explanation": None}],
        "review_checklist": [{"text": "R", "origin": "pedagogical_generation", "claim_kind": "self_assessment", "source_chunk_ids": []}],
        "estimated_study_time_minutes": 20,
    }
    df = spark.createDataFrame([("d", 0, json.dumps(doc))], "doc string, chapter_index int, document string")
    claims = L.chapter_claims(df)
    got = {r.claim_id: (r.claim_text, r.citation_origin, r.source_chunk_ids) for r in claims.collect()}
    assert got == {
        "chapter_03.chapter_summary": ("Sum", "inherited_chapter", ["c1"]),
        "chapter_03.learning_objectives.0": ("Know it", "inherited_chapter", ["c1"]), "chapter_03.learning_objectives.1": ("Do it", "none", []),
        "chapter_03.key_terms.0.meaning": ("M", "local", ["c2", "c2"]), "chapter_03.worked_examples.1.example": ("E", "none", []),
        "chapter_03.review_checklist.0": ("R", "none", []),
        "chapter_03.estimated_study_time_minutes": ("Estimated study time: 20 minutes.", "none", []),
    }
    assert rows(L.claim_problems(claims), "claim_id", "code") == [("chapter_03.key_terms.0.meaning", "DUPLICATE_SOURCE_ID")]


def test_chapter_claims_read_each_part_of_an_item_once(spark):
    """An expression inside a list's lambda is worked out at every mention: an item's object, ids, title and text parts stand there once."""
    df = spark.createDataFrame([("d", 0, "{}")], "doc string, chapter_index int, document string")
    plan = L.chapter_claims(df)._jdf.queryExecution().optimizedPlan().toString()
    fields = L.CHAPTER_FIELDS
    reads = 4 + sum(5 + (f[1] is not None) + (f[0] in L.CONTEXT_KEY) + len(f[4]) for f in fields)  # origin, text, kind, ids, the item's own ids
    assert plan.count("get_json_object") == reads


def test_chapter_claims_of_odd_items(spark):
    """Items that are null, blank, no objects, broken or of an unknown origin; ids of the text before those of its item."""
    meaning = lambda origin, **more: {"text": "M", "origin": origin, **more}
    doc = {
        "chapter_number": 1, "source_chunk_ids": ["c1"], "chapter_summary": meaning("source_grounded", source_chunk_ids=["s"]),
        "learning_objectives": [None, "\u00a0\u2003\x1c", "{broken", {"text": " ", "description": "D"}, 5, meaning("other")],
        "key_terms": [
            None, "plain", {"meaning": meaning("source_grounded"), "source_chunk_ids": ["i"]}, {"meaning": meaning("other", source_chunk_ids=["x"])},
            {"meaning": meaning("pedagogical_generation", source_chunk_ids=["t"]), "source_chunk_ids": ["i"]}, {"term": "none"}, {"meaning": "P", "source_chunk_ids": None},
        ],
    }
    df = spark.createDataFrame([("d", 0, json.dumps(doc)), ("e", 0, None)], "doc string, chapter_index int, document string")
    got = {r.claim_id.removeprefix("chapter_01."): (r.claim_text, r.citation_origin, r.source_chunk_ids, r.grounded_origin) for r in L.chapter_claims(df).collect()}
    assert got == {
        "chapter_summary": ("M", "local", ["s"], "source_grounded"), "learning_objectives.3": ("D", "inherited_chapter", ["c1"], None),
        "learning_objectives.4": ("5", "inherited_chapter", ["c1"], None), "learning_objectives.5": ("M", "inherited_chapter", ["c1"], None),
        "key_terms.2.meaning": ("M", "local", ["i"], "source_grounded"), "key_terms.4.meaning": ("M", "local", ["t"], "pedagogical_generation"),
        "key_terms.6.meaning": ("P", "none", [], None),
    }


def test_blank_is_what_strip_leaves_empty(spark):
    made = [(a + chr(c) + b,) for c in range(0x10000) if not 0xD800 <= c < 0xE000 for a, b in (("", ""), (" \n", "\x1c"))]
    df = spark.createDataFrame([*made, ("",), ("\r\n \x85",), ("\U0001d7ce",), (None,)], "t string")
    assert df.filter(T.blank("t") != F.coalesce(T.strip("t") == "", F.lit(True))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_scope_ends_at_any_level(spark, seed):
    """The next section that is no deeper, against a walk; levels far apart and beyond ten, and sections without one."""
    draw = random.Random(seed)
    rows_ = [("d", 1, i, f"Topic {i}", draw.choice([0, 1, 2, 10, 11, 40, None])) for i in range(40)]
    df = spark.createDataFrame(rows_, "doc string, chapter_number int, position int, section string, level int")
    got = {r.position: r.end for r in R.scope_ends(df).collect()}
    assert len(got) == 40
    for _, _, i, _, level in rows_:
        if level is None:
            assert got[i] == i + 2
            continue
        end = next((j for j in range(i + 1, 40) if rows_[j][4] is None or rows_[j][4] <= level), 40)
        # a plain title without descendants keeps to itself
        assert got[i] == (end + 1 if end > i + 1 else i + 2)


def test_batches_of_one_document_with_a_large_bundle(spark):
    """A third of the claims in one bundle, every other bundle small: batches by first claim, at most three claims each."""
    draw = random.Random(4)
    made = [("d", 7 * i, None if i % 5 == 0 else draw.randint(1, 40), ["a"] if i % 5 else ["b"]) for i in range(300)]
    made = [(d, o, 1, ["a"]) if i % 3 == 0 else (d, o, c, x) for i, (d, o, c, x) in enumerate(made)]
    df = spark.createDataFrame(made, "doc string, ord long, chapter_number int, source_chunk_ids array<string>")
    got = {r.ord: (r.batch_number, r.batch_claims) for r in L.plan_batches(df, 3).collect()}
    bundles = {}
    for _, o, c, x in made:
        bundles.setdefault((c, tuple(x)), []).append(o)
    want, number = {}, 0
    for orders in sorted(bundles.values(), key=min):
        for k in range(0, len(orders), 3):
            number += 1
            want |= {o: (number, len(orders[k : k + 3])) for o in orders[k : k + 3]}
    assert got == want


def test_book_claims(spark):
    doc = {"book_overview": "O", "who_this_is_for": ["A", {"description": "B"}], "study_plan": [{"week": 1, "focus": "F", "activities": ["x"]}], "final_review": {"summary": "S", "questions": ["Q"]}}
    df = spark.createDataFrame([("d", json.dumps(doc))], "doc string, materials string")
    assert sorted(rows(L.book_claims(df), "claim_id", "claim_text")) == sorted([
        ("book.book_overview", "O"), ("book.who_this_is_for.0", "A"), ("book.who_this_is_for.1", "B"), ("book.study_plan.0.focus", "F"),
        ("book.study_plan.0.activities.0", "x"), ("book.final_review.summary", "S"), ("book.final_review.questions.0", "Q")])


def test_normalised_claims_downgrade(spark):
    chunks = spark.createDataFrame([("c1", "one two three four five")], "node_id string, text string")
    allowed = chunks.select(F.lit("d").alias("doc"), "node_id")
    schema = "claim_id string, doc string, text string, claim_kind string, origin string, source_chunk_ids array<string>, grounded_in_source_chunk_ids array<string>, evidence_spans array<struct<node_id:string,quote:string>>, reason string"
    good = [("c1", "two three four five")]
    df = spark.createDataFrame(
        [("ok", "d", "t", "definition", "source_grounded", [" c1", "x"], [], good, "r"), ("noid", "d", "t", "definition", "source_grounded", ["x"], [], [], None),
         ("nospan", "d", "t", "official_rule", "source_grounded", ["c1"], [], [("c1", "six seven eight nine")], None), ("mis", "d", "t", "misconception_statement", "source_grounded", ["c1"], ["c1"], good, None),
         ("gen", "d", "t", "definition", "pedagogical_generation", [], ["c1"], [], None), ("ins", "d", "t", "definition", "insufficient_source_evidence", [], [], [], " ")], schema)
    got = {r.claim_id: r for r in G.normalise_claims(df, chunks, allowed).collect()}
    assert got["ok"].source_chunk_ids == ["c1"] and got["ok"].reason is None and len(got["ok"].evidence_spans) == 1
    assert got["noid"].reason == G.NO_CITATION and got["noid"].text is None and got["nospan"].reason == G.NO_SPAN_HIGH_RISK
    assert got["mis"].origin == "pedagogical_generation" and got["mis"].grounded_in_source_chunk_ids == ["c1"]
    assert got["gen"].reason == G.WRONG_KIND and got["ins"].reason == G.NOT_ENOUGH


def test_judged_results_accept_and_raise(spark):
    claims = spark.createDataFrame([("a", ["c1"], "time limit is short", "{}", "k"), ("b", ["c1"], "plain", "{}", "k")], "claim_id string, source_chunk_ids array<string>, claim_text string, context string, claim_type string")
    raw = spark.createDataFrame([("a", "SUPPORTED", "definition", "LOW", "HIGH", " why  so ", ["c1"]), ("z", "SUPPORTED", "definition", "LOW", "HIGH", "w", [])],
        "claim_id string, support_status string, claim_nature string, severity string, confidence string, rationale string, evidence_chunk_ids_used array<string>")
    good, bad = L.judged_results(claims, raw)
    r = good.collect()
    assert len(r) == 1 and (r[0].severity, r[0].severity_floor_applied, r[0].rationale, r[0].recommended_action) == ("HIGH", True, "why so", "keep")
    assert sorted(rows(bad, "claim_id", "code")) == [("b", "MISSING_RESULT"), ("z", "EXTRA_RESULT")]


def test_section_lesson_audit_passes_a_clean_lesson_and_fails_order(spark):
    lesson = "lesson_id string, retrieved_chunk_count int, resolved_chapter int, filter_chapter int, front_matter boolean, requested_section string, include_descendants boolean, ordering string, expanded_count int, covered_count int, missing_count int, covered_titles array<string>, missing_titles array<string>"
    lessons = spark.createDataFrame([(i, 2, 1, None, False, "Intro", True, "document", 1, 1, 0, ["Intro"], []) for i in ("good", "bad")], lesson)
    chunk = "lesson_id string, i int, node_id string, text_preview string, chapter_number int, section string, page_start int, page_end int"
    chunks = spark.createDataFrame([("good", 0, "a", "Intro words", 1, "Intro", 1, 1), ("good", 1, "b", "more", 1, "Intro", 2, 2), ("bad", 0, "a", "Intro", 1, "Intro", 3, 3), ("bad", 1, "b", "more", 1, "Intro", 2, 2)], chunk)
    titles = lessons.select("lesson_id", F.lit("Intro").alias("section"))
    positions = spark.createDataFrame([(1, "Intro", 1)], "chapter_number int, section string, position int")
    found = A.section_lesson_findings(lessons, chunks, chunks.select("lesson_id", "node_id"), titles, positions)
    assert sorted(rows(A.audit_status(lessons, found), "lesson_id", "status")) == [("bad", "FAIL"), ("good", "PASS")]
    assert rows(found, "key", "code") == [("bad", "ORDER_BREAK")]


# -- quality ---------------------------------------------------------------------------------------------------
def plain_measures(text):
    import re

    sentences = [s for s in re.split(r"[.!?]+", text) if len(s.split()) >= 3]
    words = re.findall(r"[A-Za-z']+", text)

    def syll(w):
        w = re.sub("[^a-z]", "", w.lower())
        n = len(re.findall("[aeiouy]+", w))
        return 0 if not w else max(1, n - (1 if w.endswith("e") and n > 1 else 0))

    return len(sentences), len(words), sum(map(syll, words))


def test_text_measures_match_a_word_by_word_count(spark):
    rng = random.Random(5)
    alphabet = "aeiouybcdfgst'e .!?\n-é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["The agree tree. We're done, are you? Rhythm e ee eye queue here.", "'", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in Q.readability(df, ["i"]).collect():
        assert (r.sentences, r.words, r.syllables) == plain_measures(texts[r.i]), texts[r.i]


def test_gap_snippets(spark):
    df = spark.createDataFrame([("a", "x the  quick  brown fox"), ("b", "  "), ("c", "No gap Here  There")], "id string, text string")
    got = {r.id: r for r in Q.extraction_damage(df, ["id"]).collect()}
    assert got["a"].gap_count == 1 and got["a"].snippets == ["x the  quick  brown fox"] and got["b"].code == "EMPTY" and "c" not in got


def test_equations(spark):
    df = spark.createDataFrame([(r"so $\frac{1}{2} + 1 = 1.5$ and $2 \times 3 = 7,\qquad 4 = 4$ or $15,000 \div 30 = 500$ with $x = y$",)], "text string")
    got = {r.chain: r.verdict for r in Q.check_chains(Q.equation_chains(df, [])).collect()}
    by = {k.replace("\\", ""): v for k, v in got.items()}
    assert [v for k, v in by.items() if "times" in k] == ["false"] and [v for k, v in by.items() if "div" in k] == ["true"] and by["x = y"] == "unchecked"


def test_side_is_matched_once(spark):
    df = spark.createDataFrame([(r"$\frac{1}{2} = 0.5 = 2/4$ $3 \div 2 = 1.5$ $1 - 2/3 = 1/2$ $x|y = 1|2$ $5. = 5 \cdot 1$",)], "text string")
    checked = Q.check_chains(Q.equation_chains(df, []))
    assert {r.chain: (r.verdict, r.sides) for r in checked.collect()} == {
        r"\frac{1}{2} = 0.5 = 2/4": ("true", 3), r"3 \div 2 = 1.5": ("true", 2), "1 - 2/3 = 1/2": ("false", 2), "x|y = 1|2": ("unchecked", 0), r"5. = 5 \cdot 1": ("unchecked", 1),
    }
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 0


def test_equations_of_any_length(spark):
    """Sides beyond 9 digits and 6 decimals are read; one beyond 38 digits is counted and never makes a chain true."""
    long = "1" * 25
    cases = {
        "12345678901 = 12345678902": ("false", 0), "0.12345678 = 12345678/100000000": ("true", 0), f"{long} = {long}": ("true", 0), f"{long} + 1 = {long[:-1]}2": ("true", 0),
        f"{'9' * 40} = 1 = 1": ("unchecked", 1), f"{'9' * 40} = 1 = 2": ("false", 1), f"{long} * {long} = 5 = 5": ("unchecked", 1), f"1/0 = 1 = 1": ("true", 0),
    }
    df = spark.createDataFrame([(c,) for c in cases], "chain string")
    assert {r.chain: (r.verdict, r.unread) for r in Q.check_chains(df).collect()} == cases


def test_check_health_needs_its_planted_rows(spark):
    base = spark.createDataFrame([("1", "procedure", "n", "clear words that explain it", ["a b c", "d e f"], ["e"], "wrong line read")], "id string, kind string, name string, explanation string, steps array<string>, examples array<string>, common_mistake string")
    bad = base.withColumn("explanation", F.lit(""))
    assert check_health("t", Q.teaching_findings, base, bad, "id").first().healthy
    assert not check_health("t", Q.terse_step_findings, base, bad, "id").first().healthy


# -- concepts ------------------------------------------------------------------------------------------------------
def test_vocabulary_and_stem(spark):
    df = spark.createDataFrame([("Rounding fractions to lines; the ponies $\\frac{1}{2}$ grade classes making",)], "t string")
    assert sorted(df.select(C.vocabulary("t").alias("v")).first().v) == sorted({"round", "fraction", "lin", "pony", "grad", "class", "mak"})


@pytest.mark.parametrize("seed", range(3))
def test_match_concepts_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    sents = [(i, rng.sample(words, rng.randint(1, 8))) for i in range(30)]
    cands = [(f"k{i}", rng.sample(words, rng.randint(1, 5))) for i in range(10)]
    got = {(r.sentence_id, r.key): r.score for r in C.match_concepts(
        spark.createDataFrame(sents, "sentence_id int, vocab array<string>"), spark.createDataFrame(cands, "key string, vocab array<string>")).collect()}
    spread = {w: sum(w in v for _, v in cands) for w in words}
    want = {}
    for i, sv in sents:
        for k, cv in cands:
            s = round(sum(1 / spread[w] for w in set(sv) & set(cv)), 6)
            if s >= 1.0:
                want[(i, k)] = s
    assert got == pytest.approx(want) and want


# -- marking ------------------------------------------------------------------------------------------------------------
def test_assignment_reads_the_matches_once(spark):
    """Best, ties and a key without a match, from one reading of the matches."""
    rows = [(1, "a", 2.0, 0.5, 0.5), (2, "a", 2.0, 0.5, 0.4), (3, "b", 1.0, 0.5, 0.5), (4, "b", 1.0, 0.5, 0.5), (5, "b", 1.0, 0.4, 0.9), (6, None, 9.0, 0.5, 0.5)]
    reads = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(rows, "sentence_id long, key string, score double, of_sentence double, of_candidate double").mapInPandas(
        lambda parts: (reads.add(len(p)) or p for p in parts), "sentence_id long, key string, score double, of_sentence double, of_candidate double"
    )
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "key string")
    got = C.assign_concepts(keys, counted.withColumn("ord", F.col("sentence_id"))).collect()
    assert {(r.key, r.sentence_id, r.score, r.ties) for r in got} == {("a", 1, 2.0, 1), ("b", None, None, 2), ("c", None, None, 0), (None, None, None, 0)}
    assert reads.value == len(rows)


def test_proposals_find_the_matches_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "alpha gamma\nbeta delta", "en", "book", 22), (2, "kappa\nother", "en", "book", 11)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha lambda"), (2, "beta kappa")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    reads, made = spark.sparkContext.accumulator(0), C.match_concepts

    def counted(*a):
        found = made(*a)
        return found.mapInPandas(lambda parts: (reads.add(len(p)) or p for p in parts), found.schema)

    monkeypatch.setattr(C, "match_concepts", counted)
    rows = catalog.QUERIES["concept_proposals"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 and sorted(r.bank for r in rows if r.bank) == ["k1", "k2"]
    assert reads.value == 3


def test_vocabulary_stems_like_the_patterns(spark):
    words = "sing thing being string bring ring sixties ties dies boxes cases class gas canes see there tree ages rings lining bees ingle oxeye y ee"
    got = spark.createDataFrame([(words.upper(),)], "t string").select(C.vocabulary("t").alias("v"), F.transform(F.split(F.lit(words), " "), C.stem).alias("w")).first()
    stop = set(C.EVERYDAY_WORDS)
    want = [s for w, s in zip(words.split(), got.w) if len(w) >= 3 and w not in stop and s not in stop]
    assert got.v == list(dict.fromkeys(want))


def test_number_marks_match_exact_fractions(spark):
    cases = [("1/2", 1, 2), ("2/4", 1, 2), ("-1 1/2", -3, 2), ("0.50", 1, 2), ("4,900", 4900, 1), ("1,000/2,000", 1, 2), ("−3/4", -3, 4), (" 8 ", 8, 1), ("3/0", 3, 1),
             ("x", 1, 1), ("", 1, 1), ("0/5", 0, 1), ("6/1", 6, 1), ("2 3/6", 5, 2), ("-0.25", -1, 4), ("1 / 3", 1, 3)]
    df = spark.createDataFrame([(i, t, n, d) for i, (t, n, d) in enumerate(cases)], "i int, t string, n long, d long")
    got = {r.i: r.m for r in df.select("i", M.mark_number(F.col("t"), F.col("n"), F.col("d")).alias("m")).collect()}
    want = {
        "1/2": (True, False), "2/4": (False, True), "-1 1/2": (True, False), "0.50": (True, False), "4,900": (True, False), "1,000/2,000": (True, False), "−3/4": (True, False), " 8 ": (True, False),
        "3/0": (False, False), "x": (False, False), "": (False, False), "0/5": (False, True), "6/1": (True, False), "2 3/6": (False, True), "-0.25": (True, False), "1 / 3": (True, False),
    }
    for i, (t, _, _) in enumerate(cases):
        assert (got[i].correct, got[i].not_simplest) == want[t], t
    assert not got[9].readable and got[0].readable


def test_numbers_of_any_length(spark):
    """Typed numbers beyond 18 digits and 6 decimals, against Python's fractions."""
    big = "1" + "0" * 40
    cases = [
        ("1234567890123456789", 1234567890123456789, 1), ("0.12345678", 12345678, 100000000), ("0.12345678", 6172839, 50000000),
        (f"{big}/{big}", 1, 1), (f"3{'0' * 30}/4{'0' * 30}", 3, 4), ("0.5" + "0" * 60, 1, 2), ("0" * 50 + "7", 7, 1), (f"{big}", 1, 1), ("-0.25000000000000000000001", -1, 4),
        ("-3 1/2", -7, 2), ("-0 1/2", 1, 2), ("-0 1/2", -1, 2), ("2 2/4", 5, 2), ("0/5", 0, 1), ("5/0", 5, 1), ("1 2", 12, 1), ("1 2.5", 5, 2), ("9" * 25 + " 1/2", 3, 2), ("-3/4", -3, 4), ("3/4", -3, 4), ("-0", 0, 1), (None, 1, 1),
    ]
    df = spark.createDataFrame([(i, t, n, d) for i, (t, n, d) in enumerate(cases)], "i int, t string, n long, d long")
    got = {r.i: r.m for r in df.select("i", M.mark_number(F.col("t"), F.col("n"), F.col("d")).alias("m")).collect()}
    for i, (t, n, d) in enumerate(cases):
        m = re.fullmatch(r"(-?)(?:(\d+)\s+(?=\d+/))?(\d+)(?:/(\d+)|\.(\d+))?", t or "x")
        value = None
        if m and m[4] is None or m and int(m[4]):
            whole, top = int(m[2] or 0), Fraction(int(m[3] + (m[5] or "")), int(m[4] or 10 ** len(m[5] or "")))
            value = (whole + top) * (-1 if m[1] and not (m[2] and not whole) else 1)
        equal = value == Fraction(n, d) if value is not None else False
        unreduced = bool(equal and m[4] and int(m[4]) > 1 and gcd(int(m[3]), int(m[4])) > 1)
        assert (got[i].readable, got[i].equal, got[i].correct, got[i].not_simplest) == (value is not None, equal, equal and not unreduced, unreduced), t
    ratio = spark.createDataFrame([(f"5{'0' * 30}:4{'0' * 30}",), ("0" * 30 + "5 to 4",), ("1" * 40 + ":4",)], "t string").select(M.mark_ratio(F.col("t"), F.lit(5), F.lit(4)).alias("m")).collect()
    assert [(r.m.equal, r.m.correct, r.m.readable) for r in ratio] == [(True, False, True), (True, True, True), (False, False, True)]


def test_overlapping_damage_snippets(spark):
    text = "an  ox is on  it and  so it  was"
    row = Q.extraction_damage(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).first()
    want = [text[max(0, m.start() - 18) : m.end() + 18].strip() for m in re.finditer(r"\b[a-z]{1,6}\b {2,}\b[a-z]{1,6}\b", text)]
    assert row.gap_count == len(want) == 4 and row.snippets == want[:3]


def test_gcd_and_ratio(spark):
    pairs = [(random.Random(i).randint(1, 10**17), random.Random(i + 99).randint(1, 10**17)) for i in range(20)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").select(M.gcd(M._dec(F.col("a")), M._dec(F.col("b"))).alias("g"), "a", "b")
    assert all(int(r.g) == gcd(int(r.a), int(r.b)) for r in df.collect())
    r = spark.createDataFrame([("5 to 4",), ("10:8",), ("5to4",), ("0:4",)], "t string").select(M.mark_ratio(F.col("t"), F.lit(5), F.lit(4)).alias("m")).collect()
    assert [(x.m.correct, x.m.equal, x.m.readable) for x in r] == [(True, True, True), (False, True, True), (False, False, False), (False, False, False)]


def test_stated_numbers(spark):
    said = spark.createDataFrame([("a", v) for v in (8000.0, 77.0, 80.0, 3.0, 12.5, 100.0)], "k string, number double")
    allowed = spark.createDataFrame([("a", 7800.0), ("a", 80.0), ("a", 12.46)], "k string, number double")
    assert sorted(r.number for r in M.unsupported_numbers(said, allowed, ["k"]).collect()) == [77.0]  # 100 may stand for 80


def test_tolerance_of_all_decimals(spark):
    stated = {0.1: 0.05, 12.46: 0.005, 0.12345678: 0.5e-8, 1.25e-5: 0.5e-7, 1e-7: 0.5e-7, 12345678.5: 0.05, 300.0: 50.0, 7.0: 0.5, 0.0: 5.0}
    df = spark.createDataFrame([(v,) for v in stated], "v double").select("v", M.stated_tolerance(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == pytest.approx(stated)


def test_working(spark):
    df = spark.createDataFrame([("we do 3 / 6 and get 1 1/2", ["3/6"], ["1/4"]), ("it is 3/2 and 1/2 of it", ["3/6"], ["1/2"]), (r"\frac{3}{6} is it", ["3/6"], [])], "response string, working_tokens array<string>, question_values array<string>")
    got = M.check_working(df.withColumn("answer_num", F.lit(3)).withColumn("answer_den", F.lit(2)).withColumn("working_min", F.lit(1)))
    assert rows(got, "answer_shown", "working_shown") == [(True, True), (True, False), (False, True)]


# -- schedule -------------------------------------------------------------------------------------------------------------------
def one_by_one(answers):
    state = dict(S.NEW)
    for _, time, right in sorted((i, t, r) for t, i, r in answers):
        S.apply_answer(state, right, float(time))
    return state


def test_fold_equals_one_by_one(spark):
    rng = random.Random(11)
    data = []
    for k in range(25):
        for i in range(rng.randint(1, 60)):
            data.append((f"u{k % 5}", f"i{k}", float(rng.randint(0, 400_000)), k * 1000 + i, rng.random() < rng.choice([0.5, 0.9])))
    df = spark.createDataFrame(data, "learner string, item_id string, time double, attempt_id long, correct boolean").repartition(5)
    got = {(r.learner, r.item_id): r for r in S.fold_schedule(df).collect()}
    for key in {(d[0], d[1]) for d in data}:
        want = one_by_one([(d[2], d[3], d[4]) for d in data if (d[0], d[1]) == key])
        for f in S.FIELDS:
            assert got[key][f] == want[f], (key, f)


ANSWERS = "learner string, item_id string, time double, attempt_id long, correct boolean"


def test_late_answers_count_where_they_arrive(spark):
    df = spark.createDataFrame([("u", "i", 100.0, 1, True), ("u", "i", 300.0, 2, True), ("u", "i", 200.0, 3, False)], ANSWERS)
    got = S.fold_schedule(df).first()
    assert (got.level, got.due_at, got.streak) == (1, 260.0, 0)
    assert {f: got[f] for f in S.FIELDS} == one_by_one([(100, 1, True), (300, 2, True), (200, 3, False)])


def test_one_hot_pair_with_equal_times(spark):
    rng = random.Random(4)
    answers = [(7.0, 3 * i, rng.random() < 0.6) for i in range(6000)]
    df = spark.createDataFrame([("u", "i", *a) for a in answers], ANSWERS)
    got = S.fold_schedule(df, tile_bits=(6, 11)).collect()
    assert len(got) == 1 and {f: got[0][f] for f in S.FIELDS} == one_by_one(answers)


def test_stream_equals_fold(spark, tmp_path):
    rng = random.Random(9)
    data = [("u", f"i{rng.randrange(5)}", float(rng.randint(0, 4000)), i, i % 4 != 0) for i in range(60)]
    for n in range(3):
        part = data[20 * n : 20 * n + 20]
        rng.shuffle(part)
        spark.createDataFrame(part, ANSWERS).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
    stream = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = S.schedule_stream(stream).writeStream.outputMode("update").foreachBatch(S.snapshot_sink(f"{tmp_path}/snap", 4)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.item_id: r for r in S.read_snapshot(spark, f"{tmp_path}/snap").collect()}
    want = {r.item_id: r for r in S.fold_schedule(spark.createDataFrame(data, ANSWERS)).collect()}
    assert {k: {f: r[f] for f in S.FIELDS} for k, r in got.items()} == {k: {f: r[f] for f in S.FIELDS} for k, r in want.items()}


def test_stream_calls_python_once_a_group(spark, tmp_path):
    """Two batches over 300 pairs and a hot one keep at most as many state rows as there are groups; every pair has its own state."""
    rng = random.Random(6)
    data = [(f"u{i % 300}" if i % 2 else "hot", f"i{i % 3 if i % 2 else 0}", float(rng.randint(0, 4000)), i, rng.random() < 0.7) for i in range(1800)]
    for part in (data[:900], data[900:]):
        spark.createDataFrame(part, ANSWERS).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ANSWERS).parquet(f"{tmp_path}/in")
        run = S.schedule_stream(stream, 8).writeStream.outputMode("update").foreachBatch(S.snapshot_sink(f"{tmp_path}/snap", 4))
        q = run.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    got = {(r.learner, r.item_id): {f: r[f] for f in S.FIELDS} for r in S.read_snapshot(spark, f"{tmp_path}/snap").collect()}
    pairs = {d[:2] for d in data}
    assert got == {p: one_by_one([d[2:] for d in data if d[:2] == p]) for p in pairs}


def test_snapshot_keeps_or_fails(spark, tmp_path):
    state = lambda item, level: ("u", item, level, 1.0, 1.0, 1.0, 1, 1, 1, None)
    table = lambda *rows: spark.createDataFrame(list(rows), S.STATE_SCHEMA)
    path = f"{tmp_path}/snap"
    write = S.snapshot_sink(path, 16)
    assert S.read_snapshot(spark, path).count() == 0
    with pytest.raises(ValueError, match="lacks version 2"):
        write(table(state("a", 1)), 3)
    write(table(*[state(f"k{i}", 1) for i in range(40)]), 0)
    for _ in range(2):  # run again after a failure
        write(table(state("k3", 2), state("new", 1)), 1)
    write(table(), 2)
    levels = {r.item_id: r.level for r in S.read_snapshot(spark, path).collect()}
    assert levels == {**{f"k{i}": 1 for i in range(40)}, "k3": 2, "new": 1}
    assert len(list((tmp_path / "snap/data/version=1").glob("bucket=*"))) <= 2
    with pytest.raises(ValueError, match="another stream"):
        S.snapshot_sink(path, 16)(table(state("a", 1)), 0)
    with pytest.raises(ValueError, match="buckets"):
        S.snapshot_sink(path, 8)(table(state("a", 1)), 3)


def test_next_item_tiers(spark):
    schema = "learner string, item_id string, level int, due_at double, introduced_at double, mastered_at double"
    states = spark.createDataFrame([("due", "a", 2, 5.0, 1.0, None), ("due", "b", 1, 9.0, 1.0, None), ("new", "a", 1, 99.0, 1.0, None), ("all", "a", 6, 1.0, 1.0, 1.0), ("all", "b", 6, 1.0, 1.0, 1.0), ("all", "c", 6, 1.0, 1.0, 1.0),
        ("rev", "a", 1, 50.0, 1.0, None), ("rev", "b", 1, 40.0, 1.0, None), ("rev", "c", 6, 1.0, 1.0, 1.0)], schema)
    bank = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "item_id string, position int")
    learners = spark.createDataFrame([("due", 10.0, "b"), ("new", 10.0, "a"), ("all", 10.0, None), ("rev", 10.0, "b"), ("none", 10.0, "a")], "learner string, now double, avoid string")
    assert sorted(rows(M.next_item(states, bank, learners), "learner", "item_id", "reason")) == [
        ("all", None, "all_mastered"), ("due", "a", "due"), ("new", "b", "new"), ("none", "b", "new"), ("rev", "a", "review")]


# -- sources and packages ---------------------------------------------------------------------------------------------------------
def test_scan_chunks_and_problems(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": " x ", "text": "t", "chapter_number": 2}, {"node_id": " ", "chunk_id": "c", "id": "d", "text": ""}]))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [], "items": [{"id": "z"}, "odd"]}))
    (tmp_path / "c.json").write_text("{}")
    got = Ch.scan_chunks(spark, str(tmp_path)).orderBy("file", "ord")
    assert rows(got, "row_id") == [("x",), ("c",), ("z",), (None,)]
    assert Ch.explode_chunks(Ch._files(spark, str(tmp_path)), Ch.CONTRACT_ID_ORDER).filter("chunk_id = 'c'").first().row_id == "d"
    bad = Ch.scan_problems(Ch._files(spark, str(tmp_path)))
    assert sorted((f.rsplit("/", 1)[1], c, o) for f, c, o in rows(bad, "file", "code", "ord")) == [("b.json", "NOT_AN_OBJECT", 1), ("c.json", "NO_CHUNKS", None)]


def test_page_table(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"page": 7, "markdown": "# A"}, {"page": 8, "text": "b"}]))
    assert sorted(rows(Ch.page_table(spark, str(tmp_path), "m"), "node_id", "text")) == [("m:p7", "# A"), ("m:p8", "b")]


def test_write_nodes_prunes_by_chapter(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", i % 3, "t") for i in range(30)], "node_id string, chapter_number int, text string")
    Ch.write_nodes(nodes, f"{tmp_path}/nodes")
    back = R.metadata_filter(spark.read.parquet(f"{tmp_path}/nodes"), chapter_number=1)
    assert back.count() == 10 and "PartitionFilters: [isnotnull(chapter_number" in back._jdf.queryExecution().toString()


def test_upsert_and_labels(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 5, "w"), ("c", 1, "n")], "k string, t int, v string")
    assert sorted(rows(St.upsert(old, new, ["k"], ["t"]), "k", "v")) == [("a", "z"), ("b", "w"), ("c", "n")]
    df = spark.createDataFrame([("BookOne:ch007",), ("bad",)], "l string").select(St.parse_label(F.col("l")).alias("p"))
    assert [r.p and tuple(r.p) for r in df.collect()] == [("bookone", 7), None]
    with pytest.raises(ValueError):
        St.document_section(df, "x", ["y"])


def test_blocks_with_pictures(spark):
    blocks = spark.createDataFrame([(1, "a", "t", "s", 0, "A"), (1, "b", "t", "s", 1, "B")], "p int, key string, type string, section string, position int, content string")
    extra = spark.createDataFrame([(1, "pic1", "a", "P", 0), (1, "pic2", "a", "Q", 1), (1, "lost", "zz", "R", 2)], "p int, key string, appears_after string, content string, ord int")
    done, refused = P.insert_after(blocks, extra, ["p"])
    assert rows(done.orderBy("position"), "key") == [("a",), ("pic1",), ("pic2",), ("b",)] and rows(refused, "key") == [("lost",)]


def _shuffles(spark, make):
    """(rows, exchanges) of a table made and read without broadcasts; an exchange that is read again counts once."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return got, len(re.findall(r"(?m)^\W*Exchange (?:hash|range)", plan))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_ordered_scan_shuffles_its_rows_once(spark):
    """Keys that may be null: the rows meet their summary where they lie, the summary alone moves (by group, by group and tile)."""
    made = [(g, h, o, f"t{o}") for g in (None, 1, 2) for h in (None, "a") for o in range(7)]
    df = spark.createDataFrame(made, "g long, h string, o long, text string")
    scans = {"n": Scan("sum", F.lit(1)), "prev": Scan("prev", F.col("text")), "all": Scan("bits", F.call_function("shiftleft", F.lit(1), F.col("o").cast("int")))}
    got, exchanges = _shuffles(spark, lambda: ordered_scan(df, ["g", "h"], ["o"], tile_of_integer("o", 3), scans))
    assert {(r.g, r.h, r.o): (r.text, r.n, r.prev, r["all"]) for r in got} == {(g, h, o): (t, o + 1, f"t{o - 1}" if o else None, 127) for g, h, o, t in made}
    assert len(got) == len(made) and exchanges == 3


def test_teaching_blocks_refuse_without_moving_the_texts_again(spark):
    """Document 2 lacks its goals; rows that name no document are refused with none. The texts move once, their summary twice."""
    whole = ["core_method", "overview", "learning_goals", "practice_plan", "mastery_checklist"]
    items = ["techniques", "worked_examples", "common_mistakes"]
    made = [(d, s, None, "x") for d in (1, 2) for s in whole if (d, s) != (2, "learning_goals")]
    made += [(d, s, [f"{s}{i}" for i in range(3)], "") for d in (1, 2) for s in items] + [(2, "learning_goals", None, " "), (None, "overview", None, "y")]
    df = spark.createDataFrame(made, "doc int, section string, items array<string>, content string")
    got, exchanges = _shuffles(spark, lambda: P.teaching_blocks(df, ["doc"])[0])
    want = ["core_method", "overview", "learning_goals", *[f"{s}.{i}" for s in items for i in range(3)], "practice_plan", "mastery_checklist"]
    assert [r.key for r in sorted((r for r in got if r.doc == 1), key=lambda r: r.position)] == want
    assert [(r.doc, r.key, r.content, r.position) for r in got if r.doc != 1] == [(None, "overview", "y", 0)] and exchanges == 3
    assert {r.doc: r.missing for r in P.teaching_blocks(df, ["doc"])[1].collect()}[2] == ["learning_goals"]


def test_append_only_merge_loses_nothing(spark):
    stored = spark.createDataFrame([(1, "Add Up", 0)], "p int, name string, ord int")
    incoming = spark.createDataFrame([(1, " add  up", 1), (1, "New", 2), (1, "new ", 3), (2, "N", 4)], "p int, name string, ord int")
    merged, report = P.append_only_merge(stored, incoming, ["p"], "name", "ord")
    assert sorted(rows(merged, "p", "name", "added")) == [(1, "Add Up", False), (1, "New", True), (2, "N", True)]
    assert P.lost_elements(stored, merged, ["p"], "name").count() == 0
    none = P.append_only_merge(stored, stored, ["p"], "name", "ord")[1].first()
    assert none.refused and none.added == 0


def test_read_once_reads_its_input_once(spark):
    """Two uses of other columns read one exchange; no part of the filter goes below it."""
    df = read_once(spark.range(100).select("id", F.concat(F.lit("v"), F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("w")), "id")
    both = df.groupBy("id").agg(F.max("v").alias("m")).join(df.select("id", "w").hint("merge"), "id")
    assert both.count() == 100
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_bank_of_one_skill_is_spread(spark):
    """Each pair once, in order, from a join that deals a skill's concepts over tasks."""
    concepts = spark.createDataFrame([(i, 1, " a ") for i in range(40)], "concept_key long, chapter_number int, skill string")
    items = spark.createDataFrame([(i, "a", 1) for i in range(12)], "id long, skill string, chapter int")
    bank, refused = P.exercise_bank(concepts, items)
    assert [(r.concept_key, r.id) for r in bank.collect()] == sorted(((c, i) for c in range(40) for i in range(12)), key=lambda r: (r[0], str(r[1])))
    assert refused.count() == 0 and all(w in bank._jdf.queryExecution().optimizedPlan().toString() for w in ("__salt", "RepartitionByExpression"))
