"""Vocabulary, rarity-weighted matching and book synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, read_once, salted_join, tile_of_integer, top_n

# ---------------------------------------------------------------------------
# Fixed values
EVERYDAY_WORDS = """
about after all also and another any are around back because been before being below
best between both but can choose come correct correctly did does doing done down each
either else ever every find finds first for from get gets give gives going had
has have her here him his how into its itself just keep keeps know known let like
made make makes many may more most much must need needs new next not now off often
once one only onto other our out over own put puts read reads same say
says see seen set should show shows simple simply since solve solves some still such
take takes than that the their them then there these they thing things this those
through together too under until upon use used uses using very want was way well were
what when where whether which while who why will with within without work working
works would write writes you your
""".split()
MATCH_THRESHOLD = 1.0
RANK_DIGITS = 6
STEPS_FOR_A_PROCEDURE = 2
GLOBAL_TERMS = 30
REVIEW_COVERS = {4: [1, 2, 3], 8: [1, 2, 3, 5, 6, 7], 9: [1, 2, 3, 5, 6, 7]}
# ---------------------------------------------------------------------------


def stem(word: Column) -> Column:
    """Rough stem: plural, then -ing, then a final e (K1)."""
    return _final_e(_ing(_plural(word)))


def _plural(word: Column) -> Column:
    n = F.length(word)
    cut = lambda w, k: F.substring(w, F.lit(1), F.length(w) - k)
    return (
        F.when(F.endswith(word, F.lit("ies")) & (n > 4), F.concat(cut(word, 3), F.lit("y")))
        .when(F.endswith(word, F.lit("es")) & (n > 4) & ~F.endswith(word, F.lit("ses")), cut(word, 2))
        .when(F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")) & (n > 3), cut(word, 1))
        .otherwise(word)
    )


def _ing(w: Column) -> Column:
    return F.regexp_replace(w, r"^(.{3,})ing$", "$1")


def _final_e(w: Column) -> Column:
    return F.regexp_replace(w, r"^(.{3,})e$", "$1")


def vocabulary(text: Column | str) -> Column:
    """Distinct stemmed words that carry meaning (K1). Row-local."""
    column = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"\$[^$]*\$", " ")
    tokens = F.array_distinct(F.regexp_extract_all(bare, F.lit("[a-z]{3,}"), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in EVERYDAY_WORDS])
    # a step a pass, for a step reads its word several times; these words are plain letters, so their ends decide without patterns
    cut = lambda end, n: lambda w: F.when(F.endswith(w, F.lit(end)) & (F.length(w) >= 3 + n), F.substring(w, F.lit(1), F.length(w) - n)).otherwise(w)
    stems = F.transform(F.transform(F.transform(F.array_except(tokens, stop), _plural), cut("ing", 3)), cut("e", 1))
    return F.array_distinct(F.array_except(stems, stop))


def match_concepts(
    sentences: DataFrame, candidates: DataFrame, scope: list[str] | None = None, threshold: float = MATCH_THRESHOLD
) -> DataFrame:
    """Candidates each sentence matches: sum of 1 / (candidates using the word) over shared words (K2).

    sentences: (sentence_id, *scope, vocab); candidates: (key, *scope, vocab).

    A sentence's words are ordered rarest first. Words at the end whose weights together
    stay under the threshold cannot make a match alone, so a pair is formed only on the
    words before them. Common words, which would pair everything with everything, are
    never joined on; each formed pair is then scored on its whole vocabularies.
    """
    scope = scope or []
    sentences = read_once(sentences.select("sentence_id", *scope, "vocab"), "sentence_id")
    postings = candidates.select("key", *scope, F.explode("vocab").alias("word"))
    spread = postings.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("__spread"))
    words = sentences.select("sentence_id", *scope, F.explode("vocab").alias("word")).join(spread, [*scope, "word"])
    ranked = words.groupBy("sentence_id", *scope).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__spread").alias("n"), F.col("word").alias("w")))).alias("__ws")
    )
    weights = F.transform("__ws", lambda s: F.lit(1.0) / s["n"])
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    # walk from the rarest word while the weight still to come reaches the threshold
    walked = F.aggregate(
        "__ws",
        F.struct(total.alias("left"), F.array().cast("array<string>").alias("take")),
        lambda acc, s: F.struct(
            (acc["left"] - F.lit(1.0) / s["n"]).alias("left"),
            F.when(acc["left"] >= threshold - 1e-9, F.concat(acc["take"], F.array(s["w"]))).otherwise(acc["take"]).alias("take"),
        ),
    )
    probes = ranked.select("sentence_id", *scope, F.explode(walked["take"]).alias("word"))
    pairs = salted_join(probes, postings, [*scope, "word"], "inner", F.col("sentence_id")).select("sentence_id", *scope, "key").distinct()
    full = (
        pairs.join(ranked.select("sentence_id", "__ws", F.transform("__ws", lambda s: s["w"]).alias("__w")), "sentence_id")
        .join(candidates.select("key", *scope, F.col("vocab").alias("__cv")), ["key", *scope])
        .join(sentences.select("sentence_id", F.size("vocab").alias("__sn")), "sentence_id")
    )
    # words in common by hash first, then their entries; found once a pair, for four columns and the threshold read them
    full = full.withColumn("__hit", F.array_intersect("__w", "__cv"))
    shared = F.filter("__ws", lambda s: F.array_contains("__hit", s["w"]))
    sizes = {"__sn": F.col("__sn"), "__cn": F.size("__cv")}
    found = T.pinned(T.pinned(full, ["sentence_id", *scope, "key", "__ws"], {**sizes, "__hit": F.col("__hit")}), ["sentence_id", *scope, "key"], {"__sn": F.col("__sn"), "__cn": F.col("__cn"), "__shared": shared})
    scored = found.select(
        "sentence_id", *scope, "key",
        F.aggregate("__shared", F.lit(0.0), lambda a, s: a + F.lit(1.0) / s["n"]).alias("score"),
        F.array_sort(F.transform("__shared", lambda s: s["w"])).alias("matched_on"),
        (F.size("__shared") / F.col("__sn")).alias("of_sentence"),
        (F.size("__shared") / F.col("__cn")).alias("of_candidate"),
    )
    rounded = [F.round(c, RANK_DIGITS).alias(c) for c in ("score", "of_sentence", "of_candidate")]
    return scored.select("sentence_id", *scope, "key", "matched_on", *rounded).filter(F.col("score") >= threshold)


def assign_concepts(candidates: DataFrame, matches: DataFrame, scope: list[str] | None = None, order: str = "ord") -> DataFrame:
    """Each candidate to its one best sentence; equal bests leave it unassigned (K3).

    matches carry ``order``, the sentence's place, and are read once: two map-side combined aggregates, of a candidate's
    equal ranks and of its ranks.
    """
    scope = scope or []
    rank = F.struct("score", "of_sentence", "of_candidate")
    ranks = matches.groupBy(*scope, "key", "score", "of_sentence", "of_candidate").agg(
        F.count(F.lit(1)).alias("ties"), F.min_by(F.struct("sentence_id", "score"), order).alias("__s")
    )
    picked = ranks.groupBy(*scope, "key").agg(F.max_by(F.struct("ties", "__s"), rank).alias("__b")).select(*scope, "key", "__b.ties", "__b.__s")
    return candidates.select(*scope, "key").join(picked, [*scope, "key"], "left").select(
        *scope, "key",
        F.when(F.col("ties") == 1, F.col("__s.sentence_id")).alias("sentence_id"),
        F.when(F.col("ties") == 1, F.col("__s.score")).alias("score"),
        F.coalesce("ties", F.lit(0)).alias("ties"),
    )


def common_words(texts: DataFrame, group: str, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """Words in at least half of a group's texts (K4)."""
    sizes = texts.groupBy(group).agg(F.count(F.lit(1)).alias("texts"))
    seen = texts.select(group, F.explode(vocabulary(text)).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(sizes, group).filter(F.col("n") >= F.col("texts") * at_least)


def required_form(items: DataFrame, key: str = "skill") -> DataFrame:
    """Form every answer of a bank must take, where they all agree (K5).

    items: (key, answer_kind, answer_den, answer_is_reduced).
    """
    numbers = F.bool_and(F.coalesce(F.trim("answer_kind"), F.lit("")) == "number")
    whole = F.bool_and(F.coalesce(F.col("answer_den") == 1, F.lit(False)))
    any_whole = F.bool_or(F.coalesce(F.col("answer_den") == 1, F.lit(False)))
    reduced = F.bool_and(F.coalesce("answer_is_reduced", F.lit(False)))
    form = F.when(~numbers, None).when(whole, "whole_number").when(any_whole | ~reduced, None).otherwise("simplest_fraction")
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("exercises"), form.alias("required_form"))


def concept_proposals(goals: DataFrame, assignments: DataFrame, matches: DataFrame, checklist: DataFrame, forms: DataFrame) -> DataFrame:
    """One bank per goal unless its best two tie, with assessed flag and form (K5).

    goals: (sentence_id, goal); assignments (K3); matches (K2); checklist: (sentence_id) of goals a checklist line
    matched; forms: (key, required_form).
    """
    offered = assignments.filter(F.col("sentence_id").isNotNull()).select("sentence_id", "key").join(
        matches.select("sentence_id", "key", "score", "of_candidate"), ["sentence_id", "key"]
    )
    rank = F.struct("score", "of_candidate")
    best = offered.groupBy("sentence_id").agg(F.max(rank).alias("__b"), F.count(F.lit(1)).alias("offered"))
    top = offered.join(best, "sentence_id").filter(rank == F.col("__b")).groupBy("sentence_id", "offered").agg(
        F.count(F.lit(1)).alias("__n"), F.min("key").alias("__key")
    )
    chosen = F.when(F.col("__n") == 1, F.col("__key"))
    checked = checklist.select("sentence_id").distinct().withColumn("__c", F.lit(True))
    rows = goals.join(top, "sentence_id", "left").join(checked, "sentence_id", "left").withColumn("bank", chosen)
    return rows.join(forms.select(F.col("key").alias("bank"), "required_form"), "bank", "left").select(
        "sentence_id", "goal", "bank", F.coalesce("offered", F.lit(0)).alias("offered"),
        (F.col("bank").isNotNull() | F.coalesce("__c", F.lit(False))).alias("assessed"), "required_form",
    )


def review_coverage(sentences: DataFrame, chapters: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Chapters a review covers: those any of its sentences match (K6)."""
    scope = scope or []
    found = match_concepts(sentences, chapters, scope)
    return found.groupBy(*scope, "key").agg(F.count(F.lit(1)).alias("sentences"), F.max("score").alias("best"))


def key_terms(terms: DataFrame, keys: list[str], order: list[str], n: int = GLOBAL_TERMS) -> tuple[DataFrame, DataFrame]:
    """(commonest key terms with first meaning, their sources).

    terms: (keys, *order, term, meaning, chapter_number, source_chunk_ids). Sources are
    rows (keys, rank, kind, value, first_place), one per distinct chapter and chunk id of a
    kept term: a term may come from a third of the corpus, so they are not gathered.
    """
    rows = terms.withColumn("term", T.squash("term")).filter(F.col("term") != "").withColumn("__k", F.lower("term"))
    place = F.struct(*order)
    counted = rows.groupBy(*keys, "__k").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("__seen"), F.min_by(F.struct("term", "meaning"), place).alias("__first")
    )
    best = top_n(counted, keys, [F.desc("n"), F.asc("__seen")], n)
    kept = rows.join(best.select(*keys, "__k", "rank"), [*keys, "__k"])
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    ids = F.transform(F.filter("source_chunk_ids", lambda v: ~T.blank(v)), lambda v: one("source_chunk_id", v))
    named = kept.select(*keys, "rank", *order, F.explode(F.concat(F.array(one("chapter", F.col("chapter_number"))), ids)).alias("s"))
    sources = named.groupBy(*keys, "rank", F.col("s.kind").alias("kind"), F.col("s.value").alias("value")).agg(F.min(place).alias("first_place"))
    shown = best.select(
        *keys, "rank", F.col("__first.term").alias("term"), T.preview(F.coalesce("__first.meaning", F.lit("")), 220).alias("meaning"), "n"
    )
    return shown, sources


def study_plan(chapters: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Week of each chapter: one a week up to four chapters, else two."""
    totals = chapters.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    placed = ordered_scan(chapters, keys, [order], tile_of_integer(order), {"__n": Scan("sum", F.lit(1))}).join(totals, keys)
    per_week = F.when(F.col("__total") <= 4, 1).otherwise(2)
    return placed.withColumn("week", F.floor((F.col("__n") - 1) / per_week).cast("int") + 1).drop("__n", "__total")


def study_weeks(planned: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """One row per week: its chapters (at most two) and their joined titles."""
    group = F.array_sort(F.collect_list(F.struct(order, title)))
    return planned.groupBy(*keys, "week").agg(group.alias("__g")).select(
        *keys, "week", F.transform("__g", lambda s: s[order]).alias("chapters"),
        F.array_join(F.transform("__g", lambda s: s[title]), " and ").alias("focus"),
    )


def lesson_items(items: DataFrame, lesson: int) -> DataFrame:
    """Items of the chapters a lesson practises; untagged items stay."""
    return items.filter(F.col("chapter").isNull() | F.col("chapter").isin(REVIEW_COVERS.get(lesson, [lesson])))


def lesson_chapters(lessons: DataFrame, lesson: str = "lesson") -> DataFrame:
    """(lesson, chapter) bridge."""
    pairs = []
    for number, chapters in REVIEW_COVERS.items():
        pairs += [F.lit(number), F.array(*[F.lit(c) for c in chapters])]
    covered = F.coalesce(F.element_at(F.create_map(*pairs), F.col(lesson).cast("int")), F.array(F.col(lesson).cast("int")))
    return lessons.select(lesson, F.explode(covered).alias("chapter"))


def uncovered_skills(items: DataFrame, declared: DataFrame, passed_over: DataFrame, order: str = "ord") -> DataFrame:
    """Bank skills no concept declares, with size, sample and reason.

    items: (skill, prompt, order); declared: (skill); passed_over: (skill, reason).
    """
    bank = items.groupBy("skill").agg(F.count(F.lit(1)).alias("exercises_in_bank"), F.min_by("prompt", order).alias("sample_question"))
    return bank.join(declared.select("skill").distinct(), "skill", "left_anti").join(passed_over, "skill", "left").select(
        "skill", "exercises_in_bank", "sample_question",
        F.coalesce("reason", F.lit("no learning goal in this chapter's enrichment matched it")).alias("why"),
    )


def concept_counts(proposals: DataFrame) -> DataFrame:
    """Concepts with and without questions."""
    return proposals.agg(
        F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("bank").isNotNull()).alias("with_questions"),
        F.count_if(F.col("bank").isNull()).alias("taught_but_not_yet_practised"), F.count_if("assessed").alias("assessed"),
    )


def work_queue(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with nothing stored yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
