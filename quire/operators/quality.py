"""Content quality: readability, teaching contract, equations, banks, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import json_tree
from quire.functions import text as T
from quire.functions.ordered import Scan, first_per_key, ordered_scan, read_once, salted_join, tile_of_integer, top_n
from quire.operators.findings import finding, rule_findings, union_all
from quire.operators.patterns import find_patterns
from quire.sources.scratch import written

# ---------------------------------------------------------------------------
# Fixed values
MATH_SPAN = r"\$\$.+?\$\$|\$[^$]*\$|\\[a-zA-Z]+\{[^{}]*\}"
GRADE_WEIGHTS = (0.39, 11.8, -15.59)
GRADE_TOLERANCE = 0.5
MAX_SENTENCE_WORDS = 14.0
MIN_SENTENCES, MIN_WORDS = 3, 80
GAP_CONTEXT = 18
TEMPLATE_REUSE = 5
CITATION_ARTIFACT = r"\s*:contentReference\[[^\]]*\]\{[^}]*\}"
EQUATION_BREAK = r"\\qquad|\\quad|\\\\|\\newline|;|\n"
ALIGN_ENVIRONMENT = r"\\(?:begin|end)\{(?:aligned|align\*?|gather\*?|array)\}(?:\{[^}]*\})?"
FORM_BAND = r"(?i)Form:\s*2\s*(.{0,80}?)(?=\s+1\s)"
WORD_RANGE = r"(?i)(\d{1,4})\s*(?:[-–]\s*to\s*[-–]?|[-–]|to|and)\s*(\d{1,4})[-\s]*words?"
OFFICIAL_TRAITS = [
    "content", "form", "grammar", "vocabulary", "spelling", "oral fluency", "pronunciation", "appropriacy",
    "development, structure and coherence", "general linguistic range", "vocabulary range", "linguistic range",
]
GENERIC_MENTION_PAGE = 15
GUIDE_CHARS = 24000
OPTION_KEYS = ["A", "B", "C", "D", "E"]
OPTION_COUNT = {"single": 4, "multiple": 5}
PASSAGE_WORDS = {"single": (120, 300), "multiple": (200, 400)}
CHART_TYPES = ["bar", "line", "pie"]
CHART_POINTS = (4, 8)
SWT_PASSAGE_WORDS = (180, 300)
SWT_PASSAGE_SENTENCES = 4
SOLVER_AGREEMENT = 3
REQUIRED_LISTS = ["learning_goals", "techniques", "worked_examples", "common_mistakes", "mastery_checklist"]
# ---------------------------------------------------------------------------

HALF_UP = 1e-9  # halves round up whatever their binary form
VOWELS, CONSONANTS = "aeiouy", "b-df-hj-np-tv-xz"


# -- extraction damage (P5, P7) ------------------------------------------------


def extraction_damage(chunks: DataFrame, keep: list[str], text: str = "text", snippets: int = 3) -> DataFrame:
    """Empty chunks and runs of spaces inside words, with a few snippets (P5)."""
    t = F.coalesce(F.col(text), F.lit(""))
    gaps = F.when(F.contains(t, F.lit("  ")), F.regexp_count(t, F.lit(T.GAP))).otherwise(0)
    # a gap starts after the pieces and gaps before it; its context may overlap its neighbours'
    before, gap = F.transform(F.split(t, T.GAP, snippets + 1), F.length), F.regexp_extract_all(t, F.lit(T.GAP), F.lit(0))
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    spans = F.transform(
        F.slice(gap, 1, snippets), lambda g, i: F.struct((total(before, i + 1) + total(F.transform(gap, F.length), i)).alias("at"), F.length(g).alias("size"))
    )
    cut = F.transform(spans, lambda s: F.struct(F.greatest(s["at"] - GAP_CONTEXT, F.lit(0)).alias("a"), (s["at"] + s["size"] + GAP_CONTEXT).alias("b")))
    shown = F.transform(cut, lambda s: F.trim(F.replace(F.substring(t, s["a"] + 1, s["b"] - s["a"]), F.lit("\n"), F.lit("\\n"))))
    none = F.array().cast("array<string>")
    found = T.pinned(chunks, list(dict.fromkeys([*keep, text])), {"__blank": T.blank(text), "__gaps": gaps})
    found = found.filter(F.col("__blank") | (F.col("__gaps") > 0))
    return found.select(
        *keep,
        F.when(F.col("__blank"), "EMPTY").otherwise("SUSPECTED_GAP").alias("code"),
        F.when(F.col("__blank"), "error").otherwise("warning").alias("severity"),
        F.when(F.col("__blank"), 0).otherwise(F.col("__gaps")).alias("gap_count"),
        F.when(F.col("__blank"), none).otherwise(shown).alias("snippets"),
    )


def strip_citation_artifacts(text: Column | str) -> Column:
    """Leaked citation markers removed, ends trimmed."""
    return T.strip(F.regexp_replace(text, CITATION_ARTIFACT, ""))


def strip_document_artifacts(leaves: DataFrame) -> DataFrame:
    """Leaves with the markers removed from every string of a document; other scalars stay."""
    return leaves.withColumn("value", F.when(F.col("kind") == "STRING", strip_citation_artifacts("value")).otherwise(F.col("value")))


# -- readability (Q1, Q2) --------------------------------------------------------


def _plain(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), MATH_SPAN, " ")


def text_measures(text: Column | str) -> dict[str, Column]:
    """Sentences, words and syllables of a text, each as one regex count over it (Q1).

    Syllables are vowel groups, less one for a final e that is not in the word's only
    group, and one for a word without any: counts over the text instead of a pass per word.
    """
    plain = _plain(text)
    bare = F.replace(plain, F.lit("'"), F.lit(""))
    token = r"[^.!?\s\x1C-\x1F]+"
    gap = r"[\s\x1C-\x1F]+"
    groups = F.regexp_count(bare, F.lit(f"(?i)[{VOWELS}]+"))
    final_e = F.regexp_count(bare, F.lit("(?i)e(?![a-z])"))
    only_e = F.regexp_count(bare, F.lit(f"(?i)(?<![a-z])[{CONSONANTS}]*+[{VOWELS}]*e(?![a-z])"))
    mute = F.regexp_count(bare, F.lit(f"(?i)(?<![a-z])[{CONSONANTS}]++(?![a-z])"))
    return {
        "sentences": F.regexp_count(plain, F.lit(f"(?U){token}{gap}{token}{gap}{token}[^.!?]*")),
        "words": F.regexp_count(plain, F.lit("[A-Za-z']+")),
        "syllables": groups - (final_e - only_e) + mute,
    }


def grade_of(sentences: Column, words: Column, syllables: Column) -> Column:
    a, b, c = GRADE_WEIGHTS
    enough = (sentences >= MIN_SENTENCES) & (words >= MIN_WORDS)
    return F.when(enough, F.lit(a) * words / sentences + F.lit(b) * syllables / words + F.lit(c))


def readability(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Grade and its parts per text; null grade where there is too little prose (Q1)."""
    measured = T.pinned(docs, keep, text_measures(text))
    return measured.withColumn("grade", grade_of(F.col("sentences"), F.col("words"), F.col("syllables")))


def reading_findings(measured: DataFrame, max_grade: Column | float) -> DataFrame:
    """Texts above their audience: too hard, else long sentences (Q1)."""
    limit = F.lit(max_grade) if isinstance(max_grade, (int, float)) else max_grade
    wps = F.col("words") / F.col("sentences")
    code = (
        F.when(F.col("grade") > limit + GRADE_TOLERANCE, F.when(wps > MAX_SENTENCE_WORDS, "SPLIT_SENTENCES").otherwise("PLAINER_WORDS"))
        .when(F.col("grade").isNotNull() & (wps > MAX_SENTENCE_WORDS), "LONG_SENTENCES")
    )
    return measured.withColumn("code", code).filter(F.col("code").isNotNull())


def syllables_of(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.regexp_count(w, F.lit(f"[{VOWELS}]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - F.when(F.endswith(w, F.lit("e")) & (n > 1), 1).otherwise(0)))


def long_words(docs: DataFrame, keys: list[str], order: str, n: int = 6, text: str = "text") -> DataFrame:
    """Commonest words of three or more syllables per group, first seen first on ties (Q2).

    Words are counted first, so syllables are counted once per distinct word.
    """
    tokens = docs.select(*keys, order, F.posexplode(F.regexp_extract_all(_plain(text), F.lit("[A-Za-z']+"), F.lit(0))).alias("i", "w"))
    counted = (
        tokens.groupBy(*keys, F.lower("w").alias("word"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "i")).alias("seen"))
        .filter(syllables_of(F.col("word")) >= 3)
    )
    return top_n(counted, keys, [F.desc("n"), F.asc("seen")], n).drop("seen")


def longest_sentences(docs: DataFrame, keep: list[str], n: int = 3, text: str = "text") -> DataFrame:
    """Longest sentences of each text by words, earlier first on ties (Q2). Row-local."""
    parts = F.transform(F.split(_plain(text), r"(?U)(?<=[.!?])\s+"), T.strip)
    ranked = F.array_sort(
        F.filter(F.transform(parts, lambda s, i: F.struct((-T.word_count(s)).alias("k"), i.alias("i"), s.alias("s"))), lambda v: v["k"] <= -3)
    )
    return docs.select(*keep, F.posexplode(F.slice(ranked, 1, n)).alias("p", "v")).select(
        *keep, (F.col("p") + 1).alias("rank"), (-F.col("v.k")).alias("words"), F.col("v.s").alias("sentence")
    )


# -- teaching contract (Q3-Q8) -----------------------------------------------------


def _under(text: str, words: int) -> Column:
    return F.coalesce(T.word_count(text) < words, F.lit(True))


def priming_rules() -> list[tuple[Column, str, str, str]]:
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    check = "lesson_priming"
    return [
        (_under("about", 4), check, "reject", "NO_ABOUT"),
        (none("will_be_able_to"), check, "reject", "NO_OUTCOMES"),
        (none("common_pitfalls"), check, "warn", "NO_PITFALLS"),
    ]


def teaching_rules() -> list[tuple[Column, str, str, str]]:
    procedure = F.col("kind") == "procedure"
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    mistake = F.when(procedure, _under("common_mistake", 3)).otherwise(_under("common_mistake", 1))
    check = "skill_teaching"
    return [
        (_under("explanation", 4), check, "reject", "NO_EXPLANATION"),
        (n("examples") == 0, check, "reject", "NO_EXAMPLE"),
        (procedure & (n("steps") < 2), check, "reject", "NO_STEPS"),
        (mistake, check, "warn", "NO_MISTAKE"),
    ]


def _stem(name: Column) -> Column:
    """Leading letters of a name that any of its forms share."""
    return F.substring(F.lower(T.strip(name)), F.lit(1), F.greatest(F.lit(4), F.length(name) - 2))


def circular_rules() -> list[tuple[Column, str, str, str]]:
    name = F.lower(T.strip("name"))
    said = F.regexp_extract_all(F.lower(F.coalesce("explanation", F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    prefix = F.substring(name, F.lit(1), F.greatest(F.lit(4), F.length(name) - 2))
    rest = F.filter(said, lambda w: (w != name) & ~F.startswith(w, prefix))
    hit = (F.length(name) >= 3) & F.array_contains(said, name) & (F.size(rest) < 4)
    return [(hit, "circular_definition", "reject", "CIRCULAR")]


def example_use_rules() -> list[tuple[Column, str, str, str]]:
    stem = _stem(F.col("name"))
    used = F.exists(F.coalesce("examples", F.array().cast("array<string>")), lambda e: F.contains(F.lower(e), stem))
    hit = (F.col("kind") == "item") & (F.coalesce(stem, F.lit("")) != "") & ~F.coalesce(used, F.lit(False))
    return [(hit, "example_uses_the_thing", "reject", "NOT_USED")]


def terse_step_rules() -> list[tuple[Column, str, str, str]]:
    hit = (F.col("kind") == "procedure") & (F.size("steps") > 0) & F.forall("steps", lambda s: T.word_count(s) < 3)
    return [(hit, "worked_example_shows_work", "warn", "TERSE_STEPS")]


def priming_findings(lessons: DataFrame) -> DataFrame:
    """What a lesson lacks to open a session (Q3). lessons: (id, about, will_be_able_to, common_pitfalls)."""
    return rule_findings(lessons, "id", priming_rules())


def teaching_findings(skills: DataFrame) -> DataFrame:
    """What a skill lacks to be taught (Q3). skills: (id, kind, name, explanation, steps, examples, common_mistake)."""
    return rule_findings(skills, "id", teaching_rules())


def circular_findings(skills: DataFrame) -> DataFrame:
    """A name explained by itself and little else (Q4)."""
    return rule_findings(skills, "id", circular_rules())


def example_use_findings(skills: DataFrame) -> DataFrame:
    """Items whose examples never use them (Q5)."""
    return rule_findings(skills, "id", example_use_rules())


def terse_step_findings(skills: DataFrame) -> DataFrame:
    """Procedures whose every step is under three words (Q7)."""
    return rule_findings(skills, "id", terse_step_rules())


def skill_findings(skills: DataFrame) -> DataFrame:
    """All row-local checks on skills in one pass (Q3-Q5, Q7)."""
    return rule_findings(skills, "id", teaching_rules() + circular_rules() + example_use_rules() + terse_step_rules())


def skeleton(text: Column, name: Column) -> Column:
    """A sentence with the thing it teaches taken out."""
    stem = _stem(name)
    escaped = F.regexp_replace(stem, r"([^\p{L}\p{N}_])", r"\\$1")
    pattern = F.concat(F.lit(T.WORD_BEFORE), escaped, F.lit(r"[\p{L}\p{N}_]*"))
    low = F.lower(F.coalesce(text, F.lit("")))
    # most lines do not hold the stem; only those that do meet the regex
    held = (F.coalesce(name, F.lit("")) != "") & F.contains(low, stem)
    return T.strip(F.when(held, F.regexp_replace(low, pattern, F.lit("___"))).otherwise(low))


def templated_examples(examples: DataFrame, order: list[str], reuse: int = TEMPLATE_REUSE) -> DataFrame:
    """Skills whose example is a template many skills share; each skill once, by its first template (Q6).

    examples: (id, name, example, *order). Skills are counted per skeleton on the distinct
    pairs; the way back is salted, as one template may fill a third of the table.
    """
    rows = T.pinned(examples, ["id", *order], {"skeleton": skeleton(F.col("example"), F.col("name"))})
    rows = rows.filter(T.word_count("skeleton") >= 4)
    pairs = read_once(rows.groupBy("skeleton", "id").agg(F.min(F.struct(*order)).alias("seen")), "id")
    shared = pairs.groupBy("skeleton").agg(F.count(F.lit(1)).alias("skills"), F.min("seen").alias("first_seen")).filter(F.col("skills") >= reuse)
    flagged = salted_join(pairs.select("skeleton", "id"), shared, ["skeleton"], "inner", F.col("id"))
    return first_per_key(flagged.select("id", "skeleton", "skills", "first_seen"), ["id"], ["first_seen", "skeleton"]).drop("first_seen")


def contract_rollup(lessons: DataFrame, skills: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: lessons and skills rejected, each counted alone (Q8)."""
    rejected = findings.filter(F.col("severity") == "reject").select(F.col("key").alias("id")).distinct()
    ids = lambda df, skill: df.select(F.col("id").cast("string").alias("id"), F.lit(skill).alias("is_skill"))
    both = ids(lessons, False).unionByName(ids(skills, True)).join(rejected.withColumn("bad", F.lit(True)), "id", "left")
    skill, bad = F.col("is_skill"), F.coalesce("bad", F.lit(False))
    row = both.agg(
        F.count_if(~skill).alias("lessons"), F.count_if(skill).alias("skills"), F.count_if(skill & ~bad).alias("teachable"),
        F.count_if(skill & bad).alias("rejected_skills"), F.count_if(~skill & bad).alias("rejected_lessons"),
    )
    return row.withColumn("accepted", F.col("rejected_skills") + F.col("rejected_lessons") == 0)


def findings_by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


# -- equations (Q9) -------------------------------------------------------------------

def equation_chains(leaves: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Distinct ``a = b`` chains in the math spans of each text (Q9)."""
    where = lambda v, sign, change: F.when(F.contains(v, F.lit(sign)), change(v)).otherwise(v)  # most spans need no pattern
    spans = F.transform(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?s)\$\$(.+?)\$\$|\$(.+?)\$"), F.lit(0)),
        lambda s: F.regexp_replace(s, r"^\$+|\$+$", ""),
    )
    clean = F.transform(
        F.filter(spans, lambda s: F.contains(s, F.lit("="))),
        lambda s: F.replace(where(s, "\\", lambda v: F.regexp_replace(v, ALIGN_ENVIRONMENT, " ")), F.lit("&"), F.lit("")),
    )
    clean = F.transform(clean, lambda s: where(s, ",", lambda v: F.regexp_replace(v, r"(?<=\d),(?=\d{3}(?!\d))", "")))
    signs = lambda p: F.regexp_count(p, F.lit("="))
    parts = F.flatten(F.transform(clean, lambda s: F.split(s, EQUATION_BREAK)))
    split = F.flatten(F.transform(parts, lambda p: F.when(F.contains(p, F.lit(",")) & (signs(p) > 1), F.split(p, ",")).otherwise(F.array(p))))
    chains = F.array_distinct(F.transform(F.filter(split, lambda p: F.contains(p, F.lit("="))), T.squash))
    return leaves.select(*keep, F.explode(chains).alias("chain"))


def document_chains(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct chains of each document, from its leaves; fields that quote a problem or a mistake are left out (Q9)."""
    return equation_chains(json_tree.asserted(leaves), keep, "value").distinct()


def _side_values(sides: Column) -> Column:
    """Exact (n, d) of integer, decimal, fraction and one-operator sides; other sides are left out.

    A side in one of these forms whose value passes 38 digits stays, with a null.

    Done in steps over the array, so that each text is matched once: clean, split into the
    pattern's groups, make fractions, apply the operator.
    """
    part = r"(-?\d+)(?:\.(\d+))?(?:/(\d+))?"
    pattern = rf"^{part}(?:([-+*:]){part})?$"

    def clean(v: Column) -> Column:
        plain = F.regexp_replace(v, r"(\d)\s*(?=\\[dt]?frac)", "$1_")  # a mixed number is not read
        v = F.when(F.contains(v, F.lit("frac")), F.regexp_replace(plain, r"\\[dt]?frac\{(-?\d+)\}\{(\d+)\}", "$1/$2")).otherwise(v)
        for sign, op in (("\\times", "*"), ("×", "*"), ("\\cdot", "*"), ("\\div", ":"), ("÷", ":")):
            v = F.replace(v, F.lit(sign), F.lit(op))
        return F.regexp_replace(v, r"(?U)\s|\{,\}|,|\.$", "")

    number = lambda v: v.try_cast("decimal(38,0)")
    times = lambda x, y: F.try_multiply(x, y).cast("decimal(38,0)")

    def fraction(whole: Column, decimals: Column, under: Column) -> list[Column]:
        zeros = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(decimals)))
        return [number(F.concat(whole, decimals)), times(number(F.when(under == "", F.lit("1")).otherwise(under)), number(zeros))]

    def groups(v: Column) -> Column:
        return F.when(v.rlike(pattern), F.split(F.regexp_replace(v, pattern, "$1|$2|$3|$4|$5|$6|$7"), r"\|"))

    def parts(g: Column) -> Column:
        (a, b), (c, e) = fraction(g[0], g[1], g[2]), fraction(g[4], g[5], g[6])
        c, e = (F.when(g[3] != "", x) for x in (c, e))  # no second number: casting its empty text would throw and catch inside
        return F.when(g.isNotNull(), F.struct(a.alias("a"), b.alias("b"), g[3].alias("op"), c.alias("c"), e.alias("e")))

    def value(p: Column) -> Column:
        a, b, op, c, e = (p[k] for k in "a b op c e".split())
        n = F.when(op == "", a).when(op == "+", F.try_add(times(a, e), times(c, b))).when(op == "-", F.try_subtract(times(a, e), times(c, b)))
        n = n.when(op == "*", times(a, c)).when(op == ":", times(a, e))
        d = F.when(op == "", b).when(op == ":", times(b, c)).otherwise(times(b, e))
        return F.when(p.isNotNull(), F.struct(n.cast("decimal(38,0)").alias("n"), d.cast("decimal(38,0)").alias("d")))

    values = F.transform(F.transform(F.transform(F.transform(sides, clean), groups), parts), value)
    return F.filter(values, lambda v: v.isNotNull() & F.coalesce(v["d"] != 0, F.lit(True)))


def check_chains(chains: DataFrame) -> DataFrame:
    """Verdict per chain: ``true``, ``false`` or ``unchecked`` (Q9). Fractions are compared by cross products.

    ``unread`` counts sides whose digits pass what can be held; a chain with one is never
    ``true``, and ``false`` only where its other sides differ.
    """
    rows = T.pinned(chains, chains.columns, {"__v": _side_values(F.split("chain", "="))})
    held = F.filter("__v", lambda v: v["n"].isNotNull() & v["d"].isNotNull())
    rows = T.pinned(rows, [*rows.columns], {"__h": held})
    first = F.get("__h", F.lit(0))
    same = lambda v: ((v["n"] == first["n"]) & (v["d"] == first["d"])) | (F.try_multiply(v["n"], first["d"]) == F.try_multiply(first["n"], v["d"]))
    equal, unread = F.forall("__h", same), F.size("__v") - F.size("__h")
    verdict = F.when(F.size("__h") < 2, "unchecked").when(~equal, "false").when((unread > 0) | equal.isNull(), "unchecked").otherwise("true")
    return rows.withColumn("sides", F.size("__h")).withColumn("unread", unread).withColumn("verdict", verdict).drop("__v", "__h")


# -- lesson rules (Q10-Q14) ---------------------------------------------------------------


def sentence_count(text: Column | str) -> Column:
    """Sentences with an end mark before white space or the end."""
    parts = F.split(T.strip(text), r"(?U)[.!?]+(?=\s|\z)")
    return F.size(F.filter(parts, lambda p: ~T.blank(p)))


def worked_example_findings(examples: DataFrame, lessons: DataFrame, policy: DataFrame) -> DataFrame:
    """Examples over the task's ceiling, multi-sentence answers, too few examples (Q10).

    examples: (lesson_id, i, model_answer); lessons: (lesson_id, task_type, pack, max_words or null);
    policy: (pack, min_worked_examples).
    """
    rows = examples.filter(~T.blank("model_answer")).join(lessons, "lesson_id")
    n = T.word_count("model_answer")
    one = F.contains("task_type", F.lit("summarize_written_text"))
    counts = examples.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("n"))
    few = lessons.join(policy, "pack").join(counts, "lesson_id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("min_worked_examples"))
    return union_all([
        finding(rows.filter(n > F.col("max_words")), "worked_examples", "error", "lesson_id", "OVER_LENGTH", F.col("i").cast("string")),
        finding(rows.filter(one & (sentence_count("model_answer") != 1)), "worked_examples", "error", "lesson_id", "NOT_ONE_SENTENCE", F.col("i").cast("string")),
        finding(few, "example_count", "error", "lesson_id", "TOO_FEW_EXAMPLES", F.coalesce("n", F.lit(0)).cast("string")),
    ])


def banner_findings(methods: DataFrame) -> DataFrame:
    """Arrowed banners that list the steps but miscount them (Q11).

    methods: (lesson_id, name, formula, steps array<string>).
    """
    steps = F.transform("steps", lambda s: F.lower(T.strip(s)))
    arrow = r"→|\\rightarrow"

    def tokens(banner: Column) -> Column:
        src = F.replace(F.regexp_replace(F.coalesce(banner, F.lit("")), r"\\text\{([^}]*)\}", "$1"), F.lit("$"), F.lit(""))
        parts = F.filter(F.transform(F.split(src, arrow), lambda v: F.lower(T.strip(v))), lambda v: v != "")
        return F.when(src.rlike(arrow), parts)

    counts = F.array_distinct(
        F.filter(
            F.transform(
                F.array(tokens(F.col("name")), tokens(F.col("formula"))),
                lambda t: F.when((F.size(t) > 0) & (F.size(F.array_except(t, steps)) == 0) & (F.size(t) != F.size(steps)), F.size(t)),
            ),
            lambda v: v.isNotNull(),
        )
    )
    rows = methods.filter(F.size("steps") >= 2).select("lesson_id", F.size("steps").alias("n"), F.explode(counts).alias("listed"))
    return finding(rows, "method_banner", "error", "lesson_id", "BANNER_COUNT", F.concat_ws("/", F.col("listed").cast("string"), F.col("n").cast("string")))


def guide_range(evidence: Column) -> Column:
    """(low, high) words that earn full form credit, from the guide's band (Q12)."""
    band = F.regexp_extract(T.squash(evidence), FORM_BAND, 1)
    low = F.regexp_extract(band, WORD_RANGE, 1).try_cast("int")
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.regexp_extract(band, WORD_RANGE, 2).try_cast("int").alias("high")))


def unstated_ranges(lessons: DataFrame, guides: DataFrame) -> DataFrame:
    """Lessons that never state their task's range (Q12).

    lessons: (lesson_id, task_type, facts array<string>, rules array<string>); guides: (task_type, evidence).
    """
    ranged = guides.select("task_type", guide_range(F.col("evidence")).alias("r")).filter(F.col("r").isNotNull())
    said = F.array_join(F.concat(F.coalesce("facts", F.array().cast("array<string>")), F.coalesce("rules", F.array().cast("array<string>"))), " ")
    lows = F.regexp_extract_all(said, F.lit(WORD_RANGE), F.lit(1))
    highs = F.regexp_extract_all(said, F.lit(WORD_RANGE), F.lit(2))
    stated = F.exists(F.arrays_zip(lows.alias("l"), highs.alias("h")), lambda z: (z["l"].cast("int") == F.col("r.low")) & (z["h"].cast("int") == F.col("r.high")))
    return lessons.join(ranged, "task_type").filter(~F.coalesce(stated, F.lit(False))).select(
        "lesson_id", "task_type", F.concat_ws("-", F.col("r.low").cast("string"), F.col("r.high").cast("string")).alias("range")
    )


def guide_traits(guides: DataFrame) -> DataFrame:
    """(task_type, trait) headed in the guide (Q12)."""
    names = "|".join(OFFICIAL_TRAITS)
    found = F.regexp_extract_all(T.squash("evidence"), F.lit(rf"(?i){T.WORD_BEFORE}({names})\s*:"), F.lit(1))
    return guides.select("task_type", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("trait"))


def foreign_traits(factors: DataFrame, traits: DataFrame) -> DataFrame:
    """Scoring factors that borrow an official trait the task does not have (Q12).

    factors: (lesson_id, task_type, name). Tasks without any headed trait are not judged.
    """
    named = factors.withColumn("trait", F.lower(T.strip("name"))).filter(F.col("trait").isin(OFFICIAL_TRAITS))
    known = named.join(traits.select("task_type").distinct(), "task_type", "left_semi")
    return known.join(traits, ["task_type", "trait"], "left_anti").select("lesson_id", "task_type", "name")


def guide_pages(pages: DataFrame, aliases: DataFrame, rubric_only: bool = False, fallback: int = 4) -> DataFrame:
    """Guide pages per task in reading order, the mention page last or left out (Q13).

    pages: (page, text); aliases: (task_type, alias), any number of them. Tasks without a hit get the first scoring pages.
    """
    flat = pages.withColumn("__t", T.match_text("text"))
    named = written(aliases.select("task_type", F.lower(T.squash("alias")).alias("norm")).distinct(), "aliases")
    found = find_patterns(named.withColumn("pattern_id", F.struct("task_type", "norm")), flat.select(F.col("page").alias("text_id"), F.col("__t").alias("norm")))
    hits = found.select(F.col("text_id").alias("page"), F.col("pattern_id.task_type").alias("task_type")).distinct()
    if rubric_only:
        hits = hits.filter(F.col("page") != GENERIC_MENTION_PAGE)
    matched = hits.select("task_type").distinct()
    scoring = flat.filter(F.contains("__t", F.lit("scoring"))).select("page").orderBy("page").limit(fallback)  # ``fallback`` rows
    missing = named.select("task_type").distinct().join(matched, "task_type", "left_anti")
    rest = missing.crossJoin(F.broadcast(scoring)).withColumn("matched", F.lit(False))
    return hits.withColumn("matched", F.lit(True)).select("task_type", "page", "matched").unionByName(
        rest.select("task_type", "page", "matched")
    ).withColumn("late", (F.col("page") == GENERIC_MENTION_PAGE) & F.col("matched"))


def packed_pages(hits: DataFrame, pages: DataFrame, max_chars: int = GUIDE_CHARS) -> DataFrame:
    """Text of each hit within the character budget of its task (Q13)."""
    rows = hits.join(pages, "page").withColumn("__p", F.col("page") + F.when(F.col("late"), 10**9).otherwise(0))
    scanned = ordered_scan(rows, ["task_type"], ["__p"], tile_of_integer("__p"), {"__used": Scan("sum_before", F.length("text") + 2)})
    return scanned.filter(F.col("__used") < max_chars).withColumn(
        "text", F.expr(f"left(text, cast({max_chars} - __used as int))")
    ).drop("__used", "__p")


def checkable_assertions(lessons: DataFrame) -> DataFrame:
    """Format facts, scoring factors and rules that hold a number, as rows (Q14).

    lessons: (lesson_id, facts array<struct<label, value>>, factors array<struct<name, what_it_measures>>, rules array<string>).
    """
    row = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    show = lambda v: F.coalesce(v, F.lit("None"))
    facts = F.transform(F.filter("facts", lambda f: F.coalesce(f["label"], F.lit("")) != ""), lambda f: row("format_fact", F.concat(f["label"], F.lit(": "), show(f["value"]))))
    factors = F.transform(
        F.filter("factors", lambda f: F.coalesce(f["name"], F.lit("")) != ""),
        lambda f: row("scoring_factor", F.concat(F.lit("Scoring for this task takes into account "), f["name"], F.lit(": "), show(f["what_it_measures"]))),
    )
    rules = F.transform(F.filter("rules", lambda r: r.rlike(r"\d")), lambda r: row("critical_rule", r))
    return lessons.select("lesson_id", F.posexplode(F.concat(facts, factors, rules)).alias("i", "c")).select("lesson_id", "i", "c.kind", "c.text")


# -- banks (Q16-Q20) --------------------------------------------------------------------------


def question_reason(mode="mode", passage="passage", options="options", correct="correct", rationale="rationale") -> Column:
    """First shape fault of a question item, null when well formed (Q16).

    options: array<struct<key, text>>; rationale: map<string, string>.
    """
    single = F.col(mode) == "single"
    n = F.when(single, OPTION_COUNT["single"]).otherwise(OPTION_COUNT["multiple"])
    words = T.word_count(passage)
    fits = F.when(single, words.between(*PASSAGE_WORDS["single"])).otherwise(words.between(*PASSAGE_WORDS["multiple"]))
    keys = F.slice(F.array(*[F.lit(k) for k in OPTION_KEYS]), F.lit(1), n)
    texts = F.transform(options, lambda o: F.lower(T.strip(o["text"])))
    picked = F.size(correct)
    tests = [(~F.coalesce(F.col(mode).isin("single", "multiple"), F.lit(False)), "bad_mode")]
    tests += [(T.blank(f), f"missing_{f}") for f in ("topic", "title", "passage", "question", "skill")]
    tests += [
        (~fits, "passage_length"),
        (F.coalesce(F.size(options), F.lit(-1)) != n, "option_count"),
        (F.transform(options, lambda o: o["key"]) != keys, "option_keys"),
        (F.exists(options, lambda o: T.blank(o["text"])), "option_text"),
        (F.size(F.array_distinct(texts)) != F.size(texts), "duplicate_option"),
        (F.coalesce(picked, F.lit(0)) <= 0, "no_correct"),
        (F.size(F.array_distinct(correct)) != picked, "duplicate_correct"),
        (F.size(F.array_except(correct, keys)) > 0, "correct_outside"),
        (single & (picked != 1), "single_count"),
        (~single & ~picked.between(2, n - 1), "multiple_count"),
        (F.col(rationale).isNull(), "no_rationale"),
        (F.exists(keys, lambda k: T.blank(F.element_at(F.col(rationale), k))), "rationale_missing"),
    ]
    return T.first_reason(tests)


def chart_reason(points: str = "points") -> Column:
    """First shape fault of a chart item (Q16). points: array<struct<label, value>>."""
    values = F.transform(points, lambda p: p["value"])
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    tests = [(~F.coalesce(F.col("chart_type").isin(CHART_TYPES), F.lit(False)), "chart_type")]
    tests += [(T.blank(f), f"empty_{f}") for f in ("title", "subject", "unit")]
    tests += [
        (~F.coalesce(F.size(points), F.lit(0)).between(*CHART_POINTS), "point_count"),
        (F.exists(points, lambda p: T.blank(p["label"])), "point_label"),
        (F.exists(values, lambda v: v.isNull()), "point_value"),
        (F.exists(values, lambda v: v < 0), "negative_value"),
        ((F.col("chart_type") == "pie") & ~total.between(99, 101), "pie_total"),
        (F.size(F.array_distinct(values)) == 1, "all_equal"),
    ]
    return T.first_reason(tests)


def prompt_reason() -> Column:
    """First shape fault of an essay prompt (Q16)."""
    d = F.lower("directive")
    has = lambda *terms: T.any_contains(d, list(terms))
    fits = (
        F.when(F.col("type") == "agree_disagree", has("agree") & has("disagree"))
        .when(F.col("type") == "advantages_disadvantages", has("advantage") & has("disadvantage"))
        .when(
            F.col("type") == "problem_solution",
            has("cause", "problem", "issue", "reason")
            & has("solution", "solve", "measure", "address", "tackle", "be done", "what should", "steps"),
        )
        .when(F.col("type") == "positive_negative", has("positive") & has("negative"))
        .when(F.col("type") == "discuss_two_views", has("discuss") & has("both", "views", "opinion"))
    )
    tests = [(fits.isNull() & F.col("directive").isNotNull() | F.col("type").isNull(), "unknown_type")]
    tests += [(T.blank(f), f"empty_{f}") for f in ("statement", "directive", "instruction", "topic")]
    tests += [(~fits, "directive")]
    return T.first_reason(tests)


def passage_reason() -> Column:
    """First shape fault of a summary passage (Q16)."""
    t = T.strip("passage")
    tests = [(T.blank(f), f"empty_{f}") for f in ("topic", "title", "passage")]
    tests += [
        (~T.word_count(t).between(*SWT_PASSAGE_WORDS), "length"),
        (sentence_count(t) < SWT_PASSAGE_SENTENCES, "sentences"),
        (t.rlike(r"(?m)^\s*[-*•]"), "bullets"),
    ]
    return T.first_reason(tests)


def dedupe_bank(items: DataFrame, text: str, order: str, head: int | None = None) -> DataFrame:
    """First item per collapsed lower-case text, or its first ``head`` characters (Q17)."""
    source = F.left(F.col(text), F.lit(head)) if head else F.col(text)
    return first_per_key(items.withColumn("__k", T.squash(F.lower(source))), ["__k"], [order]).drop("__k")


def assign_ids(items: DataFrame, topic: str, order: str, fallback: str = "topic") -> DataFrame:
    """``slug-NN`` ids counted per slug in bank order (Q17)."""
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(F.col(topic)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(24))
    named = items.withColumn("__slug", F.when(slug == "", F.lit(fallback)).otherwise(slug))
    placed = ordered_scan(named, ["__slug"], [order], tile_of_integer(order), {"__n": Scan("sum", F.lit(1))})
    return placed.withColumn("id", F.concat("__slug", F.format_string("-%02d", F.col("__n")))).drop("__slug", "__n")


def solver_agreement(items: DataFrame, votes: DataFrame, needed: int = SOLVER_AGREEMENT) -> DataFrame:
    """Votes equal to the key per item, and the commonest answer (Q18).

    items: (item_id, answer); votes: (item_id, vote). Votes are counted per answer before they meet the key.
    """
    counts = votes.groupBy("item_id", F.coalesce("vote", F.lit("(none)")).alias("vote")).agg(F.count(F.lit(1)).alias("n"))
    joined = items.join(counts, "item_id", "left")
    return joined.groupBy("item_id", "answer").agg(
        F.coalesce(F.sum(F.when(F.col("vote") == F.col("answer"), F.col("n"))), F.lit(0)).alias("agree"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("votes"),
        F.max_by("vote", F.struct("n", "vote")).alias("commonest"),
    ).withColumn("accepted", F.col("agree") >= needed)


def repeatability(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Spread of repeated marks (Q19)."""
    v = F.col(value)
    return scores.groupBy(*keys).agg(
        F.count(v).alias("runs"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"),
        F.round(F.avg(v) + HALF_UP, 2).alias("mean"), F.round(F.stddev_pop(v) + HALF_UP, 2).alias("stdev"),
    )


def quality_ranks(means: DataFrame, group: str, expected: str, mean: str = "mean") -> DataFrame:
    """Pairs of known quality that the marks put in the wrong order, per group (Q19).

    Groups are a handful of items of known quality.
    """
    lo = means.select(group, F.col(expected).alias("__e"), F.col(mean).alias("__m"))
    w = Window.partitionBy(group).orderBy(F.col("__e"))
    walked = lo.withColumn("__prev", F.lag("__m").over(w))
    return walked.groupBy(group).agg(F.count_if(F.col("__prev") > F.col("__m")).alias("inversions"))


def reconcile(sent: DataFrame, returned: DataFrame, key: str, fields: list[str], batch: str = "batch") -> DataFrame:
    """Returned rows against sent rows: unknown, changed, miscounted (Q20)."""
    s = sent.select(batch, key, *[F.col(f).alias(f"s_{f}") for f in fields], F.lit(True).alias("__s")).dropDuplicates([batch, key])
    r = returned.select(batch, key, *[F.col(f).alias(f"r_{f}") for f in fields])
    joined = r.join(s, [batch, key], "left")
    unknown = joined.filter(F.col("__s").isNull()).select(batch, key, F.lit("UNKNOWN_ROW").alias("code"), F.lit("").alias("field"))
    changed = joined.filter("__s").select(
        batch, key, F.explode(F.filter(F.array(*[F.when(~F.col(f"s_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]), lambda v: v.isNotNull())).alias("field")
    ).select(batch, key, F.lit("CHANGED_FIELD").alias("code"), "field")
    count = lambda df, n: df.groupBy(batch).agg(F.count(F.lit(1)).alias(n))
    miscount = count(sent, "a").join(count(returned, "b"), batch, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        batch, F.lit(None).cast(sent.schema[key].dataType).alias(key), F.lit("COUNT_MISMATCH").alias("code"),
        F.concat_ws("/", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")).alias("field"),
    )
    return union_all([unknown, changed, miscount])


# -- freshness (Q21) ------------------------------------------------------------------------------


def enrichment_problems(documents: DataFrame) -> DataFrame:
    """First contract fault of each stored enrichment (Q21).

    documents: (lesson_id, label_ok, task_type, keys array<string>, sizes map<string,int>, steps_ok, how_to_ok, answers_ok).
    """
    empty = lambda k: F.coalesce(F.element_at("sizes", F.lit(k)), F.lit(0)) == 0
    tests = [(~F.coalesce("label_ok", F.lit(False)), "wrong_label"), (T.blank("task_type"), "no_task_type")]
    tests += [(empty(k), f"empty_{k}") for k in REQUIRED_LISTS]
    tests += [(~F.coalesce(c, F.lit(False)), c) for c in ("steps_ok", "how_to_ok", "answers_ok")]
    return documents.withColumn("code", T.first_reason(tests))


def lesson_status(wanted: DataFrame, stored: DataFrame, findings: DataFrame, key: str = "lesson_id") -> DataFrame:
    """missing / stale / ok for each lesson that should exist (Q21)."""
    bad = findings.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("problems"))
    have = stored.select(F.col(key).cast("string").alias(key)).distinct().withColumn("__have", F.lit(True))
    joined = wanted.select(F.col(key).cast("string").alias(key)).join(have, key, "left").join(bad, key, "left")
    n = F.coalesce("problems", F.lit(0))
    return joined.select(key, F.when(F.col("__have").isNull(), "missing").when(n > 0, "stale").otherwise("ok").alias("status"), n.alias("problems"))
