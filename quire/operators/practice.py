"""Marking of answers and the learner's queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rationals
from quire.functions import text as T
from quire.functions.ordered import Scan, ordered_scan, read_once, tile_of_integer, top_n
from quire.operators.quality import sentence_count

# ---------------------------------------------------------------------------
# Fixed values
ESSAY_CAPS = {
    "content": 6, "form": 2, "development_structure_coherence": 6, "grammar": 2, "general_linguistic_range": 6,
    "vocabulary_range": 2, "spelling": 2,
}
SUMMARY_CAPS = {"content": 4, "form": 1, "grammar": 2, "vocabulary": 2}
MAX_CONTENT = 6
COUNTING_LIMIT = 12
NUMBER_TOKEN = r"\d+\s+\d+\s*/\s*\d+|\d+\s*/\s*\d+|\d+\.\d+|\d+"
# ---------------------------------------------------------------------------



def _dec(value: Column) -> Column:
    return value.try_cast("decimal(38,0)")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps: five for each digit of the smaller number settle any pair."""
    def settled(kind: str) -> Column:
        x, y = F.abs(a).cast("decimal(38,0)").try_cast(kind), F.abs(b).cast("decimal(38,0)").try_cast(kind)
        steps = 5 * F.length(F.least(x, y).cast("string")) + 2
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(kind).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), steps), F.struct(x.alias("a"), y.alias("b")), step)["a"].cast("decimal(38,0)")

    return F.coalesce(settled("bigint"), settled("decimal(38,0)"))


def parse_number(text: Column) -> Column:
    """Exact (num, den) of a number in shown working: integer, a/b, w a/b or decimal of up to 18 digits; null when unreadable or longer.

    A leading minus of a mixed number covers the fraction too.
    """
    s = F.replace(F.replace(T.strip(text), F.lit("−"), F.lit("-")), F.lit(","), F.lit(""))
    mixed, frac, whole, dec = r"^(-?)(\d{1,18})\s+(\d{1,18})\s*/\s*(\d{1,18})$", r"^(-?\d{1,18})\s*/\s*(\d{1,18})$", r"^(-?\d{1,18})$", r"^(-?)(\d{1,12})\.(\d{1,6})$"
    x = lambda p, i: F.regexp_extract(s, p, i)
    mw, mn, md = _dec(x(mixed, 2)), _dec(x(mixed, 3)), _dec(x(mixed, 4))
    sign = lambda p: F.when(x(p, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    scale = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(x(dec, 3))))
    out = lambda n, d: F.struct(n.cast("decimal(38,0)").alias("n"), d.cast("decimal(38,0)").alias("d"))
    fd = _dec(x(frac, 2))
    # a minus on a zero whole part is not a minus: int("-0") is 0
    msign = F.when(mw == 0, F.lit(1)).otherwise(sign(mixed))
    return (
        F.when(s.rlike(mixed), F.when(md != 0, out(msign * (mw * md + mn), md)))
        .when(s.rlike(frac), F.when(fd != 0, out(_dec(x(frac, 1)), fd)))
        .when(s.rlike(whole), out(_dec(x(whole, 1)), F.lit(1)))
        .when(s.rlike(dec), out(sign(dec) * _dec(F.concat(x(dec, 2), x(dec, 3))), _dec(scale)))
    )


def _plain(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _times(digits: Column, factor: Column) -> Column:
    """Digits of any length times a whole number under 2**63, as digits: nine at a time from the right, with a carry."""
    padded = F.lpad(digits, (F.ceil(F.length(digits) / 9) * 9).cast("int"), "0")
    limbs = F.reverse(F.regexp_extract_all(padded, F.lit(r"\d{9}"), F.lit(0)))
    wide = lambda c: c.cast("decimal(38,0)")

    def step(s: Column, limb: Column) -> Column:
        amount = wide(wide(limb) * wide(factor) + s["carry"])
        low = wide(amount % 1_000_000_000)
        return F.struct(wide((amount - low) / 1_000_000_000).alias("carry"), F.concat(F.lpad(low.cast("string"), 9, "0"), s["out"]).alias("out"))

    done = F.aggregate(limbs, F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.lit("").alias("out")), step)
    return _plain(F.concat(done["carry"].cast("string"), done["out"]))


def _same_products(a: Column, x: Column, b: Column, y: Column) -> Column:
    """a * x == b * y for digits a, b of any length and whole x, y >= 0."""
    short = (F.length(a) <= 18) & (F.length(b) <= 18)
    return F.when(short, _dec(a) * x == _dec(b) * y).otherwise(_times(a, x) == _times(b, y))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


TYPED_NUMBER = r"^(-?)(?:(\d+)\s+(?=\d+\s*/))?(\d+)(?:\s*/\s*(\d+)|\.(\d+))?$"


def mark_number(typed: Column, num: Column, den: Column) -> Column:
    """correct, equal, not_simplest, readable, for answers of any length (L1).

    One match splits the text into sign, whole part, digits, denominator and decimals. The
    accepted answer num / den is below 2**63, so a typed number is held against it by
    multiplying digits with it. An equal fraction is in simplest form where its denominator
    is that of the reduced answer. That test reads the text as typed, so a fraction written
    with commas or a typographic minus is never found unreduced.
    """
    s = F.replace(F.replace(T.strip(typed), F.lit("−"), F.lit("-")), F.lit(","), F.lit(""))
    split = F.when(s.rlike(TYPED_NUMBER), F.split(F.regexp_replace(s, TYPED_NUMBER, r"$1|$2|$3|$4|$5"), r"\|"))
    p = F.abs(_dec(num))
    p, q, negative = _dec(p), _dec(F.abs(_dec(den))), (_dec(num) < 0) != (_dec(den) < 0)
    zeros = lambda d: F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(d)))
    parts = _let(split, lambda v: F.struct(
        v[0].alias("sign"), _plain(F.when(v[1] == "", "0").otherwise(v[1])).alias("whole"), _plain(F.concat(v[2], v[4])).alias("top"),
        _plain(F.when(v[3] != "", v[3]).otherwise(zeros(v[4]))).alias("bottom"), (v[3] != "").alias("fraction"),
    ))

    def marked(v: Column) -> Column:
        readable = F.coalesce(v["bottom"] != "0", F.lit(False))
        # a whole part beyond 19 digits exceeds any accepted answer
        rest = F.when(F.length(v["whole"]) <= 19, p - F.when(v["whole"] == "0", F.lit(0).cast("decimal(38,0)")).otherwise(F.try_multiply(_dec(v["whole"]), q)))
        nothing = (v["whole"] == "0") & (v["top"] == "0")
        # a minus on a zero whole part of a mixed number is not a minus: int("-0") is 0
        minus = (v["sign"] == "-") & ~(v["mixed_zero"])
        agrees = F.when(nothing | (p == 0), nothing & (p == 0)).otherwise((minus == negative) & (rest >= 0) & _same_products(v["top"], q, v["bottom"], _dec(F.greatest(rest, F.lit(0)))))
        equal = readable & F.coalesce(agrees, F.lit(False))
        raw = T.strip(typed)
        written = equal & v["fraction"] & raw.rlike(r"^(?:-?\d+\s+)?-?\d+\s*/\s*\d+$") & (v["bottom"] != "1")
        simplest = F.when(written, v["bottom"] == (q / gcd(p, q)).cast("decimal(38,0)").cast("string")).otherwise(F.lit(True))
        return F.struct((equal & simplest).alias("correct"), equal.alias("equal"), (equal & ~simplest).alias("not_simplest"), readable.alias("readable"))

    mixed_zero = s.rlike(r"^-0+\s+\d")
    return _let(parts.withField("mixed_zero", mixed_zero), marked)


TYPED_RATIO = r"(?i)^(\d+)(?:\s*:\s*|\s+to\s+)(\d+)$"


def mark_ratio(typed: Column, left: Column, right: Column) -> Column:
    """Equal after reduction, correct only when written reduced; numbers of any length (L2)."""
    s = F.replace(T.strip(typed), F.lit(","), F.lit(""))
    split = F.when(s.rlike(TYPED_RATIO), F.split(F.regexp_replace(s, TYPED_RATIO, "$1|$2"), r"\|"))
    x, y = _dec(left), _dec(right)

    def marked(v: Column) -> Column:
        a, b = _plain(v[0]), _plain(v[1])
        readable = F.coalesce((a != "0") & (b != "0"), F.lit(False))
        equal = readable & F.coalesce((x >= 0) & (y >= 0) & _same_products(a, y, b, x), F.lit(False))
        part = lambda n: (n / gcd(x, y)).cast("decimal(38,0)").cast("string")
        simplest = F.when(equal, (a == part(x)) & (b == part(y))).otherwise(F.lit(False))
        return F.struct((equal & simplest).alias("correct"), equal.alias("equal"), (equal & ~simplest).alias("not_simplest"), readable.alias("readable"))

    return _let(split, marked)


def mark_choice(mode: Column, chosen: Column, correct: Column, keys: Column) -> Column:
    """Score of a selection: exact set for single, hits less wrong for multiple (L3)."""
    picked = F.array_intersect(F.array_distinct(F.transform(chosen, lambda c: F.upper(T.strip(c)))), keys)
    right = F.array_distinct(correct)
    hits = F.array_sort(F.array_intersect(picked, right))
    missed = F.array_sort(F.array_except(right, picked))
    wrong = F.array_sort(F.array_except(picked, right))
    net = F.size(hits) - F.size(wrong)
    single = mode == "single"
    exact = (F.size(missed) == 0) & (F.size(wrong) == 0)
    return F.struct(
        F.when(single, exact.cast("int")).otherwise(F.greatest(F.lit(0), net)).alias("score"),
        F.when(single, F.lit(1)).otherwise(F.size(right)).alias("max_score"),
        hits.alias("hits"), missed.alias("missed"), wrong.alias("wrong"), (~single & (net < 0)).alias("floored"),
    )


def _all_capitals(text: Column) -> Column:
    n = T.letters(text)
    return (n > 0) & (T.count_chars(text, r"\p{Lu}") == n)


def essay_form(text: Column) -> Column:
    """Form 0-2 of an essay with its reason (L4)."""
    s = T.strip(F.coalesce(text, F.lit("")))
    n = T.word_count(s)
    body = F.filter(F.transform(T.lines(s), T.strip), lambda v: v != "")
    bullets = (F.size(body) > 0) & F.forall(body, lambda v: v.rlike("^[-*•]"))
    reason = T.first_reason(
        [
            (_all_capitals(s), "capitals"), (~s.rlike("[.?!]"), "no_sentence_end"), (bullets, "bullets"),
            (n < 120, "too_short"), (n > 380, "too_long"), (n.between(200, 300), "in_range"),
        ],
        "near_range",
    )
    score = F.when(reason == "in_range", 2).when(reason == "near_range", 1).otherwise(0)
    return F.struct(score.alias("form"), reason.alias("reason"), n.alias("words"))


def summary_form(text: Column) -> Column:
    """Form 0-1 of a one-sentence summary with its reason."""
    s = T.strip(F.coalesce(text, F.lit("")))
    n = T.word_count(s)
    reason = T.first_reason(
        [(_all_capitals(s), "capitals"), (n < 5, "too_short"), (n > 75, "too_long"), (sentence_count(s) > 1, "several_sentences")],
        "one_sentence",
    )
    return F.struct((reason == "one_sentence").cast("int").alias("form"), reason.alias("reason"), n.alias("words"))


def gate_traits(traits: DataFrame, forms: DataFrame, caps: dict[str, int], key: str = "attempt_id") -> DataFrame:
    """Trait scores clamped, form from code, all zero when content or form is zero; total.

    traits: (key, name, score); forms: (key, form).
    """
    cap = F.element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col("name"))
    clamped = F.when(cap.isNull(), F.col("score")).otherwise(F.greatest(F.lit(0), F.least(F.col("score"), cap)))
    rows = traits.join(forms.select(key, "form"), key, "left")
    rows = rows.withColumn("__s", F.when((F.col("name") == "form") & F.col("form").isNotNull(), F.col("form")).otherwise(clamped))
    per = rows.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("name") == "content", F.col("__s"))), F.lit(0)).alias("content"),
        F.coalesce(F.max(F.when(F.col("name") == "form", F.col("__s"))), F.lit(0)).alias("form_score"),
        F.sum("__s").alias("__sum"),
    )
    gated = (F.col("content") == 0) | (F.col("form_score") == 0)
    return per.select(
        key, gated.alias("gating_applied"), F.when(gated, 0).otherwise(F.col("__sum")).cast("long").alias("raw_total"),
        F.lit(sum(caps.values())).alias("max_raw_total"),
    )


def series_facts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each data series, one row per series.

    points: (keys, i, label, value). Highest and lowest take the first on ties, the largest step the last.
    """
    v, i = F.col("value"), F.col("i")
    walked = ordered_scan(points, keys, ["i"], tile_of_integer("i"), {"__prev": Scan("prev", v), "__from": Scan("prev", F.col("label"))})
    step = F.abs(v - F.col("__prev"))
    base = walked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by("label", F.struct(v, -i)).alias("highest"), F.max(v).alias("max_value"),
        F.min_by("label", F.struct(v, i)).alias("lowest"), F.min(v).alias("min_value"),
        F.sum(v).alias("total"),
        F.min_by(v, i).alias("first_value"), F.max_by(v, i).alias("last_value"),
        F.max(step).alias("largest_step"),
        F.max_by(F.struct(F.col("__from").alias("from"), F.col("label").alias("to"), (v > F.col("__prev")).alias("up")), F.struct(step, i)).alias("__step"),
    )
    top2 = top_n(points, keys, [F.desc("value"), F.desc("label")], 2).groupBy(*keys).agg(F.sum("value").alias("top_two"))
    gap = F.col("max_value") - F.col("min_value")
    ratio = F.when(F.col("min_value") != 0, F.round(F.col("max_value") / F.col("min_value"), 1)).otherwise(0.0)
    delta = F.col("last_value") - F.col("first_value")
    return base.join(top2, keys).select(
        *keys, "points", "highest", "max_value", "lowest", "min_value", F.round("total", 6).alias("total"), F.round(gap, 6).alias("gap"),
        F.when(F.coalesce(F.try_divide(F.col("max_value"), F.col("min_value")), F.lit(0)) >= 1.5, ratio).alias("ratio"),
        F.when(delta > 0, "rose").when(delta < 0, "fell").otherwise("stayed level").alias("trend"), F.round(F.abs(delta), 6).alias("change"),
        F.when(F.col("largest_step") > 0, F.col("__step.from")).alias("step_from"),
        F.when(F.col("largest_step") > 0, F.col("__step.to")).alias("step_to"),
        F.round("largest_step", 6).alias("largest_step"),
        ((F.col("max_value") > F.col("first_value")) & (F.col("max_value") > F.col("last_value"))).alias("peaks"),
        F.round("top_two", 6).alias("top_two"),
    )


def stated_tolerance(n: Column) -> Column:
    """Slack a figure earns from how precisely it was stated."""
    whole = n == F.floor(n)
    digits = F.format_string("%.0f", n)
    zeros = F.length(F.regexp_extract(digits, r"(0*)$", 1))
    shortest = n.cast("double").cast("string")  # 12.46, or 1.25E-5
    exponent = F.coalesce(F.regexp_extract(shortest, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    decimals = F.length(F.regexp_replace(F.regexp_extract(shortest, r"\.(\d+)", 1), "0+$", "")) - exponent
    return F.when(whole & (n == 0), 0.5 * 10).when(whole, F.greatest(F.lit(0.5), F.lit(0.5) * F.pow(F.lit(10.0), zeros))).otherwise(
        F.lit(0.5) * F.pow(F.lit(10.0), -decimals)
    )


def stated_numbers(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Numbers said in each text."""
    found = F.regexp_extract_all(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(","), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return texts.select(*keep, F.explode(F.transform(found, lambda v: v.cast("double"))).alias("number"))


def allowed_numbers(points: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Figures a description may state: values, total, gap, ratio, numbers in labels and title, pie top-k sums.

    points: (key, i, label, value), any number per item; items: (key, title, chart_type). Points stay rows; only a
    pie's running sums need them in order.
    """
    v = F.col("value")
    numbers = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda s: s.cast("double"))
    placed = points.select(key, "i", v.cast("double").alias("number"))
    value = placed.drop("i")
    per = value.groupBy(key).agg(F.sum("number").alias("total"), F.max("number").alias("hi"), F.min("number").alias("lo"))
    ratio = F.when(F.col("lo") != 0, F.round(F.col("hi") / F.col("lo"), 1))
    derived = per.select(key, F.explode(F.array("total", F.col("hi") - F.col("lo"), ratio)).alias("number")).filter("number IS NOT NULL")
    labels = points.join(items.select(key), key, "left_semi").select(key, F.explode(numbers(F.col("label"))).alias("number"))
    titles = items.join(per.select(key), key, "left_semi").select(key, F.explode(numbers(F.col("title"))).alias("number"))
    pies = placed.join(items.filter("chart_type = 'pie'").select(key), key, "left_semi")
    # running sums from the largest value down; equal values are told apart by their place
    walked = ordered_scan(pies.withColumn("__down", -F.col("number")), [key], ["__down", "i"], None, {"__sum": Scan("sum", F.col("number")), "__k": Scan("sum", F.lit(1))})
    sums = walked.filter("__k > 1").select(key, F.col("__sum").alias("number"))
    known = value.unionByName(derived).join(items.select(key), key, "left_semi")
    return known.unionByName(labels).unionByName(titles).unionByName(sums).distinct()


def unsupported_numbers(said: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Stated figures no allowed one is near enough to.

    Only the nearest allowed figure on each side can decide, so said and allowed figures
    are merged in order and each said one looks left and right: a sort, not all pairs.
    said, allowed: (keys, number).
    """
    s = said.select(*keys, "number").distinct().withColumn("__a", F.lit(None).cast("double"))
    a = allowed.select(*keys, "number").distinct().withColumn("__a", F.col("number"))
    merged = s.unionByName(a).withColumn("__kind", F.col("__a").isNull().cast("int")).withColumn("__neg", -F.col("number"))
    left = ordered_scan(merged, keys, ["number", "__kind"], None, {"__below": Scan("last", F.col("__a"))})
    both = ordered_scan(left, keys, ["__neg", "__kind"], None, {"__above": Scan("last", F.col("__a"))})
    n = F.col("number")
    distance = F.least(F.coalesce(n - F.col("__below"), F.lit(float("inf"))), F.coalesce(F.col("__above") - n, F.lit(float("inf"))))
    counting = (n <= COUNTING_LIMIT) & ~(distance < 1e-9)
    return both.filter(F.col("__a").isNull() & ~counting & (distance > stated_tolerance(n))).select(*keys, "number")


# -- working and coverage (L11, L12) ----------------------------------------------------------


def check_working(responses: DataFrame) -> DataFrame:
    """Answer value present and enough working shown (L11). Row-local over a response and its item; numbers of any length.

    responses: (keep..., response, answer_num, answer_den, working_tokens, working_min, question_values). Rows with a number of
    thirteen digits or more in a row, or six decimals, go to an Arrow batch of exact fractions; all others stay with Spark's decimals.
    """
    plain = F.regexp_replace(F.coalesce("response", F.lit("")), r"\\[dt]?frac\s*\{\s*(-?\d+)\s*\}\s*\{\s*(\d+)\s*\}", "$1/$2")
    raw = F.regexp_extract_all(plain, F.lit(NUMBER_TOKEN), F.lit(0))
    tidy = F.transform(raw, lambda v: F.regexp_replace(F.regexp_replace(v, r"\s*/\s*", "/"), r"\s+", " "))
    literals = F.filter(tidy, lambda v: ~v.rlike(r"/0+$"))
    answer = F.concat_ws("/", F.col("answer_num").cast("string"), F.col("answer_den").cast("string"))
    rows = responses.withColumn("__lit", literals).withColumn("__answer", answer)
    held = F.concat("__lit", F.coalesce("working_tokens", F.array().cast("array<string>")), F.coalesce("question_values", F.array().cast("array<string>")), F.array("__answer"))
    long = F.exists(held, lambda v: F.coalesce(F.replace(v, F.lit(","), F.lit("")).rlike(r"\d{13}|\.\d{7}"), F.lit(False)))
    flagged = T.pinned(rows, rows.columns, {"__long": long})
    judged = _short_working(flagged.filter("NOT __long")).unionByName(_long_working(flagged.filter("__long")))
    worked = F.size("working_hits") >= F.coalesce("working_min", F.lit(1))
    done = judged.withColumn("working_shown", worked).withColumn("correct", F.col("answer_shown") & F.col("working_shown"))
    return done.select(*responses.columns, "answer_shown", "working_hits", "working_shown", "correct")


def _short_working(rows: DataFrame) -> DataFrame:
    same = lambda x, y: F.coalesce(x["n"] * y["d"] == y["n"] * x["d"], F.lit(False))
    rows = rows.withColumn("__val", F.transform("__lit", parse_number)).withColumn("__q", F.transform("question_values", parse_number))
    answer = F.struct(_dec(F.col("answer_num")).alias("n"), _dec(F.col("answer_den")).alias("d"))
    has = lambda arr, v: F.exists(arr, lambda x: same(x, v))
    hits = F.filter(
        "working_tokens",
        lambda t: F.array_contains("__lit", t) | (has("__val", parse_number(t)) & ~has("__q", parse_number(t))),
    )
    return rows.withColumn("answer_shown", has("__val", answer)).withColumn("working_hits", hits).drop("__val", "__q")


def _long_working(rows: DataFrame) -> DataFrame:
    judge = F.pandas_udf(rationals.working, "answer_shown boolean, working_hits array<string>")
    judged = rows.withColumn("__j", judge("__lit", F.coalesce("working_tokens", F.array().cast("array<string>")), "question_values", "__answer"))
    return judged.select(*rows.columns, "__j.answer_shown", "__j.working_hits")


def description_coverage(attempts: DataFrame, facts: DataFrame, judged: DataFrame) -> DataFrame:
    """Covered and total facts per attempt, content band clamped; zero gates.

    attempts: (attempt_id, item_id, content_score); facts: (item_id, key, importance); judged: (attempt_id, key, covered).
    """
    wanted = attempts.join(facts, "item_id").join(judged, ["attempt_id", "key"], "left")
    yes = F.coalesce(F.col("covered") == "yes", F.lit(False))
    kind = lambda k: F.col("importance") == k
    counts = wanted.groupBy("attempt_id").agg(
        *[c for k in ("essential", "supporting") for c in (F.count_if(kind(k) & yes).alias(f"{k}_covered"), F.count_if(kind(k)).alias(f"{k}_total"))]
    )
    band = F.greatest(F.lit(0), F.least(F.coalesce("content_score", F.lit(0)), F.lit(MAX_CONTENT)))
    names = [f"{k}_{p}" for k in ("essential", "supporting") for p in ("covered", "total")]
    return attempts.select("attempt_id", band.alias("content_score")).join(counts, "attempt_id", "left").na.fill(0, names).withColumn(
        "gating_applied", F.col("content_score") == 0
    )


# -- the learner's queue (L9, L10) -----------------------------------------------------------


def next_item(states: DataFrame, bank: DataFrame, learners: DataFrame) -> DataFrame:
    """Next item and why, per learner.

    states: (learner, item_id, level, due_at, introduced_at, mastered_at); bank: (item_id, position from 1, dense);
    learners: (learner, now, avoid). Due unmastered items first, weakest first; else the first item of the bank never
    introduced; else the soonest unmastered. Mastered items never come back. The first new item is the first gap in
    the learner's introduced positions, so learners and bank are never crossed.
    """
    live = read_once(states.join(bank, "item_id").join(learners, "learner"), "learner", "item_id")
    rank = lambda *cols: F.struct((F.col("item_id").eqNullSafe(F.col("avoid"))).cast("int").alias("avoided"), *cols)
    open_ = F.col("mastered_at").isNull()
    introduced = F.col("introduced_at").isNotNull()
    due = open_ & (F.col("due_at") <= F.col("now"))
    ahead = open_ & introduced
    choice = live.groupBy("learner").agg(
        F.min_by("item_id", F.when(due, rank("level", "due_at", "item_id"))).alias("__due"),
        F.min_by("item_id", F.when(ahead, rank(F.coalesce("due_at", F.lit(0)), "level", "item_id"))).alias("__ahead"),
    )
    seen = live.filter(introduced).select("learner", "position")
    avoided = learners.join(bank.withColumnRenamed("item_id", "avoid"), "avoid").select("learner", "position")
    taken = seen.unionByName(avoided).distinct()
    placed = ordered_scan(taken, ["learner"], ["position"], tile_of_integer("position"), {"__n": Scan("sum", F.lit(1))})
    gaps = placed.groupBy("learner").agg(
        F.coalesce(F.min(F.when(F.col("position") != F.col("__n"), F.col("__n"))), F.max("__n") + 1).alias("__gap")
    )
    only_avoided = avoided.join(seen, ["learner", "position"], "left_anti").select("learner", F.col("position").alias("__last"))
    size = bank.agg(F.max("position").alias("__size"))
    first_new = learners.join(gaps, "learner", "left").join(only_avoided, "learner", "left").crossJoin(F.broadcast(size)).select(
        "learner",
        F.when(F.coalesce("__gap", F.lit(1)) <= F.col("__size"), F.coalesce("__gap", F.lit(1))).otherwise(F.col("__last")).alias("position"),
    )
    fresh = first_new.join(bank, "position", "left").select("learner", F.col("item_id").alias("__new"))
    joined = learners.select("learner").join(choice, "learner", "left").join(fresh, "learner", "left")
    return joined.select(
        "learner",
        F.coalesce("__due", "__new", "__ahead").alias("item_id"),
        F.when(F.col("__due").isNotNull(), "due").when(F.col("__new").isNotNull(), "new").when(F.col("__ahead").isNotNull(), "review").otherwise("all_mastered").alias("reason"),
    )


def progress(states: DataFrame, bank: DataFrame, learners: DataFrame) -> DataFrame:
    """total, mastered, due, new and in progress per learner."""
    live = states.join(bank.select("item_id"), "item_id").join(learners.select("learner", "now"), "learner")
    open_ = F.col("mastered_at").isNull()
    per = live.groupBy("learner").agg(
        F.count_if(~open_).alias("mastered"), F.count_if(open_ & (F.col("due_at") <= F.col("now"))).alias("due"),
        F.count_if(F.col("introduced_at").isNotNull()).alias("__seen"),
    )
    size = bank.agg(F.count(F.lit(1)).alias("total"))
    return learners.select("learner").join(per, "learner", "left").na.fill(0, ["mastered", "due", "__seen"]).crossJoin(F.broadcast(size)).select(
        "learner", "total", "mastered", "due", (F.col("total") - F.col("__seen")).alias("new"),
        (F.col("__seen") - F.col("mastered")).alias("in_progress"),
    )
