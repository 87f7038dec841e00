"""Substring search, quotes of any length, tiles by row count and long numbers, against plain Python."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quire.functions import rationals
from quire.functions.ordered import Scan, ordered_scan, tiled_by_rows
from quire.operators import grounding as G
from quire.operators import practice as M
from quire.operators import quality as Q
from quire.operators import structure as S
from quire.operators.patterns import find_patterns


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_texts(rng: random.Random, n: int) -> list[str]:
    vocab = ["a", "ab", "bab", "cc", "abc", "é", "", "dd"]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_patterns_of_any_length_equal_contains(spark, seed):
    rng = random.Random(seed)
    texts = [(i, f"s{i % 2}", t) for i, t in enumerate(some_texts(rng, 60))] + [(900, "s0", None), (901, "s0", "")]
    patterns = []
    for i in range(150):
        source = rng.choice(texts[:60])[2]
        a = rng.randint(0, max(0, len(source) - 1))
        patterns.append((i, f"s{i % 2}", source[a : a + rng.choice([1, 2, 3, 5, 9, 30])]))
    patterns += [(500, "s0", "nowhere"), (501, "s0", None), (502, "s0", ""), (503, "s1", " "), (504, "s0", "zz a ab")]
    t = spark.createDataFrame(texts, "text_id long, scope string, norm string")
    p = spark.createDataFrame(patterns, "pattern_id long, scope string, norm string")
    got = sorted((r.pattern_id, r.text_id) for r in find_patterns(p, t, ["scope"]).collect())
    assert got == sorted((i, j) for i, s, n in patterns if n for j, z, x in texts if x is not None and s == z and n in x)
    both = sorted((r.pattern_id, r.text_id) for r in find_patterns(p, t).collect())
    assert both == sorted((i, j) for i, _, n in patterns if n for j, _, x in texts if x is not None and n in x)
    assert find_patterns(p.limit(0), t).count() == 0 and find_patterns(p, t.limit(0)).count() == 0


def test_no_nested_loops_over_patterns(spark):
    pages = spark.createDataFrame([(1, "Read aloud scoring"), (2, "other")], "page int, text string")
    aliases = spark.createDataFrame([("t1", "read ALOUD"), ("t2", "missing"), ("t1", "oth")], "task_type string, alias string")
    hits = Q.guide_pages(pages, aliases)
    assert sorted((r.task_type, r.page, r.matched) for r in hits.collect()) == [("t1", 1, True), ("t1", 2, True), ("t2", 1, False)]
    lines = spark.createDataFrame([("d", 3, 1, "# The Parts"), ("d", 5, 2, "# Two"), ("e", 1, 1, "# Two"), ("d", 2, 1, "Two plain")], "doc string, page int, line_no int, line string")
    contents = spark.createDataFrame([("d", 1, "Nowhere", 9), ("d", 2, " parts ", 10), ("d", 3, "two", 1), ("e", 1, " ", 4)], "doc string, position int, title string, printed int")
    offsets = S.page_offset(contents, lines)
    assert [(r.doc, r.offset) for r in offsets.collect()] == [("d", 7)]
    found = find_patterns(aliases.select(F.col("task_type").alias("pattern_id"), F.col("alias").alias("norm")), pages.select(F.col("page").alias("text_id"), F.col("text").alias("norm")))
    for df in (found, offsets):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


@pytest.mark.parametrize("seed", range(2))
def test_quotes_of_1_to_80_words(spark, seed):
    rng = random.Random(seed)
    vocab = ["the", "then", "he", "hen", "in", "inn", "x"]
    texts = [(f"n{i}", i, f"s{i % 2}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120)))) for i in range(40)]
    quotes = []
    for q in range(120):
        words = rng.choice(texts)[3].split()
        n = rng.choice([1, 2, 3, 4, 7, 80])
        a = rng.randint(0, max(0, len(words) - n))
        text = " ".join(words[a : a + n])
        quotes.append((q, f"s{q % 2}", text[rng.randint(0, 1) :].strip() or "x"))
    quotes += [(900, "s0", ""), (901, "s0", "never said"), (902, "s1", "zzz")]
    chunks = spark.createDataFrame(texts, "node_id string, ord long, scope string, norm string")
    qs = spark.createDataFrame(quotes, "quote_id long, scope string, norm string")
    got = {r.quote_id: r.node_id for r in G.locate_quotes(qs, chunks, ["scope"]).collect()}
    want = {}
    for q, s, n in quotes:
        hits = sorted((o, i) for i, o, sc, t in texts if sc == s and n and n in t)
        if hits:
            want[q] = hits[0][1]
    assert got == want


def test_scan_over_equal_values_and_a_hot_key(spark):
    """A third of the rows on one key, half of them at one value: tiles stay near the mean, and the scan equals a plain one."""
    rng = random.Random(8)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", 7.5 if i % 2 == 0 else rng.choice([0.1, 2.0, -3.0, 1e300]), i, rng.choice([None, i])) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, v double, id long, mark long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in tiled_by_rows(df.repartition(4), ["k"], ["v", "id"]).groupBy("__tile").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 9000 / 8
        scans = {"n": Scan("sum", F.lit(1)), "last": Scan("last", F.col("mark")), "before": Scan("last_before", F.col("mark")), "prev": Scan("prev", F.col("id")), "next": Scan("next", F.col("id"))}
        got = {r.id: (r.n, r["last"], r.before, r.prev, r["next"]) for r in ordered_scan(df.repartition(4), ["k"], ["v", "id"], None, scans).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in {r[0] for r in rows}:
        own, seen = sorted((v, i, m) for k, v, i, m in rows if k == key), None
        for p, (_, i, m) in enumerate(own):
            now = m if m is not None else seen
            want[i] = (p + 1, now, seen, own[p - 1][1] if p else None, own[p + 1][1] if p + 1 < len(own) else None)
            seen = now
    assert got == want


def test_pie_sums_and_figures_of_one_hot_item(spark):
    rng = random.Random(5)
    points = [("hot", i, "x", float(rng.choice([3, 3, 5, 2000, 7]))) for i in range(900)] + [("b", 1, "y 4", 2.5), ("b", 2, "z", 2.5)]
    items = spark.createDataFrame([("hot", "t", "pie"), ("b", "of 12", "pie"), ("c", "t 3", "pie")], "item_id string, title string, chart_type string")
    allowed = M.allowed_numbers(spark.createDataFrame(points, "item_id string, i int, label string, value double"), items)
    got = {(r.item_id, r.number) for r in allowed.collect()}
    want = {("b", v) for v in (2.5, 5.0, 0.0, 1.0, 4.0, 12.0)}
    values = sorted((v for k, _, _, v in points if k == "hot"), reverse=True)
    want |= {("hot", v) for v in values} | {("hot", sum(values[:k])) for k in range(2, 901)} | {("hot", sum(values)), ("hot", 1997.0), ("hot", 666.7)}
    assert got == want
    said = [("hot", float(v)) for v in range(0, 4000, 7)]
    none = M.unsupported_numbers(spark.createDataFrame(said, "item_id string, number double"), allowed.filter("item_id = 'hot'"), ["item_id"])
    bad = {r.number for r in none.collect()}
    figures = [v for k, v in want if k == "hot"]

    def slack(n):
        zeros = len(str(int(n))) - len(str(int(n)).rstrip("0"))
        return 5.0 if n == 0 else max(0.5, 0.5 * 10**zeros)

    assert bad == {n for _, n in said if min(abs(n - f) for f in figures) > slack(n) and not (n <= 12 and min(abs(n - f) for f in figures) < 1e-9)}


def number(rng: random.Random, size: int) -> str:
    n = lambda: str(rng.randint(0, 10 ** rng.randint(1, size)))
    return rng.choice(["", "-"]) + rng.choice([n(), f"{n()}/{rng.randint(1, 10**size)}", f"{n()} {n()} / {rng.randint(1, 10**size)}", f"{n()}.{n()}", f"00{n()}", f"{n()}/0"])


def value(text: str):
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text)
    if "/" in body:
        head, below = body.split("/")
        parts = head.split()
        if int(below) == 0:
            return None
        if len(parts) == 2:
            return (sign if int(parts[0]) else 1) * (int(parts[0]) + Fraction(int(parts[1]), int(below)))
        return sign * Fraction(int(parts[0]), int(below))
    return sign * Fraction(body)


@pytest.mark.parametrize("size", [3, 18, 30, 90])
def test_numbers_of_any_length(spark, size):
    rng = random.Random(size)
    pairs = []
    for _ in range(250):
        a = number(rng, size)
        b = number(rng, size)
        v = value(a)
        if v is not None and rng.random() < 0.6:  # the same number, written otherwise, or next to it
            k = rng.randint(1, 10**size)
            w = v + rng.choice([0, 0, Fraction(1, v.denominator * k)])
            b = f"{w.numerator * k}/{w.denominator * k}" if w >= 0 else f"-{-w.numerator * k}/{w.denominator * k}"
        pairs.append((a, b))
    rows = [(a, "1", "0", [b], 1, []) for a, b in pairs]
    df = spark.createDataFrame(rows, "response string, answer_num string, answer_den string, working_tokens array<string>, working_min int, question_values array<string>")
    got = {(r.response, r.working_tokens[0]): r.working_shown for r in M.check_working(df).collect()}

    def want(a: str, b: str) -> bool:
        literal = a.lstrip("-").replace(" / ", "/")  # literals carry no sign
        below = literal.rpartition("/")[2] if "/" in literal else "1"
        return bool(int(below)) and (literal == b or value(b) is not None and value(literal) == value(b))

    assert got == {(a, b): want(a, b) for a, b in pairs} and any(got.values()) and not all(got.values())
    assert [rationals.value(a) for a, _ in pairs] == [value(a) for a, _ in pairs]


def test_working_with_long_tokens(spark):
    n = 123456789012345678901234567890
    rows = [
        (f"it is {3 * n}/{6 * n} so 1/2", 1, 2, [f"{n}/{2 * n}"], []), (f"it is {n}.50", 2 * n + 1, 2, [f"{n} 1/2"], []),
        (f"{n}", n + 1, 1, [str(n + 1)], []), (f"only {2 * n}/2 here", n, 1, [str(n)], [str(n)]),
    ]
    rows = [(r, str(a), str(b), w, 1, q) for r, a, b, w, q in rows]
    df = spark.createDataFrame(rows, "response string, answer_num string, answer_den string, working_tokens array<string>, working_min int, question_values array<string>")
    got = [(r.answer_shown, r.working_shown) for r in M.check_working(df).collect()]
    assert got == [(True, True), (True, True), (False, False), (True, False)]


def test_page_offset_carries_no_text_in_ids(spark, monkeypatch):
    """A word's row holds its line's place, not the line; lines that share a place are all tried."""
    seen = {}
    found = S.find_patterns
    monkeypatch.setattr(S, "find_patterns", lambda p, t, scope: seen.setdefault("hit", found(p, seen.setdefault("texts", t), scope)))
    contents = spark.createDataFrame([("d", 1, "Two words here", 9)], "doc string, position long, title string, printed int")
    lines = spark.createDataFrame([("d", 3, 1, "# other line"), ("d", 3, 1, "# two words here"), ("d", 5, 2, "# two words here")], "doc string, page int, line_no int, line string")
    assert S.page_offset(contents, lines).first()["offset"] == 6
    assert "norm" not in seen["texts"].schema["text_id"].dataType.names


def test_patterns_are_worked_out_once(spark):
    """Every use of the aliases reads one written copy: the costly step behind them runs once a row."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        calls.add(1)
        return v

    pages = spark.createDataFrame([(1, "write an Essay now"), (2, "scoring of tasks"), (3, "re-tell the lecture")], "page int, text string")
    aliases = spark.createDataFrame([("essay", "essay"), ("retell", "tell the  lecture"), ("none", "absent words here"), ("void", None)], "task_type string, alias string").coalesce(1)
    hits = Q.guide_pages(pages, aliases.withColumn("alias", counted.asNondeterministic()("alias")))
    assert {(r.task_type, r.page, r.matched) for r in hits.collect()} == {("essay", 1, True), ("retell", 3, True), ("none", 2, False), ("void", 2, False)}
    assert calls.value == 4
