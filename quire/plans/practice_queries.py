"""Marking and schedule queries."""

from pyspark.sql import functions as F

from quire.operators import practice as P
from quire.plans.registry import Tables, derive, query
from quire.sources.scratch import shared_path
from quire.streaming import schedule as S


@query(
    "fraction_marks",
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n, CAST(l_suppkey AS BIGINT) AS s FROM lineitem)
       SELECT s % 5 AS form, count(*) AS answers, count(*) FILTER (WHERE ok AND simple) AS correct, count(*) FILTER (WHERE ok) AS equal, count(*) FILTER (WHERE readable) AS readable FROM (
         SELECT s, CASE s % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN n % 2 = 0 WHEN 3 THEN true ELSE false END AS ok, CASE s % 5 WHEN 0 THEN q = 0 OR q = 1 OR gcd(n, q) = 1 WHEN 1 THEN q * 2 = 1 ELSE true END AS simple, s % 5 <> 4 AS readable FROM a) GROUP BY s % 5""",
)
def fraction_marks(t: Tables):
    """Answers written as n/q, 2n/2q, a decimal, with commas, and as text."""
    q, n, s = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_suppkey") % 5
    text = lambda v: v.cast("string")
    typed = (
        F.when(s == 0, F.concat(text(n), F.lit("/"), text(q))).when(s == 1, F.concat(text(n * 2), F.lit(" / "), text(q * 2)))
        .when(s == 2, F.concat(text(n), F.when(n % 2 == 0, ".50").otherwise(".40"))).when(s == 3, F.concat(F.lit("1,000/"), text(n * 2), F.lit(",000"))).otherwise(F.lit("half"))
    )
    num = F.when(s.isin(0, 1, 4), n).when(s == 2, n * 2 + 1).otherwise(F.lit(1))
    den = F.when(s.isin(0, 1, 4), q).when(s == 2, F.lit(2)).otherwise(n * 2)
    rows = t.lineitem.select(s.alias("form"), P.mark_number(typed, num, den).alias("m"))
    return rows.groupBy("form").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("m.correct").alias("correct"), F.count_if("m.equal").alias("equal"), F.count_if("m.readable").alias("readable")
    )


@query(
    "ratio_marks",
    """SELECT l_suppkey % 3 AS form, count(*) FILTER (WHERE ok) AS equal, count(*) FILTER (WHERE ok AND g = 1) AS correct FROM (SELECT l_suppkey, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS ok,
         CASE l_suppkey % 3 WHEN 0 THEN gcd(l_linenumber, CAST(l_quantity AS BIGINT)) WHEN 1 THEN 2 * gcd(l_linenumber, CAST(l_quantity AS BIGINT)) END AS g FROM lineitem) GROUP BY l_suppkey % 3""",
)
def ratio_marks(t: Tables):
    q, n, s = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_suppkey") % 3
    text = lambda v: v.cast("string")
    typed = F.when(s == 0, F.concat(text(n), F.lit(" to "), text(q))).when(s == 1, F.concat(text(n * 2), F.lit(":"), text(q * 2))).otherwise(F.concat(text(n), F.lit("to"), text(q)))
    rows = t.lineitem.select(s.alias("form"), P.mark_ratio(typed, n, q).alias("m"))
    return rows.groupBy("form").agg(F.count_if("m.equal").alias("equal"), F.count_if("m.correct").alias("correct"))


@query(
    "choice_marks",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_type = 'click' THEN 1 ELSE 0 END ELSE CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 0 ELSE 0 END END AS score,
       user_id % 2 = 1 AND event_type = 'error' AS floored FROM events""",
)
def choice_marks(t: Tables):
    single = F.col("user_id") % 2 == 0
    pick = lambda *k: F.array(*[F.lit(v) for v in k])
    chosen = F.when(F.col("event_type") == "click", pick("a ")).when(F.col("event_type") == "view", pick("A", "B")).when(F.col("event_type") == "signup", pick("A", "C")).when(F.col("event_type") == "purchase", pick("z")).otherwise(pick("C", "d"))
    correct = F.when(single, pick("A")).otherwise(pick("A", "B"))
    rows = t.events.select("event_id", P.mark_choice(F.when(single, "single").otherwise("multiple"), chosen, correct, pick("A", "B", "C", "D")).alias("m"))
    return rows.select("event_id", "m.score", "m.floored")


_W = r"len(list_filter(regexp_split_to_array({c}, '[ \n]+'), lambda x: x <> ''))"
_CAPS = r"(len(regexp_extract_all({c}, '\p{{L}}')) > 0 AND len(regexp_extract_all({c}, '\p{{L}}')) = len(regexp_extract_all({c}, '\p{{Lu}}')))"


@query(
    "essay_form",
    rf"""SELECT doc_id, CASE WHEN caps OR NOT regexp_matches(s, '[.?!]') OR bul OR w < 120 OR w > 380 THEN 0 WHEN w BETWEEN 200 AND 300 THEN 2 ELSE 1 END AS form FROM (SELECT doc_id, s, {_CAPS.format(c='s')} AS caps, {_W.format(c='s')} AS w,
         len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '')) > 0 AND len(list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^[-*•]'))) = 0 AS bul FROM (SELECT doc_id, trim(text, ' ' || chr(10)) AS s FROM documents))""",
)
def essay_form(t: Tables):
    return t.documents.select("doc_id", P.essay_form(F.col("text"))["form"].alias("form"))


@query(
    "summary_form",
    rf"""SELECT conv_id, turn, CASE WHEN caps THEN 'capitals' WHEN w < 5 THEN 'too_short' WHEN w > 75 THEN 'too_long' WHEN n > 1 THEN 'several_sentences' ELSE 'one_sentence' END AS reason FROM (SELECT conv_id, turn, {_CAPS.format(c='s')} AS caps, {_W.format(c='s')} AS w,
         len(list_filter(string_split(regexp_replace(s, '[.!?]+([ \n]|$)', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '')) AS n FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS s FROM conversations))""",
)
def summary_form(t: Tables):
    return t.conversations.select("conv_id", "turn", P.summary_form(F.col("text"))["reason"].alias("reason"))


derive("trait_rows", "SELECT l_orderkey AS attempt_id, CASE l_linenumber WHEN 1 THEN 'content' WHEN 2 THEN 'form' WHEN 3 THEN 'grammar' ELSE 'vocabulary' END AS name, CAST(l_quantity AS INT) - 20 AS score FROM lineitem")


@query(
    "trait_gating",
    """WITH r AS (SELECT attempt_id, name, CASE name WHEN 'content' THEN greatest(0, least(score, 4)) WHEN 'form' THEN f WHEN 'grammar' THEN greatest(0, least(score, 2)) ELSE greatest(0, least(score, 2)) END AS s FROM trait_rows JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS f FROM orders) ON o_orderkey = attempt_id),
       g AS (SELECT attempt_id, coalesce(max(CASE WHEN name = 'content' THEN s END), 0) AS c, coalesce(max(CASE WHEN name = 'form' THEN s END), 0) AS f, sum(s) AS t FROM r GROUP BY attempt_id)
       SELECT attempt_id, c = 0 OR f = 0 AS gating_applied, CAST(CASE WHEN c = 0 OR f = 0 THEN 0 ELSE t END AS BIGINT) AS raw_total FROM g""",
)
def trait_gating(t: Tables):
    forms = t.orders.select(F.col("o_orderkey").alias("attempt_id"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("form"))
    return P.gate_traits(t.trait_rows, forms, P.SUMMARY_CAPS).drop("max_raw_total")


derive("series", "SELECT o_orderpriority AS item_id, CAST(extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate) AS INT) AS i, CAST(count(*) AS DOUBLE) AS value, 'm' || CAST(min(CAST(extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate) AS INT)) AS STRING) AS label FROM orders GROUP BY o_orderpriority, extract(year FROM o_orderdate), extract(month FROM o_orderdate)")


@query(
    "series_facts",
    """WITH s AS (SELECT *, lag(value) OVER w AS p, lag(label) OVER w AS pl FROM series WINDOW w AS (PARTITION BY item_id ORDER BY i)), g AS (SELECT item_id, count(*) AS points, arg_max(label, value * 1000000 - i) AS highest, arg_min(label, value * 1000000 + i) AS lowest, round(sum(value), 6) AS total, round(max(value) - min(value), 6) AS gap,
         arg_max(pl || '>' || label, abs(value - p) * 1000000 + i) AS step, max(abs(value - p)) AS largest_step, arg_min(value, i) AS f, arg_max(value, i) AS l FROM s GROUP BY item_id), t2 AS (SELECT item_id, sum(value) AS top_two FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY value DESC, label DESC) AS r FROM series) WHERE r <= 2 GROUP BY item_id)
       SELECT item_id, points, highest, lowest, total, gap, step, largest_step, CASE WHEN l > f THEN 'rose' WHEN l < f THEN 'fell' ELSE 'stayed level' END AS trend, top_two FROM g JOIN t2 USING (item_id)""",
)
def series_facts(t: Tables):
    f = P.series_facts(t.series, ["item_id"])
    return f.select("item_id", "points", "highest", "lowest", "total", "gap", F.concat_ws(">", "step_from", "step_to").alias("step"), "largest_step", "trend", "top_two")


derive("said_numbers", "SELECT event_type AS item_id, CAST(floor(value * 10) AS DOUBLE) AS number FROM events")
derive("true_numbers", "SELECT event_type AS item_id, floor(value) * 7.0 AS number FROM events")


@query(
    "stated_numbers",
    r"""WITH s AS (SELECT DISTINCT item_id, number AS n FROM said_numbers), a AS (SELECT DISTINCT item_id, CAST(number AS DOUBLE) AS m FROM true_numbers),
       t AS (SELECT *, CASE WHEN n = 0 THEN 5.0 ELSE greatest(0.5, 0.5 * pow(10, len(regexp_extract(CAST(CAST(n AS BIGINT) AS STRING), '(0*)$', 1)))) END AS tol FROM s)
       SELECT t.item_id, t.n AS number FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.item_id = t.item_id AND abs(a.m - t.n) <= t.tol) AND NOT (t.n <= 12 AND NOT EXISTS (SELECT 1 FROM a WHERE a.item_id = t.item_id AND abs(a.m - t.n) < 1e-9))""",
)
def stated_numbers(t: Tables):
    return P.unsupported_numbers(t.said_numbers, t.true_numbers.withColumn("number", F.col("number").cast("double")), ["item_id"])


@query(
    "allowed_numbers",
    """WITH p AS (SELECT n_regionkey AS item_id, CAST(n_nationkey AS DOUBLE) AS v FROM nation), g AS (SELECT item_id, sum(v) AS s, max(v) AS hi, min(v) AS lo FROM p GROUP BY item_id)
       SELECT DISTINCT item_id, number FROM (SELECT item_id, v AS number FROM p UNION ALL SELECT item_id, s FROM g UNION ALL SELECT item_id, hi - lo FROM g UNION ALL SELECT item_id, round(hi / lo, 1) FROM g WHERE lo <> 0 UNION ALL SELECT item_id, CAST(item_id AS DOUBLE) FROM g)""",
)
def allowed_numbers(t: Tables):
    points = t.nation.select(F.col("n_regionkey").alias("item_id"), F.col("n_nationkey").alias("i"), F.lit("x").alias("label"), F.col("n_nationkey").cast("double").alias("value"))
    items = t.region.select(F.col("r_regionkey").alias("item_id"), F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("title"), F.lit("bar").alias("chart_type"))
    return P.allowed_numbers(points, items)


@query(
    "working_shown",
    """SELECT l_linenumber AS n, count(*) FILTER (WHERE l_suppkey % 2 = 0) AS answer_shown, count(*) FILTER (WHERE l_suppkey % 3 = 0) AS working_shown, count(*) FILTER (WHERE l_suppkey % 6 = 0) AS correct FROM lineitem GROUP BY l_linenumber""",
)
def working_shown(t: Tables):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    say = F.concat(F.lit("I see 900/7 and "), F.when(s % 3 == 0, F.concat(n.cast("string"), F.lit(" /  500"))).otherwise(F.lit("nothing")), F.when(s % 2 == 0, F.lit(" so 2 1/2")).otherwise(F.lit(" so 3/4")))
    rows = t.lineitem.select(
        n.alias("n"), say.alias("response"), F.lit(5).alias("answer_num"), F.lit(2).alias("answer_den"), F.array(F.concat(n.cast("string"), F.lit("/500"))).alias("working_tokens"), F.lit(1).alias("working_min"), F.array(F.lit("900/7")).alias("question_values")
    )
    c = P.check_working(rows)
    return c.groupBy("n").agg(*[F.count_if(F.col(x)).alias(x) for x in ("answer_shown", "working_shown", "correct")])


@query(
    "description_coverage",
    """WITH f AS (SELECT o_orderkey AS a, l_linenumber AS k, CASE WHEN l_linenumber <= 3 THEN 'essential' ELSE 'supporting' END AS imp, l_returnflag = 'R' AS yes, o_custkey FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_returnflag FROM lineitem) ON l_orderkey = o_orderkey)
       SELECT o.o_orderkey AS attempt_id, CAST(greatest(0, least(o_custkey % 10 - 1, 6)) AS BIGINT) AS content_score, coalesce(e, 0) AS essential_covered, coalesce(s, 0) AS supporting_total, greatest(0, least(o_custkey % 10 - 1, 6)) = 0 AS gating_applied FROM orders o LEFT JOIN (SELECT a, count(*) FILTER (WHERE imp = 'essential' AND yes) AS e, count(*) FILTER (WHERE imp = 'supporting') AS s FROM f GROUP BY a) x ON x.a = o.o_orderkey""",
)
def description_coverage(t: Tables):
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 10 - 1).alias("content_score"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("key")).agg(F.max("l_returnflag").alias("flag"))
    facts = lines.select("item_id", "key", F.when(F.col("key") <= 3, "essential").otherwise("supporting").alias("importance"))
    judged = lines.filter(F.col("flag") == "R").select(F.col("item_id").alias("attempt_id"), "key", F.lit("yes").alias("covered"))
    c = P.description_coverage(attempts, facts, judged)
    return c.select("attempt_id", F.col("content_score").cast("long").alias("content_score"), "essential_covered", "supporting_total", "gating_applied")


# -- schedule ---------------------------------------------------------------------------------------------
derive(
    "schedule",
    "SELECT 1 AS unused",
    """WITH o AS (SELECT learner, item_id, list(correct ORDER BY attempt_id) AS c, list(epoch_us(ts) / 1e6 ORDER BY attempt_id) AS tt FROM attempts GROUP BY learner, item_id),
       l AS (SELECT *, list_reduce(list_transform(c, lambda x: CASE WHEN x THEN 1 ELSE -1 END), lambda a, x: least(6, greatest(0, a + x)), 0) AS level, len(c) - coalesce(list_position(list_reverse(c), false), len(c) + 1) AS tl FROM o),
       m AS (SELECT *, CASE WHEN list_position(list_reverse(c), false) IS NULL THEN len(c) ELSE list_position(list_reverse(c), false) - 1 END AS streak FROM l),
       b AS (SELECT *, list_reduce(list_transform(c[1:len(c) - streak], lambda x: CASE WHEN x THEN 1 ELSE -1 END), lambda a, x: least(6, greatest(0, a + x)), 0) AS base FROM m)
       SELECT learner, item_id, level, tt[len(tt)] + CASE WHEN streak = 0 THEN 60 WHEN level >= 6 THEN 5184000 ELSE [60, 600, 86400, 259200, 604800, 1382400][level + 1] END AS due_at, tt[1] AS introduced_at, len(c) AS times_seen, len(list_filter(c, lambda x: x)) AS times_correct, streak,
       CASE WHEN streak > 0 AND level >= 6 THEN tt[len(c) - streak + greatest(1, 6 - base)] END AS mastered_at FROM b""",
)


def _states(t: Tables):
    a = t.attempts.select("learner", "item_id", "attempt_id", "correct", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"))
    return S.fold_schedule(a)


@query("practice_schedule", "SELECT learner, item_id, level, round(due_at, 3) AS due_at, times_seen, times_correct, streak, round(mastered_at, 3) AS mastered_at FROM schedule")
def practice_schedule(t: Tables):
    s = _states(t)
    return s.select("learner", "item_id", "level", F.round("due_at", 3).alias("due_at"), "times_seen", "times_correct", "streak", F.round("mastered_at", 3).alias("mastered_at"))


@query("practice_schedule_stream", "SELECT learner, item_id, level, round(due_at, 3) AS due_at, times_seen, times_correct, streak, round(mastered_at, 3) AS mastered_at FROM schedule")
def practice_schedule_stream(t: Tables):
    """The same states from a stream: two runs over the log, the second taking up the keyed state of the first."""
    a = t.attempts.select("learner", "item_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), "attempt_id", "correct")
    log, point, states = (shared_path(t.spark, n) for n in ("attempt-log", "stream-point", "states"))
    middle = a.agg(F.percentile_approx("attempt_id", 0.5)).first()[0] or 0
    for part in (F.col("attempt_id") <= middle, F.col("attempt_id") > middle):
        a.filter(part).write.mode("append").parquet(log)
        stream = t.spark.readStream.schema(a.schema).parquet(log)
        S.schedule_stream(stream).writeStream.outputMode("update").option("checkpointLocation", point).foreachBatch(S.snapshot_sink(states)).trigger(availableNow=True).start().awaitTermination()
    s = S.read_snapshot(t.spark, states)
    return s.select("learner", "item_id", "level", F.round("due_at", 3).alias("due_at"), "times_seen", "times_correct", "streak", F.round("mastered_at", 3).alias("mastered_at"))


def _queue(t: Tables):
    states = _states(t)
    bank = t.attempts.select("item_id").distinct().withColumn("position", F.substring("item_id", 2, 9).cast("int") + 1)
    now = t.attempts.agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6).alias("now"))
    learners = t.attempts.groupBy("learner").agg(F.max_by("item_id", "attempt_id").alias("avoid")).crossJoin(F.broadcast(now))
    return states, bank, learners


@query(
    "practice_next",
    """WITH n AS (SELECT max(epoch_us(ts) / 1e6) AS now FROM attempts), a AS (SELECT learner, arg_max(item_id, attempt_id) AS avoid FROM attempts GROUP BY learner), bank AS (SELECT DISTINCT item_id, CAST(substr(item_id, 2) AS INT) AS p FROM attempts),
       s AS (SELECT schedule.*, a.avoid, n.now FROM schedule JOIN a USING (learner), n), d AS (SELECT learner, item_id, row_number() OVER (PARTITION BY learner ORDER BY item_id = avoid, level, due_at, item_id) AS r FROM s WHERE mastered_at IS NULL AND due_at <= now),
       w AS (SELECT a.learner, b.item_id, row_number() OVER (PARTITION BY a.learner ORDER BY b.item_id = a.avoid, b.p) AS r FROM a, bank b WHERE (a.learner, b.item_id) NOT IN (SELECT learner, item_id FROM schedule)),
       h AS (SELECT learner, item_id, row_number() OVER (PARTITION BY learner ORDER BY item_id = avoid, due_at, level, item_id) AS r FROM s WHERE mastered_at IS NULL)
       SELECT a.learner, coalesce(d.item_id, w.item_id, h.item_id) AS item_id, CASE WHEN d.item_id IS NOT NULL THEN 'due' WHEN w.item_id IS NOT NULL THEN 'new' WHEN h.item_id IS NOT NULL THEN 'review' ELSE 'all_mastered' END AS reason
       FROM a LEFT JOIN d ON d.learner = a.learner AND d.r = 1 LEFT JOIN w ON w.learner = a.learner AND w.r = 1 LEFT JOIN h ON h.learner = a.learner AND h.r = 1""",
)
def practice_next(t: Tables):
    return P.next_item(*_queue(t))


@query(
    "practice_progress",
    """WITH n AS (SELECT max(epoch_us(ts) / 1e6) AS now FROM attempts), b AS (SELECT count(DISTINCT item_id) AS total FROM attempts)
       SELECT learner, any_value(total) AS total, count(*) FILTER (WHERE mastered_at IS NOT NULL) AS mastered, count(*) FILTER (WHERE mastered_at IS NULL AND due_at <= now) AS due, any_value(total) - count(*) AS "new", count(*) - count(*) FILTER (WHERE mastered_at IS NOT NULL) AS in_progress FROM schedule, n, b GROUP BY learner""",
)
def practice_progress(t: Tables):
    return P.progress(*_queue(t))
