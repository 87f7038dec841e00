"""Review schedule per (learner, item): batch fold and keyed stream (L8), snapshot sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Seconds until an item returns, by level; seconds for a mastered one
INTERVALS = [60, 600, 86400, 259200, 604800, 1382400]
MASTERY_LEVEL = 6
MASTERY_REVIEW = 60 * 86400
# ---------------------------------------------------------------------------

STATE_SCHEMA = (
    "learner string, item_id string, level int, due_at double, introduced_at double, last_studied_at double, "
    "times_seen long, times_correct long, streak long, mastered_at double"
)

# A run of answers as a value that composes: counts, first and last time, the level map
# of everything up to the last wrong answer (x -> min(hi, max(lo, x + shift))), the number
# of right answers after it and the times of the first six of those.
PART = (
    "struct<seen:bigint,right:bigint,first:double,last:double,wrong:boolean,lo:int,hi:int,shift:bigint,"
    "tail:bigint,times:array<double>>"
)


def _part(seen, right, first, last, wrong, lo, hi, shift, tail, times) -> Column:
    names = ["seen", "right", "first", "last", "wrong", "lo", "hi", "shift", "tail", "times"]
    values = [seen, right, first, last, wrong, lo, hi, shift, tail, times]
    return F.struct(*[v.alias(n) for n, v in zip(names, values)]).cast(PART)


def _one(time: Column, right: Column) -> Column:
    """A single answer. A wrong one is the map x -> max(0, x - 1); a right one is all tail."""
    r = right.cast("long")
    return _part(
        F.lit(1), r, time, time, ~right, F.lit(0), F.lit(MASTERY_LEVEL), F.when(right, 0).otherwise(-1), r,
        F.when(right, F.array(time)).otherwise(F.array().cast("array<double>")),
    )


def _through(value: Column, part: Column) -> Column:
    return F.least(part["hi"], F.greatest(part["lo"], value + part["shift"]))


def _joined(a: Column, b: Column) -> Column:
    """Answers of ``a`` followed by those of ``b``."""
    top = F.lit(MASTERY_LEVEL)
    raised = lambda v: F.least(top, v + a["tail"])  # the right answers after a's last wrong one
    lo, hi = raised(a["lo"]), raised(a["hi"])
    times = F.when(b["wrong"], b["times"]).otherwise(F.slice(F.concat(a["times"], b["times"]), 1, MASTERY_LEVEL))
    return _part(
        a["seen"] + b["seen"], a["right"] + b["right"], a["first"], b["last"], a["wrong"] | b["wrong"],
        F.when(b["wrong"], _through(lo, b)).otherwise(a["lo"]),
        F.when(b["wrong"], _through(hi, b)).otherwise(a["hi"]),
        F.when(b["wrong"], a["shift"] + a["tail"] + b["shift"]).otherwise(a["shift"]),
        F.when(b["wrong"], b["tail"]).otherwise(a["tail"] + b["tail"]),
        times,
    )


def _fold(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Compose the parts of each group in order; groups are tiles, so they are small."""
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "part"))).alias("__p"))
    rest = F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1)))
    return gathered.select(
        *keys, F.aggregate(rest, F.col("__p")[0]["part"].cast(PART), lambda acc, x: _joined(acc, x["part"])).alias("part")
    )


def fold_schedule(attempts: DataFrame, keys: list[str] | None = None, tile_bits: tuple[int, ...] = (10, 20)) -> DataFrame:
    """State of every (learner, item) after all its answers, in the order they arrived.

    attempts: (learner, item_id, time double, attempt_id long, correct). Ids are unique and
    grow with arrival; an answer whose time lies before an earlier one's counts where it arrived. Answers
    are composed by tiles of ids: 2^10 ids, then 2^20, then the rest, so one pair holding
    a third of the table never meets in one task and equal times gather nothing.
    """
    keys = keys or ["learner", "item_id"]
    rows = attempts.select(*keys, "attempt_id", _one(F.col("time"), F.col("correct")).alias("part"))
    names = [f"__t{b}" for b in tile_bits]
    rows = rows.select("*", *[F.shiftright("attempt_id", b).alias(n) for b, n in zip(tile_bits, names)])
    order = "attempt_id"
    for i, name in enumerate(names):
        rows, order = _fold(rows, [*keys, *names[i:]], order), name
    return _fold(rows, keys, order).select(*keys, *_state(F.col("part")))


def _state(p: Column) -> list[Column]:
    base = F.when(p["wrong"], _through(F.lit(0), p)).otherwise(F.lit(0))
    level = F.least(F.lit(MASTERY_LEVEL).cast("long"), base + p["tail"]).cast("int")
    mastered = (p["tail"] > 0) & (level >= MASTERY_LEVEL)
    # the answer that took the level to six: the (6 - base)-th of the tail, the first one if it was six already
    at = F.greatest(F.lit(1), MASTERY_LEVEL - base).cast("int")
    wait = F.element_at(F.array(*[F.lit(float(v)) for v in INTERVALS]), F.least(level + 1, F.lit(MASTERY_LEVEL)))
    due = F.when(p["tail"] == 0, p["last"] + INTERVALS[0]).when(mastered, p["last"] + MASTERY_REVIEW).otherwise(p["last"] + wait)
    return [
        level.alias("level"), due.cast("double").alias("due_at"), p["first"].alias("introduced_at"), p["last"].alias("last_studied_at"),
        p["seen"].alias("times_seen"), p["right"].alias("times_correct"), p["tail"].alias("streak"),
        F.when(mastered, F.try_element_at(p["times"], at)).alias("mastered_at"),
    ]


def apply_answer(state: dict, right: bool, time: float) -> dict:
    """One answer on one state, the rule the fold composes."""
    state["times_seen"] += 1
    state["introduced_at"] = time if state["introduced_at"] is None else state["introduced_at"]
    state["times_correct"] += int(right)
    state["last_studied_at"] = time
    if right:
        state["streak"] += 1
        state["level"] = min(MASTERY_LEVEL, state["level"] + 1)
        done = state["level"] == MASTERY_LEVEL
        if done and state["mastered_at"] is None:
            state["mastered_at"] = time
        state["due_at"] = time + (MASTERY_REVIEW if done else INTERVALS[state["level"]])
    else:
        state.update(streak=0, level=max(0, state["level"] - 1), mastered_at=None, due_at=time + INTERVALS[0])
    return state


FIELDS = ["level", "due_at", "introduced_at", "last_studied_at", "times_seen", "times_correct", "streak", "mastered_at"]
NEW = dict(zip(FIELDS, [0, None, None, None, 0, 0, 0, None]))


GROUPED = ", ".join(f"{name} array<{kind}>" for name, kind in (part.split() for part in STATE_SCHEMA.split(", "))) + ", groups int"


def _update(key, batches: Iterator[pd.DataFrame], group_state) -> Iterator[pd.DataFrame]:
    """One group of pairs: its answers in id order, each applied to the state of its own pair."""
    groups, held = key[1], {}
    if group_state.exists:
        *columns, kept = group_state.get
        if kept != groups:
            raise ValueError(f"the stream keeps its states in {kept} groups, not {groups}")
        held = {(learner, item): state for learner, item, *state in zip(*columns)}
    answers: dict = {}
    for b in batches:
        for learner, item, time, i, c in zip(b["learner"], b["item_id"], b["time"], b["attempt_id"], b["correct"]):
            answers.setdefault((learner, item), []).append((i, time, bool(c)))
    for pair, found in answers.items():
        state = dict(zip(FIELDS, held[pair])) if pair in held else dict(NEW)
        for _, time, right in sorted(found):
            apply_answer(state, right, float(time))
        held[pair] = [state[f] for f in FIELDS]
    group_state.update((*map(list, zip(*[(*pair, *state) for pair, state in held.items()])), groups))
    yield pd.DataFrame([[*pair, *held[pair]] for pair in answers], columns=["learner", "item_id", *FIELDS])


def schedule_stream(attempts: DataFrame, groups: int = 4096) -> DataFrame:
    """Changed states of a stream of answers, keyed by (learner, item).

    attempts: (learner string, item_id string, time double, attempt_id long, correct boolean), a log whose ids grow from
    batch to batch. Inside a micro-batch the answers of a key are put in id order first; size the source's
    trigger (files or offsets per batch) to bound them. Keys are dealt to ``groups`` by a hash and a group's states are kept
    together, for a call of Python per key costs far more than a key's answers; a batch rewrites the groups it touches. A
    checkpoint holds to its number of groups.
    """
    group = F.pmod(F.xxhash64("learner", "item_id"), F.lit(groups)).cast("int").alias("group")
    return attempts.select("*", group, F.lit(groups).alias("groups")).groupBy("group", "groups").applyInPandasWithState(
        _update, outputStructType=STATE_SCHEMA, stateStructType=GROUPED, outputMode="update", timeoutConf="NoTimeout"
    )


COMMIT_SCHEMA = "bucket int, holder long, version long"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Rows (bucket, holder, version): which version's files hold each bucket, one small set of rows a version."""
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT_SCHEMA)


def _held(spark: SparkSession, path: str, holders: dict[int, int]) -> DataFrame:
    """States in the files of the buckets named."""
    files = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(holders.items())]
    return spark.read.schema(STATE_SCHEMA).parquet(*files) if files else spark.createDataFrame([], STATE_SCHEMA)


def _holders(commits: DataFrame, version: int) -> dict[int, int]:
    rows = commits.filter(F.col("version") == version)
    return {r.bucket: r.holder for r in rows.toLocalIterator()}  # a row a bucket


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest committed state of every key."""
    commits = _commits(spark, path)
    version = commits.agg(F.max("version")).first()[0]
    return _held(spark, path, {b: v for b, v in _holders(commits, version).items() if v is not None}) if version is not None else _held(spark, path, {})


def snapshot_sink(path: str, buckets: int = 64):
    """``foreachBatch`` writer that keeps the latest state per key in a versioned snapshot.

    Keys are dealt to ``buckets`` by a hash; a batch rewrites only the buckets it touches, under
    its own version, and commits a table of which version holds each bucket last. A batch that is run again
    writes the same version again. It fails, and writes nothing, where the version before it is not
    committed, where a first batch finds versions of another stream, or where the number of buckets has changed. Files that
    the newest commit does not name may be deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commits = _commits(spark, path)
        newest = commits.agg(F.max("version")).first()[0]
        if newest is not None and newest > batch_id:
            raise ValueError(f"{path} holds version {newest}, later than batch {batch_id}: it belongs to another stream")
        holders = _holders(commits, batch_id - 1) if batch_id else dict.fromkeys(range(buckets))
        if not holders:
            raise ValueError(f"{path} lacks version {batch_id - 1}")
        if len(holders) != buckets:
            raise ValueError(f"{path} has {len(holders)} buckets, not {buckets}")
        bucket = F.pmod(F.xxhash64("learner", "item_id"), F.lit(buckets)).cast("int").alias("bucket")
        rows = batch.select("*", bucket).persist()
        try:
            touched = [r.bucket for r in rows.select("bucket").distinct().toLocalIterator()]  # at most ``buckets``
            old = _held(spark, path, {b: holders[b] for b in touched if holders[b] is not None})
            kept = old.join(rows.select("learner", "item_id"), ["learner", "item_id"], "left_anti").select("*", bucket)
            rows.unionByName(kept).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/version={batch_id}")
        finally:
            rows.unpersist()
        now = {**holders, **dict.fromkeys(touched, batch_id)}
        manifest = spark.createDataFrame(list(now.items()), "bucket int, holder long").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{path}/commits/version={batch_id}")

    return write
