"""One finding schema for every check, and the rule-array form in which checks are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING_SCHEMA = (
    "check string, severity string, key string, code string, detail string, fixable boolean"
)


def rule(condition: Column, code: str, path: Column | str, message: Column | str) -> Column:
    """One rule: null when it holds, else (code, json_path, message)."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(
            F.lit(code).alias("code"),
            as_col(path).cast("string").alias("json_path"),
            as_col(message).cast("string").alias("message"),
        ),
    )


def broken_rules(df: DataFrame, rules: list[Column], keep: list[str]) -> DataFrame:
    """One row per broken rule. A map-only pass: rules are a row-local array, exploded."""
    fired = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return df.select(*keep, F.explode(fired).alias("e")).select(*keep, "e.code", "e.json_path", "e.message")


def finding(
    df: DataFrame,
    check: str,
    severity: str,
    key: Column | str,
    code: Column | str,
    detail: Column | str = "",
    fixable: bool = True,
) -> DataFrame:
    """Rows of ``df`` as findings. ``key`` names a column; ``code`` and ``detail`` are literals or columns."""
    as_lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"),
        as_lit(code).alias("code"),
        as_lit(detail).cast("string").alias("detail"),
        F.lit(fixable).alias("fixable"),
    )


def rule_findings(df: DataFrame, key: str, rules: list[tuple[Column, str, str, str]]) -> DataFrame:
    """Findings of several (condition, check, severity, code) rules in one pass over the rows."""
    fired = F.filter(
        F.array(
            *[
                F.when(
                    F.coalesce(condition, F.lit(False)),
                    F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(code).alias("code")),
                )
                for condition, check, severity, code in rules
            ]
        ),
        lambda r: r.isNotNull(),
    )
    return df.select(F.col(key).cast("string").alias("key"), F.explode(fired).alias("e")).select(
        "e.check", "e.severity", "key", "e.code", F.lit("").alias("detail"), F.lit(True).alias("fixable")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def verdict_of(
    artifacts: DataFrame, findings: DataFrame, health: DataFrame, key: str = "key"
) -> DataFrame:
    """pass / fix / escalate per (artifact, check), with check health (Q15).

    ``artifacts``: one row per key. ``health``: (check, healthy). A check that did not
    flag its planted rows cannot pass an artifact, it escalates.
    """
    counts = findings.groupBy("key", "check").agg(
        F.count_if(~F.col("fixable")).alias("hard"), F.count(F.lit(1)).alias("n")
    )
    grid = artifacts.select(F.col(key).cast("string").alias("key")).crossJoin(F.broadcast(health))
    return grid.join(counts, ["key", "check"], "left").select(
        "key",
        "check",
        F.when(F.coalesce("hard", F.lit(0)) > 0, "escalate")
        .when(F.coalesce("n", F.lit(0)) > 0, "fix")
        .when(F.col("healthy"), "pass")
        .otherwise("escalate")
        .alias("verdict"),
        F.coalesce("n", F.lit(0)).alias("findings"),
    )


def overall_verdict(verdicts: DataFrame) -> DataFrame:
    """Worst verdict per artifact."""
    rank = F.when(F.col("verdict") == "escalate", 2).when(F.col("verdict") == "fix", 1).otherwise(0)
    return verdicts.groupBy("key").agg(F.max(rank).alias("r"), F.sum("findings").alias("findings")).select(
        "key",
        F.element_at(F.array(F.lit("pass"), F.lit("fix"), F.lit("escalate")), F.col("r") + 1).alias("verdict"),
        "findings",
    )


def check_health(name: str, check, good: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """(check, healthy): run ``check`` over planted rows; every bad one flagged, no good one.

    The planted rows carry a tag in ``key`` so that one run covers both.
    """
    tagged = good.withColumn(key, F.concat(F.lit("good:"), F.col(key).cast("string"))).unionByName(
        bad.withColumn(key, F.concat(F.lit("bad:"), F.col(key).cast("string")))
    )
    flagged = check(tagged).select(F.col("key")).distinct()
    return (
        tagged.select(F.col(key).alias("key"))
        .join(flagged.withColumn("hit", F.lit(True)), "key", "left")
        .agg(
            F.bool_and(
                F.when(F.startswith("key", F.lit("bad:")), F.col("hit").isNotNull()).otherwise(F.col("hit").isNull())
            ).alias("healthy")
        )
        .select(F.lit(name).alias("check"), "healthy")
    )
