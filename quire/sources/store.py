"""Stored documents and attempt history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import latest_per_key

# ---------------------------------------------------------------------------
# Fixed values
NON_BLOCKING_CODES = ["EMPTY_CLEAN_CHUNK_TEXT"]
LABEL = r"(?i)^([a-z0-9_-]+):ch0*(\d+)$"
CONTENT_LISTS = ["learning_objectives", "key_terms", "core_lessons", "worked_examples", "practice_questions", "review_checklist"]
HISTORY_LIMIT = 100
EXCERPT = 90
WITHHELD = {
    "reading": ["correct", "rationale"],
    "math": ["answer_num", "answer_den", "answer_tex", "answer_plain", "check_expr", "answer_is_reduced", "answer_ratio"],
}
# ---------------------------------------------------------------------------


def chapter_key(slug: Column | str, number: Column | str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(slug if isinstance(slug, Column) else F.col(slug), F.lit(":ch"), F.format_string("%02d", number.cast("int")))


def enrichment_key(slug: Column | str, number: Column | str) -> Column:
    return F.concat(chapter_key(slug, number), F.lit(":enrichment"))


def parse_label(label: Column) -> Column:
    """(book_slug, chapter_number) of ``slug:chNN``, else null."""
    s = F.trim(label)
    return F.when(
        s.rlike(LABEL),
        F.struct(F.lower(F.regexp_extract(s, LABEL, 1)).alias("book_slug"), F.regexp_extract(s, LABEL, 2).try_cast("int").alias("chapter_number")),
    )


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key of both sides; incoming wins a tie."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return latest_per_key(both, keys, [*order, "__new"]).drop("__new")


def load_gate(chapters: DataFrame, errors: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Chapters with ``loaded``: no contract error that blocks."""
    blocking = errors.filter(~F.col("code").isin(NON_BLOCKING_CODES)).groupBy(key).agg(F.count(F.lit(1)).alias("blocking_errors"))
    return chapters.join(blocking, key, "left").na.fill(0, ["blocking_errors"]).withColumn("loaded", F.col("blocking_errors") == 0)


def register_extracted(documents: DataFrame) -> DataFrame:
    """Light registration: one chapter, a slug, an integer number, any content.

    documents: (document_id, slug, chapters int, chapter_number string, sizes map<string,int>).
    """
    filled = F.exists(F.array(*[F.lit(c) for c in CONTENT_LISTS]), lambda c: F.coalesce(F.element_at("sizes", c), F.lit(0)) > 0)
    code = T.first_reason(
        [
            (F.col("chapters") != 1, "not_one_chapter"), (T.int_or_null("chapter_number").isNull(), "no_chapter_number"),
            (T.blank("slug"), "no_slug"), (~filled, "no_content"),
        ]
    )
    return documents.withColumn("code", code).withColumn("status", F.when(F.col("code").isNull(), "extracted"))


def append_attempts(attempts: DataFrame, path: str) -> None:
    attempts.write.mode("append").parquet(path)


def history(attempts: DataFrame, book: str | None = None, task: str | None = None, n: int = HISTORY_LIMIT) -> DataFrame:
    """Newest attempts first, with a prompt excerpt (S8). A bounded top-n, no full sort."""
    if book:
        attempts = attempts.filter(F.col("book_slug") == book)
    if task:
        attempts = attempts.filter(F.col("task_type") == task)
    excerpt = F.when(F.length("prompt_text") > EXCERPT, F.concat(F.left("prompt_text", F.lit(EXCERPT)), F.lit("…"))).otherwise(F.col("prompt_text"))
    return attempts.withColumn("prompt_excerpt", excerpt).drop("prompt_text").orderBy(F.desc("id")).limit(n)


def document_section(documents: DataFrame, name: str, known: list[str], column: str = "document") -> DataFrame:
    """One named part of stored JSON documents; unknown names are refused."""
    if name not in known:
        raise ValueError(f"unknown section: {name}")
    return documents.withColumn("section", F.get_json_object(column, f"$.{name}"))


def public_items(items: DataFrame, withheld: list[str]) -> DataFrame:
    """Bank without the columns learners may not see."""
    return items.drop(*withheld)
