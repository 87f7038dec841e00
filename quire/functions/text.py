"""Text column functions. All are built-in expressions except ``nfkc``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes that give the same answer as Python's str methods.
SPACE = r"[\s\x1C-\x1F]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
WORD_AFTER = r"(?![\p{L}\p{N}_])"
URL_OR_EMAIL = r"(?i)https?://|www\.|\S+@\S+\.\S+"
PAGE_NUMBER = r"(?i)^(?:page\s*)?\d{1,4}$"
GAP = rf"{WORD_BEFORE}[a-z]{{1,6}}{WORD_AFTER} {{2,}}[a-z]{{1,6}}{WORD_AFTER}"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squash(text: Column | str) -> Column:
    """Runs of any white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(text), f"(?U){SPACE}+", " "))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"(?U){SPACE}+\z", "")


def blank(text: Column | str) -> Column:
    """Whether ``strip`` leaves nothing; it ends at the first other character."""
    return F.coalesce(~F.rlike(_col(text), F.lit(rf"(?U)[^{SPACE[1:]}")), F.lit(True))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, for inside a list's lambda every mention of an expression works it out anew."""
    return F.transform(F.array(value), use)[0]


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; the one text step Spark has no expression for."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def contract_text(text: Column | str) -> Column:
    """NFKC, then squash: the form in which quotes and sources are compared.

    ASCII text is its own NFKC form, so only other rows' text crosses to Python.
    """
    column = _col(text)
    return squash(F.coalesce(nfkc(F.when(column.rlike(r"[^\x00-\x7F]"), column)), column))


def match_text(text: Column | str) -> Column:
    return F.lower(squash(text))


def words(text: Column | str) -> Column:
    """White-space separated words, as ``str.split()`` gives them."""
    return F.filter(F.split(squash(text), " "), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"(?U)[^\s\x1C-\x1F]+")), F.lit(0))


def count_chars(text: Column | str, char_class: str) -> Column:
    """Number of characters inside a regex class such as ``\\p{L}``."""
    return F.regexp_count(_col(text), F.lit(f"(?U)[{char_class}]"))


def letters(text: Column | str) -> Column:
    return count_chars(text, r"\p{L}")


def symbols(text: Column | str) -> Column:
    return count_chars(text, r"^\p{L}\p{N}\s\x1C-\x1F")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def lines(text: Column | str) -> Column:
    """Lines as ``str.splitlines`` gives them: no trailing empty line."""
    parts = F.split(_col(text), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def preview(text: Column | str, limit: int, right_trim: bool = True) -> Column:
    """Squashed text cut to ``limit`` with an ellipsis."""
    clean = squash(text)
    head = F.left(clean, F.lit(limit - 3))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.rtrim(head) if right_trim else head, F.lit("..."))
    )


def natural_key(value: Column | str) -> Column:
    """Sortable array in which digit runs of any length compare as numbers: their length in ten digits, then they without leading zeros."""
    parts = F.regexp_extract_all(_col(value), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    padded = F.transform(
        parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)
    )
    return F.when(_col(value).rlike(r"^\d"), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def heading_key(value: Column | str) -> Column:
    """Case-folded heading with straight quotes."""
    folded = F.lower(squash(value))
    return F.regexp_replace(F.regexp_replace(folded, "[‘’]", "'"), "[“”]", '"')


def file_stem(path: Column | str) -> Column:
    name = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def any_rlike(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    return text.rlike(flags + "|".join(patterns))


def any_contains(text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(text, F.lit(prefix))
    return hit


def first_reason(tests: list[tuple[Column, str]], otherwise: Column | str | None = None) -> Column:
    """Name of the first test that holds; the order of the list is the meaning."""
    expr = None
    for condition, reason in tests:
        condition = F.coalesce(condition, F.lit(False))
        expr = F.when(condition, F.lit(reason)) if expr is None else expr.when(condition, F.lit(reason))
    if otherwise is None:
        return expr
    return expr.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def int_or_null(value: Column | str) -> Column:
    """Whole number from an int-like string, else null (ANSI-safe)."""
    return _col(value).cast("string").try_cast("int")


def pinned(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters and expressions read them instead of repeating them.

    The optimiser copies a projected expression into each filter above it; it does not
    copy through a generator, so one row per row is exploded.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(packed)).alias("__pin")).select(*keep, *[F.col(f"__pin.{n}").alias(n) for n in columns])
