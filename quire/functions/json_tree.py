"""Leaves of JSON documents of any shape and depth.

A document is parsed once into a variant. One generator a level opens the containers and
passes scalars on, so the whole walk is a chain of narrow steps in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
STIMULUS_FIELDS = ["input", "mistake", "misconception"]
NOT_PROSE = ["model_answer", "example", "formula", "input", "item", "source_label", "schema_version", "task_type", "tags"]
# ---------------------------------------------------------------------------

_HEX = [f"{c:04X}" for c in (*range(0x0B, 0x10), *range(0x1A, 0x20)) if not f"{c:04X}".isdigit()]
_PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def nesting(json: Column | str) -> Column:
    """Deepest level of brackets outside strings: 0 for a scalar, null for null."""
    column = F.col(json) if isinstance(json, str) else json
    bare = F.regexp_replace(F.regexp_replace(column, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]++", "")
    brackets = F.filter(F.split(bare, ""), lambda c: c != "")
    state = lambda now, most: F.struct(now.alias("now"), most.alias("most"))
    step = lambda s, c: F.when(c.isin("[", "{"), state(s["now"] + 1, F.greatest(s["most"], s["now"] + 1))).otherwise(state(s["now"] - 1, s["most"]))
    return F.aggregate(brackets, state(F.lit(0), F.lit(0)), step, lambda s: s["most"])


def leaves(documents: DataFrame, keep: list[str], json: str = "json") -> DataFrame:
    """One row for each scalar of each document: the ``keep`` columns, ``json_path``, ``keys``, ``key``, ``kind``, ``value``.

    ``json_path`` starts with ``$``; a key that is no plain name stands in double quotes. ``keys``
    are the object keys from the root on, ``key`` the last of them (a list passes its own key to
    its elements). ``kind`` is the scalar's type (``STRING``, ``BIGINT``, ``BOOLEAN``, ``VOID`` for null ...),
    ``value`` its text, null for null. ``place`` orders a document's leaves: keys by name,
    elements by position. Empty containers have no leaves; a document that does not parse, repeats a key in an object, or is null, has
    none either (``unreadable`` lists them). One pass finds the deepest nesting, one walks.
    """
    taken = {"json_path", "keys", "key", "kind", "value", "place", "__v", "__pos", "__key", "__value"}
    if clash := sorted(set(keep) & taken):
        raise ValueError(f"columns named like results: {clash}")
    spark = documents.sparkSession
    levels = documents.agg(F.max(nesting(json))).first()[0] or 0
    rows = documents.select(
        *keep, F.try_parse_json(json).alias("__v"), F.lit("$").alias("json_path"), F.array().cast("array<string>").alias("keys"), F.lit("").alias("place")
    )
    for _ in range(levels):
        opened = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col("__v").outer()).toDF("__pos", "__key", "__value"))
        inside, named = F.col("__pos").isNotNull(), F.col("__key").isNotNull()
        quoted = F.when(F.col("__key").rlike(_PLAIN_KEY), F.col("__key")).otherwise(F.concat(F.lit('"'), F.replace("__key", F.lit('"'), F.lit('\\"')), F.lit('"')))
        step = F.when(named, F.concat(F.lit("."), quoted)).when(inside, F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]"))).otherwise("")
        order = F.when(inside, F.concat(F.lit("/"), F.lpad(F.col("__pos").cast("string"), 10, "0"))).otherwise("")
        rows = opened.select(
            *keep, F.when(inside, F.col("__value")).otherwise(F.col("__v")).alias("__v"), F.concat("json_path", step).alias("json_path"),
            F.when(named, F.array_append("keys", F.col("__key"))).otherwise(F.col("keys")).alias("keys"), F.concat("place", order).alias("place"),
        )
    kind = F.schema_of_variant("__v")
    scalar = F.col("__v").isNotNull() & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
    return rows.filter(scalar).select(
        *keep, "json_path", "keys", F.try_element_at("keys", F.lit(-1)).alias("key"), kind.alias("kind"), F.variant_get("__v", "$", "string").alias("value"), "place"
    )


def unreadable(documents: DataFrame, keep: list[str], json: str = "json") -> DataFrame:
    """The ``keep`` columns of documents that are null or no JSON."""
    return documents.filter(F.try_parse_json(json).isNull()).select(*keep)


def strings(leaves: DataFrame) -> DataFrame:
    return leaves.filter("kind = 'STRING'")


def asserted(leaves: DataFrame, stimulus: list[str] = STIMULUS_FIELDS) -> DataFrame:
    """Strings that a document states as true: none below a field that quotes a problem or a wrong belief (Q9)."""
    return strings(leaves).filter(~F.arrays_overlap("keys", F.array(*[F.lit(s) for s in stimulus])))


def prose(leaves: DataFrame, keep: list[str], other: list[str] = NOT_PROSE) -> DataFrame:
    """The text that a document gives to read: its strings under prose fields, joined by blanks in the order of ``place`` (Q1)."""
    read = strings(leaves).filter(~F.coalesce(F.col("key").isin(other), F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("place", "value")))  # one document's own strings
    return read.groupBy(*keep).agg(F.array_join(F.transform(parts, lambda p: p["value"]), " ").alias("text"))


def _low_escapes(json: Column) -> Column:
    """Control characters as Python writes them: Spark's escapes have capital digits."""
    low = json
    for code in _HEX:
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), low).otherwise(json)


def canonical(json: Column | str, without: list[str] | None = None) -> Column:
    """One text for all ways to write a JSON document (K10, G22): no white space, keys of every object in order, lists as they are.

    Strings escape quotes, backslashes and control characters only. Whole numbers are digits,
    others shortest decimals; a fraction of zeros alone (1.0) counts as whole. ``without`` names keys of the outermost
    object that are left out. Null where the document does not parse.
    """
    column = F.col(json) if isinstance(json, str) else json
    if not without:
        return _low_escapes(F.to_json(F.try_parse_json(column)))
    fields = F.from_json(column, "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(without))
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    parts = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(name(k), F.lit(":"), F.to_json(F.element_at(kept, k))))
    return F.when(F.try_parse_json(column).isNotNull(), _low_escapes(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))))


def canonical_digest(json: Column | str, without: list[str] | None = None) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(json, without), 256)
