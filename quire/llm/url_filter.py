"""Operator 3: URL rules, then a blocked Bloom filter with an exact join behind it.

Listed canonical URLs set bits in blocks of four 64-bit words; a URL asks one block only.
The filter has a fixed number of blocks, so its broadcast is bounded whatever the list's
length; a longer list lets more URLs through to the exact join, which decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter: 32,768 rows of 256 bits, about 2 MB as a broadcast table.
BLOCKS = 1 << 15
WORDS = 4
#: host, path, verdict; a rule fits its host and all subdomains where the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without trailing slashes; scheme, query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (host and path as one string) and verdict of the longest rule that fits; null where none does. ``rules`` is a short fixed list."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(BLOCKS)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each word of the block."""
    h = F.xxhash64(F.lit(2), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str) -> DataFrame:
    """The filter of a column: BLOCKS rows at most (``__block``, ``__w0`` ...)."""
    bits = listed.select(_block(F.col(key)).alias("__block"), *[m.alias(f"__w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return bits.groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)])


def possible_hits(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Adds ``__possible``: false only where the key is surely not listed."""
    asked = rows.withColumn("__block", _block(F.col(key)))
    joined = asked.join(F.broadcast(blocks), "__block", "left")  # BLOCKS rows at most
    all_set = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col(key)))])
    return joined.withColumn("__possible", F.coalesce(all_set, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, keys: list[str], url: str = "url", rules=RULES) -> DataFrame:
    """Verdict of every URL: the longest rule's, else ``block`` for a listed canonical URL and ``allow`` for the rest.

    ``listed`` has a column ``url``; null URLs in it and URLs without host and path list
    nothing. Returns the key columns, ``host``, ``path``, ``rule``, ``verdict`` and
    ``possible`` (passed the filter), one row for each row of ``pages``. A null URL or one
    without ``://`` has empty host and path, fits no rule and is allowed. Repeated rows give
    repeated rows; empty tables work on either side. Other columns are not read; key columns
    named like the results are refused. Only possible hits reach the exact join; one
    frequent URL is a skewed join key, which adaptive execution splits.
    """
    clash = sorted(set(keys) & {"host", "path", "rule", "verdict", "possible", "__canonical", "__possible"})
    if clash:
        raise ValueError(f"key columns named like results: {clash}")
    list_url = F.col("url")
    names = listed.select(canonical(host(list_url), path(list_url)).alias("__canonical")).filter("__canonical <> ''").distinct()
    parted = pages.select(*keys, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    asked = parted.select(*keys, "host", "path", rule.alias("rule"), verdict.alias("__ruled"), canonical(F.col("host"), F.col("path")).alias("__canonical"))
    tried = possible_hits(asked, "__canonical", bloom_blocks(names, "__canonical"))
    # a key that the filter rules out joins as null and meets nothing
    exact = tried.withColumn("__asked", F.when(F.col("__possible"), F.col("__canonical")))
    listed_names = names.select(F.col("__canonical").alias("__asked"), F.lit(True).alias("__hit"))
    passed, other = exact.filter("__possible"), exact.filter("NOT __possible").withColumn("__hit", F.lit(None).cast("boolean"))
    joined = passed.join(listed_names, "__asked", "left").select(*other.columns).unionByName(other)
    return joined.select(
        *keys, "host", "path", "rule",
        F.coalesce("__ruled", F.when(F.col("__hit"), "block").otherwise("allow")).alias("verdict"),
        F.col("__possible").alias("possible"),
    )
