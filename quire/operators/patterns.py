"""Many patterns in many texts: substring search by a word index.

A text that contains a pattern holds the pattern's inner words as words of its own, so the
rarest of them leads to the few texts in which ``contains`` is tried. A pattern of two words
ends some word of the text with its first one, and one of a single word lies inside a
word: both look their word up among the distinct words of the texts, by equal pieces of the
lengths that occur among the patterns. No pattern meets a text that lacks its word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import written


def _words(norm: str) -> Column:
    return F.split(norm, " ")


def _lengths(pieces: DataFrame) -> Column:
    """Distinct lengths of the pieces: no more than the longest piece has characters."""
    found = sorted(r[0] for r in pieces.select(F.length("piece")).distinct().collect())
    return F.array(*[F.lit(n) for n in found]).cast("array<int>")


def pattern_words(patterns: DataFrame, words: DataFrame, scope: list[str]) -> DataFrame:
    """(pattern_id, *scope, word): the words of the texts in which a pattern must be looked for.

    patterns: (pattern_id, norm, *scope), not blank; words: (*scope, word, frequency), distinct words of the texts.
    """
    parts = patterns.select("pattern_id", *scope, _words("norm").alias("__w"))
    inner = parts.filter(F.size("__w") >= 3).select("pattern_id", *scope, F.explode(F.array_distinct(F.slice("__w", F.lit(2), F.size("__w") - 2))).alias("word"))
    known = inner.join(words, [*scope, "word"], "left").withColumn("__f", F.coalesce("frequency", F.lit(0)))
    rarest = known.groupBy("pattern_id", *scope).agg(F.min_by("word", F.struct("__f", "word")).alias("word"), F.min("__f").alias("__f"))
    exact = rarest.filter("__f > 0").select("pattern_id", *scope, "word")

    names = words.select("word").distinct()
    first = parts.filter(F.size("__w") == 2).select("pattern_id", *scope, F.col("__w")[0].alias("piece"))
    fitting = lambda lengths: F.filter(lengths, lambda n: n <= F.length("word"))
    ends = names.select("word", F.explode(F.transform(fitting(_lengths(first)), lambda n: F.when(n > 0, F.substring(F.col("word"), F.length("word") - n + 1, n)).otherwise(""))).alias("piece"))
    only = parts.filter(F.size("__w") == 1).select("pattern_id", *scope, F.col("__w")[0].alias("piece"))
    places = F.flatten(F.transform(fitting(_lengths(only)), lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, n))))
    within = names.select("word", F.explode(F.array_distinct(places)).alias("piece"))
    short = [own.join(found, "piece").select("pattern_id", *scope, "word") for own, found in ((first, ends), (only, within))]
    return exact.unionByName(short[0]).unionByName(short[1])


def find_patterns(patterns: DataFrame, texts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(pattern_id, text_id, *scope) for every text that contains a pattern as a substring; exact.

    patterns: (pattern_id, norm, *scope), texts: (text_id, norm, *scope), both in one normal form, ids unique (a
    pattern's within its scope too). Null or empty patterns and null texts meet nothing; a pattern meets texts of its own scope only.
    A word that many texts hold is a skewed join key, which adaptive execution splits.
    """
    scope = scope or []
    # seven uses, two of them jobs of their own: without the write each would work out the patterns anew
    asked = written(patterns.filter(F.length("norm") > 0).select("pattern_id", "norm", *scope), "patterns")
    held = texts.filter(F.col("norm").isNotNull()).select("text_id", "norm", *scope)
    postings = held.select("text_id", *scope, F.explode(F.array_distinct(_words("norm"))).alias("word"))
    frequency = written(postings.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("frequency")), "words")  # three uses
    # written, so that their sizes are known when the joins are planned: few words or pairs are broadcast and no text moves
    led = written(pattern_words(asked, frequency, scope), "led")
    met = written(postings.join(led, [*scope, "word"]).select("pattern_id", "text_id", *scope).distinct(), "met")
    both = met.join(held.withColumnRenamed("norm", "__t"), ["text_id", *scope]).join(asked.withColumnRenamed("norm", "__p"), ["pattern_id", *scope])
    return both.filter(F.contains("__t", F.col("__p"))).select("pattern_id", "text_id", *scope)
