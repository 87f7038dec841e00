"""Operator 2: quality rules and a hashed n-gram log-likelihood ratio.

Byte n-grams of whole texts are hashed into a fixed number of buckets. Two multinomials
are counted over them: one from trusted documents, one from the whole raw corpus. A
document's score is the mean over its n-grams of log p_trusted - log p_raw; every document
is kept or dropped by one fixed threshold, never by chance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keyed_texts, map_texts, slices

NGRAM = 3
BUCKETS = 1 << 14
#: Score below which a document is dropped; a clean text scores near or above 0.
THRESHOLD = -0.3
#: Trusted ids up to which they are broadcast (about 32 MB); more of them meet the documents in a shuffle join.
BROADCAST_IDS = 2_000_000
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"


def gram_buckets(text: bytes) -> np.ndarray:
    """Bucket of every byte n-gram; a shorter text is one n-gram, an empty one none."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if not len(b):
        return b
    n = min(NGRAM, len(b))
    code = np.zeros(len(b) - n + 1, np.uint32)
    for i in range(n):
        code = code << np.uint32(8) | b[i : len(b) - n + 1 + i]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS - 1).bit_length())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()  # bytes split at exactly the six ASCII white-space characters
    chars = len(text) - sum(map(text.count, _SPACE))
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            repeated += 1
        elif line.strip(_SPACE):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    covered = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered += i + 5 - max(i, end)
                end = i + 5
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, covered


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled good."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def fit_ratio(documents: DataFrame, trusted: DataFrame, text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """Log ratio of each bucket. Both counts cover all their documents; a task sends one row a bucket at most."""
    flags = trusted.select("doc_id", F.lit(True).alias("__trusted"))
    flags = F.broadcast(flags) if flags.count() <= broadcast_ids else flags.hint("shuffle_merge")
    joined = documents.select("doc_id", F.col(text)).join(flags, "doc_id", "left")
    source = keyed_texts(joined.select(F.coalesce("__trusted", F.lit(False)).alias("trusted"), text), ["trusted"], text, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            flags, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for good in (False, True):
                    grams = [gram_buckets(t.encode()) for t, f in zip(texts[a:b], flags[a:b], strict=True) if f is good]
                    if grams:
                        counts[int(good)] += np.bincount(np.concatenate(grams), minlength=BUCKETS)
        held = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[1][held]), pa.array(counts[0][held] + counts[1][held])], names=["bucket", "good", "raw"])

    sums = source.mapInArrow(run, "bucket long, good long, raw long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"))
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.toLocalIterator():  # BUCKETS rows at most
        good[row.bucket], raw[row.bucket] = row.good, row.raw
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))
    return share(good) - share(raw) if good.any() else np.zeros(BUCKETS)


def apply_rules(documents: DataFrame, ratio: np.ndarray, keys: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base verdict, score and final verdict of every whole text.

    Returns the key columns, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``base_failed``, ``score`` (double) and ``kept``. A null or
    empty text has no words, fails the base rules and scores 0. A score equal to the
    threshold keeps. Repeated rows give repeated rows with equal results, an empty table an
    empty one. Other columns are not read; key columns named like the results are refused.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(texts: list[str]) -> list:
        counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
        score = np.array([ratio[g].mean() if len(g) else 0.0 for g in (gram_buckets(t.encode()) for t in texts)])
        failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
        return [*counts.T, failed, score, ~failed & (score >= threshold)]

    return map_texts(documents, keys, text, {n: "long" for n in names} | {"base_failed": "boolean", "score": "double", "kept": "boolean"}, lambda: work)
