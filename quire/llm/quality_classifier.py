"""Operator 8: quality by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is
compressed piece by piece under each; a text like the good ones becomes smaller under the
good dictionary. The difference of the sizes over their sum, and how well the text
compresses at all, are calibrated by a logistic curve on other labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, smallest_hashes

#: Labelled rows of each class at most: for the dictionaries, and as many others for the calibration.
SAMPLE_ROWS = 1_500
#: From a sampled row the dictionaries take this many characters at a hashed place.
SAMPLE_CHARS = 2_048
DICTIONARY_BYTES = 112_640
#: Whole texts are compressed in pieces of this many bytes, so that the dictionary counts in all of them.
PIECE = 1_024
LEVEL = 3


@dataclass(frozen=True)
class Compressor:
    """``good`` and ``bad``: dictionary contents; ``weights``: of 1 and the features; ``prior``: share of good labels."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = ()
    prior: float = 0.5


def build_dictionary(samples: list[bytes], budget: int = DICTIONARY_BYTES) -> bytes:
    """The start of every sample: equal shares of the budget, and what shorter samples leave goes to the longer ones."""
    taken = [0] * len(samples)
    for k, i in enumerate(sorted(range(len(samples)), key=lambda i: len(samples[i]))):
        taken[i] = min(len(samples[i]), budget // (len(samples) - k))
        budget -= taken[i]
    return b"".join(s[:n] for s, n in zip(samples, taken))


class Sizer:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, model: Compressor):
        self.coders = []
        for content in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: difference of the two sizes over their sum, and the smaller size over the text's; 0 and 1 for an empty text."""
        out = np.tile([0.0, 1.0], (len(texts), 1))
        for i, text in enumerate(texts):
            data = text.encode()
            if data:
                good, bad = (sum(len(c.compress(data[k : k + PIECE])) for k in range(0, len(data), PIECE)) for c in self.coders)
                out[i] = (bad - good) / (bad + good), min(good, bad) / len(data)
        return out


def curve(features: np.ndarray) -> np.ndarray:
    """Inputs of the logistic curve: 1, the difference, the ratio, and the logarithm of the ratio (very repetitive texts)."""
    return np.c_[np.ones(len(features)), 10 * features[:, 0], features[:, 1], np.log(features[:, 1])]


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a small ridge; the classes weigh as often as they occur among all labels."""
    w = np.zeros(x.shape[1])
    balance = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (balance * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_quality(documents: DataFrame, labels: DataFrame, key: str, text: str = "text", rows: int = SAMPLE_ROWS) -> Compressor:
    """Learn from ``labels`` (key, quality 0 or 1); rows with a null in either teach nothing, a row labelled both ways counts as bad.

    A bounded sample: 2 * ``rows`` labelled texts of each class by smallest seeded hash, half
    for the dictionaries, which hold a share of every one, and half for the curve, whose texts are scored whole. Without
    texts of both classes every score is the share of good labels, or 0.5 without labels.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(key).alias("__id")).agg(F.min("quality").alias("quality"))
    # only labels whose document is there; the keys alone are joined here
    present = marks.join(documents.select(F.col(key).alias("__id")), "__id", "left_semi")
    drawn = smallest_hashes(present, "quality", ["__id"], 2 * rows)
    place = F.lit(1) + F.floor(F.pmod(F.xxhash64(F.lit("piece"), "__id"), F.lit(1 << 20)) / float(1 << 20) * F.greatest(F.lit(1), F.length("__text") - SAMPLE_CHARS)).cast("int")
    texts = documents.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__id")  # 4 * rows ids at most
    first = F.col("__rank") % 2 == 1
    pieces = texts.filter(first).select("quality", "__id", "__rank", F.substring("__text", place, F.lit(SAMPLE_CHARS)).alias("piece")).dropDuplicates(["__id"]).toPandas()  # bounded rows and lengths
    pieces = pieces.sort_values("__rank", ignore_index=True)
    good, bad = ([p.encode() for p in pieces["piece"][pieces["quality"] == q]] for q in (1, 0))
    counts = {r.quality: r["count"] for r in marks.groupBy("quality").count().toLocalIterator()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if not good or not bad:
        return Compressor(b"", b"", (), prior)
    budget = min(DICTIONARY_BYTES, sum(map(len, good)), sum(map(len, bad)))  # as much text from either class
    model = Compressor(build_dictionary(good, budget), build_dictionary(bad, budget))
    others = raw_features(texts.filter(~first), model, ["quality", "__id"], "__text").dropDuplicates(["__id"]).toPandas().sort_values("__id")  # numbers of 2 * rows texts at most
    y = others["quality"].to_numpy()
    if len(set(y)) < 2:
        return Compressor(b"", b"", (), prior)
    weights = logistic(curve(others[["difference", "ratio"]].to_numpy()), y, prior)
    return Compressor(model.good, model.bad, tuple(weights), prior)


def raw_features(df: DataFrame, model: Compressor, keys: list[str], text: str) -> DataFrame:
    """``difference`` and ``ratio`` of every whole text."""

    def make():
        sizer = Sizer(model)
        return lambda texts: list(sizer.features(texts).T.copy())

    return map_texts(df, keys, text, {"difference": "double", "ratio": "double"}, make)


def score_quality(df: DataFrame, model: Compressor, keys: list[str], text: str = "text") -> DataFrame:
    """Score of every whole text, 0 to 1, and ``predicted`` (1 from 0.5 on).

    Returns the key columns, ``score`` and ``predicted``. A null, empty or blank text tells
    nothing and scores the share of good labels. Repeated rows give
    repeated rows with equal scores, an empty table an empty one. Other columns are not
    read; key columns named like the results are refused. No shuffle.
    """

    def make():
        sizer = Sizer(model) if model.weights else None

        def work(texts: list[str]) -> list:
            score = np.full(len(texts), model.prior)
            if sizer:
                linear = curve(sizer.features(texts)) @ np.array(model.weights)
                score = np.where([bool(t.strip()) for t in texts], 1 / (1 + np.exp(-np.clip(linear, -30, 30))), score)
            return [score, (score >= 0.5).astype(np.int32)]

        return work

    return map_texts(df, keys, text, {"score": "double", "predicted": "int"}, make)
