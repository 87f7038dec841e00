"""Operator 4: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. An n-gram binds
its letters: the product of their vectors, each rotated by its place. A text bundles
(adds) its n-grams; a language's prototype bundles its training texts, each at length 1.
A text goes to the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keyed_texts, map_texts, slices

DIMENSIONS = 1024
NGRAM = 3
#: Letters have 2**LETTER_BITS vectors: code points that agree in these bits share one.
LETTER_BITS = 10
#: Training texts of a language at most, on average, by seeded hash.
TRAIN_LIMIT = 2_000
UNKNOWN = "und"
#: Characters of a long text bundled at a time.
PART = 1_000_000
#: Labelled rows of a language and length class whose score may lie below the class's cutoff, at most.
CUTOFF_SHARE = 0.002
#: A class of as many labelled rows stands for itself.
CLASS_ROWS = 100
#: Chance that a text unlike all languages reaches the noise level.
NOISE_CHANCE = 0.01
#: Scores are counted in steps of 1 / SCORE_STEPS.
SCORE_STEPS = 1_000


def letter_vectors(seed: int = 11) -> np.ndarray:
    """One row of +1 and -1 for each letter code; code 0 is the gap between words."""
    return np.random.default_rng(seed).integers(0, 2, (1 << LETTER_BITS, DIMENSIONS), np.int8) * 2 - 1


def letter_codes(text: str) -> np.ndarray:
    """Codes of a text's lower-cased letters, one 0 for what stands between words, at both ends too; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, where = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in distinct], bool)
    code = np.where(letter, np.maximum(distinct % (1 << LETTER_BITS), 1), 0)[where]
    code = code[np.r_[True, (code[1:] > 0) | (code[:-1] > 0)]] if len(code) else code
    if not code.any():
        return np.zeros(0, np.int64)
    return np.concatenate([[0], code[int(code[0] == 0) :], [0][: int(code[-1] > 0)]]).astype(np.int64)


def gram_codes(text: str) -> np.ndarray:
    code = letter_codes(text)
    return code[:-2] << 2 * LETTER_BITS | code[1:-1] << LETTER_BITS | code[2:] if len(code) >= NGRAM else np.zeros(0, np.int64)


def bound(grams: np.ndarray, letters: np.ndarray, rotated: list[np.ndarray]) -> np.ndarray:
    """Vectors of n-grams: letters bound under rotation by place."""
    mask = (1 << LETTER_BITS) - 1
    return rotated[0][grams >> 2 * LETTER_BITS] * rotated[1][grams >> LETTER_BITS & mask] * letters[grams & mask]


class Bundler:
    def __init__(self):
        self.letters = letter_vectors()
        self.rotated = [np.roll(self.letters, 2, 1), np.roll(self.letters, 1, 1)]

    def profiles(self, texts: list[str]) -> np.ndarray:
        """A bundled vector for each text; zero for a text without letters. Long texts are bundled in parts whose n-grams overlap. ``sizes``: their numbers of n-grams."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        parts = [(i, gram_codes(t)) for i, t in enumerate(texts)]
        self.sizes = [len(g) for _, g in parts]
        chunks = [(i, g[k : k + PART]) for i, g in parts for k in range(0, len(g), PART)]
        start = 0
        while start < len(chunks):
            end, size = start, 0
            while end < len(chunks) and (end == start or size + len(chunks[end][1]) <= PART) and end - start < 256:
                size += len(chunks[end][1])
                end += 1
            group = chunks[start:end]
            grams, where = np.unique(np.concatenate([g for _, g in group]), return_inverse=True)
            row = np.repeat(np.arange(len(group)), [len(g) for _, g in group])
            for k in range(0, len(grams), 8192):  # vectors of so many n-grams are held at a time
                here = (where >= k) & (where < k + 8192)
                width = min(8192, len(grams) - k)
                counts = np.bincount(row[here] * width + where[here] - k, minlength=len(group) * width).reshape(len(group), width)
                made = counts.astype(np.float32) @ bound(grams[k : k + width], self.letters, self.rotated).astype(np.float32)
                np.add.at(out, [i for i, _ in group], made)
            start = end
        return out


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class Languages:
    """Prototypes of unit length, in the order of ``names``."""

    names: tuple[str, ...]
    prototypes: np.ndarray


def fit_languages(df: DataFrame, keys: list[str], label: str, text: str = "text", limit: int = TRAIN_LIMIT) -> Languages:
    """Bundle prototypes from labelled texts; rows without a label teach nothing.

    A language with more than ``limit`` texts gives those whose seeded hash falls under
    limit / texts: about that many, repeatable. Tasks send one vector a language. The model
    holds one vector a language.
    """
    labelled = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("lang"), *keys, F.col(text).alias("__t"))
    sizes = labelled.groupBy("lang").count().withColumnRenamed("lang", "__lang")
    draw = F.pmod(F.xxhash64(F.lit("language"), *keys), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(F.broadcast(sizes), F.col("lang") == F.col("__lang")).filter(draw < F.lit(limit) / F.col("count"))  # one row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                vectors = unit(bundler.profiles(texts[a:b]))
                for name in set(names[a:b]):
                    pick = [n == name for n in names[a:b]]
                    sums[name] = sums.get(name, 0) + vectors[pick].sum(0, dtype=np.float64)
        place = np.arange(DIMENSIONS)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(place, pa.int32()), pa.array(np.round(total * 1e6).astype(np.int64))], names=["lang", "place", "amount"])

    sums = keyed_texts(drawn, ["lang"], "__t", []).mapInArrow(run, "lang string, place int, amount long").groupBy("lang", "place").agg(F.sum("amount").alias("amount"))
    found: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():  # DIMENSIONS rows a language
        found.setdefault(row.lang, np.zeros(DIMENSIONS))[row.place] = row.amount
    names = tuple(sorted(found))
    return Languages(names, unit(np.array([found[n] for n in names]).reshape(-1, DIMENSIONS)).astype(np.float32))


def identify(df: DataFrame, model: Languages, keys: list[str], text: str = "text") -> DataFrame:
    """Language of every whole text: the key columns, ``lang_pred`` and ``score``.

    ``score`` is the cosine with the prototype, at least 0 and at most 1. A null text, one
    without letters, and every text under a model without languages are ``und`` with score 0.
    Ties go to the first name. Repeated rows give repeated rows, an empty table an empty one.
    Other columns are not read; key columns named like the results are refused. No shuffle.
    """
    return measured(df, model, keys, text).drop("__length")


def measured(df: DataFrame, model: Languages, keys: list[str], text: str = "text") -> DataFrame:
    """The columns of ``identify`` and ``__length``, the length class: binary digits of the number of n-grams."""

    def make():
        bundler = Bundler()

        def work(texts: list[str]) -> list:
            vectors = bundler.profiles(texts)
            length = [n.bit_length() for n in bundler.sizes]
            known = vectors.any(1) & bool(model.names)
            if not model.names:
                return [[UNKNOWN] * len(texts), np.zeros(len(texts)), length]
            cosine = unit(vectors) @ model.prototypes.T
            best = cosine.argmax(1)
            score = np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
            return [[model.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, length]

        return work

    return map_texts(df, keys, text, {"lang_pred": "string", "score": "double", "__length": "int"}, make)


def noise_level(languages: int) -> float:
    """Score that the largest of so many cosines with unrelated vectors reaches with NOISE_CHANCE."""
    return NormalDist().inv_cdf(1 - NOISE_CHANCE / max(1, languages)) / DIMENSIONS**0.5


def fit_cutoffs(df: DataFrame, model: Languages, label: str, text: str = "text") -> dict[str, list[float]]:
    """Least score of each language by length class, from all labelled rows that are taken for their own language.

    Short texts score lower, so each class has its own low quantile, and the noise level as
    its floor. A class of fewer than CLASS_ROWS rows tells little: its cutoff lies halfway
    between the noise level and the lower of its own quantile and that of the nearest larger
    class. A class without rows takes the cutoff of the next shorter one.
    Score counts reach the driver: SCORE_STEPS rows a language and class at most.
    """
    rows = measured(df.filter(F.col(label).isNotNull()).select(F.col(label).alias("__label"), text), model, ["__label"], text)
    step = F.floor(F.col("score") * SCORE_STEPS).cast("int").alias("step")
    counts = rows.filter(F.col("__label") == F.col("lang_pred")).groupBy("lang_pred", F.col("__length").alias("length"), step).count()
    held: dict[tuple[str, int], dict[int, int]] = {}
    for row in counts.toLocalIterator():
        held.setdefault((row.lang_pred, row.length), {})[row.step] = row["count"]
    return {name: cutoffs_of({k[1]: c for k, c in held.items() if k[0] == name}, noise_level(len(model.names))) for name in model.names}


def cutoffs_of(held: dict[int, dict[int, int]], floor: float) -> list[float]:
    """Cutoff of every length class of one language from its score counts."""
    lows = {}
    for length, found in held.items():
        below = np.cumsum([found[at] for at in sorted(found)])
        lows[length] = sorted(found)[int(np.argmax(below > CUTOFF_SHARE * below[-1]))] / SCORE_STEPS
    dense = [n for n, found in held.items() if sum(found.values()) >= CLASS_ROWS]
    out = [floor]
    for length in range(1, 33):
        low = lows.get(length)
        if low is not None and length not in dense:
            near = [lows[min(dense, key=lambda n: (abs(n - length), n))]] if dense else []
            low = (floor + min(low, *near)) / 2 if near else (floor + low) / 2
        out.append(out[-1] if low is None else max(floor, low))
    return out


def known_language(df: DataFrame, model: Languages, cutoffs: dict[str, list[float]], keys: list[str], text: str = "text") -> DataFrame:
    """Rows of ``identify`` whose score reaches the cutoff of their language and length class."""
    rows = measured(df, model, keys, text)
    least = F.coalesce(*[F.when(F.col("lang_pred") == n, F.element_at(F.array(*map(F.lit, c)), F.col("__length") + 1)) for n, c in cutoffs.items()], F.lit(2.0))
    return rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("__length")


def fold(key: str, parts: int) -> Column:
    """Fold of a row: crc32 of its key as text; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)), F.lit(0))
