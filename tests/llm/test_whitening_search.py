"""Whitening, the Jaccard join and lexical search, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard_join, lexical_search, near_duplicates, whitening
from quire.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ARRAY = "vec_id long, embedding array<double>"


def grid(vectors) -> np.ndarray:
    return np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], np.int64)


def check_whitening(rows, vectors: dict, most: int = 32) -> None:
    """Rows of the operator against the eigenvectors of the covariance, which are unique up to their sign."""
    keys = sorted(vectors)
    x = grid(vectors[k] for k in keys)
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    held = min(most, int((e > 1e-9 * e[0]).sum()))
    got = {r.vec_id: r for r in rows}
    assert sorted(got) == keys
    w = np.array([got[k].whitened for k in keys])
    assert w.shape == (n, held)
    want = c @ u[:, :held] / np.sqrt(e[:held])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-6
    for k, row in zip(keys, x, strict=True):
        assert got[k].n == n and int(got[k].deviation) == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))
        assert np.allclose(got[k].explained, e[:held] / e.sum(), rtol=1e-9)
        assert got[k].identity_error < 1e-6


def test_whitening_query(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.vec_id, r.component)):
        by[r.vec_id].append(r)
    assert all([r.component for r in own] == list(range(1, 33)) for own in by.values()) and all(type(r.deviation) is int for r in rows)

    class Row:
        def __init__(self, own):
            self.vec_id, self.n, self.deviation, self.identity_error = own[0].vec_id, own[0].n, own[0].deviation, own[0].identity_error
            self.whitened, self.explained = [r.whitened for r in own], [r.explained for r in own]

    check_whitening([Row(own) for own in by.values()], vectors)


def test_whitening_with_constant_and_dependent_dimensions(spark):
    """A constant dimension and one that is the sum of two others: fewer components than dimensions."""
    rng = np.random.default_rng(3)
    vectors = {}
    for i in range(300):
        a, b, c, d = (float(v) for v in rng.integers(-40, 40, 4))
        vectors[i] = [a, 5.0, b * 2, a + b * 2, c / 8, d * 30]
    df = spark.createDataFrame(list(vectors.items()), ARRAY).withColumn("n", F.lit("other"))
    check_whitening(whitening.whiten(df.repartition(4), "vec_id").collect(), vectors)
    check_whitening(whitening.whiten(df, "vec_id", components=2).collect(), vectors, 2)


def test_bidiagonalisation_with_repeated_values():
    """Equal singular values need fresh directions: each start sees one direction of their space."""
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((40, 6)))
    p, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((6, 6)))
    x = q @ np.diag([4, 4, 4, 2, 2, 0]) @ p.T
    values, directions = whitening.bidiagonalise(lambda v: x.T @ (x @ v), 6, 6)
    assert np.allclose(values[:5], [4, 4, 4, 2, 2]) and (len(values) == 5 or values[5] < 1e-6)
    assert np.allclose(directions.T @ directions, np.eye(directions.shape[1]))
    assert np.allclose(np.linalg.norm(x @ directions, axis=0), values, atol=1e-6)


def test_bidiagonalisation_of_many_dimensions_stops_early():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 150)) * 0.7 ** np.arange(150)
    calls = []
    values, directions = whitening.bidiagonalise(lambda v: calls.append(1) or x.T @ (x @ v), 150, 4)
    want = np.linalg.svd(x)
    assert np.allclose(values, want[1][:4], rtol=1e-12) and len(calls) < 40
    assert np.allclose(np.abs((directions * want[2][:4].T).sum(0)), 1)


def test_whitening_of_messy_rows(spark):
    rng = np.random.default_rng(2)
    good = {i: [float(v) for v in rng.standard_normal(3)] for i in range(50)}
    bad = [(100, None), (101, [1.0, None, 0.0]), (102, [float("nan")] * 3), (103, [float("inf"), 0.0, 0.0]), (104, [1.0]), (105, []), (106, [-float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame([*good.items(), *bad], ARRAY).withColumn("components", F.lit(1))
    check_whitening(whitening.whiten(df, "vec_id").collect(), good)
    repeated = whitening.whiten(df.unionByName(df.filter("vec_id < 5")).unionByName(df.filter("vec_id = 7").withColumn("vec_id", F.lit(None).cast("long"))), "vec_id").collect()
    assert len(repeated) == 56 and {r.n for r in repeated} == {56} and sum(r.vec_id is None for r in repeated) == 1
    for none in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id >= 100 AND vec_id <> 104"), spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], ARRAY)):
        assert whitening.whiten(none, "vec_id").count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(df.withColumnRenamed("vec_id", "n"), "n")


def test_deviation_beyond_64_bits():
    x = np.array([[10**9, -5], [-(10**9), 7]], np.int64)
    n, sums = 10**6, (123456789012345, 3)
    assert whitening.deviation(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    small = np.array([[3, 4], [5, 6]], np.int64)
    assert whitening.deviation(small, 2, (8, 10)) == [4 + 4, 4 + 4]


# Jaccard join


def shingles(text) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts: dict, percent: int) -> dict:
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def edited_texts(families: list[tuple[int, int]], most: int, seed: int = 4) -> dict:
    """Families (words, copies): copies of a text with up to ``most`` edited words, so that many pairs are near the limit."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for length, copies in families:
        body = [rng.choice(words) for _ in range(length)]
        for _ in range(copies):
            copy = body[:]
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(length)] = rng.choice(words)
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize(("families", "most", "frequent"), [([(6, 12), (40, 30), (150, 10), (150, 60), (300, 5)], 5, 16), ([(120, 40), (60, 25), (9, 30)], 4, 2), ([(200, 8)] * 6, 9, 16), ([(80, 25)] * 3, 3, 1000)])
def test_jaccard_classes_by_brute_force(spark, monkeypatch, families, most, frequent):
    """Small families that pair directly, large ones whose shingles are all frequent, and everything paired."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    texts = edited_texts(families, most) | {900: None, 901: "", 902: " \t", 903: "short one", 904: "SHORT  one", 905: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit(1))
    rows = jaccard_join.jaccard_classes(df, "doc_id", frequent=frequent).collect()
    assert len(rows) == len(texts) and {r.doc_id: r.component_id for r in rows} == brute_classes(texts, 80)
    assert {r.doc_id: r.n_shingles for r in rows} == {k: len(shingles(t)) for k, t in texts.items()}


def test_prefixes_share_what_is_needed():
    """For random pairs at and above the limit: prefixes of any levels share the stated number, and a set that steps over frequent shingles meets its partner elsewhere."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        union = rng.permutation(400)[: int(rng.integers(n, int(n / 0.8) + 1))]
        common = union[: math.ceil(0.8 * len(union))]
        cut = int(rng.integers(0, len(union) - len(common) + 1))
        a, b = (np.sort(np.r_[common, rest]) for rest in (union[len(common) :][:cut], union[len(common) :][cut:]))
        la, lb = (int(rng.integers(1, jaccard_join.levels(len(s)) + 1)) for s in (a, b))
        pa, pb = (set(s[: len(s) - jaccard_join.overlap(len(s)) + level].tolist()) for s, level in ((a, la), (b, lb)))
        need = int(jaccard_join.needed(len(a), la, len(b), lb))
        assert need >= 1 and len(pa & pb) >= need
        frequent = {int(t) for t in rng.permutation(400)[: int(rng.integers(0, 60))]}
        found = []
        for s in (a, b):
            held = np.array([100 if int(t) in frequent else 3 for t in s])
            level, hot = jaccard_join.best_level(len(s), np.arange(len(s)), held)
            prefix = s[: len(s) - jaccard_join.overlap(len(s)) + level].tolist()
            assert hot == len(frequent & set(prefix))
            found.append((set(prefix), level, hot))
        if any(level > hot for _, level, hot in found):
            assert (found[0][0] & found[1][0]) - frequent


def test_costly_prefixes_are_lengthened():
    place = np.arange(100)
    assert jaccard_join.best_level(100, place, np.full(100, 1))[0] == 1
    assert jaccard_join.best_level(100, place, np.full(100, 12))[0] > 1
    level, hot = jaccard_join.best_level(100, place, np.r_[np.full(3, 99), np.full(97, 2)])
    assert level > hot == 3


def test_templates_do_not_pair(spark, monkeypatch):
    """Texts that share a third of their words with 400 others: no pair of them becomes a candidate."""
    rng = random.Random(1)
    body = [f"t{i}" for i in range(60)]
    texts = [" ".join([f"x{rng.random()}" for _ in range(70)] + body + [f"y{rng.random()}" for _ in range(50)]) for _ in range(400)]
    seen = []
    for name in ("candidates", "pivots"):
        made = getattr(jaccard_join, name)
        monkeypatch.setattr(jaccard_join, name, lambda *a, made=made, name=name: seen.append((name, made(*a).count())) or made(*a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in jaccard_join.jaccard_classes(df, "doc_id").collect())
    assert seen == [("candidates", 0), ("candidates", 0), ("pivots", 0)]


def test_jaccard_of_messy_rows(spark, messy):
    rows = jaccard_join.jaccard_classes(messy, "doc_id").collect()
    assert len(rows) == 12 and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0, 1, 2} and sum(r.doc_id is None and r.component_id is None for r in rows) == 1
    assert jaccard_join.jaccard_classes(messy.limit(0), "doc_id").count() == 0


def test_exact_limits_of_very_long_texts():
    """Sets of more than 2^24 / 100 shared hashes: the counts stay integers."""
    rng = np.random.default_rng(2)
    for union in (250_000, 250_003, 400_019):
        values = np.unique(rng.integers(0, 2**63, union, np.uint64))
        common = math.ceil(85 * len(values) / 100)
        left, right = np.sort(values[: common + 5]), np.sort(np.r_[values[:common], values[common + 5 :]])
        counts = near_duplicates.common_counts([left, left[:9], left[:2]], [right, right[:7]])
        assert counts.dtype == np.int64 and counts[0, 0] == common


# Lexical search


def plain_terms(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(documents: list[tuple], items: list[tuple], k: int = 50) -> dict:
    found = [(key, Counter(plain_terms(t))) for key, t in documents]
    count, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    holders = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(plain_terms(text))
    out = {}
    for item, terms in asked.items():
        scored = []
        for key, c in found:
            score = 0
            m = 50 + 50 * sum(c.values()) * count // max(total, 1)
            for t in terms & c.keys():
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * holders[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                scored.append((-score, key is None, key or 0))
        out[item] = [(None if none else key, -score) for score, none, key in sorted(scored)[:k]]
    return {i: r for i, r in out.items() if r}


def ranking(df) -> dict:
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    assert all([r[0] for r in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {i: [r[1:] for r in rows] for i, rows in out.items()}


def test_terms_equal_the_pattern():
    rng = random.Random(2)
    pool = [chr(i) for i in range(0x300)] + [" ", "中", "😀", "́", "İ", "K"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(60))
        assert [t.decode() for t in lexical_search.terms(text)] == plain_terms(text)


@pytest.mark.parametrize(("rows", "scored", "block"), [(4096, 256, 8 << 20), (37, 3, 200)])
def test_search_by_brute_force(spark, monkeypatch, rows, scored, block):
    """Many ties, frequent and rare words, long and short documents, an item of more than 64 terms; small slices and item blocks too."""
    for name, value in (("SLICE_DOCUMENTS", rows), ("SCORED_TOGETHER", scored), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(9)
    words = [f"W{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    documents = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 400])))) for i in range(700)]
    documents += [(700 + i, documents[3][1]) for i in range(80)] + [(900, None), (901, ""), (902, "!?"), (None, documents[3][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 200])))) for i in range(12)] + [(20, documents[3][1]), (21, None), (22, "absent"), (1, "w1 w2")]
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumn("item_id", F.lit(5)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = ranking(lexical_search.rank_documents(df, asked))
    assert got == brute_ranking(documents, items)


def test_masks_finish_early():
    """One rare word decides: documents that hold only the common one are not scored once k others are."""
    n = 3000
    ids = [[0, 1] if i % 50 == 0 else [0] for i in range(n)]
    flat = np.array([t for d in ids for t in d])
    held = lexical_search.Slice.of(list(range(n)), np.full(n, 100), np.array([len(d) for d in ids]), flat, np.ones(len(flat)), 2)
    best = lexical_search.Best(50, [])
    assert held.search(np.array([0, 1]), np.array([3, 4000]), best) == n // 50
    assert [k for _, k in best.rows] == list(range(0, 2500, 50))


def test_length_norm_beyond_64_bits():
    n, count, total = np.array([10**9, 5]), 10**12, 10**14
    assert lexical_search.length_norm(n, count, total).tolist() == [50 + 50 * int(x) * count // total for x in n]


def test_search_of_messy_rows(spark, messy):
    items = spark.createDataFrame([(1, "same text for YOU one"), (2, None), (3, ""), (None, "köln grüße 日本語"), (1, "two")], "item_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    documents = [(r.doc_id, r.text) for r in messy.collect()]
    assert ranking(lexical_search.rank_documents(messy, items)) == brute_ranking(documents, [(r.item_id, r.text) for r in items.collect()])
    assert lexical_search.rank_documents(messy.limit(0), items).count() == 0
    assert lexical_search.rank_documents(messy, items.limit(0)).count() == 0
    assert lexical_search.rank_documents(messy.filter("text IS NULL"), items).count() == 0
    with pytest.raises(ValueError):
        lexical_search.rank_documents(messy.withColumnRenamed("doc_id", "key"), items, key="n")
