"""Sharding, near-duplicates, vector search and the pipeline, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import near_duplicates, sharding, vector_search
from quire.llm.components import components
from quire.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def check_shards(rows, shards: int) -> None:
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min([sizes[s] for s in range(shards)]) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_hold_the_mixture(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    rows = sharding.stratified_shards(df, "source", ["id"], tile_rows=100).collect()
    check_shards(rows, 8)
    for source in {r.source for r in rows}:
        held = Counter(r.shard for r in rows if r.source == source)
        assert max(held.values()) - min(held[s] for s in range(8)) <= 2
    again = {r.id: (r.shard, r.slot) for r in sharding.stratified_shards(df.repartition(5), "source", ["id"], tile_rows=100).collect()}
    assert again == {r.id: (r.shard, r.slot) for r in rows}


def test_shard_order_by_brute_force(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(203)], "id long, source string")
    hashes = {r.id: (r.h % (1 << 64)) >> 1 for r in df.select("id", F.xxhash64(F.lit(7), "id").alias("h")).collect()}
    phases = spark.createDataFrame([("a",), ("b",)], "source string").select("source", F.xxhash64(F.lit(7), F.lit("phase"), "source").alias("h"))
    phase = {r.source: ((r.h % (1 << 64)) >> 11) / 2.0**53 for r in phases.collect()}
    order = []
    for s in ("a", "b"):
        own = sorted((hashes[i], i) for i in range(203) if ("a" if i % 4 else "b") == s)
        order += [((k + phase[s]) / len(own), s, k, i) for k, (_, i) in enumerate(own)]
    want = {i: p * 8 // 203 for p, (_, _, _, i) in enumerate(sorted(order))}
    assert {r.id: r.shard for r in sharding.stratified_shards(df, "source", ["id"], tile_rows=16).collect()} == want


def test_small_sources_reach_every_shard(spark):
    """Half of the rows in sources of one row: each shard gets its share of them, and no tile of the second ranking is much above the mean."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("source"))
    out = sharding.stratified_shards(df, "source", ["id"], tile_rows=500)
    small = [r["count"] for r in out.filter("source <> 'hot'").groupBy("shard").count().collect()]
    assert len(small) == 8 and min(small) > 2200 and max(small) < 2800
    hot = [r["count"] for r in out.filter("source = 'hot'").groupBy("shard").count().collect()]
    assert min(hot) > 2200 and max(hot) < 2800


def test_one_row_repeated_often(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("id"), F.lit("s").alias("source"))
    check_shards(sharding.stratified_shards(df, "source", ["id"], tile_rows=100).collect(), 8)


def test_sharding_query_and_messy_rows(spark, messy):
    rows = QUERIES["op5_sharding"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check_shards(rows, 8)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows) and len(rows) == len(texts)
    check_shards(sharding.stratified_shards(messy.select("doc_id", "source"), "source", ["doc_id"], shards=5).collect(), 5)
    assert sharding.stratified_shards(messy.select("doc_id", "source").limit(0), "source", ["doc_id"]).count() == 0


def brute_components(texts: dict) -> dict:
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block):
    """Copies with a few edits each, so that many links are near the limit; small blocks exercise large families."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(6):
        body = [rng.choice(words) for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(25):
            copy = body[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy) if base else "\n".join(copy).upper()
    texts |= {900: None, 901: "", 902: " \t", 903: "short one", 904: "SHORT  one", 905: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component_id", F.lit(1))
    rows = near_duplicates.near_duplicates(df, "doc_id").collect()
    want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_signatures_are_held_against_each_other():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, (30, near_duplicates.HASHES)).astype("<u2")
    b = rng.integers(0, 4, (20, near_duplicates.HASHES)).astype("<u2")
    assert (near_duplicates.distances(a, b) == (a[:, None] != b[None]).sum(2)).all()


def test_templated_texts_read_no_full_set(spark, monkeypatch):
    """Texts that share a template (similarity about 0.3) share keys, but hardly any lies near another: no family of them arises."""
    seen = {}
    for name in ("roots_near", "close_pairs", "family_links"):
        made = getattr(near_duplicates, name)
        monkeypatch.setattr(near_duplicates, name, lambda *a, made=made, name=name: seen.setdefault(name, made(*a)))
    rng = random.Random(2)
    body = [f"t{i}" for i in range(90)]
    texts = [" ".join([f"x{rng.random()}" for _ in range(50)] + body + [f"y{rng.random()}" for _ in range(50)]) for _ in range(1500)]
    texts += [texts[7], texts[7] + " end", texts[9].replace("t5 ", "t6 ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_duplicates.near_duplicates(df, "doc_id").collect()
    assert {r.doc_id: r.component_id for r in rows if not r.kept} == {1500: 7, 1501: 7, 1502: 9}
    assert seen["close_pairs"].count() <= 3 and seen["roots_near"].count() < 50
    assert near_duplicates.components(seen["roots_near"]).groupBy("root").count().agg(F.max("count")).first()[0] < 10


def test_near_duplicates_of_messy_rows(spark, messy):
    rows = near_duplicates.near_duplicates(messy.drop("kept"), "doc_id").collect()
    assert len(rows) == 12 and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6} and sum(r.kept for r in rows if r.component_id == 6) == 3
    assert near_duplicates.near_duplicates(messy.limit(0), "doc_id").count() == 0


def test_chunk_keys_meet_within_the_distance():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_duplicates.HASHES, np.uint64)
        b = a.copy()
        b[rng.choice(near_duplicates.HASHES, near_duplicates.MAX_DISTANCE, replace=False)] ^= np.uint64(1)
        x, y = near_duplicates.chunk_keys(np.array([a, b]))
        assert set(x) & set(y)


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 101), (5, 5), (None, 3)]
    df = spark.createDataFrame(path, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}
    assert components(df.limit(0)).count() == 0


def brute_nearest(vectors: dict, k: int) -> dict:
    keys = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in keys], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(keys % 50 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        out[int(keys[i])] = [int(keys[j]) for j in np.lexsort((keys, -s))[: min(k, len(keys) - 1)]]
    return out


def test_vector_recall(spark):
    folder = "/root/testdata/sf0.1"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["op10_nearest_vectors"](spark, folder).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(vectors, 5)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_vectors_of_messy_rows(spark):
    rng = np.random.default_rng(1)
    good = [(int(i), [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(0, 60)]
    good = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in good]
    bad = [(100, None), (150, [0.0] * 4), (200, [1.0, None, 0.0, 0.0]), (250, [float("nan")] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (350, [1.0]), (None, [1.0] * 4), (400, [])]
    df = spark.createDataFrame([*good, *bad, good[7]], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    rows = vector_search.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append(r.score)
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in good}
    assert set(got) == {0, 50}
    for q, scores in got.items():
        assert np.allclose(scores, sorted((float(x[q] @ v) for i, v in x.items() if i != q), reverse=True)[:5])
    assert vector_search.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0
    assert vector_search.nearest(df.filter("vec_id IN (0, 1)"), "vec_id", "embedding", F.col("vec_id") == 0).count() == 1


def test_queries_that_read_all_lists_are_sent_once_a_pack(spark, monkeypatch):
    """A query that reads all lists is written once, not once a list; the result is exact then."""
    monkeypatch.setattr(vector_search, "LIST_ROWS", 8)
    monkeypatch.setattr(vector_search, "fit_ratio", lambda *a: 1e3)
    monkeypatch.setattr(vector_search, "PACK_ROWS", 300, raising=False)
    made, kept = [], vector_search.stored
    monkeypatch.setattr(vector_search, "stored", lambda df: made.append(kept(df)) or made[-1])
    vectors = {int(i): [float(v) for v in x] for i, x in enumerate(np.random.default_rng(3).normal(size=(1500, 24)).astype(np.float32))}
    df = spark.createDataFrame([*vectors.items(), *[(i, vectors[i]) for i in range(0, 400, 50)]], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vector_search.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == brute_nearest(vectors, 5)
    assert max(t.groupBy("id").count().agg(F.max("count")).first()[0] for t in made) <= 2 * vector_search.COPIES


def test_packs_of_lists():
    assert vector_search.packs_of({0: 3, 1: 4, 2: 4, 5: 30, 7: 1, 8: 9}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 1), 5: (2, 3), 7: (5, 1), 8: (5, 1)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    repeated = docs.unionByName(docs.limit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, repeated, FOLDER)
        assert out.columns == corpus_pipeline.COLUMNS
    kept = out.collect()
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in kept) == sorted({v for v in want.values()})
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {r.doc_id for r in corpus_pipeline.quality(spark, docs, FOLDER).collect()}
    assert np.mean([k in good for k, q in marks.items() if q == 1]) > 0.95 and np.mean([k in good for k, q in marks.items() if q == 0]) < 0.4
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.count() > 0 and packed.groupBy("sequence_id").sum("length").agg(F.max("sum(length)")).first()[0] <= 1024


def test_pipeline_of_messy_rows(spark, messy):
    docs = messy.select(*corpus_pipeline.COLUMNS)
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, given, FOLDER).count() >= 0


def test_oracles(spark):
    from quire.llm.queries import ORACLES
    from tests.oracle_check import norm

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, FOLDER)
        cols = sorted(df.columns)
        rows = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted("|".join(norm(r[c]) for c in cols) for r in df.collect()) == sorted("|".join(map(norm, r)) for r in rows)
