"""Exact nearest vectors with blocks left out, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import nearest as N
from quire.operators import retrieval as R


def brute(nodes: dict, queries: dict, k: int, scope: bool) -> dict:
    out = {}
    for q, (qv, qs) in queries.items():
        ranked = []
        for n, (nv, ns) in nodes.items():
            if scope and ns != qs:
                continue
            a, b = (np.array(v if v is not None and all(x is not None for x in v) else [np.nan], float) for v in (qv, nv))
            fine = len(a) == len(b) == 6 and np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()
            score = float(N.unit(a[None])[0] @ N.unit(b[None])[0]) if fine else None
            ranked.append((score is None, -round(score, 12) if fine else 0, n))
        out[q] = [(n, None if none else -s) for none, s, n in sorted(ranked)[:k]]
    return out


def found(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.node_id, None if r.score is None else round(r.score, 12)))
    return out


@pytest.mark.parametrize("scope", [True, False])
def test_top_k_equals_brute_force(spark, monkeypatch, scope):
    """Copies, opposite vectors, vectors without a score, small blocks and packs, scopes of any size."""
    for name, size in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 3), ("CENTRES", 4), ("PIVOTS", 12), ("PIVOT_ROWS", 8)):
        monkeypatch.setattr(N, name, size)
    rng = np.random.default_rng(4)
    nodes = {i: (rng.integers(-2, 3, 6).astype(float).tolist(), f"s{i % 3}") for i in range(220)}
    nodes |= {300 + i: (nodes[i][0], "s0") for i in range(30)} | {400: ([0.0] * 6, "s0"), 401: (None, "s1"), 402: ([1.0, None, 0.0, 0.0, 0.0, 0.0], "s0"), 403: ([1.0], "s0"), 404: ([1e200] * 6, "s0"), 405: ([1e-200] * 6, "s1"), 406: ([2.0] * 6, "lonely")}
    queries = {i: (rng.integers(-2, 3, 6).astype(float).tolist(), f"s{i % 4}") for i in range(25)} | {50: ([0.0] * 6, "s0"), 51: (None, "s1"), 52: ([1.0] * 6, "lonely"), 53: ([float("nan")] * 6, "s0")}
    n = spark.createDataFrame([(k, v, s) for k, (v, s) in nodes.items()], "node_id long, embedding array<double>, scope string")
    q = spark.createDataFrame([(k, v, s) for k, (v, s) in queries.items()], "query_id long, query_vector array<double>, scope string")
    if not scope:
        n, q = n.drop("scope"), q.drop("scope")
    got = found(R.similarity_top_k(n, q, 4, ["scope"] if scope else None))
    want = {k: [(i, None if s is None else round(s, 12)) for i, s in v] for k, v in brute(nodes, queries, 4, scope).items() if v}
    assert got.keys() == want.keys()
    for k, rows in want.items():
        assert [i for i, _ in got[k]] == [i for i, _ in rows]
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[k], rows, strict=True))
    assert R.similarity_top_k(n.limit(0), q, 4).count() == 0 and R.similarity_top_k(n, q.limit(0), 4).count() == 0


def test_far_blocks_are_not_read(spark, monkeypatch):
    """Vectors in tight groups: a query reads its own group's blocks and few others, and still finds the nearest."""
    read = {}
    made = N.block_pairs
    monkeypatch.setattr(N, "block_pairs", lambda *a: read.setdefault(len(read), made(*a)))
    monkeypatch.setattr(N, "PIVOT_ROWS", 25)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 5
    vectors = np.concatenate([c + 0.05 * rng.standard_normal((50, 16)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    n = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    q = n.filter("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = found(N.exact_top_k(n, q, 5, []).select("query_id", "node_id", "score", "rank"))
    x = N.unit(vectors)
    for k, found_rows in got.items():
        assert [i for i, _ in found_rows] == np.lexsort((np.arange(len(x)), -np.round(x @ x[k], 12)))[:5].tolist()
    blocks = 2000 // 25
    pairs = read[0].count() + read[1].count()
    assert pairs < 0.2 * 40 * blocks
