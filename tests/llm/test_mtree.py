"""Exact top-k search against every pair, in whole numbers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mtree, queries

SCHEMA = "vec_id long, embedding array<double>, label int, v string, size string, cell string, qid string"


def brute(rows, k=20, scale=64):
    usual = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v)]
    if not usual:
        return []
    dims = Counter(len(v) for _, v in usual)
    dim = max(dims, key=lambda d: (dims[d], d))
    usual = [(i, v) for i, v in usual if len(v) == dim]
    out = []
    for q in sorted({i for i, _ in usual if i % 20 == 0}):
        best = {}
        for i, own in usual:
            if i == q:
                for j, other in usual:
                    if j != q:
                        score = max(mtree.LOW, min(mtree.HIGH, sum(a * b for a, b in zip(own, other))))
                        best[j] = max(best.get(j, score), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(ranked)]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "v", "s", "c", "q") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in mtree.search(df, df.filter(F.col("vec_id") % 20 == 0), **options).collect())


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    v = centers[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(-40, 120)]
    rows += [(i, [0.0, 0.0, 0.0]) for i in range(120, 150)]  # ties at zero
    rows += [(i, [0.5, -0.5, 0.25]) for i in range(150, 260)]  # a hot vector, asked and found
    rows += [(20, [9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0]), (21, [3.0, 3.0, 3.0]), (21, [-3.0, 1.0, 0.0])]  # repeated ids
    rows += [(300, None), (301, [None, 1.0, 2.0]), (320, [float("nan")] * 3), (321, [float("inf"), 0.0, 0.0]), (None, [9.0] * 3), (340, [1.0, 2.0]), (341, []), (360, [-0.001, 0.0, 0.015])]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, cell_rows=16, page_rows=4, first=1, block_rows=10, block_queries=3) == want


@pytest.mark.parametrize("large", [1e5, 1e12, 1e200])
def test_lengths_of_any_size(spark, large):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)] + [(200 + i, [float(x) for x in large * rng.normal(size=4)]) for i in range(30)] + [(400, [1e-9, 0.0, -1e-9, 0.0])]
    assert found(spark, rows, cell_rows=20, page_rows=5, first=1) == brute(rows)


def test_clusters_in_many_cells_and_pruning(spark):
    v = clustered(4_000, 16, 3)
    rows = list(enumerate(v.tolist()))
    got = found(spark, rows, cell_rows=100, page_rows=16, first=2)
    whole = np.floor(64 * v)
    for q in range(0, 4_000, 400):
        score = (whole @ whole[q]).astype(int)
        score[q] = -(10**6)
        order = np.lexsort((np.arange(4_000), -score))[:20]
        assert [r for r in got if r[0] == q] == [(q, n + 1, int(j), int(score[j])) for n, j in enumerate(order)]
    # stored angles rule most pages out before their pivots are met
    pages = mtree.build_pages(__import__("pandas").DataFrame({"cell": 0, "block": 0, "v": list(whole), "ids": [np.array([i]) for i in range(4_000)]}), mtree.unit(np.zeros((1, 17))), np.array([128.0]), 16, 21)
    assert sum(map(len, pages["ids"])) == 4_000 and max(map(len, pages["far"])) <= 32
    u, length = mtree.directions(whole[:1])
    met = mtree.angles(u, np.stack(pages["pivot"]))[0]
    kth = np.sort(whole @ whole[0])[-21]
    low = np.maximum(met - pages["outer"], pages["inner"] - met)
    assert (mtree.promise(length * 128.0, low.to_numpy()) >= kth).mean() < 0.5


def test_queries_of_many_cells_are_dealt_in_bounded_packs(spark, monkeypatch):
    """Vectors without clusters, all of them asked: each query meets every cell, and neither a pack nor what a task holds grows."""
    v = np.random.default_rng(4).normal(size=(1_100, 64))
    rows, packed, keep = [(20 * i, x) for i, x in enumerate((v / np.linalg.norm(v, axis=1, keepdims=True)).tolist())], {}, mtree.written
    monkeypatch.setattr(mtree, "written", lambda df, name: packed.setdefault(name, keep(df, name)))
    assert found(spark, rows, cell_rows=50) == brute(rows)
    most, pairs = packed["mtree-rest"].agg(F.max(F.size("qids")), F.sum(F.size("qids"))).first()
    assert most <= mtree.PACK_BYTES // 64 and pairs > 10 * 1_100
    whole = np.floor(64 * np.array([x for _, x in rows]))
    tree = mtree.Directory(mtree.unit(np.concatenate([whole, np.zeros((1_100, 1))], axis=1)), np.full(1_100, 64.0))
    n = np.arange(1_100)
    tree.cover(__import__("pandas").DataFrame({"cell": n, "inner": 0.0, "outer": 3.0, "least": n, "n": 1}), 10)
    dealt = [x["n"].sum() for x in mtree.packs(tree, n, whole, np.full(1_100, mtree.LOW), np.full(1_100, mtree.HIGH), [np.zeros(0, int)] * 1_100, 4)]
    assert sum(dealt) == 1_100**2 and max(dealt) * 64 <= 1.1 * mtree.HELD


def test_few_rows_and_none(spark):
    assert found(spark, []) == [] and found(spark, [(20, [1.0, 2.0])]) == [] and found(spark, [(20, [1.0]), (3, [2.0])], k=1) == [(20, 1, 3, 64 * 128)]
    assert found(spark, [(20, []), (21, []), (40, [])]) == [(20, 1, 21, 0), (20, 2, 40, 0), (40, 1, 20, 0), (40, 2, 21, 0)]


def test_query_is_exact(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_mtree(spark, "/root/testdata/sf0.001").collect()) == brute(rows)
