import math

import numpy as np
import pytest

from ledgerloom.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<float>, rid string, dim string, Shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def units(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def good(rows):
    return [(i, units(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_top(rows, k):
    rows, out = good(rows), []
    for a, (q, x) in enumerate(rows):
        if q is None or q % 100:
            continue
        s = sorted((-sum(p * r for p, r in zip(x, y)), i is None, i or 0) for b, (i, y) in enumerate(rows) if b != a and len(x) == len(y))
        out += [(q, n + 1, None if none else i, -v) for n, (v, none, i) in enumerate(s[:k])]
    return sorted(out, key=repr)


def edge_rows(n=400, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).round(2).tolist()) for i in range(n)]
    rows += [(i + 1000, rows[0][1]) for i in range(300)]  # a common vector: ties
    rows += [(100, rows[3][1]), (None, rows[0][1]), (None, rows[5][1]), (2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] + [0.0] * (dim - 1)), (2300, [float("inf")] + [0.0] * (dim - 1))]
    return rows + [(3000, []), (3100, []), (4000, [1.0]), (4001, [2.0]), (4002, [-2.0])]


def test_top_k_equals_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = edge_rows()
    for shard, queries in ((topk.SHARD, topk.QUERIES), (300, 12)):  # one shard, and many shards and blocks
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "QUERIES", queries)
        got = topk.top_k(frame(spark, rows).repartition(5), F.col("vec_id") % 100 == 0).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_top(rows, 10)


def test_top_k_of_nothing_and_of_large_numbers(spark):
    from pyspark.sql import functions as F

    asks = F.col("vec_id") % 100 == 0
    assert topk.top_k(frame(spark, []), asks).count() == 0
    rows = [(i, [2e4 * (i + 1), -3e4, 7.0]) for i in range(0, 50)] + [(100, [2e5, 1e5, 1.0])]
    assert sorted((tuple(r) for r in topk.top_k(frame(spark, rows), asks).collect()), key=repr) == brute_top(rows, 10)


def test_boxes_bound_and_trees_are_whole():
    x = np.random.default_rng(0).integers(-50, 50, (1000, 5))
    x[300:800] = x[0]
    order, begin, left, low, high = topk.build_tree(x, 16)
    leaves = [(begin[2 * i], begin[2 * i + 1]) for i in range(len(left)) if left[i] < 0]
    assert sorted(order) == list(range(1000)) and sum(b - a for a, b in leaves) == 1000 and max(b - a for a, b in leaves) <= 16
    q = np.array([3, -4, 0, 5, -1])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    for i in range(len(left)):
        assert (x[order[begin[2 * i] : begin[2 * i + 1]]] @ q).max() <= bounds[i]


def brute_white(rows, dim):
    x = np.array([np.array(u, object) + 100000 for _, u in good(rows) if len(u) == dim])
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = x.astype(float) - (s / n).astype(float)
    e, w = np.linalg.eigh(z.T @ z / n)
    e, w = e[::-1][:8], w[:, ::-1][:, :8]
    return n, deviation, z @ (w / np.sqrt(e)), e / np.trace(z.T @ z / n)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    shape = rng.standard_normal((12, 12))
    rows = [(i, (rng.standard_normal(12) @ shape / 9).tolist()) for i in range(500)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (600, None), (601, [float("nan")] * 12), (602, [None] * 12), (603, [1.0] * 5), (604, [])]
    out = whitening.whitened(frame(spark, rows).repartition(4)).toPandas()
    n, deviation, white, share = brute_white(rows, 12)
    assert (out.n == n).all() and len(out) == 8 * n and out.identity_error.max() < 1e-9
    assert sorted(out[out.component == 1].deviation) == sorted(deviation)
    for c in range(1, 9):
        own = out[(out.component == c) & out.vec_id.notna() & (out.vec_id != 7)].sort_values("vec_id")
        ids = [i for i, _ in good(rows)]
        ref = np.array([white[a, c - 1] for a, i in enumerate(ids[:n]) if i is not None and i != 7])
        assert np.allclose(abs(own.explained / share[c - 1] - 1), 0, atol=1e-9)
        assert min(np.abs(own.whitened.values - ref).max(), np.abs(own.whitened.values + ref).max()) < 1e-8
    assert sorted(out[out.vec_id == 7].component) == sorted([*range(1, 9)] * 2)


def test_whitening_of_little(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [])])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in line)
    wide = whitening.whitened(frame(spark, [(i, [1e12 * i, 1.0]) for i in range(3000)])).collect()
    assert {r.deviation for r in wide} == {None} and {r.component for r in wide} == {1}
    with pytest.raises(ValueError):
        whitening.whitened(frame(spark, [(1, [1.0] * 9)]), max_dim=8)


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(i, [3e3 * (i % 7) + i / 1024, i * 17.0]) for i in range(60)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(frame(spark, rows)).collect()}
    assert [got[i] for i in range(60)] == brute_white(rows, 2)[1].tolist()


@pytest.mark.parametrize("kind", ["any", "equal", "half", "one large", "near"])
@pytest.mark.parametrize("d", [1, 2, 9, 40])
def test_leading_components(d, kind):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, 3 * d))
    v = {"any": a @ a.T, "equal": 3.0 * np.eye(d), "half": np.diag([0.0] * (d // 2) + [1.0] * (d - d // 2)), "one large": a @ a.T + 1e6, "near": np.diag(1 + 1e-7 * np.arange(d))}[kind]
    e, w = whitening.leading(v, 8)
    ref = np.linalg.eigvalsh(v)[::-1][:8]
    ref = ref[ref > d * np.finfo(float).eps * np.trace(v)]
    assert len(e) == len(ref) and np.allclose(e, ref, rtol=1e-12, atol=1e-12 * ref[0])
    assert np.abs(v @ w - w * e).max() < 1e-11 * ref[0] and np.abs(w.T @ w - np.eye(len(e))).max() < 1e-8
