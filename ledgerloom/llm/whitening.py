"""Whitening of vectors: their leading components, found by contour integration over the covariance.

Spark adds up the counts, sums and centred products of all rows; what comes to the driver is one matrix of dimension by
dimension. Its leading eigenvalues are enclosed by circles between gaps that counts of inertia find. Over each circle the
resolvent is integrated by quadrature of complex shifted solves, which leaves the components within; a Rayleigh-Ritz step takes
them out, and the inertia at the circle's ends tells whether any is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.vectors import usable, whole

SHIFT = 100_000
#: A component beyond this either way counts as this: sums of any number of rows stay exact.
LIMIT = 1 << 50
WHITENED = "vec_id bigint, component int, deviation bigint, whitened double"


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    return whole(column, dim, LIMIT) + SHIFT


def _sums(dim: int):
    """Counts and exact sums of a partition: (i, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            x = _whole(b.column(0), dim)
            n += len(x)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
            total = [t + (h << 26) + w for t, h, w in zip(total, high, low, strict=True)]
        if n:
            yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "total"])

    return run


def _products(dim: int, mean: np.ndarray, onto: np.ndarray | None = None):
    """Sums of a partition's centred products, (i, j, v), and of what is multiplied, at j = -1. With `onto`, of the rows projected on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = dim if onto is None else onto.shape[1]
        out, plain = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            z = _whole(b.column(0), dim) - mean
            if onto is not None:
                z = z @ onto
            plain += z.sum(axis=0)
            out += z.T @ z
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.record_batch([pa.array(np.append(i, np.arange(k)), pa.int32()), pa.array(np.append(j, np.full(k, -1)), pa.int32()), pa.array(np.append(out.reshape(-1), plain))], names=["i", "j", "v"])

    return run


def _matrix(sums: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed products as a matrix, and the plain sums: k * k + k numbers, however many rows there are."""
    out, plain = np.zeros((k, k)), np.zeros(k)
    for i, j, v in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if j < 0:
            plain[i] = v
        else:
            out[i, j] = v
    return out, plain


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix that reflections make of the symmetric `v`: its inertia is the same."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = p - (x @ p) * x
        a[k + 1 :, k + 1 :] -= 2 * np.outer(x, w) + 2 * np.outer(w, x)
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, a[k + 1, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are larger than each shift: the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).eps * (np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)) + 1e-300
    pivot, count = diagonal[0] - shifts, np.zeros(len(shifts), int)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def circles(diagonal: np.ndarray, off: np.ndarray, k: int, apart: float = 1e-5) -> list[tuple[float, float, int]]:
    """(low, high, count) from above until at least k eigenvalues are enclosed. Those closer than `apart` of the largest go into one
    interval; an interval reaches half the way to the nearest one outside."""
    d = len(diagonal)
    reach = (np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max()
    low, high, nth = np.full(d, -reach), np.full(d, reach * (1 + 1e-9)), np.arange(1, d + 1)
    for _ in range(60):
        mid = (low + high) / 2
        over = above(diagonal, off, mid) >= nth
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    e = (low + high) / 2
    step = apart * max(abs(e[0]), 1e-300)
    out, first = [], 0
    while first < d and first < k:
        last = first
        while last + 1 < d and e[last] - e[last + 1] <= step:
            last += 1
        up = e[first - 1] - e[first] if first else np.inf
        down = e[last] - e[last + 1] if last + 1 < d else np.inf
        wide = min(up, down) / 2 if min(up, down) < np.inf else max(abs(e[0]), 1.0)
        out.append((e[last] - wide, e[first] + wide, last + 1 - first))
        first = last + 1
    return out


def contour(v: np.ndarray, low: float, high: float, count: int, nodes: int = 8, most: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues of `v` between `low` and `high`, falling, and their unit vectors."""
    d = len(v)
    size = np.linalg.norm(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(1j * np.pi * (2 * np.arange(nodes) + 1) / (2 * nodes))
    width = min(d, count + count // 2 + 2)
    while True:
        y = np.random.default_rng(0).standard_normal((d, width))
        for _ in range(most):
            q = sum((turn * np.linalg.solve((centre + radius * turn) * np.eye(d) - v, y)).real for turn in turns)
            q, _ = np.linalg.qr(q)
            e, w = np.linalg.eigh(q.T @ v @ q)
            y = q @ w
            inside = (e > low) & (e < high)
            left = np.linalg.norm(v @ y[:, inside] - y[:, inside] * e[inside], axis=0)
            if inside.sum() == count and (left <= 4 * d * np.finfo(float).eps * size).all():
                return e[inside][::-1], y[:, inside][:, ::-1]
        if width == d:
            raise ArithmeticError(f"{count} components lie between {low} and {high}, of which {inside.sum()} were found")
        width = min(d, 2 * width)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric `v`, falling, with unit vectors (the largest entry is positive), checked by
    inertia; those that rounding could have made out of nothing are left out."""
    trace = np.trace(v)
    if not len(v) or trace <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off = tridiagonal(v / trace)
    around = circles(diagonal, off, k)
    found = [contour(v / trace, *c) for c in around]
    e, w = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found], axis=1)
    if above(diagonal, off, np.array([around[-1][0]]))[0] != len(e):
        raise ArithmeticError("a component is missing")
    by = np.argsort(-e, kind="stable")[:k]
    e, w = e[by], w[:, by]
    some = e > len(v) * np.finfo(float).eps
    w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    return e[some] * trace, w[:, some]


def _whiten(dim: int, n: int, total: list[int], mean: np.ndarray, onto: np.ndarray):
    """Rows of (vec_id, embedding) as rows for each component."""
    k, sums = onto.shape[1], np.array(total, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _whole(b.column(1), dim)
            if not len(x) or not k:
                continue
            w = (x - mean) @ onto
            most = max(n * (int(np.abs(x).max()) + 1) * 2, 1)
            far = n * x - sums.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - sums
            if int(np.abs(far).max()) ** 2 * dim >= 1 << 62:
                far = far.astype(object)
            deviation = [int(t) if t < 1 << 63 else None for t in (far * far).sum(axis=1).tolist()]
            at = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.reshape(-1))],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return run


def whitened(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding", max_dim: int = 2048) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component, over all rows whose vector
    is there and finite.

    Components come from floor(1024 * entry) + 100000. `deviation`, exact, is null where it leaves 64 bits (n over about a million
    unit vectors). Vectors of another length than the commonest (of equally common, the longest) take no part; a component without
    variance does not count, so copies of one vector, or a single one, give no rows, and neither does an empty table. Repeated rows
    count each time, ids may be null or repeat, other columns are not looked at. Entries are held within 2^50 / 1024. One
    matrix of dimension by dimension is worked on at the driver, so the dimension is at most `max_dim`.
    """
    rows = usable(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding")))
    common = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("dim", F.struct("n", "dim")).alias("dim")).first()
    dim = common["dim"] or 0
    if dim > max_dim:
        raise ValueError(f"vectors have {dim} components; at most {max_dim} are worked on")
    rows = rows.where(F.size("embedding") == dim)
    entries = rows.select("embedding")
    sums = entries.mapInArrow(_sums(dim), "i int, n long, total decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect() if dim else []
    n, total = (sums[0]["n"] if sums else 0), [0] * dim
    for s in sums:
        total[s["i"]] = int(s["total"])
    mean = np.array([float(Fraction(t, max(n, 1))) for t in total])
    products, _ = _matrix(entries.mapInArrow(_products(dim, mean), "i int, j int, v double"), dim) if n else (np.zeros((0, 0)), None)
    v = (products + products.T) / 2 / max(n, 1)
    e, w = leading(v, components)
    k, onto = len(e), w / np.sqrt(e)
    error = 0.0
    if k:
        # What is left of the means is rounding; it is taken off as well.
        around, plain = _matrix(entries.mapInArrow(_products(dim, mean, onto), "i int, j int, v double"), k)
        error = float(np.abs(around / n - np.outer(plain / n, plain / n) - np.eye(k)).max())
    out = rows.select("vec_id", "embedding").mapInArrow(_whiten(dim, n, total, mean, onto), WHITENED)
    share = F.element_at(F.array(*[F.lit(float(x)) for x in e / np.trace(v)] or [F.lit(0.0)]), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
