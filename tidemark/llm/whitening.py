"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become whole numbers x = floor(64 c) + 1 000 000; the fit list holds each
distinct x once. Its rows, centred, are reduced to one triangle by blockwise QR:
every task folds its rows into a triangle, triangles are folded in groups until one
is left. Householder reflections make the triangle bidiagonal, differential qd with
shifts (dqds) finds its singular values, and twisted factorisations of the shifted
product give the directions. No covariance is formed, so nothing is squared before
the subtraction and small variances keep their digits. Only the d x d triangle
reaches the driver.

Defined results: rows whose vector is null, empty, or holds a null, NaN or infinite
entry are left out, and so are rows whose length differs from the most frequent one
(ties: the shorter). Scaled entries are held within +-2^52, beyond which a double has
no fractions. Null and repeated ids stay as they are; repeated vectors count once in
the fit and each is returned. A constant table, a single vector or an empty table has
no component and gives no row. Components beyond the numerical rank do not exist.
``deviation`` is null where it exceeds a long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny / EPS
#: Rows folded into a triangle at a time, and triangles folded in a task.
BLOCK_ROWS, FAN_IN = 4096, 16
SCALE, SHIFT, LARGEST = 64.0, 1_000_000, 2.0 ** 52
#: Values closer than this part of the larger one share a cluster, whose directions
#: are kept orthogonal explicitly.
CLOSE = 1e-3


# ---- bidiagonal solver (one d x d triangle) ---------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right reflections V with r = U B V^T."""
    a = np.array(r, dtype=float)
    d = a.shape[0]
    right = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k < d - 2:
            v = _reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ (2 * v), v)
                right[:, k + 1:] -= np.outer(right[:, k + 1:] @ (2 * v), v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit v such that (I - 2 v v^T) x lies on the first axis; None if it does."""
    top = np.abs(x).max(initial=0.0)
    if top == 0.0 or not np.any(x[1:]):
        return None
    v = x / top
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform; the last number is the smallest d met (negative: the
    shift was too large)."""
    qs, es = [], []
    d = q[0] - shift
    low = d
    for k in range(len(e)):
        s = d + e[k]
        t = q[k + 1] / s if s else 0.0
        qs.append(s)
        es.append(e[k] * t)
        d = d * t - shift
        low = min(low, d)
        if low < 0.0 or d != d:
            return qs, es, -1.0
    qs.append(d)
    return qs, es, low


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    Each sweep is a dqds transform; its shift is the smaller eigenvalue of the last
    2 x 2 block, cut back until the sweep stays positive, and zero at worst, so that
    values keep their relative digits. A negligible last entry splits a value off; a
    negligible inner one splits the matrix."""
    found: list[float] = []
    todo = [((diagonal * diagonal).tolist(), (above * above).tolist(), 0.0)]
    while todo:
        q, e, base = todo.pop()
        if q[0] < q[-1]:                               # upside down: same values, large entries first
            q, e = q[::-1], e[::-1]
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if e[-1] <= EPS * EPS * (base + q[-1]) or e[-1] <= TINY:
                found.append(base + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = next((k for k in range(n - 2, -1, -1)
                        if e[k] <= EPS * EPS * (base + min(q[k], q[k + 1])) or e[k] <= TINY), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            shift = _last_block(q, e)
            while True:
                qs, es, low = _sweep(q, e, shift)
                if low >= 0.0:
                    break
                shift = shift * 0.25 if shift > EPS * (base + q[-1]) else 0.0
            q, e, base = qs, es, base + shift
    return np.sort(np.maximum(np.array(found), 0.0))[::-1]


def _last_block(q: list[float], e: list[float]) -> float:
    """Lower estimate of the smallest value from the last 2 x 2 block."""
    a, c, b = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1], e[-1]
    half = (a + b + c) / 2
    root = np.sqrt(max(half * half - q[-2] * c, 0.0))
    return max(0.0, (q[-2] * c) / (half + root)) * (1 - 4 * EPS) if half + root > 0 else 0.0


class Twisted:
    """Twisted factorisations of B^T B - value from the entries of B alone."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray):
        floor = EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0), TINY)
        a = np.where(np.abs(diagonal) < floor * EPS, floor * EPS, diagonal)
        self.d, self.l = (a * a).tolist(), (above / a[:-1]).tolist()
        self.n = len(self.d)

    def factor(self, value: float):
        """(lower multipliers, upper multipliers, their pivots, gamma)."""
        d, l, n = self.d, self.l, self.n
        small = TINY
        lower, plus, s = [0.0] * (n - 1), [0.0] * n, [0.0] * n
        s[0] = -value
        for k in range(n - 1):
            plus[k] = (s[k] + d[k]) or small
            lower[k] = d[k] * l[k] / plus[k]
            s[k + 1] = lower[k] * l[k] * s[k] - value
        plus[n - 1] = (s[n - 1] + d[n - 1]) or small
        upper, minus, p = [0.0] * (n - 1), [0.0] * n, [0.0] * n
        p[n - 1] = d[n - 1] - value
        for k in range(n - 2, -1, -1):
            minus[k + 1] = (d[k] * l[k] * l[k] + p[k + 1]) or small
            t = d[k] / minus[k + 1]
            upper[k] = l[k] * t
            p[k] = p[k + 1] * t - value
        minus[0] = p[0] or small
        gamma = [s[k] + p[k] + value for k in range(n)]
        return lower, upper, plus, minus, gamma

    def vector(self, value: float) -> np.ndarray:
        """Unit direction of a value that is well apart from the others: one twisted
        factorisation, with Rayleigh corrections while they still help."""
        best, rest = None, np.inf
        for _ in range(6):
            lower, upper, _, _, gamma = self.factor(value)
            r = int(np.argmin(np.abs(np.nan_to_num(np.array(gamma), nan=np.inf, posinf=np.inf, neginf=-np.inf))))
            z = np.zeros(self.n)
            z[r] = 1.0
            for k in range(r - 1, -1, -1):
                z[k] = -lower[k] * z[k + 1]
            for k in range(r, self.n - 1):
                z[k + 1] = -upper[k] * z[k]
            norm = np.linalg.norm(z)
            left = abs(gamma[r]) / norm
            if not np.isfinite(norm) or left >= rest:
                break
            best, rest = z / norm, left
            value += gamma[r] / (norm * norm)
            if left <= EPS * abs(value):
                break
        return best

    def solve(self, value: float, b: np.ndarray) -> np.ndarray:
        """(B^T B - value) x = b by the factorisation twisted where it is smallest."""
        lower, upper, plus, minus, gamma = self.factor(value)
        n, r = self.n, int(np.argmin(np.abs(gamma)))
        least = EPS * abs(value)                       # a smaller pivot would drown all but one direction
        pivot, plus, minus = (np.where(np.abs(p) < least, least, p) for p in (gamma[r], plus, minus))
        y = b.astype(float).tolist()
        for k in range(r):
            y[k + 1] -= lower[k] * y[k]
        for k in range(n - 1, r, -1):
            y[k - 1] -= upper[k - 1] * y[k]
        x = [y[k] / (pivot if k == r else plus[k] if k < r else minus[k]) for k in range(n)]
        for k in range(r - 1, -1, -1):
            x[k] -= lower[k] * x[k + 1]
        for k in range(r + 1, n):
            x[k] -= upper[k - 1] * x[k - 1]
        return np.array(x)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a triangle, falling, and the right singular
    directions (columns) of the first ``most`` that are not zero."""
    diagonal, above, right = bidiagonal(r)
    values = dqds(diagonal, above)
    d = len(values)
    rank = int(np.sum(values > (d * EPS) ** 2 * values[0])) if values[0] > 0 else 0
    k = min(most, rank)
    twisted = Twisted(diagonal, above)
    rng = np.random.default_rng(7)
    z = np.zeros((d, k))
    i = 0
    while i < k:
        j = i + 1
        while j < d and values[j - 1] - values[j] <= CLOSE * values[j - 1]:
            j += 1
        if j == i + 1:
            z[:, i] = twisted.vector(values[i])
        else:                                          # a cluster: solves, orthogonal to those before
            for m in range(i, min(j, k)):
                shifted = values[m] * (1 + 64 * EPS)      # near all copies of a value, on none
                x = rng.normal(size=d)
                for _ in range(5):
                    x = _apart(twisted.solve(shifted, x / np.linalg.norm(x)), z[:, i:m])
                z[:, m] = x / np.linalg.norm(x)
        i = j
    whole = right @ z
    for m in range(k):                                 # rounding between neighbouring clusters
        whole[:, m] = _apart(whole[:, m], whole[:, :m])
        whole[:, m] /= np.linalg.norm(whole[:, m])
    return values, whole


def _apart(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """x without its parts along the basis, taken off twice; scaled first, since a
    solve next to a value may be huge."""
    top = np.abs(x).max(initial=0.0)
    x = x / top if top > 0 else x
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


# ---- distributed part -------------------------------------------------------

def grid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Usable rows with ``x``, their vector as whole numbers."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    held = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(
        F.lit(LARGEST), c.cast("double") * SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(fine, F.lit(False))).withColumn("x", held)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int, kind: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, d)


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x minus the mean, given as whole numbers and fractions: the large common part
    goes exactly."""
    return (x - whole).astype(float) - part


def _folded(parts: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray | None:
    """Merge the rows (slot, m: array<double>) in groups of FAN_IN inside tasks until
    one is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            for row in _matrix(b.column("m"), width, float):
                acc = row if acc is None else merge(acc, row)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([acc], pa.list_(pa.float64()))], ["m"])

    left = parts.rdd.getNumPartitions()
    parts = durable(parts)
    while left > 1:
        left = -(-left // FAN_IN)
        parts = durable(parts.coalesce(left).mapInArrow(run, "m array<double>"))
    row = parts.first()
    return None if row is None else np.array(row["m"])


@dataclass
class Whitener:
    """A fit: n, exact sums, values and directions of the covariance, its trace and
    the largest departure of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        whole = [s // self.n for s in self.sums]
        return np.array(whole, dtype=np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def projector(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values[:self.axes.shape[1]])


def most_frequent_length(rows: DataFrame) -> int | None:
    top = (rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k"))
           .orderBy(F.desc("k"), "d").first())
    return None if top is None else top["d"]


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension: each task adds its rows, Spark adds tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column("x"), d, np.int64)
            n += len(x)
            for lo in range(0, len(x), 512):           # 512 * 2^53 fits a long
                total = [t + int(s) for t, s in zip(total, x[lo:lo + 512].sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["pos", "s"])

    added = fit.select("x").mapInArrow(run, "pos int, s string")
    rows = added.groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # d + 1 rows
    by_pos = {r["pos"]: int(r["s"]) for r in rows}
    return by_pos[-1], [by_pos[k] for k in range(d)]


def fit(fit_list: DataFrame, d: int, most: int) -> Whitener | None:
    """Whitener of a durable list of distinct x vectors of length d; None if empty."""
    if fit_list.isEmpty():
        return None
    n, sums = _sums(fit_list, d)
    w = Whitener(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    whole, part = w.mean()

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            rows = _centred(_matrix(b.column("x"), d, np.int64), whole, part)
            for lo in range(0, len(rows), BLOCK_ROWS):
                r = np.linalg.qr(np.vstack([r, rows[lo:lo + BLOCK_ROWS]]), mode="r")
        if len(r):
            full = np.zeros((d, d))
            full[:len(r)] = r
            yield pa.RecordBatch.from_arrays([pa.array([full.ravel()], pa.list_(pa.float64()))], ["m"])

    r = _folded(fit_list.select("x").mapInArrow(triangles, "m array<double>"),
                lambda a, b: np.linalg.qr(np.vstack([a.reshape(d, d), b.reshape(d, d)]), mode="r").ravel(), d * d)
    r = r.reshape(d, d)
    squares, axes = directions(r, most)
    w = Whitener(n, sums, squares / n, axes, float(np.sum(r * r)) / n)
    w.identity_error = _departure(fit_list, w, d)
    return w


def _departure(fit_list: DataFrame, w: Whitener, d: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus identity,
    from counts, means and centred products merged pairwise."""
    (whole, part), p, k = w.mean(), w.projector(), w.axes.shape[1]
    if k == 0:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            z = _centred(_matrix(b.column("x"), d, np.int64), whole, part) @ p
            if len(z):
                m = z.mean(axis=0)
                one = np.concatenate([[len(z)], m, ((z - m).T @ (z - m)).ravel()])
                acc = one if acc is None else merged(acc, one)
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([acc], pa.list_(pa.float64()))], ["m"])

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = a[0], b[0]
        gap = b[1:k + 1] - a[1:k + 1]
        products = a[k + 1:] + b[k + 1:] + np.outer(gap, gap).ravel() * (na * nb / (na + nb))
        return np.concatenate([[na + nb], a[1:k + 1] + gap * (nb / (na + nb)), products])

    acc = _folded(fit_list.select("x").mapInArrow(moments, "m array<double>"), merged, 1 + k + k * k)
    return float(np.abs(acc[k + 1:].reshape(k, k) / acc[0] - np.eye(k)).max())


def transform(rows: DataFrame, w: Whitener, d: int, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component."""
    (whole, part), p, k, n, sums = w.mean(), w.projector(), w.axes.shape[1], w.n, w.sums
    id_type = rows.schema[id_col].dataType.simpleString()
    share, error = [float(v) for v in w.values[:k] / w.trace] if k else [], w.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        top = max(int(np.abs(x).max(initial=0)) * n, max(abs(s) for s in sums))
        if top < 2 ** 62:
            gap = n * x - np.array(sums, dtype=np.int64)
            if float(np.abs(gap).max(initial=0)) ** 2 * d < 2.0 ** 62:
                return (gap * gap).sum(axis=1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return [v if v < 2 ** 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), d, np.int64)
            if not len(x):
                continue
            z = _centred(x, whole, part) @ p
            m = len(x)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(at)),
                 pa.array(z.ravel()), pa.array(np.tile(np.array(share), m)), pa.array(np.full(m * k, error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = (f"{id_col} {id_type}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    return rows.select(id_col, "x").mapInArrow(run, schema)


def whiten(df: DataFrame, most: int = 16, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Fit on the distinct usable vectors of ``df`` and return every usable row's
    whitened components."""
    rows = grid(df.select(id_col, vector), vector)
    d = most_frequent_length(rows)
    found = None
    if d is not None:
        rows = rows.where(F.size("x") == d)
        found = fit(durable(rows.select("x").distinct()), d, most)
    if found is None or found.axes.shape[1] == 0:
        empty = Whitener(1, [0], np.ones(1), np.ones((1, 1)), 1.0)
        return transform(rows.where(F.lit(False)), empty, 1, id_col)
    return transform(rows, found, d, id_col)
