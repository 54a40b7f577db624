"""Whitening of embeddings by a bidiagonal qd solver.

Entries become whole numbers, floor(64 * c) + 1000000, and every different
vector stands once in the fit list. Its n rows, less their mean, are reduced
block by block to one triangular R: a task folds its blocks into one R, and the
R of the tasks meet in a tree of Spark groups. Householder reflections make R
bidiagonal, the shifted differential quotient difference iteration (dqds) finds the
singular values to high relative accuracy, and twisted factorisations of the
shifted bidiagonal products give the directions; near values are solved together and
kept orthogonal. A row's whitened values are its centred vector on these
directions, divided by the standard deviation there.

Only counts, sums, one R and the 16 x 16 check matrix reach the driver, whose sizes
depend on the dimension alone. Sums are of whole numbers and exact.

Rows take no part if the vector is null, holds a null or non-finite entry, has
another length than `dims` (unless given, the most common length, the smaller of equally
common ones), or holds an entry whose whole number is not below 2**40. A deviation
that no 64-bit number holds is null. Rows with equal or null ids are all returned. Components whose singular
value is zero to double precision have no direction and are left out, so a
single vector, equal vectors and an empty table give no rows. Other columns
than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.texts import ready_workers
from tickloom.session import materialise

COMPONENTS = 16
FAN_IN = 16
BLOCK = 4096
EPS = np.finfo(np.float64).eps
#: values this close, relative to the larger, are solved as one cluster
CLUSTER = 1e-3
LIMIT = float(1 << 40)

State = tuple  # of one task's fold


# --- rows ---------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """vec_id and x, the whole numbers of each row that takes part."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * 64 < LIMIT)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.where(F.forall("c", entry))
    x = F.transform("c", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long")).alias("x")
    if dims is None:
        lengths = rows.groupBy(F.size("c").alias("dims")).count().agg(F.min_by("dims", F.struct(-F.col("count"), F.col("dims"))))
        dims = lengths.first()[0] or 0
    return rows.where(F.size("c") == dims).select("vec_id", x)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK rows, and their x as a matrix."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


# --- one state per task, merged in a tree -----------------------------------------


def folded(rows: DataFrame, step: Callable[[State | None, np.ndarray], State], merge: Callable[[State, State], State]) -> State | None:
    """`step` over the blocks of each task, then `merge` of FAN_IN states at a time down to one."""
    ready_workers(rows.sparkSession)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in matrices(batches):
            state = step(state, x)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(state)])], ["node", "state"])

    def join(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        found = [pickle.loads(s) for s in states.sort_values("node")["state"]]
        one = found[0]
        for other in found[1:]:
            one = merge(one, other)
        return pd.DataFrame({"node": [key[0]], "state": [pickle.dumps(one)]})

    level = materialise(rows.select("x").mapInArrow(leaf, "node long, state binary"), "states")
    nodes = level.agg(F.max("node")).first()[0]
    while nodes:
        level = level.groupBy(F.floor(F.col("node") / FAN_IN).alias("group")).applyInPandas(join, "node long, state binary")
        nodes //= FAN_IN
    last = level.first()
    return pickle.loads(last["state"]) if last else None


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def step(state, x):
        # halves of 32 bits add up exactly in 64
        own = [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
        return merge(state, (len(x), own)) if state else (len(x), own)

    def merge(a, b):
        return a[0] + b[0], [p + q for p, q in zip(a[1], b[1])]

    return folded(rows, step, merge) or (0, [])


def centred(x: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, as exact whole numbers, and x - S / n as doubles."""
    reach = max(abs(int(x.min())), abs(int(x.max())), 1) * n + max(map(abs, s))
    if reach < 1 << 63:
        exact = x * n - np.array(s, np.int64)
    else:
        exact = x.astype(object) * n - np.array(s, object)
    return exact, (exact / n).astype(np.float64)


def triangle(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """R of the centred rows: a Householder QR per block, then of R pairs."""

    def step(state, x):
        own = centred(x, n, s)[1]
        return (np.linalg.qr(own if state is None else np.vstack([state[0], own]), mode="r"),)

    def merge(a, b):
        return (np.linalg.qr(np.vstack([a[0], b[0]]), mode="r"),)

    return folded(rows, step, merge)[0]


# --- the solver -----------------------------------------------------------------


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta, alpha with (I - beta v v') x = alpha e1."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    v = x / scale
    alpha = -math.copysign(float(np.sqrt(v @ v)), v[0] or 1.0)
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha * scale


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transform V with R = U B V'. Fewer rows than columns are filled with zeros."""
    d = r.shape[1]
    a = np.zeros((max(d, r.shape[0]), d))
    a[: r.shape[0]] = r
    turn = np.eye(d)
    for k in range(d):
        v, beta, alpha = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        a[k, k] = alpha
        a[k + 1 :, k] = 0.0
        if k + 2 < d:
            v, beta, alpha = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            turn[:, k + 1 :] -= beta * np.outer(turn[:, k + 1 :] @ v, v)
            a[k, k + 1], a[k, k + 2 :] = alpha, 0.0
    return np.diag(a)[:d].copy(), np.diag(a, 1)[: d - 1].copy(), turn


def split(diagonal: np.ndarray, above: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [first, end) between superdiagonal entries that are zero to double precision of their neighbours."""
    small = np.abs(above) <= EPS * 0.5 * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:]))
    edges = [0, *(np.flatnonzero(small) + 1).tolist(), len(diagonal)]
    return list(zip(edges, edges[1:]))


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling.

    q holds squared diagonal, e squared superdiagonal entries. A step with shift s
    gives the q, e of a matrix whose squared values are less by s; a shift that makes
    a q negative was too large and is tried again a quarter as large, at last as
    zero, which is always safe. Squares that converge at the end leave.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    q, e = ((diagonal / scale) ** 2).tolist(), [*((above / scale) ** 2).tolist(), 0.0]
    found, stack = [], [(q, e[: len(q) - 1], 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            # an e that adds nothing to its neighbours splits or ends the block
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1])) or e[i] == 0.0), None)
            if cut == n - 2:
                found.append(q.pop() + sigma)
                e.pop()
                continue
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if n == 2:
                # the two values of a 2 x 2 block, without cancellation
                total = q[0] + q[1] + e[0]
                gap = math.sqrt(max(0.0, (q[0] - q[1]) ** 2 + e[0] * (2 * (q[0] + q[1]) + e[0])))
                large = 0.5 * (total + gap)
                found += [large + sigma, (q[1] * (q[0] / large) if large else 0.0) + sigma]
                break
            # the larger end belongs at the top, where the iteration moves large values
            if q[-1] > 4 * q[0]:
                q, e = q[::-1], e[::-1]
            shift = _smallest(q, e)
            while True:
                made = _transform(q, e, shift)
                if made is not None:
                    break
                shift = shift / 4 if shift > EPS * q[-1] else 0.0
            (q, e), sigma = made, sigma + shift
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1]) * scale


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step, or None if the shift was above the smallest squared value."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0.0:
            return None
        top = d + e[i]
        new_q.append(top)
        if top == 0.0:
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            new_e.append(e[i] * ratio)
            d = d * ratio - shift
    if d < 0.0:
        return None
    new_q.append(d)
    return new_q, new_e


def _smallest(q: list[float], e: list[float]) -> float:
    """A shift a little below the smallest squared value: from the unshifted step, whose d bound it."""
    d, sums, least = q[0], 1.0 / q[0] if q[0] else math.inf, q[0]
    for i in range(len(e)):
        top = d + e[i]
        d = d * (q[i + 1] / top) if top else q[i + 1]
        least = min(least, d)
        sums += 1.0 / d if d else math.inf
    # 1 / sum(1 / d) is below the smallest squared value, min(d) above it
    return 0.0 if not math.isfinite(sums) else max(1.0 / sums, 0.0) * (1 - 8 * EPS)


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float):
    """Twisted factorisation of B'B - square I: the stationary and progressive qd
    transforms from both ends, their multipliers, and gamma of every twist."""
    d = len(diagonal)
    q, e = (diagonal**2).tolist(), (above**2).tolist()
    tiny = EPS * EPS * max(max(q), square, np.finfo(float).tiny)
    rise, s = [0.0] * max(0, d - 1), [0.0] * d
    lower = [0.0] * max(0, d - 1)
    s[0] = -square
    cross = (diagonal[:-1] * above).tolist()
    for i in range(d - 1):
        pivot = q[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        rise[i] = pivot
        lower[i] = cross[i] / pivot
        s[i + 1] = e[i] * (s[i] / pivot) - square
    p = [0.0] * d
    upper, fall = [0.0] * max(0, d - 1), [0.0] * max(0, d - 1)
    p[d - 1] = q[d - 1] - square
    for i in range(d - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        fall[i] = pivot
        upper[i] = cross[i] / pivot
        p[i] = q[i] * (p[i + 1] / pivot) - square
    gamma = [s[k] + p[k] + square for k in range(d)]
    return lower, rise, upper, fall, gamma


def _vector(factors, k: int) -> np.ndarray:
    """The solution of (B'B - square I) z = gamma_k e_k with z_k = 1."""
    lower, _, upper, _, gamma = factors
    z = np.zeros(len(gamma))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, len(gamma) - 1):
        z[i + 1] = -upper[i] * z[i]
    return z


def _solved(factors, k: int, b: np.ndarray) -> np.ndarray:
    """z with N diag N' z = b for the factorisation twisted at k."""
    lower, rise, upper, fall, gamma = factors
    d, y = len(gamma), b.copy()
    for i in range(k):
        y[i + 1] -= lower[i] * y[i]
    for i in range(d - 2, k - 1, -1):
        y[i] -= upper[i] * y[i + 1]
    for i in range(k):
        y[i] /= rise[i]
    for i in range(k, d - 1):
        y[i + 1] /= fall[i]
    # only the direction matters: a pivot of zero stands for a small one
    least = EPS * max(np.abs(rise).max(initial=0.0), np.abs(fall).max(initial=0.0), EPS)
    y[k] /= gamma[k] if abs(gamma[k]) > least * EPS else least * EPS
    for i in range(k - 1, -1, -1):
        y[i] -= lower[i] * y[i + 1]
    for i in range(k, d - 1):
        y[i + 1] -= upper[i] * y[i]
    return y


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors, one column per value (falling), of an unreduced bidiagonal block."""
    d = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)) or 1.0
    diagonal, above, squares = diagonal / scale, above / scale, (values / scale) ** 2
    out = np.zeros((d, len(values)))
    seeded = np.random.default_rng(13)
    first = 0
    for j in range(len(values)):
        if j and squares[j - 1] - squares[j] > CLUSTER * squares[j - 1]:
            first = j
        factors = twisted(diagonal, above, float(squares[j]))
        k = int(np.argmin(np.abs(factors[4])))
        near = out[:, first:j]
        z = _vector(factors, k)
        z /= np.sqrt(z @ z)
        if near.shape[1] or (j + 1 < len(values) and squares[j] - squares[j + 1] <= CLUSTER * squares[j]):
            # near values: some steps with the same factors, each cleared of the cluster's other directions
            z = z - near @ (near.T @ z)
            if np.sqrt(z @ z) < 0.5:
                z = seeded.standard_normal(d)
            for _ in range(4):
                z = z - near @ (near.T @ z)
                z = z / np.sqrt(z @ z)
                z = _solved(factors, k, z)
                z = z / np.abs(z).max()
            for _ in range(2):
                z = z - near @ (near.T @ z)
                z = z / np.sqrt(z @ z)
        out[:, j] = z
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of R, falling, and their right vectors as columns; zero values have none."""
    diagonal, above, turn = bidiagonal(r)
    found = []
    for a, b in split(diagonal, above):
        if b > a:
            found += [(v, a, b) for v in dqds(diagonal[a:b], above[a : b - 1])]
    found.sort(key=lambda f: -f[0])
    top = found[0][0] if found else 0.0
    found = [f for f in found if f[0] > EPS * len(diagonal) * top][:most]
    values = np.array([f[0] for f in found])
    vectors = np.zeros((len(diagonal), len(found)))
    for a, b in {(a, b) for _, a, b in found}:
        own = [j for j, f in enumerate(found) if f[1:] == (a, b)]
        vectors[a:b, own] = directions(diagonal[a:b], above[a : b - 1], values[own])
    return values, turn @ vectors


# --- the operator ------------------------------------------------------------------


def identity_error(fit: DataFrame, n: int, s: list[int], project: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened fit list departs from the identity."""

    def step(state, x):
        own = centred(x, n, s)[1] @ project
        mean = own.mean(axis=0)
        now = (len(own), mean, (own - mean).T @ (own - mean))
        return merge(state, now) if state else now

    def merge(a, b):
        n_both, apart = a[0] + b[0], b[1] - a[1]
        return n_both, a[1] + apart * (b[0] / n_both), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n_both)

    count, _, products = folded(fit, step, merge)
    return float(np.abs(products / count - np.eye(project.shape[1])).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, dims: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialise(whole_vectors(vectors, dims), "whole")
    fit = materialise(rows.select("x").distinct(), "fit-list")
    n, s = sums(fit)
    values = np.empty(0)
    if n and s:
        r = triangle(fit, n, s)
        values, turned = right_singular(r, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    explained = values**2 / float((r * r).sum())
    project = turned * (math.sqrt(n) / values)
    error = identity_error(fit, n, s, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for part, x in matrices(batches):
            exact, own = centred(x, n, s)
            reach = int(np.abs(exact).max())
            squares = exact if reach * reach * max(1, x.shape[1]) < 1 << 63 else exact.astype(object)
            deviation = (squares * squares).sum(axis=1)
            again = np.repeat(np.arange(len(x)), k)
            columns = [
                part.column("vec_id").take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(again), n, np.int64)),
                pa.array([int(v) if v < 1 << 63 else None for v in deviation], pa.int64()).take(pa.array(again)),
                pa.array((own @ project).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(again), error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    ready_workers(rows.sparkSession)
    return rows.mapInArrow(run, schema)
