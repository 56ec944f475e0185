"""Exact k-means over whole-number vectors by Shallot search.

Every vector remembers its centroid, the second nearest one, an upper bound of the distance to
the first and a lower bound of that to all others. Bounds follow the centroids as they move; a
vector whose bounds still part them is not looked at. Another is compared with its two remembered
centroids, starts from the closer one and scans that one's neighbours by distance: a centroid is
of interest only within the distances to the start and to the second nearest so far, a ball
that shrinks with each find. Bounds are real numbers, widened for rounding; which centroid
is nearer is decided by whole-number squared distances alone.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import buffers, free_name, ints, mapped, saved

#: Largest size of a component, so that squared distances fit into 64 bits.
LARGEST = 1 << 27
#: Vectors that a task looks at at once.
ROWS = 4096
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


@dataclass
class Bounds:
    """For each vector: the nearest centroid, the second nearest, and the bounds of their distances."""
    near: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


@dataclass
class Centroids:
    """Whole-number centroids, how far each one moved, and its neighbours by distance."""
    points: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.points)
        self.gap = np.array([np.sqrt(squared(self.points, p)) for p in self.points]).reshape(k, k)
        np.fill_diagonal(self.gap, -1)  # a centroid is the first of its own row
        self.order = np.argsort(self.gap, axis=1, kind="stable")
        self.half = self.gap[np.arange(k), self.order[:, 1]] / 2 * _DOWN if k > 1 else np.full(k, np.inf)
        if k:
            first = int(self.moved.argmax())
            rest = np.delete(self.moved, first).max(initial=0)
            #: The farthest that any other centroid moved.
            self.others = np.where(np.arange(k) == first, rest, self.moved[first])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def scan_all(x: np.ndarray, c: Centroids) -> Bounds:
    """Without earlier bounds: every centroid."""
    table = np.stack([squared(x, p) for p in c.points], 1)
    at = np.arange(len(x))
    near = table.argmin(1)  # the smallest number of equal ones
    best = table[at, near]
    table[at, near] = np.iinfo(np.int64).max
    second = table.argmin(1)
    lower = np.sqrt(table[at, second]) if len(c.points) > 1 else np.full(len(x), np.inf)
    return Bounds(near, second, np.sqrt(best) * _UP, lower * _DOWN)


def search(x: np.ndarray, b: Bounds, c: Centroids) -> tuple[Bounds, int]:
    """The bounds after the centroids moved, and the number of squared distances that were computed."""
    near, second = b.near.copy(), b.second.copy()
    upper = (b.upper + c.moved[near]) * _UP
    lower = np.maximum(b.lower - c.others[near] * _UP, 0) * _DOWN
    rows = np.flatnonzero(upper >= np.maximum(lower, c.half[near]))
    count = len(rows)
    one = squared(x[rows], c.points[near[rows]])
    upper[rows] = np.sqrt(one) * _UP
    open_ = upper[rows] >= np.maximum(lower[rows], c.half[near[rows]])
    rows, one = rows[open_], one[open_]
    two = squared(x[rows], c.points[second[rows]])
    count += len(rows)
    closer = (two < one) | ((two == one) & (second[rows] < near[rows]))
    n1, n2 = np.where(closer, second[rows], near[rows]), np.where(closer, near[rows], second[rows])
    d1, d2 = np.where(closer, two, one), np.where(closer, one, two)
    start, radius, known = n1.copy(), np.sqrt(d1) * _UP, (n1.copy(), n2.copy())
    for s in np.unique(start).tolist():
        live = np.flatnonzero(start == s)
        for j in c.order[s, 1:].tolist():
            # |x - c_j| >= gap - |x - c_s|; beyond the second nearest so far it is of no interest
            live = live[c.gap[s, j] * _DOWN <= radius[live] + np.sqrt(d2[live]) * _UP]
            if not len(live):
                break
            new = live[(known[0][live] != j) & (known[1][live] != j)]
            d = squared(x[rows[new]], c.points[j])
            count += len(new)
            first = (d < d1[new]) | ((d == d1[new]) & (j < n1[new]))
            other = ~first & ((d < d2[new]) | ((d == d2[new]) & (j < n2[new])))
            to = new[first]
            d2[to], n2[to] = d1[to], n1[to]
            d1[to], n1[to] = d[first], j
            d2[new[other]], n2[new[other]] = d[other], j
    near[rows], second[rows] = n1, n2
    upper[rows], lower[rows] = np.sqrt(d1) * _UP, np.sqrt(d2) * _DOWN
    return Bounds(near, second, upper, lower), count


_STATE = "ints binary, near int, second int, upper double, lower double"
_BOUNDS = (("near", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()))


def _assigned(state: DataFrame, c: Centroids, id_kind: str) -> DataFrame:
    """One round: every vector of ``state`` with its new bounds."""
    shared, size = state.sparkSession.sparkContext.broadcast(c), c.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = buffers(batch.column("ints"))[0].view(np.int32).reshape(-1, size).astype(np.int64)
                if "near" in batch.schema.names:
                    old = Bounds(*(batch.column(n).to_numpy() for n, _ in _BOUNDS))
                    new, _ = search(x, old, shared.value)
                else:
                    new = scan_all(x, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("ints"), *(pa.array(getattr(new, n), k) for n, k in _BOUNDS)],
                    ["vec_id", "ints", *(n for n, _ in _BOUNDS)])

    return saved(mapped(state, run, f"vec_id {id_kind}, {_STATE}"), "bounds")


def _means(state: DataFrame, c: Centroids) -> np.ndarray:
    """Componentwise floors of the means of the clusters; an empty one keeps its centroid."""
    k, size = c.points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = buffers(batch.column("ints"))[0].view(np.int32).reshape(-1, size).astype(np.int64)
                near = batch.column("near").to_numpy()
                for j in np.unique(near).tolist():
                    total[j] += x[near == j].sum(0)
                count += np.bincount(near, minlength=k)
        if count.any():  # a task gives one row for a cluster, however many vectors it has
            yield pa.RecordBatch.from_arrays([ints(np.arange(k)), ints(count), *(ints(col) for col in total.T)],
                                             ["cluster", "k", *(f"s{i}" for i in range(size))])

    names = ["k", *(f"s{i}" for i in range(size))]
    sums = mapped(state.select("ints", "near"), run, "cluster long, " + ", ".join(f"{n} long" for n in names))
    points = c.points.copy()
    for r in sums.groupBy("cluster").agg(*(F.sum(n).alias(n) for n in names)).collect():  # one row a cluster
        if r["k"]:
            points[r["cluster"]] = [r[f"s{i}"] // r["k"] for i in range(size)]
    return points


def whole_vectors(table: DataFrame, size: int, scale: int, vec_id: str, vec: str) -> DataFrame:
    """``vec_id, ints``: the vectors of ``size`` finite components, each as ``floor(scale x)`` in 32 bits.

    Components beyond ``LARGEST`` are set to it, with their sign.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = np.clip(np.floor(values * float(scale)), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in whole], pa.binary())], ["vec_id", "ints"])

    given = table.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")).where(
        (F.size("vec") == size) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return mapped(given, run, f"vec_id {given.schema['vec_id'].dataType.simpleString()}, ints binary")


def shallot(table: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1,
            vec_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` for every kept vector, and the final centroids.

    Kept are vectors of exactly ``size`` components, none null or not finite; component x is the
    whole number ``floor(scale x)``, at most 2**27 in size. The first centroids are the ``k`` vectors whose id has
    the least SHA-256 of ``seed:id`` (null ids last, equal ones by their components; fewer vectors
    make fewer clusters). In each round vectors go to the nearest centroid by squared distance, the
    smallest number of equally near ones, and centroids become the floors of their means. After
    the last round vectors are assigned once more; ``distance`` is squared. Repeated rows count each, an
    empty table has no clusters, other columns are not read.
    """
    start = saved(whole_vectors(table, size, scale, vec_id, vec), "vectors")
    kind = start.schema["vec_id"].dataType.simpleString()
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = start.orderBy(hashed.asc_nulls_last(), "ints").limit(k).collect()  # k rows
    points = np.array([np.frombuffer(r.ints, np.int32) for r in first], np.int64).reshape(-1, size)
    state, centroids = start, Centroids(points, np.zeros(len(points)))
    if len(points):
        for _ in range(rounds):
            state = _assigned(state, centroids, kind)
            new = _means(state, centroids)
            centroids = Centroids(new, np.sqrt(squared(new, centroids.points)) * _UP)
        state = _assigned(state, centroids, kind)
    shared = start.sparkSession.sparkContext.broadcast(centroids.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = buffers(batch.column("ints"))[0].view(np.int32).reshape(-1, size).astype(np.int64)
            near = batch.column("near").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()),
                                              ints(squared(x, shared.value[near]))], ["vec_id", "cluster", "distance"])

    given = state if "near" in state.columns else state.withColumn("near", F.lit(None).cast("int"))
    return saved(mapped(given.select("vec_id", "ints", "near"), run, f"vec_id {kind}, cluster int, distance long"),
                 "clusters"), centroids.points


def with_inertia(found: DataFrame, points: np.ndarray) -> DataFrame:
    """``found`` with ``cluster_inertia``, ``inertia`` (sums of distances) and ``centroid_sha256``."""
    spark, key = found.sparkSession, free_name(found, "centroid")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest())
            for j, p in enumerate(points.tolist())]
    each = spark.createDataFrame(rows, f"{key} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), F.col("cluster") == F.col(key)).drop(key)  # a row for each cluster
