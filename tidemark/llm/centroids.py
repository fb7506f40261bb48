"""Centroid clustering by equal-average equal-variance search, in whole numbers.

A vector is kept if it has exactly `dims` components, none null or non-finite; component x becomes floor(scale * x). For a
vector and a centroid with sums S and s of their components and deviations V and v (the root of the summed squared distances
from the own mean), the squared distance is at least (S - s)^2 / dims + (V - v)^2. The centroids are sorted by their sums, and
so by their means; a vector looks at them outward from its own sum, nearer one first. Once the first term alone passes the best
distance, so does every centroid farther out on both sides, and the search ends; a centroid whose both terms pass it is skipped.
Both tests are made in doubles with room for their rounding; what is left gets its distance in 64-bit integers, so that the
result is that of a full search, ties going to the smaller number.

Each round is one pass over the vectors: tasks sum the vectors of each centroid, the sums (one row a centroid and task) are added
up by Spark as decimals, and the driver gets one row a centroid. Nothing is kept between rounds but the centroids.

Seeds are the kept vectors with the least sha256 of `<salt>:<id>`, of equal hashes the least by components; a vector with a null
id is no seed but is assigned. Fewer kept vectors than seeds give as many centroids as there are; none gives no rows. Repeated
rows count each. Components beyond 2^27 after scaling raise, as distances could pass 64 bits. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import only, stored

#: The largest component, after scaling, whose squared distances surely fit 64 bits in up to 64 dimensions.
LARGEST = 1 << 27
#: Vectors searched at once: what a task holds for them is a few arrays of that many rows.
SLICE = 1 << 14


def whole(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept rows of a list column, and their components as integers (kept rows x dims)."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    starts = np.cumsum(np.where(sizes < 0, 0, sizes)) - np.where(sizes < 0, 0, sizes)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    fit = np.flatnonzero(sizes == dims)
    rows = values[starts[fit][:, None] + np.arange(dims)] if len(fit) else np.zeros((0, dims))
    good = np.isfinite(rows).all(axis=1)
    scaled = np.floor(scale * rows[good])
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling")
    return fit[good], scaled.astype(np.int64)


class Searcher:
    """Nearest centroid of many vectors at a time."""

    def __init__(self, centroids: list[list[int]]) -> None:
        c = np.array(centroids, np.int64)
        sums = c.sum(axis=1)
        self.order = np.lexsort((np.arange(len(c)), sums))  # by mean
        self.c, self.sums, self.dims = c[self.order], sums[self.order], c.shape[1]
        self.dev = deviation(self.c)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: the number of its centroid, the squared distance, and of how many centroids the distance was worked out."""
        n, k, sums, dev = len(v), len(self.c), v.sum(axis=1), deviation(v)
        best, which, tried = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64), np.zeros(n, np.int32)
        right = np.searchsorted(self.sums, sums)
        left, live = right - 1, np.arange(n)
        while len(live):
            lo, hi, s = left[live], right[live], sums[live]
            gap_lo = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            gap_hi = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, np.iinfo(np.int64).max)
            go_left = gap_lo <= gap_hi
            at, gap = np.where(go_left, lo, hi), np.minimum(gap_lo, gap_hi)
            over = (gap == np.iinfo(np.int64).max) | (gap.astype(np.float64) ** 2 * (1 - 1e-12) > best[live].astype(np.float64) * self.dims)
            live, at, gap, go_left = live[~over], at[~over], gap[~over], go_left[~over]
            left[live[go_left]] -= 1
            right[live[~go_left]] += 1
            bound = gap.astype(np.float64) ** 2 / self.dims + (dev[live] - self.dev[at]) ** 2
            near = bound * (1 - 1e-9) - 1e-3 * (dev[live] + 1) <= best[live]
            rows, at = live[near], at[near]
            diff = v[rows] - self.c[at]
            d, number = np.einsum("ij,ij->i", diff, diff), self.order[at]
            tried[rows] += 1
            better = (d < best[rows]) | ((d == best[rows]) & (number < which[rows]))
            best[rows[better]], which[rows[better]] = d[better], number[better]
        return which, best, tried


def deviation(v: np.ndarray) -> np.ndarray:
    """Root of the summed squared distances of the components from their mean."""
    x = v.astype(np.float64)
    return np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def _slices(batches: Iterator[pa.RecordBatch], dims: int, scale: int):
    """Ids of kept rows and their components, a slice at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            b = batch.slice(lo, SLICE)
            at, v = whole(b.column(1), dims, scale)
            if len(at):
                yield b.column(0).take(pa.array(at)), v


def seeds(vectors: DataFrame, k: int, salt: str, dims: int, scale: int) -> list[list[int]]:
    """The components of the k kept vectors with the least hashes."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("id").isNotNull() & (F.size("v") == dims) & finite)
    parts = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    first = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"), parts.alias("v"))
    return [list(r.v) for r in first.orderBy("h", "v").limit(k).collect()]


def _summed(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors: how many, and the exact sums of their components."""

    def run(batches):
        search, n, total = Searcher(centroids), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, v in _slices(batches, dims, scale):
            which, _, _ = search.nearest(v)
            by = np.argsort(which, kind="stable")
            own, first, count = np.unique(which[by], return_index=True, return_counts=True)
            n[own] += count
            total[own] += np.add.reduceat(v[by], first)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster long, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    added = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("cluster", "i").collect():  # k x dims rows
        found.setdefault(r.cluster, (r.n, []))[1].append(int(r.x))
    return found


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", dims: int = 64, scale: int = 1024, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """id, cluster, distance, n_tried of every kept vector (stored), and the final centroids."""
    rows = only(vectors, id_column, column).select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    centroids = seeds(rows, k, salt, dims, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _summed(rows, centroids, dims, scale).items():
            centroids[c] = [s // n for s in sums]  # floors, also below zero

    def run(batches):
        search = Searcher(centroids)
        for ids, v in _slices(batches, dims, scale):
            which, distance, tried = search.nearest(v)
            yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(distance), pa.array(tried)], names=["id", "cluster", "distance", "n_tried"])

    found = rows if centroids else rows.where("false")
    return stored(found.mapInArrow(run, "id long, cluster int, distance long, n_tried int")), centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256. One row a centroid passes the driver."""
    sums = {r.cluster: int(r.x) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.array(*(F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids)))) if centroids else F.array(F.lit(0).cast("long"))
    named = F.array(*map(F.lit, hashed)) if centroids else F.array(F.lit(""))
    return found.select("*", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(named, F.col("cluster")).alias("centroid_sha256"))
