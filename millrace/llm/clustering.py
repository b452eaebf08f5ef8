"""Centroid clustering in exact integers, with a pivot table in place of most distances.

Every vector's distances to a few fixed pivots are stored once. For a centroid c and any pivot p,
|d(x, p) - d(c, p)| is at most d(x, c), so in each round the pivots give a lower bound for each
centroid, and only centroids whose bound doesn't exceed a distance known already get an exact
distance. Bounds are floats and made smaller by more than their rounding, so no centroid that
could win or tie is passed over; distances, sums and centroids are integers throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Components up to this size can be squared and summed over 1024 dimensions in 64 bits.
_SMALL = 1 << 25
_LIMB = 48


def scaled(vector: list[float], dimensions: int, scale: int = 1024) -> np.ndarray | None:
    """floor(scale * x) of each component: int64, or Python's integers where they are large.

    None for vectors that take no part: other lengths, null or non-finite components, or such as
    exceed the double range once scaled.
    """
    if vector is None or len(vector) != dimensions or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(np.asarray(vector, np.float64) * scale)
    if not np.isfinite(x).all():
        return None
    if np.abs(x).max(initial=0) < _SMALL:
        return x.astype(np.int64)
    return np.array([int(v) for v in x], object)


def packed(v: np.ndarray) -> bytes:
    """After a mark, small vectors as 32-bit integers, large ones as decimal numbers."""
    return b"s" + v.astype("<i4").tobytes() if v.dtype != object else b"L" + ",".join(map(str, v)).encode()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i4", offset=1).astype(np.int64) if b[:1] == b"s" else np.array([int(x) for x in b[1:].split(b",")], object)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = a.astype(object) - b if object in (a.dtype, b.dtype) else a - b
    return (d * d).sum(axis=-1)


def _root(square: int) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


def lengths(sq: np.ndarray) -> np.ndarray:
    return np.array([_root(int(d)) for d in sq]) if sq.dtype == object else np.sqrt(sq)


def choose_pivots(sample: list[np.ndarray], count: int) -> list[np.ndarray]:
    """The vectors of a sample that lie farthest from those chosen before, by their summed distances."""
    if not sample:
        return []
    x = np.stack([v.astype(np.float64) for v in sample])
    chosen, total = [0], np.zeros(len(x))
    while len(chosen) < min(count, len(x)):
        total += np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return [sample[k] for k in chosen]


def assign(x: np.ndarray, to_pivots: np.ndarray, centroids: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances that took."""
    c = np.stack(centroids)
    kind = object if x.dtype == object or c.dtype == object else np.int64
    c = c.astype(kind)
    centre = np.array([[_root(int(squares(q, p))) for p in pivots] for q in centroids])
    low = np.zeros((len(x), len(c)))
    with np.errstate(invalid="ignore"):
        for p in range(len(pivots)):
            np.maximum(low, np.abs(to_pivots[:, p, None] - centre[None, :, p]), out=low)
        low = low * (1 - 1e-9) - 1e-9 * np.maximum(to_pivots.max(axis=1), centre.max())[:, None]
    low[~np.isfinite(low)] = 0  # beyond the range of doubles the pivots say nothing
    best, cluster, taken = np.full(len(x), -1, kind), np.full(len(x), -1), 0
    rows = np.arange(len(x))
    order = np.argsort(low, axis=1, kind="stable")
    for k in range(len(c)):  # each row's centroids by their bounds, least first
        at = order[:, k]
        near = np.ones(len(x), bool) if k == 0 else low[rows, at] <= lengths(best)
        if not near.any():
            break  # later bounds are greater still
        d = squares(x[near], c[at[near]])
        taken += int(near.sum())
        was, who = best[near], cluster[near]
        better = (who < 0) | (d < was) | ((d == was) & (at[near] < who))
        best[near], cluster[near] = np.where(better, d, was), np.where(better, at[near], who)
    return cluster, best, taken


def _blocks(packed_: list[bytes], rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of some rows at a time, small and large vectors apart."""
    small = np.array([x[:1] == b"s" for x in packed_], bool)
    for kind in (True, False):
        places = np.flatnonzero(small == kind)
        for k in range(0, len(places), rows):
            at = places[k : k + rows]
            yield at, np.stack([unpacked(packed_[i]) for i in at])


def _distances(b: dict, at: np.ndarray) -> np.ndarray:
    return np.stack([np.frombuffer(b["pivots"][i], "<f8") for i in at])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value in parts of 48 bits that sums over any number of tasks can't overflow; the last has the sign."""
    k = 0
    while not -(1 << _LIMB) < value < 1 << _LIMB:
        yield k, value & (1 << _LIMB) - 1
        value >>= _LIMB
        k += 1
    yield k, value


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int = 3, pivots: int = 8, sample_rows: int = 512
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly `dimensions` components, none null or non-finite; components
    become floor(1024 * x). Centroids start as the k vectors of the least SHA-256 of
    `seed:vec_id` (ties, and rows without a vec_id, which come last: by components). Each round
    assigns every vector to the nearest centroid (ties: the smaller number) and replaces each
    centroid that has vectors by their exact mean, rounded down; then all are assigned once more.

    Pivots are chosen among the sample_rows vectors of least hash; they only decide how many
    distances are computed. What a task hands on is one sum for each centroid and component; the
    driver holds the k centroids. Repeated rows are vectors of their own; with fewer than k kept
    vectors there are as many centroids as vectors; an empty table gives an empty result; other
    columns are ignored. Squared distances or sums beyond the range of longs are null. Vectors
    whose scaled components exceed the double range count as non-finite.
    """

    def keep(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = [(i, scaled(v, dimensions)) for i, v in zip(b["vec_id"], b["embedding"], strict=True)]
            got = [(i, v) for i, v in got if v is not None]
            yield {"vec_id": [i for i, _ in got], "x": [packed(v) for _, v in got]}

    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    kept = map_batches(columns, keep, "vec_id long, x binary")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = kept.withColumn("h", name).orderBy(F.col("h").asc_nulls_last(), "x").limit(max(k, sample_rows)).collect()  # a bounded sample
    sample = [unpacked(bytes(r.x)) for r in least]
    centroids, fixed = sample[:k], choose_pivots(sample, pivots)

    def measure(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            table = [None] * len(b["x"])
            for at, x in _blocks(b["x"]):
                far = np.stack([lengths(squares(x, p)) for p in fixed], axis=1)
                for k, row in zip(at, far, strict=True):
                    table[k] = row.astype("<f8").tobytes()
            yield {**b, "pivots": table}

    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    rows = materialize(map_batches(kept, measure, "vec_id long, x binary, pivots binary"))
    for _ in range(rounds):
        centroids = _means(rows, centroids, fixed)
    now = centroids

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            group, far = np.zeros(len(b["x"]), np.int32), np.zeros(len(b["x"]), object)
            for at, x in _blocks(b["x"]):
                group[at], far[at], _ = assign(x, _distances(b, at), now, fixed)
            yield {"vec_id": b["vec_id"], "cluster": group, "distance": [str(d) for d in far]}

    placed = materialize(map_batches(rows, place, "vec_id long, cluster int, distance string"))
    return _with_inertia(placed, now)


def _means(rows: DataFrame, centroids: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The centroids after one round."""
    size, count = len(centroids[0]), len(centroids)

    def sums(batches: Iterator[dict]) -> Iterator[dict]:
        total, n = np.zeros((count, size), object), np.zeros(count, np.int64)
        for b in batches:
            for at, x in _blocks(b["x"]):
                group, _, _ = assign(x, _distances(b, at), centroids, pivots)
                for c in np.unique(group):
                    total[c] += x[group == c].sum(axis=0)
                    n[c] += (group == c).sum()
        out: dict = {k: [] for k in ("cluster", "i", "limb", "value")}
        for c in np.flatnonzero(n):
            for i, value in enumerate([*total[c], n[c]]):  # the number of vectors stands last
                for limb, part in _limbs(int(value)):
                    for k, v in zip(out, (c, i, limb, part), strict=True):
                        out[k].append(v)
        yield out

    parts = map_batches(rows, sums, "cluster int, i int, limb int, value long")
    parts = parts.groupBy("cluster", "i", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    total: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # k x dimensions sums
        total[r.cluster, r.i] = total.get((r.cluster, r.i), 0) + (int(r.value) << _LIMB * r.limb)
    new = []
    for c, old in enumerate(centroids):
        n = total.get((c, size), 0)
        mean = [total[c, i] // n for i in range(size)] if n else [int(x) for x in old]
        small = max(map(abs, mean), default=0) < _SMALL
        new.append(np.array(mean, np.int64 if small else object))
    return new


def _with_inertia(placed: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """Adds the sums of distances over each cluster and over all, and the digest of the centroid."""
    # sums stay exact up to 38 digits, beyond that they are null
    exact = F.expr("try_cast(distance AS DECIMAL(38,0))")
    per = placed.groupBy("cluster").agg(F.try_sum(exact).alias("sum"), F.count("*").alias("n"), F.count(exact).alias("known"))
    per = {r.cluster: int(r["sum"]) if r["sum"] is not None and r.n == r.known else None for r in per.collect()}  # k rows
    whole = None if None in per.values() else sum(per.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda v: v if v is not None and v < 1 << 63 else None
    known = [(c, long(v), long(whole), digests[c]) for c, v in per.items()]
    known = placed.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = placed.select("vec_id", "cluster", F.expr("try_cast(distance AS BIGINT)").alias("distance"))
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
