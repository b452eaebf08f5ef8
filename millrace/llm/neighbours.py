"""Nearest neighbours by collision counting over single projections.

Every vector (scaled to length one, so that the nearest by distance is the nearest by cosine)
is projected on `projections` random lines, and each line's values are kept as a sorted array.
A query opens a window around its own value on every line; virtual rehashing widens all windows
together by a constant factor from level to level. A vector that falls into the windows of at
least `threshold` of the lines is verified by its exact cosine. A query stops when its k-th best
lies well within the windows or enough vectors have been verified.

Spark deals the vectors out in segments of bounded size and sends every query to every segment. A
task indexes each of its segments once and answers the queries as they stream by; it passes on
each query's best k. Nothing goes through the driver but a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PROJECTIONS, THRESHOLD = 96, 0.63
#: Half width of the windows at the first level and its growth from level to level.
FIRST, GROWTH = 0.3, 2.0
#: Share of a segment whose verification ends a query on it.
SHARE = 0.05


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its greatest component near one: the same
    direction to the last bit, without overflow or underflow of the norm."""
    _, exponent = np.frexp(np.abs(x).max(axis=-1))
    return np.ldexp(x, -exponent[..., None])


class Segment:
    """Sorted projections of some vectors (finite, none zero, scaled)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 7):
        self.ids, self.x = ids, x
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.unit = x / self.norm[:, None]
        self.lines = np.random.default_rng(seed).standard_normal((x.shape[1], PROJECTIONS))
        values = self.unit @ self.lines
        order = np.argsort(values, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        # one array for all lines: each line's values shifted past those of the line before it
        self.shift = np.arange(PROJECTIONS) * (4 * np.abs(values).max() + 8)
        self.sorted = (np.take_along_axis(values, order, axis=0) + self.shift).T.ravel()

    def search(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The best k ids of the vectors verified, as (-cosine, id), best first; own_id takes no part."""
        n = len(self.ids)
        q_norm = np.sqrt((q * q).sum())
        unit = q / q_norm
        widest = self.shift[1] / 2
        at = np.clip(unit @ self.lines, -widest / 2, widest / 2) + self.shift
        starts = np.arange(PROJECTIONS) * n
        counts, cosine = np.zeros(n, np.int16), np.full(n, -2.0)
        open_ = self.ids != own_id  # not yet verified
        others = int(open_.sum())
        lo = hi = np.searchsorted(self.sorted, at) - starts
        half, rows = FIRST, np.empty(0, np.int64)
        while len(rows) < others:
            if half >= widest:  # the windows cover every line
                met = np.flatnonzero(open_)
            else:
                new_lo = np.searchsorted(self.sorted, at - half, "left") - starts
                new_hi = np.searchsorted(self.sorted, at + half, "right") - starts
                for line, a, b, c, d in zip(self.order, new_lo.tolist(), lo.tolist(), hi.tolist(), new_hi.tolist(), strict=True):
                    counts[line[a:b]] += 1
                    counts[line[c:d]] += 1
                lo, hi = new_lo, new_hi
                met = np.flatnonzero(open_ & (counts >= THRESHOLD * PROJECTIONS))
            open_[met] = False
            cosine[met] = self.unit[met] @ unit
            rows = np.concatenate([rows, met])
            kth = self._kth(rows, cosine[rows], k)
            # nearer ones than the k-th would nearly all have met the threshold by now
            if kth is not None and (len(rows) >= SHARE * n or np.sqrt(max(0.0, 2 - 2 * kth)) <= half / 2):
                break
            half *= GROWTH
        kth = self._kth(rows, cosine[rows], k)
        if kth is not None:  # all that could be among the best k after exact scoring
            rows = rows[cosine[rows] >= kth - 1e-9]
        ids, score = self.ids[rows], (self.x[rows] * q).sum(axis=1) / (self.norm[rows] * q_norm)
        best = np.lexsort((ids, -score))
        # of rows that repeat an id the best counts
        _, first = np.unique(ids[best], return_index=True)
        best = best[np.sort(first)[:k]]
        return [(-float(score[i]), int(ids[i])) for i in best]

    def _kth(self, rows: np.ndarray, cosine: np.ndarray, k: int) -> float | None:
        """The k-th best cosine of different ids, if there are as many."""
        m = 4 * k
        while len(rows) >= k:
            top = np.argpartition(-cosine, m - 1)[:m] if m < len(rows) else np.arange(len(rows))
            top = top[np.argsort(-cosine[top], kind="stable")]
            _, first = np.unique(self.ids[rows[top]], return_index=True)
            if len(first) >= k:
                return float(cosine[top[np.sort(first)[k - 1]]])
            if len(top) == len(rows):
                return None
            m *= 4
        return None


def usable(embedding: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda v: v != 0)


def segment_rows(n: int) -> int:
    """Vectors of a segment: a 64th of all, between some 16 thousand and 262 thousand.

    Every query goes to every segment, so fewer and larger ones send less; an index of the largest
    size takes some 500 MB at 64 dimensions.
    """
    return min(max(n // 64, 1 << 14), 1 << 18)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, segment: int | None = None, id_col: str = "vec_id"
) -> DataFrame:
    """Each query's k nearest vectors found, other than its own: query_id, rank, vec_id, score.

    score is the cosine in double precision on the vectors as they are; ties go to the smaller
    vec_id. Vectors that are null, empty, zero or not finite take no part, and neither do rows
    without an id or of another length than the query; very great and very small components do.
    Rows that repeat an id count once (the best); of queries that repeat an id the least vector is
    asked for; an empty table, or one without usable queries, gives an empty result; other columns
    are ignored. segment: vectors indexed together (see segment_rows); block: queries whose hits a
    task gathers before it passes them on.
    """

    def clean(df: DataFrame) -> DataFrame:
        exact = "array<float>" if "array<float>" in df.select("embedding").schema[0].dataType.simpleString() else "array<double>"
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast(exact).alias("v"))
        return df.where(F.col("id").isNotNull() & usable(F.col("v")))

    rows = clean(vectors).dropDuplicates(["id", "v"])
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    n = vectors.count()
    segments = max(1, -(-n // (segment or segment_rows(n))))
    # by the whole row, so that an id that many rows share spreads out
    placed = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(segments)).cast("int").alias("s"), F.lit(0).alias("asks"), "id", F.col("v").cast("array<double>"))
    every = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("s")
    sent = asked.select(every, F.lit(1).alias("asks"), "id", F.col("v").cast("array<double>"))
    tasks = min(segments, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 16)
    dealt = placed.union(sent).repartition(tasks, "s").sortWithinPartitions("s", "asks")
    found = dealt.mapInArrow(_searcher(k, block), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, block: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # the segment being read
        parts: dict[int, tuple[list, list]] = {}  # its vectors, by their length
        indexes: dict[int, Segment] = {}  # once its first query has come
        out: list[tuple[int, int, float]] = []
        asked = 0

        def passed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)
            out.clear()
            return batch

        for b in batches:
            s, asks, ids, v = (b.column(c) for c in ("s", "asks", "id", "v"))
            s, asks, ids, lengths = s.to_numpy(), asks.to_numpy(), ids.to_numpy(), v.value_lengths().to_numpy()
            values, starts = v.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)]
            cuts = np.flatnonzero((s[1:] != s[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(s)], strict=True):
                if lo == hi:
                    continue
                if s[lo] != now:
                    now, parts, indexes = s[lo], {}, {}
                if not asks[lo]:
                    for dim in np.unique(lengths[lo:hi]):
                        at = lo + np.flatnonzero(lengths[lo:hi] == dim)
                        got = parts.setdefault(int(dim), ([], []))
                        got[0].append(ids[at])
                        got[1].append(scaled(values[starts[at][:, None] + np.arange(dim)]))
                    continue
                if parts:
                    indexes = {dim: Segment(np.concatenate(i), np.concatenate(x)) for dim, (i, x) in parts.items()}
                    parts = {}
                for i in range(lo, hi):
                    index = indexes.get(int(lengths[i]))
                    if index is not None:
                        hits = index.search(int(ids[i]), scaled(values[starts[i] : starts[i + 1]]), k)
                        out += [(int(ids[i]), vec, -c) for c, vec in hits]
                    asked += 1
                    if asked % block == 0:
                        yield passed()
        yield passed()

    return run
