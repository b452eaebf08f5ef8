"""Groups of texts that verified links connect, from buckets of candidates.

Buckets hold nodes that may be alike; a link is a pair of a bucket whose Jaccard similarity is the
threshold or more. Only groups are asked for, so a pair within one group needs no look: in each
round every bucket's members meet two leads, others each round, and what links joins groups. This
is linear in the buckets and settles all but nodes with few links. Then, exactly, each member
outside the group that most of its bucket belongs to meets all members of other groups, unless
bounds on what two can share rule a link out: the shingles that each has alone, their sketches,
and which shingles of the bucket's main node each has. No link between groups is lost, and no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, counted, map_batches, release

#: A sketch holds four bits of each of 128 lanes, as eight longs.
SKETCH = [f"k{i}" for i in range(8)]
_LANES = 128


def sketch(signature: np.ndarray) -> np.ndarray:
    """Eight longs: the top four bits of each lane, mixed."""
    x = (signature * np.uint16(0x9E37) >> np.uint16(12)).astype(np.uint8)
    return (x[0::2] | x[1::2] << 4).view("<i8")


def _agreeing(a: str, b: str) -> Column:
    """How many lanes of two sketches agree."""
    ones = F.lit(0x1111111111111111)
    differ = []
    for k in SKETCH:
        x = F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ.append(F.bit_count(x.bitwiseAND(ones)))
    return F.lit(_LANES) - sum(differ[1:], differ[0])


def least_agreeing(threshold: float, deviations: float = 5) -> float:
    """Lanes that agree, `deviations` standard deviations below what a pair at the threshold has on average."""
    p = threshold + (1 - threshold) / 16
    return _LANES * p - deviations * (_LANES * p * (1 - p)) ** 0.5


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def linked(met: DataFrame, sets: DataFrame, threshold: float, rounds: int = 3) -> DataFrame:
    """node and root of the nodes that a link connects with others.

    met: key and node, each pair once. sets: node, shingles (distinct) and the columns of SKETCH.
    Pairs are ruled out by their sketches five standard deviations below the threshold, which a
    pair at the threshold falls under once in some three million.
    """
    close = _agreeing("p", "q") >= least_agreeing(threshold)
    of, members = counted(met.join(sets.select("node", *SKETCH), "node").select("key", "node", F.col("node").alias("root"), *SKETCH))

    def verified(pairs: DataFrame) -> DataFrame:
        """a and b, the roots of the pairs x and y that are alike."""
        p, a, b = pairs.alias("p"), sets.alias("a"), sets.alias("b")
        both = p.join(a, F.col("p.x") == F.col("a.node")).join(b, F.col("p.y") == F.col("b.node"))
        return both.where(jaccard(F.col("a.shingles"), F.col("b.shingles")) >= threshold).select("p.a", "p.b")

    def moved(of: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
        """The members with the roots that the links give them, and the number of links."""
        links, n = counted(links.distinct())
        if not n:
            return of, 0
        found = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("new"))
        return counted(of.join(found, "root", "left").select("key", "node", F.coalesce("new", "root").alias("root"), *SKETCH))[0], n

    member = F.struct("node", "root", *SKETCH)
    for k in range(rounds):
        order = F.xxhash64("node", F.lit(k))
        leads = of.groupBy("key").agg(F.min_by(member, order).alias("p"), F.max_by(member, order).alias("r"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        leads = leads.where("lo < hi").select("key", F.explode(F.array("p", "r")).alias("p"))
        pairs = of.alias("q").join(leads.alias("l"), "key").select("q.*", "l.p").alias("q").where((F.col("q.root") != F.col("q.p.root")) & _lead_close(threshold))
        pairs = pairs.select(F.col("node").alias("x"), F.col("p.node").alias("y"), F.col("root").alias("a"), F.col("p.root").alias("b")).distinct()
        of, n = moved(of, verified(pairs))
        del leads, pairs
        release(met.sparkSession)
        if 1000 * n <= members:  # another round would join little; below nothing is missed
            break

    main = of.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    left, _ = counted(of.join(main.where("roots > 1").select("key", "main"), "key"))
    del main
    release(met.sparkSession)
    sizes = _shared(left.select("node").union(left.select("main")).distinct(), sets)
    left = left.join(sizes, "node").where(F.col("common") >= threshold * F.col("size"))
    left, _ = counted(left.join(_by_main(left.select("node", "main").distinct(), sets), ["node", "main"]).withColumn("rest", F.col("common") - F.col("inside")))
    del sizes
    release(met.sparkSession)
    keys = left.groupBy("node").agg(F.collect_set("key").alias("keys"))  # as many as there are bands
    left = left.join(keys, "node")
    p, q = left.where("root <> main").alias("p"), left.alias("q")
    # two members outside the main group meet once, and every pair in one bucket only
    once = (F.col("q.root") == F.col("q.main")) | (F.col("p.node") < F.col("q.node"))
    first = F.array_min(F.array_intersect("p.keys", "q.keys")) == F.col("p.key")
    # what two nodes share is counted within the main group's node; outside it is no more than either shares with anyone
    bits = F.zip_with("p.bits", "q.bits", lambda x, y: F.bit_count(x.bitwiseAND(y)))
    most = F.aggregate(bits, F.lit(0), lambda s, x: s + x) + F.least("p.rest", "q.rest")
    least = F.least("p.common", "q.common")
    could = lambda m: m >= threshold * (F.col("p.size") + F.col("q.size") - m)
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.root") != F.col("q.root")) & once & could(least) & close & could(most) & first)
    pairs = pairs.select(F.col("p.node").alias("x"), F.col("q.node").alias("y"), F.col("p.root").alias("a"), F.col("q.root").alias("b")).distinct()
    return moved(of, verified(pairs))[0].select("node", "root").distinct()


def _shared(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, size and common of the nodes: their shingles, and those that some other of the nodes has too."""
    own = sets.join(nodes, "node").select("node", F.size("shingles").alias("size"), "shingles")
    tokens = own.select("node", F.explode("shingles").alias("token"))
    alone = tokens.groupBy("token").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    return own.join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _by_main(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, main, bits (which of main's shingles the node has, 64 to a long) and inside (how many)."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            bits, inside = [], []
            for own, lead in zip(b["shingles"], b["lead"], strict=True):
                hit = np.isin(np.array(lead, np.int32), np.array(own, np.int32), assume_unique=True)
                inside.append(int(hit.sum()))
                bits.append(np.packbits(np.pad(hit, (0, -len(hit) % 64)), bitorder="little").view("<i8"))
            yield {"node": b["node"], "main": b["main"], "bits": bits, "inside": inside}

    own = pairs.join(sets.select("node", "shingles"), "node")
    rows = own.join(sets.select(F.col("node").alias("main"), F.col("shingles").alias("lead")), "main")
    return map_batches(rows.select("node", "main", "shingles", "lead"), each, "node long, main long, bits array<long>, inside int")


def _lead_close(threshold: float) -> Column:
    return _agreeing("q", "q.p") >= least_agreeing(threshold)
