"""SimHash near-duplicates by generalised pigeonhole search.

The bits are parted into blocks, and the blocks into sets. A pair of fingerprints differing in at
most `radius` bits differs in at most so many blocks; there are so many blocks that some set holds
`taken` others, in which the pair is equal. So a key is the value of `taken` blocks of a set, every
fingerprint has one key for each such choice, as many whatever the table holds, and the join by
keys verifies each meeting. Correlated bits share a block.

Work is on distinct fingerprints, so copies cost nothing. Dense groups are first joined into
stars around bucket minima (linear in the rows), and the join by keys then only makes pairs
between different groups: where many fingerprints of a group share a key, they meet only those
of other groups. No group's pairs are ever listed, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import connected_components, counted, map_batches, materialize, member_filter, planned, release
from .links import linked

BITS = 64
#: Values of a part that the histograms tell apart (its first 16 bits), which bounds them.
HISTOGRAM_BITS = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [hash_of(joined, 42)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = [hash_of(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    lanes, chunks = np.uint64(0x0101010101010101), np.arange(0, len(h), 255)
    set_bits = np.empty((8, 8), np.int64)  # by byte, by bit in it
    for k in range(8):
        sums = np.add.reduceat(h >> np.uint64(k) & lanes, chunks)
        set_bits[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    over = set_bits.reshape(-1) * 2 > len(h)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def word_fingerprints(words: np.ndarray, count: int) -> list[int]:
    """SimHashes of a text's distinct words (their hashes), by as many independent mixings."""
    if not len(words):
        return [0] * count
    out = []
    for k in range(count):
        h = (words + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(h ^ h >> np.uint64(29)))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            u = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield {"doc_id": b["doc_id"], "fp": u.view(np.int64)}

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(columns, each, "doc_id long, fp long")


# -- partition and thresholds ----------------------------------------------------------------


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Equal groups of correlated bits, from the correlation of all bits over all fingerprints."""

    def products(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros((BITS + 1, BITS + 1))
        for b in batches:
            u = np.array(b["fp"], np.int64).view(np.uint8).reshape(-1, 8)
            x = np.hstack([np.unpackbits(u, axis=1, bitorder="little"), np.ones((len(u), 1), np.uint8)])
            x = x.astype(np.float64)
            total += x.T @ x
        yield {"i": np.arange(total.size), "x": total.ravel()}

    rows = map_batches(distinct.select("fp"), products, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    got = np.zeros((BITS + 1) ** 2)
    for r in rows.collect():  # 65 x 65 sums
        got[r.i] = r.x
    got = got.reshape(BITS + 1, BITS + 1)
    n = max(got[-1, -1], 1)
    mean = got[-1, :-1] / n
    cov = got[:-1, :-1] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < width:
            nearest = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nearest)
            left.discard(nearest)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one group, gathered into the low bits of a long."""
    u, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(group):
        out |= (u >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def key_blocks(n: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """How many blocks the bits are parted into, and the blocks of each key, for n fingerprints that can link.

    With `taken` blocks to a key and blocks in `sets` sets, radius + (taken - 1) * sets + 1 blocks are enough:
    of those that radius bits leave alike, some set has `taken`. 9 keys of some 18 bits serve for radius 4
    up to tens of millions of fingerprints; only then are more and longer keys cheaper than the pairs to verify.
    """
    choices = []
    for taken, sets in ((2, 2), (3, 2), (3, 1)):
        blocks = radius + (taken - 1) * sets + 1
        ends = [blocks * k // sets for k in range(sets + 1)]
        keys = [c for at, end in zip(ends, ends[1:], strict=False) for c in combinations(range(at, end), taken)]
        choices.append((len(keys) * (1 + 0.01 * n / 2 ** (BITS * taken / blocks)), blocks, keys))
    return min(choices)[1:]


def thresholds(fp: np.ndarray, groups: list[list[int]], hist: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint and part, its threshold + 1 (0: the part isn't probed).

    Dynamic programming over the parts: the radius + 1 units go where probes and estimated
    candidates together are fewest. hist: how many fingerprints have each value of the first
    HISTOGRAM_BITS bits of each part. The search by key_blocks() has no thresholds and doesn't call it.
    """
    n, units, most = len(fp), radius + 1, min(radius + 1, 3)
    total = hist[0].sum()
    best = np.full((n, units + 1), np.inf)
    best[:, 0] = 0
    choice = []
    for g, h in zip(groups, hist, strict=True):
        width, seen = len(g), min(len(g), HISTOGRAM_BITS)
        v = part_values(fp, g[:HISTOGRAM_BITS])
        scale = 2.0 ** (seen - width)
        ball0 = h[v] * scale
        ball1 = ball0 * (1 + width - seen) + sum(h[v ^ (1 << k)] for k in range(seen)) * scale
        cost = np.zeros((n, most + 1))
        cost[:, 1] = 1 + 0.05 * ball0
        if most >= 2:
            cost[:, 2] = 1 + width + 0.05 * ball1
        if most >= 3:
            cost[:, 3] = 1 + width + comb(width, 2) + 0.05 * (ball1 + comb(width, 2) * total / 2.0**width)
        step, pick = np.full_like(best, np.inf), np.zeros((n, units + 1), np.int8)
        for u in range(most + 1):
            new = best[:, : units + 1 - u] + cost[:, u : u + 1]
            better = new < step[:, u:]
            step[:, u:] = np.where(better, new, step[:, u:])
            pick[:, u:][better] = u
        best = step
        choice.append(pick)
    out, left = np.zeros((n, len(groups)), np.int8), np.full(n, units)
    for i in range(len(groups) - 1, -1, -1):
        out[:, i] = choice[i][np.arange(n), left]
        left = left - out[:, i]
    return out


def _keys(nodes: DataFrame, groups: list[list[int]], keys: list[tuple[int, ...]]) -> DataFrame:
    """(part, key, fp, root): a row for each node and key, the bits of the key's blocks; part: which key, of which mixing."""
    masks = [sum(1 << bit for block in key for bit in groups[block]) for key in keys]
    signed = [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]
    part = lambda k: (F.col("mixing") * len(keys) + k).alias("part")
    each = F.array(*(F.struct(part(k), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)))
    return nodes.select(F.explode(each).alias("k"), "fp", "root").select("k.part", "k.key", "fp", "root")


def _stars(distinct: DataFrame, groups: list[list[int]], radius: int) -> DataFrame:
    """Links from fingerprints to the least and greatest that share half of the bits exactly."""
    quarters = [sum(groups, [])[k : k + BITS // 4] for k in range(0, BITS, BITS // 4)]
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("id", pa.int64())])

    def halves(batches):
        for b in batches:
            fp, mixing = b.column("fp").to_numpy(), b.column("mixing").to_numpy().astype(np.int64)
            v = [part_values(fp, q) for q in quarters]
            keys = [v[i] << 16 | v[j] | k << 40 | mixing << 44 for k, (i, j) in enumerate(combinations(range(4), 2))]
            columns = np.concatenate(keys), np.tile(fp, len(keys)), np.tile(b.column("id").to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=schema)

    rows = distinct.select("fp", "mixing", "id").mapInArrow(halves, "key long, fp long, id long")
    one = F.struct("fp", "id")
    hubs = rows.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.fp < hi.fp")
    near = lambda c: F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) <= radius
    met = rows.join(hubs, "key")
    ends = F.array(*(F.when(near(f"{e}.fp") & (F.col("id") != F.col(f"{e}.id")), F.col(f"{e}.id")) for e in ("lo", "hi")))
    return met.select(F.col("id").alias("a"), F.explode(F.array_compact(ends)).alias("b"))


def components(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """fp and root for distinct fingerprints: rows of a root are those reachable by links."""
    ids = distinct.select("fp", F.lit(0).alias("mixing"), F.col("fp").alias("id"))
    return roots_of(ids, radius).select(F.col("id").alias("fp"), "root")


def roots_of(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """id and root of distinct fingerprints (id, mixing, fp), of which those of one mixing can link."""
    spark = distinct.sparkSession
    counts = [r.n for r in distinct.groupBy("mixing").agg(F.count("*").alias("n")).collect()]  # a row for each mixing
    n = sum(counts)
    blocks, keys = key_blocks(max(counts, default=0), radius)
    with planned(spark, n):
        groups = bit_groups(distinct, blocks)
    with planned(spark, 6 * n):
        stars = connected_components(_stars(distinct, groups, radius))
    with planned(spark, n):
        # columns without nulls, known by no partitioning: else each use of the keys plans filters and a shuffle of its own
        rows = distinct.join(stars, distinct.id == stars.node, "left").withColumn("root", F.coalesce("root", "id"))
        nodes = materialize(rows.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("id", "fp", "mixing", "root"))))
    del stars
    release(spark)
    with planned(spark, len(keys) * n):
        index = _keys(nodes, groups, keys).repartition("part", "key")  # one shuffle, which all below read
        # a key that many fingerprints of one root share: they only meet those of other roots there
        of_root = F.count("*").over(W.partitionBy("part", "key", "root"))
        most = F.max(F.when(F.col("n") > 16, F.struct("n", "root"))).over(W.partitionBy("part", "key"))
        q = index.withColumn("n", of_root).withColumn("main", most["root"]).where("main is null or root <> main").alias("q")
        d = index.alias("d")
        once = F.coalesce(F.col("d.root") == F.col("q.main"), F.lit(False)) | (F.col("q.fp") < F.col("d.fp"))
        near = F.bit_count(F.col("q.fp").bitwiseXOR(F.col("d.fp"))) <= radius
        same = (F.col("q.part") == F.col("d.part")) & (F.col("q.key") == F.col("d.key"))
        met = q.join(d, same & once & (F.col("q.root") != F.col("d.root")) & near)
        joined = connected_components(met.select(F.col("q.root").alias("a"), F.col("d.root").alias("b")))
    with planned(spark, n):
        return materialize(
            nodes.join(joined, nodes.root == joined.node, "left").select("id", F.coalesce(joined.root, nodes.root).alias("root"))
        )


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row.

    A null or blank text has fingerprint zero and links like any other. Repeated rows stay
    repeated; a null doc_id is kept and never names a component unless it is alone in it; an
    empty table gives an empty result; other columns are ignored.
    """
    each = materialize(fingerprints(docs, shingle))
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    by_root = distinct.join(components(distinct, radius), "fp")
    return each.join(_named(by_root), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _named(by_root: DataFrame, salts: int = 32) -> DataFrame:
    """fp and component_id, the least `first` of its root; a root's fingerprints go to many tasks."""
    least = by_root.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = by_root.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
    return rows.join(least, ["root", "salt"], "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 4, mixings: int = 7, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: all columns, one row of each group.

    Candidates are texts whose SimHashes differ in at most radius bits. These are taken over
    distinct words, of which a changed word only touches one, and by several independent mixings
    of the words' hashes, as one misses some pairs near the threshold. Two candidates are linked
    if the Jaccard similarity of their five-word shingles is `similarity` or more, and a group is
    what links connect: of each group the row of the smallest doc_id (nulls last, then a hash of
    the row) stays. links.linked finds the groups without listing a group's pairs; however many
    texts a group or a set of candidates holds, all its links between groups count.

    Texts of equal shingles are alike. Rows are told apart by 128 bits over all their columns, so rows that
    share a doc_id or have none stand for themselves; of rows alike in every column one stays.
    Null and blank texts are alike. An empty table gives an empty result; columns may have any names.
    """
    from .minhash import shingle_sets, shingles, word_hashes

    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    # hashes skip nulls, so the places of the nulls are hashed too
    whole = [*(c.isNull() for c in names), *names]
    keys = [F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit("second"), *whole).alias("k2")]
    fps = [f"fp{k}" for k in range(mixings)]

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        import xxhash

        for b in batches:
            out: dict = {k: [] for k in ("node", "check", *fps)}
            for text in b["text"]:
                w = word_hashes(text or "")
                known = np.unique(shingles(w)).tobytes()
                out["node"].append(xxhash.xxh3_64_intdigest(known))
                out["check"].append(xxhash.xxh64_intdigest(known, 1))
                for name, fp in zip(fps, word_fingerprints(np.unique(w), mixings), strict=True):
                    out[name].append(fp)
            yield {**{k: b[k] for k in ("k1", "k2", "id", "t")}, **{k: np.array(v, np.uint64).view(np.int64) for k, v in out.items()}}

    columns = docs.select(*keys, F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("t"))
    rows = materialize(map_batches(columns, each, "k1 long, k2 long, id long, t long, node long, check long, " + ", ".join(f"{f} long" for f in fps)))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    nodes = rows.groupBy("node", "check").agg(F.min(order).alias("first"), *(F.min(f).alias(f) for f in (*fps, "t")), F.count("*").alias("n"))
    nodes = materialize(nodes)
    each_fp = F.explode(F.array(*(F.struct(F.lit(k).alias("mixing"), F.col(f).alias("fp")) for k, f in enumerate(fps)))).alias("m")
    marked = nodes.select("node", each_fp).select("node", "m.mixing", "m.fp", F.xxhash64("m.mixing", "m.fp").alias("id"))
    roots = roots_of(materialize(marked.select("id", "mixing", "fp").distinct()), radius)
    # texts of one root are candidates, whatever the mixing: one component
    with planned(docs.sparkSession, mixings * nodes.count()):
        shared = marked.join(roots, "id").select(F.col("node").alias("a"), F.col("root").alias("b"))
        candidates = connected_components(shared).select("node", F.col("root").alias("key"))
        met = nodes.select("node").distinct().join(candidates, "node").select("key", "node")
        several = met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
        met, _ = counted(met.join(several, "key"))
    del roots, shared, candidates, several, marked
    release(docs.sparkSession)
    sets, _ = counted(shingle_sets(docs, nodes.join(met.select("node"), "node").groupBy("node").agg(F.min("t").alias("t"))))
    groups = materialize(linked(met, sets, similarity))
    del met, sets
    release(docs.sparkSession)
    grouped = nodes.select("node", "check", "first", "n").join(groups, "node", "left")
    least = grouped.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    grouped = grouped.join(least, "root", "left").select("node", "check", "n", "first", F.coalesce("least", "first").alias("stays"))
    # what leaves: all rows of a group but its first; rows alike in all columns share their keys
    some = materialize(grouped.where((F.col("n") > 1) | (F.col("first") != F.col("stays"))).select("node", "check", "stays"))
    lost = rows.join(some, ["node", "check"]).where((F.col("k1") != F.col("stays.k1")) | (F.col("k2") != F.col("stays.k2")))
    lost = materialize(lost.select("k1", "k2").distinct())
    repeated = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))
    kept = docs.select(*keys, F.struct("*").alias("row"))
    touched = member_filter(lost.union(repeated), "k1")("k1")
    once = kept.where(touched).dropDuplicates(["k1", "k2"]).join(lost, ["k1", "k2"], "left_anti")
    return once.select("row.*").union(kept.where(~touched).select("row.*"))
