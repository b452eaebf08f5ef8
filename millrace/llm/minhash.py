"""MinHash fingerprints of whole texts, and near-duplicates by banded signatures.

A text's shingles (five lower-cased words) are hashed to 32 bits; each of the signature's
lanes is the minimum over the shingles of one universal hash permutation (a x + b mod 2^32
with odd a), all lanes at once in numpy. A lane keeps the low 16 bits of its minimum, which
leaves chance agreement at 2^-16.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links
from .common import arrow_function, counted, held, map_batches, materialize, member_filter, member_test, release
from .token_counts import _Cache

LANES, SHINGLE = 128, 5
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, LANES, dtype=np.uint32) * 2 + 1)[:, None]
_B = _rng.integers(0, 1 << 32, LANES, dtype=np.uint32)[:, None]
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def _hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's lower-cased words, in order."""
    known = held("words of shingles", None, lambda: _Cache(_hash_word, {}))
    words = text.lower().encode().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(w: np.ndarray) -> np.ndarray:
    """32-bit hashes of the shingles of words (their hashes); one for fewer words, none for none."""
    n = max(1, len(w) - SHINGLE + 1) if len(w) else 0
    x = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        x += w[k : k + n] * _POWERS[k]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def signature(text: str) -> np.ndarray:
    """The lanes of one text; a blank text has all bits set."""
    return _lanes(shingles(word_hashes(text)))


def _lanes(x: np.ndarray) -> np.ndarray:
    low = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):  # the table of lanes by shingles stays in cache
        np.minimum(low, (_A * x[at : at + 2048] + _B).min(axis=1), out=low)
    return low.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u2").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(docs: DataFrame, rows_each: int, most: int) -> list[int]:
    """Quantiles of doc_id that part the table into ranges (at most `most`, so always few)."""
    n = docs.count()
    parts = max(1, min(most, n // rows_each))
    if parts == 1:
        return []
    at = [k / parts for k in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", F.lit(at), F.lit(100 * parts)).alias("q")).first().q
    return sorted(set(found or []))


def fingerprints_with_edits(docs: DataFrame, rows_each: int = 4096, most: int = 20_000, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id.

    component_id: the smallest doc_id reachable over near-duplicates, whose signatures share a band
    and whose shingles have a verified Jaccard similarity of threshold or more (see near_duplicates).

    The next document is the one with the next smaller doc_id (after the smallest: the
    greatest), of equal doc_ids the one with the greater text hash; a null doc_id comes after
    all others. A null text counts as empty; two blank texts are alike (1.0); a table's only row
    is its own next; an empty table gives an empty result; other columns are ignored.

    Ranges of doc_id are shuffled and sorted once; each range's last row finds its next in a
    copy of the following range's first row, which is added before the shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(_bounds(docs, rows_each, most), np.int64)

    def range_of(ids):
        ids = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, ids, side="left").astype(np.int32))

    part = arrow_function(range_of, "int")

    ids = docs.select("doc_id").withColumn("part", part("doc_id"))
    tops = ids.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy(F.desc("part")).collect()  # <= most rows
    spark = docs.sparkSession
    # the first row of each range serves the range before it
    serves = [(tops[k - 1].part, tops[k].part, tops[k].top) for k in range(len(tops))]
    heads = spark.createDataFrame(serves, "serves int, part int, top long")
    h = F.xxhash64("text")
    heads = (
        docs.join(F.broadcast(heads), docs.doc_id.eqNullSafe(heads.top))
        .groupBy("serves").agg(F.min_by("text", h).alias("text"))
        .select(F.col("serves").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("head"))
    )
    rows = docs.select(F.lit(None).cast("int").alias("part"), "doc_id", "text", F.lit(0).alias("head"), h.alias("h"))
    rows = _compressed(rows.union(heads.select("*", h.alias("h"))), bounds)
    # rows without a text tell those after them their component and signature
    found = groups(docs, threshold).select(
        part("doc_id").alias("part"), "doc_id", F.lit(None).cast("binary").alias("text"), F.lit(0).alias("head"), F.col("t").alias("h"),
        F.col("component_id").alias("component"), "signature",
    )
    rows = rows.select("*", F.lit(None).cast("long").alias("component"), F.lit(None).cast("binary").alias("signature")).union(found)
    tasks = max(len(tops), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part", "head", F.desc_nulls_last("doc_id"), "h", F.col("text").isNotNull())

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        held, component, known = None, None, None  # the row that waits for its next, with its signature
        for b in batches:
            out: dict = {k: [] for k in _FIELDS}
            for part_, doc, packed, head, h, group, sig in zip(*(b[c] for c in ("part", "doc_id", "text", "head", "h", "component", "signature")), strict=True):
                if packed is None:
                    component, known = group, (h, np.frombuffer(sig, "<u2"))
                    continue
                text = plain.decompress(packed).decode()
                own = known[1] if known and known[0] == h and not head else signature(text)
                if held and held[0] == part_:
                    _, last, last_text, last_own, last_component = held
                    new = edited(last_text, text)
                    sig = signature(new)
                    row = (
                        last, len(last_text), hashlib.sha256(new.encode()).hexdigest(), as_text(last_own), as_text(sig),
                        likeness(last_own, sig), likeness(last_own, own), last_component,
                    )
                    for k, v in zip(_FIELDS, row, strict=True):
                        out[k].append(v)
                held = None if head else (part_, doc, text, own, component)
            yield out

    return map_batches(rows, each, ", ".join(f"{k} {t}" for k, t in _FIELDS.items()))


def _compressed(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The same rows with their texts compressed, as each is shuffled once, and the range of doc_id where it isn't given."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ranges = np.searchsorted(bounds, [-(1 << 63) if d is None else d for d in b["doc_id"]], side="left").tolist()
            parts = [r if p is None else p for r, p in zip(ranges, b["part"], strict=True)]
            yield {**b, "part": parts, "text": [pack.compress(t.encode()) for t in b["text"]]}

    return map_batches(rows, each, "part int, doc_id long, text binary, head int, h long")


_FIELDS = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string",
    "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "component_id": "long",
}


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the set of shingles), t (a hash of the text) and signature (bytes) of each row."""
    import xxhash

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = [shingles(word_hashes(t or "")) for t in b["text"]]
            nodes = [xxhash.xxh3_64_intdigest(np.unique(x).tobytes()) for x in sets]
            yield {"doc_id": b["doc_id"], "node": np.array(nodes, np.uint64).view(np.int64), "t": b["t"], "signature": [_lanes(x).astype("<u2").tobytes() for x in sets]}

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("t"))
    return map_batches(columns, each, "doc_id long, node long, t long, signature binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, its distinct shingle hashes and its sketch, for the wanted nodes (node, t: the hash of a text of theirs)."""
    import xxhash

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = [np.unique(shingles(word_hashes(t or ""))) for t in b["text"]]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            bits = np.array([links.sketch(_lanes(x)) for x in sets], np.int64).reshape(-1, len(links.SKETCH))
            yield {"node": nodes, "shingles": [x.view(np.int32) for x in sets], **{k: bits[:, i] for i, k in enumerate(links.SKETCH)}}

    texts = docs.select(F.xxhash64("text").alias("t"), F.col("text").alias("text"))
    may = member_test(wanted, "t")
    found = map_batches(texts, each, "node long, shingles array<int>, " + ", ".join(f"{k} long" for k in links.SKETCH), may and ("t", may))
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 25) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) over links of verified Jaccard >= threshold.

    Texts of equal shingles form one node. The signatures' bands are the buckets from which
    links.linked finds all links between groups. Null and blank texts are alike; repeated rows
    stay; a null doc_id is kept and only names a component that has no other; an empty table gives
    an empty result; other columns are ignored.
    """
    return groups(docs, threshold, bands).select("doc_id", "component_id")


def groups(docs: DataFrame, threshold: float = 0.8, bands: int = 25) -> DataFrame:
    """doc_id, component_id, t (the hash of the text, by which a row's group is found again) and signature; see near_duplicates."""
    rows = materialize(signatures(docs))
    nodes = materialize(rows.groupBy("node").agg(F.min("t").alias("t"), F.min("doc_id").alias("first")))
    width = 2 * (LANES // bands)
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("signature", 1 + k * width, width)) for k in range(bands)))
    every = rows.select("node", F.explode(keys).alias("key"))
    # keys of one row leave first, by their counts alone; then those of one node
    twice, _ = counted(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met, _ = counted(every.where(member_filter(twice, "key")("key")).distinct().join(twice, "key", "left_semi"))
    crowded = met.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    met, _ = counted(met.join(crowded, "key", "left_semi"))
    del twice, crowded
    release(docs.sparkSession)
    sets, _ = counted(shingle_sets(docs, nodes.join(met.select("node").distinct(), "node").select("node", "t")))
    roots = links.linked(met, sets, threshold)
    del met, sets
    release(docs.sparkSession)
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least_id = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least_id, "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", "t", "component_id", "signature")
