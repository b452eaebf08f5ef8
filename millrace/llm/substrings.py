"""Removal of repeated token windows, by Rabin-Karp hashes counted in Spark.

Every window of `window` words has a Rabin-Karp hash. Only windows that can repeat are
shuffled: each window chooses, by content, the least of its shorter `gram`-word hashes, so
equal windows choose equally; a window whose choice occurs in no other text has no equal. The
choices (some 6 % of the windows) are counted first; then the windows with a shared choice are
counted by a 96-bit hash of their own, and a window is removed where a document with a smaller
doc_id has it too. Overlapping removed windows merge into maximal intervals.

Exact copies are handled by a hash of the whole word sequence, so they never reach the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, held, map_batches, materialize, member_filter
from .token_counts import _Cache

WINDOW, GRAM = 50, 16
#: Odd multipliers of the two rolling hashes and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = held("words of windows", None, lambda: _Cache(_hash_word, {}))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and grown by doubling."""
    have = _POWERS.get((base, 0), np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[base, 0] = have
    return have[:n]


def rolling(w: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all runs of `size` values, from one prefix sum.

    With S_i the sum of w_j B^j below i, a run's hash is (S_(i+size) - S_i) B^-i.
    """
    if len(w) < size:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(base, len(w)), dtype=np.uint64)])
    h = (s[size:] - s[:-size]) * _powers(inverse, len(w) - size + 1)
    h ^= h >> np.uint64(32)  # the low bits of a product only see low bits
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over all runs of width values, by doubling."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def grams(w: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's chosen gram hash, and the hashes of all grams."""
    g = rolling(w, gram, _BASES[0])
    return _sliding(g, window - gram + 1, np.minimum), g


def _content(words: list[bytes]) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For the documents that lose words: key and gone, an array of c1, copy, starts; written out.

    key is doc_id (a null counts as greater than any other), c1 tells texts of one doc_id
    apart. copy: an earlier document has the same words. starts: the removed windows' places.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    docs = docs.select(key.alias("key"), F.col("text").alias("text"))

    def contents(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {k: [] for k in ("key", "c1", "c2", "n", "chosen")}
            for k, text in zip(b["key"], b["text"], strict=True):
                words = (text or "").encode().split()
                c1, c2 = _content(words)
                chosen, _ = grams(word_hashes(words), window, gram)
                row = (k, c1, c2, len(words), np.unique(chosen).view(np.int64))
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            yield out

    each = materialize(map_batches(docs, contents, "key long, c1 long, c2 long, n int, chosen array<long>"))
    texts = each.where(F.col("n") >= window).groupBy("c1", "c2")
    texts = materialize(texts.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.first("chosen").alias("chosen")))
    copied = texts.where("last > first").select("c1", "c2", "first")
    copies = each.join(copied, ["c1", "c2"]).where("key > first")
    copies = copies.select("key", "c1", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))

    chosen = texts.select("first", "c1", F.explode("chosen").alias("gram"))
    shared = chosen.groupBy("gram").agg(F.count("*").alias("n"), F.min("first").alias("lo")).where("n > 1")
    # a window can only go where an earlier document has its gram; elsewhere it may be the first
    late = F.when(F.col("first") > F.col("lo"), F.col("gram"))
    marks = chosen.join(shared, "gram").groupBy("first", "c1")
    marks = materialize(marks.agg(F.collect_list("gram").alias("shared"), F.collect_list(late).alias("late")))

    schema = pa.schema(
        [(k, pa.int64()) for k in ("w1", "key", "c1")] + [("w2", pa.int32()), ("starts", pa.list_(pa.int32())), ("late", pa.bool_())]
    )

    def chosen_from(grams_, g: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each window's choice is one of these grams."""
        of = np.where(np.isin(g, grams_.values.to_numpy().view(np.uint64)), g, _NEVER)
        return _sliding(of, window - gram + 1, np.minimum) == least

    def windows(batches):
        for b in batches:
            columns = [b.column(c) for c in ("key", "c1", "text", "shared", "late")]
            for k, c1, text, shared_, late_ in zip(*columns, strict=True):
                words = (text.as_py() or "").encode().split()
                if _content(words)[0] != c1.as_py():
                    continue  # another text of the same doc_id
                w = word_hashes(words)
                least, g = grams(w, window, gram)
                start = np.flatnonzero(chosen_from(shared_, g, least)).astype(np.int32)
                h1, h2 = (rolling(w, window, base)[start] for base in _BASES)
                # a text's equal windows are one row, with all their places
                order = np.lexsort((start, h2, h1))
                h1, h2, start = h1[order], h2[order], start[order]
                first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(start) else start
                ends = np.r_[first, len(start)].astype(np.int32)
                out = {
                    "w1": h1[first].view(np.int64), "key": np.full(len(first), k.as_py()), "c1": np.full(len(first), c1.as_py()),
                    "w2": (h2[first] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    "starts": pa.ListArray.from_arrays(pa.array(ends), pa.array(start)), "late": chosen_from(late_, g, least)[start[first]],
                }
                columns_ = [v if isinstance(v, pa.Array) else pa.array(v) for v in (out[f.name] for f in schema)]
                yield pa.RecordBatch.from_arrays(columns_, schema=schema)

    # only texts that can hold a repeat are shuffled
    marked = docs.where(member_filter(marks, "first")("key"))
    found = marked.join(marks, marked["key"] == marks["first"]).select("key", "c1", "text", "shared", "late")
    found = found.mapInArrow(windows, "w1 long, key long, c1 long, w2 int, starts array<int>, late boolean")
    found = found.persist(StorageLevel.DISK_ONLY)  # read twice; a lost block is made again
    # written out, so that the join below has plain sides and a window that very many texts share can be split
    earliest = found.groupBy("w1", "w2").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    earliest = materialize(earliest.drop("hi"))
    repeated = found.where("late").drop("late").join(earliest, ["w1", "w2"]).where("key > lo")
    repeated = repeated.groupBy("key", "c1").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    gone = copies.distinct().unionByName(repeated.withColumn("copy", F.lit(False)))
    gone = materialize(gone.groupBy("key").agg(F.collect_list(F.struct("c1", "copy", "starts")).alias("gone")))
    found.unpersist()
    return gone


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The words that no removed window covers."""
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    covered = np.cumsum(step[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def _with_removals(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """row (all columns of docs, whatever their names) and gone (what removals() says of its doc_id).

    In two tables: rows whose doc_id may lose something, which meet their removals, and the
    others, which stay where they are and have a null in gone.
    """
    gone = removals(docs, window, gram)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(key.alias("own"), F.struct("*").alias("row"))
    loses = member_filter(gone, "key")("own")
    some, rest = rows.where(loses), rows.where(~loses)
    some = some.join(gone, some["own"] == gone["key"], "left").select("row", "gone")
    return some, rest.select("row", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))


def _kept(text: str | None, gone: list | None, window: int) -> tuple[list[bytes], list[bytes]]:
    words = (text or "").encode().split()
    if gone is None:
        return words, words
    c1 = _content(words)[0]
    starts = [s for g in gone if g["c1"] == c1 and g["starts"] is not None for s in g["starts"]]
    if any(g["copy"] and g["c1"] == c1 for g in gone):
        return words, []
    return words, kept_words(words, np.array(starts, np.int64), window) if starts else words


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space).

    A null text has no words; a null doc_id counts as the greatest; rows that share a doc_id are
    never repeats of each other; a document shorter than the window keeps everything; an empty
    table gives an empty result; other columns are ignored.
    """

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256")}
            for doc, text, gone in zip(b["doc_id"], b["text"], b["gone"], strict=True):
                words, kept = _kept(text, gone, window)
                row = (doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            yield out

    some, rest = _with_removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, gram)
    return map_batches(some.union(rest).select("row.doc_id", "row.text", "gone"), each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated windows cut out of text (kept words joined by one space), n_chars
    set anew; texts that lose nothing stay as they are, rows of which nothing is left go."""

    def new_texts(texts, gones):
        out = []
        for text, gone in zip(texts.to_pylist(), gones.to_pylist(), strict=True):
            words, kept = _kept(text, gone, window)
            out.append(text if len(kept) == len(words) else b" ".join(kept).decode())
        return pa.array(out, pa.string())

    cut = arrow_function(new_texts, "string")

    some, rest = _with_removals(docs, window, gram)
    text, none = F.col("row.text"), F.col("gone").isNull()
    some = some.withColumn("new", F.when(none, text).otherwise(cut(text, "gone"))).where(none | (F.col("new") != ""))
    new = {"text": F.col("new"), "n_chars": F.when(none, F.col("row.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in docs.columns else None}
    some = some.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
    return some.union(rest.select("row.*"))  # texts that lose nothing never leave the JVM
