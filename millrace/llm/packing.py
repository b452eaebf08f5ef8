"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents become pieces of at most `capacity` tokens. The packing problem only depends on how
many pieces there are of each length, so Spark reduces the corpus to at most `capacity` counts
and the search runs on those: a branch-and-bound that takes the largest length left, enumerates
the undominated fillings of its bin, applies a filling as often as the counts allow, and prunes
by the waste that the best solution so far leaves. Best-fit decreasing gives the first
incumbent. The plan (a few thousand rows at most, whatever the corpus size) is broadcast; a
piece finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, held, map_batches, materialize, running_total
from .token_counts import _public_path


class IdEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, for a byte-level BPE tokenizers file.

    Whole texts are merged by the same ranks in compiled code, and by the library itself if they
    hold a special string. Ranks are the vocabulary's ids, so the file's merges must be in the
    order of the ids; others are refused.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        from .token_counts import _byte_letters

        self.path, whole = path, json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in whole["added_tokens"]]
        byte_of = {c: b for b, c in _byte_letters().items()}
        model = whole["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError(f"the merges of {path} don't follow its ids")
        ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in self.special}
        del whole, model, made
        #: Fixed value: the splitting rule of the byte-level pre-tokenizer.
        rule = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ordinary = tiktoken.Encoding("corpus", pat_str=rule, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def library(self):
        """Only read for a text that holds a special string; it takes as much memory as the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ordinary(text)
        return np.array(ids, "<u4").tobytes()


def encoder(tokenizer: str, path_of: Callable[[str], str]) -> IdEncoder:
    """The worker's encoder, made once."""
    return held("token ids", tokenizer, lambda: IdEncoder(path_of(tokenizer)))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, path_of: Callable[[str], str]) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents longer than capacity are cut."""

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        encode, end = encoder(tokenizer, path_of).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                starts = [0, *range(first, n, capacity)]
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(s)
                    out["length"].append(e - s)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * s : 4 * e]))
            yield out

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_batches(columns, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- the search, over counts of lengths -----------------------------------------------------


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins (lengths, how many alike), filling the fullest bin that still takes a piece first.

    Works on groups of equal bins, so its time depends on the distinct lengths only.
    """
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> bins alike
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                fit = capacity // length
                full, rest = divmod(left, fit)
                for k, m in ((fit, full), (rest, 1)):
                    if k and m:
                        kind = open_bins.setdefault(capacity - k * length, {})
                        kind[(length,) * k] = kind.get((length,) * k, 0) + m
                break
            kind = open_bins[room]
            bin_, m = kind.popitem()
            k = min(room // length, left)
            used = min(m, left // k)
            if m > used:
                kind[bin_] = m - used
            if not kind:
                del open_bins[room]
            grown = open_bins.setdefault(room - k * length, {})
            key = bin_ + (length,) * k
            grown[key] = grown.get(key, 0) + used
            left -= k * used
    return [(b, m) for kind in open_bins.values() for b, m in kind.items()]


def fillings(
    counts: dict[int, int], lengths: list[int], room: int, width: int | None, most_steps: int | None
) -> list[tuple[int, ...]]:
    """Undominated ways to fill room from the counts, least waste first, at most width of them.

    most_steps ends the enumeration early; without width and most_steps all are found.

    A filling is dominated if a piece left out still fits, alone or in place of a smaller one
    of the filling: the filling with it is never worse.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    rising, steps, full = lengths[::-1], 0, 0

    def undominated(chosen: tuple[int, ...], waste: int) -> bool:
        used: dict[int, int] = {}
        for x in chosen:
            used[x] = used.get(x, 0) + 1
        for y in (0, *used):
            for x in rising[bisect_right(rising, y) : bisect_right(rising, y + waste)]:
                if counts[x] > used.get(x, 0):
                    return False
        return True

    def go(i: int, chosen: tuple[int, ...], left: int) -> None:
        nonlocal steps, full
        steps += 1
        if most_steps is not None and steps > most_steps or width is not None and full >= width:
            return
        i = max(i, len(rising) - bisect_right(rising, left))  # the first that still fits
        if i == len(lengths):
            if not left or undominated(chosen, left):
                full += not left
                found.append((left, chosen))
            return
        x = lengths[i]
        for k in range(min(counts[x], left // x), -1, -1):
            go(i + 1, chosen + (x,) * k, left - k * x)

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    go(0, (), room)
    found.sort(key=lambda f: (f[0], len(f[1]), f[1]))
    return [f for _, f in found[:width]] or [()]


def bin_completion(
    counts: dict[int, int], capacity: int, nodes: int | None = 3000, width: int | None = 8, most_steps: int | None = 320
) -> list[tuple[tuple[int, ...], int]]:
    """Branch-and-bound over counts of lengths: bins as (lengths, how many alike).

    The best-fit solution is the first incumbent. The search stops at the lower bound or after
    `nodes` nodes, and looks at `width` fillings of a bin, found in `most_steps` steps: bounds on
    the driver's work, with every piece packed all the same. With None for all three the search
    is complete and its result the fewest bins.
    """
    counts = {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    bound = max(-(-total // capacity), large)
    best = best_fit_decreasing(counts, capacity)
    best_n = sum(m for _, m in best)
    path: list[tuple[tuple[int, ...], int]] = []
    seen = 0

    def go(left: dict[int, int], wasted: int, used: int) -> bool:
        """True once the search is over."""
        nonlocal best, best_n, seen
        if not left:
            if used < best_n:
                best, best_n = list(path), used
            return best_n <= bound
        seen += 1
        if nodes is not None and seen > nodes:
            return True
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        order = sorted((n for n, c in rest.items() if c), reverse=True)
        for filling in fillings(rest, order, capacity - top, width, most_steps):
            bin_ = (top, *filling)
            need: dict[int, int] = {}
            for x in bin_:
                need[x] = need.get(x, 0) + 1
            times = min(left[x] // k for x, k in need.items())
            waste = wasted + times * (capacity - sum(bin_))
            if waste > (best_n - 1) * capacity - total:
                continue  # a solution with this much waste cannot beat the incumbent
            after = {x: c - times * need.get(x, 0) for x, c in left.items()}
            path.append((bin_, times))
            over = go({x: c for x, c in after.items() if c}, waste, used + times)
            path.pop()
            if over:
                return True
        return False

    if best_n > bound:
        go(counts, 0, 0)
    return best


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: piece ranks from `rank` up to the next row's lie at `offset`, one in
    each sequence from `sequence` on."""
    rows, taken, sequence = [], {}, 0
    for bin_, times in plan:
        offset = 0
        for x in bin_:
            rank = taken.get(x, 0)
            rows.append((x, rank, sequence, offset))
            taken[x] = rank + times
            offset += x
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = 1024,
    path_of: Callable[[str], str] = _public_path,
    **search: int | None,
) -> DataFrame:
    """Packs every document's tokens (and end_id after them) into sequences of at most capacity.

    search: bounds of bin_completion (nodes, width, most_steps; None: unbounded).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text
    is end_id alone. Repeated rows, and rows without a doc_id, are pieces of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer, end_id, capacity, path_of))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(slots(bin_completion(counts, capacity, **search)))
    # a piece's rank among its length: buckets spread a length that holds a third of all pieces
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(bucket_count(sum(counts.values()), least=1024)))
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = running_total(cut, ["length"], order, F.lit(1), spread)

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        p = plan.value
        keys = p["length"] << 44 | p["rank"]
        for b in batches:
            rank = np.array(b.pop("before"), dtype=np.int64)
            i = np.searchsorted(keys, np.array(b["length"], dtype=np.int64) << 44 | rank, side="right") - 1
            yield b | {
                "sequence_id": (p["sequence"][i] + rank - p["rank"][i]).tolist() if len(rank) else [],
                "offset": p["offset"][i].tolist() if len(rank) else [],
            }

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked, place, schema)
