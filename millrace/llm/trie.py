"""The prefix trie of conversations, by burst tries.

A turn is known by 16 bytes of its role and text, a conversation by its path: its turns' bytes in
a row. Equal paths are one row that counts its conversations. All paths begin in one container
under the root; a container of more than `capacity` different paths bursts, and its paths go to
containers under trie heads one turn deeper, by their next turn. A round bursts through as many
levels as all earlier rounds together, so long stretches shared by many paths take few rounds.
Each remaining container is sorted by path and swept into its nodes by one task; for the heads
above it leaves partial counts behind, which are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches, materialize

#: Bytes by which a turn is known.
TURN = 16
_SALTS = 32
#: What a sweep gives. kind: 0 a node, 1 the top of a container (its parent is a head), 2 a part of a head's counts.
_SWEPT = {
    "kind": "int", "key": "binary", "parent": "binary", "depth": "long", "conv_id": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long",
    "n_leaves": "long", "weight": "long", "once": "long", "w": "long", "ends_sha256": "string", "owner": "binary",
}
NOBODY = hashlib.sha256(b"").hexdigest()


def prefix_keys(path: bytes, least: int, most: int) -> list[bytes]:
    """The keys of the path's prefixes of `least` to `most` turns."""
    h, out = hashlib.md5(path[: least * TURN]), []
    for d in range(least, most + 1):
        if d > least:
            h.update(path[(d - 1) * TURN : d * TURN])
        out.append(h.digest())
    return out


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, turns (an array of id and words): each conversation with the first turns of its group's.

    The rows of a group of conversation ids are dealt out together once, as short turn ids. A conversation is one
    record, as a text is: its turns' ids are put in order in one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps its end apart from the text's beginning
    known = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % group).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), known.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
    )
    rows = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("own"))
    rows = rows.select("base", "conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("own"))
    first = rows.where("conv_id = base").select("base", F.slice("own", F.lit(1), F.lit(shared - 1)).alias("first"))
    rows = rows.join(first, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    none = F.slice("own", F.lit(1), F.lit(0))
    own = F.when(F.size("own") > h, F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).otherwise(none)
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), own).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """key, path and words (32-bit numbers) of each different path, n conversations and the least of them, and their ends_sha256."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            path = [b"".join(t["id"] for t in turns) for turns in b["turns"]]
            words = [b"".join(t["words"].to_bytes(4, "little") for t in turns) for turns in b["turns"]]
            yield {"conv_id": b["conv_id"], "key": [hashlib.md5(p).digest() for p in path], "path": path, "words": words}

    rows = materialize(map_batches(conversations, each, "conv_id long, key binary, path binary, words binary"))
    different = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    return different.join(_ends(rows.select("key", "conv_id")), "key")


def _ends(members: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """key and ends_sha256: the digest of the key's conversation ids in ascending order.

    Ranges of (key, conv_id) turn into pieces of some 64 KB, so that what one task takes in of a
    key that a third of all conversations share is few rows, read one after the other.
    """

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        key, first, text, size = None, 0, [], 0
        for b in batches:
            out: dict = {"key": [], "first": [], "text": []}
            for k, c in zip(b["key"], b["conv_id"], strict=True):
                if k != key or size > chunk:
                    if key is not None:
                        for name, v in zip(out, (key, first, ",".join(text)), strict=True):
                            out[name].append(v)
                    key, first, text, size = k, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            yield out
        if key is not None:
            yield {"key": [key], "first": [first], "text": [",".join(text)]}

    def digests(batches: Iterator[dict]) -> Iterator[dict]:
        key, h = None, None
        for b in batches:
            out: dict = {"key": [], "ends_sha256": []}
            for k, text in zip(b["key"], b["text"], strict=True):
                if k == key:
                    h.update(b",")
                else:
                    if key is not None:
                        out["key"].append(key)
                        out["ends_sha256"].append(h.hexdigest())
                    key, h = k, hashlib.sha256()
                h.update(text.encode())
            yield out
        if key is not None:
            yield {"key": [key], "ends_sha256": [h.hexdigest()]}

    rows = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = map_batches(rows, pieces, "key binary, first long, text string").repartition("key").sortWithinPartitions("key", "first")
    return map_batches(rows, digests, "key binary, ends_sha256 string")


def burst(different: DataFrame, capacity: int, most_rounds: int = 40) -> DataFrame:
    """key of each path and depth of its container's top: the least prefix that no more than capacity paths have.

    at_head: the path ends at a trie head, at that depth, and has no container. Every round looks
    through the next levels of the paths that are still in oversized containers: 1, 2, 4 ... levels.
    """
    if different.count() <= capacity:
        return different.select("key", F.lit(0).alias("depth"), F.lit(False).alias("at_head"))
    done, open_ = None, different.select("key", "path")
    seen, levels = 0, 1  # all prefixes of up to `seen` turns of open paths are oversized
    for _ in range(most_rounds):
        at, to = seen, seen + levels

        def prefixes(batches: Iterator[dict], at: int = at, to: int = to) -> Iterator[dict]:
            for b in batches:
                out: dict = {"key": [], "depth": [], "prefix": []}
                for key, path in zip(b["key"], b["path"], strict=True):
                    last = min(to, len(path) // TURN)
                    for d, p in enumerate(prefix_keys(path, at + 1, last) if last > at else (), at + 1):
                        for name, v in zip(out, (key, d, p), strict=True):
                            out[name].append(v)
                yield out

        levels_of = materialize(map_batches(open_.select("key", "path"), prefixes, "key binary, depth int, prefix binary"))
        heads = levels_of.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > capacity)
        heads = heads.select("prefix", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        salted = levels_of.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int"))
        # an oversized prefix's own prefixes are oversized, so the deepest tells how many are
        deep = salted.join(heads, ["prefix", "salt"]).groupBy("key").agg(F.max("depth").alias("deep"))
        length = (F.length("path") / TURN).cast("int")
        placed = materialize(open_.join(deep, "key", "left").withColumn("deep", F.coalesce("deep", F.lit(at))))
        # a path that ends at a head stays there
        settled = placed.where((F.col("deep") < to) | (length == F.col("deep")))
        settled = settled.select("key", F.least(F.col("deep") + 1, length).alias("depth"), (length == F.col("deep")).alias("at_head"))
        done = settled if done is None else done.union(settled)
        open_ = placed.where((F.col("deep") == to) & (length > F.col("deep"))).select("key", "path")
        if open_.isEmpty():
            return done
        seen, levels = to, levels * 2
    raise RuntimeError(f"containers did not settle in {most_rounds} rounds")


def _above(path: bytes, words: bytes, depth: int) -> tuple[list[bytes], list[int]]:
    """The keys of the heads above depth, the root first, and the words of their last turns."""
    keys = prefix_keys(path, 0, depth - 1) if depth else []
    return keys, [0, *(int.from_bytes(words[4 * k : 4 * k + 4], "little") for k in range(depth - 1))][:depth]


def sweep(rows: list[dict], depth: int, at_head: bool) -> Iterator[tuple]:
    """What one container gives (see _SWEPT): its nodes, and its part of each head above it.

    rows: key, path, words, n, least and ends_sha256 of the container's paths, in the order of the
    paths. A node's subtree has the weight n_convs * words of each of its nodes, and those words
    once; the difference is what sharing saves.
    """
    first = rows[0]
    if at_head:  # one path that is a head itself
        keys, own = _above(first["path"], first["words"], depth + 1)
        total = (first["least"], first["n"], 0, 0, 0)
        yield from _parts(keys, own, total, 0, first["ends_sha256"], first["key"])
        return
    depths, ups, ids, convs, children, leaves, weights, once, ends = ([] for _ in range(9))
    words_of: list[int] = []
    stack: list[int] = []  # the places of the open nodes, from the top

    def close(to: int) -> None:
        while len(stack) > to:
            i = stack.pop()
            leaves[i] += children[i] == 0
            weights[i] += convs[i] * words_of[i]
            once[i] += words_of[i]
            if stack:
                up = stack[-1]
                ids[up] = min(ids[up], ids[i])
                for counts in (convs, leaves, weights, once):
                    counts[up] += counts[i]
                children[up] += 1

    before = None
    for r in rows:
        path, length, same = r["path"], len(r["path"]) // TURN, depth - 1
        if before is not None:
            most = min(length, len(before) // TURN)
            same = depth
            while same < most and path.startswith(before[same * TURN : (same + 1) * TURN], same * TURN):
                same += 1
        close(same - depth + 1)
        for d in range(same + 1, length + 1):
            ups.append(stack[-1] if stack else -1)
            stack.append(len(depths))
            depths.append(d)
            ids.append(r["least"])
            words_of.append(int.from_bytes(r["words"][4 * d - 4 : 4 * d], "little") if d else 0)
            ends.append(NOBODY)
            for counts in (convs, children, leaves, weights, once):
                counts.append(0)
        last = stack[-1]
        ids[last] = min(ids[last], r["least"])
        convs[last] += r["n"]
        ends[last] = r["ends_sha256"]
        before = path
    close(0)
    keys, own = _above(first["path"], first["words"], depth)
    for i, d in enumerate(depths):
        up = ups[i]
        yield (
            int(up < 0 and d > 0), None, keys[-1] if up < 0 and d else None, d, ids[i], ids[up] if up >= 0 else None, convs[i], children[i],
            leaves[i], weights[i], once[i], words_of[i], ends[i], None,
        )
    yield from _parts(keys, own, (ids[0], convs[0], leaves[0], weights[0], once[0]), 1, None, first["key"])


def _parts(keys: list[bytes], own: list[int], total: tuple, child: int, ends: str | None, owner: bytes) -> Iterator[tuple]:
    """A container's part of the counts of each head above it; the lowest has its top as a child, or its end."""
    least, n, leaves, weight, once = total
    for d in range(len(keys) - 1, -1, -1):
        weight += n * own[d]
        lowest = d == len(keys) - 1
        yield (2, keys[d], keys[d - 1] if d else None, d, least, None, n, child if lowest else 0, leaves, weight, once, own[d], ends if lowest else None, owner)


def nodes(turns: DataFrame, capacity: int = 256, group: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    Conversations are rebuilt first: conversation c takes the first h turns of conversation
    c - c % group (SQL's %, which has the sign of c), then its own after its first h; h = crc32(c) % shared. Turns stand in the order
    of `turn`, a null first, equal ones in the order of their turn ids; a null role or text is an
    empty one; repeated rows are turns of their own. Rows without a conv_id take no part.
    Conversations without a turn left belong to the root. An empty table has no node; other
    columns are ignored. Whatever the capacity, the nodes are the same.
    """
    different = materialize(paths(rebuilt(turns, group, shared)))
    placed = burst(different.select("key", "path"), capacity)

    def named(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {**b, "container": [prefix_keys(p, d, d)[0] for p, d in zip(b["path"], b["depth"], strict=True)]}

    fields = "key binary, path binary, words binary, n long, least long, ends_sha256 string, depth int, at_head boolean"
    rows = map_batches(different.join(placed, "key").select(*(f.split()[0] for f in fields.split(", "))), named, f"{fields}, container binary")
    # the head that a path ends at may share its key with no container: all others through it lie deeper
    rows = rows.repartition("container").sortWithinPartitions("container", "path")

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []

        def out(found: list[tuple]) -> dict:
            return dict(zip(_SWEPT, map(list, zip(*found, strict=True)), strict=True)) if found else {k: [] for k in _SWEPT}

        for b in batches:
            found: list[tuple] = []
            for row in zip(*b.values(), strict=True):
                r = dict(zip(b, row, strict=True))
                if held and held[0]["container"] != r["container"]:
                    found += sweep(held, held[0]["depth"], held[0]["at_head"])
                    held = []
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                held.append(r)
            yield out(found)
        if held:
            yield out(list(sweep(held, held[0]["depth"], held[0]["at_head"])))

    swept = materialize(map_batches(rows, each, ", ".join(f"{k} {t}" for k, t in _SWEPT.items())))
    heads = _heads(swept.where("kind = 2"), different)
    columns = [c for c in _SWEPT if c not in ("kind", "key", "w", "owner")]
    below = swept.where("kind < 2").select(*columns)
    every = below.where("parent is null").union(_with_parent(below.where("parent is not null").union(heads.select(*columns)), heads))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weight") - F.col("once")).alias("saved_tokens"), "ends_sha256"
    )


def _heads(parts: DataFrame, different: DataFrame) -> DataFrame:
    """The trie heads, their parts summed."""
    heads = materialize(parts.groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("parent", "depth", "w")), *(F.min(c).alias(c) for c in ("conv_id", "owner")),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "once")), F.coalesce(F.max("ends_sha256"), F.lit(NOBODY)).alias("ends_sha256"),
    ))

    # each head's words count once in every head above: they go up the path that speaks for it
    def up(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"key": [], "more": []}
            for path, owned in zip(b["path"], b["owned"], strict=True):
                last = max(o["depth"] for o in owned)
                own = [0] * (last + 1)
                for o in owned:
                    own[o["depth"]] += o["w"]
                more = 0
                for d, key in reversed(list(enumerate(prefix_keys(path, 0, last)))):
                    more += own[d]
                    out["key"].append(key)
                    out["more"].append(more)
            yield out

    owned = heads.groupBy("owner").agg(F.collect_list(F.struct("depth", "w")).alias("owned"))  # heads on one path
    owned = different.select(F.col("key").alias("owner"), "path").join(owned, "owner").select("path", "owned")
    more = map_batches(owned, up, "key binary, more long").groupBy("key").agg(F.sum("more").alias("more"))
    inner = heads.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("inner"))
    heads = heads.join(more, "key", "left").join(inner, "key", "left").fillna(0, ["more", "inner"])
    heads = heads.withColumn("once", F.col("once") + F.col("more")).withColumn("n_children", F.col("n_children") + F.col("inner"))
    return materialize(heads.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("more", "inner"))


def _with_parent(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Sets parent_conv_id from the heads; the many children of one head go to many tasks."""
    spread = heads.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(_SALTS)).cast("int"))
    joined = salted.join(spread, ["parent", "salt"], "left")
    return joined.withColumn("parent_conv_id", F.col("parent_conv")).select(*rows.columns)
