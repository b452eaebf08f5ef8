"""Centroid clustering, the prefix trie and the quality rules against plain re-statements of their contracts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, corpus, documents, words

from millrace.llm import clustering, quality, trie
from pyspark.sql import functions as F


def clashing(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    return df


# -- centroid clustering


def plain_clusters(rows, k=8, rounds=10, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[0]].append(v)
        for c, g in groups.items():
            centroids[c] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    got = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in got:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in got)


def clusters(df, **how):
    return Counter(tuple(r) for r in clustering.cluster(df, **how).collect())


def vectors(n=300, seed=5, size=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(10, size))
    out = [(i, [float(np.float32(x)) for x in centres[i % 10] + r.normal(scale=0.3, size=size)]) for i in range(n)]
    out[7] = (7, out[3][1])  # a tie
    return [*out, out[20], (400, None), (401, out[0][1][:-1]), (402, [None, *out[0][1][1:]]), (403, [math.nan, *out[0][1][1:]]), (404, [math.inf, *out[0][1][1:]]), (405, [0.0] * size), (405, [0.0] * size)]


@pytest.mark.parametrize("pivots", [1, 8, 40])
def test_clusters_against_all_distances(spark, pivots):
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), "x", "pivots", "cluster", "h")
    assert clusters(df, pivots=pivots, sample_rows=64) == plain_clusters(rows)


def test_clusters_of_few_and_of_large_vectors(spark):
    few = [(5, [1.0, 2.0]), (6, [1.0, 2.5]), (None, [0.5, 0.5]), (9, [1e20, -3e30]), (10, [1e20, -3e30]), (11, [1e20, 2e30])]
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_clusters(few, size=2)
    long = lambda d: d if d < 1 << 63 else None
    assert clusters(make(few), dimensions=2) == Counter((i, c, long(d), long(a), long(b), h) for i, c, d, a, b, h in want.elements())
    want = plain_clusters(few, k=2, size=2)
    assert clusters(make(few), dimensions=2, k=2) == Counter((i, c, long(d), long(a), long(b), h) for i, c, d, a, b, h in want.elements())
    assert clusters(make([]), dimensions=2) == Counter()
    assert clusters(make([(1, None)]), dimensions=2) == Counter()


def test_pivots_spare_distances():
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 64)) * 4000
    x = (centres[r.integers(0, 8, 500)] + r.normal(size=(500, 64)) * 200).astype(np.int64)
    centroids = [c.astype(np.int64) for c in centres]
    pivots = clustering.choose_pivots(list(x[:100]), 8)
    far = np.stack([clustering.lengths(clustering.squares(x, p)) for p in pivots], axis=1)
    cluster, best, taken = clustering.assign(x, far, centroids, pivots)
    d = np.stack([clustering.squares(x, c) for c in centroids], axis=1)
    assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and taken < 0.25 * d.size


# -- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in sorted(paths.items()):
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(words(q[-1][1])) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, digest] += 1
    return out


def chats(n=130, seed=4):
    """Conversations that share openings, long trunks and whole texts, and odd ones."""
    r = random.Random(seed)
    turn = lambda: ("user" if r.random() < 0.5 else "assistant", " ".join(r.choice("abcde") for _ in range(r.randint(0, 3))))
    trunk = [turn() for _ in range(40)]
    rows = []
    for c in range(n):
        kind = r.random()
        turns = trunk[: r.randint(0, 40)] + [turn()] * (kind < 0.2) if kind < 0.6 else [turn() for _ in range(r.randint(1, 5))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(c, k, *t) for c in range(1000, 1040) for k, t in enumerate(trunk[:9])]
    rows += [(500, 0, "ab", "c"), (501, 0, "a", "bc"), (502, None, None, None), (502, 1, None, "x"), (None, 0, "user", "nobody"), (-7, 0, "user", "below"), (0, 90, "user", "long " * 3000)]
    return rows


@pytest.mark.parametrize("capacity", [1, 3, 20, 10_000])
def test_trie_against_all_prefixes(spark, capacity):
    rows = chats()
    r = random.Random(1)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = trie.nodes(clashing(df, "key", "path", "depth", "base", "n", "least"), capacity)
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    assert Counter(tuple(x[c] for c in columns) for x in got.collect()) == plain_trie(rows)


def test_trie_of_nothing_of_repeats_and_of_one(spark):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie.nodes(make([])).collect() == []
    assert trie.nodes(make([(None, 0, "user", "x")])).collect() == []
    repeated = [(3, 0, "user", "x y"), (3, 0, "user", "x y")]  # turns of their own
    assert Counter(tuple(r) for r in trie.nodes(make(repeated)).collect()) == plain_trie(repeated)
    for c in (1, 2, 20):  # 1 and 2 have no group's conversation to begin with
        one = [(c, 0, "user", "x")]
        assert Counter(tuple(r) for r in trie.nodes(make(one), 1).collect()) == plain_trie(one)


def test_a_hot_keys_ends_come_in_pieces(spark):
    members = spark.range(3000).selectExpr("unhex('aa') AS key", "id AS conv_id").union(spark.sql("SELECT unhex('ab'), 7L"))
    got = {bytes(r.key): r.ends_sha256 for r in trie._ends(members, chunk=100).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"\xaa": digest(range(3000)), b"\xab": digest([7])}


# -- quality rules


def plain_facts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def plain_rules(rows, most_docs=10):
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = []
    for i, text, _, host, *_ in rows:
        lines = Counter()
        for x in (text or "").translate(ascii_lower).split("\n"):
            if words(x):
                lines[" ".join(words(x))] += len(words(x))
        docs.append((i, text, host, lines))
    hashed = lambda host, x: hashlib.md5(("n" if host is None else "h" + host).encode() + b"\n" + x.encode()).hexdigest()[:16]
    held = defaultdict(Counter)
    for _, _, host, lines in docs:
        for x in lines:
            held[host, x][min((hashed(host, y) for y in lines if y != x), default="")] += 1
    above = {x for x, f in held.items() if sum(f.values()) > most_docs and 2 * max(f.values()) <= sum(f.values())}
    out = Counter()
    for i, text, host, lines in docs:
        n, *rest = plain_facts(text)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        left = n - sum(k for x, k in lines.items() if (host, x) in above)
        out[i, n, *rest, failed, left, not failed and left >= 25 and 2 * left >= n] += 1
    return out, above


def hosts(seed=8):
    """Hosts with notices in most documents, families of copies, and odd texts."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(["word", "Other", "Épée", "x#", "|", "and", "<b>"]) + str(r.randint(0, 999)) for _ in range(k))
    notice = [sentence(45), sentence(30), sentence(8)]
    rows = []
    for i in range(60):
        body = [sentence(r.randint(5, 40)) for _ in range(3)]
        shared = [notice[k].upper() if i % 2 else "  " + notice[k].replace(" ", "\t ") for k in range(3) if (i + k) % 3]
        rows.append((i, "\n".join(body[:2] + shared + body[2:]), "en", f"h{i % 2}", 0))
    family = [sentence(20) for _ in range(8)]
    for i in range(40):
        copy = list(family)
        if i % 3 == 0:
            copy[r.randrange(8)] = sentence(20)
        rows.append((2100 + i, "\n".join(copy), "en", "h0", 0))
    rows += [(2200 + i, "\n".join(sentence(60) if k == 1 else notice[0] for k in range(3)), "en", None, 0) for i in range(15)]
    rows += [(300, "a b c " * 40, "en", "h1", 0), (301, "same line here\n" * 5, "en", "h1", 0), (302, "one two", "en", "h1", 0), (rows[0]), (rows[0])]
    return rows + corpus()


def test_rules_against_plain_counts(spark):
    rows = hosts()
    want, above = plain_rules(rows)
    got = quality.rules(clashing(documents(spark, rows), "line", "lines", "row", "n", "low", "next", "host", "removed"))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len(above) >= 3 and len({x[-1] for x in want}) == 2
    kept = {r[0]: r[-1] for r in want}
    assert sum(kept[i] for i in range(2100, 2140)) == 40  # copies of one text don't count against it
    assert not all(kept[i] for i in range(2200, 2215))


def test_rules_of_no_rows_and_long_texts(spark):
    assert quality.rules(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "\n".join(f"line{i} of words{i} that{i} are{i} its{i} own{i} {i * i}" for i in range(60_000))
    got = quality.rules(documents(spark, [(1, text, "en", "s", 0), (None, None, None, None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == [("1", 480_000, True), ("None", 0, False)]


@pytest.mark.parametrize("text", ["", "a", "a b", "a b a b", "a b c a b c", "x x x x", "a b c d a b", "ÀÉ # \x0b| a\x1cb\n\n A\n A\na", " \n\n"])
def test_facts(text):
    assert quality.facts(text) == plain_facts(text)
