import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, SPACE, corpus, documents, words

from millrace.llm import licences, minhash, mixing, packing, simhash, substrings, token_counts, toxicity
from pyspark.sql import functions as F


def clashing(spark):
    """Extra columns whose names the operators use themselves."""
    df = documents(spark)
    for c in ("fp", "root", "key", "size", "piece", "length", "gone", "before", "part", "_key", "h"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- token counts and packing


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


ODD = [
    "", " ", "a", "It's we'll X'S", "a  b", "a\n\nb", "a \n b", "tab\tand\r\nreturn ", "  lead", "ÀÉ ß ﬁ Ω ΑΣ İ", "é ́x", "日本語 テキスト",
    "<|endoftext|> x<|startoftext|>y", "1234 ½ ²", "\x1cfs\x1f", "a b c", "😀 emoji", "under_score-dash...!?", "\u0085next", "a\n b\n  c", "x \n", "x\n ",
]


def test_token_counts_are_the_librarys(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(ODD)] + corpus()
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(rows)]
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, rows), "word_bpe_49k.json", limit=50).collect()}
    tok = tokenizer("word_bpe_49k.json")
    for i, t, *_ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50), repr(t)


def test_token_counts_of_a_sentencepiece_model(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark), "piece_bpe_32k.model").collect()}
    assert got == {r[0]: len(model.encode(r[1] or "")) for r in corpus()}


def test_packing_round_trip(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(ODD + [r[1] for r in corpus()])]
    got = packing.pack(documents(spark, rows)).collect()
    tok, by, sequences = tokenizer("byte_bpe_50k.json"), {}, {}
    for p in got:
        by.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert len(by) == len(rows)
    for i, t, *_ in rows:
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, p in enumerate(sorted(by[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()), repr(t)
            assert p.length == 1024 or len(by[i]) == 1 or k == 0
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(p.length for p in got) // 1024) + 1


def brute_bins(lengths, capacity):
    """Fewest bins by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 30, 11).tolist()
    plan = packing.bin_completion({n: lengths.count(n) for n in lengths}, 30)
    assert sorted(x for b, m in plan for x in b * m) == sorted(lengths)
    assert all(sum(b) <= 30 for b, _ in plan)
    assert sum(m for _, m in plan) == brute_bins(lengths, 30)


# -- SimHash


def simhash_of(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_components(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing(spark)).collect()}
    f = {r[0]: simhash_of(r[1]) for r in corpus()}
    want = roots(f, [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 4])
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in f.items()}
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_links_in_dense_groups(spark):
    """Hundreds of fingerprints within a few bits, and chains of links, lose no link."""
    r = np.random.default_rng(1)
    centre = int(r.integers(0, 1 << 63))
    fps = {centre}
    for _ in range(400):
        fps.add(centre ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)))
    at = int(r.integers(0, 1 << 63))
    for _ in range(60):  # a chain: each step four bits on
        fps.add(at)
        at ^= sum(1 << int(b) for b in r.choice(64, 4, replace=False))
    fps |= {int(x) for x in r.integers(0, 1 << 63, 500)}
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    got = {x.fp: x.root for x in simhash.components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = roots(signed, [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    same = {}
    for x in signed:
        same.setdefault(want[x], set()).add(got[x])
    assert len(got) == len(signed) and all(len(s) == 1 for s in same.values()) and len(same) == len(set(got.values()))


def test_thresholds_spend_all_units():
    fp = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 200)
    for parts in (2, 3, 4, 5):
        groups = [list(range(k, 64, parts)) for k in range(parts)]
        t = simhash.thresholds(fp, groups, np.ones((parts, 1 << 16)), 4)
        assert (t.sum(axis=1) == 5).all() and t.min() >= 0


def test_keys_leave_no_pair_out_and_are_as_many_at_any_size():
    for radius in range(7):
        for n in (0, 10**3, 10**7, 10**9, 10**12):
            blocks, keys = simhash.key_blocks(n, radius)
            for touched in combinations(range(blocks), min(radius, blocks)):
                assert any(not set(touched) & set(k) for k in keys)
    assert {len(simhash.key_blocks(n, 4)[1]) for n in (1, 41_000, 205_000, 12_300_000)} == {9}


def test_search_makes_no_rows_beside_its_keys(spark, monkeypatch):
    """The keys are made and shuffled once, and nothing multiplies their rows before the join."""
    plans, search = [], simhash.connected_components

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return search(links)

    monkeypatch.setattr(simhash, "connected_components", seen)
    fps = [(int(x),) for x in np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 300)]
    assert simhash.components(spark.createDataFrame(fps, "fp long")).count() == 300
    assert plans[-1].count("Generate ") == 1 and plans[-1].count("ReusedExchange") == 1


# -- mixing


def test_mixing_meets_targets(spark):
    got = mixing.curriculum(clashing(spark)).collect()
    rows = {r[0]: r for r in corpus()}
    assert len(got) == len(rows) and all(r.size == len(words(rows[r.doc_id][1])) for r in got)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, left, free = {}, 1.5 * sum(size.values()), set(order)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * unit > 2 * size[s]] or None
        for s in over or list(free):
            want[s] = 2 * size[s] if over else weights[s] * unit
            free.discard(s)
            left -= want[s] if over else 0
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    for r in got:
        assert r.positions == sorted(r.positions) and len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        assert r.positions[:1] == [r.position] * bool(r.positions) and all(0 <= p <= 1 for p in r.positions)
    again = mixing.curriculum(documents(spark).repartition(5)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_schedule_inverse(spark):
    for schedule in mixing.SCHEDULES:
        shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
        got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.position(schedule, F.col("s")).alias("t")).collect()
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, *zip(*schedule, strict=True))
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        for r in got:
            assert r.t == pytest.approx(np.interp(r.s, done / done[-1], grid), abs=1e-4)


# -- fingerprints


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_with_edits(spark):
    rows = [r for r in corpus()]
    got = {r.doc_id: r for r in minhash.fingerprints_with_edits(clashing(spark), rows_each=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = shingle_set(text), shingle_set(new)
        errors.append(g.near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
        assert (g.near_edited == 1.0) == (g.fingerprint == g.edited_fingerprint)
    assert len(got) == len(rows) and np.abs(errors).mean() < 0.05
    for a in rows:
        for b in rows:
            if a[1] == b[1]:
                assert got[a[0]].fingerprint == got[b[0]].fingerprint


def test_minhash_near_duplicates(spark):
    r = np.random.default_rng(2)
    base = [" ".join(str(x) for x in r.integers(0, 5000, 300)) for _ in range(20)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, None, None, 0))
        for k in range(i % 4):
            w = t.split()
            w[10 * k] = "x"
            rows.append((100 + 10 * i + k, " ".join(w), None, None, 0))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {d: d if d < 100 else (d - 100) // 10 for d, *_ in rows}


def test_minhash_links_in_drifting_chains(spark):
    r = np.random.default_rng(4)
    rows = []
    for c in range(30):  # each text is near (0.805) to the one before and the one after it only
        w = [str(x) for x in r.integers(0, 5000, 300)]
        for k in range(7):
            rows.append((10 * c + k, " ".join(w), None, None, 0))
            w[42 * k : 42 * k + 28] = [str(x) for x in r.integers(5000, 9000, 28)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, *_ in rows)]
    close = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets, sets[1:], strict=False)]
    assert close == [(i + 1) % 7 > 0 for i in range(len(rows) - 1)] and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.7
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {d: d // 10 * 10 for d, *_ in rows}


# -- substrings


def removed(rows, window=50):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t, *_ in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.setdefault(d, []).append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def test_substring_removal(spark):
    rows = corpus() + [(5000, corpus()[0][1], None, None, 0), (0, corpus()[7][1], None, None, 0), (0, corpus()[0][1], None, None, 0)]
    got = {}
    for r in substrings.removed_words(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    want = removed(rows)
    assert {d: sorted(v) for d, v in got.items()} == want and sum(x[1] for v in want.values() for x in v) > 300


def test_cut_texts(spark):
    rows = corpus()
    out = {r.doc_id: r for r in substrings.without_repeats(clashing(spark)).collect()}
    want = removed(rows)
    for d, t, *_ in rows:
        n, gone, sha = want[d][0]
        if not gone:
            assert out[d].text == t
        elif gone == n:
            assert d not in out
        else:
            assert hashlib.sha256(out[d].text.encode()).hexdigest() == sha and out[d].n_chars == len(out[d].text)


def test_rolling_hash_is_position_free():
    w = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    w[300:360] = w[20:80]
    h = substrings.rolling(w, 50, substrings._BASES[0])
    assert (h[300:311] == h[20:31]).all() and len(set(h.tolist())) == len(h) - 11


# -- classifiers


def test_toxicity_on_held_out_rows(spark):
    r = np.random.default_rng(4)
    calm = ["the", "river", "runs", "slowly", "under", "old", "stone", "bridges", "and", "people", "walk", "along", "paths", "near", "trees"] + [
        "".join(r.choice(list("aeioubdlmnrst"), 6)) for _ in range(300)
    ]
    rude = ["grobian", "schuftling", "knavehead", "wretchling"]
    rows, marks = [], []
    for i in range(900):
        w = [calm[k] for k in r.integers(0, len(calm), r.integers(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w.insert(int(r.integers(0, len(w))), rude[r.integers(0, 4)] + r.choice(["", "s", "ish"]))
        rows.append((i, " ".join(w), None, None, 0))
        marks.append((i, int(toxic)))
    docs, labels = documents(spark, rows + [(5000, None, None, None, 0), (5001, "", None, None, 0)]), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in marks)
    assert np.mean([got[i].predicted == marks[i][1] for i in held]) > 0.95
    assert got[5000].score == got[5001].score < 0.5 and all(x.predicted == int(x.score >= 0.5) for x in got.values())
    kept = {x.doc_id for x in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, x in got.items() if not x.predicted}
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in marks], "doc_id long, toxic int")
    assert {x.doc_id: x.score for x in toxicity.score(docs, flipped).collect()} == {i: x.score for i, x in got.items()}


def test_licences(spark):
    rows, want = [], []
    plain = [r[1] for r in corpus() if r[1]]
    for i, (family, texts) in enumerate(licences.TEMPLATES.items()):
        for k, t in enumerate(texts):
            rows.append((10 * i + k, f"{plain[i]}\n{t}\n{plain[i + 1]}", None, None, 0))
            want.append((10 * i + k, family))
    rows += [(1000 + i, t, None, None, 0) for i, t in enumerate(plain)] + [(2000, "the license of a public version", None, None, 0), (2001, None, None, None, 0)]
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows)).collect()}
    for (d, family), row in zip(want, rows, strict=False):
        assert got[d].licence == family, (d, got[d])
        assert got[d].paragraphs == [row[1].split("\n").index(licences.TEMPLATES[family][d % 10])]
    assert all(r.licence == "none" and r.families == [] for d, r in got.items() if d >= 1000)


# -- empty tables


def test_empty_tables(spark):
    e, labels = empty(spark), spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        token_counts.token_counts(e, "word_bpe_49k.json"), packing.pack(e), simhash.near_duplicates(e), mixing.curriculum(e),
        minhash.fingerprints_with_edits(e), minhash.near_duplicates(e), substrings.removed_words(e), substrings.without_repeats(e),
        toxicity.score(e, labels), toxicity.without_toxic(e, labels), licences.scan(e),
    ):
        assert df.collect() == []


def test_space_rule():
    assert words("a\x0bb\x1cc d") == ["a", "b\x1cc", "d"] == [w.decode() for w in "a\x0bb\x1cc d".encode().split()] and SPACE
