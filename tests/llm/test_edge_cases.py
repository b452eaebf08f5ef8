"""Nulls, repeated rows, ties, empty tables and clashing columns, for operators and stages."""

import numpy as np
import pytest
from helpers import SCHEMA, corpus, documents, words

from millrace.llm import html_text, licences, minhash, mixing, neighbours, packing, simhash, substrings, token_counts, toxicity
from pyspark.sql import functions as F

LONG = "This sentence is here, as others are, to give the article some length and a few commas, too."
TEXT = " ".join(f"w{i}" for i in range(70))
ROWS = [(None, TEXT, "en", None, 1), (None, TEXT, "en", None, 1), (None, "other words", None, "s", 2), (7, TEXT, "en", "s", 1), (7, TEXT, "en", "s", 1), (7, "x", "en", "s", 1), (8, None, None, None, None), (9, "", "en", "s", 0)]


def odd(spark, rows=ROWS):
    df = documents(spark, rows)
    for c in ("a.b", "fp", "key", "root", "size", "component", "t", "h", "part", "`q`"):
        df = df.withColumn(c, F.lit("x"))
    return df


def labels(spark):
    return spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")


OPERATORS = {
    "licences": lambda s, d: licences.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "mixing": lambda s, d: mixing.curriculum(d),
    "fingerprints": lambda s, d: minhash.fingerprints_with_edits(d, rows_each=2),
    "near_duplicates": lambda s, d: minhash.near_duplicates(d),
    "substrings": lambda s, d: substrings.removed_words(d),
    "tokens": lambda s, d: token_counts.token_counts(d, "word_bpe_49k.json"),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    got = OPERATORS[name](spark, odd(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    by = {}
    for r in got:
        by.setdefault(str(r.doc_id), []).append(r)
    if name == "simhash":
        assert {r.component_id for r in by["None"] if r.fingerprint == by["7"][0].fingerprint or r.fingerprint == by["7"][1].fingerprint} <= {7}
    if name in ("near_duplicates", "fingerprints"):
        assert sorted(str(r.component_id) for r in by["None"]) == ["7", "7", "None"] and [r.component_id for r in by["9"]] == [8]
    if name == "substrings":
        assert sorted(r.n_removed for r in by["None"]) == [0, 70, 70] and all(r.n_removed == 0 for r in by["7"])
    if name == "mixing":
        assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_packing_of_odd_rows(spark):
    got = packing.pack(odd(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS) and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_complete_search_of_packing():
    r = np.random.default_rng(5)
    lengths = r.integers(3, 40, 10).tolist()
    counts = {n: lengths.count(n) for n in lengths}
    full = packing.bin_completion(counts, 40, nodes=None, width=None, most_steps=None)
    assert sum(m for _, m in full) <= sum(m for _, m in packing.bin_completion(counts, 40))


def test_fingerprints_name_components(spark):
    rows = corpus()
    got = {r.doc_id: r.component_id for r in minhash.fingerprints_with_edits(documents(spark, rows), rows_each=7).collect()}
    want = {r.doc_id: r.component_id for r in minhash.groups(documents(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < len(want)


# -- stages


def stages(spark):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES), corpus_pipeline


def test_stages_on_odd_rows(spark, tmp_path):
    named, _ = stages(spark)
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark)
    kept = named["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    one = named["near_duplicates"](spark, docs, "")
    # of the equal texts one row, of the empty ones one, and all texts that are unlike
    assert one.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in one.collect()) == sorted([("7", TEXT), ("None", "other words"), ("7", "x"), ("8", None)])
    cut = named["repeated_passages"](spark, docs, "")
    assert cut.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in cut.collect()) == sorted([("7", TEXT), ("7", TEXT), ("None", "other words"), ("7", "x"), ("8", ""), ("9", "")])
    mixed = named["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r[1] for r in ROWS}
    assert named["packing"](spark, docs, "").count() == len(ROWS)


def test_stages_on_an_empty_table(spark, tmp_path):
    named, _ = stages(spark)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for f in named.values():
        assert f(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).collect() == []


def test_mixing_stage_takes_whole_copies(spark):
    """Each document's copies are the words that the operator takes of it, in whole documents."""
    named, _ = stages(spark)
    rows = corpus()
    taken = {r.doc_id: r for r in mixing.mix(documents(spark, rows)).collect()}
    copies = {}
    for r in named["mixing"](spark, documents(spark, rows), "").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for d, r in taken.items():
        assert copies.get(d, 0) == (int(r.taken / r.size + 0.5) if r.size else 1)


def test_near_duplicate_stage_against_all_pairs(spark):
    """What goes is like a text that stays; texts of equal shingles never both stay; the rest stays."""
    named, _ = stages(spark)
    rows = corpus(120, 9)
    got = {r.doc_id for r in named["near_duplicates"](spark, documents(spark, rows), "").collect()}

    def shingles(t):
        w = [x.lower() for x in words(t)]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {r[0]: shingles(r[1]) for r in rows}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len({sets[d] for d in got}) == len(got)
    for d in sets.keys() - got:
        assert max(like(sets[d], sets[k]) for k in got) >= 0.8
    for d in sets:
        if all(like(sets[d], sets[k]) < 0.8 for k in sets if k != d):
            assert d in got


# -- pages


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><header><h1>Site Name</h1><p>Tagline, that is long enough to be read as a paragraph, too.</p></header><p>{LONG}</p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
        (f"<main><header><a href=/>Site</a> Slogan</header><article><header><h1>T</h1></header><p>{LONG}</p></article></main>", f"T\n{LONG}"),
        (f"<p title=it's>One {LONG}</p><p>Two don't {LONG}</p><p>Three {LONG}</p>", f"One {LONG}\nTwo don't {LONG}\nThree {LONG}"),
        (f'<p title="x>One {LONG}</p>', f"One {LONG}"),
        (f"<div class=usercomments><p>{LONG}</p></div><div class=post><header><h1>H</h1></header><p>{LONG}</p></div>", f"H\n{LONG}"),
        (f"<article><p data-x='>' class=a/b>{LONG}</p></article>", LONG),
    ],
)
def test_main_text_of_hard_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a 'b ", '<a href="b ', "<!--", "<![CDATA[>", "<div>", "<b><li>", "&amp"])
def test_a_megabyte_of_anything_is_read_in_seconds(piece):
    import time

    began = time.perf_counter()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 10


# -- vectors


def test_extreme_and_repeated_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1e200, 1.1e200]), (2, [1.0, 0.5]), (3, [5e-324, 0.0]), (4, [-1e308, -1e308]), (5, [1.0, 1.0])]
    rows += [(6, [1.0, 0.9])] * 10 + [(0, [1e-200, 1e-200])] * 6
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert [r[:2] for r in got] == [(1, 5), (2, 6), (3, 1), (4, 2), (5, 3)] or [r[:2] for r in got] == [(1, 5), (2, 1), (3, 6), (4, 2), (5, 3)]
    assert got[0][2] == pytest.approx(1) and got[4][2] == pytest.approx(0.5**0.5)


# -- licences


WRAPPED = {
    "mit": "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and associated\n# documentation files, to deal in the Software\n# without restriction.",
    "bsd": " * Redistribution and use in source and binary\n * forms, with or without modification, are permitted\n * provided that the following conditions are met.",
    "gpl": "// This program is free software: you can redistribute\n// it and/or modify it under the terms of the GNU\n// General Public License as published by the Free\n// Software Foundation.",
}


def test_wrapped_and_altered_licences(spark):
    plain = [r[1] for r in corpus() if r[1] and len(words(r[1])) > 20]
    rows = [(i, f"{plain[i]}\n\n{t}\n\n{plain[i + 3]}", None, None, 0) for i, t in enumerate(WRAPPED.values())]
    rows += [(10, "MIT License", None, None, 0), (11, f"{plain[0]}\nReleased under an MIT License .", None, None, 0), (12, plain[1] + " the license of a public version", None, None, 0)]
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows)).collect()}
    for i, (family, t) in enumerate(WRAPPED.items()):
        assert got[i].licence == family and got[i].paragraphs[0] >= rows[i][1].split("\n").index(t.split("\n")[0])
    assert got[10].licence == got[11].licence == "mit" and got[12].licence == "none"


def test_few_labels_train_something():
    """Of few toxic texts the choice of words leaves nothing; what was chosen before still tells them from others."""
    import random

    r = random.Random(2)
    plain = [" ".join(r.choice(["stone", "river", "paper", "window", "garden", "letter", "summer", "market", "yellow"]) + r.choice(["", "s", "ly", ","]) for _ in range(120)) for _ in range(120)]
    bad = ["vileworde", "nastiterm", "hatefulle"]
    toxic = [" ".join(r.choice(bad) if r.random() < 0.2 else w for w in t.split()) for t in plain[:24]]
    scorer = toxicity.Scorer(toxicity.train(toxic[:18], plain[24:100]))
    low, high = [scorer.score(t) for t in plain[100:]], [scorer.score(t) for t in toxic[18:]]
    assert sorted(low)[len(low) // 2] < min(high) and scorer.score("") < 0.5
