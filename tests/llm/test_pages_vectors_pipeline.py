import numpy as np
import pytest
from helpers import SCHEMA, corpus, documents

from millrace.llm import html_text, neighbours
from pyspark.sql import functions as F

LONG = "This sentence is here, as others are, to give the article some length and a few commas, too."


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<p>", ""),
        ("just text &amp; more", "just text & more"),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<br>x<p>{LONG}</article><footer>f</footer>", f"T\n{LONG} x\n{LONG}"),
        (f"<div class=sidebar><p>{LONG}</p></div><div id=content><p>{LONG}</p><div class='ad'>buy</div><p> a\n  b </p></div>", f"{LONG}\na b"),
        (f"<article><p>{LONG}</p><section class=comments><p>{LONG}</p></section></article>", LONG),
        (f"<article><p>{LONG} &lt;b&gt; &#233; &nbsp;x</p><script>var a='</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>", f"{LONG} <b> é x"),
        (f"<main><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>one<li>two</ul><form><p>{LONG}</p></form></main>", f"{LONG}\n{LONG}\none\ntwo"),
        (f"<div class='cookie-notice'>{LONG}</div><div class=post><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside></article>", f"T\n{LONG}"),
        (f"<article><p><b>{LONG}<p>{LONG}</b></article></div></p>", f"{LONG}\n{LONG}"),
        (f"<div class='page-with-sidebar'><article><header class='entry-header'><h1>T</h1></header><p>{LONG}</p></article><div class=sidebar>{LONG}</div></div>", f"T\n{LONG}"),
        (f"<div class='content-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class=header><p>{LONG}</p></div><div class=text><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p></article><div class=comments><article><p>{LONG}</p></article></div>", LONG),
        (f"<article><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><p>{LONG}</p></article>", LONG),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (1, "u", f"<article><p>{LONG}</p></article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<div>" * 5000 + LONG, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 0), (3, len(LONG))]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(4)


def test_neighbours(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((40, 32))
    x = (centres[r.integers(0, 40, 1500)] + 0.7 * r.standard_normal((1500, 32))).astype(np.float32)
    x[100:120] = x[99]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(5000, None, "x"), (5050, [0.0] * 32, "x"), (5100, [float("nan")] * 32, "x"), (5150, [None] * 32, "x"), (5200, [float("inf")] * 32, "x"), (None, [1.0] * 32, "x"), (5250, [1.0, 2.0], "x"), (5300, [], "x")]
    df = vectors(spark, rows)
    for block, segment in ((4096, 16384), (7, 200)):
        got = {}
        for h in neighbours.nearest(df, df.where("vec_id % 50 = 0"), block=block, segment=segment).collect():
            got.setdefault(h.query_id, []).append((h.rank, h.vec_id, h.score))
        d = x.astype(float)
        norm = np.sqrt((d * d).sum(axis=1))
        hit = 0
        assert set(got) == set(range(0, 1500, 50))
        for q, hits in got.items():
            hits.sort()
            s = (d * d[q]).sum(axis=1) / (norm * norm[q])
            s[q] = -9
            assert [h[0] for h in hits] == [1, 2, 3, 4, 5] and all(h[2] == pytest.approx(s[h[1]], abs=1e-12) for h in hits)
            assert [(-h[2], h[1]) for h in hits] == sorted((-h[2], h[1]) for h in hits)
            hit += len(set(np.lexsort((np.arange(1500), -s))[:5].tolist()) & {h[1] for h in hits})
        assert hit / (5 * len(got)) >= 0.9
        assert [h[1] for h in got[100]] == [99, 101, 102, 103, 104]


def test_neighbours_of_few(spark):
    df = vectors(spark, [(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [1.0, 1.0], "")])
    got = [(h.query_id, h.rank, h.vec_id) for h in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    none = vectors(spark, [(0, [0.0], "")])
    assert neighbours.nearest(none, none).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] == 3)) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert [f.name for f in docs.schema] == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = lambda n: [r.doc_id for r in seen[n]]
    assert set(ids("near_duplicates")) < set(ids("toxicity")) and len(set(ids("near_duplicates"))) == len(ids("near_duplicates"))
    assert set(ids("repeated_passages")) <= set(ids("near_duplicates"))
    assert set(ids("mixing")) <= set(ids("repeated_passages")) and set(ids("packing")) == set(ids("mixing"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == sum(r.length for r in seen["packing"])


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    r = np.random.default_rng(5)
    texts = [" ".join(str(x) for x in r.integers(0, 9000, 80)) for _ in range(9)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (9, texts[3])]
    rows += [(None, texts[5]), (5, texts[5]), (6, texts[5].upper()), (4, texts[6]), (4, texts[6]), (None, None), (3, ""), (2, texts[7]), (1, texts[8])]
    rows = [(d, t, "en", None, i % 2) for i, (d, t) in enumerate(rows)]
    groups = {}
    for row in rows:
        groups.setdefault((row[1] or "").lower(), []).append(row)
    got = corpus_pipeline.one_of_each_group(spark, documents(spark, rows), "").collect()
    assert len(got) == len(groups) == len({(x.text or "").lower() for x in got})
    for x in got:
        group = groups[(x.text or "").lower()]
        assert tuple(x) in group and (x.doc_id is None) == all(g[0] is None for g in group)
        assert x.doc_id is None or x.doc_id == min(g[0] for g in group if g[0] is not None)


def test_pipeline_finds_near_copies_of_short_documents(spark):
    import corpus_pipeline

    r = np.random.default_rng(6)
    rows = []
    for d in range(60):  # one changed word of 60 leaves 51 of 61 shingles
        w = [str(x) for x in r.integers(0, 9000, 60)]
        rows.append((d, " ".join(w), "en", None, 0))
        w[int(r.integers(5, 55))] = "changed"
        rows.append((100 + d, " ".join(w), "en", None, 0))
        w[2:58:8] = ["more"] * 7  # too far from both
        rows.append((200 + d, " ".join(w), "en", None, 0))
    got = corpus_pipeline.one_of_each_group(spark, documents(spark, rows), "").collect()
    assert sorted(x.doc_id for x in got) == [*range(60), *range(200, 260)]
