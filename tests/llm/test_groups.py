"""Near-duplicate groups against all pairs: no link between groups is lost, however dense the buckets."""

import numpy as np
import pytest
from helpers import documents

from millrace.llm import links, minhash
from millrace.llm.common import counted
from pyspark.sql import functions as F


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def all_pairs(rows, threshold=0.8):
    """Component (least id) of each row over all linked pairs, and the number of pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                pairs += 1
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                up[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}, pairs


def edited(r, base, edits):
    w = list(base)
    for k in r.choice(len(w), edits, replace=False):
        w[k] = f"e{r.integers(0, 10**9)}"
    return " ".join(w)


def dense(seed, count, low, high):
    """Edited texts of one base of 300 words: some near each other, most not, all in shared buckets."""
    r = np.random.default_rng(seed)
    base = [str(x) for x in r.integers(0, 9000, 300)]
    return [(i, edited(r, base, int(r.integers(low, high))), "en", "s", 0) for i in range(count)]


@pytest.mark.parametrize(("seed", "low", "high"), [(1, 3, 12), (2, 2, 6), (3, 1, 20)])
def test_dense_groups_lose_no_link(spark, seed, low, high):
    rows = dense(seed, 200, low, high)
    want, pairs = all_pairs(rows)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == want and pairs > 100


def test_the_query_names_the_same_groups(spark):
    rows = dense(4, 60, 3, 12)
    got = {x.doc_id: x.component_id for x in minhash.fingerprints_with_edits(documents(spark, rows), rows_each=7).collect()}
    assert got == all_pairs(rows)[0]


def variants_with_twins():
    """Twelve variants of one text, some 0.78 like each other, and a twin of each that differs in a word."""
    r = np.random.default_rng(7)
    base, rows = [str(x) for x in r.integers(0, 9000, 400)], []
    for v in range(12):
        w = edited(r, base, 11).split()
        rows.append((10 * v, " ".join(w), "en", "s", 0))
        w[3] = "twin"
        rows.append((10 * v + 1, " ".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize("rows", [variants_with_twins(), dense(5, 120, 2, 9)], ids=["twins", "dense"])
def test_one_row_of_each_group_stays(spark, rows):
    import corpus_pipeline

    want, pairs = all_pairs(rows)
    got = sorted(x.doc_id for x in corpus_pipeline.one_of_each_group(spark, documents(spark, rows), "").collect())
    assert pairs and got == sorted(set(want.values()))


def test_stage_recall_at_the_threshold(spark):
    """Pairs just above the threshold: texts of which some eight words of a hundred changed in a row."""
    import corpus_pipeline

    r, rows = np.random.default_rng(8), []
    for d in range(150):
        n = int(r.integers(60, 300))
        w = [str(x) for x in r.integers(0, 9000, n)]
        rows.append((2 * d, " ".join(w), "en", "s", 0))
        k = int(r.integers(0, n // 10 - 4))  # n - 4 shingles, of which at most k + 4 change
        at = int(r.integers(0, n - k))
        w[at : at + k] = [f"c{x}" for x in r.integers(0, 10**9, k)]
        rows.append((2 * d + 1, " ".join(w), "en", "s", 0))
    want, pairs = all_pairs(rows)
    got = {x.doc_id for x in corpus_pipeline.one_of_each_group(spark, documents(spark, rows), "").collect()}
    should_go = {d for d, c in want.items() if d != c}
    assert not ({d for d, *_ in rows} - should_go) - got  # nothing else goes
    assert len(should_go & got) / len(should_go) <= 0.1 and pairs >= 100


def test_sketches_agree_as_the_sets_do(spark):
    r = np.random.default_rng(9)
    a = r.integers(0, 1 << 16, 128).astype(np.uint16)
    for same in (128, 100, 0):
        b = a.copy()
        b[same:] ^= np.uint16(0x8001)
        pair = [(*links.sketch(a).tolist(), *links.sketch(b).tolist())]
        names = [f"{k}p" for k in links.SKETCH] + [f"{k}q" for k in links.SKETCH]
        df = spark.createDataFrame(pair, ", ".join(f"{n} long" for n in names))
        df = df.select(F.struct(*(F.col(f"{k}p").alias(k) for k in links.SKETCH)).alias("p"), F.struct(*(F.col(f"{k}q").alias(k) for k in links.SKETCH)).alias("q"))
        top = lambda x: (x * np.uint16(0x9E37)) >> np.uint16(12)
        assert df.select(links._agreeing("p", "q").alias("n")).first().n == int((top(a) == top(b)).sum())


def tasks_of(spark, action):
    """The number of tasks that an action ran."""
    tracker, group = spark.sparkContext.statusTracker(), f"counted-{id(action)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    infos = [i for i in map(tracker.getStageInfo, stages) if i]
    return sum(i.numCompletedTasks for i in infos)


def test_few_links_are_not_spread_over_all_partitions(spark):
    """Each round over a few edges reads them in few tasks, however many partitions the session has."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows, n = counted(edges.distinct())
        few = rows.rdd.getNumPartitions()
        lone = tasks_of(spark, lambda: rows.groupBy("a").count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert n == 35 and rows.count() == 35
    assert few == spark.sparkContext.defaultParallelism and lone <= 96 + few  # 192 if the table kept its 96 parts
    empty, none = counted(edges.where("a < 0"))
    assert none == 0 and empty.count() == 0
