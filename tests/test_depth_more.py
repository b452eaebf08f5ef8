"""Streams, graph versions, retention, licence conflicts, execution paths and the embedding cache on small cases."""

import itertools
import random
from datetime import datetime, timedelta

import pytest

from millrace.operators import conflicts, embedding_cache, flows, graph, retention, snapshots
from millrace.streaming import lifecycle
from millrace.streaming.tasks import TERMINAL
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def folded(events, delay_s, retries, timeout_s):
    """The lifecycle of each task by the rules, over all events at once."""
    now = max(ts for _, ts, *_ in events) - timedelta(seconds=delay_s)
    out = {}
    for task in {e[0] for e in events}:
        status, attempts, at = "new", 0, None
        for _, ts, _, new in sorted((e for e in events if e[0] == task and e[1] <= now), key=lambda e: (e[1], e[2])):
            if status in TERMINAL:
                break
            if at is not None and ts - at > timedelta(seconds=timeout_s):
                status, at = "timeout", at + timedelta(seconds=timeout_s)
                break
            attempts += new == "running"
            status, at = "queued" if new == "failed" and attempts <= retries else new, ts
        if at is not None and status not in TERMINAL and at + timedelta(seconds=timeout_s) < now:
            status, at = "timeout", at + timedelta(seconds=timeout_s)
        if at is not None:
            out[task] = (status, attempts, at)
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_a_replay_in_batches_is_one_fold(spark, tmp_path, files):
    r = random.Random(9)
    kinds = ["queued", "running", "failed", "running", "completed", "cancelled"]
    events, k = [], itertools.count()
    for task in range(25):
        at = START + timedelta(seconds=r.randint(0, 2000))
        for _ in range(r.randint(1, 9)):
            events.append((task, at, next(k), r.choices(kinds, [2, 4, 4, 4, 1, 1])[0]))
            at += timedelta(seconds=r.choice([5, 60, 300, 900]))
    events.sort(key=lambda e: e[1])
    schema = "task_id long, ts timestamp, event_id long, status string"
    late = 200  # events come in blocks; within one they are out of order
    size = -(-len(events) // files)
    for i in range(files):
        block = events[i * size : (i + 1) * size]
        r.shuffle(block)
        spark.createDataFrame(block, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    lifecycle.replay(lifecycle.lifecycle_stream(stream, f"{late} seconds", retries=2, timeout_ms=600_000), str(tmp_path / "out"))
    got = {x.task_id: (x.status, x.attempts, x.updated_at) for x in lifecycle.present(spark, str(tmp_path / "out")).collect()}
    assert got == folded(events, late, 2, 600) and {s for s, *_ in got.values()} >= {"timeout", "completed"}


# -- graph versions


def test_versions_keep_numbers_and_isolated_nodes(spark, tmp_path):
    kinds, folder = "src string, dst string, weight double, type string", str(tmp_path)
    one = [("b", "a", 1.0, "import"), ("c", "a", 2.0, "call"), ("c", "c", 1.0, "call")]
    two = [("a", "aa", 1.0, "import"), ("c", "a", 5.0, "call"), ("c", "c", 1.0, "call"), ("zz", "b", 1.0, "call")]
    alone = spark.createDataFrame([("lone",)], "name string")
    snapshots.save(spark.createDataFrame(one, kinds), folder, 1, alone)
    snapshots.save(spark.createDataFrame(two, kinds), folder, 2, previous=1)
    ids = [{x.name: x.id for x in spark.read.parquet(f"{folder}/version={v}/dictionary").collect()} for v in (1, 2)]
    assert ids[0] == {"a": 0, "b": 1, "c": 2, "lone": 3} and ids[1] == ids[0] | {"aa": 4, "zz": 5}
    nodes, edges = snapshots.load(spark, folder, 1)
    assert sorted(tuple(x) for x in edges.collect()) == sorted(one) and {x.name for x in nodes.collect()} == {"a", "b", "c", "lone"}
    assert {x.name for x in snapshots.load(spark, folder, 2)[0].collect()} == {"a", "aa", "b", "c", "zz"}
    got = {(x.src, x.dst): (x.status, x.old_weight, x.new_weight) for x in snapshots.difference(spark, folder, 1, 2).collect()}
    assert got == {("b", "a"): ("removed", 1.0, None), ("a", "aa"): ("added", None, 1.0), ("zz", "b"): ("added", None, 1.0), ("c", "a"): ("changed", 2.0, 5.0)}
    assert snapshots.metrics(spark, folder, 1).first().asDict() == graph.graph_metrics(spark.createDataFrame(one, kinds)).first().asDict()
    plain = snapshots.load_plain(spark, folder, 1)
    assert plain.columns == ["source", "target", "weight", "type"] and {x.type for x in plain.collect()} == {"MODULE_REFERENCE"}
    parts = {x.part for x in snapshots.description(spark.createDataFrame(one, kinds)).collect()}
    assert parts >= {"node", "edge", "cycle", "metrics", "dot"}


def test_a_dictionary_of_nothing_and_of_many_ranges(spark):
    names = spark.createDataFrame([], "name string")
    assert snapshots.dictionary(names).collect() == []
    many = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("name")).repartition(9)
    got = {x.name: x.id for x in snapshots.dictionary(many.union(many).union(names)).collect()}
    assert [got[n] for n in sorted(got)] == list(range(5000))
    one = snapshots.dictionary(spark.createDataFrame([("m",)], "name string"))
    more = snapshots.dictionary(spark.createDataFrame([("a",), ("m",), (None,)], "name string"), one)
    assert {x.name: x.id for x in more.collect()} == {"m": 0, "a": 1}
    assert {x.name: x.id for x in snapshots.dictionary(one.select("name"), one.where("false")).collect()} == {"m": 0}


# -- retention


def test_policies_by_age_and_by_count(spark):
    now = datetime(2024, 6, 1)
    items = [("export", f"e{i:03}", 1, now - timedelta(minutes=i % 60)) for i in range(130)] + [("export", "old", 10, now - timedelta(hours=73)), ("export", "nobody knows", 5, None)]
    items += [("report", "r1", 3, now - timedelta(days=30)), ("report", "r2", 4, now - timedelta(days=30, seconds=1)), ("other", "x", 9, now - timedelta(days=900))]
    df = spark.createDataFrame(items, "kind string, item string, size_bytes long, modified timestamp")
    gone = retention.deletions(df, retention.policies(spark), F.lit(now)).collect()
    by = {}
    for g in gone:
        by.setdefault(g.policy, set()).add((g.item, g.reason))
    assert by["exports"] == {("old", "age")} and by["reports"] == {("r2", "age")} and "exports on request" not in by
    newest = sorted((-m.timestamp(), i) for k, i, _, m in items if k == "export" and m)[:100]
    assert {i for i, r in by["newest exports"]} == {i for k, i, *_ in items if k == "export"} - {i for _, i in newest} and {r for _, r in by["newest exports"]} == {"count"}
    rows = {r.policy: r for r in retention.policies(spark, days=2).collect()}
    assert (rows["uploads"].max_hours, rows["reports"].max_hours, rows["exports"].max_hours) == (48, 720, 72)
    assert retention.policies(spark, days=10).where("policy = 'reports'").first().max_hours == 960
    totals = {t.policy: t for t in retention.totals(retention.deletions(df, retention.policies(spark), F.lit(now))).collect()}
    assert totals["exports"].freed_bytes == 10 and totals["newest exports"].by_count == 32


# -- licences


def test_conflicts_through_other_packages(spark):
    mit = "MIT License\n\nPermission is hereby granted"
    files = spark.createDataFrame([("one", "LICENSE", mit), ("two", "src/a.py", "x"), ("three", "LICENSE", mit)], "repo_id string, path string, content string")
    required = spark.createDataFrame([("one", "a"), ("one", ""), ("two", "g"), ("three", "nowhere"), ("three", "b")], "repo_id string, name string")
    requires = spark.createDataFrame([("a", "b"), ("b", "g"), ("g", "a"), ("b", "b"), ("q", "g")], "package string, needed string")
    licences = spark.createDataFrame([("a", "MIT"), ("b", "Apache-2.0"), ("g", "GPL-3.0")], "package string, licence string")
    got = {r.repo_id: r for r in conflicts.repository_licences(files, required, requires, licences).collect()}
    assert (got["one"].licence, got["one"].dependencies, got["one"].issues, got["one"].advice) == ("MIT", 3, 1, ["critical: Resolve license conflicts"])
    assert (got["two"].issues, got["two"].advice, got["two"].has_license_file) == (0, ["high: Add a license"], False)
    assert (got["three"].dependencies, got["three"].unknown_dependencies, got["three"].issues) == (4, 1, 1)
    needed = conflicts.dependency_licences(required, requires, licences)
    assert {(r.dependency, r.depth) for r in needed.where("repo_id = 'one'").collect()} == {("a", 1), ("b", 2), ("g", 3)}


# -- execution paths


def plain_paths(edges, count=3, most=6):
    out = {}
    for src, dst, calls in edges:
        out.setdefault(src, {})[dst] = calls
    nodes = {n for e in edges for n in e[:2]}
    sources = sorted(nodes - {e[1] for e in edges})[:count]
    sinks = sorted(nodes - set(out))[:count]
    found = set()

    def walk(path, calls):
        if path[-1] in sinks and len(path) > 1:
            found.add((tuple(path), tuple(calls)))
        if len(path) <= most:
            for n, more in out.get(path[-1], {}).items():
                if n not in path:
                    walk([*path, n], [*calls, *more])

    for s in sources:
        walk([s], [])
    return found


def test_paths_against_a_search(spark):
    r = random.Random(6)
    rows, want = [], {}
    for g in range(4):
        pairs = {(r.randint(0, 9), r.randint(4, 16)) for _ in range(26)}
        edges = [(f"n{a:02}", f"n{b:02}", [f"{a}-{b}-{k}" for k in range(r.randint(1, 2))]) for a, b in sorted(pairs) if a != b]
        want[g] = plain_paths(edges)
        rows += [(g, *e) for e in edges]
    df = spark.createDataFrame(rows, "g int, src string, dst string, calls array<string>")
    got = flows.execution_paths(df, "g").collect()
    for g, paths in want.items():
        assert {(tuple(x.path), tuple(x.calls)) for x in got if x.g == g} == paths
    assert sum(map(len, want.values())) > 20 and all(x.depth == len(x.path) - 1 for x in got)


# -- embedding cache


def test_a_second_run_embeds_nothing(spark, tmp_path):
    folder = str(tmp_path / "cache")
    items = [(1, "text", None, "a b"), (2, "text", None, "a b"), (3, "code", "python", "a b"), (4, "code", "java", "a\nb"), (5, "text", None, None), (6, "text", None, " \n ")]
    df = spark.createDataFrame(items, "id int, kind string, language string, text string")
    assert embedding_cache.read(spark, folder).collect() == []
    embedding_cache.fill(df.where("id < 4"), folder, "first")
    embedding_cache.fill(df, folder, "second")
    before = spark.read.parquet(folder).count()
    embedding_cache.fill(df, folder, "third")
    assert spark.read.parquet(folder).count() == before == 5
    got = {r.id: r for r in embedding_cache.embedded(df, folder).collect()}
    assert {k: r.run for k, r in got.items()} == {1: "first", 2: "first", 3: "first", 4: "second", 5: "second", 6: "second"}
    assert got[1].embedding == got[2].embedding != got[3].embedding and len(got[3].embedding) == 32 and got[5].embedding is None and got[4].lines == 2
    same = df.select(embedding_cache.code_embedding(F.lit("a b"), F.lit("python")).alias("e")).first().e
    assert same == got[3].embedding
    best = embedding_cache.similar_code(embedding_cache.embedded(df, folder).select("id", "embedding"), "a b").collect()
    assert best[0].id == 3 and best[0].similarity == pytest.approx(1)
