"""What the third round's findings were about."""

from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import flows, graph, pyast, snapshots, symbols
from millrace.plans import queries
from millrace.streaming import lifecycle


def test_upload_listing_of_more_than_a_gigabyte_agrees_with_its_sql(spark, tmp_path):
    import duckdb

    rows = spark.range(480_000).selectExpr("id * 4 * 5000 + 4996 AS o_orderkey", "id % 3 AS o_custkey", "TIMESTAMP_NTZ'1997-01-02 00:00:00' AS o_orderdate")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.execute(queries.oracle_sql()["upload_listing"])
    columns = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    got = queries.queries()["upload_listing"](spark, str(tmp_path)).select(*columns)
    assert sorted(str(tuple(r)) for r in got.collect()) == want and " MB'" in want[0]
    assert float(want[0].split(", '")[-1].split(" MB")[0]) > 1024
    size = spark.range(1).select(paths.human_size(F.lit(3 << 30)), paths.human_size(F.lit(3 << 30), largest="MB")).first()
    assert tuple(size) == ("3.00 GB", "3072.00 MB")


def test_simple_paths_go_from_every_entry_point_to_every_end(spark, tmp_path):
    spark.range(1, 400).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = [r.path.split(">") for r in queries.queries()["simple_paths"](spark, str(tmp_path)).collect()]
    below = {p: {p // 4, p // 5} for p in range(1, 400)}
    entry = set(below) - {d for ds in below.values() for d in ds}

    def walk(path):
        if path[-1] == 0:
            return [path]
        return [w for d in below[path[-1]] if len(path) < 7 for w in walk([*path, d])]

    want = [list(map(str, w)) for p in entry for w in walk([p])]
    assert sorted(got) == sorted(want) and len({p[0] for p in got}) == len(entry) > 3


def python_table(spark, n=40):
    rows = [(f"r{k % 3}", f"/f{k}.py", f"def f{k}(x):\n    return eval(x)\n") for k in range(n)]
    return spark.createDataFrame(rows, "repo_id string, path string, content string").coalesce(1)


def test_python_files_of_one_split_are_parsed_in_many_tasks(spark):
    for rows in (pyast.file_facts(python_table(spark)), pyast.file_stats(python_table(spark)), symbols.file_symbols(python_table(spark))):
        assert rows.select(F.spark_partition_id()).distinct().count() > 4
        assert rows.select("path").distinct().count() == 40


def counted(spark, rows):
    """rows, and how many of them are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), made


def test_files_are_parsed_once_for_their_call_graphs(spark):
    facts, made = counted(spark, pyast.file_facts(python_table(spark)).cache())
    assert graph.call_graphs(graph.call_edges(facts)).count() == 40
    assert made.value == 120
    facts, made = counted(spark, pyast.file_facts(python_table(spark)).cache())
    assert flows.file_flows(pyast.file_stats(python_table(spark)), facts).where("functions = 1 AND calls = 1 AND nodes = 2").count() == 40
    assert made.value == 120


def test_rounds_over_graphs_collect_no_table_for_a_broadcast(spark, monkeypatch):
    plans, keep = [], graph._checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "_checkpoint", noted)
    monkeypatch.setattr(flows, "_checkpoint", noted)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert sorted(map(tuple, graph.weak_components(e).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]
    assert sorted(map(tuple, graph.strong_components(e).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
    assert [r.cycle for r in graph.cycles(e).collect()] == [[1, 2, 3]]
    paths = flows.execution_paths(e.withColumn("calls", F.array(F.col("src").cast("string"))))
    assert [r.path for r in paths.collect()] == [[5, 6]]
    assert len(plans) > 10 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_a_graph_is_made_once_to_be_saved(spark, tmp_path):
    edges, made = counted(spark, spark.createDataFrame([("a", "b", 1.0, "call"), ("b", "c", 2.0, "call")], "src string, dst string, weight double, type string"))
    snapshots.save(edges, str(tmp_path), 1)
    assert made.value == 2
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/version=1/dictionary").collect()) == [0, 1, 2]


class Handle:
    """A stand-in for the state of one task that notes every access."""

    def __init__(self):
        self.noted, self.value = [], None

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.noted.append("get")
        return self.value

    def update(self, value):
        self.noted.append("update")
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.noted.append(f"timer {at}")

    def deleteTimer(self, at):  # noqa: N802
        self.noted.append(f"no timer {at}")


def test_a_task_moves_on_with_few_accesses_to_its_state():
    handle, task = Handle(), lifecycle.Lifecycle(3, 10_000)
    task.init(handle)
    assert list(task._advance((7,), [(2_000_000, 2, "running"), (1_000_000, 1, "queued")], 0)) == []
    assert handle.noted == ["get", "timer 1000", "update"]
    handle.noted.clear()
    (row,) = task._advance((7,), [], 5_000_000)
    assert row.iloc[0][["status", "attempts", "events", "queued_us", "running_us"]].tolist() == ["running", 1, 2, 1_000_000, 0]
    assert handle.noted == ["get", "no timer 1000", "timer 12001", "update"]
    (row,) = task._advance((7,), [], 20_000_000)
    assert row.iloc[0][["status", "running_us"]].tolist() == ["timeout", 10_000_000]
