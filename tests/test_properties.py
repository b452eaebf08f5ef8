"""Column functions against plain Python restatements over random inputs."""

from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.functions import paths
from millrace.operators import scan
from pyspark.sql import functions as F

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
NAMES = st.lists(st.text("aB.é _-", min_size=1, max_size=8).filter(lambda s: s.strip(".") and s not in (".", "..")), min_size=20, max_size=60)
TEXTS = st.lists(st.text("ab\n #/*\t", max_size=12), min_size=20, max_size=60)


def evaluate(spark, expr, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


@SETTINGS
@given(NAMES)
def test_extension_is_the_path_suffix(spark, names):
    assert evaluate(spark, paths.extension, ["d.x/" + n for n in names]) == [PurePosixPath(n).suffix.lower() for n in names]


@SETTINGS
@given(TEXTS)
def test_line_counts(spark, texts):
    assert evaluate(spark, paths.iterated_lines, texts) == [len(t.split("\n")) - (t == "" or t.endswith("\n")) for t in texts]
    assert evaluate(spark, paths.newline_lines, texts) == [t.count("\n") + 1 for t in texts]
    assert evaluate(spark, scan.stripped, texts) == [t.strip() for t in texts]


@SETTINGS
@given(st.lists(st.text("a./egilox_bu", max_size=14), min_size=20, max_size=60))
def test_scan_filter(spark, rels):
    pruned = {"__pycache__", "node_modules", ".git", "venv", ".venv", "env"}

    def kept(rel):
        *dirs, name = rel.split("/")
        return not any(d.startswith(".") or d in pruned for d in dirs) and not name.startswith(".")

    assert evaluate(spark, paths.scan_kept, rels) == [kept(r) for r in rels]
