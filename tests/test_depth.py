"""Resolution of calls, ignore rules, stored reports and archives on small cases with known results."""

import json
import random
import subprocess
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest

from millrace.operators import documents, symbols, trees
from millrace.sources import archives
from millrace.sources import files as sources
from pyspark.sql import functions as F

# -- definitions that calls name

PACKAGE = {
    "/src/pkg/__init__.py": "from .mod import f as g\nfrom .deep import *\n",
    "/src/pkg/mod.py": (
        "import os\nclass A:\n    def m(self):\n        return self.n()\n    def n(self):\n        os.getcwd(); len([])\n"
        "def f(x):\n    y = x\n    y()\n    def inner():\n        f(1)\n    return inner()\n"
    ),
    "/src/pkg/deep.py": "def h():\n    pass\ndef _p():\n    pass\n",
    "/src/app.py": (
        "import pkg.mod as x\nimport pkg\nfrom pkg import *\nfrom pkg.mod import A as B\nclass D(B):\n    def n(self):\n        super().n()\n        self.m()\n"
        "class E(D, x.A):\n    @classmethod\n    def k(cls):\n        cls.m(cls)\n        super().n()\nx.f(2)\npkg.mod.f(3)\npkg.g(4)\nh()\ng(1)\nD.m(1)\nE()\nzzz()\n_p()\n"
    ),
    "/src/bad.py": "def (:",
    "/src/circle_a.py": "from circle_b import x\nx()\n",
    "/src/circle_b.py": "from circle_a import x\n",
    "/src/late.py": "from pkg.mod import f\ndef f():\n    pass\nf()\n",
    "/src/diamond.py": (
        "class R:\n    def a(self): pass\n    def b(self): pass\nclass L(R):\n    pass\nclass M(R):\n    def a(self): pass\n"
        "class N(L, M):\n    def go(self):\n        self.a()\n        self.b()\n        self.c()\n"
    ),
}


def test_calls_name_definitions_across_files(spark):
    rows = [(r, p, t) for r in ("one", "two") for p, t in PACKAGE.items()] + [("three", "/src/app.py", PACKAGE["/src/app.py"])]
    got = symbols.calls(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect()
    found = {(r.repo_id, r.caller, r.line, r.ref): (r.status, r.callee) for r in got}
    mod = "pkg.mod"
    for repo in ("one", "two"):
        for key, want in {
            ("pkg.mod.A.m", 4, "pkg.mod.A.n"): ("definition", f"{mod}.A.n"), ("pkg.mod.A.n", 6, "pkg.mod.os.getcwd"): ("external", None),
            ("pkg.mod.A.n", 6, "pkg.mod.len"): ("builtin", None), ("pkg.mod.f", 9, None): ("local", None),
            ("pkg.mod.f.inner", 11, "pkg.mod.f"): ("definition", f"{mod}.f"), ("pkg.mod.f", 12, "pkg.mod.f.inner"): ("definition", f"{mod}.f.inner"),
            ("app.D.n", 7, "app.D.n"): ("definition", f"{mod}.A.n"), ("app.D.n", 8, "app.D.m"): ("definition", f"{mod}.A.m"),
            ("app.E.k", 12, "app.E.m"): ("definition", f"{mod}.A.m"), ("app.E.k", 13, "app.E.n"): ("definition", "app.D.n"),
            ("app", 14, "app.x.f"): ("definition", f"{mod}.f"), ("app", 15, "app.pkg.mod.f"): ("definition", f"{mod}.f"),
            ("app", 16, "app.pkg.g"): ("definition", f"{mod}.f"), ("app", 17, "app.h"): ("definition", "pkg.deep.h"),
            ("app", 18, "app.g"): ("definition", f"{mod}.f"), ("app", 19, "app.D.m"): ("definition", f"{mod}.A.m"), ("app", 20, "app.E"): ("definition", "app.E"),
            ("app", 21, "app.zzz"): ("unresolved", None), ("app", 22, "app._p"): ("unresolved", None), ("circle_a", 2, "circle_a.x"): ("unresolved", None),
            ("late", 4, "late.f"): ("definition", "late.f"), ("diamond.N.go", 10, "diamond.N.a"): ("definition", "diamond.M.a"),
            ("diamond.N.go", 11, "diamond.N.b"): ("definition", "diamond.R.b"), ("diamond.N.go", 12, "diamond.N.c"): ("unresolved", None),
        }.items():
            assert found[repo, *key] == want, key
    assert found["three", "app", 14, "app.x.f"] == ("external", None)  # another repository's package isn't this one's


def test_local_names_hide_the_modules(spark):
    text = "def f(): pass\ndef g(f):\n    f()\ndef h():\n    from os import path as f\n    f.join()\ndef i():\n    for f in []:\n        f()\n"
    rows = symbols.symbol_facts(text, "m.py")
    assert [(r["line"], r["target"]) for r in rows if r["kind"] == "call"] == [(3, None), (6, "os.path.join"), (9, None)]


# -- ignore rules


def test_ignore_files_as_the_tool_itself_reads_them(spark, tmp_path):
    """Against check-ignore of an installed version control tool, where there is one."""
    rules = {
        ".gitignore": "*.log\n!keep.log\nbuild/\n/top\na/**/z\n**/q.txt\nw/**\n\\#x\n\\!y\nsp\\ \n[ab].c\n?.d\n[!m]x.e\nmid/dle\n  \n",
        "src/.gitignore": "!*.log\ngen/\n*.tmp\n", "src/deep/.gitignore": "*\n!*.py\n", "build/.gitignore": "!*\n",
    }
    r = random.Random(3)
    names = "x.log keep.log build top z q.txt w #x !y a.c c.c k.d kk.d ax.e mx.e dle gen u.tmp main.py src deep mid a".split() + ["sp "]
    paths = {"/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(700)}
    paths = {p for p in paths if not any(q.startswith(p + "/") for q in paths)}  # files, none of them also a folder
    git = subprocess.run(["git", "init", "-q", str(tmp_path)], capture_output=True).returncode == 0
    if not git:
        pytest.skip("no tool to hold it against")
    placed = []
    for p in paths | {k for k in rules if not any(k.startswith(q + "/") for q in paths)}:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(rules.get(p, ""))
        placed.append(p)
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "-z", "--no-index", "--stdin"], input="\0".join(placed), capture_output=True, text=True).stdout
    want = {p: p in set(said.split("\0")) for p in placed}
    df = spark.createDataFrame([("r", p, rules.get(p)) for p in placed], "repo_id string, path string, content string")
    got = {x.path: x.ignored for x in trees.ignored_paths(df, trees.ignore_rules(df)).collect()}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def test_directories_of_nothing_and_of_pruned_roots(spark):
    kinds = "repo_id string, path string, size_bytes long, created timestamp, modified timestamp"
    assert trees.directory_totals(spark.createDataFrame([], kinds)).collect() == []
    rows = [("r", "/.git/x/y", 5, None, None), ("r", "a", None, None, None), ("r", "a.b/.c/d", 7, None, None)]
    got = {(x.directory, x.file_count, x.size_bytes) for x in trees.directory_totals(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {("", 1, 0), (".git", 1, 5), (".git/x", 1, 5), ("a.b/.c", 1, 7)}


# -- stored reports


def test_reports_from_several_places(spark, tmp_path):
    def put(place, text):
        f = tmp_path / place
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else json.dumps(text).encode())

    assert documents.read_candidates(spark, str(tmp_path)).collect() == []
    put("reports/a.json", {"path": "best", "metrics": {"risk_factors": ["x", 2]}, "file_types": {".py": "3"}})
    put("reports/a", {"path": "second"})
    put("reports/b.json", b'{"path": ')
    put("uploads/b/analysis.json", {"analysis_id": "B"})
    put("repos/b/analysis.json", {"analysis_id": "worse"})
    put("reports/c.json", b"\xff\xfe")
    put("reports/d.json", {"path": None})
    rows = documents.read_candidates(spark, str(tmp_path))
    got = {r.id: r for r in documents.summaries(documents.reports(rows)).collect()}
    assert {k: (r.path, r.analysis_id) for k, r in got.items()} == {"a": ("best", "a"), "b": ("Unknown", "B"), "d": ("Unknown", "d")}
    assert got["a"].risk_factors == ["x", "2"] and got["a"].file_types == {".py": 3} and got["b"].timestamp[:2] == "20"
    assert {(r.report_id, r.priority, r.problem) for r in documents.set_aside(rows).collect()} == {("b", 0, "not json"), ("c", 0, "not json")}
    schema = documents.merged_schema(documents.reports(rows)).first().schema
    assert "metrics" in schema and "analysis_id" in schema


def test_any_value_as_json(spark):
    kinds = "id int, d date, t timestamp_ntz, n decimal(9,3), b binary, m map<int,struct<x:date,y:array<decimal(5,1)>>>, s string, f double, z struct<q:string>"
    row = (1, date(2024, 2, 3), datetime(2024, 2, 3, 4, 5, 6, 70), Decimal("1.500"), b"\x00\xff", {7: (date(2020, 1, 1), [Decimal("2.5"), None])}, 'q"', float("nan"), None)
    df = spark.createDataFrame([row, (2, *[None] * 8)], kinds)
    one, two = (json.loads(r.json) for r in documents.export_json(df, "now", "id").orderBy("id").collect())
    assert one == {
        "id": 1, "d": "2024-02-03", "t": "2024-02-03T04:05:06.000070", "n": "1.500", "b": "AP8=", "m": {"7": {"x": "2020-01-01", "y": ["2.5", None]}}, "s": 'q"', "f": "NaN", "z": None,
        "_export": {"format": "json", "exported_at": "now", "report_id": "1", "version": "1.0"},
    }
    assert all(two[k] is None for k in ("d", "t", "n", "b", "m", "s", "f", "z"))


# -- archives


def write_zip(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)


def rows_of(df):
    return sorted((r.repo_id, r.path or "", r.size_bytes, r.content, r.error) for r in df.collect())


def test_an_archive_is_shared_out(spark, tmp_path):
    r = random.Random(5)
    big = [(f"d{i % 7}/f{i}.txt", r.randbytes(2000).hex()) for i in range(300)]
    write_zip(tmp_path / "big.zip", [*big, ("d/", ""), ("__MACOSX/x", "y")])
    write_zip(tmp_path / "bad.zip", [("../x", "y"), ("a", "b")])
    write_zip(tmp_path / "none.zip", [("d/", "")])
    (tmp_path / "torn.zip").write_bytes(b"PK\x03\x04 nothing")
    write_zip(tmp_path / "hurt.zip", [("good", "g" * 500), ("wrong", r.randbytes(3000).hex()), ("last", "l" * 500)])
    data = bytearray((tmp_path / "hurt.zip").read_bytes())
    at = data.find(b"wrong") + 200
    data[at : at + 50] = b"\xff" * 50
    (tmp_path / "hurt.zip").write_bytes(data)
    whole = rows_of(sources.read_archives(spark, f"{tmp_path}/*.zip"))
    parts = archives.read_archives_in_ranges(spark, str(tmp_path), range_bytes=50_000)
    assert rows_of(parts) == whole
    assert parts.where("repo_id = 'big'").select(F.spark_partition_id().alias("p")).distinct().count() > 5
    assert {x[1]: x[4] for x in whole if x[0] == "hurt"}["wrong"] and {x[1]: x[4] for x in whole if x[0] == "hurt"}["last"] is None
    assert {x[0]: x[4] for x in whole if x[0] in ("bad", "none", "torn")} == {"bad": "unsafe path", "none": "empty", "torn": "BadZipFile"}
    assert {x[4] for x in rows_of(archives.read_archives_in_ranges(spark, f"{tmp_path}/big.zip", max_mb=0))} == {"too large"}
    assert sorted((x[1], x[3]) for x in whole if x[0] == "big") == sorted(big)


def test_archives_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    archives.register(spark)

    def run():
        rows = spark.readStream.format("archives").option("range_bytes", 2000).load(str(folder))
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.repo_id, r.path) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write_zip(folder / "a.zip", [(f"f{i}", "x" * i) for i in range(200)])
    first = run()
    assert first == sorted(("a", f"f{i}") for i in range(200))
    write_zip(folder / "b.zip", [("g", "y")])
    assert run() == sorted([*first, ("b", "g")])
    assert run() == sorted([*first, ("b", "g")])  # nothing comes twice


# -- prefilters of scans


def test_no_match_is_passed_over(spark):
    """Every text in which a pattern matches is a suspect, whatever its case and whatever letters fold to it."""
    from millrace.functions import rules
    from millrace.operators import scan
    from millrace.plans import adapters

    r = random.Random(4)
    seeds = [*adapters.LINES, "API_KEY = 'abcdefghij'", "token: \"12345678\"", "-----BEGIN RSA PRIVATE KEY-----", "'" + "aB3/+" * 8 + "'", "ſubproceſſ.run(x)", "verİfy = false", "AKIA" + "X" * 16]
    odd = {"s": "ſ", "S": "ſ", "k": "K", "K": "K", "i": "ı", "I": "İ"}
    rows = []
    for _ in range(3000):
        t = "".join(odd[c] if c in odd and r.random() < 0.2 else c.swapcase() if r.random() < 0.3 else c for c in r.choice(seeds))
        if r.random() < 0.3:
            t = t.replace(r.choice(t), r.choice(" x('\""), 1)
        rows.append((t,))
    df = spark.createDataFrame(rows, "t string")
    for table in (rules.INSECURE_PATTERNS, rules.SECRET_PATTERNS):
        got = df.select(scan.any_of(F.col("t"), table).alias("hit"), scan.suspect(F.col("t"), table).alias("maybe"), "t")
        assert got.where("hit AND NOT maybe").collect() == [] and got.where("hit").count() > 300 and got.where("NOT maybe").count() > 300
