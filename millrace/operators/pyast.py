"""Facts from Python syntax trees: one pass over file contents, flat rows out."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..shipping import ship

_STATS = {
    "functions": "int", "async_functions": "int", "classes": "int", "imports": "int", "import_list": "array<string>", "lines": "int",
    "decorated_functions": "int", "decorator_exprs": "int", "comprehensions": "int", "lambdas": "int", "names": "array<string>",
    "dangerous": "int",
}
_ROWS = {
    "kind": "string", "name": "string", "qualified": "string", "caller": "string", "line": "int", "args": "int",
    "is_method": "boolean", "is_builtin": "boolean", "severity": "string", "bases": "array<string>",
}
_ARROW = {
    "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
}


def _tree(content: str | None) -> ast.AST | None:
    try:
        return ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def dotted(node: ast.AST) -> str:
    """a.b.c for a chain of attributes on a name, '' for any other."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def stats(content: str | None) -> dict | None:
    tree = _tree(content)
    if tree is None:
        return None
    nodes = list(ast.walk(tree))
    count = lambda *kinds: sum(isinstance(n, kinds) for n in nodes)
    names: list[str] = []
    for n in nodes:
        if isinstance(n, ast.Import):
            names += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            names.append(n.module)
    return {
        "functions": count(ast.FunctionDef), "async_functions": count(ast.AsyncFunctionDef), "classes": count(ast.ClassDef),
        "imports": count(ast.Import, ast.ImportFrom), "import_list": names, "lines": (content or "").count("\n") + 1,
        "decorated_functions": sum(bool(n.decorator_list) for n in nodes if isinstance(n, ast.FunctionDef)),
        "decorator_exprs": sum(len(getattr(n, "decorator_list", ())) for n in nodes),
        "comprehensions": count(ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp), "lambdas": count(ast.Lambda),
        "names": [n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.ClassDef))],
        "dangerous": sum(isinstance(n, ast.Call) and bool(_risk(n)) for n in nodes),
    }


def _risk(call: ast.Call) -> str | None:
    """The severity of a dangerous call."""
    f = call.func
    return rules.BARE_CALLS.get(f.id) if isinstance(f, ast.Name) else rules.DOTTED_CALLS.get(dotted(f))


def facts(content: str | None) -> list[dict]:
    """Functions, classes, calls, imports and dangerous calls of one source, in source order by walk."""
    tree = _tree(content)
    out: list[dict] = []
    blank = dict.fromkeys(_ROWS)
    if tree is None:
        return out

    def add(kind: str, **values) -> None:
        out.append(blank | values | {"kind": kind})

    def walk(node: ast.AST, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                full = dotted(f)
                if name:
                    add("call", name=name, qualified=full or name, caller=inside, line=child.lineno, args=len(child.args) + len(child.keywords),
                        is_method=isinstance(f, ast.Attribute), is_builtin=hasattr(builtins, name))
                if risk := _risk(child):
                    add("dangerous", name=full or name, line=child.lineno, severity=risk)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                module = child.module if isinstance(child, ast.ImportFrom) else None
                for a in child.names:
                    add("import", name=a.name, qualified=f"{module}.{a.name}" if module else a.name, caller=module, line=child.lineno)
            if isinstance(child, ast.FunctionDef):
                add("function", name=child.name, qualified=child.name, line=child.lineno)
            elif isinstance(child, ast.ClassDef):
                add("class", name=child.name, line=child.lineno, bases=[dotted(b) for b in child.bases if dotted(b)])
                for m in child.body:
                    if isinstance(m, ast.FunctionDef):
                        add("method", name=m.name, qualified=f"{child.name}.{m.name}", caller=child.name, line=m.lineno)
            walk(child, child.name if isinstance(child, (ast.FunctionDef, ast.ClassDef)) else inside)

    walk(tree, "<module>")
    return out


def python_files(files: DataFrame) -> DataFrame:
    """repo_id, path and content of the Python files, dealt to all cores.

    Small sources come in a few splits, each a task; parsing a text costs far more than moving it.
    """
    spark = files.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.where(F.lower("path").endswith(".py")).select("repo_id", "path", "content").repartition(parts)


def _apply(files: DataFrame, make, fields: dict[str, str]) -> DataFrame:
    ship(files.sparkSession)
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string())] + [(k, _ARROW[t]) for k, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, p, c in zip(*(b.column(k).to_pylist() for k in ("repo_id", "path", "content")), strict=True):
                rows += [(r, p, *x.values()) for x in make(c)]
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return python_files(files).mapInArrow(run, "repo_id string, path string, " + ", ".join(f"{k} {t}" for k, t in fields.items()))


def file_stats(files: DataFrame) -> DataFrame:
    """A row per Python file; parse_error files have null counts. Both complexity scores are given."""
    empty = dict.fromkeys(_STATS)

    def one(content):
        s = stats(content)
        return [(empty | {"parse_error": True}) if s is None else s | {"parse_error": False}]

    rows = _apply(files, one, _STATS | {"parse_error": "boolean"})
    worker = F.expr("2 * functions + 3 * classes + imports + decorated_functions + comprehensions + lambdas")
    return rows.withColumn("complexity_score", worker).withColumn("simple_complexity", F.expr("functions + 2 * classes"))


def file_facts(files: DataFrame) -> DataFrame:
    """Rows of kind function, method, class, call, import and dangerous of all Python files."""
    return _apply(files, facts, _ROWS)


def repository_stats(stats_: DataFrame) -> DataFrame:
    """Per repository: sums, mean complexity over files that score and over files that parse, other means over all Python files."""
    files, score = F.count("*"), F.col("complexity_score")
    return stats_.groupBy("repo_id").agg(
        files.alias("python_files"), F.sum("functions").alias("functions"), F.sum("classes").alias("classes"),
        F.sum("imports").alias("imports"), F.sum("lines").alias("lines"), F.sum("decorated_functions").alias("decorators"),
        F.avg(F.when(score > 0, score)).alias("avg_complexity_score"), F.avg(score).alias("avg_complexity_parsed"),
        (F.sum("functions") / files).alias("avg_functions"), (F.sum("classes") / files).alias("avg_classes"),
        F.coalesce(F.sum("dangerous"), F.lit(0)).alias("dangerous_calls"),
    )


def top_complex(stats_: DataFrame, n: int = 10) -> DataFrame:
    """The n files of each repository that score most (ties: path)."""
    order = W.partitionBy("repo_id").orderBy(F.desc("complexity_score"), "path")
    rows = stats_.where(~F.col("parse_error")).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= n).select("repo_id", "rank", "path", "complexity_score", "functions", "classes")


def import_frequency(stats_: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent imports of each repository (ties: module)."""
    counts = stats_.select("repo_id", F.explode("import_list").alias("module")).groupBy("repo_id", "module").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("n"), "module"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)
