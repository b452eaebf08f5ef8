"""Reports as texts for every repository at once: README, summary tables, layer diagrams and DOT files.

Lists in a text hold the first few entries by a stated order, cut by a rank before anything is
gathered, and say how many there are beyond; so a repository's text is short however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph


def first(rows: DataFrame, n: int, order: list[Column], *keys: str) -> DataFrame:
    """The first n rows of each group of keys, with their rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def _gathered(rows: DataFrame, line: Column, name: str, *keys: str) -> DataFrame:
    """The lines of each group in the order of their ranks, as one text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias(name))


def listing(rows: DataFrame, line: Column, order: list[Column], n: int, name: str, more: str) -> DataFrame:
    """repo_id and a text: a line for each of a repository's first n rows and one for how many more there are."""
    total = rows.groupBy("repo_id").agg(F.count("*").alias("total"))
    text = _gathered(first(rows, n, order, "repo_id"), line, "text", "repo_id").join(total, "repo_id")
    rest = F.when(F.col("total") > n, F.concat(F.lit("\n"), F.format_string(more, F.col("total") - n))).otherwise("")
    return text.select("repo_id", F.concat("text", rest).alias(name))


def layer_section(files: DataFrame, n: int = 5) -> DataFrame:
    """repo_id and layers: each layer of a repository with its first n files by path. files: repo_id, layer, path."""
    total = files.groupBy("repo_id", "layer").agg(F.count("*").alias("total"))
    text = _gathered(first(files, n, [F.col("path")], "repo_id", "layer"), F.concat(F.lit("- `"), "path", F.lit("`")), "files", "repo_id", "layer")
    rest = F.when(F.col("total") > n, F.format_string("\n- *... and %d more*", F.col("total") - n)).otherwise("")
    head = F.format_string("### %s Layer (%d files)\n", F.upper("layer"), "total")
    rows = text.join(total, ["repo_id", "layer"]).withColumn("line", F.concat(head, "files", rest))
    return _gathered(first(rows, 100, [F.col("layer")], "repo_id"), F.col("line"), "layers", "repo_id")


def readmes(summary: DataFrame, parts: dict[str, DataFrame], at: str) -> DataFrame:
    """repo_id and readme of every repository.

    summary: repo_id, file_count, total_lines, total_kb, risk, risk_score, secrets_found,
    vulnerabilities_found, security_level, python_files, functions, classes. parts: types, languages, layers,
    secrets, vulnerabilities, complex and advice, each repo_id and a text; sections without a text are left out.
    """
    rows = summary
    for name in ("types", "languages", "layers", "secrets", "vulnerabilities", "complex", "advice"):
        rows = rows.join(parts[name].select("repo_id", F.col(parts[name].columns[-1]).alias(f"text_{name}")), "repo_id", "left")
    under = lambda title, c: F.when(F.col(f"text_{c}").isNotNull(), F.concat(F.lit(f"{title}\n\n"), f"text_{c}"))
    say = lambda form, *c: F.format_string(form, *c)
    sections = [
        say("# %s\n\n*Generated on %s*\n\n## Overview\n\n- **Repository**: `%s`\n- **Files Analyzed**: %d", "repo_id", F.lit(at), "repo_id", "file_count"),
        say(
            "## Metrics\n\n- **Total Files**: %d\n- **Total Lines**: %d\n- **Total Size**: %s KB\n- **Risk Level**: **%s** (Score: %d/100)", "file_count", "total_lines",
            F.format_string("%.2f", "total_kb"), F.upper("risk"), "risk_score",
        ),
        under("### File Types", "types"), under("### Languages", "languages"), under("## Architecture", "layers"),
        say("## Security\n\n- **Secrets Found**: %d\n- **Vulnerabilities Found**: %d\n- **Overall Risk**: %s", "secrets_found", "vulnerabilities_found", F.upper("security_level")),
        under("### Potential Secrets Found", "secrets"), under("### Potential Vulnerabilities", "vulnerabilities"),
        F.when(F.col("python_files") > 0, say("## Python Analysis\n\n- **Python Files**: %d\n- **Functions Found**: %d\n- **Classes Found**: %d", "python_files", "functions", "classes")),
        under("### Most Complex Files", "complex"), under("## Recommendations", "advice"),
    ]
    return rows.select("repo_id", F.array_join(F.array_compact(F.array(*sections)), "\n\n").alias("readme"))


def summary_tables(summary: DataFrame) -> DataFrame:
    """repo_id, ord, metric and value: the rows of each repository's summary table, a heading first, languages only where there are any."""
    entries = [
        ("Metric", F.lit("Value")), ("Total Files", F.col("file_count").cast("string")), ("Total Lines", F.col("total_lines").cast("string")),
        ("Total Size", F.concat(F.format_string("%.2f", "total_kb"), F.lit(" KB"))), ("Risk Level", F.upper("risk")), ("Risk Score", F.format_string("%d/100", "risk_score")),
        ("Languages", F.when(F.col("languages") != "", F.replace("languages", F.lit(","), F.lit(", ")))),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in entries))
    return summary.select("repo_id", F.posexplode(rows).alias("ord", "r")).select("repo_id", "ord", "r.*").where("value IS NOT NULL")


def layer_diagrams(files: DataFrame) -> DataFrame:
    """repo_id, nodes (the names of its layers) and edges (none: layers are only named). files: repo_id, layer."""
    nodes = F.array_sort(F.collect_set("layer")).alias("nodes")  # of a handful
    return files.groupBy("repo_id").agg(nodes).withColumn("edges", F.expr("cast(array() AS array<string>)"))


def dot_files(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, ord and line of a DOT file for each graph: its heading, an edge to a line, its end. Sort by ord to write it."""
    whole = edges.select(*keys).distinct()
    body = edges.select(*keys, F.concat(F.lit("1 "), "src", F.lit(" "), "dst").alias("ord"), graph.dot_line().alias("line"))
    head = whole.select(*keys, F.lit("0").alias("ord"), F.lit("digraph dependencies {").alias("line"))
    return head.union(body).union(whole.select(*keys, F.lit("2"), F.lit("}")))
