"""Report projections: advice, key findings, distributions, names, and rendering of one report."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules
from ..streaming.tasks import PROGRESS


def _rows(summary: DataFrame, texts: list[Column], limit: int | None = None) -> DataFrame:
    """repo_id, ord (from 1) and text of the texts that aren't null."""
    kept = F.filter(F.array(*texts), lambda t: t.isNotNull())
    kept = F.slice(kept, 1, limit) if limit else kept
    return summary.select("repo_id", F.posexplode(kept).alias("ord", "text")).select("repo_id", (F.col("ord") + 1).alias("ord"), "text")


def readme_advice(summary: DataFrame) -> DataFrame:
    """Up to ten lines of advice per repository, in order.

    summary: repo_id, file_count, risk, secrets_found, vulnerabilities_found, other_files, avg_complexity.
    """
    n, risk, say = F.col("file_count"), F.col("risk"), rules.ADVICE
    count = lambda c, form, least=0: F.when(F.col(c) > least, F.format_string(form, c))
    return _rows(summary, [
        F.when(n > 1000, say["huge"]).when(n > 500, say["large"]), F.when(risk.isin("high", "critical"), say["high risk"]).when(risk == "medium", say["medium risk"]),
        count("secrets_found", say["secrets"]), count("vulnerabilities_found", say["vulnerabilities"]), count("other_files", say["other files"], 20),
        F.when(F.col("avg_complexity") > 50, say["complexity"]), *map(F.lit, rules.GENERAL_ADVICE),
    ], 10)


def key_findings(summary: DataFrame) -> DataFrame:
    """summary: repo_id, secrets_found, vulnerabilities_found, large_files, other_files."""
    columns = {"secrets": "secrets_found", "vulnerabilities": "vulnerabilities_found", "large files": "large_files", "other files": "other_files"}
    found = [F.when(F.col(c) > 0, F.format_string(rules.KEY_FINDINGS[k], c)) for k, c in columns.items()]
    return _rows(summary, [*found, F.when(F.coalesce(*found).isNull(), rules.KEY_FINDINGS["none"])])


def licence_advice(checks: DataFrame) -> DataFrame:
    """checks: repo_id, licence, issues. Without a licence: high; with incompatible dependencies: critical."""
    advice = F.array(
        F.when(F.col("licence").isin("No License", "Unknown"), F.struct(F.lit("high").alias("priority"), F.lit("Add a license").alias("title"))),
        F.when(F.col("issues") > 0, F.struct(F.lit("critical").alias("priority"), F.lit("Resolve license conflicts").alias("title"))),
    )
    return checks.select("repo_id", F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("x")).select("repo_id", "x.*")


def distribution(counts: DataFrame) -> DataFrame:
    """Share of each severity in whole percent, without empty ones. counts: repo_id, severity, n."""
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("repo_id"))).cast("int")
    return counts.where("n > 0").withColumn("percentage", share)


def progress(status: Column, given: Column | None = None) -> Column:
    """The given progress within 0 to 100, or what the status stands for."""
    usual = F.lit(0.0)
    for name, value in PROGRESS.items():
        usual = F.when(status == name, value).otherwise(usual)
    return usual if given is None else F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(given, usual)))


def export_name(name: Column, report_id: Column, at: Column, ext: str) -> Column:
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._-]", "")
    return F.concat(clean, F.lit("_"), F.substring(report_id, 1, 8), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("." + ext))


def to_json(report: dict) -> str:
    """One report, collected by the caller, as pretty JSON."""
    return json.dumps(report, indent=2, sort_keys=True, default=str)


def to_markdown(report: dict) -> str:
    """Sections for the parts that the report has: summary, metrics, layers (three files each), findings."""
    out = [f"# {report.get('repo_id', 'repository')}", ""]
    for title, part in (("Summary", "summary"), ("Metrics", "metrics"), ("Security", "security")):
        if report.get(part):
            out += [f"## {title}", "", *(f"- **{k.replace('_', ' ').title()}**: {v}" for k, v in report[part].items()), ""]
    if report.get("layers"):
        out += ["## Architecture", ""]
        for layer, files in sorted(report["layers"].items()):
            out += [f"### {layer} ({len(files)})", *(f"- `{f}`" for f in sorted(files)[:3]), ""]
    if report.get("recommendations"):
        out += ["## Recommendations", "", *(f"{i}. {r}" for i, r in enumerate(report["recommendations"], 1)), ""]
    return "\n".join(out)


def to_html(report: dict) -> str:
    lines = [html.escape(x) for x in to_markdown(report).split("\n")]
    return "<!DOCTYPE html><html><body><pre>" + "\n".join(lines) + "</pre></body></html>"
