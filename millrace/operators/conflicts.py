"""Licences of dependencies, direct and through other packages, against a repository's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import report, scan
from .graph import _checkpoint


def package_closure(requires: DataFrame) -> DataFrame:
    """package, needed and depth: every package that one needs, itself (0) included, by its least number of steps.

    requires: package, needed. Packages, not repositories, are closed, so what repositories share
    is found once. Each round extends what the last one added by one step and keeps what is new.
    """
    edges = _checkpoint(requires.select("package", "needed").where("package <> needed").distinct())
    names = edges.select("package").union(edges.select("needed")).distinct()
    new = _checkpoint(names.select("package", F.col("package").alias("needed"), F.lit(0).alias("depth")))
    every, depth = new, 0
    while True:
        depth += 1
        step = new.select("package", F.col("needed").alias("via")).join(edges.select(F.col("package").alias("via"), "needed"), "via")
        new = _checkpoint(step.select("package", "needed").distinct().join(every, ["package", "needed"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return every
        every = _checkpoint(every.union(new))


def dependency_licences(required: DataFrame, requires: DataFrame, licences: DataFrame) -> DataFrame:
    """repo_id, dependency, licence ('Unknown' if the table has none) and depth (1: required itself) of all packages a repository needs.

    required: repo_id, name (see scan.requirements); requires: package, needed; licences: package, licence.
    """
    direct = required.select("repo_id", F.col("name").alias("package")).where("package <> ''").distinct()
    through = direct.join(package_closure(requires), "package", "left")
    rows = through.select("repo_id", F.coalesce("needed", "package").alias("dependency"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"))
    rows = rows.groupBy("repo_id", "dependency").agg(F.min("depth").alias("depth"))
    known = licences.groupBy("package").agg(F.min("licence").alias("licence")).withColumnRenamed("package", "dependency")
    return rows.join(known, "dependency", "left").fillna("Unknown", ["licence"]).select("repo_id", "dependency", "licence", "depth")


def issues(checks: DataFrame, needed: DataFrame) -> DataFrame:
    """repo_id, dependency, licence, depth, severity and issue of the dependencies whose licence can't be combined with the repository's.

    checks: see scan.licence_check; needed: see dependency_licences. The matrix is a literal.
    """
    own = checks.select("repo_id", F.col("licence").alias("own"))
    rows = needed.join(own, "repo_id").where(scan.compatibility(F.col("own"), F.col("licence")) == "incompatible")
    return rows.select("repo_id", "dependency", "licence", "depth", F.lit("high").alias("severity"), F.lit("incompatible license").alias("issue"))


def repository_licences(files: DataFrame, required: DataFrame, requires: DataFrame, licences: DataFrame) -> DataFrame:
    """Everything about a repository's licence in one row.

    repo_id, licence, confidence, has_license_file, has_proper_license, detected (licences of its
    licence files), dependencies, unknown_dependencies, issues, issue_list (the names), advice (priority: title).
    """
    checks = _checkpoint(scan.licence_check(files))
    needed = _checkpoint(dependency_licences(required, requires, licences))
    found = _checkpoint(issues(checks, needed))
    named = scan.licence_files(files).select("repo_id", scan.licence_of(F.col("content")).alias("l")).where("l IS NOT NULL")
    detected = named.groupBy("repo_id").agg(F.array_sort(F.collect_set("l")).alias("detected"))  # of a few kinds
    counts = needed.groupBy("repo_id").agg(F.count("*").alias("dependencies"), F.sum((F.col("licence") == "Unknown").cast("long")).alias("unknown_dependencies"))
    bad = found.groupBy("repo_id").agg(F.count("*").alias("issues"))
    rows = checks.join(detected, "repo_id", "left").join(counts, "repo_id", "left").join(bad, "repo_id", "left").fillna(0, ["dependencies", "unknown_dependencies", "issues"])
    advice = report.licence_advice(rows).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "priority", "title"))).alias("advice"))  # two at most
    rows = rows.join(advice, "repo_id", "left")
    none = F.expr("cast(array() AS array<string>)")
    return rows.select(
        "repo_id", "licence", "confidence", (F.size(F.coalesce("detected", none)) > 0).alias("has_license_file"), (~F.col("licence").isin("No License", "Unknown")).alias("has_proper_license"),
        F.coalesce("detected", none).alias("detected"), "dependencies", "unknown_dependencies", "issues", F.coalesce("advice", none).alias("advice"),
    )
