"""Directories of repositories: their sizes, and which files rules of any depth ignore."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..shipping import ship


def parents(path: Column) -> Column:
    """The directories above a relative path, from the root (empty) to its own."""
    parts = F.split(F.ltrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def pruned_name(name: Column, names: tuple[str, ...], hidden: bool) -> Column:
    return (name.isin(*names) | name.startswith(".")) if hidden else name.isin(*names)


def directory_totals(files: DataFrame, names: tuple[str, ...] = rules.SIZED_WITHOUT, hidden: bool = True) -> DataFrame:
    """repo_id, directory, depth, file_count, size_bytes, created and modified of every directory.

    A directory counts the files below it, except those behind a pruned directory (one of names, or with hidden
    any whose name begins with a dot); a pruned directory itself counts what it holds, as a walk
    that begins there does. Each file goes to the directories between its own and the last pruned
    one above it, and sums begin where the file is read, so only one row for each directory and
    task is shuffled. files: repo_id, path, size_bytes, created, modified; nulls in the last three count as none.
    """
    above = parents(F.col("path"))
    cut = F.array_max(F.transform(above, lambda d: F.when(pruned_name(F.substring_index(d, "/", -1), names, hidden), F.size(F.split(d, "/"))).otherwise(0)))
    kept = F.slice(above, cut + 1, F.size(above))
    rows = files.select("repo_id", F.explode(kept).alias("directory"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), "created", "modified")
    totals = rows.groupBy("repo_id", "directory").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"), F.min("created").alias("created"), F.max("modified").alias("modified")
    )
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    return totals.withColumn("depth", depth)


def upload_listing(files: DataFrame, limit: int = 50, largest: str = "TB") -> DataFrame:
    """The uploads changed last, with their sizes, counts and times, and the totals over all uploads on every row.

    An upload is a repository's root; size and count leave pruned directories out. largest: the
    last unit of the sizes as texts.
    """
    roots = directory_totals(files).where("directory = ''")
    kb = (F.col("size_bytes") / 1024).alias("size_kb")
    rows = roots.select("repo_id", kb, paths.human_size(F.col("size_bytes"), largest=largest).alias("size_human"), "file_count", "created", "modified")
    newest = rows.orderBy(F.desc("modified"), "repo_id").limit(limit)
    total = F.sum("size_bytes")
    totals = roots.agg(F.count("*").alias("total"), F.round(total / 1024, 2).alias("total_size_kb"), paths.human_size(total, largest=largest).alias("total_size_human"))
    return newest.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").drop("one")  # one row


# -- ignore rules -----------------------------------------------------------------------------


def gitignore_rule(line: str) -> dict | None:
    """One line of an ignore file: regex over the path below its directory, negated, dir_only; None for blanks and comments.

    A pattern with a slash before its end holds from the file's directory on, any other at every
    depth; * and ? stay within a name, ** crosses directories; a backslash takes a character as it is.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    dir_only = body.endswith("/")
    body = body.rstrip("/")
    if not body:
        return None
    anchored = "/" in body
    out, k, body = "", 0, body.lstrip("/")
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k) and (k == 0 or body[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif body[k:] == "**" and k and body[k - 1] == "/":
            out, k = out + ".+", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + len(re.match(r"\*+", body[k:])[0])
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := body.find("]", k + 2 if body[k + 1 : k + 2] in ("!", "^", "]") else k + 1)) > 0:
            inner = body[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\").replace("[", "\\[") + "]"
            k = end + 1
        else:
            if c == "\\" and k + 1 < len(body):
                k, c = k + 1, body[k + 1]
            out, k = out + re.escape(c), k + 1
    return {"regex": ("^" if anchored else "(?:^|/)") + out + "$", "negated": negated, "dir_only": dir_only}


def ignore_rules(files: DataFrame) -> DataFrame:
    """repo_id, directory, ord, regex, negated and dir_only of the lines of all .gitignore files; files: repo_id, path, content."""
    ship(files.sparkSession)
    schema = pa.schema([("repo_id", pa.string()), ("directory", pa.string()), ("ord", pa.int32()), ("regex", pa.string()), ("negated", pa.bool_()), ("dir_only", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, text in zip(*(b.column(k).to_pylist() for k in ("repo_id", "path", "content")), strict=True):
                directory = path.strip("/").rpartition("/")[0]
                for k, line in enumerate((text or "").split("\n")):
                    if rule := gitignore_rule(line):
                        rows.append({"repo_id": repo, "directory": directory, "ord": k} | rule)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    named = files.where(paths.basename(F.col("path")) == ".gitignore").select("repo_id", "path", "content")
    return named.mapInArrow(run, "repo_id string, directory string, ord int, regex string, negated boolean, dir_only boolean")


def ignored_paths(files: DataFrame, ruled: DataFrame) -> DataFrame:
    """repo_id, path and ignored of every file, by the rules of all directories above it.

    Every entry (a file, or a directory once for all files below it) meets the rules of the
    directories above it; of those that match, the deepest directory's last one decides. A file
    is ignored if its own verdict or that of any directory above it says so: what lies in an
    ignored directory can't be taken back. ruled: see ignore_rules.
    """
    listed = files.select("repo_id", F.ltrim("path", F.lit("/")).alias("path"))
    above = F.slice(parents(F.col("path")), 2, F.size(F.split("path", "/")))
    folders = listed.select("repo_id", F.explode(above).alias("entry")).distinct().withColumn("is_dir", F.lit(True))
    entries = listed.select("repo_id", F.col("path").alias("entry"), F.lit(False).alias("is_dir")).distinct().union(folders)
    met = entries.select("*", F.explode(parents(F.col("entry"))).alias("directory")).join(ruled, ["repo_id", "directory"])
    rel = F.when(F.col("directory") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(directory) + 2)"))
    met = met.where((F.col("is_dir") | ~F.col("dir_only")) & F.regexp_like(rel, F.col("regex")))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    verdicts = met.groupBy("repo_id", "entry", "is_dir").agg(F.max_by("negated", F.struct(depth, "ord")).alias("negated")).where("NOT negated")
    hidden = verdicts.where("is_dir").select("repo_id", "entry")
    own = verdicts.where("NOT is_dir").select("repo_id", F.col("entry").alias("path"))
    below = listed.select("repo_id", "path", F.explode(above).alias("entry")).join(hidden, ["repo_id", "entry"], "left_semi").select("repo_id", "path")
    gone = own.union(below).distinct().withColumn("ignored", F.lit(True))
    return listed.join(gone, ["repo_id", "path"], "left").fillna(False, ["ignored"])


def ignored_by_first_match(lines: tuple[str, ...]) -> Column:
    """Whether the path of a file or directory (is_dir) is ignored when the first rule that matches decides.

    The default globs come before the lines of the root's ignore file; * crosses slashes; a line
    that ends in a slash is passed over for files. So no line takes back what a default ignores.
    """
    out = F.when(F.lit(False), F.lit(True))
    for g in rules.IGNORE_GLOBS:
        out = out.when(F.col("path").rlike(paths.glob_regex(g)), F.lit(True))
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            negated, dir_only = line.startswith("!"), line.endswith("/")
            hit = F.col("path").rlike(paths.glob_regex(line.removeprefix("!").removesuffix("/")))
            out = out.when(hit & F.col("is_dir") if dir_only else hit, F.lit(not negated))
    return out.otherwise(F.lit(False))
