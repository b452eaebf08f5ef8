"""Line scans: insecure patterns, secrets, licence wordings and requirement files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths, rules

#: Java flags under which the patterns match as they do in Python without regard to case.
FLAGS = "(?iU)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def only_comment(line: Column, ext: Column) -> Column:
    """Whether a line of a known language is blank without its comments."""
    hashed = F.regexp_replace(line, r"#.*", "")
    slashed = F.regexp_replace(F.regexp_replace(line, r"//.*", ""), r"/\*.*?\*/", "")
    code = F.when(ext.isin(*rules.HASH_COMMENTS), hashed).when(ext.isin(*rules.SLASH_COMMENTS), slashed).otherwise(line)
    return stripped(code) == ""


def lines_of(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: the file's other columns, line (from 1) and text."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(text, "\n")).alias("pos", "text")).select(*rest, (F.col("pos") + 1).alias("line"), "text")


#: What a text must hold, without regard to case, for a pattern of a table to match in it; the one
#: pattern without a fixed part is tried itself where there is a quotation mark.
NEEDED = {
    rules.INSECURE_PATTERNS: (
        "eval", "exec", "compile", "__import__", "pickle.load", "cpickle.", "os.system", "subprocess.", "cursor.execute", ".format", "pk_", "sk_", "akia",
        "random.randint", "random.choice", "verify",
    ),
    rules.SECRET_PATTERNS: ("apikey", "api_key", "api-key", "secret", "token", "passwd", "password", "akia", "pk_", "sk_", "-----begin "),
}
_QUOTED = r"""["'][0-9a-zA-Z/+]{40}["']"""


def any_of(text: Column, table) -> Column:
    """Whether any pattern matches; what matches in a line matches in the file that holds it."""
    return text.rlike(FLAGS + "|".join(f"(?:{p})" for p, _, _ in table))


def suspect(text: Column, *tables) -> Column:
    """False for texts in which no pattern of the tables can match, true for few others.

    Letters that fold to i, k and s, as the patterns take them, are made so; the text is folded once.
    """
    folded = F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))
    parts = list(dict.fromkeys(x for t in tables for x in NEEDED[t]))
    held = lambda t: [t.contains(x) for x in parts]
    any_part = F.element_at(F.transform(F.array(folded), lambda t: functools.reduce(Column.__or__, held(t))), 1)
    if rules.INSECURE_PATTERNS not in tables:
        return any_part
    return any_part | ((text.contains('"') | text.contains("'")) & text.rlike(FLAGS + _QUOTED))


def matches(lines: DataFrame, table, names: tuple[str, str]) -> DataFrame:
    """A row per match of each pattern on each line."""
    hits = F.flatten(F.array(*(_hits(row, names) for row in table)))
    rest = [c for c in lines.columns if c != "text"]
    context = F.substring(stripped(F.col("text")), 1, 200).alias("context")
    return lines.select(*rest, context, F.explode(hits).alias("m")).select(*rest, "context", "m.*")


def _hits(row: tuple[str, str, str], names: tuple[str, str]) -> Column:
    pattern, first, second = row
    found = F.regexp_extract_all("text", F.lit(FLAGS + pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.lit(first).alias(names[0]), F.lit(second).alias(names[1]), m.alias("match")))


def pattern_findings(lines: DataFrame, table=rules.INSECURE_PATTERNS) -> DataFrame:
    """Findings on lines with a path: files of scanned kinds, not on lines that are only a comment."""
    ext = paths.extension(F.col("path"))
    # the costly test for comments only sees lines that match
    lines = lines.where(ext.isin(*rules.SCANNED) & suspect(F.col("text"), table) & any_of(F.col("text"), table)).where(~only_comment(F.col("text"), ext))
    return matches(lines, table, ("pattern", "severity")).withColumn("type", F.lit("pattern_match"))


def file_findings(files: DataFrame, table=rules.INSECURE_PATTERNS) -> DataFrame:
    """pattern_findings of whole files; only files in which a pattern can match are cut into lines."""
    scanned = paths.extension(F.col("path")).isin(*rules.SCANNED)
    return pattern_findings(lines_of(files.where(scanned & suspect(F.col("content"), table)).select("repo_id", "path", "content")), table)


def all_findings(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Pattern findings of all files and the dangerous calls of Python syntax trees (facts: see
    pyast.file_facts); a call that both see is reported by both."""
    calls = facts.where("kind = 'dangerous'").select(
        "repo_id", "path", "line", F.lit(None).cast("string").alias("context"), F.col("name").alias("pattern"), "severity",
        F.col("name").alias("match"), F.lit("dangerous_call").alias("type"),
    )
    return file_findings(files).unionByName(calls)


def secrets(lines: DataFrame, table=rules.SECRET_PATTERNS) -> DataFrame:
    text = F.col("text")
    return matches(lines.where(suspect(text, table) & any_of(text, table)), table, ("type", "risk_level"))


def security_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """keys with secrets_found, vulnerabilities_found and critical_count of their lines, and file_count, in one scan.

    Each line is tested once and each pattern counted once, on suspect lines only. Lines are summed by
    file first, so the files are counted without a distinct aggregate, which would read every line twice.
    """
    text, ext = F.col("text"), paths.extension(F.col("path"))
    count = lambda table: sum((F.regexp_count(text, F.lit(FLAGS + p)) for p, _, _ in table), F.lit(0))
    kinds = [[r for r in rules.INSECURE_PATTERNS if (r[2] == "critical") == worst] for worst in (False, True)]
    code = ext.isin(*rules.SCANNED) & suspect(text, rules.INSECURE_PATTERNS) & any_of(text, rules.INSECURE_PATTERNS) & ~only_comment(text, ext)
    found = F.when(code, F.struct(*(count(k).alias(n) for k, n in zip(kinds, ("plain", "critical"), strict=True))))
    secret = F.when(suspect(text, rules.SECRET_PATTERNS) & any_of(text, rules.SECRET_PATTERNS), count(rules.SECRET_PATTERNS))
    rows = lines.select(*keys, "path", secret.alias("secret"), found.alias("found"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    per_file = rows.groupBy(*keys, "path").agg(whole("secret").alias("s"), whole("found.plain").alias("p"), whole("found.critical").alias("c"))
    return per_file.groupBy(*keys).agg(
        F.sum("s").alias("secrets_found"), F.sum(F.col("p") + F.col("c")).alias("vulnerabilities_found"), F.sum("c").alias("critical_count"), F.count("*").alias("file_count")
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), severity)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", F.coalesce("severity", F.lit("medium")).alias("severity")).agg(F.count("*").alias("n"))


def by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", F.coalesce("pattern", F.lit("unknown")).alias("pattern")).agg(F.count("*").alias("n"))


def top_per_severity(findings: DataFrame, n: int = 10, kinds: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    order = W.partitionBy("repo_id", "severity").orderBy("path", "line", "pattern", "match")
    rows = findings.where(F.col("severity").isin(*kinds)).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= n)


def licence_of(text: Column) -> Column:
    """The first licence whose wording occurs, 'Proprietary' by its usual sentence, or null."""
    out = None
    for name, forms in rules.LICENCE_PATTERNS:
        hit = text.rlike("(?i)" + "|".join(forms))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(text.rlike("(?i)all rights reserved"), "Proprietary")


def licence_confidence(text: Column) -> Column:
    """0.4 for each licence whose wording occurs, 1 at most; 0.9 for the proprietary sentence alone."""
    kinds = sum((F.when(text.rlike("(?i)" + "|".join(forms)), 4).otherwise(0) for _, forms in rules.LICENCE_PATTERNS), F.lit(0))
    return F.when(kinds > 0, F.least(F.lit(10), kinds)).when(text.rlike("(?i)all rights reserved"), 9) / F.lit(10.0)


def primary_licence(found: DataFrame) -> DataFrame:
    """Per repository the licence of most confidence (ties: path); 'No License' where none was found.

    found: repo_id, path, licence (nullable), confidence.
    """
    order = F.struct(-F.col("confidence"), F.col("path"))
    best = F.min_by(F.struct("licence", "confidence"), F.when(F.col("licence").isNotNull(), order))
    best = found.groupBy("repo_id").agg(best.alias("b"))
    return best.select("repo_id", F.coalesce("b.licence", F.lit("No License")).alias("licence"), F.coalesce("b.confidence", F.lit(1.0)).alias("confidence"))


def licence_files(files: DataFrame) -> DataFrame:
    """Files at a repository's root (path relative to it) that are named like a licence."""
    return files.where(F.col("path").isin(*rules.LICENCE_FILES))


def licence_check(files: DataFrame) -> DataFrame:
    """Per repository with files: its licence by its licence files, and how many there are."""
    text = F.col("content")
    named = F.when(F.col("path").isin(*rules.LICENCE_FILES), text)
    found = files.select("repo_id", "path", licence_of(named).alias("licence"), licence_confidence(named).alias("confidence"))
    counts = files.groupBy("repo_id").agg(F.sum(F.col("path").isin(*rules.LICENCE_FILES).cast("long")).alias("licence_files"))
    return primary_licence(found).join(counts, "repo_id")


def requirements(files: DataFrame) -> DataFrame:
    """repo_id and name of each requirement: the text before the first <, = or > of lines that aren't comments."""
    line = stripped(F.col("text"))
    rows = lines_of(files).where((line != "") & ~line.startswith("#"))
    return rows.select("repo_id", stripped(F.regexp_extract(line, r"^([^<=>]*)", 1)).alias("name"))


def compatibility(primary: Column, other: Column) -> Column:
    out = F.when(F.lit(False), "")
    for a, b, verdict in rules.COMPATIBILITY:
        out = out.when((primary == a) & (other == b), verdict)
    return out.otherwise("unknown")
