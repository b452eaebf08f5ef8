"""Column expressions over paths, sizes, URLs and file contents."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    """The lower-cased text from the last dot on; '' if that dot starts or ends the name."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def category(path: Column) -> Column:
    return lookup(extension(path), rules.CATEGORIES, "other")


def metric_language(path: Column) -> Column:
    return lookup(extension(path), rules.METRIC_LANGUAGES, "")


def report_language(path: Column) -> Column:
    return lookup(extension(path), rules.REPORT_LANGUAGES, "")


def iterated_lines(content: Column) -> Column:
    """Lines as a file iterator sees them: a final line feed starts no line."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content == "", 0).otherwise(breaks + F.when(content.endswith("\n"), 0).otherwise(1)).cast("long")


def newline_lines(content: Column) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long")


def layer(path: Column) -> Column:
    out = None
    for part, name in rules.LAYERS.items():
        out = F.when(path.contains(part), name) if out is None else out.when(path.contains(part), name)
    return out.otherwise("other")


def scan_kept(rel: Column) -> Column:
    """Whether the repository walk reaches a path relative to its root."""
    parts = F.split(rel, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    pruned = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*rules.PRUNED_DIRECTORIES))
    return ~pruned & ~F.element_at(parts, -1).startswith(".")


def dangerous(path: Column) -> Column:
    return extension(path).isin(*rules.DANGEROUS)


def human_size(size: Column, decimals: int = 2, zero: str | None = None, largest: str = "TB") -> Column:
    """The 1024 ladder from B to TB, or to a lower unit that takes all that is larger."""
    form, out = f"%.{decimals}f %s", F.when(F.lit(False), "")
    if zero is not None:
        out = F.when(size == 0, zero)
    units = ("B", "KB", "MB", "GB", "TB")
    last = units.index(largest)
    for k, unit in enumerate(units[:last]):
        out = out.when(size < 1024.0 ** (k + 1), F.format_string(form, size.cast("double") / 1024.0**k, F.lit(unit)))
    return out.otherwise(F.format_string(form, size.cast("double") / 1024.0**last, F.lit(largest)))


def estimated_seconds(files: Column, security: bool = True, complexity: bool = True, depth: str = "standard") -> Column:
    scale = 0.1 * (1.5 if security else 1) * (1.3 if complexity else 1) * {"quick": 0.5, "standard": 1.0, "deep": 2.0}[depth]
    return F.greatest(F.lit(10), F.least(F.lit(300), (files * F.lit(scale)).cast("int")))


def archive_name(name: Column) -> Column:
    """A base name without reserved characters, ending in .zip."""
    clean = F.translate(basename(name), '<>:"/\\|?*', "_" * 9)
    return F.when(F.lower(clean).endswith(".zip"), clean).otherwise(F.concat(clean, F.lit(".zip")))


def valid_git_url(url: Column) -> Column:
    hosts = r"(github\.com|gitlab\.com|bitbucket\.org)"
    return F.lower(url).rlike(rf"^(https://{hosts}/|git@{hosts}:)")


def repository_address(url: Column) -> Column:
    """Struct of username, repo_name, repo_url and branch; null if nothing matches."""
    clean = F.regexp_replace(F.trim(url), "/+$", "")
    user = repo = None
    for form in rules.ADDRESS_FORMS:
        hit, u, r = clean.rlike(form), F.regexp_extract(clean, form, 1), F.regexp_extract(clean, form, 2)
        user, repo = (F.when(hit, u), F.when(hit, r)) if user is None else (user.when(hit, u), repo.when(hit, r))
    repo = F.replace(repo, F.lit(".git"), F.lit(""))
    full = F.concat(F.lit("https://github.com/"), user, F.lit("/"), repo, F.lit(".git"))
    whole = F.struct(user.alias("username"), repo.alias("repo_name"), full.alias("repo_url"), F.lit("main").alias("branch"))
    return F.when(user.isNotNull(), whole)


def repository_name(url: Column) -> Column:
    """The last part of an address's path without .git; of an SSH address, what follows its first colon."""
    web = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#;]*)", 1)
    tail = F.when(web, F.regexp_replace(path, r"^/+|/+$", "")).when(url.contains(":"), F.regexp_extract(url, r"^[^:]*:(.*)$", 1))
    tail = F.regexp_replace(tail, r"\.git$", "")
    name = F.coalesce(basename(F.regexp_replace(tail, r"/+$", "")), stem(F.regexp_replace(url, r"/+$", "")))
    name = F.regexp_replace(F.replace(name, F.lit(" "), F.lit("_")), r'[<>:"/\\|?*]', "")
    return F.when(name == "", "repository").otherwise(name)


def glob_regex(glob: str) -> str:
    """A gitignore-like glob as a regular expression; * crosses slashes."""
    anchored = glob.startswith("/")
    body = "".join({"*": ".*", "?": ".", "[": "[", "]": "]"}.get(c, re.escape(c)) for c in glob.strip("/"))
    return ("^" if anchored else "(^|/)") + body + "($|/)"


def ignored(rel: Column, globs: Iterable[str] = rules.IGNORE_GLOBS, last_wins: bool = False) -> Column:
    """Whether a relative path is ignored: the first rule that matches decides, or the last."""
    ordered = list(globs)[:: -1 if last_wins else 1]
    out = F.when(F.lit(False), F.lit(True))
    for g in ordered:
        negated = g.startswith("!")
        out = out.when(rel.rlike(glob_regex(g.lstrip("!"))), F.lit(not negated))
    return out.otherwise(F.lit(False))


def simply_ignored(path: Column, patterns: Iterable[str] = rules.SIMPLE_IGNORES) -> Column:
    """A component equals, the name matches, or the path contains one of the patterns."""
    parts, out = F.split(path, "/"), F.lit(False)
    for p in patterns:
        shape = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p) + "$"
        out = out | F.array_contains(parts, p) | basename(path).rlike(shape) | path.contains(p)
    return out


def upload_problem(name: Column, mime: Column, size: Column, max_mb: int = 100) -> Column:
    """Why an upload is refused, or null: no name, a wrong ending, a wrong type, too large."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "no filename").when(extension(name) != ".zip", "file type")
        .when((F.coalesce(mime, F.lit("")) != "") & ~mime.isin(*rules.UPLOAD_TYPES), "mime type").when(size > (max_mb << 20), "too large")
    )


def plain_repository_url(url: Column) -> Column:
    return url.rlike(r"^https://github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+/?$")


def known_status(status: Column) -> Column:
    return status.isin("pending", "processing", "extracting", "scanning", "generating_report", "completed", "failed")


def question_topic(message: Column) -> Column:
    """What a question without a language model is answered about; the first that matches."""
    text = F.lower(message)
    return (
        F.when(text.contains("readme"), "readme").when(text.contains("summary") | text.contains("analyze"), "summary")
        .when(text.contains("security"), "security").otherwise("other")
    )
