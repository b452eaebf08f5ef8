"""Quality rules over single documents, and lines that many documents of a host share.

A text's own facts (words, symbols, repeated lines and windows) come from one pass over it, which
also hashes its lines: lower-cased (A-Z) words with single spaces between them, together with the
host. Only these hashes are counted over all documents. A line is above the limits if more than
`most_docs` documents of the host hold it and it isn't the text of mostly one family of copies:
documents count as copies when the line stands beside the same other line, the one of the
document's least hash. Words of such lines are removed, and a document is rejected when too
few are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, member_filter

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_FACTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words stand in windows that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    same = ids[:n]
    for k in range(1, window):  # windows of equal numbers are equal: each step numbers them anew
        _, same = np.unique(same * len(number) + ids[k : k + n], return_inverse=True)
    often = np.bincount(same)[same] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= often
    return int(covered.sum())


def facts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def line_hashes(text: str, host: str | None) -> dict[int, int]:
    """The hash (first half of an MD5) of each normalised line that holds a word, with the words of all its repeats."""
    of_host = hashlib.md5(b"n\n" if host is None else b"h" + host.encode() + b"\n")
    out: dict[int, int] = {}
    for line in text.encode().lower().split(b"\n"):
        words = line.split()
        if words:
            h = of_host.copy()
            h.update(b" ".join(words))
            key = int.from_bytes(h.digest()[:8], "big")
            out[key] = out.get(key, 0) + len(words)
    return out


def rules(
    docs: DataFrame, host: str = "source", most_docs: int = 10, family_share: float = 0.5, least_share: float = 0.5, least_words: int = 25
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left and kept of each row.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    n_left: the words outside lines above the limits. kept: not base_failed, and n_left is
    least_words or more and least_share of the words or more.

    A line is above the limits if more than most_docs documents of its host hold it, of which no
    family of copies makes up more than family_share; so copies of one text don't count against
    its lines. Each row is a document: repeated rows and rows of one or no doc_id count and return
    as themselves (they are copies). A null text has no words and fails; rows without a host share
    one; an empty table gives an empty result; other columns are ignored, whatever their names.
    Lines are told apart by 64 bits, so with a billion lines above the limits one line in some ten
    billion is taken for one of them.
    """

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {k: [] for k in (*_FACTS, "lines", "words", "low", "next")}
            for text, at in zip(b["text"], b["host"], strict=True):
                for k, v in zip(_FACTS, facts(text or ""), strict=True):
                    out[k].append(v)
                found = line_hashes(text or "", at)
                h = np.array(list(found), np.uint64)
                least = np.sort(h)[:2].view(np.int64).tolist()
                out["lines"].append(h.view(np.int64))
                out["words"].append(list(found.values()))
                out["low"].append(least[0] if least else 0)
                out["next"].append(least[1] if len(least) > 1 else 0)
            yield {"row": b["row"], "doc_id": b["doc_id"], **out}

    schema = ", ".join(f"{k} {t}" for k, t in ({"row": "long", "doc_id": "long"} | _FACTS).items())
    columns = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"),
    )
    rows = materialize(map_batches(columns, each, f"{schema}, lines array<long>, words array<int>, low long, next long"))

    lines = rows.select("row", "low", "next", F.explode(F.arrays_zip("lines", "words")).alias("l"))
    lines = lines.select("row", "low", "next", F.col("l.lines").alias("line"), F.col("l.words").alias("n"))
    beside = F.when(F.col("line") == F.col("low"), F.col("next")).otherwise(F.col("low")).alias("beside")
    families = lines.select("line", beside).groupBy("line", "beside").agg(F.count("*").alias("docs"))
    held = families.groupBy("line").agg(F.sum("docs").alias("docs"), F.max("docs").alias("family"))
    above = materialize(held.where((F.col("docs") > most_docs) & (F.col("family") <= family_share * F.col("docs"))).select("line"))

    # a line that a third of the documents hold meets its one row in many tasks
    salts = 32
    spread = above.select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    near = lines.where(member_filter(above, "line")("line")).select("row", "line", "n", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    removed = near.join(spread, ["line", "salt"]).groupBy("row").agg(F.sum("n").alias("removed"))

    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    left = n - F.coalesce("removed", F.lit(0))
    out = rows.drop("lines", "words", "low", "next").join(removed, "row", "left")
    return out.select(
        "doc_id", *_FACTS, failed.alias("base_failed"), left.alias("n_left"),
        (~failed & (left >= least_words) & (left >= least_share * n)).alias("kept"),
    )
