"""Small tables and plain re-statements of the contracts."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus(n=60, seed=3):
    """Documents with copies, near copies, shared passages, a null, an empty and a long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(k))
    shared = text(70)
    out = []
    for i in range(n):
        t = text(r.choice([1, 3, 4, 5, 30, 120, 300]))
        if i % 7 == 0:
            t = text(20) + "\n" + shared + " " + text(10)
        if i % 9 == 0 and out:
            t = out[r.randrange(len(out))][1]
        if i % 11 == 0 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((i * 3, t, "en", f"src{i % 4}" if i % 5 else "src0", len(t)))
    out += [(1001, None, None, None, None), (1002, "", "en", "src1", 0), (1003, " \n\t ", "en", "src1", 4), (1004, text(9000), "en", "src2", 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
