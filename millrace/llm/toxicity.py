"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary labelled texts, one on those
windows of toxic texts that the dictionary of *other* toxic texts compresses better than it does
ordinary text. A document's windows are compressed with the ordinary dictionary alone and with
the toxic one before it; the bytes that the toxic dictionary saves, the greatest first, go
against a threshold that rises with the number of windows. Both are calibrated on labelled
documents that the dictionaries haven't seen.

The classifier is fitted in one task on a bounded sample of labelled rows (`toxic_rows`,
`ordinary_rows`, `longest_text` and `sample_bytes`); every document is scored over its whole text.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, held, map_batches

#: Bytes of a scored window, and of the smaller ones that the toxic dictionary is trained on.
WINDOW_BYTES, PIECE_BYTES, LEVEL = 64, 24, 6
#: Sizes of the two dictionaries, and the trainer's segments.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT = 200_000, 4096, 16
#: Rounds that choose windows of toxic texts, folds of the texts in each, and the share of
#: ordinary windows that a chosen window's gain must exceed.
ROUNDS, FOLDS, EXCEEDS = 4, 4, 0.995
#: The toxic dictionary's size in the first round; it halves from round to round.
FIRST_BYTES = 32_768
#: Bytes of the ordinary dictionary that stand before every window: a block that doesn't shrink
#: is stored raw, which would hide what either dictionary saves on the window itself.
FRAME = 64
#: The numbers of greatest gains whose sums are held against the threshold.
TOPS = (1, 2, 4, 8)
#: Fixed value: the last entry of a trained dictionary's header, before its content.
_REPS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


@dataclass
class Model:
    toxic: bytes  # the toxic dictionary, then the ordinary one
    ordinary: bytes  # as many zero bytes, then the ordinary dictionary
    weights: list[float]  # of the sums of the greatest gains; then the threshold's: of the windows' logarithm, and constant


def windows(text: str, size: int = WINDOW_BYTES) -> list[bytes]:
    """Consecutive pieces of at least size bytes, cut at spaces, over the whole text.

    Words begin with a capital and go on without, so a word's beginning is only like others' beginnings.
    """
    b = b" " + text.title().encode().replace(b"\n", b" ") + b" "
    at, last, out = 0, len(b) - 1, []
    while at < last:
        end = b.find(b" ", at + size)
        end = last if end < 0 else end
        out.append(b[at : end + 1])
        at = end
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on the samples; empty if they are too few for one."""
    import zstandard

    size = min(size, sum(map(len, samples)) // 2)
    if size < 256 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes().rpartition(_REPS)[2]
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress


class Scorer:
    def __init__(self, model: Model):
        # content of equal length, so that a match in the ordinary part lies equally far back in both
        self.plain, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)
        self.weights, self.frame = np.array(model.weights), model.ordinary[-FRAME:]

    def gains(self, pieces: list[bytes]) -> list[int]:
        plain, toxic = self.plain, self.toxic
        frame = self.frame
        return [len(plain(frame + w)) - len(toxic(frame + w)) for w in pieces]

    def telling(self, pieces: list[bytes], least: float) -> list[bytes]:
        """The words without which a piece that gains more than least would gain less."""
        out = []
        for w, g in zip(pieces, self.gains(pieces), strict=True):
            if g > least:
                words = w.split()
                without = [b" ".join([b"", *words[:i], *words[i + 1 :], b""]) for i in range(len(words))]
                out += [x for x, rest in zip(words, self.gains(without), strict=True) if g - rest >= 2]
        return [b" " + b" ".join(out) + b" "] if out else []

    def features(self, text: str) -> list[float]:
        gains = sorted(self.gains(windows(text)), reverse=True)
        return [*(float(sum(gains[:k])) for k in TOPS), math.log(len(gains) + 1), 1.0]

    def score(self, text: str) -> float:
        z = float(np.dot(self.features(text), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _pair(toxic: bytes, ordinary: bytes) -> Model:
    return Model(toxic + ordinary, bytes(len(toxic)) + ordinary, [0.0] * (len(TOPS) + 2))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def _unlike(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones (by four minima of their shingles' hashes)."""
    from .minhash import shingles, word_hashes

    seen, out = set(), []
    odd = [np.uint32(2 * k * 0x3C6EF35 + 1) for k in range(4)]
    for t in texts:
        x = shingles(word_hashes(t))
        keys = {(k, int((x * a).min())) for k, a in enumerate(odd)} if len(x) else set()
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def toxic_pieces(toxic: list[str], ordinary: bytes, noise: list[bytes], rng: random.Random) -> list[list[bytes]]:
    """The words of each toxic text that other toxic texts hold and ordinary ones don't.

    Each round deals the texts into folds, trains a dictionary on the other folds' choice and
    chooses in the fold what gains more by it than nearly all ordinary windows do, so that
    nothing is chosen for what only its own text says. The first choice is all windows; a round
    that leaves too little to train dictionaries on doesn't count.
    """
    every = [windows(t, PIECE_BYTES) for t in toxic]
    chosen = every
    for r in range(ROUNDS):
        after: list[list[bytes]] = [[] for _ in every]
        for f in range(FOLDS):
            d = _toxic_dictionary(chosen, f, max(TOXIC_BYTES, FIRST_BYTES >> r), rng)
            if not d:
                continue
            one = Scorer(_pair(d, ordinary))
            least = max(1.0, float(np.quantile(one.gains(noise), EXCEEDS))) if noise else 1.0
            for i in range(f, len(every), FOLDS):
                after[i] = one.telling(every[i], least)
        if not all(_toxic_dictionary(after, f, TOXIC_BYTES, random.Random(r)) for f in range(-1, FOLDS)):
            break  # of few texts little is left; the choice before is the last that dictionaries can be trained on
        chosen = after
    return chosen


def _toxic_dictionary(chosen: list[list[bytes]], fold: int, size: int, rng: random.Random) -> bytes:
    """Trained on what all folds but one have chosen (-1: on all)."""
    samples = [w for i, ws in enumerate(chosen) if i % FOLDS != fold for w in ws]
    rng.shuffle(samples)
    return dictionary(samples, size)


def train(toxic: list[str], ordinary: list[str], odds: float | None = None, seed: int = 11) -> Model:
    """The ordinary dictionary from three quarters of the ordinary texts; the rest is the measure
    of chance gains and calibrates, with the toxic texts under dictionaries of the other folds.

    odds: toxic to ordinary among all labelled rows, where the texts given are drawn in another
    proportion. With too few texts to train dictionaries on, everything scores alike, below 0.5.
    """
    rng = random.Random(seed)
    prior = min(-0.1, math.log((len(toxic) + 0.5) / (len(ordinary) + 0.5)))
    alike = Model(b"\0" * 8, b"\0" * 8, [0.0] * (len(TOPS) + 1) + [prior])
    toxic, ordinary = _unlike(toxic), _unlike(ordinary)
    aside = len(ordinary) // 4
    plain = [w for t in ordinary[aside:] for w in windows(t)]
    noise = [w for t in ordinary[:aside] for w in windows(t, PIECE_BYTES)]
    rng.shuffle(plain)
    base = dictionary(plain, ORDINARY_BYTES)
    if not base or not toxic or not aside:
        return alike
    chosen = toxic_pieces(toxic, base, noise, rng)
    final = _toxic_dictionary(chosen, -1, TOXIC_BYTES, rng)
    x, y = [], []
    for f in range(FOLDS):
        d = _toxic_dictionary(chosen, f, TOXIC_BYTES, rng)
        if d:
            one = Scorer(_pair(d, base))
            texts = toxic[f::FOLDS], ordinary[f:aside:FOLDS]
            x += [one.features(t) for ts in texts for t in ts]
            y += [v for v, ts in zip((1.0, 0.0), texts, strict=True) for _ in ts]
    if not final or not 0 < sum(y) < len(y):
        return alike
    w = _logistic(np.array(x), np.array(y))
    ratio = odds or len(toxic) / len(ordinary)
    w[-1] += math.log(ratio * (len(y) - sum(y)) / sum(y))
    w[-1] = min(w[-1], -0.1)  # an empty text never counts as toxic
    model = _pair(final, base)
    model.weights = w.tolist()
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 1200, ordinary_rows: int = 2400, longest_text: int = 1 << 17,
    sample_bytes: int = 24 << 20,
) -> Model:
    """Trains on at most so many labelled rows of each kind, chosen by a hash of doc_id.

    Labelled texts of more than longest_text bytes aren't learned from, nor any past sample_bytes
    in all. One task gets the sample and trains; the driver only sees the model.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # toxic, if a doc_id has both labels
    order = F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    chosen = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).union(known.where("toxic = 0").orderBy(*order).limit(ordinary_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= longest_text)
    # the chosen ids are few by their limits
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.repartition(1).sortWithinPartitions(*order)

    def learn(batches: Iterator[dict]) -> Iterator[dict]:
        kinds: tuple[list[str], list[str]] = ([], [])
        left = sample_bytes
        for b in batches:
            for kind, text in zip(b["toxic"], b["text"], strict=True):
                left -= len(text.encode())
                if left >= 0:
                    kinds[kind].append(text)
        m = train(kinds[1], kinds[0], odds)
        yield {"toxic": [m.toxic], "ordinary": [m.ordinary], "weights": [m.weights]}

    learned = map_batches(rows, learn, "toxic binary, ordinary binary, weights array<double>").collect()
    if not learned:  # nothing labelled, no task
        return train([], [])
    r = learned[0]
    return Model(bytes(r.toxic), bytes(r.ordinary), list(r.weights))


def _scorer(model: Model) -> Scorer:
    """The worker's scorer for a model, made once."""
    return held("toxicity", (model.toxic, *model.weights), lambda: Scorer(model))


def score(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 up) of every row's whole text.

    A null text counts as empty; a null doc_id is kept, is scored and isn't held out; repeated
    rows stay; with too few labels to learn from all rows score alike, below 0.5; an empty table gives an
    empty result; other columns are ignored.
    """
    model = fit(docs, labels, **sample)

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = _scorer(model)
        for b in batches:
            s = [scorer.score(t or "") for t in b["text"]]
            yield {"doc_id": b["doc_id"], "held_out": b["held"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held"), "text")
    return map_batches(rows, each, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, **sample: int) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns; a map-side filter."""
    model = fit(docs, labels, **sample)

    def clean(texts):
        scorer = _scorer(model)
        return pa.array([scorer.score(t or "") < 0.5 for t in texts.to_pylist()], pa.bool_())

    return docs.where(arrow_function(clean, "boolean")("text"))
