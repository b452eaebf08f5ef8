"""Token counts by a map-side two-tier lookup, without shuffling a pre-token.

Text is cut at white space into pre-tokens. Tier one is a broadcast hash table of the lengths of
frequent pre-tokens; tier two is a bounded cache in each Python worker that encodes what the
table lacks. No pre-token crosses a shuffle: the table is made in one task from a bounded sample
of documents. It only saves time; the counts are the library's whatever it holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Entries of a worker's cache before it starts afresh, which bounds its memory (some 20 MB).
CACHE_ENTRIES = 1 << 17
#: The word splitter's rule, for texts in Basic Latin and Latin-1 only.
_LATIN = "a-zªµºß-öø-ÿ"
_LATIN_PRE_TOKEN = re.compile(rf"[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼½¾]|[^\s{_LATIN}0-9²³¹¼½¾]+")
_NOT_LATIN = re.compile("[^!-~¡-ÿ]")
#: str.split() takes these as white space, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceCounter:
    """Counts tokens of one text: table, then cache, then the tokenizer.

    split(text) gives the pre-tokens, or None for a text that must be encoded whole;
    one(pre_token) gives a pre-token's count; whole(text) a text's.
    """

    def __init__(self, split: Callable, one: Callable, whole: Callable, table: dict[str, int] | None = None):
        self.split, self.whole = split, whole
        self.cache = _Cache(one, table or {})

    def count(self, text: str) -> int:
        pieces = self.split(text)
        return self.whole(text) if pieces is None else sum(map(self.cache.__getitem__, pieces))


class _Cache(dict):
    """A dict that fills its gaps by a function and starts afresh from the table when full."""

    def __init__(self, make: Callable, table: dict):
        super().__init__(table)
        self.make, self.table, self.limit = make, table, CACHE_ENTRIES + len(table)

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
            self.update(self.table)
        value = self[key] = self.make(key)
        return value


def word_counter(path: str, table: dict[str, int] | None = None) -> PieceCounter:
    """For a tokenizers file with word ends that lower-cases and drops white space."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, letters = tok.model, _byte_letters()
    special = re.compile("|".join(map(re.escape, (t.content for t in tok.get_added_tokens_decoder().values()))) or r"(?!)")

    def whole(text: str) -> int:
        return len(tok.encode(text, add_special_tokens=False).ids)

    inner = _Cache(lambda p: len(model.tokenize("".join([letters[b] for b in p.encode()]))), {})

    def one(piece: str) -> int:
        if _NOT_LATIN.search(piece):
            return whole(piece)
        return sum(map(inner.__getitem__, _LATIN_PRE_TOKEN.findall(piece.lower())))

    def split(text: str) -> list[str] | None:
        if "<|" in text and special.search(text) or _ODD_SPACE.search(text):
            return None
        return text.split()

    return PieceCounter(split, one, whole, table)


def sentencepiece_counter(path: str, table: dict[str, int] | None = None) -> PieceCounter:
    """For a sentencepiece model: every text is encoded whole, since pieces may cross spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return PieceCounter(lambda _: None, lambda p: 0, lambda t: len(model.encode(t, num_threads=1)), table)


_counters: dict = {}


def _counter(name: str, path_of: Callable[[str], str], table) -> PieceCounter:
    key = (name, id(table))
    if key not in _counters:
        _counters.clear()
        entries = {}
        if table is not None:
            words, lengths = table.value
            entries = dict(zip(words.split(" "), lengths, strict=True)) if words else {}
        make = sentencepiece_counter if name.endswith(".model") else word_counter
        _counters[key] = make(path_of(name), entries)
    return _counters[key]


def frequent_pieces(docs: DataFrame, text_col: str, one: Callable[[], Callable[[str], int]], table_size: int, sample_rows: int, longest_text: int = 1 << 16) -> dict[str, int]:
    """The lengths of the table_size most frequent pre-tokens of a sample of some sample_rows documents.

    one: makes, in the task, the function from a pre-token to its length. Texts of more than
    longest_text bytes aren't in the sample, so one task can hold it.
    """
    n = docs.count()
    texts = docs.select(text_col).where(F.octet_length(text_col) <= longest_text)
    texts = texts.sample(min(1.0, sample_rows / max(n, 1)), seed=7).repartition(1)

    def tops(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for b in batches:
            for text in b[text_col]:
                seen.update(text.split())
        top = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size] if len(p) < 256]
        yield {"piece": top, "length": list(map(one(), top))}

    # at most table_size short strings reach the driver
    return {r.piece: r.length for r in map_batches(texts, tops, "piece string, length int").collect()}


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    table_size: int = 16384,
    sample_rows: int = 2048,
    path_of: Callable[[str], str] = _public_path,
) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    tokenizer: a file name that path_of turns into a place on each executor. sample_rows: documents
    whose pre-tokens fill the table. A null text
    counts as empty (0, 0, false); a null id is kept; repeated rows stay repeated; an empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = None
    if not tokenizer.endswith(".model"):
        entries = frequent_pieces(docs, "text", lambda: _counter(tokenizer, path_of, None).cache.make, table_size, sample_rows)
        table = docs.sparkSession.sparkContext.broadcast((" ".join(entries), list(entries.values())))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        counter = _counter(tokenizer, path_of, table)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [counter.count(t) for t in texts]
            yield {
                "doc_id": b["doc_id"], "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
                "n_tokens": n, "over_limit": [x > limit for x in n],
            }

    return map_batches(docs, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
