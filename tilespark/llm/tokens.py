"""Token counts of whole texts, as a ``tokenizers`` vocabulary gives them.

Huge texts go through overlap resynchronisation: chunks that overlap are encoded with offsets and spliced inside
the overlap at a boundary that is proven stable.  With this vocabulary white space ends every piece of text that the
encoder looks at (normalisation maps runs of it to one space and composes nothing across it, the splitter drops
it, and no special string holds any), so the tokens left of a white-space character don't depend on what follows
it, nor those right of it on what precedes.  A splice needs such a character inside the overlap, and both encodings must
give the same tokens from there to the next one.  Where that fails the overlap is doubled, back to the last splice if need
be; a text without white space is then encoded whole.

Other texts are counted by runs (see ``runs``), cut at white space and other places where the splitter must cut: a run's count
is looked up in a bounded memo, and runs that are not there are encoded by the library in one batch.

Null texts are empty (0 tokens); ids may be null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilespark.llm import batches
from tilespark.llm.runs import Runs

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk and of an overlap of huge texts.
CHUNK, OVERLAP = 32_768, 512
#: Runs that a worker remembers.
MEMO = 400_000

#: Unicode White_Space, what the vocabulary's patterns call \s (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[^{WHITE}]+")
_SPACE = re.compile(f"[{WHITE}]")
#: str.split() also splits at these, which are not White_Space.
_ODD = re.compile("[\x1c-\x1f]")


@lru_cache(2)
def tokenizer(path: str | None, name: str = VOCABULARY):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(name))


def runs(text: str) -> list[str]:
    return _RUN.findall(text) if _ODD.search(text) else text.split()


def spliced_ids(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of the whole text from overlapping chunks of it."""
    out: list[int] = []
    at = 0  # where the left chunk begins: the text's start or a splice
    end = min(len(text), chunk)
    left = tok.encode(text[at:end], add_special_tokens=False)
    while end < len(text):
        wide = overlap
        while True:
            begin = max(at, end - wide)
            stop = min(len(text), begin + max(chunk, 2 * wide))
            right = tok.encode(text[begin:stop], add_special_tokens=False)
            splice = _splice(text, left, at, right, begin, end)
            if splice is not None or begin == at:
                break
            wide *= 2
        if splice is None:  # no stable boundary in the whole left chunk: the right one begins with it and is longer
            left, end = right, stop
            continue
        out += left.ids[: _first(left, splice - at)]
        # the right chunk's tokens from the splice on become the left of the next round
        at, end = splice, stop
        left = _Tail(right, _first(right, splice - begin), splice - begin)
    return out + list(left.ids)


class _Tail:
    """An encoding from one of its tokens on, with offsets from a splice."""

    def __init__(self, e, first: int, shift: int):
        self.ids = e.ids[first:]
        self.offsets = [(a - shift, b - shift) for a, b in e.offsets[first:]]


def _first(e, at: int) -> int:
    """Tokens of the encoding that begin before the character at."""
    from bisect import bisect_left

    return bisect_left([o[0] for o in e.offsets], at)


def _splice(text: str, left, at: int, right, begin: int, end: int) -> int | None:
    """A white-space character in [begin, end) from which on, up to the next one, both encodings agree."""
    places = [m.start() for m in _SPACE.finditer(text, begin, end)]
    for i in sorted(range(len(places) - 1), key=lambda i: abs(2 * i - len(places))):  # from the middle
        p, q = places[i], places[i + 1]
        a = left.ids[_first(left, p - at) : _first(left, q - at)]
        if a == right.ids[_first(right, p - begin) : _first(right, q - begin)]:
            return p
    return None


class Counter:
    """Counts of tokens by text, with a bounded memo of runs."""

    def __init__(self, path: str | None = None, memo: int = MEMO, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tok, self.most, self.chunk, self.overlap, self.memo = tokenizer(path), memo, chunk, overlap, {}
        self.specials = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())

    def _learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), 4096):
            got = self.tok.encode_batch_fast([r.decode() for r in new[i : i + 4096]], add_special_tokens=False)
            self.memo.update(zip(new[i : i + 4096], map(len, got), strict=True))

    def __call__(self, many: list[str]) -> list[int]:
        huge = [len(t) > self.chunk for t in many]
        r = Runs([b"" if h else t.encode() for t, h in zip(many, huge, strict=True)], self.specials, lower=True, spaces=False)
        slow = [runs(t) if not (h or p) else [] for t, h, p in zip(many, huge, r.plain, strict=True)]
        needed = [*r.distinct, *{x.encode() for s in slow for x in s}]
        new = [x for x in needed if x not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = needed
        self._learn(new)
        count = self.memo.__getitem__
        each = np.fromiter(map(count, r.distinct), np.int64, len(r.distinct))
        upto = np.append(0, np.cumsum(each[r.place]))
        fast = np.diff(upto[r.begin]).tolist()
        return [
            len(spliced_ids(self.tok, t, self.chunk, self.overlap)) if h else f if p else sum(count(x.encode()) for x in s)
            for t, h, p, f, s in zip(many, huge, r.plain, fast, slow, strict=True)
        ]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", batches.hold(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for b in batches.pieces(it, "text"):
            texts = batches.texts(b)
            n = count(texts)
            yield batches.batch(schema, [b.column("doc_id"), [len(t.encode()) for t in texts], n, [x > limit for x in n]])

    return batches.mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
