"""Texts cut into runs that a byte pair encoder may encode one by one, vectorised over a batch.

A cut is made only where the vocabularies' splitters must cut, whatever stands around it: at white space, and between ASCII
letters, digits and other ASCII characters (not after an apostrophe, which may begin a contraction). Bytes from 128 on may
be letters, marks that compose with what precedes them, or symbols: no cut touches them. Texts with white space outside
ASCII or with special strings are not cut here (``plain`` is False): they take the slow way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whether a cut stands between two kinds.
_CUT = np.zeros((5, 5), bool)
_CUT[1:4, 1:4] = ~np.eye(3, dtype=bool)
_WIDE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


class Runs:
    """Of a list of texts as bytes: distinct runs, the run of each place, and where each text's places begin."""

    def __init__(self, texts: list[bytes], specials: tuple[bytes, ...], lower: bool, spaces: bool):
        """lower: fold A-Z. spaces: runs keep a space before them, and stretches of white space are cut before
        their last character where a word follows; else stretches of white space are runs of their own."""
        slow = re.compile(_WIDE + b"".join(b"|" + re.escape(s) for s in specials))
        self.plain = [not slow.search(t) for t in texts]
        used = [t if p else b"" for t, p in zip(texts, self.plain, strict=True)]
        data = np.frombuffer(b"".join(used), np.uint8)
        size = np.array([len(t) for t in used], np.int64)
        begin = np.cumsum(size) - size
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n:
            kind = _KIND[data]
            white = kind == 0
            edge = white[1:] != white[:-1]
            cut[1:n] = _CUT[kind[:-1], kind[1:]] & (data[:-1] != 39)
            cut[1:n] |= edge
            if spaces:
                last = white.copy()  # white space before a word of the same text
                last[:-1] &= ~white[1:]
                last[-1] = False
                last[begin[size > 0][1:] - 1] = False
                cut[:n] |= last
                cut[1:n] &= ~(last[:-1] & (data[:-1] == 32))  # the space goes with the word
            cut[begin[size > 0]] = True
        start = np.flatnonzero(cut[:n])
        offsets = np.append(start, n).astype(np.int32)
        source = LOWER[data] if lower else data
        array = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(source.tobytes())])
        coded = array.dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.place = coded.indices.to_numpy(zero_copy_only=False)
        self.begin = np.searchsorted(start, np.append(begin, n))


class Words:
    """The words (runs without the six ASCII white-space characters) of texts, as indices into ``distinct``, which holds stretches
    of white space too."""

    def __init__(self, texts: list[bytes], fold: bytes | None = None):
        """fold: a table of 256 bytes that all bytes go through first."""
        line = b"\n".join([b"", *texts, b""])  # texts are apart, and edges are all inside
        if fold:
            line = line.translate(fold)
        data = np.frombuffer(line, np.uint8)
        white = _KIND[data] == 0
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        start = edge[::2]  # the first is where a word begins
        offsets = np.concatenate([[0], edge, [len(data)]]).astype(np.int32)
        array = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(line)])
        coded = array.dictionary_encode()  # white space and all: it takes few entries
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy(zero_copy_only=False)[1:-1:2].astype(np.int64)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        upto = np.searchsorted(start, np.append(0, np.cumsum(size)) + 1)
        self.sizes = np.diff(upto)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word in turn."""
        from xxhash import xxh64_intdigest

        return np.fromiter(map(xxh64_intdigest, self.distinct), np.uint64, len(self.distinct))[self.index]
