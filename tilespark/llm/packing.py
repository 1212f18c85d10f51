"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document of n ids, n at most the capacity, stays whole: it is in class k = capacity // n, and a bin of class k takes exactly k
documents, whatever they are, so every worker fills its bins alone, without a shuffle, in one pass over its partition. What the classes
can't place is cut: documents longer than a sequence are *fillers*, whose ids fill the room that full bins leave (from LEAST on; less is padding) and,
beyond STOCK ids at hand, sequences of their own. Where more than WAIT full bins wait for fillers, the next document is one too.
When the partition ends, documents of bins that are still open (fewer than k in each class) go into the rooms that are left by first fit
decreasing, then fillers do, and at last the emptiest sequences' documents are cut to fill the others.

A sequence's id is the partition's number and a counter, so a task that runs again gives the same rows.

Ids are those of ``tokenizers`` with the vocabulary's default handling of special strings.  They are looked up by run (see
``runs``): the splitter's pattern never reaches across a run's ends.  Runs that the bounded memo lacks are encoded by the library in
batches.

Null and empty texts have the one closing id; ids may be null or repeated (each row is packed by itself); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilespark.llm import batches
from tilespark.llm.runs import Runs
from tilespark.llm.tokens import WHITE, tokenizer

CAPACITY = 2048
END = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
MEMO = 400_000
VOCABULARY = "byte_bpe_50k.json"
#: Ids of a piece that is worth its place, ids of fillers at hand, and full bins that wait for fillers.
LEAST, STOCK, WAIT = 32, 64 * CAPACITY, 32
_RUN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str | None = None, memo: int = MEMO):
        self.tok, self.most = tokenizer(path, VOCABULARY), memo
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {SPECIAL.encode(): 0}
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([SPECIAL_ID], np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        # runs of a batch are one text with the special string between them: a list of ids, not one for each run
        parts = []
        for i in range(0, len(new), 4096):
            (e,) = self.tok.encode_batch_fast([SPECIAL.encode().join(new[i : i + 4096]).decode() + SPECIAL], add_special_tokens=False)
            parts.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == SPECIAL_ID)
        size = np.diff(ends, prepend=-1) - 1
        keep = ids[ids != SPECIAL_ID]
        first = len(self.flat) + np.cumsum(size) - size
        self.memo.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        self.first, self.size, self.flat = np.append(self.first, first), np.append(self.size, size), np.append(self.flat, keep)

    def _slow(self, text: str) -> list[bytes]:
        out: list[bytes] = []
        for i, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL.encode()] * (i > 0) + [r.encode() for r in _RUN.findall(part)]
        return out

    def __call__(self, many: list[str]) -> list[np.ndarray]:
        r = Runs([t.encode() for t in many], (SPECIAL.encode(),), lower=False, spaces=True)
        slow = {i: self._slow(many[i]) for i, p in enumerate(r.plain) if not p}
        needed = [*r.distinct, *{x for s in slow.values() for x in s}]
        new = [x for x in needed if x not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self._clear()
            new = [x for x in needed if x not in self.memo]
        if new:
            self._learn(new)
        find = self.memo.__getitem__
        ids, upto = self._ids(np.fromiter(map(find, r.distinct), np.int64, len(r.distinct))[r.place])
        cut = upto[r.begin].tolist()
        out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i, s in slow.items():
            out[i] = self._ids(np.fromiter(map(find, s), np.int64, len(s)))[0]
        return [np.append(x, np.uint32(END)) for x in out]

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs one after another, and how many there are before each run and in all."""
        size = self.size[at]
        upto = np.append(0, np.cumsum(size))
        # the k-th id of a run is that many after its first in the flat array
        return self.flat[np.repeat(self.first[at] - upto[:-1], size) + np.arange(upto[-1])], upto


class Packer:
    """Bins of one worker. Sequences are lists of pieces (document, start, length)."""

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST, stock: int = STOCK, wait: int = WAIT):
        self.capacity, self.least, self.most, self.wait = capacity, min(least, capacity), stock, wait
        self.open: dict[int, list] = defaultdict(list)
        self.waiting: list[list] = []  # [room, pieces]
        self.fillers: deque = deque()  # [document, start, ids left]
        self.stock = 0

    def add(self, n: int, document) -> Iterator[list]:
        """Takes a document of n ids and gives sequences that are full by it."""
        if n > self.capacity or len(self.waiting) > self.wait:
            self.fillers.append([document, 0, n])
            self.stock += n
        else:
            k = self.capacity // n
            bin_ = self.open[k]
            bin_.append((document, 0, n))
            if len(bin_) == k:
                del self.open[k]
                self.waiting.append([self.capacity - sum(p[2] for p in bin_), bin_])
        yield from self._fill()
        while self.stock > self.most:
            yield self._cut(self.capacity)

    def _cut(self, room: int) -> list:
        """Pieces of fillers, room ids in all."""
        out = []
        while room:
            document, start, left = first = self.fillers[0]
            n = min(room, left)
            out.append((document, start, n))
            first[1:] = start + n, left - n
            if left == n:
                self.fillers.popleft()
            room -= n
            self.stock -= n
        return out

    def _fill(self) -> Iterator[list]:
        still = []
        for bin_ in self.waiting:
            room, pieces = bin_
            if room < self.least:
                yield pieces
            elif self.stock >= room:
                yield pieces + self._cut(room)
            else:
                still.append(bin_)
        self.waiting = still

    def rest(self) -> list[list]:
        """What is left, when nothing more comes."""
        done: list[list] = []
        bins = self.waiting
        whole = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2])
        self.open.clear()
        for p in whole:  # first fit decreasing; bins that nothing more fits into leave the search
            for b in bins:
                if b[0] >= p[2]:
                    b[0] -= p[2]
                    b[1].append(p)
                    break
            else:
                bins.append([self.capacity - p[2], [p]])
            least = whole[-1][2]
            if any(b[0] < max(least, self.least) for b in bins):
                done += [b[1] for b in bins if b[0] < self.least]
                bins = [b for b in bins if b[0] >= self.least]
        self.waiting = bins
        done += self._fill()
        while self.stock >= self.capacity:
            done.append(self._cut(self.capacity))
        if self.stock:
            room = self.capacity - self.stock
            self.waiting.append([room, self._cut(self.stock)])
        # the emptiest bins' documents fill the others as far as they reach
        bins = sorted(self.waiting, key=lambda b: b[0])
        while len(bins) > 1 and sum(b[0] for b in bins[:-1]) >= self.capacity - bins[-1][0]:
            for document, start, n in bins.pop()[1]:
                self.fillers.append([document, start, n])
                self.stock += n
            for b in bins:
                n = min(b[0], self.stock)
                b[1] += self._cut(n)
                b[0] -= n
            done += [b[1] for b in bins if b[0] < self.least]
            bins = [b for b in bins if b[0] >= self.least]
        self.waiting = []
        return done + [b[1] for b in bins]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("doc_id", batches.hold(kind)), *[(n, pa.int64()) for n in names], *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = Encoder(path), Packer(capacity)
        number, rows = TaskContext.get().partitionId() << 36, []

        def close(sequence: list) -> None:
            nonlocal number
            offset = 0
            for (doc_id, ids), start, length in sequence:
                part = ids[start : start + length]
                rows.append((doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), number, offset, *([part.astype(np.int32)] if with_ids else [])))
                offset += length
            number += 1

        def out() -> pa.RecordBatch:
            b = batches.batch(schema, [list(c) for c in zip(*rows, strict=True)])
            rows.clear()
            return b

        for b in batches.pieces(it, "text", 2 << 20):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(batches.texts(b)), strict=True):
                for sequence in packer.add(len(ids), (doc_id, ids)):
                    close(sequence)
            if len(rows) >= 5000:
                yield out()
        for sequence in packer.rest():
            close(sequence)
        if rows:
            yield out()

    ddl = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else "")
    return batches.mapped(docs.select("doc_id", "text"), run, ddl)


def op4_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
