"""Brown class-based bigrams: perplexity from word classes found by exchange.

1. Texts are cut into words once and written as tokens in bundles; each sends its distinct words and their training counts to the
   words' hash buckets, where counts meet (all words, no cut-off), and gets its words' counts and numbers back.
2. Seeds: exchange clustering on a matrix of fixed size, of bigrams of the FREQUENT most frequent words and of GROUPS groups of all other
   words by a hash of their last three bytes: each symbol in turn moves to the class that raises the likelihood of the class
   bigrams most, until a round moves nothing or ROUNDS are over. Ties go to the lower class; so runs agree.
3. Exchange over all words, distributed: bundles send how often each word stands before and after words of each class; in its bucket,
   every word seen LEAST times or more moves to the class that raises the likelihood most while all others stay (the FREQUENT keep the class that step 2 has found for them one by one). FULL rounds
   are made, the class bigrams are counted anew after each, and the assignment with the best likelihood on the training
   texts is kept, so rounds never worsen it. The clustered vocabulary grows with the corpus; only words seen less often, and
   unseen ones, have the class of their group.
4. Every text is scored: P(w | v) = P(class w | class v) P(w | class w), with
   P(c | b) = (n(b, c) + PRIOR p(c)) / (n(b) + PRIOR), p(c) = (n(c) + 1) / (N + CLASSES), and
   P(w | c) = (n(w) + 1) / (n(c) + V(c) + 1), where V(c) counts the distinct words of the class and 1 is left for unseen ones.

What the driver gathers is of fixed size: FREQUENT words, GROUPS sums, matrices of symbols and classes. A shuffled row has at least one word of its own.
Training documents are those whose crc32(doc_id as text) mod FOLDS is not HELD. A null id counts as an empty text there. Null
texts are empty: one end. Repeated rows all count. Without any training document all counts are 0. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm import batches, bundles, store
from tilespark.llm.runs import Words

FOLDS, HELD = 7, 2
FREQUENT, GROUPS, CLASSES = 512, 255, 48
ROUNDS = 12
FULL, LEAST = 2, 3
#: Bytes of text in a bundle.
SIZE = 8 << 20
PRIOR = 4.0
BUCKETS = 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def words_of(table: pa.Table) -> Words:
    return Words([t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()], _LOWER)


class Vocabulary:
    """The distinct words of a bundle, ordered by bucket and then by word; tokens as indices into them."""

    def __init__(self, table: pa.Table, n: int):
        found = words_of(table)
        self.held = np.array([held_out(x) for x in table.column("doc_id").to_pylist()], bool)
        self.sizes = found.sizes
        used = np.unique(found.index)  # without the entries of white space
        words = [found.distinct[i] for i in used.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % n for w in words), np.int64, len(words))
        order = sorted(range(len(words)), key=list(zip(bucket.tolist(), words, strict=True)).__getitem__)
        self.words = [words[i] for i in order]
        place = np.zeros(len(found.distinct), np.int64)
        place[used[order]] = np.arange(len(words))
        self.tokens = place[found.index]
        self.bucket = bucket[order]
        weight = np.repeat(~self.held, self.sizes)
        self.counts = np.bincount(self.tokens[weight], minlength=len(words)).astype(np.int64)


@dataclass
class Tokens:
    """A bundle: of each document id, fold and size in words, then all tokens as indices into words."""

    doc_id: pa.Array
    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    words: list[bytes]

    def line(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with each document's end, as the index after the last word; and where ends are."""
        ends = np.cumsum(self.sizes + 1) - 1
        out = np.full(len(self.tokens) + len(ends), len(self.words), np.int64)
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body] = self.tokens
        return out, ends


def save(folder: str, table: pa.Table, v: Vocabulary) -> str:
    sink = pa.BufferOutputStream()
    ids = table.select(["doc_id"]).combine_chunks()
    with pa.ipc.new_stream(sink, ids.schema) as out:
        out.write_table(ids)
    parts = [sink.getvalue().to_pybytes(), bundles.pack(v.held, v.sizes.astype(np.int64)), bundles.pack(v.tokens.astype(np.int32)), bundles.pack(np.frombuffer(b" ".join(v.words), np.uint8))]
    name = uuid.uuid4().hex
    store.put(f"{folder}/{name}", struct.pack("<4Q", *map(len, parts)) + b"".join(parts))
    return name


def load(folder: str, name: str) -> Tokens:
    data = bytes(store.get(f"{folder}/{name}"))
    at, parts = 32, []
    for n in struct.unpack("<4Q", data[:32]):
        parts.append(data[at : at + n])
        at += n
    held, sizes = bundles.unpack(parts[1], "?", "i8")
    words = bundles.unpack(parts[3], "u1")[0].tobytes()
    return Tokens(pa.ipc.open_stream(parts[0]).read_all().column("doc_id"), held, sizes, bundles.unpack(parts[2], "i4")[0], words.split(b" ") if words else [])


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


@dataclass
class Model:
    symbol: dict  # frequent word to its symbol; groups follow, then the end
    frequent: int
    cls: np.ndarray  # class of each symbol
    pairs: np.ndarray  # class bigrams
    types_in: np.ndarray  # distinct words of each class
    end_count: int
    tokens: int
    types: int

    def symbols(self, words: list[bytes]) -> np.ndarray:
        get, f = self.symbol.get, self.frequent
        return np.fromiter((f + group_of(w) if (s := get(w)) is None else s for w in words), np.int64, len(words))

    def movable(self, words: list[bytes], count: np.ndarray) -> np.ndarray:
        """Words that exchange over all words moves: those that the seeds know only by their group."""
        return np.fromiter((w not in self.symbol for w in words), bool, len(words)) & (count >= LEAST)

    def step(self) -> np.ndarray:
        """log10 P(class | class before)."""
        p = (self.pairs.sum(axis=0) + 1) / (self.tokens + CLASSES)
        return np.log10((self.pairs + PRIOR * p) / (self.pairs.sum(axis=1, keepdims=True) + PRIOR))

    def room(self) -> np.ndarray:
        """log10 (n(c) + V(c) + 1)."""
        return np.log10(self.pairs.sum(axis=0) + self.types_in + 1)


_REPLY = "kind int, bundle string, buckets binary, blob binary, word binary, grp int, n long, v long"
_REPLY_SCHEMA = pa.schema([("kind", pa.int32()), ("bundle", pa.string()), ("buckets", pa.binary()), ("blob", pa.binary()), ("word", pa.binary()), ("grp", pa.int32()), ("n", pa.int64()), ("v", pa.int64())])
_SEND = "bucket int, bundle string, blob binary, counts binary"
_SEND_SCHEMA = pa.schema([("bucket", pa.int32()), ("bundle", pa.string()), ("blob", pa.binary()), ("counts", pa.binary())])


def _count(docs: DataFrame, folder: str, n: int, frequent: int) -> DataFrame:
    """A table of what each task of the meeting says: for each bundle, the counts of its words in the task's buckets (kind 0; buckets
    has their numbers and lengths), the task's most frequent words (1), sums of words (n) and types (v) of each
    group (2); and each bundle's ends (3)."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.pieces(it, "text", SIZE):
            table = pa.Table.from_batches([b])
            v = Vocabulary(table, n)
            name = save(folder, table, v)
            rows = []
            start, size = bundles.runs_of(v.bucket)
            for s, k in zip(start.tolist(), size.tolist(), strict=True):
                words = np.frombuffer(b" ".join(v.words[s : s + k]), np.uint8)
                rows.append((int(v.bucket[s]), name, bundles.pack(words), bundles.pack(v.counts[s : s + k])))
            ends = np.array([int((~v.held).sum())], np.int64)
            rows.append((-1 - zlib.crc32(name.encode()) % n, name, b"", bundles.pack(ends)))
            yield batches.batch(_SEND_SCHEMA, [list(c) for c in zip(*rows, strict=True)])

    def meet(groups):
        replies: dict[str, list[tuple[int, np.ndarray]]] = {}
        best: list[tuple[int, bytes]] = []
        in_group, types = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        rows: list[tuple] = []
        for bucket, parts in groups:
            names, blobs, counts = (batches.column(parts, c) for c in ("bundle", "blob", "counts"))
            arrays = [bundles.unpack(c, "i8")[0] for c in counts]
            if bucket < 0:
                rows += [(3, b, None, None, None, None, int(a[0]), 0) for b, a in zip(names, arrays, strict=True)]
                continue
            lists = [bundles.unpack(b, "u1")[0].tobytes().split(b" ") for b in blobs]
            number: dict[bytes, int] = {}
            put = number.setdefault
            at = [np.array([put(w, len(number)) for w in ws], np.int64) for ws in lists]
            total = np.zeros(len(number), np.int64)
            for i, a in zip(at, arrays, strict=True):
                total[i] += a  # distinct words of one bundle
            for b, i in zip(names, at, strict=True):
                replies.setdefault(b, []).append((bucket, total[i], i))
            words = list(number)
            least = np.partition(total, -frequent)[-frequent] if len(total) > frequent else 0
            best += [(-int(total[i]), words[i]) for i in np.flatnonzero((total >= least) & (total > 0)).tolist()]
            best = sorted(best)[:frequent]
            group = np.fromiter((group_of(w) for w in words), np.int64, len(words))
            in_group += np.bincount(group, total, GROUPS).astype(np.int64)
            types += np.bincount(group, total > 0, GROUPS).astype(np.int64)
        for b, got in replies.items():
            where = np.array([(k, len(c)) for k, c, _ in got], np.int64)
            rows.append((0, b, bundles.pack(where[:, 0], where[:, 1]), bundles.pack(*(np.concatenate(c) for c in list(zip(*got, strict=True))[1:])), None, None, 0, 0))
        rows += [(1, None, None, None, w, None, -c, 0) for c, w in best]
        rows += [(2, None, None, None, None, g, int(in_group[g]), int(types[g])) for g in np.flatnonzero(types).tolist()]
        if rows:
            yield batches.batch(_REPLY_SCHEMA, [list(c) for c in zip(*rows, strict=True)])

    sent = batches.mapped(docs, send, _SEND)
    return store.table(batches.grouped(sent, "bucket", meet, _REPLY), "brown-counts")


def _bigrams(names: DataFrame, folder: str, symbol: dict, frequent: int) -> np.ndarray:
    """The matrix of symbol bigrams over the training texts."""
    s = frequent + GROUPS + 1
    end = s - 1
    model = Model(symbol, frequent, *([None] * 6))

    def tally(groups):
        matrix = np.zeros(s * s, np.int64)
        for name, _ in groups:
            t = load(folder, name)
            line, _ = t.line()
            ids = np.append(model.symbols(t.words), end)[line]
            before = np.append(end, ids[:-1]) if len(ids) else ids
            matrix += np.bincount((before * s + ids)[np.repeat(~t.held, t.sizes + 1)], minlength=s * s)
        rows = matrix.reshape(s, s)
        some = np.flatnonzero(rows.any(axis=1)).tolist()
        yield batches.batch(pa.schema([("i", pa.int32()), ("blob", pa.binary())]), [some, [bundles.pack(rows[i]) for i in some]])

    def add(groups):
        for i, parts in groups:
            total = sum(bundles.unpack(b, "i8")[0] for b in batches.column(parts, "blob"))
            yield batches.batch(pa.schema([("i", pa.int32()), ("blob", pa.binary())]), [[i], [bundles.pack(total)]])

    parts = batches.grouped(names, "bundle", tally, "i int, blob binary")
    out = np.zeros((s, s), np.int64)
    for r in batches.grouped(parts, "i", add, "i int, blob binary").collect():  # s rows of s numbers at most
        out[r.i] = bundles.unpack(bytes(r.blob), "i8")[0]
    return out


def exchange(n: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol, from counts of symbol bigrams: the end has the last class to itself."""
    s = len(n)
    weight = n.sum(axis=0) + n.sum(axis=1)
    order = np.lexsort((np.arange(s), -weight))
    order = order[order != s - 1]
    cls = np.empty(s, np.int64)
    cls[order] = np.arange(s - 1) % (classes - 1)
    cls[s - 1] = classes - 1
    one = np.eye(classes)[cls]
    f = n.astype(float)
    big = one.T @ f @ one
    from_, to = f @ one, f.T @ one  # counts with each class after, and before, each symbol

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            if not weight[w]:
                continue
            a, self_ = cls[w], f[w, w]
            out, into = from_[w], to[w]
            # without w: its counts leave row a and column a
            big[a] -= out
            big[:, a] -= into
            big[a, a] += self_
            rest_out, rest_in = out.copy(), into.copy()
            rest_out[a] -= self_
            rest_in[a] -= self_
            # sums that hold wherever w goes: what precedes it, and follows it, is in other rows and columns
            row, col = big.sum(axis=1) + rest_in, big.sum(axis=0) + rest_out
            # gain of adding w to each class b, relative to no w at all
            rows = xlogx(big + rest_out) - xlogx(big)
            cols = xlogx(big + rest_in[:, None]) - xlogx(big)
            both = np.diag(big)
            gain = rows.sum(axis=1) + cols.sum(axis=0) - np.diag(rows) - np.diag(cols) + xlogx(both + rest_out + rest_in + self_) - xlogx(both)
            total_out, total_in = out.sum(), into.sum()
            gain -= xlogx(row + total_out) - xlogx(row) + xlogx(col + total_in) - xlogx(col)
            b = int(np.argmax(gain[: classes - 1]))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            moved += b != a
            cls[w] = b
            if b != a:
                from_[:, a] -= f[:, w]
                from_[:, b] += f[:, w]
                to[:, a] -= f[w]
                to[:, b] += f[w]
                rest_out, rest_in = from_[w].copy(), to[w].copy()
                rest_out[b] -= self_
                rest_in[b] -= self_
            big[b] += rest_out
            big[:, b] += rest_in
            big[b, b] += self_
        if not moved:
            break
    return cls


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _summed(values: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """Sums of the values of each of m rows (row ascends)."""
    out = np.zeros((m, values.shape[1]))
    start, _ = bundles.runs_of(row)
    if len(start):
        out[row[start]] = np.add.reduceat(values, start, axis=0)
    return out


def best_classes(big: np.ndarray, out: np.ndarray, into: np.ndarray, self_: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The exchange step for m words: the class of each that gives the best likelihood of the class bigrams big while all other
    words stay. out and into count, for each word, the classes after and before it; self_ how often it follows itself (which
    out and into have in its own class); cls is where it is. The last class takes no words."""
    m, c = out.shape
    i = np.arange(m)
    rest_out, rest_in = out.copy(), into.copy()
    rest_out[i, cls] -= self_
    rest_in[i, cls] -= self_
    gain = np.zeros((m, c))
    for rest, mine, other, matrix in ((rest_out, out, into, big.T), (rest_in, into, out, big)):
        w, j = np.nonzero(rest)
        for lo in range(0, len(w), 1 << 15):  # cells (b, j), or (j, b), of the matrix without the word, for all b
            wi, ji = w[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            e, a = np.arange(len(wi)), cls[wi]
            cell = matrix[ji].astype(float)
            cell[e, a] -= mine[wi, ji]
            same = ji == a
            cell[same] -= other[wi[same]]
            cell[e[same], a[same]] += self_[wi[same]]
            more = _xlogx(cell + rest[wi, ji][:, None]) - _xlogx(cell)
            more[e, ji] = 0  # b itself: below
            gain += _summed(more, wi, m)
    diagonal = np.tile(np.diag(big).astype(float), (m, 1))
    diagonal[i, cls] -= out[i, cls] + into[i, cls] - self_
    gain += _xlogx(diagonal + rest_out + rest_in + self_[:, None]) - _xlogx(diagonal)
    for total, n in ((big.sum(axis=1), out.sum(axis=1)), (big.sum(axis=0), into.sum(axis=1))):
        left = np.tile(total.astype(float), (m, 1))
        left[i, cls] -= n
        gain -= _xlogx(left + n[:, None]) - _xlogx(left)
    best = np.argmax(gain[:, : c - 1], axis=1)
    return np.where(gain[i, best] > gain[i, cls] + 1e-9, best, cls)


def likelihood(big: np.ndarray) -> float:
    """Of class bigrams, but for what no assignment changes."""
    return float(_xlogx(big.astype(float)).sum() - _xlogx(big.sum(axis=0).astype(float)).sum() - _xlogx(big.sum(axis=1).astype(float)).sum())


@dataclass
class Arrived:
    """Of a bundle, in the order of its words: their buckets, counts, numbers within the bucket, and classes."""

    bucket: np.ndarray
    count: np.ndarray
    number: np.ndarray
    cls: np.ndarray


def _arrived(parts, seeds: np.ndarray) -> Arrived:
    """From the replies that a bundle has got (kinds 0, and 4 after a round of exchange); seeds are the classes before any."""
    got, moved = [], {}
    for kind, where, blob in zip(*(batches.column(parts, c) for c in ("kind", "buckets", "blob")), strict=True):
        if kind == 0:
            bucket, size = bundles.unpack(where, "i8", "i8")
            count, number = bundles.unpack(blob, "i8", "i8")
            cut = np.cumsum(size)[:-1]
            got += zip(bucket.tolist(), np.split(count, cut), np.split(number, cut), strict=True)
        elif kind == 4:
            moved[bundles.unpack(where, "i8")[0].item()] = bundles.unpack(blob, "u1")[0]
    got.sort(key=lambda x: x[0])
    if not got:
        return Arrived(*(np.zeros(0, np.int64) for _ in range(3)), seeds)
    bucket = np.repeat([k for k, _, _ in got], [len(c) for _, c, _ in got])
    cls = np.concatenate([moved[k] for k, _, _ in got]).astype(np.int64) if moved else seeds
    return Arrived(bucket, np.concatenate([c for _, c, _ in got]), np.concatenate([x for _, _, x in got]), cls)


_ROUND = "bucket int, bundle string, blob binary, words binary"
_ROUND_SCHEMA = pa.schema([("bucket", pa.int32()), ("bundle", pa.string()), ("blob", pa.binary()), ("words", pa.binary())])


def _class_pairs(t: Tokens, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training tokens and their class before, and the bundle's class bigrams; cls has the end's class last."""
    line, _ = t.line()
    c = cls[line]
    before = np.append(cls[-1], c[:-1]) if len(c) else c
    train = np.repeat(~t.held, t.sizes + 1)
    return line, before, np.bincount((before * CLASSES + c)[train], minlength=CLASSES * CLASSES)


def _round(counts: DataFrame, replies: DataFrame, folder: str, model: Model, n: int) -> DataFrame:
    """One round of exchange as a table like replies (kind 4 for the words of a bundle in a bucket), with partial sums of the class bigrams
    before the round (5: blob) and of the distinct words of each class after it (6)."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    big = None if model.pairs is None else model.pairs

    def contexts(groups):
        m = shared.value
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for name, parts in groups:
            t = load(folder, name)
            w = _arrived(parts, m.cls[m.symbols(t.words)])
            cls = np.append(w.cls, CLASSES - 1)
            line, before, pairs = _class_pairs(t, cls)
            total += pairs
            if big is None:
                continue
            train = np.repeat(~t.held, t.sizes + 1)
            c = cls[line]
            after = np.append(c[1:], CLASSES - 1) if len(c) else c
            # an end's next is the next text's first word; ends are not sent
            last = np.append(line[1:] == len(t.words), True) if len(line) else np.zeros(0, bool)
            after[last] = CLASSES - 1
            twice = np.append(False, line[1:] == line[:-1]) if len(line) else np.zeros(0, bool)
            own = train & (line < len(t.words))
            width = 2 * CLASSES + 1
            key = np.concatenate([line[own] * width + after[own], line[own] * width + CLASSES + before[own], line[own & twice] * width + 2 * CLASSES])
            key, often = np.unique(key, return_counts=True)
            word, what = key // width, (key % width).astype(np.uint8)
            rows = []
            start, size = bundles.runs_of(w.bucket)
            at = np.searchsorted(word, np.append(start, len(w.bucket)))
            for s, k, lo, hi in zip(start.tolist(), size.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                who = bundles.pack(w.number[s : s + k].astype(np.uint32), w.count[s : s + k], w.cls[s : s + k].astype(np.uint8), m.movable(t.words[s : s + k], w.count[s : s + k]))
                rows.append((int(w.bucket[s]), name, bundles.pack(w.number[word[lo:hi]].astype(np.uint32), what[lo:hi], often[lo:hi].astype(np.uint32)), who))
            yield batches.batch(_ROUND_SCHEMA, [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], [], []])
        yield batches.batch(_ROUND_SCHEMA, [[-1], [None], [bundles.pack(total)], [None]])

    def choose(groups):
        for bucket, parts in groups:
            names, blobs = batches.column(parts, "bundle"), batches.column(parts, "blob")
            if bucket < 0:
                total = sum(bundles.unpack(x, "i8")[0] for x in blobs)
                yield batches.batch(_REPLY_SCHEMA, [[5], [None], [None], [bundles.pack(total)], [None], [None], [0], [0]])
                continue
            who = [bundles.unpack(x, "u4", "i8", "u1", "?") for x in batches.column(parts, "words")]
            number, count, cls, movable = (np.concatenate(x) for x in zip(*who, strict=True))
            m = int(number.max()) + 1
            now, moves, seen = np.zeros(m, np.int64), np.zeros(m, bool), np.zeros(m, bool)
            now[number], moves[number], seen[number] = cls, movable, count > 0
            word, what, often = (np.concatenate(x) for x in zip(*(bundles.unpack(x, "u4", "u1", "u4") for x in blobs), strict=True))
            place = np.flatnonzero(moves)
            for lo in range(0, len(place), 1 << 14):
                some = place[lo : lo + (1 << 14)]
                at = np.full(m, -1)
                at[some] = np.arange(len(some))
                mine = at[word] >= 0
                width = 2 * CLASSES + 1
                table = np.bincount(at[word[mine]] * width + what[mine], often[mine], len(some) * width).reshape(-1, width)
                now[some] = best_classes(big, table[:, :CLASSES], table[:, CLASSES : 2 * CLASSES], table[:, -1], now[some])
            rows = [(4, b, bundles.pack(np.array([bucket], np.int64)), bundles.pack(now[x[0]].astype(np.uint8)), None, None, 0, 0) for b, x in zip(names, who, strict=True)]
            types = np.bincount(now[seen], minlength=CLASSES)
            rows += [(6, None, None, None, None, g, 0, int(types[g])) for g in np.flatnonzero(types).tolist()]
            yield batches.batch(_REPLY_SCHEMA, [list(x) for x in zip(*rows, strict=True)])

    asked = counts.filter("kind IN (0, 3)").select("kind", "bundle", "buckets", "blob")
    if replies is not None:
        asked = asked.unionByName(replies.filter("kind = 4").select("kind", "bundle", "buckets", "blob"))
    sent = batches.grouped(asked, "bundle", contexts, _ROUND)
    return store.table(batches.grouped(sent, "bucket", choose, _REPLY), "brown-round")


def _pairs_of(table: DataFrame) -> np.ndarray:
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for r in table.filter("kind = 5").select("blob").collect():  # one row of fixed size
        out += bundles.unpack(bytes(r.blob), "i8")[0]
    return out.reshape(CLASSES, CLASSES)


def fit(counts: DataFrame, folder: str, n: int, full: int = FULL) -> tuple[Model, DataFrame | None]:
    """The model, from all counts, and the table of the words' classes (None: seeds are the best)."""
    top = counts.filter("kind = 1").select("word", "n").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words = [bytes(r.word) for r in top]
    symbol = {w: i for i, w in enumerate(words)}
    group_n, group_v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in counts.filter("kind = 2").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        group_n[r.grp], group_v[r.grp] = r.n, r.v
    ends = counts.filter("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    tokens, types = int(group_n.sum()) + ends, int(group_v.sum()) + (ends > 0)
    for w in words:  # frequent words leave their groups
        group_v[group_of(w)] -= 1
    f = len(words)
    symbols = _bigrams(counts.filter("kind = 3").select("bundle"), folder, symbol, f)
    cls = exchange(symbols)
    one = np.eye(CLASSES, dtype=np.int64)[cls]
    model = Model(symbol, f, cls, one.T @ symbols @ one, one.T @ np.concatenate([np.ones(f, np.int64), group_v, [ends > 0]]), ends, tokens, types)
    best, replies = model, None
    trial, last = model, None
    for _ in range(full):
        last = _round(counts, last, folder, trial, n)
        # the bigrams of the new classes: a pass that moves nothing
        pairs = _pairs_of(_round(counts, last, folder, replace(trial, pairs=None), n))
        v = np.zeros(CLASSES, np.int64)
        for r in last.filter("kind = 6").groupBy("grp").agg(F.sum("v").alias("v")).collect():
            v[r.grp] = r.v
        v[CLASSES - 1] += ends > 0
        trial = replace(trial, pairs=pairs, types_in=v)
        if likelihood(pairs) > likelihood(best.pairs):
            best, replies = trial, last
    return best, replies


def score(docs: DataFrame, full: int = FULL) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = store.fresh(spark, "brown")
    slim = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = _count(slim, folder, n, FREQUENT)
    model, replies = fit(counts, folder, n, full)
    shared = spark.sparkContext.broadcast(model)
    names = [("doc_id", batches.hold(kind)), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())]
    schema = pa.schema(names)

    def run(groups):
        m = shared.value
        total, step, room = np.log10(m.tokens + m.types + 1), m.step(), m.room()
        for name, parts in groups:
            t = load(folder, name)
            w = _arrived(parts, m.cls[m.symbols(t.words)])
            line, ends = t.line()
            count, cls = np.append(w.count, m.end_count), np.append(w.cls, CLASSES - 1)
            seen = np.log10(count + 1.0)
            c = cls[line]
            before = np.append(cls[-1], c[:-1]) if len(c) else c
            scores = step[before, c] + seen[line] - room[c]
            begin = ends - t.sizes
            sums = [np.add.reduceat(x, begin) for x in (seen[line] - total, scores, (count > 0)[line].astype(np.int64))]
            size = t.sizes + 1
            yield batches.batch(schema, [t.doc_id.to_pylist(), t.held, size, sums[2], np.full(len(size), m.tokens), sums[0], sums[1]])

    asked = counts.filter("kind IN (0, 3)").select("kind", "bundle", "buckets", "blob")
    if replies is not None:
        asked = asked.unionByName(replies.filter("kind = 4").select("kind", "bundle", "buckets", "blob"))
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return batches.grouped(asked, "bundle", run, ddl)


def op5_brown_scores(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
