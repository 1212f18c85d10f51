"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of a document. A word goes if a window over it also starts in a document with a
smaller id. Texts are written once as bundles; everything that moves is packed arrays:

1. Each window elects an anchor, its smallest PHRASE-word phrase by hash. Equal windows elect the same anchor, so a window can
   only recur if its anchor is elected in two documents. A task merges what its bundles elect into one entry an anchor before
   anchors are dealt out by hash; those elected in two documents or more are confirmed as candidates.
2. Passages, the stretches of windows with confirmed anchors, are dealt out by anchor as words, each passage once for all of its
   places in a parcel of bundles. An anchor with more than HOT elections is split: each of its windows goes by its own hash.
3. Each shard takes the words of the phrases that two of its passages elect, compiles them into one Aho-Corasick automaton (pyahocorasick) over words, a letter
   for each distinct word, and streams all of its passages through: where else a phrase stands is found by the automaton alone. Only windows that hold a located phrase are looked at: they are
   compared by phrase, its place in the window and then word by word, and give the smallest document that has them. Parcels get
   back the windows that a smaller document has.
4. Each bundle marks the words of those windows and the kept words come out.

So a document's words meet only the automata of shards that may hold phrases of it, whatever the number of phrases; streaming every document through every shard would read
all texts once for each shard, and shards grow with the texts. Hashes
choose what is looked at; windows are equal if all their words are. A shuffled row has at least one anchor or passage of its own, so packing them never
makes more rows than there are anchors and passages; a passage that is in every document is one entry a parcel.

Ids are integers; a null id counts as larger than any, and documents with equal ids don't affect each other. Null, empty and short
texts have no windows and lose nothing. An empty table gives no rows. Further columns are kept by ``dedup`` and
ignored by ``digests``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilespark.llm import batches, bundles, store
from tilespark.llm.runs import Words

WINDOW = 13
PHRASE = 6
#: Groups by hash for each shuffle partition.
BUCKETS = 4
#: Bytes of text of the bundles that a task merges before it deals anything out.
PARCEL = 32 << 20
#: Elections of an anchor for each part that its windows are split into.
HOT = 4096
_LAST = np.iinfo(np.int64).max
_PACKED = "bucket int, parcel string, blob binary, words binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("parcel", pa.string()), ("blob", pa.binary()), ("words", pa.binary())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Of the documents of a bundle: words' hashes, windows and their anchors."""

    def __init__(self, texts: list[bytes]):
        self.words = Words(texts)
        self.sizes, self.hash = self.words.sizes, self.words.hashes()
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        self.phrase = bundles.rolling(self.hash, PHRASE, 1)
        n = max(0, len(self.hash) - WINDOW + 1)
        self.start = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        self.anchor = _least(self.phrase, n)[self.start]

    def elected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, how often each is elected, and whether two documents elect it."""
        order = np.argsort(self.anchor, kind="stable")
        doc = self.doc[self.start][order]
        anchor = self.anchor[order]
        start, size = bundles.runs_of(anchor)
        return anchor[start], size, doc[start] != doc[start + size - 1]


def _least(phrases: np.ndarray, n: int) -> np.ndarray:
    """The least of the phrases of each of n windows."""
    out = phrases[:n].copy()
    for j in range(1, WINDOW - PHRASE + 1):
        np.minimum(out, phrases[j : j + n], out=out)
    return out


def _merged(anchor: np.ndarray, n: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry an anchor from entries of several bundles or parcels."""
    order = np.argsort(anchor, kind="stable")
    anchor, n, twice = anchor[order], n[order], twice[order]
    start, size = bundles.runs_of(anchor)
    if not len(start):
        return anchor, n, twice
    return anchor[start], np.add.reduceat(n, start), np.logical_or.reduceat(twice, start) | (size > 1)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and where it is, order kept."""
    order = np.argsort(bucket, kind="stable")
    start, size = bundles.runs_of(bucket[order])
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        yield int(bucket[order[s]]), order[s : s + k]


def _present(parcel: str, n: int, told: str) -> tuple:
    """A row that tells a parcel's bundles (and the file of its passages' places)."""
    return -1 - zlib.crc32(parcel.encode()) % n, parcel, told.encode(), None


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of each range."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class Parcel:
    """Passages of several bundles, each once."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.held: list[tuple] = []

    def add(self, bundle: int, w: Windows, ids: np.ndarray, anchors: np.ndarray, splits: np.ndarray, n: int) -> None:
        """Passages of a bundle's windows whose anchors are among the confirmed ones (sorted)."""
        if not len(anchors) or not len(w.start):
            return
        at = np.minimum(np.searchsorted(anchors, w.anchor), len(anchors) - 1)
        keep = anchors[at] == w.anchor
        start, anchor, parts = w.start[keep], w.anchor[keep], splits[at[keep]]
        if not len(start):
            return
        hot = parts > 1
        if hot.any():
            anchor[hot] ^= bundles.mixed(bundles.rolling(w.hash, WINDOW, 2)[start[hot]] % parts[hot].astype(np.uint64) + np.uint64(1))
        bucket = (bundles.mixed(anchor) % np.uint64(n)).astype(np.int32)
        doc = w.doc[start]
        new = np.append(True, (np.diff(start) > 1) | (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(start))) + WINDOW - 1
        begin = start[first]
        said = w.words.index[_ranges(begin, size)]
        used = np.flatnonzero(np.bincount(said, minlength=len(w.words.distinct)))
        put, spelled = self.number.setdefault, np.zeros(len(w.words.distinct), np.int32)
        spelled[used] = [put(w.words.distinct[i], len(self.number)) for i in used.tolist()]
        self.held.append((bucket[first], size, ids[doc[first]], np.full(len(first), bundle, np.uint32), begin.astype(np.uint32), spelled[said]))

    def close(self) -> tuple[list[np.ndarray], list[tuple]]:
        """The places of all passages (passage, bundle, start, id), and rows (bucket, arrays, words) of distinct passages."""
        if not self.held:
            return [np.zeros(0, k) for k in ("u4", "u4", "u4", "i8")], []
        bucket, size, ids, bundle, begin, flat = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held.clear()
        at = np.cumsum(size) - size
        inside = (np.arange(len(flat)) - np.repeat(at, size)).astype(np.uint64)
        mark = np.add.reduceat(bundles.mixed((flat.astype(np.uint64) + np.uint64(1)) * _ODD + inside), at)
        order = np.lexsort((size, mark, bucket))
        a, b = order[:-1], order[1:]
        same = (bucket[a] == bucket[b]) & (mark[a] == mark[b]) & (size[a] == size[b])
        a, b = a[same], b[same]
        if len(a):  # word by word
            differ = flat[_ranges(at[a], size[a])] != flat[_ranges(at[b], size[b])]
            same[np.flatnonzero(same)[np.logical_or.reduceat(differ, np.cumsum(size[a]) - size[a])]] = False
        first = np.flatnonzero(np.append(True, ~same))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        least, most = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        one = order[first]
        words = pa.array([*(x + b" " for x in self.number), b"\n"], pa.binary())
        rows = []
        for k, g in _by_bucket(bucket[one]):
            n = size[one[g]]
            line = np.full(int(n.sum()) + len(g), len(self.number), np.int32)
            body = np.ones(len(line), bool)
            body[np.cumsum(n + 1) - 1] = False
            line[body] = flat[_ranges(at[one[g]], n)]
            said = words.take(pa.array(line))
            raw = said.buffers()[2]
            text = bundles.pack(np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8))
            rows.append((k, bundles.pack(g.astype(np.uint32), n.astype(np.uint32), least[g], most[g]), text))
        return [group.astype(np.uint32), bundle[order], begin[order], ids[order]], rows


def alphabet(words: np.ndarray) -> str:
    """A letter for each word's number, none of which is a surrogate; the number -1 is the letter 0."""
    code = words.astype(np.uint32) + np.uint32(1)
    code[code >= 0xD800] += np.uint32(0x800)
    return code.astype("<u4").tobytes().decode("utf-32-le")


#: Distinct words that letters suffice for.
_LETTERS = 0x10FFFF - 0x800


def elected_at(start: np.ndarray, anchor: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where each window has the phrase that it elects."""
    at = start.copy()
    for j in reversed(range(WINDOW - PHRASE + 1)):
        at = np.where(phrase[start + j] == anchor, start + j, at)
    return at


def located(line: str, phrases: list[str]) -> np.ndarray:
    """Where phrases begin in the line, by an Aho-Corasick automaton, and -1 elsewhere the phrase's number: an array over the line."""
    import ahocorasick

    found = np.full(len(line), -1, np.int64)
    if phrases:
        machine = ahocorasick.Automaton()
        for k, x in enumerate(phrases):
            machine.add_word(x, k)
        machine.make_automaton()
        hits = np.array(list(machine.iter(line)), np.int64).reshape(-1, 2)
        found[hits[:, 0] - (PHRASE - 1)] = hits[:, 1]
    return found


def recurring(texts: list[bytes], size: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's passages (texts hold them one a line, sizes in words, the smallest and largest document of each): windows that a
    smaller document has, as passage, offset and that document."""
    words = Words([b"".join(texts)])
    if len(words.distinct) > _LETTERS:
        raise ValueError("a shard has too many distinct words: raise spark.sql.shuffle.partitions")
    total, of = len(words.index), np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    # confirm: phrases that windows of two passages, or of one that several documents have, elect
    phrase = bundles.rolling(words.hashes(), PHRASE, 1)
    n = max(0, total - WINDOW + 1)
    start = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    anchor = _least(phrase, n)[start]
    order = np.argsort(anchor, kind="stable")
    first, count = bundles.runs_of(anchor[order])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = of[start][order]
    several = (least != most)[by]
    shared = (by[first] != by[first + count - 1]) | np.logical_or.reduceat(several, first)
    # spell passages as letters, each with a 0 after it, and stream them through the automaton of the confirmed phrases
    letters = np.full(total + len(size), -1, np.int64)
    place = np.arange(total) + of
    letters[place] = words.index
    line = alphabet(letters)
    some = np.repeat(shared, count)
    at, lead = elected_at(start[order][some], anchor[order][some], phrase), np.cumsum(count[shared]) - count[shared]
    other = np.zeros(len(at), bool)  # another phrase than the first of its hash
    leader = np.repeat(at[lead], count[shared])
    for j in range(PHRASE):
        other |= words.index[at + j] != words.index[leader + j]
    other[lead] = True
    told = at[other]
    hit = located(line, list(dict.fromkeys(line[p : p + PHRASE] for p in place[told].tolist())))[place]
    # a window's first located phrase and its place
    nearest = np.where(hit >= 0, np.arange(total), total + WINDOW)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    offset = nearest[start] - start
    keep = offset <= WINDOW - PHRASE
    start, offset = start[keep], offset[keep]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = hit[start + offset] * WINDOW + offset
    rest = bundles.rolling(bundles.mixed(words.index.astype(np.uint64) + _ODD), WINDOW, 2)[start]
    order = np.lexsort((rest, key))
    start, key, rest = start[order], key[order], rest[order]
    new = np.append(True, (key[1:] != key[:-1]) | (rest[1:] != rest[:-1]))
    leader = start[np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))]
    if any((words.index[start + j] != words.index[leader + j]).any() for j in range(WINDOW)):  # hashes collide: sort by all words
        order = np.lexsort([words.index[start + j] for j in range(WINDOW)])
        start = start[order]
        new = np.append(True, np.logical_or.reduce([np.diff(words.index[start + j]) != 0 for j in range(WINDOW)]))
    lead = np.flatnonzero(new)
    p = of[start]
    smallest = np.repeat(np.minimum.reduceat(least[p], lead), np.diff(np.append(lead, len(start))))
    goes = most[p] > smallest
    return p[goes], (start - begin[p])[goes], smallest[goes]


def _rows(rows: list) -> pa.RecordBatch:
    return batches.batch(_SCHEMA, [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []])


def _raw(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def _marked(docs: DataFrame, folder: str, ddl: str, made) -> DataFrame:
    """made(table, list of word masks or None) for every bundle, where a mask is True at words that go."""
    spark = docs.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def elect(it):
        held: list[tuple] = []
        names: list[str] = []

        def done():
            parcel = uuid.uuid4().hex
            anchor, often, twice = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            bucket = (bundles.mixed(anchor) % np.uint64(n)).astype(np.int32)
            rows = [(k, parcel, bundles.pack(anchor[at], often[at], twice[at]), None) for k, at in _by_bucket(bucket)]
            return _rows([*rows, _present(parcel, n, "\n".join(names))])

        size = 0
        for name, table in bundles.write(it, folder):
            held.append(Windows(_raw(table)).elected())
            names.append(name)
            size += table.column("text").nbytes
            if size >= PARCEL:
                yield done()
                held, names, size = [], [], 0
        if names:
            yield done()

    def confirm(groups):
        for bucket, parts in groups:
            parcels, blobs = batches.column(parts, "parcel"), batches.column(parts, "blob")
            if bucket < 0:
                yield _rows([(bucket, p, b, None) for p, b in zip(parcels, blobs, strict=True)])
                continue
            got = [bundles.unpack(x, "u8", "i8", "?") for x in blobs]
            anchor, often, twice = _merged(*(np.concatenate(c) for c in zip(*got, strict=True)))
            anchor, often = anchor[twice], often[twice]
            rows = []
            for p, (mine, _, _) in zip(parcels, got, strict=True):
                if len(anchor):
                    at = np.minimum(np.searchsorted(anchor, mine), len(anchor) - 1)
                    at = at[anchor[at] == mine]
                    if len(at):
                        rows.append((bucket, p, bundles.pack(anchor[at], -(-often[at] // HOT)), None))
            yield _rows(rows)

    def told(parts) -> tuple[list[str], list[bytes]]:
        """What the parcel's own row tells, and the other blobs."""
        got = list(zip(batches.column(parts, "bucket"), batches.column(parts, "blob"), strict=True))
        return next(b for k, b in got if k < 0).decode().split("\n"), [b for k, b in got if k >= 0]

    def locate(groups):
        for parcel, parts in groups:
            names, blobs = told(parts)
            got = [bundles.unpack(x, "u8", "i8") for x in blobs] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            anchor, splits = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.argsort(anchor)
            anchor, splits, held = anchor[order], splits[order], Parcel()
            for i, name in enumerate(names if len(anchor) else []):
                table = bundles.read(folder, name)
                held.add(i, Windows(_raw(table)), _ids(table), anchor, splits, n)
            places, rows = held.close()
            file = uuid.uuid4().hex
            store.put(f"{folder}/{file}", bundles.pack(*places))
            yield _rows([_present(parcel, n, "\n".join([file, *names]))])
            for i in range(0, len(rows), 64):
                yield _rows([(k, parcel, blob, words) for k, blob, words in rows[i : i + 64]])

    def first(groups):
        for bucket, parts in groups:
            parcels, blobs = batches.column(parts, "parcel"), batches.column(parts, "blob")
            if bucket < 0:
                yield _rows([(bucket, p, b, None) for p, b in zip(parcels, blobs, strict=True)])
                continue
            got = [bundles.unpack(x, "u4", "u4", "i8", "i8") for x in blobs]
            number, size, least, most = (np.concatenate(c) for c in zip(*got, strict=True))
            texts = [bundles.unpack(x, "u1")[0].tobytes() for x in batches.column(parts, "words")]
            passage, offset, smallest = recurring(texts, size.astype(np.int64), least, most)
            of = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])[passage]
            yield _rows([(bucket, parcels[k], bundles.pack(number[passage[at]], offset[at].astype(np.uint32), smallest[at]), None) for k, at in _by_bucket(of)])

    def mark(groups):
        for _, parts in groups:
            (file, *names), blobs = told(parts)
            got = [bundles.unpack(x, "u4", "u4", "i8") for x in blobs] or [(np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
            passage, offset, smallest = (np.concatenate(c) for c in zip(*got, strict=True))
            where, bundle, start, ids = bundles.unpack(store.get(f"{folder}/{file}"), "u4", "u4", "u4", "i8")
            lo, hi = np.searchsorted(where, passage, "left"), np.searchsorted(where, passage, "right")
            at, reply = _ranges(lo, hi - lo), np.repeat(np.arange(len(passage)), hi - lo)
            goes = ids[at] > smallest[reply]
            begin, of = (start[at] + offset[reply])[goes].astype(np.int64), bundle[at][goes]
            for i, name in enumerate(names):
                table = bundles.read(folder, name)
                words = [t.split() for t in _raw(table)]
                total = sum(map(len, words))
                mine = begin[of == i]
                change = np.bincount(mine, minlength=total + 1) - np.bincount(mine + WINDOW, minlength=total + 1)
                gone, end, masks = np.cumsum(change[:-1]) > 0, 0, []
                for w in words:
                    mask = gone[end : end + len(w)]
                    masks.append(mask if mask.any() else None)
                    end += len(w)
                yield from made(table, words, masks)

    packed = batches.mapped(docs, elect, _PACKED)
    packed = batches.grouped(packed, "bucket", confirm, _PACKED)
    packed = batches.grouped(packed, "parcel", locate, _PACKED)
    packed = batches.grouped(packed, "bucket", first, _PACKED)
    return batches.grouped(packed, "parcel", mark, ddl)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by single spaces)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def made(table, words, masks):
        kept = [w if m is None else [x for x, gone in zip(w, m.tolist(), strict=True) if not gone] for w, m in zip(words, masks, strict=True)]
        removed = [len(w) - len(k) for w, k in zip(words, kept, strict=True)]
        yield batches.batch(schema, [table.column("doc_id").to_pylist(), list(map(len, words)), removed, [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]])

    batches.whole_ids(docs)
    slim = docs.selectExpr("CAST(doc_id AS long) doc_id", "text")
    return _marked(slim, store.fresh(docs.sparkSession, "phrases"), "doc_id long, n_words long, n_removed long, kept_sha256 string", made)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the words that go cut out of the texts, each with the white space after it; other texts stay as
    they are, and n_chars follows the text."""
    batches.whole_ids(docs)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    piece = re.compile(rb"\S+\s*")  # of bytes: the same six characters of white space

    def made(table, words, masks):
        texts = []
        for text, mask in zip(table.column("text").cast(pa.binary()).to_pylist(), masks, strict=True):
            if mask is None:
                texts.append(text)
            else:
                parts = piece.findall(text)
                texts.append(b"".join(p for p, gone in zip(parts, mask.tolist(), strict=True) if not gone).rstrip())
        new = pa.array(texts, pa.binary()).cast(pa.string())
        out = table.set_column(table.schema.get_field_index("text"), "text", new)
        if "n_chars" in table.schema.names:
            cut = [None if m is None else len(t.decode()) for t, m in zip(texts, masks, strict=True)]
            old = table.column("n_chars").to_pylist()
            chars = pa.array([o if c is None else c for o, c in zip(old, cut, strict=True)], table.schema.field("n_chars").type)
            out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", chars)
        yield from out.combine_chunks().to_batches()

    return _marked(docs, store.fresh(docs.sparkSession, "phrases"), ddl, made)


def op9_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY 1),
r AS (SELECT DISTINCT x.doc_id, i + k.range AS p FROM x JOIN f USING (g), range({WINDOW}) k WHERE first < x.doc_id),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS kept FROM w ANTI JOIN r USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
