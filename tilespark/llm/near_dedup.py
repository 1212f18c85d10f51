"""Near duplicates by Order MinHash.

1. Equal word sequences (by a 128-bit hash) are one class at once and have one representative from here on.
2. A sketch has ORDERS orders of the text's occurrence-labelled shingles (SHINGLE words, and which of equal ones it is), each by a
   hash of its own. An order takes the LEAST smallest and gives a number for every two of them, hashed as they follow one another in the text, so it is
   sensitive to edits and to order. Of texts that differ in a fifth of their words, anywhere, more than nine in ten pairs share a number (from 60 words on; shorter ones may have no two
   shingles left in common).
3. Representatives that share a number are in a bucket. First candidates are every member and its bucket's hub, the member with the
   most copies and whose other numbers are the most widely shared (among near copies of one text, that text): linear in a
   bucket's size, whatever it is, and a text meets the hubs of all its numbers.
4. Candidates are verified on whole texts by banded alignment of their words: a pair links if at most a share of
   1 - SIMILARITY of the longer text's words has to be inserted, deleted or replaced, both as the texts are and trimmed: without the
   words of shingles that the text has said REPEATS times before, so filler that is repeated hundreds of times makes
   nothing similar. Shared shingles, chained in order within the band,
   give an upper bound, shared words a lower one; only between these the band is filled in. Hubs' texts are sent
   once for each GROUP members.
5. Components of links, over tables in the shared folder, are classes so far. A bucket that still holds two of them has pairs that
   were not tried. In one of at most CHUNK texts, all pairs of different components are tried; the members of a larger one are
   *crowded*. Among all crowded texts, every pair of different components that
   can link is a candidate, by positional prefix filtering, which loses none: an edit touches two pairs of neighbouring words at
   most, so texts of a and b (trimmed) words that link share at least max(a, b) - 1 - 2 (1 - SIMILARITY) max(a, b) labelled pairs. These are
   ordered by the number of crowded texts that have them, rarest first; only the rarest two fifths of a text are joined, so
   boilerplate meets itself only where texts hold nearly nothing else. These candidates are verified like the others.
6. Components of all links are the classes; a class is named by its smallest doc_id.

Texts with fewer than SHINGLE words are near duplicates only of equal ones; null, empty and blank texts have equal (no) words and
form a class. Ids are integers (other numbers are cast to them; what isn't a number is refused before anything runs). Null ids come last; a class without any id has the id null. Repeated rows are copies.
An empty table gives no rows. Further columns are ignored by ``classes`` and kept by ``keep_one``. Joins on buckets and on
copies rest on adaptive skew joins (``session.NEEDED``), which split a bucket or a group of copies over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm import batches, bundles, store
from tilespark.llm.components import components
from tilespark.llm.runs import Words

SHINGLE = 5
SIMILARITY = 0.8
ORDERS, LEAST = 14, 4
CHUNK = 6
GROUP = 64
#: Of a shingle that a text repeats, so many count in its trimmed words.
REPEATS = 16
BUCKETS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = bundles.mixed(np.arange(1, ORDERS + 1, dtype=np.uint64) * _ODD)
_FACTORS = bundles.mixed(~_SEEDS) | np.uint64(1)


def _nth(shingles: np.ndarray) -> np.ndarray:
    """How many equal ones are before each shingle."""
    order = np.argsort(shingles, kind="stable")
    start, size = bundles.runs_of(shingles[order])
    nth = np.empty(len(shingles), np.uint64)
    nth[order] = np.arange(len(shingles)) - np.repeat(start, size)
    return nth


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles with the number of equal ones before them mixed in."""
    return bundles.mixed(shingles + _nth(shingles) * _ODD)


def trimmed(h: np.ndarray) -> np.ndarray:
    """A text's words without those that begin a shingle said REPEATS times before."""
    nth = _nth(bundles.rolling(h, SHINGLE, 4))
    if not len(nth) or nth.max() < REPEATS:
        return h
    return h[np.append(nth < REPEATS, np.ones(SHINGLE - 1, bool))]


def sketch(h: np.ndarray) -> np.ndarray:
    """The numbers of a text from the hashes of its words; none for a text without shingles."""
    s = labelled(bundles.rolling(h, SHINGLE, 4))
    if len(s) < 2:
        return s.copy()
    if len(s) <= LEAST:  # all orders would say the same
        return _paired(_SEEDS[:1], s[None, :])
    ranked = (s[None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]
    return _paired(_SEEDS, s[np.sort(np.argpartition(ranked, LEAST - 1, axis=1)[:, :LEAST], axis=1)])


def _paired(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A number for every two of each row's values, in their order."""
    i, j = np.triu_indices(values.shape[1], 1)
    first = bundles.mixed(seeds[:, None] * _ODD + values[:, i])
    return bundles.mixed(first * _ODD + values[:, j]).reshape(-1)


def _chain(values: np.ndarray) -> np.ndarray:
    """Places of a longest increasing subsequence."""
    from bisect import bisect_left

    if len(values) < 2 or (np.diff(values) > 0).all():
        return np.arange(len(values))
    tails: list[int] = []
    last: list[int] = []
    back = []
    for n, v in enumerate(values.tolist()):
        i = bisect_left(tails, v)
        back.append(last[i - 1] if i else -1)
        tails[i : i + 1], last[i : i + 1] = [v], [n]
    out, n = [], last[-1]
    while n >= 0:
        out.append(n)
        n = back[n]
    return np.array(out[::-1])


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, most + 1 if it is above most: rows of the alignment are filled in within most of its diagonal."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    width = 2 * most + 1  # cell j of row i stands for the column i + j - most
    far, steps = most + 1, np.arange(width)
    row = np.where(steps >= most, steps - most, far)  # row 0
    padded = np.concatenate([np.zeros(most, b.dtype), b, np.zeros(2 * most + 1, b.dtype)])
    for i in range(1, len(a) + 1):
        column = i + steps - most
        new = np.where((column > 0) & (column <= len(b)), row + (padded[i - 1 : i - 1 + width] != a[i - 1]), far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if i <= most:
            new[most - i] = i  # column 0
        new[(column < 0) | (column > len(b))] = far
        row = np.minimum(np.minimum.accumulate(new - steps) + steps, far)
        if row.min() > most:
            return most + 1
    return int(row[len(b) - len(a) + most])


class Text:
    """What a text's alignments need, from the hashes of its words (uint64)."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.words, self.counts = np.unique(h, return_counts=True)
        self.shingles = labelled(bundles.rolling(h, SHINGLE, 4))


def _bounds(x: Text, y: Text, most: int) -> tuple[int, int]:
    """At least and at most so many edits."""
    a, b = len(x.h), len(y.h)
    _, i, j = np.intersect1d(x.words, y.words, assume_unique=True, return_indices=True)
    low = max(a, b) - int(np.minimum(x.counts[i], y.counts[j]).sum())
    if low > most:
        return low, max(a, b)
    _, i, j = np.intersect1d(x.shingles, y.shingles, assume_unique=True, return_indices=True)
    keep = np.abs(i - j) <= most
    i, j = i[keep], j[keep]
    order = np.argsort(i)
    i, j = i[order], j[order]
    chain = _chain(j)
    if not len(chain):
        return low, max(a, b)
    i, j = i[chain], j[chain]
    di, dj = np.diff(i), np.diff(j)
    between = np.maximum(di, dj) - np.minimum(np.minimum(di, dj), SHINGLE)
    return low, int(between.sum()) + int(max(i[0], j[0])) + int(max(a - i[-1], b - j[-1])) - SHINGLE


def edits_allowed(a: int, b: int) -> int:
    return int((1 - SIMILARITY) * max(a, b) + 1e-9)


def near(x: Text, y: Text) -> bool:
    """Whether the texts link: as they are, and trimmed."""
    if not _aligned(x, y):
        return False
    a, b = trimmed(x.h), trimmed(y.h)
    return a is x.h and b is y.h or _aligned(Text(a), Text(b))


def _aligned(x: Text, y: Text) -> bool:
    most = edits_allowed(len(x.h), len(y.h))
    if abs(len(x.h) - len(y.h)) > most or min(len(x.h), len(y.h)) < SHINGLE:
        return len(x.h) == len(y.h) and bool((x.h == y.h).all())
    low, high = _bounds(x, y, most)
    return low <= most and (high <= most or banded_distance(x.h, y.h, most) <= most)


_TEXTS = "row long, doc_id long, bundle string, idx int, size int, content binary, sketch array<long>"


def _texts(docs: DataFrame, folder: str) -> DataFrame:
    """A row for each document, as a table; texts go into bundles."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("bundle", pa.string()), ("idx", pa.int32()), ("size", pa.int32()), ("content", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh128_digest

        row = TaskContext.get().partitionId() << 36
        for name, table in bundles.write(it, folder):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            words = Words(texts)
            h, cut, n = words.hashes(), np.append(0, np.cumsum(words.sizes)).tolist(), len(texts)
            yield batches.batch(schema, [
                row + np.arange(n), table.column("doc_id").cast(pa.int64()).to_pylist(), [name] * n, list(range(n)), np.diff(cut).astype(np.int32),
                [xxh128_digest(b" ".join(t.split())) for t in texts], [sketch(h[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)],
            ])
            row += n

    return store.table(batches.mapped(docs, run, _TEXTS), "near-texts")


#: Beyond that many texts a bucket's exact size makes no difference.
CROWD = 64


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (value, row) with n, how many rows have the value (CROWD at most), without those that are alone. What is held is one run of fewer than CROWD rows."""
    schema = pa.schema([("value", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])
    value, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = None  # a value that has shown CROWD rows already

    def made(upto: int, n: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(n[:upto] > 1)
        return batches.batch(schema, [value[some], row[some], n[some]])

    for b in it:
        value, row = np.append(value, b.column("value").to_numpy()), np.append(row, b.column("row").to_numpy())
        if not len(value):
            continue
        start, size = bundles.runs_of(value)
        n = np.repeat(np.minimum(size, CROWD), size)
        if value[0] == large:
            n[: size[0]] = CROWD
        ended = n[-1] == CROWD
        upto = len(value) if ended else int(start[-1])
        large = value[-1] if ended else None
        yield made(upto, n)
        value, row = value[upto:], row[upto:]
    if len(value) > 1:
        yield made(len(value), np.full(len(value), len(value)))


def buckets(reps: DataFrame) -> DataFrame:
    """A table of value, row, n of the buckets of n > 1 rows, from (row, sketch): numbers are dealt out once and counted as they come; texts alone in all buckets are gone."""
    dealt = reps.select("row", F.explode("sketch").alias("value")).select("value", "row").repartition("value").sortWithinPartitions("value")
    return store.table(batches.mapped(dealt, _counted, "value long, row long, n long"), "near-bands")


def hubs(bands: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rows: members and hubs. reps: row and copies."""
    # a text of many copies is likely what near copies were made from
    spread = bands.groupBy("row").agg(F.sum(F.log2("n")).alias("spread")).join(reps.select("row", "copies"), "row")
    spread = spread.select("row", (F.col("spread") + 8 * F.log2("copies")).alias("spread"))
    hub = bands.join(spread, "row").groupBy("value").agg(F.max(F.struct("spread", "row"))["row"].alias("hub"))
    starred = bands.select("value", "row").join(hub, "value")
    return starred.select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).filter("a <> b").distinct()


def still_open(bands: DataFrame, found: DataFrame) -> DataFrame:
    """A table of value, row, n, root of the buckets that links have not made one component."""
    placed = bands.select("value", "row", "n").join(found.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    open_ = placed.groupBy("value").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    return store.table(placed.join(open_.select("value"), "value", "left_semi"), "near-open")


def small(opened: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in buckets of at most CHUNK texts."""
    one = opened.filter(F.col("n") <= CHUNK)
    two = one.select("value", F.col("row").alias("b"), F.col("root").alias("other"))
    return one.join(two, "value").filter("row < b AND root <> other").select(F.col("row").alias("a"), "b").distinct()


def crowded(opened: DataFrame) -> DataFrame:
    """A table of row, root of the members of larger buckets."""
    return store.table(opened.filter(F.col("n") > CHUNK).select("row", "root").distinct(), "near-crowded")


_PACKED = "bucket int, bundle string, blob binary"
_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("bundle", pa.string()), ("blob", pa.binary())])
_PREFIX = "token long, at int, size int, row long, root long"
_PREFIX_SCHEMA = pa.schema([("token", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("row", pa.int64()), ("root", pa.int64())])


def _least_shared(size):
    """How many labelled pairs of neighbouring words texts that link have in common, if the longer has so many."""
    return size - 2 * (1 - SIMILARITY) * (size + 1)


def rest(crowd: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Distinct pairs (a, b) of (row, root) of different roots that can link: all of them. Tokens are labelled pairs of neighbouring words."""
    n = BUCKETS * int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = lambda rows: batches.batch(_PACKED_SCHEMA, [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []])

    def tokens(name: str, idx: list[int]) -> Iterator[np.ndarray]:
        found = bundles.read(folder, name).column("text").cast(pa.binary()).take(pa.array(idx)).to_pylist()
        words = Words([t or b"" for t in found])
        h, cut = words.hashes(), np.append(0, np.cumsum(words.sizes)).tolist()
        return (labelled(bundles.rolling(trimmed(h[a:b]), 2, 5)) for a, b in zip(cut[:-1], cut[1:], strict=True))

    def send(groups):
        for name, parts in groups:
            members = [np.array(batches.column(parts, c), np.int64) for c in ("idx", "row", "root")]
            token, count = np.unique(np.concatenate(list(tokens(name, members[0].tolist()))), return_counts=True)
            bucket = (bundles.mixed(token) % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            start, size = bundles.runs_of(bucket[order])
            rows = [(-1 - zlib.crc32(name.encode()) % n, name, bundles.pack(*members))]
            for s, k in zip(start.tolist(), size.tolist(), strict=True):
                at = order[s : s + k]
                rows.append((int(bucket[at[0]]), name, bundles.pack(token[at], count[at])))
            yield packed(rows)

    def meet(groups):
        for bucket, parts in groups:
            names, blobs = batches.column(parts, "bundle"), batches.column(parts, "blob")
            if bucket < 0:
                yield packed([(bucket, b, x) for b, x in zip(names, blobs, strict=True)])
                continue
            got = [bundles.unpack(x, "u8", "i8") for x in blobs]
            token, of = np.unique(np.concatenate([t for t, _ in got]), return_inverse=True)
            total = np.zeros(len(token), np.int64)
            np.add.at(total, of, np.concatenate([c for _, c in got]))
            rows, end = [], 0
            for name, (t, _) in zip(names, got, strict=True):
                count = total[of[end : end + len(t)]]
                end += len(t)
                if (count > 1).any():
                    rows.append((bucket, name, bundles.pack(t[count > 1], count[count > 1])))
            yield packed(rows)

    def prefixes(groups):
        for name, parts in groups:
            blobs = list(zip(batches.column(parts, "bucket"), batches.column(parts, "blob"), strict=True))
            idx, row, root = (x.tolist() for x in bundles.unpack(next(x for k, x in blobs if k < 0), "i8", "i8", "i8"))
            got = [bundles.unpack(x, "u8", "i8") for k, x in blobs if k >= 0]
            if not got:
                continue
            shared, count = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.argsort(shared)
            shared, count = shared[order], count[order]
            for t, r, o in zip(tokens(name, idx), row, root, strict=True):
                at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
                often = np.where(shared[at] == t, count[at], 1)
                order = np.lexsort((t, often))[: len(t) - int(np.ceil(_least_shared(len(t)) - 1e-6)) + 1]
                meets = np.flatnonzero(often[order] > 1)
                k = len(meets)
                if k:
                    yield batches.batch(_PREFIX_SCHEMA, [t[order[meets]].view(np.int64), meets, [len(t)] * k, [r] * k, [o] * k])

    asked = crowd.join(texts.select("row", "bundle", "idx"), "row")
    counted = batches.grouped(batches.grouped(asked, "bundle", send, _PACKED), "bucket", meet, _PACKED)
    one = store.table(batches.grouped(counted, "bundle", prefixes, _PREFIX), "near-prefixes")
    two = one.select("token", *(F.col(c).alias(f"{c}2") for c in ("at", "size", "row", "root")))
    left = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    most, least = F.greatest("size", "size2"), F.least("size", "size2")
    can = (left + 1e-6 >= _least_shared(most)) & (least + 1 + 1e-6 >= SIMILARITY * (most + 1))
    met = one.join(two, "token").filter(F.expr("row < row2 AND root <> root2") & can)
    return met.select(F.col("row").alias("a"), F.col("row2").alias("b")).distinct()


def links(pairs: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """(u, v) of the candidates that are similar enough. Pairs whose lengths differ by more words than may be edited can't be, and send nothing."""
    size = lambda end, name: texts.select(F.col("row").alias(end), F.col("size").alias(name))
    allowed = F.floor(F.greatest("sa", "sb") * F.lit(1 - SIMILARITY) + 1e-9)
    pairs = pairs.join(size("a", "sa"), "a").join(size("b", "sb"), "b").filter(F.abs(F.col("sa") - F.col("sb")) <= allowed).select("a", "b")
    pairs = store.table(pairs, "near-pairs")
    # the end with more pairs leads; its members are dealt into groups
    ends = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    led = pairs.join(ends.select(F.col("row").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("row").alias("b"), F.col("n").alias("nb")), "b")
    first = F.col("na") >= F.col("nb")
    led = led.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("row"), F.greatest("na", "nb").alias("n"))
    led = led.withColumn("team", F.concat_ws("-", "lead", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / GROUP))))
    asked = led.select("team", "row", F.lit(1).alias("side")).unionByName(led.select("team", F.col("lead").alias("row"), F.lit(0).alias("side")).distinct())
    asked = asked.join(texts.select("row", "bundle", "idx"), "row")

    def serve(groups):
        schema = pa.schema([("team", pa.string()), ("side", pa.int32()), ("row", pa.int64()), ("words", pa.binary())])
        for name, parts in groups:
            idx, out, size = batches.column(parts, "idx"), [], 0
            asked = sorted(set(idx))
            texts = bundles.read(folder, name).column("text").cast(pa.binary()).take(pa.array(asked)).to_pylist()
            words = Words([t or b"" for t in texts])
            h, cut = words.hashes().astype(np.uint32), np.append(0, np.cumsum(words.sizes)).tolist()
            made = {i: h[a:b].tobytes() for i, a, b in zip(asked, cut[:-1], cut[1:], strict=True)}
            for team, side, row, i in zip(batches.column(parts, "team"), batches.column(parts, "side"), batches.column(parts, "row"), idx, strict=True):
                out.append((team, side, row, made[i]))
                size += len(made[i])
                if size > batches.BYTES:
                    yield batches.batch(schema, [list(c) for c in zip(*out, strict=True)])
                    out, size = [], 0
            if out:
                yield batches.batch(schema, [list(c) for c in zip(*out, strict=True)])

    def verify(groups):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        words = lambda x: bundles.mixed(np.frombuffer(x, np.uint32).astype(np.uint64) + _ODD)
        for _, parts in groups:
            rows = [(s, r, i, b) for b in parts for i, (s, r) in enumerate(zip(b.column("side").to_pylist(), b.column("row").to_pylist(), strict=True))]
            (_, lead, i, b), *members = sorted(rows, key=lambda x: x[:2])
            one = Text(words(b.column("words")[i].as_py()))
            out = [(lead, r) for _, r, i, b in members if near(one, Text(words(b.column("words")[i].as_py())))]
            if out:
                yield batches.batch(schema, [list(c) for c in zip(*out, strict=True)])

    served = batches.grouped(asked, "bundle", serve, "team string, side int, row long, words binary", order=("idx",))
    return batches.grouped(served, "team", verify, "u long, v long")


def _classes(docs: DataFrame, folder: str) -> DataFrame:
    """The texts' table with class_id and kept."""
    texts = _texts(docs, folder)
    place = F.struct(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("id"), "row")  # null ids last
    # the sketch goes along here, once for each text and task, so that nothing joins sketches with their representatives
    first = F.min(F.struct("row", "sketch"))
    copies = texts.groupBy("content").agg(first.alias("first"), F.min(place).alias("least"), F.count(F.lit(1)).alias("copies"))
    copies = store.table(copies.select("content", F.col("first.row").alias("rep"), "least", "copies", F.col("first.sketch").alias("sketch")), "near-copies")
    reps = copies.select(F.col("rep").alias("row"), "copies", "sketch")
    bands = buckets(reps)
    found = components(links(hubs(bands, reps), texts, folder))
    opened = still_open(bands, found)
    crowd = crowded(opened)
    pairs = small(opened)
    if not crowd.isEmpty():
        pairs = pairs.unionByName(rest(crowd, texts, folder)).distinct()
    more = links(pairs, texts, folder)
    found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    copies = copies.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    best = copies.groupBy("root").agg(F.min("least").alias("best"))
    copies = copies.join(best, "root").select("content", "best")
    out = texts.drop("sketch").join(copies, "content")
    last = F.col("best.id") == np.iinfo(np.int64).max
    return out.withColumn("class_id", F.when(~last, F.col("best.id"))).withColumn("kept", F.col("row") == F.col("best.row"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept: kept is true for one document of each class, the one that names it."""
    batches.whole_ids(docs)
    folder = store.fresh(docs.sparkSession, "near")
    return _classes(docs.select("doc_id", "text"), folder).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns."""
    batches.whole_ids(docs)
    folder = store.fresh(docs.sparkSession, "near")
    kept = _classes(docs, folder).filter("kept").select("bundle", "idx")

    def take(groups):
        for name, parts in groups:
            table = bundles.read(folder, name)
            yield from table.take(sorted(batches.column(parts, "idx"))).combine_chunks().to_batches()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return batches.grouped(kept, "bundle", take, ddl)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
