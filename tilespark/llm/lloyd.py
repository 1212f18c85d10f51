"""Vector code compression: product codes whose codebooks come from Lloyd's rounds over cover trees.

A vector's components become integers and are cut into equal parts; each part has a codebook, and a vector's code names the nearest entry of each. Every
task turns its rows, ``ROWS`` at a time, into one cover tree a part (``Tree``) with counts and sums of all points below each node, and writes them once as
a table. A round walks the trees against the codebooks: where the nearest entry is nearer to a node's centre than the second one by more than
twice the node's radius, the triangle inequality gives the whole subtree to it, and the subtree's count and sum are added at once; other nodes descend, down to
single points, which are compared exactly in integers. What a task sends is one count and sum for each entry, so a round's shuffle and what the driver
holds (the codebooks) depend on entries and dimensions, not on rows.

Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors, empty ones too, end in zeros up to the longest, rounded up to a multiple
of the parts. Components beyond 2^17 are held at that, so that squared distances fit into a long. Rows with a null id are kept and come last among the ids;
repeated rows each count, and ties of the first ids go by vector. Fewer rows than entries give a codebook of as many entries as there are rows; an empty table gives no
rows. Equal points are one point with a count. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm import batches, store, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a tree.
ROWS = 16_384
#: Components times SCALE are held within this.
MOST = 1 << 25
#: Rows of sums by label that are sent to every executor; more are joined by a shuffle.
BROADCAST = 100_000


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of points from entries."""
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - c[None, :, j]
        out += d * d
    return out


class Tree:
    """A cover tree over distinct integer points: the children of a node at a scale cover its points within that scale and are farther than it
    from one another, and the first child is the node's own centre. Points below a node are one stretch of ``order``, so a cumulative sum gives each subtree's
    sum. A node whose points are nearer than the scale waits for a smaller one, so there are no chains of single children."""

    FIELDS = ("points", "count", "order", "centre", "radius", "lo", "hi", "child", "children")

    def __init__(self, **arrays: np.ndarray):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])
        below = np.concatenate([np.zeros((1, self.points.shape[1] + 1), np.int64), np.cumsum(np.column_stack([self.points * self.count[:, None], self.count])[self.order], axis=0)])
        self.total = below[self.hi] - below[self.lo]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.FIELDS}

    @classmethod
    def grow(cls, points: np.ndarray, count: np.ndarray) -> Tree:
        n = len(points)
        far = lambda a, b: ((points[a] - points[b]) ** 2).sum(axis=1)
        order = np.arange(n)
        to_root = far(order, np.zeros(n, np.int64))
        centre, radius, lo, hi = [np.zeros(1, np.int64)], [np.sqrt(to_root.max(keepdims=True).astype(np.float64))], [np.zeros(1, np.int64)], [np.array([n])]
        child, children = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        made, open_ = 1, np.zeros(1, np.int64)
        scale = 2.0 ** np.ceil(np.log2(max(float(radius[0][0]), 1.0)))
        while len(open_):
            scale /= 2
            cat = [np.concatenate(x) for x in (centre, radius, lo, hi, child, children)]
            centre, radius, lo, hi, child, children = ([x] for x in cat)
            split = open_[cat[1][open_] > scale]
            wait = open_[cat[1][open_] <= scale]
            if not len(split):
                open_ = wait[cat[1][wait] > 0]
                continue
            sizes = cat[3][split] - cat[2][split]
            owner = np.repeat(np.arange(len(split)), sizes)
            slot = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(cat[2][split], sizes)
            point = order[slot]
            label, distance = np.full(len(point), -1), np.zeros(len(point), np.int64)
            rest, heads = np.arange(len(point)), cat[0][split]  # in the first turn, each node's own centre
            names, of, centres = 0, [], []
            owners = np.arange(len(split))
            while len(rest):
                name = np.full(len(split), -1)
                name[owners] = names + np.arange(len(owners))
                head = np.zeros(len(split), np.int64)
                head[owners] = heads
                d = far(point[rest], head[owner[rest]])
                near = d <= scale * scale
                label[rest[near]], distance[rest[near]] = name[owner[rest[near]]], d[near]
                of.append(owners)
                centres.append(heads)
                names += len(owners)
                rest = rest[~near]
                first = np.flatnonzero(np.append(True, owner[rest][1:] != owner[rest][:-1])) if len(rest) else rest
                owners, heads = owner[rest][first], point[rest][first]
            of, centres = np.concatenate(of), np.concatenate(centres)
            rank = np.argsort(of, kind="stable")  # children of a node follow one another
            place = np.empty(names, np.int64)
            place[rank] = np.arange(names)
            label = place[label]
            sort = np.argsort(label, kind="stable")  # a node's stretch stays its own: labels rise with owners, and split nodes stand by lo
            order[np.sort(slot)] = point[sort]
            held = np.bincount(label, minlength=names)
            ends = np.cumsum(held)
            reach = np.sqrt(np.maximum.reduceat(distance[sort], ends - held).astype(np.float64))
            begin = np.repeat(cat[2][split] - (np.cumsum(sizes) - sizes), np.bincount(of, minlength=len(split))) + ends - held
            kids = np.bincount(of, minlength=len(split))
            child[0][split], children[0][split] = made + np.cumsum(kids) - kids, kids
            new = made + np.arange(names)
            made += names
            for x, v in ((centre, centres[rank]), (radius, reach), (lo, begin), (hi, begin + held), (child, np.zeros(names, np.int64)), (children, np.zeros(names, np.int64))):
                x.append(v)
            open_ = np.concatenate([wait[cat[1][wait] > 0], new[reach > 0]])
            open_ = open_[np.argsort(np.concatenate([cat[2], begin])[open_], kind="stable")]
        cat = [np.concatenate(x) for x in (centre, radius, lo, hi, child, children)]
        return cls(points=points, count=count, order=order, **dict(zip(("centre", "radius", "lo", "hi", "child", "children"), cat, strict=True)))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nodes that together hold every point once, each with the entry that is nearest to all its points (ties: the first), and how many nodes were compared."""
        nodes, given, seen = [], [], 0
        ahead = np.zeros(1, np.int64)
        while len(ahead):
            below = []
            for at in range(0, len(ahead), 8192):
                now = ahead[at : at + 8192]
                seen += len(now)
                d = squared(self.points[self.centre[now]], entries)
                best = d.argmin(axis=1)
                least = d[np.arange(len(now)), best]
                if len(entries) > 1:
                    d[np.arange(len(now)), best] = np.iinfo(np.int64).max
                    # farther by more than the subtree's diameter, and than what rounding may cost
                    gap = np.sqrt(d.min(axis=1).astype(np.float64)) - np.sqrt(least.astype(np.float64))
                    sure = (self.radius[now] == 0) | (gap > 2 * self.radius[now] * (1 + 1e-9) + 1e-6)
                else:
                    sure = np.ones(len(now), bool)
                nodes.append(now[sure])
                given.append(best[sure])
                deep = now[~sure]
                kids = self.children[deep]
                below.append(np.repeat(self.child[deep] - (np.cumsum(kids) - kids), kids) + np.arange(kids.sum()))
            ahead = np.concatenate(below)
        return np.concatenate(nodes), np.concatenate(given), seen

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of every point."""
        nodes, given, _ = self.assign(entries)
        by = np.argsort(self.lo[nodes], kind="stable")
        out = np.empty(len(self.points), np.int64)
        out[self.order] = np.repeat(given[by], (self.hi - self.lo)[nodes[by]])
        return out


def forest(points: np.ndarray, parts: int) -> bytes:
    """The trees of all parts of some rows, and for each row its point in each tree."""
    out, width = {}, points.shape[1] // parts
    for p in range(parts):
        distinct, of, count = np.unique(points[:, p * width : (p + 1) * width], axis=0, return_inverse=True, return_counts=True)
        tree = Tree.grow(distinct, count)
        out |= {f"{p}_{k}": v for k, v in tree.arrays().items()} | {f"{p}_of": of.reshape(-1)}
    return vectors.dump(**out)


def trees(blob: bytes, parts: int) -> list[tuple[Tree, np.ndarray]]:
    held = vectors.load(blob)
    return [(Tree(**{k: held[f"{p}_{k}"] for k in Tree.FIELDS}), held[f"{p}_of"]) for p in range(parts)]


def _planted(rows: DataFrame, dims: int, parts: int, scale: int, most: int) -> DataFrame:
    """A table of forests: rows (id and label as an Arrow stream) and trees."""
    schema = pa.schema([("rows", pa.binary()), ("trees", pa.binary())])

    def run(it):
        held, n = [], 0

        def done():
            t = pa.Table.from_batches(held)
            x = integers(np.concatenate([vectors.matrix(c, dims) for c in t.column("__v").chunks]), scale)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.drop_columns("__v").schema) as out:
                out.write_table(t.drop_columns("__v").combine_chunks())
            return pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([forest(x, parts)], pa.binary())], schema=schema)

        for b in it:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, most - n)
                at += part.num_rows
                n += part.num_rows
                if part.num_rows:
                    held.append(part)
                if n == most:
                    yield done()
                    held, n = [], 0
        if held:
            yield done()

    return store.table(batches.mapped(rows, run, "rows binary, trees binary"), "lloyd")


def _round(planted: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: every entry that has points moves to their mean, rounded down."""
    parts = len(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("total", pa.int64())])

    def run(it):
        width = books[0].shape[1] + 1  # the count comes last
        sums = np.zeros((parts, len(books[0]), width), np.int64)
        for b in it:
            for blob in b.column("trees"):
                for p, (tree, _) in enumerate(trees(blob.as_py(), parts)):
                    nodes, given, _ = tree.assign(books[p])
                    np.add.at(sums[p], given, tree.total[nodes])
        p, e, d = np.nonzero(sums)
        yield batches.batch(schema, [p.astype(np.int32), e.astype(np.int32), d.astype(np.int32), sums[p, e, d]])

    sent = batches.mapped(planted.select("trees"), run, "part int, entry int, dim int, total long")
    sums = np.zeros((parts, len(books[0]), books[0].shape[1] + 1), np.int64)
    for r in sent.groupBy("part", "entry", "dim").agg(F.sum("total").alias("total")).collect():  # parts x entries x dimensions at most
        sums[r.part, r.entry, r.dim] = r.total
    n = sums[:, :, -1:]
    return [np.where(n[p] > 0, sums[p, :, :-1] // np.maximum(n[p], 1), books[p]) for p in range(parts)]


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, most: int = ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """From vec_id, embedding and label: vec_id, label, code (an entry a part) and error of every kept row, and the codebooks."""
    r = rows.filter(vectors.finite(F.col("embedding"))).select(F.col("vec_id").alias("__i"), F.col("label").alias("__l"), F.col("embedding").cast("array<double>").alias("__v"))
    kind, lab = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    longest = r.agg(F.max(F.size("__v"))).first()[0]
    ddl = f"vec_id {kind}, label {lab}, code binary, error long"
    if longest is None:
        return r.sparkSession.createDataFrame([], ddl), [np.zeros((0, 0), np.int64)] * parts
    dims = parts * max(1, -(-longest // parts))
    first = r.orderBy(F.col("__i").asc_nulls_last(), "__v").limit(entries).select("__v").collect()
    seeds = integers(np.array([[*x[0], *[0.0] * (dims - len(x[0]))] for x in first]), scale)
    books = [np.ascontiguousarray(x) for x in np.split(seeds, parts, axis=1)]
    planted = _planted(r, dims, parts, scale, most)
    for _ in range(rounds):
        books = _round(planted, books)
    schema = None

    def run(it):
        for b in it:
            for rows_, blob in zip(b.column("rows"), b.column("trees"), strict=True):
                t = pa.ipc.open_stream(rows_.as_py()).read_all()
                code, error = np.empty((len(t), parts), np.uint8), np.zeros(len(t), np.int64)
                for p, (tree, of) in enumerate(trees(blob.as_py(), parts)):
                    given = tree.codes(books[p])
                    code[:, p] = given[of]
                    error += ((tree.points - books[p][given]) ** 2).sum(axis=1)[of]
                yield from pa.table([t.column("__i"), t.column("__l"), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"]).combine_chunks().to_batches()

    if entries > 256:
        raise ValueError("a code is one byte a part: at most 256 entries")
    return store.table(batches.mapped(planted, run, ddl), "lloyd-codes"), books


def by_label(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all rows with an equal label (nulls together)."""
    sums = store.table(coded.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error")), "lloyd-labels")
    few = sums.count() <= BROADCAST
    return coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["__l"])).drop("__l")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def op13_cover_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = by_label(coded)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


SQL = r"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, j AS part, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS x FROM k, range(16) t(j)),
c0 AS MATERIALIZED (SELECT part, e, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 64),
d1 AS MATERIALIZED (SELECT vec_id, label, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m, any_value(x) AS x
  FROM p JOIN c0 USING (part) GROUP BY vec_id, label, part),
u1 AS (SELECT part, e, list(q ORDER BY j) AS c FROM (SELECT part, m.e AS e, j, floor(sum(x[j + 1])::DOUBLE / count(*))::BIGINT AS q FROM d1, range(len(x)) t(j) GROUP BY ALL) GROUP BY ALL),
c1 AS MATERIALIZED (SELECT part, e, coalesce(u1.c, c0.c) AS c FROM c0 LEFT JOIN u1 USING (part, e)),
d2 AS MATERIALIZED (SELECT vec_id, label, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m, any_value(x) AS x
  FROM p JOIN c1 USING (part) GROUP BY vec_id, label, part),
u2 AS (SELECT part, e, list(q ORDER BY j) AS c FROM (SELECT part, m.e AS e, j, floor(sum(x[j + 1])::DOUBLE / count(*))::BIGINT AS q FROM d2, range(len(x)) t(j) GROUP BY ALL) GROUP BY ALL),
c2 AS MATERIALIZED (SELECT part, e, coalesce(u2.c, c1.c) AS c FROM c1 LEFT JOIN u2 USING (part, e)),
d3 AS MATERIALIZED (SELECT vec_id, label, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m, any_value(x) AS x
  FROM p JOIN c2 USING (part) GROUP BY vec_id, label, part),
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM d3 GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS s FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM r, h
"""
