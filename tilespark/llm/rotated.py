"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index: rows are brought together by their nearest of ``CELLS`` centres, fitted on a bounded sample (the ``SAMPLE`` rows with the least hash of their id), and cut into
blocks of at most ``BLOCK`` rows, one file each in the shared folder. A block keeps its rows' mean; what a vector differs from it is turned by one random
rotation into ``BITS`` times as many dimensions, of which only signs stay (packed bits) and two scalars: the difference's length, and its inner product with its own code.
From these, a query's inner product with any row of the block is estimated without bias, with an error whose deviation is known; ``ERRORS`` deviations bound it.

Search: queries are blocks too, and a task takes some blocks of queries past a group of blocks of rows. It starts from a threshold that the sample proves, skips blocks whose mean and
largest difference rule them out (Cauchy and Schwarz), estimates the others from bits, and computes the exact product only where the bound
reaches the best k so far. The sample has only rows that are candidates themselves, so its threshold is never too high. All rows are indexed and all codes of blocks that can't be ruled out
are estimated; at five deviations a neighbour is lost about once in three million, so results are those of an exact search in all tests.

Range partitioning by cell and hash splits a cell that holds most rows. Of equal vectors in one block, the k + 1 with the least ids are kept: more can't be in any answer. Equal
queries of a block are searched once. So a vector that a third of all rows share costs one row a block.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. A vector shorter than the longest ends in zeros. vec_id is a key: of rows that repeat
one, the least vector counts. Ties go to the smaller vec_id; fewer candidates than k give all of them, in order; a lone row and an empty table give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm import batches, store, vectors

K = 20
#: Bits of a code for each dimension, and the most for wide vectors (but never fewer than dimensions).
BITS, MOST_BITS = 8, 2048
ERRORS = 5.0
#: Rows of the sample that cells and thresholds come from: the only part that doesn't see all rows.
SAMPLE, CELLS, TURNS = 4096, 64, 8
#: Rows of a block, the least of one that ends with its cell, queries of a block, and blocks of a group.
BLOCK, LEAST, QUERIES, GROUP = 4096, 512, 1024, 64
SEED = 7


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns: bits x dims."""
    bits = 64 * math.ceil(min(BITS * dims, max(MOST_BITS, dims)) / 64)
    return np.ascontiguousarray(np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))[0], dtype=np.float32)


def encode(v: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """A block: mean, packed bits, length of each difference from the mean and its inner product with its code."""
    mean = v.mean(axis=0)
    rest = v - mean
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = (rest / np.where(length > 0, length, 1)[:, None]).astype(np.float32) @ turn.T
    along = np.abs(unit).sum(axis=1) / np.float32(math.sqrt(len(turn)))
    return {"mean": mean, "bits": np.packbits(unit > 0, axis=1), "length": length, "along": np.where(along > 0, along, 1).astype(np.float64)}


def estimate(block: dict[str, np.ndarray], q: np.ndarray, turned: np.ndarray, bits: int, errors: float = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with a block's rows, and their bounds (single precision; queries x rows)."""
    signs = np.unpackbits(block["bits"], axis=1, count=bits).astype(np.float32)
    signs *= 2
    signs -= 1
    a, length = block["along"], block["length"]
    guess = turned @ signs.T
    guess *= (length / a / math.sqrt(bits)).astype(np.float32)
    guess += (q @ block["mean"]).astype(np.float32)[:, None]
    spread = errors * length * np.sqrt(np.maximum(1 - a * a, 0)) / a / math.sqrt(max(bits - 1, 1))
    slack = 1e-5 * (length + np.sqrt((block["mean"] ** 2).sum()))  # what single precision may cost
    return guess, np.outer(np.sqrt((q * q).sum(axis=1)), spread + slack).astype(np.float32)


def products(qt: np.ndarray, vt: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed from the first dimension to the last: the same bits in whatever block a pair meets. qt and vt: dimensions x rows."""
    out = np.zeros(len(qi))
    for at in range(0, len(qi), 1 << 18):
        i, j = qi[at : at + (1 << 18)], vi[at : at + (1 << 18)]
        s = out[at : at + (1 << 18)]
        for d in range(len(qt)):
            s += qt[d][i] * vt[d][j]
    return out


class Best:
    """The k best (score, id) of each of n queries so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k, self.floor = n, k, floor.copy()
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        by = np.lexsort((ids, -score, q))
        q, score, ids = q[by], score[by], ids[by]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.score, self.ids = q[keep], score[keep], ids[keep]
        full = np.bincount(self.q, minlength=self.n) == self.k
        last = np.searchsorted(self.q, np.arange(self.n), side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last[full]])


def _taking_part(rows: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return rows.filter(F.col("vec_id").isNotNull() & vectors.finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(F.exists("v", lambda x: x != 0))


def _keyed(rows: DataFrame) -> DataFrame:
    """One row an id. Vectors are only shuffled where ids repeat."""
    again = store.table(rows.groupBy("id").count().filter("count > 1").select("id"), "ann-again")
    if not again.count():
        return rows
    return rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _matrix(rows: list, dims: int) -> np.ndarray:
    return np.array([[*r.v, *[0.0] * (dims - len(r.v))] for r in rows]).reshape(len(rows), dims)


def centres(sample: np.ndarray, cells: int = CELLS, turns: int = TURNS) -> np.ndarray:
    """Means of some Lloyd rounds over a bounded sample."""
    c = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(turns):
        of = _nearest(sample, c)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def _blocks(rows: DataFrame, folder: str, dims: int, cells: np.ndarray, most: int, keep: int, turn: np.ndarray | None) -> DataFrame:
    """A table of block names. turn: with codes (rows) or without (queries)."""

    def celled(it):
        for b in it:
            of = _nearest(vectors.matrix(b.column("v"), dims), cells) if b.num_rows else np.zeros(0)
            yield b.append_column("cell", pa.array(of, pa.int32()))

    def cut(it):
        held_i, held_v, n, last = [], [], 0, None

        def done():
            ids, v = np.concatenate(held_i), np.concatenate(held_v)
            _, of = np.unique(v, axis=0, return_inverse=True)
            of = of.reshape(-1)
            by = np.lexsort((ids, of))
            nth = np.arange(len(by)) - np.searchsorted(of[by], of[by])
            by = by[nth < keep]
            name = uuid.uuid4().hex
            arrays = {"ids": ids[by], "v": v[by]}
            store.put(f"{folder}/{name}", vectors.dump(**arrays, **(encode(v[by], turn) if turn is not None else {})))
            return pa.record_batch([pa.array([name]), pa.array([len(ids)], pa.int64())], names=["name", "n"])

        for b in it:
            ids, v, cell = b.column("id").to_numpy(), vectors.matrix(b.column("v"), dims), b.column("cell").to_numpy()
            at = 0
            while at < len(ids):
                same = np.flatnonzero(cell[at:] != cell[at])
                end = at + int(same[0]) if len(same) else len(ids)
                if n and (n >= most or cell[at] != last and n >= min(LEAST, most)):
                    yield done()
                    held_i, held_v, n = [], [], 0
                end = min(end, at + most - n)
                held_i.append(ids[at:end])
                held_v.append(v[at:end])
                n, last, at = n + end - at, cell[at], end
        if n:
            yield done()

    dealt = batches.mapped(rows, celled, "id long, v array<double>, cell int").repartitionByRange(F.col("cell"), F.xxhash64("id"))
    return store.table(batches.mapped(dealt.sortWithinPartitions("cell", "id"), cut, "name string, n long"), "ann-blocks")


def _search(mine: list[str], theirs: list[str], folder: str, k: int, turn: np.ndarray, sample: np.ndarray):
    """(query ids, vec ids, scores) of some blocks of queries against some blocks of rows. The own row is still among the k + 1 best."""
    asked = []
    for name in mine:
        held = vectors.load(store.get(f"{folder}/{name}"))
        q, of = np.unique(held["v"], axis=0, return_inverse=True)
        floor = np.full(len(q), -np.inf)
        if len(sample) > k:
            floor = np.partition(q @ sample.T, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
            floor -= 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((sample * sample).sum(axis=1).max())
        asked.append((held["ids"], of.reshape(-1), q, np.ascontiguousarray(q.T), q.astype(np.float32) @ turn.T, np.sqrt((q * q).sum(axis=1)), Best(len(q), k + 1, floor)))
    for name in theirs:
        block = vectors.load(store.get(f"{folder}/{name}"))
        vt = np.ascontiguousarray(block["v"].T)
        for _, _, q, qt, turned, size, best in asked:
            reach = q @ block["mean"] + size * block["length"].max() * (1 + 1e-9) + 1e-9 * size * np.sqrt((block["mean"] ** 2).sum())
            live = np.flatnonzero(~(reach < best.floor))
            if not len(live):
                continue
            guess, bound = estimate(block, q[live], turned[live], len(turn))
            guess += bound
            qi, vi = np.nonzero(~(guess < best.floor[live].astype(np.float32)[:, None] - 1e-6 * np.abs(best.floor[live, None]).astype(np.float32)))
            score = products(qt, vt, live[qi], vi)
            good = ~(score < best.floor[live[qi]])
            best.add(live[qi][good], score[good], block["ids"][vi[good]])
    for ids, of, _, _, _, _, best in asked:
        first, end = np.searchsorted(best.q, of), np.searchsorted(best.q, of, side="right")
        n = end - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        whose = np.repeat(ids, n)
        other = best.ids[at] != whose
        yield whose[other], best.ids[at][other], best.score[at][other]


def nearest(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every row (of vec_id and embedding) that is_query, a condition on id, picks."""
    spark = rows.sparkSession
    r = _keyed(_taking_part(rows))
    ddl = "query_id long, vec_id long, score double"
    dims = r.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(r.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect(), dims)  # bounded
    cells, turn = centres(sample), rotation(dims)
    folder = store.fresh(spark, "ann")
    per = max(64, min(BLOCK, (8 << 20) // dims))  # 64 MB of doubles at most
    codes = _blocks(r, folder, dims, cells, per, k + 1, turn)
    asks = _blocks(r.filter(is_query), folder, dims, cells, QUERIES, QUERIES, None)
    n_codes, n_asks = codes.count(), asks.count()
    if not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # enough tasks for the cluster, none above GROUP blocks of rows and four of queries
    packs = math.ceil(n_asks / 4)
    groups = max(math.ceil(n_codes / GROUP), min(n_codes, math.ceil(3 * spark.sparkContext.defaultParallelism / packs)))
    named = lambda d, n, to: d.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).alias(to)).agg(F.collect_list("name").alias(f"{to}_names"))
    left = named(codes, groups, "group").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))
    pairs = left.join(named(asks, packs, "pack"), "pack").repartition(packs * groups if packs * groups < 100_000 else 100_000, "pack", "group")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        for b in it:
            for mine, theirs in zip(b.column("pack_names").to_pylist(), b.column("group_names").to_pylist(), strict=True):
                for whose, ids, score in _search(mine, theirs, folder, k, turn, sample):
                    yield batches.batch(schema, [whose, ids, score])

    found = batches.mapped(pairs, run, ddl)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_rotated_codes(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
