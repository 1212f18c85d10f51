"""Pieces of the candidate search: ranking, greedy filters, atoms, clustering, presets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a tile to the primitives that it may have (fixed values), and what other sides may have.
CAPACITY = {8: 24, 16: 48, 32: 96}
OTHER_CAPACITY = 48
#: What the preset for a single image sets where flags don't (fixed values).
MOST_COMPUTE = {
    "candidate_bank": "rich18", "multi_rounds": "2", "adaptive_tile_budget": "true", "edge_weighted_objective": "true", "target_bpp": "6.0", "enable_res2": "true",
    "search_mode": "greedy", "beam_width": "4", "mcmc_steps": "0", "stochastic_restarts": "0", "early_exit_patience": "0", "container_v2_blocks": "true",
    "split_entropy_streams": "true", "neighbor_delta_coding": "true", "maxcompute_fit_passes": "512",
}
#: Bank, model, primitive kind and geometry (fixed values; kind 0 constant, 1 linear, 2 line, 3 curve, 4 triangle).
TEMPLATES = (
    ("rich18", 0, 0, ()),
    ("rich18", 1, 1, (0.0, 0.0, 15.0, 0.0)),
    ("rich18", 2, 1, (0.0, 0.0, 15.0, 6.0)),
    ("rich18", 3, 1, (0.0, 0.0, 15.0, 15.0)),
    ("rich18", 4, 1, (0.0, 6.0, 15.0, 15.0)),
    ("rich18", 5, 1, (0.0, 15.0, 15.0, 15.0)),
    ("rich18", 6, 1, (0.0, 15.0, 15.0, 6.0)),
    ("rich18", 7, 1, (0.0, 15.0, 15.0, 0.0)),
    ("rich18", 8, 1, (0.0, 6.0, 15.0, 0.0)),
    ("rich18", 9, 2, (7.5, 0.0, 7.5, 15.0, 1.5)),
    ("rich18", 10, 2, (0.0, 7.5, 15.0, 7.5, 1.5)),
    ("rich18", 11, 2, (0.0, 0.0, 15.0, 15.0, 1.5)),
    ("rich18", 12, 4, (0.0, 0.0, 15.0, 0.0, 0.0, 15.0)),
    ("rich18", 13, 4, (15.0, 0.0, 15.0, 15.0, 0.0, 0.0)),
    ("rich18", 14, 4, (0.0, 15.0, 15.0, 15.0, 0.0, 0.0)),
    ("rich18", 15, 3, (0.0, 7.5, 7.5, 0.0, 15.0, 7.5, 1.5)),
    ("rich18", 16, 3, (0.0, 7.5, 7.5, 15.0, 15.0, 7.5, 1.5)),
    ("rich18", 17, 3, (7.5, 0.0, 0.0, 7.5, 7.5, 15.0, 1.5)),
    ("simple5", 0, 0, ()),
    ("simple5", 1, 1, (0.0, 0.0, 15.0, 0.0)),
    ("simple5", 2, 1, (0.0, 0.0, 0.0, 15.0)),
    ("simple5", 3, 1, (0.0, 0.0, 15.0, 15.0)),
    ("simple5", 4, 1, (0.0, 15.0, 15.0, 0.0)),
)


def capacity(size: Column) -> Column:
    """Primitives that a tile of this side may have."""
    table = F.create_map(*[F.lit(x).cast("int") for pair in CAPACITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, size.cast("int")), F.lit(OTHER_CAPACITY))


def split_threshold(quality: Column, scale: Column) -> Column:
    """Variance from which a tile is split, at the scale that the image is encoded at (0.1 to 1)."""
    base = F.when(quality < 70, 0.12).when(quality < 90, 0.08).otherwise(0.03)
    return base * F.greatest(F.lit(0.1), F.least(F.lit(1.0), scale))


def worth_refining(objective: Column, quality: Column, pool: Column) -> Column:
    """Tiles that greedy rounds go on with: their objective is high and candidates are left."""
    return (objective > F.when(quality >= 90, 5e-5).otherwise(5e-4)) & (pool > 0)


def with_most_compute(flags: Column) -> Column:
    """A map of flags over the preset's."""
    preset = F.create_map(*[F.lit(x) for pair in MOST_COMPUTE.items() for x in pair])
    own = F.coalesce(flags, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(preset, lambda k, v: ~F.map_contains_key(own, k)), own)


def raised_to_most_compute(quality: Column, primitives: Column) -> list[Column]:
    """What the preset makes of other settings: quality and max_primitives are raised, both residual layers are on."""
    return [F.greatest(quality, F.lit(95)).alias("quality"), F.greatest(primitives, F.lit(48)).alias("max_primitives"), F.lit(True).alias("enable_res0"), F.lit(True).alias("enable_res1")]


def from_models(models: DataFrame) -> DataFrame:
    """(.., bank, model) with kind and geometry; a bank's unknown models are as its last template of rich18, or a constant."""
    t = models.sparkSession.createDataFrame([(b, m, k, list(g)) for b, m, k, g in TEMPLATES], "bank string, model int, kind int, geometry array<double>")
    rich = F.col("bank") == "rich18"
    known = F.col("model").between(0, F.when(rich, 17).otherwise(4))
    d = models.withColumn("__m", F.when(known, F.col("model")).otherwise(F.when(rich, 17).otherwise(0)))
    d = d.withColumn("__b", F.when(rich, "rich18").otherwise("simple5"))
    t = t.withColumnsRenamed({"bank": "__b", "model": "__m"})
    return d.join(F.broadcast(t), ["__b", "__m"]).drop("__b", "__m")  # 23 rows


def top_models(scores: DataFrame, segment: Sequence[str], mse: str, bits: str, model: str, lam: float, n: int = 4) -> DataFrame:
    """The n models of each tile with the least mse + lam * bits, with their place."""
    w = Window.partitionBy(*segment).orderBy(F.round(F.col(mse) + F.lit(lam) * F.col(bits), 9), model)
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def distinct_colours(colours: Column, least: float = 0.002) -> Column:
    """array<array<double>> less those nearer than least (squared) to one that is kept before: an ordered fold."""
    far = lambda c: lambda k: F.aggregate(F.zip_with(k, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) < least
    keep = lambda kept, c: F.when(F.exists(kept, far(c)), kept).otherwise(F.concat(kept, F.array(c)))
    return F.aggregate(colours, F.array().cast("array<array<double>>"), keep)


def unused(candidates: DataFrame, used: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates whose encoding is not among the used ones."""
    return candidates.join(used.select(*key).distinct(), [*key], "left_anti")


def best_atom(v: Column, base: Column) -> Column:
    """struct<pix, delta>: the first pixel with the largest error, and the error in 255ths, as a signed byte."""
    e = F.zip_with(v, base, lambda a, b: a - b)
    best = F.array_max(F.transform(e, lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("at"), x.alias("x"))))
    return F.struct((-best["at"]).alias("pix"), F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(best["x"] * 255))).cast("int").alias("delta"))


def with_atoms(base: Column, atoms: Column, size: int) -> Column:
    """A tile with its sparse atoms (pix, delta) added and clipped to 0..1; atoms outside the tile have no effect."""
    inside = F.filter(atoms, lambda a: (a["pix"] >= 0) & (a["pix"] < size))
    add = lambda i: F.aggregate(F.filter(inside, lambda a: a["pix"] == i), F.lit(0.0), lambda s, a: s + a["delta"] / 255)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.transform(base, lambda x, i: F.when(F.exists(inside, lambda a: a["pix"] == i), clip(x + add(i))).otherwise(x))


def lit(albedo: Column, light: Column, side: int, grid: int) -> Column:
    """A tile times a light of grid by grid values, spread bilinearly over pixel centres, clipped to 0..1."""

    def along(i):
        at = F.greatest(F.lit(0.0), F.least(F.lit(float(grid - 1)), (i + 0.5) * grid / side - 0.5))
        low = F.least(F.floor(at), F.lit(grid - 1)).cast("int")
        return low, F.least(low + 1, F.lit(grid - 1)), at - low

    def value(x, p):
        y0, y1, fy = along(F.floor(p / side))
        x0, x1, fx = along(p % side)
        g = lambda a, b: F.get(light, a * grid + b)
        top, low = g(y0, x0) * (1 - fx) + g(y0, x1) * fx, g(y1, x0) * (1 - fx) + g(y1, x1) * fx
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * (top * (1 - fy) + low * fy)))

    return F.transform(albedo, value)


def neighbour_deltas(blobs: DataFrame, kind: str, blob: str, order: Sequence[str]) -> DataFrame:
    """blobs with prev_len, cur_len and delta: bytes less those of the blob of the same kind before, as far as that reaches.

    A kind may be most of the table: neighbours are found across ranges, no kind is in one task."""
    from tilespark.operators.relational import previous

    d = previous(blobs, F.struct(F.col(kind).alias("k"), F.col(blob).alias("b")), [kind, *order], "__before")
    old = F.when(F.col("__before.k").eqNullSafe(F.col(kind)), F.col("__before.b")).cast("binary")
    d = d.withColumn("__old", old).drop("__before")
    names = blobs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new, before = (b.column(c).cast(pa.binary()).to_pylist() for c in (blob, "__old"))
            deltas = []
            for x, y in zip(new, before, strict=True):
                a = np.frombuffer(x or b"", np.uint8).copy()
                p = np.frombuffer(y or b"", np.uint8)
                n = min(len(a), len(p))
                a[:n] -= p[:n]
                deltas.append(a.tobytes())
            sizes = [pa.array([len(x or b"") for x in s], pa.int64()) for s in (before, new)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *sizes, pa.array(deltas, pa.binary())], names=[*names, "prev_len", "cur_len", "delta"])

    return d.mapInArrow(run, f"{ddl}, prev_len long, cur_len long, delta binary")


def srgb_byte_psnr(a: Column, b: Column) -> Column:
    """PSNR of two arrays of linear light as sRGB bytes (half up); 99.99 where they are the same."""

    def byte(x):
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        return F.floor(F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255 + 0.5)

    square = F.zip_with(a, b, lambda x, y: F.pow((byte(x) - byte(y)) / 255, F.lit(2.0)))
    mse = F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(mse <= 1e-12, 99.99).otherwise(F.log10(mse) * -10)


def kmeans(points: np.ndarray, k: int = 4, rounds: int = 15, tolerance: float = 0.1, seed: int = 42) -> np.ndarray:
    """Lloyd's labels: centres begin at k points that the seed picks and rest when none moves by more than the tolerance."""
    if len(points) <= k:
        return np.zeros(len(points), np.int64)
    pts = points.astype(np.float32)
    centres = pts[np.random.default_rng(seed).choice(len(pts), k, replace=False)]
    for _ in range(rounds):
        label = ((pts[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([pts[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)], np.float32)
        if np.allclose(moved, centres, atol=tolerance):
            break
        centres = moved
    return label


def edge_clusters(tiles: DataFrame, keep: list[str], v: str, share: float = 75.0, k: int = 4) -> DataFrame:
    """keep, cluster, n, y, x: the points of each tile whose gradient reaches the percentile, clustered by place."""
    from tilespark.operators import kernels as K

    d = tiles.select(*keep, v)
    ddl = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep) + ", cluster int, n long, y double, x double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            b = b.filter(b.column(v).is_valid())
            if not b.num_rows:
                continue
            m = K.stacked(b.column(v))
            side = int(round(m.shape[1] ** 0.5))
            gx, gy = K.forward(m)
            size = np.hypot(gx, gy)
            edge = size >= np.percentile(size, share, axis=1)[:, None]
            rows = []
            for t in range(len(m)):
                at = np.flatnonzero(edge[t])
                if not len(at):
                    continue
                pts = np.stack([at // side, at % side], axis=1)
                label = kmeans(pts, k)
                rows += [(t, j, int((label == j).sum()), *pts[label == j].mean(axis=0).tolist()) for j in np.unique(label).tolist()]
            if not rows:
                continue
            of, *rest = (list(c) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of)) for c in keep), *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=[*keep, "cluster", "n", "y", "x"])

    return d.mapInArrow(run, ddl)
