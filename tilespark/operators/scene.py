"""Scenes: leaves of mixed size, each with a stack of primitives, drawn into an image.

A leaf is (image, height, width, y, x, size, prims, bias, grid): bias is an array of three signed 255ths or null, grid the flattened n x n x 3 correction or null. Leaves lie on their own
size's raster (as a quadtree or a uniform grid has it), so none crosses a border of macro tiles of ``MACRO`` pixels. What is shuffled is leaves, which are short, by (image, macro
tile); a task draws a macro tile from the few leaves that it holds and an image is never in one task. Smoothing of seams exchanges strips of one pixel between neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import layers as L

#: Side of a macro tile, the largest leaf.
MACRO = 32
#: Macro tiles that are drawn at once.
BATCH = 128
LEAF = ("y", "x", "size", "prims", "bias", "grid")


def _grids(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the leaves have a grid, and those grids as n x g x g x 3, for leaves whose grids have one size."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[at]
    has = at[sizes > 0]
    flat = column.take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).astype(float)
    g = int(round((len(flat) / max(1, len(has)) / 3) ** 0.5))
    return has, flat.reshape(len(has), g, g, 3)


def _bias(column: pa.Array, at: np.ndarray) -> np.ndarray:
    return L.ragged(column.take(pa.array(at)), 3)


def draw(leaves: pa.Array, size: int, pixels: int, at: np.ndarray) -> np.ndarray:
    """The leaves (a struct column) at some places, all of one size, drawn with so many pixels."""
    some = leaves.take(pa.array(at))
    tiles = L.compose(L.layers(some.field("prims")), len(at), size, pixels, _bias(leaves.field("bias"), at))
    column = some.field("grid")
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        has, grid = _grids(column, np.flatnonzero(sizes == n))
        tiles[has] = np.clip(tiles[has] + L.spread(grid, pixels), 0, 1)
    return tiles


def _key(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def macros(leaves: DataFrame) -> DataFrame:
    """image, height, width, my, mx and v (MACRO^2 * 3 samples, row by row; black where no leaf is) of every macro tile that has a leaf."""
    d = leaves.filter((F.col("y") < F.col("height")) & (F.col("x") < F.col("width")))
    leaf = F.struct((F.col("y") % MACRO).cast("int").alias("y"), (F.col("x") % MACRO).cast("int").alias("x"), *[F.col(c) for c in LEAF[2:]])
    place = [F.floor(F.col("y") / MACRO).cast("int").alias("my"), F.floor(F.col("x") / MACRO).cast("int").alias("mx")]
    d = d.groupBy("image", "height", "width", *place).agg(F.collect_list(leaf).alias("leaves"))  # at most sixteen of eight pixels
    keys = ["image", "height", "width", "my", "mx"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for start in range(0, b.num_rows, BATCH):
                part = b.slice(start, BATCH)
                column = part.column("leaves")
                counts = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = column.flatten()
                of = np.repeat(np.arange(part.num_rows), counts)
                y, x, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "size"))
                out = np.zeros((part.num_rows, MACRO, MACRO, 3))
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    tiles = draw(flat, int(s), int(s), at).reshape(-1, s, s, 3)
                    rows, cols = y[at, None, None] + np.arange(s)[None, :, None], x[at, None, None] + np.arange(s)[None, None, :]
                    out[of[at, None, None], rows, cols] = tiles
                yield _emitted(part, keys, out)

    return d.mapInArrow(run, f"{_key(d, keys)}, v array<double>")


def _emitted(part: pa.RecordBatch, keys: list[str], out: np.ndarray) -> pa.RecordBatch:
    n = len(out)
    flat = pa.array(np.ascontiguousarray(out).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (out.size // max(1, n))), flat)
    return pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), lists], names=[*keys, "v"])


def _smoothed_along(scene: DataFrame, tile: int, axis: str) -> DataFrame:
    """Both pixels at each seam across an axis become their mean. Every macro tile sends its first and last line to its neighbours."""
    move = "mx" if axis == "x" else "my"
    stay = "my" if axis == "x" else "mx"
    lines = F.sequence(F.lit(0), F.lit(MACRO - 1))

    def line(k: int):
        at = (lambda i: (i * MACRO + k) * 3) if axis == "x" else (lambda i: (F.lit(k * MACRO) + i) * 3)
        return F.flatten(F.transform(lines, lambda i: F.slice("v", at(i) + 1, 3)))

    none = F.lit(None).cast("array<double>")
    sent = F.array(
        F.struct(F.col(move).alias("to"), F.col("v").alias("whole"), none.alias("before"), none.alias("after")),
        F.struct((F.col(move) + 1).alias("to"), none.alias("whole"), line(MACRO - 1).alias("before"), none.alias("after")),
        F.struct((F.col(move) - 1).alias("to"), none.alias("whole"), none.alias("before"), line(0).alias("after")),
    )
    d = scene.select("image", "height", "width", stay, F.explode(sent).alias("s")).select("image", "height", "width", stay, "s.*")
    parts = ("whole", "before", "after")
    d = d.groupBy("image", "height", "width", stay, F.col("to").alias(move)).agg(*[F.max(p).alias(p) for p in parts]).filter(F.col("whole").isNotNull())
    keys = ["image", "height", "width", "my", "mx"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for start in range(0, b.num_rows, BATCH):
                part = b.slice(start, BATCH)
                n = part.num_rows
                v = part.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(n, MACRO, MACRO, 3).copy()
                if axis == "y":
                    v = v.transpose(0, 2, 1, 3)
                first = part.column(move).to_numpy() * MACRO
                end = part.column("width" if axis == "x" else "height").to_numpy()
                for k in range(0, MACRO, tile):
                    here = np.flatnonzero(first + k < end)  # a seam past the edge is none
                    if k:
                        v[here, :, k - 1 : k + 1] = v[here, :, k - 1 : k + 1].mean(axis=2, keepdims=True)
                for name, k, there in (("before", 0, first > 0), ("after", MACRO - 1, first + MACRO < end)):
                    strip = part.column(name)
                    has = np.flatnonzero(strip.is_valid().to_numpy(zero_copy_only=False) & there)
                    other = strip.take(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(len(has), MACRO, 3)
                    v[has, :, k] = 0.5 * (v[has, :, k] + other)
                yield _emitted(part, keys, v if axis == "x" else v.transpose(0, 2, 1, 3))

    return d.select(*keys, *parts).mapInArrow(run, f"{_key(d, keys)}, v array<double>")


def smoothed(scene: DataFrame, tile: int) -> DataFrame:
    """A scene of macro tiles with its seams at all multiples of tile (2 to MACRO, a divisor of it) evened out, first across columns, then across rows."""
    if tile < 2 or MACRO % tile:
        raise ValueError(f"tiles of {tile} don't fill macro tiles of {MACRO}")
    return _smoothed_along(_smoothed_along(scene, tile, "x"), tile, "y")


def uniform(tiles: DataFrame, size: int, smooth: bool = True) -> DataFrame:
    """A grid of tiles of one size, in row order: (image, height, width, tile, prims, bias, grid) to macro tiles."""
    across = F.ceil(F.col("width") / size)
    t = F.col("tile")
    leaves = tiles.withColumn("y", (F.floor(t / across) * size).cast("int")).withColumn("x", (t % across * size).cast("int")).withColumn("size", F.lit(size))
    scene = macros(leaves)
    return smoothed(scene, size) if smooth else scene


def scaled(leaves: DataFrame, height: str, width: str) -> DataFrame:
    """Leaves drawn at another resolution (columns of target height and width): image, y, x, rows, cols and v of each. Primitives are sampled where the new pixels are,
    so edges stay sharp; borders are rounded, so leaves leave no gap and don't overlap."""
    to = lambda at, target, source: F.rint(at * (F.col(target) / F.col(source))).cast("int")
    y0, x0 = to(F.col("y"), height, "height"), to(F.col("x"), width, "width")
    d = leaves.select(
        "image", y0.alias("y"), x0.alias("x"), F.greatest(F.lit(1), to(F.col("y") + F.col("size"), height, "height") - y0).alias("rows"),
        F.greatest(F.lit(1), to(F.col("x") + F.col("size"), width, "width") - x0).alias("cols"), F.struct(*LEAF[2:]).alias("leaf"),
    )
    keys = ["image", "y", "x", "rows", "cols"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            flat = b.column("leaf")
            size = flat.field("size").to_numpy(zero_copy_only=False)
            rows, cols = b.column("rows").to_numpy(), b.column("cols").to_numpy()
            for s, r, c in np.unique(np.stack([size, rows, cols], axis=1), axis=0).tolist():
                every = np.flatnonzero((size == s) & (rows == r) & (cols == c))
                px = max(r, c)
                step = max(1, (BATCH * MACRO * MACRO) // (px * px))
                for start in range(0, len(every), step):
                    at = every[start : start + step]
                    tiles = draw(flat, s, px, at).reshape(-1, px, px, 3)[:, :r, :c]
                    yield _emitted(b.take(pa.array(at)), keys, tiles)

    return d.mapInArrow(run, f"{_key(d, keys)}, v array<double>")


def pixels(scene: DataFrame) -> DataFrame:
    """image, y, x, ch and v of every pixel inside the image."""
    d = scene.select("image", "height", "width", "my", "mx", F.posexplode("v").alias("i", "v"))
    y, x = F.col("my") * MACRO + F.expr(f"i div {MACRO * 3}"), F.col("mx") * MACRO + F.expr(f"i div 3 % {MACRO}")
    d = d.select("image", "height", "width", y.cast("int").alias("y"), x.cast("int").alias("x"), (F.col("i") % 3).alias("ch"), "v")
    return d.filter((F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))).drop("height", "width")
