"""Residual layers of colour tiles: transforms of 8, 16 and 32 in one pass, three chroma modes, a step scale a tile, and two orders of coefficients.

A tile is size x size x 3 samples. Mode 0 codes red, green and blue; mode 1 luma and two chroma planes; mode 2 the same with chroma halved both ways. Tiles of a batch are
dealt by size, so each transform is one product of matrices. Coefficients of a tile follow one another by channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import kernels as K

RGB, YCC, YCC_HALVED = 0, 1, 2
#: Chroma's step over luma's (fixed value).
CHROMA_STEP = 1.5
#: BT.601 without offsets.
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.299 / 1.772, -0.587 / 1.772, 0.886 / 1.772], [0.701 / 1.402, -0.587 / 1.402, -0.114 / 1.402]])
_TO_RGB = np.linalg.inv(_TO_YCC)


def channel_sizes(size: int, mode: int) -> tuple[int, int, int]:
    """Sides of the three channels' blocks."""
    if mode not in (RGB, YCC, YCC_HALVED):
        raise ValueError(f"chroma mode {mode}")
    return (size, size // 2, size // 2) if mode == YCC_HALVED else (size, size, size)


def encode(tiles: np.ndarray, size: int, mode: int, step: float, alpha: float = 0.0, scales: np.ndarray | None = None) -> np.ndarray:
    """n x size^2 x 3 samples to n x (all channels') quantised coefficients."""
    planes = tiles if mode == RGB else tiles @ _TO_YCC.T
    scales = np.ones(len(tiles)) if scales is None else scales
    out = []
    for c, side in enumerate(channel_sizes(size, mode)):
        p = planes[:, :, c]
        if side < size:
            p = p.reshape(-1, side, 2, side, 2).mean(axis=(2, 4)).reshape(-1, side * side)
        unit = step * (CHROMA_STEP if c and mode != RGB else 1) * K.weights(side, alpha)
        out.append(np.clip(np.rint(p @ K.dct_matrix_2d(side).T / (unit * scales[:, None])), -32767, 32767))
    return np.concatenate(out, axis=1)


def decode(q: np.ndarray, size: int, mode: int, step: float, alpha: float = 0.0, scales: np.ndarray | None = None) -> np.ndarray:
    scales = np.ones(len(q)) if scales is None else scales
    planes, at = np.empty((len(q), size * size, 3)), 0
    for c, side in enumerate(channel_sizes(size, mode)):
        unit = step * (CHROMA_STEP if c and mode != RGB else 1) * K.weights(side, alpha)
        p = (q[:, at : at + side * side] * (unit * scales[:, None])) @ K.dct_matrix_2d(side)
        at += side * side
        if side < size:
            p = p.reshape(-1, side, 1, side, 1).repeat(2, axis=2).repeat(2, axis=4)
        planes[:, :, c] = p.reshape(-1, size * size)
    return planes if mode == RGB else planes @ _TO_RGB.T


def _zigzag(size: int, mode: int) -> np.ndarray:
    at, out = 0, []
    for side in channel_sizes(size, mode):
        out += [at + i for i in K.zigzag(side)]
        at += side * side
    return np.array(out)


def band_major(tiles: Sequence[np.ndarray], sizes: Sequence[int], mode: int) -> np.ndarray:
    """Coefficients of tiles of any sizes by frequency: all tiles' first ones, then all second ones along the zig-zag, the sizes one after another (from the smallest)."""
    out = [np.zeros(0)]
    for size in sorted(set(sizes)):
        out.append(np.array([t for t, s in zip(tiles, sizes, strict=True) if s == size])[:, _zigzag(size, mode)].T.reshape(-1))
    return np.concatenate(out)


def tile_major(flat: np.ndarray, sizes: Sequence[int], mode: int) -> list[np.ndarray]:
    """Back from ``band_major``: each tile's coefficients."""
    out: list = [None] * len(sizes)
    at = 0
    for size in sorted(set(sizes)):
        which = [i for i, s in enumerate(sizes) if s == size]
        order = _zigzag(size, mode)
        bands = flat[at : at + len(order) * len(which)].reshape(len(order), len(which))
        at += bands.size
        straight = np.empty((len(which), len(order)))
        straight[:, order] = bands.T
        for i, row in zip(which, straight, strict=True):
            out[i] = row
    if at != len(flat):
        raise ValueError(f"{len(flat)} coefficients where the tiles have {at}")
    return out


def split_flat(flat: np.ndarray, sizes: Sequence[int], mode: int) -> list[np.ndarray]:
    """Tile-major coefficients by tile."""
    n = [sum(s * s for s in channel_sizes(size, mode)) for size in sizes]
    if sum(n) != len(flat):
        raise ValueError(f"{len(flat)} coefficients where the tiles have {sum(n)}")
    return np.split(flat, np.cumsum(n)[:-1]) if n else []


_MADE = {"q": pa.list_(pa.int32()), "back": pa.list_(pa.float64()), "mse": pa.float64()}
_DDL = {"q": "array<int>", "back": "array<double>", "mse": "double"}


def coded(tiles: DataFrame, step: float, alpha: float = 0.0, out: Sequence[str] = ("q", "back", "mse"), samples: tuple[str, Callable[[pa.Array, int], np.ndarray]] | None = None) -> DataFrame:
    """(.., size, mode, scale, v) of colour tiles with those of out: q (their coefficients), back (what these give) and mse; every size and mode of a batch in one pass each. Rows with a null v, or
    with one of another length than size asks for, keep nulls; where samples are missing or not finite, all coefficients are null and so are the others.

    Wide rows make large batches in Python. With samples (a column, and what makes n x size^2 x 3 samples of n of its values) that column takes the place of v, and samples only exist
    for the rows at hand."""
    source, make = samples or ("v", None)
    keep = [c for c in tiles.columns if c != source]
    ddl = ", ".join([*(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {_DDL[c]}" for c in out)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n = part.num_rows
                size, mode = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("size", "mode"))
                scale = part.column("scale").fill_null(1.0).to_numpy(zero_copy_only=False)
                lengths = part.column(source).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                made: dict[str, list] = {"q": [None] * n, "back": [None] * n, "mse": [None] * n}
                for s, m in sorted({*zip(size.tolist(), mode.tolist(), strict=True)}):
                    rows = np.flatnonzero((size == s) & (mode == m) & (s > 0) & (make is not None or lengths == 3 * s * s))
                    if not len(rows):
                        continue
                    v = part.column(source).take(pa.array(rows))
                    v = make(v, s) if make else v.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), s * s, 3)
                    whole = np.isfinite(v).all(axis=(1, 2))
                    for row in rows[~whole].tolist():
                        made["q"][row] = [None] * sum(x * x for x in channel_sizes(s, m))
                    v, rows = v[whole], rows[whole]
                    c = encode(v, s, m, step, alpha, scale[rows])
                    r = decode(c, s, m, step, alpha, scale[rows]) if {"back", "mse"} & {*out} else v
                    for i, row in enumerate(rows.tolist()):
                        made["q"][row], made["back"][row], made["mse"][row] = c[i].astype(np.int32), r[i].reshape(-1), float(((r[i] - v[i]) ** 2).mean())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(made[c], _MADE[c]) for c in out)], names=[*keep, *out])

    return tiles.select(*keep, F.col(source).cast("array<double>").alias(source)).mapInArrow(run, ddl)


def extract(macros: DataFrame, leaves: DataFrame, keep: Sequence[str], side: int = 32) -> DataFrame:
    """The samples of quadtree leaves (keep, size, by, bx: a leaf's place in units of its size) out of macro tiles (keep, ty, tx, samples), as leaves with v: an equi-join on the macro
    tile, then slices of its rows; a leaf inside a macro tile has its pixels together, so no pixel is joined by itself."""
    here = lambda c: F.expr(f"{c} * size div {side}").cast("int")
    d = leaves.withColumn("ty", here("by")).withColumn("tx", here("bx")).join(macros, [*keep, "ty", "tx"])
    y, x = F.col("by") * F.col("size") - F.col("ty") * side, F.col("bx") * F.col("size") - F.col("tx") * side
    rows = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda r: F.slice("samples", (y + r) * side + x + 1, F.col("size")))
    return d.select(*leaves.columns, F.flatten(rows).alias("v"))
