"""Stacks of vector primitives of many tiles at once: coverage, compositing, and the weights that colours have in a picture.

A stack column is array<struct<kind, geom, color0, color1, alpha>> (``primitives.DDL``), back to front. All tiles of a call have one size; primitives are taken layer by layer and
kind by kind, so NumPy works on whole batches and no tile is visited by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tilespark.operators import kernels
from tilespark.operators import primitives as P

#: Chords of a curve, as the single-tile renderer has them.
CHORDS = 31


@dataclass
class Layers:
    """Primitives as arrays: the tile of each, its place in the tile's stack, and its values. geom has as many columns as the longest needs."""

    tile: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    geom: np.ndarray
    color0: np.ndarray
    color1: np.ndarray
    alpha: np.ndarray

    def take(self, index: np.ndarray) -> Layers:
        return Layers(*(getattr(self, f)[index] for f in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.kind)


def ragged(column: pa.Array, width: int, fill: float = 0.0) -> np.ndarray:
    """A list column as rows of width; what is missing (or null) is fill."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((n, width), fill)
    row = np.repeat(np.arange(n), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


def layers(column: pa.Array) -> Layers:
    """From a stack column; a null stack is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    p = column.flatten()
    field = lambda name: p.field(name)
    geom = field("geom")
    width = max([1, *geom.value_lengths().fill_null(0).to_pylist()])
    c0 = ragged(field("color0"), 3)
    c1 = ragged(field("color1"), 3, np.nan)
    return Layers(
        np.repeat(np.arange(len(column)), sizes), np.arange(len(p)) - np.repeat(np.cumsum(sizes) - sizes, sizes), field("kind").to_numpy(zero_copy_only=False).astype(np.int64),
        ragged(geom, width), c0, np.where(np.isnan(c1), c0, c1), np.clip(field("alpha").to_numpy(zero_copy_only=False).astype(float), 0, 1),
    )


def of(stacks: list[list[dict]]) -> Layers:
    """From lists of primitives, a list a tile."""
    flat = [(i, k, p) for i, s in enumerate(stacks) for k, p in enumerate(s)]
    width = max([1, *(len(p["geom"] or ()) for _, _, p in flat)])
    geom, c0, c1 = np.zeros((len(flat), width)), np.zeros((len(flat), 3)), np.zeros((len(flat), 3))
    for j, (_, _, p) in enumerate(flat):
        g = p["geom"] or ()
        geom[j, : len(g)] = g
        c0[j] = p["color0"]
        c1[j] = p["color1"] or p["color0"]
    at = lambda k: np.array([x[k] for x in flat], np.int64)
    return Layers(at(0), at(1), np.array([p["kind"] for *_, p in flat], np.int64), geom, c0, c1, np.clip([p["alpha"] for *_, p in flat], 0, 1).astype(float))


def centres(source: float, pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixel centres (y, x) of a tile of source units that is drawn with so many pixels, as one row of pixels * pixels."""
    at = (np.arange(pixels) + 0.5) * source / pixels
    return np.repeat(at, pixels)[None, :], np.tile(at, pixels)[None, :]


def _to_segment(x, y, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((x - x0) * dx + (y - y0) * dy) / np.maximum(dx * dx + dy * dy, 1e-8), 0, 1)
    return np.hypot(x - x0 - t * dx, y - y0 - t * dy)


def coverage(kind: int, geom: np.ndarray, alpha: np.ndarray, source: float, pixels: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Of n primitives of one kind: alpha (n x pixels^2), and for linear ones the share of the second colour."""
    y, x = centres(source, pixels)
    g = [geom[:, i, None] for i in range(geom.shape[1])]
    a = np.broadcast_to(alpha[:, None], (len(alpha), pixels * pixels))
    if kind == P.LINEAR:
        dx, dy = g[2] - g[0], g[3] - g[1]
        return a, np.clip(((x - g[0]) * dx + (y - g[1]) * dy) / (dx * dx + dy * dy + 1e-8), 0, 1)
    if kind == P.LINE:
        d = _to_segment(x, y, *g[:4])
        return a * np.exp(-(d**2) / (2 * np.maximum(0.5, g[4]) ** 2)), None
    if kind == P.CURVE:
        t = np.linspace(0, 1, CHORDS + 1)
        px, py = ((1 - t) ** 2 * g[i] + 2 * t * (1 - t) * g[i + 2] + t**2 * g[i + 4] for i in (0, 1))
        d = np.full((len(alpha), pixels * pixels), np.inf)
        for i in range(CHORDS):
            np.minimum(d, _to_segment(x, y, *(v[:, j, None] for j in (i, i + 1) for v in (px, py))), out=d)
        return a * np.exp(-(d**2) / (2 * np.maximum(0.5, g[6]) ** 2)), None
    if kind == P.TRIANGLE:
        ax, ay, bx, by, cx, cy = g[:6]
        d = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
        real = np.abs(d) >= 1e-8
        d = np.where(real, d, 1)
        u = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / d
        v = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / d
        return a * (real & (u >= 0) & (v >= 0) & (u + v <= 1)), None
    return a, None


def compose(stack: Layers, n: int, source: float, pixels: int, bias: np.ndarray | None = None, base: np.ndarray | None = None) -> np.ndarray:
    """n tiles (n x pixels^2 x 3) of their stacks over base (black if None), with a bias (n x 3, in 255ths), clipped to 0..1."""
    out = np.zeros((n, pixels * pixels, 3)) if base is None else base.copy()
    for place in range(int(stack.place.max()) + 1 if len(stack) else 0):
        here = np.flatnonzero(stack.place == place)
        for kind in np.unique(stack.kind[here]):
            s = stack.take(here[stack.kind[here] == kind])
            if kind == P.BICUBIC:
                cp = s.geom[:, :48].reshape(-1, 16, 3)
                out[s.tile] = np.stack([kernels.bicubic_eval(cp[:, :, c], pixels) for c in range(3)], axis=2)
                continue
            a, t = coverage(kind, s.geom, s.alpha, source, pixels)
            src = s.color0[:, None, :] if t is None else s.color0[:, None, :] * (1 - t[..., None]) + s.color1[:, None, :] * t[..., None]
            out[s.tile] = src * a[..., None] + out[s.tile] * (1 - a[..., None])
    if bias is not None:
        out += bias[:, None, :] / 255
    return np.clip(out, 0, 1)


def visibility(stack: Layers, n: int, depth: int, source: float, pixels: int) -> np.ndarray:
    """n x 2 * depth x pixels^2: what the first and the second colour of each layer weigh in each pixel, its alpha times what the layers over it let through. A layer that a
    tile lacks, and a second colour that a kind lacks, weigh nothing; bicubic layers are not for this."""
    w = np.zeros((n, depth, 2, pixels * pixels))
    through = np.ones((n, pixels * pixels))
    for place in reversed(range(depth)):
        here = np.flatnonzero(stack.place == place)
        for kind in np.unique(stack.kind[here]):
            s = stack.take(here[stack.kind[here] == kind])
            a, t = coverage(kind, s.geom, s.alpha, source, pixels)
            share = np.zeros_like(a) if t is None else t
            w[s.tile, place, 0] = a * (1 - share) * through[s.tile]
            w[s.tile, place, 1] = a * share * through[s.tile]
            through[s.tile] = through[s.tile] * (1 - a)
    return w.reshape(n, 2 * depth, -1)


def lerp(pixels: int, cells: int) -> np.ndarray:
    """Weights (pixels x cells) of values at the middles of cells for pixel centres; beyond the outer middles the nearest value holds."""
    at = np.clip((np.arange(pixels) + 0.5) * cells / pixels - 0.5, 0, cells - 1)
    low = np.floor(at).astype(np.int64)
    m = np.zeros((pixels, cells))
    np.add.at(m, (np.arange(pixels), low), 1 - (at - low))
    np.add.at(m, (np.arange(pixels), np.minimum(low + 1, cells - 1)), at - low)
    return m


def spread(grid: np.ndarray, pixels: int) -> np.ndarray:
    """Grids of n x g x g x 3, a value at the middle of each cell, at all pixel centres (n x pixels^2 x 3), bilinear."""
    m = lerp(pixels, grid.shape[1])
    return np.einsum("ya,nabc,xb->nyxc", m, grid, m).reshape(len(grid), pixels * pixels, grid.shape[3])
