"""NumPy kernels over many tiles at once, and how DataFrames reach them: whole Arrow batches, no row loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}


def stacked(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix, a row each; null elements are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def listed(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = m.shape
    flat = pa.array(np.ascontiguousarray(m).reshape(-1).astype(kind.value_type.to_pandas_dtype()), kind.value_type)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)


def over_tiles(df: DataFrame, arrays: str | list[str], columns: dict[str, str], kernel: Callable[..., list], keep: list[str]) -> DataFrame:
    """keep and the kernel's columns: it gets matrices (a row for each tile) and returns one array for each column."""
    names = [arrays] if isinstance(arrays, str) else arrays
    d = df.select(*keep, *names)
    ddl = ", ".join([*(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keep), *(f"`{c}` {t}" for c, t in columns.items())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            out = kernel(*[stacked(b.column(n)) for n in names])
            made = [listed(x, _ARROW[t]) if t.startswith("array") else pa.array(x, _ARROW[t]) for x, t in zip(out, columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *made], names=[*keep, *columns])

    return d.mapInArrow(run, ddl)


@lru_cache
def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II: coefficient k of a line is row k times it."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


@lru_cache
def dct_matrix_2d(n: int) -> np.ndarray:
    """The same for tiles as rows of n * n samples: coefficients = tiles @ this.T"""
    return np.kron(dct_matrix(n), dct_matrix(n))


@lru_cache
def zigzag(n: int) -> tuple[int, ...]:
    """Row-major index of each place of the zig-zag order: along anti-diagonals, odd ones downwards."""
    cells = [(i, j) for i in range(n) for j in range(n)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return tuple(i * n + j for i, j in cells)


@lru_cache
def weights(n: int, alpha: float) -> np.ndarray:
    i, j = np.mgrid[0:n, 0:n]
    return (1 + alpha * (i + j) / (2 * (n - 1)) if n > 1 else np.ones((1, 1))).reshape(-1)


def dct_quantise(tiles: np.ndarray, step: float, alpha: float = 0.0) -> np.ndarray:
    n = int(round(tiles.shape[1] ** 0.5))
    q = np.rint(tiles @ dct_matrix_2d(n).T / (step * weights(n, alpha)))
    return np.clip(q, -32767, 32767)


def dct_restore(q: np.ndarray, step: float, alpha: float = 0.0) -> np.ndarray:
    n = int(round(q.shape[1] ** 0.5))
    return (q * (step * weights(n, alpha))) @ dct_matrix_2d(n)


@lru_cache
def bernstein(n: int) -> np.ndarray:
    """Cubic Bernstein basis at n places from 0 to 1, both ends included: the outer samples lie on the patch's edge."""
    t = np.linspace(0, 1, n)
    return np.stack([(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t**2 * (1 - t), t**3], axis=1)


@lru_cache
def bernstein_inverse(n: int) -> np.ndarray:
    return np.linalg.pinv(bernstein(n))


def bicubic_fit(tiles: np.ndarray) -> np.ndarray:
    """16 control values of each square tile, by least squares."""
    n = int(round(tiles.shape[1] ** 0.5))
    p = bernstein_inverse(n)
    return np.einsum("ai,tij,bj->tab", p, tiles.reshape(-1, n, n), p).reshape(-1, 16)


def bicubic_eval(control: np.ndarray, n: int) -> np.ndarray:
    b = bernstein(n)
    return np.einsum("ia,tab,jb->tij", b, control.reshape(-1, 4, 4), b).reshape(-1, n * n)


def forward(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward differences, 0 at the far edge, along x and along y."""
    n = int(round(tiles.shape[1] ** 0.5))
    t = tiles.reshape(-1, n, n)
    gx, gy = np.zeros_like(t), np.zeros_like(t)
    gx[:, :, :-1], gy[:, :-1] = np.diff(t, axis=2), np.diff(t, axis=1)
    return gx.reshape(tiles.shape), gy.reshape(tiles.shape)


def divergence(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    n = int(round(gx.shape[1] ** 0.5))
    x, y = gx.reshape(-1, n, n), gy.reshape(-1, n, n)
    out = x + y
    out[:, :, 1:] -= x[:, :, :-1]
    out[:, 1:] -= y[:, :-1]
    return out.reshape(gx.shape)


def poisson(gx: np.ndarray, gy: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Tiles from their gradient fields and means: cosine transform, division by the Laplacian's eigenvalues."""
    n = int(round(gx.shape[1] ** 0.5))
    c = 2 * np.cos(np.pi * np.arange(n) / n)
    eigen = (c[:, None] + c[None, :] - 4).reshape(-1)
    eigen[0] = 1
    k = divergence(gx, gy) @ dct_matrix_2d(n).T / eigen
    k[:, 0] = mean * n
    return k @ dct_matrix_2d(n)


@lru_cache
def gaussian(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def blur(tiles: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of square tiles; borders are reflected (the edge sample counts twice)."""
    n = int(round(tiles.shape[1] ** 0.5))
    w = gaussian(sigma)
    r = len(w) // 2
    at = np.arange(-r, n + r)
    at = np.where((at // n) % 2 == 0, at % n, n - 1 - at % n)
    m = np.zeros((n, n))
    for i in range(n):
        np.add.at(m[i], at[i : i + len(w)], w)
    t = tiles.reshape(-1, n, n)
    return np.einsum("ai,tij,bj->tab", m, t, m).reshape(tiles.shape)


def retinex(tiles: np.ndarray, sigma: float = 2.0, floor: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Albedo and lighting of tiles: lighting is the blurred logarithm; albedo is scaled to its 99.5th percentile."""
    light = np.exp(blur(np.log(np.maximum(tiles, floor)), sigma))
    albedo = tiles / light
    top = np.maximum(np.percentile(albedo, 99.5, axis=1, keepdims=True), 1e-9)
    return np.clip(albedo / top, 0, 1), light * top


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 1.0) -> np.ndarray:
    """Mean structural similarity by uniform windows inside the tile, with unbiased variances."""
    n = int(round(a.shape[1] ** 0.5))
    view = lambda t: np.lib.stride_tricks.sliding_window_view(t.reshape(-1, n, n), (window, window), axis=(1, 2)).reshape(len(t), -1, window * window)
    x, y = view(a), view(b)
    mx, my = x.mean(axis=2), y.mean(axis=2)
    k = window * window / (window * window - 1)
    vx, vy, cov = k * (x.var(axis=2)), k * (y.var(axis=2)), k * ((x * y).mean(axis=2) - mx * my)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
    return s.mean(axis=1)


@lru_cache
def half_planes(n: int) -> np.ndarray:
    """18 two-bucket models of an n by n tile: six directions, three offsets; a row of 0 and 1 for each."""
    y, x = np.mgrid[0:n, 0:n] + 0.5 - n / 2
    out = []
    for a in range(6):
        along = x * np.cos(np.pi * a / 6) + y * np.sin(np.pi * a / 6)
        out += [(along > s * n / 4 + 1e-9).reshape(-1) for s in (-1, 0, 1)]
    return np.array(out, float)


def two_bucket_fit(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best model, its mean squared error and the means of both sides; an empty side has the tile's mean."""
    m = half_planes(int(round(tiles.shape[1] ** 0.5)))
    n1 = m.sum(axis=1)
    n0 = m.shape[1] - n1
    s1 = tiles @ m.T
    total = tiles.sum(axis=1, keepdims=True)
    s0, mean = total - s1, total / m.shape[1]
    c1 = np.where(n1 > 0, s1 / np.maximum(n1, 1), mean)
    c0 = np.where(n0 > 0, s0 / np.maximum(n0, 1), mean)
    mse = ((tiles**2).sum(axis=1, keepdims=True) - n1 * c1**2 - n0 * c0**2) / m.shape[1]
    best = np.argmin(np.round(mse, 9), axis=1)  # the first on ties
    at = np.arange(len(tiles))
    return best.astype(np.int32), mse[at, best], c0[at, best], c1[at, best]


def median_cut(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Palette of at most k colours and the label of each point: the box with the widest channel is cut at its median."""
    boxes = [np.arange(len(points))]
    while len(boxes) < k:
        spans = [np.ptp(points[b], axis=0).max() if len(b) > 1 else 0 for b in boxes]
        i = int(np.argmax(spans))
        if spans[i] == 0:
            break
        b = boxes.pop(i)
        ch = int(np.argmax(np.ptp(points[b], axis=0)))
        values = points[b, ch]
        mid = np.median(values)
        low = values <= mid if (values > mid).any() else values < mid
        boxes += [b[low], b[~low]]
    labels = np.empty(len(points), np.int32)
    for i, b in enumerate(boxes):
        labels[b] = i
    return np.array([points[b].mean(axis=0) for b in boxes]), labels
