"""Candidates that follow a tile's edges: ramps across its main orientations, a line, an arc and a triangle along its edge points.

``candidates`` gives a row for each candidate of each tile, in order; ``register`` makes the same a table function of SQL (``SELECT ... FROM tiles, LATERAL edge_candidates(v)``). Tiles are square arrays
of one channel; null tiles, tiles of another length than side^2 and tiles with NaN have no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilespark.operators import layers as L
from tilespark.operators import primitives as P

BINS = 12
#: Share of the strongest orientation from which one counts, and the percentile of gradients that makes an edge point (fixed values).
PEAK, EDGE = 0.2, 75.0
KIND = {"ramp": P.LINEAR, "line": P.LINE, "arc": P.CURVE, "triangle": P.TRIANGLE}
DDL = "ord int, family string, kind int, geom array<double>, color0 double, color1 double"


def sobel(tiles: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (along x, along y) of inner pixels, n x (side - 2)^2."""
    t = tiles.reshape(-1, side, side)
    down, right = t[:, :-2] + 2 * t[:, 1:-1] + t[:, 2:], t[:, :, :-2] + 2 * t[:, :, 1:-1] + t[:, :, 2:]
    shape = (len(t), (side - 2) ** 2)
    return (down[:, :, 2:] - down[:, :, :-2]).reshape(shape), (right[:, 2:] - right[:, :-2]).reshape(shape)


def orientations(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Gradient weight by direction (0 to pi), n x BINS."""
    a = np.arctan2(gy, gx)
    a = np.where(a < 0, a + np.pi, np.where(a >= np.pi, a - np.pi, a))
    bins = np.minimum(BINS - 1, np.floor(a / np.pi * BINS)).astype(int)
    out = np.zeros((len(gx), BINS))
    np.add.at(out, (np.arange(len(gx))[:, None], bins), np.hypot(gx, gy))
    return out


def principal(points: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the points that a mask (n x p) picks: middle (cx, cy), axis (ux, uy) and the least and largest place along it. The axis points right, or down if it is upright; points without a main direction have the level one."""
    n = np.maximum(1, points.sum(axis=1))
    cx, cy = (points * x).sum(axis=1) / n, (points * y).sum(axis=1) / n
    dx, dy = x[None] - cx[:, None], y[None] - cy[:, None]
    sxx, syy, sxy = ((points * p).sum(axis=1) for p in (dx * dx, dy * dy, dx * dy))
    angle = np.where(np.hypot(2 * sxy, sxx - syy) > 1e-9 * (sxx + syy), 0.5 * np.arctan2(2 * sxy, sxx - syy), 0.0)
    ux, uy = np.cos(angle), np.sin(angle)
    uy = np.where(np.abs(ux) < 1e-9, np.abs(uy), uy)
    along = dx * ux[:, None] + dy * uy[:, None]
    return cx, cy, ux, uy, np.where(points, along, np.inf).min(axis=1), np.where(points, along, -np.inf).max(axis=1)


def of(tiles: np.ndarray, side: int) -> list[list[tuple]]:
    """(family, geom, color0, color1) of each tile's candidates, in order."""
    n, m, reach = len(tiles), side / 2, 0.6 * (side - 1)
    y, x = (v[0] for v in L.centres(side, side))
    inner = (y > 1) & (y < side - 1) & (x > 1) & (x < side - 1)
    gx, gy = sobel(tiles, side)
    weight = orientations(gx, gy)
    peaks = weight > PEAK * weight.max(axis=1, keepdims=True)
    size = np.hypot(gx, gy)
    points = (size >= np.percentile(size, EDGE, axis=1)[:, None]) & (size > 0)
    yi, xi = y[inner], x[inner]
    cx, cy, ux, uy, low, high = principal(points, yi, xi)
    colour = (tiles[:, inner] * points).sum(axis=1) / np.maximum(1, points.sum(axis=1))
    dark = tiles < tiles.mean(axis=1, keepdims=True)
    out: list[list[tuple]] = [[] for _ in range(n)]
    for b in range(BINS):
        theta = (b + 0.5) * np.pi / BINS
        c, s = np.cos(theta), np.sin(theta)
        ahead = (x - m) * c + (y - m) * s >= 0
        geom = [m - c * reach, m - s * reach, m + c * reach, m + s * reach]
        for i in np.flatnonzero(peaks[:, b]):
            out[i].append(("ramp", geom, tiles[i, ~ahead].mean(), tiles[i, ahead].mean()))
    for i in np.flatnonzero(points.sum(axis=1) >= 2):
        ends = [cx[i] + low[i] * ux[i], cy[i] + low[i] * uy[i], cx[i] + high[i] * ux[i], cy[i] + high[i] * uy[i]]
        out[i].append(("line", [*ends, 1.0], colour[i], colour[i]))
        at = np.flatnonzero(points[i])
        if len(at) >= 3:
            by = at[np.argsort((xi[at] - cx[i]) * ux[i] + (yi[at] - cy[i]) * uy[i], kind="stable")]
            p0, mid, p1 = ((xi[k], yi[k]) for k in (by[0], by[len(by) // 2], by[-1]))
            bend = [min(float(side), max(0.0, 2 * mid[k] - (p0[k] + p1[k]) / 2)) for k in (0, 1)]
            out[i].append(("arc", [*p0, *bend, *p1, 1.0], colour[i], colour[i]))
    for i in np.flatnonzero(dark.sum(axis=1) >= 3):
        at = np.flatnonzero(dark[i])
        left, right = at[np.argmin(x[at])], at[np.argmax(x[at])]
        out[i].append(("triangle", [x[left], y[left], x[right], y[right], x[at].mean(), y[at].mean()], tiles[i, at].mean(), tiles[i, at].mean()))
    return out


def candidates(tiles: DataFrame, keep: list[str], v: str, side: int) -> DataFrame:
    """keep and the columns of DDL."""
    d = tiles.select(*keep, tiles[v].cast("array<double>").alias("__v"))
    ddl = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep) + ", " + DDL

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lengths = b.column("__v").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(lengths == side * side)
            if not len(rows):
                continue
            m = b.column("__v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, side * side)
            fine = np.isfinite(m).all(axis=1)
            found = of(m[fine], side) if fine.any() else []
            which = np.repeat(rows[fine], [len(f) for f in found])
            flat = [(k, *c) for f in found for k, c in enumerate(f)]
            if not flat:
                continue
            order, family, geom, c0, c1 = zip(*flat, strict=True)
            made = [pa.array(order, pa.int32()), pa.array(family), pa.array([KIND[f] for f in family], pa.int32()), pa.array([np.asarray(g, float) for g in geom], pa.list_(pa.float64())), pa.array(c0, pa.float64()), pa.array(c1, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(which)) for c in keep), *made], names=[*keep, "ord", "family", "kind", "geom", "color0", "color1"])

    return d.mapInArrow(run, ddl)


def register(spark: SparkSession, name: str = "edge_candidates") -> None:
    """The table function, for tiles of any square size."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=DDL)
    class EdgeCandidates:
        def eval(self, v: list):
            side = int(round(len(v) ** 0.5)) if v else 0
            m = np.array(v or [], dtype=float).reshape(1, -1)
            if side < 3 or side * side != m.shape[1] or not np.isfinite(m).all():
                return
            for k, (family, geom, c0, c1) in enumerate(of(m, side)[0]):
                yield k, family, KIND[family], [float(g) for g in geom], float(c0), float(c1)

    spark.udtf.register(name, EdgeCandidates)
