"""Vector primitives: their wire form, rendering back to front, candidates and the greedy fit of a tile.

A primitive is a dict: kind (const, linear, line, curve, triangle, bicubic are 0 to 5), geom (0, 4, 5, 7, 6 or 48 numbers in
pixels of the tile; 48 control values for bicubic), color0, color1 (linear only) and alpha.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from tilespark.operators import kernels

CONST, LINEAR, LINE, CURVE, TRIANGLE, BICUBIC = range(6)
GEOM = {CONST: 0, LINEAR: 4, LINE: 5, CURVE: 7, TRIANGLE: 6, BICUBIC: 48}
THICK = 4.0
DDL = "struct<kind:int,geom:array<double>,color0:array<double>,color1:array<double>,alpha:double>"


def _u16(values, top: float) -> bytes:
    return np.rint(np.clip(np.asarray(values, float) / top, 0, 1) * 65535).astype("<u2").tobytes()


def _u8(values) -> bytes:
    return np.rint(np.clip(np.asarray(values, float), 0, 1) * 255).astype(np.uint8).tobytes()


def pack(p: dict, side: int) -> bytes:
    """Kind, payload length, payload. Coordinates run over 0..side - 1."""
    kind, geom = p["kind"], list(p["geom"] or [])
    if kind not in GEOM or len(geom) != GEOM[kind]:
        raise ValueError(f"kind {kind} with {len(geom)} numbers")
    if kind == BICUBIC:
        body = _u8(geom)
    else:
        line = kind in (LINE, CURVE)
        body = _u16(geom[: len(geom) - line], side - 1.0) + (_u16(geom[-1:], THICK) if line else b"")
        body += _u8(p["color0"]) + (_u8(p["color1"]) if kind == LINEAR else b"") + _u16([p["alpha"]], 1.0)
    return struct.pack("<BB", kind, len(body)) + body


def unpack(blob: bytes, at: int, side: int) -> tuple[dict, int]:
    kind, size = struct.unpack_from("<BB", blob, at)
    body = blob[at + 2 : at + 2 + size]
    if kind not in GEOM or len(body) != size:
        raise ValueError("not a primitive")
    if kind == BICUBIC:
        return {"kind": kind, "geom": (np.frombuffer(body, np.uint8) / 255).tolist(), "color0": [0.0] * 3, "color1": None, "alpha": 1.0}, at + 2 + size
    n = GEOM[kind]
    geom = np.frombuffer(body, "<u2", n).astype(float) / 65535
    scale = np.full(n, side - 1.0)
    if kind in (LINE, CURVE):
        scale[-1] = THICK
    colours = np.frombuffer(body, np.uint8, 3 * (1 + (kind == LINEAR)), 2 * n) / 255
    (alpha,) = struct.unpack("<H", body[-2:])
    return {"kind": kind, "geom": (geom * scale).tolist(), "color0": colours[:3].tolist(), "color1": colours[3:].tolist() or None, "alpha": alpha / 65535}, at + 2 + size


def pack_tile(prims: Iterable[dict], side: int) -> bytes:
    prims = list(prims)
    return struct.pack("<B", len(prims)) + b"".join(pack(p, side) for p in prims)


def unpack_tile(blob: bytes, side: int, at: int = 0) -> list[dict]:
    n, at, out = blob[at], at + 1, []
    for _ in range(n):
        p, at = unpack(blob, at, side)
        out.append(p)
    return out


def segment_distance(x, y, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-8), 0, 1)
    return np.hypot(x - x0 - t * dx, y - y0 - t * dy)


def curve_distance(x, y, a, c, b, chords: int = 31):
    t = np.linspace(0, 1, chords + 1)
    px, py = ((1 - t) ** 2 * a[i] + 2 * t * (1 - t) * c[i] + t**2 * b[i] for i in (0, 1))
    return np.min([segment_distance(x, y, px[i], py[i], px[i + 1], py[i + 1]) for i in range(chords)], axis=0)


def inside(x, y, g):
    (ax, ay), (bx, by), (cx, cy) = g[:2], g[2:4], g[4:6]
    d = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    if abs(d) < 1e-8:
        return np.zeros(np.shape(x), bool)
    u = ((by - cy) * (x - cx) + (cx - bx) * (y - cy)) / d
    v = ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / d
    return (u >= 0) & (v >= 0) & (u + v <= 1)


def render(prims: Iterable[dict], side: int, bias=None, size: int | None = None) -> np.ndarray:
    """A (size, size, 3) tile: primitives one over another, then a bias in 255ths; pixels are sampled at their centres."""
    size = size or side
    at = (np.arange(size) + 0.5) * side / size
    y, x = np.meshgrid(at, at, indexing="ij")
    out = np.zeros((size, size, 3))
    for p in prims:
        kind, g, alpha = p["kind"], list(p["geom"] or []), min(1.0, max(0.0, p["alpha"]))
        c0 = np.asarray(p["color0"], float)
        if kind == BICUBIC:
            cp = np.asarray(g, float).reshape(16, 3)
            out = np.stack([kernels.bicubic_eval(cp[None, :, c], size)[0].reshape(size, size) for c in range(3)], axis=2)
            continue
        src = c0
        a = np.full((size, size), alpha)
        if kind == LINEAR:
            dx, dy = g[2] - g[0], g[3] - g[1]
            t = np.clip(((x - g[0]) * dx + (y - g[1]) * dy) / (dx * dx + dy * dy + 1e-8), 0, 1)[..., None]
            src = c0 * (1 - t) + np.asarray(p["color1"] or c0, float) * t
        elif kind in (LINE, CURVE):
            d = segment_distance(x, y, *g[:4]) if kind == LINE else curve_distance(x, y, g[:2], g[2:4], g[4:6])
            a = alpha * np.exp(-(d**2) / (2 * max(0.5, g[-1]) ** 2))
        elif kind == TRIANGLE:
            a = alpha * inside(x, y, g)
        a = a[..., None]
        out = src * a + out * (1 - a)
    if bias is not None:
        out = out + np.asarray(bias, float) / 255
    return np.clip(out, 0, 1)


def candidates(tile: np.ndarray) -> list[dict]:
    """Primitives worth trying on a (n, n, 3) tile: constants, swept linear patches, lines and triangles, each with colours
    from the pixels that it covers. The order is part of the result."""
    n = len(tile)
    y, x = np.mgrid[0:n, 0:n] + 0.5
    flat = tile.reshape(-1, 3)
    out = [{"kind": CONST, "geom": [], "color0": c.tolist(), "color1": None, "alpha": 1.0} for c in (flat.mean(axis=0), np.median(flat, axis=0))]
    for q in (tile[: n // 2, : n // 2], tile[: n // 2, n // 2 :], tile[n // 2 :, : n // 2], tile[n // 2 :, n // 2 :]):
        out.append({"kind": CONST, "geom": [], "color0": q.reshape(-1, 3).mean(axis=0).tolist(), "color1": None, "alpha": 1.0})
    m = (n - 1) / 2
    for i in range(8):
        dx, dy = np.cos(np.pi * i / 8) * m, np.sin(np.pi * i / 8) * m
        g = [m - dx, m - dy, m + dx, m + dy]
        t = np.clip(((x - g[0]) * 2 * dx + (y - g[1]) * 2 * dy) / (4 * m * m), 0, 1).reshape(-1)
        (c0, c1), *_ = np.linalg.lstsq(np.stack([1 - t, t], axis=1), flat, rcond=None)
        out.append({"kind": LINEAR, "geom": g, "color0": np.clip(c0, 0, 1).tolist(), "color1": np.clip(c1, 0, 1).tolist(), "alpha": 1.0})
        near = segment_distance(x, y, *g) < 1.5
        out.append({"kind": LINE, "geom": [*g, 1.0], "color0": tile[near].mean(axis=0).tolist(), "color1": None, "alpha": 1.0})
    e = n - 1.0
    for g in ([0, 0, e, 0, 0, e], [e, e, e, 0, 0, e], [0, 0, e, 0, e, e], [0, 0, 0, e, e, e], [0, e, e, e, m, 0], [0, 0, e, 0, m, e]):
        on = inside(x, y, g)
        if on.any():
            out.append({"kind": TRIANGLE, "geom": [float(v) for v in g], "color0": tile[on].mean(axis=0).tolist(), "color1": None, "alpha": 1.0})
    return out


def bits(prims: Iterable[dict], side: int) -> int:
    return 8 + 8 * sum(len(pack(p, side)) for p in prims)


def objective(tile: np.ndarray, prims: list[dict], lam: float) -> float:
    """Of the primitives as they are read back from the wire."""
    n = len(tile)
    stored = unpack_tile(pack_tile(prims, n), n)
    return float(((render(stored, n) - tile) ** 2).mean()) + lam * bits(prims, n)


def fit(tile: np.ndarray, lam: float, rounds: int = 4) -> tuple[list[dict], list[float]]:
    """Greedy: each round adds the candidate that lowers the objective most, then drops what isn't worth its bits; the trace of
    objectives never rises."""
    prims: list[dict] = []
    trace = [objective(tile, prims, lam)]
    pool = candidates(tile)
    for _ in range(rounds):
        scored = [objective(tile, [*prims, c], lam) for c in pool]
        best = int(np.argmin(scored))  # the first on ties
        if scored[best] >= trace[-1]:
            break
        prims.append(pool[best])
        trace.append(scored[best])
        for i in reversed(range(len(prims))):
            rest = prims[:i] + prims[i + 1 :]
            if (o := objective(tile, rest, lam)) < trace[-1]:
                prims = rest
                trace.append(o)
    return prims, trace


def anneal(tile: np.ndarray, prims: list[dict], lam: float, steps: int = 60, seed: int = 12345) -> list[dict]:
    """Random nudges of coordinates and colours, the best state kept; the seed belongs to the tile."""
    rng = np.random.default_rng(seed)
    now, best = list(prims), list(prims)
    o_now = o_best = objective(tile, now, lam)
    for k in range(steps):
        if not now:
            break
        i = int(rng.integers(len(now)))
        p = dict(now[i])
        heat = 1 - k / steps
        if p["geom"] and p["kind"] != BICUBIC:
            p["geom"] = np.clip(np.array(p["geom"]) + rng.normal(0, heat, len(p["geom"])), 0, len(tile) - 1).tolist()
        p["color0"] = np.clip(np.array(p["color0"]) + rng.normal(0, 0.05 * heat, 3), 0, 1).tolist()
        trial = now[:i] + [p] + now[i + 1 :]
        o = objective(tile, trial, lam)
        if o < o_now or rng.random() < np.exp(-(o - o_now) / max(1e-9, 1e-3 * heat)):
            now, o_now = trial, o
        if o < o_best:
            best, o_best = trial, o
    return best
