"""Fitting stacks of primitives to many tiles at once: pools, beams, least-squares colours and pattern search.

All functions take tiles as n x side^2 x 3 samples and work on padded arrays, so a step of the search is a few products over a batch of tiles. Primitives count as they are read back from
the wire, and the objective is the mean squared error plus lam for each bit. Nothing here lets an objective rise.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

from tilespark.operators import layers as L
from tilespark.operators import primitives as P

#: Bytes of a primitive on the wire, by kind.
BYTES = np.array([len(P.pack({"kind": k, "geom": [0.0] * n, "color0": [0.0] * 3, "color1": [0.0] * 3, "alpha": 1.0}, 8)) for k, n in P.GEOM.items()])
GEOM = max(n for k, n in P.GEOM.items() if k != P.BICUBIC)
#: Tried in turn by the refinement: shares of the mean error, changes of alpha, of coordinates (in pixels) and of thickness.
NUDGES, ALPHAS, MOVES, WIDTHS = (0.3, 0.6, 1.0, -0.3), (-0.15, -0.1, -0.05, 0.05, 0.1, 0.15, 0.25), (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0), (-0.3, -0.15, 0.15, 0.3)


def rounds_of(quality: int) -> int:
    """Greedy rounds (fixed values)."""
    return 20 if quality >= 90 else 8 if quality >= 70 else 4


#: Times that a stalled fit gets new candidates (fixed value).
RESEEDS = 3


@dataclass
class Set:
    """k primitives of each of n tiles, as arrays; kind -1: none."""

    kind: np.ndarray
    geom: np.ndarray
    color0: np.ndarray
    color1: np.ndarray
    alpha: np.ndarray

    @classmethod
    def empty(cls, n: int, k: int) -> Set:
        return cls(np.full((n, k), -1), np.zeros((n, k, GEOM)), np.zeros((n, k, 3)), np.zeros((n, k, 3)), np.zeros((n, k)))

    @classmethod
    def joined(cls, sets: list[Set]) -> Set:
        return cls(*(np.concatenate([getattr(s, f.name) for s in sets], axis=1) for f in fields(cls)))

    def rows(self, at) -> Set:
        return Set(*(getattr(self, f.name)[at] for f in fields(self)))

    def picked(self, index: np.ndarray) -> Set:
        """The primitives at index (n x m; -1: none)."""
        at = np.maximum(index, 0)
        row = np.arange(len(index))[:, None]
        out = Set(*(getattr(self, f.name)[row, at] for f in fields(self)))
        out.kind = np.where(index >= 0, out.kind, -1)
        return out

    def layers(self) -> L.Layers:
        t, k = np.nonzero(self.kind >= 0)
        return L.Layers(t, k, *(getattr(self, f.name)[t, k] for f in fields(self)))

    def bits(self) -> np.ndarray:
        return 8 + 8 * np.where(self.kind >= 0, BYTES[self.kind], 0).sum(axis=1)

    def lists(self) -> list[list[dict]]:
        out = []
        for i in range(len(self.kind)):
            row = []
            for j in np.flatnonzero(self.kind[i] >= 0):
                k = int(self.kind[i, j])
                row.append({"kind": k, "geom": self.geom[i, j, : P.GEOM[k]].tolist(), "color0": self.color0[i, j].tolist(), "color1": self.color1[i, j].tolist() if k == P.LINEAR else None, "alpha": float(self.alpha[i, j])})
            out.append(row)
        return out


def from_lists(stacks: list[list[dict]], depth: int | None = None) -> Set:
    depth = depth or max([1, *map(len, stacks)])
    out = Set.empty(len(stacks), depth)
    for i, s in enumerate(stacks):
        for j, p in enumerate(s):
            g = p["geom"] or ()
            out.kind[i, j], out.alpha[i, j], out.color0[i, j], out.color1[i, j] = p["kind"], p["alpha"], p["color0"], p["color1"] or p["color0"]
            out.geom[i, j, : len(g)] = g
    return out


def stored(s: Set, side: int) -> Set:
    """As the wire gives them back."""
    geom = s.geom.copy()
    thick = np.zeros(geom.shape, bool)
    thick[..., 4] |= s.kind == P.LINE
    thick[..., 6] |= s.kind == P.CURVE
    top = np.where(thick, P.THICK, side - 1.0)
    geom = np.rint(np.clip(geom / top, 0, 1) * 65535) / 65535 * top
    byte = lambda c: np.rint(np.clip(c, 0, 1) * 255) / 255
    return Set(s.kind, geom, byte(s.color0), byte(s.color1), np.rint(np.clip(s.alpha, 0, 1) * 65535) / 65535)


def _drawn(s: Set, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Alpha (n x k x pixels) and colour times alpha (.. x 3) of every primitive alone; nothing where there is none."""
    n, k = s.kind.shape
    a, u = np.zeros((n, k, side * side)), np.zeros((n, k, side * side, 3))
    for kind in np.unique(s.kind[s.kind >= 0]):
        t, j = np.nonzero(s.kind == kind)
        cover, share = L.coverage(int(kind), s.geom[t, j], s.alpha[t, j], side, side)
        c0, c1 = s.color0[t, j][:, None, :], s.color1[t, j][:, None, :]
        a[t, j] = cover
        u[t, j] = cover[..., None] * (c0 if share is None else c0 * (1 - share[..., None]) + c1 * share[..., None])
    return a, u


def objective(tiles: np.ndarray, s: Set, side: int, lam: float) -> np.ndarray:
    back = L.compose(s.layers(), len(tiles), side, side)
    return ((back - tiles) ** 2).mean(axis=(1, 2)) + lam * s.bits()


def beam(tiles: np.ndarray, pool: Set, side: int, lam: float, width: int, rounds: int, start: Set | None = None, most: int | None = None) -> tuple[Set, np.ndarray]:
    """The best stack that a beam of width finds by laying pool primitives (each once) over start, of most primitives at most, and its objective. All states of all tiles meet all candidates in one product a round:
    |s(1-a) + u - t|^2 is s^2 (1-a)^2 + 2 s (1-a)(u-t) + (u-t)^2. Ties go to shorter stacks, then to better ranked states, then to the pool's order; with width 1 this is the
    greedy fit."""
    n, c = pool.kind.shape
    pool = stored(pool, side)
    start = Set.empty(n, 0) if start is None else start
    pixels = side * side * 3
    a, u = _drawn(pool, side)
    rest = np.repeat((1 - a)[..., None], 3, axis=3).reshape(n, c, pixels)
    off = u.reshape(n, c, pixels) - tiles.reshape(n, 1, pixels)
    square, cross, alone = rest**2, 2 * rest * off, (off**2).sum(axis=2)
    price = np.where(pool.kind >= 0, 8.0 * BYTES[pool.kind], np.inf)
    state = L.compose(start.layers(), n, side, side).reshape(n, 1, pixels)
    bits = start.bits()[:, None].astype(float)
    score = np.round(((state - tiles.reshape(n, 1, pixels)) ** 2).mean(axis=2) + lam * bits, 12)
    used, path = np.zeros((n, 1, c), bool), np.full((n, 1, rounds), -1)
    row = np.arange(n)[:, None]
    held = (start.kind >= 0).sum(axis=1)[:, None]
    for r in range(rounds):
        b = state.shape[1]
        error = (state**2 @ square.transpose(0, 2, 1) + state @ cross.transpose(0, 2, 1) + alone[:, None, :]) / pixels
        grown = np.round(error + lam * (bits[:, :, None] + price[:, None, :]), 12)
        # a state that was not prolonged in the last round has had its chance: only its own score stays
        shut = ~np.isfinite(score) if not r else ~np.isfinite(score) | (path[:, :, r - 1] < 0)
        if most is not None:
            shut |= held + (path >= 0).sum(axis=2) >= most
        grown = np.where(used | shut[:, :, None] | ~np.isfinite(price)[:, None, :], np.inf, grown)
        every = np.concatenate([score, grown.reshape(n, b * c)], axis=1)
        best = np.argsort(every, axis=1, kind="stable")[:, :width]
        kept, of = best < b, np.where(best < b, best, (best - b) // c)
        cand = np.where(kept, -1, (best - b) % c)
        if kept.all():
            break
        score = every[row, best]
        chosen = np.maximum(cand, 0)
        laid = state[row, of] * rest[row, chosen] + u.reshape(n, c, pixels)[row, chosen]
        state = np.where(kept[..., None], state[row, of], laid)
        bits = bits[row, of] + np.where(kept | ~np.isfinite(score), 0, price[row, chosen])
        used, path = used[row, of].copy(), path[row, of].copy()
        used[row, np.arange(best.shape[1])[None, :], chosen] |= ~kept
        path[:, :, r] = cand
    lead = Set.joined([start, pool.picked(path[:, 0])])
    return lead, objective(tiles, lead, side, lam)


def packed_left(s: Set) -> Set:
    """The same stacks without holes, as deep as the deepest."""
    by = np.argsort(s.kind < 0, axis=1, kind="stable")
    depth = max(1, int((s.kind >= 0).sum(axis=1).max())) if len(s.kind) else 1
    return s.picked(by[:, :depth])


def _better(now: Set, trial: Set, was: np.ndarray, new: np.ndarray) -> tuple[Set, np.ndarray]:
    wins = new < was - 1e-12
    pick = lambda x, y: np.where(wins.reshape(-1, *[1] * (x.ndim - 1)), y, x)
    return Set(*(pick(getattr(now, f.name), getattr(trial, f.name)) for f in fields(now))), np.where(wins, new, was)


def without_idle(tiles: np.ndarray, s: Set, side: int, lam: float, was: np.ndarray) -> tuple[Set, np.ndarray]:
    """Drops what isn't worth its bits, the top layer first."""
    for j in reversed(range(s.kind.shape[1])):
        trial = Set(*(getattr(s, f.name).copy() for f in fields(s)))
        trial.kind[:, j] = -1
        s, was = _better(s, trial, was, objective(tiles, trial, side, lam))
    return packed_left(s), was


def solved_colours(tiles: np.ndarray, s: Set, side: int) -> Set:
    """The colours that fit best at fixed geometry and alpha: normal equations from what each colour weighs in each pixel, solved for all tiles at once, then clipped and stored. Colours
    that weigh nothing stay."""
    n, k = s.kind.shape
    w = L.visibility(s.layers(), n, k, side, side)
    a = w @ w.transpose(0, 2, 1)
    idle = np.einsum("nii->ni", a) < 1e-9
    solved = np.linalg.pinv(a, hermitian=True) @ (w @ tiles)
    solved = solved.reshape(n, k, 2, 3)
    idle = idle.reshape(n, k, 2, 1)
    return stored(Set(s.kind, s.geom, np.where(idle[:, :, 0], s.color0, solved[:, :, 0]), np.where(idle[:, :, 1], s.color1, solved[:, :, 1]), s.alpha), side)


class _Around:
    """All layers but one: what lies under it, what lies over it and how much that lets through. A trial for the layer costs its own coverage only."""

    def __init__(self, tiles: np.ndarray, s: Set, j: int, side: int):
        a, u = _drawn(s, side)
        n = len(tiles)
        self.tiles, self.side = tiles, side
        self.below, self.over, self.through = np.zeros((n, side * side, 3)), np.zeros((n, side * side, 3)), np.ones((n, side * side, 1))
        for i in range(j):
            self.below = u[:, i] + self.below * (1 - a[:, i, :, None])
        for i in range(j + 1, s.kind.shape[1]):
            self.over = u[:, i] + self.over * (1 - a[:, i, :, None])
            self.through = self.through * (1 - a[:, i, :, None])

    def error(self, one: Set) -> tuple[np.ndarray, np.ndarray]:
        a, u = _drawn(one, self.side)
        back = self.over + self.through * (u[:, 0] + self.below * (1 - a[:, 0, :, None]))
        return ((back - self.tiles) ** 2).mean(axis=(1, 2)), (self.tiles - back).mean(axis=1)


def _only(s: Set, j: int) -> Set:
    return Set(*(getattr(s, f.name)[:, j : j + 1].copy() for f in fields(s)))


def _put(s: Set, j: int, one: Set) -> None:
    for f in fields(s):
        getattr(s, f.name)[:, j] = getattr(one, f.name)[:, 0]


def refined(tiles: np.ndarray, s: Set, side: int, lam: float, passes: int = 1) -> tuple[Set, np.ndarray]:
    """Least-squares colours, then for each layer steps of its colour along the mean error, of its alpha, and of each coordinate and thickness; a step is taken where it helps."""
    s = stored(s, side)
    was = objective(tiles, s, side, lam)
    for _ in range(passes):
        trial = solved_colours(tiles, s, side)
        s, was = _better(s, trial, was, objective(tiles, trial, side, lam))
        for j in range(s.kind.shape[1]):
            around, one = _Around(tiles, s, j, side), _only(s, j)
            price = lam * s.bits()

            def attempt(change, around=around, price=price):
                nonlocal one, was, mean
                trial = Set(*(getattr(one, f.name).copy() for f in fields(one)))
                change(trial)
                trial = stored(trial, side)
                error, off = around.error(trial)
                wins = error + price < was - 1e-12
                mean = np.where(wins[:, None], off, mean)
                one, was = _better(one, trial, was, error + price)

            mean = around.error(one)[1]
            for share in NUDGES:
                attempt(lambda t, share=share: t.color0.__iadd__(share * mean[:, None, :]))
            for step in ALPHAS:
                attempt(lambda t, step=step: t.alpha.__setitem__(slice(None), np.clip(t.alpha + step, 0.01, 1)))
            for g in range(GEOM):
                thick = ((one.kind == P.LINE) & (g == 4) | (one.kind == P.CURVE) & (g == 6))[:, 0]
                has = np.array([P.GEOM.get(int(k), 0) > g for k in one.kind[:, 0]])
                if not has.any():
                    break
                for kind_of, steps in ((has & ~thick, MOVES), (has & thick, WIDTHS)):
                    for step in steps if kind_of.any() else ():
                        attempt(lambda t, step=step, on=kind_of, g=g: t.geom.__setitem__((on, 0, g), t.geom[on, 0, g] + step))
            _put(s, j, one)
    return s, objective(tiles, s, side, lam)


def template_pool(tiles: np.ndarray, side: int) -> Set:
    """For all tiles what ``primitives.candidates`` gives for one, in its order (constants, ramps and lines in eight directions, triangles), then arcs and the means of sixteen cells."""
    n = len(tiles)
    y, x = (v[0] for v in L.centres(side, side))
    sets: list[Set] = []

    def put(kind, geom, c0, c1=None, alpha=1.0):
        one = Set.empty(n, 1)
        one.kind[:], one.alpha[:] = kind, alpha
        one.geom[:, 0, : len(geom)] = geom
        one.color0[:, 0], one.color1[:, 0] = c0, c0 if c1 is None else c1
        sets.append(one)

    mean_of = lambda mask: tiles[:, mask].mean(axis=1)
    put(P.CONST, (), tiles.mean(axis=1))
    put(P.CONST, (), np.median(tiles, axis=1))
    h = side // 2
    for top in (True, False):
        for left in (True, False):
            put(P.CONST, (), mean_of(((y < h) == top) & ((x < h) == left)))
    m = (side - 1) / 2
    for i in range(8):
        dx, dy = np.cos(np.pi * i / 8) * m, np.sin(np.pi * i / 8) * m
        g = [m - dx, m - dy, m + dx, m + dy]
        t = np.clip(((x - g[0]) * 2 * dx + (y - g[1]) * 2 * dy) / (4 * m * m), 0, 1)
        c = np.linalg.pinv(np.stack([1 - t, t], axis=1)) @ tiles
        put(P.LINEAR, g, np.clip(c[:, 0], 0, 1), np.clip(c[:, 1], 0, 1))
        put(P.LINE, [*g, 1.0], mean_of(P.segment_distance(x, y, *g) < 1.5))
    e = side - 1.0
    for g in ([0, 0, e, 0, 0, e], [e, e, e, 0, 0, e], [0, 0, e, 0, e, e], [0, 0, 0, e, e, e], [0, e, e, e, m, 0], [0, 0, e, 0, m, e]):
        put(P.TRIANGLE, g, mean_of(P.inside(x, y, g)))
    for g in ([0, m, m, 0, e, m], [0, m, m, e, e, m], [m, 0, 0, m, m, e], [m, 0, e, m, m, e]):
        put(P.CURVE, [*g, 1.0], mean_of(P.curve_distance(x, y, g[:2], g[2:4], g[4:6]) < 1.5))
    q = side / 4
    for i in range(4):
        for j in range(4):
            put(P.CONST, (), mean_of((y // q == i) & (x // q == j)), alpha=0.3)
    return Set.joined(sets)


def summed_area(error: np.ndarray, side: int) -> np.ndarray:
    """n x (side + 1)^2: sums of everything above and to the left."""
    out = np.zeros((len(error), side + 1, side + 1))
    out[:, 1:, 1:] = error.reshape(-1, side, side).cumsum(axis=1).cumsum(axis=2)
    return out


def windows(side: int) -> np.ndarray:
    """y, x and size of the windows that are looked at: halves and quarters of a tile, each overlapping the next by half."""
    return np.array([(y, x, w) for w in (side // 2, side // 4) for y in range(0, side - w + 1, max(1, w // 2)) for x in range(0, side - w + 1, max(1, w // 2))])


def window_sums(area: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n x windows, by four lookups each."""
    y, x, w = at.T
    return area[:, y + w, x + w] - area[:, y, x + w] - area[:, y + w, x] + area[:, y, x]


def residual_pool(tiles: np.ndarray, back: np.ndarray, side: int, top: int = 3) -> Set:
    """Candidates where a fit is worst: constants of the colour that is missing, ramps along and across the error's slope, lines through its middle, an arc over it, and
    for the top windows of the error (by sums out of a summed-area table) two triangles and two lines each."""
    n = len(tiles)
    size = np.abs(tiles - back).mean(axis=2)
    high = size >= np.percentile(size, 60, axis=1)[:, None]
    weight = high / np.maximum(1, high.sum(axis=1))[:, None]
    colour = np.einsum("np,npc->nc", weight, tiles)
    y, x = (v[0] for v in L.centres(side, side))
    sets: list[Set] = []

    def put(kind, geom, c0, c1=None, alphas=(1.0,)):
        for a in alphas:
            one = Set.empty(n, 1)
            one.kind[:], one.alpha[:] = kind, a
            if len(geom):
                g = np.stack([np.broadcast_to(v, n) for v in geom], axis=1)
                one.geom[:, 0, : g.shape[1]] = np.clip(g, 0, side - 1)
            one.color0[:, 0], one.color1[:, 0] = c0, c0 if c1 is None else c1
            sets.append(one)

    put(P.CONST, (), colour, alphas=(0.6, 0.3, 0.12))
    gy, gx = np.gradient(size.reshape(n, side, side), axis=(1, 2))
    vx, vy = gx.mean(axis=(1, 2)), gy.mean(axis=(1, 2))
    norm = np.hypot(vx, vy) + 1e-8
    m, reach = (side - 1) / 2, (side - 1) * 0.6
    for ux, uy in ((vx / norm, vy / norm), (-vy / norm, vx / norm)):
        ahead = ((x[None] - m) * ux[:, None] + (y[None] - m) * uy[:, None]) >= 0
        side_mean = lambda on: np.einsum("np,npc->nc", on / np.maximum(1, on.sum(axis=1))[:, None], tiles)
        put(P.LINEAR, (m - ux * reach, m - uy * reach, m + ux * reach, m + uy * reach), side_mean(~ahead), side_mean(ahead), (0.5, 0.25))
    cx, cy = (weight * x).sum(axis=1), (weight * y).sum(axis=1)
    e = side - 1.0
    for thick in (0.5, 1.0, 2.0):
        put(P.LINE, (cx, 0.0, cx, e, thick), colour, alphas=(0.4,))
        put(P.LINE, (0.0, cy, e, cy, thick), colour, alphas=(0.4,))
    put(P.LINE, (0.0, 0.0, e, e, 1.0), colour, alphas=(0.25,))
    put(P.LINE, (0.0, e, e, 0.0, 1.0), colour, alphas=(0.25,))
    left, right = np.where(high, x, np.inf).argmin(axis=1), np.where(high, x, -np.inf).argmax(axis=1)
    put(P.CURVE, (x[left], y[left], 2 * cx - (x[left] + x[right]) / 2, 2 * cy - (y[left] + y[right]) / 2, x[right], y[right], 1.0), colour, alphas=(0.3,))
    at = windows(side)
    sums = window_sums(summed_area(size, side), at) / at[:, 2] ** 2
    best = np.argsort(-sums, axis=1, kind="stable")[:, :top]
    areas = [summed_area(tiles[:, :, c], side) for c in range(3)]
    row = np.arange(n)
    for r in range(top):
        w = at[best[:, r]]
        here = np.stack([(s[row, w[:, 0] + w[:, 2], w[:, 1] + w[:, 2]] - s[row, w[:, 0], w[:, 1] + w[:, 2]] - s[row, w[:, 0] + w[:, 2], w[:, 1]] + s[row, w[:, 0], w[:, 1]]) / w[:, 2] ** 2 for s in areas], axis=1)
        y0, x0, y1, x1 = (v.astype(float) for v in (w[:, 0], w[:, 1], w[:, 0] + w[:, 2], w[:, 1] + w[:, 2]))
        put(P.TRIANGLE, (x0, y0, x1, y0, x0, y1), here, alphas=(0.5,))
        put(P.TRIANGLE, (x1, y1, x1, y0, x0, y1), here, alphas=(0.5,))
        put(P.LINE, ((x0 + x1) / 2, y0, (x0 + x1) / 2, y1, w[:, 2] / 4), here, alphas=(0.5,))
        put(P.LINE, (x0, (y0 + y1) / 2, x1, (y0 + y1) / 2, w[:, 2] / 4), here, alphas=(0.5,))
    return Set.joined(sets)


def fit(tiles: np.ndarray, side: int, quality: int, lam: float, width: int = 1, refine: bool = True) -> tuple[Set, np.ndarray]:
    """The whole fit of a batch: rounds of the beam over the template pool, up to RESEEDS pools of residual candidates where rounds are left, idle layers dropped, then the refinement."""
    most = rounds_of(quality)
    s, was = beam(tiles, template_pool(tiles, side), side, lam, width, most, most=most)
    for _ in range(RESEEDS):
        s = packed_left(s)
        back = L.compose(s.layers(), len(tiles), side, side)
        more, new = beam(tiles, residual_pool(tiles, back, side), side, lam, width, most, s, most)
        stay = Set.joined([s, Set.empty(len(tiles), more.kind.shape[1] - s.kind.shape[1])])
        s, was = _better(stay, more, was, new)
    s, was = without_idle(tiles, packed_left(s), side, lam, was)
    return refined(tiles, s, side, lam) if refine else (s, was)
