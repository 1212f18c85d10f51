"""The batched fit against one tile at a time, budgets against a loop, scaling and edges against plain NumPy."""

from itertools import permutations

import numpy as np
import pytest

from tilespark.operators import edges, kernels, primitives as P, refine as Rf, relational, scaling

RNG = np.random.default_rng(5)
SIDE, LAM = 8, 1e-6


def tiles(n):
    out = []
    for _ in range(n):
        lay = [{"kind": P.CONST, "geom": [], "color0": RNG.random(3).tolist(), "color1": None, "alpha": 1.0}, {"kind": P.LINE, "geom": [*(RNG.random(4) * 7), 1.0], "color0": RNG.random(3).tolist(), "color1": None, "alpha": 0.8},
               {"kind": P.TRIANGLE, "geom": (RNG.random(6) * 7).tolist(), "color0": RNG.random(3).tolist(), "color1": None, "alpha": 0.6}]
        out.append(P.render(lay, SIDE).reshape(64, 3))
    return np.clip(np.array(out) + RNG.normal(0, 0.01, (n, 64, 3)), 0, 1)


T = tiles(12)


def test_pool_begins_with_the_candidates_of_one_tile():
    pool = Rf.template_pool(T, SIDE).lists()
    for t, mine in zip(T, pool, strict=True):
        for a, b in zip(P.candidates(t.reshape(8, 8, 3)), mine, strict=False):
            assert a["kind"] == b["kind"] and np.allclose(a["geom"], b["geom"]) and np.allclose(a["color0"], b["color0"]) and (a["color1"] is None or np.allclose(a["color1"], b["color1"]))


def test_objective_is_that_of_the_wire():
    s = Rf.stored(Rf.residual_pool(T, np.zeros_like(T), SIDE).picked(np.tile([0, 5, 9, 13], (12, 1))), SIDE)
    assert np.allclose(Rf.objective(T, s, SIDE, LAM), [P.objective(t.reshape(8, 8, 3), x, LAM) for t, x in zip(T, s.lists(), strict=True)])


def test_a_beam_of_one_is_the_greedy_fit():
    pool = Rf.template_pool(T, SIDE)
    s, after = Rf.beam(T, pool, SIDE, LAM, 1, 5)
    for i, t in enumerate(T):
        tile, cands, prims = t.reshape(8, 8, 3), pool.rows(slice(i, i + 1)).lists()[0], []
        best, used = P.objective(tile, [], LAM), set()
        for _ in range(5):
            scored = [(P.objective(tile, [*prims, c], LAM), j) for j, c in enumerate(cands) if j not in used]
            o, j = min((round(o, 12), j) for o, j in scored)
            if o >= round(best, 12):
                break
            best = o
            used.add(j)
            prims.append(cands[j])
        assert after[i] == pytest.approx(best, abs=1e-9) and int((s.kind[i] >= 0).sum()) == len(prims)


def test_a_wide_beam_finds_the_best_of_a_tiny_pool():
    pool = Rf.template_pool(T[:4], SIDE).picked(np.tile([0, 7, 8, 23], (4, 1)))
    _, after = Rf.beam(T[:4], pool, SIDE, LAM, 1000, 4)
    for i, t in enumerate(T[:4]):
        cands = pool.rows(slice(i, i + 1)).lists()[0]
        every = [P.objective(t.reshape(8, 8, 3), list(order), LAM) for n in range(5) for order in permutations(cands, n)]
        assert after[i] == pytest.approx(min(every), abs=1e-9)
    widths = [Rf.beam(T, Rf.template_pool(T, SIDE), SIDE, LAM, w, 6)[1].mean() for w in (1, 3, 9)]
    assert widths[0] >= widths[1] >= widths[2]


def test_colours_solve_the_normal_equations():
    s = Rf.stored(Rf.template_pool(T, SIDE).picked(np.tile([0, 7, 12, 23], (12, 1))), SIDE)
    got = Rf.solved_colours(T, s, SIDE)
    from tilespark.operators import layers as L

    w = L.visibility(s.layers(), 12, 4, SIDE, SIDE)
    for i in range(12):
        x = np.linalg.lstsq(w[i].T, T[i], rcond=None)[0].reshape(4, 2, 3)
        busy = (w[i].reshape(4, 2, -1) ** 2).sum(axis=2) > 1e-9
        mine = np.stack([got.color0[i], got.color1[i]], axis=1)
        assert np.abs(mine - np.rint(np.clip(x, 0, 1) * 255) / 255)[busy].max() <= 1 / 255 + 1e-9
        assert np.array_equal(got.color1[i][~busy[:, 1]], s.color1[i][~busy[:, 1]])


def test_nothing_rises():
    pool = Rf.template_pool(T, SIDE)
    s, o = Rf.beam(T, pool, SIDE, LAM, 1, 6)
    d, o2 = Rf.without_idle(T, Rf.packed_left(s), SIDE, LAM, o)
    r, o3 = Rf.refined(T, d, SIDE, LAM, passes=2)
    assert (o2 <= o + 1e-12).all() and (o3 <= o2 + 1e-12).all() and o3.mean() < 0.9 * o2.mean()
    assert np.allclose(o3, [P.objective(t.reshape(8, 8, 3), x, LAM) for t, x in zip(T, r.lists(), strict=True)])
    plain = Rf.fit(T, SIDE, 75, LAM, refine=False)[1]
    assert (plain <= o + 1e-12).all() and plain.mean() < o.mean()  # residual candidates help
    assert [int((Rf.fit(T, SIDE, q, LAM)[0].kind >= 0).sum(axis=1).max()) <= Rf.rounds_of(q) for q in (50, 75, 90)] == [True] * 3


def test_single_tiles_fit_as_in_a_batch():
    whole = Rf.fit(T, SIDE, 50, LAM)[1]
    assert np.allclose(whole[:3], np.concatenate([Rf.fit(T[i : i + 1], SIDE, 50, LAM)[1] for i in range(3)]), rtol=1e-6)


def test_windows_sum_what_they_hold():
    e = RNG.random((5, 64))
    at = Rf.windows(8)
    got = Rf.window_sums(Rf.summed_area(e, 8), at)
    for k, (y, x, w) in enumerate(at):
        assert np.allclose(got[:, k], e.reshape(5, 8, 8)[:, y : y + w, x : x + w].sum(axis=(1, 2)))


def shared(weights, caps, target):
    """Shares again and again until nothing exceeds its cap."""
    w, c = np.maximum(np.asarray(weights, float), 1e-9), np.asarray(caps, float)
    target = min(target, c.sum())
    full, out = np.zeros(len(w), bool), np.zeros(len(w))
    while True:
        out = np.where(full, c, 0)
        if (~full).any():
            out[~full] = (target - c[full].sum()) * w[~full] / w[~full].sum()
        over = ~full & (out > c + 1e-12)
        if not over.any():
            return out
        full |= over


@pytest.mark.parametrize("target", [0, 7, 50, 120, 5000])
def test_capped_shares(spark, target):
    rows = [(s, i, None if i % 11 == 0 else float(RNG.random() ** 4), int(RNG.integers(0, 9)), target) for s in ("a", "b", None) for i in range(40)] + [("one", 0, 1.0, 3, target), ("even", 0, 0.0, 10, target), ("even", 1, 0.0, 10, target)]
    got = relational.capped_shares(spark.createDataFrame(rows, "s string, i int, w double, cap int, t int"), "w", "cap", "t", ["s"], ["i"]).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None, "one", "even"):
        mine = sorted((r for r in got if r.s == s), key=lambda r: r.i)
        want = shared([r.w or 0 for r in mine], [r.cap for r in mine], target)
        assert sum(r.share for r in mine) == round(min(target, sum(r.cap for r in mine)))
        assert all(0 <= r.share <= r.cap and abs(r.share - x) < 1 + 1e-6 for r, x in zip(mine, want, strict=True))


@pytest.mark.parametrize(("kind", "h", "w"), [("lanczos", 11, 70), ("lanczos", 40, 9), ("bilinear", 21, 33), ("bilinear", 5, 80)])
def test_resizing_whole_images(spark, kind, h, w):
    images = {i: RNG.random((13 + i, 21 + 20 * i, 2)) for i in range(3)}
    rows = [(i, y, line.reshape(-1).tolist(), h, w) for i, m in images.items() for y, line in enumerate(m)]
    rows += [(7, 0, [1.0, None, 2.0, 3.0], h, w), (8, 1, [1.0, 2.0], h, w), (9, 0, [1.0, 2.0], 0, w)]
    got = {(r.image, r.y): r.v for r in scaling.resized(spark.createDataFrame(rows, "image int, y int, v array<double>, h int, w int"), "h", "w", 2, kind).collect()}
    assert {i for i, _ in got} == {0, 1, 2}
    for i, m in images.items():
        want = np.einsum("ya,abc,xb->yxc", scaling.weights(m.shape[0], h, kind), m, scaling.weights(m.shape[1], w, kind))
        assert np.abs(np.array([got[i, y] for y in range(h)]).reshape(h, w, 2) - want).max() < 1e-9


def test_filters_keep_what_is_flat_and_what_has_its_size():
    for kind in scaling.FILTERS:
        for a, b in ((7, 7), (5, 23), (23, 5), (1, 4), (4, 1)):
            assert np.allclose(scaling.weights(a, b, kind).sum(axis=1), 1)
        assert np.allclose(scaling.weights(9, 9, kind), np.eye(9), atol=1e-12)
    with pytest.raises(ValueError):
        scaling.resized(None, "h", "w", 1, "other")


def test_edges_by_kernel_and_by_table_function(spark):
    ramp = np.tile(np.arange(8) / 7, 8)
    step = (np.mgrid[0:8, 0:8][0] >= 4).astype(float).reshape(-1)
    rows = [(1, ramp.tolist()), (2, step.tolist()), (3, None), (4, [0.5] * 10), (5, [float("nan")] * 64), (6, [0.25] * 64), (7, RNG.random(64).tolist())]
    d = spark.createDataFrame(rows, "tile int, v array<double>")
    by_kernel = sorted(map(repr, edges.candidates(d, ["tile"], "v", 8).collect()))
    edges.register(spark)
    d.createOrReplaceTempView("edge_tiles")
    by_sql = sorted(map(repr, spark.sql("SELECT tile, c.* FROM edge_tiles, LATERAL edge_candidates(v) c").collect()))
    assert by_kernel == by_sql
    got = edges.candidates(d, ["tile"], "v", 8).collect()
    assert {r.tile for r in got} == {1, 2, 7}
    first = next(r for r in got if r.tile == 2 and r.family == "ramp")
    assert first.color0 < first.color1 and abs(first.geom[3] - first.geom[1]) > 3 * abs(first.geom[2] - first.geom[0])  # down the step
    line = next(r for r in got if r.tile == 2 and r.family == "line")
    assert abs(line.geom[1] - line.geom[3]) < 1e-9 or abs(line.geom[0] - line.geom[2]) > 3
    for r in got:
        assert r.ord == 0 or any(q.tile == r.tile and q.ord == r.ord - 1 for q in got)


def test_main_axis_of_points():
    y, x = np.mgrid[0:6, 0:6].reshape(2, -1) + 0.5
    on = np.zeros((2, 36), bool)
    on[0, [0, 7, 14, 21]] = True
    on[1, [2, 8, 14, 20]] = True
    cx, cy, ux, uy, low, high = edges.principal(on, y, x)
    assert np.allclose([ux[0], uy[0]], np.sqrt(0.5)) and abs(ux[1]) < 1e-9 and np.allclose(high - low, [3 * np.sqrt(2), 3])
    assert np.allclose([cx[0], cy[0]], 2)
    assert kernels.half_planes(4).shape == (18, 16)
