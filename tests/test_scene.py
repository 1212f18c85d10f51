"""Batched layers against the single-tile renderer, scenes against a whole picture, residual layers, pictures in containers."""

import numpy as np
import pyarrow as pa
import pytest

from tilespark.operators import kernels as K
from tilespark.operators import layers as L
from tilespark.operators import pictures as Pi
from tilespark.operators import primitives as P
from tilespark.operators import residual as R
from tilespark.operators import scene as S
from tilespark.sources import container
from tilespark.sources.container import FormatError

RNG = np.random.default_rng(3)


def primitive(kind, side=8):
    geom = RNG.random(P.GEOM[kind]) * (1 if kind == P.BICUBIC else side)
    return {"kind": int(kind), "geom": geom.tolist(), "color0": RNG.random(3).tolist(), "color1": RNG.random(3).tolist() if kind == P.LINEAR else None, "alpha": float(RNG.random())}


def stacks(n, side=8, kinds=tuple(P.GEOM)):
    return [[primitive(RNG.choice(kinds), side) for _ in range(RNG.integers(0, 5))] for _ in range(n)]


@pytest.mark.parametrize(("side", "pixels"), [(8, 8), (16, 16), (8, 21), (32, 5)])
def test_layers_draw_as_the_renderer_of_one_tile(side, pixels):
    some = stacks(40, side)
    bias = RNG.integers(-20, 20, (40, 3))
    got = L.compose(L.of(some), 40, side, pixels, bias)
    for s, b, g in zip(some, bias, got, strict=True):
        assert np.abs(P.render(s, side, b, pixels).reshape(-1, 3) - g).max() < 1e-12


def test_layers_from_arrow_and_from_lists_are_the_same():
    some = stacks(20)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("geom", pa.list_(pa.float64())), ("color0", pa.list_(pa.float64())), ("color1", pa.list_(pa.float64())), ("alpha", pa.float64())]))
    a, b = L.layers(pa.array([*some, None], kind)), L.of([*some, []])
    assert np.array_equal(L.compose(a, 21, 8, 8), L.compose(b, 21, 8, 8))
    assert L.compose(L.of([]), 0, 8, 8).shape == (0, 64, 3)


def test_weights_of_colours_make_the_picture():
    some = stacks(30, 8, (P.CONST, P.LINEAR, P.LINE, P.CURVE, P.TRIANGLE))
    stack = L.of(some)
    w = L.visibility(stack, 30, 5, 8, 8)
    colours = np.zeros((30, 5, 2, 3))
    colours[stack.tile, stack.place, 0], colours[stack.tile, stack.place, 1] = stack.color0, stack.color1
    assert np.abs(np.einsum("nkp,nkc->npc", w, colours.reshape(30, 10, 3)) - L.compose(stack, 30, 8, 8)).max() < 1e-12
    assert (w >= 0).all() and (w.sum(axis=1) <= 1 + 1e-12).all()


def _seams(img, tile):
    """One seam after another, as a picture in one piece allows it."""
    out = img.copy()
    for x in range(tile, img.shape[1], tile):
        out[:, x - 1] = out[:, x] = (out[:, x - 1] + out[:, x]) / 2
    for y in range(tile, img.shape[0], tile):
        out[y - 1] = out[y] = (out[y - 1] + out[y]) / 2
    return out


LEAF = f"image int, height int, width int, y int, x int, size int, prims array<{P.DDL}>, bias array<int>, grid array<double>"


def whole(df, h, w):
    out = np.full((h, w, 3), np.nan)
    for r in S.pixels(df).collect():
        out[r.y, r.x, r.ch] = r.v
    return out


@pytest.mark.parametrize(("tile", "height", "width"), [(8, 70, 45), (16, 64, 96), (32, 33, 100)])
def test_seams_across_macro_tiles(spark, tile, height, width):
    h, w = -(-height // tile), -(-width // tile)
    some = stacks(h * w, tile)
    grids = RNG.normal(0, 0.1, (h * w, 4, 4, 3))
    rows = [(0, height, width, i, s, [1, -2, 3], g.reshape(-1).tolist()) for i, (s, g) in enumerate(zip(some, grids, strict=True))]
    d = spark.createDataFrame(rows, f"image int, height int, width int, tile int, prims array<{P.DDL}>, bias array<int>, grid array<double>")
    img = np.zeros((h * tile, w * tile, 3))
    for i, (s, g) in enumerate(zip(some, grids, strict=True)):
        t = np.clip(P.render(s, tile, [1, -2, 3]) + L.spread(g[None], tile).reshape(tile, tile, 3), 0, 1)
        img[i // w * tile :, i % w * tile :][:tile, :tile] = t
    img = img[:height, :width]
    assert np.abs(whole(S.uniform(d, tile, smooth=False), height, width) - img).max() < 1e-12
    assert np.abs(whole(S.uniform(d, tile), height, width) - _seams(img, tile)).max() < 1e-12


def test_scenes_take_nulls_and_leaves_outside(spark):
    rows = [(0, 20, 20, 0, 0, 8, None, None, None), (0, 20, 20, 0, 8, 8, [primitive(P.CONST)], [0, None, 5], None), (0, 20, 20, 64, 0, 8, [primitive(P.CONST)], None, None), (None, 8, 8, 0, 0, 8, [], None, None)]
    got = S.macros(spark.createDataFrame(rows, LEAF)).collect()
    assert {(r.image, r.my, r.mx) for r in got} == {(0, 0, 0), (None, 0, 0)}
    assert S.macros(spark.createDataFrame([], LEAF)).count() == 0
    with pytest.raises(ValueError):
        S.smoothed(S.macros(spark.createDataFrame(rows, LEAF)), 12)


def test_scaled_leaves_fill_the_target(spark):
    places = [(0, 0, 32), (0, 32, 16), (0, 48, 16), (16, 32, 16), (16, 48, 8), (16, 56, 8), (24, 48, 8), (24, 56, 8)]
    some = [[primitive(P.CONST, s), primitive(P.LINE, s)] for *_, s in places]
    d = spark.createDataFrame([(0, 32, 64, y, x, s, p, None, None, 50, 99) for (y, x, s), p in zip(places, some, strict=True)], LEAF + ", th int, tw int")
    seen = np.zeros((50, 99), int)
    for r in S.scaled(d, "th", "tw").collect():
        seen[r.y : r.y + r.rows, r.x : r.x + r.cols] += 1
        i = next(i for i, (y, x, _) in enumerate(places) if (round(y * 50 / 32), round(x * 99 / 64)) == (r.y, r.x))
        px = max(r.rows, r.cols)
        assert np.abs(np.array(r.v).reshape(r.rows, r.cols, 3) - P.render(some[i], places[i][2], size=px)[: r.rows, : r.cols]).max() < 1e-12
    assert (seen == 1).all()


@pytest.mark.parametrize("mode", [R.RGB, R.YCC, R.YCC_HALVED])
def test_residual_layers(mode):
    sizes = [8, 32, 16, 8, 16, 32, 8]
    tiles = [RNG.normal(0, 0.1, (s * s, 3)) for s in sizes]
    scales = RNG.uniform(0.25, 4, len(sizes))
    q = [R.encode(t[None], s, mode, 0.01, 0.5, scales[i : i + 1])[0] for i, (t, s) in enumerate(zip(tiles, sizes, strict=True))]
    assert [len(x) for x in q] == [sum(c * c for c in R.channel_sizes(s, mode)) for s in sizes]
    back = R.tile_major(R.band_major(q, sizes, mode), sizes, mode)
    assert all(np.array_equal(a, b) for a, b in zip(q, back, strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(q, R.split_flat(np.concatenate(q), sizes, mode), strict=True))
    for t, s, c, f in zip(tiles, sizes, q, scales, strict=True):
        r = R.decode(c[None], s, mode, 0.01, 0.5, np.array([f]))[0]
        if mode != R.YCC_HALVED:
            assert np.abs(r - t).max() < 0.3 * f
    with pytest.raises(ValueError):
        R.tile_major(np.zeros(5), sizes, mode)
    with pytest.raises(ValueError):
        R.channel_sizes(8, 3)


def test_flat_chroma_survives_halving():
    flat = np.broadcast_to(np.array([0.3, -0.2, 0.1]), (1, 256, 3))
    assert np.abs(R.decode(R.encode(flat, 16, R.YCC_HALVED, 1e-3), 16, R.YCC_HALVED, 1e-3) - flat).max() < 1e-3


def test_residual_rows_keep_what_cannot_be_coded(spark):
    d = spark.createDataFrame([(1, 8, 0, 1.0, None), (2, 8, 0, 1.0, [0.5] * 10), (3, 8, 1, None, [0.25] * 192)], "tile int, size int, mode int, scale double, v array<double>")
    got = {r.tile: r for r in R.coded(d, 0.01).collect()}
    assert got[1].q is None and got[2].mse is None and got[3].mse < 1e-4 and len(got[3].q) == 192


def test_planes_from_gradients():
    p = RNG.random((24, 10))
    gx, gy = np.zeros_like(p), np.zeros_like(p)
    gx[:, :-1], gy[:-1] = np.diff(p, axis=1), np.diff(p, axis=0)
    assert np.abs(Pi.plane(gx, gy, p.mean()) - p).max() < 1e-10
    square = p[:10]
    gx, gy = K.forward(square.reshape(1, -1))
    assert np.abs(Pi.plane(gx.reshape(10, 10), gy.reshape(10, 10), square.mean()).reshape(1, -1) - K.poisson(gx, gy, np.array([square.mean()]))).max() < 1e-10


def test_dispatch_order_and_refusals():
    sizes, places = [16, 8, 8, 8, 8], [(0, 0), (0, 16), (0, 24), (8, 16), (8, 24)]
    some = [stacks(1, s, (P.CONST, P.LINE, P.TRIANGLE, P.CURVE))[0] for s in sizes]
    bias = RNG.integers(-9, 9, (5, 3))
    prim = Pi.stack_blocks(some, sizes, places, bias)
    h, v = Pi.draw({"HEAD": Pi.head(16, 30), **prim})
    assert (h["height"], v.shape) == (16, (16, 30, 3))
    want = np.zeros((16, 32, 3))
    for s, (y, x), n, b in zip(some, places, sizes, bias, strict=True):
        want[y : y + n, x : x + n] = P.render(P.unpack_tile(P.pack_tile(s, n), n), n, b)
    assert np.abs(v - want[:, :30]).max() < 1e-12
    pal = Pi.palette_blocks(np.array([[0, 0, 0], [255, 255, 255]]), np.ones((16, 30), int))
    assert (Pi.draw({"HEAD": Pi.head(16, 30), **prim, **pal})[1] == 1).all()
    rest = Pi.residual_block([np.full((n * n, 3), -0.25) for n in sizes], sizes, R.RGB, 0.001, present=np.array([1, 0, 1, 1, 0]), scales=np.arange(5) * 50, banded=True)
    down = Pi.draw({"HEAD": Pi.head(16, 32), "QTREE": prim["QTREE"], **Pi.palette_blocks(np.array([[128, 128, 128]]), np.zeros((16, 32), int)), **rest})[1]
    assert np.abs(down[:16, :16] - (128 / 255 - 0.25)).max() < 0.01 and np.abs(down[:8, 16:24] - 128 / 255).max() < 1e-9
    for bad in ({**prim}, {"HEAD": Pi.head(16, 30)}, {"HEAD": Pi.head(16, 40), **pal}, {"HEAD": Pi.head(16, 30), **{k: x for k, x in prim.items() if k != "QTREE"}}, {"HEAD": Pi.head(16, 30), **pal, "DCT": rest["DCT"]}):
        with pytest.raises(FormatError):
            Pi.draw(bad)


def test_container_refuses_what_is_incomplete():
    pal = Pi.palette_blocks(np.zeros((1, 3), int), np.zeros((8, 8), int))
    blob = container.write({"HEAD": Pi.head(8, 8), **pal, "LITE": b"x"}, {})
    container.read(blob, complete=True)
    for blocks in ({"HEAD": b"x"}, dict(pal)):
        with pytest.raises(FormatError):
            container.read(container.write(blocks, {}), complete=True)
    other = container.Directory(lambda at, n: blob[at : at + n], len(blob))
    other.features = []
    with pytest.raises(FormatError):
        other.complete()


def test_a_directory_longer_than_the_first_read():
    blocks = {f"B{i:03d}": bytes([i % 256]) * 20 for i in range(400)}
    blob = container.write(blocks, {})
    reads = []

    def fetch(at, n):
        reads.append(n)
        return blob[at : at + n]

    d = container.Directory(fetch, len(blob))
    assert len(d.blocks) == 400 and len(reads) == 2
    assert d.payload(d.blocks[7]) == blocks["B007"] and reads[2] <= 64


def test_residual_samples_made_in_the_task_give_the_same(spark):
    rows = [(i, 8 << i % 3, i // 3 % 3, 0.5 + i % 4 / 2, RNG.normal(0, 0.3, 4).tolist()) for i in range(20)] + [(20, 8, 2, 1.0, None), (21, 8, 0, 1.0, [0.5, 0.25])]
    made = lambda c, s: np.resize(L.ragged(c, 4, np.nan).T, (3 * s * s, len(c))).T.reshape(-1, s * s, 3)
    d = spark.createDataFrame(rows, "tile int, size int, mode int, scale double, e array<double>")
    got = {r.tile: r for r in R.coded(d, 0.01, 0.5, ["q", "mse"], ("e", made)).collect()}
    wide = spark.createDataFrame([(*r[:4], np.resize(r[4], 3 * r[1] ** 2).tolist()) for r in rows[:20]], "tile int, size int, mode int, scale double, v array<double>")
    for r in R.coded(wide, 0.01, 0.5).collect():
        assert got[r.tile].q == r.q and abs(got[r.tile].mse - r.mse) < 1e-12
    assert [(got[i].mse, len(got[i].q), {*got[i].q}) for i in (20, 21)] == [(None, 96, {None}), (None, 192, {None})]
