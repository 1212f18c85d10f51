import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilespark.operators import codec, entropy
from tilespark.operators import primitives as P
from tilespark.sources import container, images

RNG = np.random.default_rng(7)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_range_coder_gives_any_bytes_back(data):
    assert entropy.decode(entropy.encode(data)) == data


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 5000, bytes(range(256)) * 4, b"\0" * 70000 + b"\1"])
def test_range_coder_edges(data):
    blob = entropy.encode(data)
    assert entropy.decode(blob) == data and len(blob) <= len(data) + 5


def test_code_length_is_near_the_model():
    data = RNG.choice([0, 1, 2, 3], 20000, p=[0.7, 0.2, 0.05, 0.05]).astype(np.uint8).tobytes()
    freq = entropy.normalise(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    ideal = -np.log2(freq[np.frombuffer(data, np.uint8)] / entropy.TOTAL).sum() / 8
    assert ideal <= len(entropy.encode(data)) <= ideal * 1.01 + 40


def test_frequencies_sum_up():
    for _ in range(50):
        c = RNG.integers(0, 1000, 256) * (RNG.random(256) < 0.5)
        f = entropy.normalise(c)
        assert f.sum() == entropy.TOTAL and ((f > 0) >= (c > 0)).all()


def test_broken_chunks_are_refused():
    with pytest.raises(ValueError):
        entropy.decode(b"\x09\0\0\0\0")
    with pytest.raises(ValueError):
        entropy.decode(b"\x00\5\0\0\0ab")


def test_container():
    blocks = {"HEAD": b"1234", "DCT": b"x" * 1000, "PAL": RNG.bytes(100)}
    blob = container.write(blocks, {"b": 1, "a": 2})
    back, meta = container.read(blob)
    assert back == blocks and meta["a"] == 2
    assert all(at % container.ALIGN == 0 for _, at, _ in container.directory(blob))
    assert len(blob) < 1000
    for bad in (blob[:5], b"XXXX" + blob[4:], blob[:-1], blob[:4] + b"\x63" + blob[5:]):
        with pytest.raises(ValueError):
            container.read(bad)
    flipped = bytearray(blob)
    flipped[-200] ^= 1
    with pytest.raises(Exception):  # noqa: B017  the checksum, or zstd's own
        container.read(bytes(flipped))


def test_container_rows(spark, tmp_path):
    (tmp_path / "a.tspk").write_bytes(container.write({"HEAD": b"abc"}, {}))
    (tmp_path / "b.tspk").write_bytes(b"junk")
    rows = {(r.path[-6:], r.tag, bytes(r.payload or b"")[:3]) for r in container.blocks(container.files(spark, str(tmp_path))).collect()}
    assert ("a.tspk", "HEAD", b"abc") in rows and ("b.tspk", None, b"") in rows


def test_zstd_look_alike_survives():
    blob = container.write({"HEAD": b"\x28\xb5\x2f\xfdnot a frame"}, {})
    assert container.read(blob)[0]["HEAD"].endswith(b"not a frame")


@pytest.mark.parametrize("quality", [20, 75, 95])
def test_part_codec(quality):
    y, x = np.mgrid[0:8, 0:8] / 7
    tiles = np.concatenate([RNG.normal(0, 0.1, (30, 64)), (0.3 * x - 0.2 * y).reshape(1, -1).repeat(5, axis=0)])
    back = codec.decode_part(codec.encode_part(tiles, quality))
    assert ((tiles - back) ** 2).mean() < 0.02
    assert codec.decode_part(codec.encode_part(np.zeros((0, 64)), quality)).shape == (0, 64)


def test_primitive_wire_is_idempotent():
    prims = [
        {"kind": k, "geom": (RNG.random(n) * (1 if k == P.BICUBIC else 3)).tolist(), "color0": [0.2, 0.4, 0.6], "color1": [0.1, 0.1, 0.9] if k == P.LINEAR else None, "alpha": 0.5} for k, n in P.GEOM.items()
    ]
    blob = P.pack_tile(prims, 8)
    again = P.unpack_tile(blob, 8)
    assert P.pack_tile(again, 8) == blob
    assert np.abs(P.render(prims, 8) - P.render(again, 8)).max() < 0.01
    with pytest.raises(ValueError):
        P.pack({"kind": 1, "geom": [1.0], "color0": [0] * 3, "color1": None, "alpha": 1}, 8)


def test_render_order_and_scale():
    red = {"kind": P.CONST, "geom": [], "color0": [1, 0, 0], "color1": None, "alpha": 1.0}
    half = {"kind": P.CONST, "geom": [], "color0": [0, 0, 1], "color1": None, "alpha": 0.5}
    assert np.allclose(P.render([red, half], 4)[0, 0], [0.5, 0, 0.5])
    assert np.allclose(P.render([half, red], 4)[0, 0], [1, 0, 0])
    assert not P.render([], 4).any()
    assert P.render([red], 4, size=9).shape == (9, 9, 3)
    assert np.allclose(P.render([], 4, bias=[51, 0, 0])[0, 0, 0], 0.2)


def test_greedy_never_worsens_and_finds_a_ramp():
    y, x = np.mgrid[0:8, 0:8] / 7
    tile = np.stack([0.2 + 0.6 * x, 0.5 + 0 * x, 0.8 - 0.6 * x], axis=2)
    prims, trace = P.fit(tile, 1e-4)
    assert (np.diff(trace) < 0).all() and ((P.render(prims, 8) - tile) ** 2).mean() < 0.01
    assert P.fit(tile, 1e-4) == (prims, trace)
    assert P.objective(tile, P.anneal(tile, prims, 1e-4), 1e-4) <= trace[-1]


def test_png_has_a_header():
    assert images.png(np.zeros((3, 5, 3)))[16:24] == b"\0\0\0\5\0\0\0\3"


def test_chunks_side_by_side_are_coded_as_one_by_one(monkeypatch):
    data = [RNG.geometric(p, n).clip(0, 255).astype(np.uint8).tobytes() for p in (0.01, 0.3, 0.9) for n in RNG.integers(1, 900, 150)]
    data += [b"", b"a", b"a" * 5000, bytes(range(256)) * 4, b"\0" * 70000 + b"\1"]
    blobs = [entropy.encode(x) for x in data]
    assert entropy.encode_all(data) == blobs and entropy.decode_all(blobs) == data
    assert entropy.encode_all([]) == entropy.decode_all([]) == []
    with pytest.raises(ValueError):
        entropy.decode_all([*blobs, b"\x09\0\0\0\0"])
    # hundreds of chunks cost as many steps as the longest has symbols, so none of them goes to the one-by-one coder
    many = [x for x, b in zip(data, blobs, strict=True) if b[0] == entropy.CODED and len(x) < 1000][:200]
    monkeypatch.setattr(entropy, "encode", None)
    monkeypatch.setattr(entropy, "decode", None)
    assert len(many) == 200 and entropy.decode_all(entropy.encode_all(many)) == many


def test_patches_are_rendered_in_batches(spark, monkeypatch):
    from tilespark.plans import transforms_q as Q

    class Held:
        def select(self, *_):
            return self

        def mapInArrow(self, run, ddl):
            self.run = run
            return self

    held, k = Held(), np.arange(2500)
    monkeypatch.setattr(Q, "table", lambda *_: held)
    Q.primitive_render(spark, "")
    g, v, a = np.stack([k % 16, k * 3 % 16, k * 5 % 16 + 1, k * 7 % 16 + 2], axis=1).astype(float), k % 9 / 9.0, k % 5 / 5.0
    same = {"color1": [1.0] * 3, "geom": []}
    drawn = [P.render([{**same, "kind": P.CONST, "color0": [c] * 3, "alpha": 1.0}, {**same, "kind": P.LINEAR, "geom": p, "color0": [c] * 3, "alpha": b}], 8)[:, :, 0] for p, c, b in zip(g.tolist(), v, a, strict=True)]
    monkeypatch.setattr(P, "render", None)
    batch = pa.record_batch({"k": k, "v": v, **dict(zip(("x0", "y0", "x1", "y1"), g.T.copy(), strict=True)), "a": a})
    got = pa.Table.from_batches(held.run(iter([batch.slice(0, 0), batch])))
    assert got.column("k").to_pylist() == k.tolist()
    assert np.abs(got.column("m").to_numpy() - [t.mean() for t in drawn]).max() < 1e-12 and np.abs(got.column("t").to_numpy() - [t.max() for t in drawn]).max() < 1e-12
