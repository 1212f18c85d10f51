"""Image files in and out: scan, tiles at the edge, containers and back."""

import zlib

import numpy as np
import pytest

from tilespark import api, cli
from tilespark.sources import images


def _samples(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x / w, y / h, (x + y) / (h + w)], axis=2)


def _bytes(png):
    """Pixels of a PNG as png() writes it: one IDAT, no filter."""
    w, h = int.from_bytes(png[16:20], "big"), int.from_bytes(png[20:24], "big")
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])
    return np.frombuffer(raw, np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    (d / "a").mkdir()
    (d / "b").mkdir()
    (d / "a" / "x.png").write_bytes(images.png(_samples(21, 13)))
    (d / "b" / "x.png").write_bytes(images.png(_samples(16, 24)))
    (d / "b" / "bad.png").write_bytes(b"no picture")
    return d


def test_pixels_are_those_of_the_file(spark, folder):
    got = {(r.image.rsplit("/", 2)[1], r.ch, r.y, r.x): r.v for r in images.pixels(spark, str(folder)).collect()}
    assert len(got) == 3 * (21 * 13 + 16 * 24)
    for name in "ab":
        s = _bytes((folder / name / "x.png").read_bytes()) / 255
        want = np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)
        assert max(abs(got[name, c, y, x] - want[y, x, c]) for y in range(want.shape[0]) for x in range(want.shape[1]) for c in range(3)) < 1e-12


def test_broken_files_are_named(spark, folder):
    assert [r.image.rsplit("/", 1)[1] for r in images.invalid(spark, str(folder)).collect()] == ["bad.png"]
    assert images.discover(spark, str(folder)).count() == 3


def test_tiles_repeat_the_edge(spark, folder):
    t = {(r.ch, r.tile): np.array(r.v).reshape(8, 8) for r in images.tiles(spark, str(folder / "a")).collect()}
    assert sorted(t) == [(c, i) for c in range(3) for i in range(6)]
    assert (t[0, 1][:, 5:] == t[0, 1][:, 4:5]).all() and (t[1, 5][5:] == t[1, 5][4]).all()


def test_files_to_containers_and_back(spark, folder, tmp_path):
    assert cli.main(["encode", str(folder), str(tmp_path / "c"), "--quality", "95"]) == 0
    parts = spark.read.parquet(str(tmp_path / "c"))
    assert parts.count() == 6
    out = tmp_path / "out"
    assert cli.main(["decode", str(tmp_path / "c"), str(out)]) == 0
    shapes = {}
    for f in out.iterdir():
        back = _bytes(f.read_bytes())
        shapes[back.shape[:2]] = back
    assert sorted(shapes) == [(16, 24), (21, 13)] and len(list(out.iterdir())) == 2
    for name, size in (("a", (21, 13)), ("b", (16, 24))):
        want = _bytes((folder / name / "x.png").read_bytes()).astype(int)
        assert np.abs(shapes[size] - want).mean() < 4


def test_a_lost_part_gives_no_picture(spark, folder):
    from tilespark.operators import codec

    parts = api.encode_files(spark, str(folder / "a")).filter("ch <> 1")
    assert [r.png for r in codec.restore_images(parts).collect()] == [None]


# pictures by the encoder that suits them


@pytest.mark.parametrize("basis", ["bicubic", "palette", "gradient", "stacks", "bicubic-dct", "stacks-dct", "auto"])
def test_every_encoder_makes_what_a_reader_draws(basis):
    from tilespark.operators import encoder
    from tilespark.operators import pictures as Pi

    rgb = _samples(37, 50) * 0.8
    rgb[10:20, 12:30] = [0.9, 0.1, 0.2]
    name, blocks, mse, bits = encoder.encode_part(rgb, 75, basis, 128, 256)
    head, back = Pi.draw(blocks)
    assert (head["y"], head["x"], back.shape) == (128, 256, rgb.shape) and mse == pytest.approx(((back - rgb) ** 2).mean()) and bits > 0
    assert mse < (0.02 if name in ("bicubic", "gradient", "stacks") else 2e-3)
    if basis == "auto":
        costs = {n: encoder.encode_part(rgb, 75, n)[2:] for n in encoder.ENCODERS}
        lam = 0.26**2 * 1e-3 / 35
        assert name == min(costs, key=lambda n: costs[n][0] + lam * costs[n][1])
    else:
        assert name == basis


def test_pictures_to_container_files_and_back(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "wide.png").write_bytes(images.png(_samples(20, 150)))
    (tmp_path / "in" / "bad.png").write_bytes(b"no picture")
    told = api.encode_pictures(spark, str(tmp_path / "in"), str(tmp_path / "c"), 90).collect()
    assert sorted((r.y, r.x) for r in told) == [(0, 0), (0, 128)] and all(r.error is None and r.mse < 1e-3 for r in told)
    assert [r.bytes > 0 for r in api.decode_pictures(spark, str(tmp_path / "c"), str(tmp_path / "out")).collect()] == [True]
    (made,) = (tmp_path / "out").iterdir()
    a, b = _bytes(made.read_bytes()).astype(int), _bytes((tmp_path / "in" / "wide.png").read_bytes()).astype(int)
    assert a.shape == b.shape and np.abs(a - b).mean() < 4
    one = next((tmp_path / "c").rglob("*-0-1.tspk"))
    one.unlink()
    from tilespark.operators import encoder
    from tilespark.sources import tile_files

    (lost,) = encoder.restored(tile_files.load(spark, str(tmp_path / "c"))).collect()
    assert lost.png is None and lost.error == "a part is missing"
    with pytest.raises(ValueError):
        api.encode_pictures(spark, str(tmp_path / "in"), str(tmp_path / "d"), 90, "other")


def test_parts_without_samples_are_rows(spark):
    from tilespark.operators import encoder

    rows = [("a", 8, 8, c, 0, [0.5] * 64) for c in range(3)] + [("b", 8, 8, c, 0, [0.5] * 64) for c in range(2)] + [("c", 8, 8, c, 0, None) for c in range(3)]
    got = {r.image: r for r in encoder.encode(spark.createDataFrame(rows, "image string, height int, width int, ch int, tile long, v array<double>"), 75, "palette").collect()}
    assert got["a"].error is None and got["a"].mse < 1e-5 and got["b"].error == "samples are missing" and got["c"].error == "a tile of another size"


def test_experiment_command(spark, folder, tmp_path, capsys):
    (tmp_path / "s.json").write_text('{"axes": {"quality": [50, 90], "basis": ["bicubic", "palette"]}, "name_template": "{basis}-{quality}"}')
    assert cli.main(["experiment", str(folder / "a"), str(tmp_path / "out"), "--sweep", str(tmp_path / "s.json")]) == 0
    assert "palette-90" in capsys.readouterr().out
    facts = spark.read.option("header", "true").csv(str(tmp_path / "out" / "facts")).collect()
    assert {r.profile for r in facts} == {"bicubic-50", "bicubic-90", "palette-50", "palette-90"} and all(float(r.psnr) > 15 for r in facts)
