"""Fits that are kept, sweeps and packs with errors as rows, the suite with its hybrid."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark import api
from tilespark.operators import fits, refine, registry, sweeps
from tilespark.plans.tiles_q import embeddings
from tilespark.sources import sweep_files

RNG = np.random.default_rng(9)


def colour_tiles(spark, n, first=0, extra=()):
    rows = [(i, RNG.random(192).tolist()) for i in range(first, first + n)] + list(extra)
    return spark.createDataFrame(rows, "tile int, v array<double>"), rows


def test_a_second_run_fits_nothing(spark, tmp_path):
    cache, of = str(tmp_path / "fits"), fits.settings(50)
    d, rows = colour_tiles(spark, 6, extra=[(90, None), (91, [0.5] * 10), (92, [float("nan")] * 192)])
    d = d.unionByName(d.filter("tile < 2").withColumn("tile", F.col("tile") + 50))  # the same content under other names
    first, made = fits.fitted(d, of, cache)
    a = {r.tile: r for r in first.collect()}
    assert made == 6 and len(a) == 11 and a[50].prims == a[0].prims and all(a[k].prims is None for k in (90, 91, 92))
    second, made = fits.fitted(d, of, cache)
    assert made == 0 and list(map(repr, sorted(second.collect(), key=lambda r: r.tile))) == [repr(a[k]) for k in sorted(a)] and len(fits.runs(spark, cache)) == 1
    v = np.array([r[1] for r in rows[:6]]).reshape(6, 64, 3)
    assert np.allclose([a[i].after for i in range(6)], refine.fit(v, 8, 50, 1e-6, 1, False)[1])
    more, _ = colour_tiles(spark, 2, first=200)
    assert fits.fitted(d.filter("tile < 3").unionByName(more), of, cache)[1] == 2
    assert fits.fitted(d.filter("tile < 3"), fits.settings(95), cache)[1] == 3  # other settings, other fits
    assert len(fits.runs(spark, cache)) == 3
    keep = fits.keyed(d.filter("tile = 0"), of)
    fits.tidy(spark, cache, keep)
    assert len(fits.runs(spark, cache)) == 1 and fits.read(spark, cache).count() == 1


def test_an_unpublished_or_broken_run_counts_as_missing(spark, tmp_path):
    cache = str(tmp_path / "fits")
    d, _ = colour_tiles(spark, 2)
    assert fits.fitted(d, fits.settings(50), cache)[1] == 2
    (tmp_path / "fits" / "_half").mkdir()
    (tmp_path / "fits" / "_half" / "part.parquet").write_bytes(b"half")
    (tmp_path / "fits" / "run-empty").mkdir()
    assert fits.read(spark, cache).count() == 2 and fits.fitted(d, fits.settings(50), cache)[1] == 0


def test_variants_share_their_fit(spark, tmp_path):
    tiles = embeddings(spark, "/root/testdata/sf0.001").filter("image < 4")
    got, made = registry.compete_shared(tiles, str(tmp_path / "f"))
    rows = got.collect()
    assert made == tiles.count() and len(rows) == 16 and sum(r.won for r in rows) == 4
    by = {(r.image, r.variant): r for r in rows}
    for i in range(4):
        assert by[i, "hybrid-dct-tight"].mse <= by[i, "hybrid-dct"].mse <= by[i, "hybrid"].mse + 1e-12
        assert by[i, "hybrid"].bits < by[i, "hybrid-dct"].bits < by[i, "hybrid-dct-tight"].bits
    again, made = registry.compete_shared(tiles, str(tmp_path / "f"))
    assert made == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_broken_cells_are_rows(spark):
    tiles = spark.createDataFrame([(1, [float(i) / 64 for i in range(64)]), (1, [0.1] * 64), (2, [0.2] * 64), (2, None), (3, [0.2, None] + [0.0] * 62), (None, [0.3] * 64)], "image int, v array<double>").repartition(3)

    def evaluate(v, cell):
        if cell["variant"] == "fails":
            raise RuntimeError("no luck")
        return registry.of_cell(v, cell)

    cells = spark.createDataFrame([("dct", 75), ("fails", 75), ("nobody", 75), ("dct", None), ("two-tone", 10)], "variant string, quality int")
    got = {(r.variant, r.quality, r.image): r for r in sweeps.evaluated(tiles, cells, evaluate).collect()}
    assert len(got) == 20 and {r.tiles for (_, _, i), r in got.items() if i in (1, 2)} == {2}
    assert got["dct", 75, 1].mse < 1e-3 and got["dct", 75, 1].error is None and got["dct", 75, None].error is None
    assert got["fails", 75, 1].error == "RuntimeError: no luck" and got["nobody", 75, 1].error == "KeyError: 'no variant nobody'" and got["dct", None, 1].error == "ValueError: quality None"
    assert all(got["dct", 75, i].error == "tiles without samples" and got["dct", 75, i].mse is None for i in (2, 3))
    none = sweeps.evaluated(tiles, cells.limit(0), evaluate)
    assert none.count() == 0 and none.columns == ["variant", "quality", "image", "tiles", "mse", "bits", "error"]


def test_sweep_files(spark, tmp_path):
    good = {"axes": {"quality": [50, 90], "flag": [True, None, "x y"]}, "name_template": "q{quality}-{flag}", "base_encode_config": {"quality": 1, "bank": "rich18"}, "env": {"A": "1"}, "objective_weights": {"bpp": 3}}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    for name, text in {"axes": '{"base_encode_config": {}}', "list": "[1, 2]", "empty": "", "axis": '{"axes": {"a": [1], "b": []}}', "plain": '{"axes": {"b": [1, 2]}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = sweep_files.sweeps(spark, str(tmp_path)).collect()
    of = lambda name: [r for r in rows if r.path.endswith(f"/{name}.json")]
    assert [r.config["quality"] for r in sorted(of("good"), key=lambda r: r.i)] == ["50"] * 3 + ["90"] * 3
    assert of("good")[0].config["bank"] == "rich18" and of("good")[0].env == {"A": "1"} and of("good")[0].bpp == 3.0 and of("good")[0].lpips == 1.0
    assert sorted(r.name for r in of("plain")) == ["sweep_0", "sweep_1"]
    assert [r.error for r in of("axes")] == ["a sweep has axes"] and [r.error for r in of("list")] == ["a sweep is a JSON object"] and of("axis")[0].error == "axis b is no list of values"
    assert all(r.error == "a sweep is a JSON object" for r in of("empty"))


def test_packs(spark, tmp_path):
    (tmp_path / "packs.json").write_text('{"packs": {"natural": "nat", "text": "t/u"}}')
    asked = spark.createDataFrame([("d", None), ("d", "natural"), ("d", "other")], "dataset string, pack string")
    got = {r.pack: (r.folder, r.error) for r in sweep_files.resolved(asked, sweep_files.packs(spark, str(tmp_path / "packs.json")), "/data/").collect()}
    assert got == {None: ("/data/d", None), "natural": ("/data/d/nat", None), "other": (None, "no such pack: other")}
    (tmp_path / "bad.json").write_text('{"sets": {}}')
    with pytest.raises(Exception, match="named packs"):
        sweep_files.packs(spark, str(tmp_path / "bad.json")).collect()


def test_the_suite_evaluates_its_hybrid_once(spark):
    profiles = spark.createDataFrame([("a", 50.0, "x"), ("b", 60.0, "x"), ("c", 90.0, "y"), ("d", 10.0, "y")], "profile string, quality double, mode string")
    asked = []

    def evaluate(p):
        asked.append([r.profile for r in p.collect()])
        images = spark.range(5).withColumnRenamed("id", "image")
        return images.crossJoin(p).select("profile", "image", (F.abs(F.col("quality") - 62) / 10 + F.col("image") * 0.1 + 1).alias("bpp"))

    out = api.suite(spark, profiles, evaluate, {"bpp": 1.0}, ["quality"], ["mode"])
    board = out["leaderboard"].collect()
    assert sorted(asked[0]) == ["a", "b", "c", "d"] and asked[1] == ["hybrid_top3"] and len(asked) == 2
    h = out["hybrid"].collect()[0]
    inverse = {p: 1 / (abs(q - 62) / 10 + 1.2) for p, q in (("a", 50), ("b", 60), ("c", 90))}
    assert h.mode == "x" and h.quality == pytest.approx(sum(inverse[p] * q for p, q in (("a", 50), ("b", 60), ("c", 90))) / sum(inverse.values()))
    assert len(board) == 5 and [r.profile for r in sorted(board, key=lambda r: r.place)][0] in ("b", "hybrid_top3") and out["bootstrap"].count() == 4
    named = profiles.unionByName(spark.createDataFrame([("hybrid_top3", 1.0, "x")], profiles.schema))
    asked.clear()
    assert api.suite(spark, named, evaluate, {"bpp": 1.0}, ["quality"], ["mode"])["leaderboard"].count() == 5 and asked[1] == []
