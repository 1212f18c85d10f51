from tilespark import api, cli
from tilespark.plans.tiles_q import embeddings


def test_cli_lists_queries(capsys):
    assert cli.main(["queries"]) == 0
    assert "tile_rd_tournament" in capsys.readouterr().out


def test_experiment(spark):
    tiles = embeddings(spark, "/root/testdata/sf0.001").filter("image < 3")
    out = api.experiment(spark, {"quality": [50, 75, 90]}, "q{quality}", lambda _: api.bench(tiles, [50, 75, 90]), {"bits_per_sample": 1.0, "psnr": -0.1})
    board = {r.profile: r for r in out["leaderboard"].collect()}
    assert set(board) == {"q50", "q75", "q90"} and board["q90"].avg_psnr > board["q50"].avg_psnr and board["q90"].avg_bits_per_sample > board["q50"].avg_bits_per_sample
    assert out["pareto"].count() == 3 and out["bootstrap"].count() == 2 and out["grid"].count() == 3


def test_variants_compete(spark):
    import pytest

    from tilespark.operators import registry

    tiles = embeddings(spark, "/root/testdata/sf0.001")
    won = {r.image: r.variant for r in registry.compete(tiles).collect()}
    assert set(won) == set(range(10)) and set(won.values()) <= set(registry.variants())
    scalable = registry.compete(tiles, registry.Config.from_dict({"scalable_only": True, "quality": 500}))
    assert {r.variant for r in scalable.collect()} <= {"bicubic", "two-tone"}
    for bad in ({"what": 1}, {"quality": "x"}, {"scalable_only": 1}):
        with pytest.raises(ValueError):
            registry.Config.from_dict(bad)
    with pytest.raises(ValueError):
        registry.register_variant("dct")(lambda t, q: None)


def test_reports(spark, tmp_path):
    from tilespark.sources import reports

    (tmp_path / "p.json").write_text('{"name": "a", "config": {"quality": "75"}, "weights": {"bpp": 2.0}}\n{"name": "b"}\n')
    got = {r.name: (r.config, r.bpp, r.psnr) for r in reports.profiles(spark, str(tmp_path / "p.json"), {"bpp": 1.0, "psnr": -0.1}).collect()}
    assert got == {"a": ({"quality": "75"}, 2.0, -0.1), "b": ({}, 1.0, -0.1)}
    (tmp_path / "r.json").write_text('{"leaderboard": [{"profile": "a", "v": 1.5}, {"profile": "b", "v": 2.5}]}')
    board = reports.report(spark, str(tmp_path / "r.json"))
    reports.write({"board": board}, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "board")).count() == 2
    assert "<td>1.5000</td>" in reports.page("x <y>", {"board": board}) and "x &lt;y&gt;" in reports.page("x <y>", {})
    assert reports.canonical({"b": 1, "a": [1]}) == '{"a":[1],"b":1}'
