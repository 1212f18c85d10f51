"""Edges of the relational operators: ties, nulls, empty tables, repeated rows."""

import math

import pytest
from pyspark.sql import functions as F

from tilespark.functions import color, numeric, rd
from tilespark.operators import experiments as E
from tilespark.operators import relational as R
from tilespark.operators import sweeps
from tilespark.operators import tiles as T


def test_argmin_takes_the_first_of_ties(spark):
    d = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 5.0)], "s int, i int, v double")
    assert sorted(map(tuple, R.argmin_first(d, ["s"], "v", ["i"]).select("s", "i", "v").collect())) == [(1, 1, 1.0), (2, 0, 5.0)]
    assert R.argmin_first(d.filter("false"), ["s"], "v", ["i"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_global_scan(spark, n):
    d = spark.range(n).select("id", (F.col("id") % 5).alias("v")).repartition(7)
    got = sorted(map(tuple, R.exclusive_scan(d, "v", ["id"]).select("id", "offset").collect()))
    want, at = [], 0
    for i in range(n):
        want.append((i, at))
        at += i % 5
    assert got == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_global_scan_of_wide_rows(spark, adaptive):
    """More rows than the sampler of ranges takes, and a column that makes partitions' bytes uneven."""
    n = 400_000
    d = spark.range(n).selectExpr("(id * 7919) % 400000 AS id", "id % 7 AS v", "repeat(cast(id AS string), cast(id % 23 AS int)) AS wide", "id AS __part").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = R.exclusive_scan(d, "v", ["id"])
        assert got.columns == ["id", "v", "wide", "__part", "offset"]
        wrong = got.join(d.selectExpr("id", "wide AS w"), "id").filter("wide <> w").count()
        rows = got.select("id", "v", "offset").toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert wrong == 0 and len(rows) == n
    assert (rows.offset.to_numpy() == rows.v.cumsum().to_numpy() - rows.v.to_numpy()).all()


def test_segmented_scan_of_hot_segments_and_nulls(spark):
    made = [(None if i % 3 == 0 else "hot", i, i % 5) for i in range(2000)] + [("one", 0, 3)]
    got = {(r.s, r.i): r.offset for r in R.exclusive_scan(spark.createDataFrame(made, "s string, i int, v long").repartition(6), "v", ["i"], segment=["s"]).collect()}
    at = {}
    for s, i, v in made:
        assert got[s, i] == at.get(s, 0)
        at[s] = at.get(s, 0) + v


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_violations(spark, n):
    d = spark.createDataFrame([(i, 3 * i + (i % 50 == 49), 3) for i in range(n)], "i int, start long, length long").repartition(5)
    got = sorted(r.i for r in R.violations(d, ["i"], "start", "length").collect())
    assert got == sorted(j for i in range(49, n, 50) for j in (i, i + 1) if j < n)


def test_frequency_model_of_many_rare_bytes(spark):
    """One round of corrections would push a present byte below 1."""
    from tilespark.operators import entropy

    n = [394500] + [150] * 100 + [1] * 100
    d = spark.createDataFrame([("a", i, k) for i, k in enumerate(n)] + [("b", 7, 3)], "k string, byte int, n long")
    got = {(r.k, r.byte): r.freq for r in entropy.model(d, ["k"]).collect()}
    a = [got["a", i] for i in range(201)]
    assert min(a) >= 1 and sum(a) == 4096 and got["b", 7] == 4096
    counts = __import__("numpy").zeros(256, int)
    counts[:201] = n
    assert a == entropy.normalise(counts)[:201].tolist()


def test_compaction(spark):
    flags = [True, False, True, True, False]
    d = spark.createDataFrame(list(enumerate(flags)), "i long, f boolean")
    assert sorted((r.slot, r.i) for r in R.compact(d, F.col("f"), "i").collect()) == [(0, 0), (1, 2), (2, 3)]


def test_dedup_first(spark):
    d = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None), (4, "b")], "i int, k string")
    assert sorted(r.i for r in R.dedup_first(d, [F.col("k")], ["i"]).collect()) == [0, 2, 4]


def test_largest_remainder_is_whole(spark):
    d = spark.createDataFrame([("a", i, w) for i, w in enumerate([1.0, 1.0, 1.0])] + [("b", 0, 0.0)], "s string, i int, w double")
    got = {(r.s, r.i): r.budget for r in R.largest_remainder(d, "w", 10, ["s"], ["i"]).collect()}
    assert [got["a", i] for i in range(3)] == [4, 3, 3]


def test_skyline_keeps_equals(spark):
    d = spark.createDataFrame([(1.0, 5.0, "a"), (1.0, 5.0, "b"), (2.0, 5.0, "c"), (2.0, 9.0, "d")], "x double, y double, n string")
    assert sorted(r.n for r in R.skyline(d, ["x"], ["y"]).collect()) == ["a", "b", "d"]


def test_tournament_override_and_nan(spark):
    rows = [("i", 0, 10.0, 30.0), ("i", 1, 8.0, 33.0), ("i", 2, 1.0, 99.0), ("j", 0, 5.0, float("nan")), ("j", 1, 5.0, 20.0)]
    d = spark.createDataFrame(rows, "img string, ord int, s double, p double")
    got = {r.img: (r.ord, r.override) for r in E.tournament(d, ["img"], F.col("s"), "p", "ord", 5.0, 2.0).collect()}
    assert got == {"i": (1, True), "j": (1, True)}


def test_leaderboard_skips_nulls(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "p string, m double")
    got = {r.p: (r.n, r.avg_m, r.place) for r in E.leaderboard(d, "p", ["m"], "m").collect()}
    assert got == {"a": (2, 1.0, 1), "b": (1, None, 2)}


def test_bootstrap_is_stable(spark):
    d = spark.createDataFrame([("a", float(i % 3) - 0.5) for i in range(30)], "p string, delta double")
    one = E.bootstrap(d, "p", 200).collect()
    two = E.bootstrap(d.repartition(5), "p", 200).collect()
    assert one == two and one[0].low <= one[0].mean_delta <= one[0].high


def test_grid_names(spark):
    g = sweeps.grid(spark, {"q": [50, 75], "c": [1, 2, 3]}, "q{q}_c{c}").orderBy("ord").collect()
    assert [r.name for r in g][:4] == ["q50_c1", "q50_c2", "q50_c3", "q75_c1"] and len(g) == 6


def test_rounding_is_half_to_even(spark):
    r = spark.range(1).select(numeric.affine_quantise(F.lit(0.5 / 255), 0, 1).alias("a"), numeric.affine_quantise(F.lit(7.0), 0, 1).alias("b"), numeric.signed_byte(F.lit(-9.0)).alias("c"), numeric.ratio(F.lit(1), F.lit(0)).alias("d")).first()
    assert tuple(r) == (0, 255, -127, None)


def test_locked_constants(spark):
    r = spark.range(1).select(rd.tile_lambda(F.lit(75)), rd.tile_lambda(F.lit(89)), rd.tile_lambda(F.lit(90)), rd.dct_step(F.lit(0)), rd.dct_step(F.lit(100)), rd.select_lambda_scale(F.lit(75))).first()
    want = (0.26**2 * 1e-3, 0.12**2 * 1e-3, 0.11**2 * 2e-4, 0.2 * 0.91**2, 0.003, 1.0)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(r, want, strict=True))


def test_colour_goes_round(spark):
    d = spark.range(1).select(F.lit(0.2).alias("r"), F.lit(0.5).alias("g"), F.lit(0.9).alias("b"))
    back = color.ycbcr_to_rgb(*color.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b")))
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(d.select(*back).first(), (0.2, 0.5, 0.9), strict=True))


def test_tiles_pad_with_the_edge(spark):
    px = [(y, x, float(10 * y + x)) for y in range(3) for x in range(5)]
    d = T.cut(spark.createDataFrame(px, "y int, x int, v double"), F.lit(5), F.lit(3), 4, [])
    got = {(r.ty, r.tx): r.samples for r in d.collect()}
    assert set(got) == {(0, 0), (0, 1)}
    assert got[0, 1] == [4.0] * 4 + [14.0] * 4 + [24.0] * 8


def test_streaming_leaderboard(spark, tmp_path):
    from tilespark.streaming import leaderboard

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    q = leaderboard.start(spark, str(tmp_path / "in"), e.schema, str(tmp_path / "cp"), "board")
    q.awaitTermination(120)
    done = spark.table("board").count()
    assert 0 < done <= leaderboard.windowed(e, "1 day").count()


@pytest.mark.parametrize("n", [0, 3, 4, 5, 40])
def test_kmeans_rests_at_means(n):
    import numpy as np

    from tilespark.operators import search

    points = np.random.default_rng(n).integers(0, 60, (n, 2))
    label = search.kmeans(points)
    assert len(label) == n and (label == search.kmeans(points)).all()
    if n > 4:
        centres = np.array([points[label == j].mean(axis=0) if (label == j).any() else [1e9, 1e9] for j in range(4)])
        nearest = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (nearest == label).mean() > 0.9


def test_edge_clusters_cover_all_edge_points(spark):
    from tilespark.operators import search

    d = spark.createDataFrame([(i, [float((i * p) % 11) for p in range(64)]) for i in range(6)], "tile int, v array<double>")
    got = search.edge_clusters(d, ["tile"], "v").groupBy("tile").agg(F.sum("n").alias("n"), F.count("cluster").alias("k")).collect()
    assert len(got) == 6 and all(16 <= r.n <= 64 and 1 <= r.k <= 4 for r in got)


def test_greedy_palette_keeps_the_first(spark):
    from tilespark.operators import search

    d = spark.createDataFrame([([[0.0, 0.0, 0.0], [0.01, 0.0, 0.0], [0.5, 0.5, 0.5], [0.5, 0.5, 0.51], [0.05, 0.0, 0.0]],), ([],)], "c array<array<double>>")
    assert [r[0] for r in d.select(search.distinct_colours(F.col("c"))).collect()] == [[[0.0, 0.0, 0.0], [0.5, 0.5, 0.5], [0.05, 0.0, 0.0]], []]


def test_neighbour_deltas_undo(spark):
    from tilespark.operators import search

    made = [(i, "a" if i % 3 else None, bytes([i, 2 * i % 256, 7])[: 1 + i % 3]) for i in range(60)]
    got = {r.i: r for r in search.neighbour_deltas(spark.createDataFrame(made, "i int, k string, b binary").repartition(5), "k", "b", ["i"]).collect()}
    before = {}
    for i, k, b in made:
        old = before.get(k, b"")
        back = bytes((x + (old[j] if j < len(old) else 0)) & 255 for j, x in enumerate(got[i].delta))
        assert back == b and got[i].prev_len == len(old)
        before[k] = b


def test_skyline_of_three_measures_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9), rng.random() if i % 9 else None, float(rng.randint(0, 5))) for i in range(300)]
    worse = lambda a, b: b[2] is not None and a[2] is not None and b[1] <= a[1] and b[2] <= a[2] and b[3] >= a[3] and (b[1] < a[1] or b[2] < a[2] or b[3] > a[3])
    want = {a[0] for a in rows if not any(worse(a, b) for b in rows)}
    d = spark.createDataFrame(rows, "n int, x int, y double, z double").repartition(7)
    assert {r.n for r in R.skyline(d, ["x", "y"], ["z"]).collect()} == want
    assert R.skyline(d.limit(0), ["x", "y"], ["z"]).count() == 0


def test_stream_into_files(spark, tmp_path):
    from tilespark.streaming import leaderboard

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = leaderboard.start(spark, str(tmp_path / "in"), e.schema, str(tmp_path / "cp"), "to_files", path=str(tmp_path / "out"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = leaderboard.windowed(e.withColumn("ts", e.ts.cast("timestamp")), "1 day")
    assert got.count() > 0 and got.select("profile", "window.start", "n").exceptAll(whole.select("profile", "window.start", "n")).count() == 0
