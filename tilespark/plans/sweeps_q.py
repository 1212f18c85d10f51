"""Queries on sweeps: profiles out of JSON, cells with errors as data, packs, a suite that evaluates its hybrid, variants that share a fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark import api, session
from tilespark.operators import registry, sweeps
from tilespark.plans import tiles_q as Q
from tilespark.plans.catalogue import register
from tilespark.session import table
from tilespark.sources import sweep_files


@register(
    "sweep_profiles",
    """WITH k AS (SELECT c_custkey AS k, c_custkey % 50 AS q FROM customer),
    p AS (SELECT k, x.range * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END + m.range AS i, q + 10 * x.range AS quality, ['a', 'b', 'c'][m.range + 1] AS mode FROM k, range(2) x, range(3) m WHERE k % 7 > 2 AND m.range < CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)
    SELECT k AS c_custkey, CAST(i AS INTEGER) AS i, 'c' || quality || '_' || mode || '_' || i AS name, CAST(quality AS VARCHAR) AS quality, mode, CASE WHEN k % 3 = 0 THEN 2.0 ELSE 0.25 END::DOUBLE AS bpp, 0.02::DOUBLE AS encode_seconds, CAST(NULL AS VARCHAR) AS error FROM p
    UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, ['a sweep has axes', 'a sweep is a JSON object', 'axis quality is no list of values'][k % 7 + 1] FROM k WHERE k % 7 < 3""",
)
def sweep_profiles(spark, sf):
    """Two axes a file, in the order that they are written; three of seven files are broken in three ways."""
    k = F.col("c_custkey")
    q = (k % 50).cast("string")
    modes = F.when(k % 2 == 0, '["a", "b", "c"]').otherwise('["a"]')
    whole = F.concat(F.lit('{"name_template": "c{quality}_{mode}_{i}", "base_encode_config": {"mode": "z", "quality": 1}, "objective_weights": '), F.when(k % 3 == 0, '{"bpp": 2.0}').otherwise("{}"),
                     F.lit(', "axes": {"quality": ['), q, F.lit(", "), (k % 50 + 10).cast("string"), F.lit('], "mode": '), modes, F.lit("}}"))
    text = F.when(k % 7 == 0, '{"axes": {}}').when(k % 7 == 1, "no sweep").when(k % 7 == 2, '{"axes": {"quality": 5}}').otherwise(whole)
    d = sweep_files.profiles(table(spark, sf, "customer").select("c_custkey", text.alias("value")))
    return d.select("c_custkey", "i", "name", F.col("config")["quality"].alias("quality"), F.col("config")["mode"].alias("mode"), "bpp", "encode_seconds", "error")


_CELL = "SELECT {q} AS quality, image, sum(e) / 64 / count(DISTINCT tile) AS mse, count(DISTINCT tile) AS tiles FROM (WITH {t}, {d} SELECT tile, image, power(c - q * {s}, 2) AS e FROM q) GROUP BY image"
_CELLS = " UNION ALL ".join(_CELL.format(q=q, t=Q._T, d=Q._dct(Q.step_of(q)), s=Q.step_of(q)) for q in (40, 75))


@register(
    "sweep_cells",
    f"""WITH m AS ({_CELLS}), n AS (SELECT label AS image, count(*) AS tiles FROM embeddings GROUP BY 1)
    SELECT 'dct' AS variant, CAST(quality AS INTEGER) AS quality, image, tiles, round(mse, 9) AS mse, CAST(NULL AS VARCHAR) AS error FROM m
    UNION ALL SELECT 'none', 75, image, tiles, NULL, 'KeyError: ''no variant none''' FROM n UNION ALL SELECT 'dct', 400, image, tiles, NULL, 'ValueError: quality 400' FROM n""",
)
def sweep_cells(spark, sf):
    """Four cells on every image: two that work, a variant that there is none of and a setting out of range."""
    cells = spark.createDataFrame([("dct", 40), ("dct", 75), ("none", 75), ("dct", 400)], "variant string, quality int")
    d = sweeps.evaluated(Q.embeddings(spark, sf), cells, registry.of_cell)
    return d.select("variant", "quality", "image", "tiles", F.round("mse", 9).alias("mse"), "error")


@register(
    "dataset_packs",
    """WITH p AS (SELECT n_name AS pack, lower(n_name) AS folder FROM nation WHERE n_nationkey % 2 = 0), a AS (SELECT c_custkey, 'd' || c_custkey % 3 AS dataset, CASE WHEN c_custkey % 5 > 0 THEN n_name END AS pack FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, CASE WHEN a.pack IS NULL THEN '/sets/' || dataset WHEN folder IS NOT NULL THEN '/sets/' || dataset || '/' || folder END AS folder, CASE WHEN a.pack IS NOT NULL AND folder IS NULL THEN 'no such pack: ' || a.pack END AS error FROM a LEFT JOIN p USING (pack)""",
)
def dataset_packs(spark, sf):
    n = table(spark, sf, "nation")
    known = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("pack"), F.lower("n_name").alias("folder"))
    asked = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    asked = asked.select("c_custkey", F.concat(F.lit("d"), F.col("c_custkey") % 3).alias("dataset"), F.when(F.col("c_custkey") % 5 > 0, F.col("n_name")).alias("pack"))
    return sweep_files.resolved(asked, known, "/sets").select("c_custkey", "folder", "error")


_EVAL = "round({q} / 100 + c_custkey % 7 * 0.01::DOUBLE, 10) AS bpp, round(30 + {q} * 0.1::DOUBLE - CASE WHEN {m} = 'b' THEN 2 ELSE 0 END - c_custkey % 5 * 0.2::DOUBLE, 10) AS psnr"


@register(
    "hybrid_suite",
    f"""WITH p AS (SELECT o_orderpriority AS profile, round(40 + avg(o_custkey % 40 + o_orderkey % 11), 6) AS quality, CASE WHEN length(o_orderpriority) % 2 = 0 THEN 'a' ELSE 'b' END AS mode FROM orders GROUP BY 1),
    f AS (SELECT profile, c_custkey, {_EVAL.format(q="quality", m="mode")} FROM p, customer), s AS (SELECT *, bpp * 1.0 + psnr * -0.02::DOUBLE AS objective FROM f),
    b AS (SELECT profile, round(avg(objective), 10) AS o FROM s GROUP BY 1), t AS (SELECT profile, 1 / o AS inv FROM b ORDER BY o, profile LIMIT 3), w AS (SELECT profile, round(inv / (SELECT sum(inv) FROM t), 10) AS w FROM t),
    h AS (SELECT round(sum(quality * w), 10) AS quality, (SELECT arg_min(mode, (-v, mode)) FROM (SELECT mode, round(sum(w), 10) AS v FROM p JOIN w USING (profile) GROUP BY 1)) AS mode FROM p JOIN w USING (profile)),
    g AS (FROM s UNION ALL SELECT 'hybrid_top3', c_custkey, bpp, psnr, bpp * 1.0 + psnr * -0.02::DOUBLE FROM (SELECT c_custkey, {_EVAL.format(q="quality", m="mode")} FROM h, customer)),
    l AS (SELECT profile, count(*) AS n, avg(objective) AS o, avg(bpp) AS bpp, avg(psnr) AS psnr FROM g GROUP BY 1)
    SELECT profile, n, round(o, 7) AS objective, round(bpp, 7) AS bpp, round(psnr, 7) AS psnr, CAST(row_number() OVER (ORDER BY round(o, 10), profile) AS INTEGER) AS place FROM l""",
)
def hybrid_suite(spark, sf):
    """Profiles from the orders' priorities, evaluated on every customer; the hybrid of the best three is evaluated too and takes its place on the board."""
    profiles = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("profile")).agg(F.round(F.avg(F.col("o_custkey") % 40 + F.col("o_orderkey") % 11) + 40, 6).alias("quality"))
    profiles = profiles.withColumn("mode", F.when(F.length("profile") % 2 == 0, "a").otherwise("b"))
    images = table(spark, sf, "customer").select("c_custkey")

    def evaluate(p):
        """Few profiles, sent to all images."""
        k, q = F.col("c_custkey"), F.col("quality")
        d = images.join(F.broadcast(p), F.lit(True))
        return d.select("profile", k.alias("image"), F.round(q / 100 + k % 7 * 0.01, 10).alias("bpp"), F.round(q * 0.1 + 30 - F.when(F.col("mode") == "b", 2).otherwise(0) - k % 5 * 0.2, 10).alias("psnr"))

    out = api.suite(spark, profiles, evaluate, {"bpp": 1.0, "psnr": -0.02}, ["quality"], ["mode"])
    return out["leaderboard"].select("profile", "n", *[F.round(f"avg_{m}", 7).alias(m) for m in ("objective", "bpp", "psnr")], "place")


@register("shared_fit_variants")
def shared_fit_variants(spark, sf):
    """The four variants that build on one fit; the fit is made once for each distinct tile and kept in a table."""
    d, _ = registry.compete_shared(Q.embeddings(spark, sf), session.fresh(spark, "fits"))
    return d.select("image", "variant", F.round("mse", 9).alias("mse"), F.round("bits", 6).alias("bits"), "won")
