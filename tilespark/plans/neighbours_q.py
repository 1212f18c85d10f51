"""Queries on neighbouring tiles and pixels, hard tiles, lines through points, generated images and JSON profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilespark.operators import kernels as K
from tilespark.operators import relational as R
from tilespark.operators import tiles as T
from tilespark.plans.catalogue import register
from tilespark.plans.tiles_q import _G, _T, embeddings
from tilespark.session import table


def _next(spark, sf):
    """Tiles in a row by image: each with the one to its right."""
    d = embeddings(spark, sf)
    at = Window.partitionBy("image").orderBy("tile")
    return d.withColumn("r", F.lead("v").over(at)).filter("r IS NOT NULL")


_N = "n AS (SELECT tile, image, lead(tile) OVER (PARTITION BY image ORDER BY tile) AS r FROM (SELECT DISTINCT tile, image FROM t))"


@register(
    "seam_cost",
    f"""WITH {_T}, {_N} SELECT n.tile, round(avg(power(a.v - b.v, 2)), 9) AS cost FROM n JOIN t a ON a.tile = n.tile AND a.x >= 6 JOIN t b ON b.tile = n.r AND b.y = a.y AND b.x = a.x - 6 GROUP BY 1""",
)
def seam_cost(spark, sf):
    """Mean squared difference of the two columns on either side of a seam."""

    def kernel(v, r):
        a, b = v.reshape(-1, 8, 8)[:, :, 6:], r.reshape(-1, 8, 8)[:, :, :2]
        return [((a - b) ** 2).mean(axis=(1, 2))]

    d = K.over_tiles(_next(spark, sf), ["v", "r"], {"c": "double"}, kernel, ["tile"])
    return d.select("tile", F.round("c", 9).alias("cost"))


@register(
    "seam_deblock",
    f"""WITH {_T}, {_N} SELECT n.tile, a.y, round((a.v + b.v) / 2, 9) AS v FROM n JOIN t a ON a.tile = n.tile AND a.x = 7 JOIN t b ON b.tile = n.r AND b.y = a.y AND b.x = 0""",
)
def seam_deblock(spark, sf):
    """What both pixels on a seam become: their mean."""
    pick = lambda c, x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.get(c, y * 8 + x))
    d = _next(spark, sf).select("tile", F.posexplode(F.zip_with(pick("v", 7), pick("r", 0), lambda a, b: (a + b) / 2)).alias("y", "v"))
    return d.withColumn("v", F.round("v", 9))


@register(
    "unsharp_mask",
    f"""WITH {_T} SELECT tile, p, round(v + 0.5 * (v - (v + coalesce(lag(v) OVER h, v) + coalesce(lead(v) OVER h, v) + coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v)) / 5), 6) AS v FROM t
    WINDOW h AS (PARTITION BY tile, y ORDER BY x), w AS (PARTITION BY tile, x ORDER BY y)""",
)
def unsharp_mask(spark, sf):
    """Five-point mask; the border repeats itself."""

    def kernel(v):
        t = np.pad(v.reshape(-1, 8, 8), ((0, 0), (1, 1), (1, 1)), mode="edge")
        c = t[:, 1:-1, 1:-1]
        mean = (c + t[:, :-2, 1:-1] + t[:, 2:, 1:-1] + t[:, 1:-1, :-2] + t[:, 1:-1, 2:]) / 5
        return [(c + 0.5 * (c - mean)).reshape(-1, 64)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"u": "array<double>"}, kernel, ["tile"])
    return d.select("tile", F.posexplode("u").alias("p", "v")).withColumn("v", F.round("v", 6))


@register(
    "hard_tiles",
    f"""WITH {_T}, {_G}, s AS (SELECT tile, image, round(avg(power(v - w, 2)), 9) AS mse, avg(sqrt(gx * gx + gy * gy)) AS edge FROM g GROUP BY ALL),
    e AS (SELECT image, quantile_cont(edge, 0.8) AS top FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY mse DESC, tile) AS r, count(*) OVER (PARTITION BY image) AS n FROM s)
    SELECT r.tile FROM r JOIN e USING (image) WHERE r * 5 <= n OR edge >= top""",
)
def hard_tiles(spark, sf):
    """The worst fifth of an image's tiles and those with the strongest edges."""

    def kernel(v):
        gx, gy = K.forward(v)
        return [np.round(((v - np.rint(v * 8) / 8) ** 2).mean(axis=1), 9), np.sqrt(gx**2 + gy**2).mean(axis=1)]

    s = K.over_tiles(embeddings(spark, sf), "v", {"mse": "double", "edge": "double"}, kernel, ["tile", "image"])
    w = Window.partitionBy("image")
    s = s.withColumn("r", F.row_number().over(w.orderBy(F.desc("mse"), "tile"))).withColumn("n", F.count(F.lit(1)).over(w))
    top = s.groupBy("image").agg(F.percentile("edge", F.lit(0.8)).alias("top"))
    return s.join(top, "image").filter((F.col("r") * 5 <= F.col("n")) | (F.col("edge") >= F.col("top"))).select("tile")


@register(
    "brightest_pixels",
    f"""WITH {_T} SELECT tile, p, v FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY v DESC, p) AS r FROM t) WHERE r <= 3""",
)
def brightest_pixels(spark, sf):
    best = F.slice(F.array_sort(F.transform("v", lambda e, p: F.struct((-e).alias("m"), p.alias("p")))), 1, 3)
    return embeddings(spark, sf).select("tile", F.explode(best).alias("b")).select("tile", "b.p", (-F.col("b.m")).alias("v"))


@register(
    "principal_lines",
    f"""WITH {_T}, e AS (SELECT tile, quantile_cont(v, 0.8) AS top FROM t GROUP BY 1), c AS (SELECT tile, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM t JOIN e USING (tile) WHERE v > top GROUP BY 1)
    SELECT tile, round(mx, 6) AS mx, round(my, 6) AS my, round(sqrt(power(sxx - syy, 2) + 4 * sxy * sxy), 6) AS anisotropy FROM c""",
)
def principal_lines(spark, sf):
    """Centre of each tile's bright points and how far they are from round: the gap of their covariance's eigenvalues."""
    px = T.long(embeddings(spark, sf), "v", 8, ["tile"])
    top = px.groupBy("tile").agg(F.percentile("v", F.lit(0.8)).alias("top"))
    d = px.join(top, "tile").filter("v > top").groupBy("tile").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    gap = F.sqrt(F.pow(F.col("sxx") - F.col("syy"), F.lit(2)) + F.pow("sxy", F.lit(2)) * 4)
    return d.select("tile", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), F.round(gap, 6).alias("anisotropy"))


@register(
    "residual_apply",
    f"""WITH {_T}, m AS (SELECT tile, sqrt(avg(power(v - w, 2))) >= 0.036 AS present FROM t GROUP BY 1)
    SELECT tile, p, round(least(1.0, greatest(-1.0, w + CASE WHEN present THEN round_even((v - w) * 64, 0) / 64 ELSE 0 END)), 9) AS v FROM t JOIN m USING (tile)""",
)
def residual_apply(spark, sf):
    """Coarse tiles with a quantised residual where one is present, clipped."""
    rms = F.sqrt(T.mean_squared_error(F.col("v"), F.transform("v", lambda x: F.rint(x * 8) / 8)))
    d = embeddings(spark, sf).withColumn("present", rms >= 0.036)

    def fixed(x):
        w = F.rint(x * 8) / 8
        return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), w + F.when(F.col("present"), F.rint((x - w) * 64) / 64).otherwise(0.0)))

    return d.select("tile", F.posexplode(F.transform("v", fixed)).alias("p", "v")).withColumn("v", F.round("v", 9))


@register(
    "uniform_tiling",
    """WITH p AS (SELECT vec_id // 9 AS image, CAST(vec_id % 9 // 3 * 8 + i // 8 AS INTEGER) AS y, CAST(vec_id % 3 * 8 + i % 8 AS INTEGER) AS x, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)),
    e AS MATERIALIZED (SELECT image, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, v FROM p, range(24) a, range(24) b WHERE p.y < 20 AND p.x < 20 AND (a.range = p.y OR p.y = 19 AND a.range > 19) AND (b.range = p.x OR p.x = 19 AND b.range > 19))
    SELECT image, CAST(y // 8 AS BIGINT) AS ty, CAST(x // 8 AS BIGINT) AS tx, round(sum(v), 6) AS total, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY ALL""",
)
def uniform_tiling(spark, sf):
    """Images of 20 by 20 in tiles of 8: the last ones repeat their image's edge."""
    d = table(spark, sf, "embeddings").select((F.expr("vec_id div 9")).alias("image"), (F.col("vec_id") % 9).alias("k"), F.posexplode("embedding").alias("p", "v"))
    y, x = F.expr("CAST(k div 3 * 8 + p div 8 AS int)"), F.expr("CAST(k % 3 * 8 + p % 8 AS int)")
    px = d.select("image", y.alias("y"), x.alias("x"), F.col("v").cast("double").alias("v")).filter("y < 20 AND x < 20")
    d = T.cut(px, F.lit(20), F.lit(20), 8, ["image"])
    return d.select("image", "ty", "tx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("samples").alias("n"))


#: Generated images of 16 by 16, as expressions over x, y and a part's own period s that both engines read alike.
_PATTERNS = {
    "ramp": "(x + y) / 30.0e0", "checker": "CASE WHEN (floor(x / s) + floor(y / s)) % 2 = 0 THEN 1e0 ELSE 0e0 END", "disc": "CASE WHEN power(x - 7.5e0, 2) + power(y - 7.5e0, 2) <= s * s THEN 0.9e0 ELSE 0.1e0 END",
    "rings": "0.5e0 + 0.5e0 * cos(sqrt(power(x - 7.5e0, 2) + power(y - 7.5e0, 2)) / s * 3)", "stripes": "CASE WHEN floor(x / s) % 2 = 0 THEN 0.8e0 ELSE 0.2e0 END", "bars": "CASE WHEN floor((x + y) / s) % 2 = 0 THEN 0.7e0 ELSE 0.3e0 END",
    "waves": "0.5e0 + 0.25e0 * sin(x / s) + 0.25e0 * cos(y / s)", "glow": "exp(-(power(x - 7.5e0, 2) + power(y - 7.5e0, 2)) / (2 * s * s))", "cross": "CASE WHEN abs(x - 7.5e0) < s / 2 OR abs(y - 7.5e0) < s / 2 THEN 1e0 ELSE 0.25e0 END",
    "frame": "CASE WHEN least(x, y, 15 - x, 15 - y) < s / 2 THEN 0.9e0 ELSE 0.4e0 END", "saddle": "0.5e0 + (x - 7.5e0) * (y - 7.5e0) / 112.5e0", "quadrants": "(CASE WHEN x < 8 THEN 0.2e0 ELSE 0.6e0 END) + (CASE WHEN y < 8 THEN 0e0 ELSE 0.3e0 END)",
}


@register(
    "analytic_images",
    "WITH p AS (SELECT p_partkey, 2e0 + p_size % 5 AS s, CAST(a.range AS DOUBLE) AS y, CAST(b.range AS DOUBLE) AS x FROM part, range(16) a, range(16) b) SELECT p_partkey, name, count(*) AS n, round(avg(v) + 1e-8, 7) AS mean_value FROM ("
    + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS name, {v} AS v FROM p" for k, v in _PATTERNS.items()) + ") GROUP BY 1, 2",
)
def analytic_images(spark, sf):
    """Twelve generated images for each part, with its own period: every pixel is made where it is used."""
    line = F.sequence(F.lit(0), F.lit(15))
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5 + F.lit(2.0)).alias("s"), F.explode(line).alias("y")).select("p_partkey", "s", F.col("y").cast("double").alias("y"), F.explode(line).alias("x")).withColumn("x", F.col("x").cast("double"))
    # a row a pixel with all patterns as columns, summed before anything is exploded
    d = p.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.expr(v)).alias(k) for k, v in _PATTERNS.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("v")) for k in _PATTERNS])).alias("i")
    return d.select("p_partkey", "n", rows).select("p_partkey", "i.name", "n", F.round(F.col("i.v") + 1e-8, 7).alias("mean_value"))


@register(
    "json_profiles",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.weight') AS DOUBLE), 1.0) AS weight, json_valid(props) AS valid FROM events""",
)
def json_profiles(spark, sf):
    """Profiles from JSON lines; weights that are missing get their default."""
    j = F.from_json("props", "k long, weight double")
    return table(spark, sf, "events").select("event_id", j["k"].alias("k"), F.coalesce(j["weight"], F.lit(1.0)).alias("weight"), j.isNotNull().alias("valid"))


@register(
    "technique_levels",
    """SELECT n_name AS technique, level, CASE level WHEN 'off' THEN 0 WHEN 'mid' THEN 8 ELSE 12 END + n_nationkey % 3 AS candidates, 't_' || n_name || '_' || level AS profile
      FROM nation, (VALUES ('off'), ('mid'), ('max')) l(level)""",
)
def technique_levels(spark, sf):
    level = F.explode(F.array(F.lit("off"), F.lit("mid"), F.lit("max"))).alias("level")
    d = table(spark, sf, "nation").select(F.col("n_name").alias("technique"), "n_nationkey", level)
    n = F.when(F.col("level") == "off", 0).when(F.col("level") == "mid", 8).otherwise(12)
    return d.select("technique", "level", (n + F.col("n_nationkey") % 3).alias("candidates"), F.concat_ws("_", F.lit("t"), "technique", "level").alias("profile"))


@register(
    "kind_streams",
    """SELECT event_type AS kind, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, sha256(string_agg(base64(encode(props)), ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1""",
)
def kind_streams(spark, sf):
    """Payloads by kind, in order, as base64: a stream's digest and size. (Streams are bounded by the kind's rows; five kinds.)"""
    d = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("props")).cast("long").alias("bytes"), F.array_sort(F.collect_list(F.struct("event_id", F.base64(F.encode("props", "UTF-8")).alias("b")))).alias("s"))
    return d.select("kind", "n", "bytes", F.sha2(F.array_join(F.transform("s", lambda x: x["b"]), ","), 256).alias("digest"))


@register("median_cut_palettes")
def median_cut_palettes(spark, sf):
    """A palette of at most 16 colours for each supplier's points."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        palette, labels = K.median_cut(pdf[["r", "g", "b"]].to_numpy(float), 16)
        n = np.bincount(labels, minlength=len(palette))
        return pd.DataFrame({"seg": pdf["seg"].iloc[0], "label": np.arange(len(palette)), "r": palette[:, 0], "g": palette[:, 1], "b": palette[:, 2], "n": n})

    from tilespark.plans.tiles_q import _points

    return _points(spark, sf).groupBy("seg").applyInPandas(run, "seg long, label long, r double, g double, b double, n long")


@register(
    "segmented_greedy_round",
    """SELECT l_orderkey, l_partkey, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY gain DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM (
      SELECT *, round(l_extendedprice * l_discount - 1000 * l_tax, 6) AS gain FROM lineitem) WHERE gain > 0) WHERE r = 1""",
)
def segmented_greedy_round(spark, sf):
    """One round for all segments at once: candidates that gain are compacted, and each segment takes its best."""
    d = table(spark, sf, "lineitem").withColumn("gain", F.round(F.col("l_extendedprice") * F.col("l_discount") - F.col("l_tax") * 1000, 6)).filter("gain > 0")
    best = R.segmented_topk(d, ["l_orderkey"], 1, [F.desc("gain"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return best.select("l_orderkey", "l_partkey", F.round("gain", 6).alias("gain"))
