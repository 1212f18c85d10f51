"""Queries on tiles: an embedding of 64 numbers is an 8 by 8 tile, its label the image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilespark.functions import rd
from tilespark.functions.numeric import signed_byte
from tilespark.operators import kernels as K
from tilespark.operators import relational as R
from tilespark.operators import tiles as T
from tilespark.plans.catalogue import register
from tilespark.session import table

SIDE = 8
_T = """t0 AS (SELECT vec_id AS tile, label AS image, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
t AS (SELECT tile, image, p, p // 8 AS y, p % 8 AS x, v, round_even(v * 8, 0) / 8 AS w FROM t0)"""
_G = """g AS (SELECT tile, image, p, y, x, v, w, coalesce(lead(v) OVER (PARTITION BY tile, y ORDER BY x) - v, 0) AS gx, coalesce(lead(v) OVER (PARTITION BY tile, x ORDER BY y) - v, 0) AS gy,
  coalesce(lead(w) OVER (PARTITION BY tile, y ORDER BY x) - w, 0) AS hx, coalesce(lead(w) OVER (PARTITION BY tile, x ORDER BY y) - w, 0) AS hy FROM t)"""
_K = """k AS (SELECT CAST(a.range AS INTEGER) AS u, CAST(b.range AS INTEGER) AS n, CASE WHEN a.range = 0 THEN sqrt(0.125) ELSE 0.5 END * cos(pi() * (2 * b.range + 1) * a.range / 16) AS c FROM range(8) a, range(8) b)"""


def _dct(step, alpha=0.0):
    return f"""{_K}, c AS (SELECT tile, image, i.u AS i, j.u AS j, sum(v * i.c * j.c) AS c FROM t JOIN k i ON i.n = y JOIN k j ON j.n = x GROUP BY ALL),
q AS (SELECT tile, image, i, j, c, CAST(least(32767, greatest(-32767, round_even(c / ({step} * (1 + {alpha} * (i + j) / 14.0)), 0))) AS INTEGER) AS q FROM c)"""


def step_of(quality: int) -> float:
    return min(0.20, max(0.003, 0.2 * ((101 - min(99, max(10, quality))) / 100) ** 2))


def embeddings(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile"), F.col("label").alias("image"), v.alias("v"))


def pixels(spark, sf):
    return T.long(embeddings(spark, sf), "v", SIDE, ["tile", "image"])


def coarse(v):
    """A stand-in for a decoded tile: samples in steps of an eighth."""
    return F.transform(v, lambda x: F.rint(x * 8) / 8)


@register(
    "tile_rd_tournament",
    f"""WITH {_T}, {_dct(step_of(40))}, lam AS (SELECT power((101.0 - 40) / 100, 2) * 1e-3 AS l),
    m AS (SELECT tile, image, 0 AS ord, 'const' AS kind, var_pop(v) AS mse, 7 * 8 + 32 AS bits FROM t GROUP BY ALL
      UNION ALL SELECT tile, image, 1, 'vertical', sum(s) / 64, 18 * 8 + 32 FROM (SELECT tile, image, var_pop(v) * 32 AS s FROM t GROUP BY tile, image, x < 4) GROUP BY tile, image
      UNION ALL SELECT tile, image, 2, 'horizontal', sum(s) / 64, 18 * 8 + 32 FROM (SELECT tile, image, var_pop(v) * 32 AS s FROM t GROUP BY tile, image, y < 4) GROUP BY tile, image
      UNION ALL SELECT tile, image, 3, 'dct', sum(power(c - q * {step_of(40)}, 2)) / 64, CAST(4 * count(*) FILTER (q <> 0) + 32 AS INTEGER) FROM q GROUP BY tile, image),
    r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY round(mse + l * bits, 9), ord) AS r FROM m, lam)
    SELECT image, count(*) FILTER (kind = 'const') AS n_const, count(*) FILTER (kind = 'vertical') AS n_vertical, count(*) FILTER (kind = 'horizontal') AS n_horizontal,
      count(*) FILTER (kind = 'dct') AS n_dct, round(avg(mse), 6) AS mean_mse, CAST(sum(bits) AS BIGINT) AS bits FROM r WHERE r = 1 GROUP BY image""",
)
def tile_rd_tournament(spark, sf, quality: int = 40):
    """Constant, two half-plane and cosine candidates for each tile; the least mse + lambda * bits wins, by image."""
    step = step_of(quality)
    halves = np.array([np.tile(np.arange(8) < 4, 8), np.repeat(np.arange(8) < 4, 8)], float)

    def kernel(v):
        const = v.var(axis=1)
        sides = [((v - np.where(h > 0, (v @ h)[:, None] / 32, (v @ (1 - h))[:, None] / 32)) ** 2).mean(axis=1) for h in halves]
        c = v @ K.dct_matrix_2d(8).T
        q = np.clip(np.rint(c / step), -32767, 32767)
        return [const, *sides, ((c - q * step) ** 2).mean(axis=1), (q != 0).sum(axis=1)]

    names = {"const": "double", "vertical": "double", "horizontal": "double", "dct": "double", "nonzero": "int"}
    d = K.over_tiles(embeddings(spark, sf), "v", names, kernel, ["image", "tile"])
    lam = rd.tile_lambda(F.lit(quality))
    bits = {"const": F.lit(7 * 8 + 32), "vertical": F.lit(18 * 8 + 32), "horizontal": F.lit(18 * 8 + 32), "dct": F.col("nonzero") * 4 + 32}
    cands = [F.struct(F.round(F.col(k) + lam * b, 9).alias("cost"), F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.col(k).alias("mse"), b.cast("long").alias("bits")) for i, (k, b) in enumerate(bits.items())]
    w = d.select("image", F.array_min(F.array(*cands)).alias("w"))
    wins = [F.count_if(F.col("w.kind") == k).alias(f"n_{k}") for k in bits]
    return w.groupBy("image").agg(*wins, F.round(F.avg("w.mse"), 6).alias("mean_mse"), F.sum("w.bits").alias("bits"))


@register(
    "mse_psnr",
    f"""WITH {_T} SELECT tile, round(mse, 9) AS mse, round(CASE WHEN mse <= 1e-12 THEN 100 ELSE -10 * log10(mse) END, 6) AS psnr FROM (SELECT tile, avg(power(v - w, 2)) AS mse FROM t GROUP BY 1)""",
)
def mse_psnr(spark, sf):
    d = embeddings(spark, sf).withColumn("mse", T.mean_squared_error(F.col("v"), coarse("v")))
    return d.select("tile", F.round("mse", 9).alias("mse"), F.round(T.psnr(F.col("mse")), 6).alias("psnr"))


@register("dct8_quantize", f"WITH {_T}, {_dct(step_of(75), 0.5)} SELECT tile, CAST(i * 8 + j AS INTEGER) AS k, q FROM q WHERE q <> 0")
def dct8_quantize(spark, sf):
    d = K.over_tiles(embeddings(spark, sf), "v", {"q": "array<int>"}, lambda v: [K.dct_quantise(v, step_of(75), 0.5)], ["tile"])
    return d.select("tile", F.posexplode("q").alias("k", "q")).filter("q <> 0")


@register(
    "dct8_roundtrip",
    f"""WITH {_T}, {_dct(step_of(75), 0.5)}, r AS (SELECT q.tile, a.n * 8 + b.n AS p, sum(q * {step_of(75)} * (1 + 0.5 * (i + j) / 14.0) * a.c * b.c) AS r FROM q JOIN k a ON a.u = i JOIN k b ON b.u = j GROUP BY ALL)
    SELECT tile, round(avg(power(v - r, 2)), 9) AS mse, round(max(abs(v - r)), 6) AS worst FROM t JOIN r USING (tile, p) GROUP BY 1""",
)
def dct8_roundtrip(spark, sf):
    def kernel(v):
        e = v - K.dct_restore(K.dct_quantise(v, step_of(75), 0.5), step_of(75), 0.5)
        return [(e**2).mean(axis=1), np.abs(e).max(axis=1)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"mse": "double", "worst": "double"}, kernel, ["tile"])
    return d.select("tile", F.round("mse", 9).alias("mse"), F.round("worst", 6).alias("worst"))


_ZZ = """z AS (SELECT i, j, CAST(row_number() OVER (ORDER BY i + j, CASE WHEN (i + j) % 2 = 1 THEN i ELSE j END) - 1 AS INTEGER) AS zz FROM (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j FROM range(8) a, range(8) b))"""


@register(
    "zigzag_band_major",
    f"""WITH {_T}, {_dct(step_of(75))}, {_ZZ} SELECT zz, CAST(sum(abs(q)) AS BIGINT) AS energy, count(*) FILTER (q <> 0) AS nonzero, string_agg(CAST(q AS VARCHAR), ',' ORDER BY tile) AS band
    FROM q JOIN z USING (i, j) GROUP BY zz""",
)
def zigzag_band_major(spark, sf):
    """Coefficients by band: a band is one zig-zag place over all tiles in order (64 bands, each as long as there are tiles)."""
    order = list(K.zigzag(8))
    d = K.over_tiles(embeddings(spark, sf), "v", {"q": "array<int>"}, lambda v: [K.dct_quantise(v, step_of(75))[:, order]], ["tile"])
    d = d.select("tile", F.posexplode("q").alias("zz", "q"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "q"))), lambda s: s["q"].cast("string")), ",")
    return d.groupBy("zz").agg(F.sum(F.abs("q")).cast("long").alias("energy"), F.count_if(F.col("q") != 0).alias("nonzero"), line.alias("band"))


@register(
    "band_to_tile_roundtrip",
    f"""WITH {_T}, {_dct(step_of(75))} SELECT tile, string_agg(CAST(q AS VARCHAR), ',' ORDER BY i, j) AS line FROM q GROUP BY 1""",
)
def band_to_tile_roundtrip(spark, sf):
    """From band-major rows back to tile-major ones."""
    order = list(K.zigzag(8))
    d = K.over_tiles(embeddings(spark, sf), "v", {"q": "array<int>"}, lambda v: [K.dct_quantise(v, step_of(75))[:, order]], ["tile"])
    bands = d.select("tile", F.posexplode("q").alias("zz", "q"))
    k = F.element_at(F.array(*map(F.lit, order)), F.col("zz") + 1)
    back = bands.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), "q"))).alias("s"))
    return back.select("tile", F.array_join(F.transform("s", lambda x: x["q"].cast("string")), ",").alias("line"))


@register("presence_mask", f"WITH {_T} SELECT tile, round(sqrt(avg(power(v - w, 2))), 9) AS rms, sqrt(avg(power(v - w, 2))) >= 0.036 AS present FROM t GROUP BY 1")
def presence_mask(spark, sf):
    rms = F.sqrt(T.mean_squared_error(F.col("v"), coarse("v")))
    return embeddings(spark, sf).select("tile", F.round(rms, 9).alias("rms"), (rms >= 0.036).alias("present"))


@register(
    "presence_bytes",
    f"""WITH {_T}, m AS (SELECT tile, sqrt(avg(power(v - w, 2))) >= 0.036 AS present FROM t GROUP BY 1)
    SELECT tile // 8 AS byte_index, CAST(sum(CASE WHEN present THEN 1 << (tile % 8)::INTEGER ELSE 0 END) AS INTEGER) AS bits, count(*) FILTER (present) AS n FROM m GROUP BY 1""",
)
def presence_bytes(spark, sf):
    """Presence packed into bytes, least bit first; unpacking gives n."""
    bit = F.when(F.col("present"), F.expr("shiftleft(1, CAST(tile % 8 AS INT))")).otherwise(0)
    d = presence_mask(spark, sf).groupBy(F.expr("tile div 8").alias("byte_index")).agg(F.sum(bit).cast("int").alias("bits"))
    n = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("bits"), i) % 2), F.lit(0), lambda a, x: a + x)
    return d.select("byte_index", "bits", n.cast("long").alias("n"))


@register(
    "adaptive_tile_scale",
    f"""WITH {_T}, a AS (SELECT tile, image, stddev_pop(v) AS act FROM t GROUP BY ALL), p AS (SELECT image, quantile_cont(act, 0.75) AS top FROM a WHERE act > 0 GROUP BY 1),
    s AS (SELECT tile, least(1.0, greatest(0.5, act / top)) AS s FROM a JOIN p USING (image))
    SELECT tile, round(s, 6) AS scale, CAST(round_even((log2(s) + 2) / 4 * 255, 0) AS INTEGER) AS byte FROM s""",
)
def adaptive_tile_scale(spark, sf):
    d = K.over_tiles(embeddings(spark, sf), "v", {"act": "double"}, lambda v: [v.std(axis=1)], ["tile", "image"])
    top = d.filter("act > 0").groupBy("image").agg(F.percentile("act", F.lit(0.75)).alias("top"))
    s = d.join(top, "image").withColumn("s", F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.col("act") / F.col("top"))))
    return s.select("tile", F.round("s", 6).alias("scale"), rd.scale_byte(F.col("s")).alias("byte"))


@register("dct_cost_bits", f"WITH {_T}, {_dct(step_of(75))} SELECT tile, CAST(4 * count(*) FILTER (q <> 0) AS BIGINT) AS bits FROM q GROUP BY 1")
def dct_cost_bits(spark, sf):
    return K.over_tiles(embeddings(spark, sf), "v", {"bits": "bigint"}, lambda v: [4 * (K.dct_quantise(v, step_of(75)) != 0).sum(axis=1)], ["tile"])


@register(
    "tile_mode_choice",
    f"""WITH {_T}, {_dct(step_of(60))}, a AS (SELECT tile, 4 * count(*) FILTER (q <> 0) AS whole FROM q GROUP BY 1),
    b AS (SELECT tile, 4 * count(*) FILTER (round_even((c - CASE WHEN i + j = 0 THEN c ELSE 0 END) / {step_of(60)}, 0) <> 0) + 88 AS rest FROM c GROUP BY 1)
    SELECT tile, CASE WHEN whole < rest THEN 'dct' ELSE 'primitives+residual' END AS mode, CAST(least(whole, rest) AS BIGINT) AS bits FROM a JOIN b USING (tile)""",
)
def tile_mode_choice(spark, sf):
    """Whether the transform alone is cheaper than a constant patch and the transform of what it leaves."""

    def kernel(v):
        whole = 4 * (K.dct_quantise(v, step_of(60)) != 0).sum(axis=1)
        rest = 4 * (K.dct_quantise(v - v.mean(axis=1, keepdims=True), step_of(60)) != 0).sum(axis=1) + 88
        return [whole, rest]

    d = K.over_tiles(embeddings(spark, sf), "v", {"whole": "bigint", "rest": "bigint"}, kernel, ["tile"])
    return d.select("tile", F.when(F.col("whole") < F.col("rest"), "dct").otherwise("primitives+residual").alias("mode"), F.least("whole", "rest").alias("bits"))


@register(
    "ycbcr_420",
    f"""WITH {_T}, c AS (SELECT tile // 3 AS px, tile % 3 AS ch, p, y, x, v FROM t), full_ AS (SELECT px FROM c GROUP BY 1 HAVING count(*) = 192),
    r AS (SELECT px, p, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM c JOIN full_ USING (px) GROUP BY ALL),
    y AS (SELECT px, p, y, x, 0.299 * r + 0.587 * g + 0.114 * b AS l, r, b FROM r), h AS (SELECT px, y // 2 AS cy, x // 2 AS cx, avg((b - l) / 1.772) AS cb, avg((r - l) / 1.402) AS cr FROM y GROUP BY ALL)
    SELECT px, p, round(l, 6) AS luma, round(cb, 6) AS cb, round(cr, 6) AS cr, round(l + 1.402 * cr, 6) AS red FROM y JOIN h USING (px) WHERE cy = y // 2 AND cx = x // 2""",
)
def ycbcr_420(spark, sf):
    """Three consecutive vectors are a colour tile; chroma is halved both ways and repeated."""
    d = embeddings(spark, sf).groupBy(F.expr("tile div 3").alias("px")).agg(F.array_sort(F.collect_list(F.struct("tile", "v"))).alias("c")).filter("size(c) = 3")
    d = d.select("px", *[F.col("c")[i]["v"].alias(n) for i, n in enumerate("rgb")])

    def kernel(r, g, b):
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        half = lambda t: np.repeat(np.repeat(t.reshape(-1, 4, 2, 4, 2).mean(axis=(2, 4)), 2, axis=1), 2, axis=2).reshape(-1, 64)
        cb, cr = half((b - luma) / 1.772), half((r - luma) / 1.402)
        return [luma, cb, cr, luma + 1.402 * cr]

    k = K.over_tiles(d, ["r", "g", "b"], {n: "array<double>" for n in ("luma", "cb", "cr", "red")}, kernel, ["px"])
    z = k.select("px", F.posexplode(F.arrays_zip("luma", "cb", "cr", "red")).alias("p", "z"))
    return z.select("px", "p", *[F.round(f"z.{n}", 6).alias(n) for n in ("luma", "cb", "cr", "red")])


@register(
    "gradient_field_encode",
    f"""WITH {_T}, {_G}, q AS (SELECT tile, p, CAST(least(127, greatest(-127, round_even(CASE WHEN abs(gx) < 0.02 THEN 0 ELSE gx END * 127, 0))) AS INTEGER) AS qx,
      CAST(least(127, greatest(-127, round_even(CASE WHEN abs(gy) < 0.02 THEN 0 ELSE gy END * 127, 0))) AS INTEGER) AS qy FROM g)
    SELECT tile, CAST(sum(abs(qx)) AS BIGINT) AS sum_x, CAST(sum(abs(qy)) AS BIGINT) AS sum_y, round(100.0 * sum((qx = 0)::INT + (qy = 0)::INT) / 128, 6) AS sparsity FROM q GROUP BY 1""",
)
def gradient_field_encode(spark, sf):
    def coded(g):
        return F.transform(g, lambda e: signed_byte(F.when(F.abs(e) < 0.02, 0.0).otherwise(e), 127.0))

    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + F.abs(x))
    zeros = lambda q: F.size(F.filter(q, lambda x: x == 0))
    d = embeddings(spark, sf).withColumn("gx", T.forward("v", SIDE, "x")).withColumn("gy", T.forward("v", SIDE, "y"))
    d = d.withColumn("qx", coded("gx")).withColumn("qy", coded("gy"))
    return d.select("tile", total("qx").alias("sum_x"), total("qy").alias("sum_y"), F.round((zeros("qx") + zeros("qy")) * 100.0 / 128, 6).alias("sparsity"))


@register(
    "divergence",
    f"""WITH {_T}, {_G} SELECT tile, p, round(gx - coalesce(lag(gx) OVER (PARTITION BY tile, y ORDER BY x), 0) + gy - coalesce(lag(gy) OVER (PARTITION BY tile, x ORDER BY y), 0), 6) AS d FROM g""",
)
def divergence(spark, sf):
    d = K.over_tiles(embeddings(spark, sf), "v", {"d": "array<double>"}, lambda v: [K.divergence(*K.forward(v))], ["tile"])
    return d.select("tile", F.posexplode("d").alias("p", "d")).withColumn("d", F.round("d", 6))


@register(
    "tile_complexity",
    f"""WITH {_T}, c AS (SELECT *, lead(v) OVER h AS r, lag(v) OVER h AS l, lead(v) OVER w AS b, lag(v) OVER w AS a FROM t WINDOW h AS (PARTITION BY tile, y ORDER BY x), w AS (PARTITION BY tile, x ORDER BY y)),
    d AS (SELECT tile, v, CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END AS gx, CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END AS gy FROM c)
    SELECT tile, round(avg(sqrt(gx * gx + gy * gy)) + 4 * var_pop(v), 6) AS complexity FROM d GROUP BY 1""",
)
def tile_complexity(spark, sf):
    def kernel(v):
        gy, gx = np.gradient(v.reshape(-1, 8, 8), axis=(1, 2))
        return [np.sqrt(gx**2 + gy**2).mean(axis=(1, 2)) + 4 * v.var(axis=1)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"c": "double"}, kernel, ["tile"])
    return d.select("tile", F.round("c", 6).alias("complexity"))


@register(
    "quadtree_split",
    f"""WITH {_T}, a AS (SELECT tile, 8 AS size, 0 AS "by", 0 AS bx, round(var_pop(v), 9) AS variance FROM t GROUP BY tile),
    b AS (SELECT tile, 4 AS size, y // 4 AS "by", x // 4 AS bx, round(var_pop(v), 9) AS variance FROM t WHERE tile IN (SELECT tile FROM a WHERE variance >= 0.015) GROUP BY ALL),
    c AS (SELECT t.tile, 2 AS size, y // 2 AS "by", x // 2 AS bx, round(var_pop(v), 9) AS variance FROM t JOIN b ON t.tile = b.tile AND y // 4 = b."by" AND x // 4 = b.bx AND b.variance >= 0.015 GROUP BY ALL)
    SELECT tile, CAST(size AS INTEGER) AS size, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, variance FROM (FROM a WHERE variance < 0.015 UNION ALL FROM b WHERE variance < 0.015 UNION ALL FROM c)""",
)
def quadtree_split(spark, sf):
    return T.split_levels(pixels(spark, sf).select("tile", "y", "x", "v"), ["tile"], 8, 2, 0.015)


@register(
    "sobel_orientation_histogram",
    f"""WITH {_T}, n AS (SELECT a.tile, a.y, a.x, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS sx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS sy
      FROM t a JOIN t b ON a.tile = b.tile AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL),
    o AS (SELECT tile, sqrt(sx * sx + sy * sy) AS m, atan2(sy, sx) AS a FROM n), b AS (SELECT tile, m, CASE WHEN a < 0 THEN a + pi() WHEN a >= pi() THEN a - pi() ELSE a END AS a FROM o),
    h AS (SELECT tile, CAST(least(11, floor(a / pi() * 12)) AS INTEGER) AS bin, sum(m) AS weight FROM b GROUP BY ALL)
    SELECT tile, bin, round(weight, 6) AS weight, weight > 0.2 * max(weight) OVER (PARTITION BY tile) AS peak FROM h""",
)
def sobel_orientation_histogram(spark, sf):
    def kernel(v):
        t = v.reshape(-1, 8, 8)
        smooth_y, smooth_x = t[:, :-2] + 2 * t[:, 1:-1] + t[:, 2:], t[:, :, :-2] + 2 * t[:, :, 1:-1] + t[:, :, 2:]
        sx, sy = smooth_y[:, :, 2:] - smooth_y[:, :, :-2], smooth_x[:, 2:] - smooth_x[:, :-2]
        a = np.arctan2(sy, sx)
        a = np.where(a < 0, a + np.pi, np.where(a >= np.pi, a - np.pi, a))
        bins = np.minimum(11, np.floor(a / np.pi * 12)).astype(int)
        out = np.zeros((len(t), 12))
        np.add.at(out, (np.repeat(np.arange(len(t)), 36), bins.reshape(-1)), np.hypot(sx, sy).reshape(-1))
        seen = np.zeros((len(t), 12))
        np.add.at(seen, (np.repeat(np.arange(len(t)), 36), bins.reshape(-1)), 1)
        return [np.where(seen > 0, out, -1.0)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"h": "array<double>"}, kernel, ["tile"])
    d = d.select("tile", F.array_max("h").alias("top"), F.posexplode("h").alias("bin", "weight")).filter("weight >= 0")
    return d.select("tile", "bin", F.round("weight", 6).alias("weight"), (F.col("weight") > F.col("top") * 0.2).alias("peak"))


_EDGES = f"""{_T}, {_G}, m AS (SELECT tile, v, w, sqrt(gx * gx + gy * gy) AS a, sqrt(hx * hx + hy * hy) AS b FROM g),
  e AS (SELECT tile, quantile_cont(a, 0.85) AS pa, quantile_cont(b, 0.85) AS pb FROM m GROUP BY 1)"""


def _edges(a):
    gx, gy = K.forward(a)
    m = np.sqrt(gx**2 + gy**2)
    return m, np.percentile(m, 85, axis=1, keepdims=True)


@register(
    "edge_mse",
    f"""WITH {_EDGES} SELECT tile, round(coalesce(avg(power(v - w, 2)) FILTER (a > pa), avg(power(v - w, 2))), 9) AS edge_mse FROM m JOIN e USING (tile) GROUP BY 1""",
)
def edge_mse(spark, sf):
    """Error where the source's gradient exceeds its 85th percentile; everywhere if nothing does."""

    def kernel(v):
        m, p = _edges(v)
        d, on = (v - np.rint(v * 8) / 8) ** 2, m > p
        n = on.sum(axis=1)
        return [np.where(n > 0, (d * on).sum(axis=1) / np.maximum(n, 1), d.mean(axis=1))]

    d = K.over_tiles(embeddings(spark, sf), "v", {"e": "double"}, kernel, ["tile"])
    return d.select("tile", F.round("e", 9).alias("edge_mse"))


@register(
    "edge_iou",
    f"""WITH {_EDGES} SELECT tile, round(coalesce(count(*) FILTER (a >= pa AND b >= pb) / nullif(count(*) FILTER (a >= pa OR b >= pb), 0)::DOUBLE, 1.0), 6) AS iou FROM m JOIN e USING (tile) GROUP BY 1""",
)
def edge_iou(spark, sf):
    def kernel(v):
        (a, pa), (b, pb) = _edges(v), _edges(np.rint(v * 8) / 8)
        both, either = ((a >= pa) & (b >= pb)).sum(axis=1), ((a >= pa) | (b >= pb)).sum(axis=1)
        return [np.where(either > 0, both / np.maximum(either, 1), 1.0)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"i": "double"}, kernel, ["tile"])
    return d.select("tile", F.round("i", 6).alias("iou"))


_POINTS = "pts AS (SELECT l_suppkey AS seg, l_discount * 10 AS r, l_tax * 10 AS g, l_quantity / 50 AS b, l_extendedprice AS e, l_orderkey AS o, l_partkey AS k FROM lineitem)"


def _points(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("seg"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("g"), (F.col("l_quantity") / 50).alias("b"),
                                               F.col("l_extendedprice").alias("e"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k"))


_SLICES = f"""{_POINTS}, s AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY round(0.2126 * r + 0.7152 * g + 0.0722 * b, 9), e, o, k) AS i, count(*) OVER (PARTITION BY seg) AS n FROM pts),
  pal AS (SELECT seg, CAST((i * 4 - 1) // n AS INTEGER) AS label, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, count(*) AS n FROM s GROUP BY ALL)"""


def _palette(spark, sf, k=4):
    from tilespark.functions.color import luma

    w = Window.partitionBy("seg")
    order = [F.round(luma(F.col("r"), F.col("g"), F.col("b")), 9), "e", "o", "k"]
    s = _points(spark, sf).withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    s = s.withColumn("label", F.expr(f"(i * {k} - 1) div n").cast("int"))
    return s.groupBy("seg", "label").agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"))


@register("palette_equal_count", f"WITH {_SLICES} SELECT * FROM pal")
def palette_equal_count(spark, sf):
    """Luma-sorted slices of equal count; a slice's mean is its colour."""
    return _palette(spark, sf)


@register(
    "nearest_palette_assign",
    f"""WITH {_SLICES}, d AS (SELECT pts.*, label, row_number() OVER (PARTITION BY pts.seg, o, pts.k, e, pts.r, pts.g, pts.b ORDER BY round(power(pts.r - pal.r, 2) + power(pts.g - pal.g, 2) + power(pts.b - pal.b, 2), 9), label) AS i
      FROM (SELECT DISTINCT * FROM pts) pts JOIN pal USING (seg)) SELECT seg, label, count(*) AS n FROM d WHERE i = 1 GROUP BY ALL""",
)
def nearest_palette_assign(spark, sf):
    """The nearest colour of each distinct point: a segment's few colours travel as an array, and no pair is ever a row."""
    p = _palette(spark, sf).groupBy("seg").agg(F.collect_list(F.struct("label", "r", "g", "b")).alias("pal"))
    d = _points(spark, sf).distinct().join(p, "seg")
    sq = lambda c, x: (F.col(c) - x[c]) * (F.col(c) - x[c])
    best = F.array_min(F.transform("pal", lambda x: F.struct(F.round(sq("r", x) + sq("g", x) + sq("b", x), 9).alias("d"), x["label"].alias("label"))))
    return d.select("seg", best["label"].alias("label")).groupBy("seg", "label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "half_plane_model_fit",
    f"""WITH {_T}, mo AS (SELECT CAST(range AS INTEGER) AS model, pi() * (range // 3) / 6 AS angle, (range % 3 - 1) * 2 + 1e-9::DOUBLE AS edge FROM range(18)),
    s AS (SELECT tile, model, v, CASE WHEN (x - 3.5) * cos(angle) + (y - 3.5) * sin(angle) > edge THEN 1 ELSE 0 END AS side FROM t, mo), b AS (SELECT tile, model, side, var_pop(v) * count(*) AS sse, avg(v) AS c FROM s GROUP BY ALL),
    m AS (SELECT tile, model, round(sum(sse) / 64, 9) AS mse, max(c) FILTER (side = 0) AS c0, max(c) FILTER (side = 1) AS c1 FROM b GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY mse, model) AS r FROM m) SELECT tile, CAST(model AS INTEGER) AS model, mse, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM r WHERE r = 1""",
)
def half_plane_model_fit(spark, sf):
    d = K.over_tiles(embeddings(spark, sf), "v", {"model": "int", "mse": "double", "c0": "double", "c1": "double"}, lambda v: list(K.two_bucket_fit(v)), ["tile"])
    return d.select("tile", "model", F.round("mse", 9).alias("mse"), F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


@register("res0_bias", f"WITH {_T} SELECT tile, CAST(least(127, greatest(-127, round_even(avg(v - w) * 255, 0))) AS INTEGER) AS bias FROM t GROUP BY 1")
def res0_bias(spark, sf):
    return K.over_tiles(embeddings(spark, sf), "v", {"bias": "int"}, lambda v: [np.clip(np.rint((v - np.rint(v * 8) / 8).mean(axis=1) * 255), -127, 127).astype(int)], ["tile"])


@register(
    "res1_grid",
    f"""WITH {_T} SELECT tile, CAST(y // 2 * 4 + x // 2 AS INTEGER) AS cell, CAST(least(127, greatest(-127, round_even(avg(v - w) * 255, 0))) AS INTEGER) AS q FROM t GROUP BY ALL""",
)
def res1_grid(spark, sf):
    def kernel(v):
        e = (v - np.rint(v * 8) / 8).reshape(-1, 4, 2, 4, 2).mean(axis=(2, 4)).reshape(-1, 16)
        return [np.clip(np.rint(e * 255), -127, 127)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"q": "array<int>"}, kernel, ["tile"])
    return d.select("tile", F.posexplode("q").alias("cell", "q"))


@register(
    "sparse_atoms",
    f"""WITH {_T}, a AS (SELECT tile, p, CAST(round_even((v - w) * 255, 0) AS INTEGER) AS d, row_number() OVER (PARTITION BY tile ORDER BY round(abs(v - w), 9) DESC, p) AS r FROM t)
    SELECT tile, p, d FROM a WHERE r <= 4 AND abs(d) >= 2""",
)
def sparse_atoms(spark, sf):
    """The four largest residuals of each tile, without those below two levels."""
    d = embeddings(spark, sf)
    atoms = F.transform("v", lambda e, p: F.struct((-F.round(F.abs(e - F.rint(e * 8) / 8), 9)).alias("m"), p.alias("p"), F.rint((e - F.rint(e * 8) / 8) * 255).cast("int").alias("d")))
    d = d.select("tile", F.explode(F.slice(F.array_sort(atoms), 1, 4)).alias("a"))
    return d.filter(F.abs("a.d") >= 2).select("tile", "a.p", "a.d")


@register(
    "bilinear_upsample",
    f"""WITH {_T}, o AS (SELECT CAST(a.range AS INTEGER) AS oy, CAST(b.range AS INTEGER) AS ox, least(7.0, greatest(0.0, (a.range + 0.5) / 2 - 0.5)) AS fy, least(7.0, greatest(0.0, (b.range + 0.5) / 2 - 0.5)) AS fx FROM range(16) a, range(16) b)
    SELECT t.tile, oy * 16 + ox AS p, round(sum(v * greatest(0, 1 - abs(y - fy)) * greatest(0, 1 - abs(x - fx))), 6) AS v FROM o JOIN t ON abs(y - fy) < 1 AND abs(x - fx) < 1 GROUP BY ALL""",
)
def bilinear_upsample(spark, sf):
    at = np.clip((np.arange(16) + 0.5) / 2 - 0.5, 0, 7)
    m = np.maximum(0, 1 - np.abs(np.arange(8)[None, :] - at[:, None]))
    d = K.over_tiles(embeddings(spark, sf), "v", {"u": "array<double>"}, lambda v: [np.einsum("ai,tij,bj->tab", m, v.reshape(-1, 8, 8), m).reshape(-1, 256)], ["tile"])
    return d.select("tile", F.posexplode("u").alias("p", "v")).withColumn("v", F.round("v", 6))


@register(
    "nearest_upsample",
    f"""WITH {_T} SELECT tile, CAST(a.range * 12 + b.range AS INTEGER) AS p, v FROM t JOIN range(12) a ON a.range * 8 // 12 = y JOIN range(12) b ON b.range * 8 // 12 = x""",
)
def nearest_upsample(spark, sf):
    at = np.arange(12) * 8 // 12
    place = (at[:, None] * 8 + at[None, :]).reshape(-1).tolist()
    picked = F.transform(F.array(*map(F.lit, place)), lambda i: F.get("v", i))
    return embeddings(spark, sf).select("tile", F.posexplode(picked).alias("p", "v"))


@register("box_downsample", f"WITH {_T} SELECT tile, CAST(((y + 1) * 3 - 1) // 8 * 3 + ((x + 1) * 3 - 1) // 8 AS INTEGER) AS cell, round(avg(v), 6) AS v FROM t GROUP BY ALL")
def box_downsample(spark, sf):
    """Means of 3 by 3 cells of unequal size."""
    cell = ((np.arange(8) + 1) * 3 - 1) // 8
    m = (cell[None, :] == np.arange(3)[:, None]) / np.bincount(cell)[:, None]
    d = K.over_tiles(embeddings(spark, sf), "v", {"c": "array<double>"}, lambda v: [np.einsum("ai,tij,bj->tab", m, v.reshape(-1, 8, 8), m).reshape(-1, 9)], ["tile"])
    return d.select("tile", F.posexplode("c").alias("cell", "v")).withColumn("v", F.round("v", 6))


def _hat():
    h = K.bernstein(8) @ K.bernstein_inverse(8)
    return ", ".join(f"({i}, {j}, {h[i, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for i in range(8) for j in range(8))


@register(
    "bicubic_fit_eval",
    f"""WITH {_T}, h(i, j, c) AS (VALUES {_hat()}), r AS (SELECT tile, a.i * 8 + b.i AS p, sum(v * a.c * b.c) AS r FROM t JOIN h a ON a.j = y JOIN h b ON b.j = x GROUP BY ALL)
    SELECT tile, round(avg(power(v - r, 2)), 6) AS mse, round(max(r), 6) AS top FROM t JOIN r USING (tile, p) GROUP BY 1""",
)
def bicubic_fit_eval(spark, sf):
    def kernel(v):
        r = K.bicubic_eval(K.bicubic_fit(v), 8)
        return [((v - r) ** 2).mean(axis=1), r.max(axis=1)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"mse": "double", "top": "double"}, kernel, ["tile"])
    return d.select("tile", F.round("mse", 6).alias("mse"), F.round("top", 6).alias("top"))


@register(
    "tile_budget_allocation",
    f"""WITH {_T}, a AS (SELECT tile, image, round(stddev_pop(v), 9) AS act FROM t GROUP BY ALL), e AS (SELECT *, act * 1000.0 / sum(act) OVER (PARTITION BY image) AS x FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(x - floor(x), 9) DESC, tile) AS r, 1000 - sum(floor(x)) OVER (PARTITION BY image) AS rest FROM e)
    SELECT tile, image, CAST(floor(x) + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS budget FROM r""",
)
def tile_budget_allocation(spark, sf):
    d = K.over_tiles(embeddings(spark, sf), "v", {"act": "double"}, lambda v: [np.round(v.std(axis=1), 9)], ["tile", "image"])
    return R.largest_remainder(d, "act", 1000, ["image"], ["tile"]).select("tile", "image", "budget")


@register(
    "poisson_roundtrip",
    f"WITH {_T} SELECT tile, 0.0::DOUBLE AS worst, round(avg(v), 6) AS mean FROM t GROUP BY 1",
)
def poisson_roundtrip(spark, sf):
    """A tile's exact gradients and mean give it back: the worst error rounds to 0."""

    def kernel(v):
        r = K.poisson(*K.forward(v), v.mean(axis=1))
        return [np.abs(np.round(np.abs(r - v).max(axis=1), 6)), r.mean(axis=1)]

    d = K.over_tiles(embeddings(spark, sf), "v", {"worst": "double", "mean": "double"}, kernel, ["tile"])
    return d.select("tile", "worst", F.round("mean", 6).alias("mean"))


@register("retinex_split")
def retinex_split(spark, sf):
    def kernel(v):
        albedo, light = K.retinex(v - v.min(axis=1, keepdims=True) + 0.05)
        return [albedo.mean(axis=1), light.mean(axis=1)]

    return K.over_tiles(embeddings(spark, sf), "v", {"albedo": "double", "light": "double"}, kernel, ["tile"])


@register("ssim_tiles")
def ssim_tiles(spark, sf):
    return K.over_tiles(embeddings(spark, sf), "v", {"ssim": "double"}, lambda v: [K.ssim(v, np.rint(v * 8) / 8)], ["tile"])
