"""Queries that draw scenes: an embedding is a macro tile of one, four or sixteen leaves whose colours are its components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.operators import primitives as P
from tilespark.operators import scene as S
from tilespark.plans.catalogue import register
from tilespark.session import table

#: Macro tiles of an image (across, down), and the image's size, which cuts the outer ones.
ACROSS, DOWN, WIDTH, HEIGHT = 4, 3, 120, 90


def _component(n):
    """A component of the embedding as a colour."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(F.col("embedding"), (n % 64).cast("int")).cast("double") + 0.5))


def _stack(j, s):
    """A constant, a half transparent ramp, a line and a triangle, for leaf j of size s."""
    colour = lambda m, k: F.array(*[_component(j * m + k + c) for c in range(3)])
    n = lambda *v: F.array(*[x.cast("double") if hasattr(x, "cast") else F.lit(float(x)) for x in v])
    layer = lambda kind, geom, c0, c1, a: F.struct(F.lit(kind).alias("kind"), geom.alias("geom"), c0.alias("color0"), c1.alias("color1"), F.lit(a).alias("alpha"))
    none = F.lit(None).cast("array<double>")
    return F.array(
        layer(P.CONST, F.array().cast("array<double>"), colour(7, 0), none, 1.0),
        layer(P.LINEAR, n(0, 0, s - 1, (j % 3) * 4), colour(5, 3), colour(5, 6), 0.5),
        layer(P.LINE, n(1, 2, s - 2, s - 3, 1), colour(3, 9), none, 0.7),
        layer(P.TRIANGLE, n(0.25, 0.1, s - F.lit(0.8), 0.3, 0.4, s - F.lit(0.55)), colour(3, 12), none, 0.4),
    ).cast(f"array<{P.DDL}>")


def leaves(spark, sf):
    """Macro tiles with one leaf of 32, four of 16 or sixteen of 8."""
    k = F.col("vec_id")
    d = table(spark, sf, "embeddings").select((F.expr(f"vec_id div {ACROSS * DOWN}")).alias("image"), k, "embedding", (k % 3).cast("int").alias("mode"))
    d = d.withColumn("j", F.explode(F.expr("sequence(0, shiftleft(1, 2 * mode) - 1)"))).withColumn("size", F.expr("shiftright(32, mode)"))
    side = F.expr("shiftleft(1, mode)")
    j, s = F.col("j"), F.col("size")
    y = F.expr(f"vec_id % {ACROSS * DOWN} div {ACROSS} * 32") + F.floor(j / side) * s
    x = F.expr(f"vec_id % {ACROSS} * 32") + j % side * s
    bias = F.array((k % 7 - 3).cast("int"), (j % 5 - 2).cast("int"), F.lit(1))
    return d.select("image", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), y.cast("int").alias("y"), x.cast("int").alias("x"), "size", _stack(j, s).alias("prims"), bias.alias("bias"),
                    F.lit(None).cast("array<double>").alias("grid"))


def _sums(d, keys):
    return d.groupBy(*keys, "ch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.sum(F.col("v") * ((F.col("y") * 7 + F.col("x") * 3) % 11)) / F.count(F.lit(1)), 6).alias("weighted"))


_SUMS = "count(*) AS n, round(avg(v), 6) AS mean, round(sum(v * ((y * 7 + x * 3) % 11)) / count(*), 6) AS weighted"
_C = "least(1.0, greatest(0.0, embedding[CAST(({}) % 64 AS INTEGER) + 1]::DOUBLE + 0.5))"


def _drawn(leaf: str, px: str) -> str:
    """CTEs l (leaves), p (their pixels) and v (samples): py, px are sampled coordinates inside a leaf of size s, y and x the pixel's place."""
    c = lambda m, k: _C.format(f"j * {m} + {k} + ch")
    return f"""l AS ({leaf}), p AS ({px}),
    h AS (SELECT *, least(1.0, greatest(0.0, (sx * (s - 1) + sy * (j % 3) * 4) / ((s - 1) * (s - 1) + (j % 3) * 4 * (j % 3) * 4 + 1e-8))) AS t,
      least(1.0, greatest(0.0, ((sx - 1) * (s - 3) + (sy - 2) * (s - 5)) / ((s - 3) * (s - 3) + (s - 5) * (s - 5))::DOUBLE)) AS f,
      (0.3 - (s - 0.55)) * (0.25 - 0.4) + (0.4 - (s - 0.8)) * (0.1 - (s - 0.55)) AS d FROM p),
    m AS (SELECT *, 0.7 * exp(-(power(sx - 1 - f * (s - 3), 2) + power(sy - 2 - f * (s - 5), 2)) / 2) AS a2,
      ((0.3 - (s - 0.55)) * (sx - 0.4) + (0.4 - (s - 0.8)) * (sy - (s - 0.55))) / d AS u, (((s - 0.55) - 0.1) * (sx - 0.4) + (0.25 - 0.4) * (sy - (s - 0.55))) / d AS w FROM h),
    o AS (SELECT *, {c(7, 0)} AS k0, {c(5, 3)} AS k1, {c(5, 6)} AS k2, {c(3, 9)} AS k3, {c(3, 12)} AS k4, CASE WHEN u >= 0 AND w >= 0 AND u + w <= 1 THEN 0.4 ELSE 0 END AS a3,
      CASE ch WHEN 0 THEN vec_id % 7 - 3 WHEN 1 THEN j % 5 - 2 ELSE 1 END / 255.0::DOUBLE AS bias FROM m, (SELECT CAST(range AS INTEGER) AS ch FROM range(3)) c),
    v AS (SELECT *, least(1.0, greatest(0.0, k4 * a3 + (k3 * a2 + (((1 - t) * k1 + t * k2) * 0.5 + k0 * 0.5) * (1 - a2)) * (1 - a3) + bias)) AS v FROM o)"""


_LEAF = f"""SELECT vec_id, embedding, vec_id // {ACROSS * DOWN} AS image, CAST(j.range AS INTEGER) AS j, CAST(32 >> (vec_id % 3)::INTEGER AS INTEGER) AS s,
  CAST(vec_id % {ACROSS * DOWN} // {ACROSS} * 32 + j.range // (1 << (vec_id % 3)::INTEGER) * (32 >> (vec_id % 3)::INTEGER) AS INTEGER) AS y0,
  CAST(vec_id % {ACROSS} * 32 + j.range % (1 << (vec_id % 3)::INTEGER) * (32 >> (vec_id % 3)::INTEGER) AS INTEGER) AS x0
  FROM embeddings, range(16) j WHERE j.range < (1 << (2 * (vec_id % 3))::INTEGER)"""
_PX = f"""SELECT l.*, a.range + 0.5::DOUBLE AS sy, b.range + 0.5::DOUBLE AS sx, CAST(y0 + a.range AS INTEGER) AS y, CAST(x0 + b.range AS INTEGER) AS x FROM l, range(32) a, range(32) b
  WHERE a.range < s AND b.range < s AND y0 + a.range < {HEIGHT} AND x0 + b.range < {WIDTH}"""


@register("scene_render", f"WITH {_drawn(_LEAF, _PX)} SELECT image, CAST(y // 32 AS INTEGER) AS my, CAST(x // 32 AS INTEGER) AS mx, ch, {_SUMS} FROM v GROUP BY ALL")
def scene_render(spark, sf):
    """Leaves of three sizes drawn into their images."""
    d = S.pixels(S.macros(leaves(spark, sf)))
    return _sums(d.withColumn("my", F.expr("y div 32").cast("int")).withColumn("mx", F.expr("x div 32").cast("int")), ["image", "my", "mx"])


#: The target: two thirds wider and half again as high, so borders fall between pixels.
_TH, _TW = 135, 200
_SCALED = f"""SELECT *, (a.range + 0.5) * s / px::DOUBLE AS sy, (b.range + 0.5) * s / px::DOUBLE AS sx, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x FROM
  (SELECT *, greatest(rows, cols) AS px FROM (SELECT *, greatest(1, ty1 - ty) AS rows, greatest(1, tx1 - tx) AS cols FROM (SELECT *, round_even(y0 * ({_TH} / {HEIGHT}::DOUBLE), 0)::INT AS ty, round_even(x0 * ({_TW} / {WIDTH}::DOUBLE), 0)::INT AS tx,
    round_even((y0 + s) * ({_TH} / {HEIGHT}::DOUBLE), 0)::INT AS ty1, round_even((x0 + s) * ({_TW} / {WIDTH}::DOUBLE), 0)::INT AS tx1 FROM l))), range(64) a, range(64) b WHERE a.range < rows AND b.range < cols"""


@register("scene_render_scaled", f"WITH {_drawn(_LEAF, _SCALED)} SELECT image, ty, tx, CAST(rows AS INTEGER) AS rows, CAST(cols AS INTEGER) AS cols, ch, {_SUMS} FROM v GROUP BY ALL")
def scene_render_scaled(spark, sf):
    """The same leaves at another resolution, each sampled anew."""
    d = S.scaled(leaves(spark, sf).withColumn("th", F.lit(_TH)).withColumn("tw", F.lit(_TW)), "th", "tw")
    d = d.select("image", F.col("y").alias("ty"), F.col("x").alias("tx"), "rows", "cols", F.posexplode("v").alias("i", "v"))
    d = d.withColumn("y", F.expr("i div (3 * cols)")).withColumn("x", F.expr("i div 3 % cols")).withColumn("ch", (F.col("i") % 3).cast("int"))
    return _sums(d, ["image", "ty", "tx", "rows", "cols"])


_GRID = "embedding[(({a}) * 4 + ({b})) * 3 + ch + 1]::DOUBLE * 0.25"
_ULEAF = """SELECT *, CAST(k // 8 * 16 AS INTEGER) AS y0, CAST(k % 8 * 16 AS INTEGER) AS x0, 16 AS s FROM (SELECT vec_id, embedding, vec_id // 48 AS image, CAST(vec_id % 48 AS INTEGER) AS k, CAST(vec_id % 5 AS INTEGER) AS j FROM embeddings)"""
_AT = "least(3.0, greatest(0.0, ({} % 16 + 0.5) * 4 / 16 - 0.5))"


@register(
    "scene_render_uniform",
    f"""WITH {_drawn(_ULEAF, _PX)},
    g AS (SELECT *, {_AT.format("y")} AS gy, {_AT.format("x")} AS gx FROM v),
    q AS (SELECT *, CAST(floor(gy) AS INTEGER) AS ya, CAST(floor(gx) AS INTEGER) AS xa, CAST(least(3, floor(gy) + 1) AS INTEGER) AS yb, CAST(least(3, floor(gx) + 1) AS INTEGER) AS xb FROM g),
    r0 AS (SELECT image, y, x, ch, least(1.0, greatest(0.0, v + (1 - (gy - ya)) * ((1 - (gx - xa)) * {_GRID.format(a="ya", b="xa")} + (gx - xa) * {_GRID.format(a="ya", b="xb")})
      + (gy - ya) * ((1 - (gx - xa)) * {_GRID.format(a="yb", b="xa")} + (gx - xa) * {_GRID.format(a="yb", b="xb")}))) AS v FROM q),
    f AS (SELECT image, CAST(my * 32 + a.range AS INTEGER) AS y, CAST(mx * 32 + b.range AS INTEGER) AS x, CAST(c.range AS INTEGER) AS ch FROM (SELECT DISTINCT image, y // 32 AS my, x // 32 AS mx FROM r0), range(32) a, range(32) b, range(3) c),
    r AS (SELECT image, y, x, ch, coalesce(v, 0) AS v FROM f LEFT JOIN r0 USING (image, y, x, ch) WHERE y < {HEIGHT} AND x < {WIDTH}),
    e AS (SELECT image, y, x, ch, CASE WHEN x % 16 = 15 THEN (v + coalesce(lead(v) OVER w, v)) / 2 WHEN x % 16 = 0 THEN (v + coalesce(lag(v) OVER w, v)) / 2 ELSE v END AS v FROM r WINDOW w AS (PARTITION BY image, ch, y ORDER BY x)),
    z AS (SELECT image, y, x, ch, CASE WHEN y % 16 = 15 THEN (v + coalesce(lead(v) OVER w, v)) / 2 WHEN y % 16 = 0 THEN (v + coalesce(lag(v) OVER w, v)) / 2 ELSE v END AS v FROM e WINDOW w AS (PARTITION BY image, ch, x ORDER BY y))
    SELECT image, CAST(y // 32 AS INTEGER) AS my, CAST(x // 32 AS INTEGER) AS mx, ch, {_SUMS} FROM z GROUP BY ALL""",
)
def scene_render_uniform(spark, sf):
    """A grid of tiles of 16, with corrections of 4 by 4 and smoothed seams over both axes."""
    k = F.col("vec_id")
    d = table(spark, sf, "embeddings").select(F.expr("vec_id div 48").alias("image"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), (k % 48).cast("int").alias("tile"), k, "embedding", (k % 5).cast("int").alias("j"))
    bias = F.array((k % 7 - 3).cast("int"), (F.col("j") % 5 - 2).cast("int"), F.lit(1))
    grid = F.transform(F.slice("embedding", 1, 48), lambda v: v.cast("double") * 0.25)
    d = d.select("image", "height", "width", "tile", _stack(F.col("j"), F.lit(16)).alias("prims"), bias.alias("bias"), grid.alias("grid"))
    p = S.pixels(S.uniform(d, 16))
    return _sums(p.withColumn("my", F.expr("y div 32").cast("int")).withColumn("mx", F.expr("x div 32").cast("int")), ["image", "my", "mx"])
