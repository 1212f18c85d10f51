"""Queries on colour tiles of mixed size: adaptive extraction, and residual layers by size and chroma mode."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilespark.operators import residual as R
from tilespark.operators import tiles as T
from tilespark.operators.layers import ragged
from tilespark.plans.catalogue import register
from tilespark.session import table

#: Embeddings of an image (across and down): 10 tiles of 8 are 80 pixels, which macro tiles of 32 exceed.
ACROSS, TILE, SIDE = 10, 8, 32
_THRESHOLD = 0.012


def _pixels(spark, sf):
    d = table(spark, sf, "embeddings").select(F.expr(f"vec_id div {ACROSS * ACROSS}").alias("image"), (F.col("vec_id") % (ACROSS * ACROSS)).alias("k"), F.posexplode("embedding").alias("p", "v"))
    y, x = F.expr(f"k div {ACROSS} * {TILE} + p div {TILE}"), F.expr(f"k % {ACROSS} * {TILE} + p % {TILE}")
    return d.select("image", y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("v").cast("double").alias("v"))


@register(
    "adaptive_extraction",
    f"""WITH p AS (SELECT vec_id // 100 AS image, CAST(vec_id % 100 // 10 * 8 + i // 8 AS INTEGER) AS y, CAST(vec_id % 100 % 10 * 8 + i % 8 AS INTEGER) AS x, v
      FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)),

    e AS MATERIALIZED (SELECT p.image, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, v FROM p, range(96) a, range(96) b
      WHERE (a.range = p.y OR p.y = 79 AND a.range > 79) AND (b.range = p.x OR p.x = 79 AND b.range > 79)),
    a AS (SELECT image, 32 AS size, y // 32 AS "by", x // 32 AS bx, round(var_pop(v), 9) AS variance FROM e GROUP BY ALL),
    b AS (SELECT e.image, 16 AS size, y // 16 AS "by", x // 16 AS bx, round(var_pop(v), 9) AS variance FROM e JOIN a ON e.image = a.image AND y // 32 = a."by" AND x // 32 = a.bx AND a.variance >= {_THRESHOLD} GROUP BY ALL),
    c AS (SELECT e.image, 8 AS size, y // 8 AS "by", x // 8 AS bx, round(var_pop(v), 9) AS variance FROM e JOIN b ON e.image = b.image AND y // 16 = b."by" AND x // 16 = b.bx AND b.variance >= {_THRESHOLD} GROUP BY ALL),
    l AS (FROM a WHERE variance < {_THRESHOLD} UNION ALL FROM b WHERE variance < {_THRESHOLD} UNION ALL FROM c)
    SELECT l.image, CAST(size AS INTEGER) AS size, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, count(*) AS n, round(avg(v), 7) AS mean, round(avg(v * ((y % size) * 5 + (x % size) * 3)), 6) AS weighted
    FROM l JOIN e ON e.image = l.image AND y // size = l."by" AND x // size = l.bx GROUP BY ALL""",
)
def adaptive_extraction(spark, sf):
    """Quadtree leaves of 32, 16 and 8 with their samples; what macro tiles have beyond an image repeats its edge."""
    px = _pixels(spark, sf)
    edge = F.lit(ACROSS * TILE)
    macros = T.cut(px, edge, edge, SIDE, ["image"])
    whole = macros.select("image", "ty", "tx", F.posexplode("samples").alias("p", "v"))
    padded = whole.select("image", (F.col("ty") * SIDE + F.expr(f"p div {SIDE}")).cast("int").alias("y"), (F.col("tx") * SIDE + F.col("p") % SIDE).cast("int").alias("x"), "v")
    leaves = T.split_levels(padded, ["image"], SIDE, 8, _THRESHOLD).drop("variance")
    d = R.extract(macros, leaves, ["image"], SIDE)
    at = lambda i: F.floor(i / F.col("size")) * 5 + i % F.col("size") * 3
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return d.select("image", "size", "by", "bx", F.size("v").cast("long").alias("n"), F.round(total(F.col("v")), 7).alias("mean"), F.round(total(F.transform("v", lambda x, i: x * at(i))), 6).alias("weighted"))


def _colour_tiles(spark, sf):
    """Tiles of 8, 16 and 32 in all three modes, with a scale each; ``_samples`` makes their samples of the vector."""
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").select(k.alias("tile"), F.expr("shiftleft(8, cast(vec_id % 3 as int))").alias("size"), F.expr("cast(vec_id div 3 % 3 as int)").alias("mode"), (F.lit(0.5) + (k % 4) * 0.5).alias("scale"), "embedding")


def _samples(embedding, size):
    """Sample (y, x, c) is component y * 5 + x * 3 + c * 11 + y * x, halved; NaN where a vector lacks it."""
    y, x, c = np.mgrid[:size, :size, :3]
    longest = int(embedding.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0))
    v = ragged(embedding, max(64, longest), np.nan)
    return v[:, ((y * 5 + x * 3 + c * 11 + y * x) % 64).reshape(size * size, 3)] * 0.5


_STEP, _ALPHA = 0.02, 0.5
_BY_MODE = f"""t AS (SELECT vec_id AS tile, CAST(8 << CAST(vec_id % 3 AS INTEGER) AS INTEGER) AS size, CAST(vec_id // 3 % 3 AS INTEGER) AS mode, 0.5::DOUBLE + (vec_id % 4) * 0.5::DOUBLE AS scale, embedding FROM embeddings),
s AS (SELECT tile, size, mode, scale, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, [embedding[(a.range * 5 + b.range * 3 + c * 11 + a.range * b.range) % 64 + 1]::DOUBLE * 0.5 for c in [0, 1, 2]] AS v FROM t, range(32) a, range(32) b WHERE a.range < size AND b.range < size),
p AS (SELECT tile, size, mode, scale, y, x, CASE WHEN mode = 0 THEN v ELSE [0.299 * v[1] + 0.587 * v[2] + 0.114 * v[3], (v[3] - (0.299 * v[1] + 0.587 * v[2] + 0.114 * v[3])) / 1.772, (v[1] - (0.299 * v[1] + 0.587 * v[2] + 0.114 * v[3])) / 1.402] END AS v FROM s),
h AS (SELECT tile, mode, scale, c, size AS side, y, x, v[c + 1] AS v FROM p, (SELECT CAST(range AS INTEGER) AS c FROM range(3)) WHERE c = 0 OR mode < 2
  UNION ALL SELECT tile, mode, scale, c, size // 2, y // 2, x // 2, avg(v[c + 1]) FROM p, (SELECT CAST(range AS INTEGER) AS c FROM range(1, 3)) WHERE mode = 2 GROUP BY ALL),
k AS (SELECT CAST(n.range AS INTEGER) AS side, CAST(u.range AS INTEGER) AS u, CAST(i.range AS INTEGER) AS i, CASE WHEN u.range = 0 THEN sqrt(1.0 / n.range) ELSE sqrt(2.0 / n.range) END * cos(pi() * (2 * i.range + 1) * u.range / (2 * n.range)) AS w
  FROM (SELECT unnest([4, 8, 16, 32]) AS range) n, range(32) u, range(32) i WHERE u.range < n.range AND i.range < n.range),
r AS (SELECT tile, mode, scale, c, h.side, y, k.u AS j, sum(v * w) AS v FROM h JOIN k ON k.side = h.side AND k.i = x GROUP BY ALL),
f AS (SELECT tile, mode, scale, c, r.side, k.u AS i, j, sum(v * w) AS v FROM r JOIN k ON k.side = r.side AND k.i = y GROUP BY ALL),
q AS (SELECT tile, mode, c, side, i, j, CAST(greatest(-32767, least(32767, round_even(v / ({_STEP}::DOUBLE * CASE WHEN c > 0 AND mode > 0 THEN 1.5 ELSE 1 END * (1 + {_ALPHA}::DOUBLE * (i + j) / (2 * (side - 1))) * scale), 0))) AS BIGINT) AS q FROM f)"""


@register("residual_mixed_sizes", f"""WITH {_BY_MODE} SELECT tile, mode, c AS ch, CAST(side AS INTEGER) AS side, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, CAST(sum(abs(q)) AS BIGINT) AS size, CAST(sum(q * (i * 7 + j * 3 + 1)) AS BIGINT) AS weighted FROM q GROUP BY ALL""")
def residual_mixed_sizes(spark, sf):
    """Quantised transforms of tiles of 8, 16 and 32 in three chroma modes with a scale each."""
    d = R.coded(_colour_tiles(spark, sf), _STEP, _ALPHA, ["q"], ("embedding", _samples)).select("tile", "size", "mode", F.posexplode("q").alias("p", "q"))
    half = F.when(F.col("mode") == 2, F.expr("size div 2")).otherwise(F.col("size"))
    rest = F.col("p") - F.col("size") * F.col("size")
    ch = F.when(rest < 0, 0).otherwise(F.floor(rest / (half * half)) + 1).cast("int")
    side = F.when(rest < 0, F.col("size")).otherwise(half).cast("int")
    d = d.select("tile", "mode", ch.alias("ch"), side.alias("side"), F.when(rest < 0, F.col("p")).otherwise(rest % (half * half)).alias("p"), F.col("q").cast("long").alias("q"))
    at = F.floor(F.col("p") / F.col("side")) * 7 + F.col("p") % F.col("side") * 3 + 1
    return d.groupBy("tile", "mode", "ch", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"), F.sum(F.abs("q")).alias("size"), F.sum(F.col("q") * at).cast("long").alias("weighted"))


_ERROR = f"""WITH {_BY_MODE}, g AS (SELECT q.*, q * {_STEP}::DOUBLE * CASE WHEN c > 0 AND q.mode > 0 THEN 1.5 ELSE 1 END * (1 + {_ALPHA}::DOUBLE * (i + j) / (2 * (side - 1))) * scale AS v FROM q JOIN t USING (tile)),
a AS (SELECT tile, mode, c, g.side, g.i AS i, k.i AS x, sum(v * w) AS v FROM g JOIN k ON k.side = g.side AND k.u = j GROUP BY tile, mode, c, g.side, g.i, k.i),
b AS (SELECT tile, mode, c, a.side, k.i AS y, x, sum(v * w) AS v FROM a JOIN k ON k.side = a.side AND k.u = a.i GROUP BY tile, mode, c, a.side, k.i, x),
o AS (SELECT s.tile, s.y, s.x, s.v, max(b.v) FILTER (c = 0) AS l, max(b.v) FILTER (c = 1) AS m, max(b.v) FILTER (c = 2) AS n, any_value(s.mode) AS mode, any_value(s.size) AS size
  FROM s JOIN b ON b.tile = s.tile AND b.y = s.y * b.side // s.size AND b.x = s.x * b.side // s.size GROUP BY ALL),
e AS (SELECT *, CASE WHEN mode = 0 THEN [l, m, n] ELSE [l + 1.402 * n, (l - 0.299 * (l + 1.402 * n) - 0.114 * (l + 1.772 * m)) / 0.587, l + 1.772 * m] END AS back FROM o)
SELECT tile, CAST(any_value(size) AS INTEGER) AS size, any_value(mode) AS mode, round(avg((power(back[1] - v[1], 2) + power(back[2] - v[2], 2) + power(back[3] - v[3], 2)) / 3), 8) AS mse FROM e GROUP BY tile"""


@register("residual_restored", _ERROR)
def residual_restored(spark, sf):
    """What the same tiles lose by it."""
    return R.coded(_colour_tiles(spark, sf), _STEP, _ALPHA, ["mse"], ("embedding", _samples)).select("tile", "size", "mode", F.round("mse", 8).alias("mse"))
