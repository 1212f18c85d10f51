"""Queries on the pieces of the candidate search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilespark.operators import search as S
from tilespark.plans import tiles_q as Q
from tilespark.plans.catalogue import register
from tilespark.session import table


@register("primitive_counts_by_kind", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_id % 5 = {k}) AS kind{k}" for k in range(5)) + ", count(*) AS n FROM events GROUP BY 1")
def primitive_counts_by_kind(spark, sf):
    """Primitives of each tile by kind: a pivot of one aggregate."""
    d = table(spark, sf, "events").select("user_id", (F.col("event_id") % 5).alias("kind"))
    return d.groupBy("user_id").agg(*[F.count_if(F.col("kind") == k).alias(f"kind{k}") for k in range(5)], F.count(F.lit(1)).alias("n"))


@register("tile_capacity", "SELECT p_partkey, p_size, CASE p_size WHEN 8 THEN 24 WHEN 16 THEN 48 WHEN 32 THEN 96 ELSE 48 END AS capacity FROM part")
def tile_capacity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", S.capacity(F.col("p_size")).alias("capacity"))


@register("split_thresholds", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity * 2 < 70 THEN 0.12::DOUBLE WHEN l_quantity * 2 < 90 THEN 0.08::DOUBLE ELSE 0.03::DOUBLE END * greatest(0.1::DOUBLE, least(1.0::DOUBLE, CAST(l_discount AS DOUBLE) * 12)), 9) AS threshold FROM lineitem""")
def split_thresholds(spark, sf):
    t = S.split_threshold(F.col("l_quantity") * 2, F.col("l_discount").cast("double") * 12)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(t, 9).alias("threshold"))


@register("complexity_gate", f"""WITH {Q._T} SELECT tile, image, tile % 20 + 80 AS quality FROM t GROUP BY tile, image HAVING avg(power(v - w, 2)) > CASE WHEN tile % 20 >= 10 THEN 5e-5 ELSE 5e-4 END AND tile % 7 > 0""")
def complexity_gate(spark, sf):
    """Tiles that greedy rounds go on with."""
    e = F.aggregate(F.zip_with("v", Q.coarse(F.col("v")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / 64
    d = Q.embeddings(spark, sf).withColumn("quality", F.col("tile") % 20 + 80)
    return d.filter(S.worth_refining(e, F.col("quality"), F.col("tile") % 7)).select("tile", "image", "quality")


_PRESET = ", ".join(f"('{k}', '{v}')" for k, v in S.MOST_COMPUTE.items())


@register("max_compute_preset", f"""WITH d(flag, value) AS (VALUES {_PRESET}), k AS (SELECT c_custkey FROM customer)
    SELECT c_custkey, flag, CASE WHEN flag = 'beam_width' AND c_custkey % 3 = 0 THEN CAST(c_custkey % 9 AS VARCHAR) ELSE value END AS value FROM k, d
    UNION ALL SELECT c_custkey, 'own', 'yes' FROM k WHERE c_custkey % 3 = 0""")
def max_compute_preset(spark, sf):
    """A preset's defaults below each configuration's own flags."""
    own = F.create_map(F.lit("beam_width"), (F.col("c_custkey") % 9).cast("string"), F.lit("own"), F.lit("yes"))
    d = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, own).alias("flags"))
    return d.select("c_custkey", F.explode(S.with_most_compute(F.col("flags"))).alias("flag", "value"))


@register("max_compute_settings", "SELECT p_partkey, greatest(p_size * 2, 95)::INT AS quality, greatest(p_size, 48)::INT AS max_primitives, true AS enable_res0, true AS enable_res1 FROM part")
def max_compute_settings(spark, sf):
    """What the preset raises or switches on beside its flags."""
    size = F.col("p_size").cast("int")
    return table(spark, sf, "part").select("p_partkey", *S.raised_to_most_compute(size * 2, size))


_TEMPLATES = ", ".join(f"('{b}', {m}, {k}, {[float(x) for x in g]}::DOUBLE[])" for b, m, k, g in S.TEMPLATES)


@register("primitives_from_models", f"""WITH t(bank, model, kind, geometry) AS (VALUES {_TEMPLATES}), e AS (SELECT event_id, event_id % 21 AS m, CASE WHEN user_id % 2 = 0 THEN 'rich18' ELSE 'simple5' END AS bank FROM events),
    k AS (SELECT *, CASE WHEN bank = 'rich18' THEN least(m, 17) WHEN m > 4 THEN 0 ELSE m END AS model FROM e)
    SELECT event_id, k.bank, CAST(m AS INTEGER) AS model, CAST(kind AS INTEGER) AS kind, coalesce(list_sum(geometry), 0) AS geometry, len(geometry) AS n FROM k JOIN t USING (bank, model)""")
def primitives_from_models(spark, sf):
    """Fitted models to primitives by a table of templates."""
    d = table(spark, sf, "events").select("event_id", (F.col("event_id") % 21).cast("int").alias("model"), F.when(F.col("user_id") % 2 == 0, "rich18").otherwise("simple5").alias("bank"))
    total = F.aggregate("geometry", F.lit(0.0), lambda s, x: s + x)
    return S.from_models(d).select("event_id", "bank", "model", "kind", total.alias("geometry"), F.size("geometry").cast("long").alias("n"))


@register("top_models_per_tile", f"""WITH {Q._T}, m AS (SELECT tile, CAST(m.range AS INTEGER) AS model, CASE WHEN p % (m.range + 2) = 0 THEN 1 ELSE 0 END AS side, v FROM t, range(8) m),
    s AS (SELECT tile, model, sum(e) / 64 AS mse FROM (SELECT tile, model, var_pop(v) * count(*) AS e FROM m GROUP BY tile, model, side) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile ORDER BY round(mse + 1e-5 * 8 * (7 + model), 9), model) AS INTEGER) AS place FROM s)
    SELECT tile, model, round(mse, 7) AS mse, place FROM r WHERE place <= 4""")
def top_models_per_tile(spark, sf):
    """Eight two-sided models for each tile, the four best by rate and distortion."""
    d = Q.embeddings(spark, sf).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(7))))
    side = lambda one: F.filter("v", lambda x, i: (i % (F.col("model") + 2) == 0) if one else (i % (F.col("model") + 2) != 0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rest = lambda a: total(F.transform(a, lambda x: x * x)) - F.pow(total(a), F.lit(2.0)) / F.size(a)
    d = d.withColumn("a", side(True)).withColumn("b", side(False)).withColumn("mse", (rest(F.col("a")) + rest(F.col("b"))) / 64).withColumn("bits", 8 * (7 + F.col("model")))
    return S.top_models(d, ["tile"], "mse", "bits", "model", 1e-5).select("tile", "model", F.round("mse", 7).alias("mse"), "place")


@register("palette_near_duplicates", f"""WITH {Q._T}, c AS (SELECT tile, p // 3 AS i, list(round(v, 3) ORDER BY p) AS c FROM t WHERE p < 63 GROUP BY ALL), l AS (SELECT tile, list([c] ORDER BY i) AS l FROM c GROUP BY 1),
    r AS (SELECT tile, list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: power(k[1] - x[1][1], 2) + power(k[2] - x[1][2], 2) + power(k[3] - x[1][3], 2) < 0.02)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM l)
    SELECT tile, CAST(len(kept) AS INTEGER) AS n, round(list_sum(list_transform(kept, lambda k: k[1] + 2 * k[2] + 3 * k[3])), 6) AS total FROM r""")
def palette_near_duplicates(spark, sf):
    """Colours (three samples each) in order, less those near a kept one."""
    colours = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice("v", i * 3 + 1, 3), lambda x: F.round(x, 3)))
    d = Q.embeddings(spark, sf).select("tile", S.distinct_colours(colours, 0.02).alias("kept"))
    total = F.aggregate("kept", F.lit(0.0), lambda s, k: s + k[0] + 2 * k[1] + 3 * k[2])
    return d.select("tile", F.size("kept").alias("n"), F.round(total, 6).alias("total"))


@register("unused_encodings", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (FROM lineitem u WHERE u.l_linenumber = 1 AND u.l_suppkey = lineitem.l_suppkey AND u.l_quantity = lineitem.l_quantity AND u.l_discount = lineitem.l_discount)""")
def unused_encodings(spark, sf):
    """Candidates whose exact encoding no chosen one has."""
    d = table(spark, sf, "lineitem")
    key = ["l_suppkey", "l_quantity", "l_discount"]
    return S.unused(d, d.filter("l_linenumber = 1"), key).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_ATOM = f"""{Q._T}, e AS (SELECT tile, p, v, w, v - w AS e, row_number() OVER (PARTITION BY tile ORDER BY abs(v - w) DESC, p) AS r FROM t), b AS (SELECT tile, p AS pix, CAST(greatest(-127, least(127, round_even(e * 255, 0))) AS INTEGER) AS delta FROM e WHERE r = 1)"""


@register("best_residual_atom", f"""WITH {_ATOM} SELECT tile, pix, delta, round(avg(power(v - CASE WHEN p = pix THEN greatest(0.0, least(1.0, w + delta / 255.0::DOUBLE)) ELSE w END, 2)) + 1e-5 * 88, 7) AS objective FROM e JOIN b USING (tile) GROUP BY ALL""")
def best_residual_atom(spark, sf):
    """The single best atom over a coarse prediction, and the objective with it."""
    d = Q.embeddings(spark, sf).withColumn("w", Q.coarse(F.col("v"))).withColumn("a", S.best_atom(F.col("v"), F.col("w")))
    made = S.with_atoms(F.col("w"), F.array("a"), 64)
    mse = F.aggregate(F.zip_with("v", made, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / 64
    return d.select("tile", "a.pix", "a.delta", F.round(mse + 1e-5 * 88, 7).alias("objective"))


@register("sparse_atoms_applied", f"""WITH {Q._T}, a AS (SELECT tile, p, w, CASE WHEN (p - tile) % 16 = 0 THEN CAST(p % 5 - 2 AS INTEGER) * 20 END AS delta FROM t)
    SELECT tile, round(sum(CASE WHEN delta IS NULL THEN w ELSE greatest(0.0, least(1.0, w + delta / 255.0::DOUBLE)) END * (p + 1)), 6) AS total FROM a GROUP BY 1""")
def sparse_atoms_applied(spark, sf):
    """Four atoms a tile, and one outside it that has no effect."""
    pix = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: (p - F.col("tile")) % 16 == 0)
    atoms = F.concat(F.transform(pix, lambda p: F.struct(p.alias("pix"), ((p % 5 - 2) * 20).alias("delta"))), F.array(F.struct(F.lit(64).alias("pix"), F.lit(99).alias("delta"))))
    d = Q.embeddings(spark, sf).select("tile", Q.coarse(F.col("v")).alias("w"), atoms.alias("a"))
    made = F.transform(S.with_atoms(F.col("w"), F.col("a"), 64), lambda x, i: x * (i + 1))
    return d.select("tile", F.round(F.aggregate(made, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("lighting_applied", f"""WITH {Q._T}, f AS (SELECT tile, p, x, y, v, greatest(0.0, least(1.0, (x + 0.5) / 4 - 0.5)) AS fx, greatest(0.0, least(1.0, (y + 0.5) / 4 - 0.5)) AS fy FROM t),
    l AS (SELECT tile, v AS a FROM t WHERE p = 0), m AS (SELECT f.*, (1 + a) * (1 - fx) * (1 - fy) + (1 - a) * fx * (1 - fy) + 0.5 * (1 - fx) * fy + 1.5 * fx * fy AS light FROM f JOIN l USING (tile))
    SELECT tile, round(sum(greatest(0.0, least(1.0, abs(v) * light)) * (p + 1)), 6) AS total FROM m GROUP BY 1""")
def lighting_applied(spark, sf):
    """An albedo times a light of 2 by 2 that is spread over it."""
    a = F.col("v")[0]
    light = F.array(1 + a, 1 - a, F.lit(0.5), F.lit(1.5))
    d = Q.embeddings(spark, sf).select("tile", F.transform("v", F.abs).alias("u"), light.alias("l"))
    made = F.transform(S.lit(F.col("u"), F.col("l"), 8, 2), lambda x, i: x * (i + 1))
    return d.select("tile", F.round(F.aggregate(made, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("positional_tile_join", f"""WITH {Q._T}, r AS (SELECT tile, image, avg(v) AS record FROM t GROUP BY ALL), q AS (SELECT tile, image, 8 * (1 + tile % 3) AS size FROM r), s AS (SELECT tile, image, avg(v - w) AS bias FROM t GROUP BY ALL)
    SELECT image, count(*) AS tiles, round(sum(record * size), 6) AS record, round(sum(bias * size), 6) AS bias, (SELECT count(*) FROM q) = (SELECT count(*) FROM r) AS whole FROM r JOIN q USING (tile, image) JOIN s USING (tile, image) GROUP BY 1""")
def positional_tile_join(spark, sf):
    """Records, sizes and residuals of tiles meet on (image, tile), co-partitioned by these keys: one exchange for each side."""
    d = Q.embeddings(spark, sf)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 64
    key = ["image", "tile"]
    record = d.select(*key, mean(F.col("v")).alias("record"))
    sizes = d.select(*key, (F.lit(8) * (1 + F.col("tile") % 3)).alias("size"))
    bias = d.select(*key, mean(F.zip_with("v", Q.coarse(F.col("v")), lambda a, b: a - b)).alias("bias"))
    all_ = record.join(sizes, key, "full").join(bias, key, "full")
    whole = F.bool_and(F.col("record").isNotNull() & F.col("size").isNotNull() & F.col("bias").isNotNull())
    return all_.groupBy("image").agg(
        F.count(F.lit(1)).alias("tiles"), F.round(F.sum(F.col("record") * F.col("size")), 6).alias("record"), F.round(F.sum(F.col("bias") * F.col("size")), 6).alias("bias"), whole.alias("whole")
    )


@register("neighbour_delta_coding", """WITH l AS (SELECT event_id, event_type, props, lag(props) OVER (PARTITION BY event_type ORDER BY event_id) AS old FROM events)
    SELECT event_id, event_type, coalesce(length(old), 0) AS prev_len, length(props) AS cur_len,
      upper(list_aggregate(list_transform(range(1, length(props) + 1), lambda i: printf('%02x', (ascii(substr(props, i::INTEGER, 1)) - CASE WHEN i <= coalesce(length(old), 0) THEN ascii(substr(old, i::INTEGER, 1)) ELSE 0 END) & 255)), 'string_agg', '')) AS delta FROM l""")
def neighbour_delta_coding(spark, sf):
    d = table(spark, sf, "events").select("event_id", "event_type", "props")
    return S.neighbour_deltas(d, "event_type", "props", ["event_id"]).select("event_id", "event_type", "prev_len", "cur_len", F.hex("delta").alias("delta"))


@register("srgb_byte_psnr", f"""WITH {Q._T}, c AS (SELECT tile, greatest(0.0, least(1.0, v)) AS a, greatest(0.0, least(1.0, w)) AS b FROM t),
    u AS (SELECT tile, floor(CASE WHEN a <= 0.0031308 THEN a * 12.92 ELSE power(a, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END * 255 + 0.5) AS a, floor(CASE WHEN b <= 0.0031308 THEN b * 12.92 ELSE power(b, 1 / 2.4::DOUBLE) * 1.055 - 0.055 END * 255 + 0.5) AS b FROM c)
    SELECT tile, round(CASE WHEN avg(power((a - b) / 255, 2)) <= 1e-12 THEN 99.99 ELSE -10 * log10(avg(power((a - b) / 255, 2))) END, 6) AS psnr FROM u GROUP BY 1""")
def srgb_byte_psnr(spark, sf):
    return Q.embeddings(spark, sf).select("tile", F.round(S.srgb_byte_psnr(F.col("v"), Q.coarse(F.col("v"))), 6).alias("psnr"))


@register("edge_point_clusters")
def edge_point_clusters(spark, sf):
    """k-means with a seeded start over edge points: tested against a plain version."""
    return S.edge_clusters(Q.embeddings(spark, sf), ["tile"], "v")


@register("error_windows", f"""WITH {Q._T}, a AS (SELECT tile, y, x, abs(v - w) AS e FROM t), w AS (SELECT CAST(s.k AS INTEGER) AS size, CAST(y.range AS INTEGER) AS wy, CAST(x.range AS INTEGER) AS wx FROM (SELECT unnest([4, 2]) AS k) s, range(8) y, range(8) x
    WHERE y.range % (s.k // 2) = 0 AND x.range % (s.k // 2) = 0 AND y.range + s.k <= 8 AND x.range + s.k <= 8)
    SELECT tile, size, wy, wx, round(sum(e), 7) AS error FROM a, w WHERE a.y >= wy AND a.y < wy + size AND a.x >= wx AND a.x < wx + size GROUP BY ALL""")
def error_windows(spark, sf):
    """The error of overlapping windows of each tile, by four lookups in a summed-area table."""
    from tilespark.operators import kernels as K
    from tilespark.operators import refine as Rf

    at = Rf.windows(8)
    d = Q.embeddings(spark, sf).withColumn("w", Q.coarse(F.col("v")))
    sums = K.over_tiles(d, ["v", "w"], {"e": "array<double>"}, lambda v, w: [Rf.window_sums(Rf.summed_area(np.abs(v - w), 8), at)], ["tile"])
    place = F.array(*[F.struct(*[F.lit(int(x)).alias(n) for n, x in zip(("wy", "wx", "size"), row, strict=True)]) for row in at])
    d = sums.select("tile", F.posexplode("e").alias("i", "error")).withColumn("p", F.get(place, F.col("i")))
    return d.select("tile", "p.size", "p.wy", "p.wx", F.round("error", 7).alias("error"))


_SOBEL = f"""{Q._T}, n AS (SELECT a.tile, a.y, a.x, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS sx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS sy, max(a.v) AS v
      FROM t a JOIN t b ON a.tile = b.tile AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL),
    o AS (SELECT *, sqrt(sx * sx + sy * sy) AS m, atan2(sy, sx) AS a FROM n), r AS (SELECT *, CAST(least(11, floor(CASE WHEN a < 0 THEN a + pi() WHEN a >= pi() THEN a - pi() ELSE a END / pi() * 12)) AS INTEGER) AS bin FROM o)"""


@register(
    "edge_candidates",
    f"""WITH {_SOBEL}, h AS (SELECT tile, bin, sum(m) AS weight FROM r GROUP BY ALL), k AS (SELECT tile, bin, (bin + 0.5) * pi() / 12 AS th FROM (SELECT *, max(weight) OVER (PARTITION BY tile) AS top FROM h) WHERE weight > 0.2::DOUBLE * top),
    ramp AS (SELECT k.tile, row_number() OVER (PARTITION BY k.tile ORDER BY bin) - 1 AS ord, 'ramp' AS family, 4 - cos(th) * 4.2 AS x0, 4 - sin(th) * 4.2 AS y0, 4 + cos(th) * 4.2 AS x1, 4 + sin(th) * 4.2 AS y1,
      avg(v) FILTER ((x - 3.5) * cos(th) + (y - 3.5) * sin(th) < 0) AS c0, avg(v) FILTER ((x - 3.5) * cos(th) + (y - 3.5) * sin(th) >= 0) AS c1 FROM k JOIN t USING (tile) GROUP BY k.tile, bin, th),
    e AS (SELECT *, x + 0.5 AS px, y + 0.5 AS py FROM (SELECT *, quantile_cont(m, 0.75) OVER (PARTITION BY tile) AS edge FROM r) WHERE m >= edge AND m > 0),
    c AS (SELECT tile, avg(px) AS cx, avg(py) AS cy, avg(v) AS colour, CASE WHEN sqrt(power(2 * covar_pop(px, py), 2) + power(var_pop(px) - var_pop(py), 2)) > 1e-9 * (var_pop(px) + var_pop(py)) THEN 0.5 * atan2(2 * covar_pop(px, py), var_pop(px) - var_pop(py)) ELSE 0 END AS th0,
      CASE WHEN abs(cos(th0)) < 1e-9 THEN abs(th0) ELSE th0 END AS th FROM e GROUP BY tile HAVING count(*) >= 2),
    l AS (SELECT tile, cx, cy, th, colour, min((px - cx) * cos(th) + (py - cy) * sin(th)) AS low, max((px - cx) * cos(th) + (py - cy) * sin(th)) AS high FROM e JOIN c USING (tile) GROUP BY ALL),
    line AS (SELECT tile, (SELECT count(*) FROM k WHERE k.tile = l.tile) AS ord, 'line' AS family, cx + low * cos(th) AS x0, cy + low * sin(th) AS y0, cx + high * cos(th) AS x1, cy + high * sin(th) AS y1, colour AS c0, colour AS c1 FROM l)
    SELECT tile, CAST(ord AS INTEGER) AS ord, family, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(c0, 7) AS c0, round(c1, 7) AS c1 FROM (FROM ramp UNION ALL FROM line)""",
)
def edge_candidates(spark, sf):
    """Ramps along the peaks of the orientation histogram, and the line through the edge points by their main axis and extent."""
    from tilespark.operators import edges

    d = edges.candidates(Q.embeddings(spark, sf), ["tile"], "v", Q.SIDE).filter(F.col("family").isin("ramp", "line"))
    return d.select("tile", "ord", "family", *[F.round(F.col("geom")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.round("color0", 7).alias("c0"), F.round("color1", 7).alias("c1"))


_BPP = 3.0


@register(
    "capped_tile_budgets",
    f"""WITH {Q._T}, w AS (SELECT tile, image, greatest(round(var_pop(v), 9), 1e-9) AS w, CASE WHEN tile % 5 = 0 THEN 1 ELSE 2 + tile % 4 END AS c FROM t GROUP BY tile, image),
    g AS (SELECT *, least(sum(c) OVER (PARTITION BY image), floor(greatest(0, count(*) OVER (PARTITION BY image) * 64 * {_BPP}::DOUBLE - count(*) OVER (PARTITION BY image) * 32) / 72)) AS goal FROM w),
    l AS (SELECT *, (goal - coalesce(sum(c) OVER (PARTITION BY image ORDER BY c / w, tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY image ORDER BY c / w, tile ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g),
    x AS (SELECT *, least(c, greatest(0, max(level) OVER (PARTITION BY image)) * w) AS exact FROM l), f AS (SELECT *, least(c, floor(exact + 1e-9)) AS low FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY low >= c, round(exact - low, 7) DESC, tile) AS r, goal - sum(low) OVER (PARTITION BY image) AS rest FROM f)
    SELECT image, tile, CAST(1 + low + CASE WHEN r <= rest AND low < c THEN 1 ELSE 0 END AS BIGINT) AS budget FROM r""",
)
def capped_tile_budgets(spark, sf):
    """Primitives by tile under a cap each and the image's bits: what capped tiles leave goes to the others."""
    from tilespark.operators import kernels as K
    from tilespark.operators import relational as R

    d = K.over_tiles(Q.embeddings(spark, sf), "v", {"w": "double"}, lambda v: [v.var(axis=1)], ["tile", "image"])
    cap = F.when(F.col("tile") % 5 == 0, 2).otherwise(F.col("tile") % 4 + 3)
    d = d.withColumn("w", F.round("w", 9)).withColumn("cap", cap).withColumn("pixels", F.count(F.lit(1)).over(Window.partitionBy("image")) * 64)
    return R.tile_budgets(d, "w", "cap", "pixels", _BPP, ["image"], ["tile"]).select("image", "tile", "budget")


_H, _W, _NH, _NW = 32, 8, 20, 13
_SCALED = """WITH p AS (SELECT vec_id // 4 AS image, CAST(vec_id % 4 * 8 + i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)),
b AS (SELECT image, max(y) + 1 AS h FROM p GROUP BY 1),
kx AS (SELECT o, i, {f} AS k FROM (SELECT CAST(o.range AS INTEGER) AS o, CAST(i.range AS INTEGER) AS i, (i.range + 0.5 - (o.range + 0.5) * 8 / {nw}::DOUBLE) / greatest(1, 8 / {nw}::DOUBLE) AS d FROM range({nw}) o, range(8) i)),
wx AS (SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS k FROM kx),
ky AS (SELECT h, o, i, {f} AS k FROM (SELECT h, CAST(o.range AS INTEGER) AS o, CAST(i.range AS INTEGER) AS i, (i.range + 0.5 - (o.range + 0.5) * h / {nh}::DOUBLE) / greatest(1, h / {nh}::DOUBLE) AS d FROM (SELECT DISTINCT h FROM b), range({nh}) o, range(32) i WHERE i.range < h)),
wy AS (SELECT h, o, i, k / sum(k) OVER (PARTITION BY h, o) AS k FROM ky),
a AS (SELECT image, y, o AS x, sum(v * k) AS v FROM p JOIN wx ON i = x GROUP BY image, y, o)
SELECT a.image, wy.o AS y, x, round(sum(v * k), 6) AS v FROM a JOIN b ON a.image = b.image JOIN wy ON wy.h = b.h AND wy.i = a.y GROUP BY a.image, wy.o, x"""
_LANCZOS = "CASE WHEN abs(d) >= 3 THEN 0 WHEN d = 0 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END"


def _resized(spark, sf, kind):
    """Four tiles over one another are an image of 8 by 32, scaled to 13 by 20."""
    from tilespark.operators import scaling

    d = table(spark, sf, "embeddings").select(F.expr("vec_id div 4").alias("image"), (F.col("vec_id") % 4).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r"), "embedding")
    rows = d.select("image", (F.col("k") * 8 + F.col("r")).alias("y"), F.slice("embedding", F.col("r") * 8 + 1, F.lit(8)).alias("v"), F.lit(_NH).alias("h"), F.lit(_NW).alias("w"))
    out = scaling.resized(rows, "h", "w", 1, kind)
    return out.select("image", "y", F.posexplode("v").alias("x", "v")).withColumn("v", F.round("v", 6))


@register("lanczos_resize", _SCALED.format(f=_LANCZOS, nw=_NW, nh=_NH))
def lanczos_resize(spark, sf):
    return _resized(spark, sf, "lanczos")


@register("bilinear_image_resize", _SCALED.format(f="greatest(0, 1 - abs(d))", nw=_NW, nh=_NH))
def bilinear_image_resize(spark, sf):
    return _resized(spark, sf, "bilinear")
