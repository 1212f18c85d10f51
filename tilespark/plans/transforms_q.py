"""Queries on colour, geometry, entropy coding, primitives, containers and whole-image encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilespark.functions import color
from tilespark.operators import entropy as En
from tilespark.operators import layers as L
from tilespark.operators import primitives as P
from tilespark.plans.catalogue import register
from tilespark.session import table


@register(
    "srgb_roundtrip",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(lin, 9) AS linear, round(CASE WHEN lin <= 0.0031308 THEN lin * 12.92 ELSE power(lin, 1 / 2.4) * 1.055 - 0.055 END, 6) AS back,
      round(0.2126 * lin + 0.7152 * l_tax + 0.0722 * l_discount, 9) AS luma FROM (SELECT *, CASE WHEN l_quantity / 50 <= 0.04045 THEN l_quantity / 50 / 12.92 ELSE power((l_quantity / 50 + 0.055) / 1.055, 2.4) END AS lin FROM lineitem)""",
)
def srgb_roundtrip(spark, sf):
    lin = color.srgb_to_linear(F.col("l_quantity") / 50)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(lin, 9).alias("linear"), F.round(color.linear_to_srgb(lin), 6).alias("back"),
                                               F.round(color.luma(lin, F.col("l_tax"), F.col("l_discount")), 9).alias("luma"))


_GEO = """s AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 16)::DOUBLE AS ax, (s_suppkey * 11 % 16)::DOUBLE AS ay, (s_suppkey * 13 % 16)::DOUBLE AS bx, (s_suppkey * 5 % 16)::DOUBLE AS "by", (s_suppkey * 3 % 16)::DOUBLE AS cx, (s_suppkey * 9 % 16)::DOUBLE AS cy FROM supplier),
p AS (SELECT a.range + 0.5::DOUBLE AS y, b.range + 0.5::DOUBLE AS x FROM range(16) a, range(16) b)"""


def _shapes(spark, sf):
    k = F.col("s_suppkey")
    at = lambda m: (k * m % 16).cast("double")
    return table(spark, sf, "supplier").select(k.alias("k"), at(7).alias("ax"), at(11).alias("ay"), at(13).alias("bx"), at(5).alias("by"), at(3).alias("cx"), at(9).alias("cy"))


def _centres(d, side=16):
    line = F.sequence(F.lit(0), F.lit(side - 1))
    d = d.withColumn("i", F.explode(line)).withColumn("j", F.explode(line))
    return d.select("*", (F.col("i") + 0.5).alias("y"), (F.col("j") + 0.5).alias("x")).drop("i", "j")


@register(
    "triangle_coverage",
    f"""WITH {_GEO}, d AS (SELECT *, ("by" - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS d FROM s, p),
    u AS (SELECT k, abs(d) >= 1e-8 AS ok, (("by" - cy) * (x - cx) + (cx - bx) * (y - cy)) / CASE WHEN abs(d) >= 1e-8 THEN d END AS u, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / CASE WHEN abs(d) >= 1e-8 THEN d END AS v FROM d)
    SELECT k, count(*) FILTER (ok AND u >= 0 AND v >= 0 AND u + v <= 1) AS covered FROM u GROUP BY 1""",
)
def triangle_coverage(spark, sf):
    d = _centres(_shapes(spark, sf)).withColumn("d", (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy")))
    d = d.withColumn("d", F.when(F.abs("d") >= 1e-8, F.col("d")))
    u = F.expr("((`by` - cy) * (x - cx) + (cx - bx) * (y - cy)) / d")
    v = F.expr("((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / d")
    return d.groupBy("k").agg(F.count_if(F.coalesce((u >= 0) & (v >= 0) & (u + v <= 1), F.lit(False))).alias("covered"))


_SEG = "least(1.0, greatest(0.0, ((x - {0}) * ({2} - {0}) + (y - {1}) * ({3} - {1})) / greatest(1e-8, power({2} - {0}, 2) + power({3} - {1}, 2))))"


@register(
    "segment_distance",
    f"""WITH {_GEO}, t AS (SELECT *, {_SEG.format("ax", "ay", "bx", '"by"')} AS t FROM s, p)
    SELECT k, round(avg(sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * ("by" - ay), 2))), 6) AS mean_distance,
      count(*) FILTER ((x - ax) * ("by" - ay) - (y - ay) * (bx - ax) >= 0) AS left_side FROM t GROUP BY 1""",
)
def segment_distance(spark, sf):
    t = F.expr(_SEG.format("ax", "ay", "bx", "`by`"))
    d = _centres(_shapes(spark, sf)).withColumn("t", t)
    dist = F.hypot(F.expr("x - ax - t * (bx - ax)"), F.expr("y - ay - t * (`by` - ay)"))
    side = F.expr("(x - ax) * (`by` - ay) - (y - ay) * (bx - ax) >= 0")
    return d.groupBy("k").agg(F.round(F.avg(dist), 6).alias("mean_distance"), F.count_if(side).alias("left_side"))


@register(
    "curve_distance",
    f"""WITH {_GEO}, c AS (SELECT k, CAST(range AS INTEGER) AS i, power(1 - range / 31.0, 2) * ax + 2 * range / 31.0 * (1 - range / 31.0) * cx + power(range / 31.0, 2) * bx AS px,
      power(1 - range / 31.0, 2) * ay + 2 * range / 31.0 * (1 - range / 31.0) * cy + power(range / 31.0, 2) * "by" AS py FROM s, range(32)),
    h AS (SELECT a.k, a.px AS x0, a.py AS y0, b.px AS x1, b.py AS y1 FROM c a JOIN c b ON a.k = b.k AND a.i + 1 = b.i),
    t AS (SELECT *, {_SEG.format("x0", "y0", "x1", "y1")} AS t FROM h, p), m AS (SELECT k, x, y, min(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2))) AS d FROM t GROUP BY ALL)
    SELECT k, round(avg(d), 6) AS mean_distance FROM m GROUP BY 1""",
)
def curve_distance(spark, sf):
    """Distance of all pixel centres to quadratic curves of 31 chords."""

    def run(it):
        at = np.arange(16) + 0.5
        y, x = np.meshgrid(at, at, indexing="ij")
        for b in it:
            g = [b.column(c).to_pylist() for c in ("ax", "ay", "bx", "by", "cx", "cy")]
            d = [float(P.curve_distance(x, y, (ax, ay), (cx, cy), (bx, by)).mean()) for ax, ay, bx, by, cx, cy in zip(*g, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(d, pa.float64())], names=["k", "d"])

    return _shapes(spark, sf).mapInArrow(run, "k long, d double").select("k", F.round("d", 6).alias("mean_distance"))


@register(
    "blend_layers",
    """SELECT o_orderkey, round(acc, 6) AS value, round(visible, 6) AS visible FROM (
      SELECT o_orderkey, v1 * a1 * (1 - a2) * (1 - a3) + v2 * a2 * (1 - a3) + v3 * a3 AS acc, 1 - (1 - a1) * (1 - a2) * (1 - a3) AS visible FROM (
        SELECT o_orderkey, (o_orderkey % 10) / 10.0::DOUBLE AS v1, (o_custkey % 7) / 7.0::DOUBLE AS v2, (o_orderkey % 3) / 3.0::DOUBLE AS v3,
          (o_custkey % 11) / 10.0::DOUBLE AS a1, (o_orderkey % 5) / 5.0::DOUBLE AS a2, (o_custkey % 4) / 4.0::DOUBLE AS a3 FROM orders))""",
)
def blend_layers(spark, sf):
    """Layers over one another as an ordered fold; a layer's visibility is its alpha times what those above let through."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    layer = lambda v, a: F.struct(v.alias("v"), a.alias("a"))
    d = table(spark, sf, "orders").select(o, F.array(layer(o % 10 / 10, c % 11 / 10), layer(c % 7 / 7, o % 5 / 5), layer(o % 3 / 3, c % 4 / 4)).alias("l"))
    value = F.aggregate("l", F.lit(0.0), lambda s, x: x["v"] * x["a"] + s * (F.lit(1.0) - x["a"]))
    through = F.aggregate("l", F.lit(1.0), lambda s, x: s * (F.lit(1.0) - x["a"]))
    return d.select("o_orderkey", F.round(value, 6).alias("value"), F.round(F.lit(1.0) - through, 6).alias("visible"))


_BYTES = """x AS (SELECT lang, doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents), c AS (SELECT lang, CAST('0x' || h AS INTEGER) AS byte, count(*) AS n FROM x GROUP BY ALL)"""
_MODEL = """f AS (SELECT *, greatest(1, CAST(round_even(n::DOUBLE / sum(n) OVER (PARTITION BY lang) * 4096, 0) AS BIGINT)) AS f0 FROM c), l AS (SELECT *, 4096 - sum(f0) OVER (PARTITION BY lang) AS rest FROM f),
a AS (SELECT *, rest > 0 OR f0 > 1 AS able FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY lang, able ORDER BY n DESC, byte) AS r, count(*) FILTER (able) OVER (PARTITION BY lang) AS m FROM a),
m AS (SELECT lang, byte, n, CAST(f0 + CASE WHEN able THEN sign(rest) * (abs(rest) // m + CASE WHEN r <= abs(rest) % m THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS freq FROM r)"""


@register("byte_histogram", f"WITH {_BYTES} SELECT * FROM c")
def byte_histogram(spark, sf):
    return En.byte_counts(table(spark, sf, "documents"), "text", ["lang"])


@register("freq_model_12bit", f"WITH {_BYTES}, {_MODEL} SELECT * FROM m")
def freq_model_12bit(spark, sf):
    return En.model(En.byte_counts(table(spark, sf, "documents"), "text", ["lang"]), ["lang"])


@register("ideal_code_bits", f"WITH {_BYTES}, {_MODEL} SELECT lang, round(sum(n * -log2(freq / 4096.0)), 3) AS bits, CAST(sum(n) AS BIGINT) AS bytes FROM m GROUP BY 1")
def ideal_code_bits(spark, sf):
    m = En.model(En.byte_counts(table(spark, sf, "documents"), "text", ["lang"]), ["lang"])
    return m.groupBy("lang").agg(F.round(F.sum(F.col("n") * -F.log2(F.col("freq") / 4096.0)), 3).alias("bits"), F.sum("n").alias("bytes"))


@register("rans_chunk_roundtrip")
def rans_chunk_roundtrip(spark, sf):
    """The texts' bytes, in chunks of 4096, through the range coder and back."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b"))
    at = F.explode(F.sequence(F.lit(0), F.expr("greatest(0, octet_length(b) - 1) div 4096").cast("int"))).alias("chunk")
    d = d.select("doc_id", "b", at).select(F.concat_ws("-", "doc_id", "chunk").alias("chunk"), F.substring("b", F.col("chunk") * 4096 + 1, F.lit(4096)).alias("b"))
    return En.chunk_roundtrip(d, "chunk", "b")


_STACK = """SELECT c_custkey AS k, (c_custkey % 9) / 9.0 AS v, (c_custkey % 16)::DOUBLE AS x0, (c_custkey * 3 % 16)::DOUBLE AS y0, (c_custkey * 5 % 16 + 1)::DOUBLE AS x1, (c_custkey * 7 % 16 + 2)::DOUBLE AS y1, (c_custkey % 5) / 5.0 AS a FROM customer"""


@register(
    "primitive_render",
    f"""WITH s AS ({_STACK}), p AS (SELECT a.range + 0.5::DOUBLE AS y, b.range + 0.5::DOUBLE AS x FROM range(8) a, range(8) b),
    t AS (SELECT k, v, a, x, y, least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (power(x1 - x0, 2) + power(y1 - y0, 2) + 1e-8))) AS t FROM s, p),
    r AS (SELECT k, x, y, (1 - t) * v * a + t * 1.0 * a + v * (1 - a) AS v FROM t)
    SELECT k, round(avg(v), 6) AS mean_value, round(max(v), 6) AS top FROM r GROUP BY 1""",
)
def primitive_render(spark, sf):
    """A constant under a linear patch, on 8 by 8 pixels."""
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(k.alias("k"), (k % 9 / 9.0).alias("v"), *[e.cast("double").alias(n) for n, e in
        {"x0": k % 16, "y0": k * 3 % 16, "x1": k * 5 % 16 + 1, "y1": k * 7 % 16 + 2}.items()], (k % 5 / 5.0).alias("a"))

    def run(it):
        for b in (b.slice(at, 1024) for b in it for at in range(0, b.num_rows, 1024)):
            n = b.num_rows
            v, *geom, a = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("v", "x0", "y0", "x1", "y1", "a"))
            grey, tile, one = np.repeat(v, 3, axis=1), np.arange(n), np.ones(n)
            base = L.Layers(tile, np.zeros(n, np.int64), np.full(n, P.CONST), np.zeros((n, 4)), grey, grey, one)
            patch = L.Layers(tile, np.ones(n, np.int64), np.full(n, P.LINEAR), np.hstack(geom), grey, np.ones((n, 3)), np.clip(a[:, 0], 0, 1))
            t = L.compose(patch, n, 8, 8, base=L.compose(base, n, 8, 8))[:, :, 0]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(t.mean(axis=1)), pa.array(t.max(axis=1))], names=["k", "m", "t"])

    return d.mapInArrow(run, "k long, m double, t double").select("k", F.round("m", 6).alias("mean_value"), F.round("t", 6).alias("top"))


def _colour_tiles(spark, sf):
    """Three consecutive vectors are a colour tile; where the last one lacks some, its last vector stands in."""
    from tilespark.plans.tiles_q import embeddings

    d = embeddings(spark, sf).groupBy(F.expr("tile div 3").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("tile", "v"))).alias("c"))
    channel = lambda i: F.get("c", F.least(F.lit(i), F.size("c") - 1))["v"]
    # to [0, 1]
    return d.select("tile", *[F.transform(channel(i), lambda e: F.least(F.lit(1.0), F.greatest(F.lit(0.0), e + 0.5))).alias(n) for i, n in enumerate("rgb")])


def _over_colour(d, ddl, made, most=256):
    """made(tile ids, (n, 64, 3) array) to columns, for up to most tiles at once."""
    names = [x.strip().split()[0] for x in ddl.split(", ")]

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                rgb = np.stack([part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64) for c in "rgb"], axis=2)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made(part.column("tile").to_numpy(), rgb)], names=names)

    return d.mapInArrow(run, ddl)


@register("candidate_generation")
def candidate_generation(spark, sf):
    """Every candidate of every tile with its objective, numbered in the order that ties go by."""
    from tilespark.operators import refine as Rf

    def made(tile, t):
        pool = Rf.template_pool(t, 8)
        n, c = pool.kind.shape
        alone = [Rf.objective(t, Rf.stored(pool.picked(np.full((n, 1), j)), 8), 8, 1e-4) for j in range(c)]
        return [np.repeat(tile, c), np.tile(np.arange(c), n), pool.kind.reshape(-1).astype(np.int64), np.stack(alone, axis=1).reshape(-1)]

    return _over_colour(_colour_tiles(spark, sf), "tile long, ord long, kind long, objective double", made)


def _fitted(spark, sf, width, quality, refine):
    from tilespark.operators import refine as Rf

    def made(tile, t):
        lam = 1e-6
        none = Rf.objective(t, Rf.Set.empty(len(t), 1), 8, lam)
        s, after = Rf.fit(t, 8, quality, lam, width, refine)
        size = [len(P.pack_tile(x, 8)) for x in s.lists()]
        return [tile, (s.kind >= 0).sum(axis=1).astype(np.int64), np.array(size, np.int64), none, after]

    return _over_colour(_colour_tiles(spark, sf), "tile long, n long, bytes long, before double, after double", made)


@register("greedy_tile_fit")
def greedy_tile_fit(spark, sf):
    """Primitives that the greedy fit chooses, with eight rounds at quality 75 and up to three pools of residual candidates: how many, their bytes and the objective before and after."""
    return _fitted(spark, sf, 1, 75, False)


@register("beam_tile_fit")
def beam_tile_fit(spark, sf):
    """The same by a beam of four."""
    return _fitted(spark, sf, 4, 75, False)


@register("refined_tile_fit")
def refined_tile_fit(spark, sf):
    """The whole fit at quality 90: twenty rounds, then least-squares colours and pattern search."""
    return _fitted(spark, sf, 1, 90, True)


@register("primitive_codec_roundtrip")
def primitive_codec_roundtrip(spark, sf):
    """Candidates through the wire form and back: reading and writing again gives the same bytes."""
    from tilespark.operators import refine as Rf

    def made(tile, t):
        blobs = [P.pack_tile(x, 8) for x in Rf.template_pool(t, 8).lists()]
        again = [P.pack_tile(P.unpack_tile(x, 8), 8) for x in blobs]
        return [tile, np.array([len(x) for x in blobs], np.int64), np.array([x == y for x, y in zip(blobs, again, strict=True)])]

    return _over_colour(_colour_tiles(spark, sf), "tile long, bytes long, same boolean", made)


@register(
    "least_squares_colours",
    """WITH c AS (SELECT vec_id // 3 AS tile, vec_id % 3 AS ch, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p, least(1.0, greatest(0.0, CAST(unnest(embedding) AS DOUBLE) + 0.5)) AS v FROM embeddings),
    n AS (SELECT tile, max(ch) AS most FROM c GROUP BY 1),
    f AS (SELECT n.tile, CAST(k.range AS INTEGER) AS ch, p, v FROM n, range(3) k, c WHERE c.tile = n.tile AND c.ch = least(k.range, most)),
    g AS (SELECT *, p // 8 + 0.5::DOUBLE AS y, p % 8 + 0.5::DOUBLE AS x, round_even((tile % 8) / 7.0::DOUBLE * 65535, 0) / 65535 * 7 AS x0, round_even((tile // 8 % 8) / 7.0::DOUBLE * 65535, 0) / 65535 * 7 AS y1 FROM f),
    t AS (SELECT *, least(1.0, greatest(0.0, ((x - x0) * (7 - x0) + (y - 0) * (y1 - 0)) / greatest(1e-8, power(7 - x0, 2) + power(y1, 2)))) AS t FROM g),
    a AS (SELECT *, round_even(0.8::DOUBLE * 65535, 0) / 65535 * exp(-(power(x - x0 - t * (7 - x0), 2) + power(y - t * y1, 2)) / (2 * power(round_even(0.25::DOUBLE * 65535, 0) / 65535 * 4, 2))) AS b FROM t),
    s AS (SELECT tile, ch, sum((1 - b) * (1 - b)) AS aa, sum(b * (1 - b)) AS ab, sum(b * b) AS bb, sum((1 - b) * v) AS av, sum(b * v) AS bv FROM a GROUP BY ALL)
    SELECT tile, ch, CAST(round_even(least(1, greatest(0, (av * bb - bv * ab) / (aa * bb - ab * ab))) * 255, 0) AS INTEGER) AS under, CAST(round_even(least(1, greatest(0, (bv * aa - av * ab) / (aa * bb - ab * ab))) * 255, 0) AS INTEGER) AS over FROM s""",
)
def least_squares_colours(spark, sf):
    """A constant under a line of each tile's own place: the two colours that fit best, from normal equations of two unknowns."""
    from tilespark.operators import refine as Rf

    def made(tile, t):
        lay = [[{"kind": P.CONST, "geom": [], "color0": [0.0] * 3, "color1": None, "alpha": 1.0}, {"kind": P.LINE, "geom": [float(i % 8), 0.0, 7.0, float(i // 8 % 8), 1.0], "color0": [0.0] * 3, "color1": None, "alpha": 0.8}] for i in tile.tolist()]
        s = Rf.solved_colours(t, Rf.stored(Rf.from_lists(lay), 8), 8)
        under, over = (np.rint(s.color0[:, k] * 255).astype(np.int32).reshape(-1) for k in (0, 1))
        return [np.repeat(tile, 3), np.tile(np.arange(3, dtype=np.int32), len(tile)), under, over]

    return _over_colour(_colour_tiles(spark, sf), "tile long, ch int, under int, over int", made)


@register("container_roundtrip")
def container_roundtrip(spark, sf):
    """Tiles of an image as blocks of one container, and the blocks read again."""
    from tilespark.operators import codec
    from tilespark.plans.tiles_q import embeddings

    return codec.decode(codec.encode(embeddings(spark, sf), 75)).groupBy("image").agg(
        F.count(F.lit(1)).alias("tiles"), F.round(F.avg("mse"), 9).alias("mse"), F.max("bytes").alias("bytes"))


@register(
    "encoder_verification",
    """SELECT label AS image, count(*) AS tiles, true AS within_rate FROM embeddings GROUP BY 1""",
)
def encoder_verification(spark, sf):
    """Decoding in the loop: no tile's error exceeds what its quantisation step and the bits that bicubic saves allow."""
    from tilespark.operators import codec
    from tilespark.plans.tiles_q import embeddings, step_of

    most = step_of(75) ** 2 + 0.26**2 * 1e-3 * (64 * 4 + 32 - 128)
    d = codec.decode(codec.encode(embeddings(spark, sf), 75))
    return d.groupBy("image").agg(F.count(F.lit(1)).alias("tiles"), (F.max("mse") <= most).alias("within_rate"))


@register(
    "live_leaderboard",
    """SELECT event_type AS profile, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(avg(value), 10) AS avg_value FROM events GROUP BY ALL""",
)
def live_leaderboard(spark, sf):
    """What the streaming leaderboard ends with, as a batch: see tilespark.streaming.leaderboard."""
    from tilespark.streaming import leaderboard

    return leaderboard.windowed(table(spark, sf, "events"), "1 day").select("profile", F.col("window.start").alias("day"), "n", "avg_value")


@register("variant_tournament")
def variant_tournament(spark, sf):
    """Every registered encoder variant on every image; the winner by image."""
    from tilespark.operators import registry
    from tilespark.plans.tiles_q import embeddings

    return registry.compete(embeddings(spark, sf))
