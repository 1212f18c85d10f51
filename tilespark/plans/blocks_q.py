"""Round trips of the container's blocks: what is packed and read again must be what SQL makes of the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilespark.operators import blocks as B
from tilespark.operators import kernels as K
from tilespark.plans import tiles_q as Q
from tilespark.plans.catalogue import oracle_of, register
from tilespark.session import table

_SUMS = "image, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (i % 101 + 1)) AS BIGINT) AS weighted"


def _sums(d):
    at = F.col("i") % 101 + 1
    return d.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"), F.sum(F.col("value") * at).cast("long").alias("weighted"))


def _byte(v):
    return F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(v))).cast("int")


_BYTE = "greatest(-127, least(127, round_even({}, 0)))"


@register("block_toc", f"""WITH l AS (SELECT doc_id // 64 AS image, doc_id % 64 AS i, sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS value FROM documents) SELECT {_SUMS} FROM l GROUP BY image""")
def block_toc(spark, sf):
    """Offsets of a chunk's entries."""
    d = table(spark, sf, "documents").select(F.expr("doc_id div 64").alias("image"), F.struct("doc_id", F.octet_length("text").alias("n")).alias("e"))
    d = d.groupBy("image").agg(F.array_sort(F.collect_list("e")).alias("e"))  # 64 at most
    ends = F.transform(F.sequence(F.lit(1), F.size("e")), lambda k: F.aggregate(F.slice("e", 1, k), F.lit(0), lambda s, x: s + x["n"]))
    p = B.packed(d.select("image", ends.alias("offsets")), ["image"], ["offsets"], lambda r: B.pack("TOC", {"n": len(r["offsets"]), "offsets": r["offsets"]}))
    return _sums(B.values(p, ["image"], "offsets", lambda x: B.unpack("TOC", x)))


@register("block_cidx", """SELECT c_custkey // 64 AS image, CAST(min(o.o_orderkey) AS BIGINT) AS start, count(*) AS tiles FROM customer JOIN orders o ON o_custkey = c_custkey GROUP BY 1""")
def block_cidx(spark, sf):
    """A chunk's first entry and number of entries."""
    d = table(spark, sf, "orders").groupBy(F.expr("o_custkey div 64").alias("image")).agg(F.min("o_orderkey").cast("long").alias("start"), F.count(F.lit(1)).alias("tiles"))

    def build(r):
        return B.pack("CIDX", {"n": 1, "chunks": np.array([(r["start"], r["tiles"], 0, 0, 0, 0)], B.CHUNK)})

    p = B.packed(d, ["image"], ["start", "tiles"], build)
    return B.records(p, ["image"], ["start", "tiles"], lambda x: B.unpack("CIDX", x)["chunks"]).select("image", "start", "tiles")


def _per_tile(spark, sf, array, build, read, name, width):
    """Values of a block for each part of an image's tiles, a payload for 512 tiles at most."""
    part = Q.embeddings(spark, sf).select("image", F.expr("tile div 512").alias("part"), "tile", array.alias("a"))
    d = part.groupBy("image", "part").agg(F.array_sort(F.collect_list(F.struct("tile", "a"))).alias("s"))
    d = d.select("image", "part", F.size("s").alias("n"), F.flatten(F.transform("s", lambda x: x["a"])).alias("v"))
    p = B.packed(d, ["image", "part"], ["n", "v"], build)
    v = B.values(p, ["image", "part"], name, read)
    return _sums(v.withColumn("i", F.col("i") % width))


_TT = Q._T + ", "


@register("block_res0", f"""WITH {_TT} m AS (SELECT tile, image, avg(v - w) AS e FROM t GROUP BY ALL), l AS (SELECT image, c.range AS i, {_BYTE.format("e * 255 * (c.range + 1)")} AS value FROM m, range(3) c) SELECT {_SUMS} FROM l GROUP BY image""")
def block_res0(spark, sf):
    """Bias of three channels (1, 2 and 3 times a tile's mean error)."""
    e = F.aggregate(F.zip_with("v", Q.coarse(F.col("v")), lambda a, b: a - b), F.lit(0.0), lambda s, x: s + x) / 64
    bias = F.array(*[_byte(e * 255 * (c + 1)) for c in range(3)])
    return _per_tile(spark, sf, bias, lambda r: B.pack("RES0", {"n": r["n"], "bias": r["v"]}), lambda x: B.unpack("RES0", x), "bias", 3)


@register("block_res1", f"""WITH {_TT} l AS (SELECT image, p % 48 AS i, {_BYTE.format("(v - w) * 255")} AS value FROM t WHERE p < 48) SELECT {_SUMS} FROM l GROUP BY image""")
def block_res1(spark, sf):
    """Grids of 4 by 4 in three channels: a tile's first 48 errors."""
    grid = F.transform(F.slice(F.zip_with("v", Q.coarse(F.col("v")), lambda a, b: a - b), 1, 48), lambda x: _byte(x * 255))
    return _per_tile(spark, sf, grid, lambda r: B.pack("RES1", {"n": r["n"], "side": 4, "grid": r["v"]}), lambda x: B.unpack("RES1", x), "grid", 48)


@register("block_lite", f"""WITH {_TT} l AS (SELECT image, p AS i, greatest(-128, least(127, round_even((1 + v - 1) * 64, 0))) AS value FROM t) SELECT {_SUMS} FROM l GROUP BY image""")
def block_lite(spark, sf):
    light = F.transform("v", lambda x: B.lite_byte(F.lit(1.0) + x))
    return _per_tile(spark, sf, light, lambda r: B.pack("LITE", {"h": r["n"], "w": 64, "grid": r["v"]}), lambda x: B.unpack("LITE", x), "grid", 64)


@register("block_pal", f"""WITH {_TT} l AS (SELECT image, p AS i, CAST(floor((v + 1) * 8) AS BIGINT) & 15 AS value FROM t) SELECT {_SUMS} FROM l GROUP BY image""")
def block_pal(spark, sf):
    """Labels of a palette of sixteen."""
    label = F.transform("v", lambda x: F.floor((x + 1) * 8).cast("int").bitwiseAND(15))
    palette = np.repeat(np.arange(16) * 17, 3)
    return _per_tile(spark, sf, label, lambda r: B.pack("PAL", {"k": 16, "w": 64, "h": r["n"], "palette": palette, "labels": r["v"]}), lambda x: B.unpack("PAL", x), "labels", 64)


@register("block_grd", f"""WITH {_TT} {Q._G}, l AS (SELECT image, p AS i, {_BYTE.format("gx * 64")} AS value FROM g) SELECT {_SUMS} FROM l GROUP BY image""")
def block_grd(spark, sf):
    """Forward differences along x of a tile, and along y beside them."""
    from tilespark.operators import tiles as T

    both = lambda along: F.transform(T.forward("v", Q.SIDE, along), lambda x: _byte(x * 64))
    build = lambda r: B.pack("GRD", {"w": 64, "h": r["n"], "scale": 64, "c": 1, "means": [0.5], "gx": r["v"], "gy": r["v"][::-1]})
    return _per_tile(spark, sf, both("x"), build, lambda x: B.unpack("GRD", x), "gx", 64)


_STEP = Q.step_of(40)


@register("block_dct_versions", f"""WITH {Q._T}, {Q._dct(_STEP)}, v AS (SELECT CAST(unnest([2, 3, 4, 5]) AS INTEGER) AS version), s AS (SELECT version, image, i * 8 + j AS i, q AS value FROM q, v)
    SELECT version, {_SUMS} FROM s GROUP BY version, image""")
def block_dct_versions(spark, sf):
    """Quantised transforms through every version of the block; older ones lack what the newest adds."""
    d = K.over_tiles(Q.embeddings(spark, sf), "v", {"q": "array<int>"}, lambda v: [K.dct_quantise(v, _STEP).astype(np.int32)], ["tile", "image"])
    d = d.withColumn("part", F.expr("tile div 512")).groupBy("image", "part").agg(F.array_sort(F.collect_list(F.struct("tile", "q"))).alias("s"))
    d = d.select("image", "part", F.size("s").alias("n"), F.flatten(F.transform("s", lambda x: x["q"])).alias("v"))
    d = d.withColumn("version", F.explode(F.array(*map(F.lit, (2, 3, 4, 5)))))

    def build(r):
        n = r["n"]
        mask = np.packbits(np.ones(n, bool), bitorder="little")
        head = {"chroma": 0, "step": _STEP, "alpha": 0.0, "channels": 1, "n": 64 * n, "tiles": n, "layout": 0, "scaled": n}
        return B.pack_dct({**head, "mask": mask, "scales": np.full(n, 128), "coefficients": r["v"]}, r["version"])

    p = B.packed(d, ["version", "image", "part"], ["version", "n", "v"], build)
    v = B.values(p, ["version", "image", "part"], "coefficients", B.unpack_dct).withColumn("i", F.col("i") % 64)
    at = F.col("i") % 101 + 1
    return v.groupBy("version", "image").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"), F.sum(F.col("value") * at).cast("long").alias("weighted"))


@register("block_qtree", f"SELECT image, size, count(*) AS n, CAST(sum(y) AS BIGINT) AS y, CAST(sum(x) AS BIGINT) AS x FROM (SELECT tile % 97 AS image, 8 * (1 << CAST(tile % 3 AS INTEGER)) AS size, tile // 97 % 4096 * 8 AS y, tile % 31 * 8 AS x FROM (SELECT vec_id AS tile FROM embeddings)) GROUP BY ALL")
def block_qtree(spark, sf):
    """Tiles of an image with their sizes."""
    t = F.col("tile")
    d = Q.embeddings(spark, sf).select((t % 97).alias("image"), F.struct((F.expr("tile div 97") % 4096 * 8).alias("y"), (t % 31 * 8).alias("x"), (F.lit(8) * F.pow(F.lit(2), t % 3)).cast("int").alias("size")).alias("e"), F.expr("tile div 65536").alias("part"))
    d = d.groupBy("image", "part").agg(F.collect_list("e").alias("e"))
    p = B.packed(d, ["image", "part"], ["e"], lambda r: B.pack("QTREE", {"n": len(r["e"]), "tiles": np.array([(e["y"], e["x"], e["size"]) for e in r["e"]], B.TILE)}))
    out = B.records(p, ["image", "part"], ["size", "y", "x"], lambda x: B.unpack("QTREE", x)["tiles"])
    return out.groupBy("image", F.col("size").cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("y"), F.sum("x").cast("long").alias("x"))


@register("block_res2", """WITH a AS (SELECT event_id, event_id % 64 AS pix, event_id % 5 - 2 AS dr FROM events) SELECT event_id, CASE WHEN event_id % 3 < 2 THEN pix END AS pix, CASE WHEN event_id % 3 < 2 THEN dr END AS dr FROM a""")
def block_res2(spark, sf):
    """Sparse atoms as JSON in their block, else in the metadata, else none."""
    atom = F.to_json(F.array(F.struct((F.col("event_id") % 64).alias("pix"), (F.col("event_id") % 5 - 2).alias("dr"), F.lit(0).alias("dg"), F.lit(0).alias("db"))))
    k = F.col("event_id") % 3
    meta = F.when(k == 1, F.concat(F.lit('{"res2":'), atom, F.lit("}"))).otherwise("{}")
    d = table(spark, sf, "events").select("event_id", B.sparse_atoms(F.when(k == 0, atom), meta).alias("a"))
    return d.select("event_id", F.col("a")[0]["pix"].cast("long").alias("pix"), F.col("a")[0]["dr"].cast("long").alias("dr"))


@register("tile_size_distribution", f"SELECT size, count(*) AS n FROM ({oracle_of('quadtree_split')}) GROUP BY 1")
def tile_size_distribution(spark, sf):
    return Q.quadtree_split(spark, sf).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
