"""Queries through files of containers: all kinds of blocks written and read by the data source, and pictures drawn from whatever a file has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilespark import session
from tilespark.operators import blocks as B
from tilespark.operators import kernels as K
from tilespark.operators import pictures as Pi
from tilespark.operators import primitives as P
from tilespark.operators import tiles as T
from tilespark.plans import blocks_q as Bq
from tilespark.plans import tiles_q as Q
from tilespark.plans.catalogue import oracle_of, register
from tilespark.sources import tile_files

#: What is read of each block, and how many of its values a tile has (the place among them is the value's weight).
_READ = {
    "RES0": ("bias", 3, lambda x: B.unpack("RES0", x)), "RES1": ("grid", 48, lambda x: B.unpack("RES1", x)), "LITE": ("grid", 64, lambda x: B.unpack("LITE", x)), "PAL": ("labels", 64, lambda x: B.unpack("PAL", x)),
    "GRD": ("gx", 64, lambda x: B.unpack("GRD", x)), "DCT": ("coefficients", 64, B.unpack_dct), "TOC": ("offsets", 512, lambda x: B.unpack("TOC", x)),
    "CIDX": ("start", 512, lambda x: B.unpack("CIDX", x)["chunks"]), "QTREE": ("x", 512, lambda x: B.unpack("QTREE", x)["tiles"]), "BIC": ("control", 48, lambda x: B.unpack("BIC", x)),
}
_CHUNK = 16


def _every_block(r: dict) -> dict[str, bytes]:
    n = r["n"]
    v = np.array(r["v"]).reshape(n, 64)
    starts = np.arange(0, n, _CHUNK)
    sizes = np.minimum(_CHUNK, n - starts)
    chunks = np.array([(a, m, 0, 0, 0, 0) for a, m in zip(starts, sizes, strict=True)], B.CHUNK)
    there = np.array(r["tile"]) % 3 > 0
    q = K.dct_quantise(v, Bq._STEP)[there]
    dct = {"chroma": 0, "step": Bq._STEP, "alpha": 0.0, "channels": 1, "n": q.size, "tiles": n, "layout": 0, "scaled": len(q), "mask": np.packbits(there, bitorder="little"), "scales": np.array(r["tile"])[there] % 256, "coefficients": q.reshape(-1)}
    control = np.rint(np.clip(v[:, :48] + 0.5, 0, 1) * 255)
    return {
        "HEAD": Pi.head(8 * n, 8), "RES0": B.pack("RES0", {"n": n, "bias": r["bias"]}), "RES1": B.pack("RES1", {"n": n, "side": 4, "grid": r["grid"]}), "LITE": B.pack("LITE", {"h": n, "w": 64, "grid": r["light"]}),
        "PAL": B.pack("PAL", {"k": 16, "h": n, "w": 64, "palette": np.repeat(np.arange(16) * 17, 3), "labels": r["label"]}), "GRD": B.pack("GRD", {"scale": 64, "h": n, "w": 64, "c": 1, "means": [0.5], "gx": r["gx"], "gy": r["gy"]}),
        "DCT": B.pack_dct(dct), "TOC": B.pack("TOC", {"n": n, "offsets": np.cumsum(np.array(r["tile"]) % 5)}), "CIDX": B.pack("CIDX", {"n": len(chunks), "chunks": chunks}), "BIC": B.pack("BIC", {"n": n, "control": control.reshape(-1)}),
        "QTREE": B.pack("QTREE", {"n": n, "tiles": np.array([(0, 8 * (i % 7), 8 << (i % 3)) for i in range(n)], B.TILE)}),
    }


_ORDER = "s AS (SELECT vec_id AS tile, label AS image, vec_id // 512 AS part, row_number() OVER (PARTITION BY label, vec_id // 512 ORDER BY vec_id) - 1 AS k, embedding FROM embeddings)"
_EXTRA = f"""WITH {_ORDER}, l AS (
    SELECT 'TOC' AS tag, image, k AS i, sum(tile % 5) OVER (PARTITION BY image, part ORDER BY tile) AS value FROM s
    UNION ALL SELECT 'CIDX', image, k // {_CHUNK}, k FROM s WHERE k % {_CHUNK} = 0
    UNION ALL SELECT 'QTREE', image, k, 8 * (k % 7) FROM s
    UNION ALL SELECT 'BIC', image, j.range, round_even(least(1, greatest(0, embedding[j.range + 1]::DOUBLE + 0.5)) * 255, 0) FROM s, range(48) j)
  SELECT tag, {Bq._SUMS} FROM l GROUP BY tag, image"""
_BLOCKS = " UNION ALL ".join([*(f"SELECT '{t}' AS tag, * FROM ({oracle_of('block_' + t.lower())})" for t in ("RES0", "RES1", "LITE", "PAL", "GRD")),
    f"SELECT 'DCT' AS tag, {Bq._SUMS} FROM (WITH {Q._T}, {Q._dct(Bq._STEP)} SELECT image, i * 8 + j AS i, q AS value FROM q WHERE tile % 3 > 0) GROUP BY image", f"({_EXTRA})"])


@register("container_blocks", _BLOCKS)
def container_blocks(spark, sf):
    """Ten kinds of blocks in real files, with several chunks, masks and scales, written and read by the data source; a payload for 512 tiles at most."""
    v = F.col("v")
    error = F.zip_with("v", Q.coarse(v), lambda a, b: a - b)
    both = lambda along: F.transform(T.forward("v", Q.SIDE, along), lambda x: Bq._byte(x * 64))
    mean = F.aggregate(error, F.lit(0.0), lambda s, x: s + x) / 64
    arrays = {
        "v": v, "bias": F.array(*[Bq._byte(mean * 255 * (c + 1)) for c in range(3)]), "grid": F.transform(F.slice(error, 1, 48), lambda x: Bq._byte(x * 255)), "light": F.transform("v", lambda x: B.lite_byte(F.lit(1.0) + x)),
        "label": F.transform("v", lambda x: F.floor((x + 1) * 8).cast("int").bitwiseAND(15)), "gx": both("x"), "gy": both("y"),
    }
    d = Q.embeddings(spark, sf).select("image", F.expr("tile div 512").alias("part"), "tile", *[a.alias(n) for n, a in arrays.items()])
    d = d.groupBy("image", "part").agg(F.array_sort(F.collect_list(F.struct("tile", *arrays))).alias("s"))
    of = lambda n: F.transform("s", lambda x: x[n])
    d = d.select(F.concat_ws("-", F.lit("part"), "image", "part").alias("name"), F.size("s").alias("n"), of("tile").alias("tile"), *[F.flatten(of(n)).alias(n) for n in arrays])
    path = session.fresh(spark, "containers")
    tile_files.save(Pi.built(d, "name", d.columns, _every_block), path)
    read = tile_files.load(spark, path, list(_READ), complete="true")

    def run(it):
        for b in it:
            for path_, tag, x in zip(*(b.column(c).to_pylist() for c in ("path", "tag", "payload")), strict=True):
                name, width, parse = _READ[tag]
                values = np.asarray(parse(x)[name], float)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([path_] * n), pa.array([tag] * n), pa.array(np.arange(n) % width), pa.array(values)], names=["path", "tag", "i", "value"])

    values = read.select("path", "tag", "payload").mapInArrow(run, "path string, tag string, i long, value double")
    image = F.regexp_extract("path", r"part-(-?\d+)-\d+\.tspk$", 1).cast("int")
    at = F.col("i") % 101 + 1
    return values.groupBy("tag", image.alias("image")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"), F.sum(F.col("value") * at).cast("long").alias("weighted"))


_TILES, _STEP = 4, 0.05
_BASES = ("BIC", "PAL", "GRD", "PRIM")


def _clip(x):
    return np.clip(x, 0, 1)


def _picture(r: dict) -> dict[str, bytes]:
    """A column of tiles whose base is the image's turn; some images have light, atoms and residuals over it, and one kind a second base that must not be drawn."""
    image, e = r["image"], np.array([t["e"] for t in r["s"]], float)
    tile = np.array([t["tile"] for t in r["s"]])
    n = len(e)
    p, c = np.arange(64), np.arange(3)
    sample = e[:, (p[:, None] + 7 * c[None, :]) % 64]  # n x 64 x 3
    blocks = {"HEAD": Pi.head(8 * n, 8)}
    base = _BASES[image % 4]
    labels = np.minimum(15, np.floor(_clip(e + 0.5) * 16)).astype(int).reshape(8 * n, 8)
    k = np.arange(16)
    palette = Pi.palette_blocks(np.stack([17 * k, 255 - 17 * k, 8 * k], axis=1), labels)
    if base == "BIC":
        control = e[:, (np.arange(16)[:, None] + 16 * c[None, :]) % 64]
        blocks |= Pi.bicubic_blocks(np.rint(_clip(control + 0.5) * 255)) | (palette if image % 8 == 4 else {})
    elif base == "PAL":
        blocks |= palette | {"LITE": B.pack("LITE", {"h": 1, "w": 1, "grid": [image % 9 - 4]})}
    elif base == "GRD":
        steps = np.floor(_clip(sample + 0.5) * 32).reshape(8 * n, 8, 3)
        gx, gy = np.zeros_like(steps), np.zeros_like(steps)
        gx[:, :-1], gy[:-1] = np.diff(steps, axis=1), np.diff(steps, axis=0)
        blocks |= Pi.gradient_blocks(gx, gy, steps.mean(axis=(0, 1)) / 64, 64) | {"RES2": B.atoms_json([{"pix": image % (64 * n), "dr": 40, "dg": -40, "db": 0}]).encode()}
    else:
        const = lambda v, a: {"kind": P.CONST, "geom": [], "color0": _clip(v + 0.5).tolist(), "color1": None, "alpha": a}
        stacks = [[const(x[:3], 1.0), const(x[3:6], 0.3)] for x in e]
        bias = np.stack([tile % 7 - 3, tile % 5 - 2, np.ones_like(tile)], axis=1)
        grids = e[:, 8:20].reshape(n, 2, 2, 3) * 0.5
        blocks |= Pi.stack_blocks(stacks, [8] * n, [(8 * i, 0) for i in range(n)], bias, grids)
    if image % 3 == 1:
        rest = e[:, (p[:, None] * 3 + 5 * c[None, :]) % 64] * 0.2
        blocks |= Pi.residual_block(list(rest), [8] * n, 0, _STEP, 0.0, tile % 3 > 0, 64 + tile % 128, banded=bool(image % 2))
    return blocks


_KK = Q._K
_PICTURES = f"""WITH {_KK}, y AS (SELECT u, n, c AS wt FROM k), t AS (SELECT vec_id AS tile, vec_id // {_TILES} AS image, vec_id % {_TILES} AS k, embedding AS e FROM embeddings),
x AS (SELECT tile, image, k, e, CAST(p.range AS INTEGER) AS p, CAST(p.range // 8 AS INTEGER) AS i, CAST(p.range % 8 AS INTEGER) AS j, CAST(c.range AS INTEGER) AS c FROM t, range(64) p, range(3) c),
n AS (SELECT CAST(i.range AS INTEGER) AS i, CAST(a.range AS INTEGER) AS a, [power(1 - i.range / 7.0::DOUBLE, 3), 3 * i.range / 7.0::DOUBLE * power(1 - i.range / 7.0::DOUBLE, 2), 3 * power(i.range / 7.0::DOUBLE, 2) * (1 - i.range / 7.0::DOUBLE), power(i.range / 7.0::DOUBLE, 3)][a.range + 1] AS b FROM range(8) i, range(4) a),
b AS (SELECT tile, image, k, x.p, c, sum(u.b * v.b * round_even(least(1, greatest(0, e[(u.a * 4 + v.a + 16 * c) % 64 + 1]::DOUBLE + 0.5)) * 255, 0) / 255) AS v FROM x JOIN n u ON u.i = x.i JOIN n v ON v.i = x.j WHERE image % 4 = 0 GROUP BY ALL),
l AS (SELECT tile, image, k, p, c, least(15, floor(least(1, greatest(0, e[p + 1]::DOUBLE + 0.5)) * 16)) AS q FROM x WHERE image % 4 = 1),
g AS (SELECT tile, image, k, p, c, floor(least(1, greatest(0, e[(p + 7 * c) % 64 + 1]::DOUBLE + 0.5)) * 32) / 64 AS v FROM x WHERE image % 4 = 2),
z AS (SELECT image, count(*) AS n FROM t GROUP BY 1),
w AS (SELECT *, least(1.0, greatest(0.0, (i + 0.5) * 2 / 8 - 0.5)) AS fy, least(1.0, greatest(0.0, (j + 0.5) * 2 / 8 - 0.5)) AS fx, round_even(0.3::DOUBLE * 65535, 0) / 65535 AS a,
   round_even(least(1, greatest(0, e[c + 1]::DOUBLE + 0.5)) * 255, 0) / 255 AS c0, round_even(least(1, greatest(0, e[c + 4]::DOUBLE + 0.5)) * 255, 0) / 255 AS c1,
   [greatest(-127, least(127, round_even(e[8 + m * 3 + c + 1]::DOUBLE * 0.5 * 127, 0))) / 127 for m in [0, 1, 2, 3]] AS r FROM x WHERE image % 4 = 3),
d AS (SELECT tile, image, k, p, c, v FROM b
  UNION ALL SELECT tile, image, k, p, c, CASE c WHEN 0 THEN 17 * q WHEN 1 THEN 255 - 17 * q ELSE 8 * q END / 255 * (1 + (image % 9 - 4) / 64.0::DOUBLE) FROM l
  UNION ALL SELECT tile, g.image, k, p, c, CASE WHEN k * 64 + p = g.image % (64 * n) THEN least(1, greatest(0, v + CASE c WHEN 0 THEN 40 WHEN 1 THEN -40 ELSE 0 END / 255.0::DOUBLE)) ELSE v END FROM g JOIN z ON z.image = g.image
  UNION ALL SELECT tile, image, k, p, c, least(1, greatest(0, least(1, greatest(0, c1 * a + c0 * (1 - a) + CASE c WHEN 0 THEN tile % 7 - 3 WHEN 1 THEN tile % 5 - 2 ELSE 1 END / 255.0::DOUBLE))
    + (1 - fy) * ((1 - fx) * r[1] + fx * r[2]) + fy * ((1 - fx) * r[3] + fx * r[4]))) FROM w),
f AS (SELECT tile, x.c AS c, u.u AS a, v.u AS b, round_even(sum(e[(p * 3 + 5 * c) % 64 + 1]::DOUBLE * 0.2 * u.wt * v.wt) / ({_STEP}::FLOAT::DOUBLE * power(2, (64 + tile % 128) / 255.0::DOUBLE * 4 - 2)), 0) AS q
  FROM x JOIN y u ON u.n = x.i JOIN y v ON v.n = x.j WHERE image % 3 = 1 AND tile % 3 > 0 GROUP BY tile, x.c, u.u, v.u),
h AS (SELECT tile, f.c AS c, u.n * 8 + v.n AS p, sum(q * {_STEP}::FLOAT::DOUBLE * power(2, (64 + tile % 128) / 255.0::DOUBLE * 4 - 2) * u.wt * v.wt) AS r FROM f JOIN y u ON u.u = f.a JOIN y v ON v.u = f.b GROUP BY ALL),
o AS (SELECT image, c, k * 64 + p AS pos, least(1, greatest(0, v + coalesce(r, 0))) AS v FROM d LEFT JOIN h USING (tile, c, p))
SELECT image, CASE image % 4 WHEN 0 THEN 'BIC' WHEN 1 THEN 'PAL' WHEN 2 THEN 'GRD' ELSE 'PRIM' END AS base, c AS ch, count(*) AS n, round(avg(v) + 1e-8, 6) AS mean, round(avg(v * (pos % 13)) + 1e-7, 5) AS weighted FROM o GROUP BY ALL"""


@register("decode_dispatch", _PICTURES)
def decode_dispatch(spark, sf):
    """Pictures of four kinds written as files and drawn from what each file has. Means get a hair before they are rounded: palettes give exact halves."""
    e = table_of(spark, sf)
    path = session.fresh(spark, "pictures")
    tile_files.save(Pi.built(e, "image", ["image", "s"], _picture), path)
    d = Pi.drawn(tile_files.load(spark, path, complete="true"))
    d = d.select(F.regexp_extract("path", r"(\d+)\.tspk$", 1).cast("long").alias("image"), F.coalesce("base", "error").alias("base"), F.posexplode_outer("v").alias("p", "v"))
    at = F.expr("p div 3")
    return d.groupBy("image", "base", (F.col("p") % 3).cast("int").alias("ch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v") + 1e-8, 6).alias("mean"), F.round(F.avg(F.col("v") * (at % 13)) + 1e-7, 5).alias("weighted"))


def table_of(spark, sf):
    """image and s, its tiles (tile, e) in order; four at most."""
    d = session.table(spark, sf, "embeddings").select(F.expr(f"vec_id div {_TILES}").alias("image"), F.struct(F.col("vec_id").alias("tile"), F.col("embedding").cast("array<double>").alias("e")).alias("t"))
    return d.groupBy("image").agg(F.array_sort(F.collect_list("t")).alias("s"))
