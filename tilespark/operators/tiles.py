"""Tiles as rows with an array of samples, or one row a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long(tiles: DataFrame, array: str, side: int, keep: list[str]) -> DataFrame:
    """keep, p, y, x, v: a row for each pixel."""
    d = tiles.select(*keep, F.posexplode(array).alias("p", "__v"))
    return d.select(*keep, "p", F.expr(f"p div {side}").cast("int").alias("y"), (F.col("p") % side).alias("x"), F.col("__v").cast("double").alias("v"))


def cut(pixels: DataFrame, width: Column, height: Column, side: int, keep: list[str]) -> DataFrame:
    """Pixels (keep, y, x, v) to uniform tiles with an array each; missing pixels repeat the image's edge.

    A pixel on the last row or column is copied into the places that the tiles have beyond it."""
    d = pixels.withColumn("__w", width).withColumn("__h", height)
    reach = lambda c, n: F.sequence(F.col(c), F.when(F.col(c) == n - 1, F.ceil(n / side).cast("int") * side - 1).otherwise(F.col(c)))
    d = d.withColumn("__y", F.explode(reach("y", F.col("__h")))).withColumn("__x", F.explode(reach("x", F.col("__w"))))
    ty, tx = F.expr(f"__y div {side}"), F.expr(f"__x div {side}")
    p = (F.col("__y") % side) * side + F.col("__x") % side
    d = d.groupBy(*keep, ty.alias("ty"), tx.alias("tx")).agg(F.array_sort(F.collect_list(F.struct(p.alias("p"), "v"))).alias("__s"))
    return d.select(*keep, "ty", "tx", F.transform("__s", lambda s: s["v"]).alias("samples"))


def forward(v: str, side: int, along: str) -> Column:
    """Forward difference of a tile's array, 0 at the far edge."""
    step = 1 if along == "x" else side
    inside = (lambda i: i % side < side - 1) if along == "x" else (lambda i: i < side * (side - 1))
    return F.transform(v, lambda e, i: F.when(inside(i), F.get(v, i + step) - e).otherwise(F.lit(0.0)))


def mean_squared_error(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def psnr(mse: Column) -> Column:
    """Of samples in [0, 1]; 100 dB at most."""
    return F.when(mse <= 1e-12, 100.0).otherwise(F.log10(mse) * -10)


def split_levels(pixels: DataFrame, keep: list[str], side: int, least: int, threshold: float) -> DataFrame:
    """Quadtree leaves (keep, size, by, bx, variance): a block is split while its population variance reaches the threshold.

    One aggregate over all levels; a level's blocks are those whose parents were split."""
    sizes = []
    s = side
    while s >= least:
        sizes.append(s)
        s //= 2
    d = pixels.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    d = d.withColumn("by", F.floor(F.col("y") / F.col("size")).cast("int")).withColumn("bx", F.floor(F.col("x") / F.col("size")).cast("int"))
    v = d.groupBy(*keep, "size", "by", "bx").agg(F.round(F.var_pop("v"), 9).alias("variance"))
    here, leaves = v.filter(F.col("size") == side), None
    for s in sizes:
        done = here if s == least else here.filter(F.col("variance") < threshold)
        leaves = done if leaves is None else leaves.unionByName(done)
        if s > least:
            parents = here.filter(F.col("variance") >= threshold).select(*keep, F.col("by").alias("pby"), F.col("bx").alias("pbx"))
            kids = v.filter(F.col("size") == s // 2).withColumn("pby", F.expr("by div 2").cast("int")).withColumn("pbx", F.expr("bx div 2").cast("int"))
            here = kids.join(parents, [*keep, "pby", "pbx"], "left_semi").drop("pby", "pbx")
    return leaves
