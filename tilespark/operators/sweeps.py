"""Sweep grids: products of axes in axis order, named by template, and pairs of techniques."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of a sweep that one pass over the tiles evaluates; more are refused.
MOST_CELLS = 10_000


def grid(spark: SparkSession, axes: dict, template: str) -> DataFrame:
    """ord, name and the axes' values. An axis is a list or a DataFrame of one column; grids are as small as the axes are few."""
    out = None
    for name, values in axes.items():
        d = values if isinstance(values, DataFrame) else spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
        out = d if out is None else out.crossJoin(d)
    order = Window.orderBy(*axes)
    return out.select((F.row_number().over(order) - 1).alias("ord"), named(template).alias("name"), *axes)


def named(template: str):
    """A column that fills {placeholders} from columns."""
    parts = [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def pairs(techniques: DataFrame, most: int) -> DataFrame:
    """Unordered pairs of (ord, name), in order, at most so many."""
    a, b = techniques.alias("a"), techniques.alias("b")
    p = a.join(b, F.col("a.ord") < F.col("b.ord")).orderBy("a.ord", "b.ord").limit(most)
    return p.select(F.concat_ws("+", "a.name", "b.name").alias("pair"), F.col("a.ord").alias("first"), F.col("b.ord").alias("second"))


def evaluated(tiles: DataFrame, cells: DataFrame, evaluate: Callable[[np.ndarray, dict], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Every cell (a row of cells: settings, few) on every image of tiles (image, v): the cells' columns, image, tiles, mse, bits and error.

    evaluate(matrix of tiles, cell) gives restored tiles and bits of each. What it raises is the error of that cell and of the images in that batch, whose metrics are null; all other cells and images
    go on, and the job doesn't fail. Tiles are read once for all cells and no image is in one task; what moves is one partial sum for each image, cell and batch. Tiles that are null or have null samples are an error
    of their image."""
    held = [r.asDict() for r in cells.limit(MOST_CELLS + 1).collect()]
    if len(held) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: run several sweeps")
    kind = tiles.schema["image"].dataType.simpleString()
    schema_ddl = f"cell int, image {kind}, n long, square double, bits double, error string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            codes = b.column("image").dictionary_encode()
            of, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            if codes.null_count:
                of, names = np.where(codes.is_valid().to_numpy(zero_copy_only=False), np.nan_to_num(of, nan=0), len(names)), pa.concat_arrays([names, pa.nulls(1, names.type)])
            of = of.astype(np.int64)
            whole = b.column("v").is_valid().to_numpy(zero_copy_only=False) & (b.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0)
            lengths = b.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            whole &= lengths == (np.bincount(lengths[whole]).argmax() if whole.any() else 0)
            v = b.column("v").filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(whole.sum()), -1) if whole.any() else np.zeros((0, 1))
            fine = np.isfinite(v).all(axis=1)
            mine, v = of[whole][fine], v[fine]
            bad = np.ones(len(of), bool)
            bad[np.flatnonzero(whole)[fine]] = False
            spoiled = np.bincount(of[bad], minlength=len(names)) > 0
            n = np.bincount(of, minlength=len(names))
            for k, cell in enumerate(held):
                square, bits, told = np.full(len(names), np.nan), np.full(len(names), np.nan), np.full(len(names), None, object)
                try:
                    back, cost = evaluate(v, dict(cell))
                    square = np.bincount(mine, ((back - v) ** 2).mean(axis=1), minlength=len(names))
                    bits = np.bincount(mine, np.asarray(cost, float), minlength=len(names))
                except Exception as e:  # the cell's error is a value
                    told[:] = f"{type(e).__name__}: {e}"
                told[spoiled & (told == None)] = "tiles without samples"  # noqa: E711
                out = np.array([t is not None for t in told])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), k), pa.int32()), names, pa.array(n, pa.int64()), pa.array(square, mask=out), pa.array(bits, mask=out), pa.array(told.tolist(), pa.string())],
                                                 names=["cell", "image", "n", "square", "bits", "error"])

    sums = tiles.select("image", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, schema_ddl)
    sums = sums.groupBy("cell", "image").agg(F.sum("n").alias("tiles"), F.max("error").alias("error"), F.sum("square").alias("square"), F.sum("bits").alias("bits"))
    ok = F.col("error").isNull()
    numbered = tiles.sparkSession.createDataFrame([(k, *r.values()) for k, r in enumerate(held)], "cell int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)) if held else None
    out = sums.select("cell", "image", "tiles", F.when(ok, F.col("square") / F.col("tiles")).alias("mse"), F.when(ok, F.col("bits")).alias("bits"), "error")
    if numbered is None:
        return cells.select(*cells.columns).join(out.drop("cell"), F.lit(False))
    return F.broadcast(numbered).join(out, "cell").drop("cell")
