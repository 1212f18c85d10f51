"""Fits that are made once: a table of them by content, published whole, joined before anything is fitted, and the variants that share it.

A fit's key is 128 bits of the settings that it depends on and of its tile's samples, so equal tiles of all images, runs and variants are one row. The cache is a folder of Parquet tables, one a run. A run
writes what was missing below a name that readers skip and then renames that folder: others see all of a run's fits or none. Runs that overlap may both make a fit; either is taken.
What can't be read counts as missing. ``forget`` drops runs, ``tidy`` makes one table of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.operators import primitives as P
from tilespark.operators import refine
from tilespark.sources.container import canonical

#: Changes where a fit of the same tile and settings would come out differently.
VERSION = 1
BATCH = 256
_TABLE = f"key string, prims array<{P.DDL}>, before double, after double"


def settings(quality: int = 75, lam: float = 1e-6, width: int = 1, refined: bool = False, side: int = 8) -> dict:
    """Everything that a fit depends on beside its tile, and nothing that only later steps read."""
    return {"quality": int(quality), "lam": float(lam), "width": int(width), "refined": bool(refined), "side": int(side)}


def keyed(tiles: DataFrame, of: dict, v: str = "v") -> DataFrame:
    told = F.lit(canonical({**of, "version": VERSION}).decode())
    return tiles.withColumn("key", F.concat(F.lpad(F.hex(F.xxhash64(told, v)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), told, v)), 16, "0")))


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def runs(spark: SparkSession, cache: str) -> list[str]:
    """Folders of published runs."""
    fs, p = _files(spark, cache)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("run-"))


def read(spark: SparkSession, cache: str) -> DataFrame:
    """All fits, a row a key. A run whose files can't be read is left out."""
    from pyspark.errors import AnalysisException

    good = []
    for r in runs(spark, cache):
        try:
            spark.read.parquet(r)
        except AnalysisException:
            continue
        good.append(r)
    d = spark.read.schema(_TABLE).parquet(*good) if good else spark.createDataFrame([], _TABLE)
    return d.groupBy("key").agg(*[F.first(c).alias(c) for c in ("prims", "before", "after")])


def _publish(spark: SparkSession, d: DataFrame, cache: str) -> str:
    name = uuid.uuid4().hex
    d.write.parquet(f"{cache}/_{name}")
    fs, old = _files(spark, f"{cache}/_{name}")
    _, new = _files(spark, f"{cache}/run-{name}")
    if not fs.rename(old, new):
        raise OSError(f"{old} could not be published")
    return f"{cache}/run-{name}"


def _fitted(missing: DataFrame, of: dict) -> DataFrame:
    side = of["side"]
    pixels = side * side
    stack = pa.list_(pa.struct([("kind", pa.int32()), ("geom", pa.list_(pa.float64())), ("color0", pa.list_(pa.float64())), ("color1", pa.list_(pa.float64())), ("alpha", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, pixels, 3)
                before = refine.objective(v, refine.Set.empty(len(v), 1), side, of["lam"])
                s, after = refine.fit(v, side, of["quality"], of["lam"], of["width"], of["refined"])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(s.lists(), stack), pa.array(before), pa.array(after)], names=["key", "prims", "before", "after"])

    return missing.select("key", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, _TABLE)


def fitted(tiles: DataFrame, of: dict, cache: str) -> tuple[DataFrame, int]:
    """tiles (with v, side^2 * 3 samples in 0..1) with key, prims, before and after, and how many fits had to be made. Tiles whose v is null, of another length or not finite have no fit: nulls.
    Jobs run when this is called."""
    spark = tiles.sparkSession
    good = F.coalesce((F.size("v") == of["side"] ** 2 * 3) & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    d = keyed(tiles, of).withColumn("key", F.when(good, F.col("key")))
    missing = d.filter("key IS NOT NULL").select("key", "v").dropDuplicates(["key"]).join(read(spark, cache).select("key"), "key", "left_anti")
    made = _publish(spark, _fitted(missing, of), cache)
    n = spark.read.parquet(made).count()
    if not n:
        forget(spark, [made])
    return d.join(read(spark, cache), "key", "left"), n


def forget(spark: SparkSession, folders: list[str]) -> None:
    for f in folders:
        fs, p = _files(spark, f)
        fs.delete(p, True)


def tidy(spark: SparkSession, cache: str, keep: DataFrame | None = None) -> None:
    """One run of all fits, or of those whose key is in keep; the old runs go once it is published."""
    old = runs(spark, cache)
    d = read(spark, cache)
    _publish(spark, d.join(keep.select("key").distinct(), "key", "left_semi") if keep is not None else d, cache)
    forget(spark, old)


def drawn(prims: pa.Array, side: int) -> np.ndarray:
    """The tiles of a column of stacks."""
    from tilespark.operators import layers as L

    return L.compose(L.layers(prims), len(prims), side, side)


def wire_bits(prims: pa.Array) -> np.ndarray:
    from tilespark.operators import layers as L

    s = L.layers(prims)
    return 8.0 + np.bincount(s.tile, 8.0 * refine.BYTES[s.kind], minlength=len(prims))
