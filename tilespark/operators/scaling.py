"""Images at another size: separable filters over rows, then over columns.

An image is rows (image, y, v: a row's samples, channels side by side). The first pass works on each row by itself, without a shuffle. For the second, rows are cut into bands of
``BAND`` columns, and what meets in a task is one band of an image, so neither an image nor its largest dimension squared has to fit; the rows are put together again at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a band.
BAND = 32


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


FILTERS = {"lanczos": (lanczos, 3.0), "bilinear": (triangle, 1.0)}


@lru_cache(maxsize=64)
def weights(before: int, after: int, kind: str = "lanczos") -> np.ndarray:
    """after x before: what each old sample gives to each new one. Smaller images widen the filter; beyond the borders there is nothing, and each row sums to one."""
    f, _ = FILTERS[kind]
    scale = before / after
    wide = max(1.0, scale)
    w = f(((np.arange(before)[None, :] + 0.5) - (np.arange(after)[:, None] + 0.5) * scale) / wide)
    return w / w.sum(axis=1, keepdims=True)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def resized(rows: DataFrame, height: str, width: str, channels: int = 1, kind: str = "lanczos") -> DataFrame:
    """Rows (image, y, v) at the size that columns of theirs (one value an image) ask for: image, y and v. Missing rows and rows with null samples spoil only their image, which comes out
    as no rows; images whose target is not positive do too."""
    if kind not in FILTERS:
        raise ValueError(f"no filter {kind}")
    image = f"`image` {rows.schema['image'].dataType.simpleString()}"
    d = rows.select("image", F.col("y").cast("int").alias("y"), F.col(height).cast("int").alias("h"), F.col(width).cast("int").alias("w"), F.col("v").cast("array<double>").alias("v")).filter("h > 0 AND w > 0 AND v IS NOT NULL")

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list = []
            for v, w in zip(b.column("v"), b.column("w").to_pylist(), strict=True):
                line = v.values.to_numpy(zero_copy_only=False).reshape(-1, channels)
                out.append((weights(len(line), w, kind) @ line) if len(line) else np.full((w, channels), np.nan))
            bands = [-(-len(x) // BAND) for x in out]
            of = pa.array(np.repeat(np.arange(len(out)), bands))
            parts = [x[i * BAND : (i + 1) * BAND].reshape(-1) for x, n in zip(out, bands, strict=True) for i in range(n)]
            number = np.concatenate([np.arange(n) for n in bands]).astype(np.int32) if bands else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ("image", "y", "h")), pa.array(number), _lists(parts)], names=["image", "y", "h", "band", "v"])

    d = d.mapInArrow(across, f"{image}, y int, h int, band int, v array<double>")
    d = d.groupBy("image", "band").agg(F.max("h").alias("h"), F.array_sort(F.collect_list(F.struct("y", "v"))).alias("s"))

    def down(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                h, s = b.column("h")[i].as_py(), b.column("s")[i].values
                ys = s.field("y").to_numpy(zero_copy_only=False)
                lengths = s.field("v").value_lengths().to_numpy(zero_copy_only=False)
                if not np.array_equal(ys, np.arange(len(ys))) or len(set(lengths.tolist())) != 1:
                    continue
                m = s.field("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ys), -1)
                if not np.isfinite(m).all():
                    continue
                made = weights(len(ys), h, kind) @ m
                one = pa.array(np.full(h, i))
                yield pa.RecordBatch.from_arrays([b.column("image").take(one), b.column("band").take(one), pa.array(np.arange(h, dtype=np.int32)), _lists(list(made))], names=["image", "band", "y", "v"])

    d = d.mapInArrow(down, f"{image}, band int, y int, v array<double>")
    d = d.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("band", "v"))).alias("s"))
    return d.select("image", "y", F.flatten(F.transform("s", lambda x: x["v"])).alias("v"))
