"""Images as DataFrames: decoding by Spark's image source, discovery by extension, analytic images, PNG out.

Spark's image source gives an image as one row; from there on an image is tiles, cut by its task and handed on in batches
of BATCH tiles, so no row but the source's own holds an image.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "webp")
BATCH = 2048
CHANNELS = 3


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Paths of image files below a folder, sorted."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return d.filter(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*EXTENSIONS)).orderBy("path")


def _source(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return d.select(F.col("image.origin").alias("image"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))


def invalid(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder that the image source can't decode; tiles and pixels have none of them."""
    return _source(spark, path).filter("height < 1 OR width < 1").select("image")


def _linear() -> np.ndarray:
    """Linear light of each byte."""
    s = np.arange(256) / 255
    return np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)


def tiles(spark: SparkSession, path: str, side: int = 8) -> DataFrame:
    """image, height, width, ch (0 red, 1 green, 2 blue), tile (row by row), v: linear light of a tile's side * side samples.

    Tiles beyond the edge repeat the last row and column. Grey images have three equal channels; alpha is left out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light = _linear()
        for b in it:
            for i in range(b.num_rows):
                name, h, w, n, data = (c[i].as_py() for c in b.columns)
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                across = -(-w // side)
                xs = np.minimum(np.arange(across * side), w - 1)
                per = max(1, BATCH // across)
                for ch in range(CHANNELS):
                    plane = raw[:, :, 2 - ch if n >= 3 else 0]  # samples are blue, green, red
                    for top in range(0, -(-h // side), per):
                        rows = min(per, -(-h // side) - top)
                        ys = np.minimum(np.arange(top * side, (top + rows) * side), h - 1)
                        v = light[plane[np.ix_(ys, xs)]].reshape(rows, side, across, side).swapaxes(1, 2).reshape(-1, side * side)
                        at = np.arange(top * across, (top + rows) * across)
                        ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * side * side)
                        same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(len(at), np.int8)))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [same(name, pa.string()), same(h, pa.int32()), same(w, pa.int32()), same(ch, pa.int32()), pa.array(at), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))],
                            names=["image", "height", "width", "ch", "tile", "v"],
                        )

    return _source(spark, path).filter("height > 0 AND width > 0").mapInArrow(run, "image string, height int, width int, ch int, tile long, v array<double>")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """image, height, width, ch (0 red, 1 green, 2 blue), y, x, v: linear light of every pixel of every image."""
    side = 8
    d = tiles(spark, path, side).withColumn("across", F.expr(f"(width + {side - 1}) div {side}"))
    d = d.select("*", F.posexplode("v").alias("p", "s"))
    y, x = F.expr(f"int(tile div across * {side} + p div {side})"), F.expr(f"int(tile % across * {side} + p % {side})")
    return d.select("image", "height", "width", "ch", y.alias("y"), x.alias("x"), F.col("s").alias("v")).filter("y < height AND x < width")


def ramp(spark: SparkSession, side: int) -> DataFrame:
    """A diagonal ramp, one row a pixel and channel."""
    d = spark.range(side * side).select(F.expr(f"CAST(id div {side} AS int)").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    v = (F.col("x") + F.col("y")) / (2.0 * (side - 1))
    return d.withColumn("ch", F.explode(F.array(*map(F.lit, range(3))))).select(F.lit("ramp").alias("image"), "ch", "y", "x", v.alias("v"))


def png(rgb: np.ndarray) -> bytes:
    """An (h, w, 3) array of linear light as a PNG file."""
    s = np.clip(rgb, 0, 1)
    s = np.where(s <= 0.0031308, s * 12.92, 1.055 * s ** (1 / 2.4) - 0.055)
    u = (s * 255 + 0.5).astype(np.uint8)
    h, w, _ = u.shape
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = u.reshape(h, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 9)) + part(b"IEND", b"")


def save(files: DataFrame, folder: str) -> DataFrame:
    """(name, png) to files below a folder that the tasks reach (a path or a URI of Arrow's file systems); name and bytes of what was written.

    A file appears whole or not at all, under its name, so a task that runs again replaces it by the same bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for b in it:
            sizes = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = posixpath.join(base, name)
                system.create_dir(posixpath.dirname(path), recursive=True)
                attempt = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as f:
                    f.write(data)
                system.move(attempt, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "png").mapInArrow(run, "name string, bytes long")
