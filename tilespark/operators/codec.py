"""Images of tiles to containers and back.

An image's tiles may be many, so an image is cut into parts of PART tiles and each part is a container of its own: no task
ever holds more than a part. Each part picks the layout (tile by tile, or band by band) and the basis (transform or
bicubic, by tile) that is cheapest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import kernels as K
from tilespark.sources import container

PART = 4096
SIDE = 8


def step_of(quality: int) -> float:
    return min(0.20, max(0.003, 0.2 * ((101 - min(99, max(10, quality))) / 100) ** 2))


def encode_part(tiles: np.ndarray, quality: int) -> bytes:
    """One container from a matrix of tiles."""
    step = step_of(quality)
    q = K.dct_quantise(tiles, step).astype("<i2")
    control = np.rint(np.clip(K.bicubic_fit(tiles) + 0.5, 0, 1) * 255).astype(np.uint8)
    smooth = K.bicubic_eval(control / 255 - 0.5, SIDE)
    lam = ((101 - quality) / 100) ** 2 * (2e-4 if quality >= 90 else 1e-3)
    cost_q = ((tiles - K.dct_restore(q, step)) ** 2).mean(axis=1) + lam * (4 * (q != 0).sum(axis=1) + 32)
    cost_b = ((tiles - smooth) ** 2).mean(axis=1) + lam * 8 * 16
    bicubic = cost_b < cost_q
    rest = q[~bicubic]
    rows, bands = container.squeeze(rest.tobytes()), container.squeeze(rest[:, list(K.zigzag(SIDE))].T.tobytes())
    banded = len(bands) < len(rows)
    data = (rest[:, list(K.zigzag(SIDE))].T if banded else rest).tobytes()
    blocks = {"HEAD": np.array([len(tiles), SIDE, quality, banded], "<u4").tobytes(), "MODE": np.packbits(bicubic, bitorder="little").tobytes(), "DCT": data, "BIC": control[bicubic].tobytes()}
    return container.write(blocks, {"quality": quality, "tiles": len(tiles)})


def decode_part(blob: bytes) -> np.ndarray:
    blocks, _ = container.read(blob)
    n, side, quality, banded = np.frombuffer(blocks["HEAD"], "<u4").tolist()
    bicubic = np.unpackbits(np.frombuffer(blocks["MODE"], np.uint8), count=n, bitorder="little").astype(bool)
    q = np.frombuffer(blocks["DCT"], "<i2")
    if banded:
        straight = np.empty((n - bicubic.sum(), side * side), np.int16)
        straight[:, list(K.zigzag(side))] = q.reshape(side * side, -1).T
        q = straight
    out = np.empty((n, side * side))
    out[~bicubic] = K.dct_restore(q.reshape(-1, side * side), step_of(quality))
    out[bicubic] = K.bicubic_eval(np.frombuffer(blocks["BIC"], np.uint8).reshape(-1, 16) / 255 - 0.5, side)
    return out


def encode(tiles: DataFrame, quality: int) -> DataFrame:
    """(image, tile, v) to image, part, tiles, samples (as they came) and blob."""
    d = tiles.withColumn("part", F.expr(f"tile div {PART}"))
    g = d.groupBy("image", "part").agg(F.array_sort(F.collect_list(F.struct("tile", "v"))).alias("s"))
    g = g.select("image", "part", F.transform("s", lambda x: x["tile"]).alias("tiles"), F.flatten(F.transform("s", lambda x: x["v"])).alias("samples"))

    def run(it):
        for b in it:
            blobs = [encode_part(np.array(x).reshape(-1, SIDE * SIDE), quality) for x in b.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blobs, pa.binary())], names=[*b.schema.names, "blob"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in g.schema)
    return g.mapInArrow(run, f"{kinds}, blob binary")


def decode(parts: DataFrame) -> DataFrame:
    """image, tile, mse, worst, bytes: each tile as its container gives it, held against the samples."""

    def run(it):
        for b in it:
            for r in b.to_pylist():
                back = decode_part(r["blob"])
                e = np.array(r["samples"]).reshape(back.shape) - back
                n = len(back)
                yield pa.RecordBatch.from_arrays([pa.array([r["image"]] * n, b.schema.field("image").type), pa.array(r["tiles"]), pa.array((e**2).mean(axis=1)), pa.array(np.abs(e).max(axis=1)), pa.array([len(r["blob"])] * n, pa.int64())],
                                                 names=["image", "tile", "mse", "worst", "bytes"])

    kind = parts.schema["image"].dataType.simpleString()
    return parts.mapInArrow(run, f"image {kind}, tile long, mse double, worst double, bytes long")


#: What an image's samples are moved by before they are coded: bicubic controls hold -0.5 to 0.5.
MIDDLE = 0.5


def encode_images(tiles: DataFrame, quality: int) -> DataFrame:
    """(image, height, width, ch, tile, v), as the image source cuts them, to image, height, width, ch, part and blob."""
    plane = F.struct("image", "height", "width", "ch").alias("image")
    d = tiles.select(plane, "tile", F.transform("v", lambda x: x - MIDDLE).alias("v"))
    return encode(d, quality).select("image.*", "part", "blob")


def restore_images(parts: DataFrame) -> DataFrame:
    """image, height, width and png: what encode_images made, decoded.

    A picture's file is one value, so its parts meet in one task, compressed; an image that has lost a part has a null png."""
    from tilespark.sources import images

    d = parts.groupBy("image", "height", "width").agg(F.collect_list(F.struct("ch", "part", "blob")).alias("parts"))

    def picture(h: int, w: int, rows: list[dict]) -> bytes | None:
        across, down = -(-w // SIDE), -(-h // SIDE)
        out = np.empty((down * across, images.CHANNELS, SIDE * SIDE))
        filled = np.zeros((down * across, images.CHANNELS), bool)
        for r in rows:
            v = decode_part(r["blob"])
            at = slice(r["part"] * PART, r["part"] * PART + len(v))
            out[at, r["ch"]] = v + MIDDLE
            filled[at, r["ch"]] = True
        if not filled.all():
            return None
        grid = out.reshape(down, across, images.CHANNELS, SIDE, SIDE).transpose(0, 3, 1, 4, 2)
        return images.png(grid.reshape(down * SIDE, across * SIDE, images.CHANNELS)[:h, :w])

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                name, h, w, rows = (c[i].as_py() for c in b.columns)
                made = pa.array([picture(h, w, rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(i, 1) for c in b.columns[:3]] + [made], names=["image", "height", "width", "png"])

    return d.mapInArrow(run, "image string, height int, width int, png binary")
