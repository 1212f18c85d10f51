"""Image files to containers by the encoder that suits each part best, and back.

An image is cut into parts of at most ``SIDE`` by ``SIDE`` pixels; what meets in a task is a part's tiles, never an image. Every encoder makes a part's blocks, these are drawn again as a reader would, and the least
mean squared error plus lambda times the bits of a tile wins (the first on ties). A part is a container of its own, so parts of one image may have different bases. A part that an encoder fails on is
left to the others; one that all fail on is a row with its error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import codec, refine, residual
from tilespark.operators import kernels as K
from tilespark.operators import pictures as Pi
from tilespark.sources import container
from tilespark.sources.container import FormatError

SIDE, TILE = 128, 8
PALETTE = 32
#: Gradients are coded in 127ths and smaller ones left out; residuals in luma and halved chroma.
SLOPE, DEAD = 127, 0.01


def _tiles(rgb: np.ndarray) -> np.ndarray:
    """Tiles in row order, n x TILE^2 x 3; the edge is repeated."""
    h, w, _ = rgb.shape
    p = np.pad(rgb, ((0, -h % TILE), (0, -w % TILE), (0, 0)), mode="edge")
    return p.reshape(p.shape[0] // TILE, TILE, p.shape[1] // TILE, TILE, 3).swapaxes(1, 2).reshape(-1, TILE * TILE, 3)


def _bicubic(rgb: np.ndarray, quality: int) -> dict[str, bytes]:
    t = _tiles(rgb)
    return Pi.bicubic_blocks(np.rint(np.clip(np.stack([K.bicubic_fit(t[:, :, c]) for c in range(3)], axis=2), 0, 1) * 255))


def _palette(rgb: np.ndarray, quality: int) -> dict[str, bytes]:
    colours, labels = K.median_cut(rgb.reshape(-1, 3), PALETTE)
    return Pi.palette_blocks(np.rint(np.clip(colours, 0, 1) * 255).astype(int), labels.reshape(rgb.shape[:2]))


def _gradient(rgb: np.ndarray, quality: int) -> dict[str, bytes]:
    gx, gy = np.zeros_like(rgb), np.zeros_like(rgb)
    gx[:, :-1], gy[:-1] = np.diff(rgb, axis=1), np.diff(rgb, axis=0)
    code = lambda g: np.clip(np.rint(np.where(np.abs(g) < DEAD, 0, g) * SLOPE), -127, 127)
    return Pi.gradient_blocks(code(gx), code(gy), rgb.mean(axis=(0, 1)), SLOPE)


def _stacks(rgb: np.ndarray, quality: int) -> dict[str, bytes]:
    t = _tiles(rgb)
    s, _ = refine.fit(t, TILE, quality, 1e-6)
    back = refine.L.compose(s.layers(), len(t), TILE, TILE)
    bias = np.clip(np.rint((t - back).mean(axis=1) * 255), -127, 127)
    return Pi.stack_blocks(s.lists(), [TILE] * len(t), None, bias)


def _with_residual(base: Callable) -> Callable:
    def made(rgb: np.ndarray, quality: int) -> dict[str, bytes]:
        blocks = base(rgb, quality)
        h, w, _ = rgb.shape
        rest = _tiles(rgb - Pi.draw({"HEAD": Pi.head(h, w, side=TILE), **blocks})[1])
        present = (rest**2).mean(axis=(1, 2)) > 1e-6
        return blocks | Pi.residual_block(list(rest), [TILE] * len(rest), residual.YCC_HALVED, codec.step_of(quality), 0.5, present, banded=True)

    return made


ENCODERS: dict[str, Callable[[np.ndarray, int], dict[str, bytes]]] = {
    "bicubic": _bicubic, "palette": _palette, "gradient": _gradient, "stacks": _stacks, "bicubic-dct": _with_residual(_bicubic), "stacks-dct": _with_residual(_stacks),
}


def check(basis: str) -> list[str]:
    """The encoders of a basis: one, or all of them for auto."""
    if basis != "auto" and basis not in ENCODERS:
        raise ValueError(f"no encoder {basis}: auto, {', '.join(ENCODERS)}")
    return list(ENCODERS) if basis == "auto" else [basis]


def encode_part(rgb: np.ndarray, quality: int, basis: str = "auto", y: int = 0, x: int = 0) -> tuple[str, dict[str, bytes], float, int]:
    """The winner's name, blocks, mean squared error (of what a reader draws) and bits."""
    lam = ((101 - quality) / 100) ** 2 * (2e-4 if quality >= 90 else 1e-3)
    h, w, _ = rgb.shape
    n = -(-h // TILE) * -(-w // TILE)
    best, told = None, ""
    for name in check(basis):
        try:
            blocks = {"HEAD": Pi.head(h, w, y, x, TILE), **ENCODERS[name](rgb, quality)}
            mse = float(((Pi.draw(blocks)[1] - rgb) ** 2).mean())
        except (FormatError, np.linalg.LinAlgError) as e:
            told = f"{name}: {e}"
            continue
        bits = 8 * sum(len(container.squeeze(b, 3)) for b in blocks.values())
        if best is None or mse + lam * bits / n < best[0]:
            best = (mse + lam * bits / n, name, blocks, mse, bits)
    if best is None:
        raise FormatError(told)
    return best[1:]


def encode(tiles: DataFrame, quality: int, basis: str = "auto") -> DataFrame:
    """(image, height, width, ch, tile, v: the image source's tiles of TILE) to name, blocks, meta (what ``tile_files.save`` takes), image, y, x, basis, mse, bits and error, a row for each part."""
    check(basis)
    per = SIDE // TILE
    across = F.ceil(F.col("width") / TILE)
    ty, tx = F.floor(F.col("tile") / across).cast("int"), (F.col("tile") % across).cast("int")
    d = tiles.withColumn("ty", ty).withColumn("tx", tx)
    piece = F.struct("ch", (F.col("ty") % per).alias("ty"), (F.col("tx") % per).alias("tx"), F.col("v").cast("array<double>").alias("v"))
    d = d.groupBy("image", "height", "width", F.expr(f"ty div {per}").cast("int").alias("py"), F.expr(f"tx div {per}").cast("int").alias("px")).agg(F.collect_list(piece).alias("t"))  # (SIDE / TILE)^2 tiles a channel at most
    schema = pa.schema([("name", pa.string()), ("blocks", pa.map_(pa.string(), pa.binary())), ("meta", pa.string()), ("image", pa.string()), ("y", pa.int32()), ("x", pa.int32()), ("basis", pa.string()), ("mse", pa.float64()), ("bits", pa.int64()), ("error", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                image, height, width, py, px = (b.column(c)[i].as_py() for c in ("image", "height", "width", "py", "px"))
                t = b.column("t")[i].values
                y, x = py * SIDE, px * SIDE
                h, w = min(SIDE, height - y), min(SIDE, width - x)
                grid = np.full((-(-h // TILE), -(-w // TILE), 3, TILE * TILE), np.nan)
                at = [t.field(c).to_numpy(zero_copy_only=False) for c in ("ty", "tx", "ch")]
                name = f"{hashlib.sha256(str(image).encode()).hexdigest()[:20]}-{py}-{px}"
                row: list = [name, None, None, image, y, x, None, None, None, None]
                try:
                    lengths = t.field("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    if (lengths != TILE * TILE).any():
                        raise FormatError("a tile of another size")
                    grid[at[0], at[1], at[2]] = t.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, TILE * TILE)
                    if not np.isfinite(grid).all():
                        raise FormatError("samples are missing")
                    rgb = grid.reshape(*grid.shape[:3], TILE, TILE).transpose(0, 3, 1, 4, 2).reshape(grid.shape[0] * TILE, grid.shape[1] * TILE, 3)[:h, :w]
                    won, blocks, mse, bits = encode_part(rgb, quality, basis, y, x)
                    meta = container.canonical({"image": image, "height": height, "width": width, "quality": quality, "basis": won}).decode()
                    row = [name, list(blocks.items()), meta, image, y, x, won, mse, bits, None]
                except FormatError as e:
                    row[-1] = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return d.mapInArrow(run, "name string, blocks map<string,binary>, meta string, image string, y int, x int, basis string, mse double, bits long, error string")


def restored(blocks: DataFrame) -> DataFrame:
    """Blocks as the data source reads them to image, height, width, png and error. A picture's file is one value, so its parts meet in one task, drawn; an image that has lost a part, or one of whose parts is
    broken, has its error and no png."""
    from tilespark.sources import images

    meta = F.from_json("meta", "struct<image:string,height:int,width:int>")
    whole = blocks.filter("meta IS NOT NULL").groupBy("path").agg(F.first(meta).alias("m"))
    d = Pi.drawn(blocks).join(whole, "path").select("m.image", F.col("m.height").alias("h"), F.col("m.width").alias("w"), "height", "width", "y", "x", "v", "error")
    d = d.groupBy("image", "h", "w").agg(F.collect_list(F.struct("height", "width", "y", "x", "v")).alias("parts"), F.max("error").alias("error"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                h, w, told = (b.column(c)[i].as_py() for c in ("h", "w", "error"))
                out, seen = np.zeros((h, w, 3)), np.zeros((h, w), bool)
                p = b.column("parts")[i].values
                for k in range(len(p) if told is None else 0):
                    ph, pw, y, x = (p.field(c)[k].as_py() for c in ("height", "width", "y", "x"))
                    out[y : y + ph, x : x + pw] = p.field("v")[k].values.to_numpy(zero_copy_only=False).reshape(ph, pw, 3)
                    seen[y : y + ph, x : x + pw] = True
                if told is None and not seen.all():
                    told = "a part is missing"
                made = None if told else images.png(out)
                yield pa.RecordBatch.from_arrays([b.column("image").slice(i, 1), b.column("h").slice(i, 1), b.column("w").slice(i, 1), pa.array([made], pa.binary()), pa.array([told], pa.string())], names=["image", "height", "width", "png", "error"])

    return d.mapInArrow(run, "image string, height int, width int, png binary, error string")
