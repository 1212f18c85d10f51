"""Pictures as containers and back: the blocks of a part of an image, and the dispatch that draws whatever blocks a file has.

A part is a rectangle of an image that a task holds (HEAD says where it lies). Its base is one of four: bicubic patches (BIC), a palette (PAL), gradient fields (GRD) or stacks of primitives
(PRIM, with TOC and CIDX for its tiles and range-coded chunks, QTREE for tiles of mixed size, RES0 and RES1 for corrections). Where a file has several, the first of that order is drawn. Over the base come light
(LITE), sparse atoms (RES2) and the residual layer (DCT), in this order, and the result is clipped to 0..1.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.operators import blocks as B
from tilespark.operators import entropy, residual
from tilespark.operators import kernels as K
from tilespark.operators import layers as L
from tilespark.operators import primitives as P
from tilespark.sources import container
from tilespark.sources.container import FormatError

#: Tiles whose primitives are range-coded together.
CHUNK = 64


def head(height: int, width: int, y: int = 0, x: int = 0, side: int = 8) -> bytes:
    return B.pack("HEAD", {"height": height, "width": width, "y": y, "x": x, "side": side})


def stack_blocks(stacks: list[list[dict]], sizes: list[int], places: list[tuple[int, int]] | None = None, bias: list | None = None, grids: np.ndarray | None = None) -> dict[str, bytes]:
    """PRIM with its directory, tiles and corrections; without places, tiles are a grid in row order and have one size."""
    wire = [P.pack_tile(s, size) for s, size in zip(stacks, sizes, strict=True)]
    ends = np.cumsum([len(w) for w in wire])
    chunks, coded, at = [], b"", 0
    for start in range(0, len(wire), CHUNK):
        raw = b"".join(wire[start : start + CHUNK])
        part = entropy.encode(raw)
        chunks.append((start, len(wire[start : start + CHUNK]), at, len(raw), len(coded), len(part)))
        at += len(raw)
        coded += part
    out = {"TOC": B.pack("TOC", {"n": len(wire), "offsets": ends}), "CIDX": B.pack("CIDX", {"n": len(chunks), "chunks": np.array(chunks, B.CHUNK)}), "PRIM": coded}
    if places is not None:
        out["QTREE"] = B.pack("QTREE", {"n": len(wire), "tiles": np.array([(y, x, s) for (y, x), s in zip(places, sizes, strict=True)], B.TILE)})
    if bias is not None:
        out["RES0"] = B.pack("RES0", {"n": len(wire), "bias": np.asarray(bias).reshape(-1)})
    if grids is not None:
        codes = np.clip(np.rint(np.asarray(grids) * 127), -127, 127)
        out["RES1"] = B.pack("RES1", {"n": len(wire), "side": codes.shape[1], "grid": codes.reshape(-1)})
    return out


def palette_blocks(palette: np.ndarray, labels: np.ndarray) -> dict[str, bytes]:
    """palette: k x 3 bytes; labels: height x width."""
    return {"PAL": B.pack("PAL", {"k": len(palette), "h": labels.shape[0], "w": labels.shape[1], "palette": palette.reshape(-1), "labels": labels.reshape(-1)})}


def gradient_blocks(gx: np.ndarray, gy: np.ndarray, means: np.ndarray, scale: int) -> dict[str, bytes]:
    """gx, gy: height x width x channels signed codes, in scale-ths."""
    h, w, c = gx.shape
    return {"GRD": B.pack("GRD", {"h": h, "w": w, "scale": scale, "c": c, "means": means, "gx": gx.reshape(-1), "gy": gy.reshape(-1)})}


def bicubic_blocks(control: np.ndarray) -> dict[str, bytes]:
    """control: tiles x 16 x 3 bytes."""
    return {"BIC": B.pack("BIC", {"n": len(control), "control": control.reshape(-1)})}


def residual_block(tiles: list[np.ndarray], sizes: list[int], mode: int, step: float, alpha: float = 0.0, present: np.ndarray | None = None, scales: np.ndarray | None = None, banded: bool = False) -> dict[str, bytes]:
    """DCT of size^2 x 3 samples a tile: only tiles that are present have coefficients; scales are bytes, for each of those."""
    there = np.ones(len(tiles), bool) if present is None else np.asarray(present, bool)
    kept = [i for i in range(len(tiles)) if there[i]]
    codes = np.full(len(kept), 128) if scales is None else np.asarray(scales)[kept]
    q = [residual.encode(tiles[i][None], sizes[i], mode, step, alpha, step_scale(codes[j : j + 1]))[0] for j, i in enumerate(kept)]
    kept_sizes = [sizes[i] for i in kept]
    flat = residual.band_major(q, kept_sizes, mode) if banded else np.concatenate([*q, np.zeros(0)])
    values = {"chroma": mode, "step": step, "alpha": alpha, "channels": 3, "n": len(flat), "tiles": len(tiles), "layout": int(banded), "scaled": len(codes), "mask": np.packbits(there, bitorder="little"), "scales": codes, "coefficients": flat}
    return {"DCT": B.pack_dct(values)}


def step_scale(codes: np.ndarray) -> np.ndarray:
    """Bytes to step scales of 1/4 to 4, evenly in log2."""
    return 2.0 ** (np.asarray(codes, float) / 255 * 4 - 2)


def _grid(height: int, width: int, side: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(0, height, side) for x in range(0, width, side)]


def _pasted(tiles: list[np.ndarray] | np.ndarray, places: list[tuple[int, int]], sizes: list[int], height: int, width: int) -> np.ndarray:
    reach = max([1, *sizes])
    out = np.zeros((height + reach, width + reach, 3))
    if len(tiles) != len(places):
        raise FormatError(f"{len(tiles)} tiles for {len(places)} places")
    for t, (y, x), s in zip(tiles, places, sizes, strict=True):
        if y + s > out.shape[0] or x + s > out.shape[1]:
            raise FormatError(f"a tile at {y}, {x} lies outside")
        out[y : y + s, x : x + s] = t.reshape(s, s, 3)
    return out[:height, :width]


def _places(blocks: dict[str, bytes], h: dict) -> tuple[list[tuple[int, int]], list[int]]:
    if "QTREE" in blocks:
        t = B.unpack("QTREE", blocks["QTREE"])["tiles"]
        return [(int(y), int(x)) for y, x in zip(t["y"], t["x"], strict=True)], [int(s) for s in t["size"]]
    places = _grid(h["height"], h["width"], h["side"])
    return places, [h["side"]] * len(places)


def _bicubic(blocks: dict[str, bytes], h: dict) -> np.ndarray:
    control = B.unpack("BIC", blocks["BIC"])["control"].reshape(-1, 16, 3) / 255
    side = h["side"]
    tiles = np.stack([K.bicubic_eval(control[:, :, c], side) for c in range(3)], axis=2)
    places = _grid(h["height"], h["width"], side)
    return _pasted(tiles, places, [side] * len(places), h["height"], h["width"])


def _palette(blocks: dict[str, bytes], h: dict) -> np.ndarray:
    v = B.unpack("PAL", blocks["PAL"])
    return (v["palette"].reshape(-1, 3)[v["labels"]] / 255).reshape(v["h"], v["w"], 3)


def plane(gx: np.ndarray, gy: np.ndarray, mean: float) -> np.ndarray:
    """A rectangle from its gradient field and mean, by cosine transforms along both axes."""
    h, w = gx.shape
    d = gx + gy
    d[:, 1:] -= gx[:, :-1]
    d[1:] -= gy[:-1]
    a, b = K.dct_matrix(h), K.dct_matrix(w)
    eigen = 2 * np.cos(np.pi * np.arange(h) / h)[:, None] + 2 * np.cos(np.pi * np.arange(w) / w)[None, :] - 4
    eigen[0, 0] = 1
    k = a @ d @ b.T / eigen
    k[0, 0] = mean * np.sqrt(h * w)
    return a.T @ k @ b


def _gradients(blocks: dict[str, bytes], h: dict) -> np.ndarray:
    v = B.unpack("GRD", blocks["GRD"])
    gx, gy = (v[n].astype(float).reshape(v["h"], v["w"], v["c"]) / v["scale"] for n in ("gx", "gy"))
    planes = [plane(gx[:, :, c], gy[:, :, c], float(v["means"][c])) for c in range(v["c"])]
    return np.stack(planes * 3 if len(planes) == 1 else planes, axis=2)


def read_stacks(blocks: dict[str, bytes], sizes: list[int]) -> list[list[dict]]:
    """The primitives of every tile: chunks are decoded one after another and cut by the directory of tiles."""
    ends = B.unpack("TOC", blocks["TOC"])["offsets"]
    if len(ends) != len(sizes):
        raise FormatError(f"{len(ends)} entries for {len(sizes)} tiles")
    raw = b""
    for c in B.unpack("CIDX", blocks["CIDX"])["chunks"]:
        part = entropy.decode(blocks["PRIM"][c["coded_at"] : c["coded_at"] + c["coded_size"]])
        if len(part) != c["raw_size"] or len(raw) != c["raw_at"]:
            raise FormatError("a chunk of another length")
        raw += part
    if (int(ends[-1]) if len(ends) else 0) != len(raw):
        raise FormatError("chunks and directory differ")
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return [P.unpack_tile(raw[int(a) : int(b)], s) for a, b, s in zip(begins, ends, sizes, strict=True)]


def _stacks(blocks: dict[str, bytes], h: dict) -> np.ndarray:
    places, sizes = _places(blocks, h)
    stacks = read_stacks(blocks, sizes)
    bias = B.unpack("RES0", blocks["RES0"])["bias"].reshape(-1, 3).astype(float) if "RES0" in blocks else np.zeros((len(sizes), 3))
    grid = None
    if "RES1" in blocks:
        v = B.unpack("RES1", blocks["RES1"])
        grid = v["grid"].reshape(-1, v["side"], v["side"], 3) / 127
    if len(bias) != len(sizes) or grid is not None and len(grid) != len(sizes):
        raise FormatError("corrections and tiles differ in number")
    tiles: list = [None] * len(sizes)
    for s in sorted(set(sizes)):
        at = [i for i, x in enumerate(sizes) if x == s]
        drawn = L.compose(L.of([stacks[i] for i in at]), len(at), s, s, bias[at])
        if grid is not None:
            drawn = np.clip(drawn + L.spread(grid[at], s), 0, 1)
        for i, t in zip(at, drawn, strict=True):
            tiles[i] = t
    return _pasted(tiles, places, sizes, h["height"], h["width"])


#: Which block decides how a picture is drawn, first come first.
DISPATCH = (("BIC", _bicubic), ("PAL", _palette), ("GRD", _gradients), ("PRIM", _stacks))


def base_of(tags) -> str:
    for tag, _ in DISPATCH:
        if tag in tags:
            return tag
    raise FormatError("no block to draw from")


def _lit(picture: np.ndarray, payload: bytes) -> np.ndarray:
    v = B.unpack("LITE", payload)
    light = 1 + v["grid"].reshape(v["h"], v["w"]) / 64
    rows, cols = L.lerp(picture.shape[0], v["h"]), L.lerp(picture.shape[1], v["w"])
    return picture * (rows @ light @ cols.T)[:, :, None]


def _with_atoms(picture: np.ndarray, payload: bytes) -> np.ndarray:
    flat = picture.reshape(-1, 3).copy()
    for a in json.loads(payload):
        if 0 <= a["pix"] < len(flat):
            flat[a["pix"]] = np.clip(flat[a["pix"]] + np.array([a["dr"], a["dg"], a["db"]]) / 255, 0, 1)
    return flat.reshape(picture.shape)


def _residual(blocks: dict[str, bytes], h: dict) -> np.ndarray:
    v = B.unpack_dct(blocks["DCT"])
    places, sizes = _places(blocks, h)
    if v["tiles"] not in (0, len(sizes)):
        raise FormatError(f"residuals of {v['tiles']} tiles for {len(sizes)}")
    there = np.unpackbits(v["mask"], count=len(sizes), bitorder="little").astype(bool) if v["tiles"] else np.ones(len(sizes), bool)
    kept = [i for i in range(len(sizes)) if there[i]]
    kept_sizes = [sizes[i] for i in kept]
    try:
        q = (residual.tile_major if v["layout"] else residual.split_flat)(v["coefficients"].astype(float), kept_sizes, v["chroma"])
    except ValueError as e:
        raise FormatError(f"DCT: {e}") from e
    codes = v["scales"] if v["scaled"] else None
    if codes is not None and len(codes) != len(kept):
        raise FormatError("DCT: scales and tiles differ in number")
    tiles: list = [np.zeros((s * s, 3)) for s in sizes]
    for s in sorted(set(kept_sizes)):
        at = [j for j, x in enumerate(kept_sizes) if x == s]
        back = residual.decode(np.stack([q[j] for j in at]), s, v["chroma"], v["step"], v["alpha"], step_scale(codes[at]) if codes is not None else None)
        for j, t in zip(at, back, strict=True):
            tiles[kept[j]] = t
    return _pasted(tiles, places, sizes, h["height"], h["width"])


def draw(blocks: dict[str, bytes]) -> tuple[dict, np.ndarray]:
    """HEAD's values and the picture (height x width x 3) of a file's blocks."""
    if "HEAD" not in blocks:
        raise FormatError("no HEAD block")
    h = B.unpack("HEAD", blocks["HEAD"])
    tag = base_of(blocks)
    out = dict(DISPATCH)[tag](blocks, h)
    if out.shape != (h["height"], h["width"], 3):
        raise FormatError(f"{tag} has {out.shape[0]} x {out.shape[1]} samples of {h['height']} x {h['width']}")
    if "LITE" in blocks:
        out = _lit(out, blocks["LITE"])
    if "RES2" in blocks:
        out = _with_atoms(out, blocks["RES2"])
    if "DCT" in blocks:
        out = out + _residual(blocks, h)
    return h, np.clip(out, 0, 1)


def drawn(blocks: DataFrame) -> DataFrame:
    """Rows of blocks (path, tag, payload, error: what the data source reads) to path, base, height, width, y, x, v and error of each file. Payloads of a file meet in one task; a
    part is no larger than a task. A file that can't be drawn is a row with its error."""
    d = blocks.groupBy("path").agg(F.max("error").alias("error"), F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", "payload"))).alias("blocks"))
    schema = pa.schema([("path", pa.string()), ("base", pa.string()), *((n, pa.int32()) for n in ("height", "width", "y", "x")), ("v", pa.list_(pa.float64())), ("error", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                row: list = [r["path"], None, None, None, None, None, None, r["error"]]
                if r["error"] is None:
                    held = {x["tag"]: x["payload"] for x in r["blocks"]}
                    try:
                        h, v = draw(held)
                        row = [r["path"], base_of(held), h["height"], h["width"], h["y"], h["x"], v.reshape(-1), None]
                    except ValueError as e:
                        row[-1] = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return d.mapInArrow(run, "path string, base string, height int, width int, y int, x int, v array<double>, error string")


def built(parts: DataFrame, name: str, columns: list[str], build) -> DataFrame:
    """name, blocks and meta for ``tile_files.save``: build makes the blocks of a row's columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.binary())
        for b in it:
            for r in b.to_pylist():
                blocks = build(r)
                meta = container.canonical({"base": base_of(blocks)} if any(t in blocks for t in container.BASES) else {}).decode()
                yield pa.RecordBatch.from_arrays([pa.array([str(r[name])]), pa.array([list(blocks.items())], kind), pa.array([meta])], names=["name", "blocks", "meta"])

    return parts.select(name, *[c for c in columns if c != name]).mapInArrow(run, "name string, blocks map<string,binary>, meta string")
