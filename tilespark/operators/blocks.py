"""Payloads of the container's blocks: declared layouts, one packer and one reader for all of them.

A layout names the fixed fields of a payload's head, the arrays that follow with the number of their elements (from the head), and what must
hold of both. Everything is little endian and unaligned; a payload has exactly the bytes that its head asks for.

The layouts are this library's own, as its container is: it reads no other program's files, so nothing fixes their order. Settings come first and counts next to the arrays that they
count; rows come before columns, as in the shapes of arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.sources.container import FormatError


@dataclass(frozen=True)
class Layout:
    head: tuple[tuple[str, str], ...]
    body: tuple[tuple[str, object, Callable[[dict], int]], ...] = ()
    rules: tuple[tuple[str, Callable[[dict], bool]], ...] = ()

    def check(self, values: dict) -> None:
        for told, holds in self.rules:
            if not holds(values):
                raise FormatError(told)


def _within(name: str, low: int, high: int):
    return f"{name} is not in {low} to {high}", lambda v: low <= v[name] <= high


#: A tile of an image, and a chunk of tiles, as records.
TILE = np.dtype([("y", "<u2"), ("x", "<u2"), ("size", "u1")])
CHUNK = np.dtype([(n, "<u4") for n in ("start", "tiles", "raw_at", "raw_size", "coded_at", "coded_size")])
_DCT = (("chroma", "u1"), ("step", "<f4"), ("alpha", "<f4"), ("channels", "<u2"), ("n", "<u4"))
_MASK = ("mask", "u1", lambda v: -(-v["tiles"] // 8))
_COEFFICIENTS = ("coefficients", "<i2", lambda v: v["n"])
_CHROMA = (_within("chroma", 0, 2), ("a negative ramp", lambda v: v["alpha"] >= 0))
_LAYOUT = (*_CHROMA, _within("layout", 0, 1))

LAYOUTS = {
    # a part of an image: its extent, where it lies, and the side of its tiles where no QTREE says so
    "HEAD": Layout((("height", "<u4"), ("width", "<u4"), ("y", "<u4"), ("x", "<u4"), ("side", "u1")), (), (("an empty picture", lambda v: v["height"] > 0 and v["width"] > 0), _within("side", 1, 64))),
    "BIC": Layout((("n", "<u4"),), (("control", "u1", lambda v: 48 * v["n"]),)),
    "TOC": Layout((("n", "<u4"),), (("offsets", "<u4", lambda v: v["n"]),), (("offsets descend", lambda v: bool((np.diff(np.asarray(v["offsets"], np.int64)) >= 0).all())),)),
    "CIDX": Layout((("n", "<u4"),), (("chunks", CHUNK, lambda v: v["n"]),), (("chunks leave a gap", lambda v: bool((v["chunks"]["start"][1:] == v["chunks"]["start"][:-1] + v["chunks"]["tiles"][:-1]).all())),)),
    "RES0": Layout((("n", "<u4"),), (("bias", "i1", lambda v: 3 * v["n"]),)),
    "RES1": Layout((("n", "<u4"), ("side", "u1")), (("grid", "i1", lambda v: 3 * v["n"] * v["side"] ** 2),), (_within("side", 1, 16),)),
    "QTREE": Layout((("n", "<u4"),), (("tiles", TILE, lambda v: v["n"]),), (("another tile size", lambda v: bool(np.isin(v["tiles"]["size"], (8, 16, 32)).all())),)),
    "LITE": Layout((("h", "<u2"), ("w", "<u2")), (("grid", "i1", lambda v: v["h"] * v["w"]),)),
    "PAL": Layout(
        (("h", "<u4"), ("w", "<u4"), ("k", "<u2")), (("palette", "u1", lambda v: 3 * v["k"]), ("labels", "u1", lambda v: v["h"] * v["w"])),
        (_within("k", 1, 256), ("a label past the palette", lambda v: not len(v["labels"]) or int(v["labels"].max()) < v["k"])),
    ),
    "GRD": Layout(
        (("scale", "<u2"), ("h", "<u4"), ("w", "<u4"), ("c", "<u2")),
        (("means", "<f4", lambda v: v["c"]), ("gx", "i1", lambda v: v["h"] * v["w"] * v["c"]), ("gy", "i1", lambda v: v["h"] * v["w"] * v["c"])), (_within("scale", 1, 65535),),
    ),
    # the transform's block has grown: presence of tiles, then the order of coefficients, then a scale for each tile
    "DCT2": Layout(_DCT, (_COEFFICIENTS,), _CHROMA),
    "DCT3": Layout((*_DCT, ("tiles", "<u4")), (_MASK, _COEFFICIENTS), _CHROMA),
    "DCT4": Layout((*_DCT, ("tiles", "<u4"), ("layout", "u1")), (_MASK, _COEFFICIENTS), _LAYOUT),
    "DCT5": Layout((*_DCT, ("tiles", "<u4"), ("layout", "u1"), ("scaled", "<u4")), (_MASK, ("scales", "u1", lambda v: v["scaled"]), _COEFFICIENTS), _LAYOUT),
}
#: What a reader assumes of fields that an older version lacks.
_NEWER = {"tiles": 0, "mask": np.zeros(0, np.uint8), "layout": 0, "scaled": 0, "scales": np.zeros(0, np.uint8)}


def pack(kind: str, values: dict) -> bytes:
    """A payload from its values; arrays must have as many elements as the head says."""
    layout = LAYOUTS[kind]
    arrays = {}
    for name, dtype, count in layout.body:
        a = np.asarray(values[name])
        t = np.dtype(dtype)
        if t.kind in "iu" and a.size and not (np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max):
            raise FormatError(f"{name} is out of range")
        arrays[name] = np.ascontiguousarray(a.astype(t)).reshape(-1)
        if len(arrays[name]) != count(values):
            raise FormatError(f"{name} has {len(arrays[name])} elements of {count(values)}")
    layout.check({**values, **arrays})
    head = np.zeros(1, np.dtype(list(layout.head)))
    for name, _ in layout.head:
        head[name] = values[name]
    return head.tobytes() + b"".join(a.tobytes() for a in arrays.values())


def unpack(kind: str, payload: bytes) -> dict:
    layout = LAYOUTS[kind]
    t = np.dtype(list(layout.head))
    if len(payload) < t.itemsize:
        raise FormatError(f"{kind}: truncated head")
    head = np.frombuffer(payload, t, 1)[0]
    values = {name: head[name].item() for name, _ in layout.head}
    at = t.itemsize
    for name, dtype, count in layout.body:
        n, size = count(values), np.dtype(dtype).itemsize
        if at + n * size > len(payload):
            raise FormatError(f"{kind}: truncated {name}")
        values[name] = np.frombuffer(payload, dtype, n, at)
        at += n * size
    if at != len(payload):
        raise FormatError(f"{kind}: {len(payload) - at} bytes too many")
    layout.check(values)
    return values


def pack_dct(values: dict, version: int = 5) -> bytes:
    return bytes([version]) + pack(f"DCT{version}", values)


def unpack_dct(payload: bytes) -> dict:
    """Any version's values, with what it lacks."""
    if not payload or f"DCT{payload[0]}" not in LAYOUTS:
        raise FormatError("DCT: unknown version")
    return {**_NEWER, **unpack(f"DCT{payload[0]}", payload[1:]), "version": payload[0]}


def lite_byte(v: Column) -> Column:
    """A light of about 1 as a signed byte: 64ths of what it differs by."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.rint((v - 1) * 64))).cast("int")


def sparse_atoms(payload: Column, meta: Column) -> Column:
    """RES2's atoms: the payload's JSON, else the metadata's, else null."""
    kind = "array<struct<pix:int,dr:int,dg:int,db:int>>"
    return F.coalesce(F.from_json(payload, kind), F.from_json(meta, f"struct<res2:{kind}>")["res2"])


def atoms_json(atoms: list[dict]) -> str:
    return json.dumps(atoms, separators=(",", ":"))


#: Elements that a task packs at once, and bytes of payloads that it reads at once: a batch of Spark's has millions.
MOST = 1 << 17


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about MOST elements and bytes of its lists and payloads, one row at least."""
    size = np.ones(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_list(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null((pc.list_value_length if pa.types.is_list(c.type) else pc.binary_length)(c), 0).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // MOST)) + 1).tolist(), b.num_rows]
    for i, j in pairwise(at):
        yield b.slice(i, j - i)


def _cells(c: pa.Array) -> list:
    """A column's values, lists of numbers as arrays."""
    if pa.types.is_list(c.type) and pa.types.is_primitive(c.type.value_type) and not c.flatten().null_count:
        return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in c]
    return c.to_pylist()


def packed(df: DataFrame, keys: list[str], columns: list[str], build: Callable[[dict], bytes]) -> DataFrame:
    """keys, payload, error of each row: build makes the payload of a row's columns (lists of numbers come as arrays); what can't be packed is an error, not a failure."""
    ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in it for part in _slices(b)):
            made, told = [], []
            for r in zip(*(_cells(b.column(c)) for c in columns), strict=True):
                try:
                    made.append(build(dict(zip(columns, r, strict=True))))
                    told.append(None)
                except FormatError as e:
                    made.append(None)
                    told.append(str(e))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(made, pa.binary()), pa.array(told, pa.string())], names=[*keys, "payload", "error"])

    return df.select(*keys, *[c for c in columns if c not in keys]).mapInArrow(run, f"{ddl}, payload binary, error string")


def values(payloads: DataFrame, keys: list[str], name: str, read: Callable[[bytes], dict]) -> DataFrame:
    """keys, i, value: an array of each payload, a row for each element (as double)."""
    ddl = ", ".join(f"`{k}` {payloads.schema[k].dataType.simpleString()}" for k in keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in it for part in _slices(b)):
            got = [np.asarray(read(x)[name], float) if x else np.zeros(0) for x in b.column("payload").to_pylist()]
            size = np.array([len(x) for x in got], np.int64)
            of = pa.array(np.repeat(np.arange(len(got)), size))
            i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in keys), pa.array(i, pa.int32()), pa.array(np.concatenate([*got, np.zeros(0)]))], names=[*keys, "i", "value"])

    return payloads.select(*keys, "payload").mapInArrow(run, f"{ddl}, i int, value double")


def records(payloads: DataFrame, keys: list[str], names: list[str], read: Callable[[bytes], np.ndarray]) -> DataFrame:
    """keys, i and several fields (as long) of a payload's records, a row for each: every payload is read once."""
    ddl = ", ".join([*(f"`{k}` {payloads.schema[k].dataType.simpleString()}" for k in keys), "i int", *(f"`{n}` long" for n in names)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in it for part in _slices(b)):
            got = [read(x) for x in b.column("payload").to_pylist() if x]
            has = np.flatnonzero(b.column("payload").is_valid().to_numpy(zero_copy_only=False))
            size = np.array([len(x) for x in got], np.int64)
            of = pa.array(np.repeat(has, size))
            i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            fields = [np.concatenate([*(x[n].astype(np.int64) for x in got), np.zeros(0, np.int64)]) for n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in keys), pa.array(i, pa.int32()), *map(pa.array, fields)], names=[*keys, "i", *names])

    return payloads.select(*keys, "payload").mapInArrow(run, ddl)
