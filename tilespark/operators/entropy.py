"""Order-0 range coding of byte chunks with 12-bit models, and the model as column expressions."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 12
TOTAL = 1 << BITS
#: The coder's state stays in [LOW, 256 * LOW).
LOW = 1 << 23
RAW, CODED = 0, 1
#: Chunks are coded side by side, so many at most, of so many bytes in all (as if each were as long as the longest); fewer than FEW one by one.
LANES, ROOM, FEW = 1024, 1 << 22, 48
_MODEL = np.dtype([("symbol", "u1"), ("freq", "<u2")])


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to TOTAL: rounded shares, at least 1 where there is a count; the difference goes round the symbols
    from the most frequent on (those at 1 don't shrink)."""
    return normalise_rows(counts[None, :])[0]


def normalise_rows(counts: np.ndarray) -> np.ndarray:
    """The same of each row."""
    n = counts.sum(axis=1, keepdims=True)
    freq = np.where(counts > 0, np.maximum(1, np.rint(counts / np.maximum(n, 1) * TOTAL)), 0).astype(np.int64)
    freq[n[:, 0] == 0, 0] = TOTAL
    order = np.argsort(-counts, axis=1, kind="stable")
    counted = np.take_along_axis(counts, order, axis=1) > 0
    left = TOTAL - freq.sum(axis=1, keepdims=True)
    while left.any():
        f = np.take_along_axis(freq, order, axis=1)
        able = np.where(left > 0, counted, f > 1)
        np.put_along_axis(freq, order, f + np.sign(left) * (able & (np.cumsum(able, axis=1) <= np.abs(left))), axis=1)
        left = TOTAL - freq.sum(axis=1, keepdims=True)
    return freq


def encode(data: bytes) -> bytes:
    """A header, the model and the coded bytes; or the raw bytes where that is no longer."""
    raw = struct.pack("<BI", RAW, len(data)) + data
    if not data:
        return raw
    freq = normalise(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    start = (np.cumsum(freq) - freq).tolist()
    f, state, out = freq.tolist(), LOW, bytearray()
    for s in reversed(data):
        n = f[s]
        most = (LOW >> BITS << 8) * n
        while state >= most:
            out.append(state & 255)
            state >>= 8
        whole, rest = divmod(state, n)
        state = (whole << BITS) + rest + start[s]
    used = np.flatnonzero(freq).tolist()
    model = struct.pack("<H", len(used)) + b"".join(struct.pack("<BH", s, f[s] % TOTAL) for s in used)  # a lone symbol's 4096 is kept as 0
    coded = struct.pack("<BI", CODED, len(data)) + model + struct.pack("<I", state) + bytes(reversed(out))
    return coded if len(coded) < len(raw) else raw


def decode(blob: bytes) -> bytes:
    mode, n = struct.unpack_from("<BI", blob)
    if mode == RAW:
        if len(blob) != 5 + n:
            raise ValueError("a raw chunk of another length")
        return blob[5:]
    if mode != CODED:
        raise ValueError("an unknown mode")
    (k,) = struct.unpack_from("<H", blob, 5)
    freq, at = [0] * 256, 7
    for _ in range(k):
        s, f = struct.unpack_from("<BH", blob, at)
        freq[s], at = f or TOTAL, at + 3
    if sum(freq) != TOTAL:
        raise ValueError("frequencies don't sum up")
    start = (np.cumsum(freq) - freq).tolist()
    symbol = np.repeat(np.arange(256), freq).tolist()
    (state,) = struct.unpack_from("<I", blob, at)
    at += 4
    out = bytearray()
    for _ in range(n):
        slot = state & (TOTAL - 1)
        s = symbol[slot]
        out.append(s)
        state = freq[s] * (state >> BITS) + slot - start[s]
        while state < LOW and at < len(blob):
            state = state << 8 | blob[at]
            at += 1
    return bytes(out)


def _side_by_side(work: list[bytes], size: list[int], one: Callable, many: Callable) -> list[bytes]:
    """one's results: work goes to many in lots of similar size, longest first; small lots, and what has size 0, go to one."""
    order, at = sorted((i for i in range(len(work)) if size[i]), key=lambda i: -size[i]), 0
    out = [b"" if s else one(x) for x, s in zip(work, size, strict=True)]
    while at < len(order):
        lot = order[at : at + max(1, min(LANES, ROOM // size[order[at]]))]
        at += len(lot)
        did = many([work[i] for i in lot], np.array([size[i] for i in lot])) if len(lot) >= FEW else [one(work[i]) for i in lot]
        for i, x in zip(lot, did, strict=True):
            out[i] = x
    return out


def _active(size: np.ndarray) -> list[int]:
    """How many of the sizes (longest first) exceed each step."""
    return (len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")).tolist()


def _encode_lanes(data: list[bytes], size: np.ndarray) -> list[bytes]:
    n, steps = len(data), int(size[0])
    symbols, counts = np.zeros((n, steps), np.uint8), np.zeros((n, 256), np.int64)
    for i, x in enumerate(data):
        a = np.frombuffer(x, np.uint8)
        symbols[i, : len(a)] = a[::-1]
        counts[i] = np.bincount(a, minlength=256)
    symbols = np.ascontiguousarray(symbols.T)
    freq = normalise_rows(counts)
    f, start = (x.astype(np.uint32).reshape(-1) for x in (freq, np.cumsum(freq, axis=1) - freq))
    lane, state = np.arange(n) * 256, np.full(n, LOW, np.uint32)
    # at most two bytes leave the state before a symbol
    sent, does = np.zeros((steps, 2, n), np.uint8), np.zeros((steps, 2, n), bool)
    for j, k in enumerate(_active(size)):
        at = lane[:k] + symbols[j, :k]
        now, share = state[:k], f.take(at)
        most = share << (31 - BITS)
        for turn in (0, 1):
            sent[j, turn, :k] = now
            full = np.greater_equal(now, most, out=does[j, turn, :k])
            now >>= full.view(np.uint8) << 3
        whole, rest = np.divmod(now, share)
        now[:] = (whole << BITS) + rest + start.take(at)
    # the last byte sent is the first one read
    does = np.ascontiguousarray(does.reshape(2 * steps, n)[::-1].T)
    tail = np.ascontiguousarray(sent.reshape(2 * steps, n)[::-1].T)[does].tobytes()
    ends = np.cumsum(does.sum(axis=1)).tolist()
    row, symbol = np.nonzero(freq)
    model = np.empty(len(row), _MODEL)
    model["symbol"], model["freq"] = symbol, freq[row, symbol] % TOTAL
    upto, out = np.cumsum(np.bincount(row, minlength=n)).tolist(), []
    for i, (x, s) in enumerate(zip(data, state.tolist(), strict=True)):
        m = model[upto[i - 1] if i else 0 : upto[i]]
        coded = struct.pack("<BIH", CODED, len(x), len(m)) + m.tobytes() + struct.pack("<I", s) + tail[ends[i - 1] if i else 0 : ends[i]]
        raw = struct.pack("<BI", RAW, len(x)) + x
        out.append(coded if len(coded) < len(raw) else raw)
    return out


def _decode_lanes(blobs: list[bytes], size: np.ndarray) -> list[bytes]:
    n, steps = len(blobs), int(size[0])
    freq, pos, state = np.zeros((n, 256), np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint32)
    for i, x in enumerate(blobs):
        (k,) = struct.unpack_from("<H", x, 5)
        m = np.frombuffer(x, _MODEL, k, 7)
        freq[i, m["symbol"]] = np.where(m["freq"] == 0, TOTAL, m["freq"])
        pos[i] = 7 + 3 * k
        (state[i],) = struct.unpack_from("<I", x, 7 + 3 * k)
    if (freq.sum(axis=1) != TOTAL).any():
        raise ValueError("frequencies don't sum up")
    ends = np.cumsum([len(x) for x in blobs])
    pos += 4 + ends - [len(x) for x in blobs]
    data = np.frombuffer(b"".join(blobs), np.uint8)
    symbol = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), freq.reshape(-1))
    f, start = (x.astype(np.uint32).reshape(-1) for x in (freq, np.cumsum(freq, axis=1) - freq))
    lane, out = np.arange(n), np.zeros((steps, n), np.uint8)
    for j, k in enumerate(_active(size)):
        now, p = state[:k], pos[:k]
        slot = now & np.uint32(TOTAL - 1)
        s = symbol.take((lane[:k] << BITS) + slot)
        out[j, :k] = s
        at = (lane[:k] << 8) + s
        now[:] = f.take(at) * (now >> BITS) + (slot - start.take(at))
        low = np.flatnonzero((now < LOW) & (p < ends[:k]))
        while len(low):
            now[low] = now[low] << 8 | data[p[low]]
            p[low] += 1
            low = low[(now[low] < LOW) & (p[low] < ends[low])]
    out = np.ascontiguousarray(out.T)
    return [out[i, :m].tobytes() for i, m in enumerate(size.tolist())]


def encode_all(data: list[bytes]) -> list[bytes]:
    """``encode`` of each: a chunk's symbols depend on one another, but chunks don't, so a step takes a symbol of every chunk."""
    return _side_by_side(data, [len(x) for x in data], encode, _encode_lanes)


def decode_all(blobs: list[bytes]) -> list[bytes]:
    """``decode`` of each, likewise."""
    heads = [struct.unpack_from("<BI", x) for x in blobs]
    return _side_by_side(blobs, [n if mode == CODED else 0 for mode, n in heads], decode, _decode_lanes)


def byte_counts(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, byte, n: batches are counted in NumPy, so a task sends 256 rows a key at most."""
    ddl = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "byte int, n long"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in it:
            values = b.column("__b").to_pylist()
            for key, v in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * len(values), values, strict=True):
                c = np.bincount(np.frombuffer(v or b"", np.uint8), minlength=256)
                total[key] = total[key] + c if key in total else c
        rows = [(*k, s, int(c[s])) for k, c in total.items() for s in np.flatnonzero(c).tolist()]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(list(c)) for c in cols[:-2]], pa.array(list(cols[-2]), pa.int32()), pa.array(list(cols[-1]), pa.int64())], names=[*keys, "byte", "n"])

    d = df.select(*keys, F.col(text).cast("binary").alias("__b"))
    return d.mapInArrow(run, ddl).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def model(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, byte, n) with freq: each key's 256 counts are one row, and ``normalise`` is the coder's own rule, exact for any counts."""
    table = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("byte", "n"))).alias("__n"))
    ddl = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys) + (", " if keys else "") + "byte int, n long, freq long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, pairs in enumerate(b.column("__n").to_pylist()):
                n = np.zeros(256, np.int64)
                for byte, k in pairs:
                    n[byte] = k
                at = np.flatnonzero(n)
                same = [pa.concat_arrays([b.column(k).slice(i, 1)] * len(at)) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int32()), pa.array(n[at]), pa.array(np.asarray(normalise(n), np.int64)[at])], names=[*keys, "byte", "n", "freq"])

    return table.mapInArrow(run, ddl)


def chunk_roundtrip(df: DataFrame, key: str, blob: str) -> DataFrame:
    """key, raw_bytes, coded_bytes, same: a batch's chunks are coded and decoded side by side."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 4 * LANES) for b in it for at in range(0, b.num_rows, 4 * LANES)):
            data = [x or b"" for x in b.column("__b").to_pylist()]
            coded = encode_all(data)
            same = [c == x for c, x in zip(decode_all(coded), data, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__k"), pa.array([len(x) for x in data], pa.int64()), pa.array([len(c) for c in coded], pa.int64()), pa.array(same)], names=[key, "raw_bytes", "coded_bytes", "same"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("__k"), F.col(blob).cast("binary").alias("__b")).mapInArrow(run, f"`{key}` {kind}, raw_bytes long, coded_bytes long, same boolean")
