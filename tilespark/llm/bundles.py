"""Documents in bundles: compressed files of a few MB in the shared folder, read again by name.

Operators that pass over all texts several times write them once, next to the rows that they send elsewhere; what
comes back names a bundle, and the task that gets it reads that file. So texts are never shuffled, and a
lost executor costs the reading of its bundles. A bundle of a lost attempt is never named.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a bundle, about.
SIZE = 4 << 20


def write(it: Iterator[pa.RecordBatch], folder: str, column: str = "text", most: int = SIZE) -> Iterator[tuple[str, pa.Table]]:
    """(name, rows) of each bundle that the task has written."""
    from tilespark.llm import batches, store

    held, size = [], 0

    def done() -> tuple[str, pa.Table]:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(table.combine_chunks())
        name = uuid.uuid4().hex
        store.put(f"{folder}/{name}", sink.getvalue())
        return name, table

    for b in batches.pieces(it, column, most):
        n = b.column(column).nbytes
        if held and size + n > most:
            yield done()
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield done()


def read(folder: str, name: str) -> pa.Table:
    from tilespark.llm import store

    return pa.ipc.open_stream(store.get(f"{folder}/{name}")).read_all()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed blob."""
    raw = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    (size,) = struct.unpack("<Q", blob[:8])
    raw = pa.Codec("zstd", 1).decompress(blob[8:], decompressed_size=size, asbytes=True) if size else b""
    kinds_ = [np.dtype(k) for k in kinds]
    n, at, out = size // sum(k.itemsize for k in kinds_), 0, []
    for k in kinds_:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the input sways all of the output (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of k words from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    out = h[:n] * factors[0]
    for j in range(1, k):
        out += h[j : j + n] * factors[j]
    return mixed(out)


def runs_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each stretch of equal values in a sorted array."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return start, np.diff(np.append(start, len(a)))
