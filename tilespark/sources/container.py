"""A tagged-block container for tiled images that is read from its end: payloads, then a directory, then a tail of fixed size.

The layout is this library's own, made for range reads from an object store: one read of a file's last bytes gives its directory, and only the blocks that are asked for
are read after that. A file is the signature, payloads (each at a multiple of ALIGN), the directory as canonical JSON, and the tail: the directory's length, its CRC-32 and the signature
again. The directory names for each block its tag, offset, stored length, length as it is read and SHA-256 of that, so a block proves itself without the others; beside them it has
the file's metadata and its features, the optional blocks that a reader must know to draw the picture. Blocks are compressed by zstd where that is shorter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"tspk\x02\r\n\x00"
ALIGN = 64
_TAIL = struct.Struct("<II8s")
#: What a first read takes from a file's end: most directories fit.
NEAR = 16 << 10
_ZSTD = b"\x28\xb5\x2f\xfd"
#: What every picture has, the bases of which it has at least one, and what changes how it is drawn.
REQUIRED, BASES = ("HEAD",), ("BIC", "PAL", "GRD", "PRIM")
FEATURES = ("QTREE", "TOC", "CIDX", "RES0", "RES1", "RES2", "LITE", "DCT")


class FormatError(ValueError):
    pass


def squeeze(data: bytes, level: int = 19) -> bytes:
    import zstandard

    if data[:4] == _ZSTD:  # what looks compressed must be, so that reading is unambiguous
        return zstandard.ZstdCompressor(level=level).compress(data)
    small = zstandard.ZstdCompressor(level=level).compress(data)
    return small if len(small) < len(data) else data


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data[:4] == _ZSTD else data


def canonical(meta: dict) -> bytes:
    return json.dumps(meta, sort_keys=True, separators=(",", ":")).encode()


def write(blocks: dict[str, bytes], meta: dict, level: int = 19) -> bytes:
    out, entries = bytearray(SIGNATURE), []
    for tag, data in blocks.items():
        stored = squeeze(data, level)
        out += bytes(-len(out) % ALIGN)
        entries.append([tag, len(out), len(stored), len(data), hashlib.sha256(data).hexdigest()])
        out += stored
    listing = canonical({"blocks": entries, "features": [t for t in FEATURES if t in blocks], "meta": meta})
    return bytes(out) + listing + _TAIL.pack(len(listing), zlib.crc32(listing), SIGNATURE)


class Directory:
    """What a file's end says, read by ``fetch(offset, length)``."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        if size < len(SIGNATURE) + _TAIL.size:
            raise FormatError("truncated")
        end = fetch(max(0, size - NEAR), min(size, NEAR))
        length, crc, signature = _TAIL.unpack(end[-_TAIL.size :])
        if signature != SIGNATURE:
            raise FormatError("another signature")
        at = size - _TAIL.size - length
        if at < len(SIGNATURE):
            raise FormatError("a directory past the start")
        listing = end[-_TAIL.size - length : -_TAIL.size] if length + _TAIL.size <= len(end) else fetch(at, length)
        if zlib.crc32(listing) != crc:
            raise FormatError("a broken directory")
        held = json.loads(listing)
        self.meta, self.features, self.blocks = held["meta"], held["features"], held["blocks"]
        for tag, start, stored, _, _ in self.blocks:
            if start < len(SIGNATURE) or start + stored > at:
                raise FormatError(f"{tag} is not inside the file")
        self._fetch = fetch

    def payload(self, entry: list, check: bool = True) -> bytes:
        tag, start, stored, length, digest = entry
        try:
            data = expand(self._fetch(start, stored))
        except FormatError:
            raise
        except Exception as e:  # zstd's own errors are of several kinds
            raise FormatError(f"{tag}: {e}") from e
        if len(data) != length or check and hashlib.sha256(data).hexdigest() != digest:
            raise FormatError(f"{tag}: another checksum")
        return data

    def complete(self) -> None:
        """Raises where a picture can't be drawn from the file, or where features and blocks differ."""
        tags = [e[0] for e in self.blocks]
        if missing := [t for t in REQUIRED if t not in tags]:
            raise FormatError(f"no {missing[0]} block")
        if not any(t in tags for t in BASES):
            raise FormatError("no block to draw from")
        if len(set(tags)) < len(tags):
            raise FormatError("a tag twice")
        if self.features != [t for t in FEATURES if t in tags]:
            raise FormatError("features and blocks differ")


def _inside(blob: bytes) -> Directory:
    if blob[: len(SIGNATURE)] != SIGNATURE:
        raise FormatError("another signature")
    return Directory(lambda at, n: blob[at : at + n], len(blob))


def directory(blob: bytes) -> list[tuple[str, int, int]]:
    return [(tag, at, stored) for tag, at, stored, _, _ in _inside(blob).blocks]


def read(blob: bytes, check: bool = True, complete: bool = False) -> tuple[dict[str, bytes], dict]:
    d = _inside(blob)
    if complete:
        d.complete()
    return {e[0]: d.payload(e, check) for e in d.blocks}, d.meta


def files(spark, path: str) -> DataFrame:
    """path and content of the containers below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tspk").load(path).select("path", "content")


_ROWS = pa.schema([("path", pa.string()), ("tag", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def rows_of(path: str, d: Directory, wanted: Callable[[str], bool] = lambda tag: True, payloads: bool = True) -> Iterable[tuple]:
    for e in d.blocks:
        if wanted(e[0]):
            yield path, e[0], e[1], e[2], d.payload(e) if payloads else None, None


def record(rows: list[tuple], schema: pa.Schema = _ROWS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def blocks(containers: DataFrame) -> DataFrame:
    """path, tag, offset, length, payload, error: a row for each block; a file that can't be read gives one row with its error."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for path, blob in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += list(rows_of(path, _inside(blob)))
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)))
            if rows:
                yield record(rows)

    return containers.select("path", "content").mapInArrow(run, "path string, tag string, offset long, length long, payload binary, error string")
