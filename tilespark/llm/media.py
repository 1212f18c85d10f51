"""Media columns: payloads as grey images in tar shards, addressed by content.

A text's UTF-8 bytes, with zeros up to a positive multiple of 64, are the samples of a 64 pixel wide, 8-bit grey PNG.  Each
task writes tar shards into the shared folder, under a name of the attempt and then moved to that of the partition, a counter and a
digest of the entries: a task that runs again gives the same shards, and never touches those of one that met its rows in another order; an entry's name is its payload's SHA-256, and a shard
holds a payload once however often it occurs.  Rows carry digest, shard, offset and length, and nothing else of
the payload travels: ``headers`` fills width, height and depth from a range read of 33 bytes, ``contents`` reads
whole entries and computes digests and a feature.  Bytes read back must have the digest that they are addressed by. No shuffle moves media.

Feature: sixteen hex digits, one for each sixteenth of the byte range (its share of the samples, in sixteenths), a colon and
sixteen more: bit j tells whether column j is brighter than the mean of all.

Null texts are empty (64 zeros); equal texts give equal values; repeated rows point at one entry of their shard;
an empty table gives no rows and writes no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm import batches, store

WIDTH = 64
#: Bytes of media after which a task begins another shard.
SHARD = 64 << 20
#: Rows after which it does, however little media they need: a task holds a shard's rows until the shard is closed.
ROWS = 250_000
#: Reading tasks are cut at so many bytes of a shard.
CELL = 1 << 20
TASK = 32 << 20
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte of 0 precedes each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """width, height, bit depth from an image's first HEADER bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not such an image")
    return struct.unpack(">IIB", first[16:25])


def decode(image: bytes) -> bytes:
    width, height, _ = header(image[:HEADER])
    at, data = 8, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data += image[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header with nothing that depends on who writes it, or when."""
    h = bytearray(512)
    h[0 : len(name)] = name.encode()
    h[100:108], h[108:116], h[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    h[124:136], h[136:148], h[148:156] = b"%011o\0" % size, b"00000000000\0", b" " * 8
    h[156:157], h[257:265] = b"0", b"ustar\x0000"
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def feature(samples: bytes) -> str:
    a = np.frombuffer(samples, np.uint8)
    share = np.minimum(15, np.bincount(a >> 4, minlength=16) * 16 // len(a))
    columns = a.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    bright = columns * WIDTH > columns.sum()
    return "".join(f"{x:x}" for x in share) + ":" + np.packbits(bright).tobytes().hex()


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every document. Evaluate once: each run writes shards."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", batches.hold(kind)), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        where, top = fs.FileSystem.from_uri(folder)
        part, number = TaskContext.get().partitionId(), 0
        out, attempt, at, known, entries, rows = None, "", 0, {}, hashlib.sha256(), []

        def close() -> pa.RecordBatch:
            """Ends the shard and gives its rows their name."""
            nonlocal out, number, rows
            out.write(bytes(1024))
            out.close()
            name = f"{part:06d}-{number:06d}-{entries.hexdigest()[:16]}.tar"
            where.move(attempt, f"{top}/{name}")
            doc_id, n, digest, offset, length = (list(c) for c in zip(*rows, strict=True))
            out, number, rows = None, number + 1, []
            return batches.batch(schema, [doc_id, n, digest, [name] * len(n), offset, length])

        for b in batches.pieces(it, "text"):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), batches.texts(b), strict=True):
                data = payload(text)
                digest = hashlib.sha256(data).hexdigest()
                if out is None:
                    where.create_dir(top, recursive=True)
                    attempt = f"{top}/.{uuid.uuid4().hex}"
                    out, at, known, entries = where.open_output_stream(attempt), 0, {}, hashlib.sha256()
                if digest not in known:
                    image = encode(data)
                    block = tar_header(f"{digest}.png", len(image)) + image + bytes(-len(image) % 512)
                    out.write(block)
                    entries.update(digest.encode())
                    known[digest] = (at + 512, len(image))
                    at += len(block)
                rows.append((doc_id, len(text.encode()), digest, *known[digest]))
                if at >= SHARD or len(rows) >= ROWS:
                    yield close()
        if out is not None:
            yield close()

    return batches.mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long")


def _by_entry(rows: DataFrame) -> DataFrame:
    """Rows of an entry adjacent, a shard's entries in order, in as many tasks as the media's bytes need: the rows' own are few."""
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    return rows.repartition(n, "shard", F.floor(F.col("offset") / CELL)).sortWithinPartitions("shard", "offset")


def _reading(rows: DataFrame, folder: str, names: list[tuple[str, str]], whole: bool, made) -> DataFrame:
    """rows with columns that ``made`` computes from an entry's bytes (or only its first HEADER)."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{n} {t}" for n, t in names)])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder)
        shard, file, last, got = None, None, None, None
        for b in it:
            out = []
            for s, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if s != shard:
                    if file is not None:
                        file.close()
                    shard, file = s, where.open_input_file(f"{top}/{s}")
                if (s, at) != last:
                    last, got = (s, at), made(file.read_at(n if whole else min(n, HEADER), at))
                out.append(got)
            new = [pa.array(list(c), type=kinds[t]) for c, (_, t) in zip(zip(*out, strict=True), names, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in names)])
        if file is not None:
            file.close()

    return batches.mapped(rows, run, ddl)


def headers(rows: DataFrame, folder: str) -> DataFrame:
    """Fills width, height and bit_depth by range reads of the images' headers alone."""
    return _reading(rows, folder, [("width", "long"), ("height", "long"), ("bit_depth", "int")], False, header)


def contents(rows: DataFrame, folder: str) -> DataFrame:
    """Fills what only the stored bytes can tell."""

    def made(image: bytes) -> tuple:
        samples = decode(image)
        return hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), hashlib.sha256(image).hexdigest(), feature(samples)

    return _reading(rows, folder, [("payload_sha256", "string"), ("tail_crc32", "long"), ("media_sha256", "string"), ("feature", "string")], True, made)


def media(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = store.fresh(spark, "media")
    rows = store.table(write_shards(docs, folder), "media-rows")
    full = contents(headers(_by_entry(rows), folder), folder)
    read = F.when(F.col("payload_sha256") == F.col("digest"), F.col("payload_sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged entry "), "digest")))
    return full.withColumn("payload_sha256", read).select(
        "doc_id", "n_bytes", (F.col("width") * F.col("height")).alias("payload_bytes"), "payload_sha256", "tail_crc32",
        F.col("length").alias("media_bytes"), "media_sha256", "feature", "digest", "shard", "offset",
    )


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
