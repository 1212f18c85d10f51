"""Containers as a data source of Spark: ``spark.read.format("tilespark")`` and ``df.write.format("tilespark")``.

Reading gives a row for each block (path, tag, offset, length, payload, meta, error). Files are planned into partitions by their size; a file larger than a partition has its directory read by
the planner, and its blocks are dealt over several partitions. A task reads the end of a file and then only the blocks that are wanted: the option ``tags``
names them, or, with ``spark.sql.python.filterPushdown.enabled``, a filter on ``tag`` does (format "tilespark-pushed"; Spark refuses a source that takes filters without that setting, so it has a name of its own).
Option ``payload`` false reads directories alone, ``complete`` true refuses pictures that can't be drawn.

Writing takes rows of name, blocks (map of tag to payload) and meta (JSON or null) and is committed in two phases: tasks write into a folder of their attempt below a staging folder, and
the driver moves the folders of the attempts that count, one rename a task, and deletes the rest. What a task tells the driver is the name of its folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from tilespark.sources import container

SUFFIX = ".tspk"
#: Bytes of files in a partition, about; blocks of a larger file are dealt out.
SPLIT = 128 << 20
SCHEMA = "path string, tag string, offset long, length long, payload binary, meta string, error string"
_ARROW = pa.schema([("path", pa.string()), ("tag", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary()), ("meta", pa.string()), ("error", pa.string())])
#: Bytes of payloads in a batch.
BATCH = 16 << 20


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "/" + uri.removeprefix("file:").lstrip("/"))


class _Reading:
    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)

    def directory(self) -> container.Directory:
        return container.Directory(lambda at, n: self.file.read_at(n, at), self.file.size())


@dataclass
class Files(InputPartition):
    """Paths, and for one large file the places of its blocks in the directory."""

    paths: tuple[str, ...]
    blocks: tuple[int, ...] | None = None


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.tags = {t.strip() for t in options["tags"].split(",")} if options.get("tags") else None
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.complete = str(options.get("complete", "false")).lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.errors = True

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        out, held, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and "/_" not in f.path.removeprefix(root)), key=lambda f: f.path):
            if f.size > self.split:
                out += self._of_large(store, f.path)
                continue
            if held and size + f.size > self.split:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        if held:
            out.append(Files(tuple(held)))
        return out or [Files(())]

    def _of_large(self, store, path: str) -> list[Files]:
        try:
            entries = _Reading(store, path).directory().blocks
        except ValueError:
            return [Files((path,))]  # the task says what is wrong
        out, held, size = [], [], 0
        for i, (tag, _, stored, *_) in enumerate(entries):
            if self.tags is not None and tag not in self.tags:
                continue
            if held and size + stored > self.split:
                out.append(Files((path,), tuple(held)))
                held, size = [], 0
            held.append(i)
            size += stored
        return [*out, Files((path,), tuple(held))] if held else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, size = [], 0
        for path in partition.paths:
            try:
                d = _Reading(store, path).directory()
                if self.complete:
                    d.complete()
                meta = json.dumps(d.meta, sort_keys=True, separators=(",", ":"))
                for i, e in enumerate(d.blocks):
                    if partition.blocks is not None and i not in partition.blocks or self.tags is not None and e[0] not in self.tags:
                        continue
                    rows.append((path, e[0], e[1], e[2], d.payload(e) if self.payload else None, meta, None))
                    size += e[3] if self.payload else 64
                    if size >= BATCH:
                        yield container.record(rows, _ARROW)
                        rows, size = [], 0
            except ValueError as e:
                rows = [r for r in rows if r[0] != path or r[6]]  # none of a broken file's blocks that haven't gone out
                if self.errors:
                    rows.append((path, None, None, None, None, None, str(e)))
        if rows:
            yield container.record(rows, _ARROW)


class PushedReader(ContainerReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Takes equalities and lists on tag; all others stay with Spark. A broken file's row has no tag, so such a filter takes it out."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("tag",):
                tags = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tags = tags if self.tags is None else self.tags & tags
                self.errors = False
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        folder = f"part-{uuid.uuid4().hex}"
        n = 0
        for b in iterator:
            for name, blocks, meta in zip(*(b.column(c).to_pylist() for c in ("name", "blocks", "meta")), strict=True):
                if not n:
                    store.create_dir(f"{self._staging(root)}/{folder}", recursive=True)
                n += 1
                if "/" in name:
                    raise ValueError(f"{name}: a name, not a path, is asked for")
                with store.open_output_stream(f"{self._staging(root)}/{folder}/{name}{SUFFIX}") as out:
                    out.write(container.write(dict(blocks or ()), json.loads(meta) if meta else {}))
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = [f for f in store.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith("_")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                store.move(f"{self._staging(root)}/{m.folder}", f"{root}/{m.folder}")
        for f in old:
            store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            store.delete_dir(self._staging(root))


class TileFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilespark"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ContainerWriter(self.options, overwrite)


class PushedTileFiles(TileFiles):
    @classmethod
    def name(cls) -> str:
        return "tilespark-pushed"

    def reader(self, schema) -> DataSourceReader:
        return PushedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileFiles)
    spark.dataSource.register(PushedTileFiles)


def load(spark: SparkSession, path: str, tags: list[str] | None = None, **options: str) -> DataFrame:
    """Blocks of the containers below a folder; with pushdown switched on, filters on tag reach the files as the tags given here do."""
    register(spark)
    pushed = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower() == "true"
    r = spark.read.format("tilespark-pushed" if pushed else "tilespark").options(**options)
    return (r.option("tags", ",".join(tags)) if tags else r).load(path)


def save(containers: DataFrame, path: str, mode: str = "append") -> None:
    """name, blocks and meta to a file each."""
    register(containers.sparkSession)
    containers.selectExpr("CAST(name AS string) AS name", "CAST(blocks AS map<string,binary>) AS blocks", "CAST(meta AS string) AS meta").write.format("tilespark").mode(mode).save(path)
