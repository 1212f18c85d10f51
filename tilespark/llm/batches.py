"""Arrow batches in and out of Python tasks, with memory bounded by bytes rather than rows."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa

#: Texts handled at once in a task.
BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a string or binary column; one row may be larger."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hold(kind: str) -> pa.DataType:
    """Arrow's type for a Spark type, by its simple string."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(kind))


def whole_ids(docs, column: str = "doc_id") -> None:
    """Raises before anything runs where ids aren't numbers: what compares them needs integers."""
    from pyspark.sql.types import NumericType

    if not isinstance(docs.schema[column].dataType, NumericType):
        raise TypeError(f"{column} is {docs.schema[column].dataType.simpleString()}; integers are asked for")


def mapped(df, run, ddl: str):
    """df.mapInArrow whose workers give freed memory back to the system when a task ends: they live on, and an executor
    may keep more of them than it has cores."""

    def trimmed(it):
        import ctypes

        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(trimmed, ddl)


def grouped(df, key: str, run, ddl: str, n: int | None = None, order: tuple[str, ...] = ()):
    """df dealt out by key over n partitions (the session's shuffle partitions); ``run`` gets the groups of a partition one
    after another, as an iterator of (key, list of batches), and yields batches. A group must fit into a task."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def groups(it):
        held, now = [], None
        for b in it:
            keys = b.column(key).to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if held and keys[start] != now:
                        yield now, held
                        held = []
                    now = keys[start]
                    held.append(b.slice(start, i - start))
                    start = i
        if held:
            yield now, held

    return mapped(df.repartition(n, key).sortWithinPartitions(key, *order), lambda it: run(groups(it)), ddl)


def column(parts: list[pa.RecordBatch], name: str) -> list:
    return [x for b in parts for x in b.column(name).to_pylist()]
