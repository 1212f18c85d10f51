"""Intermediate tables and files in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Only where it is unset and the session is a local one
(tests) a temporary folder of this machine takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tilespark-")
    return _LOCAL[app]


def fresh(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder; nothing is there yet."""
    return f"{base(spark)}/tilespark/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet and rereads it: the lineage ends here, and lost executors cost only a read."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(uri: str, data: bytes) -> None:
    """From a task: one file in the shared folder, whole or not at all (the name is the attempt's own)."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path) as out:
        out.write(data)


def get(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """From a task: a byte range of a file in the shared folder."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
