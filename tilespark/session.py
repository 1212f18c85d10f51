"""One place for the settings every query expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on; sizes of partitions and shuffles are left to the cluster.
NEEDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benches; on a cluster, ``configure`` the one that is there."""
    b = SparkSession.builder.master(master).appName("tilespark").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**NEEDED, **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    for k, v in NEEDED.items():
        spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def fresh(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that the cluster shares (spark.checkpoint.dir). Only a local session without that setting uses a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tilespark-core-")
    return f"{base.rstrip('/')}/tilespark-core/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: what follows sees the same rows however often it scans them, and the lineage ends here.
    The job that writes runs when this is called, so a query that stands on it runs jobs while it is being built."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
