"""Containers as a data source: round trips, tags that reach the files, broken files, two-phase writes."""

import os

import pytest
from pyspark.sql import functions as F

from tilespark.sources import container, tile_files

SCHEMA = "name string, blocks map<string,binary>, meta string"


def saved(spark, path, n=5, mode="append", first=0):
    rows = [(f"p{i}", {"HEAD": b"h%d" % i, "PAL": b"p" * 500, "DCT": bytes([i]) * 300}, '{"k":%d}' % i) for i in range(first, first + n)]
    tile_files.save(spark.createDataFrame(rows, SCHEMA).repartition(3), path, mode)


def names(path):
    return sorted(f for _, _, fs in os.walk(path) for f in fs if f.endswith(".tspk"))


def test_roundtrip_tags_and_directories(spark, tmp_path):
    path = str(tmp_path / "c")
    saved(spark, path)
    assert names(path) == [f"p{i}.tspk" for i in range(5)] and not [d for d in os.listdir(path) if d.startswith("_")]
    got = tile_files.load(spark, path).collect()
    assert len(got) == 15 and {bytes(r.payload) for r in got if r.tag == "HEAD"} == {b"h%d" % i for i in range(5)} and got[0].meta.startswith('{"k":')
    assert {r.tag for r in tile_files.load(spark, path, ["PAL", "none"]).collect()} == {"PAL"}
    bare = tile_files.load(spark, path, payload="false").collect()
    assert len(bare) == 15 and all(r.payload is None and r.length > 0 for r in bare)
    assert tile_files.load(spark, path, complete="true").filter("error IS NOT NULL").count() == 0


def test_a_large_file_is_dealt_over_partitions(spark, tmp_path):
    path = str(tmp_path / "c")
    blocks = {f"B{i}": os.urandom(4000) for i in range(8)}
    tile_files.save(spark.createDataFrame([("big", blocks, None)], SCHEMA), path)
    d = tile_files.load(spark, path, split="9000")
    assert d.rdd.getNumPartitions() == 4
    assert {r.tag: bytes(r.payload) for r in d.collect()} == {k: bytes(v) for k, v in blocks.items()}


def test_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "c")
    saved(spark, path, 2)
    saved(spark, path, 2, first=5)
    assert names(path) == ["p0.tspk", "p1.tspk", "p5.tspk", "p6.tspk"]
    saved(spark, path, 1, "overwrite", first=9)
    assert names(path) == ["p9.tspk"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    saved(spark, path, 2)
    bad = spark.createDataFrame([("fine", {"HEAD": b"x"}, None), ("no/path", {"HEAD": b"x"}, None)], SCHEMA).repartition(2)
    with pytest.raises(Exception):  # noqa: B017  Spark wraps the writer's error
        tile_files.save(bad, path)
    assert names(path) == ["p0.tspk", "p1.tspk"]


def test_broken_files_are_rows(spark, tmp_path):
    path = tmp_path / "c"
    saved(spark, str(path), 1)
    (path / "junk.tspk").write_bytes(b"junk" * 10)
    whole = container.write({"HEAD": b"a" * 900, "PAL": os.urandom(700)}, {})
    cut = bytearray(whole)
    at = next(a for t, a, _ in container.directory(whole) if t == "PAL")
    cut[at + 100] ^= 1
    (path / "flipped.tspk").write_bytes(bytes(cut))
    (path / "headless.tspk").write_bytes(container.write({"PAL": b"x"}, {}))
    told = {os.path.basename(r.path): r.error for r in tile_files.load(spark, str(path), complete="true").filter("error IS NOT NULL").collect()}
    assert set(told) == {"junk.tspk", "flipped.tspk", "headless.tspk"} and "checksum" in told["flipped.tspk"] and "HEAD" in told["headless.tspk"]


def test_filters_on_tags_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "c")
    saved(spark, path)
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        d = tile_files.load(spark, path).filter((F.col("tag") == "DCT") & (F.col("length") > 0))
        plan = d._jdf.queryExecution().executedPlan().toString()
        left = plan.split("Filter")[1].split("\n")[0]
        assert "DCT" not in left and "length" in left  # only the rest is left to Spark
        assert len(d.collect()) == 5
        (tmp_path / "c" / "broken.tspk").write_bytes(container.write({"HEAD": b"h", "PAL": os.urandom(200)}, {})[:-1])
        assert tile_files.load(spark, path).filter(F.col("tag").isin("HEAD", "PAL")).count() == 10
    finally:
        spark.conf.unset(key)


def test_an_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "c")
    assert tile_files.load(spark, str(tmp_path / "c")).count() == 0
