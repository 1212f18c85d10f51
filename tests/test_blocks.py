"""Block payloads: exact round trips, guards, versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from tilespark.operators import blocks as B
from tilespark.sources.container import FormatError


def same(a, b):
    assert set(a) <= set(b)
    for k in a:
        assert np.array_equal(np.asarray(a[k]), np.asarray(b[k])), k


VALUES = {
    "TOC": {"n": 3, "offsets": [0, 7, 7]},
    "CIDX": {"n": 2, "chunks": np.array([(0, 4, 0, 9, 0, 5), (4, 2, 9, 3, 5, 3)], B.CHUNK)},
    "RES0": {"n": 2, "bias": [-128, 0, 127, 1, 2, 3]},
    "RES1": {"n": 1, "side": 2, "grid": list(range(-6, 6))},
    "QTREE": {"n": 2, "tiles": np.array([(0, 0, 32), (32, 64, 8)], B.TILE)},
    "LITE": {"h": 2, "w": 2, "grid": [-128, 127, 0, 5]},
    "PAL": {"k": 2, "w": 3, "h": 1, "palette": [0, 1, 2, 253, 254, 255], "labels": [0, 1, 1]},
    "GRD": {"w": 2, "h": 1, "scale": 64, "c": 1, "means": [0.5], "gx": [1, 0], "gy": [-2, 3]},
}
DCT = {"chroma": 2, "step": 0.25, "alpha": 1.5, "channels": 3, "n": 4, "tiles": 9, "mask": [255, 1], "layout": 1, "scaled": 2, "scales": [7, 200], "coefficients": [-32768, 0, 1, 32767]}


@pytest.mark.parametrize("kind", VALUES)
def test_roundtrip_and_truncation(kind):
    payload = B.pack(kind, VALUES[kind])
    same(VALUES[kind], B.unpack(kind, payload))
    for cut in range(len(payload)):
        with pytest.raises(FormatError):
            B.unpack(kind, payload[:cut])
    with pytest.raises(FormatError):
        B.unpack(kind, payload + b"\0")


@pytest.mark.parametrize("version", [2, 3, 4, 5])
def test_every_version_of_the_transform_block_is_read(version):
    got = B.unpack_dct(B.pack_dct(DCT, version))
    assert got["version"] == version and got["coefficients"].tolist() == DCT["coefficients"] and got["step"] == 0.25
    assert got["layout"] == (1 if version > 3 else 0) and len(got["mask"]) == (2 if version > 2 else 0) and len(got["scales"]) == (2 if version > 4 else 0)
    with pytest.raises(FormatError):
        B.unpack_dct(bytes([9]) + B.pack_dct(DCT)[1:])


@pytest.mark.parametrize(("kind", "change"), [
    ("TOC", {"offsets": [3, 2, 9]}), ("TOC", {"n": 4}), ("RES0", {"bias": [0, 0, 200, 0, 0, 0]}), ("RES1", {"side": 0, "grid": []}), ("QTREE", {"tiles": np.array([(0, 0, 9), (0, 0, 8)], B.TILE)}),
    ("PAL", {"labels": [0, 2, 0]}), ("PAL", {"k": 0, "palette": []}), ("GRD", {"scale": 0}), ("GRD", {"gy": [1]}), ("CIDX", {"chunks": np.array([(0, 4, 0, 9, 0, 5), (5, 2, 9, 3, 5, 3)], B.CHUNK)}),
])
def test_guards(kind, change):
    with pytest.raises(FormatError):
        B.pack(kind, {**VALUES[kind], **change})


@pytest.mark.parametrize("change", [{"chroma": 3}, {"alpha": -0.5}, {"layout": 2}, {"mask": [1]}])
def test_guards_of_the_transform_block(change):
    with pytest.raises(FormatError):
        B.pack_dct({**DCT, **change})


def test_what_cannot_be_packed_is_an_error_column(spark):
    d = spark.createDataFrame([(1, [1, 2]), (2, [2, 1])], "k int, offsets array<int>")
    got = {r.k: r for r in B.packed(d, ["k"], ["offsets"], lambda r: B.pack("TOC", {"n": 2, "offsets": r["offsets"]})).collect()}
    assert got[1].error is None and got[2].payload is None and "descend" in got[2].error


class Held:
    """In place of a DataFrame: hands out the function that tasks run on batches."""

    schema = StructType().add("k", IntegerType()).add("v", ArrayType(IntegerType())).add("payload", BinaryType())

    def select(self, *_):
        return self

    def mapInArrow(self, run, ddl):
        return run


def test_large_batches_are_packed_and_read_in_parts():
    n, each = 40, B.MOST // 5
    v = [[*range(i, i + each)] for i in range(n)]
    v[3], v[20] = [], [5, 4]
    batch = pa.record_batch({"k": pa.array(range(n), pa.int32()), "v": pa.array(v, pa.list_(pa.int32()))})
    made = list(B.packed(Held(), ["k"], ["v"], lambda r: B.pack("TOC", {"n": len(r["v"]), "offsets": r["v"]}))(iter([batch])))
    assert max(b.num_rows for b in made) <= 7
    whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    assert whole.column("k").to_pylist() == [*range(n)] and [i for i, e in enumerate(whole.column("error").to_pylist()) if e] == [20]
    got = list(B.values(Held(), ["k"], "offsets", lambda x: B.unpack("TOC", x))(iter([whole.select(["k", "payload"])])))
    assert max(b.num_rows for b in got) <= B.MOST
    rows = pa.Table.from_batches(got)
    assert rows.column("value").to_pylist() == [x for i, a in enumerate(v) if i != 20 for x in a]
    assert rows.column("k").to_pylist() == [i for i, a in enumerate(v) if i != 20 for _ in a]
    tiles = B.pack("QTREE", {"n": 9000, "tiles": np.array([(8, 16, 32)] * 9000, B.TILE)})
    batch = pa.record_batch({"k": pa.array(range(9), pa.int32()), "payload": pa.array([tiles] * 4 + [None] + [tiles] * 4, pa.binary())})
    got = list(B.records(Held(), ["k"], ["size", "x"], lambda x: B.unpack("QTREE", x)["tiles"])(iter([batch])))
    assert len(got) > 1 and pa.Table.from_batches(got).column("k").to_pylist() == [k for k in range(9) if k != 4 for _ in range(9000)]
