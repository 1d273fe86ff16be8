"""Binary slices, tiles of results, and sums over a stream."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators.pairs import D, linear_terms
from kinfold.plans import panel
from kinfold.sources import lines, slices, tables
from kinfold.streaming import sums

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["plain", "gz"])
def test_slices(spark, tmp_path, kind):
    x = np.random.default_rng(1).normal(size=(500, 7, 3))
    path = str(tmp_path / ("x.glf.gz" if kind == "gz" else "x.glf"))
    with (gzip.open if kind == "gz" else open)(path, "wb") as f:
        f.write(x.tobytes())
    got = slices.read_slices(spark, path, 7, 2, split=5000)
    rows = got.orderBy("record").collect()
    assert [r["record"] for r in rows] == list(range(500)) and np.array_equal([r["values"] for r in rows], x[:, :2].reshape(500, 6))
    assert kind == "gz" or got.rdd.getNumPartitions() > 10
    out = str(tmp_path / "out")
    slices.write_slices(got, out)
    whole = b"".join(open(p.removeprefix("file:"), "rb").read() for p, _ in lines.files(out))
    assert gzip.decompress(whole) == x[:, :2].tobytes()
    with open(path, "wb") as f:
        f.write((gzip.compress if kind == "gz" else bytes)(x.tobytes()[:-8]))
    with pytest.raises(Exception, match="ends within a record"):
        slices.read_slices(spark, path, 7, 2).collect()


def test_slices_of_no_samples(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"")
    assert slices.read_slices(spark, str(tmp_path / "x"), 3, 3).count() == 0
    with pytest.raises(Exception, match="from 1 to all"):
        slices.read_slices(spark, str(tmp_path / "x"), 3, 4).collect()


def test_tiles(spark, tmp_path):
    n = 11
    rows = [(x, y, float(x * 100 + y), *(float(x + y * k) for k in range(9))) for x in range(n) for y in range(x, n)]
    pairs = spark.createDataFrame(rows, "x int, y int, kinship double, " + ", ".join(f"{d} double" for d in D))
    theta, nine = tables.dense(pairs, n), None
    theta, nine = theta[1], theta[0]
    tables.write_tiles(pairs, str(tmp_path / "t"), 4)
    for i in range(3):
        for j in range(3):
            a, b = tables.read_tile(spark, str(tmp_path / "t"), i, j)
            h, w = theta[4 * i : 4 * i + 4, 4 * j : 4 * j + 4].shape
            assert np.array_equal(a[:h, :w], theta[4 * i : 4 * i + 4, 4 * j : 4 * j + 4]) and np.array_equal(b[:h, :w], nine[4 * i : 4 * i + 4, 4 * j : 4 * j + 4])
            assert np.isnan(a[h:]).all() and np.isnan(a[:, w:]).all()
    with pytest.raises(ValueError, match="no tile"):
        tables.read_tile(spark, str(tmp_path / "t"), 3, 0)


def test_stream(spark, tmp_path):
    """Batches as they arrive add up to the sums of all, also if one is run again."""
    all_ = panel.frequencies(spark, SF).select("site_id", "af", "lo", "hi").where("site_id < 90")
    for k in range(3):
        all_.where(F.col("site_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sums.streaming_linear_terms(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    want = {(r["x"], r["y"]): r for r in linear_terms(all_).collect()}

    def check(path):
        got = sums.totals(spark, str(path)).collect()
        assert len(got) == len(want) == 528
        assert all(r["v"] == 90 and abs(r["m9"] - want[r["x"], r["y"]]["m9"]) < 1e-9 for r in got)

    check(tmp_path / "out")
    # without its checkpoint the stream runs every batch again, into the same folders
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sums.streaming_linear_terms(stream, str(tmp_path / "out"), str(tmp_path / "other")).awaitTermination()
    check(tmp_path / "out")
    sums.compacted(spark, str(tmp_path / "out"), str(tmp_path / "next"))
    check(tmp_path / "next")
