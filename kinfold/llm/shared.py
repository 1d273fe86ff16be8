"""What the operators of this subpackage have in common."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII control spaces.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows in one Arrow batch; texts can be long, so that batches stay small.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one in ``spark.checkpoint.dir``. Where that is unset and all runs on one
    machine (a local master, as in tests) a temporary folder is made, once for a session;
    on a cluster it must be set, as executors would not share such a folder.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors share")
        there = getattr(sc, "_kinfold_shared", None) or "file://" + tempfile.mkdtemp(prefix="kinfold-")
        sc._kinfold_shared = there
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(there)
    return there


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/kinfold-{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables that ``written`` returned as these frames. For tables whose readers have
    all been written themselves: then nothing, not even a lost task, reads them again."""
    for df in frames:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._kinfold_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at ``BATCH_ROWS`` rows, for bounded memory in Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is that of a column (names are told apart without case)."""
    there, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in there:
            n += "_"
        there.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
