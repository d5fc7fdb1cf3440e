"""Session helpers: tables by name, lineage cuts in the shared folder, broadcasts behind a size check."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the count is taken before the hint is given.
BROADCAST_ROWS = 20_000
_settled: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors share one machine's disk: one process, as in tests."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is made only for a local session that names none. Elsewhere it is an error to name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="capsidora-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which :func:`release` and the end of the program delete."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _settled.append((spark, path))
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def local_path(path: str) -> str:
    """A path of a mounted file system as programs take it, without its scheme."""
    return re.sub(r"^file:/+", "/", path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return bool(fs.exists(at))


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def release(spark: SparkSession | None = None) -> None:
    """Delete what was settled (by one session, or by all); results that read it must have been written before."""
    kept = []
    for owner, path in _settled:
        if spark is None or owner is spark:
            with contextlib.suppress(Exception):  # the session may have ended
                fs, at = _file_system(owner, path)
                fs.delete(at, True)
        else:
            kept.append((owner, path))
    _settled[:] = kept


atexit.register(release)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
