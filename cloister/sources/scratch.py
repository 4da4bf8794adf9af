"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a local run, as in tests) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="cloister-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends or by ``release``."""
    path = f"{shared_dir(spark)}/cloister/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def transient():
    """Deletes the intermediate tables that are written within, once what they were for is done."""
    start = len(_written)
    yield
    mine = _written[start:]
    del _written[start:]
    for owner, path in mine:
        remove_path(owner, path)


def release() -> None:
    """Delete the intermediate tables written so far."""
    while _written:
        spark, path = _written.pop()
        try:
            remove_path(spark, path)
        except Exception:  # the session has ended; nothing can be deleted through it any more
            continue


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


atexit.register(release)
