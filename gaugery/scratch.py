"""Tables in the shared scratch folder: they cut lineage, survive lost executors, and are scanned as often as needed."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []
_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none there is a local one, in local mode only: on a cluster
    each executor would write to its own disk, so that is an error."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="gaugery-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return _own_root[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared scratch folder and read it again: cuts lineage, survives lost executors, scanned as often as needed.

    options: of the Parquet writer, by names with underscores for dots.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gaugery-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    df.write.options(**{k.replace("_", "."): v for k, v in options.items()}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the scratch tables written after the first `since`; what was read from them must be written or done with."""
    while len(_written) > since:
        _remove(spark, _written.pop())


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside are removed at the end; results must be written before it."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of the given bytes, which the driver holds, in a scratch folder of its own; gives the folder's path."""
    folder = f"{scratch_root(spark)}/gaugery-file-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(folder)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    return folder
