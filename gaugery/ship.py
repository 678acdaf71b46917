"""Python on executors: sends this package there, wherever the driver found it, and keeps the memory of its workers small."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch, where the session has Spark's own 10,000 rows: texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "16m")}


def ship(spark: SparkSession) -> None:
    """Once per application; to be called before Python code of the package runs on executors."""
    for key, (default, value) in BATCH.items():
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="gaugery-py-")  # on the driver, which serves it to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which its worker, which waits for further tasks, gives unused memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # elsewhere than on glibc
                ctypes.CDLL(None).malloc_trim(0)

    return tidied
