"""Making the package importable in the Python workers of the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's Python files, once for each application.

    Functions run by Python workers are pickled by reference, and a worker may start in a
    place from where the repository can't be imported.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="gradloom-ship-"), "gradloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows, and of ``size`` bytes and one row more, for what runs inside: whole texts make large
    rows, and a batch is held at once by the JVM and by its Python worker. Smaller settings stay."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {key: spark.conf.get(key) for key in limits}
    for key, most in limits.items():
        known = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[key])  # 10000, or 64m
        spark.conf.set(key, str(min(most, known) if known > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
