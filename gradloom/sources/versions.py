"""Tables whose keys are replaced as a whole: write a generation, then move the pointers, in one step.

A table's folder holds

* ``data/gen=...``: rows, as each refresh wrote them; never changed afterwards,
* ``pointers/...``: for each key the generation that holds its rows, a whole small table for each commit,
* ``commits/000000000001, ...``: one file for each commit, with the name of its pointer table.

A commit is the creation of its numbered file, which the file system lets one writer do once. Until then
readers see the commit before, wherever the writer stops; after it they see all of the new rows. A key whose new result is empty
gets a pointer to a generation without rows of it: that is how "delete, then insert nothing" reads. Two writers that meet
at a number don't lose each other's keys: the second takes the pointers of the first as its base and tries the next
number. Keys are compared null-safe, so rows without a module or subject are a key like any other.

Nothing but the names of commits passes through the driver. What no pointer refers to any more is deleted by :func:`vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.lineage import cut

_GEN = "gen"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def commits(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a table's commits."""
    return [int(n) for n in _names(spark, f"{folder}/commits") if n.isdigit()]


def _pointers(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    if not number:
        return None
    fs, target = _fs(spark, f"{folder}/commits/{number:012d}")
    stream = fs.open(target)
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.parquet(f"{folder}/pointers/{name}")


def _create(spark: SparkSession, folder: str, number: int, name: str) -> bool:
    """The commit's file, unless another writer has it already."""
    fs, target = _fs(spark, f"{folder}/commits/{number:012d}")
    try:
        stream = fs.create(target, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    stream.write(bytearray(name.encode()))
    stream.close()
    return True


def _same(by: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & left[c].eqNullSafe(right[c])
    return out


def refresh(rows: DataFrame, folder: str, by: Sequence[str], keys: DataFrame | None = None) -> int:
    """Replaces everything that the table holds for ``keys`` (columns ``by``; those of ``rows`` where None) by ``rows``; the commit's number.

    Rows of other keys than ``keys`` are refused, as readers would never see them.
    """
    spark, generation = rows.sparkSession, f"g{uuid.uuid4().hex}"  # never a number
    path = f"{folder}/data/{_GEN}={generation}"
    rows.write.parquet(path)
    written = spark.read.schema(rows.schema).parquet(path).select(*by).distinct()
    if keys is None:
        keys = written
    else:
        keys = keys.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in by]).distinct()
        if written.join(keys, _same(by, written, keys), "left_anti").limit(1).count():
            raise ValueError("rows of keys that aren't to be replaced")
    new = keys.withColumn(_GEN, F.lit(generation))
    while True:
        number = max(commits(spark, folder), default=0)
        known = _pointers(spark, folder, number)
        pointers = new if known is None else known.join(new, _same(by, known, new), "left_anti").unionByName(new)
        name = uuid.uuid4().hex
        pointers.write.parquet(f"{folder}/pointers/{name}")
        if _create(spark, folder, number + 1, name):
            return number + 1


def read(spark: SparkSession, folder: str, by: Sequence[str], at: int | None = None) -> DataFrame:
    """The table as of its last commit, or of commit ``at``: later commits don't change what this gives."""
    number = max(commits(spark, folder), default=0) if at is None else at
    pointers = _pointers(spark, folder, number)
    if pointers is None:
        raise ValueError(f"{folder} has no commit")
    data = spark.read.parquet(f"{folder}/data")
    # the generation is a partition column: Spark can leave out files of generations that no pointer names
    live = pointers.withColumnRenamed(_GEN, "__gen")
    return data.join(live, _same(by, data, live) & (data[_GEN] == live["__gen"]), "left_semi").drop(_GEN)


def recompute(table: DataFrame, folder: str, by: Sequence[str], keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Refreshes ``keys`` alone: ``compute`` gets the rows of ``table`` that have them."""
    keys = cut(keys.select(*by).distinct(), "keys")  # read here, and for the check and the pointers of the refresh
    return refresh(compute(table.join(keys, _same(by, table, keys), "left_semi")), folder, by, keys)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Deletes the commits before the last ``keep``, and generations and pointer tables that no commit left refers to.

    For times without writers: a generation that is being written isn't referred to yet.
    """
    numbers = commits(spark, folder)
    stay = numbers[-keep:]
    live: set[str] = set()
    for n in stay:  # names of generations, as many as refreshes still count
        live |= {r[_GEN] for r in _pointers(spark, folder, n).select(_GEN).distinct().collect()}
    tables = set()
    for n in stay:
        files = _pointers(spark, folder, n).inputFiles()
        tables |= {f.split("/pointers/")[1].split("/")[0] for f in files}
    gone = []
    for kind, names in (("data", [f"{_GEN}={g}" for g in live]), ("pointers", tables), ("commits", [f"{n:012d}" for n in stay])):
        for name in _names(spark, f"{folder}/{kind}"):
            if name not in names:
                fs, target = _fs(spark, f"{folder}/{kind}/{name}")
                fs.delete(target, True)
                gone.append(f"{kind}/{name}")
    return gone
