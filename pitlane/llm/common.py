"""Helpers that the text operators share: tables in the shared folder and long literal arrays."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"
#: Writers hold a row group in memory, one for each task.
ROW_GROUP_BYTES = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owned: list[tempfile.TemporaryDirectory] = []
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or on one machine (tests) a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.TemporaryDirectory(prefix="pitlane-")
        _owned.append(own)
        atexit.register(own.cleanup)
        found = f"file://{own.name}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet, in a folder of this application that goes when the driver ends."""
    own = f"{shared_dir(spark)}/pitlane-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the application has ended before
        pass


def spool(df: DataFrame, tag: str, codec: str = "zstd", tidy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that outlive any executor.

    tidy: the write's shuffle files go as soon as it ends, else when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.spooled = path
    return made


def discard(*made: DataFrame) -> None:
    """Delete tables that spool() returned, once all that reads them has itself been written."""
    for df in made:
        _remove(df.sparkSession, df.spooled)


def lean(run):
    """A function over Arrow batches that gives freed memory back to the system when a task ends; Python workers live on and would keep it."""

    def bounded(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return bounded


def long_array(values: Sequence[int]) -> Column:
    """A foldable array<bigint> literal; one string instead of one expression for each value."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")


def rank_in(size: int, at_most) -> Column:
    """How many of `size` sorted entries lie at or below a row's key; at_most(i) says so of the entry at 0-based i. Binary search in the JVM."""
    steps = [1 << k for k in reversed(range(max(1, size.bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda n, s: F.when((n + s <= size) & at_most(n + s - 1), n + s).otherwise(n),
    )
