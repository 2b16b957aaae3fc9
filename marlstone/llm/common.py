"""What the operators of this subpackage share: shared storage and text conventions."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() cuts at the same characters.
WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset.

    A folder of our own is one of this machine, so it is refused unless the executors run on it too.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """These settings of the session, for a time."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str, hashed_bytes: int = 0) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and a lost executor costs nothing.

    The table goes with drop_stored(), or else when the driver ends. A join whose shuffled side turns out to have no
    partition above hashed_bytes is hashed instead of sorted; adaptive execution sees to that at run time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Spark deletes the shuffle files of a query when the query ends, not when the driver's garbage is collected
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if hashed_bytes:
        values["spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"] = str(hashed_bytes)
    with _settings(spark, values):
        df.write.parquet(path)
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() has written and that no later plan reads."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            fs, at = _fs(df.sparkSession, f)
            fs.delete(at, True)


def ascii_lower(x: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(x, _UPPER, _LOWER)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that Python workers find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_marlstone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._marlstone_shipped = True


def trim() -> None:
    """Gives a worker's freed memory back to the system, so that idle workers don't crowd an executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if release:
        release(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
