"""Session helpers: the folder that driver and executors share, and written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used in local mode only
    (driver and executors are then one process); a cluster without the setting
    is an error, as executors could not see the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foldkeep-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/foldkeep/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage ends at the files, so a lost executor costs a re-read and not
    the work above, and every later reader sees the same rows even where the
    work above isn't deterministic.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared place once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that a worker hands on between two trims.
TRIM_BYTES = 16 << 20


def trim() -> None:
    """Give memory that is free inside this process back to the machine, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def lean(run):
    """A function over batches for ``mapInArrow`` that leaves no idle memory in its worker, which Spark keeps for later tasks."""

    def wrapped(batches):
        size = 0
        for b in run(batches):
            size += b.nbytes
            yield b
            if size > TRIM_BYTES:
                size = 0
                trim()
        trim()

    return wrapped


def free_name(df: DataFrame, name: str, *more: str) -> str:
    """``name``, or with as many underscores in front as no column of ``df`` and none of ``more`` has (in any case)."""
    taken = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in taken:
        name = "_" + name
    return name
