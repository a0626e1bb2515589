"""Shared storage: lineage is cut with checkpoint() or tables in the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this driver, for ``clean``.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where the setting is absent (local tests) one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables that are read again.

    It keeps the size that its plan was estimated at, and joins multiply sizes: what is joined again and again goes through
    ``table``, whose size is that of its files. Else the estimate's digits triple with every round, in the driver's memory."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder as Parquet (in one folder for each value of ``by``) and read again, for tables of which later steps need some columns."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables and checkpoints of this session; call it when the results are written.

    Data frames returned by the operators read them, so they cannot be used afterwards. Returns the number of folders."""
    jvm, sc = spark._jvm, spark.sparkContext
    paths = [*_WRITTEN, *([sc.getCheckpointDir()] if sc.getCheckpointDir() else [])]
    n = 0
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True))
    _WRITTEN.clear()
    if sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return n


#: Rows and bytes of an Arrow batch, so that a Python worker holds a few MB of texts at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def _lean(f):
    """f, and when its input is used up, free memory goes back to the system: workers live on for other stages."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return run


def arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes.

    Spark reads the limits when the lazy result runs, so they stay set in the session; smaller ones of the caller's are left."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}", None)
        now = int(now) if now and now.lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df.mapInArrow(_lean(f), schema)
