"""Tables written to the folder that all executors share, for results that must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables written by this driver, for ``clean``.
_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset under a local master (tests) one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables of ``written`` in this session, whose number it returns. Frames that read them cannot be used afterwards."""
    n = 0
    for path in _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    _WRITTEN.clear()
    return n
