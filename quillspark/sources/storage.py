"""Files of a run on any storage that Hadoop's file systems reach: whole texts, digests and CSV in one file.

Everything is written beside its target and renamed over it, so readers find the old file or the new one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _beside(path: str) -> str:
    head, _, name = str(path).rpartition("/")
    return f"{head}/.{name}.{uuid.uuid4().hex}" if head else f".{name}.{uuid.uuid4().hex}"


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename over the target in one step."""
    jvm, (at, fs), (to, _) = spark._jvm, _path(spark, source), _path(spark, target)
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(at), fs.makeQualified(to), options)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """For texts of the size of a report."""
    beside = _beside(path)
    at, fs = _path(spark, beside)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _replace(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """None where there is no such file."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8-sig")
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """The object of a JSON file; a missing, malformed or other one is empty."""
    try:
        data = json.loads(read_text(spark, path) or "")
    except ValueError:
        return {}
    return data if isinstance(data, dict) else {}


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file, streamed in the JVM; empty for what is no file."""
    at, fs = _path(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return ""
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def size(spark: SparkSession, path: str) -> int | None:
    at, fs = _path(spark, path)
    return fs.getFileStatus(at).getLen() if fs.exists(at) else None


def flat(df: DataFrame) -> DataFrame:
    """All columns as the text of a CSV cell: arrays joined by a blank, null empty, other values cast."""
    cell = lambda c, kind: F.array_join(F.col(f"`{c}`").cast("array<string>"), " ") if kind.startswith("array<") and "struct" not in kind else F.to_json(f"`{c}`") if kind.startswith(("array<", "map<", "struct<")) else F.col(f"`{c}`").cast("string")
    return df.select(*[T.text(cell(c, kind)).alias(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, order=(), drop=()) -> None:
    """One CSV file with a header, also when empty, its rows in the given order (columns or expressions), without the columns of ``drop``.

    For tables that people open: a single task writes the file. Larger ones are written as folders (``files.write_csv``)."""
    spark, beside = df.sparkSession, _beside(path)
    rows = df.repartition(1).sortWithinPartitions(*order) if order else df.coalesce(1)
    flat(rows.drop(*drop)).write.mode("overwrite").csv(beside, header=True, quote='"', escape='"', emptyValue="")
    at, fs = _path(spark, beside)
    part = next((s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), None)
    if part is None:  # not even a header: no columns
        write_text(spark, path, "")
    else:
        if exists(spark, path) and not _path(spark, path)[1].getFileStatus(_path(spark, path)[0]).isFile():
            _path(spark, path)[1].delete(_path(spark, path)[0], True)  # a folder of CSV files of a larger table
        _replace(spark, part, path)
    fs.delete(at, True)
