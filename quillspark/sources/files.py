"""CSV and text files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.tables import ordered_distinct, with_ord


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells text, missing empty; quoted line ends and a byte order mark are accepted."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    """Header even when empty; Spark's commit protocol makes the directory complete or absent."""
    flat = df.select(*[(F.array_join(c, " ") if t.startswith("array<") else T.text(F.col(c).cast("string"))).alias(c) for c, t in df.dtypes])
    (flat if not flat.isEmpty() else flat.coalesce(1)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of files with _ord, in the order of their lines; several files follow each other by name."""
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"))
    return with_ord(rows, "_file", "_at", "_line").drop("_file", "_at", "_line")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric dimension rows with the order of the file, on which the last of equal keys rests.

    A file is read as one partition in the order of its lines; several files follow each other by name."""
    return _in_order(read_csv(spark, path))


def read_queries(spark: SparkSession, path: str, extra=()) -> DataFrame:
    """Query lines of a file, then the extra ones: no blanks, no # lines, first of equals, ids q001 on. Nothing is collected."""
    lines = _in_order(spark.read.text(path)).select("_ord", F.col("value").alias("query"))
    more = spark.createDataFrame([((1 << 52) + i, str(q)) for i, q in enumerate(extra)], "_ord long, query string")
    kept = with_ord(ordered_distinct(lines.unionByName(more), "query").withColumnRenamed("_ord", "_first"), "_first")
    return kept.select(F.format_string("q%03d", F.col("_ord") + 1).alias("query_id"), "query", "_ord")
