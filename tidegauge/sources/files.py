"""Folders as tables: list, read and search files by Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modified, bytes) of the files below path; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def read_file(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(line, text): lines first to last of one file, from 1. The file is one row until it is split, so it fits in a task."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return whole.where((F.col("line") >= first) & (F.lit(True) if last is None else F.col("line") <= last)).orderBy("line")


def search_files(spark: SparkSession, path: str, expression: str, pattern: str = "*") -> DataFrame:
    """(path, text): lines that hold the expression, of all files below path, large ones in splits."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    return rows.where(F.col("value").rlike(expression)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
