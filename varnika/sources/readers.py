"""Scans: CSV, JSON lines, Parquet with column discovery, transcripts, capped scans, tables over JDBC, audio files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, StringType, StructType


def read_rows(spark: SparkSession, paths: str | list[str], schema: StructType | None = None) -> DataFrame:
    """Rows of CSV files (header row, byte order mark dropped, quoted line breaks) or JSON lines (blank lines skipped), by the ending;
    any other ending is an error. Adds _file and _seq, by which first-wins duplicates are ordered."""
    paths = sorted([paths] if isinstance(paths, str) else paths)
    kinds = {Path(p).suffix.lower() for p in paths}
    if kinds == {".csv"}:
        df = spark.read.csv(paths, header=True, multiLine=True, escape='"', schema=schema)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    elif kinds in ({".jsonl"}, {".ndjson"}):
        df = (spark.read.schema(schema) if schema else spark.read).json(paths)
    else:
        raise ValueError(f"unsupported files: {', '.join(sorted(kinds))}")
    return df.withColumn("_file", F.input_file_name()).withColumn("_seq", F.monotonically_increasing_id())


def find_columns(df: DataFrame, parts: tuple[str, ...]) -> list[str]:
    """Columns of text or bytes whose name holds one of the parts, in order of name."""
    return sorted(f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType)) and any(p in f.name.lower() for p in parts))


def usable_transcripts(df: DataFrame, human: str, recognised: str, error: str | None = None) -> DataFrame:
    """Rows without error whose two texts are filled; the filters reach the scan."""
    ok = F.col(human).isNotNull() & (F.col(human) != "") & F.col(recognised).isNotNull() & (F.col(recognised) != "")
    return df.where(ok & F.col(error).isNull() if error else ok)


def capped(df: DataFrame, by: str, n: int, order: str) -> DataFrame:
    """The first n rows of each group in an order; Spark prunes each task to n rows before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def shard_counts(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Per Parquet file: rows, and rows with text."""
    df = spark.read.parquet(path).select(text, "_metadata.file_name")
    return df.groupBy("file_name").agg(F.count("*").alias("rows"), F.count_if(F.trim(text) != "").alias("filled"))


def read_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table over JDBC; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, length, content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
