"""Sinks: JSON lines, splits with a manifest, CSV, append-only logs, reports, files of rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one file per task; the committer replaces the folder at once."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, seed: int, group_by: str, row_id: str = "id") -> DataFrame:
    """Each split in its own folder, ordered by id within files; returns the manifest (seed, group_by, split, n, digest of the ids)."""
    df.repartition("split", F.pmod(F.xxhash64(row_id), F.lit(64))).sortWithinPartitions("split", row_id).write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    digest = F.hex(F.bit_xor(F.xxhash64(row_id)))
    manifest = df.groupBy("split").agg(F.count("*").alias("n"), digest.alias("digest")).select(F.lit(seed).alias("seed"), F.lit(group_by).alias("group_by"), "split", "n", "digest")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for sheets that people fill in."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet log; earlier rows are never rewritten."""
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_files(df: DataFrame, folder: str, name: str, content: str, suffix: str) -> None:
    """A file per row (name, bytes), readable by its owner only, written by the executors to a folder they share."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = os.path.join(folder, os.path.basename(str(r[0])) + suffix)
            with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
                f.write(bytes(r[1]))

    df.select(name, content).where(F.col(name).isNotNull() & F.col(content).isNotNull()).foreachPartition(write)
