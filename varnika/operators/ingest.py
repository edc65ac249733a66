"""Reading rows into canonical aligned pairs: mapping, validation with quarantine, content ids, first-wins duplicates, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from varnika.functions.text import nfc, strip

SPLITS = ("train", "validation", "test")
FIELDS = ("id", "anchor_language", "target_language", "anchor_text", "target_text", "audio_path", "speaker_id", "source", "license", "split")
PAIR = T.StructType([T.StructField(f, T.StringType(), f in ("audio_path", "speaker_id", "split")) for f in FIELDS])
RATING = T.StructType([T.StructField(f, T.StringType(), f == "notes") for f in ("item_id", "rater_id", "choice", "notes")])


def blank_to_null(c: Column | str) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def content_id(anchor: Column | str, target: Column | str) -> Column:
    """First twelve hex digits of the SHA-256 of both stripped texts, composed, with a unit separator between them."""
    return F.substring(F.sha2(nfc(F.concat(strip(anchor), F.lit("\x1f"), strip(target))), 256), 1, 12)


def unknown_fields(df: DataFrame) -> list[str]:
    """Columns that a canonical pair does not have."""
    return sorted(set(df.columns) - set(FIELDS))


def canonical(rows: DataFrame, mapping: dict[str, str], constants: dict[str, str] | None = None) -> DataFrame:
    """rows with the canonical columns: mapping names the input column of a field, constants give its value. Texts are stripped and
    composed; optional fields that are blank become null; a blank or missing id becomes the content id."""
    constants = constants or {}
    out = rows.select(
        *[
            (nfc(strip(F.col(mapping[f]))) if f in mapping else F.lit(constants.get(f)).cast("string")).alias(f)
            for f in FIELDS
        ],
        *[c for c in rows.columns if c.startswith("_")],
    )
    for f in ("audio_path", "speaker_id", "split", "id"):
        out = out.withColumn(f, F.nullif(F.col(f), F.lit("")))
    return out.withColumn("id", F.coalesce("id", content_id("anchor_text", "target_text")))


def validation_error() -> Column:
    """The first fault of a canonical pair, or null."""
    out = F.lit(None).cast("string")
    checks = [(F.coalesce(F.length(f), F.lit(0)) == 0, f"{f} is empty") for f in ("id", "anchor_language", "target_language", "anchor_text", "target_text", "source", "license")]
    checks.append((F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS), "split is unknown"))
    for bad, message in reversed(checks):
        out = F.when(bad, message).otherwise(out)
    return out


def first_wins(df: DataFrame, key: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): of the rows of one key, the first in this order is kept. Null keys are one key."""
    numbered = df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return numbered.where("__n = 1").drop("__n"), numbered.where("__n > 1").drop("__n")


def ingest_status(rows: DataFrame, *order: Column) -> DataFrame:
    """Canonical rows with status: invalid (with error), duplicate, or written. Invalid rows do not make later ones duplicates."""
    checked = rows.withColumn("error", validation_error())
    n = F.row_number().over(W.partitionBy(F.col("error").isNull(), "id").orderBy(*order))
    return checked.withColumn("__n", n).withColumn("status", F.when(F.col("error").isNotNull(), "invalid").when(F.col("__n") > 1, "duplicate").otherwise("written")).drop("__n")


def ingest_report(status: DataFrame, known_audio: DataFrame | None = None) -> DataFrame:
    """One row: read, written, invalid, duplicates, missing_audio (written rows whose audio_path is not in known_audio; rows are kept)."""
    counted = status.agg(
        F.count("*").alias("read"),
        F.count_if(F.col("status") == "written").alias("written"),
        F.count_if(F.col("status") == "invalid").alias("invalid"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
    )
    wanted = status.where("status = 'written' and audio_path is not null").select("audio_path")
    missing = wanted.join(known_audio.select("audio_path").distinct(), "audio_path", "left_anti") if known_audio is not None else wanted.limit(0)
    return counted.crossJoin(missing.agg(F.count("*").alias("missing_audio")))


def first_errors(status: DataFrame, *order: Column, n: int = 5) -> DataFrame:
    """The first few faults of invalid rows in this order, for a report."""
    return status.where("status = 'invalid'").orderBy(*order).limit(n).select("id", "error")


def one_language_pair(*tables: DataFrame) -> tuple[str, str]:
    """The languages that all rows of all tables have; more than one pair, or none, raises."""
    pairs = reduce(DataFrame.unionByName, (t.select("anchor_language", "target_language") for t in tables)).distinct().limit(2).collect()
    if len(pairs) != 1:
        raise ValueError(f"{len(pairs)} language pairs or more, not one")
    return tuple(pairs[0])


def insert_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those of new whose key is not there (insert, on conflict do nothing). Of equal new keys one is taken, the smallest row."""
    fresh = new.join(existing.select(key), key, "left_anti")
    fresh, _ = first_wins(fresh, key, *[F.col(c).asc_nulls_first() for c in sorted(fresh.columns) if c != key])
    return existing.unionByName(fresh.select(existing.columns))


def update_by_key(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the non-null values of changes (one row per key) in their columns."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in own])
    return existing.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in own else F.col(c) for c in existing.columns])


def delete_by_key(existing: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """existing without the rows whose keys all match a row of gone."""
    return existing.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def retained(df: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """The rows not older than so many days at as_of."""
    return df.where(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS"))
