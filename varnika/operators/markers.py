"""Words that mark a variety: counts, rate ratios, weights across varieties, log-odds, suffixes, marker scores.

Input of all counts is (variety, word) rows or a table of texts with a variety; words are counted in partial sums before any shuffle,
so the tables that follow have one row per variety and word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from varnika.functions.text import devanagari_words

LEAST = 3


def word_counts(texts: DataFrame, variety: str, text: str, words: Column | None = None) -> DataFrame:
    """variety, word, n. words: the array of words of a text, by default its runs of Devanagari. Null varieties and texts count nothing."""
    rows = texts.select(F.col(variety).alias("variety"), F.explode(words if words is not None else devanagari_words(text)).alias("word"))
    return rows.where("variety is not null").groupBy("variety", "word").agg(F.count("*").alias("n"))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("variety").agg(F.sum("n").alias("total"))


def marker_ratios(counts: DataFrame, reference: str, top: int = 100, only_distinct: bool = False, digits: int = 1) -> DataFrame:
    """For each variety but the reference its words with n >= 3 and two characters: n, ref_n, ratio of rates (reference rate plus 1e-7,
    rounded). only_distinct keeps those not in the reference or with a ratio over 20. The first ``top`` by ratio, n, word."""
    base = counts.where(F.col("variety") == reference).select("word", F.col("n").alias("ref_n"))
    total = _totals(counts)
    ref_total = total.where(F.col("variety") == reference).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("ref_total"))
    rows = counts.where((F.col("variety") != reference) & (F.col("n") >= LEAST) & (F.length("word") >= 2)).join(base, "word", "left").join(total, "variety").crossJoin(F.broadcast(ref_total))
    ref_n = F.coalesce("ref_n", F.lit(0))
    ref_rate = F.when(F.col("ref_total") > 0, ref_n / F.col("ref_total")).otherwise(0.0)
    rows = rows.select("variety", "word", "n", ref_n.alias("ref_n"), (F.col("n") / F.col("total") / (ref_rate + F.lit(1e-7))).alias("raw"))
    if only_distinct:
        rows = rows.where("ref_n = 0 or raw > 20")
    rows = rows.withColumn("ratio", F.round("raw", digits))
    rank = F.row_number().over(W.partitionBy("variety").orderBy(F.desc("ratio"), F.desc("n"), "word"))
    return rows.withColumn("position", rank).where(F.col("position") <= top).drop("raw")


def marker_weights(counts: DataFrame, reference: str, keep: float = 0.5) -> DataFrame:
    """variety, word, weight: candidates distinct from the reference, weighted by one over the number of varieties (without the
    reference) that use the word at least three times; those below ``keep`` are shared and left out."""
    users = counts.where((F.col("variety") != reference) & (F.col("n") >= LEAST)).groupBy("word").agg(F.count("*").alias("users"))
    candidates = marker_ratios(counts, reference, top=2**31 - 1, only_distinct=True).select("variety", "word")
    return candidates.join(users, "word").select("variety", "word", (F.lit(1.0) / F.col("users")).alias("weight")).where(F.col("weight") >= keep)


def log_odds(counts: DataFrame, top: int = 15, alpha: float = 1.0) -> DataFrame:
    """Per variety the words with n >= 3 by z-score of the log-odds against all other varieties (smoothing alpha): n, rest, log_odds
    (2 digits), z (1 digit). Order: z, word."""
    every = counts.groupBy("word").agg(F.sum("n").alias("all_n"))
    size = every.agg(F.count("*").alias("v"), F.sum("all_n").alias("everything"))
    rows = counts.where(F.col("n") >= LEAST).join(every, "word").join(_totals(counts), "variety").crossJoin(F.broadcast(size))
    rest = F.col("all_n") - F.col("n")
    p = (F.col("n") + alpha) / (F.col("total") + alpha * F.col("v"))
    q = (rest + alpha) / (F.col("everything") - F.col("total") + alpha * F.col("v"))
    odds = F.log(p / q)
    z = odds / F.sqrt(1.0 / (F.col("n") + alpha) + 1.0 / (rest + alpha))
    rows = rows.select("variety", "word", "n", rest.alias("rest"), F.round(odds, 2).alias("log_odds"), F.round(z, 1).alias("z"))
    rank = F.row_number().over(W.partitionBy("variety").orderBy(F.desc("z"), "word"))
    return rows.withColumn("position", rank).where(F.col("position") <= top)


def suffixes(counts: DataFrame, length: int = 2, top: int = 10) -> DataFrame:
    """Per variety the word endings that stand out: n >= 5 and rate ratio (rest rate plus 1e-6) over 1.5, rounded to 1 digit."""
    ends = counts.where(F.length("word") > length).select("variety", F.right("word", F.lit(length)).alias("suffix"), "n").groupBy("variety", "suffix").agg(F.sum("n").alias("n"))
    every = ends.groupBy("suffix").agg(F.sum("n").alias("all_n"))
    size = ends.agg(F.sum("n").alias("everything"))
    rows = ends.where("n >= 5").join(every, "suffix").join(ends.groupBy("variety").agg(F.sum("n").alias("total")), "variety").crossJoin(F.broadcast(size))
    rest = F.coalesce((F.col("all_n") - F.col("n")) / F.nullif(F.col("everything") - F.col("total"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("raw", F.col("n") / F.col("total") / (rest + F.lit(1e-6))).where("raw > 1.5").withColumn("ratio", F.round("raw", 1))
    rank = F.row_number().over(W.partitionBy("variety").orderBy(F.desc("ratio"), F.desc("n"), "suffix"))
    return rows.withColumn("position", rank).where(F.col("position") <= top).select("variety", "suffix", "n", "ratio", "position")


def marker_scores(texts: DataFrame, row_id: str, text: str, markers: DataFrame, saturation: float = 3.0, threshold: float = 0.67, margin: float = 0.15) -> DataFrame:
    """row_id, label, score, second: each text's best variety by the weight of the marker words it holds (each once) over the
    saturation, at most 1; hindi_unknown below the threshold or if the second is within the margin. Texts without markers score 0.

    Markers are matched as words, an equi-join on exploded words: a text and marker pair is never formed unless both share the word.
    """
    words = texts.select(F.col(row_id).alias("row_id"), F.explode(F.array_distinct(devanagari_words(text))).alias("word"))
    hits = words.join(markers, "word").groupBy("row_id", "variety").agg(F.sum("weight").alias("w"))
    scored = hits.withColumn("score", F.least(F.lit(1.0), F.col("w") / saturation))
    best = scored.groupBy("row_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", F.col("variety").alias("v"))))).alias("s"))
    picked = best.select("row_id", F.col("s")[0]["v"].alias("v"), F.col("s")[0]["score"].alias("score"), F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0)).alias("second"))
    out = texts.select(F.col(row_id).alias("row_id")).distinct().join(picked, "row_id", "left")
    score, second = F.coalesce("score", F.lit(0.0)), F.coalesce("second", F.lit(0.0))
    return out.select(F.col("row_id").alias(row_id), F.when((score >= threshold) & (score - second >= margin), F.col("v")).otherwise("hindi_unknown").alias("label"), score.alias("score"), second.alias("second"))


def substring_markers(text: Column, markers: list[str], isolated: tuple[str, ...] = ()) -> Column:
    """The markers in a text as an array of hits, by one alternation (at each place the first in sorted order wins); those in
    ``isolated`` only where no Devanagari letter or sign touches them."""
    letter = "[ऀ-ॣ०-ॿ]"
    parts = [rf"(?<!{letter})\Q{m}\E(?!{letter})" if m in isolated else rf"\Q{m}\E" for m in sorted(set(markers))]
    return F.regexp_extract_all(text, F.lit(f"({'|'.join(parts)})"), 1) if parts else F.array().cast("array<string>")


def substring_label(df: DataFrame, text: str, markers: list[str], isolated: tuple[str, ...] = (), saturation: int = 3, threshold: float = 0.67, label: str = "bhojpuri", other: str = "hindi") -> DataFrame:
    """df with hits, distinct_hits, confidence (distinct hits over the saturation, at most 1, 2 digits) and label."""
    hits = substring_markers(F.col(text), markers, isolated)
    df = df.withColumn("hits", F.coalesce(hits, F.array().cast("array<string>"))).withColumn("distinct_hits", F.array_sort(F.array_distinct("hits")))
    confidence = F.least(F.lit(1.0), F.size("distinct_hits") / F.lit(float(saturation)))
    return df.withColumn("confidence", F.round(confidence, 2)).withColumn("label", F.when(confidence >= threshold, label).otherwise(other))


def union_markers(*lists: DataFrame) -> DataFrame:
    """All words of several lists, each once."""
    return reduce(DataFrame.union, (x.select("word") for x in lists)).distinct()
