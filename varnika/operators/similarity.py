"""Similarity of groups by what they have in common: inverse group frequency, cosine, Jaccard, rank correlation, verdict.

Input: (grp, item, value). Pairs of groups are formed only through shared items, after counting, so the number of rows follows the
items that groups share, not the product of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W


def idf(table: DataFrame) -> DataFrame:
    """item, groups, idf = ln(all groups / groups with it)."""
    n = table.agg(F.count_distinct("grp").alias("every"))
    return table.groupBy("item").agg(F.count_distinct("grp").alias("groups")).crossJoin(F.broadcast(n)).select("item", "groups", F.log(F.col("every") / F.col("groups")).alias("idf"))


def group_similarity(table: DataFrame) -> DataFrame:
    """a < b, shared, cosine (of value times idf; a zero vector has length 1), jaccard, spearman (on shared items; null for fewer than
    four or for constant values), verdict. All pairs of groups appear, also those that share nothing."""
    rows = table.join(idf(table), "item").withColumn("w", F.col("value") * F.col("idf"))
    norm = rows.groupBy("grp").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count_distinct("item").alias("items"))
    norm = norm.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
    a, b = (rows.select(F.col("grp").alias(x), "item", F.col("w").alias(f"w_{x}"), F.col("value").alias(f"v_{x}")) for x in "ab")
    both = a.join(b, "item").where("a < b")
    rank = lambda x: F.rank().over(W.partitionBy("a", "b").orderBy(f"v_{x}")) + (F.count("*").over(W.partitionBy("a", "b", f"v_{x}")) - 1) / 2
    ranked = both.withColumn("r_a", rank("a")).withColumn("r_b", rank("b"))
    per = ranked.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("w_a") * F.col("w_b")).alias("dot"), F.corr("r_a", "r_b").alias("rho"))
    n_a, n_b = (norm.select(F.col("grp").alias(x), F.col("norm").alias(f"n_{x}"), F.col("items").alias(f"i_{x}")) for x in "ab")
    out = n_a.crossJoin(F.broadcast(n_b)).where("a < b").join(per, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    cosine = F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("n_a") * F.col("n_b"))
    jaccard = shared / (F.col("i_a") + F.col("i_b") - shared)
    rho = F.when((shared >= 4) & ~F.isnan("rho"), F.col("rho"))
    out = out.select("a", "b", shared.alias("shared"), cosine.alias("cosine"), jaccard.alias("jaccard"), rho.alias("spearman"))
    signals = (F.col("cosine") > 0.35).cast("int") + (F.col("jaccard") > 0.12).cast("int") + F.coalesce((F.col("spearman") > 0.3).cast("int"), F.lit(0))
    verdict = F.when((F.col("shared") < 3) | (signals == 0), "UNSUPPORTED").when(signals == 1, "WEAK").when(signals == 2, "MODERATE").otherwise("STRONG")
    return out.withColumn("verdict", verdict)


def partners(similarity: DataFrame, top: int = 4) -> DataFrame:
    """Each group's closest others by cosine: grp, partner, cosine, position."""
    both = similarity.select(F.col("a").alias("grp"), F.col("b").alias("partner"), "cosine").union(similarity.select("b", "a", "cosine"))
    return both.withColumn("position", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("cosine"), "partner"))).where(F.col("position") <= top)
