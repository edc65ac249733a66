"""Deterministic splits by hash order, leakage checks, connected components, nested samples.

The order of a group is the SHA-256 of "seed:key". Running totals over all groups do not pass through one task: groups are counted by
the hash's first four digits, the 65,536 counts are summed up, and only the groups of one such range are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from varnika.session import cut


def hash_order(seed: int, key: Column | str) -> Column:
    """The hex digits by which a key is ordered."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key) if isinstance(key, str) else key), 256)


def swap_bit(seed: int, key: str) -> Column:
    """Whether the first byte of the hash of "seed:key:swap" is odd."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key), F.lit(":swap")), 256), 1, 2), 16, 10).cast("int") % 2 == 1


def running_total(groups: DataFrame, order: str, value: Column, name: str = "before") -> DataFrame:
    """groups with the sum of value over all groups whose order (a hex hash, unique) is smaller."""
    groups = groups.withColumn("__p", F.substring(order, 1, 4)).withColumn("__v", value)
    parts = groups.groupBy("__p").agg(F.sum("__v").alias("__s"))
    starts = parts.select("__p", (F.sum("__s").over(W.orderBy("__p")) - F.col("__s")).alias("__start"))
    own = F.coalesce(F.sum("__v").over(W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + own).drop("__p", "__v", "__start")


def ordered_split(df: DataFrame, group: str, row_id: str, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """df with split: whole groups in hash order fill train, then validation, then test. A null or empty group is the row's own id.

    Closed form of the fill: a group goes to train while the rows before it are fewer than round(N * train), halves to even; then to
    validation while the rows before it, less those in train, are fewer than round(N * validation). An empty table gives no rows.
    """
    keyed = df.withColumn("__g", F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.col(row_id).cast("string")))
    groups = keyed.groupBy("__g").agg(F.count("*").alias("__n")).withColumn("__h", hash_order(seed, "__g"))
    groups = running_total(groups, "__h", F.col("__n"))
    total = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total"))
    groups = groups.crossJoin(F.broadcast(total)).withColumn("__train", F.col("before") < F.bround(F.col("__total") * F.lit(train)))
    taken = groups.agg(F.coalesce(F.sum(F.when(F.col("__train"), F.col("__n"))), F.lit(0)).alias("__taken"))
    groups = groups.crossJoin(F.broadcast(taken))
    split = F.when(F.col("__train"), "train").when(F.col("before") - F.col("__taken") < F.bround(F.col("__total") * F.lit(validation)), "validation").otherwise("test")
    return keyed.join(groups.select("__g", split.alias("__split")), "__g").drop("split", "__g").withColumnRenamed("__split", "split")


def split_counts(df: DataFrame) -> DataFrame:
    """split, n for all three splits, also those without rows."""
    names = df.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    return names.join(df.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def partition_groups(groups: DataFrame, name: str, forced: str, seed: int = 42, development: float = 0.5, validation: float = 0.25) -> DataFrame:
    """groups (one row each; forced: boolean) with part: by number of groups in hash order; a forced group goes to development at its
    own place in the order; groups at places before round(G * development) go to development, the next ones not forced to validation
    up to round(G * validation), the others to test."""
    ordered = running_total(groups.withColumn("__h", hash_order(seed, name)), "__h", F.lit(1), "place")
    total = ordered.agg(F.count("*").alias("__g"))
    ordered = ordered.crossJoin(F.broadcast(total)).withColumn("__t", F.bround(F.col("__g") * F.lit(development)))
    late = (~F.col(forced)) & (F.col("place") >= F.col("__t"))
    ordered = running_total(ordered, "__h", late.cast("int"), "__late")
    part = F.when(F.col(forced) | (F.col("place") < F.col("__t")), "development").when(F.col("__late") < F.bround(F.col("__g") * F.lit(validation)), "validation").otherwise("test")
    return ordered.withColumn("part", part).drop("__h", "__g", "__t", "__late")


def nested_samples(df: DataFrame, key: str, sizes: tuple[int, ...], seed: int = 42) -> DataFrame:
    """A row per size and member: the first k rows in hash order for each k, so each sample holds the smaller ones."""
    top = df.withColumn("__h", hash_order(seed, key)).orderBy("__h").limit(max(sizes))
    ranked = top.withColumn("position", F.row_number().over(W.orderBy("__h"))).drop("__h")
    return ranked.withColumn("size", F.explode(F.array(*[F.lit(k) for k in sizes]))).where("position <= size")


def skipped_sizes(teaching: DataFrame, sizes: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """(sizes that the teaching rows allow, those skipped)."""
    n = teaching.count()
    return [k for k in sizes if k <= n], [k for k in sizes if k > n]


def leakage(teaching: DataFrame, held_out: DataFrame, fields: tuple[str, ...] = ("id", "anchor_text", "target_text")) -> DataFrame:
    """field, shared (how many values stand in both), example (the smallest) for each field."""
    out = None
    for f in fields:
        both = teaching.select(F.col(f).alias("v")).join(held_out.select(F.col(f).alias("v")), "v", "left_semi").where("v is not null")
        row = both.agg(F.lit(f).alias("field"), F.count_distinct("v").alias("shared"), F.min("v").alias("example"))
        out = row if out is None else out.unionByName(row)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) of an undirected graph, by large-star and small-star steps.

    Each step joins neighbours to the smallest node known; the lineage is cut after each round. Nodes without edges do not appear.
    Raises if it is not settled after so many rounds (each at least halves long paths).
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small.where("u > v").union(small.where("u < v").select("v", "u")).distinct())
        changed = small.exceptAll(now).limit(1).count() + now.exceptAll(small).limit(1).count()
        now = small
        if not changed:
            parents = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            return parents.union(roots).groupBy("node").agg(F.min("component").alias("component"))
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def class_split(df: DataFrame, group: str, label: str, row_id: str, seed: int = 42, least: int = 15) -> DataFrame:
    """df with split: whole groups in hash order at about 60/20/20; a label with fewer than ``least`` test or validation rows is split
    by row instead (by_group false)."""
    by_group = ordered_split(df.withColumnRenamed("split", "__old") if "split" in df.columns else df, group, row_id, seed, 0.6, 0.2)
    per = by_group.groupBy(label).agg(F.count_if(F.col("split") == "test").alias("__t"), F.count_if(F.col("split") == "validation").alias("__v"))
    flagged = by_group.join(per, label).withColumn("by_group", (F.col("__t") >= least) & (F.col("__v") >= least)).drop("__t", "__v")
    h = hash_order(seed, F.col(row_id).cast("string"))
    share = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    by_row = F.when(share < 0.6, "train").when(share < 0.8, "validation").otherwise("test")
    return flagged.withColumn("split", F.when(F.col("by_group"), F.col("split")).otherwise(by_row))
