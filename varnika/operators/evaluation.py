"""Evaluating a classifier's predictions: accuracy, calibration, thresholds, lengths, confusion, two-level recall, stability.

Input rows: true, pred, p (confidence of pred), and where needed second, family columns, grp, seed, n_words. Nulls in true or pred
count as wrong; null confidences count in no bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LENGTHS = ((1, 3), (4, 6), (7, 10), (11, 20), (21, 1000))


def _right() -> Column:
    return F.coalesce(F.col("true") == F.col("pred"), F.lit(False))


def _top2(df: DataFrame) -> Column:
    return _right() | F.coalesce(F.col("true") == F.col("second"), F.lit(False)) if "second" in df.columns else _right()


def _family(families: dict[str, str] | None) -> Column:
    """Whether true and pred are of one family; a label without family is its own."""
    name = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col(c)], F.col(c)) if families else F.col(c)
    return F.coalesce(name("true") == name("pred"), F.lit(False))


def accuracy(df: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """n, accuracy, top2 (true is pred or second), family (true and pred are of one family)."""
    return df.agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in (("accuracy", _right()), ("top2", _top2(df)), ("family", _family(families)))])


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy per equal-width bin of p; p = 1 is in the last bin."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return df.where("p is not null").groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(_right().cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps between confidence and accuracy, weighted by their rows."""
    per = calibration_bins(df, bins)
    return per.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def threshold_curve(df: DataFrame) -> DataFrame:
    """For the thresholds 0.05 to 0.95: kept, coverage, false_confident (share of the kept that are wrong; null if none are kept).

    Rows are first counted by the number of thresholds they reach, so the join with the nineteen thresholds is on twenty rows.
    """
    reached = F.aggregate(F.array(*[(F.col("p") >= F.lit(k * 0.05)).cast("int") for k in range(1, 20)]), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    per = df.groupBy(reached.alias("k")).agg(F.count("*").alias("n"), F.count_if(~_right()).alias("wrong"))
    grid = df.sparkSession.createDataFrame([(k, round(k * 0.05, 2)) for k in range(1, 20)], "i int, threshold double")
    hit = F.col("k") >= F.col("i")
    out = per.join(F.broadcast(grid), F.lit(True)).groupBy("threshold").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(hit, F.col("wrong")).otherwise(0)).alias("wrong"), F.sum("n").alias("every"))
    return out.select("threshold", "kept", (F.col("kept") / F.col("every")).alias("coverage"), F.expr("wrong / nullif(kept, 0)").alias("false_confident"))


def recommended_thresholds(curve: DataFrame, limits: tuple[float, ...] = (0.05, 0.10, 0.15)) -> DataFrame:
    """For each limit the smallest threshold whose false_confident is at most the limit, with its coverage; null if there is none."""
    grid = curve.sparkSession.createDataFrame([(x,) for x in limits], "at_most double")
    ok = F.col("false_confident") <= F.col("at_most")
    return grid.join(F.broadcast(curve), F.lit(True)).groupBy("at_most").agg(F.min(F.when(ok, F.col("threshold"))).alias("threshold"), F.min_by(F.when(ok, F.col("coverage")), F.when(ok, F.col("threshold"))).alias("coverage"))


def accuracy_by_length(df: DataFrame) -> DataFrame:
    """length (as 1-3), n, accuracy; rows outside all ranges are left out."""
    name = F.lit(None).cast("string")
    for a, b in reversed(LENGTHS):
        name = F.when(F.col("n_words").between(a, b), f"{a}-{b}").otherwise(name)
    return df.withColumn("length", name).where("length is not null").groupBy("length").agg(F.count("*").alias("n"), F.avg(_right().cast("double")).alias("accuracy"))


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """A row per true label, a column per predicted one, in the given order; 0 where none."""
    return df.where(F.col("true").isin(labels)).groupBy("true").pivot("pred", labels).count().na.fill(0)


def class_report(df: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; 0 where a denominator is 0."""
    rows = df.select(F.col("true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), _right().cast("int").alias("h")).union(df.select("pred", F.lit(0), F.lit(1), F.lit(0)))
    per = rows.where("label is not null").groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("h"), F.col("p")), ratio(F.col("h"), F.col("t"))
    return per.select("label", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), F.col("t").alias("support"))


def class_summary(df: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """Per true label: n, recall, top2, family, mean confidence when right and when wrong."""
    return df.groupBy("true").agg(F.count("*").alias("n"), F.avg(_right().cast("double")).alias("recall"), F.avg(_top2(df).cast("double")).alias("top2"), F.avg(_family(families).cast("double")).alias("family"), F.avg(F.when(_right(), F.col("p"))).alias("confidence_right"), F.avg(F.when(~_right(), F.col("p"))).alias("confidence_wrong"))


def balanced_recall(df: DataFrame) -> DataFrame:
    """Per true label: recall over rows, mean of its groups' recalls, their gap, share of the largest group."""
    per = df.groupBy("true", "grp").agg(F.count("*").alias("n"), F.avg(_right().cast("double")).alias("r"))
    out = per.groupBy("true").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), (F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("row_recall"), F.avg("r").alias("group_recall"), (F.max("n") / F.sum("n")).alias("largest_share"))
    return out.withColumn("gap", F.col("row_recall") - F.col("group_recall"))


def seed_stability(df: DataFrame) -> DataFrame:
    """Per true label the recalls over the seeds: mean, median, lowest, highest, spread and a verdict (over .20 UNSTABLE, over .10 borderline, else stable)."""
    per = df.groupBy("true", "seed").agg(F.avg(_right().cast("double")).alias("r"))
    out = per.groupBy("true").agg(F.count("*").alias("seeds"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.min("r").alias("lowest"), F.max("r").alias("highest"))
    spread = F.col("highest") - F.col("lowest")
    return out.withColumn("spread", spread).withColumn("verdict", F.when(spread > 0.20, "UNSTABLE").when(spread > 0.10, "borderline").otherwise("stable"))


def group_sizes(df: DataFrame, label: str, grp: str) -> DataFrame:
    """Per label: rows, groups, rows per group, and how far group splits can be trusted (3 groups or fewer SEVERE, 8 or fewer WEAK, else OK)."""
    per = df.groupBy(label).agg(F.count("*").alias("rows"), F.count_distinct(grp).alias("groups"))
    severity = F.when(F.col("groups") <= 3, "SEVERE").when(F.col("groups") <= 8, "WEAK").otherwise("OK")
    return per.withColumn("rows_per_group", F.expr("rows / nullif(groups, 0)")).withColumn("severity", severity)


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of hits among n; null for n = 0."""
    p = F.try_divide(hits, n)
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def wilson_gate(fates: DataFrame) -> DataFrame:
    """fates: word, fate. Per word its places, most frequent fate, bound, class and the entropy of its fates (bits).

    Fewer than 50 places INSUFFICIENT; a deletion is never safe; bound .75 and 100 places SAFE_AUTOCORRECT; bound .70 SAFE_CANDIDATE;
    else AMBIGUOUS. Ties between fates go to the one first in order.
    """
    counted = fates.groupBy("word", "fate").agg(F.count("*").alias("n"))
    total = counted.groupBy("word").agg(F.sum("n").alias("places"), F.count("*").alias("outcomes"), F.max("n").alias("top"), F.min_by("fate", F.struct(-F.col("n"), F.col("fate"))).alias("fate"))
    per = counted.join(total.select("word", "places"), "word").withColumn("q", F.col("n") / F.col("places")).groupBy("word").agg(F.sum(-F.col("q") * F.log2("q")).alias("entropy"))
    bound = wilson_lower(F.col("top").cast("double"), F.col("places").cast("double"))
    kind = F.when(F.col("places") < 50, "INSUFFICIENT").when(F.col("fate") == "DELETED", "AMBIGUOUS").when((bound >= 0.75) & (F.col("places") >= 100), "SAFE_AUTOCORRECT").when(bound >= 0.70, "SAFE_CANDIDATE").otherwise("AMBIGUOUS")
    return total.join(per, "word").select("word", "places", "outcomes", "fate", "top", bound.alias("bound"), kind.alias("class"), "entropy")


def named_language(df: DataFrame, fallback: str = "hindi", exempt: tuple[str, ...] = ("hindi", "english")) -> DataFrame:
    """df: truth (name of a language), detected (what an answer calls it). Per truth: n, exact (the name stands in it), fallback (the
    common language is named instead, for a truth that isn't exempt), wrong (all else, nulls too)."""
    told, truth = F.lower(F.trim(F.coalesce("detected", F.lit("")))), F.lower("truth")
    exact = F.contains(told, truth)
    common = ~exact & F.contains(told, F.lit(fallback)) & ~truth.isin(*exempt)
    return df.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(exact).alias("exact"), F.count_if(common).alias("fallback"), F.count_if(~exact & ~common).alias("wrong"))
