"""Consensus from several annotators' labels, assisted by features of the items.

Expectation-maximisation over three parts: a confusion matrix for each rater (smoothed towards a careful rater), a regularised
softmax classifier from item features to choices, whose output is the prior of the item's label, and the posterior of each item's
label. The features ask how well each option renders its anchor text: words of the option that go with no word of the anchor
(intruders, damaged words), words of the anchor that go with none of the option (omissions), doubled letters. "Goes with" is learned
from the items themselves: pointwise mutual information of anchor word and option word over all items.

What an iteration needs are the raters' matrices and the classifier's weights: posteriors follow from them. So each item is written
once with its ratings (a rater counts once for an item), and an iteration is one pass over the items with the parameters broadcast,
without a shuffle of items or ratings: tasks return sums by rater and the classifier's gradient and curvature. It ends when the
likelihood of an item grows by less than ``SETTLED``. This holds up to ``MAX_RATERS`` raters (16 numbers each); beyond, raters stay
distributed too, and an iteration is two joins and two sums with partial sums first. Either way one rater with a third of all ratings
is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varnika.functions.text import plain
from varnika.session import cut, table, written

CHOICES = ("1", "2", "tie", "both_bad")
#: Iterations at most, and the growth of the mean log-likelihood of an item at which they end.
ITERATIONS, SETTLED = 40, 1e-5
#: Raters whose matrices are broadcast.
MAX_RATERS = 50_000
#: A pair of words goes together at this pointwise mutual information (natural logarithm).
TOGETHER = 1.2
RIDGE = 1.0
#: Pseudo-ratings of a careful rater: on the diagonal, elsewhere.
DIAGONAL, ELSEWHERE = 2.0, 0.5
SIDES = ("intruders", "omissions", "rare", "doubled", "length")


def clean_choice(c: Column) -> Column:
    """One of CHOICES, whatever the case, white space, hyphen or underscore; else null."""
    bare = F.lower(F.regexp_replace(c, r"(?U)[\s_\-]+", ""))
    return F.when(bare == "bothbad", "both_bad").when(bare.isin("1", "2", "tie"), bare)


def latest(ratings: DataFrame) -> DataFrame:
    """item_id, rater_id, c (number of the choice): the latest valid rating of each rater and item; of equally late ones the first in CHOICES."""
    c = clean_choice(F.col("choice"))
    number = F.when(c == "1", 0).when(c == "2", 1).when(c == "tie", 2).when(c == "both_bad", 3)
    rows = ratings.select("item_id", "rater_id", number.alias("c"), "rated_at").where("item_id is not null and rater_id is not null and c is not null")
    return rows.groupBy("item_id", "rater_id").agg(F.max_by("c", F.struct(F.coalesce("rated_at", F.lit("1900-01-01").cast("timestamp_ntz") if dict(rows.dtypes)["rated_at"] == "timestamp_ntz" else F.lit("1900-01-01").cast("timestamp")), -F.col("c"))).alias("c"))


def item_features(key: DataFrame) -> DataFrame:
    """item_id, x (array of numbers) for each item of the key: for both options SIDES, their differences and the worse and better of both."""
    first = key.where("item_id is not null").groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("anchor_text", "option_1", "option_2")])
    bags = written(
        first.select("item_id", F.array_distinct(F.split(plain("anchor_text"), " ")).alias("a"), F.split(plain("option_1"), " ").alias("o1"), F.split(plain("option_2"), " ").alias("o2"))
    )
    long = bags.select("item_id", "a", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("o1").alias("o")), F.struct(F.lit(2).alias("k"), F.col("o2").alias("o")))).alias("s")).select("item_id", "a", "s.k", "s.o")
    words = long.select("item_id", "k", "a", F.explode(F.array_distinct("o")).alias("w"))
    pairs = words.select("item_id", "k", "w", F.explode("a").alias("v"))
    n = F.lit(float(max(1, bags.count() * 2)))
    n_pair = pairs.groupBy("v", "w").agg(F.count("*").alias("n_vw"))
    n_w = words.groupBy("w").agg(F.count("*").alias("n_w"))
    n_v = long.select(F.explode("a").alias("v")).groupBy("v").agg(F.count("*").alias("n_v"))
    together = written(
        n_pair.join(n_w, "w").join(n_v, "v").withColumn("pmi", F.log(F.col("n_vw") * n / (F.col("n_v") * F.col("n_w")))).where((F.col("v") == F.col("w")) | ((F.col("pmi") > TOGETHER) & (F.col("n_vw") >= 3) & (F.col("n_vw") * 4 >= F.col("n_w")))).select("v", "w")
    )
    linked = pairs.join(together, ["v", "w"]).groupBy("item_id", "k").agg(F.count_distinct("w").alias("fit_w"), F.count_distinct("v").alias("fit_v"))
    rare = words.join(n_w.where("n_w <= 2"), "w").where(~F.array_contains("a", F.col("w"))).groupBy("item_id", "k").agg(F.count("*").alias("rare"))
    sides = (
        long.join(linked, ["item_id", "k"], "left")
        .join(rare, ["item_id", "k"], "left")
        .select(
            "item_id",
            "k",
            (F.size(F.array_distinct("o")) - F.coalesce("fit_w", F.lit(0))).alias("intruders"),
            (F.size("a") - F.coalesce("fit_v", F.lit(0))).alias("omissions"),
            F.coalesce("rare", F.lit(0)).alias("rare"),
            F.regexp_count(F.concat_ws(" ", "o"), F.lit(r"([^\d\s])\1")).alias("doubled"),
            (F.size("o") - F.size("a")).alias("length"),
        )
    )
    flat = sides.groupBy("item_id").agg(*[F.max(F.when(F.col("k") == k, F.col(c)).cast("double")).alias(f"{c}{k}") for c in SIDES for k in (1, 2)])
    a, b = (lambda c: F.col(f"{c}1")), (lambda c: F.col(f"{c}2"))
    total = lambda s: sum((s(c) for c in SIDES[:4]), F.lit(0.0))
    gap = total(a) - total(b)
    x = [a(c) - b(c) for c in SIDES] + [F.least(a(c), b(c)) for c in SIDES[:4]] + [gap, F.abs(gap), F.least(total(a), total(b)), F.greatest(total(a), total(b)), (gap == 0).cast("double"), F.signum(gap)]
    return flat.select("item_id", F.array(*x).alias("x"))


WIDTH = 5 + 4 + 6


def _standard(x: DataFrame) -> DataFrame:
    """x with mean 0 and deviation 1 of each feature, and a constant."""
    row = x.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(WIDTH) for f in (F.avg, F.stddev_pop)]).first()
    scaled = [(F.col("x")[i] - (row[f"avg{i}"] or 0.0)) / ((row[f"stddev_pop{i}"] or 0.0) or 1.0) for i in range(WIDTH)]
    return x.select("item_id", F.array(*scaled, F.lit(1.0)).alias("x"))


def _newton(items: DataFrame, w: np.ndarray) -> np.ndarray:
    """One Newton step of the softmax classifier towards the posteriors."""
    p, k = w.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(p * k + (p * k) ** 2)
        for b in batches:
            x, t = np.stack(b["x"]), np.stack(b["post"])
            s = x @ w
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            grad = x.T @ (t - s)
            hess = np.zeros((k, p, k, p))
            for i in range(k):
                for j in range(k):
                    hess[i, :, j, :] = (x * (s[:, i] * ((i == j) - s[:, j]))[:, None]).T @ x
            total += np.concatenate([grad.T.ravel(), hess.ravel()])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = items.select("x", "post").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(p * k + (p * k) ** 2)
    total[got["i"]] = got["v"]
    grad, hess = total[: p * k] - RIDGE * w.T.ravel(), total[p * k :].reshape(p * k, p * k) + RIDGE * np.eye(p * k)
    return w + np.clip(np.linalg.solve(hess, grad), -2, 2).reshape(k, p).T


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


class Parameters:
    """The raters' confusion matrices and the classifier; None where there are none yet: posteriors are then the smoothed counts."""

    def __init__(self, raters: int) -> None:
        self.logs: np.ndarray | None = None  # (raters, true, given)
        self.w = np.zeros((WIDTH + 1, 4))
        self.raters = raters

    def posteriors(self, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """(posteriors, features, owner, rater and choice of each rating, log-likelihood) of a batch of items."""
        x = np.stack(b["x"])
        size = b["r"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(b)), size)
        r, c = (np.concatenate([np.asarray(v, dtype=np.int64) for v in b[k]]) for k in "rc")
        if self.logs is None:
            given = np.bincount(owner * 4 + c, minlength=4 * len(b)).reshape(-1, 4)
            return (given + 0.25) / (size[:, None] + 1.0), x, owner, r, c, -np.inf
        prior = x @ self.w
        prior -= np.logaddexp.reduce(prior, axis=1, keepdims=True)
        each = self.logs[r, :, c]
        like = np.stack([np.bincount(owner, weights=each[:, t], minlength=len(b)) for t in range(4)], axis=1)
        return _softmax(prior + like), x, owner, r, c, float(np.logaddexp.reduce(prior + like, axis=1).sum())

    def sums(self, batches: Iterator[pd.DataFrame]) -> np.ndarray:
        """Sums over items: by rater, true and given choice; gradient and curvature of the classifier; log-likelihood; items."""
        p, k = self.w.shape
        seen, grad, hess, total = np.zeros(self.raters * 16), np.zeros((k, p)), np.zeros((k, p, k, p)), np.zeros(2)
        for b in batches:
            post, x, owner, r, c, like = self.posteriors(b)
            for t in range(4):
                seen += np.bincount(r * 16 + t * 4 + c, weights=post[owner, t], minlength=len(seen))
            s = _softmax(x @ self.w)
            grad += (x.T @ (post - s)).T
            for i in range(k):
                for j in range(k):
                    hess[i, :, j, :] += (x * (s[:, i] * ((i == j) - s[:, j]))[:, None]).T @ x
            total += like, len(b)
        return np.concatenate([seen, grad.ravel(), hess.ravel(), total])

    def updated(self, sums: np.ndarray) -> Parameters:
        """The parameters after one step: matrices from the sums, one Newton step of the classifier."""
        n, (p, k) = self.raters * 16, self.w.shape
        out = Parameters(self.raters)
        cells = sums[:n].reshape(-1, 4, 4) + np.where(np.eye(4) > 0, DIAGONAL, ELSEWHERE)
        out.logs = np.log(cells / cells.sum(axis=2, keepdims=True))
        grad, hess = sums[n : n + p * k] - RIDGE * self.w.T.ravel(), sums[n + p * k : n + p * k + (p * k) ** 2].reshape(p * k, p * k) + RIDGE * np.eye(p * k)
        out.w = self.w + np.clip(np.linalg.solve(hess, grad), -2, 2).reshape(k, p).T
        return out


def _pass(items: DataFrame, parameters: Parameters) -> np.ndarray:
    """Parameters.sums() over all items: added up by place, one row per place and task."""
    shared = items.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value.sums(batches)
        at = np.flatnonzero(v)
        yield pd.DataFrame({"i": at, "v": v[at]})

    n = parameters.raters * 16 + parameters.w.size + parameters.w.size**2 + 2
    out = np.zeros(n)
    got = items.select("x", "r", "c").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out[got["i"]] = got["v"]
    shared.unpersist()
    return out


def consensus(ratings: DataFrame, key: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, raters).

    items: item_id, choice, confidence (posterior), ratings (valid ones that count), agreement (share of pairs of raters that agree;
    null for fewer than two). raters: rater_id, ratings, reliability (expected share of right labels).

    Unusable or null choices are no ratings; an item with none gets the classifier's choice and 0 ratings; ties of the posterior go to
    the first in CHOICES; items without a row in the key have average features; an empty table gives no rows.
    """
    votes = written(latest(ratings))
    ids = ratings.select("item_id").where("item_id is not null")
    if key is not None:
        ids = ids.union(key.select("item_id").where("item_id is not null"))
    zero = F.array(*[F.lit(0.0)] * WIDTH, F.lit(1.0))
    base = ids.distinct()
    if key is None:
        base = base.withColumn("x", zero)
    else:
        base = base.join(_standard(written(item_features(key))), "item_id", "left").withColumn("x", F.coalesce("x", zero))
    names = [r.rater_id for r in votes.select("rater_id").distinct().limit(MAX_RATERS + 1).collect()]
    if len(names) > MAX_RATERS:
        return _distributed(votes, base)
    spark = ratings.sparkSession
    names.sort()
    numbers = spark.createDataFrame(list(zip(names, range(len(names)))), "rater_id string, r int")
    ballots = votes.join(F.broadcast(numbers), "rater_id").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("r", "c"))).alias("b"))
    empty = F.array().cast("array<int>")
    items = written(base.join(ballots, "item_id", "left").select("item_id", "x", *[F.coalesce(F.col(f"b.{k}"), empty).alias(k) for k in "rc"]))
    now, before, sums = Parameters(len(names)), -np.inf, None
    for _ in range(ITERATIONS):
        sums = _pass(items, now)
        like = sums[-2] / max(1.0, sums[-1])
        if np.isfinite(before) and like - before < SETTLED:
            break
        now, before = now.updated(sums), like
    shared = spark.sparkContext.broadcast(now)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            post, _, owner, _, c, _ = shared.value.posteriors(b)
            given = np.bincount(owner * 4 + c, minlength=4 * len(b)).reshape(-1, 4)
            n = given.sum(axis=1)
            agree = np.where(n > 1, (given * (given - 1)).sum(axis=1) / np.maximum(1, n * (n - 1)), np.nan)
            yield pd.DataFrame({"item_id": b["item_id"], "choice": np.array(CHOICES)[post.argmax(axis=1)], "confidence": post.max(axis=1), "ratings": n, "agreement": pd.Series(agree).astype(object).where(n > 1, None)})

    out = items.mapInPandas(label, "item_id string, choice string, confidence double, ratings long, agreement double")
    seen = (sums if sums is not None else np.zeros(0))[: len(names) * 16].reshape(-1, 4, 4)
    right = [(name, int(round(m.sum())), float(np.trace(m) / max(m.sum(), 1e-300))) for name, m in zip(names, seen)]
    return out, spark.createDataFrame(right, "rater_id string, ratings long, reliability double")


def _distributed(votes: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with more raters than fit a broadcast: matrices and posteriors are tables, the lineage is cut after each iteration."""
    counts = votes.groupBy("item_id").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(4)])
    n = sum((F.coalesce(f"n{k}", F.lit(0)) for k in range(4)), F.lit(0))
    start = F.array(*[(F.coalesce(f"n{k}", F.lit(0)) + 0.25) / (n + 1.0) for k in range(4)])
    base = written(base.join(counts, "item_id", "left").withColumn("post", start))
    items, w = base, np.zeros((WIDTH + 1, 4))
    fixed = base.drop("post")
    for _ in range(ITERATIONS):
        w = _newton(items, w)
        sums = votes.join(items.select("item_id", "post"), "item_id").groupBy("rater_id").agg(*[F.sum(F.when(F.col("c") == g, F.col("post")[t]).otherwise(0.0)).alias(f"s{t}{g}") for t in range(4) for g in range(4)])
        cell = lambda t, g: F.col(f"s{t}{g}") + (DIAGONAL if t == g else ELSEWHERE)
        rows = {t: sum((cell(t, g) for g in range(4)), F.lit(0.0)) for t in range(4)}
        logs = sums.select("rater_id", F.array(*[F.log(cell(t, g) / rows[t]) for g in range(4) for t in range(4)]).alias("conf"))
        said = votes.join(logs, "rater_id").groupBy("item_id").agg(*[F.sum(F.get("conf", F.col("c") * 4 + t)).alias(f"l{t}") for t in range(4)])
        prior = [sum((F.col("x")[i] * float(w[i, t]) for i in range(WIDTH + 1)), F.lit(0.0)) for t in range(4)]
        joined = fixed.join(said, "item_id", "left").select(*fixed.columns, F.array(*[F.coalesce(f"l{t}", F.lit(0.0)) + prior[t] for t in range(4)]).alias("l"))
        joined = joined.withColumn("l", F.expr("transform(l, v -> exp(v - array_max(l)))"))
        last, items = items, cut(joined.select(*fixed.columns, F.expr("transform(l, v -> v / aggregate(l, 0D, (a, b) -> a + b))").alias("post")))
        moved = items.select("item_id", F.col("post").alias("p")).join(last.select("item_id", "post"), "item_id").agg(F.max(F.expr("aggregate(zip_with(p, post, (a, b) -> abs(a - b)), 0D, (a, b) -> a + b)"))).first()[0]
        if (moved or 0.0) < 1e-3:
            break
    best = F.array_position("post", F.array_max("post"))
    pairs = sum((F.coalesce(f"n{k}", F.lit(0)) * (F.coalesce(f"n{k}", F.lit(0)) - 1) for k in range(4)), F.lit(0))
    out = items.select(
        "item_id",
        F.element_at(F.array(*[F.lit(c) for c in CHOICES]), best.cast("int")).alias("choice"),
        F.array_max("post").alias("confidence"),
        n.cast("long").alias("ratings"),
        F.when(n > 1, pairs / (n * (n - 1))).alias("agreement"),
    )
    right = votes.join(items.select("item_id", "post"), "item_id").groupBy("rater_id").agg(F.count("*").alias("ratings"), F.avg(F.get("post", F.col("c"))).alias("reliability"))
    return out, right


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Every item's right choice."""
    return consensus(table(spark, sf_dir, "rating_records"), table(spark, sf_dir, "rating_key"))[0].select("item_id", "choice")


def p6_raters(spark, sf_dir: str) -> DataFrame:
    """Every rater's number of ratings and reliability."""
    return consensus(table(spark, sf_dir, "rating_records"), table(spark, sf_dir, "rating_key"))[1]


QUERIES = {"p6_found": p6_found, "p6_raters": p6_raters}
SQL: dict[str, str] = {}
