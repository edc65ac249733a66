"""A variety classifier on word and character n-grams: features, balanced logistic regression, calibration, leave-one-group-out.

Everything stays in Spark ML; the smoothed inverse document frequency ln((1 + n) / (1 + df)) + 1 is Spark's own plus 1, by which the
counts are scaled. Folds and seeds are independent models: a few are trained at a time, and each one's predictions are written before
the next, so neither plans nor models pile up on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from varnika.functions.text import devanagari_words
from varnika.operators import splits
from varnika.session import written

#: Rows of a training task at least: small tables train in few tasks, as every step of the optimiser is a job.
TASK_ROWS = 5_000
#: Models trained at a time.
AT_ONCE = 4
WORDS = "concat(ws, transform(slice(ws, 1, greatest(size(ws) - 1, 0)), (x, i) -> concat(x, ' ', ws[i + 1])))"
CHARS = "flatten(transform(array(3, 4), n -> if(length(text) < n, array(), transform(sequence(1, greatest(length(text) - n + 1, 1)), i -> substring(text, i, n)))))"


def feature_stages(train: DataFrame, mode: str = "combined", least: int = 2, char_features: int = 30_000) -> list[Transformer]:
    """Fitted stages from a column text (and ws, its words) to features. mode: word (1- and 2-grams), char (3- and 4-grams) or combined.

    An n-gram needs so many rows of the training table; each part of the features has length 1.
    """
    out, parts = [], []
    for name, grams, size in (("word", WORDS, 1 << 18), ("char", CHARS, char_features)):
        if mode in (name, "combined"):
            cut = SQLTransformer(statement=f"SELECT *, {grams} AS {name}_grams FROM __THIS__")
            rows = cut.transform(train)
            count = CountVectorizer(inputCol=f"{name}_grams", outputCol=f"{name}_tf", minDF=float(least), vocabSize=size).fit(rows)
            idf = IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf").fit(count.transform(rows)).idf.toArray()
            out += [cut, count, ElementwiseProduct(inputCol=f"{name}_tf", outputCol=f"{name}_scaled", scalingVec=Vectors.dense(idf + 1)), Normalizer(inputCol=f"{name}_scaled", outputCol=f"{name}_unit", p=2.0)]
            parts.append(f"{name}_unit")
    return [*out, VectorAssembler(inputCols=parts, outputCol="features")]


def prepared(df: DataFrame, text: str, label: str) -> DataFrame:
    """text, ws, label and a weight that makes all labels count alike; rows without text or label are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).withColumn("text", F.col(text)).withColumn("ws", devanagari_words(text)).withColumn("label", F.col(label))
    n = rows.groupBy("label").agg(F.count("*").alias("__n"))
    every = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(n), "label").crossJoin(F.broadcast(every)).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def fit(train: DataFrame, mode: str = "combined", c: float = 1.0, steps: int = 100) -> PipelineModel:
    """Multinomial logistic regression with balanced weights; the ridge is 1 / (c times the sum of weights)."""
    total, n = train.agg(F.coalesce(F.sum("weight"), F.lit(1.0)), F.count("*")).first()
    train = train.coalesce(max(1, n // TASK_ROWS))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    stages = [index, *feature_stages(train, mode)]
    model = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / (c * total), maxIter=steps)
    return PipelineModel([*stages, model.fit(PipelineModel(stages).transform(train).select("y", "weight", "features"))])


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with true, pred, second, p, margin and probs (in the order of labels)."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.transform(rows).withColumn("probs", F.slice(vector_to_array("probability"), 1, len(model.stages[0].labels)))
    ranked = F.reverse(F.array_sort(F.transform(F.arrays_zip("probs", names.alias("name")), lambda x: F.struct(x["probs"].alias("p"), x["name"].alias("name")))))
    out = out.withColumn("__r", ranked)
    return out.select(*rows.columns, F.col("label").alias("true"), F.col("__r")[0]["name"].alias("pred"), F.get("__r", F.lit(1))["name"].alias("second"), F.col("__r")[0]["p"].alias("p"), (F.col("__r")[0]["p"] - F.coalesce(F.get("__r", F.lit(1))["p"], F.lit(0.0))).alias("margin"), "probs")


def best_mode(train: DataFrame, validation: DataFrame, modes: tuple[str, ...] = ("word", "char", "combined"), steps: int = 100) -> tuple[str, PipelineModel]:
    """The mode with the highest accuracy on the validation rows (of equal ones the first)."""
    scored = []
    for m in modes:
        model = fit(train, m, steps=steps)
        scored.append((predictions(model, validation).agg(F.avg((F.col("true") == F.col("pred")).cast("double"))).first()[0] or 0.0, m, model))
    top = max(scored, key=lambda x: x[0])
    return top[1], top[2]


def calibrated(validation: DataFrame, test: DataFrame, labels: list[str]) -> DataFrame:
    """test predictions with pred and p after isotonic calibration of each label against the rest, fitted on the validation
    predictions and made to add up to 1; a row whose calibrated values are all 0 keeps its own."""
    steps = []
    for i, name in enumerate(labels):
        rows = validation.select((F.col("true") == name).cast("double").alias("y"), F.col("probs")[i].alias("x"), F.lit(1.0).alias("w"))
        m = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(rows)
        steps.append((np.array(m.boundaries.toArray()), np.array(m.predictions.toArray())))
    shared = test.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("array<double>")
    def apply(probs):
        out = []
        for v in probs:
            q = np.array([np.interp(x, *shared.value[i]) for i, x in enumerate(v)])
            out.append((q / q.sum() if q.sum() > 0 else np.asarray(v)).tolist())
        return pd.Series(out)

    names = F.array(*[F.lit(x) for x in labels])
    out = test.withColumn("probs", apply("probs"))
    return out.withColumn("p", F.array_max("probs")).withColumn("pred", F.element_at(names, F.array_position("probs", F.col("p")).cast("int")))


def _each(make: Callable, items: list) -> DataFrame:
    """The written results of make for all items, AT_ONCE at a time."""
    with ThreadPool(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(lambda x: written(make(x)), items))


def leave_one_group_out(rows: DataFrame, label: str, grp: str, folds: list[tuple[str, str]], mode: str = "word", steps: int = 100) -> DataFrame:
    """For each fold (label, group): predictions of its rows by a model trained on all others."""

    def fold(x: tuple[str, str]) -> DataFrame:
        held = (F.col(label) == x[0]) & (F.col(grp) == x[1])
        model = fit(rows.where(~F.coalesce(held, F.lit(False))), mode, steps=steps)
        return predictions(model, rows.where(held)).withColumn("fold", F.lit(f"{x[0]}|{x[1]}"))

    return _each(fold, folds)


def repeated_seeds(rows: DataFrame, label: str, grp: str, key: str, seeds: tuple[int, ...], mode: str = "combined", steps: int = 100) -> DataFrame:
    """For each seed: predictions, with seed, of the test rows of its own class split by a model trained on its train rows."""

    def one(seed: int) -> DataFrame:
        split = written(splits.class_split(rows, grp, label, key, seed))
        model = fit(split.where("split = 'train'"), mode, steps=steps)
        return predictions(model, split.where("split = 'test'")).withColumn("seed", F.lit(seed))

    return _each(one, list(seeds))


def silhouettes(vectors: DataFrame, features: str, ks: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8), seed: int = 42) -> DataFrame:
    """Mean silhouette of k-means for each k."""
    found = []
    for k in ks:
        got = KMeans(k=k, seed=seed, featuresCol=features).fit(vectors).transform(vectors)
        found.append((k, float(ClusteringEvaluator(featuresCol=features).evaluate(got))))
    return vectors.sparkSession.createDataFrame(found, "k int, silhouette double")
