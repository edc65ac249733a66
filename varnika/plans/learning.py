"""Queries: classifier, clustering, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varnika.operators import detector, evaluation, splits
from varnika.session import checkpoint_dir, table, written
from varnika.streaming import events as E

Q, S = {}, {}
#: Seeds of the repeated splits.
FIVE, FIFTEEN = (1, 7, 42, 123, 2024), tuple(range(1, 16))


def query(f):
    Q[f.__name__] = f
    return f


def _samples(spark, sf):
    v = table(spark, sf, "variety_samples").withColumn("sample_id", F.col("sample_id").cast("string"))
    return splits.ordered_split(v, "sample_id", "sample_id", 42, 0.6, 0.2)


@query
def m5_variety_classifier(spark, sf):
    """Word and character n-grams, mode chosen on validation rows, calibrated, scored on test rows."""
    rows = written(detector.prepared(_samples(spark, sf), "text", "lang"))
    train, validation, test = (rows.where(F.col("split") == s) for s in ("train", "validation", "test"))
    mode, model = detector.best_mode(train, validation)
    labels = model.stages[0].labels
    raw = detector.predictions(model, test)
    cal = detector.calibrated(detector.predictions(model, validation), raw, labels)
    out = None
    for name, p in (("raw", raw), ("calibrated", cal)):
        part = evaluation.accuracy(p).crossJoin(evaluation.calibration_error(p).select("ece")).select(F.lit(mode).alias("mode"), F.lit(name).alias("scores"), "n", "accuracy", "ece")
        out = part if out is None else out.unionByName(part)
    return out


@query
def m8_leave_one_group_out(spark, sf):
    """Each label's groups predicted by models that never saw them."""
    v = table(spark, sf, "variety_samples").withColumn("grp", (F.col("sample_id") % 3).cast("string"))
    rows = written(detector.prepared(v, "text", "lang"))
    folds = [tuple(r) for r in rows.where("grp is not null").select("label", "grp").distinct().orderBy("label", "grp").collect()]
    p = detector.leave_one_group_out(rows, "label", "grp", folds)
    return evaluation.balanced_recall(p)


@query
def m9_repeated_seeds(spark, sf):
    """Recall over five and over fifteen seeds, each with its own split and model."""
    v = table(spark, sf, "variety_samples").withColumn("grp", (F.col("sample_id") % 3).cast("string")).withColumn("sample_id", F.col("sample_id").cast("string"))
    rows = written(detector.prepared(v, "text", "lang"))
    p = detector.repeated_seeds(rows, "label", "grp", "sample_id", tuple(sorted({*FIVE, *FIFTEEN}))).select("true", "pred", "seed")
    five, fifteen = (evaluation.seed_stability(p.where(F.col("seed").isin(*s))) for s in (FIVE, FIFTEEN))
    return five.unionByName(fifteen)


@query
def a45_silhouettes(spark, sf):
    """Silhouette of k-means over the embeddings for two to eight clusters."""
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return detector.silhouettes(v, "features")



def _stream(spark, sf, name):
    """A table as a stream of its files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet") if _folder(spark, sf, name) else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def t1_event_stream(spark, sf):
    """Daily outcomes of the event stream, run over what is there."""
    out = E.outcome_summary(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    got = E.run_once(out, f"{folder}/rows", f"{folder}/state", "update", ["window", "event_type"])
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 3).alias("value"))


S["t1_event_stream"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ALL"


def _turn_rows(spark, sf):
    """Turns as they are delivered; a silent one ends its conversation."""
    end = F.coalesce(F.lower(F.trim("error_code")) == "no_speech", F.lit(False))
    return _stream(spark, sf, "boli_reviews").select(F.col("conversation_id").alias("conv"), F.regexp_extract("turn_id", "([0-9]+)", 1).try_cast("int").alias("turn"), F.coalesce("understood", F.lit(True)).alias("understood"), end.alias("end"), F.lit("reply").alias("stage"), F.col("created").cast("timestamp").alias("created"))


_TURN_ROWS = """r AS (SELECT conversation_id AS conv, TRY_CAST(nullif(regexp_extract(turn_id, '([0-9]+)', 1), '') AS INT) AS turn, coalesce(understood, true) AS understood, coalesce(lower(trim(error_code)) = 'no_speech', false) AS "end", created FROM boli_reviews)"""


@query
def t2_finished_once(spark, sf):
    """Each stage of a turn once, whatever is delivered again within an hour."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    got = E.run_once(E.finished_once(_turn_rows(spark, sf), "created"), f"{folder}/rows", f"{folder}/state")
    return got.groupBy("conv").agg(F.count("*").alias("stages"))


S["t2_finished_once"] = f"WITH {_TURN_ROWS} SELECT conv, count(*) AS stages FROM (SELECT DISTINCT conv, turn FROM r) GROUP BY 1"


@query
def t3_conversation_stream(spark, sf):
    """Conversations followed turn by turn with bounded state; what comes after a silent turn is late."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    got = E.run_once(E.follow_conversations(_turn_rows(spark, sf), idle=False), f"{folder}/rows", f"{folder}/state")
    return got.distinct().groupBy("conv").agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("late"), F.sum("context").alias("context"), F.max("turns").alias("turns"))


S["t3_conversation_stream"] = f"""WITH {_TURN_ROWS}, d AS (SELECT conv, turn, bool_and(understood) AS understood, bool_and("end") FILTER (understood = low) AS "end" FROM (SELECT *, bool_and(understood) OVER (PARTITION BY conv, turn) AS low FROM r WHERE turn IS NOT NULL AND conv IS NOT NULL) GROUP BY ALL),
e AS (SELECT *, turn > 40 OR coalesce(bool_or("end") OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dropped FROM d),
c AS (SELECT *, CASE WHEN dropped THEN 0 ELSE coalesce(sum(understood::INT) OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) END AS context FROM e)
SELECT conv, count(*) FILTER (NOT dropped) AS kept, count(*) FILTER (dropped) AS late, sum(context) AS context, count(*) FILTER (NOT dropped) AS turns FROM c GROUP BY 1"""


@query
def t3_evicted(spark, sf):
    """The conversations that go when fifty may stay."""
    r = table(spark, sf, "boli_reviews").where("conversation_id is not null")
    per = r.groupBy(F.col("conversation_id").alias("conv")).agg(F.max(F.coalesce(F.lower(F.trim("error_code")) == "no_speech", F.lit(False))).alias("ended"), F.max("created").alias("last"))
    return E.evicted(per).select("conv", "ended")


S["t3_evicted"] = f'WITH {_TURN_ROWS}, c AS (SELECT conv, bool_or("end") AS ended, max(created) AS last FROM r WHERE conv IS NOT NULL GROUP BY 1) SELECT conv, ended FROM c QUALIFY row_number() OVER (ORDER BY ended, last DESC, conv) > 50'


def _folder(spark, sf, name) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


QUERIES, SQL = Q, S
