"""Shared inputs of the queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from varnika.session import table

NAMES = {"hi": ("hi", "hin", "hindi"), "bho": ("bho", "bhojpuri"), "mai": ("mai", "maithili"), "awa": ("awa", "awadhi"), "mwr": ("mwr", "marwari"), "en": ("en", "eng", "english")}


#: Families of the varieties.
FAMILIES = {"bho": "bihari", "mai": "bihari", "hi": "hindi", "awa": "hindi", "mwr": "rajasthani", "en": "english"}


def variety(c: str) -> Column:
    """The variety that a label names, null if none."""
    bare = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(bare.isin(*names), code).otherwise(out)
    return out


def variety_sql(c: str) -> str:
    bare = f"regexp_extract(lower(trim({c})), '^([a-z]+)', 1)"
    cases = " ".join(f"WHEN {bare} IN ({', '.join(repr(n) for n in names)}) THEN '{code}'" for code, names in NAMES.items())
    return f"CASE {cases} END"


def records(spark, sf_dir: str) -> DataFrame:
    """The aligned pairs, each once, with their variety."""
    return table(spark, sf_dir, "dataset_records").distinct().withColumn("variety", variety("target_language"))


RECORDS = f"r AS (SELECT DISTINCT *, {variety_sql('target_language')} AS variety FROM dataset_records)"


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").withColumn("variety", variety("lang"))


DOCUMENTS = f"d AS (SELECT *, {variety_sql('lang')} AS variety FROM documents WHERE text IS NOT NULL)"


def scored(spark, sf_dir: str) -> DataFrame:
    """Predictions for the documents with a variety: a fixed stand-in for a classifier, so that evaluation can be checked without training."""
    k = F.col("doc_id") * 37 % 101
    labels = F.array(*[F.lit(x) for x in NAMES])
    at = F.array_position(labels, F.col("variety")).cast("int")
    pred = F.when(k < 62, F.col("variety")).otherwise(F.element_at(labels, (at + (k % 5).cast("int")) % 6 + 1))
    second = F.element_at(labels, (at + (k % 3).cast("int")) % 6 + 1)
    n_words = F.size(F.split(F.trim(F.regexp_replace("text", "[ \n]+", " ")), " ")) % 40
    return documents(spark, sf_dir).where("variety is not null").select("doc_id", F.col("variety").alias("true"), pred.alias("pred"), second.alias("second"), (k / 101.0).alias("p"), F.col("source").alias("grp"), (F.col("doc_id") % 5).alias("seed"), n_words.alias("n_words"))


SCORED = f"""{DOCUMENTS}, n AS (SELECT *, doc_id * 37 % 101 AS k, ['hi','bho','mai','awa','mwr','en'] AS labels FROM d WHERE variety IS NOT NULL),
s AS (SELECT doc_id, variety AS "true",
  CASE WHEN k < 62 THEN variety ELSE labels[(list_position(labels, variety) + k % 5) % 6 + 1] END AS pred,
  labels[(list_position(labels, variety) + k % 3) % 6 + 1] AS second, k / 101.0::DOUBLE AS p, source AS grp, doc_id % 5 AS seed,
  len(string_split(trim(regexp_replace(text, '[ \\n]+', ' ', 'g')), ' ')) % 40 AS n_words FROM n)"""

#: SQL for the Devanagari words of a text.
WORDS_SQL = "regexp_extract_all({}, '[\\x{{0900}}-\\x{{097F}}]+')"
STRIP_SQL = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
