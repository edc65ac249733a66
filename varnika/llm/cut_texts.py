"""Text cut off by field limits, in pure SQL.

Over all texts, each word trigram is counted inside sentences and at their ends (before a full stop, danda, question mark or line
end; the end of a text counts only where such a mark stands there). The last trigram of each text is joined with these counts, its
own occurrence taken off. Where the
trigram is too rare to tell, the estimate falls back on the last two words, the last word, the last letters of the word: each level
is smoothed with the next. A text is cut if its last words are frequent inside sentences but almost never terminal, or, unless a
closing mark follows, if its last word is a fragment that occurs nowhere else, or if it ends in a broken character or a comma.

One pass explodes the n-grams as 64-bit hashes, summed before the shuffle; only the last n-grams of texts are joined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from varnika.functions.text import BLANK, INVISIBLE
from varnika.session import table, written

#: Weight of the estimate of the next shorter level.
PRIOR = 4.0
#: Below this share of terminal occurrences the last words are no end.
TERMINAL = 0.03
#: A text that ends in a closing mark is cut only if its last word was seen so often elsewhere.
SEEN = 5
# What stands for a missing text, without white space and marks.
PLACEHOLDERS = ("", "na", "nan", "null", "none", "nil", "empty", "undefined")
_NO_TEXT = ", ".join(f"'{x}'" for x in PLACEHOLDERS)


def _tokens(text: str) -> str:
    """SQL for the words of a text: numbers are #, ends of sentences are ¶, other marks within a sentence are commas. Brackets and quotes are dropped."""
    c = rf"lower(regexp_replace({text}, r'(?is)^(?:.*</think>|\s*<think>)?\s*(?:reply\s*:)?', ''))"
    c = rf"regexp_replace({c}, r'\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*', '#')"
    c = rf"regexp_replace({c}, r'(?:[.…]{{2,}}|…)\s*$|[{INVISIBLE}]+', '')"
    c = rf"regexp_replace({c}, r'[।॥.?!…|\n]+', ' ¶ ')"
    c = rf"regexp_replace({c}, r'[;:—–]+|-+(?!\p{{L}})', ',')"
    return rf"regexp_extract_all({c}, r'[\p{{L}}\p{{M}}\p{{N}}#]+|¶|,+|\x{{FFFD}}', 0)"


LEVELS = ("trigram", "bigram", "word", "letters")


def _grams(last: str) -> str:
    """SQL for the hashes of the n-grams that end at place ``last`` (from 0) of the padded tokens t, one for each of LEVELS."""
    w = [f"get(t, {last} - {k})" for k in range(3)]
    return f"array(xxhash64(3, {w[2]}, {w[1]}, {w[0]}), xxhash64(2, {w[1]}, {w[0]}), xxhash64(1, {w[0]}), xxhash64(0, right({w[0]}, 3)))"


def cut_texts(texts: DataFrame) -> DataFrame:
    """texts: table_name, record_id, model, text. Returns them with end_share (how often such last words are terminal) and cut (boolean).

    A null or blank text, a placeholder, one of a thinking block only and one without words is not cut and has no end_share. Equal rows count once
    each (a text repeated under several ids is counted as often). Texts of any length are read whole. An empty table gives no rows.
    """
    spark = texts.sparkSession
    rows = texts.select("table_name", "record_id", "model", "text").distinct().withColumn("ok", F.col("text").isNotNull() & ~F.col("text").rlike(BLANK))
    rows = rows.withColumn("closed", F.coalesce(F.col("text").rlike("(?<![.…])[।.?!][\"»”’')\\]\\s]*$"), F.lit(False)))
    rows = rows.withColumn("t", F.expr(f"if(ok, {_tokens('text')}, array())"))
    # the end of the text itself: marks after the last word say nothing, whatever they are, but a comma
    strip = "slice(t, 1, size(t) - coalesce(array_position(transform(reverse(t), x -> x <> '¶'), true) - 1, 0))"
    rows = rows.withColumn("t", F.expr(strip)).withColumn("t", F.expr(f"if(regexp_replace(concat_ws('', t), '[¶,]', '') NOT IN ({_NO_TEXT}), concat(array('¶', '¶'), t), array())"))
    rows = written(rows.drop("text", "ok"))
    name = f"varnika_cut_{uuid.uuid4().hex}"  # two calls in one session don't meet
    rows.createOrReplaceTempView(f"{name}_rows")
    spark.sql(
        f"""
        SELECT g, count(*) AS n, count_if(is_end) AS ends FROM (
          SELECT explode({_grams('i')}) AS g, coalesce(get(t, i + 1) = '¶', true) AS is_end
          FROM (SELECT t, explode(sequence(2, size(t) - if(closed, 1, 2))) AS i FROM {name}_rows WHERE size(t) > 3)
          WHERE get(t, i) <> '¶')
        GROUP BY g"""
    ).createOrReplaceTempView(f"{name}_grams")
    ends = spark.sql(
        f"""
        SELECT e.table_name, e.record_id, e.model, e.closed, e.pos, e.w, coalesce(g.n, 0) - e.own AS n, coalesce(g.ends, 0) - e.own AS ends
        FROM (SELECT table_name, record_id, model, closed, if(closed AND size(t) > 3, 1, 0) AS own, get(t, size(t) - 1) AS w, posexplode({_grams('(size(t) - 1)')}) AS (pos, g) FROM {name}_rows WHERE size(t) > 2) e
        LEFT JOIN {name}_grams g ON e.g = g.g"""
    )
    by = ends.groupBy("table_name", "record_id", "model").agg(
        F.max("w").alias("w"), F.max("closed").alias("closed"), *[F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{3 - k}") for k in range(4) for c in ("n", "ends")]
    )
    share = "ends0 / (n0 + 8D)"
    for k in (1, 2, 3):
        share = f"(ends{k} + {PRIOR}D * ({share})) / (n{k} + {PRIOR}D)"
    scored = by.withColumn("end_share", F.expr(share)).withColumn("cut", F.expr(f"startswith(w, ',') OR contains(w, '\\uFFFD') OR (end_share < {TERMINAL} AND (NOT closed OR n1 >= {SEEN}))"))
    rest = rows.where("size(t) <= 2").select("table_name", "record_id", "model", F.lit(None).cast("double").alias("end_share"), F.lit(False).alias("cut"))
    return scored.select("table_name", "record_id", "model", "end_share", "cut").unionByName(rest)


def _texts(spark, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "experiment_evon_results").select(F.lit("experiment_evon_results").alias("table_name"), F.col("result_key").alias("record_id"), "model", F.col("raw_output").alias("text"))
    b = table(spark, sf_dir, "boli_reviews").select(F.lit("boli_reviews").alias("table_name"), F.col("id").alias("record_id"), F.get_json_object("reply", "$.model").alias("model"), F.col("reply_text").alias("text"))
    return a.unionByName(b)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """The records whose text breaks off."""
    return cut_texts(_texts(spark, sf_dir)).where("cut").select("table_name", "record_id").distinct()


def p4_cut_share(spark, sf_dir: str) -> DataFrame:
    """For each table and model: texts, cut texts, their share."""
    got = cut_texts(_texts(spark, sf_dir)).where("end_share is not null")
    return got.groupBy("table_name", "model").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))


_INVISIBLE_SQL = r"\x{00AD}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"
_BLANK_SQL = rf"(?is)^[\s\p{{Z}}\p{{Pd}}.…·−{_INVISIBLE_SQL}]*(?:null[\s\p{{Z}}\p{{Pd}}.…·−{_INVISIBLE_SQL}]*)?$"


def _tokens_sql() -> str:
    c = r"lower(regexp_replace(text, '(?is)^(?:.*</think>|\s*<think>)?\s*(?:reply\s*:)?', ''))"
    for pattern, by in ((r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", "#"), (rf"(?:[.…]{{2,}}|…)\s*$|[{_INVISIBLE_SQL}]+", ""), (r"[।॥.?!…|\n]+", " ¶ "), (r"[;:—–]+", ","), (r"-+([^\p{L}-]|$)", r",\1")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{M}}\\p{{N}}#]+|¶|,+|\\x{{FFFD}}')"


_SHARE_SQL = "e0 / (n0 + 8.0::DOUBLE)"
for _k in (1, 2, 3):
    _SHARE_SQL = f"(e{_k} + {PRIOR}::DOUBLE * ({_SHARE_SQL})) / (n{_k} + {PRIOR}::DOUBLE)"
_KEYS_SQL = {3: "w2 || ' ' || w1 || ' ' || w0", 2: "w1 || ' ' || w0", 1: "w0", 0: "substring(w0, greatest(length(w0) - 2, 1))"}
_CUT_SQL = rf"""x AS (SELECT DISTINCT 'experiment_evon_results' AS table_name, result_key AS record_id, model, raw_output AS text FROM experiment_evon_results
  UNION SELECT DISTINCT 'boli_reviews', id, json_extract_string(reply, '$.model'), reply_text FROM boli_reviews),
y AS (SELECT *, text IS NOT NULL AND NOT regexp_matches(text, '{_BLANK_SQL}') AS ok, coalesce(regexp_matches(text, '(?:^|[^.…])[।.?!]["»”’'')\]\s]*$'), false) AS closed FROM x),
t0 AS (SELECT *, CASE WHEN ok THEN {_tokens_sql()} ELSE [] END AS t FROM y),
t1 AS (SELECT *, t[1:len(t) - coalesce(list_position(list_transform(list_reverse(t), lambda z: z <> '¶'), true) - 1, 0)] AS u FROM t0),
t2 AS (SELECT table_name, record_id, model, closed, row_number() OVER () AS k, CASE WHEN regexp_replace(array_to_string(u, ''), '[¶,]', '', 'g') NOT IN ({_NO_TEXT}) THEN list_concat(['¶', '¶'], u) ELSE [] END AS t FROM t1),
p AS (SELECT k, closed, i, len(t) AS n, t[i] AS w0, t[i - 1] AS w1, t[i - 2] AS w2, coalesce(t[i + 1] = '¶', true) AS is_end FROM (SELECT *, unnest(range(3, len(t) + 1)) AS i FROM t2 WHERE len(t) > 2)),
c AS (SELECT * FROM p WHERE w0 <> '¶' AND (i < n OR closed) AND n > 3),
""" + ",\n".join(f"g{k} AS (SELECT {e} AS g, count(*) AS n, count(*) FILTER (is_end) AS ends FROM c GROUP BY 1)" for k, e in _KEYS_SQL.items()) + ",\n" + "l AS (SELECT p.k, p.w0, p.closed, " + ", ".join(f"coalesce(g{k}.n, 0) - own AS n{k}, coalesce(g{k}.ends, 0) - own AS e{k}" for k in _KEYS_SQL) + " FROM (SELECT *, CASE WHEN closed AND n > 3 THEN 1 ELSE 0 END AS own FROM p WHERE i = n) p " + " ".join(f"LEFT JOIN g{k} ON g{k}.g = {e}" for k, e in _KEYS_SQL.items()) + rf"""),
f AS (SELECT table_name, record_id, model, t2.k, {_SHARE_SQL} AS end_share, coalesce(w0 LIKE ',%' OR contains(w0, chr(65533)) OR ({_SHARE_SQL} < {TERMINAL} AND (NOT l.closed OR n1 >= {SEEN})), false) AS cut FROM t2 LEFT JOIN l ON t2.k = l.k)"""

QUERIES = {"p4_found": p4_found, "p4_cut_share": p4_cut_share}
SQL = {
    "p4_found": f"WITH {_CUT_SQL} SELECT DISTINCT table_name, record_id FROM f WHERE cut",
    "p4_cut_share": f"WITH {_CUT_SQL} SELECT table_name, model, count(*) AS texts, count(*) FILTER (cut) AS cut, round(avg(cut::INT), 6) AS share FROM f WHERE end_share IS NOT NULL GROUP BY ALL",
}
