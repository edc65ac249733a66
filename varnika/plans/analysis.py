"""Queries: texts, counts, markers, scores, ratings, evaluation, similarity, alignment, routing, turns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varnika.functions import text as X
from varnika.operators import align, evaluation, markers, metrics, routing, similarity, splits, turns
from varnika.plans.common import DOCUMENTS, FAMILIES, RECORDS, SCORED, STRIP_SQL, WORDS_SQL, documents, records, scored
from varnika.session import table

Q, S = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


_st = lambda c: STRIP_SQL.format(c)
R6 = lambda c: F.round(c, 6)
REVIEWS = "b AS (SELECT DISTINCT id, conversation_id, turn_id, recognized_text, reply_text, understood, created FROM boli_reviews)"


def reviews(spark, sf):
    return table(spark, sf, "boli_reviews").select("id", "conversation_id", "turn_id", "recognized_text", "reply_text", "understood", "created").distinct()


# ---- texts

_CLEAN = "nfc_normalize({})"
for _p, _r in ((r"</?[A-Za-z_]+>", " "), (r"\[[^\]]*\]", " "), (r"\{{[^}}]*\}}", " "), (r"-+[\s\p{{Z}}]*$", " "), (r"[।,.?!;:\"''()\-]", " "), (r"[\s\p{{Z}}]+", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"
_CLEAN = f"trim({_CLEAN})"


@query
def e4_clean_transcripts(spark, sf):
    """Cleaned turns and their number of words."""
    t = reviews(spark, sf).where("recognized_text is not null")
    return t.select("id", X.clean_transcript("recognized_text").alias("clean"), F.size(X.tokens("recognized_text")).alias("words"), F.size(X.devanagari_words("recognized_text")).alias("devanagari_words"))


S["e4_clean_transcripts"] = f"""WITH {REVIEWS}, c AS (SELECT id, recognized_text, {_CLEAN.format('recognized_text')} AS clean FROM b WHERE recognized_text IS NOT NULL)
SELECT id, clean, len(list_filter(string_split(clean, ' '), lambda x: x <> '')) AS words, len({WORDS_SQL.format('recognized_text')}) AS devanagari_words FROM c"""


@query
def e9_phonetic_forms(spark, sf):
    """Words of the reference texts in phonetic and routing form (E8, E9): how many words share a form."""
    w = records(spark, sf).select(F.explode(X.devanagari_words("target_text")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.select("w", "n", X.phonetic_form("w").alias("phonetic"), X.routing_form("w").alias("routing")).groupBy("phonetic").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("routing").alias("routing"))


S["e9_phonetic_forms"] = rf"""WITH {RECORDS}, w AS (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS_SQL.format('target_text')}) AS w FROM r) GROUP BY 1),
f AS (SELECT n, regexp_replace(replace(replace(nfc_normalize(w), '़', ''), 'ँ', 'ं'), '[नमङणञ]्', 'ं', 'g') AS phonetic, replace(replace(replace(nfc_normalize(w), chr(8204), ''), chr(8205), ''), 'ँ', 'ं') AS routing FROM w)
SELECT phonetic, count(*) AS words, sum(n) AS n, min(routing) AS routing FROM f GROUP BY 1"""


@query
def a44_script_shares(spark, sf):
    """Scripts of the answers per model and condition."""
    e = table(spark, sf, "experiment_evon_results").select("result_key", "model", "condition", "raw_output").distinct()
    return e.groupBy("model", "condition", X.script_class("raw_output").alias("script")).agg(F.count("*").alias("n"))


S["a44_script_shares"] = """SELECT model, condition, CASE WHEN raw_output IS NULL OR raw_output = '' THEN 'empty' WHEN regexp_matches(raw_output, '[\\x{0900}-\\x{097F}]') AND regexp_matches(raw_output, '[A-Za-z]') THEN 'mixed'
WHEN regexp_matches(raw_output, '[\\x{0900}-\\x{097F}]') THEN 'devanagari' WHEN regexp_matches(raw_output, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script, count(*) AS n
FROM (SELECT DISTINCT result_key, model, condition, raw_output FROM experiment_evon_results) GROUP BY ALL""".replace("\\\\", "\\")


@query
def e17_final_answers(spark, sf):
    """The answer after the thinking block and label, first line; whole sentences of it where the model stopped at its length."""
    e = table(spark, sf, "experiment_evon_results").select("result_key", "finish_reason", "raw_output").distinct().where("raw_output is not null")
    answer = X.final_answer("raw_output")
    return e.select("result_key", F.when(F.col("finish_reason") == "length", X.whole_sentences(answer)).otherwise(answer).alias("answer"))


@query
def a44_named_languages(spark, sf):
    """Recognised languages against the condition's true one: exact, the common language instead, or wrong."""
    b = table(spark, sf, "boli_reviews").select("id", "recognition").distinct()
    return evaluation.named_language(b.select(F.lit("bho").alias("truth"), F.get_json_object("recognition", "$.language").alias("detected")), "hi", ("hi", "en"))


S["a44_named_languages"] = """WITH b AS (SELECT DISTINCT id, recognition FROM boli_reviews), d AS (SELECT coalesce(lower(trim(json_extract_string(recognition, '$.language'))), '') AS t FROM b)
SELECT 'bho' AS truth, count(*) AS n, count(*) FILTER (contains(t, 'bho')) AS exact, count(*) FILTER (NOT contains(t, 'bho') AND contains(t, 'hi')) AS fallback, count(*) FILTER (NOT contains(t, 'bho') AND NOT contains(t, 'hi')) AS wrong FROM d"""


_BLOCK = _st("list_last(string_split(raw_output, '</think>'))")
S["e17_final_answers"] = rf"""WITH e AS (SELECT DISTINCT result_key, finish_reason, raw_output FROM experiment_evon_results WHERE raw_output IS NOT NULL),
k AS (SELECT *, {_BLOCK} AS block FROM e),
a AS (SELECT result_key, finish_reason, substring({_st("regexp_extract(CASE WHEN contains(block, 'REPLY:') THEN " + _st("substring(block, strpos(block, 'REPLY:') + 6)") + r" ELSE block END, '^([^\n\r]*)', 1)")}, 1, 400) AS answer FROM k)
SELECT result_key, CASE WHEN finish_reason = 'length' AND regexp_extract(answer, '(?s)^(.+[।.?!])', 1) <> '' THEN regexp_extract(answer, '(?s)^(.+[।.?!])', 1) ELSE answer END AS answer FROM a"""


@query
def e20_first_lines(spark, sf):
    """First line of each document, without a speaker's label."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.first_line("text", r"(?:S\d|A|B)").alias("line"))


S["e20_first_lines"] = rf"""SELECT doc_id, regexp_replace(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_st('x')}), lambda x: x <> '')[1], ''), '(?i)^(?:S\d|A|B)\s*:\s*', '') AS line FROM documents WHERE text IS NOT NULL"""


@query
def e25_display_names(spark, sf):
    """Sources as names to show."""
    return table(spark, sf, "source_targets").select("source", X.display_name("source").alias("name"))


S["e25_display_names"] = "SELECT source, array_to_string(list_transform(string_split(source, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM source_targets"


# ---- counts and markers

def _counts(spark, sf):
    return markers.word_counts(records(spark, sf), "variety", "target_text")


_COUNTS = f"""{RECORDS}, c AS (SELECT variety, word, count(*) AS n FROM (SELECT variety, unnest({WORDS_SQL.format('target_text')}) AS word FROM r WHERE variety IS NOT NULL) GROUP BY ALL),
vt AS (SELECT variety, sum(n) AS total FROM c GROUP BY 1)"""


@query
def a12_word_counts(spark, sf):
    """Words per variety."""
    return _counts(spark, sf)


S["a12_word_counts"] = f"WITH {_COUNTS} SELECT variety, word, n FROM c"


def _ratio_sql(where: str, top: int) -> str:
    return f"""ht AS (SELECT coalesce(sum(total), 0) AS ref_total FROM vt WHERE variety = 'bho'),
q AS (SELECT c.variety, c.word, c.n, coalesce(h.n, 0) AS ref_n, c.n / total / (CASE WHEN ref_total > 0 THEN coalesce(h.n, 0) / ref_total ELSE 0 END + 1e-7) AS raw
  FROM c LEFT JOIN (SELECT word, n FROM c WHERE variety = 'bho') h USING (word) JOIN vt USING (variety), ht WHERE c.variety <> 'bho' AND c.n >= 3 AND length(c.word) >= 2),
m AS (SELECT variety, word, n, ref_n, round(raw, 1) AS ratio, row_number() OVER (PARTITION BY variety ORDER BY round(raw, 1) DESC, n DESC, word) AS position FROM q {where} QUALIFY position <= {top})"""


@query
def a13_marker_ratios(spark, sf):
    """Words that mark each variety against the most spoken one."""
    return markers.marker_ratios(_counts(spark, sf), "bho")


S["a13_marker_ratios"] = f"WITH {_COUNTS}, {_ratio_sql('', 100)} SELECT * FROM m"


@query
def a14_distinct_markers(spark, sf):
    """Only words that the reference variety does not have or hardly has, forty each."""
    return markers.marker_ratios(_counts(spark, sf), "bho", 40, True)


S["a14_distinct_markers"] = f"WITH {_COUNTS}, {_ratio_sql('WHERE ref_n = 0 OR raw > 20', 40)} SELECT * FROM m"


@query
def a15_marker_weights(spark, sf):
    """Markers weighted by how many varieties use them."""
    return markers.marker_weights(_counts(spark, sf), "bho")


S["a15_marker_weights"] = f"""WITH {_COUNTS}, {_ratio_sql('WHERE ref_n = 0 OR raw > 20', 2**31 - 1)}, u AS (SELECT word, count(*) AS users FROM c WHERE variety <> 'bho' AND n >= 3 GROUP BY 1)
SELECT variety, word, 1.0::DOUBLE / users AS weight FROM m JOIN u USING (word) WHERE 1.0 / users >= 0.5"""


@query
def a16_log_odds(spark, sf):
    """Words over-represented in each variety, by z-score of log-odds."""
    return markers.log_odds(_counts(spark, sf))


S["a16_log_odds"] = f"""WITH {_COUNTS}, a AS (SELECT word, sum(n) AS all_n FROM c GROUP BY 1), z AS (SELECT count(*) AS v, sum(all_n) AS everything FROM a),
q AS (SELECT variety, word, n, all_n - n AS rest, ln(((n + 1.0::DOUBLE) / (total + 1.0::DOUBLE * v)) / ((all_n - n + 1.0::DOUBLE) / (everything - total + 1.0::DOUBLE * v))) AS odds FROM c JOIN a USING (word) JOIN vt USING (variety), z WHERE n >= 3),
f AS (SELECT variety, word, n, rest, round(odds, 2) AS log_odds, round(odds / sqrt(1.0::DOUBLE / (n + 1) + 1.0::DOUBLE / (rest + 1)), 1) AS z FROM q)
SELECT *, row_number() OVER (PARTITION BY variety ORDER BY z DESC, word) AS position FROM f QUALIFY position <= 15"""


@query
def a17_suffixes(spark, sf):
    """Word endings over-represented in each variety."""
    return markers.suffixes(_counts(spark, sf))


S["a17_suffixes"] = f"""WITH {_COUNTS}, e AS (SELECT variety, substring(word, length(word) - 1) AS suffix, sum(n) AS n FROM c WHERE length(word) > 2 GROUP BY ALL), a AS (SELECT suffix, sum(n) AS all_n FROM e GROUP BY 1),
t AS (SELECT variety, sum(n) AS total FROM e GROUP BY 1), z AS (SELECT sum(n) AS everything FROM e),
q AS (SELECT variety, suffix, n, n / total / (coalesce((all_n - n) / nullif(everything - total, 0), 0) + 1e-6) AS raw FROM e JOIN a USING (suffix) JOIN t USING (variety), z WHERE n >= 5)
SELECT variety, suffix, n, round(raw, 1) AS ratio, row_number() OVER (PARTITION BY variety ORDER BY round(raw, 1) DESC, n DESC, suffix) AS position FROM q WHERE raw > 1.5 QUALIFY position <= 10"""


@query
def e14_marker_scores(spark, sf):
    """Turns labelled by weighted marker words."""
    m = markers.marker_weights(_counts(spark, sf), "bho")
    return markers.marker_scores(reviews(spark, sf).where("recognized_text is not null"), "id", "recognized_text", m, 2.0, 0.5, 0.15).groupBy("label").agg(F.count("*").alias("n"))


S["e14_marker_scores"] = f"""WITH {_COUNTS}, {_ratio_sql('WHERE ref_n = 0 OR raw > 20', 2**31 - 1)}, {REVIEWS}, u AS (SELECT word, count(*) AS users FROM c WHERE variety <> 'bho' AND n >= 3 GROUP BY 1),
k AS (SELECT variety, word, 1.0::DOUBLE / users AS weight FROM m JOIN u USING (word) WHERE 1.0 / users >= 0.5),
t AS (SELECT id, recognized_text FROM b WHERE recognized_text IS NOT NULL), w AS (SELECT DISTINCT id, word FROM (SELECT id, unnest({WORDS_SQL.format('recognized_text')}) AS word FROM t)),
s AS (SELECT id, variety, least(1.0, sum(weight) / 2.0) AS score FROM w JOIN k USING (word) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, variety DESC) AS place FROM s),
p AS (SELECT id, max(variety) FILTER (place = 1) AS v, max(score) FILTER (place = 1) AS first, coalesce(max(score) FILTER (place = 2), 0) AS second FROM o GROUP BY 1)
SELECT CASE WHEN first >= 0.5 AND first - second >= 0.15 THEN v ELSE 'hindi_unknown' END AS label, count(*) AS n FROM (SELECT DISTINCT id FROM t) LEFT JOIN p USING (id) GROUP BY 1"""


@query
def e13_substring_labels(spark, sf):
    """Turns labelled by a short list of marker strings."""
    t = reviews(spark, sf).where("recognized_text is not null")
    return markers.substring_label(t, "recognized_text", ["बानी", "हमनी", "रउआ", "बा", "लोगन", "आउर"], ("बा",)).groupBy("label", "confidence").agg(F.count("*").alias("n"))


S["e13_substring_labels"] = rf"""WITH {REVIEWS}, h AS (SELECT id, ((contains(recognized_text, 'बानी'))::INT + (contains(recognized_text, 'हमनी'))::INT + contains(recognized_text, 'रउआ')::INT + contains(recognized_text, 'लोगन')::INT + contains(recognized_text, 'आउर')::INT
  + regexp_matches(recognized_text, '(^|[^\x{{0900}}-\x{{0963}}\x{{0966}}-\x{{097F}}])बा([^\x{{0900}}-\x{{0963}}\x{{0966}}-\x{{097F}}]|$)')::INT) AS k FROM b WHERE recognized_text IS NOT NULL)
SELECT CASE WHEN least(1.0, k / 3.0) >= 0.67 THEN 'bhojpuri' ELSE 'hindi' END AS label, round(least(1.0, k / 3.0::DOUBLE), 2) AS confidence, count(*) AS n FROM h GROUP BY ALL"""


@query
def u3_union_markers(spark, sf):
    """All marker words of all lists, and those of several."""
    m = markers.marker_ratios(_counts(spark, sf), "bho", 40, True)
    lists = [m.where(F.col("variety") == v).select("word") for v in ("mai", "awa", "mwr")]
    every = markers.union_markers(*lists)
    shared = lists[0].intersect(lists[1])
    only = lists[2].exceptAll(lists[0]).distinct()
    return every.select(F.lit("any").alias("kind"), "word").unionByName(shared.select(F.lit("mai and awa").alias("kind"), "word")).unionByName(only.select(F.lit("mwr not mai").alias("kind"), "word"))


S["u3_union_markers"] = f"""WITH {_COUNTS}, {_ratio_sql('WHERE ref_n = 0 OR raw > 20', 40)}
SELECT DISTINCT 'any' AS kind, word FROM m WHERE variety IN ('mai', 'awa', 'mwr') UNION ALL (SELECT 'mai and awa', word FROM m WHERE variety = 'mai' INTERSECT SELECT 'mai and awa', word FROM m WHERE variety = 'awa')
UNION ALL (SELECT 'mwr not mai', word FROM m WHERE variety = 'mwr' EXCEPT SELECT 'mwr not mai', word FROM m WHERE variety = 'mai')"""


# ---- scores and ratings

def _predictions(spark, sf):
    """For each pair and variety the first target in order that shares its anchor, as the prediction of a condition."""
    r = records(spark, sf).where("target_text is not null")
    other = r.where("variety is not null").groupBy(F.col("variety").alias("condition"), "anchor_text").agg(F.min("target_text").alias("prediction"))
    return r.select("id", "anchor_text").join(other, "anchor_text").select("condition", "id", "prediction")


_PREDICTIONS = f"""{RECORDS}, f AS (SELECT * FROM r WHERE target_text IS NOT NULL), o AS (SELECT variety AS condition, anchor_text, min(target_text) AS prediction FROM f WHERE variety IS NOT NULL GROUP BY ALL),
p AS (SELECT condition, prediction, anchor_text, target_text FROM f JOIN o USING (anchor_text))"""
_SAME = lambda a, b: f"nfc_normalize({_st(a)}) = nfc_normalize({_st(b)})"


@query
def a6_run_metrics(spark, sf):
    """n-gram F-score, exact and copy rates per condition and for the copied anchor."""
    m = metrics.run_metrics(_predictions(spark, sf), records(spark, sf).where("target_text is not null"))
    return m.select("condition", "n", "complete", *[R6(c).alias(c) for c in ("chrf", "exact_match", "copy_rate")])


S["a6_run_metrics"] = rf"""WITH {_PREDICTIONS}, e AS (SELECT * FROM p UNION ALL SELECT 'identity', anchor_text, anchor_text, target_text FROM f),
x AS (SELECT *, row_number() OVER () AS k, regexp_replace(nfc_normalize(prediction), '[\s\p{{Z}}]+', '', 'g') AS a, regexp_replace(nfc_normalize(target_text), '[\s\p{{Z}}]+', '', 'g') AS b
  FROM (SELECT prediction, target_text FROM e WHERE prediction IS NOT NULL GROUP BY ALL)),
g AS (SELECT k, n, substring(a, i, n) AS gram, 1 AS x, 0 AS y FROM (SELECT k, a, n, unnest(range(1, length(a) - n + 2)) AS i FROM x, range(1, 7) z(n))
  UNION ALL SELECT k, n, substring(b, i, n), 0, 1 FROM (SELECT k, b, n, unnest(range(1, length(b) - n + 2)) AS i FROM x, range(1, 7) z(n))),
c AS (SELECT k, n, least(sum(x), sum(y)) AS same, sum(x) AS x, sum(y) AS y FROM g GROUP BY k, n, gram),
q AS (SELECT k, n, sum(same) / sum(x)::DOUBLE AS p, sum(same) / sum(y)::DOUBLE AS r FROM c GROUP BY ALL HAVING sum(x) > 0 AND sum(y) > 0),
m AS (SELECT k, avg(p) AS p, avg(r) AS r FROM q GROUP BY 1),
v AS (SELECT prediction, target_text, CASE WHEN m.k IS NULL THEN CASE WHEN {_SAME('prediction', 'target_text')} THEN 100 ELSE 0 END WHEN p + r = 0 THEN 0 ELSE 100 * 5 * p * r / (4 * p + r) END AS chrf FROM x LEFT JOIN m USING (k))
SELECT condition, count(*) AS n, count(*) = (SELECT count(*) FROM f) AS complete, round(avg(chrf), 6) AS chrf, round(avg(({_SAME('prediction', 'target_text')})::INT), 6) AS exact_match, round(avg(({_SAME('prediction', 'anchor_text')})::INT), 6) AS copy_rate
FROM e LEFT JOIN v USING (prediction, target_text) GROUP BY 1"""


@query
def a6_exact_and_copy(spark, sf):
    """Exact and copy rates per condition."""
    refs = records(spark, sf).where("target_text is not null").select("id", "anchor_text", "target_text")
    p = _predictions(spark, sf).join(refs, "id")
    return p.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(metrics.same_text("prediction", "target_text")).alias("exact"), F.count_if(metrics.same_text("prediction", "anchor_text")).alias("copied"))


S["a6_exact_and_copy"] = f"WITH {_PREDICTIONS} SELECT condition, count(*) AS n, count(*) FILTER ({_SAME('prediction', 'target_text')}) AS exact, count(*) FILTER ({_SAME('prediction', 'anchor_text')}) AS copied FROM p GROUP BY 1"


_BARE = "regexp_replace(lower(choice), '[\\s\\p{Z}_\\-]+', '', 'g')"
_RATINGS = f"""v AS (SELECT DISTINCT item_id, rater_id, rated_at, CASE WHEN {_BARE} = 'bothbad' THEN 'both_bad' WHEN {_BARE} IN ('1', '2', 'tie') THEN {_BARE} END AS choice FROM rating_records),
o AS (SELECT v.*, system_1, system_2, CASE choice WHEN '1' THEN system_1 WHEN '2' THEN system_2 ELSE choice END AS winner FROM v JOIN rating_key USING (item_id) WHERE choice IS NOT NULL)"""


def _ratings(spark, sf):
    bare = F.lower(F.regexp_replace("choice", r"(?U)[\s_\-]+", ""))
    return table(spark, sf, "rating_records").select("item_id", "rater_id", "rated_at", F.when(bare == "bothbad", "both_bad").when(bare.isin("1", "2", "tie"), bare).alias("choice")).distinct()


@query
def a7_win_shares(spark, sf):
    """Wins, ties and share of the decided comparisons per system."""
    out = metrics.win_shares(metrics.rating_outcomes(_ratings(spark, sf), table(spark, sf, "rating_key")))
    return out.withColumn("win_share", R6("win_share"))


S["a7_win_shares"] = f"""WITH {_RATINGS}, s AS (SELECT system_1 AS system, * FROM o UNION ALL SELECT system_2, * FROM o)
SELECT system, count(*) AS compared, count(*) FILTER (choice IN ('1', '2') AND winner = system) AS wins, count(*) FILTER (choice = 'tie') AS ties, count(*) FILTER (choice = 'both_bad') AS both_bad, count(*) FILTER (choice IN ('1', '2')) AS decided,
round(wins / nullif(decided, 0), 6) AS win_share FROM s GROUP BY 1"""


@query
def a7_per_rater(spark, sf):
    """Ratings, ties and wins of the reference per rater."""
    o = metrics.rating_outcomes(_ratings(spark, sf), table(spark, sf, "rating_key"))
    return o.groupBy("rater_id").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == "tie").alias("ties"), F.count_if(F.col("winner") == "reference").alias("reference_wins"))


S["a7_per_rater"] = f"WITH {_RATINGS} SELECT rater_id, count(*) AS n, count(*) FILTER (choice = 'tie') AS ties, count(*) FILTER (winner = 'reference') AS reference_wins FROM o GROUP BY 1"


@query
def a42_word_error_rate(spark, sf):
    """Word edits between both options of each item, per first system."""
    return metrics.word_error_rate(table(spark, sf, "rating_key"), "option_1", "option_2", "system_1").withColumn("wer", R6("wer"))


# words of a pair as one character each, so that the edit distance of characters is that of words
_CODED = "array_to_string(list_transform({}, lambda w: chr(33 + list_position(d, w)::INT)), '')"
S["a42_word_error_rate"] = f"""WITH k AS (SELECT system_1, list_filter(regexp_split_to_array({_st('option_1')}, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array({_st('option_2')}, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS b FROM rating_key WHERE trim(option_1) <> '' AND trim(option_2) <> ''),
x AS (SELECT *, list_distinct(list_concat(a, b)) AS d FROM k)
SELECT system_1, count(*) AS rows, sum(levenshtein({_CODED.format('a')}, {_CODED.format('b')})) AS edits, sum(len(a)) AS words, round(sum(levenshtein({_CODED.format('a')}, {_CODED.format('b')})) / sum(len(a)), 6) AS wer FROM x GROUP BY 1""".replace("\\\\", "\\")


@query
def a42_value_counts(spark, sf):
    """How often each system stands on each side of the items."""
    return metrics.value_counts(table(spark, sf, "rating_key"), "system_1", "system_2")


S["a42_value_counts"] = """SELECT 'system_1' AS "column", system_1 AS value, count(*) AS n FROM rating_key GROUP BY ALL UNION ALL SELECT 'system_2', system_2, count(*) FROM rating_key GROUP BY ALL"""


# ---- evaluation

@query
def a4_group_sizes(spark, sf):
    """Rows and groups per variety."""
    return evaluation.group_sizes(documents(spark, sf).where("variety is not null"), "variety", "source").withColumn("rows_per_group", R6("rows_per_group"))


S["a4_group_sizes"] = f"WITH {DOCUMENTS} SELECT variety, count(*) AS rows, count(DISTINCT source) AS groups, round(count(*) / nullif(count(DISTINCT source), 0), 6) AS rows_per_group, CASE WHEN count(DISTINCT source) <= 3 THEN 'SEVERE' WHEN count(DISTINCT source) <= 8 THEN 'WEAK' ELSE 'OK' END AS severity FROM d WHERE variety IS NOT NULL GROUP BY 1"


@query
def a28_accuracy(spark, sf):
    """Accuracy, top-2 and family accuracy."""
    return evaluation.accuracy(scored(spark, sf), FAMILIES).select("n", *[R6(c).alias(c) for c in ("accuracy", "top2", "family")])


_FAMILY = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END"
_SAME_FAMILY = f"""({_FAMILY('"true"')} = {_FAMILY('pred')})::INT"""
S["a28_accuracy"] = f"""WITH {SCORED} SELECT count(*) AS n, round(avg(("true" = pred)::INT), 6) AS accuracy, round(avg(("true" = pred OR "true" = second)::INT), 6) AS top2, round(avg({_SAME_FAMILY}), 6) AS family FROM s"""


@query
def a29_calibration_error(spark, sf):
    """Expected calibration error over ten bins."""
    return evaluation.calibration_error(scored(spark, sf)).select(R6("ece").alias("ece"), "n")


S["a29_calibration_error"] = f"""WITH {SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(("true" = pred)::INT) AS a FROM s GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, sum(n) AS n FROM b"""


@query
def a30_threshold_curve(spark, sf):
    """Coverage and confident errors at nineteen thresholds."""
    return evaluation.threshold_curve(scored(spark, sf)).select("threshold", "kept", R6("coverage").alias("coverage"), R6("false_confident").alias("false_confident"))


_CURVE = f"""{SCORED}, t AS (SELECT k * 0.05::DOUBLE AS t FROM range(1, 20) x(k)), k AS (SELECT round(t, 2) AS threshold, count(*) FILTER (p >= t) AS kept, count(*) FILTER (p >= t AND "true" <> pred) AS wrong, count(*) AS every FROM s, t GROUP BY 1)"""
S["a30_threshold_curve"] = f"WITH {_CURVE} SELECT threshold, kept, round(kept / every, 6) AS coverage, round(wrong / nullif(kept, 0), 6) AS false_confident FROM k"


@query
def a30_recommended(spark, sf):
    """Smallest thresholds that keep confident errors low."""
    return evaluation.recommended_thresholds(evaluation.threshold_curve(scored(spark, sf)), (0.05, 0.2, 0.4)).withColumn("coverage", R6("coverage"))


S["a30_recommended"] = f"""WITH {_CURVE}, l AS (SELECT unnest([0.05, 0.2, 0.4])::DOUBLE AS at_most), m AS (SELECT at_most, min(threshold) FILTER (wrong / nullif(kept, 0) <= at_most) AS threshold FROM l, k GROUP BY 1)
SELECT at_most, m.threshold, round(kept / every, 6) AS coverage FROM m LEFT JOIN k USING (threshold)"""


@query
def a31_accuracy_by_length(spark, sf):
    """Accuracy by number of words."""
    return evaluation.accuracy_by_length(scored(spark, sf)).withColumn("accuracy", R6("accuracy"))


S["a31_accuracy_by_length"] = f"""WITH {SCORED} SELECT CASE WHEN n_words BETWEEN 1 AND 3 THEN '1-3' WHEN n_words BETWEEN 4 AND 6 THEN '4-6' WHEN n_words BETWEEN 7 AND 10 THEN '7-10' WHEN n_words BETWEEN 11 AND 20 THEN '11-20' ELSE '21-1000' END AS length, count(*) AS n, round(avg(("true" = pred)::INT), 6) AS accuracy FROM s WHERE n_words BETWEEN 1 AND 1000 GROUP BY 1"""


@query
def a32_confusion(spark, sf):
    """Confusion matrix."""
    return evaluation.confusion(scored(spark, sf), ["hi", "bho", "mai", "awa", "mwr", "en"])


S["a32_confusion"] = f"""WITH {SCORED} SELECT "true", """ + ", ".join(f"count(*) FILTER (pred = '{x}') AS {x}" for x in ("hi", "bho", "mai", "awa", "mwr", "en")) + " FROM s GROUP BY 1"


@query
def a33_class_report(spark, sf):
    """Precision, recall and F1 per class."""
    r = evaluation.class_report(scored(spark, sf))
    return r.select("label", *[R6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


S["a33_class_report"] = f"""WITH {SCORED}, t AS (SELECT "true" AS label, count(*) AS t, count(*) FILTER ("true" = pred) AS h FROM s GROUP BY 1), p AS (SELECT pred AS label, count(*) AS p FROM s GROUP BY 1),
q AS (SELECT label, coalesce(t, 0) AS t, coalesce(h, 0) AS h, coalesce(p, 0) AS p FROM t FULL JOIN p USING (label))
SELECT label, round(coalesce(h / nullif(p, 0), 0), 6) AS precision, round(coalesce(h / nullif(t, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * h / nullif(t + p, 0), 0), 6) AS f1, t AS support FROM q"""


@query
def a34_class_summary(spark, sf):
    """Recall, top-2, family and confidence when right and wrong, per class."""
    r = evaluation.class_summary(scored(spark, sf), FAMILIES)
    return r.select("true", "n", *[R6(c).alias(c) for c in ("recall", "top2", "family", "confidence_right", "confidence_wrong")])


S["a34_class_summary"] = f"""WITH {SCORED} SELECT "true", count(*) AS n, round(avg(("true" = pred)::INT), 6) AS recall, round(avg(("true" = pred OR "true" = second)::INT), 6) AS top2, round(avg({_SAME_FAMILY}), 6) AS family, round(avg(p) FILTER ("true" = pred), 6) AS confidence_right, round(avg(p) FILTER ("true" <> pred), 6) AS confidence_wrong FROM s GROUP BY 1"""


@query
def a35_balanced_recall(spark, sf):
    """Recall over rows and balanced over groups."""
    r = evaluation.balanced_recall(scored(spark, sf))
    return r.select("true", "n", "groups", *[R6(c).alias(c) for c in ("row_recall", "group_recall", "largest_share", "gap")])


S["a35_balanced_recall"] = f"""WITH {SCORED}, g AS (SELECT "true", grp, count(*) AS n, avg(("true" = pred)::INT) AS r FROM s GROUP BY ALL)
SELECT "true", sum(n) AS n, count(*) AS groups, round(sum(r * n) / sum(n), 6) AS row_recall, round(avg(r), 6) AS group_recall, round(max(n) / sum(n), 6) AS largest_share, round(sum(r * n) / sum(n) - avg(r), 6) AS gap FROM g GROUP BY 1"""


@query
def a36_seed_stability(spark, sf):
    """Recall over seeds."""
    r = evaluation.seed_stability(scored(spark, sf))
    return r.select("true", "seeds", *[R6(c).alias(c) for c in ("mean", "median", "lowest", "highest", "spread")], "verdict")


S["a36_seed_stability"] = f"""WITH {SCORED}, g AS (SELECT "true", seed, avg(("true" = pred)::INT) AS r FROM s GROUP BY ALL), m AS (SELECT "true", count(*) AS seeds, avg(r) AS mean, median(r) AS median, min(r) AS lowest, max(r) AS highest FROM g GROUP BY 1)
SELECT "true", seeds, round(mean, 6) AS mean, round(median, 6) AS median, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(highest - lowest, 6) AS spread, CASE WHEN highest - lowest > 0.20 THEN 'UNSTABLE' WHEN highest - lowest > 0.10 THEN 'borderline' ELSE 'stable' END AS verdict FROM m"""


# ---- similarity

def _table(spark, sf):
    d = documents(spark, sf).where("source is not null and variety is not null")
    w = d.select(F.col("source").alias("grp"), F.explode(F.array_distinct(F.split(F.regexp_replace("text", "[ \n]+", " "), " "))).alias("item"))
    return w.where("item <> ''").groupBy("grp", "item").agg(F.count("*").cast("double").alias("value"))


_TABLE = f"""{DOCUMENTS}, g AS (SELECT grp, item, count(*)::DOUBLE AS value FROM (SELECT source AS grp, unnest(list_distinct(string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' '))) AS item FROM d WHERE source IS NOT NULL AND variety IS NOT NULL) WHERE item <> '' GROUP BY ALL),
i AS (SELECT item, count(*) AS groups, ln((SELECT count(DISTINCT grp) FROM g) / count(*)) AS idf FROM g GROUP BY 1)"""


@query
def a37_idf(spark, sf):
    """Inverse group frequency of words over sources."""
    return similarity.idf(_table(spark, sf)).withColumn("idf", R6("idf"))


S["a37_idf"] = f"WITH {_TABLE} SELECT item, groups, round(idf, 6) AS idf FROM i"


@query
def a41_group_similarity(spark, sf):
    """Cosine, Jaccard, rank correlation and verdict of each pair of sources."""
    s = similarity.group_similarity(_table(spark, sf))
    return s.select("a", "b", "shared", R6("cosine").alias("cosine"), R6("jaccard").alias("jaccard"), R6("spearman").alias("spearman"), "verdict")


_SIMILAR = f"""{_TABLE}, w AS (SELECT grp, item, value, value * idf AS w FROM g JOIN i USING (item)), n AS (SELECT grp, CASE WHEN sqrt(sum(w * w)) = 0 THEN 1 ELSE sqrt(sum(w * w)) END AS norm, count(*) AS items FROM w GROUP BY 1),
x AS (SELECT a.grp AS a, b.grp AS b, a.value AS va, b.value AS vb, a.w AS wa, b.w AS wb FROM w a JOIN w b USING (item) WHERE a.grp < b.grp),
k AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2 AS rb FROM x),
p AS (SELECT a, b, count(*) AS shared, sum(wa * wb) AS dot, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM k GROUP BY ALL),
f AS (SELECT na.grp AS a, nb.grp AS b, coalesce(shared, 0) AS shared, coalesce(dot, 0) / (na.norm * nb.norm) AS cosine, coalesce(shared, 0) / (na.items + nb.items - coalesce(shared, 0)) AS jaccard, CASE WHEN shared >= 4 THEN rho END AS spearman
  FROM n na JOIN n nb ON na.grp < nb.grp LEFT JOIN p ON p.a = na.grp AND p.b = nb.grp),
v AS (SELECT *, (cosine > 0.35)::INT + (jaccard > 0.12)::INT + coalesce((spearman > 0.3)::INT, 0) AS signals FROM f)"""
S["a41_group_similarity"] = f"WITH {_SIMILAR} SELECT a, b, shared, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, round(spearman, 6) AS spearman, CASE WHEN shared < 3 OR signals = 0 THEN 'UNSUPPORTED' WHEN signals = 1 THEN 'WEAK' WHEN signals = 2 THEN 'MODERATE' ELSE 'STRONG' END AS verdict FROM v"


@query
def w10_partners(spark, sf):
    """Each source's four closest others."""
    return similarity.partners(similarity.group_similarity(_table(spark, sf))).select("grp", "partner", R6("cosine").alias("cosine"), "position")


S["w10_partners"] = f"WITH {_SIMILAR} SELECT grp, partner, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY grp ORDER BY cosine DESC, partner) AS position FROM (SELECT a AS grp, b AS partner, cosine FROM f UNION ALL SELECT b, a, cosine FROM f) QUALIFY position <= 4"


# ---- alignment: how each variety renders the anchor, word by word

def _aligned(spark, sf):
    r = records(spark, sf).where("variety is not null and target_text is not null")
    return align.aligned(r.select("id", "variety", "split", "anchor_text", "target_text"), ["id", "variety", "split"], X.tokens("target_text"), X.tokens("anchor_text"))


@query
def l4_edit_summary(spark, sf):
    """Edit rate per variety."""
    return align.edit_summary(_aligned(spark, sf), "variety").withColumn("edit_rate", R6("edit_rate"))


@query
def a18_top_changes(spark, sf):
    """Most frequent substitutions, deletions and insertions per variety."""
    st = align.steps(_aligned(spark, sf), ["variety"])
    parts = [align.top_changes(st, "variety", k, n).withColumn("kind", F.lit(k)) for k, n in (("replace", 40), ("delete", 30), ("insert", 30))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def a19_recurring(spark, sf):
    """Substitutions among the most frequent of several varieties."""
    return align.recurring(align.top_changes(align.steps(_aligned(spark, sf), ["variety"]), "variety", "replace", 8), "variety")


@query
def l2_coverage(spark, sf):
    """Where each word of the anchor comes from (L2)."""
    return align.coverage(_aligned(spark, sf), ["variety"]).groupBy("variety", F.when(F.col("source").isin("EQUAL", "INSERTED", "OTHER_MULTIWORD"), F.col("source")).otherwise("WORD").alias("kind")).agg(F.count("*").alias("words"))


@query
def a20_rules(spark, sf):
    """Word rules with support, forward and reverse precision."""
    return align.rules(align.coverage(_aligned(spark, sf), ["variety"]), 3)


def _halves(spark, sf):
    c = align.coverage(_aligned(spark, sf), ["split", "variety"])
    return c.where("split = 'train'"), c.where("split <> 'train'")


@query
def a21_rule_sweep(spark, sf):
    """Rules of the training records applied to the others, in nine settings."""
    c = align.coverage(_aligned(spark, sf), ["id", "split"]).withColumnRenamed("id", "clip")
    return align.rule_sweep(c.where("split = 'train'"), c.where("split <> 'train'")).withColumns({k: R6(k) for k in ("improved", "worsened")})


@query
def a22_difference_classes(spark, sf):
    """IGNORE, WRONG and UNSURE substitutions per variety."""
    s = align.substitutions(align.steps(_aligned(spark, sf), ["variety"]), ["variety"]).groupBy("variety", "source", "target").agg(F.count("*").alias("n"))
    return s.withColumn("kind", X.pair_class("source", "target")).groupBy("variety").pivot("kind", ["IGNORE", "WRONG", "UNSURE"]).agg(F.sum("n")).na.fill(0)


@query
def a23_consequences(spark, sf):
    """Much changed words per variety: of the same work, of another, or undecided."""
    s = align.substitutions(align.steps(_aligned(spark, sf), ["variety"]), ["variety"]).groupBy("variety", "source", "target").agg(F.count("*").alias("n"))
    return s.withColumn("kind", X.consequence("source", "target")).where("kind is not null").groupBy("variety", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("pairs"))


@query
def a24_edit_mix(spark, sf):
    """Shares of kinds of change."""
    return align.edit_mix(_aligned(spark, sf)).withColumn("share", R6("share"))


@query
def a25_error_flags(spark, sf):
    """Flagging words by their training error rate."""
    return align.error_flags(*_halves(spark, sf))


@query
def a26_candidate_recall(spark, sf):
    """Whether the true word is among the first candidates."""
    s = align.substitutions(align.steps(_aligned(spark, sf), ["split", "variety"]), ["split", "variety"])
    halves = s.where("split = 'train'"), s.where("split <> 'train'")
    return align.candidate_recall(*halves).withColumn("ranked", F.lit("pooled")).unionByName(align.candidate_recall(*halves, by=("variety",)).withColumn("ranked", F.lit("by variety")))


@query
def a27_word_fates(spark, sf):
    """What becomes of marker words."""
    return align.word_fates(_aligned(spark, sf), ["variety"], ["बानी", "आउर", "खातिर", "अहै", "छी"]).groupBy("variety", "word", "fate").agg(F.count("*").alias("n"))


@query
def a27_negation_fates(spark, sf):
    """Whether negations survive."""
    return align.negation_fates(_aligned(spark, sf), ["variety"])


@query
def a48_wilson_gate(spark, sf):
    """Which words have a safe counterpart: fuzzy alignment, Wilson bound, entropy."""
    r = records(spark, sf).where("variety is not null and target_text is not null")
    fates = align.fuzzy_fates(r.select("id", "anchor_text", "target_text"), ["id"], X.tokens("target_text"), X.tokens("anchor_text"))
    return evaluation.wilson_gate(fates)


# ---- routing

@query
def r1_evidence(spark, sf):
    """Marker hits in the turns."""
    return routing.evidence(reviews(spark, sf).where("recognized_text is not null"), "id", "recognized_text")


@query
def r2_labels(spark, sf):
    """Labels of the turns by the decision table, and their routes."""
    p = routing.propose(reviews(spark, sf).where("recognized_text is not null"), "id", "recognized_text")
    return p.select(F.array_join("labels", "+").alias("labels"), "rule", routing.matches_route(F.col("labels"), F.lit("hi-IN")).alias("matches")).groupBy("labels", "rule", "matches").agg(F.count("*").alias("n"))


@query
def r3_routes(spark, sf):
    """How each source of documents would be sent and shown if it were a label."""
    labels = table(spark, sf, "source_targets").select(F.concat("source", F.lit("_candidate")).alias("label"))
    known = table(spark, sf, "region").where("r_regionkey = 0").select(F.explode(F.array(*[F.lit(x) for x in ("hindi", "bhojpuri_candidate", "related_variety_uncertain", "other_or_insufficient")])).alias("label"))
    return labels.union(known).select("label", routing.route("label").alias("r")).select("label", "r.*")


S["r3_routes"] = """WITH l AS (SELECT source || '_candidate' AS label FROM source_targets UNION ALL SELECT unnest(['hindi', 'bhojpuri_candidate', 'related_variety_uncertain', 'other_or_insufficient']) FROM region WHERE r_regionkey = 0),
d AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(label, '_candidate$', ''), '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name, label IN ('hindi', 'bhojpuri_candidate', 'related_variety_uncertain') AS known FROM l)
SELECT label, CASE WHEN known THEN 'hi-IN' END AS code, label NOT IN ('hindi', 'other_or_insufficient') AS workaround,
CASE label WHEN 'hindi' THEN 'Hindi' WHEN 'related_variety_uncertain' THEN 'Related variety, uncertain; recognized using Hindi mode.' WHEN 'other_or_insufficient' THEN 'Other language or insufficient speech; no recognition mode chosen'
ELSE 'Likely ' || name || CASE WHEN known THEN '; recognized using Hindi mode.' ELSE '; no recognition mode configured' END END AS display FROM d"""


@query
def r4_labelled(spark, sf):
    """Turns with their proposed parts and routes beside the code they were recognised with."""
    r = reviews(spark, sf).where("recognized_text is not null")
    return routing.labelled(r, "id", "recognized_text", F.lit("hi-IN")).groupBy("mixed", "matches_route", "summary").agg(F.count("*").alias("n"))


# ---- turns

def _turns(spark, sf):
    r = reviews(spark, sf).groupBy("conversation_id", turns.turn_no("turn_id").alias("turn")).agg(F.min("recognized_text").alias("text"), F.min("reply_text").alias("reply"), F.min("understood").alias("understood"))
    return r.withColumnRenamed("conversation_id", "conv")


_TURNS = f"{REVIEWS}, t AS (SELECT conversation_id AS conv, CAST(regexp_extract(turn_id, '([0-9]+)', 1) AS INT) AS turn, min(recognized_text) AS text, min(reply_text) AS reply, bool_and(understood) AS understood FROM b GROUP BY ALL)"


@query
def w5_context(spark, sf):
    """Each turn's context: of the last six turns those understood."""
    c = turns.with_context(_turns(spark, sf))
    return c.select("conv", "turn", F.size("context").alias("messages"), F.md5(turns.transcript(F.col("context"))).alias("digest"))


S["w5_context"] = f"""WITH {_TURNS}, c AS (SELECT conv, turn, list_filter(list(struct_pack(text, reply, ok := coalesce(understood, true))) OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), lambda x: x.ok) AS past FROM t)
SELECT conv, turn, coalesce(len(past), 0) * 2 AS messages, md5(coalesce(array_to_string(list_transform(past, lambda x: 'user: ' || coalesce(x.text, '') || chr(10) || 'assistant: ' || coalesce(x.reply, '')), chr(10)), '')) AS digest FROM c"""


@query
def w4_positions(spark, sf):
    """Turns numbered in the order in which they were written."""
    return turns.positions(reviews(spark, sf).select("id", "conversation_id", "created"), "conversation_id", ["created", "id"], F.date_trunc("hour", "created")).select("id", "position")


S["w4_positions"] = f"WITH {REVIEWS} SELECT id, row_number() OVER (PARTITION BY conversation_id ORDER BY created, id) AS position FROM b"


@query
def w11_pooled_evidence(spark, sf):
    """Lexicon forms over each turn and the last six."""
    forms = markers.log_odds(_counts(spark, sf), 40).where("z >= 5").groupBy("word").agg((F.count("*") > 1).alias("shared"))
    t = _turns(spark, sf).where("text is not null")
    return turns.pooled_evidence(t, forms, X.devanagari_words("text")).groupBy("enough").agg(F.count("*").alias("turns"), F.sum("forms").alias("forms"))


S["w11_pooled_evidence"] = f"""WITH {_COUNTS}, a AS (SELECT word, sum(n) AS all_n FROM c GROUP BY 1), y AS (SELECT count(*) AS v, sum(all_n) AS everything FROM a),
q AS (SELECT variety, word, n, all_n - n AS rest, ln(((n + 1.0::DOUBLE) / (total + 1.0::DOUBLE * v)) / ((all_n - n + 1.0::DOUBLE) / (everything - total + 1.0::DOUBLE * v))) AS odds FROM c JOIN a USING (word) JOIN vt USING (variety), y WHERE n >= 3),
f AS (SELECT variety, word, round(odds / sqrt(1.0::DOUBLE / (n + 1) + 1.0::DOUBLE / (rest + 1)), 1) AS z FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY variety ORDER BY z DESC, word) AS position FROM f QUALIFY position <= 40),
l AS (SELECT word, count(*) > 1 AS shared FROM o WHERE z >= 5 GROUP BY 1), {_TURNS},
u AS (SELECT conv, turn, text, row_number() OVER (PARTITION BY conv ORDER BY turn) AS pos FROM t WHERE text IS NOT NULL),
h AS (SELECT DISTINCT conv, pos, word, shared FROM (SELECT conv, pos, unnest({WORDS_SQL.format('text')}) AS word FROM u) JOIN l USING (word)),
e AS (SELECT u.conv, u.turn, h.word, shared FROM u JOIN h ON u.conv = h.conv AND h.pos BETWEEN u.pos - 6 AND u.pos GROUP BY ALL),
p AS (SELECT conv, turn, count(*) FILTER (NOT shared) AS forms FROM e GROUP BY ALL)
SELECT forms >= 2 AS enough, count(*) AS turns, sum(forms) AS forms FROM p GROUP BY 1"""


@query
def j9_prompts(spark, sf):
    """Prompts of nested examples for each held-out record."""
    r = records(spark, sf).where("target_text is not null")
    shots = splits.nested_samples(r.where("split = 'train'").select("id", "anchor_text", "target_text"), "id", (2, 5))
    return turns.render_prompts(shots, r.where("split = 'test'"), "Hindi", "the variety").select("size", "id", F.md5("prompt").alias("digest"))


S["j9_prompts"] = f"""WITH {RECORDS}, f AS (SELECT * FROM r WHERE target_text IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || id)) AS position FROM f WHERE split = 'train' QUALIFY position <= 5),
e AS (SELECT size, string_agg('Hindi: ' || anchor_text || chr(10) || 'the variety: ' || target_text, chr(10) || chr(10) ORDER BY position) AS examples FROM o JOIN (VALUES (2), (5)) s(size) ON position <= size GROUP BY 1)
SELECT size, id, md5('Translate from Hindi to the variety.' || chr(10) || chr(10) || examples || chr(10) || chr(10) || 'Hindi: ' || anchor_text || chr(10) || 'the variety:') AS digest FROM f, e WHERE split = 'test'"""


@query
def pr_cited_rules(spark, sf):
    """Learned rules held against the examples that were shown (P10)."""
    k = table(spark, sf, "rating_key")
    shown = k.select(F.col("item_id").alias("id")).where("system_1 = '10' or system_2 = '10'")
    made = k.select(F.col("item_id").alias("rule_id"), F.array("item_id", F.concat("item_id", F.when(F.col("system_1") == "0", "x").otherwise(""))).alias("ids"), (F.length("anchor_text") / 80.0).alias("confidence"))
    return turns.cited_rules(made.withColumn("ids", F.array_distinct("ids")), shown).select("rule_id", "problem")


S["pr_cited_rules"] = """WITH m AS (SELECT item_id, system_1, system_2, length(anchor_text) / 80.0::DOUBLE AS c, system_1 = '10' OR system_2 = '10' AS known FROM rating_key),
u AS (SELECT *, list_filter([CASE WHEN NOT known THEN item_id END, CASE WHEN system_1 = '0' THEN item_id || 'x' END], lambda x: x IS NOT NULL) AS unknown FROM m)
SELECT item_id AS rule_id, CASE WHEN len(unknown) > 0 THEN 'not shown: ' || array_to_string(unknown, ', ') WHEN NOT coalesce(c BETWEEN 0 AND 1, false) THEN 'confidence outside 0 to 1' END AS problem FROM u"""


@query
def a8_outcomes(spark, sf):
    """Events by outcome with their sums."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value"), F.count_if(F.col("props").isNotNull()).alias("with_props"))


S["a8_outcomes"] = "SELECT event_type, count(*) AS n, round(sum(value), 3) AS value, count(props) AS with_props FROM events GROUP BY 1"


@query
def w6_running_totals(spark, sf):
    """Running value of each user's successful events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.select("event_id", "user_id", F.coalesce(F.count("*").over(w), F.lit(0)).alias("before"), F.round(F.coalesce(F.sum("value").over(w), F.lit(0.0)), 3).alias("spent"))


S["w6_running_totals"] = "SELECT event_id, user_id, coalesce(count(*) OVER w, 0) AS before, round(coalesce(sum(value) OVER w, 0), 3) AS spent FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query
def a43_json_object(spark, sf):
    """Per conversation and 256 numbers its turns as one JSON object (A43): an object is never larger, however long the conversation."""
    part = F.floor(F.col("turn") / 256)
    t = _turns(spark, sf).where("conv is not null and turn is not null").groupBy("conv", part.alias("part")).agg(F.count("*").alias("turns"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string"), F.col("understood"))))).alias("m"))
    return t.select("conv", "part", "turns", F.to_json("m").alias("understood"))


S["a43_json_object"] = f"""WITH {_TURNS} SELECT conv, turn // 256 AS part, count(*) AS turns, '{{' || string_agg('"' || turn::VARCHAR || '":' || coalesce(understood::VARCHAR, 'null'), ',' ORDER BY turn::VARCHAR) || '}}' AS understood FROM t WHERE conv IS NOT NULL AND turn IS NOT NULL GROUP BY ALL"""


@query
def j11_referenced(spark, sf):
    """Held-out records whose speaker also has training records."""
    r = records(spark, sf).where("trim(speaker_id) <> ''")
    live = r.where("split = 'train'").select("speaker_id")
    return r.where("split <> 'train'").join(live, "speaker_id", "left_semi").select("id")


S["j11_referenced"] = f"WITH {RECORDS}, a AS (SELECT * FROM r WHERE trim(speaker_id) <> '') SELECT id FROM a WHERE split <> 'train' AND EXISTS (SELECT 1 FROM a b WHERE b.split = 'train' AND b.speaker_id = a.speaker_id)"


@query
def z6_saved_flags(spark, sf):
    """Per call which conditions have a saved result."""
    e = table(spark, sf, "experiment_evon_results").select(F.substring_index("result_key", "_", 1).alias("item"), "condition").distinct()
    return e.groupBy("item").agg(F.max((F.col("condition") == "A_raw").cast("int")).alias("raw"), F.max((F.col("condition") == "B_context").cast("int")).alias("context"))


S["z6_saved_flags"] = "SELECT split_part(result_key, '_', 1) AS item, max((condition = 'A_raw')::INT) AS raw, max((condition = 'B_context')::INT) AS context FROM experiment_evon_results GROUP BY 1"

QUERIES, SQL = Q, S
