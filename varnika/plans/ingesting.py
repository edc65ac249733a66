"""Queries: scans, sinks, ingest, hashes, splits, leakage, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from varnika.operators import ingest, splits
from varnika.plans.common import DOCUMENTS, RECORDS, STRIP_SQL, documents, records
from varnika.session import table

Q, S = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _mapped(spark, sf):
    raw = table(spark, sf, "dataset_records").withColumnsRenamed({"anchor_text": "src", "target_text": "dst", "id": "key"})
    own = {"id": "key", "anchor_text": "src", "target_text": "dst", "audio_path": "audio_path", "speaker_id": "speaker_id", "source": "source", "license": "license", "split": "split", "target_language": "target_language"}
    return ingest.canonical(raw, own, {"anchor_language": "hi"})




@query
def a1_ingest_report(spark, sf):
    """Counters of reading, validating and storing the pairs."""
    status = ingest.ingest_status(_mapped(spark, sf), F.lit(0))
    return ingest.ingest_report(status, table(spark, sf, "dataset_records").where("split = 'train'").select(F.trim("audio_path").alias("audio_path")))


_st = lambda c: STRIP_SQL.format(c)
S["a1_ingest_report"] = f"""
WITH c AS (SELECT nullif({_st('id')}, '') AS id, coalesce({_st('target_language')}, '') AS tl, coalesce({_st('anchor_text')}, '') AS a, coalesce({_st('target_text')}, '') AS t,
  nullif({_st('audio_path')}, '') AS audio, coalesce({_st('source')}, '') AS s, coalesce({_st('license')}, '') AS l, nullif({_st('split')}, '') AS sp FROM dataset_records),
e AS (SELECT *, (tl = '' OR a = '' OR t = '' OR s = '' OR l = '' OR coalesce(sp NOT IN ('train', 'validation', 'test'), false)) AS bad FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY bad, id) AS k FROM e)
SELECT count(*) AS read, count(*) FILTER (NOT bad AND k = 1) AS written, count(*) FILTER (bad) AS invalid, count(*) FILTER (NOT bad AND k > 1) AS duplicates,
  count(*) FILTER (NOT bad AND k = 1 AND audio IS NOT NULL AND audio NOT IN (SELECT trim(audio_path) FROM dataset_records WHERE split = 'train' AND audio_path IS NOT NULL)) AS missing_audio FROM n"""


@query
def s7_transcript_scan(spark, sf):
    """Turns without error whose text and reply are filled; the filters reach the scan."""
    return table(spark, sf, "boli_reviews").where("error_code is null and recognized_text <> '' and reply_text <> ''").select("id", "recognized_text", "reply_text").distinct()


S["s7_transcript_scan"] = "SELECT DISTINCT id, recognized_text, reply_text FROM boli_reviews WHERE error_code IS NULL AND recognized_text <> '' AND reply_text <> ''"


@query
def s8_classifier_scan(spark, sf):
    """Documents with text, their group of three fields (None where null) and number of words."""
    d = table(spark, sf, "documents").where("text is not null and trim(text) <> ''")
    group = F.concat_ws("|", *[F.coalesce(c, F.lit("None")) for c in ("source", "lang")], F.coalesce(F.date_format("collected_at", "yyyy-MM"), F.lit("None")))
    return d.select("doc_id", group.alias("grp"), F.size(F.split(F.trim(F.regexp_replace("text", "[ \n]+", " ")), " ")).alias("n_words"))


S["s8_classifier_scan"] = r"""SELECT doc_id, coalesce(source, 'None') || '|' || coalesce(lang, 'None') || '|' || coalesce(strftime(collected_at, '%Y-%m'), 'None') AS grp,
len(string_split(trim(regexp_replace(text, '[ \n]+', ' ', 'g')), ' ')) AS n_words FROM documents WHERE text IS NOT NULL AND trim(text) <> ''"""


@query
def s9_column_counts(spark, sf):
    """Text and audio columns found by their names, with how many rows fill them (schema search on the driver, one scan)."""
    from varnika.sources.readers import find_columns

    df = table(spark, sf, "boli_reviews")
    found = find_columns(df, ("text", "audio"))
    row = F.array(*[F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNotNull() & (F.octet_length(c) > 0)).alias("filled")) for c in found])
    return df.agg(F.explode(row).alias("x")).select("x.*")


S["s9_column_counts"] = "SELECT 'audio' AS name, count(*) FILTER (octet_length(audio) > 0) AS filled FROM boli_reviews UNION ALL SELECT 'recognized_text', count(*) FILTER (recognized_text <> '') FROM boli_reviews UNION ALL SELECT 'reply_text', count(*) FILTER (reply_text <> '') FROM boli_reviews"


@query
def s10_capped_scan(spark, sf):
    """The first hundred documents of each source by id (the cap is the feature)."""
    from varnika.sources.readers import capped

    return capped(table(spark, sf, "documents"), "source", 100, "doc_id").select("doc_id", "source")


S["s10_capped_scan"] = "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100"


@query
def s15_recent_rows(spark, sf):
    """Reviews of the last thirty days before the latest one (retention, P15)."""
    r = table(spark, sf, "boli_reviews").select("id", "created").distinct()
    last = r.agg(F.max("created").alias("last"))
    return ingest.retained(r.crossJoin(F.broadcast(last)), "created", F.col("last"), 30).select("id", F.date_format("created", "yyyy-MM-dd").alias("day"))


S["s15_recent_rows"] = "WITH r AS (SELECT DISTINCT id, created FROM boli_reviews) SELECT id, strftime(created, '%Y-%m-%d') AS day FROM r WHERE created >= (SELECT max(created) FROM r) - INTERVAL 30 DAY"


@query
def s16_json_field(spark, sf):
    """Fields read from JSON text by path."""
    r = table(spark, sf, "boli_reviews").select("id", F.get_json_object("recognition", "$.language").alias("language"), F.get_json_object("reply", "$.model").alias("model")).distinct()
    return r.groupBy("language", "model").agg(F.count("*").alias("n"))


S["s16_json_field"] = "WITH r AS (SELECT DISTINCT id, json_extract_string(recognition, '$.language') AS language, json_extract_string(reply, '$.model') AS model FROM boli_reviews) SELECT language, model, count(*) AS n FROM r GROUP BY ALL"


@query
def k8_insert_new(spark, sf):
    """Train records, and of the others those whose anchor is new, one each."""
    r = records(spark, sf).select("id", "anchor_text", "split")
    return ingest.insert_new(r.where("split = 'train'").select("anchor_text", "id"), r.where("split <> 'train'").select("anchor_text", "id"), "anchor_text")


S["k8_insert_new"] = f"WITH {RECORDS}, t AS (SELECT anchor_text, id FROM r WHERE split = 'train') SELECT * FROM t UNION ALL SELECT anchor_text, min(id) FROM r WHERE split <> 'train' AND anchor_text NOT IN (SELECT anchor_text FROM t) GROUP BY 1"


@query
def k9_update_by_key(spark, sf):
    """Rating key with the notes and last time of its items' ratings."""
    key = table(spark, sf, "rating_key").select("item_id", "system_1", F.lit(None).cast("bigint").alias("n"))
    changes = table(spark, sf, "rating_records").distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    return ingest.update_by_key(key, changes, "item_id")


S["k9_update_by_key"] = "SELECT k.item_id, system_1, n FROM rating_key k LEFT JOIN (SELECT item_id, count(*) AS n FROM (SELECT DISTINCT * FROM rating_records) GROUP BY 1) c USING (item_id)"


@query
def k10_delete_by_key(spark, sf):
    """Ratings without those of raters who left an unusable one for the same item."""
    r = table(spark, sf, "rating_records").distinct()
    return ingest.delete_by_key(r, r.where("choice is null or choice in ('', ' ', '?', 'skip', '3')"), "item_id", "rater_id").groupBy("rater_id").agg(F.count("*").alias("n"))


S["k10_delete_by_key"] = """WITH r AS (SELECT DISTINCT * FROM rating_records), g AS (SELECT DISTINCT item_id, rater_id FROM r WHERE choice IS NULL OR choice IN ('', ' ', '?', 'skip', '3'))
SELECT rater_id, count(*) AS n FROM r ANTI JOIN g USING (item_id, rater_id) GROUP BY 1"""


@query
def h1_content_id(spark, sf):
    """Content id of each pair."""
    return records(spark, sf).select("id", ingest.content_id("anchor_text", "target_text").alias("content_id"))


S["h1_content_id"] = f"WITH {RECORDS} SELECT id, substring(sha256(nfc_normalize({_st('anchor_text')} || chr(31) || {_st('target_text')})), 1, 12) AS content_id FROM r"


@query
def h4_swap_bit(spark, sf):
    """Blinded order of the two systems of each rated item, and its short id (H2, H4, H5)."""
    k = table(spark, sf, "rating_key")
    swap = splits.swap_bit(42, "item_id")
    return k.select("item_id", F.substring(splits.hash_order(42, "item_id"), 1, 16).alias("short_id"), F.when(swap, F.col("system_2")).otherwise(F.col("system_1")).alias("first"), F.when(swap, F.col("system_1")).otherwise(F.col("system_2")).alias("second"))


_SWAP = "CAST('0x' || substring(sha256('42:' || item_id || ':swap'), 1, 2) AS INTEGER) % 2 = 1"
S["h4_swap_bit"] = f"SELECT item_id, substring(sha256('42:' || item_id), 1, 16) AS short_id, CASE WHEN {_SWAP} THEN system_2 ELSE system_1 END AS first, CASE WHEN {_SWAP} THEN system_1 ELSE system_2 END AS second FROM rating_key"


@query
def w1_ordered_split(spark, sf):
    """The pairs' splits in hash order of their anchor texts, groups kept together."""
    return splits.ordered_split(records(spark, sf).drop("split"), "anchor_text", "id").select("id", "split")


_W1 = """g AS (SELECT coalesce(nullif({group}, ''), id) AS g, count(*) AS n FROM r GROUP BY 1),
o AS (SELECT *, sum(n) OVER (ORDER BY sha256('42:' || g)) - n AS before, sum(n) OVER () AS total FROM g),
t AS (SELECT *, before < round_even(total * 0.8, 0) AS train FROM o),
a AS (SELECT sum(n) FILTER (train) AS taken FROM t),
f AS (SELECT g, CASE WHEN train THEN 'train' WHEN before - taken < round_even(total * 0.1, 0) THEN 'validation' ELSE 'test' END AS new_split FROM t, a)"""
S["w1_ordered_split"] = f"WITH {RECORDS}, {_W1.format(group='anchor_text')} SELECT id, new_split AS split FROM r JOIN f ON coalesce(nullif(anchor_text, ''), id) = f.g"


@query
def a3_split_counts(spark, sf):
    """Rows per split when speakers are kept together."""
    return splits.split_counts(splits.ordered_split(records(spark, sf).drop("split"), "speaker_id", "id"))


S["a3_split_counts"] = f"WITH {RECORDS}, {_W1.format(group='speaker_id')} SELECT new_split AS split, count(*) AS n FROM r JOIN f ON coalesce(nullif(speaker_id, ''), id) = f.g GROUP BY 1"


@query
def w2_partition_groups(spark, sf):
    """Sources and months of documents as groups, those of one source forced to development."""
    d = table(spark, sf, "documents").where("source is not null and collected_at is not null")
    g = d.groupBy(F.concat("source", F.lit(":"), F.date_format("collected_at", "yyyy-MM")).alias("grp")).agg(F.max(F.startswith("source", F.lit("web"))).alias("forced"))
    return splits.partition_groups(g, "grp", "forced").select("grp", "part")


S["w2_partition_groups"] = """WITH g AS (SELECT source || ':' || strftime(collected_at, '%Y-%m') AS grp, bool_or(starts_with(source, 'web')) AS forced FROM documents WHERE source IS NOT NULL AND collected_at IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || grp)) - 1 AS place, count(*) OVER () AS total FROM g),
l AS (SELECT *, sum(CASE WHEN NOT forced AND place >= round_even(total * 0.5, 0) THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM o)
SELECT grp, CASE WHEN forced OR place < round_even(total * 0.5, 0) THEN 'development' WHEN coalesce(late, 0) < round_even(total * 0.25, 0) THEN 'validation' ELSE 'test' END AS part FROM l"""


@query
def w3_nested_samples(spark, sf):
    """Nested samples of train records: the first 10, 25, 50 and 100 in hash order."""
    return splits.nested_samples(records(spark, sf).where("split = 'train'").select("id"), "id", (10, 25, 50, 100)).select("size", "position", "id")


S["w3_nested_samples"] = f"WITH {RECORDS}, o AS (SELECT id, row_number() OVER (ORDER BY sha256('42:' || id)) AS position FROM r WHERE split = 'train') SELECT size, position, id FROM o JOIN (VALUES (10), (25), (50), (100)) s(size) ON position <= size"


@query
def j7_leakage(spark, sf):
    """Ids, anchors and targets shared by train and held-out records."""
    r = records(spark, sf)
    return splits.leakage(r.where("split = 'train'"), r.where("split in ('validation', 'test')"))


S["j7_leakage"] = f"WITH {RECORDS} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(DISTINCT {f}) AS shared, min({f}) AS example FROM r WHERE split = 'train' AND {f} IN (SELECT {f} FROM r WHERE split IN ('validation', 'test') AND {f} IS NOT NULL)" for f in ("id", "anchor_text", "target_text")
)


@query
def j5_not_done(spark, sf):
    """Prompts (conditions A) whose raw run has no context run yet."""
    e = table(spark, sf, "experiment_evon_results").select(F.substring_index("result_key", "_", 1).alias("item"), "condition").distinct()
    return e.where("condition = 'A_raw'").select("item").join(e.where("condition = 'B_context'").select("item"), "item", "left_anti")


S["j5_not_done"] = "SELECT DISTINCT split_part(result_key, '_', 1) AS item FROM experiment_evon_results WHERE condition = 'A_raw' AND split_part(result_key, '_', 1) NOT IN (SELECT split_part(result_key, '_', 1) FROM experiment_evon_results WHERE condition = 'B_context')"


@query
def j13_components(spark, sf):
    """Records joined by equal anchors or equal targets: size of each component with more than one record."""
    r = records(spark, sf)
    key = lambda c, p: r.where(f"trim({c}) <> ''").select("id", F.concat(F.lit(p), F.md5(c)).alias("k"))
    both = key("anchor_text", "a").union(key("target_text", "t"))
    edges = both.select(F.col("id").alias("a"), F.col("k").alias("b"))
    comp = splits.connected_components(edges)
    members = comp.where("node like 'pair%'").groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    return members.where("n > 1").select("first", "n")


S["j13_components"] = f"""WITH RECURSIVE {RECORDS}, e AS (SELECT id, 'a' || anchor_text AS k FROM r WHERE trim(anchor_text) <> '' UNION ALL SELECT id, 't' || target_text FROM r WHERE trim(target_text) <> ''),
m AS (SELECT id, k, min(id) OVER (PARTITION BY k) AS low, count(*) OVER (PARTITION BY k) AS c FROM e),
p AS (SELECT DISTINCT id AS x, low AS y FROM m WHERE c > 1 UNION SELECT DISTINCT low, id FROM m WHERE c > 1),
w(x, y) AS (SELECT x, y FROM p UNION SELECT w.x, p.y FROM w JOIN p ON w.y = p.x)
SELECT first, count(*) AS n FROM (SELECT x, min(y) AS first FROM (SELECT x, y FROM w UNION SELECT x, x FROM w) GROUP BY x) GROUP BY 1 HAVING count(*) > 1"""


@query
def m7_class_split(spark, sf):
    """Documents split by source where their language has enough rows in test and validation, else by row."""
    d = documents(spark, sf).where("variety is not null and source is not null").select("doc_id", "variety", "source")
    return splits.class_split(d, "source", "variety", "doc_id").groupBy("variety", "by_group", "split").agg(F.count("*").alias("n"))


S["m7_class_split"] = f"""WITH {DOCUMENTS}, x AS (SELECT doc_id, variety, source FROM d WHERE variety IS NOT NULL AND source IS NOT NULL),
g AS (SELECT coalesce(nullif(source, ''), doc_id::VARCHAR) AS g, count(*) AS n FROM x GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sha256('42:' || g) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS every FROM g),
t AS (SELECT *, before < round_even(every * 0.6::DOUBLE, 0) AS train FROM o), k AS (SELECT *, coalesce(sum(n) FILTER (train) OVER (), 0) AS taken FROM t),
p AS (SELECT g, CASE WHEN train THEN 'train' WHEN before - taken < round_even(every * 0.2::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS part FROM k),
y AS (SELECT x.*, part, sha256('42:' || doc_id::VARCHAR) AS h FROM x JOIN p ON p.g = coalesce(nullif(source, ''), doc_id::VARCHAR)),
l AS (SELECT variety, count(*) FILTER (part = 'test') >= 15 AND count(*) FILTER (part = 'validation') >= 15 AS by_group FROM y GROUP BY 1),
z AS (SELECT y.variety, by_group, part, ('0x' || h[1:8])::BIGINT / 4294967296.0::DOUBLE AS share FROM y JOIN l USING (variety))
SELECT variety, by_group, CASE WHEN by_group THEN part WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM z GROUP BY ALL"""

QUERIES, SQL = Q, S
