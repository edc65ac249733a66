"""Explainable labelling of texts by marker tables: evidence with places and context, a decision table, routes.

The rules are columns over the tokens of a text; only the tokens with their places come from an Arrow function, as Spark has no
function for the offsets of all matches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from varnika.functions.text import display_name, py_nfc

# Forms that mark the eastern varieties, forms shared with others, standard Hindi forms, names of languages.
EASTERN = (
    "रउआ", "रउरा", "हमनी", "एगो", "कबो", "बानी", "बाड़ू", "बाड़ी", "बाड़े", "बाड़न", "बाटे", "बाटी", "बाटू",
    "रहेला", "जाला", "करेला", "खाला", "आवेला", "अइबा", "जइबा", "चलबू", "जइबू",
)
SHARED = ("बा", "ह", "तू")
HINDI_WORDS = ("मैं", "हूँ", "कभी")
HINDI_PHRASES = (("रहे", "हैं"), ("रहा", "है"), ("रही", "है"))
HINDI_FUTURE = "ेंगे$"
NAMES = {"भोजपुरी": "bhojpuri", "हिंदी": "hindi"}
HEDGES = ("related dialect", "closely related", "or a related")
# Names of rules as they are reported.
RULES = {
    "thin": "too_few_words_or_not_devanagari",
    "two": "two_or_more_distinct_markers",
    "named": "one_marker_and_speaker_names_bhojpuri",
    "hedged": "one_marker_and_speaker_names_bhojpuri_but_saved_assessment_hedges",
    "one": "one_marker_without_speaker_naming_bhojpuri",
    "name": "speaker_names_bhojpuri_but_no_variety_specific_form_recognized",
    "hindi": "two_or_more_distinct_hindi_markers",
    "hindi_named": "one_hindi_marker_and_speaker_names_hindi",
    "supplied": "externally_supplied_evidence",
    "none": "devanagari_text_without_variety_specific_evidence",
}
LEAST_WORDS = 4
CONTEXT = 3

_TOKEN = re.compile(r"[^\s।॥,.?!;:\"'()\[\]\-]+")


def _fold(s: str) -> str:
    return py_nfc(s).replace("‌", "").replace("‍", "").replace("ँ", "ं")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def tokens_with_places(s: pd.Series) -> pd.Series:
    """Words in their folded form with first and last place (in characters of the text as given); none for null."""
    return s.map(lambda x: [{"t": _fold(m.group()), "start": m.start(), "end": m.end()} for m in _TOKEN.finditer(x or "")])


def evidence(texts: DataFrame, row_id: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per hit: row_id, kind, supports, form, start, end, context (three words on each side).

    kind: eastern_marker, shared_form_noted (never counted), standard_hindi_marker (words, plural future, progressive pairs),
    speaker_names_language. ``extra`` adds eastern forms that are not shared ones.
    """
    own = [_fold(x) for x in EASTERN] + [f for x in extra if (f := _fold(x)) not in SHARED]
    toks = texts.select(row_id, tokens_with_places(text).alias("k"))
    rows = toks.select(row_id, "k", F.posexplode("k").alias("i", "x")).withColumn("next", F.get("k", F.col("i") + 1)["t"])
    t = F.col("x.t")
    hit = lambda kind, supports, length=1: F.struct(F.lit(kind).alias("kind"), F.lit(supports).cast("string").alias("supports"), F.lit(length).alias("n"))
    phrase = F.lit(False)
    for a, b in HINDI_PHRASES:
        phrase = phrase | ((t == _fold(a)) & (F.col("next") == _fold(b)))
    named = {v: [_fold(k) for k, x in NAMES.items() if x == v] for v in NAMES.values()}
    hits = F.array_compact(
        F.array(
            F.when(t.isin(own), hit("eastern_marker", "bhojpuri")).when(t.isin([_fold(x) for x in SHARED]), hit("shared_form_noted", None)),
            F.when(t.isin([_fold(x) for x in HINDI_WORDS]) | t.rlike(HINDI_FUTURE), hit("standard_hindi_marker", "hindi")),
            F.when(phrase, hit("standard_hindi_marker", "hindi", 2)),
            *[F.when(t.isin(forms), hit("speaker_names_language", v)) for v, forms in named.items()],
        )
    )
    out = rows.select(row_id, "k", "i", F.explode(hits).alias("h"))
    words = lambda a, n: F.array_join(F.transform(F.slice("k", a, n), lambda x: x["t"]), " ")
    first = F.greatest(F.col("i") - CONTEXT, F.lit(0))
    return out.select(
        row_id, "h.kind", "h.supports", words(F.col("i") + 1, F.col("h.n")).alias("form"),
        F.col("k")[F.col("i")]["start"].alias("start"), F.col("k")[F.col("i") + F.col("h.n") - 1]["end"].alias("end"),
        words(first + 1, F.col("i") + F.col("h.n") + CONTEXT - first).alias("context"),
    )


def hedges(*fields: Column) -> Column:
    """Whether any of the fields says that the language may be a related one."""
    text = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(False)
    for h in HEDGES:
        out = out | F.contains(text, F.lit(h))
    return out


def propose(texts: DataFrame, row_id: str, text: str, hedged: Column | None = None, extra: tuple[str, ...] = (), supplied: DataFrame | None = None) -> DataFrame:
    """row_id, labels (array, Hindi first), rule (of the first part that isn't Hindi, or of Hindi), parts (array of label and rule).

    Fewer than four words or mostly no Devanagari: other_or_insufficient, whatever is supplied. Two different eastern forms:
    bhojpuri_candidate; one and the speaker names Bhojpuri: the same, or related_variety_uncertain if hedged; one alone or the name
    alone: uncertain. Two Hindi forms, or one and the name Hindi: hindi beside it. supplied (row_id, supports): evidence from outside;
    a name in it other than these two languages is a candidate of its own, in the order of names. Nothing at all: uncertain. A null
    text has no words.
    """
    base = texts.select(row_id, tokens_with_places(text).alias("k"), F.coalesce(hedged if hedged is not None else F.lit(False), F.lit(False)).alias("hedged"))
    base = base.select(row_id, "hedged", F.size("k").alias("n"), F.size(F.filter("k", lambda x: x["t"].rlike("[ऀ-ॿ]"))).alias("d"))
    kind = lambda k, s=None: F.col("kind") == k if s is None else (F.col("kind") == k) & (F.col("supports") == s)
    per = evidence(texts, row_id, text, extra).groupBy(row_id).agg(
        F.count_distinct(F.when(kind("eastern_marker"), F.col("form"))).alias("eastern"),
        F.count_distinct(F.when(kind("standard_hindi_marker"), F.col("form"))).alias("hindi"),
        F.count_if(kind("speaker_names_language", "bhojpuri")).alias("names_b"),
        F.count_if(kind("speaker_names_language", "hindi")).alias("names_h"),
    )
    rows = base.join(per, row_id, "left").na.fill(0, ["eastern", "hindi", "names_b", "names_h"])
    outside = F.array().cast("array<string>")
    if supplied is not None:
        named_there = supplied.where("supports is not null and supports not in ('bhojpuri', 'hindi')").groupBy(row_id).agg(F.array_sort(F.collect_set("supports")).alias("outside"))
        rows = rows.join(named_there, row_id, "left")
        outside = F.coalesce("outside", outside)
    e, named = F.col("eastern"), F.col("names_b") > 0
    r = {k: F.lit(v) for k, v in RULES.items()}
    eastern = F.when(e >= 2, r["two"]).when((e == 1) & named, F.when(F.col("hedged"), r["hedged"]).otherwise(r["named"])).when(e == 1, r["one"]).when(named, r["name"])
    hindi = F.when(F.col("hindi") >= 2, r["hindi"]).when((F.col("hindi") == 1) & (F.col("names_h") > 0), r["hindi_named"])
    part = lambda label, rule: F.struct(F.lit(label).alias("label"), rule.alias("rule"))
    found = F.array_compact(
        F.array(
            F.when(hindi.isNotNull(), part("hindi", hindi)),
            F.when(eastern.isin(RULES["two"], RULES["named"]), part("bhojpuri_candidate", eastern)).when(eastern.isNotNull(), part("related_variety_uncertain", eastern)),
        )
    )
    found = F.concat(found, F.transform(outside, lambda x: F.struct(F.concat(x, F.lit("_candidate")).alias("label"), r["supplied"].alias("rule"))))
    thin = (F.col("n") < LEAST_WORDS) | (F.col("d") * 2 < F.col("n"))
    parts = F.when(thin, F.array(part("other_or_insufficient", r["thin"]))).when(F.size(found) == 0, F.array(part("related_variety_uncertain", r["none"]))).otherwise(found)
    out = rows.select(row_id, parts.alias("parts"))
    first = F.coalesce(F.get(F.filter("parts", lambda p: p["label"] != "hindi"), F.lit(0)), F.get("parts", F.lit(0)))
    return out.select(row_id, F.transform("parts", lambda p: p["label"]).alias("labels"), first["rule"].alias("rule"), "parts")


def route(label: Column | str) -> Column:
    """struct(code, workaround, display): in which recognition mode a label is sent and how it is shown."""
    label = F.col(label) if isinstance(label, str) else label
    known = label.isin("hindi", "bhojpuri_candidate", "bundeli_candidate", "related_variety_uncertain")
    shown = (
        F.when(label == "hindi", "Hindi")
        .when(label == "related_variety_uncertain", "Related variety, uncertain")
        .when(label == "other_or_insufficient", "Other language or insufficient speech")
        .otherwise(F.concat(F.lit("Likely "), display_name(label)))
    )
    code = F.when(known, "hi-IN")
    # What is said of the mode.
    mode = F.when(label == "other_or_insufficient", "; no recognition mode chosen").when(code.isNull(), "; no recognition mode configured").when(label == "hindi", "").otherwise("; recognized using Hindi mode.")
    shown = F.concat(shown, mode)
    return F.struct(code.alias("code"), (~label.isin("hindi", "other_or_insufficient")).alias("workaround"), shown.alias("display"))


def matches_route(labels: Column, submitted: Column) -> Column:
    """Whether the codes of all labels are just the code that was submitted."""
    codes = F.array_distinct(F.array_compact(F.transform(labels, lambda x: route(x)["code"])))
    return (F.size(codes) == 1) & (F.get(codes, F.lit(0)) == submitted)


def labelled(texts: DataFrame, row_id: str, text: str, submitted: Column, **rest) -> DataFrame:
    """row_id, submitted, mixed (several parts), parts (label, rule, code, workaround, display), summary, matches_route: the proposal of
    each text with its routes, beside the code that it was recognised with. rest: as in propose()."""
    given = propose(texts, row_id, text, **rest).join(texts.select(row_id, submitted.alias("submitted")).dropDuplicates([row_id]), row_id)
    parts = F.transform("parts", lambda p: F.struct(p["label"].alias("label"), p["rule"].alias("rule"), route(p["label"])["code"].alias("code"), route(p["label"])["workaround"].alias("workaround"), route(p["label"])["display"].alias("display")))
    out = given.select(row_id, "submitted", (F.size("parts") > 1).alias("mixed"), parts.alias("parts"), matches_route(F.col("labels"), F.col("submitted")).alias("matches_route"))
    return out.withColumn("summary", F.concat(F.when(F.col("mixed"), "Mixed: ").otherwise(""), F.array_join(F.transform("parts", lambda p: p["display"]), " | ")))
