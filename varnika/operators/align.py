"""Word alignment of two renderings of one text, and what follows from it: substitutions, fates, rules, recall.

Alignment is the longest-matching-block alignment of Python's difflib, in Arrow batches; everything after it is columns. Each step is
one row: op (equal, replace, delete, insert), the words of both sides.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

OPS = "array<struct<op:string,i1:int,i2:int,j1:int,j2:int,h:array<string>,p:array<string>>>"


def py_align(h: list[str], p: list[str]) -> list[tuple]:
    """All steps, also the equal ones."""
    return [(op, i1, i2, j1, j2, list(h[i1:i2]), list(p[j1:j2])) for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, h, p, autojunk=False).get_opcodes()]


def aligned(df: DataFrame, key: list[str], h: Column, p: Column) -> DataFrame:
    """key columns, h, p (arrays of words) and ops. Null arrays are empty; rows without words in h are left out."""
    empty = F.array().cast("array<string>")
    rows = df.select(*key, F.coalesce(h, empty).alias("h"), F.coalesce(p, empty).alias("p")).where("size(h) > 0")

    @F.pandas_udf(OPS)
    def ops(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("op", "i1", "i2", "j1", "j2", "h", "p")
        return pd.Series([[dict(zip(names, s)) for s in py_align(list(x), list(y))] for x, y in zip(a, b)])

    return rows.withColumn("ops", ops("h", "p"))


def steps(al: DataFrame, key: list[str], equal: bool = False) -> DataFrame:
    """A row per step, by default without the equal ones: key, op, h, p (words), hn, pn."""
    out = al.select(*key, F.explode("ops").alias("o")).select(*key, "o.op", "o.h", "o.p", F.size("o.h").alias("hn"), F.size("o.p").alias("pn"))
    return out if equal else out.where("op <> 'equal'")


def substitutions(st: DataFrame, key: list[str]) -> DataFrame:
    """One word for one other word: key, source, target."""
    return st.where("op = 'replace' and hn = 1 and pn = 1 and h[0] <> p[0]").select(*key, F.col("h")[0].alias("source"), F.col("p")[0].alias("target"))


def edit_summary(al: DataFrame, by: str) -> DataFrame:
    """Per group: clips, identical clips, words of h, edits (a replaced span counts its longer side), edit_rate."""
    cost = F.aggregate("ops", F.lit(0), lambda a, o: a + F.when(o["op"] == "equal", 0).otherwise(F.greatest(F.size(o["h"]), F.size(o["p"]))))
    per = al.select(by, (F.col("h") == F.col("p")).alias("same"), F.size("h").alias("words"), cost.alias("edits"))
    return per.groupBy(by).agg(F.count("*").alias("clips"), F.count_if("same").alias("identical"), F.sum("words").alias("words"), F.sum("edits").alias("edits")).withColumn("edit_rate", F.expr("edits / nullif(words, 0)"))


def top_changes(st: DataFrame, by: str, kind: str, top: int) -> DataFrame:
    """The most frequent substitutions (spans joined by spaces), deletions or insertions (single words) of each group."""
    if kind == "replace":
        rows = st.where("op = 'replace'").select(by, F.concat_ws(" ", "h").alias("source"), F.concat_ws(" ", "p").alias("target")).where("source <> target")
    else:
        side = "h" if kind == "delete" else "p"
        rows = st.where(F.col("op") == kind).select(by, F.explode(side).alias("word")).select(by, *([F.col("word").alias("source"), F.lit("").alias("target")] if kind == "delete" else [F.lit("").alias("source"), F.col("word").alias("target")]))
    counted = rows.groupBy(by, "source", "target").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "source", "target"))
    return counted.withColumn("position", rank).where(F.col("position") <= top)


def recurring(top: DataFrame, by: str, first: int = 8, groups: int = 3) -> DataFrame:
    """Pairs among the first few of at least so many groups."""
    return top.where(F.col("position") <= first).groupBy("source", "target").agg(F.count_distinct(by).alias("groups"), F.sum("n").alias("n")).where(F.col("groups") >= groups)


def coverage(al: DataFrame, key: list[str]) -> DataFrame:
    """A row per word of p: key, word, source: EQUAL, the single word it stands for, OTHER_MULTIWORD or INSERTED; equal: whether it is unchanged."""
    rows = al.select(*key, F.explode("ops").alias("o")).select(*key, F.col("o.op").alias("op"), F.size("o.h").alias("hn"), F.size("o.p").alias("pn"), F.col("o.h").alias("h"), F.explode("o.p").alias("word"))
    source = F.when(F.col("op") == "equal", "EQUAL").when(F.col("op") == "insert", "INSERTED").when((F.col("hn") == 1) & (F.col("pn") == 1), F.col("h")[0]).otherwise("OTHER_MULTIWORD")
    return rows.select(*key, "word", source.alias("source"), (F.col("op") == "equal").alias("equal"))


def word_fates(al: DataFrame, key: list[str], words: list[str] | None = None) -> DataFrame:
    """A row per word of h (or of those named): key, word, fate: UNCHANGED, DELETED or what replaced it."""
    rows = al.select(*key, F.explode("ops").alias("o")).select(*key, F.col("o.op").alias("op"), F.concat_ws(" ", "o.p").alias("p"), F.explode("o.h").alias("word"))
    fate = F.when(F.col("op") == "equal", "UNCHANGED").when(F.col("op") == "delete", "DELETED").otherwise(F.col("p"))
    rows = rows.select(*key, "word", fate.alias("fate"))
    return rows.where(F.col("word").isin(words)) if words is not None else rows


# Words that negate and do nothing else.
NEGATIONS = ("नहीं", "नही", "नइखे", "नईखे", "मत", "नाहीं")


def negation_fates(al: DataFrame, key: list[str]) -> DataFrame:
    """key, fate, n of the negating words of h: unchanged, deleted, kept (replaced by words among which one negates) or lost."""
    rows = al.select(*key, F.explode("ops").alias("o")).select(*key, "o.op", "o.p", F.explode("o.h").alias("word")).where(F.col("word").isin(*NEGATIONS))
    fate = F.when(F.col("op") == "equal", "unchanged").when(F.col("op") == "delete", "deleted").when(F.exists("p", lambda w: w.isin(*NEGATIONS)), "kept").otherwise("lost")
    return rows.groupBy(*key, fate.alias("fate")).agg(F.count("*").alias("n"))


def edit_mix(al: DataFrame) -> DataFrame:
    """Share of words (the longer side) by kind of change: one_to_one, multi_word, delete, insert."""
    st = steps(al, [])
    kind = F.when((F.col("op") == "replace") & (F.col("hn") == 1) & (F.col("pn") == 1), "one_to_one").when(F.col("op") == "replace", "multi_word").otherwise(F.col("op"))
    per = st.groupBy(kind.alias("kind")).agg(F.sum(F.greatest("hn", "pn")).alias("words"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("words").alias("every")))).select("kind", "words", (F.col("words") / F.col("every")).alias("share"))


def rules(cov: DataFrame, least: int = 1) -> DataFrame:
    """Reversal rules from coverage: word (as recognised), source, support, forward (share of the word's places that come from the
    source), reverse (share of the source's places that became the word). Denominators are all places of the word or source."""
    pairs = cov.where("source not in ('EQUAL', 'INSERTED', 'OTHER_MULTIWORD')").groupBy("word", "source").agg(F.count("*").alias("support"))
    of_word = cov.groupBy("word").agg(F.count("*").alias("word_n"))
    of_source = cov.select(F.when(F.col("source") == "EQUAL", F.col("word")).otherwise(F.col("source")).alias("source")).groupBy("source").agg(F.count("*").alias("source_n"))
    out = pairs.where(F.col("support") >= least).join(of_word, "word").join(of_source, "source")
    return out.select("word", "source", "support", (F.col("support") / F.col("word_n")).alias("forward"), (F.col("support") / F.col("source_n")).alias("reverse"))


def rule_sweep(train: DataFrame, test: DataFrame, supports: tuple[int, ...] = (10, 25, 50), precisions: tuple[float, ...] = (0.90, 0.95, 0.98)) -> DataFrame:
    """For each setting: rules, changed, fixed, damaged, net places when the rules of the training coverage are applied to the test
    coverage, and if that has a column clip, the share of clips improved and worsened. Of several rules of one word the best supported
    counts."""
    found = rules(train)
    best = found.withColumn("__n", F.row_number().over(W.partitionBy("word").orderBy(F.desc("support"), "source"))).where("__n = 1").drop("__n")
    grid = train.sparkSession.createDataFrame([(s, p) for s in supports for p in precisions], "least int, precision double")
    own = best.join(F.broadcast(grid), (F.col("support") >= F.col("least")) & (F.col("forward") >= F.col("precision")))
    places = test.groupBy("word").agg(F.count_if(F.col("source") == "EQUAL").alias("right")).join(own.select("word", "source", "least", "precision"), "word")
    hits = test.groupBy("word", "source").agg(F.count("*").alias("hit"))
    n = test.groupBy("word").agg(F.count("*").alias("n"))
    applied = places.join(n, "word").join(hits, ["word", "source"], "left").groupBy("least", "precision").agg(F.sum("n").alias("changed"), F.sum(F.coalesce("hit", F.lit(0))).alias("fixed"), F.sum("right").alias("damaged"))
    counted = own.groupBy("least", "precision").agg(F.count("*").alias("rules"))
    out = F.broadcast(grid).join(counted, ["least", "precision"], "left").join(applied, ["least", "precision"], "left")
    names = ["rules", "changed", "fixed", "damaged"]
    if "clip" in test.columns:
        gain = F.when(F.col("source") == F.col("__to"), 1).when(F.col("source") == "EQUAL", -1).otherwise(0)
        per = test.join(own.select("word", F.col("source").alias("__to"), "least", "precision"), "word").groupBy("least", "precision", "clip").agg(F.sum(gain).alias("gain"))
        clips = test.agg(F.count_distinct("clip").alias("__clips"))
        moved = per.groupBy("least", "precision").agg(F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") < 0).alias("worsened"))
        moved = moved.crossJoin(F.broadcast(clips)).select("least", "precision", *[(F.col(c) / F.col("__clips")).alias(c) for c in ("improved", "worsened")])
        out, names = out.join(moved, ["least", "precision"], "left"), [*names, "improved", "worsened"]
    return out.select("least", "precision", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]).withColumn("net", F.col("fixed") - F.col("damaged"))


def error_flags(train: DataFrame, test: DataFrame, thresholds: tuple[float, ...] = (0.05, 0.1, 0.2, 0.5)) -> DataFrame:
    """Words are flagged whose share of changed places in training reaches the threshold: flagged, precision and recall on the test coverage."""
    rate = train.groupBy("word").agg(F.avg((~F.col("equal")).cast("double")).alias("rate"))
    rows = test.join(rate, "word", "left").select(F.coalesce("rate", F.lit(0.0)).alias("rate"), (~F.col("equal")).alias("wrong"))
    grid = train.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    per = rows.groupBy("rate").agg(F.count("*").alias("n"), F.count_if("wrong").alias("wrong")).join(F.broadcast(grid), F.lit(True))
    hit = F.col("rate") >= F.col("threshold")
    out = per.groupBy("threshold").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("flagged"), F.sum(F.when(hit, F.col("wrong")).otherwise(0)).alias("right"), F.sum("wrong").alias("wrong"), F.sum("n").alias("words"))
    return out.select("threshold", "flagged", (F.col("flagged") / F.col("words")).alias("share"), F.expr("right / nullif(flagged, 0)").alias("precision"), F.expr("right / nullif(wrong, 0)").alias("recall"))


def candidate_recall(train: DataFrame, test: DataFrame, ks: tuple[int, ...] = (1, 3, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """Of the test substitutions (by, source, target): n, unseen (share whose target training never saw changed, in the same group), and
    how many have the true source among the first k sources that training saw for the target."""
    key = [*by, "target"]
    counted = train.groupBy(*key, "source").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "source")))
    got = test.join(ranked.select(*key, "source", "rank"), [*key, "source"], "left").join(counted.select(*key, F.lit(True).alias("seen")).distinct(), key, "left")
    return got.agg(F.count("*").alias("n"), F.avg(F.col("seen").isNull().cast("double")).alias("unseen"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in ks])


def fuzzy_fates(df: DataFrame, key: list[str], h: Column, p: Column, gap: float = 0.92) -> DataFrame:
    """One-to-one alignment by similarity: a row per word of h with fate UNCHANGED, DELETED or the word it became (costs: one less the
    similarity ratio of both words, a gap as given; of equally cheap paths the pairing one)."""
    rows = df.select(*key, h.alias("h"), p.alias("p")).where("size(h) > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], float] = {}

        def cost(a: str, b: str) -> float:
            if a == b:
                return 0.0
            if (a, b) not in known:
                if len(known) > 500_000:
                    known.clear()
                known[a, b] = 1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            return known[a, b]

        for x in batches:
            out = []
            for i in range(len(x)):
                own, a, b = tuple(x[k].iat[i] for k in key), list(x["h"].iat[i]), list(x["p"].iat[i] if x["p"].iat[i] is not None else [])
                d = [[j * gap for j in range(len(b) + 1)]]
                for m, w in enumerate(a, 1):
                    row = [m * gap]
                    for j, v in enumerate(b, 1):
                        row.append(min(d[m - 1][j - 1] + cost(w, v), d[m - 1][j] + gap, row[j - 1] + gap))
                    d.append(row)
                m, j, got = len(a), len(b), []
                while m:
                    if j and abs(d[m][j] - d[m - 1][j - 1] - cost(a[m - 1], b[j - 1])) < 1e-9:
                        got.append((a[m - 1], "UNCHANGED" if a[m - 1] == b[j - 1] else b[j - 1]))
                        m, j = m - 1, j - 1
                    elif abs(d[m][j] - d[m - 1][j] - gap) < 1e-9:
                        got.append((a[m - 1], "DELETED"))
                        m -= 1
                    else:
                        j -= 1
                out += [(*own, w, f) for w, f in reversed(got)]
            yield pd.DataFrame(out, columns=[*key, "word", "fate"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInPandas(run, f"{kinds}, word string, fate string")
