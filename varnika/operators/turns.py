"""Turns of conversations: order, context of the last turns, evidence over turns, prompts.

Windows go over blocks of a conversation (numbers or hours), and what a block needs from those before it is a few rows or a count, so a
conversation that holds a third of all turns is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from varnika.session import written

CONTEXT = 6
#: Numbers of turns in a block.
BLOCK = 1024
#: Lexicon forms up to which they are broadcast.
FEW = 50_000
UNCLEAR = "[UNCLEAR]"


def turn_no(c: Column | str) -> Column:
    """The number in a turn id."""
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, "([0-9]+)", 1).try_cast("int")


def positions(rows: DataFrame, group: str, order: list[str], block: Column) -> DataFrame:
    """rows with position (from 1) in their group by order. block: what is counted together; it must not fall in this order."""
    rows = rows.withColumn("__b", block)
    counts = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = counts.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), (F.sum("__n").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy(group, "__b").orderBy(*order))
    joined = rows.withColumn("__own", own).join(before, F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")))
    return joined.withColumn("position", (F.col("__own") + F.col("__before")).cast("int")).drop("__b", "__own", "__g", "__c", "__before")


def with_context(turns: DataFrame, last: int = CONTEXT) -> DataFrame:
    """turns: conv, turn, text, reply, understood. Adds context: of the last few earlier turns those that were understood, as
    (role, text) in order. Turns that were not understood are left out after the last few have been taken, not before. A row without
    a number is preceded by other such rows only."""
    item = F.struct("text", "reply", F.coalesce("understood", F.lit(True)).alias("ok"))
    rows = turns.withColumn("__b", F.floor(F.col("turn") / BLOCK)).withColumn("__i", item)
    block = W.partitionBy("conv", "__b")
    rows = rows.withColumn("__own", F.collect_list("__i").over(block.orderBy("turn").rowsBetween(-last, -1)))
    # the last rows of a block, for the blocks after it: only of conversations that have several
    long = rows.where("__b > 0").select("conv").distinct()
    ends = rows.select("conv", "__b", "turn", "__i", F.row_number().over(block.orderBy(F.desc("turn"))).alias("__k")).where(F.col("__k") <= last).join(long, "conv", "left_semi")
    ends = ends.groupBy("conv", "__b").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "__i"))), lambda x: x["__i"]).alias("__end"))
    carried = ends.select("conv", "__b", F.flatten(F.collect_list("__end").over(W.partitionBy("conv").orderBy("__b").rowsBetween(-last, -1))).alias("__before"))
    rows = rows.join(carried, ["conv", "__b"], "left")
    every = F.when(F.col("__before").isNull(), F.col("__own")).otherwise(F.concat("__before", "__own"))
    rows = rows.withColumn("__past", every).withColumn("__past", F.slice("__past", F.greatest(F.size("__past") - last + 1, F.lit(1)), last))
    past = F.filter("__past", lambda t: t["ok"])
    pairs = F.flatten(F.transform(past, lambda t: F.array(F.struct(F.lit("user").alias("role"), t["text"].alias("text")), F.struct(F.lit("assistant").alias("role"), t["reply"].alias("text")))))
    return rows.withColumn("context", pairs).select(*turns.columns, "context")


def transcript(context: Column) -> Column:
    """A context as lines of role and text."""
    return F.array_join(F.transform(context, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n")


def unclear(reply: Column | str) -> tuple[Column, Column]:
    """(understood, reply without the tag) of a reply that may begin with the tag for an unclear turn."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    return ~F.startswith(reply, F.lit(UNCLEAR)), F.trim(F.regexp_replace(reply, r"^\Q[UNCLEAR]\E", ""))


def pooled_evidence(turns: DataFrame, forms: DataFrame, words: Column, last: int = CONTEXT, lines: int = 6) -> DataFrame:
    """Per turn the lexicon forms of it and the last few turns: forms (how many different ones not shared), evidence (at most so many,
    shared ones last, most recent first, then by form). forms: word, shared."""
    forms = written(forms)
    own = positions(turns.withColumn("__w", F.array_distinct(words)), "conv", ["turn"], F.floor(F.col("turn") / BLOCK))
    said = own.select("conv", F.col("turn").alias("at"), "position", F.explode("__w").alias("word"))
    # only the forms of the lexicon go on to the turns that follow
    found = said.join(F.broadcast(forms) if forms.count() <= FEW else forms, "word")
    reach = found.select("conv", "word", "shared", "at", F.explode(F.sequence("position", F.col("position") + last)).alias("position"))
    hits = reach.join(own.select("conv", "position", "turn"), ["conv", "position"]).groupBy("conv", "turn", "word", "shared").agg(F.max("at").alias("at"))
    per = hits.groupBy("conv", "turn").agg(F.count_if(~F.col("shared")).alias("forms"), F.array_sort(F.collect_list(F.struct(F.col("shared").alias("a"), (-F.col("at")).alias("b"), F.col("word").alias("c")))).alias("e"))
    return per.select("conv", "turn", "forms", (F.col("forms") >= 2).alias("enough"), F.transform(F.slice("e", 1, lines), lambda x: x["c"]).alias("evidence"))


def render_prompts(shots: DataFrame, evaluated: DataFrame, source: str, target: str) -> DataFrame:
    """shots: size, position, anchor_text, target_text; evaluated: id, anchor_text. A prompt per size and evaluated row."""
    line = F.concat(F.lit(f"{source}: "), F.col("anchor_text"), F.lit(f"\n{target}: "), F.col("target_text"))
    examples = shots.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("examples"))
    sizes = F.broadcast(examples)  # one row per size
    return evaluated.select("id", "anchor_text").crossJoin(sizes).select("size", "id", F.concat(F.lit(f"Translate from {source} to {target}.\n\n"), F.when(F.col("examples") != "", F.concat("examples", F.lit("\n\n"))).otherwise(""), F.lit(f"{source}: "), F.col("anchor_text"), F.lit(f"\n{target}:")).alias("prompt"))


def cited_rules(rules: DataFrame, shown: DataFrame) -> DataFrame:
    """rules: rule_id, ids (array of cited example ids), confidence; shown: id. Adds unknown (cited but not shown), problem (null if the
    rule is kept): cites nothing, cites ids that were not shown, or a confidence outside 0 to 1."""
    cited = rules.select("rule_id", F.explode_outer("ids").alias("id")).join(shown.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    unknown = cited.where("id is not null and known is null").groupBy("rule_id").agg(F.array_sort(F.collect_set("id")).alias("unknown"))
    out = rules.join(unknown, "rule_id", "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    problem = F.when(F.coalesce(F.size("ids"), F.lit(0)) <= 0, "cites nothing").when(F.size("unknown") > 0, F.concat(F.lit("not shown: "), F.array_join("unknown", ", "))).when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0 to 1")
    return out.withColumn("problem", problem)
