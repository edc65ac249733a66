"""Conversations from message rows, assembled from overlapping export fragments.

1. Fragments. The rows of one conversation written in the same hour are an export fragment. Its messages are known by the hash of
   number, text and reply. A read is a run of successive numbers in a fragment (and in one block of ``BLOCK`` numbers, so that a read
   is never longer than that). The hash of a sequence of messages is the exclusive or of theirs: each holds its number, so the order
   is part of it, and the hash of any part of a read comes from two running hashes.
2. Reads that stand wholly in another one are taken out: the furthest read over the first message is looked up, and the hash of the
   same part of it compared.
3. Overlap graph. A read is joined with another where its last k messages are the other's first k, for any k down to 0: the last
   number and the first then meet. Only hashes of suffixes and prefixes are matched, and they are counted by hash, so that no two
   reads are paired unless one suffix meets one prefix. An edge is unambiguous if both reads have no longer match and the match is
   between these two only.
4. Unambiguous edges merge reads into paths. Numbers only grow along them, so there are as many paths as reads less edges. A
   conversation is whole if one path leads from number 1 to its last. A missing number, or two messages of one number, leave two
   paths or more: no overlap leads over the hole or from one message to the other.

No step collects a conversation: windows go over one block of a fragment, all else are sums with partial sums before each shuffle, so
a conversation with a third of all rows is no hot task. No text is shuffled to judge a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from varnika.functions.text import is_blank, squeeze
from varnika.session import table, written

#: Numbers in a block: a read is not longer, its suffixes and prefixes are not more.
BLOCK = 256
READ = ["conversation_id", "a", "b", "fp"]


def turn_number(turn_id: Column) -> Column:
    """The number in turn_id; null if it has none."""
    return F.regexp_extract(turn_id, "([0-9]+)", 1).try_cast("bigint")


def messages(rows: DataFrame) -> DataFrame:
    """conversation_id, no, caller, assistant (null where blank), silent, fragment, h."""
    text = lambda c: F.when(~is_blank(c), squeeze(c))
    return rows.where("conversation_id is not null").select(
        "conversation_id",
        turn_number(F.col("turn_id")).alias("no"),
        text("recognized_text").alias("caller"),
        text("reply_text").alias("assistant"),
        (F.coalesce(F.lower(F.trim("error_code")), F.lit("")) == "no_speech").alias("silent"),
        F.date_trunc("hour", "created").alias("fragment"),
    ).withColumn("h", F.xxhash64("no", F.coalesce("caller", F.lit("")), F.lit("\x1f"), F.coalesce("assistant", F.lit(""))))


def reads(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, forks) from conversation_id, fragment, no, h (distinct rows).

    reads has a row per message of each read: conversation_id, a and b (first and last number), fp (hash of all its messages), no, h,
    cum (hash of the messages up to this one). Equal reads of several fragments are one. forks: conversation_id, no, variants of the
    numbers of which one fragment holds several messages; they are in no read, each variant is a dead end.
    """
    per = nodes.where("no is not null").groupBy("conversation_id", "fragment", "no").agg(F.count("*").alias("variants"), F.min("h").alias("h"))
    forks = per.where("variants > 1").groupBy("conversation_id", "no").agg(F.max("variants").alias("variants"))
    block = ["conversation_id", "fragment", "block"]
    solid = per.where("variants = 1").withColumn("block", F.floor(F.col("no") / BLOCK))
    runs = solid.withColumn("run", F.col("no") - F.row_number().over(W.partitionBy(*block).orderBy("no")))
    own = W.partitionBy(*block, "run")
    upto = own.orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    every = own.orderBy("no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = runs.select("conversation_id", F.min("no").over(every).alias("a"), F.max("no").over(every).alias("b"), F.bit_xor("h").over(every).alias("fp"), "no", "h", F.bit_xor("h").over(upto).alias("cum"))
    return out.distinct(), forks


def uncontained(every: DataFrame) -> DataFrame:
    """The reads without those whose messages all stand in another one."""
    # of the reads over a message the one that goes furthest, and its hash before the message
    before = F.col("cum").bitwiseXOR(F.col("h"))
    far = every.groupBy("conversation_id", "no", "h").agg(F.max(F.struct("b", (-F.col("a")).alias("c"), "fp", before.alias("before"))).alias("w"))
    first = every.where("no = a").select(*READ, "no", "h").join(far, ["conversation_id", "no", "h"])
    first = first.where("w.b <> b or w.c <> -a or w.fp <> fp").select(*READ, F.col("w.b").alias("wb"), (-F.col("w.c")).alias("wa"), F.col("w.fp").alias("wfp"), F.col("w.before").alias("before"))
    wide = every.select("conversation_id", F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("fp").alias("wfp"), F.col("no").alias("b"), F.col("cum").alias("upto"))
    inside = first.join(wide, ["conversation_id", "wa", "wb", "wfp", "b"]).where(F.col("upto").bitwiseXOR(F.col("before")) == F.col("fp"))
    return every.join(inside.select(*READ), READ, "left_anti")


def overlaps(kept: DataFrame, forks: DataFrame) -> DataFrame:
    """The unambiguous edges: conversation_id, x and y (reads as a, b, fp), k (messages of the overlap)."""
    own = F.struct("a", "b", "fp")
    key = lambda side, at, k, fp: F.struct(F.lit(side).alias("side"), at.cast("bigint").alias("at"), k.cast("int").alias("k"), fp.alias("key"))
    none, zero = F.lit(0).cast("bigint"), F.lit(0)
    no, a, b = F.col("no"), F.col("a"), F.col("b")
    ends = F.array_compact(
        F.array(
            F.when(no == a, key("y", a, zero, none)),
            F.when(no < b, key("y", a, no - a + 1, F.col("cum"))),
            F.when(no == b, key("x", b + 1, zero, none)),
            F.when(no > a, key("x", no, b - no + 1, F.col("fp").bitwiseXOR(F.col("cum").bitwiseXOR(F.col("h"))))),
        )
    )
    keys = kept.select("conversation_id", own.alias("own"), F.explode(ends).alias("e")).select("conversation_id", "own", "e.*", F.lit(1).alias("n"))
    # a fork is two reads at least that end, and begin, where the other does
    dead = forks.select("conversation_id", F.struct(no.alias("a"), no.alias("b"), none.alias("fp")).alias("own"), F.explode(F.array(key("y", no, zero, none), key("x", no + 1, zero, none))).alias("e")).select("conversation_id", "own", "e.*", F.lit(2).alias("n"))
    side = lambda s, c: F.when(F.col("side") == s, c)
    met = keys.unionByName(dead).groupBy("conversation_id", "at", "k", "key").agg(*[f(side(s, F.col(c))).alias(f"{c}_{s}") for s in "xy" for f, c in ((F.sum, "n"), (F.min, "own"))]).where("n_x > 0 and n_y > 0")
    # reads that share a suffix share all shorter ones: a read is lost here only where no shorter match of it is unambiguous either
    one = lambda s: F.when(F.col(f"n_{s}") == 1, F.col(f"own_{s}"))
    ways = F.array(F.struct(F.lit("x").alias("side"), one("x").alias("own"), one("y").alias("other")), F.struct(F.lit("y").alias("side"), one("y").alias("own"), one("x").alias("other")))
    best = met.select("conversation_id", "k", F.explode(ways).alias("w")).select("conversation_id", "k", "w.*").where("own is not null").groupBy("conversation_id", "side", "own").agg(F.max(F.struct("k", "other")).alias("m"))
    edge = best.where("m.other is not null").select("conversation_id", F.col("m.k").alias("k"), F.when(F.col("side") == "x", F.col("own")).otherwise(F.col("m.other")).alias("x"), F.when(F.col("side") == "x", F.col("m.other")).otherwise(F.col("own")).alias("y"))
    return edge.groupBy("conversation_id", "x", "y", "k").agg(F.count("*").alias("sides")).where("sides = 2").drop("sides")


def assembled(nodes: DataFrame) -> DataFrame:
    """Per conversation: reads (without contained ones, each variant of a fork counts), edges, shared (messages in which the reads of
    its edges overlap), paths (reads less edges)."""
    every, forks = reads(nodes)
    every = written(every)  # hashes and numbers only; read five times
    kept = written(uncontained(every))
    parts = kept.where("no = a").select("conversation_id", F.lit(1).cast("bigint").alias("reads"), F.lit(0).cast("bigint").alias("edges"), F.lit(0).cast("bigint").alias("shared"))
    parts = parts.union(forks.select("conversation_id", "variants", F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
    parts = parts.union(overlaps(kept, forks).select("conversation_id", F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.col("k").cast("bigint")))
    return parts.groupBy("conversation_id").agg(*[F.sum(c).alias(c) for c in ("reads", "edges", "shared")]).withColumn("paths", F.col("reads") - F.col("edges"))


def judge(rows: DataFrame) -> DataFrame:
    """A row per conversation: messages, reads, shared (messages in which its reads overlap), paths, and why it is broken.

    broken is one of gap, conflict, no_reply, no_text, empty, or null for a whole conversation; the first that applies. Rows without
    conversation_id belong to none; a row without a number has no place, which is a gap; repeated rows count once; a null created is
    a fragment of its own; a silent turn (error_code no_speech, both texts blank) is no fault beside turns with text; an empty table
    gives no rows.
    """
    flags = messages(rows).groupBy("conversation_id", "fragment", "no", "h").agg(
        F.max(F.col("caller").isNotNull()).alias("said"),
        F.max(F.col("assistant").isNotNull()).alias("answered"),
        F.max("silent").alias("silent"),
    )
    nodes = written(flags)
    per = nodes.groupBy("conversation_id", "no", "h").agg(*[F.max(c).alias(c) for c in ("said", "answered", "silent")])
    per = per.groupBy("conversation_id").agg(
        F.count("*").alias("messages"),
        F.min("no").alias("lowest"),
        F.max("no").alias("highest"),
        F.count_if(F.col("no").isNull()).alias("unnumbered"),
        F.count_if(F.col("said") & ~F.col("answered")).alias("no_reply"),
        F.count_if(~F.col("said") & (F.col("answered") | ~F.col("silent"))).alias("no_text"),
        F.max("said").alias("said"),
    )
    got = per.join(assembled(nodes.select("conversation_id", "fragment", "no", "h")), "conversation_id", "left")
    loose = F.coalesce(F.col("paths"), F.lit(0)) != 1
    why = (
        F.when((F.col("unnumbered") > 0) | (F.col("lowest") != 1), "gap")
        # more messages than numbers up to the last: some number has two
        .when(loose & (F.col("messages") >= F.col("highest") + 1), "conflict")
        .when(loose, "gap")
        .when(F.col("no_reply") > 0, "no_reply")
        .when(F.col("no_text") > 0, "no_text")
        .when(~F.col("said"), "empty")
    )
    return got.select("conversation_id", "messages", F.coalesce("reads", F.lit(0)).alias("reads"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("paths", F.lit(0)).alias("paths"), why.alias("broken"))


def conversations(rows: DataFrame) -> DataFrame:
    """The whole conversations as ordered messages: conversation_id, position (from 1), role (caller, assistant), text.

    Silent turns give no message. One row per message, never one per conversation: a long conversation stays many rows.
    """
    good = judge(rows).where("broken is null").select("conversation_id")
    turns = messages(rows).groupBy("conversation_id", "no", "h").agg(F.min("caller").alias("caller"), F.min("assistant").alias("assistant"))
    said = F.explode(F.array(F.struct((F.col("no") * 2 - 1).alias("position"), F.lit("caller").alias("role"), F.col("caller").alias("text")), F.struct((F.col("no") * 2).alias("position"), F.lit("assistant").alias("role"), F.col("assistant").alias("text"))))
    return turns.join(good, "conversation_id", "left_semi").select("conversation_id", said.alias("m")).select("conversation_id", "m.*").where("text is not null")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The conversations that must be dropped."""
    return judge(table(spark, sf_dir, "boli_reviews")).where("broken is not null").select("conversation_id")


def p1_conversations(spark, sf_dir: str) -> DataFrame:
    """The whole conversations, message by message."""
    return conversations(table(spark, sf_dir, "boli_reviews"))


_BLANK_SQL = r"(?is)^[\s\p{Z}\p{Pd}.…·−\x{00AD}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]*(?:null[\s\p{Z}\p{Pd}.…·−\x{00AD}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]*)?$"
_MESSAGES_SQL = rf"""m AS (
  SELECT conversation_id, TRY_CAST(nullif(regexp_extract(turn_id, '([0-9]+)', 1), '') AS BIGINT) AS no,
         CASE WHEN NOT regexp_matches(recognized_text, '{_BLANK_SQL}') THEN trim(regexp_replace(regexp_replace(recognized_text, '[\x{{00AD}}\x{{180E}}\x{{200B}}-\x{{200F}}\x{{2028}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) END AS caller,
         CASE WHEN NOT regexp_matches(reply_text, '{_BLANK_SQL}') THEN trim(regexp_replace(regexp_replace(reply_text, '[\x{{00AD}}\x{{180E}}\x{{200B}}-\x{{200F}}\x{{2028}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]+', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) END AS assistant,
         coalesce(lower(trim(error_code)), '') = 'no_speech' AS silent
  FROM boli_reviews WHERE conversation_id IS NOT NULL),
d AS (SELECT conversation_id, no, caller, assistant, bool_or(silent) AS silent FROM m GROUP BY ALL),
dropped AS (
  SELECT conversation_id FROM d GROUP BY conversation_id
  HAVING count(*) <> count(DISTINCT no) OR min(no) <> 1 OR max(no) <> count(DISTINCT no)
      OR bool_or((caller IS NULL) <> (assistant IS NULL)) OR bool_or(caller IS NULL AND assistant IS NULL AND NOT silent) OR count(caller) = 0)"""

QUERIES = {"p1_found": p1_found, "p1_conversations": p1_conversations}
SQL = {
    "p1_found": f"WITH {_MESSAGES_SQL} SELECT conversation_id FROM dropped",
    "p1_conversations": f"""WITH {_MESSAGES_SQL}, k AS (SELECT * FROM d WHERE conversation_id NOT IN (SELECT conversation_id FROM dropped))
SELECT conversation_id, no * 2 - 1 AS position, 'caller' AS role, caller AS text FROM k WHERE caller IS NOT NULL
UNION ALL SELECT conversation_id, no * 2, 'assistant', assistant FROM k WHERE assistant IS NOT NULL""",
}
