"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted over all documents. A source's weight is its token share raised to an exponent and held
against the wanted share: wanted * (token share / wanted) ** exponent, made to add up to 1. With exponent 0 the wanted shares come out,
with 1 the sources as large as they are; where no shares are wanted all are wanted alike, and it is the usual temperature. The exponent
is bisected: to the entropy that the mixture is to have, or else to the smallest at which no source is repeated more than its limit. A
source that is too small for its share even when repeated as often as allowed (or absent) gives all it may, and the exponent is
bisected for the others, which fill the rest: one small source doesn't move all others from their wanted proportions.

A source's weight is a budget of tokens, realised as block permutations: each block holds every document once, in the order of a seeded
hash of block and document; the last block is broken off where the budget ends. How far that is follows from sums by ranges of the
hash, so no source has to be sorted as a whole.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from varnika.session import table, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits a text before merging bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents whose prefix sums are made in one task, about.
RANGE = 20_000
#: Sources that can be mixed: their weights are found on the driver.
MAX_SOURCES = 100_000
#: Repetitions of a source where none are given.
REPEATS = 4.0


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of each document with text and source. Equal doc_ids count once. The vocabulary (about 1 MB) is read once, here, and sent to the executors."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where("doc_id is not null and source is not null and text is not null and text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("varnika", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "tokens": [len(encoding.encode_ordinary(t)) for t in x["text"]]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, source string, tokens long").groupBy("doc_id").agg(F.min_by("source", F.struct("source", "tokens")).alias("source"), F.min_by("tokens", F.struct("source", "tokens")).alias("tokens"))


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def _bisect(f, low: float, high: float) -> float:
    """Where f, which does not fall, passes 0."""
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def powers(tokens: dict[str, float], exponent: float, wanted: dict[str, float] | None = None) -> dict[str, float]:
    """Token shares raised to the exponent, held against the wanted shares (all alike if not given), made to add up to 1."""
    total = sum(tokens.values())
    logs = {s: (1 - exponent) * math.log((wanted or {}).get(s, 0.0) or 1.0) + exponent * math.log(t / total) for s, t in tokens.items()}
    top = max(logs.values())
    every = sum(math.exp(x - top) for x in logs.values())
    return {s: math.exp(x - top) / every for s, x in logs.items()}


def weights(tokens: dict[str, float], budget: float, wanted: dict[str, float] | None = None, repeats: dict[str, float] | None = None, want_entropy: float | None = None) -> tuple[dict[str, float], float]:
    """(share of the budget by source, exponent). tokens: what each source holds; repeats: how often it may be repeated.

    Sources without tokens have share 0. If all sources together can't fill the budget within their limits, each gives all it may and
    the shares add up to less than 1. With an entropy that no exponent of 0 or more reaches, the exponent is 0.
    """
    names = list(wanted) if wanted is not None else list(tokens)
    free = {s: tokens[s] for s in names if tokens.get(s, 0) > 0 and (wanted is None or wanted[s] > 0)}
    cap = {s: t * (repeats or {}).get(s, REPEATS) / budget for s, t in free.items()}
    full = {s: 0.0 for s in names}  # sources that give all they may
    exponent = 0.0
    while free:
        rest = 1 - sum(full.values())

        def at(a: float) -> dict[str, float]:
            return {s: rest * p for s, p in powers(free, a, wanted).items()}

        def spare(a: float) -> float:
            return min(cap[s] - p for s, p in at(a).items()) + 1e-12

        if want_entropy is not None:
            exponent = _bisect(lambda a: want_entropy - entropy({**full, **at(a)}), 0.0, 4.0) if entropy({**full, **at(0.0)}) > want_entropy else 0.0
            short = [s for s, p in at(exponent).items() if p > cap[s] + 1e-12]
        else:
            # of those too small for their wanted share none can be helped by the others' exponent
            short = [s for s in free if wanted is not None and wanted[s] > cap[s] + 1e-12]
            if not short:
                exponent = 0.0 if spare(0.0) >= 0 else _bisect(spare, 0.0, 1.0)
                short = [s for s, p in at(exponent).items() if p > cap[s] + 1e-9]
        if not short:
            return {**full, **at(exponent)}, exponent
        for s in short:
            full[s] = min(cap[s], max(0.0, 1 - sum(full.values())))
            del free[s]
    return full, exponent


def mixture(counted: DataFrame, shares: dict[str, float], budget: float, seed: int = 42) -> DataFrame:
    """doc_id, source, tokens, block (from 0), place (its hash in the block): the documents of the mixture, one row per repetition.

    counted: doc_id, source, tokens. Sources without a share give nothing. A source's documents are as many as fit its budget; a
    document that would pass it is left out, so a source stays below its budget by less than one document. An empty table or no shares
    give no rows.
    """
    spark = counted.sparkSession
    # as many rows as sources, MAX_SOURCES at most
    plan = spark.createDataFrame([(s, float(w) * budget) for s, w in shares.items() if w > 0], "source string, budget double")
    docs = counted.where("tokens > 0").join(F.broadcast(plan), "source")
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("all"), F.count("*").alias("docs"))
    docs = docs.join(F.broadcast(sizes), "source")
    full = F.floor(F.col("budget") / F.col("all") + 1e-9)
    docs = docs.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("all"))
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), F.col("full"), F.col("doc_id")))
    docs = docs.withColumn("range", F.pmod(F.shiftrightunsigned("h", 20), (F.col("docs") / RANGE).cast("long") + 1))
    sums = docs.groupBy("source", "range").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "range", (F.sum("t").over(W.partitionBy("source").orderBy("range")) - F.col("t")).alias("before"))
    upto = F.sum("tokens").over(W.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    taken = docs.join(before, ["source", "range"]).withColumn("times", (F.col("full") + (upto <= F.col("rest")).cast("long")).cast("int"))
    out = taken.where("times > 0").select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("block"))
    return out.withColumn("place", F.xxhash64(F.lit(seed), F.col("block").cast("long"), F.col("doc_id")))


def _targets(targets: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(r.w for r in rows) or 1.0
    return {r.source: float(r.w) / total for r in rows}, {r.source: float(r.r if r.r is not None else 1) for r in rows}


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, want_entropy: float | None = None, by_share: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). targets: source, target_share, max_repeats (null: once). The budget, if not given, is the tokens of all
    sources with a target. by_share=False: the shares are not wanted themselves, only their entropy (or the one given).

    report: source, target_share, max_repeats, available (tokens), weight (share of the budget), exponent, tokens (in the mixture),
    share, repeats (of the most repeated document); a source that is absent has 0. Documents without text or source, and sources
    without a target, take no part.
    """
    wanted, repeats = _targets(targets)
    counted = written(count_tokens(documents))
    names = targets.select("source").where("target_share > 0").distinct()
    sizes = {r.source: float(r.t) for r in counted.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = budget or sum(sizes.values()) or 1.0
    if not by_share and want_entropy is None:
        want_entropy = entropy(wanted)
    shares, exponent = weights({s: sizes.get(s, 0.0) for s in wanted}, total, wanted if by_share else None, repeats, want_entropy)
    mixed = mixture(counted, shares, total, seed)
    spark = documents.sparkSession
    given = spark.createDataFrame([(s, w, int(repeats[s]), int(sizes.get(s, 0)), shares.get(s, 0.0), exponent) for s, w in wanted.items()], "source string, target_share double, max_repeats int, available long, weight double, exponent double")
    real = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("block") + 1).alias("repeats"))
    every = real.agg(F.sum("tokens").alias("every"))
    report = given.join(real, "source", "left").crossJoin(F.broadcast(every)).select(*given.columns, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    return mixed, report


def p9_mixture(spark, sf_dir: str) -> DataFrame:
    """The mixture to the wanted shares, one row per repetition of a document."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark, sf_dir: str) -> DataFrame:
    """The exponent of that mixture and what each wanted source really contributes."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p9_temperature(spark, sf_dir: str) -> DataFrame:
    """The same of a mixture by temperature alone: as even as the wanted shares (their entropy), each source within its repetitions."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), by_share=False)[1]


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_temperature": p9_temperature}
SQL: dict[str, str] = {}
