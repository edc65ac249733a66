"""Splits that keep related records together: min-cost flow allocation.

Records are joined to components by the speaker (or the source, or both). Components of the same size and label profile (their most
frequent target language and the split in which most of their records lie now) are one bundle: sizes add up to the records, so N
records have at most sqrt(2 N) different sizes and the bundles stay few. A flow of records from the bundles through (language, split)
to the splits is sought at minimum cost: a record that changes its split costs a little, a deviation from a quota of a language more,
one from a quota of the whole most. Bundles that differ in size only have parallel arcs of equal cost, so the flow is solved on their
sums, exactly. Components larger than the smallest quota, a few at most, are placed before, and what they leave of the quotas are the
shares that the flow keeps for all others. It is rounded to whole components from the largest size down, and a bundle's components are assigned in the order of
their hash: each one's rank comes from counts by hash range, so no bundle has to be sorted as a whole.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from varnika.operators.splits import connected_components
from varnika.session import table, written

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Costs of a record: one that moves, one beyond its language's quota, one beyond the whole's quota.
MOVE, LANGUAGE, WHOLE = 1, 8, 64
#: Components ranked in one task at most, about.
RANGE = 20_000
#: Bundles up to which their table is broadcast.
FEW = 100_000


def speaker_number(c: Column) -> Column:
    """The number in a speaker_id without leading zeros; null if it has none."""
    return F.regexp_extract(c, r"([0-9]+)\D*$", 1).try_cast("bigint")


def components(records: DataFrame, by: str = "speaker") -> DataFrame:
    """A row per component: component, n (records), label (most frequent language), now (split that holds most), splits (how many).

    by: speaker, source, or both: then records that share either are linked, and so are those linked with these. A record whose key is null or blank is a component of its own (its id). Repeated rows count once; records
    without id are ignored; split and language may be null. An empty table gives no rows.
    """
    rows = _keyed(records, by)
    counted = rows.groupBy("component", "lang", "split").agg(F.count("*").alias("n"))
    langs = counted.groupBy("component", "lang").agg(F.sum("n").alias("n"), F.max_by("split", F.struct("n", "split")).alias("s"), F.max("n").alias("top"))
    per_split = counted.where("split is not null").groupBy("component", "split").agg(F.sum("n").alias("n")).groupBy("component").agg(F.count("*").alias("splits"), F.max_by("split", F.struct("n", "split")).alias("now"))
    per_lang = langs.groupBy("component").agg(F.sum("n").alias("n"), F.max_by("lang", F.struct("n", "lang")).alias("label"))
    return per_lang.join(per_split, "component", "left").select("component", "n", "label", "now", F.coalesce("splits", F.lit(0)).alias("splits"))


def _keyed(records: DataFrame, by: str) -> DataFrame:
    """id, component, lang, split of each record, once."""
    speaker = F.concat(F.lit("k:"), speaker_number(F.col("speaker_id")).cast("string"))
    source = F.concat(F.lit("k:"), F.nullif(F.lower(F.trim("source")), F.lit("")))
    if by not in ("speaker", "source", "both"):
        raise ValueError(f"no grouping: {by}")
    key = source if by == "source" else speaker
    split = F.lower(F.trim("split"))
    lang = F.regexp_extract(F.lower(F.trim("target_language")), "^([a-z]+)", 1)
    rows = records.where("id is not null")
    if by == "both":
        rows = rows.withColumns({"__a": F.concat(F.lit("speaker"), speaker), "__b": F.concat(F.lit("source"), source)})
        nodes = connected_components(rows.where("__a is not null and __b is not null").select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct())
        few = nodes.count() <= FEW
        for c in ("__a", "__b"):
            own = nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
            rows = rows.join(F.broadcast(own) if few else own, c, "left")
        # a speaker or source without edges is a component of its own
        key = F.concat(F.lit("k:"), F.coalesce("__ac", "__bc", "__a", "__b"))
    return (
        rows.select("id", F.coalesce(key, F.concat(F.lit("r:"), "id")).alias("component"), F.coalesce(lang, F.lit("")).alias("lang"), F.when(split.isin(*SPLITS), split).alias("split"))
        .groupBy("id")
        .agg(F.min("component").alias("component"), F.min("lang").alias("lang"), F.min("split").alias("split"))
    )


class Flow:
    """Successive shortest paths (Bellman-Ford) on a small network of integer capacities."""

    def __init__(self) -> None:
        self.to: list = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict = defaultdict(list)

    def add(self, a, b, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source, sink) -> None:
        while True:
            far, via, todo = {source: 0}, {}, [source]
            while todo:
                nxt = []
                for x in todo:
                    for e in self.out[x]:
                        d = far[x] + self.cost[e]
                        if self.cap[e] and d < far.get(self.to[e], float("inf")):
                            far[self.to[e]], via[self.to[e]] = d, e
                            nxt.append(self.to[e])
                todo = nxt
            if sink not in far:
                return
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            n = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= n
                self.cap[e ^ 1] += n


def quotas(total: int, shares: tuple[float, ...]) -> list[int]:
    """Whole numbers in these shares that add up to total."""
    out = [int(total * s) for s in shares]
    for k in sorted(range(len(shares)), key=lambda k: out[k] - total * shares[k])[: total - sum(out)]:
        out[k] += 1
    return out


def allocate(bundles: list[tuple[int, str, str | None, int]], shares: tuple[float, ...] = SHARES) -> dict[tuple[int, str, str | None], list[int]]:
    """bundles: size, label, present split, number of components. How many components of each bundle go to each split."""
    every = sum(size * n for size, _, _, n in bundles)
    whole, out, small = quotas(every, shares), {}, []
    least = min((q for q, s in zip(whole, shares) if s > 0), default=0)
    for size, label, now, n in sorted(bundles, key=lambda b: (-b[0], b[1], b[2] or "")):
        if size <= least:
            small.append((size, label, now, n))
            continue
        take = [0] * len(SPLITS)
        for _ in range(n):  # larger than the smallest quota: there are only a few of them
            take[max(range(len(SPLITS)), key=lambda k: (whole[k] - take[k] * size, -k))] += 1
        whole = [w - t * size for w, t in zip(whole, take)]
        out[size, label, now] = take
    # what these leave of the quotas are the shares of all others
    room = [max(0, w) for w in whole]
    shares = tuple(r / sum(room) for r in room) if sum(room) else shares
    bundles, supply = small, defaultdict(int)
    for size, label, now, n in bundles:
        supply[label, now] += size * n
    total = sum(supply.values())
    flow, arcs = Flow(), {}
    for (label, now), n in supply.items():
        flow.add("source", (label, now), n, 0)
        for k, s in enumerate(SPLITS):
            arcs[label, now, k] = flow.add((label, now), ("language", label, k), n, MOVE if now and now != s else 0)
    for label in {k for k, _ in supply}:
        for k, q in enumerate(quotas(sum(n for (x, _), n in supply.items() if x == label), shares)):
            flow.add(("language", label, k), ("split", k), q, 0)
            flow.add(("language", label, k), ("split", k), total, LANGUAGE)
    for k, q in enumerate(quotas(total, shares)):
        flow.add(("split", k), "sink", q, 0)
        flow.add(("split", k), "sink", total, WHOLE)
    flow.run("source", "sink")
    left = {key: [flow.cap[arcs[(*key, k)] ^ 1] for k in range(len(SPLITS))] for key in supply}
    whole = quotas(total, shares)
    for size, label, now, n in sorted(bundles, key=lambda b: (-b[0], b[1], b[2] or "")):
        room, take = left[label, now], [0] * len(SPLITS)
        for k in range(len(SPLITS)):
            take[k] = min(max(0, min(room[k], whole[k])) // size, n - sum(take))
        # those beyond the flow's room go, one after the other, where most of the whole's quota is left: all but the last few by division, down to the level that this leaves
        over, free = (n - sum(take)) * size, [whole[k] - take[k] * size for k in range(len(SPLITS))]
        level = max((sum(x) - over) // len(x) for x in (sorted(free)[-j:] for j in range(1, len(SPLITS) + 1)))
        for k in range(len(SPLITS)):
            take[k] += min(max(0, free[k] - level) // size, n - sum(take))
        for _ in range(n - sum(take)):  # fewer than there are splits
            take[max(range(len(SPLITS)), key=lambda k: (whole[k] - take[k] * size, -k))] += 1
        for k in range(len(SPLITS)):
            room[k] -= take[k] * size
            whole[k] -= take[k] * size
        out[size, label, now] = take
    return out


def ranked(df: DataFrame, group: str, seed: int, key: str) -> DataFrame:
    """df (with the size of each row's group) with rank (from 0) of each row in its group by the hash of key: ranges of the hash are counted first, then ranked within."""
    df = df.withColumn("h", F.xxhash64(F.lit(seed), F.col(key)))
    df = df.withColumn("range", F.pmod(F.shiftrightunsigned("h", 20), (F.col("size") / RANGE).cast("long") + 1))
    counts = df.groupBy(group, "range").agg(F.count("*").alias("c"))
    before = counts.select(group, "range", (F.sum("c").over(W.partitionBy(group).orderBy("range")) - F.col("c")).alias("before"))
    rank = F.row_number().over(W.partitionBy(group, "range").orderBy("h", key)) - 1 + F.col("before")
    return df.join(before, [group, "range"]).withColumn("rank", rank).drop("h", "before", "range")


def grouped_splits(records: DataFrame, by: str = "speaker", shares: tuple[float, ...] = SHARES, seed: int = 42) -> DataFrame:
    """id, component, split: the new split of each record; all records of a component share it. Nulls and repeats as in components()."""
    spark = records.sparkSession
    comps = written(components(records, by).withColumn("bundle", F.concat_ws("|", "n", "label", F.coalesce("now", F.lit("")))))
    counted = [(r.bundle, r.n, r.label, r.now, r.c) for r in comps.groupBy("bundle", "n", "label", "now").agg(F.count("*").alias("c")).toLocalIterator()]
    plan = allocate([x[1:] for x in counted], shares)
    cuts = spark.createDataFrame([(b, c, plan[n, lab, now][0], sum(plan[n, lab, now][:2])) for b, n, lab, now, c in counted], "bundle string, size long, upto0 long, upto1 long")
    if len(counted) <= FEW:
        cuts = F.broadcast(cuts)
    placed = ranked(comps.select("component", "bundle").join(cuts, "bundle"), "bundle", seed, "component")
    split = F.when(F.col("rank") < F.col("upto0"), SPLITS[0]).when(F.col("rank") < F.col("upto1"), SPLITS[1]).otherwise(SPLITS[2])
    return _keyed(records, by).select("id", "component").join(placed.select("component", split.alias("split")), "component").select("id", "component", "split")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The speakers that the present splits separate: components of more than one split, by the number of their speaker."""
    comps = components(table(spark, sf_dir, "dataset_records"), "speaker")
    return comps.where("splits > 1 and startswith(component, 'k:')").select(F.substring("component", 3, 30).cast("bigint").alias("speaker_no"))


def p5_splits(spark, sf_dir: str) -> DataFrame:
    """The new split of each record, speakers kept together."""
    return grouped_splits(table(spark, sf_dir, "dataset_records"))


def p5_splits_by_source(spark, sf_dir: str) -> DataFrame:
    """The new split of each record, sources kept together."""
    return grouped_splits(table(spark, sf_dir, "dataset_records"), "source")


def p5_split_shares(spark, sf_dir: str) -> DataFrame:
    """What the new splits hold: records, their share, and the largest group in each."""
    per = grouped_splits(table(spark, sf_dir, "dataset_records")).groupBy("split", "component").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("records"), F.count("*").alias("groups"), F.max("n").alias("largest"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("records").alias("every")))).select("split", "records", "groups", "largest", (F.col("records") / F.col("every")).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits, "p5_splits_by_source": p5_splits_by_source, "p5_split_shares": p5_split_shares}
SQL = {
    "p5_found": """
SELECT TRY_CAST(nullif(regexp_extract(speaker_id, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS speaker_no
FROM dataset_records WHERE id IS NOT NULL AND lower(trim(split)) IN ('train', 'validation', 'test')
GROUP BY 1 HAVING speaker_no IS NOT NULL AND count(DISTINCT lower(trim(split))) > 1""",
}
