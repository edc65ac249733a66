"""Same or near-same records across splits.

A text is a vector over its words (the k-th occurrence of a word is a term of its own) with a weight per term between 1 and
``SPREAD``, the rarer the heavier. Two texts are linked if, of the longer one's words, at least seven eighths stand in the other in
the same order. Then the common weight is at least ``7 / (7 + SPREAD)`` of the larger total weight, so no linked pair lies below
that bound on the weighted dot product.

Inverted lists: the terms of a text in the order rare to frequent; the list stops where the rest of the text's weight (residual)
plus the weight of its heaviest term (maximum) can no longer reach the bound. Linked texts then share two terms of their lists at
least, so the lists are kept by *pairs* of terms, which are short even where single terms are frequent. Lists of long texts (``LONG``
words) are kept by single terms together with the length on a scale of steps of 8/7: keys then grow with the text, not with its
square, and linked texts stand on the same step or on neighbouring ones. Candidates pass an exact
test on a 48-bit parity sketch (each differing word flips one bit), then dot product and word order are computed exactly.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from varnika.functions.text import py_words
from varnika.session import table, written

SPREAD = 1.1
#: Term counts are kept by hash: this many counters, whatever the corpus (4 MB to every executor).
COUNTERS = 1 << 19
#: Candidate pairs up to which their classes (16 bytes each pair) are broadcast; beyond, the join shuffles.
SMALL = 500_000
#: Texts of so many words are kept by single terms and their length: the pairs of their list would grow with its square.
LONG = 256
#: Lengths are packed into 16 bits; texts of more words skip the tests on length and sketch and are compared exactly.
LONGEST = 0xFFFF


class _Hashes(dict):
    """Hash by term; forgets all when it has grown large."""

    def __missing__(self, term: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[term] = xxhash.xxh64_intdigest(term)
        return h


def _terms(words: list[str], hashes: _Hashes) -> list[int]:
    """Hash of each word and its number of occurrence."""
    if len(set(words)) == len(words):
        return [hashes[w] for w in words]
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen[w] = seen.get(w, 0) + 1
        out.append(hashes[w] if k == 1 else hashes[f"{w}\x1f{k}"])
    return out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _normalised(records: DataFrame, fields: tuple[str, ...], id_col: str, split_col: str, source_col: str, train: str, evaluation: tuple[str, ...]) -> DataFrame:
    """A row per record and non-blank text: id, split, source, field, text, n, cls, side (1 train, 2 evaluation).

    The same pass counts in how many texts each term stands, by the term's hash; these counts come as rows of side 0 (cls is the
    counter, n the count), at most COUNTERS from each task.
    """
    split = F.lower(F.trim(F.col(split_col)))
    rows = (
        records.select(F.col(id_col).cast("string").alias("id"), split.alias("split"), F.col(source_col).cast("string").alias("source"), *[F.col(f).alias(f"text{k}") for k, f in enumerate(fields)])
        .where(F.col("id").isNotNull() & F.col("split").isin(train, *evaluation))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = _Hashes(), np.zeros(COUNTERS, dtype=np.int64)
        for x in batches:
            found: list[int] = []
            for k in range(len(fields)):
                words = [py_words(s) for s in x[f"text{k}"]]
                texts = [" ".join(w) for w in words]
                out = pd.DataFrame({"id": x["id"], "split": x["split"], "source": x["source"], "field": k, "text": texts, "n": [len(w) for w in words], "cls": np.array([xxhash.xxh64_intdigest(t, seed=k + 1) for t in texts], dtype=np.uint64).view(np.int64), "side": np.where(x["split"] == train, 1, 2)})
                yield out[[w != [] and w != ["null"] for w in words]]
                for w in words:
                    found += _terms(w, hashes)
            total += np.bincount((np.array(found, dtype=np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": None, "split": None, "source": None, "field": -1, "text": None, "n": total[at], "cls": at, "side": 0})

    return rows.mapInPandas(run, "id string, split string, source string, field int, text string, n int, cls long, side int")


def _term_counts(rows: DataFrame) -> np.ndarray:
    """How many texts hold a term, by hash: one array of COUNTERS numbers, added up on the executors."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    got = rows.where("side = 0").groupBy("cls").agg(F.sum("n").alias("n")).toPandas()
    counts[got["cls"].to_numpy()] = got["n"].to_numpy()
    return counts


def _weights(counts: np.ndarray) -> np.ndarray:
    return (1 + (SPREAD - 1) * (1 - np.log1p(counts) / math.log1p(max(1, int(counts.max(initial=1)))))).astype(np.float32)


def _lists(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """cls, key: the pairs of terms under which each class stands in the inverted lists; packed: its sketch (48 bits) and length; sides."""
    shared = texts.sparkSession.sparkContext.broadcast((counts.astype(np.int64).tobytes(), _weights(counts).tobytes()))
    bound = 7 / (7 + SPREAD)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, heavy = array("q", shared.value[0]), array("f", shared.value[1])
        hashes, mask = _Hashes(), COUNTERS - 1
        for x in batches:
            x = x.drop_duplicates(["cls", "side"])
            packed, firsts = [], []
            for s in x["text"]:
                terms = _terms(s.split(" "), hashes)
                sketch = 0
                for h in terms:
                    sketch ^= 1 << (h >> 32) % 48
                packed.append(sketch << 16 | min(len(terms), LONGEST))
                total = most = 0.0
                order = []
                for h in terms:
                    at = h & mask
                    total += heavy[at]
                    order.append((count[at], h))
                order.sort()
                most = heavy[order[0][1] & mask]
                left, k, need, enough = total, 0, bound * total - most - 1e-4, len(terms) // 8 + 2
                while k < enough and left >= need:
                    left -= heavy[order[k][1] & mask]
                    k += 1
                firsts.append(np.array([h for _, h in order[:k]], dtype=np.uint64).view(np.int64))
            yield pd.DataFrame({"cls": x["cls"], "packed": np.array(packed, dtype=np.uint64).view(np.int64), "terms": firsts, "side": x["side"], "field": x["field"]})

    per_class = (
        texts.mapInPandas(run, "cls long, packed long, terms array<long>, side int, field int")
        .groupBy("cls", "packed", "field")
        .agg(F.first("terms").alias("terms"), F.bit_or("side").alias("sides"))
    )
    n = F.col("packed").bitwiseAND(F.lit(LONGEST))
    pairs = F.expr("flatten(transform(terms, (x, i) -> transform(slice(terms, i + 2, size(terms)), y -> xxhash64(field, x, y))))")
    none = F.array().cast("array<long>")
    # linked texts of which the longer one has LONG words or more have 7/8 LONG both; of the others both have fewer than LONG
    level = F.floor(F.log(n.cast("double")) / math.log(8 / 7) + 1e-9)
    single = F.flatten(F.transform("terms", lambda x: F.array(F.xxhash64("field", x, level), F.xxhash64("field", x, level + 1))))
    keys = F.concat(F.when(n < LONG, pairs).otherwise(none), F.when(n * 8 >= LONG * 7, single).otherwise(none))
    return per_class.select("cls", "packed", "sides", F.explode(keys).alias("key"))


def split_overlaps(records: DataFrame, fields: tuple[str, ...] = ("anchor_text", "target_text"), id_col: str = "id", split_col: str = "split", source_col: str = "source", train: str = "train", evaluation: tuple[str, ...] = ("validation", "test")) -> tuple[DataFrame, DataFrame]:
    """Links between the texts of training and of evaluation records.

    Returns (links, members). links: field (number of the text field), cls_train, cls_eval, common (words in the same order), cosine;
    a class is one text, and a class linked with itself stands in both splits. members: id, split, source, field, n, cls, side.

    Records without id or with a split that is none of those named take no part; blank and null texts match nothing; repeated rows
    count once; other columns are ignored. An empty table gives no links.
    """
    rows = written(_normalised(records, fields, id_col, split_col, source_col, train, evaluation))
    counts = _term_counts(rows)
    members = rows.where("side > 0")
    # a text of fewer than seven words can only match exactly; seven of them are seven eighths of eight
    lists = _lists(members.where("n >= 7").select("cls", "text", "side", "field"), counts)
    a = lists.where("sides != 2").select("key", F.col("cls").alias("cls_train"), F.col("packed").alias("p_a"))
    b = lists.where("sides != 1").select("key", F.col("cls").alias("cls_eval"), F.col("packed").alias("p_b"))
    n_a, n_b = (F.col(c).bitwiseAND(F.lit(LONGEST)) for c in ("p_a", "p_b"))
    need = F.ceil(F.greatest(n_a, n_b) * 7 / 8)
    flips = F.bit_count(F.shiftrightunsigned(F.col("p_a").bitwiseXOR(F.col("p_b")), 16))
    near = (
        a.join(b, "key")
        .where((F.greatest(n_a, n_b) == LONGEST) | ((F.least(n_a, n_b) >= need) & (flips <= n_a + n_b - 2 * need)))
        .where("cls_train != cls_eval")
        .select("cls_train", "cls_eval")
        .distinct()
    )
    near = written(near)
    wanted = near.select(F.explode(F.array("cls_train", "cls_eval")).alias("cls")).distinct()
    if near.count() <= SMALL:  # so few that no text has to be shuffled to find theirs
        wanted = F.broadcast(wanted)
    texts = members.select("cls", "text", "field").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text"), F.min("field").alias("field"))
    shared = records.sparkSession.sparkContext.broadcast(_weights(counts).tobytes())

    @F.pandas_udf("common int, cosine double")
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        heavy, hashes, mask = array("f", shared.value), _Hashes(), COUNTERS - 1
        out = []
        for s, t in zip(x, y):
            a, b = s.split(" "), t.split(" ")
            p, q = set(_terms(a, hashes)), set(_terms(b, hashes))
            dot, *norms = (sum(heavy[h & mask] for h in z) for z in (p & q, p, q))
            out.append((lcs(a, b), dot / math.sqrt(norms[0] * norms[1])))
        return pd.DataFrame(out, columns=["common", "cosine"])

    left = texts.select(F.col("cls").alias("cls_train"), F.col("text").alias("x"), "field")
    right = texts.select(F.col("cls").alias("cls_eval"), F.col("text").alias("y"))
    words = lambda c: F.size(F.split(c, " "))
    links = (
        near.join(left, "cls_train")
        .join(right, "cls_eval")
        .withColumn("got", compare("x", "y"))
        .where(F.col("got.common") * 8 >= F.greatest(words("x"), words("y")) * 7)
        .select("field", "cls_train", "cls_eval", "got.common", "got.cosine")
    )
    both = members.groupBy("cls", "field", "n").agg(F.bit_or("side").alias("sides")).where("sides = 3")
    same = both.select("field", F.col("cls").alias("cls_train"), F.col("cls").alias("cls_eval"), F.col("n").alias("common"), F.lit(1.0).alias("cosine"))
    return links.unionByName(same), members


def _pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    a = members.where("side = 1").select(F.col("cls").alias("cls_train"), F.col("id").alias("id_train"), F.col("source").alias("source_train"))
    b = members.where("side = 2").select(F.col("cls").alias("cls_eval"), F.col("id").alias("id_eval"), "split", F.col("source").alias("source_eval"))
    return links.join(a, "cls_train").join(b, "cls_eval")


def overlap_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """split, source, field, records (of that split and source with an overlap), train_records (that they meet), pairs.

    Pairs of records are counted from the sizes of the linked classes and never formed, so a sentence that stands in a third of all
    records costs no more than another. A record with several texts under one id counts in each of their classes.
    """
    own = members.select("id", "split", "source", "field", "cls", "side").distinct()
    evaluation = own.where("side = 2").groupBy("field", "cls", "split", "source").agg(F.count("*").alias("n_eval")).withColumnRenamed("cls", "cls_eval")
    train = own.where("side = 1").groupBy("field", "cls").agg(F.count("*").alias("n_train")).withColumnRenamed("cls", "cls_train")
    # a class is the hash of one text with the number of its field
    met = links.select("cls_train", "cls_eval").join(evaluation, "cls_eval")
    records = met.select("field", "cls_eval", "split", "source", "n_eval").distinct().groupBy("split", "source", "field").agg(F.sum("n_eval").alias("records"))
    classes = met.groupBy("split", "source", "field", "cls_train").agg(F.sum("n_eval").alias("n_eval")).join(train, ["field", "cls_train"])
    sums = classes.groupBy("split", "source", "field").agg(F.sum("n_train").alias("train_records"), F.sum(F.col("n_eval") * F.col("n_train")).alias("pairs"))
    # a null source is a group as well
    return records.join(sums, (records.split == sums.split) & records.source.eqNullSafe(sums.source) & (records.field == sums.field)).select(records.split, records.source, records.field, "records", "train_records", "pairs")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of a train and a validation or test record with the same or almost the same anchor or target text."""
    links, members = split_overlaps(table(spark, sf_dir, "dataset_records"))
    return _pairs(links, members).select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def p7_overlap_counts(spark, sf_dir: str) -> DataFrame:
    """Per evaluation split, its source and text field: the evaluation records with an overlap, the train records they meet, the pairs."""
    links, members = split_overlaps(table(spark, sf_dir, "dataset_records"))
    return overlap_counts(links, members)


QUERIES = {"p7_found": p7_found, "p7_overlap_counts": p7_overlap_counts}
SQL: dict[str, str] = {}
