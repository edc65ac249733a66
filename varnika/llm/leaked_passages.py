"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search.

A passage of n words has leaked into a document that holds 16 of its words in a row, or the whole passage with at most n // 9 words
exchanged. The passage is cut into q pieces, q at least n // 9 + 1 and each piece of 8 words at most: a run of 16 words then covers
one piece wholly, and so does a whole passage with n // 9 exchanges (one piece is free of them). So the pieces are the patterns: a
block shift table skips what can't be an end of a pattern's window, a hash of the window's last block leads to the patterns with that
suffix, and direct comparison confirms them. Where a piece occurs, its passage is laid on the document's words and compared.

The documents are read once, in one pass without a shuffle. The tables of patterns go to each executor; their size is that of the
passages, which ``MAX_PASSAGE_BYTES`` bounds (beyond it, the passages are searched in blocks of that size, one pass each).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from varnika.functions.text import py_words
from varnika.session import table

RUN = 16
PIECE = 8
EXCHANGED = 9
BLOCK = 3
MAX_PASSAGE_BYTES = 16 << 20


def allowed(n: int) -> int:
    """Words of n that may be exchanged."""
    return n // EXCHANGED


def pieces(n: int) -> list[tuple[int, int]]:
    """Beginning and end of each piece of a passage of n words."""
    q = max(allowed(n) + 1, -(-n // PIECE))
    cuts = [round(i * n / q) for i in range(q + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


class Searcher:
    """Shift and hash tables over the pieces of the passages."""

    def __init__(self, passages: list[tuple[int, list[str]]]) -> None:
        self.passages = passages
        patterns: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(passages):
            for a, b in pieces(len(words)):
                patterns[f" {' '.join(words[a:b])} "].append((k, a))
        self.window = min(map(len, patterns), default=0)
        self.block = min(BLOCK, self.window)
        self.jump = self.window - self.block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, list[tuple[int, int]]]]] = defaultdict(list)
        for p, places in patterns.items():
            for end in range(self.block, self.window + 1):
                part = p[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.jump), self.window - end)
            self.bucket[p[self.window - self.block : self.window]].append((p, places))

    def leaked(self, words: list[str]) -> set[int]:
        """The passages (by number) of which the document has enough."""
        found: set[int] = set()
        if not self.window or not words:
            return found
        text = f" {' '.join(words)} "
        end, last, window, block, jump, shift = self.window, len(text), self.window, self.block, self.jump, self.shift
        tried: set[tuple[int, int]] = set()
        while end <= last:
            step = shift.get(text[end - block : end], jump)
            if step:
                end += step
                continue
            start = end - window
            for p, places in self.bucket.get(text[end - block : end], ()):
                if text.startswith(p, start):
                    at = text.count(" ", 0, start + 1) - 1
                    for k, a in places:
                        if k not in found and (k, at - a) not in tried:
                            tried.add((k, at - a))
                            if self._holds(words, self.passages[k][1], at, a):
                                found.add(k)
            end += 1
        return found

    @staticmethod
    def _holds(words: list[str], passage: list[str], at: int, a: int) -> bool:
        """The passage's word a stands at the document's word at: the longest run through there, then the whole."""
        base, n = at - a, len(passage)
        same = [0 <= base + i < len(words) and words[base + i] == passage[i] for i in range(n)]
        run = 0
        for x in same:
            run = run + 1 if x else 0
            if run >= RUN:
                return True
        return base >= 0 and base + n <= len(words) and n - sum(same) <= allowed(n)


def leaked_passages(documents: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id of each document and each passage that leaked into it.

    Null or empty texts and passages have no leak; a passage without words is never found; equal passages under several ids are all
    reported; repeated rows count once; extra columns are ignored.
    """
    spark = documents.sparkSession
    items = passages.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = size // MAX_PASSAGE_BYTES + 1
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['i'].dataType.simpleString()}"

    def search(block: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(sorted(((r.i, w) for r in own.toLocalIterator() if (w := py_words(r.t))), key=lambda x: str(x[0])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = Searcher(shared.value)
            for x in batches:
                got = [(d, searcher.passages[k][0]) for d, s in zip(x["doc_id"], x["text"]) for k in searcher.leaked(py_words(s))]
                yield pd.DataFrame(got, columns=["doc_id", "item_id"])

        return rows.mapInPandas(run, out)

    return reduce(DataFrame.unionByName, (search(b) for b in range(blocks))).distinct()


def p8_found(spark, sf_dir: str) -> DataFrame:
    """The documents that hold a held-out passage, with the passage."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p8_leaked_items(spark, sf_dir: str) -> DataFrame:
    """The held-out items that leaked: in how many documents and sources of documents."""
    docs = table(spark, sf_dir, "documents")
    found = leaked_passages(docs, table(spark, sf_dir, "heldout_items"))
    return found.join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("sources"))


QUERIES = {"p8_found": p8_found, "p8_leaked_items": p8_leaked_items}
SQL: dict[str, str] = {}
