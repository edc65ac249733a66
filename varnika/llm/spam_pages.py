"""Keyword-stuffed and link-list pages by robust Mahalanobis distance.

The texts are read once: each page is written as the hashes of its words, the sizes of its pieces between stops, and those features that
ask for nothing else; the same pass counts the words of each group. All else works on these numbers, in arrays.

1. Function words: for each group (label of language and script of the page) the words that stand in a third of its pages. They are
   counted over all pages, by group and word, summed in each task first; only the words above that share reach the driver (pages of w
   distinct words on average have at most 5 w of them). The share is of ``PRIOR`` pages more, so that in a small group chance makes none.
2. Features of a page, in the group whose function words cover it best, so a wrong or missing label does no harm: density of links,
   tags and marks; entropy of words; repetition of words and of word pairs; function words; share of its text in sentences (pieces
   between stops with at least the share ``SENTENCE`` of function words of any group, as a page may mix languages).
3. Location and scatter per group: from median and median deviation, then concentration steps (moments of the half with the smallest
   distances), all over every page; only moments and histograms reach the driver. A group's deviations are averaged with those of all
   groups, which count as ``PRIOR`` pages.
4. A page is spam if it is an outlier (chi-square quantile) in the spam direction (far fewer function words or far more links than its
   group; where the group has no norm, far more links or repetition than the others), its words are evidence enough for that
   direction, and less than half of its text are sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from varnika.functions.text import INVISIBLE
from varnika.session import table, written

SEED = 0.2
COMMON = 0.35
SENTENCE = 0.45
#: Pages that a group has in common with all others.
PRIOR = 8
#: Log-likelihood ratio of a page's words against its group from which they are evidence.
EVIDENCE = 3.0
STEPS = 3
OTHERS = "*"
BINS = 600
FEATURES = ("link", "mark", "entropy", "top", "repeat", "func", "sent")
#: Chi-square quantile .999 and median for 7 degrees of freedom.
FAR, MEDIAN = 24.32, 6.346

_LINK = re.compile(r"(?:https?://|www\.)\S+|[a-z0-9][\w-]*(?:\.[a-z0-9][\w-]*)*\.[a-z]{2,}\b\S*|<a\s[^>]*>|[#@+]\w[^\s|,]*|\b[a-z]+:[^\s|,]+", re.I)
_STOP = re.compile(r"[\n।॥.?!|•]+")
_WORD = re.compile(r"[^\W\d_][\wऀ-ॣ]*")
#: What no link or tag lacks; most pages have none of it.
_HINT = re.compile(r"[#@+/<]|www\.|\.\w|:\S")
_MARK = re.compile(r"[^\w\sऀ-ॿ]")
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_NAMES = {"hi": "hin hindi", "bho": "bhojpuri", "mai": "maithili", "awa": "awadhi", "mwr": "marwari", "en": "eng english"}
_CODES = {w: k for k, v in _NAMES.items() for w in [k, *v.split()]}


def _latin(words: list[str], text: str) -> bool:
    """Whether most of the characters of a page's words are Latin letters; of its whole text if it has no words outside links and tags."""
    s = "".join(words) or text
    return len(s.encode("ascii", "ignore").translate(None, _NO_LETTERS)) * 2 > len(s)


def _group(lang: str | None, words: list[str], text: str) -> str:
    label = re.split(r"[-_ ]", (lang or "").strip().lower())[0]
    code = _CODES.get(label, label if label.isalpha() and label not in ("und", "unknown", "xx", "null") else "")
    return f"{code}/{'latin' if _latin(words, text) else 'other'}" if code else ""


def _unlinked(text: str) -> tuple[str, int]:
    """The text in small letters with a null character for each link or tag, and their number."""
    text = _HIDDEN.sub("", text).lower()
    return _LINK.subn(" \x00 ", text) if _HINT.search(text) else (text, 0)


def _split(text: str) -> tuple[int, int, list[tuple[int, bool, list[str]]]]:
    """Links, their characters, and for each piece between stops: characters without links, whether it holds a link, words."""
    bare, links = _unlinked(text)
    return links, max(0, len(text) - len(bare) + 3 * links) if links else 0, [(len(s), "\x00" in s, _WORD.findall(s)) for x in _STOP.split(bare) if (s := x.strip())]


ROW = "kind int, doc_id {}, lang string, id long, n long, links long, linked long, marks double, entropy double, top double, rep double, ids array<long>, size array<int>, chars array<int>, plain array<boolean>"


class _Ids(dict):
    """Hash by word; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = word_id(word)
        return h


def word_id(word: str) -> int:
    """The 63-bit hash by which a word is known."""
    return xxhash.xxh64_intdigest(word) >> 1


def read_pages(pages: DataFrame) -> DataFrame:
    """ROW: of kind 1 a row per page; of kind 2 how many pages a group (lang) has, of kind 3 how many of them have a word (id), in parts."""
    kind = pages.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, Counter[int]] = defaultdict(Counter)
        sizes: Counter[str] = Counter()
        hashes = _Ids()

        def counts() -> pd.DataFrame:
            words = [(g, w, k) for g, c in by.items() for w, k in c.items()]
            every = [(g, None, k) for g, k in sizes.items()]
            got = pd.DataFrame({"kind": [3] * len(words) + [2] * len(every), "lang": pd.Series([r[0] for r in words + every], dtype=object), "id": pd.array([r[1] for r in words + every], dtype="Int64"), "n": [r[2] for r in words + every]})
            by.clear()
            sizes.clear()
            empty = pd.Series([None] * len(got), dtype=object)
            return got.assign(**{c: empty for c in names if c not in got.columns})[names]

        for x in batches:
            rows = []
            for doc, lang, text in zip(x["doc_id"], x["lang"], x["text"]):
                links, linked, parts = _split(text)
                words = [w for _, _, p in parts for w in p]
                n = len(words)
                ids = [hashes[w] for w in words]
                count = Counter(ids)
                own = _group(lang, words, text)
                if own and n:
                    by[own].update(count.keys())
                    sizes[own] += 1
                entropy = -sum(k / n * math.log(k / n) for k in count.values()) / math.log(n + 1) if n else 0.0
                repeat = 1 - len(set(zip(ids, ids[1:]))) / (n - 1) if n > 1 else 0.0
                marks = len(_MARK.findall(text)) / len(text)
                rows.append((1, doc, own, None, n, links, linked, marks, entropy, max(count.values(), default=0) / max(1, n), repeat, ids, [len(p) for _, _, p in parts], [s for s, _, _ in parts], [not link for _, link, _ in parts]))
            yield pd.DataFrame(rows, columns=names).astype({"id": "Int64"})
            if sum(map(len, by.values())) > 500_000:
                yield counts()
        if sizes:
            yield counts()

    return pages.select("doc_id", "lang", "text").mapInPandas(run, ROW.format(kind))


class Cover:
    """How much of each page the function words of each group cover."""

    def __init__(self, groups: dict[str, frozenset[int]]) -> None:
        self.names = sorted(groups)
        self.keys = np.array(sorted({w for ws in groups.values() for w in ws}), dtype=np.int64)
        self.held = np.zeros((len(self.keys), len(self.names)), dtype=np.int64)
        for g, name in enumerate(self.names):
            self.held[np.searchsorted(self.keys, sorted(groups[name])), g] = 1

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word is a function word of any group, its place among them)."""
        at = np.minimum(np.searchsorted(self.keys, ids), max(0, len(self.keys) - 1))
        return (self.keys[at] == ids if len(self.keys) else np.zeros(len(ids), dtype=bool)), at

    def best(self, ids: np.ndarray, owner: np.ndarray, own: list[str]) -> tuple[list[str], np.ndarray]:
        """(group, its words) of each page: of equal ones its own, then the last by name; its own where no word is known."""
        known, at = self.find(ids)
        g = len(self.names)
        cover = np.stack([np.bincount(owner[known], weights=self.held[at[known], k], minlength=len(own)) for k in range(g)], axis=1) if g else np.zeros((len(own), 1))
        place = {name: k for k, name in enumerate(self.names)}
        mine = np.array([place.get(name, -1) for name in own])
        score = cover * (2 * g + 2) + np.arange(cover.shape[1])[None, :] + (np.arange(cover.shape[1])[None, :] == mine[:, None]) * (g + 1)
        pick = score.argmax(axis=1)
        covered = cover[np.arange(len(own)), pick]
        return [self.names[k] if c > 0 else name for k, c, name in zip(pick, covered, own)], covered


def _flat(arrays: pd.Series, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of all pages, and the page of each."""
    size = arrays.map(len).to_numpy()
    return np.concatenate([np.asarray(v, dtype=kind) for v in arrays] or [np.zeros(0, dtype=kind)]), np.repeat(np.arange(len(arrays)), size)


def _frequent(counts: DataFrame, sizes: DataFrame, share: float) -> dict[str, frozenset[int]]:
    """The words of each group that stand in the share of its pages; one job, and only these words reach the driver."""
    n = sizes.groupBy("lang").agg(F.sum("n").alias("pages"))
    got = counts.groupBy("lang", "id").agg(F.sum("n").alias("n")).join(F.broadcast(n) if n.count() <= 100_000 else n, "lang").where(F.col("n") >= share * (F.col("pages") + PRIOR))
    out: dict[str, set[int]] = defaultdict(set)
    for r in got.select("lang", "id").toLocalIterator():
        out[r.lang].add(r.id)
    return {g: frozenset(w) for g, w in out.items()}


def function_words(rows: DataFrame) -> dict[str, frozenset[int]]:
    """The function words (by word_id) of each group, from read_pages().

    The labels give a first choice at a low share. Then each page counts in the group that covers it best, which separates the pages
    with a wrong or no label, and the higher share decides.
    """
    first = _frequent(rows.where("kind = 3"), rows.where("kind = 2"), SEED)
    shared = rows.sparkSession.sparkContext.broadcast(Cover(first))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cover = shared.value
        for x in batches:
            ids, owner = _flat(x["ids"])
            order = np.lexsort((ids, owner))
            ids, owner = ids[order], owner[order]
            once = np.ones(len(ids), dtype=bool)
            once[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
            ids, owner = ids[once], owner[once]
            names, _ = cover.best(ids, owner, [""] * len(x))
            group = pd.Categorical(names)
            pairs = pd.DataFrame({"g": group.codes[owner], "id": ids}).groupby(["g", "id"]).size().reset_index(name="n")
            filled = Counter(g for g, ws in zip(names, x["ids"]) if len(ws))
            lang = [group.categories[k] for k in pairs["g"]] + list(filled)
            ids = pd.array([*pairs["id"], *[None] * len(filled)], dtype="Int64")
            out = pd.DataFrame({"lang": pd.Series(lang, dtype=object), "id": ids, "n": [*pairs["n"], *filled.values()]})
            yield out[out["lang"] != ""]

    counts = written(rows.where("kind = 1").select("ids").mapInPandas(run, "lang string, id long, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")))
    return _frequent(counts.where("id is not null"), counts.where("id is null"), COMMON)


def features(rows: DataFrame, common: dict[str, frozenset[int]]) -> DataFrame:
    """doc_id, grp, tokens and FEATURES of each page, from read_pages()."""
    shared = rows.sparkSession.sparkContext.broadcast(Cover(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cover = shared.value
        for x in batches:
            ids, owner = _flat(x["ids"])
            names, covered = cover.best(ids, owner, list(x["lang"]))
            size, page = _flat(x["size"])
            chars, plain = _flat(x["chars"])[0], _flat(x["plain"], bool)[0]
            known = np.concatenate([[0], np.cumsum(cover.find(ids)[0])])
            ends = np.cumsum(size)
            sentence = plain & (size >= 4) & (known[ends] - known[ends - size] >= SENTENCE * size)
            total = x["linked"].to_numpy() + np.bincount(page, weights=chars, minlength=len(x))
            sent = np.bincount(page, weights=chars * sentence, minlength=len(x))
            links, tokens = x["links"].to_numpy(), (x["n"] + x["links"]).to_numpy()
            some = np.maximum(1, tokens)
            yield pd.DataFrame({"doc_id": x["doc_id"], "grp": names, "tokens": tokens, "link": np.minimum(1.0, links / some), "mark": x["marks"], "entropy": x["entropy"], "top": x["top"], "repeat": x["rep"], "func": covered / some, "sent": sent / np.maximum(1, total)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.where("kind = 1").mapInPandas(run, f"doc_id {kind}, grp string, tokens long, " + ", ".join(f"{f} double" for f in FEATURES))


def _distances(x: pd.DataFrame, fits: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.full(len(x), np.nan)
    values = x[list(FEATURES)].to_numpy()
    for g, at in x.groupby("grp").indices.items():
        if g in fits:
            mean, inverse = fits[g]
            d = values[at] - mean
            out[at] = np.einsum("ij,jk,ik->i", d, inverse, d)
    return out


def _fit(feats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group: location, inverse scatter, robust deviation of each feature."""
    k = len(FEATURES)
    got = feats.where("tokens > 0").groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 2000).alias(f) for f in FEATURES]).collect()  # a row per group
    sizes = {r.grp: r.n for r in got}
    quartiles = {r.grp: np.array([r[f] for f in FEATURES]) for r in got}
    own_spread = {g: (q[:, 2] - q[:, 0]) / 1.349 for g, q in quartiles.items()}
    pooled = sum((n * own_spread[g] ** 2 for g, n in sizes.items()), np.zeros(k)) / max(1, sum(sizes.values()))
    spread = {g: np.maximum(np.sqrt((n * own_spread[g] ** 2 + PRIOR * pooled) / (n + PRIOR)), 0.01) for g, n in sizes.items()}
    fits = {g: (q[:, 1], np.diag(1 / spread[g] ** 2)) for g, q in quartiles.items()}
    edges = np.concatenate([[0], np.geomspace(1e-3, 1e6, BINS)])
    sc = feats.sparkSession.sparkContext
    own = feats.where("tokens > 0")
    for step in range(STEPS + 1):
        shared = sc.broadcast(fits)

        def histogram(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            n: Counter[tuple[str, int]] = Counter()
            for x in batches:
                n.update(zip(x["grp"], np.searchsorted(edges, _distances(x, shared.value), side="left")))
            yield pd.DataFrame([(g, b, c) for (g, b), c in n.items()], columns=["grp", "b", "n"])

        h = own.mapInPandas(histogram, "grp string, b int, n long").groupBy("grp", "b").agg(F.sum("n").alias("n")).toPandas()
        cut = {}
        for g, x in h.sort_values("b").groupby("grp"):
            if g in fits:
                at = int(x["b"].to_numpy()[np.searchsorted(x["n"].cumsum().to_numpy(), x["n"].sum() / 2)])
                cut[g] = edges[min(at, BINS)]
        if step == STEPS:  # the scatter of a half is too narrow: half of the distances should lie below the chi-square median
            fits = {g: (m, inverse * min(1.0, MEDIAN / max(cut.get(g, 0), 1e-9))) for g, (m, inverse) in fits.items()}
            break
        cuts = sc.broadcast(cut)

        def moments(batches: Iterator[pd.DataFrame], shared=shared, cuts=cuts) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for x in batches:
                d, values = _distances(x, shared.value), x[list(FEATURES)].to_numpy()
                for g, at in x.groupby("grp").indices.items():
                    if g in cuts.value:
                        v = np.column_stack([np.ones(len(at)), values[at]])[d[at] <= cuts.value[g]]
                        total[g] = total.get(g, 0) + v.T @ v
            yield pd.DataFrame([(g, i, float(v)) for g, m in total.items() for i, v in enumerate(np.ravel(m))], columns=["grp", "i", "v"])

        m = own.mapInPandas(moments, "grp string, i int, v double").groupBy("grp", "i").agg(F.sum("v").alias("v")).toPandas()
        for g, x in m.groupby("grp"):
            s = np.zeros((k + 1) ** 2)
            s[x["i"]] = x["v"]
            s = s.reshape(k + 1, k + 1)
            if s[0, 0] >= 2:
                mean = s[0, 1:] / s[0, 0]
                cov = s[1:, 1:] / s[0, 0] - np.outer(mean, mean) + np.diag((0.3 * spread[g]) ** 2)
                fits[g] = (mean, np.linalg.inv(cov))
    # a group that is mostly spam, or whose words are not known, is no norm: its pages are held against the mean of the others
    sent, func = FEATURES.index("sent"), FEATURES.index("func")
    good = {g: (*f, spread[g]) for g, f in fits.items() if f[0][sent] >= 0.5 and f[0][func] > 3 * spread[g][func]}
    if good:
        mean, dev = (np.average([f[i] for f in good.values()], axis=0, weights=[sizes[g] for g in good]) for i in (0, 2))
        good[OTHERS] = (mean, np.diag(1 / dev**2), dev)
    return good


def _evidence(n: np.ndarray, share: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of a share among n tokens against the usual one (of at least a hundredth)."""
    p = np.clip(usual, 0.01, 0.99)
    x = np.clip(share, 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(x > 0, x * np.log(x / p), 0) + np.where(x < 1, (1 - x) * np.log((1 - x) / (1 - p)), 0)
    return n * d


def spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id, grp, distance, func, sent, spam of each page that has text (documents: doc_id, text, lang; other columns are ignored).

    Null and empty texts have no row; pages without words and links have distance null and are no spam; a page of a few words is spam
    only if these are evidence, as three bare links are; the label of language may be null, wrong or spelled in capitals. Repeated
    rows are judged each. An empty table gives no rows.
    """
    pages = documents.select("doc_id", "lang", "text").where("doc_id is not null and text is not null and trim(text) <> ''")
    rows = written(read_pages(pages))
    feats = written(features(rows, function_words(rows)))
    fits = feats.sparkSession.sparkContext.broadcast(_fit(feats))
    at = {f: i for i, f in enumerate(FEATURES)}
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = fits.value
        plain = {g: f[:2] for g, f in norms.items()}

        def usual(norm: pd.Series, f: str) -> np.ndarray:
            return norm.map({g: n[0][at[f]] for g, n in norms.items()}).to_numpy(dtype=float)

        def beyond(x: pd.DataFrame, norm: pd.Series, f: str, sign: int) -> np.ndarray:
            limit = {g: n[0][at[f]] + sign * 3 * n[2][at[f]] for g, n in norms.items()}
            far = (sign * (x[f] - norm.map(limit)) > 0).to_numpy()
            return far & (_evidence(x["tokens"].to_numpy(), x[f].to_numpy(), usual(norm, f)) >= EVIDENCE)

        for x in batches:
            norm = x["grp"].where(x["grp"].isin(list(norms)), OTHERS)
            d = _distances(x.assign(grp=norm), plain)
            some = (x["tokens"] > 0).to_numpy()
            known = (norm != OTHERS).to_numpy()
            directed = beyond(x, norm, "link", 1) | known & beyond(x, norm, "func", -1) | ~known & (beyond(x, norm, "repeat", 1) | beyond(x, norm, "entropy", -1))
            spam = some & directed & (d > FAR) & (x["sent"] < 0.5).to_numpy()
            yield pd.DataFrame({"doc_id": x["doc_id"], "grp": x["grp"], "distance": np.where(some, d, np.nan), "func": x["func"], "sent": x["sent"], "spam": spam})

    return feats.mapInPandas(run, f"doc_id {kind}, grp string, distance double, func double, sent double, spam boolean")


def p10_found(spark, sf_dir: str) -> DataFrame:
    """The pages that are spam."""
    return spam_pages(table(spark, sf_dir, "documents")).where("spam").select("doc_id").distinct()


def p10_spam_by_source(spark, sf_dir: str) -> DataFrame:
    """Pages and spam pages of each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source").join(spam_pages(docs).select("doc_id", "spam"), "doc_id").groupBy("source").agg(F.count("*").alias("pages"), F.count_if("spam").alias("spam"))


QUERIES = {"p10_found": p10_found, "p10_spam_by_source": p10_spam_by_source}
SQL: dict[str, str] = {}
