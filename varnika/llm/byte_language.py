"""Missing or wrong document language labels: a byte convolutional network in numpy.

A text becomes one byte per character (ASCII as it is, the Devanagari block in the upper half). Filters of several widths run over
the bytes, their maxima are pooled over fixed-length windows, and a softmax gives each window's language. A filter on one-hot bytes is
a sum of table look-ups, so a batch of texts is classified by a few array operations. The windows of a text are decoded into segments
by the best path that pays for each change of language; a language whose windows hold too little evidence against the main one, or a
single word, is absorbed. Letters of other scripts are one unknown byte; a text mostly in those has no language.

The network is trained on the driver from labelled samples (``MAX_SAMPLES`` at most), each also in the other script by a plain
transliteration, with damaged copies; it is sent to the executors as one small object. All texts are classified whole, in one pass
without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varnika.functions.text import INVISIBLE, is_blank
from varnika.session import table

WIDTHS = (3, 5, 7)
FILTERS = 24
STRIDE = 12
BLOCKS = 4  # a window is so many strides
MAX_SAMPLES = 20_000
STEPS = 1500
BATCH = 128
#: Cost of a change of language on the path, in units of a stride's log-probability.
CHANGE = 4.5
#: Log-odds of the windows of a second language against the main one from which it counts.
EVIDENCE = 4.0
#: Characters that pass the network together, about.
CHUNK = 1 << 18
#: The language of a text in a script that the network doesn't know.
UNKNOWN = "und"
#: Log-odds that a label is right before the text is read.
TRUST = 2.5

# Spellings of the languages' labels (two- or three-letter codes, English names).
SPELLINGS = {"hi": ("hi", "hin", "hindi"), "bho": ("bho", "bhojpuri"), "mai": ("mai", "maithili"), "awa": ("awa", "awadhi"), "mwr": ("mwr", "marwari"), "en": ("en", "eng", "english")}

# Latin letters for Devanagari signs.
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split()))
_VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a aa i ee u oo ri e ai o au o e".split()))
_SIGNS = dict(zip("ािीुूृेैोौॉॅ", "aa i ee u oo ri e ai o au o e".split()))
_NASAL = {"ं": "n", "ँ": "n", "ः": "h"}

_MARKS = re.compile(r"<[^<>]{1,20}>|\{[^{}]{1,20}\}|\[[^\[\]]{1,20}\]|\([^()]{1,12}\)")
_HIDDEN = re.compile(f"[{INVISIBLE}]+")
_GAPS = re.compile(r"[^\wऀ-ॣ०-ॿ]+|_+")
_NUMBERS = re.compile(r"\d+")

_CODES = np.full(0x110000, ord("?"), dtype=np.uint8)
_CODES[:128] = np.arange(128)
_CODES[0x900:0x980] = np.arange(128, 256)


def label_code(c: Column) -> Column:
    """The language that a label names: capitals, region or script endings, three-letter codes and English names are other spellings. Else null."""
    bare = F.regexp_extract(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"^([a-z]+)(?:[-_ ].*)?$", 1)
    out = F.when(bare.isin(*SPELLINGS["hi"]), "hi")
    for code, names in SPELLINGS.items():
        out = out.when(bare.isin(*names), code)
    return out


def romanise(text: str) -> str:
    """Devanagari in Latin letters; a consonant's own vowel is written but at the end of a word."""
    out = []
    text = unicodedata.normalize("NFC", text).replace("़", "")
    for i, c in enumerate(text):
        following = text[i + 1] if i + 1 < len(text) else " "
        if c in _CONSONANTS:
            bare = following in _SIGNS or following == "्" or not ("ऀ" <= following <= "ॿ") or following in "।॥"
            out.append(_CONSONANTS[c] + ("" if bare else "a"))
        elif c in _VOWELS or c in _SIGNS:
            out.append(_VOWELS.get(c) or _SIGNS[c])
        elif c in _NASAL:
            out.append(_NASAL[c])
        elif c not in "्ऽ":
            out.append({"।": ".", "॥": "."}.get(c, c))
    return "".join(out)


def normal(text: str) -> str:
    """Small letters, words with single spaces, numbers as 0, without marks of the recogniser."""
    text = unicodedata.normalize("NFC", _HIDDEN.sub("", text)).lower()
    return _NUMBERS.sub("0", _GAPS.sub(" ", _MARKS.sub(" ", text))).strip()


def encode(text: str) -> np.ndarray:
    """One byte per character."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    return _CODES[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    weights: np.ndarray
    offset: np.ndarray

    def responses(self, stream: np.ndarray) -> np.ndarray:
        """(positions, filters): each filter's response at each byte; the stream needs the widest filter's length of spaces at its end."""
        n = len(stream) - max(WIDTHS) + 1
        out = np.empty((n, len(WIDTHS) * FILTERS), dtype=np.float32)
        for k, t in enumerate(self.tables):
            part = np.take(t[0], stream[:n], axis=0)
            for j in range(1, len(t)):
                part += np.take(t[j], stream[j : j + n], axis=0)
            out[:, k * FILTERS : (k + 1) * FILTERS] = part
        return out

    def windows(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of all windows of all texts, and where each text's begin. Blocks of STRIDE bytes; a window at each block covers BLOCKS of them around it.

        The responses are made for so many windows at a time as stay in the cache: of a text of any length only the result is held.
        """
        counts = np.array([max(1, -(-len(c) // STRIDE)) for c in codes])
        starts = np.concatenate([[0], np.cumsum(counts)])
        stream = np.full(starts[-1] * STRIDE + max(WIDTHS) - 1, 32, dtype=np.uint8)
        for c, s in zip(codes, starts):
            stream[s * STRIDE : s * STRIDE + len(c)] = c
        owner = np.repeat(np.arange(len(codes)), counts)
        out = np.empty((starts[-1], len(self.langs)))
        step, before, after = 4096, BLOCKS // 2, BLOCKS - BLOCKS // 2 - 1
        for a in range(0, starts[-1], step):
            b = min(a + step, starts[-1])
            lo, hi = max(0, a - before), min(starts[-1], b + after)
            top = self.responses(stream[lo * STRIDE : hi * STRIDE + max(WIDTHS) - 1]).reshape(hi - lo, STRIDE, -1).max(axis=1)
            pooled = top[a - lo : b - lo].copy()
            for shift in range(-before, after + 1):
                x, y = max(a, lo - shift), min(b, hi - shift)
                if shift and x < y:
                    same = owner[x:y] == owner[x + shift : y + shift]
                    np.maximum(pooled[x - a : y - a], np.where(same[:, None], top[x + shift - lo : y + shift - lo], -np.inf), out=pooled[x - a : y - a])
            s = np.maximum(pooled + self.bias, 0) @ self.weights + self.offset
            s -= s.max(axis=1, keepdims=True)
            out[a:b] = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return out, starts


def train(samples: list[tuple[str, str]], seed: int = 7, steps: int = STEPS) -> Network:
    """Adam on the cross-entropy of random windows. samples: (language, text)."""
    rng = np.random.default_rng(seed)
    langs = sorted({k for k, _ in samples})
    pool: list[list[np.ndarray]] = [[] for _ in langs]
    for lang, text in samples:
        forms = [normal(text)]
        if any("ऀ" <= c <= "ॿ" for c in text):
            forms.append(normal(romanise(text)))
        for k, f in enumerate(forms):
            if f:
                pool[langs.index(lang)].append(encode(f))
    # one stream of all forms, and for each language its forms as places and lengths, Devanagari ones three times as likely
    stream = np.full(sum(len(c) for p in pool for c in p) + 2 * STRIDE * BLOCKS, 32, dtype=np.uint8)
    spans, at = [], 0
    for lang, forms in zip(langs, pool):
        own = []
        for c in forms:
            stream[at : at + len(c)] = c
            own.append((at, len(c), 3.0 if lang != "en" and (c > 127).any() else 1.0))
            at += len(c)
        start, size, weight = (np.array(x) for x in zip(*own))
        spans.append((start.astype(np.int64), size.astype(np.int64), np.cumsum(weight / weight.sum())))
    length, f = STRIDE * BLOCKS, FILTERS
    wide = length + max(WIDTHS) - 1
    tables = [rng.normal(0, 0.25, (w, 256, f)).astype(np.float32) for w in WIDTHS]
    params = [*tables, np.zeros(len(WIDTHS) * f, np.float32), rng.normal(0, 0.1, (len(WIDTHS) * f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = length
    cells = np.arange(f)[None, :]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        pick, first, room = rng.random(BATCH), np.empty(BATCH, dtype=np.int64), np.empty(BATCH, dtype=np.int64)
        for k, (start, size, upto) in enumerate(spans):
            own = np.flatnonzero(y == k)
            which = np.minimum(np.searchsorted(upto, pick[own]), len(start) - 1)
            first[own], room[own] = start[which], size[which]
        size = np.minimum(room, np.where(rng.random(BATCH) < 0.75, length, rng.integers(16, length + 1, BATCH)))
        begin = first + (rng.random(BATCH) * (room - size + 1)).astype(np.int64)
        # mishearings: now and then a byte is lost or doubled, and those after it move
        noise = rng.random((BATCH, length))
        moved = np.arange(length)[None, :] + np.cumsum((noise < 0.25 / length).astype(np.int64) - (noise > 1 - 0.25 / length), axis=1)
        x = np.full((BATCH, wide), 32, dtype=np.uint8)
        x[:, :length] = np.where((moved >= 0) & (moved < size[:, None]), stream[begin[:, None] + np.clip(moved, 0, length + 12)], 32)
        acts = []
        for k, w in enumerate(WIDTHS):
            r = np.take(params[k][0], x[:, :n], axis=0)
            for j in range(1, w):
                r = r + np.take(params[k][j], x[:, j : j + n], axis=0)
            acts.append((r.max(axis=1), r.argmax(axis=1)))
        h0 = np.concatenate([a for a, _ in acts], axis=1) + params[-3]
        drop = (rng.random(h0.shape) > 0.2) / 0.8
        h = np.maximum(h0, 0) * drop
        s = h @ params[-2] + params[-1]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        s[np.arange(BATCH), y] -= 1
        s /= BATCH
        g_h = (s @ params[-2].T) * drop * (h0 > 0)
        grads = []
        for k, w in enumerate(WIDTHS):
            g = np.zeros_like(params[k])
            at, gk = acts[k][1], g_h[:, k * f : (k + 1) * f]
            for j in range(w):
                cell = np.take_along_axis(x, at + j, axis=1).astype(np.int64) * f + cells
                g[j] = np.bincount(cell.ravel(), weights=gk.ravel(), minlength=256 * f).reshape(256, f)
            grads.append(g + 1e-5 * params[k])
        grads += [g_h.sum(axis=0), h.T @ s + 1e-4 * params[-2], s.sum(axis=0)]
        rate = 0.01 * min(1, step / 50) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(langs, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def paths(logs: np.ndarray, starts: np.ndarray, change: float) -> np.ndarray:
    """The best language at each window of each text; all texts at once, longest first."""
    n, k = np.diff(starts), logs.shape[1]
    out = np.empty(len(logs), dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    first = starts[:-1][order]
    score = logs[first].copy()
    back = np.zeros((int(n.max(initial=0)), len(n), k), dtype=np.int8)
    for t in range(1, int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -t, side="left"))  # the texts with more than t windows
        s = score[:live]
        best = s.argmax(axis=1)
        moved = s.max(axis=1) - change
        stay = s >= moved[:, None]
        back[t, :live] = np.where(stay, np.arange(k)[None, :], best[:, None])
        score[:live] = np.where(stay, s, moved[:, None]) + logs[first[:live] + t]
    at = score.argmax(axis=1)
    for t in range(int(n.max(initial=0)) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        out[first[:live] + t] = at[:live]
        at[:live] = back[t, np.arange(live), at[:live]] if t else at[:live]
    return out


def chunks(sizes: list[int]) -> Iterator[list[int]]:
    """Places of texts that pass the network together: of like length, so that their number times the longest is at most CHUNK characters (or one text)."""
    part: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and (len(part) + 1) * sizes[i] > CHUNK:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def readable(form: str) -> bool:
    """Whether the network knows the script: at least half of the letters are Latin or Devanagari."""
    letters = [c for c in form if c.isalpha()]
    return 2 * sum(c.isascii() or "\u0900" <= c <= "\u097f" for c in letters) >= len(letters)


def segments(net: Network, texts: list[str], labels: list[str | None] | None = None, change: float = CHANGE) -> list[list[tuple[int, int, str, float]]]:
    """For each text its segments: first and last character (of the normal form), language, confidence.

    Texts without letters have none; a text mostly in a script that the network doesn't know is one segment of UNKNOWN, confidence 0.
    """
    forms = [normal(t) for t in texts]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    read = []
    for i, f in enumerate(forms):
        if any(c.isalpha() for c in f):
            if readable(f):
                read.append(i)
            else:
                out[i] = [(0, len(f), UNKNOWN, 0.0)]
    for part in chunks([len(forms[i]) for i in read]):
        own = [read[k] for k in part]
        logs, starts = net.windows([encode(forms[i]) for i in own])
        logs /= 2  # neighbouring windows share half of their bytes or more
        best = paths(logs, starts, change)
        for n, i in enumerate(own):
            out[i] = _merged(net, forms[i], best[starts[n] : starts[n + 1]], logs[starts[n] : starts[n + 1]], labels[i] if labels is not None else None)
    return out


def _merged(net: Network, form: str, own: np.ndarray, run: np.ndarray, label: str | None) -> list[tuple[int, int, str, float]]:
    """The segments of one text from its best path: languages without enough evidence go to the others."""
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
    parts = [(s, e, int(own[s])) for s, e in zip(cuts, cuts[1:])]
    if len(parts) > 1:
        windows = np.bincount(own, minlength=len(net.langs))
        main = int(windows.argmax())
        found = [k for k in np.flatnonzero(windows) if k != main]
        # the log-odds of its own windows against the main language, and words: a single word is no second language
        keep = [main]
        for k in found:
            mine = own == k
            words = sum(len(form[s * STRIDE : e * STRIDE].split()) for s, e, x in parts if x == k)
            if (run[mine, k] - run[mine, main]).sum() >= EVIDENCE and words > 1:
                keep.append(int(k))
        parts = [(s, e, k if k in keep else keep[int(run[s:e][:, keep].sum(axis=0).argmax())]) for s, e, k in parts]
        merged = [parts[0]]
        for s, e, k in parts[1:]:
            if k == merged[-1][2]:
                merged[-1] = (merged[-1][0], e, k)
            else:
                merged.append((s, e, k))
        parts = merged
    out = []
    for s, e, k in parts:
        total = run[s:e].sum(axis=0)
        if len(parts) == 1:
            if label in net.langs:
                total[net.langs.index(label)] += TRUST
            k = int(total.argmax())
        p = np.exp(total - total.max())
        out.append((s * STRIDE, min(e * STRIDE, len(form)), net.langs[k], float(p[k] / p.sum())))
    return out


def fit(samples: DataFrame) -> Network:
    """Train on the rows (lang, text) whose label names a language; MAX_SAMPLES of them at most, by hash."""
    code = label_code(F.col("lang"))
    rows = samples.select(code.alias("lang"), "text").where(code.isNotNull() & ~is_blank("text")).orderBy(F.xxhash64("text"), "text", "lang").limit(MAX_SAMPLES).toPandas()
    return train(list(zip(rows["lang"], rows["text"])))


def languages(texts: DataFrame, net: Network) -> DataFrame:
    """texts: table_name, record_id, label, text. A row per segment: table_name, record_id, label (code or null), segment, first, last, lang, confidence.

    Null and blank texts and texts without letters have no row; repeated rows count once; a text in one language is one segment, and
    its label counts as weak evidence; first and last count characters of the text without marks and double spaces. An empty table
    gives no rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(net)
    rows = texts.select("table_name", "record_id", label_code(F.col("label")).alias("label"), "text").where(F.col("record_id").isNotNull() & ~is_blank("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = segments(shared.value, list(x["text"]), list(x["label"]))
            got = [(t, r, lab, i, *s) for t, r, lab, parts in zip(x["table_name"], x["record_id"], x["label"], found) for i, s in enumerate(parts)]
            yield pd.DataFrame(got, columns=["table_name", "record_id", "label", "segment", "first", "last", "lang", "confidence"])

    return rows.mapInPandas(run, "table_name string, record_id string, label string, segment int, first int, last int, lang string, confidence double")


def _texts(spark, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "dataset_records").select(F.lit("dataset_records").alias("table_name"), F.col("id").alias("record_id"), F.col("target_language").alias("label"), F.col("target_text").alias("text"))
    b = table(spark, sf_dir, "boli_reviews").select(F.lit("boli_reviews").alias("table_name"), F.col("id").alias("record_id"), F.get_json_object("recognition", "$.language").alias("label"), F.col("recognized_text").alias("text"))
    return a.unionByName(b)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """The texts whose label is missing or wrong, and those in two languages; a row for each of their languages."""
    net = fit(table(spark, sf_dir, "variety_samples"))
    per = languages(_texts(spark, sf_dir), net)
    # codes only are shuffled, summed in each task first: repeated rows count once
    wrong = per.where(F.col("lang") != UNKNOWN).groupBy("table_name", "record_id").agg(F.collect_set("lang").alias("langs"), F.max(F.coalesce(F.col("label") != F.col("lang"), F.lit(True))).alias("off"))
    return wrong.where("off or size(langs) > 1").select("table_name", "record_id", F.explode("langs").alias("lang"))


def p2_segments(spark, sf_dir: str) -> DataFrame:
    """Every text's segments with language and confidence."""
    return languages(_texts(spark, sf_dir), fit(table(spark, sf_dir, "variety_samples"))).drop("label").distinct()


QUERIES = {"p2_found": p2_found, "p2_segments": p2_segments}
SQL: dict[str, str] = {}
