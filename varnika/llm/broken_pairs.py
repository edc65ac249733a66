"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and features of the pair.

Training pairs are made from a bounded sample of the data's own pairs, taken as mostly sound: each is cut at a random place, replaced
by the caller's words or the request (whole, slightly changed, introduced), swapped with an answer to a caller of another language,
replaced by a refusal or by nothing. Refusals are put together from clauses that the data itself shows to be refusals, and from a few
sentences in each language. A clause is one if it answers several unrelated callers but never stands beside a clause of its own to one
caller: greetings and thanks are repeated as often, but beside something that was meant for the caller. All pairs are counted for that.

One logistic model per defect is fitted to hashed features: words and word pairs of the answer, its last words, and features of the
pair (how much of the answer stands in the request, how many words do not, whether both are in the same language by the byte network).
After a first fit the sample's pairs that look defective are left out of the sound ones and the fit is repeated. Each defect's threshold
is calibrated on held-out pairs. All pairs are then classified in one pass. The sample stays on the executors: its pairs are chosen by a
threshold on the hash of their keys, and only hashed features of its altered pairs come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from varnika.functions.text import py_words, squeeze
from varnika.llm import byte_language as B
from varnika.session import table, written

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: Which of several defects is reported.
ORDER = ("empty", "copy", "refusal", "wrong_language", "truncated")
#: Pairs of the training sample, about; their answers and requests have so many characters at most.
MAX_PAIRS, MAX_CHARS = 4000, 20_000
#: Answers that others are swapped with, at most.
POOL = 600
#: Clauses that are taken as refusals, the most frequent ones; their longest.
MAX_CLAUSES, CLAUSE_CHARS = 2000, 300
#: Callers that a clause has answered, and the largest share of its answers with something meant for the caller only.
CALLERS, COMPANY = 3, 0.15
DIM = 1 << 17
EPOCHS = (3, 8)
#: Texts that pass the language network at a time.
CHUNK = 1000
#: Training pairs in which a feature must stand.
LEAST_SEEN = 4
#: Pairs of the sample with a score above this for any defect after the first fit are not taken as sound.
DOUBT = -1.0

# Sentences that decline, by language. They are worded freely, not taken from any table.
REFUSALS = {
    "hi": ["मैं इसमें आपकी सहायता नहीं कर पाऊँगा", "मुझे इसका उत्तर देने की अनुमति नहीं है", "ऐसी माँग मैं पूरी नहीं कर सकता", "इस प्रश्न पर मैं चुप रहूँगा"],
    "bho": ["हमरा से ई ना बतावल जाई", "हम राउर ई माँग पूरा ना कर पाइब", "हमरा एकर जवाब देवे के छूट नइखे", "एह पर हम चुप रहब"],
    "mai": ["हम अहाँक ई माँग पूरा नहि कऽ सकब", "हमरा एकर जवाब देबाक छूट नहि अछि", "एहि पर हम चुप रहब", "हमरासँ ई नहि कहल जायत"],
    "awa": ["हम तुम्हार ई माँग पूरी नाहीं कइ पइबै", "हमका यहिकै जवाब देय कै छूट नाहीं है", "यहि पर हम चुप रहबै", "हमसे ई न बतावा जाई"],
    "mwr": ["म्हैं थारी आ मांग पूरी कोनी कर सकूं", "म्हनै इण रो पडूत्तर देवण री छूट कोनी", "इण माथै म्हैं चुप रैवूंला", "म्हारै सूं ओ कोनी बताईजै"],
    "en": ["I won't be able to assist you here", "I am not permitted to answer that", "That is a request I must decline", "I would rather not comment on this"],
}
# How an answer may quote the caller.
QUOTES = {"hi": "आपने कहा", "bho": "रउआ कहनी", "mai": "अहाँ कहलहुँ", "awa": "तुम कहेउ", "mwr": "आप कयो", "en": "You said"}
# Answers that say nothing.
NOTHING = ["", " ", "\n", "null", "N/A", "[]", '""', "...", "…", "-", "।", "REPLY:", "none", "{}", "(empty)", "​", "n/a", "--", ".", "nil"]

_THINK = re.compile(r"(?is)^.*</think>|^\s*<think>.*$")
_LABEL = re.compile(r"(?i)^\s*reply\s*:\s*")
_MARKED_END = re.compile(r"[।॥?!.][\"»”')\]\s]*$")
_BROKEN_END = re.compile(r"(?:[.…]{2,}|…|�)[\"»”')\]\s]*$")
_CLAUSE = re.compile(r"[।॥.?!,;:\n]+")
_PLACEHOLDER = {"null", "na", "n a", "none", "nil", "reply", "empty", "undefined", "nan"}


def body(output: str | None) -> str:
    """The answer without its thinking block and label."""
    return _LABEL.sub("", _THINK.sub("", output or "")).strip()


#: The hashes of features of the pair, of the answer's words and of its end lie in separate ranges; a defect's model uses those named.
RANGES = {"pair": (0, 1 << 12), "words": (1 << 12, 1 << 16), "end": (1 << 16, DIM)}
USED = {"empty": ("pair",), "truncated": ("pair", "end"), "refusal": ("pair", "words"), "copy": ("pair",), "wrong_language": ("pair",)}


def _hashes(kind: str, names: set[str]) -> list[int]:
    a, b = RANGES[kind]
    return sorted({a + xxhash.xxh32_intdigest(s) % (b - a) for s in names})


def known_clauses(answer: str, clauses: frozenset[str]) -> int:
    """How many of the answer's clauses are among those found to be refusals."""
    return sum(" ".join(c.split()) in clauses for c in _CLAUSE.split(answer.lower())) if clauses else 0


def features(transcript: str | None, request: str | None, answer: str, lang_differs: float, known: int = 0) -> np.ndarray:
    """Hashes of the features of a pair; the answer is without thinking block. lang_differs: log-odds that both languages differ; known: known_clauses()."""
    words = py_words(answer)
    words = ["0" if w.isdigit() else w for w in words]
    n = len(words)
    out = ["bias", f"n{min(n, 12)}"]
    if " ".join(words) in _PLACEHOLDER or not any(c.isalpha() for c in answer):
        out.append("nothing")
    source = ["0" if w.isdigit() else w for w in py_words(transcript)] + ["\x00"] + ["0" if w.isdigit() else w for w in py_words(request)]
    pairs = set(zip(source, source[1:]))
    hit = [False] * n
    for i in range(n - 1):
        if (words[i], words[i + 1]) in pairs:
            hit[i] = hit[i + 1] = True
    if n == 1 and words[0] in source:
        hit[0] = True
    free, covered = n - sum(hit), sum(hit) / n if n else 0.0
    out += [f"known{min(known, 2)}", f"free{min(free, 10)}", f"cover{int(covered * 10)}", f"free{min(free, 10)}cover{int(covered * 5)}"]
    if lang_differs:
        level = int(np.clip(lang_differs / 3, -4, 4))
        out += [f"lang{level}", f"lang{level > 0}"]
    # what is not the caller's
    rest = [w for w, x in zip(words, hit) if not x]
    content = [f"w:{w}" for w in set(rest)] + [f"b:{a} {b}" for a, b in set(zip(rest, rest[1:]))]
    ends: list[str] = []
    if n:
        marked, broken = bool(_MARKED_END.search(answer)), bool(_BROKEN_END.search(answer))
        end = "m" if marked and not broken else "b" if broken else "o"
        ends = [f"end{end}", f"e1:{end}{words[-1]}", f"e2:{' '.join(words[-2:])}", f"e3:{' '.join(words[-3:])}", f"e1{words[-1]}", f"s:{end}{words[-1][-2:]}", f"s3:{words[-1][-3:]}", f"len{end}{min(4, len(words[-1]))}", f"p:{' '.join(words[-3:-1])}", f"comma{answer.rstrip().endswith(',')}"]
    return np.array(_hashes("pair", set(out)) + _hashes("words", set(content)) + _hashes("end", set(ends)), dtype=np.int32)


@dataclass
class Model:
    net: B.Network
    clauses: frozenset[str]  # found to be refusals
    weights: np.ndarray  # (DIM, defects)
    thresholds: np.ndarray


def _sum(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])[:-1]
    return np.add.reduceat(weights[np.concatenate(rows)], starts, axis=0)


def language_odds(net: B.Network, transcripts: list[str | None], answers: list[str]) -> np.ndarray:
    """Log-odds that the answer is in another language than the transcript; 0 where one of both has no letters.

    Words that both share tell nothing about a difference, so the answer's probabilities are held against the transcript's language.
    """
    if len(answers) > CHUNK:  # the network's responses take some 100 kB a text
        return np.concatenate([language_odds(net, transcripts[a : a + CHUNK], answers[a : a + CHUNK]) for a in range(0, len(answers), CHUNK)])

    def logs(texts: list[str]) -> np.ndarray:
        forms = [B.normal(t or "") for t in texts]
        own, starts = net.windows([B.encode(f) for f in forms])
        total = np.add.reduceat(own, starts[:-1], axis=0) / 2
        total -= np.logaddexp.reduce(total, axis=1, keepdims=True)
        total[[not any(c.isalpha() for c in f) for f in forms]] = np.nan
        return total

    a, b = logs(transcripts), logs(answers)
    lang = np.nan_to_num(a, nan=0).argmax(axis=1)
    own = b[np.arange(len(b)), lang]
    other = b.copy()
    other[np.arange(len(b)), lang] = -np.inf
    odds = np.nan_to_num(other.max(axis=1) - own, nan=0.0, posinf=50, neginf=-50)
    odds[np.isnan(a).any(axis=1)] = 0.0
    return odds


def _vary(words: list[str], rng: np.random.Generator) -> list[str]:
    """A slightly changed copy."""
    out = []
    for w in words:
        x = rng.random()
        if x < 0.03:
            continue
        out.append(w)
        if x > 0.97:
            out.append(w + ",")
    return out or words


def _refuse(lang: str, found: dict[str, list[str]], rng: np.random.Generator) -> str:
    """Some clauses of the language: mostly of those found in the data, if there are any."""
    own = found.get(lang) or []
    stop = "." if lang == "en" else "।"
    parts = [str(rng.choice(own if own and rng.random() < 0.75 else REFUSALS.get(lang, REFUSALS["hi"]))) for _ in range(int(rng.choice([1, 2, 3], p=[0.45, 0.4, 0.15])))]
    text = parts[0]
    for p in parts[1:]:
        text += (stop if rng.random() < 0.5 else ",") + " " + p
    text += stop if rng.random() < 0.8 else ""
    return B.romanise(text) if lang != "en" and rng.random() < 0.1 else text


def synthetic(t: str, q: str, a: str, lang: str, pool: dict[str, list[str]], found: dict[str, list[str]], rng: np.random.Generator) -> list[tuple[str, int]]:
    """(answer, number of the defect or -1) from a sound pair (transcript, request, answer) and its language; the pair itself first."""
    sentences = re.compile(r"[^।.?!]+[।.?!]?")
    out = [(a, -1)]
    bare = _MARKED_END.sub("", a)
    if rng.random() < 0.5:
        out.append((bare, -1))
    quote = f"{QUOTES.get(lang, QUOTES['hi'])}: "
    if rng.random() < 0.2:
        out.append(((B.romanise(quote) if t.isascii() and lang != "en" else quote) + t.rstrip("।. ") + "। " + a, -1))
    first = sentences.findall(a)
    if first and rng.random() < 0.3:
        out.append((first[-1 if len(first) > 1 else 0].strip(), -1))
    if first and rng.random() < 0.1:
        out.append((first[0].strip(), -1))
    for _ in range(3):
        if len(bare) > 30:
            at = int(rng.integers(len(bare) // 3, len(bare) - 2))
            if rng.random() < 0.35 and " " in bare[:at]:
                at = bare.rfind(" ", 0, at)
            if bare[at - 1] not in "।.?! ":
                out.append((bare[:at].rstrip() + str(rng.choice(["", "", "", "...", "…", ","], p=[0.35, 0.2, 0.2, 0.12, 0.08, 0.05])), 1))
    if rng.random() < 0.5:
        out.append((_refuse(lang, found, rng), 2))
    # a greeting or an excuse before it, as it stands before sound answers
    if len(first) > 1 and rng.random() < 0.25:
        out.append((first[0].strip() + " " + _refuse(lang, found, rng), 2))
    if "," in a and rng.random() < 0.2:
        out.append((a.split(",")[0].strip() + ", " + _refuse(lang, found, rng), 2))
    if t and rng.random() < 0.6:
        copied = " ".join(_vary(t.split(), rng)) if rng.random() < 0.6 else t
        x = rng.random()
        copied = copied if x < 0.5 else quote + copied if x < 0.7 else f'"{copied}"' if x < 0.8 else f"{copied} {copied}" if x < 0.87 else q
        if rng.random() < 0.1:
            copied = copied[: int(len(copied) * rng.uniform(0.6, 1))]
        out.append((copied, 3))
    others = [k for k in sorted(pool) if k != lang]
    if others and rng.random() < 0.5:
        swap = pool[others[int(rng.integers(len(others)))]]
        out.append((swap[int(rng.integers(len(swap)))], 4))
    if rng.random() < 0.15:
        out.append((str(rng.choice(NOTHING)).strip(), 0))
    return out


def _fit(rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, epochs: int) -> np.ndarray:
    """Logistic models for all defects at once, AdaGrad in small batches."""
    k = len(DEFECTS)
    weights, seen = np.zeros((DIM, k)), np.full((DIM, k), 0.1)
    size = np.array([len(r) for r in rows])
    flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum(size)[:-1]])
    used = np.zeros_like(weights)
    for d, name in enumerate(DEFECTS):
        for kind in USED[name]:
            used[slice(*RANGES[kind]), d] = 1
    used[np.bincount(flat, minlength=DIM) < LEAST_SEEN] = 0  # what stands in hardly any pair teaches nothing
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 128):
            part = order[a : a + 128]
            n = size[part]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = flat[np.repeat(starts[part] - begin, n) + np.arange(n.sum())]
            g = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[at], begin, axis=0), -30, 30))) - y[part]
            uniq, back = np.unique(at, return_inverse=True)
            each = np.repeat(g, n, axis=0)
            step = np.stack([np.bincount(back, weights=each[:, d], minlength=len(uniq)) for d in range(k)], axis=1)
            step = (step + 1e-5 * weights[uniq]) * used[uniq]
            seen[uniq] += step**2
            weights[uniq] -= 0.2 * step / np.sqrt(seen[uniq])
    return weights


def learn(made: pd.DataFrame, net: B.Network, clauses: frozenset[str] = frozenset(), seed: int = 11) -> Model:
    """made: pair (a number for each pair of the sample), first (the pair as it is), defect (number or -1), held (for the thresholds), x (hashed features)."""
    rng = np.random.default_rng(seed)
    made = made.sort_values(["pair", "place"], kind="stable").reset_index(drop=True)
    rows = [np.asarray(x) for x in made["x"]]
    y = (made["defect"].to_numpy()[:, None] == np.arange(len(DEFECTS))[None, :]).astype(float)
    held = made["held"].to_numpy()

    def fit_on(keep: np.ndarray, epochs: int) -> np.ndarray:
        return _fit([rows[i] for i in np.flatnonzero(keep)], y[keep], rng, epochs)

    # the sample's own defective pairs are no examples of sound ones
    first = _sum(fit_on(~held, EPOCHS[0]), rows)
    bad = set(made["pair"][(made["place"] == 0) & (first > DOUBT).any(axis=1)])
    sound = ~made["pair"].isin(bad).to_numpy()
    weights = fit_on(~held & sound, EPOCHS[1])
    score, truth = _sum(weights, rows)[held & sound], y[held & sound]
    thresholds = []
    for k in range(len(DEFECTS)):  # of the thresholds with the best F1 on held-out pairs, a low one
        grid = np.linspace(-4, 4, 81)
        f1 = [2 * ((p := score[:, k] > t) & (truth[:, k] > 0)).sum() / max(1, p.sum() + truth[:, k].sum()) for t in grid]
        best = grid[np.array(f1) >= max(f1) - 0.002]
        thresholds.append(float(np.quantile(best, 0.25)))
    return Model(net, clauses, weights.astype(np.float32), np.array(thresholds))


def examples(x: pd.DataFrame, net: B.Network, pool: dict[str, list[str]], found: dict[str, list[str]]) -> pd.DataFrame:
    """The sound pairs of x (columns result_key, transcript, request_content, raw_output) and what is made of them, as learn() takes them."""
    t, q, a = [v or "" for v in x["transcript"]], [v or "" for v in x["request_content"]], [body(v) for v in x["raw_output"]]
    odds = language_odds(net, t, a)
    langs = [f[0][2] if f else "" for f in B.segments(net, [u or v for u, v in zip(t, a)])]
    clauses = frozenset(c for own in found.values() for c in own)
    made = []
    for i, key in enumerate(x["result_key"]):
        if len(py_words(a[i])) >= 5 and odds[i] <= 0 and not known_clauses(a[i], clauses):
            h = xxhash.xxh64_intdigest(str(key))
            made += [(h >> 1, k, d, h % 5 == 0, t[i], q[i], s) for k, (s, d) in enumerate(synthetic(t[i], q[i], a[i], langs[i], pool, found, np.random.default_rng(h)))]
    out = pd.DataFrame(made, columns=["pair", "place", "defect", "held", "t", "q", "s"])
    odds = language_odds(net, list(out["t"]), list(out["s"])) if len(out) else []
    out["x"] = [features(*p, known_clauses(p[2], clauses)) for p in zip(out["t"], out["q"], out["s"], odds)]
    return out.drop(columns=["t", "q", "s"])


def _body(c: Column) -> Column:
    """body() as a column."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)^.*</think>|^\s*<think>.*$", ""), r"(?i)^\s*reply\s*:\s*", "")


def refusal_clauses(pairs: DataFrame) -> DataFrame:
    """clause, callers: the clauses of two words or more that answer at least CALLERS callers and of whose answers at most the share
    COMPANY holds a clause that answers no others; clauses that stand in the request are none. Nulls and empty texts have no clause."""
    clause = F.filter(F.transform(F.split(F.lower(_body(F.col("raw_output"))), r"[।॥.?!,;:\n]+"), squeeze), lambda c: F.size(F.split(c, " ")) > 1)
    rows = pairs.where("result_key is not null").select(F.xxhash64("result_key", "raw_output").alias("answer"), F.xxhash64("transcript").alias("caller"), F.lower(F.coalesce("request_content", F.lit(""))).alias("q"), F.explode(F.array_distinct(clause)).alias("c"))
    each = written(rows.select("answer", "caller", F.xxhash64("c").alias("h"), F.contains("q", F.col("c")).alias("asked"), F.when(F.length("c") <= CLAUSE_CHARS, F.col("c")).alias("c")).distinct())
    stock = each.groupBy("h", "caller").agg(F.max("asked").alias("asked"), F.max("c").alias("c")).groupBy("h").agg(F.count("*").alias("callers"), F.avg(F.col("asked").cast("double")).alias("asked"), F.max("c").alias("c")).where("callers > 1")
    stock = written(stock)
    told = each.select("answer", "h").join(stock.select("h", F.lit(True).alias("known")), "h", "left")
    fresh = told.groupBy("answer").agg(F.max(F.col("known").isNull()).alias("fresh"))
    company = told.where("known").join(fresh, "answer").groupBy("h").agg(F.avg(F.col("fresh").cast("double")).alias("company"))
    return stock.where(F.col("callers") >= CALLERS).join(company, "h").where((F.col("company") <= COMPANY) & (F.col("asked") <= COMPANY) & F.col("c").isNotNull()).select(F.col("c").alias("clause"), "callers")


def _sample(pairs: DataFrame, n: int) -> DataFrame:
    """About n of the pairs, by the hash of their keys, whatever their number; training reads none with longer texts than MAX_CHARS."""
    rows = pairs.select("result_key", "transcript", "request_content", "raw_output").where("result_key is not null and raw_output is not null and transcript is not null")
    rows = rows.where((F.length("raw_output") <= MAX_CHARS) & (F.length(F.coalesce("request_content", F.lit(""))) <= MAX_CHARS))
    total = rows.agg(F.approx_count_distinct("result_key")).first()[0]
    parts = 1 << 40
    return rows.where(F.pmod(F.xxhash64("result_key"), F.lit(parts)) <= int(parts * min(1.0, n / max(1, total))))


def fit(pairs: DataFrame, samples: DataFrame, clauses: list[str] | None = None) -> Model:
    """From about MAX_PAIRS of the pairs (columns result_key, transcript, request_content, raw_output) and labelled texts for the
    languages. clauses: those that are taken as refusals, by default refusal_clauses()."""
    net = B.fit(samples)
    if clauses is None:
        clauses = [r.clause for r in refusal_clauses(pairs).orderBy(F.desc("callers"), "clause").limit(MAX_CLAUSES).collect()]

    def by_language(texts: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s, f in zip(texts, B.segments(net, texts)):
            if f:
                out.setdefault(f[0][2], []).append(s)
        return out

    swaps = [body(r.raw_output) for r in _sample(pairs, POOL).where("length(raw_output) <= 2000").select("result_key", "raw_output").dropDuplicates(["result_key"]).orderBy(F.xxhash64("result_key"), "result_key").limit(POOL).collect()]
    shared = pairs.sparkSession.sparkContext.broadcast((net, by_language([s for s in swaps if len(py_words(s)) >= 5]), by_language(clauses)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a in range(0, len(x), CHUNK):
                yield examples(x.iloc[a : a + CHUNK], *shared.value)

    made = _sample(pairs, MAX_PAIRS).mapInPandas(run, "pair long, place int, defect int, held boolean, x array<int>").toPandas()
    return learn(made.drop_duplicates(["pair", "place"]), net, frozenset(clauses))


def broken_pairs(pairs: DataFrame, model: Model) -> DataFrame:
    """A row per pair: result_key, defect (null for a sound one) and a score per defect (above 0: it has it).

    A null output is empty; null transcripts and requests are empty texts; repeated rows count once; one defect is reported by ORDER.
    Rows without result_key are ignored; an empty table gives no rows.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    rows = pairs.select("result_key", "transcript", "request_content", "raw_output").where("result_key is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for x in batches:
            for a in range(0, len(x), 1000):
                part = x.iloc[a : a + 1000]
                answers = [body(o) for o in part["raw_output"]]
                odds = language_odds(m.net, list(part["transcript"]), answers)
                score = _sum(m.weights, [features(t, q, b, o, known_clauses(b, m.clauses)) for t, q, b, o in zip(part["transcript"], part["request_content"], answers, odds)]) - m.thresholds
                defect = np.full(len(part), None, dtype=object)
                for d in reversed(ORDER):
                    defect[score[:, DEFECTS.index(d)] > 0] = d
                yield pd.DataFrame({"result_key": part["result_key"].to_numpy(), "defect": defect, **{d: score[:, k].astype(float) for k, d in enumerate(DEFECTS)}})

    return rows.mapInPandas(run, "result_key string, defect string, " + ", ".join(f"{d} double" for d in DEFECTS)).dropDuplicates(["result_key"])


def p3_found(spark, sf_dir: str) -> DataFrame:
    """The defective answers and their kind of defect."""
    pairs = table(spark, sf_dir, "experiment_evon_results")
    return broken_pairs(pairs, fit(pairs, table(spark, sf_dir, "variety_samples"))).where("defect is not null").select("result_key", "defect")


def p3_defects_by_model(spark, sf_dir: str) -> DataFrame:
    """Answers and defects of each model."""
    pairs = table(spark, sf_dir, "experiment_evon_results")
    got = broken_pairs(pairs, fit(pairs, table(spark, sf_dir, "variety_samples")))
    return pairs.select("result_key", "model").distinct().join(got, "result_key").groupBy("model", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("answers"))


QUERIES = {"p3_found": p3_found, "p3_defects_by_model": p3_defects_by_model}
SQL: dict[str, str] = {}
