"""The training-data operators: defined results for dirty input, brute force, held-out accuracy."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varnika.functions.text import py_words
from varnika.llm import broken_pairs, byte_language, consensus, conversations, cut_texts, grouped_splits, leaked_passages, mixture, spam_pages, split_overlap

WORDS = [a + b + c for a in ("ka", "mo", "ri", "tu", "se", "ba") for b in ("la", "ne", "po", "di") for c in ("n", "r", "", "sh")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- 1

TURN = "id string, created timestamp, conversation_id string, turn_id string, recognized_text string, error_code string, reply_text string, extra int"


def judged(spark, rows):
    df = spark.createDataFrame([(str(i), None, c, t, x, e, y, 1) for i, (c, t, x, e, y) in enumerate(rows)], TURN)
    return {r.conversation_id: (r.messages, r.broken) for r in conversations.judge(df).collect()}, df


def test_conversations(spark):
    rows = [
        ("good", "t1", "a", None, "b"), ("good", "T002", "c", None, "d"), ("good", "turn-2", "c", None, "d"), ("good", "3", "​", "no_speech", None),
        ("gap", "t1", "a", None, "b"), ("gap", "t3", "a", None, "b"), ("late", "t2", "a", None, "b"),
        ("conflict", "t1", "a", None, "b"), ("conflict", "t1", "a", None, "x"),
        ("noreply", "t1", "a", None, "null"), ("notext", "t1", " ", None, "b"), ("nothing", "t1", None, None, None),
        ("silent", "t1", None, "no_speech", "-"), ("unnumbered", None, "a", None, "b"), (None, "t1", "a", None, "b"),
    ]
    got, df = judged(spark, rows)
    want = {"good": None, "gap": "gap", "late": "gap", "conflict": "conflict", "noreply": "no_reply", "notext": "no_text", "nothing": "no_text", "silent": "empty", "unnumbered": "gap"}
    assert {k: v[1] for k, v in got.items()} == want
    told = [(r.position, r.role, r.text) for r in conversations.conversations(df).orderBy("position").collect()]
    assert told == [(1, "caller", "a"), (2, "assistant", "b"), (3, "caller", "c"), (4, "assistant", "d")]
    assert judged(spark, [])[0] == {}


def test_conversations_are_assembled_from_overlapping_fragments(spark):
    hour = lambda k: f"2025-03-01 {k:02d}:10:00"
    rows = []

    def put(conv, k, numbers, word="w"):
        rows.extend((f"{conv}{k}{n}{word}", hour(k), conv, f"t{n}", f"{word}{n}", None, f"r{n}", 1) for n in numbers)

    for c in ("overlap", "contained", "abut", "late", "branch", "dissent", "hole", "hidden"):
        put(c, 1, (1, 2, 3, 4))
    put("overlap", 2, (3, 4, 5, 6)), put("overlap", 3, (5, 6, 7))
    put("contained", 2, (2, 3)), put("contained", 3, (1, 2, 3, 4)), put("contained", 4, (1,))
    put("abut", 2, (5, 6))
    put("late", 2, (6, 7)), put("late", 3, (5,))
    put("branch", 2, (4, 5)), put("branch", 3, (5,), "other")
    put("dissent", 2, (3, 4, 5), "other")
    put("hole", 2, (6, 7))
    put("hidden", 2, (2,), "other")
    df = spark.createDataFrame(rows, TURN.replace("created timestamp", "created string")).withColumn("created", F.col("created").cast("timestamp"))
    got = {r.conversation_id: (r.reads, r.shared, r.paths, r.broken) for r in conversations.judge(df).collect()}
    assert got == {
        "overlap": (3, 4, 1, None), "contained": (1, 0, 1, None), "abut": (2, 0, 1, None), "late": (3, 0, 1, None),
        "branch": (3, 1, 2, "conflict"), "dissent": (2, 0, 2, "conflict"), "hole": (2, 0, 2, "gap"), "hidden": (2, 0, 2, "conflict"),
    }
    # without their fragments the rows are no reads any more
    assert {r.reads for r in conversations.judge(df.withColumn("created", F.lit(None).cast("timestamp"))).where("broken is null").collect()} == {1}


def test_assembly_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rng = random.Random(21)
    rows, want = [], {}
    for c in range(300):
        n, own = rng.randrange(1, 12), []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(1, n + 1)
            own += [(k, rng.randrange(5), "x" if rng.random() < 0.03 else "") for k in range(a, min(n, a + rng.randrange(1, 8)) + 1)]
        if rng.random() < 0.7:
            own += [(k, 9, "") for k in range(1, n + 1)]
        rows += [(f"{c}-{i}", f"2025-03-01 {h:02d}:10:00", f"c{c}", f"t{k}", f"a{k}{v}", None, "r", 1) for i, (k, h, v) in enumerate(own)]
        held = {k for k, _, _ in own}
        want[f"c{c}"] = held == set(range(1, max(held) + 1)) and len({(k, v) for k, _, v in own}) == len(held)
    df = spark.createDataFrame(rows, TURN.replace("created timestamp", "created string")).withColumn("created", F.col("created").cast("timestamp"))
    assert {r.conversation_id: r.broken is None for r in conversations.judge(df).collect()} == want and 50 < sum(want.values()) < 290


# ---- 2

@pytest.fixture(scope="module")
def net():
    rng = random.Random(5)
    own = {"hi": ["है", "में", "और", "था", "नहीं"], "bho": ["बा", "आउर", "रहल", "नइखे", "के"], "en": ["the", "and", "was", "not", "of"]}
    noun = ["घर", "बाजार", "खेत", "पानी"], ["house", "market", "field", "water"]
    say = lambda k: " ".join(rng.choice(own[k] if rng.random() < 0.7 else noun[k == "en"]) for _ in range(14))
    data = [(k, say(k)) for k in own for _ in range(80)]
    return byte_language.train(data[::2] + data[1::4], steps=300), data[3::4], say


def test_languages_held_out(net):
    model, held, say = net
    found = byte_language.segments(model, [t for _, t in held])
    assert np.mean([len(f) == 1 and f[0][2] == k for f, (k, _) in zip(found, held)]) > 0.95
    two = byte_language.segments(model, [say("hi") + "। " + say("en")])[0]
    assert {s[2] for s in two} == {"hi", "en"} and all(0 <= s[3] <= 1 for s in two)
    assert byte_language.segments(model, ["", "123", "…"]) == [[], [], []]


def test_languages_frame(spark, net):
    rows = [("t", "1", "hi-IN", net[2]("hi")), ("t", "2", None, net[2]("bho")), ("t", "3", "en", None), ("t", "4", "xx", "null"), ("t", None, "hi", "x"), ("t", "5", "BHO", net[2]("bho") * 300)]
    df = spark.createDataFrame(rows, "table_name string, record_id string, label string, text string")
    got = {r.record_id: (r.label, r.lang) for r in byte_language.languages(df, net[0]).collect()}
    assert got == {"1": ("hi", "hi"), "2": (None, "bho"), "5": ("bho", "bho")}
    assert byte_language.languages(df.limit(0), net[0]).count() == 0


def test_label_spellings(spark):
    given = ["hi", " HI ", "hin", "Hindi", "hi_Deva", "bho-IN", "Bhojpuri", "eng", "und", "", None, "hindustan"]
    got = [r.c for r in spark.createDataFrame([(x,) for x in given], "x string").select(byte_language.label_code(F.col("x")).alias("c")).collect()]
    assert got == ["hi", "hi", "hi", "hi", "hi", "bho", "bho", "en", None, None, None, None]


# ---- 3

def test_broken_pairs_features_and_order(spark, net):
    rng = random.Random(1)
    pairs = []
    for _ in range(160):
        k = rng.choice(["hi", "bho", "en"])
        stop = "." if k == "en" else "।"
        pairs.append((net[2](k), "Answer: x", f"{net[2](k)} finito{stop} {net[2](k)} finito{stop}"))
    x = pd.DataFrame([(f"k{i}", *p) for i, p in enumerate(pairs)], columns=["result_key", "transcript", "request_content", "raw_output"])
    pool = {k: [net[2](k) + "." for _ in range(20)] for k in ("hi", "bho", "en")}
    m = broken_pairs.learn(broken_pairs.examples(x, net[0], pool, {}), net[0])
    t, q, a = pairs[0]
    rows = [("ok", t, q, a), ("null", t, q, None), ("blank", t, q, "<think>x</think> …"), ("copy", t, q, t), ("cut", t, q, a[: len(a) // 2]), ("ok", t, q, a), (None, t, q, a), ("bare", None, None, a)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "result_key string, transcript string, request_content string, raw_output string, defect int").drop("defect")
    got = {r.result_key: r.defect for r in broken_pairs.broken_pairs(df, m).collect()}
    assert got["null"] == got["blank"] == "empty" and got["copy"] == "copy" and got["cut"] == "truncated" and got["ok"] is None
    assert set(got) == {"ok", "null", "blank", "copy", "cut", "bare"}


def test_refusal_clauses(spark):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        rows.append((f"g{i}", f"caller {i}", "Answer the caller. Be short", f"Well noted it is. {sentence(rng, 6)} {i}, thank you."))
        if i % 4 == 0:
            rows.append((f"r{i}", f"caller {i}", "Answer the caller. Be short", ["Sorry, no help from us.", "Well noted it is. No help from us", "<think>x</think>REPLY: no help from us, ask others"][i % 3]))
        if i % 5 == 0:
            rows.append((f"q{i}", f"caller {i}", "Answer the caller. Be short", "Answer the caller."))
    rows += [rows[0], ("n", None, None, None), (None, "x", "y", "no help from us"), ("e", "c", None, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "result_key string, transcript string, request_content string, raw_output string, h int")
    got = {r.clause: r.callers for r in broken_pairs.refusal_clauses(df).collect()}
    assert got == {"no help from us": 10, "ask others": 3}
    assert broken_pairs.refusal_clauses(df.limit(0)).count() == 0


# ---- 4

def test_cut_texts(spark):
    rng = random.Random(2)
    full = [f"{sentence(rng, 6)} is done now. {sentence(rng, 5)} is done now." for _ in range(300)]
    rows = [("t", f"f{i}", "m", s) for i, s in enumerate(full)]
    rows += [("t", "cut1", "m", full[0][:-14]), ("t", "cut2", "m", full[1][: full[1].rfind("done") + 2]), ("t", "cut3", "m", full[2][:-14] + "..."), ("t", "bare", "m", full[3][:-1])]
    rows += [("t", "null", "m", None), ("t", "empty", "m", ""), ("t", "blank", "m", " … "), ("t", "na", None, "N/A"), ("t", "f0", "m", full[0]), ("t", "long", "m", " ".join(full * 3))]
    df = spark.createDataFrame(rows, "table_name string, record_id string, model string, text string")
    got = {r.record_id: r.cut for r in cut_texts.cut_texts(df).collect()}
    assert {k for k, v in got.items() if v} == {"cut1", "cut2", "cut3"} and len(got) == 309
    assert cut_texts.cut_texts(df.limit(0)).count() == 0
    # a text of one word is judged like others
    short = spark.createDataFrame([("t", "one", "m", "is"), ("t", "two", "m", "now")], df.schema)
    assert {r.record_id: r.cut for r in cut_texts.cut_texts(df.union(short)).where("record_id in ('one', 'two')").collect()} == {"one": True, "two": False}


# ---- 5

def test_grouped_splits(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", f"spk-{min(int(rng.paretovariate(0.7)), 60):04d}" if i % 9 else rng.choice([None, " ", ""]), rng.choice(["s1", "S1 ", "s2"]), rng.choice(["bho", "mai", None]), rng.choice(["train", "test", "validation", None, "x"])) for i in range(900)]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "id string, speaker_id string, source string, target_language string, split string")
    got = grouped_splits.grouped_splits(df).collect()
    assert len(got) == 900 and len({(r.component, r.split) for r in got}) == len({r.component for r in got})
    n = {s: sum(r.split == s for r in got) for s in grouped_splits.SPLITS}
    sizes = sorted((sum(r.component == c for r in got) for c in {r.component for r in got}), reverse=True)
    assert abs(n["train"] - 720) <= max(5, sizes[0] - 720) and n["validation"] > 0
    assert {r.id: r.split for r in got} == {r.id: r.split for r in grouped_splits.grouped_splits(df.repartition(7)).collect()}
    assert grouped_splits.components(df.limit(0)).count() == 0
    assert grouped_splits.quotas(10, (0.8, 0.1, 0.1)) == [8, 1, 1]


def test_grouped_by_speaker_and_source(spark):
    rows = [("1", "spk1", "a"), ("2", "spk01", "B"), ("3", "x2", "b "), ("4", "3", "c"), ("5", None, "c"), ("6", "4", None), ("7", None, " "), ("8", "s-4", ""), ("9", None, "d"), (None, "1", "e")]
    df = spark.createDataFrame([(*r, "bho", "train") for r in rows], "id string, speaker_id string, source string, target_language string, split string")
    got = {r.id: r.component for r in grouped_splits.grouped_splits(df, "both").collect()}
    groups = {}
    for k, c in got.items():
        groups.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [["1", "2", "3"], ["4", "5"], ["6", "8"], ["7"], ["9"]]
    with pytest.raises(ValueError):
        grouped_splits.components(df, "nobody")


def test_quotas_of_one_large_group():
    def records(bundles):
        got = grouped_splits.allocate(bundles)
        return [sum(size * got[size, label, now][k] for size, label, now, _ in bundles) for k in range(3)]

    assert records([(850, "a", None, 1), (1, "a", None, 150)]) == records([(850, "a", None, 1), (1, "b", None, 150)]) == [850, 75, 75]


def test_leftover_components_keep_to_the_quotas():
    def records(bundles):
        got = grouped_splits.allocate(bundles)
        assert all(sum(got[size, label, now]) == n for size, label, now, n in bundles)
        return [sum(size * got[size, label, now][k] for size, label, now, _ in bundles) for k in range(3)]

    assert records([(5000, "a", None, 1), (1, "b", None, 10_000)]) == [12_000, 1500, 1500]
    assert records([(5000, "a", "test", 1), (1, "b", "test", 9990), (2, "b", None, 5)]) == [12_000, 1500, 1500]
    assert records([(5000, "a", None, 1), (1, "b", None, 100)]) == [5000, 50, 50]
    rng = random.Random(5)
    for _ in range(200):
        bundles = {(rng.randrange(1, 12), rng.choice("abc"), rng.choice([None, "train", "test"])): rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))}
        bundles = [(*k, n) for k, n in bundles.items()] + [(rng.choice([1, 200, 3000]), "d", None, 1), (1, "e", None, 20)]
        total, large = sum(b[0] * b[3] for b in bundles), max(b[0] for b in bundles)
        assert large > 100 or all(abs(x - q) <= 2 * large for x, q in zip(records(bundles), grouped_splits.quotas(total, grouped_splits.SHARES)))


# ---- 6

def test_consensus(spark):
    rng = random.Random(6)
    truth = {f"i{k}": rng.choice(consensus.CHOICES) for k in range(150)}
    skill = {"a": 0.95, "b": 0.9, "c": 0.85, "d": 0.3, "e": 0.3}
    rows = []
    for i, t in truth.items():
        for r, p in skill.items():
            rows.append((i, r, t if rng.random() < p else rng.choice(consensus.CHOICES), "2025-01-02 00:00:00"))
    rows += [("i0", "a", "skip", "2025-02-01 00:00:00"), ("i1", "a", None, None), ("none", "a", "?", "2025-01-01 00:00:00"), (None, "a", "1", None), rows[3]]
    df = spark.createDataFrame(rows, "item_id string, rater_id string, choice string, t string").select("item_id", "rater_id", "choice", F.col("t").cast("timestamp").alias("rated_at"))
    items, raters = consensus.consensus(df)
    got = {r.item_id: r for r in items.collect()}
    assert np.mean([got[i].choice == t for i, t in truth.items()]) > 0.93 and got["none"].ratings == 0 and got["none"].agreement is None
    rel = {r.rater_id: r.reliability for r in raters.collect()}
    assert rel["a"] > 0.85 > 0.6 > rel["d"]
    assert consensus.consensus(df.limit(0))[0].count() == consensus.consensus(df.limit(0))[1].count() == 0
    with pytest.MonkeyPatch.context() as m:  # raters that don't fit a broadcast: the same result
        m.setattr(consensus, "MAX_RATERS", 3)
        m.setattr(consensus, "ITERATIONS", 6)
        other = {r.item_id: r for r in consensus.consensus(df)[0].collect()}
    assert set(other) == set(got) and np.mean([other[i].choice == got[i].choice for i in got]) > 0.98
    assert all(other[i].ratings == got[i].ratings and other[i].agreement == got[i].agreement for i in got)


def test_consensus_features_decide_where_raters_do_not(spark):
    rng = random.Random(13)
    key, rows, truth = [], [], {}
    for i in range(400):
        anchor = sentence(rng, 6)
        broken = " ".join(f"{w}{w[-1]}{w[-1]}zz" for w in anchor.split())
        truth[f"i{i}"] = t = rng.choice("12")
        key.append((f"i{i}", "a", "b", anchor, anchor if t == "1" else broken, broken if t == "1" else anchor))
        if i < 300:
            rows += [(f"i{i}", r, t if rng.random() < 0.8 else rng.choice(consensus.CHOICES), "2025-01-02 00:00:00") for r in "abc"]
    df = spark.createDataFrame(rows, "item_id string, rater_id string, choice string, t string").select("item_id", "rater_id", "choice", F.col("t").cast("timestamp").alias("rated_at"))
    items = spark.createDataFrame(key, "item_id string, system_1 string, system_2 string, anchor_text string, option_1 string, option_2 string")
    got = {r.item_id: r.choice for r in consensus.consensus(df, items)[0].collect()}
    # items that nobody rated get their choice from the features alone
    assert np.mean([got[f"i{i}"] == truth[f"i{i}"] for i in range(300, 400)]) > 0.9


def test_clean_choice(spark):
    given = [" TIE", "Both-Bad", "both bad", "1 ", "3", "", None]
    assert [r.c for r in spark.createDataFrame([(x,) for x in given], "x string").select(consensus.clean_choice(F.col("x")).alias("c")).collect()] == ["tie", "both_bad", "both_bad", "1", None, None, None]


# ---- 7

def test_split_overlap_is_brute_force(spark):
    rng = random.Random(7)
    base = [sentence(rng, rng.randrange(3, 34)) for _ in range(60)]
    rows = []
    for i in range(260):
        s = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [s[k], s[k]]])
        t = " ".join(s)
        rows.append((f"r{i:03d}", t.upper() + "।" if rng.random() < 0.3 else t, rng.choice([None, " ", "null", sentence(rng, 5)]), rng.choice(["train", "train", "test", "validation", None, " "]), "s", "clash"))
    rows += [rows[0], (None, "x", "y", "train", "s", "q")]
    df = spark.createDataFrame(rows, "id string, anchor_text string, target_text string, split string, source string, text string")
    links, members = split_overlap.split_overlaps(df)
    got = {tuple(r) for r in split_overlap._pairs(links, members).select("id_train", "id_eval").distinct().collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("test", "validation") and a[0]:
                for f in (1, 2):
                    x, y = py_words(a[f]), py_words(b[f])
                    if x and y and "null" not in (a[f], b[f]) and split_overlap.lcs(x, y) * 8 >= 7 * max(len(x), len(y)):
                        want.add((a[0], b[0]))
    assert got == want and len(want) > 50
    groups = split_overlap._pairs(links, members).select("split", F.col("source_eval").alias("source"), "field", "id_eval", "id_train").distinct().groupBy("split", "source", "field")
    plain = groups.agg(F.countDistinct("id_eval").alias("records"), F.countDistinct("id_train").alias("train_records"), F.count("*").alias("pairs"))
    assert {tuple(r) for r in split_overlap.overlap_counts(links, members).collect()} == {tuple(r) for r in plain.collect()}
    links, _ = split_overlap.split_overlaps(df.limit(0))
    assert links.count() == 0


def test_split_overlap_of_long_texts_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "LONG", 24)
    rng = random.Random(27)
    rows = []
    for i in range(60):
        s = sentence(rng, rng.randrange(18, 70)).split()
        for j in range(3):
            t = list(s)
            for _ in range(rng.randrange(0, len(s) // 6 + 1)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [rng.choice(WORDS), t[k]]])
            rows.append((f"r{i:02d}{j}", " ".join(t), None, "train" if j % 2 else "test", "s" if i % 3 else None))
    df = spark.createDataFrame(rows, "id string, anchor_text string, target_text string, split string, source string")
    links, members = split_overlap.split_overlaps(df)
    got = {tuple(r) for r in split_overlap._pairs(links, members).select("id_train", "id_eval").distinct().collect()}
    words = {r[0]: py_words(r[1]) for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] == "train" and b[3] == "test" and split_overlap.lcs(words[a[0]], words[b[0]]) * 8 >= 7 * max(len(words[a[0]]), len(words[b[0]]))}
    assert got == want and 30 < len(want) and min(len(words[a]) for a, _ in want) < 24 < max(len(words[a]) for a, _ in want)
    assert sum(r.pairs for r in split_overlap.overlap_counts(links, members).collect()) == len(want)


def test_split_overlap_of_short_texts_is_brute_force(spark):
    rng = random.Random(17)
    rows = []
    for i in range(40):
        s = [rng.choice(WORDS) for _ in range(rng.choice([7, 8, 8, 9]))]
        k, other = rng.randrange(len(s)), rng.choice(WORDS)
        for j, t in enumerate([s, s[:k] + s[k + 1 :], s[:k] + [other] + s[k:], s[:k] + [other] + s[k + 1 :]]):
            rows.append((f"r{i:02d}{j}", " ".join(t), None, "train" if (i + j) % 2 else "test", "s"))
    rows += [("x1", "one two three four five six seven eight", None, "train", "s"), ("x2", "one two three five six seven eight", None, "test", "s")]
    df = spark.createDataFrame(rows, "id string, anchor_text string, target_text string, split string, source string")
    links, members = split_overlap.split_overlaps(df)
    got = {tuple(r) for r in split_overlap._pairs(links, members).select("id_train", "id_eval").distinct().collect()}
    words = {r[0]: py_words(r[1]) for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] == "train" and b[3] == "test" and split_overlap.lcs(words[a[0]], words[b[0]]) * 8 >= 7 * max(len(words[a[0]]), len(words[b[0]]))}
    assert got == want and ("x1", "x2") in want
    assert sum({len(words[a]), len(words[b])} == {7, 8} for a, b in want) > 10


# ---- 8

def test_leaked_passages_is_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randrange(9, 45))) for i in range(25)] + [(98, ""), (99, None), (97, None)]
    docs = []
    for d in range(160):
        w = sentence(rng, 40).split()
        p = rng.choice(items[:25])[1].split()
        kind = rng.randrange(5)
        part = p if kind == 0 else p[: rng.randrange(10, 30)] if kind == 1 else p[rng.randrange(5) :] if kind == 2 else p
        if kind == 3:
            part = [rng.choice(WORDS) if rng.random() < 0.1 else x for x in p]
        if kind < 4:
            w[20:20] = part
        docs.append((d, ", ".join(w) if d % 3 == 0 else " ".join(w).upper(), "x"))
    docs += [docs[0], (None, "x", "x"), (500, None, "x"), (501, "", "x"), (502, items[0][1] * 50, "x")]
    got = {tuple(r) for r in leaked_passages.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t, _ in docs:
        w = py_words(t)
        for i, p in items:
            p = py_words(p)
            for at in range(-len(p), len(w)) if p and d is not None else ():
                same = [0 <= at + k < len(w) and w[at + k] == p[k] for k in range(len(p))]
                run = max((len(r) for r in "".join("1" if s else "0" for s in same).split("0")), default=0)
                if run >= 16 or (at >= 0 and at + len(p) <= len(w) and len(p) - sum(same) <= len(p) // 9):
                    want.add((d, i))
    assert got == want and len(want) > 40


# ---- 9

def test_mixture(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, rng.choice(["big", "big", "mid", "other"]), rng.randrange(1, 30)) for i in range(2000)] + [(9000 + i, "small", 10) for i in range(5)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0.0) + t
    wanted, repeats = {"big": 0.5, "mid": 0.3, "small": 0.1, "absent": 0.1}, {"big": 2, "mid": 3, "small": 4, "absent": 2}
    shares, exponent = mixture.weights(sizes, 20000, wanted, repeats)
    assert exponent == 0 and shares["absent"] == 0 and shares["small"] == pytest.approx(200 / 20000) and sum(shares.values()) == pytest.approx(1) and shares["big"] / shares["mid"] == pytest.approx(5 / 3)
    monkeypatch.setattr(mixture, "RANGE", 50)
    got = mixture.mixture(counted, shares, 20000).collect()
    for s in ("big", "mid", "small"):
        real = sum(r.tokens for r in got if r.source == s)
        assert shares[s] * 20000 - 31 <= real <= shares[s] * 20000 + 1e-6
        times = [sum(1 for r in got if r.doc_id == d) for d in {r.doc_id for r in got if r.source == s}]
        assert max(times) <= repeats[s] and max(times) - min(times) <= 1
    assert not [r for r in got if r.source == "other"]


def test_mixture_exponent():
    tokens = {"a": 900.0, "b": 90.0, "c": 10.0}
    free = dict.fromkeys(tokens, 1e9)
    p, a = mixture.weights(tokens, 1000, repeats=free, want_entropy=1.0)
    assert mixture.entropy(p) == pytest.approx(1.0, abs=1e-6) and 0 < a < 1
    assert p["b"] / p["c"] == pytest.approx(9**a)
    # b may stand three times: it gives 270, the exponent is found for the others
    p, a = mixture.weights(tokens, 1000, repeats={**free, "b": 3.0}, want_entropy=1.05)
    assert p["b"] == pytest.approx(0.27) and p["a"] / p["c"] == pytest.approx(90**a) and sum(p.values()) == pytest.approx(1)
    # scaled up for the absent one, a would pass its limit: the exponent grows from 0 just as far as needed
    wanted = {"a": 0.6, "b": 0.2, "c": 0.05, "gone": 0.15}
    p, a = mixture.weights(tokens | {"gone": 0.0}, 1000, wanted, {"a": 0.68, "b": 3.0, "c": 90.0, "gone": 1.0})
    assert p["a"] <= 0.9 * 0.68 + 1e-9 and sum(p.values()) == pytest.approx(1) and p["gone"] == 0
    p, a = mixture.weights({"a": 500.0, "b": 500.0}, 1000, {"a": 0.8, "b": 0.2}, {"a": 1.7, "b": 3.0})
    assert (p["a"], a) == (pytest.approx(0.8), 0)
    p, a = mixture.weights({"a": 500.0, "b": 300.0, "c": 200.0, "d": 0.0}, 1000, {"a": 0.6, "b": 0.2, "c": 0.1, "d": 0.1}, {"a": 1.25, "b": 2.0, "c": 2.0, "d": 1.0})
    assert p["a"] == pytest.approx(0.625, abs=1e-6) and 0 < a < 1 and sum(p.values()) == pytest.approx(1)
    p, a = mixture.weights({"a": 100.0, "b": 10.0}, 1000, {"a": 0.5, "b": 0.5}, {"a": 2.0, "b": 3.0})
    assert p == {"a": pytest.approx(0.2), "b": pytest.approx(0.03)}
    assert mixture.weights({}, 1.0) == ({}, 0.0)


# ---- 10

def test_spam_pages(spark):
    rng = random.Random(10)
    glue = "the of and with was for from that they have".split()
    real = lambda n: " ".join(" ".join(rng.choice(glue) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(10)) + "." for _ in range(n))
    line = real(1)
    rows = [(i, real(8), "en", None) for i in range(120)]
    rows += [(200, " ".join(["kalan"] * 80), "en", 1), (201, "\n".join(f"http://a{i}.test/x" for i in range(40)), "EN", 1), (202, real(1) + "\n" + ", ".join(rng.choice(WORDS[:6]) for _ in range(120)), None, 1), (203, "#a #b " * 60, "en", 1)]
    rows += [(300, "\n".join([line, real(1)] * 9), "en", 0), (301, real(8) + "\nhttp://a.test #x #y", "en", 0), (302, None, "en", 0), (303, "", "en", 0), (304, "404", "en", 0), (305, real(400), "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, spam int")
    got = {r.doc_id for r in spam_pages.spam_pages(df).where("spam").collect()}
    assert got == {200, 201, 202, 203}
    short = [(400, "http://a.test/x http://b.test/y www.c.test", "en", 1), (401, "Short note.", "en", 0), (402, "…", "en", 0), (403, "kalan", None, 0)]
    assert {r.doc_id for r in spam_pages.spam_pages(df.union(spark.createDataFrame(short, df.schema))).where("spam").collect()} == {200, 201, 202, 203, 400}
    assert spam_pages.spam_pages(df.limit(0)).count() == 0


def test_spam_pages_script_is_that_of_the_whole_text(spark):
    rng = random.Random(11)
    deva, glue = "क ख ग घ च छ ज झ ट ठ".split(), "the of and with was for from that they have".split()
    page = lambda fill, other, n: " ".join(" ".join(rng.choice(fill) if rng.random() < 0.6 else rng.choice(other) for _ in range(10)) + "." for _ in range(n))
    header = lambda: " | ".join(rng.choice(WORDS) + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) + "\n"
    links = "\n".join(f"http://a{i}.test/page" for i in range(30)) + "\n"
    native = [f"{x}{y}" for x in "पफबभम" for y in "यरलवश"]
    rows = [(i, (header() if i % 2 else links if i % 4 else "") + page(deva, native, 90), "hi") for i in range(160)]
    rows += [(1000 + i, page(glue, WORDS, 8), "hi") for i in range(14)]
    df = spark.createDataFrame(rows + [(2000, " ".join(rng.choice(WORDS[:20]) + "x" for _ in range(80)), "hi")], "doc_id long, text string, lang string")
    common = spam_pages.function_words(spam_pages.read_pages(df))
    glue_ids, deva_ids = ({spam_pages.word_id(w) for w in ws} for ws in (glue, deva))
    assert glue_ids <= common["hi/latin"] and not deva_ids & common["hi/latin"] and deva_ids <= common["hi/other"]
    got = {r.doc_id: r for r in spam_pages.spam_pages(df).collect()}
    assert all(got[1000 + i].grp == "hi/latin" and got[1000 + i].sent > 0.5 and not got[1000 + i].spam for i in range(14))
    assert got[2000].spam and not any(got[i].spam for i in range(160))
    assert spam_pages._group("hi", ["नमस्ते"], links) == "hi/other" and spam_pages._group("hi", ["namaste"], "") == "hi/latin"


def test_mix_to_targets_dirty(spark):
    docs = [(1, "एक दो तीन", "a", 9), (1, "एक दो तीन", "a", 9), (2, None, "a", 9), (3, "", "a", 9), (4, "one two", None, 9), (5, "one two three four", "b", 9), (6, "x " * 4000, "c", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, None), ("gone", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(df, targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"a", "b", "gone"} and got["gone"].tokens == got["gone"].repeats == 0
    assert {r.doc_id for r in mixed.collect()} <= {1, 5} and got["a"].repeats <= 3 and got["b"].repeats <= 1
    _, even = mixture.mix(df, targets, by_share=False)
    assert {r.source for r in even.collect()} == set(got)
    mixed, report = mixture.mix(df.limit(0), targets)
    assert mixed.count() == 0 and all(r.tokens == 0 for r in report.collect())
