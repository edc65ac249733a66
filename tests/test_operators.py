import hashlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from varnika.functions import text as X
from varnika.operators import align, evaluation, ingest, markers, metrics, routing, similarity, splits, turns
from varnika.sources import audio, readers, sinks


def h(key, seed=42):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def test_ordered_split_is_the_literal_fill(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(f"id{i}", rng.choice([f"g{rng.randrange(9)}", None, ""])) for i in range(rng.randrange(1, 60))]
        groups = {}
        for i, g in rows:
            groups.setdefault(g or i, []).append(i)
        want, done = {}, {"train": 0, "validation": 0, "test": 0}
        for g in sorted(groups, key=h):
            name = "train" if done["train"] < round(len(rows) * 0.8) else "validation" if done["validation"] < round(len(rows) * 0.1) else "test"
            done[name] += len(groups[g])
            want |= dict.fromkeys(groups[g], name)
        got = splits.ordered_split(spark.createDataFrame(rows, "id string, g string"), "g", "id")
        assert {r.id: r.split for r in got.collect()} == want


def test_split_of_singletons(spark):
    got = splits.split_counts(splits.ordered_split(spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("g")), "g", "id"))
    assert {r.split: r.n for r in got.collect()} == {"train": 16, "validation": 2, "test": 2}
    empty = spark.createDataFrame([], "id string, g string")
    assert {r.split: r.n for r in splits.split_counts(splits.ordered_split(empty, "g", "id")).collect()} == {"train": 0, "validation": 0, "test": 0}


def test_partition_groups_is_the_literal_fill(spark):
    names = [(f"g{i}", i % 7 == 0) for i in range(23)]
    want, placed = {}, {"development": 0, "validation": 0, "test": 0}
    for g, forced in sorted(names, key=lambda x: h(x[0])):
        part = "development" if forced or placed["development"] < round(23 * 0.5) else "validation" if placed["validation"] < round(23 * 0.25) else "test"
        placed[part] += 1
        want[g] = part
    got = splits.partition_groups(spark.createDataFrame(names, "g string, forced boolean"), "g", "forced")
    assert {r.g: r.part for r in got.collect()} == want


def test_nested_samples_and_leakage(spark):
    df = spark.createDataFrame([(f"i{k}", "a", "b") for k in range(30)], "id string, anchor_text string, target_text string")
    got = splits.nested_samples(df, "id", (2, 5)).collect()
    assert {r.id for r in got if r["size"] == 2} < {r.id for r in got if r["size"] == 5}
    leak = {r.field: (r.shared, r.example) for r in splits.leakage(df.where("id < 'i2'"), df.where("id >= 'i2'")).collect()}
    assert leak == {"id": (0, None), "anchor_text": (1, "a"), "target_text": (1, "b")}


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = splits.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.component for r in got} == {f"n{i:03d}": "n000" for i in range(41)} | {"x": "x", "y": "x"}


def test_ingest(spark):
    rows = [("a", "x", "y", "p"), (None, "x", "z", " "), ("b", "x", "y", None), ("a", "x", "w", "q"), ("c", "x", "", "p")]
    df = spark.createDataFrame(rows, "key string, src string, dst string, audio string").withColumn("_n", F.monotonically_increasing_id())
    const = {"anchor_language": "hi", "target_language": "bho", "source": "s", "license": "l"}
    got = ingest.ingest_status(ingest.canonical(df, {"id": "key", "anchor_text": "src", "target_text": "dst", "audio_path": "audio"}, const), F.col("_n"))
    report = ingest.ingest_report(got, spark.createDataFrame([("p",)], "audio_path string")).first().asDict()
    assert report == {"read": 5, "written": 3, "invalid": 1, "duplicates": 1, "missing_audio": 0}
    assert got.where("target_text = 'z'").first().id == hashlib.sha256("x\x1fz".encode()).hexdigest()[:12]
    assert ingest.unknown_fields(df) == ["_n", "audio", "dst", "key", "src"]


def test_pairs_errors_and_sizes(spark):
    a = spark.createDataFrame([("hi", "bho")] * 3, "anchor_language string, target_language string")
    assert ingest.one_language_pair(a, a) == ("hi", "bho")
    for other in (a.limit(0), a.union(spark.createDataFrame([("hi", "mai")], a.schema))):
        with pytest.raises(ValueError):
            ingest.one_language_pair(other)
    status = spark.createDataFrame([(str(i), "invalid" if i % 2 else "written", f"e{i}", i) for i in range(20)], "id string, status string, error string, n int")
    assert [r.error for r in ingest.first_errors(status, F.col("n")).orderBy("error").collect()] == ["e1", "e3", "e5", "e7", "e9"]
    assert splits.skipped_sizes(a, (1, 3, 5)) == ([1, 3], [5])


def test_table_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, ingest.insert_new(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, ingest.update_by_key(old, new.where("k = 2"), "k").collect())) == [(1, "a"), (2, "x")]
    assert sorted(map(tuple, ingest.delete_by_key(old, new, "k").collect())) == [(1, "a")]


def chrf(*pairs):
    return [round(float(x), 6) for x in metrics.batch_chrf(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))]


def test_chrf():
    assert chrf(("abc", "abc"), ("abc", "xyz"), ("abc def", "abcdef"), ("e\u0301", "\u00e9"), ("", ""), (" ", ""), ("", "a")) == [100, 0, 100, 100, 100, 100, 0]
    assert math.isnan(chrf((None, "a"))[0]) and math.isnan(chrf(("a", None))[0]) and chrf() == []
    # orders 1 to 3 of "abcd" in "abce": 3 of 4, 2 of 3, 1 of 2, none of 1
    assert chrf(("abcd", "abce"), ("abcd", "abce"))[0] == pytest.approx(100 * (3 / 4 + 2 / 3 + 1 / 2 + 0) / 4)
    assert chrf(("ab", "abc"))[0] == pytest.approx(100 * 5 * 1 * ((2 / 3 + 1 / 2) / 2) / (4 * 1 + (2 / 3 + 1 / 2) / 2))


def test_chrf_does_not_mix_pairs():
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab \u0915") for _ in range(rng.randrange(12))), "".join(rng.choice("ab\u0915") for _ in range(rng.randrange(12)))) for _ in range(60)]
    assert chrf(*pairs) == [chrf(p)[0] for p in pairs]


def test_word_distance():
    def plain(a, b):
        table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = min(table[i, j + 1] + 1, table[i + 1, j] + 1, table[i, j] + (a[i] != b[j]))
        return table[len(a), len(b)]

    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(9)) for _ in "ab")
        assert metrics.py_word_distance(a, b) == plain(a, b)


def test_run_metrics(spark):
    refs = spark.createDataFrame([("1", "अ", "ब"), ("2", "क", "क")], "id string, anchor_text string, target_text string")
    pred = spark.createDataFrame([("0", "1", "अ"), ("0", "2", "क"), ("9", "1", "ब")], "condition string, id string, prediction string")
    got = {r.condition: r for r in metrics.run_metrics(pred, refs).collect()}
    assert got["0"].copy_rate == 1 and got["0"].exact_match == 0.5 and got["0"].complete
    assert got["9"].n == 1 and got["9"].exact_match == 1 and got["9"].chrf == 100 and not got["9"].complete
    assert got["identity"].copy_rate == 1 and got["identity"].chrf == got["0"].chrf
    lost = spark.createDataFrame([("9", "7", "x")], pred.schema)
    with pytest.raises(Exception, match="no reference for 7"):
        metrics.run_metrics(pred.union(lost), refs).collect()


def test_ratings_and_wer(spark):
    r = spark.createDataFrame([("i", "x", "1"), ("i", "y", "tie"), ("i", "z", " ")], "item_id string, rater_id string, choice string")
    key = spark.createDataFrame([("i", "0", "10")], "item_id string, system_1 string, system_2 string")
    got = {x.system: x for x in metrics.win_shares(metrics.rating_outcomes(r, key)).collect()}
    assert (got["0"].wins, got["0"].ties, got["0"].win_share, got["10"].win_share) == (1, 1, 1.0, 0.0)
    with pytest.raises(Exception, match="no choice: 3"):
        metrics.rating_outcomes(r.union(spark.createDataFrame([("i", "q", "3")], r.schema)), key).collect()
    assert {(x.column, x.value): x.n for x in metrics.value_counts(key, "system_1", "system_2").collect()} == {("system_1", "0"): 1, ("system_2", "10"): 1}
    df = spark.createDataFrame([("a b c", "a x c d"), ("a", "")], "r string, h string")
    w = metrics.word_error_rate(df, "r", "h").first()
    assert (w["rows"], w.edits, w.words) == (1, 2, 3)


def test_alignment(spark):
    df = spark.createDataFrame([(1, "मैं घर जाता हूँ", "हम घर जाता"), (2, "", "x")], "id int, h string, p string")
    al = align.aligned(df, ["id"], X.tokens("h"), X.tokens("p")).cache()
    assert [(r.op, r.hn, r.pn) for r in align.steps(al, ["id"]).collect()] == [("replace", 1, 1), ("delete", 1, 0)]
    s = align.edit_summary(al, "id").first()
    assert (s.clips, s.words, s.edits) == (1, 4, 2)
    assert {(r.word, r.source) for r in align.coverage(al, ["id"]).collect()} == {("हम", "मैं"), ("घर", "EQUAL"), ("जाता", "EQUAL")}
    assert {r.word: r.fate for r in align.word_fates(al, ["id"]).collect()} == {"मैं": "हम", "घर": "UNCHANGED", "जाता": "UNCHANGED", "हूँ": "DELETED"}
    neg = spark.createDataFrame([(1, "नहीं जाता मत", "नाहीं जाता"), (2, "वह मत जा", "वह अब जा"), (3, "मत जा", "मत जा")], "id int, h string, p string")
    fates = {r.fate: r.n for r in align.negation_fates(align.aligned(neg, ["id"], X.tokens("h"), X.tokens("p")), []).collect()}
    assert fates == {"kept": 1, "deleted": 1, "lost": 1, "unchanged": 1}
    train = spark.createDataFrame([("a", "x", "y")] * 3 + [("a", "z", "y"), ("b", "q", "r")], "variety string, source string, target string")
    test = spark.createDataFrame([("a", "z", "y"), ("b", "x", "y"), ("b", "q", "r"), ("a", "n", "n2")], train.schema)
    pooled, own = align.candidate_recall(train, test).first(), align.candidate_recall(train, test, by=("variety",)).first()
    assert (pooled.n, pooled.unseen, pooled.top1, pooled.top3) == (4, 0.25, 0.5, 0.75) and (own.n, own.unseen, own.top1, own.top3) == (4, 0.5, 0.25, 0.5)
    clips = spark.createDataFrame([("1", "y", "x"), ("1", "w", "EQUAL"), ("2", "y", "EQUAL"), ("3", "w", "EQUAL")], "clip string, word string, source string")
    sweep = align.rule_sweep(spark.createDataFrame([("y", "x")] * 12, "word string, source string"), clips, (10,), (0.9,)).first()
    assert (sweep.rules, sweep.changed, sweep.fixed, sweep.damaged, sweep.net) == (1, 2, 1, 1, 0) and sweep.improved == sweep.worsened == pytest.approx(1 / 3)
    fuzzy = {r.word: r.fate for r in align.fuzzy_fates(df.where("id = 1"), ["id"], X.tokens("h"), X.tokens("p")).collect()}
    assert fuzzy["घर"] == "UNCHANGED" and fuzzy["हूँ"] == "DELETED"


def test_markers_and_similarity(spark):
    texts = spark.createDataFrame([("a", "कखग कखग कखग सब")] + [("b", "सब सब सब गघ")], "v string, t string")
    counts = markers.word_counts(texts, "v", "t")
    got = markers.marker_ratios(counts, "b").collect()
    assert [(r.word, r.n, r.ref_n) for r in got] == [("कखग", 3, 0)]
    w = markers.marker_weights(counts, "b")
    label = markers.marker_scores(spark.createDataFrame([(1, "कखग है"), (2, "और")], "id int, t string"), "id", "t", w, 1.0, 0.5)
    assert {r.id: r.label for r in label.collect()} == {1: "a", 2: "hindi_unknown"}
    t = spark.createDataFrame([(g, i, float(k)) for g, row in {"x": "abcd", "y": "abcd", "z": "q"}.items() for k, i in enumerate(row, 1)], "grp string, item string, value double")
    s = {(r.a, r.b): r for r in similarity.group_similarity(t).collect()}
    assert s["x", "y"].shared == 4 and s["x", "y"].spearman == pytest.approx(1) and s["x", "y"].verdict == "STRONG"
    assert s["x", "z"].shared == 0 and s["x", "z"].verdict == "UNSUPPORTED"


def test_consequences_families_and_names(spark):
    df = spark.createDataFrame([("है", "बा"), ("ओ", "वह"), ("घर", "खेत"), ("घर", "घर"), ("गाँव", "गांव")], "x string, y string")
    assert [r.k for r in df.select(X.consequence("x", "y").alias("k")).collect()] == ["can_live", "ambiguous_source", "needs_fixing", None, None]
    p = spark.createDataFrame([("a", "b", "a", 0.9), ("a", "c", "c", 0.5), (None, "a", "b", 0.1)], "true string, pred string, second string, p double")
    got = evaluation.accuracy(p, {"a": "f", "b": "f"}).first()
    assert (got.n, got.accuracy, got.top2, got.family) == (3, 0, pytest.approx(1 / 3), pytest.approx(1 / 3))
    n = spark.createDataFrame([("Awadhi", "It is Awadhi."), ("Awadhi", "Hindi"), ("Hindi", "urdu"), ("Awadhi", None)], "truth string, detected string")
    assert {r.truth: (r.n, r.exact, r.fallback, r.wrong) for r in evaluation.named_language(n).collect()} == {"Awadhi": (3, 1, 1, 1), "Hindi": (1, 0, 0, 1)}


def test_wilson(spark):
    fates = spark.createDataFrame([("w", "UNCHANGED")] * 110 + [("w", "x")] * 2 + [("d", "DELETED")] * 60 + [("s", "y")], "word string, fate string")
    got = {r.word: r for r in evaluation.wilson_gate(fates).collect()}
    assert got["w"]["class"] == "SAFE_AUTOCORRECT" and got["d"]["class"] == "AMBIGUOUS" and got["s"]["class"] == "INSUFFICIENT"
    assert got["d"].entropy == 0


def test_routing(spark):
    def label(t):
        return routing.propose(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").first()

    assert label("रउआ कहाँ जात बानी आज").labels == ["bhojpuri_candidate"]
    assert label("हम भोजपुरी में एगो बात कहब").rule == "one_marker_and_speaker_names_bhojpuri"
    assert label("हम एगो बात कहब आज").labels == ["related_variety_uncertain"]
    assert label("हम एगो बात कहब आज").rule == routing.RULES["one"] and label("हम भोजपुरी में बात कहब").rule == routing.RULES["name"]
    df = spark.createDataFrame([(1, "हम भोजपुरी में एगो बात कहब"), (2, "यह एक बात है आज"), (3, "मैं कभी कभी रउआ हमनी")], "id int, t string")
    given = spark.createDataFrame([(2, "bundeli"), (2, "hindi"), (1, None)], "id int, supports string")
    hedged = {r.id: r.parts for r in routing.propose(df, "id", "t", F.lit(True), supplied=given).collect()}
    assert [tuple(p) for p in hedged[1]] == [("related_variety_uncertain", routing.RULES["hedged"])]
    assert [tuple(p) for p in hedged[2]] == [("bundeli_candidate", "externally_supplied_evidence")]
    got = {r.id: r for r in routing.labelled(df, "id", "t", F.lit("hi-IN")).collect()}
    assert got[3].mixed and got[3].summary == "Mixed: Hindi | Likely Bhojpuri; recognized using Hindi mode." and got[3].matches_route
    assert got[2].parts[0].rule == routing.RULES["none"] and not got[2].mixed
    assert label("मैं कभी कभी घर जाता").labels == ["hindi"]
    assert label("रउआ हमनी मैं कभी").labels == ["hindi", "bhojpuri_candidate"]
    assert label("hello my friend there").labels == label(None).labels == ["other_or_insufficient"]
    e = routing.evidence(spark.createDataFrame([(1, "वह जा रहा है, हमनी")], "id int, t string"), "id", "t").collect()
    assert {(r.kind, r.form, r.start) for r in e} == {("standard_hindi_marker", "रहा है", 6), ("eastern_marker", "हमनी", 14)}


def test_context(spark):
    rows = [("c", n, f"q{n}", f"a{n}", n != 5) for n in range(1, 11)]
    got = turns.with_context(spark.createDataFrame(rows, "conv string, turn int, text string, reply string, understood boolean"))
    last = got.where("turn = 10").first().context
    assert [m.text for m in last][:2] == ["q4", "a4"] and len(last) == 10


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("c", n, f"w{rng.randrange(9)} w{rng.randrange(9)}", f"a{n}", rng.random() < 0.8) for n in rng.sample(range(1, 200), 60)] + [("d", 1, "w1", "a", None)]
    df = spark.createDataFrame(rows, "conv string, turn int, text string, reply string, understood boolean")
    forms = spark.createDataFrame([("w1", False), ("w2", False), ("w3", True)], "word string, shared boolean")
    words = F.split("text", " ")

    def got():
        c = {(r.conv, r.turn): [m.text for m in r.context] for r in turns.with_context(df).collect()}
        p = {(r.conv, r.turn): (r.forms, r.evidence) for r in turns.pooled_evidence(df, forms, words).collect()}
        return c, p

    plain = got()
    monkeypatch.setattr(turns, "BLOCK", 4)
    assert got() == plain
    order = sorted(r for r in rows if r[0] == "c")
    want = {("c", r[1]): [x for q in order[max(0, i - 6) : i] if q[4] for x in (q[2], q[3])] for i, r in enumerate(order)} | {("d", 1): []}
    assert plain[0] == want
    numbered = {r.turn: r.position for r in turns.positions(df.where("conv = 'c'"), "conv", ["turn"], F.floor(F.col("turn") / 4)).collect()}
    assert numbered == {r[1]: i for i, r in enumerate(order, 1)}


def test_event_stream_is_the_batch_sum(spark, tmp_path):
    from varnika.streaming import events as E

    src = tmp_path / "in"
    rng = random.Random(9)
    rows = [(f"2025-03-{rng.randrange(1, 20):02d} {rng.randrange(24):02d}:00:00", rng.choice("ab"), float(rng.randrange(5))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    df.repartition(5).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(src))
    out = E.run_once(E.outcome_summary(stream), str(tmp_path / "o"), str(tmp_path / "k"), "update", ["window", "event_type"])
    want = {(r.day, r.event_type): (r.n, r.value) for r in df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).collect()}
    assert {(str(r.window.start)[:10], r.event_type): (r.n, r.value) for r in out.collect()} == want
    gone = {r.conv for r in E.evicted(spark.createDataFrame([(f"c{i}", i % 3 == 0, i) for i in range(9)], "conv string, ended boolean, last int"), 4).collect()}
    assert gone == {"c0", "c3", "c6", "c1", "c2"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"x\ny"\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.read_rows(spark, str(tmp_path / "a.csv")).first().t == "x\ny"
    assert readers.read_rows(spark, str(tmp_path / "b.jsonl")).count() == 2
    with pytest.raises(ValueError):
        readers.read_rows(spark, str(tmp_path / "c.txt"))
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string")
    m = sinks.write_splits(df, str(tmp_path / "s"), 42, "id")
    assert {r.split: r.n for r in m.collect()} == {"train": 1, "test": 1}
    assert spark.read.json(str(tmp_path / "s/rows")).count() == 2
    sinks.export_files(spark.createDataFrame([("f", b"x")], "n string, b binary"), str(tmp_path / "out"), "n", "b", ".wav")
    assert (tmp_path / "out/f.wav").read_bytes() == b"x"


def test_audio(spark):
    import io
    import wave

    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes((16384).to_bytes(2, "little") * 8000)
    df = spark.createDataFrame([(b.getvalue(),), (b"",), (None,), (b"abcdefgh",)], "c binary").select(audio.inspect("c").alias("x")).select("x.*")
    got = df.collect()
    assert (got[0].format, got[0].seconds, got[0].peak, got[0].fault) == ("wav", 1.0, 0.5, None)
    assert [r.fault for r in got[1:]] == ["empty", "empty", "unknown_format"]


def test_stream(spark, tmp_path):
    from varnika.streaming import events as E

    src = tmp_path / "in"
    rows = [("c", n, True, n == 3) for n in (4, 1, 3, 2, 2, 41)]
    spark.createDataFrame(rows, "conv string, turn int, understood boolean, end boolean").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("conv string, turn int, understood boolean, end boolean").parquet(str(src))
    E.run_once(E.follow_conversations(stream, idle=False), str(tmp_path / "o"), str(tmp_path / "k"))
    got = {r.turn: (r.turns, r.context, r.dropped) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {1: (1, 0, False), 2: (2, 1, False), 3: (3, 2, False), 4: (3, 0, True), 41: (40, 0, True)}


def test_similarity_of_sources_has_words_of_any_length(spark, tmp_path):
    from varnika.plans import analysis

    docs = [("the of distinctive", "a"), ("the", "a"), ("the of distinctive ordinary", "b"), ("the", "b"), ("the of\nordinary elsewhere", "c"), ("the elsewhere elsewhere", "c"), (None, "c")]
    spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(docs)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    idf = {r.item: (r.groups, r.idf) for r in analysis.Q["a37_idf"](spark, str(tmp_path)).collect()}
    assert idf == {"the": (3, 0.0), "of": (3, 0.0), "distinctive": (2, 0.405465), "ordinary": (2, 0.405465), "elsewhere": (1, 1.098612)}
    got = {(r.a, r.b): (r.shared, r.cosine, r.jaccard) for r in analysis.Q["a41_group_similarity"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (3, pytest.approx(0.707107), 0.75), ("b", "c"): (3, pytest.approx(0.128319, abs=2e-6), 0.6), ("a", "c"): (2, 0.0, 0.4)}
    assert {r.grp: r.partner for r in analysis.Q["w10_partners"](spark, str(tmp_path)).where("position = 1").collect()} == {"a": "b", "b": "a", "c": "b"}


def test_every_fold_and_every_seed(spark, tmp_path):
    from varnika.operators import detector
    from varnika.plans import learning

    words = {"hi": ["मैं", "है", "नहीं", "घर"], "awa": ["हम", "अहै", "नाहीं", "घर"]}
    rng = random.Random(8)
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(8))) for i, lang in enumerate(["hi", "awa"] * 12)]
    df = spark.createDataFrame(rows, "sample_id int, lang string, text string")
    df.write.parquet(str(tmp_path / "variety_samples.parquet"))
    got = {r.true: (r.n, r.groups) for r in learning.Q["m8_leave_one_group_out"](spark, str(tmp_path)).collect()}
    assert got == {"hi": (12, 3), "awa": (12, 3)}
    prepared = detector.prepared(df.withColumn("grp", F.col("sample_id") % 3).withColumn("sample_id", F.col("sample_id").cast("string")), "text", "lang").cache()
    p = detector.repeated_seeds(prepared, "label", "grp", "sample_id", (1, 2), "word", 5).select("seed", "sample_id").collect()
    tests = [{r.sample_id for r in p if r.seed == s} for s in (1, 2)]
    assert all(tests) and tests[0] != tests[1] and len(p) == len(set(p)) < 48
