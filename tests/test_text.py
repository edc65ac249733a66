from pyspark.sql import functions as F

from varnika.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_words_ignore_form():
    assert X.py_words("Ça​  VA, ४५!") == ["ça", "va", "45"]
    assert X.py_words("ड़ा") == X.py_words("ड़ा")
    assert X.py_words(None) == X.py_words("") == []


def test_blank(spark):
    for s in (None, "", "  ​", "...", "—", "null", " NULL. "):
        assert one(spark, s, X.is_blank) is True
    for s in ("a", "nullify", "०"):
        assert one(spark, s, X.is_blank) is False


def test_clean_and_tokens(spark):
    assert one(spark, "राम <noise> [x] {atm} गया, घर --", X.clean_transcript) == "राम गया घर"
    assert one(spark, "", X.tokens) == []


def test_pair_class(spark):
    df = spark.createDataFrame([("सुन्दर", "सुंदर"), ("रही", "रहा"), ("अइबा", "आओगे"), ("करवाकर", "करवाया")], "a string, b string")
    assert [r.k for r in df.select(X.pair_class("a", "b").alias("k")).collect()][:3] == ["IGNORE", "IGNORE", "WRONG"]


def test_answers(spark):
    assert one(spark, "<think>a</think>\nREPLY: हाँ।\nmore", X.final_answer) == "हाँ।"
    assert one(spark, "एक। दो। ती", X.whole_sentences) == "एक। दो।"
    assert one(spark, "एक दो", X.whole_sentences) == "एक दो"
    assert one(spark, "LANG: x LANG: hi\nREPLY: y", lambda c: X.last_tag(c, "LANG:", "REPLY:")) == "hi"
    assert one(spark, "\n\n  A: x \n", lambda c: X.first_line(c, "A")) == "x"
    assert one(spark, "bundeli_candidate", X.display_name) == "Bundeli"


def test_scripts(spark):
    assert [one(spark, s, X.script_class) for s in ("", None, "राम", "ram", "राम ram", "12")] == ["empty", "empty", "devanagari", "latin", "mixed", "other"]
