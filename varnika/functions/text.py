"""Text primitives shared by all operators.

The ``py_`` functions work on one Python string; the others build Spark columns. Null in gives null out,
unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Characters that show nothing. Zero-width marks, joiners, directional marks, byte order mark, soft hyphen.
INVISIBLE = "­᠎​‌‍‎‏  ‪‫‬‭‮⁠⁡⁢⁣⁤﻿"

_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
#: Everything that is neither letter, vowel sign nor digit; danda and double danda (0964, 0965) and the abbreviation sign (0970) separate words.
_NOT_WORD = re.compile("(?:[^\\w\\u0900-\\u0963\\u0971-\\u097f]|_)+")
_FOREIGN_DIGIT = re.compile("[^\\D0-9]")

#: Java pattern: white space, invisible characters, dashes and dots, as a class body.
BLANK_CLASS = f"\\s\\p{{Z}}\\p{{Pd}}.\\u2026\\u00b7\\u2212{INVISIBLE}"
BLANK = f"(?is)^[{BLANK_CLASS}]*(?:null[{BLANK_CLASS}]*)?$"


def py_nfc(s: str | None) -> str | None:
    """The composed form of s."""
    return None if s is None else unicodedata.normalize("NFC", s)


def py_words(s: str | None) -> list[str]:
    """The words of s. Case, punctuation, spacing, invisible characters, Unicode form and digit script don't matter. Null: none."""
    if not s:
        return []
    s = unicodedata.normalize("NFKC", s).casefold()
    s = _INVISIBLE.sub("", s)
    s = _NOT_WORD.sub(" ", s)
    if _FOREIGN_DIGIT.search(s):
        s = _FOREIGN_DIGIT.sub(lambda m: str(unicodedata.digit(m[0], 0)), s)
    return s.split()


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, in Arrow batches: Spark has no built-in for it."""
    return s.map(py_nfc)


@F.pandas_udf(T.StringType())
def plain(s: pd.Series) -> pd.Series:
    """The words of a text (py_words), joined by one space; empty if there are none, also for null."""
    return s.map(lambda x: " ".join(py_words(x)))


def is_blank(c: Column | str) -> Column:
    """True if the text is null or holds only white space, invisible characters, dashes, dots or the word null."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.rlike(BLANK)


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Without invisible characters, each run of white space as one space, none at the ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]+", ""), r"(?U)\s+", " "))


# Devanagari signs that the comparisons below fold.
NUKTA, ANUSVARA, CHANDRABINDU = "़", "ं", "ँ"
NASAL_WITH_VIRAMA = "[नमङणञ]्"
#: Java pattern of a Devanagari word; the block holds danda too, as the counts that use it expect.
DEVANAGARI_WORD = r"[ऀ-ॿ]+"


def devanagari_words(c: Column | str) -> Column:
    """The runs of Devanagari characters, as an array."""
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(f"({DEVANAGARI_WORD})"), 1)


def clean_transcript(c: Column | str) -> Column:
    """Composed; tags, bracketed and braced notes, dashes at the end and punctuation become spaces; single spaces, none at the ends."""
    out = nfc(F.col(c) if isinstance(c, str) else c)
    for pattern in (r"</?[A-Za-z_]+>", r"\[[^\]]*\]", r"\{[^}]*\}", r"(?U)-+\s*$", r"[।,.?!;:\"'()\-]", r"(?U)\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def tokens(c: Column | str) -> Column:
    """Words of the cleaned transcript; none for an empty one."""
    return F.filter(F.split(clean_transcript(c), " "), lambda x: x != "")


def phonetic_form(c: Column | str) -> Column:
    """Composed, without nukta, all nasalisation as anusvara."""
    out = F.replace(nfc(F.col(c) if isinstance(c, str) else c), F.lit(NUKTA), F.lit(""))
    return F.regexp_replace(F.replace(out, F.lit(CHANDRABINDU), F.lit(ANUSVARA)), NASAL_WITH_VIRAMA, ANUSVARA)


def routing_form(c: Column | str) -> Column:
    """Composed, without zero-width joiners, chandrabindu as anusvara."""
    return F.replace(F.translate(nfc(F.col(c) if isinstance(c, str) else c), "‌‍", ""), F.lit(CHANDRABINDU), F.lit(ANUSVARA))


def pair_class(x: Column | str, y: Column | str) -> Column:
    """How two words differ: IGNORE (same phonetic form or one edit apart), WRONG (half of the longer word or more edited), else UNSURE."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    raw = F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when(F.levenshtein(phonetic_form(x), phonetic_form(y)) <= 1, "IGNORE").when(raw >= 0.5, "WRONG").otherwise("UNSURE")


# Words that do the same work, whatever their form: copulas, near and far demonstratives, here and there, progressive
# endings, and, negation, possessives, yes, in, also, one, and spellings of single words.
SAME_WORK = (
    "है हैं हे हेय हई छे छीये बा बाटे हल हो व वा च छिये ए", "ये यह इ ई एहा", "वह वो", "यहाँ यहां इहा", "वहाँ वहां", "रही रहे रहा रहीं रो रहियो रेहो रियो रिया रा",
    "और अउ अऊ अ", "नहीं नई नी ने", "का की के", "हाँ हां ह", "में म मा", "भी बि", "एक एगो एको", "गई गयी", "हुआ हुवा", "सीसा शीशा", "बहार बाहर", "आवो आओ", "बोडो बड़ा", "हवय हवे हावय", "भौत भोत बोहोत बहुत",
)
#: Words that keep or change the meaning, as the case may be.
EITHER = ("ओ", "एगो")


def same_work(x: Column | str, y: Column | str) -> Column:
    """Whether both words stand in one group of SAME_WORK."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    out = F.lit(False)
    for group in SAME_WORK:
        words = group.split()
        out = out | (x.isin(words) & y.isin(words))
    return out


def consequence(x: Column | str, y: Column | str) -> Column:
    """What it means that a word x became y: for words that differ much (WRONG) can_live (same work), ambiguous_source or needs_fixing; else null."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    kind = F.when(x.isin(*EITHER), "ambiguous_source").when(same_work(x, y), "can_live").otherwise("needs_fixing")
    return F.when((x != y) & (pair_class(x, y) == "WRONG"), kind)


def script_class(c: Column | str) -> Column:
    """devanagari, latin, mixed, other or empty."""
    c = F.col(c) if isinstance(c, str) else c
    d, latin = c.rlike(r"[ऀ-ॿ]"), c.rlike("[A-Za-z]")
    return F.when(c.isNull() | (c == ""), "empty").when(d & latin, "mixed").when(d, "devanagari").when(latin, "latin").otherwise("other")


def final_answer(c: Column | str, longest: int = 400) -> Column:
    """What follows the last closing think tag, then the first REPLY:, to the end of its line, so many characters at most."""
    block = strip(F.substring_index(F.col(c) if isinstance(c, str) else c, "</think>", -1))
    rest = F.when(F.contains(block, F.lit("REPLY:")), strip(F.regexp_extract(block, r"(?s)^.*?REPLY:(.*)$", 1))).otherwise(block)
    return F.substring(strip(F.regexp_extract(rest, r"^([^\n\r]*)", 1)), 1, longest)


def last_tag(c: Column | str, tag: str, until: str | None = None) -> Column:
    """First line after the last occurrence of tag, up to the tag ``until`` if that follows; null if there is no tag."""
    c = F.col(c) if isinstance(c, str) else c
    after = F.substring_index(c, tag, -1)
    if until:
        after = F.substring_index(after, until, 1)
    return F.when(F.contains(c, F.lit(tag)), strip(F.regexp_extract(strip(after), r"^([^\n]*)", 1)))


def whole_sentences(c: Column | str) -> Column:
    """Up to the last sentence mark (danda, full stop, question or exclamation mark); all of it if there is none after the first character."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.regexp_extract(c, r"(?s)^(.+[।.?!])", 1)
    return F.when(cut != "", cut).otherwise(c)


def first_line(c: Column | str, label: str = "") -> Column:
    """First line that is not blank, stripped, without a leading label; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.col(c) if isinstance(c, str) else c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    out = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.regexp_replace(out, rf"(?i)^{label}\s*:\s*", "") if label else out


def display_name(c: Column | str) -> Column:
    """bundeli_candidate becomes Bundeli."""
    return F.initcap(F.replace(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "_candidate$", ""), F.lit("_"), F.lit(" ")))
