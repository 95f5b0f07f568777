"""Text folds. They differ on purpose and are not to be merged.

Native expressions where Spark can say it; Unicode normalisation forms need Arrow-batched UDFs. Offsets count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arabic marks, the stretching letter, letter folds, digits.
MARKS = "ؐ-ًؚ-ٰٟۖ-ۭ"
TATWEEL = "ـ"
ALEFS = ("أإآٱ", "اااا")
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
CONTROLS = "​-‏‪-‮⁠-⁩﻿"
#: Brackets that may enclose a note's number, and its digits.
NOTE_OPEN, NOTE_CLOSE, NOTE_DIGITS = r"(\[{﴿（", r")\]}﴾）", "0-9٠-٩۰-۹"
#: The narrower class of marks that author, facet and link folds remove.
VOWEL_MARKS = "\u064b-\u065f\u0670\u06d6-\u06ed"


def _unmarked(c: Column) -> Column:
    return F.regexp_replace(c, f"[{MARKS}{TATWEEL}]", "")


def _lower(c: Column) -> Column:
    """Lower case code point by code point: no final form of sigma."""
    return F.lower(F.translate(c, "Σ", "σ"))


def search_fold(c: Column) -> Column:
    """Bracketed digits, marks and separators go, then lower case; alef and yeh forms are one; teh marbuta stays."""
    c = F.regexp_replace(c, rf"(?U)[{NOTE_OPEN}]\s*[{NOTE_DIGITS}]+\s*[{NOTE_CLOSE}]", " ")
    c = F.trim(F.regexp_replace(_unmarked(c), r"[^\p{L}\p{N}]+", " "))
    return F.translate(_lower(c), ALEFS[0] + "ى", ALEFS[1] + "ي")


def presentation_fold(c: Column) -> Column:
    """Lower case first; controls and marks go; alef, yeh, waw, teh marbuta and digits fold; punctuation is space."""
    c = _unmarked(F.regexp_replace(_lower(c), f"[{CONTROLS}]", ""))
    c = F.translate(c, ALEFS[0] + "ىؤئة" + DIGITS[0], ALEFS[1] + "يويه" + DIGITS[1])
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def heading_fold(c: Column) -> Column:
    """Lower case first; marks go; punctuation and outer spaces stay; white space collapses."""
    return F.regexp_replace(F.translate(_unmarked(_lower(c)), ALEFS[0] + "ى", ALEFS[1] + "ي"), r"(?U)\s+", " ")


def root_letters(c: Column) -> Column:
    """Only hamza to yeh."""
    return F.regexp_replace(c, "[^ء-ي]", "")


def reader_fold(c: Column) -> Column:
    """Persian yeh and kaf as Arabic, then the search fold."""
    return search_fold(F.translate(c, "یک", "يك"))


def _normal(form: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return run


nfc, nfkc, nfkd = (_normal(f) for f in ("NFC", "NFKC", "NFKD"))


def link_fold(c: Column, hamza: bool = True) -> Column:
    """Tags and entities are space; letters lose marks, alef and yeh forms; only Arabic letters stay; without hamza too, if so asked."""
    c = nfkd(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&[^;]+;", " "))
    c = F.translate(F.regexp_replace(c, f"[{VOWEL_MARKS}]", ""), ALEFS[0] + "ى", ALEFS[1] + "ي")
    c = F.regexp_replace(c, "[^ء-غف-ي]", "")
    return c if hamza else F.regexp_replace(c, "ء", "")


def author_fold(c: Column) -> Column:
    c = F.regexp_replace(nfkd(c), f"[{VOWEL_MARKS}{TATWEEL}]", "")
    return F.lower(F.trim(F.regexp_replace(F.translate(c, ALEFS[0] + "ىؤئة", ALEFS[1] + "يويه"), r"[^\p{L}\p{N}]+", " ")))


def verse_fold(c: Column, marks: bool = False, dagger: bool = False) -> Column:
    """marks: vowel marks stay. dagger: the small alef counts as alef."""
    c = F.translate(c, "\u0670", "ا") if dagger else c
    c = F.regexp_replace(nfc(c), TATWEEL, "")
    c = F.translate(c, ALEFS[0] + "ىئؤ", ALEFS[1] + "ييو")
    c = c if marks else F.regexp_replace(c, f"[{MARKS}]", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def broad_fold(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(_unmarked(nfkc(c)), ALEFS[0] + "ىؤئة", ALEFS[1] + "يويه"), r"[^\p{L}\p{N}]+", " ")))


def facet_fold(c: Column) -> Column:
    c = F.regexp_replace(nfkd(c), f"[{VOWEL_MARKS}{TATWEEL}]", "")
    return F.lower(F.trim(F.regexp_replace(F.translate(c, ALEFS[0] + "ىة", ALEFS[1] + "يه"), r"[^\p{L}\p{N}]+", " ")))


def aligner_fold(c: Column) -> Column:
    c = F.translate(_unmarked(nfkc(c)), ALEFS[0] + "ىة", ALEFS[1] + "يه")
    c = F.regexp_replace(c, "[\u200b-\u200f\u202a-\u202e\u2066-\u2069]", "")
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def memory_key(c: Column) -> Column:
    """Translation-memory key: NFKC, line ends unified, invisible characters and stretching gone, spaces collapsed."""
    c = F.regexp_replace(F.regexp_replace(nfkc(c), "\r\n?", "\n"), f"[{CONTROLS}{TATWEEL}]", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def toc_key(c: Column) -> Column:
    c = F.regexp_replace(_unmarked(nfkc(c)), r"[\[\](){}«»﴾﴿<>*•]+", " ")
    return F.trim(F.regexp_replace(F.translate(c, ALEFS[0] + "ى", ALEFS[1] + "ي"), r"(?U)\s+", " "))


def toc_filter(c: Column) -> Column:
    c = F.translate(_unmarked(nfkc(c)), ALEFS[0] + "ىؤئ" + DIGITS[0], ALEFS[1] + "يوي" + DIGITS[1])
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def work_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(_unmarked(nfkc(c)), ALEFS[0] + "ىة", ALEFS[1] + "يه"), r"[^\p{L}\p{N}]+", " ")))


def base_title(c: Column) -> Column:
    """Title without what follows a dash and a word for edition or verification."""
    c = F.trim(nfkc(c))
    cut = F.regexp_extract(c, r"(?U)^(.*?)\s+[\-–—]\s+(?:ط|ت|طبعة|تحقيق)(?=\s|$).+$", 1)
    return F.trim(F.when(cut != "", cut).otherwise(c))


def title_key(c: Column) -> Column:
    """Work titles and author names of editions: marks go, punctuation and space collapse."""
    c = F.regexp_replace(nfkc(c), f"[\u064b-\u065f\u0670{TATWEEL}]", "")
    c = F.regexp_replace(c, r"""[()\[\]{}«»"'،,:؛.!؟/_-]+""", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
