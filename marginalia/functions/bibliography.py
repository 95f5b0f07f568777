"""Names of files, people and works: title and author of a file name, kinds of name, dates of a biography, card values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.folds import ALEFS, DIGITS, VOWEL_MARKS, facet_fold, nfkd
from marginalia.functions.matching import _FORMS, _PIECES, decoded

#: File types, words before an author's name, beginnings that are no name, name parts, given names.
FILE_TYPES = ("docx", "doc", "rtf", "pdf", "epub", "bok", "txt", "md")
UNTITLED = "كتاب بدون عنوان"
BEFORE_AUTHOR = ("تأليف", "للمؤلف", "المؤلف", "للشيخ", "للإمام", "للأستاذ", "للدكتور", "الشيخ", "الإمام", "الدكتور")
NO_AUTHOR = ("دراسة", "بحث", "رسالة", "شرح", "تحقيق", "تعليق", "اختصار", "مختصر", "حاشية", "طبعة", "نسخة", "الجزء", "المجلد")
NAME_PARTS = ("بن", "ابن", "بنت", "أبو", "أبي", "أم", "عبد", "آل")
GIVEN_NAMES = ("محمد", "أحمد", "محمود", "إبراهيم", "إسماعيل", "يوسف", "علي", "حسن", "حسين", "خالد", "عبدالله", "عبدالرحمن", "مصطفى", "عمر", "عثمان", "سليمان", "صالح", "سعيد")
#: Catalogue labels that name no person, under the facet fold.
COLLECTIVES = ("مجموعه من المولفين", "مجهولون")
ORGANISATIONS = ("جامعه المدينه العالميه", "اللجنه الدايمه للبحوث العلميه والافتاء", "ملتقي اهل الحديث")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def file_title(name: Column) -> Column:
    """The name without its file type."""
    bare = F.trim(F.regexp_replace(name, rf"(?i)\.{_any(FILE_TYPES)}$", ""))
    return F.when(bare == "", UNTITLED).otherwise(bare)


def useful_title(c: Column) -> Column:
    return F.length(c).between(2, 180) & c.rlike(r"[\p{L}\p{N}]")


def file_name_parts(name: Column) -> Column:
    """struct(title, author): parts around the only spaced dash, if the second reads like a person's name; else author is null."""
    whole = _squeezed(file_title(name))
    dash = r"^(.*?) (ـ+|[-–—]) (.*)$"
    title, sign, rest = (F.trim(F.regexp_extract(whole, dash, i)) for i in (1, 2, 3))
    named = rf"(?U)^{_any(BEFORE_AUTHOR)}\s*[:：]?\s*"
    author = F.trim(F.regexp_replace(rest, named, ""))
    words = F.split(author, " ")
    possible = F.length(author).between(2, 100) & (F.size(words) <= 8) & ~author.rlike(rf"^{_any(NO_AUTHOR)}(?: |$)") & author.rlike(r"^[\p{L}\p{M}.،'’\- ]+$")
    person = sign.startswith("ـ") | rest.rlike(named) | F.arrays_overlap(words, F.array(*map(F.lit, NAME_PARTS)))
    person = person | (F.size(words).between(2, 5) & (F.element_at(words, -1).startswith("ال") | words[0].isin(*GIVEN_NAMES)))
    split = (F.regexp_count(whole, F.lit(r" (?:ـ+|[-–—]) ")) == 1) & useful_title(title) & possible & person
    return F.struct(F.when(split, title).otherwise(whole).alias("title"), F.when(split, author).alias("author"))


def entity_kind(name: Column) -> Column:
    """person, collective or organization, by exact catalogue labels only."""
    folded = facet_fold(name)
    return F.when(folded.isin(*COLLECTIVES), "collective").when(folded.isin(*ORGANISATIONS), "organization").otherwise("person")


def _year(c: Column) -> Column:
    return F.when(c != "", F.translate(c, *DIGITS).cast("int"))


def biography(c: Column) -> Column:
    """struct(text, reference, birth_hijri, death_hijri, birth_gregorian, death_gregorian, age, age_about); years that are not told are null."""
    digits, none = "[٠-٩0-9]+", "[٠0]{3}"
    t = F.regexp_replace(decoded(c), "(?i)&(?:times|nbsp);", " ")
    t = _squeezed(F.regexp_replace(t, "(?s)(?:×|البحث في:|تنبيهات هامة:).*$", ""))
    named = r"(?U)\s(?:نقلا\s+عن|المصدر)\s*:\s*(\S.*)$"
    source = F.regexp_replace(F.regexp_extract(t, named, 1), "[.،؛]+$", "")
    t = F.trim(F.regexp_replace(t, named, ""))
    t = F.regexp_replace(t, rf"\( ?{none} ?- ?({digits}) ?هـ ?= ?{none} ?- ?({digits}) ?م ?\)", "(ت $1 هـ = $2 م)")
    t = F.regexp_replace(t, rf"\( ?{none} ?- ?({digits}) ?هـ ?\)", "(ت $1 هـ)")
    both = rf"\( ?({digits}) ?- ?({digits}) ?هـ ?= ?({digits}) ?- ?({digits}) ?م ?\)"
    died = rf"\(ت ({digits}) ?هـ(?: ?= ?({digits}) ?م\))?"
    age = rf"(?:عن|عاش) (نحو )?({digits}) ?(?:عاما|عامًا|سنة)"
    lived = [F.regexp_extract(t, both, i) for i in range(1, 5)]
    dead = [F.regexp_extract(t, died, i) for i in (1, 2)]
    years = _year(F.regexp_extract(t, age, 2))
    return F.struct(
        t.alias("text"), F.when(source != "", F.trim(source)).alias("reference"), _year(lived[0]).alias("birth_hijri"), F.coalesce(_year(lived[1]), _year(dead[0])).alias("death_hijri"),
        _year(lived[2]).alias("birth_gregorian"), F.coalesce(_year(lived[3]), _year(dead[1])).alias("death_gregorian"),
        F.when(years > 0, years).alias("age"), F.when(years > 0, F.regexp_extract(t, age, 1) != "").alias("age_about"),
    )


def leaves(card: str | None) -> list[str]:
    """Distinct strings of a JSON card in order; a card that is no JSON is its own value."""
    card = (card or "").strip()
    if not card:
        return []
    if card[0] not in "[{":
        return [card]
    try:
        todo = [json.loads(card)]
    except ValueError:
        return [card]
    found: dict[str, None] = {}
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if clean := " ".join(item.split()):
                found.setdefault(clean)
        elif isinstance(item, list):
            todo += reversed(item)
        elif isinstance(item, dict):
            todo += reversed(item.values())
    return list(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def card_values(cards: pd.Series) -> pd.Series:
    return cards.map(leaves)


def places_every(text: str | None, step: int = 64) -> list[int]:
    """The place in the text of every step-th letter of its search fold; a space has the place of the last sign that it stands for."""
    at: list[int] = []
    apart = -1
    for m in _PIECES.finditer(text or ""):
        if m.lastgroup == "word":
            if apart >= 0 and at:
                at.append(apart)
            at += [i for i, c in enumerate(m[0], m.start()) for _ in c.lower().translate(_FORMS)]
            apart = -1
        elif m.lastgroup != "mark":
            apart = m.end() - 1
    return at[::step]


@F.pandas_udf(T.ArrayType(T.LongType()))
def sparse_offsets(texts: pd.Series) -> pd.Series:
    return texts.map(places_every)


def _query_letters(c: Column) -> Column:
    return F.translate(F.regexp_replace(nfkd(c), f"[{VOWEL_MARKS}]", ""), ALEFS[0] + "ىة", ALEFS[1] + "يه")


def reciter_fold(c: Column) -> Column:
    """Letters as they are asked for; punctuation stays."""
    return F.lower(_squeezed(_query_letters(c)))


def corpus_fold(c: Column) -> Column:
    """The same with punctuation as space."""
    return F.lower(F.trim(F.regexp_replace(_query_letters(c), r"[^\p{L}\p{N}]+", " ")))
