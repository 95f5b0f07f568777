"""Folds with offsets, match ranges, excerpts, phrase offsets, text differences, and clean plain text.

Offsets count code points of the original text. What needs a position for each letter runs as Arrow-batched UDFs;
cleaning is a chain of native expressions.
"""

from __future__ import annotations

import functools
import os.path
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.folds import MARKS, NOTE_CLOSE, NOTE_DIGITS, NOTE_OPEN, TATWEEL

_PIECES = regex.compile(rf"(?P<note>[{NOTE_OPEN}]\s*[{NOTE_DIGITS}]+\s*[{NOTE_CLOSE}])|(?P<mark>[{MARKS}{TATWEEL}]+)|(?P<word>[\p{{L}}\p{{N}}]+)|(?P<other>.)", regex.S)
_FORMS = str.maketrans("أإآٱى", "ااااي")
_NUMBER = re.compile(rf"[{NOTE_DIGITS}]+")
_NOTE, _MARK, _WORD = (regex.compile(p) for p in (rf"[{NOTE_OPEN}]\s*[{NOTE_DIGITS}]+\s*[{NOTE_CLOSE}]", rf"[{MARKS}{TATWEEL}]+", r"[\p{L}\p{N}]+"))
#: UTF-8 bytes of text that are folded with offsets at a time; one text longer than that stands alone.
SLICE_BYTES = 1 << 18


@functools.lru_cache(4096)
def _letter(c: str) -> str:
    """The fold of a letter or number; nothing for marks that are letters too."""
    return "" if _MARK.match(c) else c.lower().translate(_FORMS)


def fold_with_offsets(text: str | None) -> tuple[str, list[int]]:
    """The search fold, and where in the text each of its characters comes from; a space has the place of what follows it."""
    out: list[str] = []
    at: list[int] = []
    apart = False
    for m in _PIECES.finditer(text or ""):
        kind = m.lastgroup
        if kind == "mark":
            continue
        if kind != "word":
            apart = bool(out)
            continue
        if apart:
            out.append(" ")
            at.append(m.start())
            apart = False
        for i, c in enumerate(m[0], m.start()):
            low = _letter(c)
            out.append(low)
            at += [i] * len(low)
    return "".join(out), at


def ranges_of(text: str | None, query: str) -> list[tuple[int, int]]:
    """(start, end) of the query's non-overlapping matches in the folded text, as places in the text."""
    folded, at = fold_with_offsets(text)
    wanted = fold_with_offsets(query)[0]
    if not wanted:
        return []
    return [(at[m.start()], at[m.end() - 1] + 1) for m in re.finditer(re.escape(wanted), folded)]


def excerpt_around(text: str | None, query: str, most: int = 220, near: int | None = None) -> str:
    """`most` characters centred on the first match (or on place `near`), cut at spaces where these are outside the match."""
    text = text or ""
    folded, at = fold_with_offsets(text)
    wanted = fold_with_offsets(query)[0]
    if near is None:
        first = folded.find(wanted) if wanted else -1
    else:
        first = next((i for i, x in enumerate(at) if x >= min(max(near, 0), len(text))), len(folded))
    if first < 0 or len(text) <= most:
        return text
    start = at[first] if first < len(at) else 0
    last = first + len(wanted) - 1
    end = (at[last] if 0 <= last < len(at) else start) + 1
    left = max(0, start - max(0, most - max(1, end - start)) // 2)
    right = min(len(text), left + most)
    left = max(0, right - most)
    if left and 0 <= (space := text.find(" ", left)) < start:
        left = space + 1
    if right < len(text) and (space := text.rfind(" ", 0, right + 1)) > end:
        right = space
    return ("… " if left else "") + text[left:right].strip() + (" …" if right < len(text) else "")


def phrase_places(text: str | None, query: str) -> list[int]:
    """Where the query's whole words follow each other; numbers between them are notes and do not count."""
    folded, at = fold_with_offsets(text)
    wanted = fold_with_offsets(query)[0].split()
    words = [(m[0], m.start()) for m in re.finditer(r"\S+", folded)]
    out = []
    for i, (word, start) in enumerate(words):
        if not wanted or word != wanted[0]:
            continue
        j = i
        for w in wanted[1:]:
            j += 1
            while j < len(words) and _NUMBER.fullmatch(words[j][0]):
                j += 1
            if j >= len(words) or words[j][0] != w:
                break
        else:
            out.append(at[start])
    return out


@functools.cache
def _points() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """By code point: 2 for a letter or number, 1 for a mark, else 0; its fold; and the folds of more than one character, by code point."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    kind = np.zeros(len(every), np.uint8)
    for pattern, value in ((_WORD, 2), (_MARK, 1)):
        for m in pattern.finditer(every):
            kind[m.start() : m.end()] = value
    low, longer = np.zeros(len(every), np.uint32), {}
    for i in np.flatnonzero(kind == 2).tolist():
        c = every[i].lower().translate(_FORMS)
        if len(c) == 1:
            low[i] = ord(c)
        else:
            longer[i] = c
    return kind, low, longer


def _folded_slice(texts: list[str | None]) -> pa.StructArray:
    kind, low, longer = _points()
    texts = [t or "" for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = "\0".join(texts)  # no note reaches over this sign
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = kind[points]
    for m in _NOTE.finditer(joined):
        kinds[m.start() : m.end()] = 0
    seen = np.flatnonzero(kinds != 1).astype(np.int32)
    word = kinds[seen] == 2
    at = seen[word]
    del kinds, seen
    first = np.searchsorted(at, starts)
    apart = np.concatenate([[False], ~word[:-1]])[word] if len(word) else word
    apart[first[:-1][np.diff(first) > 0]] = False
    # What a letter gives is a space where it begins a further word, and its fold.
    letters = points[at]
    size = 1 + apart.astype(np.uint8)
    long = [(i, longer[int(letters[i])]) for i in np.flatnonzero(np.isin(letters, list(longer))).tolist()]
    for i, c in long:
        size[i] += len(c) - 1
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    out = np.full(ends[-1], ord(" "), np.uint32)
    out[ends[1:] - 1] = low[letters]
    for i, c in long:
        out[ends[i + 1] - len(c) : ends[i + 1]] = [ord(x) for x in c]
    bounds = ends[first]
    del points, letters, ends
    at -= np.repeat(starts[:-1].astype(np.int32), np.diff(first))
    origin = np.repeat(at, size)
    octets = np.zeros(len(out) + 1, np.int32)
    np.cumsum(1 + (out > 0x7F).astype(np.uint8) + (out > 0x7FF) + (out > 0xFFFF), out=octets[1:])
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(octets[bounds]), pa.py_buffer(str(memoryview(out), "utf-32-le").encode()))
    return pa.StructArray.from_arrays([folded, pa.ListArray.from_arrays(pa.array(bounds), pa.array(origin))], ["folded", "offsets"])


def folded_slices(texts: pa.Array) -> Iterator[pa.StructArray]:
    """fold_with_offsets of all texts in order, as arrays of few texts each: offsets take many times a text's own memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield _folded_slice(texts[a:b].to_pylist())
        a = b


@F.arrow_udf(T.StructType([T.StructField("folded", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))]))
def folded_with_offsets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield from folded_slices(texts)


def match_ranges(text: Column, query: str) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in ranges_of(t, query)])

    return run(text)


def centred_excerpt(text: Column, query: str, most: int = 220) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: excerpt_around(t, query, most))

    return run(text)


def phrase_offsets(text: Column, query: str) -> Column:
    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: phrase_places(t, query))

    return run(text)


@F.pandas_udf(T.StructType([T.StructField("available", T.BooleanType()), T.StructField("identical", T.BooleanType()), T.StructField("offset", T.IntegerType()), T.StructField("left_part", T.StringType()), T.StructField("right_part", T.StringType())]))
def first_difference(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Where two texts first differ, with 70 characters before and 150 after; not available where one is empty."""
    rows = []
    for a, b in zip(left, right, strict=True):
        a, b = (a or "").strip(), (b or "").strip()
        if not a or not b:
            rows.append((False, None, None, None, None))
            continue
        at = len(os.path.commonprefix([a, b]))
        same = at == len(a) == len(b)
        part = lambda t, at=at: t[max(0, at - 70) : at + 150]
        rows.append((True, same, at, None if same else part(a), None if same else part(b)))
    return pd.DataFrame(rows, columns=["available", "identical", "offset", "left_part", "right_part"]).astype({"available": "boolean", "identical": "boolean", "offset": "Int32"})


#: Character references that the sources use, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: What markup becomes, in this order.
MARKUP = (
    (r"(?is)<\s*(?:script|style)\b[^>]*>.*?<\s*/\s*(?:script|style)\s*>", ""),
    (r"(?i)(?:\n*<\s*(?:hr\b[^>]*|s\d+\s*)/?>\n*)+", "\n"),
    (r"(?i)<\s*br\b[^>]*/?>", "\n"),
    (r"(?i)<\s*/\s*(?:p|div|li|h[1-6])\s*>", "\n"),
    (r"""(?i)<\s*["']?a\b[^>]*\bhref\s*=\s*["']?inr://[^>]*>""", ""),
    (r"""(?i)<\s*/?\s*["']?a\s*/?\s*>""", ""),
    (r"<[^>]+>", ""),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
    (r"\n{3,}", "\n\n"),
)
_NOTES = (
    (r"¬[\x{A0} \t]*([(\[]?[\x{A0} \t]*[0-9٠-٩۰-۹])", "$1"),
    (r"([\[(])[\x{A0} \t]*([0-9٠-٩۰-۹]+)[\x{A0} \t]*([\])])", "$1$2$3"),
    (r"\s+([،؛:.!?؟])", "$1"),
    (r"[ \t]{2,}", " "),
)


def decoded(c: Column) -> Column:
    for name, sign in REFERENCES:
        c = F.regexp_replace(c, f"(?i){name}", sign)
    return c


def clean_plain(c: Column) -> Column:
    """Markup as plain text: rules and levels become line ends, links keep their words, other tags go."""
    c = decoded(F.regexp_replace(c, "\r\n?| | ", "\n"))
    for pattern, by in MARKUP:
        c = F.regexp_replace(c, pattern, by)
    return c


def narrator_ids(c: Column) -> Column:
    """Distinct numbers of narrator links, in order."""
    return F.array_distinct(F.regexp_extract_all(decoded(c), F.lit(r"""(?i)<?\s*["']?a\s+href\s*=\s*["']?inr://man-(\d+)"""), F.lit(1)))


def clean_search(c: Column) -> Column:
    """Plain text as it is shown for a hit: note signs joined to their numbers, no space before punctuation."""
    c = clean_plain(c)
    for pattern, by in _NOTES:
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def footnote_boundary(c: Column) -> Column:
    """Where the notes of a page begin (code points): at a ruled line, else where the first of two or more numbered notes at line starts stands; null without notes."""
    ruled = F.regexp_instr(c, F.lit(r"(?:^|\n)\s*[_ـ]{3,}\s*(?:\n|$)"))
    entry = r"(?:^|\n)\s*[\[(](?:[0-9٠-٩۰-۹]+|[*⁎∗]{1,4})[\])](?=[\x{A0} \t]*(?:\S|\r?\n[\x{A0} \t]*\S))"
    first = F.regexp_instr(c, F.lit(r"(?:(?<=\n)\s*|^\s*)" + entry[len(r"(?:^|\n)\s*") :]))
    lead = F.length(F.regexp_extract(F.substring(c, first, F.length(c)), r"^\s*", 0))
    return F.when(ruled > 0, ruled - 1).when(F.regexp_count(c, F.lit(entry)) >= 2, first + lead - 1)


def body_and_notes(c: Column) -> Column:
    """struct(body, notes): the text before the notes and from there on; notes null where there are none."""
    at = footnote_boundary(c)
    return F.struct(F.when(at.isNull(), c).otherwise(F.substring(c, F.lit(1), at)).alias("body"), F.when(at.isNotNull(), F.substring(c, at + 1, F.length(c))).alias("notes"))
