"""Secret scans: fixed patterns, and values in a credential's context that would be costly to guess.

A value's guess cost is the least sum, over its segmentations, of the costs of words, dates, repeats, sequences,
keyboard walks and brute-force spans (log10 of guesses), found by dynamic programming. Words are as long as the
vocabulary has them; runs and repeated units have any length. Values that cost at least `LIMIT` are added to the pattern
spans; pattern spans always stay. As soon as every segmentation must have reached `enough`, that is the answer.

Null text counts as empty; empty text has no spans. Repeated rows get equal results. Texts and values of any length
are scanned whole. An empty table gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, prepare
from .tokens import VOCABULARY

KINDS = ("assign", "access", "hex", "guess")
#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Contexts whose value is costed.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|auth(?:orization)?|credentials?|bearer|login)["']?(?:[ \t]*[:=]>?[ \t]*|[ \t]+is[ \t]+)["']?([^\s"'<>,;]{6,})""", re.I | re.A)
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login")
#: log10 of guesses from which a value counts as a secret.
LIMIT = 10.0
#: Key of the longest word's length in a table of ranks; no value holds it.
LONGEST = "\n"
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?\d{1,2}[-/._]?\d{1,2}|\d{1,2}[-/._]?\d{1,2}[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d)\Z")


def word_ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Words of a public vocabulary by rank: entries that are whole words of 3 letters or more, in the file's order."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = (t[:-4] for t in sorted(vocab, key=vocab.get) if t.endswith("</w>"))
    ranks = {w: i for i, w in enumerate((w for w in words if len(w) >= 3 and w.isascii() and w.isalpha()), 1)}
    return ranks | {LONGEST: max(map(len, ranks), default=0)}


def _neighbours() -> set[tuple[str, str]]:
    """Keys that touch on a keyboard: beside each other in a row, or in rows shifted by half a key."""
    out = set()
    for r, row in enumerate(ROWS):
        for i, key in enumerate(row):
            if i + 1 < len(row):
                out |= {(key, row[i + 1]), (row[i + 1], key)}
            if r + 1 < len(ROWS):
                shift = -1 if r == 0 else 0
                for j in (i + shift, i + shift - 1):
                    if 0 <= j < len(ROWS[r + 1]):
                        out |= {(key, ROWS[r + 1][j]), (ROWS[r + 1][j], key)}
    return out


NEIGHBOURS = _neighbours()


def _alphabet(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def _square(text: str, j: int, least: int) -> int:
    """Length of the shortest unit of `least` characters or more that stands twice up to j; 0 if none does."""
    at = j - least
    while at > 0 and (at := text.rfind(text[j - least : j], 0, at + least - 1)) >= 0:
        k = j - least - at
        if 2 * k > j:
            return 0
        if k >= least and text[j - 2 * k : j - k] == text[j - k : j]:
            return k
    return 0


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs, or a number from `enough` up that it is not below."""
    n, low = len(value), value.lower()
    longest = max(10, ranks.get(LONGEST, 0) or max(map(len, ranks), default=0))
    best = [0.0] * (n + 1)
    walk = step = same = unit = repeated = 0  # lengths of runs that end here: keyboard walk, sequence, repeated character, repeated unit
    delta = None
    plain = low.translate(_LEET)
    per = max(map(_alphabet, set(value)), default=0)
    over = 0  # positions up to here whose cost is enough
    for j in range(1, n + 1):
        cost = best[j - 1] + per
        if j > 1:
            d = ord(low[j - 1]) - ord(low[j - 2])
            step = step + 1 if d == delta and abs(d) == 1 else 1 if abs(d) == 1 else 0
            same = same + 1 if d == 0 else 0
            walk = walk + 1 if (low[j - 2], low[j - 1]) in NEIGHBOURS else 0
            delta = d
        for run, base in ((step + 1, math.log10(60)), (walk + 1, math.log10(94)), (same + 1, math.log10(94))):
            if run >= 3:  # a run's any end part is a run too
                cost = min(cost, best[j - run] + base + math.log10(run))
        if unit and low[j - 1] == low[j - 1 - unit]:
            repeated += 1
        else:
            unit = _square(low, j, 2)
            repeated = 2 * unit
        if unit:  # a unit that comes again and again
            times = repeated // unit
            i = j - times * unit
            cost = min(cost, best[i] + (best[i + unit] - best[i] if best[i + unit] > best[i] else per) + math.log10(times))
        for k in range(3, min(longest, j) + 1):
            i = j - k
            rank = ranks.get(low[i:j])
            if rank is not None:
                case = 0 if value[i:j] in (low[i:j], low[i:j].upper()) else math.log10(2 if value[i:j] == low[i:j].capitalize() else k * 2)
                cost = min(cost, best[i] + 0.3 + math.log10(rank + 1) + case)
            elif plain[i:j] != low[i:j] and plain[i:j] in ranks:
                cost = min(cost, best[i] + 0.6 + math.log10(ranks[plain[i:j]] + 1) + math.log10(2) * sum(a != b for a, b in zip(plain[i:j], low[i:j], strict=True)))
            if 4 <= k <= 10 and low[i].isdigit() and low[j - 1].isdigit() and _DATE.match(low[i:j]):
                cost = min(cost, best[i] + (math.log10(120) if k == 4 else math.log10(365 * 120)))
        best[j] = cost
        over = over + 1 if cost >= enough else 0
        if over > longest and not (step or walk or same or unit):  # all that is still to come starts at one of these
            return min(best[j - longest : j + 1])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, sorted."""
    out = []
    low = text.lower()
    if any(h in low for h in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, ranks: dict[str, int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with those of costly values."""
    base = base_spans(text)
    low = text.lower()
    added = []
    if any(h in low for h in HINTS):
        added = [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks, LIMIT) >= LIMIT]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """text with each maximal run of overlapping spans replaced by mark."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, _, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scanned(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, mark: str = "[secret]", keep_text: bool = True) -> DataFrame:
    """df (without its text and the redacted one, if so asked) with n_assign, n_access, n_hex, n_guess, base_sha256, spans and redacted (null: no span); columns of these names are replaced."""
    prepare(df.sparkSession)
    longs, strings = ["n_assign", "n_access", "n_hex", "n_guess"], ["base_sha256", "spans", "redacted"]
    keep = df.drop(*longs, *strings)
    carried = [c for c in keep.columns if keep_text or c != text]
    strings = strings if keep_text else strings[:-1]
    schema = extended(keep.select(*carried).schema, **dict.fromkeys(longs, "long"), **dict.fromkeys(strings, "string"))
    ranks = df.sparkSession.sparkContext.broadcast(word_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks.value
        for b in batches:
            counts, texts = [[] for _ in longs], [[] for _ in strings]
            for t in b.column(text).to_pylist():
                base, spans = all_spans(t or "", words)
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in spans))
                for c, v in zip(texts, (hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(t, spans, mark) if spans else None), strict=False):
                    c.append(v)
            added = [*[pa.array(c, pa.int64()) for c in counts], *[pa.array(c, pa.string()) for c in texts]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *added], [*carried, *longs, *strings])

    return keep.mapInArrow(run, schema)


def redacted(documents: DataFrame, vocabulary: str = VOCABULARY, mark: str = "[secret]") -> DataFrame:
    """documents with every found span replaced in text, n_chars counted anew where it is a column; other rows unchanged."""
    prepare(documents.sparkSession)
    ranks = documents.sparkSession.sparkContext.broadcast(word_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, t in enumerate(texts):
                if t and (spans := all_spans(t, words)[1]):
                    texts[i] = redact(t, spans, mark)
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            columns["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in columns:
                counted = zip(texts, columns["n_chars"].to_pylist(), strict=True)
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in counted], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return documents.mapInArrow(run, documents.schema)
