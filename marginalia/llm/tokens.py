"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and one end-of-word symbol. Each node knows, for the case that the next symbol
has no child, where matching goes on (failure link) and how many tokens are popped on the way, so a word of n bytes
costs O(n) and no piece is built. Counts equal those of greedy longest-match-first over each word.

Null text counts as empty; empty text has no words and no tokens. Repeated rows get equal counts. A word that the
vocabulary cannot spell is one token. Texts of any length are handled in chunks that end at white space.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import extended, prepare

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Words: runs of letters, single digits, runs of other characters but white space.
PATTERN = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"\s")
END = 256
CHUNK = 1 << 18
#: Distinct words that a worker remembers.
REMEMBERED = 200_000


def byte_characters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others in order from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return out


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """Each ordinary token as symbols: bytes, and END where it may only end a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    to_byte, out = byte_characters(), []
    for token in vocab:
        body, end = (token[:-4], (END,)) if token.endswith("</w>") else (token, ())
        if body and all(c in to_byte for c in body) and not token.startswith("<|"):
            out.append((*(to_byte[c] for c in body), *end))
    return out


class Automaton:
    """Greedy longest-match token counts of words."""

    def __init__(self, vocabulary: Iterable[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        token = [False]
        for word in vocabulary:
            at = 0
            for s in word:
                if s not in child[at]:
                    child[at][s] = len(child)
                    child.append({})
                    token.append(False)
                at = child[at][s]
            token[at] = True
        self.child, self.fail, self.popped = child, [-1] * len(child), [0] * len(child)
        row = [0]
        while row:
            below = []
            for parent in row:
                for s, v in child[parent].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[parent], self.popped[parent]
                    while z >= 0 and s not in child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = (child[z][s], n) if z >= 0 else (-1, 0)
            row = below
        self.known: dict[str, int] = {}

    def count(self, symbols: Iterable[int]) -> int:
        """Tokens of one word given as symbols; 1 if the vocabulary cannot spell it."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for s in symbols:
            while s not in child[at]:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = child[at][s]
        while at > 0:
            n += popped[at]
            at = fail[at]
        return n if at == 0 else 1

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.count([*word.encode(), END])
            if len(word) <= 48:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """(words, tokens) of a text, lower-cased."""
        words = tokens = at = 0
        while at < len(text):
            to = at + CHUNK
            if to < len(text):
                cut = _SPACE.search(text, to)
                to = cut.start() if cut else len(text)
            for w, n in Counter(PATTERN.findall(text[at:to].lower())).items():
                words += n
                tokens += n * self.word(w)
            at = to
        return words, tokens


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """df (without its text, if so asked) with n_bytes, n_words and n_tokens; columns of these names are replaced. The driver reads the vocabulary."""
    prepare(df.sparkSession)
    names = ["n_bytes", "n_words", "n_tokens"]
    keep = df.drop(*names)
    carried = [c for c in keep.columns if keep_text or c != text]
    schema = extended(keep.select(*carried).schema, **dict.fromkeys(names, "long"))
    symbols = load_vocabulary(vocabulary)
    made = df.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(made.value)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            found = [automaton.text(t) for t in texts]
            added = [[len(t.encode()) for t in texts], [x[0] for x in found], [x[1] for x in found]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *[pa.array(c, pa.int64()) for c in added]], [*carried, *names])

    return keep.mapInArrow(run, schema)
