"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark.

Counting: workers turn texts into 64-bit word hashes in numpy and send sorted, pre-added blocks of (key, count) by key
range; each range is merged by one task and written to the shared folder as a sorted hash array. Words are then
numbered by their place in that array, bigrams counted the same way as pairs of numbers. A bigram goes to the range of
its first word, but the bigrams of a word that is frequent enough to be hot are spread over all ranges. Workers map
the arrays into memory and score texts against them; the model is never gathered by the driver or a worker.

Learning covers all texts of the training part; nothing is pruned. Null text counts as empty. An empty text is its end
token. Repeated rows are learned and scored as often as they come. Without training texts there are no known tokens,
and both scores are those of an even distribution over one unknown word. At most 2**32 - 2 distinct words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import SOLID, added_up, crc_mod, extended, input_bytes, map_array, mix, new_path, pack_sorted, prepare, slices, unpack_sorted, words_of, write_array

#: The hash of the token that ends a text, and a context for the first token.
END = mix(np.array([0xE4D], np.uint64))[0]
#: Input bytes for which one range of keys is merged by one task.
RANGE_BYTES = 8 << 20
#: Tokens that a worker gathers before it sends what they add up to.
GATHERED = 1 << 20
#: Occurrences from which a word's bigrams are spread over all ranges.
HOT = 50_000
_BLOCKS = "part int, kind int, keys binary, a binary, b binary, c binary"


@dataclass
class Model:
    """Where the arrays are, and the figures that hold for all of them."""

    folder: str
    word_parts: int
    pair_parts: int
    bases: list[int]  # number of the first word of each range
    words: int
    tokens: int
    texts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int
    word_backoff: float


def tokens_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes with each text's end token, rows' ends) of slices of the column."""
    for a, b, buf, offsets in slices(column):
        hashes, rows = words_of(buf, offsets, SOLID)
        n = np.bincount(rows, minlength=b - a) if len(rows) else np.zeros(b - a, np.int64)
        ends = np.cumsum(n + 1)
        out = np.full(int(ends[-1]), END, np.uint64)
        out[np.arange(len(hashes)) + rows] = hashes
        yield out, ends


def _blocks(parts: np.ndarray, keys: np.ndarray, kind: int, *values: np.ndarray) -> Iterator[tuple]:
    """A row for each range: sorted keys and their values."""
    order = np.lexsort((keys, parts))
    parts, keys, values = parts[order], keys[order], [v[order] for v in values]
    cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(parts) else np.zeros(1, np.int64)
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        yield (int(parts[x]), kind, pack_sorted(keys[x:y]), *(v[x:y].astype(np.uint32).tobytes() for v in values), *[b""] * (3 - len(values)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]], ["part", "kind", "keys", "a", "b", "c"])


def _merged(table: pa.Table, n: int) -> tuple[np.ndarray, ...]:
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    values = [np.concatenate([np.frombuffer(v, np.uint32) for v in table.column(c).to_pylist()]).astype(np.int64) for c in "abc"[:n]]
    return added_up(np.concatenate(keys), *values)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of a hash: its top bits. parts: a power of two."""
    bits = parts.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class Words:
    """Numbers of words: places in the concatenated ranges."""

    def __init__(self, folder: str, parts: int, bases: list[int]):
        self.parts, self.bases = parts, bases
        self.keys = [map_array(folder, f"word-{p}", np.uint64) if bases[p] < bases[p + 1] else None for p in range(parts)]
        self.folder = folder

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; -1 where it is unknown."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        part = _part_of(distinct, self.parts)
        cuts = np.searchsorted(part, np.arange(self.parts + 1))
        for p in range(self.parts):
            x, y = cuts[p], cuts[p + 1]
            if x < y and self.keys[p] is not None:
                keys = self.keys[p]
                at = np.minimum(np.searchsorted(keys, distinct[x:y]), len(keys) - 1)
                out[x:y] = np.where(keys[at] == distinct[x:y], at + self.bases[p], -1)
        return out[back]

    def values(self, name: str, dtype) -> np.ndarray:
        """A value of each word, by number; kept in a mapping range by range."""
        return _Ranges([map_array(self.folder, f"{name}-{p}", dtype) if self.keys[p] is not None else np.zeros(0, dtype) for p in range(self.parts)], self.bases)


class _Ranges:
    def __init__(self, arrays: list[np.ndarray], bases: list[int]):
        self.arrays, self.bases = arrays, np.array(bases)

    def __getitem__(self, numbers: np.ndarray) -> np.ndarray:
        """Values of known numbers; 0 for others."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct, self.bases)
        for p, values in enumerate(self.arrays):
            x, y = cuts[p], cuts[p + 1]
            if x < y and len(values):
                out[x:y] = values[distinct[x:y] - self.bases[p]]
        return out[back]


_loaded: dict[str, tuple] = {}


def _mapped(folder: str, parts: int, bases: list[int]) -> tuple[Words, _Ranges]:
    """One mapping a worker process; another model's is let go."""
    if folder not in _loaded:
        _loaded.clear()
        words = Words(folder, parts, bases)
        _loaded[folder] = (words, words.values("count", np.int64))
    return _loaded[folder]


def _pair_part(u: np.ndarray, pairs: np.ndarray, counts: np.ndarray, parts: int, hot: int) -> np.ndarray:
    """The range of a bigram: of its first word, or of the pair where that word is hot."""
    return _part_of(mix(np.where(counts >= hot, pairs, u.astype(np.uint64) << np.uint64(32))), parts)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things seen once to four times."""
    if not n[0] or not n[1]:
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(x, 0.01), k) for k, x in zip((1, 2, 3), d, strict=True))


def fit(documents: DataFrame, hot: int = HOT) -> Model:
    """Learn from all rows of documents (column text)."""
    spark = documents.sparkSession
    prepare(spark)
    folder = new_path(spark, "kneser-ney")
    # files say how large they are; of other frames only the partitions are known
    ranges = min(input_bytes(documents) / RANGE_BYTES, 16 * max(1, documents.rdd.getNumPartitions()))
    parts = 1 << max(3, math.ceil(math.log2(max(1, ranges))))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for hashes, _ in tokens_of(b.column(0)):
                held.append(hashes)
                size += len(hashes)
                if size >= GATHERED:
                    keys, n = np.unique(np.concatenate(held), return_counts=True)
                    held, size = [], 0
                    yield _batch(list(_blocks(_part_of(keys, parts), keys, 0, n)))
        if held:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield _batch(list(_blocks(_part_of(keys, parts), keys, 0, n)))

    def merge_words(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        keys, n = _merged(table, 1)
        write_array(folder, f"word-{p}", keys.tobytes())
        write_array(folder, f"count-{p}", n.astype(np.int64).tobytes())
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(keys)], "tokens": [int(n.sum())], "ends": [int(n[keys == END].sum())]})

    texts = documents.select("text")
    got = texts.mapInArrow(count_words, _BLOCKS).groupBy("part").applyInArrow(merge_words, "part int, n long, tokens long, ends long").collect()
    sizes = {r.part: r.n for r in got}
    bases = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(parts)])]).tolist()
    words, total, ends = bases[-1], sum(r.tokens for r in got), sum(r.ends for r in got)
    if words >= 2**32 - 2:
        raise ValueError("too many distinct words")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = _mapped(folder, parts, bases)
        held, size = [], 0

        def added() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            u = pairs >> np.uint64(32)
            often = np.where(u == words, ends, counts[u.astype(np.int64)])
            return _batch(list(_blocks(_pair_part(u, pairs, often, parts, hot), pairs, 0, n)))

        for b in batches:
            for hashes, stops in tokens_of(b.column(0)):
                w = vocabulary.numbers(hashes)
                u = np.concatenate([[words], w[:-1]])
                u[stops[:-1]] = words
                held.append(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64))
                size += len(w)
                if size >= GATHERED:
                    yield added()
                    held, size = [], 0
        if held:
            yield added()

    def merge_pairs(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        pairs, n = _merged(table, 1)
        write_array(folder, f"pair-{p}", pairs.tobytes())
        write_array(folder, f"times-{p}", n.astype(np.uint32).tobytes())
        u, w = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        starts = np.array(bases, np.uint64)
        rows = []
        of_u, n1, n2, n3 = added_up(u, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))
        own = of_u < words  # the context of first tokens is added up like a word's, in a range of its own
        rows += _blocks(np.where(own, np.searchsorted(starts, of_u, "right") - 1, parts), of_u, 1, n1, n2, n3)
        of_w, m = added_up(w, np.ones(len(w), np.int64))
        rows += _blocks(np.searchsorted(starts, of_w, "right") - 1, of_w, 2, m)
        rows.append((-1, 3, b"", np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes(), b"", b""))
        return pa.Table.from_batches([_batch(rows)])

    def merge_values(table: pa.Table) -> pa.Table:
        p, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
        out = np.zeros(4, np.int64)
        if kind == 3:
            out = np.sum([np.frombuffer(a, np.int64) for a in table.column("a").to_pylist()], axis=0)
        elif kind == 1:
            numbers, *n = _merged(table, 3)
            size, first = (bases[p + 1] - bases[p], bases[p]) if p < parts else (1, words)
            for name, v in zip(("once", "twice", "more"), n, strict=True):
                dense = np.zeros(size, np.uint32)
                dense[numbers.astype(np.int64) - first] = v
                write_array(folder, f"{name}-{p}", dense.tobytes())
        else:
            numbers, m = _merged(table, 1)
            dense = np.zeros(bases[p + 1] - bases[p], np.uint32)
            dense[numbers.astype(np.int64) - bases[p]] = m
            write_array(folder, f"before-{p}", dense.tobytes())
            out = np.array([(m == k).sum() for k in (1, 2, 3, 4)], np.int64)
        total = int(m.sum()) if kind == 2 else 0
        return pa.table({"kind": pa.array([kind], pa.int32()), "n": pa.array([out.tolist()], pa.list_(pa.int64())), "total": [total], "distinct": [len(m) if kind == 2 else 0]})

    pairs = texts.mapInArrow(count_pairs, _BLOCKS).groupBy("part").applyInArrow(merge_pairs, _BLOCKS)
    got = pairs.groupBy("part", "kind").applyInArrow(merge_values, "kind int, n array<long>, total long, distinct long").collect()
    of = {k: np.sum([r.n for r in got if r.kind == k] or [[0] * 4], axis=0).tolist() for k in (2, 3)}
    continuations, distinct = sum(r.total for r in got), sum(r.distinct for r in got)
    d = _discounts(of[2])
    taken = d[0] * of[2][0] + d[1] * of[2][1] + d[2] * (distinct - of[2][0] - of[2][1])
    return Model(folder, parts, parts, bases, words, total, ends, _discounts(of[3]), d, continuations, taken / continuations if continuations else 1.0)


class Scorer:
    """A model's arrays, mapped by a worker."""

    def __init__(self, model: Model, hot: int = HOT):
        self.m, self.hot = model, hot
        self.words, self.counts = _mapped(model.folder, model.word_parts, model.bases)
        self.before = _existing(model, "before")
        self.once, self.twice, self.more = (_existing(model, n) for n in ("once", "twice", "more"))
        self.start = [int(map_array(model.folder, f"{n}-{model.word_parts}", np.uint32)[0]) if model.texts else 0 for n in ("once", "twice", "more")]
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def times(self, u: np.ndarray, w: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Occurrences of bigrams of known words."""
        keys = u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        part = _pair_part(distinct >> np.uint64(32), distinct, often[first], self.m.pair_parts, self.hot)
        out = np.zeros(len(distinct), np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.m.pair_parts + 1))
        for p in range(self.m.pair_parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if not len(mine):
                continue
            if p not in self.pairs:
                try:
                    self.pairs[p] = (map_array(self.m.folder, f"pair-{p}", np.uint64), map_array(self.m.folder, f"times-{p}", np.uint32))
                except FileNotFoundError:  # no bigram fell into this range
                    self.pairs[p] = None
            if self.pairs[p] is not None:
                have, n = self.pairs[p]
                at = np.minimum(np.searchsorted(have, distinct[mine]), len(have) - 1)
                out[mine] = np.where(have[at] == distinct[mine], n[at], 0)
        return out[back]

    def score(self, hashes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, model score) of each text."""
        m = self.m
        w = self.words.numbers(hashes)
        u = np.concatenate([[m.words], w[:-1]])
        u[stops[:-1]] = m.words
        starts = np.concatenate([[0], stops[:-1]])
        count = self.counts[w]
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        before = self.before[w]
        d1, d2, d3 = m.word_discounts
        cut = np.select([before == 0, before == 1, before == 2], [0, d1, d2], d3)
        p = np.maximum(before - cut, 0) / max(1, m.continuations) + m.word_backoff / (m.words + 1)
        often = np.where(u == m.words, m.texts, self.counts[u])
        seen = often > 0
        if seen.any():
            at = np.flatnonzero(seen)
            uu, ww = u[at], w[at]
            begin = uu == m.words
            n1, n2, n3 = (np.where(begin, s, a[uu]) for s, a in zip(self.start, (self.once, self.twice, self.more), strict=True))
            e1, e2, e3 = m.pair_discounts
            c = np.zeros(len(at), np.int64)
            known = ww >= 0
            c[known] = self.times(uu[known], ww[known], often[at][known])
            cut = np.select([c == 0, c == 1, c == 2], [0, e1, e2], e3)
            p[at] = (np.maximum(c - cut, 0) + (e1 * n1 + e2 * n2 + e3 * n3) * p[at]) / often[at]
        add = lambda v: np.add.reduceat(v, starts)
        return stops - starts, add((count > 0).astype(np.int64)), add(base), add(np.log10(p))


def _existing(model: Model, name: str) -> _Ranges:
    out = []
    for p in range(model.word_parts):
        try:
            out.append(map_array(model.folder, f"{name}-{p}", np.uint32) if model.bases[p] < model.bases[p + 1] else np.zeros(0, np.uint32))
        except FileNotFoundError:  # no word of this range was a context
            out.append(np.zeros(0, np.uint32))
    return _Ranges(out, model.bases)


def scored(df: DataFrame, model: Model, hot: int = HOT) -> DataFrame:
    """df, without its text, with n_tokens, n_known, train_tokens, base_score, score and perplexity; columns of these names are replaced."""
    prepare(df.sparkSession)
    keep = df.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    carried = [c for c in keep.columns if c != "text"]
    schema = extended(keep.select(*carried).schema, n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double", perplexity="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, hot)
        for b in batches:
            got = [scorer.score(*x) for x in tokens_of(b.column("text"))]
            n, known, base, score = (np.concatenate([g[i] for g in got]) if got else np.zeros(0) for i in range(4))
            added = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(10 ** (-score / np.maximum(n, 1)), pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *added], schema.names)

    return keep.mapInArrow(run, schema)


def held_out() -> Column:
    return crc_mod("doc_id", 7) == 2
