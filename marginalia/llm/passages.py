"""Substring dedup by collinear chaining: fuzzy passages that repeat across documents.

Two kinds of keys, one of each for every word of a text, make candidates. The hash of `least` words in a row stands for
an exact passage: all documents of such a key share the passage itself, so a link to one of them is enough. Two runs of
`SEED` words, `NEAR` to `FAR` words apart, stand for a fuzzy one: the second is the one with the least hash together with
the first, so edits elsewhere leave the key as it is. No position is left out. Keys of different documents meet by their
hash. Each document of a key is linked to the key's least and greatest document, so a passage shared by thousands of
documents, or a group of copies, gives a number of links in proportion to its size and no pairs within it. Not sure to
be linked are two documents whose passage is fuzzy and whose common keys all stand in a lower and a higher document
too, without a passage there. For each linked pair all shared runs of
`ANCHOR` words become anchors (maximal runs on a diagonal), ordered anchors are chained with gap costs through a
Fenwick tree, and the gaps of a chain are aligned by longest common subsequence. A chain is cut at its largest gap until
the similarity is at least `similarity`; parts of `least` words or more are passages.

A result row is (doc_id, start, end, other_id, other_start, other_end, similarity): word offsets, ends exclusive. Exact
copies are passages over whole texts. Documents without such passages, null and empty texts, and texts of fewer
than `least` words give no row. Rows with a null doc_id take no part; equal rows count once. A run that repeats within
both texts is matched occurrence by occurrence, further ones with the last; equal runs of `least` words that this
leaves open are matched by themselves. A word repeated `least` times or more is a passage of its own, longest run against longest run. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, mix, pack_sorted, prepare, shingles_of, slices, unpack_sorted, words_of, written

SEED, NEAR, FAR, ANCHOR, LEAST, SIMILARITY, GAP = 5, 6, 14, 5, 50, 0.8, 0.25
#: Ranges of keys, by their first byte; bits of a key that are kept; bits of a row's place in its piece of a batch.
RANGES, KEY_BITS, ROW_BITS = 256, 46, 9
#: Documents that one task aligns with one leader, about.
SHARE = 256
SCHEMA = "doc_id long, start long, end long, other_id long, other_start long, other_end long, similarity double"


def strobes(grams: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of each run with a run of its text `NEAR` to `FAR` words later: of these the least when hashed together."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    first, best = grams * np.uint64(0xD6E8FEB86659FD93), np.full(len(grams), most)
    for d in range(NEAR, min(FAR, len(grams) - 1) + 1):
        got = np.where(where[:-d] == where[d:], first[:-d] ^ grams[d:], most)
        np.minimum(best[:-d], got, out=best[:-d])
    at = np.flatnonzero(best != most)
    return mix(best[at]), where[at]


def long_runs(words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(word, start, length) of one word repeated `least` times or more; of a word's runs the longest."""
    cuts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]])) if len(words) else np.zeros(1, np.int64)
    found: dict[int, tuple[int, int, int]] = {}
    for x in np.flatnonzero(np.diff(cuts) >= least):
        w, n = int(words[cuts[x]]), int(cuts[x + 1] - cuts[x])
        if n > found.get(w, (0, 0, 0))[2]:
            found[w] = (w, int(cuts[x]), n)
    return sorted(found.values(), key=lambda r: r[1])


def keys_of(hashes: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of texts of `least` words or more."""
    grams, where, _ = shingles_of(hashes, rows, SEED)
    last = least - SEED
    m = max(0, len(grams) - last)
    whole = np.zeros(m, np.uint64)
    for d in [*range(0, last, SEED), last]:
        whole = whole * np.uint64(0x9FB21C651E98DF25) + grams[d : d + m]
    same = where[:m] == where[last:]
    at = where[:m][same]
    long = np.isin(where, at)
    near, by = strobes(grams[long], where[long])
    return np.concatenate([mix(whole[same]), near]), np.concatenate([at, by])


def _keys(texts: DataFrame, least: int) -> DataFrame:
    """Rows (range, ids, keys): the sorted keys of one range, each with its row's place in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, len(batch), 1 << ROW_BITS):
                b = batch.slice(x, 1 << ROW_BITS)
                ids, out = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), [np.zeros(0, np.uint64)]
                for a, _, buf, offsets in slices(b.column(1)):
                    keys, at = keys_of(*words_of(buf, offsets, WORD), least)
                    out.append(np.unique(keys >> np.uint64(64 - KEY_BITS) << np.uint64(ROW_BITS) | (at + a).astype(np.uint64)))
                packed = np.sort(np.concatenate(out))
                cuts = np.searchsorted(packed, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(KEY_BITS + ROW_BITS - 8))
                full = np.flatnonzero(np.diff(cuts))
                blobs = [pack_sorted(packed[cuts[r] : cuts[r + 1]]) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([pack_sorted(ids)] * len(full), pa.binary()), pa.array(blobs, pa.binary())], ["range", "ids", "keys"])

    return texts.mapInArrow(run, "range int, ids binary, keys binary")


def links_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, leader): each document of a key with the key's least and greatest document."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return docs, docs
    size = np.diff(np.append(first, len(keys)))
    low, high = (np.repeat(f.reduceat(docs, first), size) for f in (np.minimum, np.maximum))
    doc, lead = np.concatenate([docs, docs]), np.concatenate([low, high])
    doc, lead = doc[doc != lead], lead[doc != lead]
    order = np.lexsort((lead, doc))
    doc, lead = doc[order], lead[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lead[1:] != lead[:-1])])[: len(doc)]
    return doc[new], lead[new]


def _links(keys: DataFrame) -> DataFrame:
    """Links (doc_id, lead) of key rows, sorted by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, docs = None, [], []

        def found() -> pa.RecordBatch:
            doc, lead = links_of(np.concatenate(at), np.concatenate(docs))
            at.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lead)], ["doc_id", "lead"])

        for b in batches:
            for r, ids, blob in zip(*(b.column(c).to_pylist() for c in ("range", "ids", "keys")), strict=True):
                if r != own and at:
                    yield found()
                own, packed = r, unpack_sorted(blob)
                at.append(packed >> np.uint64(ROW_BITS))
                docs.append(unpack_sorted(ids).view(np.int64)[(packed & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)])
        if at:
            yield found()

    return keys.mapInArrow(run, "doc_id long, lead long")


def anchors_of(a: np.ndarray, b: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """Maximal runs of shared k-word runs on a diagonal: rows (start in a, start in b, words), by start in a."""
    ga, _, _ = shingles_of(a, np.zeros(len(a), np.int64), k)
    gb, _, _ = shingles_of(b, np.zeros(len(b), np.int64), k)
    if not len(ga) or not len(gb):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(gb, kind="stable")
    sorted_b = gb[order]
    lo, hi = np.searchsorted(sorted_b, ga, "left"), np.searchsorted(sorted_b, ga, "right")
    own = np.argsort(ga, kind="stable")
    sorted_a = ga[own]
    rank = np.empty(len(ga), np.int64)
    rank[own] = np.arange(len(ga)) - np.searchsorted(sorted_a, sorted_a, "left")
    i = np.flatnonzero(hi > lo)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    j = order[lo[i] + np.minimum(rank[i], hi[i] - lo[i] - 1)]
    new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])
    first = np.flatnonzero(new)
    return np.stack([i[first], j[first], np.diff(np.append(first, len(i))) + k - 1], 1)


def chains_of(anchors: np.ndarray, gap: float = GAP) -> list[list[int]]:
    """Chains of anchors that follow each other in both texts, best first: each anchor is in one chain.

    The score of an anchor is its words plus, if positive, the best earlier score less the gap cost; a Fenwick tree over
    the anchors' ends in the second text holds the greatest score plus gap x end.
    """
    n = len(anchors)
    if n == 1:
        return [[0]]
    starts_a, starts_b, words = anchors.T.tolist()
    ends_b = sorted({b + w for b, w in zip(starts_b, words, strict=True)})
    place = {e: p for p, e in enumerate(ends_b, 1)}
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (len(ends_b) + 1)
    by_end = sorted(range(n), key=lambda x: starts_a[x] + words[x])
    score, before, put = [0.0] * n, [-1] * n, 0
    bounds = np.searchsorted(ends_b, starts_b, "right").tolist()
    for x in range(n):
        while put < n and starts_a[by_end[put]] + words[by_end[put]] <= starts_a[x]:
            y = by_end[put]
            value, p = (score[y] + gap * (starts_a[y] + starts_b[y] + 2 * words[y]), y), place[starts_b[y] + words[y]]
            while p < len(tree):
                if tree[p] < value:
                    tree[p] = value
                p += p & -p
            put += 1
        best, p = (-1.0, -1), bounds[x]
        while p:
            if tree[p] > best:
                best = tree[p]
            p -= p & -p
        gain = best[0] - gap * (starts_a[x] + starts_b[x]) if best[1] >= 0 else 0.0
        score[x] = words[x] + max(0.0, gain)
        before[x] = best[1] if gain > 0 else -1
    used, out = [False] * n, []
    for x in sorted(range(n), key=lambda x: (-score[x], x)):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(x)
            x = before[x]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    masks: dict[int, int] = {}
    for p, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << p
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) of the passages of b that a repeats."""
    if len(a) == len(b) and len(a) >= least and np.array_equal(a, b):
        return [(0, len(a), 0, len(b), 1.0)]
    anchors = anchors_of(a, b)
    runs = long_runs(a, least)  # a word repeated for long: longest run against longest run
    if runs:
        other = {w: (j, n) for w, j, n in long_runs(b, least)}
        more = [(i, other[w][0], min(n, other[w][1])) for w, i, n in runs if w in other]
        if more:
            anchors = np.unique(np.concatenate([anchors, np.array(more, np.int64)]), axis=0)
    if anchors[:, 2].sum() < least * similarity / 2:
        return []
    out = []
    for chain in chains_of(anchors):
        rows = anchors[chain]
        todo = [(0, len(rows))]
        gaps_a = rows[1:, 0] - rows[:-1, 0] - rows[:-1, 2]
        gaps_b = rows[1:, 1] - rows[:-1, 1] - rows[:-1, 2]
        filled: dict[int, int] = {}
        while todo:
            x, y = todo.pop()
            a0, b0 = rows[x, 0], rows[x, 1]
            a1, b1 = rows[y - 1, 0] + rows[y - 1, 2], rows[y - 1, 1] + rows[y - 1, 2]
            if min(a1 - a0, b1 - b0) < least:
                continue
            same = int(rows[x:y, 2].sum())
            longest = max(a1 - a0, b1 - b0)
            most = same + int(np.minimum(gaps_a[x : y - 1], gaps_b[x : y - 1]).sum())
            if most >= similarity * longest:
                for g in range(x, y - 1):
                    if g not in filled and gaps_a[g] and gaps_b[g]:
                        e, f = rows[g, 0] + rows[g, 2], rows[g, 1] + rows[g, 2]
                        filled[g] = common_words(a[e : rows[g + 1, 0]].tolist(), b[f : rows[g + 1, 1]].tolist())
                    same += filled.get(g, 0)
            if same >= similarity * longest:
                out.append((int(a0), int(a1), int(b0), int(b1), same / longest))
            elif y - x > 1:
                cut = x + int(np.argmax(gaps_a[x : y - 1] + gaps_b[x : y - 1])) + 1
                todo += [(x, cut), (cut, y)]
    grams = np.sort(shingles_of(a, np.zeros(len(a), np.int64), ANCHOR)[0])
    if (grams[1:] == grams[:-1]).any():  # where short runs repeat, an equal passage may have met other occurrences
        open_ = np.ones(len(a), bool)
        for x, y, *_ in out:
            open_[x:y] = False
        if open_.sum():
            for i, j, n in anchors_of(a, b, least).tolist():
                if open_[i : i + n].any():
                    open_[i : i + n] = False
                    out.append((i, i + n, j, j + n, 1.0))
    return sorted(out)


def _aligned(rows: DataFrame) -> DataFrame:
    """Passages of rows (lead, share, lead_row, doc_id, text), sorted so that a leader's own text comes first in each share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, text = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("lead", "share", "doc_id")), strict=True))
            own = batch.column("lead_row").to_pylist()
            for x, y, buf, offsets in slices(batch.column("text")):
                hashes, at = words_of(buf, offsets, WORD)
                cuts = np.searchsorted(at, np.arange(y - x + 1))
                for i in range(x, y):
                    words = hashes[cuts[i - x] : cuts[i - x + 1]]
                    lead, share, doc = heads[i]
                    if own[i]:
                        leader, text = (lead, share), words.copy()
                    elif leader == (lead, share):
                        out += [(doc, a, b, lead, c, d, s) for a, b, c, d, s in aligned(words, text)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.float64())], ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"])

    return rows.select("lead", "share", "lead_row", "doc_id", "text").mapInArrow(run, SCHEMA)


def passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """The repeated passages of documents (doc_id, text)."""
    spark = documents.sparkSession
    prepare(spark)
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = _links(_keys(texts, least).repartition(parts, "range").sortWithinPartitions("range"))
    pairs = linked.select(F.greatest("doc_id", "lead").alias("x"), F.least("doc_id", "lead").alias("y"), (F.col("doc_id") > F.col("lead")).alias("up")).groupBy("x", "y").agg(F.bool_or("up").alias("up"))
    pairs = written(pairs.select(F.when(F.col("up"), F.col("x")).otherwise(F.col("y")).alias("doc_id"), F.when(F.col("up"), F.col("y")).otherwise(F.col("x")).alias("lead")), "links")
    shares = pairs.groupBy("lead").agg(F.ceil(F.count("*") / F.lit(SHARE)).cast("int").alias("shares"))
    members = pairs.join(shares, "lead").select("doc_id", "lead", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("share"), F.lit(False).alias("lead_row"))
    leaders = shares.select(F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(True).alias("lead_row"))
    wanted = members.union(leaders).join(texts, "doc_id")
    ordered = wanted.repartition(parts, "lead", "share").sortWithinPartitions("lead", "share", F.desc("lead_row"), "doc_id")
    return _aligned(ordered).distinct()
