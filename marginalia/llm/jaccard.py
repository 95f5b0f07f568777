"""N-gram Jaccard join by chosen paths.

A text's set is its shingles of five words (a text of one to four words is one shingle). In each run a set chooses
each of its tokens with chance 1 / (threshold x size) by a hash of the run and token, so two similar sets share a
chosen token with chance 1 - 1/e or more, and unrelated sets hardly ever. Buckets of over `bucket` sets are split on
tokens chosen anew, down to `depth`; buckets are then brute-forced on sketches (the least `SKETCH` hashes of a set,
exact for smaller sets). Runs are repeated until the chance of missing a pair at the threshold, even in buckets
split to the full depth, is below 1 - recall. Buckets still large at full depth are dealt out as pairs of blocks, so
no pair is skipped and no task holds more than two blocks.

Sets of large buckets of the first runs are compared with the bucket's least set beforehand. What that joins has one
label: a bucket whose sets all have one label needs no further work, and pairs of blocks of one label are left out, so
a group of very many near copies costs linear work here. Candidates are kept as the merges of different labels, never
as pairs of a bucket. The candidates' components are then verified exactly: full sets, block against block, counting
each document's links (pairs with Jaccard >= threshold) and keeping the merges of true ones. Blocks of large components
are written to the shared folder once and read from there, so what is shuffled stays in proportion to the input.

Equal sets are one node with a multiplicity throughout. Null and empty texts, and texts without words, have no
links and are their own class. Rows with a null doc_id take no part. Rows that repeat a doc_id: the one with the
most shingles counts (ties: the greatest hash of the set). An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, dropped, map_array, mix, new_path, prepare, shingles_of, slices, words_of, write_array, written
from .components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.995
BUCKET, DEPTH, SKETCH = 1024, 3, 128
#: Estimated similarity from which a pair is a candidate: four standard deviations of a sketch below the threshold.
LOOSE = 0.66
#: Runs whose large buckets are compared with their least set first, and the bytes of a sketch used for that.
LED, LED_BYTES = 3, 512
#: Sets, and shingles of sets, in a block of the exact step; a larger set stands alone.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Blocks that one task compares with one block.
CHUNK = 32
#: Tokens that are compared at a time as columns of a matrix, and pairs of their owners up to which they are listed instead.
COLUMNS, LISTED = 4096, 1 << 20
_ODD = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xA076_1D64_78BD_642F)) | np.uint64(1)


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is missed with chance 1 - recall at most, after `depth` splits (a critical branching process)."""
    found = 1.0
    for _ in range(depth):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def sets_of(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for a, b, buf, offsets in slices(column):
        hashes, rows = words_of(buf, offsets, WORD)
        grams, where, _ = shingles_of(hashes, rows, k)
        n = np.bincount(rows, minlength=b - a) if len(rows) else np.zeros(b - a, np.int64)
        ends, word_ends = np.searchsorted(where, np.arange(b - a + 1)), np.concatenate([[0], np.cumsum(n)])
        for i in range(b - a):
            if n[i] >= k:
                yield np.unique(grams[ends[i] : ends[i + 1]])
            elif n[i]:
                out = np.uint64(n[i])
                for h in hashes[word_ends[i] : word_ends[i + 1]]:
                    out = mix(np.array([out], np.uint64))[0] ^ h
                yield mix(np.array([out], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def chosen_of(s: np.ndarray, runs: int, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(slot, key) of the tokens that a set chooses; slot: run * depth + level. A multiplication by an odd number is a bijection on tokens."""
    slots, keys = [], []
    limit = np.uint64(min(2**64 - 1, int(2.0**64 / (threshold * max(1, len(s))))))
    for x in range(0, len(s), COLUMNS):
        h = s[None, x : x + COLUMNS] * _ODD[: runs * depth, None]
        slot, at = np.nonzero(h <= limit)
        slots.append(slot)
        keys.append(h[slot, at])
    return (np.concatenate(slots), np.concatenate(keys)) if slots else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _nodes(df: DataFrame, runs: int, depth: int, threshold: float, k: int) -> DataFrame:
    """(doc_id, set_key, n, sketch, chosen): of each row; chosen holds (run, level, t)."""
    kind = pa.struct([("run", pa.int32()), ("level", pa.int32()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sketches, slots, tokens = [], [], [], [], []
            for s in sets_of(b.column(1), k):
                sizes.append(len(s))
                keys.append(_set_key(s))
                sketches.append(s[:SKETCH].tobytes())
                slot, key = chosen_of(s, runs, depth, threshold)
                slots.append(slot)
                tokens.append(key)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in slots])]).astype(np.int32)
            slot = np.concatenate([*slots, np.zeros(0, np.int64)]).astype(np.int32)
            token = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
            flat = pa.StructArray.from_arrays([pa.array(slot // depth), pa.array(slot % depth), pa.array(token)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "set_key", "n", "sketch", "chosen"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key string, n int, sketch binary, chosen array<struct<run int, level int, t long>>")


def _set_key(s: np.ndarray) -> str:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return f"{int(mix(s).sum()):x}.{int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()):x}.{len(s):x}" if len(s) else ""


class _Forest:
    """Component labels of n things, merged many at a time; a label is the component's least thing."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def merge(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Joins the components of i and the others; returns the joins as pairs of their labels."""
        labels = np.unique(self.label[np.append(others, i)])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return [(int(x), int(labels[0])) for x in labels[1:]]


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges a[i]..b[i]."""
    n = b - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _estimated(a: np.ndarray, b: np.ndarray, sketch: int) -> float:
    """Similarity of two sets by their least hashes, `sketch` of each at most: exact for sets no larger than that."""
    top = min(a[-1] if len(a) == sketch else np.uint64(2**64 - 1), b[-1] if len(b) == sketch else np.uint64(2**64 - 1))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _bucket_merges(ids: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], labels: np.ndarray, sides: np.ndarray) -> tuple[list[int], list[int]]:
    """Merges of different labels by pairs whose estimated similarity is LOOSE or more: pairs of ids.

    The estimate is the share of common hashes below the ends of both sketches, where both sides are known; it is exact
    for sets no larger than a sketch. A thing is only compared with later things that are not yet in its component. Of
    two sides only what merges between them is returned; each side alone is another bucket.
    """
    n, top = len(ids), np.uint64(2**64 - 1)
    last = np.array([s[-1] if len(s) == SKETCH else top for s in sketches], np.uint64)
    held = np.array([len(s) for s in sketches])
    tokens, owner = np.concatenate(sketches), np.repeat(np.arange(n), held)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    padded = None
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    forest = _Forest(first[back])
    out: tuple[list[int], list[int]] = ([], [])
    two = len(np.unique(sides)) > 1
    for across in (False, True) if two else (False,):
        for i in range(n - 1):
            open_ = (forest.label[i + 1 :] != forest.label[i]) & ((sides[i + 1 :] != sides[i]) == across)
            if not open_.any():
                continue
            a, b = np.searchsorted(tokens, sketches[i], "left"), np.searchsorted(tokens, sketches[i], "right")
            if (b - a).max() < 2:
                continue
            both = np.bincount(owner[_spread(a, b)], minlength=n)[i + 1 :]
            js = np.flatnonzero(open_ & (both > 0) & (np.minimum(sizes[i + 1 :], sizes[i]) >= LOOSE * np.maximum(sizes[i + 1 :], sizes[i]))) + i + 1
            if not len(js):
                continue
            mine = np.searchsorted(sketches[i], last[js], "right")
            theirs = held[js].copy()
            longer = last[js] > last[i]
            if longer.any():
                if padded is None:
                    padded = np.full((n, SKETCH), top, np.uint64)
                    for x, s in enumerate(sketches):
                        padded[x, : len(s)] = s
                theirs[longer] = (padded[js[longer]] <= last[i]).sum(1)
            common = both[js - i - 1]
            js = js[common >= LOOSE * (mine + theirs - common)]
            if len(js):
                for x, y in forest.merge(i, js):
                    if across or not two:
                        out[0].append(int(ids[x]))
                        out[1].append(int(ids[y]))
    return out


def _brute(rows: DataFrame) -> DataFrame:
    """(a, b): candidate merges within each key. rows: key long, doc_id, n, sketch, label, side; a key's rows fit a task."""
    names = ("key", "doc_id", "n", "sketch", "label", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: set[tuple[int, int]] = set()

        def done() -> None:
            if len({x[4] for x in held}) > 1:
                columns = list(zip(*held, strict=True))
                found = _bucket_merges(np.array(columns[1]), np.array(columns[2]), [np.frombuffer(x, np.uint64) for x in columns[3]], np.array(columns[4]), np.array(columns[5]))
                out.update(zip(*found, strict=True))

        def flush() -> pa.RecordBatch:
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if held and held[-1][0] != row[0]:
                    done()
                    held = []
                held.append(row)
            if len(out) >= 10_000:
                yield flush()
        done()
        yield flush()

    return rows.select(*names).mapInArrow(run, "a long, b long")


def _chosen(nodes: DataFrame, level: int) -> DataFrame:
    """(doc_id, run, t) of a level."""
    return nodes.select("doc_id", F.explode(F.filter("chosen", lambda x: x["level"] == level)).alias("x")).select("doc_id", "x.run", "x.t")


def led_edges(nodes: DataFrame, bucket: int) -> DataFrame:
    """(a, b): sets of large buckets of the first runs that are candidates with the bucket's least set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, lead, s, t = (batch.column(c).to_pylist() for c in ("doc_id", "lead", "s", "t"))
            like = [_estimated(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), LED_BYTES // 8) >= LOOSE for x, y in zip(s, t, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, ok in zip(doc, like, strict=True) if ok], pa.int64()), pa.array([x for x, ok in zip(lead, like, strict=True) if ok], pa.int64())], ["a", "b"])

    rows = written(_chosen(nodes, 0).where(F.col("run") < LED).select("doc_id", F.xxhash64("run", "t").alias("key")), "led")
    leads = written(rows.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("lead")).where(F.col("c") > bucket).select("key", "lead"), "leads")
    pairs = rows.join(leads, "key").where("doc_id <> lead").select("doc_id", "lead").distinct()
    short = nodes.select("doc_id", F.substring("sketch", 1, LED_BYTES).alias("s"))
    both = pairs.join(short, "doc_id").join(short.select(F.col("doc_id").alias("lead"), F.col("s").alias("t")), "lead")
    out = written(both.mapInArrow(run, "a long, b long"), "led")
    dropped(rows, leads)
    return out


def candidate_edges(nodes: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """Spanning edges between candidate sets. nodes: the rows of each distinct set's least document."""
    spark = nodes.sparkSession
    led = led_edges(nodes, bucket)
    labels = components(led, "labels").withColumnRenamed("node", "doc_id")
    first = nodes.select("doc_id", F.filter("chosen", lambda x: x["level"] == 0).alias("chosen")).join(labels, "doc_id", "left")
    first = first.select("doc_id", F.coalesce("class", "doc_id").alias("label"), F.explode("chosen").alias("x"))
    rows = first.select("doc_id", F.col("x.run").alias("run"), F.xxhash64("x.run", "x.t").alias("key"), "label")
    found, tables, large = None, [], None
    for level in range(1, depth + 1):
        rows = written(rows, f"paths{level}")
        counts = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "c")
        counts = written(counts, f"sizes{level}")
        kept = written(rows.join(counts, "key"), f"shared{level}")
        dropped(rows, counts)
        tables.append(kept)
        small = kept.where(F.col("c") <= bucket).select("key", "doc_id", "label", F.lit(0).cast("long").alias("side"))
        found = small if found is None else found.union(small)
        large = kept.where(F.col("c") > bucket)
        if large.isEmpty():
            large = None
            break
        if level < depth:
            rows = large.join(_chosen(nodes, level), ["doc_id", "run"]).select("doc_id", "run", F.xxhash64("key", "t").alias("key"), "label").distinct()
    if large is not None:
        found = found.union(_cells(large, bucket // 2))
    with_sketch = found.join(nodes.select("doc_id", "n", "sketch"), "doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merges = written(_brute(with_sketch.repartition(parts, "key").sortWithinPartitions("key", "side", "doc_id")), "candidates")
    dropped(*tables)
    return led.union(merges)


def _cells(large: DataFrame, size: int) -> DataFrame:
    """Rows of buckets that no token splits, for each pair of blocks: sets of one frequent label have blocks of their own, which need no pair with each other."""
    per = written(large.groupBy("key", "label").agg(F.count("*").alias("m")).withColumn("own", F.col("m") >= size), "cell-labels")
    pooled = per.where("not own").groupBy("key").agg(F.ceil(F.sum("m") / F.lit(size)).cast("int").alias("pools"))
    own = per.where("own").select("key", "label", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.lit(size)).cast("int") - 1)).alias("at")).select("key", F.xxhash64("label", "at").alias("side"), F.col("label").alias("of"))
    blocks = own.union(pooled.select("key", F.explode(F.sequence(F.lit(0), F.col("pools") - 1)).alias("at")).select("key", F.xxhash64(F.lit("pool"), "at").alias("side"), F.lit(None).cast("long").alias("of")))
    blocks = written(blocks, "cell-blocks")
    other = blocks.select("key", F.col("side").alias("side2"), F.col("of").alias("of2"))
    apart = (F.col("side") == F.col("side2")) & F.col("of").isNull() | (F.col("side") < F.col("side2")) & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False))
    cells = blocks.join(other, "key").where(apart).select("key", F.xxhash64("key", "side", "side2").alias("cell"), F.explode(F.array_distinct(F.array("side", "side2"))).alias("side"))
    placed = large.join(per, ["key", "label"]).join(pooled, "key", "left")
    mine = F.when(F.col("own"), F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / F.lit(size))).cast("int"))).otherwise(F.xxhash64(F.lit("pool"), F.pmod(F.xxhash64("label"), F.col("pools")).cast("int")))
    return placed.select("key", "doc_id", "label", mine.alias("side")).join(cells, ["key", "side"]).select(F.col("cell").alias("key"), "doc_id", "label", "side")


class Sets:
    """A block of sets: its tokens sorted, each with its owner."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def common(self, other: Sets) -> np.ndarray:
        """Sizes of the intersections: a row for each set here, a column for each there."""
        n, m = len(self.sizes), len(other.sizes)
        out = np.zeros((n, m), np.float32)
        shared = np.intersect1d(self.tokens, other.tokens)
        for x in range(0, len(shared), COLUMNS):
            some = shared[x : x + COLUMNS]
            a, b = (np.stack([np.searchsorted(s.tokens, some, "left"), np.searchsorted(s.tokens, some, "right")]) for s in (self, other))
            if ((a[1] - a[0]) * (b[1] - b[0])).sum() > LISTED:
                left, right = (np.zeros((k, len(some)), np.float32) for k in (n, m))
                for dense, s, (lo, hi) in ((left, self, a), (right, other, b)):
                    dense[s.owner[_spread(lo, hi)], np.repeat(np.arange(len(some)), hi - lo)] = 1
                out += left @ right.T
            else:
                mine = np.repeat(self.owner[_spread(*a)], np.repeat(b[1] - b[0], a[1] - a[0]))
                theirs = other.owner[_spread(np.repeat(b[0], a[1] - a[0]), np.repeat(b[1], a[1] - a[0]))]
                out += np.bincount(mine.astype(np.int64) * m + theirs, minlength=n * m).reshape(n, m)
        return out

    def linked(self, other: Sets, threshold: float) -> np.ndarray:
        """Which pairs have Jaccard >= threshold."""
        common = self.common(other)
        return (common > 0) & (common >= threshold * (self.sizes[:, None] + other.sizes[None, :] - common) - 1e-9)


def _components_of(ok: np.ndarray) -> np.ndarray:
    """Component labels of a symmetric matrix of links."""
    forest = _Forest(np.arange(len(ok)))
    for i in range(len(ok)):
        js = np.flatnonzero(ok[i, i + 1 :]) + i + 1
        if len(js):
            forest.merge(i, js)
    return forest.label


def _verify(members: DataFrame, texts: DataFrame, threshold: float, k: int, block: int) -> DataFrame:
    """(doc_id, links, other): exact links of each member with blocks of its candidate component; edges that span what is linked (other, or null)."""
    spark = members.sparkSession
    folder = new_path(spark, "blocks")
    schema = "doc_id long, links long, other long"

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(sets_of(b.column(1), k))
            right = pa.array([_set_key(s) == key for s, key in zip(sets, b.column(5).to_pylist(), strict=True)], pa.bool_())
            made = pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:5], pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "class", "blocks", "copies", "set"])
            yield made.filter(right)

    sizes = members.groupBy("class").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    sizes = written(sizes, "class-sizes")
    sized = members.join(sizes, "class").select("doc_id", "class", "blocks", "copies", "set_key")
    sets = sized.join(texts, "doc_id").select("doc_id", "text", "class", "blocks", "copies", "set_key").mapInArrow(to_sets, "doc_id long, class long, blocks int, copies long, set binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sets.repartition(parts, "class", "block").sortWithinPartitions("class", "block", "doc_id")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "links", "other"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("class", "block", "doc_id", "copies", "set", "blocks")
        held: list[tuple] = []
        out: list[tuple] = []

        def done() -> None:
            if not held or len(held) == 1 and held[0][5] == 1:
                return
            ids, copies = (np.array([x[c] for x in held], np.int64) for c in (2, 3))
            sets = Sets([np.frombuffer(x[4], np.uint64) for x in held])
            ok = sets.linked(sets, threshold)
            np.fill_diagonal(ok, False)
            links, label = ok @ copies, _components_of(ok)
            out.extend((int(ids[i]), int(links[i]), int(ids[label[i]])) for i in np.flatnonzero(links))
            if held[0][5] > 1:  # kept for the other blocks
                name = f"{held[0][0]}-{held[0][1]}"
                head = np.concatenate([[len(ids)], ids, copies, label, sets.sizes]).astype(np.int64)
                write_array(folder, name, head.tobytes() + sets.tokens.tobytes() + sets.owner.astype(np.int64).tobytes())

        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if held and held[-1][:2] != row[:2]:
                    done()
                    held = []
                if not held or held[-1][2] != row[2]:  # rows that repeat a doc_id
                    held.append(row)
            yield batch(out)
        done()
        yield batch(out)

    inside = written(ordered.mapInArrow(within, schema), "within")

    def load(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sets]:
        data = map_array(folder, name, np.int64)
        n = int(data[0])
        ids, copies, label, sizes = (data[1 + x * n : 1 + (x + 1) * n] for x in range(4))
        sets, total = Sets.__new__(Sets), int(sizes.sum())
        sets.sizes, sets.tokens, sets.owner = sizes, data[1 + 4 * n : 1 + 4 * n + total].view(np.uint64), data[1 + 4 * n + total :]
        return ids, copies, label, sets

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for of, i, first, last in zip(*(b.column(n).to_pylist() for n in ("class", "i", "first", "last")), strict=True):
                try:
                    ids, copies, label, sets = load(f"{of}-{i}")
                except FileNotFoundError:  # no set fell into this block
                    continue
                links = np.zeros(len(ids), np.int64)
                forest, roots = _Forest(label), [ids]
                for j in range(first, last):
                    if j == i:
                        continue
                    try:
                        others, more, theirs, there = load(f"{of}-{j}")
                    except FileNotFoundError:
                        continue
                    ok = sets.linked(there, threshold)
                    links += ok @ more
                    if j > i:  # merges of components of the two blocks
                        base = len(forest.label)
                        forest.label = np.concatenate([forest.label, theirs + base])
                        roots.append(others)
                        ids_of = np.concatenate(roots)
                        for x in np.flatnonzero(ok.any(1)):
                            for p, q in forest.merge(int(x), np.unique(theirs[ok[x]]) + base):
                                out.append((int(ids_of[p]), 0, int(ids_of[q])))
                out.extend((int(ids[x]), int(links[x]), int(ids[x])) for x in np.flatnonzero(links))
            yield batch(out)

    rows = sizes.where("blocks > 1").select("class", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    rows = rows.select("class", "i", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(CHUNK))).alias("first")).select("class", "i", "first", F.least(F.col("first") + CHUNK, "blocks").alias("last"))
    across = written(rows.repartition(parts).mapInArrow(between, schema), "between")
    return inside.union(across)


def joined(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = SHINGLE, bucket: int = BUCKET, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per doc_id: doc_id, class_id (least doc_id of its component of similar texts) and n_links (other documents with Jaccard >= threshold)."""
    prepare(documents.sparkSession)
    runs = runs_for(recall, depth)
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = written(_nodes(texts, runs, depth, threshold, k), "sets")
    keys = written(every.groupBy("doc_id").agg(F.max(F.struct("n", "set_key")).alias("s")).select("doc_id", "s.n", "s.set_key"), "keys")
    groups = keys.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").cast("long").alias("n"))
    groups = written(groups, "groups")
    nodes = written(every.join(groups.select("doc_id", "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id"]), "nodes")
    dropped(every)
    edges = candidate_edges(nodes, threshold, bucket, depth)
    loose = written(components(edges).withColumnRenamed("node", "doc_id").join(groups, "doc_id"), "loose")
    dropped(nodes)
    verified = _verify(loose, texts, threshold, k, block)
    links = verified.groupBy("doc_id").agg(F.sum("links").alias("links"))
    classes = components(verified.where("doc_id <> other").select(F.col("doc_id").alias("a"), F.col("other").alias("b")), "classes")
    reps = groups.join(links, "doc_id", "left").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    reps = reps.select("set_key", F.coalesce("class", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = keys.where("n > 0").join(reps, "set_key").select("doc_id", "class_id", "n_links")
    return full.union(keys.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class of similar texts, that of the least doc_id; rows without words stay. With their own columns.

    Rows with a null doc_id are compared with each other only. Where ids are null or repeated, rows get numbers of their own.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        gone = joined(documents).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
        return documents.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    rows = written(documents.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col("_row").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("_id"))
    classes = joined(own.where("_id is not null").drop("_id")).union(joined(own.where("_id is null").drop("_id")))
    named = written(classes.select(F.col("doc_id").alias("_row"), "class_id").join(own.select(F.col("doc_id").alias("_row"), "_id"), "_row"), "classes")
    first = named.groupBy("class_id").agg(F.min(F.struct("_id", "_row")).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").drop("_row")
