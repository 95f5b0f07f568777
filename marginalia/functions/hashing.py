"""FNV-1a buckets, Bloom positions and canonical fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import grams

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points (UTF-16 units in the Basic Multilingual Plane), as a BIGINT."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(4294967295).cast("long")),
    )


def bucket(text: Column, count: int) -> Column:
    """The zero-padded bucket of a value: four digits or more."""
    return F.lpad((fnv1a(text) % count).cast("string"), max(4, len(str(max(0, count - 1)))), "0")


def gram_buckets(word: Column, count: int = 512) -> Column:
    """Distinct buckets of a word's trigrams: every word that holds it is in each of them."""
    return F.array_distinct(F.transform(grams(word), lambda g: fnv1a(g) % count))


def chosen_partitions(terms: DataFrame, sizes: DataFrame, count: int = 512, most: int = 16) -> DataFrame:
    """(bucket): for each term its smallest bucket of sizes (bucket, bytes), ties to the term's earlier trigram; none if a
    term has under three characters or more than `most` buckets are met: then the whole dictionary is read."""
    each = terms.select("term", F.posexplode_outer(gram_buckets(F.col("term"), count)).alias("at", "bucket")).join(sizes, "bucket", "left")
    best = each.groupBy("term").agg(F.min_by("bucket", F.struct(F.coalesce("bytes", F.lit(0)), "at")).alias("bucket"))
    whole = best.agg(F.count_if(F.col("bucket").isNull()).alias("short"), F.count_distinct("bucket").alias("n"))
    return best.select("bucket").distinct().join(F.broadcast(whole), (F.col("short") == 0) & (F.col("n") <= most), "left_semi")


#: Fixed values of the second hash, bits for each position and probes.
SECOND_SEED, SECOND_PRIME, BITS_EACH, PROBES = 0x9E3779B9, 0x85EBCA6B, 16, 10


def _probes(ids: pd.Series, at: pd.Series, bits: np.ndarray) -> np.ndarray:
    """PROBES positions for each (id, position), in 32-bit arithmetic; one character of all keys at a time."""
    keys = [f"{i}:{int(p)}" for i, p in zip(ids, at, strict=True)]
    sizes = np.array([len(k) for k in keys], np.int64)
    letters = np.zeros((len(keys), int(sizes.max(initial=0))), np.uint32)
    for r, k in enumerate(keys):
        letters[r, : len(k)] = np.frombuffer(k.encode("utf-32-le"), np.uint32)
    a, b = np.full(len(keys), FNV_OFFSET, np.uint32), np.full(len(keys), SECOND_SEED, np.uint32)
    for i in range(letters.shape[1]):
        own = i < sizes
        a = np.where(own, (a ^ letters[:, i]) * np.uint32(FNV_PRIME), a)
        mixed = (b ^ letters[:, i]) * np.uint32(SECOND_PRIME)
        b = np.where(own, mixed ^ (mixed >> np.uint32(13)), b)
    steps = np.arange(PROBES, dtype=np.uint32)[None, :] * (b | np.uint32(1))[:, None]
    return (a[:, None] + steps).astype(np.int64) % np.asarray(bits, np.int64).reshape(-1, 1)


def bloom_positions(bits: int):
    """UDF(id, position) -> the probed bits of a filter of so many bits."""

    @F.pandas_udf("array<long>")
    def run(ids: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(list(_probes(ids, at, np.array([bits]))))

    return run


def bloom_filters(positions: DataFrame) -> DataFrame:
    """(word, n, bits, byte, value): a filter for each word over its (doc_id, pos), as the bytes that are not zero."""

    @F.pandas_udf("array<long>")
    def probed(ids: pd.Series, at: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(list(_probes(ids, at, bits.to_numpy())))

    sizes = positions.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", (F.ceil(F.col("n") * BITS_EACH / 8) * 8).cast("long").alias("bits"))
    on = positions.join(sizes, "word").select("word", "n", "bits", F.explode(probed(F.col("doc_id").cast("string"), F.col("pos").cast("long"), "bits")).alias("bit"))
    return on.groupBy("word", "n", "bits", F.floor(F.col("bit") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("value"))


def bloom_members(filters: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (word, doc_id, pos) with `may`: whether all probed bits are on. False is certain."""

    @F.pandas_udf("array<long>")
    def probed(ids: pd.Series, at: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(list(_probes(ids, at, bits.to_numpy())))

    sizes = filters.select("word", "bits").distinct()
    bits = asked.join(sizes, "word").select("word", "doc_id", "pos", F.explode(probed(F.col("doc_id").cast("string"), F.col("pos").cast("long"), "bits")).alias("bit"))
    found = bits.withColumn("byte", F.floor(F.col("bit") / 8)).join(filters.select("word", "byte", "value"), ["word", "byte"], "left")
    on = F.coalesce(F.col("value").bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0, F.lit(False))
    return found.groupBy("word", "doc_id", "pos").agg(F.bool_and(on).alias("may"))


def canonical_hash(columns: list[str]) -> Column:
    """Hash of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def delta_bytes(ids: list[int]) -> bytes:
    """Ascending ids as gaps of seven bits a byte, the low ones first; the high bit says that more follow."""
    out, before = bytearray(), 0
    for i in ids:
        gap, before = int(i) - before, int(i)
        while gap > 127:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def delta_ids(data: bytes, count: int, rows: int) -> list[int]:
    """The inverse. Ids that do not ascend, reach `rows`, end early or are not `count` are an error."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, int)
    if len(ends) != count or (len(b) and b[-1] > 127) or (ends - starts >= 8).any():
        raise ValueError("posting does not decode to its count")
    if not count:
        return []
    shift = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    ids = np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << (7 * shift), starts))
    if (np.diff(ids) <= 0).any() or ids[-1] >= rows:
        raise ValueError("posting ids out of order or range")
    return ids.tolist()


@F.pandas_udf(T.BinaryType())
def delta_encoded(ids: pd.Series) -> pd.Series:
    return ids.map(delta_bytes)


@F.pandas_udf(T.ArrayType(T.LongType()))
def delta_decoded(data: pd.Series, count: pd.Series, rows: pd.Series) -> pd.Series:
    return pd.Series([delta_ids(d, c, r) for d, c, r in zip(data, count, rows, strict=True)])


def posting_blocks(postings: DataFrame, key: str, doc: str, block: int = 65536) -> DataFrame:
    """(key, block, n, data): distinct documents of a key, encoded by blocks of ids, so that no posting outgrows a row."""
    at = postings.select(key, F.floor(F.col(doc) / block).alias("block"), (F.col(doc) % block).alias("_id"))
    return at.groupBy(key, "block").agg(F.array_sort(F.collect_set("_id")).alias("ids")).select(key, "block", F.size("ids").alias("n"), delta_encoded("ids").alias("data"))


def posting_rows(blocks: DataFrame, key: str, doc: str, block: int = 65536) -> DataFrame:
    """(key, doc): the inverse."""
    ids = F.explode(delta_decoded("data", "n", F.lit(block)))
    return blocks.select(key, "block", ids.alias("_id")).select(key, (F.col("block") * block + F.col("_id")).alias(doc))
