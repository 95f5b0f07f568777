r"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only.

A window is 10 consecutive words of a benchmark item (a shorter item is one window). All words of a window must occur
for the window to occur, so one word is its necessary prefix: the rarest one, counted over all documents. Documents
offer only positions whose word may be such a prefix (a fixed-size bitmap of word hashes), each with the words around
it; these join the windows on the prefix word, within the length and positional bounds, and the whole window is
compared word by word.

Null text has no words: zero counts. Repeated rows are each returned. Rows with equal doc_id and different texts are
told apart. Items without words have no window; items of equal id count once. An empty benchmark marks nothing.
Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, written

WINDOW = 10
#: Slots of the bitmap of prefix words; more words than slots only make the filter weaker.
SLOTS = 1 << 16
#: Windows are broadcast up to so many bytes on disk; a larger table is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value of the contract: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; lower() is that for ASCII text, and much faster than translate()."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, win): distinct windows of each item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct()


def prefixed(windows: DataFrame, words: DataFrame) -> DataFrame:
    """windows with token (the window's rarest word over all documents; ties: the first in text order) and off (where it first stands in the window)."""
    vocabulary = windows.select(F.explode("win").alias("token")).distinct()
    bitmap = _bitmap(vocabulary)  # most other words go before the shuffle, and the rest are added up in each task
    said = words.select(F.explode(F.filter("w", lambda w: _on(bitmap, w))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = vocabulary.join(said, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    distinct = windows.select("win").distinct()
    ranked = distinct.select("win", F.explode(F.array_distinct("win")).alias("token")).join(counts, "token")
    rarest = ranked.groupBy("win").agg(F.min(F.struct("n", "token")).alias("r")).select("win", F.col("r.token").alias("token"))
    return windows.join(rarest, "win").select("item_id", "win", "token", (F.array_position("win", F.col("token")) - 1).cast("int").alias("off"), F.size("win").alias("len"))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _bitmap(tokens: DataFrame) -> Column:
    """A literal with one byte for each slot, 1 where a token falls."""
    on = bytearray(SLOTS)
    for s in tokens.select(_slot(F.col("token")).alias("s")).distinct().agg(F.collect_list("s")).first()[0]:  # SLOTS numbers at most
        on[s] = 1
    return F.lit(bytes(on))


def _on(bitmap: Column, word: Column) -> Column:
    """Whether a word's slot is on: substring() of a binary literal takes constant time."""
    return F.substring(bitmap, _slot(word) + 1, 1) == F.lit(b"\x01")


def marked(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key (hash of the text)."""
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    windows = written(prefixed(windows_of(benchmark, size), words), "windows")
    bitmap = _bitmap(windows)
    reach = size - 1

    def candidate(word: Column, i: Column) -> Column:
        start = F.greatest(i + 1 - reach, F.lit(1))
        near = F.struct(i.alias("at"), (i + 1 - start).alias("lead"), F.slice("w", start, i + 1 + reach - start + 1).alias("near"))
        return F.when(_on(bitmap, word), near)

    offered = words.select("doc_id", "text_key", F.size("w").alias("n_words"), F.array_compact(F.transform("w", candidate)).alias("c"))
    row = F.explode(F.array_append("c", F.lit(None))).alias("c")  # the null row stands for the document itself
    flat = offered.select("doc_id", "text_key", "n_words", row).select("doc_id", "text_key", "n_words", F.col("c.at").alias("at"), F.col("c.lead").alias("lead"), F.col("c.near").alias("near"), F.get("c.near", F.col("c.lead")).alias("word"))
    small = F.broadcast(windows) if input_bytes(windows) <= BROADCAST_BYTES else windows
    fits = (F.col("word") == F.col("token")) & (F.col("lead") >= F.col("off")) & (F.col("n_words") >= F.col("at") - F.col("off") + F.col("len"))
    same = F.slice("near", F.col("lead") - F.col("off") + 1, F.col("len")) == F.col("win")
    joined = flat.join(small, fits & same, "left").where(F.col("at").isNull() | F.col("item_id").isNotNull())
    found = joined.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(F.col("at").isNull()).alias("copies"),
        F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct((F.col("at") - F.col("off")).alias("from"), F.col("len").alias("len")))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["from"], s["from"] + s["len"] - 1)))))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "text_key", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def kept_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without any occurrence of a window, with their own columns."""
    bad = marked(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    return documents.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_key")), "left_anti")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, hash(text) AS h FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT DISTINCT pos.r, pos.i, l.n, win.item_id FROM pos CROSS JOIN (SELECT DISTINCT n FROM win) l JOIN win ON win.n = l.n AND win.g = array_to_string(list_slice(pos.w, pos.i, pos.i + l.n - 1), ' ') WHERE pos.i + l.n - 1 <= len(pos.w)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cover.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  coalesce(items.s, sha256('')) AS items_sha256, coalesce(cover.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
