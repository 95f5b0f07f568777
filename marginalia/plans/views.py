"""Derived views that the relational pack reads: paragraphs, words, and 20-character grids, each defined for Spark
and, independently, for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def folded(text):
    """Lower case, every run of other than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def paragraphs(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return lines.where(F.trim("text") != "").select("doc_id", "ordinal", "text", folded(F.col("text")).alias("folded"))


def words(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split(folded(F.col("text")), " ")).alias("pos", "word")).where("word <> ''")


def grid20(documents: DataFrame) -> DataFrame:
    """Consecutive 20-character pieces of the folded text: an index of a twentieth of its positions."""
    f = documents.select("doc_id", folded(F.col("text")).alias("f")).where(F.length("f") >= 20)
    return f.select("doc_id", F.explode(F.regexp_extract_all("f", F.lit("(?s).{20}"), F.lit(0))).alias("gram"))  # linear, unlike substring() by position


def probes60(benchmark: DataFrame) -> DataFrame:
    """(item_id, at, gram, whole): at every place of the folded text 20 characters, and the 60 that a vote needs."""
    f = benchmark.select("item_id", folded(F.col("text")).alias("f")).where(F.length("f") >= 60)
    whole = F.transform(F.sequence(F.lit(1), F.length("f") - 59), lambda i: F.substring("f", i, 60))
    return f.select("item_id", F.posexplode(whole).alias("at", "whole")).withColumn("gram", F.substring("whole", 1, 20))


def shingle_votes(documents: DataFrame, benchmark: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, item_id, votes): places of an item whose 20 characters are a piece of the document's grid and whose 60 the document holds."""
    met = probes60(benchmark).join(grid20(documents).distinct(), "gram").select("doc_id", "item_id", "at", "whole")
    texts = documents.select("doc_id", folded(F.col("text")).alias("f"))
    return met.join(texts, "doc_id").where(F.contains("f", F.col("whole"))).groupBy("doc_id", "item_id").agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


_FOLD = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
DUCK = {
    "paragraphs": "SELECT doc_id, ordinal, text, " + _FOLD.format("text") + " AS folded FROM (SELECT doc_id, unnest(range(len(ls))) AS ordinal, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a) b WHERE trim(text) <> ''",
    "words": "SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, string_split(" + _FOLD.format("text") + ", ' ') AS ws FROM documents) a) b WHERE word <> ''",
    "grams20": "SELECT doc_id, substr(f, CAST(i * 20 + 1 AS BIGINT), 20) AS gram FROM (SELECT doc_id, f, unnest(range(0, length(f) // 20)) AS i FROM (SELECT doc_id, " + _FOLD.format("text") + " AS f FROM documents) a) b",
    "probes60": "SELECT item_id, place, substr(f, place, 20) AS gram, substr(f, place, 60) AS whole FROM (SELECT item_id, f, unnest(range(1, length(f) - 58)) AS place FROM (SELECT item_id, " + _FOLD.format("text") + " AS f FROM benchmark) a) b",
}


def mentioned(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables and derived views that sql mentions."""
    derived = mentioned(sql, DUCK)
    base = set(mentioned(sql, TABLES)) | {"documents" for d in derived if d != "probes60"} | {"benchmark" for d in derived if d == "probes60"}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in base}
    make = {"paragraphs": lambda: paragraphs(frames["documents"]), "words": lambda: words(frames["documents"]), "grams20": lambda: grid20(frames["documents"]), "probes60": lambda: probes60(frames["benchmark"])}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    for name in derived:
        make[name]().createOrReplaceTempView(name)


def _close(sql: str, at: int) -> int:
    """Index past the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[i], 0)
        if not depth:
            return i + 1
    raise ValueError("open parenthesis")


def whole_sums(sql: str) -> str:
    """DuckDB adds integers up to HUGEINT: cast such sums to BIGINT. Sums within round() are of floating-point numbers."""
    out, at = "", 0
    for m in re.finditer(r"\b(sum|count_if)\(", sql):
        if m.start() < at or sql[: m.start()].endswith("round("):
            continue
        end = _close(sql, m.end() - 1)
        over = re.match(r"\s+OVER\s+\(", sql[end:])
        end = _close(sql, end + over.end() - 1) if over else end
        out, at = out + sql[at : m.start()] + f"CAST({sql[m.start() : end]} AS BIGINT)", end
    return out + sql[at:]


def oracle(sql: str) -> str:
    """The statement as DuckDB runs it, with the derived views that it mentions."""
    derived = mentioned(sql, DUCK)
    sql = whole_sums(re.sub(r"CAST\(([^()]+) AS STRING\)", r"CAST(\1 AS VARCHAR)", sql))
    return sql if not derived else "WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in derived) + f" SELECT * FROM ({sql}) q"
