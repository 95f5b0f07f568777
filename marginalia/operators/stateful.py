"""Sequential operators: a running group that resets, monotone alignment, ordered checksums.

Each works on one key's rows in order, key by key; keys are the unit of parallelism, as in the systems that they model.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed_groups(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """df with `pack`: greedy packing of consecutive rows whose sizes add up to `most` at most; an oversized row stands alone."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {size} long, pack int"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        pack, held, out = 0, 0, []
        for n in p[size].fillna(0):
            if held and held + n > most:
                pack, held = pack + 1, 0
            held += n
            out.append(pack)
        return p.assign(pack=pd.array(out, "int32"))

    return df.select(by, order, F.col(size).cast("long").alias(size)).groupBy(by).applyInPandas(run, schema)


def staged_batches(df: DataFrame, by: str, order: str, size: str, rows: int = 100, most: int = 900_000, stage_rows: int = 1000, stage_bytes: int = 8_000_000) -> DataFrame:
    """(by, order, size, stage, batch): rows in order in batches of so many rows and bytes (a separator each, two brackets), an
    oversized row alone; a stage, after which a cursor is kept, ends once it has its rows or bytes. Batches count within a stage."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {size} long, stage int, batch int"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        stage, batch, n, held, staged, staged_bytes = 0, 0, 0, 2, 0, 0
        out: list[tuple[int, int]] = []
        for own in p[size].fillna(0) + 1:
            if n and (n >= rows or held + own > most or staged + n >= stage_rows):
                staged, staged_bytes, batch, n, held = staged + n, staged_bytes + held, batch + 1, 0, 2
            if not n and (staged >= stage_rows or staged_bytes >= stage_bytes):
                stage, batch, staged, staged_bytes = stage + 1, 0, 0, 0
            n, held = n + 1, held + own
            out.append((stage, batch))
        return p.assign(stage=pd.array([s for s, _ in out], "int32"), batch=pd.array([b for _, b in out], "int32"))

    return df.select(by, order, F.col(size).cast("long").alias(size)).groupBy(by).applyInPandas(run, schema)


def coalesced_ranges(df: DataFrame, by: str, start: str, end: str, gap: int, longest: int) -> DataFrame:
    """(by, start, end, n): ranges of a key merged while the gap and the merged length stay within bounds."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, start long, end long, n int"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for a, b in sorted(zip(p[start], p[end], strict=True)):
            if out and a - out[-1][1] <= gap and max(b, out[-1][1]) - out[-1][0] <= longest:
                out[-1][1], out[-1][2] = max(out[-1][1], b), out[-1][2] + 1
            else:
                out.append([a, b, 1])
        return pd.DataFrame([[p[by].iloc[0], *x] for x in out], columns=[by, "start", "end", "n"])

    return df.groupBy(by).applyInPandas(run, schema)


def ordered_checksum(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, checksum): SHA-256 over length-prefixed values in order; null has a flag of its own."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        h = hashlib.sha256()
        for v in p.sort_values(order, kind="stable")[value]:
            b = b"" if v is None else v.encode()
            h.update(b"\x00" if v is None else b"\x01" + len(b).to_bytes(8, "big") + b)
        return pd.DataFrame([[p[by].iloc[0], h.hexdigest()]], columns=[by, "checksum"])

    return df.select(by, order, value).groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, checksum string")


def stable_batches(df: DataFrame, by: str, ts: str, quiet_ms: int = 500) -> DataFrame:
    """(by, generation, first_ts, last_ts, n): batch twin of debouncing: a gap of quiet_ms or more ends a generation."""
    w = Window.partitionBy(by).orderBy(ts)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) >= quiet_ms * 1000
    marked = df.select(by, ts, F.coalesce(gap, F.lit(False)).cast("int").alias("new"))
    numbered = marked.withColumn("generation", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(by, "generation").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def resolved_aliases(df: DataFrame, hops: int = 8) -> DataFrame:
    """(alias, target, hops): alias chains followed to their end; a cycle and a chain of more than `hops` steps are errors."""
    step = df.select(F.col("alias").alias("_from"), F.col("target").alias("_to"))
    out = df.select("alias", F.col("target").alias("at"), F.array("alias", "target").alias("seen"))
    for _ in range(hops):
        out = out.join(step, out["at"] == step["_from"], "left")
        again = F.array_contains("seen", F.col("_to"))
        after = F.when(again, F.raise_error(F.concat(F.lit("alias cycle at "), F.col("alias").cast("string")))).otherwise(F.array_append("seen", F.col("_to")))
        out = out.select("alias", F.coalesce("_to", "at").alias("at"), F.when(F.col("_to").isNull(), F.col("seen")).otherwise(after).alias("seen"))
    count = F.size("seen") - 1
    checked = F.when(count > hops, F.raise_error(F.concat(F.lit("alias hop limit at "), F.col("alias").cast("string"))).cast("int")).otherwise(count)
    return out.select("alias", F.col("at").alias("target"), checked.alias("hops"))


def reconciled(mappings: DataFrame, observed: DataFrame) -> DataFrame:
    """(id, path, outcome): match by unique identity first, then by path among what is left; then moved, same, new or missing."""
    unique_m = mappings.where("identity is not null").groupBy("identity").agg(F.min("id").alias("id"), F.min("path").alias("m_path"), F.count("*").alias("n")).where("n = 1").drop("n")
    unique_o = observed.where("identity is not null").groupBy("identity").agg(F.min("path").alias("o_path"), F.count("*").alias("n")).where("n = 1").drop("n")
    first = unique_m.join(unique_o, "identity").select("id", F.col("o_path").alias("path"), F.when(F.col("m_path") == F.col("o_path"), "same").otherwise("moved").alias("outcome"))
    left_m = mappings.join(first.select("id"), "id", "left_anti").select("id", F.col("path").alias("m"))
    left_o = observed.join(first.select("path"), "path", "left_anti").select(F.col("path").alias("o"))
    second = left_m.join(left_o, F.col("m") == F.col("o"), "full").select("id", F.coalesce("o", "m").alias("path"), F.when(F.col("id").isNull(), "new").when(F.col("o").isNull(), "missing").otherwise("same").alias("outcome"))
    return first.unionByName(second)
