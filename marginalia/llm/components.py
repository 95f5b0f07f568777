"""Connected components of an edge list by alternating large-star and small-star steps.

Every step aggregates a minimum for each node (partial aggregation takes care of hubs) and joins it back; no list of
neighbours is ever gathered. Each round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, class): the least node of each node's component; nodes without an edge to another are absent. edges: long a, b."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = _state(e)
    if not last[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("class"))
    for _ in range(rounds):
        # large star: each node's larger neighbours move to the least of its neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: each node's smaller neighbours and itself move to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before, e = e, written(small, name)
        dropped(before)
        now = _state(e)
        if now == last:  # stars already
            return e.select(F.col("u").alias("node"), F.col("v").alias("class")).union(e.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())
