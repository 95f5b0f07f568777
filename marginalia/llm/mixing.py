"""Mixing sources to target weights by Pfair scheduling.

A source is cut into blocks of `block_rows` documents in a seeded random order. With weight w, its block j is
released at slot floor(j / w) and due by slot ceil((j + 1) / w), both from the exact weights. Slots are given out
earliest deadline first among released blocks, which keeps every source within one block of slot * w at all times until
it runs out, however many slots there are. A source that has run out leaves its slots empty; nothing is dropped or
repeated. The schedule is one sequence: one task makes it, in steps of one block, and holds a block of each source only;
the driver gets counts of sources and blocks, never the sources.

Null is a source of its own, named by the empty key in `weights`. Empty tables give an empty result. Repeated rows
stay repeated; rows of one id are ordered by a hash of what they hold, so a task that runs again ranks them alike. Ties
go to the source that sorts first. Weights that are not above zero are errors. Names of extra columns may be any.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD, BLOCK_ROWS = 1024, 16
#: Blocks that the scheduling task hands on at a time.
PLAN_ROWS = 10_000
#: Rows that one task ranks, about.
RANKED_ROWS = 100_000
#: Rows of the tables of range starts and of slots up to which they are broadcast.
BROADCAST_ROWS = 500_000


def shares(targets: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Targets rounded to slots of a period, for a plan that is to repeat: largest remainders, one at least, `period` in all."""
    total = sum(targets.values())
    exact = {s: Fraction(w).limit_denominator(10**9) / Fraction(total).limit_denominator(10**9) * period for s, w in targets.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := period - sum(out.values())) != 0:
        sign = 1 if left > 0 else -1
        order = sorted((s for s in out if sign > 0 or out[s] > 1), key=lambda s: (-sign * (exact[s] - out[s]), s))
        for s in order[: abs(left)]:
            out[s] += sign
    return out


def exact(targets: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of the targets."""
    if any(not 0 < w < math.inf for w in targets.values()):
        raise ValueError("weights must be above zero")
    parts = {s: Fraction(w) for s, w in targets.items()}
    unit = math.lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * unit) for s, x in parts.items()}


def schedule(weights: dict[str, int], blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of all blocks (of one period of sum(weights) slots without `blocks`), earliest deadline
    first among released blocks."""
    total, blocks = sum(weights.values()), weights if blocks is None else blocks
    waiting = [(0, s, 0) for s in sorted(weights) if blocks[s]]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    heapq.heapify(waiting)
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        assert t < deadline, "the weights add up to one, so no deadline is missed"
        yield s, j, t
        t += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))


def mixed(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, temperature: float = 0.5, seed: int = 0) -> DataFrame:
    """df with mix_block, mix_slot, mix_place (place within the slot) and mix_order (the same as one number).

    weights: target weight of each source; those not named, or all without weights, get size ** temperature.
    Columns of the new names are replaced.
    """
    exact(weights or {"": 1.0})  # bad weights are refused at once
    spark = df.sparkSession
    keep = df.drop("mix_block", "mix_slot", "mix_place", "mix_order")
    own_ = "_mix"  # a beginning that no column of df has
    while any(c.lower().startswith(own_) for c in df.columns):
        own_ += "_"
    src, rank, t, h, part, n, before_n, inside_n = (f"{own_}_{x}" for x in ("source", "rank", "t", "h", "range", "n", "before", "in"))
    own = F.coalesce(F.col(source).cast("string"), F.lit(""))
    sizes = df.groupBy(own.alias("s")).agg(F.count("*").alias("n"))
    figures = sizes.agg(F.count("*").alias("sources"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.sum(F.ceil(F.col("n") / F.lit(block_rows))).alias("blocks")).first()
    if not figures.sources:
        return keep.select("*", *[F.lit(None).cast("long").alias(x) for x in ("mix_block", "mix_slot", "mix_place", "mix_order")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: c for b in batches for s, c in zip(b.column("s").to_pylist(), b.column("n").to_pylist(), strict=True)}
        if not held:
            return
        slots = exact({s: (weights or {}).get(s, float(c) ** temperature) for s, c in held.items()})
        for some in itertools.batched(schedule(slots, {s: -(-c // block_rows) for s, c in held.items()}), PLAN_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], [src, "mix_block", t])

    plan = sizes.repartition(1).mapInArrow(run, f"{src} string, mix_block long, {t} long")
    plan = F.broadcast(plan) if figures.blocks <= BROADCAST_ROWS else plan.hint("merge")
    parts = max(1, -(-(figures.most if figures.sources == 1 else figures.rows) // RANKED_ROWS))
    parts = max(parts, spark.sparkContext.defaultParallelism * 4)
    # rank within a source without sending it to one task: rank within hash ranges, plus what earlier ranges hold
    hashed = [c for c, kind in keep.dtypes if not re.search("map<|variant", kind)]
    drawn = keep.select("*", own.alias(src), F.xxhash64(F.lit(seed), F.col(key)).alias(h))
    drawn = drawn.withColumn(part, F.floor((F.col(h) / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    held = drawn.groupBy(src, part).agg(F.count("*").alias(n))
    before = held.select(src, part, (F.sum(n).over(Window.partitionBy(src).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)).alias(before_n))
    inside = F.row_number().over(Window.partitionBy(src, part).orderBy(h, key, F.xxhash64(*hashed)))
    before = F.broadcast(before) if figures.sources * parts <= BROADCAST_ROWS else before
    at = drawn.withColumn(inside_n, inside).join(before, [src, part]).withColumn(rank, F.col(inside_n) + F.col(before_n) - 1)
    at = at.withColumn("mix_block", F.floor(F.col(rank) / block_rows)).withColumn("mix_place", F.col(rank) % block_rows)
    at = at.join(plan, [src, "mix_block"])
    at = at.withColumn("mix_slot", F.col(t)).withColumn("mix_order", F.col("mix_slot") * block_rows + F.col("mix_place"))
    return at.select(*keep.columns, *[F.col(x).cast("long").alias(x) for x in ("mix_block", "mix_slot", "mix_place", "mix_order")])
