"""Shards of near-equal bytes: a minimax contiguous partition of ordered atomic groups.

Rows of one text form a group that no shard may split. Groups stand in the order of their digest; a
contiguous run of groups is a shard. The smallest capacity with which a greedy walk needs no more than
the wanted number of shards is found by search over the capacity, and the cuts of that walk are the
shards. The walk looks up its next cut in the table of running sizes, for many capacities in one job, so
nothing but cuts reaches the driver.

Running sizes and slots come from one order over all rows, dealt by ranges of (digest, id, ...): a hot text
spreads over many tasks, and only one total for each range is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.llm.common import parts, work_folder, written

TRIES = 64


def numbered(rows: DataFrame, order: list[str] | list[Column], size: str, folder: str) -> DataFrame:
    """`rows` with row_at (from 1) and size_at: running count and running `size` over the whole order.

    Rows equal in all of `order` take any turn among themselves. The broadcast side has one row for
    each range partition, as many as spark.sql.shuffle.partitions.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, f"{folder}/ordered")
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                           F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (dealt.withColumn("n_in", F.count("*").over(inside)).withColumn("s_in", F.sum(size).over(inside))
            .join(F.broadcast(starts), "part")
            .withColumn("row_at", F.col("n_before") + F.col("n_in")).withColumn("size_at", F.col("s_before") + F.col("s_in"))
            .drop("part", "n_in", "s_in", "n_before", "s_before"))


def _cuts(ends: DataFrame, shards: int, capacities: list[int]) -> list[list[int]]:
    """For each capacity the running size at which each greedy shard ends. One job finds a cut for all capacities."""
    at = [0] * len(capacities)
    walks: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        reach = [start + capacity for start, capacity in zip(at, capacities, strict=True)]
        found = ends.where((F.col("size_at") > min(at)) & (F.col("size_at") <= max(reach))).agg(
            *[F.max(F.when(F.col("size_at") <= r, F.col("size_at"))).alias(f"c{i}") for i, r in enumerate(reach)]).first()
        at = [max(a, found[i] or 0) for i, a in enumerate(at)]
        for walk, cut in zip(walks, at, strict=True):
            walk.append(cut)
    return walks


def minimax_cuts(ends: DataFrame, shards: int, tries: int = TRIES) -> list[int]:
    """Running sizes at which the shards end, for the smallest feasible capacity.

    `ends` has one row for each group in order: size_at (running size at its end) and group_bytes. A capacity is
    feasible if the greedy walk reaches the total. The search keeps an infeasible and a feasible capacity
    and tries `tries` capacities between them at a time; the greedy optimum lies under mean + largest group.
    """
    total, largest = ends.agg(F.max("size_at"), F.max("group_bytes")).first()
    if total is None:
        return [0] * shards
    low, high = max(-(-total // shards), largest) - 1, -(-total // shards) + largest
    best = None
    while best is None or high - low > 1:
        step = max(1, (high - low) // (tries + 1))
        capacities = sorted({min(high, low + step * (i + 1)) for i in range(tries)} | {high})
        walks = _cuts(ends, shards, capacities)
        fit = next(i for i, walk in enumerate(walks) if walk[-1] == total)
        best, high = walks[fit], capacities[fit]
        low = capacities[fit - 1] if fit else low
    return best


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, text: str = "text", id_: str = "doc_id", tries: int = TRIES) -> DataFrame:
    """One row for each row of `docs`: its id, size (UTF-8 bytes plus 1), text_crc32, shard and slot in the shard.

    Rows of equal text share a shard. Null text is a text of its own with no bytes (size 1, the checksum of the
    empty text, in one group with empty texts). Slots run from 0 without gaps; repeated rows get a slot each. A group
    larger than the mean shard makes the capacity its own size. Fewer groups than shards leave the last
    shards empty; an empty table gives no rows. Other columns of `docs` play no part.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "sharding")
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id_].alias("id"), (F.octet_length(body).cast("long") + 1).alias("size"),
                       F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("digest"))
    rows = written(rows, f"{folder}/sizes")
    placed = written(numbered(rows, ["digest", "id"], "size", folder), f"{folder}/placed")
    groups = placed.groupBy("digest").agg(F.max("size_at").alias("size_at"), F.sum("size").alias("group_bytes"),
                                          F.max("row_at").alias("row_at"))
    groups = written(groups.repartitionByRange(parts(spark), "size_at").sortWithinPartitions("size_at"), f"{folder}/groups")
    cuts = minimax_cuts(groups, shards, tries)
    inner = sorted(set(cuts[:-1]))  # at most shards - 1 numbers
    ended = {r["size_at"]: r["row_at"] for r in groups.where(F.col("size_at").isin(inner)).select("size_at", "row_at").collect()} if inner else {}
    starts = [(0, 0)] + [(cut, ended.get(cut, 0)) for cut in cuts[:-1]]
    shard, first = F.lit(0), F.lit(0).cast("long")
    for number, (cut, rows_before) in enumerate(starts):
        if number and cut > starts[number - 1][0]:
            shard = F.when(F.col("size_at") > cut, number).otherwise(shard)
            first = F.when(F.col("size_at") > cut, rows_before).otherwise(first)
    return placed.select(F.col("id").alias(id_), "size", "text_crc32", shard.cast("int").alias("shard"),
                         (F.col("row_at") - 1 - first).alias("slot"))
