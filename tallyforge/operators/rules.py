"""Threshold rules over resource events. Each rule gives one row per hit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.pairing import order_columns
from tallyforge.operators.stats import trailing_mean
from tallyforge.ordered import framed, numbered, previous, running
from tallyforge.session import cut_lineage

# Limits of the rules.
CPU_BURST = 50.0            # percent, and over twice the recent mean
CPU_HOT_CORE = 0.8          # share of time on one core
CPU_HOT_CORE_MIN_ON = 100_000_000_000
CPU_NUMA_MOVES = 10
CPU_SWITCH_RATE = 0.5
CPU_STARVED = 0.05
CPU_STARVED_MIN_CALLS = 20
CPU_STARVED_MIN_ON = 500_000
IO_SLOW_US = 100_000
IO_LARGE_BYTES = 10 * 1024 * 1024
IO_SPIKE_MIN_US = 10_000
IO_WARMUP_OPS = 10
MEMORY_LARGE_BYTES = 500 * 1024 * 1024
NET_LARGE_BYTES = 10 * 1024 * 1024
NET_CONNECTIONS = 100
NET_GAP_VARIANCE = 0.8
NET_HISTORY = 100
HISTORY = 10


def cpu_bursts(samples: DataFrame, limit: float = CPU_BURST, max_rows: int | None = None) -> DataFrame:
    """Samples over twice the mean of the last ten and over the limit."""
    seen = trailing_mean(samples, ["pid"], "utilization", "recent_mean", HISTORY, max_rows)
    return seen.filter(
        (F.col("recent_mean_rows") == HISTORY)
        & (F.col("utilization") > 2 * F.col("recent_mean")) & (F.col("utilization") > limit)
    ).drop("recent_mean_rows")


def io_spikes(events: DataFrame, min_us: int = IO_SPIKE_MIN_US, max_rows: int | None = None) -> DataFrame:
    """Latencies over three times the mean of the last ten and over the floor."""
    seen = trailing_mean(events, ["pid"], "latency_us", "recent_mean", HISTORY, max_rows)
    return seen.filter(
        (F.col("recent_mean_rows") == HISTORY)
        & (F.col("latency_us") > 3 * F.col("recent_mean")) & (F.col("latency_us") > min_us)
    ).drop("recent_mean_rows")


def memory_trend(timeline: DataFrame, points: int = 20, step: float = 0.05, max_rows: int | None = None) -> DataFrame:
    """Rising, falling and steady steps among the last ``points`` samples.

    A row comes for every sample that has ``points`` samples up to and with itself.
    """
    def add(rows: DataFrame, window) -> DataFrame:
        before = F.lag("current").over(window)
        kind = (F.when(F.col("current") > before * (1 + step), "up")
                .when(F.col("current") < before * (1 - step), "down").otherwise("flat"))
        rows = rows.withColumn("_kind", F.when(before.isNotNull(), kind))
        steps = window.rowsBetween(2 - points, 0)
        samples = window.rowsBetween(1 - points, 0)
        counts = {name: F.count(F.when(F.col("_kind") == name, 1)).over(steps) for name in ("up", "down", "flat")}
        return rows.withColumns({**counts, "_n": F.count(F.lit(1)).over(samples)}).drop("_kind")

    seen = framed(timeline, ["pid"], order_columns(), add, before=points, max_rows=max_rows)
    return seen.filter(F.col("_n") == points).drop("_n")


def traffic_bursts(events: DataFrame, limit: float = NET_GAP_VARIANCE, history: int = NET_HISTORY,
                   max_rows: int | None = None) -> DataFrame:
    """Packets where the gaps within the last ``history`` packets of their direction vary
    by more than the limit, once both directions have over ten packets (W9). Gaps in seconds."""
    totals = running(events, ["pid"], order_columns(), {
        "_sent": ("sum", F.when(F.col("is_send"), 1).otherwise(0).cast("long")),
        "_received": ("sum", F.when(F.col("is_send"), 0).otherwise(1).cast("long")),
    }, max_rows)

    def add(rows: DataFrame, window) -> DataFrame:
        gap = (F.col("t") - F.lag("t").over(window)) / 1e6
        rows = rows.withColumn("_gap", gap)
        return rows.withColumn("gap_variance", F.var_pop("_gap").over(window.rowsBetween(2 - history, 0))).drop("_gap")

    seen = framed(totals, ["pid", "is_send"], order_columns(), add, before=history, max_rows=max_rows)
    ready = (F.col("_sent") > HISTORY) & (F.col("_received") > HISTORY)
    return seen.filter(ready & (F.col("gap_variance") > limit)).drop("_sent", "_received")


def _hits(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def cpu_rules(stats: DataFrame, hot: DataFrame, bursts: DataFrame, hot_min_on: int = CPU_HOT_CORE_MIN_ON,
              starved: float = CPU_STARVED) -> DataFrame:
    """Processes that break a CPU rule, with the value that broke it."""
    cores = stats.join(hot, "pid").filter(
        (F.col("hotspot_share") > CPU_HOT_CORE) & (F.col("oncpu_total") > hot_min_on))
    rate = F.col("migrations") / F.col("call_count")
    return _hits([
        cores.select("pid", F.lit("hot_core").alias("rule"), F.col("hotspot_share").alias("value")),
        stats.filter(F.col("numa_migrations") >= CPU_NUMA_MOVES)
        .select("pid", F.lit("numa_moves").alias("rule"), F.col("numa_migrations").cast("double").alias("value")),
        bursts.groupBy("pid").agg(F.max("utilization").alias("value"))
        .select("pid", F.lit("burst").alias("rule"), "value"),
        stats.filter(rate > CPU_SWITCH_RATE).select("pid", F.lit("switch_rate").alias("rule"), rate.alias("value")),
        stats.filter((F.col("call_count") > CPU_STARVED_MIN_CALLS) & (F.col("utilization") < starved)
                     & (F.col("oncpu_total") > CPU_STARVED_MIN_ON))
        .select("pid", F.lit("starved").alias("rule"), F.col("utilization").alias("value")),
    ])


def io_rules(events: DataFrame, slow_us: int = IO_SLOW_US, large: int = IO_LARGE_BYTES,
             spike_min_us: int = IO_SPIKE_MIN_US, max_rows: int | None = None) -> DataFrame:
    """Slow, large and spiking transfers, after the first ten of a process.

    A large transfer is not tested for a spike.
    """
    seen = numbered(events, ["pid"], order_columns(), "_op", max_rows)
    seen = trailing_mean(seen, ["pid"], "latency_us", "_mean", HISTORY, max_rows).filter(F.col("_op") > IO_WARMUP_OPS)
    latency, big = F.col("latency_us"), F.col("bytes") > large
    spike = ~big & (F.col("_mean_rows") == HISTORY) & (latency > 3 * F.col("_mean")) & (latency > spike_min_us)
    rules = F.array_compact(F.array(
        F.when(latency > slow_us, "slow"), F.when(big, "large"), F.when(spike, "spike")))
    return seen.withColumn("rule", F.explode(rules)).drop("_op", "_mean", "_mean_rows")


def large_allocations(events: DataFrame, limit: int = MEMORY_LARGE_BYTES) -> DataFrame:
    """Allocations at or over the limit."""
    return events.filter(F.col("is_alloc") & (F.col("size") >= limit))


def net_rules(stats: DataFrame, bursts: DataFrame, large: int = NET_LARGE_BYTES,
              connections: int = NET_CONNECTIONS) -> DataFrame:
    """Processes that break a network rule."""
    def over(column: str, limit: int, rule: str) -> DataFrame:
        return stats.filter(F.col(column) > limit).select(
            "pid", F.lit(rule).alias("rule"), F.col(column).cast("double").alias("value"))

    burst = bursts.groupBy("pid", "is_send").agg(F.max("gap_variance").alias("value")).select(
        "pid", F.when(F.col("is_send"), "send_burst").otherwise("receive_burst").alias("rule"), "value")
    return _hits([over("tx_bytes", large, "large_send"), over("rx_bytes", large, "large_receive"),
                  over("connections", connections, "connections"), burst])


def busiest(stats: DataFrame, by: str, n: int = 5, tie: str = "pid") -> DataFrame:
    """The top ``n`` rows (T2, T3, T4). The order runs as a top-n, not a full sort."""
    return stats.orderBy(F.desc(by), tie).limit(n)


def one_per_slot(rows: DataFrame, keys: list[str], slot_us: int) -> DataFrame:
    """The first row of each time slot (R2, R3): an upper bound of one row per interval."""
    names = [c for c in rows.columns if c not in keys]
    slot = F.floor(F.col("t") / slot_us).alias("slot")
    first = F.min_by(F.struct(*names), F.struct("t", "seq"))
    return rows.groupBy(*keys, slot).agg(first.alias("first")).select(*keys, "slot", "first.*")


def once_per_interval(rows: DataFrame, keys: list[str], interval_us: int, max_rows: int | None = None) -> DataFrame:
    """Rows as a clock lets them pass that opens ``interval_us`` after the last one it let pass.

    The first row of a key passes, then the first at or after its time plus the interval, and so on; without keys there
    is one clock for all rows. Each row's successor is found by one ordered pass, and the rows on the way from the first
    are marked by doubling: after n rounds all within 2^n steps are, so no task walks a key.
    """
    names = rows.columns
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    nodes = cut_lineage(rows.groupBy(key.alias("_key"), "t").agg(F.min_by(F.struct(*names), "seq").alias("_row")))
    at = nodes.select("_key", "t", F.col("t").alias("_at"), F.lit(True).alias("_node")).unionByName(
        nodes.select("_key", "t", (F.col("t") + interval_us).alias("_at"), F.lit(False).alias("_node")))
    # backwards in time, nodes before those that ask at the same time, the last node seen is the first at or after
    looked = running(at, ["_key"], [-F.col("_at"), ~F.col("_node"), -F.col("t")],
                     {"_next": ("last", F.when(F.col("_node"), F.col("_at")))}, max_rows)
    jump = cut_lineage(looked.filter(~F.col("_node")).select("_key", "t", "_next").filter("_next is not null"))
    passed = cut_lineage(nodes.groupBy("_key").agg(F.min("t").alias("t")))
    while True:
        further = cut_lineage(passed.join(jump, ["_key", "t"]).select("_key", F.col("_next").alias("t")))
        if further.isEmpty():
            break
        passed = passed.unionByName(further)
        ahead = jump.select("_key", F.col("t").alias("_next"), F.col("_next").alias("_after"))
        jump = cut_lineage(jump.join(ahead, ["_key", "_next"]).select("_key", "t", F.col("_after").alias("_next")))
    return nodes.join(passed, ["_key", "t"]).select("_row.*")


def report_every(events: DataFrame, n: int, keys: Sequence[str], value: str, max_rows: int | None = None) -> DataFrame:
    """The state of a key's counters at each ``n``-th of its events (R6): keys, t, events, total.

    Events count in the order of t and seq; a null value adds nothing. A key with under ``n`` events has no report.
    ``streaming.stateful.reports_every`` does the same on a stream.
    """
    counted = running(events.select(*keys, "t", "seq", value), keys, [F.col("t"), F.col("seq")], {
        "events": ("sum", F.lit(1).cast("long")), "total": ("sum", F.col(value))}, max_rows)
    return counted.filter(F.col("events") % n == 0).select(*keys, "t", "events", F.coalesce("total", F.lit(0)).alias("total"))
