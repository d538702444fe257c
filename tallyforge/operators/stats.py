"""Per-process and per-device statistics, histograms and gauges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.pairing import ORDER, match_frees, order_columns
from tallyforge.ordered import framed, large, previous, running

SLOW_CALL_US = 1_000_000
SLOW_CALLS_KEPT = 10
CPUS_PER_NUMA_NODE = 32

# Histogram bounds (seconds; bytes).
DURATION_BOUNDS = [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
ALLOCATION_BOUNDS = [128, 512, 1024, 4096, 16384, 65536, 262144, 1048576, 4194304]

# Transfer direction codes.
COPY_KINDS = {0: "H2H", 1: "H2D", 2: "D2H", 3: "D2D"}


def _count() -> Column:
    return F.count(F.lit(1))


def function_stats(events: DataFrame, calls: DataFrame, slow_us: int = SLOW_CALL_US) -> DataFrame:
    """Calls, active calls and durations per function (A1).

    ``events`` are enter and exit rows with ``function_name``; ``calls`` are their pairs
    from ``pair_latest(..., keep=["function_name"])``. The mean is over all entries, as
    active calls count towards it too.
    """
    entered = events.filter("is_enter").groupBy("function_name").agg(
        _count().alias("call_count"), F.min("t").alias("first_call"))
    done = calls.groupBy(F.col("enter_function_name").alias("function_name")).agg(
        _count().alias("completed"),
        F.sum("duration").alias("total_us"),
        F.min("duration").alias("min_us"),
        F.max("duration").alias("max_us"),
        F.count_if(F.col("duration") > slow_us).alias("slow_calls"),
        F.max("t").alias("last_call"),
    )
    joined = entered.join(done, "function_name", "left")
    return joined.select(
        "function_name", "call_count",
        (F.col("call_count") - F.coalesce("completed", F.lit(0))).alias("active_calls"),
        F.coalesce("total_us", F.lit(0)).alias("total_us"), "min_us", "max_us",
        (F.coalesce("total_us", F.lit(0)) / F.col("call_count")).alias("avg_us"),
        F.coalesce("slow_calls", F.lit(0)).alias("slow_calls"), "first_call", "last_call",
    )


def first_slow_calls(calls: DataFrame, slow_us: int = SLOW_CALL_US, keep: int = SLOW_CALLS_KEPT) -> DataFrame:
    """The first slow calls of each function (A2); the row limit applies before the shuffle."""
    from pyspark.sql import Window

    ranked = Window.partitionBy("enter_function_name").orderBy(*ORDER)
    return (
        calls.filter(F.col("duration") > slow_us)
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= keep)
    )


def cpu_moves(samples: DataFrame, cpus_per_node: int = CPUS_PER_NUMA_NODE, max_rows: int | None = None) -> DataFrame:
    """Samples with ``migrated`` and ``cross_numa`` against the process's sample before."""
    looked = previous(samples, ["pid"], order_columns(), {"_cpu": F.col("cpu_id")}, max_rows)
    node, was = (F.floor(F.col(c) / cpus_per_node) for c in ("cpu_id", "_cpu"))
    return looked.withColumns({
        "migrated": F.coalesce(F.col("_cpu") != F.col("cpu_id"), F.lit(False)),
        "cross_numa": F.coalesce(node != was, F.lit(False)),
    }).drop("_cpu")


def cpu_stats(moves: DataFrame) -> DataFrame:
    """Totals, share on CPU and migrations per process (A3)."""
    on, off = F.sum("oncpu_time"), F.sum("offcpu_time")
    return moves.groupBy("pid").agg(
        on.alias("oncpu_total"), off.alias("offcpu_total"), _count().alias("call_count"),
        F.when(on + off > 0, on / (on + off)).otherwise(0.0).alias("utilization"),
        F.count_if("migrated").alias("migrations"), F.count_if("cross_numa").alias("numa_migrations"),
    )


def core_times(samples: DataFrame) -> DataFrame:
    """Time per core of each process (part of A3)."""
    return samples.groupBy("pid", "cpu_id").agg(F.sum("oncpu_time").alias("oncpu_time"))


def hot_core(times: DataFrame) -> DataFrame:
    """The core with most time and its share; the lowest core number wins a tie (A4)."""
    return times.groupBy("pid").agg(
        F.max_by("cpu_id", F.struct("oncpu_time", -F.col("cpu_id"))).alias("hotspot_cpu"),
        (F.max("oncpu_time") / F.sum("oncpu_time")).alias("hotspot_share"),
    )


def io_stats(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes, operations and latency by direction, per process (A5) or device."""
    def of(write: bool, value: Column) -> Column:
        return F.when(F.col("is_write") == write, value)

    return events.groupBy(*keys).agg(
        F.sum("bytes").alias("total_bytes"),
        F.coalesce(F.sum(of(False, F.col("bytes"))), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum(of(True, F.col("bytes"))), F.lit(0)).alias("write_bytes"),
        F.count(of(False, F.lit(1))).alias("read_ops"),
        F.count(of(True, F.lit(1))).alias("write_ops"),
        F.avg(of(False, F.col("latency_us"))).alias("avg_read_us"),
        F.avg(of(True, F.col("latency_us"))).alias("avg_write_us"),
        F.avg("latency_us").alias("avg_us"),
        F.max("latency_us").alias("max_us"),
    )


def device_access(events: DataFrame) -> DataFrame:
    """How often a process reached each device (part of A5)."""
    return events.groupBy("pid", "major", "minor").agg(_count().alias("accesses"))


def memory_timeline(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Every event with ``current`` and ``peak`` bytes of its process after it.

    A free takes the size of its allocation where known, else its own; the level never
    goes under zero. Clamping at zero equals the running sum less the lowest value, if
    negative, that the sum has had so far.
    """
    counted = large(events.select("pid"), ["pid"], max_rows)
    # where no process is large, none of its addresses is: dealt by process once, the rows serve every window below
    matched = match_frees(events, max_rows) if counted.hot is not None else match_frees(events.repartition("pid"), max_rows, counted)
    delta = F.when(F.col("is_alloc"), F.col("size")).otherwise(-F.coalesce("matched_size", "size"))
    summed = running(matched, ["pid"], order_columns(), {"_sum": ("sum", delta)}, max_rows, counted)
    floored = running(summed, ["pid"], order_columns(), {"_low": ("min", F.col("_sum"))}, max_rows, counted)
    level = floored.withColumn("current", F.col("_sum") - F.least(F.col("_low"), F.lit(0)))
    return running(level, ["pid"], order_columns(), {"peak": ("max", F.col("current"))}, max_rows, counted).drop("_sum", "_low")


def memory_stats(timeline: DataFrame) -> DataFrame:
    """Allocated, freed, current and peak bytes per process."""
    return timeline.groupBy("pid").agg(
        F.coalesce(F.sum(F.when(F.col("is_alloc"), F.col("size"))), F.lit(0)).alias("total_allocs"),
        F.coalesce(F.sum(F.when(~F.col("is_alloc"), F.col("size"))), F.lit(0)).alias("total_frees"),
        F.max_by("current", F.struct(*ORDER)).alias("current"),
        F.max("peak").alias("peak"),
    )


def fleet_memory(stats: DataFrame) -> DataFrame:
    """Totals over all processes."""
    return stats.agg(*[F.sum(c).alias(c) for c in ("current", "peak", "total_allocs", "total_frees")])


def net_stats(events: DataFrame, exact: bool = True) -> DataFrame:
    """Bytes, packets, distinct connections and listening ports per process."""
    def of(send: bool, value: Column) -> Column:
        return F.when(F.col("is_send") == send, value)

    distinct = F.count_distinct if exact else F.approx_count_distinct
    listening = F.when((F.col("dst_port") == 0) & (F.col("src_port") > 0), F.col("src_port"))
    return events.groupBy("pid").agg(
        F.coalesce(F.sum(of(True, F.col("bytes"))), F.lit(0)).alias("tx_bytes"),
        F.coalesce(F.sum(of(False, F.col("bytes"))), F.lit(0)).alias("rx_bytes"),
        F.count(of(True, F.lit(1))).alias("tx_packets"),
        F.count(of(False, F.lit(1))).alias("rx_packets"),
        distinct(F.col("connection")).alias("connections"),
        distinct(listening).alias("listening_ports"),
    )


def call_times(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and mean time of paired calls."""
    return calls.groupBy(*keys).agg(_count().alias("calls"), F.avg("duration").alias("avg_time"))


def fence_stats(fences: DataFrame, wait_end: str) -> tuple[DataFrame, DataFrame]:
    """Fence counts by type, and total and longest wait of a process."""
    counts = fences.groupBy("tgid", "fence_type").agg(_count().alias("fences"))
    ended = F.when((F.col("fence_type") == wait_end) & (F.col("duration") > 0), F.col("duration"))
    waits = fences.groupBy("tgid").agg(
        F.coalesce(F.sum(ended), F.lit(0)).alias("total_wait"), F.coalesce(F.max(ended), F.lit(0)).alias("max_wait"))
    return counts, waits


def link_stats(calls: DataFrame, unsized: Sequence[str] = ("strcpy",)) -> DataFrame:
    """Calls, mean time and bytes per function; unsized functions carry no byte count."""
    sized = F.when(~F.col("func").isin(*unsized), F.col("size"))
    return calls.groupBy("tgid", "func").agg(
        _count().alias("calls"), F.avg("duration").alias("avg_time"), F.coalesce(F.sum(sized), F.lit(0)).alias("bytes"))


def verb_counts(events: DataFrame) -> DataFrame:
    """Finished verb calls per process."""
    return events.filter(~F.col("is_enter")).groupBy("tgid", "func").agg(_count().alias("calls"))


def launch_counts(launches: DataFrame) -> DataFrame:
    """Launches per kernel."""
    return launches.groupBy("pid", "kernel").agg(_count().alias("launches"))


def copy_bandwidth(copies: DataFrame) -> DataFrame:
    """Copies with ``kind_name`` and ``mb_per_s``; zero where no time passed."""
    kinds = F.lit("DEFAULT")
    for code, name in COPY_KINDS.items():
        kinds = F.when(F.col("kind") == code, name).otherwise(kinds)
    seconds = (F.col("end_ns") - F.col("start_ns")) / 1e9
    rate = F.when(seconds > 0, F.col("bytes") / (1024.0 * 1024.0) / seconds).otherwise(0.0)
    return copies.withColumns({"kind_name": kinds, "mb_per_s": rate})


def live_bytes(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    """GPU bytes live in a process after each event (A16). Unknown frees count as zero."""
    matched = match_frees(events, max_rows)
    delta = F.when(F.col("is_alloc"), F.col("size")).otherwise(-F.coalesce("matched_size", F.lit(0)))
    return running(matched, ["pid"], order_columns(), {"live_bytes": ("sum", delta)}, max_rows)


def latest_gauges(rows: DataFrame, labels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Last written value per label set."""
    at = F.struct(*ORDER)
    return rows.groupBy(*labels).agg(*[F.max_by(v, at).alias(v) for v in values])


def histogram(rows: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound, one row per key and bound."""
    counted = rows.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], _count().alias("inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return counted.select(*keys, F.inline(F.array(*pairs)).alias("le", "n"))


def active_functions(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Functions active in a process after each event, never under zero."""
    step = F.when(F.col("is_enter"), 1).otherwise(-1).cast("long")
    counted = large(events, ["tgid"], max_rows)
    summed = running(events, ["tgid"], order_columns(), {"_sum": ("sum", step)}, max_rows, counted)
    floored = running(summed, ["tgid"], order_columns(), {"_low": ("min", F.col("_sum"))}, max_rows, counted)
    return floored.withColumn("active", F.col("_sum") - F.least(F.col("_low"), F.lit(0))).drop("_sum", "_low")


def ingest_totals(records: DataFrame) -> DataFrame:
    """Records received per type."""
    return records.groupBy("type").agg(_count().alias("traces"))


def batch_sizes(records: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Histogram of batch sizes per type."""
    sizes = records.groupBy("batch", "type").agg(_count().alias("size"))
    return histogram(sizes, ["type"], "size", bounds)


def active_clients(records: DataFrame) -> DataFrame:
    """Distinct clients."""
    return records.agg(F.count_distinct("client").alias("clients"))


LARGE_BLOCK = 500 * 1024 * 1024
MEDIUM_BLOCK = 50 * 1024 * 1024


def block_stats(blocks: DataFrame, large: int = LARGE_BLOCK, medium: int = MEDIUM_BLOCK) -> DataFrame:
    """Count, sizes, address range and size classes of allocated blocks."""
    size = F.col("size")
    return blocks.agg(
        _count().alias("blocks"), F.sum(size).alias("total"), F.avg(size).alias("mean"),
        F.min(size).alias("smallest"), F.max(size).alias("largest"),
        F.min("address").alias("low_address"), (F.max("address") + F.max(size)).alias("high_address"),
        F.count_if(size > large).alias("large"), F.count_if((size >= medium) & (size <= large)).alias("medium"),
        F.count_if(size < medium).alias("small"),
    )


def size_histogram(blocks: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of block sizes; the last bin holds its upper edge."""
    span = blocks.agg(F.min("size").alias("low"), F.max("size").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    bin_no = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("size") - F.col("low")) / width), F.lit(bins - 1)))
    return (
        blocks.select("size").join(F.broadcast(span))  # one row
        .groupBy(bin_no.cast("int").alias("bin"), (F.col("low") + bin_no * width).alias("bin_start"))
        .agg(_count().alias("n"))
    )


def connection_table(events: DataFrame) -> DataFrame:
    """Distinct endpoints per process."""
    return events.select("pid", "source", "destination", "protocol", "connection").distinct()


def array_summary(rows: DataFrame, array: str) -> DataFrame:
    """Minimum, maximum, mean, sample deviation and length of an array column."""
    x = F.transform(array, lambda v: v.cast("double"))
    n = F.size(array)
    rows = rows.withColumn("_x", x).withColumn(
        "mean", F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / n)
    squares = F.aggregate("_x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    return rows.withColumns({
        "min": F.array_min("_x"), "max": F.array_max("_x"),
        "std": F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0), "length": n,
    }).drop("_x")


def sampled_deltas(rows: DataFrame, keys: Sequence[str], totals: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Growth of running totals since the row before; a total that fell counts as zero."""
    looked = previous(rows, keys, order_columns(), {f"_{c}": F.col(c) for c in totals}, max_rows)
    grown = {f"{c}_delta": F.greatest(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)) for c in totals}
    return looked.withColumns(grown).drop(*[f"_{c}" for c in totals])


def trailing_mean(rows: DataFrame, keys: Sequence[str], value: str, name: str, points: int,
                  max_rows: int | None = None) -> DataFrame:
    """Mean over the last ``points`` rows and how many there were."""
    def add(part: DataFrame, window) -> DataFrame:
        frame = window.rowsBetween(1 - points, 0)
        return part.withColumns({name: F.avg(value).over(frame), f"{name}_rows": F.count(value).over(frame)})

    return framed(rows, keys, order_columns(), add, before=points - 1, max_rows=max_rows)
