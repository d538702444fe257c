"""Projections of telemetry domains, stack slices, and CPU use between samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.pairing import order_columns
from tallyforge.ordered import previous

# CSV columns of each domain.
CSV_COLUMNS = {
    "cpu": ["ts", "pid", "utilization", "oncpu_time", "offcpu_time", "migrations", "numa_migrations", "hotspot_percentage"],
    "io": ["ts", "pid", "read_bytes", "write_bytes", "read_latency_ms", "write_latency_ms", "read_ops", "write_ops"],
    "memory": ["ts", "pid", "alloc_size", "free_size", "current_usage"],
    "network": ["ts", "pid", "tx_bytes", "rx_bytes", "total_tx_packets", "total_rx_packets", "active_connections"],
    "function": ["ts", "pid", "cookie", "call_count", "avg_duration_us"],
}
DOMAINS = ["function", "gpu", "cpu", "memory", "network", "io"]


def of_process(events: DataFrame, pid: int) -> DataFrame:
    """Events of a process or its children."""
    return events.filter((F.col("pid") == pid) | (F.col("ppid") == pid))


def csv_rows(events: DataFrame, domain: str) -> DataFrame:
    """The CSV columns of a domain."""
    return events.select(*CSV_COLUMNS[domain])


def trace_events(events: DataFrame) -> DataFrame:
    """Begin and end trace events of function records: the process is the thread group."""
    return events.select(
        (F.col("t") / 1000.0).alias("ts"), F.col("tgid").alias("pid"), F.col("pid").alias("tid"),
        F.coalesce("function_name", F.lit("unknown")).alias("name"),
        F.when(F.col("is_enter"), "B").otherwise("E").alias("ph"), "cookie")


def fan_out(records: DataFrame, domains: Sequence[str] = DOMAINS) -> dict[str, DataFrame]:
    """One table per domain of a mixed batch."""
    return {d: records.filter(F.col("domain") == d) for d in domains}


def stack_slices(samples: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Begin and end slices from stack samples of a process (W19). Samples: pid, t, seq, frames
    from the outermost in.

    Against the sample before, frames past the common prefix end, innermost first, and the
    new ones begin; within a sample times count up by one. After the last sample of the
    trace all open frames end.
    """
    looked = previous(samples, ["pid"], order_columns(), {"_old": F.col("frames")}, max_rows)
    old = F.coalesce("_old", F.array().cast("array<string>"))
    shared = F.least(F.size(old), F.size("frames"))
    same = F.when(shared > 0, F.transform(F.sequence(F.lit(1), shared), lambda i: F.element_at(old, i) == F.element_at("frames", i)))
    same = F.coalesce(same, F.array().cast("array<boolean>"))
    first_other = F.array_position(same, False)
    looked = looked.withColumn("_common", F.when(first_other > 0, first_other - 1).otherwise(shared).cast("int"))

    def tail(frames, phase):
        kept = F.slice(frames, F.col("_common") + 1, F.size(frames))
        return F.transform(kept, lambda f, i: F.struct(F.lit(phase).alias("phase"), f.alias("name"), (F.col("_common") + i).alias("depth")))

    slices = F.concat(F.reverse(tail(old, "E")), tail(F.col("frames"), "B"))
    steps = looked.select("pid", "t", F.posexplode(slices).alias("_i", "_s")).select(
        "pid", (F.col("t") + F.col("_i")).alias("ts"), "_s.phase", "_s.name", "_s.depth")
    end = samples.agg((F.max("t") + 1).alias("_end"))  # one row
    still = samples.groupBy("pid").agg(F.max_by("frames", F.struct("t", "seq")).alias("frames")).join(F.broadcast(end))
    depth = F.size("frames")
    closing = still.select("pid", "_end", "frames", F.posexplode(F.reverse("frames")).alias("_i", "name")).select(
        "pid", (F.col("_end") + F.col("_i")).alias("ts"), F.lit("E").alias("phase"), "name", (depth - 1 - F.col("_i")).alias("depth"))
    return steps.unionByName(closing)


def cpu_use(samples: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Time on and off CPU between two samples of a process and its share (W20). Samples: pid,
    t, seq, run_time, period."""
    looked = previous(samples, ["pid"], order_columns(), {"_run": F.col("run_time")}, max_rows).filter("_run is not null")
    on = F.col("run_time") - F.col("_run")
    return looked.withColumns({"oncpu": on, "offcpu": F.col("period") - on, "share": on / F.nullif(F.col("period"), F.lit(0))}).drop("_run")


def call_graph_nodes(lines: DataFrame, depth: int, up_to: bool = False, hidden_functions: bool = False,
                     hidden_modules: bool = False) -> DataFrame:
    """Functions of a call-graph log at a depth, or up to it (P13). Lines have ``value``:
    ``<Node kind:module.function> - depth``."""
    pattern = r"^<Node (function|method):(.*)> - (\d+)"
    parts = lines.filter(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).alias("kind"), F.split(F.regexp_extract("value", pattern, 2), r"\.").alias("_path"),
        F.regexp_extract("value", pattern, 3).cast("int").alias("depth"))
    named = parts.select(
        "kind", F.slice("_path", 1, F.greatest(F.size("_path") - 1, F.lit(0))).alias("_modules"),
        F.element_at("_path", -1).alias("function"), "depth").withColumn("module", F.concat_ws(".", "_modules"))
    keep = (F.col("depth") <= depth) if up_to else (F.col("depth") == depth)
    keep = keep & (F.col("module") != "*")
    if not hidden_functions:
        keep = keep & ~F.col("function").startswith("_")
    if not hidden_modules:
        keep = keep & ~F.exists("_modules", lambda m: m.startswith("_"))
    return named.filter(keep).select("kind", "module", "function", "depth")
