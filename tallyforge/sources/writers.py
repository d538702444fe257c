"""Sinks: trace events, CSV, stack lines, invariants, checker results, memory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First lines of a stack file.
STACK_HEADER = ["FORMAT|1.0", "METADATA|", "HEADER|timestamp|pid|frame_count|[frames...]"]


def write_trace_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Trace events of a domain as JSON lines."""
    events.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of a domain as CSV with a header."""
    rows.write.mode(mode).option("header", True).csv(path)


def stack_line(ts: Column, pid: Column, frames: Column) -> Column:
    """EVENT|ts|pid|n|frames...."""
    return F.concat_ws("|", F.lit("EVENT"), ts.cast("string"), pid.cast("string"), F.size(frames).cast("string"), F.concat_ws("|", frames))


def write_stack_lines(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Stack samples as lines, every file behind the three-line header."""
    lines = samples.select(stack_line(F.col("ts"), F.col("pid"), F.col("frames")).alias("value"))

    def with_header(batches):
        first = True
        for batch in batches:
            if first and len(batch):
                import pandas as pd

                yield pd.DataFrame({"value": STACK_HEADER})
                first = False
            yield batch

    lines.mapInPandas(with_header, "value string").write.mode(mode).text(path)


def write_invariants(clauses: DataFrame, path: str, mode: str = "append") -> None:
    """Invariants, or failed hypotheses, as JSON lines."""
    clauses.write.mode(mode).json(path)


def write_check_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Checker results in one folder per outcome."""
    results.write.mode(mode).partitionBy("outcome").json(path)


def write_memory_report(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Leak suspects, or the blocks of a snapshot, as JSON lines."""
    rows.write.mode(mode).json(path)
