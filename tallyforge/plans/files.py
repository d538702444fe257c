"""Queries through files: rows that a sink wrote and a reader took back, beside the SQL of the rows themselves.

The files lie in a folder of their own for each run, under the folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.plans import bindings as b
from tallyforge.plans.registry import QUERIES, SQL, query, table
from tallyforge.session import work_path
from tallyforge.sources import readers, writers


def reread(rows: DataFrame, write: Callable[[DataFrame, str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    path = work_path(rows.sparkSession, "files")
    write(rows, path)
    return read(path)


def as_json(rows: DataFrame, write: Callable[[DataFrame, str], None]) -> DataFrame:
    return reread(rows, write, rows.sparkSession.read.schema(rows.schema).json)


@query("s11_trace_event_files", SQL["p4_trace_events"])
def s11(spark, sf):
    return as_json(QUERIES["p4_trace_events"](spark, sf), writers.write_trace_events)


@query("s12_csv_files", SQL["p3_csv_rows"])
def s12(spark, sf):
    rows = QUERIES["p3_csv_rows"](spark, sf)
    return reread(rows, writers.write_csv, spark.read.schema(rows.schema).option("header", True).csv)


@query("s10_s14_invariant_files", """
WITH r AS (SELECT event_type AS hypothesis, CAST(user_id % 7 AS INTEGER) AS precondition, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k FROM events)
SELECT hypothesis, precondition, precondition % 2 = 1 AS inverted, 'attributes.k5' AS field, CASE WHEN count(DISTINCT k) = 1 THEN 'constant' ELSE 'exist' END AS clause,
  coalesce(string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)), '') AS value_list
FROM r GROUP BY hypothesis, precondition""")
def s14(spark, sf):
    seen = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("hypothesis"), (F.col("user_id") % 7).cast("int").alias("precondition")).agg(
        F.array_sort(F.collect_set((b.prop_k() % 5).cast("string"))).alias("values"))  # at most five values
    clauses = seen.select("hypothesis", "precondition", (F.col("precondition") % 2 == 1).alias("inverted"), F.lit("attributes.k5").alias("field"),
                          F.when(F.size("values") == 1, "constant").otherwise("exist").alias("clause"), "values")
    found = reread(clauses, writers.write_invariants, lambda path: readers.read_invariants(spark, path))
    return found.select("hypothesis", "precondition", "inverted", "field", "clause", F.array_join("values", ",").alias("value_list"))


@query("s15_s16_check_result_files", f"""
SELECT relation || ':' || rule AS hypothesis, outcome, CAST(violation AS VARCHAR) AS violation, violation_time FROM ({SQL["i27_all_relations"]})""")
def s15(spark, sf):
    results = QUERIES["i27_all_relations"](spark, sf).select(
        F.concat("relation", F.lit(":"), "rule").alias("hypothesis"), "outcome", F.col("violation").cast("string").alias("violation"), "violation_time")
    found = reread(results, writers.write_check_results, lambda path: readers.read_check_results(spark, path))
    return found.select("hypothesis", "outcome", "violation", "violation_time")


@query("s17_leak_report_files", SQL["d4_leak_suspects"])
def s17_leaks(spark, sf):
    return as_json(QUERIES["d4_leak_suspects"](spark, sf), writers.write_memory_report)


@query("s17_block_files", SQL["w17_merged_blocks"])
def s17_blocks(spark, sf):
    return as_json(QUERIES["w17_merged_blocks"](spark, sf), writers.write_memory_report)
