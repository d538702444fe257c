"""Readers of the text and JSON files of telemetry, memory maps, traces and sessions.

Each ``parse_*`` works on a table of texts (column ``value``), each ``read_*`` on files.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.ordered import numbered, running
from tallyforge.session import cut_lineage

NESTED_FIELDS = ("args", "kwargs", "return_values")
SNAPSHOT_RULE = "-" * 50
SESSION_SCHEMA = "session_id string, timestamp string, step_type string, content string, metadata map<string,string>"
RESULT_SCHEMA = "hypothesis string, outcome string, violation string, violation_time long"
CLAUSE_SCHEMA = "hypothesis string, precondition int, inverted boolean, field string, clause string, values array<string>"


# --- tables --------------------------------------------------------------------------

def read_metrics(spark: SparkSession, path: str, skip_rows: int = 0, columns: Sequence[str] | None = None,
                 skip_columns: int = 0, max_rows: int | None = None) -> DataFrame:
    """Metric CSVs as series, t, metric, value (S2, M27). The file name is the series and
    the line order is t; rows and leading columns can be left out."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = [c for c in (columns or raw.columns[skip_columns:])]
    # Rows keep their order inside a split, and splits of a file are ordered by their offset.
    placed = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1).alias("series"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    ordered = numbered(placed, ["series"], [F.col("_block"), F.col("_row")], "t", max_rows)
    ordered = ordered.withColumn("t", F.col("t") - 1 - skip_rows).filter("t >= 0").drop("_block", "_row")
    return ordered.unpivot(["series", "t"], names, "metric", "value")


def flattened(df: DataFrame, separator: str = ".", keep: Sequence[str] = NESTED_FIELDS) -> DataFrame:
    """Every struct field as a column named by its path; ``keep`` stay nested."""
    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> list:
        out = []
        for field in schema.fields:
            path = (*prefix, field.name)
            if isinstance(field.dataType, T.StructType) and field.name not in keep:
                out += walk(field.dataType, path)
            else:
                # A kept field takes its bare name, wherever it was nested.
                name = field.name if field.name in keep else separator.join(path)
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(name))
        return out

    return df.select(*walk(df.schema, ()))


def trace_records(lines: DataFrame) -> DataFrame:
    """Texts (column ``value``) as ``record``, a VARIANT that holds whatever fields and types a line has (S3).

    No schema is needed or inferred. A blank line has no record; one that is no JSON has a null record.
    """
    return lines.filter(F.trim("value") != "").select(F.try_parse_json("value").alias("record"))


def trace_fields(records: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Typed columns out of records: name -> (path, type). A value of another type gives null (S3)."""
    return records.select(*[F.try_variant_get("record", path, kind).alias(name) for name, (path, kind) in fields.items()])


def trace_paths(records: DataFrame, keep: Sequence[str] = NESTED_FIELDS, separator: str = ".") -> DataFrame:
    """The merged path table: path, type, records with it. A path with values of several types has a row for each.

    Objects are opened level by level; those under a name of ``keep`` and arrays stay closed.
    """
    spark = records.sparkSession
    kind = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)

    def typed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("type", F.when(kind == "DECIMAL", "DOUBLE").otherwise(kind))

    level = typed(records.filter("record is not null").select(F.lit(None).cast("string").alias("path"), F.lit(True).alias("opens"), F.col("record").alias("v")))
    out = None
    while True:
        level = cut_lineage(level)
        inner = level.filter((F.col("type") == "OBJECT") & F.col("opens")).select(F.col("path").alias("above"), "v")
        shown = level.filter(~((F.col("type") == "OBJECT") & F.col("opens")) & F.col("path").isNotNull()).groupBy("path", "type").agg(
            F.count(F.lit(1)).alias("records"))
        out = shown if out is None else out.unionByName(shown)
        if inner.isEmpty():
            return out
        entries = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(
            F.col("key").alias("name"), F.col("value").alias("entry")))
        level = typed(entries.select(F.concat_ws(separator, "above", "name").alias("path"), (~F.col("name").isin(*keep)).alias("opens"), F.col("entry").alias("v")))


def merged_schema(records: DataFrame) -> str | None:
    """One schema for all records: a field whose types disagree stays VARIANT, one that is always null is text."""
    found = records.agg(F.schema_of_variant_agg("record")).first()[0]
    if not found.startswith("OBJECT<"):
        return None  # no record, or records that are no objects
    # type names only: what stands in backticks is a field's name
    parts = re.split(r"(`(?:[^`]|``)*`)", found)
    for old, new in ((r"\bOBJECT<", "STRUCT<"), (r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE"), (r"(?<=: )VOID\b|(?<=<)VOID\b", "STRING")):
        parts[::2] = [re.sub(old, new, part) for part in parts[::2]]
    return "".join(parts)


def read_trace(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Training trace JSON lines, flattened (S3).

    Without ``schema`` the records' own types are merged in one distributed pass; a field with conflicting types
    becomes a VARIANT column that holds each value as it was. A trace without any object gives no columns.
    """
    if schema is None:
        schema = merged_schema(trace_records(spark.read.text(path)))
        if schema is None:
            return spark.createDataFrame([], T.StructType([]))
        schema = spark.createDataFrame([], f"row {schema}").schema["row"].dataType
    return flattened(spark.read.schema(schema).json(path))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Reasoning session JSON lines."""
    return spark.read.schema(SESSION_SCHEMA).json(path)


def read_invariants(spark: SparkSession, path: str) -> DataFrame:
    """Invariant files as written by ``write_invariants``."""
    return spark.read.schema(CLAUSE_SCHEMA).json(path)


def json_objects(lines: DataFrame, max_rows: int | None = None) -> DataFrame:
    """file, number, value: the objects of texts in which JSON objects follow each other, over lines or within one.

    ``lines`` has file, at (orders the lines of a file) and value. An object starts on a line before which as many
    brackets were closed as opened; brackets inside strings do not count, and no string crosses a line. The running
    depth is carried over the borders of splits, so an object may lie in several; only its own lines meet in one task.
    """
    # `}{` outside strings is a border within a line
    tokens = F.regexp_extract_all("value", F.lit(r'"(?:\\.|[^"\\])*"|[^"]+'), F.lit(0))
    cut = F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), t).otherwise(F.regexp_replace(t, r"\}\s*\{", "}\n{"))), "")
    parts = lines.select("file", "at", F.posexplode(F.split(cut, "\n")).alias("part", "value")).filter(F.trim("value") != "")
    bare = F.regexp_replace("value", r'"(?:\\.|[^"\\])*"', "")
    depth = F.length(F.regexp_replace(bare, r"[^\{\[]", "")) - F.length(F.regexp_replace(bare, r"[^\}\]]", ""))
    order = [F.col("at"), F.col("part")]
    summed = running(parts.withColumn("_step", depth.cast("long")), ["file"], order, {"_after": ("sum", F.col("_step"))}, max_rows)
    starts = F.when(F.col("_after") - F.col("_step") == 0, 1).otherwise(0).cast("long")
    numbered_ = running(summed.withColumn("_starts", starts), ["file"], order, {"number": ("sum", F.col("_starts"))}, max_rows)
    whole = numbered_.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("at", "part", "value"))).alias("_lines"))
    return whole.select("file", "number", F.array_join(F.transform("_lines", lambda line: line["value"]), "\n").alias("value"))


def read_check_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Checker results (S16): JSON objects one after the other, each on one line or over several; the folder gives the outcome.

    An object that does not parse gives a row of nulls beside its file and number.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path)
    meta = F.col("_metadata")
    at = F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = cut_lineage(text.select(meta["file_path"].alias("file"), at.alias("at"), "value"))
    objects = json_objects(lines).withColumn("_row", F.from_json("value", schema))
    folder = F.nullif(F.regexp_extract("file", r"/outcome=([^/]*)/", 1), F.lit(""))
    return objects.select("file", "number", "_row.*").withColumn("outcome", F.coalesce(folder, F.col("outcome")))


# --- stacks --------------------------------------------------------------------------

def parse_stack_lines(lines: DataFrame) -> DataFrame:
    """EVENT|ts|pid|n|frames... as ts, pid, frame_count, frames from the outermost in."""
    parts = F.split("value", r"\|")
    events = lines.select(parts.alias("p")).filter((F.col("p")[0] == "EVENT") & (F.size("p") >= 4))
    frames = F.filter(F.slice("p", 5, F.size("p")), lambda f: f.contains(":"))
    return events.select(
        F.trim(F.col("p")[1]).cast("long").alias("ts"), F.trim(F.col("p")[2]).cast("long").alias("pid"),
        F.trim(F.col("p")[3]).cast("int").alias("frame_count"), F.reverse(frames).alias("frames"))


def parse_stack_blocks(blocks: DataFrame) -> DataFrame:
    """EVENT ... END blocks, one per row, as ts, pid, frame_count, frames."""
    text = F.col("value")

    def number(name: str):
        return F.regexp_extract(text, rf"(?m)^\s*{name}=(\d+)", 1).try_cast("long")

    frames = F.regexp_extract_all(text, F.lit(r"(?m)^\s*frame(?!s=)\w*=([^:\n]*:[^\n]*)"), F.lit(1))
    return blocks.filter(text.rlike(r"(?m)^\s*EVENT\s*$")).select(
        number("timestamp").alias("ts"), number("pid").alias("pid"), number("frames").cast("int").alias("frame_count"),
        F.transform(frames, lambda f: F.trim(f)).alias("frames"))


def read_stack_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_stack_lines(spark.read.text(path))


def read_stack_blocks(spark: SparkSession, path: str) -> DataFrame:
    return parse_stack_blocks(spark.read.option("lineSep", "\nEND").text(path))


# --- memory maps ---------------------------------------------------------------------

def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """Memory maps, one text per snapshot, as snapshot, address, size, is_oom.

    Addresses are decimals, as they may pass the range of a long.
    """
    found = F.regexp_extract_all("value", F.lit(r"0x([0-9a-fA-F]+),\s*(\d+)"), F.lit(0))
    oom = F.lower(F.regexp_extract("value", r"is_oom\s*:\s*(\w+)", 1)) == "true"
    rows = snapshots.select("snapshot", oom.alias("is_oom"), F.explode(found).alias("_b"))
    return rows.select(
        "snapshot", F.conv(F.regexp_extract("_b", r"0x([0-9a-fA-F]+)", 1), 16, 10).cast("decimal(20,0)").alias("address"),
        F.regexp_extract("_b", r",\s*(\d+)", 1).cast("long").alias("size"), "is_oom")


def read_snapshots(spark: SparkSession, path: str, rule: str = SNAPSHOT_RULE) -> DataFrame:
    """A memory-map log; a dash rule ends a snapshot, numbered along each file."""
    raw = spark.read.option("lineSep", rule).text(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row")).filter(F.trim("value") != "")
    return parse_snapshots(numbered(raw, ["file"], [F.col("_block"), F.col("_row")], "snapshot"))


def parse_allocations(lines: DataFrame) -> DataFrame:
    """``hexaddr, size`` lines as address, size; comments are skipped."""
    parts = F.split(F.trim("value"), ", ")
    rows = lines.filter(~F.trim("value").startswith("#")).select(parts.alias("p")).filter(F.size("p") >= 2)
    return rows.select(
        F.conv(F.regexp_replace(F.trim(F.col("p")[0]), "^0x", ""), 16, 10).cast("decimal(20,0)").alias("address"),
        F.trim(F.col("p")[1]).cast("long").alias("size"))


def read_allocations(spark: SparkSession, path: str) -> DataFrame:
    return parse_allocations(spark.read.text(path))
