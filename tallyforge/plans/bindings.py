"""The given tables seen as telemetry tables, once for Spark and once as SQL.

Each ``*_SQL`` is the text of common table expressions that a SQL twin starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.registry import table


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)
                            if isinstance(column, str) else column)


def day_number(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def long_of(column: str) -> Column:
    return F.floor(column).cast("long")


def prop_k(column: str = "props") -> Column:
    return F.get_json_object(column, "$.k").cast("long")


ENTER = ("view", "click", "signup")


def function_events(spark: SparkSession, sf: str, enter: tuple[str, ...] = ENTER) -> DataFrame:
    """Events of the types in ``enter`` enter a function and all others leave one; four cookies per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("tgid"), F.col("user_id").alias("pid"), (prop_k() % 4).alias("cookie"),
        F.col("event_type").isin(*enter).alias("is_enter"),
        F.concat(F.lit("fn_"), F.floor(prop_k() / 4).cast("string")).alias("function_name"),
        micros("ts").alias("t"), F.col("event_id").alias("seq"), F.col("value"),
    )


def function_events_sql(enter: tuple[str, ...] = ENTER) -> str:
    types = ", ".join(f"'{x}'" for x in enter)
    return f"""fe AS (
  SELECT user_id AS tgid, user_id AS pid, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS cookie,
         event_type IN ({types}) AS is_enter,
         'fn_' || CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 4) AS BIGINT) AS VARCHAR) AS function_name,
         epoch_us(ts) AS t, event_id AS seq, value
  FROM events)"""


def pairs_sql(source: str, keys: str, extra: str = "") -> str:
    """CTE ``calls``: exits paired with the enter just before them in their key."""
    return f"""looked AS (
  SELECT *, lag(is_enter) OVER w AS was_enter, lag(t) OVER w AS start_t,
         lag(function_name) OVER w AS enter_function_name{extra}
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY t, seq)),
calls AS (SELECT *, t - start_t AS duration FROM looked WHERE NOT is_enter AND was_enter)"""


def cpu_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), (F.col("event_id") % 64).alias("cpu_id"),
        F.floor(F.col("value") * 1000).cast("long").alias("oncpu_time"),
        (F.col("event_id") % 100 * 1000).alias("offcpu_time"),
        (F.col("value") / 5).alias("utilization"),
        micros("ts").alias("t"), F.col("event_id").alias("seq"),
    )


CPU_SQL = """cpu AS (
  SELECT user_id AS pid, event_id % 64 AS cpu_id, CAST(floor(value * 1000) AS BIGINT) AS oncpu_time,
         event_id % 100 * 1000 AS offcpu_time, value / 5 AS utilization, epoch_us(ts) AS t, event_id AS seq
  FROM events)"""

_LINE_SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
_LINE_SEQ_SQL = "struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_extendedprice)"


def io_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pid"), (F.col("l_linestatus") == "F").alias("is_write"),
        long_of("l_extendedprice").alias("bytes"), (F.col("l_quantity") * 1000).cast("long").alias("latency_us"),
        (F.col("l_linenumber") % 3).alias("major"), F.col("l_linenumber").alias("minor"),
        micros("l_shipdate").alias("t"), F.struct(*_LINE_SEQ).alias("seq"),
    )


IO_SQL = f"""io AS (
  SELECT l_suppkey AS pid, l_linestatus = 'F' AS is_write, CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
         CAST(l_quantity * 1000 AS BIGINT) AS latency_us, l_linenumber % 3 AS major, l_linenumber AS minor,
         epoch_us(l_shipdate) AS t, {_LINE_SEQ_SQL} AS seq
  FROM lineitem)"""


def alloc_events(spark: SparkSession, sf: str) -> DataFrame:
    """Lines flagged A allocate and R free; of those flagged N the odd line numbers allocate and the even ones free."""
    alloc = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 1))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pid"), F.col("l_partkey").alias("addr"),
        alloc.alias("is_alloc"), long_of("l_extendedprice").alias("size"),
        (F.col("l_partkey") % 50).alias("site"), F.when(F.col("l_discount") >= 0.1, 2).otherwise(0).alias("ret"),
        micros("l_shipdate").alias("t"), F.struct(*_LINE_SEQ).alias("seq"),
    )


ALLOC_SQL = f"""al AS (
  SELECT l_suppkey AS pid, l_partkey AS addr, (l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 1)) AS is_alloc,
         CAST(floor(l_extendedprice) AS BIGINT) AS size, l_partkey % 50 AS site,
         CASE WHEN l_discount >= 0.1 THEN 2 ELSE 0 END AS ret,
         epoch_us(l_shipdate) AS t, {_LINE_SEQ_SQL} AS seq
  FROM lineitem),
matched AS (
  SELECT *, CASE WHEN NOT is_alloc AND lag(is_alloc) OVER w THEN lag(size) OVER w END AS matched_size
  FROM al WINDOW w AS (PARTITION BY pid, addr ORDER BY t, seq))"""

TIMELINE_SQL = ALLOC_SQL + """,
summed AS (
  SELECT *, CAST(sum(CASE WHEN is_alloc THEN size ELSE -coalesce(matched_size, size) END)
                 OVER (PARTITION BY pid ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM matched),
level AS (
  SELECT *, s - least(min(s) OVER (PARTITION BY pid ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS current FROM summed),
timeline AS (
  SELECT *, max(current) OVER (PARTITION BY pid ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS peak FROM level)"""


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as packets; a day counts as one second."""
    address = F.concat(F.lit("10.0."), F.floor(F.col("o_custkey") / 256) % 256, F.lit("."), F.col("o_custkey") % 256)
    base = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("pid"), (F.col("o_orderstatus") == "F").alias("is_send"),
        long_of("o_totalprice").alias("bytes"), address.alias("src_addr"), F.lit("10.1.0.1").alias("dst_addr"),
        (F.col("o_orderkey") % 1024).alias("src_port"), (F.col("o_orderkey") % 3).alias("dst_port"),
        F.substring("o_orderpriority", 3, 20).alias("protocol"),
        (day_number("o_orderdate") * 1_000_000).alias("t"), F.col("o_orderkey").alias("seq"),
    )
    return base.withColumns({
        "source": F.concat_ws(":", "src_addr", "src_port"), "destination": F.concat_ws(":", "dst_addr", "dst_port"),
    }).withColumn("connection", F.concat("source", F.lit("->"), "destination", F.lit(" ("), "protocol", F.lit(")")))


NET_SQL = """np AS (
  SELECT o_custkey % 50 AS pid, o_orderstatus = 'F' AS is_send, CAST(floor(o_totalprice) AS BIGINT) AS bytes,
         '10.0.' || CAST(o_custkey // 256 % 256 AS VARCHAR) || '.' || CAST(o_custkey % 256 AS VARCHAR) AS src_addr,
         '10.1.0.1' AS dst_addr, o_orderkey % 1024 AS src_port, o_orderkey % 3 AS dst_port,
         substr(o_orderpriority, 3, 20) AS protocol,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 1000000 AS t, o_orderkey AS seq
  FROM orders),
net AS (
  SELECT *, src_addr || ':' || CAST(src_port AS VARCHAR) AS source, dst_addr || ':' || CAST(dst_port AS VARCHAR) AS destination,
         src_addr || ':' || CAST(src_port AS VARCHAR) || '->' || dst_addr || ':' || CAST(dst_port AS VARCHAR) || ' (' || protocol || ')' AS connection
  FROM np)"""


def snapshot_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a day as one memory map; the address follows the position of the key."""
    return table(spark, sf, "orders").select(
        day_number("o_orderdate").alias("snapshot"), (F.col("o_orderkey") * 16384).alias("address"),
        long_of("o_totalprice").alias("size"), (F.col("o_orderpriority") == "1-URGENT").alias("failed"),
    )


BLOCKS_SQL = """blocks AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS snapshot,
         o_orderkey * 16384 AS address, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderpriority = '1-URGENT' AS failed
  FROM orders)"""
