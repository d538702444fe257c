"""Queries over function, CPU, IO, memory and network events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import pairing, rules, stats
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import query

CALL_KEYS = ["tgid", "pid", "cookie"]


def calls(spark, sf, enter=b.ENTER, keys=CALL_KEYS):
    return pairing.pair_latest(b.function_events(spark, sf, enter), keys, keep=["function_name"])


CALLS_SQL = "WITH " + b.function_events_sql() + ",\n" + b.pairs_sql("fe", "tgid, pid, cookie")


@query("j1_paired_calls", CALLS_SQL + """
SELECT tgid, pid, cookie, enter_function_name, start_t, t, duration FROM calls""")
def j1(spark, sf):
    return calls(spark, sf).select("tgid", "pid", "cookie", "enter_function_name", "start_t", "t", "duration")


SYSCALL_SQL = ("WITH " + b.function_events_sql(("click", "view")) + ",\n"
               + b.pairs_sql("fe", "tgid, pid, function_name, cookie"))


def syscalls(spark, sf):
    return calls(spark, sf, ("click", "view"), ["tgid", "pid", "function_name", "cookie"])


@query("j2_paired_syscalls", SYSCALL_SQL + """
SELECT tgid, pid, function_name AS syscall, cookie AS call_id, start_t, duration FROM calls""")
def j2(spark, sf):
    return syscalls(spark, sf).select("tgid", "pid", F.col("function_name").alias("syscall"),
                                      F.col("cookie").alias("call_id"), "start_t", "duration")


OPS_SQL = "WITH " + b.function_events_sql(("view", "purchase")) + ",\n" + b.pairs_sql("fe", "tgid, pid")


def ops(spark, sf):
    return calls(spark, sf, ("view", "purchase"), ["tgid", "pid"])


@query("j3_latest_enter_exit", OPS_SQL + "\nSELECT tgid, pid, start_t, t, duration FROM calls")
def j3(spark, sf):
    return ops(spark, sf).select("tgid", "pid", "start_t", "t", "duration")


@query("j4_free_matched_to_malloc", "WITH " + b.ALLOC_SQL + """
SELECT pid, addr, t, size, matched_size FROM matched WHERE NOT is_alloc AND matched_size IS NOT NULL""")
def j4(spark, sf):
    matched = pairing.match_frees(b.alloc_events(spark, sf))
    return matched.filter(~F.col("is_alloc") & F.col("matched_size").isNotNull()).select(
        "pid", "addr", "t", "size", "matched_size")


STATS_SQL = CALLS_SQL + """,
entered AS (SELECT function_name, count(*) AS call_count, min(t) AS first_call FROM fe WHERE is_enter GROUP BY 1),
done AS (
  SELECT enter_function_name AS function_name, count(*) AS completed, CAST(sum(duration) AS BIGINT) AS total_us,
         min(duration) AS min_us, max(duration) AS max_us, count(*) FILTER (duration > 1000000) AS slow_calls,
         max(t) AS last_call
  FROM calls GROUP BY 1),
fstats AS (
  SELECT function_name, call_count, call_count - coalesce(completed, 0) AS active_calls,
         coalesce(total_us, 0) AS total_us, min_us, max_us, round(coalesce(total_us, 0) / call_count, 3) AS avg_us,
         coalesce(slow_calls, 0) AS slow_calls, first_call, last_call
  FROM entered LEFT JOIN done USING (function_name))"""


def function_stats(spark, sf):
    events = b.function_events(spark, sf)
    paired = pairing.pair_latest(events, CALL_KEYS, keep=["function_name"])
    return stats.function_stats(events, paired).withColumn("avg_us", F.round("avg_us", 3))


@query("a1_function_stats", STATS_SQL + "\nSELECT * FROM fstats")
def a1(spark, sf):
    return function_stats(spark, sf)


@query("a2_first_slow_calls", CALLS_SQL + """
SELECT enter_function_name, start_t, duration, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY enter_function_name ORDER BY t, seq) AS rank
  FROM calls WHERE duration > 1000000) WHERE rank <= 10""")
def a2(spark, sf):
    return stats.first_slow_calls(calls(spark, sf)).select("enter_function_name", "start_t", "duration", "rank")


@query("t2_top_by_total_time", STATS_SQL + """
SELECT function_name, total_us, call_count FROM fstats ORDER BY total_us DESC, function_name LIMIT 10""")
def t2(spark, sf):
    return rules.busiest(function_stats(spark, sf), "total_us", 10, "function_name").select(
        "function_name", "total_us", "call_count")


@query("t3_top_functions", STATS_SQL + """
(SELECT 'calls' AS ranking, function_name, call_count AS score FROM fstats ORDER BY call_count DESC, function_name LIMIT 5)
UNION ALL
(SELECT 'slowest', function_name, max_us FROM fstats WHERE max_us > 0 ORDER BY max_us DESC, function_name LIMIT 5)""")
def t3(spark, sf):
    of = function_stats(spark, sf)
    often = rules.busiest(of, "call_count", 5, "function_name").select(
        F.lit("calls").alias("ranking"), "function_name", F.col("call_count").alias("score"))
    slow = rules.busiest(of.filter("max_us > 0"), "max_us", 5, "function_name").select(
        F.lit("slowest").alias("ranking"), "function_name", F.col("max_us").alias("score"))
    return often.unionByName(slow)


CPU_STATS_SQL = "WITH " + b.CPU_SQL + """,
moves AS (
  SELECT *, coalesce(lag(cpu_id) OVER w <> cpu_id, false) AS migrated,
         coalesce(lag(cpu_id) OVER w // 32 <> cpu_id // 32, false) AS cross_numa
  FROM cpu WINDOW w AS (PARTITION BY pid ORDER BY t, seq)),
cstats AS (
  SELECT pid, CAST(sum(oncpu_time) AS BIGINT) AS oncpu_total, CAST(sum(offcpu_time) AS BIGINT) AS offcpu_total,
         count(*) AS call_count,
         CASE WHEN sum(oncpu_time) + sum(offcpu_time) > 0
              THEN sum(oncpu_time) / (sum(oncpu_time) + sum(offcpu_time)) ELSE 0.0 END AS utilization,
         count(*) FILTER (migrated) AS migrations, count(*) FILTER (cross_numa) AS numa_migrations
  FROM moves GROUP BY pid),
cores AS (SELECT pid, cpu_id, CAST(sum(oncpu_time) AS BIGINT) AS oncpu_time FROM cpu GROUP BY 1, 2),
hot AS (
  SELECT pid, max_by(cpu_id, struct_pack(a := oncpu_time, b := -cpu_id)) AS hotspot_cpu,
         max(oncpu_time) / sum(oncpu_time) AS hotspot_share FROM cores GROUP BY pid)"""


@query("w4_cpu_migrations", CPU_STATS_SQL + "\nSELECT pid, t, cpu_id, migrated, cross_numa FROM moves")
def w4(spark, sf):
    return stats.cpu_moves(b.cpu_samples(spark, sf)).select("pid", "t", "cpu_id", "migrated", "cross_numa")


def cpu_stats(spark, sf):
    return stats.cpu_stats(stats.cpu_moves(b.cpu_samples(spark, sf)))


@query("a3_cpu_stats", CPU_STATS_SQL + "\nSELECT * REPLACE (round(utilization, 6) AS utilization) FROM cstats")
def a3(spark, sf):
    return cpu_stats(spark, sf).withColumn("utilization", F.round("utilization", 6))


@query("a3_core_times", CPU_STATS_SQL + "\nSELECT * FROM cores")
def a3_cores(spark, sf):
    return stats.core_times(b.cpu_samples(spark, sf))


@query("a4_hot_core", CPU_STATS_SQL + "\nSELECT pid, hotspot_cpu, round(hotspot_share, 6) AS hotspot_share FROM hot")
def a4(spark, sf):
    return stats.hot_core(stats.core_times(b.cpu_samples(spark, sf))).withColumn(
        "hotspot_share", F.round("hotspot_share", 6))


BURST_SQL = CPU_STATS_SQL + """,
recent AS (
  SELECT *, avg(utilization) OVER w AS recent_mean, count(utilization) OVER w AS n
  FROM cpu WINDOW w AS (PARTITION BY pid ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
bursts AS (SELECT * FROM recent WHERE n = 10 AND utilization > 2 * recent_mean AND utilization > 50)"""


@query("w6_cpu_bursts", BURST_SQL + """
SELECT pid, t, round(utilization, 4) AS utilization, round(recent_mean, 4) AS recent_mean FROM bursts""")
def w6(spark, sf):
    return rules.cpu_bursts(b.cpu_samples(spark, sf)).select(
        "pid", "t", F.round("utilization", 4).alias("utilization"), F.round("recent_mean", 4).alias("recent_mean"))


@query("d13_cpu_rules", BURST_SQL + """
SELECT pid, 'hot_core' AS rule, round(hotspot_share, 6) AS value FROM cstats JOIN hot USING (pid)
WHERE hotspot_share > 0.8 AND oncpu_total > 1000000
UNION ALL SELECT pid, 'numa_moves', CAST(numa_migrations AS DOUBLE) FROM cstats WHERE numa_migrations >= 10
UNION ALL SELECT pid, 'burst', round(max(utilization), 6) FROM bursts GROUP BY pid
UNION ALL SELECT pid, 'switch_rate', round(migrations / call_count, 6) FROM cstats WHERE migrations / call_count > 0.5
UNION ALL SELECT pid, 'starved', round(utilization, 6) FROM cstats
WHERE call_count > 20 AND utilization < 0.45 AND oncpu_total > 500000""")
def d13(spark, sf):
    samples = b.cpu_samples(spark, sf)
    hot = stats.hot_core(stats.core_times(samples))
    # The events are no CPU load, so two limits are set to where they can be met.
    hits = rules.cpu_rules(cpu_stats(spark, sf), hot, rules.cpu_bursts(samples), hot_min_on=1_000_000, starved=0.45)
    return hits.withColumn("value", F.round("value", 6))


IO_STATS = """
SELECT {keys}, CAST(sum(bytes) AS BIGINT) AS total_bytes,
  CAST(coalesce(sum(bytes) FILTER (NOT is_write), 0) AS BIGINT) AS read_bytes,
  CAST(coalesce(sum(bytes) FILTER (is_write), 0) AS BIGINT) AS write_bytes,
  count(*) FILTER (NOT is_write) AS read_ops, count(*) FILTER (is_write) AS write_ops,
  round(avg(latency_us) FILTER (NOT is_write), 4) AS avg_read_us, round(avg(latency_us) FILTER (is_write), 4) AS avg_write_us,
  round(avg(latency_us), 4) AS avg_us, max(latency_us) AS max_us
FROM io GROUP BY {keys}"""


def io_stats(spark, sf, keys):
    out = stats.io_stats(b.io_events(spark, sf), keys)
    return out.withColumns({c: F.round(c, 4) for c in ("avg_read_us", "avg_write_us", "avg_us")})


@query("a5_io_by_process", "WITH " + b.IO_SQL + IO_STATS.format(keys="pid"))
def a5(spark, sf):
    return io_stats(spark, sf, ["pid"])


@query("a5_device_access", "WITH " + b.IO_SQL + "\nSELECT pid, major, minor, count(*) AS accesses FROM io GROUP BY ALL")
def a5_devices(spark, sf):
    return stats.device_access(b.io_events(spark, sf))


@query("a6_io_by_device", "WITH " + b.IO_SQL + IO_STATS.format(keys="major, minor"))
def a6(spark, sf):
    return io_stats(spark, sf, ["major", "minor"])


IO_RECENT_SQL = "WITH " + b.IO_SQL + """,
recent AS (
  SELECT *, avg(latency_us) OVER w AS recent_mean, count(latency_us) OVER w AS n,
         row_number() OVER (PARTITION BY pid ORDER BY t, seq) AS op
  FROM io WINDOW w AS (PARTITION BY pid ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query("w7_io_spikes", IO_RECENT_SQL + """
SELECT pid, t, bytes, latency_us, round(recent_mean, 3) AS recent_mean FROM recent
WHERE n = 10 AND latency_us > 3 * recent_mean AND latency_us > 10000""")
def w7(spark, sf):
    return rules.io_spikes(b.io_events(spark, sf)).select(
        "pid", "t", "bytes", "latency_us", F.round("recent_mean", 3).alias("recent_mean"))


@query("d14_io_rules", IO_RECENT_SQL + """
SELECT pid, t, bytes, latency_us, rule FROM (
  SELECT *, unnest(['slow', 'large', 'spike']) AS rule FROM recent WHERE op > 10)
WHERE (rule = 'slow' AND latency_us > 45000) OR (rule = 'large' AND bytes > 100000)
   OR (rule = 'spike' AND bytes <= 100000 AND n = 10 AND latency_us > 3 * recent_mean AND latency_us > 10000)""")
def d14(spark, sf):
    hits = rules.io_rules(b.io_events(spark, sf), slow_us=45_000, large=100_000)
    return hits.select("pid", "t", "bytes", "latency_us", "rule")


@query("w5_memory_timeline", "WITH " + b.TIMELINE_SQL + "\nSELECT pid, addr, t, is_alloc, size, current, peak FROM timeline")
def w5(spark, sf):
    return stats.memory_timeline(b.alloc_events(spark, sf)).select(
        "pid", "addr", "t", "is_alloc", "size", "current", "peak")


MEMORY_SQL = "WITH " + b.TIMELINE_SQL + """,
mstats AS (
  SELECT pid, CAST(coalesce(sum(size) FILTER (is_alloc), 0) AS BIGINT) AS total_allocs,
         CAST(coalesce(sum(size) FILTER (NOT is_alloc), 0) AS BIGINT) AS total_frees,
         max_by(current, struct_pack(a := t, b := seq)) AS current, max(peak) AS peak
  FROM timeline GROUP BY pid)"""


def memory_stats(spark, sf):
    return stats.memory_stats(stats.memory_timeline(b.alloc_events(spark, sf)))


@query("a7_memory_stats", MEMORY_SQL + "\nSELECT * FROM mstats")
def a7(spark, sf):
    return memory_stats(spark, sf)


@query("a19_fleet_memory", MEMORY_SQL + """
SELECT CAST(sum(current) AS BIGINT) AS current, CAST(sum(peak) AS BIGINT) AS peak,
       CAST(sum(total_allocs) AS BIGINT) AS total_allocs, CAST(sum(total_frees) AS BIGINT) AS total_frees FROM mstats""")
def a19(spark, sf):
    return stats.fleet_memory(memory_stats(spark, sf))


@query("w8_memory_trend", "WITH " + b.TIMELINE_SQL + """,
steps AS (
  SELECT *, lag(current) OVER (PARTITION BY pid ORDER BY t, seq) AS prev FROM timeline),
kinds AS (
  SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN current > prev * CAST(1.05 AS DOUBLE) THEN 'up'
                 WHEN current < prev * CAST(0.95 AS DOUBLE) THEN 'down' ELSE 'flat' END AS kind FROM steps),
trend AS (
  SELECT pid, t, current, count(*) FILTER (kind = 'up') OVER w AS up, count(*) FILTER (kind = 'down') OVER w AS down,
         count(*) FILTER (kind = 'flat') OVER w AS flat,
         row_number() OVER (PARTITION BY pid ORDER BY t, seq) AS n
  FROM kinds WINDOW w AS (PARTITION BY pid ORDER BY t, seq ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))
SELECT pid, t, current, up, down, flat FROM trend WHERE n >= 20""")
def w8(spark, sf):
    return rules.memory_trend(stats.memory_timeline(b.alloc_events(spark, sf))).select(
        "pid", "t", "current", "up", "down", "flat")


@query("d15_large_allocations", "WITH " + b.ALLOC_SQL + """
SELECT pid, addr, t, size FROM al WHERE is_alloc AND size >= 90000""")
def d15(spark, sf):
    return rules.large_allocations(b.alloc_events(spark, sf), 90_000).select("pid", "addr", "t", "size")


NET_STATS_SQL = "WITH " + b.NET_SQL + """,
nstats AS (
  SELECT pid, CAST(coalesce(sum(bytes) FILTER (is_send), 0) AS BIGINT) AS tx_bytes,
         CAST(coalesce(sum(bytes) FILTER (NOT is_send), 0) AS BIGINT) AS rx_bytes,
         count(*) FILTER (is_send) AS tx_packets, count(*) FILTER (NOT is_send) AS rx_packets,
         count(DISTINCT connection) AS connections,
         count(DISTINCT CASE WHEN dst_port = 0 AND src_port > 0 THEN src_port END) AS listening_ports
  FROM net GROUP BY pid),
gaps AS (
  SELECT *, (t - lag(t) OVER (PARTITION BY pid, is_send ORDER BY t, seq)) / 1e6 AS gap,
         count(*) FILTER (is_send) OVER w AS sent, count(*) FILTER (NOT is_send) OVER w AS received
  FROM net WINDOW w AS (PARTITION BY pid ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
varied AS (
  SELECT *, var_pop(gap) OVER (PARTITION BY pid, is_send ORDER BY t, seq ROWS BETWEEN 98 PRECEDING AND CURRENT ROW) AS v
  FROM gaps),
nbursts AS (SELECT * FROM varied WHERE sent > 10 AND received > 10 AND v > 0.8)"""


@query("a8_net_stats", NET_STATS_SQL + "\nSELECT * FROM nstats")
def a8(spark, sf):
    return stats.net_stats(b.packets(spark, sf))


@query("w9_traffic_bursts", NET_STATS_SQL + "\nSELECT pid, is_send, t, seq, round(v + 1e-7, 3) AS gap_variance FROM nbursts")
def w9(spark, sf):
    return rules.traffic_bursts(b.packets(spark, sf)).select(
        "pid", "is_send", "t", "seq", F.round(F.col("gap_variance") + 1e-7, 3).alias("gap_variance"))


@query("d16_net_rules", NET_STATS_SQL + """
SELECT pid, 'large_send' AS rule, CAST(tx_bytes AS DOUBLE) AS value FROM nstats WHERE tx_bytes > 10485760
UNION ALL SELECT pid, 'large_receive', CAST(rx_bytes AS DOUBLE) FROM nstats WHERE rx_bytes > 10485760
UNION ALL SELECT pid, 'connections', CAST(connections AS DOUBLE) FROM nstats WHERE connections > 100
UNION ALL SELECT pid, CASE WHEN is_send THEN 'send_burst' ELSE 'receive_burst' END, round(max(v) + 1e-7, 3)
FROM nbursts GROUP BY pid, is_send""")
def d16(spark, sf):
    events = b.packets(spark, sf)
    hits = rules.net_rules(stats.net_stats(events), rules.traffic_bursts(events))
    return hits.withColumn("value", F.round(F.col("value") + F.when(F.col("rule").endswith("burst"), 1e-7).otherwise(0.0), 3))


@query("a31_connections", "WITH " + b.NET_SQL + "\nSELECT DISTINCT pid, source, destination, protocol, connection FROM net")
def a31(spark, sf):
    return stats.connection_table(b.packets(spark, sf))


RUNNING_NET_SQL = "WITH " + b.NET_SQL + """,
totals AS (
  SELECT pid, t, seq, CAST(sum(CASE WHEN is_send THEN bytes ELSE 0 END) OVER w AS BIGINT) AS tx_total,
         CAST(sum(CASE WHEN is_send THEN 0 ELSE bytes END) OVER w AS BIGINT) AS rx_total
  FROM net WINDOW w AS (PARTITION BY pid ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
sampled AS (
  SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY pid, t // 30000000 ORDER BY t, seq) = 1)"""


def running_totals(spark, sf):
    from tallyforge.ordered import running

    return running(b.packets(spark, sf), ["pid"], pairing.order_columns(), {
        "tx_total": ("sum", F.when(F.col("is_send"), F.col("bytes")).otherwise(0)),
        "rx_total": ("sum", F.when(F.col("is_send"), F.lit(0)).otherwise(F.col("bytes"))),
    }).select("pid", "t", "seq", "tx_total", "rx_total")


def sampled_totals(spark, sf):
    return rules.one_per_slot(running_totals(spark, sf), ["pid"], 30_000_000)


@query("r2_sampled_rows", RUNNING_NET_SQL + "\nSELECT pid, t // 30000000 AS slot, t, seq, tx_total, rx_total FROM sampled")
def r2(spark, sf):
    return sampled_totals(spark, sf)


@query("r2_once_per_interval", RUNNING_NET_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
nodes AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY pid, t ORDER BY seq) = 1),
jump AS (SELECT pid, t, min(t) OVER (PARTITION BY pid ORDER BY t RANGE BETWEEN 30000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM nodes),
passed AS (
  SELECT pid, min(t) AS t FROM nodes GROUP BY pid
  UNION ALL SELECT p.pid, j.after FROM passed p JOIN jump j ON p.pid = j.pid AND p.t = j.t WHERE j.after IS NOT NULL)
SELECT pid, t, seq, tx_total, rx_total FROM nodes JOIN passed USING (pid, t)""")
def r2_exact(spark, sf):
    return rules.once_per_interval(running_totals(spark, sf), ["pid"], 30_000_000)


@query("r6_reports_every_n", """
SELECT pid, t, events, CAST(total AS BIGINT) AS total FROM (
  SELECT user_id AS pid, epoch_us(ts) AS t, row_number() OVER w AS events, sum(CAST(floor(value) AS BIGINT)) OVER w AS total
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING)) WHERE events % 7 = 0""")
def r6(spark, sf):
    events = b.table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), b.micros("ts").alias("t"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("v"))
    return rules.report_every(events, 7, ["pid"], "v")


@query("w10_bytes_since_sample", RUNNING_NET_SQL + """
SELECT pid, t, tx_total, greatest(tx_total - coalesce(lag(tx_total) OVER w, 0), 0) AS tx_total_delta,
       greatest(rx_total - coalesce(lag(rx_total) OVER w, 0), 0) AS rx_total_delta
FROM sampled WINDOW w AS (PARTITION BY pid ORDER BY t, seq)""")
def w10(spark, sf):
    return stats.sampled_deltas(sampled_totals(spark, sf), ["pid"], ["tx_total", "rx_total"]).select(
        "pid", "t", "tx_total", "tx_total_delta", "rx_total_delta")


@query("a9_syscall_times", SYSCALL_SQL + """
SELECT tgid, function_name AS syscall, count(*) AS calls, round(avg(duration), 3) AS avg_time FROM calls GROUP BY ALL""")
def a9(spark, sf):
    of = syscalls(spark, sf).withColumnRenamed("function_name", "syscall")
    return stats.call_times(of, ["tgid", "syscall"]).withColumn("avg_time", F.round("avg_time", 3))


@query("a10_bus_times", OPS_SQL + """
SELECT tgid, cookie AS op, count(*) AS calls, round(avg(duration), 3) AS avg_time FROM calls GROUP BY ALL""")
def a10(spark, sf):
    of = ops(spark, sf).withColumnRenamed("cookie", "op")
    return stats.call_times(of, ["tgid", "op"]).withColumn("avg_time", F.round("avg_time", 3))


FENCE_SQL = """WITH fences AS (
  SELECT l_suppkey AS tgid, CASE l_returnflag WHEN 'A' THEN 'init' WHEN 'R' THEN 'wait_start' ELSE 'wait_end' END AS fence_type,
         CAST(l_quantity * 1000 AS BIGINT) AS duration FROM lineitem)"""


def fences(spark, sf):
    flag = F.col("l_returnflag")
    return b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("tgid"),
        F.when(flag == "A", "init").when(flag == "R", "wait_start").otherwise("wait_end").alias("fence_type"),
        (F.col("l_quantity") * 1000).cast("long").alias("duration"))


@query("a11_fence_counts", FENCE_SQL + "\nSELECT tgid, fence_type, count(*) AS fences FROM fences GROUP BY ALL")
def a11(spark, sf):
    return stats.fence_stats(fences(spark, sf), "wait_end")[0]


@query("a11_fence_waits", FENCE_SQL + """
SELECT tgid, CAST(coalesce(sum(duration) FILTER (fence_type = 'wait_end' AND duration > 0), 0) AS BIGINT) AS total_wait,
       coalesce(max(duration) FILTER (fence_type = 'wait_end' AND duration > 0), 0) AS max_wait FROM fences GROUP BY tgid""")
def a11_waits(spark, sf):
    return stats.fence_stats(fences(spark, sf), "wait_end")[1]


LINK_NAMES = ["memcpy", "memset", "strcpy", "memmove"]


@query("a12_link_stats", CALLS_SQL + """
SELECT tgid, ['memcpy', 'memset', 'strcpy', 'memmove'][cookie + 1] AS func, count(*) AS calls,
       round(avg(duration), 3) AS avg_time,
       CAST(coalesce(sum(CASE WHEN cookie <> 2 THEN CAST(floor(value * 100) AS BIGINT) END), 0) AS BIGINT) AS bytes
FROM calls GROUP BY ALL""")
def a12(spark, sf):
    names = F.array(*[F.lit(n) for n in LINK_NAMES])
    of = calls(spark, sf).withColumns({
        "func": names[F.col("cookie")], "size": F.floor(F.col("value") * 100).cast("long")})
    return stats.link_stats(of).withColumn("avg_time", F.round("avg_time", 3))


@query("a13_verb_counts", "WITH " + b.function_events_sql() + """
SELECT tgid, function_name AS func, count(*) AS calls FROM fe WHERE NOT is_enter GROUP BY ALL""")
def a13(spark, sf):
    return stats.verb_counts(b.function_events(spark, sf).withColumnRenamed("function_name", "func"))


# Every event is a launch; its type and k name the kernel.
A14_SQL = """
SELECT user_id AS pid, event_type || '_' || json_extract_string(props, '$.k') AS kernel, count(*) AS launches FROM events GROUP BY ALL"""


@query("a14_all_kernel_launches", A14_SQL)
@query("a14_kernel_launches", A14_SQL)
def a14(spark, sf):
    return stats.launch_counts(b.table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k")).alias("kernel")))


@query("a15_copy_bandwidth", """
WITH copies AS (
  SELECT l_suppkey AS pid, l_linenumber % 5 AS kind, floor(l_extendedprice) AS bytes, CAST(l_quantity * 1000 AS BIGINT) AS ns
  FROM lineitem)
SELECT pid, CASE kind WHEN 0 THEN 'H2H' WHEN 1 THEN 'H2D' WHEN 2 THEN 'D2H' WHEN 3 THEN 'D2D' ELSE 'DEFAULT' END AS kind_name,
       round(avg(CASE WHEN ns > 0 THEN bytes / 1048576.0::DOUBLE / (ns / 1e9) ELSE 0 END), 3) AS mb_per_s, count(*) AS copies
FROM copies GROUP BY ALL""")
def a15(spark, sf):
    copies = b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pid"), (F.col("l_linenumber") % 5).alias("kind"),
        b.long_of("l_extendedprice").alias("bytes"), F.lit(0).cast("long").alias("start_ns"),
        (F.col("l_quantity") * 1000).cast("long").alias("end_ns"))
    return stats.copy_bandwidth(copies).groupBy("pid", "kind_name").agg(
        F.round(F.avg("mb_per_s"), 3).alias("mb_per_s"), F.count(F.lit(1)).alias("copies"))


@query("a16_gpu_live_bytes", "WITH " + b.ALLOC_SQL + """
SELECT pid, addr, t, is_alloc, CAST(sum(CASE WHEN is_alloc THEN size ELSE -coalesce(matched_size, 0) END)
  OVER (PARTITION BY pid ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_bytes FROM matched""")
def a16(spark, sf):
    return stats.live_bytes(b.alloc_events(spark, sf)).select("pid", "addr", "t", "is_alloc", "live_bytes")


@query("a17_cpu_gauges", "WITH " + b.CPU_SQL + """
SELECT pid, max_by(oncpu_time, struct_pack(a := t, b := seq)) AS oncpu_time,
       max_by(offcpu_time, struct_pack(a := t, b := seq)) AS offcpu_time FROM cpu GROUP BY pid""")
def a17_cpu(spark, sf):
    return stats.latest_gauges(b.cpu_samples(spark, sf), ["pid"], ["oncpu_time", "offcpu_time"])


@query("a17_io_gauges", "WITH " + b.IO_SQL + """
SELECT pid, is_write, max_by(bytes, struct_pack(a := t, b := seq)) AS bytes,
       max_by(latency_us, struct_pack(a := t, b := seq)) AS latency_us FROM io GROUP BY ALL""")
def a17_io(spark, sf):
    return stats.latest_gauges(b.io_events(spark, sf), ["pid", "is_write"], ["bytes", "latency_us"])


@query("a17_memory_gauges", MEMORY_SQL + """
SELECT pid, max_by(current, struct_pack(a := t, b := seq)) AS current, max_by(peak, struct_pack(a := t, b := seq)) AS peak
FROM timeline GROUP BY pid""")
def a17_memory(spark, sf):
    return stats.latest_gauges(stats.memory_timeline(b.alloc_events(spark, sf)), ["pid"], ["current", "peak"])


@query("a17_net_gauges", "WITH " + b.NET_SQL + """
SELECT pid, protocol, max_by(bytes, struct_pack(a := t, b := seq)) AS bytes FROM net GROUP BY ALL""")
def a17_net(spark, sf):
    return stats.latest_gauges(b.packets(spark, sf), ["pid", "protocol"], ["bytes"])


@query("a18_duration_histogram", CALLS_SQL + """
SELECT enter_function_name, le, count(*) FILTER (duration / 864000000000.0 <= le) AS n
FROM calls, (SELECT unnest([0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL""")
def a18_durations(spark, sf):
    # Ten days count as one second, which spreads the pairs over the bounds.
    of = calls(spark, sf).withColumn("seconds", F.col("duration") / 864e9)
    return stats.histogram(of, ["enter_function_name"], "seconds", stats.DURATION_BOUNDS)


@query("a18_allocation_histogram", "WITH " + b.ALLOC_SQL + """
SELECT pid, le, count(*) FILTER (size <= le) AS n FROM al,
  (SELECT unnest([128.0, 512, 1024, 4096, 16384, 65536, 262144, 1048576, 4194304, 'inf'::DOUBLE]) AS le)
WHERE is_alloc GROUP BY ALL""")
def a18_allocations(spark, sf):
    return stats.histogram(b.alloc_events(spark, sf).filter("is_alloc"), ["pid"], "size", stats.ALLOCATION_BOUNDS)


@query("a20_active_functions", "WITH " + b.function_events_sql() + """,
s AS (SELECT *, CAST(sum(CASE WHEN is_enter THEN 1 ELSE -1 END) OVER w AS BIGINT) AS total
      FROM fe WINDOW w AS (PARTITION BY tgid ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
SELECT tgid, t, is_enter, total - least(min(total) OVER w, 0) AS active
FROM s WINDOW w AS (PARTITION BY tgid ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""")
def a20(spark, sf):
    return stats.active_functions(b.function_events(spark, sf)).select("tgid", "t", "is_enter", "active")


def records(spark, sf):
    return b.table(spark, sf, "events").select(
        F.col("event_type").alias("type"), F.floor(F.col("event_id") / 100).alias("batch"), F.col("user_id").alias("client"))


@query("a21_traces_by_type", "SELECT event_type AS type, count(*) AS traces FROM events GROUP BY ALL")
def a21(spark, sf):
    return stats.ingest_totals(records(spark, sf))


@query("a21_batch_sizes", """
WITH sizes AS (SELECT event_id // 100 AS batch, event_type AS type, count(*) AS size FROM events GROUP BY ALL)
SELECT type, le, count(*) FILTER (size <= le) AS n
FROM sizes, (SELECT unnest([10.0, 15, 20, 25, 30, 'inf'::DOUBLE]) AS le) GROUP BY ALL""")
def a21_batches(spark, sf):
    return stats.batch_sizes(records(spark, sf), [10, 15, 20, 25, 30])


@query("a21_active_clients", "SELECT count(DISTINCT user_id) AS clients FROM events")
def a21_clients(spark, sf):
    return stats.active_clients(records(spark, sf))


@query("a22_block_stats", "WITH " + b.BLOCKS_SQL + """
SELECT count(*) AS blocks, CAST(sum(size) AS BIGINT) AS total, round(avg(size), 3) AS mean, min(size) AS smallest,
       max(size) AS largest, min(address) AS low_address, max(address) + max(size) AS high_address,
       count(*) FILTER (size > 400000) AS large, count(*) FILTER (size BETWEEN 50000 AND 400000) AS medium,
       count(*) FILTER (size < 50000) AS small FROM blocks""")
def a22(spark, sf):
    return stats.block_stats(b.snapshot_blocks(spark, sf), 400_000, 50_000).withColumn("mean", F.round("mean", 3))


@query("a23_size_histogram", "WITH " + b.BLOCKS_SQL + """,
span AS (SELECT min(size) AS low, (max(size) - min(size)) / 30.0::DOUBLE AS width FROM blocks)
SELECT CAST(least(floor((size - low) / width), 29) AS INTEGER) AS bin,
       round(low + CAST(least(floor((size - low) / width), 29) AS INTEGER) * width, 4) AS bin_start, count(*) AS n
FROM blocks, span GROUP BY ALL""")
def a23(spark, sf):
    return stats.size_histogram(b.snapshot_blocks(spark, sf)).withColumn("bin_start", F.round("bin_start", 4))


@query("a32_array_summary", """
SELECT vec_id, round(list_min(x), 5) AS min, round(list_max(x), 5) AS max, round(list_avg(x), 5) AS mean,
       round(list_stddev_samp(x), 5) AS std, CAST(len(x) AS INTEGER) AS length
FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)""")
def a32(spark, sf):
    out = stats.array_summary(b.table(spark, sf, "embeddings"), "embedding")
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in ("min", "max", "mean", "std")], "length")


@query("t1_ordered_batches", "WITH " + b.CPU_SQL + """
SELECT seq // 1000 AS batch, t, seq, row_number() OVER (PARTITION BY seq // 1000 ORDER BY t, seq) AS position FROM cpu""")
def t1(spark, sf):
    from tallyforge.ordered import numbered

    rows = b.cpu_samples(spark, sf).withColumn("batch", F.floor(F.col("seq") / 1000))
    return numbered(rows, ["batch"], pairing.order_columns(), "position").select("batch", "t", "seq", "position")


@query("t4_top_cpu", CPU_STATS_SQL + "\nSELECT pid, oncpu_total FROM cstats ORDER BY oncpu_total DESC, pid LIMIT 5")
def t4_cpu(spark, sf):
    return rules.busiest(cpu_stats(spark, sf), "oncpu_total").select("pid", "oncpu_total")


@query("t4_top_io", "WITH " + b.IO_SQL + """
SELECT pid, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM io GROUP BY pid ORDER BY total_bytes DESC, pid LIMIT 5""")
def t4_io(spark, sf):
    return rules.busiest(stats.io_stats(b.io_events(spark, sf), ["pid"]), "total_bytes").select("pid", "total_bytes")


@query("t4_top_memory", MEMORY_SQL + "\nSELECT pid, current FROM mstats ORDER BY current DESC, pid LIMIT 5")
def t4_memory(spark, sf):
    return rules.busiest(memory_stats(spark, sf), "current").select("pid", "current")


@query("t4_top_net", NET_STATS_SQL + """
SELECT pid, tx_bytes + rx_bytes AS traffic FROM nstats ORDER BY traffic DESC, pid LIMIT 5""")
def t4_net(spark, sf):
    of = stats.net_stats(b.packets(spark, sf)).withColumn("traffic", F.col("tx_bytes") + F.col("rx_bytes"))
    return rules.busiest(of, "traffic").select("pid", "traffic")
