"""Queries over GPU memory: leaks, shortage and fragmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import memory, pairing, stats
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import query

# Levels here move by tens of thousands, so a mark is 400,000 above the last one.
STEP = 400_000


def timeline(spark, sf):
    return stats.memory_timeline(b.alloc_events(spark, sf))


MARKS_SQL = "WITH RECURSIVE " + b.TIMELINE_SQL + f""",
highs AS (
  SELECT * FROM (SELECT *, lag(peak) OVER (PARTITION BY pid ORDER BY t, seq) AS was FROM timeline)
  WHERE is_alloc AND current > coalesce(was, 0)),
jumps AS (
  SELECT pid, min(current) AS level FROM highs WHERE current > {STEP} GROUP BY pid
  UNION
  SELECT h.pid, min(h.current) FROM jumps j JOIN highs h ON h.pid = j.pid AND h.current > j.level + {STEP}
  GROUP BY h.pid, j.level),
marks AS (SELECT h.* FROM highs h JOIN jumps j ON h.pid = j.pid AND h.current = j.level)"""


@query("d3_high_water_marks", MARKS_SQL + "\nSELECT pid, site, addr, t, current FROM marks")
def d3(spark, sf):
    return memory.high_water_marks(timeline(spark, sf), STEP).select("pid", "site", "addr", "t", "current")


SITES = """
SELECT pid, site, count(*) FILTER (is_alloc) AS mallocs, count(*) FILTER (NOT is_alloc) AS frees,
  CAST(sum(CASE WHEN is_alloc THEN size ELSE -coalesce(matched_size, 0) END) AS BIGINT) AS bytes,
  min(t) FILTER (is_alloc) AS first_alloc, max(t) FILTER (is_alloc) AS last_alloc,
  min_by(current, struct_pack(a := t, b := seq)) FILTER (is_alloc) AS first_total
FROM {source} GROUP BY pid, site"""

SCORE = """CASE WHEN mallocs = 0 OR mallocs - frees + 2 <= 0 THEN 0.0
  ELSE greatest(0.0, least(1.0, 1.0 - (frees + 1)::DOUBLE / (mallocs - frees + 2))) END"""
GROWTH = """CASE WHEN first_alloc IS NULL THEN NULL WHEN first_alloc = last_alloc OR first_total + bytes = 0 THEN 0.0
  ELSE bytes::DOUBLE / (first_total + bytes) END"""

ALL_SITES_SQL = "WITH " + b.TIMELINE_SQL + ",\nsites AS (" + SITES.format(source="timeline") + ")"


@query("d1_leak_scores", ALL_SITES_SQL + f"""
SELECT pid, site, mallocs, frees, round({SCORE}, 6) AS leak_score FROM sites""")
def d1(spark, sf):
    of = memory.scored_sites(memory.site_counts(timeline(spark, sf)))
    return of.select("pid", "site", "mallocs", "frees", F.round("leak_score", 6).alias("leak_score"))


@query("d2_leak_growth", ALL_SITES_SQL + f"""
SELECT pid, site, bytes, first_total, round({GROWTH}, 6) AS growth FROM sites WHERE mallocs > 0""")
def d2(spark, sf):
    of = memory.scored_sites(memory.site_counts(timeline(spark, sf))).filter("mallocs > 0")
    return of.select("pid", "site", "bytes", "first_total", F.round("growth", 6).alias("growth"))


RATE = """round(CASE WHEN (last_alloc - first_alloc) // 1000000 > 0
  THEN bytes / 1048576.0::DOUBLE / mallocs / ((last_alloc - first_alloc) // 1000000) * 1e12 ELSE 0 END, 3) AS rate"""


@query("d4_leak_suspects", MARKS_SQL + """,
opening AS (SELECT pid, min(struct_pack(a := t, b := seq)) AS o FROM marks GROUP BY pid),
starts AS (
  SELECT m.pid, site, min(struct_pack(a := t, b := seq)) AS since FROM marks m JOIN opening USING (pid)
  WHERE struct_pack(a := t, b := seq) > o GROUP BY m.pid, site),
tracked AS (
  SELECT timeline.* FROM timeline JOIN starts USING (pid, site) WHERE struct_pack(a := t, b := seq) >= since),
sites AS (""" + SITES.format(source="tracked") + f"""),
scored AS (SELECT *, {SCORE} AS leak_score, {GROWTH} AS growth FROM sites)
SELECT pid, site, mallocs, frees, round(leak_score, 6) AS leak_score, round(growth, 6) AS growth, {RATE}
FROM scored WHERE leak_score >= 0.5 AND growth >= 0.01""")
def d4(spark, sf):
    events = timeline(spark, sf).select("pid", "site", "is_alloc", "size", "matched_size", "t", "seq", "current")
    sites = memory.site_counts(memory.tracked_sites(events, memory.high_water_marks(events, STEP)))
    return memory.leak_suspects(sites, score=0.5).select(
        "pid", "site", "mallocs", "frees", F.round("leak_score", 6).alias("leak_score"),
        F.round("growth", 6).alias("growth"), F.round(F.col("rate") * 1e12, 3).alias("rate"))


@query("t5_leak_ranking", ALL_SITES_SQL + f"""
SELECT pid, site, {RATE} FROM sites WHERE {SCORE} >= 0.6 AND {GROWTH} >= 0.01""")
def t5(spark, sf):
    return memory.leak_suspects(memory.site_counts(timeline(spark, sf)), score=0.6).select(
        "pid", "site", F.round(F.col("rate") * 1e12, 3).alias("rate"))


LIVE_SQL = "WITH " + b.ALLOC_SQL + """,
live AS (
  SELECT pid, addr, size, t, ret FROM (
    SELECT *, row_number() OVER (PARTITION BY pid, addr ORDER BY t DESC, seq DESC) AS rn FROM al) WHERE rn = 1 AND is_alloc)"""


def live(spark, sf):
    return pairing.live_allocations(b.alloc_events(spark, sf))


@query("d5_old_allocations", LIVE_SQL + """
SELECT pid, addr, size, (1000000000000000 - t) // 1000000 AS age_s, size > 50000 AS is_large FROM live
WHERE (1000000000000000 - t) // 1000000 > 300""")
def d5(spark, sf):
    now = F.lit(1_000_000_000_000_000).cast("long")
    return memory.old_allocations(live(spark, sf), now, large=50_000).select("pid", "addr", "size", "age_s", "is_large")


@query("d6_memory_shortage", LIVE_SQL + """
SELECT CAST(coalesce(sum(size) FILTER (ret = 0), 0) AS BIGINT) AS used, count(*) FILTER (ret <> 0) AS failed,
       round(coalesce(sum(size) FILTER (ret = 0), 0) / 1e12, 9) AS used_share,
       coalesce(sum(size) FILTER (ret = 0), 0) / 1e12 > 0.8 OR count(*) FILTER (ret <> 0) > 0 AS short FROM live""")
def d6(spark, sf):
    return memory.shortage(live(spark, sf), 10**12).withColumn("used_share", F.round("used_share", 9))


def dated_allocations(spark, sf):
    allocs = b.alloc_events(spark, sf).filter("is_alloc")
    snapshot = F.floor(F.col("t") / 864_000_000_000)  # ten days to a snapshot
    return allocs.withColumn("snapshot", snapshot).withColumn("snapshot_t", (snapshot + 1) * 864_000_000_000)


@query("d7_oom_flags", "WITH " + b.ALLOC_SQL + """
SELECT t // 864000000000 AS snapshot,
       bool_or(ret <> 0 AND ((t // 864000000000 + 1) * 864000000000 - t) // 1000000 <= 172800) AS is_oom
FROM al WHERE is_alloc GROUP BY 1""")
def d7(spark, sf):
    return memory.oom_flags(dated_allocations(spark, sf), within_s=172_800)


@query("d19_failed_allocations", "WITH " + b.ALLOC_SQL + "\nSELECT pid, addr, t, size, ret FROM al WHERE is_alloc AND ret <> 0")
def d19(spark, sf):
    return memory.failed_allocations(b.alloc_events(spark, sf).filter("is_alloc")).select("pid", "addr", "t", "size", "ret")


def blocks(spark, sf):
    return b.snapshot_blocks(spark, sf).filter(~F.col("failed")).drop("failed")


MERGED_SQL = "WITH " + b.BLOCKS_SQL + """,
wide AS (SELECT snapshot // 365 AS snapshot, address, 16384 AS size FROM blocks WHERE NOT failed),
flagged AS (
  SELECT *, CASE WHEN lag(address + size) OVER w = address THEN 0 ELSE 1 END AS starts
  FROM wide WINDOW w AS (PARTITION BY snapshot ORDER BY address, size)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY snapshot ORDER BY address, size ROWS UNBOUNDED PRECEDING) AS island FROM flagged)
SELECT snapshot, min(address) AS address, CAST(sum(size) AS BIGINT) AS size, count(*) AS blocks FROM runs GROUP BY snapshot, island"""


@query("w17_merged_blocks", MERGED_SQL)
def w17(spark, sf):
    wide = blocks(spark, sf).withColumns({
        "snapshot": F.floor(F.col("snapshot") / 365), "size": F.lit(16384).cast("long")})
    return memory.merged_blocks(wide)


GAPS_SQL = "WITH " + b.BLOCKS_SQL + """,
kept AS (SELECT * FROM blocks WHERE NOT failed),
looked AS (
  SELECT *, address - lag(address + size) OVER (PARTITION BY snapshot ORDER BY address, size) AS gap FROM kept),
gaps AS (SELECT * FROM looked WHERE gap > 1024)"""


@query("w18_gaps", GAPS_SQL + "\nSELECT snapshot, address, gap FROM gaps")
def w18(spark, sf):
    return memory.gaps(blocks(spark, sf)).select("snapshot", "address", "gap")


METRICS_SQL = GAPS_SQL + """,
base AS (
  SELECT snapshot, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS allocated,
         max_by(address + size, struct_pack(a := address, b := size)) - min(address) AS address_space,
         avg(size) AS mean_size, stddev_pop(size) AS sd, count(*) FILTER (size <= 200000) / count(*) AS small_ratio
  FROM kept GROUP BY snapshot),
sums AS (
  SELECT snapshot, CAST(sum(gap) AS BIGINT) AS gap_total, count(*) AS gap_count, max(gap) AS largest_gap
  FROM gaps GROUP BY snapshot),
shaped AS (
  SELECT base.*, coalesce(gap_total, 0) AS gap_total, coalesce(gap_count, 0) AS gap_count,
         coalesce(largest_gap, 0) AS largest_gap,
         CAST(greatest(pow(2.0, ceil(log2(mean_size))) * 2, 4096) AS BIGINT) AS target_block,
         CAST(ceil(coalesce(gap_total, 0) / 4096) AS BIGINT) AS free_pages, gap_total // gap_count AS mean_gap
  FROM base LEFT JOIN sums USING (snapshot)),
fits AS (
  SELECT snapshot, CAST(sum(gap // target_block) AS BIGINT) AS suitable_blocks,
         CAST(coalesce(sum(gap) FILTER (gap > 2 * mean_gap), 0) AS BIGINT) AS large_gaps
  FROM gaps JOIN shaped USING (snapshot) GROUP BY snapshot),
metrics AS (
  SELECT shaped.*, coalesce(suitable_blocks, 0) AS suitable_blocks,
    CASE WHEN address_space > 0 THEN gap_total / address_space ELSE 0 END AS external_ratio,
    CASE WHEN free_pages = 0 THEN 0.0 WHEN free_pages // greatest(1, target_block // 4096) > 0
      THEN pow(1.0 - least(1.0, coalesce(suitable_blocks, 0) / (free_pages // greatest(1, target_block // 4096))), 0.25)
      ELSE 1.0 END AS unusable_index,
    sd / mean_size AS size_variation,
    CASE WHEN address_space > 0 THEN allocated / address_space ELSE 0 END AS utilization,
    CASE WHEN gap_total > 0 THEN coalesce(large_gaps, 0) / gap_total ELSE 0 END AS large_gap_ratio
  FROM shaped LEFT JOIN fits USING (snapshot)),
scored AS (
  SELECT *, least(100.0, greatest(0.0, least(external_ratio * 2, 1) * 50 + least(1, unusable_index / 10) * 15
    + (small_ratio * 0.6::DOUBLE + least(1, size_variation) * 0.4::DOUBLE) * 10 + large_gap_ratio * 25)) AS score FROM metrics)"""


def metrics(spark, sf):
    return memory.fragmentation(blocks(spark, sf), small=200_000)


ROUNDED = ["external_ratio", "unusable_index", "small_ratio", "size_variation", "utilization", "large_gap_ratio"]


@query("d8_fragmentation_metrics", METRICS_SQL + """
SELECT snapshot, blocks, allocated, address_space, gap_total, gap_count, largest_gap, target_block, free_pages, suitable_blocks,
""" + ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED) + " FROM metrics")
def d8(spark, sf):
    return metrics(spark, sf).select(
        "snapshot", "blocks", "allocated", "address_space", "gap_total", "gap_count", "largest_gap", "target_block",
        "free_pages", "suitable_blocks", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query("d9_fragmentation_score", METRICS_SQL + "\nSELECT snapshot, round(score, 5) AS score FROM scored")
def d9(spark, sf):
    return memory.fragmentation_score(metrics(spark, sf)).select("snapshot", F.round("score", 5).alias("score"))


@query("d10_fragmentation_severity", METRICS_SQL + """
SELECT snapshot, CASE WHEN score >= 80 THEN 'severe' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'mild' ELSE 'low' END AS severity,
  CASE WHEN score >= 80 THEN concat_ws(',', CASE WHEN external_ratio > 0.4 THEN 'external' END,
    CASE WHEN unusable_index > 5 THEN 'unusable' END, CASE WHEN small_ratio > 0.7 THEN 'small_blocks' END,
    CASE WHEN utilization < 0.6 THEN 'utilization' END) ELSE '' END AS reasons FROM scored""")
def d10(spark, sf):
    return memory.severity(memory.fragmentation_score(metrics(spark, sf))).select("snapshot", "severity", "reasons")


def trended(spark, sf):
    scored = memory.fragmentation_score(metrics(spark, sf)).withColumn("series", F.col("snapshot") % 7)
    return memory.score_trend(scored, ["series"], [F.col("snapshot")])


@query("a29_score_trend", METRICS_SQL + """,
placed AS (SELECT snapshot % 7 AS series, snapshot, score, row_number() OVER (PARTITION BY snapshot % 7 ORDER BY snapshot) AS pos FROM scored),
slopes AS (
  SELECT *, count(*) OVER w AS n, regr_slope(score, pos) OVER w AS slope, stddev_pop(score) OVER w AS sd
  FROM placed WINDOW w AS (PARTITION BY series ORDER BY snapshot ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series, snapshot, round(CASE WHEN n >= 2 THEN slope ELSE 0.0 END, 5) AS trend,
       round(CASE WHEN n >= 3 THEN sd / 100 ELSE 0.0 END, 5) AS volatility FROM slopes""")
def a29(spark, sf):
    return trended(spark, sf).select("series", "snapshot", F.round("trend", 5).alias("trend"),
                                     F.round("volatility", 5).alias("volatility"))


def forecasts(spark, sf):
    return memory.forecast(trended(spark, sf), ["series"], "snapshot")


@query("d11_score_forecast")
def d11(spark, sf):
    return forecasts(spark, sf)


@query("d12_forecast_risk")
def d12(spark, sf):
    now = trended(spark, sf).select("series", "snapshot", "score", "trend", "volatility", "external_ratio", "unusable_index")
    return memory.forecast_risk(forecasts(spark, sf).join(now, ["series", "snapshot"]))


@query("r10_leaks_of_ended_processes", LIVE_SQL + """
SELECT s.pid, count(addr) AS allocations, CAST(coalesce(sum(size), 0) AS BIGINT) AS leaked_bytes
FROM (SELECT s_suppkey AS pid FROM supplier WHERE s_acctbal < 0) s LEFT JOIN live USING (pid) GROUP BY s.pid""")
def r10(spark, sf):
    ended = b.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("pid"))
    return memory.exited_with_leaks(live(spark, sf), ended)
