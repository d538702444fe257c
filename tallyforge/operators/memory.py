"""GPU memory: leaks, shortage, fragmentation and its forecast."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.pairing import ORDER, order_columns
from tallyforge.ordered import framed, islands, large, numbered, previous, running
from tallyforge.session import cut_lineage

# Limits of the detectors.
LEAK_SCORE = 0.95
LEAK_GROWTH = 0.01
WATER_MARK_STEP = 10 * 1024 * 1024
LEAK_AGE_S = 300
LARGE_LEAK = 10 * 1024 * 1024
SHORTAGE_SHARE = 0.8
OOM_WITHIN_S = 10
MIN_GAP = 1024
PAGE = 4096
SMALL_BLOCK = 4 * 1024 * 1024
SCORE_WEIGHTS = {"external": 50.0, "unusable": 15.0, "pattern": 10.0, "large_gaps": 25.0}
SEVERITY = [(80, "severe"), (60, "moderate"), (40, "mild"), (0, "low")]
RISK = [(80, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (30, "LOW"), (0, "MINIMAL")]
TREND_HISTORY = 20
FORECAST_HISTORY = 50
FORECAST_WINDOW = 5
FORECAST_STEPS = 3
FEATURES = ["external_ratio", "unusable_index", "small_ratio", "size_variation", "large_gap_ratio", "utilization"]


def _banded(value: Column, bands: Sequence[tuple[float, str]]) -> Column:
    out = F.lit(bands[-1][1])
    for limit, name in reversed(bands[:-1]):
        out = F.when(value >= limit, name).otherwise(out)
    return out


# --- leaks ---------------------------------------------------------------------------

def high_water_marks(timeline: DataFrame, step: int = WATER_MARK_STEP, max_rows: int | None = None) -> DataFrame:
    """Allocations that lift a process more than ``step`` over its last mark (D3).

    Each mark depends on the one before. Only new highs can be marks, and from any high
    the next mark is the first high above it by more than ``step``; so the marks are the
    path that starts at the first high over ``step``. The path is followed by doubling:
    k rounds reach 2^k marks, each round a join on (pid, level).
    """
    counted = large(timeline.select("pid"), ["pid"], max_rows)
    before = running(timeline, ["pid"], order_columns(), {"_high": ("max", F.col("current"))}, max_rows, counted)
    highs = previous(before, ["pid"], order_columns(), {"_was": F.col("_high")}, max_rows, counted).filter(
        F.col("is_alloc") & (F.col("current") > F.coalesce("_was", F.lit(0)))
    ).drop("_high", "_was", "peak")
    highs = cut_lineage(highs)

    # Next mark of each level: walk levels downwards, keeping the lowest high seen so far.
    probes = highs.select("pid", (F.col("current") + step).alias("at"), F.lit(1).alias("kind"), F.col("current").alias("of"))
    origin = highs.select("pid").distinct().select(
        "pid", F.lit(step).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("of"))
    levels = highs.select("pid", F.col("current").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("of"))
    # A probe must not see a high equal to itself, so at equal levels probes come first going down.
    mixed = probes.unionByName(origin).unionByName(levels).withColumn("_down", -F.col("at")).withColumn("_first", -F.col("kind"))
    found = running(mixed, ["pid"], [F.col("_down"), F.col("_first"), F.col("of")],
                    {"to": ("min", F.when(F.col("kind") == 0, F.col("at")))}, max_rows)
    hop = cut_lineage(found.filter((F.col("kind") == 1) & F.col("to").isNotNull()).select("pid", F.col("of").alias("from"), "to"))

    reached = hop.filter(F.col("from") == 0).select("pid", F.col("to").alias("level"))
    size = reached.count()
    while True:
        second = hop.select(F.col("pid").alias("_pid"), F.col("from").alias("_from"), F.col("to").alias("_to"))
        further = reached.join(second, (F.col("pid") == F.col("_pid")) & (F.col("level") == F.col("_from"))).select(
            "pid", F.col("_to").alias("level"))
        reached = cut_lineage(reached.unionByName(further).distinct())
        grown = reached.count()
        if grown == size:
            break
        size = grown
        hop = cut_lineage(hop.join(second, (F.col("pid") == F.col("_pid")) & (F.col("to") == F.col("_from")))
                          .select("pid", "from", F.col("_to").alias("to")))
    return highs.join(reached.withColumnRenamed("level", "current"), ["pid", "current"])


def site_counts(events: DataFrame) -> DataFrame:
    """Allocations, frees and bytes of each call site."""
    alloc = F.col("is_alloc")
    return events.groupBy("pid", "site").agg(
        F.count_if(alloc).alias("mallocs"), F.count_if(~alloc).alias("frees"),
        F.sum(F.when(alloc, F.col("size")).otherwise(-F.coalesce("matched_size", F.lit(0)))).alias("bytes"),
        F.min(F.when(alloc, F.col("t"))).alias("first_alloc"), F.max(F.when(alloc, F.col("t"))).alias("last_alloc"),
        F.min_by(F.when(alloc, F.col("current")), F.when(alloc, F.struct(*ORDER))).alias("first_total"),
    )


def leak_score(mallocs: Column, frees: Column) -> Column:
    """Rule of succession on unfreed allocations, clipped to [0, 1]."""
    score = 1.0 - (frees + 1) / (mallocs - frees + 2)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when((mallocs == 0) | (mallocs - frees + 2 <= 0), 0.0).otherwise(clipped)


def growth_rate(total: Column, first_total: Column, first_alloc: Column, last_alloc: Column) -> Column:
    """Share of the site in its own bytes plus the level when it was first seen."""
    return F.when((first_alloc == last_alloc) | (first_total + total == 0), 0.0).otherwise(total / (first_total + total))


def tracked_sites(timeline: DataFrame, marks: DataFrame) -> DataFrame:
    """Events of sites from the first mark they set on. The first mark of a process only
    starts its history and tracks nothing."""
    at = F.struct(*ORDER)
    opening = marks.groupBy("pid").agg(F.min(at).alias("_opening"))
    starts = (
        marks.join(opening, "pid").filter(at > F.col("_opening"))
        .groupBy("pid", "site").agg(F.min(at).alias("_start"))
    )
    return timeline.join(starts, ["pid", "site"]).filter(at >= F.col("_start")).drop("_start")


def scored_sites(sites: DataFrame) -> DataFrame:
    """Sites with ``leak_score`` and ``growth``."""
    return sites.withColumns({
        "leak_score": leak_score(F.col("mallocs"), F.col("frees")),
        "growth": growth_rate(*[F.col(c) for c in ("bytes", "first_total", "first_alloc", "last_alloc")]),
    })


def leak_suspects(sites: DataFrame, score: float = LEAK_SCORE, growth: float = LEAK_GROWTH) -> DataFrame:
    """Sites over both limits with MB per allocation and second, highest first."""
    seconds = F.floor((F.col("last_alloc") - F.col("first_alloc")) / 1_000_000)
    rate = F.when(seconds > 0, F.col("bytes") / (1024.0 * 1024.0) / F.col("mallocs") / seconds).otherwise(0.0)
    return (
        scored_sites(sites).filter((F.col("leak_score") >= score) & (F.col("growth") >= growth))
        .withColumn("rate", rate).orderBy(F.desc("rate"), "pid", "site")
    )


def old_allocations(live: DataFrame, now: Column, age_s: int = LEAK_AGE_S, large: int = LARGE_LEAK) -> DataFrame:
    """Live allocations older than the age, with ``is_large``."""
    age = F.floor((now - F.col("t")) / 1_000_000)
    return live.withColumn("age_s", age).filter(F.col("age_s") > age_s).withColumn("is_large", F.col("size") > large)


def shortage(live: DataFrame, capacity: int, share: float = SHORTAGE_SHARE) -> DataFrame:
    """Bytes in use, failed allocations and whether memory is short."""
    used = F.coalesce(F.sum(F.when(F.col("ret") == 0, F.col("size"))), F.lit(0))
    out = live.agg(used.alias("used"), F.count_if(F.col("ret") != 0).alias("failed"))
    return out.withColumn("used_share", F.col("used") / F.lit(float(capacity))).withColumn(
        "short", (F.col("used_share") > share) | (F.col("failed") > 0))


def exited_with_leaks(live: DataFrame, exits: DataFrame) -> DataFrame:
    """Live allocations and bytes of processes that have ended."""
    return exits.join(live, "pid", "left").groupBy("pid").agg(
        F.count("addr").alias("allocations"), F.coalesce(F.sum("size"), F.lit(0)).alias("leaked_bytes"))


# --- fragmentation -------------------------------------------------------------------

def failed_allocations(allocs: DataFrame) -> DataFrame:
    """Allocations that failed; they take no part in the block set."""
    return allocs.filter(F.col("ret") != 0)


def oom_flags(allocs: DataFrame, within_s: int = OOM_WITHIN_S) -> DataFrame:
    """Per snapshot: did an allocation fail in the last seconds before it."""
    recent = (F.col("ret") != 0) & (F.floor((F.col("snapshot_t") - F.col("t")) / 1_000_000) <= within_s)
    return allocs.groupBy("snapshot").agg(F.max(recent).alias("is_oom"))


def merged_blocks(blocks: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Blocks of a snapshot joined where one starts at the end of the other."""
    order = [F.col("address"), F.col("size")]
    ended = {"_end": F.col("address") + F.col("size")}
    runs = islands(blocks, ["snapshot"], order, F.col("_end").isNull() | (F.col("_end") != F.col("address")), ended,
                   max_rows=max_rows)
    return runs.groupBy("snapshot", "island").agg(
        F.min("address").alias("address"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("blocks")).drop("island")


def gaps(blocks: DataFrame, min_gap: int = MIN_GAP, max_rows: int | None = None) -> DataFrame:
    """Free space before each block, over ``min_gap``."""
    looked = previous(blocks, ["snapshot"], [F.col("address"), F.col("size")],
                      {"_end": F.col("address") + F.col("size")}, max_rows)
    return looked.withColumn("gap", F.col("address") - F.col("_end")).filter(F.col("gap") > min_gap).drop("_end")


def fragmentation(blocks: DataFrame, page: int = PAGE, small: int = SMALL_BLOCK, min_gap: int = MIN_GAP,
                  max_rows: int | None = None) -> DataFrame:
    """Fragmentation metrics of each snapshot."""
    size = F.col("size")
    base = blocks.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(size).alias("allocated"),
        (F.max_by(F.col("address") + size, F.struct("address", "size")) - F.min("address")).alias("address_space"),
        F.avg(size).alias("mean_size"), F.stddev_pop(size).alias("_sd"),
        (F.count_if(size <= small) / F.count(F.lit(1))).alias("small_ratio"),
    )
    free = gaps(blocks, min_gap, max_rows)
    gap_sums = free.groupBy("snapshot").agg(
        F.sum("gap").alias("gap_total"), F.count(F.lit(1)).alias("gap_count"), F.max("gap").alias("largest_gap"))
    shaped = base.join(gap_sums, "snapshot", "left").fillna(0, ["gap_total", "gap_count", "largest_gap"])
    block = F.when(F.col("mean_size") > 0, F.greatest(
        (F.pow(F.lit(2.0), F.ceil(F.log2("mean_size"))) * 2).cast("long"), F.lit(page))).otherwise(F.lit(page))
    shaped = shaped.withColumns({
        "target_block": block.cast("long"),
        "free_pages": F.ceil(F.col("gap_total") / page),
        "_mean_gap": F.when(F.col("gap_count") > 0, F.floor(F.col("gap_total") / F.col("gap_count"))),
    })
    fits = free.join(shaped.select("snapshot", "target_block", "_mean_gap"), "snapshot").groupBy("snapshot").agg(
        F.sum(F.floor(F.col("gap") / F.col("target_block"))).alias("suitable_blocks"),
        F.coalesce(F.sum(F.when(F.col("gap") > 2 * F.col("_mean_gap"), F.col("gap"))), F.lit(0)).alias("_large_gaps"),
    )
    out = shaped.join(fits, "snapshot", "left").fillna(0, ["suitable_blocks", "_large_gaps"])
    per_page = F.greatest(F.lit(1), F.floor(F.col("target_block") / page))
    possible = F.floor(F.col("free_pages") / per_page)
    unusable = F.pow(1.0 - F.least(F.lit(1.0), F.col("suitable_blocks") / possible), F.lit(0.25))
    space = F.col("address_space")
    return out.withColumns({
        "external_ratio": F.when(space > 0, F.col("gap_total") / space).otherwise(0.0),
        "unusable_index": F.when(F.col("free_pages") == 0, 0.0).when(possible > 0, unusable).otherwise(1.0),
        "size_variation": F.when(F.col("mean_size") > 0, F.col("_sd") / F.col("mean_size")).otherwise(0.0),
        "utilization": F.when(space > 0, F.col("allocated") / space).otherwise(0.0),
        "large_gap_ratio": F.when(F.col("gap_total") > 0, F.col("_large_gaps") / F.col("gap_total")).otherwise(0.0),
    }).drop("_sd", "_mean_gap", "_large_gaps")


def fragmentation_score(metrics: DataFrame) -> DataFrame:
    """Weighted score from 0 to 100."""
    one = F.lit(1.0)
    pattern = F.col("small_ratio") * 0.6 + F.least(one, F.col("size_variation")) * 0.4
    score = (
        F.least(F.col("external_ratio") * 2, one) * SCORE_WEIGHTS["external"]
        + F.least(one, F.col("unusable_index") / 10.0) * SCORE_WEIGHTS["unusable"]
        + pattern * SCORE_WEIGHTS["pattern"] + F.col("large_gap_ratio") * SCORE_WEIGHTS["large_gaps"]
    )
    return metrics.withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))


def severity(scored: DataFrame) -> DataFrame:
    """Severity band, and the reasons given in the severest one."""
    reasons = F.array_compact(F.array(
        F.when(F.col("external_ratio") > 0.4, "external"), F.when(F.col("unusable_index") > 5.0, "unusable"),
        F.when(F.col("small_ratio") > 0.7, "small_blocks"), F.when(F.col("utilization") < 0.6, "utilization")))
    return scored.withColumns({
        "severity": _banded(F.col("score"), SEVERITY),
        "reasons": F.when(F.col("score") >= SEVERITY[0][0], F.concat_ws(",", reasons)).otherwise(""),
    })


def score_trend(scored: DataFrame, keys: Sequence[str], order: Sequence[Column], history: int = TREND_HISTORY,
                max_rows: int | None = None) -> DataFrame:
    """Least-squares slope and volatility of the scores before each row (A29, part of D12)."""
    counted = large(scored, keys, max_rows)
    rows = numbered(scored, keys, order, "_pos", max_rows, counted)

    def add(part: DataFrame, window) -> DataFrame:
        frame = window.rowsBetween(-history, -1)
        n = F.count("score").over(frame)
        return part.withColumns({
            "trend": F.when(n >= 2, F.regr_slope("score", "_pos").over(frame)).otherwise(0.0),
            "volatility": F.when(n >= 3, F.stddev_pop("score").over(frame) / 100.0).otherwise(0.0),
        })

    return framed(rows, keys, order, add, before=history, max_rows=max_rows, counted=counted).drop("_pos")


def _fit_and_forecast(features: np.ndarray, scores: np.ndarray) -> tuple[list[float], float]:
    """Three linear models on the last windows of one short series, fitted by clipped descent."""
    if len(scores) < FORECAST_WINDOW + FORECAST_STEPS:
        return [float(scores[-1])] * FORECAST_STEPS, 0.3
    spread = features.std(axis=0)
    z = (features - features.mean(axis=0)) / np.where(spread < 1e-8, 1.0, spread)
    mean, sd = scores.mean(), scores.std()
    sd = 1.0 if sd < 1e-8 else sd
    y = (scores - mean) / sd

    def window_at(i: int) -> np.ndarray:
        return np.concatenate([z[i - FORECAST_WINDOW:i].ravel(), y[i - FORECAST_WINDOW:i]])

    last = len(y) - FORECAST_STEPS
    starts = range(max(FORECAST_WINDOW, last - FORECAST_WINDOW), last + 1)
    design = np.array([window_at(i) for i in starts])
    now = window_at(len(y))
    out, errors = [], []
    for step in range(FORECAST_STEPS):
        target = y[[i + step for i in starts]]
        w, b = np.zeros(design.shape[1]), 0.0
        for _ in range(500):
            error = design @ w + b - target
            gw, gb = design.T @ error, error.sum()
            norm = float(np.sqrt(gw @ gw + gb * gb))
            scale = 0.01 / len(starts) / max(norm, 1.0)
            w, b = np.clip(w - scale * gw, -10, 10), float(np.clip(b - scale * gb, -10, 10))
        out.append(float(np.clip((now @ w + b) * sd + mean, 0, 100)))
        errors.append(np.abs(design @ w + b - target).mean() * sd)
    return out, float(max(0.1, 1.0 - np.mean(errors) / 50.0))


def forecast(scored: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The next three scores of each series from its last 50 samples.

    The row limit applies before the shuffle, so a group never exceeds 50 rows.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc(at))
    recent = (
        scored.select(*keys, at, "score", *FEATURES).withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") <= FORECAST_HISTORY).drop("_rn")
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        steps, confidence = _fit_and_forecast(pdf[FEATURES].to_numpy(float), pdf["score"].to_numpy(float))
        row = {**{k: pdf[k].iloc[0] for k in keys}, at: pdf[at].iloc[-1], "samples": len(pdf),
               **{f"next_{i + 1}": v for i, v in enumerate(steps)}, "confidence": confidence}
        return pd.DataFrame([row])

    fields = [f for f in scored.schema if f.name in (*keys, at)]
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for k in (*keys, at) for f in fields if f.name == k)
    schema = f"{key_types}, samples long, next_1 double, next_2 double, next_3 double, confidence double"
    return recent.groupBy(*keys).applyInPandas(one, schema)


def forecast_risk(predicted: DataFrame) -> DataFrame:
    """Risk band and warnings (D12). Rows carry the forecast, ``score``, ``trend``,
    ``volatility``, ``external_ratio``, ``unusable_index``."""
    steps = [F.col(f"next_{i}") for i in (1, 2, 3)]
    enough = F.col("samples") >= FORECAST_WINDOW + FORECAST_STEPS
    warnings = [F.when(s > F.col("score") + 5.0, f"worse_in_{i}") for i, s in enumerate(steps, 1)]
    warnings += [F.when(b - a > 10.0, f"jump_in_{i}") for i, (a, b) in enumerate(zip(steps, steps[1:]), 2)]
    warnings += [
        F.when(F.col("trend") > 0.3, "rising"), F.when(F.col("volatility") > 0.2, "volatile"),
        F.when(F.col("confidence") < 0.6, "low_confidence"),
        F.when((F.col("external_ratio") > 0.4) & (F.col("trend") > 0.1), "external_rising"),
        F.when(F.col("unusable_index") > 0.5, "large_blocks_at_risk"),
    ]
    return predicted.withColumns({
        "risk": F.when(enough, _banded(F.greatest(*steps), RISK)).otherwise("INSUFFICIENT_DATA"),
        "warnings": F.when(enough, F.concat_ws(",", F.array_compact(F.array(*warnings)))).otherwise("short_history"),
    })
