"""Pairing, statistics and memory detectors against step-by-step restatements."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import events, memory, pairing, rules, stats


def allocations(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2]), rng.randrange(40), rng.random() < 0.6, rng.randrange(1, 500), rng.randrange(5), i, i) for i in range(n)]
    return data, spark.createDataFrame(data, "pid long, addr long, is_alloc boolean, size long, site long, t long, seq long")


def test_pairs_follow_a_pending_map(spark, rows):
    rng = random.Random(2)
    data = [(rng.randrange(4), rng.random() < 0.5, i, i) for i in range(300)]
    pending, want = {}, []
    for key, enter, t, _ in data:
        if enter:
            pending[key] = t
        elif key in pending:
            want.append((key, pending.pop(key), t))
    df = spark.createDataFrame(data, "key long, is_enter boolean, t long, seq long")
    for limit in (None, 11):
        assert rows(pairing.pair_latest(df, ["key"], max_rows=limit), "key", "start_t", "t") == sorted(want, key=repr)


def test_memory_level_and_peak(spark, rows):
    data, df = allocations(spark)
    level, peak, held, want = {}, {}, {}, []
    for pid, addr, alloc, size, _, t, _ in data:
        if alloc:
            level[pid] = level.get(pid, 0) + size
            held[pid, addr] = size
        else:
            level[pid] = max(0, level.get(pid, 0) - held.pop((pid, addr), size))
        peak[pid] = max(peak.get(pid, 0), level[pid])
        want.append((t, level[pid], peak[pid]))
    for limit in (None, 30):
        assert rows(stats.memory_timeline(df, limit), "t", "current", "peak") == sorted(want, key=repr)


def test_high_water_marks_follow_the_greedy_rule(spark, rows):
    data, df = allocations(spark, seed=4)
    timeline = stats.memory_timeline(df)
    step, mark, want = 700, {}, []
    for r in sorted(timeline.collect(), key=lambda r: r.t):
        if r.is_alloc and r.current > mark.get(r.pid, 0) + step:
            mark[r.pid] = r.current
            want.append((r.pid, r.t))
    assert len(want) > 5
    assert rows(memory.high_water_marks(timeline, step), "pid", "t") == sorted(want, key=repr)


def test_active_functions_never_fall_under_zero(spark, rows):
    rng = random.Random(6)
    data = [(1, rng.random() < 0.45, i, i) for i in range(200)]
    n, want = 0, []
    for _, enter, t, _ in data:
        n = n + 1 if enter else max(0, n - 1)
        want.append((t, n))
    df = spark.createDataFrame(data, "tgid long, is_enter boolean, t long, seq long")
    assert rows(stats.active_functions(df, 25), "t", "active") == sorted(want, key=repr)


def test_fragmentation_of_a_known_map(spark):
    blocks = spark.createDataFrame([(1, 0, 4096), (1, 4096, 4096), (1, 1_000_000, 4096), (2, 0, 100)], "snapshot long, address long, size long")
    m = {r.snapshot: r for r in memory.fragmentation(blocks).collect()}
    assert (m[1].gap_total, m[1].gap_count, m[1].address_space) == (1_000_000 - 8192, 1, 1_004_096)
    assert m[2].unusable_index == 0.0 and m[2].external_ratio == 0.0
    merged = sorted(tuple(r) for r in memory.merged_blocks(blocks).select("snapshot", "address", "size", "blocks").collect())
    assert merged == [(1, 0, 8192, 2), (1, 1_000_000, 4096, 1), (2, 0, 100, 1)]
    assert memory.severity(memory.fragmentation_score(memory.fragmentation(blocks))).filter("severity = 'mild'").count() <= 2


def test_short_series_have_no_forecast(spark):
    cols = ", ".join(f"{f} double" for f in memory.FEATURES)
    data = [(0, i, 40.0 + i, *[0.1] * 6) for i in range(5)] + [(1, i, 10.0 + 2 * i, *[0.01 * i] * 6) for i in range(30)]
    df = spark.createDataFrame(data, f"series long, snapshot long, score double, {cols}")
    out = {r.series: r for r in memory.forecast(df, ["series"], "snapshot").collect()}
    assert (out[0].next_1, out[0].confidence) == (44.0, 0.3)
    assert out[1].next_1 > 50 and out[1].samples == 30


def test_stack_slices_nest(spark):
    data = [(1, 10, 1, ["a", "b"]), (1, 20, 2, ["a", "c", "d"]), (1, 30, 3, ["e"])]
    df = spark.createDataFrame(data, "pid long, t long, seq long, frames array<string>")
    out = [tuple(r) for r in events.stack_slices(df).orderBy("ts").select("ts", "phase", "name").collect()]
    assert sorted(out) == sorted([
        (10, "B", "a"), (11, "B", "b"), (20, "E", "b"), (21, "B", "c"), (22, "B", "d"),
        (30, "E", "d"), (31, "E", "c"), (32, "E", "a"), (33, "B", "e"), (31, "E", "e")])
    assert sum(1 for _, p, _ in out if p == "B") == sum(1 for _, p, _ in out if p == "E")


def test_io_rules_need_ten_operations(spark):
    data = [(1, 100, 1000, i, i) for i in range(12)] + [(1, 100, 200_000, 12, 12), (1, 20_000_000, 5, 13, 13)]
    df = spark.createDataFrame(data, "pid long, bytes long, latency_us long, t long, seq long")
    assert sorted((r.t, r.rule) for r in rules.io_rules(df).collect()) == [(12, "slow"), (12, "spike"), (13, "large")]


def test_trailing_statistics_split_the_same(spark, rows):
    data, df = allocations(spark)
    line = stats.memory_timeline(df)
    assert rows(rules.memory_trend(line), "t", "up", "down", "flat") == rows(rules.memory_trend(line, max_rows=30), "t", "up", "down", "flat")
    net = df.select("pid", "size", F.col("is_alloc").alias("is_send"), (F.col("t") * F.col("t") * 100_000).alias("t"), "seq")
    short = dict(history=20)
    assert rows(rules.traffic_bursts(net, **short), "seq") == rows(rules.traffic_bursts(net, max_rows=30, **short), "seq")


def test_timeline_deals_its_rows_once(spark):
    # Pairing the frees and the running values of a process need one shuffle of the rows, not one each.
    _, df = allocations(spark)
    line = stats.memory_timeline(df)
    line.collect()
    plan = line._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(pid") == 1 and "hashpartitioning(pid, addr" not in plan
    assert "hashpartitioning(pid#" in plan
