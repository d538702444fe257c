"""Windows over a key that is too big for one task give what a plain window gives."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge import ordered
from tallyforge.ranges import contained_points, overlap_join


def table(spark, n=600, seed=3):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", rng.randrange(50), i, rng.choice([None, rng.randrange(-9, 9)]))
            for i in range(n)]
    return spark.createDataFrame(data, "key string, t long, seq long, v long").repartition(5)


ORDER = ["t", "seq"]


def cols():
    return [F.col(c) for c in ORDER]


def test_lag_lead_and_frames_do_not_depend_on_splitting(spark, rows):
    df = table(spark)

    def add(part, window):
        return part.withColumns({
            "lag": F.lag("v").over(window), "lead": F.lead("v", 2).over(window),
            "mean": F.avg("v").over(window.rowsBetween(-4, 3)), "n": F.count(F.lit(1)).over(window.rowsBetween(-4, 0))})

    want = rows(add(df, Window.partitionBy("key").orderBy(*ORDER)), *df.columns, "lag", "lead", "mean", "n")
    for limit in (9, 40, 10_000):
        assert rows(ordered.framed(df, ["key"], cols(), add, before=4, after=3, max_rows=limit), *df.columns, "lag", "lead", "mean", "n") == want


def test_running_values_do_not_depend_on_splitting(spark, rows):
    df = table(spark)
    frame = Window.partitionBy("key").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.withColumns({
        "s": F.sum("v").over(frame), "hi": F.max("v").over(frame), "lo": F.min("v").over(frame),
        "last": F.last("v", ignorenulls=True).over(frame)}), *df.columns, "s", "hi", "lo", "last")
    spec = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))}
    for limit in (7, 55, 10_000):
        got = ordered.running(df, ["key"], cols(), spec, max_rows=limit)
        assert rows(got, *df.columns, "s", "hi", "lo", "last") == want


def test_islands_and_numbers_across_task_borders(spark, rows):
    df = table(spark).withColumn("state", F.col("t") % 3)
    starts = F.col("_was").isNull() | (F.col("_was") != F.col("state"))
    plain = rows(ordered.islands(df, ["key"], cols(), starts, {"_was": F.col("state")}), "key", "seq", "island")
    split = rows(ordered.islands(df, ["key"], cols(), starts, {"_was": F.col("state")}, max_rows=8), "key", "seq", "island")
    assert plain == split
    assert rows(ordered.numbered(df, ["key"], cols(), "n", 8), "key", "seq", "n") == rows(ordered.numbered(df, ["key"], cols(), "n"), "key", "seq", "n")


def test_null_keys_are_one_key(spark, rows):
    df = spark.createDataFrame([(None, i, i, i) for i in range(30)] + [("a", 1, 1, 1)], "key string, t long, seq long, v long")
    got = rows(ordered.running(df, ["key"], cols(), {"s": ("sum", F.col("v"))}, max_rows=7), "seq", "s")
    assert (29, sum(range(30))) in got and len(got) == 31


def test_only_keys_over_the_limit_are_hot(spark):
    df = table(spark)
    assert ordered.hot_keys(df, ["key"], 100).count() == 1
    assert ordered.hot_keys(df, ["key"], 10_000) is None
    assert ordered.hot_keys(df, ["key"]) is None


def test_interval_join_against_all_pairs(spark, rows):
    rng = random.Random(5)
    left = [(rng.randrange(3), i, s, s + rng.choice([0, 3, 70, 900, 100_000])) for i in range(120) for s in [rng.randrange(-500, 5000)]]
    right = [(rng.randrange(3), i, s, s + rng.choice([0, 1, 64, 4000])) for i in range(120) for s in [rng.randrange(-500, 5000)]]
    a = spark.createDataFrame(left, "g long, a long, a0 long, a1 long")
    b = spark.createDataFrame(right, "g long, b long, b0 long, b1 long")
    got = rows(overlap_join(a, b, ["g"], ("a0", "a1"), ("b0", "b1")), "a", "b")
    want = sorted(((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]), key=repr)
    assert got == want
    points = spark.createDataFrame([(g, i, t) for g, i, t, _ in right], "g long, b long, p long")
    got = rows(contained_points(a, points, ["g"], "a0", "a1", "p"), "a", "b")
    assert got == sorted(((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[2] <= x[3]), key=repr)


def test_keys_counted_once_serve_a_chain_and_parts_of_the_rows(spark, rows):
    df = table(spark)
    window = Window.partitionBy("key").orderBy(*ORDER)
    part = df.filter("seq % 3 <> 0")
    want = rows(df.withColumn("n", F.sum("seq").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("was", F.lag("n").over(window)), *df.columns, "n", "was")
    after = rows(part.withColumn("next", F.lead("v").over(window)), *df.columns, "next")
    for limit in (9, 40, 10_000):
        counted = ordered.large(df, ["key"], limit)
        summed = ordered.running(df, ["key"], cols(), {"n": ("sum", F.col("seq"))}, limit, counted)
        assert rows(ordered.previous(summed, ["key"], cols(), {"was": F.col("n")}, limit, counted), *df.columns, "n", "was") == want
        assert rows(ordered.following(part, ["key"], cols(), {"next": F.col("v")}, limit, counted), *df.columns, "next") == after
