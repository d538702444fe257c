"""Spans and the points in them against a comparison of all pairs."""

import random

from pyspark.sql import functions as F

from tallyforge import ranges
from tallyforge.operators import trace as tr


def made(spark, seed):
    rng = random.Random(seed)
    spans = [(i, rng.choice("ab"), s, s + rng.choice([-1, 0, 1, 2, 3, 7, 8, 30, 200])) for i, s in enumerate(rng.randint(-40, 200) for _ in range(60))]
    points = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice([rng.randint(-50, 220), 17, None])) for _ in range(250)]
    spans.append((60, None, 0, 100))
    return (spark.createDataFrame(spans, "id long, key string, start long, end long").repartition(3),
            spark.createDataFrame(points, "key string, kind string, at long").repartition(3), spans, points)


def test_kinds_within_equal_all_pairs(spark, rows):
    for seed, most in ((1, None), (2, 20)):
        spans, points, a, b = made(spark, seed)
        expected = sorted({(i, kind) for i, key, s, e in a for k, kind, t in b if key == k and key and t is not None and s <= t <= e}, key=repr)
        assert rows(ranges.kinds_within(spans, points, ["key"], ["kind"], "start", "end", "at", most), "id", "kind") == expected


def test_contained_points_equal_all_pairs(spark, rows):
    spans, points, a, b = made(spark, 3)
    expected = sorted([(i, kind, t) for i, key, s, e in a for k, kind, t in b if key == k and key and t is not None and s <= t <= e], key=repr)
    assert rows(ranges.contained_points(spans, points, ["key"], "start", "end", "at"), "id", "kind", "at") == expected


def test_a_call_comes_once_with_each_kind_of_change(spark, rows):
    calls = spark.createDataFrame([(0, "c1", "f", 0, 1000), (0, "c2", "f", 500, 500), (1, "c3", "f", 0, 1000)],
                                  "process_id int, call_id string, function string, start long, end long")
    changes = spark.range(0, 2000, 5).selectExpr(
        "0 as process_id", "'p' as var_name", "'t' as var_type", "'a' as attr", "id as time", "'0' as old_value", "cast(id % 2 as string) as new_value")
    got = tr.changes_in_calls(calls, changes, ["attr", "new_value"])
    assert rows(got, "parent_id", "attr", "new_value") == [("c1", "a", "0"), ("c1", "a", "1"), ("c2", "a", "0")]
    of_variable = tr.changes_in_calls(calls.selectExpr("*", "'p' as var_name", "'t' as var_type"), changes, [], ["process_id", "var_name", "var_type"])
    assert rows(of_variable, "parent_id", "var_name") == [("c1", "p"), ("c2", "p")]


def test_a_skipped_part_is_looked_for_in_one_pass_over_the_name(spark, rows):
    of = spark.createDataFrame([("mod.view_1",), ("a.torch.autograd.b",), ("x._y",), ("torchXautograd",), (None,), ("a\nb(c)[d]",)], "function string")
    kept = tr.analysable(of.selectExpr("upper(lower(function)) as function").selectExpr("lower(function) as function"), [*tr.SKIPPED_FUNCTIONS, "(c)["])
    assert rows(kept) == [("mod.view_1",), ("torchxautograd",)]
    names = tr.analysable(spark.range(4).select(F.concat(F.lit("mod."), F.upper(F.lower(F.col("id").cast("string")))).alias("function")))
    assert names._jdf.queryExecution().optimizedPlan().toString().count("upper(") <= 3


def test_kind_sets_equal_all_pairs(spark, rows):
    for seed, most in ((4, None), (5, 20)):
        spans, points, a, b = made(spark, seed)
        expected = sorted({(i, kind) for i, key, s, e in a for k, kind, t in b if key == k and key and t is not None and s <= t <= e}, key=repr)
        sets = ranges.kind_sets_within(spans, points, ["key"], ["kind"], "start", "end", "at", most)
        listed = sets.rows.alias("r").join(sets.kinds.alias("k"), F.expr("r._word = k._word and r._bits = k._bits"))
        assert rows(listed, "id", "kind") == expected
