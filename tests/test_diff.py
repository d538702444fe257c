"""Nearest records of two runs against a comparison of all lines."""

import random

from tallyforge.operators import diff

SCHEMA = "idx long, kind string, content map<string,string>"


def by_hand(left, right, most):
    def clean(content):
        return {k: v for k, v in content.items() if not any(k.endswith(e) for e in diff.IGNORED_ENDINGS)}

    out = []
    for i, kind, content in left:
        a = clean(content)
        near = []
        for j, other, more in right:
            b = clean(more)
            apart = sum((k in a) != (k in b) or (a.get(k) or "None") != (b.get(k) or "None") for k in a.keys() | b.keys())
            if kind == other and apart <= most:
                near.append((apart, j))
        if near:
            out.append((i, min(near)[1], min(near)[0]))
    return sorted(out, key=repr)


def test_nearest_records_equal_all_pairs(spark, rows):
    rng = random.Random(12)

    def run(n):
        out = []
        for i in range(n):
            keys = rng.sample(["function", "user", "size", "note", "mode", "device", "call_id", "deep"], rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 7]))
            out.append((i, rng.choice("ab"), {k: rng.choice(["1", "2", "3", "x", None]) for k in keys}))
        return out

    left, right = run(70), run(60)
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (left, right))
    for most in (0, 2, 4, 7):
        assert rows(diff.nearest_records(a, b, most), "left_idx", "right_idx", "differing") == by_hand(left, right, most)
    assert diff.nearest_records(a, b.filter("false")).count() == 0 and diff.nearest_records(a.filter("false"), b).count() == 0


def groups_by_hand(lines, keys):
    def near(a, b):
        return sum(a.get(k) != b.get(k) for k in a.keys() | b.keys()) <= keys

    found = []
    for _, content in lines:
        group = next((g for g in found if any(content == c for c in g[1:])), None)
        group = group or next((g for g in found if near(g[0], content)), None)
        if group is None:
            found.append([content, content])
        else:
            group.append(content)
    return sorted(((len(g) - 1, len({tuple(sorted(c.items())) for c in g})) for g in found), key=repr)


def test_line_patterns_equal_one_pass_over_all_lines(spark, rows):
    rng = random.Random(5)
    for names, few in ((["a", "b", "c", "d", "e"], 5), (["a", "b", "c", "d", "e", "f"], 1)):
        lines = [(i, {k: rng.choice("xyzuvw") for k in rng.sample(names, rng.randint(few, len(names)))}) for i in range(150)]
        got = diff.line_patterns(spark.createDataFrame(lines, "idx long, content map<string,string>").repartition(3))
        assert rows(got, "times", "variants") == groups_by_hand(lines, 3)


def test_line_patterns_keep_no_pairs_of_lines_that_lead_nothing(spark, monkeypatch):
    kept = []

    def counted(df):
        kept.append((out := cut(df)).count())
        return out

    cut = diff.cut_lineage
    monkeypatch.setattr(diff, "cut_lineage", counted)
    lines = [(i, {"a": "x", "b": "y", **{k: chr(97 + i // 8**n % 8) for n, k in enumerate("cde")}}) for i in range(400)]
    out = diff.line_patterns(spark.createDataFrame(lines, "idx long, content map<string,string>")).collect()
    assert [(r.times, r.variants) for r in out] == [(400, 400)]
    assert max(kept) <= 400 * 10  # ten signatures a line; the pairs are 79,800


def test_the_maps_of_f8_are_made_behind_the_join(spark, tmp_path):
    from tallyforge.plans import QUERIES

    spark.createDataFrame([(1, "A", "O", 1), (1, "N", "F", 2), (2, "R", "O", 3)], "l_orderkey long, l_returnflag string, l_linestatus string, l_linenumber int").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "O", 8, "1-HIGH"), (2, "F", 3, "2-LOW")], "o_orderkey long, o_orderstatus string, o_custkey long, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")
    out = QUERIES["f8_differing_keys"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, "F", 4, 1), (1, "O", 2, 1), (2, "O", 3, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("map(flag") < plan.index("Join Inner")  # a plan is written from its end
    assert "map(" not in plan[plan.index("Join Inner"):]
