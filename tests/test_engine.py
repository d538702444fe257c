"""The relation engine: rules proposed in one trace and judged in others, also where nothing there would propose them."""

from pyspark.sql import functions as F

from tallyforge.operators import engine as eng
from tallyforge.operators import preconditions as pc
from tallyforge.operators import relations as rel

CALLS = "process_id long, thread_id long, call_id string, function string, start long, end long, stage string, mode string"
STATES = "process_id long, var_name string, var_type string, attr string, value string, start long"


def trace(spark, calls, states=()):
    of = spark.createDataFrame([(1, 1, *c) for c in calls], CALLS)
    outputs = of.select("function", "call_id", F.col("start").alias("time"), F.lit("mode").alias("prop"), F.col("mode").alias("value"))
    fields = of.select(F.col("call_id").alias("example"), F.array(
        F.struct(F.lit("meta_vars.stage").alias("field"), F.lit("str").alias("kind"), F.col("stage").alias("value")),
        F.struct(F.lit("attributes.mode").alias("field"), F.lit("str").alias("kind"), F.col("mode").alias("value"))).alias("fields"))
    held = spark.createDataFrame(list(states), STATES)
    variables = held.select(F.concat_ws("/", "process_id", "var_name", "attr").alias("example"), F.array().cast(
        fields.schema["fields"].dataType).alias("fields")).distinct()
    return eng.Trace(of, outputs, held, fields.unionByName(variables))


def outer(n, child, stage, mode="x"):
    """Call n of function step, with a call of work inside or without."""
    rows = [(f"s{n}", "step", n * 100, n * 100 + 50, stage, mode)]
    return rows + ([(f"w{n}", "work", n * 100 + 10, n * 100 + 20, stage, mode)] if child else [])


def test_rules_hold_under_a_base_clause_and_break_elsewhere(spark, rows):
    good = trace(spark, [r for n in range(6) for r in outer(n, n % 3 != 2, "eval" if n % 3 == 2 else "train")])
    contain = {"contain": eng.POOL["contain"]}
    rules = eng.learned([good], contain)
    assert [(r.positives, r.negatives, r.kind, [tuple(c) for c in r.clauses]) for r in rules.collect()] == [
        (4, 2, "base", [("meta_vars.stage", "constant", "train")])]
    # no call of step holds anything here, so this trace proposes no rule; the learned one is broken all the same
    bad = trace(spark, outer(1, False, "eval") + outer(7, False, "train") + outer(8, False, "train"))
    assert eng.proposed([bad], contain).count() == 0
    assert rows(eng.checked(bad, rules, contain)) == [("contain", ["step", "work"], "failed", 2, "s7", 700)]
    assert rows(eng.checked(trace(spark, outer(1, False, "eval")), rules, contain), "outcome", "examples") == [("not_triggered", 0)]
    assert rows(eng.checked(trace(spark, outer(1, True, "train")), rules, contain), "outcome") == [("passed",)]


def test_open_rules_are_split(spark):
    # work is inside when the stage is train, or else when the mode is a
    calls = [r for n, (stage, mode) in enumerate([("train", "a"), ("train", "b"), ("eval", "a"), ("eval", "b")] * 2)
             for r in outer(n, stage == "train" or mode == "a", stage, mode)]
    contain = {"contain": eng.POOL["contain"]}
    t = trace(spark, calls)
    known = eng.patterns(eng.judged(t, eng.proposed([t], contain), contain))
    rules = eng.first_level(known)
    assert {r.kind for r in rules.collect()} == {"open"}
    found = pc.preconditions_as_sets(eng.searched(known, rules)).collect()
    assert {tuple(r.clauses) for r in found} == {("meta_vars.stage|constant|train",), ("attributes.mode|constant|a",)}


def test_all_relations_and_several_traces(spark, rows):
    states = [(1, "p", "layer", "grad", str(n % 2), n) for n in range(14)] + [(1, "q", "layer", "grad", "0", 0)]
    one = trace(spark, [r for n in range(3) for r in outer(n, True, "train")], states)
    two = trace(spark, [(c.replace("s", "t").replace("w", "v"), *rest) for n in range(3) for c, *rest in outer(n, True, "train", "y")])
    learned = eng.learned([one, two]).withColumn("rule", F.array_join("parts", "|"))
    got = {(r.relation, r.rule): (r.positives, r.negatives, r.kind) for r in learned.collect()}
    assert got["contain", "step|work"] == (6, 0, "unconditional")
    # the last step is followed by a work call of its own, the first work by no step before the next work
    assert got["lead", "step|work"] == (6, 0, "unconditional") and got["cover", "work|step"] == (6, 0, "unconditional")
    assert got["consistent_output", "step|mode|x"] == (3, 3, "base")
    assert set(eng.chosen(enabled=["lead"])) == {"lead"} and "lead" not in eng.chosen(disabled=["lead"])
    assert rows(eng.POOL["periodic"].judge(one, eng.POOL["periodic"].hypotheses(one)), "parts", "polarity", "example") == [
        (["layer", "grad", "0"], 0, "1/q/grad"), (["layer", "grad", "0"], 1, "1/p/grad"),
        (["layer", "grad", "1"], 0, "1/q/grad"), (["layer", "grad", "1"], 1, "1/p/grad")]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_patterns_are_counted_without_sorting_examples(spark):
    contain = {"contain": eng.POOL["contain"]}
    t = trace(spark, [r for n in range(6) for r in outer(n, n % 3 != 2, "train")])
    known = eng.patterns(eng.judged(t, eng.proposed([t], contain), contain))
    assert "SortAggregate" not in executed(known)
    assert sorted((r.polarity, r.n) for r in known.collect()) == [(0, 2), (1, 4)]


def test_partners_are_met_inside_threads(spark, rows, monkeypatch):
    names = ["a", "b", "c", "a", "a", "b", None, "c", "b", "a"]
    data = [(p, t, f"{p}{t}{i:02d}", names[(i * (t + 1) + p) % 10], (i * 7) % 11) for p in range(2) for t in range(3) for i in range(20)]
    calls = spark.createDataFrame(data, "process_id long, thread_id long, call_id string, function string, start long")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("b", "c")], "subject string, other string")
    for follows in (True, False):
        dealt = rel.partner_met(calls, pairs, follows)
        assert "hashpartitioning(process_id" in executed(dealt) and "hashpartitioning(process_id#" in executed(dealt)
        assert executed(dealt).count("Exchange hashpartitioning") == 1
        with monkeypatch.context() as m:
            m.setattr(rel, "DEALT_PAIRS", -1)
            assert rows(rel.partner_met(calls, pairs, follows)) == rows(dealt)


def test_local_clauses_shuffle_by_example_alone(spark, rows):
    data = [("h", p, f"e{p}{i}", r, f, "num", str(i * r % 3)) for p in (0, 1) for i in range(5) for r in range(1 + i % 2) for f in ("x", "y")]
    fields = spark.createDataFrame(data, "hypothesis string, polarity int, example string, record int, field string, kind string, value string")
    local = pc.local_clauses(fields)
    plan = executed(local)
    assert plan.count("Exchange hashpartitioning(hypothesis") == plan.count("Exchange hashpartitioning") <= 2
    assert rows(pc.base_clauses(local.withColumn("value", F.when(F.col("polarity") == 1, "0").otherwise(F.col("value"))))) == []
