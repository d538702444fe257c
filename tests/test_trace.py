"""Trace operators, relations and preconditions against brute force on small traces."""

import datetime
import itertools
import random
import re

from pyspark.sql import functions as F

from tallyforge.operators import diff, preconditions as pc
from tallyforge.operators import relations as rel
from tallyforge.operators import trace as tr
from tallyforge.plans import telemetry, text
from tallyforge.plans import trace as plans
from tallyforge.plans.registry import table


def calls(spark, n=120, seed=0, functions="abcd"):
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(n):
        t += rng.randrange(1, 5)
        data.append((0, rng.randrange(2), f"c{i:04d}", rng.choice(functions), t, t + rng.choice([0, 1, 3, 20])))
    return data, spark.createDataFrame(data, "process_id long, thread_id long, call_id string, function string, start long, end long")


def order_examples(data, follows):
    """The rule of the relation, call by call."""
    threads = sorted({r[1] for r in data})
    names = sorted({r[3] for r in data})
    beside = {(th, a, b) for th in threads for a, b in itertools.permutations(names, 2)
              if any(x[4] > y[5] or y[4] > x[5] for x in data for y in data if x[1] == y[1] == th and x[3] == a and y[3] == b)}
    out = {}
    for th in threads:
        mine = sorted((r for r in data if r[1] == th), key=lambda r: (r[4], r[2]))
        for a, b in {(x, y) for _, x, y in beside}:
            subject, other = (a, b) if follows else (b, a)
            if not any(t == th and (x if follows else y) == subject for t, x, y in beside):
                continue
            pos, neg = out.get((subject, other), (0, 0))
            if (th, a, b) not in beside:
                neg += sum(r[3] == subject for r in mine)
            elif follows:
                waiting = False
                for r in mine:
                    if r[3] == subject:
                        neg += waiting
                        waiting = True
                    elif r[3] == other and waiting:
                        pos, waiting = pos + 1, False
                neg += waiting
            else:
                ready = False
                for r in mine:
                    if r[3] == other:
                        ready = True
                    elif r[3] == subject:
                        pos, neg, ready = pos + ready, neg + (not ready), False
            out[subject, other] = (pos, neg)
    return sorted(((s, o, p, n) for (s, o), (p, n) in out.items()), key=repr)


def test_order_relations_and_their_chunks(spark, rows):
    data, df = calls(spark)
    for follows in (False, True):
        want = order_examples(data, follows)
        for chunk in (7, 1000):
            got = rel.order_counts(df, follows, max_rows=20 if chunk == 7 else None)
            assert rows(got, "subject", "other", "positives", "negatives") == want
        examples = rel.order_examples(df, follows, keep=10_000)
        counted = examples.groupBy("subject", "other").agg(F.sum("polarity").alias("p"), F.sum(1 - F.col("polarity")).alias("n"))
        assert rows(counted, "subject", "other", "p", "n") == want


def test_examples_are_capped_by_seed(spark, rows):
    _, df = calls(spark)
    a, b = (rel.order_examples(df.repartition(n), True, keep=5) for n in (1, 4))
    assert rows(a, "subject", "other", "polarity", "call_id") == rows(b, "subject", "other", "polarity", "call_id")
    assert a.groupBy("subject", "other", "polarity").count().agg(F.max("count")).first()[0] == 5


def test_events_in_calls(spark, rows):
    data, df = calls(spark)
    want = sorted(((p[2], c[2]) for p in data for c in data if p is not c and p[1] == c[1] and p[4] <= c[4] and c[5] <= p[5]), key=repr)
    assert rows(tr.events_in_calls(df), "parent_id", "call_id") == want


def test_list_arguments_compare_by_shared_elements(spark):
    rng = random.Random(1)
    data = [("f", rng.randrange(2), f"c{i}", [rng.randrange(12) for _ in range(rng.randrange(0, 5))]) for i in range(40)]
    df = spark.createDataFrame(data, "function string, step long, call_id string, args array<long>")
    alike = total = 0
    for x, y in itertools.combinations(data, 2):
        if x[1] == y[1]:
            a, b = set(x[3]), set(y[3])
            total += 1
            alike += bool(a | b) and len(a & b) / len(a | b) >= 0.1
    r = rel.list_argument_counts(df).first()
    assert (r.positives, r.negatives) == (total - alike, alike)


def test_chains_need_all_pairs(spark, rows):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert rows(rel.merged_chains(df)) == [(["x", "y"],)]
    full = df.unionByName(spark.createDataFrame([("a", "d"), ("b", "d")], "a string, b string"))
    assert (["a", "b", "c", "d"],) in rows(rel.merged_chains(full))


def test_chains_hold_cycles_as_one_node(spark, rows):
    def chains(*pairs):
        return [r[0] for r in rows(rel.merged_chains(spark.createDataFrame(list(pairs), "a string, b string")))]

    assert chains(("view", "click")) == [["view", "click"]]
    assert chains(("a", "b"), ("b", "a")) == [["a|b"]]
    ring = [("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "c")]
    assert chains(*ring) == [["c|d|e|f|g"]]
    assert chains(*ring, ("a", "c"), ("e", "z"), ("a", "z"), ("x", "y")) == [["a", "c|d|e|f|g", "z"], ["a", "z"], ["x", "y"]]
    assert chains(("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")) == [["a|b", "c|d"]]


def test_registered_chains_have_rules_in_both_directions(spark, rows):
    assert "mod.view_1>mod.click_0" in {r[0] for r in rows(plans.i19(spark, "/root/testdata/sf0.01"))}


def test_preconditions_are_learned_from_all_calls(spark, monkeypatch):
    given = []
    monkeypatch.setattr(pc, "infer", lambda fields, skip: given.append(fields))
    plans.learned(spark, "/root/testdata/sf0.001")
    calls_ = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert given[0].select("example").distinct().count() == calls_


def test_events_of_every_type_are_accesses(spark, monkeypatch):
    monkeypatch.setattr(plans, "table", lambda spark, sf, name: table(spark, sf, name).filter("event_type <> 'click'"))
    assert not plans.i5(spark, "/root/testdata/sf0.001").isEmpty()


def test_all_rows_have_a_role(spark, rows):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    launches = telemetry.a14(spark, sf)
    assert launches.agg(F.sum("launches")).first()[0] == events.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd, even = ({line for (t,) in docs.filter(f"doc_id % 2 = {n}").select("text").collect() for line in re.sub(r"\d+", "0", t or "").split("\n")} for n in (1, 0))
    assert {r[0] for r in rows(text.u1(spark, sf))} == {x.strip(" ") for x in odd} - {x.strip(" ") for x in even}


def test_states_merge_equal_values(spark, rows):
    data = [(0, "p", "T", "x", v, t, t) for t, v in enumerate(["1", "1", "2", None, None, "1"])]
    df = spark.createDataFrame(data, "process_id long, var_name string, var_type string, attr string, value string, time long, seq long")
    want = [("1", 0, 2), ("1", 5, 5), ("2", 2, 3), (None, 3, 5)]
    for limit in (None, 2):
        assert rows(tr.states(df, limit), "value", "start", "end") == sorted(want, key=repr)
    assert tr.changes(tr.states(df)).count() == 3


def fields(spark, examples):
    out = []
    for polarity, example, records in examples:
        for number, record in enumerate(records):
            for name, (kind, value) in record.items():
                out.append(("h", polarity, example, number, name, kind, value))
    return spark.createDataFrame(out, "hypothesis string, polarity int, example string, record int, field string, kind string, value string")


def test_precondition_splits_the_positives(spark, rows):
    examples = []
    for i in range(40):
        stage, flag = ("train", "eval")[i % 2], ("true", "false")[i // 2 % 2]
        record = {"meta_vars.stage": ("str", stage), "attributes.flag": ("bool", flag), "process_id": ("num", str(i % 3))}
        examples.append((int(stage == "train" or flag == "true"), f"e{i}", [record]))
    df = fields(spark, examples)
    found = pc.preconditions_as_sets(pc.infer(df))
    assert sorted(r.clauses[0] for r in found.collect()) == ["attributes.flag|constant|true", "meta_vars.stage|constant|train"]
    judged = pc.holds_for(pc.local_clauses(pc.relevant_fields(df)), pc.infer(df))
    assert judged.filter(F.col("holds") != (F.col("polarity") == 1)).count() == 0
    assert pc.safety(judged).first().safe
    broken = fields(spark, [(0, "bad", [{"meta_vars.stage": ("str", "train"), "attributes.flag": ("bool", "false"), "process_id": ("num", "1")}])])
    verdict = pc.holds_for(pc.local_clauses(broken), pc.infer(df))
    times = broken.select(*pc.KEY, F.lit(7).cast("long").alias("time")).distinct()
    assert rows(pc.check(verdict, times), "outcome", "violation", "violation_time") == [("failed", "bad", 7)]


def test_precondition_kinds(spark, rows):
    two = lambda a, b: [{"process_id": ("num", a)}, {"process_id": ("num", b)}]
    local = pc.local_clauses(fields(spark, [(1, "x", two("1", "2")), (1, "y", two("3", "3")), (1, "z", [{"process_id": ("num", "1")}, {"function": ("str", "f")}])]))
    assert rows(local, "example", "clause") == [("x", "unequal"), ("y", "constant")]


def test_inverted_and_unconditional(spark):
    one = lambda v: [{"attributes.a": ("str", v)}]
    inverted = fields(spark, [(1, f"p{i}", one("abcdef"[i])) for i in range(6)] + [(0, f"n{i}", one("z")) for i in range(3)])
    found = pc.infer(inverted).collect()
    assert found and all(r.inverted for r in found) and found[0]["values"] == ["z"]
    assert pc.infer(fields(spark, [(1, "p", one("a"))])).first().clause == "unconditional"
    staged = pc.restricted_to_stages(pc.infer(fields(spark, [(1, "p", one("a"))])), ["train"], ["train", "eval"])
    assert [(r.field, r["values"]) for r in staged.collect()] == [(pc.STAGE_FIELD, ["train"])]


def test_implied_preconditions_go(spark, rows):
    df = spark.createDataFrame([("h", 0, False, ["a"]), ("h", 1, False, ["a", "b"]), ("h", 2, False, ["c"])],
                               "hypothesis string, precondition int, inverted boolean, clauses array<string>")
    assert rows(pc.without_implied(df), "precondition") == [(0,), (2,)]


def records(spark, contents):
    return spark.createDataFrame([(i, "pre", c) for i, c in enumerate(contents)], "idx long, kind string, content map<string,string>")


def test_run_diff(spark, rows):
    left = records(spark, [{"function": "f", "a": "1", "b": "x"}, {"function": "g", "a": "2"}, {"function": "h", "a": "only"}])
    right = records(spark, [{"function": "f", "a": "1", "b": "x", "time": "9"}, {"function": "g", "a": "3"}, {"function": "new"}])
    assert rows(diff.run_diff(left, right, 1), "change", "left_idx", "right_idx", "keys") == [
        ("delete", 2, None, ""), ("edit", 1, 1, "a"), ("insert", None, 2, "")]


def test_line_patterns_join_near_lines(spark):
    base = {k: "v" for k in "abcdefgh"}
    lines = records(spark, [base, {**base, "a": "w", "b": "w", "c": "w"}, {k: "z" for k in "abcdefgh"}])
    out = {r.times: r.variants for r in diff.line_patterns(lines).collect()}
    assert out == {2: 2, 1: 1}


def test_symbolic_tags(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0), ("b", 0.0), ("c", -1.0), ("c", 2.0), ("d", 5.0), ("e", -1.0), ("e", 0.0), ("e", 3.0)], "k string, v double")
    assert {r.k: r.tag for r in rel.generalised(df, ["k"], "v").collect()} == {
        "a": "above_zero", "b": "non_positive", "c": "non_zero", "d": None, "e": "non_none"}


def test_relations_can_be_added_and_switched_off():
    rel.register_relation("mine", lambda calls: calls)
    assert "mine" in rel.chosen_relations() and "mine" not in rel.chosen_relations(disabled=["mine"])
    del rel.RELATIONS["mine"]


def test_line_groups_follow_the_first_line_not_yet_in_one(spark):
    rng = random.Random(2)
    lines = [(i, {k: rng.choice(["x", "y", "z", "q1", "q2"]) for k in rng.sample("abcdefgh", rng.randint(1, 7))}) for i in range(200)]
    got = diff.line_patterns(spark.createDataFrame(lines, "idx long, content map<string,string>"))
    distinct = {}
    for i, content in lines:
        masked = {k: v.replace("1", "0").replace("2", "0") for k, v in content.items()}
        held = distinct.setdefault(tuple(sorted(masked.items())), [masked, i, 0])
        held[2] += 1
    ordered = sorted(distinct.values(), key=lambda x: x[1])
    taken, want = set(), []
    for i, (mine, _, times) in enumerate(ordered):
        if i in taken:
            continue
        near = [j for j in range(i + 1, len(ordered)) if j not in taken
                and sum(1 for k in mine.keys() | ordered[j][0].keys() if mine.get(k) != ordered[j][0].get(k)) <= 3]
        taken.update(near)
        want.append((times + sum(ordered[j][2] for j in near), 1 + len(near)))
    assert sorted((r.times, r.variants) for r in got.collect()) == sorted(want)


def test_unchanged_related_variables_are_judged_over_whole_calls(spark, rows, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    data = [(event, start + datetime.timedelta(seconds=at), 8, "view", value, '{"k": 1}') for event, at, value in ((1, 0, 0.1), (2, 60, 120.0), (3, 80000, 0.0))]
    events = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    # the first call lasts 90 s and holds the change at 60 s, but not in its first twentieth
    assert rows(plans.j10(spark, str(tmp_path)), "call_id", "var_name") == []
    assert {r[0] for r in rows(plans.j10_short(spark, str(tmp_path)), "call_id")} == {"c000000000001"}


def test_merged_containment_counts_sets_as_it_counts_lists(spark, rows):
    rng = random.Random(6)
    made = []
    for i in range(60):
        start = rng.randrange(400)
        made.append((rng.choice([0, 1]), rng.choice([f"c{i}", f"c{i}", "c0", None]), rng.choice(["f", "g", "g", None]), start, start + rng.choice([0, 5, 90])))
    of = spark.createDataFrame(made, "process_id int, call_id string, function string, start long, end long").repartition(3)
    changes = spark.createDataFrame(
        [(rng.choice([0, 1]), "p", "t", rng.choice(["a", "b", None]), rng.randrange(450), "0", rng.choice([str(rng.randrange(90)), "7", None]))
         for _ in range(500)],
        "process_id int, var_name string, var_type string, attr string, time long, old_value string, new_value string").repartition(3)
    kind = ["attr", "new_value"]
    listed = rel.containment_examples(of, tr.changes_in_calls(of, changes, kind), kind)
    sets = rel.containment_examples(of, tr.changes_in_calls(of, changes, kind, sets=True), kind)
    columns = ["parent", "attr", "positives", "negatives", "rules", "merged", F.round("mean_likelihood", 9), F.round("likelihood", 9)]
    want = rows(rel.merged_containment(listed, ["parent", "attr"], "new_value"), *columns)
    assert len(want) == 4 and rows(rel.merged_containment(sets, ["parent", "attr"], "new_value"), *columns) == want


def test_examples_of_merged_containment_are_not_listed(spark, monkeypatch):
    given, merged = [], rel.merged_containment
    monkeypatch.setattr(rel, "merged_containment", lambda examples, *more: given.append(examples) or merged(examples, *more))
    sf = "/root/testdata/sf0.001"
    assert not plans.i9(spark, sf).isEmpty()
    kinds, calls_ = given[0].kinds.count(), plans.calls(spark, sf).count()
    assert kinds > 20 and given[0].rows.count() <= calls_ * (1 + kinds // 64)
