"""Streams give what the batch gives; files read back what was written."""

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions import tails
from tallyforge.operators import pairing, rules
from tallyforge.sources import readers, writers
from tallyforge.streaming import counters, stateful


def stream(spark, df, path):
    df.repartition(2).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(path)


def drained(query_df, name, checkpoint, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return query_df.sparkSession.table(name)


def test_paired_calls_equal_the_batch(spark, rows, tmp_path):
    rng = np.random.default_rng(0)
    data = [(int(k), 1, 0, bool(rng.random() < 0.5), "f", i, i) for i, k in enumerate(rng.integers(0, 5, 200))]
    df = spark.createDataFrame(data, "tgid long, pid long, cookie long, is_enter boolean, function_name string, t long, seq long")
    live = drained(stateful.paired_calls(stream(spark, df, str(tmp_path / "in")), timeout_ms=None), "pairs", str(tmp_path / "cp"))
    batch = pairing.pair_latest(df, ["tgid", "pid", "cookie"], keep=["function_name"])
    assert rows(live, "tgid", "start_t", "t", "duration") == rows(batch, "tgid", "start_t", "t", "duration")


def test_thresholds_and_windows_on_a_stream(spark, tmp_path):
    values = np.random.default_rng(1).normal(size=300)
    df = spark.createDataFrame([("s", i, i, float(v), [float(v)]) for i, v in enumerate(values)], "series string, t long, seq long, score double, x array<double>")
    src = stream(spark, df, str(tmp_path / "in"))
    got = drained(stateful.adaptive_threshold(src.drop("x"), 100, 1e-2, 0.9, timeout_ms=None), "spot", str(tmp_path / "a")).orderBy("t").collect()
    spot = tails.Spot(values[:100], 1e-2, 0.9)
    np.testing.assert_allclose([r.threshold for r in got], [spot.step(v)[0] for v in values[100:]])
    scored = drained(stateful.window_scores(src.select("series", "t", "seq", "x"), 60, timeout_ms=None), "windows", str(tmp_path / "b"))
    assert scored.count() == 300 and scored.select("k").distinct().count() == 5


def test_window_counters_equal_the_batch(spark, rows, tmp_path):
    df = spark.range(500).select((F.col("id") % 3).alias("pid"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("oncpu_time"))
    live = drained(counters.hourly_counters(stream(spark, df, str(tmp_path / "in"))), "hourly", str(tmp_path / "cp"), "update")
    last = live.groupBy("pid", "window_start").agg(F.max("events").alias("events"), F.max("oncpu_total").alias("oncpu_total"))
    assert rows(last) == rows(counters.hourly_counters(df))


def test_one_warning_per_interval(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).alias("pid"), F.timestamp_millis(F.col("id") * 100).alias("ts"))
    live = drained(counters.one_warning(stream(spark, df, str(tmp_path / "in")), ["pid"]), "warned", str(tmp_path / "cp"))
    assert live.count() == counters.one_warning(df, ["pid"]).count() == 20


def test_reports_every_n_events_equal_the_batch(spark, rows, tmp_path):
    # 50 events a micro-batch, three keys, a report every 7: no border of a batch is one of a report
    data = [("abc"[i * i % 3], i, i, None if i % 11 == 0 else i % 5) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t long, seq long, v long")
    for first in range(0, 400, 50):
        df.filter(f"t >= {first} and t < {first + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = drained(stateful.reports_every(source, 7, ["k"], "v", timeout_ms=None), "reports", str(tmp_path / "cp"))
    want, held = [], {}
    for k, t, _, v in data:
        n, total = held.get(k, (0, 0))
        held[k] = n, total = n + 1, total + (v or 0)
        if n % 7 == 0:
            want.append((k, t, n, total))
    assert rows(live) == sorted(want, key=repr)
    for limit in (None, 20):
        assert rows(rules.report_every(df, 7, ["k"], "v", limit)) == sorted(want, key=repr)
    assert rules.report_every(df.filter("false"), 7, ["k"], "v").count() == 0


def test_fan_out(spark, tmp_path):
    df = spark.createDataFrame([("cpu", 1), ("io", 2), ("cpu", 3)], "domain string, v long")
    seen = {}
    counters.fan_out_stream(stream(spark, df, str(tmp_path / "in")), lambda d, r, n: seen.update({d: seen.get(d, 0) + r.count()}),
                            str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert seen["cpu"] == 2 and seen["io"] == 1 and seen["gpu"] == 0


def test_stack_files(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, 7, ["a.py:x", "b.py:y"]), (2, 7, ["a.py:x"])], "ts long, pid long, frames array<string>")
    writers.write_stack_lines(df, str(tmp_path / "lines"))
    back = readers.read_stack_lines(spark, str(tmp_path / "lines"))
    assert rows(back, "ts", "frame_count", "frames") == [(1, 2, ["b.py:y", "a.py:x"]), (2, 1, ["a.py:x"])]
    (tmp_path / "blocks.txt").write_text("# Target PID: 5\nEVENT\ntimestamp=9\npid=5\nframes=2\nframe0=a.py:f\nframe1=b.py:g h\nEND\nEVENT\ntimestamp=10\npid=5\nframes=0\nEND\n")
    assert rows(readers.read_stack_blocks(spark, str(tmp_path / "blocks.txt")), "ts", "pid", "frames") == [(10, 5, []), (9, 5, ["a.py:f", "b.py:g h"])]


def test_memory_map_files(spark, rows, tmp_path):
    rule = "-" * 50
    (tmp_path / "map.log").write_text(f"0x10, 5 bytes\n0xffffffffffffffff, 7 bytes\nis_oom:true\n{rule}\n0x20, 8 bytes\nis_oom:false\n{rule}\n")
    got = rows(readers.read_snapshots(spark, str(tmp_path / "map.log")).withColumn("address", F.col("address").cast("string")), "snapshot", "address", "size", "is_oom")
    assert got == [(1, "16", 5, True), (1, "18446744073709551615", 7, True), (2, "32", 8, False)]
    (tmp_path / "alloc.txt").write_text("# comment\n0x10, 5\n20, 6\n\n")
    assert rows(readers.read_allocations(spark, str(tmp_path / "alloc.txt")), "size") == [(5,), (6,)]


def test_metric_csv_keeps_line_order(spark, rows, tmp_path):
    (tmp_path / "one.csv").write_text("ts,cpu,mem\n" + "".join(f"x,{i},{i * 2}\n" for i in range(50)))
    got = readers.read_metrics(spark, str(tmp_path / "*.csv"), skip_rows=2, skip_columns=1)
    assert rows(got.filter("t = 5")) == [("one", 5, "cpu", 7.0), ("one", 5, "mem", 14.0)] and got.count() == 96


def test_trace_json_is_flattened(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": {"b": {"c": 1}}, "args": {"x": {"y": 2}}, "time": 3}\n')
    df = readers.read_trace(spark, str(tmp_path / "t.json"))
    assert set(df.columns) == {"a.b.c", "args", "time"} and df.select("args.x.y").first()[0] == 2


def test_traces_with_conflicting_types_keep_every_value(spark, rows, tmp_path):
    import json

    first = [{"id": i, "x": i, "deep": {"n": i / 2, "odd name": [i]}, "args": {"a": 1}, "none": None} for i in range(4)]
    second = [{"id": i, "x": f"text {i}", "deep": {"n": None, "odd name": [i]}, "args": {"a": "1"}, "more": True} for i in range(4, 7)]
    third = [{"id": 7, "x": {"y": [1, "2"]}, "deep": 5, "args": {"b": 2}}, {"id": 8}]
    data = first + second + third
    for name, part in (("a", first), ("b", second), ("c", third)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, part)) + "\n\n")
    df = readers.read_trace(spark, str(tmp_path))
    assert set(df.columns) == {"id", "x", "deep", "args", "none", "more"}
    shown = df.select("id", F.to_json("x").alias("x"), F.to_json("deep").alias("deep"), "more").collect()
    for r in shown:
        want = data[r.id]
        assert (r.x is None) == ("x" not in want) and (r.x is None or json.loads(r.x) == want["x"])
        assert (r.deep is None) == ("deep" not in want) and (r.deep is None or json.loads(r.deep) == want["deep"])
        assert r.more == want.get("more")
    records = readers.trace_records(spark.read.text(str(tmp_path)))
    assert records.count() == len(data)
    typed = readers.trace_fields(records, {"id": ("$.id", "long"), "x": ("$.x", "long"), "n": ("$.deep.n", "double")})
    assert rows(typed.filter("id < 6"), "id", "x", "n") == sorted([(i, i, i / 2) for i in range(4)] + [(4, None, None), (5, None, None)], key=repr)
    assert rows(readers.trace_paths(records), "path", "type", "records") == sorted([
        ("id", "BIGINT", 9), ("x", "BIGINT", 4), ("x", "STRING", 3), ("x.y", "ARRAY", 1), ("deep.n", "DOUBLE", 4), ("deep.n", "VOID", 3),
        ("deep.odd name", "ARRAY", 7), ("deep", "BIGINT", 1), ("args", "OBJECT", 8), ("none", "VOID", 4), ("more", "BOOLEAN", 3)], key=repr)
    assert readers.trace_paths(records.filter("false")).count() == 0
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.json").write_text("\n[1]\nno json\n")
    assert readers.read_trace(spark, str(tmp_path / "empty")).columns == []


def test_invariants_results_and_reports(spark, rows, tmp_path):
    clauses = spark.createDataFrame([("h", 0, False, "f", "constant", ["1"])], readers.CLAUSE_SCHEMA)
    writers.write_invariants(clauses, str(tmp_path / "inv"))
    assert rows(readers.read_invariants(spark, str(tmp_path / "inv"))) == rows(clauses)
    results = spark.createDataFrame([("h", "failed"), ("g", "passed")], "hypothesis string, outcome string")
    writers.write_check_results(results, str(tmp_path / "res"))
    assert rows(readers.read_check_results(spark, str(tmp_path / "res")), "hypothesis", "outcome") == [("g", "passed"), ("h", "failed")]
    writers.write_csv(results, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    writers.write_trace_events(results, str(tmp_path / "json"))
    writers.write_memory_report(results, str(tmp_path / "mem"))
    assert spark.read.json(str(tmp_path / "mem")).count() == 2
    (tmp_path / "s.jsonl").write_text('{"session_id": "s1", "timestamp": "2024-01-01T00:00:00", "step_type": "error", "content": "x"}\n')
    assert readers.read_sessions(spark, str(tmp_path / "s.jsonl")).first().step_type == "error"


def test_concatenated_objects_over_lines_and_splits(spark, rows, tmp_path):
    import json

    objects = [{"hypothesis": f"h{n}", "violation": t, "violation_time": n, "more": {"deep": [n, {"a": "}{"}]}}
               for n, t in enumerate(['plain', 'a } { b', 'quote \\" }', '', '[[', 'é{', "x" * 500] * 8)]
    want = sorted(((o["hypothesis"], o["violation"], o["violation_time"]) for o in objects), key=repr)
    forms = {"lines": "\n".join(json.dumps(o) for o in objects), "spread": "\n\n".join(json.dumps(o, indent=2) for o in objects),
             "one": "".join(json.dumps(o) for o in objects), "glued": " ".join(json.dumps(o, indent=1) for o in objects)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "700b"):  # many splits, inside objects too
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for name, text in forms.items():
                folder = tmp_path / name / "outcome=failed"
                folder.mkdir(parents=True, exist_ok=True)
                (folder / "r.json").write_text(text)
                got = readers.read_check_results(spark, str(tmp_path / name))
                assert rows(got, "hypothesis", "violation", "violation_time") == want
                assert rows(got.select("outcome").distinct()) == [("failed",)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_clock_lets_rows_pass_as_a_loop_does(spark, rows):
    import random

    from tallyforge.operators import rules

    rng = random.Random(3)
    data = [(rng.choice([1, 2, None]), rng.randrange(400), n) for n in range(300)] + [(9, 5, 1)]
    df = spark.createDataFrame(data, "pid long, t long, seq long").repartition(3)
    for keys in (["pid"], []):
        for limit in (None, 40):
            want = []
            for key in {r[0] if keys else 0 for r in data}:
                last = None
                for r in sorted((r for r in data if not keys or r[0] == key), key=lambda r: r[1:]):
                    if last is None or r[1] >= last + 25:
                        want.append(r)
                        last = r[1]
            assert rows(rules.once_per_interval(df, keys, 25, max_rows=limit)) == sorted(want, key=repr)
    assert rules.once_per_interval(df.filter("false"), ["pid"], 5).count() == 0
