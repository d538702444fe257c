"""Queries over training traces; the events stand for function calls and variable values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import engine as eng
from tallyforge.operators import preconditions as pc
from tallyforge.operators import relations as rel
from tallyforge.operators import trace as tr
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import query, table
from tallyforge.session import cut_lineage

DAY_US = 86_400_000_000

# --- bindings ------------------------------------------------------------------------


def base_calls(spark, sf):
    events = table(spark, sf, "events").withColumn("args", F.get_json_object("props", "$.k"))  # read once, used many times
    k = F.col("args").cast("long")
    name = F.when(k % 25 == 0, "mod._hidden").otherwise(F.concat(
        F.lit("mod."), "event_type", F.lit("_"), (k % 3).cast("string"), F.when(k % 3 == 2, " [eBPF]").otherwise("")))
    t = b.micros("ts")
    return events.select(
        (F.col("user_id") % 8).alias("process_id"), F.col("user_id").alias("thread_id"),
        F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("call_id"), name.alias("function"),
        t.alias("time"), (t + F.floor(F.col("value") * 900) * 1_000_000).alias("until"),
        F.when((F.col("event_type") == "signup") & (k % 5 == 0), None).otherwise(F.col("user_id") * 10 + k % 3).alias("obj_id"),
        F.floor(t / DAY_US).alias("step"), F.when(F.floor(t / DAY_US) % 10 < 7, "train").otherwise("eval").alias("stage"),
        "args", k.alias("k"), F.col("value"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 97 == 0).alias("is_open"), ((F.col("event_type") == "error") & (k % 2 == 1)).alias("raises"),
    )


def records(spark, sf):
    base = base_calls(spark, sf)
    pre = base.withColumn("type", F.lit(tr.PRE)).drop("until", "is_open", "raises")
    post = base.filter(~F.col("is_open")).withColumns({
        "type": F.when(F.col("raises"), tr.POST_EXCEPTION).otherwise(tr.POST), "time": F.col("until"),
    }).drop("until", "is_open", "raises")
    return pre.unionByName(post)


CALLS_SQL = f"""base AS (
  SELECT user_id % 8 AS process_id, user_id AS thread_id, 'c' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS call_id,
    CASE WHEN k % 25 = 0 THEN 'mod._hidden' ELSE 'mod.' || event_type || '_' || CAST(k % 3 AS VARCHAR) || CASE WHEN k % 3 = 2 THEN ' [eBPF]' ELSE '' END END AS function,
    epoch_us(ts) AS time, epoch_us(ts) + CAST(floor(value * 900) AS BIGINT) * 1000000 AS until,
    CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN NULL ELSE user_id * 10 + k % 3 END AS obj_id,
    epoch_us(ts) // {DAY_US} AS step, CASE WHEN epoch_us(ts) // {DAY_US} % 10 < 7 THEN 'train' ELSE 'eval' END AS stage,
    CAST(k AS VARCHAR) AS args, k, value, event_id AS seq, event_id % 97 = 0 AS is_open, event_type = 'error' AND k % 2 = 1 AS raises
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
records AS (
  SELECT process_id, thread_id, call_id, function, time, 'pre' AS type, obj_id, step, stage FROM base
  UNION ALL SELECT process_id, thread_id, call_id, function, until, CASE WHEN raises THEN 'exc' ELSE 'post' END, obj_id, step, stage
  FROM base WHERE NOT is_open),
calls AS (
  SELECT base.*, time AS "start", CASE WHEN is_open THEN thread_end ELSE until END AS "end",
    CASE WHEN is_open THEN 'incomplete' WHEN raises THEN 'exception' ELSE 'ok' END AS outcome
  FROM base JOIN (SELECT process_id, thread_id, max(time) AS thread_end FROM records GROUP BY ALL) USING (process_id, thread_id))"""


def calls(spark, sf):
    return tr.calls(records(spark, sf))


def variables(spark, sf):
    """A user is a variable copy: four processes hold each variable, two variables make a type."""
    return table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("process_id"), F.concat(F.lit("p"), F.floor(F.col("user_id") / 4).cast("string")).alias("var_name"),
        F.concat(F.lit("layer_"), F.floor(F.col("user_id") / 8).cast("string")).alias("var_type"),
        F.col("event_type").alias("attr"), F.floor(F.col("value") / 50).cast("string").alias("value"),
        b.micros("ts").alias("time"), F.col("event_id").alias("seq"))


STATES_SQL = """vars AS (
  SELECT user_id % 4 AS process_id, 'p' || CAST(user_id // 4 AS VARCHAR) AS var_name, 'layer_' || CAST(user_id // 8 AS VARCHAR) AS var_type,
         event_type AS attr, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value, epoch_us(ts) AS time, event_id AS seq FROM events),
firsts AS (
  SELECT * FROM vars QUALIFY lag(value) OVER (PARTITION BY process_id, var_name, var_type, attr ORDER BY time, seq) IS DISTINCT FROM value
    OR lag(time) OVER (PARTITION BY process_id, var_name, var_type, attr ORDER BY time, seq) IS NULL),
states AS (
  SELECT process_id, var_name, var_type, attr, value, seq, time AS "start",
    coalesce(lead(time) OVER (PARTITION BY process_id, var_name, var_type, attr ORDER BY time, seq), last) AS "end"
  FROM firsts JOIN (SELECT process_id, max(time) AS last FROM vars GROUP BY 1) USING (process_id)),
changes AS (
  SELECT process_id, var_name, var_type, attr, "start" AS time, old_value, value AS new_value FROM (
    SELECT *, lag(value) OVER w AS old_value, lag("start") OVER w AS was FROM states
    WINDOW w AS (PARTITION BY process_id, var_name, var_type, attr ORDER BY "start", seq)) WHERE was IS NOT NULL)"""


def states(spark, sf):
    return tr.states(variables(spark, sf))


# --- lookups and calls ---------------------------------------------------------------

@query("i1_thread_bounds", "WITH " + CALLS_SQL + """
SELECT process_id, thread_id, min(time) AS start_time, max(time) AS end_time FROM records GROUP BY ALL""")
def i1(spark, sf):
    return tr.bounds(records(spark, sf), tr.THREAD)


@query("i1_function_names", "WITH " + CALLS_SQL + "\nSELECT DISTINCT function FROM records")
def i1_functions(spark, sf):
    return tr.distinct_values(records(spark, sf), ["function"])


@query("i2_stage_records", "WITH " + CALLS_SQL + "\nSELECT call_id, time, stage FROM records WHERE stage = 'eval'")
def i2(spark, sf):
    return tr.of_stage(records(spark, sf), "eval").select("call_id", "time", "stage")


@query("i3_without_trailing_calls", "WITH " + CALLS_SQL + """,
outer_ AS (
  SELECT process_id, min_by(call_id, struct_pack(a := time, b := call_id)) AS o, min_by(thread_id, struct_pack(a := time, b := call_id)) AS ot
  FROM base GROUP BY process_id),
ended AS (SELECT outer_.*, until AS oe FROM outer_ LEFT JOIN base ON base.call_id = o AND NOT is_open),
judged AS (
  SELECT call_id, coalesce(thread_id <> ot AND time >= oe - 86400000000, false) AS dropped
  FROM base JOIN ended USING (process_id) WHERE is_open AND call_id <> o)
SELECT r.call_id, r.time, judged.call_id IS NOT NULL AS broken FROM records r LEFT JOIN judged USING (call_id) WHERE NOT coalesce(dropped, false)""")
def i3(spark, sf):
    return tr.without_trailing(records(spark, sf), DAY_US).select("call_id", "time", "broken")


@query("i4_bound_methods", "WITH " + CALLS_SQL + "\nSELECT function, bool_and(obj_id IS NOT NULL) AS is_bound FROM base GROUP BY ALL")
def i4(spark, sf):
    return tr.bound_methods(records(spark, sf).filter(F.col("type") == tr.PRE))


@query("j5_calls", "WITH " + CALLS_SQL + """
SELECT process_id, thread_id, call_id, function, "start", "end", outcome FROM calls""")
def j5(spark, sf):
    return calls(spark, sf).select("process_id", "thread_id", "call_id", "function", "start", "end", "outcome")


RUNS_SQL = CALLS_SQL + """,
turns AS (
  SELECT *, CASE WHEN lag(function) OVER w = function THEN 0 ELSE 1 END AS turn FROM base
  WINDOW w AS (PARTITION BY process_id, thread_id ORDER BY time, call_id)),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY process_id, thread_id ORDER BY time, call_id ROWS UNBOUNDED PRECEDING) AS island FROM turns),
longest AS (
  SELECT function, max(n) AS longest_run FROM (SELECT process_id, thread_id, island, function, count(*) AS n FROM runs GROUP BY ALL) GROUP BY function),
pool AS (SELECT function FROM longest WHERE NOT contains(function, '._') AND longest_run <= 4)"""


def pre(spark, sf):
    return records(spark, sf).filter(F.col("type") == tr.PRE)


@query("w2_longest_runs", "WITH " + RUNS_SQL + "\nSELECT function, longest_run FROM longest")
def w2(spark, sf):
    return tr.longest_runs(pre(spark, sf))


@query("p5_function_pool", "WITH " + RUNS_SQL + "\nSELECT function FROM longest WHERE NOT contains(function, '._') AND longest_run <= 3")
def p5(spark, sf):
    return tr.function_pool(pre(spark, sf), 3)


@query("p6_kernel_functions", "WITH " + CALLS_SQL + "\nSELECT call_id, function FROM base WHERE contains(function, '[eBPF]')")
def p6(spark, sf):
    return tr.kernel_functions(pre(spark, sf)).select("call_id", "function")


@query("p7_analysable_calls", "WITH " + CALLS_SQL + """
SELECT call_id, function FROM base WHERE NOT contains(function, '._') AND NOT contains(function, 'torch.autograd') AND NOT contains(function, 'mod.error')""")
def p7(spark, sf):
    return tr.analysable(pre(spark, sf), [*tr.SKIPPED_FUNCTIONS, "mod.error"]).select("call_id", "function")


LEVEL_SQL = RUNS_SQL + """,
pooled AS (SELECT * FROM calls WHERE function IN (SELECT function FROM pool)),
edge AS (SELECT process_id, thread_id, function, max("start") AS s, min("end") AS e FROM pooled GROUP BY ALL),
level AS (
  SELECT x.process_id, x.thread_id, x.function AS function_a, y.function AS function_b FROM edge x JOIN edge y
  ON x.process_id = y.process_id AND x.thread_id = y.thread_id AND x.function <> y.function AND (x.s > y.e OR y.s > x.e))"""


def pool(spark, sf):
    return tr.function_pool(pre(spark, sf), rel.ORDER_RUN_LIMIT)


@query("j11_same_level_pairs", "WITH " + LEVEL_SQL + "\nSELECT process_id, thread_id, function_a, function_b FROM level")
def j11(spark, sf):
    return tr.same_level_pairs(calls(spark, sf).join(pool(spark, sf), "function", "left_semi"))


INSIDE_SQL = CALLS_SQL + """,
inside AS (
  SELECT p.process_id, p.thread_id, p.call_id AS parent_id, p.function AS parent, c.call_id, c.function, c."start" AS "at"
  FROM calls p JOIN calls c ON p.process_id = c.process_id AND p.thread_id = c.thread_id AND c."start" BETWEEN p."start" AND p."end"
    AND c."end" <= p."end" AND c.call_id <> p.call_id)"""


@query("j6_events_in_calls", "WITH " + INSIDE_SQL + "\nSELECT process_id, thread_id, parent_id, call_id, \"at\" FROM inside")
def j6(spark, sf):
    return tr.events_in_calls(calls(spark, sf)).select("process_id", "thread_id", "parent_id", "call_id", "at")


def changed_sql(name: str, end: str) -> str:
    return CALLS_SQL + ",\n" + STATES_SQL + f""",
{name} AS (SELECT process_id % 4 AS process_id, call_id, function, "start", {end} AS "end", obj_id FROM calls),
changed AS (
  SELECT p.process_id, p.call_id AS parent_id, p.function AS parent, c.var_name, c.var_type, c.attr, c.old_value, c.new_value, c.time AS "at"
  FROM {name} p JOIN changes c ON p.process_id = c.process_id AND c.time BETWEEN p."start" AND p."end")"""


# Calls last seconds here, so that a process does not hold most changes in most calls.
SHORT_SQL = changed_sql("short", '"start" + ("end" - "start") // 20')


def whole_calls(spark, sf):
    """Calls in the processes of the variables, from their start to their end."""
    return calls(spark, sf).withColumn("process_id", F.col("process_id") % 4)


def short_calls(spark, sf):
    return whole_calls(spark, sf).withColumn("end", F.col("start") + F.floor((F.col("end") - F.col("start")) / 20))


def changed(spark, sf):
    return tr.changes_in_calls(short_calls(spark, sf), tr.changes(states(spark, sf)))


def changed_kinds(spark, sf, kinds, sets=False):
    return tr.changes_in_calls(short_calls(spark, sf), tr.changes(states(spark, sf)), kinds, sets=sets)


@query("j7_changes_in_calls", "WITH " + SHORT_SQL + "\nSELECT process_id, parent_id, var_name, attr, old_value, new_value, \"at\" FROM changed")
def j7(spark, sf):
    return changed(spark, sf).select("process_id", "parent_id", "var_name", "attr", "old_value", "new_value", "at")


@query("w1_attribute_states", "WITH " + STATES_SQL + """
SELECT process_id, var_name, var_type, attr, value, "start", "end" FROM states""")
def w1(spark, sf):
    return states(spark, sf).select("process_id", "var_name", "var_type", "attr", "value", "start", "end")


@query("w3_attribute_changes", "WITH " + STATES_SQL + "\nSELECT process_id, var_name, attr, time, old_value, new_value FROM changes")
def w3(spark, sf):
    return tr.changes(states(spark, sf)).select("process_id", "var_name", "attr", "time", "old_value", "new_value")


OVERLAP_SQL = STATES_SQL + """,
pairs AS (
  SELECT l.var_type, l.attr AS attr_a, r.attr AS attr_b, l.var_name AS name_a, r.var_name AS name_b, l.process_id AS pid_a, r.process_id AS pid_b,
    l."start" AS start_a, r."start" AS start_b, CAST(l.value IS NOT DISTINCT FROM r.value AS INTEGER) AS polarity
  FROM states l JOIN states r ON l.var_type = r.var_type AND l."start" <= r."end" AND r."start" <= l."end"
    AND (l.var_name <> r.var_name OR l.process_id <> r.process_id)
    AND (l.attr, l.var_name, l.process_id) < (r.attr, r.var_name, r.process_id)
  WHERE (least(l."end", r."end") - greatest(l."start", r."start")) > 0
    AND (least(l."end", r."end") - greatest(l."start", r."start")) / (greatest(l."end", r."end") - least(l."start", r."start")) > 0.01::DOUBLE)"""


@query("j8_overlapping_states", "WITH " + OVERLAP_SQL + """
SELECT var_type, attr_a, attr_b, name_a, name_b, pid_a, pid_b, start_a, start_b, polarity FROM pairs""")
def j8(spark, sf):
    out = rel.consistency_pairs(states(spark, sf))
    return out.select(
        "var_type", F.col("left_attr").alias("attr_a"), F.col("right_attr").alias("attr_b"), F.col("left_var_name").alias("name_a"),
        F.col("right_var_name").alias("name_b"), F.col("left_process_id").alias("pid_a"), F.col("right_process_id").alias("pid_b"),
        F.col("left_start").alias("start_a"), F.col("right_start").alias("start_b"), "polarity")


@query("i10_consistency", "WITH " + OVERLAP_SQL + """
SELECT var_type, attr_a, attr_b, CAST(sum(polarity) AS BIGINT) AS positives, CAST(sum(1 - polarity) AS BIGINT) AS negatives
FROM pairs GROUP BY ALL HAVING sum(polarity) >= 2""")
def i10(spark, sf):
    return rel.consistency_counts(states(spark, sf))


def related_sql(name: str, source: str) -> str:
    return f"""{source},
accesses AS (SELECT DISTINCT user_id % 4 AS process_id, user_id * 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS obj_id,
  'p' || CAST(user_id // 4 AS VARCHAR) AS var_name, 'layer_' || CAST(user_id // 8 AS VARCHAR) AS var_type FROM events),
related AS (SELECT s.process_id, s.call_id, s.obj_id, var_name, var_type FROM {name} s JOIN accesses USING (process_id, obj_id))"""


RELATED_SQL = related_sql("short", SHORT_SQL)


def related(spark, sf, of):
    user = F.col("user_id")
    accesses = table(spark, sf, "events").select(
        (user % 4).alias("process_id"), (user * 10 + b.prop_k() % 3).alias("obj_id"),
        F.concat(F.lit("p"), F.floor(user / 4).cast("string")).alias("var_name"),
        F.concat(F.lit("layer_"), F.floor(user / 8).cast("string")).alias("var_type"))
    return tr.related_variables(of, accesses)


I5_SQL = "WITH " + RELATED_SQL + "\nSELECT process_id, call_id, obj_id, var_name, var_type FROM related"


def unchanged_sql(source: str) -> str:
    return "WITH " + source + """
SELECT call_id, process_id, var_name, var_type FROM related r WHERE NOT EXISTS (
  SELECT 1 FROM changed c WHERE c.parent_id = r.call_id AND c.process_id = r.process_id AND c.var_name = r.var_name AND c.var_type = r.var_type)"""


@query("i5_all_related_variables", I5_SQL)
@query("i5_related_variables", I5_SQL)
def i5(spark, sf):
    return related(spark, sf, short_calls(spark, sf)).select("process_id", "call_id", "obj_id", "var_name", "var_type")


def unchanged(spark, sf, calls_):
    of = related(spark, sf, calls_)
    variable = ["process_id", "var_name", "var_type"]
    beside = calls_.join(of.select(*variable, "call_id").distinct(), ["process_id", "call_id"])
    hit = tr.changes_in_calls(beside, tr.changes(states(spark, sf)), [], variable)
    return tr.unchanged_related(of, hit).select("call_id", "process_id", "var_name", "var_type")


@query("j10_unchanged_related", unchanged_sql(related_sql("whole", changed_sql("whole", '"end"'))))
def j10(spark, sf):
    return unchanged(spark, sf, whole_calls(spark, sf))


@query("j10_all_unchanged_related", unchanged_sql(RELATED_SQL))
def j10_short(spark, sf):
    return unchanged(spark, sf, short_calls(spark, sf))


@query("i6_raw_records_before", "WITH " + STATES_SQL + """,
moments AS (SELECT process_id, var_name, var_type, max(time) - 432000000000 AS moment FROM vars GROUP BY ALL)
SELECT v.process_id, v.var_name, v.attr, v.time, moment FROM vars v JOIN moments m USING (process_id, var_name, var_type) WHERE v.time < moment""")
def i6(spark, sf):
    of = variables(spark, sf)
    moments = of.groupBy("process_id", "var_name", "var_type").agg((F.max("time") - 432_000_000_000).alias("moment"))
    return tr.raw_before(of, moments).select("process_id", "var_name", "attr", "time", "moment")


@query("j9_active_settings", "WITH " + CALLS_SQL + """
SELECT call_id, last_value(CASE WHEN k % 7 = 0 THEN step END IGNORE NULLS) OVER w AS epoch,
       last_value(CASE WHEN k % 11 = 0 THEN stage END IGNORE NULLS) OVER w AS mode FROM base
WINDOW w AS (PARTITION BY process_id, thread_id ORDER BY time, seq ROWS UNBOUNDED PRECEDING)""")
def j9(spark, sf):
    base = base_calls(spark, sf)
    settings = base.filter((F.col("k") % 7 == 0) | (F.col("k") % 11 == 0)).select(
        *tr.THREAD, "time", "seq", F.when(F.col("k") % 7 == 0, F.col("step")).alias("epoch"),
        F.when(F.col("k") % 11 == 0, F.col("stage")).alias("mode"))
    return tr.with_active_values(base, settings, ["epoch", "mode"]).select("call_id", "epoch", "mode")


@query("j9_active_contexts", "WITH " + CALLS_SQL + """
SELECT r.call_id, r.time AS "at", c.function AS context FROM base r JOIN calls c ON r.process_id = c.process_id AND r.thread_id = c.thread_id
  AND r.time BETWEEN c."start" AND c."end" WHERE c.function LIKE 'mod.view%'""")
def j9_contexts(spark, sf):
    contexts = calls(spark, sf).filter(F.col("function").startswith("mod.view")).select(
        *tr.THREAD, F.col("function").alias("context"), "start", "end")
    return tr.active_contexts(pre(spark, sf), contexts).select("call_id", "at", "context")


@query("f13_time_share", "WITH " + CALLS_SQL + """
SELECT call_id, round((time - min(time) OVER ()) / (max(time) OVER () - min(time) OVER ()), 9) AS time_share FROM base""")
def f13(spark, sf):
    of = pre(spark, sf)
    span = tr.bounds(of)  # one row
    return of.join(F.broadcast(span)).select(
        "call_id", F.round(tr.time_share(F.col("time"), F.col("start_time"), F.col("end_time")), 9).alias("time_share"))


@query("i31_renamed_copies", "WITH " + CALLS_SQL + """
SELECT call_id, function, time FROM records UNION ALL
SELECT 'copy_' || call_id, 'mod.copied', time FROM records WHERE function = 'mod.view_1'""")
def i31(spark, sf):
    return tr.renamed_copies(records(spark, sf), "mod.view_1", "mod.copied").select("call_id", "function", "time")


# --- order ---------------------------------------------------------------------------

def order_sql(follows: bool, source: str = LEVEL_SQL) -> str:
    subject, other = ("function_a", "function_b") if follows else ("function_b", "function_a")
    border = "lead" if follows else "lag"
    beyond = "(s.border IS NULL OR o.pos < s.border) AND o.pos > s.pos" if follows else "(s.border IS NULL OR o.pos > s.border) AND o.pos < s.pos"
    return f"""{source},
placed AS (SELECT *, row_number() OVER (PARTITION BY process_id, thread_id ORDER BY "start", call_id) AS pos FROM pooled),
bordered AS (SELECT *, {border}(pos) OVER (PARTITION BY process_id, thread_id, function ORDER BY pos) AS border FROM placed),
met AS (
  SELECT DISTINCT s.process_id, s.thread_id, s.call_id, s.function AS subject, o.function AS other
  FROM bordered s JOIN placed o ON s.process_id = o.process_id AND s.thread_id = o.thread_id AND s.function <> o.function AND {beyond}),
beside AS (SELECT DISTINCT process_id, thread_id, {subject} AS subject, {other} AS other FROM level),
kinds AS (SELECT DISTINCT subject, other FROM beside),
subjects AS (SELECT DISTINCT process_id, thread_id, subject FROM beside),
examples AS (
  SELECT p.process_id, p.thread_id, p.call_id, kinds.subject, kinds.other,
    CAST(beside.other IS NOT NULL AND met.call_id IS NOT NULL AS INTEGER) AS polarity
  FROM placed p JOIN subjects ON subjects.process_id = p.process_id AND subjects.thread_id = p.thread_id AND subjects.subject = p.function
  JOIN kinds ON kinds.subject = p.function
  LEFT JOIN beside ON beside.process_id = p.process_id AND beside.thread_id = p.thread_id AND beside.subject = kinds.subject AND beside.other = kinds.other
  LEFT JOIN met ON met.call_id = p.call_id AND met.other = kinds.other)"""


COUNT_SQL = """
SELECT subject, other, CAST(sum(polarity) AS BIGINT) AS positives, CAST(sum(1 - polarity) AS BIGINT) AS negatives FROM examples GROUP BY ALL"""


@query("i14_cover", "WITH " + order_sql(False) + COUNT_SQL)
def i14(spark, sf):
    return rel.order_counts(calls(spark, sf), False, pool(spark, sf))


@query("i15_lead", "WITH " + order_sql(True) + COUNT_SQL)
def i15(spark, sf):
    return rel.order_counts(calls(spark, sf), True, pool(spark, sf))


KERNEL_SQL = LEVEL_SQL.replace("IN (SELECT function FROM pool)", "IN (SELECT function FROM pool) AND contains(function, '[eBPF]')")


@query("i16_kernel_cover", "WITH " + order_sql(False, KERNEL_SQL) + COUNT_SQL)
def i16(spark, sf):
    return rel.chosen_relations(["kernel_cover"])["kernel_cover"](calls(spark, sf), pool=pool(spark, sf))


def lead_rules(spark, sf):
    """Pairs A, B where B follows nearly half of the As or more."""
    return i15(spark, sf).filter("positives * 2.1 > negatives + positives").select(F.col("subject").alias("a"), F.col("other").alias("b"))


I19_SQL = "WITH RECURSIVE " + order_sql(True) + """,
rules AS (SELECT subject AS a, other AS b FROM examples GROUP BY ALL HAVING sum(polarity) * 2.1::DOUBLE > count(*)),
reach AS (SELECT a, b FROM rules UNION SELECT reach.a, rules.b FROM reach JOIN rules ON rules.a = reach.b),
named AS (
  SELECT f.function, coalesce(string_agg(x.b, '|' ORDER BY x.b), f.function) AS node FROM (SELECT a AS function FROM rules UNION SELECT b FROM rules) f
  LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) x ON x.a = f.function GROUP BY f.function),
edges AS (
  SELECT DISTINCT x.node AS a, y.node AS b FROM rules JOIN named x ON x.function = rules.a JOIN named y ON y.function = rules.b WHERE x.node <> y.node),
paths AS (
  SELECT [node] AS path, node AS tip FROM (SELECT DISTINCT node FROM named) WHERE node NOT IN (SELECT b FROM edges)
  UNION ALL
  SELECT list_append(path, e.b), e.b FROM paths JOIN edges e ON e.a = tip
  WHERE NOT list_contains(path, e.b) AND (SELECT count(*) FROM edges f WHERE f.b = e.b AND list_contains(path, f.a)) = len(path))
SELECT array_to_string(path, '>') AS chain FROM paths WHERE tip NOT IN (SELECT a FROM edges)"""


@query("i19_all_chains", I19_SQL)
@query("i19_merged_chains", I19_SQL)
def i19(spark, sf):
    return rel.merged_chains(lead_rules(spark, sf)).select(F.concat_ws(">", "path").alias("chain"))


# --- containment ---------------------------------------------------------------------

CONTAIN_SQL = "WITH " + INSIDE_SQL + """,
has AS (SELECT DISTINCT parent, parent_id, function FROM inside)"""


@query("i7_containment", CONTAIN_SQL + """,
total AS (SELECT function AS parent, count(*) AS n FROM calls GROUP BY ALL)
SELECT parent, function, count(*) AS positives, any_value(n) - count(*) AS negatives FROM has JOIN total USING (parent) GROUP BY ALL""")
def i7(spark, sf):
    of = calls(spark, sf)
    return rel.containment_counts(of, tr.events_in_calls(of), ["function"])


@query("i7_change_containment", "WITH " + SHORT_SQL + """,
has AS (SELECT DISTINCT parent, parent_id, attr, new_value FROM changed),
total AS (SELECT function AS parent, count(*) AS n FROM short GROUP BY ALL)
SELECT parent, attr, new_value, count(*) AS positives, any_value(n) - count(*) AS negatives FROM has JOIN total USING (parent) GROUP BY ALL""")
def i7_changes(spark, sf):
    return rel.containment_counts(short_calls(spark, sf), changed_kinds(spark, sf, ["attr", "new_value"]), ["attr", "new_value"])


@query("u6_containment_examples", CONTAIN_SQL + """,
kinds AS (SELECT DISTINCT parent, function FROM has)
SELECT k.parent, k.function, c.call_id, CAST(has.parent_id IS NOT NULL AS INTEGER) AS polarity
FROM kinds k JOIN calls c ON c.function = k.parent LEFT JOIN has ON has.parent = k.parent AND has.function = k.function AND has.parent_id = c.call_id""")
def u6(spark, sf):
    of = calls(spark, sf)
    return rel.containment_examples(of, tr.events_in_calls(of), ["function"]).select("parent", "function", "call_id", "polarity")


@query("i8_sampled_calls")
def i8(spark, sf):
    return rel.sampled_calls(calls(spark, sf)).select("function", "call_id", "start")


@query("i9_merged_containment", "WITH " + SHORT_SQL + """,
has AS (SELECT DISTINCT parent, parent_id, attr, new_value FROM changed),
kinds AS (SELECT DISTINCT parent, attr, new_value FROM has),
ex AS (
  SELECT k.parent, k.attr, k.new_value, s.call_id, CAST(has.parent_id IS NOT NULL AS INTEGER) AS polarity
  FROM kinds k JOIN short s ON s.function = k.parent LEFT JOIN has ON has.parent = k.parent AND has.attr = k.attr AND has.new_value = k.new_value AND has.parent_id = s.call_id),
per AS (SELECT parent, attr, new_value, 1 / (1 + exp(-0.1 * (2 * sum(polarity) - count(*)))) AS l FROM ex GROUP BY ALL),
m AS (SELECT parent, attr, avg(l) AS mean_likelihood, count(*) AS rules FROM per GROUP BY ALL),
u AS (SELECT parent, attr, call_id, max(polarity) AS polarity FROM ex GROUP BY ALL),
c AS (SELECT parent, attr, CAST(sum(polarity) AS BIGINT) AS positives, CAST(sum(1 - polarity) AS BIGINT) AS negatives FROM u GROUP BY ALL)
SELECT parent, attr, positives, negatives, rules, rules > 1 AND 1 / (1 + exp(-0.1 * (positives - negatives))) / mean_likelihood >= 1.3 AS merged
FROM c JOIN m USING (parent, attr)""")
def i9(spark, sf):
    held = changed_kinds(spark, sf, ["attr", "new_value"], sets=True)
    examples = rel.containment_examples(short_calls(spark, sf), held, ["attr", "new_value"])
    out = rel.merged_containment(examples, ["parent", "attr"], "new_value")
    return out.select("parent", "attr", "positives", "negatives", "rules", "merged")


@query("f12_likelihood", CONTAIN_SQL + """,
total AS (SELECT function AS parent, count(*) AS n FROM calls GROUP BY ALL)
SELECT parent, function, round(1 / (1 + exp(-0.1 * (2 * count(*) - any_value(n)))), 9) AS likelihood
FROM has JOIN total USING (parent) GROUP BY ALL""")
def f12(spark, sf):
    out = i7(spark, sf)
    return out.select("parent", "function", F.round(rel.likelihood(F.col("positives"), F.col("negatives")), 9).alias("likelihood"))


NUMBERS_SQL = """nums AS (
  SELECT event_type AS function, user_id % 20 AS prop, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value / 100) AS BIGINT) - user_id % 3 END AS v FROM events),
agg AS (
  SELECT function, prop, min(v) AS low, max(v) AS high, coalesce(bool_or(v = 0), false) AS zero, bool_or(v IS NULL) AS none,
         count(DISTINCT v) + max(CAST(v IS NULL AS INTEGER)) AS distinct_values FROM nums GROUP BY ALL),
tags AS (
  SELECT *, CASE WHEN distinct_values = 1 THEN NULL WHEN low > 0 THEN 'above_zero' WHEN low >= 0 THEN 'non_negative' WHEN high < 0 THEN 'below_zero'
    WHEN high <= 0 THEN 'non_positive' WHEN NOT zero THEN 'non_zero' WHEN NOT none THEN 'non_none' ELSE 'anything' END AS tag FROM agg)"""


def numbers(spark, sf):
    v = F.floor(F.col("value") / 100) - F.col("user_id") % 3
    return table(spark, sf, "events").select(
        F.col("event_type").alias("function"), (F.col("user_id") % 20).alias("prop"),
        F.when(F.col("event_id") % 13 == 0, None).otherwise(v).alias("v"))


@query("f11_generalised_values", "WITH " + NUMBERS_SQL + "\nSELECT function, prop, low, high, distinct_values, tag FROM tags")
def f11(spark, sf):
    return rel.generalised(numbers(spark, sf), ["function", "prop"], "v")


@query("p12_symbolic_matches", "WITH " + NUMBERS_SQL + """
SELECT t.function, t.prop, tag, count(*) FILTER (CASE tag WHEN 'above_zero' THEN v > 0 WHEN 'below_zero' THEN v < 0 WHEN 'non_positive' THEN v IS NULL OR v <= 0
  WHEN 'non_negative' THEN v IS NULL OR v >= 0 WHEN 'non_zero' THEN v <> 0 WHEN 'non_none' THEN v IS NOT NULL WHEN 'anything' THEN true END) AS matches
FROM nums n JOIN tags t USING (function, prop) WHERE tag IS NOT NULL GROUP BY ALL""")
def p12(spark, sf):
    of = numbers(spark, sf)
    tags = rel.generalised(of, ["function", "prop"], "v").filter("tag is not null").select("function", "prop", "tag")
    return of.join(tags, ["function", "prop"]).groupBy("function", "prop", "tag").agg(
        F.count_if(rel.matches_symbol(F.col("tag"), F.col("v"))).alias("matches"))


# --- values and arguments ------------------------------------------------------------

@query("i11_consistent_output", """
WITH o AS (SELECT event_type AS function, event_id AS call_id, unnest(['bucket', 'parity']) AS prop,
  unnest([CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR), CAST(event_id % 2 AS VARCHAR)]) AS value FROM events),
per AS (SELECT function, prop, value, count(*) AS positives FROM o GROUP BY ALL)
SELECT function, prop, value, positives, CAST(sum(positives) OVER (PARTITION BY function, prop) AS BIGINT) - positives AS negatives FROM per""")
def i11(spark, sf):
    pair = F.array(
        F.struct(F.lit("bucket").alias("prop"), F.floor(F.col("value") / 100).cast("string").alias("v")),
        F.struct(F.lit("parity").alias("prop"), (F.col("event_id") % 2).cast("string").alias("v")))
    outputs = table(spark, sf, "events").select(
        F.col("event_type").alias("function"), F.col("event_id").alias("call_id"), F.inline(pair).alias("prop", "value"))
    return rel.output_counts(outputs)


IO_PATHS_SQL = """WITH e AS (SELECT event_type AS function, event_id AS call_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, value FROM events),
inputs AS (SELECT function, call_id, unnest(['0.shape.0', '0.shape.1', '0.requires_grad']) AS path,
  unnest([CAST(k % 5 AS VARCHAR), CAST(user_id % 5 AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END]) AS value,
  unnest([false, false, true]) AS is_flag FROM e),
outputs AS (SELECT function, call_id, unnest(['0.shape.0', '0.shape.1', '0.requires_grad', '0.is_cuda']) AS path,
  unnest([CAST(k % 5 AS VARCHAR), CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR), CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END]) AS value FROM e)"""


def io_paths(spark, sf):
    k, flag = b.prop_k(), lambda c: F.when(c, "true").otherwise("false")
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("function"), F.col("event_id").alias("call_id"), k.alias("k"), "user_id", "value")

    def row(path, value, is_flag=False):
        return F.struct(F.lit(path).alias("path"), value.alias("value"), F.lit(is_flag).alias("is_flag"))

    inputs = F.array(row("0.shape.0", (F.col("k") % 5).cast("string")), row("0.shape.1", (F.col("user_id") % 5).cast("string")),
                     row("0.requires_grad", flag(F.col("k") % 2 == 0), True))
    outputs = F.array(row("0.shape.0", (F.col("k") % 5).cast("string")), row("0.shape.1", (F.floor("value") % 5).cast("string")),
                      row("0.requires_grad", flag(F.col("k") % 2 == 0), True), row("0.is_cuda", flag(F.col("k") % 3 == 0), True))
    return (e.select("function", "call_id", F.inline(inputs)), e.select("function", "call_id", F.inline(outputs)))


@query("i12_consistent_input_output", IO_PATHS_SQL + """
SELECT i.function, i.path AS input_path, o.path AS output_path, count(DISTINCT i.call_id) AS positives,
       any_value(n) - count(DISTINCT i.call_id) AS negatives
FROM inputs i JOIN outputs o ON i.call_id = o.call_id AND i.value = o.value AND (NOT is_flag OR i.path = o.path)
JOIN (SELECT function, count(*) AS n FROM e GROUP BY ALL) t ON t.function = i.function GROUP BY ALL""")
def i12(spark, sf):
    return rel.input_output_counts(*io_paths(spark, sf))


@query("u3_shared_values", IO_PATHS_SQL + """
SELECT call_id, value FROM inputs INTERSECT SELECT call_id, value FROM outputs""")
def u3(spark, sf):
    return rel.shared_values(*io_paths(spark, sf))


@query("i13_threshold", """
WITH e AS (SELECT event_type AS function, event_id AS call_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
args AS (SELECT function, call_id, unnest(['min_size', 'max_size', 'other']) AS arg, unnest([k / 2, 3.0 * k, 1.0 * k]) AS bound FROM e),
sided AS (SELECT *, 'min' AS side FROM args WHERE contains(arg, 'min') UNION ALL SELECT *, 'max' FROM args WHERE contains(arg, 'max')),
j AS (SELECT s.*, e.value, CASE WHEN side = 'min' THEN e.value >= bound ELSE e.value <= bound END AS holds,
  CASE WHEN side = 'min' THEN e.value - bound ELSE bound - e.value END AS gap FROM sided s JOIN e USING (function, call_id))
SELECT function, side, arg, 'value' AS path, count(*) FILTER (holds) AS positives, count(*) FILTER (NOT holds) AS negatives
FROM j GROUP BY function, side, arg HAVING bool_or(holds AND gap / nullif(bound, 0) <= 0.2)""")
def i13(spark, sf):
    k = b.prop_k()
    e = table(spark, sf, "events").select(F.col("event_type").alias("function"), F.col("event_id").alias("call_id"), k.alias("k"), "value")
    args = F.array(*[F.struct(F.lit(n).alias("arg"), v.alias("bound")) for n, v in (
        ("min_size", F.col("k") / 2), ("max_size", F.col("k") * 3.0), ("other", F.col("k") * 1.0))])
    outputs = e.select("function", "call_id", F.lit("value").alias("path"), "value")
    return rel.threshold_counts(e.select("function", "call_id", F.inline(args)), outputs)


@query("i17_distinct_arguments", "WITH " + CALLS_SQL + """,
g AS (SELECT function, step, args, count(*) AS n FROM base GROUP BY ALL),
s AS (SELECT function, step, sum(n) AS al, sum(n * (n - 1) / 2) AS same FROM g GROUP BY ALL)
SELECT function, CAST(sum(al * (al - 1) / 2 - same) AS BIGINT) AS positives, CAST(sum(same) AS BIGINT) AS negatives FROM s GROUP BY ALL
HAVING sum(al * (al - 1) / 2 - same) > 0""")
def i17(spark, sf):
    return rel.distinct_argument_counts(pre(spark, sf))


@query("j12_list_argument_pairs", "WITH " + CALLS_SQL + """,
lists AS (SELECT function, step, call_id, list_sort(list_distinct([k % 7, k % 11, k // 10])) AS items FROM base),
pairs AS (
  SELECT a.function, CASE WHEN len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))) >= 0.1::DOUBLE THEN 1 ELSE 0 END AS alike
  FROM lists a JOIN lists b ON a.function = b.function AND a.step = b.step AND a.call_id < b.call_id)
SELECT function, count(*) FILTER (alike = 0) AS positives, count(*) FILTER (alike = 1) AS negatives FROM pairs GROUP BY ALL HAVING count(*) FILTER (alike = 0) > 0""")
def j12(spark, sf):
    k = F.col("k")
    return rel.list_argument_counts(pre(spark, sf).withColumn("args", F.array(k % 7, k % 11, F.floor(k / 10))))


@query("u4_list_iou", "WITH " + CALLS_SQL + """
SELECT call_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS iou FROM (
  SELECT call_id, list_distinct([k % 7, k % 11, k // 10]) AS a, list_distinct([k % 5, k % 13, k // 20]) AS b FROM base)""")
def u4(spark, sf):
    k = F.col("k")
    return pre(spark, sf).select("call_id", F.round(rel.iou(
        F.array(k % 7, k % 11, F.floor(k / 10)), F.array(k % 5, k % 13, F.floor(k / 20))), 9).alias("iou"))


ARGUMENTS_SQL = CALLS_SQL + """,
given AS (SELECT function, call_id, unnest(['k5', 'unit', 'open']) AS arg,
  unnest([CAST(k % 5 AS VARCHAR), substr(function, 1, 7), CASE WHEN k % 25 = 0 THEN NULL ELSE 'x' END]) AS value FROM base),
present AS (SELECT * FROM given WHERE value IS NOT NULL)"""


def given(spark, sf):
    pairs = F.array(*[F.struct(F.lit(n).alias("arg"), v.alias("value")) for n, v in (
        ("k5", (F.col("k") % 5).cast("string")), ("unit", F.substring("function", 1, 7)),
        ("open", F.when(F.col("k") % 25 == 0, None).otherwise("x")))])
    return pre(spark, sf).select("function", "call_id", F.inline(pairs)).filter("value is not null")


@query("u2_common_arguments", "WITH " + ARGUMENTS_SQL + """
SELECT function, arg, value, count(DISTINCT call_id) AS calls FROM present p JOIN (SELECT function, count(*) AS n FROM base GROUP BY ALL) t USING (function)
GROUP BY ALL HAVING count(DISTINCT call_id) = any_value(n)""")
def u2(spark, sf):
    return rel.common_arguments(given(spark, sf))


@query("p14_argument_violations", "WITH " + ARGUMENTS_SQL + """,
required AS (SELECT DISTINCT function, 'k5' AS arg, '2' AS value FROM base UNION ALL SELECT DISTINCT function, 'open', 'x' FROM base),
wanted AS (SELECT function, call_id, r.arg, r.value FROM base JOIN required r USING (function))
SELECT w.call_id, w.arg, w.value, p.value AS given FROM wanted w LEFT JOIN present p ON p.call_id = w.call_id AND p.arg = w.arg
WHERE p.value IS NULL OR p.value <> w.value""")
def p14(spark, sf):
    have = given(spark, sf)
    names = have.select("function").distinct()
    required = names.select("function", F.lit("k5").alias("arg"), F.lit("2").alias("value")).unionByName(
        names.select("function", F.lit("open").alias("arg"), F.lit("x").alias("value")))
    return rel.argument_violations(required, have).select("call_id", "arg", "value", "given")


@query("i18_periodic_values", "WITH " + STATES_SQL + """
SELECT process_id, var_name, var_type, attr, value AS bucket, count(*) AS times FROM states GROUP BY ALL HAVING count(*) > 5""")
def i18(spark, sf):
    return rel.periodic_values(states(spark, sf))


@query("f10_value_buckets", """
SELECT vec_id, printf('%.7f', list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))))) AS list_bucket,
       printf('%.7f', CAST(label AS DOUBLE)) AS number_bucket FROM embeddings""")
def f10(spark, sf):
    numbers_ = F.transform("embedding", lambda v: v.cast("double"))

    def bucket(kind):
        return rel.value_bucket(F.lit(kind), F.col("label").cast("double"), F.col("label").cast("string"), numbers_)

    return table(spark, sf, "embeddings").select("vec_id", bucket("list").alias("list_bucket"), bucket("number").alias("number_bucket"))


@query("f9_close_values", """
WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))) AS d
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, len(list_filter(d, lambda v: v < 0.02::DOUBLE)) AS near_entries, len(list_filter(d, lambda v: v >= 0.6::DOUBLE)) = 0 AS all_near FROM p""")
def f9(spark, sf):
    wide = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    after = wide.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    near = F.filter(F.zip_with("a", "b", lambda x, y: rel.close(x, y, 0.02)), lambda v: v)
    return wide.join(after, "vec_id").select(
        "vec_id", F.size(near).cast("long").alias("near_entries"), rel.arrays_close(F.col("a"), F.col("b"), 0.6).alias("all_near"))


@query("f17_content_hash")
def f17(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.xxhash64("embedding").alias("content_hash"))


@query("f17_equal_contents", """
SELECT vec_id, first_id, copies FROM embeddings JOIN (
  SELECT embedding, min(vec_id) AS first_id, count(*) AS copies FROM embeddings GROUP BY embedding) g
ON embeddings.embedding IS NOT DISTINCT FROM g.embedding""")
def f17_equal(spark, sf):
    # arrays are compared by their hashes alone
    hashes = f17(spark, sf)
    groups = hashes.groupBy("content_hash").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashes.join(groups, "content_hash").select("vec_id", "first_id", "copies")


# --- preconditions -------------------------------------------------------------------

FIELDS_SQL = CALLS_SQL + """,
judged AS (
  SELECT split_part(function, '_', 1) AS hypothesis, call_id AS example, stage, k, step, process_id,
    CAST(CASE WHEN function LIKE 'mod.view%' THEN stage = 'train' WHEN function LIKE 'mod.click%' THEN stage = 'train' OR k % 2 = 0
      WHEN function LIKE 'mod.error%' THEN k % 2 = 1 AND k % 10 <> 9 ELSE value < 150 END AS INTEGER) AS polarity FROM base),
fields AS (
  SELECT hypothesis, polarity, example, unnest(['meta_vars.stage', 'meta_vars.phase', 'attributes.k5', 'process_id']) AS field,
    unnest(['str', 'num', 'num', 'num']) AS kind, unnest([stage, CAST(step % 2 AS VARCHAR), CAST(k % 5 AS VARCHAR), CAST(process_id AS VARCHAR)]) AS value FROM judged
  UNION ALL
  SELECT hypothesis, polarity, example, 'attributes.even', 'bool', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM judged WHERE k % 10 <> 9),
merged AS (
  SELECT hypothesis, field, 'constant' AS clause, value, n FROM (
    SELECT hypothesis, field, max(kind) AS kind, value, count(*) AS n, count(*) OVER (PARTITION BY hypothesis, field) AS width FROM fields
    WHERE polarity = 1 GROUP BY hypothesis, field, value) WHERE kind = 'bool' OR width <= CASE WHEN kind = 'str' THEN 4 ELSE 1 END
  UNION ALL
  SELECT hypothesis, field, 'consistent', NULL, count(*) FROM fields WHERE polarity = 1 GROUP BY hypothesis, field
  HAVING max(kind) <> 'bool' AND count(DISTINCT value) > CASE WHEN max(kind) = 'str' THEN 4 ELSE 1 END)"""

# The trace is cut in two runs at this time.
SPLIT_US = 1_705_363_200_000_000


def example_fields(spark, sf, run=None):
    """Calls as examples for and against a rule about their function, with the fields of the call."""
    name, k = F.col("function"), F.col("k")
    holds = (F.when(name.startswith("mod.view"), F.col("stage") == "train")
             .when(name.startswith("mod.click"), (F.col("stage") == "train") | (k % 2 == 0))
             .when(name.startswith("mod.error"), (k % 2 == 1) & (k % 10 != 9)).otherwise(F.col("value") < 150))
    text = lambda c: c.cast("string")
    pairs = [("meta_vars.stage", "str", F.col("stage")), ("meta_vars.phase", "num", text(F.col("step") % 2)),
             ("attributes.k5", "num", text(k % 5)), ("process_id", "num", text(F.col("process_id"))),
             ("attributes.even", "bool", F.when(k % 10 != 9, F.when(k % 2 == 0, "true").otherwise("false")))]
    entries = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(kind).alias("kind"), v.alias("value")) for n, kind, v in pairs])
    rows = base_calls(spark, sf)
    if run is not None:
        rows = rows.filter((F.col("time") >= SPLIT_US) == bool(run))
    # dealt as calls, before each becomes a row for each of its fields
    rows = rows.withColumns({"hypothesis": F.split_part("function", F.lit("_"), F.lit(1)), "polarity": holds.cast("int"),
                             "example": F.col("call_id")}).repartition(*pc.KEY)
    return rows.select(*pc.KEY, F.lit(0).alias("record"), "time", F.inline(entries)).filter("value is not null")


@query("i20_local_clauses", "WITH " + FIELDS_SQL + """
SELECT hypothesis, polarity, example, field, kind, 'constant' AS clause, value FROM fields""")
def i20(spark, sf):
    return pc.local_clauses(example_fields(spark, sf)).drop("single")


@query("i21_merged_clauses", "WITH " + FIELDS_SQL + "\nSELECT hypothesis, field, clause, value, n FROM merged")
def i21(spark, sf):
    return pc.merged_clauses(pc.local_clauses(example_fields(spark, sf)))


@query("i22_base_clauses", "WITH " + FIELDS_SQL + """,
totals AS (SELECT hypothesis, count(DISTINCT example) FILTER (polarity = 1) AS pos, count(DISTINCT example) FILTER (polarity = 0) AS neg FROM fields GROUP BY ALL),
everywhere AS (SELECT m.*, neg FROM merged m JOIN totals USING (hypothesis) WHERE n = pos)
SELECT e.hypothesis, e.field, clause, e.value, any_value(neg) - count(f.example) AS broken_by FROM everywhere e
LEFT JOIN fields f ON f.hypothesis = e.hypothesis AND f.field = e.field AND f.polarity = 0 AND (clause = 'consistent' OR f.value = e.value)
GROUP BY e.hypothesis, e.field, clause, e.value HAVING any_value(neg) - count(f.example) > 0""")
def i22(spark, sf):
    return pc.base_clauses(pc.local_clauses(example_fields(spark, sf)))


def learned(spark, sf, run=None):
    return pc.infer(example_fields(spark, sf, run), ["function"])


@query("i23_preconditions")
def i23(spark, sf):
    return pc.preconditions_as_sets(learned(spark, sf)).withColumn("clauses", F.concat_ws(" & ", "clauses"))


@query("p11_without_implied")
def p11(spark, sf):
    return pc.without_implied(pc.preconditions_as_sets(learned(spark, sf))).withColumn("clauses", F.concat_ws(" & ", "clauses"))


@query("i24_capped_counts", "WITH " + order_sql(True) + """
SELECT subject, other, polarity, least(count(*), 5000) AS kept FROM examples GROUP BY ALL""")
def i24_counts(spark, sf):
    examples = rel.order_examples(calls(spark, sf), True, pool(spark, sf))
    return examples.groupBy("subject", "other", "polarity").agg(F.count(F.lit(1)).alias("kept"))


@query("i24_capped_examples")
def i24(spark, sf):
    return rel.order_examples(calls(spark, sf), True, pool(spark, sf))


@query("i25_stage_restriction")
def i25(spark, sf):
    return pc.restricted_to_stages(learned(spark, sf), ["train"], ["train", "eval"]).withColumn("values", F.concat_ws(";", "values"))


@query("i26_invariants_over_traces")
def i26(spark, sf):
    clauses, failed = pc.infer_over_traces([example_fields(spark, sf, 0), example_fields(spark, sf, 1)], ["function"])
    good = clauses.groupBy("hypothesis").agg(F.count_distinct("precondition").alias("preconditions"))
    return good.unionByName(failed.select("hypothesis", F.lit(0).cast("long").alias("preconditions")))


def judged(spark, sf):
    fields = example_fields(spark, sf, 1)
    local = pc.local_clauses(pc.relevant_fields(fields, ["function"]))
    return fields, pc.holds_for(local, learned(spark, sf, 0))


@query("p9_p10_preconditions_hold")
def p10(spark, sf):
    return judged(spark, sf)[1]


@query("p15_precondition_safety")
def p15(spark, sf):
    return pc.safety(judged(spark, sf)[1])


@query("i27_checked_invariants")
def i27(spark, sf):
    fields, holds = judged(spark, sf)
    return pc.check(holds, fields.select(*pc.KEY, "time").distinct())


@query("a28_check_summary")
def a28(spark, sf):
    return pc.outcome_counts(i27(spark, sf))


@query("a27_invariants_per_relation", "WITH " + order_sql(True) + """,
g AS (SELECT function, step, args, count(*) AS n FROM base GROUP BY ALL),
s AS (SELECT function, step, sum(n) AS al, sum(n * (n - 1) / 2) AS same FROM g GROUP BY ALL),
rules AS (
  SELECT 'lead' AS relation FROM examples GROUP BY subject, other HAVING sum(polarity) * 2.1::DOUBLE > count(*)
  UNION ALL SELECT 'distinct_arguments' FROM s GROUP BY function HAVING sum(al * (al - 1) / 2 - same) > sum(same))
SELECT relation, count(*) AS invariants FROM rules GROUP BY ALL""")
def a27(spark, sf):
    lead = lead_rules(spark, sf).select(F.lit("lead").alias("relation"))
    distinct = i17(spark, sf).filter("positives > negatives").select(F.lit("distinct_arguments").alias("relation"))
    return pc.relation_sizes(lead.unionByName(distinct))


# --- all relations -------------------------------------------------------------------

def engine_sql(learn: str) -> str:
    """Rules proposed by the traces in ``learn``, judged on both, and learned from the traces in ``learn``."""
    near = """SELECT DISTINCT s.call_id, o.function AS other FROM bordered s JOIN placed o
    ON s.process_id = o.process_id AND s.thread_id = o.thread_id AND s.function <> o.function AND """
    return "WITH " + LEVEL_SQL + ",\n" + STATES_SQL + f""",
tc AS (SELECT *, process_id % 2 AS odd FROM calls),
placed AS (SELECT *, row_number() OVER (PARTITION BY process_id, thread_id ORDER BY "start", call_id) AS pos FROM tc),
bordered AS (SELECT *, lead(pos) OVER w AS after, lag(pos) OVER w AS before FROM placed WINDOW w AS (PARTITION BY process_id, thread_id, function ORDER BY pos)),
after_met AS ({near} o.pos > s.pos AND (s.after IS NULL OR o.pos < s.after)),
before_met AS ({near} o.pos < s.pos AND (s.before IS NULL OR o.pos > s.before)),
inside AS (
  SELECT DISTINCT p.odd, p.call_id AS parent_id, p.function AS parent, c.function
  FROM tc p JOIN tc c ON p.process_id = c.process_id AND p.thread_id = c.thread_id AND c."start" BETWEEN p."start" AND p."end"
    AND c."end" <= p."end" AND c.call_id <> p.call_id),
outputs AS (
  SELECT odd, function, call_id, "start" AS time, unnest(['outcome', 'parity']) AS prop, unnest([outcome, CAST(k % 2 AS VARCHAR)]) AS value FROM tc),
variables AS (
  SELECT process_id % 2 AS odd, process_id, concat_ws('/', process_id, var_name, attr) AS example, var_name, var_type, attr, min("start") AS time
  FROM states GROUP BY ALL),
times AS (SELECT process_id % 2 AS odd, concat_ws('/', process_id, var_name, attr) AS example, var_type, attr, value, count(*) AS n FROM states GROUP BY ALL),
counted AS (SELECT odd, function, prop, value, count(*) AS n FROM outputs GROUP BY ALL),
shares AS (SELECT *, sum(n) OVER (PARTITION BY odd, function, prop) AS al FROM counted),
proposed AS (
  SELECT process_id % 2 AS odd, unnest(['lead', 'cover']) AS relation, [function_a, function_b] AS parts FROM level
  UNION SELECT odd, 'contain', [parent, function] FROM inside
  UNION SELECT odd, 'consistent_output', [function, prop, value] FROM shares WHERE n >= 0.5 * al
  UNION SELECT odd, 'periodic', [var_type, attr, value] FROM times WHERE n > 5),
rules AS (SELECT DISTINCT relation, parts FROM proposed WHERE odd IN {learn}),
judged AS (
  SELECT relation, parts, odd, s.call_id AS example, "start" AS time, CAST(m.other IS NOT NULL AS INTEGER) AS polarity FROM rules r JOIN tc s
    ON relation = 'lead' AND s.function = parts[1] LEFT JOIN after_met m ON m.call_id = s.call_id AND m.other = parts[2]
  UNION ALL SELECT relation, parts, odd, s.call_id, "start", CAST(m.other IS NOT NULL AS INTEGER) FROM rules r JOIN tc s
    ON relation = 'cover' AND s.function = parts[1] LEFT JOIN before_met m ON m.call_id = s.call_id AND m.other = parts[2]
  UNION ALL SELECT relation, parts, s.odd, s.call_id, "start", CAST(i.parent_id IS NOT NULL AS INTEGER) FROM rules r JOIN tc s
    ON relation = 'contain' AND s.function = parts[1] LEFT JOIN inside i ON i.parent_id = s.call_id AND i.function = parts[2]
  UNION ALL SELECT relation, parts, odd, call_id, time, CAST(value = parts[3] AS INTEGER) FROM rules r JOIN outputs o
    ON relation = 'consistent_output' AND function = parts[1] AND prop = parts[2]
  UNION ALL SELECT relation, parts, v.odd, v.example, time, CAST(coalesce(n, 0) > 5 AS INTEGER) FROM rules r JOIN variables v
    ON relation = 'periodic' AND v.var_type = parts[1] AND v.attr = parts[2] LEFT JOIN times t ON t.example = v.example AND t.value = parts[3]),
f AS (
  SELECT call_id AS example, unnest(['attributes.even', 'attributes.k5', 'meta_vars.stage']) AS field, unnest(['bool', 'num', 'str']) AS kind,
    unnest([CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, CAST(k % 5 AS VARCHAR), stage]) AS value FROM tc
  UNION ALL SELECT example, 'process_id', 'num', CAST(process_id AS VARCHAR) FROM variables),
known AS (SELECT * FROM judged WHERE odd IN {learn}),
totals AS (
  SELECT relation, parts, CAST(sum(polarity) AS BIGINT) AS positives, CAST(sum(1 - polarity) AS BIGINT) AS negatives FROM known GROUP BY ALL HAVING sum(polarity) >= 2),
per AS (
  SELECT relation, parts, field, count(*) AS n, count(DISTINCT value) AS d, min(value) AS value FROM known JOIN f USING (example) WHERE polarity = 1 GROUP BY ALL),
shared AS (SELECT relation, parts, field, value FROM per JOIN totals USING (relation, parts) WHERE n = positives AND d = 1),
broken AS (
  SELECT relation, parts, example, field, s.value FROM known JOIN shared s USING (relation, parts) JOIN f USING (example, field)
  WHERE polarity = 0 AND f.value <> s.value),
turned AS (
  SELECT relation, parts, count(DISTINCT example) AS away, string_agg(DISTINCT field || '=' || value, ' & ' ORDER BY field || '=' || value) AS clauses
  FROM broken GROUP BY ALL),
learned AS (
  SELECT relation, parts, positives, negatives,
    CASE WHEN negatives = 0 THEN 'unconditional' WHEN away = negatives THEN 'base' ELSE 'open' END AS kind,
    CASE WHEN negatives > 0 AND away = negatives THEN clauses ELSE '' END AS clauses
  FROM totals LEFT JOIN turned USING (relation, parts))"""


def engine_trace(spark, sf, odd):
    """The threads of the even or of the odd processes as one trace."""
    mine = F.col("process_id") % 2 == int(odd)
    of = cut_lineage(calls(spark, sf).filter(mine))
    outputs = of.select("function", "call_id", F.col("start").alias("time"), F.inline(F.array(
        F.struct(F.lit("outcome").alias("prop"), F.col("outcome").alias("value")),
        F.struct(F.lit("parity").alias("prop"), (F.col("k") % 2).cast("string").alias("value")))))

    def fields(*entries):
        return F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), v.alias("value")) for n, k, v in entries]).alias("fields")

    k = F.col("k")
    per_call = of.select(F.col("call_id").alias("example"), fields(
        ("attributes.even", "bool", F.when(k % 2 == 0, "true").otherwise("false")), ("attributes.k5", "num", (k % 5).cast("string")),
        ("meta_vars.stage", "str", F.col("stage"))))
    held = cut_lineage(states(spark, sf).filter(mine))
    per_variable = held.select(*tr.VARIABLE).distinct().select(
        F.concat_ws("/", "process_id", "var_name", "attr").alias("example"), fields(("process_id", "num", F.col("process_id").cast("string"))))
    return eng.Trace(of, outputs, held, per_call.unionByName(per_variable), pool(spark, sf))


@query("i26_all_relations", engine_sql("(0, 1)") + """
SELECT relation, array_to_string(parts, '|') AS rule, positives, negatives, kind, clauses FROM learned""")
def i26_all(spark, sf):
    rules = eng.learned([engine_trace(spark, sf, False), engine_trace(spark, sf, True)])
    clauses = F.array_join(F.transform("clauses", lambda c: F.concat_ws("=", c["field"], c["value"])), " & ")
    return rules.select("relation", F.array_join("parts", "|").alias("rule"), "positives", "negatives", "kind", clauses.alias("clauses"))


@query("i27_all_relations", engine_sql("(0)") + """,
away AS (
  SELECT DISTINCT j.relation, j.parts, j.example FROM judged j JOIN learned l ON l.relation = j.relation AND l.parts = j.parts AND l.kind = 'base'
  JOIN broken b ON b.relation = j.relation AND b.parts = j.parts JOIN f ON f.example = j.example AND f.field = b.field AND f.value <> b.value WHERE j.odd = 1),
applied AS (
  SELECT j.* FROM judged j JOIN learned l ON l.relation = j.relation AND l.parts = j.parts AND l.kind <> 'open'
  WHERE j.odd = 1 AND (j.relation, j.parts, j.example) NOT IN (SELECT (relation, parts, example) FROM away)),
found AS (
  SELECT relation, parts, count(*) AS examples, min(CASE WHEN polarity = 0 THEN struct_pack(t := time, e := example) END) AS first FROM applied GROUP BY ALL)
SELECT l.relation, array_to_string(l.parts, '|') AS rule,
  CASE WHEN examples IS NULL THEN 'not_triggered' WHEN first IS NOT NULL THEN 'failed' ELSE 'passed' END AS outcome,
  coalesce(examples, 0) AS examples, first.e AS violation, first.t AS violation_time
FROM learned l LEFT JOIN found g ON g.relation = l.relation AND g.parts = l.parts WHERE kind <> 'open'""")
def i27_all(spark, sf):
    rules = eng.learned([engine_trace(spark, sf, False)])
    found = eng.checked(engine_trace(spark, sf, True), rules)
    return found.select("relation", F.array_join("parts", "|").alias("rule"), "outcome", "examples", "violation", "violation_time")


@query("p8_parameter_matches", "WITH " + SHORT_SQL + """
SELECT process_id, var_name, attr, time, new_value FROM changes WHERE var_type = 'layer_3' AND attr = 'click' AND old_value = '0'""")
def p8(spark, sf):
    of = tr.changes(states(spark, sf))
    return of.filter(pc.matches_change(var_type="layer_3", attr="click", before="0")).select(
        "process_id", "var_name", "attr", "time", "new_value")


@query("p8_call_matches", "WITH " + CALLS_SQL + "\nSELECT call_id, \"start\" FROM calls WHERE function = 'mod.error_1' AND outcome = 'exception'")
def p8_calls(spark, sf):
    return calls(spark, sf).filter(pc.matches_call("mod.error_1", "exception")).select("call_id", "start")


@query("u5_hypotheses_of_all_traces", "WITH " + FIELDS_SQL + """
SELECT hypothesis, count(DISTINCT example) AS examples, count(DISTINCT example) FILTER (polarity = 1) AS positives FROM fields GROUP BY ALL
HAVING count(DISTINCT example) FILTER (polarity = 1) >= 2""")
def u5(spark, sf):
    both = example_fields(spark, sf, 0).unionByName(example_fields(spark, sf, 1), allowMissingColumns=True)
    examples = pc.supported(both).select(*pc.KEY).distinct()
    return examples.groupBy("hypothesis").agg(F.count(F.lit(1)).alias("examples"), F.sum("polarity").alias("positives"))
