"""Queries over logs, sessions, stack samples, record diffs and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as tx
from tallyforge.operators import diff as df_
from tallyforge.operators import events as ev
from tallyforge.operators import logs, rules
from tallyforge.plans import bindings as b
from tallyforge.plans import telemetry as tele
from tallyforge.plans.registry import query, table
from tallyforge.sources import readers, writers

# --- logs ----------------------------------------------------------------------------


def log_lines(spark, sf):
    k = b.prop_k().cast("string")
    kind = F.col("event_type")
    n = b.prop_k()
    message = (
        F.when(kind == "view", F.concat(F.lit(" accuracy: 0."), k, F.lit(" lr=0.00"), k))
        .when(kind == "click", F.concat(F.lit(" GPU memory usage "), k, F.lit(".5 GB utilization="), k, F.lit("%")))
        .when(kind == "purchase", F.concat(F.lit(" grad_norm="), (n * 3).cast("string"), F.lit(" throughput: "), k, F.lit(" tokens/s")))
        .when(kind == "signup", F.concat(F.lit(" no improvement for "), k, F.lit(" epochs, early stopping, latency="), (n * 200).cast("string"), F.lit(" ms")))
        .when(n % 3 == 0, " CUDA error: out of memory").when(n % 3 == 1, " loss is nan, diverged").otherwise(" file not found, invalid data"))
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("log"), F.col("event_id").alias("line"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" step="), F.col("event_id").cast("string"),
                 F.lit(" loss="), F.col("value").cast("string"), message).alias("text"))


LINES_SQL = """lines AS (
  SELECT user_id % 10 AS log, event_id AS line, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' step=' || event_id || ' loss=' || CAST(value AS VARCHAR) ||
    CASE event_type WHEN 'view' THEN ' accuracy: 0.' || k || ' lr=0.00' || k WHEN 'click' THEN ' GPU memory usage ' || k || '.5 GB utilization=' || k || '%'
      WHEN 'purchase' THEN ' grad_norm=' || (k * 3) || ' throughput: ' || k || ' tokens/s'
      WHEN 'signup' THEN ' no improvement for ' || k || ' epochs, early stopping, latency=' || (k * 200) || ' ms'
      ELSE CASE k % 3 WHEN 0 THEN ' CUDA error: out of memory' WHEN 1 THEN ' loss is nan, diverged' ELSE ' file not found, invalid data' END END AS text
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

METRICS_SQL = LINES_SQL + ",\nfound AS (" + " UNION ALL ".join(
    f"SELECT log, line, text, '{m}' AS metric, {n} AS pattern, regexp_extract_all(text, '{p}', 1, 'i') AS l FROM lines"
    for m, patterns in logs.METRIC_PATTERNS.items() for n, p in enumerate(patterns)) + r"""),
metrics AS (
  SELECT log, line, nullif(regexp_extract(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?'), '') AS time, metric, pattern,
    CAST(i - 1 AS INTEGER) AS place, try_cast(l[i] AS DOUBLE) AS value FROM found, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""


@query("f15_log_metrics", "WITH " + METRICS_SQL + "\nSELECT log, line, time, metric, pattern, place, value FROM metrics")
def f15(spark, sf):
    return logs.log_metrics(log_lines(spark, sf))


@query("a24_metric_summary", "WITH " + METRICS_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY log, metric ORDER BY line, pattern, place) AS pos FROM metrics)
SELECT log, metric, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, max_by(value, pos) AS last,
  CASE WHEN regr_slope(value, pos) > 0 THEN 'increasing' WHEN regr_slope(value, pos) < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM placed GROUP BY ALL""")
def a24(spark, sf):
    return logs.metric_summary(logs.log_metrics(log_lines(spark, sf))).withColumn("avg", F.round("avg", 6))


HITS_SQL = "hits AS (" + " UNION ALL ".join(
    f"SELECT log, line, '{c}' AS category, 'low' AS severity FROM lines WHERE regexp_matches(text, '{p}', 'i')"
    for c, patterns in logs.ANOMALY_PATTERNS.items() for p in patterns) + ")"
LIMITS_SQL = "limits AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for m, (lo, hi) in logs.LIMITS.items()) + """) t(metric, lo, hi)),
outside AS (
  SELECT log, line, metric, CASE WHEN value < lo THEN 'below' ELSE 'above' END AS side, metric || '_issues' AS category, 'high' AS severity
  FROM metrics JOIN limits USING (metric) WHERE value < lo OR value > hi)"""
ANOMALIES_SQL = "WITH " + METRICS_SQL + ",\n" + HITS_SQL + ",\n" + LIMITS_SQL + """,
anomalies AS (SELECT log, line, category, severity FROM hits UNION ALL SELECT log, line, category, severity FROM outside)"""


@query("d17_log_anomalies", ANOMALIES_SQL + "\nSELECT log, line, category, severity FROM anomalies")
def d17(spark, sf):
    return logs.anomalies(log_lines(spark, sf))


@query("a25_anomalies_by_category", ANOMALIES_SQL + "\nSELECT log, category, count(*) AS anomalies FROM anomalies GROUP BY ALL")
def a25(spark, sf):
    return logs.anomaly_counts(d17(spark, sf), "category")


@query("a25_anomalies_by_severity", ANOMALIES_SQL + "\nSELECT log, severity, count(*) AS anomalies FROM anomalies GROUP BY ALL")
def a25_severity(spark, sf):
    return logs.anomaly_counts(d17(spark, sf), "severity")


@query("u7_recommendations", ANOMALIES_SQL + """
SELECT DISTINCT log, CASE WHEN category IN ('memory_issues', 'gpu_errors') THEN 'check_hardware'
  WHEN category IN ('training_instability', 'convergence_issues') THEN 'adjust_hyperparameters' WHEN category = 'data_issues' THEN 'check_data' ELSE 'check_model_files' END AS advice FROM hits
UNION SELECT DISTINCT log, CASE side WHEN 'below' THEN 'raise ' ELSE 'lower ' END || metric FROM outside""")
def u7(spark, sf):
    return logs.recommendations(log_lines(spark, sf))


# --- sessions ------------------------------------------------------------------------


def steps(spark, sf):
    kind = (F.when(F.col("role") == "assistant", "response_complete").when(F.col("role") == "user", "streaming_start").otherwise("error"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("step"), (F.col("conv_id") * 1_000_000_000 + F.col("turn") * 15_000_000).alias("t"),
        kind.alias("step_type"), F.col("text").alias("content"))


STEPS_SQL = """steps AS (
  SELECT conv_id AS session_id, turn AS step, conv_id * 1000000000 + turn * 15000000 AS t,
    CASE role WHEN 'assistant' THEN 'response_complete' WHEN 'user' THEN 'streaming_start' ELSE 'error' END AS step_type, text AS content FROM conversations)"""


@query("s9_sessions", "WITH " + STEPS_SQL + "\nSELECT DISTINCT session_id FROM steps")
def s9(spark, sf):
    return logs.session_list(steps(spark, sf))


@query("a26_session_summary", "WITH " + STEPS_SQL + """
SELECT session_id, count(*) AS total_steps, min(t) AS start_t, max(t) AS end_t, (max(t) - min(t)) / 1e6 AS duration_s,
  count(*) FILTER (step_type = 'response_complete') AS responses FROM steps GROUP BY ALL""")
def a26(spark, sf):
    out = logs.session_summary(steps(spark, sf))
    return out.withColumn("responses", F.coalesce(F.try_element_at("step_types", F.lit("response_complete")), F.lit(0))).drop("step_types")


ISSUES_SQL = "WITH " + STEPS_SQL + """,
low AS (SELECT *, lower(coalesce(content, '')) AS c FROM steps),
totals AS (
  SELECT session_id, count(*) AS n, (max(t) - min(t)) / 1e6 AS s, count(*) FILTER (step_type = 'streaming_start') AS op,
    count(*) FILTER (step_type = 'response_complete') AS done FROM steps GROUP BY ALL),
issues AS (
  SELECT session_id, step, 'explicit_error' AS issue, 'errors' AS "group", 'high' AS severity FROM low WHERE step_type = 'error'
  UNION ALL SELECT session_id, step, 'error_keyword', 'errors', 'medium' FROM low WHERE regexp_matches(c, 'error|failed|exception|traceback|错误|失败|异常')
  UNION ALL SELECT session_id, step, 'api_limit_warning', 'warnings', 'medium' FROM low WHERE contains(c, 'api') AND regexp_matches(c, 'limit|quota|rate|限制|配额')
  UNION ALL SELECT session_id, step, 'timeout_warning', 'warnings', 'low' FROM low WHERE regexp_matches(c, 'timeout|超时|time out')
  UNION ALL SELECT session_id, step, 'contradiction', 'logical', 'medium' FROM low WHERE step_type = 'response_complete' AND contains(content, '不是') AND contains(content, '是')
  UNION ALL SELECT session_id, step, 'short_response', 'incomplete', 'low' FROM low WHERE step_type = 'response_complete' AND length(trim(content)) < 50
  UNION ALL SELECT session_id, NULL, 'slow_response', 'performance', 'medium' FROM totals WHERE s > 60
  UNION ALL SELECT session_id, NULL, 'too_many_steps', 'performance', 'low' FROM totals WHERE n > 20
  UNION ALL SELECT session_id, NULL, 'incomplete_streaming', 'incomplete', 'high' FROM totals WHERE op > done)"""


@query("d18_session_issues", ISSUES_SQL + "\nSELECT session_id, step, issue, \"group\", severity FROM issues")
def d18(spark, sf):
    return logs.session_issues(steps(spark, sf))


@query("d18_issue_summary", ISSUES_SQL + """
SELECT session_id, count(*) AS total_issues, count(*) FILTER (severity = 'high') AS high_severity, count(*) FILTER ("group" = 'errors') AS errors,
  count(*) FILTER ("group" = 'warnings') AS warnings, count(*) FILTER ("group" = 'performance') AS performance,
  CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'serious' WHEN count(*) > 5 THEN 'several' ELSE 'few' END AS verdict FROM issues GROUP BY ALL""")
def d18_summary(spark, sf):
    return logs.issue_summary(d18(spark, sf))


# --- open-ended traces ---------------------------------------------------------------

def trace_lines(spark, sf):
    """Events as JSON lines in which the user is a number, a text or null."""
    user = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('"u'), "user_id", F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(F.concat(
        F.lit('{"id":'), "event_id", F.lit(',"user":'), F.coalesce(user, F.lit("null")), F.lit(',"meta":{"props":'), F.coalesce("props", F.lit("null")),
        F.lit("}}")).alias("value"))


@query("s3_trace_paths", """
WITH seen AS (
  SELECT 'id' AS path, 'BIGINT' AS type FROM events
  UNION ALL SELECT 'user', CASE WHEN user_id IS NULL THEN 'VOID' WHEN user_id % 3 = 0 THEN 'STRING' ELSE 'BIGINT' END FROM events
  UNION ALL SELECT 'meta.props', 'VOID' FROM events WHERE props IS NULL
  UNION ALL SELECT 'meta.props.' || key, CASE json_type(props, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE json_type(props, '$.' || key) END
  FROM (SELECT props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL))
SELECT path, type, count(*) AS records FROM seen GROUP BY ALL""")
def s3_paths(spark, sf):
    return readers.trace_paths(readers.trace_records(trace_lines(spark, sf)))


@query("s3_trace_fields", """
SELECT event_id AS id, CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_number, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id ELSE CAST(user_id AS VARCHAR) END AS user_text,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def s3_fields(spark, sf):
    return readers.trace_fields(readers.trace_records(trace_lines(spark, sf)), {
        "id": ("$.id", "long"), "user_number": ("$.user", "long"), "user_text": ("$.user", "string"), "k": ("$.meta.props.k", "long")})


# --- diffs ---------------------------------------------------------------------------

SPLIT_US = 1_705_363_200_000_000


def run_records(spark, sf, second):
    k = b.prop_k()
    rows = table(spark, sf, "events").filter((b.micros("ts") >= SPLIT_US) == second)
    content = F.create_map(
        F.lit("function"), F.concat(F.lit("fn_"), (k % 10).cast("string")), F.lit("user"), (F.col("user_id") % 7).cast("string"),
        F.lit("size"), F.floor(F.col("value") / 100).cast("string"), F.lit("note"), F.concat(F.lit("v"), (k % 3).cast("string")),
        F.lit("event_id"), F.col("event_id").cast("string"))
    return rows.select(F.col("event_id").alias("idx"), F.col("event_type").alias("kind"), content.alias("content"))


DIFF_SQL = f"""WITH r AS (
  SELECT event_id AS idx, event_type AS kind, 'fn_' || CAST(k % 10 AS VARCHAR) AS f, CAST(user_id % 7 AS VARCHAR) AS u,
    CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS s, 'v' || CAST(k % 3 AS VARCHAR) AS n, epoch_us(ts) >= {SPLIT_US} AS second
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
t1 AS (SELECT *, row_number() OVER (PARTITION BY second, kind, f, u, s, n ORDER BY idx) AS turn FROM r),
m1 AS (SELECT a.idx AS left_idx, b.idx AS right_idx FROM t1 a JOIN t1 b ON NOT a.second AND b.second AND a.kind = b.kind AND a.f = b.f AND a.u = b.u AND a.s = b.s AND a.n = b.n AND a.turn = b.turn),
t2 AS (SELECT *, row_number() OVER (PARTITION BY second, kind ORDER BY idx) AS turn FROM r WHERE idx NOT IN (SELECT left_idx FROM m1) AND idx NOT IN (SELECT right_idx FROM m1)),
m2 AS (
  SELECT a.idx AS left_idx, b.idx AS right_idx, list_filter([CASE WHEN a.f <> b.f THEN 'function' END, CASE WHEN a.n <> b.n THEN 'note' END, CASE WHEN a.s <> b.s THEN 'size' END,
    CASE WHEN a.u <> b.u THEN 'user' END], lambda x: x IS NOT NULL) AS keys,
    list_filter([CASE WHEN a.f <> b.f THEN 'function=' || a.f || ' -> ' || b.f END, CASE WHEN a.n <> b.n THEN 'note=' || a.n || ' -> ' || b.n END,
      CASE WHEN a.s <> b.s THEN 'size=' || a.s || ' -> ' || b.s END, CASE WHEN a.u <> b.u THEN 'user=' || a.u || ' -> ' || b.u END], lambda x: x IS NOT NULL) AS moves
  FROM t2 a JOIN t2 b ON NOT a.second AND b.second AND a.kind = b.kind AND a.turn = b.turn),
diff AS (
  SELECT 'edit' AS change, left_idx, right_idx, array_to_string(keys, ',') AS keys FROM m2 WHERE len(keys) <= 3
  UNION ALL SELECT 'delete', idx, NULL, '' FROM t2 WHERE NOT second AND idx NOT IN (SELECT left_idx FROM m2 WHERE len(keys) <= 3)
  UNION ALL SELECT 'insert', NULL, idx, '' FROM t2 WHERE second AND idx NOT IN (SELECT right_idx FROM m2 WHERE len(keys) <= 3))"""


@query("j13_matched_records", DIFF_SQL + """
SELECT left_idx, right_idx, CAST(0 AS INTEGER) AS differing FROM m1 UNION ALL SELECT left_idx, right_idx, CAST(len(keys) AS INTEGER) FROM m2""")
def j13(spark, sf):
    out = df_.matched_records(run_records(spark, sf, False), run_records(spark, sf, True))
    return out.select("left_idx", "right_idx", F.size("differing").alias("differing"))


@query("j13_nearest_records", DIFF_SQL.split("\nt1 AS")[0].rstrip(",") + """,
pairs AS (
  SELECT a.idx AS left_idx, b.idx AS right_idx,
    CAST(a.f <> b.f AS INTEGER) + CAST(a.u <> b.u AS INTEGER) + CAST(a.s <> b.s AS INTEGER) + CAST(a.n <> b.n AS INTEGER) AS differing
  FROM r a JOIN r b ON NOT a.second AND b.second AND a.kind = b.kind)
SELECT left_idx, first.right_idx AS right_idx, first.differing AS differing
FROM (SELECT left_idx, min(struct_pack(differing := differing, right_idx := right_idx)) AS first FROM pairs GROUP BY left_idx)""")
def j13_nearest(spark, sf):
    return df_.nearest_records(run_records(spark, sf, False), run_records(spark, sf, True))


@query("i28_run_diff", DIFF_SQL + "\nSELECT change, left_idx, right_idx, keys FROM diff")
def i28(spark, sf):
    return df_.run_diff(run_records(spark, sf, False), run_records(spark, sf, True), 3).select("change", "left_idx", "right_idx", "keys")


@query("i30_edit_patterns", DIFF_SQL + r"""
SELECT regexp_replace(unnest(moves), '\d+', '0', 'g') AS pattern, count(*) AS times FROM m2 WHERE len(keys) <= 3 GROUP BY 1""")
def i30(spark, sf):
    return df_.edit_patterns(df_.run_diff(run_records(spark, sf, False), run_records(spark, sf, True), 3))


def part_records(spark, sf):
    """Parts as lines whose contents hold no numbers, so that many different ones remain."""
    def letter(number):
        return F.chr(F.lit(65) + number % 26)

    words = F.split("p_name", " ")
    content = F.create_map(
        F.lit("colour"), words[0], F.lit("thing"), F.element_at(words, -1), F.lit("type"), F.col("p_type"),
        F.lit("brand"), letter(F.substring("p_brand", 7, 5).cast("long")), F.lit("size"), letter(F.col("p_size")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), content.alias("content"))


# Contents by first line with the earlier near ones of each; then a pass over them that holds the leaders so far.
I30_SQL = """
WITH RECURSIVE parts AS (
  SELECT p_partkey AS idx, split_part(p_name, ' ', 1) AS colour, string_split(p_name, ' ')[-1] AS thing, p_type AS type,
    chr(CAST(65 + CAST(substr(p_brand, 7, 5) AS BIGINT) % 26 AS INTEGER)) AS brand, chr(CAST(65 + p_size % 26 AS INTEGER)) AS size FROM part),
c AS (
  SELECT row_number() OVER (ORDER BY min(idx)) AS i, count(*) AS times, colour, thing, type, brand, size FROM parts GROUP BY ALL),
near AS (
  SELECT b.i, list(a.i) AS earlier FROM c a JOIN c b ON a.i < b.i AND CAST(a.colour <> b.colour AS INTEGER) + CAST(a.thing <> b.thing AS INTEGER)
    + CAST(a.type <> b.type AS INTEGER) + CAST(a.brand <> b.brand AS INTEGER) + CAST(a.size <> b.size AS INTEGER) <= 3 GROUP BY b.i),
taken AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders, CAST(0 AS BIGINT) AS leader
  UNION ALL
  SELECT n.i, CASE WHEN n.first IS NULL THEN list_append(n.leaders, n.i) ELSE n.leaders END, coalesce(n.first, n.i)
  FROM (SELECT c.i, t.leaders, list_min(list_intersect(near.earlier, t.leaders)) AS first
        FROM taken t JOIN c ON c.i = t.i + 1 LEFT JOIN near ON near.i = c.i) n)
SELECT concat_ws(chr(31), 'brand=' || l.brand, 'colour=' || l.colour, 'size=' || l.size, 'thing=' || l.thing, 'type=' || l.type) AS pattern,
  CAST(sum(c.times) AS BIGINT) AS times, count(*) AS variants
FROM taken t JOIN c ON c.i = t.i JOIN c l ON l.i = t.leader GROUP BY 1"""


@query("i30_line_patterns", I30_SQL)
def i30_lines(spark, sf):
    return df_.line_patterns(part_records(spark, sf))


@query("f8_differing_keys", """
WITH o AS (SELECT l_orderkey, l_returnflag AS f, l_linestatus AS s, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem),
e AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_custkey % 7 AS VARCHAR) AS n, o_orderpriority AS p FROM orders)
SELECT l_orderkey, s1, CAST(CAST(s1 <> s2 AS INTEGER) + CAST(n1 <> n2 AS INTEGER) + 2 AS INTEGER) AS differing, count(*) AS lines
FROM (SELECT l_orderkey, o.s AS s1, e.s AS s2, o.n AS n1, e.n AS n2 FROM o JOIN e ON l_orderkey = o_orderkey) GROUP BY ALL""")
def f8(spark, sf):
    # The maps are made behind the join, so that plain columns are sorted for it.
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linestatus").alias("s1"), "l_linenumber")
    order = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    joined = line.join(order, line.l_orderkey == order.o_orderkey)
    a = F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "s1", F.lit("number"), F.col("l_linenumber").cast("string"))
    b = F.create_map(
        F.lit("status"), "o_orderstatus", F.lit("number"), (F.col("o_custkey") % 7).cast("string"), F.lit("priority"), "o_orderpriority")
    maps = joined.select("l_orderkey", "s1", a.alias("a"), b.alias("b"))
    return maps.select("l_orderkey", "s1", F.size(df_.differing_keys(F.col("a"), F.col("b"))).alias("differing")).groupBy(
        "l_orderkey", "s1", "differing").agg(F.count(F.lit(1)).alias("lines"))


def rule_sets(spark, sf, second):
    rows = run_records(spark, sf, second)
    return rows.withColumn("kind", F.concat("kind", F.lit("/"), F.element_at("content", "function")))


@query("j14_i29_invariant_diff", DIFF_SQL.replace("event_type AS kind", "event_type || '/fn_' || CAST(k % 10 AS VARCHAR) AS kind") + """
SELECT change, left_idx, right_idx, keys FROM diff""")
def i29(spark, sf):
    # The kind stands for the description of a rule, which must be equal.
    return df_.run_diff(rule_sets(spark, sf, False), rule_sets(spark, sf, True), 3).select("change", "left_idx", "right_idx", "keys")


def text_patterns(spark, sf, run):
    lines = table(spark, sf, "documents").filter(run).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.trim(df_.masked(F.col("line"))).alias("pattern"))


# The two runs are the even and the odd documents, so that every line is in one of them.
U1_SQL = r"""
WITH p AS (SELECT coalesce(doc_id, 0) % 2 <> 0 AS second, trim(regexp_replace(unnest(string_split(text, chr(10))), '\d+', '0', 'g')) AS pattern FROM documents)
SELECT pattern FROM p WHERE second EXCEPT SELECT pattern FROM p WHERE NOT second"""


@query("u1_all_new_patterns", U1_SQL)
@query("u1_new_patterns", U1_SQL)
def u1(spark, sf):
    second = "coalesce(doc_id, 0) % 2 <> 0"
    return df_.new_patterns(text_patterns(spark, sf, f"not ({second})"), text_patterns(spark, sf, second))


@query("f7_masked_texts", r"""
SELECT md5(regexp_replace(text, '\d+', '0', 'g')) AS pattern, count(*) AS documents FROM documents GROUP BY ALL""")
def f7(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(df_.masked(F.col("text"))).alias("pattern")).agg(F.count(F.lit(1)).alias("documents"))


@query("f7_text_distance", """
SELECT a.page_id, CAST(levenshtein(a.url, b.url) AS INTEGER) AS distance FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def f7_distance(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return pages.join(after, "page_id").select("page_id", df_.text_distance(F.col("url"), F.col("next_url")).alias("distance"))


# --- formats -------------------------------------------------------------------------

@query("f1_parsed_times", """
SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS text_ms, (event_id * 7.5::DOUBLE) * 1000 AS number_ms, CAST(NULL AS DOUBLE) AS other_ms FROM events""")
def f1(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, sf, "events").select(
        "event_id", tx.time_ms(stamp).alias("text_ms"), tx.time_ms((F.col("event_id") * F.lit(7.5)).cast("decimal(20,1)").cast("string")).alias("number_ms"),
        tx.time_ms(F.col("event_type")).alias("other_ms"))


def _half_even_sql(divisor: int, places: int, unit: str) -> str:
    """x / divisor with ties to even, in whole numbers, as the text of a size or duration."""
    scaled = f"(x::HUGEINT * {10 ** places})"
    up = f"({scaled} % {divisor} * 2 > {divisor} OR ({scaled} % {divisor} * 2 = {divisor} AND {scaled} // {divisor} % 2 = 1))"
    return f"printf('%.{places}f{unit}', CAST({scaled} // {divisor} + CAST({up} AS INTEGER) AS DOUBLE) / {10 ** places})"


@query("f2_formatted_values", f"""
WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 4000 + 1) AS x FROM orders)
SELECT o_orderkey, CASE WHEN x < 1024 THEN printf('%.0fB', x::DOUBLE) WHEN x < 1048576 THEN {_half_even_sql(1024, 2, 'KB')}
    WHEN x < 1073741824 THEN {_half_even_sql(1048576, 2, 'MB')} ELSE {_half_even_sql(1073741824, 2, 'GB')} END AS size,
  CASE WHEN x < 1000 THEN printf('%.2fus', x::DOUBLE) WHEN x < 1000000 THEN {_half_even_sql(1000, 2, 'ms')} ELSE {_half_even_sql(1000000, 3, 's')} END AS duration FROM v""")
def f2(spark, sf):
    x = b.long_of("o_totalprice") * (F.col("o_orderkey") % 4000 + 1)
    return table(spark, sf, "orders").select("o_orderkey", tx.bytes_text(x).alias("size"), tx.duration_text(x).alias("duration"))


@query("f2_clock_text", "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%H:%M:%S.%g') AS clock FROM events")
def f2_clock(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.clock_text(F.floor(b.micros("ts") / 1000)).alias("clock"))


@query("f3_size_ranges", """
SELECT CASE WHEN x < 16 THEN '0-16B' WHEN x < 64 THEN '16-64B' WHEN x < 256 THEN '64-256B' WHEN x < 1024 THEN '256B-1KB' WHEN x < 4096 THEN '1-4KB'
  WHEN x < 16384 THEN '4-16KB' WHEN x < 65536 THEN '16-64KB' WHEN x < 262144 THEN '64-256KB' WHEN x < 1048576 THEN '256KB-1MB' WHEN x < 4194304 THEN '1-4MB'
  WHEN x < 16777216 THEN '4-16MB' WHEN x < 67108864 THEN '16-64MB' ELSE '>64MB' END AS size_range, count(*) AS allocations
FROM (SELECT CAST(floor(l_extendedprice) AS BIGINT) * (l_partkey % 1000) AS x FROM lineitem) GROUP BY 1""")
def f3(spark, sf):
    x = b.long_of("l_extendedprice") * (F.col("l_partkey") % 1000)
    return table(spark, sf, "lineitem").groupBy(tx.size_range(x).alias("size_range")).agg(F.count(F.lit(1)).alias("allocations"))


@query("f4_f5_connection_keys", """
SELECT o_orderkey, (a & 255) || '.' || (a >> 8 & 255) || '.' || (a >> 16 & 255) || '.' || (a >> 24 & 255) || ':' || (o_orderkey % 1024) || '->10.0.0.1:80 (' ||
  CASE o_orderkey % 4 WHEN 0 THEN 'Proto(0)' WHEN 1 THEN 'ICMP' WHEN 2 THEN 'Proto(2)' ELSE 'Proto(3)' END || ')' AS connection
FROM (SELECT o_orderkey, o_custkey * 7919 % 4294967296 AS a FROM orders)""")
def f4(spark, sf):
    a = F.col("o_custkey") * 7919 % F.lit(2**32)
    return table(spark, sf, "orders").select("o_orderkey", tx.connection_key(
        tx.ipv4_text(a), F.col("o_orderkey") % 1024, F.lit("10.0.0.1"), F.lit(80), tx.protocol_name(F.col("o_orderkey") % 4)).alias("connection"))


@query("f6_hex_addresses", "SELECT o_orderkey, '0x' || lower(to_hex(o_orderkey * 4096)) AS address FROM orders")
def f6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.hex_address(F.col("o_orderkey") * 4096).alias("address"))


@query("f16_nested_values", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.nested_value(F.col("props"), "$.k").alias("k"))


# --- projections and stacks ----------------------------------------------------------

@query("p1_events_of_process", "SELECT event_id, user_id AS pid, user_id % 10 AS ppid FROM events WHERE user_id = 7 OR user_id % 10 = 7")
def p1(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("pid"), (F.col("user_id") % 10).alias("ppid"))
    return ev.of_process(rows, 7)


@query("p2_frames_kept", """
SELECT page_id, CAST(len(list_filter(string_split(url, '/'), lambda f: trim(f) <> '' AND NOT starts_with(trim(f), 'http'))) AS INTEGER) AS frames FROM pages""")
def p2(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(tx.without_launch_frames(F.split("url", "/"), "http")).alias("frames"))


@query("p3_csv_rows", "WITH " + b.IO_SQL + tele.IO_STATS.format(keys="pid").replace("SELECT", ", st AS (SELECT", 1) + """)
SELECT 0 AS ts, pid, read_bytes, write_bytes, round(avg_read_us / 1000, 5) AS read_latency_ms, round(avg_write_us / 1000, 5) AS write_latency_ms, read_ops, write_ops FROM st""")
def p3(spark, sf):
    stats = tele.io_stats(spark, sf, ["pid"])
    named = stats.withColumns({"ts": F.lit(0), "read_latency_ms": F.round(F.col("avg_read_us") / 1000, 5), "write_latency_ms": F.round(F.col("avg_write_us") / 1000, 5)})
    return ev.csv_rows(named, "io")


@query("p4_trace_events", "WITH " + b.function_events_sql() + """
SELECT t / 1000.0::DOUBLE AS ts, tgid AS pid, pid AS tid, function_name AS name, CASE WHEN is_enter THEN 'B' ELSE 'E' END AS ph, cookie FROM fe""")
def p4(spark, sf):
    return ev.trace_events(b.function_events(spark, sf))


def stack_samples(spark, sf):
    k = b.prop_k()
    names = F.array(F.lit("main.py:run"), F.concat(F.lit("loop.py:l"), (F.col("user_id") % 3).cast("string")),
                    F.concat(F.lit("op.py:o"), (k % 4).cast("string")), F.concat(F.lit("kern.cu:k"), (k % 7).cast("string")))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), b.micros("ts").alias("t"), F.col("event_id").alias("seq"), F.slice(names, F.lit(1), (k % 4 + 1).cast("int")).alias("frames"))


@query("w19_stack_slices", r"""
WITH s AS (
  SELECT user_id AS pid, epoch_us(ts) AS t, event_id AS seq, list_slice(['main.py:run', 'loop.py:l' || (user_id % 3), 'op.py:o' || (k % 4), 'kern.cu:k' || (k % 7)], 1, k % 4 + 1) AS frames
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
l AS (SELECT *, coalesce(lag(frames) OVER (PARTITION BY pid ORDER BY t, seq), []) AS old FROM s),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(old), len(frames)) + 1), lambda i: old[i] <> frames[i])) - 1, least(len(old), len(frames))) AS common FROM l),
out_ AS (
  SELECT pid, t, 'E' AS phase, old[len(old) - i] AS name, len(old) - 1 - i AS depth, i FROM c, LATERAL (SELECT unnest(range(0, len(old) - common)) AS i)
  UNION ALL
  SELECT pid, t, 'B', frames[common + 1 + j], common + j, len(old) - common + j FROM c, LATERAL (SELECT unnest(range(0, len(frames) - common)) AS j)),
last_ AS (SELECT pid, max_by(frames, struct_pack(a := t, b := seq)) AS frames FROM s GROUP BY pid)
SELECT pid, t + i AS ts, phase, name, CAST(depth AS INTEGER) AS depth FROM out_
UNION ALL SELECT pid, (SELECT max(t) + 1 FROM s) + i, 'E', frames[len(frames) - i], CAST(len(frames) - 1 - i AS INTEGER) FROM last_, LATERAL (SELECT unnest(range(0, len(frames))) AS i)""")
def w19(spark, sf):
    return ev.stack_slices(stack_samples(spark, sf))


@query("w20_cpu_use", """
WITH s AS (SELECT user_id AS pid, epoch_us(ts) AS t, event_id AS seq,
    CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_time FROM events),
l AS (SELECT *, run_time - lag(run_time) OVER (PARTITION BY pid ORDER BY t, seq) AS oncpu FROM s)
SELECT pid, t, oncpu, 1000 - oncpu AS offcpu, round(oncpu / 1000, 6) AS share FROM l WHERE oncpu IS NOT NULL""")
def w20(spark, sf):
    from tallyforge.operators.pairing import order_columns
    from tallyforge.ordered import running

    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), b.micros("ts").alias("t"), F.col("event_id").alias("seq"), b.long_of("value").alias("v"), F.lit(1000).cast("long").alias("period"))
    return ev.cpu_use(running(rows, ["pid"], order_columns(), {"run_time": ("sum", F.col("v"))})).select(
        "pid", "t", "oncpu", "offcpu", F.round("share", 6).alias("share"))


@query("p13_call_graph_nodes", """
SELECT CASE WHEN part_no % 2 = 0 THEN 'function' ELSE 'method' END AS kind, 'mod.' || lower(p_type) AS module, split_part(p_name, ' ', 1) AS function,
  CAST(p_size % 6 AS INTEGER) AS depth FROM (SELECT *, p_partkey AS part_no FROM part) WHERE p_size % 6 <= 3 AND p_partkey % 5 <> 0""")
def p13(spark, sf):
    hidden = F.when(F.col("p_partkey") % 5 == 0, "_").otherwise("")
    lines = table(spark, sf, "part").select(F.concat(
        F.lit("<Node "), F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("method"), F.lit(":mod."), F.lower("p_type"), F.lit("."), hidden,
        F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("> - "), (F.col("p_size") % 6).cast("string")).alias("value"))
    return ev.call_graph_nodes(lines, 3, up_to=True)


# --- parsers on derived text ---------------------------------------------------------

@query("s5_s13_stack_lines", """
SELECT epoch_us(ts) AS ts, user_id AS pid, CAST(k % 4 + 1 AS INTEGER) AS frame_count,
  array_to_string(list_slice(['main.py:run', 'loop.py:l' || (user_id % 3), 'op.py:o' || (k % 4), 'kern.cu:k' || (k % 7)], 1, k % 4 + 1), '>') AS frames
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def s5(spark, sf):
    lines = stack_samples(spark, sf).select(writers.stack_line(F.col("t"), F.col("pid"), F.reverse("frames")).alias("value"))
    return readers.parse_stack_lines(lines).withColumn("frames", F.concat_ws(">", "frames"))


@query("s6_stack_blocks", """
SELECT epoch_us(ts) AS ts, user_id AS pid, CAST(2 AS INTEGER) AS frame_count, 'a.py:' || event_type || '>b.py:f' || (event_id % 5) AS frames FROM events""")
def s6(spark, sf):
    n = F.lit("\n")
    block = F.concat(F.lit("EVENT"), n, F.lit("timestamp="), b.micros("ts").cast("string"), n, F.lit("pid="), F.col("user_id").cast("string"), n,
                     F.lit("frames=2"), n, F.lit("frame0=a.py:"), F.col("event_type"), n, F.lit("frame1=b.py:f"), (F.col("event_id") % 5).cast("string"), n)
    return readers.parse_stack_blocks(table(spark, sf, "events").select(block.alias("value"))).withColumn("frames", F.concat_ws(">", "frames"))


@query("s7_memory_maps", """
SELECT o_custkey AS snapshot, o_orderkey * 4096 AS address, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey % 2 = 0 AS is_oom FROM orders""")
def s7(spark, sf):
    line = F.concat(tx.hex_address(F.col("o_orderkey") * 4096), F.lit(", "), b.long_of("o_totalprice").cast("string"), F.lit(" bytes"))
    maps = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("snapshot")).agg(F.concat_ws("\n", F.collect_list(line)).alias("_lines"))
    oom = F.when(F.col("snapshot") % 2 == 0, "true").otherwise("false")
    out = readers.parse_snapshots(maps.select("snapshot", F.concat("_lines", F.lit("\nis_oom:"), oom).alias("value")))
    return out.withColumn("address", F.col("address").cast("long"))


@query("s8_allocation_lines", "SELECT o_orderkey * 4096 AS address, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders")
def s8(spark, sf):
    line = F.concat(tx.hex_address(F.col("o_orderkey") * 4096), F.lit(", "), b.long_of("o_totalprice").cast("string"))
    out = readers.parse_allocations(table(spark, sf, "orders").select(line.alias("value")))
    return out.withColumn("address", F.col("address").cast("long"))


@query("s1_domain_counts", """
SELECT CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'io' WHEN 'error' THEN 'memory' WHEN 'purchase' THEN 'network' ELSE 'function' END AS domain, count(*) AS n
FROM events GROUP BY 1""")
def s1(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").withColumn("domain", F.when(kind == "view", "cpu").when(kind == "click", "io").when(kind == "error", "memory")
                                                 .when(kind == "purchase", "network").otherwise("function"))
    parts = [d.groupBy("domain").agg(F.count(F.lit(1)).alias("n")) for d in ev.fan_out(rows).values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s4_flattened_structs", """
SELECT event_id, event_type AS "meta_vars.stage.name", user_id AS "meta_vars.user", props AS k FROM events""")
def s4(spark, sf):
    nested = table(spark, sf, "events").select("event_id", F.struct(
        F.struct(F.col("event_type").alias("name")).alias("stage"), F.col("user_id").alias("user")).alias("meta_vars"),
        F.struct(F.col("props").alias("k")).alias("args"))
    return readers.flattened(nested).withColumn("k", F.col("args.k")).drop("args")


# --- streams in batch form -----------------------------------------------------------

@query("r1_window_counters", """
SELECT user_id AS pid, epoch_us(ts) // 3600000000 * 3600000000 AS window_start, count(*) AS events, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS oncpu_total
FROM events GROUP BY ALL""")
def r1(spark, sf):
    from tallyforge.streaming import counters

    rows = b.cpu_samples(spark, sf).withColumn("ts", F.timestamp_micros("t"))
    return counters.hourly_counters(rows).select("pid", F.unix_micros("window_start").alias("window_start"), "events", "oncpu_total")


@query("r3_one_warning_per_day", """
SELECT l_suppkey AS pid, t // 86400000000 AS slot, min(t) AS t FROM (SELECT l_suppkey, epoch_us(l_shipdate) AS t FROM lineitem WHERE l_quantity > 45) GROUP BY ALL""")
def r3(spark, sf):
    warned = b.io_events(spark, sf).filter("latency_us > 45000")
    return rules.one_per_slot(warned, ["pid"], 86_400_000_000).select("pid", "slot", "t")


@query("r3_one_clock", """
WITH RECURSIVE w AS (
  SELECT epoch_us(l_shipdate) AS t, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_extendedprice) AS seq, l_suppkey AS pid
  FROM lineitem WHERE l_quantity > 45),
nodes AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY t ORDER BY seq) = 1),
jump AS (SELECT t, min(t) OVER (ORDER BY t RANGE BETWEEN 259200000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM nodes),
passed AS (SELECT min(t) AS t FROM nodes UNION ALL SELECT j.after FROM passed p JOIN jump j ON p.t = j.t WHERE j.after IS NOT NULL)
SELECT pid, t FROM nodes JOIN passed USING (t)""")
def r3_clock(spark, sf):
    warned = b.io_events(spark, sf).filter("latency_us > 45000").select("pid", "t", "seq")
    return rules.once_per_interval(warned, [], 3 * 86_400_000_000).select("pid", "t")


@query("r5_idle_clients", """
WITH g AS (SELECT user_id AS client, ts, CASE WHEN lag(ts) OVER w >= ts - INTERVAL 1 DAY THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY client ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT client, epoch_us(min(ts)) AS active_from, epoch_us(max(ts)) + 86400000000 AS idle_from, count(*) AS events FROM s GROUP BY client, n""")
def r5(spark, sf):
    from tallyforge.streaming import counters

    rows = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.timestamp_micros(b.micros("ts")).alias("ts"))
    out = counters.client_sessions(rows, "1 day")
    return out.select("client", F.unix_micros("active_from").alias("active_from"), F.unix_micros("idle_from").alias("idle_from"), "events")
