"""Queries over metric series, built from the events of each type in half-hour slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import series as s
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import query, table

METRICS = ["events", "total", "peak"]
SLOT_US = 1_800_000_000


def kpi_points(spark, sf) -> DataFrame:
    """One row per series and slot without holes: events, total, peak."""
    raw = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("series"), F.floor(b.micros("ts") / SLOT_US).alias("slot")).agg(
        F.count(F.lit(1)).cast("double").alias("events"), F.round(F.sum("value"), 2).alias("total"),
        F.max("value").alias("peak"))
    span = raw.groupBy("series").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    grid = span.select("series", "low", F.explode(F.sequence("low", "high")).alias("slot"))
    return grid.join(raw, ["series", "slot"], "left").fillna(0.0, METRICS).select(
        "series", (F.col("slot") - F.col("low")).alias("t"), *METRICS)


def kpi(spark, sf) -> DataFrame:
    return kpi_points(spark, sf).unpivot(["series", "t"], METRICS, "metric", "value")


KPI_SQL = f"""raw AS (
  SELECT event_type AS series, epoch_us(ts) // {SLOT_US} AS slot, CAST(count(*) AS DOUBLE) AS events,
         round(sum(value), 2) AS total, max(value) AS peak FROM events GROUP BY ALL),
span AS (SELECT series, min(slot) AS low, max(slot) AS high FROM raw GROUP BY series),
grid AS (SELECT series, low, unnest(range(low, high + 1)) AS slot FROM span),
points AS (
  SELECT grid.series, grid.slot - low AS t, coalesce(events, 0) AS events, coalesce(total, 0) AS total, coalesce(peak, 0) AS peak
  FROM grid LEFT JOIN raw ON grid.series = raw.series AND grid.slot = raw.slot),
kpi AS (
  SELECT series, t, 'events' AS metric, events AS value FROM points
  UNION ALL SELECT series, t, 'total', total FROM points UNION ALL SELECT series, t, 'peak', peak FROM points),
scaled AS (
  SELECT series, t, metric, CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.5
    ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS value
  FROM kpi WINDOW w AS (PARTITION BY series, metric)),
lengths AS (SELECT series, max(t) + 1 AS n FROM points GROUP BY series)"""


def windows_sql(source: str, window: int, stride: int) -> str:
    return f"""(
  SELECT p.*, k FROM {source} p JOIN lengths USING (series),
    LATERAL (SELECT unnest(range(greatest(CAST(floor((t - {window}) / {stride}.0) AS BIGINT) + 1, 0),
      least(t // {stride}, greatest(CAST(ceil((n - {window}) / {stride}.0) AS BIGINT), 0)) + 1)) AS k))"""


@query("s2_metric_table", "WITH " + KPI_SQL + "\nSELECT series, t, metric, value FROM kpi")
def s2(spark, sf):
    return kpi(spark, sf)


@query("w15_scaled", "WITH " + KPI_SQL + "\nSELECT series, t, metric, round(value, 9) AS value FROM scaled")
def w15(spark, sf):
    return s.scaled(kpi(spark, sf)).select("series", "t", "metric", F.round("value", 9).alias("value"))


@query("w16_other_scalings", "WITH " + KPI_SQL + """
SELECT series, t, metric, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 9) AS linear,
  round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 7) AS z_score,
  round(atan(value) * 2 / pi(), 9) AS atan, round(1 / (1 + exp(-value)), 9) AS sigmoid, round(tanh(value), 9) AS tanh
FROM kpi WINDOW w AS (PARTITION BY series, metric)""")
def w16(spark, sf):
    out = s.rescaled(kpi(spark, sf))
    places = {"linear": 9, "z_score": 7, "atan": 9, "sigmoid": 9, "tanh": 9}
    return out.select("series", "t", "metric", *[F.round(c, p).alias(c) for c, p in places.items()])


@query("w11_mean_distance", "WITH " + KPI_SQL + ",\nplaced AS " + windows_sql("scaled", 48, 12) + """,
means AS (SELECT series, k, metric, avg(value) AS m FROM placed GROUP BY ALL),
dist AS (SELECT series, t, k, sqrt(sum((value - m) * (value - m))) AS d FROM placed JOIN means USING (series, k, metric) GROUP BY ALL)
SELECT series, t, round(avg(d), 7) AS score FROM dist GROUP BY ALL""")
def w11(spark, sf):
    return s.mean_distance(s.scaled(kpi(spark, sf)), 48, 12).withColumn("score", F.round("score", 7))


@query("w12_smoothed", "WITH " + KPI_SQL + """,
m AS (
  SELECT *, CASE WHEN count(value) OVER w = 18 THEN avg(value) OVER w END AS mean
  FROM kpi WINDOW w AS (PARTITION BY series, metric ORDER BY t ROWS BETWEEN 17 PRECEDING AND CURRENT ROW))
SELECT series, t, metric, round(coalesce(mean, first_value(mean IGNORE NULLS) OVER
  (PARTITION BY series, metric ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1e-9, 6) AS smoothed FROM m""")
def w12(spark, sf):
    return s.smoothed(kpi(spark, sf)).select("series", "t", "metric", F.round(F.col("smoothed") + 1e-9, 6).alias("smoothed"))


@query("w13_trailing_mean", "WITH " + KPI_SQL + """
SELECT series, t, metric, round(avg(value) OVER w + 1e-9, 6) AS back_mean FROM kpi
WINDOW w AS (PARTITION BY series, metric ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) QUALIFY count(value) OVER w = 24""")
def w13(spark, sf):
    return s.trailing_mean(kpi(spark, sf), 24).select("series", "t", "metric", F.round(F.col("back_mean") + 1e-9, 6).alias("back_mean"))


@query("w14_box_smoothed", "WITH " + KPI_SQL + """
SELECT series, t, metric, round(sum(value) OVER w / 7 + 1e-9, 6) AS box FROM kpi
WINDOW w AS (PARTITION BY series, metric ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def w14(spark, sf):
    return s.box_smoothed(kpi(spark, sf), 7).select("series", "t", "metric", F.round(F.col("box") + 1e-9, 6).alias("box"))


def errors(spark, sf):
    """Distance of each scaled value to its trailing mean, as a stand-in for a rebuilt series."""
    scaled = s.scaled(kpi(spark, sf))
    mean = s.box_smoothed(scaled, 25)
    return mean.select("series", "t", "metric", F.abs(F.col("value") - F.col("box")).alias("error"))


ERRORS_SQL = KPI_SQL + """,
errors AS (
  SELECT series, t, metric, abs(value - sum(value) OVER w / 25) AS error FROM scaled
  WINDOW w AS (PARTITION BY series, metric ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))"""

SCORES_SQL = "WITH " + ERRORS_SQL + ",\nplaced AS " + windows_sql("errors", 12, 2) + """,
spread AS (SELECT series, k, metric, quantile_cont(error, 0.9) - avg(error) AS d FROM placed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series, k ORDER BY d DESC) AS r FROM spread),
wscores AS (
  SELECT series, k, coalesce(CASE WHEN bool_or(d = 0) THEN 0 ELSE count(*) / sum(1 / d) END, 0) AS score
  FROM ranked WHERE r <= 2 GROUP BY ALL),
pscores AS (
  SELECT series, t, avg(score) AS score FROM wscores JOIN lengths USING (series),
    LATERAL (SELECT unnest(range(k * 2, least(k * 2 + 12, n))) AS t) GROUP BY ALL)"""


def point_scores(spark, sf):
    scored = s.window_scores(errors(spark, sf))
    lengths = kpi_points(spark, sf).groupBy("series").agg((F.max("t") + 1).alias("n"))
    return s.point_scores(scored, lengths)


@query("m6_window_scores", SCORES_SQL + "\nSELECT series, k, round(score, 7) AS score FROM wscores")
def m6(spark, sf):
    return s.window_scores(errors(spark, sf)).withColumn("score", F.round("score", 7))


@query("m7_point_scores", SCORES_SQL + "\nSELECT series, t, round(score, 7) AS score FROM pscores")
def m7(spark, sf):
    return point_scores(spark, sf).withColumn("score", F.round("score", 7))


LABELS_SQL = SCORES_SQL + """,
blocks AS (SELECT series, t // 12 AS block, t, score FROM pscores),
sums AS (SELECT series, block, count(*) AS n, sum(score) AS s, sum(score * score) AS q FROM blocks GROUP BY ALL),
limits AS (
  SELECT series, block, sum(s) OVER w / sum(n) OVER w AS mean, sum(q) OVER w / sum(n) OVER w AS square
  FROM sums WINDOW w AS (PARTITION BY series ORDER BY block ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
clipped AS (
  SELECT series, block, mean + 3 * sqrt(greatest(square - mean * mean, 0)) AS raw FROM limits),
labels_ AS (
  SELECT series, t, score, CASE WHEN raw >= 1 THEN 0.999 WHEN raw <= 0 THEN 0.001 ELSE raw END AS threshold
  FROM blocks JOIN clipped USING (series, block)),
predicted AS (SELECT *, CAST(score > threshold AS INTEGER) AS label FROM labels_)"""


def predicted(spark, sf):
    return s.sliding_threshold(point_scores(spark, sf), 288, 12)


@query("m8_sliding_threshold", LABELS_SQL + "\nSELECT series, t, round(threshold, 7) AS threshold, label FROM predicted")
def m8(spark, sf):
    return predicted(spark, sf).select("series", "t", F.round("threshold", 7).alias("threshold"), "label")


# The truth is a busy slot: one with at least as many events as the hundredth part of all slots have.
TRUTH_SQL = """,
busy AS (SELECT series, quantile_cont(events, 0.99) AS cut FROM points GROUP BY series),
truth AS (SELECT series, t, CAST(events >= cut AS INTEGER) AS truth FROM points JOIN busy USING (series)),
wide AS (
  SELECT series, t, max(truth) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS truth FROM truth),
judged AS (SELECT predicted.*, truth FROM predicted JOIN wide USING (series, t)),
turns AS (SELECT *, CASE WHEN lag(truth) OVER w = truth THEN 0 ELSE 1 END AS turn FROM judged WINDOW w AS (PARTITION BY series ORDER BY t)),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM turns)"""


def truth(spark, sf):
    points = kpi_points(spark, sf)
    cut = points.groupBy("series").agg(F.percentile("events", 0.99).alias("cut"))
    return points.join(cut, "series").select("series", "t", (F.col("events") >= F.col("cut")).cast("int").alias("truth"))


def judged(spark, sf):
    return s.labelled(predicted(spark, sf), s.widened(truth(spark, sf)))


@query("m21_widened_labels", LABELS_SQL + TRUTH_SQL + "\nSELECT series, t, truth FROM wide")
def m21(spark, sf):
    return s.widened(truth(spark, sf))


@query("j15_predictions_with_labels", LABELS_SQL + TRUTH_SQL + "\nSELECT series, t, label, truth FROM judged")
def j15(spark, sf):
    return judged(spark, sf).select("series", "t", "label", "truth")


@query("m20_differing_points", LABELS_SQL + TRUTH_SQL + """
SELECT series, t, label, truth AS other FROM judged WHERE label <> truth""")
def m20(spark, sf):
    wide = s.widened(truth(spark, sf)).withColumnRenamed("truth", "label")
    return s.differing_points(predicted(spark, sf), wide).select("series", "t", "label", "other")


@query("m18_range_adjusted", LABELS_SQL + TRUTH_SQL + """
SELECT series, t, truth, CASE WHEN truth = 1 THEN max(label) OVER (PARTITION BY series, island) ELSE label END AS adjusted FROM runs""")
def m18(spark, sf):
    return s.range_adjusted(judged(spark, sf), "label").select("series", "t", "truth", "adjusted")


EVALUATED_SQL = LABELS_SQL + TRUTH_SQL + """,
adjusted AS (
  SELECT series, truth, CASE WHEN truth = 1 THEN max(label) OVER (PARTITION BY series, island) ELSE label END AS hit FROM runs),
counts AS (
  SELECT series, count(*) FILTER (hit = 1 AND truth = 1) AS tp, count(*) FILTER (hit = 1 AND truth = 0) AS fp,
         count(*) FILTER (hit = 0 AND truth = 1) AS fn, count(*) FILTER (hit = 0 AND truth = 0) AS tn FROM adjusted GROUP BY series),
quality AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM counts)"""


def quality(spark, sf):
    rows = s.range_adjusted(judged(spark, sf), "label").drop("label").withColumnRenamed("adjusted", "label")
    return s.confusion(rows, ["series"])


@query("m19_precision_recall", EVALUATED_SQL + """
SELECT series, tp, fp, fn, tn, round(precision, 7) AS precision, round(recall, 7) AS recall, round(f1, 7) AS f1 FROM quality""")
def m19(spark, sf):
    out = quality(spark, sf)
    return out.withColumns({c: F.round(c, 7) for c in ("precision", "recall", "f1")})


@query("a30_mean_f1", EVALUATED_SQL + """
SELECT length(series) AS dataset, round(avg(precision), 7) AS precision, round(avg(recall), 7) AS recall, round(avg(f1), 7) AS f1
FROM quality GROUP BY 1""")
def a30(spark, sf):
    runs = quality(spark, sf).withColumn("dataset", F.length("series").cast("long"))
    return s.mean_scores(runs).select("dataset", *[F.round(c, 7).alias(c) for c in ("precision", "recall", "f1")])


def best_sql(source: str, keys: str) -> str:
    return f"""
grid100 AS (SELECT unnest(range(100)) / 100 AS threshold),
steps_ AS (
  SELECT {keys} threshold, count(*) FILTER (adjusted >= threshold AND truth = 1) AS tp,
         count(*) FILTER (adjusted >= threshold AND truth = 0) AS fp, count(*) FILTER (adjusted < threshold AND truth = 1) AS fn
  FROM {source}, grid100 GROUP BY ALL),
f AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM steps_)
SELECT {keys} threshold, round(precision, 7) AS precision, round(recall, 7) AS recall, round(f1, 7) AS f1 FROM f
QUALIFY row_number() OVER ({'PARTITION BY ' + keys.rstrip(', ') if keys else ''} ORDER BY f1 DESC, threshold) = 1"""


@query("m19_best_threshold", LABELS_SQL + TRUTH_SQL + """,
adjusted AS (
  SELECT series, truth, CASE WHEN truth = 1 THEN max(score) OVER (PARTITION BY series, island) ELSE score END AS adjusted FROM runs),"""
       + best_sql("adjusted", "series, "))
def m19_best(spark, sf):
    rows = s.range_adjusted(judged(spark, sf), "score")
    out = s.best_threshold(rows, ["series"])
    return out.withColumns({c: F.round(c, 7) for c in ("precision", "recall", "f1")})


@query("m19_best_threshold_per_window", LABELS_SQL + TRUTH_SQL + """,
placed2 AS (
  SELECT runs.*, k FROM runs, LATERAL (SELECT unnest(range(greatest(CAST(floor((t - 288) / 144.0) AS BIGINT) + 1, 0), t // 144 + 1)) AS k)),
adjusted AS (
  SELECT series, k, truth, CASE WHEN truth = 1 THEN max(score) OVER (PARTITION BY series, k, island) ELSE score END AS adjusted FROM placed2),"""
       + best_sql("adjusted", "series, k, "))
def m19_windows(spark, sf):
    out = s.best_threshold_per_window(judged(spark, sf), 288, 144)
    return out.withColumns({c: F.round(c, 7) for c in ("precision", "recall", "f1")})


def residuals(spark, sf):
    return errors(spark, sf).groupBy("series", "t").agg(F.sum("error").alias("residual"))


@query("t6_top_residuals", "WITH " + ERRORS_SQL + """,
res AS (SELECT series, t, round(sum(error), 9) AS residual FROM errors GROUP BY ALL)
SELECT series, t, t // 60 AS k, CAST(row_number() OVER (PARTITION BY series, t // 60 ORDER BY residual DESC, t) AS INTEGER) AS rank
FROM res QUALIFY rank <= greatest(ceil(count(*) OVER (PARTITION BY series, t // 60) * 0.2::DOUBLE), 1)""")
def t6(spark, sf):
    of = residuals(spark, sf).withColumn("residual", F.round("residual", 9))
    return s.top_residuals(of).select("series", "t", "k", "rank")


@query("t7_top_share", "WITH " + ERRORS_SQL + """,
res AS (SELECT series, t, round(sum(error), 9) AS score FROM errors GROUP BY ALL)
SELECT series, t, row_number() OVER (ORDER BY score DESC, series, t) AS rank FROM res
QUALIFY rank <= (SELECT CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) FROM res)""")
def t7(spark, sf):
    of = residuals(spark, sf).select("series", "t", F.round("residual", 9).alias("score"))
    return s.top_share(of, 0.05).select("series", "t", "rank")


# Every 16th point and every slot with a peak over 200 is known; the rest is filled in.
FILL_SQL = "WITH " + KPI_SQL + """,
marked AS (SELECT *, CASE WHEN t % 16 = 0 OR (metric = 'peak' AND value > 200) THEN value END AS known FROM kpi),
beside AS (
  SELECT *, last_value(CASE WHEN known IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(known IGNORE NULLS) OVER b AS v0,
         first_value(CASE WHEN known IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(known IGNORE NULLS) OVER a AS v1
  FROM marked WINDOW b AS (PARTITION BY series, metric ORDER BY t ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY series, metric ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def sparse(spark, sf):
    known = (F.col("t") % 16 == 0) | ((F.col("metric") == "peak") & (F.col("value") > 200))
    return kpi(spark, sf).withColumn("known", F.when(known, F.col("value")))


@query("m25_linear_fill", FILL_SQL + """
SELECT series, t, metric, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0
  ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END + 1e-9, 6) AS filled FROM beside""")
def m25(spark, sf):
    out = s.interpolated(sparse(spark, sf), ["series", "metric"], F.col("known").isNotNull(), F.col("known"), "filled")
    return out.select("series", "t", "metric", F.round(F.col("filled") + 1e-9, 6).alias("filled"))


@query("m25_nearest_fill", FILL_SQL + """
SELECT series, t, metric, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t - t0 <= t1 - t THEN v0 ELSE v1 END AS filled FROM beside""")
def m25_nearest(spark, sf):
    out = s.interpolated(sparse(spark, sf), ["series", "metric"], F.col("known").isNotNull(), F.col("known"), "filled", "nearest")
    return out.select("series", "t", "metric", "filled")


@query("m24_rebuilt_series", FILL_SQL + """
SELECT series, t, metric, round(CASE WHEN value > 300 THEN value WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0
  ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END + 1e-9, 6) AS rebuilt FROM beside""")
def m24(spark, sf):
    rows = sparse(spark, sf).withColumns({
        "key_value": F.col("known"), "anomaly_value": F.when(F.col("value") > 300, F.col("value"))})
    return s.rebuilt(rows).select("series", "t", "metric", F.round(F.col("rebuilt") + 1e-9, 6).alias("rebuilt"))


@query("m16_without_extremes", "WITH " + KPI_SQL + """,
marked AS (
  SELECT *, CASE WHEN abs(value) < max(abs(value)) OVER (PARTITION BY series, metric) * (1 - 0.6::DOUBLE) THEN value END AS known FROM kpi),
beside AS (
  SELECT *, last_value(CASE WHEN known IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(known IGNORE NULLS) OVER b AS v0,
         first_value(CASE WHEN known IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(known IGNORE NULLS) OVER a AS v1
  FROM marked WINDOW b AS (PARTITION BY series, metric ORDER BY t ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY series, metric ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, t, metric, round(coalesce(known, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, value) + 1e-9, 6) AS smoothed FROM beside""")
def m16(spark, sf):
    return s.without_extremes(kpi(spark, sf), 0.6).select(
        "series", "t", "metric", F.round(F.col("smoothed") + 1e-9, 6).alias("smoothed"))


@query("m22_curvature", "WITH " + KPI_SQL + """
SELECT series, t, metric, round(coalesce(abs(lead(value) OVER w - 2 * value + lag(value) OVER w), 0), 6) AS curvature
FROM kpi WINDOW w AS (PARTITION BY series, metric ORDER BY t)""")
def m22_curvature(spark, sf):
    return s.curvature(kpi(spark, sf)).select("series", "t", "metric", F.round("curvature", 6).alias("curvature"))


def vector_pairs(spark, sf):
    """Each even vector beside the odd one after it."""
    wide = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    odd = wide.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return wide.filter(F.col("vec_id") % 2 == 0).join(odd, "vec_id")


PAIR_SQL = """WITH wide AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
pairs AS (SELECT p.vec_id, p.x AS a, q.x AS b FROM wide p JOIN wide q ON q.vec_id = p.vec_id + 1 WHERE p.vec_id % 2 = 0)"""


@query("m2_similarity", PAIR_SQL + "\nSELECT vec_id, round(1 / (1 + list_distance(a, b)), 7) AS similarity FROM pairs")
def m2(spark, sf):
    return vector_pairs(spark, sf).select("vec_id", F.round(s.similarity("a", "b"), 7).alias("similarity"))


@query("f14_row_residuals", PAIR_SQL + """,
apart AS (SELECT *, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS d FROM pairs)
SELECT vec_id, round(list_sum(d), 6) AS mean, round(list_distance(a, b), 6) AS euclidean, round(list_sum(d), 6) AS manhattan,
       round(list_max(d), 6) AS chebyshev, round(list_cosine_similarity(a, b), 6) AS cosine FROM apart""")
def f14(spark, sf):
    methods = ["Mean", "Euclidean", "Manhattan", "Chebyshev", "Cosine"]
    return vector_pairs(spark, sf).select(
        "vec_id", *[F.round(s.residual("a", "b", m), 6).alias(m.lower()) for m in methods])
