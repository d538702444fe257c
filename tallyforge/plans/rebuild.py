"""Queries that sample and rebuild metric series. Their draws are seeded by series and window.

Those that draw or iterate have no SQL twin; their tests check them against plain numpy on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import rebuild as r
from tallyforge.operators import series as s
from tallyforge.plans import series as kpis
from tallyforge.plans.registry import query

CYCLE = 480  # ten days of half hours

PLACED_SQL = "WITH " + kpis.KPI_SQL + f""",
placed AS (
  SELECT series, t // {CYCLE} AS cycle, t % {CYCLE} AS place, CAST(list_position({kpis.METRICS}, metric) - 1 AS BIGINT) AS metric, value FROM scaled)"""

# The power of each positive frequency, from its cosine and sine sums.
PERIODS_SQL = PLACED_SQL + """,
sized AS (SELECT series, cycle, metric, count(*) AS n FROM placed GROUP BY ALL),
waves AS (SELECT *, unnest(range(1, (n + 1) // 2)) AS k FROM sized),
powers AS (
  SELECT series, cycle, metric, n, k, pow(sum(value * cos(2 * pi() * ((k * place) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((k * place) % n) / n)), 2) AS power
  FROM waves JOIN placed USING (series, cycle, metric) GROUP BY ALL),
strongest AS (SELECT series, cycle, metric, arg_max(k, power) AS k FROM powers GROUP BY ALL),
periods AS (
  SELECT series, cycle, metric, CASE WHEN n // k >= 12 AND n // k <= n // 2 THEN n // k END AS period FROM sized LEFT JOIN strongest USING (series, cycle, metric))"""


def raw_points(spark, sf):
    return kpis.kpi_points(spark, sf).select("series", "t", F.array(*kpis.METRICS).alias("x"))


def points(spark, sf):
    """Scaled points: the metrics as one array."""
    wide = s.scaled(kpis.kpi(spark, sf)).groupBy("series", "t").pivot("metric", kpis.METRICS).agg(F.first("value"))
    return wide.select("series", "t", F.array(*kpis.METRICS).alias("x"))


@query("m1_outlier_scores")
def m1(spark, sf):
    return r.window_outliers(points(spark, sf))


@query("m3_m4_rebuilt_windows")
def m4(spark, sf):
    return r.sampled_rebuild(points(spark, sf), cycle=CYCLE)


@query("m5_blended_windows")
def m5(spark, sf):
    return s.blended(r.sampled_rebuild(points(spark, sf), cycle=CYCLE))


@query("m11_shape_distances", PLACED_SQL + """,
norms AS (SELECT series, cycle, metric, sqrt(sum(value * value)) AS norm FROM placed GROUP BY ALL),
sums AS (
  SELECT a.series, a.cycle, a.metric AS metric_a, b.metric AS metric_b, sum(a.value * b.value) AS dot
  FROM placed a JOIN placed b ON a.series = b.series AND a.cycle = b.cycle AND a.metric < b.metric
  GROUP BY a.series, a.cycle, a.metric, b.metric, a.place - b.place)
SELECT series, cycle, metric_a, metric_b, round(1 - CASE WHEN a.norm * b.norm > 0 THEN max(dot) / (a.norm * b.norm) ELSE 0 END, 7) AS distance
FROM sums JOIN norms a USING (series, cycle) JOIN norms b USING (series, cycle)
WHERE a.metric = metric_a AND b.metric = metric_b GROUP BY series, cycle, metric_a, metric_b, a.norm, b.norm""")
def m11(spark, sf):
    return r.shape_distances(points(spark, sf), CYCLE).withColumn("distance", F.round("distance", 7))


@query("m12_metric_groups")
def m12(spark, sf):
    return r.metric_groups(points(spark, sf), CYCLE, 0.2)


@query("m13_shape_clusters")
def m13(spark, sf):
    return r.shape_clusters(points(spark, sf), 2, CYCLE)


@query("m14_metric_periods", PERIODS_SQL + "\nSELECT series, cycle, metric, period FROM periods")
def m14(spark, sf):
    return r.metric_periods(points(spark, sf), CYCLE)


@query("m26_chosen_path", PERIODS_SQL + """,
sizes AS (SELECT series, cycle, period, count(*) AS n FROM periods WHERE period IS NOT NULL GROUP BY ALL),
found AS (SELECT series, max(n) AS most, count(*) FILTER (n >= 2) AS strong FROM sizes GROUP BY series)
SELECT series, CASE WHEN most >= 3 OR strong >= 2 THEN 'modes' ELSE 'sampling' END AS path
FROM (SELECT DISTINCT series FROM periods) LEFT JOIN found USING (series)""")
def m26(spark, sf):
    return r.chosen_path(r.metric_periods(points(spark, sf), CYCLE), 3, 2, 2)


@query("m15_mode_rebuild")
def m15(spark, sf):
    return s.blended(r.mode_rebuild(points(spark, sf), r.metric_periods(points(spark, sf), CYCLE), CYCLE, 60, 48, CYCLE))


@query("m17_detect_by_sampling")
def m17(spark, sf):
    return r.detect_by_sampling(raw_points(spark, sf), cycle=CYCLE, threshold_window=288, threshold_stride=12)


@query("m17_detect_by_modes")
def m17_modes(spark, sf):
    return r.detect_by_modes(raw_points(spark, sf), CYCLE, 60, 48, calibration=400)


@query("m9_adaptive_threshold")
def m9(spark, sf):
    return r.adaptive_threshold(kpis.point_scores(spark, sf), risk=1e-3, calibration=400).drop("lower")


@query("m9_two_sided_threshold")
def m9_both(spark, sf):
    return r.adaptive_threshold(kpis.point_scores(spark, sf), risk=1e-3, calibration=400, both=True)


@query("m9_drift_threshold")
def m9_drift(spark, sf):
    return r.adaptive_threshold(kpis.point_scores(spark, sf), risk=1e-3, calibration=400, depth=48).drop("lower")


@query("m10_adaptive_labels")
def m10(spark, sf):
    return r.adaptive_threshold(kpis.point_scores(spark, sf), risk=1e-3, calibration=400, depth=24).select("series", "t", "label")


@query("m22_compressed_points")
def m22(spark, sf):
    scaled = points(spark, sf)
    return r.compressed(scaled, s.blended(r.sampled_rebuild(scaled, cycle=CYCLE)))


@query("m23_background")
def m23_background(spark, sf):
    return r.background(points(spark, sf))


@query("m25_cubic_background")
def m25_cubic(spark, sf):
    return r.background(points(spark, sf), share=0.1, method="cubic")


@query("m23_compressed_by_background")
def m23(spark, sf):
    return r.compressed_by_background(points(spark, sf))


@query("m23_compression_quality")
def m23_quality(spark, sf):
    return r.compression_quality(r.compressed_by_background(points(spark, sf)))
