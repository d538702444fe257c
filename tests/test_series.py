"""Series operators against numpy, published values and other splittings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import signal, tails
from tallyforge.operators import rebuild, series


def points(spark, n=300, d=2, seed=0, names=("a", "b")):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    wave = np.column_stack([np.sin(2 * np.pi * t / 24 + j) for j in range(d)])
    data = [(s, int(i), [float(v) for v in wave[i] + rng.normal(0, 0.05, d)]) for s in names for i in t]
    return spark.createDataFrame(data, "series string, t long, x array<double>").repartition(3)


def test_cross_correlation_and_shape_distance_known_values():
    np.testing.assert_allclose(signal.cross_correlation(np.array([1., 2, 3, 4]), np.array([1., 2, 3, 4])),
                               [.13333333, .36666667, .66666667, 1, .66666667, .36666667, .13333333], atol=1e-7)
    np.testing.assert_allclose(signal.cross_correlation(np.array([1., 2, 3]), np.array([-1., -1, -1])),
                               [-.15430335, -.46291005, -.9258201, -.77151675, -.46291005], atol=1e-7)
    assert abs(signal.shape_distance(np.ones(3), np.ones(3))[0]) < 1e-12
    distance, moved = signal.shape_distance(np.array([0., 1, 2]), np.array([1., 2, 3]))
    assert distance == pytest.approx(0.043817112532485103) and list(moved) == [1, 2, 3]


def test_shape_clusters_known_values():
    rows = np.array([[1., 2, 3, 4], [0, 1, 2, 3], [-1, 1, -1, 1], [1, 2, 2, 3]])
    group, centres = signal.shape_clusters(rows, 2, np.random.default_rng(0), start=np.array([0, 1, 1, 0]))
    assert list(group) == [0, 0, 1, 0]
    np.testing.assert_allclose(centres[0], [-1.2244258, -.35015476, .52411628, 1.05046429], atol=1e-7)
    np.testing.assert_allclose(centres[1], [-.8660254, .8660254, -.8660254, .8660254], atol=1e-7)


def test_distance_groups():
    d = np.array([[0, .001, .9], [.001, 0, .8], [.9, .8, 0]])
    assert list(signal.grouped_by_distance(d, 0.01)) == [0, 0, 1]
    assert len(set(signal.grouped_by_distance(d, 0.0001))) == 3


def test_outlier_score_approaches_its_expectation():
    rng = np.random.default_rng(1)
    window = rng.normal(size=(20, 2))
    similar = np.sort(1 / (1 + np.sqrt(((window[:, None] - window[None]) ** 2).sum(-1))), axis=1)[:, ::-1]
    n, size = 20, 5
    from math import comb

    weight = np.array([comb(n - 1 - i, size - 1) / comb(n, size) if n - 1 - i >= size - 1 else 0 for i in range(n)])
    got = signal.outlier_scores(window, window, 20_000, size, rng)
    np.testing.assert_allclose(got, 1 / (similar @ weight), rtol=0.01)


def test_sparse_window_is_rebuilt_from_samples():
    n = 60
    t = np.arange(n)
    wave = np.cos(np.pi * (t + .5) * 3 / n) + .5 * np.cos(np.pi * (t + .5) * 7 / n)
    at = np.random.default_rng(1).choice(n, 24, replace=False)
    two = np.column_stack([wave, wave])
    assert abs(signal.sparse_rebuild(n, at, wave[at][:, None])[:, 0] - wave).max() < 1e-4
    assert abs(signal.sparse_rebuild(n, at, two[at]) - two).max() < 1e-3


def test_cubic_spline_and_periods():
    x, xp = np.arange(0, 11.), np.array([0, 2, 3, 7, 10.])
    np.testing.assert_allclose(signal.cubic_through(x, xp, xp ** 3), x ** 3, atol=1e-9)
    assert signal.dominant_period(np.sin(2 * np.pi * np.arange(240) / 24)) == 24
    assert signal.dominant_period(np.sin(2 * np.pi * np.arange(240) / 5)) is None


def test_tail_fit_and_threshold():
    rng = np.random.default_rng(0)
    shape, scale = tails.fit_tail(rng.pareto(4, 4000))
    assert shape == pytest.approx(0.25, abs=0.06) and scale == pytest.approx(0.25, abs=0.03)
    values = np.concatenate([rng.normal(size=4000), [9.0]])
    spot = tails.Spot(values[:1200], 1e-4, 0.98)
    steps = [spot.step(v) for v in values]
    assert steps[-1][2] and sum(s[2] for s in steps) < 10
    both = tails.Spot(values[:1200], 1e-4, 0.98, both=True)
    upper, lower, _ = both.step(0.0)
    assert lower < -2 < 2 < upper
    drift = tails.Spot(np.arange(1200) / 100 + rng.normal(size=1200), 1e-4, 0.98, depth=50)
    assert drift.step(12.0)[0] > 12


def test_chunks_do_not_change_scores(spark, rows):
    df = points(spark)
    a = rows(rebuild.window_outliers(df, 30, 10, 20, 10, 5, chunk_windows=2))
    b = rows(rebuild.window_outliers(df, 30, 10, 20, 10, 5, chunk_windows=50))
    assert [x[:2] for x in a] == [x[:2] for x in b] and len(a) == 600
    np.testing.assert_allclose([x[2] for x in a], [x[2] for x in b])


def test_rebuilt_windows_cover_every_point(spark):
    df = points(spark)
    # A narrow draw keeps samples near their points; the wide default averages much of a window.
    out = series.blended(rebuild.sampled_rebuild(df, cycle=120, sigma=1 / 240))
    assert out.count() == 300 * 2 * 2
    close = rebuild.errors(df, out).agg(F.avg("error")).first()[0]
    assert close < 0.35
    modes = series.blended(rebuild.mode_rebuild(df, rebuild.metric_periods(df, 120), 120, 30, 24, 120))
    assert modes.count() == 300 * 2 * 2


def test_detection_marks_a_spike(spark):
    df = points(spark, names=("a",)).withColumn("x", F.when(F.col("t").between(200, 205), F.transform("x", lambda v: v + 8)).otherwise(F.col("x")))
    out = rebuild.detect_by_sampling(df, cycle=120, threshold_window=300, threshold_stride=10)
    hit = [r.t for r in out.filter("label = 1").collect()]
    assert out.count() == 300 and hit and all(185 <= t <= 220 for t in hit)


def test_series_windows_split_the_same(spark, rows):
    m = rebuild.as_metrics(points(spark)).withColumn("metric", F.col("metric").cast("string"))
    for function in (lambda d, r: series.smoothed(d, 18, r), lambda d, r: series.trailing_mean(d, 12, r), lambda d, r: series.box_smoothed(d, 7, r)):
        a, b = rows(function(m, None)), rows(function(m, 25))
        assert [x[:3] for x in a] == [x[:3] for x in b]
        np.testing.assert_allclose([x[-1] for x in a], [x[-1] for x in b])


def test_box_smoothing_is_a_same_size_convolution(spark):
    m = spark.createDataFrame([("s", i, "m", float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "series string, t long, metric string, value double")
    for n in (3, 4):
        got = [r.box for r in series.box_smoothed(m, n).orderBy("t").collect()]
        np.testing.assert_allclose(got, np.convolve([3, 1, 4, 1, 5, 9, 2, 6], np.ones(n) / n, mode="same"))


def test_interpolation_against_numpy(spark):
    known = {3: 1.0, 7: 5.0, 12: -2.0}
    df = spark.createDataFrame([("s", t, known.get(t)) for t in range(20)], "series string, t long, v double")
    for limit in (None, 4):
        got = [r.f for r in series.interpolated(df, ["series"], F.col("v").isNotNull(), F.col("v"), "f", max_rows=limit).orderBy("t").collect()]
        np.testing.assert_allclose(got, np.interp(range(20), list(known), list(known.values())))


def test_constant_metric_scales_to_a_half(spark):
    m = spark.createDataFrame([("s", i, "m", 7.0) for i in range(4)], "series string, t long, metric string, value double")
    assert {r.value for r in series.scaled(m).collect()} == {0.5}


def test_top_share_ranks_across_tasks(spark, rows):
    df = spark.createDataFrame([("s", i, float((i * 37) % 101)) for i in range(101)], "series string, t long, score double")
    assert rows(series.top_share(df, 0.2), "t") == rows(series.top_share(df, 0.2, max_rows=9), "t")
    assert series.top_share(df, 0.2).count() == 20


def test_threshold_is_one_run_whatever_the_length(spark):
    from tallyforge.functions import tails

    rng = np.random.default_rng(3)
    values = {"s": rng.normal(size=30_000), "t": rng.normal(size=70), "u": rng.normal(size=500)}
    df = spark.createDataFrame([(n, i, float(v)) for n, x in values.items() for i, v in enumerate(x)], "series string, t long, score double")
    out = rebuild.adaptive_threshold(df, 1e-2, 0.98, 100).toPandas().sort_values("t")
    for name, x in values.items():
        spot = tails.Spot(x[:100], 1e-2, 0.98)
        want = [spot.step(v) for v in x]
        got = out[out.series == name]
        assert got.score.tolist() == x.tolist()
        assert got.label.tolist() == [int(w[2]) for w in want]
        assert np.allclose(got.threshold, [w[0] for w in want])
