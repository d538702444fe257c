"""Sample, rebuild and score windows of metric series; thresholds on the scores.

Points have series, t (0, 1, 2, ...), x (array of metrics). Work is cut by position into
chunks with the rows beside them that their windows need, so a task holds a bounded part
of one series however long the series is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import signal, tails
from tallyforge.operators import series as s
from tallyforge.ordered import numbered

WINDOW, STRIDE, HISTORY = 60, 10, 96
WINDOWS_PER_CYCLE = 24
DRAWS, DRAW_SIZE = 40, 20
SAMPLE_RATE, SCALE, RHO, SIGMA = 0.4, 5, 0.1, 0.5
GROUP_THRESHOLD = 0.01
DMD_WINDOW, DMD_STRIDE, DMD_LAG, DMD_SMOOTHING = 3600, 14, 288, 18
CALIBRATION = 1200


def _rng(*parts) -> np.random.Generator:
    """The same draws for the same series and window wherever the task runs."""
    return np.random.default_rng(zlib.crc32("|".join(map(str, parts)).encode()))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups over all shuffle partitions: they are small in bytes but heavy to compute, so
    they must not be coalesced by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def chunked(points: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Rows with ``chunk`` (a copy for each chunk that needs the row) and series length ``n``."""
    length = points.groupBy("series").agg((F.max("t") + 1).alias("n"))
    low = F.greatest(F.floor((F.col("t") - after) / size), F.lit(0))
    high = F.least(F.floor((F.col("t") + before) / size), F.floor((F.col("n") - 1) / size))
    return points.join(length, "series").withColumn("chunk", F.explode(F.sequence(low, high)))


def _windows(n: int, window: int, stride: int, first: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(k, start, stop) of the windows that start in [first, end); the last one reaches n."""
    k = -(-first // stride)
    while k * stride < end:
        start = k * stride
        if k and start - stride + window >= n:
            return
        yield k, start, min(n, start + window)
        k += 1


def _per_chunk(points: DataFrame, size: int, before: int, after: int, schema: str, one: Callable) -> DataFrame:
    """``one(rows of t, matrix, n, chunk start, chunk end, first row)`` gives the output frame of a chunk."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        chunk, n, name = int(pdf["chunk"].iloc[0]), int(pdf["n"].iloc[0]), pdf["series"].iloc[0]
        out = one(pdf, np.vstack(pdf["x"].to_numpy()).astype(float), name, n, chunk * size, min(n, (chunk + 1) * size))
        out.insert(0, "series", name)
        return out

    return _spread(chunked(points, size, before, after), "series", "chunk").groupBy("series", "chunk").applyInPandas(run, f"series string, {schema}")


# --- outlier score -------------------------------------------------------------------

def window_outliers(points: DataFrame, window: int = WINDOW, stride: int = WINDOW, history: int = HISTORY,
                    draws: int = DRAWS, size: int = DRAW_SIZE, chunk_windows: int = 12) -> DataFrame:
    """Outlier score of every point against its window and the points before it.

    A point in several windows gets the mean of its scores.
    """
    step = stride * chunk_windows

    def one(pdf, x, name, n, begin, end):
        t0 = int(pdf["t"].iloc[0])
        total, count = np.zeros(len(x)), np.zeros(len(x))
        for k, start, stop in _windows(n, window, stride, begin, end):
            pool = x[max(0, start - history - t0):stop - t0]
            total[start - t0:stop - t0] += signal.outlier_scores(x[start - t0:stop - t0], pool, draws, size, _rng(name, k))
            count[start - t0:stop - t0] += 1
        has = count > 0
        return pd.DataFrame({"t": pdf["t"].to_numpy()[has], "total": total[has], "n": count[has]})

    parts = _per_chunk(points, step, history, window, "t long, total double, n double", one)
    return parts.groupBy("series", "t").agg((F.sum("total") / F.sum("n")).alias("score"))


# --- shapes and periods --------------------------------------------------------------

def _by_cycle(points: DataFrame, cycle: int, schema: str, one: Callable) -> DataFrame:
    """``one(matrix, series, cycle)`` on each cycle of each series, at most ``cycle`` rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        name, number = pdf["series"].iloc[0], int(pdf["cycle"].iloc[0])
        out = one(np.vstack(pdf["x"].to_numpy()).astype(float), name, number)
        out.insert(0, "cycle", number)
        out.insert(0, "series", name)
        return out

    placed = points.withColumn("cycle", F.floor(F.col("t") / cycle))
    return _spread(placed, "series", "cycle").groupBy("series", "cycle").applyInPandas(run, f"series string, cycle long, {schema}")


def _distances(x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    return np.array([[signal.shape_distance(x[:, i], x[:, j])[0] for j in range(d)] for i in range(d)])


def shape_distances(points: DataFrame, cycle: int = WINDOW * WINDOWS_PER_CYCLE) -> DataFrame:
    """Shape distance of each two metrics in each cycle (M11). A pair of metrics is one row."""
    def one(x, name, number):
        d = _distances(x)
        a, b = np.triu_indices(len(d), 1)
        return pd.DataFrame({"metric_a": a, "metric_b": b, "distance": d[a, b]})

    return _by_cycle(points, cycle, "metric_a long, metric_b long, distance double", one)


def metric_groups(points: DataFrame, cycle: int = WINDOW * WINDOWS_PER_CYCLE, threshold: float = GROUP_THRESHOLD) -> DataFrame:
    """Group of each metric per cycle (M12). In the first cycle each metric is its own group."""
    def one(x, name, number):
        d = x.shape[1]
        group = np.arange(d) if number == 0 or d < 2 else signal.grouped_by_distance(_distances(x), threshold)
        return pd.DataFrame({"metric": np.arange(d), "grp": group})

    return _by_cycle(points, cycle, "metric long, grp long", one)


def shape_clusters(points: DataFrame, clusters: int, cycle: int = WINDOW * WINDOWS_PER_CYCLE) -> DataFrame:
    """Metrics of each cycle clustered by shape."""
    def one(x, name, number):
        group, _ = signal.shape_clusters(x.T, clusters, _rng(name, number))
        return pd.DataFrame({"metric": np.arange(x.shape[1]), "cluster": group})

    return _by_cycle(points, cycle, "metric long, cluster long", one)


def metric_periods(points: DataFrame, cycle: int) -> DataFrame:
    """Dominant period of each metric per cycle, null where there is none."""
    def one(x, name, number):
        found = [signal.dominant_period(column) for column in x.T]
        return pd.DataFrame({"metric": np.arange(x.shape[1]), "period": pd.array(found, dtype="Int64")})

    return _by_cycle(points, cycle, "metric long, period long", one)


def chosen_path(periods: DataFrame, big: int = 15, strong: int = 4, groups: int = 3) -> DataFrame:
    """``modes`` where periods tie many metrics together, else ``sampling``."""
    sizes = periods.filter(F.col("period").isNotNull()).groupBy("series", "cycle", "period").agg(F.count(F.lit(1)).alias("_n"))
    per = sizes.groupBy("series").agg(F.max("_n").alias("_most"), F.count_if(F.col("_n") >= strong).alias("_strong"))
    modes = (F.col("_most") >= big) | (F.col("_strong") >= groups)
    return periods.select("series").distinct().join(per, "series", "left").select(
        "series", F.when(modes, "modes").otherwise("sampling").alias("path"))


# --- reconstruction ------------------------------------------------------------------

PARTS = "t long, metric long, rec_sum double, rec_n long"


def _parts_frame(t: np.ndarray, total: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    has = count > 0
    d = total.shape[1]
    return pd.DataFrame({
        "t": np.repeat(t[has], d), "metric": np.tile(np.arange(d), has.sum()),
        "rec_sum": total[has].ravel(), "rec_n": np.repeat(count[has], d)})


def _with_groups(points: DataFrame, groups: DataFrame, size: int, cycle: int, before: int) -> DataFrame:
    """Points with the metric groups of the cycle their chunk starts in, as ``grps``."""
    listed = groups.groupBy("series", "cycle").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("metric", "grp"))), lambda g: g["grp"]).alias("grps"))
    return points.join(listed, (points.series == listed.series) & (F.floor(F.col("t") / cycle) == listed.cycle)).select(
        points.series, "t", "x", "grps")


def sampled_rebuild(points: DataFrame, groups: DataFrame | None = None, window: int = WINDOW, stride: int = STRIDE,
                    history: int = HISTORY, rate: float = SAMPLE_RATE, scale: int = SCALE, rho: float | None = RHO,
                    sigma: float = SIGMA, draws: int = DRAWS, size: int = DRAW_SIZE,
                    cycle: int = WINDOW * WINDOWS_PER_CYCLE) -> DataFrame:
    """Windows rebuilt from calm samples (M3, M4) as sums and counts per value.

    Without ``groups`` each metric is rebuilt on its own; with them the metrics of a group
    are rebuilt together, as grouped in the cycle the window starts in.
    """
    chunk = cycle // 2
    source = points if groups is None else _with_groups(points, groups, chunk, cycle, history)

    def one(pdf, x, name, n, begin, end):
        t0, d = int(pdf["t"].iloc[0]), x.shape[1]
        grps = np.arange(d)
        if "grps" in pdf.columns:
            grps = np.asarray(pdf.loc[pdf["t"] == begin, "grps"].iloc[0])
        total, count = np.zeros_like(x), np.zeros(len(x), dtype=int)
        for k, start, stop in _windows(n, window, stride, begin, end):
            rng, here = _rng(name, k), slice(start - t0, stop - t0)
            data, pool = x[here], x[max(0, start - history - t0):stop - t0]
            weights = signal.confidence(signal.outlier_scores(data, pool, draws, size, rng))
            units = max(1, round(rate * len(data)))
            matrix, centres = signal.sample_units(weights, units, rng, scale, rho, sigma)
            values = matrix @ data
            for group in np.unique(grps):
                members = np.flatnonzero(grps == group)
                total[here, members] += signal.sparse_rebuild(len(data), centres, values[:, members])
            count[here] += 1
        return _parts_frame(pdf["t"].to_numpy(), total, count)

    return _per_chunk(source, chunk, history, window, PARTS, one)


def mode_rebuild(points: DataFrame, periods: DataFrame, window: int = DMD_WINDOW, stride: int = DMD_STRIDE,
                 lag: int = DMD_LAG, cycle: int = DMD_WINDOW) -> DataFrame:
    """Windows rebuilt by dynamic modes within the groups of equal period."""
    groups = periods.select("series", "cycle", "metric", F.coalesce("period", F.lit(0)).alias("grp"))
    source = _with_groups(points, groups, cycle, cycle, 0)

    def one(pdf, x, name, n, begin, end):
        t0 = int(pdf["t"].iloc[0])
        grps = np.asarray(pdf.loc[pdf["t"] == begin, "grps"].iloc[0])
        total, count = np.zeros_like(x), np.zeros(len(x), dtype=int)
        for k, start, stop in _windows(n, window, stride, begin, end):
            here = slice(start - t0, stop - t0)
            data = x[here]
            if len(data) <= lag + 1:
                total[here] += data
            else:
                for group in np.unique(grps):
                    members = np.flatnonzero(grps == group)
                    total[here, members] += signal.mode_rebuild(data[:, members].T, lag).T
            count[here] += 1
        return _parts_frame(pdf["t"].to_numpy(), total, count)

    return _per_chunk(source, cycle, 0, window, PARTS, one)


def as_metrics(points: DataFrame) -> DataFrame:
    """One row per value: series, t, metric (its position), value."""
    return points.select("series", "t", F.posexplode("x").alias("metric", "value")).withColumn("metric", F.col("metric").cast("long"))


def as_points(metrics: DataFrame) -> DataFrame:
    """Back to one row per point; a point has as many entries as there are metrics."""
    return metrics.groupBy("series", "t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("metric", "value"))), lambda p: p["value"]).alias("x"))


def errors(points: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Absolute error of each rebuilt value."""
    return as_metrics(points).join(rebuilt, ["series", "t", "metric"]).select(
        "series", "t", "metric", F.abs(F.col("value") - F.col("rec")).alias("error"))


def detect_by_sampling(raw: DataFrame, window: int = WINDOW, stride: int = STRIDE, cycle: int = WINDOW * WINDOWS_PER_CYCLE,
                       threshold_window: int = s.THRESHOLD_WINDOW, threshold_stride: int = s.THRESHOLD_STRIDE) -> DataFrame:
    """Labels of raw points by sampling and rebuilding (M17): W15, M12, M1, M3-M8."""
    points = as_points(s.scaled(as_metrics(raw)))
    groups = metric_groups(points, cycle)
    rebuilt = s.blended(sampled_rebuild(points, groups, window, stride, cycle=cycle))
    lengths = raw.groupBy("series").agg((F.max("t") + 1).alias("n"))
    scores = s.point_scores(s.window_scores(errors(points, rebuilt)), lengths)
    return s.sliding_threshold(scores, threshold_window, threshold_stride)


def detect_by_modes(raw: DataFrame, window: int = DMD_WINDOW, stride: int = DMD_STRIDE, lag: int = DMD_LAG,
                    calibration: int = CALIBRATION, level: float = 0.98) -> DataFrame:
    """Labels of raw points by dynamic modes (M17): W12, W15, M14, M15, M6, M7, M10."""
    calm = s.smoothed(as_metrics(raw), DMD_SMOOTHING).withColumn("value", F.col("smoothed")).drop("smoothed")
    points = as_points(s.scaled(calm))
    rebuilt = s.blended(mode_rebuild(points, metric_periods(points, window), window, stride, lag, window))
    lengths = raw.groupBy("series").agg((F.max("t") + 1).alias("n"))
    scores = s.point_scores(s.window_scores(errors(points, rebuilt), 14, 2), lengths, 14, 2)
    return adaptive_threshold(scores, risk=1e-3, level=level, calibration=calibration)


# --- compression ---------------------------------------------------------------------

def compressed(points: DataFrame, rebuilt: DataFrame, window: int = WINDOW, anomaly_share: float = 0.2,
               key_share: float = 0.05, apart: int = 5) -> DataFrame:
    """Points kept of each window: the worst rebuilt ones, and the bends of the rebuilt line.

    Gives series, t, kind, x; an anomaly keeps its own values, a key point the rebuilt ones.
    """
    lines = rebuilt.groupBy("series", "t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("metric", "rec"))), lambda p: p["rec"]).alias("rec"))
    both = points.join(lines, ["series", "t"])
    far = both.withColumn("residual", s.l2("x", "rec"))
    anomalies = s.top_residuals(far, window, anomaly_share).select("series", "t", F.lit("anomaly").alias("kind"), "x")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        line = np.vstack(pdf["rec"].to_numpy())
        at = signal.key_points(line, max(2, int(np.ceil(key_share * len(line)))), apart) if len(line) > 1 else []
        return pd.DataFrame({"series": pdf["series"].iloc[0], "t": pdf["t"].to_numpy()[at], "kind": "key", "x": [line[i] for i in at]})

    keys = both.withColumn("k", F.floor(F.col("t") / window)).groupBy("series", "k").applyInPandas(
        one, "series string, t long, kind string, x array<double>")
    return anomalies.unionByName(keys)


def background(points: DataFrame, window: int = WINDOW, history: int = 20, share: float = 0.05,
               draws: int = 50, size: int = 20, method: str = "linear") -> DataFrame:
    """Line through a few sampled points of each window, with ``sampled`` at those points."""
    def one(pdf, x, name, n, begin, end):
        t0, frames = int(pdf["t"].iloc[0]), []
        for k, start, stop in _windows(n, window, window, begin, end):
            rng, data = _rng(name, k), x[start - t0:stop - t0]
            pool = x[max(0, start - history - t0):stop - t0]
            weights = signal.confidence(signal.outlier_scores(data, pool, draws, size, rng))
            _, centres = signal.sample_units(weights, max(1, int(len(data) * share)), rng)
            at, where = np.sort(centres), np.arange(len(data))
            through = signal.cubic_through if method == "cubic" else np.interp
            line = np.column_stack([through(where, at, column[at]) for column in data.T])
            frames.append(pd.DataFrame({"t": start + where, "line": list(line), "sampled": np.isin(where, at)}))
        return pd.concat(frames) if frames else pd.DataFrame({"t": [], "line": [], "sampled": []})

    return _per_chunk(points, window * 12, history, window, "t long, line array<double>, sampled boolean", one)


def compressed_by_background(points: DataFrame, anomaly_share: float = 0.2, share: float = 0.05,
                             max_rows: int | None = None) -> DataFrame:
    """Points with ``sampled`` and ``anomaly`` (M23): the points most out of line after the
    background is taken off, scored in half-overlapping windows, int(n * share) per series."""
    lines = background(points, share=share)
    rows = points.join(lines, ["series", "t"])
    rest = rows.select("series", "t", F.zip_with("x", "line", lambda a, b: a - b).alias("x"))
    scores = window_outliers(rest, WINDOW, WINDOW // 2, 0, 50, 20)
    lengths = points.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(scores, ["series"], [F.desc("score"), F.col("t")], "_rank", max_rows).join(lengths, "series")
    return rows.join(ranked, ["series", "t"]).select(
        "series", "t", "x", "sampled", (F.col("_rank") <= F.floor(F.col("_n") * anomaly_share)).alias("anomaly"))


def compression_quality(kept: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Share of points kept and relative squared error of the series rebuilt from them."""
    values = kept.select("series", "t", "sampled", "anomaly", F.posexplode("x").alias("metric", "value"))
    rows = values.withColumns({
        "key_value": F.when(F.col("sampled"), F.col("value")), "anomaly_value": F.when(F.col("anomaly"), F.col("value"))})
    out = s.rebuilt(rows, max_rows)
    off = F.col("value") - F.col("rebuilt")
    quality = out.groupBy("series").agg((F.sum(off * off) / F.sum(F.col("value") * F.col("value"))).alias("relative_error"))
    share = kept.groupBy("series").agg(
        ((F.count_if("sampled") + F.count_if("anomaly")) / F.count(F.lit(1))).alias("kept_share"))
    return share.join(quality, "series")


# --- adaptive thresholds -------------------------------------------------------------

def adaptive_threshold(scores: DataFrame, risk: float = 1e-4, level: float = 0.98, calibration: int = CALIBRATION,
                       depth: int = 0, both: bool = False) -> DataFrame:
    """Scores with upper (and lower) threshold and label by extreme-value theory.

    ``depth`` follows drift, ``both`` watches both sides. The threshold steps from point to point, so a series of any
    length is one run: its rows come sorted and in batches, and only the state of the run and the points that
    calibrate it are held. Labels do not depend on how long the series is.
    """
    columns = "series string, t long, score double, threshold double, lower double, label int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, spot, first = None, None, []

        def stepped(rows: list[tuple]) -> pd.DataFrame:
            steps = [spot.step(score) for _, _, score in rows]
            return pd.DataFrame({
                "series": [r[0] for r in rows], "t": [r[1] for r in rows], "score": [r[2] for r in rows],
                "threshold": [x[0] for x in steps], "lower": [x[1] for x in steps],
                "label": np.array([int(x[2]) for x in steps], dtype="int32")})

        def started(rows: list[tuple]) -> tails.Spot:
            values = np.array([r[2] for r in rows], float)
            return tails.Spot(values, risk, level, min(depth, max(1, len(values) // 2)) if depth else 0, both)

        for batch in batches:
            for name, part in batch.groupby("series", sort=False, dropna=False):
                name = None if pd.isna(name) else name  # a null series goes on from batch to batch like any other
                if name != series:
                    if first:  # the series before was shorter than a calibration
                        spot = started(first)
                        yield stepped(first)
                    series, spot, first = name, None, []
                rows = list(zip(part["series"], part["t"], part["score"].astype(float), strict=True))
                if spot is None:
                    first += rows
                    if len(first) < calibration:
                        continue
                    spot, rows, first = started(first[:calibration]), first, []
                yield stepped(rows)
        if first:
            spot = started(first)
            yield stepped(first)

    ordered = _spread(scores.select("series", "t", "score"), "series").sortWithinPartitions("series", "t")
    return ordered.mapInPandas(run, columns)
