"""Metric series: smoothing, scaling, window scores, thresholds and their evaluation.

A metric table has series, t (0, 1, 2, ... without holes), metric, value. A score table
has series, t, score. Windows start at multiples of the stride; the last one is the
first that reaches the end of its series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.ordered import following, framed, islands, large, numbered, previous, running

THRESHOLD_WINDOW = 1440
THRESHOLD_STRIDE = 10
THRESHOLD_SIGMAS = 3.0
TOP_RESIDUAL_SHARE = 0.2
LABEL_WIDENING = 5


def _t() -> list[Column]:
    return [F.col("t")]


# --- windows -------------------------------------------------------------------------

def in_windows(rows: DataFrame, window: int, stride: int) -> DataFrame:
    """One row per row and window ``k`` that holds it; at most ceil(window/stride) copies."""
    length = rows.groupBy("series").agg((F.max("t") + 1).alias("_n"))
    last = F.greatest(F.ceil((F.col("_n") - window) / stride), F.lit(0))
    first_k = F.greatest(F.floor((F.col("t") - window) / stride) + 1, F.lit(0))
    last_k = F.least(F.floor(F.col("t") / stride), last)
    return (
        rows.join(length, "series")
        .withColumn("k", F.explode(F.when(first_k <= last_k, F.sequence(first_k, last_k)))).drop("_n")
    )


def mean_distance(metrics: DataFrame, window: int, stride: int) -> DataFrame:
    """Mean over a point's windows of its distance to the window mean."""
    placed = in_windows(metrics, window, stride)
    means = placed.groupBy("series", "k", "metric").agg(F.avg("value").alias("_mean"))
    distance = (
        placed.join(means, ["series", "k", "metric"])
        .groupBy("series", "t", "k").agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("_mean"), 2))).alias("_d"))
    )
    return distance.groupBy("series", "t").agg(F.avg("_d").alias("score"))


def smoothed(metrics: DataFrame, points: int = 18, max_rows: int | None = None) -> DataFrame:
    """Mean of the last ``points`` values, the first full one reaching back over the start."""
    def add(rows: DataFrame, window) -> DataFrame:
        frame = window.rowsBetween(1 - points, 0)
        mean = F.when(F.count("value").over(frame) == points, F.avg("value").over(frame))
        rows = rows.withColumn("_mean", mean)
        ahead = F.first("_mean", ignorenulls=True).over(window.rowsBetween(0, points - 1))
        return rows.withColumn("smoothed", F.coalesce("_mean", ahead)).drop("_mean")

    return framed(metrics, ["series", "metric"], _t(), add, before=points - 1, after=points - 1, max_rows=max_rows)


def trailing_mean(metrics: DataFrame, depth: int, max_rows: int | None = None) -> DataFrame:
    """Mean of the last ``depth`` values where there are so many."""
    def add(rows: DataFrame, window) -> DataFrame:
        frame = window.rowsBetween(1 - depth, 0)
        return rows.withColumns({"back_mean": F.avg("value").over(frame), "_n": F.count("value").over(frame)})

    out = framed(metrics, ["series", "metric"], _t(), add, before=depth - 1, max_rows=max_rows)
    return out.filter(F.col("_n") == depth).drop("_n")


def box_smoothed(metrics: DataFrame, points: int, max_rows: int | None = None) -> DataFrame:
    """Centred moving sum over ``points`` divided by ``points``, as if zeros lay outside."""
    ahead = points // 2
    back = points - 1 - ahead

    def add(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("box", F.sum("value").over(window.rowsBetween(-ahead, back)) / points)

    return framed(metrics, ["series", "metric"], _t(), add, before=ahead, after=back, max_rows=max_rows)


# --- scaling -------------------------------------------------------------------------

def scaled(metrics: DataFrame, keys: Sequence[str] = ("series", "metric")) -> DataFrame:
    """Values on [0, 1] per metric; a constant metric gives 0.5."""
    span = metrics.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    width = F.col("_high") - F.col("_low")
    value = F.when(width == 0, 0.5).otherwise((F.col("value") - F.col("_low")) / width)
    return metrics.join(span, list(keys)).withColumn("value", value).drop("_low", "_high")


def rescaled(metrics: DataFrame, keys: Sequence[str] = ("series", "metric")) -> DataFrame:
    """Columns linear, z_score, atan, sigmoid and tanh."""
    span = metrics.groupBy(*keys).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_sd"))
    x = F.col("value")
    width = F.col("_high") - F.col("_low")
    return metrics.join(span, list(keys)).withColumns({
        "linear": F.when(width == 0, 0.5).otherwise((x - F.col("_low")) / width),
        "z_score": F.when(F.col("_sd") > 0, (x - F.col("_mean")) / F.col("_sd")).otherwise(0.0),
        "atan": F.atan(x) * 2 / F.pi(), "sigmoid": 1.0 / (1.0 + F.exp(-x)), "tanh": F.tanh(x),
    }).drop("_low", "_high", "_mean", "_sd")


# --- scores --------------------------------------------------------------------------

def blended(parts: DataFrame) -> DataFrame:
    """Mean of all window reconstructions of a value (M5). Parts carry sums and counts."""
    return parts.groupBy("series", "t", "metric").agg((F.sum("rec_sum") / F.sum("rec_n")).alias("rec"))


def window_scores(errors: DataFrame, window: int = 12, stride: int = 2, share: float = 0.9, top: int = 2) -> DataFrame:
    """Score of each window (M6). ``errors`` has series, t, metric, error (absolute).

    Per metric the 90% point of the error over its window mean; then the harmonic mean of
    the two highest metrics, zero if one of them is zero.
    """
    placed = in_windows(errors, window, stride)
    spread = placed.groupBy("series", "k", "metric").agg(
        (F.percentile("error", share) - F.avg("error")).alias("_d"))
    # One entry per metric, so the list is as long as the metric table is wide.
    best = spread.groupBy("series", "k").agg(F.slice(F.sort_array(F.collect_list("_d"), asc=False), 1, top).alias("_best"))
    inverse = F.aggregate("_best", F.lit(0.0), lambda a, d: a + 1.0 / F.nullif(d, F.lit(0.0)))
    return best.select("series", "k", F.coalesce(F.size("_best") / inverse, F.lit(0.0)).alias("score"))


def point_scores(scores: DataFrame, lengths: DataFrame, window: int = 12, stride: int = 2) -> DataFrame:
    """Mean score of the windows a point lies in (M7). ``lengths`` has series, n."""
    start = F.col("k") * stride
    points = F.sequence(start, F.least(start + window, F.col("n")) - 1)
    return (
        scores.join(lengths, "series").select("series", F.explode(points).alias("t"), "score")
        .groupBy("series", "t").agg(F.avg("score").alias("score"))
    )


def sliding_threshold(
    scores: DataFrame, window: int = THRESHOLD_WINDOW, stride: int = THRESHOLD_STRIDE,
    sigmas: float = THRESHOLD_SIGMAS, max_rows: int | None = None,
) -> DataFrame:
    """Scores with ``threshold`` and ``label`` (M8).

    A point takes the last window that holds it, which starts at its own stride block.
    Means and deviations come from sums per block, so no row is copied per window.
    ``window`` must be a multiple of ``stride``.
    """
    blocks = window // stride
    rows = scores.withColumn("_block", F.floor(F.col("t") / stride))
    sums = rows.groupBy("series", "_block").agg(
        F.count("score").alias("_n"), F.sum("score").alias("_s"), F.sum(F.col("score") * F.col("score")).alias("_q"))

    def add(part: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(0, blocks - 1)
        n, s, q = (F.sum(c).over(frame) for c in ("_n", "_s", "_q"))
        mean = s / n
        limit = mean + sigmas * F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0)))
        clipped = F.when(limit >= 1, 0.999).when(limit <= 0, 0.001).otherwise(limit)
        return part.withColumn("threshold", clipped)

    limits = framed(sums, ["series"], [F.col("_block")], add, before=0, after=blocks - 1, max_rows=max_rows)
    joined = rows.join(limits.select("series", "_block", "threshold"), ["series", "_block"])
    return joined.withColumn("label", (F.col("score") > F.col("threshold")).cast("int")).drop("_block")


def top_residuals(residuals: DataFrame, window: int = 60, share: float = TOP_RESIDUAL_SHARE) -> DataFrame:
    """The largest residuals of each window, ceil(share * rows) of them.

    A group is a window of at most ``window`` rows.
    """
    from pyspark.sql import Window

    rows = residuals.withColumn("k", F.floor(F.col("t") / window))
    group = Window.partitionBy("series", "k")
    ranked = rows.withColumns({
        "rank": F.row_number().over(group.orderBy(F.desc("residual"), "t")), "_n": F.count(F.lit(1)).over(group)})
    return ranked.filter(F.col("rank") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1))).drop("_n")


def top_share(scores: DataFrame, share: float, max_rows: int | None = None) -> DataFrame:
    """The highest int(n * share) scores of all rows.

    The number kept grows with the data, so rows are ranked over many tasks rather than
    gathered by a limit.
    """
    total = scores.count()
    keyed = scores.withColumn("_all", F.lit(0))
    ranked = numbered(keyed, ["_all"], [F.desc("score"), F.col("series"), F.col("t")], "rank", max_rows)
    return ranked.filter(F.col("rank") <= int(total * share)).drop("_all")


# --- filling in ----------------------------------------------------------------------

def interpolated(rows: DataFrame, keys: Sequence[str], known: Column, value: Column, name: str,
                 method: str = "linear", max_rows: int | None = None) -> DataFrame:
    """Values where ``known`` holds, filled between by line or nearest.

    Outside the first and last known row the nearest known value is used. A point half
    way between two known rows takes the earlier one under ``nearest``.
    """
    pair = F.when(known, F.struct(F.col("t").alias("t"), value.alias("v")))
    counted = large(rows, keys, max_rows)
    out = running(rows, keys, _t(), {"_before": ("last", pair)}, max_rows, counted)
    out = out.withColumn("_back", -F.col("t"))
    out = running(out, keys, [F.col("_back")], {"_after": ("last", pair)}, max_rows, counted).drop("_back")
    t0, v0, t1, v1 = (F.col(c) for c in ("_before.t", "_before.v", "_after.t", "_after.v"))
    if method == "linear":
        between = v0 + (v1 - v0) * (F.col("t") - t0) / F.nullif(t1 - t0, F.lit(0))
    elif method == "nearest":
        between = F.when(F.col("t") - t0 <= t1 - F.col("t"), v0).otherwise(v1)
    else:
        raise ValueError(f"unknown method {method}")
    filled = F.when(t0.isNull(), v1).when(t1.isNull(), v0).when(t0 == t1, v0).otherwise(between)
    return out.withColumn(name, filled).drop("_before", "_after")


def without_extremes(metrics: DataFrame, share: float = 0.2, max_rows: int | None = None) -> DataFrame:
    """Values near the largest magnitude of their metric replaced along a line."""
    peak = metrics.groupBy("series", "metric").agg(F.max(F.abs("value")).alias("_peak"))
    rows = metrics.join(peak, ["series", "metric"])
    normal = F.abs("value") < F.col("_peak") * (1 - share)
    out = interpolated(rows, ["series", "metric"], normal, F.col("value"), "_line", max_rows=max_rows)
    return out.withColumn("smoothed", F.when(normal, F.col("value")).otherwise(F.coalesce("_line", "value"))).drop(
        "_peak", "_line")


def rebuilt(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Series from its key points and anomalies (M24). Rows have key_value and anomaly_value,
    null where there is none."""
    line = interpolated(rows, ["series", "metric"], F.col("key_value").isNotNull(), F.col("key_value"), "_line",
                        max_rows=max_rows)
    return line.withColumn("rebuilt", F.coalesce("anomaly_value", "_line")).drop("_line")


# --- evaluation ----------------------------------------------------------------------

def labelled(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions beside the truth."""
    return predictions.join(labels, ["series", "t"])


def range_adjusted(rows: DataFrame, value: str = "score", max_rows: int | None = None) -> DataFrame:
    """Within a run of true anomalies every point takes the run's highest value."""
    runs = islands(rows, ["series"], _t(), F.col("_was").isNull() | (F.col("_was") != F.col("truth")),
                   {"_was": F.col("truth")}, max_rows=max_rows)
    best = runs.filter(F.col("truth") == 1).groupBy("series", "island").agg(F.max(value).alias("_best"))
    joined = runs.join(best, ["series", "island"], "left")
    return joined.withColumn("adjusted", F.coalesce("_best", value)).drop("_best", "island")


def confusion(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall and F1 of ``label`` against ``truth``."""
    hit, true = F.col("label") == 1, F.col("truth") == 1
    out = rows.groupBy(*keys).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    return with_f1(out)


def with_f1(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; zero where nothing is there to divide."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0),
        "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0),
    })


def _steps_reached(score: Column, steps: int) -> Column:
    """Largest i in 0..steps-1 with i/steps <= score, or -1, exact at the grid points."""
    guess = F.floor(score * steps)
    i = (F.when((guess + 1) / F.lit(float(steps)) <= score, guess + 1)
         .when(guess / F.lit(float(steps)) > score, guess - 1).otherwise(guess))
    return F.greatest(F.least(i, F.lit(steps - 1)), F.lit(-1))


def best_threshold(rows: DataFrame, keys: Sequence[str] = (), value: str = "adjusted", steps: int = 100) -> DataFrame:
    """The threshold i/steps with the best F1; the lowest wins a tie.

    Rows are first counted per grid step, so no row meets every threshold.
    """
    counted = rows.groupBy(*keys, _steps_reached(F.col(value), steps).alias("_i")).agg(
        F.count_if(F.col("truth") == 1).alias("_pos"), F.count_if(F.col("truth") != 1).alias("_neg"))
    # From here on there are at most steps + 1 rows per key.
    per_step = counted.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    at = per_step.groupBy(*keys, "_step").agg(
        F.sum(F.when(F.col("_i") >= F.col("_step"), F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_i") >= F.col("_step"), F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_i") < F.col("_step"), F.col("_pos")).otherwise(0)).alias("fn"))
    scored = with_f1(at).withColumn("threshold", F.col("_step") / F.lit(float(steps)))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("_step")))
    return scored.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def best_threshold_per_window(rows: DataFrame, window: int, stride: int) -> DataFrame:
    """Best threshold of each sliding window, runs cut at its edges."""
    runs = islands(rows, ["series"], _t(), F.col("_was").isNull() | (F.col("_was") != F.col("truth")),
                   {"_was": F.col("truth")})
    placed = (
        runs.withColumn("k", F.explode(F.sequence(
            F.greatest(F.floor((F.col("t") - window) / stride) + 1, F.lit(0)), F.floor(F.col("t") / stride))))
    )
    best = placed.filter("truth = 1").groupBy("series", "k", "island").agg(F.max("score").alias("_best"))
    adjusted = placed.join(best, ["series", "k", "island"], "left").withColumn("adjusted", F.coalesce("_best", "score"))
    return best_threshold(adjusted, ["series", "k"])


def mean_scores(runs: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 per dataset."""
    return runs.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def differing_points(left: DataFrame, right: DataFrame) -> DataFrame:
    """Points where two label series differ."""
    other = right.select("series", "t", F.col("label").alias("other"))
    return left.join(other, ["series", "t"]).filter(F.col("label") != F.col("other"))


def widened(labels: DataFrame, points: int = LABEL_WIDENING, max_rows: int | None = None) -> DataFrame:
    """Labels spread over the points beside them."""
    def add(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("truth", F.max("truth").over(window.rowsBetween(-points, points)))

    return framed(labels, ["series"], _t(), add, before=points, after=points, max_rows=max_rows)


def curvature(metrics: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Absolute second difference; zero at the ends (part of M22)."""
    counted = large(metrics, ["series", "metric"], max_rows)
    out = previous(metrics, ["series", "metric"], _t(), {"_prev": F.col("value")}, max_rows, counted)
    out = following(out, ["series", "metric"], _t(), {"_next": F.col("value")}, max_rows, counted)
    bend = F.abs(F.col("_next") - 2 * F.col("value") + F.col("_prev"))
    return out.withColumn("curvature", F.coalesce(bend, F.lit(0.0))).drop("_prev", "_next")


# --- vectors -------------------------------------------------------------------------

def l2(a: str, b: str) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def similarity(a: str, b: str) -> Column:
    """1 / (1 + distance) (M2)."""
    return 1.0 / (1.0 + l2(a, b))


def residual(original: str, rebuilt_: str, method: str) -> Column:
    """Distance of a row to its rebuilt row."""
    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    apart = F.zip_with(original, rebuilt_, lambda x, y: F.abs(x - y))
    if method in ("Mean", "Manhattan"):
        return total(apart)
    if method == "Euclidean":
        return l2(original, rebuilt_)
    if method == "Chebyshev":
        return F.array_max(apart)
    if method == "Cosine":
        dot = total(F.zip_with(original, rebuilt_, lambda x, y: x * y))
        length = F.sqrt(total(F.transform(original, lambda x: x * x))) * F.sqrt(total(F.transform(rebuilt_, lambda x: x * x)))
        return dot / F.nullif(length, F.lit(0.0))
    raise ValueError(f"unknown method {method}")
