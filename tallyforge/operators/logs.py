"""Training logs and reasoning sessions: metrics, anomalies, summaries, issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.ordered import numbered

# Patterns of metrics and anomalies in a log line, and limits of the metrics.
METRIC_PATTERNS = {
    "loss": [r"loss[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", r"train_loss[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)",
             r"validation_loss[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"],
    "accuracy": [r"accuracy[:=]\s*([0-9]*\.?[0-9]+)", r"acc[:=]\s*([0-9]*\.?[0-9]+)", r"train_acc[:=]\s*([0-9]*\.?[0-9]+)",
                 r"val_acc[:=]\s*([0-9]*\.?[0-9]+)"],
    "learning_rate": [r"learning_rate[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", r"lr[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"],
    "gpu_memory": [r"GPU.*memory.*([0-9]+\.?[0-9]*)\s*GB", r"memory.*usage.*([0-9]+\.?[0-9]*)\s*GB",
                   r"allocated.*([0-9]+\.?[0-9]*)\s*[GM]B", r"memory usage=([0-9]+\.?[0-9]*)GB"],
    "gpu_utilization": [r"GPU.*utilization.*([0-9]+)", r"GPU.*usage.*([0-9]+)", r"utilization=([0-9]+)%"],
    "throughput": [r"throughput[:=]\s*([0-9]*\.?[0-9]+).*tokens?/s", r"tokens/second[:=]\s*([0-9]*\.?[0-9]+)",
                   r"samples/second[:=]\s*([0-9]*\.?[0-9]+)"],
    "latency": [r"latency[:=]\s*([0-9]*\.?[0-9]+).*ms", r"inference.*time[:=]\s*([0-9]*\.?[0-9]+).*seconds?",
                r"processing.*time[:=]\s*([0-9]*\.?[0-9]+)"],
    "gradient_norm": [r"gradient.*norm[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", r"grad_norm[:=]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"],
    "epoch": [r"epoch[:=]\s*([0-9]+)", r"Epoch\s+([0-9]+)"],
    "step": [r"step[:=]\s*([0-9]+)", r"Step\s+([0-9]+)"],
}
ANOMALY_PATTERNS = {
    "memory_issues": [r"out of memory|OOM|OutOfMemoryError", r"CUDA out of memory", r"memory allocation failed", r"insufficient memory", r"memory leak"],
    "gpu_errors": [r"CUDA error|CUDA runtime error", r"CUDNN_STATUS_EXECUTION_FAILED", r"GPU device not found", r"NVIDIA-SMI has failed",
                   r"device-side assert triggered"],
    "training_instability": [r"loss.*nan|loss.*inf", r"gradient.*nan|gradient.*inf", r"gradient.*explosion", r"learning rate.*too.*high",
                             r"training.*unstable", r"diverged|diverging"],
    "convergence_issues": [r"no improvement for \d+ epochs", r"early stopping", r"plateau.*detected", r"learning.*stagnated"],
    "data_issues": [r"empty.*batch|batch.*size.*0", r"data.*corruption|corrupt.*data", r"missing.*files|file.*not.*found", r"invalid.*data|data.*invalid"],
    "model_issues": [r"failed.*load.*model|model.*loading.*failed", r"checkpoint.*not.*found|missing.*checkpoint",
                     r"model.*format.*error|invalid.*model", r"version.*mismatch|incompatible.*version"],
    "performance_issues": [r"timeout|time.*out", r"slow.*training|training.*slow", r"low.*throughput|throughput.*low", r"high.*latency|latency.*high"],
}
LIMITS = {
    "loss": (0.0, 100.0), "accuracy": (0.0, 1.0), "learning_rate": (1e-8, 1.0), "gpu_memory": (None, 95.0),
    "gpu_utilization": (10.0, 100.0), "throughput": (1.0, None), "latency": (None, 10000.0), "gradient_norm": (None, 100.0),
}
FINITE_METRICS = ["loss", "gradient_norm"]
ADVICE = {
    "memory_issues": "check_hardware", "gpu_errors": "check_hardware", "training_instability": "adjust_hyperparameters",
    "convergence_issues": "adjust_hyperparameters", "data_issues": "check_data", "model_issues": "check_model_files",
    "performance_issues": "improve_performance",
}
LINE_TIME = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?"

# Words and limits of the session rules.
ERROR_WORDS = ["error", "failed", "exception", "traceback", "错误", "失败", "异常"]
QUOTA_WORDS = ["limit", "quota", "rate", "限制", "配额"]
TIMEOUT_WORDS = ["timeout", "超时", "time out"]
SLOW_SESSION_S = 60
MANY_STEPS = 20
SHORT_RESPONSE = 50


def log_metrics(lines: DataFrame) -> DataFrame:
    """Every metric value in a line (F15). Lines have log, line, text.

    Gives log, line, time, metric, pattern, place (the match in the line), value.
    """
    def values(metric: str, number: int, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(1))
        return F.transform(found, lambda v, i: F.struct(
            F.lit(metric).alias("metric"), F.lit(number).alias("pattern"), i.alias("place"), v.try_cast("double").alias("value")))

    entries = [values(m, n, p) for m, patterns in METRIC_PATTERNS.items() for n, p in enumerate(patterns)]
    stamp = F.nullif(F.regexp_extract("text", LINE_TIME, 0), F.lit(""))
    return lines.select("log", "line", stamp.alias("time"), F.inline(F.concat(*entries))).filter("value is not null")


def metric_summary(metrics: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Count, range, mean, last value and trend of each metric of a log."""
    order = [F.col("line"), F.col("pattern"), F.col("place")]
    rows = numbered(metrics, ["log", "metric"], order, "_at", max_rows)
    slope = F.regr_slope("value", "_at")
    return rows.groupBy("log", "metric").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"),
        F.max_by("value", "_at").alias("last"),
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable").alias("trend"))


def pattern_anomalies(lines: DataFrame) -> DataFrame:
    """One row per anomaly pattern that a line meets."""
    hits = [F.when(F.col("text").rlike("(?i)" + p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("pattern")))
            for c, patterns in ANOMALY_PATTERNS.items() for n, p in enumerate(patterns)]
    return lines.select("log", "line", F.inline(F.array_compact(F.array(*hits)))).withColumn("severity", F.lit("low"))


def limit_anomalies(metrics: DataFrame) -> DataFrame:
    """Metric values outside their limits."""
    name, value = F.col("metric"), F.col("value")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for metric, (lower, upper) in LIMITS.items():
        low = F.when(name == metric, F.lit(lower).cast("double")).otherwise(low)
        high = F.when(name == metric, F.lit(upper).cast("double")).otherwise(high)
    broken = name.isin(*FINITE_METRICS) & (F.isnan(value) | (F.abs(value) == float("inf")))
    side = F.when(broken, "not_finite").when(value < low, "below").when(value > high, "above")
    return metrics.select(
        "log", "line", F.concat(name, F.lit("_issues")).alias("category"), "pattern", "metric", "value", side.alias("side"),
        F.when(broken, "critical").otherwise("high").alias("severity")).filter("side is not null")


def anomalies(lines: DataFrame) -> DataFrame:
    """All anomalies of a log."""
    hit = pattern_anomalies(lines).select("log", "line", "category", "severity")
    return hit.unionByName(limit_anomalies(log_metrics(lines)).select("log", "line", "category", "severity"))


def anomaly_counts(found: DataFrame, by: str) -> DataFrame:
    """Anomalies by category or severity."""
    return found.groupBy("log", by).agg(F.count(F.lit(1)).alias("anomalies"))


def recommendations(lines: DataFrame) -> DataFrame:
    """Distinct advice per log."""
    advice = F.lit(None).cast("string")
    for category, text in ADVICE.items():
        advice = F.when(F.col("category") == category, text).otherwise(advice)
    general = pattern_anomalies(lines).select("log", advice.alias("advice"))
    limits = limit_anomalies(log_metrics(lines)).filter("side <> 'not_finite'").select(
        "log", F.concat(F.when(F.col("side") == "below", "raise ").otherwise("lower "), F.col("metric")).alias("advice"))
    return general.unionByName(limits).distinct()


# --- sessions ------------------------------------------------------------------------

def session_list(steps: DataFrame) -> DataFrame:
    """Ids of all sessions."""
    return steps.select("session_id").distinct()


def session_summary(steps: DataFrame) -> DataFrame:
    """Steps, step types, start, end and duration of a session (A26). Steps: session_id,
    step, t (us), step_type, content."""
    per_type = steps.groupBy("session_id", "step_type").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return per_type.groupBy("session_id").agg(
        F.sum("n").alias("total_steps"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("step_type", "n")))).alias("step_types"),
        F.min("a").alias("start_t"), F.max("b").alias("end_t"), ((F.max("b") - F.min("a")) / 1e6).alias("duration_s"))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def session_issues(steps: DataFrame) -> DataFrame:
    """Errors, warnings, slow or long sessions, contradictions, unfinished and short answers.

    Gives session_id, step (null for a session as a whole), issue, group, severity.
    """
    text, kind = F.lower(F.coalesce("content", F.lit(""))), F.col("step_type")
    answer = kind == "response_complete"

    def issue(cond: Column, name: str, group: str, level: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("issue"), F.lit(group).alias("group"), F.lit(level).alias("severity")))

    own = F.array_compact(F.array(
        issue(kind == "error", "explicit_error", "errors", "high"),
        issue(_any(text, ERROR_WORDS), "error_keyword", "errors", "medium"),
        issue(text.contains("api") & _any(text, QUOTA_WORDS), "api_limit_warning", "warnings", "medium"),
        issue(_any(text, TIMEOUT_WORDS), "timeout_warning", "warnings", "low"),
        issue(answer & F.col("content").contains("不是") & F.col("content").contains("是"), "contradiction", "logical", "medium"),
        issue(answer & (F.length(F.trim("content")) < SHORT_RESPONSE), "short_response", "incomplete", "low")))
    by_step = steps.select("session_id", "step", F.inline(own))
    totals = steps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), ((F.max("t") - F.min("t")) / 1e6).alias("_s"),
        F.count_if(kind == "streaming_start").alias("_open"), F.count_if(answer).alias("_done"))
    whole = F.array_compact(F.array(
        issue(F.col("_s") > SLOW_SESSION_S, "slow_response", "performance", "medium"),
        issue(F.col("_n") > MANY_STEPS, "too_many_steps", "performance", "low"),
        issue(F.col("_open") > F.col("_done"), "incomplete_streaming", "incomplete", "high")))
    by_session = totals.select("session_id", F.lit(None).cast(dict(steps.dtypes)["step"]).alias("step"), F.inline(whole))
    return by_step.unionByName(by_session)


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues of a session and what to make of them."""
    high = F.count_if(F.col("severity") == "high")
    total = F.count(F.lit(1))
    return issues.groupBy("session_id").agg(
        total.alias("total_issues"), high.alias("high_severity"),
        F.count_if(F.col("group") == "errors").alias("errors"), F.count_if(F.col("group") == "warnings").alias("warnings"),
        F.count_if(F.col("group") == "performance").alias("performance"),
        F.when(high > 0, "serious").when(total > 5, "several").otherwise("few").alias("verdict"))
