"""Stateful stream operators: pending calls, window scores, adaptive thresholds.

State is kept per key and dropped after ``timeout_ms`` without rows, or kept for good when
that is None. A timeout keeps the stream running batches, so a run that should end by itself
(``availableNow``) takes None. Rows of one key are taken in the order of ``t`` within a batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.functions import signal, tails

TIMEOUT_MS = 3_600_000
WINDOW = 60


def _kind(timeout_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["t", "seq"])


def paired_calls(events: DataFrame, timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """Exits with the pending enter of their (tgid, pid, cookie) on a stream.

    Rows: tgid, pid, cookie, is_enter, function_name, t, seq.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending_t, pending_name = state.get if state.exists else (0, None)
        rows = _rows(batches)
        enters, t, names = rows["is_enter"].to_numpy(bool), rows["t"].to_numpy(), rows["function_name"].to_numpy(object)
        # an exit pairs exactly when the row before it is an enter; before the first row of a batch stands the state
        started = np.append(state.exists, enters[:-1])
        start_t, start_name = np.append(pending_t, t[:-1]), np.append(np.array([pending_name], object), names[:-1])
        hit = started & ~enters
        if enters[-1]:
            state.update((int(t[-1]), names[-1]))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        ids = {name: [value] * int(hit.sum()) for name, value in zip(("tgid", "pid", "cookie"), key, strict=True)}
        yield pd.DataFrame({**ids, "function_name": start_name[hit], "start_t": start_t[hit], "t": t[hit], "duration": (t - start_t)[hit]})

    return events.groupBy("tgid", "pid", "cookie").applyInPandasWithState(
        step, "tgid long, pid long, cookie long, function_name string, start_t long, t long, duration long",
        "start_t long, function_name string", "append", _kind(timeout_ms))


def reports_every(events: DataFrame, n: int, keys: Sequence[str], value: str, timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """The counters of a key at each ``n``-th of its events on a stream (R6): keys, t, events, total.

    The count goes on across micro-batches, so a batch may end between two reports. The state is two numbers a key;
    rows of a micro-batch count in the order of t and seq, micro-batches in the order they come. A null value adds nothing.
    The key columns and the long value keep their types.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events_before, total_before = state.get if state.exists else (0, 0)
        rows = _rows(batches)
        # whole numbers even where nulls make pandas hold floats
        total = total_before + rows[value].fillna(0).astype("int64").cumsum().to_numpy()
        number = events_before + np.arange(1, len(rows) + 1)
        state.update((int(number[-1]), int(total[-1])))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        due = number % n == 0
        out = {k: [v] * int(due.sum()) for k, v in zip(keys, key, strict=True)}
        yield pd.DataFrame({**out, "t": rows["t"].to_numpy()[due], "events": number[due], "total": total[due]})

    columns = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "t long", "events long", "total long"])
    return events.select(*keys, "t", "seq", value).groupBy(*keys).applyInPandasWithState(
        step, columns, "events long, total long", "append", _kind(timeout_ms))


def window_scores(points: DataFrame, window: int = WINDOW, draws: int = 40, size: int = 20,
                  timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """Outlier scores of every full count window of a series on a stream.

    Rows fill a window of ``window`` points; a full one is scored against itself and the
    window before it, then cleared. Rows: series, t, seq, x (array).
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, before, held = pickle.loads(state.get[0]) if state.exists else (0, [], [])
        out = []
        for row in _rows(batches).itertuples():
            held.append((row.t, list(row.x)))
            if len(held) == window:
                data = np.array([x for _, x in held], float)
                pool = np.array(before + [x for _, x in held], float)
                scores = signal.outlier_scores(data, pool, draws, size, np.random.default_rng(number))
                out += [(key[0], t, number, float(s)) for (t, _), s in zip(held, scores)]
                before, held, number = [x for _, x in held], [], number + 1
        state.update((pickle.dumps((number, before, held)),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["series", "t", "k", "score"])

    return points.groupBy("series").applyInPandasWithState(
        step, "series string, t long, k long, score double", "held binary", "append", _kind(timeout_ms))


def adaptive_threshold(scores: DataFrame, calibration: int = 1200, risk: float = 1e-4, level: float = 0.98,
                       timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """Threshold and label of each score of a stream, after the points used to calibrate.

    Rows: series, t, seq, score.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spot, first = pickle.loads(state.get[0]) if state.exists else (None, [])
        out = []
        for row in _rows(batches).itertuples():
            if spot is None:
                first.append(row.score)
                if len(first) == calibration:
                    spot, first = tails.Spot(np.array(first), risk, level), []
                continue
            limit, _, alarm = spot.step(row.score)
            out.append((key[0], row.t, row.score, limit, int(alarm)))
        state.update((pickle.dumps((spot, first)),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["series", "t", "score", "threshold", "label"])

    return scores.groupBy("series").applyInPandasWithState(
        step, "series string, t long, score double, threshold double, label int", "held binary", "append",
        _kind(timeout_ms))
