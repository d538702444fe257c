"""Whitening of embeddings: projections on the leading components of their covariance, scaled to unit variance.

Entries are taken as whole 256ths. The components are fitted to the distinct vectors: exact sums in one pass, centred
products in a second, both added up in the tasks first; the small matrix that is left is decomposed by `feast`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import feast
from tallyforge.llm.common import work_folder, written

COMPONENTS = 4
#: An eigenvalue below this share of the trace is no component: there is nothing to scale.
LEAST = 1e-12
ROWS = 20_000


def _whole(vector: Column) -> Column:
    """floor(256 c) of each entry as a long; null where the vector or an entry is null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(entries, lambda c: F.floor(c * 256).cast("long")))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Vectors as rows; missing entries are zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        return values.reshape(len(column), d)
    out = np.zeros((len(column), d), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.empty(0, int)])] = values
    return out


def _totals(fit: DataFrame, d: int, columns: str, start: Callable[[], list[np.ndarray]], add: Callable[[list[np.ndarray], np.ndarray], None]) -> dict:
    """Arrays that are added up row by row, in the tasks and then by place: (array, place) to total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                add(held, _matrix(batch.column(0).slice(at, ROWS), d))
        flat = [h.ravel() for h in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(flat), dtype=np.int32), [len(f) for f in flat])),
             pa.array(np.concatenate([np.arange(len(f), dtype=np.int32) for f in flat])), pa.array(np.concatenate(flat))], ["part", "place", "value"])

    kind, total = (("long", "decimal(38,0)") if columns == "long" else ("double", "double"))
    rows = fit.mapInArrow(run, f"part int, place int, value {kind}")
    return {(r.part, r.place): r.total for r in rows.groupBy("part", "place").agg(F.sum(F.col("value").cast(total)).alias("total")).collect()}


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sum of each entry, by halves that cannot overflow in a task."""
    def add(held: list[np.ndarray], x: np.ndarray) -> None:
        held[0] += (x >> 32).sum(axis=0)
        held[1] += (x & 0xFFFFFFFF).sum(axis=0)

    found = _totals(fit, d, "long", lambda: [np.zeros(d, np.int64) for _ in range(2)], add)
    return [int(found.get((0, i), Decimal(0))) * 2**32 + int(found.get((1, i), Decimal(0))) for i in range(d)]


def _products(fit: DataFrame, d: int, rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of y y^T over the vectors, where `rows` makes y of x."""
    def add(held: list[np.ndarray], x: np.ndarray) -> None:
        y = rows(x)
        held[0] += y.T @ y

    found = _totals(fit, d, "double", lambda: [np.zeros((width, width))], add)
    return np.array([found.get((0, i), 0.0) for i in range(width * width)]).reshape(width, width)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of squares of n x - S for each row; null where it does not fit a long."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) < 2**63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whitened(embeddings: DataFrame, *, vector: str = "embedding", id_: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector is dropped if it is null or holds a null or an entry that is not finite. Shorter vectors count as filled up
    with zeros to the longest. Equal vectors count once in the fit; each of their rows is returned. Components with
    next to no variance (`LEAST` of the trace) are left out, so a table with one distinct vector, or none, gives no
    rows. deviation is null where the exact number exceeds a long. Ids may repeat or be null; other columns play no part.
    """
    spark = embeddings.sparkSession
    held = f"vec_id {embeddings.schema[id_].dataType.simpleString()}"
    schema = f"{held}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(embeddings[id_].alias("vec_id"), _whole(embeddings[vector]).alias("x")).where("x is not null")
    folder = work_folder(spark, "whitening")
    fit = written(rows.select("x").distinct(), f"{folder}/fit")
    n, d, least = fit.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.min(F.size("x"))).first()
    if least != d:  # filled up, vectors may be equal that were not before
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x")))
        fit = written(fit.select(filled.alias("x")).distinct(), f"{folder}/filled")
        n = fit.count()
    nothing = spark.createDataFrame([], schema)
    if n < 2 or d == 0:
        return nothing
    sums = _sums(fit, d)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = _products(fit, d, lambda x: x - mean, d) / n
    trace = float(np.trace(covariance))
    if not trace > 0:
        return nothing
    values, vectors = feast.largest(spark, covariance, components)
    live = values > LEAST * trace
    values, scaled = values[live], vectors[:, live] / np.sqrt(values[live])
    k = len(values)
    error = float(np.abs(_products(fit, d, lambda x: (x - mean) @ scaled, k) / n - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), d)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                     pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(((x - mean) @ scaled).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
