"""Interval joins on grids, one grid per magnitude of interval length.

An interval whose length is under 8^k sits on level k, whose cells are 8^k wide, so it
touches at most two cells however long it is. Two intervals meet on the level of the
longer one; the shorter touches at most two cells there as well. No bucket width has to
be chosen and a long interval is never spread over many buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.ordered import MAX_ROWS, Large, previous
from tallyforge.session import cut_lineage

_BITS = 3  # cells grow eightfold per level; 64-bit times need at most 22 levels
_WORD = 6  # bits of the place in a word of 64 kinds


def _with_level(df: DataFrame, start: str, end: str) -> DataFrame:
    length = F.col(end) - F.col(start)
    bits = F.when(length <= 0, 0).otherwise(F.length(F.bin(length)))
    return df.withColumn("_level", F.ceil(bits / F.lit(_BITS)).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    return sorted(row[0] for row in df.select("_level").distinct().collect())


def _expanded(df: DataFrame, start: str, end: str, levels: Sequence[int]) -> DataFrame:
    """One row per level in use at or above the row's own, and per cell touched there."""
    grid = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("_level"))
    shift = f"_at * {_BITS}"
    return (
        df.withColumn("_at", F.explode(grid))
        .withColumn("_from", F.expr(f"shiftright({start}, {shift})"))
        .withColumn("_cell", F.explode(F.sequence("_from", F.expr(f"shiftright({end}, {shift})"))))
    )


def overlap_join(
    left: DataFrame, right: DataFrame, on: Sequence[str],
    left_span: tuple[str, str], right_span: tuple[str, str],
) -> DataFrame:
    """Pairs of rows equal on ``on`` whose closed spans (longs) meet. Each pair comes once.

    Column names other than ``on`` must differ between the sides. A side whose span names
    the same column twice is a set of points.
    """
    a, b = _with_level(left, *left_span), _with_level(right, *right_span)
    levels = sorted(set(_levels(a) if left_span[0] != left_span[1] else [0])
                    | set(_levels(b) if right_span[0] != right_span[1] else [0]))
    a = _expanded(a, *left_span, levels)
    b = _expanded(b, *right_span, levels)
    for name in ("_level", "_at", "_from", "_cell", *on):
        b = b.withColumnRenamed(name, f"_r{name}")
    equal = [F.col(k) == F.col(f"_r{k}") for k in (*on, "_at", "_cell")]
    exact = [
        F.col("_at") == F.greatest("_level", "_r_level"),
        F.col("_cell") == F.greatest("_from", "_r_from"),
        F.col(left_span[0]) <= F.col(right_span[1]),
        F.col(right_span[0]) <= F.col(left_span[1]),
    ]
    joined = a.join(b, reduce(lambda x, y: x & y, equal + exact))
    return joined.drop("_level", "_at", "_from", "_cell", "_r_level", "_r_at", "_r_from", "_r_cell",
                       *[f"_r{k}" for k in on])


def contained_points(
    spans: DataFrame, points: DataFrame, on: Sequence[str], start: str, end: str, at: str
) -> DataFrame:
    """Points with ``start <= at <= end`` joined to every span that holds them.

    A point lies in one cell of each level, so a span is only put into cells of its own.
    """
    a = _with_level(spans.filter(F.col(start) <= F.col(end)), start, end)
    levels = _levels(a)
    a = _expanded(a, start, end, levels).filter(F.col("_at") == F.col("_level"))
    b = points.withColumn("_at", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    b = b.withColumn("_cell", F.expr(f"shiftright({at}, _at * {_BITS})"))
    for name in ("_at", "_cell", *on):
        b = b.withColumnRenamed(name, f"_r{name}")
    equal = [F.col(k) == F.col(f"_r{k}") for k in (*on, "_at", "_cell")]
    held = F.col(at).between(F.col(start), F.col(end))
    joined = a.join(b, reduce(lambda x, y: x & y, equal) & held)
    return joined.drop("_level", "_at", "_from", "_cell", "_r_at", "_r_cell", *[f"_r{k}" for k in on])


def kinds_within(
    spans: DataFrame, points: DataFrame, on: Sequence[str], kinds: Sequence[str], start: str, end: str, at: str,
    max_rows: int | None = None,
) -> DataFrame:
    """Every span with each kind of point in it, once: the span's columns and the ``kinds`` columns of the points.

    Cells are as wide as the largest power of two that fits into the span, so it touches at most three of them and none
    sticks out of it on both sides. Whether a cell's points of one kind meet the span then follows from the first and the
    last of them. A kind counts in the first cell where it is met: its last point before that cell lies before the span.
    So a span and a kind form at most three rows, however many points of the kind the span holds.
    """
    return _kinds_met(spans, _moments(points, on, kinds, at), on, kinds, start, end, max_rows)


@dataclass(frozen=True)
class KindSets:
    """What ``kinds_within`` lists, 64 kinds a row: the spans' columns with ``_word`` and its ``_bits``, which may stand in
    several rows of a span; and the kinds, each with its ``_word`` and its one bit in ``_bits``."""

    rows: DataFrame
    kinds: DataFrame


def kind_sets_within(
    spans: DataFrame, points: DataFrame, on: Sequence[str], kinds: Sequence[str], start: str, end: str, at: str,
    max_rows: int | None = None,
) -> KindSets:
    """``kinds_within`` as sets. Kinds are numbered in their order, so that those of one first column lie together."""
    moments = _moments(points, on, kinds, at)
    counts = cut_lineage(moments.groupBy(*on, *kinds).agg(F.count(F.lit(1)).alias("_rows")))
    number = counts.select(*kinds).distinct().orderBy(*kinds).withColumn("_number", F.monotonically_increasing_id())
    number = cut_lineage(number).withColumns({"_word": F.shiftright("_number", _WORD), "_bit": F.col("_number").bitwiseAND(2**_WORD - 1).cast("int")})
    known = number.select(*[F.col(k).alias(f"_k_{k}") for k in kinds], "_word", "_bit")

    def numbered(rows: DataFrame) -> DataFrame:
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in kinds])
        return rows.join(known, same).drop(*kinds, *[f"_k_{k}" for k in kinds])

    hot = counts.filter(F.col("_rows") > (max_rows or MAX_ROWS))
    counted = Large(None if hot.isEmpty() else cut_lineage(numbered(hot)))
    met = _kinds_met(spans, numbered(moments), on, ["_word", "_bit"], start, end, max_rows, counted)
    bit = F.expr("shiftleft(1L, _bit)")
    return KindSets(met.withColumn("_bits", bit).drop("_bit"), number.select(*kinds, "_word", bit.alias("_bits")))


def _moments(points: DataFrame, on: Sequence[str], kinds: Sequence[str], at: str) -> DataFrame:
    return points.filter(F.col(at).isNotNull()).select(*on, *kinds, F.col(at).alias("_moment")).distinct()


def _kinds_met(
    spans: DataFrame, moments: DataFrame, on: Sequence[str], kinds: Sequence[str], start: str, end: str,
    max_rows: int | None, counted: Large | None = None,
) -> DataFrame:
    cut = spans.filter(F.col(start) <= F.col(end)).withColumn("_level", F.length(F.bin(F.col(end) - F.col(start) + 1)) - 1)
    levels = _levels(cut)
    cut = cut.withColumn("_from", F.expr(f"shiftright({start}, _level)"))
    cut = cut.withColumn("_cell", F.explode(F.sequence("_from", F.expr(f"shiftright({end}, _level)"))))

    looked = previous(moments, [*on, *kinds], [F.col("_moment")], {"_before": F.col("_moment")}, max_rows, counted)
    cells = looked.withColumn("_grid", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).groupBy(
        *[F.col(k).alias(f"_r_{k}") for k in on], *kinds, "_grid", F.expr("shiftright(_moment, _grid)").alias("_r_cell")).agg(
        F.min("_moment").alias("_first"), F.max("_moment").alias("_last"),
        F.min(F.coalesce("_before", F.lit(-(2**63)))).alias("_before"))
    equal = [*[F.col(k) == F.col(f"_r_{k}") for k in on], F.col("_level") == F.col("_grid"), F.col("_cell") == F.col("_r_cell")]
    met = (F.col("_first") <= F.col(end)) & (F.col("_last") >= F.col(start))
    new = (F.col("_cell") == F.col("_from")) | (F.col("_before") < F.col(start))
    joined = cut.join(cells, reduce(lambda x, y: x & y, equal) & met & new)
    return joined.drop("_level", "_from", "_cell", "_grid", "_r_cell", "_first", "_last", "_before", *[f"_r_{k}" for k in on])
