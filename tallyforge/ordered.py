"""Ordered (window) computations that hold when one key owns a large share of all rows.

A plain window puts every row of a key into one task. The helpers here keep that
plain window for ordinary keys. Keys measured to be over ``max_rows`` are laid out by
range over (key, order) instead, so a key spreads over many tasks, and what has to
cross a task border is carried by a table with one row per border.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyforge.session import cut_lineage

# Rows of one key that one task may hold.
MAX_ROWS = 4_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> DataFrame | None:
    """The keys with more than ``max_rows`` rows and their counts, or None when there are none.

    Every input is counted, by one aggregation with partial counts in each task; every key over the
    limit is split. At most one key for each ``max_rows`` rows of the input can be.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > (max_rows or MAX_ROWS))
    return None if counted.isEmpty() else cut_lineage(counted)


@dataclass(frozen=True)
class Large:
    """The large keys of a table, counted once for all helpers that read its rows, or a part of them, by the same keys."""

    hot: DataFrame | None


def large(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> Large:
    """What the helpers take as ``counted``: a chain of them on the same rows and keys counts its input once."""
    return Large(hot_keys(df, keys, max_rows))


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def _split_off(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys). Spark broadcasts the hot keys if they turn out to be few."""
    small = hot.select(*keys)
    on = _same(df, small, keys)
    return df.join(small, on, "left_anti"), df.join(small, on, "left_semi")


def _slotted(hot_rows: DataFrame, keys: Sequence[str], order: Sequence[Column], slots: int) -> DataFrame:
    """Hot rows with ``_slot``, increasing along the order, each slot about the same size.

    The layout is written once so that every later reader sees the same borders.
    """
    laid_out = hot_rows.repartitionByRange(max(slots, 1), *keys, *order)
    return cut_lineage(laid_out.withColumn("_slot", F.spark_partition_id()))


def _slot_count(hot: DataFrame, max_rows: int) -> int:
    total = hot.agg(F.sum("_rows")).first()[0]
    return -(-int(total) // max_rows)


def _carry(
    slotted: DataFrame, keys: Sequence[str], order: Sequence[Column], partial: Sequence[Column], totals: Sequence[Column]
) -> DataFrame:
    """Per (key, slot): ``totals`` over all earlier slots of the key. One row per slot border."""
    per_slot = slotted.groupBy(*keys, "_slot").agg(*partial)
    return per_slot.select(*keys, "_slot", *totals)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 1,
    after: int = 0,
    max_rows: int | None = None,
    counted: Large | None = None,
) -> DataFrame:
    """Add columns that look at most ``before`` rows back and ``after`` rows ahead in a key.

    ``add(rows, window)`` gets an ordered window; every frame it uses must stay inside
    those bounds. ``order`` must be total within a key.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = (counted or large(df, keys, max_rows)).hot
    if hot is None:
        return add(df, plain)

    limit = max(max_rows or MAX_ROWS, before + after + 1)
    cold_rows, hot_rows = _split_off(df, keys, hot)
    slotted = _slotted(hot_rows, keys, order, _slot_count(hot, limit))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _carry(
        slotted, keys, order,
        [F.count(F.lit(1)).alias("_n")],
        [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")],
    )
    within = Window.partitionBy(*keys, "_slot").orderBy(*order)
    numbered = _join_slots(slotted.withColumn("_rn", F.row_number().over(within)), offsets, keys)
    numbered = numbered.withColumn("_pos", F.col("_offset") + F.col("_rn") - 1).drop("_slot", "_rn", "_offset")

    home = F.floor(F.col("_pos") / limit)
    low = F.floor(F.greatest(F.col("_pos") - after, F.lit(0)) / limit)
    high = F.floor((F.col("_pos") + before) / limit)
    copies = (
        numbered.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(low, high)))
    )
    chunked = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    done = add(copies, chunked).filter(F.col("_chunk") == F.col("_home")).drop("_pos", "_home", "_chunk")
    return add(cold_rows, plain).unionByName(done)


def _join_slots(rows: DataFrame, per_slot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows to the table of slot borders, which has one row per slot a key touches."""
    side = per_slot.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slot").alias("_k_slot"),
                           *[c for c in per_slot.columns if c not in (*keys, "_slot")])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = rows.join(side, on & (F.col("_slot") == F.col("_k_slot")))
    return joined.drop(*[f"_k_{k}" for k in keys], "_k_slot")


_FOLDS = {
    "sum": (F.sum, lambda carried, here: F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Mapping[str, tuple[str, Column]],
    max_rows: int | None = None,
    counted: Large | None = None,
) -> DataFrame:
    """Add running values from the first row of a key to the current row.

    ``columns`` maps a new name to ``(fold, expression)`` with fold one of sum, max, min
    or last (the latest non-null value). ``order`` must be total within a key.
    """
    def local(rows: DataFrame, window: WindowSpec, suffix: str = "") -> DataFrame:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        new = {}
        for name, (fold, expr) in columns.items():
            agg = F.last(expr, ignorenulls=True) if fold == "last" else _FOLDS[fold][0](expr)
            new[name + suffix] = agg.over(frame)
        return rows.withColumns(new)

    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = (counted or large(df, keys, max_rows)).hot
    if hot is None:
        return local(df, plain)

    cold_rows, hot_rows = _split_off(df, keys, hot)
    slotted = _slotted(hot_rows, keys, order, _slot_count(hot, max_rows or MAX_ROWS))
    # A row's own value may be null, so "last" keeps its order key beside the value.
    partial, totals = [], []
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    order_key = F.struct(*order)
    for name, (fold, expr) in columns.items():
        if fold == "last":
            partial.append(F.max_by(expr, F.when(expr.isNotNull(), order_key)).alias(f"_p_{name}"))
            totals.append(F.last(f"_p_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        else:
            agg = _FOLDS[fold][0]
            partial.append(agg(expr).alias(f"_p_{name}"))
            totals.append(agg(f"_p_{name}").over(earlier).alias(f"_c_{name}"))
    borders = _carry(slotted, keys, order, partial, totals)
    inside = local(slotted, Window.partitionBy(*keys, "_slot").orderBy(*order), "_here")
    joined = _join_slots(inside, borders, keys)
    final = {}
    for name, (fold, _) in columns.items():
        carried, here = F.col(f"_c_{name}"), F.col(f"{name}_here")
        if fold == "last":
            final[name] = F.coalesce(here, carried)
        elif fold == "sum":
            final[name] = F.when(carried.isNull() & here.isNull(), None).otherwise(_FOLDS[fold][1](carried, here))
        else:
            final[name] = _FOLDS[fold][1](carried, here)
    done = joined.withColumns(final).drop("_slot", *[f"_c_{n}" for n in columns], *[f"{n}_here" for n in columns])
    return local(cold_rows, plain).unionByName(done)


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Mapping[str, Column],
    max_rows: int | None = None, counted: Large | None = None,
) -> DataFrame:
    """Add the value each expression had on the row before, null on the first row of a key."""
    def add(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return rows.withColumns({name: F.lag(expr).over(window) for name, expr in columns.items()})

    return framed(df, keys, order, add, before=1, max_rows=max_rows, counted=counted)


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Mapping[str, Column],
    max_rows: int | None = None, counted: Large | None = None,
) -> DataFrame:
    """Add the value each expression has on the row after, null on the last row of a key."""
    def add(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return rows.withColumns({name: F.lead(expr).over(window) for name, expr in columns.items()})

    return framed(df, keys, order, add, before=0, after=1, max_rows=max_rows, counted=counted)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, max_rows: int | None = None,
    counted: Large | None = None,
) -> DataFrame:
    """Add the 1-based position of a row in its key as a long."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, max_rows, counted)


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], starts: Column,
    previous_columns: Mapping[str, Column], name: str = "island", max_rows: int | None = None,
) -> DataFrame:
    """Number the runs of rows in a key. ``starts`` is true where a run begins and may use
    the ``previous_columns``, which are dropped again."""
    counted = large(df, keys, max_rows)
    looked = previous(df, keys, order, previous_columns, max_rows, counted)
    flagged = looked.withColumn("_starts", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0).cast("long"))
    out = running(flagged, keys, order, {name: ("sum", F.col("_starts"))}, max_rows, counted)
    return out.drop("_starts", *previous_columns)
