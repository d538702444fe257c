"""Pairing of enter with exit records, and of frees with their allocations.

Record tables carry ``t`` (a long time) and ``seq`` (any orderable tie-break), which
together order the rows of a key totally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.ordered import Large, previous

ORDER = ("t", "seq")


def order_columns():
    return [F.col(c) for c in ORDER]


def pair_latest(
    events: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), max_rows: int | None = None
) -> DataFrame:
    """Exits joined to the pending enter of their key.

    ``is_enter`` tells the two kinds apart. An enter replaces a pending enter; an exit
    uses the pending enter up; an exit with none pending is dropped. So an exit pairs
    exactly when the row before it in its key is an enter.

    Returns the exit rows with ``start_t``, ``duration`` and ``enter_<name>`` for each
    name in ``keep``.
    """
    looked = previous(
        events, keys, order_columns(),
        {"_was_enter": F.col("is_enter"), "start_t": F.col("t"), **{f"enter_{c}": F.col(c) for c in keep}},
        max_rows,
    )
    paired = looked.filter(~F.col("is_enter") & F.col("_was_enter"))
    return paired.withColumn("duration", F.col("t") - F.col("start_t")).drop("_was_enter", "is_enter")


def match_frees(events: DataFrame, max_rows: int | None = None, counted: Large | None = None) -> DataFrame:
    """All rows with ``matched_size``: on a free, the size of the allocation it ends.

    Rows have pid, addr, is_alloc, size. A free ends the latest allocation of its
    (pid, address) when nothing ended that one before; otherwise the value is null.
    """
    looked = previous(events, ["pid", "addr"], order_columns(),
                      {"_was_alloc": F.col("is_alloc"), "_size": F.col("size")}, max_rows, counted)
    matched = F.when(~F.col("is_alloc") & F.col("_was_alloc"), F.col("_size"))
    return looked.withColumn("matched_size", matched).drop("_was_alloc", "_size")


def live_allocations(events: DataFrame) -> DataFrame:
    """Allocations whose address nothing freed or reused later: the last row of the address
    when that row is an allocation. One row per (pid, addr)."""
    last = F.max_by(F.struct("is_alloc", "size", "t", "ret") if "ret" in events.columns
                    else F.struct("is_alloc", "size", "t"), F.struct(*ORDER))
    return (
        events.groupBy("pid", "addr").agg(last.alias("last"))
        .filter("last.is_alloc").select("pid", "addr", "last.*").drop("is_alloc")
    )
