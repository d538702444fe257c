"""Training traces: calls, variable states, and what happens inside a call.

Function records have process_id, thread_id, call_id, function, type, time (a long) and
what the run added (obj_id, step, stage, args). Calls are pre records with their end.
Variable records have process_id, var_name, var_type, attr, value, time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.ordered import framed, islands, large, numbered, previous, running
from tallyforge.ranges import KindSets, contained_points, kind_sets_within, kinds_within, overlap_join

# Record types, and name parts of functions that are never analysed as parents.
PRE = "function_call (pre)"
POST = "function_call (post)"
POST_EXCEPTION = "function_call (post) (exception)"
SKIPPED_FUNCTIONS = [
    "cuda.is_available",
    "torch.get_default_dtype",
    "torch._VariableFunctionsClass",
    "torch.nn.modules.module.Module._call_impl",
    "torch.nn.modules.module.Module._wrapped_impl",
    "torch.nn.modules.module.Module._wrapped_call_impl",
    "torch.cuda._is_compiled",
    "torch.is_grad_enabled",
    "torch._ops.OpOverload",
    "torch.nn.modules.module.Module",
    "torch.utils.data._utils",
    "torch.distributed.utils._to_kwargs",
    "torch.distributed.utils._recursive_to",
    "torch.nn.parallel.scatter_gather._is_namedtuple",
    "torch.nn._reduction",
    "torch.nn.functional",
    "torch._tensor.Tensor.backward",
    "torch.autograd",
    "torch.optim.optimizer.Optimizer._optimizer_step_code",
    "torch.optim.optimizer._get_value",
    "torch.overrides",
    "._",
]
PRIVATE = "._"
KERNEL_TAG = "[eBPF]"
OVERLAP_SHARE = 0.01
TRAILING_SLACK_US = 1000
THREAD = ["process_id", "thread_id"]
VARIABLE = ["process_id", "var_name", "var_type", "attr"]


# --- lookups (I1, I2, I4) ------------------------------------------------------------

def bounds(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time of the trace, or of each process or thread."""
    return records.groupBy(*keys).agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"))


def distinct_values(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stages, functions, call ids, processes or threads of a trace."""
    return records.select(*columns).where(F.col(columns[-1]).isNotNull()).distinct()


def of_stage(records: DataFrame, stage: str) -> DataFrame:
    """The part of a trace in one stage."""
    return records.filter(F.col("stage") == stage)


def bound_methods(pre_records: DataFrame) -> DataFrame:
    """Is every call of a function made on an object?"""
    return pre_records.groupBy("function").agg(F.bool_and(F.col("obj_id").isNotNull()).alias("is_bound"))


# --- calls (J5, I3) ------------------------------------------------------------------

def calls(records: DataFrame) -> DataFrame:
    """Pre records with their post record, one row per call.

    ``outcome`` is ok, exception or incomplete; an incomplete call ends with its thread.
    """
    post = records.filter(F.col("type").isin(POST, POST_EXCEPTION)).select(
        "call_id", F.col("type").alias("post_type"), F.col("time").alias("post_time"))
    ends = records.groupBy(*THREAD).agg(F.max("time").alias("thread_end"))
    return (
        records.filter(F.col("type") == PRE).join(post, "call_id", "left").join(ends, THREAD)
        .withColumns({
            "start": F.col("time"), "end": F.coalesce("post_time", "thread_end"),
            "outcome": F.when(F.col("post_type").isNull(), "incomplete")
            .when(F.col("post_type") == POST_EXCEPTION, "exception").otherwise("ok"),
        }).drop("type", "time", "post_type", "post_time", "thread_end")
    )


def without_trailing(records: DataFrame, slack_us: int = TRAILING_SLACK_US) -> DataFrame:
    """Drop calls left incomplete at the end of a trace.

    The outermost call of a process is the one that starts first; it stays. Another
    incomplete call is dropped when it runs on another thread and started no earlier than
    ``slack_us`` before the outermost call ended; otherwise it stays and ``broken`` marks it.
    """
    pre = records.filter(F.col("type") == PRE)
    per_call = records.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"))
    outer = pre.groupBy("process_id").agg(F.min_by(F.struct("call_id", "thread_id"), F.struct("time", "call_id")).alias("_o"))
    outer = outer.select("process_id", F.col("_o.call_id").alias("_outer"), F.col("_o.thread_id").alias("_outer_thread"))
    ended = records.filter(F.col("type").isin(POST, POST_EXCEPTION)).select(F.col("call_id").alias("_outer"), F.col("time").alias("_outer_end"))
    outer = outer.join(ended, "_outer", "left")
    judged = (
        pre.select("call_id", "process_id", "thread_id", "time").join(per_call, "call_id").filter(F.col("_n") == 1)
        .join(outer, "process_id").filter(F.col("call_id") != F.col("_outer"))
        .withColumn("_drop", (F.col("thread_id") != F.col("_outer_thread")) & (F.col("time") >= F.col("_outer_end") - slack_us))
    ).select("call_id", F.coalesce("_drop", F.lit(False)).alias("_drop"))
    kept = records.join(judged, "call_id", "left").filter(~F.coalesce("_drop", F.lit(False)))
    return kept.withColumn("broken", F.col("_drop").isNotNull()).drop("_drop")


def longest_runs(pre_records: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Most calls of a function in a row on one thread."""
    order = [F.col("time"), F.col("call_id")]
    runs = islands(pre_records, THREAD, order, F.col("_was").isNull() | (F.col("_was") != F.col("function")),
                   {"_was": F.col("function")}, max_rows=max_rows)
    lengths = runs.groupBy(*THREAD, "island", "function").agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy("function").agg(F.max("_n").alias("longest_run"))


def function_pool(pre_records: DataFrame, limit: int, max_rows: int | None = None) -> DataFrame:
    """Functions that are not private and never run over ``limit`` times in a row (P5)."""
    runs = longest_runs(pre_records, max_rows)
    return runs.filter(~F.col("function").contains(PRIVATE) & (F.col("longest_run") <= limit)).select("function")


def kernel_functions(records: DataFrame) -> DataFrame:
    """Records of functions traced in the kernel."""
    return records.filter(F.col("function").contains(KERNEL_TAG))


def analysable(records: DataFrame, skipped: Sequence[str] = SKIPPED_FUNCTIONS) -> DataFrame:
    """Records whose function name holds none of the skipped parts (P7). One pattern for all parts, so that a name is made once."""
    if not skipped:
        return records
    return records.filter(~F.col("function").rlike("|".join(re.escape(part) for part in skipped)))


def same_level_pairs(calls_: DataFrame) -> DataFrame:
    """Ordered pairs of functions of which two calls on one thread do not overlap.

    Two such calls exist exactly when one function's last start is after the other's first
    end, so a thread needs one row per function.
    """
    return level_pairs(function_edges(calls_))


def function_edges(calls_: DataFrame) -> DataFrame:
    """Last start and first end of each function on each thread."""
    return calls_.groupBy(*THREAD, "function").agg(F.max("start").alias("last_start"), F.min("end").alias("first_end"))


def level_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of functions of a thread that are not always nested, from their edges."""
    a, b = (edges.select(*THREAD, F.col("function").alias(f"function_{n}"), F.col("last_start").alias(f"s_{n}"),
                         F.col("first_end").alias(f"e_{n}")) for n in ("a", "b"))
    apart = (F.col("s_a") > F.col("e_b")) | (F.col("s_b") > F.col("e_a"))
    return a.join(b, THREAD).filter((F.col("function_a") != F.col("function_b")) & apart).select(
        *THREAD, "function_a", "function_b")


def events_in_calls(calls_: DataFrame) -> DataFrame:
    """Calls that start inside another call of their thread, with the call around them."""
    around = calls_.select(*THREAD, F.col("call_id").alias("parent_id"), F.col("function").alias("parent"), "start", "end")
    inner = calls_.select(*THREAD, "call_id", "function", F.col("start").alias("at"), F.col("end").alias("until"))
    held = contained_points(around, inner, THREAD, "start", "end", "at")
    return held.filter((F.col("call_id") != F.col("parent_id")) & (F.col("until") <= F.col("end"))).select(
        *THREAD, "parent_id", "parent", "call_id", "function", "at")


def changes_in_calls(calls_: DataFrame, changes: DataFrame, kinds: Sequence[str] | None = None,
                     on: Sequence[str] = ("process_id",), max_rows: int | None = None, sets: bool = False) -> DataFrame | KindSets:
    """Variable changes during a call of the same process, on whatever thread.

    With ``kinds`` a call comes once with each kind of change in it, in place of once with each change; with ``sets`` these
    kinds come 64 a row. ``on`` may name more columns in which the call and the change agree.
    """
    around = calls_.select(*on, F.col("call_id").alias("parent_id"), F.col("function").alias("parent"), "start", "end")
    if kinds is not None:
        if sets:
            held = kind_sets_within(around, changes, on, kinds, "start", "end", "time", max_rows)
            return KindSets(held.rows.drop("start", "end"), held.kinds)
        return kinds_within(around, changes, on, kinds, "start", "end", "time", max_rows).drop("start", "end")
    inner = changes.select(*dict.fromkeys([*on, "process_id", "var_name", "var_type", "attr"]), "old_value", "new_value", F.col("time").alias("at"))
    return contained_points(around, inner, on, "start", "end", "at").drop("start", "end")


# --- variables -----------------------------------------------------------------------

def states(variables: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Value of each attribute over time: equal values in a row are one state.

    A state ends where the next begins; the last one ends with its process.
    """
    order = [F.col("time"), F.col("seq")]
    counted = large(variables, VARIABLE, max_rows)  # the states' first rows are a part of these rows
    first = previous(variables, VARIABLE, order, {"_was": F.col("value"), "_at": F.col("time")}, max_rows, counted)
    starts = first.filter(F.col("_at").isNull() | ~F.col("_was").eqNullSafe(F.col("value")))
    starts = starts.drop("_was", "_at")

    def add(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("_next", F.lead("time").over(window))

    ends = variables.groupBy("process_id").agg(F.max("time").alias("_last"))
    following = framed(starts, VARIABLE, order, add, before=0, after=1, max_rows=max_rows, counted=counted).join(ends, "process_id")
    return following.withColumn("start", F.col("time")).withColumn("end", F.coalesce("_next", "_last")).drop(
        "time", "_next", "_last")


def changes(states_: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row per change of an attribute from one state to the next."""
    order = [F.col("start"), F.col("seq")]
    looked = previous(states_, VARIABLE, order, {"old_value": F.col("value"), "_from": F.col("start")}, max_rows)
    return looked.filter(F.col("_from").isNotNull()).select(
        *VARIABLE, F.col("start").alias("time"), "seq", "old_value", F.col("value").alias("new_value"))


def overlapping_states(left: DataFrame, right: DataFrame, on: Sequence[str], share: float = OVERLAP_SHARE) -> DataFrame:
    """Pairs of states that live together for over ``share`` of their union.

    Sides have left_/right_ prefixes on all columns but ``on``. Only pairs that meet are formed.
    """
    pairs = overlap_join(left, right, on, ("left_start", "left_end"), ("right_start", "right_end"))
    both = F.least("left_end", "right_end") - F.greatest("left_start", "right_start")
    union = F.greatest("left_end", "right_end") - F.least("left_start", "right_start")
    return pairs.filter((both > 0) & (both / union > share))


def sided(rows: DataFrame, side: str, on: Sequence[str]) -> DataFrame:
    return rows.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in on])


def raw_before(variables: DataFrame, moments: DataFrame) -> DataFrame:
    """Records of a variable before a moment asked for (I6). Moments: process_id, var_name,
    var_type, moment."""
    keys = ["process_id", "var_name", "var_type"]
    return variables.join(moments, keys).filter(F.col("time") < F.col("moment"))


def related_variables(calls_: DataFrame, accesses: DataFrame) -> DataFrame:
    """Variables that the object of a call touches in any of its methods.

    ``accesses`` has process_id, obj_id, var_name, var_type.
    """
    touched = accesses.select("process_id", "obj_id", "var_name", "var_type").distinct()
    return calls_.filter(F.col("obj_id").isNotNull()).select("process_id", "call_id", "obj_id").join(
        touched, ["process_id", "obj_id"])


def unchanged_related(related: DataFrame, changed: DataFrame) -> DataFrame:
    """Related variables of a call that did not change within it."""
    hit = changed.select(F.col("parent_id").alias("call_id"), "process_id", "var_name", "var_type").distinct()
    return related.join(hit, ["call_id", "process_id", "var_name", "var_type"], "left_anti")


def with_active_values(records: DataFrame, settings: DataFrame, names: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Records with the latest earlier setting of each name on their thread.

    ``settings`` has process_id, thread_id, time, seq and one column per name; a setting at
    the time of a record counts.
    """
    base = records.withColumns({**{f"_set_{n}": F.lit(None).cast(dict(settings.dtypes)[n]) for n in names}, "_kind": F.lit(1)})
    added = settings.select(*THREAD, "time", "seq", *[F.col(n).alias(f"_set_{n}") for n in names]).withColumn("_kind", F.lit(0))
    mixed = base.unionByName(added, allowMissingColumns=True)
    order = [F.col("time"), F.col("_kind"), F.col("seq")]
    filled = running(mixed, THREAD, order, {n: ("last", F.col(f"_set_{n}")) for n in names}, max_rows)
    return filled.filter(F.col("_kind") == 1).drop("_kind", *[f"_set_{n}" for n in names])


def active_contexts(records: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context managers open at the time of a record on its thread.

    ``contexts`` has process_id, thread_id, context, start, end.
    """
    at = records.select(*THREAD, "call_id", F.col("time").alias("at"))
    return contained_points(contexts, at, THREAD, "start", "end", "at").select(*THREAD, "call_id", "at", "context")


def time_share(time: Column, start: Column, end: Column) -> Column:
    """Where in the trace a moment lies, from 0 to 1."""
    return (time - start) / F.nullif(end - start, F.lit(0))


def renamed_copies(records: DataFrame, function: str, new_name: str) -> DataFrame:
    """The records with copies of one function under another name and new call ids."""
    copies = records.filter(F.col("function") == function).withColumns({
        "function": F.lit(new_name), "call_id": F.concat(F.lit("copy_"), F.col("call_id"))})
    return records.unionByName(copies)


def positions(pre_records: DataFrame, max_rows: int | None = None, backwards: bool = False) -> DataFrame:
    """Calls of a thread numbered by time from 1, or from its end."""
    order = [F.col("time"), F.col("call_id")]
    return numbered(pre_records, THREAD, [c.desc() for c in order] if backwards else order, "pos", max_rows)
