"""Relations that good runs keep: counts of examples for and against each.

Each relation gives hypotheses with ``positives`` and ``negatives``. Its examples table
has hypothesis, polarity (1 or 0), example, record; a record is a row of the trace.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import trace as tr
from tallyforge.ordered import MAX_ROWS, following, hot_keys, previous
from tallyforge.ranges import KindSets
from tallyforge.session import cut_lineage

# Limits of the relations.
ORDER_RUN_LIMIT = 4
DISTINCT_RUN_LIMIT = 6
IOU_LIMIT = 0.1
PERIODIC_COUNT = 5
THRESHOLD_REACH = 0.2
MERGE_RATIO = 1.3
FLOAT_TOLERANCE = 1e-8
SALTS = 64
# Calls of a thread that meet all their pairs in one task, and pairs that each task holds.
DEALT_CALLS = 100_000
DEALT_PAIRS = 10_000


def likelihood(positives: Column, negatives: Column) -> Column:
    """Sigmoid of a tenth of the surplus of positives."""
    return 1.0 / (1.0 + F.exp(-0.1 * (positives - negatives)))


# --- order: cover and lead (I14, I15, I16) -------------------------------------------

def partner_met(calls: DataFrame, pairs: DataFrame, follows: bool, max_rows: int | None = None) -> DataFrame:
    """Each call of a pair's subject with ``met``: a call of the other comes between it and the subject's next call
    (``follows``), or its last one.

    ``pairs`` has subject and other, and the thread's columns where it holds for one thread. In the calls of both
    functions, in order, the other must be the very next: one sort of (thread, pair), and no call walks a list of functions.
    """
    order = [F.col("start"), F.col("call_id")]
    on = [c for c in tr.THREAD if c in pairs.columns]
    names = [*tr.THREAD, "subject", "other"]
    rows = calls.select(*tr.THREAD, "function", "start", "call_id")
    many = hot_keys(rows, tr.THREAD, min(max_rows or MAX_ROWS, DEALT_CALLS))
    if many is None and not on and pairs.count() <= DEALT_PAIRS:
        return _met_in_threads(rows, pairs, follows)

    def side(name: str, is_other: bool) -> DataFrame:
        return rows.withColumnRenamed("function", name).join(pairs, [*on, name]).select(
            *names, "start", "call_id", F.lit(is_other).alias("_other"))

    merged = side("subject", False).unionByName(side("other", True))
    if many is None or many.filter(F.col("_rows") > (max_rows or MAX_ROWS)).isEmpty():  # no thread is large, so none of its pairs is
        beside = F.lead if follows else F.lag
        looked = merged.withColumn("_met", beside("_other").over(Window.partitionBy(*names).orderBy(*order)))
    else:
        looked = (following if follows else previous)(merged, names, order, {"_met": F.col("_other")}, max_rows)
    return looked.filter(~F.col("_other")).select(*names, "call_id", "start", F.coalesce("_met", F.lit(False)).alias("met"))


def _met_in_threads(rows: DataFrame, pairs: DataFrame, follows: bool) -> DataFrame:
    """``partner_met`` where threads are of ordinary size and the pairs few: a thread's calls are dealt to one task and
    meet their pairs there, so that no call is shuffled once a pair, and numbers are sorted in place of names."""
    # of a fixed number, as a partition grows by the pairs of each call only behind the shuffle
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = F.array(F.struct(F.col("subject").alias("function"), F.lit(False).alias("_other")),
                   F.struct(F.col("other").alias("function"), F.lit(True).alias("_other")))
    sides = pairs.select(F.monotonically_increasing_id().alias("_pair"), "subject", "other").select("*", F.inline(ends))
    met = rows.repartition(shuffle, *tr.THREAD).join(F.broadcast(sides), "function")
    window = Window.partitionBy("thread_id", "process_id", "_pair").orderBy("start", "call_id")
    looked = met.withColumn("_met", (F.lead if follows else F.lag)("_other").over(window))
    return looked.filter(~F.col("_other")).select(
        *tr.THREAD, "subject", "other", "call_id", "start", F.coalesce("_met", F.lit(False)).alias("met"))


def _beside(calls: DataFrame, follows: bool) -> DataFrame:
    """Per thread, each subject with the functions on its level, for cover or lead."""
    # One row per thread and function; written once, as the pairs are used several times.
    level = tr.level_pairs(cut_lineage(tr.function_edges(calls)))
    subject, other = ("function_a", "function_b") if follows else ("function_b", "function_a")
    return level.select(*tr.THREAD, F.col(subject).alias("subject"), F.col(other).alias("other")).distinct()


def _pooled(calls: DataFrame, pool: DataFrame | None) -> DataFrame:
    return calls if pool is None else calls.join(pool, "function", "left_semi")


def same_level(calls: DataFrame, follows: bool, pool: DataFrame | None = None) -> DataFrame:
    """Pairs (subject, other) of functions that some thread calls on one level: what cover and lead are proposed for."""
    return _beside(_pooled(calls, pool), follows).select("subject", "other").distinct()


def order_counts(calls: DataFrame, follows: bool, pool: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Positives and negatives of ordered pairs (I14: cover, I15: lead).

    Cover (``follows`` false): each B has an A since the last B. Lead: each A has a B
    before the next A. ``subject`` is B for cover and A for lead, ``other`` the partner.
    A thread that never calls the partner beside the subject counts all its subjects
    against the pair; a thread where the subject is beside nothing does not count.
    """
    pooled = _pooled(calls, pool)
    beside = cut_lineage(_beside(pooled, follows))
    pairs = beside.select("subject", "other").distinct()
    counted = calls.groupBy(*tr.THREAD, F.col("function").alias("subject")).agg(F.count(F.lit(1)).alias("_calls"))
    matched = partner_met(pooled, beside, follows, max_rows).groupBy(*tr.THREAD, "subject", "other").agg(
        F.count_if("met").alias("_matched"))
    subjects = beside.select(*tr.THREAD, "subject").distinct().join(counted, [*tr.THREAD, "subject"])
    per_thread = subjects.join(pairs, "subject").join(matched, [*tr.THREAD, "subject", "other"], "left")
    hit = F.coalesce("_matched", F.lit(0))
    return per_thread.groupBy("subject", "other").agg(
        F.sum(hit).alias("positives"), F.sum(F.col("_calls") - hit).alias("negatives"))


def order_examples(calls: DataFrame, follows: bool, pool: DataFrame | None = None, keep: int = 5000, seed: int = 42,
                   max_rows: int | None = None) -> DataFrame:
    """Subject calls for and against each pair, at most ``keep`` of each by seeded order."""
    calls = _pooled(calls, pool)
    beside = cut_lineage(_beside(calls, follows))
    pairs = beside.select("subject", "other").distinct()
    subjects = beside.select(*tr.THREAD, "subject").distinct()
    met = partner_met(calls, beside, follows, max_rows).select("subject", "other", F.col("met").cast("int").alias("polarity"), "call_id")
    apart = subjects.join(pairs, "subject").join(beside, [*tr.THREAD, "subject", "other"], "left_anti")
    never = calls.withColumnRenamed("function", "subject").join(apart, [*tr.THREAD, "subject"]).select(
        "subject", "other", F.lit(0).alias("polarity"), "call_id")
    return capped(met.unionByName(never), ["subject", "other"], "call_id", keep, seed)


def capped(examples: DataFrame, keys: Sequence[str], example: str, keep: int = 5000, seed: int = 42) -> DataFrame:
    """At most ``keep`` examples per hypothesis and polarity, by a seeded hash.

    Ranked in ``SALTS`` shares first, so no task sorts all examples of a hypothesis.
    """
    draw = F.xxhash64(F.lit(seed), F.col(example))
    drawn = examples.withColumns({"_draw": draw, "_salt": F.pmod(F.xxhash64(F.col(example)), F.lit(SALTS))})
    for share in (["_salt"], []):
        order = Window.partitionBy(*keys, "polarity", *share).orderBy("_draw", example)
        drawn = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep).drop("_rn")
    return drawn.drop("_draw", "_salt")


def contracted(edges: DataFrame) -> DataFrame:
    """(function, node): functions that lead each other, also over others, share a node that is named by all of them.

    Only functions with rules into and out of them can be on a cycle; what these reach doubles its way each round.
    """
    reach = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    reach, size = cut_lineage(reach.select("a", "b")), -1
    while (now := reach.count()) != size:
        size = now
        further = reach.select("a", F.col("b").alias("via")).join(reach.select(F.col("a").alias("via"), "b"), "via")
        reach = cut_lineage(reach.unionByName(further.select("a", "b")).distinct())
    both = reach.join(reach.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    cycles = both.groupBy(F.col("a").alias("function")).agg(F.array_join(F.sort_array(F.collect_set("b")), "|").alias("node"))
    functions = edges.select(F.col("a").alias("function")).unionByName(edges.select(F.col("b").alias("function"))).distinct()
    return functions.join(cycles, "function", "left").withColumn("node", F.coalesce("node", "function"))


def merged_chains(pairs: DataFrame) -> DataFrame:
    """Chains A, B, C, ... in which each earlier function is paired with each later one.

    A chain starts where nothing leads in and is kept where nothing leads on. Functions on a cycle have no first one:
    they stand in the chain as one node, their names joined by ``|``, which is paired with what any of them is paired
    with. Pairs are per precondition; each round lengthens the chains by one node.
    """
    rules = cut_lineage(pairs.select("a", "b").distinct())
    named = cut_lineage(contracted(rules))
    edges = rules.join(named.select(F.col("function").alias("a"), F.col("node").alias("_a")), "a").join(
        named.select(F.col("function").alias("b"), F.col("node").alias("_b")), "b")
    edges = cut_lineage(edges.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    into = edges.groupBy(F.col("b").alias("_node")).agg(F.collect_set("a").alias("_into"))
    nodes = named.select("node").distinct()
    sources = nodes.join(edges.select(F.col("b").alias("node")), "node", "left_anti")
    sinks = nodes.select(F.col("node").alias("last")).join(edges.select(F.col("a").alias("last")), "last", "left_anti")
    paths = cut_lineage(sources.select(F.array("node").alias("path"), F.col("node").alias("last")))
    found = paths.join(sinks, "last", "left_semi")
    while not paths.isEmpty():
        grown = (
            paths.join(edges, paths["last"] == edges["a"]).join(into, F.col("b") == F.col("_node"))
            .filter(~F.array_contains("path", F.col("b")) & (F.size(F.array_except("path", "_into")) == 0))
            .select(F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("last"))
        )
        paths = cut_lineage(grown)
        found = found.unionByName(paths.join(sinks, "last", "left_semi"))
    return found.select("path")


# --- containment (I7, I8, I9) --------------------------------------------------------

def sampled_calls(calls: DataFrame, above: int = 1000, ends: int = 10, between: int = 100, seed: int = 42) -> DataFrame:
    """Of a function called over ``above`` times: its first and last calls and a seeded part
    of the others (I8)."""
    total = calls.groupBy("function").agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col("start"), F.col("call_id")]
    early = Window.partitionBy("function").orderBy(*order)
    late = Window.partitionBy("function").orderBy(*[c.desc() for c in order])
    mixed = Window.partitionBy("function").orderBy(F.xxhash64(F.lit(seed), F.col("call_id")), F.col("call_id"))
    few = calls.join(total.filter(F.col("_n") <= above), "function", "left_semi")
    many = calls.join(total.filter(F.col("_n") > above), "function", "left_semi")

    def first(window, n: int, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")

    edge = first(early, ends, many).unionByName(first(late, ends, many))
    inner = many.join(edge.select("call_id"), "call_id", "left_anti")
    return few.unionByName(edge).unionByName(first(mixed, between, inner))


def containment_counts(calls: DataFrame, held: DataFrame, child: Sequence[str]) -> DataFrame:
    """Calls of a parent that hold the child event, and calls that do not.

    ``held`` has parent_id, parent and the ``child`` columns that describe an event.
    """
    has = held.select("parent", "parent_id", *child).distinct().groupBy("parent", *child).agg(F.count(F.lit(1)).alias("positives"))
    total = calls.groupBy(F.col("function").alias("parent")).agg(F.count(F.lit(1)).alias("_n"))
    return has.join(total, "parent").withColumn("negatives", F.col("_n") - F.col("positives")).drop("_n")


@dataclass(frozen=True)
class ExampleSets:
    """The examples of ``containment_examples``, 64 kinds a row: the bits set are the kinds that a call is for, all other
    kinds of its parent it is against.

    ``rows``: parent, call_id, ``_word``, ``_bits`` and ``_calls``, the calls of that id. ``kinds``: the child columns with
    ``_word`` and ``_bits``. ``parents``: parent with its calls and their ids, where no id is one.
    """

    rows: DataFrame
    kinds: DataFrame
    parents: DataFrame


def containment_examples(calls: DataFrame, held: DataFrame | KindSets, child: Sequence[str]) -> DataFrame | ExampleSets:
    """Parent calls for and against each containment; the ones against by anti join (I7). Sets of kinds give sets of examples."""
    if isinstance(held, KindSets):
        return _example_sets(calls, held)
    has = held.select("parent", *child, F.col("parent_id").alias("call_id")).distinct()
    kinds = has.select("parent", *child).distinct()
    every = kinds.join(calls.select(F.col("function").alias("parent"), "call_id"), "parent")
    against = every.join(has, ["parent", *child, "call_id"], "left_anti")
    return has.withColumn("polarity", F.lit(1)).unionByName(against.withColumn("polarity", F.lit(0)))


def _example_sets(calls: DataFrame, held: KindSets) -> ExampleSets:
    has = held.rows.filter(F.col("parent").isNotNull()).groupBy("parent", F.col("parent_id").alias("call_id"), "_word").agg(
        F.bit_or("_bits").alias("_bits"))
    ids = calls.filter(F.col("function").isNotNull()).groupBy(F.col("function").alias("parent"), "call_id").agg(
        F.count(F.lit(1)).alias("_calls"))
    parents = ids.groupBy("parent").agg(
        F.sum("_calls").alias("_all"), F.count(F.lit(1)).alias("_ids"))
    return ExampleSets(has.join(ids, ["parent", "call_id"], "left"), held.kinds, parents)


def merged_containment(examples: DataFrame | ExampleSets, keys: Sequence[str], value: str, ratio: float = MERGE_RATIO) -> DataFrame:
    """One general rule in place of rules that differ only in ``value``.

    The rules of a key are merged when the likelihood of the union, in which a call for any
    of them is not against it (U6), is at least ``ratio`` times their mean likelihood.
    Gives the merged counts and the mean, with ``merged`` true where merging pays. ``keys`` of example sets begin with parent.
    """
    if isinstance(examples, ExampleSets):
        per_value, union = _counts_of_sets(examples, keys, value)
    else:
        per_value = examples.groupBy(*keys, value).agg(
            F.sum("polarity").alias("_p"), F.sum(1 - F.col("polarity")).alias("_n"))
        per_call = examples.groupBy(*keys, "call_id").agg(F.max("polarity").alias("polarity"))
        union = per_call.groupBy(*keys).agg(
            F.sum("polarity").alias("positives"), F.sum(1 - F.col("polarity")).alias("negatives"))
    mean = per_value.groupBy(*keys).agg(
        F.avg(likelihood(F.col("_p"), F.col("_n"))).alias("mean_likelihood"), F.count(F.lit(1)).alias("rules"))
    joined = union.join(mean, list(keys)).withColumn("likelihood", likelihood(F.col("positives"), F.col("negatives")))
    return joined.withColumn("merged", (F.col("rules") > 1) & (F.col("likelihood") / F.col("mean_likelihood") >= ratio))


def _counts_of_sets(examples: ExampleSets, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Examples for and against each rule and each union of rules, from sets. A call without an id counts against each rule,
    and each call does where the value is null, as null equals nothing in the anti join."""
    of = list(keys)[1:]
    known = F.coalesce("_calls", F.lit(0))
    alike = examples.rows.groupBy("parent", "_word", "_bits").agg(F.count(F.lit(1)).alias("_p"), F.sum(known).alias("_for"))
    kinds = examples.kinds.select(*of, value, "_word", F.col("_bits").alias("_mask")).dropna(subset=of)
    has = F.col("_bits").bitwiseAND(F.col("_mask")) != 0
    counted = alike.join(F.broadcast(kinds), "_word").filter(has).groupBy("parent", *of, value).agg(
        F.sum("_p").alias("_p"), F.sum("_for").alias("_for"))
    per_value = counted.join(examples.parents, "parent").select(
        "parent", *of, value, "_p", (F.col("_all") - F.when(F.col(value).isNull(), 0).otherwise(F.col("_for"))).alias("_n"))
    masks = kinds.groupBy(*of, "_word").agg(F.bit_or("_mask").alias("_mask"))
    calls = examples.rows.join(F.broadcast(masks), "_word").filter(has).groupBy("parent", *of, "call_id").agg(
        F.max(known).alias("_calls"))
    met = calls.groupBy("parent", *of).agg(
        F.count(F.lit(1)).alias("positives"),
        F.count_if((F.col("_calls") > 0) | F.col("call_id").isNull()).alias("_met"))
    union = met.join(examples.parents, "parent").select("parent", *of, "positives", (F.col("_ids") - F.col("_met")).alias("negatives"))
    return per_value, union


def symbolic(values: Column, has_none: Column, distinct: Column) -> Column:
    """Tag that covers a set of numbers, given as (min, max, has zero)."""
    low, high, zero = values["low"], values["high"], values["zero"]
    return (
        F.when(distinct == 1, F.lit(None).cast("string"))
        .when(low > 0, "above_zero").when(low >= 0, "non_negative").when(high < 0, "below_zero")
        .when(high <= 0, "non_positive").when(~zero, "non_zero").when(~has_none, "non_none").otherwise("anything")
    )


def generalised(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Tag and range of the numeric values of each key; no tag where there is one value."""
    x = F.col(value)
    agg = rows.groupBy(*keys).agg(
        F.struct(F.min(x).alias("low"), F.max(x).alias("high"), F.coalesce(F.bool_or(x == 0), F.lit(False)).alias("zero")).alias("_v"),
        F.bool_or(x.isNull()).alias("_none"),
        (F.count_distinct(x) + F.max(x.isNull().cast("int"))).alias("distinct_values"))
    return agg.withColumn("tag", symbolic(F.col("_v"), F.col("_none"), F.col("distinct_values"))).select(
        *keys, F.col("_v.low").alias("low"), F.col("_v.high").alias("high"), "distinct_values", "tag")


def matches_symbol(tag: Column, value: Column) -> Column:
    """Does a value (null for none) fall under a tag?"""
    none = value.isNull()
    return (
        F.when(tag == "above_zero", ~none & (value > 0)).when(tag == "below_zero", ~none & (value < 0))
        .when(tag == "non_positive", none | (value <= 0)).when(tag == "non_negative", none | (value >= 0))
        .when(tag == "non_zero", ~none & (value != 0)).when(tag == "non_none", ~none)
        .when(tag == "anything", F.lit(True)).otherwise(F.lit(None).cast("boolean"))
    )


# --- values --------------------------------------------------------------------------

def close(a: Column, b: Column, tolerance: float = FLOAT_TOLERANCE) -> Column:
    """Equality of numbers up to the tolerance."""
    return F.abs(a - b) < tolerance


def arrays_close(a: Column, b: Column, tolerance: float = FLOAT_TOLERANCE) -> Column:
    """Equality of number arrays up to the tolerance."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) < tolerance, x.isNull() & y.isNull()))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda v: v)


def consistency_counts(states: DataFrame, on: Sequence[str] = ("var_type",), share: float = tr.OVERLAP_SHARE,
                       least: int = 2) -> DataFrame:
    """Live pairs of attributes of two variables with equal and with different values.

    Pairs of variables agree on ``on``. A hypothesis is a pair of attributes; it needs
    ``least`` equal pairs. The same attribute of two variables counts once.
    """
    pairs = consistency_pairs(states, on, share)
    counts = pairs.groupBy(*on, F.col("left_attr").alias("attr_a"), F.col("right_attr").alias("attr_b")).agg(
        F.sum("polarity").alias("positives"), F.sum(1 - F.col("polarity")).alias("negatives"))
    return counts.filter(F.col("positives") >= least)


def consistency_pairs(states: DataFrame, on: Sequence[str] = ("var_type",), share: float = tr.OVERLAP_SHARE) -> DataFrame:
    """The live pairs themselves, with polarity 1 where the values agree."""
    rows = states.select(*on, *[c for c in ("process_id", "var_name", "attr", "value", "start", "end") if c not in on])
    left, right = tr.sided(rows, "left", on), tr.sided(rows, "right", on)
    met = tr.overlapping_states(left, right, on, share)
    a, b = (F.struct(f"{s}_attr", f"{s}_var_name", f"{s}_process_id") for s in ("left", "right"))
    other = ~((F.col("left_var_name") == F.col("right_var_name")) & (F.col("left_process_id") == F.col("right_process_id")))
    return met.filter(other & (a < b)).withColumn(
        "polarity", F.col("left_value").eqNullSafe(F.col("right_value")).cast("int"))


def output_counts(outputs: DataFrame) -> DataFrame:
    """How often a returned property of a function has one value, and another.

    ``outputs`` has function, call_id, prop, value, one row per property of each output.
    """
    per = outputs.groupBy("function", "prop", "value").agg(F.count(F.lit(1)).alias("positives"))
    total = outputs.groupBy("function", "prop").agg(F.count(F.lit(1)).alias("_n"))
    return per.join(total, ["function", "prop"]).withColumn("negatives", F.col("_n") - F.col("positives")).drop("_n")


def input_output_counts(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Calls where an input path and an output path hold the same value, and do not.

    Both sides have function, call_id, path, value, is_flag. Flags only pair with the same
    path. A pair of paths is a hypothesis when some call agrees on it.
    """
    left = inputs.select("function", "call_id", F.col("path").alias("input_path"), "value", "is_flag")
    right = outputs.select("call_id", F.col("path").alias("output_path"), "value")
    same = left.join(right, ["call_id", "value"]).filter(~F.col("is_flag") | (F.col("input_path") == F.col("output_path")))
    hits = same.groupBy("function", "input_path", "output_path").agg(F.count_distinct("call_id").alias("positives"))
    total = inputs.groupBy("function").agg(F.count_distinct("call_id").alias("_n"))
    return hits.join(total, "function").withColumn("negatives", F.col("_n") - F.col("positives")).drop("_n")


def shared_values(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Values found both in the inputs and the outputs of a call."""
    return inputs.select("call_id", "value").intersect(outputs.select("call_id", "value"))


def threshold_counts(arguments: DataFrame, outputs: DataFrame, reach: float = THRESHOLD_REACH) -> DataFrame:
    """Outputs held by an argument named min or max.

    ``arguments`` has function, call_id, arg, bound; ``outputs`` function, call_id, path,
    value. A pair becomes a hypothesis where some output is within ``reach`` of its bound.
    """
    sided = arguments.withColumn("side", F.explode(F.array_compact(F.array(
        F.when(F.contains(F.col("arg"), F.lit("min")), "min"), F.when(F.contains(F.col("arg"), F.lit("max")), "max")))))
    joined = sided.join(outputs, ["function", "call_id"])
    holds = F.when(F.col("side") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    gap = F.when(F.col("side") == "min", F.col("value") - F.col("bound")).otherwise(F.col("bound") - F.col("value"))
    near = holds & (gap / F.nullif(F.col("bound").cast("double"), F.lit(0.0)) <= reach)
    return joined.groupBy("function", "side", "arg", "path").agg(
        F.count_if(holds).alias("positives"), F.count_if(~holds).alias("negatives"),
        F.coalesce(F.bool_or(near), F.lit(False)).alias("_formed")).filter("_formed").drop("_formed")


def value_bucket(kind: Column, number: Column, text: Column, numbers: Column) -> Column:
    """Text under which a value is counted: seven decimals, or the absolute sum of a list."""
    total = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + F.abs(v))
    return (F.when(kind == "none", "None").when(kind == "number", F.format_string("%.7f", number))
            .when(kind == "list", F.format_string("%.7f", total)).otherwise(text))


def periodic_values(states: DataFrame, bucket: str = "value", over: int = PERIODIC_COUNT) -> DataFrame:
    """Values that a variable attribute takes more than ``over`` times."""
    return states.groupBy(*tr.VARIABLE, F.col(bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("times")).filter(F.col("times") > over)


# --- arguments (I17, U2, U4, J12) ----------------------------------------------------

def iou(a: Column, b: Column) -> Column:
    """Shared part of two lists taken as sets (U4)."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _pairs_of(count: str) -> Column:
    """Number of pairs among so many, in whole numbers: one of n and n - 1 is halved before they are multiplied."""
    n = F.col(count)
    return F.when(n % 2 == 0, F.expr(f"{count} div 2") * (n - 1)).otherwise(n * F.expr(f"({count} - 1) div 2"))


def distinct_argument_counts(calls: DataFrame) -> DataFrame:
    """Pairs of calls of a function in a step with different and with equal arguments.

    ``args`` is comparable (text, or a map sorted into text). Equal arguments are counted
    in groups, so no two calls are ever paired.
    """
    groups = calls.groupBy("function", "step", "args").agg(F.count(F.lit(1)).alias("_n"))
    steps = groups.groupBy("function", "step").agg(
        F.sum("_n").alias("_all"), F.sum(_pairs_of("_n")).alias("_same"))
    pairs = _pairs_of("_all")
    return steps.groupBy("function").agg(
        F.sum(pairs - F.col("_same")).alias("positives"), F.sum("_same").alias("negatives")).filter("positives > 0")


def list_argument_counts(calls: DataFrame, limit: float = IOU_LIMIT) -> DataFrame:
    """The same for arguments that are lists of integers, alike from ``limit`` IOU on.

    Distinct lists are counted first and only those that share an element are compared.
    Equal lists are alike unless empty, whose IOU is zero.
    """
    groups = calls.groupBy("function", "step", F.array_sort(F.array_distinct("args")).alias("items")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("id", F.col("items"))
    totals = groups.groupBy("function", "step").agg(F.sum("n").alias("_all"))
    same = groups.filter(F.size("items") > 0).groupBy("function", "step").agg(
        F.sum(_pairs_of("n")).alias("_same"))
    single = groups.select("function", "step", "id", "n", F.size("items").alias("size"), F.explode("items").alias("item"))
    a, b = (single.select("function", "step", "item", F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"),
                          F.col("size").alias(f"size_{s}")) for s in "ab")
    shared = a.join(b, ["function", "step", "item"]).filter(F.col("id_a") < F.col("id_b")).groupBy(
        "function", "step", "id_a", "id_b").agg(
        F.count(F.lit(1)).alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"),
        F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    alike = shared.filter(F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both")) >= limit).groupBy(
        "function", "step").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("_alike"))
    steps = totals.join(same, ["function", "step"], "left").join(alike, ["function", "step"], "left").fillna(0)
    negatives = F.col("_same") + F.col("_alike")
    pairs = _pairs_of("_all")
    return steps.groupBy("function").agg(
        F.sum(pairs - negatives).alias("positives"), F.sum(negatives).alias("negatives")).filter("positives > 0")


def common_arguments(arguments: DataFrame) -> DataFrame:
    """Arguments with the same value in all calls of a function.

    ``arguments`` has function, call_id, arg, value.
    """
    total = arguments.groupBy("function").agg(F.count_distinct("call_id").alias("_n"))
    per = arguments.groupBy("function", "arg", "value").agg(F.count_distinct("call_id").alias("calls"))
    return per.join(total, "function").filter(F.col("calls") == F.col("_n")).drop("_n")


def argument_violations(required: DataFrame, given: DataFrame) -> DataFrame:
    """Calls that lack a required argument or give another value.

    ``required`` has function, arg, value; ``given`` has function, call_id, arg, value.
    """
    calls = given.select("function", "call_id").distinct()
    wanted = calls.join(required, "function")
    have = given.select("call_id", "arg", F.col("value").alias("given"))
    return wanted.join(have, ["call_id", "arg"], "left").filter(
        F.col("given").isNull() | (F.col("given") != F.col("value")))


# --- registry ------------------------------------------------------------------------

RELATIONS: dict[str, Callable[..., DataFrame]] = {
    "contain": containment_counts,
    "consistency": consistency_counts,
    "consistent_output": output_counts,
    "consistent_input_output": input_output_counts,
    "threshold": threshold_counts,
    "cover": lambda calls, **options: order_counts(calls, follows=False, **options),
    "lead": lambda calls, **options: order_counts(calls, follows=True, **options),
    "kernel_cover": lambda calls, **options: order_counts(tr.kernel_functions(calls), follows=False, **options),
    "distinct_arguments": distinct_argument_counts,
}


def register_relation(name: str, function: Callable[..., DataFrame]) -> None:
    """Add a relation: a function from trace tables to counts."""
    RELATIONS[name] = function


def chosen_relations(enabled: Sequence[str] = (), disabled: Sequence[str] = ()) -> dict[str, Callable[..., DataFrame]]:
    """The registered relations, all or the enabled ones, without the disabled ones."""
    return {n: f for n, f in RELATIONS.items() if (not enabled or n in enabled) and n not in disabled}
