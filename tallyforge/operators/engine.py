"""One run over all relations: learn rules from several traces, check them on another.

A relation is a pair of functions. ``hypotheses`` proposes rules from a trace, each an array of text ``parts``. ``judge``
gives every example of given rules on a trace: parts, polarity (1 for, 0 against), example, time. Learning judges the
rules of all traces on every trace; checking judges the learned rules on a new one, where they may be broken in places
that would never propose them.

All relations share the tables of a ``Trace`` and one pass from examples to *patterns*: how often each set of field
values occurs for and against each rule. What follows reads patterns only, so no rule's examples meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import preconditions as pc
from tallyforge.operators import relations as rel
from tallyforge.operators import trace as tr
from tallyforge.session import cut_lineage

RULE = ["relation", "parts"]
#: A rule needs this many positives over all traces.
LEAST_POSITIVES = 2


@dataclass(frozen=True)
class Trace:
    """Tables of one trace. ``fields``: example and an array of (field, kind, value), one for each record that may be one."""

    calls: DataFrame
    outputs: DataFrame
    states: DataFrame
    fields: DataFrame
    pool: DataFrame | None = None


@dataclass(frozen=True)
class Relation:
    hypotheses: Callable[[Trace], DataFrame]
    judge: Callable[[Trace, DataFrame], DataFrame]


def _part(number: int) -> Column:
    return F.element_at("parts", number)


def _examples(parts: Sequence[str], polarity: Column, example: str, time: str) -> list[Column]:
    return [F.array(*parts).alias("parts"), polarity.cast("int").alias("polarity"), F.col(example).alias("example"), F.col(time).alias("time")]


# --- the relations -------------------------------------------------------------------

def _order(follows: bool) -> Relation:
    def hypotheses(trace: Trace) -> DataFrame:
        pairs = rel.same_level(trace.calls, follows, trace.pool)
        return pairs.select(F.array("subject", "other").alias("parts")).distinct()

    def judge(trace: Trace, rules: DataFrame) -> DataFrame:
        pairs = rules.select(_part(1).alias("subject"), _part(2).alias("other"))
        met = rel.partner_met(trace.calls, pairs, follows)
        return met.select(*_examples(["subject", "other"], F.col("met"), "call_id", "start"))

    return Relation(hypotheses, judge)


def _contain() -> Relation:
    def inside(trace: Trace) -> DataFrame:
        return tr.events_in_calls(trace.calls).select("parent", "parent_id", "function").distinct()

    def hypotheses(trace: Trace) -> DataFrame:
        return inside(trace).select(F.array("parent", "function").alias("parts")).distinct()

    def judge(trace: Trace, rules: DataFrame) -> DataFrame:
        wanted = rules.select(_part(1).alias("parent"), _part(2).alias("function"))
        asked = trace.calls.select(F.col("function").alias("parent"), F.col("call_id").alias("parent_id"), "start").join(wanted, "parent")
        has = inside(trace).withColumn("_has", F.lit(True))
        judged = asked.join(has, ["parent", "parent_id", "function"], "left")
        return judged.select(*_examples(["parent", "function"], F.coalesce("_has", F.lit(False)), "parent_id", "start"))

    return Relation(hypotheses, judge)


def _output(share: float = 0.5) -> Relation:
    """A returned property has the value that at least ``share`` of a trace's calls give it."""
    def hypotheses(trace: Trace) -> DataFrame:
        counts = rel.output_counts(trace.outputs.select("function", "prop", "value", "call_id"))
        often = counts.filter(F.col("positives") >= share * (F.col("positives") + F.col("negatives")))
        return often.select(F.array("function", "prop", "value").alias("parts"))

    def judge(trace: Trace, rules: DataFrame) -> DataFrame:
        wanted = rules.select(_part(1).alias("function"), _part(2).alias("prop"), _part(3).alias("wanted"))
        judged = trace.outputs.join(wanted, ["function", "prop"])
        return judged.select(*_examples(["function", "prop", "wanted"], F.col("value").eqNullSafe(F.col("wanted")), "call_id", "time"))

    return Relation(hypotheses, judge)


def _periodic(over: int = rel.PERIODIC_COUNT) -> Relation:
    """A variable's attribute comes back to a value more than ``over`` times (I18); each variable is one example."""
    def hypotheses(trace: Trace) -> DataFrame:
        return rel.periodic_values(trace.states, over=over).select(F.array("var_type", "attr", "bucket").alias("parts")).distinct()

    def judge(trace: Trace, rules: DataFrame) -> DataFrame:
        wanted = rules.select(_part(1).alias("var_type"), _part(2).alias("attr"), _part(3).alias("wanted"))
        times = trace.states.groupBy(*tr.VARIABLE, "value").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("value", "wanted")
        seen = trace.states.groupBy(*tr.VARIABLE).agg(F.min("start").alias("start"))
        judged = seen.join(wanted, ["var_type", "attr"]).join(times, [*tr.VARIABLE, "wanted"], "left")
        name = F.concat_ws("/", "process_id", "var_name", "attr")
        return judged.withColumn("example", name).select(
            *_examples(["var_type", "attr", "wanted"], F.coalesce("_n", F.lit(0)) > over, "example", "start"))

    return Relation(hypotheses, judge)


POOL: dict[str, Relation] = {
    "contain": _contain(), "cover": _order(False), "lead": _order(True), "consistent_output": _output(), "periodic": _periodic()}


def register(name: str, relation: Relation) -> None:
    """Add a relation to the pool."""
    POOL[name] = relation


def chosen(enabled: Sequence[str] = (), disabled: Sequence[str] = ()) -> dict[str, Relation]:
    """The relations of the pool, all or the enabled ones, without the disabled ones."""
    return {n: r for n, r in POOL.items() if (not enabled or n in enabled) and n not in disabled}


# --- learning ------------------------------------------------------------------------

def _all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def proposed(traces: Sequence[Trace], relations: Mapping[str, Relation]) -> DataFrame:
    """relation, parts: the rules that any trace proposes."""
    rules = [r.hypotheses(t).select(F.lit(n).alias("relation"), "parts") for n, r in relations.items() for t in traces]
    return cut_lineage(_all(rules).distinct())


def judged(trace: Trace, rules: DataFrame, relations: Mapping[str, Relation]) -> DataFrame:
    """relation, parts, polarity, example, time, fields: all examples of the rules on a trace."""
    examples = [r.judge(trace, rules.filter(F.col("relation") == n).select("parts")).select(
        F.lit(n).alias("relation"), "parts", "polarity", F.col("example").cast("string").alias("example"), "time") for n, r in relations.items()]
    # an example meets many rules: its fields are put in order before, once
    return _all(examples).join(trace.fields.select("example", F.array_sort("fields").alias("fields")), "example")


def patterns(examples: DataFrame) -> DataFrame:
    """How often each set of field values, in order, occurs for and against each rule."""
    return examples.groupBy(*RULE, "polarity", "fields").agg(F.count(F.lit(1)).alias("n"))


def first_patterns(examples: DataFrame) -> DataFrame:
    """``patterns`` with ``first``, the time and example of the first one against the rule.

    Examples for a rule are only counted, in a hash table; each one against it is a row until the second grouping.
    """
    against = F.when(F.col("polarity") == 0, F.struct("time", "example"))
    counted = examples.groupBy(*RULE, "polarity", "fields", against.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*RULE, "polarity", "fields").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _base(known: DataFrame, totals: DataFrame) -> DataFrame:
    """relation, parts, clauses: what the fields of all positives of a rule have in common."""
    fields = known.filter("polarity = 1").select(*RULE, "n", F.inline("fields"))
    per = fields.groupBy(*RULE, "field").agg(
        F.sum("n").alias("_n"), F.count_distinct("value").alias("_d"), F.min("value").alias("value"), F.max("kind").alias("kind"))
    limit = F.when(F.col("kind") == "str", pc.STRING_CONSTANTS).otherwise(pc.OTHER_CONSTANTS)
    clause = F.when(F.col("_d") == 1, "constant").when((F.col("_d") > limit) & (F.col("kind") != "bool"), "consistent")
    held = per.join(totals, RULE).filter(F.col("_n") == F.col("positives")).withColumn("clause", clause).filter("clause is not null")
    value = F.when(F.col("clause") == "constant", F.col("value"))
    return held.groupBy(*RULE).agg(F.array_sort(F.collect_list(F.struct("field", "clause", value.alias("value")))).alias("clauses"))


def _has(fields: Column, clause: Column) -> Column:
    same = lambda f: (f["field"] == clause["field"]) & ((clause["clause"] == "consistent") | f["value"].eqNullSafe(clause["value"]))
    return F.exists(fields, same)


def first_level(known: DataFrame, least: int = LEAST_POSITIVES) -> DataFrame:
    """Rules with at least ``least`` positives: relation, parts, positives, negatives, kind, clauses.

    ``kind`` is unconditional (nothing is against the rule), base (the clauses that all positives share and some negative
    breaks turn every negative away) or open, where positives must be split (see ``searched``).
    """
    totals = known.groupBy(*RULE).agg(
        F.sum(F.when(F.col("polarity") == 1, F.col("n")).otherwise(0)).alias("positives"),
        F.sum(F.when(F.col("polarity") == 0, F.col("n")).otherwise(0)).alias("negatives")).filter(F.col("positives") >= least)
    base = _base(known, totals)
    none = F.array().cast("array<struct<field:string,clause:string,value:string>>")
    against = known.filter("polarity = 0").join(base, RULE).select(
        *RULE, F.filter("clauses", lambda c: ~_has(F.col("fields"), c)).alias("_broken"))
    tested = against.groupBy(*RULE).agg(F.bool_and(F.size("_broken") > 0).alias("_turned"),
                                        F.array_distinct(F.flatten(F.collect_set("_broken"))).alias("_used"))
    rules = totals.join(tested, RULE, "left")
    kind = F.when(F.col("negatives") == 0, "unconditional").when(F.coalesce("_turned", F.lit(False)), "base").otherwise("open")
    return rules.select(*RULE, "positives", "negatives", kind.alias("kind"),
                        F.when(kind == "base", F.array_sort("_used")).otherwise(none).alias("clauses"))


def learned(traces: Sequence[Trace], relations: Mapping[str, Relation] | None = None, least: int = LEAST_POSITIVES) -> DataFrame:
    """Rules of all relations over several traces with their first-level preconditions."""
    relations = POOL if relations is None else relations
    rules = proposed(traces, relations)
    known = cut_lineage(patterns(_all([judged(t, rules, relations) for t in traces])))
    return first_level(known, least)


def searched(known: DataFrame, rules: DataFrame) -> DataFrame:
    """Preconditions of the open rules by the split search over their patterns (I23), one row per clause.

    ``known`` has the patterns that ``rules`` were learned from; hypothesis is relation and parts joined by ``|``.
    """
    open_ = known.join(rules.filter("kind = 'open'").select(*RULE), RULE, "left_semi")
    name = F.concat_ws("|", "relation", F.concat_ws("|", "parts"))
    rows = open_.select(name.alias("hypothesis"), "polarity", F.xxhash64("fields").cast("string").alias("example"), F.inline("fields"))
    return pc.search(rows.select(*pc.KEY, "field", "kind", F.lit("constant").alias("clause"), "value", F.lit(True).alias("single")))


# --- checking ------------------------------------------------------------------------

def checked(trace: Trace, rules: DataFrame, relations: Mapping[str, Relation] | None = None) -> DataFrame:
    """Outcome of each unconditional or base rule on a trace: failed, passed or not_triggered, with the first violation."""
    relations = POOL if relations is None else relations
    rules = cut_lineage(rules.filter("kind <> 'open'").select(*RULE, "clauses"))
    applied = first_patterns(judged(trace, rules, relations)).join(rules, RULE).filter(
        F.forall("clauses", lambda c: _has(F.col("fields"), c)))
    found = applied.groupBy(*RULE).agg(F.sum("n").alias("examples"), F.min(F.when(F.col("polarity") == 0, F.col("first"))).alias("_first"))
    outcome = F.when(F.col("examples").isNull(), "not_triggered").when(F.col("_first").isNotNull(), "failed").otherwise("passed")
    return rules.join(found, RULE, "left").select(
        *RULE, outcome.alias("outcome"), F.coalesce("examples", F.lit(0)).alias("examples"),
        F.col("_first.example").alias("violation"), F.col("_first.time").alias("violation_time"))
