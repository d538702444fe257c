"""Preconditions: when does a relation hold? Inference, checking, and the whole run.

Example fields are long: hypothesis, polarity (1 for, 0 against), example, record, field,
kind (str, num, bool), value (text). A field that a record lacks, or that is NaN there,
has no row; null is the value "None" of kind none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.relations import capped
from tallyforge.session import cut_lineage

# Which fields count, when constants become "consistent", depth, significance.
RELEVANT_PREFIXES = ["process_id", "thread_id", "meta_vars", "var_name", "function", "exception", "attributes", "var_type"]
CONTEXT_PREFIX = "meta_vars.context_managers"
STAGE_FIELD = "meta_vars.stage"
STRING_CONSTANTS = 4
OTHER_CONSTANTS = 1
MAX_DEPTH = 8
SIGNIFICANT = 100
KEY = ["hypothesis", "polarity", "example"]


def relevant_fields(fields: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Fields that may serve as a clause."""
    keep = F.lit(False)
    for prefix in RELEVANT_PREFIXES:
        keep = keep | F.col("field").startswith(prefix)
    for part in skip:
        keep = keep & ~F.col("field").contains(part)
    return fields.filter(keep)


def local_clauses(fields: DataFrame) -> DataFrame:
    """What each field does within an example.

    ``clause`` is constant (all records share the value), unequal (all differ) or mixed; a
    field missing in one record gives no row. ``single`` marks one-record examples.
    """
    # dealt by example first: the counts and their join need no shuffle of their own, and no sort where the rows are read
    fields = fields.repartition(*KEY)
    size = fields.groupBy(*KEY).agg(F.count_distinct("record").alias("_records"))
    per = fields.groupBy(*KEY, "field").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("value").alias("_d"), F.min("value").alias("value"),
        F.max("kind").alias("kind"), F.bool_or(F.col("kind") == "none").alias("_none"))
    joined = per.join(size, KEY).filter(F.col("_n") == F.col("_records"))
    clause = (F.when(F.col("_d") == 1, "constant")
              .when((F.col("_d") == F.col("_records")) & ~F.col("_none"), "unequal").otherwise("mixed"))
    return joined.select(*KEY, "field", "kind", clause.alias("clause"),
                         F.when(F.col("_d") == 1, F.col("value")).alias("value"), (F.col("_records") == 1).alias("single"))


def merged_clauses(local: DataFrame) -> DataFrame:
    """Clauses of the positives with the number of examples that have them.

    Over four text constants, or over one other, become one consistent clause; flags stay.
    """
    return _merged(local.filter(F.col("polarity") == 1).groupBy("hypothesis", "field", "clause", "value").agg(
        F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")))


def _merged(tally: DataFrame) -> DataFrame:
    """``merged_clauses`` from the positives with each local clause: hypothesis, field, clause, value, kind, n."""
    field = Window.partitionBy("hypothesis", "field")
    limit = F.when(F.col("kind") == "str", STRING_CONSTANTS).otherwise(OTHER_CONSTANTS)
    constant = F.col("clause") == "constant"
    many = constant & (F.count(F.when(constant, 1)).over(field) > limit) & (F.col("kind") != "bool")
    judged = tally.withColumn("_many", many)
    own = F.when(F.col("_many"), F.struct(F.lit("consistent").alias("clause"), F.lit(None).cast("string").alias("value"))).when(
        F.col("clause") != "mixed", F.struct("clause", "value"))
    exist = F.when(F.col("field").startswith(CONTEXT_PREFIX), F.struct(
        F.lit("exist").alias("clause"), F.lit(None).cast("string").alias("value")))
    return judged.select("hypothesis", "field", "n", F.inline(F.array_compact(F.array(own, exist)))).groupBy(
        "hypothesis", "field", "clause", "value").agg(F.sum("n").alias("n"))


def clause_holds(clause: Column, values: Column, local_clause: Column, local_value: Column, single: Column) -> Column:
    """Does one clause hold for an example's field? A missing field (null) fails."""
    constant = local_clause == "constant"
    held = (F.when(clause == "constant", constant & F.array_contains(values, local_value))
            .when(clause == "consistent", constant)
            .when(clause == "unequal", (local_clause == "unequal") | single)
            .when(clause == "exist", local_clause.isNotNull()).otherwise(clause == "unconditional"))
    return F.coalesce(held, F.lit(False))


def base_clauses(local: DataFrame) -> DataFrame:
    """Clauses all positives have and some negative breaks, with how many break them."""
    # examples with the same clause are one row, so a hypothesis with most examples joins few. An example counts in one of its rows
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("field")) == 1
    tally = cut_lineage(local.withColumn("_first", first).groupBy(
        "hypothesis", "polarity", "field", "kind", F.col("clause").alias("_l"), F.col("value").alias("_v"), "single").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("_first").alias("_examples")))
    merged = _merged(tally.filter(F.col("polarity") == 1).groupBy("hypothesis", "field", F.col("_l").alias("clause"), F.col("_v").alias("value")).agg(
        F.max("kind").alias("kind"), F.sum("_rows").alias("n")))
    totals = tally.groupBy("hypothesis").agg(
        F.sum(F.col("polarity") * F.col("_examples")).alias("_pos"), F.sum((1 - F.col("polarity")) * F.col("_examples")).alias("_neg"))
    everywhere = merged.join(totals, "hypothesis").filter(F.col("n") == F.col("_pos"))
    negatives = tally.filter(F.col("polarity") == 0).drop("polarity", "kind", "_examples")
    held = everywhere.join(negatives, ["hypothesis", "field"], "left").groupBy(
        "hypothesis", "field", "clause", "value", "_neg").agg(
        F.sum(F.when(clause_holds(F.col("clause"), F.array("value"), F.col("_l"), F.col("_v"), F.col("single")), F.col("_rows")).otherwise(0)).alias("_held"))
    return held.withColumn("broken_by", F.col("_neg") - F.col("_held")).filter("broken_by > 0").drop("_neg", "_held")


# --- search per hypothesis -----------------------------------------------------------

_CONSTANT, _UNEQUAL = 1, 2


class _Field:
    """One field over the examples of a hypothesis: state, value, kind."""

    def __init__(self, n: int):
        self.state = np.zeros(n, dtype=np.int8)
        self.seen = np.zeros(n, dtype=bool)
        self.single = np.zeros(n, dtype=bool)
        self.value = np.full(n, None, dtype=object)
        self.kind = "str"


def _clauses(fields: dict[str, _Field], positive: np.ndarray) -> dict[tuple, np.ndarray]:
    """Merged clauses of these positives, each with the examples it holds for."""
    out: dict[tuple, np.ndarray] = {}
    for name, f in fields.items():
        constant = f.state == _CONSTANT
        values = sorted({v for v, c in zip(f.value[positive], constant[positive]) if c})
        limit = STRING_CONSTANTS if f.kind == "str" else OTHER_CONSTANTS
        if f.kind != "bool" and len(values) > limit:
            out[(name, "consistent", tuple(values))] = constant
        else:
            for v in values:
                out[(name, "constant", (v,))] = constant & (f.value == v)
        if (f.state[positive] == _UNEQUAL).any():
            out[(name, "unequal", ())] = (f.state == _UNEQUAL) | (f.single & f.seen)
        if name.startswith(CONTEXT_PREFIX) and f.seen[positive].any():
            out[(name, "exist", ())] = f.seen
    return out


def _search(fields: dict[str, _Field], positive: np.ndarray, negative: np.ndarray, pruned: set | None = None,
            depth: int = 0) -> list[frozenset]:
    """Conjunctions, one of which holds for every positive and none for a negative."""
    if depth > MAX_DEPTH:
        return []
    if not len(negative):
        return [frozenset()]
    clauses = {c: m for c, m in _clauses(fields, positive).items() if not pruned or c not in pruned}
    base = {c for c, m in clauses.items() if m[positive].all()}
    passing = negative
    for c in base:
        passing = passing[clauses[c][passing]]
    if pruned is None:
        never_false = {c for c, m in clauses.items() if m[negative].all()}
        pruned, base = never_false, base - never_false
        clauses = {c: m for c, m in clauses.items() if c not in never_false}
    if not len(passing):
        return [frozenset(base)]

    groups: list[np.ndarray] = []
    for mask in sorted((m[positive] for c, m in clauses.items() if c not in base), key=lambda m: -int(m.sum())):
        if mask.any() and not any((mask <= g).all() for g in groups):
            groups.append(mask)
    if not groups or not np.logical_or.reduce(groups).all():
        return []
    found: set[frozenset] = set()
    for mask in groups:
        found.update(_search(fields, positive[mask], passing, pruned, depth + 1))
    found = {p for p in found if not any(q < p for q in found)}
    covered = np.zeros(len(positive), dtype=bool)
    for p in found:
        holds = np.ones(len(positive), dtype=bool)
        for name, kind, values in p:
            holds &= _holds(fields[name], kind, values)[positive]
        covered |= holds
    return sorted(found, key=sorted) if covered.all() else []


def _holds(f: _Field, kind: str, values: tuple) -> np.ndarray:
    if kind == "constant":
        return (f.state == _CONSTANT) & np.isin(f.value.astype(str), list(values))
    if kind == "consistent":
        return f.state == _CONSTANT
    return ((f.state == _UNEQUAL) | (f.single & f.seen)) if kind == "unequal" else f.seen


PRECONDITION = ("hypothesis string, precondition int, inverted boolean, field string, clause string, values array<string>")


def _infer_one(pdf: pd.DataFrame) -> pd.DataFrame:
    number = {key: i for i, key in enumerate(sorted(set(zip(pdf["polarity"], pdf["example"]))))}
    at = np.array([number[key] for key in zip(pdf["polarity"], pdf["example"])])
    polarity = np.array([p for p, _ in sorted(number)])
    fields: dict[str, _Field] = {}
    for name, rows in pdf.groupby("field"):
        where, f = at[rows.index], _Field(len(number))
        f.seen[where] = True
        f.single[where] = rows["single"].to_numpy()
        f.state[where] = rows["clause"].map({"constant": _CONSTANT, "unequal": _UNEQUAL}).fillna(0).to_numpy(np.int8)
        f.value[where] = rows["value"].to_numpy()
        f.kind = rows["kind"].mode().iloc[0]
        fields[name] = f
    positive, negative = np.flatnonzero(polarity == 1), np.flatnonzero(polarity == 0)
    found = _search(fields, positive, negative) if len(positive) else []
    inverted = False
    if not found and len(positive) and len(negative):
        found, inverted = _search(fields, negative, positive), True
    out = []
    for i, precondition in enumerate(found):
        for name, kind, values in sorted(precondition) or [(None, "unconditional", ())]:
            out.append((pdf["hypothesis"].iloc[0], i, inverted, name, kind, list(values)))
    return pd.DataFrame(out, columns=["hypothesis", "precondition", "inverted", "field", "clause", "values"])


def infer(fields: DataFrame, skip: Sequence[str] = (), keep: int = 5000, seed: int = 42) -> DataFrame:
    """Preconditions of each hypothesis, one row per clause.

    Examples are capped per hypothesis and polarity before their fields are read, so a
    hypothesis is searched on at most twice ``keep`` examples. No row means none was found.
    """
    chosen = capped(fields.select(*KEY).distinct(), ["hypothesis"], "example", keep, seed)
    return search(local_clauses(relevant_fields(fields.join(chosen, KEY, "left_semi"), skip)))


def search(local: DataFrame) -> DataFrame:
    """Preconditions of each hypothesis from the local clauses of its examples, one row per clause."""
    shuffle = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return local.repartition(shuffle, "hypothesis").groupBy("hypothesis").applyInPandas(
        lambda pdf: _infer_one(pdf.reset_index(drop=True)), PRECONDITION)


def preconditions_as_sets(clauses: DataFrame) -> DataFrame:
    """One row per precondition with its clauses as a sorted array."""
    text = F.concat_ws("|", F.coalesce("field", F.lit("")), "clause", F.concat_ws(";", "values"))
    return clauses.groupBy("hypothesis", "precondition", "inverted").agg(F.sort_array(F.collect_set(text)).alias("clauses"))


def without_implied(preconditions: DataFrame) -> DataFrame:
    """Drop a precondition that holds every clause of another one.

    A hypothesis has few preconditions; of equal ones the first stays.
    """
    other = preconditions.select("hypothesis", F.col("precondition").alias("_p"), F.col("clauses").alias("_c"))
    implied = preconditions.join(other, "hypothesis").filter(
        (F.col("precondition") != F.col("_p")) & (F.size(F.array_except("_c", "clauses")) == 0)
        & ((F.size("_c") < F.size("clauses")) | (F.col("_p") < F.col("precondition"))))
    return preconditions.join(implied.select("hypothesis", "precondition").distinct(), ["hypothesis", "precondition"], "left_anti")


def restricted_to_stages(clauses: DataFrame, valid: Sequence[str], every: Sequence[str]) -> DataFrame:
    """Preconditions that also ask for a valid stage.

    An unconditional one becomes the stage clause; an inverted set gets one more
    precondition for the other stages.
    """
    def stage_rows(rows: DataFrame, number: Column, stages: Sequence[str]) -> DataFrame:
        return rows.select("hypothesis", number.alias("precondition"), "inverted", F.lit(STAGE_FIELD).alias("field"),
                           F.lit("constant").alias("clause"), F.array(*[F.lit(s) for s in sorted(stages)]).alias("values"))

    plain = clauses.filter(~F.col("inverted")).select("hypothesis", "precondition", "inverted").distinct()
    added = stage_rows(plain, F.col("precondition"), valid)
    turned = clauses.filter("inverted").groupBy("hypothesis", "inverted").agg((F.max("precondition") + 1).alias("_next"))
    rest = sorted(set(every) - set(valid))
    out = clauses.filter(F.col("clause") != "unconditional").unionByName(added)
    return out.unionByName(stage_rows(turned, F.col("_next"), rest)) if rest else out


# --- checking ------------------------------------------------------------------------

def holds_for(local: DataFrame, clauses: DataFrame) -> DataFrame:
    """Examples with ``holds``: does their hypothesis apply to them?

    All clauses of one precondition, any precondition, and the reverse if inverted.
    """
    examples = local.select(*KEY).distinct()
    seen = local.select(*KEY, "field", F.col("clause").alias("_l"), F.col("value").alias("_v"), "single")
    asked = examples.join(clauses, "hypothesis").join(seen, [*KEY, "field"], "left")
    ok = clause_holds(F.col("clause"), F.col("values"), F.col("_l"), F.col("_v"), F.col("single"))
    conjunction = asked.groupBy(*KEY, "precondition", "inverted").agg(F.bool_and(ok).alias("_all"))
    return conjunction.groupBy(*KEY).agg(F.bool_or("_all").alias("_any"), F.first("inverted").alias("_inv")).select(
        *KEY, (F.col("_any") != F.col("_inv")).alias("holds"))


def safety(judged: DataFrame) -> DataFrame:
    """Is a precondition met by no negative, and are there enough positives?"""
    return judged.groupBy("hypothesis").agg(
        F.count_if(F.col("holds") & (F.col("polarity") == 0)).alias("unsafe_examples"),
        F.count_if(F.col("polarity") == 1).alias("positives")).withColumns({
            "safe": F.col("unsafe_examples") == 0, "significant": F.col("positives") > SIGNIFICANT})


def check(judged: DataFrame, times: DataFrame) -> DataFrame:
    """Outcome of each hypothesis on a trace (I27): failed, passed or not_triggered.

    ``times`` has hypothesis, polarity, example, time; the first violation is reported.
    """
    applied = judged.filter("holds").join(times, KEY)
    broken = F.when(F.col("polarity") == 0, F.struct("time", "example"))
    found = applied.groupBy("hypothesis").agg(F.min(broken).alias("_first"))
    every = judged.select("hypothesis").distinct().join(found.withColumn("_hit", F.lit(True)), "hypothesis", "left")
    outcome = F.when(F.col("_hit").isNull(), "not_triggered").when(F.col("_first").isNotNull(), "failed").otherwise("passed")
    return every.select("hypothesis", outcome.alias("outcome"), F.col("_first.example").alias("violation"),
                        F.col("_first.time").alias("violation_time"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Failed, passed and not triggered invariants."""
    return results.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("failed", "passed", "not_triggered")])


def supported(fields: DataFrame, least: int = 2) -> DataFrame:
    """Example fields of hypotheses with at least ``least`` positives over all traces."""
    examples = fields.select(*KEY).distinct()
    enough = examples.groupBy("hypothesis").agg(F.sum("polarity").alias("_p")).filter(F.col("_p") >= least)
    return fields.join(enough, "hypothesis", "left_semi")


def infer_over_traces(traces: Sequence[DataFrame], skip: Sequence[str] = (), keep: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Invariants and failed hypotheses of several traces.

    Each trace gives example fields; equal hypotheses are merged, those with at most one
    positive dropped. Gives the clause rows, and the hypotheses without a precondition.
    """
    merged = traces[0]
    for other in traces[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    kept = supported(merged)
    clauses = infer(kept, skip, keep)
    failed = kept.select("hypothesis").distinct().join(clauses.select("hypothesis").distinct(), "hypothesis", "left_anti")
    return clauses, failed.withColumn("reason", F.lit("Precondition not found"))


def relation_sizes(invariants: DataFrame) -> DataFrame:
    """Invariants per relation."""
    return invariants.groupBy("relation").agg(F.count(F.lit(1)).alias("invariants"))


# --- parameters ----------------------------------------------------------------------

def matches_call(api: str | None = None, exception: str | None = None) -> Column:
    """Does a call fall under an API parameter?"""
    cond = F.lit(True)
    if api is not None:
        cond = cond & (F.col("function") == api)
    return cond & (F.col("outcome") == exception if exception is not None else F.col("outcome") != "exception")


def matches_change(var_type: str | None = None, var_name: str | None = None, attr: str | None = None,
                   before: str | None = None, after: str | None = None, const: str | None = None) -> Column:
    """Does a variable change fall under a variable parameter?"""
    cond = F.lit(True)
    for column, wanted in (("var_type", var_type), ("var_name", var_name), ("attr", attr),
                           ("old_value", before), ("new_value", after), ("new_value", const)):
        if wanted is not None:
            cond = cond & F.col(column).eqNullSafe(F.lit(wanted))
    return cond
