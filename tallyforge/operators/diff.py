"""Differences between the records of two runs, and between two sets of invariants.

A record has idx (its line), kind (its type) and content (flat map of text). Runs are
matched line by line without comparing all lines: first equal contents, then contents
equal up to numbers, then records of the same kind and name; within a block the n-th
line of one run meets the n-th of the other. What is left was deleted or inserted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.ordered import numbered
from tallyforge.session import cut_lineage

# Key endings that are not compared, and how far an edited line may differ.
IGNORED_ENDINGS = ["_id", "time", "time_ns", "_millis", "_str", "idx"]
EDIT_KEYS = 4
PATTERN_KEYS = 3
SHARES = 16


def masked(text: Column) -> Column:
    """Text with every number replaced by 0."""
    return F.regexp_replace(text, r"\d+", "0")


def compared(content: Column) -> Column:
    """The entries of a record that take part in a comparison."""
    def keep(key: Column, _: Column) -> Column:
        ignored = F.lit(False)
        for ending in IGNORED_ENDINGS:
            ignored = ignored | key.endswith(ending)
        return ~ignored

    return F.map_filter(content, keep)


def differing_keys(a: Column, b: Column) -> Column:
    """Keys whose values differ or that only one record has (F8)."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def content_text(content: Column) -> Column:
    """One text for a content, independent of the order of its keys."""
    entries = F.array_sort(F.map_entries(content))
    return F.concat_ws("\x1f", F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("None")))))


def _matched(left: DataFrame, right: DataFrame, block: str, max_rows: int | None) -> DataFrame:
    """Lines of both runs with the same block and the same turn in it."""
    a = numbered(left, [block], [F.col("idx")], "_turn", max_rows).select(
        F.col(block).alias("_block"), "_turn", F.col("idx").alias("left_idx"), F.col("content").alias("left_content"))
    b = numbered(right, [block], [F.col("idx")], "_turn", max_rows).select(
        F.col(block).alias("_block"), "_turn", F.col("idx").alias("right_idx"), F.col("content").alias("right_content"))
    return a.join(b, ["_block", "_turn"]).drop("_block", "_turn")


def matched_records(left: DataFrame, right: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Best matches of two runs with the keys that differ (J13; J14 with kind = description)."""
    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("content", compared(F.col("content")))
        text = content_text(F.col("content"))
        return rows.withColumns({
            "_exact": F.concat_ws("\x1e", "kind", text), "_mask": F.concat_ws("\x1e", "kind", masked(text)),
            "_name": F.concat_ws("\x1e", "kind", F.coalesce(F.try_element_at("content", F.lit("function")), F.lit(""))),
        })

    a, b = cut_lineage(prepared(left)), cut_lineage(prepared(right))
    out = None
    for block in ("_exact", "_mask", "_name"):
        found = cut_lineage(_matched(a, b, block, max_rows))
        out = found if out is None else out.unionByName(found)
        a = a.join(found.select(F.col("left_idx").alias("idx")), "idx", "left_anti")
        b = b.join(found.select(F.col("right_idx").alias("idx")), "idx", "left_anti")
    return out.withColumn("differing", differing_keys(F.col("left_content"), F.col("right_content")))


def _contents(rows: DataFrame, side: str) -> DataFrame:
    """Distinct contents of a kind with their entries, key names and first line."""
    cleaned = rows.select("kind", "idx", compared(F.col("content")).alias("content"))
    text = content_text(F.col("content"))
    first = cleaned.groupBy("kind", text.alias("text")).agg(F.min("idx").alias("first"), F.min_by(F.map_entries("content"), "idx").alias("pairs"))
    entries = F.transform("pairs", lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return first.select("kind", F.col("text").alias(f"{side}_text"), F.col("first").alias(f"{side}_first"), entries.alias(f"{side}_entries"),
                        F.array_sort(F.transform("pairs", lambda e: e["key"])).alias(f"{side}_keys"))


def _signatures(contents: DataFrame, side: str, counts: DataFrame, d: int) -> DataFrame:
    """kind, signature, text: what contents with at most ``d`` differing keys must have one in common of.

    The larger of two such contents shares all its entries but ``d`` with the other: two of its ``d`` + 2 rarest if it
    has so many, else one of its ``d`` + 1 rarest. The smaller one has at most as many others, so the same holds for it.
    """
    ranked = contents.select("kind", f"{side}_text", F.size(f"{side}_entries").alias("size"), F.explode(f"{side}_entries").alias("entry"))
    ranked = ranked.join(counts, ["kind", "entry"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = Window.partitionBy("kind", f"{side}_text").orderBy("n", "entry")
    rare = ranked.withColumn("turn", F.row_number().over(own)).filter(F.col("turn") <= d + 2).groupBy("kind", f"{side}_text", "size").agg(
        F.array_sort(F.collect_list("entry")).alias("two"), F.array_sort(F.collect_list(F.when(F.col("turn") <= d + 1, F.col("entry")))).alias("one"))
    pairs = F.flatten(F.transform("two", lambda a, i: F.transform(
        F.slice("two", i + 2, F.size("two")), lambda b: F.concat_ws("\x1e", a, b))))
    # singles are for two contents of which the larger has d + 1 entries
    ones = F.when(F.col("size") <= d + 1, F.col("one")).otherwise(F.array().cast("array<string>"))
    return rare.select("kind", f"{side}_text", F.explode(F.concat(pairs, ones)).alias("signature"))


def nearest_records(left: DataFrame, right: DataFrame, most: int = EDIT_KEYS) -> DataFrame:
    """Each left record with the right record of its kind that differs in the fewest keys, at most ``most``.

    Of several the one on the first line: left_idx, right_idx, differing. A record without a near one has no row. Distinct
    contents are compared, for 0, 1, 2, ... differing keys in turn, each only while no nearer one is known, and only those
    with a rare combination of entries in common. Contents of so few keys that all may differ need no comparison: what
    counts for them are the key names, of which a kind has few sets.
    """
    a, b = cut_lineage(_contents(left, "left")), cut_lineage(_contents(right, "right"))
    counts = cut_lineage(b.select("kind", F.explode("right_entries").alias("entry")).groupBy("kind", "entry").agg(F.count(F.lit(1)).alias("n")))
    key_sets = cut_lineage(b.groupBy("kind", "right_keys").agg(F.min("right_first").alias("right_first")))
    equal = a.join(b, (a["kind"] == b["kind"]) & (F.col("left_text") == F.col("right_text")))
    found = cut_lineage(equal.select(a["kind"], "left_text", F.col("right_first").alias("right_idx"), F.lit(0).alias("differing")))
    for d in range(1, most + 1):
        open_ = a.join(found, ["kind", "left_text"], "left_anti")
        met = _signatures(open_, "left", counts, d).join(_signatures(b, "right", counts, d), ["kind", "signature"]).select(
            "kind", "left_text", "right_text").distinct()
        both = met.join(a, ["kind", "left_text"]).join(b, ["kind", "right_text"])
        shared = F.size(F.array_intersect("left_entries", "right_entries"))
        apart = F.size(F.array_union("left_keys", "right_keys")) - shared
        near = both.filter(apart == d).select("kind", "left_text", "right_first")
        # nothing nearer is known, so contents with so few keys between them differ in all of them
        small = open_.filter(F.size("left_keys") <= d).join(key_sets.filter(F.size("right_keys") <= d), "kind")
        small = small.filter(F.size(F.array_union("left_keys", "right_keys")) == d).select("kind", "left_text", "right_first")
        level = near.unionByName(small).groupBy("kind", "left_text").agg(F.min("right_first").alias("right_idx"))
        found = cut_lineage(found.unionByName(level.withColumn("differing", F.lit(d))))
    lines = left.select("kind", F.col("idx").alias("left_idx"), content_text(compared(F.col("content"))).alias("left_text"))
    return lines.join(found, ["kind", "left_text"]).select("left_idx", "right_idx", "differing")


def run_diff(left: DataFrame, right: DataFrame, edit_keys: int = EDIT_KEYS, max_rows: int | None = None) -> DataFrame:
    """Line changes from one run to the other: edit, delete, insert.

    A match that differs in more than ``edit_keys`` keys counts as no match.
    """
    close = matched_records(left, right, max_rows).filter(F.size("differing") <= edit_keys)
    edits = close.filter(F.size("differing") > 0).select(
        F.lit("edit").alias("change"), "left_idx", "right_idx", F.concat_ws(",", F.array_sort("differing")).alias("keys"),
        F.col("left_content"), F.col("right_content"))

    def rest(rows: DataFrame, side: str, change: str) -> DataFrame:
        alone = rows.join(close.select(F.col(f"{side}_idx").alias("idx")), "idx", "left_anti")
        none = F.lit(None)
        mine = {f"{side}_idx": F.col("idx"), f"{side}_content": compared(F.col("content"))}
        other = "right" if side == "left" else "left"
        return alone.select(
            F.lit(change).alias("change"),
            *[mine.get(f"{s}_idx", none.cast("long")).alias(f"{s}_idx") for s in ("left", "right")],
            F.lit("").alias("keys"),
            mine[f"{side}_content"].alias(f"{side}_content"), none.cast("map<string,string>").alias(f"{other}_content"))

    return edits.unionByName(rest(left, "left", "delete")).unionByName(rest(right, "right", "insert"))


def edit_patterns(diff: DataFrame) -> DataFrame:
    """Edited keys with masked values and how often each occurs (part of I30)."""
    keys = diff.filter("change = 'edit'").withColumn("key", F.explode(F.split("keys", ",")))
    old, new = (F.coalesce(F.try_element_at(f"{s}_content", F.col("key")), F.lit("None")) for s in ("left", "right"))
    pattern = masked(F.concat(F.col("key"), F.lit("="), old, F.lit(" -> "), new))
    return keys.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("times"))


def _firsts(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key by ``at``, ranked in shares first, so that no task sorts all rows of a key."""
    first = rows.withColumn("_share", F.pmod(F.xxhash64("pattern"), F.lit(SHARES)))
    for share in (["_share"], []):
        first = first.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, *share).orderBy("at"))).filter(F.col("_turn") <= most)
    return first.drop("_share", "_turn")


def line_patterns(lines: DataFrame, keys: int = PATTERN_KEYS) -> DataFrame:
    """Masked contents of deleted or inserted lines, grouped when at most ``keys`` keys differ.

    ``lines`` has idx, content. Distinct masked contents are compared, and only those that share a signature: two
    of their rarest entries, or one if no more can be common. Contents of so few keys that all may differ need
    no comparison: two of them are near by their key names alone, and contents with the same names are all near,
    so at most one of them leads. For these a table with one row a set of names holds what is settled.

    Contents are taken by first line: one that is in no group yet leads a group of all later contents near
    to it that are in none. Each round takes the first few open contents of every signature. One that is among them
    under all its signatures, and has no earlier open content near, leads; what is near to it is open no more. Few
    leaders close many contents, so pairs of contents that do not lead are hardly formed. The number taken doubles
    each round, so that contents which are all apart need few rounds. At last each content joins its first leader.
    """
    mask = F.transform_values(compared(F.col("content")), lambda _, v: masked(v))
    distinct = lines.withColumn("content", mask).withColumn("pattern", content_text(F.col("content"))).groupBy("pattern").agg(
        F.min_by("content", F.struct("idx", content_text(F.col("content")))).alias("content"), F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("times"))
    names = F.array_sort(F.map_keys("content"))
    distinct = cut_lineage(distinct.withColumns({
        "at": F.struct("first_idx", "pattern"), "names": F.when(F.size("content") <= keys, names)}))

    entries = F.transform(F.map_entries("content"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    contents = distinct.select(F.lit("").alias("kind"), F.col("pattern").alias("left_text"), entries.alias("left_entries"))
    counts = contents.select("kind", F.explode("left_entries").alias("entry")).groupBy("kind", "entry").agg(F.count(F.lit(1)).alias("n"))
    signed = cut_lineage(_signatures(contents, "left", counts, keys).select(F.col("left_text").alias("pattern"), "signature"))
    signed = signed.join(signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("signature"), "signature")
    signed = cut_lineage(signed.join(distinct.select("pattern", "content", "at"), "pattern"))

    def near(later: DataFrame, before: DataFrame) -> DataFrame:
        """Contents with earlier near ones that share a signature: pattern, at of the earlier one."""
        other = before.select("signature", F.col("content").alias("other"), F.col("at").alias("before_at"))
        apart = F.size(differing_keys(F.col("content"), F.col("other")))
        return later.join(other, "signature").filter((F.col("before_at") < F.col("at")) & (apart <= keys)).select("pattern", "before_at")

    few = distinct.select("names").filter("names is not null").distinct()
    beside = few.select(F.col("names").alias("other_names"))
    beside = cut_lineage(few.join(beside, F.size(F.array_union("names", "other_names")) <= keys))

    def first_beside(rows: DataFrame) -> DataFrame:
        """The first of the rows that is near by key names, for each set of names."""
        first = rows.filter("names is not null").groupBy(F.col("names").alias("other_names")).agg(F.min("at").alias("at"))
        return beside.join(first, "other_names").groupBy("names").agg(F.min("at").alias("first_beside"))

    open_, leaders, most = distinct.select("pattern", "at", "names"), None, 1
    while True:
        rows = signed.join(open_.select("pattern"), "pattern", "left_semi")
        heads = cut_lineage(_firsts(rows, ["signature"], most))
        # not among the first of some signature: something before it there is not compared
        unseen = rows.select("pattern", "signature").join(heads, ["pattern", "signature"], "left_anti").select("pattern")
        behind = unseen.unionByName(near(heads, heads).select("pattern")).distinct()
        lead = open_.join(behind, "pattern", "left_anti").join(first_beside(open_), "names", "left").filter(
            F.col("first_beside").isNull() | (F.col("first_beside") >= F.col("at")))
        lead = cut_lineage(lead.select("pattern", "at", "names"))
        leaders = lead if leaders is None else leaders.unionByName(lead)
        closed = near(rows, signed.join(lead.select("pattern"), "pattern", "left_semi")).select("pattern").distinct()
        open_ = open_.join(lead.select("pattern"), "pattern", "left_anti").join(closed, "pattern", "left_anti")
        open_ = cut_lineage(open_.join(first_beside(lead), "names", "left").filter("first_beside is null").drop("first_beside"))
        if open_.isEmpty():
            break
        most *= 2

    leaders = cut_lineage(leaders)
    met = near(signed, signed.join(leaders.select("pattern"), "pattern", "left_semi")).groupBy("pattern").agg(F.min("before_at").alias("near_first"))
    first = distinct.join(leaders.select("pattern", F.lit(True).alias("leads")), "pattern", "left").join(met, "pattern", "left").join(
        first_beside(leaders), "names", "left")
    by_names = F.when(F.col("first_beside") < F.col("at"), F.col("first_beside"))
    leader = F.when(F.col("leads"), F.col("pattern")).otherwise(F.least("near_first", by_names)["pattern"])
    return first.groupBy(leader.alias("pattern")).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("variants"))


def new_patterns(first: DataFrame, second: DataFrame) -> DataFrame:
    """Patterns of the second run that the first run has not."""
    return second.select("pattern").subtract(first.select("pattern"))


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts."""
    return F.levenshtein(a, b)
