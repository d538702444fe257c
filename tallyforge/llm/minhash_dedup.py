"""Near-duplicate groups from bottom-k sketches, confirmed by exact Jaccard similarity of full shingle sets.

1. Each text becomes its set of word shingles under one 64-bit hash, and the `SKETCH` smallest values are its sketch.
   Documents with equal sets are one class from here on.
2. Inverted lists of sketch values give candidates. Two sets with a similarity of 0.8 share `SHARED` of 32 values but
   for a chance of 3e-10, so a class needs to look only at its rarest `SKETCH - SHARED + 1` values: very common
   values meet nowhere, and no value is dropped. Small sets have their whole set as sketch, where the bound is exact.
3. Lists of up to `LIST` classes give all their pairs. Longer lists (groups of thousands of near copies) are never
   paired: each has a hub, the class whose values most others hold, and each member is compared with the hub alone.
   Two members that are linked with the hub are in one group anyway. For the others the differences from the hub are
   compared: with c elements that only one of a class and its hub has, two classes differ in c1 + c2 - 2 * common
   elements, so linked classes have about as many differences each and share most of them, one of the first few in any
   order; if one of them is not linked with the hub, one of the first half of the other's. The holders of such a difference first get a hub of their own, and what is linked by now
   is one part. A pair is formed only between two parts, where a difference stands early enough in both, and where the
   parity bits of their differences do not prove them too far apart.
4. The union of two sketches estimates the similarity of a pair and drops the hopeless ones; the others are
   confirmed on their full sets. Components of the confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyforge.llm.common import work_folder, written
from tallyforge.llm.components import components
from tallyforge.llm.pieces import slices

SKETCH = 32
SHARED = 10
LIST = 16
HUB_STEPS = 2
#: Members of a hub that are compared with one copy of it.
SHARE = 256
#: Names of the parity bits of a member's differences.
MARKS = [f"mark{i}" for i in range(8)]
LOST_MARKS = [f"lost{i}" for i in range(4)]
#: Lacking elements of the hub for which bits are worked out; beyond it a pair is judged without them.
LOST_MOST = 4096
WORDS_KNOWN = 400_000


class _Hashes(dict):
    """64-bit hash of each word, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(33))) >> np.uint64(1)


def shingle_set(text: str, words: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct hashes (63 bits) of the runs of `words` words; fewer words are one run; none is the empty set."""
    parts = text.encode().lower().split()  # bytes: only A-Z change, and words end at ASCII white space
    if not parts:
        return np.empty(0, np.int64)
    if len(known) > WORDS_KNOWN:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    take = min(words, len(parts))
    value = np.full(len(parts) - take + 1, take, np.uint64)
    for i in range(take):
        value = (value ^ hashes[i:len(parts) - take + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return np.unique(_mixed(value)).astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]), pa.int64()))


def sketches(docs: DataFrame, text: str, id_: str, words: int) -> DataFrame:
    """id, text_key, n (set size), digest of the set (null if empty) and sketch of each row."""
    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("body"), docs[id_].cast("long").alias("id"), F.xxhash64(docs[text]).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part in slices(batches, 0):
            sets = [shingle_set(body, words, known) for body in part.column(0).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 _lists([s[:SKETCH] for s in sets])], ["id", "text_key", "n", "digest", "sketch"])

    return rows.mapInArrow(run, "id long, text_key long, n long, digest binary, sketch array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, text: str, id_: str, words: int) -> DataFrame:
    """(node, items) of the wanted classes (node, id, text_key), from the text of the row that stands for the class."""
    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("body"), docs[id_].cast("long").alias("doc"), F.xxhash64(docs[text]).alias("key"))
    found = rows.join(wanted, F.col("doc").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key"))).select("body", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part in slices(batches, 0):
            sets = [shingle_set(body, words, known) for body in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), _lists(sets)], ["node", "items"])

    return found.mapInArrow(run, "node long, items array<long>")


def _listed(nodes: DataFrame, similarity: int) -> DataFrame:
    """(value, node, n, members): for each class its rarest sketch values, as many as a linked class must meet one of."""
    size = F.size("sketch")
    needed = F.least(F.lit(SHARED), F.ceil(size * similarity / 100.0).cast("int"))
    rows = nodes.select("node", "n", size.alias("held"), needed.alias("needed"), F.explode("sketch").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    met = rows.join(common, "value")
    mine = Window.partitionBy("node")
    # values that no other class has come first; what is left of the prefix goes to the rarest of the others
    rest = F.col("held") - F.col("needed") + 1 - (F.col("held") - F.count("*").over(mine))
    ranked = met.withColumn("rest", rest).withColumn("turn", F.row_number().over(mine.orderBy("members", "value")))
    prefix = ranked.where("turn <= rest").select("value", "node", "n")
    lists = prefix.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    return prefix.join(lists, "value")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch holds enough values of both, on sketches alone."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    enough = shared >= F.ceil(F.size(union) * (SHARED / SKETCH))
    return both.where(enough).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose full sets have at least the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    inner = F.size(F.array_intersect("ia", "ib"))
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", inner.alias("both"), (F.size("ia") + F.size("ib")).alias("sum"))
    return counted.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * similarity).select("a", "b")


def _near_size(similarity: int):
    return (F.col("x.n") * 100 >= F.col("y.n") * similarity) & (F.col("y.n") * 100 >= F.col("x.n") * similarity)




def _pairs(x: DataFrame, y: DataFrame, condition, similarity: int) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), (F.col("x.value") == F.col("y.value")) & condition & _near_size(similarity))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).where("a < b").distinct()


def _hubs(long_: DataFrame, folder: str) -> DataFrame:
    """(value, hub): for each long list the class whose values most others hold, or one that tops a list of that class.

    Common values weigh more than many: a class of rarer values, at the edge of its group, may stand in as many long lists,
    and what the rest of the group has in common would then be a difference of nearly all of them from their hub.
    """
    weight = long_.groupBy("node").agg(F.sum("members").alias("weight"))
    ranked = long_.select("value", "node").join(weight, "node")
    hubs = written(ranked.groupBy("value").agg(F.max(F.struct("weight", "node")).alias("top")), f"{folder}/tops")
    # a hub may stand in a list with a better one: taking that one's place, the lists of one group get one hub
    better = ranked.join(hubs, "value").groupBy("node").agg(F.max("top").alias("better"))
    for _ in range(HUB_STEPS):
        hubs = hubs.join(better, F.col("top.node") == F.col("node")).select("value", F.col("better").alias("top"))
    return hubs.select("value", F.col("top.node").alias("hub"))


def _hub_links(long_: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int, folder: str) -> DataFrame:
    """Links that join the members of each long list as all their pairs would.

    Sets of n1 and n2 elements are linked if they differ in at most share * (n1 + n2) elements.
    """
    less, more = 100 - similarity, 100 + similarity  # share = less / more
    hubs = _hubs(long_, folder)
    members = long_.select("value", "node").join(hubs, "value").where("hub <> node").select("hub", "node").distinct()
    # a hub with many members is dealt to them in as many copies
    shares = members.groupBy("hub").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    members = members.join(shares, "hub").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    of_hub = sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")).join(shares, "hub").select(
        "hub", "hub_items", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    held = members.join(sets, "node").join(of_hub, ["hub", "share"])
    held = held.select("hub", "node", F.size("items").alias("n"), F.size("hub_items").alias("hub_n"), F.array_except("items", "hub_items").alias("gained"),
                       F.array_except("hub_items", "items").alias("lost"))
    held = held.withColumns({"g": F.size("gained"), "c": F.size("gained") + F.size("lost"), **_lost_marks()})
    held = held.withColumn("outside", F.col("c") * more > (F.col("n") + F.col("hub_n")) * less)
    held = written(held, f"{folder}/hubs")
    linked = held.where("not outside").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))

    unsettled = held.where("outside").select("hub").distinct()
    # linked classes have about as many differences each, so they share one of the first `reach`. What is not in the hub
    # comes first, the rarest ahead; what only the hub has is lacking in most members and comes last
    reach = F.floor(F.col("n") * less / similarity) + 1
    kept = ["hub", "node", "n", "hub_n", "g", "c", "outside", *LOST_MARKS]
    open_ = held.join(unsettled, "hub", "left_semi")
    gained = open_.select(*kept, F.explode("gained").alias("element"))
    common = gained.groupBy("hub", "element").agg(F.count("*").alias("holders")).where("holders > 1")
    lost = open_.where(F.col("g") < reach).select(*kept, F.posexplode(F.slice(F.array_sort("lost"), F.lit(1), (reach - F.col("g")).cast("int"))).alias("after", "element"))
    placed = gained.join(common, ["hub", "element"]).withColumn("after", F.lit(None).cast("int")).unionByName(
        lost.withColumn("holders", F.lit(None).cast("long")))
    mine = Window.partitionBy("hub", "node")
    # differences that no other member has come before all; `left` counts this one and those behind it
    alone = F.col("g") - F.count("holders").over(mine)
    at = F.when(F.col("holders").isNull(), F.col("g") + F.col("after") + 1).otherwise(alone + F.row_number().over(mine.orderBy(F.col("holders").asc_nulls_last(), "element")))
    placed = placed.select(*kept, alone.alias("alone"), *_marks(F.col("element"), mine), "element", at.alias("at")).where(F.col("at") <= reach)
    placed = placed.withColumn("left", F.col("c") - F.col("at") + 1)
    half = F.floor((F.col("c") * more + (F.col("hub_n") - F.col("n")) * less) / (2 * more))
    early = F.col("left") * 2 * more >= F.col("c") * more - (F.col("n") + F.col("hub_n")) * less
    placed = written(placed.withColumn("first", F.col("left") > half).where(F.col("first") | F.col("outside") & early), f"{folder}/differences")

    # the members with one difference in common get a hub of their own, which joins those that are close to each other
    second = placed.where("first").groupBy("hub", "element").agg(F.min_by(F.struct("node", "n", "g", "c", "alone", *MARKS, *LOST_MARKS), F.xxhash64("node")).alias("y"))
    near = placed.join(second, ["hub", "element"]).where(F.col("y.node") != F.col("node")).where(
        _marks_apart(F.col, lambda m: F.col(f"y.{m}")) * more <= (F.col("n") + F.col("y.n")) * less)
    near = near.select(F.least("node", "y.node").alias("a"), F.greatest("node", "y.node").alias("b")).distinct()
    linked = linked.unionByName(written(_confirmed(_alike(near, nodes), sets, similarity), f"{folder}/second"))
    labels = written(components(linked, f"{folder}/parts"), f"{folder}/part_labels")
    placed = placed.join(labels, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")

    x, y = placed.where("outside").alias("x"), placed.where("first").alias("y")
    needed = (F.col("x.c") + F.col("y.c")) * more - (F.col("x.n") + F.col("y.n")) * less  # times 2 * more
    fits = (F.col("x.left") * 2 * more >= needed) & (F.col("y.left") * 2 * more >= needed)
    fits = fits & (_marks_apart(lambda m: F.col(f"x.{m}"), lambda m: F.col(f"y.{m}")) * more <= (F.col("x.n") + F.col("y.n")) * less)
    once = F.when(F.col("y.outside"), F.col("x.node") < F.col("y.node")).otherwise(F.lit(True)) & (F.col("x.part") != F.col("y.part"))
    met = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & once & fits & _near_size(similarity))
    pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return linked.unionByName(_confirmed(_alike(pairs, nodes), sets, similarity))


def _marks(element: Column, mine: WindowSpec) -> list[Column]:
    """512 bits of the elements not in the hub, each turning one: two sets differ in at least as many elements as their bits do."""
    word, bit = F.shiftright(element, 6).bitwiseAND(F.lit(7)), F.expr("shiftleft(1L, cast(element & 63 as int))")
    return [F.bit_xor(F.when((word == i) & F.col("holders").isNotNull(), bit).otherwise(F.lit(0).cast("long"))).over(mine).alias(m) for i, m in enumerate(MARKS)]


def _lost_marks() -> dict[str, Column]:
    """256 bits of the hub's elements that a member lacks; none where there are more than `LOST_MOST`."""
    bits = "aggregate(lost, 0L, (s, e) -> if((shiftright(e, 6) & 3) = {}, s ^ shiftleft(1L, cast(e & 63 as int)), s))"
    return {m: F.when(F.size("lost") <= LOST_MOST, F.expr(bits.format(i))) for i, m in enumerate(LOST_MARKS)}


def _marks_apart(x, y):
    """A lower bound of the elements in which two members differ: those that either holds alone, the bits of the others,
    and of the hub's elements that they lack the difference in number or the bits."""
    lost = sum((F.coalesce(F.bit_count(x(m).bitwiseXOR(y(m))), F.lit(0)) for m in LOST_MARKS), F.lit(0))
    lost = F.greatest(lost, F.abs(x("c") - x("g") - y("c") + y("g")))
    return sum((F.bit_count(x(m).bitwiseXOR(y(m))) for m in MARKS), x("alone") + y("alone") + lost)


def near_groups(docs: DataFrame, *, words: int = 5, similarity: int = 80, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, text_key, n_shingles, class_id, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is one
    shingle; null, empty and blank texts have none, are linked with nothing and stay. component_id is the smallest
    id in the group, its own id included; a document is kept if it has that id. Rows that repeat an id keep a row
    each; a null id is never the smallest, and a group without any id has a null component_id and is kept. An
    empty table gives no rows; other columns play no part.
    """
    folder = work_folder(docs.sparkSession, "minhash")
    rows = written(sketches(docs, text, id_, words), f"{folder}/rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key"))
    classes = rows.where("digest is not null").groupBy("digest").agg(first.alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "r.id", "r.text_key", "n", "sketch"), f"{folder}/nodes")
    lists = written(_listed(nodes, similarity), f"{folder}/lists")
    short, long_ = lists.where(F.col("members") <= LIST), lists.where(F.col("members") > LIST)
    pairs = _pairs(short, short, F.col("x.node") < F.col("y.node"), similarity)
    pairs = written(_alike(pairs, nodes), f"{folder}/pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long_.select("node")).distinct()
    sets = written(_full_sets(docs, nodes.select("node", "id", "text_key").join(wanted, "node"), text, id_, words), f"{folder}/sets")
    links = written(_confirmed(pairs, sets, similarity), f"{folder}/links")
    links = links.unionByName(_hub_links(long_, nodes, sets, similarity, folder))
    labels = written(components(links, f"{folder}/cc"), f"{folder}/labels")

    grouped = nodes.join(labels, "node", "left").select("node", "digest", "id", F.coalesce("label", "node").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("id").alias("component_id"))
    named = grouped.join(smallest, "label").select("digest", F.col("label").alias("class_id"), "component_id")
    out = rows.join(named, "digest", "left").select(
        F.col("id").alias("doc_id"), "text_key", F.col("n").alias("n_shingles"), "class_id",
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, words: int = 5, similarity: int = 80, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, all columns: one for each group. Rows without words all stay.

    Of several kept rows in one group (a repeated id, or no id at all) the first by its text's key and its columns' hash stays.
    """
    groups = near_groups(docs, words=words, similarity=similarity, text=text, id_=id_).where("kept")
    groups = groups.select(F.col("doc_id").alias("group_doc"), "text_key", "class_id").distinct()
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[id_].cast("long").alias("row_doc"), F.xxhash64(docs[text]).alias("row_key"))
    stay = rows.join(groups, F.col("row_doc").eqNullSafe(F.col("group_doc")) & (F.col("row_key") == F.col("text_key")))
    # rows without words have no class; a number of their own keeps them apart
    stay = stay.withColumn("lone", F.when(F.col("class_id").isNull(), F.monotonically_increasing_id()))
    first = F.min_by("row", F.struct("row_doc", "row_key", F.xxhash64("row")))
    return stay.groupBy("class_id", "lone").agg(first.alias("row")).select("row.*")
