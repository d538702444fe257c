"""Exact dedup through an extendible-hash index kept in shared files.

The index holds one record for each distinct normalised text: its 64-bit key, its place in the
chain of its key, its digest, the id that stays and the number of copies. Owner tasks hold ranges
of keys. Each task that reads documents folds its own copies first, so that a hot text leaves one
row a task; the folded rows go to the owner of their key with their bytes, and the owner compares
bytes: equal ones become one record, others with the same key further links of its chain.

A directory maps the first `depth` bits of a key to a bucket. A bucket with more than `capacity`
keys splits by its next bit, alone; the directory doubles when that bit is beyond its depth.
Buckets are contiguous key ranges, written in key order. Documents probe by the slot of their key:
the directory names the bucket, and only that bucket's chain of the key is searched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.llm.common import ascii_lower, parts, work_folder, written

CAPACITY = 4096
KEY_BITS = 63


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z are lower-cased and nothing else changes."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _key(text: Column) -> Column:
    """The upper 63 bits of the hash, so that ranges of keys are ranges of signed numbers."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def _slot(key: Column, depth: int) -> Column:
    return F.shiftright(key, KEY_BITS - depth)


def directory(keys: DataFrame, folder: str, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for each used slot of the directory, and its depth.

    Loading starts at the depth at which even keys would fill their buckets at least by half. Then each
    overfull bucket splits, and only its keys are counted again, one bit deeper, until none is left.
    A bucket is named by its first key. `keys` has one row for each key: equal keys are chained, not
    counted again. Work tables go to `folder`.
    """
    depth = max(0, math.floor(math.log2(max(1, keys.count() / capacity))))
    settled = None
    while True:
        slot = _slot(F.col("key"), depth)
        counted = written(keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n_keys")), f"{folder}/counted-{depth}")
        last = depth == KEY_BITS
        fits = counted.where((F.col("n_keys") <= capacity) | F.lit(last)).select("slot")
        here = keys.select("key", slot.alias("slot")).join(fits, "slot").select(
            "key", F.shiftleft("slot", KEY_BITS - depth).alias("bucket"), F.lit(depth).alias("local_depth"))
        settled = here if settled is None else settled.unionByName(here)
        if last or counted.where(F.col("n_keys") > capacity).isEmpty():
            break
        keys = written(keys.join(counted.where(F.col("n_keys") > capacity).select("slot"), slot == F.col("slot"), "left_semi"),
                       f"{folder}/overfull-{depth}")
        depth += 1
    slots = settled.select(_slot(F.col("key"), depth).alias("slot"), "bucket", "local_depth").distinct()
    return written(slots, f"{folder}/directory"), depth


def chained(docs: DataFrame, *, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One record for each distinct normalised text, made by the owner of its key from the bytes themselves."""
    rows = docs.select(F.col(id_).alias("id"), normalised(F.col(text)).alias("body"))
    rows = rows.select("id", "body", _key(F.col("body")).alias("key"), F.spark_partition_id().alias("task"))
    folded = rows.groupBy("task", "key", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("copies"))
    # the layout by key meets what grouping by (key, body) asks for, so the owners group without another shuffle
    owned = folded.repartitionByRange(parts(docs.sparkSession), "key")
    texts = owned.groupBy("key", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return texts.select("key", F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("long").alias("n_bytes"),
                        "keep_id", "group_size")


def build_index(docs: DataFrame, folder: str, *, text: str = "text", id_: str = "doc_id", capacity: int = CAPACITY
                ) -> tuple[DataFrame, DataFrame, int]:
    """(index, directory, depth of the directory). The tables lie in `folder`/index and `folder`/directory."""
    records = written(chained(docs, text=text, id_=id_), f"{folder}/records")
    slots, depth = directory(records.select("key").distinct(), folder, capacity)
    placed = records.withColumn("slot", _slot(F.col("key"), depth)).join(slots, "slot")
    owned = placed.repartitionByRange(parts(docs.sparkSession), "bucket", "key")
    chain = Window.partitionBy("bucket", "key").orderBy("sha256")
    index = owned.withColumn("link", F.row_number().over(chain) - 1).select(
        "bucket", "local_depth", "key", "link", "sha256", "n_bytes", "keep_id", "group_size")
    return written(index.sortWithinPartitions("bucket", "key", "link"), f"{folder}/index"), slots, depth


def _probes(docs: DataFrame, slots: DataFrame, depth: int, text: str, id_: str, carry: Column) -> DataFrame:
    """Each document with its key, its digest and the bucket that the directory names for it."""
    rows = docs.select(docs[id_].alias("id"), normalised(docs[text]).alias("body"), carry.alias("carried"))
    rows = rows.select("id", "carried", _key(F.col("body")).alias("p_key"), F.sha2("body", 256).alias("text_sha256"),
                       F.octet_length("body").cast("long").alias("p_bytes"))
    named = slots.select(F.col("slot").alias("p_slot"), F.col("bucket").alias("p_bucket"))
    return rows.withColumn("p_slot", _slot(F.col("p_key"), depth)).join(named, "p_slot")


HIT = "p_bucket = bucket and p_key = key and text_sha256 = sha256 and p_bytes = n_bytes"


def exact_groups(docs: DataFrame, *, text: str = "text", id_: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of `docs`: its id, keep_id, group_size, kept, text_sha256, and its bucket and link.

    Null text is the empty text; an empty table gives no rows. Of equal texts the row with the largest
    id stays. A repeated id counts as one more copy each time; rows that share the id which stays are
    all marked kept, as are all rows of a group without any id (`unique` cuts such ties to one row).
    Other columns of `docs`, whatever their names, play no part.
    """
    index, slots, depth = build_index(docs, work_folder(docs.sparkSession, "exact-dedup"), text=text, id_=id_, capacity=capacity)
    return _probes(docs, slots, depth, text, id_, F.lit(None)).join(index, F.expr(HIT)).select(
        F.col("id").alias(id_), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), "text_sha256",
        "bucket", "link")


def unique(docs: DataFrame, *, text: str = "text", id_: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with the columns of `docs`: one row for each distinct normalised text.

    Rows that repeat an id with an equal text are one document; the first of them by its columns' hash stays.
    The id is part of the join key, so the copies of a hot text spread over all tasks.
    """
    index, slots, depth = build_index(docs, work_folder(docs.sparkSession, "exact-dedup"), text=text, id_=id_, capacity=capacity)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    stay = _probes(docs, slots, depth, text, id_, row).join(index, F.expr(f"{HIT} and id <=> keep_id"))
    once = Window.partitionBy("p_key", "text_sha256", "p_bytes", "id").orderBy(F.xxhash64("carried"))
    return stay.withColumn("turn", F.row_number().over(once)).where("turn = 1").select("carried.*")
