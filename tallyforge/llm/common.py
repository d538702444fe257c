"""Shared-folder tables and small numpy helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. Only a local session gets one of its own, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyforge-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder. Tables there belong to one run; the cluster expires them."""
    return f"{shared_folder(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and a lost executor costs no upstream work."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text with as many bytes as characters is ASCII, where plain lower() does the same faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class HashTable:
    """uint64 keys to int32 values: open addressing with linear probes, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.missing = missing
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, missing, np.int32)
        self.used = np.zeros(1 << self.bits, bool)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = todo[~self.used[slot[todo]]]
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.values[at], self.used[at] = keys[won], values[won], True
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & self.used[slot])
        out[(self.keys[slot] != keys) | ~self.used[slot]] = self.missing
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            at, want = slot[open_], keys[open_]
            hit = self.used[at] & (self.keys[at] == want)
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[self.used[at] & ~hit]
        return out
