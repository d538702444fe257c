"""Token counts through a digest cache.

The cache is a table in a shared folder: content digest, digest of the tokenizer and its library's version, count.
Texts are reduced to one row for each distinct digest, those that the cache knows are left out, the others are
encoded once and appended. Documents then take their count from the cache by digest. A new tokenizer file
or library version has another digest, so its counts never mix with older ones.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import work_folder
from tallyforge.llm.pieces import Memo, cut, slices

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Of the tokenizer's file and the version of the library that reads it."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


@lru_cache(maxsize=2)
def _memos(path: str) -> tuple[Memo, Memo]:
    """Counts of pieces at the start of a text and after a space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Memo(count, 1_000), Memo(lambda pieces: count([" " + p for p in pieces]))


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library counts them over the whole text. Each distinct piece is encoded once."""
    first, after = _memos(path)
    pieces = [cut(text) for text in texts]
    heads = [p.pop(0) for p in pieces]
    first.learn(heads)
    after.learn(chain.from_iterable(pieces))
    return [first[head] + sum(map(after.__getitem__, rest)) for head, rest in zip(heads, pieces, strict=True)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            counts = count_tokens(part.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])
    return run


def open_cache(spark: SparkSession, folder: str) -> None:
    """Make an empty cache where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(folder)


def _cached(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Counts by content; jobs that ran at the same time may have appended a content twice."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(folder).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy(F.col("content").alias("known")).agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(texts: DataFrame, path: str, folder: str) -> None:
    """Encode those rows of `texts` (content, body) whose content the cache lacks, once each, and append them."""
    spark, tokenizer = texts.sparkSession, tokenizer_digest(path)
    distinct = texts.groupBy("content").agg(F.first("body").alias("body"))
    misses = distinct.join(_cached(spark, folder, tokenizer).select("known"), F.col("content") == F.col("known"), "left_anti")
    counted = misses.select("content", "body").mapInArrow(_encode(path), "content string, n_tokens long")
    counted.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(folder)


def token_counts(docs: DataFrame, path: str, *, cache: str | None = None, limit: int = 512,
                 text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text is the empty text, with no bytes and no tokens. Repeated rows are encoded once and keep a row each;
    an empty table gives no rows; other columns of `docs` play no part. `cache` names a folder that all executors
    share and that later runs use again; without it the run starts an empty cache of its own.
    """
    spark = docs.sparkSession
    folder = cache or work_folder(spark, "token-counts")
    open_cache(spark, folder)
    body = F.coalesce(docs[text], F.lit(""))
    add_missing(docs.select(F.sha2(body, 256).alias("content"), body.alias("body")), path, folder)
    rows = docs.select(docs[id_].alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("content"))
    known = _cached(spark, folder, tokenizer_digest(path))
    return rows.join(known, F.col("content") == F.col("known")).select(
        F.col("id").alias(id_), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
