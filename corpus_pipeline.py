"""From documents to token ids: the stages of a training-data run, each read from the Parquet of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import byte_bpe, exact_dedup, language, minhash_dedup, mixing
from tallyforge.llm.common import work_folder, written
from tallyforge.llm.queries import PATTERN, PIECES, TIKTOKEN

#: The stages classify, fit and encode; SQL cannot say them. tests/llm compares a run with a brute-force one.
ORACLE_SQL = None
#: A document whose best language has less than this posterior is of no known language.
SURE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of a learned language; null texts, texts without letters and undecided ones go.

    So do texts that are far less likely, letter by letter, under their best language than its labelled texts are.
    Rows without a label are judged like all others, and no row's own label is an input of its prediction.
    """
    predicted = language.predict(docs, language.train(docs, PIECES))
    return predicted.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE) & F.col("usual")).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal but for the case of A-Z: the one with the largest id."""
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (word shingles of five, similarity 0.8): the one with the smallest id."""
    return minhash_dedup.one_of_each(docs, words=5, similarity=80)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates of their domains ask for: some not at all, some more than once."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text that the ids decode to."""
    encoded = byte_bpe.encode(docs, TIKTOKEN, PATTERN, ids="token_ids", decoded="decoded_bytes")
    return (encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))
            .withColumn("decoded_text", F.decode("decoded_bytes", "UTF-8")).drop("decoded_bytes"))


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_to_weights),
    ("byte-level BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs
