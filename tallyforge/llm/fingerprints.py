"""Document fingerprints by one-permutation MinHash with optimal densification, in SQL functions only.

Each shingle of a text is hashed once. Seven bits of the hash name one of `BINS` bins, which keeps its smallest
value; an empty bin takes the value of the first filled bin in a probe order of its own (a fixed permutation of the
bins), so that two texts that both lack the bin still agree with the probability of their similarity. The low
eight bits of every bin, packed as hex digits, are the fingerprint. Two unrelated bins agree in 1 of 256 cases;
the likeness of two fingerprints is corrected for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ascii_lower, work_folder, written
from tallyforge.llm.sharding import numbered

BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 56
EMPTY = (1 << VALUE_BITS) - 1
CHANCE = 1.0 / 256
SPACE = "\t\n\x0b\x0c\r "


def with_fingerprint(rows: DataFrame, text: str, name: str, words: int = 5) -> DataFrame:
    """`rows` with the fingerprint of column `text` under `name`.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is one
    shingle; a text without words, or null, has the empty fingerprint. Each step is a column of its own, so that
    no lambda repeats the work of an earlier step.
    """
    keep = [F.col(c) for c in rows.columns]
    body = F.trim(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE))
    split = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))
    step = rows.select(*keep, split.alias("_words"))
    count = F.size("_words")
    runs = F.transform(F.sequence(F.lit(0), count - words), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(words)]))
    hashes = F.when(count >= words, runs).when(count > 0, F.array(F.xxhash64(F.lit(words), F.array_join("_words", " ")))).otherwise(
        F.array().cast("array<bigint>"))
    step = step.select(*keep, hashes.alias("_hashes"))
    # bin in front, value behind: sorted, the first of each bin is its smallest; one empty mark a bin stands last
    keyed = F.transform("_hashes", lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), VALUE_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - VALUE_BITS)))
    marks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.shiftleft(b, VALUE_BITS).bitwiseOR(F.lit(EMPTY)))
    step = step.select(*keep, F.sort_array(F.concat(keyed, marks)).alias("_keys"))
    firsts = F.filter("_keys", lambda k, i: (i == 0) | (F.shiftright(k, VALUE_BITS) != F.shiftright(F.get("_keys", i - 1), VALUE_BITS)))
    step = step.select(*keep, F.transform(firsts, lambda k: k.bitwiseAND(F.lit(EMPTY))).alias("_bins"))
    filled = step.select(*keep, "_bins", F.exists("_bins", lambda v: v != EMPTY).alias("_any"))
    # probe j of bin b: (start[b] + j * odd step[b]) mod BINS reaches every bin once
    starts = F.lit([(b * 0x9E3779B1 >> 11) % BINS for b in range(BINS)])
    steps = F.lit([(b * 0x85EBCA77 >> 9) % BINS | 1 for b in range(BINS)])

    def donor(value: Column, b: Column) -> Column:
        def probe(found: Column, j: Column) -> Column:
            return F.when(found != EMPTY, found).otherwise(F.get("_bins", F.pmod(F.get(starts, b) + j * F.get(steps, b), F.lit(BINS))))
        return F.when(value != EMPTY, value).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(EMPTY), probe))

    dense = F.transform("_bins", donor)
    digits = F.transform(dense, lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0"))
    return filled.select(*keep, F.when(F.col("_any"), F.array_join(digits, "")).otherwise("").alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints, 0 to 1: their share of equal bins without the chance hits.

    Two empty fingerprints are alike (1); an empty and another one are not (0).
    """
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, 2 * i + 1, F.lit(2)) == F.substr(b, 2 * i + 1, F.lit(2))))
    corrected = (equal / BINS - CHANCE) / (1 - CHANCE)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), corrected))


def fingerprints(docs: DataFrame, *, text: str = "text", id_: str = "doc_id", words: int = 5) -> DataFrame:
    """id, fingerprint of each row of `docs`. Null text is the empty text; repeated rows keep a row each."""
    rows = docs.select(docs[id_].alias("id"), docs[text].alias("body"))
    return with_fingerprint(rows, "body", "fingerprint", words).select(F.col("id").alias(id_), "fingerprint")


def edited_fingerprints(docs: DataFrame, *, text: str = "text", id_: str = "doc_id", words: int = 5) -> DataFrame:
    """Each row of `docs` beside its edited text: its last half replaced by the start of the next document's text.

    Returns the id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited and near_next. The next document is the
    one with the next smaller id (null ids come last; equal ids are ordered by a hash of the text), and the first follows the
    last. Rows with equal id and text are one document in this order and each get its result; a lone document
    follows itself. Null text is the empty text; an empty table gives no rows; other columns play no part.
    """
    folder = work_folder(docs.sparkSession, "fingerprints")
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id_].alias("id"), F.xxhash64(body).alias("key"), body.alias("body"))
    keys = rows.select("id", "key", F.char_length("body").cast("long").alias("n_chars")).distinct()
    placed = written(numbered(keys, [F.col("id").desc_nulls_last(), F.col("key")], "n_chars", folder), f"{folder}/placed")
    total = placed.agg(F.max("row_at").alias("total"))
    after = placed.crossJoin(F.broadcast(total)).select(  # one row: the number of documents
        F.col("id").alias("own_id"), F.col("key").alias("own_key"), F.floor(F.col("n_chars") / 2).cast("int").alias("taken"),
        F.when(F.col("row_at") == F.col("total"), 1).otherwise(F.col("row_at") + 1).alias("next_at"))
    chained = after.join(placed.select("id", "key", "row_at"), F.col("next_at") == F.col("row_at")).select(
        F.col("id").alias("next_id"), F.col("key").alias("next_key"), "own_id", "own_key", "taken")
    marked = with_fingerprint(rows, "body", "fingerprint", words)
    # the text moves once by its own key; the part that the document before needs moves on from there
    given = marked.join(chained, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("key") == F.col("next_key"))).select(
        "own_id", "own_key", F.substr("body", F.lit(1), F.col("taken")).alias("part"), F.col("fingerprint").alias("next_fingerprint"))
    given = given.dropDuplicates(["own_id", "own_key"])
    both = marked.join(given, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")))
    count = F.char_length("body")
    both = both.select("id", count.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
                       F.concat(F.substr("body", F.lit(1), count - F.floor(count / 2).cast("int")), "part").alias("edited"))
    both = with_fingerprint(both, "edited", "edited_fingerprint", words)
    return both.select(F.col("id").alias(id_), "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
