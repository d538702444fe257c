"""Benchmark passages in training documents: an FM-index for each shard of documents, searched for test phrases.

1. `indexed` turns the documents into a table of shards, one row each: about `SHARD_BYTES` of text, or one longer text.
   Equal texts of a shard are indexed once. The table is built once and serves any number of test sets.
2. The test items come in blocks of at most `BLOCK_BYTES` of text (or one longer item). Their phrases are the windows of
   `WINDOW` words; an item with fewer words is one phrase. Each block is searched backwards in each shard, for all of
   its phrases at once, and the occurrences are located by sampled positions and merged to spans.
3. The spans that several blocks find in a document are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import work_folder, written
from tallyforge.llm.fm_index import Shard, split_words
from tallyforge.llm.pieces import slices

WINDOW = 10
SHARD_BYTES = 4_000_000
BLOCK_BYTES = 8_000_000
#: Occurrences that are located at a time.
ROWS = 500_000

_PARTS = ["vocabulary", "starts", "planes", "counts", "marks", "kept"]
_DOCS = pa.list_(pa.struct([("id", pa.int64()), ("words", pa.int64()), ("text", pa.int32())]))
INDEX = "shard long, docs array<struct<id: long, words: long, text: int>>, " + ", ".join(f"{c} binary" for c in _PARTS)
HITS = "shard long, place int, spans array<struct<start: long, stop: long>>, items array<string>"


def indexed(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The shards of `docs`. `docs.text` is the number of a document's text in its shard, null for one without words."""
    rows = docs.select(F.coalesce(docs[text], F.lit("")).cast("binary").alias("body"), docs[id_].cast("long").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs_, texts, known, held = [], [], {}, 0

        def done() -> pa.RecordBatch:
            parts = Shard.built(texts).packed() if texts else dict.fromkeys(_PARTS)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([docs_], _DOCS),
                                               *[pa.array([parts[c]], pa.binary()) for c in _PARTS]], ["shard", "docs", *_PARTS])

        for part in slices(batches, 0):
            for body, doc in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if docs_ and held + len(body) > SHARD_BYTES:
                    yield done()
                    number, docs_, texts, known, held = number + 1, [], [], {}, 0
                digest = hashlib.blake2b(body, digest_size=16).digest()
                if digest not in known:
                    words = split_words(body)
                    known[digest] = (len(words), len(texts) if words else None)
                    if words:
                        texts.append(words)
                        held += len(body)
                held += 16
                docs_.append((doc, *known[digest]))
        if docs_:
            yield done()

    return rows.mapInArrow(run, INDEX)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + len(row.body) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item, bytes(row.body)))
        held += len(row.body)
    if block:
        yield block


class Phrases:
    """The distinct phrases of a block of items, as rows of numbers of the block's words, and the items of each."""

    def __init__(self, block: list[tuple[str, bytes]], window: int) -> None:
        number: dict[bytes, int] = {}
        phrases: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for item, body in block:
            words = [number.setdefault(w, len(number)) for w in split_words(body)]
            for i in range(max(len(words) - window + 1, 1 if words else 0)):
                phrases.setdefault(tuple(words[i:i + window]), set()).add(names.setdefault(item, len(names)))
        self.words, self.items = list(number), list(names)
        self.sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.rows = np.full((len(phrases), window), -1, np.int64)
        for at, phrase in enumerate(phrases):
            self.rows[at, window - len(phrase):] = phrase
        self.owners = [np.fromiter(v, np.int64, len(v)) for v in phrases.values()]

    def hits(self, shard: Shard) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
        """By text of the shard: the merged spans of words that phrases cover, and the items that own the phrases."""
        mine = np.fromiter((shard.vocabulary.get(w, -1) for w in self.words), np.int64, len(self.words))
        if not len(self.words):
            return {}
        low, high = shard.find(np.where(self.rows >= 0, mine[self.rows], -1), self.sizes)
        found = np.flatnonzero(low < high)
        counts = high[found] - low[found]
        cover = np.zeros(int(shard.starts[-1]) + 1, np.int32)
        owned: set[tuple[int, int]] = set()
        ends = np.cumsum(counts)
        for start in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
            turn = np.arange(start, min(start + ROWS, int(ends[-1])))
            which = np.searchsorted(ends, turn, "right")
            phrase = found[which]
            at = shard.locate(low[phrase] + turn - (ends[which] - counts[which]))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.sizes[phrase], -1)
            text = np.searchsorted(shard.starts, at, "right") - 1
            for t, p in np.unique(np.column_stack((text, phrase)), axis=0).tolist():
                owned.update((t, item) for item in self.owners[p].tolist())
        inside = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        out: dict[int, tuple[list[tuple[int, int]], list[str]]] = {}
        for start, stop in edges.reshape(-1, 2).tolist():  # an end mark is never covered, so no span leaves its text
            text = int(np.searchsorted(shard.starts, start, "right")) - 1
            first = int(shard.starts[text])
            out.setdefault(text, ([], []))[0].append((start - first, stop - first))
        for text, item in owned:
            out[text][1].append(self.items[item])
        return out


def _searched(index: DataFrame, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    """(shard, place, spans, items) of the documents of the index in which phrases of the block occur."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    rows = index.where("vocabulary is not null").select("shard", F.transform("docs", lambda d: d["text"]).alias("texts"), *_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for batch in batches:
            phrases = phrases or Phrases(sent.value, window)
            for i in range(batch.num_rows):
                held = phrases.hits(Shard.unpacked(*(batch.column(2 + k)[i].as_py() for k in range(len(_PARTS)))))
                places = [(p, held[t]) for p, t in enumerate(batch.column(1)[i].as_py()) if t in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(places), pa.int64()), pa.array([p for p, _ in places], pa.int32()),
                     pa.array([spans for _, (spans, _) in places], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                     pa.array([items for _, (_, items) in places], pa.list_(pa.string()))], ["shard", "place", "spans", "items"])

    return rows.mapInArrow(run, HITS)


def contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text: str = "text", id_: str = "doc_id",
                 item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_hit, spans, items, contaminated.

    Words are runs of ASCII letters and digits and of characters outside ASCII, A-Z lower-cased; null and empty texts
    have none. A word is hit that lies in an occurrence of `window` consecutive words of an item, or of all words of an
    item with fewer; an item without words is nowhere. `spans` are the maximal runs of hit words (start, stop), `items`
    the ids of the items with an occurrence, as strings in their order. Item rows with one id are one item; a null id
    counts as the empty string. Rows that repeat a document keep a row each. An empty table of documents gives no rows,
    one of items hits nothing; other columns play no part.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "decontamination")
    index = written(indexed(docs, text, id_), f"{folder}/index")
    listed = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"),
                          F.coalesce(items[item_text], F.lit("")).cast("binary").alias("body"))
    hits = None
    for number, block in enumerate(_blocks(written(listed.distinct(), f"{folder}/items"), block_bytes)):
        found = written(_searched(index, block, window), f"{folder}/hits{number}")
        hits = found if hits is None else hits.unionByName(found)
    rows = index.select("shard", F.posexplode("docs").alias("place", "doc")).select("shard", "place", "doc.id", "doc.words")
    if hits is None:
        hits = spark.createDataFrame([], HITS)
    merged = hits.groupBy("shard", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"),
                                                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grown = F.aggregate("found", F.array().cast("array<struct<start:long,stop:long>>"), _joined)
    out = rows.join(merged, ["shard", "place"], "left").withColumn("spans", F.coalesce(grown, F.array().cast("array<struct<start:long,stop:long>>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(F.col("id").alias("doc_id"), F.col("words").alias("n_words"), n_hit.alias("n_hit"), "spans",
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.size("spans") > 0).alias("contaminated"))


def _joined(spans, span):
    """Spans in order, with one more that starts no earlier: it grows the last one if they meet."""
    last = F.try_element_at(spans, F.lit(-1))
    longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
    return F.when(span["start"] <= last["stop"], F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer))).otherwise(
        F.concat(spans, F.array(span)))
