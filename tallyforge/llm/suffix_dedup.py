"""Removal of every byte that lies in a repeated string of `LENGTH` bytes, found by suffix sorting.

No task can hold the suffix array of a corpus, so the suffixes are dealt out by what repeated strings must share:

1. In each run of `LENGTH` bytes the `GRAM`-byte gram with the smallest hash is an anchor. Two equal strings of
   `LENGTH` bytes have the same anchors at the same places, so anchors whose gram occurs once are done with.
2. A string belongs to one anchor; around an anchor lie all its strings: its context. Contexts with the same bytes are
   counted as one. A context that occurs twice is repeated as a whole.
3. Different contexts of one gram are suffix-sorted together. They are aligned at the gram, and matches run outwards
   from it, so the bytes of a context between the columns where others part from it are one symbol, and what it
   shares with none is left out. The linear grouping construction sorts the suffixes of these short strings; the longest common prefix with the neighbours,
   in bytes, says which strings of `LENGTH` bytes start elsewhere too.
4. The covered bytes of all contexts of a document are joined and cut out.

A gram with more than `GROUP` different contexts is not sorted in one task: each of its strings of `LENGTH` bytes is
counted by digest instead, over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import parts, work_folder, written
from tallyforge.llm.pieces import slices
from tallyforge.llm.suffix_order import common_prefixes, suffix_array

LENGTH = 400
GROUP = 20_000
SEGMENT = 1 << 20
BASE = 0x5851F42D4C957F2D | 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of the base and of its inverse."""
    byte = np.random.default_rng(400).integers(0, 2**64, 256, np.uint64)
    inverse = pow(BASE, -1, 2**64)
    powers = np.repeat(np.array([[BASE], [inverse]], np.uint64), SEGMENT + 1, axis=1)
    powers[:, 0] = 1
    up, down = np.cumprod(powers, axis=1, dtype=np.uint64)
    return byte, up, down


def _sliding(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over each run of `width` values, through running values of blocks from both ends."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, values[-1])]).reshape(-1, width)
    ahead = ufunc.accumulate(padded, axis=1).ravel()
    behind = ufunc.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: bytes, length: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Positions of the anchors of `data`, the hashes of their grams, and where their contexts begin and end.

    A string belongs to the first of its smallest grams, so each string lies in one context: that of an anchor
    reaches from the first to the last string that belongs to it. Whichever gram stands nearest before or behind and
    takes strings from an anchor is itself the smallest of some string, so the anchors alone tell the borders.
    """
    gram = length // 2
    width = length - gram + 1  # grams in a run of `length` bytes
    byte, up, down = _tables()
    found: dict[int, int] = {}
    step = SEGMENT - length
    for start in range(0, max(1, len(data) - length + 1), step):
        piece = np.frombuffer(data, np.uint8)[start:start + SEGMENT - 1]
        if len(piece) < length:
            break
        sums = np.concatenate([[np.uint64(0)], np.cumsum(byte[piece] * down[:len(piece)], dtype=np.uint64)])
        value = (sums[gram:] - sums[:-gram]) * up[:len(piece) - gram + 1]
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        least = _sliding(value, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == value)
        found.update(zip((chosen + start).tolist(), value[chosen].tolist(), strict=True))
    where = sorted(found)
    values = [found[at] for at in where]
    first, last = [0] * len(where), [0] * len(where)
    waiting: list[int] = []  # anchors with no smaller one behind them so far, in rising order of their hash
    for i, (at, value) in enumerate(zip(where, values, strict=True)):
        while waiting and values[waiting[-1]] > value:
            last[waiting[-1]] = min(where[waiting[-1]], at - width)
            waiting.pop()
        first[i] = max(0, at - width + 1, where[waiting[-1]] + 1 if waiting else 0)
        waiting.append(i)
    for i in waiting:
        last[i] = min(where[i], len(data) - length)
    kept = [i for i in range(len(where)) if first[i] <= last[i]]
    return [where[i] for i in kept], [values[i] for i in kept], [first[i] for i in kept], [last[i] + length for i in kept]


ROWS = "id {id}, key long, gram long, at long, before int, size int, c1 long, c2 long"


def _occurrences(length: int):
    """One row for each anchor: its gram, place, and the digest of its context (which starts `before` bytes earlier)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            owner: list[int] = []
            where: list[int] = []
            grams: list[int] = []
            begins: list[int] = []
            ends: list[int] = []
            digests: list[bytes] = []
            for row, text in enumerate(part.column(0).to_pylist()):
                data = text.encode()
                found = anchors(data, length)
                for held, new in zip((where, grams, begins, ends), found, strict=True):
                    held += new
                owner += [row] * len(found[0])
                digests += [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(*found[2:], strict=True)]
            at, begin, end = np.array(where, np.int64), np.array(begins, np.int64), np.array(ends, np.int64)
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(owner, pa.int64())
            columns = [np.array(grams, np.uint64).view(np.int64), at, (at - begin).astype(np.int32), (end - begin).astype(np.int32),
                       digest[:, 0].copy(), digest[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([part.column(1).take(rows), part.column(2).take(rows), *map(pa.array, columns)],
                                             ["id", "key", "gram", "at", "before", "size", "c1", "c2"])
    return run


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _parting(sides: list[bytes]) -> list[list[int]]:
    """For each string, in rising order, the lengths at which some other one parts from it.

    In sorted order these are the running minima of the neighbours' common prefixes, to both sides. Two strings
    have the same lengths up to the one at which they part from each other.
    """
    order = sorted(range(len(sides)), key=sides.__getitem__)
    near = [_shared(sides[i], sides[j]) for i, j in zip(order[:-1], order[1:], strict=True)]
    out: list[set[int]] = [set() for _ in sides]
    for run, line in ((near, order), (near[::-1], order[::-1])):
        minima: list[int] = []
        for i, common in zip(line[1:], run, strict=True):
            while minima and minima[-1] >= common:
                minima.pop()
            minima.append(common)
            out[i].update(minima)
    return [sorted(lengths) for lengths in out]


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(contexts: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each of the different (bytes, bytes before the gram): the spans covered by strings that another one has too."""
    right = _parting([data[before:] for data, before in contexts])
    left = _parting([data[:before][::-1] for data, before in contexts])
    names: dict[tuple[int, bytes], int] = {}
    text: list[int] = []
    starts: list[int] = []  # byte in its context at which each symbol starts
    spans: list[tuple[int, int]] = []  # symbols of each context
    for number, (data, before) in enumerate(contexts):
        first = len(text)
        if left[number][-1] + right[number][-1] >= length:  # else no other context shares enough with this one
            cuts = [before - x for x in reversed(left[number])] + [before + x for x in right[number] if x]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                text.append(len(contexts) + names.setdefault((a - before, data[a:b]), len(names)))
                starts.append(a)
            spans.append((first, len(text)))
            text.append(number)  # an end of its own, lower than all blocks
            starts.append(cuts[-1])
        else:
            spans.append((first, first))
    order = suffix_array(text)
    shared = common_prefixes(text, order) + [0]
    longest = [0] * len(text)
    for place, at in enumerate(order):
        symbols = max(shared[place], shared[place + 1])
        if symbols:
            longest[at] = starts[at + symbols] - starts[at]
    out = []
    for first, last in spans:
        covered = []
        for at in range(first, last):
            if longest[at] >= length:
                more = min(starts[at + 1] - starts[at] - 1, longest[at] - length)
                covered.append((starts[at], starts[at] + more + length))
        out.append(_join(covered))
    return out


def _sort_groups(length: int):
    """Batches of contexts in order of their gram -> spans relative to each context's start."""

    def of(held: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
        found = repeated_spans([(data, before) for _, _, _, before, data in held], length)
        for (gram, c1, c2, _, _), spans in zip(held, found, strict=True):
            for a, b in spans:
                yield gram, c1, c2, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[0][0] != row[0]:
                    out += of(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        out += of(held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, wanted contexts) -> the bytes of each context."""
    schema = pa.schema([("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("hot", pa.bool_()), ("n", pa.int64()),
                        ("before", pa.int32()), ("data", pa.binary())])
    for part in slices(batches, 0):
        rows = []
        for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            data = text.encode()
            for w in wanted:
                first = w["at"] - w["before"]
                rows.append((w["gram"], w["c1"], w["c2"], w["hot"], w["n"], w["before"], data[first:first + w["size"]]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _strings(length: int):
    """Contexts -> a row for each string of `length` bytes in them, by digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("string", pa.binary()), ("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for row in range(batch.num_rows):
                gram, c1, c2, n, data = (batch.column(i)[row].as_py() for i in range(5))
                count = max(0, len(data) - length + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(count)], pa.binary()),
                     pa.array([gram] * count, pa.int64()), pa.array([c1] * count, pa.int64()), pa.array([c2] * count, pa.int64()),
                     pa.array(range(count), pa.int32()), pa.array([n] * count, pa.int64())], schema=schema)
    return run


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                data, at, left = text.encode(), 0, []
                joined = _join([(s["a"], s["b"]) for s in spans or []])
                for a, b in joined:
                    left.append(data[at:a])
                    at = b
                kept.append(b"".join([*left, data[at:]]))
                sizes.append(len(data))
                counts.append(len(joined))
                removed.append(len(data) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, group: int = GROUP, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: its id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes).

    Each byte of the UTF-8 text that lies in a string of `length` bytes which also starts anywhere else, in this or another
    row, is removed; strings are judged on the input and never cross rows. Null text is the empty text; texts shorter
    than `length` stay whole; repeated rows (equal id and text too) are repeats of each other and lose all strings;
    an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "suffix-dedup")
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id_].alias("id"), F.xxhash64(body).alias("key"), body.alias("body"))
    kind = dict(rows.dtypes)["id"]
    long_ = rows.where(F.octet_length("body") >= length).select("body", "id", "key")
    found = written(long_.mapInArrow(_occurrences(length), ROWS.format(id=kind)), f"{folder}/anchors")
    common = found.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    found = written(found.join(common, "gram"), f"{folder}/repeated")

    contexts = found.groupBy("gram", "c1", "c2").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "key", "at", "before", "size")).alias("r"))
    contexts = written(contexts.select("gram", "c1", "c2", "n", "r.*"), f"{folder}/contexts")
    whole = contexts.where((F.col("n") > 1) & (F.col("size") >= length)).select(
        "gram", "c1", "c2", F.lit(0).alias("a"), F.col("size").alias("b"))
    mixed = contexts.groupBy("gram").agg(F.count("*").alias("different"), F.min("n").alias("least")).where("different > 1 and least = 1")
    sorted_ = contexts.join(mixed, "gram").withColumn("hot", F.col("different") > group)
    wanted = sorted_.groupBy(F.col("id").alias("w_id"), F.col("key").alias("w_key")).agg(
        F.collect_list(F.struct("gram", "c1", "c2", "hot", "n", "at", "before", "size")).alias("wanted"))
    near = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))
    data = rows.join(wanted, near).select("body", "wanted").mapInArrow(
        _extract, "gram long, c1 long, c2 long, hot boolean, n long, before int, data binary")
    data = written(data, f"{folder}/data").dropDuplicates(["gram", "c1", "c2"])  # an id and text may stand in many rows

    spans = data.where("not hot").select("gram", "c1", "c2", "before", "data")
    spans = spans.repartition(parts(spark), "gram").sortWithinPartitions("gram").mapInArrow(
        _sort_groups(length), "gram long, c1 long, c2 long, a int, b int")
    strings = data.where("hot").select("gram", "c1", "c2", "n", "data").mapInArrow(
        _strings(length), "string binary, gram long, c1 long, c2 long, a int, n long")
    again = strings.groupBy("string").agg(F.sum("n").alias("all")).where("all > 1").select("string")
    spans_hot = strings.join(again, "string").select("gram", "c1", "c2", "a", (F.col("a") + length).alias("b"))
    spans = written(whole.unionByName(spans).unionByName(spans_hot), f"{folder}/spans")

    in_docs = found.join(spans, ["gram", "c1", "c2"]).select(
        F.col("id").alias("s_id"), F.col("key").alias("s_key"), F.struct(
            (F.col("at") - F.col("before") + F.col("a")).alias("a"), (F.col("at") - F.col("before") + F.col("b")).alias("b")).alias("span"))
    in_docs = in_docs.groupBy("s_id", "s_key").agg(F.collect_set("span").alias("spans"))
    marked = rows.join(in_docs, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left").select("body", "id", "spans")
    out = marked.mapInArrow(_cut(), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_)
