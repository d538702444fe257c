"""Byte-level BPE over a rank file: numpy merges of many pieces at once, and decoding.

Text is split by the tokenizer's pattern; each match becomes a row of byte ids in a padded matrix of rows of
like length. In each round every open row merges its leftmost pair of least rank: a hash table from pairs of ids
to ranks gives the two pairs that the merge changes, and the row closes the gap. Rows without a known pair
leave the matrix. Very long rows keep their pairs in blocks with a minimum each instead, merging in the same order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import HashTable
from tallyforge.llm.pieces import Memo, cut, slices

NONE = np.int32(2**31 - 1)
LONG = 1024
CELLS = 400_000


class Vocabulary:
    """Ranks, pairs that merge, and the bytes of each id, from a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[token[:i]] << 32) | ranks[token[i:]]: rank for token, rank in ranks.items()
                 for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.pairs = HashTable(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)), int(NONE))
        by_rank = sorted(ranks.items(), key=lambda item: item[1])
        self.sizes = np.zeros(by_rank[-1][1] + 1, np.int64)
        self.sizes[[rank for _, rank in by_rank]] = [len(token) for token, _ in by_rank]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(token for token, _ in by_rank), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it doesn't merge or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64)
        return self.pairs.get(keys)

    # encoding

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each merged for itself, one word after the other; and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        data = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        counts = sizes.copy()
        width = np.where(sizes <= 16, sizes, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        order = np.argsort(width, kind="stable")
        for bucket in np.split(order, np.flatnonzero(np.diff(width[order])) + 1):
            wide = int(width[bucket[0]]) if len(bucket) else 0
            if wide < 2:
                continue
            if wide > LONG:
                for at in bucket:
                    merged = self._merge_long(data[starts[at]:starts[at] + sizes[at]])
                    counts[at] = len(merged)
                    data[starts[at]:starts[at] + len(merged)] = merged
                continue
            rows = max(1, CELLS // wide)
            for i in range(0, len(bucket), rows):
                part = bucket[i:i + rows]
                counts[part] = self._merge_rows(data, starts[part], sizes[part], wide)
        ends = np.cumsum(counts)
        return data[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Merge the rows that begin at `starts` in `data`, write their ids there, and return how many each has."""
        at = np.arange(len(starts))
        counts = size.copy()
        inside = np.arange(width + 1) < size[:, None]
        ids = np.full((len(at), width + 1), -1, np.int32)
        ids[inside] = data[(starts[:, None] + np.arange(width + 1))[inside]]
        ranks = np.full(ids.shape, NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(at), width)
        column = np.arange(width + 1)
        while True:
            best = ranks.argmin(axis=1)
            rows = np.arange(len(at))
            least = ranks[rows, best]
            done = least == NONE
            if done.any():
                inside = column < size[done][:, None]
                data[(starts[at[done]][:, None] + column)[inside]] = ids[done][inside]
                counts[at[done]] = size[done]
                keep = ~done
                if not keep.any():
                    return counts
                ids, ranks, size, at, best, least = ids[keep], ranks[keep], size[keep], at[keep], best[keep], least[keep]
                rows = np.arange(len(at))
            gap = column[:-1] > best[:, None]  # what lies right of the pair's left half moves up by one
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=gap)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=gap)
            ids[rows, best] = least
            size = size - 1
            longest = int(size.max())
            if longest + 1 < ids.shape[1]:
                ids, ranks, column = ids[:, :longest + 1], ranks[:, :longest + 1], column[:longest + 1]
            ids[rows, size] = -1
            ranks[rows, best] = self.rank(least, ids[rows, best + 1])
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.rank(ids[before, best[before] - 1], least[before])
            ranks[rows, size] = NONE

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: the leftmost least pair is found through block minima, neighbours through links."""
        n = len(ids)
        block = int(np.sqrt(n)) + 1
        ids = ids.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(block * block, NONE, np.int32)
        ranks[:n - 1] = self.rank(ids[:-1], ids[1:])
        table = ranks.reshape(block, block)
        least = table.min(axis=1)
        alive = np.ones(n, bool)
        while True:
            row = int(least.argmin())
            if least[row] == NONE:
                return ids[alive]
            at = row * block + int(table[row].argmin())
            gone = int(after[at])
            right, left = int(after[gone]), int(before[at])
            ids[at], alive[gone], after[at] = ranks[at], False, right
            if right < n:
                before[right] = at
            new = self.rank(np.array([ids[left] if left >= 0 else -1, ids[at]]), np.array([ids[at], ids[right] if right < n else -1]))
            ranks[gone], ranks[at] = NONE, new[1]
            if left >= 0:
                ranks[left] = new[0]
            for touched in {at // block, gone // block, max(left, 0) // block}:
                least[touched] = table[touched].min()

    def _encode_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, one after the other, and how many each has; each distinct match is merged once."""
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(m, len(number)) for m in matches), np.int64, len(matches))
        flat, counts = self.encode([word.encode() for word in number])
        starts, sizes = (np.cumsum(counts) - counts)[which], counts[which]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode_pieces(self, pieces: list[str], lead: str = "") -> list[bytes]:
        """Ids of `lead` + each piece, as the bytes of an int32 array.

        With a space in front, pieces that don't end in white space split the same when they stand in a row, so
        the pattern runs over all of them at once.
        """
        joined = [i for i, p in enumerate(pieces) if p and not p[-1].isspace()] if lead == " " else []
        single = sorted(set(range(len(pieces))).difference(joined))
        matches = self.pattern.findall(lead + lead.join([pieces[i] for i in joined])) if joined else []
        letters = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        piece_ends = np.cumsum(np.fromiter((len(pieces[i]) + 1 for i in joined), np.int64, len(joined)))
        rest = [self.pattern.findall(lead + pieces[i]) for i in single]
        ends = np.concatenate([np.searchsorted(letters, piece_ends) + 1, len(matches) + np.cumsum([len(m) for m in rest], dtype=np.int64)])
        flat, counts = self._encode_matches(matches + list(chain.from_iterable(rest)))
        stops = 4 * np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])]
        body, out = flat.tobytes(), [b""] * len(pieces)
        for i, a, b in zip(joined + single, stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            out[i] = body[a:b]
        return out

    # decoding

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)]


    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
        """The bytes of each row, whose ids lie between successive `ends`."""
        stops = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(stops), pa.py_buffer(self.decode(ids))])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


@lru_cache(maxsize=2)
def _memos(path: str, pattern: str) -> tuple[Memo, Memo]:
    words = vocabulary(path, pattern)
    return Memo(words.encode_pieces, 1_000), Memo(lambda pieces: words.encode_pieces(pieces, " "))


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Ids of each text as the bytes of an int32 array."""
    first, after = _memos(path, pattern)
    pieces = [cut(text) for text in texts]
    heads = [p.pop(0) for p in pieces]
    first.learn(heads)
    after.learn(chain.from_iterable(pieces))
    return [first[head] + b"".join(map(after.__getitem__, rest)) for head, rest in zip(heads, pieces, strict=True)]


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the token ids of its text (array<int>) under `ids`, which replaces a column of that name.

    Null text counts as empty: no ids. Repeated rows keep a row each, an empty table gives no rows, texts of any
    length are encoded whole, and other columns pass through unchanged. With a name in `decoded` the ids are
    decoded in the same pass, into a binary column of that name.
    """
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("body"), F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()), rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for part in slices(batches, 0):
            encoded = encode_texts(part.column(0).to_pylist(), path, pattern)
            flat = np.frombuffer(b"".join(encoded), np.int32)
            ends = np.cumsum([0, *[len(e) // 4 for e in encoded]])
            back = words.decode_rows(flat, ends) if decoded else pa.nulls(len(encoded), pa.binary())
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([lists, back, part.column(1)], ["ids", "decoded", "row"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("ids").alias(ids),
                      *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(docs: DataFrame, path: str, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` with the bytes that its ids stand for (binary) under `decoded`, which replaces a column of that name.

    Null ids decode to no bytes. An id outside the vocabulary is an error.
    """
    kept = [c for c in docs.columns if c != decoded]
    rows = docs.select(F.coalesce(docs[ids], F.array().cast("array<int>")).alias("ids"), F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"))
    schema = T.StructType([T.StructField("decoded", T.BinaryType()), rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(0)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
                out = words.decode_rows(flat, np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([out, part.column(1)], ["decoded", "row"])

    return rows.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("decoded").alias(decoded))
