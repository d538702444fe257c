"""Texts as pieces that a tokenizer treats independently, and a bounded memo of what is known of a piece."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

_RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?= \S)")
SLICE_BYTES = 4_000_000
MEMO_ENTRIES = 250_000
MEMO_CHARS = 200


def cut(text: str) -> list[str]:
    """The text before its first inner single space, then what follows each such space (the space is left out).

    A single space between two other characters that are no white space always starts a new token in the
    byte-level patterns, so ` ` + piece can be encoded by itself. All other white space stays inside a piece.
    """
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
    if odd or _RARE_SPACE.search(text):
        first, *rest = _CUT.split(text)
        return [first, *[piece[1:] for piece in rest]]
    return text.split(" ")


class Memo(dict):
    """Known values of pieces, bounded: when full, only what the texts at hand use stays. Long pieces are not kept."""

    def __init__(self, work_out: Callable[[list[str]], Iterable], limit: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.work_out, self.limit, self.long = work_out, limit, []

    def learn(self, pieces: Iterable[str]) -> None:
        """After this every piece of `pieces` is known, until the next call."""
        for piece in self.long:
            self.pop(piece, None)
        wanted = set(pieces)
        if len(self) + len(wanted) > self.limit:
            used = {piece: self[piece] for piece in wanted if piece in self}
            self.clear()
            self.update(used)
        new = [piece for piece in wanted if piece not in self]
        self.update(zip(new, self.work_out(new), strict=True))
        self.long = [piece for piece in new if len(piece) > MEMO_CHARS]


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes of text at a time; a longer text comes alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
