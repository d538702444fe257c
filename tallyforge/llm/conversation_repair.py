"""Faults of conversations and their cheapest repair, at any length of a conversation.

1. Equal rows of a conversation are counted as one, and the first row of each role and text in it is found in two
   steps, so that no step gathers all turns that say the same.
2. The rows are laid out by range over (conversation, turn), which splits a long conversation over tasks. A task turns
   its rows into pieces of at most `PIECE` symbols, with the counts of their faults and what stands at their borders.
3. Each distinct piece is solved once for all conversations that have it: see `structure`.
4. The pieces of a conversation are folded in order, which gives the least cost and its audit; the rows of the
   conversation then pass by in order, and the audit says what becomes of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import structure
from tallyforge.llm.common import parts, work_folder, written

PIECE = 2048
#: Symbols for which one grammar is built.
AT_ONCE = 200_000
SHARES = 32
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows broken by the checksum of their place: dropped, emptied, unpunctuated, repeated or given to the user."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("break", (F.crc32(place) % 20).cast("int")).where("`break` <> 0")
    text = F.when(F.col("break") == 1, "").when(F.col("break") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("break") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("break") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _taken(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and the text's digest; rows are ordered by turn (nulls first), role and digest."""
    c = conversations
    text = F.coalesce(c["text"].cast("string"), F.lit(" "))
    return c.select(c["conv_id"].alias("conv"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit(" ")).alias("role"),
                    text.alias("text"), F.md5(text).alias("digest"))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, n (equal rows), initial, fault (b, d, t or empty) of the first of them."""
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    looked = rows.select("conv", "turn", "role", "digest", (ended == "").alias("blank"),
                         (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"))
    once = looked.groupBy("conv", "turn", "role", "digest", "blank", "open").agg(F.count("*").alias("n"))
    same = [F.col("conv"), F.col("role"), F.col("digest")]
    share = F.pmod(F.xxhash64("turn"), F.lit(SHARES)).cast("int")
    early = once.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy(*same, "share").orderBy("turn")))
    # only the first of a share can be the first of all
    early = early.withColumn("share", F.when(F.col("at") == 1, -1).otherwise(F.col("share")))
    early = early.withColumn("at", F.row_number().over(Window.partitionBy(*same, "share").orderBy("turn")))
    seen = (F.col("share") >= 0) | (F.col("at") > 1)
    initial = F.left("role", F.lit(1))
    fault = F.when(F.col("blank"), "b").when(seen, "d").when(F.col("open"), "t").otherwise("")
    return early.select("conv", "turn", "role", "digest", "n", F.when(initial.isin(*"sua"), initial).otherwise("x").alias("initial"),
                        fault.alias("fault"))


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _grouped(rows: Iterable[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that agree in their first `width` values, as they follow each other; a group must be used up before the next."""
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        key = row[:width]

        def same() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:width] == key:  # noqa: B023 - used up within its turn
                now, row = row, next(rows, None)
                yield now[width:]

        yield key, same()


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Piece:
    """What is gathered of consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.symbols, self.size = [], 0
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = ""
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str, n: int) -> None:
        self.symbols.append(structure.MUST_GO * n if fault in ("b", "d") else initial.upper() if fault == "t" else initial)
        self.size += n
        self.blank += n * (fault == "b")
        self.duplicate += n * (fault == "d")
        self.truncated += n * (fault == "t")
        self.illegal += (n - 1) + (bool(self.last_initial) and self.last_initial + initial not in LEGAL)
        self.first_initial, self.last_initial = self.first_initial or initial, initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn

    def row(self) -> tuple:
        return ("".join(self.symbols), self.first_turn, self.last_turn, self.turns, self.first_initial, self.last_initial,
                self.blank, self.duplicate, self.truncated, self.illegal)


_PIECE_COLUMNS = ("symbols string, first_turn long, last_turn long, turns long, first_initial string, last_initial string, "
                  "blank long, duplicate long, truncated long, illegal long")


def _arrow(columns: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))]


def _streamed(out: Callable[[Iterable[tuple]], Iterable[tuple]], columns: str) -> Callable:
    """A function for mapInArrow from rows in order to rows that start with the conversation, in its own type."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([pa.field("conv", first.schema.field(0).type), *_arrow(columns)])
            yield from _batches(out(_tuples(chain([first], batches))), schema)

    return run


def _pieces(rows: DataFrame) -> DataFrame:
    """The pieces of the conversations, numbered in their order (part, piece)."""
    order = ["conv", "turn", "role", "digest"]
    laid_out = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    conv = rows.schema["conv"].dataType

    def out(stream: Iterable[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for (key,), group in _grouped(stream, 1):
            number, piece = 0, _Piece()
            for turn, _, _, n, initial, fault in group:
                # of equal rows all but the first are duplicates, unless they are blank
                for kind, left in [(fault, n)] if fault in ("b", "d") else [(fault, 1), ("d", n - 1)]:
                    while left:
                        if piece.size == PIECE:
                            yield (key, part, number, *piece.row())
                            number, piece = number + 1, _Piece()
                        now = min(left, PIECE - piece.size)
                        piece.add(turn, initial, kind, now)
                        left -= now
            yield (key, part, number, *piece.row())

    columns = "part int, piece int, " + _PIECE_COLUMNS
    return laid_out.select("conv", "turn", "role", "digest", "n", "initial", "fault").mapInArrow(
        _streamed(out, columns), f"conv {conv.simpleString()}, {columns}")


def _solved(pieces: DataFrame) -> DataFrame:
    """symbols, costs, audits: the transfer matrix of each distinct piece, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[str]) -> pa.RecordBatch:
            entries = [[entry for line in matrix for entry in line] for matrix in structure.matrices(held)]
            return pa.RecordBatch.from_arrays(
                [pa.array(held), pa.array([[e and e[0] for e in m] for m in entries], pa.list_(pa.int64())),
                 pa.array([[e and structure.flat(e[1]) for e in m] for m in entries], pa.list_(pa.string()))], ["symbols", "costs", "audits"])

        held, size = [], 0
        for (symbols,) in _tuples(batches):
            held.append(symbols)
            size += len(symbols)
            if size >= AT_ONCE:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return pieces.select("symbols").distinct().mapInArrow(run, "symbols string, costs array<long>, audits array<string>")


def _fold(group: Iterable[tuple]) -> tuple:
    """gaps, faults, illegal neighbours, cost and audit of a conversation from its pieces in order."""
    vector = [structure.EMPTY[0]] + [[None] * 4] * 3
    low = high = initial = None
    turns = blank = duplicate = truncated = illegal = 0
    for _, _, first, last, n, first_initial, last_initial, b, d, t, i, costs, audits in group:
        matrix = [[None if costs[r * 4 + c] is None else (costs[r * 4 + c], audits[r * 4 + c]) for c in range(4)] for r in range(4)]
        vector = structure.product(vector, matrix)
        if first is not None:
            turns += n - (first == high)
            low, high = first if low is None else low, last
        illegal += i + (initial is not None and initial + first_initial not in LEGAL)
        initial = last_initial
        blank, duplicate, truncated = blank + b, duplicate + d, truncated + t
    last = structure.product(vector, structure.INSERTS)[0]
    cost, audit = min((last[e][0], structure.flat(last[e][1])) for e in structure.ENDS if last[e])
    return 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, audit


def audits(conversations: DataFrame, folder: str) -> DataFrame:
    """conv, the counts of `COUNTS` and audit of each conversation with rows."""
    pieces = written(_pieces(_symbols(_taken(conversations))), f"{folder}/pieces")
    solved = written(_solved(pieces), f"{folder}/solved")
    conv = pieces.schema["conv"].dataType.simpleString()
    rows = pieces.join(solved, "symbols").select("conv", "part", "piece", *[c.split()[0] for c in _PIECE_COLUMNS.split(", ")[1:]], "costs", "audits")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "piece")

    def out(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, group in _grouped(rows, 1):
            yield (*key, *_fold(group))

    return rows.mapInArrow(_streamed(out, ", ".join(f"{c} long" for c in COUNTS) + ", audit string"),
                           f"conv {conv}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


def _edited(audit: str, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of each row that stays or comes in."""
    count, system = 0, False
    for edit in audit:
        role, text = (b"", b"") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if count == 0 and edit == "K" and role[:1] == b"s":
            system = True
        if edit != "K":
            role = (b"user", b"assistant")[(count - system) % 2]
        count += 1
        yield edit, role, text


def _with_audits(conversations: DataFrame, found: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Each conversation's id, then its counts and audit, then its rows in order."""
    rows = _taken(conversations)
    nothing = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    line = [F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text")]
    none = [F.lit(None).cast("binary").alias(c) for c in ("role", "text")]
    keys = [F.col("turn"), F.col("role").alias("by_role"), F.col("digest")]
    no_keys = [F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("by_role"), F.lit(None).cast("string").alias("digest")]
    no_audit = F.lit(None).cast("string").alias("audit")
    table = rows.select("conv", F.lit(2).alias("kind"), *nothing, no_audit, *line, *keys).unionByName(
        found.select("conv", F.lit(1).alias("kind"), *COUNTS, "audit", *none, *no_keys))
    if ids is not None:
        bare = ids.select(ids.columns[0]).distinct().toDF("conv").select("conv", F.lit(0).alias("kind"), *nothing, no_audit, *none, *no_keys)
        table = table.unionByName(bare)
    order = ["conv", "kind", "turn", "by_role", "digest"]
    return table.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", *COUNTS, "audit", "role", "text")


def _heads(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conversation, counts, audit, its rows) for each conversation, in a stream of what `_with_audits` gives."""
    width = len(COUNTS)
    for (key,), group in _grouped(rows, 1):
        counts, audit, lines = (0,) * width, "", group
        for kind, *values in group:
            if kind == 1:
                counts, audit = tuple(values[:width]), values[width]
            if kind >= 1:
                break
        yield key, counts, audit, ((row[-2], row[-1]) for row in lines)


def digests(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `conversations` has conv_id, turn, role, text. Nulls count as one space, a null conv_id is a conversation of its own,
    and a null turn comes first. Rows of one turn follow in order of role and text's digest; equal rows each count, all
    but the first as duplicates. `ids` names conversations that may have no rows: zeros, an empty audit and the digest
    of nothing. Without rows and ids there is no result; other columns play no part.
    """
    folder = work_folder(conversations.sparkSession, "repair")
    found = written(audits(conversations, folder), f"{folder}/audits")
    table = _with_audits(conversations, found, ids)

    def out(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, counts, audit, lines in _heads(rows):
            digest, mark = hashlib.sha256(), b""
            for _, role, text in _edited(audit, lines):
                digest.update(mark + role + b":")
                digest.update(text)
                mark = b"\n"
            yield (key, *counts, audit, digest.hexdigest())

    columns = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    conv = table.schema["conv"].dataType.simpleString()
    return table.mapInArrow(_streamed(out, columns), f"conv {conv}, {columns}").withColumnRenamed("conv", "conv_id")


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text. See `digests`."""
    folder = work_folder(conversations.sparkSession, "repair")
    found = written(audits(conversations, folder), f"{folder}/audits")
    table = _with_audits(conversations, found, None)

    def out(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, _, audit, lines in _heads(rows):
            for place, (edit, role, text) in enumerate(_edited(audit, lines)):
                yield key, place, edit, role.decode(), text.decode()

    columns = "place long, edit string, role string, text string"
    conv = table.schema["conv"].dataType.simpleString()
    return table.mapInArrow(_streamed(out, columns), f"conv {conv}, {columns}").withColumnRenamed("conv", "conv_id")
