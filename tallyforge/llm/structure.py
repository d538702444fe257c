"""Cheapest repairs of role sequences: grammar-compressed dynamic programming over min-plus transfer matrices.

A conversation is a sequence of symbols, one for each row: its role's initial and its fault. A transfer matrix gives,
for each state before and after a sequence, the least cost of the edits and the ASCII-least audit (string of edit
initials) among the cheapest. Products of matrices are associative, so a sequence is replaced by a grammar: Re-Pair names
the most frequent pairs of neighbours, again and again, and each rule gets one matrix, worked out once from its two
parts and shared by all sequences it occurs in. Audits are ropes: a rule's audit points to those of its parts.

Two audits of one matrix entry never cost the same if one begins with the other, as inserts cost more than nothing.
So the lesser of two audits stays the lesser whatever follows, and the products may be taken in any grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
#: States: nothing yet, after system, after user, after assistant. A whole repair ends in one of ENDS.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: (state, role's initial) to the state after it: s? then (ua)+.
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Symbols: a row that must go, and rows of each initial (x: any other), whole or truncated.
MUST_GO = "d"
SYMBOLS = {MUST_GO: (None, 0), **{c: (c, 0) for c in "suax"}, **{c.upper(): (c, TRUNCATED) for c in "suax"}}

# A rope is a string or a pair of ropes. An entry is (cost, rope), or None where no edits lead from state to state.
Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]


def flat(rope: Rope) -> str:
    """The string of a rope."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """Is one rope's string before the other's? Parts that both share are skipped whole."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if x[n:]:
                left.append(x[n:])
            if y[n:]:
                right.append(y[n:])
        elif isinstance(y, str) or not isinstance(x, str) and _deeper(x, y):
            left += [x[1], x[0]]
            right.append(y)
        else:
            right += [y[1], y[0]]
            left.append(x)
    return bool(right)


def _deeper(x: tuple, y: tuple) -> bool:
    return x[2] >= y[2]


def _size(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[2]


def joined(a: Rope, b: Rope) -> Rope:
    """The rope of one string after another. A pair also holds its length."""
    if not a or not b:
        return a or b
    return (a, b, _size(a) + _size(b))


def product(x: Matrix, y: Matrix) -> Matrix:
    """The matrix of one sequence after another."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            best = None
            for k in range(4):
                if x[i][k] is None or y[k][j] is None:
                    continue
                cost = x[i][k][0] + y[k][j][0]
                if best is None or cost <= best[0]:
                    audit = joined(x[i][k][1], y[k][j][1])
                    if best is None or cost < best[0] or less(audit, best[1]):
                        best = (cost, audit)
            out[i][j] = best
    return out


def _inserts() -> Matrix:
    """No or more inserted rows."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (0, "")
        at, cost, audit = i, 0, ""
        while (at := STEPS.get((at, "u"), STEPS.get((at, "a")))) is not None and out[i][at] is None:
            cost, audit = cost + INSERT, audit + "I"
            out[i][at] = (cost, audit)
    return out


def _row(symbol: str) -> Matrix:
    """One row, kept, given another role or deleted."""
    initial, extra = SYMBOLS[symbol]
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        for (state, role), to in STEPS.items():
            if state != i or initial is None:
                continue
            edit = (KEEP + extra, "K") if role == initial else (REROLE + extra, "R") if role in "ua" else None
            if edit and (out[i][to] is None or edit < out[i][to]):
                out[i][to] = edit
    return out


INSERTS = _inserts()
ROWS = {symbol: product(INSERTS, _row(symbol)) for symbol in SYMBOLS}
EMPTY: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def grammar(sequences: Sequence[str]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair: rules (left, right) and what is left of each sequence, in numbers of symbols, then of rules.

    Each round replaces the most frequent pairs of neighbours that have no symbol in common, until none occurs twice.
    """
    alphabet = list(SYMBOLS)
    code = np.full(128, -1, np.int64)
    code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    rules: list[tuple[int, int]] = []
    text = code[np.frombuffer("".join(sequences).encode(), np.uint8)]
    owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    while len(text) > 1:
        width = len(alphabet) + len(rules)
        pair = np.where(owner[1:] == owner[:-1], text[:-1] * width + text[1:], -1)
        # of overlapping pairs of one symbol every second one counts
        same = (text[:-1] == text[1:]) & (pair >= 0)
        run = np.arange(len(pair)) - np.maximum.accumulate(np.where(same, -1, np.arange(len(pair))))
        pair[same & (run % 2 == 0)] = -1
        kinds, counts = np.unique(pair[pair >= 0], return_counts=True)
        used: set[int] = set()
        chosen = {}
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 2 or len(used) == width:
                break
            a, b = divmod(int(kinds[k]), width)
            if a not in used and b not in used:
                used |= {a, b}
                chosen[int(kinds[k])] = len(alphabet) + len(rules)
                rules.append((a, b))
        if not chosen:
            break
        names = np.array(sorted(chosen))
        at = np.flatnonzero(np.isin(pair, names))
        text[at] = np.array([chosen[n] for n in names])[np.searchsorted(names, pair[at])]
        stay = np.ones(len(text), bool)
        stay[at + 1] = False
        text, owner = text[stay], owner[stay]
    return rules, np.split(text, np.searchsorted(owner, np.arange(1, len(sequences)))) if len(sequences) else []


def matrices(sequences: Sequence[str]) -> list[Matrix]:
    """The matrix of each sequence: rules bottom-up, then the products along what is left of the sequence."""
    rules, texts = grammar(sequences)
    held = list(ROWS.values())
    for a, b in rules:
        held.append(product(held[a], held[b]))
    out = []
    for text in texts:
        matrix = EMPTY
        for symbol in text.tolist():
            matrix = product(matrix, held[symbol])
        out.append(matrix)
    return out
