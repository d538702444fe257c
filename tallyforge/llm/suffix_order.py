"""Linear suffix sorting by grouping, for strings of whole numbers.

The Lyndon prefix of a suffix is its longest prefix that is a Lyndon word. Suffixes are first put into groups of equal
Lyndon prefix, ordered by that prefix. Groups are finished from the highest down: the nearest unfinished
position before a member is its previous smaller suffix, whose Lyndon prefix grows by the group's word once for each
such member, and the positions that grew move to new groups right above their old one. No symbols are renamed and
nothing recurses. Then the order is read off: a suffix is its Lyndon prefix followed by its next smaller
suffix, so walking the suffixes upwards and appending to its group each one whose next smaller suffix is the
current one leaves every group in order.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of `text` in lexicographic order; a prefix comes before what it begins."""
    n = len(text)
    places: dict[int, list[int]] = {}
    for at, symbol in enumerate(text):
        places.setdefault(symbol, []).append(at)
    # groups are numbered as they are made; `below` and `above` keep their order
    members = [places[symbol] for symbol in sorted(places)]
    group = [0] * n
    for number, held in enumerate(members):
        for at in held:
            group[at] = number
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    open_ = list(range(n + 1))  # open_[at + 1]: towards the nearest unfinished position up to `at`, 0 if there is none
    smaller = [-1] * n
    finished: list[list[int]] = []
    current = len(members) - 1
    while current >= 0:
        held = [at for at in members[current] if group[at] == current]
        if held:
            finished.append(held)
            for at in held:
                open_[at + 1] = at
            grown: dict[int, int] = {}
            for at in held:
                x = at
                while open_[x] != x:
                    open_[x] = x = open_[open_[x]]
                smaller[at] = x - 1
                if x:
                    grown[x - 1] = grown.get(x - 1, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for at, times in grown.items():
                moved.setdefault((group[at], times), []).append(at)
            old = under = -1
            for key in sorted(moved):
                if key[0] != old:
                    old = under = key[0]
                number = len(members)
                members.append(moved[key])
                for at in moved[key]:
                    group[at] = number
                over = above[under]
                below.append(under)
                above.append(over)
                above[under] = number
                below[over] = number
                under = number
        current = below[current]
    slot = [0] * len(members)
    start = 0
    for held in reversed(finished):
        slot[group[held[0]]] = start
        start += len(held)
    order = [0] * n
    step, at, stop = 0, n, -1
    while True:
        s = at - 1
        while s != stop:  # these have their next smaller suffix at `at`
            number = group[s]
            order[slot[number]] = s
            slot[number] += 1
            s = smaller[s]
        if step == n:
            return order
        at = order[step]
        stop = smaller[at]
        step += 1


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """For each place in the order, how many symbols its suffix shares with the one before (0 for the first)."""
    n = len(text)
    rank = [0] * n
    for place, at in enumerate(order):
        rank[at] = place
    shared, length = [0] * n, 0
    for at in range(n):
        place = rank[at]
        if not place:
            length = 0
            continue
        other = order[place - 1]
        while at + length < n and other + length < n and text[at + length] == text[other + length]:
            length += 1
        shared[place] = length
        length = max(0, length - 1)
    return shared
