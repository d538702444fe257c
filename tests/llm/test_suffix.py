import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import suffix_dedup
from tallyforge.llm.suffix_order import common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffixes_are_in_order(text):
    order = suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    shared = common_prefixes(text, order)
    for place in range(1, len(text)):
        a, b = text[order[place - 1]:], text[order[place]:]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[place] == n


def removed(rows, length):
    """(id, bytes, removed bytes, removed runs, kept) by counting every string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j:j + length] for _, b in data for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = b"\1" * length
        runs = sum(1 for j, x in enumerate(gone) if x and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    words = [f"{rng.randint(0, 999)}é" for _ in range(40)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(rng.randint(10, 40)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [make(rng.randint(0, 12)) for _ in range(3)]
        text = parts[0] + rng.choice(shared) + parts[1] + (rng.choice(shared)[rng.randint(0, 20):] if i % 2 else "") + parts[2]
        if i % 5 == 0:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        rows.append((i, text))
    rows += [(50, rows[7][1]), (51, "abc" * 60), (52, "z" * 90), (53, "abc" * 20), (54, rows[3][1][10:80])]
    return rows


@pytest.mark.parametrize("group", [20_000, 2])
def test_removal_equals_brute_force(make_docs, odd_rows, group):
    data = passages(1) + passages(2) + [(i, t[:2000] if t else t) for i, t in odd_rows]
    got = suffix_dedup.remove_repeats(make_docs(data), length=40, group=group).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == removed(data, 40)


def test_whole_repeated_rows_lose_everything(make_docs):
    got = suffix_dedup.remove_repeats(make_docs([(1, "q" * 300 + "r" * 200)] * 2 + [(2, None), (3, "")])).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(1, 500, 1), (1, 500, 1), (2, 0, 0), (3, 0, 0)]


def test_long_text_is_read_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 200)
    suffix_dedup._tables.cache_clear()
    rng = random.Random(2)
    data = bytes(rng.randint(97, 99) for _ in range(1500))
    short = suffix_dedup.anchors(data, 40)
    monkeypatch.undo()
    suffix_dedup._tables.cache_clear()
    assert [x[0:] for x in short] == [x[0:] for x in suffix_dedup.anchors(data, 40)]
    starts = [s for a, b in zip(short[2], short[3], strict=True) for s in range(a, b - 39)]
    assert starts == list(range(len(data) - 39))  # each string belongs to one anchor


def test_empty_table(make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).collect() == []
