import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import fingerprints, minhash_dedup
from tallyforge.llm.components import components
from tallyforge.llm.common import work_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def groups(rows, n, similarity=80):
    """(id, set size, smallest id of the component) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return sorted(((doc, len(sets[i]), min(least[find(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def near_rows(seed=3, base=12, copies=9, words=60, edits=4):
    rng = random.Random(seed)
    rows = []
    for b in range(base):
        text = [f"w{rng.randint(0, 300)}" for _ in range(words)]
        for _ in range(copies):
            edited = list(text)
            for _ in range(rng.randint(0, edits)):
                # few places and words for edits, so that members can be near each other but far from the rest
                edited[rng.randrange(words // 3) * 3] = f"e{rng.randint(0, 3)}"
            rows.append((len(rows) * 7 % 1009, " ".join(edited)))
    return rows


@pytest.mark.parametrize("n", [4, 5])
def test_groups_equal_brute_force(make_docs, odd_rows, n):
    data = [r for r in odd_rows] + [(1000 + i, t) for i, t in near_rows()]
    got = minhash_dedup.near_groups(make_docs(data), words=n)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)
    assert found == groups(data, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


@pytest.mark.parametrize(("seed", "copies", "edits"), [(8, 25, 4), (9, 60, 8), (10, 40, 3)])
def test_long_lists_are_joined_by_hubs(make_docs, monkeypatch, seed, copies, edits):
    # all lists are long; many members are linked with others but not with their hub, or with none
    monkeypatch.setattr(minhash_dedup, "LIST", 1)
    data = near_rows(seed=seed, base=3, copies=copies, words=90, edits=edits)
    got = minhash_dedup.near_groups(make_docs(data), words=4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == groups(data, 4)


def test_a_hub_holds_the_values_most_others_hold(spark):
    # node 99 stands in as many lists as those of the middle, but two of its values are rare
    lists = {10: [0, 1, 2, 3, 4, 99], 20: [0, 1, 2, 3, 4], 30: [0, 1, 2, 3, 4], 40: [97, 98, 99], 50: [97, 98, 99]}
    rows = [(value, node, 50, len(nodes)) for value, nodes in lists.items() for node in nodes]
    long_ = spark.createDataFrame(rows, "value long, node long, n long, members long")
    hubs = minhash_dedup._hubs(long_, work_folder(spark, "test"))
    assert {r.value: r.hub for r in hubs.collect()} == dict.fromkeys(lists, 4)


def test_one_of_each(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = minhash_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    want = Counter()
    seen = set()
    for (doc, size, least), (_, text) in zip(groups(odd_rows, 5), sorted(odd_rows, key=lambda r: repr(r)), strict=True):
        del text
        if not size:
            want[doc] += 1
        elif doc == least and least not in seen:
            seen.add(least)
            want[doc] += 1
    found = Counter(r.doc_id for r in got.collect())
    assert {k: v for k, v in found.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_one_of_near_copies_without_an_id_or_with_one_id(make_docs):
    words = [f"w{i}" for i in range(80)]
    copies = [" ".join([*words[:i], "edited", *words[i + 1:]]) for i in (3, 40, 77)]
    other = [" ".join(f"{w}x" for w in text.split(" ")) for text in copies]
    rows = [*[(None, text) for text in copies], *[(7, text) for text in other], (None, None), (None, None), (8, " "), (8, " ")]
    got = minhash_dedup.one_of_each(make_docs(rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["7", "8", "8", "None", "None", "None"]
    assert sum(r.text in copies for r in got) == sum(r.text in other for r in got) == 1


def test_empty_table(make_docs):
    assert minhash_dedup.near_groups(make_docs([])).collect() == []
    assert minhash_dedup.one_of_each(make_docs([])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(300, 340)] + [(7, 7), (9, 8), (8, 9)]
    got = components(spark.createDataFrame(links, "a long, b long"), work_folder(spark, "test"))
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(300, 340)]} | {8: 8, 9: 8}
    assert {r.node: r.label for r in got.collect()} == want


def test_fingerprints_estimate_the_likeness(make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(6, 400)))) for i in range(120)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(make_docs(rows)).collect()}
    ordered = sorted(rows, reverse=True)
    errors = []
    for at, (doc, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[doc].edited == edited
        assert got[doc].n_chars == len(text)
        a, b = shingles(text, 5), shingles(edited, 5)
        errors.append(got[doc].near_edited - len(a & b) / len(a | b))
        assert 0 <= got[doc].near_next <= 0.1
    assert abs(np.mean(errors)) < 0.015
    assert np.std(errors) < 0.06


def test_fingerprints_of_odd_rows(make_docs, odd_rows):
    marks = fingerprints.fingerprints(make_docs(odd_rows)).collect()
    assert len(marks) == len(odd_rows)
    by_set = defaultdict(set)
    for r, (_, text) in zip(sorted(marks, key=lambda r: repr(r.doc_id)), sorted(odd_rows, key=lambda r: repr(r[0])), strict=True):
        del text
        assert len(r.fingerprint) in (0, 256)
    for doc, text in odd_rows:
        by_set[shingles(text, 5)] |= {r.fingerprint for r in marks if r.doc_id == doc and doc not in (None, 60)}
    assert all(len(v) <= 1 for v in by_set.values())
    edited = fingerprints.edited_fingerprints(make_docs(odd_rows)).collect()
    assert sorted(repr(r.doc_id) for r in edited) == sorted(repr(i) for i, _ in odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in edited)
    assert fingerprints.edited_fingerprints(make_docs([])).collect() == []
    lone = fingerprints.edited_fingerprints(make_docs([(1, "abcd")])).collect()
    assert [(r.edited, r.near_next) for r in lone] == [("abab", 1.0)]
