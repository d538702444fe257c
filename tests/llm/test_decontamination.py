import random
import re

import numpy as np

from tallyforge.llm import decontamination as dc
from tallyforge.llm.fm_index import Shard, sorted_suffixes, split_words

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, items, window=10):
    doc, hit, names = words(text), set(), set()
    for item, body in items:
        ws = words(body)
        size = min(window, len(ws))
        phrases = {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)} if ws else set()
        for p in range(len(doc) - size + 1):
            if tuple(doc[p:p + size]) in phrases:
                hit.update(range(p, p + size))
                names.add("" if item is None else str(item))
    starts = [w for w in sorted(hit) if w - 1 not in hit]
    spans = [(s, next(e for e in range(s, len(doc) + 1) if e not in hit)) for s in starts]
    return len(doc), len(hit), spans, sorted(names), bool(hit)


def test_suffixes_and_index_equal_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        texts = [[b"abcd"[rng.randrange(4):][:1] for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(1, 6))]
        texts += [texts[0]]
        shard = Shard.unpacked(**Shard.built(texts).packed())
        for size in (1, 2, 5):
            held = sorted({tuple(t[i:i + size]) for t in texts for i in range(len(t) - size + 1)}) or [(b"a",)]
            rows = np.array([[shard.vocabulary[w] for w in p] for p in held])
            low, high = shard.find(rows, np.full(len(rows), len(held[0])))
            for k, phrase in enumerate(held):
                at = sorted(shard.locate(np.arange(low[k], high[k])).tolist())
                want = [int(shard.starts[n]) + i for n, t in enumerate(texts) for i in range(len(t)) if tuple(t[i:i + len(phrase)]) == phrase]
                assert at == want
    symbols = np.array([3, 3, 3, 3, 3, 0, 3, 3, 3, 1, 2])
    assert sorted_suffixes(symbols).tolist() == sorted(range(11), key=lambda i: symbols[i:].tolist())


def test_words_are_those_of_the_pattern(odd_rows):
    for _, text in odd_rows:
        assert [w.decode() for w in split_words((text or "").encode())] == words(text)


def table(spark, items):
    rows = [(i, t, "x", 1) for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, body string, shard int")


def test_documents_equal_brute_force(spark, make_docs, odd_rows, monkeypatch):
    rng = random.Random(4)
    prose = [" ".join(rng.choice("one two three four five six".split()) for _ in range(40)) for _ in range(6)]
    items = [(i, " ".join(p.split()[:25])) for i, p in enumerate(prose)] + [
        (9, "One  TWO"), (10, "three"), (11, None), (12, "?!"), (None, prose[2]), (9, "six six six"), (13, "délta41 word word"), (5, prose[5]), (14, "absent " + prose[0])]
    docs = [*odd_rows, *((100 + i, " ".join(rng.choice(prose).split()[rng.randrange(20):])) for i in range(30)),
            (200, prose[3].upper().replace(" ", "\n-- ")), (201, "five " * 12), (202, prose[0] + ". " + prose[0]), (202, prose[0])]
    for shard_bytes, block_bytes, rows in ((dc.SHARD_BYTES, dc.BLOCK_BYTES, dc.ROWS), (2000, 300, 7)):
        monkeypatch.setattr(dc, "SHARD_BYTES", shard_bytes)
        monkeypatch.setattr(dc, "ROWS", rows)
        for use in (items, items[:6]):
            got = dc.contaminated(make_docs(docs), table(spark, use), block_bytes=block_bytes).collect()
            have = sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"], r.contaminated) for r in got), key=repr)
            assert have == sorted(((d, *by_hand(t, use)) for d, t in docs), key=repr)


def test_no_items_and_no_documents(spark, make_docs):
    none = dc.contaminated(make_docs([(1, "a b"), (2, None)]), table(spark, [])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in none) == [(1, 2, 0, False), (2, 0, 0, False)]
    empty = make_docs([(1, "a")]).where("false")
    assert dc.contaminated(empty, table(spark, [(1, "a")])).collect() == []
    assert dc.contaminated(make_docs([(1, None), (None, "")]), table(spark, [(1, "a")])).where("contaminated").count() == 0
