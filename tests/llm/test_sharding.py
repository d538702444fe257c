import random
import zlib
from collections import defaultdict

import pytest

from tallyforge.llm import sharding


def smallest_capacity(sizes, shards):
    """By trying every sum of a run of groups."""
    def fits(capacity):
        used, left = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > left:
                used, left = used + 1, capacity
            left -= size
        return used <= shards

    runs = {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}
    return min(c for c in runs if fits(c))


@pytest.mark.parametrize("shards", [1, 3, 7, 50])
def test_cuts_are_the_smallest_feasible(spark, shards):
    rng = random.Random(shards)
    sizes = [rng.randint(1, 90) for _ in range(40)] + [400]
    rng.shuffle(sizes)
    ends = [(sum(sizes[:i + 1]), size) for i, size in enumerate(sizes)]
    cuts = sharding.minimax_cuts(spark.createDataFrame(ends, "size_at long, group_bytes long"), shards, tries=5)
    assert cuts[-1] == sum(sizes)
    assert max(b - a for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) == smallest_capacity(sizes, shards)


def test_shards_of_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, *[(200 + i, f"text number {i} " * (i % 9 + 1)) for i in range(150)], *[(500 + i, "hot copy " * 9) for i in range(60)]]
    got = sharding.shard_by_bytes(make_docs(rows, 5), 4).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, where = defaultdict(list), defaultdict(set)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    for r in got:
        slots[r.shard].append(r.slot)
        if len(texts[r.doc_id]) == 1:
            where[next(iter(texts[r.doc_id]))].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    assert set(slots) <= {0, 1, 2, 3}


def test_empty_and_tiny_tables(make_docs):
    assert sharding.shard_by_bytes(make_docs([]), 16).collect() == []
    assert [(r.shard, r.slot, r.size) for r in sharding.shard_by_bytes(make_docs([(None, None)]), 16).collect()] == [(0, 0, 1)]
