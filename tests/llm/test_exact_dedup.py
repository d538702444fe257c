import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.llm import exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out = []
    for i, text in rows:
        held = groups[lower(text)]
        keep = max((x for x in held if x is not None), default=None)
        out.append((i, keep, len(held), i == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_equal_brute_force(make_docs, odd_rows, rows):
    got = exact_dedup.exact_groups(make_docs(odd_rows), capacity=4)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected(odd_rows)


def test_unique_keeps_one_row_of_each_text(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = exact_dedup.unique(docs)
    assert got.columns == docs.columns
    assert sorted(lower(r.text) for r in got.select("text").collect()) == sorted({lower(t) for _, t in odd_rows})
    assert {r.doc_id for r in got.collect()} == {k for _, k, *_ in expected(odd_rows)}


def test_empty_table(make_docs, rows):
    assert rows(exact_dedup.exact_groups(make_docs([]))) == []
    assert rows(exact_dedup.unique(make_docs([]))) == []


def test_only_overfull_buckets_split(spark, tmp_path):
    # 200 keys share their first ten bits, 40 others are spread evenly
    crowd = [(i + 1) << 45 for i in range(200)]
    spread = [(1 << 62) + (i << 56) + 5 for i in range(40)]
    keys = spark.createDataFrame([(k,) for k in crowd + spread], "key long")
    slots, depth = exact_dedup.directory(keys, f"file://{tmp_path}", capacity=16)
    got = {r.slot: r for r in slots.collect()}
    held = defaultdict(list)
    for k in crowd + spread:
        entry = got[k >> (63 - depth)]
        assert entry.bucket == k >> (63 - entry.local_depth) << (63 - entry.local_depth)
        held[entry.bucket, entry.local_depth].append(k)
    assert max(map(len, held.values())) <= 16 and depth > 10
    # a bucket is as deep as it must be: the one it split from held more than it may
    first = 3
    for (bucket, local), _ in held.items():
        assert local == first or sum(k >> (64 - local) == bucket >> (64 - local) for k in crowd + spread) > 16
    assert {local for _, local in held} >= {first, depth}


def test_probes_go_through_the_directory(spark, make_docs, odd_rows, monkeypatch):
    # a directory that names the wrong bucket for a slot loses the documents of that slot
    right = exact_dedup.directory

    def wrong(keys, folder, capacity):
        slots, depth = right(keys, folder, capacity)
        lost.append(min(r.slot for r in slots.collect()))
        return slots, depth

    def named(docs, slots, depth, *rest):
        moved = slots.withColumn("bucket", F.when(F.col("slot") == lost[0], F.lit(-1)).otherwise(F.col("bucket")))
        return probes(docs, moved, depth, *rest)

    lost, probes = [], exact_dedup._probes
    docs = make_docs(odd_rows)
    whole = exact_dedup.exact_groups(docs, capacity=4).count()
    monkeypatch.setattr(exact_dedup, "directory", wrong)
    monkeypatch.setattr(exact_dedup, "_probes", named)
    assert 0 < exact_dedup.exact_groups(docs, capacity=4).count() < whole == len(odd_rows)


def test_owners_fold_a_hot_text_first(spark, make_docs):
    # 3,000 copies in 3 tasks reach the owner of their key as one row a task, and grouping adds no shuffle
    docs = make_docs([(i, "hot") for i in range(3000)])
    made = exact_dedup.chained(docs)
    assert [(r.keep_id, r.group_size) for r in made.collect()] == [(2999, 3000)]
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange rangepartitioning(key") == 1 and "hashpartitioning(key" not in plan


def test_index_chains_equal_keys(make_docs, monkeypatch, rows):
    # with one key for all texts every record is a link of one chain, and bytes decide
    monkeypatch.setattr(exact_dedup, "_key", lambda text: F.lit(7).cast("long"))
    data = [(1, "a"), (2, "b"), (3, "A"), (4, "c")]
    got = exact_dedup.exact_groups(make_docs(data))
    assert rows(got, "doc_id", "keep_id") == [(1, 3), (2, 2), (3, 3), (4, 4)]
    assert {r.link for r in got.collect()} == {0, 1, 2}
