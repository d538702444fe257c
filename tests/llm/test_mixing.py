import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import mixing


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.6, 0.3, 0.3], 400)
    tokens = rng.integers(0, 900, 400)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>")
    weights = [0.2, 0.7, 0.1]
    steps, targets = mixing.fit_steps(rows, weights, budget=0.5)
    got = rows.select("n_tokens", "posterior", mixing._rate(F.col("posterior"), steps).alias("rate")).collect()
    rate = np.array([r.rate for r in got])
    sums = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in got)
    assert (rate >= 0).all()
    assert np.allclose(targets, 0.5 * tokens.sum() * np.array(weights))
    assert np.allclose(sums, targets, rtol=1e-4)

    # the same descent, row by row
    q = np.array([r.posterior for r in got])
    a = q * np.array([[r.n_tokens] for r in got])
    mine, off = np.ones(len(got)), []
    for step in steps:
        moving = mine > 0
        whole = np.linalg.inv(q[moving].T @ a[moving]) @ (a.T @ mine - targets)
        assert np.allclose(step, whole * (step[0] / whole[0]))
        mine = np.maximum(0, mine - q @ np.array(step))
        off.append(np.abs(a.T @ mine - targets).sum())
    assert np.allclose(mine, rate, atol=1e-6)
    assert off == sorted(off, reverse=True)


def test_unreachable_targets_keep_rates_in_range(spark):
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (30, [1.0, 0.0])], "n_tokens long, posterior array<double>")
    steps, targets = mixing.fit_steps(rows, [0.4, 0.6])
    assert targets == [40.0, 0.0]  # nothing can meet the second weight, so the first takes all
    assert steps == []
    assert mixing.fit_steps(rows.where("false"), [0.4, 0.6]) == ([], [0.0, 0.0])


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = mixing.posteriors(docs, labels.where(~held)).join(labels.where(held), F.col("id") == F.col("doc_id"))
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    best = F.array_position("posterior", F.array_max("posterior")) - 1
    rows = got.agg(F.avg((best == truth).cast("int")).alias("right"), F.max(F.abs(F.aggregate("posterior", F.lit(0.0), lambda x, y: x + y) - 1)).alias("off")).first()
    assert rows.right > 0.9
    assert rows.off < 1e-9


def test_odd_rows_and_labels(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(20, 1, 0, "a"), (21, 0, 0, "b"), (22, 1, 1, "c"), (22, 1, 0, "d"), (None, 1, 0, "e"), (23, None, None, "f"), (999, 1, 0, "g")],
                                   "doc_id long, quality int, toxic int, text string")
    got = mixing.rates(docs, labels).collect()
    assert len(got) == len(odd_rows)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert [r.n_tokens for r in got if r.id == 1] == [0]
    kept = mixing.mixed(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.copies for r in got)
    none = mixing.rates(docs, labels.where("false")).collect()
    assert all(np.isclose(r.rate, 1.0, atol=2) and np.allclose(r.posterior, 1 / 3) for r in none)
    one = mixing.rates(docs, labels.where("doc_id = 20")).collect()
    assert all(r.posterior == [1.0, 0.0, 0.0] and np.isclose(r.rate, 1.0) for r in one)
    assert mixing.rates(make_docs([]), labels).collect() == []
    assert mixing.mixed(make_docs([]), labels).collect() == []
