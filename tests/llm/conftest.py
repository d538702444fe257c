import random

import pytest

CLASHING = "row struct<a:int>, id string, key int, body string, n int, label string, kept boolean, ids string, value int, `a.b` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text[, lang]) tuples as documents with further columns whose names the operators use themselves."""
    def make(rows, parts=3):
        filled = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, (1,), "x", 2, "y", 3, "z", True, "w", 4, "dot") for r in rows]
        return spark.createDataFrame(filled, SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, long texts and near copies."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "eps-ilon", "ζeta", "eta.", "THETA", "iota", "kappa", "123", "'s", "\t", "\n\n", " "]
    prose = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(8)]
    near = prose[0].split(" ")
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "!!! ..."), (5, "Same Text"), (6, "same text"), (6, "same text"), (7, "SAME TEXT"),
            (None, "same text"), (None, "no id"), (None, None), (8, "É"), (9, "é"), (10, "one"), (11, "word " * 20000), (12, "x" * 3000)]
    rows += [(20 + i, text) for i, text in enumerate(prose)]
    rows += [(40 + i, " ".join([*near[:i * 5], "edited", *near[i * 5 + 1:]])) for i in range(1, 10)]
    rows += [(60, prose[3]), (60, prose[4]), (61, prose[3] + " " + prose[5])]
    return rows
