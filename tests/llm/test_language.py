import itertools
import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tallyforge.llm import language, queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def model_of(probabilities, languages=("a", "b")):
    """A small model from {piece: [probability for each language]}."""
    pieces = sorted(probabilities)
    table = language.HashTable(language._hashes(pieces), np.arange(len(pieces), dtype=np.int32), -1)
    lifted = [np.array(probabilities[p]) * language.LIFT ** len(p) for p in pieces]
    span = max(map(len, pieces))
    return language.Model(list(languages), table, np.vstack([*lifted, [language.UNKNOWN * language.LIFT] * len(languages)]), span=span)


def by_hand(word, probabilities, which):
    """Sum over all segmentations of the marked word."""
    text = language.MARK + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        product = 1.0
        for a, b in zip(at[:-1], at[1:], strict=True):
            piece = text[a:b]
            product *= probabilities[piece][which] if piece in probabilities else language.UNKNOWN if b - a == 1 else 0.0
        total += product
    return math.log(total)


def test_forward_pass_sums_all_segmentations():
    rng = random.Random(1)
    probabilities = {p: [rng.random() * 0.1, rng.random() * 0.1] for p in ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb", "é", "éb"]}
    model = model_of(probabilities)
    words = ["ab", "abba", "b", "ababab", "éb", "xé", "zzz", "aéba"]
    scores = model.score(words)
    for word, row in zip(words, scores, strict=True):
        assert np.allclose(row[:2], [by_hand(word, probabilities, 0), by_hand(word, probabilities, 1)])
        assert row[2] == len(word)
    assert np.allclose(model.score(["ab-ba!"])[0], model.score(["ab"])[0] + model.score(["ba"])[0])
    assert model.score(["12", "...", ""])[:, 2].tolist() == [0, 0, 0]


def test_long_runs_are_scored_whole():
    model = model_of({"a": [0.5, 0.1], "▁": [0.1, 0.1]})
    row = model.score(["a" * 1000])[0]
    assert row[2] == 1000
    assert np.isfinite(row).all()


def test_long_runs_and_long_pieces_sum_all_segmentations(monkeypatch):
    rng = random.Random(4)
    whole = "abbaéabbaabab"
    probabilities = {p: [rng.random() * 0.1, rng.random() * 1e-5] for p in ["a", "b", "ab", "ba", "▁", "▁ab", "bbaéabbaab", "▁abbaéabbaa", whole[2:]]}
    model = model_of(probabilities)
    words = [whole, whole[:12], whole + "b", "zz" + whole, "b"]
    want = [[by_hand(word, probabilities, 0), by_hand(word, probabilities, 1)] for word in words]
    assert np.allclose(model.score(words)[:, :2], want)
    short = [language._expected(model, which, ["▁" + w for w in words], np.arange(1.0, 6)) for which in (0, 1)]
    monkeypatch.setattr(language, "LONGEST", 3)  # now all but "b" pass letter by letter
    assert np.allclose(model.score(words)[:, :2], want)
    for which in (0, 1):
        assert np.allclose(language._expected(model, which, ["▁" + w for w in words], np.arange(1.0, 6)), short[which])


def test_a_long_run_is_one_run():
    # no false mark inside, and no underflow however unlikely its letters are
    model = model_of({"a": [0.5, 0.1], "▁": [0.1, 0.3], "▁a": [0.2, 0.2]})
    got = model.score(["a" * 5000, "ж" * 5000])
    for which, (a, mark, marked) in enumerate([(0.5, 0.1, 0.2), (0.1, 0.3, 0.2)]):
        assert np.isclose(got[0][which], math.log(mark * a + marked) + 4999 * math.log(a))
        assert np.isclose(got[1][which], math.log(mark) + 5000 * math.log(language.UNKNOWN))


def test_pieces_of_all_lengths_are_in_the_vocabulary():
    assert max(map(len, language.letter_pieces(PIECES))) > 12


def test_expected_uses_equal_the_share_of_segmentations():
    probabilities = {"a": [0.2], "b": [0.3], "ab": [0.1], "▁": [0.5], "▁a": [0.05]}
    model = model_of(probabilities, ["x"])
    uses = language._expected(model, 0, ["▁ab"], np.array([2.0]))
    ways = {("▁", "a", "b"): 0.5 * 0.2 * 0.3, ("▁", "ab"): 0.5 * 0.1, ("▁a", "b"): 0.05 * 0.3}
    total = sum(ways.values())
    for i, piece in enumerate(sorted(probabilities)):
        assert np.isclose(uses[i], 2 * sum(w for way, w in ways.items() if piece in way) / total)


def test_held_out_documents_are_recognised(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out")
    assert held.count() > 250
    assert held.where("lang_pred = lang").count() / held.count() > 0.98
    assert got.where("score < 0 or score > 1").count() == 0
    fold = spark.sql("select pmod(crc32(cast(cast(7 as bigint) as string)), 3) as f").first()[0]
    assert got.where("doc_id = 7").first().held_out == (fold == 1)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs([(*r, "en" if i % 2 else "de") for i, r in enumerate(odd_rows)])
    model = language.train(docs, PIECES, sample=10)
    got = language.predict(docs, model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred in ("de", "en")) == letters
        assert 0 <= r.score <= 1
    assert language.predict(make_docs([]), model).collect() == []
    few = language.train(make_docs([(1, "ein text", "de"), (2, "noch ein text", "de"), (3, "a text", "en"), (4, "un texte", "fr")]), PIECES, max_languages=2)
    assert few.languages == ["de", "en"]
    nothing = language.train(make_docs([(1, "text"), (2, None)]), PIECES)
    assert [(r.lang_pred, r.score) for r in language.predict(docs, nothing).select("lang_pred", "score").distinct().collect()] == [("und", 0.0)]


def test_a_row_does_not_see_its_own_label(make_docs):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(20)] + [(30 + i, "der hund und die katze " * 5, "de") for i in range(20)]
    docs = make_docs([*rows, (90, "der hund und die katze", "en")])
    model = language.train(docs.where(F.col("doc_id") != 90), PIECES)
    assert language.predict(docs, model).where("row.doc_id = 90").first().lang_pred == "de"
