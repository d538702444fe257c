import base64
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken

from tallyforge.llm import minhash_dedup
from test_near import groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    """Documents in two invented languages, with copies, near copies and texts that no language stage keeps."""
    rng = random.Random(9)
    words = {"en": ["the", "and", "house", "river", "stone", "walking", "other", "bright"], "de": ["der", "und", "haus", "fluss", "stein", "gehen", "anders", "hell"]}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en"]) for _ in range(80)), lang if i % 4 else None, f"s{i % 3}", None))
    rows += [(100 + i, rows[i][1].upper(), None, None, 5) for i in range(8)]
    rows += [(200 + i, rows[i + 8][1] + " tail", rows[i + 8][2], "x", 5) for i in range(8)]
    rows += [(300, None, "en", None, None), (301, "", None, None, None), (302, "12 34 !!", "de", None, None), (303, "  \n", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i % 10 == 0)) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_every_stage_against_brute_force(spark, tmp_path):
    rows = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    spoken = steps["language ID"](spark, docs, str(tmp_path))
    assert spoken.columns == COLUMNS
    assert sorted(r.doc_id for r in spoken.collect()) == sorted(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))

    whole = steps["exact dedup"](spark, spoken, str(tmp_path))
    last = {}
    for r in sorted(spoken.collect()):
        last[r.text.lower()] = r.doc_id
    assert whole.columns == COLUMNS
    assert sorted(r.doc_id for r in whole.collect()) == sorted(last.values())

    apart = steps["MinHash near-dedup"](spark, whole, str(tmp_path))
    want = [doc for doc, _, least in groups([(r.doc_id, r.text) for r in whole.collect()], 5) if doc == least]
    assert apart.columns == COLUMNS
    assert sorted(r.doc_id for r in apart.collect()) == sorted(want)

    mixed = steps["mixing sources to target weights"](spark, apart, str(tmp_path))
    assert mixed.columns == COLUMNS
    assert set(Counter(r.doc_id for r in mixed.collect())) <= set(want)

    encoded = steps["byte-level BPE encoding and decoding"](spark, mixed, str(tmp_path))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in encoded.collect():
        assert r.token_ids == library.encode_ordinary(r.text)
        assert (r.decoded_text, r.n_tokens) == (r.text, len(r.token_ids))


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Студенты читают много книг в библиотеке города, а потом возвращаются домой, когда наступает ночь.",
               "Gli studenti leggono molti libri nella biblioteca della città e poi tornano a casa quando scende la notte.",
               "学生们在城市的图书馆里读很多书,然后在夜晚来临时回家。"]
    more = spark.createDataFrame([(-1 - i, text, None) for i, text in enumerate(foreign)], docs.schema)
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(more), "").collect()
    spoken = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(r.doc_id for r in kept) == sorted(spoken)


def test_run_joins_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == [*COLUMNS, "token_ids", "n_tokens", "decoded_text"]
    rows = got.collect()
    assert len(rows) > 100
    assert all(r.decoded_text == r.text for r in rows)
    one = {r.doc_id: r.text for r in rows}
    assert len({t.lower() for t in one.values()}) == len(one)
    again = minhash_dedup.near_groups(spark.createDataFrame(list(one.items()), "doc_id long, text string"))
    assert again.where("not kept").count() == 0


def test_stages_on_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
