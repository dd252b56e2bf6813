"""The pipeline's stages after the fitted ones, against brute force over each stage's own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from odd import SCHEMA, documents
from test_set_operators import brute_components

from tamis.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        steps.append(f(spark, steps[-1], SF).cache())
    assert all(s.columns == names for s in steps[:-1])
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) <= set(ids[1])
    groups = brute_components([(r.doc_id, r.text) for r in steps[2].collect()])
    assert sorted(ids[3]) == sorted(i for i, _, least in groups if i == least)
    copies = {r.doc_id: r.copies for r in mixing.mix_report(steps[3]).collect()}
    assert Counter(ids[4]) == Counter({i: n for i, n in copies.items() if n})
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = steps[5].collect()
    assert Counter(r.doc_id for r in out) == Counter(ids[4])
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_near_duplicates_with_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text, "en", "a", 3), (3, "", "en", "a", 0), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, df, SF).collect()
    assert sorted(r.doc_id for r in out) == [1, 3, 4]


def test_odd_documents_and_clashing_names(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for start in (docs, docs.limit(0)):
        steps = [start]
        for _, f in corpus_pipeline.STAGES[:-1]:
            steps.append(f(spark, steps[-1], SF).cache())
            assert steps[-1].columns == docs.columns and steps[-1].count() <= 3 * steps[-2].count()
        out = corpus_pipeline.STAGES[-1][1](spark, steps[-1], SF).collect()
        assert len(out) == steps[-1].count()
    words = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).select("doc_id").collect()}
    assert not words & {200, 201, 202, 205} and 203 in words


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
