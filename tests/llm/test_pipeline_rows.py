"""The pipeline's stages decide for each row by what it says, whatever its id."""

import random

import corpus_pipeline
from odd import SCHEMA, documents, sentence
from pyspark.sql import functions as F

from tamis.llm import langid
from tamis.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(1)
    x, a, c, d = (sentence(rng, 60) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(3, x), (5, a), (5, near(x)), (7, c), (7, near(c)), (7, c), (None, d), (None, near(d)), (None, x), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect()]
    assert {(3, x), (5, a), (None, None), (9, "")} < set(got) and len(got) == 6
    assert sum(g in [(7, c), (7, near(c))] for g in got) == 1 and sum(g in [(None, d), (None, near(d))] for g in got) == 1


def test_near_duplicates_of_odd_documents(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    out = corpus_pipeline.one_of_each_group(spark, df, SF)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and len(got) == len(set(got)) and (8, documents()[8][1]) in got
    assert (None, documents()[0][1]) not in got and (8, "another text with the id eight and enough words") in got


def test_mixtures_of_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [r.text for r in docs.where("length(text) > 500").groupBy("lang").agg(F.min("text").alias("text")).collect()]
    mixture = spark.createDataFrame([(10**9, " ".join(t[:500] for t in parts)), (10**9 + 1, "12 34 !!")], "doc_id long, text string")
    docs = docs.unionByName(mixture, allowMissingColumns=True)
    named = langid.identify(docs, langid.train(docs.where(crc_mod("doc_id", 3) != 1)), keep=("doc_id",)).collect()
    score = {r.doc_id: r.score for r in named}
    assert score[10**9] < 0.4
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in named if r.lang_pred != "und"} and 10**9 in kept and 10**9 + 1 not in kept
