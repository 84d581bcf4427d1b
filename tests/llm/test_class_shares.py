"""Scores of a bounded sample of the classes."""

import math

from pyspark.sql import functions as F

from palisade.llm import toxicity


def test_the_sample_does_not_change_the_odds(spark):
    """A text that tells nothing scores by the true share of toxic rows (a twentieth), whatever the bound of the sample."""
    rows = [(i, f"n{i % 7} n{i % 11} n{i % 13}", int(i % 20 == 0)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    are = {r.toxic: r.n for r in labels.filter(~toxicity.held_out(F.col("doc_id"))).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert abs(toxicity.shift(labels, {0: 100, 1: 100}) - math.log(are[1] / are[0])) < 1e-9
    assert abs(toxicity.shift(labels, are)) < 1e-9
    for bound in (10_000, 100):
        [score] = toxicity.learnt(docs, labels, bound).scores([toxicity.hashed("zz yy")])
        assert score < 0.1
