import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions.scalars import average_subdomain_entropy, capped, seconds_between, shannon_entropy, shortened, z_score


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "bigint"}
    return spark.range(1).select(column(*(F.lit(v).cast(kinds[type(v)]) for v in values.values()))).first()[0]


def entropy(s):
    return sum(-s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0


@pytest.mark.parametrize(("text", "bits"), [("aaaaaa", 0.0), ("mail", 2.0), ("", 0.0), ("ab", 1.0), ("ééàà", 1.0)])
def test_shannon(spark, text, bits):
    got = one(spark, shannon_entropy, s=text)
    assert got == pytest.approx(bits)
    assert math.copysign(1, got) == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc.-é", max_size=12), min_size=1, max_size=8))
def test_subdomain_entropy_by_brute_force(spark, names):
    def slow(name):
        labels = name.rstrip(".").split(".")
        own = labels[:1] if len(labels) <= 2 else labels[:-2]
        return sum(map(entropy, own)) / len(own)

    rows = spark.createDataFrame(list(enumerate(names)), "i int, s string").select("i", average_subdomain_entropy(F.col("s")).alias("h")).collect()
    for r in rows:
        assert r.h == pytest.approx(slow(names[r.i]))


@pytest.mark.parametrize(("name", "bits"), [("example.com", 2.5216), ("internal.corp", 2.75), ("api.example.com", 1.585), ("mail.example.com.", 2.0), ("...", 0.0), ("", 0.0), ("host", 2.0)])
def test_subdomain_entropy(spark, name, bits):
    assert one(spark, average_subdomain_entropy, s=name) == pytest.approx(bits, abs=1e-4)


def test_scores(spark):
    assert one(spark, lambda m: z_score(m, 2.0, 0.5), m=3.0) == 2.0
    assert one(spark, lambda m: z_score(m, 2.0, 0.0), m=3.0) == 0.0
    assert one(spark, capped, s=1.7) == 1.0
    assert one(spark, capped, s=-0.7) == 0.0


def test_seconds_are_boundaries(spark):
    got = spark.sql("SELECT timestamp'2024-01-01 00:00:00.9' AS a, timestamp'2024-01-01 00:00:02.1' AS b").select(seconds_between(F.col("a"), F.col("b"))).first()[0]
    assert got == 2


def test_shortened(spark):
    assert one(spark, lambda s: shortened(s, 8), s="a\tb") == "a b"
    assert one(spark, lambda s: shortened(s, 8), s="123456789") == "12345..."
